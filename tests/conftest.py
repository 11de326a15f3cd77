from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from marketlens.plans import job  # noqa: E402
from marketlens.session import build_session  # noqa: E402
from tests.shop import write_shop  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "marketlens-tests",
        "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def shop_csv(tmp_path_factory):
    """Folder of hand-made raw CSV files."""
    folder = tmp_path_factory.mktemp("raw")
    write_shop(folder)
    return str(folder)


@pytest.fixture(scope="session")
def prepared(spark, shop_csv, tmp_path_factory):
    """Folder of prepared tables and the checks of the preparation."""
    folder = str(tmp_path_factory.mktemp("prepared"))
    checks = job.prepare(spark, shop_csv, folder, late_share=(0.2, 0.6))
    return folder, {row["check"]: row for row in checks.collect()}


@pytest.fixture(scope="session")
def shop(spark, prepared):
    """The fact of the hand-made shop."""
    return spark.read.parquet(f"{prepared[0]}/orders_enriched.parquet")


@pytest.fixture(scope="session")
def shop_orders(spark, prepared):
    """The order rollup of the hand-made shop."""
    return spark.read.parquet(f"{prepared[0]}/agg_order.parquet")

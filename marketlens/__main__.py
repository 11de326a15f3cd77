"""Prepare the tables: ``python -m marketlens <folder of CSV files> <output folder>``."""

from __future__ import annotations

import argparse
from datetime import date

from marketlens.plans.job import prepare, refresh, require
from marketlens.session import build_session


def main() -> None:
    parser = argparse.ArgumentParser(prog="marketlens", description="Prepare the marketplace tables.")
    parser.add_argument("raw", help="folder with <table>.csv for each raw table")
    parser.add_argument("output", help="folder for the Parquet tables")
    parser.add_argument("--late-share", nargs=2, type=float, metavar=("FROM", "TO"), help="expected share of late items")
    parser.add_argument("--months", nargs="+", metavar="YYYY-MM", help="only bring these purchase months up to date")
    options = parser.parse_args()
    if options.months:
        refresh(build_session(), options.raw, options.output, [date.fromisoformat(f"{month}-01") for month in options.months])
        return
    late_share = tuple(options.late_share) if options.late_share else None
    checks = prepare(build_session(), options.raw, options.output, late_share)
    checks.show(truncate=False)
    require(checks)


if __name__ == "__main__":
    main()

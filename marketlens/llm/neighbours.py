"""Exact nearest neighbours: shifted space-filling curves bound them, one pass over all vectors finds them.

Each of ``CURVES`` Hilbert curves runs through a grid of its own: vectors are projected on ``DIMS``
random orthogonal directions and every coordinate is cut at quantiles that are shifted from curve to
curve. Sorted along a curve, the vectors within ``REACH`` places of a query are its candidates; the
candidates of all curves are merged and ranked by their exact distance. Directions and quantiles
are fitted on a sample of at most ``SAMPLE`` vectors; every vector is indexed.

The distance of a query's last candidate is a bound: nothing farther can be among its nearest. Then every
block of at most ``PACK`` points meets every block of at most ``PACK`` queries once, and each query takes
from it its nearest within the bound. So the result is exact, whatever the number of vectors and
however they lie; ``CURVES`` and ``REACH`` only decide how tight the bound is. The work of that pass is the number of
queries times that of points, as it must be where distances tell nothing in advance.

Equal vectors are one point of the index, which keeps the least ``k + 1`` ids: as ties go to smaller
ids, no other can be among the ``k`` nearest of any query. So a vector that many rows share costs
one place. Places along a curve are running totals in two levels; a block of ``BLOCK`` places and the
queries whose window reaches into it make a task's work, whatever the input.

Cases. Vectors that are null, all zero or hold null or non-finite components take no part, nor do rows
with a null id, nor vectors of another length than the commonest of the sample. Rows that repeat id and
vector count once; a query id with several vectors is searched for each. Where there are fewer than
``k`` others all are returned; an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from marketlens.llm.common import read, stage

CURVES = 48
DIMS = 12
BITS = 5
REACH = 320
BLOCK = 2048
SAMPLE = 10_000
SEED = 7
SALTS = 64
RUNS = 4096
PACK = 1024
#: Rounding of squared distances from products, relative to the squares that they are made of.
ROUNDING = 1e-9


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of integer cells (rows x dimensions), by Skilling's transform."""
    x = np.ascontiguousarray(cells.T.astype(np.int64))
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for axis in x:
            swap = np.where(axis & bit, 0, (x[0] ^ axis) & low)
            flip = np.where(axis & bit, low, 0)
            x[0] ^= swap ^ flip
            if axis is not x[0]:
                axis ^= swap
        bit >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn, bit = np.zeros_like(x[0]), 1 << (bits - 1)
    while bit > 1:
        turn ^= np.where(x[-1] & bit, bit - 1, 0)
        bit >>= 1
    x ^= turn
    keys = np.zeros(x.shape[1], np.int64)
    for b in reversed(range(bits)):
        for axis in x:
            keys = (keys << 1) | ((axis >> b) & 1)
    return keys


class Curves:
    """Directions and cuts of every curve, fitted on a sample of vectors."""

    def __init__(self, sample: np.ndarray, curves: int = CURVES):
        rng = np.random.default_rng(SEED)
        width = sample.shape[1]
        dims = min(DIMS, width)
        self.bits = min(60 // dims, 16) if dims < DIMS else BITS
        self.directions, self.cuts = [], []
        for _ in range(curves):
            self.directions.append(np.linalg.qr(rng.normal(size=(width, dims)))[0])
            levels = (np.arange(2**self.bits - 1) + rng.random((dims, 1))) / 2**self.bits
            projected = sample @ self.directions[-1]
            self.cuts.append([np.quantile(projected[:, i], levels[i]) for i in range(dims)])

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """Rows x curves."""
        found = []
        for direction, cuts in zip(self.directions, self.cuts):
            projected = vectors @ direction
            cells = np.stack([np.searchsorted(cut, projected[:, i]) for i, cut in enumerate(cuts)], axis=1)
            found.append(hilbert_keys(cells, self.bits))
        return np.stack(found, axis=1)


def _packed_vectors(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = batch.column("vector")
        if len(batch):
            values = vectors.flatten().to_numpy().astype(np.float64).reshape(-1, width)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([row.tobytes() for row in values], pa.binary())], names=["id", "vector"]
            )


def _keys(batches: Iterator[pa.RecordBatch], curves: Curves) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        vectors = _matrix(batch.column("vector"))
        keys = curves.keys(vectors)
        lists = pa.ListArray.from_arrays(
            pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel())
        )
        yield pa.RecordBatch.from_arrays([batch.column("point"), lists], names=["point", "keys"])


def _matrix(vectors: pa.Array) -> np.ndarray:
    rows = vectors.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def _search(table: pa.Table, reach: int, k: int) -> pa.Table:
    """The nearest of one block's vectors for each query that reaches into it."""
    table = table.combine_chunks()
    asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
    places, points = table.column("place").to_numpy(), table.column("point").to_numpy()
    vectors = _matrix(table.column("vector").combine_chunks())
    members = table.column("members").to_pylist()
    base = np.flatnonzero(~asks)
    out: list[tuple[int, int, float]] = []
    for q in np.flatnonzero(asks):
        inside = base[np.abs(places[base] - places[q]) <= reach]
        scores = np.sqrt(((vectors[inside] - vectors[q]) ** 2).sum(axis=1))
        # Points are distinct vectors, so the nearest k + 1 of them hold the nearest k + 1 ids, but for ties at the last.
        if len(inside) > k + 1:
            near = scores <= np.partition(scores, k)[k]
            inside, scores = inside[near], scores[near]
        found = sorted((score, i) for score, at in zip(scores.tolist(), inside.tolist()) for i in members[at])
        out += [(int(points[q]), i, score) for score, i in found[: k + 1]]
    columns = list(zip(*out)) or [[], [], []]
    return pa.table({"point": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of at most PACK points: their other columns as lists, the vectors one after another."""
    for batch in batches:
        for start in range(0, len(batch), PACK):
            part = batch.slice(start, PACK)
            columns = {
                name: pa.array([b"".join(part.column(name).to_pylist())], pa.binary()) if name == "vector"
                else pa.array([part.column(name).to_pylist()], pa.list_(part.schema.field(name).type))
                for name in part.schema.names
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _within(batches: Iterator[pa.RecordBatch], width: int, k: int) -> Iterator[pa.RecordBatch]:
    """Of each pair of packs the nearest points of each query, none beyond its bound."""
    for batch in batches:
        for row in range(len(batch)):
            at = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
            base = np.frombuffer(at["vector"], np.float64).reshape(-1, width)
            asked = np.frombuffer(at["asked_vector"], np.float64).reshape(-1, width)
            bounds = np.array(at["bound"], np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                squares, own = (base**2).sum(axis=1), (asked**2).sum(axis=1)
                sums = own[:, None] + squares
                # Negated, so that what overflows is looked at, too.
                close = ~(sums - 2 * (asked @ base.T) > bounds[:, None] ** 2 + ROUNDING * sums)
            out: list[tuple[int, int, float]] = []
            for q in np.flatnonzero(close.any(axis=1)):
                inside = np.flatnonzero(close[q])
                scores = np.sqrt(((base[inside] - asked[q]) ** 2).sum(axis=1))
                if len(inside) > k + 1:
                    near = scores <= np.partition(scores, k)[k]
                    inside, scores = inside[near], scores[near]
                found = sorted((score, i) for score, point in zip(scores.tolist(), inside.tolist()) for i in at["members"][point])
                out += [(at["asked_point"][q], i, score) for score, i in found[: k + 1]]
            columns = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
                names=["point", "vec_id", "score"],
            )


def usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """``id`` and ``vector`` of the rows that take part."""
    vector = F.col(column).cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (
        vectors.select(F.col(id_column).cast("long").alias("id"), vector.alias("vector"))
        .where(F.col("id").isNotNull() & F.col("vector").isNotNull())
        .where(finite & F.exists("vector", lambda x: x != 0))
    )


def nearest(vectors: DataFrame, is_query, id_column: str = "vec_id", column: str = "embedding", k: int = 10,
            curves: int = CURVES, reach: int = REACH) -> DataFrame:
    """Per query: query_id, rank (from 1), vec_id, score (Euclidean distance), nearest first.

    ``is_query`` makes a condition from the column of ids.
    """
    spark = vectors.sparkSession
    empty = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors, id_column, column)
    sample = [r["vector"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").collect()]
    if not sample:
        return spark.createDataFrame([], empty)
    lengths = [len(v) for v in sample]
    width = max(sorted(set(lengths)), key=lengths.count)
    fitted = Curves(np.array([v for v in sample if len(v) == width]), curves)

    packed = stage(
        rows.where(F.size("vector") == width).mapInArrow(partial(_packed_vectors, width=width), "id long, vector binary").distinct(),
        "vectors",
    )
    # The least k + 1 ids of each distinct vector, salted first.
    by_part = Window.partitionBy("vector", F.pmod(F.xxhash64("id"), F.lit(SALTS))).orderBy("id")
    by_vector = Window.partitionBy("vector").orderBy("id")
    members = (
        packed.withColumn("n", F.row_number().over(by_part)).where(F.col("n") <= k + 1)
        .withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1)
        .groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("members"))
    )
    # A point is named by its least id, which no other vector has, unless an id has several vectors.
    asked = packed.where(is_query(F.col("id"))).select("vector", F.lit(True).alias("asked")).distinct()
    points = stage(
        members.join(asked, "vector", "left").select(
            F.xxhash64("vector", F.get("members", 0)).alias("point"), "vector", "members", F.coalesce("asked", F.lit(False)).alias("asked")
        ),
        "points",
    )

    keys = points.select("point", "vector").mapInArrow(partial(_keys, curves=fitted), "point long, keys array<long>")
    along = stage(
        keys.select("point", F.posexplode("keys").alias("curve", "key")).withColumn(
            "run", F.shiftright("key", max(0, fitted.bits * min(DIMS, width) - 12))
        ),
        "curve-keys",
    )
    before = Window.partitionBy("curve").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = along.groupBy("curve", "run").agg(F.count("*").alias("n")).select(
        "curve", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy("curve", "run").orderBy("key", "point")
    placed = (
        along.withColumn("n", F.row_number().over(inside) - 1)
        .join(offsets, ["curve", "run"])
        .groupBy("point")
        .agg(F.collect_list(F.struct("curve", (F.col("offset") + F.col("n")).alias("place"))).alias("places"))
    )
    spread = points.join(placed, "point").select("point", "vector", "members", "asked", F.inline("places"))
    first, last = F.floor(F.greatest(F.col("place") - reach, F.lit(0)) / BLOCK), F.floor((F.col("place") + reach) / BLOCK)
    blocks = F.concat(
        F.array(F.struct(F.lit(False).alias("asks"), F.floor(F.col("place") / BLOCK).alias("block"))),
        F.when(F.col("asked"), F.transform(F.sequence(first, last), lambda b: F.struct(F.lit(True).alias("asks"), b.alias("block")))).otherwise(
            F.array().cast("array<struct<asks:boolean,block:bigint>>")
        ),
    )
    work = spread.select("point", "vector", "curve", "place", "members", F.inline(blocks))

    def search(table: pa.Table) -> pa.Table:
        return _search(table, reach, k)

    found = work.groupBy("curve", "block").applyInArrow(search, "point long, vec_id long, score double").distinct()
    ranked = Window.partitionBy("point").orderBy("score", "vec_id")
    best = found.withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= k + 1).select("point", "vec_id", "score")
    # Fewer than k + 1 candidates bound nothing.
    bounds = best.groupBy("point").agg(F.when(F.count("*") > k, F.max("score")).otherwise(F.lit(float("inf"))).alias("bound"))
    asking = stage(
        points.where("asked").join(bounds, "point", "left")
        .select("point", F.coalesce("bound", F.lit(float("inf"))).alias("bound"), "vector")
        .mapInArrow(_packs, "point array<long>, bound array<double>, vector binary")
        .withColumnsRenamed({"point": "asked_point", "vector": "asked_vector"}),
        "query-packs",
    )
    base = stage(points.select("members", "vector").mapInArrow(_packs, "members array<array<long>>, vector binary"), "point-packs")
    exact = base.crossJoin(asking).mapInArrow(partial(_within, width=width, k=k), "point long, vec_id long, score double").distinct()
    best = exact.withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= k + 1).select("point", "vec_id", "score")

    queries = packed.where(is_query(F.col("id"))).join(points.where("asked").select("point", "vector"), "vector").select(
        F.col("id").alias("query_id"), "point"
    )
    own = Window.partitionBy("query_id", "point").orderBy("score", "vec_id")
    return (
        queries.join(best, "point")
        .where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(own))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op7_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)

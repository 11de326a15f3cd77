"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint has 64 bits; a bit is set if it is set in over half the hashes of the text's word
shingles. Only distinct fingerprints are compared. Split into four blocks, two fingerprints that
differ in at most two bits agree on two blocks, so each goes to six buckets by pairs of blocks.
A bucket with over ``BUCKET`` fingerprints is split again in the same way, by the bits it does
not agree on yet, and once more if need be: then 56 bits agree and 256 fingerprints are all it can
hold. So no bucket is compared whole beyond that bound, and no link is lost.

In a bucket the bit planes are stored vertically, one bit per fingerprint. The distances of one
fingerprint to all are counted plane by plane with carry-save counters, one word for each digit of
64 counts, and a block of 64 fingerprints is abandoned once all are beyond the radius. Buckets give a
spanning forest of their links; components are found by alternating star steps over staged tables.

``drop_near_copies`` keeps one row of each component: that with the least doc_id, or one of those without an id.

Cases. A null text has no words; no words give fingerprint zero, which links like any other. Rows
with equal texts have equal fingerprints. A null doc_id is never the smallest; where a component
has no other, its id is null. Rows that repeat a doc_id are fingerprinted each on its own. An empty
table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.common import packed, read, release, stage

SEED = 42
SHINGLE = 3
RADIUS = 2
BUCKET = 1024
QUERIES_AT_ONCE = 64
ABANDON_EVERY = 8
LEVELS = (16, 8, 4)  # bits of a block


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """Hashes of the shingles, repeats included; fewer words than a shingle make one."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends, at = [], -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    first = min(shingle, len(words)) - 1
    starts = [0, *(end + 1 for end in ends[: len(ends) - first - 1])]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[first:])), np.uint64, len(starts))


def fingerprint_of(hashes: np.ndarray) -> int:
    """Signed number of the fingerprint's 64 bits."""
    counts = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[part : part + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes, shingle: int) -> int:
    return fingerprint_of(shingle_hashes(text, shingle))


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        found = [fingerprint(text.as_py().encode() if text.is_valid else b"", shingle) for text in texts]
        others = [name for name in batch.schema.names if name != "text"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, others), pa.array(found, pa.int64())], names=[*others, "fp"])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``fp`` in place of ``text``; the other columns are numbers."""
    others = ", ".join(f"{name} long" for name in docs.columns if name != "text")
    return docs.mapInArrow(partial(_fingerprints, shingle=shingle), f"{others}, fp long")


def _planes(fps: np.ndarray) -> np.ndarray:
    """Bit plane b holds bit b of every fingerprint; 64 fingerprints to a word."""
    padded = np.zeros(-(-len(fps) // 64) * 64, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def near(fps: np.ndarray, queries: np.ndarray, planes: np.ndarray, radius: int) -> np.ndarray:
    """Boolean matrix, queries x fingerprints: at most ``radius`` bits differ."""
    wide = planes.shape[1]
    digits = (radius + 1).bit_length()
    counts = np.zeros((digits, len(queries), wide), np.uint64)  # bitwise counters, lowest digit first
    over = np.zeros((len(queries), wide), np.uint64)
    alive = np.arange(wide)
    done = np.full((len(queries), wide), ~np.uint64(0))
    full = np.where((queries[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), ~np.uint64(0), np.uint64(0))

    def beyond() -> np.ndarray:
        """Counters over the radius, from the highest digit down."""
        more, same = over.copy(), ~over
        for i in reversed(range(digits)):
            if radius >> i & 1:
                same &= counts[i]
            else:
                more |= same & counts[i]
                same &= ~counts[i]
        return more

    for b in range(64):
        carry = planes[b][None, alive] ^ full[:, b, None]
        for i in range(digits):
            counts[i], carry = counts[i] ^ carry, counts[i] & carry
        over |= carry
        if b % ABANDON_EVERY == ABANDON_EVERY - 1:
            keep = (beyond() != ~np.uint64(0)).any(axis=0)
            if not keep.all():
                alive, counts, over = alive[keep], counts[:, :, keep], over[:, keep]
                if not len(alive):
                    break
    if len(alive):
        done[:, alive] = beyond()
    bits = np.unpackbits(done.view(np.uint8).reshape(len(queries), -1), axis=1, bitorder="little")
    return bits[:, : len(fps)] == 0


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links within the radius that join the same fingerprints as all such links, as index pairs."""
    planes = _planes(fps)
    linked = np.concatenate(
        [near(fps, fps[i : i + QUERIES_AT_ONCE], planes, radius) for i in range(0, len(fps), QUERIES_AT_ONCE)]
    )
    unseen, edges = np.ones(len(fps), bool), []
    for root in range(len(fps)):
        if not unseen[root]:
            continue
        unseen[root] = False
        frontier = [root]
        while frontier:
            at = frontier.pop()
            new = np.flatnonzero(linked[at] & unseen)
            unseen[new] = False
            edges += [(at, int(i)) for i in new]
            frontier += new.tolist()
    return edges


def _pairs(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of buckets of two, all at once: the planes hold the differences of the pairs."""
    a, b = fps[starts[sizes == 2]], fps[starts[sizes == 2] + 1]
    if not len(a):
        return a, b
    close = near(a ^ b, np.zeros(1, np.uint64), _planes(a ^ b), radius)[0]
    return a[close], b[close]


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Edges of the buckets; rows come sorted by bucket, and a bucket may span batches."""
    table, key, rest = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def edges(table: np.ndarray, key: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate([[True], (table[1:] != table[:-1]) | (key[1:] != key[:-1])]))
        sizes = np.diff(np.concatenate([starts, [len(fps)]]))
        low, high = map(list, _pairs(fps, starts, sizes, radius))
        for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            group = fps[start : start + size]
            for i, j in forest(group, radius):
                low.append(group[i])
                high.append(group[j])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (low, high)], names=["a", "b"]
        )

    for batch in batches:
        columns = [batch.column(name).to_numpy() for name in ("table", "key", "fp")]
        table, key = np.concatenate([table, columns[0]]), np.concatenate([key, columns[1]])
        rest = np.concatenate([rest, columns[2].view(np.uint64)])
        if not len(rest):
            continue
        last = np.flatnonzero((table != table[-1]) | (key != key[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield edges(table[:cut], key[:cut], rest[:cut])
            table, key, rest = table[cut:], key[cut:], rest[cut:]
    if len(rest):
        yield edges(table, key, rest)


def _split(rows: DataFrame, block: int) -> DataFrame:
    """Put every fingerprint into six buckets by two of the four ``block``-bit blocks of its open bits.

    ``mask`` has the bits a bucket does not agree on yet; ``table`` tells the masks apart.
    """
    choices = []
    for path, mask in _tables(block):
        blocks = _blocks(mask, block)
        for number, (i, j) in enumerate(combinations(range(4), 2)):
            agreed = ~(mask & ~blocks[i] & ~blocks[j]) & (2**64 - 1)
            choices.append((path, path * 6 + number + 1, agreed))
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    by_path: dict[int, list[Column]] = {}
    for path, table, agreed in choices:
        by_path.setdefault(path, []).append(
            F.struct(F.lit(table).cast("long").alias("table"), F.col("fp").bitwiseAND(F.lit(signed(agreed))).alias("key"))
        )
    made = None
    for path, buckets in by_path.items():
        made = F.when(F.col("table") == path, F.array(*buckets)) if made is None else made.when(F.col("table") == path, F.array(*buckets))
    return rows.select("fp", F.inline(made))


def _blocks(mask: int, block: int) -> list[int]:
    """The open bits in four blocks, lowest first."""
    bits = [b for b in range(64) if mask >> b & 1]
    return [sum(1 << b for b in bits[i * block : (i + 1) * block]) for i in range(4)]


def _tables(block: int) -> list[tuple[int, int]]:
    """Number and open bits of every table that is split into blocks of this size."""
    tables = [(0, 2**64 - 1)]
    for size in LEVELS[: LEVELS.index(block)]:
        tables = [
            (path * 6 + number + 1, mask & ~blocks[i] & ~blocks[j])
            for path, mask in tables
            for blocks in [_blocks(mask, size)]
            for number, (i, j) in enumerate(combinations(range(4), 2))
        ]
    return tables


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints ``fp`` as all links within the radius do."""
    if not 0 <= radius <= 2:
        raise ValueError("the buckets hold for a radius of 0 to 2")
    open_ = fps.withColumn("table", F.lit(0).cast("long"))
    found = None
    for block in LEVELS:
        rows = stage(_split(open_, block), "simhash-buckets")
        sizes = rows.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1")
        sized = rows.join(sizes, ["table", "key"])
        last = block == LEVELS[-1]
        ready = sized if last else sized.where(F.col("n") <= BUCKET)
        edges = stage(
            ready.select("table", "key", "fp")
            .repartition("table", "key")
            .sortWithinPartitions("table", "key")
            .mapInArrow(partial(_links, radius=radius), "a long, b long"),
            "simhash-links",
        )
        found = edges if found is None else found.unionByName(edges)
        if last:
            break
        large = sized.where(F.col("n") > BUCKET).select("table", "fp")
        if large.isEmpty():
            break
        open_ = large
    return found


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node it is connected to; one row for every node with an edge.

    Large-star and small-star steps; a step is one aggregate and one join, so a node with very
    many neighbours is never gathered.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
        joined = both.join(least, "a")
        if large:
            moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("root").alias("b"))
        else:
            moved = joined.select(F.col("b").alias("a"), F.col("root").alias("b")).unionByName(
                joined.select("a", F.col("root").alias("b"))
            )
        return moved.where("a <> b").distinct()

    pairs = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    digest = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    before = pairs.agg(digest).first()[0]
    while True:
        after = stage(star(star(pairs, True), False), "stars")
        release(pairs)
        pairs, now = after, after.agg(digest).first()[0]
        if now == before:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Per document: doc_id, fp and component_id, the least doc_id of all it is linked to."""
    marked = stage(fingerprints(docs.select("doc_id", "text"), shingle), "fingerprints")
    return _with_components(marked, links(marked.select("fp").distinct(), radius))


def _with_components(marked: DataFrame, edges: DataFrame) -> DataFrame:
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("doc"))
    roots = components(edges).withColumnRenamed("node", "of")
    rooted = nodes.join(roots, nodes["fp"] == roots["of"], "left").select("fp", "doc", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp")


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each component of near-duplicates: that with the least doc_id, or one of those without an id.

    Rows are told apart by a number, not by doc_id, so of rows that repeat an id and its text one stays, too.
    """
    rows = stage(docs.select(packed(docs).alias("doc"), F.monotonically_increasing_id().alias("at")), "copy-rows")
    marked = stage(fingerprints(rows.select("at", "doc.doc_id", "doc.text"), shingle), "fingerprints")
    # Exact copies fold to one node before anything is joined.
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "at")
    nodes = marked.groupBy("fp").agg(F.min(order).alias("first"))
    roots = components(links(nodes.select("fp"), radius)).withColumnRenamed("node", "of")
    rooted = nodes.join(roots, F.col("fp") == F.col("of"), "left").select("first", F.coalesce("root", "fp").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.at").alias("at"))
    return rows.join(kept, "at", "left_semi").select("doc.*")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

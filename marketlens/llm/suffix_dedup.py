"""Removal of repeated 50-byte strings by distributed prefix doubling.

A position is removed from when the 50 bytes that start there also start somewhere in a
document with a smaller id. Ranks of strings of 1, 2, 4, 8 and 16 bytes are doubled in place
(rank pairs at growing offsets, named by hashes). From 16 bytes on Spark sorts position-rank
pairs and every round drops the positions whose rank is found in one document only:

1. 16 bytes. Of each 35 consecutive positions only the one with the least rank is sorted.
   Every 50-byte string holds 35 such positions, so equal strings sort the same one, and a
   string whose position has a unique rank can't repeat. Positions that agree on all bytes
   of all strings they stand for are settled here: the smallest document keeps them.
2. 32 bytes, the 16 doubled to the left or to the right; what is left after it is few.
3. 50 bytes: ranks of 32 bytes paired at an offset of 18, names of 96 bits.

Sorting every position in every round, as plain prefix doubling does, moves some ten times the
corpus through each shuffle; this moves one row for about 18 bytes, once.

Rows of equal rank are folded within a batch before they are shuffled, so a passage that many
documents share travels once a batch. A batch is bounded in rows and bytes by Spark, and the
hashing works on pieces of it of at most ``PIECE`` bytes, so a very long text costs time only.

Cases. A null text is empty. Texts under 50 bytes keep everything. A document with a null id is
neither smaller nor larger than another: nothing is removed from it, nor because of it. Equal
strings inside one document, or in rows that repeat a doc_id, are not repeats; rows that repeat
an id with another text are cut like the union of them. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from marketlens.llm.common import read, release, stage

LENGTH = 50
CORE = 16
HALF = 2 * CORE
SPREAD = LENGTH - CORE + 1  # positions that a string chooses from
PIECE = 1 << 20
POSITION_BITS = 22

_M = np.uint64(0x9E3779B97F4A7C15)
_BITS = np.uint64((1 << POSITION_BITS) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _names(seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix((np.arange(256, dtype=np.uint64) + np.uint64(seed * 256 + 1)) * _M)


def _doubled(ranks: np.ndarray, offset: int) -> np.ndarray:
    """Ranks of the strings made of two, ``offset`` apart."""
    pairs = ranks[:-offset] * _M
    pairs += ranks[offset:]
    return _mix(pairs)


def _ranks(data: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks of the 16, 32 and 50 bytes from each position."""
    ranks = _names(seed)[data]
    for offset in (1, 2, 4, 8):
        ranks = _doubled(ranks, offset)
    half = _doubled(ranks, CORE)
    return ranks, half, _doubled(half, LENGTH - HALF)


def _least(ranks: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    reach = 1
    while 2 * reach <= width:
        ranks = np.minimum(ranks[:-reach], ranks[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(ranks[:-rest], ranks[rest:]) if rest else ranks


def _pieces(offsets: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int, int, int]]]]:
    """Byte ranges of at most PIECE, each with its documents: (id, begin and end in the range, offset in the text).

    A longer text is cut so that every 50-byte string lies in one range.
    """
    group: list[tuple[int, int, int, int]] = []
    begin = end = None
    for i, doc in enumerate(ids):
        low, high = int(offsets[i]), int(offsets[i + 1])
        if high - low < LENGTH:
            continue
        if group and (high - begin > PIECE):
            yield begin, end, group
            group = []
        if high - low > PIECE:
            at = low
            while at < high - LENGTH + 1:
                stop = min(high, at + PIECE)
                yield at, stop, [(int(doc), 0, stop - at, at - low)]
                at = stop - LENGTH + 1
            continue
        if not group:
            begin = low
        group.append((int(doc), low - begin, high - begin, 0))
        end = high
    if group:
        yield begin, end, group


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, text bytes and offsets; rows without id are left out by the caller."""
    text = batch.column("text")
    text = text.cast(pa.binary()) if not pa.types.is_binary(text.type) else text
    _, offsets, data = text.buffers()
    offsets = np.frombuffer(offsets, np.int32)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return batch.column("doc_id").to_numpy(zero_copy_only=False), data, offsets


def _anchors(data: np.ndarray, docs: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, ...]:
    """Rank, rank with surroundings, document and place of each chosen position.

    ``at`` packs the place of the first string that chose it (31 bits), how many more did (6), how far
    the position is from the first (6), and ten bits each of the ranks doubled to the left and right.
    """
    core, half, full = _ranks(data)
    ordered = (core & ~_BITS) | np.arange(len(core), dtype=np.uint64)
    chosen = (_least(ordered, SPREAD) & _BITS).astype(np.int64)
    valid = np.zeros(len(chosen), bool)
    of, shift = np.zeros(len(chosen), np.int64), np.zeros(len(chosen), np.int64)
    for doc, low, high, inside in docs:
        valid[low : high - LENGTH + 1] = True
        of[low : high - LENGTH + 1] = doc
        shift[low : high - LENGTH + 1] = inside - low
    starts = np.flatnonzero(valid)
    picks = chosen[starts]
    new = np.flatnonzero(np.concatenate([[True], picks[1:] != picks[:-1]]))
    last = np.concatenate([new[1:], [len(picks)]]) - 1
    low, high, anchor = starts[new], starts[last], picks[new]
    more, lead = high - low, anchor - low
    context = full[low] * _M
    context += full[high]
    context = _mix(_mix(context) + more.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    top = np.uint64(54)
    left = np.where(lead > CORE, half[np.maximum(anchor - CORE, 0)] >> top, np.uint64(0)).astype(np.int64)
    right = np.where(lead - more <= CORE, half[np.minimum(anchor, len(half) - 1)] >> top, np.uint64(0)).astype(np.int64)
    at = (low + shift[low]) << 32 | more << 26 | lead << 20 | left << 10 | right
    return core[anchor].view(np.int64), context.view(np.int64), of[low], at


def _folded(first: np.ndarray, second: np.ndarray, doc: np.ndarray, at: np.ndarray, with_second: bool) -> pa.RecordBatch:
    """One row per pair of ranks: the least document, and the others as a list of document, place, document, place.

    The columns that end in zero bytes stand together, which compresses best.
    """
    key = _mix(first.view(np.uint64) * _M + second.view(np.uint64))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    member = np.zeros(len(order), bool)
    member[1:] |= same
    member[:-1] |= same
    single, several = order[~member], order[member]
    several = several[np.lexsort((at[several], doc[several], second[several], first[several]))]
    a, b = first[several], second[several]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(several) else np.zeros(0, int)
    heads = np.zeros(len(several), bool)
    heads[new] = True
    sizes = np.diff(np.concatenate([new, [len(several)]])) - 1
    rest = several[~heads]
    lists = np.stack([doc[rest], at[rest]], axis=1).ravel()
    rows = np.concatenate([single, several[heads]])
    lengths = np.concatenate([np.zeros(len(single), np.int64), 2 * sizes])
    more = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(lists),
        mask=pa.array(lengths == 0),
    )
    return pa.RecordBatch.from_arrays(
        [pa.array(first[rows]), *([pa.array(second[rows])] if with_second else []), pa.array(at[rows]), pa.array(doc[rows]), more],
        names=["first", *(["second"] if with_second else []), "at", "doc", "more"],
    )


RANKED = "first long, second long, at long, doc long, more array<long>"
NAMED = "first long, at long, doc long, more array<long>"


def _rank_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, data, offsets = _columns(batch)
        found = [_anchors(data[low:high], docs) for low, high, docs in _pieces(offsets, ids)]
        if found:
            yield _folded(*map(np.concatenate, zip(*found)), True)


def _rank_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of 96 bits of the 50-byte strings that start in each document's ranges; ``at`` packs place and half a name."""
    for batch in batches:
        ids, data, offsets = _columns(batch)
        ranges = batch.column("ranges")
        bounds = ranges.offsets.to_numpy()
        lows, highs = (ranges.values.field(k).to_numpy(zero_copy_only=False) for k in ("low", "high"))
        wanted = {}
        for i, doc in enumerate(ids):
            part = slice(bounds[i], bounds[i + 1])
            wanted[int(doc)] = (lows[part], highs[part])
        found = []
        for low, high, docs in _pieces(offsets, ids):
            one, two = _ranks(data[low:high])[2], _ranks(data[low:high], 1)[2]
            for doc, begin, end, inside in docs:
                mark = np.zeros(end - begin - LENGTH + 2, np.int32)
                first, stop = (np.clip(x - inside, 0, len(mark) - 1) for x in wanted[doc])
                np.add.at(mark, first, 1)
                np.add.at(mark, stop, -1)
                starts = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
                places = begin + starts
                found.append((one[places].view(np.int64), two[places].view(np.int64), np.full(len(starts), doc), starts + inside))
        if found:
            first, second, doc, place = map(np.concatenate, zip(*found))
            half = second & 0xFFFFFFFF
            yield _folded(first, half, doc, place << 32 | half, False)


def _occurrences(ranked: DataFrame, *keys: str) -> DataFrame:
    """The folded rows spread out again, each with the least document of its rank."""
    least = F.min("doc").over(Window.partitionBy(*keys))
    others = F.transform(
        F.sequence(F.lit(0), F.size("more") - 2, F.lit(2)),
        lambda i: F.struct(F.get("more", i).alias("doc"), F.get("more", i + 1).alias("at")),
    )
    own = F.array(F.struct("doc", "at"))
    every = F.when(F.col("more").isNull(), own).otherwise(F.concat(own, others))
    return ranked.withColumn("least", least).select(*keys, "least", F.inline(every))


def _last(column: str = "more") -> Column:
    """The largest document of a folded row."""
    return F.coalesce(F.element_at(column, -2), F.col("doc"))


def find_repeats(docs: DataFrame) -> list[DataFrame]:
    """Byte ranges (doc, low, high) to remove, in staged parts; ranges of a document overlap."""
    texts = docs.where("doc_id IS NOT NULL AND octet_length(text) >= 50").select("doc_id", "text")

    # Round of 16 bytes.
    by_rank = Window.partitionBy("first")
    shared = (
        texts.mapInArrow(_rank_anchors, RANKED)
        .withColumns({"low_doc": F.min("doc").over(by_rank), "high_doc": F.max(_last()).over(by_rank)})
        .where("low_doc < high_doc")
    )
    low = F.shiftright("at", 32)
    spread = F.shiftright("at", 26).bitwiseAND(63)
    lead = F.shiftright("at", 20).bitwiseAND(63)
    placed = stage(
        _occurrences(shared, "first", "second").select(
            (F.col("doc") > F.col("least")).alias("settled"),
            F.when(F.col("doc") == F.col("least"), F.col("first")).alias("first"),
            "doc", low.alias("low"), spread.alias("spread"), lead.alias("lead"),
            F.shiftright("at", 10).bitwiseAND(1023).alias("left"), F.col("at").bitwiseAND(1023).alias("right"),
        ),
        "repeats-16",
    )
    settled = placed.where("settled").select("doc", "low", (F.col("low") + F.col("spread") + LENGTH).alias("high"))

    # Round of 32 bytes: ten bits of the rank are enough to drop by, as the 16 bytes agree already.
    anchor = F.col("low") + F.col("lead")
    end = F.col("low") + F.col("spread") + 1
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.col("left").alias("rank"), F.col("low").alias("low"), F.least(end, anchor - CORE).alias("high")),
        F.struct(F.lit(1).alias("side"), F.col("right").alias("rank"), F.greatest(F.col("low"), anchor - CORE).alias("low"), end.alias("high")),
    )
    by_half = Window.partitionBy("first", "side", "rank")
    halves = (
        placed.where("NOT settled")
        .select("first", "doc", F.inline(sides))
        .where("low < high")
        .withColumns({"low_doc": F.min("doc").over(by_half), "high_doc": F.max("doc").over(by_half)})
        .where("low_doc < high_doc")
    )
    ranges = stage(
        halves.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("low", "high")).alias("ranges")), "repeats-32"
    )

    # Round of 50 bytes.
    strings = texts.join(ranges, "doc_id").mapInArrow(_rank_strings, NAMED)
    named = strings.withColumn("second", F.col("at").bitwiseAND(F.lit(2**32 - 1)))
    low = F.shiftright("at", 32)
    edges = stage(
        _occurrences(named, "first", "second").where("doc > least").select("doc", low.alias("low"), (low + LENGTH).alias("high")),
        "repeats-50",
    )
    release(ranges)
    return [settled, edges]


def _cut(text: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, int]:
    """Mask of the bytes kept, and the number of removed runs."""
    mark = np.zeros(len(text) + 1, np.int32)
    np.add.at(mark, np.minimum(lows, len(text)), 1)
    np.add.at(mark, np.minimum(highs, len(text)), -1)
    gone = np.cumsum(mark[:-1]) > 0
    return ~gone, int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())


def _removals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, data, offsets = _columns(batch)
        ranges = batch.column("ranges")
        bounds, empty = ranges.offsets.to_numpy(), ranges.is_null().to_numpy(zero_copy_only=False)
        lows, highs = (ranges.values.field(k).to_numpy(zero_copy_only=False) for k in ("low", "high"))
        rows = []
        for i in range(len(batch)):
            text = data[offsets[i] : offsets[i + 1]]
            size, runs = len(text), 0
            if not empty[i]:
                keep, runs = _cut(text, lows[bounds[i] : bounds[i + 1]], highs[bounds[i] : bounds[i + 1]])
                text = text[keep]
            rows.append((size, size - len(text), runs, text.tobytes()))
        sizes, removed, runs, kept = zip(*rows)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, removed, runs)),
             pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    parts = find_repeats(docs)
    found = parts[0].unionByName(parts[1])
    ranges = found.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return texts.join(ranges, "doc_id", "left").mapInArrow(
        _removals, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))

"""Stretches of words that repeat with a period, by minimizers at several scales.

A run is a stretch of consecutive words whose smallest period q goes into it at least three times, that has 24 words or
more, and that no neighbouring word extends keeping the period. Inside a run the words around a place are the same q words
later, so whatever a window picks by its content alone it picks again q words later.

For periods from ``low`` up to 1.5 times that, a gram has as many words as the longest of these periods and a window has
the grams of 2 * ``low`` words; its minimizer is the gram of the least hash, the leftmost of equal ones. A run holds two
windows a period apart, so it holds two equal minimizers a period apart. As a gram is no shorter than the period it can't
occur in between, or the run had a smaller period. So of equal minimizers only neighbours are paired, which is one pair a
minimizer at most, and each pair is extended word by word: hashes only propose, words decide. Periods under ``SHORT``,
where a window would have few grams, are found by comparing every word with the one a lag later.

Texts of a batch are laid end to end with marks that occur once between them, up to ``CHUNK`` words at a time; one
longer text is a chunk of its own. Time is in proportion to words times scales, and to the words of runs found.

Cases. A null or empty text has no words, no runs and an empty collapsed text. Rows are worked on each by itself, so rows that
repeat an id or have none come back as often as they came. Ties in a window go to the left; of runs that start together
the shorter period comes first. An empty table gives no rows. Other columns than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.common import hex_sha256, read

LEAST_WORDS = 24
LEAST_TIMES = 3
SHORT = 16  # smaller periods are looked for by lag
CHUNK = 1 << 19

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _least(period: int) -> int:
    return max(LEAST_WORDS, LEAST_TIMES * period)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return x


def by_lag(words: np.ndarray, lag: int) -> list[tuple[int, int, int]]:
    """Longest stretches whose words are equal ``lag`` apart, if long enough for a run."""
    apart = np.flatnonzero(words[:-lag] != words[lag:])
    edges = np.concatenate([[-1], apart, [max(len(words) - lag, 0)]])
    gaps = np.diff(edges) - 1
    at = np.flatnonzero(gaps >= _least(lag) - lag)
    return [(int(edges[i]) + 1, int(gaps[i]) + lag, lag) for i in at]


def _window_minima(keys: np.ndarray, window: int) -> np.ndarray:
    least, size = keys, 1
    while 2 * size <= window:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = window - size
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def pairs_at_scale(grams: np.ndarray, window: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of minimizers and the distance to the next equal one, where it is from ``low`` to under ``high``."""
    bits = np.uint64(len(grams).bit_length())
    places = np.arange(len(grams), dtype=np.uint64)
    least = _window_minima((grams >> bits << bits) | places, window) & ((np.uint64(1) << bits) - np.uint64(1))
    at = least[np.concatenate([[True], least[1:] != least[:-1]])].astype(np.int64)
    order = np.argsort(grams[at], kind="stable")
    value, at = grams[at][order], at[order]
    apart = np.diff(at)
    wanted = (value[1:] == value[:-1]) & (apart >= low) & (apart < high)
    return at[:-1][wanted], apart[wanted]


def _extended(words: np.ndarray, place: int, period: int) -> tuple[int, int]:
    """First and last place + 1 around ``place`` whose words are equal ``period`` later."""
    end, step = place, 64
    while True:
        one, two = words[end : end + step], words[end + period : end + period + step]
        apart = np.flatnonzero(one[: len(two)] != two)
        if len(apart):
            end += int(apart[0])
            break
        end += len(two)
        if len(two) < step:
            break
        step *= 2
    start, step = place, 64
    while start:
        first = max(0, start - step)
        apart = np.flatnonzero(words[first:start] != words[first + period : start + period])
        if len(apart):
            return first + int(apart[-1]) + 1, end
        start, step = first, step * 2
    return start, end


def _scales(longest: int) -> Iterator[tuple[int, int]]:
    low = SHORT
    while LEAST_TIMES * low <= longest:
        yield low, low + low // 2
        low += low // 2


def runs_of(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Start, length and period of the runs of each text, given as numbers of words from 0 on."""

    def laid(numbers: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Texts end to end, a mark that occurs once after each, and where they start."""
        parts = [part for i in numbers for part in (texts[i], np.array([-1 - i], np.int64))]
        sizes = np.array([len(texts[i]) + 1 for i in numbers], np.int64)
        return np.concatenate(parts), np.cumsum(sizes) - sizes

    smallest: list[dict[tuple[int, int], int]] = [{} for _ in texts]

    def note(numbers: list[int], starts: np.ndarray, start: int, length: int, period: int) -> None:
        """The same stretch is found for multiples of its smallest period, too."""
        which = int(np.searchsorted(starts, start, side="right")) - 1
        found, key = smallest[numbers[which]], (start - int(starts[which]), length)
        found[key] = min(period, found.get(key, period))

    kept = [i for i, text in enumerate(texts) if len(text) >= LEAST_WORDS]
    if kept:
        words, starts = laid(kept)
        for lag in range(1, SHORT):
            for run in by_lag(words, lag):
                note(kept, starts, *run)
        size, hashes = 1, _mixed(words.view(np.uint64), words.view(np.uint64))
        for low, high in _scales(max(len(texts[i]) for i in kept)):
            long = [i for i in kept if len(texts[i]) >= LEAST_TIMES * low]
            if 2 * sum(len(texts[i]) + 1 for i in long) < len(words):
                kept = long
                words, starts = laid(kept)
                size, hashes = 1, _mixed(words.view(np.uint64), words.view(np.uint64))
            gram = high - 1
            while 2 * size <= gram:
                hashes, size = _mixed(hashes[:-size], hashes[size:]), 2 * size
            rest = gram - size
            grams = _mixed(hashes[: len(hashes) - rest], hashes[rest:]) if rest else hashes
            places, periods = pairs_at_scale(grams, 2 * low - gram + 1, low, high)
            period_before, end_before = 0, 0
            for k in np.lexsort((places, periods)):
                place, period = int(places[k]), int(periods[k])
                if period == period_before and place < end_before:
                    continue  # in the stretch extended last
                start, end = _extended(words, place, period)
                period_before, end_before = period, end
                if end - start + period >= _least(period):
                    note(kept, starts, start, end - start + period, period)
    return [sorted((s, n, q) for (s, n), q in found.items()) for found in smallest]


def _in_order(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    return sorted(runs, key=lambda run: (run[0], run[2]))


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but for those that a run has after its first period."""
    if not runs:
        return b" ".join(words)
    covered = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        covered[start + period] += 1
        covered[start + length] -= 1
    return b" ".join([word for word, n in zip(words, np.cumsum(covered)) if not n])


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def chunk(ids: list, split: list[list[bytes]]) -> pa.RecordBatch:
        numbers: dict[bytes, int] = {}
        texts = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)) for words in split]
        runs = [_in_order(found) for found in runs_of(texts)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(words) for words in split], pa.int64()),
                pa.array([[dict(zip(("start", "length", "period"), run)) for run in found] for found in runs], pa.list_(RUN)),
                pa.array([_collapsed(words, found) for words, found in zip(split, runs)], pa.binary()).cast(pa.string()),
            ],
            names=["doc_id", "n_words", "runs", "collapsed"],
        )

    for batch in batches:
        ids, split, size = [], [], 0
        for number, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            words = text.as_py().encode().split() if text.is_valid else []
            if ids and size + len(words) > CHUNK:
                yield chunk(ids, split)
                ids, split, size = [], [], 0
            ids.append(number)
            split.append(words)
            size += len(words)
        if ids:
            yield chunk(ids, split)


def find_runs(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, its runs by start and period, and the words that are left without their repeats."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_found, FOUND)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the documents, by their ids, go on with a period from some word on."""
    hashed = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h")).withColumn(
        "words",
        F.when(F.col("h") % 10 == 0, F.expr(r"filter(split(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), w -> w <> '')")),
    )
    placed = hashed.select(
        "doc_id", "text", "words", F.size("words").alias("n"), F.floor(F.col("h") / 10).alias("g")
    ).withColumn("a", F.expr("IF(n > 0, g % n, 0)"))
    lengths = placed.withColumn("p", F.expr("1 + (n - a) DIV (3 + g % 8)"))
    planted = F.expr(
        "array_join(concat(slice(words, 1, int(a)),"
        " slice(flatten(array_repeat(slice(words, int(a) + 1, int(p)), int((n - a) DIV p + 1))), 1, int(n - a))), ' ')"
    )
    return lengths.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(with_planted_runs(read(spark, sf_dir, "documents")))
    best = F.expr(
        "aggregate(runs, CAST(NULL AS struct<start:bigint,length:bigint,period:bigint>),"
        " (best, r) -> IF(best IS NULL OR r.length * best.period > best.length * r.period, r, best))"
    )
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.select("doc_id", "runs", "collapsed", best.alias("best")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        hex_sha256(lines).alias("runs_sha256"),
        hex_sha256(F.col("collapsed")).alias("collapsed_sha256"),
    )

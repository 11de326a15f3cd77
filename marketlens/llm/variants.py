"""Spelling variants grouped by an index of variable-length grams.

Two words are near if they differ by one inserted, deleted or replaced character. Words are cut into grams of two to five
characters from a dictionary: all pairs of characters, and a longer gram only where the gram without its last character is
frequent. At each place the longest gram of the dictionary is taken, unless an earlier one reaches as far. Short words
take grams of at most three characters, words from 10 on four, from 13 on five: then some gram always outlives an edit.

For every word the largest number of grams that one edit can spoil is counted, place by place: those that hold the place, a
gram just before it that the dictionary could prolong, and those just behind it that a gram from before could swallow. A near
word shares all others, at the same place or one further. So of the word's grams, rarest first, one more than that number
must hold a shared one: only these lists are merged, the long lists of common grams stay untouched where a word has rarer ones.
A list is a gram at a place among words of one length (or of lengths that differ by one). An edit lies before the shared gram
or behind it, so what meets in a list must agree on all that is behind or all that is before; hashes of both parts travel along.
Then the edit distance decides. All that is tested inside the join, so only near words become rows. Nothing is capped: a
long list is a skewed join key that adaptive execution splits.

Nearness is followed to each word's form, its commonest near word if that is ten times as common, and to the root where
forms end. A form is ten times as common as its word, so chains are short; pointers are doubled until none moves.

Bounds. A dictionary has all pairs of characters that occur, and the children of grams that make more than one in
``EXTENDED`` of all gram places: at most ``EXTENDED`` grams of each length times the letters of the alphabet. That alone is
collected and sent to the workers; words, lists and links stay distributed.

Cases. A null or empty text has no words. A null doc_id counts as an empty one in the hash that plants misspellings. Rows
that repeat an id count each. Ties of a commonest near word go to the smallest in code-point order. Words without a near word
are their own root with n_near 0. Edit distances take time in the square of a word's length: a few letters as a rule,
some seconds for two words of 20,000. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.common import read, release, stage

LEAST_LENGTH = 7
LEAST_COUNT = 2
TIMES = 10
SHORTEST = 2
EXTENDED = 2000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

TYPES = {
    "word": pa.string(), "n": pa.int64(), "kind": pa.int32(), "length": pa.int32(),
    "gram": pa.string(), "place": pa.int32(), "before": pa.int32(), "behind": pa.int32(),
}
TOKENS = "word string, n long, kind int, length int, gram string, place int, before int, behind int"


def longest_gram(length: int) -> int:
    """Longest grams for words of this length, so that some gram outlives any edit."""
    return min(5, (length + 2) // 3)


class Grams:
    """The dictionary: how often a gram occurs, which grams can be prolonged, and what they end in."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.counts = counts
        self.prolonged = {gram[:-1] for gram in counts if len(gram) > SHORTEST}
        self.endings: dict[int, set[str]] = {}
        for most in range(SHORTEST, 6):
            self.endings[most] = {gram[i:] for gram in counts if len(gram) <= most for i in range(1, len(gram))}

    def cut(self, word: str, most: int) -> list[tuple[int, str]]:
        """Place and text of the word's grams, none of them inside another."""
        grams, reach = [], 0
        for at in range(len(word) - SHORTEST + 1):
            size = SHORTEST
            while size < most and at + size < len(word) and word[at : at + size + 1] in self.counts:
                size += 1
            if at + size > reach:
                reach = at + size
                grams.append((at, word[at:reach]))
        return grams

    def spoiled(self, word: str, grams: list[tuple[int, str]], most: int, inserted: bool) -> int:
        """The most grams that one edit spoils: a character inserted, or else deleted or replaced."""
        worst, first, endings = 0, 0, self.endings[most]
        for i in range(len(word) + inserted):
            after = i if inserted else i + 1  # first place behind the edit
            while first < len(grams) and grams[first][0] + len(grams[first][1]) < i:
                first += 1
            hit = 0
            for k in range(first, len(grams)):
                at, gram = grams[k]
                end = at + len(gram)
                if end >= after + most and at >= after:
                    break  # out of reach, as are all behind
                if end <= i:
                    hit += end == i and len(gram) < most and gram in self.prolonged
                elif at < after:
                    hit += 1
                else:
                    hit += word[after:end] in endings
            worst = max(worst, hit)
        return worst

    def rarest(self, word: str, most: int, inserted: bool) -> list[tuple[int, str]]:
        """Grams of which any word one such edit away shares at least one."""
        grams = self.cut(word, most)
        wanted = self.spoiled(word, grams, most, inserted) + 1
        if wanted > len(grams):
            raise ValueError(f"no gram of {word!r} outlives an edit; words need {LEAST_LENGTH} characters")
        return sorted(grams, key=lambda g: (self.counts.get(g[1], 0), g[1], g[0]))[:wanted]


def counted_words(docs: DataFrame) -> DataFrame:
    """Misspelt as the ids say, the words of at least seven characters that occur at least twice: word, n."""
    pattern = F.lit("[A-Za-z\\u00C0-\\u00FF]{%d,}" % LEAST_LENGTH)
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), pattern, F.lit(0))).alias("run"),
    )
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    misspelt = F.expr("concat(substr(run, 1, int(h % length(run))), substr(run, int(h % length(run)) + 2))")
    words = hashed.select(F.when(F.col("h") % 31 == 0, misspelt).otherwise(F.col("run")).alias("word"))
    counted = words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


def _counted_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter[str] = Counter()
        for word in batch.column("word").to_pylist():
            for size in range(SHORTEST, 6):
                counts.update(word[at : at + size] for at in range(len(word) - size + 1))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["gram", "n"])


def gram_dictionary(words: DataFrame, extended: int = EXTENDED) -> dict[str, int]:
    """Grams and how many words' places they have; longer ones only behind a frequent shorter one."""
    places = words.select("word").mapInArrow(_counted_grams, "gram string, n long")
    counts = stage(places.groupBy("gram").agg(F.sum("n").alias("n")), "gram-counts")
    total = counts.where(F.length("gram") == SHORTEST).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # At most ``extended`` grams of each length are above this, so their broadcast is bounded.
    frequent = counts.where((F.col("n") > total / extended) & (F.length("gram") < 5)).select(F.col("gram").alias("head"))
    children = counts.where(F.length("gram") > SHORTEST).join(
        F.broadcast(frequent), F.expr("substr(gram, 1, length(gram) - 1)") == F.col("head"), "left_semi"
    )
    rows = counts.where(F.length("gram") == SHORTEST).unionByName(children).collect()
    release(counts)
    return {row["gram"]: row["n"] for row in rows}


def _hash(text: str) -> int:
    return zlib.crc32(text.encode()) - 2**31


def _tokens(batches: Iterator[pa.RecordBatch], counts: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """Lists that a word stands in. Kind 0: words of one length; 1: the shorter, 2: the longer of two lengths."""
    grams = Grams(counts)
    for batch in batches:
        rows = []
        for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
            size = len(word)

            def put(kind: int, length: int, gram: str, at: int, place: int) -> None:
                rows.append((word, n, kind, length, gram, place, _hash(word[:at]), _hash(word[at + len(gram) :])))

            for at, gram in grams.rarest(word, longest_gram(size), False):
                put(0, size, gram, at, at)
            for at, gram in grams.rarest(word, longest_gram(size), True):
                put(1, size, gram, at, at)
            if size > LEAST_LENGTH:  # else no word is shorter
                for at, gram in grams.rarest(word, longest_gram(size - 1), False):
                    put(2, size - 1, gram, at, at)
                    if at:
                        put(2, size - 1, gram, at, at - 1)
        columns = list(zip(*rows)) if rows else [()] * len(TYPES)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES.values())], names=list(TYPES))


def near_pairs(words: DataFrame, extended: int = EXTENDED) -> DataFrame:
    """a, n_a, b, n_b: every two of the ``words`` (word, n) that one edit tells apart, once."""
    counts = gram_dictionary(words, extended)
    tokens = stage(words.select("word", "n").mapInArrow(partial(_tokens, counts=counts), TOKENS), "gram-lists")
    key = ["same", "length", "gram", "place"]

    def side(kind: int, name: str) -> DataFrame:
        described = [F.col(column).alias(f"{column}_{name}") for column in ("n", "before", "behind")]
        return tokens.where(F.col("kind").isin(0, kind)).select(
            F.col("word").alias(name), *described, (F.col("kind") == 0).alias("same"), "length", "gram", "place"
        )

    agree = (F.col("before_a") == F.col("before_b")) | (F.col("behind_a") == F.col("behind_b"))
    once = ~F.col("same") | (F.col("a") < F.col("b"))
    near = agree & once & (F.levenshtein(F.col("a"), F.col("b"), 1) == 1)
    return side(1, "a").join(side(2, "b"), key).where(near).select("a", "n_a", "b", "n_b").distinct()


def _best(words: DataFrame, pairs: DataFrame, times: int) -> DataFrame:
    """word, n, n_near, form, form_n."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    best = both.groupBy(F.col("a").alias("word")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), "b")).alias("best")
    )
    common = -F.col("best.less") >= F.col("n") * times
    return words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(common, F.col("best.b")).alias("form"), F.when(common, -F.col("best.less")).alias("form_n"),
    )


def roots(forms: DataFrame) -> DataFrame:
    """word and root of the words that have a form; pointers are doubled until none moves."""
    links = stage(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "forms")
    while True:
        ends = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = stage(links.join(ends, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forms")
        release(links)
        links = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            return links


def group_variants(words: DataFrame, times: int = TIMES, extended: int = EXTENDED) -> DataFrame:
    """word, form, root, n, n_near, form_n of ``words`` (word, n), which are distinct and have seven characters or more."""
    described = stage(_best(words, near_pairs(words, extended), times), "variants")
    return described.join(roots(described), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(stage(counted_words(read(spark, sf_dir, "documents")), "words"))

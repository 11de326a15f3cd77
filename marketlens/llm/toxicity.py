"""Toxicity: noisy-channel deobfuscation, then a linear score of the restored words.

A disguised word is a lattice: every sign may stand for itself, for letters it looks like, for any
letter (an asterisk) or for nothing (separators), and a run of one letter for one or two of it. Viterbi
decoding takes the path that is likeliest under the channel and a character trigram model, which
is counted over all documents. Runs of single letters are decoded as one word. Decoded is every token that
holds such signs and two different ones of them or of letters, and every word that mixes scripts; the plain
letters of a word stay as a second reading. Numbers are none: digits with signs of number or money around.

Features are the restored words and their beginnings, present or not. The classifier learns from at most
``LABELLED`` labelled documents, chosen by a hash of their id, never from held-out ones: the features
that tell the labels apart best are counted in Spark, ``FEATURES`` of them are kept, and a logistic
regression is fitted on them. Scoring is one pass over the documents.

Cases. A null text is empty and gets the score of a document without any feature. A null doc_id is not
held out. A label of null is no label; a document with several counts as toxic if one says so. Without
labels of both kinds the score is their smoothed share. Rows that repeat a doc_id are scored each
on its own. An empty table gives no rows. Other columns are not looked at. Decoding takes time in
proportion to the length of a token, about a millisecond for an asterisk.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.common import read, release, stage

LABELLED = 20_000
FEATURES = 512
SUPPORT = 5  # toxic documents that must have a feature
BEGINNINGS = (5, 7)  # letters
FOLDS = 5
FIT_ROWS = 1024  # made dense at once

# What a sign may stand for, besides itself where it is a letter.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "<": "c", "#": "h",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ı": "i", "ѕ": "s",
}
SEPARATORS = "-._~'`^=​­/\\"
ANY = "*"
ALPHABET = "abcdefghijklmnopqrstuvwxyzàáâäãåæçèéêëìíîïñòóôöõøœùúûüýÿß"
LETTER = {c: i + 2 for i, c in enumerate(ALPHABET)}  # 0: between words, 1: any other letter
SIZE = 64
EDGE = "\"'()[]{}<>.,;:!?…«»“”‘’%&#*$@|~^`_=+/\\-"
SPACED = re.compile(r"(?<!\w)[^\W_](?:[ ._\-*][^\W_]){2,}(?!\w)")
REPEATED = re.compile(r"([^\W\d_])\1\1")
TOKEN = re.compile(r"\S*")
TAIL = re.compile(r"([*#%&$@!?.+])\1+$")
NUMBER = re.compile(r"[\W_]*\d[\d.,:;/\-+()%$€£#*!?^=<>]*")

FLOOR = 0.05
COST_LOOK, COST_ANY, COST_DROP, COST_LOSE, COST_FOLD, COST_KEEP, COST_PAIR = -1.0, -2.0, -0.5, -9.0, -0.2, -6.0, -15.0


def _table() -> np.ndarray:
    table = np.zeros(65536, np.int64)
    for code in range(128, 65536):
        table[code] = chr(code).isalpha()
    for c, i in LETTER.items():
        table[ord(c)] = i
    return table


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, counts = _table(), np.zeros(SIZE**3, np.int64)
    for batch in batches:
        for text in batch.column("text"):
            if not text.is_valid:
                continue
            codes = table[np.frombuffer(text.as_py().lower().encode("utf-16-le", "surrogatepass"), np.uint16)]
            codes = np.concatenate([[0, 0], codes, [0]])
            grams = (codes[:-2] * SIZE + codes[1:-1]) * SIZE + codes[2:]
            counts += np.bincount(grams, minlength=SIZE**3)
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["gram", "n"])


def language_model(docs: DataFrame) -> np.ndarray:
    """Log probability of a letter after two, at most SIZE**3 values, from all documents."""
    rows = docs.select("text").mapInArrow(_count_trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SIZE**3)
    for row in rows:
        counts[row["gram"]] = row["n"]
    three = counts.reshape(SIZE, SIZE, SIZE)
    two = three.sum(axis=0)
    one = two.sum(axis=0) + 1.0
    p1 = one / one.sum()
    p2 = (two + 50 * p1) / (two.sum(axis=1, keepdims=True) + 50)
    p3 = (three + 20 * p2[None]) / (three.sum(axis=2, keepdims=True) + 20)
    # Rude words may be missing from a corpus: any letter keeps a share, so that the channel decides where the counts don't know.
    return np.log((1 - FLOOR) * p3 + FLOOR / SIZE).astype(np.float32)


def _longest(model: np.ndarray) -> int:
    """How many letters a run of asterisks can gain by.

    A letter costs at least COST_DROP - COST_ANY more than none, and letters after the run see others before
    them for two steps only, so that a run of more letters than this is never on the likeliest path.
    """
    return int(2 * float(model.max() - model.min()) / (COST_DROP - COST_ANY)) + 1


def _lattice(word: str, longest: int) -> list[list[tuple[str, float]]]:
    """For every run of a sign the strings it may stand for, with the channel's log probability.

    Of a run of asterisks no more than ``longest`` stand for letters.
    """
    slots: list[list[tuple[str, float]]] = []
    for run in re.finditer(r"(.)\1*", word, re.DOTALL):
        sign, n = run[1], len(run[0])
        letters = LOOKS.get(sign, "")
        if sign.isalpha() and not letters:
            if n == 1:
                slots.append([(sign, 0.0)])
            elif n == 2:
                slots.append([(sign * 2, 0.0), (sign, COST_KEEP)])
            else:
                slots.append([(sign, COST_FOLD), (sign * 2, COST_FOLD)])
        elif letters:
            if n > 2:  # stress
                slots.append([(c * k, COST_LOOK) for c in letters for k in (1, 2)] + [("", COST_LOSE)])
            elif n == 2:  # as two equal letters, seldom one
                slots.append([(c * k, COST_LOOK * 2 + (COST_PAIR if k == 1 else 0.0)) for c in letters for k in (1, 2)] + [("", 2 * COST_LOSE)])
            else:
                slots.append([(c, COST_LOOK) for c in letters] + [("", COST_LOSE)])
        elif sign == ANY:
            slots += [[(c, COST_ANY) for c in ALPHABET] + [("", COST_DROP)]] * min(n, longest)
        else:
            slots.append([("", COST_DROP)])
    return slots


def _decode_few(slots: list[list[tuple[str, float]]], model: np.ndarray) -> str:
    """Viterbi over the pairs of letters reached; a path is a chain of its strings."""
    paths: dict[tuple[int, int], tuple] = {(0, 0): (0.0, None)}
    for options in slots:
        best: dict[tuple[int, int], tuple] = {}
        for (a, b), (score, path) in paths.items():
            for letters, cost in options:
                total, x, y = score + cost, a, b
                for c in letters:
                    z = LETTER.get(c, 1)
                    total, x, y = total + float(model[x, y, z]), y, z
                if (x, y) not in best or total > best[x, y][0]:
                    best[x, y] = (total, (path, letters))
        paths = best
    path = max(((score + float(model[a, b, 0]), path) for (a, b), (score, path) in paths.items()), key=lambda p: p[0])[1]
    made = []
    while path is not None:
        path, letters = path
        made.append(letters)
    return "".join(reversed(made))


def _decode_any(slots: list[list[tuple[str, float]]], model: np.ndarray) -> str:
    """The same over all pairs of letters at once, for words with signs that may be any letter."""
    before, score = [], np.full((SIZE, SIZE), -np.inf, np.float32)
    score[0, 0] = 0
    for options in slots:
        old, score = score, np.full((SIZE, SIZE), -np.inf, np.float32)
        before.append(old)
        reached = (old[:, :, None] + model).max(axis=0) if len(options) > 8 else None
        for letters, cost in options:
            if not letters:
                np.maximum(score, old + np.float32(cost), out=score)
                continue
            first, last = LETTER.get(letters[0], 1), LETTER.get(letters[-1], 1)
            column = (reached[:, first] if reached is not None else (old + model[:, :, first]).max(axis=0)) + np.float32(cost)
            if len(letters) == 1:
                score[:, first] = np.maximum(score[:, first], column)
            else:
                score[first, last] = max(score[first, last], (column + model[:, first, last]).max())
    y, z = np.unravel_index(np.argmax(score + model[:, :, 0]), score.shape)
    made = []
    for options, old in zip(reversed(slots), reversed(before)):
        ways = []  # into (y, z): score, the pair before, letters
        for letters, cost in options:
            codes = [LETTER.get(c, 1) for c in letters]
            if not codes:
                ways.append((old[y, z] + cost, y, z, letters))
            elif codes == [z]:
                column = old[:, y] + model[:, y, z]
                ways.append((column.max() + cost, np.argmax(column), y, letters))
            elif codes == [y, z]:
                pairs = old + model[:, :, y] + model[:, y, z]
                a, b = np.unravel_index(np.argmax(pairs), pairs.shape)
                ways.append((pairs[a, b] + cost, a, b, letters))
        _, y, z, letters = max(ways, key=lambda way: way[0])
        made.append(letters)
    return "".join(reversed(made))


def decode(word: str, model: np.ndarray, longest: int | None = None) -> str:
    """The likeliest word behind a disguised one."""
    slots = _lattice(word, _longest(model) if longest is None else longest)
    return (_decode_any if ANY in word else _decode_few)(slots, model)


def _disguised(token: str) -> bool:
    """Whether a token may hold letters under other signs: it has two different ones and is no number."""
    signs = {c for c in token if c.isalpha() or c in LOOKS or c == ANY}
    return len(signs) > 1 and not token.isalpha() and not NUMBER.fullmatch(token)


def _mixed(word: str) -> bool:
    """Whether a word of letters has look-alikes of another script among plain ones."""
    return not word.isascii() and any(c in LOOKS for c in word) and any(c in LETTER for c in word)


def restored_words(text: str, restore) -> set[str]:
    """Distinct words of a text, disguised ones decoded."""
    text = text.lower()
    found = set()
    for token in set(text.split()):
        word = token.strip(EDGE)
        if word.isalpha():
            found.add(word)
            if _mixed(word):
                found.add(restore(word))
            if len(word) == len(token):
                continue
        # Signs at an end may be letters, too: "a$$", "1diot". Two equal ones are read with and without, more after a word are stress.
        body = token.strip("\"'()[]{}<>.,;:?…«»“”‘’")
        short = TAIL.sub("", body)
        for form in {word, short, body} if len(body) - len(short) <= 2 or not word.isalpha() else {word, short}:
            if form.isalpha():
                found.add(form)
            elif _disguised(form):
                found.add(restore(form))
    end = 0
    for match in REPEATED.finditer(text):
        if match.start() >= end:
            head = text[end : match.start()].rsplit(None, 1)[-1:] if not text[match.start() - 1 : match.start()].isspace() else []
            tail = TOKEN.match(text, match.start())
            found.add(restore(((head or [""])[0] + tail[0]).strip(EDGE)))
            end = tail.end()
    for match in SPACED.finditer(text):
        found.add(restore(re.sub(r"[ ._\-]", "", match[0])))
    return found


def features(words: set[str]) -> set[str]:
    made = {"=" + word for word in words}
    for n in BEGINNINGS:
        made.update(word[:n] for word in words if len(word) >= n)
    return made


def _restorer(model: np.ndarray):
    return lru_cache(maxsize=100_000)(partial(decode, model=model, longest=_longest(model)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _document_features(batches: Iterator[pa.RecordBatch], model: np.ndarray) -> Iterator[pa.RecordBatch]:
    restore = _restorer(model)
    for batch in batches:
        made = [sorted(features(restored_words(text.as_py() if text.is_valid else "", restore))) for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(made, pa.list_(pa.string()))], names=["toxic", "features"])


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [Counter(), Counter()]
        for toxic, made in zip(batch.column("toxic").to_pylist(), batch.column("features").to_pylist()):
            counts[toxic].update(made)
        every = sorted(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(every, pa.string()), *(pa.array([c[f] for f in every], pa.int64()) for c in counts)], names=["feature", "clean", "toxic"]
        )


class Scorer:
    def __init__(self, model: np.ndarray, bias: float, weights: dict[str, float]):
        self.model, self.bias, self.weights = model, bias, weights

    def score(self, text: str, restore) -> float:
        words, weights = restored_words(text, restore), self.weights
        found = {f for word in words for f in ("=" + word, *(word[:n] for n in BEGINNINGS if len(word) >= n)) if f in weights}
        # Sorted: sums must not depend on the order of a set.
        return float(1 / (1 + np.exp(-(self.bias + sum(weights[f] for f in sorted(found))))))


def _fit(rows: list[np.ndarray], labels: np.ndarray, width: int) -> tuple[float, np.ndarray]:
    """Logistic regression with a ridge, by Newton steps on present features.

    Rows are made dense ``FIT_ROWS`` at a time: the 20,000 of them at once took 126 MB of the driver.
    """
    w, ridge = np.zeros(width + 1), np.full(width + 1, 0.3)
    ridge[width] = 1e-6
    for _ in range(12):
        gradient, hessian = -ridge * w, np.diag(ridge)
        for start in range(0, len(rows), FIT_ROWS):
            part = rows[start : start + FIT_ROWS]
            x = np.zeros((len(part), width + 1))
            x[:, width] = 1
            x[np.repeat(np.arange(len(part)), [len(present) for present in part]), np.concatenate(part)] = 1
            p = 1 / (1 + np.exp(-(x @ w)))
            gradient += x.T @ (labels[start : start + FIT_ROWS] - p)
            hessian += (x * (p * (1 - p))[:, None]).T @ x
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return float(w[width]), w[:width]


def train(docs: DataFrame, labels: DataFrame) -> Scorer:
    model = language_model(docs)
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    sample = (
        known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    )
    # At most LABELLED rows of two numbers.
    labelled = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("toxic", "text")
    made = stage(labelled.mapInArrow(partial(_document_features, model=model), "toxic int, features array<string>"), "toxic-features")
    totals = {row["toxic"]: row["count"] for row in made.groupBy("toxic").count().collect()}
    clean, toxic = totals.get(0, 0), totals.get(1, 0)
    bias = float(np.log((toxic + 0.5) / (clean + 0.5)))
    if not clean or not toxic:
        return Scorer(model, bias, {})

    counts = made.mapInArrow(_count_features, "feature string, clean long, toxic long").groupBy("feature").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    )
    ratio = F.log((F.col("toxic") + 0.5) / (toxic - F.col("toxic") + 0.5)) - F.log((F.col("clean") + 0.5) / (clean - F.col("clean") + 0.5))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    kept = [
        row["feature"]
        for row in counts.where(F.col("toxic") >= SUPPORT)
        .withColumn("strength", ratio / error)
        .where("strength > 3")
        .orderBy(F.desc("strength"), "feature").limit(FEATURES).collect()
    ]
    number = F.create_map(*[F.lit(x) for i, f in enumerate(kept) for x in (f, i)]) if kept else None
    chosen = F.filter(F.transform("features", lambda f: F.try_element_at(number, f)), lambda i: i.isNotNull()) if kept else F.array().cast("array<int>")
    rows = made.select("toxic", chosen.alias("present")).collect()
    release(made)
    if not kept:
        return Scorer(model, bias, {})
    bias, weights = _fit([np.array(r["present"], np.int64) for r in rows], np.array([r["toxic"] for r in rows], np.float64), len(kept))
    return Scorer(model, bias, dict(zip(kept, weights.tolist())))


def _scores(batches: Iterator[pa.RecordBatch], scorer: Scorer) -> Iterator[pa.RecordBatch]:
    restore = _restorer(scorer.model)
    for batch in batches:
        found = [scorer.score(text.as_py() if text.is_valid else "", restore) for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """Per row: doc_id and score."""
    return docs.select("doc_id", "text").mapInArrow(partial(_scores, scorer=scorer), "doc_id long, score double")


def _keep_clean(batches: Iterator[pa.RecordBatch], scorer: Scorer) -> Iterator[pa.RecordBatch]:
    restore = _restorer(scorer.model)
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        yield batch.filter(pa.array([scorer.score(text.as_py() if text.is_valid else "", restore) < 0.5 for text in texts], pa.bool_()))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score under a half."""
    return docs.mapInArrow(partial(_keep_clean, scorer=train(docs, labels)), docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, train(docs, read(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )

"""Language identification by Bayesian evidence fusion.

For every page four kinds of evidence are added as logarithms:

- the text's likelihood under a character trigram model of each language, counted over all labelled
  documents, tempered by ``TEMPER`` since neighbouring trigrams aren't independent;
- the language the markup declares, by how often pages of a language declare it;
- the suffix of the address, likewise;
- a prior of the host, smoothed towards its domain's, and that towards the prior of all pages.

The last three are grouped sums of the pages' text-only posteriors, a page's own share taken out of its
host's and domain's, so that no page confirms itself. A hot host's sums are folded before the shuffle.

Cases. A null html, or one without text, has no text evidence. A page that declares nothing, or has a
null or malformed url, counts as declaring, or being at, the empty string. Documents without text or
language teach nothing; without any labelled document ``lang`` is null. Languages that tie are taken in
order. Pages that repeat an id are separate. Empty tables give no rows. Other columns are not looked at.
Markup that is never closed is read in time in proportion to its length. References to characters that can't be
give the replacement character.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.common import read, stage

TEMPER = 0.2
HOST_WEIGHT = DOMAIN_WEIGHT = 4.0  # pages that the level above counts for
SMOOTHING = 1.0
SIZE = 64
ALPHABET = "abcdefghijklmnopqrstuvwxyzàáâäãåæçèéêëìíîïñòóôöõøœùúûüýÿß"

HIDDEN = ("script", "style", "noscript", "template")
OPENED = re.compile(rf"<(?:{'|'.join(f'({name})' for name in HIDDEN)})\b|<!--", re.IGNORECASE)
CLOSED = [re.compile("-->"), *[re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in HIDDEN]]
TAG = re.compile(r"<[^>]*>")
ZEROS = re.compile(r"(?:(?<=&#)0+(?=[0-9])|(?<=&#[xX])0+(?=[0-9a-fA-F]))")
BEYOND = re.compile(r"&#(?:[1-9][0-9]{7,}|[xX][1-9a-fA-F][0-9a-fA-F]{6,});?")  # no character has such a number
LANGUAGE_OF = {  # value of the attribute, in a tag of that name
    "html": re.compile(r"""\blang(?=\s*=\s*["']?([A-Za-z]+))""", re.IGNORECASE),
    "meta": re.compile(r"""\bcontent(?=\s*=\s*["']?([A-Za-z]+))""", re.IGNORECASE),
}
STARTS = {name: re.compile(rf"<{name}\b", re.IGNORECASE) for name in LANGUAGE_OF}
CONTENT_LANGUAGE = re.compile("content-language", re.IGNORECASE)


def without_hidden(markup: str) -> str:
    """Comments and elements that aren't shown become a blank. One scan: an end that isn't found once is not looked for again."""
    kept, done, at, missing = [], 0, 0, set()
    while opened := OPENED.search(markup, at):
        at, kind = opened.end(), opened.lastindex or 0
        closed = None if kind in missing else CLOSED[kind].search(markup, at)
        if closed is None:
            missing.add(kind)
            continue
        kept.append(markup[done : opened.start()])
        done = at = closed.end()
    return " ".join([*kept, markup[done:]])


def visible_text(markup: str) -> str:
    shown = without_hidden(markup)
    end = shown.rfind(">") + 1  # no tag ends beyond
    text = TAG.sub(" ", shown[:end]) + shown[end:]
    return entities.unescape(BEYOND.sub("\ufffd", ZEROS.sub("", text)))


def _in_tags(markup: str, name: str) -> Iterator[tuple[int, int]]:
    """Where the attributes of the tags of a name begin and end, each sign looked at once."""
    at = 0
    while found := STARTS[name].search(markup, at):
        end = markup.find(">", found.end())
        at = len(markup) if end < 0 else end
        yield found.end(), at


def declared_language(markup: str) -> str:
    for start, end in _in_tags(markup, "html"):
        if found := LANGUAGE_OF["html"].search(markup, start, end):
            return found[1].lower()
    for start, end in _in_tags(markup, "meta"):
        # The value after the last mention of the language that has one after it.
        values = [(found.start(), found[1]) for found in LANGUAGE_OF["meta"].finditer(markup, start, end)]
        last = values[-1][0] if values else start
        named = [found.end() for found in CONTENT_LANGUAGE.finditer(markup, start, last)]
        if named:
            return next(value for at, value in values if at >= named[-1]).lower()
    return ""


def _classes() -> np.ndarray:
    """Class of a UTF-16 unit: 0 none, 1 other letters."""
    table = np.zeros(65536, np.int64)
    table[[c for c in range(128, 65536) if chr(c).isalpha()]] = 1
    for i, c in enumerate(ALPHABET):
        table[ord(c)] = i + 2
    return table


def _trigrams(text: str, classes: np.ndarray) -> np.ndarray:
    codes = classes[np.frombuffer(text.lower().encode("utf-16-le", "surrogatepass"), np.uint16)]
    codes = np.concatenate([[0], codes, [0]])
    codes = codes[np.concatenate([[True], (codes[1:] > 0) | (codes[:-1] > 0)])]  # one gap between words
    return (codes[:-2] * SIZE + codes[1:-1]) * SIZE + codes[2:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    classes, counts = _classes(), {}
    for batch in batches:
        for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist()):
            own = counts.setdefault(lang, np.zeros(SIZE**3, np.int64))
            own += np.bincount(_trigrams(text.as_py(), classes), minlength=SIZE**3)
    for lang, own in counts.items():
        seen = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen), pa.array(own[seen])], names=["lang", "gram", "n"])


def train(docs: DataFrame) -> dict[str, np.ndarray]:
    """Log probability of a letter after two, by language; at most SIZE**3 values each."""
    rows = (
        docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
        .mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()
    )
    models = {}
    for row in rows:
        models.setdefault(row["lang"], np.zeros(SIZE**3))[row["gram"]] = row["n"]
    for lang, counts in models.items():
        three = counts.reshape(SIZE, SIZE, SIZE)
        two = three.sum(axis=0)
        one = two.sum(axis=0) + 1
        p2 = (two + 20 * one / one.sum()) / (two.sum(axis=1, keepdims=True) + 20)
        models[lang] = np.log((three + 20 * p2[None]) / (three.sum(axis=2, keepdims=True) + 20)).ravel()
    return dict(sorted(models.items()))


def _evidence(batches: Iterator[pa.RecordBatch], models: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    classes, table = _classes(), np.stack(list(models.values()))
    for batch in batches:
        declared, logs = [], []
        for markup in batch.column("html"):
            text = markup.as_py() if markup.is_valid else ""
            declared.append(declared_language(text))
            shown = visible_text(text).strip()
            grams = _trigrams(shown, classes) if shown else np.zeros(0, np.int64)
            logs.append((TEMPER * table[:, grams].sum(axis=1)).tolist())
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(declared, pa.string()), pa.array(logs, pa.list_(pa.float64()))],
            names=["page_id", "url", "declared", "text_log"],
        )


def _normalised(logs: Column) -> Column:
    top = F.array_max(logs)
    weights = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return F.transform(weights, lambda x: x / total)


def identify(pages: DataFrame, models: dict[str, np.ndarray]) -> DataFrame:
    """Per page: page_id, lang, probability, and the evidence: text_lang, declared, suffix, host."""
    langs = list(models)
    if not langs:
        null = [F.lit(None).cast(kind).alias(name) for name, kind in (("lang", "string"), ("probability", "double"), ("text_lang", "string"), ("declared", "string"), ("suffix", "string"), ("host", "string"))]
        return pages.select("page_id", *null)
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?([^/?#:]*)", 1))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), "html").mapInArrow(
        partial(_evidence, models=models), "page_id long, url string, declared string, text_log array<double>"
    )
    marked = stage(
        rows.withColumn("host", host)
        .withColumn("domain", F.regexp_extract("host", r"([^.]*\.?[^.]*)$", 1))
        .withColumn("suffix", F.regexp_extract("host", r"([^.]*)$", 1))
        .withColumn("own", _normalised(F.col("text_log")))
        .drop("url"),
        "page-evidence",
    )
    shares = [F.sum(F.get("own", i)).alias(f"n{i}") for i in range(len(langs))]

    def sums(name: str, *keys: str) -> DataFrame:
        return marked.groupBy(*keys).agg(F.array(*[F.sum(F.get("own", i)) for i in range(len(langs))]).alias(name))

    total = marked.agg(*shares).first()
    prior = np.array([total[i] or 0.0 for i in range(len(langs))]) + SMOOTHING
    prior = F.array(*[F.lit(float(x)) for x in prior / prior.sum()])

    def summed(array: Column) -> Column:
        return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)

    def smoothed(counts: Column, above: Column, weight: float) -> Column:
        """Counts but for the page's own share, with the level above as ``weight`` pages."""
        others = F.zip_with(counts, "own", lambda n, x: F.greatest(n - x, F.lit(0.0)))
        return F.zip_with(others, above, lambda n, p: (n + weight * p) / (summed(others) + weight))

    def given(counts: Column, totals: str) -> Column:
        """Logarithm of a sign's probability under each language."""
        others = F.zip_with(counts, "own", lambda n, x: F.greatest(n - x, F.lit(0.0)))
        return F.zip_with(others, totals, lambda n, t: F.log((n + SMOOTHING) / (t + 2 * SMOOTHING)))

    totals = F.array(*[F.lit(float(total[i] or 0.0)) for i in range(len(langs))])
    joined = (
        marked.join(sums("by_host", "host"), "host")
        .join(sums("by_domain", "domain"), "domain")
        .join(sums("by_declared", "declared"), "declared")
        .join(sums("by_suffix", "suffix"), "suffix")
        .withColumn("totals", totals)
    )
    domain_prior = smoothed(F.col("by_domain"), prior, DOMAIN_WEIGHT)
    fused = (
        joined.withColumn("domain_prior", domain_prior)
        .withColumn("prior", smoothed(F.col("by_host"), F.col("domain_prior"), HOST_WEIGHT))
        .withColumn("declared_log", given(F.col("by_declared"), "totals"))
        .withColumn("suffix_log", given(F.col("by_suffix"), "totals"))
        .withColumn(
            "posterior",
            _normalised(F.transform("text_log", lambda x, i: x + F.log(F.get("prior", i)) + F.get("declared_log", i) + F.get("suffix_log", i))),
        )
    )
    names = F.array(*[F.lit(x) for x in langs])

    def best(array: str) -> Column:
        return F.get(names, F.array_position(array, F.array_max(array)).cast("int") - 1)

    return fused.select(
        "page_id", best("posterior").alias("lang"), F.array_max("posterior").alias("probability"),
        best("own").alias("text_lang"), "declared", "suffix", "host",
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "pages"), train(read(spark, sf_dir, "documents")))

"""Personal data by weak supervision: labelers vote on spans, their reliabilities are estimated, a classifier decides.

Base spans are what the four forms (e-mail address, IP address, payment card, phone number) match and their checks let
through; they always stay. Beside them, candidates are proposed in wider forms, such as an address written with "(at)", a card
number with dots or a phone number without a plus, and base matches that fail their check serve as counter-examples.

Five labelers vote for, against or not at all on each candidate: its form; the check of its digits or labels; a gazetteer of
ending domains, leading octets and prefixes that base spans of the whole corpus have; the words on either side, by how often
they stand next to base spans; and the signs at its borders. Gazetteer and context are counted in Spark over all candidates
into ``BUCKETS`` hash buckets, so they are small at any size. Votes are grouped into patterns, of which there are at most 3^5
a kind, and expectation-maximisation estimates from their counts how reliable each labeler is, and how likely each pattern is a true span.

These likelihoods are the soft targets of a logistic regression on the candidate's own features (check, borders, shape, key and
neighbouring words). It is fitted on at most ``FITTED`` candidates, those of the least hash. A candidate that
scores a half or more, and overlaps no base span nor an accepted one before it, is added.

All searches are linear in the text: addresses are grown from their sign, numbers from maximal runs.

Cases. A null or empty text has no spans. Rows are worked on each by itself, so rows that repeat an id or have none come back as
often as they came. Spans that start together are in the order of the kinds. A corpus without candidates adds nothing, and an
empty table gives no rows. Other columns than doc_id and text are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.common import hex_sha256, read, release, stage

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
BUCKETS = 1024
FITTED = 20_000
SUPPORT = 3  # base spans of the corpus that share a key, for the gazetteer to know it
SEEN = 5  # candidates beside a word, for it to tell anything
ROUNDS = 50

# The base forms, anchored so that a search never goes back over a long run.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9][0-9.]{6,}")
DIGITS = re.compile(r"[0-9]+")
CARDS = re.compile(r"[0-9](?:[ -]?[0-9]){11,}")
PHONES = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Wider forms.
AT = re.compile(r" ?(?:\(at\)|\[at\]|\{at\}) ?| at | ?@ ?", re.IGNORECASE)
DOT = r"(?: ?(?:\(dot\)|\[dot\]|\{dot\}) ?| dot |\.)"
WIDE_DOMAIN = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{DOT}[A-Za-z0-9-]{{1,63}}){{1,9}}", re.IGNORECASE)
WIDE_IP = re.compile(r"(?<![\w.])[0-9]{1,3}(?: ?(?:\[\.\]|\(\.\)|\(dot\)|\[dot\]) ?[0-9]{1,3}){3}(?![\w.])", re.IGNORECASE)
WIDE_CARD = re.compile(r"(?<!\w)[0-9]{4}(?:[ ._/-]{1,2}[0-9]{4}){2}[ ._/-]{1,2}[0-9]{3,7}(?!\w)")
WIDE_PHONE = re.compile(r"(?<![\w+.])(?:\(?[0-9]{1,4}\)?[ .-]{1,2}){2,5}[0-9]{2,4}(?!\w)")
BEFORE, AFTER = re.compile(r"(\w+)\W*$"), re.compile(r"\W*(\w+)")
REACH = 40  # characters to either side that may hold the neighbouring word

CANDIDATE = pa.struct(
    [("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("form", pa.int32()), ("check", pa.int32()),
     ("border", pa.int32()), ("shape", pa.int32()), ("key", pa.int32()), ("before", pa.int32()), ("after", pa.int32())]
)
CANDIDATES = (
    "doc_id long, found array<struct<kind:int,start:long,end:long,base:boolean,form:int,check:int,"
    "border:int,shape:int,key:int,before:int,after:int>>"
)
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
SPANS = "doc_id long, base array<struct<kind:string,start:long,end:long>>, spans array<struct<kind:string,start:long,end:long,score:double>>"
FEATURES = ("check", "border", "shape", "key", "before", "after")
LABELERS = ("form", "check", "known", "context", "border")


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _only_digits(text: str) -> str:
    return "".join(DIGITS.findall(text))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            floor = domain.end()
            yield start, floor
        at = text.find("@", at + 1)


def _addresses(text: str) -> Iterator[tuple[int, int, bool]]:
    for run in DOTTED.finditer(text):
        groups = [group.span() for group in DIGITS.finditer(text, run.start(), run.end())]
        i = 0
        while i + 3 < len(groups):
            four = groups[i : i + 4]
            if all(b[0] == a[1] + 1 for a, b in zip(four, four[1:])):
                yield four[0][0], four[3][1], all(_small(text[a:b]) for a, b in four)
                i += 4
            else:
                i += 1


def matches(text: str) -> list[tuple[int, int, int, bool]]:
    """Kind, start and end of what the base forms match, and whether the check lets it through."""
    found = [(EMAIL, start, end, True) for start, end in _emails(text)]
    if not DIGITS.search(text):
        return found
    found += [(IP, start, end, holds) for start, end, holds in _addresses(text)]
    for match in CARDS.finditer(text):
        digits = _only_digits(match.group())
        found.append((CARD, *match.span(), len(digits) <= 19 and luhn(digits)))
    for match in PHONES.finditer(text):
        found.append((PHONE, *match.span(), 9 <= len(_only_digits(match.group())) <= 15))
    return found


def wider(text: str) -> Iterator[tuple[int, int, int]]:
    """Kind, start and end of candidates in other forms."""
    for sign in AT.finditer(text):
        start = sign.start()
        while start > 0 and sign.start() - start < 64 and text[start - 1] in LOCAL:
            start -= 1
        domain = WIDE_DOMAIN.match(text, sign.end()) if start < sign.start() else None
        if domain:
            yield EMAIL, start, domain.end()
    if not DIGITS.search(text):
        return
    for kind, pattern in ((IP, WIDE_IP), (CARD, WIDE_CARD), (PHONE, WIDE_PHONE)):
        for match in pattern.finditer(text):
            if kind != PHONE or 9 <= len(_only_digits(match.group())) <= 15:
                yield kind, *match.span()


def _bucket(*parts: object) -> int:
    return zlib.crc32(":".join(map(str, parts)).encode("utf-8", "surrogatepass")) % BUCKETS


def _labels(span: str) -> list[str]:
    """Labels of an address's domain, however its signs are written."""
    return re.split(DOT, AT.split(span)[-1].lower(), flags=re.IGNORECASE)


def _check(kind: int, span: str) -> int:
    digits = _only_digits(span)
    if kind == EMAIL:
        last = _labels(span)[-1]
        return 1 if last.isalpha() and 2 <= len(last) <= 24 else -1
    if kind == IP:
        return 1 if all(_small(part) for part in DIGITS.findall(span)) else -1
    if kind == CARD:
        return 1 if 12 <= len(digits) <= 19 and luhn(digits) else -1
    return 1 if 9 <= len(digits) <= 15 and len(set(digits)) > 1 else -1


def _key(kind: int, span: str) -> int:
    """What the gazetteer knows a span by."""
    if kind == EMAIL:
        return _bucket(kind, ".".join(_labels(span)[-2:]))
    digits = DIGITS.findall(span)
    return _bucket(kind, int(digits[0][-9:]) if kind == IP else (len("".join(digits)), "".join(digits)[:1]))


def described(text: str) -> list[dict]:
    """Base spans, failed base matches and wider candidates, with their features."""
    base = matches(text)
    taken = {(kind, start) for kind, start, _, _ in base} | {(kind, end) for kind, _, end, _ in base}
    spans = [(kind, start, end, holds, 1 if holds else -1) for kind, start, end, holds in base]
    spans += [(*span, False, 0) for span in wider(text) if not {(span[0], span[1]), (span[0], span[2])} & taken]
    found = []
    for kind, start, end, holds, form in sorted(spans, key=lambda s: (s[1], s[0], s[2])):
        span = text[start:end]
        left, right = text[max(0, start - REACH) : start], text[end : end + REACH]
        glued = (left[-1:].isalnum() or left[-1:] == "_") or (right[:1].isalnum() or right[:1] == "_")
        before, after = BEFORE.search(left), AFTER.match(right)
        shape = re.sub(r"[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", span[:200]))
        found.append(
            {
                "kind": kind, "start": start, "end": end, "base": holds, "form": form, "check": _check(kind, span),
                "border": -1 if glued else 1, "shape": _bucket("shape", shape), "key": _key(kind, span),
                "before": _bucket("word", before.group(1).lower() if before else ""),
                "after": _bucket("word", after.group(1).lower() if after else ""),
            }
        )
    return found


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [described(text.as_py()) if text.is_valid else [] for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(CANDIDATE))], names=["doc_id", "found"])


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and ``found``, its candidates with their features; one row for each of ``docs``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_candidates, CANDIDATES)


def votes(found: DataFrame) -> DataFrame:
    """A row for each candidate: its features and what each labeler says, 1, 0 or -1."""
    rows = found.select("doc_id", F.inline("found"))
    # At most a row for each kind and bucket, whatever the corpus.
    known = rows.where("base").groupBy("kind", "key").agg((F.count("*") >= SUPPORT).cast("int").alias("known"))
    totals = rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.col("base").cast("long")).alias("good"))

    def beside(side: str) -> DataFrame:
        """How much likelier a candidate is a base span with that word beside it, in logarithms."""
        seen = rows.groupBy("kind", side).agg(F.count("*").alias("m"), F.sum(F.col("base").cast("long")).alias("g")).where(F.col("m") >= SEEN)
        odds = F.log((F.col("g") + 0.5) / (F.col("m") - F.col("g") + 0.5)) - F.log((F.col("good") + 0.5) / (F.col("n") - F.col("good") + 0.5))
        return seen.join(F.broadcast(totals), "kind").select("kind", side, odds.alias(f"odds_{side}"))

    joined = rows.join(F.broadcast(known), ["kind", "key"], "left")
    for side in ("before", "after"):
        joined = joined.join(F.broadcast(beside(side)), ["kind", side], "left")
    odds = F.coalesce("odds_before", F.lit(0.0)) + F.coalesce("odds_after", F.lit(0.0))
    context = F.when(odds > 1, 1).when(odds < -1, -1).otherwise(0)
    return joined.select(
        "doc_id", "kind", "start", "end", "base", *FEATURES, "form", F.coalesce("known", F.lit(0)).alias("known"), context.alias("context")
    )


def reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over patterns of votes, a row each.

    Gives how likely each pattern is a true span, and the probability of each labeler's three votes (-1, 0, 1) for
    false and true spans: labelers x 2 x 3. Starts from the majority; one imagined vote of each kind keeps all above zero.
    """
    cells = patterns + 1
    true = 1 / (1 + np.exp(-patterns.sum(axis=1).astype(float)))
    for _ in range(rounds):
        weights = np.stack([counts * (1 - true), counts * true])
        share = (weights.sum(axis=1) + 1) / (counts.sum() + 2)
        tables = np.array([[np.bincount(cells[:, j], w, 3) + 1 for w in weights] for j in range(patterns.shape[1])])
        tables /= tables.sum(axis=2, keepdims=True)
        logs = np.log(share)[:, None] + sum(np.log(tables[j][:, cells[:, j]]) for j in range(patterns.shape[1]))
        true = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
    return true, tables


def _places(rows: list[np.ndarray]) -> np.ndarray:
    """Indices of the features of candidates that are set, one for each of them and one for the kind."""
    kind, *features = rows
    columns = [kind]
    for i, values in enumerate(features):
        columns.append(4 + (i * 4 + kind) * BUCKETS + (values + 1 if i < 2 else values))
    return np.stack(columns, axis=1)


def fitted(places: np.ndarray, targets: np.ndarray, rounds: int = 300, penalty: float = 0.5) -> np.ndarray:
    """Weights of a logistic regression on indicator features with soft targets."""
    size = 4 + len(FEATURES) * 4 * BUCKETS
    weights = np.zeros(size)
    # A bound on the curvature along each weight, so that every step goes down.
    steps = 0.25 * places.shape[1] * np.bincount(places.ravel(), minlength=size) + penalty
    for _ in range(rounds):
        errors = 1 / (1 + np.exp(-weights[places].sum(axis=1))) - targets
        slope = np.bincount(places.ravel(), np.repeat(errors, places.shape[1]), size) + penalty * weights
        weights -= slope / steps
    return weights


def train(found: DataFrame) -> np.ndarray | None:
    """Weights of the span classifier, or None where there are no candidates."""
    voted = stage(votes(found), "votes")
    grouped = voted.groupBy("kind", *LABELERS).agg(F.count("*").alias("n")).orderBy("kind", *LABELERS).collect()
    likely: dict[tuple, float] = {}
    for kind in range(len(KINDS)):
        rows = [row for row in grouped if row["kind"] == kind]
        if rows:
            patterns = np.array([[row[name] for name in LABELERS] for row in rows])
            true, _ = reliabilities(patterns, np.array([row["n"] for row in rows], float))
            likely |= {(kind, *pattern): value for pattern, value in zip(patterns.tolist(), true.tolist())}
    columns = ["kind", *FEATURES, "form", "known", "context"]
    order = [F.xxhash64("doc_id", "kind", "start", "end"), *columns]
    sample = voted.orderBy(*order).limit(FITTED).select(*columns).collect()
    release(voted)
    if not sample:
        return None
    targets = np.array([likely[(row["kind"], *(row[name] for name in LABELERS))] for row in sample])
    return fitted(_places([np.array([row[name] for row in sample]) for name in ("kind", *FEATURES)]), targets)


def accepted(found: list[dict], scores: np.ndarray) -> list[tuple[str, int, int, float]]:
    """Base spans and, from left to right, candidates of a half or more that meet none before."""
    base = [(c["start"], c["end"]) for c in found if c["base"]]
    out, reach, at = [], -1, 0
    furthest = np.maximum.accumulate([end for _, end in base]) if base else []
    starts = [start for start, _ in base]
    for candidate, score in zip(found, scores.tolist()):
        start, end = candidate["start"], candidate["end"]
        if not candidate["base"]:
            at = int(np.searchsorted(starts, end))  # base spans that start ahead of its end
            if score < 0.5 or start < reach or (at and furthest[at - 1] > start):
                continue
            reach = end
        out.append((KINDS[candidate["kind"]], start, end, score))
    return out


def _decided(batches: Iterator[pa.RecordBatch], weights: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, spans = [], []
        for found in batch.column("found").to_pylist():
            scores = np.zeros(len(found))
            if found and weights is not None:
                places = _places([np.array([c[name] for c in found]) for name in ("kind", *FEATURES)])
                scores = 1 / (1 + np.exp(-weights[places].sum(axis=1)))
            base.append([{"kind": KINDS[c["kind"]], "start": c["start"], "end": c["end"]} for c in found if c["base"]])
            spans.append([dict(zip(("kind", "start", "end", "score"), span)) for span in accepted(found, scores)])
        place = pa.struct([SPAN.field(name) for name in ("kind", "start", "end")])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(base, pa.list_(place)), pa.array(spans, pa.list_(SPAN))], names=["doc_id", "base", "spans"]
        )


def find_personal(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, its base spans, and all spans with the classifier's score; code points, end exclusive."""
    found = stage(candidates(docs), "personal-candidates")
    return found.mapInArrow(partial(_decided, weights=train(found)), SPANS)


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(read(spark, sf_dir, "documents"))

    def joined(spans: str) -> str:
        return f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"

    counts = [F.expr(f"bigint(size(filter(base, s -> s.kind = '{kind}')))").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, hex_sha256(F.expr(joined("base"))).alias("base_sha256"), F.expr(joined("spans")).alias("spans"))

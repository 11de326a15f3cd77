"""Personal data against the plain patterns, reliabilities on made votes, spans in other forms."""

from __future__ import annotations

import hashlib
import os
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.llm import personal
from marketlens.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def luhn_by_loop(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        d = int(c) * (2 if i % 2 else 1)
        total += d // 10 + d % 10
    return total % 10 == 0


def base_by_patterns(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(part) <= 255 for part in m.group().split(".")):
            found.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and luhn_by_loop(digits):
            found.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append((m.start(), 3, "phone", m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def base_of(text):
    return [(personal.KINDS[c["kind"]], c["start"], c["end"]) for c in personal.described(text) if c["base"]]


def test_base_spans_of_random_texts():
    rng = random.Random(3)
    pieces = ["a.b", "@", ".", "..", "@c.d", "x-1", "+", "+1", " ", "-", "12", "255", "256", "1.2.3.4", "0004", "(3)", "4111111111111111",
              "4111 1111-1111 1111", "+1 (310) 555-4510", "é", "\n", "%", "4", "00", "1.2", "a@b.c@d.e"]
    for _ in range(4000):
        text = "".join(rng.choices(pieces, k=rng.randint(1, 14)))
        assert base_of(text) == base_by_patterns(text), text


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_query_against_patterns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {row["doc_id"]: row for row in QUERIES["op12_personal_data"](spark, SF).collect()}
    assert len(got) == len(docs)
    for doc in docs:
        want, row = base_by_patterns(doc["text"] or ""), got[doc["doc_id"]]
        said = ",".join(f"{kind}:{start}:{end}" for kind, start, end in want)
        assert row["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [row[f"n_{kind}"] for kind in personal.KINDS] == [sum(w[0] == kind for w in want) for kind in personal.KINDS]
        spans = row["spans"].split(",") if row["spans"] else []
        assert {f"{kind}:{start}:{end}" for kind, start, end in want} <= set(spans)
        order = [(int(s.split(":")[1]), personal.KINDS.index(s.split(":")[0])) for s in spans]
        assert order == sorted(order)


def test_reliabilities_of_made_votes():
    """Labelers of known accuracy, of which one is noise."""
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.4
    right = [0.9, 0.8, 0.75, 0.5]
    said = np.stack([np.where(rng.random(len(truth)) < p, truth, ~truth) * 2 - 1 for p in right], axis=1)
    said[rng.random(said.shape) < 0.2] = 0
    patterns, inverse, counts = np.unique(said, axis=0, return_inverse=True, return_counts=True)
    true, tables = personal.reliabilities(patterns, counts.astype(float))
    for j, p in enumerate(right):
        assert abs(tables[j, 1, 2] / (1 - tables[j, 1, 1]) - p) < 0.03
        assert abs(tables[j, 0, 0] / (1 - tables[j, 0, 1]) - p) < 0.03
    likely = true[inverse.ravel()]
    majority = said.sum(axis=1) > 0
    assert ((likely >= 0.5) == truth).mean() >= (majority == truth).mean()
    assert abs(likely[likely > 0.9].mean() - truth[likely > 0.9].mean()) < 0.03  # a probability, not just an order


def card(rng):
    body = "4" + "".join(rng.choices("0123456789", k=14))
    return next(body + c for c in "0123456789" if luhn_by_loop(body + c))


def test_other_forms_are_added_and_numbers_left_alone(spark):
    rng = random.Random(1)
    rows, private, clean = [], {}, []
    for i in range(600):
        words = " ".join(rng.choices("alpha beta gamma delta epsilon zeta eta theta".split(), k=12))
        number, name = card(rng), f"user.{rng.randint(1, 99)}"
        ip = [str(rng.randint(1, 255)) for _ in range(4)]
        phone = f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
        plain = [f"{name}@mail.example.com", ".".join(ip), number, "+1 " + phone]
        other = [f"{name} (at) mail [dot] example [dot] com", "[.]".join(ip), ".".join(number[j : j + 4] for j in range(0, 16, 4)), None]
        wrong = ["300.1.2.3", f"{number[:-1]}{(int(number[-1]) + 1) % 10}", "meet at noon", "look at page 4.2", "1999 2004", "3.14159"]
        kind = i % 4
        if i % 6 == 0 and other[kind]:
            text, private[i] = f"{words} {other[kind]} {words}", (len(words) + 1, len(words) + 1 + len(other[kind]))
        elif i % 6 == 1:
            text = f"{words} {rng.choice(wrong)} {words}"
            clean.append(i)
        else:
            text = f"{words} {plain[kind]} {words}"
        rows.append((i, text))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {row["doc_id"]: row for row in personal.find_personal(docs).collect()}
    caught = [any((s["start"], s["end"]) == span for s in found[i]["spans"]) for i, span in private.items()]
    assert all(found[i]["base"] == [] for i in private) and sum(caught) >= 0.9 * len(caught)
    assert all(found[i]["spans"] == [] for i in clean)
    again = {row["doc_id"]: row for row in personal.find_personal(docs.repartition(7)).collect()}
    assert again == found


def test_hard_rows(spark, hard_docs):
    rows = personal.find_personal(hard_docs).collect()
    assert len(rows) == hard_docs.count() and all(row["base"] == [] for row in rows)
    assert personal.find_personal(hard_docs.where(F.lit(False))).count() == 0
    odd = [(None, None), (None, ""), (1, "a@b.cd"), (1, "x a@b.cd"), (None, "é a@b.cd 1.2.3.4"), (2, "1.2.3.4@x.yz")]
    docs = spark.createDataFrame(odd, "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, [tuple(s) for s in r["base"]]) for r in personal.find_personal(docs).collect()))
    assert got == [
        (0, []), (0, []), (0, [("email", 2, 8), ("ip", 9, 16)]), (1, [("email", 0, 6)]), (1, [("email", 2, 8)]),
        (2, [("email", 0, 12), ("ip", 0, 7)]),
    ]


@pytest.mark.parametrize("piece", ["1", "1.", "a", "@", "a@", "+1", "+1 ", "1 ", "1-", "(1) ", " at ", "a.", "1111 ", "a at b.", "(at)"])
def test_time_grows_with_the_text(piece):
    text = piece * (400_000 // len(piece))
    start = time.perf_counter()
    personal.described(text)
    assert time.perf_counter() - start < 20

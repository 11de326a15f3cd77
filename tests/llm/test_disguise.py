"""Disguised words are restored from whole texts; decoding is exact and takes time in proportion to the token."""

from __future__ import annotations

import random
import time
from itertools import product

import pytest

from marketlens.llm import toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.language_model(spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet"))


@pytest.mark.parametrize(
    "text, word",
    [
        ("1d107", "idiot"), ("such an 1d10t, he is", "idiot"), ("5h17", "shit"), ("(p155)", "piss"), ("@$$", "ass"), ("a$$", "ass"), ("1diot!!", "idiot"),
        ("@$$h0le", "asshole"), ("іdiot", "idiot"), ("mоron", "moron"), ("m*ron", "moron"), ("l0s3r$", "loser"), ("i d i o t", "idiot"),
    ],
)
def test_disguises(model, text, word):
    assert word in toxicity.restored_words(text, toxicity._restorer(model))


@pytest.mark.parametrize("text", ["455", "2019-05-03 12:30", "$1,000.50", "50%", "#1", "(2)", "!!!", "***", "$$$", "€ 5"])
def test_numbers_and_signs_are_no_words(model, text):
    assert toxicity.restored_words(text, toxicity._restorer(model)) == set()


def test_words_of_another_script_stay(model):
    assert toxicity.restored_words("оса 雨 größe", toxicity._restorer(model)) == {"оса", "雨", "größe"}


def test_both_decoders_find_the_best_of_all_paths(model):
    rnd = random.Random(5)
    longest = toxicity._longest(model)
    for _ in range(60):
        slots = toxicity._lattice("".join(rnd.choice("abelst10$@-") for _ in range(rnd.randint(1, 6))), longest)

        def score(path):
            total, x, y = sum(cost for _, cost in path), 0, 0
            for c in "".join(letters for letters, _ in path):
                z = toxicity.LETTER.get(c, 1)
                total, x, y = total + float(model[x, y, z]), y, z
            return total + float(model[x, y, 0])

        best = max(map(score, product(*slots)))
        for decoder in (toxicity._decode_few, toxicity._decode_any):
            found = decoder(slots, model)
            same = [score(path) for path in product(*slots) if "".join(letters for letters, _ in path) == found]
            assert max(same) == pytest.approx(best, abs=1e-3)


def test_a_run_of_asterisks_has_no_cap_on_the_likeliest_path(model):
    for n in (2, 12, 30):
        assert toxicity.decode("a" + "*" * n + "t", model) == toxicity.decode("a" + "*" * n + "t", model, longest=n)


def test_time_of_long_tokens(model):
    for token, limit in (("a" + "*" * 50 + "b", 0.5), ("i" + "*d*i*o*t" * 12, 0.5), ("ab1" * 20_000, 5), ("$@" * 20_000, 10)):
        before = time.perf_counter()
        toxicity.decode(token, model)
        assert time.perf_counter() - before < limit



def test_disguised_toxic_rows_are_caught(spark):
    """Toxic held-out rows whose telling words are disguised score as the plain ones do."""
    folder = SF.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    scorer = toxicity.train(docs, labels)
    restore = toxicity._restorer(scorer.model)
    rows = docs.where(toxicity.held_out(docs["doc_id"])).join(labels.where("toxic = 1"), "doc_id").select("text").collect()
    telling = {f[1:] for f in scorer.weights if f.startswith("=")}
    hide = str.maketrans("aeios", "@310$")
    caught = total = 0
    for (text,) in rows:
        if scorer.score(text, restore) >= 0.5:
            hidden = " ".join(w.translate(hide) if w.lower().strip(toxicity.EDGE) in telling else w for w in text.split())
            total += 1
            caught += scorer.score(hidden, restore) >= 0.5
    assert total and caught >= 0.9 * total

"""Spelling variants against edits of every word."""

from __future__ import annotations

import random

import pytest

from marketlens.llm import variants


def edits(word, letters):
    for i in range(len(word) + 1):
        yield from (word[:i] + c + word[i:] for c in letters)
        if i < len(word):
            yield word[:i] + word[i + 1 :]
            yield from (word[:i] + c + word[i + 1 :] for c in letters)


def vocabulary(seed, size, letters="abeé"):
    rng = random.Random(seed)
    words = {"".join(rng.choices(letters, k=rng.randint(7, 16))) for _ in range(size)}
    for word in sorted(words)[: size // 2]:
        words |= {w for w in rng.sample(sorted(set(edits(word, letters))), 3) if len(w) >= 7}
    return {word: rng.choice([2, 3, 30, 31, 400, 5000]) for word in sorted(words)}


def dictionary(words, extended):
    """Counts of all grams, then those that the definition keeps."""
    counts = {}
    for word in words:
        for size in range(2, 6):
            for at in range(len(word) - size + 1):
                counts[word[at : at + size]] = counts.get(word[at : at + size], 0) + 1
    least = sum(n for gram, n in counts.items() if len(gram) == 2) / extended
    return {gram: n for gram, n in counts.items() if len(gram) == 2 or counts[gram[:-1]] > least}


@pytest.mark.parametrize("extended", [5, 60, 2000])
def test_an_edit_leaves_a_shared_gram_among_the_rarest(extended):
    """For any word and any edit, also to words that the dictionary has not seen."""
    words = vocabulary(extended, 150)
    grams = variants.Grams(dictionary(words, extended))
    for word in words:
        size = len(word)
        same = {(g, at) for at, g in grams.rarest(word, variants.longest_gram(size), False)}
        shorter = {(g, at) for at, g in grams.rarest(word, variants.longest_gram(size), True)}
        for other in set(edits(word, "abeéz")) - {word}:
            if len(other) == size:
                theirs = {(g, at) for at, g in grams.rarest(other, variants.longest_gram(size), False)}
                assert same & theirs, (word, other)
            elif len(other) > size:
                theirs = {(g, at - back) for at, g in grams.rarest(other, variants.longest_gram(size), False) for back in (0, 1)}
                assert shorter & theirs, (word, other)


def grouped_by_loop(words, times=10):
    near = {word: {w for w in set(edits(word, set("".join(words)))) if w in words and w != word} for word in words}
    form = {}
    for word, n in words.items():
        best = min(near[word], key=lambda w: (-words[w], w), default=None)
        form[word] = best if best and words[best] >= times * n else None
    root = {}
    for word in words:
        at = word
        while form[at]:
            at = form[at]
        root[word] = at
    return {w: (form[w], root[w], n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


@pytest.mark.parametrize("extended", [20, 2000])
def test_groups(spark, extended):
    words = vocabulary(3, 300)
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    rows = variants.group_variants(table, extended=extended).collect()
    want = grouped_by_loop(words)
    assert len(rows) == len(words)
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows} == want
    assert any(v[0] and v[1] != v[0] for v in want.values())  # chains of forms are followed


def test_dictionary(spark):
    words = vocabulary(5, 200)
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    assert variants.gram_dictionary(table, 40) == dictionary(words, 40)


def test_hard_rows(spark, hard_docs):
    assert variants.group_variants(variants.counted_words(hard_docs.limit(0))).count() == 0
    words = {row["word"]: row["n"] for row in variants.counted_words(hard_docs).collect()}
    assert words["ünïcödé"] > 30 and words["passage"] >= 3  # rows that repeat an id count each
    assert all(len(word) >= 7 and n >= 2 for word, n in words.items())
    rows = {row["word"]: row for row in variants.group_variants(variants.counted_words(hard_docs)).collect()}
    assert set(rows) == set(words)
    with pytest.raises(ValueError, match="outlives"):
        variants.Grams({"ab": 1, "bc": 1}).rarest("abc", 2, False)


def test_words_and_misspellings(spark):
    import zlib

    texts = [(i, "Aéroplane; aÉroplanes xylophone7xylophones ÀÉÎÕÜÿþ ab") for i in range(300)] + [(None, "nameless1 nameless1")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = {}
    for i, text in texts:
        for run in ["aéroplane", "aÉroplanes", "xylophone", "xylophones", "ÀÉÎÕÜÿþ"] if i is not None else ["nameless"] * 2:
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
            if len(word) >= 7:
                want[word] = want.get(word, 0) + 1
    got = {row["word"]: row["n"] for row in variants.counted_words(docs).collect()}
    assert got == {word: n for word, n in want.items() if n >= 2}


def test_a_word_of_any_length(spark):
    rng = random.Random(1)
    long = "".join(rng.choices("abcdefgh", k=4_000))
    words = {long: 30, long[:1_999] + long[2_000:]: 2, long[:-1]: 2, long + "a": 3, long[:100] + "ab" + long[100:]: 2}
    rows = variants.group_variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    found = {row["word"]: (row["n_near"], row["form"] == long) for row in rows}
    assert found[long] == (3, False) and sum(form for _, form in found.values()) == 3
    assert found[long[:100] + "ab" + long[100:]] == (0, False)

"""The scan of a page's markup against plain regular expressions, and its time on markup that is never closed."""

from __future__ import annotations

import html
import random
import re
import time

import pytest

from marketlens.llm import langid

HIDDEN = re.compile(r"<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->", re.DOTALL | re.IGNORECASE)
DECLARED = re.compile(r"""<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]+)""", re.IGNORECASE)
META = re.compile(r"""<meta\b[^>]*content-language[^>]*?\bcontent\s*=\s*["']?([A-Za-z]+)""", re.IGNORECASE)
PIECES = [
    "<script ", "<script>", "</script>", "</SCRIPT >", "<style", "</style>", "<!--", "-->", "<", ">", "<html ", " lang=en", " lang = 'fr'", "<meta ",
    "content-language", " content=de", " content = content='x'", "xlang=q", "abc", " ", "</", "&amp;", "&#65;", "&#0066", "&#x0f9;", "=", "content", "<b>", "\n", "-",
]


def test_scan_against_regular_expressions():
    rnd = random.Random(3)
    for _ in range(20_000):
        markup = "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 14)))
        assert langid.visible_text(markup) == html.unescape(re.sub(r"<[^>]*>", " ", HIDDEN.sub(" ", markup)))
        found = DECLARED.search(markup) or META.search(markup)
        assert langid.declared_language(markup) == (found[1].lower() if found else "")


@pytest.mark.parametrize("piece", ["<!--", "<script ", "<html ", "<meta ", "<", "<meta content-language ", "</script ", "<html lang ", "&#"])
def test_a_megabyte_never_closed(piece):
    markup = piece * (1_000_000 // len(piece))
    before = time.perf_counter()
    langid.visible_text(markup), langid.declared_language(markup)
    assert time.perf_counter() - before < 5


def test_references_of_many_digits():
    assert langid.visible_text(f"&#{'9' * 6000}; &#{'0' * 6000}65; &#x{'f' * 6000};") == "� A �"

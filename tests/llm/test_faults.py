"""Inputs that once crashed an operator, lost text, or emptied a page."""

from __future__ import annotations

import numpy as np
import pytest

from variantlab.llm import pages, pii, substrings

DOCS = "doc_id long, text string"


# personal data


def test_parts_of_an_address_may_be_of_any_length():
    assert pii.base_spans("x 1" + "0" * 5000 + ".1.1.1 y") == []
    zeros = "0" * 6000
    assert pii.base_spans(f"{zeros}9.1.1.{zeros}1") == [(1, 0, 2 * 6001 + 5)]
    assert not pii.well_formed("ip", "1000000001 . 2 . 3 . 4")
    assert not pii.well_formed("ip", "256.2.3.4") and pii.well_formed("ip", "0255 . 2 . 3 . 004")


def test_long_numbers_everywhere(spark):
    rows = [(1, "x 1" + "0" * 5000 + ".1.1.1 y"), (2, "+" + "1" * 5000 + " 4"), (3, "4" * 6000), (4, "ip 10.0.0.1 and a@b.co")]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1].n_ip == 0 and got[4].n_ip == 1 and got[4].n_email == 1 and got[3].n_card == 0


# repeated passages


@pytest.mark.parametrize("lines", [1000, (1 << 20) + 50_000])
def test_spans_of_any_number_of_sentences(spark, lines):
    """Of a text that repeats one line, the first run stays and all other lines go."""
    text = "spam.\n" * lines
    got = substrings.removed_passages(spark.createDataFrame([(1, text), (2, "other words stand here.")], DOCS)).collect()
    left = {r.doc_id: r for r in got}
    assert left[1].s_removed == lines - left[1].text.count("spam") and left[1].text.count("spam") < 60
    assert left[2].s_removed == 0


def test_cut_beyond_a_million_sentences():
    n = (1 << 20) + 7
    text, gone = substrings.cut("a.\n" * n, [np.int64(5) << 32 | (n - 5)])
    assert gone == n - 5 and text == "a.\na.\na.\na.\na."


# main text


def text_of(source):
    return pages.main_text(pages.parse(source), set())


LONG = "A paragraph of the article with a good number of words in it, so that it is most of the page."


@pytest.mark.parametrize(
    "page",
    [
        '<div class="layout has-sidebar"><article><p>{}</p></article></div>',
        '<div class="page with-nav"><main><p>{}</p></main></div>',
        '<main id="search"><p>{}</p></main>',
        '<article class="post share-enabled"><p>{}</p></article>',
        '<article class="post share"><p>{}</p></article>',
        '<div class="sidebar"><article><p>{}</p></article></div>',
        '<form id="aspnetForm"><div><p>{}</p></div></form>',
        '<div class="comments"><p>{}</p></div>',
        '<body class="search menu"><p>{}</p></body>',
        '<article><div class="alert">{}</div></article>',
        '<div role="search"><article>{}</article></div>',
        '<div class="sidebar">Short</div><div class="site-footer">Foot</div><div class="ad-banner">Buy</div><nav>Menu</nav><p>{}</p>',
        '<article><p>{}</p><div class="share">Share this</div><div class="comments">First!</div></article>',
    ],
)
def test_names_of_wrappers_drop_nothing(page):
    assert text_of(f"<html><body>{page.format(LONG)}</body></html>") == LONG


def test_a_teaser_is_not_the_page():
    paragraphs = [f"Paragraph {i}. {LONG}" for i in range(20)]
    page = "<body><div>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</div><article>teaser</article></body>"
    assert text_of(page) == "\n\n".join([*paragraphs, "teaser"])
    assert text_of(f"<body><main><p>{LONG}</p></main><div>{LONG} {LONG} {LONG}</div></body>") == LONG

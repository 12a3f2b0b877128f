"""Site templates: the count against a plain one over real pages, unmarked templates of a part of a host, copies, and linear time."""

from __future__ import annotations

import time
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from variantlab.llm import pages, queries

SCHEMA = "page_id long, url string, html string"


def plain_subtrees(page):
    """(name, texts) of every element that counts, by joining the texts themselves."""
    out = set()
    texts = [" ".join(c.split()) if c else "" for c in page.chunks]
    every = sum(map(len, texts))
    for e in page.elements:
        own = tuple(t for t in texts[e.start : e.end] if t)
        inside = e.parent >= 0 and page.elements[e.parent].root
        article = e.root and not inside
        shared = e.root and inside and e.name in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "dd", "dt", "td", "th", "tr")
        counts = e.name in pages._BLOCK or e.name in pages._DROPPED or e.dropped
        if own and counts and e.name not in ("html", "body", "head") and not article and not shared and 2 * sum(map(len, own)) <= every:
            out.add((e.name, own))
    return out


def test_counts_over_real_pages(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("host", pages.host_of(F.col("url"))).collect()
    found, total, holders = defaultdict(Counter), Counter(), defaultdict(set)
    for r in rows:
        page = pages.parse(r.html or "")
        total[r.host] += 1
        for x in plain_subtrees(page):
            found[r.host][x] += 1
            holders[r.host, x].add("".join(c or " " for c in page.chunks))
    least = 2
    expected = {h: sum(n >= least and n >= 0.02 * total[h] and len(holders[h, x]) > 1 for x, n in own.items()) for h, own in found.items()}
    got = {r.host: len(r.templates) for r in pages.templates(spark.read.parquet(f"{sf_dir}/pages.parquet"), least=least).collect()}
    assert got == {h: n for h, n in expected.items() if n} and sum(got.values()) > 0


def test_templates_are_deleted_from_real_pages(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    some = pages.extracted(df, least=2).collect()
    assert sum(r.n_templates for r in some) > 0
    assert {r.page_id: r.text for r in some} == {r.page_id: r.text for r in queries.op3_main_text(spark, sf_dir).collect()}


def test_unmarked_template_of_a_part_of_a_host(spark):
    """A notice on a twentieth of a host's pages goes, one on a single page stays."""
    rows = []
    for i in range(400):
        notice = "<div><span>Section</span> seven is open again until the end of May</div>" if i % 20 == 0 else ""
        once = f"<div>Only page {i} says this</div>" if i == 3 else ""
        rows.append((i, f"http://a.example.com/{i}", f"<body><div><b>Top</b> menu here</div>{notice}<div><p>Own text number {i} is longer than menus are, as texts should be.</p></div>{once}</body>"))
    got = {r.page_id: r for r in pages.extracted(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in range(400):
        assert got[i].text == f"Own text number {i} is longer than menus are, as texts should be." + (f"\n\nOnly page {i} says this" if i == 3 else "")
        assert got[i].n_templates == (2 if i % 20 == 0 else 1)


def test_copies_are_no_templates(spark):
    """Neither pages that are copies of one page nor an article under different menus lose text."""
    one = "<body><div>First part of the page.</div><div>Second part of the page.</div></body>"
    rows = [(i, "http://c.example.com/x", one) for i in range(50)]
    article = "<body><div>menu {i}</div><div><div>The same article stands on every page, and it is longer than its menu.</div></div></body>"
    rows += [(100 + i, "http://d.example.com/x", article.format(i=i)) for i in range(50)]
    rows += [(200 + i, "http://e.example.com/x", f"<article><h1>Title</h1><p>Shared paragraph.</p><p>Own {i}.</p></article>") for i in range(50)]
    got = {r.page_id: r.text for r in pages.extracted(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] == "First part of the page.\n\nSecond part of the page." for i in range(50))
    assert all("The same article stands" in got[100 + i] for i in range(50))
    assert all(got[200 + i] == f"Title\n\nShared paragraph.\n\nOwn {i}." for i in range(50))


def seconds(source):
    best = 9e9
    for _ in range(3):
        began = time.perf_counter()
        page = pages.parse(source)
        pages.cleaned(page, {1})
        best = min(best, time.perf_counter() - began)
    return best


def test_time_is_linear():
    nested = lambda n: "<div><p>some words</p>" * n + "</div>" * n
    stray = lambda n: "<b>x" * n + "</i>y" * n
    lists = lambda n: "<ul><li>" * n + "<b>x</u>" * n
    for make in (nested, stray, lists):
        assert seconds(make(16_000)) < 12 * seconds(make(4_000)) + 0.05


def test_odd_pages(spark):
    rows = [(1, None, None), (1, None, None), (None, "http://x", "<p>a</p>"), (2, "http://x", "")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("templates", F.lit("q")).withColumn("n", F.lit(1))
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in pages.extracted(df).collect()), key=str)
    assert got == sorted([(1, None, "", 0), (1, None, "", 0), (None, "http://x", "a", 1), (2, "http://x", "", 0)], key=str)
    assert pages.extracted(df.limit(0)).count() == 0

"""Vectors, pages and archives against plain, slow versions and on odd rows; and the pipeline."""

from __future__ import annotations

import base64
import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from variantlab.llm import pages, queries, vectors, warc
from variantlab.llm.common import components


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def slow_vectors(rows):
    good = {}
    for k, (i, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[k] = np.array(v, float) / np.linalg.norm(v)
    links = {k: [j for j in good if j != k and len(good[j]) == len(good[k]) and good[k] @ good[j] >= 0.95] for k in good}
    low = {k: rows[k][0] for k in range(len(rows))}
    ids = {k: rows[k][0] for k in good}
    while True:
        new = {**low, **{k: min([low[k], *[low[j] for j in links[k]], *[low[j] for j in good if ids[j] == ids[k]]]) for k in good}}
        if new == low:
            return [(rows[k][0], len(links.get(k, ())), low[k]) for k in range(len(rows))]
        low = new


def test_vectors_are_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL", 32)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=16)
    rows = [(i, (centre + rng.normal(size=16) * 0.25).tolist()) for i in range(120)] + [(500 + i, rng.normal(size=16).tolist()) for i in range(100)]
    rows += [(700 + i, centre.tolist()) for i in range(30)] + [(800, (centre * 3).tolist()), (801, None), (802, []), (803, [0.0] * 16), (804, [float("nan")] * 16), (805, [float("inf")] + [1.0] * 15), (806, [None] + [1.0] * 15), (807, [1.0, 2.0]), (808, [2.0, 4.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, key string, cell int")
    got = sorted(tuple(r)[:3] for r in vectors.near_duplicates(df).collect())
    assert got == sorted(slow_vectors(rows))
    assert vectors.near_duplicates(df.limit(0)).count() == 0


PAGE = '<html><head><title>t</title></head><body><nav><a href="/">Home</a></nav><div class="ad">Buy</div><div>Site line {n}</div><article><h1>T &amp; {i}</h1><p>One\n <b>two</b>&nbsp;{i}<p>Three</article><div>Subscribe today</div><footer>f</footer></body></html>'


def test_main_text_cases():
    text = lambda s, known=(): pages.main_text(pages.parse(s), set(known))
    assert text(PAGE.format(i=1, n=2)) == "T & 1\n\nOne two 1\n\nThree"
    assert text("") == "" and text("a < b &lt; c") == "a < b < c" and text("<p>x</p><p") == "x" and text("<!-- x") == ""
    assert text('<div><script>if(a<b){"</p>"}</script><p title="a>b">q</p>r</div>') == "q\n\nr"
    assert text('<article><p>a</p><section class="comments"><article class="comment">c</article></section><form>f</form><aside>s</aside></article>') == "a"
    assert text("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == "a\n\nb\n\nc\n\nd"
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert text(deep) == "x"


def test_templates_are_removed_by_host(spark):
    body = '<html><body><div>Top of this site</div><div><p>Own text {i}</p></div><div>End of this site</div></body></html>'
    rows = [(i, f"http://a.example.com/{i}", body.format(i=i)) for i in range(20)] + [(100 + i, f"http://b.example.com/{i}", f"<body><div>Only here {i}</div></body>") for i in range(20)]
    rows += [(200, None, None), (201, "http://a.example.com/x", ""), (202, "", "<p>x</p>"), (202, "", "<p>x</p>"), (203, "u", "<p>" + "long " * 50_000 + "</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("z")).withColumn("h", F.lit(1)).withColumn("templates", F.lit("q"))
    got = {r.page_id: r for r in pages.extracted(df).collect()}
    assert pages.extracted(df).count() == len(rows)
    assert all(got[i].text == f"Own text {i}" for i in range(20)) and all(got[100 + i].text == f"Only here {i}" for i in range(20))
    assert got[200].text == "" and got[201].n_chars == 0 and got[202].text == "x" and got[203].n_chars == 5 * 50_000 - 1
    assert pages.extracted(df.limit(0)).count() == 0


def test_main_text_of_pages(spark, sf_dir):
    """Every page's article, cut out by hand."""
    import html
    import re

    got = {r.page_id: r.text for r in queries.op3_main_text(spark, sf_dir).collect()}
    for i, source in duckdb.sql(f"select page_id, html from '{sf_dir}/pages.parquet'").fetchall():
        own = source.split("<article>", 1)[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub(r"<(br|/?b)>", " " if False else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", re.sub("<br>", " ", own))]
        assert got[i] == "\n\n".join(b for b in blocks if b)


def test_archives_are_their_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    expected = sorted(con.execute(warc.SQL).fetchall())
    assert sorted(map(tuple, queries.op4_warc(spark, sf_dir).collect())) == expected


def test_archives_odd_rows(spark, tmp_path):
    rows = [(5, "http://x/ä b", "<p>é</p>"), (3, "http://y", "<p>é</p>"), (4, None, None), (9, "z", ""), (7, "w", "x" * 300_000), (7, "w", "x" * 300_000), (8, "v", "\r\n\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit(1)).withColumn("low", F.lit(1)).repartition(3)
    got = sorted(map(tuple, warc.report(df).collect()), key=str)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {"<p>é</p>": 3, "": 4, "x" * 300_000: 7, "\r\n\r\n": 8}
    expected = [(i, len((t or "").encode()), digest(t), "response" if first[t or ""] == i else "revisit", None if first[t or ""] == i else first[t or ""]) for i, _, t in rows]
    assert got == sorted(expected, key=str)
    assert {r.record_type for r in warc.report(df, least=1 << 20).collect()} == {"response"}
    assert warc.report(df.limit(0)).count() == 0
    folder = f"file://{tmp_path}/w"
    index = warc.write(df, folder)
    some = warc.read(index.where("page_id = 8"), folder).collect()
    assert [(r.page_id, bytes(r.payload), r.url) for r in some] == [(8, b"\r\n\r\n", "v")]


def test_reads_are_coalesced():
    rows = [("a", 0, 10, ""), ("a", 10, 5, ""), ("a", 200, 5, ""), ("b", 0, 3, ""), ("b", 3, 90, ""), ("b", 93, 90, "")]
    assert [[r[1] for r in s] for s in warc.spans(rows, 20, 100)] == [[0, 10], [200], [0, 3], [93]]


def test_pipeline_is_brute_force_where_it_can_be(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    from test_texts import check_packing, slow_base, slow_cut, slow_groups, words

    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    start = docs
    for name, stage in pipeline.STAGES:
        held[name] = {r.doc_id: r for r in stage(spark, docs, sf_dir).collect()} if name != "packing" else stage(spark, docs, sf_dir).collect()
        if name != "packing":
            docs = spark.createDataFrame(list(held[name].values()), start.schema)
            assert docs.columns == start.columns
    from variantlab.llm import quality

    verdicts = {r.doc_id for r in quality.quality_report(start).where("kept").collect()}
    assert set(held["quality_rules"]) == verdicts
    groups = slow_groups([(d, r.text) for d, r in held["quality_rules"].items()])
    assert set(held["near_duplicates"]) == {d for d, g in groups.items() if d == g}
    left, _ = slow_cut([(d, r.text) for d, r in held["near_duplicates"].items()])
    assert {d: words(r.text) for d, r in held["repeated_passages"].items()} == left
    assert set(held["personal_data"]) == set(left) and not any(slow_base(r.text) for r in held["personal_data"].values())
    assert {r.doc_id for r in held["packing"]} == set(left)
    check_packing(held["packing"], 1024)
    n = pipeline.run(spark, sf_dir).count()
    assert n == len(held["packing"])

"""What has no bound by size: long white space, null ids, large groups, frequent shingles, packing of few pieces."""

from __future__ import annotations

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from variantlab.llm import bpe, neardup, packing, toxicity, vectors, warc

SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("text", [" " * 1_000_000, "a" + " " * 1_000_000 + "b", "\n" * 1_000_000, " \n" * 500_000 + "x", "\xa0" * 300_000 + "y", "a　" * 1000, "x " + " " * 300 + " z"])
def test_long_white_space_is_the_library(text):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(bpe.public_path())
    coder = bpe.encoder(bpe.public_path())
    ids = coder.encode(text.encode())
    assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert coder.decode(ids) == text.encode()


def test_wide_spaces_leave_certain_cuts():
    coder = bpe.encoder(bpe.public_path())
    plain = "one.two;three,four" * 20
    data = np.frombuffer(plain.encode(), np.uint8)
    wide = np.frombuffer(("\xa0" + plain).encode(), np.uint8)
    assert len(coder._cuts(wide)) >= len(coder._cuts(data)) > 0


def test_long_white_space_in_queries(spark):
    texts = [(1, "a" + " " * 1_000_000 + "b"), (None, "no id"), (None, "no id"), (2, None)]
    df = spark.createDataFrame(texts, SCHEMA)
    assert {r.doc_id: r.decoded_sha256 for r in bpe.encode_report(df).collect()}[1] == hashlib.sha256(texts[0][1].encode()).hexdigest()
    rows = packing.packed(df).collect()
    assert Counter(r.doc_id for r in rows)[None] == 2 and sum(r.length for r in rows if r.doc_id == 1) > 1_000_000 // 1024


def test_rows_without_id_fill_no_group(spark):
    """A large doc_id stays exact beside nulls, and repeated ids are dealt to all groups."""
    big = (1 << 53) + 1
    df = spark.createDataFrame([(None, "the words")] * 300 + [(big, "the words")] * 300, SCHEMA)
    rows = packing.packed(df, group=50).collect()
    assert Counter(r.doc_id for r in rows) == {None: 300, big: 300}
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    for own in by.values():
        own.sort(key=lambda r: r.offset)
        assert own[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in zip(own, own[1:]))


def fewest(sizes, capacity):
    """The least number of bins, by trying every assignment."""
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity:
                bins[k] += sizes[i]
                place(i + 1, bins)
                bins[k] -= sizes[i]
        bins.append(sizes[i])
        place(i + 1, bins)
        bins.pop()

    place(0, [])
    return best


def test_packing_of_few_pieces_is_near_the_optimum():
    rng, over = random.Random(9), 0
    for _ in range(150):
        sizes = sorted((rng.randint(1, 10) for _ in range(9)), reverse=True)
        bins = packing.Bins(sizes, 12)
        bins.pack()
        bins.search()
        used = sum(f > 0 for f in bins.fill)
        assert sorted(itertools.chain(*bins.content)) == list(range(9)) and max(bins.fill) <= 12
        assert bins.least() <= fewest(sizes, 12) <= used
        over += used - fewest(sizes, 12)
    assert over <= 3


def test_null_pages_are_archived(spark):
    rows = [(None, "http://a", "x"), (5, "http://b", "x"), (4, "http://c", "x"), (None, "http://d", "only"), (None, None, None), (6, "http://e%20f/ä", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.report(df).collect()), key=str)
    expected = [(None, "revisit", 4, 1), (5, "revisit", 4, 1), (4, "response", None, 1), (None, "response", None, 4), (None, "revisit", 6, 0), (6, "response", None, 0)]
    assert got == sorted(expected, key=str)


def test_changed_bytes_are_noticed():
    raw = warc.record(3, "http://x", b"payload", warc.digest_of(b"payload"), None)
    assert warc.checked(raw, "http://x")[5] == b"payload"
    with pytest.raises(ValueError):
        warc.checked(raw.replace(b"payload", b"paYload"), "http://x")


def test_a_revisit_needs_its_response(spark):
    schema = "page_id long, record_type string, refers_to long, digest string, payload_bytes long"
    rows = spark.createDataFrame([(1, "response", None, "D", 7), (2, "revisit", 1, "D", 7)], schema)
    assert sorted((r.page_id, r.payload_bytes) for r in warc.resolved(rows).collect()) == [(1, 7), (2, 7)]
    with pytest.raises(Exception, match="isn't in the archives"):
        warc.resolved(rows.where("page_id = 2")).collect()


def test_frequent_shingles_are_exact_in_any_blocks(spark, monkeypatch):
    """Shingles of at least one in RATIO texts, counted by words themselves, however texts fall into blocks."""
    rng = random.Random(3)
    texts = []
    for i in range(450):
        own = [f"w{rng.randrange(10**6)}" for _ in range(30)]
        common = ["the", "same", "five", "words", "here"] if i % 40 == 0 else ["other", "five", "words", "stand", "there"] if i % 97 == 0 else []
        texts.append((i, " ".join(own[:15] + common + own[15:])))
    counts = Counter(tuple(w[i : i + 5]) for _, t in texts for w in [t.split()] for i in {i for i in range(len(w) - 4)})
    wanted = sorted(n for n in counts.values() if n * neardup.RATIO >= len(texts))
    df = spark.createDataFrame(texts, SCHEMA).repartition(7)
    for size in (1, 300, 10**9):
        monkeypatch.setattr(neardup, "BLOCK_SHINGLES", size)
        assert sorted(neardup.frequent(df, len(texts))["n"].tolist()) == wanted


def test_scores_do_not_depend_on_neighbours():
    rng = np.random.default_rng(2)
    p, size = rng.random(500) ** 4, rng.integers(0, 6, 120)
    first = np.minimum(np.concatenate([[0], np.cumsum(size)]), 500)
    whole = toxicity.document_scores(p, first)
    for i in range(120):
        own = p[first[i] : first[i + 1]]
        alone = toxicity.document_scores(own, np.array([0, len(own)]))
        assert whole[i] == alone[0] and abs(alone[0] - (1 - np.prod(1 - own))) < 1e-9


def test_signs_leave_out_no_pair_at_the_threshold():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((2000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((2000, 32))
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * z
    planes = np.random.default_rng(1).standard_normal((32, vectors.SIGNS))
    differ = ((x @ planes > 0) != (y @ planes > 0)).sum(1)
    assert differ.max() <= vectors.most_differing(vectors.SIGNS)
    assert pa.array(differ).type == pa.int64()


def test_quality_names_may_clash(spark):
    from pyspark.sql import functions as F

    from variantlab.llm import quality

    good = "This line has quite a few plain words and it ends well.\nAnother one follows here, with other words, and it ends well too."
    df = spark.createDataFrame([(1, good), (None, good), (2, None)], SCHEMA)
    for name in ("q_kept", "q_n_words", "row_0", "row_1", "q_clean_text"):
        df = df.withColumn(name, F.lit("x"))
    out = quality.cleaned(df)
    assert out.columns == df.columns and sorted((r.doc_id or 0, r.text, r.row_1) for r in out.collect()) == [(0, good, "x"), (1, good, "x")]
    assert quality.quality_report(df).count() == 3 and quality.cleaned(df.limit(0)).count() == 0

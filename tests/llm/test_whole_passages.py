"""Repeated passages against word runs that are compared directly, without the rule for cuts."""

from __future__ import annotations

import itertools
import random

from variantlab.llm import substrings

SCHEMA = "doc_id long, text string"


def passage_words(rng, fresh, n, closing):
    return [f"w{next(fresh)}" + ("." if rng.random() < closing else "") for _ in range(n)]


def test_all_of_a_passage_goes(spark):
    rng, fresh = random.Random(11), itertools.count()
    pairs, shared = [], []
    for k in range(300):
        passage = passage_words(rng, fresh, rng.randrange(50, 70), (0, 0.08)[k % 2])
        shared.append(passage)
        for copy in range(2):
            own = [passage_words(rng, fresh, rng.randrange(0, 60), (0, 0.08)[k % 2]) for _ in range(2)]
            pairs.append((1000 * copy + k, " ".join([*own[0], *passage, *own[1]])))
    left = {r.doc_id: set(r.text.split()) for r in substrings.removed_passages(spark.createDataFrame(pairs, SCHEMA)).collect()}
    for d, text in pairs:
        passage, gone = shared[d % 1000], set(text.split()) - left[d]
        assert gone <= set(passage) and not (d < 1000 and gone)
        assert d < 1000 or set(passage[8:-8]) <= gone, d  # at most 8 words stay at either end


def test_the_end_of_a_passage_goes(spark):
    fresh = itertools.count()
    sentences = [" ".join(f"v{next(fresh)}" for _ in range(n - 1)) + " end." for n in (25, 25, 8, 8)]
    pairs = [(i, " ".join([f"start{i}.", *sentences, f"own{i} words{i} here{i}."])) for i in range(2)]
    left = {r.doc_id: r.text.split() for r in substrings.removed_passages(spark.createDataFrame(pairs, SCHEMA)).collect()}
    assert left[0] == pairs[0][1].split() and left[1] == ["start1.", "own1", "words1", "here1."]


def test_blocks_change_nothing(spark, monkeypatch):
    """Texts that settle among their own in small blocks give what one block gives; names of other columns may be any."""
    from pyspark.sql import functions as F

    rng, fresh = random.Random(3), itertools.count()
    common = passage_words(rng, fresh, 60, 0.1)
    pairs = [(i, " ".join([*passage_words(rng, fresh, 30, 0.1), *(common if i % 3 else []), *passage_words(rng, fresh, 30, 0.1)])) for i in range(200)]
    pairs += [(500, pairs[7][1]), (500, pairs[8][1]), (500, pairs[7][1]), (501, " ".join(common * 2))]
    df = spark.createDataFrame(pairs, SCHEMA)
    for name in ("id", "spans", "row", "h", "h2", "low", "s_removed", "s_spans"):
        df = df.withColumn(name, F.lit("x"))
    results = []
    for size in (1, 500, 10**9):
        monkeypatch.setattr(substrings, "BLOCK", size)
        out = substrings.removed_passages(df.repartition(1))
        assert out.columns == [c for c in df.columns if c != "s_removed"] + ["s_removed"]
        results.append(sorted((r.doc_id, r.text, r.s_removed) for r in out.collect()))
    assert results[0] == results[1] == results[2]
    assert sum(n > 0 for _, _, n in results[0]) > 130


def test_short_sentences_are_never_cut(spark):
    sentences = [" ".join(f"u{i}x{j}" for j in range(7)) + " end." for i in range(5)]
    text = " ".join(sentences)
    pairs = [(1, text), (2, f"{sentences[4]} {' '.join(sentences[1:4])} {sentences[0]}")]
    left = {r.doc_id: r.text for r in substrings.removed_passages(spark.createDataFrame(pairs, SCHEMA)).collect()}
    assert left[1] == text and left[2] == f"{sentences[4]} {sentences[0]}"

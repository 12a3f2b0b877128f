"""Text operators against plain, slow versions, and on odd rows: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from variantlab.llm import bpe, neardup, packing, pii, quality, substrings, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(sf_dir):
    return duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet' order by doc_id").fetchall()


def odd_rows():
    long = " ".join(f"word{i % 977}" for i in range(40_000)) + "."
    return [(1, None), (2, ""), (3, "   \n\t "), (4, "a"), (5, "a"), (6, long), (7, long), (7, long), (8, "été 汉字 🎉 <|endoftext|> x"), (9, "one two three four five six"), (None, "no id")]


def frame(spark, pairs, extra=False):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in pairs]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        for name in ("h", "n", "key", "cell", "side", "rep", "grp", "spans", "band", "u", "v", "count", "score", "ids", "low", "label"):
            df = df.withColumn(name, F.lit("x"))
    return df


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# BPE


def test_bpe_is_the_library(spark, sf_dir):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(bpe.public_path())
    rng = random.Random(4)
    parts = [*"abZ09 .,'!\n\t\r\x0b\x1c\x85\xa0 éñ汉🎉", "'s", "'re", "  ", " \n", "<|endoftext|>"]
    texts = [t for _, t in rows_of(sf_dir)] + ["", "<|endoftext|>", "a<|endoftext|>b"] + ["".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(1500)]
    df = frame(spark, list(enumerate(texts)), extra=True)
    for r in bpe.encode_report(df).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_odd_rows_and_round_trip(spark):
    df = frame(spark, odd_rows(), extra=True)
    back = bpe.decoded(bpe.encoded(df)).collect()
    assert len(back) == len(odd_rows()) and all(r.decoded == (r.text or "") for r in back)
    assert bpe.encode_report(df.limit(0)).count() == 0


def test_bpe_cache_full_changes_nothing():
    small, large = bpe.Encoder(bpe.public_path(), cache=3), bpe.Encoder(bpe.public_path())
    text = "the thing is that the other thing isn't".encode()
    assert small.encode(text) == large.encode(text) and len(small.known) == 3


# quality rules


def test_quality_is_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    expected = con.execute(quality.SQL).df().sort_values("doc_id")
    got = quality.quality_report(spark.read.parquet(f"{sf_dir}/documents.parquet")).toPandas().sort_values("doc_id")
    for c in expected.columns:
        assert got[c].tolist() == expected[c].tolist(), c


def slow_repeats(text, n=8):
    w = words(text)
    spans = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    covered = {j for i in range(len(w) - n + 1) if spans[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
    return len(covered)


def test_quality_counts_and_verdicts(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choices("abcd", k=rng.randint(0, 60))) + rng.choice(["", ".", "\n."]) for _ in range(150)]
    good = "This line has quite a few plain words and it ends well.\n" * 1 + "Another one follows here, with other words, and it ends well too.\nAnd a last one that says something else again."
    texts += [good, good + "\nhome | about | news | contact", "home | about | news | contact | login | more | even more | less\n" * 3, None, ""]
    got = {r.doc_id: r for r in quality.quality_report(frame(spark, list(enumerate(texts)), extra=True)).collect()}
    for i, t in enumerate(texts):
        r, lines = got[i], [x for x in (t or "").split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_dup_lines) == (len(words(t)), sum(map(len, words(t))), len(lines) - len(set(lines)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t or "") and r.n_repeat_words == slow_repeats(t)
        assert r.base_failed == (len(words(t)) < 20 or 100 * slow_repeats(t) > 30 * len(words(t)))
    n = len(texts)
    assert [got[i].kept for i in range(n - 5, n)] == [True, True, False, False, False]


def test_quality_cleaning(spark):
    good = "This line has quite a few plain words and it ends well.\nAnother one follows here, with other words, and it ends well too."
    df = frame(spark, [(1, good + "\nAll rights reserved."), (2, "x | y"), (3, None)], extra=True)
    out = quality.cleaned(df).collect()
    assert [(r.doc_id, r.text, r.n_chars) for r in out] == [(1, good, len(good))] and quality.cleaned(df).columns == df.columns
    assert quality.quality_report(frame(spark, odd_rows())).count() == len(odd_rows()) and quality.cleaned(df.limit(0)).count() == 0


# near-duplicates


def slow_groups(pairs):
    """Weighted Jaccard of all pairs, by words themselves."""
    shingles = {}
    for d, t in pairs:
        w = words(t)
        shingles[d] = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
    n = len(pairs)
    df = Counter(s for c in shingles.values() for s in c)
    idf = {s: 1 + math.log(min(100, max(1, n / k))) / math.log(100) for s, k in df.items()}
    weight = {d: sum(idf[s] * k for s, k in c.items()) for d, c in shingles.items()}
    where = defaultdict(list)
    for d, c in shingles.items():
        for s in c:
            where[s].append(d)
    common = Counter()
    for s, ds in where.items():
        for i, a in enumerate(ds):
            for b in ds[:i]:
                common[a, b] += idf[s] * min(shingles[a][s], shingles[b][s])
    root = {d: d for d in shingles}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), c in common.items():
        if c / (weight[a] + weight[b] - c) >= 0.8 - 1e-9:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {d: find(d) for d in root}


def edited(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice("xyz") * rng.randint(1, 5)
    return " ".join(w)


def test_near_duplicates_are_brute_force(spark, sf_dir):
    rng = random.Random(2)
    base = " ".join(rng.choice("abcdefghij") * rng.randint(1, 6) for _ in range(200))
    pairs = rows_of(sf_dir) + [(10_000 + i, edited(rng, base, rng.randint(0, 6))) for i in range(150)] + [(20_000 + i, base) for i in range(60)] + [(30_000, None), (30_001, ""), (30_002, "a b"), (30_003, "a b")]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, pairs, extra=True)).collect()}
    assert got == slow_groups(pairs)


def test_large_groups_are_cut_into_cells(spark, monkeypatch):
    monkeypatch.setattr(neardup, "COMPARED", 16)
    monkeypatch.setattr(neardup, "VERIFIED", 16)
    rng = random.Random(5)
    base = " ".join(rng.choice("abcdefghij") * rng.randint(1, 6) for _ in range(150))
    pairs = [(i, edited(rng, base, rng.randint(0, 8))) for i in range(120)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, pairs)).collect()}
    assert got == slow_groups(pairs)


def test_deduplication_odd_rows(spark):
    df = frame(spark, odd_rows(), extra=True)
    out = neardup.deduplicated(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 2, 3, 4, 6, 8, 9]
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_samples_follow_weighted_jaccard():
    """The share of agreeing samples is the weighted Jaccard similarity."""
    values = np.arange(1, 41, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = np.linspace(1, 3, 40), np.linspace(3, 1, 40)
    b[:10] = 0
    own = b > 0
    hits = sum(neardup.samples(values, a, np.array([0, 40]), k)[0] == neardup.samples(values[own], b[own], np.array([0, own.sum()]), k)[0] for k in range(2000)) / 2000
    assert abs(hits - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


# repeated passages


def pair_hashes(text):
    """A hash of each two neighbouring words."""
    from variantlab.llm.arrays import Words, mix, utf8

    v = Words(*utf8(pa.array([text]))).value.tolist()
    return [int(mix(np.array([(a * 3 + b) % 2**64], np.uint64))[0]) for a, b in zip(v, v[1:])]


def slow_cut(pairs):
    """Sentences by regular expressions, cuts of long ones by looking at every window, spans in a dictionary."""
    split = {}
    for d, t in pairs:
        own, ends, line_of = [], [], []
        for k, line in enumerate((t or "").split("\n")):
            for w in words(line):
                own.append(w)
                line_of.append(k)
                ends.append(bool(re.search(r"[.!?][\"')\]]?$", w)) and not re.fullmatch(r"[\"')\]]", w))
        hashes = [0 if ends[i] else h for i, h in enumerate(pair_hashes(t or ""))]
        cuts = set()
        for i in range(len(hashes) - substrings.WINDOW + 1):
            window = range(i, i + substrings.WINDOW)
            cuts.add(1 + max(window, key=lambda j: (-hashes[j], j)))
        out = []
        for i, w in enumerate(own):
            if not i or ends[i - 1] or i in cuts or line_of[i] != line_of[i - 1]:
                out.append([])
            out[-1].append(w)
        split[d] = out
    spans = defaultdict(set)  # of each document its shortest runs from each start and to each end
    for d, s in split.items():
        for step in (1, -1):
            for i in range(len(s)):
                j, n = i, 0
                while 0 <= j < len(s) and (abs(j - i) < 2 or n < 20):
                    n += len(s[j])
                    j += step
                if abs(j - i) >= 2 and n >= 20:
                    spans[d].add((i, j) if step > 0 else (j + 1, i + 1))
    seen, gone = {}, defaultdict(set)
    for d in sorted(split):
        for i, j in sorted(spans[d]):
            key = tuple(w for x in split[d][i:j] for w in x)
            if key in seen:
                gone[d] |= set(range(i, j))
            seen.setdefault(key, (d, i))
    return {d: [w for i, x in enumerate(s) if i not in gone[d] for w in x] for d, s in split.items()}, gone


def test_passages_are_brute_force(spark, sf_dir):
    rng = random.Random(6)
    sentence = lambda: " ".join(rng.choice("abcdefghij") * rng.randint(1, 6) for _ in range(rng.randint(3, 15))).capitalize() + "."
    passage = " ".join(sentence() for _ in range(8))
    own = [(50_000 + i, f"{sentence()} {sentence()}\n{passage}\n{sentence()}") for i in range(40)]
    pairs = rows_of(sf_dir) + own + [(60_000, passage + "\n" + passage), (60_001, None), (60_002, ""), (60_003, sentence())]
    got = {r.doc_id: r for r in substrings.report(frame(spark, pairs, extra=True)).collect()}
    left, gone = slow_cut(pairs)
    for d, _ in pairs:
        assert words(got[d].text) == left[d], d
        assert got[d].n_removed == len(gone[d])
    assert got[50_000].n_removed == 0 and all(got[50_000 + i].n_removed >= 8 for i in range(1, 40))


def test_passages_odd_rows(spark):
    df = frame(spark, odd_rows(), extra=True)
    out = substrings.removed_passages(df)
    assert out.columns == [*df.columns, "s_removed"] and out.count() == len(odd_rows())
    rows = out.collect()
    assert {r.s_removed for r in rows if r.doc_id in (1, 2, None)} == {0} and len({(r.text, r.s_removed) for r in rows if r.doc_id == 7}) == 1
    assert len({r.text for r in rows if r.doc_id == 7}.pop()) < len({r.text for r in rows if r.doc_id == 6}.pop())
    assert substrings.removed_passages(df.limit(0)).count() == 0


# personal data


def slow_base(text):
    out = []
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    for k, p in enumerate(patterns):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            check = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            if (k == 0, k == 1 and all(int(x) <= 255 for x in m.group().split(".")), k == 2 and 13 <= len(digits) <= 19 and check, k == 3 and 9 <= len(digits) <= 15)[k]:
                out.append((k, m.start(), m.end()))
    return out


def test_base_spans_are_the_patterns(sf_dir):
    rng = random.Random(7)
    texts = [t for _, t in rows_of(sf_dir)] + ["".join(rng.choices("ab@.1234+- ()%é", k=60)) for _ in range(4000)]
    assert all(pii.base_spans(t) == slow_base(t) for t in texts)


def test_personal_data(spark, sf_dir):
    pairs = rows_of(sf_dir) + [(90_000 + i, t) for i, t in odd_rows() if i]
    pairs.append((99_000, "x" * 70_000 + " joe@mail.example.com " + "1" * 5000))
    df = frame(spark, pairs, extra=True)
    rows = pii.report(df).collect()
    assert len(rows) == len(pairs)
    texts = dict(pairs)
    for r in rows:
        base = slow_base(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in base) for i in range(4)]
        assert set(pii.joined(base).split(",")) <= set(r.spans.split(","))
    out = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    assert not any(pii.base_spans(t or "") for t in out.values()) and "<EMAIL>" in out[99_000]
    assert pii.redacted(df).columns == df.columns and pii.report(df.limit(0)).count() == 0


def test_network_gradients_and_learning(sf_dir):
    texts = [f"call +1 ({200 + i}) 555-{1000 + i} or write a{i}@mail{i % 9}.example.com from 10.{i % 250}.3.4 now" for i in range(150)]
    net = pii.Tagger()
    x, y = (v[:3] for v in pii.examples(texts[:3]))
    _, grad = net.loss(x, y)
    for k, p in net.p.items():
        at = np.unravel_index(np.abs(grad[k]).argmax(), p.shape)
        old, e = p[at], 1e-5
        p[at] = old + e
        up = net.loss(x, y)[0]
        p[at] = old - e
        down = net.loss(x, y)[0]
        p[at] = old
        assert grad[k][at] == pytest.approx((up - down) / (2 * e), rel=1e-4, abs=1e-6)
    net = pii.train(*pii.examples(texts[:100]), steps=120)
    found = [set(f) & set(pii.base_spans(t)) for f, t in zip(pii.found_spans(texts[100:], net), texts[100:])]
    assert sum(map(len, found)) > 0.6 * sum(len(pii.base_spans(t)) for t in texts[100:])


# toxicity


def test_toxicity_learns_and_locates(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(600):
        s = [" ".join(rng.choices(vocabulary, k=8)) for _ in range(rng.randint(1, 12))]
        toxic = i % 4 == 0
        if toxic:
            s[rng.randrange(len(s))] += " " + rng.choice(["scumbag", "scummy", "loser"])
        docs.append((i, ". ".join(s) + "."))
        labels.append((i, int(toxic)))
    frame_ = frame(spark, docs + [(700, None), (701, "")], extra=True)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.report(frame_, known).collect()}
    assert len(got) == 602 and got[700].score == 0 and got[701].score == 0
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for d, r in got.items())
    held = [(got[i].score, t) for i, t in labels if got[i].held_out]
    assert np.mean([(s >= 0.3) == bool(t) for s, t in held]) > 0.95
    spans = {r.doc_id: r.offending for r in toxicity.scored(frame_, toxicity.fitted(frame_, known)).collect()}
    hits = [any(re.search("scum|loser", docs[i][1][s.start : s.end]) for s in spans[i]) for i, t in labels if t]
    assert np.mean(hits) > 0.9
    assert toxicity.report(frame_.limit(0), known).count() == 0 and toxicity.report(frame_, known.limit(0)).count() == 602


# packing


def check_packing(rows, length):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    for own in by.values():
        own.sort(key=lambda r: r.offset)
        assert own[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in zip(own, own[1:])) and own[-1].offset + own[-1].length <= length
    return len(by)


def test_packing_is_whole(spark, sf_dir):
    pairs = rows_of(sf_dir) + [(i + 100_000, t) for i, t in odd_rows() if i]
    rows = packing.packed(frame(spark, pairs, extra=True), group=100).collect()
    n = check_packing(rows, 1024)
    lower = -(-sum(r.length for r in rows) // 1024)
    assert n <= 1.03 * lower + 1
    coder, texts, counts = bpe.Encoder(bpe.public_path()), dict(pairs), Counter(i for i, _ in pairs)
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for d, own in pieces.items():
        own.sort(key=lambda r: r.piece)
        ids = np.frombuffer(coder.encode((texts[d] or "").encode()) + np.array([2], "<u4").tobytes(), "<u4")
        if counts[d] == 1:
            assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
            assert all(r.length == 1024 for r in own[1:]) and [r.start for r in own] == np.cumsum([0, *[r.length for r in own[:-1]]]).tolist()
            assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    assert packing.packed(frame(spark, []).limit(0)).count() == 0


def test_local_search_empties_bins():
    bins = packing.Bins([6, 5, 4, 3, 2], 10)
    bins.content, bins.fill = [[0, 4], [1, 3], [2]], [8, 8, 4]
    for b in range(3):
        bins._place(b)
    before = sum(f * f for f in bins.fill)
    bins.search(50)
    assert sum(f > 0 for f in bins.fill) == 2 and sum(f * f for f in bins.fill) > before
    assert sorted(x for c in bins.content for x in c) == [0, 1, 2, 3, 4]


def test_arrow_slices_and_nulls():
    from variantlab.llm.arrays import Words, utf8

    data, offsets = utf8(pa.array(["zz", None, "a b", ""]).slice(1))
    w = Words(data, offsets)
    assert w.first.tolist() == [0, 0, 2, 2] and len(set(w.value.tolist())) == 2

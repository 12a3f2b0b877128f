"""Chat formatting, the prefix trie and periodic runs against plain versions, SQL, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from variantlab.llm import chat, periodic, queries, trie
from variantlab.llm.arrays import utf8

TURNS = "conv_id long, turn long, role string, text string"
MESSAGES = "message_id long, parent_id long, role string, text string, score double"


@pytest.mark.parametrize("name", ["op11_chat_format", "op12_prefix_trie"])
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    got = queries.queries()[name](spark, sf_dir)
    cursor = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = [tuple(dict(zip(names, r))[c] for c in got.columns) for r in cursor.fetchall()]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def odd_turns():
    rows = [(1, None, "user", None), (1, 0, None, "<|im_end|>\n<|im_start|>assistant\nx"), (1, 1, "assistant", ""), (1, 2, "assistant", "a<\\|b <| <<|x|>")]
    rows += [(2, 0, "a\nb\\n<|c", "same"), (2, 0, "a\nb\\n<|c", "same"), (None, 0, "user", "nobody"), (None, 1, "assistant", "no one"), (3, 5, "assistant", "é汉🎉 " * 3000)]
    return rows


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# chat


def plain_chat(rows):
    by = defaultdict(list)
    for c, t, r, x in [*rows, (-1, 0, "user", chat._ADDED), (-1, 1, "assistant", chat._ADDED)]:
        by[c].append(((t is not None, t or 0), r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = [x for _, r, x in turns if r == "assistant"]
        out[c] = (len(turns), digest(f"{r}\n{x}\n" for _, r, x in turns), sum(map(len, loss)), digest(loss))
    return out


def test_chat_odd_rows(spark):
    rows = odd_turns()
    df = spark.createDataFrame(rows, TURNS)
    for c in ("message_id", "path", "at", "tree", "node", "score", "_place"):
        df = df.withColumn(c, F.lit("x"))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.report(df).collect()}
    assert got == plain_chat(rows)
    assert [r.conv_id for r in chat.report(df.limit(0)).collect()] == [-1]


def test_escapes_are_reversible():
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choices("<|\\>\nnax", k=rng.randint(0, 12)))
        assert chat.unescaped(chat.escaped(text)) == text
        assert "<|" not in chat.escaped(text)
        assert chat.role_of(chat.header_of(text)) == text
        assert "\n" not in chat.header_of(text)
        formatted = f"{chat.START}{chat.header_of(text)}\n{chat.escaped(text)}{chat.END}\n"
        assert [t[:2] for t in chat.turns_of(formatted * 2)] == [(text, text)] * 2


def forest(rng, n):
    rows = []
    for i in range(n):
        parent = rng.choice([None, i - 1, rng.randrange(i)]) if i else None
        rows.append((i, parent, rng.choice(["user", "assistant", None]), f"t{i} <|x|>", rng.choice([None, float("nan"), 1.0, 2.0, -3.0])))
    return rows


def plain_branches(rows):
    """tree, branch, path as message ids, of every leaf whose ancestors end."""
    known = {r[0]: r for r in sorted(rows, key=str, reverse=True) if r[0] is not None}
    parent = {i: r[1] if r[1] in known else None for i, r in known.items()}
    trees = defaultdict(list)
    for leaf in known.keys() - set(parent.values()):
        path, at = [], leaf
        while at is not None and len(path) <= len(known):
            path.append(at)
            at = parent[at]
        if at is None:
            score = sum(s if (s := known[i][4]) is not None and s == s else 0 for i in path) / len(path)
            trees[path[-1]].append((-score, leaf, path[::-1]))
    return sorted((tree, k + 1, path) for tree, leaves in trees.items() for k, (_, _, path) in enumerate(sorted(leaves)))


def test_reply_trees(spark):
    rng = random.Random(8)
    rows = forest(rng, 150) + [(1000, 999, "user", "orphan", 1.0), (1001, 1001, "user", "of itself", 1.0), (1002, 1003, "user", "circle", 1.0), (1003, 1002, "user", "circle", 1.0)]
    rows += [(1004, 1003, "user", "below a circle", 1.0), (None, 3, "user", "no id", 1.0), (7, 6, "user", "zz", 9.0)] + [(2000 + i, 2000, "user", "hot", float(i)) for i in range(1, 200)] + [(2000, None, "user", "root", 0.0)]
    rows = [r for r in rows if r[0] != 7] + [r for r in rows if r[0] == 7][:1] * 2
    df = spark.createDataFrame(rows, MESSAGES)
    linked = chat.links(chat.distinct_messages(df))
    for most in (None, 2):
        found = defaultdict(list)
        for r in chat.paths(linked, most).collect():
            found[r.tree, r.branch].append((r["at"], r.message_id))
        got = sorted((tree, branch, [m for _, m in sorted(path)]) for (tree, branch), path in found.items())
        assert got == [x for x in plain_branches(rows) if most is None or x[1] <= most]
    texts = {r[0]: r for r in rows}
    whole = chat.conversations_of(df, part_chars=60).collect()
    parts = defaultdict(dict)
    for r in whole:
        parts[r.tree, r.branch][r.part] = r
    assert max(map(len, parts.values())) > 1
    for tree, branch, path in plain_branches(rows):
        turns, loss = [], []
        for _, r in sorted(parts[tree, branch].items()):
            turns += [(a, b) for a, b, _, _ in chat.turns_of(r.formatted)]
            loss += [chat.unescaped(r.formatted[s.start : s.end]) for s in r.loss]
        assert turns == [(texts[i][2] or "", texts[i][3]) for i in path]
        assert loss == [texts[i][3] for i in path if texts[i][2] == "assistant"]


def test_long_path(spark):
    df = spark.createDataFrame([(i, i - 1 if i else None, "user", str(i), 0.0) for i in range(700)], MESSAGES)
    got = sorted((r["at"], r.message_id) for r in chat.paths(chat.links(df)).collect())
    assert got == [(i, i) for i in range(700)]
    assert chat.conversations_of(df.limit(0)).collect() == []


# trie


def plain_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    new = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        new[c] = own.get(c - c % 100, [])[:h] + v[h:]
    members, below = defaultdict(list), defaultdict(set)
    for c, v in new.items():
        for k in range(len(v) + 1):
            members[tuple(v[:k])].append(c)
            if k:
                below[tuple(v[: k - 1])].add(tuple(v[:k]))
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in below[p]) if below[p] else 1
        saved[p] = sum(saved[k] for k in below[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
        ends = ",".join(map(str, sorted(c for c in members[p] if len(new[c]) == len(p))))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below[p]), leaves[p], saved[p], digest([ends])))
    return sorted(out, key=str)


def trie_of(spark, rows, **bounds):
    df = spark.createDataFrame(rows, TURNS)
    for c in ("path", "sizes", "node", "shard", "base", "h", "turns"):
        df = df.withColumn(c, F.lit("x"))
    return sorted(map(tuple, trie.nodes(trie.rebuilt(trie.paths(df)), **bounds).collect()), key=str)


@pytest.mark.parametrize("bounds", [{}, {"shard": 5}, {"shard": 5, "most": 3, "pack": 2}, {"shard": 1, "pack": 1}])
def test_trie_is_the_plain_one(spark, bounds):
    rng = random.Random(str(bounds))
    rows = []
    for c in [*range(0, 260), *range(1000, 1100)]:
        if rng.random() < 0.9:
            rows += [(c, None if t == 0 and c % 7 == 0 else t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None]) if t < 3 else f"t{rng.randint(0, 3)}") for t in range(rng.choice([1, 2, 3, 5, 9]))]
    rows += [(c, t, "user", f"copy {t}") for c in range(5000, 5150) for t in range(7)] + [(c, t, "user", f"copy {t}") for c in (6000, 6001) for t in range(60)]
    rows += [(None, 0, "user", "x"), (77, 0, "user", "again"), (77, 0, "user", "again")]
    rows = [r for r in rows if r[0] != 77 or r[3] == "again"]
    assert trie_of(spark, rows, **bounds) == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert trie_of(spark, []) == []
    # a conversation whose base isn't there may be left without turns
    some = [(c, 0, "user", "x") for c in range(101, 130)]
    assert trie_of(spark, some) == plain_trie(some)


def test_skeleton_is_bounded():
    path = b"".join(bytes([i % 251]) * 16 for i in range(500))
    sample = [(path[: 16 * (i + 1)], i, [1] * (i + 1)) for i in range(500)]
    for most in (1, 10, 100, 1000):
        assert len(trie.skeleton(sample, 100, most).parent) - 1 <= most


# runs


def plain_runs(w, least=6, exponent=4):
    out = {}
    for q in range(1, len(w)):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                out.setdefault((i, j - i + q), q)
            i = max(i + 1, j)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def plain_report(doc_id, text):
    w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    n = len(w)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(w)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + k for s, k, q in found)]
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, digest(f"{s},{k},{q}\n" for s, k, q in found), digest([" ".join(kept)]))


def test_runs_are_the_plain_ones():
    rng = random.Random(1)
    for _ in range(1500):
        letters, w = "abcde"[: rng.choice([1, 2, 3, 5])], []
        while len(w) < rng.randint(1, 60):
            w += [rng.choice(letters) for _ in range(rng.randint(1, 6))] * rng.randint(1, 7)
        texts = [" ".join(w), " ".join(rng.choices("ab", k=rng.randint(0, 30))), "".join(f"{x}\n\t" for x in w)]
        data, offsets = utf8(pa.array(texts))
        for bounds in ((6, 4), (2, 2), (5, 3)):
            assert periodic.Texts(data, offsets, None, *bounds).runs == [plain_runs(t.split(), *bounds) for t in texts]


def test_runs_of_words_like_thue_and_morse_and_very_long_ones():
    bits = "".join("01"[bin(i).count("1") % 2] for i in range(1 << 13))
    data, offsets = utf8(pa.array([" ".join(bits), " ".join(str(i % 30_011) for i in range(200_000)), "x " * 100_000]))
    assert periodic.Texts(data, offsets).runs == [[], [(0, 200_000, 30_011)], [(0, 100_000, 1)]]


def test_runs_report(spark, sf_dir):
    rows = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet' where length(text) < 6000").fetchall()
    rows += [(None, "a a a a a a a"), (10**9, None), (10**9 + 1, ""), (10**9 + 2, " \n\t "), (-5, "x y " * 50), (-5, "x y " * 50), (-6, "été\x85a " * 9), (-7, "a\x1cb c " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("runs", "start", "period", "n_runs"):
        df = df.withColumn(c, F.lit("x"))
    got = sorted(map(tuple, periodic.report(df).collect()), key=str)
    assert got == sorted((plain_report(*r) for r in rows), key=str)
    assert periodic.report(df.limit(0)).collect() == []
    out = {r.doc_id: r for r in periodic.with_runs(df).collect()}
    assert [tuple(r) for r in out[-6].runs] == [(0, 9, 1)] and out[-6].collapsed == "été\x85a"

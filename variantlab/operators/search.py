"""Sequence search by shared or similar words of residues, alignment of a query with its hits, and folds by similarity."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from variantlab.functions.expr import RESIDUES, blosum
from variantlab.tables import components, written


def kmers(rows: DataFrame, name: str, sequence: str, k: int = 5) -> DataFrame:
    """The distinct words of k residues of each sequence; none of a shorter one."""
    n = F.length(sequence) - (k - 1)
    words = F.when(n >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(F.col(sequence), i, F.lit(k)))))
    return rows.select(name, F.explode(words).alias("word"))


def shared_words(queries: DataFrame, targets: DataFrame, name: str, sequence: str, k: int = 5, least: int = 2, most: int = 5000) -> DataFrame:
    """Query, target, n_shared and rank of each query's targets with at least `least` words in common, the best `most`.

    An equi-join on words: sequences never meet otherwise.  Ties go by the target's name.
    """
    a = kmers(queries, name, sequence, k).withColumnRenamed(name, "query")
    b = kmers(targets, name, sequence, k).withColumnRenamed(name, "target")
    counts = a.join(b, "word").where("query <> target").groupBy("query", "target").agg(F.count("*").alias("n_shared")).where(F.col("n_shared") >= least)
    order = Window.partitionBy("query").orderBy(F.desc("n_shared"), "target")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def aligned_pair(query: str, target: str, gap: float = 8.0) -> tuple[str, str, float]:
    """Needleman and Wunsch's alignment with BLOSUM62 and one cost per gap; other letters score -1."""
    place = {c: i for i, c in enumerate(RESIDUES)}
    table = np.full((21, 21), -1.0)
    table[:20, :20] = blosum()
    a = np.array([place.get(c, 20) for c in query.upper()], int)
    b = np.array([place.get(c, 20) for c in target.upper()], int)
    score = np.zeros((len(a) + 1, len(b) + 1))
    score[0], score[:, 0] = -gap * np.arange(len(b) + 1), -gap * np.arange(len(a) + 1)
    steps = gap * np.arange(len(b) + 1)
    for i in range(1, len(a) + 1):
        row = np.empty(len(b) + 1)
        row[0] = score[i, 0]
        row[1:] = np.maximum(score[i - 1, :-1] + table[a[i - 1], b], score[i - 1, 1:] - gap)
        score[i] = np.maximum.accumulate(row + steps) - steps  # gaps in the query
    i, j, left, right = len(a), len(b), [], []
    while i or j:
        if i and j and np.isclose(score[i, j], score[i - 1, j - 1] + table[a[i - 1], b[j - 1]]):
            i, j = i - 1, j - 1
            left.append(query[i])
            right.append(target[j])
        elif i and np.isclose(score[i, j], score[i - 1, j] - gap):
            i -= 1
            left.append(query[i])
            right.append("-")
        else:
            j -= 1
            left.append("-")
            right.append(target[j])
    return "".join(reversed(left)), "".join(reversed(right)), float(score[-1, -1])


def aligned_hits(pairs: DataFrame, query: str = "q_seq", target: str = "t_seq", gap: float = 8.0) -> DataFrame:
    """`pairs` with q_aln, t_aln and score; each pair by itself, so any number of hits of a query is spread."""
    schema = pairs.limit(0).schema.add("q_aln", "string").add("t_aln", "string").add("score", "double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [aligned_pair(q or "", t or "", gap) for q, t in zip(pdf[query], pdf[target])]
            yield pdf.assign(q_aln=[f[0] for f in found], t_aln=[f[1] for f in found], score=[f[2] for f in found])

    return pairs.mapInPandas(run, schema)


#: Clusters that are placed one by one.
LARGEST = 1000
#: Mean number of clusters of a slice of the others.
SLICE = 100_000


def similarity_folds(rows: DataFrame, name: str, sequence: str, k_folds: int, word: int = 5, least: int = 2) -> DataFrame:
    """X05, approximately: `fold` such that sequences which share words, directly or by others, are in one fold.

    Clusters go by the smallest name that shared words reach over any number of links.  The LARGEST
    clusters go first to the emptiest fold, larger ones first; the others, in order of a hash, fill up
    what the folds lack of an equal share, by a running total over slices.
    """
    links = shared_words(rows, rows, name, sequence, word, least, 1 << 30).select(F.col("query").alias("u"), F.col("target").alias("v"))
    reached = components(links).select(F.col("id").alias(name), F.col("component").alias("_c"))
    label = written(rows.select(name).distinct().join(reached, name, "left").select(name, F.coalesce("_c", name).alias("cluster")), "label")
    sizes = written(label.groupBy("cluster").agg(F.count("*").alias("n")), "sizes")
    clusters, total = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    load, fold = [0] * k_folds, []
    for r in sizes.orderBy(F.desc("n"), "cluster").limit(LARGEST).collect():
        at = min(range(k_folds), key=lambda i: load[i])
        load[at] += r.n
        fold.append((r.cluster, at))
    folds = rows.sparkSession.createDataFrame(fold, f"cluster {rows.schema[name].dataType.simpleString()}, fold int")
    if clusters > LARGEST:
        # the level to which the others fill the emptier folds
        up, rest = sorted(load), total - sum(load)
        level = min((rest + sum(up[:m])) / m for m in range(1, k_folds + 1))
        edges = [sum(max(0, level - load[j]) for j in range(i + 1)) for i in range(k_folds - 1)]
        h = F.xxhash64("cluster")
        sliced = sizes.join(folds, "cluster", "left_anti").select("cluster", "n", h.alias("_h"), F.pmod(h, F.lit(-(-clusters // SLICE))).alias("_s"))
        before = F.coalesce(F.sum("_n").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = sliced.groupBy("_s").agg(F.sum("n").alias("_n")).select("_s", before.alias("_before"))
        own = F.sum("n").over(Window.partitionBy("_s").orderBy("_h", "cluster").rowsBetween(Window.unboundedPreceding, 0))
        place = sliced.withColumn("_own", own).join(F.broadcast(starts), "_s").withColumn("_at", F.col("_before") + F.col("_own") - F.col("n") / 2)
        others = place.select("cluster", sum((F.when(F.col("_at") > e, 1).otherwise(0) for e in edges), F.lit(0)).cast("int").alias("fold"))
        folds = folds.union(others)
    return label.join(folds, "cluster")


# search by similar words

#: Places of a word on one side of a cell; a word with more on a side is cut into cells.
PLACES = 512
_BLOSUM = np.full((21, 21), -1, np.int32)
_BLOSUM[:20, :20] = blosum()
_CODES = np.full(256, 20, np.int64)
for _i, _c in enumerate(RESIDUES):
    _CODES[[ord(_c), ord(_c.lower())]] = _i


def coded(sequence: str | None) -> np.ndarray:
    """Numbers of residues; 20 for any other letter."""
    return _CODES[np.frombuffer((sequence or "").encode("latin-1", "replace"), np.uint8)]


@lru_cache(maxsize=1 << 17)
def similar(word: int, least: int, k: int) -> np.ndarray:
    """The words of k residues whose substitution score with `word` is at least `least`."""
    digits = [word // 20**i % 20 for i in reversed(range(k))]
    rest = np.cumsum([0, *[int(_BLOSUM[d].max()) for d in reversed(digits)]])[::-1]
    codes, scores = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for i, d in enumerate(digits):
        codes, scores = (codes[:, None] * 20 + np.arange(20)).ravel(), (scores[:, None] + _BLOSUM[d, :20]).ravel()
        live = scores + rest[i + 1] >= least
        codes, scores = codes[live], scores[live]
    return codes


def _places(rows: DataFrame, name: str, sequence: str, k: int, least: int | None) -> DataFrame:
    """word, id and pos of every word of k residues, or of all words similar to it."""
    kind = rows.schema[name].dataType
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, sequence in enumerate(batch.column("s").to_pylist()):
                c = coded(sequence)
                if len(c) < k:
                    continue
                windows = np.lib.stride_tricks.sliding_window_view(c, k)
                pos = np.flatnonzero((windows < 20).all(1))
                word = windows[pos] @ 20 ** np.arange(k)[::-1]
                if least is not None:
                    near = [similar(int(w), least, k) for w in word]
                    pos, word = np.repeat(pos, [len(x) for x in near]), np.concatenate(near) if near else word
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array([batch.column("id")[i].as_py()] * len(word), arrow), pa.array(pos.astype(np.int32))], ["word", "id", "pos"])

    own = rows.where(F.col(name).isNotNull()).select(F.col(name).alias("id"), F.col(sequence).alias("s"))
    return own.mapInArrow(run, f"word long, id {kind.simpleString()}, pos int")


def _met(batches: Iterator[pa.RecordBatch], arrow: pa.DataType) -> Iterator[pa.RecordBatch]:
    """query, target, diagonal and number of meetings in the cells of a task, which are summed up until they are many."""
    found: Counter = Counter()
    cell, sides = None, ([], [])

    def meet() -> None:
        for q, a in sides[0]:
            for t, b in sides[1]:
                if q != t:
                    found[q, t, b - a] += 1

    def batch_of() -> pa.RecordBatch:
        q, t, d = zip(*found) if found else ((), (), ())
        out = pa.RecordBatch.from_arrays([pa.array(q, arrow), pa.array(t, arrow), pa.array(d, pa.int32()), pa.array(list(found.values()), pa.int64())], ["query", "target", "diagonal", "n"])
        found.clear()
        return out

    for batch in batches:
        for c, side, i, pos in zip(*(batch.column(x).to_pylist() for x in ("cell", "side", "id", "pos"))):
            if c != cell:
                meet()
                cell, sides = c, ([], [])
                if len(found) > 500_000:
                    yield batch_of()
            sides[side].append((i, pos))
    meet()
    yield batch_of()


def diagonals(queries: DataFrame, targets: DataFrame, name: str, sequence: str, k: int = 5, least: int = 19) -> DataFrame:
    """query, target, diagonal (place in the target less that in the query) and n, the similar words that they share on it.

    Words meet by an equi-join.  A word with over PLACES places on a side is cut into cells of two
    blocks; its places are rows, its pairs are made and summed up inside a task.
    """
    q, t = written(_places(queries, name, sequence, k, least), "words"), written(_places(targets, name, sequence, k, None), "words")
    sizes = q.groupBy("word").agg(F.count("*").alias("nq")).join(t.groupBy("word").agg(F.count("*").alias("nt")), "word")
    sizes = written(sizes.select("word", F.ceil(F.col("nq") / PLACES).cast("int").alias("bq"), F.ceil(F.col("nt") / PLACES).cast("int").alias("bt")), "words")
    plain, hot = sizes.where("bq = 1 and bt = 1").select("word"), sizes.where("bq > 1 or bt > 1")
    a = q.join(plain, "word").select("word", F.col("id").alias("query"), F.col("pos").alias("_a"))
    b = t.select("word", F.col("id").alias("target"), F.col("pos").alias("_b"))
    met = a.join(b, "word").where("query <> target").groupBy("query", "target", (F.col("_b") - F.col("_a")).alias("diagonal")).agg(F.count("*").alias("n"))
    cut = []
    for side, rows, own, other in ((0, q, "bq", "bt"), (1, t, "bt", "bq")):
        block = F.pmod(F.xxhash64("id", "pos"), F.col(own)).cast("int")
        both = rows.join(hot, "word").select("word", "id", "pos", block.alias("_own"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("_other"))
        place = F.xxhash64("word", *(("_own", "_other") if side == 0 else ("_other", "_own")))
        cut.append(both.select(place.alias("cell"), F.lit(side).alias("side"), "id", "pos"))
    kind = queries.schema[name].dataType
    arrow = to_arrow_type(kind)
    cells = cut[0].union(cut[1]).repartition("cell").sortWithinPartitions("cell", "side")
    inside = cells.mapInArrow(lambda x: _met(x, arrow), f"query {kind.simpleString()}, target {kind.simpleString()}, diagonal int, n long")
    return met.union(inside).groupBy("query", "target", "diagonal").agg(F.sum("n").alias("n"))


def ungapped(a: np.ndarray, b: np.ndarray, diagonal: int) -> int:
    """The best score of a stretch on a diagonal."""
    low, high = max(0, -diagonal), min(len(a), len(b) - diagonal)
    if low >= high:
        return 0
    up = np.concatenate([[0], np.cumsum(_BLOSUM[a[low:high], b[low + diagonal : high + diagonal]])])
    return int((up - np.minimum.accumulate(up)).max())


def banded(a: np.ndarray, b: np.ndarray, diagonal: int, band: int, gap: int = 8) -> int:
    """The best score of a local alignment that leaves the diagonal by `band` places at most, with one cost per gap."""
    off = np.arange(-band, band + 1)
    scores, steps, best = np.zeros(len(off) + 1, np.int64), gap * np.arange(len(off)), 0
    for i, c in enumerate(a):
        j = i + diagonal + off
        ok = (j >= 0) & (j < len(b))
        pair = np.where(ok, _BLOSUM[c, b[np.clip(j, 0, len(b) - 1)]], 0)
        row = np.where(ok, np.maximum(np.maximum(scores[:-1] + pair, scores[1:] - gap), 0), 0)
        row = np.where(ok, np.maximum.accumulate(row + steps) - steps, 0)
        scores[:-1] = row
        best = max(best, int(row.max(initial=0)))
    return best


def scored_hits(queries: DataFrame, targets: DataFrame, name: str, sequence: str, k: int = 5, least: int = 19, words: int = 2, extension: int = 30, band: int = 24, score: int = 40, most: int = 5000) -> DataFrame:
    """Query, target, diagonal, score and rank of the best `most` targets of each query.

    Pairs that share at least `words` similar words on a diagonal are extended along the best of those
    without gaps, and where that scores `extension`, aligned within a band around it; hits score at least
    `score`.  Ties go by the target's name; a sequence is no hit of itself.  Names must not repeat; rows
    without a name are left out, and residues that aren't one of the twenty are in no word.
    """
    best = F.max_by("diagonal", F.struct("n", -F.abs("diagonal"), "diagonal"))
    pairs = diagonals(queries, targets, name, sequence, k, least).where(F.col("n") >= words).groupBy("query", "target").agg(best.alias("diagonal"))
    rows = pairs.join(queries.select(F.col(name).alias("query"), F.col(sequence).alias("_q")), "query").join(targets.select(F.col(name).alias("target"), F.col(sequence).alias("_t")), "target")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for q, t, d in zip(*(batch.column(c).to_pylist() for c in ("_q", "_t", "diagonal"))):
                a, b = coded(q), coded(t)
                found.append(banded(a, b, d, band) if ungapped(a, b, d) >= extension else 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("query", "target", "diagonal")), pa.array(found, pa.int64())], ["query", "target", "diagonal", "score"])

    kind = queries.schema[name].dataType.simpleString()
    out = rows.mapInArrow(run, f"query {kind}, target {kind}, diagonal int, score long").where(F.col("score") >= score)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "target")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)

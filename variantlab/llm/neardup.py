"""Near-duplicate texts by improved consistent weighted sampling (Ioffe 2010) over TF-IDF shingles.

A shingle is five consecutive words, a word `[^\\x20\\x09-\\x0D]+`; a shorter text with words has one
shingle, all of it.  Its weight is its count in the text times its idf, 1 + ln(min(N / df, R)) / ln(R):
between 1 for a shingle of all texts and 2 for one of at most N / R texts.  Two texts are linked if
their weighted Jaccard similarity, the sum of the smaller weights over that of the larger, is 0.8 or more.

1. Frequent shingles, those of at least one in R texts: blocks of texts count what at least one in 2R
   of their texts has; what a block leaves out is less than half of what is needed, so shingles whose
   counts sum up to one in 2R of all texts are the candidates, and a second scan counts those exactly.
   There are at most 2R times the mean number of shingles of a text, whatever the number of texts, so
   the candidates may be broadcast.
2. Each text gets `bands * rows` consistent samples.  Equal texts become one class.
3. Classes that agree in a band meet in cells of bounded size and compare samples; those whose
   samples agree in half or more are connected to clusters, which are small or true families.
4. Each cluster is verified: weights of all pairs are compared exactly, in cells of bounded size.
   A cell sends one row for each linked text, never pairs.  Connected components are the groups.

Null and empty texts have no shingles and link with nothing.  Rows that share a doc_id are one
document, and rows without doc_id link with nothing.  An empty table gives an empty result.  Extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variantlab.llm.arrays import Words, chunks, counted, mix, runs, utf8
from variantlab.llm.common import by_cell, components, dealt, in_blocks, roots, written

#: Words of a shingle; least similarity; R of the idf; bands and samples in each; share of agreeing samples.
SHINGLE, SIMILAR, RATIO, BANDS, ROWS, PLAUSIBLE = 5, 0.8, 100, 10, 3, 0.5
#: Texts of a block when candidates for frequent shingles are named, and of a cell's side when compared.
BLOCK_SHINGLES, COMPARED, VERIFIED = 2_000_000, 1024, 512


def shingled(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of texts, their text and count."""
    words = Words(data, offsets)
    return counted(*runs(words.value, words.first, SHINGLE))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int]]:
    """Shingles (each once for each text) and number of texts, of successive blocks of texts."""
    held, size, texts = [], 0, 0
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        for a, b in chunks(offsets):
            values, _, _ = shingled(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            held.append(values)
            size, texts = size + len(values), texts + b - a
            if size >= BLOCK_SHINGLES:
                yield np.concatenate(held), texts
                held, size, texts = [], 0, 0
    if held:
        yield np.concatenate(held), texts


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, n: the shingles of each block that at least one in 2 * RATIO of its texts has."""
    for values, texts in _blocks(batches):
        found, n = np.unique(values, return_counts=True)
        keep = n * 2 * RATIO >= texts
        yield pa.RecordBatch.from_arrays([pa.array(found[keep].view(np.int64)), pa.array(n[keep].astype(np.int64))], ["h", "n"])


def frequent(docs: DataFrame, texts: int) -> dict[str, np.ndarray]:
    """Shingles that at least one in RATIO texts has, sorted, and their numbers of texts."""
    only = docs.select("text")
    named = only.mapInArrow(_named, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") * 2 * RATIO >= texts)
    wanted = np.sort(named.select("h").toArrow().column(0).to_numpy().view(np.uint64))
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value
        total = np.zeros(len(names), np.int64)
        for values, _ in _blocks(batches):
            if len(names):
                at = np.searchsorted(names, values)
                at[at == len(names)] = 0
                total += np.bincount(at[names[at] == values], minlength=len(names))
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(names[has].view(np.int64)), pa.array(total[has])], ["h", "n"])

    exact = only.mapInArrow(counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rows = exact.where(F.col("n") * RATIO >= texts).toArrow()
    h, n = rows.column("h").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(h)
    return {"h": h[order], "n": n[order], "texts": texts}


def idf(values: np.ndarray, known: dict) -> np.ndarray:
    """The idf of shingles, by the table of frequent ones."""
    out = np.full(len(values), 2.0 if known["texts"] >= RATIO else 1 + math.log(max(known["texts"], 1)) / math.log(RATIO))
    if len(known["h"]):
        at = np.searchsorted(known["h"], values)
        at[at == len(known["h"])] = 0
        hit = known["h"][at] == values
        share = known["texts"] / known["n"][at[hit]]
        out[hit] = 1 + np.log(np.clip(share, 1, RATIO)) / math.log(RATIO)
    return out


def samples(values: np.ndarray, weights: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Sample k of each text: the shingle and level that consistent weighted sampling picks, as 64 bits.

    first: offsets of the texts, none of them empty.
    """
    one, two = mix(values + np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 % 2**64)), mix(values ^ np.uint64((2 * k + 2) * 0xC2B2AE3D27D4EB4F % 2**64))
    unit = lambda z, shift, bits: (((z >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-bits)
    r = -np.log(unit(one, 0, 22) * unit(one, 22, 22))
    ln_c = np.log(-np.log(unit(two, 0, 24) * unit(two, 24, 24)))
    level = np.floor(np.log(weights.astype(np.float32)) / r + unit(one, 44, 20))
    ln_a = ln_c - r * (level - unit(one, 44, 20)) - r
    low = np.minimum.reduceat(ln_a, first[:-1])
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    hits = np.flatnonzero(ln_a == low[text])
    at = hits[np.unique(text[hits], return_index=True)[1]]
    return mix(values[at] + level[at].astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def signed(docs: DataFrame, known: dict, bands: int, rows: int) -> DataFrame:
    """doc_id, key (equal for equal word sequences), bands (array of long), sample (32 bits each, bytes); texts without words are left out."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in chunks(offsets):
                values, text, n = shingled(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                own, first = np.unique(text, return_index=True)
                if not len(own):
                    continue
                first = np.append(first, len(text))
                weights = n * idf(values, table)
                all_ = np.stack([samples(values, weights, first, k) for k in range(bands * rows)], axis=1)
                keys = [hashlib.blake2b(values[x:y].tobytes() + n[x:y].tobytes(), digest_size=16).digest() for x, y in zip(first, first[1:])]
                joined = np.zeros((len(own), bands), np.uint64)
                for j in range(rows):
                    joined = mix(joined * np.uint64(3) + all_[:, j::rows])
                low = (all_ >> np.uint64(32)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a).take(pa.array(own)),
                        pa.array(keys, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, joined.size + 1, bands), pa.int32()), pa.array(joined.view(np.int64).reshape(-1))),
                        pa.array([x.tobytes() for x in low], pa.binary()),
                    ],
                    ["doc_id", "key", "bands", "sample"],
                )

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, key binary, bands array<long>, sample binary")


def _edges(ids: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(low.astype(np.int64))], ["u", "v"])


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of a cell's two sides, the same for a cell of one block."""
    side = table.column("side").to_numpy()
    return (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if (side >= 0).all() else (np.arange(len(side)), np.arange(len(side)))


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Connects the members of a cell whose samples agree often enough."""
    for table in by_cell(batches):
        ids = table.column("rep").to_numpy()
        raw = b"".join(table.column("sample").to_pylist())
        sample = np.frombuffer(raw, np.uint32).reshape(len(ids), -1)
        a, b = _sides(table)
        same = np.zeros((len(a), len(b)), np.uint8)
        for k in range(sample.shape[1]):
            same += sample[a, k][:, None] == sample[b, k][None, :]
        near = (same >= PLAUSIBLE * sample.shape[1]) & (ids[a][:, None] != ids[b][None, :])
        if near.any():
            yield _edges(*roots(near, ids[a], ids[b]))


def similarity(values: list[np.ndarray], weights: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weighted Jaccard of texts a with texts b.  A weight is split into one of each occurrence, so sums of smaller weights are sums over common elements."""
    total = np.array([w.sum() for w in weights])
    flat, text, weight = np.concatenate(values), np.repeat(np.arange(len(values)), [len(v) for v in values]), np.concatenate(weights)
    names, at, n = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.cumsum(n > 1) - 1
    use = n[at] > 1
    text, at, weight = text[use], column[at[use]], weight[use]
    order = np.argsort(at, kind="stable")
    text, at, weight = text[order], at[order], weight[order]
    common = np.zeros((len(a), len(b)))
    width = max(64, (1 << 21) // len(values))
    for x in range(0, int((n > 1).sum()), width):
        i, j = np.searchsorted(at, [x, x + width])
        has = np.zeros((len(values), width))
        has[text[i:j], at[i:j] - x] = 1
        each = np.zeros(width)
        each[at[i:j] - x] = weight[i:j]
        common += (has[a] * each) @ has[b].T
    return common / np.maximum(total[a][:, None] + total[b][None, :] - common, 1e-300)


def elements(text: pa.Array, table: dict) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each text its (shingle, occurrence) elements and their idf."""
    values, weights = [], []
    data, offsets = utf8(text)
    for a, b in chunks(offsets):
        v, t, n = shingled(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        w = idf(v, table)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        v, t, w = np.repeat(v, n), np.repeat(t, n), np.repeat(w, n)
        v = np.where(nth > 0, mix(v + nth.astype(np.uint64)), v)
        cuts = np.searchsorted(t, np.arange(b - a + 1))
        values += [v[x:y] for x, y in zip(cuts, cuts[1:])]
        weights += [w[x:y] for x, y in zip(cuts, cuts[1:])]
    return values, weights


def near_duplicates(docs: DataFrame, similar: float = SIMILAR, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, component_id (the smallest doc_id reachable by links), kept (doc_id = component_id), one row per row of `docs`."""
    texts = docs.count()
    known = frequent(docs, texts)
    all_signed = written(signed(docs, known, bands, rows), "signed")
    classes = all_signed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sample").alias("sample"))
    classes = written(classes, "classes")

    banded = classes.select("rep", F.posexplode("bands").alias("band", "value"))
    cells = in_blocks(banded, ["band", "value"], "rep", COMPARED)
    compared = dealt(cells.join(classes.select("rep", "sample"), "rep")).mapInArrow(_plausible, "u long, v long")
    clusters = written(components(compared), "clusters")

    shared = docs.sparkSession.sparkContext.broadcast(known)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_cell(batches):
            ids = table.column("rep").to_numpy()
            a, b = _sides(table)
            near = similarity(*elements(table.column("text").combine_chunks(), shared.value), a, b) >= similar - 1e-9
            near &= ids[a][:, None] != ids[b][None, :]
            if near.any():
                yield _edges(*roots(near, ids[a], ids[b]))

    members = in_blocks(clusters.select(F.col("id").alias("rep"), F.col("component").alias("cluster")), ["cluster"], "rep", VERIFIED)
    own = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").where("rep is not null")
    linked = components(dealt(members.hint("merge").join(own, "rep")).mapInArrow(verify, "u long, v long"))

    named = all_signed.select("doc_id", "key").join(classes.select("key", "rep"), "key", "left")
    named = named.join(linked.withColumnRenamed("id", "rep"), "rep", "left")
    ids = named.groupBy("doc_id").agg(F.min(F.coalesce("component", "rep", "doc_id")).alias("component_id"))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(ids, "doc_id", "left")
    group = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", group.alias("component_id"), F.coalesce(F.col("doc_id") == group, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each group, the one with the smallest doc_id, in the columns of `docs`."""
    found = written(near_duplicates(docs), "found")
    gone = found.where("not kept").select("doc_id").distinct()
    out = docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    ids = found.where("doc_id is not null").agg(F.count("*"), F.countDistinct("doc_id")).first()
    return out if ids[0] == ids[1] else out.where("doc_id is not null").dropDuplicates(["doc_id"]).union(out.where("doc_id is null"))

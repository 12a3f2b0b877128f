"""Toxicity by multiple-instance learning: only documents have labels, sentences get the scores.

A sentence's probability is logistic in the sum of its words' weights; a document's is the noisy-or
of its sentences.  Weights are trained from document labels by gradient steps on the documents'
likelihood, on a sample of at most LABELLED labelled rows (those first in the order of a hash of
doc_id).  A word is a run of ASCII letters and digits and of non-ASCII characters, in ASCII lower
case; its features are the word and its first four and five bytes, hashed to 2**BITS weights; only
those that are significantly more frequent in toxic documents are trained.

Null and empty texts have no sentences and score 0.  Every row is scored by itself, repeated rows and
rows without doc_id alike, in linear time for very long texts; nothing is shuffled.  With no labelled
rows all scores are those of the start weights; labels whose `toxic` is null aren't learnt from, and
those without doc_id belong to no document.  An empty table gives an empty result; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variantlab.llm.arrays import Words, chunks, utf8

#: Labelled rows that training takes at most; bits of a feature; least documents of a feature in
#: training, and standard deviations by which toxic ones among them exceed their share.
LABELLED, BITS, SEEN, SIGNIFICANT = 6000, 20, 3, 4.0
#: Score from which a document counts as toxic, and a sentence as offending.
TOXIC = 0.3
START = -5.0

_APART = np.ones(256, bool)
_APART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?\n")] = True


@dataclass
class Features:
    """Features of the words of some texts: index [3, words], sentence of each word, first sentence of each text, span of sentences in code points."""

    index: np.ndarray
    sentence: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray


def features(data: np.ndarray, offsets: np.ndarray) -> Features:
    w = Words(_LOWER[data], offsets, _APART)
    n = len(w.start)
    ends = np.concatenate([[0], np.cumsum(_ENDS[data])])
    new = np.zeros(n + 1, bool)
    new[w.first] = True
    if n:
        new[1:n] |= ends[w.start[1:]] > ends[w.end[:-1]]
    new[n] = True
    word = np.flatnonzero(new)
    values = np.stack([w.value, w.span(w.start, np.minimum(w.start + 4, w.end)) + np.uint64(1), w.span(w.start, np.minimum(w.start + 5, w.end)) + np.uint64(2)])
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    first = np.searchsorted(word, w.first)
    own = np.searchsorted(w.first, word[:-1], "right") - 1
    base = points[offsets[own]]
    return Features((values >> np.uint64(64 - BITS)).astype(np.int32), np.cumsum(new[:n]) - 1, first, points[w.start[word[:-1]]] - base, points[w.end[word[1:] - 1]] - base)


def sentence_scores(f: Features, weights: np.ndarray, bias: float) -> np.ndarray:
    z = np.bincount(f.sentence, weights[f.index].sum(0), len(f.start)) + bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def document_scores(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Noisy-or of each document's sentences."""
    out, some = np.zeros(len(first) - 1), np.flatnonzero(first[1:] > first[:-1])
    if len(some):  # each document's own sum, so that its neighbours don't change its last digits
        out[some] = -np.expm1(np.add.reduceat(np.log1p(-np.minimum(p[: first[-1]], 1 - 1e-12)), first[some]))
    return np.clip(out, 0.0, 1.0)


def train(texts: list[str], labels: list[int], epochs: int = 60, rate: float = 0.15, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias from documents and their labels."""
    weights = np.zeros(1 << BITS)
    if not texts:
        return weights, START
    toxic = np.asarray(labels, bool)
    share = toxic.mean()
    parts, n, k = [], np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    data, offsets = utf8(pa.array(texts, pa.string()))
    for a, b in chunks(offsets):
        f = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        own = np.searchsorted(f.first, f.sentence, "right") - 1
        pairs = np.unique(own.astype(np.int64)[None, :] << BITS | f.index)
        n += np.bincount(pairs & (1 << BITS) - 1, minlength=1 << BITS)
        k += np.bincount(pairs[toxic[a:b][pairs >> BITS]] & (1 << BITS) - 1, minlength=1 << BITS)
        parts.append((f.index, f.sentence.astype(np.int32), f.first))
    # a feature is used if toxic documents have it more often than chance would explain
    known = np.flatnonzero((n >= SEEN) & (k - n * share > SIGNIFICANT * np.sqrt(n * share * (1 - share) + 0.25)))
    place = np.full(1 << BITS, -1, np.int32)
    place[known] = np.arange(len(known))
    at, to, first = [], [], [np.zeros(1, np.int64)]
    for index, sentence, starts in parts:
        own = place[index]
        use = own >= 0
        at.append(own[use])
        to.append(np.broadcast_to(sentence, index.shape)[use] + first[-1][-1])
        first.append(starts[1:] + first[-1][-1])
    del parts
    at, to, first = np.concatenate(at), np.concatenate(to), np.concatenate(first)
    sentences = int(first[-1])
    document = np.searchsorted(first, np.arange(sentences), "right") - 1
    y = np.asarray(labels, float)[document]
    w, bias = np.zeros(len(known)), START
    m, v = np.zeros(len(known) + 1), np.zeros(len(known) + 1)
    for step in range(1, epochs + 1):
        z = np.bincount(to, w[at], sentences) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        whole = document_scores(p, first)[document]
        slope = np.where(y > 0, -p * (1 - whole) / np.maximum(whole, 1e-9), p)
        grad = np.append(np.bincount(at, slope[to], len(known)), slope.sum()) / len(texts)
        grad[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        w, bias = w - move[:-1], bias - move[-1]
    weights[known] = w
    return weights, float(bias)


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def fitted(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> tuple[np.ndarray, float]:
    """A model from at most `most` labelled rows that aren't held out."""
    own = labels.where("toxic is not null").where(~held_out()).select("doc_id", "toxic")
    own = own.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id", "toxic").limit(most)
    # a doc_id that repeats brings all its rows: the bound holds for the joined rows again
    rows = docs.select("doc_id", "text").join(own, "doc_id").orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id", "text", "toxic").limit(most).select("text", "toxic").toArrow()
    return train([x or "" for x in rows.column("text").to_pylist()], rows.column("toxic").to_pylist())


def scored(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """`doc_id, score, offending` of every row; offending: spans (code points) and scores of sentences from TOXIC on."""
    shared = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            scores, spans = np.zeros(batch.num_rows), []
            for a, b in chunks(offsets):
                f = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                p = sentence_scores(f, weights, bias)
                scores[a:b] = document_scores(p, f.first)
                bad = np.flatnonzero(p >= TOXIC)
                cuts = np.searchsorted(bad, f.first)
                spans += [[{"start": f.start[i], "end": f.end[i], "score": p[i]} for i in bad[x:y]] for x, y in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array(spans, pa.list_(span))], ["doc_id", "score", "offending"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, offending array<struct<start:long,end:long,score:double>>")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_offending, and `offending`: the located sentences as start:end in code points, comma-joined."""
    out = scored(docs, fitted(docs, labels))
    spans = F.array_join(F.transform("offending", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), F.size("offending").cast("long").alias("n_offending"), spans.alias("offending"))

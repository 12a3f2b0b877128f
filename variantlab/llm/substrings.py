"""Repeated passages: hash every run of several consecutive sentences, join the hashes over all documents,
and remove the sentences that any non-first occurrence of a repeated run covers.

A sentence ends with a word that ends in `.`, `!` or `?` (quotes and brackets may follow), at a line
feed, or with the text.  Sentences of up to WINDOW words are never cut.  Since a passage may lie inside
one long sentence, or begin and end inside two, a longer one is cut further: of every WINDOW
neighbouring pairs of words in a text the one of the least hash is a cut, and where one of them ends a
sentence, that is its cut.  So copies are cut alike wherever they stand, and no part is longer than
WINDOW words.  From each sentence a run takes the fewest sentences that are at least SENTENCES and
have at least WORDS words, and to each sentence's end the fewest before it; white space does not
count.  Of words that two places share in a row and that lines break alike, at least
WORDS + 2 * WINDOW, all but at most WINDOW at either end are in common runs.  First is the occurrence
in the smallest doc_id, and there the earliest.  Runs are compared by 96-bit values.

Texts are scanned once for runs.  A block of texts settles among its own: of a run that several of its
documents have, all but those of the smallest doc_id are no first occurrence anywhere, and only that
one goes to the others.  So a passage that a third of all documents share makes a row for each block
that has it and not for each document, and no task gets all of them.

Null and empty texts have no sentences; a text too short for a run keeps all.  Rows that share a
doc_id are one document, so neither is the other's repeat; rows without doc_id keep all.  Very long
texts are cut in linear time.  An empty table gives an empty result.  Columns of any name are kept,
but for one named like the result, s_removed, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from variantlab.llm.arrays import Words, chunks, mix, utf8

#: Fewest sentences and words of a run.
SENTENCES, WORDS = 2, 20
#: Neighbouring pairs of words of which one is a cut, so the most words of a part.
WINDOW = 8
#: Runs of a block, whose texts settle among their own what isn't first.
BLOCK = 2_000_000

_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?")] = True
_CLOSES = np.zeros(256, bool)
_CLOSES[list(b"\"')]")] = True
#: Runs are polynomials in their words' values, by one base for 64 bits and by another for 32 more.
_BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)


def _least(pair: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """Whether a pair (of words i and i + 1) is the least, or the last of equal ones, of some `window` neighbours in one text."""
    out = np.zeros(len(pair), bool)
    if len(pair) < window:
        return out
    size = np.diff(first)
    most = np.repeat(first[1:], size)[: len(pair)] - 1  # pairs from here on aren't in the text of word i
    starts = np.flatnonzero(np.arange(len(pair)) + window <= most)
    best, value = starts.copy(), pair[starts]
    for k in range(1, window):
        other = pair[starts + k]
        less = other <= value
        best[less] = starts[less] + k
        value = np.minimum(value, other)
    out[best] = True
    return out


class Sentences:
    """Sentences of some texts: `word` is the first word of each (and the end), `first` the first sentence of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> None:
        self.words = w = Words(data, offsets)
        n = len(w.start)
        self.value = np.empty(0, np.uint64)
        last = np.where(_CLOSES[data[w.end - 1]] & (w.end - w.start > 1), w.end - 2, w.end - 1) if n else w.end
        closing = _ENDS[data[last]] if n else np.zeros(0, bool)
        lines = np.concatenate([[0], np.cumsum(data == 10)])
        starts = np.zeros(n + 1, bool)
        starts[w.first] = True
        if n:
            self.value = w.value
            cut = np.zeros(n, bool)
            pair = mix(self.value[:-1] * np.uint64(3) + self.value[1:])
            pair[closing[:-1]] = 0
            cut[1:] = _least(pair, w.first, window)
            cut[w.first[:-1][np.diff(w.first) > 0]] = False
            # a cut stands before its pair's second word
            starts[1:n] |= closing[:-1] | cut[1:] | (lines[w.start[1:]] > lines[w.end[:-1]])
        starts[n] = True
        self.word = np.flatnonzero(starts)
        self.first = np.searchsorted(self.word, w.first)

    def runs(self, sentences: int = SENTENCES, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Two values, text, first sentence in the text and number of sentences of every run."""
        count = np.diff(self.first)
        text = np.repeat(np.arange(len(count)), count)
        at = np.arange(len(text))
        end = np.maximum(at + sentences, np.searchsorted(self.word, self.word[:-1][at] + words))
        fits = end <= self.first[1:][text]
        stop = at + 1  # of each sentence, where also the shortest run before it ends
        start = np.minimum(stop - sentences, np.searchsorted(self.word, self.word[stop] - words, "right") - 1)
        more = start >= self.first[:-1][text]
        more[more] = end[start[more]] != stop[more]  # else it is a run from its start as well
        at, end, text = np.concatenate([at[fits], start[more]]), np.concatenate([end[fits], stop[more]]), np.concatenate([text[fits], text[more]])
        a, b = self.word[at], self.word[end]
        out, n = [], len(self.value)
        for k, base in enumerate(_BASES):
            up, down = np.ones(n + 1, np.uint64), np.ones(n + 1, np.uint64)
            up[1:], down[1:] = np.cumprod(np.full(n, base, np.uint64)), np.cumprod(np.full(n, pow(base, -1, 1 << 64), np.uint64))
            value = mix(self.value + np.uint64(1)) if k else self.value
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * up[:n], dtype=np.uint64)])
            out.append(mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)))
        return out[0], (out[1] >> np.uint64(32)).astype(np.uint32), text, at - self.first[text], end - at


def _settled(h: np.ndarray, h2: np.ndarray, doc: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Occurrences of a block that are surely not first: an equal run stands before them in their text, or in a smaller doc_id."""
    out = np.zeros(len(h), bool)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twin = np.zeros(len(h), bool)
    twin[1:] |= same
    twin[:-1] |= same
    some = order[twin]  # all others are alone with their value
    some = some[np.lexsort((at[some], row[some], doc[some], h2[some], h[some]))]
    if len(some):
        new = np.ones(len(some), bool)
        new[1:] = (h[some][1:] != h[some][:-1]) | (h2[some][1:] != h2[some][:-1])
        low = doc[some][np.flatnonzero(new)][np.cumsum(new) - 1]
        later = np.zeros(len(some), bool)
        later[1:] = ~new[1:] & (row[some][1:] == row[some][:-1])
        out[some] = later | (doc[some] > low)
    return out


def _merged(doc: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of sentences of documents, those that touch or overlap as one."""
    order = np.lexsort((at, doc))
    doc, at, n = doc[order], at[order], n[order]
    number = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    far = int((at + n).max(initial=0)) + 2
    start, reach = number * far + at, np.maximum.accumulate(number * far + at + n)
    new = np.ones(len(doc), bool)
    new[1:] = start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1 if len(doc) else first
    return doc[first], at[first], reach[last] - number[first] * far - at[first]


def _occurrences(batches: Iterator[pa.RecordBatch], sentences: int, words: int, window: int) -> Iterator[pa.RecordBatch]:
    """h, h2, doc_id, at (first sentence and number of sentences); h2 is null where that span surely goes."""
    held: list[tuple] = []
    size = rows = 0

    def block() -> pa.RecordBatch:
        h, h2, doc, row, at, n = (np.concatenate(c) for c in zip(*held))
        gone = _settled(h, h2, doc, row, at)
        d, a, k = _merged(doc[gone], at[gone], n[gone])
        stays = ~gone
        columns = [
            pa.array(np.concatenate([h[stays].view(np.int64), d])),
            pa.concat_arrays([pa.array(h2[stays].view(np.int32)), pa.nulls(len(d), pa.int32())]),
            pa.array(np.concatenate([doc[stays], d])),
            pa.array(np.concatenate([at[stays] << 32 | n[stays], a << 32 | k])),
        ]
        return pa.RecordBatch.from_arrays(columns, ["h", "h2", "doc_id", "at"])

    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        ids = batch.column("doc_id").to_numpy()
        for a, b in chunks(offsets):
            h, h2, text, at, n = Sentences(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], window).runs(sentences, words)
            held.append((h, h2, ids[a:b][text], text + rows, at, n))
            size, rows = size + len(h), rows + b - a
            if size >= BLOCK:
                yield block()
                held, size = [], 0
    if held:
        yield block()


def repeated(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS, window: int = WINDOW) -> DataFrame:
    """doc_id and `spans` (array of long: first sentence << 32 | number of sentences, of which a text has fewer than 2**31) of documents with non-first repeated runs."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    occurrences = rows.mapInArrow(lambda x: _occurrences(x, sentences, words, window), "h long, h2 int, doc_id long, at long")
    low = F.first("doc_id").over(Window.partitionBy("h", "h2").orderBy("doc_id"))
    found = occurrences.withColumn("low", low).where("h2 is null or doc_id > low")
    return found.groupBy("doc_id").agg(F.collect_set("at").alias("spans"))


def cut(text: str, spans: list[int], window: int = WINDOW) -> tuple[str, int]:
    """The text without the sentences that spans cover, and how many those are."""
    data = np.frombuffer(text.encode(), np.uint8)
    found = Sentences(data, np.array([0, len(data)]), window)
    n = len(found.word) - 1
    steps = np.zeros(n + 1, np.int64)
    for span in spans:
        if span >> 32 < n:
            steps[span >> 32] += 1
            steps[min(n, (span >> 32) + (span & 0xFFFFFFFF))] -= 1
    gone = np.cumsum(steps[:n]) > 0
    if not gone.any():
        return text, 0
    edges = np.append(found.words.start[found.word[:-1]], len(data))
    keep = np.ones(len(data), bool)
    for i in np.flatnonzero(gone):
        keep[edges[i] : edges[i + 1]] = False
    return data[keep].tobytes().decode().rstrip(" \t\n\v\f\r"), int(gone.sum())


def removed_passages(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS, window: int = WINDOW) -> DataFrame:
    """`docs` without repeated passages in `text` (`n_chars` follows), with s_removed, the number of sentences taken out."""
    docs = docs.drop("s_removed")
    spans = repeated(docs, sentences, words, window).withColumnRenamed("doc_id", "id")
    whole = docs.select(F.struct(*docs.columns).alias("row"))  # one column, so that no name of `docs` can clash
    joined = whole.join(spans.hint("merge"), F.col("row.doc_id").cast("long") == F.col("id"), "left").select("row", "spans")
    schema = docs.limit(0).schema.add("s_removed", "long")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(names, batch.column("row").flatten()))
            spans, count = batch.column("spans"), np.zeros(batch.num_rows, np.int64)
            touched = [i for i, ok in enumerate(spans.is_valid().to_pylist()) if ok and columns["text"][i].is_valid]
            if touched:
                texts = columns["text"].to_pylist()
                lengths = columns["n_chars"].to_pylist() if "n_chars" in columns else None
                for i in touched:
                    texts[i], count[i] = cut(texts[i], spans[i].as_py(), window)
                    if lengths is not None and count[i]:
                        lengths[i] = len(texts[i])
                columns["text"] = pa.array(texts, columns["text"].type)
                if lengths is not None:
                    columns["n_chars"] = pa.array(lengths, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(count)], [*names, "s_removed"])

    return joined.mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_removed (sentences taken out), n_chars (of what is left) and text (what is left)."""
    out = removed_passages(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("s_removed").alias("n_removed"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), "text")

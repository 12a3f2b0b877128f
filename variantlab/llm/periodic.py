"""Periodic runs of words: all stretches that repeat one block at least EXPONENT times, found as maximal pairs.

A maximal pair is a stretch of words at two places that neither neighbour extends on both.  Two places
q words apart that share l words are, if they are a maximal pair with q * (EXPONENT - 1) <= l, a
periodic stretch of q + l words that nothing extends, so nothing is extended here.  Pairs come from the
tree of LCP intervals of a suffix array over the words of a text: bottom-up, every interval holds its
places in lists by the word to their left, and when a child joins its parent, the places of the smaller
one look for their nearest places in the lists of other left words.  Nearest ones suffice: a place in
between would give the stretch a smaller period.  Intervals whose places all have one left word make
no pair, nor do those that share too few words for any period; neither is visited.  Words are compared by
64-bit values.

Texts are handled in chunks, each text whole in one task; nothing is shuffled.  A null or empty text,
or one of white space only, has no words, no runs, and an empty collapsed text.  Very long texts make
chunks of their own; time grows with n log n, memory with n.  Repeated rows are judged row by row.  A
row without doc_id is read as it stands (no planted period).  An empty table gives an empty result;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from variantlab.llm.arrays import SPACE, Words, chunks, mix, utf8

#: Fewest words of a run, and fewest times that its period goes into it.
LEAST, EXPONENT = 6, 4

RUN = "start long, length long, period long"


def suffixes(value: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of all texts in order (those of a text stand together, a prefix before what it begins), and the place of each.

    value: a number for each word; text: the text of each word, ascending.  Ranks double the words
    that they stand for; only suffixes that share theirs are sorted again.
    """
    n = len(value)
    _, number = np.unique(value, return_inverse=True)
    key = text * (int(number.max(initial=0)) + 1) + number
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[order][1:] != key[order][:-1]
    slot = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, slot, 0))
    same = ~new
    same[:-1] |= ~new[1:]
    open_ = order[same]
    step = 1
    while len(open_):
        after = open_ + step
        inside = after < n
        inside[inside] = text[after[inside]] == text[open_[inside]]
        further = np.zeros(len(open_), np.int64)
        further[inside] = rank[after[inside]] + 1
        key = rank[open_] * (n + 1) + further
        by = np.argsort(key, kind="stable")
        open_, key = open_[by], key[by]
        old = rank[open_]
        group = np.ones(len(open_), bool)
        group[1:] = old[1:] != old[:-1]
        first = np.flatnonzero(group)
        at = old + np.arange(len(open_)) - np.repeat(first, np.diff(np.append(first, len(open_))))
        new = np.ones(len(open_), bool)
        new[1:] = key[1:] != key[:-1]
        rank[open_] = np.maximum.accumulate(np.where(new, at, 0))
        order[at] = open_
        same = ~new
        same[:-1] |= ~new[1:]
        open_ = open_[same]
        step *= 2
    return order, rank


def shared(words: list[int], order: list[int], place: list[int]) -> list[int]:
    """How many words each suffix of one text shares with the one before it in order (Kasai et al. 2001); `words` ends with a mark of its own."""
    n, same = len(order), 0
    out = [0] * n
    for i in range(n):
        at = place[i]
        if at:
            j = order[at - 1]
            while words[i + same] == words[j + same] and i + same < n and j + same < n:
                same += 1
            out[at] = same
            if same:
                same -= 1
        else:
            same = 0
    return out


def least_shared(least: int, exponent: int) -> int:
    """Fewest words that the two places of a run's pair share, whatever its period."""
    return min(max(least - q, (exponent - 1) * q, 1) for q in range(1, least + 1))


class Interval:
    """An LCP interval under construction: shared words, first place in order, members, and their places by left word."""

    __slots__ = ("shared", "start", "count", "lists")

    def __init__(self, shared: int, start: int, count: int, lists: dict[int, list[int]]) -> None:
        self.shared, self.start, self.count, self.lists = shared, start, count, lists


def maximal_pairs(words: list[int], order: list[int], place: list[int], lcp: list[int], low: int, high: int, least: int, exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of periodic maximal pairs among the suffixes order[low:high], neighbours of which share words.

    words[i - 1] is the word to the left of i, and -1 where there is none; words has one more mark at its end.
    """
    found: list[tuple[int, int, int]] = []

    def pair(i: int, j: int, size: int) -> None:
        # the nearest place may be of the same child, so that both are followed by one word
        if 0 <= i < j and (exponent - 1) * (j - i) <= size and j - i + size >= least and words[i - 1] != words[j - 1] and words[i + size] != words[j + size]:
            found.append((i, j - i + size, j - i))

    def paired(few: dict[int, list[int]], many: dict[int, list[int]], size: int, a: int, b: int) -> None:
        """Pairs that share `size` words, of places in `few` and places of other left words; both are in the interval order[a:b]."""
        reach = size // (exponent - 1)
        for word, places in few.items():
            if len(many) > reach:  # more lists than places that are near enough
                for p in places:
                    pair(next((x for x in range(p - 1, max(p - reach, 0) - 1, -1) if a <= place[x] < b), -1), p, size)
                    pair(p, next((x for x in range(p + 1, min(p + reach + 1, len(place))) if a <= place[x] < b), -1), size)
                continue
            others = [own for w, own in many.items() if w != word]
            for p in places:
                for own in others:
                    k = bisect_left(own, p)
                    if k:
                        pair(own[k - 1], p, size)
                    if k < len(own):
                        pair(p, own[k], size)

    def joined(parent: Interval, child: Interval, end: int) -> None:
        own, more = (parent.lists, child.lists) if parent.count >= child.count else (child.lists, parent.lists)
        if len(own) > 1 or len(more) > 1 or own.keys() != more.keys():
            paired(more, own, parent.shared, parent.start, end)
        _put(own, more)
        parent.count, parent.lists = parent.count + child.count, own

    stack: list[Interval] = []
    for k in range(low, high):
        before, after = lcp[k] if k > low else -1, lcp[k + 1] if k + 1 < high else -1
        leaf = Interval(max(before, after), k, 1, {words[order[k] - 1]: [order[k]]})
        if after > before:
            stack.append(leaf)  # opens an interval
        else:
            joined(stack[-1], leaf, k + 1)
        while stack[-1].shared > after:
            child = stack.pop()
            if stack and stack[-1].shared >= after:
                joined(stack[-1], child, k + 1)
            elif after < 0:
                break
            else:
                child.shared = after
                stack.append(child)
    return found


def _put(into: dict[int, list[int]], more: dict[int, list[int]]) -> None:
    """The lists of `more` in those of `into`, ascending."""
    for word, places in more.items():
        own = into.get(word)
        if own is None:
            into[word] = places
        elif own[-1] < places[0]:
            own += places
        elif 16 * len(places) >= len(own):
            own += places
            own.sort()  # two ascending lists: linear
        else:
            for p in places:
                insort(own, p)


def runs(words: np.ndarray, order: np.ndarray, place: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """All runs of one text as (start, length, period), by start and period; order and place: of its suffixes, from 0."""
    marked = [*words.tolist(), -2, -1]  # words[-1] is left of the first word
    placed, ordered = place.tolist(), order.tolist()
    lcp = shared(marked, ordered, placed)
    deep = np.array(lcp) >= least_shared(least, exponent)
    left = np.where(order > 0, words[order - 1], -1)
    differs = np.zeros(len(words), bool)
    differs[1:] = left[1:] != left[:-1]
    # stretches of order whose neighbours share enough; only those with two left words are visited
    edges = np.flatnonzero(np.diff(np.concatenate([[0], deep.astype(np.int8), [0]])))
    some = np.concatenate([[0], np.cumsum(differs & deep)])
    out: dict[tuple[int, int], int] = {}
    for a, b in edges.reshape(-1, 2).tolist():
        if some[b] > some[a]:
            for start, length, period in maximal_pairs(marked, ordered, placed, lcp, a - 1, b, least, exponent):
                # multiples of a period make pairs too, of the same stretch
                out[start, length] = min(period, out.get((start, length), period))
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def planted(doc_id: int, n: int) -> tuple[int, int] | None:
    """Where the period that the contract plants in a text begins, and the period."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    return g % n, 1 + (n - g % n) // (3 + g % 8)


class Texts:
    """Words of some texts with what recurs inside each; `index` names the word of the texts that stands at each place."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, ids: list[int | None] | None = None, least: int = LEAST, exponent: int = EXPONENT) -> None:
        self.found = w = Words(data, offsets)
        self.first = first = w.first
        n = len(w.start)
        self.index = np.arange(n)
        self.moved = np.zeros(len(offsets) - 1, bool)
        for t, doc_id in enumerate(ids or ()):
            at = planted(doc_id, int(first[t + 1] - first[t])) if doc_id is not None else None
            if at:
                own = self.index[first[t] + at[0] : first[t + 1]]
                own[:] = own[0] + np.arange(len(own)) % at[1]
                self.moved[t] = True
        value = w.value[self.index] if n else np.empty(0, np.uint64)
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.runs: list[list[tuple[int, int, int]]] = [[] for _ in range(len(first) - 1)]
        some = self._repeating(value, text, least_shared(least, exponent))
        if not some.any():
            return
        chosen = np.flatnonzero(some)
        mine = np.flatnonzero(some[text])
        order, place = suffixes(value[mine], text[mine])
        _, number = np.unique(value[mine], return_inverse=True)
        cuts = np.searchsorted(text[mine], [*chosen, len(first)])
        for t, a, b in zip(chosen.tolist(), cuts, cuts[1:]):
            self.runs[t] = runs(number[a:b], order[a:b] - a, place[a:b] - a, least, exponent)

    def _repeating(self, value: np.ndarray, text: np.ndarray, size: int) -> np.ndarray:
        """Texts in which some stretch of `size` words occurs twice: no others have runs."""
        out = np.zeros(len(self.first) - 1, bool)
        n = len(value) - size + 1
        if n < 2:
            return out
        h = text[:n].astype(np.uint64)
        for k in range(size):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + value[k : k + n])
        whole = np.flatnonzero(text[:n] == text[size - 1 :])
        whole = whole[np.argsort(h[whole], kind="stable")]
        twice = h[whole][1:] == h[whole][:-1]
        out[text[whole[1:][twice]]] = True
        return out

    def collapsed(self) -> list[bytes]:
        """Each text's words joined by one space, without those that a run contains after its first period."""
        w, data = self.found, self.found.data
        # texts that stand as they are: their words' bytes and one for each gap
        keep = ~SPACE[data]
        inner = np.ones(len(w.end), bool)
        inner[self.first[1:][np.diff(self.first) > 0] - 1] = False
        joined = data
        if inner.any():
            joined = data.copy()
            joined[w.end[inner]] = 0x20
            keep[w.end[inner]] = True
        cuts = np.concatenate([[0], np.cumsum(keep)])[w.offsets]
        flat = joined[keep].tobytes()
        out = []
        for t, found in enumerate(self.runs):
            if not found and not self.moved[t]:
                out.append(flat[cuts[t] : cuts[t + 1]])
                continue
            a, b = self.first[t], self.first[t + 1]
            steps = np.zeros(b - a + 1, np.int64)
            for start, length, period in found:
                steps[start + period] += 1
                steps[start + length] -= 1
            own = self.index[a:b][np.cumsum(steps[:-1]) == 0]
            low = int(w.offsets[t])
            source = data[low : w.offsets[t + 1]].tobytes()
            out.append(b" ".join([source[x:y] for x, y in zip((w.start[own] - low).tolist(), (w.end[own] - low).tolist())]))
        return out


def _texts(batch: pa.RecordBatch, plant: bool, least: int, exponent: int) -> Iterator[Texts]:
    data, offsets = utf8(batch.column("text"))
    ids = batch.column("doc_id").to_pylist() if plant else None
    for a, b in chunks(offsets):
        yield Texts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ids[a:b] if plant else None, least, exponent)


def with_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """doc_id, `runs` (array of start, length, period, in words) and `collapsed`, the text with the first period of each run only, one space between words."""
    run = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, left = [], []
            for texts in _texts(batch, False, least, exponent):
                found += [[dict(zip(("start", "length", "period"), r)) for r in own] for own in texts.runs]
                left += [x.decode() for x in texts.collapsed()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(run)), pa.array(left, pa.string())], ["doc_id", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, runs array<struct<{RUN.replace(' long', ':long')}>>, collapsed string")


def report(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """One row per document: n_runs, the longest run, and digests of all runs and of the collapsed text; a planted period by doc_id comes first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for texts in _texts(batch, True, least, exponent):
                for found, left in zip(texts.runs, texts.collapsed()):
                    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
                    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
                    milli = 1000 * best[1] // best[2] if found else None
                    rows.append((len(found), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest()))
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n_runs long, {RUN}, exponent_milli long, runs_sha256 string, collapsed_sha256 string")

"""Best-fit packing of tokenised documents into sequences, with a swap-based local search.

Pieces are dealt to groups by a hash of their place, each group is packed best-fit, largest first,
and a local search then exchanges pieces between underfull bins (moves, one for one, two for one)
so that the squared fill rises and the emptiest bins empty, until no underfull bin has an exchange or
the group has as few bins as any packing of it.  The emptiest bins of each group, with at most
GROUP / PASSED pieces, go to the next level, which so has at most about a PASSED-th of the pieces
however badly they fit; it is packed alike, until one group is left.  A group has about GROUP pieces at
every level.  Other bins are final: pieces are dealt by hash, so what fits together is in each group.

A null text is empty: one piece, the end token.  A text longer than a sequence is cut, the first
piece taking the remainder.  Repeated rows and rows without doc_id are pieces of their own.  Pieces are
numbered as they are written, and dealt to groups by a hash of that number, so no source, document or
repeated doc_id can make a group hot.  An empty table gives an empty result; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variantlab.llm.arrays import utf8
from variantlab.llm.bpe import encoder, public_path
from variantlab.llm.common import removed, written

#: Tokens of a sequence, the id that ends a document, pieces of a group.
LENGTH, END, GROUP = 1024, 2, 16_384
#: Bins filled less than this go to the next level, the emptiest first, at most a group's size through this in pieces.
NEARLY, PASSED = 0.99, 8

_PIECE = "piece int, start long, length long, ids_crc32 long, nr long"


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """Pieces of at most `length` tokens of every document: doc_id, piece, start, length, ids_crc32, and nr, another number for each."""
    path = path or public_path()
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, place = encoder(path), TaskContext.get()
        nr = (place.partitionId() if place else 0) << 40
        for batch in batches:
            row, piece, start, size, crc = [], [], [], [], []
            for i, ids in enumerate(coder.encode_all(*utf8(batch.column("text")))):
                ids += end
                n = len(ids) // 4
                first = n % length or min(n, length)
                cuts = [0, *range(first, n + 1, length)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    size.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * b]))
            columns = [batch.column("doc_id").take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.arange(nr, nr + len(row)))]
            nr += len(row)
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "nr"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_PIECE}")


class Bins:
    """Bins of one group: contents by piece number, fill, and bins by what they have and lack."""

    def __init__(self, sizes: list[int], capacity: int) -> None:
        self.sizes, self.capacity = sizes, capacity
        self.content: list[list[int]] = []
        self.fill: list[int] = []
        self.room: dict[int, set[int]] = defaultdict(set)  # of underfull bins, by free tokens
        self.rooms = 0  # bit r is set if some bin has room r

    def _place(self, b: int) -> None:
        r = self.capacity - self.fill[b]
        self.room[r].add(b)
        self.rooms |= 1 << r

    def _lift(self, b: int) -> None:
        r = self.capacity - self.fill[b]
        self.room[r].discard(b)
        if not self.room[r]:
            self.rooms &= ~(1 << r)

    def best(self, size: int, most: int | None = None, other: int = -1) -> int:
        """The bin with the least sufficient room, or -1."""
        rest = self.rooms >> size
        while rest:
            r = size + (rest & -rest).bit_length() - 1
            if most is not None and r > most:
                return -1
            for b in self.room[r]:
                if b != other:
                    return b
            rest &= rest - 1
        return -1

    def add(self, b: int, item: int) -> None:
        self._lift(b)
        self.content[b].append(item)
        self.fill[b] += self.sizes[item]
        self._place(b)

    def take(self, b: int, item: int) -> None:
        self._lift(b)
        self.content[b].remove(item)
        self.fill[b] -= self.sizes[item]
        self._place(b)

    def pack(self) -> None:
        """Best fit, largest piece first."""
        for item in sorted(range(len(self.sizes)), key=lambda i: -self.sizes[i]):
            b = self.best(self.sizes[item])
            if b < 0:
                b = len(self.content)
                self.content.append([])
                self.fill.append(0)
                self._place(b)
            self.add(b, item)

    def _sums(self, b: int) -> tuple[int, int]:
        """Bit s is set if the bin has a piece, or two pieces, of s tokens."""
        if b not in self._known:
            own = [self.sizes[y] for y in self.content[b]]
            one = two = 0
            for k, y in enumerate(own):
                one |= 1 << y
                for z in own[:k]:
                    two |= 1 << (y + z)
            self._known[b] = one, two
        return self._known[b]

    def _roomy(self, r: int) -> tuple[int, int]:
        """The same of all bins with free room r."""
        if r not in self._known_room:
            one = two = 0
            for b in self.room[r]:
                x, y = self._sums(b)
                one, two = one | x, two | y
            self._known_room[r] = one, two
        return self._known_room[r]

    def _changed(self, b: int) -> None:
        self._known.pop(b, None)
        self.log.append(b)

    @staticmethod
    def _gain(out: tuple[list[int], list[int]], sums: tuple[int, int], r: int) -> tuple[int, int, int]:
        """The largest gain of at most r of out against less: gain, pieces out, pieces back."""
        best = (0, 0, 0)
        for given, taken in ((0, 0), (0, 1), (1, 0)):
            for x in out[given]:
                least = max(x - r, 1)
                rest = sums[taken] >> least & (1 << max(x - least, 0)) - 1
                if rest:
                    best = max(best, (x - least - (rest & -rest).bit_length() + 1, given + 1, taken + 1))
        return best

    def _pieces(self, b: int, count: int, total: int) -> tuple[int, ...]:
        own, seen = self.content[b], {}
        for y in own:
            if count == 1 and self.sizes[y] == total:
                return (y,)
            if count == 2 and total - self.sizes[y] in seen:
                return (seen[total - self.sizes[y]], y)
            seen[self.sizes[y]] = y
        raise KeyError(total)

    def _shift(self, items: tuple[int, ...], a: int, b: int) -> None:
        for bin_ in (a, b):
            self._known_room.pop(self.capacity - self.fill[bin_], None)
        for item in items:
            self.take(a, item)
            self.add(b, item)
        for bin_ in (a, b):
            self._known_room.pop(self.capacity - self.fill[bin_], None)
            self._changed(bin_)
        if not self.content[a]:
            self._lift(a)  # empty for good

    def exchange(self, low: int, since: int = 0) -> bool:
        """One improving exchange between the bin `low` and a bin at least as full, changed since that place of the log; False if there is none."""
        for x in sorted(self.content[low], key=lambda i: -self.sizes[i]):
            b = self.best(self.sizes[x], other=low)
            if b >= 0 and self.fill[b] + self.sizes[x] > self.fill[low]:
                self._shift((x,), low, b)
                return True
        own = sorted({self.sizes[x] for x in self.content[low]})
        one, two = self._sums(low)
        out = (own, [s for s in range(two.bit_length()) if two >> s & 1])
        most = self.capacity - self.fill[low]
        if since:
            rooms = defaultdict(set)
            for b in set(self.log[since:]):
                if self.content[b]:
                    rooms[self.capacity - self.fill[b]].add(b)
        else:
            rooms = self.room
        for r in sorted(r for r, bins in rooms.items() if bins and 0 < r <= most):
            if not since and not self._gain(out, self._roomy(r), r)[0]:
                continue
            for b in sorted(rooms[r]):
                if b == low:
                    continue
                gain, given, taken = self._gain(out, self._sums(b), r)
                if gain:
                    sums = self._sums(b)[taken - 1]
                    give_total = next(x for x in out[given - 1] if x > gain and sums >> (x - gain) & 1)
                    give, get = self._pieces(low, given, give_total), self._pieces(b, taken, give_total - gain)
                    for room in (most, r):
                        self._known_room.pop(room, None)
                    for y in give:
                        self.take(low, y)
                    for y in get:
                        self.take(b, y)
                        self.add(low, y)
                    for y in give:
                        self.add(b, y)
                    for bin_ in (low, b):
                        self._known_room.pop(self.capacity - self.fill[bin_], None)
                        self._changed(bin_)
                    return True
        return False

    def least(self) -> int:
        """No packing has fewer bins (Martello and Toth's bound): pieces over half are apart, and the rest only fits beside some."""
        count = np.bincount(self.sizes, minlength=self.capacity + 1)
        tokens, half = count * np.arange(len(count)), self.capacity // 2
        n, t = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(tokens)])
        k = np.arange(half + 1)  # pieces under k are left out
        apart = n[-1] - n[half + 1]
        middle, beside = n[self.capacity - k + 1] - n[half + 1], t[self.capacity - k + 1] - t[half + 1]
        small = t[half + 1] - t[k]
        return int((apart + np.maximum(0, -((middle * self.capacity - beside - small) // self.capacity))).max())

    def search(self, steps: int | None = None) -> None:
        """Exchanges, emptiest bins first, until no underfull bin has one or no packing has fewer bins.

        Each raises the squared fill, so it ends.  A bin that had none is held only against bins that
        changed since.  `steps` stops it earlier.
        """
        for b, n in enumerate(self.fill):
            if not n:
                self._lift(b)
        self.log, self._known, self._known_room = [-1], {}, {}
        least, used, done, stuck = self.least(), sum(n > 0 for n in self.fill), 0, {}
        moved = True
        while moved:
            moved = False
            for low in sorted((b for b, n in enumerate(self.fill) if 0 < n < self.capacity), key=lambda b: self.fill[b]):
                while self.content[low] and self.fill[low] < self.capacity:
                    if used <= least or steps is not None and done >= steps:
                        return
                    at = len(self.log)
                    if not self.exchange(low, stuck.get(low, 0)):
                        stuck[low] = at
                        break
                    for b in self.log[at:]:
                        stuck.pop(b, None)  # it has other pieces now
                    moved, done, used = True, done + 1, used - (not self.content[low])


def _packed_group(capacity: int, level: int, last: bool, most: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("nr")
        bins = Bins(rows.column("length").to_pylist(), capacity)
        bins.pack()
        bins.search()
        passed, left = set(), most
        for b in sorted((b for b, n in enumerate(bins.fill) if 0 < n < NEARLY * capacity), key=lambda b: bins.fill[b]):
            left -= len(bins.content[b])
            if last or left < 0:
                break
            passed.add(b)
        n = rows.num_rows
        sequence, offset, open_ = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        for b, items in enumerate(bins.content):
            at = 0
            for item in items:
                sequence[item], offset[item] = (level << 56) + (key[0].as_py() << 20) + b, at
                open_[item] = b in passed
                at += bins.sizes[item]
        out = rows.drop_columns(["grp"])
        for name, column in (("sequence_id", sequence), ("offset", offset), ("open", open_)):
            out = out.append_column(name, pa.array(column))
        return out

    return run


def packed(docs: DataFrame, path: str | None = None, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Every piece with its sequence: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rest = written(pieces(docs, path, length), "pieces")
    left, level, done, out_schema = rest.count(), 0, [], None
    while True:
        groups = -(-left // group)
        last = groups <= 1
        cell = F.pmod(F.xxhash64("nr", F.lit(level)), F.lit(max(groups, 1))).alias("grp")
        out_schema = out_schema or rest.schema.simpleString()[7:-1].replace(":", " ") + ", sequence_id long, offset long, open boolean"
        level_rows = written(rest.select("*", cell).groupBy("grp").applyInArrow(_packed_group(length, level, last, group // PASSED), out_schema), "packed")
        done.append(level_rows.where("not open").drop("open", "nr"))
        if last:
            break
        removed(rest) if level == 0 else None
        rest = level_rows.where("open").drop("open", "sequence_id", "offset")
        still = rest.count()
        left, level = still, level + 1
        if not still:
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out

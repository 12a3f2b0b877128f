"""The trie of conversation prefixes by a splitter skeleton: every distinct sequence of first turns, with what lies below it.

A conversation is a path of 16-byte digests of its turns (role and text), so that paths in byte order
stand in the trie's order.  Splitters cut that order (path, then conv_id) into shards; each is cut
down to the turns that tell it from the one before.  A node with members in two shards is a prefix of
the splitter between them, so the trie of the splitters' prefixes, the skeleton, holds all nodes that
no shard can finish alone.  It is broadcast: it has at most SKELETON nodes, as splitters are left out
until it does, which makes shards larger and changes no result.  Shards are read in order, with a
stack of the nodes on the current path; they finish all other nodes, and give partial aggregates for
the skeleton's, which are summed up over shards.  What skeleton nodes add to those above them is
rolled up over their preorder, of at most SKELETON rows.

One conversation is a row of 20 bytes a turn, however long its texts are.  A first turn, or a whole
conversation, that a third of all rows share is cut by splitters, the latter by conv_id; the ids that
end at one node, whose digest must go over them in order, are packed by shard, PACK a row.

Turns go by `turn`, nulls first, those of one number by their digests; a null role or text is empty;
repeated rows are turns of their own.  Rows without conv_id belong to no conversation and are left
out.  An empty table gives an empty result (no conversation, not even a root).  Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variantlab.llm.common import written

#: Conversations of a shard, the most shards and skeleton nodes.
SHARD, SHARDS, SKELETON = 200_000, 1 << 14, 1 << 19
#: Sampled conversations for a shard, and turns of the whole sample, which only choose splitters.
PER_SHARD, SAMPLED = 24, 1 << 21
#: Bytes of a turn's digest; ids of a row of packed ends.
KEY, PACK = 16, 50_000
#: Turns of the base conversation that the contract may put in front.
HEAD = 5

EMPTY = hashlib.sha256(b"").hexdigest()
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: What a shard gives: a finished node (`parent` is the skeleton node above it, or -1), a share of skeleton node `node`, or ids that end at it.
_GIVEN = f"{_NODE}, node long, parent long, shard int, part int, ends binary"


def paths(conversations: DataFrame) -> DataFrame:
    """conv_id, `path` (digests of the turns) and `sizes` (code points of each text) of every conversation."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("k"), F.length(text).alias("n"))
    turns = F.sort_array(F.collect_list(F.struct("turn", "k", "n")))
    return rows.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", *_flat(F.col("turns")))


def _flat(turns: F.Column) -> tuple[F.Column, F.Column]:
    return F.unhex(F.array_join(turns["k"], "")).alias("path"), turns["n"].alias("sizes")


def rebuilt(given: DataFrame) -> DataFrame:
    """Paths with the first turns of another conversation in front: conversation c takes the first h of c - c % 100 for its own, h = crc32(c) % 6."""
    base = given.where(F.col("conv_id") % 100 == 0)
    base = base.select(F.col("conv_id").alias("base"), F.substring("path", 1, KEY * HEAD).alias("base_path"), F.slice("sizes", 1, HEAD).alias("base_sizes"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)
    own = given.withColumns({"base": F.col("conv_id") - F.col("conv_id") % 100, "h": h.cast("int")}).join(base, "base", "left")
    head, sizes = F.coalesce("base_path", F.lit(b"")), F.coalesce("base_sizes", F.array().cast("array<int>"))
    path = F.concat(F.substring(head, F.lit(1), F.col("h") * KEY), F.expr(f"substring(path, h * {KEY} + 1)"))
    rest = F.slice("sizes", F.col("h") + 1, F.greatest(F.size("sizes") - F.col("h"), F.lit(0)))
    return own.select("conv_id", path.alias("path"), F.concat(F.slice(sizes, F.lit(1), F.col("h")), rest).alias("sizes"))


def _alike(a: bytes, b: bytes) -> int:
    """Turns that two paths begin with alike."""
    n = min(len(a), len(b)) // KEY
    if a[: n * KEY] == b[: n * KEY]:
        return n
    low, high = 0, n  # the first `low` are alike, the first `high` aren't
    while high - low > 1:
        mid = (low + high) // 2
        if a[: mid * KEY] == b[: mid * KEY]:
            low = mid
        else:
            high = mid
    return low


@dataclass
class Skeleton:
    """The splitters, and the trie of their prefixes in preorder; node 0 is the root."""

    splitters: list[tuple[bytes, int]]
    below: dict[tuple[int, bytes], int] = field(default_factory=dict)
    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    size: list[int] = field(default_factory=lambda: [0])  # code points of the last text

    def add(self, path: bytes, sizes: list[int]) -> None:
        at = 0
        for d in range(len(path) // KEY):
            key = path[d * KEY : (d + 1) * KEY]
            to = self.below.get((at, key))
            if to is None:
                to = self.below[at, key] = len(self.parent)
                self.parent.append(at)
                self.depth.append(d + 1)
                self.size.append(sizes[d])
            at = to


def skeleton(sample: list[tuple], shards: int, most: int = SKELETON) -> Skeleton:
    """The skeleton of evenly spaced splitters out of a sample (path, conv_id, sizes), of at most `most` nodes but the root."""
    sample = sorted(sample, key=lambda r: r[:2])
    while True:
        chosen = [sample[len(sample) * i // shards] for i in range(1, shards)] if sample else []
        cut: dict[tuple[bytes, int], list[int]] = {}
        before = sample[0] if sample else None
        for row in chosen:
            if row[:2] == before[:2]:
                continue
            alike = _alike(before[0], row[0])
            if before[0] == row[0]:
                cut[row[:2]] = row[2]  # one path: the ids tell them apart
            else:
                cut[row[0][: (alike + 1) * KEY], -(1 << 63)] = row[2]
            before = row
        # an upper bound, from what neighbours have in common
        nodes, last = 0, b""
        for path, _ in sorted(cut):
            nodes += len(path) // KEY - _alike(last, path)
            last = path
        if nodes <= most:
            break
        shards = max(1, shards // 2)
    out = Skeleton(sorted(cut))
    for path, conv in out.splitters:
        out.add(path, cut[path, conv])
    return out


class _Open:
    """A node on the current path of a shard; node: its number in the skeleton or -1."""

    __slots__ = ("depth", "node", "size", "conv", "convs", "children", "leaves", "saved", "ends", "rows")

    def __init__(self, depth: int, node: int, size: int) -> None:
        self.depth, self.node, self.size = depth, node, size
        self.conv, self.convs, self.children, self.leaves, self.saved = 1 << 63, 0, 0, 0, 0
        self.ends = None  # of finished nodes a digest, of skeleton nodes ids
        self.rows: list[list] = []  # finished children, which wait for this node's smallest member


class _Out:
    """Rows of a shard, by column, until a batch is full."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        names = [x.split()[0] for x in _GIVEN.split(", ")]
        columns = list(zip(*self.rows)) or [()] * len(names)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _shard(rows: Iterator[tuple[int, bytes, list[int]]], shard: int, below: dict[tuple[int, bytes], int], pack: int, out: _Out) -> Iterator[None]:
    """One shard's rows (conv_id, path, sizes), in order of path and conv_id; yields when `out` may be emptied."""
    stack = [_Open(0, 0, 0)]
    parts: dict[int, int] = {}

    def packed(top: _Open) -> None:
        if top.ends:
            parts[top.node] = part = parts.get(top.node, -1) + 1
            out.rows.append((None,) * 8 + (top.node, None, shard, part, ",".join(map(str, top.ends)).encode()))
            top.ends = None

    def close() -> None:
        top = stack.pop()
        over = stack[-1] if stack else None
        if over is not None:
            over.conv, over.convs = min(over.conv, top.conv), over.convs + top.convs
        for row in top.rows:
            row[2] = top.conv
            out.rows.append(tuple(row))
        if top.node >= 0:
            packed(top)
            out.rows.append((top.conv, top.depth, None, top.convs, top.children, top.leaves, top.saved, None, top.node, None, shard, None, None))
            if over is not None:
                over.leaves, over.saved = over.leaves + top.leaves, over.saved + top.saved
            return
        top.leaves += top.children == 0
        top.saved += (top.convs - 1) * top.size
        over.children, over.leaves, over.saved = over.children + 1, over.leaves + top.leaves, over.saved + top.saved
        row = [top.conv, top.depth, None, top.convs, top.children, top.leaves, top.saved, top.ends.hexdigest() if top.ends else EMPTY, None, over.node, shard, None, None]
        if over.node >= 0:
            out.rows.append(tuple(row))
        else:
            over.rows.append(row)

    last = b""
    for conv, path, sizes in rows:
        same = _alike(last, path)
        while len(stack) - 1 > same:
            close()
        for d in range(same, len(path) // KEY):
            node = below.get((stack[-1].node, path[d * KEY : (d + 1) * KEY]), -1) if stack[-1].node >= 0 else -1
            stack.append(_Open(d + 1, node, sizes[d]))
        top, last = stack[-1], path
        top.conv, top.convs = min(top.conv, conv), top.convs + 1
        if top.node >= 0:
            top.ends = top.ends or []
            top.ends.append(conv)
            if len(top.ends) >= pack:
                packed(top)
        elif top.ends is None:
            top.ends = hashlib.sha256(str(conv).encode())
        else:
            top.ends.update(f",{conv}".encode())
        yield
    while stack:
        close()
    yield


def _finished(batches: Iterator[pa.RecordBatch], below: dict[tuple[int, bytes], int], pack: int) -> Iterator[pa.RecordBatch]:
    """What the shards of a task give, one shard after the other."""
    out = _Out()
    held: list = []  # the first row of the next shard

    def rows() -> Iterator[tuple[int, int, bytes, list[int]]]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                yield from zip(*(batch.column(c).slice(start, 1024).to_pylist() for c in ("shard", "conv_id", "path", "sizes")))

    every = rows()
    row = next(every, None)
    while row is not None:
        shard = row[0]

        def own(first=row, shard=shard) -> Iterator[tuple[int, bytes, list[int]]]:
            held.clear()
            yield first[1:]
            for r in every:
                if r[0] != shard:
                    held.append(r)
                    return
                yield r[1:]

        for _ in _shard(own(), shard, below, pack, out):
            if len(out.rows) >= 5000:
                yield out.batch()
        row = held[0] if held else None
    if out.rows:
        yield out.batch()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and the digest of its packed ids, from rows in order of node, shard and part."""
    nodes, digests = [], []
    for batch in batches:
        for node, ends in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist()):
            if nodes and nodes[-1] == node:
                digests[-1].update(b"," + ends)
            else:
                nodes.append(node)
                digests.append(hashlib.sha256(ends))
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([d.hexdigest() for d in digests], pa.string())], ["node", "ends_sha256"])


def nodes(given: DataFrame, shard: int = SHARD, most: int = SKELETON, pack: int = PACK) -> DataFrame:
    """All nodes of the trie of `given` (conv_id, path, sizes; conv_id without repetition), one row each, in the columns of the contract."""
    spark = given.sparkSession
    given = written(given, "paths")
    count, turns = given.agg(F.count("*"), F.coalesce(F.sum(F.size("sizes")), F.lit(0))).first()
    shards = max(1, min(SHARDS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // shard))))
    wanted = min(shards * PER_SHARD, SAMPLED * count // max(turns, 1))
    share = min(1 << 20, -(-(wanted << 20) // max(count, 1)))
    sampled = given.where(F.pmod(F.xxhash64(F.lit(12), "conv_id"), F.lit(1 << 20)) < share).toArrow()
    known = skeleton(list(zip(sampled.column("path").to_pylist(), sampled.column("conv_id").to_pylist(), sampled.column("sizes").to_pylist())), shards, most)
    shared = spark.sparkContext.broadcast((known.splitters, known.below))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitters = shared.value[0]
        for batch in batches:
            at = [bisect_right(splitters, x) for x in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns], ["shard", *batch.schema.names])

    dealt = given.select("conv_id", "path", "sizes").mapInArrow(assigned, "shard int, conv_id long, path binary, sizes array<int>")
    dealt = dealt.repartitionById(len(known.splitters) + 1, "shard").sortWithinPartitions("shard", "path", "conv_id")
    out = written(dealt.mapInArrow(lambda x: _finished(x, shared.value[1], pack), _GIVEN), "trie")
    names = [x.split()[0] for x in _NODE.split(", ")]

    ends = out.where("ends is not null").select("node", "shard", "part", "ends")
    ends = ends.repartition("node").sortWithinPartitions("node", "shard", "part").mapInArrow(_digests, "node long, ends_sha256 string")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    reduced = out.where("node is not null and ends is null").groupBy("node").agg(F.min("conv_id").alias("conv_id"), *sums).join(ends, "node", "left")
    core = spark.createDataFrame(_rolled_up(known, reduced.toArrow()), f"{_NODE}, node long")
    own = out.where("node is null")
    alone = own.where("parent = -1").select(*names)
    above = F.broadcast(core.select(F.col("node").alias("parent"), F.col("conv_id").alias("_above")))
    under = own.where("parent >= 0").join(above, "parent").withColumn("parent_conv_id", F.col("_above")).select(*names)
    return core.select(*names).union(alone).union(under)


def _rolled_up(known: Skeleton, reduced: pa.Table) -> pa.Table:
    """The skeleton's nodes: of their own members and finished children from the shards, the rest from the nodes below them, by preorder."""
    n = len(known.parent)
    parent, depth, size = (np.array(x, np.int64) for x in (known.parent, known.depth, known.size))
    at = reduced.column("node").to_numpy()

    def column(name: str) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[at] = reduced.column(name).to_numpy()
        return out

    conv, convs, children, leaves, saved = (column(c) for c in ("conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"))
    children += np.bincount(parent[1:], minlength=n)
    # shards have summed up all but what the skeleton's nodes are themselves
    own = np.stack([children == 0, (convs - 1) * size * (depth > 0)]).astype(np.int64)
    before = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(own, axis=1)], axis=1)
    last = np.arange(1, n + 1)  # in preorder, a subtree is a stretch
    for i in range(n - 1, 0, -1):
        last[parent[i]] = max(last[parent[i]], last[i])
    below = before[:, last] - before[:, :n]
    digest = np.full(n, EMPTY, object)
    digest[at] = [x or EMPTY for x in reduced.column("ends_sha256").to_pylist()]
    there = convs > 0
    above = pa.array(conv[np.maximum(parent, 0)], mask=parent < 0)
    columns = [pa.array(conv), pa.array(depth), above, pa.array(convs), pa.array(children), pa.array(leaves + below[0]), pa.array(saved + below[1]), pa.array(digest.tolist(), pa.string()), pa.array(np.arange(n))]
    return pa.table(columns, [x.split()[0] for x in f"{_NODE}, node".split(", ")]).filter(pa.array(there))


def report(conversations: DataFrame) -> DataFrame:
    """The trie's nodes of the rebuilt conversations."""
    return nodes(rebuilt(paths(conversations)))


#: The same in DuckDB; it has no crc32, so its bits are folded here.
_CRC = "xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split({0}, ''), lambda c: list_concat([ascii(c)::bigint], [-1::bigint, -1, -1, -1, -1, -1, -1, -1])))), lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, (a & 1) * 3988292384) end), 4294967295)"
SQL = f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
k as (select conv_id, turn, md5(length(role)::varchar || ':' || role || text) as k, length(text) as n from c),
o as (select conv_id, list({{'k': k, 'n': n}} order by turn nulls first, k, n) as own from k group by conv_id),
h as (select o.conv_id, list_concat(coalesce(b.own, [])[:{_CRC.format("o.conv_id::varchar")} % {HEAD + 1}], o.own[{_CRC.format("o.conv_id::varchar")} % {HEAD + 1} + 1:]) as v
  from o left join o b on b.conv_id = o.conv_id - o.conv_id % 100),
p as (select conv_id, d, len(v) as total, list_aggregate(list_transform(v[:d], lambda x: x.k), 'string_agg', '') as p, case when d > 0 then v[d].n else 0 end as n
  from (select conv_id, v, unnest(generate_series(0, len(v))) as d from h)),
q as (select conv_id, d, total, n, coalesce(p, '') as p, substr(coalesce(p, ''), 1, greatest(0, 32 * (d - 1))) as up from p),
m as (select d, p, any_value(up) as up, min(conv_id) as conv_id, count(*) as n_convs, any_value(n) as n,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where total = d), '')) as ends_sha256 from q group by d, p),
s as (select m.*, (select count(*) from m x where x.d = m.d + 1 and x.up = m.p) as n_children from m),
t as (select distinct a.d, a.p, b.d as d2, b.p as p2 from q a join q b on a.conv_id = b.conv_id and b.d >= a.d),
u as (select t.d, t.p, count(*) filter (where s.n_children = 0) as n_leaves, sum((s.n_convs - 1) * s.n)::bigint as saved_tokens from t join s on s.d = t.d2 and s.p = t.p2 group by t.d, t.p)
select s.conv_id, s.d as depth, x.conv_id as parent_conv_id, s.n_convs, s.n_children, u.n_leaves, u.saved_tokens, s.ends_sha256
from s join u on u.d = s.d and u.p = s.p left join m x on x.d = s.d - 1 and x.p = s.up
"""

"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosines, connected components.

Equal vectors become one class.  In each table a vector's bucket is the signs of its products with
`bits` random hyperplanes; buckets are cut into cells of bounded size.  A cell first compares the signs
themselves: how many differ tells the angle, and pairs that differ in more than a pair at the threshold
does with a chance of about one in 10**9 are left out.  Only vectors with a pair that is left are
fetched, once for each cell that is the first to hold such a pair of theirs, and compared by cosine in
double precision.  A pair that agrees in several tables counts in the first.  A cell sends, for each of
its linked vectors, its number of links and the smallest vector that it reaches in the cell, so rows
grow with the vectors and not with pairs.

Both numbers follow from the data's size and the threshold alone: `bits` keeps buckets of unrelated
vectors at about BUCKET, and there are as many tables as find a pair at the threshold with
probability RECALL.  Vectors that are null, empty, zero or hold null or non-finite components link
with nothing, vectors of different lengths don't link.  Each row of a repeated vec_id is a vector
(they share the id, so their links to each other count and their component is the same).  A row
without vec_id links with nothing.  An empty table gives an empty result; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variantlab.llm.common import by_cell, components, dealt, in_blocks, roots, written

#: Least cosine; vectors of a bucket by chance; share of pairs at the threshold to find; vectors of a cell's side.
COSINE, BUCKET, RECALL, CELL = 0.95, 1024, 0.9998, 1024
#: Fewest signs that cells compare, and standard deviations by which a pair's differences may exceed those at the threshold.
SIGNS, SPREAD = 256, 6.0
SEED = 20_240_607


def plan(vectors: int, cosine: float = COSINE) -> tuple[int, int]:
    """Bits of a bucket and number of tables."""
    bits = min(62, max(4, math.ceil(math.log2(max(vectors, 1) / BUCKET))) if vectors > BUCKET else 4)
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - RECALL) / math.log1p(-same))


def most_differing(signs: int, cosine: float = COSINE) -> int:
    """How many of the signs of a pair at the threshold may differ."""
    share = math.acos(cosine) / math.pi
    return math.ceil(signs * share + SPREAD * math.sqrt(signs * share * (1 - share)))


def _matrix(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors, in their own precision, of each length, of rows that can link."""
    kind = pa.float32() if pa.types.is_float32(column.type.value_type) else pa.float64()
    column = column.cast(pa.list_(kind))
    offsets = column.offsets.to_numpy()
    lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    flat = column.values.to_numpy(zero_copy_only=False)
    for n in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == n)
        x = flat[offsets[rows][:, None] + np.arange(n)]
        good = np.isfinite(x).all(1) & (x != 0).any(1)
        yield rows[good], x[good]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, key (equal for equal vectors) and the vector's bytes."""
    for batch in batches:
        for rows, x in _matrix(batch.column("embedding")):
            raw = [(v + v.dtype.type(0)).tobytes() for v in x]
            keys = [hashlib.blake2b(r, digest_size=16).digest() for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "key", "vector"])


def _buckets(signs: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The bucket of each table, of signs [vector, plane]."""
    return (signs[:, : bits * tables].reshape(len(signs), tables, bits) * (1 << np.arange(bits, dtype=np.int64))).sum(2)


def _signed(bits: int, tables: int, kind: str):
    planes: dict[int, np.ndarray] = {}
    count = max(SIGNS, bits * tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get()
        nr = (place.partitionId() if place else 0) << 40
        for batch in batches:
            raw = batch.column("vector").to_pylist()
            for n in {len(r) for r in raw}:
                width = n // np.dtype(kind).itemsize
                if n not in planes:
                    planes[n] = np.random.default_rng([SEED, width]).standard_normal((width, count))
                rows = [i for i, r in enumerate(raw) if len(r) == n]
                x = np.frombuffer(b"".join(raw[i] for i in rows), kind).reshape(len(rows), -1)
                signs = _unit(x) @ planes[n] > 0
                bucket = _buckets(signs, bits, tables)
                kept = batch.take(pa.array(rows))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, bucket.size + 1, tables), pa.int32()), pa.array(bucket.reshape(-1)))
                packed = pa.array([r.tobytes() for r in np.packbits(signs, axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(np.arange(nr, nr + len(rows))), packed, flat], [*kept.schema.names, "nr", "signs", "buckets"])
                nr += len(rows)

    return run


def _sides(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Members of a cell's two sides, the same for a cell of one block."""
    side = code % 4 - 1
    if (side >= 0).all():
        return np.flatnonzero(side == 0), np.flatnonzero(side == 1), False
    return np.arange(len(side)), np.arange(len(side)), True


def _first(near: np.ndarray, signs: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int, place: int) -> tuple[np.ndarray, np.ndarray]:
    """The near pairs that no table before this one holds."""
    i, j = np.nonzero(near)
    buckets = _buckets(signs, bits, place)
    for t in range(place):
        new = buckets[a[i], t] != buckets[b[j], t]
        i, j = i[new], j[new]
    return i, j


def _plausible(bits: int, tables: int, cosine: float):
    count = max(SIGNS, bits * tables)
    most = most_differing(count, cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The members of a cell that have a pair there whose signs are alike."""
        for table in by_cell(batches):
            code = table.column("code").to_numpy()
            raw = np.frombuffer(b"".join(table.column("signs").to_pylist()), np.uint8).reshape(len(code), -1)
            signs = np.unpackbits(raw, axis=1, count=count)
            a, b, one = _sides(code)
            if not len(a) or not len(b):
                continue
            x = signs.astype(np.float32) * 2 - 1
            near = x[a] @ x[b].T >= count - 2 * most
            if one:
                near[np.arange(len(a)), np.arange(len(a))] = False
            i, j = _first(near, signs, a, b, bits, int(code[0]) // 4)
            some = np.unique(np.concatenate([a[i], b[j]]))
            if len(some):
                yield pa.RecordBatch.from_arrays([c.combine_chunks().take(pa.array(some)) for c in (table.column("nr"), table.column("cell"), table.column("code"))], ["nr", "cell", "code"])

    return run


def _linked(bits: int, tables: int, cosine: float, kind: str):
    count = max(SIGNS, bits * tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_cell(batches):
            ids, copies, code = (table.column(c).to_numpy() for c in ("rep", "copies", "code"))
            raw = table.column("vector").to_pylist()
            packed = np.frombuffer(b"".join(table.column("signs").to_pylist()), np.uint8).reshape(len(ids), -1)
            signs = np.unpackbits(packed, axis=1, count=count)
            sides = _sides(code)
            for n in {len(r) for r in raw}:
                own = np.array([len(r) == n for r in raw])
                a, b, one = sides[0][own[sides[0]]], sides[1][own[sides[1]]], sides[2]
                if not len(a) or not len(b):
                    continue
                x, y = (_unit(np.frombuffer(b"".join(raw[i] for i in at), kind).reshape(len(at), -1)) for at in (a, b))
                near = x @ y.T >= cosine
                if one:
                    near &= ~np.eye(len(a), dtype=bool)
                i, j = _first(near, signs, a, b, bits, int(code[0]) // 4)
                if not len(i):
                    continue
                near[:] = False
                near[i, j] = True
                links = np.zeros(len(ids), np.int64)
                np.add.at(links, a[i], copies[b[j]])
                if not one:
                    np.add.at(links, b[j], copies[a[i]])
                some = np.flatnonzero(links)
                node, low = roots(near, ids[a], ids[b])
                at = np.searchsorted(node, ids[some])
                yield pa.RecordBatch.from_arrays([table.column("nr").combine_chunks().take(pa.array(some)), pa.array(ids[some]), pa.array(low[at]), pa.array(links[some])], ["nr", "rep", "low", "links"])

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id (the smallest vec_id that links reach) and kept (vec_id = component_id), one row per row of `vectors`."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    kind = "f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "f8"
    keyed = rows.where("vec_id is not null").mapInArrow(_keyed, "vec_id long, key binary, vector binary")
    classes = keyed.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    bits, tables = plan(rows.count(), cosine)
    signed = written(classes.mapInArrow(_signed(bits, tables, kind), "key binary, rep long, copies long, vector binary, nr long, signs binary, buckets array<long>"), "signed")

    # cells compare signs; vectors are fetched for members with a pair that is left, and dealt to the same cells
    placed = signed.select("nr", "signs", F.posexplode("buckets").alias("p", "bucket")).withColumn("place", F.col("p"))
    cells = in_blocks(placed, ["p", "bucket"], "nr", CELL)
    cells = cells.select("nr", "signs", "cell", (F.col("place") * 4 + F.col("side") + 1).cast("int").alias("code"))
    some = dealt(cells).mapInArrow(_plausible(bits, tables, cosine), "nr long, cell long, code int")
    fetched = some.join(signed.select("nr", "rep", "copies", "vector", "signs"), "nr")
    found = written(dealt(fetched).mapInArrow(_linked(bits, tables, cosine, kind), "nr long, rep long, low long, links long"), "links")

    reached = components(found.select(F.col("rep").alias("u"), F.col("low").alias("v")))
    links = found.groupBy("nr").agg(F.sum("links").alias("links"))
    by_key = signed.select("key", "nr", "rep", "copies").join(links, "nr", "left").join(reached.withColumnRenamed("id", "rep"), "rep", "left")
    by_key = by_key.select("key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = keyed.select("vec_id", "key").join(by_key, "key").drop("key")
    alone = rows.mapInArrow(_unlinkable, "vec_id long").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.select("vec_id", "n_links", "component_id").union(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _unlinkable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id of rows that can't link, null ids among them."""
    for batch in batches:
        alone = np.ones(batch.num_rows, bool)
        for rows, _ in _matrix(batch.column("embedding")):
            alone[rows] = False
        alone |= batch.column("vec_id").is_null().to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(alone))], ["vec_id"])

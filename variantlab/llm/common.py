"""Groups cut into blocks; tables between stages and connected components are those of `variantlab.tables`."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variantlab.tables import components, removed, scratch, written  # noqa: F401


def in_blocks(members: DataFrame, group: list[str], member: str, size: int) -> DataFrame:
    """Members of groups of two or more, dealt so that each pair of a group meets in exactly one cell.

    A group of m members is cut into ceil(m / size) blocks by a hash of the member; each pair of
    blocks is a cell of at most about twice `size` members, so one huge group becomes many tasks.
    Adds `cell` (long), and `side`: 0 or 1 in a cell of two blocks, -1 in a cell of one.
    """
    counts = members.groupBy(*group).agg(F.count("*").alias("_m")).where("_m > 1")
    blocks = F.ceil(F.col("_m") / size).cast("int")
    out = members.join(counts, group).withColumn("_n", blocks).withColumn("_b", F.pmod(F.xxhash64(F.lit(7), member), "_n").cast("int"))
    out = out.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    out = out.withColumn("cell", F.xxhash64(*group, F.least("_b", "_o"), F.greatest("_b", "_o")))
    side = F.when(F.col("_b") == F.col("_o"), -1).when(F.col("_b") < F.col("_o"), 0).otherwise(1)
    return out.withColumn("side", side.cast("int")).drop("_m", "_n", "_b", "_o", *group)


def by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of one cell each, from batches sorted by the long column `cell`; only one cell is held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        cell = batch.column("cell").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and held[0].column("cell")[0].as_py() != int(cell[a]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def dealt(df: DataFrame) -> DataFrame:
    """Rows of a cell in one partition, next to each other.

    The number is stated: cells cost time and not bytes, by which partitions would be put together.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, "cell").sortWithinPartitions("cell")


def roots(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of linked[i, j], the smallest id that each id reaches inside the matrix: only rows with a link.

    The result has one row for each linked id, so that a cell sends as many rows as it has members.
    """
    ids, inverse = np.unique(np.concatenate([left, right]), return_inverse=True)
    at, to = inverse[: len(left)], inverse[len(left) :]
    label = np.arange(len(ids))
    i, j = np.nonzero(linked)
    u, v = at[i], to[j]
    while True:
        old = label.copy()
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        label = label[label]
        if (label == old).all():
            break
    touched = np.unique(np.concatenate([u, v]))
    return ids[touched], ids[label[touched]]


def text_key(text: Column) -> Column:
    """What equal texts share; a null is an empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))

"""Alignment columns, position windows and profile scores of proteins."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from variantlab.functions.expr import RESIDUES, blosum, residue_index
from variantlab.operators.stats import by_group, quantiles
from variantlab.tables import running, written

#: Width of the position window.
WIDTH = 21

# Fixed values of the profile: background shares of RESIDUES, effective numbers by the step of the similarity, and the scale of substitution scores.
BACKGROUND = (0.085786, 0.045676, 0.047306, 0.058022, 0.018036, 0.037722, 0.059724, 0.081155, 0.021639, 0.052944, 0.081156, 0.058717, 0.021109, 0.039946, 0.048178, 0.063047, 0.060835, 0.014256, 0.036310, 0.068436)
EFFECTIVE = (
    1.0, 1.5, 2.0, 2.5, 3.1, 3.8, 4.2, 5.0, 5.8, 6.4, 7.0, 7.8, 8.9, 9.5, 10.2, 11.2, 12.2, 13.2, 14.2, 15.2, 16.2, 17.5, 19.0, 20.2, 22.0, 23.5, 25.8, 27.5, 30.0, 33.0, 35.5, 40.0, 44.0, 50.0, 55.0,
)
SCALE, PSEUDO, MOST_SIMILAR, MOST_EFFECTIVE = 0.225, 5.0, 18.0, 100.0


def ungapped(rows: DataFrame, group: str = "prot_id", row: str = "row_nr", aligned: str = "aligned") -> DataFrame:
    """Every aligned row cut to the columns in which the group's first row has no gap; rows left without residues go."""
    seeds = rows.where(F.col(row) == 0).select(group, F.split(aligned, "").alias("_seed"))
    cut = F.filter(F.split(aligned, ""), lambda c, i: F.get(F.col("_seed"), i) != "-")
    out = rows.join(seeds, group).withColumn(aligned, F.array_join(cut, "")).drop("_seed")
    return out.where(F.length(F.replace(aligned, F.lit("-"), F.lit(""))) > 0)


def column_cells(rows: DataFrame, group: str = "prot_id", row: str = "row_nr", aligned: str = "aligned") -> DataFrame:
    """One row per cell: group, row, pos (0-based), residue."""
    return rows.select(group, row, F.posexplode(F.split(aligned, "")).alias("pos", "residue"))


def column_shares(cells: DataFrame, group: str = "prot_id") -> DataFrame:
    """Counts of each residue in each column, and rows in all and without a gap."""
    counts = cells.groupBy(group, "pos", "residue").agg(F.count("*").alias("n"))
    total = counts.groupBy(group, "pos").agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("residue") != "-", F.col("n")).otherwise(0)).alias("n_filled"))
    return counts.join(total, [group, "pos"])


def composition(variants: DataFrame, cells: DataFrame, group: str = "prot_id") -> DataFrame:
    """For variants (group, pos, wt, mut) the shares of both residues, of gaps and of others in the column, and without gaps.

    Columns are counted before they meet variants, so the join is of positions, not of cells.
    """
    shares = column_shares(cells, group).groupBy(group, "pos").agg(F.map_from_entries(F.collect_list(F.struct("residue", "n"))).alias("_n"), F.first("n_rows").alias("n_rows"), F.first("n_filled").alias("n_filled"))
    out = variants.join(shares, [group, "pos"], "left")
    n = {k: F.coalesce(F.element_at("_n", F.col(k) if k != "gap" else F.lit("-")), F.lit(0)) for k in ("wt", "mut", "gap")}
    share = {k: F.try_divide(v, F.col("n_rows")) for k, v in n.items()}
    return out.select(
        *variants.columns,
        *[v.alias(f"{k}_share") for k, v in share.items()],
        (1 - share["wt"] - share["mut"] - share["gap"]).alias("other_share"),
        F.try_divide(n["wt"], F.col("n_filled")).alias("wt_share_filled"),
        F.try_divide(n["mut"], F.col("n_filled")).alias("mut_share_filled"),
        F.try_divide(F.col("n_filled"), F.col("n_rows")).alias("column_cover"),
    )


def position_medians(rows: DataFrame, group: str, pos: str, value: str) -> DataFrame:
    """The median of each position, NULL where it has no value; no task needs all values of one."""
    return by_group(rows.select(group, pos).distinct(), quantiles(rows, [group, pos], value, {"median": 0.5}), [group, pos])


def group_median(rows: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """`rows` with their group's median; an aggregate joined back, so a large group is no single task."""
    return by_group(rows, quantiles(rows, [group], value, {name: 0.5}), [group])


def window_medians(medians: DataFrame, group: str, pos: str, value: str = "median", width: int = WIDTH) -> DataFrame:
    """At each of a group's positions the median over `width` of them, the window shifted inward at the borders.

    Positions are 0..L-1 with L one more than the group's largest; a group shorter than the window is
    one window.  Positions without a value count for nothing.
    """
    length = Window.partitionBy(group)
    half = width // 2
    n = F.max(pos).over(length) + 1
    low = F.greatest(F.lit(0), F.least(F.col(pos) - half, n - width))
    spans = medians.select(group, pos, value, low.alias("_low"), F.least(n - 1, low + width - 1).alias("_high"))
    near = [F.struct(F.col(pos).alias("p"), F.col(value).alias("v"))]
    # a shifted window lies within width - 1 positions on either side
    around = Window.partitionBy(group).orderBy(pos).rangeBetween(-(width - 1), width - 1)
    held = spans.withColumn("_all", F.collect_list(*near).over(around))
    inside = F.array_sort(F.transform(F.filter("_all", lambda s: s["p"].between(F.col("_low"), F.col("_high")) & s["v"].isNotNull()), lambda s: s["v"]))
    held = held.withColumn("_in", inside)
    size = F.size("_in")
    mid = (F.get("_in", F.floor((size - 1) / 2).cast("int")) + F.get("_in", F.floor(size / 2).cast("int"))) / 2
    return held.select(group, pos, value, mid.alias("window_median"))


def effective_number(similarity: np.ndarray, table: tuple[float, ...] = EFFECTIVE) -> np.ndarray:
    """The effective number of sequences by their similarity."""
    scaled = similarity / 0.5 - 2
    whole = np.floor(np.maximum(scaled, 0))
    at = np.clip(np.floor(2 * (np.maximum(scaled, 0) - whole)) + whole, 0, len(table) - 1).astype(int)
    inside = np.array(table)[at]
    return np.where(similarity == 0, 0.0, np.where(similarity < 1, 1.0, np.where(similarity < MOST_SIMILAR, inside, MOST_EFFECTIVE)))


def similarities(codes: np.ndarray) -> np.ndarray:
    """[pos, residue]: among rows with the residue at pos, the mean number of distinct residues in columns that have any.

    codes: [rows, columns], -1 for a gap.  Residues of a column are bits, so a set of rows is an OR.
    """
    bits = np.where(codes >= 0, np.int64(1) << np.maximum(codes, 0), 0)
    out = np.zeros((codes.shape[1], len(RESIDUES)))
    for pos in range(codes.shape[1]):
        for residue in np.unique(codes[:, pos]):
            if residue < 0:
                continue
            rows = np.flatnonzero(codes[:, pos] == residue)
            if len(rows) == 1:
                out[pos, residue] = 1
                continue
            present = np.bitwise_or.reduce(bits[rows], axis=0)
            distinct = np.bitwise_count(present)
            some = distinct > 0
            out[pos, residue] = distinct[some].sum() / some.sum()
    return out


def profile(codes: np.ndarray, table: tuple[float, ...] = EFFECTIVE) -> np.ndarray:
    """Log-odds scores [pos, residue] of a small alignment in memory, to three places; a column of gaps scores 0. `profiles` has them as columns."""
    background = np.array(BACKGROUND)
    each = effective_number(similarities(codes), table)
    total = each.sum(1, keepdims=True)
    share = np.where(total > 0, each / np.where(total > 0, total, 1), background)
    pseudo = background * (share @ np.exp(SCALE * np.array(blosum(), float)).T)
    extra = PSEUDO * np.sqrt(total)
    below = total - 1 + extra
    odds = ((total - 1) * share + extra * pseudo) / np.where(below == 0, 1, below) / background
    return np.round(np.where(total > 0, np.log(np.maximum(odds, 1e-300)), 0.0), 3)


#: Rows of an alignment, and cells of unions of residues, that one task holds at a time.
ROWS, CELLS = 4096, 1 << 22

_CODE = np.full(256, -1, np.int64)
for _i, _c in enumerate(RESIDUES):
    _CODE[[ord(_c), ord(_c.lower())]] = _i


def _unions(batches: Iterator[pa.RecordBatch], group: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Of each block of rows and of columns: for each column and residue the rows that have it, and the residues that those have in every column, as bits."""
    names = ["g", "pos", "code", "n", "bits"]
    key, unions, counts, first = None, None, None, 0

    def given() -> pa.RecordBatch:
        at, code = np.nonzero(counts)
        bits = [unions[i, c].tobytes() for i, c in zip(at, code)]
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(at), group), pa.array((at + first).astype(np.int32)), pa.array(code.astype(np.int32)), pa.array(counts[at, code]), pa.array(bits, pa.binary())], names)

    for batch in batches:
        for g, rb, pb, width, size, text in zip(*(batch.column(c).to_pylist() for c in ("g", "rb", "pb", "width", "size", "text"))):
            if (g, rb, pb) != key:
                if key is not None:
                    yield given()
                key, first = (g, rb, pb), pb * size
                unions, counts = np.zeros((min(size, width - first), len(RESIDUES), width), np.int32), np.zeros((min(size, width - first), len(RESIDUES)), np.int64)
            codes = np.full(width, -1)
            own = np.frombuffer(text.encode("latin-1", "replace"), np.uint8)
            codes[: len(own)] = _CODE[own]
            row = np.where(codes >= 0, 1 << np.maximum(codes, 0), 0).astype(np.int32)
            at = np.flatnonzero(codes[first : first + size] >= 0)
            code = codes[first + at]
            unions[at, code] |= row
            counts[at, code] += 1
    if key is not None:
        yield given()


def _similar(batches: Iterator[pa.RecordBatch], group: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Of each column and residue, from its blocks of rows one after the other: rows, and the mean number of distinct residues in columns that have any."""
    key, bits, n = None, None, 0
    out: list[tuple] = []

    def given() -> tuple:
        distinct = np.bitwise_count(bits)
        some = distinct > 0
        return *key, n, 1.0 if n == 1 else float(distinct[some].sum() / some.sum())

    def batch_of() -> pa.RecordBatch:
        kinds = [group, pa.int32(), pa.int32(), pa.int64(), pa.float64()]
        columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, ["g", "pos", "code", "n", "similarity"])

    for batch in batches:
        for *own, m, raw in zip(*(batch.column(c).to_pylist() for c in ("g", "pos", "code", "n", "bits"))):
            if own != key:
                if key is not None:
                    out.append(given())
                key, bits, n = own, np.zeros(len(raw) // 4, np.int32), 0
            bits, n = bits | np.frombuffer(raw, np.int32), n + m
            if len(out) >= 10_000:
                yield batch_of()
    if key is not None:
        out.append(given())
    if out:
        yield batch_of()


def residue_similarities(rows: DataFrame, group: str = "prot_id", row: str = "row_nr", aligned: str = "aligned") -> DataFrame:
    """Group, pos, code (place in RESIDUES), n (rows with the residue at pos) and similarity.

    An alignment is cut into blocks of rows, and those into blocks of columns, each read with all of its
    rows' residues; unions of blocks are joined by column and residue.  So one protein is many tasks,
    and a task holds CELLS cells however many rows and columns there are.
    """
    kind = rows.schema[group].dataType
    own = rows.select(F.col(group).alias("g"), F.col(row).alias("r"), F.coalesce(aligned, F.lit("")).alias("text"))
    sizes = own.groupBy("g").agg(F.max(F.length("text")).alias("width"), F.count("*").alias("m"))
    held = by_group(own, sizes, ["g"], "inner").where("width > 0")
    held = held.withColumns({"size": F.least(F.lit(64), F.greatest(F.lit(1), F.floor(F.lit(CELLS) / (F.col("width") * len(RESIDUES))))).cast("int"), "rb": F.pmod(F.xxhash64(F.lit(3), "r"), F.ceil(F.col("m") / ROWS))})
    cut = held.select("g", "rb", F.explode(F.sequence(F.lit(0), F.floor((F.col("width") - 1) / F.col("size")).cast("int"))).alias("pb"), "width", "size", "text")
    arrow = to_arrow_type(kind)
    parts = cut.repartition("g", "rb", "pb").sortWithinPartitions("g", "rb", "pb").mapInArrow(lambda x: _unions(x, arrow), f"g {kind.simpleString()}, pos int, code int, n long, bits binary")
    joined = parts.repartition("g", "pos").sortWithinPartitions("g", "pos", "code")
    return joined.mapInArrow(lambda x: _similar(x, arrow), f"g {kind.simpleString()}, pos int, code int, n long, similarity double").withColumnRenamed("g", group)


def _effective(similarity: Column, table: tuple[float, ...]) -> Column:
    """A38 as a column."""
    scaled = F.greatest(similarity / 0.5 - 2, F.lit(0.0))
    at = F.floor(2 * (scaled - F.floor(scaled))) + F.floor(scaled)
    inside = F.get(F.array(*map(F.lit, table)), F.least(at, F.lit(len(table) - 1)).cast("int"))
    return F.when(similarity == 0, 0.0).when(similarity < 1, 1.0).when(similarity < MOST_SIMILAR, inside).otherwise(MOST_EFFECTIVE)


def profiles(rows: DataFrame, table: tuple[float, ...] = EFFECTIVE, group: str = "prot_id", row: str = "row_nr", aligned: str = "aligned") -> DataFrame:
    """A36-A40 by group: pos, aa, score and n_rows (rows with a residue in the column), for every column and residue; a column of gaps scores 0."""
    found = written(residue_similarities(rows, group, row, aligned), "similar")
    entry = F.struct("code", _effective(F.col("similarity"), table).alias("e"))
    columns = found.groupBy(group, "pos").agg(F.map_from_entries(F.collect_list(entry)).alias("_e"), F.sum("n").alias("n_rows"))
    every = rows.groupBy(group).agg(F.max(F.length(aligned)).alias("_w")).where("_w > 0").select(group, F.explode(F.sequence(F.lit(0), F.col("_w") - 1)).alias("pos"))
    each = F.transform(F.sequence(F.lit(0), F.lit(len(RESIDUES) - 1)), lambda i: F.coalesce(F.element_at("_e", i), F.lit(0.0)))
    held = by_group(every, columns, [group, "pos"]).withColumns({"n_rows": F.coalesce("n_rows", F.lit(0).cast("long")), "_each": each})
    held = held.withColumn("_total", F.aggregate("_each", F.lit(0.0), lambda a, x: a + x))
    held = held.withColumn("_share", F.when(F.col("_total") > 0, F.transform("_each", lambda x: x / F.col("_total"))).otherwise(F.array(*map(F.lit, BACKGROUND))))
    weights = np.exp(SCALE * np.array(blosum(), float))
    extra = PSEUDO * F.sqrt("_total")
    below = F.col("_total") - 1 + extra
    scores = []
    for i, (aa, share) in enumerate(zip(RESIDUES, BACKGROUND)):
        pseudo = share * F.aggregate(F.zip_with("_share", F.array(*[F.lit(float(w)) for w in weights[i]]), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
        odds = ((F.col("_total") - 1) * F.get("_share", F.lit(i)) + extra * pseudo) / F.when(below == 0, 1.0).otherwise(below) / share
        scores.append(F.struct(F.lit(aa).alias("aa"), F.when(F.col("_total") > 0, F.round(F.log(F.greatest(odds, F.lit(1e-300))), 3)).otherwise(0.0).alias("score")))
    return held.select(group, "pos", F.inline(F.array(*scores)), "n_rows").select(group, "pos", "aa", "score", "n_rows")


def profile_differences(variants: DataFrame, scores: DataFrame, group: str = "prot_id") -> DataFrame:
    """Scores of both residues of variants (group, pos, wt, mut), 0 for a missing wild type, -1 for a missing mutant, and their difference."""
    side = lambda k: scores.select(group, "pos", F.col("aa").alias(k), F.col("score").alias(f"{k}_score"))
    out = variants.join(side("wt"), [group, "pos", "wt"], "left").join(side("mut"), [group, "pos", "mut"], "left")
    wt, mut = F.coalesce("wt_score", F.lit(0.0)), F.coalesce("mut_score", F.lit(-1.0))
    return out.select(*variants.columns, wt.alias("wt_score"), mut.alias("mut_score"), (wt - mut).alias("difference"))


def seed_first(rows: DataFrame, seed: Column, group: str = "prot_id", row: str = "row_nr") -> DataFrame:
    """Rows of each group renumbered with the seed's first, the others in their order."""
    order = Window.partitionBy(group).orderBy((~seed).cast("int"), row)
    return rows.withColumn(row, (F.row_number().over(order) - 1).cast("int"))


def residue_codes(rows: DataFrame, column: str, name: str) -> DataFrame:
    """P29 as a column."""
    return rows.withColumn(name, residue_index(F.col(column)))


def _insertions(batches: Iterator[pa.RecordBatch], group: pa.DataType) -> Iterator[pa.RecordBatch]:
    """g, place and n: how many residues of a hit stand before the seed's residue `place`, for each pair."""
    for batch in batches:
        keys, places, sizes = [], [], []
        for g, query in zip(batch.column("g").to_pylist(), batch.column("query").to_pylist()):
            place = 0
            for part in re.findall("-+|[^-]+", query or ""):
                if part[0] == "-":
                    keys.append(g)
                    places.append(place)
                    sizes.append(len(part))
                else:
                    place += len(part)
        yield pa.RecordBatch.from_arrays([pa.array(keys, group), pa.array(places, pa.int32()), pa.array(sizes, pa.int32())], ["g", "place", "n"])


def spread(query: str, hit: str, seed: str, longest: dict[int, int]) -> str:
    """A hit's row of the assembled alignment: at every place of the seed as many columns as the longest insertion there has."""
    if query.replace("-", "") != seed:
        raise ValueError("a pair is aligned to another sequence than its seed")
    parts, place, inserted = [], 0, []
    for q, t in zip(query, hit.ljust(len(query), "-")):
        if q == "-":
            inserted.append(t)
            continue
        parts += ["".join(inserted).ljust(longest.get(place, 0), "-"), t]
        place, inserted = place + 1, []
    return "".join([*parts, "".join(inserted).ljust(longest.get(place, 0), "-")])


def assembled(seeds: DataFrame, pairs: DataFrame, group: str = "prot_id", seed: str = "seq", hit: str = "hit_id", query: str = "q_aln", target: str = "t_aln", rank: str | None = None) -> DataFrame:
    """Alignments out of pairwise ones with the seed in the middle: group, row_nr, seq_id, aligned; the seed is row 0.

    Insertions of all hits before a residue of the seed share columns, as many as the longest has, left
    to right.  Their lengths are one aggregate by group and place, so no task sees an alignment as a
    whole; rows are numbered by running totals over `rank` (or the hit's name), then by the hit's name and
    its row.  A hit of a group without seed is left out; one aligned to another sequence is an error.
    """
    kind = pairs.schema[group].dataType
    arrow = to_arrow_type(kind)
    own = pairs.select(F.col(group).alias("g"), F.col(hit).cast("string").alias("seq_id"), F.coalesce(query, F.lit("")).alias("query"), F.coalesce(target, F.lit("")).alias("hit"), (F.col(rank) if rank else F.lit(0)).alias("_rank"))
    longest = own.select("g", "query").mapInArrow(lambda x: _insertions(x, arrow), f"g {kind.simpleString()}, place int, n int")
    longest = longest.groupBy("g", "place").agg(F.max("n").alias("n")).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("place", "n"))).alias("longest"))
    known = seeds.select(F.col(group).alias("g"), F.coalesce(seed, F.lit("")).alias("seed")).join(longest, "g", "left")
    numbered = running(own, ["g", "_rank", "seq_id", "query", "hit"], {"_n": F.lit(1)})
    first = numbered.groupBy("g").agg(F.min("_n").alias("_first"))
    rows = numbered.join(first, "g").join(known, "g").select("g", (F.col("_n") - F.col("_first") + 1).cast("int").alias("row_nr"), "seq_id", "query", "hit", "seed", "longest")
    middle = known.select("g", F.lit(0).alias("row_nr"), F.col("g").cast("string").alias("seq_id"), F.col("seed").alias("query"), F.col("seed").alias("hit"), "seed", "longest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [spread(q, h, s, dict(n or ())) for q, h, s, n in zip(*(batch.column(c).to_pylist() for c in ("query", "hit", "seed", "longest")))]
            yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("row_nr"), batch.column("seq_id"), pa.array(texts, pa.string())], ["g", "row_nr", "seq_id", "aligned"])

    return middle.unionByName(rows).mapInArrow(run, f"g {kind.simpleString()}, row_nr int, seq_id string, aligned string").withColumnRenamed("g", group)

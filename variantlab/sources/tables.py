"""Tab-separated sample tables, splits, variant sets, profiles, matrices and search hits; and their writers.

Files are read as text columns in parallel, and typed by expressions over the whole column, so a
column's type doesn't depend on which row comes first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from variantlab.functions import expr
from variantlab.tables import running

# Header names that have a newer name.
SYNONYMS = {
    "WT Amino Acid": "Wildtype AA",
    "Mut Amino Acid": "Mutant AA",
    "Structure Location": "Structure location",
    "Mainchain Location": "Mainchain location",
    "Sidechain Location": "Sidechain location",
}


@dataclass(frozen=True)
class Roles:
    """Which columns, by number, hold a sample's parts; aac may be several, joined."""

    prot_id: int = 0
    aac: tuple[int, ...] = (1,)
    target: int | None = 2
    tags: int | None = 3
    structures: int | None = 4
    skipped: frozenset[int] = frozenset({0, 1, 2, 3, 4})


PROCESSED = Roles()
RAW = Roles(prot_id=1, aac=(3, 4, 5), target=None, tags=7, structures=19, skipped=frozenset({0, 1, 2, 4, 7, 19}))


def text_table(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """All columns as strings, under their newer names."""
    rows = spark.read.csv(path, sep="\t", header=header, inferSchema=False, enforceSchema=False, quote="")
    return rows.withColumnsRenamed({k: v for k, v in SYNONYMS.items() if k in rows.columns})


def inferred(rows: DataFrame, columns: list[str]) -> dict[str, str]:
    """Types of text columns by all their values: bigint if all cells that are given are, else double, else string. One scan."""
    cells = {c: expr.cell(F.col(f"`{c}`")) for c in columns}
    fits = lambda x, kind: F.coalesce(F.every(x.try_cast(kind).isNotNull() | x.isNull()), F.lit(True))
    row = rows.agg(*[fits(x, "bigint").alias(f"i{i}") for i, x in enumerate(cells.values())], *[fits(x, "double").alias(f"d{i}") for i, x in enumerate(cells.values())]).first()
    return {c: "bigint" if row[f"i{i}"] else "double" if row[f"d{i}"] else "string" for i, c in enumerate(columns)}


def feature_table(spark: SparkSession, path: str, roles: Roles = PROCESSED, target_tag: str | None = None) -> tuple[DataFrame, list[str]]:
    """Samples (prot_id, aac, target, tags, structures, then features) and the features' names.

    The target is the effect column's number, or the mean of a tag's numbers; failing both, text.
    """
    rows = text_table(spark, path)
    names = rows.columns
    features = [c for i, c in enumerate(names) if i not in roles.skipped]
    kinds = inferred(rows, features)
    col = lambda i: F.col(f"`{names[i]}`")
    tags = expr.cell(col(roles.tags)) if roles.tags is not None else F.lit(None).cast("string")
    target = expr.tag_effect(tags, target_tag) if target_tag else expr.as_real(col(roles.target)) if roles.target is not None else expr.tag_label(tags)
    structures = F.coalesce(col(roles.structures).try_cast("int"), F.lit(0)) if roles.structures is not None else F.lit(0)
    typed = [expr.cell(F.col(f"`{c}`")).try_cast(k).alias(c) if k != "string" else expr.cell(F.col(f"`{c}`")).alias(c) for c, k in kinds.items()]
    return rows.select(col(roles.prot_id).alias("prot_id"), F.concat(*map(col, roles.aac)).alias("aac"), target.alias("target"), tags.alias("tags"), structures.alias("structures"), *typed), features


def split_table(spark: SparkSession, path: str) -> DataFrame:
    """prot_id, aac, bin."""
    return spark.read.csv(path, sep="\t", schema="prot_id string, aac string, bin int")


def variant_sets(spark: SparkSession, path: str, target_tag: str | None = None) -> DataFrame:
    """prot_id, aacs (array), effect."""
    rows = text_table(spark, path).toDF("prot_id", "aacs", "tags")
    effect = expr.tag_effect(F.col("tags"), target_tag) if target_tag else expr.tag_label(F.col("tags"))
    return rows.select("prot_id", F.split("aacs", ":").alias("aacs"), effect.alias("effect"))


def profile_table(spark: SparkSession, path: str, prot_id: str) -> DataFrame:
    """prot_id, pos (from 0), aa, score of a profile file."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(parts.alias("p")).where(F.get("p", F.lit(0)).rlike(r"^\d+$") & (F.size("p") >= 21))
    cells = rows.select((F.col("p")[0].cast("int") - 1).alias("pos"), F.posexplode(F.slice("p", 2, 20)).alias("i", "s"))
    return cells.select(F.lit(prot_id).alias("prot_id"), "pos", F.substring(F.lit(expr.RESIDUES), F.col("i") + 1, F.lit(1)).alias("aa"), F.col("s").try_cast("double").alias("score"))


def effect_matrix(spark: SparkSession, path: str, prot_id: str, sequence: str) -> DataFrame:
    """prot_id, aac, value of a matrix with a row per mutant residue and a column per position; NA is left out."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(parts.alias("p")).where(F.size("p") == len(sequence) + 1)
    cells = rows.select(F.upper(F.translate(F.col("p")[0], '"', "")).alias("mut"), F.posexplode(F.slice("p", 2, len(sequence))).alias("i", "v"))
    wt = F.substring(F.lit(sequence), F.col("i") + 1, F.lit(1))
    out = cells.select(F.lit(prot_id).alias("prot_id"), expr.variant(wt, F.col("i") + 1, F.col("mut")).alias("aac"), F.col("v").try_cast("double").alias("value"))
    return out.where("value is not null")


#: Bytes of hit files whose hits a task takes, and the bits of a run of hits of one file split.
HITS, RUN = 32 << 20, 20


def search_hits(spark: SparkSession, path: str, most: int = 5000) -> DataFrame:
    """Query, target, tseq, rank; the first `most` hits of each query in file order. Hits of all files count (Q16).

    Files are numbered, so that no row carries its path, and their bytes say how many tasks share the hits.  Each
    query's first hits are taken from runs of 2^RUN hits, then from what these leave: no task has all hits of a query.
    """
    files = sorted(tuple(r) for r in spark.read.format("binaryFile").load(path).select("_metadata.file_path", "length").collect())
    numbers = F.broadcast(spark.createDataFrame([(name, i) for i, (name, _) in enumerate(files)], "_path string, _file int"))
    rows = spark.read.csv(path, sep="\t", schema="query string, target string, tseq string")
    placed = rows.select("*", F.monotonically_increasing_id().alias("_id"), F.col("_metadata.file_path").alias("_path")).join(numbers, "_path").drop("_path")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(n for _, n in files) // HITS))
    runs = placed.withColumn("_run", F.shiftright("_id", RUN))
    for by in (["query", "_run"], ["query"]):
        place = F.row_number().over(Window.partitionBy(*by).orderBy("_file", "_id"))
        runs = runs.repartition(tasks, *by).withColumn("rank", place).where(F.col("rank") <= most)
    return runs.select(*rows.columns, "rank")


def names_list(spark: SparkSession, path: str) -> DataFrame:
    """One name per line, without blanks and comments."""
    name = F.trim("value").alias("name")
    return spark.read.text(path).select(name).where((F.col("name") != "") & ~F.col("name").startswith("#"))


def write_samples(samples: DataFrame, path: str, by: str | None = None) -> None:
    """A tab-separated table with a header, a folder per class with `by`; NULLs are written as None."""
    out = samples.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("None")).alias(c) for c in samples.columns])
    writer = out.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "")
    (writer.partitionBy(by) if by else writer).csv(path)


def write_packed(samples: DataFrame, path: str) -> None:
    """Samples with their types, packed."""
    samples.write.mode("overwrite").parquet(path)


def packed(spark: SparkSession, path: str) -> DataFrame:
    """K02, read back."""
    return spark.read.parquet(path)


def write_predictions(predictions: DataFrame, path: str, target: str = "target", prediction: str = "prediction", first: bool = True) -> None:
    """Predictions with their absolute error; later folds are appended to the first."""
    out = predictions.withColumn("Error", F.abs(F.col(target) - F.col(prediction)))
    out.write.mode("overwrite" if first else "append").option("sep", "\t").option("header", True).csv(path)


def profile_lines(scores: DataFrame) -> DataFrame:
    """The lines of a profile file, in order of `pos`."""
    cells = F.transform(F.sort_array(F.collect_list(F.struct(F.instr(F.lit(expr.RESIDUES), F.col("aa")).alias("i"), "score"))), lambda s: F.format_string("%+5.3f", s["score"]))
    rows = scores.groupBy("prot_id", "pos").agg(cells.alias("c"), F.max("n_rows").alias("n"))
    return rows.select("prot_id", "pos", F.format_string("%04d %s   %3d", F.col("pos") + 1, F.array_join("c", " "), "n").alias("line"))


def blast_hits(spark: SparkSession, path: str) -> DataFrame:
    """Target, length and hit sequence of each hit of XML search reports."""
    hits = spark.read.format("xml").option("rowTag", "Hit").schema("Hit_id string, Hit_def string, Hit_len int, Hit_hsps struct<Hsp: array<struct<Hsp_evalue: double, Hsp_hseq: string>>>").load(path)
    first = F.get("Hit_hsps.Hsp", F.lit(0))
    return hits.select(F.coalesce(F.get(F.split("Hit_id", r"\|"), F.lit(1)), F.col("Hit_id")).alias("target"), F.col("Hit_len").alias("length"), first["Hsp_evalue"].alias("evalue"), F.replace(first["Hsp_hseq"], F.lit("-"), F.lit("")).alias("tseq"))


def block_alignment(spark: SparkSession, path: str, prot_id: str) -> DataFrame:
    """prot_id, row_nr, seq_id, aligned of a block-wise alignment: lines of a name and residues, a row's blocks in file order."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), F.col("value").startswith(" ").alias("marks"), parts.alias("p"))
    lines = lines.where((F.size("p") == 2) & ~F.col("marks")).select("n", F.col("p")[0].alias("seq_id"), F.col("p")[1].alias("part"))
    rows = lines.groupBy("seq_id").agg(F.min("n").alias("_first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda s: s["part"]), "").alias("aligned"))
    placed = running(rows, ["_first"], {"_n": F.lit(1)})
    return placed.select(F.lit(prot_id).alias("prot_id"), (F.col("_n") - 1).cast("int").alias("row_nr"), "seq_id", "aligned")


def substitution_matrix(text: str) -> dict[tuple[str, str], float]:
    """Scores by residue pair of a matrix text whose first plain line names the columns."""
    lines = [x.split() for x in text.splitlines() if x.strip() and not x.startswith("#")]
    names = lines[0]
    return {(row[0], c): float(v) for row in lines[1:] for c, v in zip(names, row[1:])}


def results_by_group(spark: SparkSession, path: str, group: str, target: str, prediction: str) -> DataFrame:
    """Number of rows and Spearman by group of a predictions file."""
    from variantlab.operators.stats import group_spearman

    rows = text_table(spark, path).select(F.col(f"`{group}`").alias("group"), expr.as_real(F.col(f"`{target}`")).alias("y"), expr.as_real(F.col(f"`{prediction}`")).alias("p"))
    return group_spearman(rows, ["group"], "y", "p")


def missing(wanted: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows that a stored table lacks; compute these and append them."""
    return wanted.join(stored.select(key).distinct(), key, "left_anti")

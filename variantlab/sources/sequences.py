"""FASTA files as DataFrames, and back.

A file is split at record starts, so records of one large file are read by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def record_id(head: Column) -> Column:
    """The second field of a head with two bars or more, else its first token."""
    token = F.split(F.trim(head), r"\s+")[0]
    bars = F.split(token, r"\|")
    return F.when(F.size(bars) >= 3, bars[1]).otherwise(token)


def _records(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("v"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n"))
    parts = F.split("v", "\r?\n", 2)
    return rows.where(F.trim("v") != "").select("file", "n", parts[0].alias("head"), F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"[\s]", "").alias("body"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """prot_id, seq; upper case, without `/` and `*`."""
    return _records(spark, path).select(record_id(F.col("head")).alias("prot_id"), F.upper(F.translate("body", "/*", "")).alias("seq"))


def alignment(spark: SparkSession, path: str, prot_id: str | None = None) -> DataFrame:
    """prot_id, row_nr, seq_id, aligned of aligned FASTA; the first record of a file is row 0, its seed.

    Without a name the protein is the file's name up to its first dot; a folder or a pattern may be read.
    """
    from pyspark.sql import Window

    rows = _records(spark, path)
    name = F.lit(prot_id) if prot_id else F.regexp_extract("file", r"([^/]+?)(?:\.[^/]*)?$", 1)
    order = Window.partitionBy("file").orderBy("n")
    return rows.select(name.alias("prot_id"), (F.row_number().over(order) - 1).cast("int").alias("row_nr"), record_id(F.col("head")).alias("seq_id"), F.col("body").alias("aligned"))


def pairwise(spark: SparkSession, path: str) -> DataFrame:
    """hit_id, q_aln, t_aln of alternating query and hit records."""
    rows = alignment(spark, path).withColumn("pair", F.floor(F.col("row_nr") / 2))
    odd = F.col("row_nr") % 2 == 1
    return rows.groupBy("prot_id", "pair").agg(F.max(F.when(odd, F.col("seq_id"))).alias("hit_id"), F.max(F.when(~odd, F.col("aligned"))).alias("q_aln"), F.max(F.when(odd, F.col("aligned"))).alias("t_aln")).where("hit_id is not null")


def write_fasta(rows: DataFrame, path: str, name: str = "prot_id", sequence: str = "seq", order: str | None = None, compression: str | None = None) -> None:
    """One record per row, in `order` within files if given."""
    out = rows.sortWithinPartitions(order) if order else rows
    writer = out.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(sequence))).write.mode("overwrite")
    (writer.option("compression", compression) if compression else writer).text(path)


def write_shards(rows: DataFrame, path: str, shards: int = 240, name: str = "prot_id", sequence: str = "seq") -> None:
    """Files by ranges of the name, about equally many records in each."""
    write_fasta(rows.repartitionByRange(shards, name), path, name, sequence, name)


def with_canonical(rows: DataFrame, sequences: DataFrame, name: str = "prot_id") -> DataFrame:
    """The sequence of the id itself or, failing that, of the id without its isoform."""
    own = sequences.select(F.col("prot_id").alias(name), F.col("seq").alias("_own"))
    base = sequences.select(F.col("prot_id").alias("_base"), F.col("seq").alias("_base_seq"))
    out = rows.join(own, name, "left").withColumn("_base", F.substring_index(name, "-", 1)).join(base, "_base", "left")
    return out.withColumn("seq", F.coalesce("_own", "_base_seq")).drop("_own", "_base", "_base_seq")

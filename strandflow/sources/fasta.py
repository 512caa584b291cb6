"""FASTA and FASTQ files as tables, and record strings as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: offset of Phred qualities in FASTQ.
PHRED = 33


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, description, sequence): records begin with a `>` at the start of a line, wrapped lines are joined."""
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^\\s*>", "").alias("value")).where("trim(value) <> ''")
    head = F.regexp_extract("value", "^([^\n]*)", 1)
    return records.select(
        F.regexp_extract(head, r"^(\S*)", 1).alias("read_id"), F.trim(F.regexp_replace(head, r"^\S*", "")).alias("description"),
        F.regexp_replace(F.regexp_replace("value", "^[^\n]*\n?", ""), r"\s", "").alias("sequence"),
    )


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, description, sequence, quality_scores) of four-line records; qualities may hold any sign, `@` too.

    Lines are numbered within the stretches in which Spark reads a file, each in one task; the
    stretches' line counts give the numbers in the file. Blank lines at the end are no records.
    """
    split = ["file", "block"]
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("order"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = lines.groupBy(split).agg(F.count("*").alias("n")).select(*split, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy(split).orderBy("order")) - 1
    placed = lines.withColumn("line", within).join(counts, split).withColumn("line", F.col("line") + F.col("first"))
    part = lambda i: F.max(F.when(F.col("line") % 4 == i, F.regexp_replace("value", "\r$", "")))
    records = placed.groupBy("file", F.floor(F.col("line") / 4).alias("record")).agg(part(0).alias("head"), part(1).alias("sequence"), part(3).alias("quality"))
    quality = F.coalesce(F.col("quality"), F.lit(""))
    scores = F.when(F.length(quality) > 0, F.transform(F.split(quality, ""), lambda c: F.ascii(c) - PHRED)).otherwise(F.array().cast("array<int>"))
    return records.where("head LIKE '@%'").select(
        F.regexp_extract("head", r"^@(\S*)", 1).alias("read_id"), F.trim(F.regexp_replace("head", r"^@\S*", "")).alias("description"),
        F.coalesce("sequence", F.lit("")).alias("sequence"), scores.alias("quality_scores"))


def write_records(records: DataFrame, path: str, column: str = "record", *, order_by: str | None = None) -> None:
    """Write record strings as text, one file a partition; ordered over all files if asked for."""
    out = records.orderBy(order_by) if order_by else records
    out.select(column).write.mode("overwrite").text(path)

"""From raw documents to token ids in five stages, each written as Parquet and read again.

Every stage function takes (spark, docs, sf_dir) and works on all rows its predecessor
kept. All but the last return the columns of `docs`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.llm import bpe, decontam, jaccard, langid, pii
from strandflow.llm.queries import vocabulary
from strandflow.session import attach, materialize, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language the compressors cannot tell (null, no letter, or too narrow a margin)."""
    attach(spark)
    found = langid.identify(docs, langid.learn(docs.where(~langid.held_out())))
    return found.where("NOT rejected").select(*docs.columns)


#: Near duplicates share this fraction of their shingles of so many words.
SHINGLE, NEAR = 5, (80, 100)
HAS_WORD = r"[^\x20\x09-\x0D]"


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near duplicates, that of the least doc_id (null comes last); rows without words stay.

    Rows are told apart by doc_id where it is unique and never null; else they are numbered in a written
    copy, so that repeated rows and texts of one id are judged each for itself.
    """
    attach(spark)
    key = "row_key"
    while key in docs.columns:
        key += "_"
    if docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        rows = docs.withColumn(key, F.col("doc_id").cast("long"))
    else:
        rows = materialize(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    worded = F.coalesce(F.col("text").rlike(HAS_WORD), F.lit(False))
    groups = jaccard.jaccard_components(rows.where(worded), id_col=key, shingle=SHINGLE, threshold=NEAR).select(F.col("doc_id").alias(key), "component_id")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(key).alias("row")).alias("place")
    first = rows.where(worded).select(key, place).join(groups, key).groupBy("component_id").agg(F.min("place").alias("place"))
    kept = first.select(F.col("place.row").alias(key))
    return rows.where(worded).join(kept, key, "left_semi").unionByName(rows.where(~worded)).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item; null and empty texts hold none and stay."""
    attach(spark)
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("hit_words") == 0).select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; n_chars follows the text. Null and empty texts stay as they are."""
    attach(spark)
    out = pii.redact(docs, pii.learn(docs))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids (little-endian unsigned 32-bit), n_tokens, and digests of ids and of their decoded text; a null text is empty."""
    attach(spark)
    both = bpe.encode_documents(docs.select("doc_id", "text"), vocabulary(), decoded_col="decoded")
    return both.select("doc_id", "token_ids", *bpe.digest_columns())


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("PII", redact),
    ("BPE", tokenize),
]

#: SQL can express neither the compressors, the random field nor the encoder; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs

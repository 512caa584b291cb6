"""The registered queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from strandflow.llm import anngraph, blocknorm, bpe, chatformat, decontam, hilbert, jaccard, langid, merkle, pii, runindex, sharding, toxicity
from strandflow.session import table


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public vocabulary file on the driver."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"/opt/tokenizers/{name}"


def op1_decontaminate(spark, sf_dir):
    return decontam.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_shard(spark, sf_dir):
    return sharding.digest(table(spark, sf_dir, "documents"))


def op3_repeated_substrings(spark, sf_dir):
    return runindex.digest(table(spark, sf_dir, "documents"))


def op4_language_id(spark, sf_dir):
    return langid.digest(table(spark, sf_dir, "documents"))


def op5_embedding_links(spark, sf_dir):
    return anngraph.digest(table(spark, sf_dir, "embeddings"))


def op6_toxicity(spark, sf_dir):
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pii(spark, sf_dir):
    return pii.digest(table(spark, sf_dir, "documents"))


def op8_chat_format(spark, sf_dir):
    return chatformat.digest(table(spark, sf_dir, "conversations"))


def op9_bpe(spark, sf_dir):
    return bpe.digest(table(spark, sf_dir, "documents"), vocabulary())


def op10_ngram_jaccard(spark, sf_dir):
    return jaccard.digest(table(spark, sf_dir, "documents"))


def op11_centroids(spark, sf_dir):
    return blocknorm.digest(table(spark, sf_dir, "embeddings"))


def op12_nearest(spark, sf_dir):
    return hilbert.digest(table(spark, sf_dir, "embeddings"))


def op13_manifest(spark, sf_dir):
    return merkle.digest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_shard, op3_repeated_substrings, op4_language_id, op5_embedding_links, op6_toxicity, op7_pii, op8_chat_format, op9_bpe, op10_ngram_jaccard, op11_centroids, op12_nearest, op13_manifest)}

ORACLES = {"op1_decontaminate": decontam.ORACLE, "op2_shard": sharding.ORACLE, "op3_repeated_substrings": runindex.ORACLE, "op5_embedding_links": anngraph.ORACLE, "op8_chat_format": chatformat.ORACLE, "op10_ngram_jaccard": jaccard.ORACLE, "op11_centroids": blocknorm.ORACLE, "op12_nearest": hilbert.ORACLE, "op13_manifest": merkle.ORACLE}

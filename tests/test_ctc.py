import numpy as np
import pytest
from pyspark.sql import functions as F

from strandflow.functions import ctc, records
from strandflow.operators import basecall


def matrix(*runs):
    rows = []
    for label, n in runs:
        for _ in range(n):
            rows.append([0.0 if c == label else -10.0 for c in range(5)])
    return rows


CASES = {
    "simple": ([(0, 3), (1, 2), (2, 3), (3, 2), (4, 10)], "ATCG"),
    "blank": ([(4, 10)], ""),
    "repeat": ([(0, 5), (4, 5), (0, 5)], "AA"),
    "single": ([(2, 5)], "C"),
    "empty": ([], ""),
}


def test_decoding(spark):
    df = spark.createDataFrame([(k, matrix(*v[0])) for k, v in CASES.items()], "read_id string, lp array<array<double>>")
    got = {r["read_id"]: r for r in basecall.decode(df).collect()}
    for name, (_, want) in CASES.items():
        assert got[name]["sequence"] == want
    assert got["blank"]["mean_confidence"] == 0.0 and got["single"]["mean_confidence"] == 1.0


def test_timesteps_have_inclusive_ends(spark):
    df = spark.createDataFrame([(matrix((0, 5), (4, 2), (1, 5), (4, 18)),)], "lp array<array<double>>")
    runs = df.select(ctc.runs(F.col("lp"))).first()[0]
    assert [(r["label"], r["start"], r["end"]) for r in runs] == [(0, 0, 4), (1, 7, 11)]


def test_quality(spark):
    df = spark.createDataFrame([(0.9,), (0.5,), (1.0,)], "p double")
    np.testing.assert_allclose([r[0] for r in df.select(ctc.quality(F.col("p"))).collect()], [10, 3.0103, 100], rtol=1e-4)


def test_records(spark):
    df = spark.createDataFrame([("r", "ATCG", 0.95, [30.0, 35.0, 28.9, 45.0]), ("s", "ATCG", 0.0, None)], "id string, seq string, p double, q array<double>")
    rows = df.select(records.fasta(F.col("id"), F.col("seq"), F.col("p")), records.fastq(F.col("id"), F.col("seq"), F.col("q"))).collect()
    assert rows[0][0] == ">r mean_q=0.950\nATCG" and rows[1][0] == ">s\nATCG"
    assert rows[0][1] == "@r\nATCG\n+\n?D=I" and rows[1][1] == "@s\nATCG\n+\nIIII"


def test_contig_records_wrap(spark):
    df = spark.createDataFrame([("A" * 160, True), ("A" * 81, False)], "s string, c boolean")
    a, b = (r[0] for r in df.select(records.contig_fasta(F.lit("x"), F.col("s"), F.lit(2.0), F.col("c"))).collect())
    assert a == ">x length=160 depth=2.00 circular=yes\n" + "A" * 80 + "\n" + "A" * 80
    assert b.split("\n")[1:] == ["A" * 80, "A"]


def test_summary(spark):
    calls = spark.createDataFrame([(4, 10, 0.5), (0, 5, 0.0)], "num_bases int, signal_length int, mean_confidence double")
    assert tuple(basecall.summary(calls).first()) == (2, 4, 15, 2.0, 0.5)
    assert tuple(basecall.summary(calls.limit(0)).first()) == (0, 0, 0, 0.0, 0.0)


def test_lengths_blank_and_padding(spark):
    rows = [("a", matrix((0, 10), (4, 90)), 15), ("b", matrix((1, 5), (4, 2), (2, 5)), 6), ("c", matrix((1, 5), (4, 2), (2, 5)), None), ("d", matrix((2, 4)), 0)]
    df = spark.createDataFrame(rows, "read_id string, lp array<array<double>>, n int")
    got = {r["read_id"]: r["sequence"] for r in basecall.decode(df, length="n").collect()}
    assert got == {"a": "A", "b": "T", "c": "TC", "d": ""}
    padded = basecall.decode_padded(df, length="n")
    assert {r["read_id"]: (r["labels"], r["n_labels"]) for r in padded.collect()} == {"a": ([0, 4], 1), "b": ([1, 4], 1), "c": ([1, 2], 2), "d": ([4, 4], 0)}
    assert {r["read_id"]: r["sequence"] for r in basecall.padded_to_sequence(padded).collect()} == got
    other = basecall.GreedyDecoder(blank=0, alphabet="-ACGT")
    assert {r["read_id"]: r["sequence"] for r in basecall.decode(df, other, "n").collect()}["a"] == "T"

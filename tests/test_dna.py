import random

import pytest
from pyspark.sql import functions as F

from strandflow.functions import dna
from strandflow.operators.kmers import count_kmers


def reads(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "read_id int, sequence string")


def first(df):
    return df.first()[0]


def test_codes_and_complements(spark):
    df = reads(spark, "ATCG")
    assert first(df.select(dna.encode(F.col("sequence")))) == 27
    assert first(df.select(dna.decode(F.lit(27).cast("long"), 4))) == "ATCG"
    assert first(df.select(dna.reverse_complement(F.col("sequence")))) == "CGAT"
    assert first(reads(spark, "ATxg").select(dna.reverse_complement(F.col("sequence")))) == "NNAT"
    code = dna.encode(F.col("sequence"))
    assert first(df.select(dna.reverse_complement_code(dna.reverse_complement_code(code, 4), 4))) == 27


def test_nodes_of_a_kmer(spark):
    df = reads(spark, "ATCGA").select(dna.encode(F.col("sequence")).alias("c"))
    src, dst = dna.prefix(F.col("c")), dna.suffix(F.col("c"), 5)
    row = df.select(dna.decode(src, 4), dna.decode(dst, 4), dna.edge_code(src, dst) == F.col("c")).first()
    assert tuple(row) == ("ATCG", "TCGA", True)


def test_counts(spark):
    got = {r[0]: r[1] for r in count_kmers(reads(spark, "ATCG", "TCGA", "CGAT"), 3).select(dna.decode(F.col("kmer"), 3), "cnt").collect()}
    assert got == {"ATC": 1, "TCG": 2, "CGA": 2, "GAT": 1}
    got = {r[0]: r[1] for r in count_kmers(reads(spark, "ATCG", "ATCG", "CGAT"), 3, 2).select(dna.decode(F.col("kmer"), 3), "cnt").collect()}
    assert got == {"ATC": 2, "TCG": 2}


def test_short_null_and_empty_reads_have_no_kmers(spark):
    df = spark.createDataFrame([(0, None), (1, ""), (2, "AT"), (3, "ATC")], "read_id int, sequence string")
    assert [(r[0], r[1]) for r in df.select("read_id", F.size(dna.kmers(F.col("sequence"), 3))).orderBy("read_id").collect()] == [(0, 0), (1, 0), (2, 0), (3, 1)]
    assert count_kmers(df.limit(0), 3).count() == 0


@pytest.mark.parametrize("k", [1, 2, 32, 50])
def test_k_is_checked(spark, k):
    with pytest.raises(ValueError):
        dna.check_k(k)


def test_canonical_counts_match_brute_force(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ATCG") for _ in range(60)) for _ in range(5)]
    k, order, flip = 5, "ATCG", str.maketrans("ATCG", "TAGC")
    want = {}
    code = lambda s: sum(order.index(c) * 4 ** (k - 1 - i) for i, c in enumerate(s))
    for t in texts:
        for i in range(len(t) - k + 1):
            w = t[i : i + k]
            c = min(code(w), code(w[::-1].translate(flip)))
            want[c] = want.get(c, 0) + 1
    assert {r[0]: r[1] for r in count_kmers(reads(spark, *texts), k, canonical=True).collect()} == want


def test_labels(spark):
    df = spark.createDataFrame([([0, 4, 1, 4, 2], "atXn")], "l array<int>, s string")
    row = df.select(dna.bases_of_labels(F.col("l")), dna.bases_of_labels(F.col("l"), "N"), dna.labels_of_bases(F.col("s"))).first()
    assert row[0] == "ATC" and row[1] == "ANTNC" and row[2] == [0, 1]


def test_gc(spark):
    assert [round(r[0], 4) for r in reads(spark, "GGCA", "", "AT").select(dna.gc_content(F.col("sequence"))).collect()] == [0.75, 0, 0]


def test_codes_of_32_bases(spark):
    rng = random.Random(32)
    texts = ["".join(rng.choice("ATCG") for _ in range(32)) for _ in range(50)] + ["G" * 32, "A" * 32, "C" * 32, "T" * 32]
    back = lambda t: t[::-1].translate(str.maketrans("ATCG", "TAGC"))
    number = lambda t: int(t.translate(str.maketrans("ATCG", "0123")), 4)
    signed = lambda n: n - (1 << 64) if n >> 63 else n
    code = F.col("code")
    df = spark.createDataFrame([(t,) for t in texts], "s string").withColumn("code", dna.encode(F.col("s")))
    for r in df.select("s", "code", dna.decode(code, 32).alias("d"), dna.reverse_complement_code(code, 32).alias("rc"), dna.canonical(code, 32).alias("c"), dna.prefix(code).alias("p"), dna.suffix(code, 32).alias("x"), dna.edge_code(dna.prefix(code), dna.suffix(code, 32)).alias("e")).collect():
        n, rc = number(r["s"]), number(back(r["s"]))
        assert (r["code"], r["d"], r["rc"], r["c"]) == (signed(n), r["s"], signed(rc), signed(min(n, rc)))
        assert (r["p"], r["x"], r["e"]) == (n >> 2, n & ((1 << 62) - 1), r["code"])


def test_kmer_arrays_equal_the_column_function(spark):
    from strandflow.operators import kmers

    rows = [(1, "ATCGGCTA"), (2, "AT"), (3, None), (4, ""), (5, "ggnATCCC"), (6, "TTTTT")]
    reads = spark.createDataFrame(rows, "read_id long, sequence string")
    want = {r.read_id: r.c for r in reads.select("read_id", dna.kmers(F.col("sequence"), 5).alias("c")).collect()}
    assert {r.read_id: r.codes for r in kmers.kmer_arrays(reads, 5).collect()} == want

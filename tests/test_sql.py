"""Functions called from SQL text, against the column functions."""

import pytest
from pyspark.sql import functions as F

from strandflow import sql
from strandflow.functions import ctc, dna
from strandflow.functions import signal as S


@pytest.fixture
def known(spark):
    sql.register(spark)
    sql.register(spark)  # again is no error
    return spark


def test_scalars(known):
    df = known.createDataFrame([("ATCGN", [3.0, 1.0, 2.0, 10.0], 0.9), ("gc", [], 1.0), ("", [5.0], 0.0), (None, None, None)], "s string, a array<double>, p double")
    got = known.sql("SELECT reverse_complement(s), gc_content(s), signal_median(a), signal_mad(a), signal_normalize(a, 2D), basecall_quality(p), clean_bases(s) FROM {df}", df=df).collect()
    a = F.col("a")
    want = df.select(dna.reverse_complement(F.upper("s")), dna.gc_content(F.upper("s")), S.median(a), S.mad(a, S.median(a)), S.normalize(a, 2.0)["norm"], ctc.quality(F.col("p"))).collect()
    for g, w in zip(got, want):
        assert tuple(g)[:3] == tuple(w)[:3] and g[4] == w[4] and g[5] == (pytest.approx(w[5]) if w[5] is not None else None)
    assert [g[3] for g in got] == [1.0, None, S.LEAST_MAD, None] and [g[6] for g in got] == ["ATCG", "GC", "", None]


def test_kmers_and_chunks(known):
    df = known.createDataFrame([(1, "ATCGXA"), (2, "at"), (3, None), (4, "")], "id int, s string")
    rows = known.sql("SELECT id, k.* FROM {df}, LATERAL kmers(s, 3, true) AS k ORDER BY id, pos", df=df).collect()
    assert [r["kmer"] for r in rows] == ["ATC", "TCG", "CGA", "GAA"] and [r["pos"] for r in rows] == [0, 1, 2, 3]
    codes = df.where("id = 1").select(dna.kmers(F.col("s"), 3)).first()[0]
    assert [r["code"] for r in rows] == codes
    least = known.createDataFrame([(c,) for c in codes], "c long").select(dna.decode(dna.canonical(F.col("c"), 3), 3)).collect()
    assert [r["canonical"] for r in rows] == [r[0] for r in least]
    assert known.sql("SELECT * FROM {df}, LATERAL kmers(s, 40)", df=df).columns == ["id", "s", "pos", "kmer"]
    floats = known.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, []), (3, None)], "id int, a array<float>")
    got = known.sql("SELECT id, c.* FROM {df}, LATERAL signal_chunks(a, 2) AS c", df=floats)
    assert got.schema["chunk"].dataType.simpleString() == "array<float>"
    assert sorted(map(tuple, got.collect())) == [(1, 0, 2, [1.0, 2.0], False), (1, 2, 1, [3.0], True)]
    for bad in ("kmers(s, id)", "kmers(s, 0)", "kmers(id, 3)", "signal_chunks(s, 2)"):
        with pytest.raises(Exception):
            known.sql(f"SELECT * FROM {{df}}, LATERAL {bad}", df=df).collect()


def test_kmers_compare_strands_by_code():
    """Same rows as the plain comparison of both strands digit by digit, in much less time."""
    import random
    import time

    digit, pair = {b: i for i, b in enumerate(dna.BASES)}, str.maketrans("ATCG", "TAGC")

    def plain(s, k):
        s = "".join(b if b in digit else "A" for b in s.upper())
        words = [s[i : i + k] for i in range(len(s) - k + 1)]
        return [min(w, w.translate(pair)[::-1], key=lambda w: [digit[b] for b in w]) for w in words]

    rng = random.Random(3)
    for k in (1, 2, 11, 31, 40):
        for n in (0, 3, 11, 90):
            s = "".join(rng.choice("ATCGNatcgß") for _ in range(n))
            assert [r[-1] for r in sql.Kmers().eval(s, k, True)] == plain(s, k)
    s, times = "".join(rng.choice("ATCG") for _ in range(50_000)), {}
    for name, run in (("plain", lambda: plain(s, 11)), ("rows", lambda: list(sql.Kmers().eval(s, 11, True)))):
        laps = []
        for _ in range(3):
            began = time.process_time()
            run()
            laps.append(time.process_time() - began)
        times[name] = min(laps)
    assert times["rows"] < 0.7 * times["plain"], times

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandflow.functions import signal as S
from strandflow.operators import signals


def frame(spark, *arrays):
    return spark.createDataFrame([(i, [float(x) for x in a]) for i, a in enumerate(arrays)], "read_id int, signal array<double>")


def column(df, expr):
    return [r[0] for r in df.orderBy("read_id").select(expr).collect()]


def test_medians(spark):
    df = frame(spark, [3, 1, 4, 1, 5], [1, 2, 3, 4], [42], [-5, -2, -8, -1, -3], [])
    assert column(df, S.median(F.col("signal"))) == [3, 2.5, 42, -3, None]


def test_normalisation_matches_numpy_and_reverses(spark):
    x = np.random.default_rng(1).normal(100, 5, 301)
    x[7] += 500
    df = frame(spark, x, [10.0] * 9)
    n = df.orderBy("read_id").select(S.normalize(F.col("signal")).alias("n")).collect()
    m, d = np.median(x), np.median(np.abs(x - np.median(x)))
    assert n[0].n["median"] == pytest.approx(m) and n[0].n["mad"] == pytest.approx(d)
    np.testing.assert_allclose(n[0].n["norm"], np.clip((x - m) / (1.4826 * d), -5, 5))
    assert set(n[1].n["norm"]) == {0.0} and n[1].n["mad"] == 1e-8
    free = df.select("read_id", S.normalize(F.col("signal"), None).alias("n"))
    np.testing.assert_allclose(column(free, S.denormalize(F.col("n.norm"), F.col("n.median"), F.col("n.mad")))[0], x)


def test_chunks(spark):
    df = frame(spark, range(1000), [])
    c = column(df, S.chunks(F.col("signal"), 300))
    assert [(x["start"], len(x["chunk"])) for x in c[0]] == [(0, 300), (300, 300), (600, 300), (900, 100)] and c[1] == []


def test_windowed_normalisation_covers_the_tail(spark):
    x = np.random.default_rng(2).normal(0, 1, 47)
    got = signals.normalize_windowed(frame(spark, x), 20, 10).orderBy("pos").collect()
    total, n = np.zeros(47), np.zeros(47)
    for s in (0, 10, 20, 27):
        w = x[s : s + 20]
        total[s : s + 20] += np.clip((w - np.median(w)) / (1.4826 * np.median(np.abs(w - np.median(w)))), -5, 5)
        n[s : s + 20] += 1
    np.testing.assert_allclose([r["value"] for r in got], total / n)


def test_median_filter_takes_the_upper_median_at_edges(spark):
    x = [5.0, 1.0, 9.0, 2.0, 8.0, 3.0]
    want = [sorted(x[max(0, i - 2) : i + 3])[len(x[max(0, i - 2) : i + 3]) // 2] for i in range(6)]
    df = frame(spark, x, [])
    assert column(df, S.median_filter(F.col("signal"), 5)) == [want, []]
    assert [r["value"] for r in signals.median_filter_points(signals.long_form(df), 5).orderBy("pos").collect()] == want
    with pytest.raises(ValueError):
        S.median_filter(F.col("signal"), 4)


def test_spikes_are_bridged_and_plateaus_stay(spark):
    x = np.zeros(1000)
    x[[0, 100, 200, 999]] = 10.0
    x[300:400] = 10.0
    got = np.array([r["value"] for r in signals.repair_spikes(signals.long_form(frame(spark, x)), 5.0, 50).orderBy("pos").collect()])
    want = np.zeros(1000)
    want[300:400] = 10.0
    np.testing.assert_allclose(got, want)
    assert [r["value"] for r in signals.repair_spikes(signals.long_form(frame(spark, [9.0, 9.0])), 5.0).collect()] == [9.0, 9.0]


def test_trim(spark):
    x = np.concatenate([np.full(500, 5.0), np.zeros(2000)])
    df = frame(spark, x, [1.0] * 10, [])
    assert column(df, S.trim_position(F.col("signal"), 100, 0.01, 50)) == [450, 0, 0]
    assert len(column(df, S.trim(F.col("signal"), 100, 2.0, 50))[0]) == 2450


def test_regions_and_running_std(spark):
    x = np.full(5000, 2.0)
    x[1000:2000] = x[3000:4000] = 0.0
    found = signals.regions(signals.long_form(frame(spark, x))).orderBy("start").collect()
    assert [(r["start"], r["end"]) for r in found] == [(1000, 2000), (3000, 4000)]
    assert {r["value"] for r in signals.running_std(signals.long_form(frame(spark, [10.0] * 300))).collect()} == {0.0}


def test_batches_are_padded(spark):
    rows = signals.padded_batches(frame(spark, [1, 2, 3], [1], [1, 2], [5, 5, 5, 5, 5]), 2, 4).orderBy("read_id").collect()
    assert [(r["batch_id"], r["length"], len(r["signal"])) for r in rows] == [(0, 3, 3), (0, 1, 3), (1, 2, 4), (1, 4, 4)]


def test_preprocessing_modes(spark):
    df = frame(spark, np.random.default_rng(3).normal(90, 4, 600), [])
    for mode in ("global", "chunks", "windowed"):
        out = {r["read_id"]: r["signal"] for r in signals.preprocess(df, mode, chunk=200, window=200, step=100).collect()}
        assert len(out[0]) == 500 and out[1] == []
    with pytest.raises(ValueError):
        signals.preprocess(df, "other")


def test_batches_keep_whole_lengths_unless_cut(spark):
    from strandflow.operators import signals

    rows = [(i, [1.0] * (i * 20 + 1)) for i in range(10)]
    df = spark.createDataFrame(rows, "read_id long, signal array<double>")
    want = [(i // 4, i, i * 20 + 1, min(i // 4 * 4 + 3, 9) * 20 + 1) for i in range(10)]
    lengths = signals.batch_lengths(df.selectExpr("read_id", "size(signal) AS length"), 4)
    assert sorted(map(tuple, lengths.collect())) == want
    whole = signals.padded_batches(df, 4).selectExpr("batch_id", "read_id", "length", "size(signal) AS padded")
    assert sorted(map(tuple, whole.collect())) == want
    cut = signals.padded_batches(df, 4, 50).selectExpr("read_id", "length", "size(signal) AS padded").collect()
    assert sorted(map(tuple, cut)) == [(i, min(i * 20 + 1, 50), 50) for i in range(10)]


def test_no_read_is_lost_from_wide_batches(spark):
    df = spark.range(20_000).selectExpr("(id * 7919) % 20011 AS read_id", "transform(sequence(0, 63), i -> double(i)) AS signal").repartition(16)
    rows = signals.padded_batches(df, 32)
    assert rows.count() == rows.select("signal").count() == 20_000
    sizes = rows.groupBy("batch_id").count().collect()
    assert len(sizes) == 625 and {r["count"] for r in sizes} == {32}


def test_rows_of_one_read_id_stay_apart(spark):
    df = spark.createDataFrame([(1, [float(i) for i in range(30)]), (1, [float(-i * i) for i in range(40)])], "read_id long, signal array<double>")
    assert signals.normalize_windowed(df, 10, 5).count() == 70
    assert sorted(len(r["signal"]) for r in signals.preprocess(df, "windowed", window=10, step=5, trim_window=100).collect()) == [30, 40]


def test_denoising_reports_what_it_did(spark):
    x = np.zeros(300)
    x[100:104] = 9.0
    x[200:290] = 9.0
    df = frame(spark, x, [], np.ones(20))
    got = {r["read_id"]: r for r in signals.denoise(df).collect()}
    assert got[0]["stats"].asDict() == {"median_filter_applied": True, "spikes_removed": True, "n_spike_samples": 94, "spike_fraction": 94 / 300}
    assert max(got[0]["signal"][:150]) == 0.0 and max(got[0]["signal"]) == 9.0  # the long run stays
    assert got[1]["signal"] == [] and got[1]["stats"].asDict() == {"median_filter_applied": False, "spikes_removed": False, "n_spike_samples": 0, "spike_fraction": 0.0}
    assert got[2]["stats"]["spikes_removed"] is False and got[2]["signal"] == [1.0] * 20
    plain = signals.denoise(df, signals.Denoiser(apply_median_filter=False, remove_spikes=False)).collect()
    assert sorted(r["read_id"] for r in plain) == [0, 1, 2] and all(r["stats"]["n_spike_samples"] is None for r in plain)

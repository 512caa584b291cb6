"""Signals in segments, exact order statistics and numbering within keys, against the whole arrays."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandflow.functions import signal as S
from strandflow.operators import segments, signals
from strandflow.plans import selection
from strandflow.plans.numbering import number_within


@pytest.fixture(scope="module")
def whole(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i, n in enumerate((1, 2, 7, 8, 9, 40, 41, 150)):
        x = rng.normal(size=n).round(2)
        x[rng.random(n) < 0.3] = 9.0  # spikes
        if n == 150:
            x[20:60], x[100:] = 9.0, 0.1  # a run over several segments, one to the end
        rows.append((f"r{i}", x.tolist()))
    rows.append(("empty", []))
    return spark.createDataFrame(rows, "read_id string, signal array<double>").cache()


def points(df, *names):
    return sorted((r["read_id"], r["pos"], *(r[n] if isinstance(r[n], bool) else round(r[n], 9) for n in names)) for r in df.collect())


@pytest.mark.parametrize("size", [4, 1000])
def test_segments_equal_the_whole_signal(spark, whole, size):
    cut = segments.of_arrays(whole, size)
    assert all(len(r["values"]) <= size for r in cut.collect())
    every = signals.long_form(whole)
    assert points(segments.to_points(cut), "value") == points(every, "value")
    assert points(segments.to_points(segments.of_points(every, size)), "value") == points(every, "value")
    for kernel in (1, 21):
        want = signals.long_form(whole.select("read_id", S.median_filter(F.col("signal"), kernel).alias("signal")))
        assert points(segments.to_points(segments.median_filter(cut, kernel, size)), "value") == points(want, "value")
    assert points(segments.running_std(cut, 10, size), "value") == points(signals.running_std(every, 10), "value")
    for most in (2, 45):
        assert points(segments.repair_spikes(cut, 5.0, most, size), "value", "is_spike") == points(signals.repair_spikes(every, 5.0, most), "value", "is_spike")
    assert sorted(map(tuple, segments.regions(cut, 0.0, 0.5, 2).collect())) == sorted(map(tuple, signals.regions(every, 0.0, 0.5, 2).collect()))


@pytest.mark.parametrize("size", [4])
def test_trim_and_normalise(spark, whole, size):
    cut = segments.of_arrays(whole, size)
    found = segments.trim_position(cut, 5, 0.5, 3, size)
    want = {r["read_id"]: r["p"] for r in whole.select("read_id", S.trim_position(F.col("signal"), 5, 0.5, 3).alias("p")).collect()}
    assert {r["read_id"]: r["position"] for r in found.collect()} == {k: v for k, v in want.items() if k != "empty"}
    trimmed = segments.trim(cut, found, size)
    assert all(len(r["values"]) <= size and r["start"] == r["segment"] * size for r in trimmed.collect())
    assert points(segments.to_points(trimmed), "value") == points(signals.long_form(whole.select("read_id", S.trim(F.col("signal"), 5, 0.5, 3).alias("signal"))), "value")
    norm = signals.long_form(whole.select("read_id", S.normalize(F.col("signal"))["norm"].alias("signal")))
    for gathered in (0, 20):
        assert points(segments.to_points(segments.normalize(cut, gathered=gathered)), "value") == points(norm, "value")
    conf = signals.Denoiser(3, 5.0, 10)
    assert points(segments.denoise(cut, conf, size), "value") == points(signals.long_form(signals.denoise(whole, conf).select("read_id", "signal")), "value")


def test_halos_hold_no_more_than_they_should(spark):
    df = spark.createDataFrame([("a", [float(i) for i in range(50)])], "read_id string, signal array<double>")
    for halo in (0, 1, 3, 4, 9, 60):
        for r in segments.with_halos(segments.of_arrays(df, 4), halo, 4).collect():
            low, high = max(0, r["start"] - halo), min(50, r["start"] + len(r["values"]) + halo)
            assert r["around"] == [float(i) for i in range(low, high)] and r["before"] == r["start"] - low


def test_selected_ranks(spark):
    rng = np.random.default_rng(3)
    hot = np.concatenate([rng.normal(size=900), rng.normal(size=50) * 1e300, rng.normal(size=50) * 1e-300, [0.0, -0.0, np.inf, -np.inf, 5e-324, -5e-324], np.full(300, 0.25)])
    rows = [(0, float(x)) for x in hot] + [(k, float(x)) for k in range(1, 30) for x in rng.integers(-3, 4, k)] + [(99, None), (98, 7.0)]
    df = spark.createDataFrame(rows, "key int, value double")
    by = {}
    for k, x in rows:
        if x is not None:
            by.setdefault(k, []).append(x)
    assert {r["key"]: r["median"] for r in selection.medians(df).collect()} == {k: statistics.median(v) for k, v in by.items()}
    ranks = spark.createDataFrame([(0, r) for r in (0, 1, 13, 650, 1305)] + [(29, 28)], "key int, rank long")
    assert {(r["key"], r["rank"]): r["value"] for r in selection.select_ranks(df, ranks).collect()} == {(k, r): sorted(by[k])[r] for k, r in [(0, 0), (0, 1), (0, 13), (0, 650), (0, 1305), (29, 28)]}
    nan = spark.createDataFrame([(1, float("nan")), (1, 1.0), (1, float("inf"))], "key int, value double")
    assert [r["value"] for r in selection.select_ranks(nan, spark.createDataFrame([(1, 1)], "key int, rank long")).collect()] == [float("inf")]
    assert selection.medians(df.limit(0)).count() == 0


def test_stats_of_one_read_that_holds_all_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=20001).round(3)
    df = spark.createDataFrame([("hot", i, float(v)) for i, v in enumerate(x)] + [("b", 0, 1.0), (None, 0, 5.0), ("c", 0, None), ("c", 1, 2.0)], "read_id string, pos long, value double")
    for gathered in (100, 10**6):
        got = {r["read_id"]: r for r in signals.stats(df, gathered).collect()}
        assert set(got) == {"hot", "b", "c"} and got["hot"]["length"] == 20001 and got["b"]["mad"] == S.LEAST_MAD and got["c"]["median"] == 2.0
        assert got["hot"]["median"] == np.median(x) and got["hot"]["mad"] == pytest.approx(np.median(np.abs(x - np.median(x))), abs=1e-15)


def test_numbers_within_keys(spark):
    rng = np.random.default_rng(7)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.integers(40)}", int(rng.integers(1000)), i) for i in range(3000)] + [(None, 3, -1), (None, 1, -2)]
    got = number_within(spark.createDataFrame(rows, "k string, t int, i int").repartition(7), "k", "t", "i").collect()
    by = {}
    for k, t, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        by.setdefault(k, []).append(i)
    assert len(got) == len(rows) and all(by[r["k"]][r["pos"]] == r["i"] for r in got)


def test_what_is_known_of_many_keys_is_not_sent_to_the_driver(spark, monkeypatch):
    rng = random.Random(8)
    by = {k: [rng.uniform(-9, 9) for _ in range(rng.randint(1, 9))] for k in range(60)}
    df = spark.createDataFrame([(k, v) for k, vs in by.items() for v in vs], "key int, value double")
    center = {k: statistics.median(v) for k, v in by.items()}
    known = spark.createDataFrame(list(center.items()), "key int, median double")
    for most in (10, 100):
        monkeypatch.setattr(selection, "FEW", most, raising=False)
        far = selection.deviations(df, known)
        plan = far._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastExchange" in plan) == (most == 100)
        assert sorted(map(tuple, far.collect())) == sorted((k, abs(v - center[k])) for k, vs in by.items() for v in vs)
        assert {r["key"]: r["median"] for r in selection.medians(df).collect()} == center

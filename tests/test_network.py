import numpy as np
import pytest
from pyspark.sql import functions as F

from strandflow.operators import basecall, network


def test_shapes_and_sizes(spark):
    assert network.count_parameters() == 3_376_741
    c = network.NetConfig()
    assert [c.output_length(n) for n in (500, 1000, 2000)] == [63, 125, 250] and c.total_stride == 8
    got = spark.createDataFrame([(500,), (1000,), (2000,)], "n int").select(network.output_length(F.col("n"))).collect()
    assert [r[0] for r in got] == [63, 125, 250]
    with pytest.raises(ValueError):
        network.NetConfig(kernels=(5,))
    assert network.NetConfig.from_dict({"conv_channels": [8, 8], "kernels": [3, 3], "strides": [2, 2], "other": 1}).total_stride == 4


def test_forward_is_a_distribution(spark):
    small = network.NetConfig((4, 8), (5, 5), (2, 2), 8, 2)
    w = network.random_weights(small, 3)
    lp = network.forward(np.random.default_rng(0).normal(size=101), w, small)
    assert lp.shape == (small.output_length(101), 5)
    np.testing.assert_allclose(np.exp(lp).sum(1), 1, atol=1e-5)
    assert network.forward(np.zeros(0), w, small).shape == (0, 5)


def test_basecalls_of_a_table(spark):
    small = network.NetConfig((4,), (5,), (2,), 8, 1)
    x = np.random.default_rng(1).normal(80, 3, 700)
    df = spark.createDataFrame([("a", x.tolist()), ("b", [])], "read_id string, signal array<double>")
    rows = {r["read_id"]: r for r in basecall.basecall(df, network.random_weights(small), small).collect()}
    assert rows["b"]["sequence"] == "" and rows["b"]["mean_confidence"] == 0.0
    assert rows["a"]["signal_length"] == 700 and set(rows["a"]["sequence"]) <= set("ATCG")
    assert len(rows["a"]["quality_scores"]) == rows["a"]["num_bases"]


def test_signals_of_one_length_run_together():
    small = network.NetConfig((4, 8), (5, 5), (2, 2), 8, 2)
    w = network.random_weights(small, 3)
    x = np.random.default_rng(0).normal(size=(3, 101)).astype(np.float32)
    np.testing.assert_allclose(network.forward(x, w, small), [network.forward(r, w, small) for r in x], atol=1e-5)
    assert [len(lp) for lp in network._log_probs([x[0], x[1][:50], np.zeros(0, np.float32)], w, small)] == [small.output_length(101), small.output_length(50), 0]
    z = np.linspace(-4, 4, 200)
    np.testing.assert_allclose(network._erf(z), np.vectorize(__import__("math").erf)(z), atol=2e-7)
    block = {f"r{s}.{k}": v for s in "ab" for k, v in (("w", np.zeros((4, 4, 3))), ("scale", np.ones(4)), ("shift", np.zeros(4)))}
    np.testing.assert_allclose(network.residual_block(np.ones((2, 4, 9)), block, "r"), 1)


def test_repeated_and_null_ids_are_calls_of_their_own(spark):
    small = network.NetConfig((4,), (5,), (2,), 8, 1)
    rows = [("a", [float(i % 7) for i in range(600)]), ("a", [float(i % 5) for i in range(700)]), (None, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "read_id string, signal array<double>")
    out = basecall.basecall(df, network.random_weights(small), small).collect()
    assert sorted(r["signal_length"] for r in out) == [2, 600, 700]
    assert basecall.summary(spark.createDataFrame(out, "read_id string, sequence string, quality_scores array<double>, mean_confidence double, signal_length int, sequence_length int, num_bases int"), 2.0).first()["bases_per_second"] == sum(r["num_bases"] for r in out) / 2


def test_a_file_is_called_and_written(spark, tmp_path):
    small = network.NetConfig((4,), (5,), (2,), 8, 1)
    spark.createDataFrame([(i, [float((i * j) % 11) for j in range(300)]) for i in range(5)], "read_id long, signal array<double>").write.parquet(f"file://{tmp_path}/in")
    calls = basecall.basecall_file(spark, f"file://{tmp_path}/in", network.random_weights(small), small, source="parquet", max_reads=3, fastq=f"file://{tmp_path}/q", fasta=f"file://{tmp_path}/a")
    assert sorted(r["read_id"] for r in calls.collect()) == [0, 1, 2]
    assert spark.read.text(f"file://{tmp_path}/q").where("value LIKE '@%'").count() >= 3 and spark.read.text(f"file://{tmp_path}/a").where("value LIKE '>%'").count() == 3


def test_signals_of_any_lengths_run_together():
    """Packed steps and both directions, against one signal at a time and against plain loops over one step at a time."""
    rng = np.random.default_rng(4)
    for conf in (network.NetConfig((4, 8), (5, 3), (2, 2), 8, 2), network.NetConfig((3,), (5,), (1,), 4, 1)):
        w = network.random_weights(conf, 5)
        w |= {k: rng.normal(size=v.shape).astype(np.float32) * 0.3 for k, v in w.items() if k.split(".")[1] in ("shift", "bi", "bh", "b")}
        signals = [rng.normal(size=n).astype(np.float32) for n in (5, 0, 101, 1, 100, 37, 101, 2)]
        together = network.forward_packed(signals, w, conf)
        for x, lp in zip(signals, together):
            assert lp.shape == (conf.output_length(len(x)) if len(x) else 0, 5)
            if len(x):
                np.testing.assert_allclose(lp, network.forward_packed([x], w, conf)[0], atol=1e-5)
                np.testing.assert_allclose(lp, plain_forward(x, w, conf), atol=1e-4)


def plain_forward(x, w, conf):
    x = x[None].astype(np.float64)
    for i, (k, s) in enumerate(zip(conf.kernels, conf.strides)):
        x = np.pad(x, ((0, 0), ((k - 1) // 2,) * 2))
        y = np.array([[(x[:, t : t + k] * f).sum() for t in range(0, x.shape[1] - k + 1, s)] for f in w[f"conv{i}.w"]])
        y = y * (w[f"conv{i}.scale"] / np.sqrt(1 + 1e-5))[:, None] + w[f"conv{i}.shift"][:, None]
        x = 0.5 * y * (1 + np.vectorize(__import__("math").erf)(y / np.sqrt(2)))
    x = x.T
    logistic = lambda z: 1 / (1 + np.exp(-z))
    for i in range(conf.gru_layers):
        ways = []
        for d, steps in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
            h, out, n = np.zeros(conf.gru_hidden), np.zeros((len(x), conf.gru_hidden)), conf.gru_hidden
            for t in steps:
                a, b = w[f"gru{i}{d}.wi"] @ x[t] + w[f"gru{i}{d}.bi"], w[f"gru{i}{d}.wh"] @ h + w[f"gru{i}{d}.bh"]
                r, z = logistic(a[:n] + b[:n]), logistic(a[n : 2 * n] + b[n : 2 * n])
                h = (1 - z) * np.tanh(a[2 * n :] + r * b[2 * n :]) + z * h
                out[t] = h
            ways.append(out)
        x = np.hstack(ways)
        x = (x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + 1e-5) * w[f"norm{i}.scale"] + w[f"norm{i}.shift"]
    z = x @ w["out.w"].T + w["out.b"]
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def test_parts_of_the_pipeline_can_be_exchanged(spark):
    """A model that reads bases off the signal, a decoder with another alphabet, no preprocessing; ids by default."""
    rows = [([0.0, 0.0, 4.0, 1.0, 2.0],), ([],), ([3.0, 4.0, 3.0],)] + [([float(i % 4)],) for i in range(40)]
    df = spark.createDataFrame(rows, "signal array<double>").repartition(3).coalesce(1)
    order = [r[0] for r in df.collect()]
    one_hot = lambda x: F.transform(F.sequence(F.lit(0), F.lit(4)), lambda c: F.when(c == x.cast("int"), 0.0).otherwise(-50.0))
    model = lambda x: x.select("read_id", F.transform("signal", one_hot).alias("lp"))
    swapped = basecall.Pipeline(model, prepare=lambda x: x, decoder=lambda x: basecall.decode(x, basecall.GreedyDecoder(alphabet="GCTA")))
    got = {r["read_id"]: r for r in swapped.run(df).collect()}
    assert set(got) == {f"read_{i}" for i in range(len(rows))}
    want = {(0.0, 0.0, 4.0, 1.0, 2.0): "GCT", (): "", (3.0, 4.0, 3.0): "AA"} | {(float(i),): "GCTA"[i] for i in range(4)}
    assert all(got[f"read_{i}"]["sequence"] == want[tuple(x)] and got[f"read_{i}"]["signal_length"] == len(x) for i, x in enumerate(order))


def test_labels_are_padded_by_batch(spark):
    lp = lambda labels: [[0.0 if c == x else -9.0 for c in range(3)] for x in labels]
    df = spark.createDataFrame([(1, 0, lp([0, 1, 0, 1])), (2, 0, lp([2])), (3, 7, lp([1])), (4, None, lp([0, 1])), (5, None, lp([]))], "read_id int, b int, lp array<array<double>>")
    conf = basecall.GreedyDecoder(2, "AT")
    got = {r["read_id"]: r["labels"] for r in basecall.decode_padded(df, conf, batch="b").collect()}
    assert got == {1: [0, 1, 0, 1], 2: [2, 2, 2, 2], 3: [1], 4: [0, 1], 5: [2, 2]}
    assert {len(r["labels"]) for r in basecall.decode_padded(df, conf).collect()} == {4}

"""The HDF5 source in batches and as a stream; h5py is a stand-in for driver and workers."""

import json
import os
import sys

import pytest
from pyspark.sql import functions as F

from strandflow.operators import basecall, network
from strandflow.sources import fast5
from strandflow.streaming import signals as streaming

STANDIN = os.path.join(os.path.dirname(os.path.abspath(__file__)), "standin")


@pytest.fixture
def h5py_everywhere(spark, monkeypatch):
    env = spark.sparkContext.environment
    monkeypatch.setitem(env, "PYTHONPATH", os.pathsep.join([STANDIN, env["PYTHONPATH"]]))
    monkeypatch.syspath_prepend(STANDIN)
    monkeypatch.delitem(sys.modules, "h5py", raising=False)
    fast5.register(spark)


def put(folder, name, first, n, length=6):
    """A file of n reads, renamed into place when it is whole."""
    reads = {f"read_{i:04d}": {"signal": [(i * j) % 9 for j in range(length + i % 5)], "channel": {"digitisation": 100.0, "offset": 1.0, "range": 50.0}} for i in range(first, first + n)}
    (folder / f"{name}.part").write_text(json.dumps(reads))
    os.rename(folder / f"{name}.part", folder / f"{name}.fast5")


def ids(df):
    return sorted(r["read_id"] for r in df.select("read_id").collect())


def names(first, n):
    return [f"read_{i:04d}" for i in range(first, first + n)]


def test_limits_are_of_the_scan(spark, h5py_everywhere, tmp_path):
    put(tmp_path, "a", 0, 5)
    put(tmp_path, "b", 100, 5)
    put(tmp_path, "c", 200, 5)
    read = lambda **o: spark.read.format("fast5").options(path=str(tmp_path), **o).load()
    assert ids(read()) == names(0, 5) + names(100, 5) + names(200, 5)
    assert ids(read(maxReads=7)) == names(0, 5) + names(100, 2) and ids(read(maxReads=0)) == []
    assert ids(read(maxReads=99)) == ids(read())
    parts = read(readsPerPartition=2)
    assert ids(parts) == ids(read()) and parts.rdd.getNumPartitions() == 9
    assert ids(read(maxReads=6, readsPerPartition=4, readIds="read_0001,read_0003,read_0101,read_0200")) == ["read_0001", "read_0003", "read_0101", "read_0200"]


def test_plans_of_a_stream(tmp_path, monkeypatch):
    """Entries of the log: new files, bounded files and reads, a file over several batches, the limit of the scan."""
    monkeypatch.syspath_prepend(STANDIN)
    monkeypatch.delitem(sys.modules, "h5py", raising=False)
    folder = tmp_path / "in"
    folder.mkdir()
    open_ = lambda log, **o: fast5.Fast5DataSource({"path": str(folder), "log": str(tmp_path / log), **o}).streamReader(None)
    seen = lambda r, a, b: [x[0] for p in r.partitions({"entry": a}, {"entry": b}) for x in r.read(p)]
    r = open_("x")
    assert r.initialOffset() == r.latestOffset() == {"entry": 0}
    put(folder, "b", 10, 3)
    assert r.latestOffset() == {"entry": 1} and r.latestOffset() == {"entry": 1}
    put(folder, "a", 0, 5)  # arrives later, sorts before
    again = open_("x")  # a reader that starts anew finds the same batches
    assert again.latestOffset() == {"entry": 2}
    assert seen(again, 0, 1) == names(10, 3) and seen(again, 1, 2) == names(0, 5) and seen(again, 2, 2) == []
    assert r.latestOffset() == {"entry": 2} and seen(r, 0, 2) == names(10, 3) + names(0, 5)
    r = open_("y", maxReadsPerTrigger="2")
    assert [r.latestOffset()["entry"] for _ in range(6)] == [1, 2, 3, 4, 4, 4]
    assert [len(seen(r, i, i + 1)) for i in range(4)] == [2, 2, 2, 2] and seen(open_("y"), 0, 4) == names(0, 5) + names(10, 3)
    r = open_("z", maxFilesPerTrigger="1", maxReads="6")
    assert [r.latestOffset()["entry"] for _ in range(4)] == [1, 2, 2, 2] and seen(r, 0, 2) == names(0, 5) + names(10, 1)
    with pytest.raises(ValueError):
        fast5.Fast5DataSource({"path": str(folder)}).streamReader(None)


def test_a_stream_that_is_started_again_reads_nothing_twice(spark, h5py_everywhere, tmp_path):
    folder, base, log = tmp_path / "in", f"file://{tmp_path}/run", str(tmp_path / "log")
    folder.mkdir()
    put(folder, "a", 0, 4)
    put(folder, "b", 10, 4)
    step = lambda rows: fast5.picoamperes(rows).select("read_id", "signal")
    broken = lambda rows: step(rows).where(F.raise_error(F.lit("stopped")).isNull())
    run = lambda step: streaming.run_once(streaming.read_fast5_stream(spark, str(folder), log, maxFilesPerTrigger=1), step, base)
    while len(ids(run(step))) < 8:
        pass
    put(folder, "c", 20, 4)
    with pytest.raises(Exception, match="stopped"):
        run(broken)  # planned, but not finished
    put(folder, "d", 5, 2)
    for _ in range(3):
        out = run(step)
    batch = step(spark.read.format("fast5").load(str(folder)))
    assert sorted(map(str, out.collect())) == sorted(map(str, batch.collect())) and out.count() == 14


def test_basecalls_of_a_stream_equal_those_of_a_batch(spark, h5py_everywhere, tmp_path):
    small = network.NetConfig((4,), (5,), (2,), 8, 1)
    w = network.random_weights(small)
    put(tmp_path, "a", 0, 3, 300)
    put(tmp_path, "b", 7, 2, 200)
    got = streaming.basecall_fast5_stream(spark, str(tmp_path), f"file://{tmp_path}/run", w, small, log=str(tmp_path / "log"), trim_window=8)
    reads = fast5.picoamperes(spark.read.format("fast5").load(str(tmp_path))).select("read_id", "signal")
    assert sorted(map(str, got.collect())) == sorted(map(str, basecall.basecall(reads, w, small, trim_window=8).collect())) and got.count() == 5

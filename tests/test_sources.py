import os
import sys
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandflow.sources import fast5, fasta
from strandflow.streaming.signals import run_available


def test_fasta_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(">r1 first\nATCG\nAT",), (">r2\nGG",)], "record string")
    fasta.write_records(df, f"file://{tmp_path}/out")
    rows = {r["read_id"]: r for r in fasta.read_fasta(spark, f"file://{tmp_path}/out").collect()}
    assert rows["r1"]["sequence"] == "ATCGAT" and rows["r1"]["description"] == "first" and rows["r2"]["sequence"] == "GG"


def test_fast5_needs_h5py_and_a_path(spark, tmp_path):
    fast5.register(spark)
    for name in ("a", "b", "d/e.fast5", "d/f/g.fast5", "d/h.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).touch()
    of = lambda *paths: [os.path.relpath(p.path, tmp_path) for p in fast5.Fast5DataSource({"path": ",".join(f"{tmp_path}/{p}" for p in paths)}).reader(None).partitions()]
    assert of("a", "b", "a") == ["a", "b"] and of("d") == ["d/e.fast5", "d/f/g.fast5"] and of("d/*.txt") == ["d/h.txt"]
    with pytest.raises(FileNotFoundError):
        of("none")
    with pytest.raises(ValueError):
        fast5.Fast5DataSource({}).reader(None)


def test_calibration_defaults(spark):
    schema = "read_id string, signal array<float>, channel struct<digitisation: double, offset: double, range: double, sampling_rate: double, channel_number: string>"
    df = spark.createDataFrame([("a", [8192.0], None), ("b", [90.0], (100.0, 10.0, 50.0, 4000.0, "1"))], schema)
    assert [r["signal"] for r in fast5.picoamperes(df).orderBy("read_id").collect()] == [[1200.0], [50.0]]


def test_stream_equals_batch(spark, tmp_path):
    df = spark.range(50).withColumn("x", F.col("id") * 2)
    df.repartition(5).write.parquet(f"file://{tmp_path}/in")
    step = lambda d: d.select("id", (F.col("x") + 1).alias("y"))
    out = run_available(spark, f"file://{tmp_path}/in", step, max_files=2)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, step(df).collect()))


def test_fasta_headers_may_hold_the_sign(spark, tmp_path):
    from strandflow.sources import fasta

    (tmp_path / "x.fa").write_text(">r1 A>G variant\nACGT\nAC\n>r2\nTT\n")
    got = sorted(tuple(r) for r in fasta.read_fasta(spark, f"file://{tmp_path}/x.fa").collect())
    assert got == [("r1", "A>G variant", "ACGTAC"), ("r2", "", "TT")]


class Group(dict):
    """Stand-in for a group of an HDF5 file."""

    def __init__(self, members=(), **attrs):
        super().__init__(members)
        self.attrs = attrs

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass


def test_fast5_reads_what_is_asked_for(monkeypatch, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    (tmp_path / "x.fast5").touch()
    read = lambda n: Group({"Raw/Signal": np.arange(n, dtype=np.int16), "channel_id": Group(digitisation=100.0, channel_number=b"7"), "tracking_id": Group(run_id=b"r")})
    store = Group({"read_b": read(3), "read_a": read(2), "read_c": Group({"Raw/Signal": np.zeros(0)}), "other": Group()})
    monkeypatch.setitem(sys.modules, "h5py", types.SimpleNamespace(File=lambda path, mode: store))

    def rows(filters=(), **options):
        reader = fast5.Fast5DataSource({"path": str(tmp_path), **options}).reader(None)
        left = list(reader.pushFilters(list(filters)))
        return [r for p in reader.partitions() for r in reader.read(p)], left

    everything, _ = rows()
    assert everything[0] == ("read_a", [0.0, 1.0], (100.0, None, None, None, "7"), {"run_id": "r"}, 2) and everything[2] == ("read_c", [], None, None, 0)
    assert [r[0] for r in rows(maxReads="2")[0]] == ["read_a", "read_b"] and [r[0] for r in rows(readIds="read_c,read_b,x")[0]] == ["read_b", "read_c"]
    assert [(r[1], r[4]) for r in rows(signals="false")[0]] == [(None, 2), (None, 3), (None, 0)]
    other = GreaterThan(("signal_length",), 1)
    got, left = rows([EqualTo(("read_id",), "read_b"), other])
    assert [r[0] for r in got] == ["read_b"] and left == [other]
    assert rows([In(("read_id",), ("read_a", "x")), EqualTo(("read_id",), "read_b")])[0] == []


def test_fastq_reader(spark, tmp_path):
    records = [(f"r{i}", f"d {i}" if i % 2 else "", "ACGT"[: i % 5] * 3, "@+!I"[: i % 5] * 3) for i in range(400)]
    (tmp_path / "x.fq").write_text("".join(f"@{i}{' ' + d if d else ''}\n{s}\n+\n{q}\n" for i, d, s, q in records))
    (tmp_path / "y.fq").write_bytes(b"@z\r\nAC\r\n+\r\n@@\r\n\r\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000b")
    try:
        got = {r["read_id"]: tuple(r)[1:] for r in fasta.read_fastq(spark, f"file://{tmp_path}/*.fq").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = {i: (d, s, [ord(c) - 33 for c in q]) for i, d, s, q in records} | {"z": ("", "AC", [31, 31])}
    assert got == want


def test_records_sink(spark, tmp_path):
    from strandflow.sources import records_sink

    rows = [(i, f"@r{i}\nACGT\n+\nII@I") for i in range(500)]
    df = spark.createDataFrame(rows, "i int, record string").repartition(7)
    want = "".join(r + "\n" for _, r in rows)
    records_sink.write_file(df, f"file://{tmp_path}/out/one.fastq", order_by="i")
    assert (tmp_path / "out/one.fastq").read_text() == want and os.listdir(tmp_path / "out") == ["one.fastq"]
    assert sorted(map(tuple, fasta.read_fastq(spark, f"file://{tmp_path}/out/one.fastq").select("read_id", "sequence", "quality_scores").collect())) == sorted((f"r{i}", "ACGT", [40, 40, 31, 40]) for i, _ in rows)
    folder = tmp_path / "parts"
    records_sink.write_file(df, str(folder), order_by="i", single=False, extension=".fastq")
    names = sorted(os.listdir(folder))
    assert names == [f"part-{i:06d}.fastq" for i in range(len(names))] and "".join((folder / n).read_text() for n in names) == want
    records_sink.write_file(df.limit(1), str(folder), single=False, extension=".fastq", append=True)
    assert len(os.listdir(folder)) == len(names) + 1
    records_sink.write_file(df.where("i < 3"), str(folder), order_by="i", single=False)
    assert "".join((folder / n).read_text() for n in sorted(os.listdir(folder))) == "".join(r + "\n" for _, r in rows[:3])
    records_sink.write_file(df.limit(0), str(tmp_path / "empty.fa"))
    assert (tmp_path / "empty.fa").read_text() == ""


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    from strandflow.sources import records_sink

    df = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("broken"))).otherwise("ok").alias("record"))
    for single in (True, False):
        with pytest.raises(Exception, match="broken"):
            records_sink.write_file(df, str(tmp_path / "x"), single=single)
        assert os.listdir(tmp_path) == []
    (tmp_path / "x").write_text("as it was\n")
    with pytest.raises(Exception, match="broken"):
        records_sink.write_file(df, str(tmp_path / "x"))
    assert (tmp_path / "x").read_text() == "as it was\n" and os.listdir(tmp_path) == ["x"]
    with pytest.raises(Exception, match="exists"):
        records_sink.write_file(spark.createDataFrame([("a",)], "record string"), str(tmp_path / "x"), append=True)
    with pytest.raises(Exception, match="shared disk"):
        records_sink.write_file(spark.createDataFrame([("a",)], "record string"), "s3://x/y")

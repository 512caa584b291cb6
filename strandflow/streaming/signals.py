"""The same transforms on streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandflow.operators import basecall, network
from strandflow.session import shared_dir
from strandflow.sources import fast5


def run_once(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], base: str) -> DataFrame:
    """Take what is there now of a stream through a stateless transform; all that was ever written below `base`.

    Progress and output are below `base`, so that a run that follows, or one after a failure, goes on where the last one ended.
    """
    out = transform(stream)
    query = out.writeStream.format("parquet").option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start(f"{base}/out")
    query.awaitTermination()
    return stream.sparkSession.read.schema(out.schema).parquet(f"{base}/out")


def run_available(spark: SparkSession, path: str, transform: Callable[[DataFrame], DataFrame], *, max_files: int = 8) -> DataFrame:
    """Stream Parquet files below `path` through a stateless transform until none is left; the written result.

    Files are taken `max_files` at a time; progress and output are in the shared folder.
    """
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
    return run_once(stream, transform, f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}")


def read_fast5_stream(spark: SparkSession, path: str, log: str, **options) -> DataFrame:
    """Reads of the HDF5 files that arrive below `path`; `log` and `options` as the data source has them."""
    fast5.register(spark)
    return spark.readStream.format("fast5").options(path=path, log=log, **options).load()


def basecall_fast5_stream(spark: SparkSession, path: str, base: str, weights: dict, config: network.NetConfig = network.NetConfig(), *, log: str, options: dict | None = None, **preprocessing) -> DataFrame:
    """Basecalls of the HDF5 files below `path` so far, with those of earlier runs on the same `base`."""
    reads = read_fast5_stream(spark, path, log, **(options or {}))
    step = lambda rows: basecall.basecall(fast5.picoamperes(rows).select("read_id", "signal"), weights, config, **preprocessing)
    return run_once(reads, step, base)


def basecall_available(spark: SparkSession, path: str, weights: dict, config: network.NetConfig = network.NetConfig(), *, reads: Callable[[DataFrame], DataFrame] | None = None, **preprocessing) -> DataFrame:
    """Basecalls of all signal files below `path`, as a stream. reads: makes (read_id, signal) of the files' columns. Each signal is normalised as a whole."""
    as_reads = reads or (lambda rows: rows.select("read_id", "signal"))
    return run_available(spark, path, lambda rows: basecall.basecall(as_reads(rows), weights, config, **preprocessing))

"""Session helpers: worker import path, shared checkpoint folder, table access."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch; documents are large rows, so Spark's default of 10,000 would hold tens of MB in each worker.
ARROW_ROWS = "1000"

ROOT = str(Path(__file__).resolve().parent.parent)


def attach(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers started for `spark`, and keep Arrow batches small.

    On a cluster the package is installed on the executors or shipped with
    ``--py-files``; this only covers sessions whose workers share the driver's disk.
    """
    env = spark.sparkContext.environment
    paths = [p for p in (env.get("PYTHONPATH") or os.environ.get("PYTHONPATH") or "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, ARROW_ROWS)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master without that setting (tests) gets a temporary folder.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None)
    if base is None:
        base = getattr(spark.sparkContext, "_strandflow_dir", None)
    if base is None:
        if not conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-strandflow-")
        spark.sparkContext._strandflow_dir = base
        spark.sparkContext.setCheckpointDir(base)
    return base


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write `df` as Parquet below the shared folder and read it back.

    Cuts the lineage with data that survives the loss of an executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    attach(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

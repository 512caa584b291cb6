"""Record strings as numbered text files, or as one named file, `df.write.format("records")`.

The rows of each partition become a part; parts keep the order of the partitions, so what was
sorted before (`orderBy`) is in order in the files. Tasks write to a hidden folder beside the target.
Only when all have ended does the commit move their parts to `path` under gapless numbers, or
append them to one file that then takes the name `path`. A failed job removes the hidden folder and leaves
`path` as it was.

Options: `path` (a folder, or with `singleFile` a file, on a disk that driver and executors share; for other stores
write text with Spark), `extension` (of numbered parts, `.txt`), `singleFile` = true. Mode overwrite replaces what
is there, append adds parts after the last one; appending to a single file that exists is an error.
The frame has one string column; null records are left out.
"""

from __future__ import annotations

import os
import re
import shutil
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

_PART = re.compile(r"part-(\d+)")


@dataclass
class _Part(WriterCommitMessage):
    partition: int
    file: str
    records: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        path = options.get("path")
        if not path:
            raise ValueError("records need a path")
        self.path = re.sub(r"^file:(//)?(?=/)", "", path).rstrip("/")
        if re.match(r"[a-z0-9]+:", self.path):
            raise ValueError("records are written to a shared disk; write text with Spark to other stores")
        self.single = str(options.get("singleFile", "false")).lower() == "true"
        self.extension, self.overwrite = options.get("extension", ".txt"), overwrite
        if self.single and not overwrite and os.path.exists(self.path):
            raise FileExistsError(f"{self.path} exists, and a single file is not appended to")
        head, tail = os.path.split(self.path)
        self.hidden = os.path.join(head, f".{tail}-{uuid.uuid4().hex}")
        os.makedirs(self.hidden)  # by the driver, once: a task that outlives its job's end cannot bring it back

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        task = TaskContext.get()
        file = os.path.join(self.hidden, f"{task.partitionId()}-{task.taskAttemptId()}")
        n = 0
        with open(file, "wb") as out:
            for batch in iterator:
                for record in batch.column(0).to_pylist():
                    if record is not None:
                        out.write(record.encode() + b"\n")
                        n += 1
            out.flush()
            os.fsync(out.fileno())
        return _Part(task.partitionId(), file, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        parts = [m.file for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition) if m.records]
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        if self.single:
            joined = self.hidden + "-joined"
            with open(joined, "wb") as out:
                for part in parts:
                    with open(part, "rb") as f:
                        shutil.copyfileobj(f, out, 1 << 20)
                out.flush()
                os.fsync(out.fileno())
            if os.path.isdir(self.path):
                shutil.rmtree(self.path)
            os.replace(joined, self.path)
        else:
            if self.overwrite and os.path.exists(self.path):
                shutil.rmtree(self.path) if os.path.isdir(self.path) else os.remove(self.path)
            os.makedirs(self.path, exist_ok=True)
            first = 1 + max((int(m[1]) for m in map(_PART.match, os.listdir(self.path)) if m), default=-1)
            for i, part in enumerate(parts, first):
                os.replace(part, os.path.join(self.path, f"part-{i:06d}{self.extension}"))
        self._clean()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        for _ in range(20):  # a task that is still running may add a file meanwhile
            shutil.rmtree(self.hidden, ignore_errors=True)
            if not os.path.exists(self.hidden):
                return
            time.sleep(0.1)


class RecordsDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return "record string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if [f.dataType.simpleString() for f in schema.fields] != ["string"]:
            raise ValueError("records are one string column")
        return _Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordsDataSource)


def write_file(records: DataFrame, path: str, column: str = "record", *, order_by: str | None = None, single: bool = True, extension: str = ".txt", append: bool = False) -> None:
    """Record strings as one file of this name, or as a folder of numbered parts; sorted by a column if asked for."""
    register(records.sparkSession)
    out = (records.orderBy(order_by) if order_by else records).select(column)
    out.write.format("records").mode("append" if append else "overwrite").options(singleFile=str(single).lower(), extension=extension).save(path)

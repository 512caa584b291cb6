"""Multi-read HDF5 containers as a Python data source, `spark.read.format("fast5")` and `spark.readStream.format("fast5")`.

h5py is optional: without it a read fails with a clear message; a table of the same schema
in Parquet serves all operators as well. A task opens the files of its partition itself.

Options: `path` (files, folders and patterns, comma-separated, visible to driver and executors),
`readIds` (comma-separated ids; others are not opened), `maxReads` (the first so many of the scan: files by
name, reads of a file by id; the driver counts the reads of files until it has them), `signals` = false (signals
stay null, only their lengths are read), `readsPerPartition` (files of more are read by several tasks; the driver
counts their reads). Equality and `IN` on read_id are pushed down (not with `maxReads`, which counts before).

A stream takes what is new below its paths; files must arrive whole (written elsewhere and renamed). `log` names
a folder on a shared disk in which each batch's files are recorded before it runs, under numbers that are the stream's
offsets: a stream that is started again from its checkpoint reads exactly the batches it has not finished. `maxFilesPerTrigger`
and `maxReadsPerTrigger` bound a batch (a large file may take several), `maxReads` all of them. A batch is never empty but the first.
"""

from __future__ import annotations

import contextlib
import glob
import json
import os
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

SCHEMA = (
    "read_id string, signal array<float>, channel struct<digitisation: double, offset: double, range: double, sampling_rate: double, channel_number: string>, "
    "tracking map<string, string>, signal_length int"
)
#: Calibration where a file has none.
DIGITISATION, OFFSET, RANGE = 8192.0, 0.0, 1200.0
GROUP_PREFIX = "read_"


class _Slice(InputPartition):
    """The reads `first` to `first + count` (all after it, if None) of a file, by id."""

    def __init__(self, path: str, first: int = 0, count: int | None = None):
        self.path, self.first, self.count = path, first, count


def _list(value: str | None) -> list[str]:
    return [p.strip() for p in (value or "").split(",") if p.strip()]


def _files(paths: list[str]) -> list[str]:
    """Files that are named, lie in a named folder, or match a pattern; what is missing is an error."""
    out = []
    for path in paths:
        if os.path.isdir(path):
            found = glob.glob(os.path.join(glob.escape(path), "**", "*.fast5"), recursive=True)
        else:
            found = [path] if os.path.exists(path) else glob.glob(path)
            if not found:
                raise FileNotFoundError(f"no such file: {path}")
        out += sorted(found)
    return list(dict.fromkeys(out))


def _text(value) -> str:
    return value.decode() if isinstance(value, bytes) else str(value)


def _h5py():
    try:
        import h5py
    except ImportError as e:
        raise ImportError("reading fast5 needs h5py on the driver and the executors") from e
    return h5py


class _Scan:
    """What the options ask for, and the reading of a slice."""

    def __init__(self, options):
        self.paths = _list(options.get("path"))
        if not self.paths:
            raise ValueError("fast5 needs a path")
        ids = options.get("readIds")
        self.ids = None if ids is None else set(_list(ids))
        number = lambda name: int(options[name]) if name in options else None
        self.most, self.per_partition = number("maxReads"), number("readsPerPartition")
        self.signals = str(options.get("signals", "true")).lower() != "false"

    def names(self, f) -> list[str]:
        return sorted(k for k in f if k.startswith(GROUP_PREFIX) and (self.ids is None or k in self.ids))

    def count(self, path: str) -> int:
        with _h5py().File(path, "r") as f:
            return len(self.names(f))

    def slices(self, files: list[str], most: int | None, first: int = 0) -> Iterator[_Slice]:
        """The first `most` reads of the files, from read `first` of the first one; files are counted only where a number needs it."""
        for path in files:
            if most is None and self.per_partition is None:
                yield _Slice(path, first)
            else:
                n = self.count(path) - first
                n = n if most is None else min(n, most)
                step = self.per_partition or max(n, 1)
                for at in range(0, n, step):
                    yield _Slice(path, first + at, min(step, n - at))
                if most is not None:
                    most -= n
                    if most <= 0:
                        return
            first = 0

    def rows(self, part: _Slice | None) -> Iterator[tuple]:
        if part is None:  # Spark's one partition of a scan that has none
            return
        with _h5py().File(part.path, "r") as f:
            for name in self.names(f)[part.first : None if part.count is None else part.first + part.count]:
                group = f[name]
                attrs = dict(group["channel_id"].attrs) if "channel_id" in group else None
                number = lambda k: float(attrs[k]) if attrs and k in attrs else None  # noqa: B023, E731
                channel = attrs and (number("digitisation"), number("offset"), number("range"), number("sampling_rate"), _text(attrs["channel_number"]) if "channel_number" in attrs else None)
                tracking = {k: _text(v) for k, v in group["tracking_id"].attrs.items()} if "tracking_id" in group else None
                raw = group["Raw/Signal"]
                yield (name, raw[:].astype("float32").tolist() if self.signals else None, channel, tracking, int(raw.shape[0]))


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.scan = _Scan(options)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        scan = self.scan
        for f in filters:
            if scan.most is None and isinstance(f, (EqualTo, In)) and tuple(f.attribute) == ("read_id",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                scan.ids = wanted if scan.ids is None else scan.ids & wanted
            else:
                yield f

    def partitions(self):
        return list(self.scan.slices(_files(self.scan.paths), self.scan.most)) if self.scan.most != 0 else []

    def read(self, partition: _Slice | None) -> Iterator[tuple]:
        return self.scan.rows(partition)


class _StreamReader(DataSourceStreamReader):
    """Batches are numbered entries of the log: {"slices": [[path, first, count]], "next": [path, first] or null}.

    `next` is a file that the batch has begun and not finished.
    """

    def __init__(self, options):
        self.scan = _Scan(options)
        self.log = options.get("log")
        if not self.log:
            raise ValueError("a fast5 stream needs a log folder")
        number = lambda name: int(options[name]) if name in options else None
        self.files, self.reads = number("maxFilesPerTrigger"), number("maxReadsPerTrigger")
        os.makedirs(self.log, exist_ok=True)
        self.entries: list[dict] = []

    def _entry(self, n: int) -> str:
        return os.path.join(self.log, f"{n:09d}.json")

    def _catch_up(self) -> None:
        while os.path.exists(self._entry(len(self.entries) + 1)):
            with open(self._entry(len(self.entries) + 1)) as f:
                self.entries.append(json.load(f))

    def initialOffset(self) -> dict:
        return {"entry": 0}

    def latestOffset(self) -> dict:
        self._catch_up()
        entry = self._plan()
        if entry["slices"]:
            # a name is given to a whole entry, and to one only
            draft = f"{self._entry(len(self.entries) + 1)}.{uuid.uuid4().hex}"
            with open(draft, "w") as f:
                json.dump(entry, f)
                f.flush()
                os.fsync(f.fileno())
            with contextlib.suppress(FileExistsError):
                os.link(draft, self._entry(len(self.entries) + 1))
            os.remove(draft)
            self._catch_up()
        return {"entry": len(self.entries)}

    def _plan(self) -> dict:
        begun = self.entries[-1]["next"] if self.entries else None
        known = {path for e in self.entries for path, _, _ in e["slices"]} | {e["next"][0] for e in self.entries if e["next"]}
        new = [p for p in _files(self.scan.paths) if p not in known]
        files, first = ([begun[0], *new], begun[1]) if begun else (new, 0)
        files = files[: self.files]
        bounds = [] if self.reads is None else [self.reads]
        if self.scan.most is not None:
            bounds.append(self.scan.most - sum(count for e in self.entries for _, _, count in e["slices"]))
        most = min(bounds, default=None)
        if most is not None and most <= 0:
            return {"slices": [], "next": None}
        slices = [[s.path, s.first, s.count] for s in self.scan.slices(files, most, first)]
        following = None
        if slices and most is not None:
            path, at, count = slices[-1]
            if at + count < self.scan.count(path):
                following = [path, at + count]
        return {"slices": slices, "next": following}

    def partitions(self, start: dict, end: dict):
        self._catch_up()
        return [_Slice(*s) for e in self.entries[start["entry"] : end["entry"]] for s in e["slices"]]

    def read(self, partition: _Slice | None) -> Iterator[tuple]:
        return self.scan.rows(partition)


class Fast5DataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fast5"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the source known; Spark refuses one that takes filters where they are not pushed to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Fast5DataSource)


def calibration(channel: Column) -> tuple[Column, Column, Column]:
    return (F.coalesce(channel["digitisation"], F.lit(DIGITISATION)), F.coalesce(channel["offset"], F.lit(OFFSET)), F.coalesce(channel["range"], F.lit(RANGE)))


def picoamperes(reads: DataFrame) -> DataFrame:
    from strandflow.functions.signal import to_picoamperes

    return reads.withColumn("signal", to_picoamperes(F.col("signal"), *calibration(F.col("channel"))))

"""Signals longer than a task holds, as tables of segments.

A segment is a row: read_id, segment (0, 1, ...), start (position of its first sample) and values,
`size` samples or fewer at the end of the signal. Operators that look around a sample first give
each segment a halo: as many samples of the neighbours as they need, sent from segment to segment.
No row, and no group, holds more than a segment and its halos. What is longer than any halo (the
state of a run, the place of the greatest jump) is a few numbers for each segment, and only these
are brought together by read.

Positions and results are those of the whole signal. Null read_ids are left out; a null value is an
error of the input and makes its window's result null or skips it as the whole-array functions do;
an empty signal has no segments; segments must be complete (every position from 0 once).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.functions import signal as S
from strandflow.operators import signals
from strandflow.plans import selection
from strandflow.session import materialize

SIZE = 1 << 16


def of_points(points: DataFrame, size: int = SIZE) -> DataFrame:
    """Segments of (read_id, pos, value)."""
    place = F.expr(f"pos div {size}").cast("long")
    values = F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda p: p["value"])
    made = points.where("read_id IS NOT NULL").groupBy("read_id", place.alias("segment")).agg(values.alias("values"))
    return made.select("read_id", "segment", (F.col("segment") * size).alias("start"), "values")


def of_arrays(reads: DataFrame, size: int = SIZE, column: str = "signal") -> DataFrame:
    """Segments of (read_id, signal)."""
    parts = reads.where("read_id IS NOT NULL").select("read_id", F.explode(S.chunks(F.col(column), size)).alias("c"))
    return parts.select("read_id", F.expr(f"c.start div {size}").cast("long").alias("segment"), F.col("c.start").cast("long").alias("start"), F.col("c.chunk").alias("values"))


def to_points(segments: DataFrame) -> DataFrame:
    """(read_id, pos, value)."""
    each = segments.select("read_id", "start", F.posexplode("values").alias("at", "value"))
    return each.select("read_id", (F.col("start") + F.col("at")).alias("pos"), "value")


def with_halos(segments: DataFrame, halo: int, size: int = SIZE) -> DataFrame:
    """Segments with `around`: their values and up to `halo` samples of the neighbours on each side, and `before`, how many come first.

    A segment sends its ends to as many neighbours as the halo reaches, so a group holds a segment and two halos.
    """
    reach = -(-halo // size)
    n = F.size("values")
    sent = [F.struct(F.lit(0).cast("long").alias("by"), F.lit(True).alias("own"), F.col("values").alias("piece"))]
    for d in range(1, reach + 1):
        some = min(size, halo - (d - 1) * size)  # of the samples of a neighbour d away
        sent.append(F.struct(F.lit(d).cast("long").alias("by"), F.lit(False).alias("own"), F.slice("values", F.greatest(n - some, F.lit(0)) + 1, F.lit(some)).alias("piece")))
        sent.append(F.struct(F.lit(-d).cast("long").alias("by"), F.lit(False).alias("own"), F.slice("values", 1, some).alias("piece")))
    pieces = segments.select("read_id", "segment", F.explode(F.array(*sent)).alias("s")).select(
        "read_id", (F.col("segment") + F.col("s.by")).alias("segment"), F.struct((-F.col("s.by")).alias("by"), "s.own", "s.piece").alias("p"))
    met = pieces.groupBy("read_id", "segment").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    size_of = lambda ps: F.aggregate(ps, F.lit(0), lambda a, p: a + F.size(p["piece"]))
    met = met.withColumn("values", F.get(F.filter("ps", lambda p: p["own"]), F.lit(0))["piece"]).where("values IS NOT NULL")
    return met.select(
        "read_id", "segment", (F.col("segment") * size).alias("start"), "values",
        F.flatten(F.col("ps.piece")).alias("around"), size_of(F.filter("ps", lambda p: p["by"] < 0)).alias("before"))


def _own(filtered: Column) -> Column:
    return F.slice(filtered, F.col("before") + 1, F.size("values"))


def median_filter(segments: DataFrame, kernel: int = 5, size: int = SIZE) -> DataFrame:
    """The whole signal's median filter, cut at the signal's ends only."""
    if kernel == 1:
        return segments
    wide = with_halos(segments, kernel // 2, size)
    return wide.select("read_id", "segment", "start", _own(S.median_filter(F.col("around"), kernel)).alias("values"))


def _in_points(wide: DataFrame) -> DataFrame:
    """Points of segments with halos under keys of their own: read_id is (read_id, segment), pos counts from the halo."""
    key = F.struct("read_id", "segment", "start", "before", F.size("values").alias("n"))
    return wide.select(key.alias("read_id"), F.posexplode("around").alias("pos", "value"))


def _own_points(points: DataFrame, *columns: str) -> DataFrame:
    key = F.col("read_id")
    inside = (F.col("pos") >= key["before"]) & (F.col("pos") < key["before"] + key["n"])
    return points.where(inside).select(key["read_id"].alias("read_id"), (key["start"] + F.col("pos") - key["before"]).alias("pos"), *columns)


def running_std(segments: DataFrame, window: int = 100, size: int = SIZE) -> DataFrame:
    """(read_id, pos, value): standard deviation of the samples around each."""
    return _own_points(signals.running_std(_in_points(with_halos(segments, window // 2, size)), window), "value")


def repair_spikes(segments: DataFrame, threshold: float = 5.0, max_length: int = 50, size: int = SIZE) -> DataFrame:
    """(read_id, pos, value, is_spike): runs of at most max_length samples beyond the threshold become lines between their neighbours.

    A run that fills a halo of max_length + 1 samples is too long to be repaired, whatever lies beyond it.
    """
    points = _in_points(with_halos(segments, max_length + 1, size))
    return _own_points(signals.repair_spikes(points, threshold, max_length), "value", "is_spike")


def regions(segments: DataFrame, center: float = 0.0, tolerance: float = 0.5, min_length: int = 40) -> DataFrame:
    """(read_id, start, end): maximal runs of samples nearer to center than tolerance, end exclusive.

    A segment gives its runs; only those that touch one of its ends, two for each segment at most, are joined by read.
    """
    near = F.transform("values", lambda x: F.coalesce(F.abs(x - center) < tolerance, F.lit(False)))
    n = F.size("values")
    marked = segments.select("read_id", "segment", "start", n.alias("n"), near.alias("near"))
    begins = F.filter(F.transform("near", lambda x, i: F.when(x & ((i == 0) | ~F.coalesce(F.get("near", i - 1), F.lit(False))), i)), lambda i: i.isNotNull())
    ends = F.filter(F.transform("near", lambda x, i: F.when(x & ~F.coalesce(F.get("near", i + 1), F.lit(False)), i + 1)), lambda i: i.isNotNull())
    runs = marked.select("read_id", "segment", "start", "n", F.explode(F.arrays_zip(begins.alias("b"), ends.alias("e"))).alias("r"))
    runs = materialize(runs.select(
        "read_id", "segment", (F.col("start") + F.col("r.b")).alias("start"), (F.col("start") + F.col("r.e")).alias("end"),
        ((F.col("r.b") == 0) & (F.col("segment") > 0) | (F.col("r.e") == F.col("n"))).alias("touches")), "runs")
    order = Window.partitionBy("read_id").orderBy("start")
    new = F.coalesce(F.lag("end").over(order) != F.col("start"), F.lit(True)).cast("int")
    joined = runs.where("touches").withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = joined.groupBy("read_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")
    return runs.where("NOT touches").select("read_id", "start", "end").unionByName(joined).where(F.col("end") - F.col("start") >= min_length)


def trim_position(segments: DataFrame, window: int = 200, threshold: float = 2.0, min_trim: int = 100, size: int = SIZE) -> DataFrame:
    """(read_id, position): samples to cut, as `functions.signal.trim_position` finds them in the whole signal.

    Each segment gives its greatest jump, which a jump of the same size further on does not replace.
    """
    wide = with_halos(segments, window, size)
    own = F.slice("around", F.col("before") + 1, F.size("around"))
    ahead = F.slice("around", F.col("before") + window + 1, F.size("values"))
    jumps = F.zip_with(F.slice(own, F.lit(1), F.size(ahead)), ahead, lambda a, b: F.abs(b - a) / window)
    each = wide.select("read_id", "start", F.size("values").alias("n"), jumps.alias("jumps"))
    best = each.select("read_id", "start", "n", F.array_max("jumps").alias("jump"), F.array_position("jumps", F.array_max("jumps")).alias("at"))
    found = best.groupBy("read_id").agg(
        F.sum("n").alias("n"), F.max(F.struct("jump", (-(F.col("start") + F.col("at") - 1)).alias("from"))).alias("best"))
    place = F.when(F.col("best.jump") < threshold, min_trim).otherwise(F.greatest(-F.col("best.from") + window // 2, F.lit(min_trim)))
    place = F.when(place >= F.col("n"), min_trim).otherwise(place)
    return found.select("read_id", F.when(F.col("n") < 2 * window, 0).otherwise(place).cast("long").alias("position"))


def _known(segments: DataFrame, of_reads: DataFrame) -> DataFrame:
    """Segments joined with a row for each read; the segments of one read go to many tasks."""
    of_reads = materialize(of_reads, "of-reads")
    return selection.join_keys(segments, of_reads, ["read_id"], selection.few(of_reads))


def trim(segments: DataFrame, positions: DataFrame, size: int = SIZE) -> DataFrame:
    """Segments of what follows each read's `position`, cut anew from there."""
    cut = F.greatest(F.col("position") - F.col("start"), F.lit(0)).cast("int")
    left = _known(segments, positions).where(cut < F.size("values"))
    rest = left.select("read_id", (F.col("start") + cut - F.col("position")).alias("start"), F.slice("values", cut + 1, F.lit(size)).alias("values"))
    # a cut piece lies in two of the new segments at most
    first = F.expr(f"start div {size}")
    room = (F.lit(size) - F.col("start") % size).cast("int")
    halves = F.array(
        F.struct(first.alias("segment"), F.col("start").alias("start"), F.slice("values", F.lit(1), room).alias("values")),
        F.struct((first + 1).alias("segment"), (F.col("start") + room).alias("start"), F.slice("values", room + 1, F.lit(size)).alias("values")))
    dealt = rest.select("read_id", F.explode(halves).alias("h")).where("size(h.values) > 0").select("read_id", "h.*")
    ordered = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "values"))), lambda p: p["values"]))
    return dealt.groupBy("read_id", "segment").agg(ordered.alias("values")).select("read_id", "segment", (F.col("segment") * size).alias("start"), "values")


def normalize(segments: DataFrame, clip: float | None = 5.0, gathered: int = signals.GATHERED) -> DataFrame:
    """Segments of the signal scaled by its exact median and MAD."""
    of_reads = signals.stats(to_points(segments), gathered).select("read_id", "median", "mad")
    return _known(segments, of_reads).select("read_id", "segment", "start", S.robust_scale(F.col("values"), F.col("median"), F.col("mad"), clip).alias("values"))


def denoise(segments: DataFrame, conf: signals.Denoiser = signals.Denoiser(), size: int = SIZE) -> DataFrame:
    """(read_id, pos, value, is_spike): the median filter, then repaired spikes."""
    out = median_filter(segments, conf.median_filter_size, size) if conf.apply_median_filter else segments
    out = materialize(out, "segments")
    if not conf.remove_spikes:
        return to_points(out).withColumn("is_spike", F.lit(False))
    return repair_spikes(out, conf.spike_threshold, conf.max_spike_length, size)

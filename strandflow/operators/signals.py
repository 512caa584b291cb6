"""Relational operators on signals in long form (read_id, pos, value) and on arrays."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.functions import signal as S
from strandflow.plans import selection
from strandflow.plans.numbering import number_rows
from strandflow.session import materialize


def long_form(signals: DataFrame, column: str = "signal") -> DataFrame:
    return signals.select("read_id", F.posexplode(column).alias("pos", "value"))


def _by_read(before: int | None = None, after: int | None = None):
    w = Window.partitionBy("read_id").orderBy("pos")
    return w if before is None else w.rowsBetween(-before, after)


def _windowed(signals: DataFrame, window: int, step: int, clip: float | None) -> DataFrame:
    """(row, read_id, pos, value): `row` tells rows of one read_id apart; an empty signal has one row, of null pos."""
    n = F.size("signal")
    last = F.greatest(n - window, F.lit(0))
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(step)), F.array(last)))
    parts = F.transform(starts, lambda s: F.struct(s.alias("start"), S.normalize(F.slice("signal", s + 1, F.lit(window)), clip)["norm"].alias("x")))
    every = F.array(F.struct(F.lit(0).alias("start"), F.array_repeat(F.lit(None).cast("double"), n).alias("x")))  # positions in gaps
    rows = signals.where(n >= 0).select(F.monotonically_increasing_id().alias("row"), "read_id", "signal")
    rows = rows.select("row", "read_id", F.explode(F.concat(every, parts)).alias("w"))
    one = rows.select("row", "read_id", "w.start", F.posexplode_outer("w.x").alias("k", "x"))
    return one.groupBy("row", "read_id", (F.col("start") + F.col("k")).alias("pos")).agg(F.coalesce(F.avg("x"), F.lit(0.0)).alias("value"))


def normalize_windowed(signals: DataFrame, window: int = 5000, step: int = 1000, clip: float | None = 5.0) -> DataFrame:
    """(read_id, pos, value): each window normalised alone, overlaps averaged, gaps 0.

    Windows start at 0, step, ... and one ends with the signal; shorter signals are one window.
    Rows of one read_id are signals of their own.
    """
    return _windowed(signals, window, step, clip).where("pos IS NOT NULL").select("read_id", "pos", "value")


def repair_spikes(points: DataFrame, threshold: float = 5.0, max_length: int = 50) -> DataFrame:
    """(read_id, pos, value, is_spike): runs of at most max_length samples beyond the threshold become a line
    between their neighbours (at an end of the signal, the one neighbour there is)."""
    w = _by_read()
    run = F.sum((~F.col("is_spike")).cast("int")).over(w)
    marked = points.withColumn("is_spike", F.abs("value") > threshold).withColumn("run", run)
    clean = F.when(~F.col("is_spike"), F.col("value"))
    back, on = Window.partitionBy("read_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("read_id").orderBy("pos").rowsBetween(0, Window.unboundedFollowing)
    around = marked.withColumn("left", F.last(clean, True).over(back)).withColumn("right", F.first(clean, True).over(on))
    spiky = Window.partitionBy("read_id", "run", "is_spike")
    sized = around.withColumn("size", F.count("*").over(spiky)).withColumn("place", F.col("pos") - F.min("pos").over(spiky) + 1)
    left, right = F.coalesce("left", "right"), F.coalesce("right", "left")
    line = left + (right - left) * F.col("place") / (F.col("size") + 1)
    fixed = F.when(F.col("is_spike") & (F.col("size") <= max_length) & left.isNotNull(), line).otherwise(F.col("value"))
    return sized.select("read_id", "pos", fixed.alias("value"), "is_spike")


def regions(points: DataFrame, center: float = 0.0, tolerance: float = 0.5, min_length: int = 40) -> DataFrame:
    """(read_id, start, end): maximal runs of samples nearer to center than tolerance, end exclusive."""
    near = points.where(F.abs(F.col("value") - center) < tolerance)
    island = F.col("pos") - F.row_number().over(_by_read())
    found = near.withColumn("island", island).groupBy("read_id", "island").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))
    return found.where(F.col("end") - F.col("start") >= min_length).select("read_id", "start", "end")


def running_std(points: DataFrame, window: int = 100) -> DataFrame:
    half = window // 2
    return points.select("read_id", "pos", F.stddev_pop("value").over(_by_read(half, half)).alias("value"))


def median_filter_points(points: DataFrame, kernel: int = 5) -> DataFrame:
    half = kernel // 2
    window = F.array_sort(F.collect_list("value").over(_by_read(half, half)))
    return points.select("read_id", "pos", F.element_at(window, F.shiftright(F.size(window), 1) + 1).alias("value"))


#: Values of a read that one group may sort; the medians of larger reads are selected in rounds over all tasks.
GATHERED = 1 << 20


def _median_mad(points: DataFrame) -> DataFrame:
    """(read_id, median, m) with each read's values in one group."""
    center = points.groupBy("read_id").agg(F.median("value").alias("median"))
    spread = points.join(center, "read_id").groupBy("read_id").agg(F.median(F.abs(F.col("value") - F.col("median"))).alias("m"))
    return center.join(spread, "read_id")


def _selected_median_mad(points: DataFrame) -> DataFrame:
    values = points.select(F.col("read_id").alias("key"), "value")
    center = materialize(selection.medians(values), "medians")
    spread = selection.medians(selection.deviations(values, center))
    return center.hint("merge").join(spread.withColumnRenamed("median", "m"), "key").withColumnRenamed("key", "read_id")


def stats(points: DataFrame, gathered: int = GATHERED) -> DataFrame:
    """(read_id, median, mad, std_equivalent, mean, std, min, max, length).

    The values of a read of more than `gathered` are never brought to one task. Rows without read_id or value are left out.
    """
    points = points.where("read_id IS NOT NULL AND value IS NOT NULL")
    first = materialize(points.groupBy("read_id").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("length")), "stats")
    large = first.where(F.col("length") > gathered).select("read_id")
    n_large, n = large.count(), first.count()
    if n_large == 0:
        found = _median_mad(points)
    elif n_large == n:
        found = _selected_median_mad(points)
    else:
        # at most one in `gathered` rows names a large read
        found = _selected_median_mad(points.join(large, "read_id", "left_semi")).unionByName(_median_mad(points.join(large, "read_id", "left_anti")))
    mad = F.when(F.col("m") == 0, S.LEAST_MAD).otherwise(F.col("m"))
    return first.hint("merge").join(found, "read_id").select("read_id", "median", mad.alias("mad"), (mad * S.MAD_SCALE).alias("std_equivalent"), "mean", "std", "min", "max", "length")


@dataclass(frozen=True)
class Denoiser:
    median_filter_size: int = 5
    spike_threshold: float = 5.0
    max_spike_length: int = 50
    apply_median_filter: bool = True
    remove_spikes: bool = True


def denoise(signals: DataFrame, conf: Denoiser = Denoiser()) -> DataFrame:
    """(read_id, signal, stats): median filter, then runs of spikes of the filtered signal become lines.

    stats: median_filter_applied, spikes_removed (whether any sample is a spike), n_spike_samples and
    spike_fraction (null without spike removal). Empty signals stay empty, null ones null.
    """
    filtered = conf.apply_median_filter and conf.median_filter_size > 1
    some = F.size("signal") > 0
    rows = signals.select(F.monotonically_increasing_id().alias("row"), "read_id", (S.median_filter(F.col("signal"), conf.median_filter_size) if filtered else F.col("signal")).alias("signal"))
    if conf.remove_spikes:
        # reads without a spike stay arrays; the others go point by point
        marks = F.size(F.filter(S.spikes(F.col("signal"), conf.spike_threshold), lambda x: x))
        rows = materialize(rows.withColumn("n_spikes", F.when(some, marks).otherwise(0)), "denoise")
        spiky = rows.where("n_spikes > 0").select(F.col("row").alias("read_id"), "signal")
        points = repair_spikes(long_form(spiky), conf.spike_threshold, conf.max_spike_length)
        fixed = points.groupBy(F.col("read_id").alias("row")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda p: p["value"]).alias("fixed"))
        rows = rows.join(fixed, "row", "left").withColumn("signal", F.coalesce("fixed", "signal"))
    n = F.col("n_spikes") if conf.remove_spikes else F.lit(None).cast("int")
    stats = F.struct(
        (some & F.lit(filtered)).alias("median_filter_applied"), F.coalesce(n > 0, F.lit(False)).alias("spikes_removed"), n.alias("n_spike_samples"),
        F.when(some, n / F.size("signal")).otherwise(n.cast("double")).alias("spike_fraction"),
    )
    return rows.select("read_id", "signal", stats.alias("stats"))


def preprocess(signals: DataFrame, mode: str = "global", *, chunk: int = 10000, window: int = 5000, step: int = 1000, trim_window: int = 200,
               trim_threshold: float = 2.0, min_trim: int = 100, clip: float | None = 5.0, conf: Denoiser = Denoiser()) -> DataFrame:
    """(read_id, signal): normalise, cut the adapter, denoise.

    Spikes are looked for only where there can be any: not in signals clipped at or below the spike threshold.
    """
    if mode == "global":
        norm = signals.select("read_id", S.normalize(F.col("signal"), clip)["norm"].alias("signal"))
    elif mode == "chunks":
        norm = signals.select("read_id", S.normalize_chunks(F.col("signal"), chunk, clip).alias("signal"))
    elif mode == "windowed":
        order = F.array_sort(F.filter(F.collect_list(F.struct("pos", "value")), lambda p: p["pos"].isNotNull()))
        norm = _windowed(signals, window, step, clip).groupBy("row", "read_id").agg(F.transform(order, lambda p: p["value"]).alias("signal"))
    else:
        raise ValueError(f"mode must be global, windowed or chunks, not {mode!r}")
    norm = norm.select("read_id", S.trim(F.col("signal"), trim_window, trim_threshold, min_trim).alias("signal"))
    if clip is None or clip > conf.spike_threshold:
        return denoise(norm, conf).select("read_id", "signal")
    size = conf.median_filter_size if conf.apply_median_filter else 1
    return norm.select("read_id", S.median_filter(F.col("signal"), size).alias("signal"))


def _batches(rows: DataFrame, batch_size: int) -> DataFrame:
    """`rows` with batch_id: by read_id, batch_size rows each."""
    numbered = number_rows(rows, "read_id", name="batch_id")
    return numbered.withColumn("batch_id", F.floor(F.col("batch_id") / batch_size))


def batch_lengths(lengths: DataFrame, batch_size: int = 32) -> DataFrame:
    """(batch_id, read_id, length, padded) of `padded_batches` for reads of any length, without building the padded arrays."""
    padded = F.max("length").over(Window.partitionBy("batch_id"))
    return _batches(lengths, batch_size).select("batch_id", "read_id", "length", padded.alias("padded"))


def padded_batches(signals: DataFrame, batch_size: int = 32, max_length: int | None = None) -> DataFrame:
    """(batch_id, read_id, length, signal): reads by read_id in batches, cut to max_length, padded with 0 to the batch's longest."""
    batch = _batches(signals.select("read_id", (F.slice("signal", 1, max_length) if max_length else F.col("signal")).alias("signal")), batch_size)
    longest = F.max(F.size("signal")).over(Window.partitionBy("batch_id"))
    return batch.select("batch_id", "read_id", F.size("signal").alias("length"), F.concat("signal", F.array_repeat(F.lit(0.0), longest - F.size("signal"))).alias("signal"))

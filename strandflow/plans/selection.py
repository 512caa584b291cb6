"""Exact order statistics of every key at once, without bringing a key's values together.

A double is turned into a long of the same order and found by its bits: `BITS` in each round. A
round counts, for each key and rank, the values that agree with the bits found so far by their
next ones; the counts (at most 2^BITS of a key and rank) say which bits come next. Counting
combines before it shuffles. What is known of few keys is broadcast; of many, it meets their values
through `SALT` copies and an exchange, so a key that holds all rows is counted by all tasks, and what
the driver is sent does not grow with the keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.session import materialize

BITS, ROUNDS = 16, 4
SALT = 16
#: Rows of a table of keys that are broadcast at most.
FEW = 10_000


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Longs that sort like the doubles; -0.0 is 0.0, and every NaN is one value after all others."""
    for batch in batches:
        x = batch.column("value").to_numpy(zero_copy_only=False) + 0.0
        x[np.isnan(x)] = np.nan
        bits = x.view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(bits ^ ((bits >> 63) & np.int64((1 << 63) - 1)))], names=["key", "code"])


def _doubles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        code = batch.column("code").to_numpy()
        bits = code ^ ((code >> 63) & np.int64((1 << 63) - 1))
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("rank"), pa.array(bits.view(np.float64))], names=["key", "rank", "value"])


def few(keys: DataFrame) -> bool:
    return keys.count() <= FEW


def join_keys(rows: DataFrame, keys: DataFrame, on: list[str], is_few: bool, how: str = "inner") -> DataFrame:
    """`rows` joined with the rows of `keys`: broadcast, or else (the hint rules a broadcast out) by `SALT` copies of each."""
    if is_few:
        return rows.join(F.broadcast(keys), on, how)
    copies = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALT)).cast("int"))
    return salted.join(copies.hint("merge"), [*on, "_salt"], how).drop("_salt")


def select_ranks(values: DataFrame, ranks: DataFrame) -> DataFrame:
    """(key, rank, value): the value of each asked rank (0 the least) among the non-null values of its key.

    `values` has key and value, `ranks` key and rank (below the number of values); keys are not null.
    """
    kind = values.schema["key"].dataType.simpleString()
    left = values.where("value IS NOT NULL").select("key", F.col("value").cast("double").alias("value")).mapInArrow(_codes, f"key {kind}, code long")
    left = materialize(left, "codes")
    # found: the bits so far, and how many values of the same bits the rank has before it
    state = materialize(ranks.select("key", "rank", F.lit(0).cast("long").alias("found"), F.col("rank").cast("long").alias("skip")), "ranks")
    is_few = few(state)
    for step in range(ROUNDS):
        shift = 64 - BITS * (step + 1)
        bits = F.shiftright("code", shift)  # an arithmetic shift keeps the order
        so_far = F.shiftright("code", shift + BITS) if step else F.lit(0).cast("long")
        hit = left.withColumn("found", so_far)
        if step:  # in the first round every value agrees
            groups = state.groupBy("key", "found").agg(F.lit(1)).select("key", "found")
            hit = join_keys(hit, groups, ["key", "found"], is_few, "left_semi")
        if step == 1:
            hit = left = materialize(hit.drop("found"), "codes").withColumn("found", so_far)  # few are left to be looked at again
        counted = hit.groupBy("key", "found", bits.alias("next")).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("key", "found").orderBy("next").rowsBetween(Window.unboundedPreceding, -1))
        bins = counted.withColumn("before", F.coalesce(upto, F.lit(0)))
        inside = (F.col("skip") >= F.col("before")) & (F.col("skip") < F.col("before") + F.col("n"))
        state = materialize(bins.join(state if is_few else state.hint("merge"), ["key", "found"]).where(inside).select("key", "rank", F.col("next").alias("found"), (F.col("skip") - F.col("before")).alias("skip")), "ranks")
    return state.select("key", "rank", F.col("found").alias("code")).mapInArrow(_doubles, f"key {kind}, rank long, value double")


def medians(values: DataFrame) -> DataFrame:
    """(key, median) of the keys with any value; the mean of both middle values of an even number."""
    n = values.groupBy("key").agg(F.count("value").cast("long").alias("n")).where("n > 0")
    middle = F.array_distinct(F.array(F.expr("(n - 1) div 2"), F.expr("n div 2")))
    ranks = n.select("key", F.explode(middle).alias("rank"))
    return select_ranks(values, ranks).groupBy("key").agg(((F.min("value") + F.max("value")) / 2).alias("median"))


def deviations(values: DataFrame, center: DataFrame) -> DataFrame:
    """(key, value): distance of each value from its key's `median`."""
    return join_keys(values, center, ["key"], few(center)).select("key", F.abs(F.col("value") - F.col("median")).alias("value"))

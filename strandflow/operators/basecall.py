"""Basecalling: signal to sequence, qualities and a summary."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.functions import ctc, records
from strandflow.functions.dna import BASES, bases_of_labels
from strandflow.operators import network, signals
from strandflow.plans.numbering import number_rows
from strandflow.session import materialize
from strandflow.sources.fast5 import register as register_fast5
from strandflow.sources.fasta import write_records
from strandflow.sources.records_sink import write_file


@dataclass(frozen=True)
class GreedyDecoder:
    blank: int = ctc.BLANK
    alphabet: str = BASES


def decode(log_probs: DataFrame, conf: GreedyDecoder = GreedyDecoder(), length: str | None = None) -> DataFrame:
    """(read_id, sequence, confidences, quality_scores, mean_confidence, peak_confidence) of (read_id, lp); of the first steps where a column `length` is named."""
    cut = log_probs.select("read_id", ctc.cut(F.col("lp"), F.col(length) if length else None).alias("lp"))
    lp = F.col("lp")
    found = cut.withColumn("runs", ctc.runs(lp, conf.blank))
    scored = found.withColumn("confidences", ctc.base_confidences(lp, F.col("runs")))
    mean = F.coalesce(F.try_divide(F.aggregate("confidences", F.lit(0.0), lambda a, x: a + x), F.size("confidences")), F.lit(0.0))
    return scored.select(
        "read_id", ctc.sequence(F.col("runs"), conf.alphabet).alias("sequence"), "confidences",
        F.transform("confidences", lambda p: ctc.quality(p)).alias("quality_scores"),
        mean.alias("mean_confidence"), ctc.peak_confidence(lp, F.col("runs")).alias("peak_confidence"),
    )


def decode_padded(log_probs: DataFrame, conf: GreedyDecoder = GreedyDecoder(), length: str | None = None, batch: str | None = None) -> DataFrame:
    """(read_id, labels, n_labels, confidence): labels of all rows padded with the blank to the most of any.

    With `batch`, a column that numbers the rows' batches, to the most of the batch: one long row widens its own batch alone.
    """
    lp = F.col("lp")
    group = F.col(batch) if batch else F.lit(0)
    cut = log_probs.select("read_id", group.alias("batch"), ctc.cut(lp, F.col(length) if length else None).alias("lp")).withColumn("runs", ctc.runs(lp, conf.blank))
    found = cut.select("read_id", "batch", F.col("runs.label").alias("labels"), F.size("runs").alias("n_labels"), ctc.peak_confidence(lp, F.col("runs")).alias("confidence"))
    most = found.groupBy("batch").agg(F.coalesce(F.max("n_labels"), F.lit(0)).alias("most"))
    padded = F.concat("labels", F.array_repeat(F.lit(conf.blank), F.col("most") - F.col("n_labels")))
    if not batch:
        most = F.broadcast(most)  # one row
    return found.join(most, found["batch"].eqNullSafe(most["batch"])).select("read_id", padded.alias("labels"), "n_labels", "confidence")


def padded_to_sequence(padded: DataFrame, alphabet: str = BASES) -> DataFrame:
    """(read_id, sequence) of (read_id, labels, n_labels); a label outside the alphabet is an error."""
    return padded.select("read_id", bases_of_labels(F.slice("labels", F.lit(1), F.col("n_labels")), "fail", alphabet).alias("sequence"))


@dataclass(frozen=True)
class Pipeline:
    """Basecalling in exchangeable parts, each a function of tables: raw to prepared signals, these to log-probabilities, those to calls.

    `prepare` takes and gives (read_id, signal), `model` gives (read_id, lp), `decoder` gives what `decode` gives. read_id is a struct
    that holds the raw signal's length beside the id, and must come through unchanged.
    """

    model: Callable[[DataFrame], DataFrame]
    prepare: Callable[[DataFrame], DataFrame] = signals.preprocess
    decoder: Callable[[DataFrame], DataFrame] = decode

    @classmethod
    def of_network(cls, weights: dict[str, np.ndarray], config: network.NetConfig = network.NetConfig(), decoder: GreedyDecoder = GreedyDecoder(), **preprocessing) -> Pipeline:
        return cls(lambda x: network.infer(x, weights, config), lambda x: signals.preprocess(x, **preprocessing), lambda x: decode(x, decoder))

    def run(self, reads: DataFrame) -> DataFrame:
        """Basecalls of (read_id, signal), or of (signal) alone, whose rows are then read_0, read_1, ... in their order.

        Empty signals give empty sequences. The length of the raw signal goes along with the read_id, so rows of one id, or of none, are
        calls of their own.
        """
        if "read_id" not in reads.columns:
            numbered = number_rows(reads.select("signal", F.monotonically_increasing_id().alias("order")), "order", name="n")
            reads = numbered.select(F.format_string("read_%d", "n").alias("read_id"), "signal")
        keyed = reads.select(F.struct("read_id", F.size("signal").alias("signal_length")).alias("read_id"), "signal")
        called = self.decoder(self.model(self.prepare(keyed)))
        return called.select(
            "read_id.read_id", "sequence", "quality_scores", "mean_confidence", "read_id.signal_length",
            F.length("sequence").alias("sequence_length"), F.length("sequence").alias("num_bases"),
        )


def basecall(reads: DataFrame, weights: dict[str, np.ndarray], config: network.NetConfig = network.NetConfig(), **preprocessing) -> DataFrame:
    """Basecalls of (read_id, signal) by the usual parts: preprocessing, network, greedy decoding."""
    return Pipeline.of_network(weights, config, **preprocessing).run(reads)


def basecall_file(spark: SparkSession, path: str, weights: dict[str, np.ndarray], config: network.NetConfig = network.NetConfig(), *, source: str = "fast5",
                  max_reads: int | None = None, fastq: str | None = None, fasta: str | None = None, single_file: bool = False, **preprocessing) -> DataFrame:
    """Basecalls of the reads of a file (of the first `max_reads` by read_id), also written as FASTQ or FASTA.

    These are folders of text in any store, or with `single_file` one file each, on a shared disk; records are in the order of read_id.

    `source` names the data source: multi-read HDF5, or any other with columns read_id and signal.
    """
    if source == "fast5":
        register_fast5(spark)
    found = spark.read.format(source).load(path)
    if max_reads is not None:
        found = found.orderBy("read_id").limit(max_reads)
    calls = materialize(basecall(found.select("read_id", F.col("signal").cast("array<double>").alias("signal")), weights, config, **preprocessing), "calls")
    name = F.col("read_id").cast("string")
    write = write_file if single_file else write_records
    if fastq:
        write(calls.select("read_id", records.fastq(name, F.col("sequence"), F.col("quality_scores")).alias("record")), fastq, order_by="read_id")
    if fasta:
        write(calls.select("read_id", records.fasta(name, F.col("sequence"), F.col("mean_confidence")).alias("record")), fasta, order_by="read_id")
    return calls


def summary(calls: DataFrame, seconds: float | None = None) -> DataFrame:
    """One row: counts, sums and means; the mean confidence is over reads with bases. With `seconds`, bases called a second."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = calls.agg(
        F.count("*").alias("num_reads"), F.coalesce(F.sum("num_bases"), F.lit(0)).alias("total_bases"),
        F.coalesce(F.sum("signal_length"), F.lit(0)).alias("total_samples"), zero(F.avg("num_bases")).alias("avg_length"),
        zero(F.avg(F.when(F.col("num_bases") > 0, F.col("mean_confidence")))).alias("avg_confidence"),
    )
    return out if seconds is None else out.withColumn("bases_per_second", F.col("total_bases") / F.lit(float(seconds)) if seconds > 0 else F.lit(0.0))

"""k-mer counting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.functions import dna

#: Bytes of sequence counted at a time; bounds a task's memory.
SLICE_BYTES = 2 << 20

_CODES = np.zeros(256, np.int64)
_CODES[[ord(b) for b in dna.BASES]] = range(4)


def _codes_of(data: np.ndarray, k: int) -> np.ndarray:
    """Code of the k bases from every position."""
    return rolled(_CODES[data], k)


def rolled(one: np.ndarray, k: int) -> np.ndarray:
    """Code of the k bases from every position, from codes of single bases, by joining codes of shorter stretches."""
    have, size = one, 1
    for bit in bin(k)[3:]:
        have = (have[:-size] << 2 * size) | have[size:]
        size *= 2
        if bit == "1":
            have = (have[:-1] << 2) | one[size:]
            size += 1
    return have


def _count(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0).cast(pa.large_binary()).fill_null(b"")
            _, offsets, data = column.buffers()
            offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            at = 0
            while at < len(column):
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
                part = data[offsets[at] : offsets[to]]
                if len(part) >= k:
                    ends = offsets[at + 1 : to + 1] - offsets[at]
                    whole = np.ones(len(part) - k + 1, bool)  # windows that lie in one sequence
                    for i in range(1, k):
                        cut = ends[(ends >= i) & (ends - i < len(whole))] - i
                        whole[cut] = False
                    kmer, n = np.unique(_codes_of(part, k)[whole], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(kmer), pa.array(n.astype(np.int64))], names=["kmer", "n"])
                at = to

    return run


def count_kmers(reads: DataFrame, k: int, min_count: int = 1, *, sequence: str = "sequence", canonical: bool = False) -> DataFrame:
    """(kmer, cnt) with cnt >= min_count.

    Tasks count slices of their reads with NumPy (rolling 2-bit codes), so one shuffle of
    partial counts with 8-byte keys is left to Spark.
    """
    dna.check_k(k)
    partial = reads.select(dna.clean(F.col(sequence)).alias("s")).mapInArrow(_count(k), "kmer long, n long")
    if canonical:
        partial = partial.select(dna.canonical(F.col("kmer"), k).alias("kmer"), "n")
    return partial.groupBy("kmer").agg(F.sum("n").alias("cnt")).where(F.col("cnt") >= min_count)


def _arrays(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            _, offsets, data = column.buffers()
            offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            at = 0
            while at < len(column):
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
                first = offsets[at:to] - offsets[at]
                n = np.maximum(np.diff(offsets[at : to + 1]) - k + 1, 0)
                ends = np.concatenate([[0], np.cumsum(n)])
                place = np.arange(ends[-1]) + np.repeat(first - ends[:-1], n)
                codes = _codes_of(data[offsets[at] : offsets[to]], k)[place] if len(place) else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(codes))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), lists], names=["read_id", "codes"])
                at = to

    return run


def kmer_arrays(reads: DataFrame, k: int, *, sequence: str = "sequence") -> DataFrame:
    """(read_id, codes): the codes of all k-mers of each read in order, as `dna.kmers` gives them, by NumPy over slices of reads."""
    dna.check_k(k)
    kind = reads.schema["read_id"].dataType.simpleString()
    return reads.select("read_id", dna.clean(F.col(sequence)).alias("s")).mapInArrow(_arrays(k), f"read_id {kind}, codes array<bigint>")

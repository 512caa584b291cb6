"""CTC greedy decoding as array expressions on a log-probability matrix (`array<array<double>>`)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandflow.functions.dna import BASES, bases_of_labels

BLANK = 4


def log_softmax(row: Column) -> Column:
    top = F.array_max(row)
    total = F.log(F.aggregate(row, F.lit(0.0), lambda a, x: a + F.exp(x - top)))
    return F.transform(row, lambda x: x - top - total)


def best_labels(lp: Column) -> Column:
    """Most likely class of each step, the lowest on ties."""
    return F.transform(lp, lambda row: (F.array_position(row, F.array_max(row)) - 1).cast("int"))


def cut(lp: Column, length: Column | None) -> Column:
    """The first `length` steps; all of them for a null length."""
    return lp if length is None else F.slice(lp, F.lit(1), F.greatest(F.coalesce(length, F.size(lp)), F.lit(0)))


def runs(lp: Column, blank: int = BLANK) -> Column:
    """Maximal runs of one label but blank: array of (label, start, end), the end inclusive."""

    def of(labels: Column) -> Column:
        marked = F.transform(labels, lambda x, i: F.when((i == 0) | (F.element_at(labels, F.greatest(i, F.lit(1))) != x), i).otherwise(-1))
        return F.element_at(F.transform(F.array(F.filter(marked, lambda i: i >= 0)), lambda starts: F.zip_with(
            starts, F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(labels))),
            lambda s, e: F.struct(F.element_at(labels, s + 1).alias("label"), s.alias("start"), (e - 1).alias("end")))), 1)

    # of an empty matrix the borders give one run without a label, which the comparison drops
    return F.filter(F.element_at(F.transform(F.array(best_labels(lp)), of), 1), lambda r: (r["label"] != blank) & r["start"].isNotNull())


def sequence(run: Column, alphabet: str = BASES) -> Column:
    return bases_of_labels(F.transform(run, lambda r: r["label"]), "drop", alphabet)


def peak_confidence(lp: Column, run: Column) -> Column:
    """Mean probability at the first step of each run; 0 without runs."""
    total = F.aggregate(run, F.lit(0.0), lambda a, r: a + F.exp(F.element_at(F.element_at(lp, r["start"] + 1), r["label"] + 1)))
    return F.coalesce(F.try_divide(total, F.size(run)), F.lit(0.0))


def base_confidences(lp: Column, run: Column) -> Column:
    """Mean probability of each run's label over its steps."""
    return F.transform(run, lambda r: F.aggregate(
        F.slice(lp, r["start"] + 1, r["end"] - r["start"] + 1), F.lit(0.0), lambda a, row: a + F.exp(F.element_at(row, r["label"] + 1))) / (r["end"] - r["start"] + 1))


def quality(confidence: Column, scale: float = 10.0) -> Column:
    """-scale * log10(1 - p), with p and the error kept within 1e-10 of their bounds."""
    p = F.least(F.greatest(confidence, F.lit(1e-10)), F.lit(1 - 1e-10))
    return -scale * F.log10(F.least(F.greatest(1 - p, F.lit(1e-10)), F.lit(1.0)))

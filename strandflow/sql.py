"""Functions for SQL text: `register(spark)` makes them known to a session.

Scalar functions are SQL expressions that Catalyst puts in place, so calls run in the JVM and are optimised like what
is written out. Table functions whose columns depend on their arguments are Python ones with `analyze`; rows
stay one read each, so they are called with LATERAL.

| function | |
|-|-|
| `clean_bases(s)`, `reverse_complement(s)`, `gc_content(s)` | upper-case bases without other letters; complement read backward; share of G and C |
| `signal_median(a)`, `signal_mad(a)`, `signal_normalize(a, clip)` | of an `array<double>` |
| `basecall_quality(p)` | Phred quality of a confidence |
| `kmers(sequence, k [, canonical])` | table: pos, kmer (bases), code where 2k bits fit a long (k <= 31), and with canonical the lesser strand |
| `signal_chunks(signal, size)` | table: start, size, chunk (an array of the signal's own type), is_last |
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from strandflow.functions.dna import BASES
from strandflow.functions.signal import LEAST_MAD, MAD_SCALE
from strandflow.session import attach



def _with(value: str, name: str, use: str) -> str:
    """`use` with `name` for the value, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {use}), 1)"


def _median(array: str) -> str:
    return _with(f"array_sort({array})", "s", "(try_element_at(s, shiftright(size(s) + 1, 1)) + try_element_at(s, shiftright(size(s), 1) + 1)) / 2")


_MEDIAN = f"CASE WHEN size(a) > 0 THEN {_median('a')} END"
_MAD = f"CASE WHEN size(a) > 0 THEN coalesce(nullif({_with(_median('a'), 'm', _median('transform(a, x -> abs(x - m))'))}, 0D), {LEAST_MAD}D) END"
_NORMAL = _with(f"struct({_MEDIAN} AS m, {_MAD} * {MAD_SCALE}D AS d)", "c", "transform(a, x -> greatest(-clip, least(clip, (x - c.m) / c.d)))")
#: name(parameters), type, body
SCALAR = [
    ("clean_bases(s STRING)", "STRING", "regexp_replace(upper(s), '[^ATCG]', '')"),
    ("reverse_complement(s STRING)", "STRING", "regexp_replace(translate(reverse(upper(s)), 'ATCG', 'TAGC'), '[^ATCG]', 'N')"),
    ("gc_content(s STRING)", "DOUBLE", "coalesce(try_divide(length(regexp_replace(upper(s), '[^GC]', '')), length(regexp_replace(upper(s), '[^ATCG]', ''))), 0D)"),
    ("signal_median(a ARRAY<DOUBLE>)", "DOUBLE", _MEDIAN),
    ("signal_mad(a ARRAY<DOUBLE>)", "DOUBLE", _MAD),
    ("signal_normalize(a ARRAY<DOUBLE>, clip DOUBLE)", "ARRAY<DOUBLE>", _NORMAL),
    ("basecall_quality(p DOUBLE)", "DOUBLE", "-10D * log10(least(greatest(1D - least(greatest(p, 1e-10D), 1D - 1e-10D), 1e-10D), 1D))"),
]
_PAIR = str.maketrans("ATCG", "TAGC")
_DIGIT = {b: i for i, b in enumerate(BASES)}
_OTHERS = re.compile("[^ATCG]")


def _constant(argument: AnalyzeArgument, name: str, kinds: tuple):
    if not argument.isConstantExpression or not isinstance(argument.dataType, kinds) or argument.value is None:
        raise ValueError(f"{name} must be a constant of another type than given")
    return argument.value


class Kmers:
    """Rows of all windows of k bases; other letters than A, T, C and G count as A."""

    @staticmethod
    def analyze(sequence: AnalyzeArgument, k: AnalyzeArgument, canonical: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(sequence.dataType, T.StringType):
            raise ValueError("kmers needs a string")
        size = _constant(k, "k", (T.IntegerType, T.LongType))
        if size < 1:
            raise ValueError("k must be positive")
        schema = T.StructType().add("pos", T.IntegerType()).add("kmer", T.StringType())
        if size <= 31:
            schema = schema.add("code", T.LongType())
        if canonical is not None and _constant(canonical, "canonical", (T.BooleanType,)):
            schema = schema.add("canonical", T.StringType())
        return AnalyzeResult(schema)

    def eval(self, sequence: str | None, k: int, canonical: bool = False) -> Iterator[tuple]:
        if sequence is None:
            return
        bases = _OTHERS.sub("A", sequence.upper())
        back = bases.translate(_PAIR)[::-1] if canonical else ""
        n, top, mask = len(bases), 2 * k - 2, (1 << 2 * k) - 1
        code = behind = 0  # of the last k bases and of their complement read backward
        for end, digit in enumerate(map(_DIGIT.__getitem__, bases), 1):
            code = (code << 2 | digit) & mask
            behind = behind >> 2 | (digit ^ 1) << top
            if end >= k:
                word = bases[end - k : end]
                row = (end - k, word, code) if k <= 31 else (end - k, word)
                yield (*row, word if code <= behind else back[n - end : n - end + k]) if canonical else row


class SignalChunks:
    """Rows of consecutive pieces of an array, the last one shorter; none of a null or empty one."""

    @staticmethod
    def analyze(signal: AnalyzeArgument, size: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(signal.dataType, T.ArrayType):
            raise ValueError("signal_chunks needs an array")
        if _constant(size, "size", (T.IntegerType, T.LongType)) < 1:
            raise ValueError("size must be positive")
        return AnalyzeResult(T.StructType().add("start", T.IntegerType()).add("size", T.IntegerType()).add("chunk", signal.dataType).add("is_last", T.BooleanType()))

    def eval(self, signal: list | None, size: int) -> Iterator[tuple]:
        for start in range(0, len(signal or ()), size):
            piece = list(signal[start : start + size])
            yield start, len(piece), piece, start + size >= len(signal)


def register(spark: SparkSession) -> None:
    """Make all functions known to the session."""
    attach(spark)
    for head, kind, body in SCALAR:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    spark.udtf.register("kmers", udtf(Kmers))
    spark.udtf.register("signal_chunks", udtf(SignalChunks))

"""Column functions for DNA strings and packed k-mers (2 bits a base, first base highest)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The order of bases that defines codes and labels.
BASES = "ATCG"
COMPLEMENTS = "TAGC"


def check_k(k: int) -> int:
    if not 3 <= k <= 31:
        raise ValueError(f"k must be from 3 to 31 to fit a signed 64-bit code, not {k}")
    return k


def bases(text: Column) -> Column:
    """The letters A, T, C, G of a text (either case), in upper case."""
    return F.upper(F.regexp_replace(text, "[^ATCGatcg]+", ""))


def clean(sequence: Column) -> Column:
    """Upper case; any other letter counts as A, as in codes."""
    return F.regexp_replace(F.upper(sequence), "[^ATCG]", "A")


def _code_of_clean(sequence: Column) -> Column:
    return F.conv(F.translate(sequence, BASES, "0123"), 4, -10).cast("long")  # base -10 is signed decimal


def encode(kmer: Column) -> Column:
    """Code of a string of at most 32 bases, the 64 bits of 32 as a signed number; other letters count as A."""
    return _code_of_clean(clean(kmer))


def decode(code: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", BASES)


def reverse_complement(sequence: Column) -> Column:
    """Anything but upper-case A, T, C, G becomes N."""
    return F.regexp_replace(F.translate(F.reverse(sequence), BASES, COMPLEMENTS), "[^ATCG]", "N")


def reverse_complement_code(code: Column, k: int) -> Column:
    digits = F.reverse(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"))
    return F.conv(F.translate(digits, "0123", "1032"), 4, -10).cast("long")


def canonical(code: Column, k: int) -> Column:
    """The lesser of a code and its reverse complement, as unsigned numbers."""
    sign = F.lit(-(1 << 63) if k == 32 else 0).cast("long")
    return F.least(code.bitwiseXOR(sign), reverse_complement_code(code, k).bitwiseXOR(sign)).bitwiseXOR(sign)


def prefix(code: Column) -> Column:
    """Code without the last base."""
    return F.shiftrightunsigned(code, 2)


def suffix(code: Column, k: int) -> Column:
    """Code without the first base."""
    return code.bitwiseAND(F.lit((1 << 2 * (k - 1)) - 1))


def extend_right(node: Column, base: Column, k: int) -> Column:
    """Node ((k-1)-mer) moved on by one base code."""
    return F.shiftleft(node, 2).bitwiseOR(base.cast("long")).bitwiseAND(F.lit((1 << 2 * (k - 1)) - 1))


def edge_code(src: Column, dst: Column) -> Column:
    """k-mer of an edge between (k-1)-mers."""
    return F.shiftleft(src, 2).bitwiseOR(dst.bitwiseAND(F.lit(3)))


def windows(sequence: Column, k: int) -> Column:
    """Array of all substrings of k bases in order (other letters as A); empty if the sequence is shorter."""
    check_k(k)
    none = F.array().cast("array<string>")

    def of(s: Column) -> Column:
        last = F.length(s) - k + 1
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(s, i, F.lit(k)))).otherwise(none)

    # bound once: inside the inner lambda an expression would be computed again for every window
    return F.coalesce(F.element_at(F.transform(F.array(clean(sequence)), of), 1), none)


def kmers(sequence: Column, k: int) -> Column:
    """Array of the codes of all k-mers in order."""
    return F.transform(windows(sequence, k), _code_of_clean)


def gc_content(sequence: Column) -> Column:
    """Share of G and C among A, T, C, G; 0 for none."""
    gc = F.length(F.regexp_replace(sequence, "[^GC]", ""))
    return F.coalesce(F.try_divide(gc.cast("double"), F.length(F.regexp_replace(sequence, "[^ATCG]", ""))), F.lit(0.0))


def labels_of_bases(sequence: Column) -> Column:
    """Class numbers of the bases; other letters are dropped."""
    digits = F.translate(F.regexp_replace(F.upper(sequence), "[^ATCG]", ""), BASES, "0123")
    return F.when(F.length(digits) > 0, F.transform(F.split(digits, ""), lambda c: c.cast("int"))).otherwise(F.array().cast("array<int>"))


def bases_of_labels(labels: Column, unknown: str = "drop", alphabet: str = BASES) -> Column:
    """Text of class numbers; labels beyond the alphabet are dropped, become `N`, or raise (`unknown`: drop, N, fail)."""
    if unknown not in ("drop", "N", "fail"):
        raise ValueError(f"unknown must be drop, N or fail, not {unknown!r}")
    letters = F.array(*(F.lit(b) for b in alphabet))
    if unknown == "drop":
        labels = F.filter(labels, lambda x: (x >= 0) & (x < len(alphabet)))
    if unknown == "N":
        return F.array_join(F.transform(labels, lambda x: F.when((x >= 0) & (x < len(alphabet)), F.try_element_at(letters, x + 1)).otherwise("N")), "")
    return F.array_join(F.transform(labels, lambda x: F.element_at(letters, x + 1)), "")

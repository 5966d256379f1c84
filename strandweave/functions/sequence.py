"""DNA sequences as plain Spark strings over the upper-case alphabet ACGT.

Everything here is built from JVM-side expressions, so it stays inside the
projection that uses it. String order on ACGT equals base-code order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Base alphabet in code order, its complement, and the largest k per length class.
BASES = "ACGT"
COMPLEMENT = "TGCA"
SEED_LENGTHS = (4, 8, 16, 24, 32, 40, 48, 64, 96, 128)


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def normalise(seq: Column | str) -> Column:
    """Upper-case text with all white space removed."""
    return F.upper(F.regexp_replace(_c(seq), r"\s+", ""))


def is_dna(seq: Column | str) -> Column:
    """True where the sequence consists of A, C, G and T only."""
    return _c(seq).rlike("^[ACGT]*$")


def base_code(base: Column | str) -> Column:
    """Code 0..3 of one base letter in either case; 4 for any other letter."""
    at = F.instr(F.lit(BASES), F.upper(_c(base)))
    return F.when((F.length(_c(base)) == 1) & (at > 0), at - 1).otherwise(F.lit(4))


def base_letter(code: Column | str) -> Column:
    """Letter of a base code 0..3."""
    return F.substring(F.lit(BASES), _c(code) + 1, F.lit(1))


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(F.translate(_c(seq), BASES, COMPLEMENT))


def slice_seq(seq: Column | str, beg: Column, end: Column, rc: Column | bool = False) -> Column:
    """Bases ``beg..end`` (0-based, inclusive), reverse-complemented where ``rc``."""
    part = F.substring(_c(seq), beg + 1, end - beg + 1)
    if rc is True:
        return reverse_complement(part)
    if rc is False:
        return part
    return F.when(rc, reverse_complement(part)).otherwise(part)


def set_base(seq: Column | str, pos: Column, base: Column) -> Column:
    """Sequence with the base at 0-based ``pos`` replaced."""
    return F.overlay(_c(seq), base, pos + 1)


def kmers(seq: Column | str, k: int) -> Column:
    """Array of all k-mers in position order; empty for sequences shorter than k."""
    s = _c(seq)
    last = F.length(s) - k + 1
    return F.when(
        last >= 1,
        F.transform(F.sequence(F.lit(1), last), lambda p: F.substring(s, p, F.lit(k))),
    ).otherwise(F.array().cast("array<string>"))


def canonical_kmer(kmer: Column | str, rc: Column | str | None = None) -> Column:
    """The lesser of a k-mer and its reverse complement, which ``rc`` may give where it is at hand."""
    return F.least(_c(kmer), reverse_complement(kmer) if rc is None else _c(rc))


def kmer_is_rc(kmer: Column | str, rc: Column | str | None = None) -> Column:
    """True where the canonical form is the reverse complement; palindromes count as such."""
    return ~(_c(kmer) < (reverse_complement(kmer) if rc is None else _c(rc)))


def kmer_hash(kmer: Column | str) -> Column:
    """64-bit key of a k-mer for partitioning; equality must be confirmed on the text."""
    return F.xxhash64(_c(kmer))


def seed_length(min_overlap_len: int) -> int:
    """Longest supported seed that fits in every overlap of the given minimum length."""
    fitting = [k for k in SEED_LENGTHS if k <= min_overlap_len]
    if not fitting:
        raise ValueError("the minimum overlap length must be at least 4")
    return fitting[-1]

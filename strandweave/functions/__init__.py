"""Column expressions on DNA sequences and small numeric helpers."""

from strandweave.functions.numeric import (
    ceil_div,
    div_or_zero,
    mod_or_zero,
    parse_bounded_int,
    percent_of,
)
from strandweave.functions.sequence import (
    base_code,
    base_letter,
    canonical_kmer,
    is_dna,
    kmer_hash,
    kmer_is_rc,
    kmers,
    normalise,
    reverse_complement,
    seed_length,
    set_base,
    slice_seq,
)

__all__ = [
    "base_code",
    "base_letter",
    "canonical_kmer",
    "ceil_div",
    "div_or_zero",
    "is_dna",
    "kmer_hash",
    "kmer_is_rc",
    "kmers",
    "mod_or_zero",
    "normalise",
    "parse_bounded_int",
    "percent_of",
    "reverse_complement",
    "seed_length",
    "set_base",
    "slice_seq",
]

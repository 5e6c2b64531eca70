"""Nucleotide and coordinate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Complements, stop codons.
PLAIN, PLAIN_COMPLEMENT = "ACGT", "TGCA"
IUPAC, IUPAC_COMPLEMENT = "ACGTRYMKBDHVN", "TGCAYRKMVHDBN"
STOP_CODONS = ["TAA", "TAG", "TGA"]


def clean_bases(text: Column) -> Column:
    """Upper-cased bases without white space."""
    return F.upper(F.regexp_replace(text, r"\s+", ""))


def base_code(base: Column) -> Column:
    """A, C, G, T as 0..3 and any other letter as -1."""
    return F.instr(F.lit(PLAIN), base) - 1


def reverse_complement(bases: Column) -> Column:
    """Reverse complement; letters other than A, C, G, T become N."""
    known = F.regexp_replace(bases, "[^ACGT]", "N")
    return F.reverse(F.translate(known, PLAIN, PLAIN_COMPLEMENT))


def iupac_reverse_complement(bases: Column) -> Column:
    """Reverse complement that also complements the IUPAC ambiguity codes."""
    return F.reverse(F.translate(bases, IUPAC, IUPAC_COMPLEMENT))


def is_stop(codon: Column) -> Column:
    return codon.isin(STOP_CODONS)


def oriented_start(strand: Column, start0: Column, end0: Column, length: Column) -> Column:
    """Start of ``[start0, end0)`` on the given strand's own coordinates."""
    return F.when(strand == "+", start0).otherwise(length - end0)


def oriented_end(strand: Column, start0: Column, end0: Column, length: Column) -> Column:
    return F.when(strand == "+", end0).otherwise(length - start0)


def inside_contig(strand: Column, start0: Column, end0: Column, length: Column) -> Column:
    """A valid, non-empty interval on a known strand."""
    return strand.isin("+", "-") & (start0 >= 0) & (end0 > start0) & (end0 <= length)


def seeded_draw(seed: int, *parts: Column) -> Column:
    """Deterministic uniform integer in ``[0, 2**60)`` from a seed and a row's identity."""
    key = F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")

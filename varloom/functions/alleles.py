"""Allele codes: strand complement, ambiguity, and a key that all encodings of a pair share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def complement(a: Column) -> Column:
    """Other strand, base by base (for alleles of several bases the order is kept)."""
    return F.translate(a, "ACGT", "TGCA")


def pair(a1: Column, a2: Column) -> Column:
    return F.concat(a1, F.lit("/"), a2)


def pair_key(a1: Column, a2: Column) -> Column:
    """The least of the four encodings of an allele pair: as given, swapped, other strand, both."""
    c1, c2 = complement(a1), complement(a2)
    return F.least(pair(a1, a2), pair(a2, a1), pair(c1, c2), pair(c2, c1))


def ambiguous(a1: Column, a2: Column) -> Column:
    """A/T or C/G, which read the same on both strands."""
    return F.concat(a1, a2).isin("AT", "TA", "CG", "GC")


def swapped(a1: Column, a2: Column, ref1: Column, ref2: Column) -> Column:
    """Whether the first allele is the reference's second one, on either strand."""
    same = ((a1 == ref1) & (a2 == ref2)) | ((complement(a1) == ref1) & (complement(a2) == ref2))
    return ~same & (((a1 == ref2) & (a2 == ref1)) | ((complement(a1) == ref2) & (complement(a2) == ref1)))

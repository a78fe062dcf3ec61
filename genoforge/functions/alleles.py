"""Columns that classify alleles and score genotypes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Genotype models and what an allele count of a diploid genotype scores in each.
MODELS = ("allelic", "dominant", "recessive")


def allele_type(ref: Column, alt: Column) -> Column:
    """Kind of one ALT relative to REF: reference, unknown, substitution, insertion, deletion or mnp."""
    a, r = F.length(alt), F.length(ref)
    return (
        F.when(alt == ref, "reference").when(alt.isin("", ".", "N") | alt.isNull(), "unknown")
        .when((a == 1) & (r == 1), "substitution").when(alt.startswith("<INS>") | alt.startswith("I"), "insertion")
        .when(alt.startswith("<DEL>") | alt.startswith("D"), "deletion").when(a > r, "insertion").when(a < r, "deletion").otherwise("mnp")
    )


def is_transition(ref: Column, alt: Column) -> Column:
    return F.concat(F.least(ref, alt), F.greatest(ref, alt)).isin("AG", "CT")


def is_transversion(ref: Column, alt: Column) -> Column:
    return F.concat(F.least(ref, alt), F.greatest(ref, alt)).isin("AC", "AT", "CG", "GT")


def score(model: str, ac: Column) -> Column:
    """Score of an ALT count under a model; a missing genotype scores 0."""
    by = {"allelic": ac, "dominant": F.when(ac > 0, 1).otherwise(0), "recessive": F.when(ac == 2, 1).otherwise(0)}
    return F.coalesce(by[model], F.lit(0))


def hard_call(dosage: Column, within: float) -> Column:
    """ALT count of a dosage that lies within a distance of 0, 1 or 2, or null."""
    return F.when(dosage <= within, 0).when(F.abs(dosage - 1) <= within, 1).when(dosage >= 2 - within, 2)


def in_region(region: str, chr_: Column, bp: Column) -> Column:
    """`chr1`, `chr1:100`, `chr1:100..200`, `chr1:100-200` and `chr1:150+50` as a condition on a position."""
    name, _, span = region.partition(":")
    number = {"X": 23, "Y": 24, "M": 25}.get(name.removeprefix("chr").upper()) or int(name.removeprefix("chr"))
    here = chr_ == number
    if not span:
        return here
    if "+" in span:
        mid, around = map(int, span.split("+"))
        return here & bp.between(mid - around, mid + around)
    low, _, high = span.replace("..", "-").partition("-")
    return here & bp.between(int(low), int(high or low))


def is_region(region: str, chr_: Column, bp1: Column, bp2: Column) -> Column:
    """The region's chromosome, first and last base are exactly these; a bare chromosome is no region."""
    name, _, span = region.partition(":")
    if not span:
        return F.lit(False)
    number = {"X": 23, "Y": 24, "M": 25}.get(name.removeprefix("chr").upper()) or int(name.removeprefix("chr"))
    if "+" in span:
        mid, around = map(int, span.split("+"))
        low, high = mid - around, mid + around
    else:
        first, _, last = span.replace("..", "-").partition("-")
        low, high = int(first), int(last or first)
    return (chr_ == number) & (bp1 == low) & (bp2 == high)


def in_range(value: Column, text: str, bare: int = 0) -> Column:
    """`a:b`, `a-b`, `a:`, `:b`, `n` and `*`; a bare n means at most (-1), exactly (0) or at least (1) n. Negative values are in no range."""
    if text in ("*", "."):
        return value >= 0
    low, sep, high = text.partition(":") if ":" in text else text.partition("-")
    if not sep:
        n = float(text)
        return (value >= 0) & {-1: value <= n, 0: value == n, 1: value >= n}[bare]
    ends = sorted(float(x) for x in (low, high) if x)
    if low and high:
        return (value >= 0) & value.between(*ends)
    return (value >= 0) & (value >= ends[0] if low else value <= ends[0])

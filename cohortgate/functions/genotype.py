"""CPRA keys, alleles and VCF genotype fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortgate.fixed_values import GT_CODE_TEXT, GT_TEXT_CODES


def cpra_part(cpra: Column, index: int) -> Column:
    """Part 0..3 (chrom, pos, ref, alt); null when absent."""
    return F.get(F.split(cpra, ":"), F.lit(index))


def cpra_of(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    return F.concat_ws(":", chrom, pos.cast("string"), ref, alt)


def shared_end(left: Column, right: Column, cut) -> Column:
    """Bases two alleles share at one end, leaving at least one base on either."""
    limit = F.least(F.length(left), F.length(right)) - 1
    return F.when(
        limit >= 1,
        F.size(F.filter(F.sequence(F.lit(1), limit), lambda k: cut(left, k) == cut(right, k))),
    ).otherwise(0)


def allele_pair(ref: Column, alt: Column) -> Column:
    """The two alleles in alphabetical order, as one string."""
    return F.concat(F.least(ref, alt), F.greatest(ref, alt))


def gt_code(gt: Column) -> Column:
    """VCF GT text: -1 when any allele is missing, else the sum of allele indexes.

    The usual biallelic texts are read off directly; only other texts are taken apart.
    """
    alleles = F.split(gt, r"[/|]")
    total = F.aggregate(
        alleles, F.lit(0), lambda acc, allele: acc + F.coalesce(allele.try_cast("int"), F.lit(0))
    )
    missing = F.exists(alleles, lambda allele: allele.try_cast("int").isNull())
    general = F.when(F.coalesce(missing, F.lit(True)), -1).otherwise(total).cast("double")
    return F.coalesce(gt_text_code(F.replace(gt, F.lit("|"), F.lit("/"))), general)


def gt_text_code(gt: Column) -> Column:
    """Six exact GT strings; any other text is null."""
    out = F.lit(None).cast("double")
    for text, code in GT_TEXT_CODES.items():
        out = F.when(gt == text, float(code)).otherwise(out)
    return out


def gt_text(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for value, text in GT_CODE_TEXT.items():
        out = F.when(code == value, text).otherwise(out)
    return out


def chrom_rank(chrom: Column) -> Column:
    return (
        F.when(chrom.rlike(r"^[0-9]+$"), chrom.try_cast("int"))
        .when(chrom == "X", 23).when(chrom == "Y", 24).when(chrom == "MT", 25)
        .otherwise(99)
    )

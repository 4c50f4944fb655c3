"""Allele trimming, genome-build match and strand resolution, joined to reference tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortgate.fixed_values import AF_AMBIGUITY_BAND, PALINDROMES
from cohortgate.functions.genotype import allele_pair, cpra_of, shared_end
from cohortgate.functions.numbers import decimal_text
from cohortgate.operators import sizing


def strand_of(observed: Column, panel: Column) -> Column:
    """Orientation of a palindromic variant by frequency concordance with the panel."""
    same = F.abs(observed - panel)
    flipped = F.abs(observed - (F.lit(1.0) - panel))
    near_half = (F.abs(observed - 0.5) < AF_AMBIGUITY_BAND) | (F.abs(panel - 0.5) < AF_AMBIGUITY_BAND)
    return (
        F.when(observed.isNull() | panel.isNull() | near_half, "unresolved")
        .when(F.abs(same - flipped) < AF_AMBIGUITY_BAND, "unresolved")
        .when(same <= flipped, "forward")
        .otherwise("reverse")
    )


def _shown(value: Column) -> Column:
    return F.coalesce(decimal_text(value), F.lit("None"))


def trim_alleles(variants: DataFrame) -> DataFrame:
    """Add n_pos, n_ref, n_alt and normalized_cpra: the shared suffix goes first, then the shared
    prefix, which moves the position.

    Each step is a column of its own, so a shared length is found once per row and not again
    wherever it is used.
    """
    suffix = variants.withColumn(
        "_suffix", shared_end(F.upper("ref"), F.upper("alt"), F.right)
    ).withColumns({
        "_ref": F.left(F.upper("ref"), F.length("ref") - F.col("_suffix")),
        "_alt": F.left(F.upper("alt"), F.length("alt") - F.col("_suffix")),
    })
    prefix = suffix.withColumn("_prefix", shared_end(F.col("_ref"), F.col("_alt"), F.left))
    return prefix.withColumns({
        "n_pos": F.col("pos").cast("long") + F.col("_prefix"),
        "n_ref": F.right("_ref", F.length("_ref") - F.col("_prefix")),
        "n_alt": F.right("_alt", F.length("_alt") - F.col("_prefix")),
    }).withColumn(
        "normalized_cpra", cpra_of(F.col("chrom"), F.col("n_pos"), F.col("n_ref"), F.col("n_alt"))
    ).drop("_suffix", "_ref", "_alt", "_prefix")


def with_preflight(matched: DataFrame, bases: DataFrame, panel_maf: DataFrame) -> DataFrame:
    """Add the pre-flight record and ``preflight_reject``.

    ``bases`` is (build, chrom, pos, base), ``panel_maf`` is (cpra, panel_maf). Both may be as
    large as a genome: they are joined by key and not broadcast. A build has one base per position: where
    ``bases`` lists several, the last in alphabetical order counts, and a request stays one row.
    """
    trimmed = trim_alleles(matched)

    def base_of(build: str) -> Column:
        return F.max(F.when(F.col("build") == build, F.col("base")))

    # Both builds side by side: the requests are joined to the bases once.
    both = bases.filter(F.col("build").isin("GRCh38", "GRCh37")).groupBy("chrom", F.col("pos").alias("n_pos")).agg(
        base_of("GRCh38").alias("base38"), base_of("GRCh37").alias("base37")
    )
    joined = (
        trimmed.join(sizing.shuffled(both), ["chrom", "n_pos"], "left")
        .join(sizing.shuffled(panel_maf.withColumnRenamed("cpra", "normalized_cpra")), "normalized_cpra", "left")
    )
    anchor = F.left(F.col("n_ref"), F.lit(1))
    on38 = F.coalesce(F.col("base38") == anchor, F.lit(False))
    on37 = F.coalesce(F.col("base37") == anchor, F.lit(False))
    palindrome = allele_pair(F.col("n_ref"), F.col("n_alt")).isin(PALINDROMES)
    strand = F.when(palindrome, strand_of(F.col("observed_maf"), F.col("panel_maf"))).otherwise("n/a")

    return joined.withColumns({
        "preflight_reject": F.when(on38, F.lit(None).cast("string"))
        .when(on37, "build_mismatch_grch37")
        .when(F.col("base38").isNotNull(), "reference_mismatch"),
        "build_resolved": F.when(on38, "GRCh38").otherwise(F.col("build")),
        "ref_matched": on38,
        "is_palindromic": palindrome,
        "strand": strand,
        "ambiguous": strand == "unresolved",
    }).drop("base38", "base37")


def caveats() -> Column:
    """The pre-flight record in words: trimming, build and strand notes that apply."""
    palindrome, strand = F.col("is_palindromic"), F.col("strand")
    locus = F.concat_ws(":", F.col("chrom"), F.col("n_pos").cast("string"))
    trimmed_note = F.when(
        F.col("normalized_cpra") != F.col("cpra"),
        F.concat(
            F.lit("Normalized "), F.col("cpra"), F.lit(" -> "), F.col("normalized_cpra"),
            F.lit(" (parsimonious left-aligned form)."),
        ),
    )
    build_note = F.when(
        F.col("ref_matched"),
        F.concat(
            F.lit("Client request is a CPRA ("), locus,
            F.lit(":...) with no explicit genome build; GRCh38 confirmed by REF-to-reference match (REF '"),
            F.col("n_ref"), F.lit("')."),
        ),
    ).otherwise(
        F.concat(
            F.lit("Reference base for "), locus, F.lit(" not in the mock reference; build "),
            F.col("build"),
            F.lit(
                " asserted by CPRA convention, NOT reference-matched — verify against in-TRE FASTA."
            ),
        )
    )
    pair = F.concat_ws("/", "n_ref", "n_alt")
    frequencies = (_shown(F.col("observed_maf")), _shown(F.col("panel_maf")))
    strand_note = F.when(
        palindrome & (strand == "unresolved"),
        F.concat(
            pair,
            F.lit(
                " is a palindromic (strand-ambiguous) SNP and its strand could NOT be resolved by "
                "allele-frequency concordance (cohort MAF "
            ),
            frequencies[0], F.lit(", panel "), frequencies[1],
            F.lit(
                "); orientation is provisional — confirm against the array assay design before recall."
            ),
        ),
    ).when(
        palindrome,
        F.concat(
            pair, F.lit(" is a palindromic SNP; strand resolved as "), strand,
            F.lit(" by allele-frequency concordance (cohort MAF "), frequencies[0],
            F.lit(" concords with the reference panel "), frequencies[1], F.lit(")."),
        ),
    )
    return F.array_compact(F.array(trimmed_note, build_note, strand_note))

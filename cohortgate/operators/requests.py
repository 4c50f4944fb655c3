"""Request rules, manifest matching and source decisions. A rejected request stays a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortgate.fixed_values import (
    BUILDS,
    CARRIER_DEFINITIONS,
    CONTIG_LENGTHS,
    CPRA_PATTERN,
    REQUESTED_SOURCES,
)
from cohortgate.functions import coerce
from cohortgate.functions.genotype import cpra_of
from cohortgate.operators import sizing
from cohortgate.policy import AnalysisPolicy

ARRAY_ABSENT = (
    "Requested source includes array, but the exact CPRA is absent from the array resource; "
    "array-direct evidence is unavailable for this request."
)
IMPUTED_ABSENT = (
    "Requested source includes imputed, but the exact CPRA is absent from the imputed resource; "
    "imputed evidence is unavailable for this request."
)


def contig_length(chrom: Column) -> Column:
    """Length of a known contig, else null. A 25-entry literal map, so no join."""
    entries = ", ".join(f"'{name}', {length}L" for name, length in CONTIG_LENGTHS.items())
    return F.try_element_at(F.expr(f"map({entries})"), chrom)


def with_violations(requests: DataFrame, policy: AnalysisPolicy) -> DataFrame:
    """Add ``violations``: the codes of every broken request rule, in rule order.

    ``pos`` may be text or a number; text that is not an integer breaks the position rule.
    """
    pos = F.col("pos").cast("string").try_cast("long")
    length = contig_length(F.col("chrom"))
    rules = [
        ("bad_cpra_format", F.col("cpra").rlike(CPRA_PATTERN)),
        ("invalid_chromosome", length.isNotNull()),
        ("pos_not_positive", pos >= 1),
        ("bad_build", F.col("build").isin(BUILDS)),
        ("bad_carrier_definition", F.col("carrier_definition").isin(CARRIER_DEFINITIONS)),
        ("bad_requested_source", F.col("requested_source").isin(REQUESTED_SOURCES)),
        ("missing_study_or_purpose", F.col("study_id").isNotNull() & F.col("purpose").isNotNull()),
        ("cpra_inconsistent", F.col("cpra") == cpra_of(F.col("chrom"), pos, F.col("ref"), F.col("alt"))),
        ("ref_equals_alt", F.col("ref") != F.col("alt")),
        ("pos_beyond_contig", F.coalesce(pos <= length, F.lit(True))),
        ("carrier_definition_mismatch", F.col("carrier_definition") == policy.carrier_definition),
    ]
    codes = [F.when(~coerce.holds(ok), F.lit(code)) for code, ok in rules]
    return requests.withColumn("violations", F.array_compact(F.array(*codes)))


def first_or_null(codes: Column) -> Column:
    return F.get(codes, F.lit(0))


def batch_headers(requests: DataFrame) -> DataFrame:
    """One row per batch: size, and the study and purpose of its first member.

    Resolved requests also tell whether any member was rejected, which rejects the batch.
    """
    summed = [
        F.count(F.lit(1)).alias("members"),
        F.min_by("study_id", "ordinal").alias("study_id"),
        F.min_by(F.coalesce("purpose", F.lit("")), F.col("ordinal")).alias("purpose"),
    ]
    if "status" in requests.columns:
        summed.append(F.bool_or(F.col("status") == "rejected").alias("rejected"))
    return requests.groupBy("batch_id").agg(*summed)


def overlay_identifiability(manifest: DataFrame, listed: DataFrame) -> DataFrame:
    """Public-list membership and reliability replace the manifest's own; the rest is unchanged."""

    def text(flag: Column) -> Column:
        return F.when(flag, "TRUE").otherwise("FALSE")

    overlay = listed.select(
        "cpra",
        text(coerce.strict_bool_or_fail(F.col("on_array"), "variant_identifiability")).alias("_array"),
        text(coerce.strict_bool_or_fail(F.col("on_imputed"), "variant_identifiability")).alias("_imputed"),
        text(
            ~coerce.strict_bool_or_fail(F.col("annotation_reliable"), "variant_identifiability")
        ).alias("_inaccurate"),
    )
    replaced = {"on_array": "_array", "on_imputed": "_imputed", "inaccurate_annotation": "_inaccurate"}
    joined = manifest.join(sizing.shuffled(overlay), "cpra", "left")
    return joined.select(*[
        F.coalesce(replaced[name], name).alias(name) if name in replaced else F.col(name)
        for name in manifest.columns
    ])


def typed_manifest(manifest: DataFrame) -> DataFrame:
    """Manifest text as typed columns, normalised once at the scan."""
    return manifest.select(
        "cpra",
        F.col("build").alias("m_build"), F.col("ref").alias("m_ref"), F.col("alt").alias("m_alt"),
        coerce.manifest_flag(F.col("on_array")).alias("variant_on_array"),
        coerce.manifest_flag(F.col("on_imputed")).alias("variant_on_imputed"),
        (~coerce.manifest_flag(F.col("inaccurate_annotation"))).alias("annotation_reliable"),
        coerce.manifest_flag(F.col("multiallelic_variant")).alias("multiallelic"),
        coerce.optional_number(F.col("dosage_r2")).alias("variant_info"),
        F.coalesce(
            coerce.optional_number(F.col("array_maf")), coerce.optional_number(F.col("imputed_maf"))
        ).alias("observed_maf"),
    )


def match_manifest(requests: DataFrame, manifest: DataFrame) -> DataFrame:
    """Join requests to the typed manifest and add ``manifest_reject`` (the first failed check)."""
    joined = requests.join(sizing.shuffled(typed_manifest(manifest)), "cpra", "left")
    return joined.withColumn(
        "manifest_reject",
        F.when(F.col("m_build").isNull() & F.col("m_ref").isNull(), "not_in_manifest")
        .when(~F.col("m_build").eqNullSafe(F.col("build")), "build_mismatch")
        .when(
            ~(F.col("m_ref").eqNullSafe(F.col("ref")) & F.col("m_alt").eqNullSafe(F.col("alt"))),
            "allele_mismatch",
        )
        .when(~F.col("annotation_reliable"), "inaccurate_annotation")
        .when(F.col("multiallelic"), "multiallelic"),
    )


def requested_sources(requested_source: Column) -> Column:
    """The requested sources as an array; unknown text gives null."""
    return (
        F.when(requested_source == "array", F.array(F.lit("array")))
        .when(requested_source == "imputed", F.array(F.lit("imputed")))
        .when(requested_source == "array_and_imputed", F.array(F.lit("array"), F.lit("imputed")))
    )


def with_availability(matched: DataFrame) -> DataFrame:
    """Requested sources against resource membership: six flags and the caveat texts."""
    wanted = requested_sources(F.col("requested_source"))
    asks_array = coerce.holds(F.array_contains(wanted, "array"))
    asks_imputed = coerce.holds(F.array_contains(wanted, "imputed"))
    has_array = coerce.holds(F.col("variant_on_array"))
    has_imputed = coerce.holds(F.col("variant_on_imputed"))
    return matched.withColumns({
        "requested_array": asks_array,
        "requested_imputed": asks_imputed,
        "array_available": has_array,
        "imputed_available": has_imputed,
        "array_requested_available": ~asks_array | has_array,
        "imputed_requested_available": ~asks_imputed | has_imputed,
        "requested_sources_available": (~asks_array | has_array) & (~asks_imputed | has_imputed),
        "source_caveats": F.array_compact(F.array(
            F.when(asks_array & ~has_array, F.lit(ARRAY_ABSENT)),
            F.when(asks_imputed & ~has_imputed, F.lit(IMPUTED_ABSENT)),
        )),
    })


def with_source_decision(matched: DataFrame, policy: AnalysisPolicy) -> DataFrame:
    """``use_array``, ``use_imputed`` and ``imp_high`` for each request."""
    info = F.col("variant_info")
    use_array = F.col("variant_on_array") & F.col("requested_source").isin("array", "array_and_imputed")
    use_imputed = (
        F.col("variant_on_imputed")
        & F.col("requested_source").isin("imputed", "array_and_imputed")
        & (info >= policy.imputed_dr2_min)
    )
    return matched.withColumns({
        "use_array": coerce.holds(use_array),
        "use_imputed": coerce.holds(use_imputed),
        "imp_high": coerce.holds(info >= policy.imputed_dr2_high_confidence),
    })


def id_token(value: Column) -> Column:
    """Runs of other characters become one dash; blank gives REQUEST."""
    dashed = F.regexp_replace(F.trim(value), "[^A-Za-z0-9]+", "-")
    token = F.upper(F.regexp_replace(dashed, "^-+|-+$", ""))
    return F.when(token == "", "REQUEST").otherwise(token)


def panel_label(value: Column) -> Column:
    return F.replace(F.lower(F.trim(value)), F.lit("_"), F.lit(" "))


def default_study_id(kind: str, name: Column, prefix: str) -> Column:
    """Default id of a gene or panel request, e.g. ``<prefix>-GENE1-GENE``."""
    return F.concat(F.lit(f"{prefix}-"), id_token(name), F.lit(f"-{kind.upper()}"))

"""Result rows: counts, tokens, assumptions, limitations and the recommendation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortgate.functions import disclosure as dc
from cohortgate.functions.numbers import decimal_text
from cohortgate.policy import AnalysisPolicy

INDEL_CAVEAT = (
    "Variant is an indel not directly typed on the array; short frameshift indels can impute "
    "unreliably, so confirm with a targeted assay before recall."
)
CLOSING_LIMITATIONS = [
    "Genotype feasibility only — ICD-10 phenotype eligibility is assessed downstream by "
    "epidemiology and will reduce the count.",
    "Sample-level flags (sex-check, relatedness) are recorded in the internal table for review, "
    "not silently dropped.",
    "Counts are a feasibility estimate for recruitment planning, not a final invitation list.",
]


def assumptions(policy: AnalysisPolicy) -> Column:
    return F.array(
        F.concat(
            F.lit("Carrier definition: "), F.col("carrier_definition"),
            F.lit(" (>=1 alt allele '"), F.col("alt"), F.lit("')."),
        ),
        F.lit(f"Array QC: call_rate >= {policy.array_call_rate_min}, GQ >= {policy.array_gq_min}."),
        F.lit(
            "Imputed evidence is used only when the exact CPRA is present in the imputed resource, "
            f"variant dosage r2 (DR2) >= {policy.imputed_dr2_min}, and per-participant max genotype "
            f"probability >= {policy.imputed_max_gp_min}."
        ),
        F.lit("Consent gate: withdrawn participants excluded from any recontact set."),
    )


def dr2_limitation(policy: AnalysisPolicy) -> Column:
    info = F.col("variant_info")
    shown = decimal_text(info)
    tier = F.when(info >= policy.imputed_dr2_high_confidence, "high").otherwise("moderate")
    return (
        F.when(
            ~F.col("variant_on_imputed"),
            "Exact CPRA is absent from the imputed public variant list; imputed evidence is not "
            "used for this variant.",
        )
        .when(
            info.isNull(),
            "Imputed dosage r2 (DR2) is unavailable; imputed evidence is not counted.",
        )
        .when(
            info < policy.imputed_dr2_min,
            F.concat(
                F.lit("Imputed dosage r2 (DR2) = "), shown,
                F.lit(
                    f" (below configured floor {policy.imputed_dr2_min}); imputed evidence is not "
                    "counted without review or confirmatory genotyping."
                ),
            ),
        )
        .otherwise(F.concat(
            F.lit("Imputed dosage r2 (DR2) = "), shown, F.lit(" ("), tier,
            F.lit(
                "); imputed-only carriers are conditional and benefit from confirmatory genotyping."
            ),
        ))
    )


def indel_caveat() -> Column:
    untyped_indel = ~F.col("variant_on_array") & (F.length("ref") != F.length("alt"))
    return F.when(untyped_indel, INDEL_CAVEAT)


def limitations(policy: AnalysisPolicy) -> Column:
    own = F.array(indel_caveat(), dr2_limitation(policy), *[F.lit(t) for t in CLOSING_LIMITATIONS])
    return F.array_compact(F.concat(F.col("caveats"), own))


def recommendation() -> Column:
    causes = F.array_join(F.array_compact(F.array(
        F.when(
            F.col("conditional") > 0,
            F.lit("part of the pool is imputed-supported (conditional confidence)"),
        ),
        F.when(
            F.col("breakdown_suppressed"),
            F.lit("the subgroup breakdown is suppressed under disclosure control"),
        ),
        F.when(
            F.col("client_total").startswith("<"),
            F.lit("the total is below the disclosure-control minimum cell size"),
        ),
    )), "; ")
    return (
        F.when(
            F.col("total") == 0,
            "NO-GO — no eligible consented carriers identified at the applied QC thresholds.",
        )
        .when(
            causes != "",
            F.concat(
                F.lit("GO WITH CAVEATS — a credible carrier pool exists, but "), causes, F.lit("."),
            ),
        )
        .otherwise(
            "GO — a credible high-confidence carrier pool exists; proceed to phenotype eligibility."
        )
    )


def final_recommendation() -> Column:
    return (
        F.when(
            F.col("post_phenotype_eligible") == 0,
            "NO-GO — no phenotype-eligible carriers remain after ICD-10 assessment.",
        )
        .when(
            F.col("eligible_suppressed"),
            "GO WITH CAVEATS — eligible carriers exist but the count is below the "
            "disclosure-control minimum; treat as a small pool.",
        )
        .otherwise(
            "GO — a phenotype-eligible carrier pool exists; proceed to recruitment planning."
        )
    )


def factsheet(results: DataFrame, policy: AnalysisPolicy) -> DataFrame:
    """Aggregate-only facts, one row per accepted request."""
    return results.select(
        "request_id", "study_id", "cpra", "build", "requested_source", "variant_on_array",
        "variant_on_imputed", "client_total", "breakdown_suppressed", "reported_cells",
        F.lit(policy.sdc_min_cell).alias("min_cell"), F.lit(policy.sdc_round_to).alias("round_to"),
        "recommendation", "assumptions", "limitations",
    )


def portfolio(results: DataFrame, policy: AnalysisPolicy) -> DataFrame:
    return results.select(
        "request_id", "study_id", "cpra", "purpose", "client_total",
        F.when(F.col("breakdown_suppressed"), "suppressed").otherwise("shown").alias("breakdown"),
        "variant_on_array", "recommendation", F.lit(policy.sdc_min_cell).alias("min_cell"),
    )


def breakdown_tokens(policy: AnalysisPolicy) -> tuple[Column, Column]:
    base = policy.sdc_round_to
    return tuple(
        F.concat(F.lit("~"), dc.rounded(F.col(name), base).cast("string"))
        for name in ("high_confidence", "conditional")
    )

"""Phenotype returns: validation, human-review gate and the final result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortgate.functions import disclosure as dc
from cohortgate.functions.coerce import holds
from cohortgate.operators import sizing
from cohortgate.operators.identifiers import has_identifier_text
from cohortgate.operators.results import final_recommendation
from cohortgate.policy import AnalysisPolicy, Deployment

TEXT_FIELDS = [
    "phenotype_definition_id", "icd10_codeset_label", "icd10_codeset_version",
    "linked_record_scope", "reviewer", "return_timestamp",
]


def match_returns(results: DataFrame, returns: DataFrame) -> DataFrame:
    """Results with their return, joined on study and variant. Unmatched returns drop out here."""
    renamed = returns.withColumnsRenamed({"run_id": "return_run_id", "caveats": "return_caveats"})
    return results.join(sizing.shuffled(renamed), ["study_id", "cpra"])


def unmatched_returns(results: DataFrame, returns: DataFrame) -> DataFrame:
    """Returns whose study and variant no result has."""
    return returns.join(results.select("study_id", "cpra"), ["study_id", "cpra"], "left_anti")


def with_return_violations(matched: DataFrame, deployment: Deployment) -> DataFrame:
    """Add ``return_violations`` to (result, return) pairs. ``total`` is the genotype ceiling."""
    texts = F.concat_ws(" \n ", *TEXT_FIELDS, F.array_join("return_caveats", " \n "))
    rules = [
        ("run_id_mismatch", ~holds(F.col("return_run_id") == F.col("run_id"))),
        ("not_signed", ~holds(F.col("sign_off_status") == "signed")),
        (
            "missing_phenotype_metadata",
            ~holds((F.col("phenotype_definition_id") != "") & (F.col("icd10_codeset_label") != "")),
        ),
        ("negative_count", ~holds(F.col("eligible_count") >= 0)),
        ("above_ceiling", holds(F.col("eligible_count") > F.col("total"))),
        ("contains_identifier", holds(has_identifier_text(texts, deployment))),
    ]
    return matched.withColumn(
        "return_violations",
        F.array_compact(F.array(*[F.when(bad, F.lit(code)) for code, bad in rules])),
    )


def blocking_checkpoints(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.filter(F.col("decision").isin("block", "query"))


def review_passed(rows: DataFrame, checkpoints: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without any blocking or open review decision."""
    return rows.join(sizing.shuffled(blocking_checkpoints(checkpoints).select(*keys)), keys, "left_anti")


def final_results(valid: DataFrame, policy: AnalysisPolicy) -> DataFrame:
    """Ceiling and eligible count, both disclosure-controlled, with provenance and caveats."""
    m, base = policy.sdc_min_cell, policy.sdc_round_to
    own = F.array(
        F.lit(
            "The genotype count is an UPPER BOUND (ceiling); the post-phenotype eligible count is "
            "the figure for recruitment after ICD-10 assessment by epidemiology."
        ),
        F.concat(
            F.lit("Phenotype: "), F.col("phenotype_definition_id"), F.lit(" (ICD-10 "),
            F.col("icd10_codeset_label"), F.lit(" "), F.col("icd10_codeset_version"),
            F.lit("); linked-record scope: "), F.col("linked_record_scope"), F.lit("."),
        ),
        F.concat(
            F.lit("Epidemiology sign-off: "), F.col("reviewer"), F.lit(" at "),
            F.col("return_timestamp"), F.lit("."),
        ),
    )
    closing = F.array(F.lit(
        f"Disclosure control (min cell {m}, round to {base}) applied to both the genotype ceiling "
        "and the post-phenotype eligible count."
    ))
    no_caveats = F.array().cast("array<string>")
    out = valid.select(
        "request_id", "study_id", "cpra", "purpose", "build", "ref", "alt", "carrier_definition",
        F.col("total").alias("genotype_total_included"),
        F.col("eligible_count").alias("post_phenotype_eligible"),
        dc.total_token(F.col("total"), m, base).alias("client_genotype_ceiling"),
        dc.total_token(F.col("eligible_count"), m, base).alias("client_eligible"),
        dc.below_minimum(F.col("eligible_count"), m, base).alias("eligible_suppressed"),
        "phenotype_definition_id", "icd10_codeset_label", "icd10_codeset_version",
        F.col("reviewer").alias("epi_reviewer"), F.col("return_timestamp").alias("epi_timestamp"),
        F.concat(own, F.coalesce("return_caveats", no_caveats), closing).alias("final_caveats"),
    )
    return out.withColumn("final_recommendation", final_recommendation())


def notifications(runs: DataFrame, state: str, owner: str = "recontact service") -> DataFrame:
    """Internal turnaround notes, one per run."""
    return runs.select(
        "study_id", "cpra", "run_id",
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("received_timestamp"),
        F.lit(state).alias("workflow_state"), F.lit(owner).alias("owner"),
        F.lit("").alias("due_date"), F.lit("").alias("eta"),
        F.lit(None).cast("string").alias("escalation_reason"),
    )

"""Aggregate-only review views. None of them may carry a participant column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortgate.functions.numbers import decimal_text

from cohortgate.operators.checks import forbid_identifiers
from cohortgate.operators.evidence import EVALUATION_KEY


def _counted(df: DataFrame, columns: list[str]) -> DataFrame:
    """Row counts per group, largest first, then by the keys. Null keys are a group."""
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("count"))
    return forbid_identifiers(counted).orderBy(F.desc("count"), *columns)


def decision_reasons(classified: DataFrame, compat: bool = False) -> DataFrame:
    """Counts per decision and reason.

    An excluded row can have an empty reason (its evidence is not credible or not allowed). It
    is named ``no_credible_evidence``; ``compat`` labels every empty reason ``included``.
    """
    blank = F.lit("included") if compat else F.when(
        F.col("decision") == "included", "included"
    ).otherwise("no_credible_evidence")
    reason = F.when(F.col("reason") == "", blank).otherwise(F.col("reason"))
    return _counted(
        classified.select(*EVALUATION_KEY, "decision", reason.alias("reason")),
        [*EVALUATION_KEY, "decision", "reason"],
    )


def decision_tiers(classified: DataFrame) -> DataFrame:
    return _counted(classified, [*EVALUATION_KEY, "decision", "confidence", "evidence_priority"])


def funnel(results: DataFrame) -> DataFrame:
    """Candidate, excluded, included and released rows of each result."""

    def step(number: int, name: str, value, visible: bool, note: str):
        return F.struct(
            F.lit(number).alias("step_no"), F.lit(name).alias("step"),
            value.cast("string").alias("count"), F.lit(visible).alias("client_visible"),
            F.lit(note).alias("note"),
        )

    return forbid_identifiers(results.select("request_id", F.inline(F.array(
        step(1, "Candidate rows", F.col("total") + F.col("excluded"), False,
             "Internal slice after request/manifest validation"),
        step(2, "Excluded before recontact", F.col("excluded"), False,
             "Consent/QC/source failures retained internally as reason codes"),
        step(3, "Included genotype carriers", F.col("total"), False,
             "Internal exact count before disclosure control"),
        step(4, "Client count", F.col("client_total"), True,
             "SDC-applied token in the airlock export candidate"),
    ))))


def source_decisions(results: DataFrame) -> DataFrame:
    def row(name: str, value):
        return F.struct(F.lit(name).alias("check"), value.cast("string").alias("value"))

    dr2 = F.when(F.col("variant_on_imputed"), decimal_text(F.col("variant_info"))).otherwise("not used")
    return results.select("request_id", F.inline(F.array(
        row("Requested source", F.col("requested_source")),
        row("Variant on array", F.col("variant_on_array")),
        row("Array evidence used", F.col("use_array")),
        row("Imputed evidence used", F.col("use_imputed")),
        row("Imputed DR2", dr2),
    )))


def disclosure_fields(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """What the release gate was asked to pass. ``verdicts`` is (candidate_id, ancestry_suppressed)."""

    def row(name: str, value):
        return F.struct(F.lit(name).alias("field"), value.cast("string").alias("value"))

    return candidates.join(verdicts, "candidate_id", "left").select("candidate_id", F.inline(F.array(
        row("client_total", F.col("client_total")),
        row("breakdown_suppressed", F.col("breakdown_suppressed")),
        row("reported_cells", F.size("reported_cells")),
        row("min_cell", F.col("min_cell")),
        row("round_to", F.col("round_to")),
        row("ancestry_suppressed", F.col("ancestry_suppressed")),
    )))


def governance(files: DataFrame, keys: list[str]) -> DataFrame:
    """Exports per run, and whether anything but the sanctioned aggregate would leave."""
    exported = F.coalesce("export_to_client", F.lit(False))
    return files.groupBy(*keys).agg(
        F.count_if(exported).alias("exports"),
        (F.count_if(exported) == 1).alias("single_export"),
        F.max(F.when(exported, F.col("file"))).alias("airlock_export_file"),
        F.coalesce(
            F.bool_or(exported & (F.col("classification") != "AIRLOCK-EXPORT-CANDIDATE")),
            F.lit(False),
        ).alias("participant_level_outputs_exported"),
    )

"""Candidate evidence, quality gates and carrier classification.

Grain: one row per (evaluation, participant). An *evaluation* is a distinct (cpra,
requested_source, carrier_definition) among the accepted requests, so a variant asked for by a
thousand requests is classified once and its counts are joined back to all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortgate.fixed_values import GATES, HET_DOSAGE_UPPER, INTERNAL_COLUMNS, MISSING_GT
from cohortgate.functions import coerce
from cohortgate.functions.numbers import decimal_text
from cohortgate.operators import sizing
from cohortgate.policy import AnalysisPolicy
from cohortgate.sources.durable import written

EVALUATION_KEY = ["cpra", "requested_source", "carrier_definition"]

EVALUATION_COLUMNS = [
    *EVALUATION_KEY, "chrom", "variant_on_array", "variant_on_imputed", "annotation_reliable",
    "use_array", "use_imputed", "imp_high", "variant_info",
]

EVIDENCE_COLUMNS = [
    "array_gt_code", "array_gq", "array_call_rate", "imputed_dosage", "imputed_max_gp",
]


def evaluations_of(resolved: DataFrame) -> DataFrame:
    """Distinct evaluations of the accepted requests."""
    accepted = resolved.filter(F.col("status") == "accepted")
    return accepted.select(*EVALUATION_COLUMNS).dropDuplicates(EVALUATION_KEY)


def subjects_of(participants: DataFrame, sample_qc: DataFrame) -> DataFrame:
    """Participants with their sample flags as booleans; unknown flags fail closed.

    Where both tables are bucketed by participant, they are merged bucket by bucket.
    """
    flags = sample_qc.select("participant_id", "sex_check_pass", "kinship_flag")
    joined = participants.select(
        "participant_id", "pseudo_id", "consent_status", "sex", "ancestry_stub"
    ).join(sizing.shuffled(flags), "participant_id", "left")
    return joined.withColumns({
        "consent_ok": coerce.holds(F.col("consent_status") == "consented"),
        "sex_check_ok": coerce.qc_bool(F.col("sex_check_pass"), default=False),
        "kinship_ok": ~coerce.qc_bool(F.col("kinship_flag"), default=True),
    }).drop("sex_check_pass", "kinship_flag")


def numbered(subjects: DataFrame) -> DataFrame:
    """Subjects with ``participant_no``, written once so that the numbers stay.

    Numbers count up by one within a written partition, which is what keeps bitmaps of them full.
    """
    return written(subjects.withColumn("participant_no", F.monotonically_increasing_id()), "subjects")


def pivot_calls(genotypes: DataFrame) -> DataFrame:
    """Long genotype rows to one row per (cpra, participant), array and imputed side by side.

    (participant, cpra, source) is unique, so ``max`` only picks the one value there is. The
    grouping key holds both columns: a popular variant spreads over participants and a widely
    genotyped participant spreads over variants.
    """

    def only(source: str, column: str) -> Column:
        return F.max(F.when(F.col("source") == source, coerce.number(F.col(column))))

    return genotypes.groupBy("cpra", "participant_id").agg(
        only("array", "gt_code").alias("array_gt_code"),
        only("array", "gq").alias("array_gq"),
        only("array", "call_rate").alias("array_call_rate"),
        only("imputed", "dosage").alias("imputed_dosage"),
        only("imputed", "max_gp").alias("imputed_max_gp"),
    )


FILTER_VALUES = 1_000


def requested_calls(
    genotypes: DataFrame, evaluations: DataFrame, cpras: list[str] | None
) -> DataFrame:
    """Genotype rows of the requested variants, cut at the scan.

    A short list of variants gives literal filters: on ``chrom`` where the table is partitioned by
    it, and on ``cpra``, which reach the Parquet scan. Otherwise it is a semi-join on both.
    """
    if cpras is not None and len(cpras) <= FILTER_VALUES:
        if "chrom" in genotypes.columns:
            genotypes = genotypes.filter(F.col("chrom").isin(sorted({c.split(":")[0] for c in cpras})))
        return genotypes.filter(F.col("cpra").isin(cpras))
    wanted, keys = evaluations.select("cpra").distinct(), ["cpra"]
    if "chrom" in genotypes.columns:  # lets the contigs prune partitions at run time
        wanted, keys = wanted.withColumn("chrom", F.split_part("cpra", F.lit(":"), F.lit(1))), ["chrom", "cpra"]
    return genotypes.join(sizing.shuffled(wanted) if cpras is None else F.broadcast(wanted), keys, "left_semi")


def candidate_evidence(
    genotypes: DataFrame, subjects: DataFrame, evaluations: DataFrame, cpras: list[str] | None = None
) -> DataFrame:
    """Participants with any call, per evaluation.

    The scan starts from the genotypes and is cut to the requested variants before the first
    shuffle; participants without a call never enter, which keeps the row count at the number of
    calls and not at requests times participants. :mod:`counts` adds them back to gate totals.
    ``cpras`` lists the variants of an evaluation table that passed a size check and may be
    broadcast; without it the joins shuffle.
    """
    calls = pivot_calls(requested_calls(genotypes, evaluations, cpras))
    return calls.join(subjects, "participant_id").join(
        sizing.shuffled(evaluations) if cpras is None else F.broadcast(evaluations), "cpra"
    )


def candidate_table(genotypes: DataFrame, subjects: DataFrame, cpra: str) -> DataFrame:
    """Every participant for one requested variant, with null evidence where there is no call."""
    calls = pivot_calls(genotypes.filter(F.col("cpra") == cpra)).drop("cpra")
    return subjects.join(calls, "participant_id", "left").withColumn("cpra", F.lit(cpra))


def with_gates(evidence: DataFrame, policy: AnalysisPolicy) -> DataFrame:
    """The 18 gate columns, each true or false and never null."""
    gt, dosage = F.col("array_gt_code"), F.col("imputed_dosage")
    het_only = F.col("carrier_definition") == "het_only"
    simple = evidence.withColumns({
        "on_array": F.col("variant_on_array"),
        "on_imputed": F.col("variant_on_imputed"),
        "array_source_allowed": F.col("use_array"),
        "imputed_source_allowed": F.col("use_imputed"),
        "has_array_gt": coerce.holds(gt != MISSING_GT),
        "call_rate_ok": coerce.holds(F.col("array_call_rate") >= policy.array_call_rate_min),
        "gq_ok": coerce.holds(F.col("array_gq") >= policy.array_gq_min),
        "has_imputed_dosage": dosage.isNotNull(),
        "dr2_ok": coerce.holds(F.col("variant_info") >= policy.imputed_dr2_min),
        "max_gp_ok": coerce.holds(F.col("imputed_max_gp") >= policy.imputed_max_gp_min),
        "dosage_ok": coerce.holds(dosage >= policy.imputed_dosage_carrier_threshold)
        & ~(het_only & coerce.holds(dosage >= HET_DOSAGE_UPPER)),
        "array_alt": coerce.holds((gt == 1) | ((gt == 2) & ~het_only)),
    })
    credible = simple.withColumns({
        "array_credible": F.col("on_array") & F.col("annotation_reliable")
        & F.col("array_source_allowed") & F.col("has_array_gt") & F.col("call_rate_ok")
        & F.col("gq_ok"),
        "imputed_credible": F.col("on_imputed") & F.col("annotation_reliable")
        & F.col("imputed_source_allowed") & F.col("dr2_ok") & F.col("has_imputed_dosage")
        & F.col("max_gp_ok"),
    })
    return credible.withColumn(
        "included_by_configured_gates",
        F.col("consent_ok")
        & ((F.col("array_credible") & F.col("array_alt"))
           | (F.col("imputed_credible") & F.col("dosage_ok"))),
    )


def sample_flags(sex_check_ok: Column, kinship_ok: Column) -> Column:
    return F.concat_ws(
        ";", F.when(~sex_check_ok, "sample_sex_check_fail"), F.when(~kinship_ok, "related_pair")
    )


def classify(gated: DataFrame, policy: AnalysisPolicy) -> DataFrame:
    """Carrier candidates with decision, confidence, tier, source, reason and flags.

    A candidate shows alternate evidence by any source, also one the request did not ask for.
    """
    array_evidence = F.col("array_alt") & F.col("array_credible")
    imputed_evidence = F.col("dosage_ok") & F.col("imputed_credible")
    included = F.col("included_by_configured_gates")
    low_call_rate = coerce.holds(F.col("array_call_rate") < policy.array_call_rate_min)
    low_gq = coerce.holds(F.col("array_gq") < policy.array_gq_min)
    low_gp = coerce.holds(F.col("imputed_max_gp") < policy.imputed_max_gp_min)
    array_refused = F.col("array_alt") & ~F.col("array_credible")
    source = F.concat_ws("+", F.when(array_evidence, "array"), F.when(imputed_evidence, "imputed"))
    return gated.filter(F.col("array_alt") | F.col("dosage_ok")).withColumns({
        "array_evidence": array_evidence,
        "imputed_evidence": imputed_evidence,
        "decision": F.when(included, "included").otherwise("excluded"),
        "confidence": F.when(~included, "NA")
        .when(array_evidence | (imputed_evidence & F.col("imp_high")), "high")
        .otherwise("conditional"),
        "evidence_priority": F.when(~included, "NA")
        .when(array_evidence, "array_direct")
        .when(F.col("imp_high"), "imputed_high")
        .otherwise("imputed_conditional"),
        "source": F.when(source == "", "none").otherwise(source),
        "reason": F.concat_ws(
            ";",
            F.when(coerce.holds(F.col("array_gt_code") == MISSING_GT), "array_genotype_missing"),
            F.when(array_refused & low_call_rate, f"array_call_rate<{policy.array_call_rate_min}")
            .when(array_refused & low_gq, f"array_GQ<{policy.array_gq_min}"),
            F.when(F.col("dosage_ok") & low_gp, f"imputed_max_gp<{policy.imputed_max_gp_min}"),
            F.when(~F.col("consent_ok"), "consent_withdrawn"),
        ),
        "flags": sample_flags(F.col("sex_check_ok"), F.col("kinship_ok")),
    })


def internal_table(classified: DataFrame) -> DataFrame:
    """The participant-level carrier table, fixed column order. Never leaves the estate."""
    return classified.select(*EVALUATION_KEY, *INTERNAL_COLUMNS)


def epi_handoff(classified: DataFrame) -> DataFrame:
    """Included carriers under their pseudonym, with the caveat text. No participant id."""
    moderate = F.when(
        F.col("confidence") == "conditional",
        F.concat(
            F.lit("imputed-supported, DR2="), decimal_text(F.col("variant_info")),
            F.lit(" (moderate)"),
        ),
    )
    return classified.filter(F.col("decision") == "included").select(
        *EVALUATION_KEY, "pseudo_id", F.lit("carrier").alias("carrier_status"), "source",
        "confidence", "evidence_priority",
        F.concat_ws("; ", moderate, F.when(F.col("flags") != "", F.col("flags"))).alias("caveat"),
    )


def genotype_values(evidence: DataFrame) -> DataFrame:
    """Numeric forms used by the hard-call counts: missing call -1, missing dosage 0."""
    return evidence.withColumns({
        "gt_value": F.coalesce("array_gt_code", F.lit(float(MISSING_GT))).cast("tinyint"),
        "dosage_value": F.coalesce("imputed_dosage", F.lit(0.0)),
    })


GATE_COLUMNS = GATES

"""The driver queries: one callable per operator group, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortgate.functions import digest, genotype
from cohortgate.operators import (
    catalogue,
    checks,
    counts,
    disclosure,
    evidence,
    finalize,
    frequency,
    identifiers,
    ledger,
    notes,
    preflight,
    release,
    requests,
    results,
    views,
)
from cohortgate.operators.evidence import EVALUATION_KEY
from cohortgate.plans import driver_views as dv
from cohortgate.plans import staged
from cohortgate.plans.feasibility import Evaluation
from cohortgate.policy import policy_violations
from cohortgate.sources import layout, variant_lists, vcf
from cohortgate.sources.durable import shared_path, written

POLICY, DEPLOYMENT, RELEASE_POLICY = dv.POLICY, dv.DEPLOYMENT, dv.RELEASE_POLICY
Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def evaluation(spark: SparkSession, sf_dir: str) -> Evaluation:
    return Evaluation(dv.inputs(spark, sf_dir), POLICY)


def joined(column: str, separator: str = "|") -> Column:
    return F.array_join(column, separator).alias(column)


# --- the evaluation --------------------------------------------------------------------------


@query
def client_totals(spark, sf_dir):
    return evaluation(spark, sf_dir).results().select(
        "request_id", "study_id", "cpra", "status", "reject_reason", "client_total",
        "breakdown_suppressed", "total_suppressed", "shown_high", "shown_conditional",
    )


@query
def result_rows(spark, sf_dir):
    return evaluation(spark, sf_dir).reports().select(
        "request_id", "total", "high_confidence", "conditional", "excluded", "flagged",
        "ancestry_suppressed",
        F.array_join(F.transform(
            "ancestry_breakdown",
            lambda s: F.concat(s["stratum"], F.lit(": ~"), s["n"].cast("string")),
        ), ", ").alias("ancestry_breakdown"),
        "sensitivity_suppressed", "recommendation", joined("assumptions"), joined("limitations"),
    )


@query
def candidate_table(spark, sf_dir):
    return evaluation(spark, sf_dir).candidates.select(
        *EVALUATION_KEY, "participant_id", "pseudo_id", "consent_status", "sex", "ancestry_stub",
        *evidence.EVIDENCE_COLUMNS, "sex_check_ok", "kinship_ok",
    )


def _colocated(spark, sf_dir) -> tuple[Evaluation, layout.CohortLayout]:
    inputs = dv.inputs(spark, sf_dir)
    stored = layout.store(spark, inputs.participants, inputs.sample_qc, inputs.genotypes)
    tables = {name: stored.table(spark, name) for name in layout.KEYS}
    return Evaluation(replace(inputs, **tables, colocated=True), POLICY), stored


@query
def candidate_table_colocated(spark, sf_dir):
    """The candidate table from stored tables whose rows lie together by participant."""
    run, _ = _colocated(spark, sf_dir)
    return run.candidates.select(
        *EVALUATION_KEY, "participant_id", "pseudo_id", "consent_status", "sex", "ancestry_stub",
        *evidence.EVIDENCE_COLUMNS, "sex_check_ok", "kinship_ok",
    )


@query
def cohort_faults(spark, sf_dir):
    """Key faults of a stored cohort in which every 41st participant is missing and some rows repeat."""
    inputs = dv.inputs(spark, sf_dir)
    number = F.substring("participant_id", 2, 9).cast("long")
    twice = inputs.genotypes.filter(number % 53 == 5).filter("source = 'array'")
    stored = layout.store(
        spark, inputs.participants.filter(number % 41 != 3),
        inputs.sample_qc.unionByName(inputs.sample_qc.filter(number % 47 == 4)), inputs.genotypes.unionByName(twice),
    )
    return stored.faults(spark).groupBy("fault", "participant_id").agg(F.sum("rows").alias("rows"))


@query
def gate_accounting(spark, sf_dir):
    return evaluation(spark, sf_dir).gated.select(
        *EVALUATION_KEY, "participant_id", *evidence.GATE_COLUMNS
    )


@query
def gate_pass_counts(spark, sf_dir):
    run = evaluation(spark, sf_dir)
    return counts.gate_pass_counts(run.gated, run.evaluations, run.subjects, POLICY)


@query
def classified_carriers(spark, sf_dir):
    return evidence.internal_table(evaluation(spark, sf_dir).classified)


@query
def epi_handoff(spark, sf_dir):
    return evidence.epi_handoff(evaluation(spark, sf_dir).classified)


@query
def evaluation_cells(spark, sf_dir):
    return counts.count_cells(evaluation(spark, sf_dir).classified)


@query
def threshold_projection(spark, sf_dir):
    return counts.project_cells(evaluation(spark, sf_dir).classified, POLICY, dv.SCENARIOS)


@query
def staged_projection(spark, sf_dir):
    """The projection over classified evidence that was stored as text by one run and opened by another."""
    run = evaluation(spark, sf_dir)
    inputs = {name: getattr(run.inputs, name) for name in ("participants", "genotypes", "sample_qc", "manifest", "requests")}
    digest_ = staged.input_digest(POLICY, **inputs)
    store = staged.StageStore(spark, shared_path(spark, "stages"), text=True)
    store.reused("classified", digest_, lambda: run.classified)
    stored = staged.StageStore(spark, store.path, text=True).open("classified", digest_, run.classified.schema)
    types = {f.name: f.dataType.simpleString() for f in run.classified.schema}
    plain = [name for name in types if name not in counts.STAGED_FLAGS]
    typed = stored.withColumns({name: F.col(f"`{name}`").cast(types[name]) for name in plain})
    # Empty text is null in a text file; flags are compared as text.
    return counts.project_cells(counts.staged_evidence(typed.fillna("", ["flags"])), POLICY, dv.SCENARIOS)


@query
def quality_sensitivity(spark, sf_dir):
    projected = counts.project_cells(
        evaluation(spark, sf_dir).classified, POLICY, disclosure.sensitivity_scenarios(POLICY)
    )
    return disclosure.control_sensitivity(projected, EVALUATION_KEY, POLICY)


@query
def ancestry_strata(spark, sf_dir):
    return counts.count_by_ancestry(evaluation(spark, sf_dir).classified)


@query
def ancestry_sdc(spark, sf_dir):
    classified = evaluation(spark, sf_dir).classified
    strata = counts.count_by_ancestry(classified)
    return disclosure.control_strata(strata, counts.count_cells(classified), EVALUATION_KEY, POLICY)


@query
def ancestry_verdicts(spark, sf_dir):
    classified = evaluation(spark, sf_dir).classified
    return disclosure.strata_verdict(
        counts.count_by_ancestry(classified), counts.count_cells(classified), EVALUATION_KEY, POLICY
    )


@query
def hardcall_counts(spark, sf_dir):
    values = evidence.genotype_values(evaluation(spark, sf_dir).gated)
    return counts.hardcall_counts(values, F.col("array_credible") & F.col("consent_ok"))


@query
def reconciliation(spark, sf_dir):
    return counts.reconciliation(evaluation(spark, sf_dir).gated)


@query
def batch_headers(spark, sf_dir):
    return requests.batch_headers(dv.requests(spark, sf_dir))


@query
def batch_union(spark, sf_dir):
    return evaluation(spark, sf_dir).batches()


@query
def batch_variant_counts(spark, sf_dir):
    run = evaluation(spark, sf_dir)
    return counts.batch_variant_counts(run.carrier_words, run.members)


# --- heterozygous carriers only ----------------------------------------------------------------


def _het_only(spark, sf_dir) -> Evaluation:
    return Evaluation(dv.inputs(spark, sf_dir), dv.HET_POLICY)


@query
def het_only_totals(spark, sf_dir):
    return _het_only(spark, sf_dir).results().select(
        "request_id", "status", "reject_reason", "client_total", "total", "high_confidence", "conditional", "excluded"
    )


@query
def het_only_carriers(spark, sf_dir):
    return evidence.internal_table(_het_only(spark, sf_dir).classified)


@query
def het_only_hardcalls(spark, sf_dir):
    """Kernel counts of heterozygous carriers, held against the classified rows in the strict form."""
    gated = _het_only(spark, sf_dir).gated
    counted = counts.hardcall_counts(evidence.genotype_values(gated), F.col("array_credible") & F.col("consent_ok"))
    return counted.join(counts.assert_reconciled(counts.reconciliation(gated)), EVALUATION_KEY)


# --- frequency control -----------------------------------------------------------------------


def _frequency_cells(run: Evaluation) -> DataFrame:
    return frequency.frequency_cells(run.gated, POLICY)


@query
def allele_frequency(spark, sf_dir):
    run = evaluation(spark, sf_dir)
    return frequency.frequency_strata(_frequency_cells(run), run.evaluations, run.subjects, POLICY)


@query
def frequency_control(spark, sf_dir):
    run = evaluation(spark, sf_dir)
    return frequency.frequency_control(_frequency_cells(run), run.evaluations, POLICY)


@query
def cohort_totals(spark, sf_dir):
    return counts.participant_totals(evaluation(spark, sf_dir).subjects)


@query
def array_allele_frequency(spark, sf_dir):
    array = dv.genotypes(spark, sf_dir).filter("source = 'array'")
    return frequency.array_allele_frequency(array)


@query
def bootstrap_interval(spark, sf_dir):
    return frequency.bootstrap_interval(_frequency_cells(evaluation(spark, sf_dir)), POLICY)


# --- request front end (wide tables) ---------------------------------------------------------


@query
def request_violations(spark, sf_dir):
    checked = requests.with_violations(dv.wide_requests(spark, sf_dir), POLICY)
    return checked.select("request_id", "cpra", joined("violations", ","))


def _wide_matched(spark, sf_dir) -> DataFrame:
    return requests.match_manifest(dv.wide_requests(spark, sf_dir), dv.wide_manifest(spark, sf_dir))


@query
def manifest_checks(spark, sf_dir):
    return _wide_matched(spark, sf_dir).select("request_id", "cpra", "manifest_reject", "observed_maf")


@query
def source_availability(spark, sf_dir):
    return requests.with_availability(_wide_matched(spark, sf_dir)).select(
        "request_id", "cpra", "requested_array", "requested_imputed", "array_available",
        "imputed_available", "array_requested_available", "imputed_requested_available",
        "requested_sources_available", joined("source_caveats"),
    )


@query
def source_decision(spark, sf_dir):
    return requests.with_source_decision(
        requests.with_availability(_wide_matched(spark, sf_dir)), POLICY
    ).select("request_id", "cpra", "variant_info", "use_array", "use_imputed", "imp_high")


@query
def identifiability_overlay(spark, sf_dir):
    wide = dv.wide_manifest(spark, sf_dir)
    listed = wide.selectExpr(
        dv.elsewhere("k % 4 = 3", "cpra"), "CASE WHEN k % 2 = 0 THEN 'yes' ELSE ' n' END AS on_array",
        "CASE WHEN k % 8 = 0 THEN '1' ELSE 'False' END AS on_imputed",
        "CASE WHEN k % 16 = 1 THEN 'F' ELSE 't' END AS annotation_reliable",
    )
    return requests.overlay_identifiability(wide, listed).select(
        "cpra", "on_array", "on_imputed", "inaccurate_annotation", "dosage_r2"
    )


#: Lines of the array list and of the imputed list, made from the sites (``k, cpra``); entries with a place of
#: their own behind all others list some sites a second time, with another flag.
LIST_ENTRIES = {
    "array": [
        ("k", "k % 5 <> 0", "CASE WHEN k % 41 = 0 THEN 'Yes' ELSE 'No' END"),
        ("1000000000 + k", "k % 10 = 1", "CASE WHEN k % 20 = 1 THEN ' yes' ELSE 'no' END"),
    ],
    "imputed": [
        ("k", "k % 3 <> 0", "CASE WHEN k % 37 = 0 THEN 'true' ELSE 'FALSE' END"),
        ("1000000000 + k", "k % 7 = 2", "'TRUE'"),
    ],
}
LIST_HEADERS = {"array": "variant_id,gene,Inaccurate Call", "imputed": "inaccurate.annotation,cpra_grch38"}
LIST_LINES = {"array": "concat(cpra, ',G', CAST(k AS VARCHAR(20)), ',', flag)", "imputed": "concat(flag, ',', cpra)"}


def _list_text(spark, sf_dir, name: str) -> DataFrame:
    """``place, value``: the lines of a list in their order, header first; a few lines are cut short."""
    wide = dv.wide_manifest(spark, sf_dir)
    entries = [wide.filter(held).selectExpr(f"{place} AS place", "k", "cpra", f"{flag} AS flag") for place, held, flag in LIST_ENTRIES[name]]
    lines = entries[0].unionByName(entries[1]).selectExpr("place", f"CASE WHEN k % 97 = 3 THEN 'cut' ELSE {LIST_LINES[name]} END AS value")
    header = spark.createDataFrame([(-1, LIST_HEADERS[name])], "place long, value string")
    return header.unionByName(lines)


def _written_list(spark, sf_dir, name: str) -> str:
    """A list as several text files that follow each other."""
    path = shared_path(spark, f"{name}-list")
    lines = _list_text(spark, sf_dir, name)
    lines.repartitionByRange("place").sortWithinPartitions("place").select("value").write.text(path)
    return path


def _zipped_list(spark, sf_dir, name: str) -> DataFrame:
    """``path, content``: a list as the one member of an archive, packed where its lines are sorted."""

    def pack(rows):
        import io
        import zipfile

        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive, archive.open(f"{name}.csv", "w") as member:
            for batch in rows:
                member.writelines(f"{value}\r\n".encode() for value in batch.column("value").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([f"{name}.zip"]), pa.array([packed.getvalue()])], names=["path", "content"])

    lines = _list_text(spark, sf_dir, name).coalesce(1).sortWithinPartitions("place").select("value")
    return written(lines.mapInArrow(pack, "path string, content binary"), f"{name}-zip")


def _list_entries(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    array = variant_lists.read_list(spark, _written_list(spark, sf_dir, "array"), "variant_id", "Inaccurate Call")
    zipped = variant_lists.archive_lines(_zipped_list(spark, sf_dir, "imputed"), first_member=True)
    return array, variant_lists.list_entries(zipped, "cpra_grch38", "inaccurate.annotation")


@query
def variant_list_membership(spark, sf_dir):
    """Requested variants, some of them in no list, so both lists are read to their ends."""
    targets = dv.wide_requests(spark, sf_dir).select("cpra").distinct()
    array, imputed = _list_entries(spark, sf_dir)
    return variant_lists.membership(
        targets, variant_lists.list_hits(array, targets, "Yes"),
        variant_lists.list_hits(imputed, targets, "TRUE"), "test release",
    )


@query
def variant_list_stop(spark, sf_dir):
    """All variants of the array list, met before it repeats some: reading stops there."""
    array, _ = _list_entries(spark, sf_dir)
    hits = variant_lists.list_hits(array, array.select("cpra"), "Yes")
    return hits.select("cpra", "flag", "line", "reliable")


def _list_lines(spark, sf_dir) -> DataFrame:
    plain = variant_lists.list_lines(spark, _written_list(spark, sf_dir, "array")).withColumns({"file": F.lit("array"), "member": F.lit("array")})
    return plain.unionByName(variant_lists.archive_lines(_zipped_list(spark, sf_dir, "imputed")))


@query
def position_search(spark, sf_dir):
    return variant_lists.position_search(_list_lines(spark, sf_dir), "1048290", "2:1048290:CG:C")


@query
def position_sample(spark, sf_dir):
    return variant_lists.position_sample(_list_lines(spark, sf_dir), "829")


@query
def allele_trim(spark, sf_dir):
    return preflight.trim_alleles(dv.wide_requests(spark, sf_dir)).select(
        "request_id", "cpra", F.col("n_pos").alias("pos"), F.col("n_ref").alias("ref"),
        F.col("n_alt").alias("alt"),
    )


@query
def build_and_strand(spark, sf_dir):
    wide = dv.wide_manifest(spark, sf_dir)
    matched = requests.match_manifest(dv.wide_requests(spark, sf_dir), wide)
    return preflight.with_preflight(matched, dv.bases(spark, sf_dir), dv.panel_maf(spark, sf_dir)).select(
        "request_id", "cpra", "normalized_cpra", "build_resolved", "ref_matched", "is_palindromic",
        "strand", "ambiguous", "preflight_reject",
        F.array_join(preflight.caveats(), "|").alias("caveats"),
    )


@query
def policy_rules(spark, sf_dir):
    policies = dv.table(spark, sf_dir, "part").selectExpr(
        "p_partkey", *[f"{sql} AS {name}" for name, sql in POLICY_ROWS.items()]
    )
    return policy_violations(policies).select("p_partkey", joined("policy_violations", ","))


POLICY_ROWS = {
    "require_consent": "p_partkey % 31 <> 0",
    "array_call_rate_min": "CASE WHEN p_partkey % 17 = 0 THEN 1.5e0 ELSE 0.98e0 END",
    "imputed_dr2_min": "CASE WHEN p_partkey % 19 = 0 THEN 0.9e0 ELSE 0.3e0 END",
    "imputed_dr2_high_confidence": "0.8e0",
    "imputed_max_gp_min": "CASE WHEN p_partkey % 23 = 0 THEN -0.1e0 ELSE 0.9e0 END",
    "imputed_dosage_carrier_threshold": "CASE WHEN p_partkey % 29 = 0 THEN 2.5e0 ELSE 0.5e0 END",
    "array_gq_min": "CASE WHEN p_partkey % 37 = 0 THEN -1 ELSE 20 END",
    "sdc_min_cell": "CAST(p_partkey % 8 + 4 AS INT)",
    "sdc_round_to": "CAST(p_partkey % 6 AS INT)",
    "carrier_definition": "CASE WHEN p_partkey % 41 = 0 THEN 'any' ELSE 'het_only' END",
}


@query
def request_tokens(spark, sf_dir):
    return dv.table(spark, sf_dir, "customer").select(
        "c_custkey",
        requests.id_token(F.concat(F.lit(" "), F.col("c_name"), F.lit("# "))).alias("token"),
        requests.default_study_id("gene", F.col("c_mktsegment"), "DEMO").alias("study_id"),
        requests.panel_label(F.replace(F.col("c_name"), F.lit("#"), F.lit("_"))).alias("label"),
    )


# --- integrity and catalogue -----------------------------------------------------------------


@query
def duplicate_keys(spark, sf_dir):
    return checks.duplicate_keys(dv.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def unmatched_left(spark, sf_dir):
    return checks.unmatched_left(
        dv.table(spark, sf_dir, "documents").select("doc_id", "lang", "source"),
        dv.table(spark, sf_dir, "labels"), ["doc_id"],
    )


def _variants(spark, sf_dir) -> DataFrame:
    return dv.wide_manifest(spark, sf_dir).withColumnRenamed("k", "variant_id").select(
        "variant_id", "cpra", "chrom", "pos", "ref", "alt"
    )


@query
def gene_span_check(spark, sf_dir):
    return catalogue.outside_gene_span(
        _variants(spark, sf_dir), dv.genes(spark, sf_dir), dv.gene_variants(spark, sf_dir)
    ).select("symbol", "variant_id", "chrom", "pos", "g_chrom")


@query
def gene_span_members(spark, sf_dir):
    spans = dv.genes(spark, sf_dir)
    return catalogue.containing_spans(_variants(spark, sf_dir), spans).select("cpra", "symbol")


@query
def unknown_references(spark, sf_dir):
    suppliers_of_customers = dv.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("G"), F.col("c_custkey").cast("string")).alias("symbol"), "c_custkey"
    )
    return catalogue.unknown_references(suppliers_of_customers, dv.genes(spark, sf_dir), "symbol").select(
        "symbol", "c_custkey"
    )


@query
def gene_variant_requests(spark, sf_dir):
    asked = dv.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("STUDY-"), F.col("s_suppkey").cast("string")).alias("study_id"),
        F.concat(F.lit(" g"), F.col("s_suppkey").cast("string"), F.lit(" ")).alias("symbol"),
    )
    return catalogue.resolve_genes(
        asked, dv.gene_variants(spark, sf_dir), _variants(spark, sf_dir)
    ).select("study_id", "symbol", "ordinal", "cpra", "build", "carrier_definition")


@query
def panel_variants(spark, sf_dir):
    asked = dv.table(spark, sf_dir, "nation").select(
        F.concat(F.lit("STUDY-"), F.col("n_nationkey").cast("string")).alias("study_id"),
        F.concat(F.col("n_name"), F.lit(" ")).alias("panel"),
    )
    return catalogue.resolve_panels(
        asked, dv.panel_genes(spark, sf_dir), dv.gene_variants(spark, sf_dir), _variants(spark, sf_dir)
    ).select("study_id", "panel", "gene_ordinal", "variant_ordinal", "cpra")


@query
def region_lookup(spark, sf_dir):
    loci = dv.wide_requests(spark, sf_dir).select("request_id", "cpra", "chrom", "pos")
    return catalogue.region_of(loci, dv.regions(spark, sf_dir)).select("request_id", "cpra", "region")


@query
def region_spans(spark, sf_dir):
    return catalogue.region_spans(dv.wide_manifest(spark, sf_dir), "b0001")


@query
def locus_sorted(spark, sf_dir):
    wide = dv.wide_manifest(spark, sf_dir)
    return vcf.locus_order(wide).select(
        "cpra", genotype.chrom_rank(F.col("chrom")).alias("chrom_rank"), "pos"
    )


# --- results for readers ---------------------------------------------------------------------


@query
def recruitment_funnel(spark, sf_dir):
    return disclosure.recruitment_funnel(
        evaluation(spark, sf_dir).accepted_results(), ["request_id"], POLICY
    )


@query
def portfolio(spark, sf_dir):
    return results.portfolio(evaluation(spark, sf_dir).accepted_reports(), POLICY)


def _cells_text(cells: Column) -> Column:
    return F.array_join(
        F.transform(cells, lambda c: F.concat_ws("=", c["label"], c["count"].cast("string"))), ","
    )


@query
def factsheet(spark, sf_dir):
    sheet = results.factsheet(evaluation(spark, sf_dir).accepted_reports(), POLICY)
    return sheet.withColumns({
        "reported_cells": _cells_text(F.col("reported_cells")),
        "assumptions": F.size("assumptions").cast("long"),
        "limitations": F.array_join("limitations", "|"),
    })


@query
def funnel_view(spark, sf_dir):
    return views.funnel(evaluation(spark, sf_dir).accepted_results())


@query
def source_decision_view(spark, sf_dir):
    return views.source_decisions(evaluation(spark, sf_dir).accepted_results())


@query
def decision_breakdown(spark, sf_dir):
    return views.decision_reasons(evaluation(spark, sf_dir).classified)


@query
def decision_tiers(spark, sf_dir):
    return views.decision_tiers(evaluation(spark, sf_dir).classified)


@query
def disclosure_view(spark, sf_dir):
    accepted = evaluation(spark, sf_dir).accepted_results()
    verdicts = accepted.select(F.col("request_id").alias("candidate_id"), "ancestry_suppressed")
    return views.disclosure_fields(release.request_candidates(accepted, POLICY), verdicts)


@query
def feasibility_notes(spark, sf_dir):
    return notes.request_notes(evaluation(spark, sf_dir).accepted_reports(), POLICY, DEPLOYMENT)


@query
def markdown_reports(spark, sf_dir):
    accepted = evaluation(spark, sf_dir).accepted_reports()
    return accepted.select("request_id", notes.markdown_report(POLICY).alias("note"))


@query
def batch_notes(spark, sf_dir):
    accepted = evaluation(spark, sf_dir).batches().filter("status = 'accepted'")
    return notes.batch_notes(accepted, POLICY, DEPLOYMENT)


# --- release ---------------------------------------------------------------------------------


@query
def release_predicate(spark, sf_dir):
    return release.with_release_reasons(dv.candidates(spark, sf_dir)).select(
        "candidate_id", joined("release_reasons", "; ")
    )


def _judged(spark, sf_dir) -> DataFrame:
    return release.with_verdict(dv.candidates(spark, sf_dir), RELEASE_POLICY, DEPLOYMENT)


@query
def release_language(spark, sf_dir):
    return _judged(spark, sf_dir).select("candidate_id", joined("malformed", ","))


@query
def release_verdict(spark, sf_dir):
    return _judged(spark, sf_dir).select("candidate_id", "verdict")


@query
def release_payload(spark, sf_dir):
    return _judged(spark, sf_dir).select("candidate_id", "request_text", "payload")


@query
def release_receipt(spark, sf_dir):
    return release.receipts(_judged(spark, sf_dir), RELEASE_POLICY, DEPLOYMENT)


@query
def retained_requests(spark, sf_dir):
    return release.retained_requests(_judged(spark, sf_dir))


@query
def request_release(spark, sf_dir):
    candidates = release.request_candidates(evaluation(spark, sf_dir).accepted_results(), POLICY)
    return release.with_verdict(candidates, RELEASE_POLICY, DEPLOYMENT).select(
        "candidate_id", "verdict", "payload"
    )


@query
def batch_release(spark, sf_dir):
    accepted = evaluation(spark, sf_dir).batches().filter("status = 'accepted'")
    return release.with_verdict(
        release.batch_candidates(accepted, POLICY), RELEASE_POLICY, DEPLOYMENT
    ).select("candidate_id", "verdict", "payload")


@query
def release_check(spark, sf_dir):
    """Generations of which fixed shares are tampered with in one of the four tables."""
    judged = written(_judged(spark, sf_dir), "judged")  # four tables come from one judgement
    key = F.split("candidate_id", "-")[1].cast("long")
    receipts = release.receipts(judged, RELEASE_POLICY, DEPLOYMENT)
    payloads = judged.filter("verdict = 'released'").filter(key % 11 != 0).select(
        "candidate_id",
        F.when(key % 13 == 0, F.replace("payload", F.lit("~"), F.lit("~1"))).otherwise(F.col("payload"))
        .alias("payload"),
    )
    kept = receipts.filter(key % 7 != 0)
    recorded = receipts.filter(key % 19 != 0).withColumn(
        "policy_version", F.when(key % 23 == 0, "0").otherwise(F.col("policy_version"))
    )
    retained = release.retained_requests(judged.filter(key % 29 != 0))
    return release.verify_generations(
        payloads, kept, recorded, retained, RELEASE_POLICY
    ).withColumn("failures", F.array_join("failures", ","))


@query
def current_generation(spark, sf_dir):
    attempts = _judged(spark, sf_dir).select(
        F.col("study_id").alias("subject"), F.split("candidate_id", "-")[1].cast("long").alias("attempt"),
        "verdict",
    )
    return release.generations(attempts)


@query
def export_manifest(spark, sf_dir):
    return release.manifest_rules(_files(spark, sf_dir), ["l_orderkey"])


def _files(spark, sf_dir) -> DataFrame:
    return dv.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", *[f"{sql} AS {name}" for name, sql in FILE_ROWS.items()]
    )


FILE_ROWS = {
    "file": "CASE WHEN l_partkey % 211 = 0 THEN '../up.txt' WHEN l_partkey % 223 = 0 THEN ' ' "
    "ELSE concat('file', CAST(l_linenumber AS VARCHAR(20)), '.json') END",
    "classification": "CASE WHEN l_linenumber = 1 AND l_partkey % 5 <> 0 THEN 'AIRLOCK-EXPORT-CANDIDATE' "
    "ELSE 'INTERNAL-TRE-ONLY' END",
    "export_to_client": "l_linenumber = 1",
    "human_readable": "l_partkey % 9 <> 0",
    "reason": "CASE WHEN l_partkey % 227 = 0 THEN '' ELSE 'listed' END",
}


@query
def governance_view(spark, sf_dir):
    return views.governance(_files(spark, sf_dir), ["l_orderkey"])


@query
def batch_export_files(spark, sf_dir):
    runs = evaluation(spark, sf_dir).batches().select("batch_id", F.lit("batch").alias("kind"))
    return release.manifest_rules(release.export_files(runs), ["batch_id"])


# --- final figures ---------------------------------------------------------------------------


def _returned(spark, sf_dir) -> DataFrame:
    accepted = evaluation(spark, sf_dir).accepted_results().withColumn(
        "run_id", digest.run_id(F.col("study_id"), F.col("cpra"))
    )
    matched = finalize.match_returns(accepted, dv.returns(spark, sf_dir))
    return finalize.with_return_violations(matched, DEPLOYMENT)


@query
def run_ids(spark, sf_dir):
    return dv.requests(spark, sf_dir).select(
        "request_id", digest.run_id(F.col("study_id"), F.col("cpra")).alias("run_id"),
        digest.run_id(
            F.col("study_id"), F.col("cpra"), F.lit("c0ffee"),
            F.create_map(F.lit("b"), F.lit("22"), F.lit("a"), F.col("batch_id")),
        ).alias("bound_run_id"),
    )


@query
def return_checks(spark, sf_dir):
    return _returned(spark, sf_dir).select("request_id", joined("return_violations", ","))


def _finals(spark, sf_dir) -> DataFrame:
    valid = _returned(spark, sf_dir).filter(F.size("return_violations") == 0)
    passed = finalize.review_passed(valid, dv.checkpoints(spark, sf_dir), ["study_id"])
    return finalize.final_results(passed, POLICY)


@query
def final_result(spark, sf_dir):
    return _finals(spark, sf_dir).select(
        "request_id", "genotype_total_included", "post_phenotype_eligible", "client_genotype_ceiling",
        "client_eligible", "eligible_suppressed", "final_recommendation", joined("final_caveats"),
    )


@query
def blocked_finals(spark, sf_dir):
    blocking = finalize.blocking_checkpoints(dv.checkpoints(spark, sf_dir))
    return dv.requests(spark, sf_dir).join(blocking, "study_id").select(
        "request_id", "checkpoint", "decision"
    )


@query
def final_release(spark, sf_dir):
    return release.with_verdict(
        release.final_candidates(_finals(spark, sf_dir), POLICY), RELEASE_POLICY, DEPLOYMENT
    ).select("candidate_id", "verdict", "payload")


@query
def final_notes(spark, sf_dir):
    return _finals(spark, sf_dir).select("request_id", notes.final_note(POLICY, DEPLOYMENT).alias("note"))


# --- audit -----------------------------------------------------------------------------------


@query
def identifier_scan_documents(spark, sf_dir):
    hits = identifiers.identifier_hits(F.col("text"), DEPLOYMENT)
    email = F.coalesce(F.regexp_count("text", F.lit(EMAIL)), F.lit(0)).cast("long").alias("email")
    scanned = dv.table(spark, sf_dir, "documents").select(
        "doc_id", *[hit.alias(name) for name, hit in hits.items()], email
    )
    return scanned.filter("pseudo_id + participant_id + health_number + email > 0")


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query
def identifier_scan_conversations(spark, sf_dir):
    texts = dv.table(spark, sf_dir, "conversations").select(
        "role", identifiers.has_identifier_text(F.col("text"), DEPLOYMENT).alias("hit"),
        F.col("text").rlike(EMAIL).alias("email"),
    )
    return texts.groupBy("role").agg(
        F.count(F.lit(1)).alias("turns"), F.count_if("hit").alias("with_identifier"),
        F.count_if("email").alias("with_email"),
    )


def _event_json() -> Column:
    """An event with its properties; fixed shares carry a forbidden key or an identifier value."""
    return F.concat(
        F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(',"props":'), F.col("props"),
        F.when(F.col("event_id") % 97 == 0, F.lit(',"nested":[{"Participant_ID_hash":1}]'))
        .when(F.col("event_id") % 89 == 0, F.lit(',"note":"seen PSU-00AB12 today"'))
        .when(F.col("event_id") % 83 == 0, F.lit(',"input_sha256":{"a":{"b":["PSU-00AB12"]},"c":"P000000001"}'))
        .when(F.col("event_id") % 79 == 0, F.lit(r',"note":"seen\nPSU-00AB12"'))
        .when(F.col("event_id") % 73 == 0, F.lit(r',"note":"id\tP000000001"'))
        .when(F.col("event_id") % 71 == 0, F.lit(r',"note":"\u0050SU-00AB12"'))
        .when(F.col("event_id") % 67 == 0, F.lit(r',"git_commit":[{"participant\u005fid":1}]'))
        .otherwise(F.lit(',"text":"a \\"pseudo_id\\": quoted"')),
        F.lit("}"),
    )


@query
def identifier_scan_events(spark, sf_dir):
    scanned = dv.table(spark, sf_dir, "events").select(
        "event_id", "event_type",
        identifiers.has_forbidden_content(_event_json(), DEPLOYMENT).alias("forbidden"),
    )
    return scanned.filter("forbidden").select("event_id", "event_type")


def _ledger_events(spark, sf_dir) -> DataFrame:
    return dv.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("event_id").alias("id"), "event_type", "user_id", "props"
    )


def _leaves(spark, sf_dir) -> DataFrame:
    events = _ledger_events(spark, sf_dir)
    return ledger.event_leaves(events, ledger.event_json(events))


@query
def event_leaves(spark, sf_dir):
    return _leaves(spark, sf_dir)


def _ledger_size(spark, sf_dir) -> int:
    return dv.table(spark, sf_dir, "events").count()


@query
def event_root(spark, sf_dir):
    return ledger.hash_root(_leaves(spark, sf_dir), _ledger_size(spark, sf_dir))


@query
def event_parent_roots(spark, sf_dir):
    return ledger.parent_roots(_leaves(spark, sf_dir), _ledger_size(spark, sf_dir))


@query
def ledger_sequence(spark, sf_dir):
    return ledger.sequence_faults(_ledger_events(spark, sf_dir))


@query
def ledger_checks(spark, sf_dir):
    events = _ledger_events(spark, sf_dir)
    changed = events.filter("seq % 1009 <> 5").withColumn(
        "event_type", F.when(F.col("seq") % 1013 == 7, "edited").otherwise(F.col("event_type"))
    )
    return ledger.lost_or_changed(
        _leaves(spark, sf_dir), ledger.event_leaves(changed, ledger.event_json(changed))
    )


# --- VCF text --------------------------------------------------------------------------------


def _sites(spark, sf_dir) -> DataFrame:
    return dv.manifest(spark, sf_dir).selectExpr("cpra", "chrom", "CAST(pos AS BIGINT) AS pos", "ref", "alt")


def _as_lines(export: tuple[DataFrame, DataFrame]) -> DataFrame:
    header, data = export
    return header.select(F.col("block").cast("string").alias("file"), "value").unionByName(
        data.select(F.col("block").cast("string").alias("file"), "value")
    )


def _array_lines(spark, sf_dir) -> DataFrame:
    return written(_as_lines(vcf.array_export(dv.chip_genotypes(spark, sf_dir), _sites(spark, sf_dir))), "array-lines")


def _imputed_lines(spark, sf_dir) -> DataFrame:
    return written(_as_lines(vcf.imputed_export(dv.chip_genotypes(spark, sf_dir), _sites(spark, sf_dir))), "imputed-lines")


@query
def vcf_array_export(spark, sf_dir):
    _, data = vcf.array_export(dv.chip_genotypes(spark, sf_dir), _sites(spark, sf_dir))
    return data.select("cpra", F.sha2("value", 256).alias("line_sha256"))


@query
def vcf_imputed_export(spark, sf_dir):
    _, data = vcf.imputed_export(dv.chip_genotypes(spark, sf_dir), _sites(spark, sf_dir))
    return data.select("cpra", F.sha2("value", 256).alias("line_sha256"))


@query
def vcf_array_scan(spark, sf_dir):
    return vcf.parse_array(_array_lines(spark, sf_dir), None, allow_full_scan=True)


@query
def vcf_imputed_scan(spark, sf_dir):
    return vcf.parse_imputed(_imputed_lines(spark, sf_dir), None, allow_full_scan=True)


@query
def vcf_genotypes(spark, sf_dir):
    return vcf.combined_genotypes(
        _array_lines(spark, sf_dir), _imputed_lines(spark, sf_dir), dv.sample_qc(spark, sf_dir),
        dv.requests(spark, sf_dir).select("cpra"),
    )


@query
def vcf_summary_export(spark, sf_dir):
    return vcf.summary_export(dv.wide_manifest(spark, sf_dir)).select("cpra", "value")


def _summary(spark, sf_dir) -> DataFrame:
    lines = vcf.summary_export(dv.wide_manifest(spark, sf_dir)).select(
        F.lit("summary").alias("file"), "value"
    )
    return vcf.parse_summary(lines, None, allow_full_scan=True)


@query
def vcf_summary_scan(spark, sf_dir):
    return _summary(spark, sf_dir)


@query
def vcf_manifest(spark, sf_dir):
    """Summary statistics of the parts merged with array presence; every eighth part is met by no
    call."""
    array_calls = dv.table(spark, sf_dir, "lineitem").selectExpr(
        "CASE WHEN l_partkey % 8 = 1 THEN -l_partkey ELSE l_partkey END AS l_partkey", "CAST((l_orderkey + l_linenumber) % 4 - 1 AS DOUBLE) AS gt_code"
    ).join(dv.wide_manifest(spark, sf_dir).select("k", "cpra"), F.col("l_partkey") == F.col("k"))
    array = vcf.array_manifest(array_calls)
    return vcf.combined_manifest(_summary(spark, sf_dir), array)


@query
def sample_qc_export(spark, sf_dir):
    return vcf.sample_qc_export(dv.sample_qc(spark, sf_dir), dv.participants(spark, sf_dir))


@query
def sample_list_export(spark, sf_dir):
    return vcf.sample_list_export(
        dv.genotypes(spark, sf_dir), dv.participants(spark, sf_dir), "array"
    )


@query
def kinship_pairs(spark, sf_dir):
    return vcf.kinship_pairs(dv.sample_qc(spark, sf_dir))

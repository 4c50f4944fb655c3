"""Release candidates, the release predicate and language, payloads, receipts and generations.

Only rows for which every rule holds carry a payload; for the rest the payload is null, so a
refused candidate has nothing that could be written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortgate.fixed_values import (
    APPROVED_CELL_LABELS,
    CONTIG_LENGTHS,
    EXPORT_CLASS,
    EXPORTED_FILE,
    INTERNAL_CLASS,
    MAX_ALLELE_LENGTH,
    MAX_CELLS,
    MAX_COUNT,
    MAX_SUBJECT_VARIANTS,
    MIN_ALLOWED_CELL,
    RELEASE_FIELDS,
    RUN_FILES,
)
from cohortgate.functions.coerce import holds
from cohortgate.operators.checks import unexpected_fields
from cohortgate.operators.disclosure import reported_cells
from cohortgate.policy import AnalysisPolicy, Deployment, ReleasePolicy

EMPTY_CELLS = "array<struct<label:string,count:bigint>>"


# --- candidates ------------------------------------------------------------------------------


def request_candidates(results: DataFrame, policy: AnalysisPolicy) -> DataFrame:
    return results.select(
        F.col("request_id").alias("candidate_id"), "study_id", "cpra", "client_total",
        "breakdown_suppressed",
        reported_cells(
            F.col("breakdown_suppressed"), F.col("shown_high"), F.col("shown_conditional")
        ).alias("reported_cells"),
        F.lit(policy.sdc_min_cell).cast("long").alias("min_cell"),
        F.lit(policy.sdc_round_to).cast("long").alias("round_to"),
    )


def final_candidates(finals: DataFrame, policy: AnalysisPolicy) -> DataFrame:
    """The post-phenotype figure alone: a single total, so no cells."""
    return finals.select(
        F.col("request_id").alias("candidate_id"), "study_id", "cpra",
        F.col("client_eligible").alias("client_total"),
        F.lit(True).alias("breakdown_suppressed"),
        F.array().cast(EMPTY_CELLS).alias("reported_cells"),
        F.lit(policy.sdc_min_cell).cast("long").alias("min_cell"),
        F.lit(policy.sdc_round_to).cast("long").alias("round_to"),
    )


def batch_candidates(batches: DataFrame, policy: AnalysisPolicy) -> DataFrame:
    """The union total alone; per-variant and overlap counts stay internal."""
    return batches.select(
        F.col("batch_id").alias("candidate_id"), "study_id", F.col("subject").alias("cpra"),
        F.col("combined_client_total").alias("client_total"), "breakdown_suppressed",
        F.array().cast(EMPTY_CELLS).alias("reported_cells"),
        F.lit(policy.sdc_min_cell).cast("long").alias("min_cell"),
        F.lit(policy.sdc_round_to).cast("long").alias("round_to"),
    )


# --- release predicate -----------------------------------------------------------------------


def _last_of_label(cells: Column) -> Column:
    """Cells without those that a later cell of the same label replaces."""
    return F.filter(
        cells,
        lambda cell, i: ~F.exists(
            F.slice(cells, i + 2, F.greatest(F.size(cells), F.lit(1))),
            lambda later: later["label"] == cell["label"],
        ),
    )


def total_is_safe(token: Column, min_cell: Column, round_to: Column) -> Column:
    n = F.substring(token, 2, 30).try_cast("long")
    multiple = F.try_mod(n, round_to) == 0
    return (
        F.when(token.startswith("<"), token == F.concat(F.lit("<"), min_cell.cast("string")))
        .when(token.startswith("~"), holds(multiple & (n >= min_cell)))
        .otherwise(False)
    )


def with_release_reasons(candidates: DataFrame, extra_fields: list[str] | None = None) -> DataFrame:
    """Add ``release_reasons``: every requirement a candidate fails; empty means releasable.

    ``extra_fields`` are columns of the candidate table that are keys, not candidate fields.
    """
    known = [*RELEASE_FIELDS, "candidate_id", *(extra_fields or [])]
    foreign = bool(unexpected_fields(candidates.columns, known))
    cells, last = F.col("reported_cells"), _last_of_label(F.col("reported_cells"))
    labels = F.transform(cells, lambda c: c["label"])
    m, base = F.col("min_cell"), F.col("round_to")
    rules = [
        ("release object carries a non-aggregate field", F.lit(foreign)),
        ("duplicate released subgroup cell labels", F.size(F.array_distinct(labels)) != F.size(cells)),
        ("a released subgroup cell count is negative", F.exists(cells, lambda c: c["count"] < 0)),
        (
            "a released subgroup cell is below the minimum cell size",
            F.exists(last, lambda c: (c["count"] > 0) & (c["count"] < m)),
        ),
        (
            "breakdown suppressed but subgroup cells released (back-calculation risk)",
            F.col("breakdown_suppressed") & (F.size(cells) > 0),
        ),
        (
            "a released cell is not a multiple of the rounding base",
            F.exists(last, lambda c: F.coalesce(F.try_mod(c["count"], base) != 0, F.lit(True))),
        ),
        (
            "the released total is neither the suppression token nor a rounded value",
            ~total_is_safe(F.col("client_total"), m, base),
        ),
    ]
    return candidates.withColumn(
        "release_reasons",
        F.array_compact(F.array(*[F.when(bad, F.lit(text)) for text, bad in rules])),
    )


# --- closed release language and verdict -----------------------------------------------------


def canonical_count(text: Column) -> Column:
    """Plain digits without a leading zero, at most ten of them; else null."""
    return F.when(text.rlike(r"\A(?:0|[1-9][0-9]{0,9})\z"), text.try_cast("long"))


# One variant reference: known contig, canonical position, bounded alleles. Ten digits stay under
# the position cap. A subject joins one to sixteen of them.
_CPRA = (
    rf"(?:{'|'.join(CONTIG_LENGTHS)}):[1-9][0-9]{{0,9}}"
    rf":[ACGT]{{1,{MAX_ALLELE_LENGTH}}}:[ACGT]{{1,{MAX_ALLELE_LENGTH}}}"
)
SUBJECT_PATTERN = rf"\A{_CPRA}(?:\+{_CPRA}){{0,{MAX_SUBJECT_VARIANTS - 1}}}\z"


def with_verdict(candidates: DataFrame, policy: ReleasePolicy, deployment: Deployment) -> DataFrame:
    """Add ``malformed`` codes, ``verdict``, the retained request and the payload.

    The order is fixed: malformed, then invalid policy, then rejected, then released. The
    authorised policy is applied; a candidate only states the policy it was made under.
    """
    m, base = policy.min_cell, policy.round_to
    cells = F.col("reported_cells")
    labels = F.transform(cells, lambda c: c["label"])
    token = F.col("client_total")
    withheld = token == f"<{m}"
    shown_n = F.when(token.startswith("~"), canonical_count(F.substring(token, 2, 30)))
    mappable = withheld | holds(shown_n <= MAX_COUNT)
    rules = [
        ("policy_disagrees", (F.col("min_cell") != m) | (F.col("round_to") != base)),
        ("bad_subject", ~holds(F.col("cpra").rlike(SUBJECT_PATTERN))),
        ("bad_total", ~mappable),
        ("too_many_cells", F.size(cells) > MAX_CELLS),
        ("unknown_label", F.exists(labels, lambda x: ~x.isin(APPROVED_CELL_LABELS))),
        ("duplicate_label", F.size(F.array_distinct(labels)) != F.size(cells)),
        (
            "bad_count",
            F.exists(cells, lambda c: ~holds(c["count"].between(0, MAX_COUNT))),
        ),
        ("suppressed_with_cells", F.col("breakdown_suppressed") & (F.size(cells) > 0)),
    ]
    policy_valid = m >= MIN_ALLOWED_CELL and base > 0 and m % base == 0
    total_ok = withheld | holds((shown_n >= m) & (F.try_mod(shown_n, F.lit(base)) == 0))
    cells_ok = F.forall(
        cells,
        lambda c: holds(
            ((c["count"] == 0) | (c["count"] >= m)) & (F.try_mod(c["count"], F.lit(base)) == 0)
        ),
    )
    judged = candidates.withColumn(
        "malformed", F.array_compact(F.array(*[F.when(bad, F.lit(code)) for code, bad in rules]))
    ).withColumn(
        "verdict",
        F.when(F.size("malformed") > 0, "malformed")
        .when(F.lit(not policy_valid), "invalid_policy")
        .when(~(total_ok & cells_ok), "rejected")
        .otherwise("released"),
    )
    authorised = F.struct(F.lit(m).alias("min_cell"), F.lit(base).alias("round_to"))
    request = F.to_json(F.struct(
        F.lit(deployment.release_schema).alias("schema"),
        authorised.alias("policy"),
        F.struct(
            F.col("cpra").alias("subject_id"),
            F.struct(
                F.when(withheld, "suppressed").otherwise("shown").alias("tag"),
                F.when(~withheld, shown_n).alias("n"),
            ).alias("total"),
            F.struct(
                F.when(F.col("breakdown_suppressed"), "suppressed").otherwise("shown").alias("tag"),
                F.when(~F.col("breakdown_suppressed"), cells).alias("cells"),
            ).alias("breakdown"),
        ).alias("candidate"),
    ))
    payload = F.to_json(
        F.struct(
            F.lit(deployment.release_schema).alias("schema"),
            F.lit("released").alias("status"),
            authorised.alias("policy"),
            F.col("cpra").alias("subject_id"),
            token.alias("total"),
            F.when(~F.col("breakdown_suppressed"), cells).alias("breakdown"),
        ),
        {"ignoreNullFields": "false"},
    )
    return judged.withColumns({
        "request_text": F.when(F.size("malformed") == 0, request),
        "payload": F.when(F.col("verdict") == "released", payload),
    })


def receipts(judged: DataFrame, policy: ReleasePolicy, deployment: Deployment) -> DataFrame:
    """Digests binding payload, retained request and policy, one row per released candidate."""
    return judged.filter(F.col("verdict") == "released").select(
        "candidate_id",
        F.lit(deployment.release_schema).alias("schema"),
        F.lit(policy.policy_id).alias("policy_id"),
        F.lit(policy.version).alias("policy_version"),
        F.lit(policy.policy_sha256).alias("policy_sha256"),
        F.sha2(F.col("request_text"), 256).alias("request_sha256"),
        F.sha2(F.concat(F.col("payload"), F.lit("\n")), 256).alias("payload_sha256"),
    )


def retained_requests(judged: DataFrame) -> DataFrame:
    """Request texts under their own digest; identical requests are kept once."""
    return judged.filter(F.col("verdict") == "released").select(
        F.sha2(F.col("request_text"), 256).alias("request_sha256"), "request_text"
    ).dropDuplicates(["request_sha256"])


RECEIPT_FIELDS = [
    "schema", "policy_id", "policy_version", "policy_sha256", "request_sha256", "payload_sha256",
]


def replayed_payload(request_text: Column) -> Column:
    """The payload rendered again from a retained request."""
    request = F.from_json(
        request_text,
        "schema string, policy struct<min_cell:bigint,round_to:bigint>, candidate struct<"
        "subject_id:string, total:struct<tag:string,n:bigint>, "
        f"breakdown:struct<tag:string,cells:{EMPTY_CELLS}>>",
    )
    total = F.when(
        request["candidate"]["total"]["tag"] == "shown",
        F.concat(F.lit("~"), request["candidate"]["total"]["n"].cast("string")),
    ).otherwise(F.concat(F.lit("<"), request["policy"]["min_cell"].cast("string")))
    return F.to_json(
        F.struct(
            request["schema"].alias("schema"), F.lit("released").alias("status"),
            request["policy"].alias("policy"),
            request["candidate"]["subject_id"].alias("subject_id"), total.alias("total"),
            request["candidate"]["breakdown"]["cells"].alias("breakdown"),
        ),
        {"ignoreNullFields": "false"},
    )


def verify_generations(
    payloads: DataFrame, receipt_rows: DataFrame, ledger: DataFrame, retained: DataFrame,
    policy: ReleasePolicy,
) -> DataFrame:
    """Payload, receipt, ledger record and retained request of each generation, compared.

    ``payloads`` is (candidate_id, payload); ``ledger`` holds the receipt fields recorded inside
    the run, one row per candidate. The result lists every mismatch; replay is a new rendering of
    the retained request and must give the payload byte for byte.
    """
    recorded = ledger.select(
        "candidate_id", F.struct(*RECEIPT_FIELDS).alias("ledger"), F.lit(True).alias("has_ledger")
    )
    receipt = receipt_rows.select(
        "candidate_id", F.struct(*RECEIPT_FIELDS).alias("receipt"), F.lit(True).alias("has_receipt")
    )
    joined = (
        payloads.join(receipt, "candidate_id", "full_outer")
        .join(recorded, "candidate_id", "left")
        .withColumn("request_sha256", F.col("receipt.request_sha256"))
        .join(retained, "request_sha256", "left")
    )
    has_receipt = holds(F.col("has_receipt"))
    has_payload, has_request = F.col("payload").isNotNull(), F.col("request_text").isNotNull()
    payload_sha = F.sha2(F.concat(F.col("payload"), F.lit("\n")), 256)
    rules = [
        ("payload_without_receipt", has_payload & ~has_receipt),
        ("receipt_without_payload", has_receipt & ~has_payload),
        (
            "payload_digest_mismatch",
            has_receipt & has_payload & (payload_sha != F.col("receipt.payload_sha256")),
        ),
        ("no_ledger_record", has_receipt & ~holds(F.col("has_ledger"))),
        (
            "receipt_differs_from_ledger",
            has_receipt & holds(F.col("has_ledger"))
            & ~F.to_json("receipt").eqNullSafe(F.to_json("ledger")),
        ),
        (
            "policy_changed",
            has_receipt & ~holds(
                (F.col("receipt.policy_id") == policy.policy_id)
                & (F.col("receipt.policy_version") == policy.version)
                & (F.col("receipt.policy_sha256") == policy.policy_sha256)
            ),
        ),
        ("retained_request_missing", has_receipt & ~has_request),
        (
            "retained_request_digest_mismatch",
            has_request & (F.sha2(F.col("request_text"), 256) != F.col("request_sha256")),
        ),
        (
            "replay_mismatch",
            has_payload & has_request
            & ~replayed_payload(F.col("request_text")).eqNullSafe(F.col("payload")),
        ),
    ]
    return joined.select(
        "candidate_id",
        F.array_compact(F.array(*[F.when(bad, F.lit(code)) for code, bad in rules])).alias("failures"),
    ).withColumn("ok", F.size("failures") == 0)


def generations(attempts: DataFrame) -> DataFrame:
    """Mark each attempt of a subject current, history or refused.

    Only the latest attempt can be current, and only when it was released: a refused latest
    attempt leaves the subject without a current payload.
    """
    # The latest attempt is found by a partial aggregation and met again on both columns, so a
    # subject with very many attempts is never gathered in one task.
    latest = attempts.groupBy("subject").agg(F.max("attempt").alias("attempt")).withColumn(
        "_latest", F.lit(True)
    )
    return attempts.join(latest, ["subject", "attempt"], "left").withColumn(
        "generation",
        F.when(F.col("verdict") != "released", "refused")
        .when(F.col("_latest"), "current")
        .otherwise("history"),
    ).drop("_latest")


# --- export manifest -------------------------------------------------------------------------


def safe_file_name(name: Column) -> Column:
    """A bare file name: no separators, not blank, not a dot name."""
    trimmed = F.trim(name)
    return holds(
        (trimmed != "") & ~trimmed.contains("/") & ~trimmed.isin(".", "..")
    )


def manifest_rules(files: DataFrame, keys: list[str]) -> DataFrame:
    """Per export manifest: the one-export rule, its class, and complete file descriptors.

    ``files`` is (keys, file, classification, export_to_client, human_readable, reason).
    """
    exported = holds(F.col("export_to_client"))
    described = (
        safe_file_name(F.col("file"))
        & holds(F.trim("classification") != "")
        & F.col("export_to_client").isNotNull()
        & F.col("human_readable").isNotNull()
        & holds(F.trim("reason") != "")
    )
    readable = holds(F.col("human_readable"))
    candidate = holds(F.col("classification") == "AIRLOCK-EXPORT-CANDIDATE")
    summed = files.groupBy(*keys).agg(
        F.count_if(exported).alias("exports"),
        F.bool_and(~exported | readable).alias("exports_readable"),
        F.bool_and(~exported | candidate).alias("exports_classified"),
        F.bool_and(described).alias("files_described_and_inspectable"),
        F.max(F.when(exported, F.col("file"))).alias("export_file"),
    )
    return summed.withColumns({
        "technically_feasible": F.col("files_described_and_inspectable") & F.col("exports_readable"),
        "manifest_reject": F.when(F.col("exports") != 1, "not_exactly_one_export")
        .when(~F.col("exports_readable"), "export_not_human_readable")
        .when(~F.col("exports_classified"), "export_wrong_class"),
    })


def export_files(runs: DataFrame, deployment: Deployment | None = None) -> DataFrame:
    """File descriptors of each run; ``runs`` carries ``kind`` (run, final or batch).

    Only the payload may leave. Columnar files are not readable by a person; why a file is
    classed as it is, is a matter of the deployment.
    """
    notes = (deployment or Deployment()).file_notes
    names = F.create_map(*[
        part for kind, files in RUN_FILES.items() for part in (F.lit(kind), F.array(*map(F.lit, files)))
    ])
    listed = runs.select("*", F.explode(names[F.col("kind")]).alias("file"))
    leaves = F.col("file") == EXPORTED_FILE
    return listed.withColumns({
        "classification": F.when(leaves, EXPORT_CLASS).otherwise(INTERNAL_CLASS),
        "export_to_client": leaves,
        "human_readable": ~F.col("file").endswith(".parquet"),
        "reason": F.when(leaves, notes[0]).otherwise(notes[1]),
    })

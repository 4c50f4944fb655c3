"""The whole evaluation: a table of requests in, one result row per request out.

All requests run in one plan. Participant rows are read once, shuffled once by (variant,
participant), and counted into a table of a few rows per evaluation; everything after that works
on request-sized data.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortgate.functions import disclosure as dc
from cohortgate.operators import (
    counts,
    disclosure,
    evidence,
    preflight,
    requests,
    results,
    sizing,
)
from cohortgate.operators.evidence import EVALUATION_KEY
from cohortgate.policy import AnalysisPolicy


@dataclass(frozen=True)
class Inputs:
    """The tables of one load. ``requests`` has request_id, batch_id and ordinal beside its fields.

    ``colocated``: participants, sample QC and genotypes are tables of one :class:`CohortLayout`, so
    their joins need no exchange and are not broadcast.
    """

    requests: DataFrame
    manifest: DataFrame
    bases: DataFrame
    panel_maf: DataFrame
    participants: DataFrame
    genotypes: DataFrame
    sample_qc: DataFrame
    colocated: bool = False

    def subjects(self) -> DataFrame:
        return evidence.subjects_of(self.participants, self.sample_qc)


def resolve(inputs: Inputs, policy: AnalysisPolicy) -> DataFrame:
    """Requests with violations, manifest match, pre-flight, source decision, status and reason."""
    checked = requests.with_violations(inputs.requests, policy)
    matched = requests.with_source_decision(
        requests.with_availability(requests.match_manifest(checked, inputs.manifest)), policy
    )
    flown = preflight.with_preflight(matched, inputs.bases, inputs.panel_maf)
    reason = F.coalesce(
        requests.first_or_null(F.col("violations")), F.col("manifest_reject"), F.col("preflight_reject")
    )
    return flown.withColumn("reject_reason", reason).withColumn(
        "status", F.when(F.col("reject_reason").isNull(), "accepted").otherwise("rejected")
    )


@dataclass(frozen=True)
class Evaluation:
    """Lazy stages of one evaluation over one set of inputs."""

    inputs: Inputs
    policy: AnalysisPolicy

    @cached_property
    def _resolved(self) -> tuple[DataFrame, pa.Table | None]:
        return sizing.held(resolve(self.inputs, self.policy))

    @property
    def resolved(self) -> DataFrame:
        """Requests with their checks. Up to ten thousand are held as a literal table, so the many
        later uses do not run the request joins again; more are written once and stay distributed."""
        return self._resolved[0]

    @cached_property
    def _evaluations(self) -> tuple[DataFrame, list[str] | None]:
        distributed = evidence.evaluations_of(self.resolved)
        rows = self._resolved[1]
        if rows is None:
            return distributed, None
        accepted = rows.filter(pc.equal(rows["status"], "accepted"))
        distinct = sizing.distinct_rows(accepted, evidence.EVALUATION_COLUMNS, EVALUATION_KEY)
        held = sizing.literal(distributed.sparkSession, distinct, distributed.schema)
        return held, sorted(set(distinct["cpra"].to_pylist()))

    @property
    def evaluations(self) -> DataFrame:
        """Distinct evaluations, held when the requests are: the scan is then filtered by their
        variants and their join is a broadcast of known size."""
        return self._evaluations[0]

    @cached_property
    def subjects(self) -> DataFrame:
        subjects = self.inputs.subjects()
        if self.inputs.colocated:
            return subjects.hint("merge")
        return sizing.broadcast_within(subjects, self.inputs.participants, self.inputs.sample_qc)

    @cached_property
    def carrier_words(self) -> DataFrame:
        """Bitmaps of the included carriers of every evaluation, over numbered subjects."""
        subjects = evidence.numbered(self.inputs.subjects())
        evaluations, cpras = self._evaluations
        found = evidence.candidate_evidence(
            self.inputs.genotypes, sizing.broadcast_within(subjects, subjects), evaluations, cpras
        )
        return counts.carrier_words(evidence.classify(evidence.with_gates(found, self.policy), self.policy))

    @cached_property
    def candidates(self) -> DataFrame:
        evaluations, cpras = self._evaluations
        return evidence.candidate_evidence(
            self.inputs.genotypes, self.subjects, evaluations, cpras
        )

    @cached_property
    def gated(self) -> DataFrame:
        return evidence.with_gates(self.candidates, self.policy)

    @cached_property
    def classified(self) -> DataFrame:
        return evidence.classify(self.gated, self.policy)

    @cached_property
    def members(self) -> DataFrame:
        """Accepted batch members with their place and evaluation key."""
        return self.resolved.filter(F.col("status") == "accepted").select(
            "batch_id", "ordinal", *EVALUATION_KEY
        )

    def summary(self) -> DataFrame:
        """Cells, ancestry strata and DR2 sensitivity per evaluation from a single aggregation.

        Rows are counted by (evaluation, ancestry), partly before the shuffle; the second step
        folds a few strata into one row per evaluation.
        """
        scenarios = disclosure.sensitivity_scenarios(self.policy)
        projected = [
            F.count_if(counts.projection(self.policy, s)["included"]).alias(f"t{i}")
            for i, s in enumerate(scenarios)
        ]
        by_stratum = self.classified.groupBy(
            *EVALUATION_KEY, counts.ancestry_stratum(F.col("ancestry_stub")).alias("stratum")
        ).agg(*counts.cell_aggregates(), *projected)
        m, base = self.policy.sdc_min_cell, self.policy.sdc_round_to
        sums = ["high_confidence", "conditional", "total", "excluded", "flagged"]
        moves = [f"t{i}" for i in range(len(scenarios))]
        folded = by_stratum.groupBy(*EVALUATION_KEY).agg(
            *[F.sum(name).alias(name) for name in [*sums, *moves]],
            F.bool_or(dc.small_cell(F.col("total"), m, base)).alias("ancestry_suppressed"),
            F.sort_array(F.collect_list(F.when(
                F.col("total") > 0,
                F.struct("stratum", dc.rounded(F.col("total"), base).alias("n")),
            ))).alias("_strata"),
        )
        return folded.withColumn(
            "ancestry_breakdown",
            F.when(~F.col("ancestry_suppressed"), F.col("_strata")),
        ).drop("_strata")

    def results(self) -> DataFrame:
        """One row per request: counts, tokens and shown cells.

        Rejected requests keep null counts and their reason.
        """
        policy = self.policy
        accepted = F.col("status") == "accepted"
        suppressed = F.coalesce("ancestry_suppressed", F.lit(False))
        joined = self.resolved.join(sizing.shuffled(self.summary()), EVALUATION_KEY, "left")
        zero = F.lit(0).cast("long")
        steps = [f"t{i}" for i in range(len(disclosure.sensitivity_scenarios(policy)))]
        numbers = ["high_confidence", "conditional", "total", "excluded", "flagged", *steps]
        filled = joined.withColumns({
            **{n: F.when(accepted, F.coalesce(n, zero)) for n in numbers},
            "ancestry_suppressed": F.when(accepted, suppressed),
            "ancestry_breakdown": F.when(
                accepted & ~suppressed,
                F.coalesce("ancestry_breakdown", F.array().cast("array<struct<stratum:string,n:bigint>>")),
            ),
        })
        return disclosure.control_cells(filled, policy).withColumn(
            "client_total", F.when(accepted, F.col("client_total"))
        )

    def reports(self) -> DataFrame:
        """Result rows with their sensitivity table, cells array and texts."""
        policy = self.policy
        accepted = F.col("status") == "accepted"
        scenarios = disclosure.sensitivity_scenarios(policy)
        exposes = F.lit(False)
        for i in range(len(scenarios) - 1):
            move = F.abs(F.col(f"t{i}") - F.col(f"t{i + 1}"))
            exposes = exposes | ((move > 0) & (move < policy.sdc_min_cell))
        tokens = F.array(*[
            F.struct(
                F.lit(s.name).alias("threshold"),
                dc.total_token(F.col(f"t{i}"), policy.sdc_min_cell, policy.sdc_round_to)
                .alias("client_total"),
            )
            for i, s in enumerate(scenarios)
        ])
        with_caveats = self.results().withColumn("caveats", preflight.caveats())
        return with_caveats.withColumns({
            "sensitivity_suppressed": F.when(accepted, exposes),
            "sensitivity": F.when(accepted & ~exposes, tokens),
            "reported_cells": disclosure.reported_cells(
                F.col("breakdown_suppressed"), F.col("shown_high"), F.col("shown_conditional")
            ),
            "assumptions": F.when(accepted, results.assumptions(policy)),
            "limitations": F.when(accepted, results.limitations(policy)),
            "recommendation": F.when(accepted, results.recommendation()),
        })

    def accepted_results(self) -> DataFrame:
        return self.results().filter(F.col("status") == "accepted")

    def accepted_reports(self) -> DataFrame:
        return self.reports().filter(F.col("status") == "accepted")

    def batches(self) -> DataFrame:
        """Batch rows: union and overlap, and the union's token.

        One rejected member rejects its batch, which then has no counts.
        """
        policy = self.policy
        heads = requests.batch_headers(self.resolved)
        union = counts.batch_union(self.carrier_words, self.members)
        joined = heads.join(sizing.shuffled(union), "batch_id", "left")
        ok = ~F.col("rejected")
        m, base = policy.sdc_min_cell, policy.sdc_round_to
        return joined.select(
            "batch_id", "study_id", "purpose", "members",
            F.when(ok, "accepted").otherwise("rejected").alias("status"),
            F.when(ok, F.col("subject")).alias("subject"),
            F.when(ok, F.col("distinct_variants")).alias("distinct_variants"),
            F.when(ok, F.col("combined_carriers")).alias("combined_carriers"),
            F.when(ok, F.col("overlap_carriers")).alias("overlap_carriers"),
            F.when(ok, dc.total_token(F.col("combined_carriers"), m, base)).alias("combined_client_total"),
            F.when(ok, dc.total_token(F.col("overlap_carriers"), m, base)).alias("overlap_client"),
            F.when(ok, F.col("breakdown_suppressed")).alias("breakdown_suppressed"),
        )

from __future__ import annotations

import cohorts
import pytest
from pyspark.sql import functions as F

from cohortgate.operators import checks, counts, evidence, frequency, views
from cohortgate.policy import AnalysisPolicy, Scenario


def by_person(df, *columns):
    return {r["participant_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_bootstrap_is_the_inverse_of_the_total_at_ranked_uniforms(spark):
    """The four inverses against exact sums, and the interval against resampling."""
    import math
    from fractions import Fraction

    import numpy as np

    from cohortgate.operators import frequency

    cases = [(30, 0, 0), (0, 0, 12), (5, 4, 3), (40, 9, 1), (0, 7, 5), (300, 60, 12), (9, 0, 0), (2000, 300, 20)]
    cells = cohorts.table(
        spark, [(f"v{i}", "array", "het_and_homalt", "1", *case) for i, case in enumerate(cases)] + [("y", "array", "het_and_homalt", "Y", 20, 5, 5)],
        "cpra string, requested_source string, carrier_definition string, chrom string, n0 bigint, n1 bigint, n2 bigint",
    )
    got = {r.cpra: (r.ci95_low, r.ci95_high) for r in frequency.bootstrap_interval(cells, AnalysisPolicy()).collect()}
    assert set(got) == {f"v{i}" for i in range(len(cases))} and got["v6"] == (None, None)
    uniforms = sorted(frequency.uniform_ranks().items())
    for i, (n0, n1, n2) in enumerate(cases):
        n = n0 + n1 + n2
        if n < 10:
            continue
        draws = np.random.default_rng(1).multinomial(n, [n0 / n, n1 / n, n2 / n], size=4000)
        low, high = np.percentile((draws[:, 1] + 2 * draws[:, 2]) / (2 * n), [2.5, 97.5])
        assert abs(got[f"v{i}"][0] - low) < 0.02 and abs(got[f"v{i}"][1] - high) < 0.02
        if n > 60:
            continue
        chance: dict[int, Fraction] = {}
        for x2 in range(n + 1):
            for x1 in range(n - x2 + 1):
                ways = math.factorial(n) // (math.factorial(x1) * math.factorial(x2) * math.factorial(n - x1 - x2))
                chance[x1 + 2 * x2] = chance.get(x1 + 2 * x2, 0) + Fraction(ways * n0 ** (n - x1 - x2) * n1**x1 * n2**x2, n**n)

        def inverse(u):
            below = Fraction(0)
            for t in sorted(chance):
                below += chance[t]
                if below >= Fraction(u):
                    return t

        t = {rank: inverse(u) for rank, u in uniforms}
        want = [(t[a] + (t[a + 1] - t[a]) * (share * 999 - a)) / (2 * n) for share, a in ((0.025, 24), (0.975, 974))]
        assert got[f"v{i}"] == tuple(round(w, 5) for w in want)


def test_tiny_cohort_counts_and_token(spark):
    run = cohorts.tiny(spark)
    row = run.results().collect()[0]
    assert (row["high_confidence"], row["conditional"], row["total"], row["excluded"]) == (2, 1, 3, 1)
    assert row["client_total"] == "<10" and row["breakdown_suppressed"]
    report = run.reports().collect()[0]
    assert report["recommendation"].startswith("GO WITH CAVEATS")
    assert report["limitations"][0].endswith("REF-to-reference match (REF 'T').")


def test_tiny_cohort_rows(spark):
    run = cohorts.tiny(spark)
    rows = by_person(run.classified, "source", "confidence", "evidence_priority", "decision", "reason")
    assert rows == {
        "P100003": ("array+imputed", "high", "array_direct", "included", ""),
        "P100007": ("array+imputed", "NA", "NA", "excluded", "consent_withdrawn"),
        "P100011": ("array+imputed", "high", "array_direct", "included", ""),
        "P100015": ("imputed", "conditional", "imputed_conditional", "included", ""),
    }
    handoff = evidence.epi_handoff(run.classified)
    assert "participant_id" not in handoff.columns
    assert {(r["pseudo_id"], r["caveat"]) for r in handoff.collect()} == {
        ("PSU-000003", ""), ("PSU-000011", ""),
        ("PSU-000015", "imputed-supported, DR2=0.64 (moderate)"),
    }


def test_six_row_cohort(spark):
    run = cohorts.six_rows(spark)
    row = counts.count_cells(run.classified).collect()[0]
    assert [row[c] for c in ("high_confidence", "conditional", "total", "excluded", "flagged")] == [1, 2, 3, 2, 1]
    reasons = by_person(run.classified, "reason", "flags")
    assert reasons["P3"] == ("imputed_max_gp<0.9", "")
    assert reasons["P4"] == ("array_call_rate<0.98", "")
    assert reasons["P0"] == ("", "related_pair")


def test_relaxed_projection_matches_a_rerun(spark):
    run = cohorts.six_rows(spark)
    projected = counts.project_cells(
        run.classified, run.policy, [Scenario("relaxed", imputed_max_gp_min=0.60)]
    ).collect()[0]
    again = counts.count_cells(
        cohorts.six_rows(spark, AnalysisPolicy(imputed_max_gp_min=0.60)).classified
    ).collect()[0]
    assert projected["total"] == again["total"] == 4 and projected["excluded"] == again["excluded"] == 1


def test_het_only_drops_homozygous_evidence(spark):
    names = ["A", "B", "C"]
    calls = [cohorts.array_call("A", 1), cohorts.array_call("B", 2), cohorts.imputed_call("C", 1.9)]
    run = cohorts.evaluation(
        spark, [cohorts.request(definition="het_only")], cohorts.people(names), calls,
        [(n, True, False) for n in names], AnalysisPolicy(carrier_definition="het_only"),
    )
    assert set(by_person(run.classified, "decision")) == {"A"}
    hard = counts.hardcall_counts(
        evidence.genotype_values(run.gated), F.col("array_credible") & F.col("consent_ok")
    ).collect()[0]
    assert (hard["n_het"], hard["n_homalt"], hard["n_carrier"]) == (1, 1, 1)
    assert counts.reconciliation(run.gated).collect()[0]["agrees"]


def test_missing_evidence_is_never_true(spark):
    """NaN and null thresholds, missing calls and unknown flags all fail closed."""
    names = ["A", "B"]
    calls = [
        cohorts.array_call("A", 1, gq=float("nan"), call_rate=float("nan")),
        cohorts.array_call("B", -1), cohorts.imputed_call("B", 1.0, float("nan")),
    ]
    run = cohorts.evaluation(
        spark, [cohorts.request()], cohorts.people(names), calls, [("A", "unknown", "maybe"), ("B", "TRUE", "0")]
    )
    gates = by_person(run.gated, "call_rate_ok", "gq_ok", "max_gp_ok", "has_array_gt", "sex_check_ok", "kinship_ok")
    assert gates["A"] == (False, False, False, True, False, False)
    assert gates["B"][2:] == (False, False, True, True)
    rows = by_person(run.classified, "decision", "reason", "flags")
    assert rows["A"] == ("excluded", "", "sample_sex_check_fail;related_pair")
    assert rows["B"] == ("excluded", "array_genotype_missing", "")


def test_gate_totals_cover_participants_without_calls(spark):
    names = [f"P{i}" for i in range(10)]
    run = cohorts.evaluation(
        spark, [cohorts.request()], cohorts.people(names, withdrawn={"P9"}),
        [cohorts.array_call("P0", 1)], [(n, True, n == "P1") for n in names],
    )
    passed = {
        r["gate"]: (r["passing_rows"], r["total_rows"])
        for r in counts.gate_pass_counts(run.gated, run.evaluations, run.subjects, run.policy).collect()
    }
    whole = evidence.with_gates(
        evidence.candidate_table(run.inputs.genotypes, run.subjects, cohorts.CPRA).join(run.evaluations, "cpra"),
        run.policy,
    )
    assert whole.count() == 10
    for gate, (rows, total) in passed.items():
        assert (rows, total) == (whole.filter(F.col(gate)).count(), 10), gate


def test_rejected_requests_stay_rows(spark):
    bad = cohorts.request("21:9900300:T:C", "R2", ordinal=1)
    unknown = cohorts.request("7:77:A:C", "R3", ordinal=2)
    wrong = cohorts.request(request_id="R4", ordinal=3, definition="het_only")
    rows = {r["request_id"]: r for r in cohorts.tiny(
        spark, requests=[cohorts.request(), bad, unknown, wrong]).results().collect()}
    assert rows["R1"]["status"] == "accepted" and rows["R1"]["total"] == 3
    assert rows["R2"]["reject_reason"] == "inaccurate_annotation" and rows["R2"]["client_total"] is None
    assert rows["R3"]["reject_reason"] == "not_in_manifest"
    assert rows["R4"]["reject_reason"] == "carrier_definition_mismatch"


def test_distributed_path_equals_held_path(spark, monkeypatch):
    from cohortgate.operators import sizing

    held = cohorts.tiny(spark).results().select("request_id", "total", "client_total").collect()
    monkeypatch.setattr(sizing, "held", lambda df, limit=0: (df, None))
    assert cohorts.tiny(spark).results().select("request_id", "total", "client_total").collect() == held


def test_two_variant_union(spark):
    other = "11:830045:C:A"
    names = [f"P{i}" for i in range(6)]
    calls = [cohorts.array_call(n, 1) for n in names[:3]] + [
        cohorts.array_call(n, 1, cpra=other) for n in names[1:4]
    ]
    requests = [cohorts.request(), cohorts.request(other, "R2", ordinal=1)]
    run = cohorts.evaluation(
        spark, requests, cohorts.people(names), calls, [(n, True, False) for n in names]
    )
    row = run.batches().collect()[0]
    assert (row["combined_carriers"], row["overlap_carriers"]) == (4, 2)
    assert row["breakdown_suppressed"] and row["subject"] == f"{cohorts.CPRA}+{other}"
    assert counts.shared_carriers(run.classified, cohorts.CPRA, other).count() == 2


def test_frequency_cohort(spark):
    names = [f"P{i}" for i in range(30)]
    carriers = {0, 2, 4, 6, 8, 10}
    calls = [cohorts.array_call(n, 1 if i in carriers else 0) for i, n in enumerate(names)]
    calls += [cohorts.imputed_call(n, 1.0 if i in carriers else 0.0) for i, n in enumerate(names)]
    people = cohorts.people(
        names, sex=lambda i: "M" if i % 2 == 0 else "F",
        ancestry=lambda i: "EUR" if i < 20 else "SAS" if i < 28 else "AFR",
    )
    run = cohorts.evaluation(
        spark, [cohorts.request()], people, calls, [(n, True, i in (0, 1)) for i, n in enumerate(names)]
    )
    cells = frequency.frequency_cells(run.gated, run.policy)
    strata = {
        (r["stratum_kind"], r["stratum"]): r
        for r in frequency.frequency_strata(cells, run.evaluations, run.subjects, run.policy).collect()
    }
    assert strata["overall", "all"]["af"] == 0.1 and strata["overall", "all"]["callable_alleles"] == 60
    assert strata["sex", "M"]["af"] == 0.2
    assert strata["ancestry", "SAS"]["suppressed"] and strata["ancestry", "AFR"]["af"] is None
    control = frequency.frequency_control(cells, run.evaluations, run.policy).collect()[0]
    assert control["af_delta"] == pytest.approx(0.01071) and "differs by 0.01071" in control["note"]
    assert (control["n_compared"], control["discordant_calls"]) == (30, 0)
    interval = frequency.bootstrap_interval(cells, run.policy).collect()[0]
    # Against the normal approximation of 6 alternate alleles in 60.
    spread = (0.2 * 0.8 / 30) ** 0.5 / 2
    assert interval["ci95_low"] == pytest.approx(0.1 - 1.96 * spread, abs=0.02)
    assert interval["ci95_high"] == pytest.approx(0.1 + 1.96 * spread, abs=0.02)


def test_integrity_checks_name_offenders(spark):
    run = cohorts.tiny(spark)
    people = run.inputs.participants
    with pytest.raises(ValueError, match="duplicate participant_id"):
        checks.assert_unique(people.union(people.limit(1)), ["participant_id"], "participants")
    with pytest.raises(ValueError, match="unmatched"):
        checks.assert_join_one_to_one(
            people, run.inputs.sample_qc.filter("participant_id <> 'P100000'"), ["participant_id"], "join"
        )
    with pytest.raises(ValueError, match="missing columns"):
        checks.require_columns(people.drop("sex"), ["sex"], "participants")
    with pytest.raises(ValueError, match="identifier"):
        checks.forbid_identifiers(people)
    checks.assert_inputs(people, run.inputs.sample_qc, run.inputs.genotypes)


def test_views_and_compat_label(spark):
    run = cohorts.evaluation(
        spark, [cohorts.request(source="array")], cohorts.people(["A"]), [cohorts.imputed_call("A", 1.0)],
        [("A", True, False)],
    )
    assert views.decision_reasons(run.classified).collect()[0]["reason"] == "no_credible_evidence"
    assert views.decision_reasons(run.classified, compat=True).collect()[0]["reason"] == "included"

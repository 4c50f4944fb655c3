from __future__ import annotations

import json

import cohorts
import pytest
from pyspark.sql import functions as F

from cohortgate.operators import disclosure, release
from cohortgate.plans import driver_views as dv
from cohortgate.policy import AnalysisPolicy, ReleasePolicy

SETTINGS = [(10, 5), (5, 5), (20, 10), (10, 1)]


@pytest.mark.parametrize(("minimum", "base"), SETTINGS)
def test_every_pair_below_sixty(spark, minimum, base):
    """All (high, conditional) pairs: nothing shown is small, unrounded or differenced away."""
    pairs = spark.range(3600).select(
        F.floor(F.col("id") / 60).alias("high_confidence"), (F.col("id") % 60).alias("conditional")
    ).withColumn("total", F.col("high_confidence") + F.col("conditional"))
    policy = AnalysisPolicy(sdc_min_cell=minimum, sdc_round_to=base)

    def round_to(n):
        return base * round(n / base)

    def tiny(n):
        return n > 0 and (n < minimum or round_to(n) < minimum)

    for row in disclosure.control_cells(pairs, policy).toLocalIterator():
        high, cond, total = row["high_confidence"], row["conditional"], row["total"]
        hidden = total < minimum or round_to(total) < minimum
        assert row["client_total"] == (f"<{minimum}" if hidden else f"~{round_to(total)}")
        assert row["breakdown_suppressed"] == (tiny(high) or tiny(cond))
        shown = (row["shown_high"], row["shown_conditional"])
        assert shown == ((None, None) if row["breakdown_suppressed"] else (round_to(high), round_to(cond)))


def test_strata_that_do_not_sum_are_withheld(spark):
    strata = cohorts.table(spark, [("k", "EUR", 25), ("k", "SAS", 15)], "k string, stratum string, n bigint")
    whole = cohorts.table(spark, [("k", 40)], "k string, total bigint")
    short = cohorts.table(spark, [("k", 41)], "k string, total bigint")
    policy = AnalysisPolicy()
    shown = disclosure.control_strata(strata, whole, ["k"], policy).collect()
    assert sorted((r["stratum"], r["shown_n"]) for r in shown) == [("EUR", 25), ("SAS", 15)]
    verdict = disclosure.strata_verdict(strata, short, ["k"], policy).collect()[0]
    assert verdict["ancestry_suppressed"] and verdict["unaccounted"] == 1


CANDIDATE = (
    "candidate_id string, study_id string, cpra string, client_total string, breakdown_suppressed boolean, "
    "reported_cells array<struct<label:string,count:bigint>>, min_cell bigint, round_to bigint"
)
HIGH, COND = "array_direct_high_confidence", "imputed_supported_conditional"


def candidates(spark, rows):
    full = [
        (f"C{i}", "S", r.get("cpra", cohorts.CPRA), r["total"], r["suppressed"],
         [{"label": a, "count": n} for a, n in r.get("cells", [])], 10, 5)
        for i, r in enumerate(rows)
    ]
    return cohorts.table(spark, full, CANDIDATE)


def plain_ok(total: str, suppressed: bool, cells: list[tuple[str, int]]) -> bool:
    """The release rules once more, in plain Python."""
    if total.startswith("~"):
        digits = total[1:]
        safe = digits.isdigit() and int(digits) >= 10 and int(digits) % 5 == 0
    else:
        safe = total == "<10"
    counts_ok = all(n >= 0 and (n == 0 or n >= 10) and n % 5 == 0 for _, n in cells)
    return safe and counts_ok and not (suppressed and cells) and len({a for a, _ in cells}) == len(cells)


def test_release_grid(spark):
    """Ten totals by nine cell lists by two flags: predicate and verdict against plain Python."""
    totals = ["<10", "<5", "~10", "~15", "~12", "~5", "~0", "10", "~", "~70"]
    cell_lists = [
        [], [(HIGH, 0)], [(HIGH, 10)], [(HIGH, 10), (COND, 15)], [(HIGH, 5)], [(HIGH, 12)], [(HIGH, -5)],
        [(HIGH, 10), (HIGH, 10)], [(HIGH, 0), (COND, 0)],
    ]
    rows = [
        {"total": t, "suppressed": s, "cells": c} for t in totals for c in cell_lists for s in (True, False)
    ]
    frame = candidates(spark, rows)
    reasons = {r["candidate_id"]: r["release_reasons"] for r in release.with_release_reasons(frame).collect()}
    judged = {
        r["candidate_id"]: r
        for r in release.with_verdict(frame, dv.RELEASE_POLICY, dv.DEPLOYMENT).collect()
    }
    for i, row in enumerate(rows):
        ok = plain_ok(row["total"], row["suppressed"], row["cells"])
        assert (reasons[f"C{i}"] == []) == ok, row
        assert (judged[f"C{i}"]["verdict"] == "released") == ok, row
        assert (judged[f"C{i}"]["payload"] is not None) == ok


def test_payload_text_and_verdict_order(spark):
    frame = candidates(spark, [
        {"total": "<10", "suppressed": True},
        {"total": "~70", "suppressed": False, "cells": [(HIGH, 70), (COND, 0)]},
        {"total": "~70", "suppressed": True, "cpra": "10:01:C:G"},
        {"total": "~70", "suppressed": True, "cpra": "+".join([cohorts.CPRA] * 17)},
    ])
    rows = {
        r["candidate_id"]: r for r in release.with_verdict(frame, dv.RELEASE_POLICY, dv.DEPLOYMENT).collect()
    }
    tag = dv.DEPLOYMENT.release_schema
    assert rows["C0"]["payload"] == (
        f'{{"schema":"{tag}","status":"released","policy":{{"min_cell":10,"round_to":5}},'
        '"subject_id":"7:5500120:T:A","total":"<10","breakdown":null}'
    )
    assert json.loads(rows["C1"]["payload"])["breakdown"] == [
        {"label": HIGH, "count": 70}, {"label": COND, "count": 0},
    ]
    assert [rows[f"C{i}"]["verdict"] for i in range(4)] == ["released", "released", "malformed", "malformed"]
    invalid = release.with_verdict(
        frame.withColumn("round_to", F.lit(6).cast("long")), ReleasePolicy("p", "1", 10, 6), dv.DEPLOYMENT
    )
    assert {r["verdict"] for r in invalid.filter("candidate_id in ('C0', 'C1')").collect()} == {"invalid_policy"}


def test_foreign_column_fails_the_predicate(spark):
    frame = candidates(spark, [{"total": "<10", "suppressed": True}]).withColumn("pseudo_id", F.lit("x"))
    assert release.with_release_reasons(frame).collect()[0]["release_reasons"] == [
        "release object carries a non-aggregate field"
    ]


def test_refused_latest_attempt_leaves_nothing_current(spark):
    attempts = cohorts.table(
        spark, [("a", 1, "released"), ("a", 2, "rejected"), ("b", 1, "released"), ("b", 2, "released")],
        "subject string, attempt bigint, verdict string",
    )
    rows = {(r["subject"], r["attempt"]): r["generation"] for r in release.generations(attempts).collect()}
    assert rows == {("a", 1): "history", ("a", 2): "refused", ("b", 1): "history", ("b", 2): "current"}


def test_export_file_sets_are_valid(spark):
    runs = cohorts.table(spark, [("1", "run"), ("2", "final"), ("3", "batch")], "id string, kind string")
    rows = release.manifest_rules(release.export_files(runs), ["id"]).collect()
    assert all(r["manifest_reject"] is None and r["technically_feasible"] for r in rows) and len(rows) == 3


def test_policy_is_checked_when_built():
    for wrong in (
        {"sdc_min_cell": 4}, {"sdc_round_to": 3}, {"imputed_dr2_high_confidence": 0.1},
        {"array_call_rate_min": 1.2}, {"require_consent": False},
    ):
        with pytest.raises(ValueError, match="invalid analysis policy"):
            AnalysisPolicy(**wrong)
    assert AnalysisPolicy.from_dict({"imputed_info_min": 0.4}).imputed_dr2_min == 0.4
    with pytest.raises(ValueError, match="twice"):
        AnalysisPolicy.from_dict({"imputed_info_min": 0.4, "imputed_dr2_min": 0.5})

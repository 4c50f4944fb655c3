"""Cohorts stored by participant, and carrier bitmaps."""

from __future__ import annotations

import random
from dataclasses import replace
from itertools import combinations

import cohorts
from pyspark.sql import functions as F

from cohortgate.operators import counts, evidence
from cohortgate.sources import layout


def test_stored_cohort_needs_no_exchange(spark):
    run = cohorts.tiny(spark)
    want = run.candidates.select("cpra", "participant_id", *evidence.EVIDENCE_COLUMNS, "consent_ok", "kinship_ok")
    stored = layout.store(spark, run.inputs.participants, run.inputs.sample_qc, run.inputs.genotypes, buckets=3)
    tables = {name: stored.table(spark, name) for name in layout.KEYS}
    together = type(run)(replace(run.inputs, **tables, colocated=True), run.policy)
    got = together.candidates.select(*want.columns)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" in plan
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert together.results().select("request_id", "total").collect() == run.results().select("request_id", "total").collect()
    once = stored.table(spark, "genotypes").groupBy("participant_id", "cpra", "source").count()
    assert "hashpartitioning" not in once._jdf.queryExecution().executedPlan().toString()
    assert stored.faults(spark).count() == 0
    stored.drop(spark)


def test_faults_of_a_stored_cohort(spark):
    run = cohorts.tiny(spark)
    people = run.inputs.participants
    first = people.agg(F.min("participant_id")).first()[0]
    quality = run.inputs.sample_qc.unionByName(run.inputs.sample_qc.filter(F.col("participant_id") == first))
    calls = run.inputs.genotypes.unionByName(run.inputs.genotypes.filter((F.col("participant_id") == first) & (F.col("source") == "array")))
    stored = layout.store(spark, people.filter(F.col("participant_id") != "P100009"), quality, calls, buckets=2)
    found = {tuple(r) for r in stored.faults(spark).collect()}
    assert found == {
        ("sample_qc: repeated", first, 2), ("genotypes: repeated", first, 2),
        ("sample_qc: unknown participant", "P100009", 1), ("genotypes: unknown participant", "P100009", 2),
    }


def test_calls_are_counted_before_they_meet_the_participants(spark):
    run = cohorts.tiny(spark)
    stored = layout.store(spark, run.inputs.participants, run.inputs.sample_qc, run.inputs.genotypes, buckets=2)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = stored.faults(spark)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    under = [plan[i + 1] for i, line in enumerate(plan) if "Join LeftAnti" in line]
    assert len(under) == 2 and all("Aggregate" in line for line in under)


def test_union_and_overlap_of_many_variants(spark):
    """Bitmaps against sets, with numbers far apart, equal variants under two sources, and empty ones."""
    rng = random.Random(4)
    numbers = [base + i for base in (0, 1 << 33, 5 << 33) for i in range(200)]
    variants = [f"1:{i}:A:C" for i in range(21)]
    carriers = {(v, s): set(rng.sample(numbers, rng.randrange(0, 60))) for v in variants for s in ("array", "imputed")}
    carriers[variants[3], "array"] = set(numbers)
    carriers[variants[4], "array"] = carriers[variants[4], "imputed"] = set()
    rows = [(v, s, "het_and_homalt", n, d) for (v, s), found in carriers.items() for n in numbers for d in (["included"] if n in found else ["excluded"][: n % 2])]
    classified = cohorts.table(spark, rows, "cpra string, requested_source string, carrier_definition string, participant_no bigint, decision string")
    batches = {"all": [(v, "array") for v in variants], "one": [(variants[0], "array")], "none": [(variants[4], "array")], "pair": [(variants[3], "array"), (variants[7], "imputed")],
               "same": [(variants[5], "array"), (variants[5], "imputed"), (variants[5], "array")], "three": [(v, "imputed") for v in variants[8:11]]}
    members = cohorts.table(spark, [(b, i, v, s, "het_and_homalt") for b, vs in batches.items() for i, (v, s) in enumerate(vs)],
                            "batch_id string, ordinal bigint, cpra string, requested_source string, carrier_definition string")
    words = counts.carrier_words(classified)
    got = {r.batch_id: r for r in counts.batch_union(words, members).collect()}
    per_variant = {(r.batch_id, r.cpra): r.included for r in counts.batch_variant_counts(words, members).collect()}
    for batch, asked in batches.items():
        sets: dict[str, set] = {}
        for v, s in asked:
            sets.setdefault(v, set()).update(carriers[v, s])
        both = set().union(*(a & b for a, b in combinations(sets.values(), 2))) if len(sets) > 1 else set()
        assert (got[batch].combined_carriers, got[batch].overlap_carriers) == (len(set().union(*sets.values())), len(both))
        assert got[batch].distinct_variants == len(sets)
        assert all(per_variant.get((batch, v), 0) == len(found) for v, found in sets.items())

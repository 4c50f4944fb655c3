"""Stored stages are used again only where their contract holds."""

from __future__ import annotations

import cohorts
import pytest
from pyspark.sql import functions as F

from cohortgate.operators import counts
from cohortgate.plans import staged
from cohortgate.plans.staged import StageMismatch, StageStore
from cohortgate.policy import AnalysisPolicy, Scenario


def test_digests_follow_content_only(spark):
    rows = cohorts.table(spark, [("a", 1), ("b", None), ("b", None), (None, 3)], "x string, y bigint")
    same = staged.content_digest(rows.repartition(3).orderBy(F.desc("x")))
    assert staged.content_digest(rows) == same
    for other in (rows.distinct(), rows.withColumn("y", F.col("y") + 1), rows.withColumnRenamed("y", "z"), rows.limit(0)):
        assert staged.content_digest(other) != same
    policy = AnalysisPolicy()
    assert staged.input_digest(policy, t=rows) == staged.input_digest(AnalysisPolicy(), t=rows.coalesce(1))
    assert staged.input_digest(AnalysisPolicy(array_gq_min=30), t=rows) != staged.input_digest(policy, t=rows)
    assert staged.input_digest(policy, u=rows) != staged.input_digest(policy, t=rows)


@pytest.mark.parametrize("text", [False, True])
def test_a_stage_is_made_once_and_refused_where_it_differs(spark, tmp_path, text):
    store = StageStore(spark, str(tmp_path / "stages"), text)
    rows = cohorts.table(spark, [('say "hi", now', 1), (None, 2), ("two\nlines" if not text else "x", 3)], "x string, y bigint")
    made = []

    def make():
        made.append(1)
        return rows

    for _ in range(2):
        got = store.reused("one", "d1", make).select("x", F.col("y").cast("long")).collect()
        assert sorted(map(tuple, got), key=lambda r: r[1]) == sorted(map(tuple, rows.collect()), key=lambda r: r[1])
    assert len(made) == 1
    with pytest.raises(StageMismatch, match="other inputs"):
        store.reused("one", "d2", make)
    with pytest.raises(StageMismatch, match="other columns"):
        store.open("one", "d1", rows.withColumn("y", F.col("y").cast("int")).schema)
    with pytest.raises(StageMismatch, match="not written"):
        store.open("two", "d1")
    (rows.write.parquet if not text else rows.selectExpr("x", "CAST(y AS STRING) AS y").write.option("header", True).csv)(str(tmp_path / "more"))
    part = next(p for p in (tmp_path / "more").iterdir() if p.name.startswith("part"))
    (tmp_path / "stages" / "one" / f"part-9{part.suffix}").write_bytes(part.read_bytes())
    with pytest.raises(StageMismatch, match="lost or gained"):
        store.open("one", "d1")


def test_stored_evidence_projects_like_the_run(spark, tmp_path):
    run = cohorts.six_rows(spark)
    scenarios = [Scenario("base"), Scenario("relaxed", imputed_max_gp_min=0.60)]
    direct = counts.project_cells(run.classified, AnalysisPolicy(), scenarios).collect()
    store = StageStore(spark, str(tmp_path / "stages"), text=True)
    store.save("classified", run.classified, "d")
    types = {f.name: f.dataType.simpleString() for f in run.classified.schema if f.name not in counts.STAGED_FLAGS}
    stored = store.open("classified", "d").withColumns({n: F.col(n).cast(t) for n, t in types.items()}).fillna("", ["flags"])
    assert counts.project_cells(counts.staged_evidence(stored), AnalysisPolicy(), scenarios).collect() == direct

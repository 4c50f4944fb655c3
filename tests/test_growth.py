"""Plans over tables that grow: few bytes on disk can be many rows."""

from __future__ import annotations

import glob
import hashlib
import os

import pytest
from oracle_check import TABLES, compare, connect
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cohortgate.functions import numbers
from cohortgate.operators import catalogue, requests, sizing
from cohortgate.plans import driver_views as dv
from cohortgate.plans import queries
from cohortgate.sources import vcf

SF_DIR = "/root/testdata/sf0.001"


def with_tables(folder, **replaced) -> str:
    """A data folder like the smallest one, in which some tables are replaced."""
    for name in TABLES:
        if name in replaced:
            replaced[name].coalesce(1).write.parquet(f"{folder}/{name}")
            [file] = glob.glob(f"{folder}/{name}/*.parquet")
            os.symlink(file, f"{folder}/{name}.parquet")
        else:
            os.symlink(f"{SF_DIR}/{name}.parquet", f"{folder}/{name}.parquet")
    return str(folder)


def test_many_rows_of_few_bytes_are_not_broadcast(spark, tmp_path):
    part = dv.table(spark, SF_DIR, "part")
    copies = part.join(spark.range(1_000).withColumnRenamed("id", "copy"))
    shift = F.col("p_partkey") + F.col("copy") * 1_000_000
    sf_dir = with_tables(tmp_path, part=copies.withColumn("p_partkey", shift).drop("copy"))
    matched = requests.match_manifest(dv.requests(spark, sf_dir), dv.manifest(spark, sf_dir))
    wide = dv.wide_requests(spark, sf_dir)
    for plan in (matched, wide, dv.genotypes(spark, sf_dir).select("cpra")):
        assert "BroadcastHashJoin" not in plan._jdf.queryExecution().executedPlan().toString()
    few = dv.wide_requests(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in few


def test_more_rows_than_held_are_computed_once(spark):
    rows = spark.range(50).withColumn("x", F.rand())
    kept, held = sizing.held(rows, limit=10)
    assert held is None and sorted(kept.collect()) == sorted(kept.collect())
    assert "Parquet" in kept._jdf.queryExecution().executedPlan().toString()


def test_a_position_listed_with_several_bases(spark, tmp_path):
    """Positions on MT repeat from part 375,325 on, with other bases; a request stays one row there."""
    parts, items = dv.table(spark, SF_DIR, "part"), dv.table(spark, SF_DIR, "lineitem").limit(2_000)
    again = parts.withColumn("p_partkey", F.col("p_partkey") + 375_325)
    sf_dir = with_tables(tmp_path, part=parts.unionByName(again), lineitem=items)
    query, sql = entry.queries()["build_and_strand"], entry.oracle_sql()["build_and_strand"]
    assert compare(spark, connect(sf_dir), query, sql, sf_dir) == ""
    assert query(spark, sf_dir).count() == items.count()


@pytest.fixture(scope="module")
def several_bases(spark, tmp_path_factory) -> str:
    """Every part three times, 375,325 keys apart, and calls of all of them: positions on MT have several bases."""
    again = spark.range(3).select((F.col("id") * 375_325).alias("by"))
    parts, items = dv.table(spark, SF_DIR, "part").join(again), dv.table(spark, SF_DIR, "lineitem")
    moved = items.withColumn("l_partkey", F.col("l_partkey") + F.col("l_orderkey") % 3 * 375_325)
    return with_tables(
        tmp_path_factory.mktemp("bases"), lineitem=moved,
        part=parts.withColumn("p_partkey", F.col("p_partkey") + F.col("by")).drop("by"),
    )


@pytest.mark.parametrize("name", [
    "ancestry_strata", "ancestry_verdicts", "build_and_strand", "candidate_table", "candidate_table_colocated",
    "classified_carriers", "client_totals", "decision_breakdown", "decision_tiers", "disclosure_view", "epi_handoff",
    "evaluation_cells",
])
def test_queries_where_a_position_has_several_bases(spark, several_bases, name):
    query, sql = entry.queries()[name], entry.oracle_sql()[name]
    assert compare(spark, connect(several_bases), query, sql, several_bases) == ""


@pytest.mark.parametrize("name", [
    "final_notes", "batch_export_files",
])
def test_no_join_broadcasts_a_table_that_grows(spark, monkeypatch, name):
    """With all tables beyond the row limits, no side of a join passes through the driver."""
    few, held = 10, sizing.held
    monkeypatch.setattr(sizing, "BROADCAST_ROWS", few)
    monkeypatch.setattr(sizing, "held", lambda df: held(df, few))
    plan = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_pairs_of_an_interval_join_are_dealt_to_tasks(spark):
    """A few thousand bytes that make many pairs; every locus meets every span that holds it."""
    loci = spark.range(600).select(F.lit("1").alias("chrom"), (F.col("id") * 5_000).alias("pos"))
    spans = spark.range(300).select(
        F.col("id").alias("span"), F.lit("1").alias("chrom"), (F.col("id") * 7_000).alias("start"), (F.col("id") * 7_000 + 900_000).alias("end")
    )
    found = catalogue.containing_spans(loci, spans, task_pairs=10_000)
    got = sorted((r.pos, r.span) for r in found.collect())
    want = sorted((5_000 * i, k) for i in range(600) for k in range(300) if 7_000 * k <= 5_000 * i <= 7_000 * k + 900_000)
    assert got == want
    assert found.select(F.spark_partition_id()).distinct().count() >= 3


def test_texts_of_numbers_are_rounded_once(spark):
    """The digits of a number are found once per row, not again for every part of the text that shows them."""
    rows = spark.range(5).select(numbers.significant(F.col("id") / 7).alias("short"), numbers.decimal_text(F.col("id") / 7).alias("long"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("format_string") == 1 and "regexp" not in plan


def test_held_rows_are_read_from_what_was_written(spark):
    """A result is not computed a second time to find that it is small or large."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    for limit in (10, 100):
        before = seen.value
        sizing.held(spark.range(50).mapInArrow(counted, "id long"), limit)
        assert seen.value - before == 50


def test_rows_of_a_small_file_are_dealt_by_count(spark, tmp_path):
    """A million parts in a few megabytes of one file are worked on by more tasks than the file has splits."""
    spark.range(300_000).coalesce(1).write.parquet(f"{tmp_path}/rows")
    assert sizing.spread(spark.read.parquet(f"{tmp_path}/rows")).rdd.getNumPartitions() == 7
    assert "Exchange" not in sizing.spread(dv.table(spark, SF_DIR, "part"))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["vcf_array_export", "vcf_imputed_export"])
def test_export_of_several_blocks_is_the_whole_line(spark, name):
    """A cohort beyond one block: no line holds more samples than a block may, and the blocks of a variant, put
    together, are the line over all samples that the SQL has."""
    export = {"vcf_array_export": vcf.array_export, "vcf_imputed_export": vcf.imputed_export}[name]
    heads, data = export(dv.chip_genotypes(spark, SF_DIR), queries._sites(spark, SF_DIR), per_block=40)
    names = [r["value"].split("\t")[9:] for r in heads.orderBy("block").collect()]
    listed = [n for block in names for n in block]
    assert len(names) > 2 and max(len(block) for block in names) <= 40
    assert listed == sorted(set(listed))
    lines: dict[str, list[str]] = {}
    for row in data.orderBy("block").collect():
        fields = row["value"].split("\t")
        assert len(fields) == 9 + len(names[row["block"]])
        lines.setdefault(row["cpra"], fields[:9]).extend(fields[9:])
    got = {(cpra, hashlib.sha256("\t".join(fields).encode()).hexdigest()) for cpra, fields in lines.items()}
    assert got == set(connect(SF_DIR).execute(entry.oracle_sql()[name]).fetchall())


@pytest.mark.parametrize("name", ["vcf_imputed_export", "vcf_imputed_scan"])
def test_imputed_calls_without_dosage_or_probability(spark, tmp_path, name):
    """A call that lacks its dosage or max GP is written as its SQL says, not as a homozygous carrier or with a GP cut short."""
    items = dv.table(spark, SF_DIR, "lineitem").withColumns({
        "l_tax": F.expr("CASE WHEN l_orderkey % 3 <> 0 THEN l_tax END"),
        "l_discount": F.expr("CASE WHEN l_orderkey % 5 <> 0 THEN l_discount END"),
    })
    sf_dir = with_tables(tmp_path, lineitem=items)
    calls = dv.chip_genotypes(spark, sf_dir).filter("source = 'imputed'")
    lacking = calls.selectExpr("count_if(dosage IS NULL)", "count_if(dosage > 0.5 AND max_gp IS NULL)").first()
    assert min(lacking) > 0
    assert compare(spark, connect(sf_dir), entry.queries()[name], entry.oracle_sql()[name], sf_dir) == ""

"""Driver tables written in the engine's file forms and read back through its readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortgate import schemas
from cohortgate.functions import numbers
from cohortgate.functions.digest import run_id
from cohortgate.functions.genotype import gt_text
from cohortgate.operators import finalize, frontier, ledger
from cohortgate.plans import driver_views as dv
from cohortgate.plans.queries import QUERIES, _ledger_size, _leaves, query
from cohortgate.sources import tables, vcf
from cohortgate.sources.durable import shared_path

__all__ = ["QUERIES"]


@query
def participants_read(spark, sf_dir):
    path = shared_path(spark, "participants")
    tables.write_parquet(dv.participants(spark, sf_dir).withColumn("unused", F.lit(1)), path)
    return tables.read_participants(spark, path)


@query
def sample_qc_read(spark, sf_dir):
    path = shared_path(spark, "sample-qc")
    dv.sample_qc(spark, sf_dir).write.option("header", True).option("sep", "\t").csv(path)
    return tables.read_sample_qc(spark, path)


@query
def requests_read(spark, sf_dir):
    path = shared_path(spark, "requests")
    rows = dv.requests(spark, sf_dir).select(*schemas.REQUESTS.fieldNames())
    tables.write_csv(rows, path)
    return tables.read_requests(spark, path)


@query
def requests_read_json(spark, sf_dir):
    path = f"{shared_path(spark, 'requests')}.jsonl"
    tables.write_json(dv.requests(spark, sf_dir).select(*schemas.REQUESTS.fieldNames()), path)
    return tables.read_requests(spark, path)


@query
def manifest_read(spark, sf_dir):
    path = shared_path(spark, "manifest")
    tables.write_csv(dv.wide_manifest(spark, sf_dir).select(*schemas.MANIFEST.fieldNames()), path)
    return tables.read_manifest(spark, path).select("cpra", "chrom", "pos", "on_array", "array_maf", "dosage_r2", "inaccurate_annotation")


@query
def identifiability_read(spark, sf_dir):
    path = shared_path(spark, "identifiability")
    sites = dv.wide_manifest(spark, sf_dir)
    listed = sites.select(
        "cpra", "on_array", "on_imputed", F.lit("TRUE").alias("annotation_reliable"),
        F.lit("r1").alias("source_release"), F.concat_ws(" ", F.lit("row"), F.col("k").cast("string")).alias("evidence"),
    )
    tables.write_csv(listed, path)
    return tables.read_identifiability(spark, path)


@query
def genotypes_read(spark, sf_dir):
    """Stored by contig and read for two of them: the filter prunes partitions."""
    path = shared_path(spark, "genotypes")
    tables.write_genotypes(dv.genotypes(spark, sf_dir), path)
    return tables.read_genotypes(spark, path).filter(F.col("chrom").isin("4", "X"))


@query
def genotypes_read_whole(spark, sf_dir):
    """Stored by contig and read back whole."""
    path = shared_path(spark, "genotypes")
    tables.write_genotypes(dv.genotypes(spark, sf_dir), path)
    return tables.read_genotypes(spark, path)


@query
def number_texts(spark, sf_dir):
    """Texts of numbers over many magnitudes."""
    items = dv.table(spark, sf_dir, "lineitem")
    scale = F.element_at(F.array(*[F.lit(float(f"1e{e}")) for e in range(-9, 9)]), (F.col("l_orderkey") % 18 + 1).cast("int"))
    value = (F.col("l_extendedprice").cast("double") + F.lit(1.0) / F.lit(3.0)) * F.lit(1e-5) * scale
    return items.select(
        "l_orderkey", "l_linenumber", numbers.significant(value).alias("six_digits"),
        numbers.decimal_text(F.col("l_partkey").cast("double") / F.lit(1e6)).alias("shortest"),
    )


def _run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per request; every third has crossed the release gate."""

    def pair(key: str, value: Column) -> Column:
        return F.create_map(F.lit(key), value)

    runs = dv.requests(spark, sf_dir).select(
        "ordinal", "request_id", "cpra", F.lit("2026-01-01T00:00:00+00:00").alias("timestamp"),
        F.lit("c0ffee").alias("config_sha256"),
        F.create_map(F.lit("z"), F.col("study_id"), F.lit("a"), F.lit("1")).alias("input_sha256"),
        pair("release.json", F.col("request_id")).alias("output_sha256"),
        pair("client_total", F.lit("<10")).alias("sdc"),
        F.when(F.col("ordinal") % 3 == 0, pair("payload", F.col("request_id"))).alias("airlock"),
    )
    return ledger.run_events(runs, F.col("ordinal"), F.lit(""), "unknown")


@query
def run_event_leaves(spark, sf_dir):
    events = _run_events(spark, sf_dir)
    return ledger.event_leaves(events, ledger.event_json(events))


@query
def run_event_parent_roots(spark, sf_dir):
    """The root before each run, which the chain check compares with what the run recorded."""
    events = _run_events(spark, sf_dir)
    leaves = ledger.event_leaves(events, ledger.event_json(events))
    return ledger.parent_roots(leaves, events.count())


@query
def broken_chain(spark, sf_dir):
    """Every eleventh event has recorded another root than that of the events before it."""
    events = _run_events(spark, sf_dir)
    leaves = ledger.event_leaves(events, ledger.event_json(events))
    total = events.count()
    recorded = ledger.parent_roots(leaves, total)
    wrong = F.when(F.col("seq") % 11 == 4, F.repeat(F.lit("0"), F.lit(64))).otherwise(F.col("parent_root"))
    return ledger.broken_chain(recorded.withColumn("parent_root", wrong), leaves, total).select("seq", "parent_root")


@query
def ledger_appends(spark, sf_dir):
    """The events appended in three steps: each step reads its own events and the stored frontier."""
    leaves, total = _leaves(spark, sf_dir), _ledger_size(spark, sf_dir)
    path = shared_path(spark, "frontiers")
    checks, before = None, frontier.Frontier()
    frontier.save(before, spark, path)
    for stop in (total // 3, 2 * total // 3 + 1, total):
        before = frontier.latest(spark, path)
        new = leaves.filter((F.col("seq") >= before.total) & (F.col("seq") < stop))
        after = frontier.extended(before, new, stop - before.total)
        frontier.save(after, spark, path)
        proof = frontier.consistent(before, after, spark).withColumn("total", F.lit(stop).cast("long"))
        checks = proof if checks is None else checks.unionByName(proof)
    states = spark.read.parquet(path)
    peaks = states.filter("kind = 'peak'").groupBy("total").agg(F.count(F.lit(1)).alias("peaks"))
    return frontier.roots(states).join(checks, "total").join(peaks, "total").select("total", "root", "consistent", "peaks")


#: Dictionaries made from nations, regions and parts, with columns that the readers do not know.
DICTIONARIES = {
    "entity": ("region", {"entity": "r_name", "description": "concat('all of ', r_name)", "primary_key": "'key'", "unknown": "1"}),
    "data": ("part", {
        "entity": "p_brand", "name": "p_name", "type": "'string'", "primary_key_type": "''", "coding_name": "concat('c', CAST(p_size AS VARCHAR(20)))",
        "title": "concat('title, ', p_name)", "units": "CAST(NULL AS VARCHAR(20))", "description": "concat('\"', p_type, '\"')",
    }),
    "coding": ("nation", {
        "coding_name": "concat('c', CAST(n_nationkey + 1 AS VARCHAR(20)))", "code": "CAST(n_nationkey AS VARCHAR(20))", "meaning": "n_name",
        "display_order": "CAST(n_regionkey AS VARCHAR(20))", "parent_code": "''",
    }),
}


@query
def dictionaries_read(spark, sf_dir):
    """Fields of the data dictionary with the labels of their codings."""
    path = shared_path(spark, "dictionaries")
    for name, (source, columns) in DICTIONARIES.items():
        rows = dv.table(spark, sf_dir, source).selectExpr(*[f"{sql} AS `{column}`" for column, sql in columns.items()])
        rows.write.option("header", True).option("escape", '"').csv(f"{path}/{name}_dictionary.csv")
    entity, data, coding = tables.read_dictionaries(spark, path)
    coded = data.join(coding, "coding_name", "left").select("entity", "name", "title", "units", "code", "meaning", "display_order")
    return coded.unionByName(entity.select("entity", F.col("description").alias("title")), allowMissingColumns=True)


@query
def shaped_read(spark, sf_dir):
    """Call files with one text or three probabilities a call, through the registered reader."""
    path = shared_path(spark, "shaped")
    calls = dv.genotypes(spark, sf_dir)
    text = F.when(F.col("gt_code") < 0, "./.").when(F.col("gq") < 3, "0|1").otherwise(gt_text(F.col("gt_code")))
    array = calls.filter("source = 'array'").select("participant_id", "cpra", text.alias("gt"), "gq", "call_rate")
    rest = F.lit(1.0) - F.col("max_gp")
    imputed = calls.filter("source = 'imputed'").select(
        "participant_id", "cpra", "dosage", rest.alias("gp_00"), F.col("max_gp").alias("gp_01"), F.lit(0.0).alias("gp_11")
    )
    for rows, name in ((array, "array_calls_vcf.tsv"), (imputed, "imputed_calls_bgen.tsv")):
        rows.write.option("header", True).option("sep", "\t").csv(f"{path}/{name}")
    return tables.read_genotype_source(spark, "shaped_tsv", path)


@query
def region_sample_qc_read(spark, sf_dir):
    path = shared_path(spark, "region-sample-qc")
    rows = dv.sample_qc(spark, sf_dir).withColumnRenamed("array_call_rate", "call_rate").withColumn("genotyping_batch", F.lit("b"))
    rows.write.option("header", True).option("sep", "\t").csv(path)
    return vcf.read_region_sample_qc(spark, path)


@query
def returns_read(spark, sf_dir):
    path = f"{shared_path(spark, 'returns')}.jsonl"
    tables.write_json(dv.returns(spark, sf_dir).select(*schemas.RETURNS.fieldNames()), path)
    rows = tables.read_returns(spark, path)
    return rows.withColumn("caveats", F.array_join("caveats", "|"))


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dv.checkpoints(spark, sf_dir)
    none = F.lit(None).cast("string")
    return rows.select(
        "checkpoint", F.lit("reviewer one").alias("reviewer"), F.lit("2026-01-01T00:00:00+00:00").alias("timestamp"),
        F.array("study_id").alias("artefacts_checked"), "decision", F.concat(F.lit("line one\nof "), "study_id").alias("notes"), none.alias("follow_up_owner"),
    )


@query
def checkpoints_read(spark, sf_dir):
    """Reviews appended in two steps; before the first there are none."""
    path = shared_path(spark, "checkpoints")
    rows, before = _reviews(spark, sf_dir), tables.read_checkpoints(spark, path).count()
    for decided in (True, False):
        tables.append_json_lines(rows.filter((F.col("decision") == "pass") == decided), path)
    read = tables.read_checkpoints(spark, path)
    return read.withColumn("artefacts_checked", F.array_join("artefacts_checked", "|")).withColumn("before", F.lit(before))


@query
def ledger_read_leaves(spark, sf_dir):
    """Leaves of run events that were appended to the ledger in two steps and read back."""
    path = shared_path(spark, "ledger")
    events = _run_events(spark, sf_dir)
    for part in (1, 0):
        tables.append_json_lines(events.filter(F.col("seq") % 2 == part), path)
    read = tables.read_ledger(spark, path)
    return ledger.event_leaves(read, ledger.event_json(read))


@query
def run_notifications(spark, sf_dir):
    runs = dv.requests(spark, sf_dir).select("study_id", "cpra", run_id(F.col("study_id"), F.col("cpra")).alias("run_id"))
    notes = finalize.notifications(runs, "awaiting_review")
    stamp = F.col("received_timestamp")
    recent = F.abs(F.unix_timestamp(stamp, "yyyy-MM-dd'T'HH:mm:ssXXX") - F.unix_timestamp(F.current_timestamp())) < 3600
    shaped = stamp.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\+00:00$") & recent
    return notes.withColumn("received_timestamp", shaped)

"""Table readers with explicit schemas, JSON records, and the plain sinks."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cohortgate import schemas
from cohortgate.functions import coerce
from cohortgate.functions.genotype import gt_text_code
from cohortgate.operators.checks import require_columns
from cohortgate.policy import Deployment, ReleasePolicy

GENOTYPE_COLUMNS = schemas.GENOTYPES.fieldNames()


def _csv(spark: SparkSession, path: str, schema: StructType, name: str, sep: str = ",") -> DataFrame:
    """Delimited text with a header, columns matched by name, types from the schema.

    The header is read first and checked; columns the schema does not name are read as text and
    dropped. Blank and ``NA`` cells of number columns become null.
    """
    untyped = spark.read.option("sep", sep).csv(path, header=True, inferSchema=False)
    header = require_columns(untyped, schema, name).columns
    raw = spark.read.option("sep", sep).csv(
        path, header=True, schema=StructType().fromJson(_text_schema(header))
    )
    return raw.select(*[_typed(field.name, field.dataType.typeName()) for field in schema.fields])


def _text_schema(columns: list[str]) -> dict:
    fields = [{"name": c, "type": "string", "nullable": True, "metadata": {}} for c in columns]
    return {"type": "struct", "fields": fields}


def _typed(name: str, kind: str) -> Column:
    column = F.col(f"`{name}`")
    if kind == "double":
        return coerce.optional_number(column).alias(name)
    if kind in ("long", "integer"):
        return F.trim(column).try_cast("long").alias(name)
    return column.alias(name)


def _parquet(
    spark: SparkSession, path: str, schema: StructType, name: str, partition: str | None = None
) -> DataFrame:
    """Parquet, cut to the declared columns (only these reach the scan) and a partition column."""
    df = require_columns(spark.read.parquet(path), schema, name)
    kept = [F.col(partition).cast("string")] if partition in df.columns else []
    return df.select(*kept, *[
        coerce.number(F.col(f.name).cast("double")).alias(f.name)
        if f.dataType.typeName() == "double" else F.col(f.name).cast(f.dataType)
        for f in schema.fields
    ])


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests from CSV or JSON, one per row, every field as text."""
    if path.endswith((".json", ".jsonl")):
        multi = path.endswith(".json")
        return spark.read.schema(schemas.REQUESTS).option("multiLine", multi).json(path)
    return _csv(spark, path, schemas.REQUESTS, "requests")


def read_single_request(spark: SparkSession, path: str) -> DataFrame:
    """The one-request form: any other row count is an error."""
    df = read_requests(spark, path)
    rows = len(df.limit(2).collect())
    if rows != 1:
        raise ValueError(f"variant request must contain exactly one row, got {'none' if not rows else 'more'}")
    return df


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.MANIFEST, "variant_manifest")


def read_identifiability(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.IDENTIFIABILITY, "variant_identifiability")


def read_participants(spark: SparkSession, path: str) -> DataFrame:
    return _parquet(spark, path, schemas.PARTICIPANTS, "participants")


def read_genotypes(spark: SparkSession, path: str) -> DataFrame:
    """Long genotype table. Stored by :func:`write_genotypes`, a locus filter prunes partitions
    by chrom and row groups by cpra."""
    return _parquet(spark, path, schemas.GENOTYPES, "genotype_slice", partition="chrom")


def read_sample_qc(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.SAMPLE_QC, "sample_qc", sep="\t")


def read_dictionaries(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entity, data and coding dictionaries."""
    return (
        _csv(spark, f"{directory}/entity_dictionary.csv", schemas.ENTITY_DICTIONARY, "entity"),
        _csv(spark, f"{directory}/data_dictionary.csv", schemas.DATA_DICTIONARY, "data"),
        _csv(spark, f"{directory}/coding_dictionary.csv", schemas.CODING_DICTIONARY, "coding"),
    )


def read_returns(spark: SparkSession, path: str) -> DataFrame:
    """Returns from files of one record (or one array) each, or from JSON lines (``.jsonl``)."""
    return spark.read.schema(schemas.RETURNS).option("multiLine", not path.endswith(".jsonl")).json(path)


def _absent(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return not hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def read_json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines under a schema; blank lines are skipped, an absent path gives no rows."""
    if _absent(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    return read_json_lines(spark, path, schemas.CHECKPOINTS)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger; its order is the ``seq`` column, never the file order."""
    return read_json_lines(spark, path, schemas.LEDGER)


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def read_shaped_genotypes(spark: SparkSession, directory: str) -> DataFrame:
    """The two tab-separated call files (GT text; GP triplet) as long genotype rows."""
    array_schema = StructType.fromDDL(
        "participant_id string, cpra string, gt string, gq double, call_rate double"
    )
    imputed_schema = StructType.fromDDL(
        "participant_id string, cpra string, dosage double, gp_00 double, gp_01 double, gp_11 double"
    )
    array = _csv(spark, f"{directory}/array_calls_vcf.tsv", array_schema, "array_calls", "\t")
    imputed = _csv(spark, f"{directory}/imputed_calls_bgen.tsv", imputed_schema, "imputed_calls", "\t")
    return array_rows(array.withColumn("gt_code", gt_text_code(F.col("gt")))).unionByName(
        imputed_rows(imputed.withColumn("max_gp", F.greatest("gp_00", "gp_01", "gp_11")))
    )


def array_rows(calls: DataFrame) -> DataFrame:
    """(participant_id, cpra, gt_code, gq, call_rate) in the long genotype form."""
    return calls.select(
        "participant_id", "cpra", F.lit("array").alias("source"), F.col("gt_code").cast("double"),
        F.col("gq").cast("double"), F.col("call_rate").cast("double"),
        F.lit(None).cast("double").alias("dosage"), F.lit(None).cast("double").alias("max_gp"),
    )


def imputed_rows(calls: DataFrame) -> DataFrame:
    """(participant_id, cpra, dosage, max_gp) in the long genotype form."""
    missing = F.lit(None).cast("double")
    return calls.select(
        "participant_id", "cpra", F.lit("imputed").alias("source"), missing.alias("gt_code"),
        missing.alias("gq"), missing.alias("call_rate"), F.col("dosage").cast("double"),
        F.col("max_gp").cast("double"),
    )


GENOTYPE_READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "parquet": read_genotypes,
    "shaped_tsv": read_shaped_genotypes,
}


def register_genotype_source(name: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
    """Add a reader that gives the long genotype form."""
    GENOTYPE_READERS[name] = reader


def read_genotype_source(spark: SparkSession, kind: str, path: str) -> DataFrame:
    df = require_columns(GENOTYPE_READERS[kind](spark, path), schemas.GENOTYPES, f"genotypes({kind})")
    contig = ["chrom"] if "chrom" in df.columns else []
    return df.select(*contig, *GENOTYPE_COLUMNS)


def small_table(spark: SparkSession, rows: list[tuple], schema: StructType) -> DataFrame:
    """A literal table. Going through Arrow makes it a local relation: no Python worker reads it,
    and its known size lets joins broadcast it."""
    names = schema.fieldNames()
    columns = {name: [row[i] for row in rows] for i, name in enumerate(names)}
    table = pa.table(columns, schema=to_arrow_schema(schema))
    return spark.createDataFrame(table, schema)


def reference_tables(spark: SparkSession, rows: dict) -> tuple[DataFrame, DataFrame]:
    """Bases and panel frequencies from ``{"bases": {build: {locus: base}}, "panel_maf": {...}}``."""
    bases = [
        (build, locus.split(":")[0], int(locus.split(":")[1]), base)
        for build, loci in rows["bases"].items() for locus, base in loci.items()
    ]
    return (
        small_table(spark, bases, schemas.REFERENCE_BASES),
        small_table(spark, list(rows["panel_maf"].items()), schemas.PANEL_MAF),
    )


POLICY_KEYS = {"schema", "policy_id", "version", "min_cell", "round_to", "adjudicator_sha256"}


def read_release_policy(spark: SparkSession, path: str, deployment: Deployment) -> ReleasePolicy:
    """The one release-policy record, checked strictly; its digest is over the exact text.

    The record is parsed in Spark; only the checked one-row result reaches the driver.
    """
    files = spark.read.format("binaryFile").load(path).select(
        F.col("content").cast("string").alias("text"), F.sha2("content", 256).alias("digest")
    )
    variant = F.try_parse_json(F.col("text"))

    def kind(key: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(variant, f"$.{key}", "variant"))

    def text_of(key: str) -> Column:
        return F.try_variant_get(variant, f"$.{key}", "string")

    positive = [
        (kind(key) == "BIGINT") & (F.try_variant_get(variant, f"$.{key}", "bigint") > 0)
        for key in ("min_cell", "round_to")
    ]
    named = [(kind(key) == "STRING") & (F.trim(text_of(key)) != "") for key in ("policy_id", "version")]
    pin = text_of("adjudicator_sha256")
    pin_ok = pin.isNull() | ((kind("adjudicator_sha256") == "STRING") & (F.length(pin) == 64))
    keys_ok = F.array_sort(F.json_object_keys("text")) == F.array(*[F.lit(k) for k in sorted(POLICY_KEYS)])
    checked = files.select(
        F.coalesce(
            keys_ok & (text_of("schema") == deployment.policy_schema) & positive[0] & positive[1]
            & named[0] & named[1] & pin_ok,
            F.lit(False),
        ).alias("ok"),
        text_of("policy_id").alias("policy_id"), text_of("version").alias("version"),
        F.try_variant_get(variant, "$.min_cell", "bigint").alias("min_cell"),
        F.try_variant_get(variant, "$.round_to", "bigint").alias("round_to"), "digest",
    )
    rows = checked.limit(2).collect()
    if len(rows) != 1 or not rows[0]["ok"]:
        raise ValueError("malformed release policy record")
    row = rows[0]
    return ReleasePolicy(row["policy_id"], row["version"], row["min_cell"], row["round_to"], row["digest"])


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file under ``path``, hashed per part file in the executors."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(
        "path", "length", F.sha2("content", 256).alias("sha256")
    )


# --- sinks -----------------------------------------------------------------------------------


def write_genotypes(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store genotypes for pruned reads: one directory per contig, sorted by position inside.

    Rows are ranged by (chrom, pos, participant) so a popular variant spreads over many files.
    """
    placed = df.withColumns({
        "chrom": F.split_part("cpra", F.lit(":"), F.lit(1)),
        "pos": F.split_part("cpra", F.lit(":"), F.lit(2)).cast("long"),
    })
    (
        placed.repartitionByRange("chrom", "pos", "participant_id")
        .sortWithinPartitions("chrom", "pos", "cpra", "participant_id")
        .write.mode(mode).partitionBy("chrom").parquet(path)
    )


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_text(df: DataFrame, path: str, mode: str = "errorifexists", gzip: bool = False) -> None:
    """One text column, one line (or block of lines) per row."""
    writer = df.write.mode(mode)
    (writer.option("compression", "gzip") if gzip else writer).text(path)

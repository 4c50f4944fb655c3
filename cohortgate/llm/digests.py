"""Exact deduplication over a persistent digest index.

The index is a Parquet table bucketed and sorted by digest in the shared folder. An arrival is
combined by digest (with partial aggregation), its unseen digests are found by a sort-merge
anti-join with the index, and these are appended. The text itself is never shuffled: it is
digested in the scan that reads it.

Defined results: a null text counts as empty; texts are equal when identical after lower-casing
A-Z only; a null ``doc_id`` is smaller than every other; of repeated rows with the surviving id
and the same text one is kept, and different texts of one id (or without an id) all stay; texts are digested whole,
whatever their length; an empty table gives an empty result. Other columns are neither read nor changed.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortgate.llm.tables import ascii_lower, kept, shared_dir


def text_digest(text: Column) -> Column:
    """SHA-256 of the normalised text as 32 bytes."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256))


class DigestIndex:
    """Digests seen so far with the document that stands for each.

    ``path`` is where the index lives. Its bucket count is stored beside it (``<path>.settings``): an
    existing index is opened with that, and asking for another one is refused, since rows would be
    looked for in the wrong files. The same text arriving later is a copy of the one already in the index.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/digest-index-{uuid.uuid4().hex}"
        stored = self._stored_buckets()
        if stored and buckets and stored != buckets:
            raise ValueError(f"the index at {self.path} has {stored} buckets, not {buckets}")
        self.buckets = stored or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not stored:
            spark.range(1).select(F.lit(self.buckets).alias("buckets")).write.json(f"{self.path}.settings")
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, doc_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def _stored_buckets(self) -> int | None:
        try:
            return self.spark.read.schema("buckets int").json(f"{self.path}.settings").first().buckets
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def absorb(self, arrival: DataFrame) -> None:
        """Append the digests of ``arrival`` (``digest, doc_id``) that the index lacks."""
        firsts = arrival.groupBy("digest").agg(F.max("doc_id").alias("doc_id"))
        unseen = firsts.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        (
            unseen.repartition(self.buckets, "digest")
            .write.mode("append").format("parquet")
            .bucketBy(self.buckets, "digest").sortBy("digest")
            .option("path", self.path).saveAsTable(self.table)
        )
        self.spark.catalog.refreshTable(self.table)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, n``: n repeated rows share id and text. Written once; texts are read once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("digest"))
    return kept(rows.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")), "fingerprints")


def classes(prints: DataFrame) -> DataFrame:
    """``digest, keep_id, group_size`` of every digest.

    The prints arrive in two parts, larger ids first, so that the largest id of equal texts is the
    one the index knows.
    """
    spark = prints.sparkSession
    index = DigestIndex(spark)
    span = prints.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    if span.low is None:
        index.absorb(prints)
    else:
        middle = F.lit((span.low + span.high) // 2)
        index.absorb(prints.filter(F.col("doc_id") > middle))
        index.absorb(prints.filter(F.col("doc_id").isNull() | (F.col("doc_id") <= middle)))
    sizes = prints.groupBy("digest").agg(F.sum("n").alias("group_size"))
    found = sizes.join(index.rows().withColumnRenamed("doc_id", "keep_id"), "digest")
    return kept(found, "digest-classes")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row per document with the class it belongs to.

    Both join sides are plain shuffles of narrow rows, so adaptive execution can split the
    partition of a text that a large part of all rows repeats.
    """
    prints = fingerprints(docs)
    joined = prints.join(classes(prints), "digest")
    each = joined.withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return each.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("turn") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def survivors(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns."""
    prints = fingerprints(docs)
    stay = classes(prints).select(F.col("keep_id").alias("__keep_id"), F.col("digest").alias("__keep"))
    rows = docs.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__digest", text_digest(F.col("text")))
    same = F.col("__id").eqNullSafe(F.col("__keep_id")) & (F.col("__digest") == F.col("__keep"))
    rows = rows.join(stay, same, "left_semi")
    repeated = prints.filter("n > 1").limit(1).count()
    return (rows.dropDuplicates(["__id", "__digest"]) if repeated else rows).drop("__id", "__digest")

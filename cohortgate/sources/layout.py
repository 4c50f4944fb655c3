"""Cohort tables stored together by participant, so that evidence is joined without a shuffle.

Participants, sample QC and genotypes are bucketed by participant into the same number of buckets;
genotypes also have one directory per contig and are sorted by position inside, so a request still
prunes contigs and row groups. Grouping calls by (variant, participant), joining the participant and
checking unique keys then stay inside a bucket. A popular variant spreads over all buckets, and a
participant has few rows for each variant asked for, so buckets are even.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortgate.operators import checks
from cohortgate.sources.durable import shared_path

#: Unique keys of the stored tables; all of them hold the bucketing column.
KEYS = {
    "participants": ["participant_id"],
    "sample_qc": ["participant_id"],
    "genotypes": ["participant_id", "cpra", "source"],
}


@dataclass(frozen=True)
class CohortLayout:
    """Names of the stored tables in the session's catalogue, and the number of their buckets."""

    participants: str
    sample_qc: str
    genotypes: str
    buckets: int

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.table(getattr(self, name))

    def faults(self, spark: SparkSession) -> DataFrame:
        """``table, participant_id, rows`` of every key that stands more than once, found inside the
        buckets, and of every call or sample QC row of an unknown participant."""
        found = None
        for name, keys in KEYS.items():
            rows = self.table(spark, name)
            twice = checks.duplicate_keys(rows, keys).select(F.lit(f"{name}: repeated").alias("fault"), "participant_id", "rows")
            if name != "participants":
                known = self.table(spark, "participants").select("participant_id").hint("merge")
                # Counted before they meet the known ones: a row per participant is sorted for the join, not all calls.
                unknown = rows.groupBy("participant_id").agg(F.count(F.lit(1)).alias("rows")).join(known, "participant_id", "left_anti")
                twice = twice.unionByName(unknown.select(F.lit(f"{name}: unknown participant").alias("fault"), "participant_id", "rows"))
            found = twice if found is None else found.unionByName(twice)
        return found

    def drop(self, spark: SparkSession) -> None:
        """Forget the tables; their files stay where they were written."""
        for name in KEYS:
            spark.sql(f"DROP TABLE IF EXISTS {getattr(self, name)}")


def store(
    spark: SparkSession, participants: DataFrame, sample_qc: DataFrame, genotypes: DataFrame,
    buckets: int | None = None,
) -> CohortLayout:
    """Write the three tables; each is shuffled once, by participant."""
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = genotypes.withColumns({
        "chrom": F.split_part("cpra", F.lit(":"), F.lit(1)),
        "pos": F.split_part("cpra", F.lit(":"), F.lit(2)).cast("long"),
    })
    names = {}
    for name, rows in (("participants", participants), ("sample_qc", sample_qc), ("genotypes", placed)):
        names[name] = f"{name}_{uuid.uuid4().hex}"
        order = ["pos", "cpra", "participant_id"] if name == "genotypes" else ["participant_id"]
        writer = rows.repartition(count, "participant_id").write.format("parquet")
        writer = writer.option("path", shared_path(spark, name)).bucketBy(count, "participant_id").sortBy(*order)
        (writer.partitionBy("chrom") if name == "genotypes" else writer).saveAsTable(names[name])
    return CohortLayout(**names, buckets=count)

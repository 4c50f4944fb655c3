"""Size checks in front of every broadcast and every driver-held table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortgate.sources.durable import written

BROADCAST_ROWS = 100_000
HELD_ROWS = 10_000
#: Rows of a compact file that one task computes on.
TASK_ROWS = 50_000


def broadcast_within(df: DataFrame, *bounding: DataFrame) -> DataFrame:
    """Mark ``df`` for broadcast when the tables that bound it have few rows by count; otherwise its
    join shuffles, with adaptive splitting of skewed partitions.

    Estimates of bytes are no bound: a scan counts with the size of its files, of which a few
    megabytes can hold a million rows.
    """
    few = all(frame.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS for frame in bounding)
    return F.broadcast(df) if few else shuffled(df)


def shuffled(df: DataFrame) -> DataFrame:
    """A table that grows with the data: its join is a merge of shuffled sides and never a broadcast."""
    return df.hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """A stored table dealt to tasks by its rows, for work that follows the rows and not the bytes: a few
    megabytes of Parquet, which are one or two splits, can hold a million rows."""
    tasks = 1 + df.count() // TASK_ROWS
    return df.repartition(tasks) if tasks > 2 else df


def held(df: DataFrame, limit: int = HELD_ROWS) -> tuple[DataFrame, pa.Table | None]:
    """A small result as a literal table with its rows; a larger one stays where it was written, without rows.

    The result is computed and written once, and what was written is asked for its size. At most ``limit`` + 1
    rows reach the driver. Within the limit the table's rows become part of the plan: its size is known to the
    optimizer and its values can be pushed into a scan. Beyond it the many later uses read the written rows.
    """
    kept = written(df, "held")
    rows = kept.limit(limit + 1).toArrow()
    if rows.num_rows > limit:
        return kept, None
    return literal(df.sparkSession, rows, df.schema), rows


def literal(spark: SparkSession, rows: pa.Table, schema: StructType) -> DataFrame:
    return spark.createDataFrame(rows, StructType(schema.fields))


def distinct_rows(rows: pa.Table, columns: list[str], keys: list[str]) -> pa.Table:
    """One row per key of a held table."""
    seen = {}
    for row in rows.select(columns).to_pylist():
        seen.setdefault(tuple(row[key] for key in keys), row)
    return pa.Table.from_pylist(list(seen.values()), schema=rows.select(columns).schema)

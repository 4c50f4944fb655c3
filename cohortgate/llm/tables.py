"""What the corpus operators share: durable intermediate tables and text expressions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: One word: a run of anything but space and the controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes up to which a table whose size was counted may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 8 << 20

#: Narrow rows that one task writes where a bound of the rows is known.
TASK_ROWS = 100_000

_local_folder: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; local sessions without the
    setting get one temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_folder:
        _local_folder.append(tempfile.mkdtemp(prefix="spark-"))
    return _local_folder[0]


def kept(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors.

    ``rows`` is a known bound of narrow rows; a table that is small by it is written by as few
    tasks, whatever the number of shuffle partitions.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(1 + rows // TASK_ROWS)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, width: Column | None = None) -> bool:
    """Whether a table (cheap to scan) is within the documented broadcast bound."""
    size = df.agg(F.count(F.lit(1)).alias("n"), F.sum(width if width is not None else F.lit(64)).alias("b")).first()
    return size.n <= BROADCAST_ROWS and (size.b or 0) <= BROADCAST_BYTES


def ascii_lower(text: Column) -> Column:
    """A-Z lowered, every other character as it is. Pure ASCII texts take the fast built-in."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def word_count(text: Column) -> Column:
    """Number of words as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def holdout(key: Column, parts: int, held: int) -> Column:
    """Whether ``crc32(key as text) mod parts`` is ``held``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts == held

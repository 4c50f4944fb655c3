"""Public variant lists: numbered lines of split files and archives, membership, position search.

A list is one file, or a directory whose files follow each other by name. Lines are counted per file
split first; a line's number is the number of lines in the splits before its own plus its place in
it, so a list is numbered by as many tasks as read it and no line is shuffled for it.
"""

from __future__ import annotations

import gzip
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Lines of an archive member that are handed on at once.
MEMBER_LINES = 10_000
#: Rows of split counts that are sent to all tasks; a split has many megabytes.
BROADCAST_SPLITS = 1_000_000


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, value`` of plain or gzip text under ``path``, numbered from 1 over all its files.

    Lines end at a line feed; a carriage return before it is dropped.
    """
    text = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"), F.rtrim("value", F.lit("\r")).alias("value"),
    )
    # Rows of a split follow each other inside one task, so their ids count up without gaps.
    splits = text.groupBy("_path", "_block").agg(F.count(F.lit(1)).alias("_lines"), F.min("_row").alias("_first"))
    before = F.sum("_lines").over(W.orderBy("_path", "_block").rowsBetween(W.unboundedPreceding, -1))
    starts = splits.select("_path", "_block", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    small = starts.limit(BROADCAST_SPLITS + 1).count() <= BROADCAST_SPLITS
    joined = text.join(F.broadcast(starts) if small else starts, ["_path", "_block"], "left")
    missed = F.raise_error(F.lit("the list was split in another way while it was read")).cast("long")
    line = F.coalesce(F.col("_before") + F.col("_row") - F.col("_first") + 1, missed)
    return joined.select(F.element_at(F.split("_path", "/"), -1).alias("file"), line.alias("line"), "value")


def archives(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of the zip files under ``path``, one to a task.

    An archive's compressed bytes are in memory while it is read; Spark refuses files beyond
    ``spark.sql.sources.binaryFile.maxLength`` (2 GB at most).
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.repartition(max(1, len(files.inputFiles())), "path")


def archive_lines(files: DataFrame, first_member: bool = False) -> DataFrame:
    """``file, member, line, value`` of zip files (``path, content``), unpacked as a stream in the tasks.

    Lines are numbered within a member. A member ending in ``.gz`` is unpacked too; folders and the
    resource forks of archives packed on macOS are left out. ``first_member``: only the first of the rest.
    """

    def lines_of(member: io.BufferedIOBase) -> Iterator[list[str]]:
        some: list[str] = []
        for line in member:
            some.append(line.decode("utf-8", "replace").rstrip("\r\n"))
            if len(some) == MEMBER_LINES:
                yield some
                some = []
        if some:
            yield some

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_buffer())) as archive:
                    names = [n for n in archive.namelist() if not n.endswith("/") and not n.startswith("__MACOSX")]
                    for name in names[:1] if first_member else names:
                        with archive.open(name) as packed:
                            member = gzip.GzipFile(fileobj=packed) if name.lower().endswith(".gz") else packed
                            at = 1
                            for some in lines_of(member):
                                size = len(some)
                                yield pa.RecordBatch.from_arrays(
                                    [pa.array([path.split("/")[-1]] * size), pa.array([name] * size), pa.array(range(at, at + size)), pa.array(some, pa.string())],
                                    names=["file", "member", "line", "value"],
                                )
                                at += size

    rows = files.select("path", "content")
    return rows.mapInArrow(unpack, "file string, member string, line long, value string")


def list_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, member, line, value`` of a list that is plain, gzip or zip by its name."""
    if path.lower().endswith(".zip"):
        return archive_lines(archives(spark, path))
    lines = numbered_lines(spark, path)
    return lines.select("file", F.col("file").alias("member"), "line", "value")


def list_entries(lines: DataFrame, cpra_column: str, flag_column: str) -> DataFrame:
    """``cpra, flag, line`` of comma-separated lines; the columns are found by the names in line 1.

    Fields are not quoted. Lines with too few fields are left out.
    """
    header = lines.filter(F.col("line") == 1).select(F.split(F.trim("value"), ",").alias("names")).limit(2).collect()
    if len(header) != 1:
        raise ValueError("a list has one first line")
    places = []
    for name in (cpra_column, flag_column):
        if name not in header[0].names:
            raise ValueError(f"the list has no column {name}")
        places.append(header[0].names.index(name))
    fields = F.split("value", ",")
    rows = lines.filter((F.col("line") > 1) & (F.size(fields) > max(places)))
    return rows.select(F.get(fields, F.lit(places[0])).alias("cpra"), F.get(fields, F.lit(places[1])).alias("flag"), "line")


def read_list(spark: SparkSession, path: str, cpra_column: str, flag_column: str) -> DataFrame:
    """The entries of a list file; of an archive those of its first member."""
    if path.lower().endswith(".zip"):
        lines = archive_lines(archives(spark, path), first_member=True)
    else:
        lines = numbered_lines(spark, path)
    return list_entries(lines, cpra_column, flag_column)


def list_hits(entries: DataFrame, targets: DataFrame, unreliable_word: str) -> DataFrame:
    """``cpra, flag, line, reliable`` of the wanted variants that a list holds.

    A list is read until all wanted variants were met, and a later entry replaces an earlier one. So
    the entry that counts is a variant's last one up to the line where the last of them is first met,
    or its last one of all where some are not in the list.
    """
    wanted = targets.select("cpra").distinct()
    met = entries.join(wanted, "cpra", "left_semi")
    found = met.groupBy("cpra").agg(F.min("line").alias("first"))
    state = found.agg(F.struct(F.count(F.lit(1)).alias("found"), F.max("first").alias("last"))).scalar()
    complete = state["found"] == wanted.agg(F.count(F.lit(1))).scalar()
    until = F.when(complete, state["last"])
    read = met.withColumn("_until", until).filter(F.col("_until").isNull() | (F.col("line") <= F.col("_until")))
    entry = F.max_by(F.struct("flag", "line"), "line").alias("entry")
    return read.groupBy("cpra").agg(entry).select("cpra", "entry.*").withColumn(
        "reliable", F.upper(F.trim(F.coalesce("flag", F.lit("")))) != unreliable_word.upper()
    )


def membership(
    targets: DataFrame, array_hits: DataFrame, imputed_hits: DataFrame, release: str
) -> DataFrame:
    """The identifiability table: presence in each list, reliability and evidence text."""

    def side(hits: DataFrame, mark: str) -> DataFrame:
        return hits.select("cpra", *[F.col(c).alias(f"{mark}_{c}") for c in ("flag", "line", "reliable")])

    joined = targets.join(side(array_hits, "a"), "cpra", "left").join(side(imputed_hits, "i"), "cpra", "left")

    def word(flag: Column) -> Column:
        return F.when(flag, "TRUE").otherwise("FALSE")

    def evidence(name: str, flag_name: str, mark: str) -> Column:
        present = F.concat(
            F.lit(f"{name} resource line "), F.col(f"{mark}_line").cast("string"),
            F.lit(f": exact CPRA present; {flag_name}="), F.coalesce(f"{mark}_flag", F.lit("")),
        )
        return F.when(F.col(f"{mark}_line").isNotNull(), present).otherwise(f"{name} resource: no exact CPRA hit")

    reliable = F.coalesce("a_reliable", F.lit(True)) & F.coalesce("i_reliable", F.lit(True))
    return joined.select(
        "cpra",
        word(F.col("a_line").isNotNull()).alias("on_array"),
        word(F.col("i_line").isNotNull()).alias("on_imputed"),
        word(reliable).alias("annotation_reliable"),
        F.lit(release).alias("source_release"),
        F.concat_ws("; ", evidence("array", "Inaccurate Call", "a"), evidence("imputed", "inaccurate.annotation", "i")).alias("evidence"),
    )


def position_search(lines: DataFrame, pos: str, exact_cpra: str | None = None) -> DataFrame:
    """Per file: lines holding the position text, and lines holding the exact variant."""
    hit = F.col("value").contains(pos)
    flat = F.translate("value", "\t,", "::")
    exact = hit & flat.contains(exact_cpra) if exact_cpra else F.lit(False)
    return lines.groupBy("file").agg(
        F.count_if(hit).alias("hits"), F.count_if(exact).alias("exact_hits")
    )


def position_sample(lines: DataFrame, pos: str, rows: int = 12) -> DataFrame:
    """The first lines of each file that hold the position (a top-k report)."""
    order = W.partitionBy("file").orderBy("member", "line")
    hits = lines.filter(F.col("value").contains(pos)).withColumn("_place", F.row_number().over(order))
    return hits.filter(F.col("_place") <= rows).select("file", "member", "line", "value")

"""The ordered root of a growing ledger from the roots of its complete subtrees.

A ledger of n entries splits into complete subtrees, one for each binary digit 1 of n. Their roots are
its *frontier*: at most 64 rows, whatever n. An append needs the frontier and the new leaves, never
the old ones: new nodes are paired level by level with the frontier's nodes to their left. The nodes
that old frontier nodes are paired with are kept as a *bridge*; with it, two frontiers alone show
that the later ledger holds the earlier one unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortgate.functions.digest import node_hash
from cohortgate.operators.ledger import FAN_IN_LEVELS, _dense
from cohortgate.sources.durable import written

BLOCK = 2 ** FAN_IN_LEVELS
NODE = "level int, hash string"


@dataclass(frozen=True)
class Frontier:
    """``peaks`` are (level, hash) of the complete subtrees of ``total`` entries, ``bridge`` those that
    the peaks before the last append were paired with."""

    total: int = 0
    peaks: tuple[tuple[int, str], ...] = ()
    bridge: tuple[tuple[int, str], ...] = ()

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [("peak", *node) for node in self.peaks] + [("bridge", *node) for node in self.bridge]
        frame = spark.createDataFrame(rows, f"kind string, {NODE}")
        return frame.select(F.lit(self.total).cast("long").alias("total"), "*")


def extended(frontier: Frontier, leaves: DataFrame, added: int) -> Frontier:
    """The frontier after ``added`` entries with ``leaves`` (seq, leaf), numbered on from its total.

    Rounds are as in a whole root: aligned blocks of 1,024 nodes, each folded by itself. Only the block
    in which the old ledger ended meets old peaks. Its new ones, and those of the last block, are what
    little comes back.
    """
    if added == 0:
        return Frontier(frontier.total, frontier.peaks)
    old = dict(frontier.peaks)
    level = leaves.select(F.col("seq").alias("i"), F.col("leaf").alias("h"))
    low, high, base = frontier.total, frontier.total + added, 0
    peaks, bridge = [], []
    climbing = False  # whether the first node of a level holds old and new entries
    while high > low:
        seam, last = low // BLOCK, (high - 1) // BLOCK
        grouped = level.groupBy(F.floor(F.col("i") / BLOCK).alias("i")).agg(
            F.sort_array(F.collect_list(F.struct("i", "h"))).alias("nodes")
        )
        # The seam block lacks the nodes of the old ledger; they are in the peaks.
        first = F.greatest(F.col("i") * BLOCK, F.lit(low))
        nodes = _dense(F.col("nodes"), first, F.least((F.col("i") + 1) * BLOCK, F.lit(high)))
        grouped = grouped.select("i", nodes.alias("l0"))
        for step in range(FAN_IN_LEVELS):
            name = f"l{step}"
            if base + step in old:
                mine = F.when(F.col("i") == seam, F.concat(F.array(F.lit(old[base + step])), name)).otherwise(F.col(name))
                grouped = grouped.withColumn(name, mine)
            grouped = grouped.withColumn(f"l{step + 1}", _pairs(F.col(name)))
        levels = [f"l{step}" for step in range(FAN_IN_LEVELS + 1)]
        grouped = written(grouped, "frontier-levels")
        ends = grouped.filter(F.col("i").isin(seam, last)).select(
            "i", *[F.struct(F.size(n).alias("size"), F.get(n, F.lit(1)).alias("second"), F.element_at(F.when(F.size(n) > 0, F.col(n)), -1).alias("end")).alias(n) for n in levels]
        )
        found = {row.i: row for row in ends.collect()}
        if {seam, last} - set(found):
            raise ValueError("entries are missing")
        for step in range(FAN_IN_LEVELS):
            seen, right = found[seam][f"l{step}"], found[last][f"l{step}"]
            held = base + step in old
            if held != climbing and seen.size > 1:
                bridge.append((base + step, seen.second))
            climbing = (held or climbing) and seen.size > 1
            if right.size % 2 == 1:
                peaks.append((base + step, right.end))
        level = grouped.filter(F.size(F.col(f"l{FAN_IN_LEVELS}")) == 1).select("i", F.get(F.col(f"l{FAN_IN_LEVELS}"), F.lit(0)).alias("h"))
        low, high, base = low // BLOCK, high // BLOCK, base + FAN_IN_LEVELS
    done = {lvl for lvl, _ in peaks}
    peaks += [(lvl, node) for lvl, node in frontier.peaks if lvl >= base and lvl not in done]
    return Frontier(frontier.total + added, tuple(sorted(peaks)), tuple(sorted(bridge)))


def save(frontier: Frontier, spark: SparkSession, path: str) -> None:
    """Add a state to the stored ones; its rows are one file, so it is there whole or not at all."""
    rows = frontier.frame(spark)
    rows.coalesce(1).write.mode("append").parquet(path)


def latest(spark: SparkSession, path: str) -> Frontier:
    """The stored frontier with the most entries."""
    states = spark.read.schema(f"total long, kind string, {NODE}").parquet(path)
    top = states.agg(F.max("total")).first()[0]
    rows = states.filter(F.col("total") == top).collect() if top is not None else []
    nodes = {kind: tuple(sorted((r.level, r.hash) for r in rows if r.kind == kind)) for kind in ("peak", "bridge")}
    return Frontier(top or 0, nodes["peak"], nodes["bridge"])


def _pairs(below: Column) -> Column:
    """Hashes of the complete pairs of a level; a last node without a partner is a peak."""
    pairs = F.transform(
        F.sequence(F.lit(1), F.floor(F.size(below) / 2).cast("int")),
        lambda k: node_hash(F.get(below, k * 2 - 2), F.get(below, k * 2 - 1)),
    )
    return F.when(F.size(below) >= 2, pairs).otherwise(F.array().cast("array<string>"))


def roots(states: DataFrame) -> DataFrame:
    """``total, root`` of frontiers: rows ``total, kind, level, hash``, one frontier for each total.

    From the lowest peak up, the right edge pairs with the peak to its left, or with itself where
    there is none on its level, until it stands alone.
    """
    levels = F.explode(F.sequence(F.lit(0), F.lit(62))).alias("level")
    peaks = states.filter("kind = 'peak'").select("total", "level", F.col("hash").alias("own"))
    grid = states.select("total").distinct().select("total", levels).join(peaks, ["total", "level"], "left")

    def up(node: Column, row: Column) -> Column:
        index = F.floor(F.col("total") / F.pow(F.lit(2), row["level"])).cast("long")
        met = F.when(index % 2 == 1, node_hash(row["own"], node)).when(index > 0, node_hash(node, node)).otherwise(node)
        lowest = F.when(index > 1, node_hash(row["own"], row["own"])).otherwise(row["own"])
        return F.when(node.isNotNull(), met).when(row["own"].isNotNull(), lowest)

    rows = F.array_sort(F.collect_list(F.struct("level", "own")))
    climbed = grid.groupBy("total").agg(F.aggregate(rows, F.lit(None).cast("string"), up).alias("node"))
    return climbed.select("total", F.coalesce("node", F.sha2(F.unhex(F.lit("01")), 256)).alias("root"))


def consistent(old: Frontier, new: Frontier, spark: SparkSession) -> DataFrame:
    """One row: whether ``new``, made by one append to ``old``, holds the old entries unchanged.

    The old peaks and the bridge give the one complete subtree, or the partial ones, in which the old
    entries end up; each must be a peak of the new frontier.
    """
    levels = spark.range(63).select(F.col("id").cast("int").alias("level"))

    def side(nodes: tuple[tuple[int, str], ...], name: str) -> DataFrame:
        return spark.createDataFrame(list(nodes), f"level int, {name} string")

    grid = levels.join(side(old.peaks, "own"), "level", "left").join(side(new.bridge, "other"), "level", "left")
    grid = grid.join(side(new.peaks, "peak"), "level", "left")
    rows = F.array_sort(F.collect_list(F.struct("level", "own", "other", "peak")))
    state = "struct<node:string,ok:boolean>"

    def up(end: Column, row: Column) -> Column:
        # Old entries are in an old peak of this level, in a node from the level below, or in both: a pair.
        mine = F.coalesce(row["own"], end["node"])
        partner = F.when(row["own"].isNotNull() & end["node"].isNotNull(), end["node"]).otherwise(row["other"])
        alone = mine.isNotNull() & partner.isNull()
        return F.struct(
            F.when(mine.isNotNull() & partner.isNotNull(), node_hash(mine, partner)).alias("node"),
            (end["ok"] & F.when(alone, mine.eqNullSafe(row["peak"])).otherwise(F.lit(True))).alias("ok"),
        )

    start = F.struct(F.lit(None).cast("string").alias("node"), F.lit(old.total <= new.total).alias("ok")).cast(state)
    return grid.agg(F.aggregate(rows, start, up).alias("end")).select(F.col("end.ok").alias("consistent"))

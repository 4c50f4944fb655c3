"""Hash-chained ledger: leaves, the ordered root, verification and run events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortgate.functions.digest import canonical_json, leaf_hash, node_hash
from cohortgate.sources.durable import written

FAN_IN_LEVELS = 10
# Event fields that are left out when null.
OPTIONAL_FIELDS = ("airlock",)


def event_json(events: DataFrame) -> Column:
    """Canonical JSON of an event row; ``seq`` orders the ledger and is not part of the event."""
    fields = {f.name: (F.col(f.name), f.dataType) for f in events.schema.fields if f.name != "seq"}
    return canonical_json(fields, OPTIONAL_FIELDS)


def event_leaves(events: DataFrame, json_text: Column) -> DataFrame:
    """(seq, leaf) for each event. ``seq`` counts 0, 1, 2 ... without gaps."""
    return events.select(F.col("seq").cast("long").alias("seq"), leaf_hash(json_text).alias("leaf"))


def _folded(nodes: Column, lone: bool) -> Column:
    """Up to ``FAN_IN_LEVELS`` pairwise levels over one block; an odd last node pairs with itself.

    A block that is alone stops at its root. A block among others is lifted the full number of
    levels, which is what the pairing over the whole level does to it.
    """

    def one_level(level: Column, _step: Column) -> Column:
        paired = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int")),
            lambda i: node_hash(
                F.get(level, i * 2), F.coalesce(F.get(level, i * 2 + 1), F.get(level, i * 2))
            ),
        )
        return F.when(F.size(level) == 1, level).otherwise(paired) if lone else paired

    return F.get(
        F.aggregate(F.sequence(F.lit(1), F.lit(FAN_IN_LEVELS)), nodes, one_level), F.lit(0)
    )


def _dense(nodes: Column, first: Column, total: int) -> Column:
    """Hashes of a block's nodes; a gap, a repeat or a missing node stops the job."""
    fault = F.raise_error(F.lit("ledger positions are not 0, 1, 2 ... without gaps or repeats")).cast("string")
    hashes = F.transform(nodes, lambda node, j: F.when(node["i"] == first + j, node["h"]).otherwise(fault))
    full = F.size(nodes) == F.least(F.lit(2 ** FAN_IN_LEVELS), F.lit(total) - first)
    return F.when(full, hashes).otherwise(F.array(fault))


def hash_root(leaves: DataFrame, total: int) -> DataFrame:
    """One row ``root`` over ``total`` ordered leaves (seq, leaf).

    Pairing is by position, so aligned blocks of 1,024 leaves can be folded apart from each
    other: every round is one shuffle with map-side independence, groups are bounded by 1,024,
    and a trillion leaves need four rounds.
    """
    block = 2 ** FAN_IN_LEVELS
    level = leaves.select(F.col("seq").alias("i"), F.col("leaf").alias("h"))
    remaining = total
    while remaining > 1:
        lone = remaining <= block
        grouped = level.groupBy(F.floor(F.col("i") / block).alias("i")).agg(
            F.sort_array(F.collect_list(F.struct("i", "h"))).alias("nodes")
        )
        level = grouped.select("i", _folded(_dense(F.col("nodes"), F.col("i") * block, remaining), lone).alias("h"))
        remaining = -(-remaining // block)
    if total == 0:
        return leaves.sparkSession.range(1).select(
            F.sha2(F.unhex(F.lit("01")), 256).alias("root")
        )
    return level.select(F.col("h").alias("root"))


def sequence_faults(events: DataFrame) -> DataFrame:
    """One row: whether ``seq`` is 0..n-1 without gaps or repeats."""
    return events.agg(
        F.count(F.lit(1)).alias("events"),
        F.coalesce(
            (F.min("seq") == 0)
            & (F.max("seq") == F.count(F.lit(1)) - 1)
            & (F.count_distinct("seq") == F.count(F.lit(1))),
            F.lit(True),
        ).alias("dense"),
    )


def verify_root(leaves: DataFrame, total: int, expected_root: str) -> DataFrame:
    return hash_root(leaves, total).select(
        "root", (F.col("root") == expected_root).alias("verified")
    )


def lost_or_changed(old_leaves: DataFrame, new_leaves: DataFrame) -> DataFrame:
    """Old entries that the new ledger no longer has at the same place; empty means append-only."""
    return old_leaves.join(new_leaves, ["seq", "leaf"], "left_anti")


def _full_pairs(below: Column) -> Column:
    """Hashes of the complete pairs of a level; a last node without a partner is left out."""
    pairs = F.transform(
        F.sequence(F.lit(1), F.floor(F.size(below) / 2).cast("int")),
        lambda k: node_hash(F.get(below, k * 2 - 2), F.get(below, k * 2 - 1)),
    )
    return F.when(F.size(below) >= 2, pairs).otherwise(F.array().cast("array<string>"))


def _numbered(hashes: Column, level: int, first: Column) -> Column:
    return F.transform(
        hashes,
        lambda h, j: F.struct(
            F.lit(level).alias("level"), (first + j).cast("long").alias("idx"), h.alias("hash")
        ),
    )


def full_nodes(leaves: DataFrame, total: int) -> DataFrame:
    """(level, idx, hash) of every node whose subtree is complete, for prefix roots.

    A block of 1,024 nodes gives its ten levels at once; only roots of whole blocks go on to the
    next round, so a round is one shuffle and there are log1024(n) of them.
    """
    block = 2 ** FAN_IN_LEVELS
    level = leaves.select(F.col("seq").alias("i"), F.col("leaf").alias("h"))
    found, base, remaining = None, 0, total
    while remaining > 0:
        grouped = level.groupBy(F.floor(F.col("i") / block).alias("i")).agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("i", "h"))), lambda node: node["h"]
            ).alias("l0")
        )
        for step in range(1, FAN_IN_LEVELS + 1):
            grouped = grouped.withColumn(f"l{step}", _full_pairs(F.col(f"l{step - 1}")))
        # The top level of a round is level 0 of the next one.
        listed = F.flatten(F.array(*[
            _numbered(F.col(f"l{step}"), base + step, F.col("i") * 2 ** (FAN_IN_LEVELS - step))
            for step in range(FAN_IN_LEVELS)
        ]))
        nodes = grouped.select(F.inline(listed))
        found = nodes if found is None else found.unionByName(nodes)
        # A whole block is told by its leaf count: a filter on a computed level would be pushed
        # through all ten of them.
        level = grouped.filter(F.size("l0") == block).select(
            "i", F.get(F.col(f"l{FAN_IN_LEVELS}"), F.lit(0)).alias("h")
        )
        base += FAN_IN_LEVELS
        remaining //= block
    return found


def _walked(acc: Column, index: Column, left: Column) -> Column:
    """One level up for the last node of a prefix: it pairs with its left neighbour, or with itself
    where it has none on its own side; a node at place 0 is the root already."""
    return F.when(index % 2 == 1, node_hash(left, acc)).when(index > 0, node_hash(acc, acc)).otherwise(acc)


def _paths(blocks: DataFrame, total: int) -> DataFrame:
    """(block, path): what the last node of a prefix meets above its block, from the bottom up."""
    complete = blocks.filter(F.size(F.col(f"l{FAN_IN_LEVELS}")) == 1)
    roots = complete.select(F.col("block").alias("seq"), F.get(F.col(f"l{FAN_IN_LEVELS}"), F.lit(0)).alias("leaf"))
    count = -(-total // 2 ** FAN_IN_LEVELS)
    steps = blocks.select(
        "block", F.explode(F.sequence(F.lit(0), F.lit(max(count - 1, 1).bit_length()))).alias("level")
    ).withColumn("index", F.floor(F.col("block") / F.pow(F.lit(2), F.col("level"))))
    steps = steps.filter(F.col("index") > 0).withColumn("idx", F.when(F.col("index") % 2 == 1, F.col("index") - 1))
    met = steps.join(full_nodes(roots, total // 2 ** FAN_IN_LEVELS), ["level", "idx"], "left")
    return met.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("level", "index", "hash"))).alias("path"))


def parent_roots(leaves: DataFrame, total: int) -> DataFrame:
    """(seq, parent_root): the root over all earlier events, for every event at once.

    Leaves are shuffled once, into aligned blocks of 1,024 whose nodes are hashed once and written.
    A prefix ends in one block; below, it meets nodes of that block only, and above, the few nodes
    of its block's path, which n / 1,024 block roots give. Every row that moves is a leaf or a
    block, and no node is looked up by more than its neighbours.
    """
    size = 2 ** FAN_IN_LEVELS
    blocks = leaves.groupBy(F.floor(F.col("seq") / size).alias("block")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("seq", "leaf"))), lambda node: node["leaf"]).alias("l0")
    )
    for step in range(1, FAN_IN_LEVELS + 1):
        blocks = blocks.withColumn(f"l{step}", _full_pairs(F.col(f"l{step - 1}")))
    levels = F.array(*[F.struct(F.lit(step).alias("level"), F.col(f"l{step}").alias("nodes")) for step in range(FAN_IN_LEVELS)])
    blocks = written(blocks.select("block", "l0", f"l{FAN_IN_LEVELS}", levels.alias("levels")), "ledger-blocks")
    none = F.array().cast("array<struct<level:int,index:bigint,hash:string>>")
    joined = blocks.withColumn("path", none)
    if total > size:
        joined = blocks.join(_paths(blocks, total), "block", "left")
    path = F.coalesce("path", none)

    def root(leaf: Column, place: Column) -> Column:
        def within(acc: Column, row: Column) -> Column:
            here = F.floor(place / F.pow(F.lit(2), row["level"])).cast("int")
            index = F.when(F.col("block") > 0, size + here).otherwise(here)  # only its parity and whether it is 0 matter
            return _walked(acc, index, F.get(row["nodes"], here - 1))

        inside = F.aggregate(F.col("levels"), leaf, within)
        return F.aggregate(path, inside, lambda acc, up: _walked(acc, up["index"], up["hash"]))

    roots = joined.select("block", F.posexplode(F.transform("l0", root)).alias("place", "parent_root"))
    seq = (F.col("block") * size + F.col("place") + 1).alias("seq")
    empty = leaves.filter(F.col("seq") == 0).select("seq", F.sha2(F.unhex(F.lit("01")), 256).alias("parent_root"))
    return roots.select(seq, "parent_root").filter(F.col("seq") < total).unionByName(empty)


def broken_chain(events: DataFrame, leaves: DataFrame, total: int) -> DataFrame:
    """Events whose recorded parent root is not the root of the events before them."""
    expected = parent_roots(leaves, total).withColumnRenamed("parent_root", "expected_root")
    return events.select("seq", "parent_root").join(expected, "seq").filter(
        ~F.col("parent_root").eqNullSafe(F.col("expected_root"))
    )


def run_events(
    runs: DataFrame, seq: Column, parent_root: Column, git_commit: str, actor_type: str = "workflow"
) -> DataFrame:
    """Ledger rows: digests and disclosure metadata only.

    ``runs`` is (request_id, cpra, timestamp, config_sha256, input_sha256, output_sha256, sdc,
    airlock) with the digests as maps.
    """
    return runs.select(
        seq.cast("long").alias("seq"), "request_id", "cpra", F.lit(actor_type).alias("actor_type"),
        "timestamp", F.lit(git_commit).alias("git_commit"), "config_sha256", "input_sha256",
        "output_sha256", "sdc", parent_root.alias("parent_root"), "airlock",
    )

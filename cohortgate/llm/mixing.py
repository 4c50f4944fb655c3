"""Mixing sources to target weights: whole repetitions plus one hash-seeded Bernoulli copy.

Tokens are words. One narrow scan gives each document's size and text digest, written once; one
partial aggregation gives tokens per source, a window over the per-source table fills the targets,
and each document is repeated floor(rate) times plus once more with the probability of the fraction.
The draw is a hash of id, text digest and seed, so documents without an id, or with one id, are drawn
apart. Rows that agree in id, text and source are one document that stands n times: together they
take n times the rate, rounded by one draw, which any number of tasks settles alike. Everything is
DataFrame operations.

Defined results: null text has size 0; null sources form one source, ordered last; a source of
size 0 has target 0 and is not taken; an empty table gives an empty result; ties of the draw do not
matter, since it is compared with the rate alone; a very long text is one row with its size. Other
columns of the input are not changed; of rows that are one document the mix repeats one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortgate.llm.tables import kept, small_enough, word_count


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), limit: int = 3
) -> DataFrame:
    """``source, source_size, weight, target`` from rows of ``source, size``.

    Sources in code point order take the weights in turn and share the sum of all sizes. A target
    stops at ``limit`` times its source's size; the rest is shared again by weight. With sources
    sorted by cap per weight the capped ones are a prefix, so one pass of running sums finds the
    level at which the others stand.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    by_ratio = W.orderBy("ratio", "place")
    everything = W.partitionBy()
    levelled = (
        per_source.withColumn("place", place)
        .withColumn("weight", turn.cast("long"))
        .withColumn("cap", F.col("source_size") * limit)
        .withColumn("ratio", F.col("cap").cast("double") / F.col("weight").cast("double"))
        .withColumn("capped_before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", (F.col("total") - F.col("capped_before")).cast("double") / F.col("weight_left").cast("double"))
        .withColumn("turn", F.row_number().over(by_ratio))
    )
    level = F.min_by("level", F.when(F.col("level") <= F.col("ratio"), F.col("turn"))).over(everything)
    share = level * F.col("weight").cast("double")
    return levelled.select(
        "source", "source_size", "weight", F.least(F.col("cap").cast("double"), share).alias("target")
    )


def draw(key: Column, digest: Column, seed: int) -> Column:
    """Uniform in [0, 1) from a digest of the id, the text's digest and the seed."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.lower(F.hex(digest)), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def text_digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, source, digest, size, n``: every document with the number of its rows; written once."""
    rows = docs.select("doc_id", "source", text_digest(F.col("text")).alias("digest"), word_count(F.col("text")).alias("size"))
    return kept(rows.groupBy("doc_id", "source", "digest", "size").agg(F.count(F.lit(1)).alias("n")), "mix-rows")


def targets_of(prints: DataFrame, weights: Sequence[int], limit: int) -> DataFrame:
    """Targets of all sources as the struct ``__t``, sent to all tasks where they are small."""
    sizes = kept(prints.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size")), "mix-sizes")
    targets = kept(source_targets(sizes, weights, limit), "mix-targets").select(F.struct("*").alias("__t"))
    small = small_enough(targets, F.coalesce(F.octet_length("__t.source"), F.lit(0)) + 64)
    return F.broadcast(targets) if small else targets


def _rate() -> Column:
    size = F.col("__t.source_size")
    return F.when(size > 0, F.col("__t.target") / size.cast("double")).otherwise(0.0)


def _taken(n: Column, key: Column, digest: Column, seed: int) -> tuple[Column, Column]:
    """Copies that each of ``n`` rows takes, and how many of the rows take one more."""
    rate = _rate()
    part = n.cast("double") * (rate - F.floor(rate))
    more = F.floor(part) + (draw(key, digest, seed) < part - F.floor(part)).cast("long")
    return F.floor(rate), more


def copies(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), limit: int = 3, seed: int = 7) -> DataFrame:
    """``doc_id, source`` of every row with the struct ``__mix`` (size, source_size, target, copies)."""
    prints = fingerprints(docs)
    joined = prints.join(targets_of(prints, weights, limit), prints["source"].eqNullSafe(F.col("__t.source")), "left")
    each, more = _taken(F.col("n"), F.col("doc_id"), F.col("digest"), seed)
    turns = joined.withColumns({"__each": each, "__more": more}).withColumn("__turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    mix = F.struct(
        "size", F.col("__t.source_size").alias("source_size"), F.col("__t.target").alias("target"),
        (F.col("__each") + (F.col("__turn") <= F.col("__more")).cast("long")).alias("copies"),
    )
    return turns.select("doc_id", "source", mix.alias("__mix"))


def mixed(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), limit: int = 3, seed: int = 7) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as it is taken.

    Texts are not shuffled but those of documents that stand more than once.
    """
    prints = fingerprints(docs)
    rows = docs.withColumn("__digest", text_digest(F.col("text")))
    again = kept(prints.filter("n > 1").select(F.struct("doc_id", "source", "digest", "n").alias("__r")), "mix-again")
    if again.isEmpty():
        rows = rows.withColumn("__n", F.lit(1).cast("long"))
    else:
        same = F.col("__digest") == F.col("__r.digest")
        for name in ("doc_id", "source"):
            same = same & docs[name].eqNullSafe(F.col(f"__r.{name}"))
        marked = rows.join(F.broadcast(again) if small_enough(again) else again, same, "left")
        marked = marked.withColumn("__n", F.coalesce("__r.n", F.lit(1).cast("long"))).drop("__r")
        rows = marked.filter("__n = 1").unionByName(marked.filter("__n > 1").dropDuplicates(["doc_id", "source", "__digest"]))
    joined = rows.join(targets_of(prints, weights, limit), rows["source"].eqNullSafe(F.col("__t.source")), "left")
    each, more = _taken(F.col("__n"), F.col("doc_id"), F.col("__digest"), seed)
    counted = joined.withColumn("__copies", F.col("__n") * each + more).filter(F.col("__copies") > 0)
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))
    return counted.select(*[F.col(f"`{c}`") for c in docs.columns], times.alias("__turn")).drop("__turn")

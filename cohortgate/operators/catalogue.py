"""Gene and panel catalogue: integrity checks, and resolution to variant requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortgate.operators import sizing

POSITION_BIN = 250_000
#: Pairs of a locus and a span on its bin that one task compares.
TASK_PAIRS = 2_000_000


def symbol_key(symbol: Column) -> Column:
    return F.upper(F.trim(symbol))


def panel_key(panel: Column) -> Column:
    return F.lower(F.trim(panel))


def unknown_references(bridge: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Bridge rows naming something the target table does not hold."""
    return bridge.join(target.select(key), key, "left_anti")


def invalid_spans(genes: DataFrame) -> DataFrame:
    return genes.filter((F.col("start") < 1) | (F.col("end") < F.col("start")))


def outside_gene_span(variants: DataFrame, genes: DataFrame, gene_variants: DataFrame) -> DataFrame:
    """Listed gene members that do not lie inside their gene: two equi-joins, then a filter."""
    placed = gene_variants.join(sizing.broadcast_within(variants, variants), "variant_id").join(
        genes.select("symbol", F.col("chrom").alias("g_chrom"), "start", "end"), "symbol"
    )
    inside = (F.col("chrom") == F.col("g_chrom")) & F.col("pos").between(F.col("start"), F.col("end"))
    return placed.filter(~F.coalesce(inside, F.lit(False)))


def containing_spans(
    loci: DataFrame, spans: DataFrame, bin_size: int = POSITION_BIN, task_pairs: int = TASK_PAIRS
) -> DataFrame:
    """Interval join: each locus with every span on its contig that holds its position.

    Spans are copied to each position bin they touch, so the join is an equi-join on
    the bin and a span of any length meets a locus exactly once. A few megabytes of loci and
    spans can make millions of pairs, so tasks are dealt by the pairs of the bins, which are counted
    first, and not by the bytes that come in.
    """

    def bin_of(number: Column) -> Column:
        return F.concat("chrom", F.lit(":"), number.cast("string"))

    touched = F.sequence(F.floor(F.col("start") / bin_size), F.floor(F.col("end") / bin_size))
    binned = spans.withColumn("_bin", F.explode(touched)).withColumn("_bin", bin_of(F.col("_bin"))).drop("chrom")
    keyed = loci.withColumn("_bin", bin_of(F.floor(F.col("pos") / bin_size)))
    per_bin = [rows.groupBy("_bin").agg(F.count(F.lit(1)).alias(name)) for rows, name in ((keyed, "n"), (binned, "m"))]
    pairs = per_bin[0].join(sizing.shuffled(per_bin[1]), "_bin").agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    if pairs > task_pairs:
        tasks = 1 + pairs // task_pairs
        keyed, binned = keyed.repartition(tasks, "_bin"), sizing.shuffled(binned.repartition(tasks, "_bin"))
    joined = keyed.join(binned, "_bin")
    return joined.filter(F.col("pos").between(F.col("start"), F.col("end"))).drop("_bin")


def _as_requests(members: DataFrame, variants: DataFrame) -> DataFrame:
    """Catalogue variants in request form, with the catalogue's fixed build and definition."""
    return members.join(sizing.broadcast_within(variants, variants), "variant_id").withColumns({
        "build": F.lit("GRCh38"),
        "carrier_definition": F.lit("het_and_homalt"),
    })


def resolve_genes(requests: DataFrame, gene_variants: DataFrame, variants: DataFrame) -> DataFrame:
    """Gene requests (request_id, symbol, ...) to one row per member variant."""
    bridge = gene_variants.withColumn("symbol", symbol_key(F.col("symbol")))
    wanted = requests.withColumn("symbol", symbol_key(F.col("symbol")))
    return _as_requests(wanted.join(bridge, "symbol"), variants)


def resolve_panels(
    requests: DataFrame, panel_genes: DataFrame, gene_variants: DataFrame, variants: DataFrame
) -> DataFrame:
    """Panel requests to one row per distinct variant, ordered by its first occurrence.

    ``panel_genes`` and ``gene_variants`` carry ``ordinal``: the place in the listed order.
    """
    genes = panel_genes.select(
        panel_key(F.col("panel")).alias("panel"), symbol_key(F.col("symbol")).alias("symbol"),
        F.col("ordinal").alias("gene_ordinal"),
    )
    members = gene_variants.select(
        symbol_key(F.col("symbol")).alias("symbol"), "variant_id",
        F.col("ordinal").alias("variant_ordinal"),
    )
    first_seen = (
        genes.join(members, "symbol")
        .groupBy("panel", "variant_id")
        .agg(F.min(F.struct("gene_ordinal", "variant_ordinal")).alias("place"))
        .select("panel", "variant_id", "place.gene_ordinal", "place.variant_ordinal")
    )
    wanted = requests.withColumn("panel", panel_key(F.col("panel")))
    return _as_requests(wanted.join(first_seen, "panel"), variants)


def unknown_names(requests: DataFrame, catalogue: DataFrame, key: str, normalise) -> DataFrame:
    """Requests for a gene or panel the catalogue does not hold."""
    known = catalogue.select(normalise(F.col(key)).alias(key)).distinct()
    return requests.withColumn(key, normalise(F.col(key))).join(known, key, "left_anti")


def region_of(loci: DataFrame, regions: DataFrame, bin_size: int = POSITION_BIN) -> DataFrame:
    """Locus to region file, left join: a locus in no region keeps a null region."""
    found = containing_spans(
        loci.select("cpra", "chrom", "pos").distinct(), regions, bin_size
    ).select("cpra", "region")
    return loci.join(found, "cpra", "left")


def region_spans(manifest: DataFrame, code: str, margin: int = 1000) -> DataFrame:
    """One span per contig, widened by ``margin`` and never below zero."""
    return manifest.groupBy("chrom").agg(
        F.greatest(F.lit(0), F.min(F.col("pos").cast("long")) - margin).alias("start"),
        (F.max(F.col("pos").cast("long")) + margin).alias("end"),
    ).withColumn("region", F.lit(code))

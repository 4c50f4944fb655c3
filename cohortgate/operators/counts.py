"""Counts over classified evidence. Every count here is one partial-then-final aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortgate.fixed_values import MISSING_GT, UNKNOWN_ANCESTRY
from cohortgate.functions import coerce
from cohortgate.operators import sizing
from cohortgate.operators.evidence import EVALUATION_KEY
from cohortgate.policy import AnalysisPolicy, Scenario
from cohortgate.sources.durable import written

PARTICIPANT_GATES = ["consent_ok", "sex_check_ok", "kinship_ok"]
VARIANT_GATES = [
    "on_array", "on_imputed", "annotation_reliable", "array_source_allowed",
    "imputed_source_allowed", "dr2_ok",
]
CALL_GATES = [
    "has_array_gt", "call_rate_ok", "gq_ok", "has_imputed_dosage", "max_gp_ok", "dosage_ok",
    "array_credible", "imputed_credible", "included_by_configured_gates",
]


def ancestry_stratum(ancestry: Column) -> Column:
    """Missing or blank ancestry is a stratum of its own and never a dropped key."""
    return F.coalesce(F.nullif(F.trim(ancestry), F.lit("")), F.lit(UNKNOWN_ANCESTRY))


def cell_aggregates() -> list[Column]:
    """The five cells from decisions."""
    included = F.col("decision") == "included"
    return [
        F.count_if(included & (F.col("confidence") == "high")).alias("high_confidence"),
        F.count_if(included & (F.col("confidence") == "conditional")).alias("conditional"),
        F.count_if(included).alias("total"),
        F.count_if(F.col("decision") == "excluded").alias("excluded"),
        F.count_if(included & (F.col("flags") != "")).alias("flagged"),
    ]


def count_cells(classified: DataFrame, keys: list[str] = EVALUATION_KEY) -> DataFrame:
    return classified.groupBy(*keys).agg(*cell_aggregates())


#: Columns of stored evidence that are read back as booleans by the projection's own rule.
STAGED_FLAGS = ["array_source_allowed", "imputed_source_allowed", "annotation_reliable", "consent_ok"]


def staged_evidence(stored: DataFrame) -> DataFrame:
    """Classified rows read back from text storage: flags as booleans again, so that
    :func:`project_cells` can run over them. Missing source flags fall back to membership."""
    return stored.withColumns({
        "array_source_allowed": coerce.projection_bool(F.col("array_source_allowed"), F.col("on_array")),
        "imputed_source_allowed": coerce.projection_bool(
            F.col("imputed_source_allowed"), F.col("on_imputed")
        ),
        "annotation_reliable": coerce.projection_bool(F.col("annotation_reliable"), True),
        "consent_ok": coerce.holds(F.col("consent_status") == "consented"),
    })


def projection(policy: AnalysisPolicy, scenario: Scenario) -> dict[str, Column]:
    """``included`` and ``high`` recomputed from retained evidence under other thresholds."""
    info = F.col("variant_info")
    array_ok = (
        F.col("array_source_allowed") & F.col("annotation_reliable") & F.col("has_array_gt")
        & coerce.holds(F.col("array_call_rate") >= scenario.value("array_call_rate_min", policy))
        & coerce.holds(F.col("array_gq") >= scenario.value("array_gq_min", policy))
    )
    imputed_ok = (
        F.col("imputed_source_allowed") & F.col("annotation_reliable") & F.col("has_imputed_dosage")
        & coerce.holds(info >= scenario.value("imputed_dr2_min", policy))
        & coerce.holds(F.col("imputed_max_gp") >= scenario.value("imputed_max_gp_min", policy))
    )
    by_array = F.col("array_alt") & array_ok
    by_imputed = F.col("dosage_ok") & imputed_ok
    high_info = coerce.holds(info >= scenario.value("imputed_dr2_high_confidence", policy))
    return {
        "included": F.col("consent_ok") & (by_array | by_imputed),
        "high": by_array | (by_imputed & high_info),
    }


def project_cells(
    classified: DataFrame, policy: AnalysisPolicy, scenarios: list[Scenario],
    keys: list[str] = EVALUATION_KEY,
) -> DataFrame:
    """The five cells under each scenario, one row per (key, scenario).

    All scenarios are counted in the same pass as extra aggregates, so the classified rows are
    neither copied per scenario nor read again.
    """
    aggregates = []
    for scenario in scenarios:
        rule = projection(policy, scenario)
        included, high = rule["included"], rule["high"]
        aggregates.append(F.struct(
            F.lit(scenario.name).alias("scenario"),
            F.count_if(included & high).alias("high_confidence"),
            F.count_if(included & ~high).alias("conditional"),
            F.count_if(included).alias("total"),
            F.count_if(~included).alias("excluded"),
            F.count_if(included & (F.col("flags") != "")).alias("flagged"),
        ))
    wide = classified.groupBy(*keys).agg(F.array(*aggregates).alias("_rows"))
    return wide.select(*keys, F.inline("_rows"))


def count_by_ancestry(classified: DataFrame, keys: list[str] = EVALUATION_KEY) -> DataFrame:
    return (
        classified.filter(F.col("decision") == "included")
        .groupBy(*keys, ancestry_stratum(F.col("ancestry_stub")).alias("stratum"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def hardcall_counts(values: DataFrame, mask: Column, keys: list[str] = EVALUATION_KEY) -> DataFrame:
    """Carriers over masked hard calls: het, hom-alt, and their sum or het alone."""
    gt = F.col("gt_value")
    het = F.count_if(mask & (gt == 1))
    homalt = F.count_if(mask & (gt == 2))
    counted = values.groupBy(*keys).agg(het.alias("n_het"), homalt.alias("n_homalt"))
    return counted.withColumn(
        "n_carrier",
        F.when(F.col("carrier_definition") == "het_only", F.col("n_het"))
        .otherwise(F.col("n_het") + F.col("n_homalt")),
    )


def reconciliation(gated: DataFrame, keys: list[str] = EVALUATION_KEY) -> DataFrame:
    """Hard-call carriers against rows classified array_direct, both in one pass."""
    gt = F.coalesce("array_gt_code", F.lit(float(MISSING_GT))).cast("tinyint")
    mask = F.col("array_credible") & F.col("consent_ok")
    het_only = F.col("carrier_definition") == "het_only"
    kernel = mask & ((gt == 1) | (~het_only & (gt == 2)))
    direct = F.col("included_by_configured_gates") & F.col("array_alt") & F.col("array_credible")
    return gated.groupBy(*keys).agg(
        F.count_if(kernel).alias("hardcall_carriers"),
        F.count_if(direct).alias("array_direct_carriers"),
    ).withColumn("agrees", F.col("hardcall_carriers") == F.col("array_direct_carriers"))


def assert_reconciled(reconciled: DataFrame) -> DataFrame:
    """Strict form: any disagreement stops the job that reads the result."""
    return reconciled.withColumn(
        "agrees",
        F.when(F.col("agrees"), True).otherwise(
            F.raise_error(F.lit("array-direct carrier count diverged from classified rows"))
            .cast("boolean")
        ),
    )


def participant_totals(subjects: DataFrame) -> DataFrame:
    """One row: cohort size, participant gates, missing self-reports and related samples."""
    return subjects.agg(
        F.count(F.lit(1)).alias("n_participants"),
        *[F.count_if(F.col(gate)).alias(f"all_{gate}") for gate in PARTICIPANT_GATES],
        F.count_if(F.col("sex").isNull()).alias("missing_sex"),
        F.count_if(F.col("ancestry_stub").isNull()).alias("missing_ancestry"),
        F.count_if(~F.col("kinship_ok")).alias("n_related"),
    )


def gate_pass_counts(
    gated: DataFrame, evaluations: DataFrame, subjects: DataFrame, policy: AnalysisPolicy
) -> DataFrame:
    """Passing rows per gate over the whole cohort, one row per (evaluation, gate).

    Call gates are false without a call, so they are counted over evidence rows. Participant
    gates do not depend on the variant and are counted once. Variant gates hold for all
    participants or for none. Together they equal a count over evaluations times participants
    without ever building that product.
    """
    called = gated.groupBy(*EVALUATION_KEY).agg(
        *[F.count_if(F.col(gate)).alias(gate) for gate in CALL_GATES]
    )
    # One subquery gives all cohort-wide counts.
    totals = participant_totals(subjects).select(
        F.struct("n_participants", *[f"all_{gate}" for gate in PARTICIPANT_GATES])
    ).scalar()
    per_evaluation = evaluations.select(
        *EVALUATION_KEY,
        F.col("variant_on_array").alias("on_array"),
        F.col("variant_on_imputed").alias("on_imputed"),
        "annotation_reliable",
        F.col("use_array").alias("array_source_allowed"),
        F.col("use_imputed").alias("imputed_source_allowed"),
        coerce.holds(F.col("variant_info") >= policy.imputed_dr2_min).alias("dr2_ok"),
    ).join(called, EVALUATION_KEY, "left").withColumn("_totals", totals).withColumns({
        "total_rows": F.col("_totals.n_participants"),
        **{gate: F.col(f"_totals.all_{gate}") for gate in PARTICIPANT_GATES},
    })
    counted = [
        F.struct(
            F.lit(gate).alias("gate"),
            (F.when(F.col(gate), F.col("total_rows")).otherwise(F.lit(0)).cast("long")
             if gate in VARIANT_GATES else F.coalesce(F.col(gate), F.lit(0)).cast("long"))
            .alias("passing_rows"),
        )
        for gate in [*VARIANT_GATES, *CALL_GATES, *PARTICIPANT_GATES]
    ]
    return per_evaluation.select(
        *EVALUATION_KEY, "total_rows", F.inline(F.array(*counted))
    )


#: Participants of one bitmap word.
WORD_BITS = 64


def carrier_words(classified: DataFrame) -> DataFrame:
    """Included carriers of each evaluation as a bitmap: a row per 64-bit word that is not empty.

    ``participant_no`` numbers participants closely (see :func:`evidence.numbered`), so the words of a
    frequent variant are full and those of a rare one few. Bits are combined before the shuffle: up to
    64 carriers move as one row.
    """
    bit = F.expr(f"shiftleft(1L, CAST(participant_no % {WORD_BITS} AS INT))")
    word = F.expr("shiftright(participant_no, 6)").alias("word")  # 64 to a word
    included = classified.filter(F.col("decision") == "included")
    return included.groupBy(*EVALUATION_KEY, word).agg(F.bit_or(bit).alias("bits"))


#: Columns that name a set of carriers: a variant and the evaluations whose carriers are in it.
SET_KEY = ["cpra", "evaluated"]
#: Words from which a set is frequent.
FREQUENT_WORDS = 256


def batch_sets(members: DataFrame) -> DataFrame:
    """``batch_id, cpra, evaluated, ordinal``: the distinct variants of every batch.

    Evaluations of one variant under several sources are one set; ``evaluated`` lists them, so equal
    sets of different batches have the same name.
    """
    key = F.struct(*[name for name in EVALUATION_KEY if name != "cpra"])
    return members.groupBy("batch_id", "cpra").agg(
        F.sort_array(F.collect_set(key)).alias("evaluated"), F.min("ordinal").alias("ordinal")
    )


def set_words(words: DataFrame, sets: DataFrame) -> DataFrame:
    """``cpra, evaluated, word, bits``: bitmaps of the distinct sets, however many batches hold them."""
    named = sets.select(*SET_KEY).distinct().select(*SET_KEY, F.inline("evaluated"))
    return words.join(sizing.shuffled(named), EVALUATION_KEY).groupBy(*SET_KEY, "word").agg(F.bit_or("bits").alias("bits"))


def _once_and_twice(words: DataFrame, key: str, places: range) -> DataFrame:
    """``key, word, one, two``: participants in at least one, and at least two, of the sets of a key.

    ``rank`` numbers a key's sets from 0. Two of them differ in some binary place of their ranks. So a
    participant is in two sets exactly when, for some place, it is in one whose rank has a 0 there and
    in one whose rank has a 1: two disjunctions and a conjunction for each place, all plain aggregates.
    """

    def having(place: int, digit: int) -> Column:
        return F.bit_or(F.when(F.shiftright("rank", place).bitwiseAND(1) == digit, F.col("bits")))

    # A missing side is null and so is its conjunction, which counts no one.
    twice = [F.coalesce(having(place, 0).bitwiseAND(having(place, 1)), F.lit(0).cast("long")) for place in places]
    several = twice[0]
    for more in twice[1:]:
        several = several.bitwiseOR(more)
    return words.groupBy(key, "word").agg(F.bit_or("bits").alias("one"), several.alias("two"))


def batch_union(words: DataFrame, members: DataFrame, frequent_words: int = FREQUENT_WORDS) -> DataFrame:
    """Per batch: participants carrying at least one, and at least two, of its variants.

    ``words`` are :func:`carrier_words`, ``members`` is (batch_id, ordinal, evaluation key). Sets of up
    to ``frequent_words`` words are copied to their batches. The larger ones, which many batches hold,
    are not: batches that hold the same ones share a *mix*, whose counts are made once, and only the
    words that a batch's other carriers are in are looked up in it.
    """
    sets = written(batch_sets(members), "batch-sets")
    bits = written(set_words(words, sets), "set-words")
    frequent = bits.groupBy(*SET_KEY).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > frequent_words)
    marked = sets.join(sizing.shuffled(frequent.select(*SET_KEY, F.lit(True).alias("frequent"))), SET_KEY, "left")
    shape = written(marked.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("distinct_variants"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "cpra"))), lambda x: x["cpra"]), "+"
        ).alias("subject"),
        F.sort_array(F.collect_list(F.when(F.col("frequent"), F.struct(*SET_KEY)))).alias("held"),
    ).withColumn("mix", F.when(F.size("held") > 0, F.md5(F.to_json("held")))), "batch-shapes")
    most = shape.agg(F.max("distinct_variants")).first()[0] or 1
    places = range(max(1, (most - 1).bit_length()))

    mixes = shape.filter("mix IS NOT NULL").groupBy("mix").agg(F.any_value("held").alias("held"))
    of_mix = mixes.select("mix", F.posexplode("held").alias("rank", "_set")).select("mix", "rank", "_set.*")
    mixed = written(_once_and_twice(bits.join(sizing.shuffled(of_mix), SET_KEY), "mix", places), "mix-words")
    whole = mixed.groupBy("mix").agg(*[F.sum(F.bit_count(n)).alias(f"mix_{n}") for n in ("one", "two")])

    rank = F.dense_rank().over(W.partitionBy("batch_id").orderBy("cpra")) - 1
    rest = marked.filter("frequent IS NULL").select("batch_id", *SET_KEY, rank.alias("rank"))
    own = _once_and_twice(bits.join(sizing.shuffled(rest), SET_KEY), "batch_id", places)
    met = own.join(sizing.shuffled(shape.select("batch_id", "mix")), "batch_id").join(
        sizing.shuffled(mixed.withColumnsRenamed({"one": "m_one", "two": "m_two"})), ["mix", "word"], "left"
    )
    m_one, m_two = (F.coalesce(name, F.lit(0).cast("long")) for name in ("m_one", "m_two"))
    # What the batch's other sets add to the counts of its mix.
    twice = F.col("two").bitwiseOR(F.col("one").bitwiseAND(m_one))
    added = met.groupBy("batch_id").agg(
        F.sum(F.bit_count(F.col("one").bitwiseAND(F.bitwise_not(m_one)))).alias("more_one"),
        F.sum(F.bit_count(twice.bitwiseAND(F.bitwise_not(m_two)))).alias("more_two"),
    )
    zero = F.lit(0)
    return shape.join(sizing.shuffled(added), "batch_id", "left").join(sizing.shuffled(whole), "mix", "left").select(
        "batch_id", "distinct_variants", "subject",
        (F.coalesce("mix_one", zero) + F.coalesce("more_one", zero)).cast("long").alias("combined_carriers"),
        (F.coalesce("mix_two", zero) + F.coalesce("more_two", zero)).cast("long").alias("overlap_carriers"),
        (F.col("distinct_variants") > 1).alias("breakdown_suppressed"),
    )


def batch_variant_counts(words: DataFrame, members: DataFrame) -> DataFrame:
    """Included participants per (batch, variant); internal, never released beside the union.

    Sets are counted once, and their counts go to the batches.
    """
    sets = batch_sets(members)
    counted = set_words(words, sets).groupBy(*SET_KEY).agg(F.sum(F.bit_count("bits")).cast("long").alias("included"))
    return sets.join(sizing.shuffled(counted), SET_KEY).select("batch_id", "cpra", "included")


def shared_carriers(classified: DataFrame, left: str, right: str) -> DataFrame:
    """Participants included for both of two variants."""
    included = classified.filter(F.col("decision") == "included")

    def carriers(cpra: str) -> DataFrame:
        return included.filter(F.col("cpra") == cpra).select("participant_id")

    return carriers(left).intersect(carriers(right))

"""Allele-frequency control. One pass over evidence gives a small cell table; all views read that.

The cell table is keyed by (evaluation, sex, ancestry, related) and holds genotype counts only, so
strata, intervals, kinship stability and the bootstrap never touch participant rows again.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortgate.fixed_values import AUTOSOMES
from cohortgate.functions import coerce
from cohortgate.functions.interval import five_places, frequency, wilson_bounds
from cohortgate.operators.evidence import EVALUATION_KEY
from cohortgate.policy import AnalysisPolicy


def frequency_cells(gated: DataFrame, policy: AnalysisPolicy) -> DataFrame:
    """Genotype counts over quality-passed typed calls, and typed-against-imputed counts."""
    ok, gt, dosage = F.col("array_credible"), F.col("array_gt_code"), F.col("imputed_dosage")
    both = ok & dosage.isNotNull()
    differs = (gt >= 1) != (dosage >= policy.imputed_dosage_carrier_threshold)
    return gated.groupBy(
        *EVALUATION_KEY, "chrom", "sex", "ancestry_stub", (~F.col("kinship_ok")).alias("related")
    ).agg(
        F.count_if(ok).alias("callable"),
        F.coalesce(F.sum(F.when(ok, gt.cast("long"))), F.lit(0)).alias("alt_alleles"),
        F.count_if(ok & (gt == 0)).alias("n0"),
        F.count_if(ok & (gt == 1)).alias("n1"),
        F.count_if(ok & (gt == 2)).alias("n2"),
        F.count_if(both).alias("n_compared"),
        F.count_if(coerce.holds(both & differs)).alias("discordant_calls"),
    )


def with_frequency(counted: DataFrame, policy: AnalysisPolicy) -> DataFrame:
    """Frequency and interval of (callable, alt_alleles), hidden under the minimum cell."""
    alleles = (F.col("callable") * 2).cast("long")
    low, high = wilson_bounds(F.col("alt_alleles"), alleles)
    shown = F.col("callable") >= policy.sdc_min_cell
    return counted.withColumns({
        "suppressed": ~shown,
        "reason": F.when(F.col("callable") == 0, "no callable typed samples").when(
            ~shown, "below min cell (internal discipline)"
        ),
        "callable_alleles": F.when(shown, alleles),
        "af": F.when(shown, five_places(frequency(F.col("alt_alleles"), alleles))),
        "ci95_low": F.when(shown, five_places(low)),
        "ci95_high": F.when(shown, five_places(high)),
        "alt_alleles": F.when(shown, F.col("alt_alleles")),
    })


def frequency_strata(
    cells: DataFrame, evaluations: DataFrame, subjects: DataFrame, policy: AnalysisPolicy
) -> DataFrame:
    """Frequency overall, by sex and by ancestry; null strata are dropped, empty ones are kept.

    Off the autosomes no frequency is computed (ploidy guard), so those evaluations have no rows.
    """
    diploid = cells.filter(F.col("chrom").isin(AUTOSOMES))
    strata = F.inline(F.array(
        F.struct(F.lit("overall").alias("stratum_kind"), F.lit("all").alias("stratum")),
        F.struct(F.lit("sex").alias("stratum_kind"), F.col("sex").alias("stratum")),
        F.struct(F.lit("ancestry").alias("stratum_kind"), F.col("ancestry_stub").alias("stratum")),
    ))
    # Cells are already one row per stratum combination, so all margins come from one pass.
    seen = (
        diploid.select(*EVALUATION_KEY, "callable", "alt_alleles", strata)
        .filter(F.col("stratum").isNotNull())
        .groupBy(*EVALUATION_KEY, "stratum_kind", "stratum")
        .agg(F.sum("callable").alias("callable"), F.sum("alt_alleles").alias("alt_alleles"))
    )
    kinds = subjects.select(strata).filter(F.col("stratum").isNotNull()).distinct()
    # Every stratum the cohort has appears for every evaluation: a handful of labels, held as one
    # array value and exploded, so an evaluation without a callable sample still gets its row.
    labels = kinds.agg(F.sort_array(F.collect_list(F.struct("stratum_kind", "stratum"))))
    grid = evaluations.filter(F.col("chrom").isin(AUTOSOMES)).select(
        *EVALUATION_KEY, F.inline(labels.scalar())
    )
    counted = grid.join(seen, [*EVALUATION_KEY, "stratum_kind", "stratum"], "left").withColumns({
        "callable": F.coalesce("callable", F.lit(0)),
        "alt_alleles": F.coalesce("alt_alleles", F.lit(0)),
    })
    return with_frequency(counted, policy).withColumnRenamed("callable", "n_callable_samples")


def frequency_control(
    cells: DataFrame, evaluations: DataFrame, policy: AnalysisPolicy
) -> DataFrame:
    """Per evaluation: ploidy guard, typed-against-imputed counts and kinship stability."""
    counted = cells.groupBy(*EVALUATION_KEY).agg(
        F.sum("callable").alias("callable"),
        F.sum("alt_alleles").alias("alt"),
        F.sum(F.when(~F.col("related"), F.col("callable"))).alias("un_callable"),
        F.sum(F.when(~F.col("related"), F.col("alt_alleles"))).alias("un_alt"),
        F.sum("n_compared").alias("n_compared"),
        F.sum("discordant_calls").alias("discordant_calls"),
    )
    joined = evaluations.select(*EVALUATION_KEY, "chrom").join(counted, EVALUATION_KEY, "left")
    diploid = F.col("chrom").isin(AUTOSOMES)

    def stratum_af(callable_, alt):
        shown = diploid & (callable_ >= policy.sdc_min_cell)
        return F.when(shown, five_places(frequency(alt, callable_ * 2)))

    out = joined.withColumns({
        "ploidy_guard": ~diploid,
        "full_af": stratum_af(F.col("callable"), F.col("alt")),
        "unrelated_only_af": stratum_af(F.col("un_callable"), F.col("un_alt")),
        "n_compared": F.when(diploid, F.coalesce("n_compared", F.lit(0))),
        "discordant_calls": F.when(diploid, F.coalesce("discordant_calls", F.lit(0))),
    }).withColumn("af_delta", five_places(F.abs(F.col("full_af") - F.col("unrelated_only_af"))))
    note = (
        F.when(~diploid, F.concat(
            F.lit("chrom "), F.col("chrom"),
            F.lit(" is non-autosomal; diploid AF not computed (ploidy guard)"),
        ))
        .when(
            F.col("af_delta").isNull(),
            "AF stability could not be assessed after removing related samples",
        )
        .when(F.col("af_delta") == 0, "AF unchanged when related samples are removed")
        .otherwise(F.concat(
            F.lit("AF differs by "), F.format_string("%.5f", F.col("af_delta")),
            F.lit(" when related samples are removed; review for possible clustering"),
        ))
    )
    return out.withColumn("note", note).drop("callable", "alt", "un_callable", "un_alt")


def array_allele_frequency(calls: DataFrame) -> DataFrame:
    """Array frequency per variant over non-missing calls; null when nothing was called."""
    called = F.col("gt_code") >= 0
    return calls.groupBy("cpra").agg(
        F.count_if(called).alias("n_called"),
        F.coalesce(F.sum(F.when(called, F.col("gt_code").cast("long"))), F.lit(0)).alias("alt_alleles"),
    ).withColumn(
        "array_af", F.try_divide(F.col("alt_alleles").cast("double"), F.col("n_called") * 2)
    )


BOOTSTRAP_DRAWS = 1000
BOOTSTRAP_SEED = 42
#: Standard deviations, and places, about the mean that are summed; what lies beyond is below rounding.
REACH, MARGIN = 9, 12
#: Logarithms of 0! to 15!; larger ones come from Stirling's series.
_LOG_FACTORIALS = [math.log(math.factorial(k)) for k in range(16)]


def uniform_ranks(draws: int = BOOTSTRAP_DRAWS, seed: int = BOOTSTRAP_SEED) -> dict[int, float]:
    """The uniform numbers that draws use, by the ranks between which the 2.5% and 97.5% points lie.

    Draw d uses a hash of seed and d, so no state runs through the draws.
    """
    ordered = sorted(int(hashlib.md5(f"{seed}:{d}".encode()).hexdigest()[:13], 16) / 2**52 for d in range(draws))
    return {rank: ordered[rank] for point in (0.025, 0.975) for rank in (math.floor(point * (draws - 1)), math.floor(point * (draws - 1)) + 1)}


def log_factorial(k: Column) -> Column:
    z = k.cast("double") + 1
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    large = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series
    known = F.element_at(F.array(*[F.lit(x) for x in _LOG_FACTORIALS]), F.least(k, F.lit(15)).cast("int") + 1)
    return F.when(k < 16, known).otherwise(large)


def bootstrap_interval(cells: DataFrame, policy: AnalysisPolicy) -> DataFrame:
    """Bootstrap 95% interval of the overall typed frequency.

    A resample's alternate alleles depend only on how often 0, 1 and 2 are drawn, so each evaluation is
    reduced to three counts, and the distribution of the allele total is summed over the counts that
    can occur. A draw inverts it at its uniform number. Inversion keeps order, so the draw of a rank is
    the inverse at the uniform number of that rank, and the percentiles need four of them: no draw is
    made one by one. Equal in distribution to resampling the calls, not bit for bit. Rows of an
    evaluation grow with its calls, by some twenty for each at most.
    """
    counted = cells.filter(F.col("chrom").isin(AUTOSOMES)).groupBy(*EVALUATION_KEY).agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("n2").alias("n2")
    ).withColumn("n", F.col("n0") + F.col("n1") + F.col("n2"))
    n = F.col("n")

    def ends(count: str) -> tuple[Column, Column]:
        mean = F.col(count).cast("double")
        reach = REACH * F.sqrt(mean * (n - F.col(count)) / n) + MARGIN
        return F.greatest(F.lit(0), F.floor(mean - reach)).cast("long"), F.least(n, F.ceil(mean + reach)).cast("long")

    def part(times: Column, count: str) -> Column:
        """Logarithm of the share of ``count`` to the power ``times``, over the factorial of it."""
        share = F.when(F.col(count) > 0, F.log(F.col(count) / n) * times).otherwise(F.when(times > 0, float("-inf")).otherwise(0.0))
        return share - log_factorial(times)

    (low1, high1), (low2, high2) = ends("n1"), ends("n2")
    shown = counted.filter(n >= policy.sdc_min_cell)
    two = shown.select("*", low1.alias("_low"), high1.alias("_high"), F.explode(F.sequence(low2, high2)).alias("x2"))
    two = two.withColumn("_high", F.least(F.col("_high"), n - F.col("x2"))).filter("_low <= _high")
    grid = two.withColumn("x1", F.explode(F.sequence("_low", "_high")))
    x1, x2 = F.col("x1"), F.col("x2")
    chance = F.exp(log_factorial(n) + part(n - x1 - x2, "n0") + part(x1, "n1") + part(x2, "n2"))
    totals = grid.groupBy(*EVALUATION_KEY, "n", (x1 + 2 * x2).alias("t")).agg(F.sum(chance).alias("p"))
    below = totals.withColumn("below", F.sum("p").over(W.partitionBy(*EVALUATION_KEY).orderBy("t")))
    ranks = uniform_ranks()
    inverted = below.groupBy(*EVALUATION_KEY, "n").agg(
        *[F.min(F.when(F.col("below") >= u, F.col("t"))).alias(f"_{rank}") for rank, u in ranks.items()]
    )

    def point(share: float) -> Column:
        place = share * (BOOTSTRAP_DRAWS - 1)
        rank = math.floor(place)
        t = F.col(f"_{rank}") + (F.col(f"_{rank + 1}") - F.col(f"_{rank}")) * F.lit(place - rank)
        return five_places(t / (F.col("n") * 2).cast("double"))

    found = inverted.select(*EVALUATION_KEY, point(0.025).alias("ci95_low"), point(0.975).alias("ci95_high"))
    return counted.select(*EVALUATION_KEY).join(found, EVALUATION_KEY, "left")

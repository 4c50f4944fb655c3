"""Disclosure control over count tables: totals, breakdowns, strata and sensitivity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortgate.fixed_values import CELL_CONDITIONAL, CELL_HIGH, RESPONSE_RATES
from cohortgate.functions import disclosure as dc
from cohortgate.policy import AnalysisPolicy, Scenario


def control_cells(cells: DataFrame, policy: AnalysisPolicy) -> DataFrame:
    """Total token, breakdown verdict and the rounded cells that may be shown.

    One small non-zero subgroup withholds the whole breakdown, because the total is released.
    """
    m, base = policy.sdc_min_cell, policy.sdc_round_to
    hidden = dc.small_cell(F.col("high_confidence"), m, base) | dc.small_cell(
        F.col("conditional"), m, base
    )
    return cells.withColumns({
        "breakdown_suppressed": hidden,
        "total_suppressed": dc.below_minimum(F.col("total"), m, base),
        "client_total": dc.total_token(F.col("total"), m, base),
        "shown_high": F.when(~hidden, dc.rounded(F.col("high_confidence"), base)),
        "shown_conditional": F.when(~hidden, dc.rounded(F.col("conditional"), base)),
    })


def reported_cells(hidden, shown_high, shown_conditional):
    """The cells array of a release: empty when the breakdown is suppressed."""
    cell = "array<struct<label:string,count:bigint>>"
    shown = F.array(
        F.struct(F.lit(CELL_HIGH).alias("label"), shown_high.alias("count")),
        F.struct(F.lit(CELL_CONDITIONAL).alias("label"), shown_conditional.alias("count")),
    ).cast(cell)
    return F.when(~hidden, shown).otherwise(F.array().cast(cell))


def strata_verdict(
    strata: DataFrame, totals: DataFrame, keys: list[str], policy: AnalysisPolicy
) -> DataFrame:
    """Per key: are the strata withheld, how many are small, and what is unaccounted for.

    ``strata`` is (keys, stratum, n); ``totals`` is (keys, total) and keeps keys without strata.
    """
    m, base = policy.sdc_min_cell, policy.sdc_round_to
    summed = strata.groupBy(*keys).agg(
        F.count_if(dc.small_cell(F.col("n"), m, base)).alias("small_strata"),
        F.sum("n").alias("_sum"),
    )
    joined = totals.select(*keys, "total").join(summed, keys, "left")
    unaccounted = F.col("total") - F.coalesce("_sum", F.lit(0))
    return joined.select(
        *keys,
        F.coalesce("small_strata", F.lit(0)).cast("long").alias("small_strata"),
        unaccounted.alias("unaccounted"),
        ((F.coalesce("small_strata", F.lit(0)) > 0) | (unaccounted != 0)).alias("ancestry_suppressed"),
    )


def control_strata(
    strata: DataFrame, totals: DataFrame, keys: list[str], policy: AnalysisPolicy
) -> DataFrame:
    """Strata that may be shown, rounded; none of a key's strata when one of them is small."""
    open_keys = strata_verdict(strata, totals, keys, policy).filter(~F.col("ancestry_suppressed"))
    return strata.join(open_keys.select(*keys), keys, "left_semi").withColumn(
        "shown_n", dc.rounded(F.col("n"), policy.sdc_round_to)
    ).drop("n")


def sensitivity_scenarios(policy: AnalysisPolicy) -> list[Scenario]:
    """DR2 at the floor, half way, and at the high-confidence cut."""
    low, high = policy.imputed_dr2_min, policy.imputed_dr2_high_confidence
    return [
        Scenario(name=f"DR2 >= {value:.2f}", imputed_dr2_min=value)
        for value in sorted({low, (low + high) / 2, high})
    ]


def control_sensitivity(
    projected: DataFrame, keys: list[str], policy: AnalysisPolicy
) -> DataFrame:
    """Token per DR2 threshold; a key is withheld when two neighbours differ by a small count.

    ``projected`` is (keys, scenario, total) where scenario names sort in threshold order.
    """
    ordered = Window.partitionBy(*keys).orderBy("scenario")
    moved = projected.withColumn(
        "_move", F.abs(F.col("total") - F.lag("total").over(ordered))
    )
    exposes = (F.col("_move") > 0) & (F.col("_move") < policy.sdc_min_cell)
    flagged = moved.withColumn(
        "suppressed",
        F.coalesce(F.bool_or(exposes).over(Window.partitionBy(*keys)), F.lit(False)),
    )
    token = dc.total_token(F.col("total"), policy.sdc_min_cell, policy.sdc_round_to)
    return flagged.select(
        *keys, F.col("scenario").alias("threshold"), "suppressed",
        F.when(~F.col("suppressed"), token).alias("client_total"),
    )


def recruitment_funnel(
    results: DataFrame, keys: list[str], policy: AnalysisPolicy,
    rates: tuple[float, ...] = RESPONSE_RATES,
) -> DataFrame:
    """Planning steps per result. Estimates start from the released token, never from the count."""
    steps = [
        F.struct(
            F.lit(1).alias("step_no"),
            F.lit("Genotype carrier ceiling").alias("step"),
            F.col("client_total").alias("value"),
            F.lit("released SDC-applied genotype count").alias("basis"),
        ),
        F.struct(
            F.lit(2).alias("step_no"),
            F.lit("Phenotype eligibility").alias("step"),
            F.lit("downstream aggregate return").alias("value"),
            F.lit("ICD-10 / linked-record review, not inferred in the genotype MVP").alias("basis"),
        ),
    ]
    for number, rate in enumerate(rates, start=3):
        steps.append(F.struct(
            F.lit(number).alias("step_no"),
            F.lit(f"Illustrative response at {int(rate * 100)}%").alias("step"),
            dc.scaled_token(
                F.col("client_total"), rate, policy.sdc_min_cell, policy.sdc_round_to
            ).alias("value"),
            F.lit("planning assumption applied only to the released SDC token").alias("basis"),
        ))
    return results.select(*keys, F.inline(F.array(*steps)))

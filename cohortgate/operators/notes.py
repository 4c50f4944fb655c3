"""Analyst notes as text columns: fixed headings around values of the result rows.

Headings name the organisation of the :class:`~cohortgate.policy.Deployment`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortgate.fixed_values import RESPONSE_RATES
from cohortgate.functions import disclosure as dc
from cohortgate.operators.results import breakdown_tokens
from cohortgate.policy import AnalysisPolicy, Deployment


def _text(*parts: str | Column) -> Column:
    """Literal strings and columns side by side; a null column gives an empty place."""
    return F.concat(*[
        F.coalesce(p, F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts
    ])


def _lines(*lines: str | Column) -> Column:
    """Lines of a note; a null line is left out."""
    return F.concat_ws("\n", *[line if isinstance(line, Column) else F.lit(line) for line in lines])


def _bullets(items: Column, indent: str = "  - ") -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit(indent), x)), "\n")


def cutoffs(policy: AnalysisPolicy) -> list[str]:
    """Configured quality cut-offs in words."""
    return [
        f"Array call rate >= {policy.array_call_rate_min}",
        f"Array GQ >= {policy.array_gq_min}",
        f"Imputed variant DR2 >= {policy.imputed_dr2_min}",
        f"Imputed max GP >= {policy.imputed_max_gp_min}",
        f"Imputed dosage carrier threshold >= {policy.imputed_dosage_carrier_threshold}",
    ]


def _cutoff_lines(policy: AnalysisPolicy) -> list[str | Column]:
    shown = F.transform(
        "sensitivity",
        lambda s: F.concat(F.lit("    * "), s["threshold"], F.lit(": "), s["client_total"]),
    )
    sensitivity = F.when(
        F.col("sensitivity_suppressed"),
        "  - DR2 sensitivity: SUPPRESSED — withheld because adjacent thresholds expose a "
        "sub-minimum movement.",
    ).otherwise(F.concat(F.lit("  - DR2 sensitivity (SDC-applied):\n"), F.array_join(shown, "\n")))
    return [*[f"  - {line}" for line in cutoffs(policy)], sensitivity]


def _ancestry_list() -> Column:
    return F.array_join(
        F.transform(
            "ancestry_breakdown",
            lambda s: F.concat(s["stratum"], F.lit(": ~"), s["n"].cast("string")),
        ),
        ", ",
    )


def _ancestry_line() -> Column:
    return (
        F.when(
            F.col("ancestry_suppressed"),
            "  Ancestry breakdown: SUPPRESSED — a per-ancestry stratum is below the minimum\n"
            "  cell size; with the total released, showing the rest would expose it.",
        )
        .when(
            F.coalesce(F.size("ancestry_breakdown"), F.lit(0)) > 0,
            _text("  Ancestry breakdown (consented carriers): ", _ancestry_list()),
        )
        .otherwise("  Ancestry breakdown: n/a")
    )


def _yes(flag: str, yes: str = "yes", no: str = "no") -> Column:
    return F.when(F.col(flag), yes).otherwise(no)


def _request_lines() -> tuple[Column, Column]:
    return (
        _text("1. REQUEST          ", F.col("study_id"), " | purpose: ", F.col("purpose")),
        _text(
            "2. VARIANT          ", F.col("cpra"), " (build ", F.col("build"), "); ref ", F.col("ref"),
            " / alt ", F.col("alt"), "; carrier = ", F.col("carrier_definition"),
        ),
    )


def neutral_summary(policy: AnalysisPolicy, deployment: Deployment) -> Column:
    """The ten-part summary."""
    high, conditional = breakdown_tokens(policy)
    breakdown = F.when(
        F.col("breakdown_suppressed"),
        "  Subgroup breakdown (array-direct vs imputed-supported): SUPPRESSED — a subgroup\n"
        f"  is below the minimum cell size ({policy.sdc_min_cell}); releasing it beside the\n"
        "  total would permit back-calculation of the complement.",
    ).otherwise(_text(
        "  Array-direct (high confidence):  ", high, "\n  Imputed-supported (conditional): ", conditional
    ))
    return _lines(
        f"{deployment.organisation} — GENOTYPE FEASIBILITY SUMMARY (INTERNAL ANALYST NOTE, SDC-APPLIED)",
        "=" * 78,
        *_request_lines(),
        _text(
            "3. SOURCES CHECKED  requested: ", F.col("requested_source"),
            f"; variant on {deployment.short_name} array: ",
            _yes("variant_on_array", "yes — array-direct evidence available"),
            f"; variant in {deployment.short_name} imputed resource: ",
            _yes("variant_on_imputed", no="no — imputed evidence unavailable"),
        ),
        "   evidence tiers: array-direct > imputed-high (DR2 high) > imputed-conditional",
        "4. METHOD",
        _bullets(F.col("assumptions")),
        "5. ELIGIBLE GENOTYPE CARRIERS (consented, QC-passed) — disclosure-controlled",
        _text(
            "  Approximate count: ", F.col("client_total"),
            f"   [rounded to nearest {policy.sdc_round_to}; SDC applied]",
        ),
        breakdown,
        _ancestry_line(),
        "6. INTERNAL HANDOFF  pseudonymised carrier set staged for epidemiology (in-TRE)",
        "7. PHENOTYPE         ICD-10 phenotype eligibility assessed downstream by epi",
        "8. QUALITY CUT-OFFS  configured and surfaced, not hidden",
        *_cutoff_lines(policy),
        "9. DISCLOSURE CONTROL",
        f"  - min cell size {policy.sdc_min_cell}, rounding to nearest {policy.sdc_round_to}; "
        "secondary suppression withholds the breakdown if any subgroup is small.",
        "  - The canonical export is the authorised release payload;\n"
        "    this note and all participant-level tables remain internal.",
        "10. CAVEATS",
        _bullets(F.col("limitations")),
        "-" * 78,
        _text("RECOMMENDATION: ", F.col("recommendation")),
    )


def research_note(policy: AnalysisPolicy, deployment: Deployment) -> Column:
    """Method, evidence tiers and caveats first."""
    high, conditional = breakdown_tokens(policy)
    breakdown = F.when(
        F.col("breakdown_suppressed"),
        "- Subgroup breakdown: suppressed under disclosure control; the total is the released figure.",
    ).otherwise(_text(
        "- Array-direct high-confidence carriers: ", high,
        "\n- Imputed-supported conditional carriers: ", conditional,
    ))
    return _lines(
        f"{deployment.short_name} GENOTYPE FEASIBILITY — RESEARCH NOTE (SDC-APPLIED)",
        "=" * 72,
        _text("Study: ", F.col("study_id"), " | Variant: ", F.col("cpra"), " (", F.col("build"), ")"),
        _text("Purpose: ", F.col("purpose")),
        _text("Released genotype carrier ceiling: ", F.col("client_total")),
        _text("Recommendation: ", F.col("recommendation")),
        "",
        "Evidence interpretation",
        breakdown,
        _text(
            "- Requested source: ", F.col("requested_source"), "; variant on array: ",
            _yes("variant_on_array"), "; variant in imputed resource: ", _yes("variant_on_imputed"),
        ),
        "",
        "Configured quality cut-offs",
        *_cutoff_lines(policy),
        "",
        "Method assumptions",
        _bullets(F.col("assumptions")),
        "",
        "Caveats",
        _bullets(F.col("limitations")),
        "",
        f"Disclosure control: min cell {policy.sdc_min_cell}; rounded to {policy.sdc_round_to}.",
    )


def _estimate(token: Column, rate: float, policy: AnalysisPolicy) -> Column:
    return dc.scaled_token(token, rate, policy.sdc_min_cell, policy.sdc_round_to)


def planning_memo(policy: AnalysisPolicy, deployment: Deployment) -> Column:
    """Planning figures from the released token, with the recruitment funnel."""
    responses = [
        _text(
            f"- Illustrative response at {int(rate * 100)}%: ",
            _estimate(F.col("client_total"), rate, policy),
            " (planning assumption applied only to the released SDC token)",
        )
        for rate in RESPONSE_RATES
    ]
    shown = F.array_join(F.transform(
        "sensitivity", lambda s: F.concat(s["threshold"], F.lit(" -> "), s["client_total"])
    ), "; ")
    sensitivity = F.when(
        F.col("sensitivity_suppressed"),
        "- DR2 sensitivity: suppressed because adjacent thresholds would expose a sub-minimum movement.",
    ).otherwise(_text("- DR2 sensitivity: ", shown))
    return _lines(
        f"{deployment.short_name} GENOTYPE FEASIBILITY — INTERNAL PLANNING PREVIEW "
        "(SDC-APPLIED; NOT A RELEASE ARTEFACT)",
        "=" * 72,
        _text(f"Question: can {deployment.short_name} identify carriers for ", F.col("purpose"), "?"),
        _text("Decision signal: ", F.col("recommendation")),
        _text("Released genotype carrier ceiling: ", F.col("client_total")),
        "",
        "Recruitability planning view",
        _text(
            "- Genotype carrier ceiling: ", F.col("client_total"),
            " (released SDC-applied genotype count)",
        ),
        "- Phenotype eligibility: downstream aggregate return "
        "(ICD-10 / linked-record review, not inferred in the genotype MVP)",
        *responses,
        "",
        "Operational constraints",
        "- Genotype count is a ceiling before phenotype eligibility.",
        "- Participant-level tables and pseudonymised handoff remain internal to the TRE.",
        f"- SDC min cell {policy.sdc_min_cell}, rounding {policy.sdc_round_to}; no subgroup is "
        "released when it would enable differencing.",
        "- Configured quality cut-offs: " + "; ".join(cutoffs(policy)),
        sensitivity,
        "",
        "Caveats",
        _bullets(F.col("limitations")),
    )


def audience_note(audience: str, policy: AnalysisPolicy, deployment: Deployment) -> Column:
    """The same governed result for one of three audiences."""
    makers = {"neutral": neutral_summary, "research": research_note, "commercial": planning_memo}
    if audience not in makers:
        raise ValueError(f"unknown audience: {audience!r}")
    return makers[audience](policy, deployment)


def request_notes(
    accepted: DataFrame, policy: AnalysisPolicy, deployment: Deployment
) -> DataFrame:
    """(request_id, neutral, research, commercial)."""
    return accepted.select("request_id", *[
        audience_note(a, policy, deployment).alias(a) for a in ("neutral", "research", "commercial")
    ])


def markdown_report(policy: AnalysisPolicy) -> Column:
    high, conditional = breakdown_tokens(policy)
    breakdown = F.when(
        F.col("breakdown_suppressed"),
        "| Subgroup breakdown | suppressed (a subgroup below the minimum cell size) |",
    ).otherwise(_text(
        "| Array-direct (high confidence) | ", high, " |\n| Imputed-supported (conditional) | ",
        conditional, " |",
    ))
    ancestry = F.when(
        F.col("ancestry_suppressed"),
        "| Ancestry breakdown | suppressed (a per-ancestry stratum below the minimum) |",
    ).when(
        F.coalesce(F.size("ancestry_breakdown"), F.lit(0)) > 0,
        _text("| Ancestry breakdown | ", _ancestry_list(), " |"),
    )
    return _lines(
        _text("# Genotype feasibility — ", F.col("study_id")),
        "",
        _text(
            "**Variant:** `", F.col("cpra"), "` (build ", F.col("build"), "); carrier = ",
            F.col("carrier_definition"),
        ),
        _text("**Purpose:** ", F.col("purpose")),
        "",
        "## Recommendation",
        _text("> ", F.col("recommendation")),
        "",
        "## Eligible genotype carriers (consented, QC-passed)",
        "",
        "| Metric | Value (SDC-applied) |",
        "|---|---|",
        _text("| Approximate count | ", F.col("client_total"), " |"),
        breakdown,
        ancestry,
        "",
        "## Method",
        _bullets(F.col("assumptions"), "- "),
        "",
        "## Caveats",
        _bullets(F.col("limitations"), "- "),
        "",
        f"_Disclosure control: min cell {policy.sdc_min_cell}, rounding to {policy.sdc_round_to}; "
        "secondary suppression applied. The export is the authorised release payload._",
    )


def final_note(policy: AnalysisPolicy, deployment: Deployment) -> Column:
    """Post-phenotype summary: the ceiling and the eligible figure, each under its own heading."""
    return _lines(
        f"{deployment.organisation} — FINAL POST-PHENOTYPE FEASIBILITY SUMMARY "
        "(INTERNAL ANALYST NOTE, SDC)",
        "=" * 78,
        *_request_lines(),
        "3. GENOTYPE FEASIBILITY (upper bound / ceiling) — disclosure-controlled",
        _text(
            "  Genotype carrier ceiling: ", F.col("client_genotype_ceiling"),
            "   [consented, QC-passed carriers; an UPPER BOUND before phenotype]",
        ),
        "4. EPIDEMIOLOGY REVIEW (ICD-10 phenotype eligibility — assessed by epidemiology)",
        _text(
            "  Phenotype definition: ", F.col("phenotype_definition_id"), " | ICD-10 code-set: ",
            F.col("icd10_codeset_label"), " ", F.col("icd10_codeset_version"),
        ),
        _text("  Returned + signed off by ", F.col("epi_reviewer"), " at ", F.col("epi_timestamp")),
        "5. POST-PHENOTYPE ELIGIBLE CARRIERS (the FINAL figure) — disclosure-controlled",
        _text(
            "  Eligible count: ", F.col("client_eligible"),
            f"   [after ICD-10 assessment; rounded to nearest {policy.sdc_round_to}; SDC applied]",
        ),
        "6. DISCLOSURE CONTROL",
        f"  - min cell size {policy.sdc_min_cell}, rounding to nearest {policy.sdc_round_to}; "
        "applied to both the ceiling and the eligible count.",
        "  - The canonical export is the authorised release payload; this note and all "
        "participant-level tables remain internal.",
        "7. CAVEATS",
        _bullets(F.col("final_caveats")),
        "-" * 78,
        _text("RECOMMENDATION: ", F.col("final_recommendation")),
    )


def batch_note(audience: str, policy: AnalysisPolicy, deployment: Deployment) -> Column:
    """A batch note; it shows the union total, and single-variant counts only when unsuppressed."""
    members = F.col("members").cast("string")
    if audience == "neutral":
        detail = F.when(
            F.col("breakdown_suppressed"),
            "\nPER-VARIANT / OVERLAP BREAKDOWN: SUPPRESSED\n"
            "  Per-variant counts and overlap are withheld because they can reveal suppressed\n"
            "  intersections or complements by differencing against the union total.",
        ).otherwise(_text(
            # Not suppressed means one distinct variant, listed once per member.
            "\nPER-VARIANT (consented, QC-passed carriers, SDC-applied):\n",
            F.array_join(F.array_repeat(
                _text("  ", F.col("subject"), ": ", F.col("combined_client_total")), F.col("members").cast("int")
            ), "\n"),
            F.when(
                F.col("members") > 1,
                _text("\n  of which carry >=2 variants: ", F.col("overlap_client")),
            ),
        ))
        return _lines(
            f"{deployment.organisation} — COMBINED (MULTI-VARIANT) FEASIBILITY SUMMARY (SDC-APPLIED)",
            "=" * 78,
            _text("Study: ", F.col("study_id"), " | purpose: ", F.col("purpose")),
            _text("Variants assessed: ", members),
            "",
            _text(
                "COMBINED — participants carrying >=1 variant: ", F.col("combined_client_total"),
            ),
            "  [union across variants; the recall set for a composite risk profile; SDC applied]",
            detail,
        )
    if audience not in ("research", "commercial"):
        raise ValueError(f"unknown audience: {audience!r}")
    title = "RESEARCH NOTE" if audience == "research" else "CLIENT PLANNING MEMO"
    responses = [] if audience == "research" else [
        _text(
            f"- Illustrative response at {int(rate * 100)}%: ",
            _estimate(F.col("combined_client_total"), rate, policy),
        )
        for rate in RESPONSE_RATES
    ]
    return _lines(
        f"{deployment.short_name} MULTI-VARIANT FEASIBILITY — {title} (SDC-APPLIED)",
        "=" * 72,
        _text("Study: ", F.col("study_id"), " | variants assessed: ", members),
        _text("Purpose: ", F.col("purpose")),
        _text("Released union carrier ceiling: ", F.col("combined_client_total")),
        "",
        "Disclosure control",
        f"- min cell {policy.sdc_min_cell}; rounded to {policy.sdc_round_to}.",
        "- Per-variant and overlap counts are withheld because they can expose intersections or "
        "complements by differencing against the union.",
        "",
        "Interpretation",
        "- The figure is genotype feasibility before phenotype eligibility.",
        "- The pseudonymised carrier set remains internal for epidemiology review.",
        *responses,
    )


def batch_notes(batches: DataFrame, policy: AnalysisPolicy, deployment: Deployment) -> DataFrame:
    return batches.select("batch_id", *[
        batch_note(a, policy, deployment).alias(a) for a in ("neutral", "research", "commercial")
    ])

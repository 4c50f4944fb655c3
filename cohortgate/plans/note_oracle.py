"""Reference SQL of the note queries: the texts a second time, line by line.

A line is a template in which ``{name}`` stands for a column or a named SQL text; a null gives an empty
place. Lines are joined by line feeds, and a null line is left out.
"""

from __future__ import annotations

import re

from cohortgate.fixed_values import RESPONSE_RATES
from cohortgate.plans import driver_views as dv
from cohortgate.plans.oracle import DR2_STEPS, ORACLE, B, M, P, estimate, lit, token, with_ctes

D = dv.DEPLOYMENT
CUTOFFS = [
    f"Array call rate >= {P.array_call_rate_min}", f"Array GQ >= {P.array_gq_min}", f"Imputed variant DR2 >= {P.imputed_dr2_min}",
    f"Imputed max GP >= {P.imputed_max_gp_min}", f"Imputed dosage carrier threshold >= {P.imputed_dosage_carrier_threshold}",
]


def line(template: str, **texts: str) -> str:
    pieces = re.split(r"\{(\w+)\}", template)
    parts = [lit(piece) if i % 2 == 0 else f"CAST({texts.get(piece, piece)} AS VARCHAR)" for i, piece in enumerate(pieces) if piece]
    return f"concat({', '.join(parts)})".replace("\n", "' || chr(10) || '") if parts else "''"


def choice(*cases: tuple[str, str], other: str | None = None) -> str:
    whens = " ".join(f"WHEN {condition} THEN {text}" for condition, text in cases)
    return f"CASE {whens} {f'ELSE {other} ' if other else ''}END"


def lines(*rows: str) -> str:
    return f"concat_ws(chr(10), {', '.join(rows)})"


def bullets(column: str, mark: str = "  - ") -> str:
    return f"concat({lit(mark)}, replace({column}, '|', concat(chr(10), {lit(mark)})))"


def yes(flag: str, there: str = "yes", absent: str = "no") -> str:
    return choice((flag, lit(there)), other=lit(absent))


def steps(before: str, between: str, sep: str) -> str:
    shown = [f"concat({lit(f'{before}DR2 >= {d:.2f}{between}')}, {token(f't{i}')})" for i, d in enumerate(DR2_STEPS)]
    return f"concat_ws({sep}, {', '.join(shown)})"


REQUEST = [
    line("1. REQUEST          {study_id} | purpose: {purpose}"),
    line("2. VARIANT          {cpra} (build {build}); ref {ref} / alt {alt}; carrier = {carrier_definition}"),
]
CUTOFF_LINES = [
    *[lit(f"  - {text}") for text in CUTOFFS],
    choice(
        ("sensitivity_suppressed", lit("  - DR2 sensitivity: SUPPRESSED — withheld because adjacent thresholds expose a sub-minimum movement.")),
        other=f"concat('  - DR2 sensitivity (SDC-applied):', chr(10), {steps('    * ', ': ', 'chr(10)')})",
    ),
]
ANCESTRY = choice(
    ("ancestry_suppressed", line("  Ancestry breakdown: SUPPRESSED — a per-ancestry stratum is below the minimum\n  cell size; with the total released, showing the rest would expose it.")),
    ("coalesce(ancestry_breakdown, '') <> ''", line("  Ancestry breakdown (consented carriers): {ancestry_breakdown}")),
    other=lit("  Ancestry breakdown: n/a"),
)
NEUTRAL = lines(
    lit(f"{D.organisation} — GENOTYPE FEASIBILITY SUMMARY (INTERNAL ANALYST NOTE, SDC-APPLIED)"), lit("=" * 78), *REQUEST,
    line(
        f"3. SOURCES CHECKED  requested: {{requested_source}}; variant on {D.short_name} array: {{a}}; variant in {D.short_name} imputed resource: {{i}}",
        a=yes("variant_on_array", "yes — array-direct evidence available"), i=yes("variant_on_imputed", absent="no — imputed evidence unavailable"),
    ),
    lit("   evidence tiers: array-direct > imputed-high (DR2 high) > imputed-conditional"),
    lit("4. METHOD"), bullets("assumptions"),
    lit("5. ELIGIBLE GENOTYPE CARRIERS (consented, QC-passed) — disclosure-controlled"),
    line(f"  Approximate count: {{client_total}}   [rounded to nearest {B}; SDC applied]"),
    choice(
        ("breakdown_suppressed", line(
            "  Subgroup breakdown (array-direct vs imputed-supported): SUPPRESSED — a subgroup\n"
            f"  is below the minimum cell size ({M}); releasing it beside the\n  total would permit back-calculation of the complement.")),
        other=line("  Array-direct (high confidence):  ~{shown_high}\n  Imputed-supported (conditional): ~{shown_conditional}"),
    ),
    ANCESTRY,
    lit("6. INTERNAL HANDOFF  pseudonymised carrier set staged for epidemiology (in-TRE)"),
    lit("7. PHENOTYPE         ICD-10 phenotype eligibility assessed downstream by epi"),
    lit("8. QUALITY CUT-OFFS  configured and surfaced, not hidden"), *CUTOFF_LINES,
    lit("9. DISCLOSURE CONTROL"),
    lit(f"  - min cell size {M}, rounding to nearest {B}; secondary suppression withholds the breakdown if any subgroup is small."),
    line("  - The canonical export is the authorised release payload;\n    this note and all participant-level tables remain internal."),
    lit("10. CAVEATS"), bullets("limitations"), lit("-" * 78), line("RECOMMENDATION: {recommendation}"),
)
RESEARCH = lines(
    lit(f"{D.short_name} GENOTYPE FEASIBILITY — RESEARCH NOTE (SDC-APPLIED)"), lit("=" * 72),
    line("Study: {study_id} | Variant: {cpra} ({build})"), line("Purpose: {purpose}"),
    line("Released genotype carrier ceiling: {client_total}"), line("Recommendation: {recommendation}"), "''",
    lit("Evidence interpretation"),
    choice(
        ("breakdown_suppressed", lit("- Subgroup breakdown: suppressed under disclosure control; the total is the released figure.")),
        other=line("- Array-direct high-confidence carriers: ~{shown_high}\n- Imputed-supported conditional carriers: ~{shown_conditional}"),
    ),
    line("- Requested source: {requested_source}; variant on array: {a}; variant in imputed resource: {i}", a=yes("variant_on_array"), i=yes("variant_on_imputed")),
    "''", lit("Configured quality cut-offs"), *CUTOFF_LINES, "''", lit("Method assumptions"), bullets("assumptions"), "''",
    lit("Caveats"), bullets("limitations"), "''", lit(f"Disclosure control: min cell {M}; rounded to {B}."),
)
COMMERCIAL = lines(
    lit(f"{D.short_name} GENOTYPE FEASIBILITY — INTERNAL PLANNING PREVIEW (SDC-APPLIED; NOT A RELEASE ARTEFACT)"), lit("=" * 72),
    line(f"Question: can {D.short_name} identify carriers for {{purpose}}?"), line("Decision signal: {recommendation}"),
    line("Released genotype carrier ceiling: {client_total}"), "''", lit("Recruitability planning view"),
    line("- Genotype carrier ceiling: {client_total} (released SDC-applied genotype count)"),
    lit("- Phenotype eligibility: downstream aggregate return (ICD-10 / linked-record review, not inferred in the genotype MVP)"),
    *[
        line(f"- Illustrative response at {int(rate * 100)}%: {{e}} (planning assumption applied only to the released SDC token)", e=estimate("client_total", rate))
        for rate in RESPONSE_RATES
    ],
    "''", lit("Operational constraints"), lit("- Genotype count is a ceiling before phenotype eligibility."),
    lit("- Participant-level tables and pseudonymised handoff remain internal to the TRE."),
    lit(f"- SDC min cell {M}, rounding {B}; no subgroup is released when it would enable differencing."),
    lit("- Configured quality cut-offs: " + "; ".join(CUTOFFS)),
    choice(
        ("sensitivity_suppressed", lit("- DR2 sensitivity: suppressed because adjacent thresholds would expose a sub-minimum movement.")),
        other=f"concat('- DR2 sensitivity: ', {steps('', ' -> ', lit('; '))})",
    ),
    "''", lit("Caveats"), bullets("limitations"),
)
ORACLE["feasibility_notes"] = with_ctes(
    f"SELECT request_id, {NEUTRAL} AS neutral, {RESEARCH} AS research, {COMMERCIAL} AS commercial FROM o_acc", "o_acc"
)

FINAL = lines(
    lit(f"{D.organisation} — FINAL POST-PHENOTYPE FEASIBILITY SUMMARY (INTERNAL ANALYST NOTE, SDC)"), lit("=" * 78), *REQUEST,
    lit("3. GENOTYPE FEASIBILITY (upper bound / ceiling) — disclosure-controlled"),
    line("  Genotype carrier ceiling: {client_genotype_ceiling}   [consented, QC-passed carriers; an UPPER BOUND before phenotype]"),
    lit("4. EPIDEMIOLOGY REVIEW (ICD-10 phenotype eligibility — assessed by epidemiology)"),
    line("  Phenotype definition: {phenotype_definition_id} | ICD-10 code-set: {icd10_codeset_label} {icd10_codeset_version}"),
    line("  Returned + signed off by {reviewer} at {return_timestamp}"),
    lit("5. POST-PHENOTYPE ELIGIBLE CARRIERS (the FINAL figure) — disclosure-controlled"),
    line(f"  Eligible count: {{client_eligible}}   [after ICD-10 assessment; rounded to nearest {B}; SDC applied]"),
    lit("6. DISCLOSURE CONTROL"),
    lit(f"  - min cell size {M}, rounding to nearest {B}; applied to both the ceiling and the eligible count."),
    lit("  - The canonical export is the authorised release payload; this note and all participant-level tables remain internal."),
    lit("7. CAVEATS"), bullets("final_caveats"), lit("-" * 78), line("RECOMMENDATION: {final_recommendation}"),
)
ORACLE["final_notes"] = with_ctes(f"""SELECT request_id, {FINAL} AS note FROM (
  SELECT f.request_id, a.study_id, a.purpose, a.cpra, a.build, a.ref, a.alt, a.carrier_definition, f.client_genotype_ceiling, f.client_eligible, f.final_caveats,
    f.final_recommendation, x.phenotype_definition_id, x.icd10_codeset_label, x.icd10_codeset_version, x.reviewer, x.return_timestamp
  FROM o_finals f JOIN o_acc a ON f.request_id = a.request_id JOIN v_returns x ON a.study_id = x.study_id) n""", "o_finals", "o_acc", "v_returns")

BATCH_NEUTRAL = lines(
    lit(f"{D.organisation} — COMBINED (MULTI-VARIANT) FEASIBILITY SUMMARY (SDC-APPLIED)"), lit("=" * 78),
    line("Study: {study_id} | purpose: {purpose}"), line("Variants assessed: {members}"), "''",
    line("COMBINED — participants carrying >=1 variant: {combined_client_total}"),
    lit("  [union across variants; the recall set for a composite risk profile; SDC applied]"),
    choice(
        ("breakdown_suppressed", line(
            "\nPER-VARIANT / OVERLAP BREAKDOWN: SUPPRESSED\n  Per-variant counts and overlap are withheld because they can reveal suppressed\n"
            "  intersections or complements by differencing against the union total.")),
        other=line(
            "\nPER-VARIANT (consented, QC-passed carriers, SDC-applied):\n{each}{twice}",
            each="array_to_string(list_transform(range(members), lambda i: concat('  ', subject, ': ', combined_client_total)), chr(10))",
            twice="CASE WHEN members > 1 THEN concat(chr(10), '  of which carry >=2 variants: ', overlap_client) ELSE '' END",
        ),
    ),
)


def batch_memo(title: str, *more: str) -> str:
    return lines(
        lit(f"{D.short_name} MULTI-VARIANT FEASIBILITY — {title} (SDC-APPLIED)"), lit("=" * 72),
        line("Study: {study_id} | variants assessed: {members}"), line("Purpose: {purpose}"),
        line("Released union carrier ceiling: {combined_client_total}"), "''", lit("Disclosure control"), lit(f"- min cell {M}; rounded to {B}."),
        lit("- Per-variant and overlap counts are withheld because they can expose intersections or complements by differencing against the union."),
        "''", lit("Interpretation"), lit("- The figure is genotype feasibility before phenotype eligibility."),
        lit("- The pseudonymised carrier set remains internal for epidemiology review."), *more,
    )


BATCH_RESPONSES = [
    line(f"- Illustrative response at {int(rate * 100)}%: {{e}}", e=estimate("combined_client_total", rate)) for rate in RESPONSE_RATES
]
ORACLE["batch_notes"] = with_ctes(f"""SELECT batch_id, {BATCH_NEUTRAL} AS neutral, {batch_memo('RESEARCH NOTE')} AS research,
  {batch_memo('CLIENT PLANNING MEMO', *BATCH_RESPONSES)} AS commercial FROM o_batch WHERE status = 'accepted'""", "o_batch")

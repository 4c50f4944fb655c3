"""Reference SQL of the driver queries, written for DuckDB over the raw tables.

Input views share their column expressions with :mod:`driver_views`; everything after the inputs is
written here a second time, in SQL.
"""

from __future__ import annotations

from cohortgate.fixed_values import DIGEST_KEYS, FORBIDDEN_KEYS
from cohortgate.fixed_values import (
    AUTOSOMES,
    CONTIG_LENGTHS,
    GATES,
    INTERNAL_COLUMNS,
    MAX_COUNT,
    Z95,
)
from cohortgate.operators import counts, requests, results
from cohortgate.plans import driver_views as dv
from cohortgate.plans.reader_queries import DICTIONARIES
from cohortgate.plans.queries import EMAIL, FILE_ROWS, LIST_ENTRIES, LIST_HEADERS, LIST_LINES, POLICY_ROWS

P = dv.POLICY
M, B = P.sdc_min_cell, P.sdc_round_to
KEY = "cpra, requested_source, carrier_definition"
HIGH, COND = "array_direct_high_confidence", "imputed_supported_conditional"

ORACLE: dict[str, str] = {}
CTES: dict[str, str] = {}


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sel(expressions: dict[str, str], source: str, extra: str = "") -> str:
    listed = ", ".join(f'{sql} AS "{name}"' for name, sql in expressions.items())
    return f"SELECT {extra}{listed} FROM {source}"


def rounded(n: str) -> str:
    return f"CAST(round_even(({n}) / {B}.0, 0) * {B} AS BIGINT)"


def hidden(n: str) -> str:
    return f"(({n}) < {M} OR {rounded(n)} < {M})"


def small(n: str) -> str:
    return f"(({n}) > 0 AND {hidden(n)})"


def token(n: str) -> str:
    return f"CASE WHEN {hidden(n)} THEN '<{M}' ELSE concat('~', {rounded(n)}) END"


def estimate(tok: str, rate: float) -> str:
    n = f"TRY_CAST(CASE WHEN starts_with({tok}, '~') THEN substr({tok}, 2) END AS BIGINT)"
    est = rounded(f"round_even({n} * {rate}e0, 0)")
    return f"CASE WHEN {n} >= {M} AND {est} >= {M} THEN concat('~', {est}) ELSE '<{M}' END"


def codes(rules: list[tuple[str, str]], sep: str = ",") -> str:
    """Codes of the conditions that hold, joined in order; empty text for none."""
    cases = ", ".join(f"CASE WHEN {bad} THEN {lit(code)} END" for code, bad in rules)
    return f"concat_ws('{sep}', {cases})"


def with_ctes(body: str, *names: str, using: dict[str, str] | None = None) -> str:
    """``body`` with all CTEs that it needs; ``using`` replaces the text of some."""
    wanted: list[str] = []

    def need(name: str) -> None:
        for other in CTES:
            if other != name and other in CTES[name].split("--deps:")[-1].split():
                need(other)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        need(name)
    texts = {n: CTES[n].split("--deps:")[0] for n in wanted} | (using or {})
    return "WITH " + ",\n".join(f"{n} AS ({texts[n]})" for n in wanted) + "\n" + body


def cte(name: str, sql: str, *deps: str) -> None:
    CTES[name] = sql + "\n--deps:" + " ".join(deps)


def oracle(name: str, sql: str, *ctes: str) -> None:
    ORACLE[name] = with_ctes(sql, *ctes) if ctes else sql


# --- inputs ----------------------------------------------------------------------------------

cte("v_participants", sel(dv.PARTICIPANTS, "customer"))
cte("v_sample_qc", sel(dv.SAMPLE_QC, "customer"))
cte("v_wide", "SELECT *, concat(chrom, ':', pos, ':', ref, ':', alt) AS cpra FROM (" + sel(dv.WIDE_SITES, "part") + ") s")


def _genotype_ctes(name: str, site: str) -> None:
    """The long genotype table ``name`` in which a lineitem is a call of the variant of part ``site``."""
    cte(f"{name}_cell", f"""SELECT k, v, concat('P', lpad(CAST(k AS VARCHAR(20)), 9, '0')) AS participant_id, mo, q, dmin, tmin,
  {dv.CELL_GT} AS gt
  FROM (SELECT o_custkey AS k, {site} AS v, min(l_orderkey) AS mo, max(l_quantity) AS q,
        min(l_discount) AS dmin, min(l_tax) AS tmin
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, {site}) c""")
    cte(name, f"""SELECT g.*, m.cpra FROM (
  SELECT participant_id, v, 'array' AS source, CAST(gt AS DOUBLE) AS gt_code, q AS gq, 1e0 - dmin / 2e0 AS call_rate,
    CAST(NULL AS DOUBLE) AS dosage, CAST(NULL AS DOUBLE) AS max_gp FROM {name}_cell WHERE (k + v) % 5 <> 0
  UNION ALL SELECT participant_id, v, 'imputed', NULL, NULL, NULL, {dv.DOSAGE}, 1e0 - tmin * 2e0 FROM {name}_cell
) g JOIN v_wide m ON g.v = m.k""", f"{name}_cell", "v_wide")


_genotype_ctes("v_genotype", dv.CALLED_SITE)
_genotype_ctes("v_chip", dv.CHIP_SITE)
cte("v_requests", f"""SELECT r.*, m.cpra, m.chrom, m.pos, m.ref, m.alt FROM ({sel(dv.REQUESTS, "part")}) r
  JOIN v_wide m ON r.v = m.k""", "v_wide")


def preflight(source: str, bases: str, panel: str) -> str:
    """Trim, match and orient; ``source`` has request_id, cpra, chrom, pos, ref, alt, build, observed_maf."""
    return f"""
  SELECT q.*, CASE WHEN on38 THEN NULL WHEN on37 THEN 'build_mismatch_grch37'
      WHEN base38 IS NOT NULL THEN 'reference_mismatch' END AS preflight_reject,
    CASE WHEN on38 THEN 'GRCh38' ELSE build END AS build_resolved, on38 AS ref_matched,
    concat_ws('|',
      CASE WHEN normalized_cpra <> cpra THEN concat('Normalized ', cpra, ' -> ', normalized_cpra, ' (parsimonious left-aligned form).') END,
      CASE WHEN on38 THEN concat('Client request is a CPRA (', chrom, ':', n_pos, ':...) with no explicit genome build; GRCh38 confirmed by REF-to-reference match (REF ''', n_ref, ''').')
        ELSE concat('Reference base for ', chrom, ':', n_pos, ' not in the mock reference; build ', build, ' asserted by CPRA convention, NOT reference-matched — verify against in-TRE FASTA.') END,
      CASE WHEN strand = 'unresolved' THEN concat(n_ref, '/', n_alt, ' is a palindromic (strand-ambiguous) SNP and its strand could NOT be resolved by allele-frequency concordance (cohort MAF ', coalesce(CAST(observed_maf AS VARCHAR), 'None'), ', panel ', coalesce(CAST(panel_maf AS VARCHAR), 'None'), '); orientation is provisional — confirm against the array assay design before recall.')
        WHEN strand <> 'n/a' THEN concat(n_ref, '/', n_alt, ' is a palindromic SNP; strand resolved as ', strand, ' by allele-frequency concordance (cohort MAF ', CAST(observed_maf AS VARCHAR), ' concords with the reference panel ', CAST(panel_maf AS VARCHAR), ').') END
    ) AS caveats, strand = 'unresolved' AS ambiguous
  FROM (
    SELECT p.*, pm.panel_maf, b38.base AS base38,
      coalesce(b38.base = left(n_ref, 1), false) AS on38, coalesce(b37.base = left(n_ref, 1), false) AS on37,
      (n_ref || n_alt) IN ('CG', 'GC', 'AT', 'TA') AS is_palindromic,
      CASE WHEN (n_ref || n_alt) NOT IN ('CG', 'GC', 'AT', 'TA') THEN 'n/a'
        WHEN observed_maf IS NULL OR pm.panel_maf IS NULL THEN 'unresolved'
        WHEN abs(observed_maf - 0.5e0) < 0.05e0 OR abs(pm.panel_maf - 0.5e0) < 0.05e0 THEN 'unresolved'
        WHEN abs(abs(observed_maf - pm.panel_maf) - abs(observed_maf - (1.0e0 - pm.panel_maf))) < 0.05e0 THEN 'unresolved'
        WHEN abs(observed_maf - pm.panel_maf) <= abs(observed_maf - (1.0e0 - pm.panel_maf)) THEN 'forward'
        ELSE 'reverse' END AS strand
    FROM (SELECT *, concat(chrom, ':', n_pos, ':', n_ref, ':', n_alt) AS normalized_cpra FROM ({trim(source)})) p
    LEFT JOIN (SELECT chrom, pos, max(base) AS base FROM {bases} WHERE build = 'GRCh38' GROUP BY chrom, pos) b38 ON p.chrom = b38.chrom AND p.n_pos = b38.pos
    LEFT JOIN (SELECT chrom, pos, max(base) AS base FROM {bases} WHERE build = 'GRCh37' GROUP BY chrom, pos) b37 ON p.chrom = b37.chrom AND p.n_pos = b37.pos
    LEFT JOIN {panel} pm ON p.normalized_cpra = pm.cpra
  ) q"""


def trim(source: str) -> str:
    def shared(a: str, b: str, cut: str) -> str:
        return (f"len(list_filter(range(1, least(length({a}), length({b}))), "
                f"lambda k: {cut}({a}, k) = {cut}({b}, k)))")

    return f"""SELECT *, pos + pre AS n_pos, substr(r1, pre + 1) AS n_ref, substr(a1, pre + 1) AS n_alt
    FROM (SELECT *, {shared('r1', 'a1', 'left')} AS pre
      FROM (SELECT *, left(upper(ref), length(ref) - suf) AS r1, left(upper(alt), length(alt) - suf) AS a1
        FROM (SELECT *, {shared('upper(ref)', 'upper(alt)', 'right')} AS suf FROM {source}) t0) t1) t2"""


cte("o_wide_trim", f"SELECT * FROM ({trim('v_wide')}) t", "v_wide")
cte("o_wide_bases", sel({"chrom": "chrom", "pos": "n_pos", **dv.WIDE_BASES},
    "(SELECT k AS p_partkey, chrom, n_pos, n_ref FROM o_wide_trim WHERE k % 7 <> 0) b"), "o_wide_trim")
cte("o_wide_panel", """SELECT concat(chrom, ':', n_pos, ':', n_ref, ':', n_alt) AS cpra, CAST(k * 37 % 997 AS DOUBLE) / 1000e0 AS panel_maf
    FROM o_wide_trim WHERE k % 4 <> 0""", "o_wide_trim")

# --- the evaluation --------------------------------------------------------------------------

def matched_sql(definition: str) -> str:
    return f"""SELECT r.*, m.on_array = 'TRUE' AS variant_on_array, m.on_imputed = 'TRUE' AS variant_on_imputed,
    TRY_CAST(m.dosage_r2 AS DOUBLE) AS variant_info,
    coalesce(TRY_CAST(m.array_maf AS DOUBLE), TRY_CAST(m.imputed_maf AS DOUBLE)) AS observed_maf,
    CASE WHEN r.carrier_definition <> '{definition}' THEN 'carrier_definition_mismatch'
      WHEN m.build <> r.build THEN 'build_mismatch' WHEN m.inaccurate_annotation = 'TRUE' THEN 'inaccurate_annotation'
      WHEN m.multiallelic_variant = 'TRUE' THEN 'multiallelic' END AS early_reject
    FROM v_requests r JOIN v_wide m ON r.cpra = m.cpra"""


cte("o_matched", matched_sql(P.carrier_definition), "v_requests", "v_wide")
cte("o_req", f"""SELECT *, coalesce(early_reject, preflight_reject) AS reject_reason,
    variant_on_array AND requested_source LIKE '%array%' AS use_array,
    coalesce(variant_on_imputed AND requested_source LIKE '%imputed%' AND variant_info >= {P.imputed_dr2_min}e0, false) AS use_imputed,
    coalesce(variant_info >= {P.imputed_dr2_high_confidence}e0, false) AS imp_high
    FROM ({preflight('o_matched', 'o_wide_bases', 'o_wide_panel')}) f""", "o_matched", "o_wide_bases", "o_wide_panel")
cte("o_eval", f"""SELECT DISTINCT {KEY}, chrom, variant_on_array, variant_on_imputed, variant_info, use_array, use_imputed, imp_high
    FROM o_req WHERE reject_reason IS NULL""", "o_req")
cte("o_sub", """SELECT p.participant_id, p.pseudo_id, p.consent_status, p.sex, p.ancestry_stub,
    p.consent_status = 'consented' AS consent_ok, q.sex_check_pass AS sex_check_ok, NOT q.kinship_flag AS kinship_ok
    FROM v_participants p LEFT JOIN v_sample_qc q USING (participant_id)""", "v_participants", "v_sample_qc")
cte("o_ev", """SELECT e.*, s.*, g.array_gt_code, g.array_gq, g.array_call_rate, g.imputed_dosage, g.imputed_max_gp
    FROM (SELECT participant_id, cpra, max(gt_code) AS array_gt_code, max(gq) AS array_gq, max(call_rate) AS array_call_rate,
        max(dosage) AS imputed_dosage, max(max_gp) AS imputed_max_gp FROM v_genotype GROUP BY participant_id, cpra) g
    JOIN o_sub s ON g.participant_id = s.participant_id JOIN o_eval e ON g.cpra = e.cpra""",
    "v_genotype", "o_sub", "o_eval")
def gate_sql(upper: str, codes: str) -> str:
    return f"""SELECT *, consent_ok AND ((array_credible AND array_alt) OR (imputed_credible AND dosage_ok)) AS included_by_configured_gates
  FROM (SELECT *, on_array AND annotation_reliable AND array_source_allowed AND has_array_gt AND call_rate_ok AND gq_ok AS array_credible,
    on_imputed AND annotation_reliable AND imputed_source_allowed AND dr2_ok AND has_imputed_dosage AND max_gp_ok AS imputed_credible
  FROM (SELECT *, variant_on_array AS on_array, variant_on_imputed AS on_imputed, true AS annotation_reliable,
    use_array AS array_source_allowed, use_imputed AS imputed_source_allowed,
    coalesce(array_gt_code <> -1, false) AS has_array_gt,
    coalesce(array_call_rate >= {P.array_call_rate_min}e0, false) AS call_rate_ok,
    coalesce(array_gq >= {P.array_gq_min}, false) AS gq_ok,
    imputed_dosage IS NOT NULL AS has_imputed_dosage,
    coalesce(variant_info >= {P.imputed_dr2_min}e0, false) AS dr2_ok,
    coalesce(imputed_max_gp >= {P.imputed_max_gp_min}e0, false) AS max_gp_ok,
    coalesce(imputed_dosage >= {P.imputed_dosage_carrier_threshold}e0{upper}, false) AS dosage_ok,
    coalesce(array_gt_code IN ({codes}), false) AS array_alt FROM o_ev) a) b"""


cte("o_gate", gate_sql("", "1, 2"), "o_ev")
cte("o_cls", f"""SELECT *, CASE WHEN inc THEN 'included' ELSE 'excluded' END AS decision,
    CASE WHEN NOT inc THEN 'NA' WHEN ea OR (ei AND imp_high) THEN 'high' ELSE 'conditional' END AS confidence,
    CASE WHEN NOT inc THEN 'NA' WHEN ea THEN 'array_direct' WHEN imp_high THEN 'imputed_high' ELSE 'imputed_conditional' END AS evidence_priority,
    CASE WHEN ea AND ei THEN 'array+imputed' WHEN ea THEN 'array' WHEN ei THEN 'imputed' ELSE 'none' END AS source,
    concat_ws(';', CASE WHEN array_gt_code = -1 THEN 'array_genotype_missing' END,
      CASE WHEN array_alt AND NOT array_credible AND array_call_rate < {P.array_call_rate_min}e0 THEN 'array_call_rate<{P.array_call_rate_min}'
        WHEN array_alt AND NOT array_credible AND array_gq < {P.array_gq_min} THEN 'array_GQ<{P.array_gq_min}' END,
      CASE WHEN dosage_ok AND imputed_max_gp < {P.imputed_max_gp_min}e0 THEN 'imputed_max_gp<{P.imputed_max_gp_min}' END,
      CASE WHEN NOT consent_ok THEN 'consent_withdrawn' END) AS reason,
    concat_ws(';', CASE WHEN NOT sex_check_ok THEN 'sample_sex_check_fail' END, CASE WHEN NOT kinship_ok THEN 'related_pair' END) AS flags
  FROM (SELECT *, included_by_configured_gates AS inc, array_alt AND array_credible AS ea, dosage_ok AND imputed_credible AS ei
    FROM o_gate WHERE array_alt OR dosage_ok) c""", "o_gate")
CELLS = """count(*) FILTER (WHERE decision = 'included' AND confidence = 'high') AS high_confidence,
    count(*) FILTER (WHERE decision = 'included' AND confidence = 'conditional') AS conditional,
    count(*) FILTER (WHERE decision = 'included') AS total, count(*) FILTER (WHERE decision = 'excluded') AS excluded,
    count(*) FILTER (WHERE decision = 'included' AND flags <> '') AS flagged"""
STRATUM = "coalesce(nullif(trim(ancestry_stub), ''), 'UNKNOWN')"
cte("o_cells", f"SELECT {KEY}, {CELLS} FROM o_cls GROUP BY {KEY}", "o_cls")
cte("o_strata", f"SELECT {KEY}, {STRATUM} AS stratum, count(*) AS n FROM o_cls WHERE decision = 'included' GROUP BY {KEY}, {STRATUM}", "o_cls")
DR2_STEPS = [P.imputed_dr2_min, (P.imputed_dr2_min + P.imputed_dr2_high_confidence) / 2, P.imputed_dr2_high_confidence]


def projected(dr2: float, high: float, gp: float, cr: float, gq: float) -> tuple[str, str]:
    array = f"(array_alt AND array_source_allowed AND has_array_gt AND coalesce(array_call_rate >= {cr}e0, false) AND coalesce(array_gq >= {gq}, false))"
    imputed = f"(dosage_ok AND imputed_source_allowed AND coalesce(variant_info >= {dr2}e0, false) AND has_imputed_dosage AND coalesce(imputed_max_gp >= {gp}e0, false))"
    included = f"(consent_ok AND ({array} OR {imputed}))"
    return included, f"({array} OR ({imputed} AND coalesce(variant_info >= {high}e0, false)))"


def _step(dr2: float) -> str:
    return projected(dr2, P.imputed_dr2_high_confidence, P.imputed_max_gp_min, P.array_call_rate_min, P.array_gq_min)[0]


cte("o_steps", f"SELECT {KEY}, " + ", ".join(
    f"count(*) FILTER (WHERE {_step(d)}) AS t{i}" for i, d in enumerate(DR2_STEPS)) + f" FROM o_cls GROUP BY {KEY}", "o_cls")
MOVES = f"((abs(t0 - t1) > 0 AND abs(t0 - t1) < {M}) OR (abs(t1 - t2) > 0 AND abs(t1 - t2) < {M}))"
cte("o_anc", f"""SELECT {KEY}, bool_or({small('n')}) AS ancestry_suppressed,
    string_agg(concat(stratum, ': ~', {rounded('n')}), ', ' ORDER BY stratum) AS listed FROM o_strata GROUP BY {KEY}""", "o_strata")
DR2_TEXT = f"""CASE WHEN NOT variant_on_imputed THEN 'Exact CPRA is absent from the imputed public variant list; imputed evidence is not used for this variant.'
    WHEN variant_info IS NULL THEN 'Imputed dosage r2 (DR2) is unavailable; imputed evidence is not counted.'
    WHEN variant_info < {P.imputed_dr2_min}e0 THEN concat('Imputed dosage r2 (DR2) = ', CAST(variant_info AS VARCHAR), ' (below configured floor {P.imputed_dr2_min}); imputed evidence is not counted without review or confirmatory genotyping.')
    ELSE concat('Imputed dosage r2 (DR2) = ', CAST(variant_info AS VARCHAR), ' (', CASE WHEN imp_high THEN 'high' ELSE 'moderate' END, '); imputed-only carriers are conditional and benefit from confirmatory genotyping.') END"""
CLOSING = ", ".join(lit(t) for t in results.CLOSING_LIMITATIONS)
ASSUMED = f"""concat_ws('|', concat('Carrier definition: ', carrier_definition, ' (>=1 alt allele ''', alt, ''').'),
    'Array QC: call_rate >= {P.array_call_rate_min}, GQ >= {P.array_gq_min}.',
    'Imputed evidence is used only when the exact CPRA is present in the imputed resource, variant dosage r2 (DR2) >= {P.imputed_dr2_min}, and per-participant max genotype probability >= {P.imputed_max_gp_min}.',
    'Consent gate: withdrawn participants excluded from any recontact set.')"""
cte("o_res", f"""SELECT *, {small('high_confidence')} OR {small('conditional')} AS breakdown_suppressed, {hidden('total')} AS total_suppressed,
    CASE WHEN NOT ({small('high_confidence')} OR {small('conditional')}) THEN {rounded('high_confidence')} END AS shown_high,
    CASE WHEN NOT ({small('high_confidence')} OR {small('conditional')}) THEN {rounded('conditional')} END AS shown_conditional,
    CASE WHEN accepted THEN {token('total')} END AS client_total,
    CASE WHEN accepted THEN {ASSUMED} END AS assumptions,
    CASE WHEN accepted THEN concat_ws('|', caveats,
      CASE WHEN NOT variant_on_array AND length(ref) <> length(alt) THEN {lit(results.INDEL_CAVEAT)} END, {DR2_TEXT}, {CLOSING}) END AS limitations
  FROM (SELECT r.*, r.reject_reason IS NULL AS accepted,
    {", ".join(f"CASE WHEN r.reject_reason IS NULL THEN coalesce(c.{n}, 0) END AS {n}" for n in ("high_confidence", "conditional", "total", "excluded", "flagged"))},
    CASE WHEN r.reject_reason IS NULL THEN coalesce(a.ancestry_suppressed, false) END AS ancestry_suppressed,
    CASE WHEN r.reject_reason IS NULL AND NOT coalesce(a.ancestry_suppressed, false) THEN coalesce(a.listed, '') END AS ancestry_breakdown,
    CASE WHEN r.reject_reason IS NULL THEN coalesce(({MOVES}), false) END AS sensitivity_suppressed,
    coalesce(t0, 0) AS t0, coalesce(t1, 0) AS t1, coalesce(t2, 0) AS t2
    FROM o_req r LEFT JOIN o_cells c USING ({KEY}) LEFT JOIN o_anc a USING ({KEY}) LEFT JOIN o_steps t USING ({KEY})) x""",
    "o_req", "o_cells", "o_anc", "o_steps")
cte("o_final_res", """SELECT *, CASE WHEN NOT accepted THEN NULL
    WHEN total = 0 THEN 'NO-GO — no eligible consented carriers identified at the applied QC thresholds.'
    WHEN conditional > 0 OR breakdown_suppressed OR starts_with(client_total, '<') THEN concat('GO WITH CAVEATS — a credible carrier pool exists, but ',
      concat_ws('; ', CASE WHEN conditional > 0 THEN 'part of the pool is imputed-supported (conditional confidence)' END,
        CASE WHEN breakdown_suppressed THEN 'the subgroup breakdown is suppressed under disclosure control' END,
        CASE WHEN starts_with(client_total, '<') THEN 'the total is below the disclosure-control minimum cell size' END), '.')
    ELSE 'GO — a credible high-confidence carrier pool exists; proceed to phenotype eligibility.' END AS recommendation FROM o_res""", "o_res")
cte("o_acc", "SELECT * FROM o_final_res WHERE accepted", "o_final_res")

oracle("client_totals", """SELECT request_id, study_id, cpra, CASE WHEN accepted THEN 'accepted' ELSE 'rejected' END AS status, reject_reason,
    client_total, breakdown_suppressed, total_suppressed, shown_high, shown_conditional FROM o_res""", "o_res")
oracle("result_rows", """SELECT request_id, total, high_confidence, conditional, excluded, flagged, ancestry_suppressed, ancestry_breakdown,
    sensitivity_suppressed, recommendation, assumptions, limitations FROM o_final_res""", "o_final_res")
for _name in ("candidate_table", "candidate_table_colocated"):
    oracle(_name, f"""SELECT {KEY}, participant_id, pseudo_id, consent_status, sex, ancestry_stub, array_gt_code, array_gq, array_call_rate,
    imputed_dosage, imputed_max_gp, sex_check_ok, kinship_ok FROM o_ev""", "o_ev")
_NO = "CAST(substr(participant_id, 2, 9) AS BIGINT)"
oracle("cohort_faults", f"""SELECT 'sample_qc: repeated' AS fault, participant_id, CAST(2 AS BIGINT) AS rows FROM v_sample_qc WHERE {_NO} % 47 = 4
    UNION ALL SELECT 'genotypes: repeated', participant_id, CAST(2 * count(*) AS BIGINT) FROM v_genotype WHERE {_NO} % 53 = 5 AND source = 'array' GROUP BY participant_id
    UNION ALL SELECT 'sample_qc: unknown participant', participant_id, CAST(1 + CAST({_NO} % 47 = 4 AS INT) AS BIGINT) FROM v_sample_qc WHERE {_NO} % 41 = 3
    UNION ALL SELECT 'genotypes: unknown participant', participant_id, CAST(sum(1 + CAST({_NO} % 53 = 5 AND source = 'array' AS INT)) AS BIGINT) FROM v_genotype
      WHERE {_NO} % 41 = 3 GROUP BY participant_id""", "v_sample_qc", "v_genotype")
oracle("gate_accounting", f"SELECT {KEY}, participant_id, {', '.join(GATES)} FROM o_gate", "o_gate")
_GATE_ROWS = [
    f"SELECT {KEY}, n AS total_rows, '{g}' AS gate, "
    + (f"CASE WHEN max_{g} THEN n ELSE 0 END" if g in counts.VARIANT_GATES
       else f"all_{g}" if g in counts.PARTICIPANT_GATES else f"coalesce(n_{g}, 0)")
    + " AS passing_rows FROM o_gate_wide" for g in GATES
]
cte("o_gate_wide", f"""SELECT e.*, g.*, s.*, variant_on_array AS max_on_array, variant_on_imputed AS max_on_imputed, true AS max_annotation_reliable,
    use_array AS max_array_source_allowed, use_imputed AS max_imputed_source_allowed, coalesce(variant_info >= {P.imputed_dr2_min}e0, false) AS max_dr2_ok
    FROM o_eval e LEFT JOIN (SELECT {KEY}, {", ".join(f"count(*) FILTER (WHERE {g}) AS n_{g}" for g in counts.CALL_GATES)} FROM o_gate GROUP BY {KEY}) g
      USING ({KEY}) CROSS JOIN (SELECT count(*) AS n, {", ".join(f"count(*) FILTER (WHERE {g}) AS all_{g}" for g in counts.PARTICIPANT_GATES)} FROM o_sub) s""",
    "o_eval", "o_gate", "o_sub")
oracle("gate_pass_counts", " UNION ALL ".join(_GATE_ROWS), "o_gate_wide")
oracle("classified_carriers", f"SELECT {KEY}, {', '.join(INTERNAL_COLUMNS)} FROM o_cls", "o_cls")
oracle("epi_handoff", f"""SELECT {KEY}, pseudo_id, 'carrier' AS carrier_status, source, confidence, evidence_priority,
    concat_ws('; ', CASE WHEN confidence = 'conditional' THEN concat('imputed-supported, DR2=', CAST(variant_info AS VARCHAR), ' (moderate)') END,
      nullif(flags, '')) AS caveat FROM o_cls WHERE decision = 'included'""", "o_cls")
oracle("evaluation_cells", "SELECT * FROM o_cells", "o_cells")


def _scenario_sql(s) -> str:
    inc, high = projected(*[s.value(f, P) for f in (
        "imputed_dr2_min", "imputed_dr2_high_confidence", "imputed_max_gp_min", "array_call_rate_min", "array_gq_min")])
    return f"""SELECT {KEY}, '{s.name}' AS scenario, count(*) FILTER (WHERE {inc} AND {high}) AS high_confidence,
      count(*) FILTER (WHERE {inc} AND NOT {high}) AS conditional, count(*) FILTER (WHERE {inc}) AS total,
      count(*) FILTER (WHERE NOT {inc}) AS excluded, count(*) FILTER (WHERE {inc} AND flags <> '') AS flagged FROM o_cls GROUP BY {KEY}"""


for _name in ("threshold_projection", "staged_projection"):
    oracle(_name, " UNION ALL ".join(_scenario_sql(s) for s in dv.SCENARIOS), "o_cls")
oracle("quality_sensitivity", " UNION ALL ".join(
    f"SELECT {KEY}, 'DR2 >= {d:.2f}' AS threshold, {MOVES} AS suppressed, CASE WHEN NOT {MOVES} THEN {token(f't{i}')} END AS client_total FROM o_steps"
    for i, d in enumerate(DR2_STEPS)), "o_steps")
oracle("ancestry_strata", "SELECT * FROM o_strata", "o_strata")
oracle("ancestry_sdc", f"""SELECT {KEY}, stratum, {rounded('n')} AS shown_n FROM o_strata JOIN o_anc USING ({KEY})
    WHERE NOT ancestry_suppressed""", "o_strata", "o_anc")
oracle("ancestry_verdicts", f"""SELECT {KEY}, coalesce(small_strata, 0) AS small_strata, total - coalesce(s, 0) AS unaccounted,
    coalesce(small_strata, 0) > 0 OR total <> coalesce(s, 0) AS ancestry_suppressed FROM o_cells LEFT JOIN
    (SELECT {KEY}, count(*) FILTER (WHERE {small('n')}) AS small_strata, CAST(sum(n) AS BIGINT) AS s FROM o_strata GROUP BY {KEY}) x USING ({KEY})""",
    "o_cells", "o_strata")
_MASK = "array_credible AND consent_ok"
oracle("hardcall_counts", f"""SELECT {KEY}, n_het, n_homalt, CASE WHEN carrier_definition = 'het_only' THEN n_het ELSE n_het + n_homalt END AS n_carrier
    FROM (SELECT {KEY}, count(*) FILTER (WHERE {_MASK} AND array_gt_code = 1) AS n_het,
      count(*) FILTER (WHERE {_MASK} AND array_gt_code = 2) AS n_homalt FROM o_gate GROUP BY {KEY}) x""", "o_gate")
oracle("reconciliation", f"""SELECT {KEY}, h AS hardcall_carriers, coalesce(d, 0) AS array_direct_carriers, h = coalesce(d, 0) AS agrees FROM
    (SELECT {KEY}, count(*) FILTER (WHERE {_MASK} AND array_gt_code IN (1, 2)) AS h FROM o_gate GROUP BY {KEY}) g LEFT JOIN
    (SELECT {KEY}, count(*) AS d FROM o_cls WHERE decision = 'included' AND evidence_priority = 'array_direct' GROUP BY {KEY}) c USING ({KEY})""",
    "o_gate", "o_cls")
oracle("batch_headers", """SELECT batch_id, count(*) AS members, arg_min(study_id, ordinal) AS study_id, arg_min(purpose, ordinal) AS purpose
    FROM v_requests GROUP BY batch_id""", "v_requests")
cte("o_pairs", f"""SELECT DISTINCT batch_id, participant_id, c.cpra AS cpra FROM o_cls c JOIN
    (SELECT DISTINCT batch_id, {KEY} FROM o_req WHERE reject_reason IS NULL) m USING ({KEY}) WHERE decision = 'included'""", "o_cls", "o_req")
cte("o_batch", f"""SELECT h.batch_id, study_id, purpose, members, CASE WHEN ok THEN 'accepted' ELSE 'rejected' END AS status,
    CASE WHEN ok THEN subject END AS subject, CASE WHEN ok THEN distinct_variants END AS distinct_variants,
    CASE WHEN ok THEN coalesce(u, 0) END AS combined_carriers, CASE WHEN ok THEN coalesce(o, 0) END AS overlap_carriers,
    CASE WHEN ok THEN {token('coalesce(u, 0)')} END AS combined_client_total, CASE WHEN ok THEN {token('coalesce(o, 0)')} END AS overlap_client,
    CASE WHEN ok THEN distinct_variants > 1 END AS breakdown_suppressed
  FROM (SELECT batch_id, count(*) AS members, arg_min(study_id, ordinal) AS study_id, arg_min(purpose, ordinal) AS purpose,
      bool_and(reject_reason IS NULL) AS ok FROM o_req GROUP BY batch_id) h
  LEFT JOIN (SELECT batch_id, count(*) AS distinct_variants, string_agg(cpra, '+' ORDER BY ordinal) AS subject FROM
      (SELECT batch_id, cpra, min(ordinal) AS ordinal FROM o_req WHERE reject_reason IS NULL GROUP BY batch_id, cpra) s GROUP BY batch_id) v USING (batch_id)
  LEFT JOIN (SELECT batch_id, count(*) AS u, count(*) FILTER (WHERE n >= 2) AS o FROM
      (SELECT batch_id, participant_id, count(*) AS n FROM o_pairs GROUP BY batch_id, participant_id) p GROUP BY batch_id) c USING (batch_id)""",
    "o_req", "o_pairs")
oracle("batch_union", "SELECT * FROM o_batch", "o_batch")
oracle("batch_variant_counts", "SELECT batch_id, cpra, count(*) AS included FROM o_pairs GROUP BY batch_id, cpra", "o_pairs")

# --- heterozygous carriers only --------------------------------------------------------------

_HET = {"o_matched": matched_sql("het_only"), "o_gate": gate_sql(" AND imputed_dosage < 1.5e0", "1")}
ORACLE["het_only_totals"] = with_ctes("""SELECT request_id, CASE WHEN accepted THEN 'accepted' ELSE 'rejected' END AS status, reject_reason, client_total,
    total, high_confidence, conditional, excluded FROM o_res""", "o_res", using=_HET)
ORACLE["het_only_carriers"] = with_ctes(f"SELECT {KEY}, {', '.join(INTERNAL_COLUMNS)} FROM o_cls", "o_cls", using=_HET)
ORACLE["het_only_hardcalls"] = with_ctes(f"""SELECT {KEY}, n_het, n_homalt, n_het AS n_carrier, n_het AS hardcall_carriers, n_het AS array_direct_carriers, true AS agrees
    FROM (SELECT {KEY}, count(*) FILTER (WHERE {_MASK} AND array_gt_code = 1) AS n_het,
      count(*) FILTER (WHERE {_MASK} AND array_gt_code = 2) AS n_homalt FROM o_gate GROUP BY {KEY}) x""", "o_gate", using=_HET)

# --- frequency -------------------------------------------------------------------------------

DIPLOID = f"chrom IN ({', '.join(lit(c) for c in AUTOSOMES)})"


def af(alt: str, n: str) -> str:
    return f"round_even(CAST({alt} AS DOUBLE) / CAST({n} AS DOUBLE), 5)"


def wilson(sign: str) -> str:
    n, p, z = "CAST(2 * c AS DOUBLE)", "(CAST(a AS DOUBLE) / CAST(2 * c AS DOUBLE))", f"{Z95}e0"
    z2 = f"{Z95 * Z95!r}e0"
    den = f"(1.0e0 + {z2} / {n})"
    mid = f"(({p} + {z2} / ({n} * 2)) / {den})"
    half = f"(({z} / {den}) * sqrt({p} * (1.0e0 - {p}) / {n} + {z2} / ({n} * {n} * 4)))"
    inner = f"greatest(0.0e0, {mid} - {half})" if sign == "-" else f"least(1.0e0, {mid} + {half})"
    return f"round_even({inner}, 5)"


cte("o_freq", f"""SELECT {KEY}, sex, ancestry_stub, kinship_ok, count(*) FILTER (WHERE array_credible) AS c,
    coalesce(sum(CAST(array_gt_code AS BIGINT)) FILTER (WHERE array_credible), 0) AS a FROM o_gate WHERE {DIPLOID}
    GROUP BY {KEY}, sex, ancestry_stub, kinship_ok""", "o_gate")
cte("o_kinds", """SELECT 'overall' AS stratum_kind, 'all' AS stratum UNION ALL SELECT DISTINCT 'sex', sex FROM o_sub WHERE sex IS NOT NULL
    UNION ALL SELECT DISTINCT 'ancestry', ancestry_stub FROM o_sub WHERE ancestry_stub IS NOT NULL""", "o_sub")
cte("o_freq_strata", f"""SELECT {KEY}, 'overall' AS stratum_kind, 'all' AS stratum, CAST(sum(c) AS BIGINT) AS c, CAST(sum(a) AS BIGINT) AS a FROM o_freq GROUP BY {KEY}
    UNION ALL SELECT {KEY}, 'sex', sex, CAST(sum(c) AS BIGINT), CAST(sum(a) AS BIGINT) FROM o_freq WHERE sex IS NOT NULL GROUP BY {KEY}, sex
    UNION ALL SELECT {KEY}, 'ancestry', ancestry_stub, CAST(sum(c) AS BIGINT), CAST(sum(a) AS BIGINT) FROM o_freq WHERE ancestry_stub IS NOT NULL GROUP BY {KEY}, ancestry_stub""", "o_freq")
oracle("allele_frequency", f"""SELECT {KEY}, stratum_kind, stratum, c AS n_callable_samples, CASE WHEN c >= {M} THEN a END AS alt_alleles, c < {M} AS suppressed,
    CASE WHEN c = 0 THEN 'no callable typed samples' WHEN c < {M} THEN 'below min cell (internal discipline)' END AS reason,
    CASE WHEN c >= {M} THEN 2 * c END AS callable_alleles, CASE WHEN c >= {M} THEN {af('a', '(2 * c)')} END AS af,
    CASE WHEN c >= {M} THEN {wilson('-')} END AS ci95_low, CASE WHEN c >= {M} THEN {wilson('+')} END AS ci95_high
  FROM (SELECT e.cpra, e.requested_source, e.carrier_definition, stratum_kind, stratum, coalesce(c, 0) AS c, coalesce(a, 0) AS a
    FROM (SELECT * FROM o_eval WHERE {DIPLOID}) e CROSS JOIN o_kinds LEFT JOIN o_freq_strata f USING ({KEY}, stratum_kind, stratum)) x""",
    "o_eval", "o_kinds", "o_freq_strata")
_DELTA = f"round_even(abs(full_af - unrelated_only_af), 5)"
oracle("frequency_control", f"""SELECT {KEY}, chrom, NOT {DIPLOID} AS ploidy_guard, full_af, unrelated_only_af,
    CASE WHEN {DIPLOID} THEN coalesce(nc, 0) END AS n_compared, CASE WHEN {DIPLOID} THEN coalesce(dc, 0) END AS discordant_calls, {_DELTA} AS af_delta,
    CASE WHEN NOT {DIPLOID} THEN concat('chrom ', chrom, ' is non-autosomal; diploid AF not computed (ploidy guard)')
      WHEN {_DELTA} IS NULL THEN 'AF stability could not be assessed after removing related samples'
      WHEN {_DELTA} = 0 THEN 'AF unchanged when related samples are removed'
      ELSE concat('AF differs by ', printf('%.5f', {_DELTA}), ' when related samples are removed; review for possible clustering') END AS note
  FROM (SELECT {KEY}, chrom, nc, dc, CASE WHEN {DIPLOID} AND c >= {M} THEN {af('a', '(2 * c)')} END AS full_af,
      CASE WHEN {DIPLOID} AND uc >= {M} THEN {af('ua', '(2 * uc)')} END AS unrelated_only_af
    FROM o_eval LEFT JOIN (SELECT {KEY}, count(*) FILTER (WHERE array_credible) AS c, count(*) FILTER (WHERE array_credible AND kinship_ok) AS uc,
        CAST(sum(CASE WHEN array_credible THEN array_gt_code ELSE 0 END) AS BIGINT) AS a,
        CAST(sum(CASE WHEN array_credible AND kinship_ok THEN array_gt_code ELSE 0 END) AS BIGINT) AS ua,
        count(*) FILTER (WHERE array_credible AND imputed_dosage IS NOT NULL) AS nc,
        count(*) FILTER (WHERE array_credible AND imputed_dosage IS NOT NULL AND (array_gt_code >= 1) <> (imputed_dosage >= {P.imputed_dosage_carrier_threshold}e0)) AS dc
      FROM o_gate GROUP BY {KEY}) f USING ({KEY})) x""", "o_eval", "o_gate")
_U = "list_sort(list_transform(range(1000), lambda d: ('0x' || substr(md5('42:' || d), 1, 13))::BIGINT::DOUBLE / 4503599627370496e0))"


def _share(times: str, count: str) -> str:
    power = f"CASE WHEN {count} > 0 THEN {times} * ln({count}::DOUBLE / n) WHEN {times} > 0 THEN '-infinity'::DOUBLE ELSE 0e0 END"
    return f"({power} - lgamma({times} + 1))"


oracle("bootstrap_interval", f"""SELECT {KEY}, round_even((a + (b - a) * {0.025 * 999 - 24!r}e0) / (2 * n)::DOUBLE, 5) AS ci95_low,
    round_even((c + (d - c) * {0.975 * 999 - 974!r}e0) / (2 * n)::DOUBLE, 5) AS ci95_high FROM
  (SELECT {KEY}, sum(n0) AS m FROM (SELECT {KEY}, count(*) AS n0 FROM o_gate WHERE {DIPLOID} GROUP BY {KEY}) e GROUP BY {KEY}) k LEFT JOIN
  (SELECT {KEY}, n, min(t) FILTER (below >= us[25]) AS a, min(t) FILTER (below >= us[26]) AS b, min(t) FILTER (below >= us[975]) AS c, min(t) FILTER (below >= us[976]) AS d FROM
    (SELECT {KEY}, n, t, sum(p) OVER (PARTITION BY {KEY} ORDER BY t) AS below FROM
      (SELECT {KEY}, n, x1 + 2 * x2 AS t, sum(exp(lgamma(n + 1) + {_share('(n - x1 - x2)', 'n0')} + {_share('x1', 'n1')} + {_share('x2', 'n2')})) AS p FROM
        (SELECT *, unnest(range(0, CASE WHEN n1 > 0 THEN n - x2 + 1 ELSE 1 END)) AS x1 FROM
          (SELECT *, unnest(range(0, CASE WHEN n2 > 0 THEN n + 1 ELSE 1 END)) AS x2 FROM
            (SELECT {KEY}, count(*) FILTER (WHERE array_credible) AS n, count(*) FILTER (WHERE array_credible AND array_gt_code = 0) AS n0,
              count(*) FILTER (WHERE array_credible AND array_gt_code = 1) AS n1, count(*) FILTER (WHERE array_credible AND array_gt_code = 2) AS n2
              FROM o_gate WHERE {DIPLOID} GROUP BY {KEY}) g WHERE n >= {M}) h) i GROUP BY ALL) j) l, (SELECT {_U} AS us) v GROUP BY {KEY}, n) q USING ({KEY})""", "o_gate")
oracle("cohort_totals", """SELECT count(*) AS n_participants, count(*) FILTER (WHERE consent_ok) AS all_consent_ok,
    count(*) FILTER (WHERE sex_check_ok) AS all_sex_check_ok, count(*) FILTER (WHERE kinship_ok) AS all_kinship_ok,
    count(*) FILTER (WHERE sex IS NULL) AS missing_sex, count(*) FILTER (WHERE ancestry_stub IS NULL) AS missing_ancestry,
    count(*) FILTER (WHERE NOT kinship_ok) AS n_related FROM o_sub""", "o_sub")
oracle("array_allele_frequency", """SELECT cpra, n_called, alt_alleles, CASE WHEN n_called > 0 THEN CAST(alt_alleles AS DOUBLE) / CAST(2 * n_called AS DOUBLE) END AS array_af
    FROM (SELECT cpra, count(*) FILTER (WHERE gt_code >= 0) AS n_called, CAST(coalesce(sum(gt_code) FILTER (WHERE gt_code >= 0), 0) AS BIGINT) AS alt_alleles
    FROM v_genotype WHERE source = 'array' GROUP BY cpra) x""", "v_genotype")

# --- wide ------------------------------------------------------------------------------------

_PREPARED = ", ".join(f"{sql} AS {name}" for name, sql in dv.WIDE_PREPARED.items())
cte("v_wide_requests", sel(dv.WIDE_REQUESTS, f"""(SELECT *, {_PREPARED} FROM (SELECT l.*, (l_orderkey * 7 + l_linenumber) % 40 AS c,
    w.cpra, w.chrom, w.pos, w.ref, w.alt FROM lineitem l JOIN v_wide w ON l.l_partkey = w.k) j) p"""), "v_wide")
_LENGTH = "CASE chrom " + " ".join(f"WHEN '{c}' THEN {n}" for c, n in CONTIG_LENGTHS.items()) + " END"
_VIOLATIONS = [
    ("bad_cpra_format", r"NOT regexp_matches(cpra, '^(?:\d{1,2}|X|Y|MT):\d+:[ACGT]+:[ACGT]+$')"),
    ("invalid_chromosome", f"{_LENGTH} IS NULL"),
    ("pos_not_positive", "pos < 1"),
    ("bad_build", "build <> 'GRCh38'"),
    ("bad_carrier_definition", "carrier_definition NOT IN ('het_and_homalt', 'het_only')"),
    ("bad_requested_source", "requested_source NOT IN ('array', 'imputed', 'array_and_imputed')"),
    ("missing_study_or_purpose", "study_id IS NULL OR purpose IS NULL"),
    ("cpra_inconsistent", "cpra <> concat(chrom, ':', pos, ':', ref, ':', alt)"),
    ("ref_equals_alt", "ref = alt"),
    ("pos_beyond_contig", f"pos > {_LENGTH}"),
    ("carrier_definition_mismatch", f"carrier_definition <> '{P.carrier_definition}'"),
]
oracle("request_violations", f"SELECT request_id, cpra, {codes(_VIOLATIONS)} AS violations FROM v_wide_requests", "v_wide_requests")
cte("o_wide", """SELECT r.*, w.build AS m_build, w.on_array = 'TRUE' AS oa, w.on_imputed = 'TRUE' AS oi, TRY_CAST(w.dosage_r2 AS DOUBLE) AS info,
    coalesce(TRY_CAST(w.array_maf AS DOUBLE), TRY_CAST(w.imputed_maf AS DOUBLE)) AS observed_maf,
    CASE WHEN w.cpra IS NULL THEN 'not_in_manifest' WHEN w.build <> r.build THEN 'build_mismatch'
      WHEN w.ref <> r.ref OR w.alt <> r.alt THEN 'allele_mismatch' WHEN w.inaccurate_annotation = 'TRUE' THEN 'inaccurate_annotation'
      WHEN w.multiallelic_variant = 'TRUE' THEN 'multiallelic' END AS manifest_reject
    FROM v_wide_requests r LEFT JOIN v_wide w ON r.cpra = w.cpra""", "v_wide_requests", "v_wide")
oracle("manifest_checks", "SELECT request_id, cpra, manifest_reject, observed_maf FROM o_wide", "o_wide")
oracle("source_availability", f"""SELECT request_id, cpra, ra AS requested_array, ri AS requested_imputed, a AS array_available, i AS imputed_available,
    NOT ra OR a AS array_requested_available, NOT ri OR i AS imputed_requested_available, (NOT ra OR a) AND (NOT ri OR i) AS requested_sources_available,
    concat_ws('|', CASE WHEN ra AND NOT a THEN {lit(requests.ARRAY_ABSENT)} END, CASE WHEN ri AND NOT i THEN {lit(requests.IMPUTED_ABSENT)} END) AS source_caveats
  FROM (SELECT request_id, cpra, requested_source IN ('array', 'array_and_imputed') AS ra, requested_source IN ('imputed', 'array_and_imputed') AS ri,
    coalesce(oa, false) AS a, coalesce(oi, false) AS i FROM o_wide) x""", "o_wide")
oracle("source_decision", f"""SELECT request_id, cpra, info AS variant_info,
    coalesce(oa AND requested_source IN ('array', 'array_and_imputed'), false) AS use_array,
    coalesce(oi AND requested_source IN ('imputed', 'array_and_imputed') AND info >= {P.imputed_dr2_min}e0, false) AS use_imputed,
    coalesce(info >= {P.imputed_dr2_high_confidence}e0, false) AS imp_high FROM o_wide""", "o_wide")
oracle("identifiability_overlay", """SELECT cpra, CASE WHEN k % 4 = 3 THEN on_array WHEN k % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END AS on_array,
    CASE WHEN k % 4 = 3 THEN on_imputed WHEN k % 8 = 0 THEN 'TRUE' ELSE 'FALSE' END AS on_imputed,
    CASE WHEN k % 4 = 3 THEN inaccurate_annotation WHEN k % 16 = 1 THEN 'TRUE' ELSE 'FALSE' END AS inaccurate_annotation, dosage_r2 FROM v_wide""", "v_wide")
for _list in ("array", "imputed"):
    _entries = " UNION ALL ".join(
        f"SELECT {place} AS place, k, cpra, {flag} AS flag FROM v_wide WHERE {held}" for place, held, flag in LIST_ENTRIES[_list])
    cte(f"v_{_list}_list", f"SELECT *, row_number() OVER (ORDER BY place) + 1 AS line FROM ({_entries}) x", "v_wide")
    cte(f"o_{_list}_hits", f"""SELECT cpra, arg_max(flag, line) AS flag, max(line) AS line FROM v_{_list}_list
    WHERE k % 97 <> 3 GROUP BY cpra""", f"v_{_list}_list")
oracle("variant_list_membership", """SELECT t.cpra, CASE WHEN a.line IS NOT NULL THEN 'TRUE' ELSE 'FALSE' END AS on_array,
    CASE WHEN i.line IS NOT NULL THEN 'TRUE' ELSE 'FALSE' END AS on_imputed,
    CASE WHEN coalesce(upper(trim(a.flag)) = 'YES', false) OR coalesce(upper(i.flag) = 'TRUE', false) THEN 'FALSE' ELSE 'TRUE' END AS annotation_reliable,
    'test release' AS source_release,
    concat(CASE WHEN a.line IS NULL THEN 'array resource: no exact CPRA hit' ELSE concat('array resource line ', a.line, ': exact CPRA present; Inaccurate Call=', a.flag) END, '; ',
      CASE WHEN i.line IS NULL THEN 'imputed resource: no exact CPRA hit' ELSE concat('imputed resource line ', i.line, ': exact CPRA present; inaccurate.annotation=', i.flag) END) AS evidence
  FROM (SELECT DISTINCT cpra FROM v_wide_requests) t LEFT JOIN o_array_hits a ON t.cpra = a.cpra
    LEFT JOIN o_imputed_hits i ON t.cpra = i.cpra""", "v_wide_requests", "o_array_hits", "o_imputed_hits")
oracle("variant_list_stop", """SELECT cpra, flag, line, upper(trim(flag)) <> 'YES' AS reliable FROM
    (SELECT cpra, arg_max(flag, line) AS flag, max(line) AS line FROM (SELECT *, max(first) OVER () AS stop FROM
      (SELECT *, min(line) OVER (PARTITION BY cpra) AS first FROM v_array_list WHERE k % 97 <> 3) a) b WHERE line <= stop GROUP BY cpra) c""", "v_array_list")
cte("o_lines", " UNION ALL ".join(
    f"""SELECT '{file}' AS file, '{member}' AS member, 1 AS line, '{LIST_HEADERS[name]}' AS value UNION ALL
    SELECT '{file}', '{member}', line, CASE WHEN k % 97 = 3 THEN 'cut' ELSE {LIST_LINES[name]} END FROM v_{name}_list"""
    for name, file, member in (("array", "array", "array"), ("imputed", "imputed.zip", "imputed.csv"))), "v_array_list", "v_imputed_list")
oracle("position_search", """SELECT file, count(*) FILTER (WHERE contains(value, '1048290')) AS hits,
    count(*) FILTER (WHERE contains(value, '1048290') AND contains(replace(replace(value, chr(9), ':'), ',', ':'), '2:1048290:CG:C')) AS exact_hits FROM o_lines GROUP BY file""", "o_lines")
oracle("position_sample", """SELECT file, member, line, value FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line) AS place FROM o_lines
    WHERE contains(value, '829')) x WHERE place <= 12""", "o_lines")
oracle("allele_trim", f"SELECT request_id, cpra, n_pos AS pos, n_ref AS ref, n_alt AS alt FROM ({trim('v_wide_requests')}) t", "v_wide_requests")
oracle("build_and_strand", f"""SELECT request_id, cpra, normalized_cpra, build_resolved, ref_matched, is_palindromic, strand, ambiguous,
    preflight_reject, caveats FROM ({preflight('o_wide', 'o_wide_bases', 'o_wide_panel')}) f""", "o_wide", "o_wide_bases", "o_wide_panel")
_RULES = [
    ("consent_gate_off", "NOT require_consent"),
    ("threshold_outside_unit_interval", "NOT (array_call_rate_min BETWEEN 0 AND 1 AND imputed_dr2_min BETWEEN 0 AND 1 AND imputed_dr2_high_confidence BETWEEN 0 AND 1 AND imputed_max_gp_min BETWEEN 0 AND 1)"),
    ("dosage_threshold_outside_0_2", "NOT imputed_dosage_carrier_threshold BETWEEN 0 AND 2"),
    ("negative_gq", "array_gq_min < 0"),
    ("min_cell_below_floor", "sdc_min_cell < 5"),
    ("high_dr2_below_floor", "imputed_dr2_high_confidence < imputed_dr2_min"),
    ("round_to_not_divisor", "CASE WHEN sdc_round_to <= 0 THEN true ELSE sdc_min_cell % sdc_round_to <> 0 END"),
    ("bad_carrier_definition", "carrier_definition NOT IN ('het_and_homalt', 'het_only')"),
]
oracle("policy_rules", f"SELECT p_partkey, {codes(_RULES)} AS policy_violations FROM ({sel(POLICY_ROWS, 'part', 'p_partkey, ')}) p")
_TOKEN = r"coalesce(nullif(upper(regexp_replace(regexp_replace({0}, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), ''), 'REQUEST')"
oracle("request_tokens", f"""SELECT c_custkey, {_TOKEN.format("c_name || '#'")} AS token, concat('DEMO-', {_TOKEN.format('c_mktsegment')}, '-GENE') AS study_id,
    replace(lower(trim(replace(c_name, '#', '_'))), '_', ' ') AS label FROM customer""")

# --- integrity and catalogue -----------------------------------------------------------------

oracle("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
oracle("unmatched_left", "SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
cte("v_genes", sel(dv.GENES, "supplier"))
cte("v_gene_variants", "SELECT concat('G', l_suppkey) AS symbol, l_partkey AS variant_id, min(l_orderkey) AS ordinal FROM lineitem GROUP BY l_suppkey, l_partkey")
oracle("gene_span_check", """SELECT g.symbol, gv.variant_id, w.chrom, w.pos, g.chrom AS g_chrom FROM v_gene_variants gv JOIN v_wide w ON gv.variant_id = w.k
    JOIN v_genes g ON gv.symbol = g.symbol WHERE NOT (w.chrom = g.chrom AND w.pos BETWEEN g.start AND g."end")""", "v_gene_variants", "v_wide", "v_genes")
oracle("gene_span_members", """SELECT w.cpra, g.symbol FROM v_wide w JOIN v_genes g ON w.chrom = g.chrom AND w.pos BETWEEN g.start AND g."end" """, "v_wide", "v_genes")
oracle("unknown_references", "SELECT concat('G', c_custkey) AS symbol, c_custkey FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
oracle("gene_variant_requests", """SELECT concat('STUDY-', s_suppkey) AS study_id, gv.symbol, gv.ordinal, w.cpra, 'GRCh38' AS build, 'het_and_homalt' AS carrier_definition
    FROM supplier JOIN v_gene_variants gv ON gv.symbol = concat('G', s_suppkey) JOIN v_wide w ON gv.variant_id = w.k""", "v_gene_variants", "v_wide")
oracle("panel_variants", """SELECT concat('STUDY-', n_nationkey) AS study_id, panel, gene_ordinal, variant_ordinal, cpra FROM
    (SELECT lower(trim(n_name)) AS panel, n_nationkey, variant_id, s_suppkey AS gene_ordinal, ordinal AS variant_ordinal,
      row_number() OVER (PARTITION BY n_nationkey, variant_id ORDER BY s_suppkey, ordinal) AS rn
     FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN v_gene_variants ON symbol = concat('G', s_suppkey)) x
    JOIN v_wide w ON x.variant_id = w.k WHERE rn = 1""", "v_gene_variants", "v_wide")
cte("v_regions", sel(dv.REGIONS, "supplier"))
oracle("region_lookup", """SELECT r.request_id, r.cpra, d.region FROM v_wide_requests r LEFT JOIN (SELECT DISTINCT w.cpra, g.region FROM v_wide_requests w JOIN v_regions g
    ON w.chrom = g.chrom AND w.pos BETWEEN g.start AND g."end") d ON r.cpra = d.cpra""", "v_wide_requests", "v_regions")
oracle("region_spans", """SELECT chrom, greatest(0, min(pos) - 1000) AS start, max(pos) + 1000 AS "end", 'b0001' AS region FROM v_wide GROUP BY chrom""", "v_wide")
oracle("locus_sorted", """SELECT cpra, CASE chrom WHEN 'X' THEN 23 WHEN 'Y' THEN 24 WHEN 'MT' THEN 25 ELSE CAST(chrom AS INT) END AS chrom_rank, pos
    FROM v_wide ORDER BY 2, pos, cpra""", "v_wide")

# --- results for readers ---------------------------------------------------------------------

oracle("recruitment_funnel", f"""SELECT request_id, 1 AS step_no, 'Genotype carrier ceiling' AS step, client_total AS value, 'released SDC-applied genotype count' AS basis FROM o_acc
    UNION ALL SELECT request_id, 2, 'Phenotype eligibility', 'downstream aggregate return', 'ICD-10 / linked-record review, not inferred in the genotype MVP' FROM o_acc
    UNION ALL SELECT request_id, 3, 'Illustrative response at 25%', {estimate('client_total', 0.25)}, 'planning assumption applied only to the released SDC token' FROM o_acc
    UNION ALL SELECT request_id, 4, 'Illustrative response at 50%', {estimate('client_total', 0.5)}, 'planning assumption applied only to the released SDC token' FROM o_acc""", "o_acc")
oracle("portfolio", f"""SELECT request_id, study_id, cpra, purpose, client_total, CASE WHEN breakdown_suppressed THEN 'suppressed' ELSE 'shown' END AS breakdown,
    variant_on_array, recommendation, {M} AS min_cell FROM o_acc""", "o_acc")
oracle("factsheet", f"""SELECT request_id, study_id, cpra, build, requested_source, variant_on_array, variant_on_imputed, client_total, breakdown_suppressed,
    CASE WHEN breakdown_suppressed THEN '' ELSE concat('{HIGH}=', shown_high, ',{COND}=', shown_conditional) END AS reported_cells,
    {M} AS min_cell, {B} AS round_to, recommendation, CAST(4 AS BIGINT) AS assumptions, limitations FROM o_acc""", "o_acc")
oracle("funnel_view", """SELECT request_id, 1 AS step_no, 'Candidate rows' AS step, CAST(total + excluded AS VARCHAR) AS count, false AS client_visible, 'Internal slice after request/manifest validation' AS note FROM o_acc
    UNION ALL SELECT request_id, 2, 'Excluded before recontact', CAST(excluded AS VARCHAR), false, 'Consent/QC/source failures retained internally as reason codes' FROM o_acc
    UNION ALL SELECT request_id, 3, 'Included genotype carriers', CAST(total AS VARCHAR), false, 'Internal exact count before disclosure control' FROM o_acc
    UNION ALL SELECT request_id, 4, 'Client count', client_total, true, 'SDC-applied token in the airlock export candidate' FROM o_acc""", "o_acc")
oracle("source_decision_view", " UNION ALL ".join(
    f"SELECT request_id, '{name}' AS \"check\", {value} AS value FROM o_acc" for name, value in [
        ("Requested source", "requested_source"), ("Variant on array", "CAST(variant_on_array AS VARCHAR)"),
        ("Array evidence used", "CAST(use_array AS VARCHAR)"), ("Imputed evidence used", "CAST(use_imputed AS VARCHAR)"),
        ("Imputed DR2", "CASE WHEN variant_on_imputed THEN CAST(variant_info AS VARCHAR) ELSE 'not used' END"),
    ]), "o_acc")
oracle("decision_breakdown", f"""SELECT {KEY}, decision, CASE WHEN reason <> '' THEN reason WHEN decision = 'included' THEN 'included' ELSE 'no_credible_evidence' END AS reason,
    count(*) AS count FROM o_cls GROUP BY ALL""", "o_cls")
oracle("decision_tiers", f"SELECT {KEY}, decision, confidence, evidence_priority, count(*) AS count FROM o_cls GROUP BY ALL", "o_cls")
oracle("disclosure_view", " UNION ALL ".join(
    f"SELECT request_id AS candidate_id, '{name}' AS field, {value} AS value FROM o_acc" for name, value in [
        ("client_total", "client_total"), ("breakdown_suppressed", "CAST(breakdown_suppressed AS VARCHAR)"),
        ("reported_cells", "CASE WHEN breakdown_suppressed THEN '0' ELSE '2' END"), ("min_cell", f"'{M}'"), ("round_to", f"'{B}'"),
        ("ancestry_suppressed", "CAST(ancestry_suppressed AS VARCHAR)"),
    ]), "o_acc")
oracle("markdown_reports", f"""SELECT request_id, concat_ws(chr(10), concat('# Genotype feasibility — ', study_id), '',
    concat('**Variant:** `', cpra, '` (build ', build, '); carrier = ', carrier_definition), concat('**Purpose:** ', purpose), '', '## Recommendation', concat('> ', recommendation), '',
    '## Eligible genotype carriers (consented, QC-passed)', '', '| Metric | Value (SDC-applied) |', '|---|---|', concat('| Approximate count | ', client_total, ' |'),
    CASE WHEN breakdown_suppressed THEN '| Subgroup breakdown | suppressed (a subgroup below the minimum cell size) |'
      ELSE concat('| Array-direct (high confidence) | ~', shown_high, ' |', chr(10), '| Imputed-supported (conditional) | ~', shown_conditional, ' |') END,
    CASE WHEN ancestry_suppressed THEN '| Ancestry breakdown | suppressed (a per-ancestry stratum below the minimum) |'
      WHEN ancestry_breakdown <> '' THEN concat('| Ancestry breakdown | ', ancestry_breakdown, ' |') END,
    '', '## Method', concat('- ', replace(assumptions, '|', concat(chr(10), '- '))), '', '## Caveats', concat('- ', replace(limitations, '|', concat(chr(10), '- '))), '',
    '_Disclosure control: min cell {M}, rounding to {B}; secondary suppression applied. The export is the authorised release payload._') AS note FROM o_acc""", "o_acc")

# --- release ---------------------------------------------------------------------------------

cte("v_cand", sel(dv.CANDIDATES, "orders", "o_orderkey AS k, "))
_DUP = "coalesce(label1 = label2, false)"
# A later cell of the same label replaces the first.
_C1, _C2 = f"(label1 IS NOT NULL AND NOT {_DUP})", "(label2 IS NOT NULL)"
_TOTAL_SAFE = """CASE WHEN starts_with(client_total, '<') THEN client_total = concat('<', min_cell)
    WHEN starts_with(client_total, '~') THEN coalesce(TRY_CAST(substr(client_total, 2) AS BIGINT) % round_to = 0 AND TRY_CAST(substr(client_total, 2) AS BIGINT) >= min_cell, false)
    ELSE false END"""
oracle("release_predicate", "SELECT candidate_id, " + codes([
    ("duplicate released subgroup cell labels", _DUP),
    ("a released subgroup cell count is negative", "(label1 IS NOT NULL AND count1 < 0) OR (label2 IS NOT NULL AND count2 < 0)"),
    ("a released subgroup cell is below the minimum cell size",
     f"({_C1} AND count1 > 0 AND count1 < min_cell) OR ({_C2} AND count2 > 0 AND count2 < min_cell)"),
    ("breakdown suppressed but subgroup cells released (back-calculation risk)", "breakdown_suppressed AND (label1 IS NOT NULL OR label2 IS NOT NULL)"),
    ("a released cell is not a multiple of the rounding base", f"({_C1} AND count1 % round_to <> 0) OR ({_C2} AND count2 % round_to <> 0)"),
    ("the released total is neither the suppression token nor a rounded value", f"NOT ({_TOTAL_SAFE})"),
], "; ") + " AS release_reasons FROM v_cand", "v_cand")
_CPRA_OK = (r"""len(string_split(cpra, '+')) <= 16 AND len(list_filter(string_split(cpra, '+'), lambda x: NOT (regexp_full_match(x, '([1-9]|1[0-9]|2[0-2]|X|Y|MT):[1-9][0-9]{0,9}:[ACGT]{1,64}:[ACGT]{1,64}')))) = 0""")
_TOTAL_MAP = rf"(client_total = '<{M}' OR (regexp_full_match(client_total, '~(0|[1-9][0-9]{{0,9}})') AND TRY_CAST(substr(client_total, 2) AS BIGINT) <= {MAX_COUNT}))"
_MALFORMED = [
    ("policy_disagrees", f"min_cell <> {M} OR round_to <> {B}"),
    ("bad_subject", f"NOT ({_CPRA_OK})"),
    ("bad_total", f"NOT {_TOTAL_MAP}"),
    ("unknown_label", f"label1 NOT IN ('{HIGH}', '{COND}') OR label2 NOT IN ('{HIGH}', '{COND}')"),
    ("duplicate_label", _DUP),
    ("bad_count", f"(label1 IS NOT NULL AND NOT count1 BETWEEN 0 AND {MAX_COUNT}) OR (label2 IS NOT NULL AND NOT count2 BETWEEN 0 AND {MAX_COUNT})"),
    ("suppressed_with_cells", "breakdown_suppressed AND (label1 IS NOT NULL OR label2 IS NOT NULL)"),
]


def shown_ok(label: str, n: str) -> str:
    return f"({label} IS NULL OR (({n} = 0 OR {n} >= {M}) AND {n} % {B} = 0))"


_N = "TRY_CAST(substr(client_total, 2) AS BIGINT)"
_OK = f"(client_total = '<{M}' OR ({_N} >= {M} AND {_N} % {B} = 0)) AND {shown_ok('label1', 'count1')} AND {shown_ok('label2', 'count2')}"
SCHEMA = dv.DEPLOYMENT.release_schema


def _cell_json(n: int) -> str:
    return f"""'{{"label":"' || label{n} || '","count":' || count{n} || '}}'"""


def _cells_json() -> str:
    return f"concat('[', concat_ws(',', {_cell_json(1)}, {_cell_json(2)}), ']')"


cte("o_judged", f"""SELECT *, CASE WHEN malformed <> '' THEN NULL ELSE
      concat('{{"schema":"{SCHEMA}","policy":{{"min_cell":{M},"round_to":{B}}},"candidate":{{"subject_id":"', cpra, '","total":',
        CASE WHEN client_total = '<{M}' THEN '{{"tag":"suppressed"}}' ELSE concat('{{"tag":"shown","n":', substr(client_total, 2), '}}') END, ',"breakdown":',
        CASE WHEN breakdown_suppressed THEN '{{"tag":"suppressed"}}' ELSE concat('{{"tag":"shown","cells":', {_cells_json()}, '}}') END, '}}}}') END AS request_text,
    CASE WHEN verdict = 'released' THEN concat('{{"schema":"{SCHEMA}","status":"released","policy":{{"min_cell":{M},"round_to":{B}}},"subject_id":"', cpra, '","total":"', client_total,
      '","breakdown":', CASE WHEN breakdown_suppressed THEN 'null' ELSE {_cells_json()} END, '}}') END AS payload
  FROM (SELECT *, CASE WHEN malformed <> '' THEN 'malformed' WHEN {_OK} THEN 'released' ELSE 'rejected' END AS verdict
    FROM (SELECT *, {codes(_MALFORMED)} AS malformed FROM v_cand) a) b""", "v_cand")
oracle("release_language", "SELECT candidate_id, malformed FROM o_judged", "o_judged")
oracle("release_verdict", "SELECT candidate_id, verdict FROM o_judged", "o_judged")
oracle("release_payload", "SELECT candidate_id, request_text, payload FROM o_judged", "o_judged")
_RP = dv.RELEASE_POLICY
cte("o_receipts", f"""SELECT k, candidate_id, '{SCHEMA}' AS schema, '{_RP.policy_id}' AS policy_id, '{_RP.version}' AS policy_version, '{_RP.policy_sha256}' AS policy_sha256,
    sha256(request_text) AS request_sha256, sha256(concat(payload, chr(10))) AS payload_sha256, request_text, payload FROM o_judged WHERE verdict = 'released'""", "o_judged")
oracle("release_receipt", "SELECT candidate_id, schema, policy_id, policy_version, policy_sha256, request_sha256, payload_sha256 FROM o_receipts", "o_receipts")
oracle("retained_requests", "SELECT DISTINCT request_sha256, request_text FROM o_receipts", "o_receipts")
_BAD_PAYLOAD = "(hp AND k % 13 = 0 AND contains(payload, '~'))"
oracle("release_check", "SELECT candidate_id, failures, failures = '' AS ok FROM (SELECT candidate_id, " + codes([
    ("payload_without_receipt", "hp AND NOT hr"), ("receipt_without_payload", "hr AND NOT hp"),
    ("payload_digest_mismatch", f"hr AND {_BAD_PAYLOAD}"), ("no_ledger_record", "hr AND k % 19 = 0"),
    ("receipt_differs_from_ledger", "hr AND k % 19 <> 0 AND k % 23 = 0"),
    ("retained_request_missing", "hr AND NOT kept"),
    ("replay_mismatch", f"hr AND kept AND {_BAD_PAYLOAD}"),
]) + """ AS failures FROM (SELECT *, k % 11 <> 0 AS hp, k % 7 <> 0 AS hr,
    request_sha256 IN (SELECT request_sha256 FROM o_receipts WHERE k % 29 <> 0) AS kept FROM o_receipts) r WHERE hp OR hr) x""", "o_receipts")
oracle("current_generation", """SELECT study_id AS subject, k AS attempt, verdict, CASE WHEN verdict <> 'released' THEN 'refused'
    WHEN k = max(k) OVER (PARTITION BY study_id) THEN 'current' ELSE 'history' END AS generation FROM o_judged""", "o_judged")
cte("o_request_release", f"""SELECT request_id AS candidate_id, CASE WHEN starts_with(client_total, '<') OR total >= 0 THEN 'released' END AS verdict,
    concat('{{"schema":"{SCHEMA}","status":"released","policy":{{"min_cell":{M},"round_to":{B}}},"subject_id":"', cpra, '","total":"', client_total, '","breakdown":',
      CASE WHEN breakdown_suppressed THEN 'null' ELSE concat('[{{"label":"{HIGH}","count":', shown_high, '}},{{"label":"{COND}","count":', shown_conditional, '}}]') END, '}}') AS payload FROM o_acc""", "o_acc")
oracle("request_release", "SELECT * FROM o_request_release", "o_request_release")
oracle("batch_release", f"""SELECT batch_id AS candidate_id, 'released' AS verdict, concat('{{"schema":"{SCHEMA}","status":"released","policy":{{"min_cell":{M},"round_to":{B}}},"subject_id":"', subject, '","total":"', combined_client_total,
    '","breakdown":', CASE WHEN breakdown_suppressed THEN 'null' ELSE '[]' END, '}}') AS payload FROM o_batch WHERE status = 'accepted'""", "o_batch")
cte("v_files", sel(FILE_ROWS, "lineitem", "l_orderkey, "))
_EXPORT = "classification = 'AIRLOCK-EXPORT-CANDIDATE'"
oracle("export_manifest", f"""SELECT *, files_described_and_inspectable AND exports_readable AS technically_feasible,
    CASE WHEN exports <> 1 THEN 'not_exactly_one_export' WHEN NOT exports_readable THEN 'export_not_human_readable' WHEN NOT exports_classified THEN 'export_wrong_class' END AS manifest_reject
  FROM (SELECT l_orderkey, count(*) FILTER (WHERE export_to_client) AS exports, bool_and(NOT export_to_client OR human_readable) AS exports_readable,
    bool_and(NOT export_to_client OR {_EXPORT}) AS exports_classified,
    bool_and(trim(file) <> '' AND NOT contains(file, '/') AND trim(reason) <> '') AS files_described_and_inspectable,
    max(CASE WHEN export_to_client THEN file END) AS export_file FROM v_files GROUP BY l_orderkey) x""", "v_files")
oracle("governance_view", f"""SELECT l_orderkey, count(*) FILTER (WHERE export_to_client) AS exports, count(*) FILTER (WHERE export_to_client) = 1 AS single_export,
    max(CASE WHEN export_to_client THEN file END) AS airlock_export_file, coalesce(bool_or(export_to_client AND NOT {_EXPORT}), false) AS participant_level_outputs_exported
    FROM v_files GROUP BY l_orderkey""", "v_files")
oracle("batch_export_files", """SELECT DISTINCT batch_id, CAST(1 AS BIGINT) AS exports, true AS exports_readable, true AS exports_classified, true AS files_described_and_inspectable,
    'release.json' AS export_file, true AS technically_feasible, CAST(NULL AS VARCHAR) AS manifest_reject FROM v_requests""", "v_requests")

# --- final figures ---------------------------------------------------------------------------

_RUN = """concat('RUN-', left(sha256(concat('{"cpra": "', cpra, '", "study_id": "', study_id, '"}')), 12))"""
oracle("run_ids", f"""SELECT request_id, {_RUN} AS run_id, concat('RUN-', left(sha256(concat('{{"config_sha256": "c0ffee", "cpra": "', cpra, '", "input_sha256": {{"a": "', batch_id,
    '", "b": "22"}}, "study_id": "', study_id, '"}}')), 12)) AS bound_run_id FROM v_requests""", "v_requests")
cte("v_returns", sel(dv.RETURNS, "part"))
cte("o_ret", "SELECT a.*, x.*, " + codes([
    ("run_id_mismatch", "bad_run"), ("not_signed", "sign_off_status <> 'signed'"),
    ("missing_phenotype_metadata", "phenotype_definition_id = '' OR icd10_codeset_label = ''"),
    ("negative_count", "eligible_count < 0"), ("above_ceiling", "eligible_count > total"),
    ("contains_identifier", "contains(reviewer, 'PSU-')"),
]) + " AS return_violations FROM o_acc a JOIN v_returns x ON a.study_id = x.study_id", "o_acc", "v_returns")
oracle("return_checks", "SELECT request_id, return_violations FROM o_ret", "o_ret")
cte("v_check", sel(dv.CHECKPOINTS, "part"))
oracle("blocked_finals", """SELECT request_id, checkpoint, decision FROM v_requests r JOIN v_check c ON r.study_id = c.study_id
    WHERE decision IN ('block', 'query')""", "v_requests", "v_check")
cte("o_finals", f"""SELECT request_id, cpra, total AS genotype_total_included, eligible_count AS post_phenotype_eligible, {token('total')} AS client_genotype_ceiling,
    {token('eligible_count')} AS client_eligible, {hidden('eligible_count')} AS eligible_suppressed,
    CASE WHEN eligible_count = 0 THEN 'NO-GO — no phenotype-eligible carriers remain after ICD-10 assessment.'
      WHEN {hidden('eligible_count')} THEN 'GO WITH CAVEATS — eligible carriers exist but the count is below the disclosure-control minimum; treat as a small pool.'
      ELSE 'GO — a phenotype-eligible carrier pool exists; proceed to recruitment planning.' END AS final_recommendation,
    concat_ws('|', 'The genotype count is an UPPER BOUND (ceiling); the post-phenotype eligible count is the figure for recruitment after ICD-10 assessment by epidemiology.',
      concat('Phenotype: ', phenotype_definition_id, ' (ICD-10 cardiac v1); linked-record scope: hospital episodes.'),
      concat('Epidemiology sign-off: ', reviewer, ' at ', return_timestamp, '.'), caveat,
      'Disclosure control (min cell {M}, round to {B}) applied to both the genotype ceiling and the post-phenotype eligible count.') AS final_caveats
  FROM o_ret WHERE return_violations = '' AND study_id NOT IN (SELECT study_id FROM v_check WHERE decision IN ('block', 'query'))""", "o_ret", "v_check")
oracle("final_result", "SELECT * EXCLUDE (cpra) FROM o_finals", "o_finals")
oracle("final_release", f"""SELECT request_id AS candidate_id, 'released' AS verdict, concat('{{"schema":"{SCHEMA}","status":"released","policy":{{"min_cell":{M},"round_to":{B}}},"subject_id":"', cpra, '","total":"', client_eligible,
    '","breakdown":null}}') AS payload FROM o_finals""", "o_finals")

# --- audit -----------------------------------------------------------------------------------

_PSEUDO, _PERSON, _NUMBER = r"(?i)\bPSU-[0-9A-F]{6,}\b", r"(?i)\bP\d{4,}\b", r"\b\d{3}\s?\d{3}\s?\d{4}\b"


def hits(pattern: str) -> str:
    return f"len(regexp_extract_all(text, {lit(pattern)}))"


oracle("identifier_scan_documents", f"""SELECT * FROM (SELECT doc_id, {hits(_PSEUDO)} AS pseudo_id, {hits(_PERSON)} AS participant_id, {hits(_NUMBER)} AS health_number,
    {hits(EMAIL)} AS email FROM documents) x WHERE pseudo_id + participant_id + health_number + email > 0""")
oracle("identifier_scan_conversations", f"""SELECT role, count(*) AS turns, count(*) FILTER (WHERE regexp_matches(text, {lit(_PSEUDO)}) OR regexp_matches(text, {lit(_PERSON)})
    OR regexp_matches(text, {lit(_NUMBER)})) AS with_identifier, count(*) FILTER (WHERE regexp_matches(text, {lit(EMAIL)})) AS with_email FROM conversations GROUP BY role""")
cte("o_json", r"""SELECT event_id, event_type, concat('{"event_id":', event_id, ',"props":', props, CASE WHEN event_id % 97 = 0 THEN ',"nested":[{"Participant_ID_hash":1}]'
    WHEN event_id % 89 = 0 THEN ',"note":"seen PSU-00AB12 today"' WHEN event_id % 83 = 0 THEN ',"input_sha256":{"a":{"b":["PSU-00AB12"]},"c":"P000000001"}'
    WHEN event_id % 79 = 0 THEN ',"note":"seen\nPSU-00AB12"' WHEN event_id % 73 = 0 THEN ',"note":"id\tP000000001"' WHEN event_id % 71 = 0 THEN ',"note":"\u0050SU-00AB12"'
    WHEN event_id % 67 = 0 THEN ',"git_commit":[{"participant\u005fid":1}]' ELSE ',"text":"a \"pseudo_id\": quoted"' END, '}') AS j FROM events""")
oracle("identifier_scan_events", f"""SELECT DISTINCT event_id, event_type FROM (SELECT event_id, event_type, t.key, t.fullkey, t.type, json_extract_string(t.atom, '$') AS text
    FROM o_json, json_tree(o_json.j) t) n WHERE regexp_matches(lower(key), '{"|".join(FORBIDDEN_KEYS)}')
    OR (type = 'VARCHAR' AND NOT regexp_matches(fullkey, '[.]"?({"|".join(DIGEST_KEYS)})"?([.[]|$)')
      AND (regexp_matches(text, {lit(_PSEUDO)}) OR regexp_matches(text, {lit(_PERSON)}) OR regexp_matches(text, {lit(_NUMBER)})))""", "o_json")
cte("o_leaves", """SELECT event_id AS seq, sha256(concat(chr(0), '{"event_type":"', event_type, '","id":', event_id, ',"props":', to_json(props), ',"user_id":', user_id, '}')) AS leaf FROM events""")
oracle("event_leaves", "SELECT * FROM o_leaves", "o_leaves")
ORACLE["event_root"] = f"""WITH RECURSIVE o_leaves AS ({CTES['o_leaves'].split('--deps:')[0]}),
  walk AS (SELECT 0 AS depth, list(leaf ORDER BY seq) AS level FROM o_leaves
    UNION ALL SELECT depth + 1, list_transform(range(0, len(level), 2), lambda i: sha256(unhex(concat('01', level[i + 1], coalesce(level[i + 2], level[i + 1])))))
      FROM walk WHERE len(level) > 1)
  SELECT level[1] AS root FROM walk WHERE len(level) = 1"""
ORACLE["ledger_appends"] = f"""WITH RECURSIVE o_leaves AS ({CTES['o_leaves'].split('--deps:')[0]}),
  sizes AS (SELECT unnest([count(*) // 3, 2 * count(*) // 3 + 1, count(*)]) AS total FROM o_leaves),
  walk AS (SELECT total, list(leaf ORDER BY seq) AS level FROM sizes JOIN o_leaves ON seq < total GROUP BY total
    UNION ALL SELECT total, list_transform(range(0, len(level), 2), lambda i: sha256(unhex(concat('01', level[i + 1], coalesce(level[i + 2], level[i + 1])))))
      FROM walk WHERE len(level) > 1)
  SELECT total, level[1] AS root, true AS consistent, CAST(bit_count(total) AS BIGINT) AS peaks FROM walk WHERE len(level) = 1"""
oracle("ledger_sequence", "SELECT count(*) AS events, min(event_id) = 0 AND max(event_id) = count(*) - 1 AND count(DISTINCT event_id) = count(*) AS dense FROM events")
oracle("ledger_checks", "SELECT seq, leaf FROM o_leaves WHERE seq % 1009 = 5 OR seq % 1013 = 7", "o_leaves")

# --- VCF text --------------------------------------------------------------------------------

cte("o_array_grid", """SELECT s.participant_id, m.cpra, coalesce(g.gt_code, -1) AS gt_code FROM (SELECT DISTINCT participant_id FROM v_chip WHERE source = 'array') s
    CROSS JOIN (SELECT DISTINCT cpra FROM v_chip WHERE source = 'array') m LEFT JOIN (SELECT * FROM v_chip WHERE source = 'array') g
    ON g.participant_id = s.participant_id AND g.cpra = m.cpra""", "v_chip")
oracle("vcf_array_scan", "SELECT * FROM o_array_grid", "o_array_grid")
cte("o_gp", """SELECT s.participant_id, m.cpra, coalesce(g.dosage, 0e0) AS d, coalesce(g.max_gp, 1e0) AS mg FROM (SELECT DISTINCT participant_id FROM v_chip WHERE source = 'imputed') s
    CROSS JOIN (SELECT DISTINCT cpra FROM v_chip WHERE source = 'imputed') m LEFT JOIN (SELECT * FROM v_chip WHERE source = 'imputed') g
    ON g.participant_id = s.participant_id AND g.cpra = m.cpra""", "v_chip")
cte("o_gp3", """SELECT *, CASE WHEN b = 1 THEN top WHEN b = 0 THEN rest ELSE rest END AS p1, CASE WHEN b = 2 THEN top ELSE 0e0 END AS p2 FROM
    (SELECT *, round_even(mg, 3) AS top, round_even(1e0 - mg, 3) AS rest, CAST(greatest(0, least(2, round_even(d, 0))) AS INT) AS b FROM o_gp) x""", "o_gp")
oracle("vcf_imputed_scan", "SELECT participant_id, cpra, round_even(p1 + p2 * 2, 4) AS dosage, greatest(top, rest) AS max_gp FROM o_gp3", "o_gp3")
ORACLE["vcf_genotypes"] = with_ctes("""SELECT a.participant_id, a.cpra, 'array' AS source, a.gt_code, 99e0 AS gq, q.array_call_rate AS call_rate, CAST(NULL AS DOUBLE) AS dosage, CAST(NULL AS DOUBLE) AS max_gp
    FROM o_array_grid a LEFT JOIN v_sample_qc q ON a.participant_id = q.participant_id WHERE a.cpra IN (SELECT cpra FROM v_requests)
    UNION ALL SELECT participant_id, cpra, 'imputed', NULL, NULL, NULL, round_even(p1 + p2 * 2, 4), greatest(top, rest) FROM o_gp3 WHERE cpra IN (SELECT cpra FROM v_requests)""",
    "o_array_grid", "v_sample_qc", "v_requests", "o_gp3")
ORACLE["vcf_array_export"] = with_ctes("""SELECT a.cpra, sha256(concat(any_value(concat_ws(chr(9), m.chrom, m.pos, m.cpra, m.ref, m.alt, '.', '.', '.', 'GT')), chr(9),
    string_agg(CASE CAST(gt_code AS INT) WHEN 0 THEN '0/0' WHEN 1 THEN '0/1' WHEN 2 THEN '1/1' ELSE './.' END, chr(9) ORDER BY participant_id))) AS line_sha256
    FROM o_array_grid a JOIN v_wide m ON a.cpra = m.cpra GROUP BY a.cpra""", "o_array_grid", "v_wide")
ORACLE["vcf_imputed_export"] = with_ctes("""SELECT x.cpra, sha256(concat(any_value(concat_ws(chr(9), m.chrom, m.pos, m.cpra, m.ref, m.alt, '.', '.', '.', 'GT:GP')), chr(9),
    string_agg(concat(CASE b WHEN 0 THEN '0/0' WHEN 1 THEN '0/1' ELSE '1/1' END, ':', CAST(CASE WHEN b = 0 THEN top WHEN b = 1 THEN rest ELSE 0e0 END AS VARCHAR), ',', CAST(p1 AS VARCHAR), ',', CAST(p2 AS VARCHAR)), chr(9) ORDER BY participant_id))) AS line_sha256
    FROM o_gp3 x JOIN v_wide m ON x.cpra = m.cpra GROUP BY x.cpra""", "o_gp3", "v_wide")
cte("o_summary", """SELECT *, TRY_CAST(dosage_r2 AS DOUBLE) AS dr2, TRY_CAST(imputed_maf AS DOUBLE) AS af FROM v_wide WHERE on_imputed = 'TRUE'""", "v_wide")
oracle("vcf_summary_export", """SELECT cpra, concat_ws(chr(9), chrom, pos, cpra, ref, alt, '.', '.', concat('DR2=', CASE WHEN dosage_r2 IN ('NA', '') THEN '.' ELSE dosage_r2 END,
    ';AF=', imputed_maf, ';RAF=', CAST(round_even(1e0 - af, 4) AS VARCHAR), ';PROP_TYPED=', CASE WHEN on_array = 'TRUE' THEN '1.0' ELSE '0.0' END)) AS value FROM o_summary""", "o_summary")
cte("o_summary_rows", """SELECT cpra, chrom, pos, ref, alt, on_array = 'TRUE' AS on_array, true AS on_imputed, af AS array_maf, af AS imputed_maf, dr2 AS dosage_r2,
    'from_summary_stats' AS annotation FROM o_summary""", "o_summary")
oracle("vcf_summary_scan", "SELECT * FROM o_summary_rows", "o_summary_rows")
cte("o_array_rows", """SELECT w.cpra, any_value(w.chrom) AS chrom, any_value(w.pos) AS pos, any_value(w.ref) AS ref, any_value(w.alt) AS alt,
    CAST(sum(CASE WHEN g >= 0 THEN g ELSE 0 END) AS DOUBLE) / nullif(CAST(2 * count(*) FILTER (WHERE g >= 0) AS DOUBLE), 0) AS af
    FROM (SELECT l_partkey, (l_orderkey + l_linenumber) % 4 - 1 AS g FROM lineitem WHERE l_partkey % 8 <> 1) l JOIN v_wide w ON l.l_partkey = w.k GROUP BY w.cpra""", "v_wide")
oracle("vcf_manifest", """SELECT coalesce(s.cpra, a.cpra) AS cpra, coalesce(s.chrom, a.chrom) AS chrom, coalesce(s.pos, a.pos) AS pos, coalesce(s.ref, a.ref) AS ref, coalesce(s.alt, a.alt) AS alt,
    a.cpra IS NOT NULL OR coalesce(s.on_array, false) AS on_array, s.cpra IS NOT NULL AS on_imputed, CASE WHEN a.cpra IS NOT NULL THEN a.af ELSE s.array_maf END AS array_maf,
    s.imputed_maf, s.dosage_r2, coalesce(s.annotation, 'from_array_pvcf') AS annotation FROM o_summary_rows s FULL JOIN o_array_rows a ON s.cpra = a.cpra""", "o_summary_rows", "o_array_rows")
oracle("sample_qc_export", """SELECT participant_id, 'BATCH_DEMO_A01' AS genotyping_batch, 'v2' AS manifest_version, CASE WHEN sex = 'F' THEN 'F' ELSE 'M' END AS estimated_genetic_sex,
    array_call_rate AS call_rate, het_rate, sex_check_pass, ancestry_pc1, ancestry_pc2, kinship_flag FROM v_sample_qc q LEFT JOIN v_participants p USING (participant_id)""", "v_sample_qc", "v_participants")
oracle("sample_list_export", """SELECT participant_id, concat_ws(' ', participant_id, participant_id, '0', CASE WHEN NOT coalesce(known, false) OR coalesce(sex = 'M', false) THEN '1' ELSE '2' END) AS value
    FROM (SELECT DISTINCT participant_id FROM v_genotype WHERE source = 'array') g LEFT JOIN (SELECT *, true AS known FROM v_participants) p USING (participant_id)""", "v_genotype", "v_participants")
oracle("kinship_pairs", """SELECT id1, id2 FROM (SELECT min(participant_id) AS id1, max(participant_id) AS id2, count(*) AS n FROM
    (SELECT participant_id, (row_number() OVER (ORDER BY participant_id) - 1) // 2 AS pair FROM v_sample_qc WHERE kinship_flag) r GROUP BY pair) x WHERE n = 2""", "v_sample_qc")

# --- files read back, number texts, run events ------------------------------------------------

oracle("participants_read", "SELECT * FROM v_participants", "v_participants")
oracle("sample_qc_read", "SELECT participant_id, array_call_rate, het_rate, CAST(sex_check_pass AS VARCHAR) AS sex_check_pass, ancestry_pc1, ancestry_pc2, CAST(kinship_flag AS VARCHAR) AS kinship_flag FROM v_sample_qc", "v_sample_qc")
for _name in ("requests_read", "requests_read_json"):
    oracle(_name, "SELECT study_id, cpra, chrom, CAST(pos AS VARCHAR) AS pos, ref, alt, build, carrier_definition, requested_source, purpose FROM v_requests", "v_requests")
cte("v_sites", f"SELECT *, concat_ws(':', chrom, CAST(pos AS VARCHAR), ref, alt) AS cpra FROM ({sel(dv.WIDE_SITES, 'part')}) s")
oracle("manifest_read", "SELECT cpra, chrom, CAST(pos AS VARCHAR) AS pos, on_array, array_maf, nullif(dosage_r2, '') AS dosage_r2, inaccurate_annotation FROM v_sites", "v_sites")
oracle("identifiability_read", "SELECT cpra, on_array, on_imputed, 'TRUE' AS annotation_reliable, 'r1' AS source_release, concat('row ', CAST(k AS VARCHAR)) AS evidence FROM v_sites", "v_sites")
oracle("genotypes_read", "SELECT split_part(cpra, ':', 1) AS chrom, participant_id, cpra, source, gt_code, gq, call_rate, dosage, max_gp FROM v_genotype WHERE split_part(cpra, ':', 1) IN ('4', 'X')", "v_genotype")
oracle("genotypes_read_whole", "SELECT split_part(cpra, ':', 1) AS chrom, participant_id, cpra, source, gt_code, gq, call_rate, dosage, max_gp FROM v_genotype", "v_genotype")
oracle("number_texts", "SELECT l_orderkey, l_linenumber, format('{:.6g}', (CAST(l_extendedprice AS DOUBLE) + 1e0 / 3e0) * 1e-5 * ([" + ", ".join(f"1e{e}" for e in range(-9, 9))
       + "])[CAST(l_orderkey % 18 + 1 AS INT)]) AS six_digits, CAST(CAST(l_partkey AS DOUBLE) / 1e6 AS VARCHAR) AS shortest FROM lineitem")
cte("o_run_leaves", """SELECT ordinal AS seq, sha256(concat(chr(0), '{"actor_type":"workflow"', CASE WHEN ordinal % 3 = 0 THEN concat(',"airlock":{"payload":"', request_id, '"}') ELSE '' END,
    ',"config_sha256":"c0ffee","cpra":"', cpra, '","git_commit":"unknown","input_sha256":{"a":"1","z":"', study_id, '"},"output_sha256":{"release.json":"', request_id,
    '"},"parent_root":"","request_id":"', request_id, '","sdc":{"client_total":"<10"},"timestamp":"2026-01-01T00:00:00+00:00"}')) AS leaf FROM v_requests""", "v_requests")
oracle("run_event_leaves", "SELECT seq, leaf FROM o_run_leaves", "o_run_leaves")


def _prefix_roots(leaves: str) -> str:
    """Roots of all prefixes: nodes of every level, then one walk upward for each prefix."""
    return f"""RECURSIVE levels(depth, nodes) AS (
  SELECT 0, list(leaf ORDER BY seq) FROM {leaves}
  UNION ALL SELECT depth + 1, list_transform(range(1, len(nodes), 2), lambda i: sha256(unhex(concat('01', nodes[i], nodes[i + 1])))) FROM levels WHERE len(nodes) > 1
), walk(p, depth, below, acc) AS (
  SELECT seq + 1, 0, seq + 1, leaf FROM {leaves} WHERE seq + 1 < (SELECT count(*) FROM {leaves})
  UNION ALL SELECT p, w.depth + 1, (below + 1) // 2, sha256(unhex(concat('01', CASE WHEN below % 2 = 0 THEN l.nodes[below - 1] ELSE acc END, acc)))
  FROM walk w JOIN levels l ON l.depth = w.depth WHERE below > 1
), done AS (SELECT p AS seq, acc AS parent_root FROM walk WHERE below = 1 UNION ALL SELECT 0, sha256(unhex('01')))
"""


def _with_prefix_roots(body: str, leaves: str) -> str:
    first = with_ctes("", leaves).removeprefix("WITH ").strip()
    return f"WITH {_prefix_roots(leaves).replace('RECURSIVE ', f'RECURSIVE {first}, ', 1)} {body}"


ORACLE["event_parent_roots"] = _with_prefix_roots("SELECT seq, parent_root FROM done", "o_leaves")
ORACLE["run_event_parent_roots"] = _with_prefix_roots("SELECT seq, parent_root FROM done", "o_run_leaves")
ORACLE["broken_chain"] = _with_prefix_roots("SELECT seq, repeat('0', 64) AS parent_root FROM done WHERE seq % 11 = 4", "o_run_leaves")

_DICT = {name: f"({sel(columns, source)})" for name, (source, columns) in DICTIONARIES.items()}
ORACLE["dictionaries_read"] = f"""SELECT d.entity, d.name, d.title, d.units, c.code, c.meaning, c.display_order FROM {_DICT['data']} d LEFT JOIN {_DICT['coding']} c USING (coding_name)
    UNION ALL SELECT entity, NULL, description, NULL, NULL, NULL, NULL FROM {_DICT['entity']} e"""
oracle("shaped_read", """SELECT participant_id, cpra, source, CASE WHEN source = 'array' AND gq < 3 AND gt_code >= 0 THEN NULL ELSE gt_code END AS gt_code, gq, call_rate, dosage,
    CASE WHEN source = 'imputed' THEN greatest(1e0 - max_gp, max_gp, 0e0) END AS max_gp FROM v_genotype""", "v_genotype")
ORACLE["region_sample_qc_read"] = ORACLE["sample_qc_read"]
oracle("returns_read", f"""SELECT x.study_id, m.cpra, CASE WHEN bad_run THEN 'RUN-000000000000' ELSE {_RUN.replace("cpra,", "m.cpra,").replace("study_id,", "x.study_id,")} END AS run_id, eligible_count,
    phenotype_definition_id, icd10_codeset_label, icd10_codeset_version, linked_record_scope, reviewer, return_timestamp, sign_off_status, caveat AS caveats
    FROM v_returns x JOIN v_wide m ON x.v = m.k""", "v_returns", "v_wide")
oracle("checkpoints_read", """SELECT checkpoint, 'reviewer one' AS reviewer, '2026-01-01T00:00:00+00:00' AS timestamp, study_id AS artefacts_checked, decision,
    concat('line one', chr(10), 'of ', study_id) AS notes, CAST(NULL AS VARCHAR) AS follow_up_owner, 0 AS before FROM v_check""", "v_check")
ORACLE["ledger_read_leaves"] = ORACLE["run_event_leaves"]
oracle("run_notifications", f"""SELECT study_id, cpra, {_RUN} AS run_id, true AS received_timestamp, 'awaiting_review' AS workflow_state, 'recontact service' AS owner,
    '' AS due_date, '' AS eta, CAST(NULL AS VARCHAR) AS escalation_reason FROM v_requests""", "v_requests")

"""The engine's input tables, derived from the driver's parquet tables.

Every part is a variant, with its site, alleles and annotation made from its key; requests, returns
and reviews come from parts too, so variants and evaluations grow with the data. The *cohort* tables
(participants, genotypes, sample QC) come from customer, orders and lineitem. Parts of every fourth
key share four variants and the next ones fifty, so a few variants are asked for and called very often.
The *chip* maps all calls to sixteen variants, for file forms that hold a column per sample. The *wide*
requests come from lineitem and feed the operators that work on requests alone.

Expressions in this module are shared with the reference SQL, as text both engines accept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortgate import schemas
from cohortgate.operators import preflight, sizing
from cohortgate.plans.feasibility import Inputs
from cohortgate.policy import AnalysisPolicy, Deployment, ReleasePolicy, Scenario

POLICY = AnalysisPolicy()
HET_POLICY = AnalysisPolicy(carrier_definition="het_only")
DEPLOYMENT = Deployment()
RELEASE_POLICY = ReleasePolicy("sdc-default", "1", 10, 5, "0" * 64)

SCENARIOS = [
    Scenario("base"),
    Scenario("relaxed_gp", imputed_max_gp_min=0.60),
    Scenario("strict_dr2", imputed_dr2_min=0.90, imputed_dr2_high_confidence=0.95),
    Scenario("relaxed_array", array_call_rate_min=0.96, array_gq_min=10),
    Scenario("low_high_cut", imputed_dr2_high_confidence=0.50),
]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _select(df: DataFrame, expressions: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{sql} AS {name}" for name, sql in expressions.items()])


# --- cohort ----------------------------------------------------------------------------------

_PARTICIPANT_ID = "concat('P', lpad(CAST({k} AS VARCHAR(20)), 9, '0'))"

PARTICIPANTS = {
    "participant_id": _PARTICIPANT_ID.format(k="c_custkey"),
    "pseudo_id": "concat('PSU-', lpad(upper(hex(c_custkey)), 6, '0'))",
    "sex": "CASE WHEN c_custkey % 97 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END",
    "ancestry_stub": "CASE WHEN c_custkey % 307 = 0 THEN NULL ELSE c_mktsegment END",
    "consent_status": "CASE WHEN c_acctbal < 0 THEN 'withdrawn' ELSE 'consented' END",
    "baseline_qc_pass": "true",
}
SAMPLE_QC = {
    "participant_id": _PARTICIPANT_ID.format(k="c_custkey"),
    "array_call_rate": "0.9e0 + CAST(c_custkey % 100 AS DOUBLE) / 1000e0",
    "het_rate": "0.2e0 + CAST(c_custkey % 50 AS DOUBLE) / 500e0",
    "sex_check_pass": "c_custkey % 101 <> 0",
    "ancestry_pc1": "0e0",
    "ancestry_pc2": "0e0",
    "kinship_flag": "c_custkey % 37 = 0",
}
CELL_GT = (
    "CASE WHEN (mo * 7 + v) % 23 = 0 THEN 2 WHEN (mo * 7 + v) % 23 IN (1, 2, 3) THEN 1 "
    "WHEN (mo * 7 + v) % 23 = 4 THEN -1 ELSE 0 END"
)
DOSAGE = (
    "CASE WHEN mo % 29 = 0 THEN 0.55e0 WHEN gt >= 1 THEN CAST(gt AS DOUBLE) - tmin ELSE dmin END"
)
#: Part key of the variant that a lineitem is a call of, in the cohort and on the chip.
CALLED_SITE = (
    "CASE l_partkey % 4 WHEN 0 THEN 2 + l_partkey % 16 WHEN 1 THEN l_partkey % 200 ELSE l_partkey END"
)
CHIP_SITE = "1 + l_partkey % 16"
#: Part key of the variant that a part's request asks for.
ASKED_SITE = (
    "CASE p_partkey % 8 WHEN 0 THEN 2 + p_partkey / 8 % 4 * 4 WHEN 1 THEN p_partkey % 200 ELSE p_partkey END"
).replace("p_partkey / 8", "CAST(floor(p_partkey / 8) AS BIGINT)")
_SOURCE = "CAST(floor(p_partkey / 3) AS BIGINT) % 3"
REQUESTS = {
    "request_id": "concat('REQ-', lpad(CAST(p_partkey AS VARCHAR(20)), 9, '0'))",
    "batch_id": "concat('B-', lpad(CAST(CAST(floor(p_partkey / 5) AS BIGINT) AS VARCHAR(20)), 8, '0'))",
    "ordinal": "p_partkey",
    "study_id": "concat('STUDY-', CAST(p_partkey AS VARCHAR(20)))",
    "v": ASKED_SITE,
    "build": "'GRCh38'",
    "carrier_definition": "CASE WHEN p_partkey % 19 < 3 THEN 'het_only' ELSE 'het_and_homalt' END",
    "requested_source": f"CASE {_SOURCE} WHEN 0 THEN 'array_and_imputed' WHEN 1 THEN 'array' ELSE 'imputed' END",
    "purpose": "concat('recall planning for ', p_name)",
}


def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "customer"), PARTICIPANTS)


def sample_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "customer"), SAMPLE_QC)


def _cells(spark: SparkSession, sf_dir: str, site: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.expr(site).alias("v"), "l_quantity", "l_discount", "l_tax",
    )
    owners = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("k")
    )
    grouped = items.join(sizing.shuffled(owners), "l_orderkey").groupBy("k", "v").agg(
        F.min("l_orderkey").alias("mo"), F.max("l_quantity").alias("q"),
        F.min("l_discount").alias("dmin"), F.min("l_tax").alias("tmin"),
    )
    return grouped.selectExpr(
        "k", "v", f"{_PARTICIPANT_ID.format(k='k')} AS participant_id", "mo", "q", "dmin", "tmin",
        f"{CELL_GT} AS gt",
    )


def genotypes(spark: SparkSession, sf_dir: str, site: str = CALLED_SITE) -> DataFrame:
    """Long genotype rows. Array and imputed rows come from one pass over the cells."""
    missing = "CAST(NULL AS DOUBLE)"
    sites = wide_manifest(spark, sf_dir).select(F.col("k").alias("v"), "cpra")
    cells = _cells(spark, sf_dir, site).join(sizing.broadcast_within(sites, sites), "v")
    calls = cells.selectExpr(
        "participant_id", "cpra",
        f"""inline(array(
            struct(IF((k + v) % 5 <> 0, 'array', NULL) AS source, CAST(gt AS DOUBLE) AS gt_code,
                q AS gq, 1e0 - dmin / 2e0 AS call_rate, {missing} AS dosage, {missing} AS max_gp),
            struct('imputed' AS source, {missing} AS gt_code, {missing} AS gq,
                {missing} AS call_rate, {DOSAGE} AS dosage, 1e0 - tmin * 2e0 AS max_gp)
        ))""",
    ).filter(F.col("source").isNotNull())
    return calls.select(*schemas.GENOTYPES.fieldNames())


def chip_genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genotypes(spark, sf_dir, CHIP_SITE)


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = wide_manifest(spark, sf_dir).withColumn("pos", F.col("pos").cast("string"))
    return sites.select(*schemas.MANIFEST.fieldNames())


def _with_variant(rows: DataFrame, variants: DataFrame) -> DataFrame:
    return rows.join(sizing.shuffled(variants.withColumnRenamed("k", "v")), "v").drop("v")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per part."""
    variants = wide_manifest(spark, sf_dir).select("k", "cpra", "chrom", "pos", "ref", "alt")
    return _with_variant(_select(sizing.spread(table(spark, sf_dir, "part")), REQUESTS), variants)


def inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    return Inputs(
        requests=requests(spark, sf_dir), manifest=manifest(spark, sf_dir),
        bases=bases(spark, sf_dir), panel_maf=panel_maf(spark, sf_dir),
        participants=participants(spark, sf_dir), genotypes=genotypes(spark, sf_dir),
        sample_qc=sample_qc(spark, sf_dir),
    )


# --- wide ------------------------------------------------------------------------------------


_R = "substr('ACGT', CAST(1 + p_partkey % 4 AS INT), 1)"
_S = "substr('ACGT', CAST(1 + (p_partkey + 1 + CAST(floor(p_partkey / 4) AS BIGINT) % 3) % 4 AS INT), 1)"
#: Most sites change one letter; by last digit of the key some lose or gain letters, or share some.
_FORM = "CASE WHEN p_partkey % 25 = 24 THEN 0 ELSE p_partkey % 10 END"


def _decimal(multiplier: int) -> str:
    return f"concat('0.', lpad(CAST(p_partkey * {multiplier} % 1000 AS VARCHAR(20)), 3, '0'))"


WIDE_SITES = {
    "k": "p_partkey",
    "chrom": "CASE WHEN p_partkey % 25 < 22 THEN CAST(p_partkey % 25 + 1 AS VARCHAR(20)) "
    "WHEN p_partkey % 25 = 22 THEN 'X' WHEN p_partkey % 25 = 23 THEN 'Y' ELSE 'MT' END",
    "pos": "CASE WHEN p_partkey % 25 = 24 THEN 1000 + p_partkey * 7919 % 15013 "
    "ELSE 1000 + 10 * (p_partkey * 104729 % 4000000) END",
    "ref": f"CASE {_FORM} WHEN 1 THEN concat({_R}, {_S}) WHEN 3 THEN concat({_S}, {_R}, {_S}) "
    f"WHEN 4 THEN concat({_R}, {_S}, {_S}, {_R}) ELSE {_R} END",
    "alt": f"CASE {_FORM} WHEN 1 THEN {_R} WHEN 2 THEN concat({_R}, {_S}, {_S}) WHEN 3 THEN repeat({_S}, 3) "
    f"WHEN 4 THEN concat({_R}, {_S}, {_R}) ELSE {_S} END",
    "build": "CASE WHEN p_partkey % 53 = 0 THEN 'GRCh37' ELSE 'GRCh38' END",
    "biallelic": "'TRUE'",
    "on_array": "CASE WHEN p_partkey % 5 <> 0 THEN 'TRUE' ELSE 'FALSE' END",
    "on_imputed": "CASE WHEN p_partkey % 3 <> 0 THEN 'TRUE' ELSE 'FALSE' END",
    "array_maf": f"CASE WHEN p_partkey % 5 = 0 OR p_partkey % 9 = 0 THEN 'NA' ELSE {_decimal(37)} END",
    "imputed_maf": f"CASE WHEN p_partkey % 3 = 0 THEN 'NA' ELSE {_decimal(41)} END",
    "dosage_r2": "CASE WHEN p_partkey % 11 = 0 THEN 'NA' WHEN p_partkey % 23 = 0 THEN '' "
    f"ELSE {_decimal(53)} END",
    "annotation": "p_name",
    "inaccurate_annotation": "CASE WHEN p_partkey % 41 = 0 THEN 'TRUE' ELSE 'FALSE' END",
    "multiallelic_variant": "CASE WHEN p_partkey % 43 = 0 THEN 'TRUE' ELSE 'FALSE' END",
}
WIDE_REQUESTS = {
    "request_id": "concat('R', CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(20)), "
    "'-', CAST(l_partkey AS VARCHAR(20)))",
    "study_id": "concat('STUDY-', CAST(l_suppkey AS VARCHAR(20)))",
    "cpra": "CASE WHEN c = 0 THEN lower(cpra) WHEN c = 1 THEN replace(cpra, ':', '-') WHEN c = 2 THEN cpra "
    "ELSE concat(chrom, ':', CAST(pos2 AS VARCHAR(20)), ':', ref2, ':', alt2) END",
    "chrom": "CASE WHEN c = 2 THEN '26' ELSE chrom END",
    "pos": "pos2",
    "ref": "ref2",
    "alt": "alt2",
    "build": "CASE WHEN c = 7 THEN 'GRCh37' ELSE 'GRCh38' END",
    "carrier_definition": "CASE WHEN c = 8 THEN 'hom_only' WHEN c = 9 THEN 'het_only' ELSE 'het_and_homalt' END",
    "requested_source": "CASE WHEN c = 10 THEN 'wgs' WHEN l_linenumber % 3 = 0 THEN 'array' "
    "WHEN l_linenumber % 3 = 1 THEN 'imputed' ELSE 'array_and_imputed' END",
    "purpose": "CASE WHEN c = 11 THEN NULL ELSE 'recall planning' END",
}
WIDE_PREPARED = {
    "pos2": "CASE WHEN c = 3 THEN 0 WHEN c = 4 THEN 999999999 WHEN c = 13 THEN pos + 1 ELSE pos END",
    "ref2": "CASE WHEN c = 12 THEN alt ELSE ref END",
    "alt2": "CASE WHEN c IN (6, 12) THEN ref ELSE alt END",
}
WIDE_BASES = {
    "build": "CASE WHEN p_partkey % 17 = 0 THEN 'GRCh37' ELSE 'GRCh38' END",
    "base": "CASE WHEN p_partkey % 13 = 0 THEN 'N' ELSE substr(n_ref, 1, 1) END",
}


def wide_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One variant per part, with its key ``k``."""
    sites = _select(sizing.spread(table(spark, sf_dir, "part")), WIDE_SITES)
    return sites.withColumn("cpra", F.concat_ws(":", "chrom", F.col("pos").cast("string"), "ref", "alt"))


def elsewhere(missed: str, key: str, name: str | None = None) -> str:
    """The key, moved to a contig that no variant has where ``missed`` holds: a row without a match."""
    return f"CASE WHEN {missed} THEN concat('U', {key}) ELSE {key} END AS {name or key}"


def bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference bases at the trimmed sites; those of every seventh part are missing."""
    trimmed = preflight.trim_alleles(wide_manifest(spark, sf_dir))
    placed = trimmed.selectExpr(elsewhere("k % 7 = 0", "chrom"), "n_pos AS pos", "k AS p_partkey", "n_ref")
    return placed.selectExpr("chrom", "pos", *[f"{sql} AS {name}" for name, sql in WIDE_BASES.items()])


def panel_maf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel frequencies of the trimmed variants; those of every fourth part are missing."""
    trimmed = preflight.trim_alleles(wide_manifest(spark, sf_dir))
    return trimmed.select(
        F.expr(elsewhere("k % 4 = 0", "normalized_cpra", "cpra")), (F.col("k") * 37 % 997 / 1000).alias("panel_maf")
    )


def wide_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per lineitem on the variant of its part; fixed shares of them are malformed."""
    variants = wide_manifest(spark, sf_dir).select("k", "cpra", "chrom", "pos", "ref", "alt")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    keyed = items.withColumn("c", (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 40)
    prepared = keyed.join(sizing.broadcast_within(variants, variants), keyed.l_partkey == variants.k).selectExpr(
        "*", *[f"{sql} AS {name}" for name, sql in WIDE_PREPARED.items()]
    )
    return _select(prepared, WIDE_REQUESTS)


# --- catalogue -------------------------------------------------------------------------------

GENES = {
    "symbol": "concat('G', CAST(s_suppkey AS VARCHAR(20)))",
    "chrom": "CAST(s_suppkey % 22 + 1 AS VARCHAR(20))",
    "start": "1 + s_suppkey * 1299709 % 38000000",
    "end": "1 + s_suppkey * 1299709 % 38000000 + 2500000",
}
REGIONS = {
    "chrom": "CAST(s_suppkey % 22 + 1 AS VARCHAR(20))",
    "start": "CAST(floor(s_suppkey / 22) AS BIGINT) * 400000",
    "end": "CAST(floor(s_suppkey / 22) AS BIGINT) * 400000 + 399999",
    "region": "concat('b', lpad(CAST(s_suppkey AS VARCHAR(20)), 4, '0'))",
}


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier")
    return suppliers.selectExpr(*[f"{sql} AS `{name}`" for name, sql in GENES.items()])


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier")
    return suppliers.selectExpr(*[f"{sql} AS `{name}`" for name, sql in REGIONS.items()])


def gene_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, variant_id, ordinal): parts a supplier ships, ordered by their first order."""
    return table(spark, sf_dir, "lineitem").groupBy(
        F.concat(F.lit("G"), F.col("l_suppkey").cast("string")).alias("symbol"),
        F.col("l_partkey").alias("variant_id"),
    ).agg(F.min("l_orderkey").alias("ordinal"))


def panel_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(panel, symbol, ordinal): suppliers of each nation."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("panel"),
        F.concat(F.lit("g"), F.col("s_suppkey").cast("string")).alias("symbol"),
        F.col("s_suppkey").alias("ordinal"),
    )


# --- release candidates ----------------------------------------------------------------------

CANDIDATES = {
    "candidate_id": "concat('C-', CAST(o_orderkey AS VARCHAR(20)))",
    "study_id": "concat('STUDY-', CAST(o_custkey AS VARCHAR(20)))",
    "cpra": "CASE WHEN o_orderkey % 17 = 1 THEN '10:0119:C:G' WHEN o_orderkey % 17 = 2 THEN '23:5:C:G' "
    "WHEN o_orderkey % 17 = 3 THEN '10:100:C:N' WHEN o_orderkey % 17 = 4 THEN '10:100:C' "
    "WHEN o_orderkey % 17 = 5 THEN repeat('+10:100:C:G', 17) "
    "WHEN o_orderkey % 17 = 6 THEN '10:100:C:G+X:7:A:AT' "
    "ELSE concat('1:', CAST(o_orderkey + 1 AS VARCHAR(20)), ':A:G') END",
    "client_total": "CASE o_orderkey % 13 WHEN 0 THEN '<10' WHEN 1 THEN '<5' WHEN 2 THEN '~5' WHEN 3 THEN '~12' "
    "WHEN 4 THEN '~070' WHEN 5 THEN '70' WHEN 6 THEN '~' WHEN 7 THEN '~2000000000' WHEN 8 THEN '<10' "
    "ELSE concat('~', CAST((o_orderkey % 50 + 2) * 5 AS VARCHAR(20))) END",
    "breakdown_suppressed": "o_orderkey % 7 < 3",
    "min_cell": "CAST(CASE WHEN o_orderkey % 29 = 0 THEN 5 ELSE 10 END AS BIGINT)",
    "round_to": "CAST(5 AS BIGINT)",
    # 0 to 2 cells, flattened; a null label means no cell.
    "label1": "CASE WHEN o_orderkey % 7 < 2 THEN NULL WHEN o_orderkey % 19 = 1 THEN 'other_cell' "
    "ELSE 'array_direct_high_confidence' END",
    "count1": "CAST(CASE WHEN o_orderkey % 11 = 0 THEN 0 WHEN o_orderkey % 11 = 1 THEN 5 "
    "WHEN o_orderkey % 11 = 2 THEN -5 WHEN o_orderkey % 11 = 3 THEN 2000000000 "
    "ELSE (o_orderkey % 30 + 2) * 5 END AS BIGINT)",
    "label2": "CASE WHEN o_orderkey % 7 < 3 THEN NULL WHEN o_orderkey % 23 = 1 THEN 'array_direct_high_confidence' "
    "ELSE 'imputed_supported_conditional' END",
    "count2": "CAST(CASE WHEN o_orderkey % 10 = 0 THEN 12 ELSE (o_orderkey % 20 + 2) * 5 END AS BIGINT)",
}


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One release candidate per order, with fixed shares that break each rule."""
    flat = _select(table(spark, sf_dir, "orders"), CANDIDATES)

    def cell(n: int):
        return F.when(
            F.col(f"label{n}").isNotNull(),
            F.struct(F.col(f"label{n}").alias("label"), F.col(f"count{n}").alias("count")),
        )

    return flat.withColumn(
        "reported_cells", F.array_compact(F.array(cell(1), cell(2)))
    ).drop("label1", "count1", "label2", "count2")


# --- returns and reviews ---------------------------------------------------------------------

RETURNS = {
    "study_id": "concat('STUDY-', CAST(p_partkey AS VARCHAR(20)))",
    "v": ASKED_SITE,
    "bad_run": "p_partkey % 11 = 0",
    "eligible_count": "CASE WHEN p_partkey % 17 = 0 THEN -1 WHEN p_partkey % 8 < 2 THEN p_partkey * 7 % 60 ELSE p_partkey * 7 % 6 END",
    "phenotype_definition_id": "CASE WHEN p_partkey % 23 = 0 THEN '' ELSE concat('PHENO-', CAST(p_size AS VARCHAR(20))) END",
    "icd10_codeset_label": "'cardiac'",
    "icd10_codeset_version": "'v1'",
    "linked_record_scope": "'hospital episodes'",
    "reviewer": "CASE WHEN p_partkey % 31 = 0 THEN 'reviewer of PSU-00AB12' ELSE 'reviewer one' END",
    "return_timestamp": "'2026-01-01T00:00:00+00:00'",
    "sign_off_status": "CASE WHEN p_partkey % 13 = 0 THEN 'pending_sign_off' ELSE 'signed' END",
    "caveat": "concat('returned for ', p_name)",
}
CHECKPOINTS = {
    "study_id": "concat('STUDY-', CAST(p_partkey AS VARCHAR(20)))",
    "checkpoint": "CASE WHEN p_partkey % 2 = 0 THEN 'epi_return' ELSE 'pre_airlock' END",
    "decision": "CASE WHEN p_partkey % 12 = 0 THEN 'block' WHEN p_partkey % 12 = 1 THEN 'query' ELSE 'pass' END",
}


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortgate.functions.digest import run_id

    flat = _select(table(spark, sf_dir, "part"), RETURNS)
    named = _with_variant(flat, wide_manifest(spark, sf_dir).select("k", "cpra"))
    return named.withColumns({
        "run_id": F.when(F.col("bad_run"), "RUN-000000000000").otherwise(
            run_id(F.col("study_id"), F.col("cpra"))
        ),
        "caveats": F.array("caveat"),
    }).drop("bad_run", "caveat")


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "part"), CHECKPOINTS)

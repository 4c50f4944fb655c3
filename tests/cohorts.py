"""Small hand-made inputs shared by the tests."""

from __future__ import annotations

from cohortgate import schemas
from cohortgate.plans.feasibility import Evaluation, Inputs
from cohortgate.policy import AnalysisPolicy
from cohortgate.sources.tables import reference_tables, small_table

CPRA = "7:5500120:T:A"
#: cpra, on_array, on_imputed, array_maf, imputed_maf, dosage_r2, inaccurate, multiallelic
SITES = [
    (CPRA, "TRUE", "TRUE", "0.021", "0.022", "0.64", "FALSE", "FALSE"),
    ("11:830045:C:A", "TRUE", "TRUE", "0.040", "0.041", "0.90", "FALSE", "FALSE"),
    ("15:2000:GT:G", "FALSE", "TRUE", "NA", "0.004", "0.12", "FALSE", "FALSE"),
    ("21:9900300:T:C", "TRUE", "TRUE", "0.050", "0.050", "0.50", "TRUE", "FALSE"),
]
REFERENCE = {
    "bases": {"GRCh38": {"7:5500120": "T", "11:830045": "C", "15:2000": "G"}, "GRCh37": {"7:5400000": "T"}},
    "panel_maf": {CPRA: 0.021, "11:830045:C:A": 0.040, "15:2000:GT:G": 0.004},
}
REQUEST_SCHEMA = (
    "request_id string, batch_id string, ordinal bigint, study_id string, cpra string, chrom string, "
    "pos bigint, ref string, alt string, build string, carrier_definition string, "
    "requested_source string, purpose string"
)


def table(spark, rows, ddl):
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(ddl) if isinstance(ddl, str) else ddl
    return small_table(spark, rows, schema)


def request(cpra=CPRA, request_id="R1", batch_id="B1", ordinal=0, source="array_and_imputed",
            definition="het_and_homalt", study="TEST", **over):
    chrom, pos, ref, alt = cpra.split(":")
    row = {
        "request_id": request_id, "batch_id": batch_id, "ordinal": ordinal, "study_id": study,
        "cpra": cpra, "chrom": chrom, "pos": int(pos), "ref": ref, "alt": alt, "build": "GRCh38",
        "carrier_definition": definition, "requested_source": source, "purpose": "test", **over,
    }
    return tuple(row.values())


def evaluation(spark, requests, participants, genotypes, sample_qc, policy=None) -> Evaluation:
    """``sample_qc`` is (participant_id, sex_check_pass, kinship_flag) as text."""
    bases, panel = reference_tables(spark, REFERENCE)
    manifest = [(c, *c.split(":"), "GRCh38", "TRUE", a, i, am, im, dr2, "test", bad, multi) for c, a, i, am, im, dr2, bad, multi in SITES]
    quality = [(p, 0.99, 0.25, str(s), 0.0, 0.0, str(k)) for p, s, k in sample_qc]
    return Evaluation(
        Inputs(
            requests=table(spark, requests, REQUEST_SCHEMA), manifest=table(spark, manifest, schemas.MANIFEST),
            bases=bases, panel_maf=panel,
            participants=table(spark, participants, schemas.PARTICIPANTS),
            genotypes=table(spark, genotypes, schemas.GENOTYPES),
            sample_qc=table(spark, quality, schemas.SAMPLE_QC),
        ),
        policy or AnalysisPolicy(),
    )


def people(names, withdrawn=(), sex=None, ancestry=None):
    return [
        (n, f"PSU-{i:06d}", sex(i) if sex else "F", ancestry(i) if ancestry else "EUR",
         "withdrawn" if n in withdrawn else "consented", True)
        for i, n in enumerate(names)
    ]


def array_call(person, gt, gq=40.0, call_rate=0.99, cpra=CPRA):
    return (person, cpra, "array", float(gt), gq, call_rate, None, None)


def imputed_call(person, dosage, max_gp=0.95, cpra=CPRA):
    return (person, cpra, "imputed", None, None, None, dosage, max_gp)


def tiny(spark, **over) -> Evaluation:
    """Thirty participants; carriers 3, 7, 11, 15; 7 withdrawn; 15 has no array call."""
    names = [f"P{100000 + i}" for i in range(30)]
    carriers = {3, 7, 11, 15}
    calls = []
    for i, name in enumerate(names):
        if i != 15:
            calls.append(array_call(name, 1 if i in carriers else 0))
        calls.append(imputed_call(name, 1.0 if i in carriers else 0.0))
    requests = over.pop("requests", [request()])
    return evaluation(
        spark, requests, people(names, withdrawn={names[7]}), calls,
        [(n, True, False) for n in names], **over,
    )


def six_rows(spark, policy=None, definition="het_and_homalt") -> Evaluation:
    """Clean flagged carrier; withdrawn; imputed only; low GP; low call rate; non-carrier."""
    names = ["P0", "P1", "P2", "P3", "P4", "P5"]
    calls = [
        array_call("P0", 1), array_call("P1", 1), array_call("P4", 1, call_rate=0.90), array_call("P5", 0),
        imputed_call("P0", 1.0), imputed_call("P1", 1.0), imputed_call("P2", 1.0),
        imputed_call("P3", 0.60, 0.62), imputed_call("P4", 1.0), imputed_call("P5", 0.01, 0.985),
    ]
    return evaluation(
        spark, [request(definition=definition)], people(names, withdrawn={"P1"}), calls,
        [(n, True, n == "P0") for n in names], policy,
    )

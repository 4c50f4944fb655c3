"""Explicit schemas of every table; nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


def _text(*names: str) -> T.StructType:
    return _struct(**{name: T.StringType() for name in names})


_S, _D, _B, _L = T.StringType(), T.DoubleType(), T.BooleanType(), T.LongType()

PARTICIPANTS = _struct(
    participant_id=_S, pseudo_id=_S, sex=_S, ancestry_stub=_S, consent_status=_S,
    baseline_qc_pass=_B,
)
GENOTYPES = _struct(
    participant_id=_S, cpra=_S, source=_S, gt_code=_D, gq=_D, call_rate=_D, dosage=_D, max_gp=_D,
)
# Sample-QC flags are text at the edge: files carry TRUE/true/1 and unknown words alike.
SAMPLE_QC = _struct(
    participant_id=_S, array_call_rate=_D, het_rate=_D, sex_check_pass=_S,
    ancestry_pc1=_D, ancestry_pc2=_D, kinship_flag=_S,
)
MANIFEST = _text(
    "cpra", "chrom", "pos", "ref", "alt", "build", "biallelic", "on_array", "on_imputed",
    "array_maf", "imputed_maf", "dosage_r2", "annotation", "inaccurate_annotation",
    "multiallelic_variant",
)
IDENTIFIABILITY = _text(
    "cpra", "on_array", "on_imputed", "annotation_reliable", "source_release", "evidence",
)
REQUESTS = _text(
    "study_id", "cpra", "chrom", "pos", "ref", "alt", "build", "carrier_definition",
    "requested_source", "purpose",
)
ENTITY_DICTIONARY = _text("entity", "description", "primary_key")
DATA_DICTIONARY = _text(
    "entity", "name", "type", "primary_key_type", "coding_name", "title", "units", "description",
)
CODING_DICTIONARY = _text("coding_name", "code", "meaning", "display_order", "parent_code")
RETURNS = T.StructType([
    *_text("study_id", "cpra", "run_id").fields,
    T.StructField("eligible_count", _L),
    *_text(
        "phenotype_definition_id", "icd10_codeset_label", "icd10_codeset_version",
        "linked_record_scope", "reviewer", "return_timestamp", "sign_off_status",
    ).fields,
    T.StructField("caveats", T.ArrayType(_S)),
])
CHECKPOINTS = T.StructType([
    *_text("checkpoint", "reviewer", "timestamp").fields,
    T.StructField("artefacts_checked", T.ArrayType(_S)),
    *_text("decision", "notes", "follow_up_owner").fields,
])
LEDGER = T.StructType([
    T.StructField("seq", _L),
    *_text("request_id", "cpra", "actor_type", "timestamp", "git_commit", "config_sha256").fields,
    T.StructField("input_sha256", T.MapType(_S, _S)),
    T.StructField("output_sha256", T.MapType(_S, _S)),
    T.StructField("sdc", T.MapType(_S, _S)),
    T.StructField("parent_root", _S),
    T.StructField("airlock", T.MapType(_S, _S)),
])
REFERENCE_BASES = _struct(build=_S, chrom=_S, pos=_L, base=_S)
PANEL_MAF = _struct(cpra=_S, panel_maf=_D)
REGIONS = _struct(chrom=_S, start=_L, end=_L, region=_S)
CELL = _struct(label=_S, count=_L)

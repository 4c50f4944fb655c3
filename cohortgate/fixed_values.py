"""Fixed values of the domain, stated once. Nothing in here is computed."""

from __future__ import annotations

# GRCh38 primary-assembly contig lengths in bases.
CONTIG_LENGTHS = {
    "1": 248956422, "2": 242193529, "3": 198295559, "4": 190214555, "5": 181538259,
    "6": 170805979, "7": 159345973, "8": 145138636, "9": 138394717, "10": 133797422,
    "11": 135086622, "12": 133275309, "13": 114364328, "14": 107043718, "15": 101991189,
    "16": 90338345, "17": 83257441, "18": 80373285, "19": 58617616, "20": 64444167,
    "21": 46709983, "22": 50818468, "X": 156040895, "Y": 57227415, "MT": 16569,
}
AUTOSOMES = [str(n) for n in range(1, 23)]

# Request vocabulary.
CPRA_PATTERN = r"^(?:\d{1,2}|X|Y|MT):\d+:[ACGT]+:[ACGT]+$"
BUILDS = ["GRCh38"]
CARRIER_DEFINITIONS = ["het_and_homalt", "het_only"]
REQUESTED_SOURCES = ["array", "imputed", "array_and_imputed"]

# Words accepted as booleans.
TRUE_WORDS = ["TRUE", "T", "YES", "Y", "1"]
FALSE_WORDS = ["FALSE", "F", "NO", "N", "0"]

# Genotype codes and limits.
MISSING_GT = -1
HET_DOSAGE_UPPER = 1.5
GQ_SENTINEL = 99.0
GT_TEXT_CODES = {"0/0": 0, "0/1": 1, "1/0": 1, "1/1": 2, "./.": -1, ".": -1}
GT_CODE_TEXT = {0: "0/0", 1: "0/1", 2: "1/1", -1: "./."}

# Strand resolution by allele frequency.
PALINDROMES = ["CG", "AT"]
AF_AMBIGUITY_BAND = 0.05

# Interval and planning constants.
Z95 = 1.959963985
RESPONSE_RATES = (0.25, 0.50)
UNKNOWN_ANCESTRY = "UNKNOWN"

# Release language.
CELL_HIGH = "array_direct_high_confidence"
CELL_CONDITIONAL = "imputed_supported_conditional"
APPROVED_CELL_LABELS = [CELL_HIGH, CELL_CONDITIONAL]
MIN_ALLOWED_CELL = 5
MAX_COUNT = 1_000_000_000
MAX_CELLS = 16
MAX_SUBJECT_VARIANTS = 16
MAX_ALLELE_LENGTH = 64
RELEASE_FIELDS = [
    "study_id", "cpra", "client_total", "breakdown_suppressed", "reported_cells",
    "min_cell", "round_to",
]

# File classes, and the files of each kind of run in writing order.
INTERNAL_CLASS, EXPORT_CLASS = "INTERNAL-TRE-ONLY", "AIRLOCK-EXPORT-CANDIDATE"
EXPORTED_FILE = "release.json"
RUN_FILES = {
    "run": [
        "internal_carrier_table.parquet", "handoff_to_epi.csv", "frequency_control_view.json",
        "feasibility_summary.txt", "release.json",
    ],
    "final": ["feasibility_summary.txt", "final_feasibility_summary.txt", "release.json"],
    "batch": ["batch_release_candidate.json", "batch_feasibility_summary.txt", "release.json"],
}

# Identifier scan.
FORBIDDEN_KEYS = ["participant_id", "pseudo_id", "nhs_number", "date_of_birth"]
DIGEST_KEYS = ["config_sha256", "input_sha256", "output_sha256", "git_commit", "parent_root"]

# Gate columns in reporting order.
GATES = [
    "on_array", "on_imputed", "annotation_reliable", "array_source_allowed",
    "imputed_source_allowed", "has_array_gt", "call_rate_ok", "gq_ok", "has_imputed_dosage",
    "dr2_ok", "max_gp_ok", "dosage_ok", "consent_ok", "sex_check_ok", "kinship_ok",
    "array_credible", "imputed_credible", "included_by_configured_gates",
]

# Column order of the internal carrier table.
INTERNAL_COLUMNS = [
    "participant_id", "pseudo_id", "consent_status", "sex", "ancestry_stub", "source",
    "array_gt_code", "array_gq", "array_call_rate", "imputed_dosage", "imputed_max_gp",
    *GATES,
    "variant_info", "confidence", "evidence_priority", "decision", "reason", "flags",
]

"""Analysis and release policy. Both are small driver-side values, checked when built."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortgate.fixed_values import CARRIER_DEFINITIONS, MIN_ALLOWED_CELL

_ALIASES = {
    "imputed_info_min": "imputed_dr2_min",
    "imputed_info_high_confidence": "imputed_dr2_high_confidence",
}


@dataclass(frozen=True)
class AnalysisPolicy:
    """Quality thresholds and disclosure parameters of one analysis."""

    array_call_rate_min: float = 0.98
    array_gq_min: int = 20
    imputed_dr2_min: float = 0.30
    imputed_dr2_high_confidence: float = 0.80
    imputed_dosage_carrier_threshold: float = 0.5
    imputed_max_gp_min: float = 0.90
    carrier_definition: str = "het_and_homalt"
    require_consent: bool = True
    sdc_min_cell: int = 10
    sdc_round_to: int = 5

    def __post_init__(self) -> None:
        broken = [code for code, ok in self._rules().items() if not ok]
        if broken:
            raise ValueError(f"invalid analysis policy: {broken}")

    def _rules(self) -> dict[str, bool]:
        unit = (
            self.array_call_rate_min, self.imputed_dr2_min, self.imputed_dr2_high_confidence,
            self.imputed_max_gp_min,
        )
        return {
            "consent_gate_off": self.require_consent is True,
            "threshold_outside_unit_interval": all(0 <= value <= 1 for value in unit),
            "dosage_threshold_outside_0_2": 0 <= self.imputed_dosage_carrier_threshold <= 2,
            "negative_gq": self.array_gq_min >= 0,
            "min_cell_below_floor": self.sdc_min_cell >= MIN_ALLOWED_CELL,
            "high_dr2_below_floor": self.imputed_dr2_high_confidence >= self.imputed_dr2_min,
            "round_to_not_divisor": self.sdc_round_to > 0
            and self.sdc_min_cell % self.sdc_round_to == 0,
            "bad_carrier_definition": self.carrier_definition in CARRIER_DEFINITIONS,
        }

    @classmethod
    def from_dict(cls, values: dict) -> AnalysisPolicy:
        """Build from a plain mapping; the older ``imputed_info_*`` names are accepted."""
        known = {field.name for field in fields(cls)}
        resolved: dict = {}
        for name, value in values.items():
            target = _ALIASES.get(name, name)
            if target not in known:
                raise ValueError(f"unknown policy field: {name}")
            if target in resolved and resolved[target] != value:
                raise ValueError(f"policy sets {target} twice with different values")
            resolved[target] = value
        return cls(**resolved)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


@dataclass(frozen=True)
class Scenario:
    """Late-bound thresholds for re-projection; ``None`` keeps the analysis policy's value."""

    name: str
    imputed_dr2_min: float | None = None
    imputed_dr2_high_confidence: float | None = None
    imputed_max_gp_min: float | None = None
    array_call_rate_min: float | None = None
    array_gq_min: int | None = None

    def value(self, field: str, policy: AnalysisPolicy):
        own = getattr(self, field)
        return getattr(policy, field) if own is None else own


@dataclass(frozen=True)
class ReleasePolicy:
    """The authorised disclosure policy. It is loaded apart from the analysis, never from it."""

    policy_id: str
    version: str
    min_cell: int
    round_to: int
    policy_sha256: str = ""


@dataclass(frozen=True)
class Deployment:
    """Names that differ between estates: note headings, format tags, identifier prefixes."""

    organisation: str = "COHORT RESOURCE"
    short_name: str = "COHORT"
    release_schema: str = "aggregate-release/v2"
    policy_schema: str = "aggregate-release-policy/v1"
    participant_prefix: str = "P"
    pseudo_prefix: str = "PSU-"
    #: Why a run's file may leave, and why one may not.
    file_notes: tuple[str, str] = ("release payload without row-level data", "stays inside: working file of the run")


def policy_violations(df: DataFrame) -> DataFrame:
    """Add ``policy_violations`` to a table of analysis policies, one row each."""

    def rule(code: str, ok: Column) -> Column:
        return F.when(~F.coalesce(ok, F.lit(False)), F.lit(code))

    unit = [
        F.col(name).between(0, 1)
        for name in (
            "array_call_rate_min", "imputed_dr2_min", "imputed_dr2_high_confidence",
            "imputed_max_gp_min",
        )
    ]
    all_unit = unit[0] & unit[1] & unit[2] & unit[3]
    divides = (F.col("sdc_round_to") > 0) & (
        F.try_mod(F.col("sdc_min_cell"), F.col("sdc_round_to")) == 0
    )
    return df.withColumn(
        "policy_violations",
        F.array_compact(F.array(
            rule("consent_gate_off", F.col("require_consent")),
            rule("threshold_outside_unit_interval", all_unit),
            rule(
                "dosage_threshold_outside_0_2",
                F.col("imputed_dosage_carrier_threshold").between(0, 2),
            ),
            rule("negative_gq", F.col("array_gq_min") >= 0),
            rule("min_cell_below_floor", F.col("sdc_min_cell") >= MIN_ALLOWED_CELL),
            rule(
                "high_dr2_below_floor",
                F.col("imputed_dr2_high_confidence") >= F.col("imputed_dr2_min"),
            ),
            rule("round_to_not_divisor", divides),
            rule("bad_carrier_definition", F.col("carrier_definition").isin(CARRIER_DEFINITIONS)),
        )),
    )

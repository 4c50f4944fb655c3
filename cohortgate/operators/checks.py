"""Integrity checks on shared inputs: required columns, unique keys, join cardinality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

IDENTIFIER_COLUMNS = {"participant_id", "pseudo_id"}


def require_columns(df: DataFrame, schema: StructType | list[str], name: str) -> DataFrame:
    """Fail before any job runs when a declared column is missing. Extra columns are allowed."""
    wanted = schema.fieldNames() if isinstance(schema, StructType) else list(schema)
    missing = [column for column in wanted if column not in df.columns]
    if missing:
        raise ValueError(f"{name} missing columns: {missing}")
    return df


def forbid_identifiers(df: DataFrame) -> DataFrame:
    """A public view may not carry participant columns."""
    exposed = sorted(IDENTIFIER_COLUMNS.intersection(df.columns))
    if exposed:
        raise ValueError(f"view would expose identifier columns: {exposed}")
    return df


def unexpected_fields(columns: list[str], allowed: list[str]) -> list[str]:
    return sorted(set(columns) - set(allowed))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values held by more than one row, with their row count. Null keys are compared too."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def unmatched_left(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left rows without a partner on the right."""
    return left.join(right.select(*keys), keys, "left_anti")


def assert_unique(df: DataFrame, keys: list[str], name: str) -> None:
    """Stop when a key repeats, naming the first five offenders in key order."""
    found = duplicate_keys(df, keys).orderBy(*keys).limit(5).collect()
    if found:
        named = [tuple(row[key] for key in keys) if len(keys) > 1 else row[keys[0]] for row in found]
        raise ValueError(f"{name}: duplicate {'+'.join(keys)} key(s): {named}")


def assert_join_one_to_one(left: DataFrame, right: DataFrame, keys: list[str], name: str) -> None:
    """Right key unique and every left row matched; extra right rows are fine."""
    assert_unique(right, keys, f"{name} (right side)")
    missing = unmatched_left(left, right, keys).orderBy(*keys).limit(5).collect()
    if missing:
        named = [row[keys[0]] for row in missing]
        raise ValueError(f"{name}: left row(s) unmatched in join, e.g. {named}")


def assert_inputs(participants: DataFrame, sample_qc: DataFrame, genotypes: DataFrame) -> None:
    """The checks of one load. Run once per load, not once per request."""
    assert_unique(participants, ["participant_id"], "participant_table")
    assert_unique(genotypes, ["participant_id", "cpra", "source"], "genotype_slice")
    assert_join_one_to_one(
        participants, sample_qc, ["participant_id"], "participant->sample_qc"
    )

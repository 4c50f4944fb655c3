"""Stages of an evaluation that are written, checked and used again.

A stage is a table with a contract: its columns and types, its number of rows, and the digest of all
that it was made from. It is opened only where the contract agrees with what the caller asks for and
with the rows that are there; otherwise the reason is raised, and nothing stale or cut short is used.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortgate.policy import AnalysisPolicy

CONTRACT = "stage string, input_digest string, columns string, rows long"


class StageMismatch(ValueError):
    """A stored stage is not the one that was asked for."""


def content_digest(rows: DataFrame) -> str:
    """A digest of a table's rows that does not depend on their order or partitions, nor on equal rows
    cancelling out: sums of two hashes of each row, with the number of rows, in one aggregation."""
    text = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    sums = [F.coalesce(F.sum(F.xxhash64(F.lit(seed), text).cast("decimal(38,0)")), F.lit(0)).cast("string") for seed in (1, 2)]
    row = rows.agg(F.count(F.lit(1)).cast("string"), *sums).first()
    return hashlib.sha256(json.dumps([rows.schema.json(), *row]).encode()).hexdigest()


def input_digest(policy: AnalysisPolicy, **inputs: DataFrame) -> str:
    """A digest of the policy and of the content of the input tables."""
    parts = {name: content_digest(rows) for name, rows in sorted(inputs.items())}
    return hashlib.sha256(json.dumps([asdict(policy), parts], sort_keys=True, default=str).encode()).hexdigest()


class StageStore:
    """Stages under one folder, as Parquet, or as text where ``text`` is set (every value as a string)."""

    def __init__(self, spark: SparkSession, path: str, text: bool = False):
        self.spark, self.path, self.text = spark, path.rstrip("/"), text

    def _rows(self, stage: str, schema: StructType) -> DataFrame:
        if not self.text:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{stage}")
        names = StructType.fromDDL(", ".join(f"`{name}` string" for name in schema.fieldNames()))
        return self.spark.read.option("header", True).option("escape", '"').schema(names).csv(f"{self.path}/{stage}")

    def save(self, stage: str, rows: DataFrame, digest: str) -> None:
        """Write a stage and then its contract, so that a stage that was cut short has none."""
        if self.text:
            texts = rows.select(*[F.col(f"`{name}`").cast("string") for name in rows.columns])
            texts.write.option("header", True).option("escape", '"').csv(f"{self.path}/{stage}")
        else:
            rows.write.parquet(f"{self.path}/{stage}")
        count = self._rows(stage, rows.schema).count()
        contract = self.spark.createDataFrame([(stage, digest, rows.schema.json(), count)], CONTRACT)
        contract.coalesce(1).write.json(f"{self.path}/{stage}.contract")

    def contract(self, stage: str) -> dict | None:
        try:
            rows = self.spark.read.schema(CONTRACT).json(f"{self.path}/{stage}.contract").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return rows[0].asDict() if len(rows) == 1 else None

    def open(self, stage: str, digest: str, schema: StructType | None = None) -> DataFrame:
        """The stored stage; ``schema`` is what its reader needs, if it is stricter than what was written."""
        found = self.contract(stage)
        if found is None:
            raise StageMismatch(f"stage {stage} was not written to its end")
        if found["input_digest"] != digest:
            raise StageMismatch(f"stage {stage} was made from other inputs")
        written = StructType.fromJson(json.loads(found["columns"]))
        if schema is not None and [(f.name, f.dataType) for f in schema] != [(f.name, f.dataType) for f in written]:
            raise StageMismatch(f"stage {stage} has other columns")
        rows = self._rows(stage, written)
        if rows.count() != found["rows"]:
            raise StageMismatch(f"stage {stage} has lost or gained rows")
        return rows

    def reused(self, stage: str, digest: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The stored stage where there is one from the same inputs; otherwise it is made and written.

        A stage of other inputs is not overwritten: the caller takes another folder for them.
        """
        if self.contract(stage) is None:
            self.save(stage, make(), digest)
        return self.open(stage, digest)

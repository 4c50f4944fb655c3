"""Secret scans over an incremental blob ledger.

Every version of every path is content-addressed. Only (blob, rule version) pairs that the ledger
lacks are scanned, one representative text per blob, and the findings are joined back to all
paths. Everything is DataFrame operations; the regular expressions run in the JVM.

Positions come from what lies between the matches: splitting a text by a pattern and extracting
all its matches gives both lists in order, and running lengths give starts and ends in code points.

Defined results: a null text counts as empty and has no findings; repeated rows each get their
row; an empty table gives an empty result; other columns are neither read nor changed.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortgate.llm.tables import kept, shared_dir

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``hints``: lower-case texts of which a match contains one. ``value``: a
    pattern whose second group must have ``least`` characters, checked match by match."""

    kind: str
    pattern: str
    hints: tuple[str, ...] = ()
    value: str | None = None
    least: int = 0


#: Runs of fixed classes carry their least length in the pattern: a greedy run is found at its
#: first place, so a shorter run has no match inside it.
RULES = (
    Rule("assign", ASSIGN, ("password", "passwd", "secret", "token", "api_key", "apikey"), ASSIGN, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", ("akia",)),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", ("private key-----",)),
)
VERSION = "1"
FINDING = "array<struct<start:long,place:int,end:long,kind:string>>"


def _spans(text: Column, lowered: Column, rule: Rule, place: int) -> Column:
    """All spans of one rule, in order."""
    between = F.split(text, rule.pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    pairs = F.arrays_zip(between.alias("gap"), matches.alias("hit"))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(FINDING).alias("spans"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.char_length(pair["gap"])
        end = start + F.char_length(pair["hit"])
        span = F.struct(start.alias("start"), F.lit(place).alias("place"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        good = pair["hit"].isNotNull()
        if rule.value:
            good &= F.char_length(F.regexp_extract(pair["hit"], rule.value, 2)) >= rule.least
        spans = F.when(good, F.concat(state["spans"], F.array(span).cast(FINDING))).otherwise(state["spans"])
        return F.struct(F.coalesce(end, start).cast("long").alias("at"), spans.alias("spans"))

    found = F.aggregate(pairs, begin, step, lambda state: state["spans"])
    maybe = F.lit(not rule.hints)
    for hint in rule.hints:
        maybe = maybe | F.contains(lowered, F.lit(hint))
    return F.when(maybe & F.regexp_like(text, F.lit(rule.pattern)), found).otherwise(F.array().cast(FINDING))


def scan(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``texts`` (with the column ``text``) and ``spans`` by start, then kind as listed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lists = [_spans(text, F.lower(text), rule, place) for place, rule in enumerate(rules)]
    return texts.withColumn("spans", F.array_sort(F.concat(*lists)))


class BlobLedger:
    """Which (blob, rule version) pairs were scanned, and what was found; two Parquet folders."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/blob-ledger-{uuid.uuid4().hex}"

    def _read(self, part: str, schema: str) -> DataFrame:
        spark = self.spark
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.path}/{part}")

    def scanned(self) -> DataFrame:
        return self._read("scanned", "blob binary, rules string")

    def findings(self) -> DataFrame:
        return self._read("findings", f"blob binary, rules string, spans {FINDING}")

    def update(self, versions: DataFrame, texts: DataFrame, rules: tuple[Rule, ...] = RULES, version: str = VERSION) -> None:
        """Scan what is new of ``versions`` (``path, blob``); ``texts`` has ``path, blob, text``."""
        done = self.scanned().filter(F.col("rules") == version).select("blob")
        unseen = versions.groupBy("blob").agg(F.min("path").alias("path")).join(done, "blob", "left_anti")
        unseen = kept(unseen, "unseen-blobs")
        found = (
            scan(texts.join(unseen, ["path", "blob"], "left_semi"), rules)
            .filter(F.size("spans") > 0)
            .select("blob", F.lit(version).alias("rules"), "spans")
            .dropDuplicates(["blob"])
        )
        found.write.mode("append").parquet(f"{self.path}/findings")
        unseen.select("blob", F.lit(version).alias("rules")).write.mode("append").parquet(f"{self.path}/scanned")


def findings_of_paths(docs: DataFrame, path: str = "doc_id", ledger: BlobLedger | None = None) -> DataFrame:
    """``path, spans`` of every row of ``docs``; spans is an empty list where nothing was found."""
    ledger = ledger or BlobLedger(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col(path).cast("string"), F.lit(""))
    texts = docs.select(key.alias("path"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob"), text.alias("text"))
    versions = kept(docs.select(F.col(path).alias("id"), key.alias("path"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob")), "versions")
    ledger.update(versions.select("path", "blob"), texts)
    found = ledger.findings().filter(F.col("rules") == VERSION).select("blob", "spans")
    joined = versions.join(found, "blob", "left")
    return joined.select(F.col("id").alias(path), F.coalesce("spans", F.array().cast(FINDING)).alias("spans"))


def joined_spans(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

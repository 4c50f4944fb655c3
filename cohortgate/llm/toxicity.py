"""Toxicity scores from gradient-boosted trees over dense features, with isotonic calibration.

A bounded sample of labelled rows is drawn by hash. From one part of it the lexicon is learned:
words and word beginnings that toxic rows hold far more often than others. Dense features are then
densities and counts of lexicon words and beginnings, lexicon words near the second person, rates
of capitals, punctuation and obfuscated words, and length. The trees learn on the same part; the
other part fits a monotone curve from the trees' raw score to the label. Every whole text is scored
in one scan without a shuffle.

Bounds: ``sample_rows`` labelled rows, ``LEXICON`` entries of either kind.

Defined results: a null text counts as empty, and an empty text has a score as every other; a row
whose labels contradict each other counts as toxic; without labels of both kinds the score is the
share of toxic labels (0 without labels). Repeated rows score alike; an empty table gives an empty
result; other columns are neither read nor changed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortgate.llm.tables import kept

SEED = 23
LEXICON = 1_000
STEMS = (4, 5)
WORDS = re.compile(r"[^\W\d_]+(?:[*@$!1035#]+[^\W\d_]+)*")
MIXED = re.compile(r"[*@$!1035#]")
PLAIN = str.maketrans("@$!1035", "asilose")
SECOND_PERSON = frozenset(
    "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine euch ihr tú ti usted vosotros tus".split()
)
NEAR = 5
NAMES = (
    "word_density", "word_count", "stem_density", "stem_count", "near_second_person", "second_person",
    "capitals", "shouted", "punctuation", "marks", "obfuscated", "obfuscated_lexicon", "length",
)


def features(text: str | None, words: frozenset[str], stems: frozenset[str]) -> list[float]:
    """The dense features of one text, in the order of NAMES."""
    text = text or ""
    found = WORDS.findall(text)
    low = [w.lower() for w in found]
    n, size = max(1, len(low)), max(1, len(text))
    hits, stem_hits, mixed, mixed_hits = [], 0, 0, 0
    for at, w in enumerate(low):
        if w in words:
            hits.append(at)
        elif len(w) > 3 and (w[:4] in stems or w[:5] in stems):
            stem_hits += 1
        elif not w.isalpha() and MIXED.search(w):
            mixed += 1
            mixed_hits += w.translate(PLAIN) in words
    second = [at for at, w in enumerate(low) if w in SECOND_PERSON]
    near = 0
    if hits and second:
        spots = np.asarray(second)
        for at in hits:
            near += bool((np.abs(spots - at) <= NEAR).any())
    capitals = sum(map(str.isupper, text)) if not text.islower() else 0
    shouted = sum(map(str.isupper, found))
    letters = sum(map(len, found))
    marks = text.count("!") + text.count("?") + text.count("*")
    return [
        len(hits) / n, len(hits), stem_hits / n, stem_hits, near, len(second) / n, capitals / size,
        shouted / n, (size - letters - text.count(" ")) / size, marks / size, mixed / n, mixed_hits, float(np.log1p(len(low))),
    ]


def _with_features(rows: DataFrame, words: frozenset[str], stems: frozenset[str]) -> DataFrame:
    """``rows`` without text, and the array ``x``."""
    rest = [c for c in rows.columns if c != "text"]

    def compute(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = [features(t, words, stems) for t in frame["text"]]
            yield frame[rest].assign(x=x)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*rest).schema.fields)
    return rows.mapInPandas(compute, f"{fields}, x array<double>")


def learned_lexicon(rows: DataFrame, least: int = 4, odds: float = 20.0) -> tuple[frozenset[str], frozenset[str]]:
    """Words, and word beginnings, whose share of toxic rows is ``odds`` times that of the others."""
    lowered = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    split = rows.select("label", F.array_distinct(lowered).alias("words"))
    total = split.agg(F.sum("label").alias("bad"), F.count(F.lit(1)).alias("n")).first()
    good = max(1.0, total.n - total.bad)

    def best(entries: Column) -> frozenset[str]:
        each = split.select("label", F.explode(F.array_distinct(entries)).alias("entry"))
        counted = each.groupBy("entry").agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"))
        ratio = (F.col("bad") / max(1.0, total.bad)) / ((F.col("good") + 0.5) / good)
        strong = counted.withColumn("ratio", ratio).filter((F.col("bad") >= least) & (F.col("ratio") >= odds))
        return frozenset(r.entry for r in strong.orderBy(F.desc("bad"), "entry").limit(LEXICON).collect())

    long_enough = F.filter("words", lambda w: F.length(w) > max(STEMS))
    beginnings = F.concat(*[F.transform(long_enough, lambda w, s=s: F.substring(w, 1, s)) for s in STEMS])
    return best(F.col("words")), best(beginnings)


class ToxicityModel:
    """Lexicon, trees and calibration curve, learned from (text, label) rows."""

    def __init__(self, docs: DataFrame, labels: DataFrame, eligible: Column, sample_rows: int = 12_000, rounds: int = 20, depth: int = 3):
        keys = labels.filter(eligible & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        keys = keys.groupBy("doc_id").agg(F.max("toxic").cast("double").alias("label"))
        keys = keys.withColumn("hash", F.xxhash64(F.col("doc_id").cast("string"), F.lit(SEED)))
        chosen = keys.orderBy("hash", "doc_id").limit(sample_rows)  # bounded, so it may be broadcast
        rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        rows = kept(rows.select("hash", "label", F.coalesce("text", F.lit("")).alias("text")), "toxicity-sample")
        seen = rows.groupBy("label").count().collect()
        counts = {r.label: r["count"] for r in seen}
        self.base = counts.get(1.0, 0) / max(1, sum(counts.values()))
        self.trees = self.curve = None
        self.words = self.stems = frozenset()
        learn, check = rows.filter(F.pmod("hash", F.lit(3)) != 0), rows.filter(F.pmod("hash", F.lit(3)) == 0)
        both = learn.agg(F.countDistinct("label").alias("n")).first().n == 2 and not check.isEmpty()
        if not both:
            return
        self.words, self.stems = learned_lexicon(learn)
        dense = self._vectors(_with_features(rows, self.words, self.stems).coalesce(4)).persist()
        learn, check = dense.filter(F.pmod("hash", F.lit(3)) != 0), dense.filter(F.pmod("hash", F.lit(3)) == 0)
        trees = GBTClassifier(featuresCol="v", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=SEED, cacheNodeIds=False, checkpointInterval=-1)
        self.trees = trees.fit(learn)
        raw = self._raw(check).select("raw", "label")
        self.curve = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(raw)
        dense.unpersist()

    @staticmethod
    def _vectors(rows: DataFrame) -> DataFrame:
        return rows.withColumn("v", array_to_vector("x"))

    def _raw(self, rows: DataFrame) -> DataFrame:
        self.trees.setRawPredictionCol("margin").setProbabilityCol("").setPredictionCol("")
        return self.trees.transform(rows).withColumn("raw", vector_to_array("margin")[1])

    def scored(self, docs: DataFrame) -> DataFrame:
        """``docs`` without its text, and ``score`` and ``predicted``."""
        if self.trees is None:
            out = docs.drop("text", "score").withColumn("score", F.lit(float(self.base)))
        else:
            rest = [c for c in docs.columns if c not in ("text", "score")]
            held = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("__row"), "text")
            dense = self._raw(self._vectors(_with_features(held, self.words, self.stems)))
            out = self.curve.transform(dense.select("__row", "raw")).select("__row.*", F.col("score").cast("double"))
        score = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
        return out.withColumn("score", score).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

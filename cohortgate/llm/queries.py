"""The operators' queries over their whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortgate.llm import audit, bitslice, digests, language, minhash, mixing, packing, parsing, prefixes, ranking, secrets, toxicity, urlrules
from cohortgate.llm.tables import holdout


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslice.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op2_cross_parsing_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = holdout(F.col("doc_id"), 4, 2)
    samples = language.learned_samples(docs, ~held)
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    return language.predicted(rows, samples).drop("text")


def op3_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = holdout(F.col("doc_id"), 5, 0)
    model = toxicity.ToxicityModel(docs, table(spark, sf_dir, "labels"), ~held)
    return model.scored(docs.select("doc_id", held.alias("held_out"), "text"))


RULES = (
    urlrules.UrlRule("allow", "org", "/"),
    urlrules.UrlRule("block", "example.org", "/es/"),
    urlrules.UrlRule("block", "example.org", "/en/1"),
    urlrules.UrlRule("allow", "com", "/fr/"),
    urlrules.UrlRule("block", "com", "/de/"),
)


def op4_wildcard_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judged(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)


def op5_blob_ledger_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.findings_of_paths(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    digest = F.sha2(secrets.joined_spans(base).cast("binary"), 256).alias("base_sha256")
    spans = secrets.joined_spans(F.col("spans")).alias("spans")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), digest, spans)


def op6_parsed_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = parsing.without_repeats(table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, run: n + run["stop"] - run["begin"])
    return left.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_digest_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.deduplicated(table(spark, sf_dir, "documents"))


def op8_sketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = F.col("__mix")
    taken = (mix["copies"] * mix["size"]).cast("long").alias("taken")
    mixed = mixing.copies(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", mix["size"].alias("size"), mix["source_size"].alias("source_size"), mix["target"].alias("target"), taken)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return packing.packed(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op11_nra_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = prefixes.encoded(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)
    count = F.octet_length("ids").cast("long") / F.lit(4)
    return coded.select(
        "doc_id", count.cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_bit_sliced_top_k, op2_cross_parsing_language, op3_boosted_toxicity, op4_wildcard_url_filter,
        op5_blob_ledger_secrets, op6_parsed_substring_dedup, op7_digest_index_dedup, op8_sketch_near_dedup, op9_source_mixing, op10_best_fit_packing,
        op11_nra_ranked_search, op12_prefix_bpe, op13_filter_audit,
    )
}

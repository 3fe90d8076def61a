"""The operators of this package as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import brown, decontaminate, filter_audit, mixing, page_diff, periodic_runs, quality_rules, secret_scan, sharding, simhash, token_scan, warc, weak_labels
from tallyline.llm.oracles import ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through WARC archives and back, one row per assembled capture."""
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the adaptive quality rules for every document."""
    found = quality_rules.quality_verdicts(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_page_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = page_diff.main_texts(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"), "n_outside", "n_shared")


def op4_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document under the class bigram model."""
    return brown.class_model_scores(_table(spark, sf_dir, "documents"))


def op5_token_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat token files."""
    return token_scan.token_counts(_table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and items of every document that lie in benchmark windows."""
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", decontaminate.items_digest(F.col("item_ids")).alias("items_sha256"), "contaminated")


def op6_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of every document whose terms lie close together in any order."""
    found = decontaminate.proximity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_near", F.size("near_items").cast("bigint").alias("n_near_items"), decontaminate.items_digest(F.col("near_items")).alias("near_items_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of near duplicates for every document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the base forms, and all spans."""
    found = secret_scan.scan_documents(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint")
    base = secret_scan.written(F.filter("found", lambda s: s["kind"] < 3))
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(base, 256).alias("base_sha256"),
        secret_scan.written(F.col("found")).alias("spans"),
    )


def op10_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of the weakly supervised quality classifier for every document."""
    found = weak_labels.classify(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.round("quality_score", 6).alias("quality_score"), "accepted")


def _with_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` as words with one space between them; a tenth of the texts, by checksum of the id, ends in repeats.

    Of n words, those from place a on repeat the p words from there, a and p by the same checksum.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(own: Column) -> Column:
        n, g = F.size(own).cast("bigint"), F.floor(h / 10)
        a = g % n
        p = 1 + F.call_function("div", n - a, 3 + g % 8)
        block = F.slice(own, (a + 1).cast("int"), p.cast("int"))
        tail = F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int")))
        return F.concat(F.slice(own, F.lit(1), a.cast("int")), F.slice(tail, F.lit(1), (n - a).cast("int")))

    changed = F.transform(F.array(words), lambda own: F.when(F.size(own) > 0, F.array_join(repeated(own), " ")).otherwise(""))[0]
    return docs.select("doc_id", F.when(h % 10 == 0, changed).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, longest and digests of the periodic runs of every document."""
    found = periodic_runs.periodic_runs(_with_repeats(_table(spark, sf_dir, "documents")))
    longest = found.withColumn("longest", periodic_runs.longest_run(F.col("runs")))
    return longest.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "longest.start",
        "longest.length",
        "longest.period",
        F.expr("1000 * longest.length div longest.period").alias("exponent_milli"),
        F.sha2(periodic_runs.written(F.col("runs")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document by rendezvous hashing, and its shard among one more."""
    found = sharding.assign(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in every order, per language, with their shares of the removal."""
    return filter_audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_quality_rules": op2_quality_rules,
    "op3_page_diff": op3_page_diff,
    "op4_brown": op4_brown,
    "op5_token_scan": op5_token_scan,
    "op6_decontaminate": op6_decontaminate,
    "op6_proximity": op6_proximity,
    "op7_simhash": op7_simhash,
    "op8_mixing": op8_mixing,
    "op9_secret_scan": op9_secret_scan,
    "op10_weak_labels": op10_weak_labels,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_sharding": op12_sharding,
    "op13_filter_audit": op13_filter_audit,
}

__all__ = ["ORACLES", "QUERIES"]

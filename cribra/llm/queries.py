"""The registered queries ``opN_<name>`` over whole tables, and ``pipeline``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cribra.llm import (decontam, licenses, lines, merkle, neighbours, packing, passages, prefixes,
                        quality, secrets, simhash, toxicity, warc)
from cribra.session import checkpoint_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(_table(spark, sf_dir, "documents"),
                                        _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first scan: the ledger of a new folder is empty, and keeps what was scanned."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}"
    found, new = secrets.scan_versions(_table(spark, sf_dir, "documents"),
                                       secrets.read_ledger(spark, path))
    secrets.append_ledger(new, path)
    base = F.filter("spans", lambda s: s["rule"] < len(secrets.BASE))

    def n(k: int) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["rule"] == k)).cast("long")

    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.duplicate_passages(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped",
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies (op7's components) and documents of one source never share a bin."""
    return packing.best_fit(_table(spark, sf_dir, "documents"), near=True)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written to a new folder of the shared checkpoint folder and read back from there."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    return warc.read_records(spark, path).drop("verified")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan_licenses(_table(spark, sf_dir, "documents")))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of ``documents``; where the id's crc32 is even, a text loses its newlines later."""
    cut = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0,
                 F.translate("text", "\n", "")).otherwise(F.col("text"))
    now = merkle.record_digest(*[cut if f == "text" else F.col(f) for f in merkle.FIELDS])
    return merkle.verify(_table(spark, sf_dir, "documents"), now)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return prefixes.trie(prefixes.rebuilt(prefixes.sequences(turns)))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_decontamination, op2_toxicity, op3_secret_scan, op4_nearest_neighbours,
    op5_substring_dedup, op6_line_dedup, op7_simhash, op8_best_fit_packing, op9_quality,
    op10_warc, op11_license_scan, op12_merkle_manifest, op13_prefix_trie, pipeline)}

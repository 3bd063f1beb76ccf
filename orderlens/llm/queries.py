"""One query per operator: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, centroids, embedding_dedup, hard_negatives, license_scan, packing, pitman_yor, quality, secret_scan,
               simhash, suffix_dedup, toxicity)
from .oracles import ORACLES  # noqa: F401 - registered with the queries
from .substring_dedup import repeated_words


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file."""
    return importlib.import_module("public_tokenizers").path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and the text that they decode to."""
    out = bpe.encode(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), decoded=True)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label linked by cosine 0.93 or more."""
    out = embedding_dedup.link(_table(spark, sf_dir, "embeddings"), threshold=0.93)
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text: base rules and inferred formats."""
    docs = _table(spark, sf_dir, "documents")
    out = secret_scan.scan(docs, secret_scan.learn(docs))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "inferred")
    return out.select("doc_id", *map(count, secret_scan.KINDS[:3]),
                      F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every text and the verdict of the fertility bands."""
    measured = quality.measures(_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
    return quality.judge(measured).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "band", "n_tokens", *quality.MEASURES)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 4-word shingles, linked at 4 or fewer differing bits."""
    out = simhash.group(_table(spark, sf_dir, "documents"), shingle=4, max_bits=4, seed=42)
    return out.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability that a text is toxic; every fourth id is held out of learning."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    weights = toxicity.train(docs, _table(spark, sf_dir, "labels"), ~held_out)
    out = toxicity.score(docs, weights)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes repeated in 50-byte strings of smaller documents removed."""
    out = suffix_dedup.repeated_bytes(_table(spark, sf_dir, "documents"), size=50)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every text; every seventh id is held out of learning."""
    return pitman_yor.score(_table(spark, sf_dir, "documents"), modulus=7, remainder=2)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words repeated in 50-word windows of smaller documents removed."""
    out = repeated_words(_table(spark, sf_dir, "documents"), size=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 ids in sequences of at most 4096."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"),
                                  end_id=2, length=4096)


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases of every text, and the notices that its lines hold."""
    out = license_scan.label(_table(spark, sf_dir, "documents"), threshold=0.9, run=3)
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word",
                      *(F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")), "score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of another label that score 30 to 90 percent of an anchor's positives."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings").withColumn("label", label), every=100, positives=5,
                               negatives=10, least=30, most=90, scale=256)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector after ten rounds, with the clusters' inertia and centroids."""
    found, centres = centroids.cluster(_table(spark, sf_dir, "embeddings"), k=8, dims=64, scale=1024, rounds=10, seed=3)
    texts = F.array(*(F.lit(",".join(map(str, c))) for c in centres.tolist())).cast("array<string>")
    return centroids.with_inertia(found).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia",
        F.sha2(F.get(texts, F.col("cluster")), 256).alias("centroid_sha256"))


# corpus_pipeline is at the repository's top and imports this module for its vocabulary places
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over documents."""
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_bpe, op2_embedding_dedup, op3_secret_scan, op4_quality, op5_simhash, op6_toxicity, op7_suffix_dedup,
        op8_pitman_yor, op9_substring_dedup, op10_packing, op11_license_scan, op12_hard_negatives, op13_centroids,
        pipeline)}

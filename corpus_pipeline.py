"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet to the shared folder and rereads it as the next one's ``docs``,
so that a lost executor costs one stage's part at most. All stages but the
last return the columns of documents, whichever they are:

toxicity   documents scored 0.3 or more are rejected
simhash    of each group of near copies the smallest id stays
substring  words repeated in 50-word windows of smaller documents go
secrets    secrets are masked
packing    texts become pieces of at most 4096 ids in sequences of 4096

Defined results: null ids and texts pass through the first four; an emptied
text stays, as a document without words. Rows with equal ids are one document
for SimHash and for substrings (they don't remove each other's words), and
documents of their own for the rest; repeated rows stay, as a group keeps all
rows of its smallest id. Empty tables give empty tables; texts of any length
are whole. Further columns pass through, whatever their names, but ``n_chars``,
where there is one, follows the text. The last stage returns pieces: their
places, lengths, checksums and ids (an array of int), ready to be laid out by
``sequence_id`` and ``offset``.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.llm import packing, secret_scan, simhash, substring_dedup, toxicity
from orderlens.llm.chunks import Chunks
from orderlens.llm.queries import tokenizer
from orderlens.session import scratch_path


def _sized(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars`` as long as the text now is."""
    if "n_chars" not in docs.columns:
        return docs
    length = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return docs.withColumn("n_chars", length)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learned_from = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2
    weights = toxicity.train(docs, labels, learned_from)
    into = "score"
    while into in docs.columns:
        into = "_" + into
    return toxicity.score(docs, weights, into=into).where(F.col(into) < 0.3).drop(into)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs, shingle=4, max_bits=4, seed=42)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(substring_dedup.repeated_words(docs, size=50, replace=True))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(secret_scan.redact(docs, secret_scan.learn(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the workers serve other stages too, so they keep fewer words than a job of its own would
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"), end_id=2, length=4096, with_ids=True,
                                  cache_words=150_000)


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("substring", cut_repeats),
          ("secrets", mask_secrets), ("packing", pack)]

#: SQL can't express the stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the stages make of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = scratch_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for number, (name, stage) in enumerate(STAGES):
        path = os.path.join(place, f"{number}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        Chunks.release_all()
        docs = spark.read.parquet(path)
    return docs

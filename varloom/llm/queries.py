"""The registered queries of these operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

import functools
import os
import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm import ann, bpe, html, licences, media, minhash, negatives, packing, pii, sharding, toxicity, vector_codes, vector_near
from varloom.llm._shared import read, workspace
from varloom.llm.sql import ORACLE_SQL  # noqa: F401  SQL where it can express the query



@functools.lru_cache(maxsize=1)
def pseudonym_key() -> str:
    """The secret of the pseudonyms: VARLOOM_PSEUDONYM_KEY, or else one made for this process, so that nobody can invert them.

    Set it where pseudonyms of several runs must be equal.
    """
    return os.environ.get("VARLOOM_PSEUDONYM_KEY") or secrets.token_hex(32)


def vocabulary() -> str:
    """The tokenizer file; a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(read(spark, sf_dir, "documents"), 40, map_path=workspace(spark, "slot-map"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.media_columns(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.col("length").alias("media_bytes"), "media_sha256", "feature", "width", "height", "bit_depth", "shard", "offset")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    files = docs.select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "text")
    # The table has no file names: a document of which at least half the sentences speak of a licence is its directory's licence file.
    return licences.scan(files, licence_file=F.col("n_speaking") * 2 >= F.col("n_sentences"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), vocabulary(), capacity=1024, end_id=2)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(read(spark, sf_dir, "documents").select("doc_id", "text"), pseudonym_key(), found="n_found")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out"), "score", "predicted")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), every=20, k=20)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(read(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096).drop("label")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return negatives.hard_negatives(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))), every=100, positives=5, negatives=10, least=30, most=90, scale=256)


def op13_vector_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_near.near_vectors(read(spark, sf_dir, "embeddings"), threshold=0.98)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_bpe, op2_sharding, op3_media, op4_minhash, op5_licences, op6_packing, op7_pii, op8_html, op9_toxicity, op10_ann, op11_vector_codes, op12_hard_negatives, op13_vector_near, pipeline)}


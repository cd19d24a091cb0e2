"""The corpus pipeline: toxicity, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again for the next stage.  All but the last return the
columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm import minhash, packing, pii, toxicity
from varloom.llm._shared import materialize, read, tidy, written
from varloom.llm.queries import pseudonym_key, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from `labels` and the texts of `documents`; rejected rows go."""
    model = toxicity.fit(*toxicity.training_rows(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))  # its texts are freed here
    return toxicity.score(docs, model).where(F.col("score") < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; repeated rows of one document count as copies.

    A row is known by its doc_id and its text's hash, as one doc_id may stand
    on different texts.  Only rows that go or repeat are looked up; the text of
    repeated rows decides among them.
    """
    near = minhash.near_duplicates(docs).groupBy(F.col("doc_id").alias("_varloom_id"), F.col("text_hash").alias("_varloom_hash")).agg(F.min("kept").alias("_varloom_kept"), F.count(F.lit(1)).alias("_varloom_rows"))
    told = materialize(near.where(~F.col("_varloom_kept") | (F.col("_varloom_rows") > 1)), "told")
    marked = docs.withColumn("_varloom_h", F.xxhash64(F.col("text").cast("string")))
    # The same plan at every size: the list of decided rows grows with the table, so it is not broadcast.
    marked = marked.join(told.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col("_varloom_id")) & (F.col("_varloom_h") == F.col("_varloom_hash")), "left")
    once = marked.where(F.col("_varloom_kept").isNull()).select(*docs.columns)
    return once.unionByName(marked.where("_varloom_kept").select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def pseudonymize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.pseudonymize(docs, pseudonym_key())
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary(), capacity=1024, end_id=2)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("pii", pseudonymize), ("packing", pack)]
#: SQL cannot express the nearest-example vote, the groups or the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    start = written()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
            tidy(start, docs)
    return docs

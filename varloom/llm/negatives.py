"""Hard negatives by distributed radix selection.

A row's score for an anchor is the inner product of their integer vectors,
floor(scale * x).  An anchor's positives are its best rows of the same label;
an (anchor, positive) pair opens a window of scores, between two shares of the
positive's score, and its hard negatives are the best rows of other labels in
that window.  Higher scores come first, ties by smaller id.

Selection never sorts the scores.  Every task counts the rows of each window in
256 buckets of equal width; the sums locate the bucket that holds the kth row;
that bucket is cut into 256 again, until hardly more than k rows lie at or
above it.  Where rows without end have the kth score, the same digits go on
over the ids.  Then one pass gathers the rows that qualify, at most 2 k a
window.  A task reports a window's buckets only down to its own kth row: the
kth of all rows cannot lie lower, so counts above that bucket are complete.

Anchors are a stated query set.  They meet all rows in blocks of at most about
`block` anchors, whose vectors and windows (a size that does not depend on the
table) are sent to all tasks; the rows stay where they are, and no key brings
rows together, so a label, a vector or a score that a third of all rows share
costs nothing more.

Rows take no part if the id or the label is null, or the vector is null, holds
null or non-finite components or is not of the commonest length.  Rows that
repeat id, label and vector count once; an id with several vectors is several
candidates, and as an anchor stands for its smallest label and vector; rows of
the anchor's id are not its candidates.  Inner products must stay below 2^53,
or an error is raised.  Anchors without positives, and windows without rows,
give no rows.  Columns of other names are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from varloom.llm._shared import importable, materialize, workspace
from varloom.llm._vectors import length_of, matrix, whole

DIGIT = 8  # bits
COUNT = T.StructType([T.StructField("window", T.IntegerType()), T.StructField("need", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])
HIT = T.StructType([T.StructField("window", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def integer_rows(df: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """vec_id, label, x (floor of scale times the vector) of the rows that take part, each once."""
    v = F.col(f"`{vector}`").cast("array<double>")
    kept = df.where(whole(v)).select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"), F.transform(v, lambda x: F.floor(x * scale)).alias("x"))
    return kept.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull()).distinct()


class Windows:
    """Windows of a block of anchors, `slots` for each: an inclusive range of scores each (none where low > high), and how many rows are wanted."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, k: int, id_range: tuple[int, int]):
        self.ids, self.labels, self.vectors, self.same, self.k = ids, labels, vectors.astype(np.float64), same, k
        self.top = high.astype(np.int64)  # slots x anchors
        self.low, self.high = low.astype(np.int64), self.top.copy()  # of the bucket at hand
        self.above = np.zeros_like(self.low)  # rows better than that bucket
        self.tie = np.zeros(self.low.shape, bool)  # the bucket is one score; its rows are told apart by id
        self.id_low, self.id_high = np.full_like(self.low, id_range[0]), np.full_like(self.low, id_range[1])
        self.open = self.low <= self.high
        self.least, self.last_id = self.low.copy(), self.id_high.copy()  # what the gathering takes

    def shifts(self) -> np.ndarray:
        width = np.where(self.tie, self.id_high - self.id_low, self.high - self.low)
        bits = np.array([int(w).bit_length() for w in width.ravel()]).reshape(width.shape)
        return np.maximum(0, bits - DIGIT)

    def scored(self, batches, rows: int):
        """Ids, scores (anchors x rows) and which of them are candidates, for small batches."""
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, rows):
                b = whole_batch.slice(at, rows)
                ids, labels = b.column("vec_id").to_numpy(), b.column("label").to_numpy()
                score = self.vectors @ matrix(b.column("x"), self.vectors.shape[1]).astype(np.float64).T
                own = self.labels[:, None] == labels[None, :]
                yield ids, score, (own & (self.ids[:, None] != ids[None, :])) if self.same else ~own

    def count(self, batches, rows: int = 512):
        slots, anchors = self.low.shape
        held = np.zeros((slots * anchors, 1 << DIGIT), np.int64)
        shift = self.shifts()
        for ids, score, allowed in self.scored(batches, rows):
            for s in range(slots):
                if not self.open[s].any():
                    continue
                hit = allowed & self.open[s][:, None] & (score >= self.low[s][:, None]) & (score <= self.high[s][:, None])
                a, r = np.nonzero(hit)
                offset = self.high[s][a] - score[a, r].astype(np.int64)
                tied = self.tie[s][a]
                if tied.any():
                    inside = ~tied | ((ids[r] >= self.id_low[s][a]) & (ids[r] <= self.id_high[s][a]))
                    a, r, offset, tied = a[inside], r[inside], offset[inside], tied[inside]
                    offset = np.where(tied, ids[r] - self.id_low[s][a], offset)
                np.add.at(held, (s * anchors + a, offset >> shift[s][a]), 1)
        need = (self.k - self.above).ravel()
        so_far = held.cumsum(1) - held
        w, bucket = np.nonzero((held > 0) & (so_far < need[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(w.astype(np.int32)), pa.array(need[w]), pa.array(bucket.astype(np.int32)), pa.array(held[w, bucket])], names=COUNT.names)

    def refine(self, located: dict[int, tuple[int, int, int]]) -> None:
        """Go into the buckets that hold the kth rows (window: bucket, rows down to it, rows in it); windows not named hold fewer than k rows and take all."""
        shift, (slots, anchors) = self.shifts(), self.low.shape
        for s, a in zip(*np.nonzero(self.open), strict=True):
            if int(s * anchors + a) not in located:
                self.open[s, a], self.least[s, a], self.last_id[s, a] = False, self.low[s, a], self.id_high[s, a]
                continue
            bucket, down_to, inside = located[int(s * anchors + a)]
            step = 1 << int(shift[s, a])
            if self.tie[s, a]:
                self.id_low[s, a] += bucket * step
                self.id_high[s, a] = min(self.id_high[s, a], self.id_low[s, a] + step - 1)
                single = self.id_low[s, a] == self.id_high[s, a]
            else:
                self.high[s, a] -= bucket * step
                self.low[s, a] = max(self.low[s, a], self.high[s, a] - step + 1)
                single = False
            few = self.above[s, a] + down_to <= 2 * self.k
            self.above[s, a] += down_to - inside
            if few or single:
                self.open[s, a], self.least[s, a], self.last_id[s, a] = False, self.low[s, a], self.id_high[s, a]
            elif not self.tie[s, a] and self.low[s, a] == self.high[s, a]:
                self.tie[s, a] = True

    def gather(self, batches, rows: int = 512):
        anchors = self.low.shape[1]
        for ids, score, allowed in self.scored(batches, rows):
            for s in range(len(self.low)):
                least = self.least[s][:, None]
                a, r = np.nonzero(allowed & (score >= least) & (score <= self.top[s][:, None]) & ((score > least) | (ids[None, :] <= self.last_id[s][:, None])))
                yield pa.RecordBatch.from_arrays([pa.array((s * anchors + a).astype(np.int32)), pa.array(ids[r]), pa.array(score[a, r].astype(np.int64))], names=HIT.names)


def best(rows: DataFrame, windows: Windows) -> DataFrame:
    """window, vec_id, score, rank: the k best rows of each window."""
    spark = rows.sparkSession
    while windows.open.any():
        sent = spark.sparkContext.broadcast(windows)  # bounded by the block
        counts = rows.mapInArrow(lambda batches, sent=sent: sent.value.count(batches), COUNT).groupBy("window", "need", "bucket").agg(F.sum("n").alias("n"))
        down = counts.withColumn("upto", F.sum("n").over(W.partitionBy("window").orderBy("bucket")))
        located = down.where("upto >= need").groupBy("window").agg(F.min(F.struct("bucket", "upto", "n")).alias("at")).collect()  # a row a window of the block
        windows.refine({r["window"]: tuple(r["at"]) for r in located})
    sent = spark.sparkContext.broadcast(windows)
    found = rows.mapInArrow(lambda batches: sent.value.gather(batches), HIT)
    return found.withColumn("rank", F.row_number().over(W.partitionBy("window").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= windows.k)


def hard_negatives(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = 100, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = 256, block: int = 4096) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors: ids divisible by `every`.  A negative's score lies between
    `least` and `most` hundredths of the positive's.
    """
    spark = df.sparkSession
    importable(spark)
    rows = integer_rows(df, key, vector, label, scale)
    dims = length_of(rows, "x")
    square = F.aggregate("x", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    rows = rows.where(F.size("x") == dims).withColumn("_s", square)
    rows = materialize(rows, "rows")
    got = rows.agg(F.max("_s").alias("top"), F.min("vec_id").alias("low"), F.max("vec_id").alias("high"), F.count_if(F.col("vec_id") % every == 0).alias("anchors")).first()
    if not got["anchors"] or not dims:
        return spark.createDataFrame([], OUT)
    if got["top"] >= 1 << 53:
        raise ValueError("inner products of the scaled vectors must stay below 2^53")
    rows = rows.drop("_s")
    blocks = -(-got["anchors"] // block)
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r")).select("vec_id", "r.label", "r.x", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"))
    asked = materialize(asked.repartition("block").sortWithinPartitions("block"), "anchors")
    path = workspace(spark, "negatives")
    spark.createDataFrame([], OUT).write.parquet(path)
    for b in range(blocks):  # about `block` anchors each
        part = asked.where(F.col("block") == b).orderBy("vec_id").collect()
        if not part:
            continue
        ids, labels, x = np.array([r["vec_id"] for r in part], np.int64), np.array([r["label"] for r in part], np.int64), np.array([r["x"] for r in part], np.int64)
        reach = np.ceil(np.sqrt((x.astype(np.float64) ** 2).sum(1) * got["top"]) * (1 + 1e-9)).astype(np.int64)[None, :] + 1
        nearest = Windows(ids, labels, x, True, -reach, reach, positives, (got["low"], got["high"]))
        positive = np.zeros((positives, len(ids)), np.int64)
        score, there = positive.copy(), np.zeros(positive.shape, bool)
        for r in best(rows, nearest).collect():  # at most `positives` an anchor of the block
            slot, a = r["rank"] - 1, r["window"]
            positive[slot, a], score[slot, a], there[slot, a] = r["vec_id"], r["score"], True
        low, high = -(-least * score // 100), most * score // 100
        found = best(rows, Windows(ids, labels, x, False, np.where(there, low, 1), np.where(there, high, 0), negatives, (got["low"], got["high"])))
        names = spark.createDataFrame([(int(s * len(ids) + a), int(ids[a]), int(positive[s, a]), int(score[s, a])) for s, a in zip(*np.nonzero(there), strict=True)], "window int, anchor_id long, positive_id long, positive_score long")
        found.join(F.broadcast(names), "window").select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
    return spark.read.schema(OUT).parquet(path)

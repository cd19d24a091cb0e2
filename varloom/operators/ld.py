"""Linkage disequilibrium: correlated pairs, scores, and pruning to an independent set."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.operators.ranges import window_pairs
from varloom.operators.ranks import lowest


def standardize(df: DataFrame, vector: str) -> DataFrame:
    """The vector with mean 0 and length 1, so that r is a dot product.  Constant vectors become null."""
    v = F.col(vector).cast("array<double>")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    centred = F.transform(v, lambda x: x - total(v) / F.size(v))
    out = df.withColumn(vector, centred)
    norm = F.sqrt(total(F.transform(F.col(vector), lambda x: x * x)))
    return out.withColumn("_n", norm).withColumn(vector, F.when(F.col("_n") > 0, F.transform(F.col(vector), lambda x: x / F.col("_n")))).drop("_n")


def ld_pairs(df: DataFrame, window: int, r2_min: float, key: str = "vec_id", vector: str = "embedding", position: str | None = None, chrom: str | None = None) -> DataFrame:
    """i, j, r2 of pairs with i before j, at most `window` apart on one chromosome, and r2 of at least r2_min.

    `vector` must be standardised (or of any length: the cosine is taken).
    """
    v = F.col(vector).cast("array<double>")
    sq = F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda s, x: s + x)
    pos = position or key
    rows = df.select(*dict.fromkeys([key, pos] + ([chrom] if chrom else [])), v.alias("v"), sq.alias("sq"))
    pairs = window_pairs(rows, window, pos, chrom)
    dot = F.aggregate(F.zip_with("a.v", "b.v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    r2 = F.try_divide(dot * dot, F.col("a.sq") * F.col("b.sq"))
    keep = [F.col(f"a.{chrom}").alias(chrom)] if chrom else []
    return pairs.select(*keep, F.col(f"a.{key}").alias("i"), F.col(f"b.{key}").alias("j"), r2.alias("r2")).where(F.col("r2") >= r2_min)


def ld_score(pairs: DataFrame, r2_min: float = 0.0, own: bool = False) -> DataFrame:
    """Sum of r2 of each variant over its pairs, read in both directions; `own` adds 1 for the variant itself."""
    kept = pairs.where(F.col("r2") >= r2_min)
    # Both directions by exploding once: the pairs are scanned once.
    ends = kept.select(F.explode(F.array("i", "j")).alias("i"), "r2")
    return ends.groupBy("i").agg((F.sum("r2") + (1.0 if own else 0.0)).alias("ld_score"), F.count(F.lit(1)).alias("n_pairs"))


def _written(df: DataFrame, work: str | None) -> DataFrame:
    """Cut the lineage with a table in the shared folder, or with a reliable checkpoint there."""
    if work:
        path = f"{work.rstrip('/')}/prune-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return df.sparkSession.read.parquet(path)
    return df.checkpoint()


def prune_replicates(variants: DataFrame, pairs: DataFrame, r2: float, replicates: int = 20, seed: int = 0, maf: float | None = None, n: int | None = None, key: str = "vec_id", work: str | None = None) -> DataFrame:
    """rep and key of `replicates` (20 in production) independent prunings, each to a maximal set without a pair of r2 or more.

    Each replicate has a seeded random order.  Optional first steps: minor
    allele frequency of at least `maf`, a random subset of n.  Rounds, of all
    replicates at once: every open variant with the lowest hash among its open
    neighbours is taken, its neighbours are dropped.  The expected number of
    rounds grows with the logarithm of the table, not with the replicates.
    Pairs of variants that are not in the table do not count.
    """
    if not work:
        from varloom.sources.shared import checkpoint_folder

        checkpoint_folder(variants.sparkSession)
    if maf is not None:
        variants = variants.where(F.col("maf") >= maf)
    rep = F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep")
    nodes = variants.select(F.col(key).alias("v"), rep).withColumn("h", F.xxhash64("v", F.col("rep") + F.lit(seed)))
    if n is not None:
        nodes = lowest(nodes, "h", "rep", n, "v")
    nodes = _written(nodes.select("rep", "v", F.struct("h", F.col("v").alias("k")).alias("o")), work)
    strong = pairs.where((F.col("r2") >= r2) & (F.col("i") != F.col("j"))).select(F.explode(F.array(F.struct(F.col("i").alias("v"), F.col("j").alias("w")), F.struct(F.col("j").alias("v"), F.col("i").alias("w")))).alias("e")).select("e.*").distinct()
    at = ["rep", "v"]
    other = lambda df: df.withColumnRenamed("v", "w")
    edges = _written(strong.join(nodes, "v").join(other(nodes).withColumnRenamed("o", "ow"), ["rep", "w"]), work)
    taken = _written(nodes.join(edges.select(at).distinct(), at, "left_anti").select(at), work)  # without neighbours
    while edges.take(1):  # a round takes at least the open variant of the lowest hash, in every open replicate
        won = edges.groupBy(at).agg(F.min("ow").alias("least"), F.first("o").alias("o")).where(F.col("o") < F.col("least")).select(at)
        won = _written(won, work)
        gone = won.unionByName(edges.join(won, at, "left_semi").select("rep", F.col("w").alias("v"))).distinct()
        left = edges.join(gone, at, "left_anti").join(other(gone), ["rep", "w"], "left_anti")
        left = _written(left, work)
        # Open variants that lost all their neighbours are free.
        freed = edges.select(at).distinct().join(gone, at, "left_anti").join(left.select(at).distinct(), at, "left_anti")
        taken = _written(taken.unionByName(won).unionByName(freed), work)
        edges = left
    return taken.select("rep", F.col("v").alias(key))


def random_prune(variants: DataFrame, pairs: DataFrame, r2: float, seed: int = 0, **options) -> DataFrame:
    """One pruning: the key of a maximal set of variants without a pair of r2 or more, in a seeded random order."""
    return prune_replicates(variants, pairs, r2, 1, seed - 1, **options).drop("rep")


def bed_copies(bits: bytes, samples: int) -> np.ndarray:
    """Genotypes (variants x samples; copies of the first allele, -1 where missing) of a variant-major .bed file's records."""
    width = -(-samples // 4)
    raw = np.frombuffer(bits, np.uint8).reshape(-1, width)
    two = np.stack([(raw >> s) & 3 for s in (0, 2, 4, 6)], axis=2).reshape(len(raw), -1)[:, :samples]
    return np.array([2.0, -1.0, 1.0, 0.0])[two]


def decode_bed(bits: bytes, samples: int) -> list[list[int | None]]:
    """The same as lists, null where missing."""
    return [[None if g < 0 else int(g) for g in row] for row in bed_copies(bits, samples)]


def genotype_batch(name: str, first: int, copies: np.ndarray) -> pa.RecordBatch:
    n, samples = copies.shape
    flat = np.ascontiguousarray(copies).ravel()
    g = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * samples), pa.array(flat, mask=flat < 0))
    return pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(first, first + n, dtype=np.int64)), g], names=["file", "i", "g"])


def genotype_vectors(genotypes: DataFrame) -> DataFrame:
    """Missing genotypes as the variant's mean (0 if all are missing); other columns stay."""
    known = F.filter("g", lambda x: x.isNotNull() & ~F.isnan(x))
    mean = F.coalesce(F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known)), F.lit(0.0))
    return genotypes.withColumn("_m", mean).withColumn("g", F.transform("g", lambda x: F.when(x.isNotNull() & ~F.isnan(x), x).otherwise(F.col("_m")))).drop("_m")

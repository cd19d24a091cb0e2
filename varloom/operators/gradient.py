"""Per-category effect variances by gradient descent, with LD.

Each variant i has an effect variance theta_c for the categories c that it is
in (genes, annotations, a base category for all), added up.  Through LD,

    var(z_j) = sig2_zero + n_j * sum over c of theta_c l_jc,   l_jc = sum over i in c of het_i r2_ij

and the cost of a variant is the normal negative log likelihood of its z.  The
parameters are log theta_c and log sig2_zero.  An epoch is one pass over the
variants (each with its few categories and their l) and one aggregation of
sparse gradients by category; Adam's step is a join of the parameters with the
gradients.  The state of every epoch (parameters and both moments) is a table in
the shared folder.  An epoch whose cost is not lower is taken back and the step
halved, so the cost falls from epoch to epoch.

Tasks get all parameters as one array: categories are counted first, and more
than MOST are an error.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.sources.shared import written

MOST = 2_000_000  # categories: 16 MB
NOISE = "sig2_zero"


def category_scores(pairs: DataFrame, members: DataFrame, panel: DataFrame, key: str = "snp") -> DataFrame:
    """key, category, l: LD scores by category, which may overlap; a sparse product of the pairs and the annotation.

    `pairs`: i, j, r2, each unordered pair once; `members`: key, category and
    optionally value (1 if absent); `panel`: key, het.  A variant counts for
    itself with r2 = 1.
    """
    value = F.col("value").cast("double") if "value" in members.columns else F.lit(1.0)
    held = members.join(panel.select(key, F.col("het").cast("double").alias("het")), key).groupBy(F.col(key).alias("b"), "category").agg(F.sum(value * F.col("het")).alias("a"))
    ends = pairs.where(F.col("i") != F.col("j")).select(F.explode(F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b")), F.struct(F.col("j").alias("a"), F.col("i").alias("b")))).alias("e"), "r2").select(F.col("e.a").alias(key), F.col("e.b").alias("b"), "r2")
    own = panel.select(F.col(key), F.col(key).alias("b"), F.lit(1.0).alias("r2"))
    return ends.unionByName(own).join(held, "b").groupBy(key, "category").agg(F.sum(F.col("r2") * F.col("a")).alias("l"))


def inputs(tags: DataFrame, scores: DataFrame, key: str = "snp", weights: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (z, n, w, cats, l) of the tags (key, z, n), and the categories numbered (category, c).

    A variant's categories are those of its LD window, so its lists are short.
    """
    names = written(scores.select("category").distinct().orderBy("category").withColumn("c", F.monotonically_increasing_id()), "categories")
    total = names.count()
    if total > MOST:
        raise ValueError(f"{total} categories; at most {MOST} can be fitted at once")
    listed = names.orderBy("category").toArrow().column("category").to_pylist()  # at most MOST names
    numbered = written(tags.sparkSession.createDataFrame([(x, i) for i, x in enumerate(listed)], "category string, c int"), "categories") if listed else names.select("category", F.col("c").cast("int").alias("c"))
    small = scores.join(F.broadcast(numbered), "category").groupBy(key).agg(F.collect_list(F.struct("c", "l")).alias("s"))
    z, n = F.col("z").cast("double"), F.col("n").cast("double")
    known = tags.where(z.isNotNull() & n.isNotNull() & ~F.isnan(z) & (n > 0))
    w = F.col(weights).cast("double") if weights else F.lit(1.0)
    rows = known.select(key, z.alias("z"), n.alias("n"), w.alias("w")).join(small, key, "left")
    none = lambda t: F.array().cast(f"array<{t}>")
    return rows.select("z", "n", "w", F.coalesce("s.c", none("int")).alias("cats"), F.coalesce("s.l", none("double")).alias("l")), numbered


def epoch(rows: DataFrame, theta: np.ndarray, noise: float) -> DataFrame:
    """c, g: the gradient by log theta; c = -1: by log noise; c = -2: the cost.  Each task sends the categories that it met."""
    sent = rows.sparkSession.sparkContext.broadcast(theta)

    def run(batches):
        t = sent.value
        g, ends = np.zeros(len(t)), np.zeros(2)
        for b in batches:
            z, n, w = (b.column(x).to_numpy() for x in ("z", "n", "w"))
            sizes = np.asarray(b.column("cats").value_lengths())
            at, l = b.column("cats").flatten().to_numpy(), b.column("l").flatten().to_numpy()
            who = np.repeat(np.arange(len(z)), sizes)
            part = t[at] * l
            v = noise + n * np.bincount(who, part, len(z))
            slope = 0.5 * w * (1 - z * z / v) / v
            g += np.bincount(at, (slope * n)[who] * part, len(t))
            ends += (slope * noise).sum(), 0.5 * (w * (np.log(v) + z * z / v + math.log(2 * math.pi))).sum()
        met = np.flatnonzero(g)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([met, [-1, -2]]).astype(np.int32)), pa.array(np.concatenate([g[met], ends]))], names=["c", "g"])

    return rows.mapInArrow(run, "c int, g double").groupBy("c").agg(F.sum("g").alias("g"))


def fit(tags: DataFrame, scores: DataFrame, *, key: str = "snp", weights: str | None = None, adam_epoch: tuple[int, ...] = (60, 60, 60), adam_step: tuple[float, ...] = (0.25, 0.064, 0.016), start: DataFrame | None = None, noise: float = 1.0, fit_noise: bool = True, betas: tuple[float, float] = (0.9, 0.99)) -> tuple[DataFrame, dict]:
    """Parameters (category, theta; the noise as category sig2_zero), and cost, trace (the cost after each accepted epoch), n.

    `start`: category, theta of an earlier fit (its sig2_zero counts too);
    others begin where all variants' mean z^2 puts one common theta.
    `adam_epoch` and `adam_step`: numbers of epochs and their step sizes.
    """
    if len(adam_epoch) != len(adam_step):
        raise ValueError("as many step sizes as numbers of epochs")
    spark = tags.sparkSession
    rows, names = inputs(tags, scores, key, weights)
    rows = written(rows, "gradient-rows")
    per = F.aggregate("l", F.lit(0.0), lambda a, x: a + x)
    s = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("z") * F.col("z")).alias("q"), F.avg(F.col("n") * per).alias("nl")).first()
    if not s["n"]:
        return spark.createDataFrame([], "category string, theta double"), {"cost": math.nan, "trace": [], "n": 0}
    common = max(s["q"] - noise, 0.05) / max(s["nl"], 1e-300)
    zero = spark.createDataFrame([(NOISE, -1)], "category string, c int")
    state = names.select("category", "c").unionByName(zero)
    if start is not None:
        state = state.join(start.select("category", F.greatest("theta", F.lit(1e-300)).alias("theta")), "category", "left")
    else:
        state = state.withColumn("theta", F.lit(None).cast("double"))
    first = F.when(F.col("c") < 0, F.lit(float(noise))).otherwise(F.lit(common))
    state = written(state.select("category", "c", F.ln(F.coalesce("theta", first)).alias("x"), F.lit(0.0).alias("m"), F.lit(0.0).alias("v")), "adam")

    def values(df: DataFrame) -> tuple[np.ndarray, float]:
        t = df.select("c", "x").toArrow()  # at most MOST numbers
        c, x = t.column("c").to_numpy(), t.column("x").to_numpy()
        theta = np.zeros(len(c) - 1)
        theta[c[c >= 0]] = np.exp(x[c >= 0])
        return theta, float(np.exp(x[c < 0][0]))

    def look(df: DataFrame) -> tuple[DataFrame, float]:
        got = written(epoch(rows, *values(df)), "gradients")
        return got, got.where("c = -2").first()["g"]

    grads, cost = look(state)
    trace, t = [cost], 0
    b1, b2 = betas
    for epochs, size in zip(adam_epoch, adam_step, strict=True):
        for _ in range(epochs):
            t += 1
            g = F.coalesce("g", F.lit(0.0)) if fit_noise else F.when(F.col("c") < 0, 0.0).otherwise(F.coalesce("g", F.lit(0.0)))
            m, v = b1 * F.col("m") + (1 - b1) * g, b2 * F.col("v") + (1 - b2) * g * g
            moved = state.join(grads.where("c >= -1"), "c", "left").select("category", "c", "x", m.alias("m"), v.alias("v"))
            step = size * (F.col("m") / (1 - b1**t)) / (F.sqrt(F.col("v") / (1 - b2**t)) + 1e-12)
            new = written(moved.withColumn("x", F.col("x") - step).select("category", "c", "x", "m", "v"), "adam")
            there, then = look(new)
            if then < cost:
                state, grads, cost = new, there, then
                trace.append(cost)
                continue
            size /= 2  # taken back; the moments begin anew from the last good place
            state, t = state.withColumns({"m": F.lit(0.0), "v": F.lit(0.0)}), 0
            if size < 1e-5:
                break
    out = state.select("category", F.exp("x").alias("theta"))
    return out, {"cost": cost, "trace": trace, "n": s["n"]}


def heritability(theta: DataFrame, members: DataFrame, panel: DataFrame, key: str = "snp") -> DataFrame:
    """`heritability_of` of the categories that were fitted."""
    each = members.select(key, "category").distinct()
    return heritability_of(each.join(theta, "category").groupBy(key).agg(F.sum("theta").alias("theta")), each, panel, key)


def heritability_of(variances: DataFrame, members: DataFrame, panel: DataFrame, key: str = "snp") -> DataFrame:
    """category, snps, h2, enrich of any categories: sums of their variants' theta het, and that a het over the whole panel's.

    `variances`: key, theta (the sum over all fitted categories of the variant).
    """
    het = panel.select(key, F.col("het").cast("double").alias("het"))
    by = het.join(variances.select(key, "theta"), key, "left").select(key, "het", (F.coalesce("theta", F.lit(0.0)) * F.col("het")).alias("h"))
    total = by.agg(F.sum("h").alias("t_h"), F.sum("het").alias("t_het"))
    per = members.select(key, "category").distinct().join(by, key).groupBy("category").agg(F.count(F.lit(1)).alias("snps"), F.sum("h").alias("h2"), F.sum("het").alias("mass"))
    return per.crossJoin(F.broadcast(total)).select("category", "snps", "h2", F.try_divide(F.col("h2") * F.col("t_het"), F.col("mass") * F.col("t_h")).alias("enrich"))

"""LD scores by category and the gradient fit: against direct sums, closed forms, and planted variances in linked data."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.operators import gradient, ld


def test_category_scores(spark):
    pairs = spark.createDataFrame([("a", "b", 0.5), ("b", "c", 0.2), ("a", "a", 1.0)], "i string, j string, r2 double")
    panel = spark.createDataFrame([("a", 0.5), ("b", 0.4), ("c", 0.1), ("d", 0.3)], "snp string, het double")
    members = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y"), ("d", "y"), ("gone", "y")], "snp string, category string")
    got = {(r["snp"], r["category"]): r["l"] for r in gradient.category_scores(pairs, members, panel).collect()}
    assert got == pytest.approx({("a", "x"): 0.7, ("a", "y"): 0.2, ("b", "x"): 0.65, ("b", "y"): 0.4, ("c", "x"): 0.08, ("c", "y"): 0.08, ("d", "y"): 0.3})
    # Disjoint categories that hold all variants add up to the LD score.
    flat = panel.withColumn("het", F.lit(1.0))
    parts = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "x"), ("d", "z")], "snp string, category string")
    whole = {r["i"]: r["ld_score"] for r in ld.ld_score(pairs.where("i <> j"), own=True).collect()}
    summed = {r["snp"]: r["s"] for r in gradient.category_scores(pairs, parts, flat).groupBy("snp").agg(F.sum("l").alias("s")).collect()}
    assert summed == pytest.approx({**whole, "d": 1.0})


def test_closed_form_on_independent_variants(spark):
    rng = np.random.default_rng(1)
    n, rows, members, want = 1000.0, [], [], {}
    for c, var in (("A", 3.0), ("B", 1.6), ("none", 1.0)):
        z = rng.normal(size=1500) * math.sqrt(var)
        rows += [(f"{c}{i}", float(x), n) for i, x in enumerate(z)]
        want[c] = float((z * z).mean())
        members += [(f"{c}{i}", c) for i in range(1500)] if c != "none" else []
    tags = spark.createDataFrame([*rows, ("null", None, n), ("nan", float("nan"), n)], "snp string, z double, n double")
    panel = tags.select("snp", F.lit(0.5).alias("het"))
    held = spark.createDataFrame(members, "snp string, category string")
    scores = gradient.category_scores(spark.createDataFrame([], "i string, j string, r2 double"), held, panel)
    theta, info = gradient.fit(tags, scores, adam_epoch=(25, 15), adam_step=(0.25, 0.05))
    got = {r["category"]: r["theta"] for r in theta.collect()}
    assert all(b < a for a, b in zip(info["trace"], info["trace"][1:])) and len(info["trace"]) > 15 and info["n"] == 4500
    assert got["sig2_zero"] == pytest.approx(want["none"], rel=0.02)
    for c in "AB":
        assert got["sig2_zero"] + n * 0.5 * got[c] == pytest.approx(want[c], rel=0.02)
    best = sum(750 * (math.log(2 * math.pi * v) + 1) for v in want.values())
    assert best <= info["cost"] < best + 1.0
    again, more = gradient.fit(tags, scores, adam_epoch=(2,), adam_step=(0.01,), start=theta)
    assert more["trace"][0] == pytest.approx(info["cost"], rel=1e-9) and more["cost"] <= info["cost"]
    h2 = {r["category"]: r for r in gradient.heritability(theta, held, panel).collect()}
    assert h2["A"]["snps"] == 1500 and h2["A"]["h2"] == pytest.approx(750 * got["A"]) and h2["A"]["enrich"] > 1 > h2["B"]["enrich"]


def test_linked_categories(spark):
    """Genes that stand beside each other in LD: the neighbour's variance is not taken for the gene's own."""
    rng = np.random.default_rng(2)
    width, blocks, n = 20, 250, 5000.0
    r = 0.9 ** np.abs(np.subtract.outer(np.arange(width), np.arange(width)))
    root = np.linalg.cholesky(r)
    rows = []
    for b in range(blocks):
        beta = np.where(np.arange(width) < 10, rng.normal(size=width) * math.sqrt(0.002), 0.0)  # the first half has effects
        z = math.sqrt(n) * r @ beta + root @ rng.normal(size=width)
        rows += [(f"v{b}_{i}", float(z[i]), n, "hot" if i < 10 else "cold") for i in range(width)]
    rows += [(f"w{i}", float(rng.normal()), n, None) for i in range(1500)]
    tags = spark.createDataFrame(rows, "snp string, z double, n double, category string")
    near = spark.createDataFrame([(i, j, float(r[i, j] ** 2)) for i in range(width) for j in range(i + 1, width)], "x int, y int, r2 double")
    pairs = spark.range(blocks).crossJoin(near).select(F.concat(F.lit("v"), "id", F.lit("_"), "x").alias("i"), F.concat(F.lit("v"), "id", F.lit("_"), "y").alias("j"), "r2")
    members, panel = tags.where("category is not null").select("snp", "category"), tags.select("snp", F.lit(1.0).alias("het"))
    theta, info = gradient.fit(tags, gradient.category_scores(pairs, members, panel), adam_epoch=(30, 15), adam_step=(0.3, 0.06))
    got = {r["category"]: r["theta"] for r in theta.collect()}
    assert got["hot"] == pytest.approx(0.002, rel=0.25) and got["cold"] < 0.25 * got["hot"] and got["sig2_zero"] == pytest.approx(1.0, abs=0.12)
    alone, _ = gradient.fit(tags, gradient.category_scores(pairs.limit(0), members, panel), adam_epoch=(15,), adam_step=(0.3,))
    blind = {r["category"]: r["theta"] for r in alone.collect()}
    assert blind["hot"] > 2 * got["hot"] and blind["cold"] > 0.002  # without LD both halves seem to have effects


def test_no_variants(spark):
    theta, info = gradient.fit(spark.createDataFrame([], "snp string, z double, n double"), spark.createDataFrame([], "snp string, category string, l double"))
    assert theta.count() == 0 and info["n"] == 0

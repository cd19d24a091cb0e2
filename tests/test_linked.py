"""Likelihoods under LD: against closed forms, sampling, and planted parameters in linked test data."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.operators import linked, mixture

N = 20_000.0


def normal(z, v):
    return np.exp(-z * z / (2 * v)) / np.sqrt(2 * math.pi * v)


def test_density_without_neighbours():
    z, one = np.array([0.0, 1.0, -2.0, 5.0, 12.0]), np.ones((5, 1))
    p = {"pi": 0.05, "sig2_beta": 0.02, "sig2_zero": 1.1}
    want = 0.95 * normal(z, 1.1) + 0.05 * normal(z, 21.1)
    assert linked.density(z, np.full(5, 1000.0), one, one, p) == pytest.approx(want, rel=1e-9)
    both = linked.pair_params({"pi": 0.1, "sig2_beta": 0.01, "sig2_zero": 1.0}, {"pi": 0.2, "sig2_beta": 0.02, "sig2_zero": 1.2}, 0.05, 0.6, 0.1)
    zz = np.array([[0.0, 0.0], [1.0, -1.0], [3.0, 4.0], [8.0, 7.0]])

    def two(v1, v2, c):
        d = v1 * v2 - c * c
        return np.exp(-(zz[:, 0] ** 2 * v2 - 2 * zz[:, 0] * zz[:, 1] * c + zz[:, 1] ** 2 * v1) / (2 * d)) / (2 * math.pi * np.sqrt(d))

    c = 0.1 * math.sqrt(1.2)
    want = 0.75 * two(1, 1.2, c) + 0.05 * two(11, 1.2, c) + 0.15 * two(1, 21.2, c) + 0.05 * two(11, 21.2, c + 0.6 * math.sqrt(200))
    assert linked.density2(zz, np.full((4, 2), 1000.0), np.ones((4, 1)), np.ones((4, 1)), both) == pytest.approx(want, rel=1e-5)


def test_density_of_a_neighbourhood_against_sampling():
    rng = np.random.default_rng(1)
    a = rng.random(12)
    p = {"pi": 0.15, "sig2_beta": 0.01, "sig2_zero": 1.0}
    draws = np.sqrt(1 + ((rng.random((400_000, 12)) < 0.15) * a * 1000 * 0.01).sum(1))
    z = np.array([0.0, 1.5, 4.0])
    want = [float((np.exp(-x * x / (2 * draws**2)) / draws).mean() / math.sqrt(2 * math.pi)) for x in z]
    got = linked.density(z, np.full(3, 1000.0), np.ones((3, 12)), np.tile(a, (3, 1)), p)
    assert got == pytest.approx(want, rel=0.01)
    own = linked.density(z, np.full(3, 1000.0), np.ones((3, 12)), np.tile(a, (3, 1)), p, own="causal")
    other = linked.density(z, np.full(3, 1000.0), np.r_[np.zeros((1, 3)), np.ones((11, 3))].T, np.tile(a, (3, 1)), p)
    assert got == pytest.approx(0.15 * own + 0.85 * other, rel=1e-8)


def panel_of(spark, blocks, width, decay, causal, seed, traits=1, rho=0.0):
    """Blocks of linked variants (r = decay^distance): z of each trait, the panel and its pairs; `causal`: standard deviations of effects by variant."""
    rng = np.random.default_rng(seed)
    r = decay ** np.abs(np.subtract.outer(np.arange(width), np.arange(width)))
    root = np.linalg.cholesky(r)
    rows = []
    for b in range(blocks):
        z = []
        for k in range(traits):
            noise = root @ rng.normal(size=width)
            z.append(math.sqrt(N) * r @ causal[k][b] + noise)
        for i in range(width):
            rows.append((f"v{b}_{i}", b * 1000 + i, *[float(x[i]) for x in z], *([N] * traits)))
    names = "z double, n double" if traits == 1 else "z1 double, z2 double, n1 double, n2 double"
    tags = spark.createDataFrame(rows, f"snp string, at long, {names}")
    near = [(i, j, float(r[i, j] ** 2)) for i in range(width) for j in range(i + 1, width) if r[i, j] ** 2 >= 0.01]
    inside = spark.createDataFrame(near, "x int, y int, r2 double")
    pairs = spark.range(blocks).crossJoin(inside).select(F.concat(F.lit("v"), "id", F.lit("_"), "x").alias("i"), F.concat(F.lit("v"), "id", F.lit("_"), "y").alias("j"), "r2")
    return tags, tags.select("snp", F.lit(1.0).alias("het")), pairs


def test_planted_parameters_are_recovered_where_independence_is_biased(spark):
    rng = np.random.default_rng(7)
    blocks, width, pi, sb = 200, 40, 0.01, 0.0015
    effects = np.where(rng.random((blocks, width)) < pi, rng.normal(size=(blocks, width)) * math.sqrt(sb), 0.0)
    tags, panel, pairs = panel_of(spark, blocks, width, 0.9, [effects], 8)
    pruned = tags.where(F.col("at") % 1000 % 5 == 0)
    true_pi = float((effects != 0).mean())
    got = linked.fit_univariate(pruned, panel, pairs, fit_sequence=("neldermead-fast",)).first()
    alone = mixture.fit_univariate(pruned.select("z", "n")).first()
    assert got["converged"] and got["n"] == 1600 and got["num_snp"] == 8000
    assert 0.6 * true_pi < got["pi"] < 1.6 * true_pi and 0.6 * sb < got["sig2_beta"] < 1.6 * sb and 0.9 < got["sig2_zero"] < 1.15
    assert alone["pi"] > 4 * true_pi  # a variant counts as causal for its neighbours' effects
    assert got["aic"] > 0
    rows = linked.spectra(pruned, panel, pairs)
    cost = linked.costs(rows, got.asDict())
    total = cost.agg(F.sum("cost"), F.min("posterior"), F.max("posterior")).first()
    assert total[0] == pytest.approx(got["cost"], rel=1e-9) and 0 <= total[1] < got["pi"] < total[2] <= 1


def test_overlap_curve_of_linked_traits(spark):
    rng = np.random.default_rng(9)
    blocks, width, sb = 150, 20, 0.004
    u = rng.random((blocks, width))
    a, b = rng.normal(size=(2, blocks, width)) * math.sqrt(sb)
    shared, first, second = u < 0.03, (u >= 0.03) & (u < 0.05), (u >= 0.05) & (u < 0.07)
    e1, e2 = np.where(shared | first, a, 0), np.where(shared | second, 0.6 * a * shared + (0.8 * shared + second) * b, 0)
    true_rg = (e1 * e2).sum() / math.sqrt((e1**2).sum() * (e2**2).sum())
    tags, panel, pairs = panel_of(spark, blocks, width, 0.8, [e1, e2], 10, traits=2)
    pruned = tags.where(F.col("at") % 1000 % 5 == 0)
    one = {"pi": 0.05, "sig2_beta": sb, "sig2_zero": 1.0}
    got = linked.fit_bivariate(pruned, panel, pairs, one, one, points=9, rho_zero=0.0)
    assert len(got["grid"]) == len(got["jout"]) == 9 and got["grid"] == sorted(got["grid"]) and got["grid"][-1] == pytest.approx(0.05)
    assert 0.02 < got["pi12"] < 0.042 and abs(got["rg"] - true_rg) < 0.2 and got["cost"] <= min(got["jout"])
    assert got["jout"][0] > got["cost"] + 2 and got["jout"][-1] > got["cost"] + 2  # neither end explains the traits


def test_spectra(spark):
    tags = spark.createDataFrame([("a", 1.0, 10.0), ("b", None, 10.0), ("c", 2.0, 10.0), ("x", 0.0, 5.0)], "snp string, z double, n double")
    panel = spark.createDataFrame([("a", 0.5), ("b", 0.25), ("c", 0.4), ("d", 0.1)], "snp string, het double")
    pairs = spark.createDataFrame([("a", "b", 0.5), ("c", "a", 0.1), ("d", "a", 0.11), ("a", "a", 1.0), ("b", "c", 0.0)], "i string, j string, r2 double")
    rows = {r["snp"]: r for r in linked.spectra(tags, panel, pairs, bins=8).collect()}
    assert set(rows) == {"a", "b", "c"}  # x is not in the panel
    assert rows["a"]["count"] == [2.0, 1.0] and rows["a"]["mass"] == pytest.approx([0.1 * 0.4 + 0.11 * 0.1, 0.5 * 0.25])
    assert rows["a"]["ld"] == pytest.approx(0.5 + 0.04 + 0.011 + 0.125) and rows["b"]["count"] == [1.0] and rows["c"]["own"] == 0.4
    none = linked.fit_univariate(tags.limit(0), panel, pairs)
    assert none.count() == 0

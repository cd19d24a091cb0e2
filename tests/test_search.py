"""Optimisers against fine grids; restart from a stored state."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.operators import mixture, search

SPACE = search.Space({"a": (-2.0, 2.0), "b": (0.01, 100.0)}, {"a": "add", "b": "log"})


def bowl(p):
    return (p["a"] - 0.7) ** 2 + (math.log(p["b"]) - 1.1) ** 2


def valley(p):
    x, y = p["a"], math.log(p["b"]) / 2
    return (1 - x) ** 2 + 20 * (y - x * x) ** 2


def two_optima(p):
    """The nearer of two wells, at a = -1.2, is not the deeper."""
    x, y = p["a"], math.log(p["b"])
    return 1 - 0.8 * math.exp(-((x + 1.2) ** 2 + y**2) * 3) - math.exp(-((x - 1.3) ** 2 + (y - 2) ** 2) * 3)


def grid(f, n=601):
    points = [SPACE.point(np.array([i / (n - 1), j / (n - 1)])) for i in range(n) for j in range(n)]
    return min(points, key=f)


@pytest.mark.parametrize("f", [bowl, valley, two_optima])
def test_same_optimum_as_a_fine_grid(f):
    calls = []

    def evaluate(points):
        calls.append(len(points))
        return [f(p) for p in points]

    want = grid(f)
    for seed in (1, 2):
        got = search.differential_evolution(evaluate, SPACE, seed=seed)
        assert got.converged and got.cost <= f(want) + 1e-6
        assert abs(got.params["a"] - want["a"]) < 0.02 and abs(math.log(got.params["b"] / want["b"])) < 0.06
    assert min(calls) >= 12  # a generation at a time
    begin = {"a": 0.5, "b": 5.0}
    for got in (search.nelder_mead(evaluate, SPACE, begin), search.pattern(evaluate, SPACE, begin)):
        assert got.converged and got.cost <= f(want) + 1e-4
    best, done = search.sequence(evaluate, SPACE, ("diffevo-fast", "neldermead"), begin)
    assert [k for k, _ in done] == ["diffevo-fast", "neldermead"] and best.cost <= f(want) + 1e-6


def test_bounds_on_rounds_are_told():
    got = search.pattern(lambda ps: [bowl(p) for p in ps], SPACE, {"a": -2.0, "b": 0.01}, rounds=3)
    assert not got.converged and got.rounds == 3
    assert math.isnan(search.nelder_mead(lambda ps: [math.nan] * len(ps), SPACE, {"a": 0.0, "b": 1.0}, rounds=3).cost)
    only = search.Space({"x": (0.0, 9.0)}, {"x": "add"}, lambda p: p["x"] != 0)
    got = search.line(lambda ps: [(p["x"] - 2.5) ** 2 for p in ps], only, 0.0, 9.0)
    assert got.converged and abs(got.params["x"] - 2.5) < 1e-4


def test_a_generation_is_one_job_and_goes_on_after_a_stop(spark, tmp_path):
    rows = spark.range(500).select(((F.col("id") % 50) / 10.0).alias("x"))

    def evaluate(points):
        row = rows.agg(*[F.avg((F.col("x") - p["a"] - math.log(p["b"])) ** 2 + (p["a"] - 1) ** 2).alias(f"c{i}") for i, p in enumerate(points)]).first()
        return [row[i] for i in range(len(points))]

    whole = search.differential_evolution(evaluate, SPACE, seed=3, rounds=8)
    part = search.differential_evolution(evaluate, SPACE, seed=3, rounds=4, store=search.Store(spark, str(tmp_path / "s")))
    assert not part.converged
    rest = search.differential_evolution(evaluate, SPACE, seed=3, rounds=8, store=search.Store(spark, str(tmp_path / "s")))
    assert rest.params == whole.params and rest.trace == pytest.approx(whole.trace) and len(rest.trace) == 8
    assert len(list((tmp_path / "s").glob("step-*"))) == 2


def test_candidates_of_a_batch_share_their_densities(monkeypatch):
    """27 candidates on a grid: 3 null and 9 causal densities for one trait, 9 and 9 for two, and the costs of each alone."""
    rng = np.random.default_rng(5)
    z1, z2, n = rng.normal(0, 1.2, 500), rng.normal(0, 1.2, 500), rng.uniform(500, 2_000, 500)
    made = []
    for name in ("normal_density", "_density2"):
        monkeypatch.setattr(mixture, name, lambda *a, name=name, g=getattr(mixture, name): made.append(name) or g(*a))
    one = [{"pi": a, "sig2_beta": b, "sig2_zero": c} for a in (0.01, 0.1, 0.5) for b in (1e-4, 1e-3, 1e-2) for c in (0.9, 1.0, 1.1)]
    two = [{"pi12": a, "rho_beta": b, "rho_zero": c} for a in (0.01, 0.05, 0.1) for b in (-0.5, 0.0, 0.5) for c in (-0.1, 0.0, 0.1)]
    for points, cost, most in (
        (one, lambda p, f: mixture.univariate_cost(p, z1, n, f), 12),
        (two, lambda p, f: mixture.bivariate_cost(p, one[13], one[14], z1, z2, n, n, f), 18),
    ):
        alone = [cost(p, mixture.Numpy()) for p in points]
        made.clear()
        f = mixture.Numpy()
        shared = [cost(p, f) for p in points]
        assert len(made) == most and all((a == b).all() for a, b in zip(alone, shared, strict=True))


def test_a_round_runs_as_many_tasks_as_its_rows_ask_for(spark, monkeypatch):
    parts, evaluator = [], mixture.evaluator
    monkeypatch.setattr(mixture, "evaluator", lambda df, cost: parts.append(df.rdd.getNumPartitions()) or evaluator(df, cost))
    monkeypatch.setattr(mixture, "ROWS_A_TASK", 400, raising=False)
    df = spark.range(1_000, numPartitions=40).select(((F.col("id") % 40) / 10 - 2).alias("z"), F.lit(1000.0).alias("n"))
    assert mixture.fit_univariate(df, rounds=1).first()["n"] == 1_000
    assert parts == [3, 3]

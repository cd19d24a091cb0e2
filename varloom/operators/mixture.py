"""Causal-mixture fits on z-scores of independent variants (use a pruned set).

`linked` has the likelihoods that know LD; where LD is at hand they are the
ones to use, as an independent fit takes a neighbour's effect for a variant's
own.  No parity with the published tool's numbers is claimed.

* one trait:  z ~ (1 - pi) N(0, s0) + pi N(0, s0 + n sb)
* two traits: four parts (null, first only, second only, shared), the shared
  part with effect correlation rho_beta, all with error correlation rho_zero.

Costs are negative log likelihoods.  A search round evaluates all its
candidates in one pass over the data, so the driver sees a few numbers a round.
Searches go on until their steps are small; `converged` says whether they did.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.operators.linked import overlap_curve
from varloom.operators.search import Evaluate, Params, Space, pattern

TWO_PI = 6.283185307179586


#: Rows of a task in a round of a search; a round must not cost more for its tasks than for its rows.
ROWS_A_TASK = 100_000


class Numpy:
    """The functions of a cost for arrays, under the names that they have for columns, and the parts made for one batch."""

    exp, sqrt, ln, greatest, lit = np.exp, np.sqrt, np.log, np.maximum, float

    def __init__(self):
        self.made: dict[tuple, np.ndarray] = {}

    def once(self, key: tuple, make: Callable[[], np.ndarray]) -> np.ndarray:
        if key not in self.made:
            self.made[key] = make()
        return self.made[key]


def _once(f, key: tuple, make: Callable):
    """A part of a mixture: candidates that agree in its parameters (most of a round's, as they lie on a grid) share it."""
    return f.once(key, make) if isinstance(f, Numpy) else make()


def normal_density(z, var, f=F):
    return f.exp(-z * z / (2.0 * var)) / f.sqrt(TWO_PI * var)


def univariate_cost(p: Params, z, n, f=F):
    zero, beta = p["sig2_zero"], p["sig2_beta"]
    null = _once(f, (zero,), lambda: normal_density(z, f.lit(zero), f))
    causal = _once(f, (zero, beta), lambda: normal_density(z, zero + n * beta, f))
    return -f.ln(f.greatest((1.0 - p["pi"]) * null + p["pi"] * causal, f.lit(1e-300)))


def infinitesimal_cost(p: Params, z, n, f=F):
    """The two-parameter model: every variant has an effect."""
    return -f.ln(f.greatest(normal_density(z, p["sig2_zero"] + n * p["sig2_beta"], f), f.lit(1e-300)))


def _density2(z1, z2, v1, v2, c, f):
    det = v1 * v2 - c * c
    return f.exp(-(z1 * z1 * v2 - 2.0 * z1 * z2 * c + z2 * z2 * v1) / (2.0 * det)) / (TWO_PI * f.sqrt(det))


def bivariate_cost(p: Params, one: Params, two: Params, z1, z2, n1, n2, f=F):
    """`one` and `two` must be the same for all candidates of a batch."""
    a, b = f.lit(one["sig2_zero"]), f.lit(two["sig2_zero"])
    e1, e2 = n1 * one["sig2_beta"], n2 * two["sig2_beta"]
    c0 = f.lit(p["rho_zero"] * math.sqrt(one["sig2_zero"] * two["sig2_zero"]))
    pi1, pi2 = one["pi"] - p["pi12"], two["pi"] - p["pi12"]
    null = max(1e-9, 1.0 - pi1 - pi2 - p["pi12"])
    part = lambda name, v1, v2: _once(f, (name, p["rho_zero"]), lambda: _density2(z1, z2, v1, v2, c0, f))
    mix = (
        null * part("null", a, b)
        + pi1 * part("one", a + e1, b)
        + pi2 * part("two", a, b + e2)
        + p["pi12"] * _once(f, ("both", p["rho_zero"], p["rho_beta"]), lambda: _density2(z1, z2, a + e1, b + e2, c0 + p["rho_beta"] * f.sqrt(e1 * e2), f))
    )
    return -f.ln(f.greatest(mix, f.lit(1e-300)))


def evaluator(df: DataFrame, cost: Callable[..., np.ndarray]) -> Evaluate:
    """Total costs of any number of candidates in one job.

    Arrays in tasks: as columns each round would be other constants, so other
    code to compile, which takes longer than the round.
    """
    names = df.columns

    def evaluate(points: list[Params]) -> list[float]:
        def run(batches):
            total, rows = np.zeros(len(points)), 0
            for b in batches:
                cells = [b.column(c).to_numpy() for c in names]
                f = Numpy()
                total += [float(cost(p, *cells, f).sum()) for p in points]
                rows += b.num_rows
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(points), dtype=np.int32)), pa.array(total)], names=["i", "cost"])

        by = {r["i"]: r["cost"] for r in df.mapInArrow(run, "i int, cost double").groupBy("i").agg(F.sum("cost").alias("cost")).collect()}
        return [by.get(i, math.nan) for i in range(len(points))]

    return evaluate


def _dealt(rows: DataFrame) -> DataFrame:
    """Persisted rows in as many parts as their number asks for: each round of a search runs a task a part."""
    count = rows.count()
    dealt = rows.repartition(count // ROWS_A_TASK + 1).persist()
    dealt.count()
    rows.unpersist()
    return dealt


def fit_univariate(df: DataFrame, z: str = "z", n: str = "n", start: Params | None = None, rounds: int | None = None) -> DataFrame:
    """One row: pi, sig2_beta, sig2_zero, cost, cost_infinitesimal, n, aic and bic against the two-parameter model (negative: pi is not supported), converged."""
    rows = df.where(F.col(z).isNotNull() & F.col(n).isNotNull() & ~F.isnan(z) & ~F.isnan(n)).select(F.col(z).alias("z"), F.col(n).cast("double").alias("n")).persist()
    try:
        rows = _dealt(rows)
        count, mean_n = rows.agg(F.count(F.lit(1)), F.avg("n")).first()
        mean_n = mean_n or 1.0
        bounds = {"pi": (1e-7, 1.0), "sig2_beta": (1e-5 / mean_n, 1e5 / mean_n), "sig2_zero": (0.05, 20.0)}
        space = Space(bounds, dict.fromkeys(bounds, "log"))
        flat_space = Space({k: bounds[k] for k in ("sig2_beta", "sig2_zero")}, {"sig2_beta": "log", "sig2_zero": "log"})
        begin = start or {"pi": 0.05, "sig2_beta": 2.0 / mean_n, "sig2_zero": 1.0}
        best = pattern(evaluator(rows, univariate_cost), space, begin, tolerance=1e-4, rounds=rounds)
        flat = pattern(evaluator(rows, infinitesimal_cost), flat_space, {"sig2_beta": 0.2 / mean_n, "sig2_zero": 1.0}, tolerance=1e-4, rounds=rounds)
    finally:
        rows.unpersist()
    # One parameter more than the two-parameter model.
    p, gain = best.params, 2.0 * (flat.cost - best.cost)
    aic, bic = -2.0 + gain, -math.log(count) + gain if count else math.nan
    return df.sparkSession.createDataFrame([(p["pi"], p["sig2_beta"], p["sig2_zero"], best.cost, flat.cost, int(count), aic, bic, best.converged and flat.converged)], "pi double, sig2_beta double, sig2_zero double, cost double, cost_infinitesimal double, n long, aic double, bic double, converged boolean")


def apply_univariate(df: DataFrame, params: Params, z: str = "z", n: str = "n") -> DataFrame:
    """Each variant's probability of a causal effect under fitted parameters (no refit)."""
    zc, nc = F.col(z), F.col(n).cast("double")
    null = (1.0 - params["pi"]) * normal_density(zc, F.lit(params["sig2_zero"]))
    causal = params["pi"] * normal_density(zc, params["sig2_zero"] + nc * params["sig2_beta"])
    return df.withColumn("posterior", causal / (null + causal))


def fit_bivariate(df: DataFrame, one: Params, two: Params, z1: str = "z1", z2: str = "z2", n1: str = "n1", n2: str = "n2", rounds: int | None = None, points: int = 21) -> DataFrame:
    """One row: pi12, rho_beta, rho_zero, cost, the overlap curve (grid of pi12 and jout), its ends cost_min and cost_max, n, converged.

    A free fit gives rg and rho_zero.  These stay as they are on the curve,
    which goes from the least overlap that rg allows to the greatest, and in
    the line search for the best overlap.
    """
    cols = [F.col(c).cast("double").alias(c) for c in (z1, z2, n1, n2)]
    rows = df.select(*cols).dropna().persist()
    most = min(one["pi"], two["pi"])
    try:
        rows = _dealt(rows)
        count = rows.count()
        evaluate = evaluator(rows, lambda p, a, b, c, d, f: bivariate_cost(p, one, two, a, b, c, d, f))
        space = Space({"pi12": (most * 1e-4, most), "rho_beta": (-0.99, 0.99), "rho_zero": (-0.99, 0.99)}, {"pi12": "log", "rho_beta": "add", "rho_zero": "add"})
        free = pattern(evaluate, space, {"pi12": most / 2, "rho_beta": 0.0, "rho_zero": 0.0}, tolerance=1e-4, rounds=rounds)
        root = math.sqrt(one["pi"] * two["pi"])
        rg = free.params["rho_beta"] * free.params["pi12"] / root
        grid, jout, best = overlap_curve(evaluate, one, two, rg, free.params["rho_zero"], points)
    finally:
        rows.unpersist()
    pi12 = best.params["pi12"]
    row = (pi12, max(-0.999, min(0.999, rg * root / pi12)), free.params["rho_zero"], best.cost, jout[0], jout[-1], int(count), grid, jout, free.converged and best.converged)
    return df.sparkSession.createDataFrame([row], "pi12 double, rho_beta double, rho_zero double, cost double, cost_min double, cost_max double, n long, grid array<double>, jout array<double>, converged boolean")


def apply_bivariate(df: DataFrame, one: Params, two: Params, params: Params, z1: str = "z1", z2: str = "z2", n1: str = "n1", n2: str = "n2") -> DataFrame:
    """Each variant's cost under fitted parameters (no refit)."""
    cols = [F.col(c).cast("double") for c in (z1, z2, n1, n2)]
    return df.withColumn("cost", bivariate_cost(params, one, two, *cols))

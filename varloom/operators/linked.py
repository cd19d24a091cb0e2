"""Causal-mixture likelihoods of variants that are linked with their neighbours.

A variant's z holds the effects of all variants it is correlated with:
z = sum over i of sqrt(n het_i) r_i beta_i + noise, each beta_i being 0 with
probability 1 - pi and else N(0, sig2_beta).  Its density has no closed form,
its characteristic function has:

    phi(t) = exp(-sig2_zero t^2 / 2) * product of (1 - pi + pi exp(-n het_i r2_i sig2_beta t^2 / 2))

and the density is (1 / pi) * integral of cos(t z) phi(t), summed by the
trapezoid rule, which is exact to rounding here: phi is smooth and vanishes at
the end, and the step is small enough for |z| and the spread of z.  Two traits
have the same with two arguments.  What a variant needs of its neighbourhood is
a short spectrum: numbers and sums of het r2 in bins of r2 (narrow ones; a bin
counts as its mean).  Costs are negative log likelihoods, weighted; densities
below FLOOR count as FLOOR, so a single outlier has a bounded cost.

The published tool's estimator is not in public documentation here; this is the
likelihood of the documented model, and no parity of numbers is claimed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.operators.search import Evaluate, Found, Params, Space, Store, line, sequence
from varloom.sources.shared import written

FLOOR = 1e-14
END = 7.5  # in units of 1 / sqrt(sig2_zero): phi is below 1e-12 there
END2 = 6.0  # the same for two traits, below 2e-8
STEPS = 512
BINS = 32
_DOUBLES = pa.list_(pa.float64())


def spectra(tags: DataFrame, panel: DataFrame, pairs: DataFrame, key: str = "snp", bins: int = BINS, weights: str | None = None) -> DataFrame:
    """Tags (key, z, n, or z1, z2, n1, n2) with own (their het), count and mass (of the neighbours' bins), ld (total het r2) and w.

    `panel`: key and het of all variants that can have effects; `pairs`: i, j,
    r2, once in either direction.  A pair is joined twice and summed per
    variant and bin before anything is collected, at most `bins` values a
    variant.  Tags that are not in the panel drop out; missing r2 is 0.
    `weights`: a column of `tags`; otherwise 1.
    """
    het = panel.select(F.col(key).alias("_k"), F.col("het").cast("double").alias("het"))
    ends = pairs.where((F.col("r2") > 0) & (F.col("i") != F.col("j"))).select(F.explode(F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b")), F.struct(F.col("j").alias("a"), F.col("i").alias("b")))).alias("e"), "r2").select("e.a", "e.b", "r2")
    near = ends.join(tags.select(F.col(key).alias("a")), "a", "left_semi").join(het, F.col("b") == F.col("_k"))
    cells = near.groupBy("a", F.least(F.floor(F.col("r2") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).cast("double").alias("count"), F.sum(F.col("het") * F.col("r2")).alias("mass"))
    rows = cells.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("bin", "count", "mass"))).alias("s")).select(F.col("a").alias(key), F.col("s.count").alias("count"), F.col("s.mass").alias("mass"))
    none = F.array().cast("array<double>")
    out = tags.join(het.withColumnsRenamed({"_k": key, "het": "own"}), key).join(rows, key, "left").withColumns({"count": F.coalesce("count", none), "mass": F.coalesce("mass", none)})
    total = F.aggregate("mass", F.lit(0.0), lambda a, x: a + x)
    return out.withColumns({"ld": F.col("own") + total, "w": F.col(weights).cast("double") if weights else F.lit(1.0)})


def _padded(column: pa.ListArray, width: int) -> np.ndarray:
    flat, offs = column.flatten().to_numpy(zero_copy_only=False), np.diff(np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths()))]))
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < offs[:, None]] = flat
    return out


def _spectrum(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Counts and mean het r2 of each variant itself (first) and its bins."""
    width = max([0, *np.asarray(b.column("count").value_lengths()).tolist()])
    count, mass = _padded(b.column("count"), width), _padded(b.column("mass"), width)
    own = b.column("own").to_numpy()[:, None]
    return np.hstack([np.ones_like(own), count]), np.hstack([own, mass / np.maximum(count, 1)])


def _points(z: np.ndarray, var: np.ndarray, s0: float) -> np.ndarray:
    """How many steps the trapezoid rule needs, a multiple of 16, at most STEPS: they cover spreads up to 30 (wider tails wrap round)."""
    need = END / math.sqrt(s0) * (np.abs(z) + 6.5 * np.sqrt(var)) / math.pi
    return 16 * np.clip(np.ceil(need / 16), 1, STEPS // 16).astype(int)


def density(z: np.ndarray, n: np.ndarray, count: np.ndarray, a: np.ndarray, p: Params, own: str = "any") -> np.ndarray:
    """Densities of z; `own`: "any", or "causal" for the density given that the variant itself has an effect."""
    pi, sb, s0 = p["pi"], p["sig2_beta"], p["sig2_zero"]
    v = a * n[:, None] * sb  # rows x bins
    if pi >= 1:
        var = s0 + (count * v).sum(1)
        return np.exp(-z * z / (2 * var)) / np.sqrt(2 * math.pi * var)
    # One strong effect may stand beside the mean of all of them.
    steps = _points(z, s0 + pi * (count * v).sum(1) + v.max(1), s0)
    out = np.empty(len(z))
    for m in np.unique(steps):
        rows = np.flatnonzero(steps == m)
        t = np.arange(m + 1) * (END / math.sqrt(s0) / m)
        h = np.full(m + 1, t[1])
        h[0] = h[-1] = t[1] / 2
        for at in range(0, len(rows), max(1, (1 << 20) // (m * v.shape[1]))):
            r = rows[at : at + max(1, (1 << 20) // (m * v.shape[1]))]
            fall = np.expm1(-0.5 * v[r][:, :, None] * (t * t)[None, None, :])
            log_phi = np.einsum("rk,rkm->rm", count[r], np.log1p(pi * fall)) - 0.5 * s0 * t * t
            if own == "causal":
                log_phi += -0.5 * v[r, 0][:, None] * (t * t) - np.log1p(pi * fall[:, 0])
            out[r] = (np.cos(z[r][:, None] * t) * np.exp(log_phi)) @ h / math.pi
    return out


def density2(z: np.ndarray, n: np.ndarray, count: np.ndarray, a: np.ndarray, p: Params) -> np.ndarray:
    """Densities of (z1, z2), rows x 2, under pi1, pi2, pi12, sig2_beta1/2, sig2_zero1/2, rho_beta and rho_zero."""
    s = [p["sig2_zero1"], p["sig2_zero2"]]
    v = [a * n[:, [k]] * p[f"sig2_beta{k + 1}"] for k in (0, 1)]
    share = [p["pi1"] + p["pi12"], p["pi2"] + p["pi12"]]
    # phi falls along the narrow direction of the noise only as fast as its smaller axis lets it.
    slack = math.sqrt(1 - abs(p["rho_zero"]))
    spread = [np.sqrt(s[k] + share[k] * (count * v[k]).sum(1) + v[k].max(1)) for k in (0, 1)]
    need = np.maximum(*[END2 / (math.sqrt(s[k]) * slack) * (np.abs(z[:, k]) + 6 * spread[k]) / math.pi for k in (0, 1)])
    steps = 4 * np.clip(np.ceil(need / 4), 3, 32).astype(int)
    out = np.empty(len(z))
    for m in np.unique(steps):
        rows = np.flatnonzero(steps == m)
        t = [np.arange(m + 1) * (END2 / math.sqrt(s[0]) / slack / m), np.arange(-m, m + 1) * (END2 / math.sqrt(s[1]) / slack / m)]
        h = np.full(m + 1, 1.0)
        h[0] = 0.5
        noise = -0.5 * (s[0] * t[0][:, None] ** 2 + s[1] * t[1][None, :] ** 2) - p["rho_zero"] * math.sqrt(s[0] * s[1]) * t[0][:, None] * t[1][None, :]
        for r in rows:
            one = np.exp(-0.5 * v[0][r][:, None] * t[0] ** 2)  # bins x m
            two = np.exp(-0.5 * v[1][r][:, None] * t[1] ** 2)
            cross = np.exp(-p["rho_beta"] * np.sqrt(v[0][r] * v[1][r])[:, None, None] * t[0][None, :, None] * t[1][None, None, :] - 0.5 * v[0][r][:, None, None] * (t[0] ** 2)[None, :, None] - 0.5 * v[1][r][:, None, None] * (t[1] ** 2)[None, None, :])
            mix = 1 + p["pi1"] * (one - 1)[:, :, None] + p["pi2"] * (two - 1)[:, None, :] + p["pi12"] * (cross - 1)
            log_phi = np.einsum("k,kab->ab", count[r], np.log(np.maximum(mix, 1e-300))) + noise
            wave = np.cos(z[r, 0] * t[0][:, None] + z[r, 1] * t[1][None, :])
            out[r] = h @ (wave * np.exp(log_phi)).sum(1) * (t[0][1] * (t[1][1] - t[1][0])) / (2 * math.pi**2)
    return out


def _parts(b: pa.RecordBatch):
    count, a = _spectrum(b)
    col = lambda c: b.column(c).to_numpy()
    if "z2" in b.schema.names:
        return np.stack([col("z1"), col("z2")], 1), np.stack([col("n1"), col("n2")], 1), count, a, col("w")
    return col("z"), col("n"), count, a, col("w")


def _cost(parts, p: Params) -> np.ndarray:
    z, n, count, a, _ = parts
    return -np.log(np.maximum((density2 if z.ndim == 2 else density)(z, n, count, a, p), FLOOR))


def evaluator(rows: DataFrame, rows_a_batch: int = 512) -> Evaluate:
    """Total weighted costs of any number of parameter sets: one job, a number a set from each task."""

    def evaluate(points: list[Params]) -> list[float]:
        def run(batches):
            total = np.zeros(len(points))
            for b in batches:
                for at in range(0, b.num_rows, rows_a_batch):
                    parts = _parts(b.slice(at, rows_a_batch))
                    total += [float((parts[-1] * _cost(parts, p)).sum()) for p in points]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(points), dtype=np.int32)), pa.array(total)], names=["i", "cost"])

        got = rows.mapInArrow(run, "i int, cost double").groupBy("i").agg(F.sum("cost").alias("cost")).collect()
        by = {r["i"]: r["cost"] for r in got}
        return [by.get(i, math.nan) for i in range(len(points))]

    return evaluate


def costs(rows: DataFrame, p: Params, key: str = "snp") -> DataFrame:
    """key, cost of every variant under fixed parameters, and for one trait `posterior`: the probability that the variant itself has an effect."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                parts = _parts(part)
                cost = _cost(parts, p)
                if parts[0].ndim == 2:
                    post = np.full(len(cost), np.nan)
                else:
                    post = np.clip(p["pi"] * density(*parts[:4], p, own="causal") * np.exp(cost), 0, 1)
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(cost), pa.array(post)], names=[key, "cost", "posterior"])

    return rows.mapInArrow(run, f"{key} {kind}, cost double, posterior double")


def _dealt(rows: DataFrame, rows_a_task: int) -> DataFrame:
    """Rows written in as many parts as their work asks for: they are few bytes and many operations."""
    rows = written(rows, "spectra")
    most = 16 * rows.sparkSession.sparkContext.defaultParallelism
    return written(rows.repartition(max(1, min(most, rows.count() // rows_a_task + 1))), "spectra-dealt")


def _usable(df: DataFrame, *columns: str) -> DataFrame:
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return df.where(ok).withColumns({c: F.col(c).cast("double") for c in columns})


FIT = "pi double, sig2_beta double, sig2_zero double, cost double, cost_infinitesimal double, n long, sum_weights double, totalhet double, num_snp long, aic double, bic double, converged boolean, rounds int"


def fit_univariate(tags: DataFrame, panel: DataFrame, pairs: DataFrame, *, key: str = "snp", weights: str | None = None, fit_sequence: tuple[str, ...] = ("diffevo", "neldermead"), repeats: int = 1, start: Params | None = None, seed: int = 1, bins: int = BINS, store: str | None = None) -> DataFrame:
    """One row: pi, sig2_beta, sig2_zero and costs, against the two-parameter model in which every variant has an effect.

    `fit_sequence`: steps of `search.sequence`.  `store`: a folder for the
    search's states, from which it goes on when it is begun again.
    """
    spark = tags.sparkSession
    rows = _dealt(spectra(_usable(tags, "z", "n"), panel, pairs, key, bins, weights), 250)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.avg("n").alias("mean_n"), F.avg("ld").alias("ld"), F.avg(F.col("z") * F.col("z")).alias("q")).first()
    whole = panel.agg(F.sum("het").alias("h"), F.count(F.lit(1)).alias("m")).first()
    if not size["n"]:
        return spark.createDataFrame([], FIT)
    evaluate = evaluator(rows)
    unit = 1.0 / (size["mean_n"] * max(size["ld"], 1e-12))  # an effect variance that adds 1 to z's variance if every variant has it
    beta = (unit * 1e-4, unit * 1e4)
    flat_space = Space({"sig2_beta": beta, "sig2_zero": (0.3, 3.0)}, {"sig2_beta": "log", "sig2_zero": "log"})
    at = Store(spark, store) if store else None
    keep = (lambda name: Store(spark, f"{at.path}/{name}")) if at else None
    flat, _ = sequence(lambda ps: evaluate([{**p, "pi": 1.0} for p in ps]), flat_space, ("neldermead-fast" if all(x.endswith("-fast") for x in fit_sequence) else "neldermead",), {"sig2_beta": unit * max(size["q"] - 1, 0.01), "sig2_zero": 1.0}, store=(lambda name: keep(f"flat-{name}")) if keep else None)
    space = Space({"pi": (1e-6, 1.0), "sig2_beta": beta, "sig2_zero": (0.3, 3.0)}, dict.fromkeys(("pi", "sig2_beta", "sig2_zero"), "log"))
    begin = start or {"pi": 0.01, "sig2_beta": min(beta[1], flat.params["sig2_beta"] * 100), "sig2_zero": flat.params["sig2_zero"]}
    best, done = sequence(evaluate, space, fit_sequence, begin, seed, repeats, keep)
    p = best.params
    aic, bic = -2.0 + 2.0 * (flat.cost - best.cost), -math.log(size["w"]) + 2.0 * (flat.cost - best.cost)
    row = (p["pi"], p["sig2_beta"], p["sig2_zero"], best.cost, flat.cost, int(size["n"]), float(size["w"]), float(whole["h"]), int(whole["m"]), aic, bic, bool(done[-1][1].converged), sum(f.rounds for _, f in done))
    return spark.createDataFrame([row], FIT)


def pair_params(one: Params, two: Params, pi12: float, rho_beta: float, rho_zero: float) -> Params:
    """Parameters of `density2` from two traits' own and what they share."""
    return {"pi1": max(one["pi"] - pi12, 0.0), "pi2": max(two["pi"] - pi12, 0.0), "pi12": pi12, "sig2_beta1": one["sig2_beta"], "sig2_beta2": two["sig2_beta"], "sig2_zero1": one["sig2_zero"], "sig2_zero2": two["sig2_zero"], "rho_beta": rho_beta, "rho_zero": rho_zero}


def correlations(rows: DataFrame, one: Params, two: Params, rho_zero: float | None = None) -> tuple[float, float]:
    """rg and rho_zero of the model in which all variants have effects: weighted least squares of z1 z2 on sqrt(n1 n2) ld.

    Slope over the traits' slopes is rg, the intercept is the covariance of noise.
    Where LD scores hardly vary the two are hard to tell apart: give `rho_zero`
    if it is known (0 for studies without common samples).
    """
    x, y = F.sqrt(F.col("n1") * F.col("n2")) * F.col("ld"), F.col("z1") * F.col("z2")
    w = F.col("w") / ((F.lit(one["sig2_zero"]) + F.col("n1") * one["sig2_beta"] * one["pi"] * F.col("ld")) * (F.lit(two["sig2_zero"]) + F.col("n2") * two["sig2_beta"] * two["pi"] * F.col("ld")))
    s = rows.agg(*[F.sum(c).alias(k) for k, c in {"w": w, "x": w * x, "y": w * y, "xx": w * x * x, "xy": w * x * y}.items()]).first()
    det = s["w"] * s["xx"] - s["x"] ** 2
    if rho_zero is not None:
        noise = rho_zero * math.sqrt(one["sig2_zero"] * two["sig2_zero"])
        slope = (s["xy"] - noise * s["x"]) / s["xx"]
    elif not det or det < 1e-9 * s["w"] * s["xx"]:  # all variants have the same neighbourhood: noise and effects cannot be told apart
        slope, noise = s["xy"] / s["xx"], 0.0
    else:
        slope, noise = (s["w"] * s["xy"] - s["x"] * s["y"]) / det, (s["xx"] * s["y"] - s["x"] * s["xy"]) / det
    rg = slope / math.sqrt(one["pi"] * one["sig2_beta"] * two["pi"] * two["sig2_beta"])
    clip = lambda v: max(-0.98, min(0.98, v))
    return clip(rg), clip(noise / math.sqrt(one["sig2_zero"] * two["sig2_zero"]))


def overlap_curve(evaluate: Evaluate, one: Params, two: Params, rg: float, rho_zero: float, points: int = 21) -> tuple[list[float], list[float], Found]:
    """grid of pi12 from the least overlap that rg allows to the greatest, the costs on it (one job), and the best overlap (line search in the bracket around the least).

    rg and rho_zero stay as they are, so rho_beta = rg sqrt(pi1 pi2) / pi12.
    """
    root = math.sqrt(one["pi"] * two["pi"])
    high = min(one["pi"], two["pi"])
    low = max(abs(rg) * root / 0.999, high * 1e-4)
    if low >= high:  # more correlation than shared variants can carry
        low = high * (1 - 1e-9)
    at = lambda pi12: pair_params(one, two, pi12, max(-0.999, min(0.999, rg * root / pi12)), rho_zero)
    grid = [float(x) for x in np.linspace(low, high, points)]
    ask = lambda ps: evaluate([at(p["pi12"]) for p in ps])
    cost = ask([{"pi12": x} for x in grid])
    i = int(np.argmin(cost))
    best = line(ask, Space({"pi12": (low, high)}, {"pi12": "add"}), grid[max(i - 1, 0)], grid[min(i + 1, points - 1)], tolerance=1e-4)
    if cost[i] < best.cost:
        best = Found({"pi12": grid[i]}, cost[i], best.rounds, best.converged, best.trace)
    return grid, cost, best


def fit_bivariate(tags: DataFrame, panel: DataFrame, pairs: DataFrame, one: Params, two: Params, *, key: str = "snp", weights: str | None = None, points: int = 21, bins: int = 8, rho_zero: float | None = None) -> dict:
    """pi12, rho_beta, rho_zero, rg, cost, grid and jout (the overlap curve), n and sum_weights of two traits fitted before."""
    rows = _dealt(spectra(_usable(tags, "z1", "z2", "n1", "n2"), panel, pairs, key, bins, weights), 25)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w")).first()
    rg, rho_zero = correlations(rows, one, two, rho_zero)
    grid, jout, best = overlap_curve(evaluator(rows, 64), one, two, rg, rho_zero, points)
    pi12 = best.params["pi12"]
    return {"pi12": pi12, "rho_beta": max(-0.999, min(0.999, rg * math.sqrt(one["pi"] * two["pi"]) / pi12)), "rho_zero": rho_zero, "rg": rg, "cost": best.cost, "grid": grid, "jout": jout, "n": size["n"], "sum_weights": size["w"], "converged": best.converged}

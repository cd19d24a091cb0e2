"""Optimisers that ask for many costs at once.

A cost is a sum over a distributed table, so asking costs a job: each optimiser
here hands over a whole generation of candidates (`evaluate`: parameters in,
costs out), which is one aggregation however many candidates there are.

Searches end when their steps or their population are small, and say so
(`converged`); a bound on rounds is the caller's wish, never silent.  With a
`Store` the state of each generation is written, and a search begun again goes
on from the last one; random numbers depend on the seed and the generation
alone, so both end alike.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import SparkSession

Params = dict[str, float]
Evaluate = Callable[[list[Params]], list[float]]


@dataclass
class Found:
    params: Params
    cost: float
    rounds: int
    converged: bool
    trace: list[float] = field(default_factory=list)  # the least cost of each round


@dataclass
class Space:
    """Bounds of each parameter, and whether it moves by factors ("log") or amounts ("add")."""

    bounds: dict[str, tuple[float, float]]
    scale: dict[str, str]
    valid: Callable[[Params], bool] = lambda p: True

    @property
    def names(self) -> list[str]:
        return list(self.bounds)

    def _ends(self, name: str) -> tuple[float, float]:
        lo, hi = self.bounds[name]
        return (math.log(lo), math.log(hi)) if self.scale[name] == "log" else (lo, hi)

    def point(self, u: np.ndarray) -> Params:
        """Parameters at a place of the unit cube (beyond it: at its side)."""
        out = {}
        for name, x in zip(self.names, np.clip(u, 0.0, 1.0), strict=True):
            lo, hi = self._ends(name)
            v = lo + float(x) * (hi - lo)
            out[name] = math.exp(v) if self.scale[name] == "log" else v
        return out

    def place(self, p: Params) -> np.ndarray:
        ends = [self._ends(k) for k in self.names]
        at = [math.log(p[k]) if self.scale[k] == "log" else p[k] for k in self.names]
        return np.clip([(v - lo) / (hi - lo) for v, (lo, hi) in zip(at, ends, strict=True)], 0.0, 1.0)


class Store:
    """States of a search as files below a folder; the last complete one counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _steps(self) -> list[str]:
        top = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return []
        done = [s.getPath() for s in fs.listStatus(top) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(p.toString() for p in done)

    def load(self) -> dict | None:
        steps = self._steps()
        return json.loads(self.spark.read.text(steps[-1]).first()[0]) if steps else None

    def save(self, number: int, state: dict) -> None:
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/step-{number:06d}")
        for old in self._steps()[:-2]:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(old)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def _costs(evaluate: Evaluate, space: Space, points: list[Params]) -> list[float]:
    """Costs of the points; those outside the valid region cost infinity and are not evaluated."""
    ask = [i for i, p in enumerate(points) if space.valid(p)]
    out = [math.inf] * len(points)
    for i, c in zip(ask, evaluate([points[i] for i in ask]) if ask else [], strict=True):
        out[i] = c if c is not None and not math.isnan(c) else math.inf
    return out


def _bottom(points: np.ndarray, costs: np.ndarray) -> np.ndarray | None:
    """Where a quadratic through these points and costs is least, if it is least anywhere."""
    known = np.isfinite(costs)
    d = points.shape[1]
    i, j = np.triu_indices(d)
    x = points[known] - points[0]
    if len(x) < 1 + d + len(i):
        return None
    terms, *_ = np.linalg.lstsq(np.hstack([np.ones((len(x), 1)), x, x[:, i] * x[:, j]]), costs[known] - costs[0], rcond=None)
    bend = np.zeros((d, d))
    bend[i, j] = terms[1 + d :]
    bend = bend + bend.T
    if np.linalg.eigvalsh(bend)[0] <= 0:
        return None
    return points[0] - np.linalg.solve(bend, terms[1 : 1 + d])


def pattern(evaluate: Evaluate, space: Space, start: Params, step: float = 0.1, tolerance: float = 1e-5, gain: float = 1e-8, rounds: int | None = None) -> Found:
    """All neighbours of the present point at once, the place where the last round's neighbours point to, and on along the way just gone.

    Steps (shares of each parameter's range) halve when none is better by a share of `gain`.
    """
    now, best, n, trace, ahead = space.place(start), math.inf, 0, [], []
    signs = [s for s in itertools.product((-1, 0, 1), repeat=len(now)) if any(s)]
    while rounds is None or n < rounds:
        n += 1
        near = np.array([now] + [np.clip(now + step * np.array(s), 0, 1) for s in signs])
        around = [*near, *ahead]
        costs = _costs(evaluate, space, [space.point(u) for u in around])
        i = min(range(len(costs)), key=lambda j: (costs[j], j))
        trace.append(costs[i])
        if not math.isfinite(costs[i]):
            return Found(space.point(now), math.nan, n, False, trace)
        best, there = costs[i], _bottom(near, np.array(costs[: len(near)])) if math.isfinite(costs[0]) else None
        ahead = [] if there is None else [np.clip(now + f * (there - now), 0, 1) for f in (0.5, 1.0, 2.0)]
        if i and costs[i] < costs[0] - gain * abs(costs[0]):
            # Along a valley: several lengths of the way just gone.
            ahead += [np.clip(around[i] + f * (around[i] - now), 0, 1) for f in (1.0, 4.0, 16.0, 64.0)]
            now = around[i]
        else:
            step /= 2
            if step < tolerance:
                return Found(space.point(now), costs[0], n, True, trace)
    return Found(space.point(now), best, n, False, trace)


def differential_evolution(evaluate: Evaluate, space: Space, seed: int = 1, size: int | None = None, weight: float = 0.7, cross: float = 0.9, tolerance: float = 1e-6, rounds: int | None = None, store: Store | None = None) -> Found:
    """A population in which each member competes with a mix of three others; all trials of a generation are evaluated together.

    It ends when the population lies close together, in cost or in place.
    """
    d = len(space.names)
    size = size or max(12, 8 * d)
    state = store.load() if store else None
    if state and "people" in state:
        people, costs, n, trace = np.array(state["people"]), np.array(state["costs"]), state["round"], state["trace"]
    else:
        rng = np.random.default_rng([seed, 0])
        cells = np.stack([rng.permutation(size) for _ in range(d)], 1)  # one member in each slice of each parameter
        people, n, trace = (cells + rng.random((size, d))) / size, 0, []
        costs = np.array(_costs(evaluate, space, [space.point(u) for u in people]))
    while rounds is None or n < rounds:
        least = costs.min()
        if not math.isfinite(least):
            return Found(space.point(people[0]), math.nan, n, False, trace)
        if costs.max() - least <= tolerance * max(1.0, abs(least)) or np.ptp(people, axis=0).max() <= tolerance:
            break
        n += 1
        rng = np.random.default_rng([seed, n])
        others = np.stack([rng.permutation(np.delete(np.arange(size), i))[:3] for i in range(size)])
        mixed = people[others[:, 0]] + weight * (people[others[:, 1]] - people[others[:, 2]])
        mixed = np.abs(mixed)  # back from the sides of the cube
        mixed = np.where(mixed > 1, np.clip(2 - mixed, 0, 1), mixed)
        taken = (rng.random((size, d)) < cross) | (np.arange(d) == rng.integers(0, d, size)[:, None])
        trial = np.where(taken, mixed, people)
        new = np.array(_costs(evaluate, space, [space.point(u) for u in trial]))
        won = new <= costs
        people, costs = np.where(won[:, None], trial, people), np.where(won, new, costs)
        trace.append(float(costs.min()))
        if store:
            store.save(n, {"people": people.tolist(), "costs": costs.tolist(), "round": n, "trace": trace})
    i = int(costs.argmin())
    close = costs.max() - costs.min() <= tolerance * max(1.0, abs(costs.min())) or np.ptp(people, axis=0).max() <= tolerance
    return Found(space.point(people[i]), float(costs[i]), n, bool(close), trace)


def nelder_mead(evaluate: Evaluate, space: Space, start: Params, step: float = 0.05, tolerance: float = 1e-6, rounds: int | None = None, store: Store | None = None) -> Found:
    """A simplex; every way it can move (reflection, expansion, both contractions, shrinking) is evaluated together."""
    state = store.load() if store else None
    if state and "corners" in state:
        corners, costs, n, trace = np.array(state["corners"]), np.array(state["costs"]), state["round"], state["trace"]
    else:
        at = space.place(start)
        corners = np.array([at] + [at + np.eye(len(at))[i] * (step if at[i] + step <= 1 else -step) for i in range(len(at))])
        costs, n, trace = np.array(_costs(evaluate, space, [space.point(u) for u in corners])), 0, []
    small = lambda: np.ptp(corners, axis=0).max() <= tolerance or np.ptp(costs) <= 1e-10 * max(1.0, abs(costs.min()))
    while not small() and (rounds is None or n < rounds):
        n += 1
        order = np.argsort(costs, kind="stable")
        corners, costs = corners[order], costs[order]
        if not math.isfinite(costs[0]):
            return Found(space.point(corners[0]), math.nan, n, False, trace)
        middle, worst = corners[:-1].mean(0), corners[-1]
        ways = [np.clip(middle + f * (middle - worst), 0, 1) for f in (1.0, 2.0, 0.5, -0.5)]
        shrunk = corners[0] + 0.5 * (corners[1:] - corners[0])
        got = np.array(_costs(evaluate, space, [space.point(u) for u in [*ways, *shrunk]]))
        reflected, expanded, outside, inside = got[:4]
        if reflected < costs[0]:
            k = 1 if expanded < reflected else 0
        elif reflected < costs[-2]:
            k = 0
        elif reflected < costs[-1] and outside <= reflected:
            k = 2
        elif reflected >= costs[-1] and inside < costs[-1]:
            k = 3
        else:
            k = None
        if k is None:
            corners, costs = np.vstack([corners[:1], shrunk]), np.concatenate([costs[:1], got[4:]])
        else:
            corners[-1], costs[-1] = ways[k], got[k]
        trace.append(float(costs.min()))
        if store:
            store.save(n, {"corners": corners.tolist(), "costs": costs.tolist(), "round": n, "trace": trace})
    i = int(costs.argmin())
    return Found(space.point(corners[i]), float(costs[i]), n, bool(small()), trace)


def line(evaluate: Evaluate, space: Space, low: float, high: float, points: int = 9, tolerance: float = 1e-6, rounds: int | None = None) -> Found:
    """The least cost between two places of the one parameter: `points` inside the bracket at once, then the bracket around the best of them."""
    (name,) = space.names
    n, trace, best, least = 0, [], None, math.inf
    while rounds is None or n < rounds:
        n += 1
        at = np.linspace(low, high, points + 2)
        costs = _costs(evaluate, space, [{name: float(x)} for x in at])
        i = int(np.argmin(costs))
        if costs[i] < least:
            best, least = float(at[i]), costs[i]
        trace.append(least)
        if not math.isfinite(least):
            return Found({name: low}, math.nan, n, False, trace)
        low, high = float(at[max(i - 1, 0)]), float(at[min(i + 1, points + 1)])
        if high - low <= tolerance * max(abs(low), abs(high), 1e-300):
            return Found({name: best}, least, n, True, trace)
    return Found({name: best}, least, n, False, trace)


def sequence(evaluate: Evaluate, space: Space, steps: tuple[str, ...], start: Params, seed: int = 1, repeats: int = 1, store: Callable[[str], Store] | None = None) -> tuple[Found, list[tuple[str, Found]]]:
    """A fit sequence of named steps, each from the best point so far: diffevo, neldermead, pattern, and the first two with "-fast" (looser ends)."""
    best, done = None, []
    for k, step in enumerate(steps):
        loose = 100.0 if step.endswith("-fast") else 1.0
        begin = best.params if best else start
        keep = store(f"{k}-{step}") if store else None
        kind = step.removesuffix("-fast")
        if kind == "diffevo":
            runs = [differential_evolution(evaluate, space, seed + r, tolerance=1e-6 * loose, store=keep if repeats == 1 else (store(f"{k}-{step}-{r}") if store else None)) for r in range(repeats)]
            found = min(runs, key=lambda f: (math.isnan(f.cost), f.cost))
        elif kind == "neldermead":
            found = nelder_mead(evaluate, space, begin, tolerance=1e-5 * loose, store=keep)
        elif kind == "pattern":
            found = pattern(evaluate, space, begin, tolerance=1e-5 * loose)
        else:
            raise ValueError(f"not a step of a fit: {step}")
        done.append((step, found))
        if best is None or found.cost < best.cost:
            best = found
    return best, done

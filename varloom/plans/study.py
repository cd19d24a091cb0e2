"""The plan of a cross-trait study: traits, pairs, and the order of the fits.

Steps depend on earlier ones: a trait is fitted, then tested on all variants;
a pair is fitted after both its traits were fitted and tested, then tested;
tables come last.  Replicates of a step are independent and become rows, so
one Spark job runs them side by side.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge(primary: Mapping[str, str], secondary: Mapping[str, str]) -> dict[str, str]:
    """Trait files by name; for a name in both, the secondary one counts."""
    return dict(primary) | dict(secondary)


def pairs(primary: Mapping[str, str], secondary: Mapping[str, str]) -> list[tuple[str, str]]:
    """(primary, secondary) names whose files differ.  The same rule holds for fits and for tables."""
    return [(a, b) for b in secondary for a in primary if primary[a] != secondary[b]]


def pairs_frame(primary: DataFrame, secondary: DataFrame, trait: str = "trait", file: str | None = None) -> DataFrame:
    """The same for frames of traits (a few hundred rows): trait1, trait2."""
    f = file or trait
    a, b = primary.select(F.col(trait).alias("trait1"), F.col(f).alias("_f1")), secondary.select(F.col(trait).alias("trait2"), F.col(f).alias("_f2"))
    return a.crossJoin(b).where(F.col("_f1") != F.col("_f2")).select("trait1", "trait2")


@dataclass(frozen=True)
class Step:
    kind: str
    traits: tuple[str, ...]
    needs: tuple[str, ...] = field(default=())
    replicates: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}({','.join(self.traits)})"


def study(primary: Mapping[str, str], secondary: Mapping[str, str], replicates: int = 20) -> list[Step]:
    """All steps in an order in which each follows what it needs."""
    steps: list[Step] = []
    for t in merge(primary, secondary):
        fit = Step("fit1", (t,), replicates=replicates)
        steps += [fit, Step("test1", (t,), (fit.name,), replicates)]
    tests = []
    for a, b in pairs(primary, secondary):
        needs = tuple(f"{k}({t})" for t in (a, b) for k in ("fit1", "test1"))
        fit = Step("fit2", (a, b), needs, replicates)
        test = Step("test2", (a, b), (fit.name,), replicates)
        tests.append(test.name)
        steps += [fit, test]
    steps += [Step("one", (t,), (f"test1({t})",)) for t in merge(primary, secondary)]
    steps += [Step("two", (a, b), tuple(tests)) for a, b in pairs(primary, secondary)]
    return steps


def waves(steps: list[Step]) -> list[list[Step]]:
    """Steps that can run together, wave by wave.  A circle or an unknown need is an error."""
    done: set[str] = set()
    left = list(steps)
    out: list[list[Step]] = []
    while left:
        now = [s for s in left if set(s.needs) <= done]
        if not now:
            raise ValueError(f"steps wait for what never comes: {[s.name for s in left]}")
        out.append(now)
        done |= {s.name for s in now}
        left = [s for s in left if s.name not in done]
    return out

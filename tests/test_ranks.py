import itertools
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from varloom.operators import harmonize, ld, ranks

INF = float("inf")
GROUPS = {
    "one": [3.0],
    "two": [1.0, 2.0],
    "equal": [5.0] * 7,
    "ties": [1.0, 2.0, 2.0, 2.0, 9.0, 9.0],
    "scales": [10.0**k for k in range(-300, 300, 40)],
    "ends": [-INF, -1.7e308, 0.0, 1.7e308, INF, 4.0],
    "tiny": [0.0, 5e-324, 1e-323, -5e-324],
    "some": [random.Random(1).gauss(0, 1) for _ in range(500)],
    "skewed": [random.Random(2).lognormvariate(0, 5) for _ in range(333)],
    "with gaps": [1.0, None, 3.0, float("nan")],
    "empty": [None, float("nan")],
    None: [1.0, 2.0],
}


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(g, v, i) for g, vs in GROUPS.items() for i, v in enumerate(vs)], "g string, v double, extra long")


def values(g):
    return sorted(v for v in GROUPS[g] if v is not None and not math.isnan(v))


@pytest.mark.parametrize("buckets", [4, 4096])
def test_median_against_sorting(table, buckets):
    got = {r["g"]: r["median"] for r in ranks.exact_median(table, "v", "g", buckets=buckets).collect()}
    want = {g: statistics.median(values(g)) for g in GROUPS if g is not None and values(g)}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[g], want[g], rel_tol=1e-15) for g in want)


def test_every_rank(spark):
    rng = random.Random(4)
    big = 2**62  # whole numbers that doubles cannot tell apart
    rows = {"a": [rng.randrange(40) for _ in range(30)], "b": [big + rng.randrange(9) for _ in range(25)], "c": [-big, big, 0]}
    df = spark.createDataFrame([(g, v) for g, vs in rows.items() for v in vs], "g string, v long")
    for k in (0, 2, 11, 24, 99):
        for r in ranks.rank_values(df, "v", "g", F.lit(k), buckets=4).collect():
            s = sorted(rows[r["g"]])
            assert r["value"] == s[min(k, len(s) - 1)] and r["below"] == sum(v < r["value"] for v in s) and r["n"] == len(s)


def test_lowest_rows(spark):
    df = spark.createDataFrame([(g, v, t) for g in (1, 2) for t, v in enumerate([5, 1, 5, 5, 0, 7])], "g int, v long, t int")
    got = sorted((r["g"], r["v"], r["t"]) for r in ranks.lowest(df, "v", "g", 4, "t").collect())
    assert got == [(g, v, t) for g in (1, 2) for v, t in ((0, 4), (1, 1), (5, 0), (5, 2))]
    assert ranks.lowest(df, "v", "g", 9, "t").count() == 12


def test_half_median(spark, table):
    got = sorted((r["g"], r["v"]) for r in harmonize.half_median_n(table, "v", "g").where("g not in ('ends', 'tiny')").collect())
    want = sorted((g, v) for g in GROUPS if g not in ("ends", "tiny", "empty", None) for v in values(g) if v >= statistics.median(values(g)) / 2)
    assert got == want
    assert harmonize.half_median_n(table.where("g = 'ties'"), "v").columns == table.columns
    assert sorted(r["v"] for r in harmonize.half_median_n(table.where("g = 'ties'"), "v").collect()) == [1.0, 2.0, 2.0, 2.0, 9.0, 9.0]
    assert harmonize.half_median_n(table.where("false"), "v", "g").count() == 0


def test_no_aggregate_holds_a_group(table):
    plan = ranks.exact_median(table, "v", "g")._jdf.queryExecution().executedPlan().toString()
    assert not any(f"{name}(" in plan for name in ("median", "percentile", "collect_list", "collect_set"))


def test_replicates_are_independent_and_maximal(spark):
    """Every replicate against brute force: it is what the same seed alone gives, by taking variants in the order of their hashes."""
    rng = random.Random(5)
    n = 60
    pairs = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(150)})
    nodes = spark.createDataFrame([(i, 0.01 * (i % 50)) for i in range(n)], "vec_id long, maf double")
    linked = spark.createDataFrame([(a, b, rng.choice([0.3, 0.6])) for a, b in pairs], "i long, j long, r2 double")
    strong = {(r["i"], r["j"]) for r in linked.collect() if r["r2"] >= 0.5}
    order = {(r["rep"], r["vec_id"]): r["h"] for r in nodes.select("vec_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("rep")).withColumn("h", F.xxhash64("vec_id", F.col("rep") + F.lit(7))).collect()}
    rows = ld.prune_replicates(nodes, linked, 0.5, replicates=5, seed=7).collect()
    got = {rep: {r["vec_id"] for r in rows if r["rep"] == rep} for rep in range(1, 6)}
    assert sum(map(len, got.values())) == len(rows)
    for rep in got:
        want: set[int] = set()
        for v in sorted(range(n), key=lambda x: order[rep, x]):
            if not any((min(v, w), max(v, w)) in strong for w in want):
                want.add(v)
        assert got[rep] == want
    assert len({frozenset(x) for x in got.values()}) > 1
    assert {r["vec_id"] for r in ld.random_prune(nodes, linked, 0.5, seed=9).collect()} == got[2]
    few = ld.prune_replicates(nodes, linked, 0.5, replicates=2, seed=7, maf=0.1, n=20).collect()
    for rep, some in itertools.groupby(sorted(few, key=lambda r: r["rep"]), key=lambda r: r["rep"]):
        kept = [r["vec_id"] for r in some]
        allowed = sorted((v for v in range(n) if v % 50 >= 10), key=lambda x: order[rep, x])[:20]
        assert set(kept) <= set(allowed)
        assert all(v in kept or any((min(v, w), max(v, w)) in strong for w in kept) for v in allowed)


def test_rounds_do_not_grow_with_replicates(spark, monkeypatch):
    nodes = spark.range(64).select(F.col("id").alias("vec_id"))
    linked = spark.range(63).select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"), F.lit(0.9).alias("r2"))
    calls = []
    kept = ld._written
    monkeypatch.setattr(ld, "_written", lambda df, work: calls.append(1) or kept(df, work))
    ld.prune_replicates(nodes, linked, 0.5, replicates=1).count()
    one = len(calls)
    calls.clear()
    assert ld.prune_replicates(nodes, linked, 0.5, replicates=20).select("rep").distinct().count() == 20
    assert len(calls) < one + 3 * 6  # the slowest replicate decides, not their sum

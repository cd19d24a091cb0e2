"""Sums over intervals against the pairs of points and intervals."""

import math
import random

import pytest
from pyspark.sql import functions as F

from varloom import catalog
from varloom.operators import geneset, ranges, spans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    places = [(f"s{i}", rng.randrange(1, 3), rng.randrange(-50, 3000)) for i in range(500)]
    places += [(f"s{i}", 1, rng.randrange(3000)) for i in range(20)] + places[30:35]  # several positions, repeated rows
    z = [(f"s{i}", 0.0 if i % 9 == 0 else float("nan") if i % 50 == 1 else rng.gauss(0, 1), 100.0 + i) for i in range(500)]
    genes = [(f"g{i}", rng.randrange(1, 3), a, a + rng.choice([0, 1, 7, 63, 64, 200, 900])) for i in range(60) for a in [rng.randrange(3000)]]
    genes += [(f"g{i}", c, a + 30, b + 60) for i, (_, c, a, b) in enumerate(genes[:10])]  # two intervals that overlap
    sets = [(f"GO{i % 4}", f"g{i}") for i in range(55)] + [("GO9", f"g{i}") for i in range(0, 50, 7)]
    f = spark.createDataFrame
    return f(places, "snp string, chr int, bp long"), f(z, "snp string, z double, n double"), f(genes, "gene string, chr int, gstart long, gend long"), f(sets, "go string, gene string")


def near(a, b):
    return a == b or (a is not None and b is not None and (math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) or (math.isnan(a) and math.isnan(b)))) if not isinstance(a, str) else a == b


def same(got, want):
    got, want = (sorted(map(tuple, d.collect()), key=lambda r: str(r[0])) for d in (got, want))
    assert len(got) == len(want) and got
    bad = [(a, b) for a, b in zip(got, want, strict=True) if not all(near(x, y) for x, y in zip(a, b, strict=True))]
    assert not bad, bad[:3]


def test_genes_as_by_pairs(tables):
    places, z, genes, _ = tables
    held = ranges.interval_join(places.where("bp >= 0"), genes, flank=5)
    same(geneset.gene_z_at(z.select("snp", "z"), places.where("bp >= 0"), genes, flank=5), geneset.gene_z(z.select("snp", "z"), held))


def test_sets_as_by_pairs(tables):
    places, z, genes, sets = tables
    places = places.where("bp >= 0")
    label = places.groupBy("snp").agg(F.min(F.col("chr").cast("string")).alias("chr"))
    by_pairs = geneset.fit_inputs(z.join(label, "snp"), ranges.interval_join(places, genes, flank=5).select("gene", "snp"), sets)
    variants = z.join(places, "snp")
    several = places.groupBy("snp").agg(F.count_distinct("chr").alias("k")).where("k > 1")
    # The jackknife needs one chromosome a variant.
    by_pairs, variants = by_pairs.join(several, "snp", "left_anti"), variants.join(several, "snp", "left_anti")
    same(geneset.analyse_at(variants, genes, sets, flank=5), geneset.analyse(by_pairs))


def test_values_that_are_not_finite_stay_in_their_interval(spark):
    points = spark.createDataFrame([(1, i, 1e300 if i == 7 else float("inf") if i == 9 else 1e-9) for i in range(20)], "chr int, bp long, v double")
    spans_ = spark.createDataFrame([("a", 1, 0, 6), ("b", 1, 10, 19), ("c", 1, 8, 12)], "gene string, chr int, lo long, hi long")
    got = {r["gene"]: r["v"] for r in spans.interval_sums(points, spans_, ["v"], ["gene"]).collect()}
    assert got["a"] == pytest.approx(7e-9, rel=1e-12) and got["b"] == pytest.approx(1e-8, rel=1e-12) and math.isinf(got["c"])


@pytest.mark.parametrize("name", ["gene_mean_stat", "gene_p_values", "gene_set_p_values", "gene_set_model"])
def test_no_row_for_each_pair(spark, monkeypatch, name):
    """Pairs of variants and genes grow with the product of both tables."""
    rows, join = [], ranges.interval_join

    def counted(*a, **k):
        out = join(*a, **k)
        rows.append(out.count())
        return out

    monkeypatch.setattr(ranges, "interval_join", counted)
    assert catalog.QUERIES[name](spark, SF).count() > 0
    assert sum(rows) == 0

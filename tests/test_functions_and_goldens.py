"""Scalar functions and the published golden values."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from varloom.functions import alleles, normal, text
from varloom.operators import harmonize, models, ranges


def test_quantile_against_the_standard_library(spark):
    rng = random.Random(1)
    ps = [rng.random() for _ in range(500)] + [10.0**-k for k in range(1, 300, 7)] + [1 - 10.0**-k for k in range(1, 15)] + [0.5, 0.075, 0.925]
    rows = spark.createDataFrame([(p,) for p in ps], "p double").select("p", normal.quantile("p").alias("q")).collect()
    inv = statistics.NormalDist().inv_cdf
    for r in rows:
        assert math.isclose(r["q"], inv(r["p"]), rel_tol=1e-13, abs_tol=1e-15)
    edge = spark.createDataFrame([(0.0,), (1.0,), (-1.0,), (None,)], "p double").select(normal.quantile("p").alias("q")).collect()
    assert [r["q"] for r in edge] == [None] * 4


def test_z_goldens(spark):
    df = spark.createDataFrame([(0.812, 1.0024), (0.2585, 0.98906), (1.0, 1.2), (0.5, 1.0), (0.0, 2.0), (None, 2.0)], "p double, o double")
    z = [r["z"] for r in df.select(normal.z_from_p_and_or("p", "o").alias("z")).collect()]
    assert math.isclose(z[0], 0.23784669541774933, rel_tol=1e-12) and math.isclose(z[1], -1.1299435776163629, rel_tol=1e-12)
    assert z[2] == 0 and z[3] == 0 and z[4] is None and z[5] is None
    assert math.isclose(normal.effective_n_value(40675, 64643), 99863.42410604075, rel_tol=1e-15)
    n = spark.range(1).select(normal.effective_n(F.lit(40675.0), F.lit(64643.0)).alias("n"), normal.effective_n(F.lit(0.0), F.lit(5.0)).alias("z")).first()
    assert math.isclose(n["n"], 99863.42410604075, rel_tol=1e-15) and n["z"] is None


def test_z_round_trip(spark):
    z = [x / 7 for x in range(-200, 201) if x]
    p = [(math.erfc(abs(x) / math.sqrt(2)), math.exp(x / 100), x) for x in z]
    df = spark.createDataFrame(p, "p double, o double, z double").where("p > 0")
    for r in df.select("z", normal.z_from_p_and_or("p", "o").alias("y")).collect():
        assert math.isclose(r["z"], r["y"], rel_tol=1e-6)


def test_golden_relations(spark):
    pi = 0.0030418808730291644
    row = spark.createDataFrame([(pi, 9997231.0)], "pi double, m double").select(models.nc_p9(F.col("pi"), F.col("m")).alias("x")).first()
    assert math.isclose(row["x"], 9700.913058127198, rel_tol=1e-9)
    n = math.exp(9.45466710470906 + 2)
    out = spark.createDataFrame([(10.0, 4.0, n)], "alt double, best double, n double").select((models.aic_delta(F.col("alt"), F.col("best")) - models.bic_delta(F.col("alt"), F.col("best"), F.col("n"))).alias("d")).first()
    assert math.isclose(out["d"], 9.45466710470906, abs_tol=1e-9)
    # The logged counts close: lines - header - unmatched - mismatched - ambiguous = kept.
    assert 8130258 - 1 - 684787 - 1134409 == 6311061 and 9241349 - 1 - 1291097 - 11 - 1080837 == 6869403


def test_overlap_goldens(spark):
    """The published means satisfy the relations within the spread of replicates."""
    pi1, pi2, pi12, rho = 0.0030418808730291644, 0.0035, 0.0029, -0.27
    r = models.overlap(models.venn(spark.createDataFrame([(pi1, pi2, pi12, rho)], "pi1u double, pi2u double, pi12 double, rho_beta double"))).first()
    assert math.isclose(r["pi1"] + r["pi12"], pi1) and math.isclose(r["dice"], 2 * pi12 / (pi1 + pi2))
    assert math.isclose(r["rg"], rho * pi12 / math.sqrt(pi1 * pi2)) and math.isclose(r["pi12_min"], r["rg"] * math.sqrt(pi1 * pi2))
    assert math.isclose(r["fraction_concordant_within_shared"], 0.5 + math.asin(rho) / math.pi)


def test_allele_key_is_one_for_all_encodings(spark):
    comp = str.maketrans("ACGT", "TGCA")
    pairs = [(a, b) for a in "ACGT" for b in "ACGT" if a != b] + [("T", "AA"), ("ACG", "A")]
    rows = []
    for a, b in pairs:
        for x, y in ((a, b), (b, a), (a.translate(comp), b.translate(comp)), (b.translate(comp), a.translate(comp))):
            rows.append((a, b, x, y))
    out = spark.createDataFrame(rows, "a string, b string, x string, y string").select("*", (alleles.pair_key(F.col("a"), F.col("b")) == alleles.pair_key(F.col("x"), F.col("y"))).alias("same"), alleles.ambiguous(F.col("a"), F.col("b")).alias("amb"), alleles.swapped(F.col("a"), F.col("b"), F.col("x"), F.col("y")).alias("sw"), alleles.swapped(F.col("x"), F.col("y"), F.col("a"), F.col("b")).alias("back")).collect()
    assert all(r["same"] for r in out)
    assert {r["a"] + r["b"] for r in out if r["amb"]} == {"AT", "TA", "CG", "GC"}
    assert all(r["sw"] == r["back"] for r in out)


def test_range_grammar():
    assert ranges.parse_ranges("[]") == [] and ranges.parse_ranges("") == []
    assert ranges.parse_ranges("MHC chr21:20-21MB, chr22:19100-19900KB 6:25000000-35000000") == [("6", 25_000_000, 35_000_000), ("21", 20_000_000, 21_000_000), ("22", 19_100_000, 19_900_000), ("6", 25_000_000, 35_000_000)]
    for bad in ("chr21", "21:5-1", "x y:1"):
        with pytest.raises(ValueError):
            ranges.parse_ranges(bad)
    assert ranges.parse_chromosomes("21-22") == [21, 22] and ranges.parse_chromosomes("1,3,5-7") == [1, 3, 5, 6, 7]


def test_mhc_bounds_are_strict_and_text_labels_count(spark):
    df = spark.createDataFrame([("6", 26_000_000), ("6", 26_000_001), ("6", 33_999_999), ("6", 34_000_000), ("X", 30_000_000), ("7", 30_000_000), (None, 30_000_000)], "c string, b long")
    row = harmonize.exclusion_counts(df, "c", "b").first()
    assert (row["n"], row["mhc"], row["x"], row["excluded"], row["kept"], row["disjoint"]) == (7, 2, 1, 3, 4, True)
    assert df.where(~harmonize.excluded(F.col("c"), F.col("b"))).count() == 4


def test_formats(spark):
    df = spark.createDataFrame([(1234567.125, 0.000123, 7), (-0.001, None, None)], "enrich double, magma_p double, ngenes long")
    a, b = df.select(*[text.formatted(c).alias(c) for c in df.columns]).collect()
    assert tuple(a) == ("1,234,567.12", "1.23e-04", "7") and b["magma_p"] == "" and b["ngenes"] == "" and b["enrich"] in ("-0.00", "0.00")

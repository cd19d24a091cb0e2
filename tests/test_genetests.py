"""Gene and set tests under LD: against direct computation, sampling, and their level on linked null data."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.functions.normal import tail_sql, upper_tail
from varloom.operators import geneset, genetests

M, WIDTH, STEP = 2400, 8, 5  # variants, variants a gene, variants between the starts of genes


def test_tail(spark):
    z = [-8.0, -1.0, 0.0, 0.5, 3.0, 6.9, 7.1, 8.0, 10.0, 20.0, 37.0]
    got = spark.createDataFrame([(x,) for x in z], "z double").select(F.expr(tail_sql("z")).alias("a"), upper_tail(F.col("z")).alias("b")).collect()
    assert [r["a"] for r in got] == pytest.approx([r["b"] for r in got], rel=1e-12)
    assert [r["a"] for r in got] == pytest.approx([0.5 * math.erfc(x / math.sqrt(2)) for x in z], rel=1e-8)


@pytest.fixture(scope="module")
def linked(spark):
    """One chromosome of variants with r = 0.8 to the distance, overlapping genes, null z."""
    rng = np.random.default_rng(4)
    z = np.zeros(M)
    z[0] = rng.normal()
    for i in range(1, M):
        z[i] = 0.8 * z[i - 1] + 0.6 * rng.normal()
    genes = {f"g{k:04d}": range(k * STEP, k * STEP + WIDTH) for k in range((M - WIDTH) // STEP)}
    variants = spark.createDataFrame([(f"s{i}", float(x)) for i, x in enumerate(z)], "snp string, z double")
    held = spark.createDataFrame([(g, f"s{i}") for g, r in genes.items() for i in r], "gene string, snp string")
    pairs = spark.createDataFrame([(f"s{i}", f"s{i + d}", 0.8**d) for i in range(M) for d in range(1, 12) if i + d < M], "i string, j string, r double").withColumn("r2", F.col("r") ** 2)
    return z, genes, variants, held, pairs


def test_statistics(spark, linked):
    z, genes, variants, held, pairs = linked
    r = 0.8 ** np.abs(np.subtract.outer(np.arange(WIDTH), np.arange(WIDTH)))
    got = {x["gene"]: x for x in genetests.gene_statistics(variants, held, pairs).collect()}
    exact = {x["gene"]: x for x in genetests.saddlepoint(variants, held, pairs).collect()}
    assert set(got) == set(exact) == set(genes)
    sample = np.sort(((np.linalg.cholesky(r) @ np.random.default_rng(5).normal(size=(WIDTH, 200_000))) ** 2).sum(0))
    for g, i in genes.items():
        stat = float((z[list(i)] ** 2).sum())
        df = WIDTH**2 / float((r * r).sum())
        assert got[g]["nsnps"] == WIDTH and got[g]["stat"] == pytest.approx(stat) and got[g]["df"] == pytest.approx(df)
        true = 1 - np.searchsorted(sample, stat) / len(sample)
        assert exact[g]["p"] == pytest.approx(true, abs=0.005 if true < 0.1 else 0.03)
        assert got[g]["p"] == pytest.approx(true, abs=0.02 if true < 0.1 else 0.1)  # two moments: near in the tail, rough in the middle
    low = lambda rows, c: np.mean([x[c] < 0.05 for x in rows])
    assert 0.02 < low(exact.values(), "p") < 0.09
    alone = geneset.gene_z(variants, held).collect()
    assert low(alone, "p") > 1.5 * low(exact.values(), "p")  # independent variants: far too many hits


def test_saddlepoint_of_equal_weights():
    for stat in (0.5, 4.0, 30.0, 200.0):  # two weights of one: an exponential tail
        assert genetests.weighted_chi2_tail(stat, np.ones(2)) == pytest.approx(math.exp(-stat / 2), rel=0.09)
    assert genetests.weighted_chi2_tail(5.0, np.array([2.0])) == pytest.approx(math.erfc(math.sqrt(1.25)))
    assert 0.2 < genetests.weighted_chi2_tail(3.0, np.ones(3)) < 0.5


def dense_gls(x, y, c):
    i = np.linalg.inv(c)
    b = np.linalg.solve(x.T @ i @ x, x.T @ i @ y)
    e = y - x @ b
    cov = np.linalg.inv(x.T @ i @ x) * float(e @ i @ e) / (len(y) - x.shape[1])
    return b[-1], math.sqrt(cov[-1, -1])


def test_gls_equals_dense_algebra(spark, linked):
    _, genes, variants, held, pairs = linked
    held = held.where(~((F.col("gene") > "g0100") & (F.col("gene") < "g0104") & (F.col("snp") > "s51")))  # genes of other sizes
    stats = genetests.gene_statistics(variants, held, pairs)
    shared = genetests.shared_r2(held, pairs).where("r2 > 1.0")  # leaves gaps, so blocks
    rows = sorted(stats.collect(), key=lambda r: r["gene"])
    table = spark.createDataFrame([(r["gene"], 1, int(r["gene"][1:]), r["nsnps"], r["z"]) for r in rows], "gene string, chr int, gstart int, nsnps long, z double")
    sets = [("A", r["gene"]) for r in rows[::7]] + [("B", r["gene"]) for r in rows[40:90]] + [("C", rows[3]["gene"])]
    got = {r["go"]: r for r in genetests.set_gls(table, spark.createDataFrame(sets + sets[:3], "go string, gene string"), shared).collect()}
    assert set(got) == {"A", "B"}
    at = {r["gene"]: k for k, r in enumerate(rows)}
    s = np.zeros((len(at), len(at)))
    for r in shared.collect():
        s[at[r["gene_a"]], at[r["gene_b"]]] = r["r2"]
    c = 0.95 * np.minimum(1, s / np.sqrt(np.outer(np.diag(s), np.diag(s))))
    np.fill_diagonal(c, 1)
    assert np.linalg.eigvalsh(c)[0] > 0.025
    y, size = np.array([r["z"] for r in rows]), np.log([r["nsnps"] for r in rows])
    for go in "AB":
        member = np.array([float((go, r["gene"]) in sets) for r in rows])
        beta, se = dense_gls(np.stack([np.ones(len(at)), size, member], 1), y, c)
        assert got[go]["beta"] == pytest.approx(beta, rel=1e-6) and got[go]["se"] == pytest.approx(se, rel=1e-6)
        assert got[go]["p"] == pytest.approx(0.5 * math.erfc(beta / se / math.sqrt(2)), rel=1e-6)


def test_level_of_set_test(spark, linked):
    """Sets of neighbouring genes on null data: the test holds its level, a regression that takes genes as independent does not."""
    _, genes, variants, held, pairs = linked
    shared = genetests.shared_r2(held, pairs)
    stats = genetests.gene_statistics(variants, held, pairs).withColumns({"chr": F.lit(1), "gstart": F.substring("gene", 2, 9).cast("int")})
    names = sorted(genes)
    sets = spark.createDataFrame([(f"s{k}", g) for k in range(0, len(names) - 12, 2) for g in names[k : k + 12]], "go string, gene string")
    aware = np.array([r["z"] for r in genetests.set_gls(stats, sets, shared).collect()])
    blind = np.array([r["beta"] / r["se"] for r in geneset.set_regression(stats, sets).collect()])
    assert 0.7 < aware.std() < 1.25 and blind.std() > 1.25
    assert (aware > 1.645).mean() < 0.1


def joined_rows(spark, df):
    """The most rows that a join or an explode of this query puts out."""
    df.collect()
    store = spark._jsparkSession.sharedState().statusStore()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    runs = store.executionsList()
    number = max(runs.apply(i).executionId() for i in range(runs.size()))
    told, nodes, most = store.executionMetrics(number), store.planGraph(number).allNodes(), 0
    for i in range(nodes.size()):
        node = nodes.apply(i)
        for k in range(node.metrics().size()) if "Join" in node.name() or "Generate" in node.name() else ():
            m = node.metrics().apply(k)
            if m.name() == "number of output rows" and (v := told.get(m.accumulatorId())).isDefined():
                most = max(most, int(v.get().replace(",", "")))
    return most


def test_overlapping_genes_do_not_multiply(spark):
    """Fifty genes over the same variants: no row for each gene, gene and pair, nor for each gene and pair in a gene's own sum."""
    n, genes = 40, 50
    held = spark.createDataFrame([(f"g{k}", f"s{i}") for k in range(genes) for i in range(n) if i != k], "gene string, snp string")
    pairs = spark.createDataFrame([(f"s{i}", f"s{j}", 1 / (j - i + 1)) for i in range(n) for j in range(i + 1, n)], "i string, j string, r2 double")
    r2 = 1 / (1 + np.abs(np.subtract.outer(np.arange(n), np.arange(n))))
    inside = {f"g{k}": np.array([i != k for i in range(n)], float) for k in range(genes)}
    shared = genetests.shared_r2(held, pairs)
    got = {(r["gene_a"], r["gene_b"]): r["r2"] for r in shared.collect()}
    assert len(got) == genes * genes
    assert all(v == pytest.approx(inside[a] @ r2 @ inside[b]) for (a, b), v in got.items())
    assert 0 < joined_rows(spark, genetests.shared_r2(held, pairs)) <= 2 * genes * n * (n + genes)
    own = {r["gene"]: r["df"] for r in genetests.gene_statistics(spark.createDataFrame([(f"s{i}", 1.0) for i in range(n)], "snp string, z double"), held, pairs).collect()}
    assert all(v == pytest.approx(inside[g].sum() ** 2 / (inside[g] @ r2 @ inside[g])) for g, v in own.items())

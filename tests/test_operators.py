"""Operators on small hand-made tables: nulls, NaN, ties, missing partners, and property checks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from varloom import schema
from varloom.operators import enrich, figures, harmonize, ld, mixture, models, ranges
from varloom.plans import study

NAN = float("nan")
RESULTS = [
    ("coding_genes", None, 1.0, 0.1, 10.0, 1.0, 100.0, None),
    ("base", None, 1.0, 0.1, 20.0, 1.0, 200.0, None),
    ("GOBP_A", 5, 3.0, 0.3, 2.0, 0.2, 9.0, 4.0),
    ("GOMF_B", 4, 9.0, 0.3, 2.0, 0.2, 9.0, 4.0),
    ("GOCC_C", 7, NAN, 0.3, 2.0, 0.2, 9.0, 1.0),
    ("SYNGO_D", 9, 2.0, 0.3, 2.0, 0.2, 9.0, NAN),
    ("GOBP_P", 9, 5.0, 0.3, 2.0, 0.2, 9.0, 3.0),
    ("GOBP_N", 9, 2.5, 0.3, 2.0, 0.2, 9.0, 2.0),
    ("GOBP_A_excl_G2", 4, 1.5, 0.1, 1.0, 0.1, 5.0, None),
    ("GOBP_A_excl_G1", 4, 1.5, 0.2, 1.0, 0.1, 5.0, None),
    ("GOBP_A_excl_G3", 4, NAN, 0.2, 1.0, 0.1, 5.0, None),
    ("SYNGO_D_excl_G9", 8, None, 0.2, 1.0, 0.1, 5.0, None),
    ("GENE7", 1, 4.0, 0.4, 0.5, 0.1, 1.0, 6.0),
    ("GENE8", 1, 4.0, 0.4, 0.5, 0.1, 1.0, -6.0),
    ("aXexclXb", 1, 4.0, 0.4, 0.5, 0.1, 1.0, 7.0),
]
SCHEMA = "GO string, NGENES long, enrich double, enrich_std double, h2 double, h2_std double, h2_base double, loglike_aic double, snps long"


@pytest.fixture(scope="module")
def tables(spark):
    results = spark.createDataFrame([(*r, 1) for r in RESULTS], SCHEMA)
    sets = spark.createDataFrame([("GOBP_A", 1e-4), ("GOBP_N", 1e-4), ("SYNGO_D", NAN), ("GOBP_P", 0.2), ("GOBP_P", 0.3), ("OTHER", 0.5)], "FULL_NAME string, P double")
    genes = spark.createDataFrame([(7, 0.01)], "GENE long, P double").select(F.concat(F.lit("GENE"), "GENE").alias("GENE"), "P")
    prune = spark.createDataFrame([("GOBP_N",)], "GOBP_P string")
    return results, sets, genes, prune


def test_classes(spark, tables):
    c = {r["go"]: (r["class"], r["set_go"], r["excl_gene"]) for r in enrich.classify(enrich.ingest(tables[0])).collect()}
    assert c["base"][0] == "whole" and c["GOBP_A"][0] == "set" and c["GOMF_B"][0] == "set" and c["aXexclXb"][0] == "gene"
    assert c["GOBP_A_excl_G2"] == ("loo", "GOBP_A", "G2")


def test_tables(spark, tables):
    results, sets, genes, prune = tables
    t = enrich.build(results, sets, genes, prune)
    got = {r["go"]: r for r in t.sets.collect()}
    assert "GOMF_B" not in got and "GOBP_N" not in got  # too few genes; pruned
    assert (got["GOBP_A"]["excl_gene"], got["GOBP_A"]["excl_enrich"], got["GOBP_A"]["gene_list"]) == ("G1", 1.5, "G1 G2 G3")
    assert (got["SYNGO_D"]["excl_gene"], got["SYNGO_D"]["gene_list"]) == (None, "G9") and got["GOCC_C"]["gene_list"] is None
    assert got["GOBP_A"]["h2_frac"] == 0.2 and got["GOBP_A"]["se_h2_frac"] == pytest.approx(0.02) and got["GOBP_A"]["h2_base_frac"] == 0.09
    assert t.sets.where("go = 'GOBP_P'").count() == 2  # repeated names fan out
    legacy = enrich.build(results, sets, genes, prune, legacy_prune=True)
    names = {r["go"] for r in legacy.sets.collect()}
    assert "GOBP_N" in names and "GOBP_P" not in names  # the heading is compared, not the values
    assert t.n_names.first()["n"] == 5


def test_reports(spark, tables):
    results, sets, genes, _ = tables
    t = enrich.build(results, sets, genes)
    st5 = enrich.report_st5(t)
    assert [(r["go"], r["magma_rank"]) for r in st5.collect()] == [("GOBP_A", 1), ("GOBP_N", 2)]
    assert not {"h2", "se_h2", "model_aic"} & set(st5.columns) and st5.columns[:4] == ["go", "ngenes", "enrich", "se_enrich"]
    st7 = [r["go"] for r in enrich.report_st7(t).collect()]
    assert st7 == ["GOBP_P", "GOBP_P", "GOBP_A", "GOBP_N", "GOCC_C"]  # NaN AIC fails, NaN enrichment is last
    st9 = enrich.report_st9(t)
    assert [r["gene"] for r in st9.collect()] == ["aXexclXb", "GENE7"] and "ngenes" not in st9.columns and {"h2", "se_h2"} <= set(st9.columns)
    assert [r["magma_p"] for r in t.genes.where("gene = 'GENE7'").collect()] == [0.01]
    shown = enrich.format_report(enrich.report_st7(t)).collect()
    assert shown[0]["enrich"] == "5.00" and shown[-1]["enrich"] == "" and shown[0]["ngenes"] == "9"


def test_significance_columns(spark):
    df = enrich.ingest(spark.createDataFrame([("GENE1", 0.5, 0.01, 0.2)], "GO string, TOOL_P double, TOOL_FDR double, MAGMA_P double"))
    assert df.columns == ["go", "model_p", "model_fdr", "magma_p"]
    assert enrich.format_report(df).first()["model_p"] == "5.00e-01"


def test_fractions_need_their_row(spark, tables):
    lost = enrich.ingest(tables[0]).where("go <> 'coding_genes'")
    with pytest.raises(Exception, match="coding_genes"):
        enrich.h2_fractions(lost).collect()


def test_headers(spark):
    df = spark.createDataFrame([("rs1", 1, "a", "g", 10.0, 1.0)], "rsid string, Pos long, effectALLELE string, OTHERallele string, n double, Z double")
    assert schema.resolve_headers(df).columns == ["SNP", "BP", "A1", "A2", "N", "Z"]
    with pytest.raises(ValueError, match="more than one"):
        schema.resolve_headers(df.withColumn("snp", F.lit("x")))
    with pytest.raises(ValueError, match="missing"):
        schema.resolve_headers(df.drop("Z"))
    with pytest.raises(ValueError, match="needs SNP"):
        schema.resolve_headers(df.drop("rsid"))


def test_matching_and_counters(spark):
    ref = spark.createDataFrame([("rs1", 1, 100, "A", "G"), ("rs2", 1, 200, "C", "T"), ("rs3", 2, 300, "A", "T"), ("rs4", 2, 400, "G", "T")], "snp string, chr int, bp long, a1 string, a2 string")
    lines = [
        ("t", "rs1", 1, 100, "A", "G", 5.0, 1.0),  # as it is
        ("t", "rs2", 1, 200, "T", "C", 5.0, 2.0),  # swapped
        ("t", "x", 1, 100, "C", "T", 5.0, 3.0),  # by position: other strand, swapped
        ("t", "y", 1, 200, "G", "A", 5.0, 4.0),  # by position: other strand
        ("t", "rs3", 2, 300, "A", "T", 5.0, 5.0),  # ambiguous
        ("t", "rs4", 2, 400, "G", "C", 5.0, 6.0),  # other alleles
        ("t", "z", 9, 900, "A", "G", 5.0, 7.0),  # not in the panel
        ("t", "rs4", 2, 400, "G", "T", None, 8.0),  # no N
        ("t", "rs4", 2, 400, "G", "T", 5.0, NAN),  # no Z
    ]
    s = spark.createDataFrame(lines, "trait string, snp string, chr int, bp long, a1 string, a2 string, n double, z double")
    m = harmonize.match_reference(s, ref)
    got = {r["snp"]: (r["ref_snp"], r["by"], r["swapped"], r["z_ref"]) for r in m.where("z < 5").collect()}
    assert got == {"rs1": ("rs1", "name", False, 1.0), "rs2": ("rs2", "name", True, -2.0), "x": ("rs1", "position", True, -3.0), "y": ("rs2", "position", False, 4.0)}
    c = harmonize.match_counters(m).first().asDict()
    assert c == {"trait": "t", "lines": 9, "undefined": 2, "unmatched": 1, "mismatched": 1, "ambiguous": 1, "kept": 4, "swapped": 2}
    assert c["lines"] - c["undefined"] - c["unmatched"] - c["mismatched"] - c["ambiguous"] == c["kept"] == harmonize.usable(m).count()


def test_interval_and_window_joins(spark):
    rng = random.Random(2)
    pts = [(f"s{i}", rng.randrange(1, 3), rng.randrange(0, 5_000_000)) for i in range(200)]
    ivs = [(f"g{i}", rng.randrange(1, 3), a, a + rng.randrange(0, 2_500_000)) for i in range(20) for a in [rng.randrange(0, 5_000_000)]]
    p = spark.createDataFrame(pts, "snp string, chr int, bp long")
    g = spark.createDataFrame(ivs, "gene string, chr int, gstart long, gend long")
    want = sorted((s, x) for s, c, b in pts for x, d, lo, hi in ivs if c == d and lo - 10_000 <= b <= hi + 10_000)
    assert sorted((r["snp"], r["gene"]) for r in ranges.interval_join(p, g, flank=10_000).collect()) == want
    out = {r["snp"] for r in ranges.anti_interval_join(p, g).collect()}
    assert out == {s for s, c, b in pts if not any(c == d and lo <= b <= hi for _, d, lo, hi in ivs)}
    pairs = {(r["a"]["snp"], r["b"]["snp"]) for r in ranges.window_pairs(p, 50_000, "bp", "chr").collect()}
    assert pairs == {(a[0], b[0]) for a in pts for b in pts if a[1] == b[1] and 0 < b[2] - a[2] <= 50_000}


def test_interval_join_spreads_its_rows_over_tasks_whatever_the_files(spark, tmp_path):
    """One file a side, small enough to broadcast: the task that reads it must not make all pairs."""
    spark.createDataFrame([(f"s{i}", 1 + i % 3, i * 5_000) for i in range(2_000)], "snp string, chr int, bp long").coalesce(1).write.parquet(f"{tmp_path}/p")
    spark.createDataFrame([(f"g{i}", 1 + i % 3, i * 50_000, i * 50_000 + 500_000) for i in range(200)], "gene string, chr int, gstart long, gend long").coalesce(1).write.parquet(f"{tmp_path}/g")
    p, g = spark.read.parquet(f"{tmp_path}/p"), spark.read.parquet(f"{tmp_path}/g")
    want = sorted((f"s{i}", f"g{j}") for i in range(2_000) for j in range(200) if i % 3 == j % 3 and j * 50_000 - 10_000 <= i * 5_000 <= j * 50_000 + 510_000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # tables of this size would be put together again
    try:
        got = ranges.interval_join(p, g, flank=10_000).select("snp", "gene", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r["snp"], r["gene"]) for r in got) == want
    tasks = [r["task"] for r in got]
    assert max(tasks.count(t) for t in set(tasks)) < len(want) / 2


def test_ld_and_prune(spark):
    rng = random.Random(3)
    e = [(i, [rng.gauss(0, 1) + (i // 5) * (j % 3) for j in range(8)]) for i in range(80)]
    df = spark.createDataFrame(e, "vec_id long, embedding array<double>")
    pairs = ld.ld_pairs(df, 10, 0.3)
    got = {(r["i"], r["j"]): r["r2"] for r in pairs.collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    want = {(i, j): dot(a, b) ** 2 / (dot(a, a) * dot(b, b)) for i, a in e for j, b in e if 0 < j - i <= 10}
    want = {k: v for k, v in want.items() if v >= 0.3}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    score = {r["i"]: r["ld_score"] for r in ld.ld_score(pairs).collect()}
    assert all(math.isclose(score[i], sum(v for k, v in want.items() if i in k)) for i in score)
    for seed in (1, 2):
        kept = {r["vec_id"] for r in ld.random_prune(df, pairs, 0.5, seed=seed).collect()}
        strong = {k for k, v in want.items() if v >= 0.5}
        assert not any(i in kept and j in kept for i, j in strong)
        assert all(v in kept or any((v in k) and (set(k) - {v}) & kept for k in strong) for v in range(80))
    assert ld.prune_replicates(df, pairs, 0.5, replicates=2).groupBy("rep").count().count() == 2
    assert ld.random_prune(df, pairs, 0.5, n=20).count() <= 20


def test_bed_codes():
    body = bytes([0b11_10_01_00, 0b00_00_00_10])
    assert ld.decode_bed(body, 5) == [[2, None, 1, 0, 1]]


def test_model_documents(spark):
    text = '{"options":{"sum_weights":1000.0,"totalhet":5.0,"num_snp":7},"params":{"pi":0.1},"optimize":[["a",{"fun":1}],["b",{"fun":2}],["brute1",{"grid":[1,2,3],"Jout":[30.5,10.25,20.0],"fun":10.25}],["brent1",{"fun":9.5}]]}'
    df = models.parse(spark.createDataFrame([("t", text)], "trait string, json string"))
    r = models.criteria(models.costs(df)).first()
    assert (r["cost_min"], r["cost_max"], r["cost_best"], r["offset"], r["n"]) == (30.5, 20.0, 9.5, 9.5, 1000.0)
    assert r["best_vs_min_aic"] == -2 + 2 * 21.0 and math.isclose(r["best_vs_max_bic"], -math.log(1000) + 2 * 10.5)
    assert [(x["x"], x["cost"]) for x in models.likelihood_curve(df, "trait").collect()] == [(1.0, 20.25), (2.0, 0.0), (3.0, 9.75)]
    assert [x["name"] for x in models.steps(df, "trait").collect()] == ["a", "b", "brute1", "brent1"]


def test_combine(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "t string, x double")
    got = {r["t"]: (r["x (mean)"], r["x (std)"]) for r in models.combine(df, ["t"], ["x"]).collect()}
    assert got["a"] == (2.0, pytest.approx(2**0.5)) and got["b"] == (5.0, None)


def test_figures(spark):
    p = [0.9, 0.5, 0.05, 0.05, 0.001, 0.0, None]
    out = figures.qq_data(spark.createDataFrame([(x,) for x in p], "p double")).orderBy("observed").collect()
    assert [(r["observed"], r["n"], r["n_at_least"]) for r in out] == [(0.0, 1, 5), (0.3, 1, 4), (1.3, 2, 3), (3.0, 1, 1)]
    g = figures.density_grid(spark.createDataFrame([(0.1, 0.1), (99.0, -99.0), (None, 1.0)], "x double, y double"), "x", "y").collect()
    assert sorted((r["ix"], r["iy"], r["share"]) for r in g) == [(10, 10, 0.5), (19, 0, 0.5)]
    power = figures.power_curve(spark.createDataFrame([(1e-4,)], "sig2_beta double")).orderBy("size").collect()
    shares = [r["share"] for r in power]
    assert shares == sorted(shares) and 0 <= shares[0] < shares[-1] <= 1


def test_study_order():
    primary, secondary = {"SCZ": "scz.gz", "ALSO": "int.gz"}, {"INT": "int.gz", "BIP": "bip.gz"}
    assert study.pairs(primary, secondary) == [("SCZ", "INT"), ("SCZ", "BIP"), ("ALSO", "BIP")]
    steps = study.study(primary, secondary)
    seen = set()
    for s in steps:
        assert set(s.needs) <= seen or s.kind == "two"
        seen.add(s.name)
    w = study.waves(steps)
    at = {s.name: i for i, x in enumerate(w) for s in x}
    assert all(at[n] < at[s.name] for s in steps for n in s.needs)
    assert study.merge({"a": "1"}, {"a": "2"}) == {"a": "2"}
    with pytest.raises(ValueError):
        study.waves([study.Step("x", ("a",), ("never",))])


def test_fits_recover_simulated_parameters(spark):
    rng = random.Random(5)
    n, pi, sb, s0 = 1000.0, 0.2, 0.01, 1.1
    z = [rng.gauss(0, math.sqrt(s0 + (n * sb if rng.random() < pi else 0))) for _ in range(6000)]
    r = mixture.fit_univariate(spark.createDataFrame([(x, n) for x in z], "z double, n double")).first()
    assert 0.12 < r["pi"] < 0.3 and 0.006 < r["sig2_beta"] < 0.016 and 1.0 < r["sig2_zero"] < 1.2 and r["aic"] > 0
    post = mixture.apply_univariate(spark.createDataFrame([(0.0, n), (9.0, n)], "z double, n double"), r.asDict()).collect()
    assert post[0]["posterior"] < 0.2 < 0.9 < post[1]["posterior"]
    one = {"pi": 0.2, "sig2_beta": 0.01, "sig2_zero": 1.0}
    rows = []
    for _ in range(6000):
        u = rng.random()
        b = (0.0, 0.0)
        if u < 0.12:  # shared, correlated
            x = rng.gauss(0, 1)
            b = (x, 0.8 * x + 0.6 * rng.gauss(0, 1))
        elif u < 0.2:
            b = (rng.gauss(0, 1), 0.0)
        elif u < 0.28:
            b = (0.0, rng.gauss(0, 1))
        rows.append((b[0] * math.sqrt(n * 0.01) + rng.gauss(0, 1), b[1] * math.sqrt(n * 0.01) + rng.gauss(0, 1), n, n))
    f = mixture.fit_bivariate(spark.createDataFrame(rows, "z1 double, z2 double, n1 double, n2 double"), one, one).first()
    assert 0.06 < f["pi12"] <= 0.2 and 0.5 < f["rho_beta"] < 0.99 and abs(f["rho_zero"]) < 0.15
    assert f["cost"] <= min(f["cost_min"], f["cost_max"]) + 1e-6


def test_random_subset_is_stable(spark):
    df = spark.range(1000).select(F.concat(F.lit("rs"), "id").alias("snp"))
    a = {r["snp"] for r in harmonize.random_subset(df.repartition(7), 50, 3).collect()}
    b = {r["snp"] for r in harmonize.random_subset(df.repartition(2), 50, 3).collect()}
    assert a == b and len(a) == 50 and a != {r["snp"] for r in harmonize.random_subset(df, 50, 4).collect()}


def test_set_heritability(spark):
    v = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 4.0)], "snp string, h2 double, h2_base double")
    m = spark.createDataFrame([("coding_genes", "a"), ("coding_genes", "b"), ("s", "b"), ("s", "b"), ("s", "zz")], "go string, snp string")
    got = {r["go"]: (r["snps"], r["h2"], r["enrich"]) for r in enrich.set_heritability(v, m).collect()}
    assert got["s"] == (1, 3.0, pytest.approx((3 / 4) / (4 / 6))) and got["coding_genes"][2] == 1.0




def test_gene_set_analysis(spark):
    from varloom.operators import geneset, simulate

    rng = random.Random(8)
    rows = [(f"s{i}", i % 4, rng.gauss(0, 2.0 if i < 60 else 1.0), 100.0) for i in range(300)]
    genes = [(f"G{i // 20}", f"s{i}") for i in range(300)] + [("G1", "s5")]
    sets = [("GOBP_hot", g) for g in ("G0", "G1", "G2")] + [("GOBP_cold", g) for g in ("G10", "G11")] + [("GOBP_rest", f"G{i}") for i in range(15)]
    f = lambda x, s: spark.createDataFrame(x, s)
    inputs = geneset.fit_inputs(f(rows, "snp string, chr int, z double, n double"), f(genes, "gene string, snp string"), f(sets, "go string, gene string"))
    got = {r["go"]: r for r in geneset.analyse(inputs).collect()}
    z2 = [r[2] ** 2 for r in rows]
    base = sum(z2) / 300
    hot = z2[:60]
    assert got["GOBP_hot"]["snps"] == 60 and got["GOBP_hot"]["ngenes"] == 3
    assert got["GOBP_hot"]["h2"] == pytest.approx(sum(x - 1 for x in hot) / 100)
    assert got["GOBP_hot"]["h2_base"] == pytest.approx((base - 1) * 0.6)
    own = sum(hot) / 60
    assert got["GOBP_hot"]["loglike_diff"] == pytest.approx(-30 * (math.log(own / base) + 1 - own / base)) and got["GOBP_hot"]["loglike_aic"] > 0 > got["GOBP_rest"]["loglike_aic"]
    left = [x for i, x in enumerate(z2[:60]) if not 20 <= i < 40]  # s5 is also in G0, so only G1's own variants go
    assert got["GOBP_hot_excl_G1"]["h2"] == pytest.approx(sum(x - 1 for x in left) / 100) and got["GOBP_hot_excl_G1"]["ngenes"] == 2
    assert got["coding_genes"]["enrich"] == pytest.approx(1.0) and got["GOBP_hot"]["se_enrich"] > 0
    tables = enrich.build(geneset.analyse(inputs), f([("GOBP_hot", 0.001)], "FULL_NAME string, P double"), f([("G0", 0.1)], "GENE string, P double"))
    assert {r["go"] for r in tables.sets.collect()} == {"GOBP_rest"}  # the others have fewer than five genes
    sim = simulate.two_traits(spark, 4000, 1e4, 0.1, 0.1, 0.5, rho=0.9, seed=3)
    part = {r["part"]: r["n"] for r in sim.groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert 120 < part["both"] < 280 and sim.where("part = 'both'").agg(F.corr("z1", "z2")).first()[0] > 0.6


def test_qc_and_neff(spark):
    df = spark.createDataFrame([("6", 30_000_000, 1.0, 0.9, 0.5), ("1", 5, 1.5, 0.9, 0.5), ("1", 5, 1.0, 0.5, 0.5), ("1", 5, 1.0, 0.9, 0.99), ("1", 5, 1.0, 0.9, 0.5), ("1", 5, None, 0.9, 0.5)], "CHR string, BP long, OR double, INFO double, MAF double")
    assert harmonize.qc(df, ranges.parse_ranges("MHC"), max_or=1.2, least_info=0.8, least_maf=0.05).count() == 1
    n = harmonize.with_neff(spark.createDataFrame([(40675.0, 64643.0), (0.0, 1.0)], "NCASE double, NCONTROL double"), drop=True).collect()
    assert math.isclose(n[0]["N"], 99863.42410604075) and n[1]["N"] is None

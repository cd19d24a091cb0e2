"""The commands end to end on small simulated files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from varloom import commands
from varloom.operators import simulate
from varloom.sources import readers, sinks


@pytest.fixture(scope="module")
def study(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("study")
    sim = simulate.two_traits(spark, 6000, 2e4, 0.1, 0.1, 0.8, h2=0.6, rho=0.8, seed=5)
    base = sim.select(F.col("snp").alias("SNP"), F.col("chr").cast("string").alias("CHR"), (F.col("bp") * 20).alias("BP"), F.lit("A").alias("A1"), F.lit("G").alias("A2"), F.col("n").alias("N"), "z1", "z2")
    sinks.write_tsv(base.withColumnRenamed("z1", "Z"), str(d / "t1"), ["SNP", "CHR", "BP", "A1", "A2", "N", "Z"], files=1)
    flipped = base.withColumns({"A1": F.lit("G"), "A2": F.lit("A"), "Z": -F.col("z2")})
    sinks.write_tsv(flipped, str(d / "t2"), ["SNP", "CHR", "BP", "A1", "A2", "N", "Z"], files=1)
    return d


def test_fits_and_reports(spark, study):
    d = str(study)
    for t in ("t1", "t2"):
        commands.fit1(spark, f"{d}/{t}", f"{d}/{t}.fit.rep1.json", exclude_ranges="")
        commands.test1(spark, f"{d}/{t}", f"{d}/{t}.fit.rep1.json", f"{d}/{t}.test", exclude_ranges="[]")
        assert spark.read.parquet(f"{d}/{t}.test").where("posterior between 0 and 1").count() == 6000
    params = json.loads(spark.read.text(f"{d}/t1.fit.rep1.json").first()[0])["params"]
    assert 0.04 < params["pi"] < 0.25
    commands.fit2(spark, f"{d}/t1", f"{d}/t2", f"{d}/t1.fit.rep1.json", f"{d}/t2.fit.rep1.json", f"{d}/p.fit.rep1.json", exclude_ranges="")
    commands.test2(spark, f"{d}/t1", f"{d}/t2", f"{d}/t1.fit.rep1.json", f"{d}/t2.fit.rep1.json", f"{d}/p.fit.rep1.json", f"{d}/p.test", exclude_ranges="")
    assert spark.read.parquet(f"{d}/p.test").count() == 6000
    commands.one(spark, f"{d}/t1.fit.rep1.json", "T1", f"{d}/one")
    commands.two(spark, f"{d}/p.fit.rep1.json", "T1", "T2", f"{d}/two")
    one, two = readers.tsv(spark, f"{d}/one").first(), readers.tsv(spark, f"{d}/two").first()
    assert float(one["pi (mean)"]) == pytest.approx(params["pi"])
    assert float(two["rho_beta (mean)"]) > 0.4 and float(two["rg (mean)"]) > 0.2 and float(two["best_vs_min_AIC"]) > -10
    commands.combine(spark, f"{d}/t1.fit.rep@.json", f"{d}/all")
    assert spark.read.parquet(f"{d}/all").count() == 1
    commands.qq(spark, f"{d}/t1", f"{d}/qq")
    assert spark.read.parquet(f"{d}/qq").count() > 5


def test_gene_sets(spark, study):
    d = str(study)
    (study / "gene.loc").write_text("".join(f"G{i} {i % 22 + 1} {i * 300_000} {i * 300_000 + 3_000_000}\n" for i in range(40)))
    (study / "go.csv").write_text("GO\tGENE\tCHR\tFROM\tTO\n" + "".join(f"GOBP_{s}\tG{i}\t1\t0\t1\n" for s in "AB" for i in range(40) if i % 2 == (s == "A")))
    commands.plsa(spark, f"{d}/t1", f"{d}/gene.loc", f"{d}/go.csv", f"{d}/enrich", exclude_ranges="")
    table = readers.enrichment(spark, f"{d}/enrich")
    assert {"coding_genes", "GOBP_A", "GOBP_B", "G3"} <= {r["GO"] for r in table.collect()}
    (study / "m.gsa.out").write_text("# head\nVARIABLE P FULL_NAME\nx 0.001 GOBP_A\ny 0.9 GOBP_B\n")
    (study / "m.genes.out").write_text("GENE P\nG3 0.01\n")
    commands.gsa_tables(spark, f"{d}/enrich", f"{d}/m.gsa.out", f"{d}/m.genes.out", f"{d}/book")
    st5 = readers.tsv(spark, f"{d}/book/ST5").collect()
    assert [r["go"] for r in st5] == ["GOBP_A"] and st5[0]["magma_rank"] == "1" and st5[0]["magma_p"] == "1.00e-03" and st5[0]["gene_list"].startswith("G1 G11")
    (study / "snp.loc").write_text("".join(f"rs{i} {i % 22 + 1} {i * 20_000}\n" for i in range(600)))
    (study / "p.txt").write_text("RSID P N\n" + "".join(f"rs{i} 0.05 100\n" for i in range(600)))
    commands.magma_annotate(spark, f"{d}/snp.loc", f"{d}/gene.loc", f"{d}/annot")
    commands.magma_gene(spark, f"{d}/p.txt", f"{d}/annot", f"{d}/genes")
    assert all(float(r["MEAN_CHI2"]) == pytest.approx(3.8414588) for r in readers.tsv(spark, f"{d}/genes").collect())


def test_ld_and_lists(spark, tmp_path):
    rng = random.Random(1)
    n = 40
    first = [rng.randrange(3) for _ in range(n)]
    variants = [first, first, [rng.randrange(3) for _ in range(n)], [2 - g for g in first]]
    code = {2: 0, 1: 2, 0: 3}
    body = bytearray(b"\x6c\x1b\x01")
    for g in variants:
        for at in range(0, n, 4):
            body.append(sum(code[x] << (2 * k) for k, x in enumerate(g[at : at + 4])))
    (tmp_path / "r.chr21.bed").write_bytes(bytes(body))
    (tmp_path / "r.chr21.bim").write_text("".join(f"21\trs{i}\t0\t{1000 * (i + 1)}\tA\tG\n" for i in range(4)))
    (tmp_path / "r.chr21.fam").write_text("".join(f"f{i} i{i} 0 0 1 -9\n" for i in range(n)))
    commands.ld(spark, f"{tmp_path}/r.chr@", f"{tmp_path}/ld", chr2use="21", r2min=0.5)
    pairs = {(r["i"], r["j"]): r["r2"] for r in readers.library(spark, f"{tmp_path}/ld/pairs", [21]).collect()}
    assert {("rs0", "rs1"), ("rs0", "rs3"), ("rs1", "rs3")} <= set(pairs) and all(pairs[k] == pytest.approx(1.0) for k in (("rs0", "rs1"), ("rs0", "rs3")))
    commands.snps(spark, f"{tmp_path}/ld", f"{tmp_path}/lists", r2=0.5, maf=0.01, subset=100, replicates=2)
    for rep in (1, 2):
        kept = {r["value"] for r in spark.read.text(f"{tmp_path}/lists/rep={rep}").collect()}
        assert "rs2" in kept and len(kept & {"rs0", "rs1", "rs3"}) == 1


def test_process_and_split(spark, tmp_path):
    (tmp_path / "raw.txt").write_text("SNP Freq.A1 CHR BP A1 A2 OR SE P\n10:100968448:T:AA 0.3 10 100968448 t aa 1.0024 0.01 0.812\nrs2 0.3 10 5 a g 0.98906 0.01 0.2585\nrs3 0.3 6 30000000 a g 1.1 0.01 0.5\nrs4 0.3 X 30 a g 1.1 0.01 0.5\n")
    commands.process_sumstats(spark, f"{tmp_path}/raw.txt", f"{tmp_path}/clean", cases=40675, controls=64643)
    got = readers.sumstats(spark, f"{tmp_path}/clean").orderBy("BP").collect()
    assert [(r["SNP"], r["A1"], r["A2"]) for r in got] == [("rs2", "A", "G"), ("10:100968448:T:AA", "T", "AA")]
    assert got[1]["Z"] == pytest.approx(0.23784669541774933, rel=1e-12) and got[1]["N"] == pytest.approx(99863.42410604075, rel=1e-12)
    commands.split_sumstats(spark, f"{tmp_path}/clean", f"{tmp_path}/by", "10")
    assert spark.read.parquet(f"{tmp_path}/by").where("CHR = 10").count() == 2

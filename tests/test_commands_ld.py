"""The commands that fit and test under LD, from files to files."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom import commands
from varloom.sources import readers, sinks

WIDTH, BLOCKS, N = 20, 60, 5000.0


@pytest.fixture(scope="module")
def study(spark, tmp_path_factory):
    """60 blocks of 20 linked variants; genes are blocks, those of even number have effects."""
    d = tmp_path_factory.mktemp("ldstudy")
    rng = np.random.default_rng(6)
    r = 0.85 ** np.abs(np.subtract.outer(np.arange(WIDTH), np.arange(WIDTH)))
    root, rows = np.linalg.cholesky(r), []
    for b in range(BLOCKS):
        z = []
        for _ in range(2):
            beta = rng.normal(size=WIDTH) * math.sqrt(0.004) * (b % 2 == 0) * (rng.random(WIDTH) < 0.3)
            z.append(math.sqrt(N * 0.5) * r @ beta + root @ rng.normal(size=WIDTH))
        rows += [(f"rs{b * WIDTH + i}", b % 2 + 1, (b * 1000 + i + 1) * 1000, "A", "G", N, float(z[0][i]), float(z[1][i])) for i in range(WIDTH)]
    df = spark.createDataFrame(rows, "SNP string, CHR int, BP long, A1 string, A2 string, N double, z1 double, z2 double")
    for k in (1, 2):
        sinks.write_tsv(df.withColumn("Z", F.col(f"z{k}")), f"{d}/t{k}", ["SNP", "CHR", "BP", "A1", "A2", "N", "Z"], files=1)
    pairs = [(f"rs{b * WIDTH + i}", f"rs{b * WIDTH + j}", float(r[i, j] ** 2), b % 2 + 1) for b in range(BLOCKS) for i in range(WIDTH) for j in range(i + 1, WIDTH) if r[i, j] ** 2 > 0.02]
    sinks.write_library(spark.createDataFrame(pairs, "i string, j string, r2 double, chr int"), f"{d}/ld/pairs")
    df.select(F.col("CHR").alias("chr"), F.col("SNP").alias("snp"), F.lit(0.5).alias("maf"), F.lit(1.0).alias("ld_score")).write.partitionBy("chr").parquet(f"{d}/ld/scores")
    (d / "gene.loc").write_text("".join(f"G{b} {b % 2 + 1} {b * 1000 * 1000 + 1} {(b * 1000 + WIDTH) * 1000}\n" for b in range(BLOCKS)))
    (d / "go.csv").write_text("GO\tGENE\tCHR\tFROM\tTO\n" + "".join(f"{'EVEN' if b % 2 == 0 else 'ODD'}\tG{b}\t1\t0\t1\n" for b in range(BLOCKS)))
    return str(d)


def test_gene_set_study(spark, study):
    d = study
    commands.plsa_ld(spark, f"{d}/t1", f"{d}/ld", f"{d}/base", gene_loc=f"{d}/gene.loc", exclude_ranges="", gsa_base=True, adam_epoch=(6,), adam_step=(0.3,))
    base = json.loads(spark.read.text(f"{d}/base").first()[0])
    assert set(base["params"]) == {"base", "coding_genes", "sig2_zero"}
    assert base["optimize"][0][1]["Jout"] == sorted(base["optimize"][0][1]["Jout"], reverse=True)
    commands.plsa_ld(spark, f"{d}/t1", f"{d}/ld", f"{d}/full", gene_loc=f"{d}/gene.loc", go_file_test=f"{d}/go.csv", exclude_ranges="", load_params=f"{d}/base", adam_epoch=(12,), adam_step=(0.4,))
    h2 = {r["category"]: r for r in spark.read.parquet(f"{d}/full/heritability").collect()}
    assert h2["EVEN"]["snps"] == h2["ODD"]["snps"] == BLOCKS * WIDTH // 2 and h2["EVEN"]["enrich"] > 1.3 > 0.7 > h2["ODD"]["enrich"]
    assert h2["EVEN"]["h2"] + h2["ODD"]["h2"] == pytest.approx(h2["base"]["h2"])


def test_gene_tests(spark, study):
    d = study
    df = readers.sumstats(spark, f"{d}/t1")
    from varloom.functions.normal import upper_tail

    lines = df.select(F.concat_ws(" ", "SNP", F.format_string("%.10e", 2 * upper_tail(F.abs("Z"))), "N")).collect()
    with open(f"{d}/p.txt", "w") as f:
        f.write("RSID P N\n" + "".join(r[0] + "\n" for r in lines))
    with open(f"{d}/sets.txt", "w") as f:
        f.write("EVEN " + " ".join(f"G{b}" for b in range(0, BLOCKS, 2)) + "\nSOME " + " ".join(f"G{b}" for b in range(0, BLOCKS, 3)) + "\n")
    with open(f"{d}/snp.loc", "w") as f:
        f.write("".join(f"{r['SNP']} {r['CHR']} {r['BP']}\n" for r in df.collect()))
    commands.magma_annotate(spark, f"{d}/snp.loc", f"{d}/gene.loc", f"{d}/annot", window_kb=0)
    commands.magma_gene(spark, f"{d}/p.txt", f"{d}/annot", f"{d}/genes", pairs=f"{d}/ld/pairs")
    genes = {r["GENE"]: r for r in readers.tsv(spark, f"{d}/genes").collect()}
    want = {r["gene"]: r["m"] for r in df.select((F.floor((F.regexp_extract("SNP", r"\d+", 0).cast("int")) / WIDTH)).alias("b"), "Z").groupBy(F.concat(F.lit("G"), "b").alias("gene")).agg(F.avg(F.col("Z") ** 2).alias("m")).collect()}
    assert {g: float(r["MEAN_CHI2"]) for g, r in genes.items()} == pytest.approx(want, rel=1e-6)
    commands.magma_sets(spark, f"{d}/genes", f"{d}/sets.txt", f"{d}/sets", gene_loc=f"{d}/gene.loc")
    sets = {r["FULL_NAME"]: r for r in readers.tsv(spark, f"{d}/sets").collect()}
    assert float(sets["EVEN"]["P"]) < 1e-3 < float(sets["SOME"]["P"]) and sets["EVEN"]["NGENES"] == "30"


def test_fits(spark, study):
    d = study
    with open(f"{d}/list.snps", "w") as f:
        f.write("".join(f"rs{i}\n" for i in range(0, BLOCKS * WIDTH, 8)))
    commands.fit1(spark, f"{d}/t1", f"{d}/t1.fit", extract=f"{d}/list.snps", exclude_ranges="", ld_out=f"{d}/ld", fit_sequence=("neldermead-fast",))
    one = json.loads(spark.read.text(f"{d}/t1.fit").first()[0])
    assert one["optimize"][-1][1]["success"] and one["options"]["num_snp"] == BLOCKS * WIDTH and one["options"]["totalhet"] == pytest.approx(0.5 * BLOCKS * WIDTH)
    assert 0.03 < one["params"]["pi"] < 0.6 and 0.001 < one["params"]["sig2_beta"] < 0.02
    commands.test1(spark, f"{d}/t1", f"{d}/t1.fit", f"{d}/t1.test", exclude_ranges="", ld_out=f"{d}/ld")
    assert spark.read.parquet(f"{d}/t1.test").where("posterior between 0 and 1 and cost > 0").count() > 0.95 * BLOCKS * WIDTH
    commands.fit2(spark, f"{d}/t1", f"{d}/t2", f"{d}/t1.fit", f"{d}/t1.fit", f"{d}/p.fit", extract=f"{d}/list.snps", exclude_ranges="", ld_out=f"{d}/ld", points=5)
    both = json.loads(spark.read.text(f"{d}/p.fit").first()[0])
    name, curve = both["optimize"][2]
    assert name == "brute1" and len(curve["grid"]) == len(curve["Jout"]) == 5 and curve["grid"] == sorted(curve["grid"])
    assert both["optimize"][-1][1]["fun"] <= min(curve["Jout"]) and 0 < both["params"]["pi12"] <= min(both["params"]["pi1u"], both["params"]["pi2u"])
    commands.test2(spark, f"{d}/t1", f"{d}/t2", f"{d}/t1.fit", f"{d}/t1.fit", f"{d}/p.fit", f"{d}/p.test", exclude_ranges="", ld_out=f"{d}/ld")
    assert spark.read.parquet(f"{d}/p.test").where("cost is not null").count() == BLOCKS * WIDTH

"""Workbooks, headings, headers by file, genotype files by ranges, gene statistics, base and full analysis."""

import json
import math
import xml.etree.ElementTree as ET
import zipfile

import pytest
from pyspark.sql import functions as F

from varloom import commands, schema
from varloom.operators import enrich, geneset, ld
from varloom.sources import readers, sinks

NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet(path, i):
    with zipfile.ZipFile(path) as z:
        root = ET.fromstring(z.read(f"xl/worksheets/sheet{i}.xml"))
        names = [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{NS}sheet")]
    rows = [["".join(t.text or "" for t in c.iter() if t.tag in (f"{NS}v", f"{NS}t")) for c in row] for row in root.iter(f"{NS}row")]
    return names, rows


def test_workbook(spark, tmp_path):
    a = spark.createDataFrame([("x<&>y", 1.5, 3), (None, None, -4), ("bad\x01char", float("nan"), 0)], "go string, enrich double, n int").coalesce(1)
    path = str(tmp_path / "book.xlsx")
    sinks.write_xlsx({"ST5": a, "S & T": a.limit(0)}, path)
    names, rows = sheet(path, 1)
    assert names == ["ST5", "S & T"]
    assert rows == [["go", "enrich", "n"], ["x<&>y", "1.5", "3"], ["", "", "-4"], ["badchar", "nan", "0"]]
    assert sheet(path, 2)[1] == [["go", "enrich", "n"]]
    with pytest.raises(ValueError, match="more than"):
        sinks.write_xlsx({"ST5": a}, path, most_rows=2)


def test_headings(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, "g", 0.5)], "go string, model_aic double, enrich double, excl_gene string, magma_p double")
    assert enrich.headed(df, "TOOL").columns == ["GO", "TOOL_AIC", "enrich", "excl_GENE", "MAGMA_P"]


def test_headers_by_file(spark, tmp_path):
    (tmp_path / "a").write_text("# first\nSNP A B\nr1 1 2\nSNP A B\n")
    (tmp_path / "b").write_text("SNP B A # other order\nr2 20 10\n")
    (tmp_path / "c").write_text("SNP A\nr3 1\n")
    kinds = schema._struct("SNP:s A:l B:l", schema._K)
    got = readers.whitespace(spark, [str(tmp_path / "a"), str(tmp_path / "b")], kinds)
    assert sorted(tuple(r) for r in got.collect()) == [("SNP", None, None), ("r1", 1, 2), ("r2", 10, 20)]
    text = readers.whitespace(spark, [str(tmp_path / "b"), str(tmp_path / "a")])
    assert {(r["SNP"], r["A"], r["B"]) for r in text.collect()} == {("r1", "1", "2"), ("r2", "10", "20"), ("SNP", "A", "B")}
    with pytest.raises(ValueError, match="missing"):
        readers.whitespace(spark, [str(tmp_path / "a"), str(tmp_path / "c")], kinds)


def test_genotypes_by_ranges(spark, tmp_path):
    import random

    rng = random.Random(2)
    samples, n = 7, 2500
    records = bytes(rng.randrange(256) for _ in range(n * 2))
    (tmp_path / "x.bed").write_bytes(b"\x6c\x1b\x01" + records)
    want = [[None if g is None else float(g) for g in row] for row in ld.decode_bed(records, samples)]
    got = readers.bed(spark, str(tmp_path / "x.bed"), samples, range_bytes=600)
    assert got.select("file").distinct().count() == 1 and [r["g"] for r in got.orderBy("i").collect()] == want
    filled = ld.genotype_vectors(got.where("i < 50")).orderBy("i").collect()
    for r, w in zip(filled, want, strict=False):
        known = [x for x in w if x is not None]
        mean = sum(known) / len(known) if known else 0.0
        assert r["g"] == [pytest.approx(mean) if x is None else x for x in w]
    (tmp_path / "y.bed").write_bytes(b"\x6c\x1b\x01abc")
    with pytest.raises(Exception, match="not whole records"):
        readers.bed(spark, str(tmp_path / "y.bed"), samples).collect()


def test_gene_and_set_statistics(spark):
    import random

    rng = random.Random(6)
    z = {f"s{i}": rng.gauss(0, 1.6 if i < 200 else 1.0) for i in range(1000)}
    genes = {f"G{g}": [f"s{i}" for i in range(g * 20, g * 20 + 20)] for g in range(50)}
    variants = spark.createDataFrame(list(z.items()), "snp string, z double")
    held = spark.createDataFrame([(g, s) for g, m in genes.items() for s in m] * 2, "gene string, snp string")
    per = {r["gene"]: r for r in geneset.gene_z(variants, held).collect()}
    for g, m in genes.items():
        mean = sum(z[s] ** 2 for s in m) / 20
        assert per[g]["nsnps"] == 20 and math.isclose(per[g]["mean_chi2"], mean)
        assert math.isclose(per[g]["p"], 0.5 * math.erfc(per[g]["z"] / math.sqrt(2)), abs_tol=1e-6)
    sets = spark.createDataFrame([("HIGH", f"G{i}") for i in range(10)] + [("REST", f"G{i}") for i in range(10, 40)] + [("ONE", "G1")], "go string, gene string")
    frame = spark.createDataFrame([(g, r["z"]) for g, r in per.items()], "gene string, z double")
    got = {r["go"]: r for r in geneset.set_regression(frame, sets).collect()}
    assert set(got) == {"HIGH", "REST"} and got["HIGH"]["p"] < 1e-3 < 0.5 < got["REST"]["p"]
    x = [1.0 if int(g[1:]) < 10 else 0.0 for g in per]
    y = [per[g]["z"] for g in per]
    mx, my = sum(x) / 50, sum(y) / 50
    beta = sum((a - mx) * (b - my) for a, b in zip(x, y, strict=True)) / sum((a - mx) ** 2 for a in x)
    left = sum((b - my - beta * (a - mx)) ** 2 for a, b in zip(x, y, strict=True))
    assert math.isclose(got["HIGH"]["beta"], beta) and math.isclose(got["HIGH"]["se"], math.sqrt(left / 48 / sum((a - mx) ** 2 for a in x)))


def test_base_then_full(spark, tmp_path):
    d = str(tmp_path)
    (tmp_path / "t").write_text("SNP CHR BP A1 A2 N Z\n" + "".join(f"rs{i} {i % 22 + 1} {i * 20_000} A G 1000 {(i * 7919 % 400 - 200) / 80}\n" for i in range(600)))
    (tmp_path / "gene.loc").write_text("".join(f"G{i} {i % 22 + 1} {i * 300_000} {i * 300_000 + 3_000_000}\n" for i in range(40)))
    (tmp_path / "go.csv").write_text("GO\tGENE\tCHR\tFROM\tTO\n" + "".join(f"GOBP_{s}\tG{i}\t1\t0\t1\n" for s in "AB" for i in range(40) if i % 2 == (s == "A")))
    args = (f"{d}/t", f"{d}/gene.loc", f"{d}/go.csv")
    commands.plsa(spark, *args, f"{d}/base", exclude_ranges="", gsa_base=True)
    params = json.loads(spark.read.text(f"{d}/base").first()[0])["params"]
    assert params["snps"] > 0 and set(params) == {"snps", "s2", "h2", "inv_n"}
    commands.plsa(spark, *args, f"{d}/one", exclude_ranges="")
    commands.plsa(spark, *args, f"{d}/two", exclude_ranges="", load_params=f"{d}/base")
    rows = [sorted(tuple(map(str, r)) for r in readers.enrichment(spark, f"{d}/{x}").select("GO", F.round("enrich", 6)).collect()) for x in ("one", "two")]
    assert rows[0] == rows[1] and len(rows[0]) > 40
    pairs = spark.createDataFrame([(1, f"rs{i}", f"rs{i + 1}", 0.9) for i in range(0, 600, 2)], "chr int, i string, j string, r2 double")
    sinks.write_library(pairs, f"{d}/pairs")
    commands.plsa(spark, *args, f"{d}/pruned", exclude_ranges="", gsa_base=True, pairs=f"{d}/pairs", hardprune_r2=0.6)
    assert json.loads(spark.read.text(f"{d}/pruned").first()[0])["params"]["snps"] < 0.7 * params["snps"]
    assert commands.perf({"x": lambda: sum(range(1000))}, 2)["x"] > 0


def test_entry_without_a_library(monkeypatch):
    """A missing library of the training-data operators leaves the other queries."""
    import __spark_entry__

    if __spark_entry__.importlib.util.find_spec("varloom.llm") is None:
        pytest.skip("no training-data subpackage")

    def fail(name):
        raise ImportError("no such library")

    monkeypatch.setattr(__spark_entry__.importlib, "import_module", fail)
    with pytest.warns(UserWarning, match="left out"):
        names = __spark_entry__.queries()
    assert "neff" in names and "op1_bpe" not in names

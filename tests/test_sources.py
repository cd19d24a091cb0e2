"""Readers and writers on small files."""

import gzip
import time

import pytest
from pyspark.sql import functions as F

from varloom import schema
from varloom.sources import readers, sinks


def write(path, text):
    path.write_text(text)
    return str(path)


def test_whitespace_table(spark, tmp_path):
    p = write(tmp_path / "x.gsa.out", "# a comment\nVARIABLE  TYPE   P FULL_NAME\n# more\n a   SET  0.5  GOBP_A # tail\n\nb SET NA GOBP_B\nc\tSET\tNaN\tGOBP_C\n")
    got = readers.whitespace(spark, p, schema.MAGMA_SETS).collect()
    assert [(r["FULL_NAME"], r["P"]) for r in got] == [("GOBP_A", 0.5), ("GOBP_B", None), ("GOBP_C", None)]
    assert readers.whitespace(spark, p).columns == ["VARIABLE", "TYPE", "P", "FULL_NAME"]
    with pytest.raises(ValueError, match="missing"):
        readers.whitespace(spark, p, schema.MAGMA_GENES)


def test_gz_sumstats(spark, tmp_path):
    p = tmp_path / "t.sumstats.gz"
    with gzip.open(p, "wt") as f:
        f.write("RSID chr POS EffectAllele OtherAllele N Z\nrs1 1 100 A G 10 1.5\nrs2 X 200 C T 10 nan\n")
    got = readers.sumstats(spark, str(p), partitions=2).orderBy("SNP").collect()
    assert [(r["SNP"], r["CHR"], r["BP"], r["N"], r["Z"]) for r in got] == [("rs1", "1", 100, 10.0, 1.5), ("rs2", "X", 200, 10.0, None)]


def test_dialects(spark, tmp_path):
    p = write(tmp_path / "g.glm", "ID REF ALT OBS_CT T_STAT\nrs1 A G 500 -2.5\n")
    got = readers.sumstats(spark, p, schema.DIALECTS["glm_linear"]).first()
    assert (got["SNP"], got["A1"], got["A2"], got["N"], got["Z"]) == ("rs1", "A", "G", 500.0, -2.5)
    p = write(tmp_path / "z.txt", "SNP CHR POS A1 A2 Zscore N_analyzed\nrs12184267 1 715265 t c 0.916 225955\n")
    got = readers.sumstats(spark, p, schema.DIALECTS["zscore"]).select(F.upper("A1").alias("A1"), "BP", "N", "Z").first()
    assert tuple(got) == ("T", 715265, 225955.0, 0.916)


def test_tsv_round_trip_and_enrichment(spark, tmp_path):
    df = spark.createDataFrame([("GOBP_A", 5, 1.5), ("GOBP_B", None, None)], "GO string, NGENES long, enrich double")
    sinks.write_tsv(df, str(tmp_path / "out"), ["GO", "enrich", "NGENES"])
    back = readers.enrichment(spark, str(tmp_path / "out")).orderBy("GO")
    assert back.columns == ["GO", "enrich", "NGENES"] and [tuple(r) for r in back.collect()] == [("GOBP_A", 1.5, 5), ("GOBP_B", None, None)]
    sinks.write_workbook({"ST5": df, "ST7": df}, str(tmp_path / "book"))
    assert readers.tsv(spark, str(tmp_path / "book" / "ST7")).count() == 2


def test_documents(spark, tmp_path):
    for i in (1, 2):
        write(tmp_path / f"x.fit.rep{i}.json", '{"params": {"pi": 0.%d}}' % i)
    got = readers.documents(spark, readers.expand_replicates(f"{tmp_path}/x.fit.rep@.json")).select("rep", F.try_variant_get("doc", "$.params.pi", "double").alias("pi")).orderBy("rep").collect()
    assert [tuple(r) for r in got] == [(1, 0.1), (2, 0.2)]
    sinks.write_documents(readers.documents(spark, f"{tmp_path}/x.fit.rep1.json"), str(tmp_path / "docs"))
    assert spark.read.text(str(tmp_path / "docs")).count() == 1


def test_panel_files(spark, tmp_path):
    for c in (21, 22):
        write(tmp_path / f"ref.chr{c}.bim", f"{c}\trs{c}\t0\t100\tA\tG\n{c}\trs{c}b\t0\t200\tAT\tC\n")
    template = f"{tmp_path}/ref.chr@.bim"
    assert readers.bim(spark, template, [21, 22]).count() == 4
    marked = spark.read.text(readers.expand_chromosomes(template, [21, 22])).select(readers.chromosome_of(template).alias("c")).distinct()
    assert {r["c"] for r in marked.collect()} == {"21", "22"}
    fam = write(tmp_path / "ref.fam", "f1 i1 0 0 1 -9\nf2 i2 0 0 2 -9\n")
    assert readers.fam(spark, fam).count() == 2
    (tmp_path / "ref.bed").write_bytes(b"\x6c\x1b\x01" + bytes([0b00_00_01_11, 0b00_00_10_00]))
    assert [r["g"] for r in readers.bed(spark, str(tmp_path / "ref.bed"), 2).orderBy("i").collect()] == [[0.0, None], [2.0, 1.0]]
    write(tmp_path / "p.rep3.snps", "rs1\n\nrs2\n")
    assert [(r["SNP"], r["rep"]) for r in readers.snp_list(spark, str(tmp_path / "p.rep3.snps")).collect()] == [("rs1", 3), ("rs2", 3)]
    a = write(tmp_path / "b.annot", "CHR\tBP\tSNP\tCM\tcoding\tpromoter\n1\t5\trs1\t0\t1\t0\n1\t6\trs2\t0\t1\t1\n")
    assert readers.annotation(spark, a).count() == 3
    g = write(tmp_path / "go.csv", "GO\tGENE\tCHR\tFROM\tTO\nGOBP_A\tG1\t1\t5\t9\n")
    assert tuple(readers.gene_sets(spark, g).first()) == ("GOBP_A", "G1", "1", 5, 9)
    loc = write(tmp_path / "gene.loc", "G1 1 5 9 + NAME\n")
    assert tuple(readers.gene_locations(spark, loc).first()) == ("G1", "1", 5, 9)


def test_by_chromosome_and_library(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 3).cast("int").alias("chr"), "id")
    sinks.write_by_chromosome(df, str(tmp_path / "c"), chromosomes=[0, 2])
    back = spark.read.parquet(str(tmp_path / "c"))
    assert back.count() == 67 and {r["chr"] for r in back.select("chr").distinct().collect()} == {0, 2}
    pairs = spark.createDataFrame([(1, 1, 2, 0.5), (2, 5, 6, 0.25)], "chr int, i long, j long, r2 double")
    sinks.write_library(pairs, str(tmp_path / "lib"))
    assert spark.read.parquet(str(tmp_path / "lib")).where("chr = 2").count() == 1


def test_freshness(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    write(tmp_path / "a", "x")
    assert readers.stale(spark, b, a)
    time.sleep(1.1)
    write(tmp_path / "b", "y")
    assert not readers.stale(spark, b, a) and readers.stale(spark, a, b)
    with pytest.raises(FileNotFoundError):
        readers.stale(spark, b, str(tmp_path / "none"))


def test_headers_do_not_depend_on_splits(spark, tmp_path):
    """The way files are split may change between reading the headers and the action; a line equal to the header stays as often as it is data."""
    paths = []
    for i in range(6):
        head = "SNP A B" if i % 2 else "B A SNP"
        cells = [f"r{i}_{k} {k} {k}" if i % 2 else f"{k} {k} r{i}_{k}" for k in range(20)]
        (tmp_path / f"f{i}").write_text("\n".join(["# note", head, *cells, *([head] * (2 if i == 3 else 0))]) + "\n")
        paths.append(str(tmp_path / f"f{i}"))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        df = readers.whitespace(spark, paths)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "40b")
        got = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert len(got) == 122 and sum(r["SNP"] == "SNP" for r in got) == 2
    assert {r["SNP"] for r in got if r["A"] == "7" and r["B"] == "7"} == {f"r{i}_7" for i in range(6)}


def test_headers_are_found_without_sorting_the_lines(spark, tmp_path, monkeypatch):
    path, plans, frame = write(tmp_path / "t", "A B\n" + "".join(f"{i} {i}\n" for i in range(50))), [], type(spark.range(1))
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: plans.append(self._jdf.queryExecution().executedPlan().toString()) or collect(self))
    readers.whitespace(spark, path)
    assert len(plans) == 2 and not any("SortAggregate" in p for p in plans)


def test_files_of_text_grow_with_the_input(spark, tmp_path, monkeypatch):
    from varloom import catalog

    spark.range(60_000).select(F.concat(F.lit("v"), "id").alias("snp")).write.parquet(f"{tmp_path}/in")
    df = spark.read.parquet(f"{tmp_path}/in")
    count = lambda: len(spark.read.text(catalog._text(df, "grow", F.col("snp"), "SNP")).inputFiles())
    assert count() == 3
    monkeypatch.setattr(catalog, "BYTES_A_FILE", 20_000, raising=False)
    assert count() > 6

"""Readers: white-space tables, TSV, JSON documents, templates of paths, panel files, annotations, gene sets."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varloom import schema as S
from varloom.operators.ld import bed_copies, genotype_batch

#: What counts as missing in text tables.
MISSING = ("", "NA", "NaN", "nan", "N/A", "null", "NULL", "-nan", "#N/A", "n/a", "None")


def _typed(cell, kind: T.DataType):
    text = F.when(cell.isin(*MISSING), None).otherwise(cell)
    if isinstance(kind, (T.LongType, T.IntegerType)):
        return F.coalesce(text.try_cast(kind), text.try_cast("double").try_cast(kind))
    return text if isinstance(kind, T.StringType) else text.try_cast(kind)


def whitespace(spark: SparkSession, path: str | list[str], columns: T.StructType | None = None, comment: str = "#", partitions: int | None = None) -> DataFrame:
    """A table with cells between runs of white space; text after `comment` is cut anywhere in a line.

    The first line left of each file is its header, and its cells are read by
    it: files may have their columns in different orders.  Without `columns`,
    cells stay text under the names of the first file; with them, columns are
    typed and picked by name.  A file without one of the columns is an error.
    Compressed files cannot be split: give `partitions` to deal their rows out.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    cut = F.regexp_replace("value", re.escape(comment) + ".*$", "") if comment else F.col("value")
    lines = raw.withColumn("line", F.trim(cut)).where("line <> ''")
    # The first line of a file: in its first block that has one, the first row.  One row a file.
    # A list that stays empty (asked for below, or it would be left out): with it Spark aggregates by objects in a hash table; the least struct alone would sort all lines of a task.
    least = lines.groupBy("_f").agg(F.min(F.struct("_b", "_i", "line")).alias("_h"), F.collect_list(F.lit(None).cast("int")).alias("_none"))
    found = least.where(F.size("_none") == 0).select("_f", F.col("_h.line").alias("_head"), F.split("_h.line", r"\s+").alias("_names")).orderBy("_f").collect()
    if not found:
        raise ValueError(f"no header in {path}")
    names = [f.name for f in columns] if columns else found[0]["_names"]
    for r in found:
        missing = [n for n in names if n not in r["_names"]]
        if missing:
            raise ValueError(f"columns {missing} are missing in {r['_f']}; there are {r['_names']}")
    layouts = sorted({tuple(r["_names"]) for r in found})
    which = F.broadcast(spark.createDataFrame([(r["_f"], layouts.index(tuple(r["_names"])), r["_head"]) for r in found], "_f string, _layout int, _head string"))  # one row a file
    # A header is known by its text, which no way of splitting the file changes.  Of equal lines in its file one is the header; the others are data.
    known = lines.join(which, "_f", "left").withColumn("_layout", F.coalesce("_layout", F.raise_error(F.concat(F.lit("the header of this file was not read: "), "_f")).cast("int")))
    # Its cells become null as well as its row leaving, so that a caller's condition that is moved below the join never meets a header's text.
    body = known.where(~F.col("line").eqNullSafe(F.col("_head"))).select(F.when(F.col("line") != F.col("_head"), F.col("line")).alias("line"), "_layout")
    again = known.where(F.col("line") == F.col("_head")).groupBy("_f", "_layout", "line").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").collect()
    if again:
        more = spark.createDataFrame([(r["line"], r["_layout"], r["_n"] - 1) for r in again], "line string, _layout int, _n long")
        body = body.unionByName(more.select("line", "_layout", F.explode(F.sequence(F.lit(1), "_n")).alias("_n")).drop("_n"))
    if partitions:
        body = body.repartition(partitions)
    rows = body.select(F.split("line", r"\s+").alias("c"), "_layout")

    def cell(name: str):
        places = [n.index(name) for n in layouts]
        if len(set(places)) == 1:
            return F.get("c", F.lit(places[0]))
        return F.get("c", F.get(F.array(*[F.lit(i) for i in places]), F.col("_layout")))

    if columns is None:
        return rows.select(*[F.when(cell(n).isin(*MISSING), None).otherwise(cell(n)).alias(n) for n in names])
    return S.nan_to_null(rows.select(*[_typed(cell(f.name), f.dataType).alias(f.name) for f in columns]))


def tsv(spark: SparkSession, path: str | list[str], columns: T.StructType | None = None, sep: str = "\t") -> DataFrame:
    """Cells between tabs with a header; missing marks become null.  Columns that a file lacks are null."""
    raw = spark.read.csv(path, sep=sep, header=True, inferSchema=False)
    if columns is None:
        return raw.select(*[F.when(F.col(f"`{c}`").isin(*MISSING), None).otherwise(F.col(f"`{c}`")).alias(c) for c in raw.columns])
    return S.nan_to_null(raw.select(*[(_typed(F.col(f"`{f.name}`"), f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in columns]))


def enrichment(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Gene-set results with whatever columns the file has, numbers typed, older names replaced."""
    raw = tsv(spark, path)
    return S.nan_to_null(raw.select(*[F.col(f"`{c}`") if c == "GO" else F.col(f"`{c}`").try_cast("long" if c in ("NGENES", "snps") else "double").alias(c) for c in raw.columns]))


def documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSON files, one row each: fname, rep (from a name with rep<number>, else null), json, doc."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("fname"), F.col("value").alias("json"))
    rep = F.regexp_extract("fname", r"rep(\d+)", 1)
    return files.withColumns({"rep": F.when(rep != "", rep.cast("int")), "doc": F.parse_json("json")})


def expand_chromosomes(template: str, chromosomes: list[int] | None = None) -> list[str]:
    """Paths of a template in which @ stands for the chromosome (1 to 22 unless given)."""
    return [template.replace("@", str(c)) for c in chromosomes or range(1, 23)] if "@" in template else [template]


def chromosome_of(template: str):
    """The chromosome of a row's file, for a template with @."""
    before, _, after = template.rsplit("/", 1)[-1].partition("@")
    return F.regexp_extract(F.col("_metadata.file_name"), "^" + re.escape(before) + r"(\w+?)" + re.escape(after) + "$", 1)


def expand_replicates(template: str) -> str:
    """A glob for rep@ templates."""
    return template.replace("rep@", "rep*")


def bim(spark: SparkSession, template: str, chromosomes: list[int] | None = None) -> DataFrame:
    """Panel variants: CHR, SNP, CM, BP, A1, A2 (no header)."""
    lines = spark.read.text(expand_chromosomes(template, chromosomes)).select(F.split(F.trim("value"), r"\s+").alias("c")).where(F.size("c") >= 6)
    return lines.select(*[_typed(F.get("c", F.lit(i)), f.dataType).alias(f.name) for i, f in enumerate(S.BIM)])


def fam(spark: SparkSession, path: str) -> DataFrame:
    """Samples: FID, IID, PAT, MAT, SEX, PHENO (no header)."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("c")).where(F.size("c") >= 6)
    return lines.select(*[_typed(F.get("c", F.lit(i)), f.dataType).alias(f.name) for i, f in enumerate(S.FAM)])


def bed(spark: SparkSession, path: str | list[str], samples: int, *, range_bytes: int = 32 << 20) -> DataFrame:
    """Genotypes of variant-major .bed files: file, i (place in the file), g (array<double>, null where missing).

    A variant is a record of fixed length, so files of any size are read by
    ranges of whole records, many tasks a file.
    """
    width = -(-samples // 4)
    each = max(1, range_bytes // width)
    listed = spark.read.format("binaryFile").load(path).select("path", ((F.col("length") - 3) / width).alias("_n"))  # contents are not read
    whole = F.when(F.col("_n") == F.floor("_n"), F.col("_n").cast("long")).otherwise(F.raise_error(F.concat(F.lit("not whole records: "), "path")).cast("long"))
    starts = F.filter(F.sequence(F.lit(0).cast("long"), whole, F.lit(each).cast("long")), lambda x: x < F.col("_n"))
    ranges = listed.select("path", F.col("_n").cast("long").alias("n"), F.explode(starts).alias("first")).repartition("path", "first")

    def decode(batches):
        from pyarrow import fs

        for b in batches:
            for name, n, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                where, at = fs.FileSystem.from_uri(name)
                with where.open_input_file(at) as f:
                    if f.read_at(3, 0) != b"\x6c\x1b\x01":  # fixed value: mark of variant-major files
                        raise ValueError(f"not a variant-major .bed file: {name}")
                    for i in range(first, min(n, first + each), 1000):
                        m = min(1000, min(n, first + each) - i)
                        yield genotype_batch(name, i, bed_copies(f.read_at(m * width, 3 + i * width), samples))

    return ranges.mapInArrow(decode, "file string, i long, g array<double>")


def snp_list(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """SNP and rep (from the file's name; null without one)."""
    rep = F.regexp_extract(F.col("_metadata.file_name"), r"rep(\d+)", 1)
    return spark.read.text(path).select(F.trim("value").alias("SNP"), F.when(rep != "", rep.cast("int")).alias("rep")).where("SNP <> ''")


def annotation(spark: SparkSession, template: str, chromosomes: list[int] | None = None, keep: tuple[str, ...] = ("CHR", "BP", "SNP", "CM")) -> DataFrame:
    """Long form of annotation files: SNP, category, value; zeros are left out."""
    wide = tsv(spark, expand_chromosomes(template, chromosomes))
    typed = wide.select(*[F.col(f"`{c}`") if c in keep else F.col(f"`{c}`").try_cast("double").alias(c) for c in wide.columns])
    return unpivot_annotation(typed, "SNP", keep).where(F.col("value") != 0)


def unpivot_annotation(wide: DataFrame, snp: str = "SNP", keep: tuple[str, ...] = ("CHR", "BP", "SNP", "CM"), value: str = "value") -> DataFrame:
    """One row a variant and category from one column a category."""
    names = [c for c in wide.columns if c not in keep]
    return wide.select(snp, *[F.col(f"`{c}`") for c in names]).unpivot([snp], names, "category", value)


def gene_sets(spark: SparkSession, path: str | list[str], sep: str = "\t") -> DataFrame:
    """GO, GENE, CHR, FROM, TO, one row a gene of a set."""
    return tsv(spark, path, S.GENE_SETS, sep)


def gene_locations(spark: SparkSession, path: str) -> DataFrame:
    """Gene positions without header: gene, chr, gstart, gend."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("c")).where(F.size("c") >= 4)
    return lines.select(F.get("c", F.lit(0)).alias("gene"), F.get("c", F.lit(1)).alias("chr"), F.get("c", F.lit(2)).try_cast("long").alias("gstart"), F.get("c", F.lit(3)).try_cast("long").alias("gend"))


def sumstats(spark: SparkSession, path: str | list[str], rename: Mapping[str, str] | None = None, partitions: int | None = None) -> DataFrame:
    """Summary statistics with any accepted header names: the standard columns that are there, typed."""
    raw = whitespace(spark, path, comment="", partitions=partitions)
    raw = S.resolve_headers(raw.withColumnsRenamed(dict(rename or {})))
    kinds = {f.name: f.dataType for f in S.SUMSTATS}
    return S.nan_to_null(raw.select(*[_typed(F.col(f"`{c}`"), kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in raw.columns]))


def modified(spark: SparkSession, path: str) -> int | None:
    """Time of the last change of a path (of its newest file), or null if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    return max([fs.getFileStatus(p).getModificationTime(), *(s.getModificationTime() for s in fs.listStatus(p))])


def file_bytes(spark: SparkSession, paths: list[str]) -> int:
    """Bytes of the files in all."""
    total = 0
    for name in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))  # names are encoded
        total += p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen()
    return total


def stale(spark: SparkSession, target: str, source: str) -> bool:
    """Whether a target is missing or older than its source; a missing source is an error."""
    made, from_ = modified(spark, target), modified(spark, source)
    if from_ is None:
        raise FileNotFoundError(source)
    return made is None or made < from_


def snp_locations(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Variant positions without header: snp, chr, bp."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("c")).where(F.size("c") >= 3)
    return lines.select(F.get("c", F.lit(0)).alias("snp"), F.get("c", F.lit(1)).alias("chr"), F.get("c", F.lit(2)).try_cast("long").alias("bp"))


def set_annotation(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of a set's name and its genes: go, gene."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("c")).where(F.size("c") >= 2)
    return lines.select(F.get("c", F.lit(0)).alias("go"), F.explode(F.slice("c", F.lit(2), F.size("c"))).alias("gene"))


def p_values(spark: SparkSession, path: str | list[str], snp: str = "RSID", p: str = "P", n: str = "N") -> DataFrame:
    """snp, p, n from the named columns of a table."""
    raw = whitespace(spark, path, comment="")
    return S.nan_to_null(raw.select(F.col(f"`{snp}`").alias("snp"), F.col(f"`{p}`").try_cast("double").alias("p"), F.col(f"`{n}`").try_cast("double").alias("n")))


def library(spark: SparkSession, path: str, chromosomes: list[int] | None = None, chrom: str = "chr") -> DataFrame:
    """Correlated pairs stored by chromosome; only the asked-for partitions are read."""
    df = spark.read.parquet(path)
    return df.where(F.col(chrom).isin(chromosomes)) if chromosomes else df

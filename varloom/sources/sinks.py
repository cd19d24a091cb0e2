"""Writers: TSV, per-chromosome tables, report sheets, JSON documents, panel libraries."""

from __future__ import annotations

import io
import math
import re
import zipfile
from collections.abc import Mapping
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the workbook format: its name spaces and kinds of parts, and characters that its text cannot hold.
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006"
_SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_UNFIT = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def write_tsv(df: DataFrame, path: str, columns: list[str] | None = None, compression: str | None = "gzip", files: int | None = None) -> None:
    """Cells between tabs with a header, columns in the given order; null is an empty cell."""
    out = df.select(*[F.col(f"`{c}`") for c in columns or df.columns])
    if files:
        out = out.coalesce(files)
    out.write.mode("overwrite").csv(path, sep="\t", header=True, compression=compression or "none", emptyValue="", nullValue="")


def write_by_chromosome(df: DataFrame, path: str, chrom: str = "chr", chromosomes: list[int] | None = None, per_file: int = 2_000_000) -> None:
    """A table partitioned by chromosome.

    Rows are dealt by chromosome and a hash, several tasks to a chromosome,
    so that neither the 22 uneven chromosomes nor small files are a burden.
    """
    if chromosomes:
        df = df.where(F.col(chrom).isin(chromosomes))
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(8))
    df.repartition(chrom, salt).write.mode("overwrite").option("maxRecordsPerFile", per_file).partitionBy(chrom).parquet(path)


def write_workbook(sheets: Mapping[str, DataFrame], path: str, parquet: bool = False) -> None:
    """Named sheets below one folder, each a TSV of one file (or Parquet)."""
    for name, df in sheets.items():
        if parquet:
            df.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")
        else:
            write_tsv(df, f"{path}/{name}", compression=None, files=1)


def write_xlsx(sheets: Mapping[str, DataFrame], path: str, most_rows: int = 1_048_575) -> None:
    """One workbook file of several sheets, for reports: a sheet of this format holds `most_rows` rows below its header, more is an error.

    Rows come to the driver one partition at a time.  Null is an empty cell.
    """
    out = io.BytesIO()
    cell = lambda v: "<c/>" if v is None else f"<c><v>{v!r}</v></c>" if isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_UNFIT.sub("", str(v)))}</t></is></c>'
    names = list(sheets)
    parts = range(1, len(names) + 1)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{_KIND}.worksheet+xml"/>' for i in parts)
        z.writestr("[Content_Types].xml", f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{_KIND}.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_OFFICE}/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_SHEET}" xmlns:r="{_OFFICE}/relationships"><sheets>' + "".join(f'<sheet name={quoteattr(n[:31])} sheetId="{i}" r:id="r{i}"/>' for i, n in zip(parts, names, strict=True)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{_OFFICE}/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in parts) + "</Relationships>")
        for i, name in zip(parts, names, strict=True):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                f.write(f'<worksheet xmlns="{_SHEET}"><sheetData>'.encode())
                f.write(("<row>" + "".join(map(cell, sheets[name].columns)) + "</row>").encode())
                for n, row in enumerate(sheets[name].toLocalIterator()):
                    if n >= most_rows:
                        raise ValueError(f"sheet {name} has more than {most_rows} rows; write it as a table")
                    f.write(("<row>" + "".join(map(cell, row)) + "</row>").encode())
                f.write(b"</sheetData></worksheet>")
    _put_file(next(iter(sheets.values())).sparkSession, path, out.getvalue())


def _put_file(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file in any store that Spark writes to."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def write_documents(df: DataFrame, path: str, json: str = "json") -> None:
    """One JSON document a line."""
    df.select(F.col(json).alias("value")).write.mode("overwrite").text(path)


def write_library(pairs: DataFrame, path: str, chrom: str = "chr") -> None:
    """Correlated pairs as a table by chromosome, sorted by first variant, for quick reloads."""
    salt = F.pmod(F.xxhash64("i"), F.lit(16))
    pairs.repartition(chrom, salt).sortWithinPartitions(chrom, "i").write.mode("overwrite").partitionBy(chrom).parquet(path)

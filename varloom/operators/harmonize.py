"""Harmonisation of summary statistics: values, exclusions, allele matching, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.functions import alleles
from varloom.functions.normal import effective_n_value, z_from_p_and_or
from varloom.operators.ranks import exact_median
from varloom.schema import require


def upper_alleles(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.upper(F.col(f"`{c}`")) for c in columns or ("A1", "A2")})


def constant(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def from_case_control(df: DataFrame, cases: float, controls: float) -> DataFrame:
    """N from the study's counts and Z from P and OR."""
    return require(df, ["P", "OR"]).withColumns({"N": F.lit(effective_n_value(cases, controls)), "Z": z_from_p_and_or("P", "`OR`")})


def in_mhc(chrom: Column, bp: Column) -> Column:
    """Strictly between 26 and 34 Mb of chromosome 6.  Labels are compared as text, so an X among them changes nothing."""
    return (chrom.cast("string") == "6") & (bp > 26_000_000) & (bp < 34_000_000)


def on_x(chrom: Column) -> Column:
    return chrom.cast("string") == "X"


def excluded(chrom: Column, bp: Column) -> Column:
    return F.coalesce(in_mhc(chrom, bp), F.lit(False)) | F.coalesce(on_x(chrom), F.lit(False))


def exclusion_counts(df: DataFrame, chrom: str, bp: str) -> DataFrame:
    """One row: n, mhc, x, excluded, kept, disjoint (the masks do not overlap)."""
    c, b = F.col(chrom), F.col(bp)
    counts = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(in_mhc(c, b)).alias("mhc"),
        F.count_if(on_x(c)).alias("x"),
        F.count_if(excluded(c, b)).alias("excluded"),
    )
    return counts.withColumn("kept", F.col("n") - F.col("excluded")).withColumn("disjoint", F.col("excluded") == F.col("mhc") + F.col("x"))


def assert_disjoint(df: DataFrame, chrom: str, bp: str) -> DataFrame:
    row = exclusion_counts(df, chrom, bp).first()
    if not row["disjoint"]:
        raise ValueError(f"exclusion masks overlap: {row}")
    return df


def clean(df: DataFrame, chrom: str = "CHR", bp: str = "BP", columns: tuple[str, ...] = ("SNP", "CHR", "BP", "A1", "A2", "N", "Z")) -> DataFrame:
    """The table a study keeps: capital alleles, no MHC, no X, the standard columns."""
    return upper_alleles(df.where(~excluded(F.col(chrom), F.col(bp)))).select(*columns)


def defined(*columns: Column) -> Column:
    """Not null and not NaN, for all columns."""
    out = F.lit(True)
    for c in columns:
        out = out & c.isNotNull() & ~F.isnan(c)
    return out


def half_median_n(df: DataFrame, n: str = "n", by: str | None = None) -> DataFrame:
    """Rows with N of at least half the median N (of their group).

    The median is exact and found by rounds of counts, so a group may be of
    any size.  It is one number a group; Spark broadcasts the groups only if
    it measures them to be small.  Null and NaN have no say and do not stay.
    """
    group = by or "_all"
    rows = df if by else df.withColumn(group, F.lit(1))
    out = rows.join(exact_median(rows, n, group, "_m"), group).where((F.col(n) >= F.col("_m") / 2) & ~F.isnan(n))
    return out.select(*df.columns)


def match_reference(sumstats: DataFrame, reference: DataFrame, keep: tuple[str, ...] = ("trait",)) -> DataFrame:
    """Every line with its reference variant, how it was found, and the Z for the reference's allele order.

    Lines are matched by marker name; those left over by position and the
    key that the four encodings of an allele pair share.  Columns of
    `reference`: snp, chr, bp, a1, a2.  Gives ref_snp, by ("name", "position",
    null), agrees (the alleles are the reference's in some encoding),
    ambiguous, swapped and z_ref.

    One shuffle by name and one by position; the second side of each is the
    panel, which Spark broadcasts only if it is measured to be small.
    """
    ref = reference.select(F.col("snp").alias("ref_snp"), F.col("chr").alias("_c"), F.col("bp").alias("_b"), F.col("a1").alias("_r1"), F.col("a2").alias("_r2"), alleles.pair_key(F.col("a1"), F.col("a2")).alias("_k"))
    named = sumstats.join(ref.select(F.col("ref_snp").alias("_n_snp"), F.col("_r1").alias("_n1"), F.col("_r2").alias("_n2")), F.col("snp") == F.col("_n_snp"), "left")
    # Lines found by name get a null key, so the second join cannot match them.
    key = F.when(F.col("_n_snp").isNull(), alleles.pair_key(F.col("a1"), F.col("a2")))
    both = named.withColumn("_key", key).join(ref, (F.col("chr") == F.col("_c")) & (F.col("bp") == F.col("_b")) & (F.col("_key") == F.col("_k")), "left")
    r1, r2 = F.coalesce("_n1", "_r1"), F.coalesce("_n2", "_r2")
    by = F.when(F.col("_n_snp").isNotNull(), "name").when(F.col("ref_snp").isNotNull(), "position")
    flip = alleles.swapped(F.col("a1"), F.col("a2"), r1, r2)
    agrees = alleles.pair_key(F.col("a1"), F.col("a2")) == alleles.pair_key(r1, r2)
    return both.select(
        *keep, "snp", "chr", "bp", "a1", "a2", "n", "z",
        F.coalesce("_n_snp", "ref_snp").alias("ref_snp"),
        by.alias("by"),
        agrees.alias("agrees"),
        alleles.ambiguous(F.col("a1"), F.col("a2")).alias("ambiguous"),
        flip.alias("swapped"),
        (F.col("z") * F.when(flip, -1.0).otherwise(1.0) + 0.0).alias("z_ref"),
    )


def usable(matched: DataFrame) -> DataFrame:
    """Lines that a study may use: in the panel, with its alleles, not ambiguous, with N and Z."""
    return matched.where(F.col("by").isNotNull() & F.col("agrees") & ~F.col("ambiguous") & defined(F.col("n"), F.col("z")))


def match_counters(matched: DataFrame, by: str = "trait") -> DataFrame:
    """Lines, undefined, unmatched, mismatched, ambiguous, kept, swapped: one pass.  Each line counts under the first that applies."""
    ok = defined(F.col("n"), F.col("z"))
    found, fits, doubt = F.col("by").isNotNull(), F.col("agrees"), F.col("ambiguous")
    return matched.groupBy(by).agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(~ok).alias("undefined"),
        F.count_if(ok & ~found).alias("unmatched"),
        F.count_if(ok & found & ~fits).alias("mismatched"),
        F.count_if(ok & found & fits & doubt).alias("ambiguous"),
        F.count_if(ok & found & fits & ~doubt).alias("kept"),
        F.count_if(ok & found & fits & ~doubt & F.col("swapped")).alias("swapped"),
    )


def intersect(first: DataFrame, *others: DataFrame, on: str = "snp") -> DataFrame:
    """Rows whose marker is in every other table."""
    for o in others:
        first = first.join(o.select(on), on, "left_semi")
    return first


def random_subset(df: DataFrame, n: int, seed: int, on: str = "snp") -> DataFrame:
    """n rows chosen by a seeded hash of their key: the same rows in any layout (top-n a partition first, then of those)."""
    return df.orderBy(F.xxhash64(F.col(on), F.lit(seed)), F.col(on)).limit(n)


def maf_at_least(df: DataFrame, least: float, maf: str = "maf") -> DataFrame:
    """Variants of at least this allele frequency, the bound itself included; a missing one fails."""
    return df.where(F.col(maf) >= least)


def extract(df: DataFrame, listed: DataFrame, on: str = "snp") -> DataFrame:
    """Rows whose marker is in a list."""
    return df.join(listed.select(on), on, "left_semi")


def max_odds(df: DataFrame, most: float, odds: str = "OR") -> DataFrame:
    return df.where(F.col(odds) <= most)


def qc(df: DataFrame, ranges: list[tuple[str, int, int]] = (), max_or: float | None = None, least_info: float | None = None, least_maf: float | None = None) -> DataFrame:
    """Quality filters in one pass: ranges to leave out, odds ratio, imputation quality, allele frequency.  A missing value fails its filter."""
    from varloom.operators.ranges import in_ranges

    keep = ~in_ranges(F.col("CHR"), F.col("BP"), list(ranges))
    if max_or is not None:
        df = max_odds(df, max_or)
    if least_info is not None:
        keep &= F.col("INFO") >= least_info
    if least_maf is not None:
        keep &= F.least(F.col("MAF"), 1.0 - F.col("MAF")) >= least_maf
    return df.where(keep)


def with_neff(df: DataFrame, factor: float = 4.0, drop: bool = False) -> DataFrame:
    """N from NCASE and NCONTROL: factor / (1 / cases + 1 / controls)."""
    n = F.try_divide(F.lit(float(factor)), F.try_divide(F.lit(1.0), "NCASE") + F.try_divide(F.lit(1.0), "NCONTROL"))
    out = df.withColumn("N", n)
    return out.drop("NCASE", "NCONTROL") if drop else out

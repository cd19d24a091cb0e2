"""Gene-set result tables: classes of rows, shares of heritability, leave-one-gene-out, ranks and reports.

Columns are lower case here: go, ngenes, enrich, se_enrich, h2, se_h2,
h2_base, model_aic, ...  All inputs must have been through `nan_to_null`.
Ties are broken by name, as a table has no row order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from varloom.functions.text import formatted
from varloom.schema import nan_to_null, reorder

MARK = "_excl_"
PREFIXES = ("GOMF_", "GOBP_", "GOCC_", "SYNGO_")
WHOLE = ("base", "coding_genes")
#: Fixed value: the report's column order.
ORDER = (
    "go gene ngenes enrich se_enrich model_aic loglike_diff loglike_df model_p model_q model_fdr magma_p magma_rank"
    " h2 se_h2 h2_frac se_h2_frac h2_base_frac se_h2_base_frac excl_gene excl_enrich se_excl_enrich gene_list"
).split()


def ingest(df: DataFrame) -> DataFrame:
    """Lower-case names, the tool's older names replaced, NaN to null."""
    df = df.toDF(*[c.lower() for c in df.columns])
    for old, new in (("enrich_std", "se_enrich"), ("h2_std", "se_h2"), ("loglike_aic", "model_aic")):
        if old in df.columns:
            df = df.withColumnRenamed(old, new)
    # Significance columns carry the name of the tool that made them.
    for c in df.columns:
        tail = c.rpartition("_")[2]
        if tail in ("p", "q", "fdr") and not c.startswith("magma_") and f"model_{tail}" not in df.columns:
            df = df.withColumnRenamed(c, f"model_{tail}")
    return nan_to_null(df)


def classify(df: DataFrame) -> DataFrame:
    """Add class ("whole", "loo", "set", "gene") and the parts of a leave-one-out name: set_go, excl_gene."""
    go = F.col("go")
    loo = go.contains(MARK)
    is_set = F.lit(False)
    for p in PREFIXES:
        is_set = is_set | go.startswith(p)
    parts = F.split(go, MARK)
    return df.withColumns(
        {
            "class": F.when(go.isin(*WHOLE), "whole").when(loo, "loo").when(is_set, "set").otherwise("gene"),
            "set_go": F.when(loo, parts.getItem(0)),
            "excl_gene": F.when(loo, parts.getItem(1)),
        }
    )


def h2_fractions(df: DataFrame) -> DataFrame:
    """Shares of the coding_genes row: h2_frac, se_h2_frac (same denominator), h2_base_frac.  Raises without that row.

    The denominator is one row, so its broadcast has a fixed size.
    """
    base = df.where(F.col("go") == "coding_genes").agg(F.min(F.struct("h2", "h2_base")).alias("_w"))
    need = F.when(F.col("_w").isNull(), F.raise_error(F.lit("no row coding_genes"))).otherwise(F.col("_w"))
    out = df.crossJoin(F.broadcast(base.select(need.alias("_w"))))
    new = {"h2_frac": F.try_divide("h2", "_w.h2"), "h2_base_frac": F.try_divide("h2_base", "_w.h2_base")}
    if "se_h2" in df.columns:
        new["se_h2_frac"] = F.try_divide("se_h2", "_w.h2")
    return out.withColumns(new).drop("_w", "h2_base", "snps")


def worst_loo(classified: DataFrame) -> DataFrame:
    """Of each set, the gene without which enrichment is lowest: go, excl_gene, excl_enrich (and its error)."""
    loo = classified.where((F.col("class") == "loo") & F.col("enrich").isNotNull())
    more = ["se_enrich"] if "se_enrich" in classified.columns else []
    best = loo.groupBy("set_go").agg(F.min(F.struct("enrich", "excl_gene", *more)).alias("_b"))
    return best.select(F.col("set_go").alias("go"), "_b.excl_gene", F.col("_b.enrich").alias("excl_enrich"), *[F.col("_b.se_enrich").alias("se_excl_enrich")] * bool(more))


def gene_lists(classified: DataFrame) -> DataFrame:
    """The genes of each set in code-point order, repeated ones kept; rows with a missing enrichment count too."""
    loo = classified.where(F.col("class") == "loo")
    return loo.groupBy(F.col("set_go").alias("go")).agg(F.array_join(F.array_sort(F.collect_list("excl_gene")), " ").alias("gene_list"))


def main_sets(classified: DataFrame, pruned: DataFrame | None = None, least_genes: int = 5, legacy_prune: bool = False) -> DataFrame:
    """Sets with enough genes that are not on the prune list.

    `legacy_prune` compares names with the list's column headings instead of
    its values, as the published tables were made.
    """
    sets = classified.where((F.col("class") == "set") & (F.col("ngenes") >= least_genes)).drop("class", "set_go", "excl_gene")
    if pruned is None:
        return sets
    if legacy_prune:
        return sets.where(~F.col("go").isin(*pruned.columns))
    return sets.join(pruned.select(F.col(f"`{pruned.columns[0]}`").alias("go")), "go", "left_anti")


@dataclass
class Tables:
    sets: DataFrame
    genes: DataFrame
    n_names: DataFrame  # one row: how many different names the set-level P table has


def build(results: DataFrame, magma_sets: DataFrame, magma_genes: DataFrame, pruned: DataFrame | None = None, legacy_prune: bool = False) -> Tables:
    """The two joined tables.  The right sides are small and Spark broadcasts those it measures as such."""
    rows = classify(h2_fractions(ingest(results)))
    sets = main_sets(rows, pruned, legacy_prune=legacy_prune)
    by_name = magma_sets.toDF(*[c.lower() for c in magma_sets.columns]).select(F.col("full_name").alias("go"), F.col("p").alias("magma_p"))
    sets = sets.join(worst_loo(rows), "go", "left").join(nan_to_null(by_name), "go", "left").join(gene_lists(rows), "go", "left")
    per_gene = magma_genes.toDF(*[c.lower() for c in magma_genes.columns]).select(F.col("gene").cast("string").alias("go"), F.col("p").alias("magma_p"))
    genes = rows.where(F.col("class") == "gene").drop("class", "set_go", "excl_gene", "ngenes").join(nan_to_null(per_gene), "go", "left").withColumnRenamed("go", "gene")
    # A missing name counts as one more name.
    names = by_name.agg((F.count_distinct("go") + F.max(F.col("go").isNull().cast("int"))).alias("n"))
    return Tables(sets, genes, names)


def bonferroni(sets: DataFrame, n_names: DataFrame, level: float = 0.05) -> DataFrame:
    return sets.join(F.broadcast(n_names.select(F.col("n").alias("_n"))), F.col("magma_p") < F.try_divide(F.lit(level), F.col("_n"))).drop("_n")


def small_rank(df: DataFrame, by: str = "magma_p", name: str = "go") -> DataFrame:
    """Row numbers by ascending P, missing last, ties by name: one window, for a report of a few thousand rows (after the filters)."""
    return df.withColumn("magma_rank", F.row_number().over(W.orderBy(F.col(by).asc_nulls_last(), name)).cast("long"))


def report_st5(t: Tables) -> DataFrame:
    """Sets significant by MAGMA with their rank, by enrichment."""
    df = small_rank(bonferroni(t.sets, t.n_names))
    return reorder(df.drop("h2", "se_h2", "model_aic", "loglike_diff", "loglike_df"), ORDER).orderBy(F.col("enrich").desc_nulls_last(), "go")


def report_st7(t: Tables) -> DataFrame:
    """Sets that the model's AIC supports, by enrichment."""
    return reorder(t.sets.where(F.col("model_aic") > 0).drop("h2", "se_h2", "magma_p"), ORDER).orderBy(F.col("enrich").desc_nulls_last(), "go")


def report_st9(t: Tables) -> DataFrame:
    """Genes that the model's AIC supports, by AIC."""
    return reorder(t.genes.where(F.col("model_aic") > 0).drop("magma_p"), ORDER).orderBy(F.col("model_aic").desc_nulls_last(), "gene")


def format_report(df: DataFrame) -> DataFrame:
    """Numbers as the report's texts; other columns as they are."""
    return df.select(*[formatted(c).alias(c) for c in df.columns])


def headed(df: DataFrame, model: str = "MODEL") -> DataFrame:
    """Column headings as published tables have them: GO, GENE, NGENES and significance columns in capitals, the rest as it is.

    `model` is the heading's first part for the model's own columns, such as the name of the tool.
    """
    capital = {c: c.upper() for c in ("go", "gene", "ngenes", "gene_list", "magma_p", "magma_rank")}
    capital |= {"excl_gene": "excl_GENE"} | {f"model_{x}": f"{model}_{x.upper()}" for x in ("aic", "p", "q", "fdr")}
    return df.withColumnsRenamed({a: b for a, b in capital.items() if a in df.columns})


def set_heritability(variants: DataFrame, membership: DataFrame, total: str = "coding_genes") -> DataFrame:
    """Heritability per gene set from per-variant values: go, snps, h2, h2_base, enrich.

    `variants`: snp, h2, h2_base; `membership`: go, snp, repeated pairs counted
    once.  Enrichment is the set's h2 / h2_base over that of the `total` row.
    """
    per = membership.select("go", "snp").distinct().join(variants, "snp").groupBy("go").agg(F.count(F.lit(1)).alias("snps"), F.sum("h2").alias("h2"), F.sum("h2_base").alias("h2_base"))
    whole = per.where(F.col("go") == total).select((F.col("h2") / F.col("h2_base")).alias("_t"))  # one row
    return per.join(F.broadcast(whole), how="left").withColumn("enrich", F.try_divide(F.col("h2") / F.col("h2_base"), F.col("_t"))).drop("_t")

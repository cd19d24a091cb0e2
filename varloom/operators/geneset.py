"""Gene-set analysis on per-variant statistics: base model, set tests, leave-one-gene-out rows.

The tool's own estimator (an LD-aware likelihood with an adaptive optimiser)
is not in public documentation here.  Ours is its documented frame with
closed forms, on independent variants:

* base: all variants in coding genes share one variance of z;
* full: a set has a variance of its own.  Its log likelihood over the base's
  gives loglike_diff, loglike_df = 1 and loglike_aic = 2 diff - 2 df;
  A set whose z are all 0 has no finite likelihood; its columns are null;
* h2 is the moment estimate, the sum of (z^2 - 1) / n; h2_base what the base
  model expects of the same variants; enrich the ratio of the two, over that
  ratio for all coding genes;
* se_h2 and se_enrich by a jackknife over chromosomes.

The result has the layout that `enrich.build` reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.operators import ranges, spans
from varloom.sources.shared import written

TOTAL = "coding_genes"


def _sums(z: Column, n: Column) -> dict[str, Column]:
    return {"snps": F.count(F.lit(1)), "s2": F.sum(z * z), "h2": F.sum((z * z - 1.0) / n), "inv_n": F.sum(1.0 / n)}


def fit_inputs(variants: DataFrame, gene_variants: DataFrame, sets: DataFrame, annotation: DataFrame | None = None) -> DataFrame:
    """go, gene, snp, chr, z, n (and category): variants x genes x sets, all equi-joins.

    `gene_variants` (gene, snp) comes from the interval join; `sets` has go, gene.
    """
    out = gene_variants.select("gene", "snp").distinct().join(variants.select("snp", "chr", "z", "n"), "snp").join(sets.select("go", "gene").distinct(), "gene")
    return out.join(annotation.select("snp", "category"), "snp", "left") if annotation is not None else out


def base_model(inputs: DataFrame) -> dict[str, float]:
    """Parameters of the base model: sums over all variants in coding genes.  They are what `analyse` loads."""
    z, n = F.col("z"), F.col("n")
    snps = usable_rows(inputs).select("snp", "z", "n").dropDuplicates(["snp"])
    row = snps.agg(*[v.alias(k) for k, v in _sums(z, n).items()]).first()
    return {k: float(row[k] or 0) for k in ("snps", "s2", "h2", "inv_n")}


def usable_rows(inputs: DataFrame) -> DataFrame:
    z, n = F.col("z"), F.col("n")
    return inputs.where(z.isNotNull() & n.isNotNull() & ~F.isnan(z) & (n > 0))


def analyse(inputs: DataFrame, base: dict[str, float] | None = None) -> DataFrame:
    """The enrichment table of `inputs` (go, gene, snp, chr, z, n): sets, their leave-one-out rows, genes, and coding_genes.

    `base` are parameters of a base model fitted before (else these inputs' own).
    What several branches read is written once in the shared folder.  One shuffle by (go, snp) finds variants that several genes of a set hold;
    everything after it is a sum per (go, gene, chromosome) or smaller.
    """
    z, n = F.col("z"), F.col("n")
    usable = written(usable_rows(inputs), "gene-set-inputs")
    # Variants of a set once each, with the gene if one gene alone holds it.
    per = _holders(usable)
    cells = written(_cells(per), "gene-set-cells")
    per_gene = _per_gene(usable)
    return _table(cells, usable.select("go", "gene").distinct(), per_gene, base or base_model(usable))


NAMES = ["snps", "s2", "h2", "inv_n"]


def _holders(usable: DataFrame) -> DataFrame:
    """Variants of a set once each, with the number of its genes that hold them and the first of these."""
    return usable.groupBy("go", "snp").agg(F.count_distinct("gene").alias("holders"), F.min("gene").alias("gene"), F.first("chr").alias("chr"), F.first("z").alias("z"), F.first("n").alias("n"))


def _cells(per: DataFrame) -> DataFrame:
    """Sums of each set by the gene that alone holds a variant (else null) and chromosome."""
    return per.groupBy("go", F.when(F.col("holders") == 1, F.col("gene")).alias("gene"), "chr").agg(*[v.alias(k) for k, v in _sums(F.col("z"), F.col("n")).items()])


def _per_gene(usable: DataFrame) -> DataFrame:
    return usable.select("gene", "snp", "z", "n").dropDuplicates(["gene", "snp"]).groupBy("gene").agg(*[v.alias(k) for k, v in _sums(F.col("z"), F.col("n")).items()])


def analyse_at(variants: DataFrame, genes: DataFrame, sets: DataFrame, flank: int = 0, base: dict[str, float] | None = None) -> DataFrame:
    """As `analyse` of variants (snp, chr, bp, z, n), genes (gene, chr, gstart, gend) and sets (go, gene), without their product.

    A gene's sums are sums over its interval.  Each set's genes are swept once:
    where one of them lies alone its variants are held by it only, so the sums
    over the swept pieces are the cells.  Variants with several positions go
    through the pairs, as one gene may meet them twice.
    """
    z, n = F.col("z"), F.col("n")
    number = {"snps": F.lit(1).cast("long"), "s2": z * z, "h2": (z * z - 1.0) / n, "inv_n": 1.0 / n}
    known = usable_rows(variants)
    one, several = spans.one_place(variants)
    points = written(known.dropDuplicates(["snp"]).select("snp", "z", "n").join(one, "snp").select("chr", "bp", *[v.alias(k) for k, v in number.items()]), "gene-set-points")
    in_sets = sets.select("go", "gene").distinct()
    wide = spans.widened(genes.join(in_sets.select("gene").distinct(), "gene", "left_semi"), flank)
    numbers = written(wide.select("gene").distinct().withColumn("number", F.monotonically_increasing_id()), "gene-set-genes")
    wide = written(wide.join(numbers, "gene"), "gene-set-spans")
    per_gene = spans.interval_sums(points, wide, NAMES, ["gene"])
    pieces = spans.layers(wide.join(in_sets, "gene").select("go", "chr", "lo", "hi", "number"), "go", "number")
    cells = spans.interval_sums(points, pieces.withColumn("on", F.col("chr").cast("string")), NAMES, ["go", "on", "alone"])
    cells = cells.join(numbers.withColumnRenamed("number", "alone"), "alone", "left").select("go", "gene", F.col("on").alias("chr"), *NAMES)
    all_genes = spans.layers(wide.select(F.lit(TOTAL).alias("go"), "chr", "lo", "hi", F.lit(0).cast("long").alias("number")), "go", "number")
    total = spans.interval_sums(points, all_genes, NAMES, ["go"]).select(*NAMES)
    # The few variants of several positions, by pairs.
    met = ranges.interval_join(several, wide, start="lo", end="hi").select("gene", "snp").distinct()
    rest = written(met.join(known.dropDuplicates(["snp"]).select("snp", F.col("chr").cast("string").alias("chr"), "z", "n"), "snp").join(in_sets, "gene"), "gene-set-rest")
    add = lambda a, b, k: a.select(*k, *NAMES).unionByName(b.select(*k, *NAMES)).groupBy(*k).agg(*[F.sum(c).alias(c) for c in NAMES])
    cells = written(add(cells, _cells(_holders(rest)), ["go", "gene", "chr"]), "gene-set-cells")
    per_gene = written(add(per_gene, _per_gene(rest), ["gene"]), "gene-set-per-gene")
    fitted = base
    if not fitted:
        extra = rest.select("snp", "z", "n").dropDuplicates(["snp"]).agg(*[v.alias(k) for k, v in _sums(z, n).items()])
        row = total.unionByName(extra).agg(*[F.sum(c).alias(c) for c in NAMES]).first()
        fitted = {k: float(row[k] or 0) for k in NAMES}
    return _table(cells, in_sets.join(per_gene.select("gene"), "gene").select("go", "gene"), per_gene, fitted)


def _table(cells: DataFrame, members: DataFrame, per_gene: DataFrame, fitted: dict[str, float]) -> DataFrame:
    """The enrichment table: `cells` (go, gene that alone holds or null, chr, sums), `members` (go, gene with variants), `per_gene` (gene, sums)."""
    names = NAMES
    by_chr = cells.groupBy("go", "chr").agg(*[F.sum(c).alias(c) for c in names])
    genes_of = members.groupBy("go").agg(F.count(F.lit(1)).alias("ngenes"))
    t = {f"t_{c}": F.lit(fitted[c]) for c in names}  # four numbers

    def row(df: DataFrame) -> DataFrame:
        """Model columns from sums and the totals."""
        base = F.col("t_s2") / F.col("t_snps")
        own = F.col("s2") / F.col("snps")
        out = df.withColumns(t).withColumns(
            {
                "h2_base": (base - 1.0) * F.col("inv_n"),
                "loglike_diff": -0.5 * F.col("snps") * (F.ln(own) - F.ln(base) + 1.0 - own / base),
            }
        )
        ratio = F.try_divide("h2", "h2_base")
        total = F.try_divide(F.col("t_h2"), (base - 1.0) * F.col("t_inv_n"))
        return out.withColumns({"enrich": F.try_divide(ratio, total), "loglike_df": F.lit(1.0)}).withColumn("loglike_aic", 2.0 * F.col("loglike_diff") - 2.0)

    sets = by_chr.groupBy("go").agg(*[F.sum(c).alias(c) for c in names]).join(genes_of, "go")
    # Jackknife: the set's sums without one chromosome each (at most as many rows a set as chromosomes).
    left_out = by_chr.join(sets.select("go", *[F.col(c).alias(f"a_{c}") for c in names]), "go").select("go", *[(F.col(f"a_{c}") - F.col(c)).alias(c) for c in names])
    jack = row(left_out.where(F.col("snps") > 0)).groupBy("go").agg(F.count(F.lit(1)).alias("k"), *[F.var_pop(c).alias(f"v_{c}") for c in ("h2", "enrich")])
    spread = jack.select("go", *[F.sqrt((F.col("k") - 1) * F.col(f"v_{c}")).alias(f"se_{c}") for c in ("h2", "enrich")])
    # Leave one gene out: the set's sums less those of variants that this gene alone holds.
    alone = cells.where(F.col("gene").isNotNull()).groupBy("go", "gene").agg(*[F.sum(c).alias(f"g_{c}") for c in names])
    loo = members.join(alone, ["go", "gene"], "left").join(sets, "go").where(F.col("ngenes") > 1)
    loo = loo.select(F.concat("go", F.lit("_excl_"), "gene").alias("go"), *[(F.col(c) - F.coalesce(f"g_{c}", F.lit(0))).alias(c) for c in names], (F.col("ngenes") - 1).alias("ngenes"))
    of_genes = per_gene.select(F.col("gene").alias("go"), *names, F.lit(1).cast("long").alias("ngenes"))
    n_all = members.agg(F.count_distinct("gene").alias("ngenes"))
    total = n_all.select(F.lit(TOTAL).alias("go"), *[F.lit(fitted[c]).cast("long" if c == "snps" else "double").alias(c) for c in names], "ngenes")
    every = sets.select("go", *names, "ngenes").unionByName(loo).unionByName(of_genes).unionByName(total)
    modelled = row(every.where(F.col("snps") > 0)).join(spread, "go", "left")
    return modelled.select("go", "ngenes", "snps", "enrich", "se_enrich", "h2", "se_h2", "h2_base", "loglike_aic", "loglike_diff", "loglike_df")


def gene_z(variants: DataFrame, gene_variants: DataFrame) -> DataFrame:
    """gene, nsnps, mean_chi2, z, p of each gene, from the sum of its variants' squared z.

    For independent variants that sum is chi-square with nsnps degrees of
    freedom; the cube root of its mean is normal to a good approximation
    (Wilson and Hilferty).  The public tool also weighs by LD; its code is not
    in the reference, so its P values are not claimed.
    """
    per = gene_variants.select("gene", "snp").distinct().join(variants.select("snp", "z").where(F.col("z").isNotNull() & ~F.isnan("z")), "snp")
    return _gene_tests(per.groupBy("gene").agg(F.count(F.lit(1)).alias("nsnps"), F.avg(F.col("z") * F.col("z")).alias("mean_chi2")))


def gene_z_at(variants: DataFrame, places: DataFrame, genes: DataFrame, flank: int = 0) -> DataFrame:
    """As `gene_z` of variants (snp, z), their places (snp, chr, bp) and genes (gene, chr, gstart, gend), by sums over intervals.

    Variants with several positions go through the pairs, as one gene may meet them twice.
    """
    known = variants.select("snp", "z").where(F.col("z").isNotNull() & ~F.isnan("z")).withColumns({"nsnps": F.lit(1).cast("long"), "stat": F.col("z") * F.col("z")})
    one, several = spans.one_place(places)
    wide = spans.widened(genes, flank)
    sums = spans.interval_sums(known.join(one, "snp").select("chr", "bp", "nsnps", "stat"), wide, ["nsnps", "stat"], ["gene"])
    met = ranges.interval_join(several, wide, start="lo", end="hi").select("gene", "snp").distinct().join(known, "snp").select("gene", "nsnps", "stat")
    both = sums.unionByName(met).groupBy("gene").agg(F.sum("nsnps").alias("nsnps"), F.sum("stat").alias("stat"))
    return _gene_tests(both.select("gene", "nsnps", (F.col("stat") / F.col("nsnps")).alias("mean_chi2")))


def _gene_tests(sums: DataFrame) -> DataFrame:
    spread = 2.0 / (9.0 * F.col("nsnps"))
    out = sums.withColumn("z", (F.cbrt("mean_chi2") - (1.0 - spread)) / F.sqrt(spread))
    return out.withColumn("p", upper_tail(F.col("z")))


def upper_tail(z: Column) -> Column:
    from varloom.operators.figures import _upper

    return F.when(z >= 0, _upper(z)).otherwise(1.0 - _upper(-z))


def set_regression(genes: DataFrame, sets: DataFrame, least_genes: int = 2) -> DataFrame:
    """go, ngenes, beta, se, p: the competitive test, a regression of gene z on membership in the set (one-sided).

    `genes`: gene, z; `sets`: go, gene.  Only sums are needed: of all genes
    (one row) and of each set's genes.
    """
    known = genes.where(F.col("z").isNotNull()).select("gene", "z")
    total = known.agg(F.count(F.lit(1)).alias("t_n"), F.sum("z").alias("t_s"), F.sum(F.col("z") * F.col("z")).alias("t_q"))
    per = sets.select("go", "gene").distinct().join(known, "gene").groupBy("go").agg(F.count(F.lit(1)).alias("ngenes"), F.sum("z").alias("s"))
    n, m = F.col("t_n"), F.col("ngenes")
    inside, outside = F.col("s") / m, F.try_divide(F.col("t_s") - F.col("s"), n - m)
    left = F.col("t_q") - m * inside * inside - (n - m) * outside * outside  # residual sum of squares
    out = per.crossJoin(F.broadcast(total)).where((m >= least_genes) & (n > m) & (n > 2)).withColumns({"beta": inside - outside, "se": F.sqrt(F.greatest(left, F.lit(0.0)) / (n - 2) * (1.0 / m + 1.0 / (n - m)))})
    return out.select("go", "ngenes", "beta", "se", upper_tail(F.try_divide("beta", "se")).alias("p"))

"""Steps of a study as functions from files to files, one for each command of the workflow.

Names and parameters follow the workflow's commands; what they compute is in
`varloom.operators`.  Paths may lie in any store that Spark reads.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom import schema as S
from varloom.operators import band, enrich, figures, geneset, genetests, gradient, harmonize, linked, mixture, models, ranges
from varloom.operators import ld as ldops
from varloom.sources import readers, sinks


def process_sumstats(spark: SparkSession, path: str, out: str, *, rename: dict[str, str] | None = None, cases: float | None = None, controls: float | None = None) -> None:
    """Harmonise a raw table: N and Z from counts, P and OR where they are given; no MHC, no X; gzip TSV."""
    raw = readers.whitespace(spark, path, comment="")
    raw = raw.withColumnsRenamed(rename or {})
    if cases is not None and controls is not None:
        raw = harmonize.from_case_control(raw.withColumns({"P": F.col("P").try_cast("double"), "OR": F.col("OR").try_cast("double")}), cases, controls)
    df = S.resolve_headers(raw)
    typed = df.select(*[(F.col(f"`{f.name}`").try_cast(f.dataType)).alias(f.name) for f in S.SUMSTATS])
    harmonize.assert_disjoint(typed, "CHR", "BP")
    sinks.write_tsv(harmonize.clean(S.nan_to_null(typed)), out, [f.name for f in S.SUMSTATS])


def split_sumstats(spark: SparkSession, trait1_file: str, out: str, chr2use: str | None = None) -> None:
    df = readers.sumstats(spark, trait1_file)
    sinks.write_by_chromosome(df, out, "CHR", ranges.parse_chromosomes(chr2use) if chr2use else None)


def ld(spark: SparkSession, bfile: str, out: str, *, chr2use: str | None = None, r2min: float = 0.05, ldscore_r2min: float = 0.001, ld_window_kb: int = 1000) -> None:
    """Pairs of r2 of at least r2min by chromosome below out/pairs, and LD scores with allele frequencies below out/scores.

    r2 is that of the samples called at both variants.
    """
    chroms = ranges.parse_chromosomes(chr2use) if chr2use else None
    parts, most = [], 0
    for prefix in readers.expand_chromosomes(bfile, chroms):
        samples = readers.fam(spark, f"{prefix}.fam").count()
        most = max(most, samples)
        genotypes = readers.bed(spark, f"{prefix}.bed", samples)
        # A .bim file's lines are in the order of the .bed file; one small file a chromosome.
        lines = spark.read.text(f"{prefix}.bim", wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("i", "line")).where(F.trim("line") != "")
        c = F.split(F.trim("line"), r"\s+")
        names = lines.select(F.col("i").cast("long").alias("i"), c[0].try_cast("int").alias("chr"), c[1].alias("snp"), c[3].try_cast("long").alias("bp"))
        parts.append(names.join(genotypes.drop("file"), "i"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    filled = ldops.genotype_vectors(rows)
    mean = F.aggregate("g", F.lit(0.0), lambda a, x: a + x) / F.size("g") / 2
    maf = filled.select("chr", "snp", F.least(mean, 1 - mean).alias("maf"))
    window = band.genotype_pairs(rows, ld_window_kb * 1000, min(r2min, ldscore_r2min), tile=band.tile_rows(most)).drop("n")
    sinks.write_library(window.where(F.col("r2") >= r2min), f"{out}/pairs")
    score = ldops.ld_score(window, ldscore_r2min, own=True)
    maf.join(score.withColumnRenamed("i", "snp"), "snp", "left").select("chr", "snp", "maf", F.coalesce("ld_score", F.lit(1.0)).alias("ld_score")).write.mode("overwrite").partitionBy("chr").parquet(f"{out}/scores")


def snps(spark: SparkSession, ld_out: str, out: str, *, r2: float = 0.8, maf: float = 0.05, subset: int = 2_000_000, seed: int = 1, replicates: int = 1, chr2use: str | None = None) -> None:
    """Randomly pruned lists, one file group a replicate: out/rep=1, ..."""
    chroms = ranges.parse_chromosomes(chr2use) if chr2use else None
    variants = readers.library(spark, f"{ld_out}/scores", chroms)
    pairs = readers.library(spark, f"{ld_out}/pairs", chroms)
    ldops.prune_replicates(variants, pairs, r2, replicates, seed, maf=maf, n=subset, key="snp").select("rep", F.col("snp").alias("value")).write.mode("overwrite").partitionBy("rep").text(out)


def _study(df: DataFrame, extract: DataFrame | None, exclude_ranges: str, chr2use: str | None) -> DataFrame:
    df = ranges.exclude_ranges(df, ranges.parse_ranges(exclude_ranges), "CHR", "BP")
    if chr2use:
        df = df.where(F.col("CHR").cast("string").isin([str(c) for c in ranges.parse_chromosomes(chr2use)]))
    if extract is not None:
        df = df.join(extract.select("SNP"), "SNP", "left_semi")
    return df.where(harmonize.defined(F.col("N"), F.col("Z")))


def _put(spark: SparkSession, document: dict, out: str) -> None:
    spark.createDataFrame([(json.dumps(document),)], "value string").coalesce(1).write.mode("overwrite").text(out)


def _params(spark: SparkSession, path: str) -> dict[str, float]:
    return json.loads(spark.read.text(path).first()[0])["params"]


def _panel(spark: SparkSession, ld_out: str, chr2use: str | None) -> tuple[DataFrame, DataFrame]:
    """The panel (SNP, het) and its pairs from what `ld` has written."""
    chroms = ranges.parse_chromosomes(chr2use) if chr2use else None
    scores = readers.library(spark, f"{ld_out}/scores", chroms)
    return scores.select(F.col("snp").alias("SNP"), (2.0 * F.col("maf") * (1.0 - F.col("maf"))).alias("het")), readers.library(spark, f"{ld_out}/pairs", chroms)


def fit1(spark: SparkSession, trait1_file: str, out: str, *, extract: str | None = None, exclude_ranges: str = "MHC", chr2use: str | None = None, load_params: str | None = None, ld_out: str | None = None, fit_sequence: tuple[str, ...] = ("diffevo", "neldermead"), diffevo_fast_repeats: int = 1, seed: int = 1, states: str | None = None) -> None:
    """Fit one trait; a result document with parameters and costs.

    With `ld_out` (the folder of `ld`) the likelihood takes LD into account,
    `fit_sequence` names the optimisers, and `states` is a folder from which a
    fit that was stopped goes on.  Without, variants count as independent.
    """
    df = _study(readers.sumstats(spark, trait1_file), readers.snp_list(spark, extract) if extract else None, exclude_ranges, chr2use)
    start = {k: v for k, v in _params(spark, load_params).items() if k in ("pi", "sig2_beta", "sig2_zero")} if load_params else None
    if ld_out:
        panel, pairs = _panel(spark, ld_out, chr2use)
        tags = df.select("SNP", F.col("Z").alias("z"), F.col("N").alias("n"))
        r = linked.fit_univariate(tags, panel, pairs, key="SNP", fit_sequence=tuple(fit_sequence), repeats=diffevo_fast_repeats, start=start, seed=seed, store=states).first()
        options = {"sum_weights": r["sum_weights"], "num_snp": r["num_snp"], "totalhet": r["totalhet"]}
    else:
        r = mixture.fit_univariate(df, "Z", "N", start).first()
        options = {"sum_weights": r["n"], "num_snp": r["n"], "totalhet": r["n"]}
    _put(spark, {"options": options, "params": {k: r[k] for k in ("pi", "sig2_beta", "sig2_zero")}, "optimize": [["infinitesimal", {"fun": r["cost_infinitesimal"]}], ["mixture", {"fun": r["cost"], "success": r["converged"]}]], "criteria": {"aic": r["aic"], "bic": r["bic"]}}, out)


def test1(spark: SparkSession, trait1_file: str, load_params: str, out: str, *, exclude_ranges: str = "MHC", chr2use: str | None = None, ld_out: str | None = None) -> None:
    """Apply fitted parameters to all variants: posteriors as a table (with `ld_out` also costs, under LD)."""
    df = _study(readers.sumstats(spark, trait1_file), None, exclude_ranges, chr2use)
    if ld_out:
        panel, pairs = _panel(spark, ld_out, chr2use)
        rows = linked.spectra(df.select("SNP", F.col("Z").alias("z"), F.col("N").cast("double").alias("n")), panel, pairs, "SNP")
        linked.costs(rows, _params(spark, load_params), "SNP").write.mode("overwrite").parquet(out)
        return
    mixture.apply_univariate(df, _params(spark, load_params), "Z", "N").write.mode("overwrite").parquet(out)


def _pair(spark: SparkSession, trait1_file: str, trait2_file: str, exclude_ranges: str, chr2use: str | None, extract: DataFrame | None = None) -> DataFrame:
    a, b = (_study(readers.sumstats(spark, f), extract, exclude_ranges, chr2use) for f in (trait1_file, trait2_file))
    b = b.select("SNP", F.col("A1").alias("B1"), F.col("A2").alias("B2"), F.col("Z").alias("z2"), F.col("N").alias("n2"))
    both = a.join(b, "SNP")
    from varloom.functions.alleles import ambiguous, pair_key, swapped

    fits = both.where((pair_key(F.col("A1"), F.col("A2")) == pair_key(F.col("B1"), F.col("B2"))) & ~ambiguous(F.col("A1"), F.col("A2")))
    turned = F.when(swapped(F.col("B1"), F.col("B2"), F.col("A1"), F.col("A2")), -F.col("z2")).otherwise(F.col("z2"))
    return fits.select("SNP", F.col("Z").alias("z1"), turned.alias("z2"), F.col("N").alias("n1"), "n2")


def fit2(spark: SparkSession, trait1_file: str, trait2_file: str, trait1_params: str, trait2_params: str, out: str, *, extract: str | None = None, exclude_ranges: str = "MHC", chr2use: str | None = None, ld_out: str | None = None, points: int = 21) -> None:
    """Fit a pair from its traits' documents, under LD with `ld_out`.

    The document's third step, brute1, is the overlap curve: the costs on a
    grid of pi12 from the least overlap that the genetic correlation allows to
    the greatest; brent1 is the best overlap.
    """
    df = _pair(spark, trait1_file, trait2_file, exclude_ranges, chr2use, readers.snp_list(spark, extract) if extract else None)
    one, two = _params(spark, trait1_params), _params(spark, trait2_params)
    if ld_out:
        panel, pairs = _panel(spark, ld_out, chr2use)
        r = linked.fit_bivariate(df, panel, pairs, one, two, key="SNP", points=points)
        size = panel.agg(F.count(F.lit(1)), F.sum("het")).first()
        options = {"sum_weights": r["sum_weights"], "num_snp": size[0], "totalhet": size[1]}
    else:
        r = mixture.fit_bivariate(df, one, two, points=points).first().asDict()
        options = {"sum_weights": r["n"], "num_snp": r["n"], "totalhet": r["n"]}
    curve = {"grid": r["grid"], "Jout": r["jout"], "fun": min(r["jout"])}
    best = {"fun": r["cost"], "x": r["pi12"], "success": r["converged"]}
    _put(spark, {"options": options, "params": {"pi12": r["pi12"], "rho_beta": r["rho_beta"], "rho_zero": r["rho_zero"], "pi1u": one["pi"], "pi2u": two["pi"]}, "optimize": [["inft", {"fun": r["jout"][-1]}], ["fit", {"fun": r["cost"]}], ["brute1", curve], ["brent1", best]]}, out)


def test2(spark: SparkSession, trait1_file: str, trait2_file: str, trait1_params: str, trait2_params: str, load_params: str, out: str, *, exclude_ranges: str = "MHC", chr2use: str | None = None, ld_out: str | None = None) -> None:
    """Apply a pair's parameters to all variants: costs as a table."""
    df = _pair(spark, trait1_file, trait2_file, exclude_ranges, chr2use)
    one, two, both = (_params(spark, f) for f in (trait1_params, trait2_params, load_params))
    if ld_out:
        panel, pairs = _panel(spark, ld_out, chr2use)
        rows = linked.spectra(df.withColumns({c: F.col(c).cast("double") for c in ("z1", "z2", "n1", "n2")}), panel, pairs, "SNP", bins=8)
        linked.costs(rows, linked.pair_params(one, two, both["pi12"], both["rho_beta"], both["rho_zero"]), "SNP").select("SNP", "cost").write.mode("overwrite").parquet(out)
        return
    mixture.apply_bivariate(df, one, two, both).write.mode("overwrite").parquet(out)


def plsa(spark: SparkSession, trait1_file: str, gene_loc: str, go_file: str, out: str, *, window_kb: int = 10, exclude_ranges: str = "MHC", chr2use: str | None = None, gsa_base: bool = False, load_params: str | None = None, pairs: str | None = None, hardprune_r2: float | None = None, seed: int = 1) -> None:
    """Gene-set analysis of one trait.

    `gsa_base`: fit the base model on all coding genes, write its parameters
    as a document.  Else the full analysis, with the base model of
    `load_params` if given: the enrichment table as TSV.  `hardprune_r2` with
    `pairs` (a library of correlated pairs by variant name) first leaves a
    random set of variants without a pair of that r2.
    """
    df = _study(readers.sumstats(spark, trait1_file), None, exclude_ranges, chr2use).select(F.col("SNP").alias("snp"), F.col("CHR").cast("string").alias("chr"), F.col("BP").alias("bp"), F.col("Z").alias("z"), F.col("N").alias("n"))
    if hardprune_r2 is not None and pairs:
        df = harmonize.extract(df, ldops.random_prune(df.select("snp"), readers.library(spark, pairs), hardprune_r2, seed=seed, key="snp"))
    held = ranges.interval_join(df, readers.gene_locations(spark, gene_loc), flank=window_kb * 1000)
    sets = readers.gene_sets(spark, go_file).select(F.col("GO").alias("go"), F.col("GENE").alias("gene"))
    inputs = geneset.fit_inputs(df, held.select("gene", "snp"), sets)
    if gsa_base:
        _put(spark, {"params": geneset.base_model(inputs)}, out)
        return
    table = geneset.analyse(inputs, _params(spark, load_params) if load_params else None)
    sinks.write_tsv(table.withColumnsRenamed({"go": "GO", "ngenes": "NGENES"}), out, compression=None)


def plsa_ld(spark: SparkSession, trait1_file: str, ld_out: str, out: str, *, gene_loc: str | None = None, go_file_test: str | None = None, annot_file: str | None = None, window_kb: int = 10, exclude_ranges: str = "MHC", chr2use: str | None = None, gsa_base: bool = False, load_params: str | None = None, adam_epoch: tuple[int, ...] = (60, 60, 60), adam_step: tuple[float, ...] = (0.25, 0.064, 0.016)) -> None:
    """Gene-set analysis under LD, by gradient descent on per-category effect variances.

    `gsa_base`: the categories are a base for all variants, all genes together
    (coding_genes) and the annotations of `annot_file`; a document with their
    parameters and the cost after each epoch.  Else each gene is one more
    category, beginning with the parameters of `load_params`; below `out`,
    theta (category, theta) and heritability (genes, the sets of `go_file_test`
    and coding_genes: category, snps, h2, enrich) as tables, and the document.
    """
    df = _study(readers.sumstats(spark, trait1_file), None, exclude_ranges, chr2use)
    panel, pairs = _panel(spark, ld_out, chr2use)
    panel = panel.withColumnRenamed("SNP", "snp")
    tags = df.select(F.col("SNP").alias("snp"), F.col("Z").alias("z"), F.col("N").alias("n"))
    members = panel.select("snp", F.lit("base").alias("category"))
    held = None
    if gene_loc:
        at = df.select(F.col("SNP").alias("snp"), F.col("CHR").cast("string").alias("chr"), F.col("BP").alias("bp"))
        held = ranges.interval_join(at, readers.gene_locations(spark, gene_loc), flank=window_kb * 1000).select("snp", "gene").distinct()
        members = members.unionByName(held.select("snp", F.lit(geneset.TOTAL).alias("category")).distinct())
    if annot_file:
        members = members.unionByName(readers.annotation(spark, annot_file).where(F.col("value") != 0).select(F.col("SNP").alias("snp"), "category"))
    start = None
    if load_params:
        start = spark.createDataFrame(sorted(_params(spark, load_params).items()), "category string, theta double")
    fitted = members
    if held is not None and not gsa_base:
        fitted = members.unionByName(held.select("snp", F.col("gene").alias("category")))
    theta, info = gradient.fit(tags, gradient.category_scores(pairs, fitted, panel), adam_epoch=tuple(adam_epoch), adam_step=tuple(adam_step), start=start)
    document = {"options": {"sum_weights": info["n"]}, "optimize": [["adam", {"Jout": info["trace"], "fun": info["cost"]}]]}
    if gsa_base:
        _put(spark, {**document, "params": {r["category"]: r["theta"] for r in theta.collect()}}, out)  # a few categories
        return
    _put(spark, document, f"{out}/document")
    theta.write.mode("overwrite").parquet(f"{out}/theta")
    # Heritability sums each variant's fitted variances; a set's variants are those of its genes.
    theta = spark.read.parquet(f"{out}/theta")
    h = fitted.distinct().join(theta, "category").groupBy("snp").agg(F.sum("theta").alias("theta")).select("snp", F.col("theta"))
    asked = fitted
    if go_file_test and held is not None:
        sets = readers.gene_sets(spark, go_file_test).select(F.col("GO").alias("category"), F.col("GENE").alias("gene")).distinct()
        asked = fitted.unionByName(held.join(sets, "gene").select("snp", "category"))
    gradient.heritability_of(h, asked, panel).write.mode("overwrite").parquet(f"{out}/heritability")


def perf(steps: dict[str, Callable[[], object]], repeat: int = 3) -> dict[str, float]:
    """Least seconds of each named step over some runs."""
    out = {}
    for name, step in steps.items():
        seconds = []
        for _ in range(repeat):
            began = time.perf_counter()
            step()
            seconds.append(time.perf_counter() - began)
        out[name] = min(seconds)
    return out


def gsa_tables(spark: SparkSession, go_test_enrich: str, magma_gsa: str, magma_genes: str, out: str, *, prune: str | None = None, legacy_prune: bool = False, model: str | None = None, workbook: bool = False) -> None:
    """The three report sheets ST5, ST7 and ST9 as formatted text: a folder each, or one workbook file.

    With `model` the headings are those of published tables, and `model` is the first part of the model's own.
    """
    t = enrich.build(readers.enrichment(spark, go_test_enrich), readers.whitespace(spark, magma_gsa, S.MAGMA_SETS), readers.whitespace(spark, magma_genes, S.MAGMA_GENES), readers.tsv(spark, prune) if prune else None, legacy_prune)
    # Both branches of the sheets read the joined sets; they are kept while the sheets are written.
    t.sets.persist()
    try:
        sheets = {name: enrich.headed(enrich.format_report(report(t)), model) if model else enrich.format_report(report(t)) for name, report in (("ST5", enrich.report_st5), ("ST7", enrich.report_st7), ("ST9", enrich.report_st9))}
        (sinks.write_xlsx if workbook else sinks.write_workbook)(sheets, out)
    finally:
        t.sets.unpersist()


def combine(spark: SparkSession, template: str, out: str) -> None:
    """All replicates' parameters, one row each, as a table: fname, rep and the document's numbers."""
    docs = readers.documents(spark, readers.expand_replicates(template))
    docs.select("fname", "rep", "json").write.mode("overwrite").parquet(out)


def one(spark: SparkSession, documents: str | list[str], trait1: str, out: str) -> None:
    """Report of one trait over its replicates' documents."""
    runs = models.univariate_runs(readers.documents(spark, documents).withColumn("trait1", F.lit(trait1)))
    sinks.write_tsv(models.univariate_table(runs, "trait1"), out, compression=None, files=1)


def two(spark: SparkSession, documents: str | list[str], trait1: str, trait2: str, out: str) -> None:
    """Report of a pair over its replicates' documents, with mean criteria."""
    docs = readers.documents(spark, documents).withColumns({"trait1": F.lit(trait1), "trait2": F.lit(trait2)})
    p = {c: models.get(f"$.params.{c}") for c in ("pi1u", "pi2u", "pi12", "rho_beta", "rho_zero")}
    runs = docs.withColumns({**p, "num_snp": models.get("$.options.num_snp")})
    table = models.bivariate_table(runs, "trait1", "trait2")
    crit = models.criteria(models.costs(docs)).groupBy("trait1", "trait2").agg(*[F.avg(f"best_vs_{m}_{c}").alias(f"best_vs_{m}_{c.upper()}") for m in ("min", "max") for c in ("aic", "bic")])
    sinks.write_tsv(table.join(crit, ["trait1", "trait2"]), out, compression=None, files=1)


def magma_annotate(spark: SparkSession, snp_loc: str, gene_loc: str, out: str, window_kb: int = 10) -> None:
    """Variants of each gene: gene, snp."""
    hit = ranges.interval_join(readers.snp_locations(spark, snp_loc), readers.gene_locations(spark, gene_loc), flank=window_kb * 1000)
    hit.select("gene", "snp").write.mode("overwrite").parquet(out)


def magma_gene(spark: SparkSession, pval: str, annotation: str, out: str, pairs: str | None = None) -> None:
    """Statistic of each gene: GENE, NSNPS, MEAN_CHI2, ZSTAT, P.

    With `pairs` (a library of correlated pairs by variant name) LD is taken
    into account, and what `magma_sets` needs of it is written to <out>.raw;
    without, variants count as independent.
    """
    p = readers.p_values(spark, pval).where((F.col("p") > 0) & (F.col("p") <= 1))
    from varloom.functions.normal import quantile_sql

    z = p.select("snp", F.expr(quantile_sql("(p / 2e0)")).alias("z"))
    held = spark.read.parquet(annotation)
    if pairs:
        linked_pairs = readers.library(spark, pairs)
        per = genetests.gene_statistics(z, held, linked_pairs).select("gene", "nsnps", (F.col("stat") / F.col("nsnps")).alias("mean_chi2"), "z", "p")
        genetests.shared_r2(held.join(z.select("snp"), "snp", "left_semi"), linked_pairs).write.mode("overwrite").parquet(f"{out}.raw")
    else:
        per = geneset.gene_z(z, held)
    sinks.write_tsv(per.toDF("GENE", "NSNPS", "MEAN_CHI2", "ZSTAT", "P"), out, compression=None)


def magma_sets(spark: SparkSession, gene_results: str, set_annot: str, out: str, gene_loc: str | None = None) -> None:
    """Competitive test of each set: FULL_NAME, NGENES, BETA, SE, P.

    With `gene_loc` and the <gene_results>.raw that `magma_gene` writes under
    LD: least squares over correlated genes, their size as covariate.
    """
    rows = readers.tsv(spark, gene_results).select(F.col("GENE").alias("gene"), F.col("NSNPS").try_cast("long").alias("nsnps"), F.col("ZSTAT").try_cast("double").alias("z"))
    sets = readers.set_annotation(spark, set_annot)
    if gene_loc:
        got = genetests.set_gls(rows.join(readers.gene_locations(spark, gene_loc), "gene"), sets, spark.read.parquet(f"{gene_results}.raw")).drop("z")
    else:
        got = geneset.set_regression(rows.select("gene", "z"), sets)
    sinks.write_tsv(got.toDF("FULL_NAME", "NGENES", "BETA", "SE", "P"), out, compression=None)


def qq(spark: SparkSession, trait1_file: str, out: str) -> None:
    """Data of a quantile-quantile figure of one trait (p from |Z| by its own normal tail)."""
    df = readers.sumstats(spark, trait1_file).where(harmonize.defined(F.col("N"), F.col("Z")))
    p = 2.0 * figures._upper(F.abs("Z"))
    figures.qq_data(df.select(F.greatest(p, F.lit(math.ulp(0.0))).alias("p"))).write.mode("overwrite").parquet(out)

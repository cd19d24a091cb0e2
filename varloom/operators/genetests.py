"""Gene and gene-set tests that know LD.

A gene's statistic is the sum of its variants' squared z.  Under the null, z of
a gene is normal with the LD matrix R as covariance, and the statistic is a sum
of chi-squares weighted by R's eigenvalues: its mean is the number of variants,
its variance twice the sum of r2 over all ordered pairs.  `gene_statistics`
matches these two moments to a scaled chi-square, of which the cube root is
normal to a good approximation; only sums of r2 are needed.  `saddlepoint`
takes the eigenvalues themselves, from signed correlations, and is right far
out in the tail.

Statistics of two genes are correlated by the r2 between their variants.
`set_gls` therefore tests a set by generalised least squares of gene z on
membership, with the logarithm of the gene's number of variants as covariate:
genes fall into blocks without correlation between them, a task inverts its
block's matrix, and the sums over blocks give all sets at once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from varloom.functions.normal import upper_tail
from varloom.sources.shared import written


def shared_r2(gene_variants: DataFrame, pairs: DataFrame) -> DataFrame:
    """gene_a, gene_b, r2: the sum of r2 over all ordered pairs of a variant of one gene and one of the other, a gene with itself included.

    `pairs`: i, j, r2, each unordered pair once.
    """
    numbers, lists = _gene_lists(gene_variants)
    both = pairs.where(F.col("i") != F.col("j")).select("i", "j", "r2")
    turned = both.select(F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("e"), "r2").select("e.i", "e.j", "r2")
    # A gene's r2 with each variant first, so that no row stands for two genes and a pair.
    near = turned.join(lists.withColumnRenamed("snp", "i"), "i").select(F.explode("genes").alias("a"), "j", "r2")
    near = near.unionByName(lists.select(F.explode("genes").alias("a"), F.col("snp").alias("j"), F.lit(1.0).alias("r2")))
    near = near.groupBy("a", "j").agg(F.sum("r2").alias("r2")).repartition("a")
    sums = near.join(lists.withColumnRenamed("snp", "j"), "j").select("a", F.explode("genes").alias("b"), "r2").groupBy("a", "b").agg(F.sum("r2").alias("r2"))
    named = lambda c: numbers.select(F.col("gene").alias(f"gene_{c}"), F.col("number").alias(c))
    return sums.join(named("a"), "a").join(named("b"), "b").select("gene_a", "gene_b", "r2")


def _gene_lists(gene_variants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gene, number; snp, genes: the numbers of the genes that hold it), both written."""
    gv = gene_variants.select("gene", "snp").distinct()
    numbers = written(gv.select("gene").distinct().withColumn("number", F.monotonically_increasing_id()), "genes")
    return numbers, written(gv.join(numbers, "gene").groupBy("snp").agg(F.array_sort(F.collect_list("number")).alias("genes")), "gene-lists")


def own_r2(gene_variants: DataFrame, pairs: DataFrame) -> DataFrame:
    """gene, r2: as `shared_r2` of each gene with itself.  A pair finds the genes that hold both by their lists."""
    numbers, lists = _gene_lists(gene_variants)
    of = lambda c: lists.select(F.col("snp").alias(c), F.col("genes").alias(f"genes_{c}"))
    both = pairs.where(F.col("i") != F.col("j")).select("i", "j", "r2").join(of("i"), "i").join(of("j"), "j")
    inside = both.select(F.explode(F.array_intersect("genes_i", "genes_j")).alias("number"), (2.0 * F.col("r2")).alias("r2"))
    alone = lists.select(F.explode("genes").alias("number"), F.lit(1.0).alias("r2"))
    return inside.unionByName(alone).groupBy("number").agg(F.sum("r2").alias("r2")).join(numbers, "number").select("gene", "r2")


def gene_statistics(variants: DataFrame, gene_variants: DataFrame, pairs: DataFrame) -> DataFrame:
    """gene, nsnps, stat, df (the effective number of independent variants), z, p."""
    known = variants.where(F.col("z").isNotNull() & ~F.isnan("z")).select("snp", "z")
    gv = gene_variants.select("gene", "snp").distinct().join(known, "snp")
    sums = gv.groupBy("gene").agg(F.count(F.lit(1)).alias("nsnps"), F.sum(F.col("z") * F.col("z")).alias("stat"))
    return by_moments(sums.join(own_r2(gv, pairs), "gene"))


def by_moments(sums: DataFrame) -> DataFrame:
    """The statistics of genes from their sums: gene, nsnps, stat, r2 (over all ordered pairs)."""
    n = F.col("nsnps")
    out = sums.withColumn("df", n * n / F.col("r2"))
    spread = 2.0 / (9.0 * F.col("df"))
    return out.withColumn("z", (F.cbrt(F.col("stat") / n) - (1.0 - spread)) / F.sqrt(spread)).withColumn("p", upper_tail(F.col("z"))).select("gene", "nsnps", "stat", "df", "z", "p")


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def weighted_chi2_tail(stat: float, weights: np.ndarray) -> float:
    """P(sum of weights * chi-square(1) > stat) by the saddle point (Lugannani and Rice)."""
    w = weights[weights > 1e-8 * weights.max()]
    if len(w) == 1:
        return math.erfc(math.sqrt(max(stat, 0.0) / w[0] / 2))
    mean, var = w.sum(), 2 * (w * w).sum()
    if stat <= 0:
        return 1.0
    slope = lambda s: float((w / (1 - 2 * s * w)).sum())
    high = 0.5 / w.max()
    lo, hi = -0.5 * len(w) / stat - 1.0 / stat, high * (1 - 1e-12)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if slope(mid) < stat else (lo, mid)
    s = (lo + hi) / 2
    if abs(stat - mean) < 1e-4 * math.sqrt(var):  # the formula is singular at the mean
        skew = 8 * (w**3).sum() / var**1.5
        return 0.5 - skew / (6 * math.sqrt(2 * math.pi))
    k = -0.5 * np.log1p(-2 * s * w).sum()
    r = math.copysign(math.sqrt(max(2 * (s * stat - k), 1e-300)), s)
    u = s * math.sqrt((2 * w * w / (1 - 2 * s * w) ** 2).sum())
    return float(min(1.0, max(0.0, _tail(r + math.log(u / r) / r))))


def saddlepoint(variants: DataFrame, gene_variants: DataFrame, pairs: DataFrame) -> DataFrame:
    """gene, nsnps, stat, p from the eigenvalues of each gene's correlation matrix.

    `pairs`: i, j, r (signed), each unordered pair once.  A gene's variants
    and pairs meet in one task: as many as lie within a gene.
    """
    known = variants.where(F.col("z").isNotNull() & ~F.isnan("z")).select("snp", "z")
    gv = gene_variants.select("gene", "snp").distinct().join(known, "snp")
    a, b = gv.select("gene", F.col("snp").alias("i")), gv.select("gene", F.col("snp").alias("j"))
    inside = pairs.where(F.col("i") != F.col("j")).select("i", "j", "r").join(a, "i").join(b, ["j", "gene"])
    none = F.lit(None)
    rows = gv.select("gene", F.col("snp").alias("i"), none.cast("string").alias("j"), F.col("z").alias("v")).unionByName(inside.select("gene", "i", "j", F.col("r").alias("v")))

    def run(table: pa.Table) -> pa.Table:
        i, j, v = (table.column(c).to_pylist() for c in ("i", "j", "v"))
        at = {s: k for k, s in enumerate(sorted({x for x, y in zip(i, j, strict=True) if y is None}))}
        r, z = np.eye(len(at)), np.zeros(len(at))
        for x, y, value in zip(i, j, v, strict=True):
            if y is None:
                z[at[x]] = value
            else:
                r[at[x], at[y]] = r[at[y], at[x]] = value
        weights = np.maximum(np.linalg.eigvalsh(r), 0.0)
        stat = float(z @ z)
        return pa.table({"gene": [table.column("gene")[0].as_py()], "nsnps": pa.array([len(at)], pa.int64()), "stat": [stat], "p": [weighted_chi2_tail(stat, weights)]})

    return rows.groupBy("gene").applyInArrow(run, "gene string, nsnps long, stat double, p double")


def gene_blocks(genes: DataFrame, shared: DataFrame) -> DataFrame:
    """gene, block: genes of a chromosome in the order of their starts, cut where no correlated pair reaches across (genes: gene, chr, gstart)."""
    order = W.partitionBy("chr").orderBy("gstart", "gene")  # the genes of one chromosome
    at = genes.select("gene", "chr", F.row_number().over(order).alias("at"))
    reach = shared.join(at.select(F.col("gene").alias("gene_a"), F.col("at").alias("x"), "chr"), "gene_a").join(at.select(F.col("gene").alias("gene_b"), F.col("at").alias("y"), F.col("chr").alias("chr_b")), "gene_b").where("chr = chr_b").groupBy("chr", F.least("x", "y").alias("at")).agg(F.max(F.greatest("x", "y")).alias("to"))
    by = W.partitionBy("chr").orderBy("at")
    far = at.join(reach, ["chr", "at"], "left").withColumn("to", F.max(F.coalesce("to", "at")).over(by.rowsBetween(W.unboundedPreceding, -1)))
    cut = far.withColumn("new", (F.col("to").isNull() | (F.col("to") < F.col("at"))).cast("int"))
    return cut.select("gene", F.concat_ws("/", F.col("chr").cast("string"), F.sum("new").over(by).cast("string")).alias("block"))


def set_gls(genes: DataFrame, sets: DataFrame, shared: DataFrame, least_genes: int = 2, shrink: float = 0.05) -> DataFrame:
    """go, ngenes, beta, se, z, p (one-sided) of each set.

    `genes`: gene, chr, gstart, nsnps, z; `sets`: go, gene; `shared`: from
    `shared_r2`.  The correlation matrix of a block is pulled towards the unit
    matrix by `shrink`, as pairs below the stored r2 are missing in it.
    """
    # Both are read several times, so they are written once.
    known, shared = written(genes.where(F.col("z").isNotNull() & ~F.isnan("z")), "gls-genes"), written(shared, "gls-shared")
    own = shared.where("gene_a = gene_b").select("gene_a", F.col("r2").alias("own"))
    scale = own.select(F.col("gene_a").alias("gene_b"), F.col("own").alias("own_b"))
    names = known.select("gene")
    near = shared.where("gene_a < gene_b").join(own, "gene_a").join(scale, "gene_b").select("gene_a", "gene_b", F.least(F.lit(1.0), F.col("r2") / F.sqrt(F.col("own") * F.col("own_b"))).alias("c"))
    near = near.join(names.withColumnRenamed("gene", "gene_a"), "gene_a").join(names.withColumnRenamed("gene", "gene_b"), "gene_b")
    block = gene_blocks(known, near)
    member = sets.select("go", "gene").distinct()
    none = lambda t: F.lit(None).cast(t)
    rows = known.join(block, "gene").select("block", F.lit(0).alias("kind"), "gene", none("string").alias("other"), F.col("z").cast("double").alias("v"), F.log(F.col("nsnps").cast("double")).alias("size"))
    rows = rows.unionByName(near.join(block.withColumnRenamed("gene", "gene_a"), "gene_a").select("block", F.lit(1).alias("kind"), F.col("gene_a").alias("gene"), F.col("gene_b").alias("other"), F.col("c").alias("v"), none("double").alias("size")))
    rows = rows.unionByName(member.join(block, "gene").select("block", F.lit(2).alias("kind"), "gene", F.col("go").alias("other"), none("double").alias("v"), none("double").alias("size")))

    def run(table: pa.Table) -> pa.Table:
        kind, gene, other, v, size = (table.column(c).to_pylist() for c in ("kind", "gene", "other", "v", "size"))
        at = {g: k for k, g in enumerate(sorted(g for g, t in zip(gene, kind, strict=True) if t == 0))}
        n = len(at)
        y, x, c, held = np.zeros(n), np.zeros(n), np.eye(n), {}
        for t, g, o, value, s in zip(kind, gene, other, v, size, strict=True):
            if t == 0:
                y[at[g]], x[at[g]] = value, s
            elif t == 1:
                c[at[g], at[o]] = c[at[o], at[g]] = (1 - shrink) * value
            else:
                held.setdefault(o, []).append(at[g])
        low = np.linalg.eigvalsh(c)[0]
        if low < shrink / 2:  # left-out pairs can make it indefinite
            c = (c + (shrink / 2 - low) * np.eye(n)) / (1 + shrink / 2 - low)
        half = np.linalg.inv(np.linalg.cholesky(c))
        one, x, y = half @ np.ones(n), half @ x, half @ y
        sets_in = [half[:, genes_in].sum(1) for genes_in in held.values()]
        v = np.stack([one, x, y], 1)
        cross = np.array([s @ v for s in sets_in]).reshape(-1, 3)
        number = np.repeat(np.arange(len(held)), [len(genes_in) for genes_in in held.values()])
        return sums_table(n, v.T @ v, cross, np.array([s @ s for s in sets_in]), list(held), number)

    return set_table(written(rows.groupBy("block").applyInArrow(run, SUMS), "gls-sums"), least_genes)


#: Products under the inverse of a block's matrix: of a set (s) and of 1, x and y (g, one row without a set).
SUMS = "go string, n long, s1 double, sx double, sy double, ss double, g11 double, g1x double, g1y double, gxx double, gxy double, gyy double"


def sums_table(n: int, base: np.ndarray, cross: np.ndarray, square: np.ndarray, names: list[str], held: np.ndarray) -> pa.Table:
    """Rows of SUMS of a block (`held`: the number of the set of each gene in a set)."""
    counts = np.bincount(held, minlength=len(names))
    out = [(None, n, 0.0, 0.0, 0.0, 0.0, *(float(base[i, j]) for i in range(3) for j in range(i, 3)))]
    out += [(go, int(m), *(float(x) for x in c), float(q), *([0.0] * 6)) for go, m, c, q in zip(names, counts, cross, square, strict=True)]
    return pa.Table.from_arrays([pa.array(k, kinds) for k, kinds in zip(zip(*out, strict=True), [pa.string(), pa.int64()] + [pa.float64()] * 10, strict=True)], names=[p.split(" ")[0] for p in SUMS.split(", ")])


def set_table(sums: DataFrame, least_genes: int = 2) -> DataFrame:
    """go, ngenes, beta, se, z, p of each set from the sums over blocks."""
    base = sums.where("go is null").agg(F.sum("n").alias("t_n"), *[F.sum(k).alias(k) for k in ("g11", "g1x", "g1y", "gxx", "gxy", "gyy")])
    per = sums.where("go is not null").groupBy("go").agg(F.sum("n").alias("ngenes"), *[F.sum(k).alias(k) for k in ("s1", "sx", "sy", "ss")])
    # The set's column less what intercept and size explain of it (two by two normal equations); one row of totals.
    d = F.col("g11") * F.col("gxx") - F.col("g1x") * F.col("g1x")
    flat = d <= 1e-9 * F.col("g11") * F.col("gxx")  # all genes of one size
    solve = lambda u, w: (F.when(flat, u / F.col("g11")).otherwise((F.col("gxx") * u - F.col("g1x") * w) / d), F.when(flat, F.lit(0.0)).otherwise((F.col("g11") * w - F.col("g1x") * u) / d))
    a, b = solve(F.col("s1"), F.col("sx"))
    e, f = solve(F.col("g1y"), F.col("gxy"))
    q = per.crossJoin(F.broadcast(base)).withColumns({"q": F.col("ss") - a * F.col("s1") - b * F.col("sx"), "u": F.col("sy") - a * F.col("g1y") - b * F.col("gxy"), "r": F.col("gyy") - e * F.col("g1y") - f * F.col("gxy")})
    q = q.where((F.col("ngenes") >= least_genes) & (F.col("ngenes") < F.col("t_n")) & (F.col("q") > 1e-9 * F.col("ss")) & (F.col("t_n") > 3))
    beta = q.withColumn("beta", F.col("u") / F.col("q")).withColumn("se", F.sqrt(F.greatest(F.col("r") - F.col("u") * F.col("u") / F.col("q"), F.lit(0.0)) / (F.col("t_n") - 3) / F.col("q")))
    out = beta.withColumn("z", F.try_divide("beta", "se"))
    return out.select("go", "ngenes", "beta", "se", "z", upper_tail(F.col("z")).alias("p"))

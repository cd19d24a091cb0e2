"""Model results: documents in JSON, information criteria, curves, and overlap statistics.

A result document holds `options`, `params` and `optimize`, a list of pairs
[name, object] whose two members differ in type, so it is read as a VARIANT.
Costs are negative log likelihoods: lower is better.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of variants that explains 90 % of heritability under the model's effect distribution.
P9 = 0.319
CURVE = 2  # place of the overlap curve among the optimisation steps


def parse(df: DataFrame, json: str = "json") -> DataFrame:
    return df.withColumn("doc", F.parse_json(F.col(json)))


def get(path: str, kind: str = "double", doc: str = "doc") -> Column:
    return F.try_variant_get(F.col(doc), path, kind)


def costs(df: DataFrame) -> DataFrame:
    """Add n, cost_min, cost_max (ends of the overlap curve), cost_best (last step) and offset (the least)."""
    last = F.expr("element_at(cast(variant_get(doc, '$.optimize', 'array<variant>') as array<variant>), -1)")
    curve = get(f"$.optimize[{CURVE}][1].Jout", "array<double>")
    out = df.withColumns(
        {
            "n": get("$.options.sum_weights"),
            "cost_min": F.element_at(curve, 1),
            "cost_max": F.element_at(curve, -1),
            "cost_best": F.try_variant_get(last, "$[1].fun", "double"),
        }
    )
    return out.withColumn("offset", F.least("cost_min", "cost_max", "cost_best"))


def aic_delta(alternative: Column, best: Column, df: int = -1) -> Column:
    """2 df + 2 (cost_alternative - cost_best): above 0 the best model is worth its parameter more."""
    return 2.0 * df + 2.0 * (alternative - best)


def bic_delta(alternative: Column, best: Column, n: Column, df: int = -1) -> Column:
    return F.ln(n) * df + 2.0 * (alternative - best)


def criteria(df: DataFrame) -> DataFrame:
    """best_vs_min and best_vs_max AIC and BIC of each document."""
    new = {}
    for name in ("min", "max"):
        new[f"best_vs_{name}_aic"] = aic_delta(F.col(f"cost_{name}"), F.col("cost_best"))
        new[f"best_vs_{name}_bic"] = bic_delta(F.col(f"cost_{name}"), F.col("cost_best"), F.col("n"))
    return df.withColumns(new)


def likelihood_curve(df: DataFrame, *keys: str, step: int = CURVE) -> DataFrame:
    """One row a grid point: keys, i, x, cost above the least of the curve.  The grid's own units are kept."""
    grid, cost = get(f"$.optimize[{step}][1].grid", "array<double>"), get(f"$.optimize[{step}][1].Jout", "array<double>")
    return df.select(*keys, F.array_min(cost).alias("_low"), F.posexplode(F.arrays_zip(grid.alias("x"), cost.alias("y")))).select(*keys, F.col("pos").alias("i"), F.col("col.x").alias("x"), (F.col("col.y") - F.col("_low")).alias("cost"))


def steps(df: DataFrame, *keys: str) -> DataFrame:
    """keys, i, name of every optimisation step; steps are addressed by place, the name is a cross check."""
    each = F.expr("cast(variant_get(doc, '$.optimize', 'array<variant>') as array<variant>)")
    return df.select(*keys, F.posexplode(each)).select(*keys, F.col("pos").alias("i"), F.try_variant_get("col", "$[0]", "string").alias("name"))


def univariate(df: DataFrame) -> DataFrame:
    """Add h2 = pi sig2_beta totalhet and nc_p9 = 0.319 num_snp pi."""
    return df.withColumns({"h2": F.col("pi") * F.col("sig2_beta") * F.col("totalhet"), "nc_p9": nc_p9(F.col("pi"), F.col("num_snp"))})


def nc_p9(pi: Column, num_snp: Column) -> Column:
    return P9 * num_snp * pi


def venn(df: DataFrame, pi1u: str = "pi1u", pi2u: str = "pi2u", pi12: str = "pi12") -> DataFrame:
    """Parts of two traits' polygenicity: pi1 and pi2 on their own, pi12 shared."""
    return df.withColumns({"pi1": F.col(pi1u) - F.col(pi12), "pi2": F.col(pi2u) - F.col(pi12)})


def overlap(df: DataFrame) -> DataFrame:
    """Add dice, rg, concordance within the shared part, and the least pi12 that the correlation allows.

    Needs pi1, pi2, pi12 and rho_beta, each row one run.
    """
    u1, u2 = F.col("pi1") + F.col("pi12"), F.col("pi2") + F.col("pi12")
    rg = F.try_divide(F.col("rho_beta") * F.col("pi12"), F.sqrt(u1 * u2))
    return df.withColumns(
        {
            "dice": F.try_divide(2.0 * F.col("pi12"), u1 + u2),
            "rg": rg,
            "fraction_concordant_within_shared": 0.5 + F.asin("rho_beta") / F.lit(3.141592653589793),
            "pi12_min": rg * F.sqrt(u1 * u2),
        }
    )


def combine(df: DataFrame, keys: list[str], values: list[str], sample: bool = True) -> DataFrame:
    """Mean and spread over replicates: `x (mean)`, `x (std)`.

    The divisor is n - 1 (one run: null); the published tables do not say which they use.
    """
    std = F.stddev_samp if sample else F.stddev_pop
    return df.groupBy(*keys).agg(*[x for v in values for x in (F.avg(v).alias(f"{v} (mean)"), std(v).alias(f"{v} (std)"))])


def warm_start(runs: DataFrame, params: DataFrame, keys: tuple[str, ...] = ("trait", "rep")) -> DataFrame:
    """Runs with the parameters of the earlier fit of the same key; runs without one keep nulls."""
    return runs.join(params, list(keys), "left")


def document(df: DataFrame, options: list[str], params: list[str]) -> DataFrame:
    """A result document (JSON text) of each row, from flat columns, `grid`, `jout` and `fun`."""
    step = lambda name, *f: F.concat(F.lit(f'["{name}",'), F.to_json(F.struct(*f)), F.lit("]"))
    jout, grid, fun = F.col("jout"), F.col("grid"), F.col("fun")
    optimize = F.concat(F.lit("["), step("inft", fun.alias("fun")), F.lit(","), step("fit", fun.alias("fun")), F.lit(","), step("brute1", grid.alias("grid"), jout.alias("Jout"), fun.alias("fun")), F.lit(","), step("brent1", fun.alias("fun")), F.lit("]"))
    return df.withColumn("json", F.concat(F.lit('{"options":'), F.to_json(F.struct(*options)), F.lit(',"params":'), F.to_json(F.struct(*params)), F.lit(',"optimize":'), optimize, F.lit("}")))


def univariate_runs(df: DataFrame) -> DataFrame:
    """Per run, from parsed result documents: parameters, h2 and nc_p9, with criteria where the document has a curve."""
    p = {c: get(f"$.params.{c}") for c in ("pi", "sig2_beta", "sig2_zero")}
    o = {c: get(f"$.options.{c}") for c in ("totalhet", "num_snp", "sum_weights")}
    return univariate(df.withColumns({**p, **o}))


def univariate_table(runs: DataFrame, *keys: str) -> DataFrame:
    """The report of single traits: mean and spread of every statistic over replicates."""
    return combine(runs, list(keys), ["pi", "sig2_beta", "sig2_zero", "h2", "nc_p9"])


def bivariate_table(runs: DataFrame, *keys: str) -> DataFrame:
    """The report of pairs: overlap statistics of each run, then mean and spread.

    Needs pi1u, pi2u, pi12, rho_beta, rho_zero and num_snp of each run.
    """
    each = overlap(venn(runs)).withColumns({f"nc{k}_p9": nc_p9(F.col(f"pi{k}"), F.col("num_snp")) for k in ("1", "2", "12")})
    return combine(each, list(keys), ["dice", "pi1", "pi2", "pi12", "nc1_p9", "nc2_p9", "nc12_p9", "rho_zero", "rho_beta", "rg", "fraction_concordant_within_shared"])

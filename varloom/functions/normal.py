"""Normal quantiles and related scalar functions as SQL expressions.

The text is plain SQL, so the same formula runs in Spark (whole-stage code)
and in a checking engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the published rational approximation AS 241
# (PPND16) to the normal quantile, constant term first.
CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
MIDDLE = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
FAR = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _horner(coefficients: tuple[float, ...], x: str) -> str:
    out = f"{coefficients[-1]:.20e}"
    for c in reversed(coefficients[:-1]):
        out = f"({out} * {x} + {c:.20e})"
    return out


def _ratio(pair, x: str) -> str:
    return f"({_horner(pair[0], x)} / {_horner(pair[1], x)})"


def quantile_sql(p: str) -> str:
    """The standard normal quantile of p; null at and beyond 0 and 1."""
    r = f"(0.180625e0 - ({p} - 0.5e0) * ({p} - 0.5e0))"
    tail = f"sqrt(-ln(case when {p} < 0.5e0 then {p} else 1e0 - {p} end))"
    sign = f"(case when {p} < 0.5e0 then -1e0 else 1e0 end)"
    return (
        f"(case when {p} is null or not ({p} > 0e0 and {p} < 1e0) then null"
        f" when abs({p} - 0.5e0) <= 0.425e0 then ({p} - 0.5e0) * {_ratio(CENTRE, r)}"
        f" when {tail} <= 5e0 then {sign} * {_ratio(MIDDLE, f'({tail} - 1.6e0)')}"
        f" else {sign} * {_ratio(FAR, f'({tail} - 5e0)')} end)"
    )


def quantile(p: str) -> Column:
    return F.expr(quantile_sql(p))


def z_from_p_and_or_sql(p: str, odds: str) -> str:
    """Z from a two-sided P and an odds ratio: size by P, sign by OR - 1.  P = 0 (infinite) gives null, as do missing values."""
    return f"(-{quantile_sql(f'({p} / 2e0)')} * (case when {odds} > 1e0 then 1e0 when {odds} < 1e0 then -1e0 when {odds} = 1e0 then 0e0 end) + 0e0)"


def z_from_p_and_or(p: str, odds: str) -> Column:
    return F.expr(z_from_p_and_or_sql(p, odds))


def effective_n(cases: Column, controls: Column) -> Column:
    """4 / (1 / cases + 1 / controls); null where a count is 0."""
    return F.try_divide(F.lit(4.0), F.try_divide(F.lit(1.0), cases) + F.try_divide(F.lit(1.0), controls))


def effective_n_value(cases: float, controls: float) -> float:
    return 4.0 / (1.0 / cases + 1.0 / controls)


#: Fixed values of a published rational form of the normal tail (Hart; double precision by West, 2005), highest power first.
_TAIL_UP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_TAIL_DOWN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def _falling(coefficients: tuple[float, ...], x: str) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"(({out})*{x}+{c!r})"
    return out


def tail_sql(z: str) -> str:
    """P(Z > z) as SQL, small in relative error far out in the tail too (a rational form, beyond 7 a continued fraction)."""
    a = f"abs({z})"
    near = f"exp(-{a}*{a}/2e0)*{_falling(_TAIL_UP, a)}/{_falling(_TAIL_DOWN, a)}"
    fraction = f"({a}+0.65e0)"
    for k in range(12, 0, -1):
        fraction = f"({a}+{k}e0/{fraction})"
    far = f"exp(-{a}*{a}/2e0)/{fraction}/2.5066282746310002e0"
    upper = f"(case when {a}<7e0 then {near} else {far} end)"
    return f"(case when {z}>=0 then {upper} else 1e0-{upper} end)"


def upper_tail(z: Column) -> Column:
    """The same as a column; z is evaluated once, however long its own expression is."""

    def of(x: Column) -> Column:
        a = F.abs(x)

        def horner(coefficients: tuple[float, ...]) -> Column:
            out = F.lit(coefficients[0])
            for c in coefficients[1:]:
                out = out * a + c
            return out

        fraction = a + 0.65
        for k in range(12, 0, -1):
            fraction = a + float(k) / fraction
        density = F.exp(-a * a / 2.0)
        upper = F.when(a < 7.0, density * horner(_TAIL_UP) / horner(_TAIL_DOWN)).otherwise(density / fraction / 2.5066282746310002)
        return F.when(x >= 0, upper).otherwise(1.0 - upper)

    return F.element_at(F.transform(F.array(z), of), 1)

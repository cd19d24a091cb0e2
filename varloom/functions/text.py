"""Number formats of the report tables.  Null shows as an empty string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimals of a fixed-point column, by name; the rest of the table's numbers stay as they are.
SIX = ("h2", "se_h2", "h2_frac", "se_h2_frac", "h2_base_frac", "se_h2_base_frac")
TWO = ("model_aic", "loglike_diff", "enrich", "se_enrich", "excl_enrich", "se_excl_enrich")
SCIENTIFIC = ("magma_p", "model_p", "model_q", "model_fdr")


def fixed(x: Column, decimals: int) -> Column:
    return F.coalesce(F.format_number(x, decimals), F.lit(""))


def scientific(x: Column) -> Column:
    """Two decimals and an exponent.  Decimal ties round up here; keep P numeric where that matters."""
    return F.when(x.isNull(), F.lit("")).otherwise(F.format_string("%.2e", x))


def whole(x: Column) -> Column:
    return F.coalesce(x.cast("long").cast("string"), F.lit(""))


def formatted(name: str) -> Column:
    c, key = F.col(f"`{name}`"), name.lower()
    if key in SIX:
        return fixed(c, 6)
    if key in TWO:
        return fixed(c, 2)
    if key in SCIENTIFIC:
        return scientific(c)
    return whole(c) if key == "ngenes" else c

"""Table schemas, header aliases, and the missing-value rule.

Missing values: NaN becomes null at ingest.  Spark orders NaN above every
number and finds NaN > 0 true, so a NaN that stayed would pass filters and
win sorts that a missing value must not.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _D, _L = T.StringType(), T.DoubleType(), T.LongType()


def _struct(spec: str, kinds: Mapping[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in spec.split())])


_K = {"s": _S, "d": _D, "l": _L, "i": T.IntegerType()}
SUMSTATS = _struct("SNP:s CHR:s BP:l A1:s A2:s N:d Z:d", _K)
RAW_CASE_CONTROL = _struct("SNP:s Freq.A1:d CHR:s BP:l A1:s A2:s OR:d SE:d P:d", _K)
RAW_ZSCORE = _struct("SNP:s UNIQUE_ID:s CHR:s POS:l A1:s A2:s EAF_HRC:d Zscore:d stdBeta:d SE:d P:d N_analyzed:d minINFO:d EffectDirection:s", _K)
GLM_LINEAR = _struct("ID:s REF:s ALT:s OBS_CT:l T_STAT:d", _K)
BIM = _struct("CHR:s SNP:s CM:d BP:l A1:s A2:s", _K)
FAM = _struct("FID:s IID:s PAT:s MAT:s SEX:i PHENO:s", _K)
LD_PAIRS = _struct("chr:i i:l j:l r2:d", _K)
GENE_SETS = _struct("GO:s GENE:s CHR:s FROM:l TO:l", _K)
ENRICHMENT = _struct("GO:s NGENES:l snps:l enrich:d se_enrich:d h2:d se_h2:d h2_base:d loglike_aic:d loglike_diff:d loglike_df:d", _K)
MAGMA_SETS = _struct("FULL_NAME:s P:d", _K)
MAGMA_GENES = _struct("GENE:s P:d", _K)

#: Accepted header names (any case) for each column of summary statistics.
ALIASES = {"SNP": ("snp", "rsid"), "CHR": ("chr",), "BP": ("bp", "pos"), "A1": ("a1", "effectallele"), "A2": ("a2", "otherallele"), "N": ("n",), "Z": ("z",)}
#: Renames of named dialects.  The GLM one takes REF as A1 whatever allele was tested; it is kept as it is.
DIALECTS = {
    "glm_linear": {"ID": "SNP", "REF": "A1", "ALT": "A2", "OBS_CT": "N", "T_STAT": "Z"},
    "zscore": {"POS": "BP", "Zscore": "Z", "N_analyzed": "N"},
}


def nan_to_null(df: DataFrame) -> DataFrame:
    """Null in place of NaN in every float column."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns])


def require(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Raise unless all columns are there."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")
    return df


def resolve_headers(df: DataFrame, aliases: Mapping[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """Rename columns to their standard names, in any case; two columns for one name are an error.

    Either a marker name or chromosome and position must be there.
    """
    standard = {a: name for name, names in aliases.items() for a in names}
    new = [standard.get(c.lower(), c) for c in df.columns]
    twice = {c for c in new if new.count(c) > 1}
    if twice:
        raise ValueError(f"more than one column for {sorted(twice)}")
    out = df.toDF(*new)
    if "SNP" not in new and not {"CHR", "BP"} <= set(new):
        raise ValueError("needs SNP, or CHR and BP")
    return require(out, [c for c in ("A1", "A2", "N", "Z") if c in aliases])


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def reorder(df: DataFrame, first: Iterable[str]) -> DataFrame:
    """The listed columns that exist, then the others in their order."""
    known = [c for c in first if c in df.columns]
    return df.select(*[f"`{c}`" for c in known + [c for c in df.columns if c not in known]])

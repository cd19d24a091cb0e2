"""Correlations of genotypes in a band along the chromosome, by blocked matrix products.

Variants are dealt into bins as wide as the window, and a bin's variants into
tiles of about `tile` rows by their hash.  Two tiles of one bin or of
neighbouring bins meet once, in one task, as matrices; a bin of any density is
only more tiles.  A variant travels once for each tile it meets (as bytes), not
once for each variant.

r2 is that of the samples called at both variants.  Its sums are whole numbers,
so it does not depend on the tiles.  Copies are whole numbers from 0; null, NaN and values
below 0 are missing.  Pairs without variance among their common samples have no
r2 and are left out, as are variants without position, chromosome or genotypes;
variants at one position make no pair.  Repeated rows repeat their pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TILE_BYTES = 128 << 20


def tile_rows(samples: int) -> int:
    """Rows of a tile such that two of them stay within TILE_BYTES as bytes."""
    return max(1, min(1024, TILE_BYTES // (2 * max(1, samples))))


def _products(a: np.ndarray, b: np.ndarray, columns: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """r2 (NaN: none) and the number of common samples of each row of a with each of b; samples are taken some columns at a time."""
    n, sx, sy, xy, xx, yy = (np.zeros((len(a), len(b))) for _ in range(6))
    for at in range(0, a.shape[1], columns):
        p, q = a[:, at : at + columns], b[:, at : at + columns]
        p_here, q_here = (p >= 0).astype(float), (q >= 0).astype(float)
        p, q = np.maximum(p, 0).astype(float), np.maximum(q, 0).astype(float)
        n += p_here @ q_here.T
        sx += p @ q_here.T
        sy += p_here @ q.T
        xy += p @ q.T
        xx += (p * p) @ q_here.T
        yy += p_here @ (q * q).T
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = (n * xx - sx * sx) * (n * yy - sy * sy)
        return np.where(spread > 0, (n * xy - sx * sy) ** 2 / spread, np.nan), n


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    sizes = np.unique(np.diff(lists.offsets.to_numpy()))
    if len(sizes) > 1:
        raise ValueError("genotypes of one chromosome have different numbers of samples")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def genotype_pairs(rows: DataFrame, window: int, r2_min: float, key: str = "snp", genotypes: str = "g", position: str = "bp", chrom: str = "chr", tile: int = 1024) -> DataFrame:
    """chrom, i, j, r2 and n (common samples) of pairs with i before j, at most `window` apart, and r2 of at least r2_min."""
    called = F.transform(F.col(f"`{genotypes}`"), lambda x: F.when(x >= 0, F.when(~F.isnan(x), x)).cast("tinyint"))
    base = rows.select(F.col(f"`{chrom}`").alias("c"), F.col(f"`{key}`").alias("k"), F.col(f"`{position}`").cast("long").alias("p"), F.transform(called, lambda x: F.coalesce(x, F.lit(-1).cast("tinyint"))).alias("g"))
    base = base.where("c is not null and p is not null and size(g) > 0").withColumn("bin", F.floor(F.col("p") / (window + 1)))
    counted = base.select("c", "bin").groupBy("c", "bin").agg(F.ceil(F.count(F.lit(1)) / tile).alias("tiles"))
    beside = lambda step, name: counted.select("c", (F.col("bin") + step).alias("bin"), F.col("tiles").alias(name))
    bins = counted.join(beside(1, "before"), ["c", "bin"], "left").join(beside(-1, "after"), ["c", "bin"], "left")
    dealt = base.join(bins, ["c", "bin"]).withColumn("t", F.pmod(F.xxhash64("k"), F.col("tiles")))
    # The places where a row stands: (bin and tile of the first side, of the second, which side it is).
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    place = lambda b1, t1, b2, t2, second: F.struct(b1.alias("b1"), t1.alias("t1"), b2.alias("b2"), t2.alias("t2"), F.lit(second).alias("second"))
    b, t, none = F.col("bin"), F.col("t"), F.array().cast("array<struct<b1:bigint,t1:bigint,b2:bigint,t2:bigint,second:boolean>>")
    places = F.concat(
        F.transform(F.filter(upto(F.col("tiles")), lambda u: u >= t), lambda u: place(b, t, b, u, False)),
        F.transform(F.filter(upto(F.col("tiles")), lambda u: u < t), lambda u: place(b, u, b, t, True)),
        F.coalesce(F.transform(upto(F.col("after")), lambda u: place(b, t, b + 1, u, False)), none),
        F.coalesce(F.transform(upto(F.col("before")), lambda u: place(b - 1, u, b, t, True)), none),
    )
    sent = dealt.select("c", "k", "p", "g", F.explode(places).alias("at")).select("c", "at.*", "k", "p", "g")
    out = T.StructType([T.StructField(chrom, rows.schema[chrom].dataType), T.StructField("i", rows.schema[key].dataType), T.StructField("j", rows.schema[key].dataType), T.StructField("r2", T.DoubleType()), T.StructField("n", T.LongType())])

    def meet(names: tuple, table: pa.Table) -> pa.Table:
        alone = names[1] == names[3] and names[2] == names[4]  # a tile with itself
        second = table["second"].to_numpy()
        a = table.filter(pa.array(~second))
        b = a if alone else table.filter(pa.array(second))
        schema = pa.schema([(chrom, table.schema.field("c").type), ("i", table.schema.field("k").type), ("j", table.schema.field("k").type), ("r2", pa.float64()), ("n", pa.int64())])
        if not len(a) or not len(b):
            return schema.empty_table()
        r2, n = _products(_matrix(a["g"]), _matrix(b["g"]))
        gap = b["p"].to_numpy()[None, :] - a["p"].to_numpy()[:, None]
        near = (gap > 0) & (gap <= window) if alone else (gap != 0) & (abs(gap) <= window)
        x, y = np.nonzero(near & (r2 >= r2_min))
        forward = pa.array(gap[x, y] > 0)
        ka, kb = a["k"].combine_chunks().take(pa.array(x)), b["k"].combine_chunks().take(pa.array(y))
        import pyarrow.compute as pc

        columns = [pa.repeat(names[0], len(x)).cast(schema.field(0).type), pc.if_else(forward, ka, kb), pc.if_else(forward, kb, ka), pa.array(r2[x, y]), pa.array(n[x, y].astype(np.int64))]
        return pa.table(columns, schema=schema)

    return sent.groupBy("c", "b1", "t1", "b2", "t2").applyInArrow(meet, out)

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.operators import band

SCHEMA = "chr int, snp string, bp long, g array<double>, extra string"


def brute(rows, window, r2_min):
    out = {}
    for c, i, p, g, _ in rows:
        for d, j, q, h, _ in rows:
            if c is None or c != d or p is None or q is None or not g or not h or not 0 < q - p <= window:
                continue
            both = [(x, y) for x, y in zip(g, h) if x is not None and y is not None and x >= 0 and y >= 0]
            x, y = np.array(both).reshape(-1, 2).T
            if len(both) and x.std() > 0 and y.std() > 0:
                r2 = np.corrcoef(x, y)[0, 1] ** 2
                if r2 >= r2_min:
                    out[i, j] = (c, r2, len(both))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out, last = [], [1] * 40
    for k in range(150):
        last = [x if rng.random() < 0.7 else rng.randrange(3) for x in last]
        g = [None if rng.random() < 0.1 else float(x) for x in last]
        # Two chromosomes, a dense place, shared positions.
        out.append((1 + k % 2, f"rs{k}", 1000 + k % 5 if 40 <= k < 90 else 37 * k, g, "x"))
    out += [(1, "same", 500, [1.0] * 40, None), (1, "missing", 501, [None] * 40, None), (1, "none", 502, None, None), (1, "empty", 503, [], None), (None, "lost", 3, [1.0, 2.0] * 20, None), (2, "unplaced", None, [1.0, 2.0] * 20, None), (2, "nan", 400, [float("nan"), -1.0, 1.0, 2.0] * 10, None)]
    return out


@pytest.mark.parametrize("tile", [1, 7, 1024])
@pytest.mark.parametrize("window", [3, 200])
def test_against_brute_force(spark, rows, tile, window):
    df = spark.createDataFrame(rows, SCHEMA)
    got = band.genotype_pairs(df, window, 0.05, tile=tile).collect()
    want = brute(rows, window, 0.05)
    assert len(got) == len(want) > 0
    for r in got:
        c, r2, n = want[r["i"], r["j"]]
        assert (r["chr"], r["n"]) == (c, n) and r["r2"] == pytest.approx(r2, abs=1e-9)


def test_edges(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert band.genotype_pairs(df.where("false"), 100, 0.1).count() == 0
    once = band.genotype_pairs(df, 200, 0.05).count()
    assert band.genotype_pairs(df.unionByName(df), 200, 0.05, tile=5).count() == 4 * once
    uneven = df.where("snp = 'rs2'").unionByName(df.where("snp = 'rs4'").withColumn("g", F.slice("g", 1, 9)))
    with pytest.raises(Exception, match="different numbers of samples"):
        band.genotype_pairs(uneven, 10_000, 0.0).collect()
    assert band.tile_rows(500_000) * 500_000 * 2 <= band.TILE_BYTES and band.tile_rows(100) == 1024


def test_samples_are_taken_in_columns():
    rng = np.random.default_rng(3)
    a, b = rng.integers(-1, 3, (5, 333)).astype(np.int8), rng.integers(-1, 3, (4, 333)).astype(np.int8)
    for x, y in zip(band._products(a, b), band._products(a, b, columns=10)):
        np.testing.assert_allclose(x, y)

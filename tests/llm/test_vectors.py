"""Vector codes, hard negatives and vector near duplicates against brute force."""

import hashlib

import numpy as np
import pytest

from varloom.llm import negatives, vector_codes, vector_near

ROWS = "vec_id long, embedding array<double>, label int, code string, score double"


def table(spark, rows):
    """Rows (id, vector, label) with extra columns whose names clash."""
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], c, "x", 1.0) for i, v, c in rows], ROWS).repartition(3)


def clean(rows):
    return [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]


HARD = [(90001, None, 1), (90002, [None] + [0.5] * 15, 2), (90003, [float("nan")] + [0.5] * 15, 3), (90004, [float("inf")] + [0.5] * 15, None), (90005, [0.0] * 16, 4)]


# -- codes -------------------------------------------------------------------


def lloyd(rows, parts, entries, rounds, scale=4096):
    rows = sorted(clean(rows), key=lambda r: (r[0] is None, r[0] or 0, [float(np.floor(scale * x)) for x in r[1]]))
    x = np.floor(np.array([r[1] for r in rows], float) * scale).astype(int)
    width = x.shape[1] // parts
    cut = x.reshape(len(x), parts, width)
    books = cut[:entries].transpose(1, 0, 2).copy()
    for turn in range(rounds + 1):
        d = ((cut[:, :, None, :] - books[None]) ** 2).sum(-1)
        code = d.argmin(2)
        if turn < rounds:
            for p in range(parts):
                for e in range(books.shape[1]):
                    own = cut[code[:, p] == e, p]
                    if len(own):
                        books[p, e] = [int(v) // len(own) for v in own.sum(0)]
    error = np.take_along_axis(d, code[:, :, None], 2)[:, :, 0].sum(1)
    total = {}
    for r, e in zip(rows, error):
        total[r[2]] = total.get(r[2], 0) + int(e)
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return sorted((r[0] is None, r[0] or 0, "".join(f"{c:02x}" for c in k), int(e), total[r[2]], sha) for r, k, e in zip(rows, code, error))


def coded(df, **options):
    return sorted((r["vec_id"] is None, r["vec_id"] or 0, r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vector_codes.codes(df, **options).collect())


def test_codes_are_lloyds(spark):
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(9, 16))
    rows = [(int(i), (middle[i % 9] + rng.normal(scale=0.2, size=16)).tolist(), [None, 1, 2, 3][i % 4]) for i in range(900)]
    rows += [(1000 + i, [0.25 * ((i + j) % 3) for j in range(16)], 7) for i in range(60)]  # ties and copies
    rows += [rows[5], rows[5], (None, rows[7][1], None)] + HARD
    for parts, entries, rounds in ((4, 16, 6), (8, 5, 3), (1, 3, 1)):
        assert coded(table(spark, rows), parts=parts, entries=entries, rounds=rounds) == lloyd(rows, parts, entries, rounds)


def test_codes_of_few_rows(spark):
    rows = [(3, [1.0] * 16, 1), (1, [1.0] * 16, 1), (2, [-0.00001] * 16, None)]
    assert coded(table(spark, rows)) == lloyd(rows, 8, 16, 6)
    assert vector_codes.codes(table(spark, HARD[:4])).collect() == []
    with pytest.raises(ValueError):
        vector_codes.codes(table(spark, [(1, [1.0] * 10, 1)]))


def test_bounds_save_distances():
    """The bounds hold after the entries move, and most distances are never computed."""
    rng = np.random.default_rng(2)
    book = rng.integers(-4000, 4000, (16, 8))
    x = book[rng.integers(0, 16, 3000)] + rng.integers(-300, 300, (3000, 8))
    code, upper, lower = np.zeros(3000, np.int64), np.full(3000, np.inf, np.float32), np.zeros((3000, 16), np.float32)
    spent = []
    for _ in range(4):
        _, n = vector_codes.reassign(x, book, code, upper, lower)
        spent.append(n)
        d = ((x[:, None] - book) ** 2).sum(-1)
        assert (code == d.argmin(1)).all()
        true = np.sqrt(d)
        assert (upper >= true[np.arange(3000), code]).all() and (lower <= true).all()
        new = book + rng.integers(-20, 20, book.shape)
        vector_codes.shift(code, upper, lower, np.sqrt(((new - book) ** 2).sum(1)))
        book = new
    assert max(spent[1:]) < 3000 * 16 / 8


# -- hard negatives ------------------------------------------------------------


def mined(rows, every, positives, negatives, least=30, most=90, scale=256):
    kept = sorted({(i, c, tuple(int(np.floor(scale * x)) for x in v)) for i, v, c in clean(rows) if i is not None and c is not None})
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    anchors = {}
    for i, c, v in kept:
        if i % every == 0:
            anchors.setdefault(i, (c, v))
    out = []
    for i, (c, v) in anchors.items():
        scored = sorted((-dot(v, w), j, d) for j, d, w in kept)
        for s, p, _ in [t for t in scored if t[2] == c and t[1] != i][:positives]:
            fits = [(t, j) for t, j, d in scored if d != c and least * -s <= 100 * -t <= most * -s][:negatives]
            out += [(i, p, n, j, -s, -t) for n, (t, j) in enumerate(fits, 1)]
    return sorted(out)


def test_hard_negatives(spark):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(12, 16))
    vectors = (middle[rng.integers(0, 12, 700)] + rng.normal(scale=0.6, size=(700, 16))) / 4
    rows = [(int(i), v.tolist(), [None, 0, 1, 2, 3][i % 5]) for i, v in enumerate(vectors)]
    # Many rows of one score, in and beyond the positives and the window: ids decide.
    rows += [(10_000 + 7 * i, vectors[6].tolist(), 1) for i in range(900)] + [(50_000 + i, (vectors[6] * 0.6).tolist(), 2) for i in range(900)]
    rows += [rows[6], rows[6], (6, vectors[9].tolist(), 2), (None, vectors[6].tolist(), 1)] + HARD
    for every, positives, negatives, block in ((6, 5, 10, 4096), (35, 3, 50, 8)):
        got = negatives_of(table(spark, rows), every=every, positives=positives, negatives=negatives, block=block)
        want = mined(rows, every, positives, negatives)
        assert got == want and len(want) > 500


def negatives_of(df, **options):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in negatives.hard_negatives(df, **options).collect())


def test_hard_negatives_of_few_rows(spark):
    assert negatives_of(table(spark, HARD)) == []
    assert negatives_of(table(spark, [])) == []
    rows = [(0, [1.0] * 4, 1), (1, [1.0] * 4, 1), (2, [0.5] * 4, 2), (3, [0.0] * 4, 2), (100, [-1.0] * 4, 5)]
    assert negatives_of(table(spark, rows)) == mined(rows, 100, 5, 10) == [(0, 1, 1, 2, 262144, 131072)]


# -- near duplicates -----------------------------------------------------------


def linked(rows, t):
    """vec_id, n_links, component_id, kept of distinct rows, by all pairs."""
    rows = sorted({(i, c, None if v is None else tuple(None if x is None else float(x) for x in v)) for i, v, c in rows}, key=str)
    good = [k for k, (i, c, v) in enumerate(rows) if i is not None and c is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    if not good:
        return sorted(((i is None, i or 0, 0, i, True) for i, _, _ in rows), key=str)
    x = np.array([rows[k][2] for k in good], float)
    x /= np.abs(x).max(1, keepdims=True)  # lengths far from 1
    x /= np.sqrt((x * x).sum(1))[:, None]
    label = np.array([rows[k][1] for k in good])
    link = (x @ x.T >= t) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    low = np.array([rows[k][0] for k in good])
    while True:
        new = np.where(link, low[None, :], low[:, None]).min(1)
        new = np.minimum(new, low)
        if (new == low).all():
            break
        low = new
    out = {k: (int(n), int(c)) for k, n, c in zip(good, link.sum(1), low)}
    return sorted(((i is None, i or 0, *(out.get(k, (0, i))), out.get(k, (0, i))[1] == i) for k, (i, _, _) in enumerate(rows)), key=str)


def found(df, **options):
    return sorted(((r["vec_id"] is None, r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in vector_near.near_vectors(df, **options).collect()), key=str)


def test_near_vectors(spark):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(40, 16))
    rows = [(int(i), (middle[rng.integers(0, 40)] * (1 + i % 3) + rng.normal(scale=0.12, size=16)).tolist(), [None, 0, 1, 2, 11][i % 5]) for i in range(1500)]
    rows += [(20_000 - i, (middle[3] + rng.normal(scale=0.02, size=16)).tolist(), 2) for i in range(700)]  # a tight group: linked as wholes
    rows += [(30_000 + i, middle[5].tolist(), 1) for i in range(300)]  # copies
    steps = rng.normal(size=16)
    rows += [(40_000 + i, (np.array([10.0] + [0] * 15) * np.cos(i * 0.1) + np.array([0, 10.0] + [0] * 14) * np.sin(i * 0.1)).tolist(), 11) for i in range(40)]  # a chain
    rows += [(50_000, (steps * 1e300 / 10).tolist(), 0), (50_001, (steps * 1e-300).tolist(), 0)]  # equal directions of very unequal lengths
    rows += [rows[1], rows[1], (None, rows[1][1], 0), (60_000, [1.0, 2.0], 1), (60_001, [], 1)] + HARD
    want = linked([r for r in rows if r[1] is None or len(r[1]) == 16], 0.98)
    want = sorted(want + [(False, 60_000, 0, 60_000, True), (False, 60_001, 0, 60_001, True)], key=str)
    for options in ({}, {"block": 60}):
        assert found(table(spark, rows), **options) == want
    assert sum(r[2] > 0 for r in want) > 1500


def test_near_vectors_of_few_rows(spark):
    assert found(table(spark, [])) == []
    assert found(table(spark, HARD)) == linked(HARD, 0.98)
    rows = [(3, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (2, [1.0, 0.1], 2), (9, [1.0, 0.0], 1)]
    assert found(table(spark, rows)) == linked(rows, 0.98)


def test_whole_intervals_hold_both_ways():
    """Blocks of one tight group are linked as wholes, seen from each of them, and no pair is looked at."""
    rng = np.random.default_rng(5)
    x = np.array([1.0] + [0] * 7) + rng.normal(scale=0.01, size=(4096, 8))
    x /= np.sqrt((x * x).sum(1))[:, None]
    block = vector_near.Block(np.arange(4096), ["a"] * 4096, np.ones(4096, np.int64), x, np.eye(8)[:, :4], {})
    kinds = [k for k, *_ in vector_near.meet(block.tree, block.tree, 0.2, mirrored=True)]
    assert kinds == ["all"]
    n, root = np.zeros(4096, np.int64), np.arange(4096)
    vector_near.compare(block, block, 0.98, 0.2, root, n, n)
    assert (n == 4095).all() and not vector_near._find(root, np.arange(4096)).any()


def test_sql_of_vector_queries(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    from varloom.llm import queries
    from varloom.llm.sql import ORACLE_SQL

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    for name in ("op11_vector_codes", "op12_hard_negatives", "op13_vector_near"):
        df = queries.QUERIES[name](spark, sf_dir)
        cols = ", ".join(f'"{c}"' for c in df.columns)
        assert sorted(map(tuple, df.collect())) == sorted(con.execute(f"select {cols} from ({ORACLE_SQL[name]})").fetchall()), name

"""Vector codes by Elkan's version of Lloyd's rounds, in integers.

A vector's components become integers, floor(scale * x); it is cut into equal
consecutive parts, and each part position has a codebook of its own.  The
codebooks start as the parts of the rows of smallest id.  A round gives every
part its nearest entry (squared Euclidean distance, ties to the lower index)
and replaces each entry by the floor of its parts' mean; entries that no part
took stay.

Every row carries, from round to round, an upper bound of each part's distance
to its entry and a lower bound for each of the entries.  When entries move, the
bounds are shifted by the way they went.  An entry is passed by only where a
bound, or half the distance between two entries, says that it is strictly
farther than the present one; all others, so all ties, are decided on the
squared distances in integers.  Bounds are rounded outwards, so they never
decide wrongly.  The state of a round is a table in the shared folder: a lost
executor costs the tasks that it ran.  The only values that meet are one sum an
entry from each task, and the codebooks, whose size does not depend on the rows.

Rows whose vector is null, or holds null or non-finite components, or is not of
the commonest length, take no part.  Repeated rows count as often as they are
there; equal ids are ordered by their vectors, a null id comes last.  Fewer
rows than entries give as many entries as rows.  The length must be a multiple
of the number of parts, and integers must lie within 2^28, or an error is
raised.  No rows give no rows.  Columns of other names are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varloom.llm._shared import importable, materialize, tidy, with_totals, written
from varloom.llm._vectors import length_of, lists, matrix, no_list, whole

LARGEST = 1 << 28  # squared distances of these fit 64 bits
BATCH = 4096

#: kind 0: a row with its bounds; kind 1: a task's sum for one entry (cell: part * entries + entry).
STATE = T.StructType(
    [
        T.StructField("kind", T.IntegerType()),
        T.StructField("row", T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", T.StringType())])),
        T.StructField("x", T.ArrayType(T.IntegerType())),
        T.StructField("code", T.ArrayType(T.IntegerType())),
        T.StructField("upper", T.ArrayType(T.FloatType())),
        T.StructField("lower", T.ArrayType(T.FloatType())),
        T.StructField("cell", T.IntegerType()),
        T.StructField("n", T.LongType()),
        T.StructField("total", T.ArrayType(T.LongType())),
    ]
)
CODED = T.StructType([STATE.fields[1], T.StructField("code", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])
_ROW = pa.struct([("vec_id", pa.int64()), ("label", pa.string())])


def _up(v: np.ndarray) -> np.ndarray:
    return np.nextafter(np.asarray(v, np.float64).astype(np.float32), np.float32(np.inf))


def _down(v: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.asarray(v, np.float64).astype(np.float32), np.float32(-np.inf)), np.float32(0))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(-1)


def reassign(x: np.ndarray, book: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, int]:
    """Give every part (rows of x) its nearest entry of the book, in place; known squared distances (-1: not needed) and how many were computed."""
    entries, n = len(book), len(x)
    half = np.sqrt(_squared(book[:, None], book[None]).astype(np.float64)) * (0.5 * (1 - 1e-12))
    np.fill_diagonal(half, np.inf)
    known, computed = np.full(n, -1, np.int64), 0
    open_ = np.flatnonzero(upper >= half.min(1)[code])
    for j in range(entries):
        i = open_[code[open_] != j]
        i = i[(upper[i] >= lower[i, j]) & (upper[i] >= half[code[i], j])]
        loose = i[known[i] < 0]
        if len(loose):  # the upper bound may be too weak: make it exact
            own = code[loose]
            known[loose] = _squared(x[loose], book[own])
            distance = np.sqrt(known[loose].astype(np.float64))
            upper[loose], lower[loose, own] = _up(distance), _down(distance)
            computed += len(loose)
            i = i[(upper[i] >= lower[i, j]) & (upper[i] >= half[code[i], j])]
        if not len(i):
            continue
        there = _squared(x[i], book[j])
        distance = np.sqrt(there.astype(np.float64))
        lower[i, j] = _down(distance)
        computed += len(i)
        nearer = (there < known[i]) | ((there == known[i]) & (j < code[i]))
        won = i[nearer]
        code[won], known[won], upper[won] = j, there[nearer], _up(distance[nearer])
    return known, computed


def shift(code: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray) -> None:
    """Keep the bounds true after the entries have moved by these distances, in place."""
    way = np.nextafter(moved, np.inf)
    upper[:] = _up(upper.astype(np.float64) + way[code])
    lower[:] = _down(lower.astype(np.float64) - way[None, :])


def integers(df: DataFrame, key: str, vector: str, label: str | None, scale: int) -> DataFrame:
    """row (vec_id, label as text) and x, the integer vector, of the rows that take part."""
    v = F.col(f"`{vector}`").cast("array<double>")
    name = F.col(f"`{label}`").cast("string") if label else F.lit(None).cast("string")
    kept = df.where(whole(v)).select(F.struct(F.col(f"`{key}`").cast("long").alias("vec_id"), name.alias("label")).alias("row"), F.transform(v, lambda x: F.floor(x * scale)).alias("x"))
    return kept


def compress(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str | None = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, np.ndarray]:
    """row (vec_id, label), code (an entry's index a part) and error (squared distances summed over the parts), and the codebooks (parts x entries x length)."""
    spark = df.sparkSession
    importable(spark)
    start = written()
    rows = integers(df, key, vector, label, scale)
    dims = length_of(rows, "x")
    if dims % parts:
        raise ValueError(f"vectors of length {dims} cannot be cut into {parts} equal parts")
    if not dims:
        return spark.createDataFrame([], CODED), np.empty((parts, 0, 0), np.int64)
    rows = rows.where(F.size("x") == dims)
    if rows.where(F.exists("x", lambda v: F.abs(v) > LARGEST)).take(1):
        raise ValueError(f"scaled components must lie within {LARGEST}")
    rows = rows.withColumn("x", F.col("x").cast("array<int>"))
    width = dims // parts
    first = rows.orderBy(F.col("row.vec_id").asc_nulls_last(), "x").limit(entries).collect()
    books = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    k = len(first)

    def turn(books: np.ndarray, moved: np.ndarray | None, last: bool):
        """One assignment over batches of state rows (moved None: rows without bounds so far)."""

        def run(batches):
            n, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.float64)
            exact = np.zeros((parts, k, width), np.int64)
            for whole_batch in batches:
                for at in range(0, whole_batch.num_rows, BATCH):
                    b = whole_batch.slice(at, BATCH)
                    size = b.num_rows
                    x = matrix(b.column("x"), dims).astype(np.int64).reshape(size, parts, width)
                    if moved is None:
                        code, upper, lower = np.zeros((size, parts), np.int64), np.full((size, parts), np.inf, np.float32), np.zeros((size, parts, k), np.float32)
                    else:
                        code, upper = matrix(b.column("code"), parts).astype(np.int64), matrix(b.column("upper"), parts).astype(np.float32)
                        lower = matrix(b.column("lower"), parts * k).astype(np.float32).reshape(size, parts, k)
                    error = np.zeros(size, np.int64)
                    for p in range(parts):
                        c, u, w = code[:, p].copy(), upper[:, p].copy(), lower[:, p].copy()
                        if moved is not None:
                            shift(c, u, w, moved[p])
                        known, _ = reassign(x[:, p], books[p], c, u, w)
                        code[:, p], upper[:, p], lower[:, p] = c, u, w
                        if last:
                            rest = known < 0
                            known[rest] = _squared(x[rest, p], books[p][c[rest]])
                            error += known
                        else:
                            member = (c[:, None] == np.arange(k)).astype(np.float64)
                            n[p] += member.sum(0).astype(np.int64)
                            total[p] = member.T @ x[:, p].astype(np.float64)  # exact: below 2^53
                    if last:
                        yield pa.RecordBatch.from_arrays([b.column("row"), lists(code, pa.int32()), pa.array(error)], names=CODED.names)
                    else:
                        exact += total.astype(np.int64)
                        yield _state(0, b.column("row"), b.column("x"), code, upper, lower.reshape(size, -1))
            if not last and n.any():
                cell = np.flatnonzero(n.ravel())
                yield _sums(cell, n.ravel()[cell], exact.reshape(-1, width)[cell])

        return run

    state, moved, held = rows, None, None
    for _ in range(rounds):
        held = materialize(state.mapInArrow(turn(books, moved, False), STATE), "bounds")
        tidy(start, held)
        sums = held.where("kind = 1").select("cell", "n", F.posexplode("total").alias("at", "v"))
        got = sums.groupBy("cell", "at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"), F.sum("n").alias("n")).collect()  # a number an entry's component
        new = books.copy()
        for r in got:
            new[r["cell"] // k, r["cell"] % k, r["at"]] = int(r["v"]) // r["n"]
        moved = np.sqrt(_squared(new, books).astype(np.float64))
        books, state = new, held.where("kind = 0").select("row", "x", "code", "upper", "lower")
    return state.mapInArrow(turn(books, moved, True), CODED), books


def _state(kind, row, x, code, upper, lower) -> pa.RecordBatch:
    n = len(row)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), row, x, lists(code, pa.int32()), lists(upper, pa.float32()), lists(lower, pa.float32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), no_list(n, pa.int64())], names=STATE.names)


def _sums(cell, n, total) -> pa.RecordBatch:
    m = len(cell)
    return pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.nulls(m, _ROW), no_list(m, pa.int32()), no_list(m, pa.int32()), no_list(m, pa.float32()), no_list(m, pa.float32()), pa.array(cell.astype(np.int32)), pa.array(n), lists(total, pa.int64())], names=STATE.names)


def digest(books: np.ndarray) -> str:
    """SHA-256 of the entries' decimal components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def codes(df: DataFrame, **options) -> DataFrame:
    """vec_id, label (as text), code (two hex digits a part), error, label_error (summed over equal labels, nulls together) and codebooks_sha256."""
    coded, books = compress(df, **options)
    code = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    flat = materialize(coded.select("row.vec_id", "row.label", code.alias("code"), "error", F.when(F.col("row.label").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), "row.label")).alias("_same")), "codes")
    by_label = flat.groupBy("_same").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    out = with_totals(flat, by_label, "_same", flat.count())
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))

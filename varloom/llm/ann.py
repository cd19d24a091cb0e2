"""Approximate nearest neighbours with a hash-prefix forest.

Every vector gets one long bit string a tree (signs of random projections; the
trees draw their planes from one pool).  A tree is the sorted array of these
strings.  A query descends each tree to its longest-prefix matches by binary
search; then all trees ascend together, one bit at a time, and what their
matching ranges hold is compared exactly, in double precision.  The ascent
ends when a row as near as the k-th best so far would have shared one of the
visited prefixes with a probability of at least 1 - `miss`: two vectors at an
angle a agree in a bit with probability p = 1 - a / pi, so all trees miss such
a row with (1 - p^depth)^trees.  How much is visited therefore follows from
the data: little where neighbours are much nearer than the rest, a good part
where vectors spread evenly over all directions.  The rule is the same for
any number of rows.

Largest inner product is turned into smallest angle by one more component,
sqrt(M^2 - |x|^2) for an indexed vector and 0 for a query.

The index is one more such array over all rows, cut into ranges of about
`block_rows` rows: the blocks, each a forest that one task holds.  A query is
first answered in its home block.  Then it is sent on, with the score it must
beat, only to blocks that can hold a nearer row: those with
q.c + |q| r of at least that score, for the block's centre c and radius r.

Rows that repeat both id and vector count once.  An id with several vectors is
several candidates and, as a query, stands for its smallest vector (in the
order of arrays); rows with the query's id are its own and no candidates.
Of equal vectors only the `k` + 1 smallest ids are indexed: by the tie rule
the others can never be returned.  Vectors that are null, empty, all zero, or
hold null or non-finite components, or whose length differs from the longest
group's, take no part; a null id neither.  Other columns are not looked at.
No rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from varloom.llm._shared import importable, materialize, tidy, written

BITS = 24
POOL = 1536  # planes that the trees draw from
ROUTE_BITS = 36
MOST_BLOCKS = 1 << 15  # what one task knows of all blocks is a centre each


class Forest:
    """Sorted hash strings of one block of vectors; `top` is the largest squared length in the whole index."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, top: float, trees: int, seed: int):
        self.ids, self.top, self.trees = ids, top, trees
        self.vectors = np.ascontiguousarray(vectors, dtype=np.float64)
        rng = np.random.default_rng(seed)
        self.planes = rng.standard_normal((vectors.shape[1] + 1, POOL))
        self.picks = np.stack([rng.permutation(POOL)[:BITS] for _ in range(trees)])
        self.compared = 0
        lift = np.sqrt(np.maximum(top - (self.vectors**2).sum(1), 0))
        codes = self._codes(np.hstack([self.vectors, lift[:, None]]))
        order = np.argsort(codes, axis=1, kind="stable")
        self.order = order.astype(np.int32).ravel()
        # One ascending array: the trees' sorted arrays one after another.
        self.sorted = (np.take_along_axis(codes, order, 1) | (np.arange(trees)[:, None] << BITS)).ravel()

    def _codes(self, lifted: np.ndarray) -> np.ndarray:
        bits = lifted @ self.planes > 0
        place = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        return np.stack([bits[:, p] @ place for p in self.picks])

    def search(self, qids: np.ndarray, queries: np.ndarray, low: np.ndarray, k: int, miss: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query its k best rows with a score of at least `low`: (ids, scores), best first, ties to the smaller id."""
        for at in range(0, len(queries), 256):
            part = slice(at, at + 256)
            yield from self._search(qids[part], np.ascontiguousarray(queries[part], dtype=np.float64), low[part], k, math.log(miss))

    def _search(self, qids, queries, low, k, log_miss):
        n, trees = len(self.ids), self.trees
        first = self._codes(np.hstack([queries, np.zeros((len(queries), 1))])) | (np.arange(trees)[:, None] << BITS)
        length = np.sqrt((queries**2).sum(1) * self.top)
        seen = np.zeros((len(queries), n), bool)
        held = [(np.empty(0, np.int64), np.empty(0)) for _ in queries]
        kth, looked = low.copy(), np.zeros(len(queries), np.int64)
        # Descend only where a prefix as long as the block's size asks for still holds more than a few rows.
        begin = min(BITS, n.bit_length() + 2)
        crowded = self._ranges(first, begin)[1].sum(0) >= 4 * k
        open_, waiting = np.flatnonzero(crowded), np.flatnonzero(~crowded)
        for depth in range(BITS, -1, -1):  # ascend, all trees together
            if depth == begin:
                open_ = np.concatenate([open_, waiting])
            if not len(open_):
                if depth < begin:
                    break
                continue
            lo, size = self._ranges(first[:, open_], depth)
            total = size.sum(0)
            left = []
            for j, i in enumerate(open_):
                need = self._needed(depth, kth[i], length[i], log_miss)
                if need > trees and total[j] < 2 * looked[i]:
                    left.append(i)  # hardly more than the last look: ascend on
                    continue
                use = min(need, trees)
                looked[i] = total[j]
                held[i], kth[i] = self._look(lo[:use, j], size[:use, j], seen[i], held[i], qids[i], queries[i], low[i], k)
                if need > trees and self._needed(depth, kth[i], length[i], log_miss) > trees:
                    left.append(i)
            open_ = np.array(left, dtype=np.int64)
        return held

    def _ranges(self, codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Begin and size of what shares `depth` bits with these strings, in the trees' array."""
        prefix = (codes >> (BITS - depth)) << (BITS - depth)
        lo = np.searchsorted(self.sorted, prefix, "left")
        return lo, np.searchsorted(self.sorted, prefix + (1 << (BITS - depth)), "left") - lo

    def _needed(self, depth: int, kth: float, length: float, log_miss: float) -> int:
        """How many trees must be visited at this depth (the others at one bit more); more than all of them: ascend."""
        if depth == 0:
            return 1  # the whole block
        if not math.isfinite(kth):
            return self.trees + 1
        p = 1 - math.acos(max(-1.0, min(1.0, kth / length))) / math.pi
        if p >= 1:
            return 1
        here, deeper = math.log1p(-(p**depth)), math.log1p(-(p ** (depth + 1)))
        if here >= deeper:  # both round to 0
            return self.trees + 1
        return max(1, math.ceil((log_miss - self.trees * deeper) / (here - deeper)))

    def _look(self, lo, size, seen, held, qid, q, low, k):
        """Compare what these ranges hold and was not seen yet; the k best so far and the k-th score."""
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        hit = np.zeros(len(seen), bool)
        hit[self.order[at]] = True
        new = np.flatnonzero(hit & ~seen)
        seen[new] = True
        self.compared += len(new)
        rows = new[self.ids[new] != qid]
        rough = (self.vectors @ q)[rows] if 8 * len(rows) > len(seen) else self.vectors[rows] @ q  # reading all is cheaper than gathering many
        least = low
        if len(rows) + len(held[0]) > k:
            both = np.concatenate([rough, held[1]])
            least = max(low, np.partition(both, len(both) - k)[len(both) - k])
        near = rough >= least - 1e-9 * max(1.0, abs(least)) if math.isfinite(least) else np.ones(len(rows), bool)
        score = (self.vectors[rows[near]] * q).sum(1)  # summed alike wherever the row lies, so ties are exact
        ids, score = np.concatenate([held[0], self.ids[rows[near]]]), np.concatenate([held[1], score])
        best = np.lexsort((ids, -score))
        best = best[score[best] >= low][:k]
        ids, score = ids[best], score[best]
        return (ids, score), (float(score[-1]) if len(score) == k else low)


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id and vec (array<double>) of the rows that take part, each once."""
    v = F.col(f"`{vector}`").cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(f"`{key}`").cast("long").alias("vec_id"), v.alias("vec")).where(F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False))).distinct()


def _vectors(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _lists(vectors: np.ndarray) -> pa.ListArray:
    rows, dims = vectors.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * dims), pa.array(np.ascontiguousarray(vectors).ravel()))


VEC = T.ArrayType(T.DoubleType())
DEALT = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("role", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("vec", VEC)])
#: kind: 0 an indexed row, 1 a query and its k-th score, 2 a block's centre and radius, 3 a pair found (vec_id: query; other, score).
HOME = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("vec", VEC), T.StructField("other", T.LongType()), T.StructField("score", T.DoubleType())])
FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])


def _pairs(qids: np.ndarray, results: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
    got = list(results)
    sizes = [len(i) for i, _ in got]
    ids = np.concatenate([i for i, _ in got]) if got else np.empty(0, np.int64)
    score = np.concatenate([s for _, s in got]) if got else np.empty(0)
    return got, np.repeat(qids, sizes), ids, score


def nearest(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, trees: int = 256, miss: float = 0.06, block_rows: int = 8192, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query (ids divisible by `every`), each of the k missed with a probability of about `miss`."""
    spark = df.sparkSession
    importable(spark)
    start = written()
    rows = materialize(usable(df, key, vector), "vectors")
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    shape = rows.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("top")).orderBy(F.desc("n"), "d").first()
    if shape is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, n, top = shape["d"], shape["n"], shape["top"]
    rows = rows.where(F.size("vec") == dims)
    # Of equal vectors the k + 1 smallest ids: the limit is also applied before the shuffle.
    same = W.partitionBy("vec").orderBy("vec_id")
    indexed = rows.withColumn("_i", F.row_number().over(same)).where(F.col("_i") <= k + 1).select(F.lit(0).alias("role"), "vec_id", "vec")
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vec").alias("vec")).select(F.lit(1).alias("role"), "vec_id", "vec")

    blocks = -(-n // max(block_rows, -(-n // MOST_BLOCKS)))

    def places(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """Where rows stand in the array over all rows: the string's first bits, then a hash of the id, as an exact double."""
        planes = np.random.default_rng(seed + 1).standard_normal((dims, ROUTE_BITS))
        bits = (vectors @ planes > 0) @ (1 << np.arange(ROUTE_BITS - 1, -1, -1, dtype=np.int64))
        spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
        return (bits * 65536 + spread.astype(np.int64)).astype(np.float64)

    def place(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(places(b.column("vec_id").to_numpy(), _vectors(b.column("vec"), dims)))], names=["place"])

    cuts = indexed.select("vec_id", "vec").mapInArrow(place, "place double").approxQuantile("place", [i / blocks for i in range(1, blocks)], 0.25 / blocks) if blocks > 1 else []
    ends = spark.sparkContext.broadcast(np.array(sorted(set(cuts))))  # a number a block

    def deal(batches):
        for b in batches:
            block = np.searchsorted(ends.value, places(b.column("vec_id").to_numpy(), _vectors(b.column("vec"), dims)), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(block), b.column("role"), b.column("vec_id"), b.column("vec")], names=DEALT.names)

    def by_block(batches):
        """(block, role, batch of rows) of a stream that is sorted by block and role."""
        for b in batches:
            here, role = b.column("block").to_numpy(), b.column("role").to_numpy()
            turns = np.flatnonzero((np.diff(here) != 0) | (np.diff(role) != 0)) + 1
            for x, z in zip([0, *turns], [*turns, len(here)], strict=True):
                if x < z:
                    yield int(here[x]), int(role[x]), b.slice(x, z - x)

    def at_home(batches):
        block, forest, ids, vectors = None, None, [], []

        def out(kind, vec_id, vec, other, score):
            m = len(vec_id)
            fill = lambda x, t: pa.nulls(m, t) if x is None else pa.array(x, t)
            return pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int32)), pa.array(np.full(m, block, np.int32)), pa.array(vec_id, pa.int64()), pa.nulls(m, pa.list_(pa.float64())) if vec is None else _lists(vec), fill(other, pa.int64()), fill(score, pa.float64())], names=HOME.names)

        def summary():
            if ids:
                x = np.concatenate(vectors)
                centre = x.mean(0)
                yield out(2, [block], centre[None, :], None, [np.sqrt(((x - centre) ** 2).sum(1)).max()])

        for here, role, part in by_block(batches):
            if here != block:
                yield from summary()
                block, forest, ids, vectors = here, None, [], []
            i, v = part.column("vec_id").to_numpy(), _vectors(part.column("vec"), dims)
            if role == 0:
                ids.append(i)
                vectors.append(v)
                yield out(0, i, v, None, None)
                continue
            if forest is None and ids:
                forest = Forest(np.concatenate(ids), np.concatenate(vectors), top, trees, seed)
            low = np.full(len(v), -np.inf)
            if forest:
                got, pair, near, score = _pairs(i, forest.search(i, v, low, k, miss))
                low = np.array([x[-1] if len(x) == k else -np.inf for _, x in got])
                yield out(3, pair, None, near, score)
            yield out(1, i, v, None, low)
        yield from summary()

    dealt = indexed.unionByName(asked).select("role", "vec_id", "vec").mapInArrow(deal, DEALT).repartition("block").sortWithinPartitions("block", "role")
    home = materialize(dealt.mapInArrow(at_home, HOME), "blocks")
    tidy(start, home)
    # One centre a block, at most MOST_BLOCKS of them.
    known = home.where("kind = 2").select("block", "vec", "score").collect()
    centres = spark.sparkContext.broadcast((np.array([r["block"] for r in known], np.int32), np.array([r["vec"] for r in known]).reshape(-1, dims), np.array([r["score"] for r in known])))
    sent = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("role", T.IntegerType()), *HOME.fields[2:4], HOME.fields[5]])

    def route(batches):
        where, centre, radius = centres.value
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                q, low = _vectors(part.column("vec"), dims), part.column("score").to_numpy()
                reach = q @ centre.T + np.sqrt((q**2).sum(1))[:, None] * radius
                i, j = np.nonzero((reach >= low[:, None] - 1e-9 * np.maximum(1.0, np.abs(reach))) & (where[None, :] != part.column("block").to_numpy()[:, None]))
                yield pa.RecordBatch.from_arrays([pa.array(where[j]), pa.array(np.ones(len(i), np.int32)), part.column("vec_id").take(pa.array(i)), _lists(q[i]), pa.array(low[i])], names=sent.names)

    def visit(batches):
        block, forest, ids, vectors = None, None, [], []
        for here, role, part in by_block(batches):
            if here != block:
                block, forest, ids, vectors = here, None, [], []
            i, v = part.column("vec_id").to_numpy(), _vectors(part.column("vec"), dims)
            if role == 0:
                ids.append(i)
                vectors.append(v)
                continue
            if forest is None:
                forest = Forest(np.concatenate(ids), np.concatenate(vectors), top, trees, seed)
                ids, vectors = [], []
            _, pair, near, score = _pairs(i, forest.search(i, v, part.column("score").to_numpy(), k, miss))
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(near), pa.array(score)], names=FOUND.names)

    asks = home.where("kind = 1").select("block", "vec_id", "vec", "score").mapInArrow(route, sent)
    held = home.where("kind = 0").select("block", F.lit(0).alias("role"), "vec_id", "vec", F.lit(None).cast("double").alias("score"))
    abroad = held.unionByName(asks).repartition("block").sortWithinPartitions("block", "role").mapInArrow(visit, FOUND)
    found = abroad.unionByName(home.where("kind = 3").select(F.col("vec_id").alias("query_id"), F.col("other").alias("vec_id"), "score"))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

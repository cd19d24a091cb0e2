"""Best-fit packing of token sequences, with large-item matching.

Plan: only the number of pieces of each length (at most `capacity` numbers)
is needed to plan the packing of any corpus, so the driver gets that
histogram and nothing else.  Pieces above a third of the capacity go at most
two to a bin: greedy matching gives each, largest first, the largest partner
that fits (a maximum matching).  Smaller pieces then go, largest first, into
the tightest remaining gap.  Equal bins are kept as one run with a count, so
the plan has few rows however large the corpus.

Placing: every piece gets its rank among the pieces of its length (ranks are
made within hash buckets of bounded size, plus the buckets' prefix sums) and
looks its place up in the plan's runs.

Null text counts as empty: its document is the end token alone.  Repeated rows
are packed as separate documents.  No rows give no rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from varloom.llm._shared import bounded_batches, materialize
from varloom.llm.bpe import load, small_batches

PIECES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def cut_points(n: int, capacity: int) -> list[int]:
    """Starts of the pieces of n tokens: full pieces, but the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [0, *range(first, n, capacity)]


def token_pieces(df: DataFrame, vocabulary: str, *, capacity: int = 1024, end_id: int = 2, text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, and `ids` if asked for."""
    bounded_batches(df.sparkSession)
    schema = T.StructType([*PIECES.fields, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])

    def run(batches):
        bpe = load(vocabulary)
        for b in small_batches(batches, 512):
            rows, kept = [], []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(bpe.encode_numpy(t or ""), np.uint32(end_id)).astype("<u4")
                starts = cut_points(len(ids), capacity)
                for p, (s, e) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    rows.append((doc, p, s, e - s, zlib.crc32(ids[s:e].tobytes())))
                    if with_ids:
                        kept.append(ids[s:e].astype(np.int32))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(kept, pa.list_(pa.int32()))] if with_ids else []), names=schema.names)

    return df.select(F.col("doc_id").cast("long"), F.col(f"`{text}`").cast("string")).mapInArrow(run, schema)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Runs of equal bins: (how many, [(length, how often in each bin)])."""
    left = {n: c for n, c in histogram.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("a piece is empty or longer than the capacity")
    large = sorted(n for n in left if 3 * n > capacity)
    runs: list[tuple[int, list[tuple[int, int]], int]] = []  # count, items, gap
    while large:
        a = large[-1]
        at = bisect.bisect_right(large, capacity - a) - 1
        b = large[at] if at >= 0 else None
        if b == a and left[a] < 2:
            b = large[at - 1] if at else None
        if b is None:
            runs.append((left.pop(a), [(a, 1)], capacity - a))
        elif b == a:
            runs.append((left[a] // 2, [(a, 2)], capacity - 2 * a))
            left[a] %= 2
        else:
            m = min(left[a], left[b])
            runs.append((m, [(a, 1), (b, 1)], capacity - a - b))
            left[a] -= m
            left[b] -= m
        large = [n for n in large if left.get(n)]
    by_gap: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)
    done: list[tuple[int, list[tuple[int, int]]]] = []
    for count, items, gap in runs:
        by_gap[gap].append((count, items))
    gaps = sorted(by_gap)

    def put(gap: int, count: int, items: list[tuple[int, int]]) -> None:
        if count:
            if gap not in by_gap:
                bisect.insort(gaps, gap)
            by_gap[gap].append((count, items))

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        todo = left[n]
        while todo:
            at = bisect.bisect_left(gaps, n)
            if at < len(gaps):
                gap = gaps[at]
                count, items = by_gap[gap].pop()
                if not by_gap[gap]:
                    del by_gap[gap]
                    gaps.pop(at)
            else:
                gap, items = capacity, []
                count = max(1, todo // (capacity // n))
            each = min(gap // n, todo)
            full = min(count, todo // each)
            put(gap, count - full, items)
            put(gap - each * n, full, [*items, (n, each)])
            todo -= full * each
    for gap in gaps:
        done += by_gap[gap]
    return done


def runs_table(runs: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, list[tuple[int, int, int, int, int]]]]:
    """For each length its runs: (first rank, end rank, pieces a bin, first sequence, offset)."""
    used: dict[int, int] = defaultdict(int)
    table: dict[int, list[tuple[int, int, int, int, int]]] = defaultdict(list)
    base = 0
    for count, items in runs:
        offset = 0
        for n, each in items:
            table[n].append((used[n], used[n] + count * each, each, base, offset))
            used[n] += count * each
            offset += n * each
        base += count
    return sorted(table.items())


def pack(pieces: DataFrame, *, capacity: int = 1024, bucket_rows: int = 256, most_buckets: int = 4096) -> DataFrame:
    """Add sequence_id and offset to `pieces` (doc_id, piece, length and more).

    `pieces` must be cheap and stable to read twice: give a written table.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    table = runs_table(plan(histogram, capacity))
    run = "struct<first:bigint,last:bigint,each:bigint,base:bigint,at:bigint>"
    plan_df = spark.createDataFrame([(n, max(1, min(most_buckets, -(-histogram[n] // bucket_rows))), rows) for n, rows in table], f"length bigint, _buckets bigint, _runs array<{run}>")  # at most `capacity` rows
    sizes = F.broadcast(plan_df.select("length", "_buckets"))
    dealt = pieces.join(sizes, "length").withColumn("_bucket", F.expr("pmod(xxhash64(doc_id, piece), _buckets)")).drop("_buckets")
    # Where each bucket's ranks begin: a length has at most `most_buckets` buckets.
    counts = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.withColumn("_from", F.sum("_n").over(W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))).select("length", "_bucket", F.coalesce("_from", F.lit(0)).alias("_from"))
    ranked = dealt.withColumn("_rank", F.row_number().over(W.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start")) - 1)
    placed = ranked.join(starts, ["length", "_bucket"]).join(F.broadcast(plan_df.select("length", "_runs")), "length")
    rank = F.col("_rank") + F.col("_from")
    placed = placed.withColumn("_rank", rank).withColumn("_run", F.expr("filter(_runs, r -> r.first <= _rank and _rank < r.last)[0]"))
    return placed.select(
        *[F.col(f"`{c}`") for c in pieces.columns if c.lower() not in ("sequence_id", "offset")],
        F.expr("_run.base + (_rank - _run.first) div _run.each").alias("sequence_id"),
        F.expr("_run.at + ((_rank - _run.first) % _run.each) * length").alias("offset"),
    )


def pack_documents(df: DataFrame, vocabulary: str, *, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Cut, write the narrow piece table in the shared folder, pack it."""
    return pack(materialize(token_pieces(df, vocabulary, capacity=capacity, end_id=end_id), "pieces"), capacity=capacity)


def sequences(pieces_with_ids: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, ids.  A sequence has at most `capacity` ids."""
    return pieces_with_ids.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_p")).select("sequence_id", F.expr("flatten(transform(_p, x -> x.ids))").alias("ids"))

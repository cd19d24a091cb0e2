"""Near-duplicate groups from bottom-k sketches with one hash function.

Words are runs of bytes other than ASCII white space, A-Z in lower case; a
document's set holds its distinct 5-word shingles as 64-bit hashes (fewer
words: the whole sequence as one; none: empty, linked with nothing).  Links:
100 * intersection >= 75 * union.  Groups: connected components of links.

1. Sketch.  One pass over the texts gives each row the size of its set, a
   128-bit digest of it and the smallest hashes, as many as `retained` says.
   Rows with equal digests are one class from here on, so exact copies cost
   nothing more.
2. Inverted lists.  Linked sets of n values have at least a = ceil(3 n / 4) in
   common, so the first n - a + t values of each (in the order of the hash)
   share at least t.  That is a law for sets of up to 512 shingles, and with
   k=None for all.  Larger sets keep k = 176 values; there a linked pair shares
   fewer than t = 48 with odds below 1e-23 (144 draws or more, each shared with
   a probability of at least 3/4), far below those of a collision of 64-bit
   hashes.  A class whose values are mostly found
   nowhere else drops out, and the others enter only the lists of their rarest
   values, as many as the law requires: frequent passages come last and rarely
   enter.  Each list gives edges to one member, not all pairs.
3. Clusters.  Components over those edges hold every link.
4. Verification.  Full sets of clustered classes (a second pass; other texts
   stay where they are) meet by cluster in blocks of bounded rows and values.
   Inside a block the sketches' union gives an estimate and the number of
   values that certainly are in one set only: pairs with too many of these are
   out, the others are verified by exact Jaccard on the full sets, best first,
   leaving out pairs that verified links already join.  A cluster above `block`
   first meets a block of pivots, the classes with the fewest values of their
   own; only classes that stay unlinked then meet those of the rest whose sizes
   allow a link.
5. Components over the verified links; each takes its smallest doc_id.

A key that holds many rows (a frequent value, the
centre of a star, a large group) is joined by broadcast (see `with_totals`) or
dealt out by a hash (see `_stars`).

Rows with a null doc_id are given component_id null and kept true, and link
nothing; they are not named by others.  Repeated rows share their component.
Null text counts as empty.  No rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from varloom.llm._shared import bounded_batches, materialize, tidy, with_totals, written
from varloom.llm.bpe import small_batches

SHARED = 48  # the largest t
K = 176  # values of a sketch at most: the law's number for 512 shingles; None: the law's number for all
VERIFY = 256  # smallest values of a set that are compared before the whole sets
SHINGLE = 5
BLOCK = 512
PIVOTS = 256
VALUES = 1 << 22  # of all sets that meet in a task
_MIX1, _MIX2, _MIX3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _MIX3)  # a random value for each byte
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, all texts in one pass.

    A word's hash is the sum over its bytes of value times a power of an odd
    base, taken from running sums; a shingle mixes the hashes of its words.
    """
    raws = [(t or "").encode() + b" " for t in texts]
    data = np.frombuffer(b"".join(raws), np.uint8)
    base = np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    first, last = edge[0::2], edge[1::2]  # every text ends with a space
    out: list[np.ndarray] = []
    if not len(first):
        return [np.empty(0, np.uint64) for _ in texts]
    length = last - first
    word = np.zeros(len(first), np.uint64)
    # Byte by byte of the words: the words still running shrink quickly.
    running, at = np.arange(len(first)), 0
    while len(running) and at < 64:
        word[running] = word[running] * base + _BYTE[data[first[running] + at]]
        at += 1
        running = running[length[running] > at]
    for i in running:  # a very long word: the rest in one polynomial
        rest = _BYTE[data[first[i] + at : last[i]]]
        powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(rest), base)]))
        word[i : i + 1] = word[i : i + 1] * powers[-1:] + (rest * powers[-2::-1]).sum(dtype=np.uint64, keepdims=True)
    word = mix(word ^ length.astype(np.uint64))
    ends = np.cumsum([len(r) for r in raws])
    bounds = np.concatenate([[0], np.searchsorted(first, ends)])
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        w = word[a:b]
        n = min(SHINGLE, len(w))
        if not n:
            out.append(np.empty(0, np.uint64))
            continue
        h = np.full(len(w) - n + 1, n, np.uint64)
        for j in range(n):
            h = mix(h * _MIX3 + w[j : len(w) - n + 1 + j])
        out.append(np.unique(h))
    return out


def digest(s: np.ndarray) -> bytes:
    """128 bits that name a set."""
    a = mix(s * _MIX3 + np.uint64(1)).sum(dtype=np.uint64)
    b = mix(s * _MIX1 + np.uint64(2)).sum(dtype=np.uint64) + np.uint64(len(s))
    return int(mix(np.array([a]))[0]).to_bytes(8, "big") + int(mix(np.array([b]))[0]).to_bytes(8, "big")


def least_shared(n: int) -> int:
    """t of the law for a set of n values; it never falls as n grows."""
    return min(-(-3 * n // 4), max(8, n // 4), SHARED)


def retained(n: int, k: int | None = K) -> int:
    """How many of a set's smallest values its sketch keeps: two linked sets share at least the smaller t of the two there."""
    exact = n - -(-3 * n // 4) + least_shared(n)
    return min(exact, k) if k else exact


def _longs(lists: list[np.ndarray]) -> pa.Array:
    sizes = np.array([0, *map(len, lists)])
    flat = np.concatenate(lists).view(np.int64) if lists else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(flat))


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int | None = K) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest (of the set; null if empty), sketch."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_hash", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("sketch", T.ArrayType(T.LongType()))])

    def run(batches):
        for b in small_batches(batches):
            sets = shingle_sets(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) if len(s) else None for s in sets], pa.binary()), _longs([s[: retained(len(s), k)] for s in sets])], names=schema.names)

    t = F.col(f"`{text}`").cast("string")
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.xxhash64(t).alias("text_hash"), t.alias("text")).mapInArrow(run, schema)


def _lists(values: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """Keep the values found in more than one class, and the classes with at least their bound of such values: node, size, least, shared (sorted rarest first)."""
    shared = values.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    met = with_totals(values, shared, "value", total)
    return met.groupBy("node").agg(F.array_sort(F.collect_list(F.struct(F.col("n").alias("df"), "value"))).alias("shared")).join(least, "node").where(F.size("shared") >= F.col("least"))


def candidate_edges(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges of the clusters: a, b; own: node, own = number of values found nowhere else)."""
    # The smallest set that a linked one can be has a = ceil(3 n / 4) values; its t holds for both.
    bound = f"least((3 * ((3 * n_shingles + 3) div 4) + 3) div 4, greatest(8, ((3 * n_shingles + 3) div 4) div 4), {SHARED})"
    least = classes.select("node", F.size("sketch").alias("size"), F.expr(bound).cast("int").alias("least"))
    values = classes.select("node", F.explode("sketch").alias("value"))
    total = classes.agg(F.sum(F.size("sketch"))).first()[0] or 0
    once = materialize(_lists(values, least, total).select("node", F.explode("shared.value").alias("value")), "lists")
    # Once more among the classes that are left: some values are now single.
    left = materialize(_lists(once, least, once.count()), "lists")
    # Of a class's values, those found nowhere else come first in the order; they fill places of the prefix.
    take = F.col("size") - F.col("least") + 1 - (F.col("size") - F.size("shared"))
    entries = left.where(take > 0).select("node", F.explode(F.expr("slice(shared.value, 1, size(shared) - least + 1)")).alias("value"))
    entries = materialize(entries, "entries")
    head = entries.groupBy("value").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    edges = with_totals(entries, head, "value", entries.count()).where(F.col("node") != F.col("a")).select("a", F.col("node").alias("b")).distinct()
    return edges, left.select("node", (F.col("size") - F.size("shared")).alias("own"))


def _stars(rows: DataFrame, salts: int = 256) -> DataFrame:
    """`rows` (u, v) with m, the smallest v of each u.

    A u of many rows stays dealt out by a hash of v: its minima are made per
    deal, then over the deals, and go back to each deal.
    """
    dealt = rows.withColumn("s", F.expr(f"cast(pmod(xxhash64(v), {salts}) as int)"))
    part = dealt.groupBy("u", "s").agg(F.min("v").alias("m"))
    low = part.groupBy("u").agg(F.min("m").alias("m"), F.collect_list("s").alias("_s")).select("u", "m", F.explode("_s").alias("s"))  # at most `salts` a u
    return dealt.join(low, ["u", "s"]).select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) by large-star and small-star rounds.

    Each round is written to the shared folder.  Rounds end when a round
    changes nothing, seen by a checksum of the edges; their number grows with
    the square of the logarithm of the edges at most.
    """
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    old, seen = None, mark(now)
    while seen != old:
        before = written()
        # Large star: every larger neighbour of u moves to the smallest of u's neighbourhood.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialize(_stars(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "stars")
        # Small star: every smaller neighbour of u, and u itself, moves to the smallest of them.
        small = _stars(large).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = materialize(small.where("u != v").distinct(), "edges")
        old, seen = seen, mark(now)
        tidy(before - 1, now)  # the round before
    star = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return star.unionByName(star.select(F.col("root").alias("node"), "root").distinct())


def bitmap(nodes: DataFrame) -> tuple[int, bytes]:
    """(bits, map): a bit for each value of the first `bits` bits of a digest, about 16 times as many as nodes, from 2^20 to 2^28 (32 MB)."""
    bits = min(28, max(20, (16 * nodes.count()).bit_length()))
    at = F.shiftright(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), 32 - bits)
    rows = nodes.select(at.alias("p")).where("p > 0").groupBy(F.expr("bitmap_bucket_number(p)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("m")).collect()  # at most 2^28 bits
    out = bytearray((1 << bits) // 8 + 4096)
    for r in rows:
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = r["m"]
    return bits, bytes(out)


def full_sets(docs: DataFrame, nodes: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """digest, set for the given digests: a second pass over the texts that sends on only sets whose bit is set."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(nodes))  # 32 MB at most
    schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("set", T.ArrayType(T.LongType()))])

    def run(batches):
        (bits, held), sent = shared.value, set()
        for b in small_batches(batches):
            names, sets = [], []
            for s in shingle_sets(b.column(0).to_pylist()):
                if len(s):
                    d = digest(s)
                    if d not in sent and _bit(held, int.from_bytes(d[:4], "big") >> (32 - bits)):
                        if len(sent) < 1 << 17:  # copies beyond are brought together after the pass
                            sent.add(d)
                        names.append(d)
                        sets.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), _longs(sets)], names=schema.names)

    return docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(run, schema)


def _bit(bits: bytes, p: int) -> bool:
    """Whether Spark's bitmap functions have set the bit of p (they count from 1)."""
    if p == 0:
        return True  # its bucket is not kept; such nodes are always sent on
    bucket, position = 1 + (p - 1) // 32768, (p - 1) % 32768
    return bool(bits[(bucket - 1) * 4096 + position // 8] >> (position % 8) & 1)


def union_sketch(sets: list[np.ndarray], k: int, cross: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For all pairs (`cross`: of the first so many with the others): the Jaccard estimate, and how many values are in one of the two sets for certain.

    Below the smaller of the two sketches' ends both sets are known wholly,
    so what one of them lacks there it lacks at all.
    """
    n = len(sets)
    sk = [s[:k] for s in sets]
    ends = np.array([s[k - 1] if len(s) > k else np.uint64(0xFFFFFFFFFFFFFFFF) for s in sets])
    within = np.stack([np.searchsorted(s, ends, "right") for s in sk]).astype(np.float32)
    who = np.repeat(np.arange(n), [len(s) for s in sk])
    _, place, df = np.unique(np.concatenate(sk), return_inverse=True, return_counts=True)
    many = df > 1
    column, many = (np.cumsum(many) - 1)[place], many[place]
    order = np.argsort(column[many], kind="stable")
    column, who = column[many][order], who[many][order]
    rows, columns = (slice(0, n), slice(0, n)) if cross is None else (slice(0, cross), slice(cross, n))
    both = np.zeros((len(range(n)[rows]), len(range(n)[columns])), np.float32)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [c, c + 4096])
        held = np.zeros((n, 4096), np.float32)
        held[who[a:b], column[a:b] - c] = 1
        both += held[rows] @ held[columns].T
    union = within[rows, columns] + within[columns, rows].T - both
    return both / np.maximum(union, 1), union - both


def verified_links(sets: list[np.ndarray], k: int = VERIFY, cross: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the linked pairs among these sets, or between the first `cross` and the others (exact)."""
    n = len(sets)
    if n < 2:
        return []
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    size = np.array([len(s) for s in sets])
    guess, apart = union_sketch(sets, k, cross)
    if cross is None:
        left, right = np.triu_indices(n, 1)
        guess, apart = guess[left, right], apart[left, right]
    else:
        left, right = np.repeat(np.arange(cross), n - cross), np.tile(np.arange(cross, n), cross)
        guess, apart = guess.ravel(), apart.ravel()
    low, high = np.minimum(size[left], size[right]), np.maximum(size[left], size[right])
    # A pair is linked if at most a seventh of both sizes together is in one set only.
    ok = (100 * low >= 75 * high) & (7 * apart <= low + high)
    left, right = left[ok], right[ok]
    links = []
    for i in np.argsort(-guess[ok], kind="stable"):
        a, b = int(left[i]), int(right[i])
        ra, rb = find(a), find(b)
        if ra == rb:
            continue
        x, y = (sets[a], sets[b]) if size[a] <= size[b] else (sets[b], sets[a])
        at = np.searchsorted(y, x)
        both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
        if 100 * both >= 75 * (len(x) + len(y) - both):
            root[ra] = rb
            links.append((a, b))
    return links


LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _by_task(rows: DataFrame, out: T.StructType, work) -> DataFrame:
    """Bring the rows of each `task` together in one stream of tasks; `work(task rows as columns)` yields rows of `out`.

    Columns of rows: task, role, node, set.  A task has a bounded number of rows.
    """

    def run(batches):
        held: list[tuple] = []
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(3)]
            sets = b.column(3)
            flat, offs = sets.values.to_numpy(zero_copy_only=False).view(np.uint64), sets.offsets.to_numpy()
            done = []
            for i, (task, role, node) in enumerate(zip(*cols, strict=True)):
                if held and held[-1][0] != task:
                    done += work(held)
                    held = []
                held.append((task, role, node, flat[offs[i] : offs[i + 1]].copy()))
            yield _rows(done, out)
        yield _rows(work(held) if held else [], out)

    return rows.repartition("task").sortWithinPartitions("task", "role", "node").mapInArrow(run, out)


def _rows(rows: list[tuple], out: T.StructType) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(out)
    return pa.RecordBatch.from_arrays([pa.array(c, {"bigint": pa.int64(), "int": pa.int32()}[f.dataType.simpleString()]) for c, f in zip(cols, out.fields, strict=True)], names=out.names)


def links(docs: DataFrame, classes: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK, pivots: int = PIVOTS, values: int = VALUES) -> DataFrame:
    """Verified links (a, b) that join every group."""
    edges, own = candidate_edges(classes)
    clusters = materialize(components(edges).join(classes.select("node", "digest", "n_shingles"), "node"), "clusters")
    # Blocks of a cluster: as many as its rows and its values need.
    n_blocks = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n_shingles") / values)).cast("int")
    counts = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("n"), n_blocks.alias("blocks"))
    sized = with_totals(clusters, counts, "root", clusters.count())
    sets = materialize(sized.join(full_sets(docs, clusters, key, text).dropDuplicates(["digest"]), "digest").drop("digest").join(own, "node", "left"), "sets")

    def all_pairs(held):
        return [(held[i][2], held[j][2]) for i, j in verified_links([h[3] for h in held])]

    near = sets.where(F.col("blocks") == 1).select(F.hex("root").alias("task"), F.lit(0).alias("role"), "node", "set")
    out = _by_task(near, LINKS, all_pairs)
    big = sets.where(F.col("blocks") > 1)
    if not big.take(1):
        return out
    # Large clusters: pivots first (the classes with the fewest values of their own).
    rank = F.row_number().over(W.partitionBy("root").orderBy("own", "node"))
    first = materialize(big.withColumn("_r", rank).where(F.col("_r") <= pivots).select("root", "blocks", "node", "set", "n_shingles", "_r"), "pivots")
    so_far = F.sum("n_shingles").over(W.partitionBy("root").orderBy("_r").rowsBetween(W.unboundedPreceding, 0))  # at most `pivots` rows a cluster
    pivot = first.withColumn("_v", so_far).where((F.col("_v") <= values) | (F.col("_r") == 1)).select("root", "blocks", "node", "set")
    others = big.select("root", "blocks", "node", "set").join(pivot.select("node"), "node", "left_anti")
    name = lambda *x: F.concat_ws("/", F.hex("root"), *[c.cast("string") for c in x])
    dealt = others.select(name(F.expr("pmod(xxhash64(node), blocks)")).alias("task"), F.lit(1).alias("role"), "node", "set")
    spread = pivot.select("root", "node", "set", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j")).select(name(F.col("j")).alias("task"), F.lit(0).alias("role"), "node", "set")
    marked = T.StructType([*LINKS.fields, T.StructField("open", T.IntegerType())])

    def against_pivots(held):
        found = verified_links([h[3] for h in held])
        n_pivots = sum(h[1] == 0 for h in held)
        first = verified_links([h[3] for h in held[:n_pivots]])
        main = _largest(n_pivots, first)
        joined = _label(len(held), found)
        home = {joined[i] for i in main}
        rows = [(held[i][2], held[j][2], 0) for i, j in found] + [(held[i][2], held[j][2], 0) for i, j in first]
        return rows + [(h[2], h[2], 1) for i, h in enumerate(held) if joined[i] not in home]

    met = materialize(_by_task(spread.unionByName(dealt), marked, against_pivots), "met")
    out = out.unionByName(met.where("open = 0").select("a", "b"))
    # What no pivot's group took in meets the cluster.  Both sides are cut, in the order of their sizes, into sides of
    # bounded rows and values; only sides whose sizes can be linked meet, so a set is sent to few tasks.
    opened = met.where("open = 1").select(F.col("a").alias("node")).distinct()
    every = _sides(big, 4 * block, values // 2)
    few = _sides(big.join(opened, "node", "left_semi"), 4 * block, values // 2)
    ranges = lambda d, c: d.groupBy("root", F.col("side").alias(c)).agg(F.min("n_shingles").alias(f"lo_{c}"), F.max("n_shingles").alias(f"hi_{c}"))
    tiles = materialize(ranges(few, "i").join(ranges(every, "j"), "root").where("100 * hi_i >= 75 * lo_j and 100 * hi_j >= 75 * lo_i").select("root", "i", "j"), "tiles")  # (rows / side)^2 at most
    to = lambda d, c, role: d.withColumnRenamed("side", c).join(F.broadcast(tiles), ["root", c]).select(name(F.col("i"), F.col("j")).alias("task"), F.lit(role).alias("role"), "node")
    sent = to(few, "i", 0).unionByName(to(every, "j", 1)).join(big.select("node", "set"), "node").select("task", "role", "node", "set")

    def loose_against_all(held):
        low, high = ([h for h in sorted(held, key=lambda h: (len(h[3]), h[2])) if h[1] == role] for role in (0, 1))
        return [pair for x in range(0, len(low), block // 2) for y in range(0, len(high), block) for pair in _between(low[x : x + block // 2], high[y : y + block])]

    return out.unionByName(_by_task(sent, LINKS, loose_against_all))


def _sides(rows: DataFrame, most: int, values: int) -> DataFrame:
    """root, node, n_shingles, side: each cluster's rows in the order of their sizes, cut after `most` rows or so many values."""
    by = W.partitionBy("root").orderBy("n_shingles", "node")  # numbers of one cluster, no sets
    # Sizes ascend, so a side never holds more rows than one step of either count.
    side = F.greatest(F.floor((F.row_number().over(by) - 1) / most), F.floor((F.sum("n_shingles").over(by.rowsBetween(W.unboundedPreceding, 0)) - F.col("n_shingles")) / values))
    return materialize(rows.select("root", "node", "n_shingles").withColumn("side", side.cast("int")), "sides")


def _between(low: list[tuple], high: list[tuple]) -> list[tuple[int, int]]:
    """Verified links between rows of two lists sorted by size; none if no sizes of theirs can be linked."""
    if not low or not high or 100 * len(low[-1][3]) < 75 * len(high[0][3]) or 100 * len(high[-1][3]) < 75 * len(low[0][3]):
        return []
    rows = low + high
    return [(rows[i][2], rows[j][2]) for i, j in verified_links([h[3] for h in rows], cross=len(low)) if rows[i][2] != rows[j][2]]


def _label(n: int, found: list[tuple[int, int]]) -> list[int]:
    label = list(range(n))

    def find(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for a, b in found:
        label[find(a)] = find(b)
    return [find(i) for i in range(n)]


def _largest(n: int, found: list[tuple[int, int]]) -> list[int]:
    label = _label(n, found)
    count: dict[int, list[int]] = {}
    for i, x in enumerate(label):
        count.setdefault(x, []).append(i)
    return max(count.values(), key=lambda m: (len(m), -m[0])) if count else []


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int | None = K, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept, digest (of the class) and text_hash (xxhash64 of the text)."""
    bounded_batches(docs.sparkSession)
    start = written()
    sketched = rows = materialize(sketches(docs, key, text, k), "sketches")
    named = F.col("doc_id").isNotNull() & F.col("digest").isNotNull()
    # A class is known by a number from here on; the table is written, so it stays.
    classes = materialize(rows.where(named).select("digest", "n_shingles", "sketch").dropDuplicates(["digest"]).withColumn("node", F.monotonically_increasing_id()), "classes")
    rows = rows.drop("sketch")
    found = components(links(docs, classes, key, text, block, pivots))
    low = rows.where(named).groupBy("digest").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies")).join(classes.select("digest", "node"), "digest")
    rooted = materialize(low.join(found, "node", "left").select("digest", "low", "copies", F.coalesce("root", "node").alias("root")), "rooted")
    tidy(start, sketched, rooted)
    smallest = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("n"))
    by_class = with_totals(rooted, smallest, "root", rooted.count()).select("digest", "component_id", F.col("copies").alias("n"))
    grouped = with_totals(rows.where(named), by_class, "digest", rows.count()).select(*rows.columns, "component_id")
    out = grouped.unionByName(rows.where(~named).withColumn("component_id", F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", "digest", "text_hash").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

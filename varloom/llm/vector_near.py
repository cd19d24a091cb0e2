"""Near-duplicate vectors by an epsilon grid order join.

Vectors of one label are linked if their cosine reaches a threshold t; for unit
vectors that is a distance of at most eps = sqrt(2 - 2 t).

1. Classes.  Equal vectors of a label are one class with a count of copies.
2. Grid order.  Unit vectors are projected on the leading principal directions
   (eigenvectors of the second moments of all rows); cells of width eps on
   these give the order: by label, then cell by cell, then number.
3. Sequence.  Ranges of that order are cut into blocks of bounded rows.  A block
   has a box (in the projection), a centre and a radius.
4. Recursion.  Two intervals of the sequence are halved until they are told
   apart or are leaves: no common label, boxes or balls farther than eps apart
   (no link; projections never lengthen a distance), or both balls together
   within eps (all rows link; counted without looking at pairs).  This runs
   over the blocks, and inside two blocks that meet over leaves of 64 rows,
   which are compared exactly in double precision.
5. A block meets its partners in tasks of at most 32 of them.  A task returns
   the number of links of each row and a spanning forest, never the pairs.
   Components over the forests give the groups.

What the driver and all tasks hold is a summary a block, at most about 32,768
and one a partition.  A group of near copies of any size costs what its blocks
cost: blocks that lie within eps of each other are linked as wholes.

Vectors that are null, zero, of another than the commonest length, or hold null
or non-finite components, and rows with a null label, link with nothing.  Rows
that repeat id, label and vector count once and are returned once; an id with
several vectors is several rows.  A null id links with nothing, and its
component is null and kept true.  No rows give no rows.  Columns of other names
are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from varloom.llm._shared import importable, materialize, tidy, with_totals, written
from varloom.llm._vectors import length_of, lists, matrix, whole
from varloom.llm.minhash import components

LEAF = 64
VISITS = 32
LEADING = 8
MOST_BLOCKS = 1 << 15

_VEC = T.ArrayType(T.DoubleType())
#: Rows of blocks (kind 0; weight: copies), and a summary of each block (kind 1; weight: all copies, vec: centre).
DEALT = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("node", T.LongType()), T.StructField("label", T.StringType()), T.StructField("last", T.StringType()), T.StructField("weight", T.LongType()), T.StructField("vec", _VEC), T.StructField("low", _VEC), T.StructField("high", _VEC), T.StructField("radius", T.DoubleType())])
#: kind 0: n links of node a; kind 1: an edge a, b; of blocks, kind 2: block a meets block b; kind 3: all of block a links with the blocks number b to n; kind 4: which hold n rows.
MET = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("n", T.LongType())])


def _met(kind: int, a, b, n) -> pa.RecordBatch:
    m = len(a)
    col = lambda x: pa.array(np.broadcast_to(np.asarray(x, np.int64), m))
    return pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int32)), col(a), col(b), col(n)], names=MET.names)


class Sequence:
    """A binary tree over a sequence of leaves (boxes, balls, label ranges, weights); level 0 holds the leaves, a node covers those of its two children."""

    def __init__(self, first, last, low, high, centre, radius, weight, size):
        level = {"first": first, "last": last, "low": low, "high": high, "centre": centre, "radius": radius, "weight": weight, "size": size}
        self.levels = [level]
        while len(level["first"]) > 1:
            level = self._halve(level)
            self.levels.append(level)

    @staticmethod
    def _halve(x: dict) -> dict:
        n = len(x["first"])
        left, right = np.arange(0, n, 2), np.minimum(np.arange(1, n + 1, 2), n - 1)
        twice = left != right
        size = x["size"][left] + x["size"][right] * twice
        share = (x["size"][right] * twice / size)[:, None]
        centre = x["centre"][left] * (1 - share) + x["centre"][right] * share
        reach = lambda side: np.sqrt(((x["centre"][side] - centre) ** 2).sum(1)) + x["radius"][side]
        return {"first": x["first"][left], "last": x["last"][right], "low": np.minimum(x["low"][left], x["low"][right]), "high": np.maximum(x["high"][left], x["high"][right]), "centre": centre, "radius": np.maximum(reach(left), reach(right)) * (1 + 1e-12), "weight": x["weight"][left] + x["weight"][right] * twice, "size": size}

    @property
    def top(self) -> tuple[int, int]:
        return len(self.levels) - 1, 0

    def leaves(self, node: tuple[int, int]) -> tuple[int, int]:
        """The interval of leaves below a node."""
        level, i = node
        return i << level, min((i + 1) << level, len(self.levels[0]["first"]))

    def children(self, level: int, i: int) -> list[tuple[int, int]]:
        return [(level - 1, j) for j in (2 * i, 2 * i + 1) if j < len(self.levels[level - 1]["first"])]


def meet(one: Sequence, two: Sequence, eps: float, start: tuple[tuple[int, int], tuple[int, int]] | None = None, mirrored: bool = False):
    """Recursion over intervals of two sequences: ("all", node, node) for intervals all of whose rows link, ("leaf", i, j) for leaves to be compared.

    `mirrored`: both are one sequence; each unordered pair comes once.
    """
    near, far = eps * (1 - 1e-9) - 1e-9, eps * (1 + 1e-9) + 1e-9
    stack = [start or (one.top, two.top)]
    while stack:
        (la, i), (lb, j) = stack.pop()
        if mirrored and la == lb and i > j:
            continue
        a, b = one.levels[la], two.levels[lb]
        if a["first"][i] > b["last"][j] or b["first"][j] > a["last"][i]:
            continue
        gap = np.maximum(0.0, np.maximum(a["low"][i] - b["high"][j], b["low"][j] - a["high"][i]))
        if math.sqrt(float(gap @ gap)) > far:
            continue
        d = a["centre"][i] - b["centre"][j]
        apart, reach = math.sqrt(float(d @ d)), float(a["radius"][i] + b["radius"][j])
        if apart - reach > far:
            continue
        # For intervals by a little more, so that it holds for each leaf of theirs, seen from either side.
        if apart + reach <= (near if la == lb == 0 else near - 1e-8) and a["first"][i] == a["last"][i] == b["first"][j] == b["last"][j]:
            yield "all", (la, i), (lb, j)
        elif la == lb == 0:
            yield "leaf", i, j
        elif mirrored and la == lb:
            kids = one.children(la, i), two.children(lb, j)
            stack += [(x, y) for x in kids[0] for y in kids[1]]
        elif la >= lb:
            stack += [(x, (lb, j)) for x in one.children(la, i)]
        else:
            stack += [((la, i), y) for y in two.children(lb, j)]


def _find(root: np.ndarray, x: np.ndarray) -> np.ndarray:
    r = root[x]
    while True:
        up = root[r]
        if np.array_equal(up, r):
            return r
        r = up


def join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union a[i] with b[i] for all i; roots are the smallest members."""
    while len(a):
        x, y = _find(root, a), _find(root, b)
        open_ = x != y
        if not open_.any():
            return
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))


class Block:
    """Rows of a block in grid order, with a tree over leaves of LEAF rows."""

    def __init__(self, nodes: np.ndarray, labels: list[str], weights: np.ndarray, vectors: np.ndarray, basis: np.ndarray, names: dict[str, int]):
        self.nodes, self.weights, self.vectors = nodes, weights, vectors
        self.labels = np.array([names.setdefault(x, len(names)) for x in labels], np.int64)  # numbers that hold within a task
        sorted_labels = _bytes(labels)
        seen = vectors @ basis
        n = len(nodes)
        cuts = np.arange(0, n, LEAF)
        ends = np.minimum(cuts + LEAF, n)
        size = (ends - cuts).astype(float)
        centre = np.add.reduceat(vectors, cuts) / size[:, None]
        radius = np.sqrt(np.maximum.reduceat(((vectors - np.repeat(centre, ends - cuts, 0)) ** 2).sum(1), cuts)) * (1 + 1e-12)
        self.tree = Sequence(sorted_labels[cuts], sorted_labels[ends - 1], np.minimum.reduceat(seen, cuts), np.maximum.reduceat(seen, cuts), centre, radius, np.add.reduceat(weights, cuts), size)

    def rows(self, node: tuple[int, int]) -> slice:
        lo, hi = self.tree.leaves(node)
        return slice(lo * LEAF, min(hi * LEAF, len(self.nodes)))


def compare(home: Block, other: Block, t: float, eps: float, root: np.ndarray, n_home: np.ndarray, n_other: np.ndarray) -> None:
    """Add the links between two blocks (or within one) to the rows' counts and to the forest `root` (home's rows, then the other's)."""
    same = home is other
    shift = 0 if same else len(home.nodes)
    pend_a, pend_b, held = [], [], 0
    for kind, x, y in meet(home.tree, other.tree, eps, mirrored=same):
        ra, rb = home.rows(x if kind == "all" else (0, x)), other.rows(y if kind == "all" else (0, y))
        if kind == "all":
            n_home[ra] += other.weights[rb].sum()
            if same and ra == rb:
                n_home[ra] -= home.weights[ra]
            elif same:
                n_home[rb] += home.weights[ra].sum()
            else:
                n_other[rb] += home.weights[ra].sum()
            every = np.concatenate([np.arange(ra.start, ra.stop), np.arange(rb.start, rb.stop) + shift])
            join(root, every, np.full(len(every), every[0]))
            continue
        link = (home.vectors[ra] @ other.vectors[rb].T >= t) & (home.labels[ra][:, None] == other.labels[rb][None, :])
        if same and ra == rb:
            np.fill_diagonal(link, False)
        if not link.any():
            continue
        n_home[ra] += link @ other.weights[rb]
        if not same:
            n_other[rb] += home.weights[ra] @ link
        elif ra != rb:
            n_home[rb] += home.weights[ra] @ link
        i, j = np.nonzero(link)
        pend_a.append(i + ra.start)
        pend_b.append(j + rb.start + shift)
        held += len(i)
        if held > 1 << 18:
            join(root, np.concatenate(pend_a), np.concatenate(pend_b))
            pend_a, pend_b, held = [], [], 0
    if pend_a:
        join(root, np.concatenate(pend_a), np.concatenate(pend_b))


def _bytes(labels: list[str]) -> np.ndarray:
    """Labels in the order in which Spark sorts them."""
    out = np.empty(len(labels), object)
    out[:] = [x.encode() for x in labels]
    return out


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def directions(classes: DataFrame, dims: int, most: int) -> np.ndarray:
    """The leading eigenvectors (dims x most) of the unit vectors' second moments, over all rows."""

    def moments(batches):
        total = np.zeros((dims, dims))
        for b in batches:
            u = _unit(matrix(b.column("vec"), dims))
            total += u.T @ u
        yield pa.RecordBatch.from_arrays([lists(total.reshape(1, -1), pa.float64())], names=["m"])

    def add(batches):
        total = np.zeros(dims * dims)
        for b in batches:
            total += matrix(b.column("m"), dims * dims).sum(0)
        yield pa.RecordBatch.from_arrays([lists(total.reshape(1, -1), pa.float64())], names=["m"])

    sums = classes.select("vec").mapInArrow(moments, "m array<double>").repartition(16).mapInArrow(add, "m array<double>")
    total = np.array([r["m"] for r in sums.collect()]).sum(0).reshape(dims, dims)  # 16 matrices
    _, basis = np.linalg.eigh(total)
    return np.ascontiguousarray(basis[:, ::-1][:, :most])


def near_vectors(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98, block: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row a row of `df` (repeated rows once)."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie above 0 and at most at 1")
    spark = df.sparkSession
    importable(spark)
    start = written()
    rows = df.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("vec"))
    ok = F.coalesce(whole(F.col("vec")) & F.exists("vec", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    rows = materialize(rows.distinct().withColumn("takes", ok), "vectors")
    dims = length_of(rows.where("takes"), "vec")
    used = F.col("takes") & (F.size("vec") == dims)
    same = F.struct("label", "vec").alias("_same")
    grouped = rows.where(used).groupBy("label", "vec").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    total = classes.count()
    alone = rows.where(~used).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not total:
        return alone
    found = materialize(links(classes, dims, total, threshold, block), "links")
    tidy(start, rows, classes, found)
    linked = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    rooted = components(found.where("kind = 1").select("a", "b"))
    told = classes.join(linked, "node", "left").join(rooted, "node", "left").select(same, "low", "copies", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"))
    told = materialize(told, "told")
    smallest = told.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("n"))
    by_class = with_totals(told, smallest, "root", total).select("_same", "n_links", "component_id", F.col("copies").alias("n"))
    kept = rows.where(used).select("vec_id", same)
    out = with_totals(kept, by_class, "_same", rows.count()).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return out.unionByName(alone)


def links(classes: DataFrame, dims: int, total: int, threshold: float, block: int) -> DataFrame:
    """MET rows of kinds 0 (counts of links) and 1 (edges of forests) of classes (label, vec, node, copies)."""
    spark = classes.sparkSession
    eps = math.sqrt(max(0.0, 2 - 2 * threshold))
    width = max(eps, 1e-6)
    bits = int(2 / width + 2).bit_length()
    leading = max(1, min(LEADING, dims, 62 // bits))
    basis = directions(classes, dims, leading)
    most = max(block, -(-total // MOST_BLOCKS))

    def place(batches):
        for b in batches:
            u = _unit(matrix(b.column("vec"), dims))
            cell = np.clip(np.floor((u @ basis + 1) / width), 0, (1 << bits) - 1).astype(np.int64)
            at = np.zeros(len(u), np.int64)
            for d in range(leading):
                at = (at << bits) | cell[:, d]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(at), b.column("node"), b.column("copies"), lists(u, pa.float64())], names=["label", "place", "node", "copies", "vec"])

    placed = materialize(classes.select("label", "node", "copies", "vec").mapInArrow(place, "label string, place long, node long, copies long, vec array<double>"), "placed")

    def cut(batches):
        """Blocks of consecutive rows, each followed by its summary."""
        turn, held, n = 0, [], 0
        part = TaskContext.get().partitionId()

        def close():
            b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            name, u = (part << 32) | turn, matrix(b.column("vec"), dims)
            size, seen, centre = len(u), u @ basis, u.mean(0)
            radius = float(np.sqrt(((u - centre) ** 2).sum(1).max())) * (1 + 1e-12)
            none = pa.nulls(size, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(size, np.int32)), pa.array(np.full(size, name, np.int64)), pa.array(np.arange(size, dtype=np.int32)), b.column("node"), b.column("label"), pa.nulls(size, pa.string()), b.column("copies"), b.column("vec"), none, none, pa.nulls(size, pa.float64())], names=DEALT.names)
            one = lambda x, t: pa.array([x], t)
            yield pa.RecordBatch.from_arrays([one(1, pa.int32()), one(name, pa.int64()), one(0, pa.int32()), one(size, pa.int64()), one(b.column("label")[0].as_py(), pa.string()), one(b.column("label")[-1].as_py(), pa.string()), one(int(b.column("copies").to_numpy().sum()), pa.int64()), lists(centre[None], pa.float64()), lists(seen.min(0)[None], pa.float64()), lists(seen.max(0)[None], pa.float64()), one(radius, pa.float64())], names=DEALT.names)

        for b in batches:
            at = 0
            while at < b.num_rows:
                take = min(most - n, b.num_rows - at)
                held.append(b.slice(at, take))
                at, n = at + take, n + take
                if n == most:
                    yield from close()
                    turn, held, n = turn + 1, [], 0
        if held:
            yield from close()

    order = ["label", "place", "node"]
    dealt = materialize(placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, DEALT), "dealt")
    known = dealt.where("kind = 1").orderBy("block").collect()  # a summary a block
    of = lambda c, kind: np.array([r[c] for r in known], kind)
    blocks = of("block", np.int64)
    sequence = Sequence(_bytes([r["label"] for r in known]), _bytes([r["last"] for r in known]), of("low", float), of("high", float), of("vec", float), of("radius", float), of("weight", np.int64), of("node", float))
    sent = spark.sparkContext.broadcast((blocks, sequence))

    def partners(batches):
        """Which blocks a block meets, and with which intervals of blocks it links as a whole."""
        where, tree = sent.value
        for b in batches:
            for i in b.column("id").to_pylist():
                mine, close, lo, hi = [], 0, [], []
                for kind, _, y in meet(tree, tree, eps, ((0, i), tree.top)):
                    if kind == "leaf":
                        if y >= i:
                            mine.append(y)
                        continue
                    first, stop = tree.leaves(y)
                    close += int(tree.levels[y[0]]["weight"][y[1]])
                    lo.append(first)
                    hi.append(stop)
                if mine:
                    yield _met(2, np.full(len(mine), where[i]), where[mine], 0)
                if lo:
                    yield _met(3, np.full(len(lo), where[i]), lo, hi)
                    yield _met(4, [where[i]], 0, [close])

    routes = materialize(spark.range(len(blocks)).mapInArrow(partners, MET), "routes")
    # A block meets itself and, of each pair, one is at home; a task has its home block and some visitors.
    pair = routes.where("kind = 2").select(F.when((F.col("a") + F.col("b")) % 2 == 0, F.struct(F.col("a").alias("h"), F.col("b").alias("v"))).otherwise(F.struct(F.col("b").alias("h"), F.col("a").alias("v"))).alias("p")).select("p.*")
    task = pair.withColumn("chunk", F.floor((F.row_number().over(W.partitionBy("h").orderBy("v")) - 1) / VISITS))
    asked = task.select("h", "chunk").distinct().select(F.col("h").alias("block"), F.lit(0).alias("role"), "h", "chunk").unionByName(task.select(F.col("v").alias("block"), F.lit(1).alias("role"), "h", "chunk"))
    rows = dealt.where("kind = 0").select("block", "at", "node", "label", "weight", "vec")
    met = rows.join(asked, "block").withColumn("task", F.concat_ws("/", "h", "chunk")).select("task", "role", "block", "at", "node", "label", "weight", "vec")

    def run(batches):
        task, home, held, key, names = None, None, [], None, {}
        root = n_home = None

        def close():
            """The rows of one block of a task are complete."""
            nonlocal home, root, n_home
            if not held:
                return
            b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            here = Block(b.column("node").to_numpy(), b.column("label").to_pylist(), b.column("weight").to_numpy(), matrix(b.column("vec"), dims), basis, names)
            if key[1] == 0:
                home, root, n_home = here, np.arange(len(here.nodes)), np.zeros(len(here.nodes), np.int64)
                return
            if here.nodes[0] == home.nodes[0]:  # the block itself
                compare(home, home, threshold, eps, root, n_home, n_home)
                return
            both, n = np.concatenate([root, np.arange(len(here.nodes)) + len(root)]), np.zeros(len(here.nodes), np.int64)
            compare(home, here, threshold, eps, both, n_home, n)
            root[:] = both[: len(root)]
            tied = np.flatnonzero(n)
            yield _met(0, here.nodes[tied], 0, n[tied])
            yield _met(1, here.nodes[tied], home.nodes[_find(both, tied + len(root))], 0)

        def finish():
            if home is not None:
                tied, up = np.flatnonzero(n_home), _find(root, np.arange(len(root)))
                yield _met(0, home.nodes[tied], 0, n_home[tied])
                moved = np.flatnonzero(up != np.arange(len(up)))
                yield _met(1, home.nodes[moved], home.nodes[up[moved]], 0)

        for b in batches:
            tasks, roles, names_of = b.column("task").to_pylist(), b.column("role").to_numpy(), b.column("block").to_numpy()
            turns = [0, *[i for i in range(1, b.num_rows) if tasks[i] != tasks[i - 1] or roles[i] != roles[i - 1] or names_of[i] != names_of[i - 1]], b.num_rows]
            for x, z in zip(turns, turns[1:], strict=False):
                if x == z:
                    continue
                now = (tasks[x], int(roles[x]), int(names_of[x]))
                if now != key:
                    yield from close()
                    if now[0] != task:
                        yield from finish()
                        task, home, names = now[0], None, {}
                    held, key = [], now
                held.append(b.slice(x, z - x))
        yield from close()
        yield from finish()

    inside = met.repartition("task").sortWithinPartitions("task", "role", "block", "at").mapInArrow(run, MET)
    # Blocks that link as wholes: one edge to each interval, and each interval's blocks to its first, once.
    first = dealt.where("kind = 0").groupBy("block").agg(F.min("node").alias("rep"))
    at = spark.createDataFrame([(i, int(x)) for i, x in enumerate(blocks)], "i long, block long").join(first, "block").select("i", "block", "rep")
    whole_of = routes.where("kind = 3")
    bonus = dealt.where("kind = 0").select("block", "node", "weight").join(routes.where("kind = 4").select(F.col("a").alias("block"), "n"), "block")
    own = whole_of.join(at.select(F.col("block").alias("a"), F.col("i").alias("me")), "a").where((F.col("me") >= F.col("b")) & (F.col("me") < F.col("n"))).select(F.col("a").alias("block"), F.lit(True).alias("inside")).distinct()
    counts = bonus.join(own, "block", "left").select(F.lit(0).alias("kind"), F.col("node").alias("a"), F.lit(0).cast("long").alias("b"), (F.col("n") - F.when(F.col("inside"), F.col("weight")).otherwise(0)).alias("n"))
    ties = whole_of.select("a", F.col("b").alias("i")).join(at.select("i", "rep"), "i").join(at.select(F.col("block").alias("a"), F.col("rep").alias("mine")), "a").select(F.col("mine").alias("a"), F.col("rep").alias("b"))
    glue = whole_of.select("b", "n").distinct().select("b", F.explode(F.sequence(F.col("b"), F.col("n") - 1)).alias("i")).join(at.select("i", F.col("rep").alias("x")), "i").join(at.select(F.col("i").alias("b"), F.col("rep").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    # A block in such an interval is linked within itself only through the rows of the other blocks: all its rows go with its first.
    members = dealt.where("kind = 0").select("block", "node").join(whole_of.select(F.col("a").alias("block")).distinct(), "block").join(first, "block").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    edges = ties.unionByName(glue).unionByName(members).where("a != b").select(F.lit(1).alias("kind"), "a", "b", F.lit(0).cast("long").alias("n"))
    return inside.unionByName(counts).unionByName(edges)

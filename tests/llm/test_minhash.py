import random
import re
from collections import Counter, defaultdict

import pytest
from cases import HARD

from varloom.llm import minhash, queries

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(t):
    w = WORDS.findall((t or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    lists = defaultdict(list)
    for i, s in enumerate(sets):
        if rows[i][0] is not None:
            for x in s:
                lists[x].append(i)
    shared = Counter()
    for m in lists.values():
        for a in range(len(m)):
            for b in range(a):
                shared[m[b], m[a]] += 1
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            root[find(a)] = find(b)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return Counter((d, len(sets[i]), None if d is None else low[find(i)], d is None or d == low[find(i)]) for i, (d, _) in enumerate(rows))


def counted(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect())


def test_whole_table(spark, sf_dir, documents):
    assert counted(queries.op4_minhash(spark, sf_dir)) == brute([(d["doc_id"], d["text"]) for d in documents])


def test_hard(spark, hard, nothing):
    assert counted(minhash.near_duplicates(hard)) == brute([(i, t) for i, t, _ in HARD])
    assert minhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("block,pivots", [(512, 256), (16, 4)])
def test_groups_of_near_copies(spark, block, pivots):
    """Chains of edits around bases, a passage that many share; with small blocks also the path of large clusters."""
    rng = random.Random(block)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    rows = []
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([12, 60, 90, 150, 400]))]
        if g % 3 == 0:
            base[5:5] = passage
        for _ in range(rng.choice([2, 5, 60])):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 20)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(w)))
    for _ in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.choice([5, 20, 60]))]
        rows.append((len(rows), " ".join(w[:9] + passage + w[9:])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert counted(minhash.near_duplicates(df, block=block, pivots=pivots)) == brute(rows)


def test_components(spark):
    rng = random.Random(9)
    edges = [(bytes([a]), bytes([b])) for a, b in [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(50), 100 + rng.randrange(50)) for _ in range(30)]]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {bytes(r["node"]): bytes(r["root"]) for r in minhash.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {i: find(i) for i in nodes}
    assert minhash.components(spark.createDataFrame([], "a binary, b binary")).count() == 0


def test_law_of_retained_values():
    """Two linked sets share at least the smaller t among their retained values, whatever the values are."""
    rng = random.Random(4)
    for _ in range(400):
        n = rng.choice([1, 2, 3, 5, 9, 20, 60, 200, 500])
        x = sorted(rng.sample(range(10**6), n))
        # The worst case: all that differs comes first.
        out = rng.randrange(n // 4 + 1)
        y = sorted(x[out:] + [-i - 1 for i in range(rng.randrange(n // 4 + 1))])
        both = len(set(x) & set(y))
        if 100 * both < 75 * (len(x) + len(y) - both):
            continue
        head = [set(s[: minhash.retained(len(s))]) for s in (x, y)]
        assert len(head[0] & head[1]) >= min(minhash.least_shared(len(x)), minhash.least_shared(len(y)))


def test_without_a_bound_on_sketches(spark, sf_dir, documents):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert counted(minhash.near_duplicates(rows, k=None)) == brute([(d["doc_id"], d["text"]) for d in documents])


def test_a_large_cluster_meets_by_sizes(spark, monkeypatch):
    """Texts of many sizes chained by passages: the sets sent to tasks stay a small multiple of their number, and no link is lost."""
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(20000)]
    passages = [[rng.choice(vocabulary) for _ in range(60)] for _ in range(130)]
    rows = []
    for g in range(400):
        at = g % 100
        own = [rng.choice(vocabulary) for _ in range(4)]
        rows.append((len(rows), " ".join([w for p in passages[at : at + 1 + g // 40] for w in p] + own * (g % 3))))
    sent, by_task = [], minhash._by_task

    def counted_by_task(df, out, work):
        sent.append((work.__name__, df.count()))
        return by_task(df, out, work)

    monkeypatch.setattr(minhash, "_by_task", counted_by_task)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert counted(minhash.near_duplicates(df, block=16, pivots=4)) == brute(rows)
    last = dict(sent)["loose_against_all"]
    assert last < 10 * len(rows), last

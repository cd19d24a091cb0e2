import hashlib
import random
import tarfile
import zlib
from collections import Counter, defaultdict

import numpy as np
from cases import HARD
from pyspark.sql import functions as F

from varloom.llm import bpe, media, packing, queries, sharding
from varloom.llm._shared import workspace


def check_packing(rows, docs, tok, capacity=1024):
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    want = Counter()
    for i, t in docs:
        ids = np.array([*tok.encode_batch([t or ""])[0], 2], "<u4")
        first = len(ids) % capacity or min(len(ids), capacity)
        cuts = [0, *range(first, len(ids), capacity), len(ids)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(i, p, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    seqs = defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in seqs.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= capacity
    return len(seqs)


def test_packing(spark, sf_dir, documents):
    rows = queries.op6_packing(spark, sf_dir).collect()
    n = check_packing(rows, [(d["doc_id"], d["text"]) for d in documents], bpe.load(queries.vocabulary()))
    least = -(-sum(r["length"] for r in rows) // 1024)
    assert least <= n <= least * 1.02 + 1


def test_packing_hard(spark, hard, nothing):
    rows = packing.pack_documents(hard, queries.vocabulary()).collect()
    check_packing(rows, [(i, t) for i, t, _ in HARD], bpe.load(queries.vocabulary()))
    assert packing.pack_documents(nothing, queries.vocabulary()).count() == 0


def test_plan_against_item_wise_packing():
    rng = random.Random(5)
    for _ in range(60):
        cap = rng.choice([10, 30, 100])
        items = [rng.randint(1, cap) for _ in range(rng.randint(0, 120))]
        runs = packing.plan(Counter(items), cap)
        placed = Counter()
        for count, its in runs:
            assert sum(n * e for n, e in its) <= cap
            for n, e in its:
                placed[n] += count * e
        assert placed == Counter(items)
        large = sorted(n for n in items if 3 * n > cap)
        # Pairs of large items: no more are possible (brute force over the sorted two-pointer bound).
        i, j, pairs = 0, len(large) - 1, 0
        while i < j:
            if large[i] + large[j] <= cap:
                pairs, i = pairs + 1, i + 1
            j -= 1
        assert sum(c for c, its in runs if sum(e for n, e in its if 3 * n > cap) == 2) == pairs


def test_sequences_round_trip(spark, documents):
    df = spark.createDataFrame([(d["doc_id"], d["text"]) for d in documents[:40]], "doc_id long, text string")
    pieces = packing.pack(packing.token_pieces(df, queries.vocabulary(), with_ids=True))
    seqs = {r["sequence_id"]: r["ids"] for r in packing.sequences(pieces).collect()}
    for r in pieces.collect():
        assert seqs[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]


def check_shards(rows, n_shards):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert set(by) <= set(range(n_shards))
    for rs in by.values():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
    return [sum(r["size"] for r in by[s]) for s in range(n_shards)]


def test_sharding(spark, sf_dir, documents):
    rows = queries.op2_sharding(spark, sf_dir).collect()
    size = {d["doc_id"]: (len(d["text"].encode()) + 16, zlib.crc32(d["text"].encode())) for d in documents}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == size
    held = check_shards(rows, 40)
    assert max(held) - min(held) <= 0.01 * sum(held) / 40 + 200


def test_sharding_hard_and_versions(spark, hard, nothing):
    path = workspace(spark, "maps")
    rows = sharding.shard_documents(hard, 4, map_path=path).collect()
    assert len(rows) == len(HARD)
    check_shards(rows, 4)
    assert sharding.shard_documents(nothing, 4).count() == 0
    first = sharding.SlotMap.load(spark, path)
    weight = [(v * 7919) % 101 for v in range(sharding.SLOTS)]
    second = sharding.SlotMap.deal(weight, 4).rebalance(weight, 5)
    second.save(spark, path)
    assert sharding.SlotMap.load(spark, path) == second and sharding.SlotMap.load(spark, path, 1) == first
    loads = [sum(w for w, s in zip(weight, second.shard) if s == x) for x in range(5)]
    assert max(loads) - min(loads) <= 0.011 * sum(weight) / 5
    start = sharding.SlotMap.deal(weight, 4).shard
    assert all(b == a or b == 4 for a, b in zip(start, second.shard))  # slots move only to the new shard


def payload_of(t):
    raw = (t or "").encode()
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def test_media(spark, sf_dir, documents):
    got = {r["doc_id"]: r for r in queries.op3_media(spark, sf_dir).collect()}
    assert len(got) == len(documents)
    same = {}
    for d in documents:
        p, r = payload_of(d["text"]), got[d["doc_id"]]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(d["text"].encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        image = media.to_png(p)
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(image), hashlib.sha256(image).hexdigest(), media.feature(p))
        assert (r["width"], r["height"], r["bit_depth"]) == (64, len(p) // 64, 8)
        same.setdefault(d["text"], set()).add((r["media_sha256"], r["feature"], r["shard"], r["offset"]))
    assert all(len(v) == 1 for v in same.values())


def test_media_hard_and_tar(spark, hard, nothing):
    from pyarrow import fs

    folder = workspace(spark, "media")
    rows = media.store(hard, folder, shard_bytes=2000).collect()
    assert len(rows) == len(HARD)
    base = folder.removeprefix("file://")
    names = [f.path for f in fs.LocalFileSystem().get_file_info(fs.FileSelector(base)) if f.path.endswith(".tar")]
    assert len(names) > 1
    for r in rows:
        with tarfile.open(f"{base}/{r['shard']}") as t:
            m = t.getmember(f"{r['digest']}.png")
            assert (m.offset_data, m.size) == (r["offset"], r["length"])
            assert hashlib.sha256(media.from_png(t.extractfile(m).read())).hexdigest() == r["digest"]
    target = workspace(spark, "media")
    folder = workspace(spark, "media")
    stored = media.store(spark.createDataFrame([(i, t, None) for i, t in enumerate(["a", "b", "a", "c"] * 5)], "doc_id long, text string, ids string").repartition(4), folder)
    places = media.compact(stored, folder, target)
    assert places.count() == 3 and sum(r["payload_sha256"] == r["digest"] for r in media.read_features(places, target).collect()) == 3
    assert media.media_columns(nothing).count() == 0


def test_sharding_query_stores_its_map(spark, sf_dir, monkeypatch):
    paths = []
    monkeypatch.setattr(queries, "workspace", lambda s, name: paths.append(workspace(s, name)) or paths[-1])
    rows = queries.op2_sharding(spark, sf_dir).collect()
    stored = sharding.SlotMap.load(spark, paths[0])
    assert stored.version == 1 and all(r["shard"] == stored.shard[r["vslot"]] for r in rows)


def test_slot_map_is_stored_once_and_edited(spark, tmp_path, sf_dir):
    path = str(tmp_path / "map")
    recs = sharding.records(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    weight = sharding.slot_bytes(recs)
    first = sharding.SlotMap.deal(weight, 40)
    for _ in range(2):
        first.save(spark, path)
    assert sharding.SlotMap.load(spark, path) == first
    second = sharding.rebalance(spark, path, weight, 41)
    assert (second.version, second.n_shards, len(second.shard)) == (2, 41, sharding.SLOTS) and sharding.SlotMap.load(spark, path, 1) == first
    moved = [a for a, b in zip(first.shard, second.shard, strict=True) if a != b]
    assert 0 < len(moved) < sharding.SLOTS / 10
    load = [0] * 41
    for v, s in enumerate(second.shard):
        load[s] += weight[v]
    assert max(load) - min(load) <= 0.011 * sum(load) / 41


def test_many_rows_of_one_record(spark):
    """Repeated rows of one record do not fill one slot."""
    df = spark.range(30000).select(F.when(F.col("id") < 20000, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("the same text").alias("text"))
    rows = sharding.shard_documents(df, 8)
    n = rows.groupBy("shard").count().collect()
    assert len(n) == 8 and max(r["count"] for r in n) < 1.2 * 30000 / 8
    slots = rows.groupBy("shard").agg(F.count_distinct("slot").alias("d"), F.min("slot").alias("a"), F.max("slot").alias("z"), F.count("*").alias("n")).collect()
    assert all(r["a"] == 0 and r["z"] == r["n"] - 1 and r["d"] == r["n"] for r in slots)


def test_clashing_columns(spark, hard):
    """Columns of the input with the names of the results are replaced."""
    names = "width height bit_depth colour_type feature payload_sha256 media_sha256 tail_crc32 Digest shard offset length n_bytes n _row size vslot slot text_crc32 sequence_id piece".split()
    df = hard
    for c in names:
        df = df.withColumn(c, F.lit("mine"))
    got = media.media_columns(df).collect()
    assert len(got) == len(HARD) and all(r["n"] == r["_row"] == "mine" and r["width"] == 64 and len(r["feature"]) > 9 for r in got)
    assert {(r["doc_id"], r["media_sha256"]) for r in got} == {(r["doc_id"], r["media_sha256"]) for r in media.media_columns(hard).collect()}
    placed = sharding.shard_documents(df, 4).collect()
    assert len(placed) == len(HARD) and all(isinstance(r["slot"], int) and isinstance(r["size"], int) for r in placed)
    packed = packing.pack_documents(df, queries.vocabulary()).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(i for i, _, _ in HARD)

from collections import Counter

import corpus_pipeline
from cases import HARD
from test_minhash import brute
from test_packing_sharding_media import check_packing

from varloom.llm import bpe, queries


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "pii", "packing"]


def test_each_stage_on_its_input(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{i}")
        after = spark.read.parquet(f"{tmp_path}/{i}")
        rows = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name != "packing":
            assert after.columns == columns
        if name == "toxicity":
            bad = {r["doc_id"] for r in queries.op9_toxicity(spark, sf_dir).collect() if r["predicted"]}
            assert bad and {r["doc_id"] for r in after.collect()} == set(rows) - bad
        elif name == "near_duplicates":
            keep = {d for d, _, _, kept in brute(list(rows.items())) if kept}
            assert {r["doc_id"] for r in after.collect()} == keep
        elif name == "pii":
            assert {r["doc_id"] for r in after.collect()} == set(rows)
        else:
            check_packing(after.collect(), list(rows.items()), bpe.load(queries.vocabulary()))
        docs = after
    assert queries.pipeline(spark, sf_dir).count() == after.count()


def test_hard_rows(spark, hard, nothing, sf_dir):
    for start in (hard, nothing):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
        rows = docs.collect()
        assert bool(rows) == (start is hard)
    kept = corpus_pipeline.drop_near_duplicates(spark, hard, sf_dir).collect()
    want = Counter(d for d, _, _, k in brute([(i, t) for i, t, _ in HARD]) if k)
    assert Counter(r["doc_id"] for r in kept) == want


def test_one_id_on_several_texts(spark, sf_dir):
    """A row goes by its own text, not by what its id stands for elsewhere; repeated rows are copies."""
    a, b = "first words of a text that two rows share here", "other words that stand in one row alone"
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "x"), (2, b, "y"), (3, None, "x"), (None, a, "x"), (4, b, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _h string").repartition(3)
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in corpus_pipeline.drop_near_duplicates(spark, df, sf_dir).collect())
    assert got == sorted([("1", a), ("2", b), ("3", "None"), ("None", a)])

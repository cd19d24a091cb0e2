import hashlib
import random

import pytest
from cases import HARD

from varloom.llm import bpe, queries


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    t.no_padding()
    t.no_truncation()
    return t


def test_whole_table(spark, sf_dir, documents, tok):
    got = {r["doc_id"]: r for r in queries.op1_bpe(spark, sf_dir).collect()}
    assert len(got) == len(documents)
    for d in documents:
        ids = tok.encode(d["text"] or "", add_special_tokens=False).ids
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("doc_chars", [50, 65536])
def test_hard_rows(spark, hard, nothing, tok, doc_chars):
    out = bpe.encode(hard, queries.vocabulary(), doc_chars=doc_chars, leaf_chars=64)
    got = sorted((str(r["doc_id"]), r["text"] or "", r["ids"]) for r in out.collect())
    want = sorted((str(i), t or "", tok.encode(t or "", add_special_tokens=False).ids) for i, t, _ in HARD)
    assert got == want
    back = {(r["doc_id"], r["text"]): r["decoded"] for r in bpe.decode(out, queries.vocabulary()).collect()}
    assert all(v == (t or "") for (_, t), v in back.items())
    assert bpe.decode(bpe.encode(nothing, queries.vocabulary()), queries.vocabulary()).count() == 0


@pytest.mark.parametrize("leaf", [1, 7, 16, 100])
def test_random_unsplit_text(tok, leaf):
    rng = random.Random(3)
    b = bpe.Bpe(queries.vocabulary(), leaf)
    for alphabet in ("ab", "aeinrst", "abcé😀ü", "0123456789", "!?.,'s ", "a1! \n", " \n\t", ["'", "s", "re", " ", "x", "'ll", "7"], ["<|endoftext|>", "<|endof", "text|>", " ", "a", "!", "<"]):
        for _ in range(60):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 400)))
            want = tok.encode(t, add_special_tokens=False).ids
            leaves = b.halves(t)
            assert "".join(leaves) == t
            assert b.tree([(x, b.encode_numpy(x)) for x in leaves]).tolist() == want
            assert b.encode_numpy(t).tolist() == want


def test_very_long_matches(tok):
    """A match of many leaves: windows of tokens, not of text."""
    rng = random.Random(8)
    b = bpe.Bpe(queries.vocabulary(), 300)
    for t in ("x" * 9000, " " * 5000 + "a", "!" * 4000 + "'s", "".join(rng.choice("aeinrst") for _ in range(6000)), "7" * 3000 + "word " * 500, "é" * 3000 + "😀" * 900):
        leaves = b.halves(t)
        assert len(leaves) > 8
        assert b.tree([(x, b.encode_numpy(x)) for x in leaves]).tolist() == tok.encode(t, add_special_tokens=False).ids


def test_decodes_any_ids(tok):
    """Also ids that give no valid text."""
    rng = random.Random(5)
    b = bpe.load(queries.vocabulary())
    for _ in range(300):
        ids = [rng.choice([rng.randrange(50257), rng.randrange(256), 50256]) for _ in range(rng.randrange(12))]
        assert b.decode_text(ids) == tok.decode(ids, skip_special_tokens=False)


def test_round_trip(spark, hard, tok):
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip_digests(hard, queries.vocabulary(), doc_chars=50, leaf_chars=64).collect())
    want = []
    for i, t, _ in HARD:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_runs_of_blanks_of_any_length(tok):
    """Longer than the pattern can hold, at either end, before a word, a blank of another kind or a special token."""
    b = bpe.load(queries.vocabulary())
    for t in (" " * 1_200_000 + "a", "x" + "\n" * 200_000 + " <|endoftext|>" + " " * 100_000, "a" + "\t" * 70_001 + "b" + " " * 131_073 + "!", "　" * 90_000 + "\n9"):
        want = tok.encode(t, add_special_tokens=False).ids
        assert b.encode_numpy(t).tolist() == want
        assert b.tree([(x, b.encode_numpy(x)) for x in b.halves(t)]).tolist() == want


def test_short_runs_by_hand(tok, monkeypatch):
    rng = random.Random(6)
    b = bpe.Bpe(queries.vocabulary())
    monkeypatch.setattr(b, "BLANKS", 3, raising=False)
    import regex

    b._blanks = regex.compile(r"\s{4,}")
    for _ in range(400):
        t = "".join(rng.choice([" ", "  ", "\n", "    ", "a", "!", "'s", "\x1c", "\x85", "　", "<|endoftext|>"]) for _ in range(rng.randrange(1, 60)))
        assert b.encode_numpy(t).tolist() == tok.encode(t, add_special_tokens=False).ids

"""BPE encoding and decoding with tree concatenation of long unsplit text.

A byte-level BPE tokenizer first cuts text with a pattern and then merges
inside each cut.  A document above ``doc_chars`` is not cut with the pattern
beforehand: it is halved, and its halves halved, until they have at most
``leaf_chars`` characters.  The leaves are encoded by different tasks, each as
if it were a whole text, and concatenated in a tree.  Around each join a
window of text is encoded again, and grows (doubling) until on both sides it
ends where the encoding beside it has a cut that no neighbour can move: after
a letter or a digit that ends its run, or before white space.  From there on
both encodings agree, so the join is exact.

A very long run of white space is cut off by hand, as the pattern would cut
it: all but its last blank where something follows, else all of it.

A window that grows without meeting such a place lies in one match of the
pattern (a very long word or number, or such a run).  Its tokens are joined by merges alone:
a window of tokens grows until its first and last tokens agree with what
stands on both sides; merges are valid exactly if every neighbouring pair is.

Null text counts as empty (no ids).  An empty id list decodes to "".  Rows are
independent: repeated rows give repeated results.  Other columns pass through;
one that has the output column's name is replaced.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varloom.llm._shared import bounded_batches, materialize

#: Fixed value: the public split pattern of this tokenizer family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=1)
def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves, the others for letters from 256 on.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)]


class Bpe:
    """One tokenizer file, loaded once a Python worker."""

    #: Characters of white space up to which the pattern is left to find its matches; it keeps a state for each of them.
    BLANKS = 65_536

    def __init__(self, path: str, leaf_chars: int = 8192):
        import regex
        import tiktoken

        self.path, self.leaf_chars = path, leaf_chars
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        # The same vocabulary for a faster library.  Tests hold its ids and texts against the tokenizers library's.
        byte = {c: b for b, c in enumerate(_byte_letters())}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.ranks = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.bytes = np.zeros(max(max(ranks.values()), *self.special.values(), 0) + 1, np.int64)  # of each token
        for t, i in ranks.items():
            self.bytes[i] = len(t)
        for t, i in self.special.items():
            self.bytes[i] = len(t.encode())
        self._specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._pattern = regex.compile(PATTERN)
        # No match of the pattern, and no special token, goes across such a place.
        self._blanks = regex.compile(r"\s{%d,}" % (self.BLANKS + 1))
        self._safe = regex.compile(r"(?<=\p{L})(?=[^\p{L}])|(?<=\p{N})(?=[^\p{N}])|(?<=\S)(?=\s)")

    @functools.cached_property
    def whole(self):
        """The tokenizers library's object; loaded only where it is asked for, as memory is short."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(self.path)
        t.no_padding()
        t.no_truncation()
        return t

    def encode_numpy(self, text: str) -> np.ndarray:
        """The ids of a whole text, as the tokenizers library gives them."""
        runs = list(self._blanks.finditer(text)) if len(text) > self.BLANKS else []
        out, at = [], 0
        for run in runs:
            a, z = run.span()
            if z < len(text) and not (self._specials and self._specials.match(text, z)):
                z -= 1  # the last blank goes with what follows
            out += [self.ranks.encode_to_numpy(text[at:a], allowed_special="all"), self._blank_match(text[a:z])]
            at = z
        out.append(self.ranks.encode_to_numpy(text[at:], allowed_special="all"))
        return np.concatenate(out) if runs else out[0]

    def _blank_match(self, run: str) -> np.ndarray:
        """Ids of white space that is one match: of its parts, joined in a tree by merges alone."""
        parts = [self.ranks.encode_to_numpy(run[i : i + self.BLANKS]) for i in range(0, len(run), self.BLANKS)]
        while len(parts) > 1:
            joined = [self._join_match(x.tolist(), y.tolist()) for x, y in zip(parts[::2], parts[1::2])]
            parts = [np.asarray(x, parts[0].dtype) for x in joined] + parts[len(parts) & ~1 :]
        return parts[0]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        return [self.encode_numpy(t).tolist() for t in texts]

    def decode_text(self, ids: list[int]) -> str:
        return self.ranks.decode_bytes(ids).decode("utf-8", "replace")

    def decode_batch(self, ids: list[list[int]]) -> list[str]:
        return [self.decode_text(i) for i in ids]

    # -- long text ---------------------------------------------------------

    def halves(self, text: str) -> list[str]:
        """The leaves of a text: halved until short enough, never inside a special token."""
        inside = [m.span() for m in self._specials.finditer(text)] if self._specials else []
        starts = [a for a, _ in inside]
        out: list[str] = []

        def cut(a: int, z: int) -> None:
            mid = (a + z) // 2
            at = bisect.bisect_right(starts, mid) - 1
            if at >= 0 and mid < inside[at][1]:
                mid = inside[at][0] if inside[at][0] > a else inside[at][1]
            if z - a <= self.leaf_chars or not a < mid < z:
                out.append(text[a:z])
                return
            cut(a, mid)
            cut(mid, z)

        cut(0, len(text))
        return out

    def _fits(self, text: str, at: int) -> bool:
        """Whether a place that no match crosses is no part of a special token either."""
        if not self._specials:
            return True
        longest = max(map(len, self.special))
        return not any(m.start() < at - max(0, at - longest) < m.end() for m in self._specials.finditer(text[max(0, at - longest) : at + longest]))

    def join(self, left: tuple[str, np.ndarray], right: tuple[str, np.ndarray]) -> tuple[str, np.ndarray]:
        """(text, ids) of two neighbouring stretches, from those of each."""
        (lt, li), (rt, ri) = left, right
        text = lt + rt
        if not lt or not rt:
            return text, np.concatenate([li, ri])
        w = 64
        while True:
            begin, end = self._last_cut(text, max(0, len(lt) - w), len(lt)), self._first_cut(text, len(lt), len(lt) + w)
            begin = 0 if begin is None and w >= len(lt) else begin
            end = len(text) if end is None and w >= len(rt) else end
            if begin is not None and end is not None:
                break
            w *= 2
        a, b = self._split(li, len(lt[begin:].encode()), True), self._split(ri, len(rt[: end - len(lt)].encode()), False)
        middle = text[begin:end]
        if len(middle) > 512 and self._pattern.fullmatch(middle) and self._pattern.fullmatch(lt[begin:]) and self._pattern.fullmatch(rt[: end - len(lt)]):
            mid = np.asarray(self._join_match(li[a:].tolist(), ri[:b].tolist()), dtype=li.dtype)  # one match: merges alone
        else:
            mid = self.encode_numpy(middle)
        return text, np.concatenate([li[:a], mid, ri[b:]])

    def _last_cut(self, text: str, lo: int, hi: int) -> int | None:
        found = [m.start() for m in self._safe.finditer(text, lo, hi) if lo < m.start() < hi]
        return next((x for x in reversed(found) if self._fits(text, x)), None)

    def _first_cut(self, text: str, lo: int, hi: int) -> int | None:
        return next((m.start() for m in self._safe.finditer(text, lo, min(hi, len(text))) if lo < m.start() < min(hi, len(text)) and self._fits(text, m.start())), None)

    def _split(self, ids: np.ndarray, size: int, tail: bool) -> int:
        """Where the tokens of the last (or first) `size` bytes begin (end)."""
        so_far = np.cumsum(self.bytes[ids])
        want = (int(so_far[-1]) if len(so_far) else 0) - size if tail else size
        at = int(np.searchsorted(so_far, want, "left")) + 1 if want else 0
        if want and so_far[at - 1] != want:
            raise AssertionError("a token goes across a cut")
        return at

    def _merge(self, piece: bytes) -> list[int]:
        """Merges alone: the piece is not split by the pattern."""
        return self.ranks._encode_single_piece(piece)

    def _join_match(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of two neighbouring stretches of one match, from the ids of each."""
        w = 8
        while True:
            a, b = left[-w:], right[:w]
            mid = self._merge(self.ranks.decode_bytes(a + b))
            fits_left = w >= len(left) or mid[:2] == a[:2]
            fits_right = w >= len(right) or mid[-2:] == b[-2:]
            if fits_left and fits_right:
                return left[: len(left) - len(a)] + mid + right[len(b) :]
            w *= 2

    def tree(self, parts: list[tuple[str, np.ndarray]]) -> np.ndarray:
        """The ids of the text whose neighbouring stretches these are."""
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0][1] if parts else np.empty(0, np.uint32)


@functools.lru_cache(maxsize=2)
def load(path: str, leaf_chars: int = 8192) -> Bpe:
    return Bpe(path, leaf_chars)


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Work on few rows at a time, so that ids of a batch stay small in memory."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def _ids(lists: list) -> pa.Array:
    sizes = np.fromiter(map(len, lists), dtype=np.int32, count=len(lists))
    flat = np.concatenate([np.asarray(x, dtype=np.int32) for x in lists]) if lists else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat, type=pa.int32()))


def _lists(column: pa.ListArray) -> list[list[int]]:
    """Lists of ids without a Python object for each value on the way; null gives no ids."""
    flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    here = column.is_valid().to_numpy(zero_copy_only=False)
    return [flat[a:b].tolist() if ok else [] for a, b, ok in zip(at[:-1], at[1:], here, strict=True)]


def _schema(df: DataFrame, *more: T.StructField) -> T.StructType:
    names = {f.name.lower() for f in more}
    return T.StructType([f for f in df.schema.fields if f.name.lower() not in names] + list(more))


def _each_text(df: DataFrame, vocabulary: str, text: str, keep: list[str], added: list[tuple[T.StructField, pa.DataType]], work, *, doc_chars: int, leaf_chars: int) -> DataFrame:
    """`work(bpe, ids)` of every text's ids as the added columns, beside the kept ones.

    Texts of up to `doc_chars` characters are encoded where they lie, without
    a shuffle.  Longer ones are dealt out by leaf; only they move.
    """
    bounded_batches(df.sparkSession)
    schema = T.StructType([*(df.schema[c] for c in keep), *(f for f, _ in added)])
    size = F.coalesce(F.length(F.col(f"`{text}`")), F.lit(0))

    def columns(bpe, all_ids):
        got = list(zip(*(work(bpe, ids) for ids in all_ids), strict=True)) or [()] * len(added)
        return [_ids(list(g)) if pa.types.is_list(t) else pa.array(g, t) for g, (_, t) in zip(got, added, strict=True)]

    def short(batches):
        bpe = load(vocabulary, leaf_chars)
        for b in small_batches(batches):
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + columns(bpe, [bpe.encode_numpy(x or "") for x in b.column(text).to_pylist()]), names=schema.names)

    near = df.where(size <= doc_chars).mapInArrow(short, schema)

    # Long documents, written once so that their keys stay: one row a leaf, dealt by leaf, then brought together again.
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("_"))
    tagged = materialize(df.where(size > doc_chars).select(row.alias("_row"), F.col(f"`{text}`").alias("_text"), F.monotonically_increasing_id().alias("_key")), "long-texts")
    cut_schema = T.StructType([T.StructField("_key", T.LongType()), T.StructField("_row", tagged.schema["_row"].dataType), T.StructField("_at", T.IntegerType()), T.StructField("_leaf", T.StringType())])

    def cut(batches):
        bpe = load(vocabulary, leaf_chars)
        for b in small_batches(batches, 8):
            rows = b.column("_row")
            for i, (key, t) in enumerate(zip(b.column("_key").to_pylist(), b.column("_text").to_pylist(), strict=True)):
                leaves = bpe.halves(t)
                first = pa.array([i] + [None] * (len(leaves) - 1), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(leaves), pa.int64()), rows.take(first), pa.array(range(len(leaves)), pa.int32()), pa.array(leaves, pa.string())], names=cut_schema.names)

    part_schema = T.StructType([*cut_schema.fields, T.StructField("_ids", T.ArrayType(T.IntegerType()))])

    def each(batches):
        bpe = load(vocabulary, leaf_chars)
        for b in small_batches(batches, 64):
            yield pa.RecordBatch.from_arrays([*b.columns, _ids([bpe.encode_numpy(x) for x in b.column("_leaf").to_pylist()])], names=part_schema.names)

    parts = tagged.mapInArrow(cut, cut_schema).repartition("_key", "_at").mapInArrow(each, part_schema)
    grouped = parts.groupBy("_key").agg(F.first("_row", ignorenulls=True).alias("_row"), F.array_sort(F.collect_list(F.struct("_at", "_leaf", "_ids"))).alias("_parts"))
    whole = grouped.select(*[F.col(f"_row.`{c}`") for c in keep], F.col("_parts._leaf").alias("_leaves"), F.col("_parts._ids").alias("_ids"))

    def together(batches):
        bpe = load(vocabulary, leaf_chars)
        for b in small_batches(batches, 4):
            leaves, ids = b.column("_leaves").to_pylist(), b.column("_ids").to_pylist()
            got = [bpe.tree([(t, np.asarray(i, np.uint32)) for t, i in zip(x, y, strict=True)]) for x, y in zip(leaves, ids, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + columns(bpe, got), names=schema.names)

    return near.unionByName(whole.mapInArrow(together, schema))


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", *, doc_chars: int = 32768, leaf_chars: int = 8192) -> DataFrame:
    """Add `ids` (array<int>) of the whole `text` (null: empty)."""
    keep = [c for c in df.columns if c.lower() != ids.lower()]
    field = T.StructField(ids, T.ArrayType(T.IntegerType()), True)
    return _each_text(df, vocabulary, text, keep, [(field, pa.list_(pa.int32()))], lambda bpe, got: (got,), doc_chars=doc_chars, leaf_chars=leaf_chars)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add `text`, decoded from `ids` (null: empty), special tokens shown."""
    bounded_batches(df.sparkSession)
    schema = _schema(df, T.StructField(text, T.StringType(), True))
    keep = [f.name for f in schema.fields[:-1]]

    def run(batches):
        bpe = load(vocabulary)
        for b in small_batches(batches):
            got = bpe.decode_batch(_lists(b.column(ids)))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(got, pa.string())], names=[*keep, text])

    return df.mapInArrow(run, schema)


DIGESTS = [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string())]


def round_trip_digests(df: DataFrame, vocabulary: str, text: str = "text", *, doc_chars: int = 32768, leaf_chars: int = 8192) -> DataFrame:
    """Encode each whole `text`, decode its ids, and keep in place of the text n_tokens, ids_sha256 and decoded_sha256.

    One pass: ids and decoded texts stay in the task that makes them.
    """
    names = {n for n, *_ in DIGESTS}
    keep = [c for c in df.columns if c != text and c.lower() not in names]

    def work(bpe, got):
        ids = got.tolist()
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(bpe.decode_text(ids).encode()).hexdigest()

    return _each_text(df, vocabulary, text, keep, [(T.StructField(n, t), a) for n, t, a in DIGESTS], work, doc_chars=doc_chars, leaf_chars=leaf_chars)

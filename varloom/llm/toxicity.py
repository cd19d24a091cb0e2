"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Training takes at most ``most_examples`` labelled documents of each class
(those with the smallest hashes of their id; never a row with
crc32(doc_id as text) mod 5 = 0).  Every example is indexed under the TF-IDF
vector of all its words, so a copy of an example always finds it.  Terms that
speak for the toxic label (words and word beginnings in at least ``min_docs``
toxic documents, ``min_lift`` times as frequent as among clean ones, with a
significance of ``min_z``; near copies of an example count once) only weigh
more: the other words of a text share the weight of one term.  Where a text
has a telling term, half of that weight stands for how many other words there
are, so that a long text with a chance hit lies far from a short abusive one.

`nearest_all` searches an inverted index with the largest weight of each block
of 64 similar examples: the blocks of the highest bounds first, then only those
whose bound reaches the k-th best cosine so far.  Words that most examples
share are held by block, and a block is one product for the texts of a batch
that visit it.  The k nearest are exact.  Their votes, weighted by closeness, and the training
rate of documents without telling terms as a prior give the score, corrected
for the sampling of classes.

The index is bounded by the sample and is the only thing sent to executors.
Labels, language, source and id are never inputs of a score.  Null and empty
texts, and those that share no word with any example, get the prior.  Without toxic training rows all scores are 0,
without clean ones 1, without any labels 0.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varloom.llm._shared import bounded_batches, hash_sample
from varloom.llm.bpe import small_batches

_WORD = re.compile(r"[^\W\d_]+")
BLOCK = 64
BATCH = 128  # texts searched at a time
FIRST_BLOCKS = 8  # visited first, to learn how good the k-th best is at least
REST = "*"  # stands for the number of words that are no kept term
COMMON = 16  # a term of more than one example in so many is taken as a dense row
NEAR = 0.02  # a copy counts 1 / NEAR, a cosine of 0.5 about 0.3


def terms(text: str | None) -> Counter:
    """Counts of words ("loser") and of beginnings of longer words ("loser-")."""
    words = Counter(_WORD.findall((text or "").lower()))
    out = Counter(words)
    for w, n in words.items():
        for size in (4, 5, 6):
            if len(w) > size:
                out[w[:size] + "-"] += n
    return out


class Model:
    """The kept terms and all other words with their idf, the lists of examples by term, and the prior.

    What a search needs beside the lists is made from them where it runs, so that little is sent.
    """

    def __init__(self, idf: dict[str, float], vectors: Iterable[dict[int, float]], toxic: list[int], rates: tuple[float, float], prior: float, k: int = 9, words: dict[str, float] | None = None, new_idf: float = 1.0):
        self.k, self.rates, self.prior, self.new_idf = k, rates, prior, new_idf
        self.term_id = {t: i for i, t in enumerate(idf)}
        self.idf = np.array(list(idf.values()))
        self.whole = {t for t in idf if t[-1] not in "-*"}
        self.starts = {t[:-1] for t in idf if t[-1] == "-"}
        self.heads = {t[:4] for t in self.starts}  # a beginning has at least four letters
        self.words = dict(zip(words or (), range(len(words or ()))))  # numbered after the kept terms
        self.word_idf = array("d", (words or {}).values())
        self.index(vectors, toxic)

    def index(self, vectors: Iterable[dict[int, float]], toxic: list[int]) -> None:
        """The list of term t is docs[begin[t] : begin[t + 1]]."""
        ids, weights, sizes = array("i"), array("d"), array("i")
        for v in vectors:
            ids.extend(v.keys())
            weights.extend(v.values())
            sizes.append(len(v))
        self.toxic = np.array(toxic, dtype=np.int8)
        by = np.array(ids, np.int32)
        del ids
        self.begin = np.append(0, np.cumsum(np.bincount(by, minlength=len(self.idf) + len(self.words))))
        order = np.argsort(by, kind="stable").astype(np.int32)
        del by
        self.docs = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
        self.weights = np.array(weights)[order]
        self.blocks = None
        self.memo: dict[bytes, tuple[float, list]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"words": " ".join(self.words), "blocks": None, "memo": {}}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.words = {w: i for i, w in enumerate(state["words"].split(" "))} if state["words"] else {}

    def _prepare(self) -> None:
        """Blocks of 64 similar examples: their weights under common terms, and the largest of these."""
        n = len(self.toxic)
        common = np.flatnonzero(np.diff(self.begin) * COMMON > max(BLOCK, n))
        self.row = np.full(len(self.begin) - 1, -1)  # of a common term among them
        self.row[common] = np.arange(len(common))
        dense = np.zeros((len(common), n))
        for r, t in enumerate(common):
            here = slice(self.begin[t], self.begin[t + 1])
            dense[r, self.docs[here]] = self.weights[here]
        self.number = similar_order(dense.T, BLOCK)  # the example at each place
        place = np.empty(n, np.int32)
        place[self.number] = np.arange(n)
        self.places = place[self.docs]
        self.n_blocks = -(-max(1, n) // BLOCK)
        placed = np.zeros((len(common), self.n_blocks * BLOCK))
        placed[:, :n] = dense[:, self.number]
        self.blocks = np.ascontiguousarray(placed.reshape(len(common), self.n_blocks, BLOCK).transpose(1, 0, 2))
        self.block_max = self.blocks.max(2).T

    def vector(self, text: str | None) -> dict[int, float]:
        """Unit TF-IDF vector by term number; words of no example count in its length only."""
        count = Counter(_WORD.findall((text or "").lower()))
        hit = count.keys() & self.whole
        begun: Counter = Counter()
        for w, c in count.items():
            if w[:4] in self.heads:
                for n in (4, 5, 6):
                    if len(w) > n and w[:n] in self.starts:
                        begun[w[:n]] += c
        rest = self.term_id[REST]
        out: dict[int, float] = {}
        share = 1.0
        if hit or begun:
            raw = {self.term_id[w]: count[w] for w in hit} | {self.term_id[b + "-"]: c for b, c in begun.items()}
            raw[rest] = count.total() - sum(count[w] for w in hit)
            out = weigh(raw, self.idf)
            share = out.get(rest, 0.0) * math.sqrt(0.5)
            if share:
                out[rest] = share
        square, others = 0.0, []
        for w, c in count.items():
            if w in hit:
                continue
            i = self.words.get(w, -1)
            x = self.word_idf[i] if i >= 0 else self.new_idf
            if c > 1:
                x *= 1 + math.log(c)
            square += x * x
            if i >= 0:
                others.append((len(self.idf) + i, x))
        if others and share:
            share /= math.sqrt(square)
            out.update((i, x * share) for i, x in others)
        return out

    def nearest(self, v: dict[int, float]) -> list[tuple[float, int]]:
        """The k examples of highest cosine, ties to the lower number."""
        return self.nearest_all([v])[0]

    def nearest_all(self, vectors: list[dict[int, float]]) -> list[list[tuple[float, int]]]:
        """The k nearest examples of each vector; exact, by block maxima.

        The lists of rare words are added up.  With what the common terms of a
        block can add at most, that bounds every cosine in it: the blocks of
        the highest bounds are visited first, then those whose bound reaches
        the k-th best cosine so far.  A block is one product for all the
        vectors that visit it.
        """
        if self.blocks is None:
            self._prepare()
        n = len(vectors)
        common = np.zeros((n, len(self.block_max)))
        sums = np.zeros((n, self.n_blocks, BLOCK))
        for i, v in enumerate(vectors):
            t, q = np.fromiter(v.keys(), np.int64, len(v)), np.fromiter(v.values(), float, len(v))
            r = self.row[t]
            common[i, r[r >= 0]] = q[r >= 0]
            t, q = t[r < 0], q[r < 0]
            size = self.begin[t + 1] - self.begin[t]
            at = np.repeat(self.begin[t] - np.cumsum(size) + size, size) + np.arange(size.sum())  # where the rare terms' lists lie
            sums[i] = np.bincount(self.places[at], np.repeat(q, size) * self.weights[at], self.n_blocks * BLOCK).reshape(-1, BLOCK)
        bound = common @ self.block_max + sums.max(2)
        visited = np.zeros((n, self.n_blocks), bool)

        def visit(now: np.ndarray) -> None:
            for b in np.flatnonzero(now.any(0)):
                who = np.flatnonzero(now[:, b])
                sums[who, b] += common[who] @ self.blocks[b]
            visited[now] = True

        first = np.argsort(-bound, axis=1, kind="stable")[:, :FIRST_BLOCKS]
        now = np.zeros_like(visited)
        np.put_along_axis(now, first, True, 1)
        visit(now & (bound > 0))
        seen = sums[np.arange(n)[:, None], first].reshape(n, -1)
        least = np.partition(seen, seen.shape[1] - self.k, 1)[:, seen.shape[1] - self.k] if seen.shape[1] >= self.k else np.zeros(n)
        visit((bound > 0) & (bound >= least[:, None] - 1e-9) & ~visited)
        out = []
        for s, here, low in zip(sums, visited, least, strict=True):
            b = np.flatnonzero(here)
            found = s[b]
            x, y = np.nonzero((found >= low - 1e-9) & (found > 0))
            best = sorted(zip((-found[x, y].round(12)).tolist(), self.number[b[x] * BLOCK + y].tolist(), strict=True))[: self.k]
            out.append([(-c, e) for c, e in best])
        return out

    def _vote(self, near: list[tuple[float, int]]) -> tuple[float, list]:
        vote, all_ = [0.0, 0.0], 0.0
        for cos, e in near:
            w = cos * cos / (1 + NEAR - min(1.0, cos * cos))
            vote[self.toxic[e]] += w / self.rates[self.toxic[e]]  # one sampled example stands for 1 / rate
            all_ += w
        scale = all_ / max(sum(vote), 1e-300)
        return (vote[1] * scale + 0.5 * self.prior) / (sum(vote) * scale + 0.5), near

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[tuple[float, int]]]]:
        """For each text the probability of the toxic label and the neighbours that speak for it."""
        keys = [hashlib.blake2b((t or "").encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
        if len(self.memo) > 1000:
            self.memo.clear()
        new = {key: t for key, t in zip(keys, texts, strict=True) if key not in self.memo}
        vectors = {key: self.vector(t) for key, t in new.items()}
        some = [key for key, v in vectors.items() if v]
        self.memo |= dict.fromkeys(new.keys() - set(some), (self.prior, []))
        for at in range(0, len(some), BATCH):
            part = some[at : at + BATCH]
            self.memo |= {key: self._vote(near) for key, near in zip(part, self.nearest_all([vectors[key] for key in part]), strict=True)}
        return [self.memo[key] for key in keys]

    def score(self, text: str | None) -> tuple[float, list[tuple[float, int]]]:
        return self.scores([text])[0]


def weigh(raw: dict[int, float], idf: np.ndarray) -> dict[int, float]:
    """Unit vector of damped counts times idf; the last number counts words that are no kept term."""
    out = {t: (1 + math.log(n)) * idf[t] for t, n in raw.items() if n > 0}
    if len(out) <= (len(idf) - 1 in out):
        return {}
    norm = math.sqrt(sum(x * x for x in out.values()))
    return {t: x / norm for t, x in sorted(out.items())} if norm else {}


def similar_order(x: np.ndarray, size: int) -> np.ndarray:
    """An order of the rows of `x` in which runs of `size` hold similar ones: halved along the direction of largest spread."""
    out: list[np.ndarray] = []
    todo = [np.arange(len(x))]
    while todo:
        g = todo.pop()
        if len(g) <= size:
            out.append(g)
            continue
        part = x[g] - x[g].mean(0)
        d = np.ones(x.shape[1])
        for _ in range(8):
            d = part.T @ (part @ d)
            d /= np.linalg.norm(d) or 1.0
        g = g[np.argsort(part @ d, kind="stable")]
        half = -(-len(g) // (2 * size)) * size  # a multiple of `size`, below the length
        todo += [g[half:], g[:half]]
    return np.concatenate(out) if out else np.empty(0, np.int64)


def copies(texts: Iterable[str | None]) -> list[bool]:
    """Which examples are near copies of an earlier one: equal in one of four bands of three minimum hashes of their words."""
    seen: set[tuple] = set()
    out = []
    factors = np.random.default_rng(11).integers(1, 1 << 62, 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for text in texts:
        words = [zlib.crc32(w.encode()) for w in set(_WORD.findall((text or "").lower()))]
        if not words:
            out.append(False)
            continue
        h = ((np.array(words, np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)) ^ factors) * factors
        low = (h >> np.uint64(8)).min(0).reshape(4, 3)
        bands = {(i, *map(int, low[i])) for i in range(4)}
        out.append(not bands.isdisjoint(seen))
        seen |= bands
    return out


def fit(examples: list[tuple[str | None, int]], totals: tuple[int, int] | None = None, *, min_docs: int = 3, min_lift: float = 8.0, min_z: float = 4.0, most_terms: int = 20000, k: int = 9, rest: float = 1.0) -> Model:
    """A model from (text, label) examples; `totals`: how many clean and toxic rows the examples stand for."""
    labels = [y for _, y in examples]
    n = (labels.count(0), labels.count(1))
    totals = totals or n
    rates = tuple(a / b if a and b else 1.0 for a, b in zip(n, totals, strict=True))
    if not n[0] or not n[1]:
        return Model({REST: rest}, [], [], rates, 1.0 if n[1] else 0.0, k)  # type: ignore[arg-type]
    # One text at a time: terms of toxic texts first, then how often clean texts hold those.
    fresh = [not c for c in copies(t for t, _ in examples)]
    single = [sum(f for f, y in zip(fresh, labels, strict=True) if y == c) for c in (0, 1)]
    df: tuple[Counter, Counter] = (Counter(), Counter())
    for (t, y), new in zip(examples, fresh, strict=True):
        if y and new:
            df[1].update(terms(t).keys())
    likely = {t for t, a in df[1].items() if a >= min_docs and a >= min_lift * single[1] * 0.5 / single[0]}
    for (t, y), new in zip(examples, fresh, strict=True):
        if not y and new:
            df[0].update(terms(t).keys() & likely)
    told: list[tuple[float, str]] = []
    for t in likely:
        a, b = df[1][t], df[0][t]
        if a < min_lift * single[1] * (b + 0.5) / single[0]:
            continue
        share = (a + b) / (single[0] + single[1])
        z = (a / single[1] - b / single[0]) / math.sqrt(share * (1 - share) * (1 / single[0] + 1 / single[1]) + 1e-12)
        if z >= min_z:
            told.append((z, t))
    kept = sorted(t for _, t in sorted(told, key=lambda x: (-x[0], x[1]))[:most_terms])
    total = single[0] + single[1]
    idf = {t: math.log((1 + total) / (1 + df[0][t] + df[1][t])) + 1 for t in kept} | {REST: rest}
    seen = Counter(w for t, _ in examples for w in set(_WORD.findall((t or "").lower())))
    new_idf = math.log(1 + len(examples)) + 1
    for w, c in seen.items():
        seen[w] = new_idf - math.log(1 + c)
    model = Model(idf, [], [], rates, 0.0, k, seen, new_idf)  # type: ignore[arg-type]
    del seen
    plain = [0.0, 0.0]

    def vectors():
        for t, y in examples:
            v = model.vector(t)
            if v.keys().isdisjoint(range(len(kept))):
                plain[y] += 1 / rates[y]
            yield v

    model.index(vectors(), labels)
    model.prior = plain[1] / (plain[0] + plain[1] + 1)
    return model


def training_rows(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", most_examples: int = 4096) -> tuple[list[tuple[str | None, int]], tuple[int, int]]:
    """The bounded sample with its texts, and how many training rows of each class there are."""
    y = F.col(f"`{label}`").cast("int")
    usable = labels.select(F.col("doc_id"), y.alias("y")).where(y.isin(0, 1) & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    got = dict(usable.groupBy("y").agg(F.count(F.lit(1))).collect())
    part = [hash_sample(usable.where(F.col("y") == c), got.get(c, 0), most_examples, "doc_id") for c in (0, 1)]
    few = part[0].unionByName(part[1]).dropDuplicates(["doc_id"])  # at most twice `most_examples` rows
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # one text an id
    found = sorted(rows.collect(), key=lambda r: (r["doc_id"], r["text"] or ""))  # as many texts as examples
    return [(r["text"], r["y"]) for r in found], (got.get(0, 0), got.get(1, 0))


def score(docs: DataFrame, model: Model, text: str = "text", *, evidence: bool = False) -> DataFrame:
    """Add `score` and, if asked for, `evidence`: the nearest examples with cosine and label."""
    bounded_batches(docs.sparkSession)
    added = {"score", "evidence"} if evidence else {"score"}
    keep = [f for f in docs.schema.fields if f.name.lower() not in added]
    names = [f.name for f in keep]
    near = T.ArrayType(T.StructType([T.StructField("cosine", T.DoubleType()), T.StructField("example", T.IntegerType()), T.StructField("toxic", T.IntegerType())]))
    schema = T.StructType([*keep, T.StructField("score", T.DoubleType()), *([T.StructField("evidence", near)] if evidence else [])])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches):
        m = shared.value
        for b in small_batches(batches):
            got = m.scores(b.column(text).to_pylist())
            cols = [pa.array([s for s, _ in got], pa.float64())]
            if evidence:
                cols.append(pa.array([[{"cosine": c, "example": e, "toxic": int(m.toxic[e])} for c, e in v] for _, v in got], pa.list_(pa.struct([("cosine", pa.float64()), ("example", pa.int32()), ("toxic", pa.int32())]))))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + cols, names=schema.names)

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, *, most_examples: int = 4096, evidence: bool = False) -> DataFrame:
    """Fit on labelled rows and score every row of `docs`; adds score and predicted."""
    out = score(docs, fit(*training_rows(docs, labels, most_examples=most_examples)), evidence=evidence)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

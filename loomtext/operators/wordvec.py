"""Word and document vectors by negative sampling, trained on every partition and averaged.

The vocabulary and its counts come from all documents. In each epoch every partition takes the
model, goes through its own documents in small batches, and gives back what it changed, by word;
the changes of a word are averaged by how often each partition met it, in Spark, and the sums come
to the driver, which holds the model alone: two matrices of vocabulary x dimension. Work and
quality grow with the corpus; the only bound is the vocabulary's (``MAX_WORDS``, the most frequent).

Kind ``word``: a word is to tell the words within ``window`` places of it from words drawn by
count^0.75; words outside the vocabulary keep their places. Kind ``document``: a document's
vector, which starts each epoch as the unit centroid of its words, is to tell its words. Negatives
are drawn once a batch and shared in it, weighted to ``negative`` a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_WORDS = 200_000
#: Places taken in one step, and negatives shared by them; rows of a matrix that travel together.
BATCH, SHARED, CHUNK = 1_024, 128, 2_048
#: Cells of the guide to the running shares of words.
GUIDE = 1 << 16


@dataclass
class Vectors:
    """vocabulary: word to row. words and context: input and output matrices; of documents' models the output is what names words."""

    kind: str
    vocabulary: dict[str, int]
    words: np.ndarray
    context: np.ndarray
    counts: np.ndarray
    window: int = 5
    negative: int = 5
    epochs: int = 5
    alpha: float = 0.05
    min_alpha: float = 1e-3
    seed: int = 42
    cdf: np.ndarray = field(init=False)
    guide: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        share = self.counts.astype(float) ** 0.75
        self.cdf = np.cumsum(share / share.sum())
        self.guide = np.searchsorted(self.cdf, np.arange(GUIDE + 1) / GUIDE)

    @property
    def matrix(self) -> np.ndarray:
        """The matrix that holds the words' vectors."""
        return self.words if self.kind == "word" else self.context

    @property
    def dim(self) -> int:
        return self.words.shape[1]

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        """Words by their share; most draws fall into a cell of the guide that has one word only, the others are searched."""
        u = rng.random(n)
        cell = (u * GUIDE).astype(np.int64)
        at = self.guide[cell]
        rest = np.flatnonzero(at != self.guide[cell + 1])
        at[rest] = np.searchsorted(self.cdf, u[rest])
        return np.minimum(at, len(self.cdf) - 1)

    def word_vector(self, word: str | None) -> np.ndarray | None:
        at = self.vocabulary.get(word)
        return None if at is None else self.matrix[at].copy()


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


def _distinct(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts ``at``, where each value begins in it, and the values."""
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], at[order][1:] != at[order][:-1]))) if len(at) else np.zeros(0, dtype=np.int64)
    return order, first, at[order][first]


def _damped(n: np.ndarray) -> np.ndarray:
    """A row met in many pairs of a batch takes fewer whole steps, as their gradients weren't taken one after another."""
    return np.sqrt(np.maximum(1.0, n / 4.0))


def _add(matrix: np.ndarray, at: np.ndarray, step: np.ndarray, pairs: np.ndarray) -> None:
    """Add the steps to the rows, damped."""
    if len(at):
        order, first, rows = _distinct(at)
        matrix[rows] += np.add.reduceat(step[order], first, axis=0) / _damped(np.add.reduceat(pairs[order], first)).astype(matrix.dtype)[:, None]


def learn_words(m: Vectors, ids: np.ndarray, doc: np.ndarray, rate: float, rng: np.random.Generator) -> None:
    """One step over places (``ids``, -1 for unknown words) of documents ``doc``."""
    known = ids >= 0
    at = np.where(known, ids, 0)
    x, u = m.words[at], m.context[at]
    gx, gu, pairs = np.zeros_like(x), np.zeros_like(u), np.zeros(len(ids), dtype=x.dtype)
    for d in range(1, min(m.window, len(ids) - 1) + 1):
        both = ((doc[:-d] == doc[d:]) & known[:-d] & known[d:]).astype(x.dtype)
        for a, b in ((slice(None, -d), slice(d, None)), (slice(d, None), slice(None, -d))):
            gap = ((1 - sigmoid(np.einsum("id,id->i", x[a], u[b]))) * both)[:, None].astype(x.dtype)
            gx[a] += gap * u[b]
            gu[b] += gap * x[a]
            pairs[a] += both
    away = m.draw(rng, SHARED)
    n = m.context[away]
    pull = sigmoid(x @ n.T).astype(x.dtype) * pairs[:, None] * x.dtype.type(m.negative / SHARED) * (away[None, :] != ids[:, None])
    gx -= pull @ n
    _add(m.words, at[known], rate * gx[known], pairs[known])
    _add(m.context, np.concatenate((at[known], away)), rate * np.concatenate((gu[known], -(pull.T @ x))), np.concatenate((pairs[known], np.full(SHARED, pairs.sum() * m.negative / SHARED))))


def learn_document(m: Vectors, ids: np.ndarray, rate: float, rng: np.random.Generator) -> None:
    """A pass over a document's known words, BATCH at a time; its vector moves along."""
    v = m.context[ids].mean(axis=0)
    v /= max(1e-9, float(np.linalg.norm(v)))
    for a in range(0, len(ids), BATCH):
        at = ids[a : a + BATCH]
        away = m.draw(rng, m.negative * len(at))
        # a word met several times has one gradient, a multiple of v: rows are read and changed once each
        keys = np.concatenate((at.astype(np.int64) * 2, away * 2 + 1))
        keys.sort()
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        times, kind = np.diff(np.append(first, len(keys))), keys[first] & 1
        rows = keys[first] >> 1
        own = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        rows, all_times, seen = rows[own], np.add.reduceat(times, own), np.add.reduceat(times * (1 - kind), own)
        u = m.context[rows]
        pull = (seen - all_times * sigmoid(u @ v)).astype(v.dtype)
        m.context[rows] = u + (rate * pull / _damped(all_times)).astype(v.dtype)[:, None] * v
        v = v + rate * (pull @ u) / np.float32(max(1.0, len(at) / 32))


def _epoch(batches: Iterator[pa.RecordBatch], m: Vectors, epoch: int) -> Iterator[pa.RecordBatch]:
    """Goes through a partition's documents; then rows (matrix, chunk, how often each word was met, change times that)."""
    m = Vectors(m.kind, m.vocabulary, m.words.copy(), m.context.copy(), m.counts, m.window, m.negative, m.epochs, m.alpha, m.min_alpha, m.seed)
    first = {"words": m.words.copy(), "context": m.context.copy()}
    rng = np.random.default_rng([m.seed, epoch, TaskContext.get().partitionId()])
    rate = np.float32(max(m.min_alpha, m.alpha * (1 - epoch / m.epochs)))
    met = np.zeros(len(m.counts))
    for batch in batches:
        lists = batch.column(0)
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        size = np.diff(lists.offsets.to_numpy())
        met += np.bincount(ids[ids >= 0], minlength=len(met))
        if m.kind == "word":
            doc = np.repeat(np.arange(len(size)), size)
            for a in range(0, len(ids), BATCH):
                learn_words(m, ids[a : a + BATCH], doc[a : a + BATCH], rate, rng)
        else:
            for part in np.split(ids, np.cumsum(size)[:-1]):
                if len(part := part[part >= 0]):
                    learn_document(m, part, rate, rng)
    met = np.maximum(met, 1e-3)  # drawn negatives change too
    for name, old in first.items():
        change = (getattr(m, name) - old) * met[:, None]
        for chunk in range(0, len(met), CHUNK):
            some = change[chunk : chunk + CHUNK]
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([chunk], pa.int64()), pa.array([met[chunk : chunk + CHUNK].astype("<f4").tobytes()], pa.binary()), pa.array([some.astype("<f4").tobytes()], pa.binary())], names=["matrix", "chunk", "met", "change"])


def _summed(group: pa.Table) -> pa.Table:
    """The average change of a chunk's words: sums over partitions."""
    add = lambda c: sum(np.frombuffer(x, "<f4").astype(float) for x in group.column(c).to_pylist())
    met, change = add("met"), add("change")
    mean = change.reshape(len(met), -1) / np.maximum(met, 1e-9)[:, None]
    return pa.table({"matrix": group.column("matrix").slice(0, 1), "chunk": group.column("chunk").slice(0, 1), "change": pa.array([mean.astype("<f4").tobytes()], pa.binary())})


def _ids(tokens: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(doc_id, ids) where there is a doc_id, else (ids); -1 for an unknown word."""
    shared = tokens.sparkSession.sparkContext.broadcast(vocabulary)
    names = [c for c in ("doc_id", "words") if c in tokens.columns]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            lists = b.column(len(names) - 1)
            coded = lists.flatten().dictionary_encode()
            numbers = np.array([known.get(w, -1) for w in coded.dictionary.to_pylist()], dtype=np.int32)
            flat = numbers[coded.indices.to_numpy()] if len(numbers) else np.zeros(0, dtype=np.int32)
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            at = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(names) - 1)], pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=[*names[:-1], "ids"])

    kinds = [f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}"] if len(names) > 1 else []
    return tokens.select(*names).mapInArrow(each, ", ".join([*kinds, "ids array<int>"]))


def vocabulary_of(tokens: DataFrame, min_count: int, max_words: int = MAX_WORDS) -> list[tuple[str, int]]:
    """(word, count) in code-point order: words of at least ``min_count`` places, the most frequent ``max_words`` of them."""
    counts = tokens.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count).persist()
    left, least = max_words, min_count  # the least count that is needed, so that partitions don't each send max_words
    for n, c in sorted(((r["n"], r["c"]) for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()), reverse=True):
        least, left = n, left - c
        if left <= 0:
            break
    found = sorted((r.w, r.n) for r in counts.where(F.col("n") >= least).orderBy(F.desc("n"), "w").limit(max_words).collect())
    counts.unpersist()
    return found


def most_common(m: Vectors, n: int) -> list[str]:
    """The n most frequent words of the model, ties in code-point order."""
    return sorted(m.vocabulary, key=lambda w: (-m.counts[m.vocabulary[w]], w))[:n]


def prepared(tokens: DataFrame, min_count: int, max_words: int = MAX_WORDS, parts: int | None = None) -> tuple[list[tuple[str, int]], DataFrame]:
    """The vocabulary of ``fit``, and the kept (doc_id, ids) of tokens (doc_id, words): four bytes a word instead of strings."""
    found = vocabulary_of(tokens, min_count, max_words)
    ids = _ids(tokens, {w: i for i, (w, _) in enumerate(found)})
    return found, ids.coalesce(parts or tokens.sparkSession.sparkContext.defaultParallelism).persist(StorageLevel.MEMORY_AND_DISK)


def whole_number(value, name: str, least: int) -> int:
    """The value if it is a whole number of at least ``least``; ValueError else."""
    if isinstance(value, bool) or not isinstance(value, (int, np.integer)) and not (isinstance(value, float) and value.is_integer()):
        raise ValueError(f"{name} must be a whole number, not {value!r}")
    if value < least:
        raise ValueError(f"{name} must be at least {least}, not {value}")
    return int(value)


def fit(tokens: DataFrame, kind: str = "word", dim: int = 100, window: int = 5, min_count: int = 1, epochs: int = 5, negative: int = 5, alpha: float = 0.05, min_alpha: float = 1e-3, seed: int = 42, max_words: int = MAX_WORDS, parts: int | None = None, ready: tuple[list[tuple[str, int]], DataFrame] | None = None) -> Vectors:
    """tokens (words: array of string), one row a document; null is none. ``parts``: partitions to train on, by default as many as there are cores. ``ready``: what ``prepared`` gave for the tokens."""
    if kind not in ("word", "document"):
        raise ValueError(f"kind must be word or document, not {kind!r}")
    dim, epochs, min_count = (whole_number(v, n, 1) for v, n in ((dim, "dim"), (epochs, "epochs"), (min_count, "min_count")))
    window, negative = whole_number(window, "window", 0), whole_number(negative, "negative", 0)
    if not alpha > 0:
        raise ValueError("alpha must be positive")
    spark = tokens.sparkSession
    found, ids = ready or prepared(tokens.select("words"), min_count, max_words, parts)
    if not found:
        raise ValueError("no word is frequent enough")
    vocabulary = {w: i for i, (w, _) in enumerate(found)}
    rng = np.random.default_rng(seed)
    draw = lambda: ((rng.random((len(found), dim)) - 0.5) / dim).astype(np.float32)
    m = Vectors(kind, vocabulary, draw(), draw(), np.array([n for _, n in found]), window, max(1, min(negative, len(found) - 1)) if len(found) > 1 else 0, epochs, alpha, min_alpha, seed)
    for epoch in range(epochs):
        shared = spark.sparkContext.broadcast(m)
        changes = ids.select("ids").mapInArrow(lambda b, shared=shared, epoch=epoch: _epoch(b, shared.value, epoch), "matrix string, chunk long, met binary, change binary")
        for r in changes.groupBy("matrix", "chunk").applyInArrow(_summed, "matrix string, chunk long, change binary").collect():  # the two matrices
            part = np.frombuffer(r.change, "<f4").reshape(-1, dim)
            getattr(m, r.matrix)[r.chunk : r.chunk + len(part)] += part
        shared.unpersist()
    if not ready:
        ids.unpersist()
    return m


def _by_document(m: Vectors, tokens: DataFrame, vector) -> DataFrame:
    """(doc_id, vec): ``vector`` of the model and the known words' rows of each of tokens (doc_id, words or ids)."""
    rows = tokens if "ids" in tokens.columns else _ids(tokens, m.vocabulary)
    shared = tokens.sparkSession.sparkContext.broadcast(m)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, lists = np.zeros((b.num_rows, shared.value.dim)), b.column(1)
            flat, at = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for i in range(b.num_rows):
                ids = flat[at[i] : at[i + 1]]
                if len(known := ids[ids >= 0]):
                    out[i] = vector(shared.value, known)
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(out)], names=["doc_id", "vec"])

    return rows.select("doc_id", "ids").mapInArrow(each, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, vec array<double>")


def mean_pooled(m: Vectors, tokens: DataFrame) -> DataFrame:
    """tokens (doc_id, words, or ids as of ``prepared``): (doc_id, vec), the mean of the known words' vectors; zeros if there are none."""
    return _by_document(m, tokens, lambda m, at: m.matrix[at].mean(axis=0, dtype=float))


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())).cast(pa.list_(pa.float64()))


def infer(m: Vectors, words: list[str], epochs: int | None = None, alpha: float | None = None) -> np.ndarray:
    """A document's vector, words frozen: from the unit centroid at a constant rate; random numbers start anew for each."""
    at = np.array([m.vocabulary[t] for t in words if t in m.vocabulary], dtype=np.int64)
    return _infer(m, at, epochs, alpha) if len(at) else np.zeros(m.dim)


def _infer(m: Vectors, at: np.ndarray, epochs: int | None = None, alpha: float | None = None) -> np.ndarray:
    u = m.matrix[at].astype(float)
    v = u.mean(axis=0)
    v /= max(1e-12, float(np.linalg.norm(v)))
    rng = np.random.default_rng(m.seed)
    for _ in range(m.epochs if epochs is None else epochs):
        away = m.draw(rng, SHARED)
        n = m.matrix[away].astype(float)
        down = sigmoid(n @ v) * (m.negative * len(at) / SHARED)
        v = v + (m.alpha if alpha is None else alpha) * ((1 - sigmoid(u @ v)) @ u - down @ n) / max(1.0, len(at) / 32)  # a long text doesn't take longer steps
    return v


def inferred(m: Vectors, tokens: DataFrame, epochs: int | None = None, alpha: float | None = None) -> DataFrame:
    """tokens (doc_id, words, or ids as of ``prepared``): (doc_id, vec), inferred in parallel."""
    return _by_document(m, tokens, lambda m, at: _infer(m, at, epochs, alpha))


def most_similar(m: Vectors, word: str | None, top_n: int = 10) -> list[tuple[str, float]]:
    """The words of highest cosine, the word itself left out; ties in code-point order. [] for an unknown word."""
    at = m.vocabulary.get(word)
    return [] if at is None or top_n <= 0 else _nearest(m, m.matrix[at], {at}, top_n)


def analogy(m: Vectors, a: str, b: str, c: str, top_n: int = 3) -> list[tuple[str, float]]:
    """The words nearest to a - b + c, these three left out; [] if one is unknown."""
    at = [m.vocabulary.get(w) for w in (a, b, c)]
    if None in at:
        return []
    return _nearest(m, m.matrix[at[0]] - m.matrix[at[1]] + m.matrix[at[2]], set(at), top_n)


def _nearest(m: Vectors, v: np.ndarray, without: set[int], top_n: int) -> list[tuple[str, float]]:
    size = np.linalg.norm(m.matrix, axis=1) * np.linalg.norm(v)
    score = np.where(size > 1e-12, m.matrix @ v / np.maximum(size, 1e-12), 0.0)
    score[list(without)] = -np.inf
    names = list(m.vocabulary)
    order = np.argsort(-score, kind="stable")[:top_n]
    return [(names[i], float(score[i])) for i in order if np.isfinite(score[i])]


def to_table(m: Vectors, spark) -> DataFrame:
    """(idx, term, count, word_vec, context_vec)."""
    rows = [(i, w, int(m.counts[i]), m.words[i].tolist(), m.context[i].tolist()) for w, i in m.vocabulary.items()]
    return spark.createDataFrame(rows, "idx long, term string, count long, word_vec array<float>, context_vec array<float>")


def from_table(rows: DataFrame, **params) -> Vectors:
    got = rows.orderBy("idx").toArrow()
    matrix = lambda c: np.array(got.column(c).to_pylist(), dtype=np.float32).reshape(got.num_rows, -1)
    return Vectors(vocabulary={w: i for i, w in enumerate(got.column("term").to_pylist())}, words=matrix("word_vec"), context=matrix("context_vec"), counts=np.array(got.column("count").to_pylist()), **params)

"""Sequence packing: length patterns fitted to the histogram by non-negative least squares.

Documents are tokenised once and cut into pieces of at most ``CAPACITY`` tokens; only the pieces'
numbers are kept. The histogram of lengths has at most ``CAPACITY`` rows, so the plan is made on
the driver whatever the corpus: patterns of up to three pieces that fill a sequence exactly are
enumerated, their repeat counts fitted to the histogram by non-negative least squares (accelerated
projected gradient) and rounded so that their total stays. What the rounded patterns leave is
fitted again; the last residual, about a hundredth of the pieces, is packed best-fit over counts.
Each piece then finds its sequence from its length and its rank among pieces of that length: ranks
come from per-partition counters and prefix sums, not from a sort or a single task.

Defined cases: a null or empty text is a document of the closing id alone. A text of any length is
tokenised whole. Rows with equal ids or texts are packed one by one; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.llm.common import durable, frugal, table

CAPACITY, CLOSING = 2048, 0
#: Gradient steps of a fit; the most fits of what is left; the share of the pieces that a fit must place for another.
ROUNDS, PASSES, LEAST_SHARE = 60, 12, 0.005


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str | None = None):
    """Byte-level BPE over the ranks file; the same ids as the JSON form of the vocabulary."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class ChunkEncoder:
    """Ids of a text as an array; each text goes to the vocabulary's code in one call, which splits it itself.

    Putting ids together from cached chunks took twice the CPU time.
    """

    def __init__(self, vocabulary: str | None = None):
        self.encode = encoder(vocabulary).encode_ordinary

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.encode(text), dtype="<u4")


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; the first takes the remainder."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    starts = ([0] if first else []) + list(range(first, n, capacity))
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n])]


@frugal
def _pieces(batches: Iterator[pa.RecordBatch], capacity: int, vocabulary: str | None) -> Iterator[pa.RecordBatch]:
    ids_of = ChunkEncoder(vocabulary).ids
    pid = TaskContext.get().partitionId()
    seen = np.zeros(capacity + 1, dtype=np.int64)
    closing = np.array([CLOSING], dtype="<u4")
    for batch in batches:
        rows = []
        docs = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = np.concatenate((ids_of(text.as_py() or ""), closing))
            for k, (start, length) in enumerate(cut(len(ids), capacity)):
                docs.append(doc)
                rows.append((k, start, length, zlib.crc32(ids[start : start + length].tobytes()), pid, seen[length]))
                seen[length] += 1
        cols = list(zip(*rows)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(docs, batch.column(0).type), pa.array(cols[0], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=["doc_id", "piece", "start", "length", "ids_crc32", "pid", "local"])


def cut_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """One row per piece, with its partition and its rank there among pieces of its length."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, pid long, local long"
    return docs.select("doc_id", "text").mapInArrow(lambda b: _pieces(b, capacity, vocabulary), schema)


def patterns_of(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of three lengths (0: none), each filling the capacity exactly, from the lengths given."""
    there = np.zeros(capacity + 1, dtype=bool)
    there[lengths[lengths < capacity]] = True
    found = []
    have = np.flatnonzero(there)
    two = have[(have <= capacity - have) & there[capacity - have]]
    found.append(np.stack([two, capacity - two, np.zeros_like(two)], axis=1))
    for a in have[3 * have <= capacity]:
        b = have[(have >= a) & (2 * have <= capacity - a)]
        b = b[there[capacity - a - b]]
        found.append(np.stack([np.full_like(b, a), b, capacity - a - b], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 with least ||A x - histogram||, A counting lengths in patterns (accelerated projected gradient)."""
    if not len(patterns):
        return np.zeros(0)
    columns = [patterns[:, i].copy() for i in range(patterns.shape[1])]

    def apply(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(c, weights=x, minlength=len(histogram)) for c in columns)
        out[0] = 0.0  # length 0 stands for no piece
        return out

    def back(r: np.ndarray) -> np.ndarray:
        r = np.concatenate(([0.0], r[1:]))
        return sum(r[c] for c in columns)

    v = np.ones(len(patterns))
    for _ in range(15):  # largest eigenvalue of A'A
        v = back(apply(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - back(apply(y) - histogram) / (1.05 * top))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def round_counts(patterns: np.ndarray, fitted: np.ndarray, left: np.ndarray, rng: np.random.Generator) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, count) after systematic rounding of the fitted counts; ``left`` loses what they hold.

    The fractions are laid end to end in random order and each whole number that their sum passes
    is a repeat more, so that the rounded counts keep the fitted total, and the histogram on
    average. Patterns of high fitted counts then take their pieces first, up to what is there.
    """
    order = rng.permutation(len(fitted))
    counts = np.floor(fitted).astype(np.int64)
    passed = np.floor(np.cumsum((fitted - counts)[order]) + rng.random()).astype(np.int64)
    counts[order] += np.diff(passed, prepend=0)
    some = np.flatnonzero(counts)
    out = []
    for i in some[np.argsort(-fitted[some], kind="stable")]:
        parts = tuple(int(p) for p in patterns[i] if p)
        need = Counter(parts)
        n = min(int(counts[i]), *(int(left[p]) // k for p, k in need.items()))
        if n > 0:
            out.append((parts, n))
            for p, k in need.items():
                left[p] -= n * k
    return out


def best_fit(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, count) of best-fit decreasing, over counts of equal bins instead of single ones."""
    bins: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]
    for length in range(len(histogram) - 1, 0, -1):
        todo = int(histogram[length])
        room = length
        while todo and room <= capacity:
            while todo and bins[room]:
                pattern, count = bins[room].popitem()
                n = min(count, todo)
                if count > n:
                    bins[room][pattern] = count - n
                grown = (*pattern, length)
                target = bins[room - length]
                target[grown] = target.get(grown, 0) + n
                todo -= n
                if room - length >= length and room - length < room:
                    room = room - length - 1  # those just filled are now the tightest that fit
                    break
            room += 1
        each = capacity // length
        while todo:
            k = min(each, todo)
            n = todo // k
            pattern = (length,) * k
            room_left = capacity - k * length
            bins[room_left][pattern] = bins[room_left].get(pattern, 0) + n
            todo -= n * k
    return [(p, n) for group in bins for p, n in sorted(group.items())]


def fit_patterns(histogram: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """(pattern, count) of exact patterns, and the histogram of what they leave.

    Patterns are fitted and rounded, then fitted anew to what is left, until a pass places at most
    ``LEAST_SHARE`` of the pieces. Should stopping after fewer passes need fewer sequences in all,
    those passes are taken.
    """
    left = histogram.astype(np.int64).copy()
    total, lower = int(left.sum()), -(-int((left * np.arange(len(left))).sum()) // capacity)
    rng = np.random.default_rng(5)
    steps: list[tuple[tuple[int, ...], int]] = []
    choices = [(0, left.copy())]
    for _ in range(PASSES):
        patterns = patterns_of(np.flatnonzero(left), capacity)
        before = int(left.sum())
        steps += round_counts(patterns, fit_counts(patterns, left.astype(float)), left, rng)
        choices.append((len(steps), left.copy()))
        if before - int(left.sum()) <= LEAST_SHARE * total:
            break
    best: tuple[int, int, np.ndarray] | None = None
    for taken, rest in choices[::-1]:
        needed = sum(n for _, n in steps[:taken]) + sum(n for _, n in best_fit(rest, capacity))
        if best is None or needed < best[0]:
            best = needed, taken, rest
        if needed == lower:
            break
    return steps[: best[1]], best[2]


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, count) that together hold every piece of the histogram once: full pieces, fitted patterns, best-fit residual."""
    left = histogram.astype(np.int64).copy()
    full = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    steps, rest = fit_patterns(left, capacity)
    return full + steps + best_fit(rest, capacity)


def intervals(steps: list[tuple[tuple[int, ...], int]], capacity: int = CAPACITY) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, offset), by rank. As many rows as the plan has parts."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    used = np.zeros(capacity + 1, dtype=np.int64)
    sequence = 0
    for pattern, count in steps:
        offset = 0
        for length in pattern:
            rows.setdefault(length, []).append((int(used[length]), sequence, offset))
            used[length] += count
            offset += length
        sequence += count
    return {k: np.array(v, dtype=np.int64) for k, v in rows.items()}


@frugal
def _place(batches: Iterator[pa.RecordBatch], places: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length = batch.column("length").to_numpy(zero_copy_only=False)
        rank = batch.column("rank").to_numpy(zero_copy_only=False)
        sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            rows = places[int(n)]
            i = np.searchsorted(rows[:, 0], rank[at], side="right") - 1
            sequence[at] = rows[i, 1] + rank[at] - rows[i, 0]
            offset[at] = rows[i, 2]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset."""
    pieces = durable(cut_documents(docs, capacity, vocabulary))
    counts = pieces.groupBy("length", "pid").count()
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("count")).collect():  # at most ``capacity`` rows
        histogram[length] = n
    places = docs.sparkSession.sparkContext.broadcast(intervals(plan(histogram, capacity), capacity))
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "pid", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("earlier"))
    ranked = pieces.join(offsets, ["length", "pid"]).withColumn("rank", F.col("earlier") + F.col("local"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(lambda b: _place(b, places.value), schema)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))

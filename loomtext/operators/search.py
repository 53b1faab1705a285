"""Ranked search by cosine.

A block of queries is compared with some thousand rows of the corpus in one matrix product; what
reaches the least of the best so far is kept, without sorting the rest. The best of each task go on
to the final ranking: rows shuffled are top_n per query and task, whatever the corpus. Rank order is score descending, id ascending; degenerate vectors score 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.vectors import TINY

#: The most query vectors in one matrix product.
BLOCK = 1_000
#: Blocks that go through one pass over the corpus; rows of the corpus that a block meets at once.
BLOCKS, ROWS = 32, 4_096


def top_n_of(value, default: int = 10) -> int:
    """None is the default, junk and negatives 0."""
    if value is None:
        return default
    try:
        return max(0, int(value)) if not isinstance(value, bool) else 0
    except (TypeError, ValueError):
        return 0


def _scaled(x: np.ndarray) -> np.ndarray:
    x = np.where(np.isfinite(x).all(axis=1, keepdims=True), x, 0.0)
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.where(size > TINY, x / np.maximum(size, TINY), 0.0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if not column.null_count and len(column) and (np.diff(column.offsets.to_numpy()) == dim).all() and not (flat := column.flatten()).null_count:
        return flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    out = np.zeros((len(column), dim))
    for i, v in enumerate(column.to_pylist()):
        if v is not None and len(v) == dim:
            out[i] = [np.nan if x is None else x for x in v]
    return out


def _first(ids: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the n first by score to twelve decimals, highest first, then by id; in no order if there are more than n."""
    if len(ids) <= n:
        return np.arange(len(ids))
    r = np.round(scores, 12)
    least = np.partition(r, len(r) - n)[len(r) - n]
    above, level = np.flatnonzero(r > least), np.flatnonzero(r == least)
    need = n - len(above)
    return np.concatenate((above, level[np.argpartition(ids[level], need - 1)[:need]] if need < len(level) else level))


class _Best:
    """The n best of one block of queries over the batches of a task."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, n: int, exclude_self: bool):
        self.queries, self.q, self.n, self.exclude_self = ids, q, n, exclude_self
        self.found = [(np.zeros(0, dtype=np.int64), np.zeros(0))] * len(ids)
        self.least = np.full(len(ids), -np.inf)  # what a score must reach

    def meet(self, own: np.ndarray, x: np.ndarray) -> None:
        scores = self.q @ x.T
        if self.exclude_self:
            order = np.argsort(own, kind="stable")
            a, b = (np.searchsorted(own[order], self.queries, side=side) for side in ("left", "right"))
            for i in np.flatnonzero(b > a):
                scores[i, order[a[i] : b[i]]] = -np.inf
        if len(own) > self.n and np.isneginf(self.least).any():
            self.least = np.maximum(self.least, np.partition(scores, len(own) - self.n, axis=1)[:, len(own) - self.n])
        row, place = np.nonzero(scores >= self.least[:, None] - 2e-12)  # ties by twelve decimals stay
        value = scores[row, place]
        fine = np.isfinite(value)
        row, place, value = row[fine], place[fine], value[fine]
        ends = np.searchsorted(row, np.arange(len(self.queries) + 1))
        for i in np.flatnonzero(ends[1:] > ends[:-1]):
            some = slice(ends[i], ends[i + 1])
            ids, s = np.concatenate((self.found[i][0], own[place[some]])), np.concatenate((self.found[i][1], value[some]))
            at = _first(ids, s, self.n)
            self.found[i] = (ids[at], s[at])
            if len(at) == self.n:
                self.least[i] = max(self.least[i], s[at].min())

    def rows(self) -> pa.RecordBatch:
        ids, s = (np.concatenate([f[c] for f in self.found]) if self.found else np.zeros(0, kind) for c, kind in ((0, np.int64), (1, float)))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.queries, [len(f[0]) for f in self.found])), pa.array(ids.astype(np.int64)), pa.array(s)], names=["query_id", "id", "score"])


def search(queries: DataFrame, corpus: DataFrame, top_n=None, exclude_self: bool = False, block: int = BLOCK) -> DataFrame:
    """queries (query_id, vec), corpus (id, vec): (query_id, rank, id, score)."""
    n = top_n_of(top_n)
    numbered = queries.select("query_id", F.col("vec").cast("array<double>").alias("vec")).persist()
    n_blocks = max(1, -(-numbered.count() // block))
    numbered = numbered.withColumn("b", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)))
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    found = None
    for first in range(0, n_blocks, BLOCKS):  # one pass over the corpus for so many blocks
        blocks: dict[int, tuple[list, list]] = {}
        for r in numbered.where(F.col("b").between(first, first + BLOCKS - 1)).collect():
            blocks.setdefault(r["b"], ([], []))[0].append(r["query_id"])
            blocks[r["b"]][1].append(r["vec"])
        dim = max((len(v) for _, vecs in blocks.values() for v in vecs if v), default=0)
        scaled = [(np.array(ids, dtype=np.int64), _scaled(np.array([v if v and len(v) == dim else [0.0] * dim for v in vecs], dtype=float).reshape(len(ids), dim))) for ids, vecs in blocks.values()]
        shared = corpus.sparkSession.sparkContext.broadcast(scaled)

        def best(batches: Iterator[pa.RecordBatch], shared=shared, dim=dim) -> Iterator[pa.RecordBatch]:
            all_blocks = [_Best(ids, q, n, exclude_self) for ids, q in shared.value]
            for batch in batches:
                for a in range(0, batch.num_rows, ROWS):
                    some = batch.slice(a, ROWS)
                    own = some.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                    x = _scaled(_matrix(some.column(1), dim))
                    for b in all_blocks if n else ():
                        b.meet(own, x)
            yield from (b.rows() for b in all_blocks)

        part = corpus.select(F.col("id").cast("long"), F.col("vec").cast("array<double>")).coalesce(cores).mapInArrow(best, "query_id long, id long, score double")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= n).select("query_id", "rank", "id", "score")


def twin(docs: DataFrame, text: str) -> DataFrame:
    """The first document whose text equals ``text``, exactly or up to white space."""
    from loomtext.functions.text import squeeze

    flat = " ".join(text.split())
    return docs.where((F.trim("text") == text.strip()) | (squeeze(F.col("text")) == flat)).agg(F.min("doc_id").alias("doc_id"))

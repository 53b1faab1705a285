"""Line deduplication: drop lines whose key is found in many documents.

Lines are split at \\n; a line's key is the line stripped of [\\x20\\x09-\\x0D] at both ends, A-Z
lower-cased. Each document gives each of its distinct keys once, so one groupBy with map-side
sums counts documents per key, however common a key is. The keys at or over the threshold are
broadcast while they are few (their number is checked); beyond that the lines are joined with them
by key hash and the kept ones put together again by position.

Keys are compared by a 128-bit hash, as a pair of numbers. Every row counts as a document. Defined
cases: a null or empty text is one empty line; empty keys are never dropped; a document that loses
all its lines has the empty text. Extra columns, nulls in them included, are carried through
``dedup_lines`` untouched, but that columns named n_lines and n_dropped are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm.common import durable, frugal, table

#: A line goes if at least so many documents have its key, of at least so many code points.
MIN_DOCS, MIN_CHARS = 10, 1
#: The most common keys that are broadcast (16 bytes each); more are joined.
BROADCAST_KEYS = 500_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def line_keys(raw: bytes) -> list[bytes]:
    """The key of each line. bytes.strip() takes away exactly [\\x20\\x09-\\x0D]."""
    return [line.strip() for line in raw.translate(_LOWER).split(b"\n")]


def _chars(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode("utf-8", "replace"))


def _hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _pairs(hashes: list[bytes]) -> list[pa.Array]:
    """The hashes as two columns of numbers."""
    both = np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2)
    return [pa.array(np.ascontiguousarray(both[:, i])) for i in range(2)]


def _raw(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


@frugal
def _distinct_keys(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: Counter = Counter()
        for raw in _raw(batch.column(0)):
            out.update(map(_hash, {k for k in line_keys(raw) if k and (min_chars <= 1 or _chars(k) >= min_chars)}))
        # copies inside a batch are summed here, before Spark's own map-side sum
        yield pa.RecordBatch.from_arrays([*_pairs(list(out)), pa.array(list(out.values()), pa.int64())], names=["k1", "k2", "n"])


def common_keys(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Hashes (k1, k2) of the keys that at least ``min_docs`` rows have."""
    keys = docs.select("text").mapInArrow(lambda b: _distinct_keys(b, min_chars), "k1 long, k2 long, n long")
    return keys.groupBy("k1", "k2").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("k1", "k2")


@frugal
def _drop(batches: Iterator[pa.RecordBatch], common: bytes, at: int, min_chars: int) -> Iterator[pa.RecordBatch]:
    """Each batch with its text column cut, and n_lines and n_dropped after the others."""
    drop = {common[i : i + 16] for i in range(0, len(common), 16)}
    for batch in batches:
        texts, totals, losses = [], [], []
        for raw in _raw(batch.column(at)):
            keys = line_keys(raw)
            kept = [line for line, k in zip(raw.split(b"\n"), keys) if not k or _hash(k) not in drop or min_chars > 1 and _chars(k) < min_chars]
            texts.append(b"\n".join(kept))
            totals.append(len(keys))
            losses.append(len(keys) - len(kept))
        cols = list(batch.columns)
        cols[at] = pc.cast(pa.array(texts, pa.binary()), pa.string())
        names = list(batch.schema.names)
        yield pa.RecordBatch.from_arrays([*cols, pa.array(totals, pa.int64()), pa.array(losses, pa.int64())], names=[*names, "n_lines", "n_dropped"])


@frugal
def _exploded(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    """Each line with its row, place and key. A line without a key has one of its own (row and place), so that such lines are dealt evenly."""
    for batch in batches:
        for row, raw in zip(batch.column(0).to_pylist(), _raw(batch.column(1))):
            lines = raw.split(b"\n")
            hashes = [_hash(k) if k and (min_chars <= 1 or _chars(k) >= min_chars) else _hash(b"\n%d %d" % (row, i)) for i, k in enumerate(line_keys(raw))]
            yield pa.RecordBatch.from_arrays([pa.array([row] * len(lines), pa.int64()), pa.array(range(len(lines)), pa.int64()), *_pairs(hashes), pc.cast(pa.array(lines, pa.binary()), pa.string())], names=["row", "pos", "k1", "k2", "line"])


def _dropped_by_join(docs: DataFrame, common: DataFrame, min_chars: int) -> DataFrame:
    """The way without a broadcast: rows numbered and written, lines joined by key, put together by position."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("doc")
    rows = durable(docs.select(whole, "text", F.monotonically_increasing_id().alias("row")))
    lines = rows.select("row", "text").mapInArrow(lambda b: _exploded(b, min_chars), "row long, pos long, k1 long, k2 long, line string")
    marked = lines.join(common.withColumn("hit", F.lit(1)), ["k1", "k2"], "left")
    kept = marked.groupBy("row").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.coalesce("hit", F.lit(0))).alias("n_dropped"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("hit").isNull(), F.struct("pos", "line")))), lambda x: x["line"]), "\n").alias("new"),
    )
    out = rows.select("doc", "row").join(kept, "row")
    return out.select(*[F.col("new").alias("text") if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns], "n_lines", "n_dropped")


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """docs with ``text`` cut (never null), and the columns n_lines and n_dropped added."""
    common = durable(common_keys(docs, min_docs, min_chars))
    base = docs.drop("n_lines", "n_dropped")
    if common.count() > broadcast_keys:
        return _dropped_by_join(base, common, min_chars)
    hashes = common.toPandas()[["k1", "k2"]].to_numpy(dtype="<i8").tobytes()  # at most ``broadcast_keys`` hashes
    shared = docs.sparkSession.sparkContext.broadcast(hashes)
    at = base.columns.index("text")
    schema = T.StructType([*base.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return base.mapInArrow(lambda b: _drop(b, shared.value, at, min_chars), schema)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
keyed AS (
  SELECT r, doc_id, lines,
         list_transform(lines, lambda l: translate(regexp_replace(regexp_replace(l, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS keys
  FROM docs),
common AS (
  SELECT k FROM (SELECT unnest(list_distinct(keys)) AS k FROM keyed) GROUP BY k
  HAVING count(*) >= {MIN_DOCS} AND length(k) >= {MIN_CHARS}),
flat AS (
  SELECT r, doc_id, unnest(lines) AS l, unnest(keys) AS k, unnest(range(len(lines))) AS pos FROM keyed),
marked AS (SELECT f.r, f.doc_id, f.l, f.pos, c.k IS NOT NULL AS hit FROM flat f LEFT JOIN common c ON f.k = c.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE hit) AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY pos) FILTER (WHERE NOT hit), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""

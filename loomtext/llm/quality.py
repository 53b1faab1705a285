"""Quality rules: rule statistics of whole texts, judged by an isolation forest.

The statistics of every document are computed in one pass and written. A forest of random splits is
grown on labelled good rows, so documents that are isolated after few splits are anomalous; the cut
on the anomaly score is calibrated on labelled rows that the forest hasn't seen (every fifth, by
crc32 of doc_id, if they hold both labels). All labelled rows count: each tree's SUBSAMPLE rows, as the
method has it, are drawn from all good ones, the ranges of splits and the cut are taken over all.
Scores are multiples of 1 / GRID, so the cut comes from counts by score, of which there are few.

Defined cases: a null or empty text has no words, all counts 0, and fails the base rule (fewer
than 10 words). Repeated rows are judged one by one and get the same verdict. With no labelled
rows, or labels of one kind only, the forest keeps every document that passes the base rules.
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import crc_fold, durable, frugal, table

TREES, SUBSAMPLE = 150, 256
#: Steps of the anomaly score between 0 and 1.
GRID = 1 << 20
#: Of labelled good rows, at most this part may fall beyond the threshold.
GOOD_LOSS = 0.01
#: Rows of each label that the cut needs to be calibrated on rows apart from the forest's.
LEAST_JUDGED = 20

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "word_length", "symbols", "dup_lines", "repeated", "variety", "upper", "digits", "marks", "line_words"]
_SPACE = [bytes([c]) for c in b" \t\n\v\f\r"]
_SYMBOLS = [bytes([c]) for c in b"#*$%&|<>"]
_UPPER, _DIGITS, _MARKS = bytes(range(65, 91)), bytes(range(48, 58)), b".,;:!?()[]{}#*$%&|<>=+-_/\\@~^\"'"


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words that stand in a window of ``size`` words found twice or more in the text, first places included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    grams = list(zip(*[words[i:] for i in range(size)]))
    if len(set(grams)) == n:
        return 0
    seen: dict[tuple, int] = {}
    marked = np.zeros(n + 1, dtype=bool)
    for i, gram in enumerate(grams):
        first = seen.setdefault(gram, i)
        if first != i:
            marked[first] = marked[i] = True
    change = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(marked[:n])
    np.add.at(change, at, 1)
    np.add.at(change, at + size, -1)
    return int((np.cumsum(change[:-1]) > 0).sum())


def rule_statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The five counts of the base rules, and the features that the forest splits on."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly space and \x09-\x0D
    chars = len(text) - sum(map(raw.count, _SPACE))
    symbols = sum(map(raw.count, _SYMBOLS))
    dup, lines, earlier = 0, 0, set()
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            if line in earlier:
                dup += 1
            else:
                earlier.add(line)
    n = len(words)
    again = repeated_words(words)
    size = max(1, len(raw))
    less = lambda kind: (len(raw) - len(raw.translate(None, kind))) / size
    features = [np.log1p(n), np.log1p(chars / max(1, n)), np.sqrt(symbols / max(1, n)), dup / max(1, lines), again / max(1, n), len(set(words)) / max(1, n) ** 0.85, less(_UPPER), np.sqrt(less(_DIGITS)), np.sqrt(less(_MARKS)), np.log1p(n / max(1, lines))]
    return [n, chars, symbols, dup, again], [float(x) for x in features]


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


class IsolationForest:
    """Random splits stored as flat arrays: feature, cut, left child, and path length at leaves."""

    def __init__(self, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 7):
        self.trees, self.subsample, self.seed = trees, subsample, seed

    @staticmethod
    def expected_path(n: float) -> float:
        """Mean path length of an unsuccessful search in a random tree of n leaves."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def fit(self, x: np.ndarray, box: tuple[np.ndarray, np.ndarray] | None = None) -> IsolationForest:
        """x: the normal rows. box: the range to split in, by default theirs.

        A split may fall where no normal row lies; the empty side is then a leaf near the root, so
        that a value never seen among normal rows (a symbol, say) is isolated at once.
        """
        rng = np.random.default_rng(self.seed)
        self.size = min(self.subsample, len(x))
        self.depth = 2 * max(1, int(np.ceil(np.log2(max(2, self.size)))))
        low, high = box or (x.min(axis=0), x.max(axis=0))
        deal = rng.permutation(len(x)) if len(x) >= self.trees * self.size else None  # enough rows for trees with none in common
        drawn = lambda i: rng.choice(len(x), self.size, replace=False) if deal is None else deal[i * self.size : (i + 1) * self.size]
        self.nodes = [self._grow(x[drawn(i)], low, high, rng) for i in range(self.trees)]
        return self

    def _grow(self, x: np.ndarray, low: np.ndarray, high: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        feature, cut, left, path = [0], [0.0], [-1], [0.0]
        work = [(0, np.arange(len(x)), 0, low, high)]
        while work:
            node, rows, depth, low, high = work.pop()
            able = np.flatnonzero(high > low)
            if depth >= self.depth or len(rows) < 2 or not len(able):
                path[node] = depth + self.expected_path(len(rows))
                continue
            f = int(rng.choice(able))
            at = float(rng.uniform(low[f], high[f]))
            goes = x[rows, f] < at
            feature[node], cut[node], left[node] = f, at, len(left)
            for part, side in ((rows[goes], 0), (rows[~goes], 1)):
                lo, hi = low.copy(), high.copy()
                (lo if side else hi)[f] = at
                work.append((len(left), part, depth + 1, lo, hi))
                feature.append(0), cut.append(0.0), left.append(-1), path.append(depth + 1.0)
        return np.array(feature), np.array(cut), np.array(left), np.array(path)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1); higher is isolated earlier."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, left, path in self.nodes:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                child = left[at]
                down = child >= 0
                at = np.where(down, child + (x[rows, feature[at]] >= cut[at]), at)
            total += path[at]
        return 2.0 ** (-total / self.trees / max(1e-9, self.expected_path(self.size)))


def calibrate(scores: np.ndarray, good: np.ndarray, good_loss: float = GOOD_LOSS) -> float:
    """The cut that rejects most labelled bad rows net of good ones while losing few good ones."""
    s, at = np.unique(scores, return_inverse=True)
    return calibrate_counts(s, np.bincount(at[good], minlength=len(s)), np.bincount(at[~good], minlength=len(s)), good_loss)


def calibrate_counts(scores: np.ndarray, good: np.ndarray, bad: np.ndarray, good_loss: float = GOOD_LOSS) -> float:
    """The cut, from the numbers of good and bad rows at each score."""
    if not good.sum() or not bad.sum():
        return float("inf")
    order = np.argsort(-scores, kind="stable")
    s, lost, won = scores[order], np.cumsum(good[order]), np.cumsum(bad[order])
    gain = np.where(lost <= good_loss * good.sum(), won / bad.sum() - 5 * lost / good.sum(), -1.0)
    best = int(np.argmax(gain))
    return float(s[best]) if gain[best] > 0 else float("inf")


@frugal
def _statistics_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [rule_statistics(x.as_py()) for x in batch.column(1)]
        counts = np.array([c for c, _ in rows], dtype=np.int64).reshape(-1, len(COUNTS))
        x = np.array([f for _, f in rows]).reshape(-1, len(FEATURES))
        failed = (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])
        out = [batch.column(0), *[pa.array(counts[:, i]) for i in range(len(COUNTS))], pa.array(failed), *[pa.array(x[:, i]) for i in range(len(FEATURES))]]
        yield pa.RecordBatch.from_arrays(out, names=["doc_id", *COUNTS, "base_failed", *FEATURES])


def _scores(batch: pa.RecordBatch, forest: IsolationForest | None) -> np.ndarray:
    x = np.stack([batch.column(f).to_numpy(zero_copy_only=False) for f in FEATURES], axis=1).astype(float)
    return np.round(forest.score(x) * GRID) / GRID if forest is not None and len(x) else np.zeros(len(x))


@frugal
def _scored(batches: Iterator[pa.RecordBatch], forest: IsolationForest) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("good"), pa.array(_scores(batch, forest))], names=["good", "anomaly"])


@frugal
def _judged(batches: Iterator[pa.RecordBatch], forest: IsolationForest | None, cut: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score, failed = _scores(batch, forest), batch.column("base_failed").to_numpy(zero_copy_only=False).astype(bool)
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", *COUNTS, "base_failed")], pa.array(~failed & (score < cut)), pa.array(score)], names=["doc_id", *COUNTS, "base_failed", "kept", "anomaly"])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, ``base_failed`` and the features of each document."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, " + ", ".join(f"{f} double" for f in FEATURES)
    return docs.select("doc_id", "text").mapInArrow(_statistics_of, schema)


def drawn_rows(rows: DataFrame, total: int, most: int) -> np.ndarray:
    """Features of ``most`` of the ``total`` rows, or of all if there are no more: a uniform, repeatable draw by a hash, whatever their partitions."""
    share = 1.0 if total <= most else min(1.0, (most + 8 * most**0.5) / total)
    place = F.xxhash64(F.lit(17), "doc_id", *FEATURES)
    got = rows.select(place.alias("place"), *FEATURES)
    got = got.where(F.col("place") <= F.lit(int((2 * share - 1) * ((1 << 63) - 1)))) if share < 1 else got
    got = got.toPandas().sort_values(["place", *FEATURES])[:most]  # some ``most`` rows come, besides copies of rows
    return got[FEATURES].sort_values(FEATURES).to_numpy()


def fit_forest(stats: DataFrame, labels: DataFrame) -> tuple[IsolationForest | None, float]:
    """Forest and threshold from all labelled rows of ``stats``."""
    named = labels.where("doc_id is not null and quality is not null").select("doc_id", (F.col("quality").cast("int") == 1).alias("good"))
    rows = durable(stats.where("not base_failed").join(named, "doc_id").select("doc_id", "good", (crc_fold() == 1).alias("judging"), *FEATURES))
    sums = [F.count(F.when(F.col("good") == g, F.when(F.col("judging") == j, 1))).alias(f"n{g:d}{j:d}") for g in (True, False) for j in (True, False)]
    seen = rows.agg(*sums, *[f(c).alias(f"{f.__name__}_{c}") for c in FEATURES for f in (F.min, F.max)]).first()
    apart = min(seen.n11, seen.n01) >= LEAST_JUDGED
    taught = seen.n10 + (0 if apart else seen.n11)
    if taught < 2:
        return None, float("inf")
    fold = F.col("judging") if apart else F.lit(True)
    x = drawn_rows(rows.where(F.col("good") & ~fold if apart else F.col("good")), taught, TREES * SUBSAMPLE)
    forest = IsolationForest().fit(x, tuple(np.array([seen[f"{f}_{c}"] for c in FEATURES]) for f in ("min", "max")))
    scored = rows.where(fold).select("good", *FEATURES).mapInArrow(lambda b: _scored(b, forest), "good boolean, anomaly double")
    at = scored.groupBy("anomaly").agg(F.count(F.when(F.col("good"), 1)).alias("g"), F.count(F.when(~F.col("good"), 1)).alias("b")).toPandas().sort_values("anomaly")  # at most GRID + 1 rows
    return forest, calibrate_counts(at["anomaly"].to_numpy(), at["g"].to_numpy(), at["b"].to_numpy())


def judge_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: the counts, ``base_failed``, ``kept`` and the anomaly score."""
    stats = durable(statistics(docs))
    forest, cut = fit_forest(stats, labels)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, anomaly double"
    return stats.mapInArrow(lambda batches: _judged(batches, forest, cut), schema)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

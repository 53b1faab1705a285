"""Toxicity: a support vector machine on a gap-weighted subsequence kernel, with Nyström landmarks.

Texts are folded (case, look-alike digits, punctuation inside words dropped, single letters set
apart by blanks put together) into words over a small alphabet. The kernel of two words counts
common subsequences of four characters within six (a word's beginning counts as a character), each
gap decayed by ``LAMBDA``; an inserted or dropped character leaves many of them in place. The
machine is linear in the Nyström features K(x, landmarks) K(landmarks, landmarks)^-1/2, so its value for a word is a weighted sum of the
word's own subsequences: scoring is one table lookup for each of them, whatever the number of
landmarks. A document's score is a logistic function of its words' values. (Machines taught whole
sentences, or sentences by windows of two words, found fewer toxic texts; see the README.)

Labels are learnt from rows whose crc32(doc_id) modulo 5 is not 0, at most ``SAMPLE_BOUND`` of
each kind, written once to the shared folder; the logistic function is fitted on a part of them
that the machine hasn't seen. Neither doc_id, lang nor source is an input.

Defined cases: a null or empty text is a document without words and gets the score of one (the
logistic function at its baseline). Repeated rows get equal scores. Where the training rows have
no label 1 (or no label 0), every score is 0 (or 1 where all are toxic). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import crc_fold, durable, frugal, labelled_sample, table

#: The most training rows of each label, the most words taken as instances of each kind, and landmarks.
SAMPLE_BOUND, WORDS_BOUND, LANDMARKS = 2_500, 5_000, 512
#: Cost of a unit of margin, for the average word.
COST = 0.3
#: Rows of each label that the document's logistic function needs to be fitted apart from the machine.
LEAST_JUDGED = 30
LAMBDA, SPAN, LONGEST = 0.6, 6, 48
#: Offsets (h, j, k) of a subsequence i < i+h < i+j < i+k, with its weight.
STEPS = [(h, j, k, LAMBDA ** (k - 3)) for k in range(3, SPAN) for j in range(2, k) for h in range(1, j)]
FEATURES = ["top", "second", "third", "over0", "over_half", "share", "log_words", "top_over0", "top_over_half", "second_over0"]


def _fold_table() -> np.ndarray:
    """Code point to character code: 0 a separator, 255 dropped, 1-31 letters (0 also stands for a word's beginning)."""
    codes = np.full(0x250, 255, dtype=np.uint8)
    codes[[9, 10, 11, 12, 13, 32, 0xA0]] = 0
    for i in range(26):
        codes[97 + i] = codes[65 + i] = 1 + i
    for a, b in zip("01345@$", "oieasas"):
        codes[ord(a)] = codes[ord(b)]
    rest = [c for c in range(0xC0, 0x250) if chr(c).isalpha() and c == ord(chr(c).lower()[0])]
    for c in rest:
        codes[c] = 27 + c % 5
    for c in range(0xC0, 0x250):
        if codes[c] == 255 and chr(c).isalpha() and ord(chr(c).lower()[0]) < 0x250:
            codes[c] = codes[ord(chr(c).lower()[0])]
    return codes


_CODES = _fold_table()
#: Squared norm of a word of n characters whose subsequences all differ.
_NORM = np.array([1.0] + [max(1e-9, sum(max(0, n + 1 - k) * w * w for _, _, k, w in STEPS)) for n in range(1, 4096)]) ** 0.5


def fold(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts, each followed by a separator, and the place where each text begins."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    # letters of other alphabets take all 31 codes, so that those of one alphabet stay apart
    codes = np.where(points < 0x250, _CODES[np.minimum(points, 0x24F)], (1 + points % 31).astype(np.uint8))
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(lengths)
    kept = codes != 255
    sep = codes == 0
    text_end = np.zeros(len(codes), dtype=bool)
    text_end[ends - 1] = True
    codes, text_end = codes[kept], text_end[kept]
    sep = codes == 0
    if len(codes) > 4:  # single letters apart: a separator between two of them goes
        alone = np.zeros(len(codes), dtype=bool)
        before = np.concatenate(([True], sep[:-1]))
        after = np.concatenate((sep[1:], [True]))
        alone = ~sep & before & after
        drop = sep & ~text_end
        drop[0] = drop[-1] = False
        drop[1:-1] &= alone[:-2] & alone[2:]
        codes, text_end = codes[~drop], text_end[~drop]
    starts = np.concatenate(([0], np.flatnonzero(text_end)[:-1] + 1)) if len(texts) else np.zeros(0, dtype=np.int64)
    return codes, starts


def words_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of each word."""
    letter = np.concatenate(([False], codes != 0, [False]))
    edge = np.flatnonzero(letter[1:] != letter[:-1])
    return edge[::2], edge[1::2] - edge[::2]


def word_values(codes: np.ndarray, begin: np.ndarray, length: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Value of each word: its subsequences' weights, over the word's norm."""
    if not len(begin):
        return np.zeros(0, dtype=np.float32)
    wide = np.concatenate(([0], codes, np.zeros(SPAN, dtype=np.uint8))).astype(np.int32)
    n = len(codes) + 1
    total = np.zeros(n, dtype=np.float32)
    solid = wide != 0
    inside = solid[1 : n + 1] & solid[2 : n + 2]
    lead = wide[:n] << 15
    for k in range(3, SPAN):
        inside = inside & solid[k : k + n]
        last = wide[k : k + n]
        part = np.zeros(n, dtype=np.float32)
        for j in range(2, k):
            end = (wide[j : j + n] << 5) + last
            for h in range(1, j):
                part += weights[lead + (wide[h : h + n] << 10) + end]
        total += np.where(inside, part * np.float32(LAMBDA ** (k - 3)), np.float32(0))
    # a word's subsequences begin at the place before it (its beginning) or inside it
    return np.add.reduceat(total, begin) / _NORM[np.minimum(length, len(_NORM) - 1)].astype(np.float32)


def document_features(texts: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    codes, starts = fold(texts)
    begin, length = words_of(codes)
    values = word_values(codes, begin, length, weights) + np.float32(bias)
    values = np.where(length >= 3, values, np.float32(-3))
    first = np.searchsorted(begin, starts)
    last = np.append(first[1:], len(begin))
    out = np.zeros((len(texts), len(FEATURES)))
    n = last - first
    out[:, 6] = np.log1p(n)
    out[:, :3] = -3.0
    full = np.flatnonzero(n)
    if len(full):
        at = first[full]
        owner = np.repeat(np.arange(len(texts)), n)
        spare = values.copy()
        for rank in range(3):  # the three highest: a maximum each, taking away one place of it
            top = np.maximum.reduceat(spare, at)
            out[full, rank] = top
            hit = np.flatnonzero(spare == np.repeat(top, n[full]))
            spare[hit[np.unique(owner[hit], return_index=True)[1]]] = -3.0
        out[full, 3] = np.log1p(np.add.reduceat((values > 0).astype(np.int64), at))
        out[full, 4] = np.log1p(np.add.reduceat((values > 0.5).astype(np.int64), at))
        out[full, 5] = np.sqrt(np.add.reduceat((values > 0).astype(np.int64), at) / n[full])
    np.clip(out[:, :3], -3, 3, out=out[:, :3])
    out[:, 7], out[:, 8], out[:, 9] = np.clip(out[:, 0], 0, 1), np.clip(out[:, 0] - 0.5, 0, 0.5), np.clip(out[:, 1], 0, 1)
    return out


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The subsequence map of the words at unit norm, as (subsequence, weight, word) sorted by word."""
    codes, starts = fold(words)
    begin, length = words_of(codes)
    owner = np.searchsorted(starts, begin, side="right") - 1
    wide = np.concatenate(([0], codes, np.zeros(SPAN, dtype=np.uint8))).astype(np.int64)
    place = np.concatenate([np.arange(b, b + n) for b, n in zip(begin, length)]) if len(begin) else np.zeros(0, dtype=np.int64)
    word, end = np.repeat(owner, length), np.repeat(begin + length, length)
    keys, weights = [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
    for h, j, k, w in STEPS:
        at = place[fits := place + k <= end]
        keys.append((word[fits] << 20) + (wide[at] << 15) + (wide[at + h] << 10) + (wide[at + j] << 5) + wide[at + k])
        weights.append(np.full(len(at), w))
    names, again = np.unique(np.concatenate(keys), return_inverse=True)
    value = np.bincount(again, weights=np.concatenate(weights), minlength=len(names))
    word = names >> 20
    norm = np.sqrt(np.bincount(word, weights=value * value, minlength=len(words)))
    return names & ((1 << 20) - 1), (value / np.maximum(norm[word], 1e-9)).astype(np.float32), word


def kernel(words: list[str], marks: list[str], chunk: int = 500) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kernel of each word with each landmark; and the landmarks' subsequences with their weights (rows)."""
    triples, weights, owner = subsequences(marks)
    names, place = np.unique(triples, return_inverse=True)
    table_ = np.zeros((len(names), len(marks)), dtype=np.float32)
    table_[place, owner] = weights
    out = np.zeros((len(words), len(marks)), dtype=np.float32)
    for a in range(0, len(words), chunk):
        t, v, o = subsequences(words[a : a + chunk])
        at = np.minimum(np.searchsorted(names, t), max(0, len(names) - 1))
        there = names[at] == t if len(names) else np.zeros(len(t), dtype=bool)
        at, v, o = at[there], v[there], o[there]
        if len(o):
            first = np.flatnonzero(np.concatenate(([True], o[1:] != o[:-1])))
            out[a + o[first]] = np.add.reduceat(table_[at] * v[:, None], first)
    return out, names, table_


def fit_machine(words: list[str], toxic: np.ndarray, clean: np.ndarray, landmarks: int = LANDMARKS, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Weights by subsequence, and bias, of the machine in Nyström space (squared hinge, Newton steps).

    A word is an example of both kinds, at the costs given: words that toxic and clean texts use
    alike end near the middle, so that only those that toxic texts prefer get high values.
    """
    lead, common = np.argsort(-(toxic - clean), kind="stable"), np.argsort(-clean, kind="stable")
    spread = np.random.default_rng(3).permutation(len(words))
    marks = [words[i] for i in dict.fromkeys([*lead[: landmarks // 2], *common[: landmarks // 4], *spread[: landmarks // 2]])][:landmarks]
    own, _, _ = kernel(marks, marks)
    values, vectors = np.linalg.eigh(own.astype(np.float64))
    keep = values > 1e-4 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    near, names, table_ = kernel(words, marks)
    z = np.hstack([near @ root.astype(np.float32), np.ones((len(words), 1), dtype=np.float32)])
    del near
    w = np.zeros(z.shape[1])
    ridge = np.ones(len(w))
    ridge[-1] = 1e-6
    for _ in range(rounds):
        f = z @ w.astype(np.float32)
        up, down = np.where(f < 1, toxic, 0.0), np.where(f > -1, clean, 0.0)
        grad = ridge * w - 2 * ((up * (1 - f) - down * (1 + f)).astype(np.float32) @ z)
        hess = np.diag(ridge) + 2 * (z * (up + down).astype(np.float32)[:, None]).T @ z
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    out = np.zeros(1 << 20, dtype=np.float32)
    out[names] = (table_ @ (root @ w[:-1])).astype(np.float32)
    return out, float(w[-1])


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 200, ridge: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps, on standardised features."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + ridge * len(x) / 100 * w
        hess = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * len(x) / 100 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w, mean, scale


def word_lists(texts: list[str]) -> list[list[str]]:
    """Distinct folded words of each text, written with one letter for each code."""
    codes, starts = fold(texts)
    begin, length = words_of(codes)
    first = np.searchsorted(begin, starts)
    last = np.append(first[1:], len(begin))
    spell = (codes.astype(np.uint32) + np.where(codes < 27, 96, 0x400 - 27)).astype(np.uint32).tobytes().decode("utf-32-le")
    return [list({spell[b : b + n] for b, n in zip(begin[f:l], length[f:l]) if 3 <= n <= LONGEST}) for f, l in zip(first, last)]


def _respell(words: list[str]) -> list[str]:
    """Folded spelling back to text that folds to the same codes."""
    back = {chr(0x400 - 27 + code): chr(cp) for cp in range(0x24F, 0xBF, -1) if 27 <= (code := int(_CODES[cp])) < 255}
    table_ = str.maketrans(back)
    return [w.translate(table_) for w in words]


@frugal
def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = batch.column(0).to_pylist()
        texts = [t or "" for t in batch.column(1).to_pylist()]
        lists = word_lists(texts)
        yield pa.RecordBatch.from_arrays([pa.array([w for ws in lists for w in ws], pa.string()), pa.array([lab for lab, ws in zip(labels, lists) for _ in ws], pa.int32())], names=["word", "toxic"])


@frugal
def _features(batches: Iterator[pa.RecordBatch], weights: np.ndarray, bias: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = document_features([t or "" for t in batch.column(1).to_pylist()], weights, bias)
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x[:, i]) for i in range(len(FEATURES))]], names=["toxic", *FEATURES])


def fit_words(sample: DataFrame) -> tuple[np.ndarray, float] | None:
    """The machine's weights by subsequence, and bias, from the words of labelled texts; None where they have none of one kind."""
    count = dict(sample.groupBy("toxic").count().collect())
    by_word = sample.mapInArrow(_words, "word string, toxic int").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(F.expr("1 - toxic")).alias("c"))
    by_word = durable(by_word)
    lead = by_word.where("t >= 1").orderBy(F.desc(F.col("t") / count[1] - F.col("c") / count[0]), F.xxhash64("word"), "word").limit(WORDS_BOUND)
    common = by_word.where("c >= 1").orderBy(F.desc("c"), F.xxhash64("word"), "word").limit(WORDS_BOUND // 2)
    others = by_word.where("c >= 1").orderBy(F.xxhash64("word"), "word").limit(WORDS_BOUND)
    got = lead.unionByName(common).unionByName(others).toPandas().drop_duplicates("word")
    if not got.t.sum() or not got.c.sum():
        return None
    t, c = np.sqrt(got.t.to_numpy(float)), np.sqrt(got.c.to_numpy(float))
    return fit_machine(_respell(list(got.word)), COST * len(got) * t / t.sum(), COST * len(got) * c / c.sum())


def fit_toxicity(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_BOUND) -> tuple:
    """The model: subsequence weights, bias, and the document's logistic function; or a constant score.

    The logistic function is fitted on rows whose crc32(doc_id) modulo 5 is 1, by a machine that
    hasn't seen them (if there are ``LEAST_JUDGED`` of each label); the machine is then fitted on all.
    """
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(crc_fold() != 0)
    drawn = labelled_sample(rows.where("toxic = 1"), bound).unionByName(labelled_sample(rows.where("toxic = 0"), bound))
    sample = durable(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("toxic", "text", (crc_fold() == 1).alias("judging")))  # at most 2 * bound rows are broadcast
    parts = {(r.toxic, r.judging): r["count"] for r in sample.groupBy("toxic", "judging").count().collect()}
    count = {kind: parts.get((kind, True), 0) + parts.get((kind, False), 0) for kind in (0, 1)}
    if not count[1] or not count[0]:
        return None, float(bool(count[1]))
    machine = fit_words(sample)
    if machine is None:
        return None, float(count[1] > count[0])
    apart = all(parts.get((kind, judging), 0) >= LEAST_JUDGED for kind in (0, 1) for judging in (True, False))
    earlier = fit_words(sample.where("not judging")) if apart else None
    weights, bias = earlier or machine
    judged = sample.where("judging") if earlier else sample
    x = judged.select("toxic", "text").mapInArrow(lambda b: _features(b, weights, bias), "toxic int, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas()
    share = rows.agg(F.avg("toxic")).first()[0]
    y = x.toxic.to_numpy(float)
    w, mean, scale = fit_logistic(x[FEATURES].to_numpy(), y)
    # the sample holds both labels alike: shift to their true share, half way, so that 0.5 still favours neither kind much
    w = w.copy()
    w[-1] += 0.5 * (np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean())))
    return (*machine, w, mean, scale), 0.0


def scores_of(column: pa.Array, model, constant: float) -> np.ndarray:
    """Score of each text of the column."""
    texts = [t or "" for t in column.to_pylist()]
    score = np.full(len(texts), constant)
    if model is not None:
        weights, bias, w, mean, scale = model
        for a, b in chunks(texts):
            x = (document_features(texts[a:b], weights, bias) - mean) / scale
            score[a:b] = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
    return score


@frugal
def _scores(batches: Iterator[pa.RecordBatch], model, constant: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = scores_of(batch.column(1), model, constant)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])


def chunks(texts: list[str], most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` characters, so that the arrays stay small; a longer text is a run of its own."""
    a = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > most:
            yield a, i
            a, total = i, 0
        total += len(t) + 1
    if a < len(texts):
        yield a, len(texts)


def score_toxicity(docs: DataFrame, model, constant: float = 0.0) -> DataFrame:
    """doc_id, score and predicted of each row."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int"
    return docs.select("doc_id", "text").mapInArrow(lambda b: _scores(b, model, constant), schema)


@frugal
def _clean(batches: Iterator[pa.RecordBatch], at: int, model, constant: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(scores_of(batch.column(at), model, constant) < 0.5))


def drop_toxic(docs: DataFrame, model, constant: float = 0.0) -> DataFrame:
    """docs without those that score 0.5 or more, all columns kept."""
    at = docs.columns.index("text")
    return docs.mapInArrow(lambda b: _clean(b, at, model, constant), docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, *fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(crc_fold() == 0, F.lit(False)).alias("held_out"), "score", "predicted")

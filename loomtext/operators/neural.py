"""Document encoders in numpy: convolutions over words, and gated recurrent units; trained by Adam.

Training takes a bounded sample of labelled rows in one process; scoring runs in parallel with the
weights broadcast. Ids are 1-based, 0 is padding. A convolution's window counts if it begins
inside the text; a text without known words has the zero vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most labelled rows that a network is trained on.
SAMPLE_BOUND = 4_000
KERNELS = (3, 4, 5)
Weights = dict[str, np.ndarray]


@dataclass
class Network:
    kind: str
    vocabulary: dict[str, int]
    labels: list[str]
    weights: Weights
    max_len: int
    losses: list[float] = field(default_factory=list)
    accuracy: float = 0.0


def start(kind: str, n_words: int, n_labels: int, emb: int, hidden: int, rng: np.random.Generator) -> Weights:
    draw = lambda *shape: rng.uniform(-1, 1, shape) / np.sqrt(shape[0])
    w: Weights = {"emb": rng.normal(0, 0.5, (n_words + 1, emb))}
    w["emb"][0] = 0
    if kind == "cnn":
        for k in KERNELS:
            w[f"w{k}"], w[f"b{k}"] = draw(k * emb, hidden), np.zeros(hidden)
        size = hidden * len(KERNELS)
    elif kind == "gru":
        for d in "fb":
            w[f"x{d}"], w[f"h{d}"], w[f"bx{d}"], w[f"bh{d}"] = draw(emb, 3 * hidden), draw(hidden, 3 * hidden), np.zeros(3 * hidden), np.zeros(3 * hidden)
        size = 2 * hidden
    else:
        raise ValueError(f"unknown network {kind!r}; cnn or gru")
    w["out"], w["bias"] = draw(size, n_labels), np.zeros(n_labels)
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _cnn(w: Weights, x: np.ndarray, lengths: np.ndarray):
    parts, memory = [], []
    for k in KERNELS:
        n = x.shape[1] - k + 1
        u = np.concatenate([x[:, i : i + n] for i in range(k)], axis=2)
        z = np.where((np.arange(n)[None, :] < lengths[:, None])[:, :, None], np.maximum(u @ w[f"w{k}"] + w[f"b{k}"], 0), -1.0)
        at = z.argmax(axis=1)
        top = np.maximum(np.take_along_axis(z, at[:, None, :], axis=1)[:, 0], 0)
        parts.append(top), memory.append((u, at, top))
    return np.concatenate(parts, axis=1), memory


def _cnn_back(w: Weights, memory, d: np.ndarray, x: np.ndarray, grad: Weights) -> np.ndarray:
    dx, (rows, _, emb) = np.zeros_like(x), x.shape
    hidden = d.shape[1] // len(KERNELS)
    b = np.arange(rows)[:, None]
    for i, k in enumerate(KERNELS):
        u, at, top = memory[i]
        dz = d[:, i * hidden : (i + 1) * hidden] * (top > 0)
        picked = u[b, at]  # (rows, hidden, k * emb)
        grad[f"w{k}"], grad[f"b{k}"] = np.einsum("bhu,bh->uh", picked, dz), dz.sum(axis=0)
        du = dz[:, :, None] * w[f"w{k}"].T[None]
        for j in range(k):
            np.add.at(dx, (np.broadcast_to(b, at.shape), at + j), du[:, :, j * emb : (j + 1) * emb])
    return dx


def _places(lengths: np.ndarray, width: int, back: bool) -> np.ndarray:
    """Position read at each step; a text is read from its own end when going back."""
    t = np.arange(width)[None, :]
    return np.where(t < lengths[:, None], lengths[:, None] - 1 - t if back else t, 0)


def _gru(w: Weights, x: np.ndarray, lengths: np.ndarray):
    hidden, parts, memory = w["hf"].shape[0], [], []
    width = int(lengths.max()) if len(lengths) else 0
    for d in "fb":
        places = _places(lengths, width, d == "b")
        h, steps = np.zeros((len(x), hidden)), []
        for t in range(width):
            on = (t < lengths)[:, None]
            now = x[np.arange(len(x)), places[:, t]]
            a, b = now @ w[f"x{d}"] + w[f"bx{d}"], h @ w[f"h{d}"] + w[f"bh{d}"]
            r, z = _sigmoid(a[:, :hidden] + b[:, :hidden]), _sigmoid(a[:, hidden : 2 * hidden] + b[:, hidden : 2 * hidden])
            c = b[:, 2 * hidden :]
            n = np.tanh(a[:, 2 * hidden :] + r * c)
            steps.append((now, h, r, z, c, n, on))
            h = np.where(on, (1 - z) * n + z * h, h)
        parts.append(h), memory.append((places, steps))
    return np.concatenate(parts, axis=1), memory


def _gru_back(w: Weights, memory, d: np.ndarray, x: np.ndarray, grad: Weights) -> np.ndarray:
    dx, hidden = np.zeros_like(x), w["hf"].shape[0]
    rows = np.arange(len(x))
    for i, name in enumerate("fb"):
        places, steps = memory[i]
        dh = d[:, i * hidden : (i + 1) * hidden].copy()
        for key in ("x", "h", "bx", "bh"):
            grad[key + name] = np.zeros_like(w[key + name])
        for t in range(len(steps) - 1, -1, -1):
            now, h, r, z, c, n, on = steps[t]
            g = np.where(on, dh, 0)
            dn = g * (1 - z) * (1 - n * n)
            da = np.concatenate((dn * c * r * (1 - r), g * (h - n) * z * (1 - z), dn), axis=1)
            db = np.concatenate((da[:, : 2 * hidden], dn * r), axis=1)
            grad["x" + name] += now.T @ da
            grad["h" + name] += h.T @ db
            grad["bx" + name] += da.sum(axis=0)
            grad["bh" + name] += db.sum(axis=0)
            np.add.at(dx, (rows, places[:, t]), da @ w["x" + name].T)
            dh = np.where(on, g * z, dh) + db @ w["h" + name].T
    return dx


def encode(kind: str, w: Weights, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    v, _ = (_cnn if kind == "cnn" else _gru)(w, w["emb"][ids], lengths)
    return np.where(lengths[:, None] > 0, v, 0.0)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def loss_and_gradient(kind: str, w: Weights, ids: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> tuple[float, Weights]:
    x = w["emb"][ids]
    v, memory = (_cnn if kind == "cnn" else _gru)(w, x, lengths)
    p = softmax(v @ w["out"] + w["bias"])
    rows = np.arange(len(y))
    loss = float(-np.log(np.maximum(p[rows, y], 1e-12)).mean())
    d = p.copy()
    d[rows, y] -= 1
    d /= len(y)
    grad: Weights = {"out": v.T @ d, "bias": d.sum(axis=0)}
    dx = (_cnn_back if kind == "cnn" else _gru_back)(w, memory, d @ w["out"].T, x, grad)
    grad["emb"] = np.zeros_like(w["emb"])
    np.add.at(grad["emb"], ids, dx)
    grad["emb"][0] = 0
    return loss, grad


def padded(docs: list[list[str]], vocabulary: dict[str, int], max_len: int) -> tuple[np.ndarray, np.ndarray]:
    width = max_len if max_len > max(KERNELS) else max(KERNELS) + 1
    ids, lengths = np.zeros((len(docs), width), dtype=np.int64), np.zeros(len(docs), dtype=np.int64)
    for i, d in enumerate(docs):
        known = [vocabulary[t] for t in d if t in vocabulary][:max_len]
        ids[i, : len(known)], lengths[i] = known, len(known)
    return ids, lengths


def train(kind: str, docs: list[list[str]], labels: list[str], emb: int = 32, hidden: int = 32, epochs: int = 10, batch: int = 32, rate: float = 2e-3, max_len: int = 64, min_count: int = 2, seed: int = 42) -> Network:
    """A network for a bounded list of labelled documents; accuracy is that on the training rows."""
    names = sorted(set(labels))
    if len(names) < 2:
        raise ValueError("at least two labels are needed")
    counts: dict[str, int] = {}
    for d in docs:
        for t in d:
            counts[t] = counts.get(t, 0) + 1
    vocabulary = {t: i + 1 for i, t in enumerate(sorted(t for t, c in counts.items() if c >= min_count))}
    if not vocabulary:
        raise ValueError("no word is frequent enough")
    ids, lengths = padded(docs, vocabulary, max_len)
    y = np.array([names.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    w = start(kind, len(vocabulary), len(names), emb, hidden, rng)
    m, s = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    net, step = Network(kind, vocabulary, names, w, max_len), 0
    for _ in range(epochs):
        order, total = rng.permutation(len(y)), 0.0
        for a in range(0, len(y), batch):
            at = order[a : a + batch]
            loss, grad = loss_and_gradient(kind, w, ids[at], lengths[at], y[at])
            total += loss * len(at)
            step += 1
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        net.losses.append(total / len(y))
    net.accuracy = float((probabilities(net, docs).argmax(axis=1) == y).mean())
    return net


def probabilities(net: Network, docs: list[list[str]]) -> np.ndarray:
    return softmax(encode(net.kind, net.weights, *padded(docs, net.vocabulary, net.max_len)) @ net.weights["out"] + net.weights["bias"])


def sample(labelled: DataFrame, bound: int = SAMPLE_BOUND, seed: int = 42) -> tuple[list[list[str]], list[str]]:
    """Token lists and labels of at most ``bound`` rows of (doc_id, words, label), drawn by a hash of the id.

    Ids are ranked first: each partition sends its least ones to the driver, and words come of the chosen rows alone.
    """
    order = [F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id")]
    ids = labelled.select(F.col("doc_id").alias("chosen")).orderBy(F.xxhash64(F.lit(seed), "chosen"), "chosen").limit(bound).distinct()
    drawn = labelled.join(F.broadcast(ids), labelled["doc_id"].eqNullSafe(F.col("chosen")), "left_semi")
    rows = drawn.orderBy(*order).limit(bound).select("words", "label").collect()
    return [r[0] for r in rows], [r[1] for r in rows]


def score(net: Network, tokens: DataFrame) -> DataFrame:
    """tokens (doc_id, words): (doc_id, label, probabilities, vec); label is null where no word is known."""
    shared = tokens.sparkSession.sparkContext.broadcast(net)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = shared.value
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                b = whole.slice(a, 512)
                ids, lengths = padded([x.as_py() or [] for x in b.column(1)], n.vocabulary, n.max_len)
                v = encode(n.kind, n.weights, ids, lengths)
                p = softmax(v @ n.weights["out"] + n.weights["bias"])
                label = [n.labels[i] if k else None for i, k in zip(p.argmax(axis=1), lengths)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(label, pa.string()), pa.array(p.tolist(), pa.list_(pa.float64())), pa.array(v.tolist(), pa.list_(pa.float64()))], names=["doc_id", "label", "probabilities", "vec"])

    return tokens.select("doc_id", "words").mapInArrow(each, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, label string, probabilities array<double>, vec array<double>")

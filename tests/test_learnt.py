import random

import numpy as np
import pytest

from loomtext.operators import neural, terms, wordvec
from loomtext.operators.lexicon import stem
from loomtext.plans.registry import QUERIES, _kept


@pytest.mark.parametrize("kind", ["cnn", "gru"])
def test_gradients(kind):
    rng = np.random.default_rng(2)
    w = neural.start(kind, 7, 3, 4, 5, rng)
    ids = rng.integers(1, 8, (6, 9))
    lengths = np.array([9, 7, 5, 3, 1, 6])
    ids[np.arange(9)[None, :] >= lengths[:, None]] = 0
    y = rng.integers(0, 3, 6)
    _, grad = neural.loss_and_gradient(kind, w, ids, lengths, y)
    for k in w:
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in w[k].shape)
            if k == "emb" and at[0] == 0:
                continue
            old, out = w[k][at], []
            for e in (1e-5, -1e-5):
                w[k][at] = old + e
                out.append(neural.loss_and_gradient(kind, w, ids, lengths, y)[0])
            w[k][at] = old
            assert abs((out[0] - out[1]) / 2e-5 - grad[k][at]) < 1e-5, (k, at)


def corpus(n=120):
    rng = random.Random(5)
    topics = {"food": "soup bread salt cook pan".split(), "sport": "goal team ball run win".split()}
    labels = [rng.choice(sorted(topics)) for _ in range(n)]
    return [[rng.choice(topics[lab] + ["the", "of"]) for _ in range(rng.randrange(6, 20))] for lab in labels], labels


@pytest.mark.parametrize("kind", ["cnn", "gru"])
def test_network_learns(spark, kind):
    docs, labels = corpus()
    net = neural.train(kind, docs, labels, emb=12, hidden=8, epochs=8, rate=1e-2)
    assert net.losses[-1] < net.losses[0] and net.accuracy > 0.95
    rows = spark.createDataFrame([(1, ["soup", "pan", "salt"]), (2, ["goal", "team"]), (3, ["zzz"]), (4, None)], "doc_id long, words array<string>")
    got = {r.doc_id: r for r in neural.score(net, rows).collect()}
    assert got[1].label == "food" and got[2].label == "sport" and got[3].label is None and got[4].label is None and not any(got[3].vec)
    again = neural.train(kind, docs, labels, emb=12, hidden=8, epochs=8, rate=1e-2)
    assert all((again.weights[k] == v).all() for k, v in net.weights.items())
    with pytest.raises(ValueError):
        neural.train(kind, docs, ["a"] * len(docs))


@pytest.mark.parametrize("kind", ["word", "document"])
def test_vectors_of_words_and_documents(spark, kind):
    docs, labels = corpus()
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(docs)] + [(1000, ["zzz"]), (1001, docs[0]), (1002, None)], "doc_id long, words array<string>")
    model = wordvec.fit(rows.where("doc_id < 1000"), kind, dim=12, epochs=8, parts=2)
    got = {r.doc_id: np.array(r.vec) for r in (wordvec.mean_pooled if kind == "word" else wordvec.inferred)(model, rows).collect()}
    assert not got[1000].any() and not got[1002].any() and (got[1001] == got[0]).all()
    x = np.array([got[i] for i in range(len(docs))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T - 2 * np.eye(len(x))
    assert np.mean([labels[i] == labels[j] for i, j in enumerate(s.argmax(axis=1))]) > 0.9
    if kind == "word":
        assert {w for w, _ in wordvec.most_similar(model, "soup", 4)} == {"bread", "salt", "cook", "pan"}
        assert wordvec.most_similar(model, "zzz") == [] and model.word_vector("zzz") is None and len(wordvec.analogy(model, "soup", "goal", "team")) == 3
        assert np.allclose(got[0], np.mean([model.word_vector(w) for w in docs[0]], axis=0), atol=1e-6)
        back = wordvec.from_table(wordvec.to_table(model, spark), kind="word")
        assert back.vocabulary == model.vocabulary and (back.words == model.words).all() and (back.counts == model.counts).all()
    assert sum(model.counts) == sum(map(len, docs))
    for bad in ({"dim": 0}, {"dim": 1.5}, {"epochs": True}, {"min_count": 99_999}, {"alpha": 0}):
        with pytest.raises(ValueError):
            wordvec.fit(rows, kind, **bad)


def test_word_windows_by_brute_force():
    """One batch's gradient against a loop over its pairs."""
    rng = np.random.default_rng(1)
    v, dim = 9, 4
    m = wordvec.Vectors("word", {str(i): i for i in range(v)}, rng.normal(size=(v, dim)), rng.normal(size=(v, dim)), np.ones(v), window=2, negative=0)
    ids, doc = np.array([0, 3, -1, 5, 6, 7, 8]), np.array([0, 0, 0, 0, 1, 1, 1])
    old = (m.words.copy(), m.context.copy())
    want_w, want_c = old[0].copy(), old[1].copy()
    for i in range(7):
        for j in range(max(0, i - 2), min(7, i + 3)):
            if i != j and doc[i] == doc[j] and ids[i] >= 0 and ids[j] >= 0:
                gap = 1 - wordvec.sigmoid(old[0][ids[i]] @ old[1][ids[j]])
                want_w[ids[i]] += 0.1 * gap * old[1][ids[j]]
                want_c[ids[j]] += 0.1 * gap * old[0][ids[i]]
    wordvec.learn_words(m, ids, doc, 0.1, rng)
    assert np.allclose(m.words, want_w) and np.allclose(m.context, want_c)


SF = "/root/testdata/sf0.001"


def test_pca_query_equals_numpy(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.array([r.embedding for r in rows], dtype=float)
    x -= x.mean(axis=0)
    axes = np.linalg.svd(x, full_matrices=False)[2][:2]
    axes *= np.where(axes[range(2), np.abs(axes).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    want = {r.vec_id: p for r, p in zip(rows, x @ axes.T)}
    got = {r.id: (r.p1, r.p2) for r in QUERIES["pca_2d"](spark, SF).collect()}
    assert set(got) == set(want) and all(np.allclose(got[i], want[i], atol=1e-5) for i in want)


def test_topic_queries_equal_numpy(spark):
    """Singular values and the search of all documents, from the same weights by a full decomposition."""
    tf, kept, n = _kept(spark, SF, min_df=20, max_df=0.5)
    w = terms.tfidf(tf, terms.idf(kept, n)).join(terms.indexed(kept), "term").select("doc_id", "idx", "weight").toPandas()
    docs = sorted(set(w.doc_id))
    x = np.zeros((len(docs), w.idx.max() + 1))
    x[[docs.index(d) for d in w.doc_id], w.idx] = w.weight
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    sigma = [r.sigma for r in QUERIES["lsa_fit_sigma"](spark, SF).orderBy("topic").collect()]
    assert np.allclose(sigma, s[:5], rtol=1e-6)
    v = x @ vt[:5].T
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    got: dict[int, list[float]] = {}
    for r in QUERIES["lsa_query"](spark, SF).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.score)
    assert got and all(np.allclose(scores, np.sort(v @ v[docs.index(q)])[::-1][:10], atol=1e-6) for q, scores in got.items())


def test_stem_query_equals_the_stemmer(spark):
    rows = QUERIES["stemmed_vocabulary"](spark, SF).collect()
    assert all(r.stem == stem(r.term) for r in rows) and sum(r.stem != r.term for r in rows) > 100

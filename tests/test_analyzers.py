"""Fit, query, save and load of the analyzers; what is loaded gives the rows of what was saved."""

import random

import numpy as np
import pytest

from loomtext.operators import lexicon
from loomtext.plans.analyzers import DocVecAnalyzer, NeuralAnalyzer, SemanticAnalyzer, as_documents, as_text
from loomtext.plans.facade import SentimentAnalyzer

TOPICS = {"food": "soup bread salt cook pan".split(), "sport": "goal team ball run win".split()}


def texts(n=40):
    rng = random.Random(5)
    names = [("food", "sport")[i % 2] for i in range(n)]
    return [" ".join(rng.choice(TOPICS[t]) for _ in range(rng.randrange(6, 20))) for t in names], [f"{t}_{i:02d}.txt" for i, t in enumerate(names)]


def rows(df):
    return [(r.query_id, r.rank, r["index"], round(r.score, 9), r.source) for r in df.orderBy("query_id", "rank").collect()]


CASES = [
    (SemanticAnalyzer, {}, {"k": 2}), (DocVecAnalyzer, {"method": "word2vec"}, {"dim": 8, "epochs": 6, "parts": 2}),
    (DocVecAnalyzer, {"method": "doc2vec"}, {"dim": 8, "epochs": 6, "parts": 2}), (NeuralAnalyzer, {"method": "cnn"}, {"emb": 8, "hidden": 6, "epochs": 6, "rate": 1e-2}),
]


@pytest.mark.parametrize("kind, options, params", CASES)
def test_fit_query_save_load(spark, tmp_path, kind, options, params):
    docs, sources = texts()
    path = str(tmp_path / "model")
    a = kind(spark, model_dir=path, **options)
    assert not a.is_fitted and "fitted=False" in repr(a)
    with pytest.raises(RuntimeError):
        a.query("soup")
    a.fit(docs, sources=sources, **params)
    assert a.is_fitted and a.n_docs == 40 and a.n_features == 10 and a.dim > 0
    near = a.query("soup with bread", 5).collect()
    assert len(near) == 5 and sum(r.source.startswith("food") for r in near) >= 4
    assert a.query("unknown words").count() == 0 and a.query("").count() == 0
    alike = rows(a.similar(3, 4))
    assert len(alike) == 4 and 3 not in [r[2] for r in alike] and 3 in [r[2] for r in rows(a.similar(3, 40, exclude_self=False))]
    own = rows(a.similar(docs[3], 4))
    assert [r[2] for r in own] == [r[2] for r in alike] and 3 not in [r[2] for r in own]
    assert a.similar(999).count() == a.similar(True).count() == a.similar(None).count() == 0
    assert len(a.doc_vector(0)) == len(a.doc_vector("soup")) == a.dim and not any(a.doc_vector("zzz"))
    for bad in (999, True, None):
        with pytest.raises(IndexError):
            a.doc_vector(bad)
    b = kind.load(spark, path, **options)
    c = kind(spark, model_dir=path, **options)
    for other in (b, c):
        assert other.is_fitted and other.load_error is None and (other.n_docs, other.n_features, other.dim) == (40, 10, a.dim)
        assert rows(other.query("soup with bread", 5)) == rows(a.query("soup with bread", 5)) and rows(other.similar(3, 4)) == alike
    if kind is SemanticAnalyzer:
        assert a.topics(3).count() == 6 and set(a.topic_weights("soup goal")) == {0, 1} and a.topic_weights("zzz") == {} and a.scatter().count() == 40
        size = [abs(w) for _, w in a.main_topics("soup")]
        assert size == sorted(size, reverse=True)
    else:
        assert a.word_vector("zzz") is None and a.most_similar("zzz") == [] and a.most_similar("soup", "x") == []
        assert b.most_similar("soup", 4) == a.most_similar("soup", 4) and np.allclose(b.word_vector("soup"), a.word_vector("soup"))
    if kind is NeuralAnalyzer:
        p = b.predict("soup and salt")
        assert p == pytest.approx(a.predict("soup and salt")) and max(p, key=p.get) == "food" and b.predict(1) == pytest.approx(a.predict(1))
        for bad in ("zzz", 999, True):
            with pytest.raises(ValueError):
                a.predict(bad)
    with pytest.raises(ValueError):
        (DocVecAnalyzer if kind is SemanticAnalyzer else SemanticAnalyzer).load(spark, path)
    wrong = (DocVecAnalyzer if kind is SemanticAnalyzer else SemanticAnalyzer)(spark, model_dir=path)
    assert not wrong.is_fitted and wrong.load_error


def test_constructors_and_arguments(spark, tmp_path):
    for kind in (DocVecAnalyzer, NeuralAnalyzer):
        with pytest.raises(ValueError):
            kind(spark, method="other")
    with pytest.raises(ValueError):
        SemanticAnalyzer.load(spark, str(tmp_path / "none"))
    for bad in (None, []):
        with pytest.raises(ValueError):
            as_documents(spark, bad)
    with pytest.raises(ValueError):
        as_documents(spark, ["a", "b"], sources=["x"])
    got = as_documents(spark, ["a", None, ["b", "c"]]).orderBy("doc_id").collect()
    assert [(r.text, r.source) for r in got] == [("a", "doc_0"), ("", "doc_1"), ("b c", "doc_2")] and as_text(3) == "3"


def test_sentiment_files_and_opening(spark, tmp_path):
    rng = random.Random(3)
    words = {"negative": "bad awful poor", "neutral": "plain usual normal", "positive": "good great fine"}
    corpus = spark.createDataFrame([(i, lab, " ".join(rng.choice(words[lab].split()) for _ in range(8))) for i, lab in enumerate(sorted(words) * 12)], "doc_id long, label string, text string")
    path = str(tmp_path / "m")
    with pytest.raises(ValueError):
        SentimentAnalyzer.open(spark, path)
    a = SentimentAnalyzer.open(spark, path, corpus)
    b = SentimentAnalyzer.open(spark, path)
    assert a.is_fitted and "fitted=True" in repr(b)
    assert b.analyze_text("great fine", spark)[0] == "positive" and b.analyze_text("", spark) == ("neutral", {})
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.txt").write_text("awful, bad")
    assert [(r.source, r.label) for r in b.analyze_file(spark, str(tmp_path / "t")).collect()] == [("x.txt", "negative")]


def test_lemmatizer_of_ones_own_and_joined_text(spark):
    docs = spark.createDataFrame([(1, "Cats saw the dogs"), (2, None)], "doc_id long, text string")
    stops = spark.createDataFrame([("the",)], "word string")
    names = spark.createDataFrame([("dog", "hound")], "form string, canonical string")
    cut = lambda w: w.removesuffix("s")
    got = {r.doc_id: (r.normalized, r.stopwords) for r in lexicon.normalized_text(docs, cut, names, stops).collect()}
    assert got == {1: ("cat saw the hound", 1), 2: ("", 0)}
    kept = lexicon.doc_terms(lexicon.exploded(docs), "canonical", cut, names, stops).orderBy("pos").collect()
    assert [r.term for r in kept] == ["cat", "saw", "hound"]

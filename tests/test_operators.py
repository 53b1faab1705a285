import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.operators import bayes, lexicon, lsa, sampling, search, terms
from loomtext.plans.facade import SemanticAnalyzer, SentimentAnalyzer
from loomtext.sources import corpus


def test_idf_golden(spark):
    df = spark.createDataFrame([("a", 1), ("b", 42)], "term string, df long")
    got = {r.term: r.idf for r in terms.idf(df, 42).collect()}
    assert abs(got["a"] - (math.log(43 / 2) + 1)) < 1e-12 and got["b"] == 1


@pytest.mark.parametrize("min_df, max_df", [(0, 1.0), (True, 1.0), (1, 0), (1, 1.5)])
def test_pruning_rejects_bad_bounds(spark, min_df, max_df):
    with pytest.raises(ValueError):
        terms.pruned(spark.createDataFrame([("a", 1)], "term string, df long"), 1, min_df, max_df)


def test_index_is_dense_and_in_order(spark):
    words = [f"w{i:03d}" for i in range(250)]
    got = {r.term: r.idx for r in terms.indexed(spark.createDataFrame([(w,) for w in reversed(words)], "term string")).collect()}
    assert [got[w] for w in words] == list(range(250))


def test_tfidf_rows_have_norm_one(spark):
    tf = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "a", 1)], "doc_id long, term string, tf long")
    w = terms.tfidf(tf, terms.idf(terms.document_frequency(tf), 2), sublinear=True)
    assert all(abs(r.s - 1) < 1e-12 for r in w.groupBy("doc_id").agg(F.sum(F.col("weight") ** 2).alias("s")).collect())


def test_bayes_predicts_every_document_though_sums_vary(spark):
    """Sums of shuffled rows come out anew in the last digits; a tie goes to the first label."""
    noisy = F.udf(lambda x: x + random.random() * 1e-9, "double").asNondeterministic()
    rows = spark.createDataFrame([(i, lab, -5.0 - (i + j) % 3) for i in range(60) for j, lab in enumerate("abc")], "doc_id long, label string, logp double")
    assert {r.doc_id: r.predicted for r in bayes.predict(rows.withColumn("logp", noisy("logp"))).collect()} == {i: "acb"[i % 3] for i in range(60)}
    tied = spark.createDataFrame([(1, "b", -2.0), (1, "a", -2.0), (1, "c", -3.0)], rows.schema)
    assert [r.predicted for r in bayes.predict(tied).collect()] == ["a"]


def test_bayes_priors_and_smoothing(spark):
    docs = spark.createDataFrame([(1, "n"), (2, "p"), (3, "p"), (4, "p")], "doc_id long, label string")
    tokens = spark.createDataFrame([(1, "bad"), (2, "good"), (3, "good"), (4, "fine")], "doc_id long, term string")
    m = bayes.fit(docs, tokens)
    prior = {r.label: r.prior_log for r in m.prior.collect()}
    assert abs(prior["n"] - math.log(1 / 4)) < 1e-12
    cond = {(r.label, r.term): r.cond_log for r in m.cond.collect()}
    assert abs(cond["p", "good"] - math.log(3 / 6)) < 1e-12
    p = bayes.proba(bayes.log_proba(m, docs, tokens)).groupBy("doc_id").agg(F.sum("p").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-12 for r in p)
    with pytest.raises(ValueError):
        bayes.fit(docs, tokens, alpha=0)


def test_normalisation_order(spark):
    docs = spark.createDataFrame([(1, "Cars drive The fast cars")], "doc_id long, text string")
    lemmas = spark.createDataFrame([("cars", "car")], "form string, lemma string")
    synonyms = spark.createDataFrame([("car", "auto"), ("auto", "never")], "form string, canonical string")
    stops = spark.createDataFrame([("the",), ("auto",)], "word string")
    got = [r.term for r in lexicon.doc_terms(lexicon.exploded(docs), "canonical", lemmas, synonyms, stops).orderBy("pos").collect()]
    assert got == ["auto", "drive", "fast", "auto"]  # one hop, and the canonical form is no stop word
    with pytest.raises(ValueError):
        lexicon.doc_terms(lexicon.exploded(docs), "odd")


def test_split_and_quota(spark):
    rows = spark.createDataFrame([(i, "a" if i < 25 else "b" if i < 30 else "c") for i in range(31)], "doc_id long, label string")
    n = {(r.label, r.is_test): r["count"] for r in sampling.stratified_split(rows).groupBy("label", "is_test").count().collect()}
    assert n["a", True] == 5 and n["b", True] == 1 and ("c", True) not in n
    q = {r.label: r["count"] for r in sampling.quota(rows, 8).groupBy("label").count().collect()}
    assert q == {"a": 3, "b": 3, "c": 1}


def test_search_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5))
    x[7] = 0
    x[9] = x[8]
    vec = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    got = search.search(vec.where("id < 4").withColumnRenamed("id", "query_id"), vec, 6, exclude_self=True, block=2).collect()
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    for q in range(4):
        s = u @ u[q]
        want = [i for i in np.lexsort((np.arange(60), -np.round(s, 12))) if i != q][:6]
        assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want
    assert [search.top_n_of(v) for v in (None, 0, -1, "abc", "3", True)] == [10, 0, 0, 0, 3, 0]


def test_lsa_equals_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.random((12, 9)) * (rng.random((12, 9)) < 0.6)
    w = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(12) for j in range(9) if x[i, j]], "doc_id long, idx long, weight double")
    m = lsa.fit(w, 3)
    s = np.linalg.svd(x, compute_uv=False)
    assert np.allclose([r.sigma for r in m.sigma.orderBy("topic").collect()], s[:3], rtol=1e-8)
    load = m.loadings.toPandas()
    assert all(load[load.topic == t].loading.iloc[load[load.topic == t].loading.abs().argmax()] > 0 for t in range(3))


def test_review_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("label,text\npos,good, really\nneautral,so so\nodd,x\nneg,\n".encode())
    (tmp_path / "b.tsv").write_bytes("review\tsentiment\nплохо\tnegative\n".encode("cp1251"))
    got = {(r.label, r.text) for r in corpus.load_corpus(spark, str(tmp_path)).collect()}
    assert got == {("positive", "good, really"), ("neutral", "so so"), ("negative", "плохо")}
    long = "слово " * 60_000
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "c.csv").write_text("\n \nотзыв;тональность\n" + f'"{long}";pos\n"две; части";NEG\n')
    (tmp_path / "more" / "d.csv").write_text("class,rating\npos,no header here\nlabel,text\nneg,after a header\n")
    more = {(r.label, r.text) for r in corpus.load_corpus(spark, str(tmp_path / "more")).collect()}
    assert more == {("positive", long.strip()), ("negative", "две; части"), ("positive", "no header here"), ("negative", "after a header")}
    assert {(r.label, r.text) for r in corpus.read_reviews(spark, str(tmp_path / "a.csv")).collect()} == {("positive", "good"), ("neutral", "so so")}
    sample = corpus.write_seed_sample(corpus.load_corpus(spark, str(tmp_path / "more")), str(tmp_path / "seed"), 2)
    assert sorted(r.label for r in sample.collect()) == ["negative", "positive"] and corpus.read_reviews(spark, str(tmp_path / "seed")).count() == 2
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "none.csv").write_text("text,label\ngood,pos\n")
    with pytest.raises(ValueError):
        corpus.load_corpus(spark, str(tmp_path / "sub"))


def test_text_readers(spark, tmp_path):
    (tmp_path / "x_1.txt").write_text("﻿ one \n\n two \n")
    (tmp_path / "x_2.txt").write_text("  ")
    assert [(r.source, r.text) for r in corpus.load_text_files(spark, str(tmp_path)).collect()] == [("x_1.txt", "one \n\n two")]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "stop.txt").write_text("# note\nThe\n\nthe\nand\n")
    assert sorted(r.word for r in corpus.stop_words(spark, str(tmp_path / "w" / "stop.txt")).collect()) == ["and", "the"]
    (tmp_path / "w" / "syn.json").write_text('{"Good": ["Fine", "nice"]}')
    assert {(r.form, r.canonical) for r in corpus.synonyms(spark, str(tmp_path / "w" / "syn.json")).collect()} == {("fine", "good"), ("nice", "good")}


def _reviews(spark):
    rng = random.Random(3)
    words = {"negative": "bad awful poor", "neutral": "plain usual normal", "positive": "good great fine"}
    rows = [(i, lab, " ".join(rng.choice(words[lab].split() + ["the", "film"]) for _ in range(8))) for i, lab in enumerate(sorted(words) * 20)]
    return spark.createDataFrame(rows, "doc_id long, label string, text string")


def test_sentiment_analyzer(spark, tmp_path):
    a = SentimentAnalyzer()
    with pytest.raises(RuntimeError):
        a.analyze(_reviews(spark))
    got = a.train(_reviews(spark))
    assert got["n_train"] == 48 and got["n_test"] == 12 and got["accuracy"] > 0.9
    with pytest.raises(ValueError):
        SentimentAnalyzer().train(_reviews(spark).where("label <> 'neutral'"))
    a.save(str(tmp_path / "m"))
    b = SentimentAnalyzer().load(spark, str(tmp_path / "m"))
    docs = spark.createDataFrame([(1, "great fine film"), (2, "12 !"), (3, "zzz")], "doc_id long, text string")
    rows = {r.doc_id: r for r in b.analyze(docs).collect()}
    assert rows[1].label == "positive" and rows[2].label == "neutral" and rows[2].probabilities == {} and abs(sum(rows[3].probabilities.values()) - 1) < 1e-9


def test_semantic_analyzer(spark):
    docs = spark.createDataFrame([(0, "cat dog pet cat"), (1, "dog pet animal"), (2, "stock market money"), (3, "market bank money"), (4, "12 34")], "doc_id long, text string")
    a = SemanticAnalyzer(spark).fit(docs, k=2)
    q = spark.createDataFrame([(100, "pet dog"), (101, "unknownword")], "doc_id long, text string")
    got = a.query(q, 2).collect()
    assert {r["index"] for r in got if r.query_id == 100} == {0, 1} and not [r for r in got if r.query_id == 101]
    with pytest.raises(ValueError):
        SemanticAnalyzer(spark).fit(docs.limit(1))

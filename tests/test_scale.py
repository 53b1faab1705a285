"""Steps that must not move or hold more than their input needs."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.sql import functions as F

from loomtext.operators import lexicon, lsa, neural, search, wordvec
from loomtext.plans.registry import LEMMAS, ORACLES, QUERIES, STOPS, lexicons

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["term_frequency", "tfidf_raw", "tfidf_l2", "df_pruned_vocab"])
def test_words_are_counted_where_their_texts_are(spark, name):
    """No shuffle of (document, term) rows before they are counted."""
    assert not re.search(r"hashpartitioning\(doc_id#\d+L?, term#", plan(QUERIES[name](spark, SF)))


def test_sparsity_joins_nothing(spark):
    assert "Join" not in plan(QUERIES["tfidf_sparsity"](spark, SF))


def test_network_sample_takes_words_of_chosen_rows_only(spark):
    ids = spark.range(200).select(F.col("id").alias("doc_id"))
    want = [r.doc_id for r in ids.orderBy(F.xxhash64(F.lit(42), "doc_id"), "doc_id").limit(20).collect()]
    words = F.when(F.col("doc_id").isin(want), F.array(F.concat(F.lit("w"), "doc_id"))).otherwise(F.raise_error(F.lit("words of a row that wasn't chosen")).cast("array<string>"))
    rows = ids.select("doc_id", words.alias("words"), (F.col("doc_id") % 2).cast("string").alias("label"))
    assert neural.sample(rows, 20) == ([[f"w{i}"] for i in want], [str(i % 2) for i in want])


def test_normalized_text_without_a_shuffle(spark):
    rows = [(1, "Thes die house, the anen"), (2, ""), (3, None), (None, "some words"), (4, "la les de onen los und x"), (5, "plain")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    lemmas, synonyms, stops = lexicons(spark)
    fast = lexicon.normalized_text(docs, lemmas, synonyms, stops)
    assert "Exchange" not in plan(fast)
    slow = lexicon.normalized_text(docs, lambda w: dict(LEMMAS).get(w, w), synonyms, stops)
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert key(fast) == key(slow) and sum(r.stopwords for r in fast.collect()) > 3 and "the" in STOPS


def test_pairs_of_words_by_brute_force(spark, tmp_path):
    texts = ["a a b", "b a a a c", "c", "", None, "a b a b a b"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter((w[i], w[j]) for t in texts for w in [(t or "").split()] for i in range(len(w)) for j in range(max(0, i - 2), min(len(w), i + 3)) if i != j)
    assert {(r.center, r.context): r.cnt for r in QUERIES["skipgram_pairs"](spark, str(tmp_path)).collect()} == want


def test_each_draw_is_looked_up_once_and_each_row_answered(spark, tmp_path):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60) for _ in range(5 + i)]
    spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ids = [(i % 400,) for i in range(1200)] + [(None,)]
    spark.createDataFrame(ids, "vec_id long").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = [tuple(r) for r in QUERIES["negative_sample_asof"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(con.execute(ORACLES["negative_sample_asof"]).fetchall(), key=repr) and len(got) == len(ids)


def test_search_ranks_by_twelve_decimals_before_it_drops(spark):
    rows = [(5, [1.0, 0.0]), (3, [1.0, 1e-7]), (9, [1.0, 0.0]), (7, [0.0, 1.0]), (8, None), (6, [0.5])]
    corpus = spark.createDataFrame(rows, "id long, vec array<double>").coalesce(1)
    queries = spark.createDataFrame([(1, [2.0, 0.0]), (5, [1.0, 0.0])], "query_id long, vec array<double>")
    got = sorted((r.query_id, r.rank, r.id) for r in search.search(queries, corpus, 2, exclude_self=True).collect())
    assert got == [(1, 1, 3), (1, 2, 5), (5, 1, 3), (5, 2, 9)]


def test_search_by_brute_force_over_many_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (700, 3)).astype(float)  # many ties and some zeros
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(3)
    queries = corpus.where("id % 10 = 0").withColumnRenamed("id", "query_id")
    size = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.where(size > 0, x / np.maximum(size, 1e-12), 0)
    for own in (False, True):
        got: dict[int, list] = {}
        for r in search.search(queries, corpus, 7, exclude_self=own, block=9).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        for q in range(0, 700, 10):
            ids = [i for i in range(700) if not (own and i == q)]
            assert got[q] == sorted(ids, key=lambda i: (-round(float(u[q] @ u[i]), 12), i))[:7]


def test_document_steps_by_loops():
    rng = np.random.default_rng(5)
    m = wordvec.Vectors("document", {str(i): i for i in range(9)}, rng.normal(size=(9, 4)), rng.normal(size=(9, 4)), np.arange(1, 10), negative=2)
    ids, old = rng.integers(0, 9, 30), m.context.copy()
    v = old[ids].mean(axis=0)
    v /= np.linalg.norm(v)
    away = m.draw(np.random.default_rng(1), 60)
    step, met = np.zeros_like(old), np.zeros(9)
    for at, want in [(i, 1) for i in ids] + [(i, 0) for i in away]:
        step[at] += 0.1 * (want - wordvec.sigmoid(old[at] @ v)) * v
        met[at] += 1
    wordvec.learn_document(m, ids, 0.1, np.random.default_rng(1))
    assert np.allclose(m.context, old + step / np.sqrt(np.maximum(1, met / 4))[:, None])


def test_models_share_ids_and_common_words(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a", "z"]), (2, None), (3, ["b", "a"]), (4, [])], "doc_id long, words array<string>")
    found, ids = wordvec.prepared(rows, 2)
    assert found == [("a", 3), ("b", 2)] and {r.doc_id: list(r.ids) for r in ids.collect()} == {1: [0, 1, 0, -1], 2: [], 3: [1, 0], 4: []}
    model = wordvec.fit(rows, dim=4, min_count=2, epochs=1, ready=(found, ids))
    assert wordvec.most_common(model, 2) == ["a", "b"]
    by = lambda t: {r.doc_id: r.vec for r in wordvec.mean_pooled(model, t).collect()}
    assert by(ids) == by(rows)
    assert wordvec.vocabulary_of(rows, 1, 2) == [("a", 3), ("b", 2)]


def test_guided_draws_equal_a_search():
    m = wordvec.Vectors("word", {}, np.zeros((5000, 2)), np.zeros((5000, 2)), np.arange(1, 5001)[::-1] ** 2)
    u = np.random.default_rng(8).random(20_000)
    assert (m.draw(np.random.default_rng(8), 20_000) == np.minimum(np.searchsorted(m.cdf, u), 4999)).all()


def test_topics_solver_reads_rows_of_the_jvm(spark, monkeypatch):
    """Rows handed to the solver are a kept DataFrame; an RDD of Python's would be decoded at each of its steps."""
    given = []
    monkeypatch.setattr(lsa, "RowMatrix", lambda rows, *size: given.append((type(rows).__name__, "InMemoryTableScan" in plan(rows))) or RowMatrix(rows, *size))
    weights = spark.createDataFrame([(d, i, float((d * 7 + i * 3) % 5 + 1)) for d in range(12) for i in range(8) if (d + i) % 3], "doc_id long, idx long, weight double")
    model = lsa.fit(weights, 2)
    assert given == [("DataFrame", True)]
    x = np.zeros((12, 8))
    for r in weights.collect():
        x[r.doc_id, r.idx] = r.weight
    assert np.allclose([r.sigma for r in model.sigma.orderBy("topic").collect()], np.linalg.svd(x)[1][:2])
    assert model.documents.count() == 12

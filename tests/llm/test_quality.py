import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from loomtext.llm.quality import FEATURES, IsolationForest, base_failed, calibrate, drawn_rows, judge_quality, repeated_words, rule_statistics
from tests.llm.helpers import awkward, docs


def brute_repeated(words, size=5):
    wins = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
    hit = set()
    for i, w in enumerate(wins):
        if wins.count(w) > 1:
            hit.update(range(i, i + size))
    return len(hit)


def test_repeated_words_equal_brute_force():
    rng = random.Random(5)
    for n in [0, 1, 4, 5, 6, 40, 120]:
        for _ in range(20):
            words = [rng.choice([b"a", b"b", b"c"]) for _ in range(n)]
            assert repeated_words(words) == brute_repeated(words)


def test_counts():
    counts, _ = rule_statistics("a #b\x0bc\na #b\n\n x  |\nx")
    assert counts == [8, 10, 3, 0, 0]
    counts, _ = rule_statistics("l one\nl one\nl one\n \n ")
    assert counts[3] == 2  # blank lines never count
    assert rule_statistics(None)[0] == [0, 0, 0, 0, 0]
    assert rule_statistics("a\u00a0b")[0][:2] == [1, 3]  # a no-break space parts no words
    assert base_failed(9, 0) and not base_failed(10, 2) and base_failed(10, 3)


def test_forest_isolates_outliers_and_calibration_spares_good():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    f = IsolationForest().fit(x)
    assert f.score(np.array([[9.0, 9.0, 9.0]]))[0] > f.score(x).mean() + 0.1
    s = np.concatenate((rng.uniform(0, 0.5, 500), rng.uniform(0.6, 1, 100)))
    good = np.arange(600) < 500
    cut = calibrate(s, good)
    assert 0.5 <= cut <= 0.65
    assert calibrate(s, np.ones(600, bool)) == float("inf")
    assert calibrate(np.zeros(0), np.zeros(0, bool)) == float("inf")


def test_awkward_tables(spark):
    texts = awkward()
    labels = spark.createDataFrame([(5, 1, 0), (6, 1, 0), (1, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in judge_quality(docs(spark, texts), labels).collect()}
    assert len(rows) == len(texts)
    assert rows[1].base_failed and not rows[1].kept and rows[1].n_words == 0
    assert rows[5].kept == rows[6].kept and not rows[5].base_failed
    for i, t in enumerate(texts):
        assert [rows[i + 1][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == rule_statistics(t)[0]
    empty = labels.where("false")
    assert judge_quality(docs(spark, texts).where("false"), empty).count() == 0
    assert judge_quality(docs(spark, ["a b c d e f g h i j"]), empty).first().kept


def test_cut_counts_every_labelled_row(spark):
    """The verdicts are those of a cut calibrated on all judged labelled rows, however many there are."""
    rng = random.Random(9)
    n = 20_000
    bad = [rng.random() < 0.2 for _ in range(n)]
    texts = [" ".join("#" * (rng.random() < (0.25 if b else 0.1)) + rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(rng.randrange(12, 20))) for b in bad]
    labels = spark.createDataFrame([(i + 1, int(not b), 0) for i, b in enumerate(bad)], "doc_id long, quality int, toxic int")
    rows = judge_quality(docs(spark, texts), labels).collect()
    judged = [r for r in rows if not r.base_failed and zlib.crc32(str(r.doc_id).encode()) % 5 == 1]
    cut = calibrate(np.array([r.anomaly for r in judged]), np.array([not bad[r.doc_id - 1] for r in judged]))
    assert len(rows) == n and 0 < cut < 1
    assert [r.kept for r in rows] == [not r.base_failed and r.anomaly < cut for r in rows]


def test_trees_have_rows_of_their_own_where_there_are_enough(spark):
    rng = np.random.default_rng(1)
    f = IsolationForest(trees=4, subsample=8)
    drawn = []
    f._grow = lambda x, *rest: drawn.append(x[:, 0]) or (np.zeros(1, int), np.zeros(1), np.full(1, -1), np.zeros(1))
    f.fit(np.stack([np.arange(100.0), rng.random(100)], axis=1))
    assert len(np.unique(np.concatenate(drawn))) == 32
    rows = spark.range(3000).select("id", *[(F.hash("id") / (i + 1)).alias(c) for i, c in enumerate(FEATURES)]).withColumnRenamed("id", "doc_id")
    some = drawn_rows(rows, 3000, 500)
    assert some.shape == (500, len(FEATURES)) and (drawn_rows(rows.repartition(7), 3000, 500) == some).all()
    assert len(drawn_rows(rows, 3000, 4000)) == 3000

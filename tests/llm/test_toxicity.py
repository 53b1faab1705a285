import random

import numpy as np

from loomtext.llm.common import held_out
from loomtext.llm.toxicity import drop_toxic, fit_toxicity, fold, kernel, score_toxicity, words_of
from tests.llm.helpers import awkward, docs


def corpus(n=700, seed=2):
    rng = random.Random(seed)
    syllables = ["ka", "mo", "ri", "te", "lu", "sen", "par", "dol"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    texts, toxic = [], []
    for _ in range(n):
        words = [word() for _ in range(rng.randrange(20, 60))]
        if bad := rng.random() < 0.3:
            for w in rng.sample(["idiot", "stupid", "moron", "id-iot", "stuupid", "m o r o n"], 3):
                words.insert(rng.randrange(len(words)), w)
        texts.append(" ".join(words)), toxic.append(int(bad))
    return texts, toxic


def slow_kernel(a, b, decay=0.6, span=6):
    """Gap-weighted common subsequences of four characters, by listing them."""
    from itertools import combinations

    def table(w):
        w, out = "^" + w, {}
        for at in combinations(range(len(w)), 4):
            if at[3] - at[0] < span:
                key = "".join(w[i] for i in at)
                out[key] = out.get(key, 0) + decay ** (at[3] - at[0] - 3)
        return out

    x, y = table(a), table(b)
    dot = lambda p, q: sum(v * q.get(k, 0) for k, v in p.items())
    return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5


def test_kernel_equals_listing_of_subsequences():
    words, marks = ["stupid", "stuupid", "idiot", "table"], ["stupid", "idiots", "tables"]
    got, _, _ = kernel(words, marks)
    assert np.allclose(got, [[slow_kernel(a, b) for b in marks] for a in words], atol=1e-5)


def test_fold_joins_spaced_and_cut_words():
    codes, _ = fold(["I d i o t tables", "id-iot ID.IOT"])
    begin, length = words_of(codes)
    assert length.tolist() == [5, 6, 5, 5]


def test_held_out_accuracy_and_tolerance(spark):
    texts, toxic = corpus()
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i + 1, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    model = fit_toxicity(d, labels)
    got = {r.doc_id: r for r in score_toxicity(d, *model).collect()}
    test = [i for i in range(len(texts)) if held_out(i + 1)]
    assert sum(got[i + 1].predicted == toxic[i] for i in test) >= 0.95 * len(test)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    odd = docs(spark, ["kamo rite you stu.pid mor-on senpar", "kamo rite lusen parka senpar ridol", *awkward(3000)])
    rows = {r.doc_id: r for r in score_toxicity(odd, *model).collect()}
    assert len(rows) == odd.count() and rows[1].score > rows[2].score and rows[3].score == rows[4].score == rows[5].score
    left = drop_toxic(odd, *model)
    assert left.columns == odd.columns and {r.doc_id for r in left.collect()} == {i for i, r in rows.items() if not r.predicted}


def test_labels_of_one_kind_or_none(spark):
    d = docs(spark, ["a b c", None])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in score_toxicity(d, *fit_toxicity(d, none)).collect()] == [0.0, 0.0]
    ones = spark.createDataFrame([(i, 1, 1) for i in (1, 2, None)], "doc_id long, quality int, toxic int")
    assert {r.score for r in score_toxicity(d, *fit_toxicity(d, ones)).collect()} == {1.0}
    assert score_toxicity(d.where("false"), *fit_toxicity(d.where("false"), ones)).count() == 0

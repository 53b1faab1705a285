import random

import pytest

from loomtext.llm.decontaminate import drop_leaking, find_leaks
from tests.llm.helpers import awkward, docs

ITEM = "If Alice drives 12 km in 30 minutes and then walks 5 km with Bob, how many kilometres does Alice cover each hour on average?"


def leaks(spark, texts, items, **more):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = find_leaks(docs(spark, texts), bench, **more).collect()
    return {r.doc_id: [x.item_id for x in r.leaks] for r in rows}


def test_copies_edits_and_new_parameters(spark):
    filler = " ".join(f"pad{i}" for i in range(60))
    copy = f"{filler} {ITEM} {filler}"
    shouted = ITEM.replace("?", " ?!").replace("kilometres", "kilometres,")
    other = ITEM.replace("Alice", "Carla").replace("Bob", "Dmitri").replace("12", "48").replace("30", "90").replace("5 km", "7 km")
    clash = other.replace("48 km", "7 km").replace("Dmitri", "Carla").replace("90", "7")  # three slots of the item share a filler
    got = leaks(spark, [copy, shouted, other, clash, filler, *awkward(2000)], [ITEM, None, "", "one"])
    assert got[1] == got[2] == got[3] == [0] and got[4] == [] and got[5] == []
    assert got[9] == [3]  # the text "one": an item of one word is a window of its own length
    assert all(got[i] == [] for i in (6, 7, 8, 10))


def test_against_brute_force_on_plain_words(spark):
    rng = random.Random(4)
    word = lambda: f"w{'abcdefghij'[rng.randrange(10)]}{'klmnopqrst'[rng.randrange(10)]}"
    items = [" ".join(word() for _ in range(rng.randrange(12, 30))) for _ in range(30)]
    texts = []
    for _ in range(120):
        words = [word() for _ in range(50)]
        it = rng.choice(items).split()
        part = it[: max(5, int(len(it) * rng.choice([0.4, 0.7, 0.9, 1.0])))]
        words[20:20] = part
        texts.append(" ".join(words))

    def brute(text):
        w = text.split()
        have = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        out = []
        for k, it in enumerate(items):
            x = it.split()
            need = {tuple(x[i : i + 5]) for i in range(len(x) - 4)}
            if len(need & have) >= 0.8 * len(need):
                out.append(k)
        return out

    want = {i + 1: brute(t) for i, t in enumerate(texts)}
    assert leaks(spark, texts, items) == want and any(want.values())
    assert leaks(spark, texts, items, block=70) == want


def test_empty_tables_and_columns(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    d = docs(spark, ["a b", None])
    assert [r.leaks for r in find_leaks(d, bench).collect()] == [[], []]
    assert find_leaks(d.where("false"), bench).count() == 0
    assert set(find_leaks(d, bench).columns) == set(d.columns)


QUESTION = "{0} has {2} apples. {1} gives {0} {3} more apples. How many apples does {0} have now?"


def test_names_at_the_beginning_numbers_and_units(spark):
    item = QUESTION.format("Alice", "Bob", "3", "5")
    drive = "Tom drives 5 km in three hours and then rests for 20 min before the long way home."
    texts = [
        item, QUESTION.format("Carol", "Dave", "7", "9"), QUESTION.format("Carol", "Dave", "seven", "7"), "Some words before. " + QUESTION.format("Omar", "Li", "40", "2") + " And after.",
        QUESTION.format("Carol", "Carol", "7", "9"),  # one name for two
        item.replace("apples", "pears"), drive.replace("5 km", "80km").replace("three", "4").replace("20 min", "35min").replace("Tom", "Jens"),
    ]
    got = leaks(spark, texts, [item, drive, "one two three"])
    assert got == {1: [0], 2: [0], 3: [0], 4: [0], 5: [], 6: [], 7: [1]}


def brute_leaks(texts, items):
    """Both readings of sentence beginnings in plain Python: names {A..}, numbers, and words in lower case."""
    def readings(text):
        out, begins = [], True
        for chunk in text.split():
            word = chunk.strip(".?,")
            name = word[0].isupper()
            out.append((word.lower() if name and not begins or not name else None, word, "#" if word.isdigit() else "N" if name else word.lower(), begins))
            begins = chunk[-1] in ".?"
        words = [w for _, w, _, _ in out]
        names = [t for _, _, t, _ in out]
        plain = [w.lower() if b and t == "N" else t for _, w, t, b in out]
        return words, names, plain

    def grams(x):
        return [tuple(x[i : i + 5]) for i in range(len(x) - 4)]

    found = []
    for text in texts:
        words, names, plain = readings(text)
        have = {}
        for g in (grams(names), grams(plain)):
            for p, w in enumerate(g):
                have.setdefault(w, set()).add(p)
        mine = []
        for k, item in enumerate(items):
            iwords, inames, iplain = readings(item)
            seen = {}
            for q, (a, b) in enumerate(zip(grams(inames), grams(iplain))):
                seen.setdefault(a, set()).update((q, p) for w in (a, b) for p in have.get(w, ()))
            hit = {a: v for a, v in seen.items() if v}
            if len(hit) < 0.8 * len(seen) - 1e-9:
                continue
            votes = {}
            for v in hit.values():
                for d in {p - q for q, p in v}:
                    votes[d] = votes.get(d, 0) + 1
            best = max(votes, key=lambda d: (votes[d], -d))
            pairs = set()
            for v in hit.values():
                q, p = min(v, key=lambda o: (abs(o[1] - o[0] - best), o))
                pairs |= {(inames[q + i], iwords[q + i].lower(), words[p + i].lower()) for i in range(5) if inames[q + i] in "#N"}
            fine = [x for x in pairs if sum(y[:2] == x[:2] for y in pairs) == 1 and (x[0] == "#" or sum(y[0] == "N" and y[2] == x[2] for y in pairs) == 1)]
            if len(fine) >= 0.8 * len(pairs):
                mine.append(k)
        found.append(mine)
    return found


@pytest.mark.parametrize("block", [8_000_000, 40])
def test_against_brute_force_with_names_and_numbers(spark, block):
    rng = random.Random(11)
    people = ["Alice", "Bob", "Carol", "Dave", "Omar", "Lin", "Ana", "Jens"]
    verbs, things = ["takes", "sells", "finds", "paints"], ["apples", "pears", "cups", "maps"]

    def question(shape, who, numbers):
        r = random.Random(shape)
        text = [f"{who[r.randrange(2)]} {r.choice(verbs)} {numbers[i]} {r.choice(things)} from the {r.choice(things)} of {who[r.randrange(2)]} {r.choice(['today', 'again', 'soon'])}." for i in range(r.randrange(2, 4))]
        return " ".join([*text, f"How many {r.choice(things)} are left for {who[0]}?"])

    draw = lambda: (rng.sample(people, 2), [str(rng.randrange(2, 99)) for _ in range(4)])
    items = [question(s, *draw()) for s in range(12)]
    texts = []
    for _ in range(90):
        q = question(rng.randrange(16), *draw()).split()
        if rng.random() < 0.4:
            q = q[: int(len(q) * rng.choice([0.6, 0.8, 0.9]))]
        texts.append(" ".join(["pad words stand here."] * rng.randrange(3) + q + ["and more of them."] * rng.randrange(2)))
    want = brute_leaks(texts, items)
    assert list(leaks(spark, texts, items, block=block).values()) == want and sum(map(bool, want)) > 20
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    kept = drop_leaking(docs(spark, texts), bench, block=block)
    assert kept.columns == docs(spark, texts).columns
    assert sorted(r.doc_id for r in kept.collect()) == [i + 1 for i, w in enumerate(want) if not w]

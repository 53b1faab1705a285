import random
from collections import Counter

from loomtext.llm.lines import dedup_lines
from tests.llm.helpers import awkward, docs

_SPACE = " \t\n\x0b\x0c\r"


def brute(texts, least, chars=1):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(_SPACE))
    split = [(t or "").split("\n") for t in texts]
    seen = Counter(k for lines in split for k in {key(x) for x in lines} if len(k) >= chars)
    out = []
    for lines in split:
        kept = [x for x in lines if not (len(key(x)) >= chars and seen[key(x)] >= least)]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def table(rng):
    lines = ["Shared line", "  shared LINE\t", "SHARED é", "shared É", "", " ", "\u00a0", "x", "Menu\r", "menu"] + [f"own {i}" for i in range(40)]
    return ["\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 12))) for _ in range(150)] + awkward(3000)


def test_equal_to_brute_force_both_ways(spark):
    texts = table(random.Random(8))
    for least, chars in ((10, 1), (4, 3), (1, 1)):
        for broadcast in (500_000, 0):
            got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in dedup_lines(docs(spark, texts), least, chars, broadcast_keys=broadcast).collect()}
            assert [got[i + 1] for i in range(len(texts))] == brute(texts, least, chars)


def test_empty_and_columns(spark):
    d = docs(spark, ["a"])
    assert dedup_lines(d.where("false")).count() == 0
    assert {*d.columns, "n_lines", "n_dropped"} == set(dedup_lines(d).columns)

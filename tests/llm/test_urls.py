import random
import re
from fnmatch import translate

from loomtext.llm.urls import GLOBS, OP8_SQL, RULES, GlobAutomaton, canonical, filter_urls, op8_url_filter, parts, rule_of


def test_automaton_equals_regular_expressions():
    rng = random.Random(6)
    globs = ["*".join("".join(rng.choice("ab?") for _ in range(rng.randrange(4))) for _ in range(rng.randrange(1, 4))) for _ in range(60)] + ["*", "", "a", "*a", "a*"]
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 9))) for _ in range(300)] + ["", "a" * 200]
    for some in (globs, [g for g in globs if set(g) - {"*"}], GLOBS, ["b*c", "?"]):
        slow = [re.compile(translate(g)) for g in some]
        assert GlobAutomaton(some).matches(texts).tolist() == [any(p.match(t) for p in slow) for t in texts]


def test_parts_and_rules():
    assert parts(None) == parts("www.a.com/x") == ("", "")
    assert parts("HTTP://A.Com") == ("a.com", "") and parts("x://É.COM?q/://y") == ("É.com", "") and parts("h://a/b?c#d") == ("a", "/b") and parts("h://a#/b") == ("a", "")
    assert rule_of("www.example.com", "/en/71", RULES) == ("example.com/en/7", "allow")
    assert rule_of("notexample.com", "/en/71", RULES) == ("com/en/", "block") and rule_of("xcom", "/en/", RULES) is None


def test_table(spark):
    urls = [None, "", "no scheme", "https://a.com/en/1", "https://example.com/en/7", "https://x.fr/casino/1", "https://x.fr/" + "a" * 20_000, "https://a.com/en/1"]
    rows = spark.createDataFrame([(i, u, "h", "p", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, path string, verdict string")
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in filter_urls(rows).collect()}
    assert got[0] == got[1] == got[2] == ("", None, "allow") and got[3] == got[7] == ("a.com", "com/en/", "block")
    assert got[4] == ("example.com", "example.com/en/7", "allow") and got[5][2] == "block" and got[6][2] == "allow"
    assert filter_urls(rows.where("false")).count() == 0


def test_canonical_urls():
    assert canonical("a%2Ecom", "/%73pam/X") == "a.com/spam/x" and canonical("h", "/%25%C3%A9%0a%zz%") == "h/%%c3%a9%0a%zz%"
    assert canonical("h", "/a/../b/./c/..") == "h/b/" and canonical("h", "/../../x") == "h/x" and canonical("h", "/a/%2e%2e/b") == "h/b" and canonical("h", "") == "h"


def test_query_equals_its_sql_on_evasive_urls(spark, tmp_path):
    import duckdb

    rng = random.Random(2)
    bits = ["/", "..", ".", "%73pam", "SPAM", "a", "%2e%2e", "%C3%A9", "é", "ads", "track", "%2F", "?q", "%", "%zz", ".exe", "%2eEXE", "en/7"]
    urls = [None, "no", *(f"http://{rng.choice(['a.com', 'WWW.example.net', 'x%2Eorg', 'é.fr'])}" + "".join(rng.choice(bits) for _ in range(rng.randrange(9))) for _ in range(500))]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(con.execute(OP8_SQL).fetchall())
    assert sorted(tuple(r) for r in op8_url_filter(spark, str(tmp_path)).collect()) == want
    assert 50 < sum(r[4] == "block" for r in want) < 450


def test_every_rule_has_the_contracts_word(spark, tmp_path):
    import duckdb

    contract = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    assert ", ".join(f"{v} {h}{p}" for v, h, p in RULES) == contract
    urls = [f"https://{sub}{h}{p}{end}" for _, h, p in RULES for sub in ("", "www.") for end in ("1", "casino")]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    want = [(h + p, v) for v, h, p in RULES for _ in range(4)]
    assert [(r.rule, r.verdict) for r in op8_url_filter(spark, str(tmp_path)).orderBy("page_id").collect()] == want
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert [r[3:] for r in sorted(con.execute(OP8_SQL).fetchall())] == want

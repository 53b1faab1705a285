import random
from collections import Counter

from loomtext.llm.html import MIN_CLASS, MIN_PAGES, SUPPORT, _tag_code, _text_code, extract, main_text, page_tokens, templates

PAGE = """<html><head><title>T</title><style>p{}</style><script>"<p>no</p>"</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav>
<header>Site</header><div class="cookie">We use cookies</div><article><h1>Head &amp; title</h1><p>First &lt;b&gt;  <b>bold</b>
text.<p>Second&nbsp;&#233;<br>line.<div class="ad">Buy</div><form>Name <input></form><div class="comments"><p>Reader says</div></article><aside>Side</aside><footer>Foot</footer></body></html>"""


def test_article_and_cuts():
    assert main_text(PAGE) == "Head & title\n\nFirst <b> bold text.\n\nSecond é line."
    assert main_text(None) == main_text("") == main_text("<p></p>") == main_text("<script>x") == ""
    assert main_text("plain words") == "plain words"
    assert main_text("<article><p>open <b>never closed") == "open never closed"
    assert main_text("<article>" + "<div>" * 3000 + "deep</article>") == "deep"


def test_template_of_a_host(spark):
    page = lambda i: f"<body><div><p>Same menu here</p><p>Same second</p><p>Same third</p></div><div><p>Own text number {i} is here, and long enough.</p></div><div><p>Same end</p></div></body>"
    rows = spark.createDataFrame([(i, f"http://h.com/{i}", page(i), "x") for i in range(8)] + [(100, None, None, "x"), (101, "http://h.com/0", page(0), "x"), (102, "h", "<p>x" * 5000, "x")], "page_id long, url string, html string, text string")
    for broadcast in (100_000, 0):
        got = {r.page_id: r for r in extract(rows, broadcast).collect()}
        assert got[3].text == "Own text number 3 is here, and long enough." and got[3].n_chars == len(got[3].text)
        assert got[101].text == got[0].text and got[100].text == "" and got[102].n_chars == 5000 + 2 * 4999
    assert extract(rows.where("false")).count() == 0


def test_deep_nesting_closes_its_own():
    deep = "<div>" * 500 + "in" + "</div>" * 500
    assert main_text(f"<div><article><p>before</p>{deep}<p>after</p></article>out</div>") == "before\n\nin\n\nafter"
    assert main_text("<i>" * 450 + "out<article><p>text</p><nav>menu</nav></article>") == "text"
    assert main_text("<article>" + "<b>x" * 20_000 + "</i>" * 20_000) == "x" * 20_000


def test_template_inside_articles(spark):
    page = lambda i: f"<body><article><h1>Title {i}</h1><p>Editors choose these pages</p><div class='x'><p>Read it in our app</p><p>Call the desk</p></div><p>Own <b>text</b> number {i} is here.</p></article></body>"
    copy = "<body><main><p>All</p><p>of it</p><p>is alike</p></main></body>"
    rows = spark.createDataFrame([(i, f"http://h.com/{i}", page(i)) for i in range(8)] + [(100 + i, f"http://k.com/{i}", copy) for i in range(5)] + [(200, "http://one.com/", page(9))], "page_id long, url string, html string")
    for broadcast in (100_000, 0):
        got = {r.page_id: r.text for r in extract(rows, broadcast).collect()}
        assert got[3] == "Title 3\n\nOwn text number 3 is here."
        assert got[102] == "All\n\nof it\n\nis alike"
        assert "Call the desk" in got[200]  # a host of one page has no template


def test_names_only_break_ties():
    assert main_text('<article><p>One.</p><div class="related-work"><p>Two.</p></div><p class="alert">Three.</p></article>') == "One.\n\nTwo.\n\nThree."
    assert main_text("<header>Site</header><article><header><h1>Head</h1></header><p>Text.</p></article>") == "Head\n\nText."
    assert main_text("<article><h1>Long</h1><p>" + "word " * 40 + "</p></article><article><p>Teaser text</p></article>").startswith("Long\n\nword") and "Teaser" not in main_text("<article><p>" + "word " * 40 + "</p></article><article><p>Teaser text</p></article>")
    both = "<article><p>First entry of the day</p></article><article><p>Second entry of the day</p></article>"
    assert main_text(both) == "First entry of the day\n\nSecond entry of the day"
    assert main_text('<article><p>A</p><div class="comments"><article class="comment"><p>Reader</p></article></div><section class="comment-list">B</section><div class="post-comments">C</div></article>') == "A"
    alert = frozenset([_tag_code("/article/p.alert")])
    assert main_text('<article><p>One.</p><p class="alert">Three.</p></article>', alert) == "One."


WORDS = "river stone lamp green under table seven music paper cloud winter garden".split()


def _site(rng, n):
    """Pages of one host without telling names: (html, main text)."""
    say = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    box, column = rng.choice(["wide", "main-col", "x"]), rng.choice(["div", "section"])
    menu = "".join(f"<li><a href=/{w}>{w}</a></li>" for w in rng.sample(WORDS, 5))
    pages = []
    for _ in range(n):
        title, body = say(4), [say(rng.randrange(8, 30)) for _ in range(rng.randrange(2, 7))]
        side = "".join(f"<p>{say(3)}</p>" for _ in range(rng.randrange(3)))
        inner = "".join(f"<p>{b}</p>" for b in body)
        html = f"<html><body><div><ul>{menu}</ul></div><div>{side}<p>Write to our desk</p></div><{column} class='{box}'><h2>{title}</h2>{inner}<p>All words are made up</p></{column}><div><p>Our own town</p><p>since long</p></div></body></html>"
        pages.append((html, "\n\n".join([title, *body])))
    return pages


def test_the_template_chooses_the_slot(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for h in range(6):
        for html, text in _site(rng, 12):
            want[len(rows)] = text
            rows.append((len(rows), f"http://h{h}.com/{len(rows)}", html))
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    for broadcast in (100_000, 0):
        assert {r.page_id: r.text for r in extract(d, broadcast).collect()} == want
    assert all(main_text(html) != want[i] for i, _, html in rows)  # without the template the pages give other texts


def test_templates_equal_plain_occurrence_vectors(spark):
    """Classes by whole vectors in plain Python, over random hosts of few and many pages."""
    rng = random.Random(9)
    rows = []
    for h, n in enumerate((2, 4, 9, 30)):
        rows += [(len(rows) + i, f"http://h{h}.com/{rng.randrange(5)}", html if rng.random() < 0.9 else "<p>odd") for i, (html, _) in enumerate(_site(rng, n))]
    got = {r.host: set(r.tokens) for r in templates(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    want = {}
    for h in range(4):
        pages = [page_tokens(html) for _, url, html in rows if f"//h{h}." in url]
        vectors = {}
        for i, page in enumerate(pages):
            for token, (n, _) in page.items():
                vectors.setdefault(token, [0] * len(pages))[i] = n
        often = {t: tuple(v) for t, v in vectors.items() if sum(map(bool, v)) >= max(3, SUPPORT * len(pages))}
        sizes = Counter(often.values())
        valid = {_tag_code(t[1]) if t[0] else _text_code(t[1], t[2]) for t, v in often.items() if sizes[v] >= MIN_CLASS}
        if len(pages) >= MIN_PAGES and often:
            want[f"h{h}.com"] = valid
    assert got == want and sum(map(len, want.values())) > 20

"""HTML main text by equivalence-class template deduction.

A page's tokens are its tags and its text nodes, each with its path of open elements (names, and
classes without digits). Over the pages of one host every token has an occurrence vector (how often
it is in each page); tokens with equal vectors form an equivalence class. A vector is kept as a sum
over pages of a per-page random number times the count, so classes come from one groupBy with
map-side sums, however many pages a host has. Classes of at least ``MIN_CLASS`` tokens found in at
least ``SUPPORT`` of the host's pages are valid; nested by path they are the host's template: its
tags are the skeleton, its text nodes are boilerplate, and what lies between are slots.

The template chooses the slot: among the skeleton's elements that stand once in a page, from the
outermost down to the one that still holds most of the host's slot text (text of no valid class,
outside links) and, where its heading stands beside it, the heading. Each page's text is what fills
that element. Only where the host has no template, or the page lacks its element, the page's own
article or main element counts, else the element with the most slot text. Within the element a
block that is template text throughout is boilerplate; a page with no other text there is a copy of
the host's other pages, and is kept whole.

Element and class names break ties: menus, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments are cut where they are named so, a header only outside an article; a
paragraph or heading is cut by its class only if the template holds it. Character references are
decoded, white space inside a block is one space, blocks are joined by two \\n in page order.

Defined cases: null or empty html gives the empty text; pages without a host are one group;
truncated and unclosed markup is read to its end; hosts of fewer than ``MIN_PAGES`` pages have no
template. Repeated rows give equal texts. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import durable, frugal, table
from loomtext.llm.urls import parts

MIN_PAGES, MIN_CLASS, SUPPORT = 4, 3, 0.8
#: The share of its parent's slot text that an element needs to be chosen in its place, and of the largest of several articles.
MOST, SEVERAL = 0.6, 0.5
#: Parts that a host's pages are dealt to where templates are joined.
SALTS = 16
#: Template tokens that are broadcast (some 100 bytes each); more are joined by host.
BROADCAST_TOKENS = 100_000
#: Characters from which a path is shortened to a digest.
LONG_PATH = 2_000

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)(?:>|(?=<)|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in ("script", "style", "textarea", "noscript", "template", "svg", "title")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_CUT = frozenset("nav header footer aside form script style noscript template iframe button select option textarea svg canvas object dialog menu head title".split())
#: Class names and ids of what isn't main text, as whole names and with the endings that such names have.
_NAMES = re.compile(
    r"(?:ads?|advert\w*|adsense|sponsor\w*|promos?|promoted|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|sidebar|side-bar|rail|comments?|disqus|replies|reply|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|toolbar|widget|pagination|pager)"
    r"(?:[_-](?:\d+|list|box|bar|block|area|wrap(?:per)?|container|section|slot|unit|links?|buttons?|icons?|form|item|items|body|content|thread|posts?|articles?|stories|news|main|top|bottom|left|right|primary|site|page|banner|notice|menu|nav|popup|text|inner))*"
    r"|(?:site|page|main|top|left|right|primary|global|mobile|user|reader|blog|cookie|post)[_-](?:ads?|banner|cookies?|notices?|sidebar|comments?|menu|nav|navbar|navigation|breadcrumbs?|footer|header|share|sharing|social|related|newsletter|pagination)",
    re.I,
)
_TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote td".split())
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: An opening tag ends these open elements, up to the nearest of the second set.
_ENDS = {
    **{t: (frozenset(["p"]), frozenset(["button", "td", "th", "article", "section", "div", "body", "li", "blockquote", "main", "aside", "header", "footer", "nav"])) for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()},
    "li": (frozenset(["li", "p"]), frozenset(["ul", "ol", "menu"])), "dt": (frozenset(["dt", "dd", "p"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd", "p"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th", "p"]), frozenset(["table"])), "td": (frozenset(["td", "th", "p"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th", "p"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}


#: What an element's name or attributes say of it: nothing, that it is cut, that it is a header, that it bears a name of what is cut.
PLAIN, CUT, HEADER, NAMED = range(4)


def _looks(tag: str, attributes: str) -> tuple[int, str]:
    """One of the four, and the classes without digits."""
    kind, classes = (HEADER if tag == "header" else CUT if tag in _CUT else PLAIN), ""
    if attributes:
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "role" and value in _ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
                kind = CUT
            elif name in ("class", "id"):
                names = value.split()
                if name == "class":
                    classes = "".join(f".{c}" for c in names if not any(map(str.isdigit, c)))
                if kind == PLAIN and tag not in ("html", "body", "article", "main") and any(map(_NAMES.fullmatch, names)):
                    kind = NAMED
    return kind, classes


class Node:
    __slots__ = ("tag", "path", "index", "link")

    def __init__(self, tag: str, path: str, index: int, link: bool = False):
        self.tag, self.path, self.index, self.link = tag, path, index, link


def read(html: str) -> tuple[list[str], list[tuple[str, int, int, bool]], list[tuple[str, str, int, int]]]:
    """Paths of tag tokens; text nodes (text, block, element's number, in a link); elements (tag, path, parent's number, looks)."""
    tags, texts, elements = [], [], [("", "", -1, PLAIN)]
    stack = [Node("", "", 0)]
    depth: Counter = Counter()  # open elements of each name, so that a search of the stack for none is spared
    block, at, size = 0, 0, len(html)

    def text(a: int, b: int) -> None:
        if b > a and stack[-1].tag not in ("script", "style") and not (piece := html[a:b]).isspace():
            texts.append((piece, block, stack[-1].index, stack[-1].link))
        elif b > a and texts and texts[-1][1] == block:  # blanks between inline elements part words
            texts.append((" ", block, stack[-1].index, False))

    def close(i: int) -> None:
        for n in stack[i:]:
            depth[n.tag] -= 1
        del stack[i:]

    while at < size:
        m = _TOKEN.search(html, at)
        if not m:
            text(at, size)
            break
        text(at, m.start())
        at = max(m.end(), m.start() + 1)
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag == "br":
            if texts and texts[-1][1] == block:
                texts.append((" ", block, texts[-1][2], False))
            continue
        if closing:
            for i in range(len(stack) - 1, 0, -1) if depth[tag] else ():
                if stack[i].tag == tag:
                    close(i)
                    break
                if stack[i].tag in ("article", "main", "body", "td") and tag in _INLINE:
                    break
            if tag not in _INLINE:
                block += 1
            continue
        if tag in _ENDS:
            ends, bounds = _ENDS[tag]
            for i in range(len(stack) - 1, 0, -1) if any(depth[t] for t in ends) else ():
                if stack[i].tag in bounds:
                    break
                if stack[i].tag in ends:
                    close(i)
                    break
        if tag not in _INLINE:
            block += 1
        looks, classes = _looks(tag, m[3])
        path = f"{stack[-1].path}/{tag}{classes}" if tag not in _INLINE else stack[-1].path
        if len(path) > LONG_PATH:  # deep nesting: the path's digest stands for it
            path = f"~{xxhash.xxh3_64_hexdigest(path.encode('utf-8', 'surrogatepass'))}"
        if tag not in _INLINE:
            tags.append(path)
        if tag in _VOID or m[3].endswith("/"):
            continue
        if tag in _RAW_END:
            end = _RAW_END[tag].search(html, at)
            at = end.end() if end else size
            if tag not in ("noscript", "svg"):
                block += 1
            continue
        node = Node(tag, path, len(elements), stack[-1].link or tag == "a")
        elements.append((tag, path, stack[-1].index, looks))
        stack.append(node)
        depth[tag] += 1
    return tags, texts, elements


def squeeze(text: str) -> str:
    return " ".join(unescape(text).split())


def _code(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass")) - (1 << 63)


def _text_code(path: str, text: str) -> int:
    return _code(f"{path}|{text}")


def _tag_code(path: str) -> int:
    return _code(f"<{path}>")


def cut_elements(elements: list[tuple[str, str, int, int]], template: frozenset[int] | None = None) -> list[bool]:
    """Whether each element lies in one that is cut. None: there is no template to ask."""
    out: list[bool] = []
    article: list[bool] = []
    for tag, path, up, looks in elements:
        inside = up >= 0 and article[up]
        cut = up >= 0 and out[up] or looks == CUT or looks == HEADER and not inside
        if looks == NAMED and not cut:
            cut = tag not in _TEXTUAL or template is not None and _tag_code(path) in template
        out.append(cut)
        article.append(inside or tag in ("article", "main"))
    return out


def page_tokens(html: str | None) -> dict[tuple[bool, str, str], list[int]]:
    """Template tokens of a page, (is a tag, path, text): how often each is there, and its characters outside links and cuts (a tag's: in all of its element)."""
    tags, texts, elements = read(html or "")
    out: dict[tuple[bool, str, str], list[int]] = {}
    for path in tags:
        out.setdefault((True, path, ""), [0, 0])[0] += 1
    cut = cut_elements(elements)
    own = [0] * len(elements)
    for piece, _, at, link in texts:
        if t := squeeze(piece):
            row = out.setdefault((False, elements[at][1], t), [0, 0])
            row[0] += 1
            if not link and not cut[at]:
                row[1] += len(t)
                own[at] += len(t)
    for i in range(len(elements) - 1, 0, -1):
        tag, path, up, _ = elements[i]
        own[up] += own[i]
        if own[i] and tag not in _INLINE:
            out[True, path, ""][1] += own[i]
    return out


_VECTORS = "host string, token long, is_tag boolean, place long, path string, pages long, hits long, v1 long, v2 long, chars long"


@frugal
def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums per host and token over each batch: pages, occurrences, the occurrence vector's two random sums, characters."""
    for batch in batches:
        sums: dict[tuple, list[int]] = {}
        pages: Counter = Counter()
        for page, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            host = parts(url)[0]
            pages[host] += 1
            draw = xxhash.xxh3_64_intdigest(repr((page, url)).encode("utf-8", "surrogatepass"))
            for (is_tag, path, text), (n, chars) in page_tokens(html.as_py()).items():
                key = (host, _tag_code(path), True, None, path) if is_tag else (host, _text_code(path, text), False, _tag_code(path), None)
                row = sums.setdefault(key, [0, 0, 0, 0, 0])
                for i, x in enumerate((1, n, n * (draw & 0x7FFFFFFF), n * (draw >> 33), chars)):
                    row[i] += x
        rows = [(*k, *v) for k, v in sums.items()] + [(h, None, False, None, None, n, 0, 0, 0, 0) for h, n in pages.items()]
        cols = list(zip(*rows)) if rows else [[]] * 10
        types = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[c.split()[0] for c in _VECTORS.split(", ")])


def _within(path: str, outer: str) -> bool:
    return path == outer or path.startswith(outer + "/")


def choose(tags: dict[str, tuple[int, int, int]], boiler: list[tuple[str, int]]) -> str:
    """Path of the element that holds the host's main text ("": none found).

    tags: of each skeleton path the pages and occurrences, and the characters in it; boiler: paths
    and characters of the template's texts.
    """
    weight = {p: chars - sum(c for at, c in boiler if _within(at, p)) for p, (_, _, chars) in tags.items()}
    last = lambda p: p.rpartition("/")[2].partition(".")[0]
    once = [p for p, (pages, hits, _) in tags.items() if hits <= 1.1 * pages and last(p) not in _TEXTUAL and last(p) not in _VOID and last(p) != "li"]
    now, total = "", max(weight.values(), default=0)
    while True:
        under = [p for p in once if (not now or _within(p, now)) and p != now and weight[p] >= MOST * total and weight[p] > 0]
        if not under:
            break
        # the outermost of those below, the heavier of two
        best = min(under, key=lambda p: (p.count("/"), -weight[p], p))
        if last(now) not in ("", "html", "body", "main") and any(f"{now}/{h}" in tags for h in ("h1", "h2", "header")):
            break  # a heading beside it belongs to the text
        now, total = best, weight[best]
        if last(now) == "article":
            break
    return now if last(now) not in ("", "html", "body") else ""


def _chosen(group: pa.Table) -> pa.Table:
    """A host's template: its tokens of valid classes, and the path of its main element."""
    rows = group.to_pylist()  # tokens of most of its pages: no more than a page has
    vector = lambda r: (r["pages"], r["v1"], r["v2"])
    sizes = Counter(map(vector, rows))
    valid = [r for r in rows if sizes[vector(r)] >= MIN_CLASS]
    paths = {r["token"]: r["path"] for r in rows if r["is_tag"]}
    tags = {r["path"]: (r["pages"], r["hits"], r["chars"]) for r in valid if r["is_tag"]}
    boiler = [(paths[r["place"]], r["chars"]) for r in valid if not r["is_tag"] and r["place"] in paths]
    tokens = sorted(r["token"] for r in valid)
    return pa.table({"host": pa.array([rows[0]["host"]], pa.string()), "tokens": pa.array([tokens], pa.list_(pa.int64())), "main": pa.array([choose(tags, boiler)], pa.string())})


def templates(pages: DataFrame) -> DataFrame:
    """(host, tokens, main): each host's template tokens, and the path of its main element."""
    sums = pages.select("page_id", "url", "html").mapInArrow(_vectors, _VECTORS)
    sums = sums.groupBy("host", "token", "is_tag", "place", "path").agg(*[F.sum(c).alias(c) for c in ("pages", "hits", "v1", "v2", "chars")]).where("token is null or pages >= 3")
    sums = durable(sums)
    hosts = sums.where("token is null").select("host", F.col("pages").alias("all")).where(F.col("all") >= MIN_PAGES)
    tokens = sums.where("token is not null").join(hosts, "host").where(F.col("pages") >= SUPPORT * F.col("all")).drop("all")
    return tokens.groupBy("host").applyInArrow(_chosen, "host string, tokens array<long>, main string")


def _largest(elements: list[tuple[str, str, int, int]], roots: list[int], size: list[int]) -> set[int]:
    """Of several roots, those that aren't much smaller than the largest (others are teasers); one inside another goes."""
    inner = set()
    for i in roots:
        up = elements[i][2]
        while up >= 0 and up not in roots:
            up = elements[up][2]
        if up >= 0:
            inner.add(i)
    outer = [i for i in roots if i not in inner]
    most = max((size[i] for i in outer), default=0)
    return {i for i in outer if size[i] >= SEVERAL * most}


def main_text(html: str | None, template: frozenset[int] | None = None, main: str = "") -> str:
    """Main text of a page, given its host's template tokens and the path of its main element."""
    _, texts, elements = read(html or "")
    if not texts:
        return ""
    cut = cut_elements(elements, template)
    known = template or frozenset()
    boiler = [bool(known) and not piece.isspace() and _text_code(elements[at][1], squeeze(piece)) in known for piece, _, at, _ in texts]
    size = [0] * len(elements)
    for (piece, _, at, _), b in zip(texts, boiler):
        size[at] += 0 if cut[at] or b else len(piece)
    for i in range(len(elements) - 1, 0, -1):
        size[elements[i][2]] += size[i]
    named = [[i for i, (_, path, _, _) in enumerate(elements) if main and path == main and elements[i][0] not in _INLINE]]
    named += [[i for i, e in enumerate(elements) if e[0] == tag] for tag in ("article", "main")]
    roots = next((_largest(elements, r, size) for r in named if any(not cut[i] for i in r)), set())
    by_block = bool(roots)
    if not roots:
        roots = {_densest(texts, elements, cut, boiler, known)}
    inside: list[bool] = []
    for i, (_, _, up, _) in enumerate(elements):
        inside.append(i in roots or up >= 0 and inside[up])
    blocks: list[list[str]] = []
    own: list[bool] = []  # whether the block has slot text
    last = None
    for (piece, block, at, _), b in zip(texts, boiler):
        if cut[at] or not inside[at] or b and not by_block:
            continue
        if block != last:
            blocks.append([])
            own.append(False)
            last = block
        blocks[-1].append(piece)
        own[-1] |= not b and not piece.isspace()
    if by_block and any(own):
        blocks = [b for b, o in zip(blocks, own) if o]
    return "\n\n".join(t for b in blocks if (t := squeeze("".join(b))))


def _densest(texts: list, elements: list, cut: list[bool], boiler: list[bool], template: frozenset[int]) -> int:
    """The skeleton's container with the most slot text that isn't links, or its parent if that holds much more."""
    weight: Counter = Counter()
    skeleton = {i for i, (tag, path, _, _) in enumerate(elements) if tag and tag not in _INLINE and tag not in ("p", "html") and (not template or _tag_code(path) in template)} or {0}
    inner: list[int] = []  # each element's innermost element of the skeleton, itself included
    for i, (_, _, up, _) in enumerate(elements):
        inner.append(i if i in skeleton else inner[up] if up >= 0 else -1)
    for (piece, _, at, link), b in zip(texts, boiler):
        if not (cut[at] or link or b) and inner[at] >= 0:
            weight[inner[at]] += len(piece)
    if not weight:
        return 0
    best = max(weight, key=lambda i: (weight[i], -i))
    up = inner[elements[best][2]] if best else -1
    return best if weight[best] >= 0.7 * sum(weight.values()) or up < 0 else up


@frugal
def _extract(batches: Iterator[pa.RecordBatch], by_host: dict[str, tuple[frozenset[int], str]] | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        joined = None if by_host is not None else list(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()))
        texts = []
        for i, (url, html) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2))):
            if joined is None:
                template, main = by_host.get(parts(url)[0], (None, ""))
            else:
                template, main = joined[i]
            texts.append(main_text(html.as_py(), None if template is None else frozenset(template), main or ""))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], dtype=np.int64))], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """Per row: page_id, url, text and n_chars."""
    found = durable(templates(pages))
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    rows = pages.select("page_id", "url", "html")
    size = found.agg(F.sum(F.size("tokens") + F.lit(1))).first()[0] or 0
    if size <= broadcast_tokens:
        by_host = {r.host: (frozenset(r.tokens), r.main) for r in found.collect()}  # at most ``broadcast_tokens`` tokens and hosts
        shared = pages.sparkSession.sparkContext.broadcast(by_host)
        return rows.mapInArrow(lambda b: _extract(b, shared.value), schema)
    host = F.regexp_extract(F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(""), "^[^/?#]*", 0)
    lower = F.translate(F.coalesce(host, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # a host may hold a third of the pages: they are dealt to SALTS parts, each with a copy of its template
    salted = rows.withColumn("host", lower).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
    lists = found.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(lists, ["host", "salt"], "left").select("page_id", "url", "html", "tokens", "main").mapInArrow(lambda b: _extract(b, None), schema)


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))

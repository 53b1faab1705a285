"""URL filter: rules on host and path, and glob rules run together as one bit-parallel automaton.

All globs are laid side by side in the bits of a multiword state, one bit for each pattern
character; a * keeps its bit alive. One Shift-And step for each character of the canonical URL
(host, then path) advances every glob at once, for a whole batch of URLs in numpy. In the canonical
URL escapes of printable ASCII are decoded, A-Z are lower-cased and dot segments are resolved, so
that no spelling of a URL evades a glob; host, path and the rules are of the URL as written.

Rules (host, path) come first: a rule fits its host and all subdomains if the path starts with the
rule's, and the longest rule that fits wins. Where none fits, the globs decide: a blocking glob that
matches the whole canonical URL blocks it, else it is allowed.

Defined cases: a null URL or one without :// has an empty host and path, no rule, and is allowed
(unless a glob matches the empty text). Repeated rows are judged one by one; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomtext.llm.common import frugal, table

#: (verdict, host, path).
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Globs over host + path that block; * is any run of characters, ? any single one.
GLOBS = ["*spam*", "*adult*", "*casino*", "*phish*", "*malware*", "*porn*", "*/ads/*", "*/track/*", "*.exe", "*xxx?*"]


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    at = re.search(r"[/?#]", rest)
    host, rest = (rest, "") if at is None else (rest[: at.start()], rest[at.start() :])
    at = re.search(r"[?#]", rest)
    return re.sub(r"[A-Z]+", lambda m: m[0].lower(), host), rest if at is None else rest[: at.start()]


_ESCAPE = re.compile("%([2-7][0-9A-Fa-f])")
_LOWER = {c: c + 32 for c in range(65, 91)}


def canonical(host: str, path: str) -> str:
    """Host and path with printable ASCII decoded, A-Z lower-cased and dot segments resolved."""
    text = f"{host}\n{path}"  # a URL's newline stays within its part
    if "%" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), text)
    host, path = text[: (at := len(_ESCAPE.sub("x", host)))], text[at + 1 :]
    if "/." in path:
        out: list[str] = []
        steps = path.split("/")
        for step in steps:
            if step == "..":
                del out[max(1, len(out) - 1) :]
            elif step != ".":
                out.append(step)
        path = "/".join(out + [""] * (steps[-1] in (".", "..")))
    return (host + path).translate(_LOWER)


def rule_of(host: str, path: str, rules: list[tuple[str, str, str]]) -> tuple[str, str] | None:
    """(rule as text, verdict) of the longest rule that fits."""
    fit = [(h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda x: (len(x[0]), x[0]), default=None)


class GlobAutomaton:
    """Shift-And over all globs at once; bit i is pattern character i, stars folded into the bit before."""

    def __init__(self, globs: list[str]):
        self.starts, self.ends, self.loops, self.masks = 0, 0, 0, {}
        self.any, self.empty = 0, []
        place, letters = 0, []
        for g in globs:
            chars = re.sub(r"\*+", "*", g)
            self.starts |= 1 << place  # a bit for the beginning of each glob
            if chars.startswith("*"):
                self.loops |= 1 << place
            at = place
            for c in chars:
                if c == "*":
                    self.loops |= 1 << at
                    continue
                at += 1
                if c == "?":
                    self.any |= 1 << at
                else:
                    letters.append((c, at))
            self.ends |= 1 << at
            place = at + 1
        for c, at in letters:
            self.masks[c] = self.masks.get(c, 0) | 1 << at
        self.words = max(1, -(-place // 64))

    def _split(self, bits: int) -> np.ndarray:
        return np.array([bits >> 64 * w & (1 << 64) - 1 for w in range(self.words)], dtype=np.uint64)

    def matches(self, texts: list[str]) -> np.ndarray:
        """Whether any glob matches the whole of each text."""
        letters = np.array(sorted(map(ord, self.masks)), dtype=np.uint32)
        table_ = np.stack([self._split(self.any), *[self._split(self.masks[chr(c)] | self.any) for c in letters]])
        loops, ends = self._split(self.loops), self._split(self.ends)
        order = np.argsort([-len(t) for t in texts], kind="stable")  # longest first, so that the live ones are a prefix
        lengths = np.array([len(texts[i]) for i in order], dtype=np.int64)
        points = np.frombuffer("".join(texts[i] for i in order).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if len(letters):
            at = np.minimum(np.searchsorted(letters, points), len(letters) - 1)
            codes = np.where(letters[at] == points, at + 1, 0)
        else:
            codes = np.zeros(len(points), dtype=np.int64)
        begin = np.cumsum(lengths) - lengths
        state = np.tile(self._split(self.starts), (len(texts), 1))
        live = len(texts)
        for step in range(int(lengths[0]) if len(texts) else 0):
            live = int(np.searchsorted(-lengths[:live], -step, side="left"))
            now = state[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = moved & table_[codes[begin[:live] + step]] | now & loops
        hit = np.zeros(len(texts), dtype=bool)
        hit[order] = (state & ends).any(axis=1)
        return hit


@frugal
def _judge(batches: Iterator[pa.RecordBatch], rules: list, globs: list[str]) -> Iterator[pa.RecordBatch]:
    automaton = GlobAutomaton(globs)
    for batch in batches:
        split = [parts(u) for u in batch.column(1).to_pylist()]
        ruled = [rule_of(h, p, rules) for h, p in split]
        bad = automaton.matches([canonical(h, p) for h, p in split])
        verdict = [r[1] if r else "block" if b else "allow" for r, b in zip(ruled, bad)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([h for h, _ in split], pa.string()), pa.array([p for _, p in split], pa.string()), pa.array([r and r[0] for r in ruled], pa.string()), pa.array(verdict, pa.string())],
            names=["page_id", "host", "path", "rule", "verdict"],
        )


def filter_urls(pages: DataFrame, rules: list = RULES, globs: list[str] = GLOBS) -> DataFrame:
    """Per row: page_id, host, path, rule (or null) and verdict."""
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string"
    return pages.select("page_id", "url").mapInArrow(lambda b: _judge(b, rules, globs), schema)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def _like(glob: str) -> str:
    return glob.replace("_", "\\_").replace("%", "\\%").replace("*", "%").replace("?", "_")


_FITS = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{}}" for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
)
_SORTED = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
#: Escapes of what isn't printable ASCII get their own percent sign escaped, so that decoding leaves them.
_DECODED = "CASE WHEN contains({0}, '%') THEN url_decode(regexp_replace({0}, '%([0189a-fA-F][0-9a-fA-F])', '%25\\1', 'g')) ELSE {0} END"
_STEP = "CASE WHEN s[1] = '.' THEN acc WHEN s[1] = '..' THEN acc[1:greatest(1, len(acc) - 1)] ELSE acc || s END"
OP8_SQL = f"""
WITH rests AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM rests),
parts AS (SELECT page_id, translate(h, {_UPPER}) AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM hosts),
steps AS (SELECT *, string_split({_DECODED.format("path")}, '/') AS steps FROM parts),
whole AS (
  SELECT page_id, host, path, translate({_DECODED.format("host")} || array_to_string(
    list_reduce(list_transform(steps, lambda s: [s]), lambda acc, s: {_STEP}) || CASE WHEN steps[-1] IN ('.', '..') THEN [''] ELSE [] END, '/'), {_UPPER}) AS canonical
  FROM steps)
SELECT page_id, host, path, CASE {_FITS.format(*[f"'{h + p}'" for _, h, p in _SORTED])} END AS rule,
       CASE {_FITS.format(*[f"'{v}'" for v, _, _ in _SORTED])} {" ".join(f"WHEN canonical LIKE '{_like(g)}' ESCAPE '{chr(92)}' THEN 'block'" for g in GLOBS)} ELSE 'allow' END AS verdict
FROM whole
"""

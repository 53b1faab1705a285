"""Text functions as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"(?iu)[а-яё]+(?:['’-][а-яё]+)*|[a-z]+(?:['’-][a-z]+)*"
#: White space as Python's str.split() sees it.
SPACE = r"[\s\x1c-\x1f]"
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
LABELS = {"negative": "negative", "neutral": "neutral", "positive": "positive", "neautral": "neutral", "neg": "negative", "neut": "neutral", "pos": "positive"}
# Words of a header row, by the order of columns that they tell.
SENTIMENT_FIRST = ["review", "sentiment", "отзыв", "тональность"]
LABEL_FIRST = ["label", "text", "метка", "текст"]
DELIMITERS = ["\t", ",", ";"]


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def tokenize(c: Column) -> Column:
    """Lower-cased Cyrillic or Latin words, in order, repeats kept; null gives none."""
    return F.transform(F.regexp_extract_all(or_empty(c), F.lit(TOKEN), F.lit(0)), F.lower)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def sentences(c: Column) -> Column:
    """Split at newlines, and after . ! ? … before white space; stripped, empties dropped."""
    parts = F.flatten(F.transform(F.split(or_empty(c), "\n"), lambda x: F.split(x, rf"(?U)(?<=[.!?…])(?={SPACE})")))
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def squeeze(c: Column) -> Column:
    """White-space runs to one space, trimmed."""
    return F.trim(F.regexp_replace(or_empty(c), rf"(?U){SPACE}+", " "))


def snippet(c: Column, limit: int = 160) -> Column:
    flat = squeeze(c)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…")))


def lines(c: Column) -> Column:
    """Non-blank lines, stripped."""
    return F.filter(F.transform(F.split(or_empty(c), LINE_BREAK), strip), lambda x: x != "")


def label(c: Column) -> Column:
    """One of the three sentiment labels, or the empty text."""
    known = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return F.coalesce(F.element_at(known, F.lower(strip(F.regexp_replace(or_empty(c), "﻿", "")))), F.lit(""))


def delimiter(first_line: Column) -> Column:
    """The delimiter found most often; ties go to tab, comma, semicolon in this order; none is a comma."""
    n = [F.regexp_count(first_line, F.lit(d)) for d in DELIMITERS]
    most = F.greatest(*n)
    return F.when(most == 0, ",").when(n[0] == most, DELIMITERS[0]).when(n[1] == most, DELIMITERS[1]).otherwise(DELIMITERS[2])


def first_line(content: Column) -> Column:
    """The first line that isn't blank, or the empty text."""
    breaks = "\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029"
    return F.regexp_extract(or_empty(content), rf"(?U)\A(?:[\s\x1c-\x1f&&[^{breaks}]]*[{breaks}])*([^{breaks}]*)", 1)


def is_header(cells: Column) -> Column:
    """Whether all non-empty cells are header words, and there is one."""
    full = F.filter(F.transform(cells, lambda x: F.lower(strip(F.regexp_replace(strip(x), "^\ufeff+|\ufeff+$", "")))), lambda x: x != "")
    return (F.size(full) > 0) & F.forall(full, lambda x: x.isin(SENTIMENT_FIRST + LABEL_FIRST))


def orientation(cells: Column) -> Column:
    low = F.transform(cells, lambda x: F.lower(strip(x)))
    hits = lambda words: F.size(F.array_intersect(low, F.array(*map(F.lit, words))))
    return F.when(hits(SENTIMENT_FIRST) > hits(LABEL_FIRST), "sentiment_first").otherwise("label_first")


def split_row(cells: Column, d: Column | str) -> Column:
    """A row of one cell is split again by a delimiter other than a tab."""
    d = F.lit(d) if isinstance(d, str) else d
    return F.when((F.size(cells) == 1) & (d != "\t"), F.split(cells[0], d)).otherwise(cells)


def review_of(cells: Column, sentiment_first: Column) -> Column:
    """struct<label, text> of a row's cells: the label first and the other cells joined by commas, or the text first and the label last."""
    n = F.size(cells)
    rest = F.array_join(F.slice(cells, 2, F.greatest(n - 1, F.lit(0))), ",")
    raw = F.when(sentiment_first, F.element_at(cells, -1)).otherwise(cells[0])
    words = F.when(sentiment_first, cells[0]).otherwise(rest)
    return F.struct(label(raw).alias("label"), squeeze(words).alias("text"))


def topic_of(source: Column, last: bool = False) -> Column:
    """Topic from a source's name: before the first underscore (else the first dot), or before the last underscore."""
    if last:
        return F.when(source.contains("_"), F.regexp_extract(source, "(?s)^(.*)_[^_]*$", 1)).otherwise(source)
    return F.when(source.contains("_"), F.substring_index(source, "_", 1)).otherwise(F.substring_index(source, ".", 1))


def pad(ids: Column, length: int) -> Column:
    """Cut to ``length`` and filled with 0 on the right."""
    some = F.slice(ids, 1, length)
    return F.concat(some, F.array_repeat(F.lit(0).cast("int"), F.lit(length) - F.size(some)))

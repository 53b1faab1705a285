"""Normalisation by lexicon: lemma, synonym, stop words; and the Russian Snowball stemmer.

Lexicons are dimension tables; Spark joins or broadcasts them by their size. The stemmer runs on
the distinct vocabulary only, in Arrow batches, and is joined back.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions.text import tokenize

MODES = ("canonical", "stem", "lemma", "raw")
_VOWELS = "аеиоуыэюя"
_GERUND = (r"(?<=[ая])(?:вшись|вши|в)$", r"(?:ившись|ывшись|ивши|ывши|ив|ыв)$")
_REFLEXIVE = r"(?:ся|сь)$"
_ADJECTIVE = r"(?:ими|ыми|его|ого|ему|ому|ее|ие|ые|ое|ей|ий|ый|ой|ем|им|ым|ом|их|ых|ую|юю|ая|яя|ою|ею)$"
_PARTICIPLE = (r"(?<=[ая])(?:ющ|вш|ем|нн|щ)$", r"(?:ивш|ывш|ующ)$")
_VERB = (r"(?<=[ая])(?:ешь|нно|ете|йте|ла|на|ли|ем|ло|но|ет|ют|ны|ть|й|л|н)$", r"(?:ейте|уйте|ила|ыла|ена|ите|или|ыли|ило|ыло|ено|ует|уют|ены|ить|ыть|ишь|ей|уй|ил|ыл|им|ым|ен|ят|ит|ыт|ую|ю)$")
_NOUN = r"(?:иями|ями|ами|ией|иям|ием|иях|ев|ов|ие|ье|еи|ии|ей|ой|ий|ям|ем|ам|ом|ах|ях|ию|ью|ия|ья|а|е|и|й|о|у|ы|ь|ю|я)$"


def stem(word: str | None) -> str:
    """Snowball stem of a Russian word; words of other alphabets stay as they are."""
    word = (word or "").lower().replace("ё", "е")
    m = re.search(f"[{_VOWELS}]", word)
    if not m:
        return word
    rv = m.end()
    r1 = next((m.end() for m in [re.search(f"[{_VOWELS}][^{_VOWELS}]", word)] if m), len(word))
    r2 = next((r1 + m.end() for m in [re.search(f"[{_VOWELS}][^{_VOWELS}]", word[r1:])] if m), len(word))
    head, tail = word[:rv], word[rv:]

    def cut(patterns, text: str) -> tuple[str, bool]:
        for p in patterns if isinstance(patterns, tuple) else (patterns,):
            new = re.sub(p, "", text)
            if new != text:
                return new, True
        return text, False

    tail, done = cut(_GERUND, tail)
    if not done:
        tail, _ = cut(_REFLEXIVE, tail)
        tail, adjective = cut(_ADJECTIVE, tail)
        if adjective:
            tail, _ = cut(_PARTICIPLE, tail)
        else:
            tail, verb = cut(_VERB, tail)
            if not verb:
                tail, _ = cut(_NOUN, tail)
    tail = re.sub("и$", "", tail)
    whole = head + tail
    if (m := re.search("(?:ость|ост)$", whole)) and m.start() >= r2:
        whole = whole[: m.start()]
    if (short := re.sub("(?:ейше|ейш)$", "", whole[rv:])) != whole[rv:]:
        whole = whole[:rv] + short
    if whole[rv:].endswith("нн"):
        return whole[:-1]
    if whole[rv:].endswith("ь"):
        return whole[:-1]
    return whole


def stems(words: DataFrame, stemmer: Callable[[str], str] = stem) -> DataFrame:
    """(term, stem) of the distinct terms of ``words``."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(stem=b["term"].map(stemmer))

    return words.select("term").where("term is not null").distinct().mapInPandas(each, "term string, stem string")


def exploded(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, pos, term) of every token."""
    return docs.select("doc_id", F.posexplode(tokenize(F.col(text))).alias("pos", "term"))


#: Lexicons of at most so many rows are broadcast (some 50 bytes each).
BROADCAST_ROWS = 200_000


def _small(lexicon: DataFrame) -> DataFrame:
    return F.broadcast(lexicon) if lexicon.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else lexicon


def lemmas_of(words: DataFrame, lemmatizer: Callable[[str], str]) -> DataFrame:
    """(form, lemma) of the distinct terms of ``words`` by a function of one's own."""
    return stems(words, lemmatizer).select(F.col("term").alias("form"), F.col("stem").alias("lemma"))


def normalize(tokens: DataFrame, lemmas: DataFrame | Callable[[str], str] | None, synonyms: DataFrame | None, stops: DataFrame | None) -> DataFrame:
    """tokens (doc_id, pos, term) with lemma, canonical and is_stopword.

    lemmas (form, lemma), or a function that gives a word's lemma, and synonyms (form, canonical)
    default to the word itself; the synonym of the lemma is looked up once. A token is a stop word
    if its lemma or itself is in ``stops`` (word).
    """
    out = tokens.withColumn("lemma", F.col("term"))
    if lemmas is not None:
        found = lemmas_of(tokens, lemmas) if callable(lemmas) and not isinstance(lemmas, DataFrame) else _small(lemmas.select("form", "lemma"))
        out = out.drop("lemma").join(found.withColumnRenamed("form", "term"), "term", "left").withColumn("lemma", F.coalesce("lemma", "term"))
    out = out.withColumn("canonical", F.col("lemma"))
    if synonyms is not None:
        out = out.drop("canonical").join(_small(synonyms.select(F.col("form").alias("lemma"), "canonical")), "lemma", "left").withColumn("canonical", F.coalesce("canonical", "lemma"))
    out = out.withColumn("is_stopword", F.lit(False))
    if stops is not None:
        words = _small(stops.select("word").distinct())
        a, b = words.select(F.col("word").alias("term"), F.lit(True).alias("s1")), words.select(F.col("word").alias("lemma"), F.lit(True).alias("s2"))
        out = out.drop("is_stopword").join(a, "term", "left").join(b, "lemma", "left").withColumn("is_stopword", F.coalesce("s1", "s2", F.lit(False))).drop("s1", "s2")
    return out.select(*tokens.columns, "lemma", "canonical", "is_stopword")


def without_stops(tokens: DataFrame, lemmas, synonyms, stops: DataFrame | None) -> DataFrame:
    """``normalize`` less its stop words: anti joins on the word and on its lemma."""
    out = normalize(tokens, lemmas, synonyms, None).drop("is_stopword")
    if stops is not None:
        words = _small(stops.select("word").distinct())
        out = out.join(words.withColumnRenamed("word", "term"), "term", "left_anti").join(words.withColumnRenamed("word", "lemma"), "lemma", "left_anti")
    return out


def _dictionaries(lemmas, synonyms, stops) -> tuple[dict, dict, set] | None:
    """The lexicons as dictionaries; None if one is a function, has more than BROADCAST_ROWS rows, or a form twice."""
    out: list[dict] = []
    for lexicon, names in ((lemmas, ("form", "lemma")), (synonyms, ("form", "canonical")), (stops, ("word", "word"))):
        if lexicon is not None and not isinstance(lexicon, DataFrame):
            return None
        rows = [] if lexicon is None else lexicon.select(*[F.col(c).alias(x) for c, x in zip(names, "ab")]).where("a is not null").limit(BROADCAST_ROWS + 1).collect()
        out.append({r.a: r.b for r in rows})
        if len(rows) > BROADCAST_ROWS or len(out[-1]) < len(rows) and names[0] == "form":
            return None
    return out[0], out[1], set(out[2])


def _rewritten(batches: Iterator[pa.RecordBatch], lemmas: dict, synonyms: dict, stops: set) -> Iterator[pa.RecordBatch]:
    """(doc_id, normalized, stopwords) of rows (doc_id, words); each distinct word of a batch is looked up once."""
    for b in batches:
        lists = b.column(1)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        found = [x if (x := lemmas.get(w)) is not None else w for w in words]
        canonical = pa.array([x if (x := synonyms.get(lemma)) is not None else lemma for lemma in found], pa.string()).take(coded.indices)
        stop = np.array([lemma in stops or w in stops for w, lemma in zip(words, found)], dtype=np.int64)
        at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        before = np.concatenate(([0], np.cumsum(stop[coded.indices.to_numpy()]))) if len(words) else np.zeros(1, dtype=np.int64)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), canonical), " ")
        yield pa.RecordBatch.from_arrays([b.column(0), joined, pa.array(before[at[1:]] - before[at[:-1]], pa.int64())], names=["doc_id", "normalized", "stopwords"])


def normalized_text(docs: DataFrame, lemmas=None, synonyms=None, stops=None) -> DataFrame:
    """(doc_id, normalized, stopwords): canonical words in order joined by blanks, stop words kept, and how many they are."""
    tables = _dictionaries(lemmas, synonyms, stops)
    if tables is not None:
        shared = docs.sparkSession.sparkContext.broadcast(tables)
        known = F.when(F.col("doc_id").isNull(), F.array().cast("array<string>")).otherwise(tokenize(F.col("text")))  # as in a join, no words for a null id
        return docs.select("doc_id", known.alias("words")).mapInArrow(lambda b: _rewritten(b, *shared.value), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, normalized string, stopwords long")
    n = normalize(exploded(docs), lemmas, synonyms, stops)
    words = n.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "canonical"))), lambda x: x["canonical"]), " ").alias("normalized"), F.count_if("is_stopword").alias("stopwords"))
    return docs.select("doc_id").join(words, "doc_id", "left").select("doc_id", F.coalesce("normalized", F.lit("")).alias("normalized"), F.coalesce("stopwords", F.lit(0)).alias("stopwords"))


def doc_terms(tokens: DataFrame, mode: str, lemmas=None, synonyms=None, stops=None) -> DataFrame:
    """(doc_id, pos, term) in one of MODES; stop words go except in raw mode."""
    mode = str(mode).strip().lower()
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {', '.join(MODES)}")
    if mode == "raw":
        return tokens
    kept = without_stops(tokens, lemmas, synonyms, stops)
    if mode == "stem":
        return kept.join(stems(kept), "term").select("doc_id", "pos", F.col("stem").alias("term"))
    return kept.select("doc_id", "pos", F.col(mode).alias("term"))

import pytest
from pyspark.sql import functions as F

from loomtext.functions import text as X
from loomtext.functions import vectors as V
from loomtext.operators.lexicon import stem


def one(spark, make, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_tokenize(spark):
    assert one(spark, X.tokenize, "web-сайт don’t x--y -a- Ёлка 12 a1b", None, "", "  \x1c", "123 !?") == [["web", "сайт", "don’t", "x", "y", "a", "ёлка", "a", "b"], [], [], [], []]


def test_sentences(spark):
    assert one(spark, X.sentences, "One. Two!Three?  Four…\nFive", None, "  ") == [["One.", "Two!Three?", "Four…", "Five"], [], []]


def test_white_space_and_snippet(spark):
    assert one(spark, X.squeeze, " a \x1c b\t\n", None) == ["a b", ""]
    assert one(spark, X.snippet, "x" * 160, "x" * 161, "y" * 158 + " zz z") == ["x" * 160, "x" * 159 + "…", "y" * 158 + "…"]


def test_labels_and_delimiters(spark):
    assert one(spark, X.label, " Neautral ", "﻿POS", "other", None) == ["neutral", "positive", "", ""]
    assert one(spark, X.delimiter, "a,b;c", "a\tb,c", "a;b;c,d", "abc") == [",", "\t", ";", ","]


def test_topic_and_pad(spark):
    assert one(spark, X.topic_of, "sport_01.txt", "a_b_01.txt", "plain.txt") == ["sport", "a", "plain"]
    assert one(spark, lambda c: X.topic_of(c, last=True), "a_b_01.txt") == ["a_b"]
    got = spark.range(1).select(X.pad(F.array(F.lit(3), F.lit(4)), 4).alias("a"), X.pad(F.array(F.lit(3), F.lit(4)), 1).alias("b")).first()
    assert got.a == [3, 4, 0, 0] and got.b == [3]


@pytest.mark.parametrize("word, want", [("книги", "книг"), ("красивая", "красив"), ("читал", "чита"), ("радость", "радост"), ("hello", "hello"), ("", ""), (None, "")])
def test_stem(word, want):
    assert stem(word) == want


def test_vectors(spark):
    rows = spark.sql("SELECT array(3D, 4D) a, array(0D, 0D) z, array(double('nan'), 1D) n")
    r = rows.select(V.norm(F.col("a")).alias("norm"), V.cosine(F.col("a"), F.col("a")).alias("c"), V.cosine(F.col("a"), F.col("z")).alias("zero"), V.unit(F.col("a")).alias("u"), V.degenerate(F.col("z")).alias("dz"), V.degenerate(F.col("n")).alias("dn"), V.degenerate(F.col("a")).alias("da")).first()
    assert r.norm == 5 and abs(r.c - 1) < 1e-12 and r.zero == 0 and r.u == [0.6, 0.8] and r.dz and r.dn and not r.da

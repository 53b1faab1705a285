"""Corpus readers: labelled review files, text files, lines and lexicons."""

from __future__ import annotations

import csv
import io
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import text as X


def decode(raw: bytes) -> str:
    """UTF-8 with or without a mark, then cp1251, then UTF-8 with replacement."""
    for encoding in ("utf-8-sig", "utf-8", "cp1251"):
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for p, raw in zip(b.column(0).to_pylist(), b.column(1)):
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.string()), pa.array([decode(raw.as_py() or b"")], pa.string())], names=["path", "content"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the files as their quotes have them, some thousand at a time; a field may have any length."""
    csv.field_size_limit((1 << 31) - 1)
    for b in batches:
        for p, d, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            rows = enumerate(csv.reader(io.StringIO(content.as_py(), newline=""), delimiter=d))
            while some := list(itertools.islice(rows, 4096)):
                n = len(some)
                yield pa.RecordBatch.from_arrays([pa.array([p] * n, pa.string()), pa.array([d] * n, pa.string()), pa.array([i for i, _ in some], pa.int64()), pa.array([c for _, c in some], pa.list_(pa.string()))], names=["path", "delimiter", "row_id", "cells"])


def load_corpus(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, row_id, label, text) of every review file at ``path``; files are read in parallel, one task each.

    Encoding, delimiter, header and the columns' order are found for each file; rows without a
    known label or a text go. A large file whose format is known goes through ``read_reviews``.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    texts = files.mapInArrow(_decoded, "path string, content string").select("path", X.delimiter(X.first_line(F.col("content"))).alias("delimiter"), "content")
    rows = texts.mapInArrow(_cells, "path string, delimiter string, row_id long, cells array<string>")
    rows = rows.where(F.exists("cells", lambda c: X.strip(c) != "")).withColumn("header", X.is_header(F.col("cells"))).persist()
    heads = rows.where("header").groupBy("path").agg(F.min("row_id").alias("head"), F.min_by(X.orientation(F.col("cells")), "row_id").alias("order"))
    placed = rows.join(heads, "path", "left").where("head is null or row_id != head").withColumn("cells", X.split_row(F.col("cells"), F.col("delimiter"))).where(F.size("cells") >= 2)
    sentiment_first = F.coalesce((F.col("order") == "sentiment_first") & (F.col("row_id") > F.col("head")), F.lit(False))
    out = placed.select("path", "row_id", X.review_of(F.col("cells"), sentiment_first).alias("r")).select("path", "row_id", "r.label", "r.text").where("label != '' and text != ''")
    if not out.limit(1).count():
        raise ValueError(f"no labelled rows in {path}")
    return out


def read_reviews(spark: SparkSession, path: str, label: str = "label", text: str = "text", delimiter: str = ",", **options) -> DataFrame:
    """(label, text) of files with a header whose format is known: Spark's own reader, which splits large files."""
    rows = spark.read.options(header=True, sep=delimiter, quote='"', escape='"', **options).csv(path)
    return rows.select(X.label(F.col(label)).alias("label"), X.squeeze(F.col(text)).alias("text")).where("label != '' and text != ''")


def write_seed_sample(corpus: DataFrame, path: str, n: int) -> DataFrame:
    """A sample of ``n`` rows, as many of each label as can be, written as one CSV with a header (label, text)."""
    from loomtext.operators.sampling import quota

    rows = quota(corpus, n, row="doc_id" if "doc_id" in corpus.columns else "row_id").select("label", "text")
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"')  # n rows
    return rows


def load_text_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source, text), one row per non-empty file, in the paths' order; ValueError if none is left."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("source"), X.strip(F.regexp_replace("value", "^\ufeff", "")).alias("text"))
    t = t.where("text <> ''")
    if not t.limit(1).count():
        raise ValueError(f"no text in {path}")
    return t.orderBy("path").select("source", "text")


def load_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source, text), one row per non-blank line."""
    t = spark.read.text(path).select(F.col("_metadata.file_name").alias("source"), F.explode(X.lines(F.col("value"))).alias("text"))
    return t


def load_reviews(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Texts of a labelled corpus, in file order; at most ``limit`` if it is positive."""
    rows = load_corpus(spark, path).select("path", "row_id", "text")
    return (rows.orderBy("path", "row_id").limit(limit) if limit and limit > 0 else rows).select("text")


def stop_words(spark: SparkSession, path: str) -> DataFrame:
    """(word): lines of the file, without blank ones and comments."""
    w = spark.read.text(path).select(F.lower(X.strip(F.col("value"))).alias("word"))
    return w.where("word <> '' and not startswith(word, '#')").distinct()


def synonyms(spark: SparkSession, path: str) -> DataFrame:
    """(form, canonical) of a JSON object {canonical: [form, ...]}."""
    m = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    pairs = m.select(F.explode("m").alias("canonical", "forms")).select("canonical", F.explode("forms").alias("form"))
    return pairs.select(F.lower("form").alias("form"), F.lower("canonical").alias("canonical")).groupBy("form").agg(F.max("canonical").alias("canonical"))

"""Multinomial naive Bayes over DataFrames: unsmoothed priors, additive smoothing of terms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class NaiveBayes:
    """prior (label, prior_log), cond (label, term, cond_log) of counted terms, base (label, base_log) of a term the label never has."""

    prior: DataFrame
    cond: DataFrame
    base: DataFrame
    terms: DataFrame
    alpha: float


def fit(docs: DataFrame, tokens: DataFrame, alpha: float = 1.0) -> NaiveBayes:
    """docs (doc_id, label); tokens (doc_id, term). The zero cells of the grid share one value per label and aren't stored."""
    if not alpha > 0:
        raise ValueError("alpha must be positive")
    per = docs.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n").alias("all"))
    prior = per.join(F.broadcast(total)).select("label", F.log(F.col("n") / F.col("all")).alias("prior_log"))  # one row is broadcast
    counts = tokens.join(docs, "doc_id").groupBy("label", "term").agg(F.count(F.lit(1)).alias("c"))
    terms = counts.select("term").distinct()
    size = terms.agg(F.count(F.lit(1)).alias("v"))
    sums = docs.select("label").distinct().join(counts.groupBy("label").agg(F.sum("c").alias("t")), "label", "left").join(F.broadcast(size))
    sums = sums.select("label", (F.coalesce("t", F.lit(0)) + F.lit(alpha) * F.col("v")).alias("d"))
    cond = counts.join(F.broadcast(sums), "label").select("label", "term", F.log((F.col("c") + alpha) / F.col("d")).alias("cond_log"))  # one row per label
    return NaiveBayes(prior, cond, sums.select("label", F.log(F.lit(alpha) / F.col("d")).alias("base_log")), terms, alpha)


def log_proba(model: NaiveBayes, docs: DataFrame, tokens: DataFrame) -> DataFrame:
    """(doc_id, label, logp) for every document and label; unknown terms add nothing."""
    labels = model.prior.join(model.base, "label")
    known = tokens.join(model.terms, "term")
    n = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    lift = known.join(model.cond, "term").join(F.broadcast(model.base), "label").groupBy("doc_id", "label").agg(F.sum(F.col("cond_log") - F.col("base_log")).alias("lift"))
    grid = docs.select("doc_id").join(n, "doc_id", "left").join(F.broadcast(labels))  # one row per label
    return grid.join(lift, ["doc_id", "label"], "left").select("doc_id", "label", (F.col("prior_log") + F.coalesce("n", F.lit(0)) * F.col("base_log") + F.coalesce("lift", F.lit(0.0))).alias("logp"))


def proba(logp: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id")
    e = logp.withColumn("e", F.exp(F.col("logp") - F.max("logp").over(w)))
    return e.select("doc_id", "label", (F.col("e") / F.sum("e").over(w)).alias("p"))


def predict(logp: DataFrame) -> DataFrame:
    """The label with the highest value; ties go to the first in order.

    One aggregate, so that each value is computed once: sums taken anew in another order may differ in the last digits.
    """
    return logp.groupBy("doc_id").agg(F.min(F.struct((-F.col("logp")).alias("least"), "label")).getField("label").alias("predicted"))

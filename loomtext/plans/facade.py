"""Analyzers: whole pipelines behind fit, save, load and query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.operators import bayes, lexicon, sampling, terms
from loomtext.plans.analyzers import DocVecAnalyzer, NeuralAnalyzer, SemanticAnalyzer, as_documents
from loomtext.sources import corpus as files
from loomtext.sources import models

__all__ = ["DocVecAnalyzer", "NeuralAnalyzer", "SemanticAnalyzer", "SentimentAnalyzer"]


class SentimentAnalyzer:
    """Naive Bayes over canonical tokens, three labels."""

    LABELS = {"negative", "neutral", "positive"}

    def __init__(self, lemmas=None, synonyms=None, stops=None):
        self.lexicons, self.model, self.report = (lemmas, synonyms, stops), None, None

    @classmethod
    def open(cls, spark: SparkSession, path: str, corpus: DataFrame | None = None, lemmas=None, synonyms=None, stops=None) -> SentimentAnalyzer:
        """The model saved at ``path``; where there is none, one trained on ``corpus`` and saved there."""
        found = cls(lemmas, synonyms, stops)
        if models.exists(spark, path):
            return found.load(spark, path)
        if corpus is None:
            raise ValueError(f"{path}: no model, and no corpus to train one on")
        found.train(corpus)
        found.save(path)
        return found

    @property
    def is_fitted(self) -> bool:
        return self.model is not None

    def __repr__(self) -> str:
        return f"SentimentAnalyzer(fitted={self.is_fitted}, report={self.report})"

    def _tokens(self, docs: DataFrame) -> DataFrame:
        return lexicon.doc_terms(lexicon.exploded(docs), "canonical", *self.lexicons).select("doc_id", "term")

    def train(self, corpus: DataFrame, alpha: float = 1.0, test_size: float = 0.2, min_df: int = 1, limit: int | None = None) -> dict:
        """corpus (doc_id, label, text). Returns accuracy, n_train and n_test."""
        rows = sampling.quota(corpus, limit) if limit else corpus
        found = {r[0] for r in rows.select("label").distinct().limit(4).collect()}
        if found != self.LABELS:
            raise ValueError(f"labels must be {sorted(self.LABELS)}, not {sorted(map(str, found))}")
        split = sampling.stratified_split(rows, test_size).persist()
        train = split.where(~F.col("is_test")).select("doc_id", "label", "text")
        n_train, n_all = train.count(), split.count()
        tokens = self._tokens(train).persist()
        kept = terms.document_frequency(terms.term_frequency(tokens)).where(F.col("df") >= max(1, min(min_df, n_train // 10)))
        self.model = bayes.fit(train.select("doc_id", "label"), tokens.join(kept, "term", "left_semi"), alpha)
        judged = split.where("is_test") if n_all > n_train else train
        hits = judged.join(bayes.predict(bayes.log_proba(self.model, judged, self._tokens(judged))), "doc_id")
        self.report = {"accuracy": hits.agg(F.avg((F.col("label") == F.col("predicted")).cast("double"))).first()[0] or 0.0, "n_train": n_train, "n_test": n_all - n_train}
        return self.report

    def analyze(self, docs: DataFrame) -> DataFrame:
        """(doc_id, label, probabilities); a document without tokens is neutral, with no probabilities."""
        if self.model is None:
            raise RuntimeError("the analyzer isn't trained")
        tokens = self._tokens(docs)
        logp = bayes.log_proba(self.model, docs, tokens)
        probs = bayes.proba(logp).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "p")))).alias("probabilities"))
        some = tokens.select("doc_id").distinct().withColumn("has", F.lit(True))
        out = docs.select("doc_id").join(some, "doc_id", "left").join(bayes.predict(logp), "doc_id").join(probs, "doc_id")
        empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
        return out.select("doc_id", F.when(F.col("has"), F.col("predicted")).otherwise("neutral").alias("label"), F.when(F.col("has"), F.col("probabilities")).otherwise(empty).alias("probabilities"))

    def analyze_text(self, text: str | None, spark: SparkSession) -> tuple[str, dict[str, float]]:
        """Label and probabilities of one text; neutral and none if it has no token."""
        row = self.analyze(as_documents(spark, [text])).first()
        return row.label, dict(row.probabilities)

    def analyze_file(self, spark: SparkSession, path: str) -> DataFrame:
        """(source, label, probabilities) of each text file at ``path``."""
        docs = files.load_text_files(spark, path).withColumn("doc_id", F.xxhash64("source", "text")).persist()
        return docs.select("doc_id", "source").join(self.analyze(docs), "doc_id").drop("doc_id")

    def save(self, path: str) -> None:
        if self.model is None:
            raise RuntimeError("the analyzer isn't trained")
        m = self.model
        models.save(path, {"prior": m.prior, "cond": m.cond, "base": m.base, "terms": m.terms}, kind="naive-bayes", alpha=m.alpha)

    def load(self, spark: SparkSession, path: str) -> SentimentAnalyzer:
        t, meta = models.load(spark, path, "naive-bayes")
        self.model = bayes.NaiveBayes(t["prior"], t["cond"], t["base"], t["terms"], meta["alpha"])
        return self

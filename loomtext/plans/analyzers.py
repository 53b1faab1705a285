"""Analyzers of a document collection: topics, document vectors, networks, behind one interface.

fit, query, similar, word and document vectors, save and load. Documents are a DataFrame
(doc_id, text[, source][, label]) or an iterable of texts, numbered from 0. Queries may be one text
or a DataFrame (doc_id, text); matches are rows (query_id, rank, index, score, text, source).
Empty, unknown or degenerate queries have no matches.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions.text import snippet, topic_of
from loomtext.functions.vectors import TINY
from loomtext.operators import lexicon, lsa, neural, search, terms, wordvec
from loomtext.sources import models

MATCH = "query_id long, rank int, index long, score double, text string, source string"


def as_text(value) -> str:
    """None is the empty text, a list of tokens its words joined by blanks."""
    if value is None:
        return ""
    return " ".join(map(str, value)) if isinstance(value, (list, tuple)) else str(value)


def as_documents(spark: SparkSession, texts, sources: Iterable | None = None, labels: Iterable | None = None) -> DataFrame:
    """(doc_id, text, source[, label]) of a DataFrame, one text, or an iterable of texts; ValueError for none, or if the numbers of sources or labels differ."""
    if isinstance(texts, DataFrame):
        return texts if "source" in texts.columns else texts.withColumn("source", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")))
    if texts is None:
        raise ValueError("texts must not be None")
    rows = [texts] if isinstance(texts, str) else [as_text(t) for t in texts]
    if not rows:
        raise ValueError("there are no texts")
    names = [f"doc_{i}" for i in range(len(rows))] if sources is None else ["" if s is None else str(s) for s in ([sources] if isinstance(sources, str) else sources)]
    marks = None if labels is None else [str(x) for x in labels]
    if len(names) != len(rows) or marks is not None and len(marks) != len(rows):
        raise ValueError(f"{len(rows)} texts need as many sources and labels")
    if marks is None:
        return spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(zip(rows, names))], "doc_id long, text string, source string")
    return spark.createDataFrame([(i, t, s, x) for i, (t, s, x) in enumerate(zip(rows, names, marks))], "doc_id long, text string, source string, label string")


def as_token(word) -> str:
    """A word as the vocabulary has it; ValueError for None."""
    if word is None:
        raise ValueError("a word must not be None")
    return str(word)


class Analyzer:
    """What the three analyzers share. ``model_dir``: a saved model is loaded from there, and ``fit`` saves there."""

    kind = ""

    def __init__(self, spark: SparkSession, lemmas=None, synonyms=None, stops=None, mode: str = "canonical", model_dir: str | None = None):
        self.spark, self.lexicons, self.mode, self.model_dir = spark, (lemmas, synonyms, stops), mode, model_dir
        self.load_error: str | None = None
        self._reset()
        if model_dir and models.exists(spark, model_dir):
            try:
                self._adopt(model_dir)
            except (ValueError, KeyError) as e:
                self._reset()
                self.load_error = str(e)

    @classmethod
    def load(cls, spark: SparkSession, path: str, **options) -> Analyzer:
        """The model saved at ``path``; ValueError if there is none of this kind."""
        if not models.exists(spark, path):
            raise ValueError(f"{path}: no model")
        found = cls(spark, **options)
        found._adopt(path)
        return found

    def _reset(self) -> None:
        self.documents = self._vectors = self.model = None
        self.n_docs = self.n_features = self.dim = 0

    @property
    def is_fitted(self) -> bool:
        return self.documents is not None

    def _require_fitted(self) -> None:
        if not self.is_fitted:
            raise RuntimeError("the analyzer isn't fitted" + (f": {self.load_error}" if self.load_error else ""))

    def __repr__(self) -> str:
        return f"{type(self).__name__}(fitted={self.is_fitted}, n_docs={self.n_docs}, n_features={self.n_features}, dim={self.dim})"

    def _tokens(self, docs: DataFrame) -> DataFrame:
        return lexicon.doc_terms(lexicon.exploded(docs), self.mode, *self.lexicons)

    def _words(self, docs: DataFrame) -> DataFrame:
        """(doc_id, words) of every document, in order."""
        words = self._tokens(docs).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("words"))
        return docs.select("doc_id").join(words, "doc_id", "left").select("doc_id", F.coalesce("words", F.array().cast("array<string>")).alias("words"))

    def _fold(self, docs: DataFrame) -> DataFrame:
        """(doc_id, vec) of new documents; none or zeros where no word is known."""
        raise NotImplementedError

    def vectors(self, docs: DataFrame) -> DataFrame:
        self._require_fitted()
        return self._fold(docs)

    def _search(self, queries: DataFrame, top_n, exclude_self: bool) -> DataFrame:
        """queries (query_id, vec)."""
        some = queries.where(F.col("vec").isNotNull()).where(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)) > TINY)
        found = search.search(some, self._vectors.select(F.col("doc_id").alias("id"), "vec"), top_n, exclude_self=exclude_self)
        named = self.documents.select(F.col("doc_id").alias("id"), snippet(F.col("text")).alias("text"), "source")
        return found.join(named, "id").select("query_id", "rank", F.col("id").alias("index"), "score", "text", "source")

    def query(self, queries, top_n=None) -> DataFrame:
        """The nearest documents of a text, or of each row of a DataFrame (doc_id, text)."""
        self._require_fitted()
        return self._search(self._fold(as_documents(self.spark, queries)).select(F.col("doc_id").alias("query_id"), "vec"), top_n, False)

    def similar(self, text_or_index, top_n=None, exclude_self: bool = True) -> DataFrame:
        """The documents nearest to one of the collection (its id) or to a text; itself, or the first document of that very text, is left out."""
        self._require_fitted()
        none = self.spark.createDataFrame([], MATCH)
        if isinstance(text_or_index, bool):
            return none
        if isinstance(text_or_index, (int, np.integer)):
            own = self._vectors.where(F.col("doc_id") == int(text_or_index)).select(F.col("doc_id").alias("query_id"), "vec")
            return self._search(own, top_n, exclude_self)
        if not isinstance(text_or_index, str):
            return none
        twin = search.twin(self.documents, text_or_index).first()[0] if exclude_self else None
        vec = self._fold(as_documents(self.spark, text_or_index)).select(F.lit(-1 if twin is None else twin).cast("long").alias("query_id"), "vec")
        return self._search(vec, top_n, twin is not None)

    def doc_vector(self, text_or_index) -> list[float]:
        """Vector of a document of the collection (IndexError if its id is unknown), or of a text (zeros if no word is known)."""
        self._require_fitted()
        if isinstance(text_or_index, bool) or not isinstance(text_or_index, (int, np.integer, str)):
            raise IndexError(f"no document {text_or_index!r}")
        if isinstance(text_or_index, str):
            row = self._fold(as_documents(self.spark, text_or_index)).first()
            return [0.0] * self.dim if row is None or row.vec is None else list(row.vec)
        rows = self._vectors.where(F.col("doc_id") == int(text_or_index)).select("vec").limit(1).collect()
        if not rows and not self.documents.where(F.col("doc_id") == int(text_or_index)).limit(1).count():
            raise IndexError(f"no document {text_or_index}")
        return list(rows[0].vec) if rows else [0.0] * self.dim

    def sources(self) -> DataFrame:
        self._require_fitted()
        return self.documents.select("doc_id", "source")

    def _saved(self, documents: DataFrame) -> None:
        self.documents = documents
        self.load_error = None
        if self.model_dir:
            self.save(self.model_dir)


class SemanticAnalyzer(Analyzer):
    """TF-IDF and latent topics."""

    kind = "latent-topics"

    def fit(self, docs, k: int = 10, min_df: int = 1, max_df: float = 1.0, sublinear: bool = False, smooth: bool = True, sources=None) -> SemanticAnalyzer:
        docs = as_documents(self.spark, docs, sources)
        n = docs.count()
        if n < 2 or isinstance(k, bool) or k < 1:
            raise ValueError("at least two documents and one topic are needed")
        tf = terms.term_frequency(self._tokens(docs)).persist()
        kept = terms.pruned(terms.document_frequency(tf), n, min_df, max_df)
        if kept.limit(2).count() < 2:
            raise ValueError("at least two terms are needed")
        self.idf = terms.idf(kept, n, smooth).join(terms.indexed(kept), "term").select("term", "df", "idf", "idx").persist()
        self.sublinear, self.n_docs, self.n_features = sublinear, n, self.idf.count()
        weights = terms.tfidf(tf, self.idf, sublinear).join(self.idf.select("term", "idx"), "term").select("doc_id", "idx", "weight")
        self.model = lsa.fit(weights, k)
        self.k = self.dim = self.model.k
        self._vectors = docs.select("doc_id").join(self.model.documents, "doc_id", "left")
        self._saved(docs)
        return self

    def _fold(self, docs: DataFrame) -> DataFrame:
        weights = terms.tfidf(terms.term_frequency(self._tokens(docs)), self.idf, self.sublinear).join(self.idf.select("term", "idx"), "term")
        return lsa.fold_in(weights.select("doc_id", "idx", "weight"), self.model.loadings, self.model.k)

    def topics(self, n_terms=None) -> DataFrame:
        """(topic, rank, term, loading): each topic's terms of largest loading, by size."""
        self._require_fitted()
        return lsa.topics(self.model, self.idf, search.top_n_of(n_terms))

    def topic_weights(self, text) -> dict[int, float]:
        """Coordinate of the text in each topic, {} if no term is known."""
        row = self.vectors(as_documents(self.spark, as_text(text))).first()
        return {} if row is None else dict(enumerate(row.vec))

    def main_topics(self, text, n: int = 5) -> list[tuple[int, float]]:
        """The topics of largest weight by size."""
        return sorted(self.topic_weights(text).items(), key=lambda x: (-abs(x[1]), x[0]))[:n]

    def scatter(self) -> DataFrame:
        """(doc_id, x, y, source): the documents on the first two topics."""
        self._require_fitted()
        return self.documents.select("doc_id", "source").join(self._vectors.select("doc_id", F.get("vec", 0).alias("x"), F.get("vec", 1).alias("y")), "doc_id")

    def save(self, path: str) -> None:
        self._require_fitted()
        tables = {"idf": self.idf, "sigma": self.model.sigma, "loadings": self.model.loadings, "vectors": self._vectors.select("doc_id", "vec"), "documents": self.documents.select("doc_id", "text", "source")}
        models.save(path, tables, kind=self.kind, k=self.k, sublinear=self.sublinear, mode=self.mode, n_docs=self.n_docs, n_features=self.n_features)

    def _adopt(self, path: str) -> None:
        t, meta = models.load(self.spark, path, self.kind)
        self.idf, self._vectors, self.documents = t["idf"], t["vectors"], t["documents"]
        self.model = lsa.Lsa(t["sigma"], t["loadings"], t["vectors"], meta["k"])
        self.k = self.dim = meta["k"]
        self.sublinear, self.mode, self.n_docs, self.n_features = meta["sublinear"], meta["mode"], meta["n_docs"], meta["n_features"]


class DocVecAnalyzer(Analyzer):
    """Vectors of words and documents by negative sampling: method doc2vec (documents inferred) or word2vec (documents are means of words)."""

    kind = "vectors"

    def __init__(self, spark: SparkSession, method: str = "doc2vec", **options):
        if method not in ("doc2vec", "word2vec"):
            raise ValueError(f"method must be doc2vec or word2vec, not {method!r}")
        self.method = method
        super().__init__(spark, **options)

    def fit(self, docs, dim: int = 100, epochs: int | None = None, window: int = 5, negative: int = 5, min_count: int = 1, sources=None, seed: int = 42, **more) -> dict:
        """Returns what was learnt: n_docs, n_features, dim, epochs, negative, method."""
        docs = as_documents(self.spark, docs, sources)
        words = self._words(docs).persist()
        kind = "document" if self.method == "doc2vec" else "word"
        self.model = wordvec.fit(words, kind, dim, window, min_count, (10 if kind == "document" else 5) if epochs is None else epochs, negative, seed=seed, **more)
        self._vectors = self._folded(words).persist()
        self.n_docs, self.n_features, self.dim = docs.count(), len(self.model.vocabulary), self.model.dim
        self._saved(docs)
        return {"n_docs": self.n_docs, "n_features": self.n_features, "dim": self.dim, "epochs": self.model.epochs, "negative": self.model.negative, "method": self.method}

    def _folded(self, words: DataFrame) -> DataFrame:
        return (wordvec.inferred if self.method == "doc2vec" else wordvec.mean_pooled)(self.model, words)

    def _fold(self, docs: DataFrame) -> DataFrame:
        return self._folded(self._words(docs))

    def most_similar(self, word, top_n=None) -> list[tuple[str, float]]:
        self._require_fitted()
        return [] if word is None else wordvec.most_similar(self.model, as_token(word), search.top_n_of(top_n))

    def analogy(self, a: str, b: str, c: str, top_n: int = 3) -> list[tuple[str, float]]:
        """The words nearest to a - b + c."""
        self._require_fitted()
        return wordvec.analogy(self.model, a, b, c, top_n)

    def word_vector(self, word) -> np.ndarray | None:
        self._require_fitted()
        return self.model.word_vector(None if word is None else as_token(word))

    def save(self, path: str) -> None:
        self._require_fitted()
        m = self.model
        tables = {"words": wordvec.to_table(m, self.spark), "vectors": self._vectors.select("doc_id", "vec"), "documents": self.documents.select("doc_id", "text", "source")}
        params = {"kind": m.kind, "window": m.window, "negative": m.negative, "epochs": m.epochs, "alpha": m.alpha, "min_alpha": m.min_alpha, "seed": m.seed}
        models.save(path, tables, kind=self.kind, method=self.method, params=params, mode=self.mode, n_docs=self.n_docs)

    def _adopt(self, path: str) -> None:
        t, meta = models.load(self.spark, path, self.kind)
        if meta["method"] != self.method:
            raise ValueError(f"{path}: a model of method {meta['method']}")
        self.model = wordvec.from_table(t["words"], **meta["params"])
        self._vectors, self.documents, self.mode = t["vectors"], t["documents"], meta["mode"]
        self.n_docs, self.n_features, self.dim = meta["n_docs"], len(self.model.vocabulary), self.model.dim


class NeuralAnalyzer(Analyzer):
    """A network (cnn or gru) that tells labels; its last layer but one gives document vectors."""

    kind = "network"

    def __init__(self, spark: SparkSession, method: str = "cnn", **options):
        if method not in ("cnn", "gru"):
            raise ValueError(f"method must be cnn or gru, not {method!r}")
        self.method = method
        super().__init__(spark, **options)

    def fit(self, docs, labels=None, sources=None, bound: int = neural.SAMPLE_BOUND, **params) -> dict:
        """Labels default to the topic before the underscore of each source. Returns n_docs, n_features, n_classes, accuracy (on the training rows) and the last loss."""
        docs = as_documents(self.spark, docs, sources, labels)
        docs = docs if "label" in docs.columns else docs.withColumn("label", topic_of(F.col("source")))
        words = self._words(docs).persist()
        self.model = neural.train(self.method, *neural.sample(words.join(docs.select("doc_id", "label"), "doc_id").where("label is not null"), bound), **params)
        self._vectors = self._folded(words).persist()
        self.n_docs = docs.count()
        self._sized()
        self._saved(docs)
        return {"n_docs": self.n_docs, "n_features": self.n_features, "n_classes": self.n_classes, "accuracy": self.model.accuracy, "loss": self.model.losses[-1] if self.model.losses else math.nan}

    def _sized(self) -> None:
        self.n_features, self.n_classes, self.dim = len(self.model.vocabulary), len(self.model.labels), self.model.weights["out"].shape[0]

    def _folded(self, words: DataFrame) -> DataFrame:
        return neural.score(self.model, words).select("doc_id", "vec")

    def _fold(self, docs: DataFrame) -> DataFrame:
        return self._folded(self._words(docs))

    def predict_all(self, docs: DataFrame) -> DataFrame:
        """(doc_id, label, probabilities): label null where no word is known; probabilities in the labels' order."""
        self._require_fitted()
        return neural.score(self.model, self._words(docs)).select("doc_id", "label", "probabilities")

    def predict(self, text_or_index) -> dict[str, float]:
        """Probability of each label for a text or a document of the collection; ValueError where there is none or no word is known."""
        self._require_fitted()
        if isinstance(text_or_index, bool) or not isinstance(text_or_index, (int, np.integer, str)):
            raise ValueError(f"no document {text_or_index!r}")
        docs = as_documents(self.spark, text_or_index) if isinstance(text_or_index, str) else self.documents.where(F.col("doc_id") == int(text_or_index))
        row = self.predict_all(docs).first()
        if row is None or row.label is None:
            raise ValueError(f"no known word in {text_or_index!r}")
        return dict(zip(self.model.labels, row.probabilities))

    def word_vector(self, word) -> np.ndarray | None:
        """The word's row of the first layer."""
        self._require_fitted()
        at = self.model.vocabulary.get(None if word is None else as_token(word))
        return None if at is None else self.model.weights["emb"][at].copy()

    def most_similar(self, word, top_n=None) -> list[tuple[str, float]]:
        """The words of highest cosine in the first layer, itself left out; [] for an unknown word."""
        v, n = self.word_vector(word), search.top_n_of(top_n)
        if v is None or n <= 0:
            return []
        names = list(self.model.vocabulary)
        matrix = self.model.weights["emb"][[self.model.vocabulary[w] for w in names]]
        size = np.linalg.norm(matrix, axis=1) * np.linalg.norm(v)
        score = np.where(size > TINY, matrix @ v / np.maximum(size, TINY), 0.0)
        order = [i for i in np.argsort(-score, kind="stable") if names[i] != str(word)][:n]
        return [(names[i], float(score[i])) for i in order]

    def save(self, path: str) -> None:
        """The weights, vocabulary and documents; document vectors are computed anew on loading."""
        self._require_fitted()
        m = self.model
        weights = self.spark.createDataFrame([(k, list(v.shape), v.ravel().tolist()) for k, v in m.weights.items()], "name string, shape array<int>, data array<double>")
        words = self.spark.createDataFrame(list(m.vocabulary.items()), "term string, idx long")
        models.save(path, {"weights": weights, "words": words, "documents": self.documents.select("doc_id", "text", "source", "label")}, kind=self.kind, method=self.method, labels=m.labels, max_len=m.max_len, losses=m.losses, accuracy=m.accuracy, mode=self.mode, n_docs=self.n_docs)

    def _adopt(self, path: str) -> None:
        t, meta = models.load(self.spark, path, self.kind)
        if meta["method"] != self.method:
            raise ValueError(f"{path}: a network of kind {meta['method']}")
        weights = {r.name: np.array(r.data).reshape(r.shape) for r in t["weights"].collect()}
        vocabulary = {r.term: r.idx for r in t["words"].orderBy("idx").collect()}
        self.model = neural.Network(self.method, vocabulary, meta["labels"], weights, meta["max_len"], meta["losses"], meta["accuracy"])
        self.documents, self.mode, self.n_docs = t["documents"], meta["mode"], meta["n_docs"]
        self._vectors = self._fold(self.documents)
        self._sized()

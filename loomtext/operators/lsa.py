"""Latent semantic analysis: truncated SVD of the document-term rows.

Distributed: computeSVD works on the rows where they are; only the k topics' loadings (terms x k)
come to the driver. Signs are fixed so that each topic's largest loading is positive.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.mllib.linalg import SparseVector, VectorUDT
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from loomtext.operators.terms import BROADCAST_TERMS


@dataclass
class Lsa:
    """sigma (topic, sigma), loadings (topic, idx, loading), documents (doc_id, vec)."""

    sigma: DataFrame
    loadings: DataFrame
    documents: DataFrame
    k: int


def fit(weights: DataFrame, k: int) -> Lsa:
    """weights (doc_id, idx, weight), idx dense from 0. Singular values under 1e-7 of the first count as none."""
    spark = weights.sparkSession
    weights = weights.persist()
    n, size = as_matrix(weights)
    rows = weights.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "weight"))).alias("w"))
    k = max(1, min(k, min(n, size) - 1))
    # the solver passes over the rows once for each of its steps: they are kept as the JVM's vectors, else Python's would be decoded each time
    pairs = rows.select(F.transform("w", lambda x: x["idx"]).alias("i"), F.transform("w", lambda x: x["weight"]).alias("x"))
    kept = spark.createDataFrame(pairs.rdd.map(lambda r: (SparseVector(size, r[0], r[1]),)), StructType([StructField("v", VectorUDT())]), verifySchema=False).persist(StorageLevel.MEMORY_AND_DISK)
    svd = RowMatrix(kept.coalesce(spark.sparkContext.defaultParallelism), n, size).computeSVD(k, rCond=1e-12)
    sigma, v = np.array(svd.s.toArray()), svd.V.toArray()
    kept.unpersist()
    keep = sigma > 1e-7 * sigma[0]
    sigma, v = np.pad(sigma[keep], (0, k - int(keep.sum()))), np.pad(v[:, keep], ((0, 0), (0, k - int(keep.sum()))))
    v = v * np.where(v[np.abs(v).argmax(axis=0), range(k)] < 0, -1.0, 1.0)
    table = pa.table({"topic": np.repeat(np.arange(k, dtype=np.int32), size), "idx": np.tile(np.arange(size), k), "loading": v.T.ravel()})
    load = spark.createDataFrame(table)
    return Lsa(spark.createDataFrame([(t, float(s)) for t, s in enumerate(sigma)], "topic int, sigma double"), load, fold_in(weights, load, k), k)


def fold_in(weights: DataFrame, loadings: DataFrame, k: int) -> DataFrame:
    """(doc_id, vec): the rows' products with the topics."""
    vectors = loadings.groupBy("idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("topic", "loading"))), lambda s: s["loading"]).alias("l"))
    few = loadings.count() <= BROADCAST_TERMS * k
    parts = weights.join(F.broadcast(vectors) if few else vectors, "idx")
    sums = parts.groupBy("doc_id").agg(*[F.sum(F.col("weight") * F.col("l")[t]).alias(f"t{t}") for t in range(k)])
    return sums.select("doc_id", F.array(*[f"t{t}" for t in range(k)]).alias("vec"))


def topics(model: Lsa, terms: DataFrame, n: int = 10) -> DataFrame:
    """(topic, rank, term, loading): each topic's n terms of largest loading by size; terms has term and idx."""
    order = Window.partitionBy("topic").orderBy(F.desc(F.abs("loading")), "idx")
    top = model.loadings.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return top.join(terms.select("term", "idx"), "idx").select("topic", "rank", "term", "loading")


def as_matrix(weights: DataFrame) -> tuple[int, int]:
    """(documents, terms) of the rows (doc_id, idx, weight); ValueError if there are none, or one isn't a number."""
    size = weights.agg(F.countDistinct("doc_id"), F.max("idx"), F.count_if(F.isnan("weight") | F.col("weight").isNull())).first()
    if not size[0] or size[1] is None or size[2]:
        raise ValueError("a matrix needs rows, and numbers in them")
    return int(size[0]), int(size[1]) + 1

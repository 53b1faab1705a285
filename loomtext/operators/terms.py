"""Vocabulary, document frequency and TF-IDF over (doc_id, term) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.text import tokenize

#: Terms are broadcast up to this number (some 60 bytes each), else joined by shuffle.
BROADCAST_TERMS = 500_000


def vocabulary(tokens: DataFrame) -> DataFrame:
    """(term, cnt), most frequent first, then by term."""
    return tokens.groupBy("term").agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), "term")


def term_frequency(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf) of documents (doc_id, text).

    Texts are dealt by doc_id before they become words: these and what is summed by doc_id later need no other shuffle.
    """
    dealt = docs.select("doc_id", "text").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    return term_frequency(dealt.select("doc_id", F.explode(tokenize(F.col("text"))).alias("term")))


def document_frequency(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def pruned(df: DataFrame, n_docs: int, min_df: int = 1, max_df: float = 1.0) -> DataFrame:
    if isinstance(min_df, bool) or min_df < 1 or isinstance(max_df, bool) or not 0 < max_df <= 1:
        raise ValueError("min_df must be at least 1 and max_df in (0, 1]")
    return df.where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * n_docs))


def indexed(terms: DataFrame, first: int = 0, also: tuple[str, ...] = ()) -> DataFrame:
    """Terms with a dense index in code-point order, without one task holding them all; ``also`` names columns that stay.

    Terms are range-partitioned and sorted; each partition's size gives the next one's offset.
    """
    cut = terms.select("term", *also).repartitionByRange(max(1, terms.sparkSession.sparkContext.defaultParallelism), "term").sortWithinPartitions("term")
    # kept, since offsets and ranks must come of one and the same partitioning
    numbered = cut.withColumn("p", F.spark_partition_id()).withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy("term"))).persist()
    sizes = numbered.groupBy("p").agg(F.max("r").alias("size"))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    earlier = sizes.select("p", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("skip"))
    return numbered.join(F.broadcast(earlier), "p").select("term", *also, (F.col("skip") + F.col("r") - 1 + first).cast("long").alias("idx"))


def idf(df: DataFrame, n_docs: int, smooth: bool = True) -> DataFrame:
    n = F.lit(float(n_docs))
    value = F.log((1 + n) / (1 + F.col("df"))) + 1 if smooth else F.log(n / F.col("df")) + 1
    return df.withColumn("idf", value)


def tfidf(tf: DataFrame, idfs: DataFrame, sublinear: bool = False, l2: bool = True, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, term, weight), and the columns of ``idfs`` that ``also`` names."""
    kept = idfs.select("term", "idf", *also).persist()
    kept = F.broadcast(kept) if kept.count() <= BROADCAST_TERMS else kept
    w = tf.join(kept, "term").select("doc_id", "term", *also, ((1 + F.log("tf") if sublinear else F.col("tf")) * F.col("idf")).alias("weight"))
    if not l2:
        return w
    size = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("doc_id")))
    return w.withColumn("size", size).select("doc_id", "term", *also, F.when(F.col("size") > 0, F.col("weight") / F.col("size")).otherwise(F.col("weight")).alias("weight"))

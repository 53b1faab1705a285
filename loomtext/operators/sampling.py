"""Stratified split, quota samples and first rows, by ranks that SQL can reproduce."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _rank(seed: int, row: str) -> F.Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(row).cast("string")))


def stratified_split(rows: DataFrame, test_size: float = 0.2, seed: int = 42, row: str = "doc_id") -> DataFrame:
    """rows (row, label) with is_test: per label round-half-even(n * test_size), 1 to n - 1 where there are two."""
    if not 0 <= test_size < 1:
        raise ValueError("test_size must be in [0, 1)")
    n = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    want = F.bround(F.col("n") * F.lit(test_size)).cast("long")
    want = F.when((F.lit(test_size) > 0) & (F.col("n") > 1), F.greatest(F.lit(1), F.least(want, F.col("n") - 1))).otherwise(F.least(want, F.greatest(F.lit(0), F.col("n") - 1)))
    order = F.row_number().over(Window.partitionBy("label").orderBy(_rank(seed, row), row))
    return rows.join(F.broadcast(n), "label").withColumn("is_test", order <= want).drop("n")  # one row per label


def quota(rows: DataFrame, n: int, seed: int | None = None, row: str = "doc_id") -> DataFrame:
    """n rows over all labels alike: n // c each, one more for the first n % c labels; in file order, or shuffled by seed."""
    labels = rows.select("label").distinct().withColumn("i", F.row_number().over(Window.orderBy("label")) - 1)  # one row per label
    c = labels.agg(F.count(F.lit(1)).alias("c"))
    per = labels.join(F.broadcast(c)).select("label", (F.floor(F.lit(n) / F.col("c")) + (F.col("i") < F.lit(n) % F.col("c")).cast("int")).alias("q"))
    order = Window.partitionBy("label").orderBy(*([_rank(seed, row)] if seed is not None else []), row)
    return rows.join(F.broadcast(per), "label").withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.col("q")).drop("r", "q")


def first_per_label(rows: DataFrame, n: int = 1, row: str = "doc_id") -> DataFrame:
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(row))).where(F.col("r") <= n).drop("r")

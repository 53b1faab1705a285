"""Model directories: Parquet tables beside a meta.json of version 1."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

VERSION = 1


def save(path: str, tables: dict[str, DataFrame], **meta) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
        spark = df.sparkSession
    spark.createDataFrame([(json.dumps({"version": VERSION, "tables": sorted(tables), **meta}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta.json")


def load(spark: SparkSession, path: str, kind: str) -> tuple[dict[str, DataFrame], dict]:
    meta = json.loads(spark.read.text(f"{path}/meta.json").first()[0])
    if meta.get("version") != VERSION or meta.get("kind") != kind:
        raise ValueError(f"{path}: not a {kind} model of version {VERSION}")
    return {t: spark.read.parquet(f"{path}/{t}.parquet") for t in meta["tables"]}, meta


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a model directory is at ``path``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/meta.json")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)

"""Resumable work: fingerprints of inputs and settings, and the pages still to do."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 3


def file_key(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 20)


def fingerprint(path: Column, size: Column, mtime_us: Column, settings: dict) -> Column:
    """A digest that changes with the file, its size or time, the settings, or this format's version."""
    text = json.dumps(settings, ensure_ascii=False, sort_keys=True)
    return F.sha2(F.concat_ws("\n", path, size.cast("string"), mtime_us.cast("string"), F.lit(text), F.lit(str(VERSION))), 256)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder; a failing storage is an error, not an absence."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The state kept under path; an empty one before the first run."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def page_name(index: Column) -> Column:
    """The name of a page's entry in a state: page_000001 and so on, from the 0-based index."""
    return F.format_string("page_%06d", index)


def pending(pages: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Pages that the state table has not; keys hold the fingerprint, so stale state counts as none."""
    return pages.join(state.select(*keys), keys, "left_anti")


def restored(pages: DataFrame, state: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Pages with the state's columns where it has them."""
    kept = state.select(*keys, *[F.col(c).alias(f"_state_{c}") for c in columns], F.lit(True).alias("_held"))
    df = pages.join(kept, keys, "left")
    for c in columns:
        df = df.withColumn(c, F.when(F.col("_held"), F.col(f"_state_{c}")).otherwise(F.col(c)))
    return df.drop("_held", *[f"_state_{c}" for c in columns])

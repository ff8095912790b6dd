"""Readers of provenance documents, and the append that never changes what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MATTER = r"(?s)\A---\n(.*?)\n---\n?(.*)\z"


def front_matter(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """path, the named scalar fields, body of Markdown files with a front matter; files without one are left out."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value"))
    rows = rows.where(F.col("value").rlike(_MATTER)).select("path", F.regexp_extract("value", _MATTER, 1).alias("_m"), F.regexp_extract("value", _MATTER, 2).alias("body"))
    value = lambda f: F.nullif(F.btrim(F.regexp_extract("_m", rf"(?m)^{f}:[ \t]*(.*)$", 1), F.lit(" '\"")), F.lit(""))
    return rows.select("path", *[value(f).alias(f) for f in fields], "body")


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    """path, meta, data (JSON strings) of artifact files; a malformed one has nulls and is told by `ok`."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    meta, data = F.get_json_object("value", "$._meta"), F.get_json_object("value", "$.data")
    return rows.select("path", meta.alias("meta"), data.alias("data"), (meta.isNotNull() & data.isNotNull()).alias("ok"))


def append_sources(new: DataFrame, path: str) -> int:
    """Append sources (id, supersedes, ...) whose ids aren't there yet; returns how many were refused."""
    spark = new.sparkSession
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        known = spark.read.parquet(path).select("id")
        fresh = new.join(known, "id", "left_anti")
    else:
        fresh = new
    fresh = fresh.dropDuplicates(["id"])
    refused = new.count() - fresh.count()
    fresh.write.mode("append").parquet(path)
    return refused

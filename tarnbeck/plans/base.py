"""Registry of queries, and the supplied tables in the operators' shapes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NOW = "2024-02-01 12:00:00"


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def corpus(self) -> DataFrame:
        """documents as id, kind, as_of, body."""
        day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int"))
        return self("documents").select(F.format_string("d%07d", "doc_id").alias("id"), F.col("source").alias("kind"), day.cast("string").alias("as_of"), F.col("text").alias("body"), "doc_id")

    def ticks(self) -> DataFrame:
        return self("events").select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("tick"), "value")

    def years(self) -> DataFrame:
        """symbol (segment), period (year), revenue, cost of all orders."""
        o = self("orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("period"))
        c = self("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("symbol"))
        price = F.col("l_extendedprice").cast("decimal(18,2)")
        lines = self("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (price * (1 - F.col("l_discount").cast("decimal(4,2)"))).alias("rev"), F.col("l_quantity").cast("decimal(18,2)").alias("qty"))
        return lines.join(o, "o_orderkey").join(c, "o_custkey").groupBy("symbol", "period").agg(F.sum("rev").cast("double").alias("revenue"), F.sum("qty").cast("double").alias("quantity"))


def query(name: str, sql: str | None = None):
    def add(run: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: run(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return run

    return add


CORPUS = "corpus AS (SELECT 'd' || lpad(cast(doc_id AS VARCHAR), 7, '0') AS id, source AS kind, cast(date '2024-01-01' + cast(doc_id % 365 AS INTEGER) AS VARCHAR) AS as_of, text AS body, doc_id FROM documents)"
BARS = "bars AS (SELECT event_type AS symbol, cast(ts AS DATE) AS day, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY ALL)"
YEARS = "years AS (SELECT c_mktsegment AS symbol, cast(year(o_orderdate) AS INTEGER) AS period, cast(sum(cast(l_extendedprice AS DECIMAL(18,2)) * (1 - cast(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue, cast(sum(cast(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"

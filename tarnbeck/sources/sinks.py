"""Tables that are replaced as a whole: each write is a new version, and readers take the newest finished one.

A writer that dies leaves a version without its mark of success, which nobody reads. Versions are never changed,
so that one of them is a snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Versions:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """The finished versions, oldest first."""
        if not self._fs.exists(self._at(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(self.path))]
        done = [n for n in names if n.startswith("v") and n[1:].isdigit() and self._fs.exists(self._at(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n[1:]) for n in done)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The named version or the newest; None if there is none."""
        have = self.numbers()
        version = have[-1] if version is None and have else version
        return self.spark.read.parquet(f"{self.path}/v{version:08d}") if version in have else None

    def replace(self, rows: DataFrame) -> int:
        """Write the next version and return its number; of two writers that take the same number, one fails."""
        version = max(self.numbers(), default=0) + 1
        target = f"{self.path}/v{version:08d}"
        # An unfinished version of that number is overwritten, a finished one isn't.
        rows.write.mode("error" if self._fs.exists(self._at(f"{target}/_SUCCESS")) else "overwrite").parquet(target)
        return version

    def upsert(self, rows: DataFrame, key: str, stamp: str) -> int:
        """Replace by the newest row of each key; of equal stamps the new rows win, and among these any one."""
        old = self.read()
        rows = rows.withColumn("_new", F.lit(1))
        both = rows if old is None else rows.unionByName(old.withColumn("_new", F.lit(0)), allowMissingColumns=True)
        w = Window.partitionBy(key).orderBy(F.desc_nulls_last(stamp), F.desc("_new"))
        return self.replace(both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_new"))

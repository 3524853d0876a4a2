"""Writing: partitioned packages, staged swaps guarded by a fingerprint, dry runs, backups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    """Hadoop file system of a path, so the same code runs on local and on shared storage."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_package(books: DataFrame, path: str, by: str = "book_id", apply: bool = True) -> int:
    """One partition for each book; a static overwrite takes stale ones away. Without ``apply`` only the count is returned."""
    n = books.count()
    if apply:
        books.repartition(F.col(by)).write.mode("overwrite").partitionBy(by).parquet(path)
    return n


def write_report(findings: DataFrame, path: str) -> None:
    findings.write.mode("overwrite").json(path)


def swap_in(rows: DataFrame, path: str, fingerprint: str) -> bool:
    """Replace a table by a staged copy; False if it already has the fingerprint.

    The copy is written beside the table and counted first: an empty one is an
    error, and the old table stays until the new one is complete.
    """
    spark = rows.sparkSession
    fs, table = _fs(spark, path)
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_fingerprint-{fingerprint}")
    if fs.exists(mark):
        return False
    staged = f"{path}.staged"
    rows.write.mode("overwrite").parquet(staged)
    if not spark.read.parquet(staged).limit(1).count():
        fs.delete(_fs(spark, staged)[1], True)
        raise ValueError("the staged table is empty")
    old = _fs(spark, f"{path}.old")[1]
    fs.delete(old, True)
    if fs.exists(table):
        fs.rename(table, old)
    fs.rename(_fs(spark, staged)[1], table)
    fs.create(mark).close()
    fs.delete(old, True)
    return True


def backup(spark: SparkSession, path: str, suffix: str) -> str:
    """A copy of a table beside it, before it is overwritten; an existing copy is kept."""
    copy = f"{path}.{suffix}"
    fs, target = _fs(spark, copy)
    if not fs.exists(target):
        spark.read.parquet(path).write.parquet(copy)
    return copy

"""Reading the tables of the training-data operators, with the null rules they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import sent_if_small, spread, table


def chapters(spark: SparkSession, folder: str) -> DataFrame:
    """chapter_id, book_id, title, content of every delivered chapter; rows without an id are no record."""
    return spread(table(spark, folder, "chapters").select("chapter_id", "book_id", "title", "content").where(F.col("chapter_id").isNotNull()))


def elements(chapters: DataFrame, *keep: str) -> DataFrame:
    """One row for each non-null content element: ``keep``, paragraph_index, text."""
    return chapters.select(*keep, F.posexplode("content").alias("paragraph_index", "text")).where(F.col("text").isNotNull())


def one_delivery(chapters: DataFrame) -> DataFrame:
    """chapter_id and content of one row for each chapter_id; where rows differ the least hash of content stays.

    Only keys and hashes are aggregated. Chapters that came more than once are
    few; while their keys are few enough to be sent to all tasks, only their
    texts are shuffled.
    """
    rows = chapters.where("chapter_id is not null").select("chapter_id", "content")
    counted = rows.select("chapter_id", F.xxhash64("content").alias("_h")).groupBy("chapter_id").agg(F.min("_h").alias("_least"), F.count(F.lit(1)).alias("_n"))
    several = sent_if_small(counted.where("_n > 1").select("chapter_id", "_least"))
    held = rows.join(several, "chapter_id").where(F.xxhash64("content") == F.col("_least")).select("chapter_id", "content").dropDuplicates(["chapter_id"])
    return rows.join(several.select("chapter_id"), "chapter_id", "left_anti").unionByName(held)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"))


def site_of(url: Column) -> Column:
    """Host of a URL in lower case, without user and port; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]+)", 1))
    return F.when(host != "", host)

"""The catalogue: books, authors, state tables, and the set operations on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.positions import element_lengths, latest_chapters
from lectern.session import cut_lineage


def distinct_books(books: DataFrame) -> DataFrame:
    """One row for each book_id: of repeats the one loaded last; rows without an id drop. Columns that aren't used are neither read nor shuffled."""
    at = F.coalesce("loaded_at", F.lit("1970-01-01").cast("timestamp"))
    return books.where("book_id is not null").groupBy("book_id").agg(*(F.max_by(c, at).alias(c) for c in books.columns if c != "book_id"))


def title_or_id(rows: DataFrame, titles: DataFrame, key: str, title: str) -> DataFrame:
    """Rows with the title of their key, or the key itself where there is none."""
    return rows.join(titles.select(key, title), key, "left").withColumn(title, F.coalesce(title, key))


def in_directory(works: DataFrame, directory: DataFrame) -> DataFrame:
    """Works (author_id, source_url, …) with their place in the author's directory (author_id, source_url, place), the first of several; null for works it doesn't list."""
    first = directory.groupBy("author_id", "source_url").agg(F.min("place").alias("place"))
    return works.join(first, ["author_id", "source_url"], "left")


def placed(rows: DataFrame, *order: Column) -> DataFrame:
    """Rows numbered from 1 in the given order, which must be total: sorted by ranges, then numbered in each from the counts of those before.

    The ranges are fixed by a checkpoint, since sampled again they may fall
    elsewhere; only one count for each range is gathered.
    """
    ranged = cut_lineage(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    numbered = ranged.withColumn("_k", within).join(F.broadcast(counts.select("_range", "_before")), "_range")
    return numbered.withColumn("place", (F.col("_k") + F.col("_before")).cast("bigint")).drop("_range", "_k", "_before")


def patched(base: DataFrame, patch: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Base rows with the patch's non-null fields; every patch key must be in the base, see ``unknown_keys``."""
    p = patch.select(key, *(F.col(f).alias(f"_{f}") for f in fields))
    out = base.join(p, key, "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce(f"_{f}", f))
    return out.drop(*(f"_{f}" for f in fields))


def unknown_keys(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).select(key).distinct().join(known.select(key), key, "left_anti")


def merged(old: DataFrame, fresh: DataFrame, key: str, size: str) -> DataFrame:
    """Old rows replaced by fresh ones of the same key, unless the old has several parts and the fresh has fewer; other fresh rows are added."""
    columns = [c for c in old.columns if c != key]
    both = old.select(key, F.struct(*columns).alias("o")).join(fresh.select(key, F.struct(*columns).alias("f")), key, "full")
    keep_old = F.col("f").isNull() | (F.col("o").isNotNull() & (F.col(f"o.{size}") > 1) & (F.col(f"f.{size}") < F.col(f"o.{size}")))
    return both.select(key, F.when(keep_old, F.col("o")).otherwise(F.col("f")).alias("x"), F.when(F.col("f").isNull(), "kept").when(F.col("o").isNull(), "added").when(keep_old, "kept").otherwise("replaced").alias("action")).select(key, "x.*", "action")


def toggled(events: DataFrame, key: list[str], at: Column, value: str) -> DataFrame:
    """What is on after all toggles: keys toggled an odd number of times, with the value of the last."""
    state = events.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max_by(value, at).alias(value))
    return state.where("n % 2 = 1").drop("n")


def without(rows: DataFrame, deleted: DataFrame, key: str, *children: DataFrame) -> list[DataFrame]:
    """Rows, and rows of child tables by the same key, after deletion of the keys."""
    gone = deleted.select(key).distinct()
    return [frame.join(gone, key, "left_anti") for frame in (rows, *children)]


def migrated(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Rows of an older shape with the columns they lack, by default expressions; columns they have stay."""
    return rows.withColumns({c: e for c, e in defaults.items() if c not in rows.columns})


def content_digest(content: Column) -> Column:
    return F.sha2(F.coalesce(content, F.lit("")), 256)


def fingerprint(rows: DataFrame, key: str, content: str, *group: str, digested: bool = False) -> DataFrame:
    """Digest of the (key, content or its digest) rows of each group, whatever their order: SHA-256 over the sums of their digests' parts.

    Sums are partial aggregates, so a group of any size is never gathered.
    """
    digest = F.sha2(F.concat_ws("\u0000", key, F.col(content) if digested else content_digest(F.col(content))), 256)
    part = lambda i: F.sum(F.conv(F.substring("_d", 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)")
    sums = rows.select(*group, digest.alias("_d")).groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), *(part(i).alias(f"_{i}") for i in range(5)))
    return sums.select(*group, F.sha2(F.concat_ws(",", "_n", *(F.col(f"_{i}").cast("string") for i in range(5))), 256).alias("fingerprint"))


def catalog_projection(chapters: DataFrame) -> DataFrame:
    """(book_id, chapter_id, paragraph_count, paragraph_character_counts, character_count) of each chapter's newest delivery: a catalogue entry without the body."""
    return latest_chapters(chapters, "book_id", element_lengths().alias("paragraph_character_counts")).select(
        "book_id", "chapter_id", F.size("paragraph_character_counts").alias("paragraph_count"), "paragraph_character_counts",
        F.aggregate("paragraph_character_counts", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("character_count"),
    )


def differing_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one side has, counted with their repeats: side and the columns."""
    a, b = left.exceptAll(right), right.exceptAll(left)
    return reduce(DataFrame.unionByName, [a.withColumn("side", F.lit("left")), b.withColumn("side", F.lit("right"))])

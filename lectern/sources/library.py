"""Reading a library of JSON books, as one file or as a catalogue with a file for each book, into flat tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import trim
from lectern.sources.schemas import LIBRARY

#: Versions of the format that are read.
VERSIONS = (1, 2)


@dataclass
class Library:
    """Flat tables of a library; ``bad_files`` lists what could not be read, which is no failure."""

    authors: DataFrame
    books: DataFrame
    chapters: DataFrame
    footnotes: DataFrame
    sections: DataFrame
    toc: DataFrame
    bad_files: DataFrame


def read_json(spark: SparkSession, *paths: str) -> DataFrame:
    """Raw files with their names; malformed ones have null fields and the text in _corrupt, missing ones are skipped."""
    reader = spark.read.schema(LIBRARY).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True)
    return reader.json(list(paths)).withColumn("file", F.input_file_name())


def _strings(c: str):
    """A list of strings trimmed and without empty ones, as positions count them."""
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), trim), lambda x: x != "")


def flatten(files: DataFrame) -> Library:
    """Tables of raw files. Positions come from posexplode after empty strings are dropped; references out of range drop, and notes left with nothing."""
    good = files.where(F.col("schemaVersion").isin(*VERSIONS) & F.col("_corrupt").isNull())
    bad = files.where(~F.coalesce(F.col("schemaVersion").isin(*VERSIONS), F.lit(False)) | F.col("_corrupt").isNotNull()).select("file", F.coalesce(F.when(F.col("_corrupt").isNotNull(), "malformed"), F.lit("schema version")).alias("reason"))
    authors = good.select(F.explode("authors").alias("a")).select("a.*").dropDuplicates(["id"])
    books = good.select(F.explode("books").alias("b"), "file").select("b.*", "file").where("id is not null and id <> ''")
    chapters = books.select(F.col("id").alias("book_id"), F.posexplode("chapters").alias("chapter_ord", "c")).select("book_id", "chapter_ord", "c.*")
    chapters = chapters.withColumn("content", _strings("content")).withColumnRenamed("id", "chapter_id").withColumn("level", F.greatest(F.lit(1), F.least(F.lit(4), F.coalesce("level", F.lit(1)))))
    lengths = F.transform("content", lambda x: F.length(x))
    valid = lambda r: (r.paragraphIndex >= 0) & (r.paragraphIndex < F.size("lengths")) & (r.start >= 0) & (r.end > r.start) & (r.end <= F.get("lengths", r.paragraphIndex))
    notes = chapters.select("book_id", "chapter_id", lengths.alias("lengths"), F.explode("footnotes").alias("f")).select("book_id", "chapter_id", "lengths", "f.*")
    notes = notes.withColumn("content", _strings("content")).withColumn("references", F.filter(F.coalesce("references", F.array().cast("array<struct<paragraphIndex:int,start:int,end:int>>")), valid))
    notes = notes.where((F.size("content") > 0) | (F.size("references") > 0)).drop("lengths")
    sections = chapters.select("book_id", "chapter_id", F.posexplode("sections").alias("section_ord", "s")).select("book_id", "chapter_id", "section_ord", "s.*")
    toc = books.select(F.col("id").alias("book_id"), F.explode("toc").alias("t")).select("book_id", "t.*")
    return Library(authors, books.drop("chapters", "toc"), chapters.drop("footnotes", "sections"), notes, sections, toc, bad)


def read_library(spark: SparkSession, path: str) -> Library:
    """A library from one JSON file, or from a folder with catalog.json and books/*.json (bodies come from the latter)."""
    single = path.endswith(".json")
    return flatten(read_json(spark, path if single else f"{path}/books/*.json"))


def read_book(spark: SparkSession, folder: str, book_id: str) -> Library:
    """One book by its file name; a missing or malformed file gives empty tables."""
    return flatten(read_json(spark, f"{folder}/books/{book_id}.json"))


def asset_findings(files: DataFrame, catalog_ids: DataFrame) -> DataFrame:
    """(code, location): files and catalogue entries (book_id) that don't match, files with other than one book, names that aren't the id."""
    stem = F.regexp_extract("file", r"([^/]+)\.json$", 1)
    ids = files.select(F.transform(F.coalesce("books", F.array().cast(LIBRARY["books"].dataType)), lambda b: b.id).alias("ids"), stem.alias("stem"))
    flat = ids.select(F.explode("ids").alias("book_id"), "stem")
    say = lambda rows, code, at: rows.select(F.lit(code).alias("code"), F.col(at).alias("location"))
    return (
        say(catalog_ids.join(flat, "book_id", "left_anti"), "MISSING_BOOK_ASSET", "book_id")
        .unionByName(say(flat.join(catalog_ids, "book_id", "left_anti"), "ORPHAN_BOOK_ASSET", "book_id"))
        .unionByName(say(ids.where(F.size("ids") != 1), "BOOK_ASSET_CARDINALITY", "stem"))
        .unionByName(say(flat.where("book_id <> stem"), "BOOK_FILENAME_MISMATCH", "stem"))
    )

"""Guarded repairs: each is bound to what it expects, refuses what has changed, and changes nothing when run again."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digest(content: Column) -> Column:
    return F.sha2(F.array_join(content, "\n"), 256)


def delete_elements(chapters: DataFrame, drop) -> DataFrame:
    """Chapters without the elements for which ``drop(element, index)`` holds; sections and their paragraph_index follow, those of deleted elements go."""
    numbered = F.transform("content", lambda x, i: F.struct(i.alias("i"), x.alias("x"), F.coalesce(drop(x, i), F.lit(False)).alias("d")))
    kept_before = lambda i: F.size(F.filter(F.slice(F.col("_n"), F.lit(1), F.greatest(i, F.lit(0))), lambda e: ~e.d))
    inside = lambda s: (s.paragraph_index >= 0) & (s.paragraph_index < F.size("_n")) & ~F.coalesce(F.get("_n", s.paragraph_index).d, F.lit(True))
    moved = F.transform(F.filter("sections", inside), lambda s: s.withField("paragraph_index", kept_before(s.paragraph_index)))
    return chapters.withColumn("_n", numbered).withColumn("sections", moved).withColumn("content", F.transform(F.filter("_n", lambda e: ~e.d), lambda e: e.x)).drop("_n")


def insert_text(paragraphs: DataFrame, edits: DataFrame, *key: str) -> DataFrame:
    """Texts with pieces inserted (key, at, piece): in the order of their places, of the pieces at one place in that of their text."""
    listed = edits.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("at", "piece"))).alias("_e"))
    step = lambda a, e: F.struct(F.concat(a.done, F.substring(F.col("text"), a.past + 1, e.at - a.past), e.piece).alias("done"), e.at.alias("past"))
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("past"))
    rebuilt = F.aggregate("_e", start, step, lambda a: F.concat(a.done, F.substring(F.col("text"), a.past + 1, F.length("text"))))
    return paragraphs.join(listed, list(key), "left").withColumn("text", F.coalesce(rebuilt, F.col("text"))).drop("_e")


def append_tail(chapters: DataFrame, records: DataFrame) -> DataFrame:
    """Chapters with paragraphs appended by records (chapter_id, expected, tail): only where the digest is the expected one and the tail isn't there."""
    r = records.select("chapter_id", "expected", "tail").dropDuplicates(["chapter_id"])
    there = F.slice("content", F.greatest(F.lit(1), F.size("content") - F.size("tail") + 1), F.size("tail")) == F.col("tail")
    fits = F.coalesce((digest(F.col("content")) == F.col("expected")) & ~there, F.lit(False))
    return chapters.join(r, "chapter_id", "left").withColumn("content", F.when(fits, F.concat("content", "tail")).otherwise(F.col("content"))).drop("expected", "tail")


def replace_payload(rows: DataFrame, records: DataFrame, key: str, field: str) -> tuple[DataFrame, DataFrame]:
    """(rows, refused): a field replaced where its digest is the expected one (key, expected, payload); changed or missing rows refuse."""
    r = records.select(key, "expected", "payload").dropDuplicates([key])
    joined = rows.join(r, key, "left")
    fits = F.coalesce(F.sha2(field, 256) == F.col("expected"), F.lit(False))
    out = joined.withColumn(field, F.when(fits, F.col("payload")).otherwise(F.col(field))).drop("expected", "payload")
    done = F.coalesce(F.col(field) == F.col("payload"), F.lit(False))
    refused = r.join(rows.select(key, field), key, "left").where(~fits & ~done).select(key, F.when(F.col(field).isNull(), "missing").otherwise("changed").alias("reason"))
    return out, refused


def substitute(rows: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Literal substitutions (key, damaged, corrected) with one of four outcomes each: fixed, already, unmatched, missing; and the text after it."""
    joined = records.join(rows.select(key, "text"), key, "left")
    outcome = F.when(F.col("text").isNull(), "missing").when(F.contains("text", F.col("damaged")), "fixed").when(F.contains("text", F.col("corrected")), "already").otherwise("unmatched")
    return joined.select(key, outcome.alias("outcome"), F.replace("text", "damaged", "corrected").alias("text"))


def swap_records(rows: DataFrame, fresh: DataFrame, key: str, expected: str = "expected") -> DataFrame:
    """Whole rows replaced by fresh ones with the digest of the row they expect; other rows stay, unknown fresh ones are no rows."""
    columns = [c for c in rows.columns if c != key]
    f = fresh.select(key, expected, F.struct(*columns).alias("_f"))
    now = F.sha2(F.to_json(F.struct(*columns)), 256)
    joined = rows.withColumn("_now", now).withColumn("_r", F.struct(*columns)).select(key, "_now", "_r").join(f, key, "left")
    return joined.select(key, F.when(F.col("_now") == F.col(expected), F.col("_f")).otherwise(F.col("_r")).alias("x")).select(key, "x.*")


def _diff(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for key, a, b in zip(batch.column("key").to_pylist(), batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a or [], b or [], autojunk=False).get_opcodes():
                if op != "equal":
                    rows.append((key, op, i1, i2, j1, j2))
        columns = list(zip(*rows)) if rows else [()] * 6
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "op", "a_from", "a_to", "b_from", "b_to"])


def line_differences(pairs: DataFrame) -> DataFrame:
    """(key, op, a_from, a_to, b_from, b_to): edits that turn the lines a of a key into the lines b; equal digests are left out before any line is compared."""
    changed = pairs.where(~(digest(F.col("a")).eqNullSafe(digest(F.col("b")))))
    return changed.select("key", "a", "b").mapInArrow(_diff, "key string, op string, a_from int, a_to int, b_from int, b_to int")


def missing_blocks(source: DataFrame, local: DataFrame, key: str, least: int = 80) -> DataFrame:
    """Blocks of a source (key, block) of at least ``least`` characters that the local text (key, text) doesn't hold, white space aside."""
    from lectern.functions.text import compact

    s = source.where(F.length("block") >= least).withColumn("_c", compact(F.col("block")))
    return s.join(local.select(key, compact(F.col("text")).alias("_t")), key, "left").where(~F.coalesce(F.contains("_t", F.col("_c")), F.lit(False))).drop("_c", "_t")

"""The algebra of positions in texts: offsets, progress, remapping, as-of lookups, overlaps. Offsets are code points from 0, ranges half open."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import cut_lineage, sent_if_small




def _fetched(chapters: DataFrame) -> Column:
    epoch = F.lit("1970-01-01").cast("timestamp")
    return F.coalesce("fetched_at", epoch) if "fetched_at" in chapters.columns else epoch


def latest_chapters(chapters: DataFrame, *columns: str | Column) -> DataFrame:
    """One row for each chapter_id: the delivery fetched last, which aggregation finds without a sort; rows without an id drop.

    ``columns`` are names or expressions, all columns if none are given. Each is
    an aggregate of its own, so those that a query doesn't use are neither read
    nor shuffled. What is made of texts belongs into an expression, which the
    scan takes; texts themselves come from ``latest_texts``. Of deliveries of
    one time all columns are from the same one.
    """
    rows = chapters.where("chapter_id is not null")
    if columns:
        rows = rows.select("chapter_id", _fetched(chapters).alias("_at"), *columns)
    else:
        rows = rows.withColumn("_at", _fetched(chapters))
    rest = [c for c in rows.columns if c not in ("chapter_id", "_at")]
    if not rest:
        return rows.select("chapter_id").distinct()
    return rows.groupBy("chapter_id").agg(*(F.max_by(c, "_at").alias(c) for c in rest))


def _place_in_files(rows: DataFrame) -> Column | None:
    """File and row number of each row, if the rows come from files."""
    place = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"))
    try:
        rows.select(place)
    except AnalysisException:
        return None
    return place


def latest_texts(chapters: DataFrame, *columns: str) -> DataFrame:
    """(chapter_id, columns) like ``latest_chapters``, for columns that hold texts.

    Only keys, times and the rows' places in their files are aggregated; of
    chapters that came more than once, which are few, the row at the right place
    stays. While their keys are few enough to be sent to all tasks, no text is
    shuffled, and beyond that texts are shuffled once, by a join. Rows that
    don't come from files have no place: of those of the newest time the one
    with the least hash of its columns stays.
    """
    place = _place_in_files(chapters)
    rows = chapters.where("chapter_id is not null").select("chapter_id", _fetched(chapters).alias("_at"), *columns, *([] if place is None else [place.alias("_place")]))
    if place is not None:
        times = rows.groupBy("chapter_id").agg(F.max_by("_place", F.struct("_at", "_place")).alias("_kept"), F.count(F.lit(1)).alias("_n"))
        several = sent_if_small(times.where("_n > 1").select("chapter_id", "_kept"))
        return rows.join(several, "chapter_id", "left").where("_kept is null or _kept = _place").select("chapter_id", *columns)
    order = Window.partitionBy("chapter_id").orderBy(F.desc("_at"), F.xxhash64(*columns))
    return rows.withColumn("_k", F.row_number().over(order)).where("_k = 1").select("chapter_id", *columns)


def latest_elements(chapters: DataFrame, keep: Callable[[Column], Column], **values: Callable[[Column], Column]) -> DataFrame:
    """(chapter_id, paragraph_index, values) of the non-null elements of each chapter's newest delivery for which ``keep`` holds.

    The functions of an element's text run in the scan, so no text is shuffled.
    """
    found = F.transform("content", lambda x, i: F.when(x.isNotNull() & keep(x), F.struct(i.alias("paragraph_index"), *(f(x).alias(n) for n, f in values.items()))))
    return latest_chapters(chapters, F.filter(found, lambda e: e.isNotNull()).alias("_e")).select("chapter_id", F.inline("_e"))


def element_lengths(content: str = "content", non_empty: bool = False) -> Column:
    """Lengths of the elements, 0 for null ones; with ``non_empty`` of the paragraphs, which are numbered after the empty ones are dropped."""
    whole = F.coalesce(content, F.array().cast("array<string>"))
    return F.transform(F.filter(whole, lambda x: x.isNotNull() & (x != "")) if non_empty else whole, lambda x: F.coalesce(F.length(x), F.lit(0)))


def chapter_length(content: str = "content") -> Column:
    return F.aggregate(element_lengths(content), F.lit(0).cast("bigint"), lambda s, x: s + x)


def chapter_sizes(chapters: DataFrame) -> DataFrame:
    """(chapter_id, book_id, chapter_ord, length) of each chapter's newest delivery."""
    return latest_chapters(chapters, "book_id", "chapter_ord", chapter_length().alias("length"))


def paragraphs(chapters: DataFrame, *keep: str) -> DataFrame:
    """(keep, paragraph_index, text) of the non-empty paragraphs, numbered after the empty ones are dropped."""
    return chapters.select(*keep, F.posexplode(F.filter("content", lambda x: x.isNotNull() & (x != ""))).alias("paragraph_index", "text"))


def paragraph_offsets(chapters: DataFrame) -> DataFrame:
    """(chapter_id, paragraph_index, length, start) of rows with lengths, of which the prefix sums are taken in their array, or with content."""
    lengths = F.col("lengths") if "lengths" in chapters.columns else element_lengths(non_empty=True)
    step = lambda a, x: F.struct((a.past + x).alias("past"), F.array_append(a.starts, a.past).alias("starts"))
    starts = F.aggregate("lengths", F.struct(F.lit(0).cast("bigint").alias("past"), F.array().cast("array<bigint>").alias("starts")), step, lambda a: a.starts)
    return chapters.select("chapter_id", lengths.alias("lengths")).select("chapter_id", F.posexplode(F.arrays_zip("lengths", starts.alias("starts"))).alias("paragraph_index", "e")).select("chapter_id", "paragraph_index", F.col("e.lengths").alias("length"), F.col("e.starts").alias("start"))


#: Chapters of a book, by number, whose prefix sums one task takes.
BUCKET = 512


def chapter_offsets(chapters: DataFrame) -> DataFrame:
    """(book_id, chapter_id, place, length, start, book_length): prefix sums of chapter lengths within each book.

    A book may hold a third of all chapters, so none is sorted whole: sums of
    BUCKET chapters each are added up first, then chapters within each bucket.
    Chapters without a number come last, by id. ``chapters`` has the length or the content.
    """
    length = F.col("length") if "length" in chapters.columns else chapter_length()
    bucket = F.coalesce(F.floor(F.col("chapter_ord") / BUCKET), F.lit(1 << 40)).cast("bigint")
    # numbers of each chapter, used for buckets and for places: written once, so texts are read once
    sized = cut_lineage(chapters.select("book_id", "chapter_id", "chapter_ord", length.alias("length"), bucket.alias("bucket")))
    key = ["book_id", "bucket"]
    earlier = Window.partitionBy("book_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    buckets = sized.groupBy(*key).agg(F.sum("length").alias("sum"), F.count(F.lit(1)).alias("n")).select(
        *key, F.coalesce(F.sum("sum").over(earlier), zero).alias("chars_before"), F.coalesce(F.sum("n").over(earlier), zero).alias("places_before"), F.sum("sum").over(Window.partitionBy("book_id")).alias("book_length")
    )
    w = Window.partitionBy(*key).orderBy(F.asc_nulls_last("chapter_ord"), "chapter_id")
    within = w.rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("place", F.row_number().over(w) - 1).withColumn("start", F.coalesce(F.sum("length").over(within), zero))
    # a chapter without a book has no place in one
    joined = placed.join(buckets, key)
    return joined.select("book_id", "chapter_id", (F.col("place") + F.col("places_before")).cast("int").alias("place"), "length", (F.col("start") + F.col("chars_before")).alias("start"), "book_length")


def part_of(place: Column, sizes: tuple[int, ...]) -> Column:
    """Number, from 1, of the part that holds a place, of parts with the given sizes one after the other; null past the last."""
    past, out = 0, F.lit(None).cast("int")
    bounds = []
    for n, size in enumerate(sizes, 1):
        bounds.append((past := past + size, n))
    for end, n in reversed(bounds):
        out = F.when(place < end, n).otherwise(out)
    return F.when(place >= 0, out)


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(value, low), high)


def kept_indexes(elements: DataFrame, keep: Column, *key: str) -> DataFrame:
    """Index of each kept element after the others are deleted."""
    w = Window.partitionBy(*key).orderBy("paragraph_index").rowsBetween(Window.unboundedPreceding, 0)
    return elements.withColumn("_keep", keep.cast("int")).withColumn("new_index", (F.sum("_keep").over(w) - 1).cast("int")).where("_keep = 1").drop("_keep")


def shifted(ranges: DataFrame, insertions: DataFrame, *place: str) -> DataFrame:
    """Ranges after text was inserted: a start moves with insertions at or before it, an end with those before it.

    ``insertions``: place, at, size; ``ranges``: place and id, range_start, range_end.
    """
    sums = (
        ranges.join(insertions, list(place), "left")
        .groupBy("id", "range_start", "range_end")
        .agg(
            F.coalesce(F.sum(F.when(F.col("at") <= F.col("range_start"), F.col("size"))), F.lit(0)).alias("a"),
            F.coalesce(F.sum(F.when(F.col("at") < F.col("range_end"), F.col("size"))), F.lit(0)).alias("b"),
        )
    )
    return sums.select("id", (F.col("range_start") + F.col("a")).alias("range_start"), (F.col("range_end") + F.col("b")).alias("range_end"))


def as_of(points: DataFrame, marks: DataFrame, key: str, at: str, mark: str, value: str) -> DataFrame:
    """Each point with the value of the last mark at or before it under the same key; null without one.

    Marks of one key are those of one text; they become a sorted array, in which
    each point looks up its own, so points of a hot key are neither sorted nor
    gathered. Of equal marks the one with the greatest value holds.
    """
    listed = marks.where(F.col(mark).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(mark).alias("m"), F.col(value).alias("v")))).alias("_marks"))
    before = F.filter("_marks", lambda m: m.m <= F.col(at))
    return points.join(listed, key, "left").withColumn(value, F.try_element_at(before, F.lit(-1)).v).drop("_marks")


def pages(lengths: DataFrame, width: int, *key: str) -> DataFrame:
    """(key, page, page_start, page_end): ranges of at most ``width`` characters of texts with a length."""
    numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("length") - 1) / width).cast("int")))
    return lengths.where("length > 0").select(*key, "length", F.explode(numbers).alias("page")).select(*key, "page", (F.col("page") * width).alias("page_start"), F.least(F.col("length"), (F.col("page") + 1) * width).alias("page_end"))


def overlaps(ranges: DataFrame, others: DataFrame, key: list[str], start: str, end: str, other_start: str, other_end: str) -> DataFrame:
    """Overlapping pairs under one key, clipped: an equi join on the key first, so only ranges of one text meet."""
    hit = (F.col(start) < F.col(other_end)) & (F.col(other_start) < F.col(end))
    return ranges.join(others, key).where(hit).withColumn("clip_start", F.greatest(start, other_start)).withColumn("clip_end", F.least(end, other_end))


def nearest_before(points: DataFrame, marks: DataFrame, key: str, at: str, mark: str, within: int) -> DataFrame:
    """Each point with the greatest mark before it, at most ``within`` away; null without one."""
    found = as_of(points.withColumn("_before", F.col(at) - 1), marks.withColumn("nearest", F.col(mark)), key, "_before", mark, "nearest")
    return found.withColumn("nearest", F.when(F.col(at) - F.col("nearest") <= within, F.col("nearest"))).drop("_before")


def with_parents(chapters: DataFrame) -> DataFrame:
    """(chapter_id, section_id, ord, section_level, parent_id): the last section before with a lesser level, within the array."""
    parent = lambda s, i: F.try_element_at(F.filter(F.slice("sections", F.lit(1), i), lambda p: p.section_level < s.section_level), F.lit(-1)).section_id
    rows = F.transform("sections", lambda s, i: F.struct(s.section_id.alias("section_id"), i.alias("ord"), s.section_level.alias("section_level"), F.when(i > 0, parent(s, i)).alias("parent_id"), s.paragraph_index.alias("paragraph_index"), s.title.alias("title")))
    return chapters.where(F.size("sections") > 0).select("chapter_id", F.inline(rows))

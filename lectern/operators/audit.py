"""Quality rules: each table is read once and every row yields an array of findings (severity, code, location, message)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators.positions import latest_chapters

# What the catalogue allows.
LANGUAGES = ("zh", "en", "de", "fr", "ru")
CATEGORIES = ("著作", "文章", "书信")
RIGHTS = ("PUBLIC_DOMAIN", "CC_BY_SA", "PERMISSION_REQUIRED", "UNKNOWN")
OPEN_RIGHTS = ("PUBLIC_DOMAIN", "CC_BY_SA")
YEAR_TYPES = ("WRITTEN", "PUBLISHED", "TRANSLATION_PUBLICATION", "EDITION", "SOURCE_DATE")
TOC_TYPES = ("VOLUME", "PART", "CHAPTER", "SECTION", "PREFACE", "APPENDIX")
SHORTEST_BODY = 100


def _finding(when: Column, severity: str, code: str, location: Column, message: Column | str = "") -> Column:
    m = F.lit(message) if isinstance(message, str) else message
    return F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), location.alias("location"), F.coalesce(m, F.lit("")).alias("message")))


def _found(rows: DataFrame, *findings: Column) -> DataFrame:
    return rows.select(F.inline(F.filter(F.array(*findings), lambda f: f.isNotNull())))


def _empty(c: str) -> Column:
    return X.trim(F.coalesce(c, F.lit(""))) == ""


def books(books: DataFrame) -> DataFrame:
    """Rules on one book each."""
    at = F.coalesce("book_id", F.lit("?"))
    years = F.regexp_extract_all(F.coalesce("title_zh", F.lit("")), F.lit("(?<![0-9])((?:18|19|20)[0-9]{2})(?![0-9])"), F.lit(1))
    year = F.coalesce("pub_year", F.lit(""))
    good_year = year.rlike(r"^(?:18|19|20)[0-9]{2}(?:\s*[–—-]\s*(?:18|19|20)[0-9]{2})?$")
    return _found(
        books,
        _finding(_empty("book_id"), "ERROR", "MISSING_BOOK_ID", at),
        _finding(_empty("title_zh"), "ERROR", "MISSING_TITLE", at),
        _finding(F.contains(F.coalesce("title_zh", F.lit("")), F.lit("�")), "ERROR", "REPLACEMENT_CHARACTER", at),
        _finding(~F.coalesce("lang_code", F.lit("")).isin(*LANGUAGES), "ERROR", "INVALID_LANGUAGE", at, F.col("lang_code")),
        _finding(~F.coalesce("category", F.lit("")).isin(*CATEGORIES), "ERROR", "INVALID_CATEGORY", at, F.col("category")),
        _finding(~F.coalesce("rights", F.lit("")).isin(*RIGHTS), "ERROR", "INVALID_RIGHTS", at, F.col("rights")),
        _finding(~F.coalesce("source_url", F.lit("")).rlike("^https?://"), "ERROR", "INVALID_SOURCE_URL", at, F.col("source_url")),
        _finding(_empty("source_credit"), "ERROR", "MISSING_SOURCE_CREDIT", at),
        _finding(year == "", "REVIEW", "MISSING_YEAR", at),
        _finding((year != "") & ~good_year, "REVIEW", "INVALID_YEAR_FORMAT", at, year),
        _finding(good_year & (F.size(years) > 0) & ~F.array_contains(years, F.left(year, F.lit(4))), "REVIEW", "TITLE_YEAR_CONFLICT", at, year),
        _finding((F.coalesce("year_type", F.lit("")) != "") & ~F.col("year_type").isin(*YEAR_TYPES), "ERROR", "INVALID_YEAR_TYPE", at, F.col("year_type")),
        _finding(_empty("translator"), "REVIEW", "TRANSLATOR_UNRECORDED", at),
        _finding(_empty("description"), "REVIEW", "DESCRIPTION_MISSING", at),
    )


def chapters(chapters: DataFrame) -> DataFrame:
    """Rules on the newest delivery of each chapter: counts, so a long chapter has one finding for each rule.

    The rules run in the scan, and their findings, not the texts, are reduced to those of the newest delivery.
    """
    at = F.col("chapter_id")
    body = F.array_join("content", "\n")
    content = F.coalesce("content", F.array().cast("array<string>"))
    sections = F.coalesce("sections", F.array().cast("array<struct<section_id:string,title:string,section_level:int,paragraph_index:int>>"))
    nav = F.size(F.filter(content, X.navigation_line))
    compact_title = X.compact(F.col("title"))
    structure = F.size(F.filter(content, lambda x, i: x.rlike("^第[一二三四五六七八九十百0-9]+(?:卷|篇|章|节|部)[\\s　]") & (F.length(x) <= 32) & ((i < 4) | (X.compact(x) == compact_title))))
    empty = F.size(F.filter(content, lambda x: X.trim(F.coalesce(x, F.lit(""))) == ""))
    repeats = F.size(F.filter(content, lambda x, i: (i > 0) & (x == F.get(content, i - 1)) & (x != "")))
    ids = F.transform(sections, lambda s: s.section_id)
    suspicious = F.size(F.filter(sections, lambda s: X.suspicious_title(s.title).isNotNull()))
    damaged = F.size(F.filter(sections, lambda s: F.contains(F.coalesce(s.title, F.lit("")), F.lit("�"))))
    outside = F.size(F.filter(sections, lambda s: (s.paragraph_index < 0) | (s.paragraph_index >= F.size(content))))
    text = lambda c: c.cast("string")
    rules = (
        _finding(_empty("title"), "ERROR", "MISSING_CHAPTER_TITLE", at),
        _finding(F.length(X.trim(F.coalesce("_body", F.lit("")))) < SHORTEST_BODY, "ERROR", "CHAPTER_BODY_TOO_SHORT", at),
        _finding(empty > 0, "ERROR", "EMPTY_PARAGRAPH", at, text(empty)),
        _finding(F.contains("_body", F.lit("�")), "ERROR", "REPLACEMENT_CHARACTER", at, text(F.regexp_count("_body", F.lit(r"\x{FFFD}")))),
        _finding(F.col("_body").rlike("[\\x{E000}-\\x{F8FF}]"), "ERROR", "PRIVATE_USE_CHARACTER", at, text(F.regexp_count("_body", F.lit(r"[\x{E000}-\x{F8FF}]")))),
        _finding(F.col("_body").rlike("(?i)</?[a-z][^>]*>"), "ERROR", "HTML_LEAK", at),
        _finding(nav > 0, "ERROR", "NAVIGATION_LINE", at, text(nav)),
        _finding(structure > 0, "ERROR", "DUPLICATE_STRUCTURE_HEADING", at, text(structure)),
        _finding(repeats > 0, "REVIEW", "CONSECUTIVE_DUPLICATE_PARAGRAPH", at, text(repeats)),
        _finding(F.size(F.array_distinct(ids)) < F.size(ids), "ERROR", "DUPLICATE_SECTION_ID", at),
        _finding(damaged > 0, "ERROR", "REPLACEMENT_CHARACTER", F.concat(at, F.lit("#sections")), text(damaged)),
        _finding(suspicious > 0, "ERROR", "SUSPICIOUS_SECTION_TITLE", at, text(suspicious)),
        _finding(outside > 0, "ERROR", "SECTION_TARGET_OUT_OF_RANGE", at, text(outside)),
    )
    found = F.filter(F.array(*rules), lambda f: f.isNotNull())
    return latest_chapters(chapters.withColumn("_body", body), found.alias("_f")).select(F.inline("_f"))


def footnotes(footnotes: DataFrame, chapters: DataFrame) -> DataFrame:
    """Rules on one footnote each; references are held against the lengths of their chapter's paragraphs."""
    at = F.coalesce("footnote_id", F.lit("?"))
    refs = F.coalesce("refs", F.array().cast("array<struct<paragraph_index:int,start_offset:int,end_offset:int>>"))
    lengths = chapters.select("chapter_id", F.col("lengths").alias("_lengths"))
    f = footnotes.join(lengths, "chapter_id", "left").withColumn("_lengths", F.coalesce("_lengths", F.array().cast("array<int>")))
    inside = lambda r: (r.paragraph_index >= 0) & (r.paragraph_index < F.size("_lengths"))
    off = F.size(F.filter(refs, lambda r: ~inside(r)))
    wrong = F.size(F.filter(refs, lambda r: inside(r) & ((r.start_offset < 0) | (r.end_offset <= r.start_offset) | (r.end_offset > F.get("_lengths", r.paragraph_index)))))
    damaged = F.size(F.filter("content", lambda x: F.contains(F.coalesce(x, F.lit("")), F.lit("�"))))
    found = _found(
        f,
        _finding(_empty("footnote_id"), "ERROR", "MISSING_FOOTNOTE_ID", at),
        _finding(F.size(F.filter(F.coalesce("content", F.array().cast("array<string>")), lambda x: X.trim(F.coalesce(x, F.lit(""))) != "")) == 0, "ERROR", "EMPTY_FOOTNOTE", at),
        _finding(damaged > 0, "ERROR", "REPLACEMENT_CHARACTER", at, damaged.cast("string")),
        _finding(F.size(refs) == 0, "ERROR", "FOOTNOTE_WITHOUT_REFERENCE", at),
        _finding(off > 0, "ERROR", "FOOTNOTE_PARAGRAPH_OUT_OF_RANGE", at, off.cast("string")),
        _finding(wrong > 0, "ERROR", "FOOTNOTE_OFFSET_OUT_OF_RANGE", at, wrong.cast("string")),
    )
    return found.unionByName(repeated(footnotes, "footnote_id", "DUPLICATE_FOOTNOTE_ID"))


def marker_mismatches(footnotes: DataFrame, chapters: DataFrame) -> DataFrame:
    """(footnote_id, paragraph_index, found): references at which the text doesn't read as the marker."""
    refs = footnotes.select("footnote_id", "chapter_id", "marker", F.inline("refs"))
    texts = chapters.select("chapter_id", F.posexplode("content").alias("paragraph_index", "text"))
    at = refs.join(texts, ["chapter_id", "paragraph_index"]).withColumn("found", F.substring("text", F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset")))
    return at.where("found <> marker").select("footnote_id", "paragraph_index", "found")


def repeated(rows: DataFrame, key: str, code: str) -> DataFrame:
    """A finding for each non-empty key that stands more than once."""
    n = rows.where(F.coalesce(key, F.lit("")) != "").groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return n.select(F.lit("ERROR").alias("severity"), F.lit(code).alias("code"), F.col(key).alias("location"), F.col("n").cast("string").alias("message"))


def catalogue(authors: DataFrame, books: DataFrame, chapters: DataFrame) -> DataFrame:
    """Rules between tables: repeated keys, unknown authors, books without chapters, restricted bodies, equal chapters."""
    say = lambda rows, severity, code, at, message="": rows.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.col(at).alias("location"), (F.lit(message) if isinstance(message, str) else message).alias("message"))
    unknown = books.select("book_id", F.explode("author_ids").alias("author_id")).distinct().join(authors, "author_id", "left_anti")
    empty = books.join(chapters, "book_id", "left_anti")
    restricted = books.where(~F.coalesce("rights", F.lit("")).isin(*OPEN_RIGHTS)).join(chapters, "book_id", "left_semi")
    digest = chapters.select("chapter_id", F.sha2(F.array_join("content", "\n"), 256).alias("digest"), F.length(F.array_join("content", "\n")).alias("n")).where("n > 0")
    equal = digest.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("chapter_id").alias("chapter_id")).where("n > 1")
    parts = [
        repeated(authors, "author_id", "DUPLICATE_AUTHOR_ID"),
        repeated(books, "book_id", "DUPLICATE_BOOK_ID"),
        repeated(books, "source_url", "DUPLICATE_SOURCE_URL"),
        repeated(chapters, "chapter_id", "DUPLICATE_CHAPTER_ID_GLOBAL"),
        repeated(chapters.where("book_id is not null").select(F.concat_ws("/", "book_id", F.nullif("chapter_id", F.lit(""))).alias("k"), "chapter_id").where("coalesce(chapter_id, '') <> ''"), "k", "DUPLICATE_CHAPTER_ID_IN_BOOK"),
        say(unknown, "ERROR", "UNKNOWN_AUTHOR", "book_id", F.col("author_id")),
        say(empty, "ERROR", "NO_CHAPTERS", "book_id"),
        say(restricted, "ERROR", "RESTRICTED_RIGHTS_BODY", "book_id"),
        say(equal, "REVIEW", "EXACT_DUPLICATE_CHAPTER", "chapter_id", F.col("n").cast("string")),
    ]
    return reduce(DataFrame.unionByName, parts)


def toc(nodes: DataFrame, chapters: DataFrame) -> DataFrame:
    """Rules on a table of contents (book_id, node_id, parent_id, node_type, chapter_id, paragraph_index): a tree is checked by walking parents until none or a repeat."""
    say = lambda rows, code, message: rows.select(F.lit("ERROR").alias("severity"), F.lit(code).alias("code"), F.col("node_id").alias("location"), message.alias("message"))
    known = nodes.select("book_id", F.col("node_id").alias("parent_id"))
    sizes = chapters.select("chapter_id", F.size("content").alias("_n"))
    targeted = nodes.where("chapter_id is not null").join(sizes, "chapter_id", "left")
    view = f"_lectern_toc_{uuid.uuid4().hex}"
    nodes.select("book_id", "node_id", "parent_id").createOrReplaceTempView(view)
    cycles = nodes.sparkSession.sql(f"""
        WITH RECURSIVE up (book_id, node_id, parent_id, seen, closed) AS (
          SELECT book_id, node_id, parent_id, array(node_id), false FROM {view}
          UNION ALL
          SELECT u.book_id, u.node_id, t.parent_id, array_append(u.seen, t.node_id), array_contains(u.seen, t.node_id)
          FROM up u JOIN {view} t ON t.book_id = u.book_id AND t.node_id = u.parent_id WHERE NOT u.closed)
        SELECT DISTINCT node_id FROM up WHERE closed""")
    parts = [
        repeated(nodes, "node_id", "DUPLICATE_TOC_ID"),
        say(nodes.where("parent_id is not null").join(known, ["book_id", "parent_id"], "left_anti"), "UNKNOWN_TOC_PARENT", F.col("parent_id")),
        say(nodes.where(~F.coalesce("node_type", F.lit("")).isin(*TOC_TYPES)), "INVALID_TOC_TYPE", F.coalesce("node_type", F.lit(""))),
        say(targeted.where("_n is null"), "UNKNOWN_TOC_CHAPTER", F.col("chapter_id")),
        say(targeted.where("paragraph_index < 0 or paragraph_index >= _n"), "TOC_TARGET_OUT_OF_RANGE", F.col("paragraph_index").cast("string")),
        say(cycles, "TOC_PARENT_CYCLE", F.lit("")),
    ]
    return reduce(DataFrame.unionByName, parts)


def ordered(findings: DataFrame, most: int | None = None) -> DataFrame:
    """Errors first, then by code and place; with ``most``, a preview."""
    rows = findings.orderBy(F.col("severity") != "ERROR", "code", "location", "message")
    return rows if most is None else rows.limit(most)


def counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"))

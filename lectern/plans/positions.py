"""Queries of positions: offsets, progress, remaps, as-of joins, overlaps, trees."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators import positions as P
from lectern.operators import reading as R
from lectern.registry import Tables, query
from lectern.session import cut_lineage

CHAPTERS = """
WITH chap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chapter_id ORDER BY fetched_at DESC) AS k FROM chapters WHERE chapter_id IS NOT NULL) WHERE k = 1)
"""
_PARAGRAPHS = CHAPTERS + ", kept AS (SELECT chapter_id, list_filter(content, lambda x: x IS NOT NULL AND x <> '') AS content FROM chap), par AS (SELECT chapter_id, unnest(content) AS text, CAST(generate_subscripts(content, 1) - 1 AS INTEGER) AS paragraph_index FROM kept)"
_OFFSETS = CHAPTERS + """, sized AS (SELECT book_id, chapter_id, chapter_ord, CAST(coalesce(list_sum(list_transform(content, lambda x: coalesce(length(x), 0))), 0) AS BIGINT) AS length FROM chap),
offs AS (SELECT book_id, chapter_id, row_number() OVER w - 1 AS place, length, CAST(coalesce(sum(length) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(sum(length) OVER (PARTITION BY book_id) AS BIGINT) AS book_length
  FROM sized WINDOW w AS (PARTITION BY book_id ORDER BY chapter_ord NULLS LAST, chapter_id))
"""
_SESSIONS = ", once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY received_at, started_at, ended_at, active_millis) AS n FROM reading_sessions WHERE id IS NOT NULL) WHERE n = 1)"


def _chapters(t: Tables, *columns) -> DataFrame:
    return P.latest_chapters(t.chapters, *columns)


def _lengths(t: Tables) -> DataFrame:
    """(chapter_id, lengths) of the non-empty paragraphs of each chapter."""
    return _chapters(t, P.element_lengths(non_empty=True).alias("lengths"))


def _sized(t: Tables) -> DataFrame:
    """(chapter_id, paragraph_index, length) of the non-empty paragraphs."""
    return _lengths(t).select("chapter_id", F.posexplode("lengths").alias("paragraph_index", "length"))


@query("w1_paragraph_offsets", _PARAGRAPHS + "SELECT chapter_id, paragraph_index, CAST(length(text) AS INTEGER) AS length, CAST(coalesce(sum(length(text)) OVER (PARTITION BY chapter_id ORDER BY paragraph_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM par")
def _(t: Tables) -> DataFrame:
    return P.paragraph_offsets(_lengths(t))


@query("w1_chapter_offsets", _OFFSETS + "SELECT book_id, chapter_id, CAST(place AS INTEGER) AS place, length, start, book_length FROM offs")
def _(t: Tables) -> DataFrame:
    return P.chapter_offsets(P.chapter_sizes(t.chapters))


@query(
    "w2_reading_progress",
    _OFFSETS + _SESSIONS + """, pos AS (SELECT id, book_id, end_chapter_id, greatest(coalesce(end_paragraph_index, 0), 0) AS p FROM once),
sizes AS (SELECT chapter_id, list_transform(content, lambda x: coalesce(length(x), 0)) AS ls FROM chap)
SELECT id, CAST(start + coalesce(list_sum(ls[1:least(p, len(ls))]), 0) AS BIGINT) AS position, round(least(1.0, CASE WHEN book_length > 0 THEN (start + coalesce(list_sum(ls[1:least(p, len(ls))]), 0)) / book_length ELSE 0 END), 6) AS fraction
FROM (SELECT id, p, coalesce(o.chapter_id, f.chapter_id) AS chapter_id FROM pos LEFT JOIN offs o ON o.book_id = pos.book_id AND o.chapter_id = pos.end_chapter_id LEFT JOIN offs f ON f.book_id = pos.book_id AND f.place = 0) JOIN offs USING (chapter_id) JOIN sizes USING (chapter_id)""",
)
def _(t: Tables) -> DataFrame:
    """Absolute position and fraction of each session's end; an index past the chapter is clamped to its end, an unknown chapter counts as the book's first one."""
    # the chapters' lengths, used for places in books and in chapters: written once, so texts are read once
    c = cut_lineage(_chapters(t, "book_id", "chapter_ord", P.element_lengths().alias("ls")))
    total = F.aggregate("ls", F.lit(0).cast("bigint"), lambda a, x: a + x)
    offs = cut_lineage(P.chapter_offsets(c.withColumn("length", total)).select("book_id", F.col("chapter_id").alias("end_chapter_id"), "place", "start", "book_length"))
    first = offs.where("place = 0").select("book_id", F.col("end_chapter_id").alias("first_chapter_id"))
    own = offs.select("book_id", "end_chapter_id").withColumn("known", F.lit(True))
    sizes = c.select(F.col("chapter_id").alias("end_chapter_id"), "ls")
    s = R.distinct_sessions(t.reading_sessions).select("id", "book_id", "end_chapter_id", F.greatest(F.coalesce("end_paragraph_index", F.lit(0)), F.lit(0)).alias("p"))
    inside = F.aggregate(F.slice("ls", F.lit(1), F.least(F.col("p"), F.size("ls"))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    ends = s.join(own, ["book_id", "end_chapter_id"], "left").join(first, "book_id", "left").withColumn("end_chapter_id", F.when(F.col("known"), F.col("end_chapter_id")).otherwise(F.col("first_chapter_id"))).select("id", "p", "end_chapter_id")
    at = ends.join(offs, "end_chapter_id").join(sizes, "end_chapter_id").select("id", (F.col("start") + inside).alias("position"), "book_length")
    return at.select("id", "position", F.round(F.least(F.lit(1.0), F.when(F.col("book_length") > 0, F.col("position") / F.col("book_length")).otherwise(0.0)), 6).alias("fraction"))


_NAV = "回目录|上一篇|下一篇"


@query("w4_remap_after_delete", _PARAGRAPHS + f"SELECT chapter_id, paragraph_index, new_index FROM (SELECT chapter_id, paragraph_index, CAST(sum(CASE WHEN regexp_matches(text, '{_NAV}') THEN 0 ELSE 1 END) OVER (PARTITION BY chapter_id ORDER BY paragraph_index) - 1 AS INTEGER) AS new_index, NOT regexp_matches(text, '{_NAV}') AS keep FROM par) WHERE keep")
def _(t: Tables) -> DataFrame:
    """Indexes after the navigation lines are deleted."""
    kept = F.transform(F.filter("content", lambda x: x.isNotNull() & (x != "")), lambda x: ~x.rlike(_NAV))
    flags = _chapters(t, kept.alias("kept")).select("chapter_id", F.posexplode("kept").alias("paragraph_index", "keep"))
    return P.kept_indexes(flags, F.col("keep"), "chapter_id").select("chapter_id", "paragraph_index", "new_index")


@query(
    "w5_shift_after_insert",
    """WITH n AS (SELECT DISTINCT id, chapter_id, paragraph_index, selection_start AS a, selection_end AS b FROM notes WHERE id IS NOT NULL AND selection_start IS NOT NULL AND selection_end IS NOT NULL),
f AS (SELECT DISTINCT footnote_id, chapter_id, marker, unnest(refs) AS r FROM (SELECT DISTINCT footnote_id, chapter_id, marker, refs FROM footnotes)),
i AS (SELECT chapter_id, r.paragraph_index AS paragraph_index, r.start_offset AS spot, length(marker) AS size FROM f WHERE marker IS NOT NULL)
SELECT id, CAST(a + coalesce(sum(size) FILTER (spot <= a), 0) AS BIGINT) AS range_start, CAST(b + coalesce(sum(size) FILTER (spot < b), 0) AS BIGINT) AS range_end FROM n LEFT JOIN i USING (chapter_id, paragraph_index) GROUP BY id, a, b""",
)
def _(t: Tables) -> DataFrame:
    """Selections after the footnote markers are inserted at their references."""
    notes = t.notes.where("id is not null and selection_start is not null and selection_end is not null").select("id", "chapter_id", "paragraph_index", F.col("selection_start").alias("range_start"), F.col("selection_end").alias("range_end")).distinct()
    refs = t.footnotes.where("marker is not null").select("footnote_id", "chapter_id", "marker", "refs").distinct().select("footnote_id", "chapter_id", "marker", F.inline("refs")).distinct()
    inserts = refs.select("chapter_id", "paragraph_index", F.col("start_offset").alias("at"), F.length("marker").cast("bigint").alias("size"))
    return P.shifted(notes, inserts, "chapter_id", "paragraph_index")


_SECTIONS = ", sec AS (SELECT chapter_id, unnest(sections) AS s, generate_subscripts(sections, 1) - 1 AS ord FROM chap), sect AS (SELECT chapter_id, CAST(ord AS INTEGER) AS ord, s.section_id AS section_id, s.title AS title, s.section_level AS section_level, s.paragraph_index AS paragraph_index FROM sec)"


@query("j14_current_section", CHAPTERS + _SECTIONS + _SESSIONS + "SELECT id, (SELECT arg_max(section_id, (paragraph_index, section_id)) FROM sect WHERE sect.chapter_id = o.end_chapter_id AND sect.paragraph_index <= o.end_paragraph_index) AS section_id FROM once o WHERE end_chapter_id IS NOT NULL AND end_paragraph_index IS NOT NULL")
def _(t: Tables) -> DataFrame:
    """The section in which each session ends: looked up in the sections of its chapter."""
    ends = R.distinct_sessions(t.reading_sessions).where("end_chapter_id is not null and end_paragraph_index is not null").select("id", F.col("end_chapter_id").alias("chapter_id"), F.col("end_paragraph_index").alias("p"))
    marks = _chapters(t).select("chapter_id", F.inline("sections")).select("chapter_id", F.col("paragraph_index").alias("at"), "section_id").where("at is not null")
    return P.as_of(ends, marks, "chapter_id", "p", "at", "section_id").select("id", "section_id")


@query("j13_nearest_heading", _PARAGRAPHS + ", h AS (SELECT chapter_id, paragraph_index FROM par WHERE regexp_matches(text, '^[一二三四五六七八九十]+、')), d AS (SELECT chapter_id, paragraph_index FROM par WHERE regexp_matches(text, '^（[一二].*）$')) SELECT chapter_id, paragraph_index, (SELECT max(h.paragraph_index) FROM h WHERE h.chapter_id = d.chapter_id AND h.paragraph_index BETWEEN d.paragraph_index - 8 AND d.paragraph_index - 1) AS nearest FROM d")
def _(t: Tables) -> DataFrame:
    """Date lines with the heading at most 8 paragraphs before them."""
    kinds = F.transform(F.filter("content", lambda x: x.isNotNull() & (x != "")), lambda x: F.when(x.rlike("^[一二三四五六七八九十]+、"), "heading").when(x.rlike("^（[一二][^\n]*）$"), "date"))
    # the kind of each paragraph, used for both sides: written once, so texts are read once
    par = cut_lineage(_chapters(t, kinds.alias("kinds")).select("chapter_id", F.posexplode("kinds").alias("paragraph_index", "kind")).where("kind is not null"))
    heads = par.where("kind = 'heading'").select("chapter_id", F.col("paragraph_index").alias("at"))
    dates = par.where("kind = 'date'").select("chapter_id", "paragraph_index")
    return P.nearest_before(dates, heads, "chapter_id", "paragraph_index", "at", 8)


_PAGES = _PARAGRAPHS + ", pg AS (SELECT chapter_id, paragraph_index, length(text) AS len, unnest(generate_series(0, (length(text) - 1) // 40)) AS page FROM par), pages AS (SELECT chapter_id, paragraph_index, CAST(page AS INTEGER) AS page, CAST(page * 40 AS INTEGER) AS page_start, CAST(least(len, (page + 1) * 40) AS INTEGER) AS page_end FROM pg), n AS (SELECT DISTINCT id, chapter_id, paragraph_index, selection_start, selection_end FROM notes WHERE id IS NOT NULL)"


def _pages(t: Tables) -> DataFrame:
    return P.pages(_sized(t), 40, "chapter_id", "paragraph_index")


def _selections(t: Tables) -> DataFrame:
    return t.notes.where("id is not null").select("id", "chapter_id", "paragraph_index", "selection_start", "selection_end").distinct()


@query("j17_notes_on_pages", _PAGES + "SELECT id, page, greatest(selection_start, page_start) AS clip_start, least(selection_end, page_end) AS clip_end FROM n JOIN pages USING (chapter_id, paragraph_index) WHERE selection_start < page_end AND page_start < selection_end")
def _(t: Tables) -> DataFrame:
    """Selections clipped to the page ranges that they overlap."""
    return P.overlaps(_selections(t), _pages(t), ["chapter_id", "paragraph_index"], "selection_start", "selection_end", "page_start", "page_end").select("id", "page", "clip_start", "clip_end")


@query("j20_page_of_position", _PAGES + "SELECT id, arg_min(page, (CASE WHEN selection_start >= page_start AND selection_start < page_end THEN 1 ELSE 2 END, page)) AS page FROM n JOIN pages USING (chapter_id, paragraph_index) WHERE selection_start IS NOT NULL GROUP BY id")
def _(t: Tables) -> DataFrame:
    """The page that holds a selection's start, else the first one of its paragraph."""
    at = _selections(t).where("selection_start is not null").join(_pages(t), ["chapter_id", "paragraph_index"])
    rank = F.when((F.col("selection_start") >= F.col("page_start")) & (F.col("selection_start") < F.col("page_end")), 1).otherwise(2)
    return at.groupBy("id").agg(F.min_by("page", F.struct(rank, F.col("page"))).alias("page"))


@query("j21_within_one_page", _PAGES + "SELECT id, page FROM n JOIN pages USING (chapter_id, paragraph_index) WHERE selection_start >= page_start AND selection_end <= page_end")
def _(t: Tables) -> DataFrame:
    both = _selections(t).join(_pages(t), ["chapter_id", "paragraph_index"])
    return both.where("selection_start >= page_start and selection_end <= page_end").select("id", "page")


@query("j19_paragraph_notes", CHAPTERS + _SECTIONS + ", f AS (SELECT chapter_id, unnest(refs) AS r FROM (SELECT DISTINCT footnote_id, chapter_id, refs FROM footnotes)), c AS (SELECT chapter_id, r.paragraph_index AS paragraph_index, count(*) AS refs FROM f GROUP BY ALL), s AS (SELECT chapter_id, paragraph_index, count(*) AS sections FROM sect GROUP BY ALL) SELECT chapter_id, paragraph_index, coalesce(refs, 0) AS refs, coalesce(sections, 0) AS sections FROM c FULL JOIN s USING (chapter_id, paragraph_index)")
def _(t: Tables) -> DataFrame:
    place = ["chapter_id", "paragraph_index"]
    refs = t.footnotes.select("footnote_id", "chapter_id", "refs").distinct().select("chapter_id", F.inline("refs")).groupBy(*place).agg(F.count(F.lit(1)).alias("refs"))
    secs = _chapters(t).select("chapter_id", F.inline("sections")).groupBy(*place).agg(F.count(F.lit(1)).alias("sections"))
    zero = F.lit(0).cast("bigint")
    return refs.join(secs, place, "full").select(*place, F.coalesce("refs", zero).alias("refs"), F.coalesce("sections", zero).alias("sections"))


@query("w13_section_parents", CHAPTERS + _SECTIONS + "SELECT chapter_id, section_id, ord, section_level, (SELECT arg_max(p.section_id, p.ord) FROM sect p WHERE p.chapter_id = s.chapter_id AND p.ord < s.ord AND p.section_level < s.section_level) AS parent_id FROM sect s")
def _(t: Tables) -> DataFrame:
    return P.with_parents(_chapters(t)).select("chapter_id", "section_id", "ord", "section_level", "parent_id")


_TREE = CHAPTERS.replace("WITH chap", "WITH RECURSIVE chap") + _SECTIONS + """, edges AS (SELECT chapter_id, section_id, ord, (SELECT arg_max(p.section_id, p.ord) FROM sect p WHERE p.chapter_id = s.chapter_id AND p.ord < s.ord AND p.section_level < s.section_level) AS parent_id FROM sect s),
walk AS (SELECT chapter_id, section_id, [ord] AS path, [section_id] AS ids FROM edges WHERE parent_id IS NULL
  UNION ALL SELECT e.chapter_id, e.section_id, list_append(w.path, e.ord), list_append(w.ids, e.section_id) FROM walk w JOIN edges e ON e.chapter_id = w.chapter_id AND e.parent_id = w.section_id WHERE NOT list_contains(w.ids, e.section_id))
"""


def _walk(t: Tables) -> DataFrame:
    """Paths from the roots by a recursive CTE with a cycle guard."""
    # the view's name is its own, so plans of one session don't read each other's edges
    view = f"_lectern_edges_{uuid.uuid4().hex}"
    P.with_parents(_chapters(t)).select("chapter_id", "section_id", "ord", "parent_id").createOrReplaceTempView(view)
    return t.spark.sql(f"""
        WITH RECURSIVE walk (chapter_id, section_id, path, ids) AS (
          SELECT chapter_id, section_id, array(ord), array(section_id) FROM {view} WHERE parent_id IS NULL
          UNION ALL
          SELECT e.chapter_id, e.section_id, array_append(w.path, e.ord), array_append(w.ids, e.section_id)
          FROM walk w JOIN {view} e ON e.chapter_id = w.chapter_id AND e.parent_id = w.section_id
          WHERE NOT array_contains(w.ids, e.section_id))
        SELECT * FROM walk""")


@query("j15_ancestors", _TREE + "SELECT chapter_id, section_id, CAST(len(ids) AS INTEGER) AS depth, array_to_string(ids, '/') AS trail FROM walk")
def _(t: Tables) -> DataFrame:
    return _walk(t).select("chapter_id", "section_id", F.size("ids").alias("depth"), F.array_join("ids", "/").alias("trail"))


@query("j16_preorder", _TREE + "SELECT chapter_id, section_id, row_number() OVER (PARTITION BY chapter_id ORDER BY path) AS place FROM walk")
def _(t: Tables) -> DataFrame:
    w = Window.partitionBy("chapter_id").orderBy("path")
    return _walk(t).select("chapter_id", "section_id", F.row_number().over(w).cast("bigint").alias("place"))


@query("w14_parts_by_size", _OFFSETS + ", parts(part, first, past) AS (VALUES (1, 0, 3), (2, 3, 8), (3, 8, 16)) SELECT chapter_id, CAST(part AS INTEGER) AS part FROM offs LEFT JOIN parts ON place >= first AND place < past")
def _(t: Tables) -> DataFrame:
    """Parts of 3, 5 and 8 chapters, by their cumulative sizes.

    Chapters past the last part are the appendix, which belongs to no part: theirs is null.
    """
    return P.chapter_offsets(P.chapter_sizes(t.chapters)).select("chapter_id", P.part_of(F.col("place"), (3, 5, 8)).alias("part"))


@query("w15_ordinals", _OFFSETS + "SELECT book_id, chapter_id, 'chapter-' || lpad(CAST(place + 1 AS VARCHAR), 3, '0') AS label FROM offs")
def _(t: Tables) -> DataFrame:
    return P.chapter_offsets(P.chapter_sizes(t.chapters)).select("book_id", "chapter_id", F.format_string("chapter-%03d", F.col("place") + 1).alias("label"))


@query("w19_floor_search", _PARAGRAPHS + ", st AS (SELECT chapter_id, list(s ORDER BY s) AS starts FROM (SELECT chapter_id, coalesce(sum(length(text)) OVER (PARTITION BY chapter_id ORDER BY paragraph_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM par) GROUP BY chapter_id) SELECT chapter_id, CAST(len(list_filter(starts, lambda x: x <= 500)) - 1 AS INTEGER) AS paragraph_index FROM st")
def _(t: Tables) -> DataFrame:
    """The paragraph at character 500 of each chapter: a floor search in its starts."""
    starts = F.aggregate("lengths", F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(0).alias("n")), lambda a, x: F.struct((a.at + x).alias("at"), F.when(a.at <= 500, a.n + 1).otherwise(a.n).alias("n")), lambda a: a.n - 1)
    return _lengths(t).where(F.size("lengths") > 0).select("chapter_id", starts.alias("paragraph_index"))


@query("w16_contexts", _PARAGRAPHS + "SELECT id, right(substr(text, 1, greatest(selection_start, 0)), 32) AS before, substr(text, selection_end + 1, 32) AS after FROM (SELECT DISTINCT id, chapter_id, paragraph_index, selection_start, selection_end FROM notes WHERE id IS NOT NULL) JOIN par USING (chapter_id, paragraph_index)")
def _(t: Tables) -> DataFrame:
    """32 characters on either side of each selection."""
    par = P.paragraphs(P.latest_texts(t.chapters, "content"), "chapter_id")
    at = _selections(t).join(par, ["chapter_id", "paragraph_index"])
    return at.select("id", F.right(F.substring("text", F.lit(1), F.greatest("selection_start", F.lit(0))), F.lit(32)).alias("before"), F.substring("text", F.col("selection_end") + 1, F.lit(32)).alias("after"))


@query("w3_adjacent_repeats", _PARAGRAPHS + "SELECT chapter_id, count(*) AS repeats FROM (SELECT chapter_id, text, lag(text) OVER (PARTITION BY chapter_id ORDER BY paragraph_index) AS prev FROM par) WHERE text = prev GROUP BY chapter_id")
def _(t: Tables) -> DataFrame:
    """Paragraphs equal to the one before, from the array itself: no shuffle of text."""
    kept = F.filter("content", lambda x: x.isNotNull() & (x != ""))
    repeats = F.aggregate(kept, F.struct(F.lit(None).cast("string").alias("prev"), F.lit(0).cast("bigint").alias("n")), lambda a, x: F.struct(x.alias("prev"), F.when(a.prev == x, a.n + 1).otherwise(a.n).alias("n")), lambda a: a.n)
    return _chapters(t, repeats.alias("repeats")).where("repeats > 0")


@query("w9_single_character_runs", _PARAGRAPHS + ", m AS (SELECT chapter_id, paragraph_index, length(text) <= 20 AS short FROM par), g AS (SELECT *, paragraph_index - row_number() OVER (PARTITION BY chapter_id, short ORDER BY paragraph_index) AS island FROM m WHERE short) SELECT chapter_id, min(paragraph_index) AS first_index, max(paragraph_index) AS last_index, count(*) AS size FROM g GROUP BY chapter_id, island HAVING count(*) >= 2")
def _(t: Tables) -> DataFrame:
    """Runs of neighbouring short lines, as gaps and islands."""
    short = _sized(t).where("length <= 20").select("chapter_id", "paragraph_index")
    island = F.col("paragraph_index") - F.row_number().over(Window.partitionBy("chapter_id").orderBy("paragraph_index"))
    runs = short.withColumn("island", island).groupBy("chapter_id", "island").agg(F.min("paragraph_index").alias("first_index"), F.max("paragraph_index").alias("last_index"), F.count(F.lit(1)).alias("size"))
    return runs.where("size >= 2").drop("island")


@query("w8_next_start", CHAPTERS + _SECTIONS + "SELECT chapter_id, section_id, coalesce(lead(paragraph_index) OVER (PARTITION BY chapter_id ORDER BY paragraph_index, ord), len) AS section_end FROM sect JOIN (SELECT chapter_id, CAST(len(content) AS INTEGER) AS len FROM chap) USING (chapter_id)")
def _(t: Tables) -> DataFrame:
    """The end of each section: where the next one begins, else the end of the chapter."""
    c = _chapters(t, F.size("content").alias("len"), "sections").select("chapter_id", "len", F.posexplode("sections").alias("ord", "s"))
    end = F.lead("s.paragraph_index").over(Window.partitionBy("chapter_id").orderBy("s.paragraph_index", "ord"))
    return c.select("chapter_id", F.col("s.section_id").alias("section_id"), F.coalesce(end, F.col("len")).alias("section_end"))

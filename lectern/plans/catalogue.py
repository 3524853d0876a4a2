"""Queries of the catalogue: joins, aggregates, state tables, sets, orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators import catalog as C
from lectern.operators import positions as P
from lectern.operators import reading as R
from lectern.plans.positions import CHAPTERS
from lectern.registry import Tables, query
from lectern.session import cut_lineage

BOOKS = "bk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY loaded_at DESC) AS bn FROM books WHERE book_id IS NOT NULL) WHERE bn = 1)"
_W = "WITH " + BOOKS
_WC = CHAPTERS + ", " + BOOKS
_NOTES = "nt AS (SELECT DISTINCT * FROM notes WHERE id IS NOT NULL)"
_SESS = "once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY received_at, started_at, ended_at, active_millis) AS n FROM reading_sessions WHERE id IS NOT NULL) WHERE n = 1)"


def _books(t: Tables) -> DataFrame:
    return C.distinct_books(t.books)


def _chapters(t: Tables, *columns) -> DataFrame:
    return P.latest_chapters(t.chapters, *columns)


def _notes(t: Tables) -> DataFrame:
    return t.notes.where("id is not null").distinct()


@query("j1_session_titles", f"WITH {BOOKS}, {_SESS} SELECT id, coalesce(title_zh, o.book_id) AS title_zh FROM once o LEFT JOIN bk USING (book_id)")
def _(t: Tables) -> DataFrame:
    return C.title_or_id(R.distinct_sessions(t.reading_sessions).select("id", "book_id"), _books(t), "book_id", "title_zh").select("id", "title_zh")


@query("j1_note_chapter_titles", CHAPTERS + f", {_NOTES} SELECT n.id, coalesce(c.title, n.chapter_id) AS title FROM nt n LEFT JOIN chap c USING (chapter_id)")
def _(t: Tables) -> DataFrame:
    return C.title_or_id(_notes(t).select("id", "chapter_id"), _chapters(t), "chapter_id", "title").select("id", "title")


@query("j2_author_books", _W + ", ex AS (SELECT DISTINCT unnest(author_ids) AS author_id, book_id, title_zh, pub_year FROM bk) SELECT author_id, book_id, row_number() OVER (PARTITION BY author_id ORDER BY nullif(pub_year, '') NULLS LAST, title_zh, book_id) AS place FROM ex JOIN authors USING (author_id)")
def _(t: Tables) -> DataFrame:
    """Membership by explode; years first, undated books after them."""
    ex = _books(t).select(F.explode("author_ids").alias("author_id"), "book_id", "title_zh", F.nullif("pub_year", F.lit("")).alias("y")).distinct().join(t.authors.select("author_id"), "author_id")
    w = Window.partitionBy("author_id").orderBy(F.asc_nulls_last("y"), "title_zh", "book_id")
    return ex.select("author_id", "book_id", F.row_number().over(w).cast("bigint").alias("place"))


@query("j3_first_in_directory", _W + "SELECT source_url, min(book_id) AS book_id, count(*) AS books FROM bk WHERE source_url IS NOT NULL GROUP BY source_url")
def _(t: Tables) -> DataFrame:
    return _books(t).where("source_url is not null").groupBy("source_url").agg(F.min("book_id").alias("book_id"), F.count(F.lit(1)).alias("books"))


@query("j5_kinds_per_chapter", f"WITH {_NOTES} SELECT chapter_id, string_agg(note_kind, chr(31) ORDER BY note_kind) AS kinds FROM (SELECT DISTINCT chapter_id, note_kind FROM nt WHERE note_kind IS NOT NULL) GROUP BY chapter_id")
def _(t: Tables) -> DataFrame:
    """Values of a child table in one cell, separated by U+001F."""
    kinds = _notes(t).where("note_kind is not null").groupBy("chapter_id").agg(F.array_join(F.array_sort(F.collect_set("note_kind")), "\x1f").alias("kinds"))
    return kinds


@query("j6_notes_of_letters", _W + f", {_NOTES} SELECT id FROM nt WHERE book_id IN (SELECT book_id FROM bk WHERE category = '书信') AND chapter_id IN (SELECT chapter_id FROM chapters WHERE len(content) > 5)")
def _(t: Tables) -> DataFrame:
    """A chain of semi joins."""
    return _notes(t).join(_books(t).where("category = '书信'"), "book_id", "left_semi").join(t.chapters.where(F.size("content") > 5), "chapter_id", "left_semi").select("id")


@query("j7_missing_and_orphans", _WC + ", c AS (SELECT DISTINCT book_id FROM chap WHERE book_id IS NOT NULL) SELECT book_id, 'no chapters' AS finding FROM bk WHERE book_id NOT IN (SELECT book_id FROM c) UNION ALL SELECT book_id, 'no book' FROM c WHERE book_id NOT IN (SELECT book_id FROM bk)")
def _(t: Tables) -> DataFrame:
    """Differences in both directions."""
    b, c = _books(t).select("book_id"), _chapters(t).where("book_id is not null").select("book_id").distinct()
    return b.join(c, "book_id", "left_anti").withColumn("finding", F.lit("no chapters")).unionByName(c.join(b, "book_id", "left_anti").withColumn("finding", F.lit("no book")))


@query("j8_unknown_authors", _W + "SELECT DISTINCT a AS author_id FROM (SELECT unnest(author_ids) AS a FROM bk) WHERE a IS NOT NULL AND a NOT IN (SELECT author_id FROM authors)")
def _(t: Tables) -> DataFrame:
    return C.unknown_keys(_books(t).select(F.explode("author_ids").alias("author_id")), t.authors, "author_id")


@query("j9_override_patch", _W + ", p AS (SELECT book_id, min(source_credit) AS t FROM bk WHERE coalesce(translator, '') = '' AND lang_code <> 'zh' AND coalesce(source_credit, '') <> '' GROUP BY book_id) SELECT book_id, coalesce(p.t, translator) AS translator, pub_year FROM bk LEFT JOIN p USING (book_id)")
def _(t: Tables) -> DataFrame:
    """A table of overrides wins field by field."""
    b = _books(t)
    patch = b.where("coalesce(translator, '') = '' and lang_code <> 'zh' and coalesce(source_credit, '') <> ''").groupBy("book_id").agg(F.min("source_credit").alias("translator"))
    return C.patched(b.select("book_id", "translator", "pub_year"), patch, "book_id", ["translator"])


@query("j22_digest_suffixes", _W + "SELECT book_id, substr(sha1(source_url), 1, 10) AS digest FROM bk WHERE source_url IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return _books(t).where("source_url is not null").select("book_id", F.substring(F.sha1("source_url"), 1, 10).alias("digest"))


@query(
    "j23_fresh_merge",
    CHAPTERS + """, o AS (SELECT book_id, count(*) AS chapters, CAST(sum(len(content)) AS BIGINT) AS paragraphs FROM chap WHERE book_id IS NOT NULL AND chapter_level = 1 GROUP BY book_id), f AS (SELECT book_id, count(*) AS chapters, CAST(sum(len(content)) AS BIGINT) AS paragraphs FROM chap WHERE book_id IS NOT NULL AND chapter_level <> 1 GROUP BY book_id)
SELECT book_id, CASE WHEN f.chapters IS NULL OR (o.chapters > 1 AND f.chapters < o.chapters) THEN o.chapters ELSE f.chapters END AS chapters, CASE WHEN f.chapters IS NULL OR (o.chapters > 1 AND f.chapters < o.chapters) THEN o.paragraphs ELSE f.paragraphs END AS paragraphs,
CASE WHEN f.chapters IS NULL THEN 'kept' WHEN o.chapters IS NULL THEN 'added' WHEN o.chapters > 1 AND f.chapters < o.chapters THEN 'kept' ELSE 'replaced' END AS action FROM o FULL JOIN f USING (book_id)""",
)
def _(t: Tables) -> DataFrame:
    """The merge of fresh works into old ones, tried on chapters of the first level against the others."""
    c = _chapters(t, "book_id", "chapter_level", F.size("content").alias("n")).where("book_id is not null")
    sizes = lambda frame: frame.groupBy("book_id").agg(F.count(F.lit(1)).alias("chapters"), F.sum("n").alias("paragraphs"))
    return C.merged(sizes(c.where("chapter_level = 1")), sizes(c.where("chapter_level <> 1")), "book_id", "chapters")


@query("j29_same_range_notes", f"WITH {_NOTES} SELECT a.id, min(b.id) AS first_id FROM nt a JOIN nt b ON a.chapter_id = b.chapter_id AND a.paragraph_index = b.paragraph_index AND a.selection_start = b.selection_start AND a.selection_end = b.selection_end GROUP BY a.id")
def _(t: Tables) -> DataFrame:
    """A note reuses the smallest id at the same range; a minimum over the range, not a self join."""
    w = Window.partitionBy("chapter_id", "paragraph_index", "selection_start", "selection_end")
    n = _notes(t).where("chapter_id is not null and paragraph_index is not null and selection_start is not null and selection_end is not null")
    return n.select("id", F.min("id").over(w).alias("first_id")).distinct()


@query("j30_summary_differences", CHAPTERS + ", s AS (SELECT DISTINCT chapter_id, CAST(len(content) AS INTEGER) AS paragraphs, CAST(list_sum(list_transform(content, lambda x: length(x))) AS BIGINT) AS characters FROM chapters), v AS (SELECT chapter_id, CAST(len(content) AS INTEGER) AS paragraphs, CAST(list_sum(list_transform(content, lambda x: length(x))) AS BIGINT) AS characters FROM chap) SELECT 'left' AS side, * FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM v) UNION ALL SELECT 'right', * FROM (SELECT * FROM v EXCEPT ALL SELECT * FROM s)")
def _(t: Tables) -> DataFrame:
    """Summaries of all deliveries against those of the latest."""
    # numbers of each delivery, compared four ways below: written once, so texts are read once
    sizes = cut_lineage(t.chapters.select("chapter_id", "fetched_at", F.size("content").alias("paragraphs"), P.chapter_length().alias("characters")))
    columns = ["chapter_id", "paragraphs", "characters"]
    return C.differing_rows(sizes.select(*columns).distinct(), P.latest_chapters(sizes).select(*columns))


@query("a2_completed_books", "WITH " + _SESS + ", last AS (SELECT book_id, count(DISTINCT end_chapter_id) AS reached FROM once WHERE end_chapter_id IS NOT NULL GROUP BY book_id), c AS (SELECT book_id, count(DISTINCT chapter_id) AS chapters FROM chapters GROUP BY book_id) SELECT count(*) FILTER (reached >= chapters) AS completed, count(*) AS started FROM last JOIN c USING (book_id)")
def _(t: Tables) -> DataFrame:
    reached = R.distinct_sessions(t.reading_sessions).where("end_chapter_id is not null").groupBy("book_id").agg(F.count_distinct("end_chapter_id").alias("reached"))
    have = t.chapters.groupBy("book_id").agg(F.count_distinct("chapter_id").alias("chapters"))
    return reached.join(have, "book_id").agg(F.count_if(F.col("reached") >= F.col("chapters")).alias("completed"), F.count(F.lit(1)).alias("started"))


@query("a7_hierarchical_counts", CHAPTERS + "SELECT book_id, chapter_id, CAST(sum(len(content)) AS BIGINT) AS paragraphs, CAST(sum(list_sum(list_transform(content, lambda x: length(x)))) AS BIGINT) AS characters FROM chap WHERE book_id IS NOT NULL GROUP BY ROLLUP (book_id, chapter_id)")
def _(t: Tables) -> DataFrame:
    """Chapter, book and library in one rollup, over lengths instead of texts."""
    p = C.catalog_projection(t.chapters).where("book_id is not null")
    return p.rollup("book_id", "chapter_id").agg(F.sum("paragraph_count").alias("paragraphs"), F.sum("character_count").alias("characters"))


@query("a8_category_counts", _W + "SELECT 'category' AS kind, category AS value, count(*) AS books FROM bk GROUP BY category UNION ALL SELECT 'author', a, count(*) FROM (SELECT DISTINCT book_id, unnest(author_ids) AS a FROM bk) GROUP BY a")
def _(t: Tables) -> DataFrame:
    b = _books(t)
    authors = b.select("book_id", F.explode("author_ids").alias("value")).distinct().withColumn("kind", F.lit("author"))
    kinds = b.select("book_id", F.col("category").alias("value"), F.lit("category").alias("kind")).unionByName(authors)
    return kinds.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("books"))


@query("a9_repeated_keys", "SELECT chapter_id, count(*) AS n FROM chapters WHERE coalesce(chapter_id, '') <> '' GROUP BY chapter_id HAVING count(*) > 1")
def _(t: Tables) -> DataFrame:
    return t.chapters.where("coalesce(chapter_id, '') <> ''").groupBy("chapter_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("a10_repeated_texts", "SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def _(t: Tables) -> DataFrame:
    """Groups of equal texts by digest; owners as count and bounds, so no group is gathered in one row."""
    hashed = t.documents.where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))
    return hashed.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("n > 1")


@query("a10_members", "SELECT doc_id, first_doc FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_doc, count(*) OVER (PARTITION BY sha256(text)) AS n FROM documents WHERE text IS NOT NULL) WHERE n > 1")
def _(t: Tables) -> DataFrame:
    """Each repeated document with the first of its group: aggregate, then join by digest."""
    hashed = t.documents.where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))
    groups = hashed.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1").drop("n")
    return hashed.join(groups, "digest").select("doc_id", "first_doc")


@query("a11_keep_first", "SELECT source, doc_id, title FROM (SELECT source, doc_id, title, row_number() OVER (PARTITION BY source ORDER BY added_at, doc_id) AS k FROM documents WHERE source IS NOT NULL) WHERE k = 1")
def _(t: Tables) -> DataFrame:
    """By aggregation, which a hot source can't skew."""
    d = t.documents.where("source is not null")
    return d.groupBy("source").agg(F.min_by(F.struct("doc_id", "title"), F.struct("added_at", "doc_id")).alias("x")).select("source", "x.doc_id", "x.title")


@query("a12_most_chapters", _WC + ", s AS (SELECT book_id, count(*) AS n FROM chap GROUP BY book_id) SELECT title_zh, arg_min(book_id, (-coalesce(n, 0), book_id)) AS book_id, coalesce(max(n), 0) AS chapters FROM bk LEFT JOIN s USING (book_id) GROUP BY title_zh")
def _(t: Tables) -> DataFrame:
    """Of works with one title the one with most chapters, the least id on ties."""
    n = _chapters(t).groupBy("book_id").agg(F.count(F.lit(1)).alias("n"))
    b = _books(t).select("book_id", "title_zh").join(n, "book_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    return b.groupBy("title_zh").agg(F.min_by("book_id", F.struct(-F.col("n"), "book_id")).alias("book_id"), F.max("n").alias("chapters"))


@query("a15_by_url", _W + "SELECT source_url, array_to_string(list_sort(list_distinct(flatten(list(author_ids)))), ',') AS author_ids, min(nullif(pub_year, '')) AS pub_year FROM bk WHERE source_url IS NOT NULL GROUP BY source_url")
def _(t: Tables) -> DataFrame:
    """A set of authors for each URL is no longer than the table of authors."""
    b = _books(t).where("source_url is not null").select("source_url", "pub_year", F.explode_outer("author_ids").alias("author_id"))
    return b.groupBy("source_url").agg(F.array_join(F.array_sort(F.collect_set("author_id")), ",").alias("author_ids"), F.min(F.nullif("pub_year", F.lit(""))).alias("pub_year"))


@query("a18_short_books", _WC + "SELECT book_id, CAST(coalesce(sum(list_sum(list_transform(content, lambda x: length(x)))), 0) AS BIGINT) AS characters FROM bk LEFT JOIN chap USING (book_id) GROUP BY book_id HAVING coalesce(sum(list_sum(list_transform(content, lambda x: length(x)))), 0) < 1000")
def _(t: Tables) -> DataFrame:
    sums = C.catalog_projection(t.chapters).groupBy("book_id").agg(F.sum("character_count").alias("characters"))
    return _books(t).select("book_id").join(sums, "book_id", "left").withColumn("characters", F.coalesce("characters", F.lit(0).cast("bigint"))).where("characters < 1000")


@query("a19_extracted_ratio", CHAPTERS + ", r AS (SELECT book_id, sum(list_sum(list_transform(list_filter(content, lambda x: length(x) >= 40), lambda x: length(x)))) AS kept, sum(list_sum(list_transform(content, lambda x: length(x)))) AS whole FROM chap WHERE book_id IS NOT NULL GROUP BY book_id) SELECT book_id, round(coalesce(kept, 0) / whole, 6) AS ratio FROM r WHERE whole > 0 AND coalesce(kept, 0) / whole < 0.9")
def _(t: Tables) -> DataFrame:
    """Books whose long paragraphs hold less than nine tenths of their characters."""
    lengths, zero = P.element_lengths(), F.lit(0).cast("bigint")
    add = lambda a, x: a + x
    c = _chapters(t, "book_id", F.aggregate(F.filter(lengths, lambda x: x >= 40), zero, add).alias("kept"), F.aggregate(lengths, zero, add).alias("whole")).where("book_id is not null")
    r = c.groupBy("book_id").agg(F.sum("kept").alias("kept"), F.sum("whole").alias("whole")).where("whole > 0")
    return r.where(F.col("kept") / F.col("whole") < 0.9).select("book_id", F.round(F.col("kept") / F.col("whole"), 6).alias("ratio"))


@query("a22_distinct_colours", f"WITH {_NOTES} SELECT DISTINCT highlight_color FROM nt WHERE highlight_color IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return _notes(t).where("highlight_color is not null").select("highlight_color").distinct()


@query("k2_catalog", CHAPTERS + "SELECT book_id, chapter_id, CAST(len(content) AS INTEGER) AS paragraph_count, array_to_string(list_transform(content, lambda x: coalesce(length(x), 0)), ',') AS paragraph_character_counts, CAST(coalesce(list_sum(list_transform(content, lambda x: length(x))), 0) AS BIGINT) AS character_count FROM chap")
def _(t: Tables) -> DataFrame:
    return C.catalog_projection(t.chapters).withColumn("paragraph_character_counts", F.array_join("paragraph_character_counts", ","))


@query("k7_toggled_places", f"WITH {_NOTES} SELECT chapter_id, paragraph_index, arg_max(left(excerpt, 180), (created_at, id)) AS excerpt FROM nt GROUP BY chapter_id, paragraph_index HAVING count(*) % 2 = 1")
def _(t: Tables) -> DataFrame:
    n = _notes(t).withColumn("excerpt", F.left("excerpt", F.lit(180)))
    return C.toggled(n, ["chapter_id", "paragraph_index"], F.struct("created_at", "id"), "excerpt")


@query("k8_saved_notes", f"WITH {_NOTES} SELECT min(id) AS id, chapter_id, paragraph_index, selection_start, selection_end, arg_max(note_text, (updated_at, id)) AS note_text, max(updated_at) AS updated_at FROM nt WHERE note_text IS NOT NULL GROUP BY chapter_id, paragraph_index, selection_start, selection_end")
def _(t: Tables) -> DataFrame:
    """Upsert by exact place: the smallest id stays, the newest text wins."""
    n = _notes(t).where("note_text is not null")
    return n.groupBy("chapter_id", "paragraph_index", "selection_start", "selection_end").agg(F.min("id").alias("id"), F.max_by("note_text", F.struct("updated_at", "id")).alias("note_text"), F.max("updated_at").alias("updated_at"))


@query("k11_delete_cascade", _W + f", {_NOTES}, gone AS (SELECT book_id FROM bk WHERE coalesce(translator, '') = '') SELECT id FROM nt WHERE book_id NOT IN (SELECT book_id FROM gone) OR book_id IS NULL")
def _(t: Tables) -> DataFrame:
    b = _books(t)
    return C.without(b, b.where("coalesce(translator, '') = ''"), "book_id", _notes(t))[1].select("id")


@query("k14_migrated_notes", f"WITH {_NOTES} SELECT id, excerpt, note_text, selection_start, CAST(coalesce(selection_start, 0) + length(excerpt) AS INTEGER) AS range_end, 'EXACT' AS state, CASE WHEN trim(coalesce(note_text, '')) = '' THEN 'HIGHLIGHT' ELSE 'ANNOTATION' END AS kind, '' AS prefix, '' AS suffix, '' AS paragraph_hash, false AS pinned, created_at, created_at AS updated_at FROM nt")
def _(t: Tables) -> DataFrame:
    """The oldest shape brought to the newest step by step: ranges, then anchors, then kinds, then what is pinned and when it changed."""
    old = _notes(t).select("id", "excerpt", "note_text", "selection_start", "created_at")
    empty = F.lit("")
    steps = (
        {"range_end": (F.coalesce("selection_start", F.lit(0)) + F.length("excerpt")).cast("int")},
        {"prefix": empty, "suffix": empty, "paragraph_hash": empty, "state": F.lit("EXACT")},
        {"kind": F.when(F.trim(F.coalesce("note_text", empty)) == "", "HIGHLIGHT").otherwise("ANNOTATION")},
        {"pinned": F.lit(False), "updated_at": F.col("created_at")},
    )
    for defaults in steps:
        old = C.migrated(old, defaults)
    return old


@query(
    "k15_book_fingerprints",
    CHAPTERS + ", l AS (SELECT book_id, sha256(concat_ws(chr(0), chapter_id, sha256(coalesce(array_to_string(content, chr(10)), '')))) AS d FROM chap WHERE book_id IS NOT NULL) SELECT book_id, sha256(concat_ws(',', count(*), "
    + ", ".join(f"sum(CAST(('0x' || substr(d, {1 + 12 * i}, 12)) AS BIGINT))" for i in range(5)) + ")) AS fingerprint FROM l GROUP BY book_id",
)
def _(t: Tables) -> DataFrame:
    c = _chapters(t, "book_id", C.content_digest(F.array_join("content", "\n")).alias("digest")).where("book_id is not null")
    return C.fingerprint(c, "chapter_id", "digest", "book_id", digested=True)


@query("u3_ordered_union", f"WITH {_NOTES}, {_SESS}, u AS (SELECT book_id, 1 AS o FROM nt UNION ALL SELECT book_id, 2 FROM once) SELECT book_id, CAST(min(o) AS INTEGER) AS first_list FROM u WHERE book_id IS NOT NULL GROUP BY book_id")
def _(t: Tables) -> DataFrame:
    both = _notes(t).select("book_id", F.lit(1).alias("o")).unionByName(R.distinct_sessions(t.reading_sessions).select("book_id", F.lit(2).alias("o")))
    return both.where("book_id is not null").groupBy("book_id").agg(F.min("o").alias("first_list"))


@query("u4_intersection", "SELECT book_id FROM notes WHERE book_id IS NOT NULL INTERSECT SELECT book_id FROM footnotes INTERSECT SELECT book_id FROM reading_sessions")
def _(t: Tables) -> DataFrame:
    return t.notes.select("book_id").where("book_id is not null").intersect(t.footnotes.select("book_id")).intersect(t.reading_sessions.select("book_id"))


@query("u5_title_variants", _W + "SELECT title_zh AS title FROM bk WHERE title_zh IS NOT NULL UNION SELECT title_en FROM bk WHERE title_en IS NOT NULL UNION SELECT title FROM chapters WHERE title IS NOT NULL")
def _(t: Tables) -> DataFrame:
    b = _books(t)
    parts = [b.select(F.col("title_zh").alias("title")), b.select("title_en"), t.chapters.select("title")]
    return parts[0].union(parts[1]).union(parts[2]).where("title is not null").distinct()


@query("u7_append_new", CHAPTERS + ", fresh AS (SELECT chapter_id, title FROM chap WHERE chapter_level >= 2), old AS (SELECT chapter_id, title FROM chap WHERE chapter_ord = 0) SELECT * FROM old UNION ALL SELECT * FROM fresh WHERE chapter_id NOT IN (SELECT chapter_id FROM old)")
def _(t: Tables) -> DataFrame:
    c = _chapters(t)
    old, fresh = c.where("chapter_ord = 0").select("chapter_id", "title"), c.where("chapter_level >= 2").select("chapter_id", "title")
    return old.unionByName(fresh.join(old, "chapter_id", "left_anti"))


@query("o1_notes_order", f"WITH {_NOTES} SELECT id, row_number() OVER (ORDER BY pinned DESC NULLS LAST, updated_at DESC NULLS LAST, id) AS place FROM nt")
def _(t: Tables) -> DataFrame:
    """Every note with its place."""
    return C.placed(_notes(t).select("id", "pinned", "updated_at"), F.desc_nulls_last("pinned"), F.desc_nulls_last("updated_at"), F.asc("id")).select("id", "place")


@query("o2_chapter_notes_order", f"WITH {_NOTES} SELECT id, row_number() OVER (PARTITION BY chapter_id ORDER BY paragraph_index, selection_start, id) AS place FROM nt")
def _(t: Tables) -> DataFrame:
    return _notes(t).select("id", F.row_number().over(Window.partitionBy("chapter_id").orderBy("paragraph_index", "selection_start", "id")).cast("bigint").alias("place"))


@query("o3_latest_sessions", f"WITH {_SESS} SELECT id, started_at, row_number() OVER (ORDER BY started_at DESC NULLS LAST, id DESC) AS place FROM once WHERE active_millis > 0")
def _(t: Tables) -> DataFrame:
    """Every session with active time, the latest first, with its place."""
    active = R.distinct_sessions(t.reading_sessions).where("active_millis > 0").select("id", "started_at")
    return C.placed(active, F.desc_nulls_last("started_at"), F.desc("id")).select("id", "started_at", "place")


@query("o8_inventory_order", _W + "SELECT book_id, row_number() OVER (ORDER BY array_to_string(author_ids, ',') NULLS LAST, coalesce(pub_year, ''), title_zh NULLS LAST, book_id) AS place FROM bk")
def _(t: Tables) -> DataFrame:
    """Every book with its place."""
    order = [F.asc_nulls_last(F.array_join("author_ids", ",")), F.asc(F.coalesce("pub_year", F.lit(""))), F.asc_nulls_last("title_zh"), F.asc("book_id")]
    return C.placed(_books(t).select("book_id", "author_ids", "pub_year", "title_zh"), *order).select("book_id", "place")


@query("o11_sections_resorted", CHAPTERS + ", s AS (SELECT chapter_id, unnest(sections) AS s, generate_subscripts(sections, 1) AS ord FROM chap) SELECT chapter_id, string_agg(s.section_id, ',' ORDER BY s.paragraph_index, ord) AS section_ids FROM s GROUP BY chapter_id")
def _(t: Tables) -> DataFrame:
    """A stable sort inside the array."""
    numbered = F.transform("sections", lambda s, i: F.struct(s.paragraph_index.alias("p"), i.alias("i"), s.section_id.alias("id")))
    return _chapters(t).where(F.size("sections") > 0).select("chapter_id", F.array_join(F.transform(F.array_sort(numbered), lambda s: s.id), ",").alias("section_ids"))


@query("o13_recent_unique", f"WITH {_SESS}, r AS (SELECT device_id, book_id, max(started_at) AS s FROM once WHERE device_id IS NOT NULL GROUP BY device_id, book_id) SELECT device_id, book_id, k AS place FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY s DESC, book_id) AS k FROM r) WHERE k <= 8")
def _(t: Tables) -> DataFrame:
    """The last 8 different books of each device."""
    r = R.distinct_sessions(t.reading_sessions).where("device_id is not null").groupBy("device_id", "book_id").agg(F.max("started_at").alias("s"))
    k = F.row_number().over(Window.partitionBy("device_id").orderBy(F.desc("s"), "book_id"))
    return r.select("device_id", "book_id", k.cast("bigint").alias("place")).where("place <= 8")


@query("filter_shelf", _WC + f", {_NOTES} SELECT n.id FROM nt n LEFT JOIN bk USING (book_id) LEFT JOIN chap c ON c.chapter_id = n.chapter_id WHERE contains(lower(concat_ws(' ', coalesce(title_zh, ''), coalesce(c.title, ''), coalesce(n.note_text, ''), coalesce(n.excerpt, ''))), '工') AND note_kind IS NOT NULL AND highlight_color IS NOT NULL")
def _(t: Tables) -> DataFrame:
    """A case-insensitive substring over title, chapter, note and excerpt, with kind and colour."""
    n = _notes(t).where("note_kind is not null and highlight_color is not null")
    b, c = _books(t).select("book_id", "title_zh"), _chapters(t).select("chapter_id", "title")
    empty = F.lit("")
    text = F.lower(F.concat_ws(" ", F.coalesce("title_zh", empty), F.coalesce("title", empty), F.coalesce("note_text", empty), F.coalesce("excerpt", empty)))
    return n.join(b, "book_id", "left").join(c, "chapter_id", "left").where(F.contains(text, F.lit("工"))).select("id")

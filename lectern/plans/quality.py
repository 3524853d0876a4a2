"""Queries of the quality rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import audit as A
from lectern.operators import catalog as C
from lectern.operators import positions as P
from lectern.plans.catalogue import BOOKS
from lectern.plans.positions import CHAPTERS
from lectern.plans.texts import _S, _TITLE, SUSPICIOUS
from lectern.registry import ORACLES, Tables, query
from lectern.session import cut_lineage


def _trimmed(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '^{_S}+|{_S}+$', '', 'g')"



def _rule(when: str, severity: str, code: str, at: str, message: str = "''") -> str:
    return f"SELECT '{severity}' AS severity, '{code}' AS code, {at} AS location, coalesce({message}, '') AS message FROM r WHERE {when}"


_YEAR = "regexp_full_match(coalesce(pub_year, ''), '(?:18|19|20)[0-9]{2}(?:\\s*[–—-]\\s*(?:18|19|20)[0-9]{2})?')"
_TITLE_YEARS = "regexp_extract_all(regexp_replace(coalesce(title_zh, ''), '[0-9]{5,}', '', 'g'), '(?:18|19|20)[0-9]{2}')"
_BOOK_RULES = " UNION ALL ".join(
    _rule(*x)
    for x in (
        (_trimmed("title_zh") + " = ''", "ERROR", "MISSING_TITLE", "book_id"),
        ("contains(coalesce(title_zh, ''), chr(65533))", "ERROR", "REPLACEMENT_CHARACTER", "book_id"),
        ("coalesce(lang_code, '') NOT IN ('zh','en','de','fr','ru')", "ERROR", "INVALID_LANGUAGE", "book_id", "lang_code"),
        ("coalesce(category, '') NOT IN ('著作','文章','书信')", "ERROR", "INVALID_CATEGORY", "book_id", "category"),
        ("coalesce(rights, '') NOT IN ('PUBLIC_DOMAIN','CC_BY_SA','PERMISSION_REQUIRED','UNKNOWN')", "ERROR", "INVALID_RIGHTS", "book_id", "rights"),
        ("NOT regexp_matches(coalesce(source_url, ''), '^https?://')", "ERROR", "INVALID_SOURCE_URL", "book_id", "source_url"),
        (_trimmed("source_credit") + " = ''", "ERROR", "MISSING_SOURCE_CREDIT", "book_id"),
        ("coalesce(pub_year, '') = ''", "REVIEW", "MISSING_YEAR", "book_id"),
        (f"coalesce(pub_year, '') <> '' AND NOT {_YEAR}", "REVIEW", "INVALID_YEAR_FORMAT", "book_id", "pub_year"),
        (f"{_YEAR} AND len({_TITLE_YEARS}) > 0 AND NOT list_contains({_TITLE_YEARS}, left(pub_year, 4))", "REVIEW", "TITLE_YEAR_CONFLICT", "book_id", "pub_year"),
        ("coalesce(year_type, '') <> '' AND year_type NOT IN ('WRITTEN','PUBLISHED','TRANSLATION_PUBLICATION','EDITION','SOURCE_DATE')", "ERROR", "INVALID_YEAR_TYPE", "book_id", "year_type"),
        (_trimmed("translator") + " = ''", "REVIEW", "TRANSLATOR_UNRECORDED", "book_id"),
        (_trimmed("description") + " = ''", "REVIEW", "DESCRIPTION_MISSING", "book_id"),
    )
)


@query("audit_books", f"WITH {BOOKS}, r AS (SELECT * FROM bk) {_BOOK_RULES}")
def _(t: Tables) -> DataFrame:
    return A.books(C.distinct_books(t.books))


_NAV = f"(regexp_matches(x, '^(?:(?:上一篇|下一篇|回目录|返回目录|上一页|下一页|目录){_S}*[（(]?[^）)]{{0,30}}[）)]?{_S}*)+$') OR (contains(x, '回目录') AND length(x) <= 60))"
_CHAPTER_RULES = " UNION ALL ".join(
    _rule(*x)
    for x in (
        (_trimmed("title") + " = ''", "ERROR", "MISSING_CHAPTER_TITLE", "chapter_id"),
        ("length(" + _trimmed("body") + ") < 100", "ERROR", "CHAPTER_BODY_TOO_SHORT", "chapter_id"),
        ("empties > 0", "ERROR", "EMPTY_PARAGRAPH", "chapter_id", "CAST(empties AS VARCHAR)"),
        ("contains(body, chr(65533))", "ERROR", "REPLACEMENT_CHARACTER", "chapter_id", "CAST(len(regexp_extract_all(body, '\\x{FFFD}')) AS VARCHAR)"),
        ("regexp_matches(body, '[\\x{E000}-\\x{F8FF}]')", "ERROR", "PRIVATE_USE_CHARACTER", "chapter_id", "CAST(len(regexp_extract_all(body, '[\\x{E000}-\\x{F8FF}]')) AS VARCHAR)"),
        ("regexp_matches(body, '(?i)</?[a-z][^>]*>')", "ERROR", "HTML_LEAK", "chapter_id"),
        ("navs > 0", "ERROR", "NAVIGATION_LINE", "chapter_id", "CAST(navs AS VARCHAR)"),
        ("structures > 0", "ERROR", "DUPLICATE_STRUCTURE_HEADING", "chapter_id", "CAST(structures AS VARCHAR)"),
        ("repeats > 0", "REVIEW", "CONSECUTIVE_DUPLICATE_PARAGRAPH", "chapter_id", "CAST(repeats AS VARCHAR)"),
        ("len(list_distinct(ids)) < len(ids)", "ERROR", "DUPLICATE_SECTION_ID", "chapter_id"),
        ("damaged > 0", "ERROR", "REPLACEMENT_CHARACTER", "chapter_id || '#sections'", "CAST(damaged AS VARCHAR)"),
        ("outside > 0", "ERROR", "SECTION_TARGET_OUT_OF_RANGE", "chapter_id", "CAST(outside AS VARCHAR)"),
    )
)
_CHAPTER_FACTS = f""", r AS (SELECT chapter_id, title, array_to_string(content, chr(10)) AS body,
 len(list_filter(content, lambda x: {_trimmed('x')} = '')) AS empties, len(list_filter(content, lambda x: {_NAV})) AS navs,
 len(list_filter(content, lambda x, i: regexp_matches(x, '^第[一二三四五六七八九十百0-9]+(?:卷|篇|章|节|部)[\\s\\x{{3000}}]') AND length(x) <= 32 AND (i <= 4 OR regexp_replace(x, '{_S}+', '', 'g') = regexp_replace(coalesce(title, ''), '{_S}+', '', 'g')))) AS structures,
 len(list_filter(content, lambda x, i: i > 1 AND x = content[i - 1] AND x <> '')) AS repeats, list_transform(sections, lambda s: s.section_id) AS ids, len(list_filter(sections, lambda s: contains(coalesce(s.title, ''), chr(65533)))) AS damaged,
 len(list_filter(sections, lambda s: s.paragraph_index < 0 OR s.paragraph_index >= len(content))) AS outside FROM chap) """


@query("audit_chapters", CHAPTERS + _CHAPTER_FACTS + "SELECT * FROM (" + _CHAPTER_RULES + ")")
def _(t: Tables) -> DataFrame:
    """All rules on chapters but the classifier of section titles, which SQL's regular expressions don't express."""
    return A.chapters(t.chapters).where("code <> 'SUSPICIOUS_SECTION_TITLE'")


_FOOTNOTES = "fn AS (SELECT DISTINCT footnote_id, book_id, chapter_id, marker, content, refs FROM footnotes)"
_FOOTNOTE_FACTS = f", {_FOOTNOTES}, r AS (SELECT footnote_id, f.content, refs, len(list_filter(f.content, lambda x: {_trimmed('x')} <> '')) AS kept, len(list_filter(f.content, lambda x: contains(coalesce(x, ''), chr(65533)))) AS damaged, len(list_filter(refs, lambda q: q.paragraph_index < 0 OR q.paragraph_index >= coalesce(len(c.content), 0))) AS off, len(list_filter(refs, lambda q: q.paragraph_index >= 0 AND q.paragraph_index < coalesce(len(c.content), 0) AND (q.start_offset < 0 OR q.end_offset <= q.start_offset OR q.end_offset > length(c.content[q.paragraph_index + 1])))) AS wrong FROM fn f LEFT JOIN chap c USING (chapter_id)) "
_FOOTNOTE_RULES = " UNION ALL ".join(
    _rule(*x)
    for x in (
        ("coalesce(kept, 0) = 0", "ERROR", "EMPTY_FOOTNOTE", "footnote_id"),
        ("damaged > 0", "ERROR", "REPLACEMENT_CHARACTER", "footnote_id", "CAST(damaged AS VARCHAR)"),
        ("coalesce(len(refs), 0) = 0", "ERROR", "FOOTNOTE_WITHOUT_REFERENCE", "footnote_id"),
        ("off > 0", "ERROR", "FOOTNOTE_PARAGRAPH_OUT_OF_RANGE", "footnote_id", "CAST(off AS VARCHAR)"),
        ("wrong > 0", "ERROR", "FOOTNOTE_OFFSET_OUT_OF_RANGE", "footnote_id", "CAST(wrong AS VARCHAR)"),
    )
)


def _footnotes(t: Tables) -> DataFrame:
    return t.footnotes.select("footnote_id", "book_id", "chapter_id", "marker", "content", "refs").distinct()


@query("audit_footnotes", CHAPTERS + _FOOTNOTE_FACTS + _FOOTNOTE_RULES + " UNION ALL SELECT 'ERROR', 'DUPLICATE_FOOTNOTE_ID', footnote_id, CAST(count(*) AS VARCHAR) FROM fn WHERE coalesce(footnote_id, '') <> '' GROUP BY footnote_id HAVING count(*) > 1")
def _(t: Tables) -> DataFrame:
    return A.footnotes(_footnotes(t), P.latest_chapters(t.chapters, P.element_lengths().alias("lengths")))


@query("x8_marker_mismatch", CHAPTERS + f", {_FOOTNOTES}, q AS (SELECT footnote_id, chapter_id, marker, unnest(refs) AS q FROM fn) SELECT footnote_id, q.paragraph_index AS paragraph_index, substr(content[q.paragraph_index + 1], q.start_offset + 1, q.end_offset - q.start_offset) AS found FROM q JOIN chap USING (chapter_id) WHERE q.paragraph_index < len(content) AND substr(content[q.paragraph_index + 1], q.start_offset + 1, q.end_offset - q.start_offset) <> marker")
def _(t: Tables) -> DataFrame:
    return A.marker_mismatches(_footnotes(t), P.latest_texts(t.chapters, "content"))


@query(
    "audit_catalogue",
    CHAPTERS + f""", {BOOKS}, rep AS (
 SELECT 'DUPLICATE_AUTHOR_ID' AS code, author_id AS k, count(*) AS n FROM authors GROUP BY author_id UNION ALL SELECT 'DUPLICATE_BOOK_ID', book_id, count(*) FROM books GROUP BY book_id
 UNION ALL SELECT 'DUPLICATE_SOURCE_URL', source_url, count(*) FROM books GROUP BY source_url UNION ALL SELECT 'DUPLICATE_CHAPTER_ID_GLOBAL', chapter_id, count(*) FROM chapters GROUP BY chapter_id
 UNION ALL SELECT 'DUPLICATE_CHAPTER_ID_IN_BOOK', book_id || '/' || chapter_id, count(*) FROM chapters WHERE coalesce(chapter_id, '') <> '' GROUP BY ALL)
SELECT 'ERROR' AS severity, code, k AS location, CAST(n AS VARCHAR) AS message FROM rep WHERE n > 1 AND coalesce(k, '') <> ''
UNION ALL SELECT 'ERROR', 'UNKNOWN_AUTHOR', book_id, a FROM (SELECT DISTINCT book_id, unnest(author_ids) AS a FROM books) WHERE a NOT IN (SELECT author_id FROM authors)
UNION ALL SELECT 'ERROR', 'NO_CHAPTERS', book_id, '' FROM books WHERE book_id NOT IN (SELECT book_id FROM chapters WHERE book_id IS NOT NULL)
UNION ALL SELECT 'ERROR', 'RESTRICTED_RIGHTS_BODY', book_id, '' FROM books WHERE coalesce(rights, '') NOT IN ('PUBLIC_DOMAIN', 'CC_BY_SA') AND book_id IN (SELECT book_id FROM chapters)
UNION ALL SELECT 'REVIEW', 'EXACT_DUPLICATE_CHAPTER', min(chapter_id), CAST(count(*) AS VARCHAR) FROM chapters WHERE array_to_string(content, chr(10)) <> '' GROUP BY sha256(array_to_string(content, chr(10))) HAVING count(*) > 1""",
)
def _(t: Tables) -> DataFrame:
    """The tables as delivered, with their repeats."""
    return A.catalogue(t.authors, t.books, t.chapters)


_SUSPICIOUS = CHAPTERS + f", s AS (SELECT chapter_id, unnest(sections).title AS title FROM chap), t AS (SELECT chapter_id, {_TITLE} AS t FROM s) SELECT DISTINCT 'ERROR' AS severity, 'SUSPICIOUS_SECTION_TITLE' AS code, chapter_id AS location FROM t WHERE {SUSPICIOUS} IS NOT NULL"
_PARTS = " UNION ALL ".join(f"SELECT severity, code FROM ({sql})" for sql in (*(ORACLES[f"audit_{n}"] for n in ("books", "chapters", "footnotes", "catalogue")), _SUSPICIOUS))


@query("audit_counts", f"SELECT severity, code, count(*) AS n FROM ({_PARTS}) GROUP BY severity, code")
def _(t: Tables) -> DataFrame:
    """All findings by code."""
    lengths = P.latest_chapters(t.chapters, P.element_lengths().alias("lengths"))
    parts = [A.books(C.distinct_books(t.books)), A.chapters(t.chapters), A.footnotes(_footnotes(t), lengths), A.catalogue(t.authors, t.books, t.chapters)]
    return A.counts(reduce(DataFrame.unionByName, parts))


@query("o7_findings_preview", f"WITH {BOOKS}, r AS (SELECT * FROM bk), f AS ({_BOOK_RULES}) SELECT * FROM f ORDER BY severity <> 'ERROR', code, location, message LIMIT 50")
def _(t: Tables) -> DataFrame:
    """The first findings, errors first."""
    return A.ordered(A.books(C.distinct_books(t.books)), 50)


@query("j28_guarded_records", CHAPTERS + ", e AS (SELECT chapter_id, sha256(array_to_string(content, chr(10))) AS before FROM chapters) SELECT DISTINCT chapter_id, CASE WHEN e.before = sha256(array_to_string(list_filter(chap.content, lambda x: NOT coalesce(" + _NAV + ", false)), chr(10))) THEN 'applies' ELSE 'refused' END AS outcome FROM e JOIN chap USING (chapter_id)")
def _(t: Tables) -> DataFrame:
    """Repairs bound to the digest of what they expect, here of every delivery, against the latest without its navigation lines; where there were any, they are refused."""
    kept = F.sha2(F.array_join(F.filter("content", lambda x: ~F.coalesce(X.navigation_line(x), F.lit(False))), "\n"), 256)
    body = F.sha2(F.array_join("content", "\n"), 256)
    # a digest of each delivery, used on both sides: written once, so texts are read once
    digests = cut_lineage(t.chapters.select("chapter_id", "fetched_at", body.alias("digest"), kept.alias("kept")))
    expected, now = digests.select("chapter_id", F.col("digest").alias("expected")), P.latest_chapters(digests, F.col("kept").alias("now"))
    return expected.join(now, "chapter_id").select("chapter_id", F.when(F.col("expected") == F.col("now"), "applies").otherwise("refused").alias("outcome")).distinct()

"""Queries of search and of note anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import tags
from lectern.operators import catalog as C
from lectern.operators import positions as P
from lectern.operators import search as S
from lectern.plans.catalogue import BOOKS
from lectern.plans.positions import CHAPTERS
from lectern.registry import Tables, query

_INDEX = CHAPTERS + f", {BOOKS}, ix AS (SELECT c.book_id, chapter_id, bk.title_zh AS title, c.title AS chapter_title, unnest(content) AS content, CAST(generate_subscripts(content, 1) - 1 AS INTEGER) AS paragraph_index FROM chap c JOIN bk ON bk.book_id = c.book_id)"


def _has(column: str, term: str) -> str:
    """A token that begins with the term: the term at the beginning or after a character that is no letter, number or mark."""
    return f"regexp_matches(lower(coalesce({column}, '')), '(?:^|[^\\p{{L}}\\p{{N}}\\p{{M}}]){term}')"


def _index(t: Tables) -> DataFrame:
    return S.content_index(P.latest_texts(t.chapters, "book_id", "title", "content"), C.distinct_books(t.books))


_PLACE = ["book_id", "chapter_id", "paragraph_index"]


@query("x1_search_all", _INDEX + f" SELECT book_id, chapter_id, paragraph_index FROM ix WHERE content <> '' AND ({_has('title', '关于')} OR {_has('chapter_title', '关于')} OR {_has('content', '关于')})")
def _(t: Tables) -> DataFrame:
    """Every paragraph in which a term begins a token, in any column."""
    return S.matching(_index(t), "关于").select(*_PLACE)


@query("x1_search_body", _INDEX + f" SELECT book_id, chapter_id, paragraph_index FROM ix WHERE content <> '' AND {_has('content', 'die')} AND {_has('content', 'steuer')}")
def _(t: Tables) -> DataFrame:
    return S.matching(_index(t), 'die "Steuer*"', "BODY").select(*_PLACE)


@query("x1_search_titles", _INDEX + f" SELECT book_id, chapter_id, paragraph_index FROM ix WHERE content <> '' AND ({_has('title', '评')} OR {_has('chapter_title', '评')})")
def _(t: Tables) -> DataFrame:
    return S.matching(_index(t), "评", "TITLES").select(*_PLACE)


@query("o4_first_80_hits", _INDEX + f" SELECT book_id, chapter_id, paragraph_index FROM ix WHERE content <> '' AND {_has('content', '难道')} ORDER BY 1, 2, 3 LIMIT 80")
def _(t: Tables) -> DataFrame:
    return S.first_hits(S.matching(_index(t), "难道", "BODY")).select(*_PLACE)


@query("x2_search_of_author", _INDEX + f" SELECT ix.book_id, chapter_id, paragraph_index FROM ix WHERE content <> '' AND {_has('content', '凡是')} AND book_id IN (SELECT book_id FROM books WHERE list_contains(author_ids, (SELECT min(author_id) FROM authors)))")
def _(t: Tables) -> DataFrame:
    """The author's books as a semi join; the first author stands for the one asked for."""
    author = t.authors.agg(F.min("author_id").alias("author_id"))
    own = C.distinct_books(t.books).select("book_id", F.explode("author_ids").alias("author_id")).join(author, "author_id", "left_semi")
    return S.matching(_index(t), "凡是", "BODY", own).select(*_PLACE)


def _paragraphs(t: Tables) -> DataFrame:
    return P.latest_texts(t.chapters, "content").select("chapter_id", F.posexplode("content").alias("paragraph_index", "text"))


@query("x3_matches_in_books", CHAPTERS + ", par AS (SELECT chapter_id, unnest(content) AS text, CAST(generate_subscripts(content, 1) - 1 AS INTEGER) AS paragraph_index FROM chap), p AS (SELECT chapter_id, paragraph_index, string_split(text, '劳动') AS pieces FROM par WHERE contains(text, '劳动')), o AS (SELECT chapter_id, paragraph_index, pieces, unnest(generate_series(1, len(pieces) - 1)) AS k FROM p) SELECT chapter_id, paragraph_index, CAST(list_sum(list_transform(pieces[1:k], lambda x: length(x))) + 2 * (k - 1) AS INTEGER) AS start FROM o ORDER BY 1, 2, 3 LIMIT 500")
def _(t: Tables) -> DataFrame:
    """The first 500 literal matches in document order."""
    return S.in_book(_paragraphs(t), "劳动").select("chapter_id", "paragraph_index", "start")


@query("f12_all_occurrences", "WITH p AS (SELECT doc_id, string_split(lower(text), '的') AS pieces FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(pieces) - 1 AS n FROM p WHERE len(pieces) > 1")
def _(t: Tables) -> DataFrame:
    rows = t.documents.where("text is not null").select("doc_id", "text", F.lit("的").alias("needle"))
    return S.occurrences(rows, "doc_id").select("doc_id", F.size("starts").cast("bigint").alias("n"))


@query("f13_excerpts", "WITH p AS (SELECT doc_id, text, instr(text, '劳动') - 1 AS s FROM documents WHERE contains(text, '劳动')) SELECT doc_id, CASE WHEN s > 32 THEN '…' ELSE '' END || substr(text, greatest(s - 32, 0) + 1, least(s + 50, length(text)) - greatest(s - 32, 0)) || CASE WHEN s + 50 < length(text) THEN '…' ELSE '' END AS excerpt FROM p")
def _(t: Tables) -> DataFrame:
    start = F.instr("text", F.lit("劳动")) - 1
    return t.documents.where(F.contains("text", F.lit("劳动"))).select("doc_id", S.excerpt(F.col("text"), start, F.lit(2)).alias("excerpt"))


@query("f14_marked_snippets", "WITH p AS (SELECT doc_id, text, instr(text, '工') - 1 AS s FROM documents WHERE contains(text, '工')), e AS (SELECT doc_id, CASE WHEN s > 32 THEN '…' ELSE '' END || substr(text, greatest(s - 32, 0) + 1, least(s + 49, length(text)) - greatest(s - 32, 0)) || CASE WHEN s + 49 < length(text) THEN '…' ELSE '' END AS x FROM p) SELECT doc_id, md5(replace(x, '工', '<b>工</b>')) AS digest, x = replace(replace(replace(x, '工', '<b>工</b>'), '<b>', ''), '</b>', '') AS same FROM e")
def _(t: Tables) -> DataFrame:
    """marks put into the surroundings of the first hit, wherever it stands, and taken out again."""
    text, term = F.col("text"), F.lit("工")
    d = t.documents.where(F.contains(text, term)).select("doc_id", S.excerpt(text, F.instr(text, term) - 1, F.length(term)).alias("excerpt"))
    snippet = S.marked(F.col("excerpt"), term)
    return d.select("doc_id", F.md5(snippet).alias("digest"), (S.unmarked(snippet) == F.col("excerpt")).alias("same"))


def _notes(t: Tables) -> DataFrame:
    return t.notes.where("id is not null").select("id", "chapter_id", "paragraph_index", "excerpt", "selection_start", "selection_end").distinct()


@query("x5_note_anchors", CHAPTERS + ", par AS (SELECT chapter_id, unnest(content) AS text, CAST(generate_subscripts(content, 1) - 1 AS INTEGER) AS paragraph_index FROM chap) SELECT id, substr(text, selection_start + 1, selection_end - selection_start) AS excerpt, right(left(text, selection_start), 32) AS prefix, substr(text, selection_end + 1, 32) AS suffix, sha256(text) AS paragraph_hash, CASE WHEN trim(coalesce(note_text, '')) = '' THEN 'HIGHLIGHT' ELSE 'ANNOTATION' END AS kind, concat_ws('|', note_kind, highlight_color) AS tags FROM (SELECT DISTINCT id, chapter_id, paragraph_index, selection_start, selection_end, note_text, note_kind, highlight_color FROM notes WHERE id IS NOT NULL) JOIN par USING (chapter_id, paragraph_index) WHERE selection_start >= 0 AND selection_end > selection_start")
def _(t: Tables) -> DataFrame:
    """What a note stores of its place, its kind by whether it has a text, and its tags."""
    notes = t.notes.where("id is not null and selection_start >= 0 and selection_end > selection_start").select("id", "chapter_id", "paragraph_index", "selection_start", "selection_end", "note_text", "note_kind", "highlight_color").distinct()
    at = notes.join(_paragraphs(t), ["chapter_id", "paragraph_index"])
    kind = F.when(F.trim(F.coalesce("note_text", F.lit(""))) == "", "HIGHLIGHT").otherwise("ANNOTATION")
    listed = F.array_join(tags(F.concat_ws("，", "note_kind", "highlight_color")), "|")
    return at.select("id", S.note_anchors(F.col("text"), F.col("selection_start"), F.col("selection_end")).alias("a"), kind.alias("kind"), listed.alias("tags")).select("id", "a.*", "kind", "tags")


@query(
    "x4_resolved_anchors",
    CHAPTERS + """, par AS (SELECT chapter_id, unnest(content) AS text, CAST(generate_subscripts(content, 1) - 1 AS INTEGER) AS paragraph_index FROM chap), n AS (SELECT DISTINCT id, chapter_id, paragraph_index, excerpt, selection_start AS s, selection_end AS e FROM notes WHERE id IS NOT NULL),
x AS (SELECT n.*, coalesce(substr(text, s + 1, e - s) = excerpt, false) AS exact FROM n LEFT JOIN par USING (chapter_id, paragraph_index)),
h AS (SELECT x.id, par.paragraph_index AS pi, instr(text, excerpt) - 1 AS st, abs(par.paragraph_index - x.paragraph_index) AS d FROM x JOIN par USING (chapter_id) WHERE NOT exact AND excerpt <> '' AND contains(text, excerpt)),
b AS (SELECT id, arg_min(pi, (d, pi)) AS pi, arg_min(st, (d, pi)) AS st FROM h GROUP BY id)
SELECT x.id, CASE WHEN exact THEN 'EXACT' WHEN b.id IS NOT NULL THEN 'RELOCATED' ELSE 'FALLBACK' END AS state, CASE WHEN exact OR b.id IS NULL THEN paragraph_index ELSE b.pi END AS paragraph_index,
CAST(CASE WHEN exact THEN s ELSE coalesce(b.st, 0) END AS INTEGER) AS range_start, CAST(CASE WHEN exact THEN e ELSE coalesce(b.st + length(excerpt), 0) END AS INTEGER) AS range_end FROM x LEFT JOIN b USING (id)""",
)
def _(t: Tables) -> DataFrame:
    """Notes without stored context, so the nearest paragraph with the excerpt wins."""
    nothing = F.lit(None).cast("string")
    notes = _notes(t).withColumns({"prefix": nothing, "suffix": nothing, "paragraph_hash": nothing})
    return S.resolved_anchors(notes, _paragraphs(t))


@query("j27_located_once", CHAPTERS + ", f AS (SELECT DISTINCT id, chapter_id, excerpt FROM notes WHERE id IS NOT NULL AND excerpt <> '') SELECT chapter_id, id AS piece_id, CAST(instr(body, excerpt) - 1 AS INTEGER) AS start FROM f JOIN (SELECT chapter_id, array_to_string(content, chr(10)) AS body FROM chap) USING (chapter_id) WHERE len(string_split(body, excerpt)) = 2")
def _(t: Tables) -> DataFrame:
    """Excerpts that stand exactly once in their chapter."""
    texts = P.latest_texts(t.chapters, "content").select("chapter_id", F.array_join("content", "\n").alias("text"))
    pieces = _notes(t).where("excerpt <> ''").select("chapter_id", F.col("id").alias("piece_id"), F.col("excerpt").alias("piece"))
    return S.located_once(texts, pieces, "chapter_id")

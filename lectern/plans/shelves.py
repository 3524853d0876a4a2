"""Queries of shelves and directories, of runs and contexts in texts, and of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import dates as D
from lectern.functions import text as X
from lectern.operators import catalog as C
from lectern.operators import notes as N
from lectern.operators import positions as P
from lectern.operators import reading as R
from lectern.operators import search as S
from lectern.plans.catalogue import _NOTES, _SESS, BOOKS
from lectern.plans.positions import _PAGES, _TREE, CHAPTERS, _pages
from lectern.plans.texts import _PAR
from lectern.registry import Tables, query
from lectern.session import cut_lineage

_W = "WITH " + BOOKS


def _books(t: Tables) -> DataFrame:
    return C.distinct_books(t.books)


def _notes(t: Tables) -> DataFrame:
    return t.notes.where("id is not null").distinct()


@query("filter_author_works", _W + " SELECT book_id FROM bk WHERE category = '著作' AND contains(lower(coalesce(title_zh, '')), '论')")
def _(t: Tables) -> DataFrame:
    """The author's screen, by category and part of the title."""
    return _books(t).where((F.col("category") == "著作") & F.contains(F.lower(F.coalesce("title_zh", F.lit(""))), F.lit("论"))).select("book_id")


@query("filter_shelf_tagged", _W + f", {_NOTES} SELECT id FROM nt LEFT JOIN bk USING (book_id) WHERE contains(lower(concat_ws(' ', coalesce(title_zh, ''), coalesce(note_text, ''), coalesce(excerpt, ''))), '的') AND list_contains([lower(category), lower(note_kind)], '书信')")
def _(t: Tables) -> DataFrame:
    """Notes of which the shelf's text holds a word and the tags a tag, without regard to case."""
    both = _notes(t).join(_books(t).select("book_id", "title_zh", "category"), "book_id", "left")
    empty = F.lit("")
    text = F.lower(F.concat_ws(" ", F.coalesce("title_zh", empty), F.coalesce("note_text", empty), F.coalesce("excerpt", empty)))
    tags = X.tags(F.lower(F.concat_ws("，", "category", "note_kind")))
    return both.where(F.contains(text, F.lit("的")) & F.array_contains(tags, "书信")).select("id")


@query("filter_safe_assets", _W + r" SELECT book_id, path FROM (SELECT book_id, 'images/' || regexp_replace(source_url, '^[A-Za-z]+:/', '') AS path FROM bk WHERE source_url IS NOT NULL) WHERE NOT contains(path, '..') AND NOT contains(path, chr(92)) AND NOT contains(path, '//') AND regexp_matches(path, '[^/]$')")
def _(t: Tables) -> DataFrame:
    """Paths of assets made of URLs, those inside their folder only."""
    path = F.concat(F.lit("images/"), F.regexp_replace("source_url", "^[A-Za-z]+:/", ""))
    return _books(t).where("source_url is not null").select("book_id", path.alias("path")).where(X.safe_asset(F.col("path"), "images/"))


@query("filter_short_keep", _PAR + ", p AS (SELECT chapter_id, title FROM chap) SELECT chapter_id, paragraph_index FROM par JOIN p USING (chapter_id) WHERE length(text) >= 2 AND text <> coalesce(title, '') AND lower(text) NOT IN ('home', 'index', 'next', 'previous', 'up', 'contents', '返回', '主页', '下一页', '上一页') AND NOT contains(lower(text), 'contact us') AND NOT contains(lower(text), 'last updated') AND NOT contains(lower(text), 'download:') AND NOT contains(lower(text), 'jump to') AND NOT contains(lower(text), 'privacy policy') AND NOT contains(lower(text), 'cookie')")
def _(t: Tables) -> DataFrame:
    """The short list of lines that aren't the text's, with a word of the archive's own."""
    kept = F.transform("content", lambda x, i: F.when(X.short_keep(x, F.coalesce("title", F.lit("")), ("cookie",)), i))
    return P.latest_chapters(t.chapters, F.filter(kept, lambda i: i.isNotNull()).alias("i")).select("chapter_id", F.explode("i").alias("paragraph_index"))


@query("filter_kept_lines", _PAR + r"SELECT chapter_id, paragraph_index FROM par WHERE length(text) >= 2 AND lower(text) NOT IN ('home', 'index', 'next', 'previous', 'up', 'contents', '返回', '主页', '首页', '下一页', '上一页', '目录', '打印') AND text NOT IN ('->', '- >', '→', '>>', '»') AND NOT (regexp_matches(text, '^(?:->|→|>>) ') AND length(text) <= 40) AND NOT contains(lower(text), '广告') AND NOT contains(lower(text), 'cookie')")
def _(t: Tables) -> DataFrame:
    """P5: lines of the text, without navigation words, breadcrumbs and notices."""
    return P.latest_elements(t.chapters, lambda x: X.kept_line(x, ("广告", "cookie")))


@query("filter_defaults", _W + " SELECT book_id, CASE WHEN rights IN ('PUBLIC_DOMAIN', 'CC_BY_SA', 'PERMISSION_REQUIRED') THEN rights ELSE 'UNKNOWN' END AS rights, CASE WHEN category IN ('著作', '书信') THEN category ELSE '文章' END AS category, coalesce(nullif(lang_code, ''), 'zh') AS lang_code, CASE WHEN year_type IN ('WRITTEN', 'PUBLISHED', 'TRANSLATION_PUBLICATION', 'EDITION', 'SOURCE_DATE') THEN year_type END AS year_type FROM bk")
def _(t: Tables) -> DataFrame:
    """Values outside of what is allowed become defaults."""
    allowed = lambda c, values, default: F.when(F.col(c).isin(*values), F.col(c)).otherwise(F.lit(default)).alias(c)
    years = ("WRITTEN", "PUBLISHED", "TRANSLATION_PUBLICATION", "EDITION", "SOURCE_DATE")
    return _books(t).select("book_id", allowed("rights", ("PUBLIC_DOMAIN", "CC_BY_SA", "PERMISSION_REQUIRED"), "UNKNOWN"), allowed("category", ("著作", "书信"), "文章"), F.coalesce(F.nullif("lang_code", F.lit("")), F.lit("zh")).alias("lang_code"), allowed("year_type", years, None))


_DIRECTORY = _W + """, ex AS (SELECT DISTINCT unnest(author_ids) AS author_id, book_id, source_url, title_zh FROM bk),
 dir AS (SELECT author_id, source_url, row_number() OVER (PARTITION BY author_id ORDER BY source_url) - 1 AS place FROM (SELECT DISTINCT author_id, source_url FROM ex WHERE source_url IS NOT NULL)),
 placed AS (SELECT ex.author_id, book_id, title_zh, place FROM ex LEFT JOIN dir ON dir.author_id = ex.author_id AND dir.source_url = ex.source_url) """


def _directory(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Works of each author, and the author's directory: the URLs of the works with their places."""
    works = _books(t).select(F.explode("author_ids").alias("author_id"), "book_id", "source_url", "title_zh").distinct()
    w = Window.partitionBy("author_id").orderBy("source_url")
    urls = works.where("source_url is not null").select("author_id", "source_url").distinct().withColumn("place", F.row_number().over(w) - 1)
    return works, urls


@query("j3_directory_order", _DIRECTORY + "SELECT author_id, CAST(place AS INTEGER) AS place, min(book_id) AS book_id, count(*) AS works FROM placed WHERE place IS NOT NULL GROUP BY author_id, place")
def _(t: Tables) -> DataFrame:
    """Each place of an author's directory with its first work, and how many works have its URL."""
    works, urls = _directory(t)
    return C.in_directory(works, urls).where("place is not null").groupBy("author_id", "place").agg(F.min("book_id").alias("book_id"), F.count(F.lit(1)).alias("works"))


@query("j2_by_directory", _DIRECTORY + "SELECT author_id, book_id, row_number() OVER (PARTITION BY author_id ORDER BY place NULLS LAST, title_zh NULLS LAST, book_id) AS ord FROM placed")
def _(t: Tables) -> DataFrame:
    """An author's works in the order of the directory, those that it doesn't list after them."""
    works, urls = _directory(t)
    w = Window.partitionBy("author_id").orderBy(F.asc_nulls_last("place"), F.asc_nulls_last("title_zh"), "book_id")
    return C.in_directory(works, urls).select("author_id", "book_id", F.row_number().over(w).cast("bigint").alias("ord"))


@query("j10_reviewed_first", _W + ", y AS (SELECT book_id, nullif(pub_year, '') AS r, list_distinct(regexp_extract_all(coalesce(title_zh, ''), '\\b((?:18|19|20)[0-9]{2})\\b', 1)) AS a FROM bk) SELECT book_id, coalesce(r, CASE WHEN len(a) = 1 THEN a[1] END) AS year, CASE WHEN r IS NOT NULL THEN 'reviewed' WHEN len(a) = 1 THEN 'inferred' END AS basis FROM y")
def _(t: Tables) -> DataFrame:
    """A recorded year beats the one inferred from the title."""
    label = F.coalesce("title_zh", F.lit(""))
    b = _books(t).select("book_id", F.nullif("pub_year", F.lit("")).alias("r"), F.nullif(X.local_year(label, label), F.lit("")).alias("i"))
    return b.select("book_id", F.coalesce("r", "i").alias("year"), F.when(F.col("r").isNotNull(), "reviewed").when(F.col("i").isNotNull(), "inferred").alias("basis"))


_MATCHES = ", pieces AS (SELECT chapter_id, paragraph_index, string_split(text, '劳动') AS p FROM par WHERE contains(text, '劳动')), o AS (SELECT chapter_id, paragraph_index, p, unnest(generate_series(1, len(p) - 1)) AS k FROM pieces), hits AS (SELECT chapter_id, paragraph_index, CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) + 2 * (k - 1) AS INTEGER) AS start FROM o)"


def _matches(t: Tables, needle: str) -> DataFrame:
    """(chapter_id, paragraph_index, start): occurrences in the non-empty paragraphs, found in the scan."""
    shown = F.filter("content", lambda x: x.isNotNull() & (x != ""))
    found = F.transform(shown, lambda x: X.occurrences(x, F.lit(needle)))
    return P.latest_chapters(t.chapters, found.alias("f")).select("chapter_id", F.posexplode("f").alias("paragraph_index", "s")).select("chapter_id", "paragraph_index", F.explode("s").alias("start"))


@query("j18_matches_on_pages", _PAGES + _MATCHES + "SELECT chapter_id, paragraph_index, start, page, greatest(start, page_start) AS clip_start, least(start + 2, page_end) AS clip_end FROM hits JOIN pages USING (chapter_id, paragraph_index) WHERE start < page_end AND page_start < start + 2")
def _(t: Tables) -> DataFrame:
    """Matches of a search clipped to the page ranges that they overlap."""
    hits = _matches(t, "劳动").withColumn("past", F.col("start") + 2)
    return P.overlaps(hits, _pages(t), ["chapter_id", "paragraph_index"], "start", "past", "page_start", "page_end").select("chapter_id", "paragraph_index", "start", "page", "clip_start", "clip_end")


@query("j22_digest_join", _W + ", l AS (SELECT DISTINCT source_url AS target FROM bk WHERE source_url IS NOT NULL), i AS (SELECT book_id, 'chapter-' || substr(sha1(source_url), 1, 10) AS key FROM bk WHERE source_url IS NOT NULL) SELECT book_id, target FROM i JOIN l ON substr(sha1(target), 1, 10) = right(key, 10)")
def _(t: Tables) -> DataFrame:
    """Ids that end in part of a digest, joined to the links with that digest."""
    b = _books(t).where("source_url is not null")
    digest = F.substring(F.sha1("source_url"), 1, 10)
    ids = b.select("book_id", F.concat(F.lit("chapter-"), digest).alias("key"))
    links = b.select(F.col("source_url").alias("target"), digest.alias("suffix")).distinct()
    return ids.withColumn("suffix", F.right("key", F.lit(10))).join(links, "suffix").select("book_id", "target")


@query("j16_reversed_collapsed", _TREE.replace("CAST(ord AS INTEGER) AS ord, s.section_id", "CAST(-ord AS INTEGER) AS nord, CAST(ord AS INTEGER) AS ord, s.section_id") + ", shown AS (SELECT * FROM walk w WHERE NOT EXISTS (SELECT 1 FROM sect s WHERE s.chapter_id = w.chapter_id AND contains(coalesce(s.title, ''), '问题') AND s.section_id <> w.section_id AND list_contains(w.ids, s.section_id))) SELECT chapter_id, section_id, row_number() OVER (PARTITION BY chapter_id ORDER BY list_transform(path, lambda x: -x)) AS place FROM shown")
def _(t: Tables) -> DataFrame:
    """The tree with children in reverse order, without what is below a collapsed node."""
    from lectern.plans.positions import _walk

    collapsed = P.latest_chapters(t.chapters, F.transform(F.filter("sections", lambda s: F.contains(F.coalesce(s.title, F.lit("")), F.lit("问题"))), lambda s: s.section_id).alias("closed"))
    above = F.slice("ids", F.lit(1), F.size("ids") - 1)
    shown = _walk(t).join(collapsed, "chapter_id").where(~F.arrays_overlap(above, F.coalesce("closed", F.array().cast("array<string>"))))
    w = Window.partitionBy("chapter_id").orderBy(F.transform("path", lambda x: -x))
    return shown.select("chapter_id", "section_id", F.row_number().over(w).cast("bigint").alias("place"))


@query("a7_levels", _PAR.replace("par AS (SELECT chapter_id", "par AS (SELECT book_id, chapter_id") + "SELECT book_id, chapter_id, paragraph_index, count(*) AS paragraphs, count(DISTINCT chapter_id) AS chapters, count(DISTINCT book_id) AS books, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS characters FROM par WHERE book_id IS NOT NULL GROUP BY ROLLUP (book_id, chapter_id, paragraph_index)")
def _(t: Tables) -> DataFrame:
    """Library, book, chapter and paragraph in one rollup over lengths; a book's and a chapter's first paragraph counts it, so nothing is counted distinct."""
    sizes = cut_lineage(P.latest_chapters(t.chapters, "book_id", P.element_lengths().alias("ls")).where("book_id is not null and size(ls) > 0"))
    first = sizes.groupBy("book_id").agg(F.min("chapter_id").alias("chapter_id")).withColumn("first", F.lit(True))
    rows = sizes.join(first, ["book_id", "chapter_id"], "left").select("book_id", "chapter_id", "first", F.posexplode("ls").alias("i", "n"))
    marked = rows.select("book_id", "chapter_id", F.col("i").alias("paragraph_index"), "n", (F.col("i") == 0).cast("int").alias("c"), ((F.col("i") == 0) & F.coalesce("first", F.lit(False))).cast("int").alias("b"))
    sums = marked.rollup("book_id", "chapter_id", "paragraph_index").agg(F.count(F.lit(1)).alias("paragraphs"), F.sum("c").alias("c"), F.sum("b").alias("b"), F.sum("n").cast("bigint").alias("characters"))
    one = F.lit(1).cast("bigint")
    return sums.select("book_id", "chapter_id", "paragraph_index", "paragraphs", F.when(F.col("chapter_id").isNotNull(), one).otherwise(F.col("c")).alias("chapters"), F.when(F.col("book_id").isNotNull(), one).otherwise(F.col("b")).alias("books"), "characters")


@query("a22_available_books", f"WITH {_NOTES}, {_SESS}, u AS (SELECT book_id, 1 AS o FROM nt UNION ALL SELECT book_id, 2 FROM once UNION ALL SELECT book_id, 3 FROM footnotes) SELECT book_id, CAST(min(o) AS INTEGER) AS first_list, count(DISTINCT o) AS lists FROM u WHERE book_id IS NOT NULL GROUP BY book_id")
def _(t: Tables) -> DataFrame:
    """The different ids of three lists, with the first list of each."""
    of = lambda frame, o: frame.select("book_id", F.lit(o).alias("o"))
    u = of(_notes(t), 1).unionByName(of(R.distinct_sessions(t.reading_sessions), 2)).unionByName(of(t.footnotes, 3)).where("book_id is not null").groupBy("book_id", "o").agg(F.count(F.lit(1)).alias("n"))
    return u.groupBy("book_id").agg(F.min("o").alias("first_list"), F.count(F.lit(1)).alias("lists"))


@query("w10_repeated_runs", _PAR + ", m AS (SELECT *, text = lag(text) OVER w AS same, lag(text, 1) OVER w AS b1, lag(text, 2) OVER w AS b2, lead(text, 1) OVER w AS a1, lead(text, 2) OVER w AS a2 FROM par WINDOW w AS (PARTITION BY chapter_id ORDER BY paragraph_index)), g AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY chapter_id ORDER BY paragraph_index) AS run FROM m WHERE text <> ''), r AS (SELECT chapter_id, run, min(paragraph_index) AS first_index, max(paragraph_index) AS last_index, count(*) AS n, arg_min(concat_ws('|', b2, b1), paragraph_index) AS before, arg_max(concat_ws('|', a1, a2), paragraph_index) AS after FROM g GROUP BY ALL HAVING count(*) > 1) SELECT chapter_id, first_index, last_index, md5(before) AS before, md5(after) AS after FROM r")
def _(t: Tables) -> DataFrame:
    """Runs of one repeated line, with two lines of context on either side, from the array itself."""
    run = lambda i: F.struct(i.alias("first_index"), (i + F.size(F.filter(F.sequence(i, F.size("content") - 1), lambda j: F.forall(F.sequence(i, j), lambda k: F.get("content", k) == F.get("content", i)))) - 1).alias("last_index"))
    begins = lambda x, i: x.isNotNull() & (x != "") & (F.get("content", i + 1) == x) & ((i == 0) | ~F.get("content", i - 1).eqNullSafe(x))
    starts = F.filter(F.transform("content", lambda x, i: F.when(begins(x, i), i)), lambda i: i.isNotNull())
    context = lambda a, b: F.md5(F.concat_ws("|", F.get("content", a), F.get("content", b)))
    runs = F.transform(F.transform(starts, run), lambda r: F.struct(r.first_index.alias("first_index"), r.last_index.alias("last_index"), context(r.first_index - 2, r.first_index - 1).alias("before"), context(r.last_index + 1, r.last_index + 2).alias("after")))
    return P.latest_chapters(t.chapters, runs.alias("r")).select("chapter_id", F.inline("r"))


@query("w9_character_runs", _PAR + ", m AS (SELECT chapter_id, paragraph_index FROM par WHERE length(text) <= 4 AND text <> ''), g AS (SELECT *, paragraph_index - row_number() OVER (PARTITION BY chapter_id ORDER BY paragraph_index) AS island FROM m) SELECT chapter_id, min(paragraph_index) AS first_index, max(paragraph_index) AS last_index, count(*) AS size FROM g GROUP BY chapter_id, island")
def _(t: Tables) -> DataFrame:
    """Runs of neighbouring lines of at most four characters, of one line too."""
    short = P.latest_elements(t.chapters, lambda x: (F.length(x) <= 4) & (x != ""))
    island = F.col("paragraph_index") - F.row_number().over(Window.partitionBy("chapter_id").orderBy("paragraph_index"))
    return short.withColumn("island", island).groupBy("chapter_id", "island").agg(F.min("paragraph_index").alias("first_index"), F.max("paragraph_index").alias("last_index"), F.count(F.lit(1)).alias("size")).drop("island")


@query("j11_first_definitions", "WITH f AS (SELECT DISTINCT chapter_id, marker, footnote_id FROM footnotes WHERE marker IS NOT NULL) SELECT chapter_id, marker, min(footnote_id) AS footnote_id FROM f GROUP BY chapter_id, marker")
def _(t: Tables) -> DataFrame:
    """Of the definitions of one marker in a chapter the first, to which its references lead."""
    f = t.footnotes.where("marker is not null").select("chapter_id", "marker", "footnote_id").distinct()
    return N.first_definitions(f, ["chapter_id", "marker"], "footnote_id").select("chapter_id", "marker", "footnote_id")


@query("o6_by_title", _W + " SELECT book_id, row_number() OVER (ORDER BY coalesce(nullif(title_zh, ''), nullif(title_en, ''), book_id), book_id) AS place FROM bk")
def _(t: Tables) -> DataFrame:
    """The catalogue by the title that is shown."""
    empty = F.lit("")
    b = _books(t).select("book_id", F.coalesce(F.nullif("title_zh", empty), F.nullif("title_en", empty), "book_id").alias("shown"))
    return C.placed(b, F.asc("shown"), F.asc("book_id")).select("book_id", "place")


@query("f10_balanced_ends", "WITH s AS (SELECT doc_id, instr(text, '（') AS a, text FROM documents WHERE contains(text, '（')), c AS (SELECT doc_id, a, unnest(string_split(substr(text, a), '')) AS ch, generate_subscripts(string_split(substr(text, a), ''), 1) AS i FROM s), d AS (SELECT doc_id, a, i, sum(CASE ch WHEN '（' THEN 1 WHEN '）' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS depth FROM c) SELECT doc_id, CAST(any_value(a) - 1 AS INTEGER) AS start, CAST(min(a + i - 1) FILTER (depth = 0) AS INTEGER) AS past FROM d GROUP BY doc_id")
def _(t: Tables) -> DataFrame:
    """where the first parenthesis of a text closes, with all that open and close within it; null where it never does."""
    d = t.documents.where(F.contains("text", F.lit("（"))).select("doc_id", "text", (F.instr("text", F.lit("（")) - 1).alias("start"))
    return d.select("doc_id", "start", X.balanced_end(F.col("text"), F.col("start")).alias("past"))


@query("f11_common_context", f"WITH {_NOTES} SELECT id, CAST((SELECT max(n) FROM generate_series(0, 64) g(n) WHERE n <= least(length(excerpt), length(note_text)) AND left(excerpt, n) = left(note_text, n)) AS INTEGER) AS prefix, CAST((SELECT max(n) FROM generate_series(0, 64) g(n) WHERE n <= least(length(excerpt), length(note_text)) AND right(excerpt, n) = right(note_text, n)) AS INTEGER) AS suffix FROM nt WHERE excerpt IS NOT NULL AND note_text IS NOT NULL")
def _(t: Tables) -> DataFrame:
    """how many characters an excerpt and its note have in common at the beginning and at the end, of 64 at most."""
    n = _notes(t).where("excerpt is not null and note_text is not null")
    return n.select("id", X.common_prefix(F.col("excerpt"), F.col("note_text"), 64).alias("prefix"), X.common_prefix(F.reverse("excerpt"), F.reverse("note_text"), 64).alias("suffix"))


@query("f13_all_excerpts", "WITH p AS (SELECT doc_id, text, string_split(text, '劳动') AS p FROM documents WHERE contains(text, '劳动')), o AS (SELECT doc_id, text, p, unnest(generate_series(1, len(p) - 1)) AS k FROM p), h AS (SELECT doc_id, text, CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) + 2 * (k - 1) AS INTEGER) AS s FROM o) SELECT doc_id, s AS start, CASE WHEN s > 32 THEN '…' ELSE '' END || substr(text, greatest(s - 32, 0) + 1, least(s + 50, length(text)) - greatest(s - 32, 0)) || CASE WHEN s + 50 < length(text) THEN '…' ELSE '' END AS excerpt FROM h")
def _(t: Tables) -> DataFrame:
    """every match with its surroundings."""
    d = t.documents.where(F.contains("text", F.lit("劳动"))).select("doc_id", F.explode(X.occurrences(F.col("text"), F.lit("劳动"))).alias("start"), "text")
    return d.select("doc_id", "start", S.excerpt(F.col("text"), F.col("start"), F.lit(2)).alias("excerpt"))


@query("f15_marked_spans", "WITH p AS (SELECT doc_id, string_split(left(text, 200), '工') AS p FROM documents WHERE contains(left(text, 200), '工')), o AS (SELECT doc_id, p, unnest(generate_series(1, len(p) - 1)) AS k FROM p) SELECT doc_id, CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) + k - 1 AS INTEGER) AS span_start, CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) + k AS INTEGER) AS span_end FROM o")
def _(t: Tables) -> DataFrame:
    """the spans that the marks of a preview's text enclosed, in the text without them; the preview is the first 200 characters."""
    marked = t.documents.where("text is not null").select("doc_id", S.marked(F.left("text", F.lit(200)), F.lit("工")).alias("m"))
    return marked.select("doc_id", F.inline(X.marked_spans(F.col("m"))))


@query("f27_range_labels", _W + ", p AS (SELECT book_id, publication_date AS d, length(publication_date) AS l, CAST(left(publication_date, 4) AS INTEGER) AS y FROM bk WHERE regexp_full_match(publication_date, '[0-9]{4}(-[0-9]{2}(-[0-9]{2})?)?')), q AS (SELECT book_id, y, y || '年' || CASE WHEN l >= 7 THEN CAST(substr(d, 6, 2) AS INTEGER) || '月' ELSE '' END || CASE WHEN l = 10 THEN CAST(substr(d, 9, 2) AS INTEGER) || '日' ELSE '' END AS label FROM p WHERE try_cast(CASE l WHEN 4 THEN d || '-01-01' WHEN 7 THEN d || '-01' ELSE d END AS DATE) IS NOT NULL) SELECT book_id, label || CASE WHEN y % 2 = 0 THEN '—' || (y + 1) || '年' ELSE '' END AS label FROM q")
def _(t: Tables) -> DataFrame:
    """labels of ranges; the end, for even years, is the year after."""
    d = _books(t).select("book_id", D.partial_date(F.col("publication_date")).alias("d")).where("d is not null")
    end = F.when(F.col("d.year") % 2 == 0, D.partial_date(F.format_string("%04d", F.col("d.year") + 1)))
    return d.select("book_id", D.range_label(F.col("d"), end).alias("label"))


@query("numeric_labels", CHAPTERS + ", s AS (SELECT book_id, CAST(sum(list_sum(list_transform(content, lambda x: coalesce(length(x), 0)))) AS BIGINT) AS n, count(*) AS c FROM chap WHERE book_id IS NOT NULL GROUP BY book_id HAVING n IS NOT NULL) SELECT book_id, CASE WHEN n >= 10000 THEN printf('%d.%d', n // 10000, n % 10000 // 1000) || ' 万字' ELSE n || ' 字' END AS label, CASE WHEN c = 1 THEN 100.0 ELSE least(99.9, floor(n / 1000.0) / 10.0 * 10) END AS percent, (n % 97) * (n % 97) + c * c AS distance FROM s")
def _(t: Tables) -> DataFrame:
    """Numbers as a reader sees them: lengths in ten thousands, a percentage of at most 99.9 unless completed, squared distances."""
    s = P.latest_chapters(t.chapters, "book_id", P.chapter_length().alias("n")).where("book_id is not null").groupBy("book_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("c"))
    percent = X.percent(F.floor(F.col("n") / 1000) / 10.0 * 10, F.col("c") == 1)
    return s.select("book_id", X.length_label(F.col("n")).alias("label"), percent.alias("percent"), X.squared_distance(F.col("n") % 97, F.col("c")).alias("distance"))


@query("url_normalised", _W + " SELECT book_id, regexp_replace(regexp_replace(source_url, '#.*$', ''), '^([^?;]*);[^?]*', '\\1') AS url, regexp_extract(regexp_replace(source_url, '[?#].*$', ''), '^.*/', 0) AS folder FROM bk WHERE regexp_matches(source_url, '^https?://[^/]+/')")
def _(t: Tables) -> DataFrame:
    """URLs without fragment and path parameters, and the folder of each."""
    b = _books(t).where(F.col("source_url").rlike("^https?://[^/]+/"))
    return b.select("book_id", X.normal_url(F.col("source_url")).alias("url"), X.url_folder(F.col("source_url")).alias("folder"))

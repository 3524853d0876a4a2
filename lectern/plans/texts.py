"""Queries of text and date functions over titles, elements and markers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import dates as D
from lectern.functions import text as X
from lectern.operators import catalog as C
from lectern.operators import positions as P
from lectern.plans.catalogue import BOOKS
from lectern.plans.positions import CHAPTERS
from lectern.registry import Tables, query

_S = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_PAR = CHAPTERS + ", par AS (SELECT chapter_id, unnest(content) AS text, CAST(generate_subscripts(content, 1) - 1 AS INTEGER) AS paragraph_index FROM chap)"


def _chapters(t: Tables, *columns) -> DataFrame:
    return P.latest_chapters(t.chapters, *columns)


def _elements(t: Tables, keep, **values) -> DataFrame:
    return P.latest_elements(t.chapters, keep, **values)


@query("f1_clean_space", _PAR + f"SELECT chapter_id, paragraph_index, md5(regexp_replace(regexp_replace(text, '{_S}+', ' ', 'g'), '^ | $', '', 'g')) AS digest FROM par WHERE text IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return _elements(t, lambda x: F.lit(True), digest=lambda x: F.md5(X.clean_space(x)))


@query("f2_compact_titles", CHAPTERS + f"SELECT chapter_id, regexp_replace(coalesce(title, ''), '{_S}+', '', 'g') AS title FROM chap")
def _(t: Tables) -> DataFrame:
    return _chapters(t).select("chapter_id", X.compact(F.col("title")).alias("title"))


@query("f5_safe_ids", "WITH " + BOOKS + " SELECT book_id, trim(regexp_replace(source_url, '[^a-zA-Z0-9_-]+', '-', 'g'), '-') AS slug FROM bk WHERE source_url IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return C.distinct_books(t.books).where("source_url is not null").select("book_id", X.safe_id(F.col("source_url")).alias("slug"))


@query("f4_clean_titles", CHAPTERS + f", a AS (SELECT chapter_id, title, regexp_replace(regexp_replace(regexp_extract(title, '(?s)^(.*?)(?:…{{4,}}.*|\\.{{6,}}.*)?$', 1), '{_S}*[0-9]+{_S}*[―—–-]{_S}*[0-9]+{_S}*$', ''), '{_S}+', ' ', 'g') AS t FROM chap WHERE title IS NOT NULL), b AS (SELECT chapter_id, title, trim(t, ' ·…') AS t FROM a), c AS (SELECT chapter_id, title, CASE WHEN len(string_split(t, ' ')) > 1 AND len(list_filter(string_split(t, ' '), lambda p: length(p) <> 1)) = 0 THEN replace(t, ' ', '') ELSE t END AS t FROM b) SELECT chapter_id, CASE WHEN t = '' THEN title ELSE regexp_replace(t, '^(第[一二三四五六七八九十百0-9]+章)([^\\s])', '\\1 \\2') END AS title FROM c")
def _(t: Tables) -> DataFrame:
    return _chapters(t).where("title is not null").select("chapter_id", X.clean_title(F.col("title")).alias("title"))


@query("f7_tags", "WITH " + BOOKS + ", x AS (SELECT book_id, list_filter(list_transform(string_split_regex(concat_ws('，', category, lang_code, upper(lang_code), source_credit), '[,，;；]'), lambda s: left(trim(s), 24)), lambda s: s <> '') AS p FROM bk) SELECT book_id, array_to_string(list_filter(p, lambda s, i: NOT list_contains(list_transform(p[1:i - 1], lambda q: lower(q)), lower(s)))[1:12], '|') AS tags FROM x")
def _(t: Tables) -> DataFrame:
    line = F.concat_ws("，", "category", "lang_code", F.upper("lang_code"), "source_credit")
    return C.distinct_books(t.books).select("book_id", F.array_join(X.tags(line), "|").alias("tags"))


@query("f9_marker_keys", "WITH f AS (SELECT DISTINCT footnote_id, marker, trim(marker, '[]［］〔〕【】 ' || chr(9)) AS bare FROM footnotes WHERE marker IS NOT NULL) SELECT footnote_id, CASE WHEN regexp_full_match(bare, '[①-⑳]') THEN bare WHEN regexp_matches(bare, '^[0-9]') THEN replace(left(marker, 1), '［', '[') || regexp_replace(regexp_extract(bare, '^[0-9]+'), '^0+([0-9])', '\\1') || regexp_replace(bare, '^[0-9]+', '') ELSE replace(left(marker, 1), '［', '[') || bare END AS marker_key FROM f")
def _(t: Tables) -> DataFrame:
    return t.footnotes.where("marker is not null").select("footnote_id", "marker").distinct().select("footnote_id", X.marker_key(F.col("marker")).alias("marker_key"))


@query("f16_short_excerpts", "SELECT doc_id, left(text, 180) AS excerpt FROM documents WHERE text IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", F.left("text", F.lit(180)).alias("excerpt"))


@query("f17_categories", CHAPTERS + "SELECT chapter_id, CASE WHEN regexp_matches(title, '(?:致|给).{0,25}(?:信|复信|书)|书信|通告信') THEN '书信' WHEN regexp_matches(title, '论|批判|宣言|原理|纲领|手稿|战争|革命和反革命|起源|怎么办') THEN '著作' ELSE '文章' END AS category FROM chap WHERE title IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return _chapters(t).where("title is not null").select("chapter_id", X.category(F.col("title")).alias("category"))


@query("f18_joined_ids", "WITH " + BOOKS + " SELECT book_id, array_to_string(author_ids, chr(31)) AS joined, CAST(len(string_split(array_to_string(author_ids, chr(31)), chr(31))) AS INTEGER) AS n FROM bk WHERE len(author_ids) > 0")
def _(t: Tables) -> DataFrame:
    joined = F.array_join("author_ids", "\x1f")
    return C.distinct_books(t.books).where(F.size("author_ids") > 0).select("book_id", joined.alias("joined"), F.size(F.split(joined, "\x1f")).alias("n"))


@query("f20_partial_dates", "WITH " + BOOKS + ", p AS (SELECT book_id, publication_date AS d, length(publication_date) AS l FROM bk WHERE regexp_full_match(publication_date, '[0-9]{4}(-[0-9]{2}(-[0-9]{2})?)?')) SELECT book_id, CAST(left(d, 4) AS INTEGER) * 10000 + CASE WHEN l >= 7 THEN CAST(substr(d, 6, 2) AS INTEGER) ELSE 1 END * 100 + CASE WHEN l = 10 THEN CAST(substr(d, 9, 2) AS INTEGER) ELSE 1 END AS date_order, left(d, 4) || '年' || CASE WHEN l >= 7 THEN CAST(substr(d, 6, 2) AS INTEGER) || '月' ELSE '' END || CASE WHEN l = 10 THEN CAST(substr(d, 9, 2) AS INTEGER) || '日' ELSE '' END AS label FROM p WHERE try_cast(CASE l WHEN 4 THEN d || '-01-01' WHEN 7 THEN d || '-01' ELSE d END AS DATE) IS NOT NULL")
def _(t: Tables) -> DataFrame:
    """Dates of which month and day may be missing."""
    d = C.distinct_books(t.books).select("book_id", D.partial_date(F.col("publication_date")).alias("d")).where("d is not null")
    return d.select("book_id", D.date_order(F.col("d")).alias("date_order"), D.date_label(F.col("d")).alias("label"))


_DATED = "WITH " + BOOKS + ", p AS (SELECT book_id, CAST(publication_date AS DATE) AS d FROM bk WHERE regexp_full_match(publication_date, '(18|19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}') AND try_cast(publication_date AS DATE) IS NOT NULL)"


def _dated(t: Tables) -> DataFrame:
    """(book_id, d, y, m, n): books with a whole date, its year, month and day."""
    b = C.distinct_books(t.books).where(F.col("publication_date").rlike("^(18|19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}$")).select("book_id", F.try_to_date("publication_date", "yyyy-MM-dd").alias("d")).where("d is not null")
    return b.select("book_id", "d", F.year("d").alias("y"), F.month("d").alias("m"), F.day("d").alias("n"))


@query("f21_printed_dates", _DATED + " SELECT book_id, 'whole' AS form, strftime(d, '%Y-%m-%d') AS date_start, '' AS date_end, '' AS note FROM p UNION ALL SELECT book_id, 'month', strftime(d, '%Y-%m'), '', '' FROM p UNION ALL SELECT book_id, 'styles', strftime(d + INTERVAL 13 DAY, '%Y-%m-%d'), '', 'new style' FROM p UNION ALL SELECT book_id, 'days', strftime(d, '%Y-%m-%d'), '', 'first of several' FROM p UNION ALL SELECT book_id, 'years', CAST(year(d) AS VARCHAR), CAST(year(d) + 1 AS VARCHAR), 'range of years' FROM p")
def _(t: Tables) -> DataFrame:
    """printed lines made of the dates of books, in each form that a line may have, read back; impossible dates are none."""
    day = lambda d: F.format_string("%d月%d日", F.month(d), F.day(d))
    new = F.date_add("d", 13)
    forms = {
        "whole": F.concat("y", F.lit("年"), day("d"), F.lit("载于报纸")), "month": F.concat("y", F.lit("年"), "m", F.lit("月")), "styles": F.concat("y", F.lit("年"), day("d"), F.lit("（"), day(new), F.lit("）")),
        "days": F.concat("y", F.lit("年"), "m", F.lit("月"), "n", F.lit("、"), F.col("n") + 1, F.lit("日")), "years": F.concat("y", F.lit("―"), F.col("y") + 1, F.lit("年“时报”")), "none": F.concat("y", F.lit("年13月")),
    }
    lines = _dated(t).select("book_id", F.explode(F.array(*(F.struct(F.lit(n).alias("form"), c.alias("line")) for n, c in forms.items()))).alias("l")).select("book_id", "l.*")
    return lines.select("book_id", "form", D.printed_date(F.col("line")).alias("d")).where("d is not null").select("book_id", "form", "d.*")


@query("f22_credits", _DATED + " SELECT book_id, 'first' AS form, CAST(year(d) + 1 AS VARCHAR) AS date_start FROM p UNION ALL SELECT book_id, 'after', strftime(d, '%Y-%m-%d') FROM p UNION ALL SELECT book_id, 'before', CAST(year(d) + 2 AS VARCHAR) FROM p UNION ALL SELECT book_id, 'named', strftime(d, '%Y-%m-%d') FROM p UNION ALL SELECT book_id, 'second', strftime(d, '%Y-%m-%d') FROM p")
def _(t: Tables) -> DataFrame:
    """Credit lines made of the dates of books: the word before the date, the year before the word, a name in front, a translation first; writings and prose credit nothing."""
    whole = F.concat("y", F.lit("年"), F.format_string("%d月%d日", "m", "n"))
    later = lambda k: F.concat(F.col("y") + k, F.lit("年"))
    forms = {
        "first": F.concat(later(1), F.lit("第一次发表")), "after": F.concat(F.lit("写于"), later(-1), F.lit("载于"), whole, F.lit("“时报”第3号")), "before": F.concat(F.lit("写于"), later(0), F.lit("6月"), later(2), F.lit("第一次载于“文集”第3卷")),
        "named": F.concat(F.lit("弗・兰卡写于"), later(0), F.lit("载于"), whole, F.lit("“论坛报”")), "second": F.concat(F.lit("写于"), later(0), F.lit("，俄译文第一次发表于"), later(9), F.lit("某地出版的一本杂志上，原文后来才载于"), whole),
        "none": F.concat(F.lit("写于"), later(0), F.lit("6月")), "prose": F.concat(later(0), F.lit("春，书店出版了译本。")), "translated": F.concat(F.lit("俄译文第一次发表于"), later(0)),
    }
    lines = _dated(t).select("book_id", F.explode(F.array(*(F.struct(F.lit(n).alias("form"), c.alias("line")) for n, c in forms.items()))).alias("l")).select("book_id", "l.*")
    return lines.select("book_id", "form", D.publication_credit(F.col("line"), ("兰卡",)).alias("d")).where("d is not null").select("book_id", "form", "d.date_start")


@query("f23_publication", _DATED + ", one AS (SELECT book_id FROM chapters WHERE chapter_id IS NOT NULL AND content IS NOT NULL GROUP BY book_id HAVING count(DISTINCT chapter_id) = 1) SELECT book_id, CAST(year(d) AS VARCHAR) AS date_start, '' AS date_end, '载于' || year(d) || '年“时报”' AS basis FROM p JOIN one USING (book_id)")
def _(t: Tables) -> DataFrame:
    """the least publication date in the credit lines of books of one chapter, before its notes; the lines are set at the end of the books' texts."""
    single = P.latest_chapters(t.chapters.where("content is not null"), "book_id").groupBy("book_id").agg(F.count(F.lit(1)).alias("n"), F.min("chapter_id").alias("chapter_id")).where("n = 1").select("book_id", "chapter_id")
    printed = lambda k: F.concat(F.lit("载于"), F.col("y") + k, F.lit("年“时报”"))
    tail = F.array(printed(3), printed(0), F.concat(F.lit("[1]"), printed(-5)), F.lit("注释："), printed(-9))
    added = _dated(t).join(single, "book_id").select("chapter_id", "book_id", tail.alias("tail"))
    whole = P.latest_texts(t.chapters, "content").join(added, "chapter_id")
    lines = whole.select("book_id", F.explode(D.before_notes(F.concat(F.coalesce("content", F.array().cast("array<string>")), "tail"))).alias("text"))
    credit = lines.select("book_id", "text", D.publication_credit(F.col("text")).alias("d")).where("d is not null")
    return credit.groupBy("book_id").agg(F.min_by(F.struct("d.date_start", "d.date_end", F.col("text").alias("basis")), F.struct("d.date_start", "text")).alias("x")).select("book_id", "x.*")


@query("f24_local_years", "WITH " + BOOKS + ", y AS (SELECT book_id, list_distinct(regexp_extract_all(coalesce(title_zh, ''), '\\b((?:18|19|20)[0-9]{2})\\b', 1)) AS a, coalesce(title_zh, '') AS l, list_distinct(regexp_extract_all(coalesce(title_zh, '') || ' ' || coalesce(pub_year, ''), '\\b((?:18|19|20)[0-9]{2})\\b', 1)) AS b, coalesce(title_zh, '') || ' ' || coalesce(pub_year, '') AS c FROM bk) SELECT book_id, CASE WHEN len(a) = 1 THEN a[1] WHEN len(a) > 1 THEN '' WHEN length(c) <= length(l) + 80 AND len(b) = 1 THEN b[1] ELSE '' END AS year FROM y")
def _(t: Tables) -> DataFrame:
    label = F.coalesce("title_zh", F.lit(""))
    return C.distinct_books(t.books).select("book_id", X.local_year(label, F.concat(label, F.lit(" "), F.coalesce("pub_year", F.lit("")))).alias("year"))


@query("f25_agreed_years", "WITH " + BOOKS + ", y AS (SELECT book_id, list_distinct(regexp_extract_all(coalesce(pub_year, ''), '(?:18|19|20)[0-9]{2}')) AS a, list_distinct(regexp_extract_all(coalesce(publication_date, ''), '^(?:18|19|20)[0-9]{2}')) AS b FROM bk) SELECT book_id, list_intersect(a, b)[1] AS year FROM y WHERE len(list_intersect(a, b)) = 1")
def _(t: Tables) -> DataFrame:
    """A year that two signals agree on."""
    years = lambda c, p: F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(p), F.lit(0)))
    y = X.agreed_year(years(F.col("pub_year"), "(?:18|19|20)[0-9]{2}"), years(F.col("publication_date"), "^(?:18|19|20)[0-9]{2}"))
    return C.distinct_books(t.books).select("book_id", y.alias("year")).where("year is not null")


@query("filter_link_acceptance_rule", "WITH " + BOOKS + " SELECT book_id FROM bk WHERE regexp_matches(lower(split_part(regexp_replace(source_url, '^[A-Za-z]+://[^/]+', ''), '?', 1)), '(\\.htm|\\.html|/)$') AND length(title_zh) >= 2 AND NOT regexp_matches(lower(title_zh), 'pdf|zip|下载') AND title_zh NOT IN ('主页', '首页', '返回', '上一页', '下一页', '目录', '中文版')")
def _(t: Tables) -> DataFrame:
    """Links to texts, by path ending, label words and label length."""
    path = F.lower(F.parse_url("source_url", F.lit("PATH")))
    b = C.distinct_books(t.books)
    return b.where(path.rlike(r"(\.htm|\.html|/)$") & (F.length("title_zh") >= 2) & ~F.lower("title_zh").rlike("pdf|zip|下载") & ~F.col("title_zh").isin("主页", "首页", "返回", "上一页", "下一页", "目录", "中文版")).select("book_id")


@query("filter_navigation_lines", _PAR + f"SELECT chapter_id, paragraph_index FROM par WHERE regexp_matches(text, '^(?:(?:上一篇|下一篇|回目录|返回目录|上一页|下一页|目录){_S}*[（(]?[^）)]{{0,30}}[）)]?{_S}*)+$') OR (contains(text, '回目录') AND length(text) <= 60)")
def _(t: Tables) -> DataFrame:
    """P5, P7."""
    return _elements(t, X.navigation_line)


@query("filter_heading_levels", _PAR + r", h AS (SELECT chapter_id, paragraph_index, text FROM par WHERE length(text) BETWEEN 2 AND 72 AND NOT regexp_matches(text, '[。！？；;]$') AND regexp_matches(text, '\p{L}')) SELECT chapter_id, paragraph_index, CAST(CASE WHEN regexp_matches(text, '^第[一二三四五六七八九十百0-9]+[篇章节部卷](?:[\s\x{3000}]|$)') THEN 2 WHEN regexp_matches(text, '^[一二三四五六七八九十]{1,4}[、．.]') THEN 2 WHEN regexp_matches(text, '^[（(][一二三四五六七八九十0-9]{1,4}[）)]') THEN 3 END AS INTEGER) AS level FROM h WHERE NOT regexp_matches(text, '^[0-9]') AND regexp_matches(text, '^第[一二三四五六七八九十百0-9]+[篇章节部卷](?:[\s\x{3000}]|$)|^[一二三四五六七八九十]{1,4}[、．.]|^[（(][一二三四五六七八九十0-9]{1,4}[）)]')")
def _(t: Tables) -> DataFrame:
    """Lines that read as headings."""
    return _elements(t, lambda x: ~x.rlike("^[0-9]"), level=X.heading_level).where("level is not null")


_TITLE = f"trim(regexp_replace(title, '{_S}+', ' ', 'g'))"
_DIGITS = "length(regexp_replace(t, '[^0-9]', '', 'g'))"
SUSPICIOUS = (
    "CASE WHEN t = '' THEN 'empty title' WHEN regexp_matches(t, '^[（(][0-9]{1,4}[）)]$') OR regexp_matches(t, '(?:^|[0-9][、．。.] *)(?:(?:18|19|20)[0-9]{2}年)?[0-9]{1,2}月[0-9]{1,2}日') OR regexp_matches(t, '(?:^|[0-9][、．。.] *)(?:18|19|20)[0-9]{2}年') OR regexp_matches(t, '^[0-9]{1,3} +[^0-9]') THEN NULL "
    + f"WHEN {_DIGITS} > 0 AND regexp_matches(t, '^[0-9 .,，、:：;%％+\\-−—–/()（）]+$') THEN 'numeric-only title' WHEN regexp_matches(t, '^[0-9]') AND len(regexp_extract_all(t, '[0-9]+(?:[.,][0-9]+)?')) >= 2 AND {_DIGITS} / greatest(length(t), 1) >= 0.35 AND NOT regexp_matches(t, '^[0-9]{{1,2}}[、．。)] *[^0-9]') THEN 'probable table row' END"
)


@query("filter_suspicious_titles", CHAPTERS + f", s AS (SELECT chapter_id, unnest(sections) AS s FROM chap), forms AS (SELECT chapter_id, s.section_id AS section_id, unnest([s.title, s.paragraph_index || ' | ' || length(s.title) || ' | 3.5', s.paragraph_index || '', '  ', s.paragraph_index || '、' || s.title, '（' || s.paragraph_index || '）']) AS title, generate_subscripts([1, 2, 3, 4, 5, 6], 1) AS form FROM s), t AS (SELECT *, {_TITLE} AS t FROM forms) SELECT chapter_id, section_id, CAST(form AS INTEGER) AS form, {SUSPICIOUS} AS reason FROM t WHERE reason IS NOT NULL")
def _(t: Tables) -> DataFrame:
    """Titles that are probably data, with the reason: those of sections, and as titles of sections hold few such, rows and numbers made of their places."""
    s = _chapters(t, "sections").select("chapter_id", F.inline("sections"))
    at = F.col("paragraph_index").cast("string")
    forms = (F.col("title"), F.concat(at, F.lit(" | "), F.length("title"), F.lit(" | 3.5")), at, F.lit("  "), F.concat(at, F.lit("、"), "title"), F.concat(F.lit("（"), at, F.lit("）")))
    titles = s.select("chapter_id", "section_id", F.posexplode(F.array(*forms)).alias("form", "title"))
    return titles.select("chapter_id", "section_id", (F.col("form") + 1).alias("form"), X.suspicious_title(F.col("title")).alias("reason")).where("reason is not null")


@query("filter_copyright_pages", _PAR + "SELECT chapter_id, count(*) AS lines FROM par WHERE regexp_matches(lower(text), '(?:copyright|版权所有|©)\\s*(?:19|20)[0-9]{2}|保留所有权利') GROUP BY chapter_id")
def _(t: Tables) -> DataFrame:
    """P12."""
    found = F.filter("content", lambda x: F.lower(x).rlike(r"(?:copyright|版权所有|©)\s*(?:19|20)[0-9]{2}|保留所有权利"))
    return _chapters(t, F.size(found).cast("bigint").alias("lines")).where("lines > 0")


@query("filter_valid_references", CHAPTERS + ", f AS (SELECT footnote_id, list_filter(refs, lambda r: r.start_offset >= 0 AND r.end_offset > r.start_offset AND r.paragraph_index >= 0 AND r.paragraph_index < coalesce(len(c.content), 0) AND r.end_offset <= coalesce(length(c.content[r.paragraph_index + 1]), 0)) AS ok, len(f.content) AS n FROM (SELECT DISTINCT footnote_id, chapter_id, refs, content FROM footnotes) f LEFT JOIN chap c USING (chapter_id)) SELECT footnote_id, CAST(len(ok) AS INTEGER) AS refs FROM f WHERE len(ok) > 0 OR n > 0")
def _(t: Tables) -> DataFrame:
    """References with a range within their paragraph; notes left without references and content drop."""
    f = t.footnotes.select("footnote_id", "chapter_id", "refs", "content").distinct().join(_chapters(t, P.element_lengths().alias("ls")), "chapter_id", "left")
    ok = F.filter("refs", lambda r: (r.start_offset >= 0) & (r.end_offset > r.start_offset) & (r.paragraph_index >= 0) & (r.end_offset <= F.coalesce(F.get("ls", r.paragraph_index), F.lit(0))))
    return f.select("footnote_id", F.size(ok).alias("refs"), F.size("content").alias("n")).where("refs > 0 or n > 0").drop("n")


@query("filter_clamped", CHAPTERS + "SELECT chapter_id, CAST(least(greatest(coalesce(chapter_level, 1), 1), 2) AS INTEGER) AS level FROM chap")
def _(t: Tables) -> DataFrame:
    """P15."""
    return _chapters(t).select("chapter_id", P.clamp(F.coalesce("chapter_level", F.lit(1)), F.lit(1), F.lit(2)).alias("level"))


@query("filter_language", "WITH " + BOOKS + " SELECT book_id, lower(lang_code) AS lang_code FROM bk WHERE lower(lang_code) = 'zh' AND (source_url LIKE 'https://%' OR source_url IS NULL)")
def _(t: Tables) -> DataFrame:
    """P20, P21, P13."""
    return C.distinct_books(t.books).where((F.lower("lang_code") == "zh") & (F.startswith("source_url", F.lit("https://")) | F.col("source_url").isNull())).select("book_id", F.lower("lang_code").alias("lang_code"))


@query("a16_private_characters", CHAPTERS + ", j AS (SELECT chapter_id, array_to_string(content, chr(10)) AS body FROM chap) SELECT chapter_id, CAST(len(regexp_extract_all(body, '[\\x{E000}-\\x{F8FF}]')) AS INTEGER) AS private_use, CAST(len(regexp_extract_all(body, '\\x{FFFD}')) AS INTEGER) AS replacement FROM j WHERE regexp_matches(body, '[\\x{E000}-\\x{F8FF}\\x{FFFD}]')")
def _(t: Tables) -> DataFrame:
    body = F.array_join("content", "\n")
    counts = _chapters(t, F.regexp_count(body, F.lit(r"[\x{E000}-\x{F8FF}]")).alias("private_use"), F.regexp_count(body, F.lit(r"\x{FFFD}")).alias("replacement"))
    return counts.where("private_use > 0 or replacement > 0")


_MERGED = CHAPTERS.replace("WITH chap", "WITH RECURSIVE chap") + """, l AS (SELECT chapter_id, list_filter(content, lambda x: x IS NOT NULL AND x <> '') AS ls FROM chap WHERE content IS NOT NULL),
 r AS (SELECT chapter_id, ls, 1 AS k, ls[1] AS last, 1 AS n FROM l WHERE len(ls) > 0
  UNION ALL SELECT chapter_id, ls, k + 1, CASE WHEN length(last) >= 60 AND NOT regexp_matches(last, '[。！？!?”」』：:]$') THEN last || ls[k + 1] ELSE ls[k + 1] END, CASE WHEN length(last) >= 60 AND NOT regexp_matches(last, '[。！？!?”」』：:]$') THEN n ELSE n + 1 END FROM r WHERE k < len(ls))
SELECT chapter_id, CAST(n AS INTEGER) AS lines, CAST(list_sum(list_transform(ls, lambda x: length(x))) AS BIGINT) AS characters FROM r WHERE k = len(ls)
UNION ALL SELECT chapter_id, 0, 0 FROM l WHERE len(ls) = 0"""


@query("w6_merged_lines", _MERGED)
def _(t: Tables) -> DataFrame:
    """Broken lines joined by a fold inside each chapter's row."""
    merged = t.chapters.select("chapter_id", "fetched_at", X.merge_lines(F.col("content")).alias("lines"))
    return P.latest_chapters(merged, F.size("lines").alias("lines"), F.aggregate("lines", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("characters"))


_PACKS = """WITH RECURSIVE d AS (SELECT doc_id, text, list_filter(list_transform(regexp_extract_all(text, '(?s)(?:.+?(?:[。！？]|[.!?]\\s+)|.+$)'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS p FROM documents WHERE length(text) > 2800),
 r AS (SELECT doc_id, p, 1 AS k, 0 AS pack, p[1] AS cur, CAST(NULL AS BIGINT) AS done FROM d WHERE len(p) > 0
  UNION ALL SELECT doc_id, p, k + 1, CASE WHEN length(cur) + length(p[k + 1]) > 1400 THEN pack + 1 ELSE pack END, CASE WHEN length(cur) + length(p[k + 1]) > 1400 THEN p[k + 1] ELSE cur || CASE WHEN ascii(right(cur, 1)) < 128 THEN ' ' ELSE '' END || p[k + 1] END, CASE WHEN length(cur) + length(p[k + 1]) > 1400 THEN length(cur) END FROM r WHERE k < len(p))
SELECT doc_id, 0 AS pack, CAST(length(text) AS INTEGER) AS length FROM documents WHERE length(text) <= 2800
UNION ALL SELECT doc_id, CAST(pack - 1 AS INTEGER), CAST(done AS INTEGER) FROM r WHERE done IS NOT NULL
UNION ALL SELECT doc_id, CAST(pack AS INTEGER), CAST(length(cur) AS INTEGER) FROM r WHERE k = len(p)"""


@query("w7_sentence_packs", _PACKS)
def _(t: Tables) -> DataFrame:
    packs = t.documents.where("text is not null").select("doc_id", F.posexplode(X.pack_sentences(F.col("text"))).alias("pack", "piece"))
    return packs.select("doc_id", "pack", F.length("piece").alias("length"))


@query("hash_digests", "SELECT doc_id, sha256(text) AS sha256, left(sha1(text), 12) AS short FROM documents WHERE text IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha256"), F.left(F.sha1("text"), F.lit(12)).alias("short"))


@query("json_round_trip", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(t: Tables) -> DataFrame:
    """Typed optional access: a missing or malformed field is null."""
    return t.events.select("event_id", F.from_json("props", "k bigint").k.alias("k"))


@query("hex_colours", "SELECT author_id, CAST(('0x' || replace(color, '#', '')) AS BIGINT) AS rgb FROM authors WHERE color IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return t.authors.where("color is not null").select("author_id", F.conv(F.replace("color", F.lit("#"), F.lit("")), 16, 10).cast("bigint").alias("rgb"))

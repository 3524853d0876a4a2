"""Queries of pages, printed notes and repairs, over pages and edits made from the library's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import navigation_line
from lectern.operators import catalog as C
from lectern.operators import notes as N
from lectern.operators import positions as P
from lectern.operators import repairs as R
from lectern.plans.catalogue import BOOKS
from lectern.plans.positions import CHAPTERS
from lectern.plans.texts import _S
from lectern.registry import Tables, query
from lectern.session import cut_lineage
from lectern.sources import pages as G


def _texts(t: Tables, *columns: str) -> DataFrame:
    return P.latest_texts(t.chapters, "content", *columns)


def _pages(t: Tables) -> DataFrame:
    """Each chapter as a page: its title as a heading, its elements as paragraphs in the main element, with a list of links into the page; a menu, a path, a script and lines around them."""
    escape = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.array_join(F.transform("content", lambda x: F.concat(F.lit("<p>"), escape(x), F.lit("</p>"))), "\n")
    html = F.concat(F.lit("<html><head><title>t</title><script>let x = '<p>no</p>'</script></head><body><nav><a href='/'>Home</a></nav><div class='breadcrumbs'>You <div>are</div> here</div><p>before</p><main><ul><li><a href='#a'>I</a></li><li><a href='#b'>II</a></li><li><a href='#c'>III</a></li></ul>"), F.lit("<h1>"), escape(F.coalesce("title", F.lit(""))), F.lit("</h1>"), body, F.lit("</main><div>after</div></body></html>"))
    return _texts(t, "title").where("content is not null").select(F.col("chapter_id").alias("url"), html.alias("html"))


_CLEAN = f"trim(regexp_replace(x, '{_S}+', ' ', 'g'))"


@query("x0_page_lines", CHAPTERS + f", l AS (SELECT chapter_id, list_filter(list_transform(list_prepend(coalesce(title, ''), content), lambda x: {_CLEAN}), lambda x: x <> '') AS ls FROM chap WHERE content IS NOT NULL) SELECT chapter_id AS url, CAST(len(ls) AS INTEGER) AS lines, md5(array_to_string(ls, chr(10))) AS digest FROM l WHERE len(ls) > 0")
def _(t: Tables) -> DataFrame:
    """X0.1, X0.2, X0.6: pages parsed back into the lines of their main element, without menu, path, script and lists of links into the page."""
    lines = G.page_lines(_pages(t)).groupBy("url").agg(F.array_sort(F.collect_list(F.struct("line_index", "text"))).alias("l"))
    return lines.select("url", F.size("l").alias("lines"), F.md5(F.array_join(F.transform("l", lambda x: x.text), "\n")).alias("digest"))


@query("s12_decoded_pages", "SELECT doc_id, CASE WHEN lang = 'de' THEN 'utf-16-be' WHEN regexp_full_match(text, '(?s)[\\x{0}-\\x{FF}]*') THEN 'iso-8859-1' ELSE 'utf-8' END AS encoding, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def _(t: Tables) -> DataFrame:
    """Bytes in three encodings, of which the declaration of the third lies."""
    wide, narrow = F.coalesce(F.col("lang") == "de", F.lit(False)), F.col("text").rlike(r"^[\x00-\xFF]*$")
    raw = F.when(wide, F.encode("text", "UTF-16BE")).when(narrow, F.encode(F.when(narrow, F.col("text")), "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    named = F.when(wide, "utf-16-be").when(narrow, "iso-8859-1").otherwise("ascii")
    raw = t.documents.where("text is not null").select(F.col("doc_id").cast("string").alias("url"), raw.alias("raw"), named.alias("declared"))
    return G.decoded(raw).select(F.col("url").cast("bigint").alias("doc_id"), "encoding", F.sha2("html", 256).alias("digest"))


@query("s10_verified_snapshots", "SELECT doc_id, octet_length(encode(text)) AS size, NOT contains(text, '，与此同时') AS verified FROM documents WHERE text IS NOT NULL")
def _(t: Tables) -> DataFrame:
    """Bytes against the digest noted with them; those that changed since, as here where a phrase was another, aren't verified."""
    before = F.replace("text", F.lit("，与此同时"), F.lit("，同时"))
    d = t.documents.where("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("raw"), F.sha2(before, 256).alias("noted"))
    return d.select("doc_id", F.octet_length("raw").cast("bigint").alias("size"), (F.sha2("raw", 256) == F.col("noted")).alias("verified"))


_SITE = "lower(regexp_extract(source_url, '^[A-Za-z]+://([^/?#:]+)', 1))"


def _index_links(t: Tables) -> DataFrame:
    host = F.lower(F.regexp_extract("source_url", "^[A-Za-z]+://([^/?#:]+)", 1))
    b = C.distinct_books(t.books).where("source_url is not null")
    return b.select(F.concat(F.lit("https://"), host, F.lit("/index.html")).alias("url"), F.lit(0).alias("ord"), F.col("source_url").alias("target"), F.col("title_zh").alias("label"))


@query("s18_chapter_links", f"WITH {BOOKS}, l AS (SELECT 'https://' || {_SITE} || '/index.html' AS url, source_url AS target, min(title_zh) AS label FROM bk WHERE source_url IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY target) AS k, count(*) OVER (PARTITION BY url) AS n FROM l) SELECT url, CAST(k - 1 AS INTEGER) AS place, target, label FROM r WHERE k <= 120 AND n >= 2")
def _(t: Tables) -> DataFrame:
    """The first 120 targets of index pages with at least two."""
    return G.chapter_links(_index_links(t))


@query("s17_inventory", f"WITH {BOOKS}, l AS (SELECT DISTINCT unnest(author_ids) AS a, source_url, title_zh, pub_year FROM bk WHERE source_url IS NOT NULL) SELECT source_url, array_to_string(list_sort(list_distinct(list(a))), ',') AS author_ids, arg_min(nullif(pub_year, ''), (a, title_zh)) FILTER (pub_year <> '') AS year FROM l GROUP BY source_url")
def _(t: Tables) -> DataFrame:
    b = C.distinct_books(t.books).where("source_url is not null")
    links = b.select(F.explode("author_ids").alias("author_id"), F.col("title_zh").alias("ord"), F.col("source_url").alias("target"), F.col("title_zh").alias("label"), F.col("pub_year").alias("year"))
    return G.inventory(links).select("source_url", F.array_join("author_ids", ",").alias("author_ids"), "year")


@query("s9_allowed_hosts", f"WITH {BOOKS} SELECT {_SITE} AS host, count(*) AS books FROM bk WHERE source_url IS NOT NULL AND {_SITE} LIKE '%.example' GROUP BY 1")
def _(t: Tables) -> DataFrame:
    host = F.lower(F.parse_url("source_url", F.lit("HOST")))
    return C.distinct_books(t.books).where("source_url is not null").select(host.alias("host")).where("host like '%.example'").groupBy("host").agg(F.count(F.lit(1)).alias("books"))


@query("j12_resolved_markers")
def _(t: Tables) -> DataFrame:
    """Markers in the text held against the library's footnotes of the chapter, else of the book."""
    # few rows, used in every tier: written once, so texts are parsed once
    refs = cut_lineage(N.references(N.scanned(_texts(t, "book_id"))))
    f = t.footnotes.select("footnote_id", "book_id", "chapter_id", "marker", "content").distinct()
    defs = f.select("book_id", "chapter_id", "marker", "content", F.lit(0).alias("scope_start"), F.lit(1 << 30).alias("scope_end"), F.lit(False).alias("is_local")).withColumn("key", N.marker_key(F.col("marker")))
    return N.resolved(refs, defs).select("chapter_id", "paragraph_index", "start", "marker", "tier", "outcome")


@query("x6_unlinked_markers")
def _(t: Tables) -> DataFrame:
    refs = N.references(N.scanned(_texts(t, "book_id")))
    return N.without_linked(refs, t.footnotes.select("footnote_id", "chapter_id", "refs").distinct()).select("chapter_id", "paragraph_index", "start", "marker")


@query("r1_without_navigation", CHAPTERS + f", k AS (SELECT chapter_id, list_filter(content, lambda x: NOT (regexp_matches(x, '^(?:(?:上一篇|下一篇|回目录|返回目录|上一页|下一页|目录){_S}*[（(]?[^）)]{{0,30}}[）)]?{_S}*)+$') OR (contains(x, '回目录') AND length(x) <= 60))) AS c FROM chap) SELECT chapter_id, CAST(len(c) AS INTEGER) AS elements, md5(array_to_string(c, chr(10))) AS digest FROM k")
def _(t: Tables) -> DataFrame:
    """Navigation lines deleted, sections moved with their paragraphs."""
    out = R.delete_elements(t.chapters, lambda x, i: navigation_line(x))
    return P.latest_chapters(out, F.size("content").alias("elements"), F.md5(F.array_join("content", "\n")).alias("digest"))


@query("r2_inserted_markers", CHAPTERS + ", f AS (SELECT DISTINCT chapter_id, marker, unnest(refs) AS r FROM (SELECT DISTINCT footnote_id, chapter_id, marker, refs FROM footnotes WHERE marker IS NOT NULL)), e AS (SELECT DISTINCT chapter_id, r.paragraph_index AS paragraph_index, r.end_offset AS spot, '{' || marker || '}' AS piece FROM f), fit AS (SELECT chapter_id, paragraph_index, spot, piece, content[paragraph_index + 1] AS text, coalesce(lag(spot) OVER (PARTITION BY chapter_id, paragraph_index ORDER BY spot, piece), 0) AS past FROM e JOIN chap USING (chapter_id) WHERE paragraph_index < len(content) AND spot <= length(content[paragraph_index + 1])) SELECT chapter_id, paragraph_index, md5(string_agg(substr(text, past + 1, spot - past) || piece, '' ORDER BY spot, piece) || substr(any_value(text), max(spot) + 1)) AS digest FROM fit GROUP BY chapter_id, paragraph_index")
def _(t: Tables) -> DataFrame:
    """R2: text inserted at references, however many a paragraph has."""
    refs = t.footnotes.where("marker is not null").select("footnote_id", "chapter_id", "marker", "refs").distinct().select("chapter_id", "marker", F.inline("refs"))
    edits = refs.select("chapter_id", "paragraph_index", F.col("end_offset").alias("at"), F.concat(F.lit("{"), "marker", F.lit("}")).alias("piece")).distinct()
    par = _texts(t).select("chapter_id", F.posexplode("content").alias("paragraph_index", "text"))
    key = ["chapter_id", "paragraph_index"]
    fits = edits.join(par.select(*key, F.length("text").alias("length")), key).where(F.col("at") <= F.col("length")).drop("length")
    return R.insert_text(par.join(fits, key, "left_semi"), fits, *key).select(*key, F.md5("text").alias("digest"))


@query("r5_substitutions", "SELECT doc_id, CASE WHEN contains(text, '的确') THEN 'fixed' WHEN contains(text, '确实') THEN 'already' ELSE 'unmatched' END AS outcome, md5(replace(text, '的确', '确实')) AS digest FROM documents WHERE text IS NOT NULL")
def _(t: Tables) -> DataFrame:
    d = t.documents.where("text is not null")
    records = d.select("doc_id", F.lit("的确").alias("damaged"), F.lit("确实").alias("corrected"))
    return R.substitute(d, records, "doc_id").select("doc_id", "outcome", F.md5("text").alias("digest"))


_NAV = f"(regexp_matches(x, '^(?:(?:上一篇|下一篇|回目录|返回目录|上一页|下一页|目录){_S}*[（(]?[^）)]{{0,30}}[）)]?{_S}*)+$') OR (contains(x, '回目录') AND length(x) <= 60))"


@query(
    "j26_line_differences",
    CHAPTERS + f", l AS (SELECT chapter_id AS key, unnest(content) AS x, generate_subscripts(content, 1) - 1 AS i FROM chap), m AS (SELECT *, coalesce({_NAV}, false) AS gone FROM l), n AS (SELECT *, sum(CASE WHEN gone THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY i) AS kept FROM m) SELECT key, 'delete' AS op, CAST(min(i) AS INTEGER) AS a_from, CAST(max(i) + 1 AS INTEGER) AS a_to, CAST(kept AS INTEGER) AS b_from, CAST(kept AS INTEGER) AS b_to FROM n WHERE gone GROUP BY key, kept",
)
def _(t: Tables) -> DataFrame:
    """Chapters against themselves without navigation lines: where lines were deleted."""
    a = _texts(t).select(F.col("chapter_id").alias("key"), F.col("content").alias("a"), F.filter("content", lambda x: ~navigation_line(x)).alias("b"))
    return R.line_differences(a)


@query(
    "x0_missing_blocks",
    CHAPTERS + f""", b AS (SELECT DISTINCT chapter_id, unnest(content) AS block FROM chapters WHERE chapter_id IS NOT NULL),
 n AS (SELECT chapter_id, string_agg(coalesce(array_to_string(content, ''), ''), '' ORDER BY footnote_id) AS notes FROM (SELECT DISTINCT footnote_id, chapter_id, content FROM footnotes) GROUP BY chapter_id),
 loc AS (SELECT chapter_id, regexp_replace(coalesce(array_to_string(list_filter(content, lambda x: NOT {_NAV}), ''), '') || coalesce(notes, ''), '{_S}+', '', 'g') AS t FROM chap LEFT JOIN n USING (chapter_id))
SELECT DISTINCT chapter_id, md5(block) AS digest FROM b JOIN loc USING (chapter_id) WHERE length(block) >= 80 AND NOT contains(t, regexp_replace(block, '{_S}+', '', 'g'))""",
)
def _(t: Tables) -> DataFrame:
    """X0.9: long blocks of any delivery that the library lacks: the whole newest one without navigation lines, with its footnotes."""
    blocks = t.chapters.where("chapter_id is not null").select("chapter_id", F.explode("content").alias("block"))
    notes = t.footnotes.select("footnote_id", "chapter_id", "content").distinct().groupBy("chapter_id").agg(F.array_sort(F.collect_list(F.struct("footnote_id", "content"))).alias("n"))
    kept = R.delete_elements(_texts(t, "sections"), lambda x, i: navigation_line(x)).select("chapter_id", F.array_join("content", "").alias("body"))
    printed = F.array_join(F.flatten(F.transform("n", lambda n: F.coalesce(n.content, F.array().cast("array<string>")))), "")
    local = kept.join(notes, "chapter_id", "left").select("chapter_id", F.concat(F.coalesce("body", F.lit("")), F.coalesce(printed, F.lit(""))).alias("text"))
    return R.missing_blocks(blocks, local, "chapter_id").select("chapter_id", F.md5("block").alias("digest")).distinct()

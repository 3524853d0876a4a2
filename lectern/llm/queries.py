"""Queries of the training-data operators, and the SQL that some are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import eval_leaks, lookalikes, mojibake, page_body, shared_spans, site_lines, source_mix, truncation
from lectern.llm.tables import chapters, documents, elements
from lectern.session import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return mojibake.damaged(chapters(spark, folder)).select("chapter_id", "paragraph_index").distinct()


def p1_restored(spark: SparkSession, folder: str) -> DataFrame:
    return mojibake.damaged(chapters(spark, folder)).select("chapter_id", "paragraph_index", "restored", "channel")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return page_body.around(chapters(spark, folder), table(spark, folder, "books"))


def p2_main_body(spark: SparkSession, folder: str) -> DataFrame:
    return page_body.main_body(chapters(spark, folder), table(spark, folder, "books"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = shared_spans.shared_pairs(chapters(spark, folder).withColumnRenamed("chapter_id", "record"))
    return pairs.select(F.col("record_a").alias("chapter_id_a"), F.col("record_b").alias("chapter_id_b"))


def p3_share(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans.shared_share(chapters(spark, folder).withColumnRenamed("chapter_id", "record")).withColumnRenamed("record", "chapter_id")


def p3_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans.without_shared(chapters(spark, folder).withColumnRenamed("chapter_id", "record")).withColumnRenamed("record", "chapter_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return site_lines.repeated_lines(chapters(spark, folder), table(spark, folder, "books")).select("chapter_id", "paragraph_index").distinct()


def p4_templates(spark: SparkSession, folder: str) -> DataFrame:
    return site_lines.line_templates(chapters(spark, folder), table(spark, folder, "books")).select("site", "template", "chapters")


def p4_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return site_lines.without_repeated_lines(chapters(spark, folder), table(spark, folder, "books"))


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """Content elements of chapters and of footnotes: kind, record, index, text."""
    notes = table(spark, folder, "footnotes").where("footnote_id is not null")
    parts = [
        elements(frame, id_column).select(F.lit(kind).alias("kind"), F.col(id_column).alias("record"), F.col("paragraph_index").alias("index"), "text")
        for kind, frame, id_column in (("chapter", chapters(spark, folder), "chapter_id"), ("footnote", notes, "footnote_id"))
    ]
    return parts[0].unionByName(parts[1])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalikes.same_looking(_texts(spark, folder)).select("record_a", "index_a", "record_b", "index_b")


def p5_consistent(spark: SparkSession, folder: str) -> DataFrame:
    changed = lookalikes.consistent(_texts(spark, folder))
    return changed.where("form <> text").select("kind", "record", "index", "form").distinct()


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return eval_leaks.leaks(documents(spark, folder), table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p6_leaked_items(spark: SparkSession, folder: str) -> DataFrame:
    found = eval_leaks.leaks(documents(spark, folder), table(spark, folder, "eval_items"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("covered_chars").alias("most_covered"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return source_mix.Mix(documents(spark, folder), table(spark, folder, "mix_targets")).copies()


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return source_mix.Mix(documents(spark, folder), table(spark, folder, "mix_targets")).shares()


def p7_exact_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The mixes as large as their shares allow."""
    return source_mix.Mix(documents(spark, folder), table(spark, folder, "mix_targets"), keep="shares").shares()


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncated(documents(spark, folder)).select("doc_id").distinct()


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncation_rates(documents(spark, folder))


def p8_limits(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.length_spikes(documents(spark, folder))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n[0] == "p" and n[1:2].isdigit() and callable(f)}


_LINES = r"""
WITH sites AS (
  SELECT DISTINCT book_id, lower(regexp_extract(source_url, '^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]+)', 1)) AS site
  FROM books WHERE source_url IS NOT NULL
), pages AS (
  SELECT DISTINCT site, chapter_id, content FROM chapters JOIN sites USING (book_id) WHERE site <> ''
), pieces AS (
  SELECT site, chapter_id, unnest(content) AS element, generate_subscripts(content, 1) - 1 AS paragraph_index FROM pages
), lines AS (
  SELECT site, chapter_id, paragraph_index, trim(l, chr(32) || chr(9) || chr(12288) || chr(160)) AS line
  FROM (SELECT site, chapter_id, paragraph_index, unnest(string_split(element, chr(10))) AS l FROM pieces)
), marked AS (
  SELECT *, regexp_replace(line, '[0-9]+', chr(10), 'g') AS template FROM lines WHERE line <> ''
), repeated AS (
  SELECT site, template, count(DISTINCT chapter_id) AS chapters FROM marked GROUP BY site, template HAVING count(DISTINCT chapter_id) >= 5
)
"""


_CLEANED = r"""
, drops AS (SELECT DISTINCT chapter_id, template FROM marked JOIN repeated USING (site, template)),
 once AS (SELECT DISTINCT ON (chapter_id) chapter_id, content FROM chapters WHERE chapter_id IS NOT NULL),
 broken AS (SELECT chapter_id, paragraph_index, unnest(string_split(element, chr(10))) AS l, generate_subscripts(string_split(element, chr(10)), 1) AS i FROM (SELECT chapter_id, unnest(content) AS element, generate_subscripts(content, 1) AS paragraph_index FROM once)),
 kept AS (SELECT b.*, d.template IS NOT NULL AS gone FROM (SELECT *, regexp_replace(trim(l, chr(32) || chr(9) || chr(12288) || chr(160)), '[0-9]+', chr(10), 'g') AS template FROM broken) b LEFT JOIN drops d USING (chapter_id, template)),
 joined AS (SELECT chapter_id, paragraph_index, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '') AS element FROM kept GROUP BY ALL),
 rebuilt AS (SELECT chapter_id, list(element ORDER BY paragraph_index) AS content FROM joined GROUP BY chapter_id),
 counts AS (SELECT chapter_id, count(*) AS removed FROM drops GROUP BY chapter_id)
SELECT chapter_id, CASE WHEN len(o.content) > 0 THEN r.content ELSE o.content END AS content, CAST(coalesce(removed, 0) AS INTEGER) AS removed FROM once o LEFT JOIN rebuilt r USING (chapter_id) LEFT JOIN counts USING (chapter_id)
"""


_WINDOWS = """
WITH elements AS (SELECT DISTINCT chapter_id, unnest(content) AS text FROM chapters WHERE chapter_id IS NOT NULL),
 long AS (SELECT chapter_id, text, unnest(generate_series(1, length(text) - 99)) AS i FROM elements WHERE length(text) >= 100),
 held AS (SELECT DISTINCT chapter_id, substr(text, i, 100) AS w FROM long),
 shared AS (SELECT w FROM held GROUP BY w HAVING count(*) > 1),
 members AS (SELECT chapter_id, w FROM held JOIN shared USING (w))
SELECT DISTINCT a.chapter_id AS chapter_id_a, b.chapter_id AS chapter_id_b FROM members a JOIN members b ON a.w = b.w AND a.chapter_id < b.chapter_id
"""

_SHARE = """
WITH elements AS (SELECT DISTINCT chapter_id, idx, text FROM (SELECT chapter_id, unnest(content) AS text, generate_subscripts(content, 1) AS idx FROM chapters WHERE chapter_id IS NOT NULL)),
 windows AS (SELECT chapter_id, idx, i, substr(text, i, 100) AS w FROM (SELECT chapter_id, idx, text, unnest(generate_series(1, length(text) - 99)) AS i FROM elements WHERE length(text) >= 100)),
 shared AS (SELECT w FROM windows GROUP BY w HAVING count(DISTINCT chapter_id) > 1),
 hits AS (SELECT chapter_id, i, lag(i) OVER (PARTITION BY chapter_id, idx ORDER BY i) AS p FROM (SELECT DISTINCT chapter_id, idx, i FROM windows JOIN shared USING (w))),
 covered AS (SELECT chapter_id, sum(CASE WHEN p IS NULL THEN 100 ELSE least(100, i - p) END) AS n FROM hits GROUP BY chapter_id),
 sizes AS (SELECT chapter_id, max(CAST(coalesce(list_sum(list_transform(content, lambda x: coalesce(length(x), 0))), 0) AS BIGINT)) AS n_chars FROM chapters WHERE chapter_id IS NOT NULL AND content IS NOT NULL GROUP BY chapter_id)
SELECT chapter_id, n_chars, CAST(coalesce(n, 0) AS BIGINT) AS shared_chars, CASE WHEN n_chars > 0 THEN coalesce(n, 0) / n_chars ELSE 0.0 END AS share FROM sizes LEFT JOIN covered USING (chapter_id)
"""

_WIDE = "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ０１２３４５６７８９"
_NARROW = "abcdefghijklmnopqrstuvwxyz" * 2 + "0123456789"
_LEAKS = f"""
WITH d AS (SELECT DISTINCT doc_id, regexp_replace(lower(translate(text, '{_WIDE}', '{_NARROW}')), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS t FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
 e AS (SELECT DISTINCT item_id, regexp_replace(lower(translate(text, '{_WIDE}', '{_NARROW}')), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS t FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL),
 dg AS (SELECT DISTINCT doc_id, substr(t, i, 30) AS g FROM (SELECT doc_id, t, unnest(generate_series(1, length(t) - 29)) AS i FROM d WHERE length(t) >= 30)),
 eg AS (SELECT item_id, i, substr(t, i, 30) AS g FROM (SELECT item_id, t, unnest(generate_series(1, length(t) - 29)) AS i FROM e WHERE length(t) >= 30)),
 hits AS (SELECT doc_id, item_id, i, lag(i) OVER (PARTITION BY doc_id, item_id ORDER BY i) AS p FROM eg JOIN dg USING (g)),
 covered AS (SELECT doc_id, item_id, sum(CASE WHEN p IS NULL THEN 30 ELSE least(30, i - p) END) AS n FROM hits GROUP BY doc_id, item_id)
"""

_LIMITS = """
WITH m AS (SELECT source, unnest([{'measure': 'chars', 'size': length(text)}, {'measure': 'bytes', 'size': octet_length(encode(text))}], recursive := true) FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
 top AS (SELECT source, measure, max(size) AS high FROM m GROUP BY ALL)
SELECT source, measure, CAST(high - 3 AS INTEGER) AS low, CAST(high AS INTEGER) AS high, count(*) FILTER (size >= high - 3) AS n FROM m JOIN top USING (source, measure) GROUP BY source, measure, high
HAVING count(*) FILTER (size >= high - 3) >= 3 AND count(*) FILTER (size >= high - 3) >= 3 * count(*) FILTER (size < high - 3 AND size >= high - 43)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _WINDOWS,
        "p3_share": _SHARE,
        "p4_found": _LINES + "SELECT DISTINCT chapter_id, CAST(paragraph_index AS INTEGER) AS paragraph_index FROM marked JOIN repeated USING (site, template)",
        "p4_templates": _LINES + "SELECT site, template, chapters FROM repeated",
        "p4_cleaned": _LINES + _CLEANED,
        "p6_found": _LEAKS + "SELECT doc_id, item_id FROM covered JOIN e USING (item_id) WHERE 2 * n >= length(t)",
        "p6_leaked_items": _LEAKS + "SELECT item_id, count(*) AS documents, CAST(max(n) AS INTEGER) AS most_covered FROM covered JOIN e USING (item_id) WHERE 2 * n >= length(t) GROUP BY item_id",
        "p8_limits": _LIMITS,
    }

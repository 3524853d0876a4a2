"""Search: prefix terms over token arrays, literal matches with positions, excerpts, anchors of notes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.codepoints import sliced
from lectern.functions.text import excerpt

#: Characters of a search term that count, and terms are runs of letters, numbers and marks.
LONGEST_TERM = 80
_TERM = r"[\p{L}\p{N}\p{M}]+"
SCOPES = ("ALL", "BODY", "TITLES")


def terms(query: str) -> list[str]:
    """Prefix terms of a query: quotes and asterisks go, each run of word characters is a term of at most LONGEST_TERM characters."""
    import regex

    return [t[:LONGEST_TERM].lower() for t in regex.findall(_TERM, re.sub(r'["*]', "", query))]


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TERM), F.lit(0)))


def content_index(chapters: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, chapter_id, paragraph_index, title, chapter_title, content and their token arrays): one row for each paragraph."""
    rows = chapters.select("book_id", "chapter_id", F.col("title").alias("chapter_title"), F.posexplode("content").alias("paragraph_index", "content"))
    titled = rows.where("content is not null and content <> ''").join(books.select("book_id", F.col("title_zh").alias("title")), "book_id")
    return titled.withColumns({"title_tokens": tokens(F.col("title")), "chapter_tokens": tokens(F.col("chapter_title")), "content_tokens": tokens(F.col("content"))})


def _begins(word: str):
    return lambda token: F.startswith(token, F.lit(word))


def matching(index: DataFrame, query: str, scope: str = "ALL", books: DataFrame | None = None) -> DataFrame:
    """Paragraphs that hold every term of a query as the beginning of a token.

    ALL: in any column; BODY: in the content; TITLES: in a title. A run of
    ideographs is one token, so a term finds only its beginning. Columns of ids
    are not searched. No terms, or an empty table of books, give nothing.
    """
    if scope not in SCOPES:
        raise ValueError(scope)
    fields = {"ALL": ("title_tokens", "chapter_tokens", "content_tokens"), "BODY": ("content_tokens",), "TITLES": ("title_tokens", "chapter_tokens")}[scope]
    condition = F.lit(bool(words := terms(query)))
    for word in words:
        somewhere = F.lit(False)
        for f in fields:
            somewhere = somewhere | F.exists(f, _begins(word))
        condition = condition & somewhere
    hits = index.where(condition)
    return hits if books is None else hits.join(books.select("book_id").distinct(), "book_id", "left_semi")


def first_hits(hits: DataFrame, most: int = 80) -> DataFrame:
    """The first hits in the order of the library."""
    return hits.orderBy("book_id", "chapter_id", "paragraph_index").limit(most)


def _find_all(batches: Iterator[pa.RecordBatch], keep: list[str] | None = None) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        at, starts = [], []
        for i, (text, needle) in enumerate(zip(batch.column("text").to_pylist(), batch.column("needle").to_pylist())):
            if text and needle:
                low, sought, p, here = text.lower(), needle.lower(), 0, []
                if len(low) != len(text):  # a letter whose lower case is longer would shift positions
                    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
                while (p := low.find(sought, p)) >= 0:
                    here.append(p)
                    p += len(sought)
                if here:
                    at.append(i)
                    starts.append(here)
        rows = batch.select(keep or batch.schema.names).take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(starts, pa.list_(pa.int32()))], [*rows.schema.names, "starts"])


def occurrences(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and the starts, from 0, of each of the rows (with text and needle) that has an occurrence; those don't overlap, and case doesn't count."""
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.select(*keep).dtypes)
    return rows.mapInArrow(lambda batches: _find_all(batches, [*keep]), f"{kinds}, starts array<int>")


def find_all(rows: DataFrame) -> DataFrame:
    """Rows (with text and needle) for each occurrence that doesn't overlap the one before, without regard to case: start from 0.

    Workers send each text once; it is repeated for its occurrences row by row in the JVM.
    """
    return occurrences(rows, *rows.columns).select(*rows.columns, F.explode("starts").alias("start"))


def in_book(paragraphs: DataFrame, needle: str, most: int = 500) -> DataFrame:
    """Literal matches in document order with excerpts; needles under two characters after trimming find nothing."""
    needle = needle.strip()
    rows = paragraphs.where(F.contains(F.lower("text"), F.lit(needle.lower())) & F.lit(len(needle) >= 2)).withColumn("needle", F.lit(needle))
    hits = find_all(rows).withColumn("excerpt", excerpt(F.col("text"), F.col("start"), F.length("needle"))).drop("text", "needle")
    return hits.orderBy("chapter_id", "paragraph_index", "start").limit(most)


def marked(text: Column, needle: Column) -> Column:
    """Occurrences between <b> and </b>."""
    return F.regexp_replace(text, F.concat(F.lit(r"(?iu)(\Q"), needle, F.lit(r"\E)")), F.lit("<b>$1</b>"))


def unmarked(snippet: Column) -> Column:
    return F.regexp_replace(snippet, "</?b>", "")


def note_anchors(paragraph: Column, start: Column, end: Column, context: int = 32) -> Column:
    """What a note stores of its place: excerpt, context on both sides, digest of the paragraph."""
    a = F.greatest(start - context, F.lit(0))
    return F.struct(
        F.substring(paragraph, start + 1, end - start).alias("excerpt"), F.substring(paragraph, a + 1, start - a).alias("prefix"),
        F.substring(paragraph, end + 1, F.lit(context)).alias("suffix"), F.sha2(paragraph, 256).alias("paragraph_hash"),
    )


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate places of a note's excerpt in one paragraph, scored by context and distance."""
    for batch in batches:
        at, starts, scores = [], [], []
        columns = [batch.column(c).to_pylist() for c in ("text", "excerpt", "prefix", "suffix", "candidate_index", "paragraph_index")]
        for i, (text, sought, prefix, suffix, here, there) in enumerate(zip(*columns)):
            p = -1
            while sought and text and (p := text.find(sought, p + 1)) >= 0:
                left, right = text[:p], text[p + len(sought) :]
                n = next((k for k, (a, b) in enumerate(zip(reversed(left), reversed(prefix or ""))) if a != b), min(len(left), len(prefix or "")))
                m = next((k for k, (a, b) in enumerate(zip(right, suffix or "")) if a != b), min(len(right), len(suffix or "")))
                at.append(i)
                starts.append(p)
                scores.append(n + m - abs(here - there))
        rows = batch.take(pa.array(at, pa.int64())).select(["id", "candidate_index"])
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(starts, pa.int32()), pa.array(scores, pa.int32())], ["id", "candidate_index", "start", "score"])


def resolved_anchors(notes: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(id, state, paragraph_index, start, end): where each note stands now.

    ``notes``: id, chapter_id, paragraph_index, excerpt, selection_start,
    selection_end, prefix, suffix, paragraph_hash (nulls allowed but for id).
    EXACT: the range still reads as the excerpt, or the paragraph is unchanged.
    RELOCATED: the occurrence of the excerpt in the chapter with the best
    score, common context less the distance in paragraphs, the first on ties.
    FALLBACK: the beginning of the note's paragraph.
    """
    here = paragraphs.select("chapter_id", F.col("paragraph_index").alias("candidate_index"), "text")
    own = notes.join(here.withColumnRenamed("candidate_index", "paragraph_index"), ["chapter_id", "paragraph_index"], "left")
    reads = F.substring("text", F.col("selection_start") + 1, F.col("selection_end") - F.col("selection_start")) == F.col("excerpt")
    exact = own.withColumn("exact", F.coalesce(reads, F.lit(False)) | F.coalesce(F.sha2("text", 256) == F.col("paragraph_hash"), F.lit(False))).drop("text")
    lost = exact.where("not exact and excerpt <> ''")
    # only paragraphs that hold the excerpt are sent to the scorer
    candidates = lost.join(here, "chapter_id").where(F.contains("text", F.col("excerpt")))
    scored = candidates.select("id", "text", "excerpt", "prefix", "suffix", "candidate_index", "paragraph_index").mapInArrow(_scored, "id bigint, candidate_index int, start int, score int")
    best = scored.groupBy("id").agg(F.max_by(F.struct("candidate_index", "start"), F.struct(F.col("score"), -F.col("candidate_index"), -F.col("start"))).alias("b"))
    found = exact.join(best, "id", "left")
    state = F.when(F.col("exact"), "EXACT").when(F.col("b").isNotNull(), "RELOCATED").otherwise("FALLBACK")
    return found.select(
        "id", state.alias("state"), F.when(F.col("exact") | F.col("b").isNull(), F.col("paragraph_index")).otherwise(F.col("b.candidate_index")).alias("paragraph_index"),
        F.when(F.col("exact"), F.col("selection_start")).otherwise(F.coalesce("b.start", F.lit(0))).alias("range_start"),
        F.when(F.col("exact"), F.col("selection_end")).otherwise(F.coalesce(F.col("b.start") + F.length("excerpt"), F.lit(0))).alias("range_end"),
    )


def located_once(texts: DataFrame, pieces: DataFrame, key: str) -> DataFrame:
    """(key, piece_id, start): pieces that stand exactly once in the text of their key."""
    both = texts.select(key, "text").join(pieces.select(key, "piece_id", "piece"), key)
    at = F.position(F.col("piece"), F.col("text"))
    again = F.position(F.col("piece"), F.col("text"), at + 1)
    return both.where((F.col("piece") != "") & (at > 0) & (again == 0)).select(key, "piece_id", (at - 1).alias("start"))

"""Problem 8: texts cut off by a field limit or a broken transfer.

For every source the lengths of its texts, in characters and in bytes, are
tested for a spike at the maximum; a text of a spike's length without terminal
punctuation was cut there. Transfers break at any length: such a text ends in
the debris of a tag, an entity or a character, or in a line that is neither
finished nor one of the forms in which a text may rightly end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.codepoints import codepoints, sliced, strings

#: Lengths below the maximum that belong to its spike: a cut inside a character of up to 4 bytes, a mark after the cut.
BAND = 3
#: Lengths below the band that say how dense lengths are there; a spike has LEAST texts and RATIO times theirs.
BEFORE, LEAST, RATIO = 40, 3, 3.0
#: Share of all sentences from which their first two characters count as a way to begin a sentence.
OPENING_SHARE = 0.001
#: Longest closing line without punctuation (a body, a place, a name), in characters.
CLOSING = 16

# The ends of sentences and the forms of endings.
_TERMINAL = r"(?<!\.\.)[。．.！!？?][”’」』\"'»）)\]]*$|[”」』\"»]$"
_GERMAN_QUOTE = r"„[^„“]*“$"
_BRACKETED = r"(?:（[^（）]*）|\([^()]*\)|【[^【】]*】|〔[^〔〕]*〕|\[[^\[\]]*\])$"
#: White space, and characters without width that stand for it.
_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff\u200b"
_DEBRIS = r"(?:&#?[A-Za-z0-9]{0,8}|</?[A-Za-z]?[^<>]{0,80}|\x{FFFD}+)$"
_ENDINGS = (
    r"^(?:此致|敬礼)$"
    r"|^.{0,12}[0-9〇零一二三四五六七八九十廿卅]{1,4}年(?:[0-9〇零一二三四五六七八九十廿卅]{1,3}月)?(?:[0-9〇零一二三四五六七八九十廿卅]{1,3}日)?(?:夜|晨|于.{2,10})?$"
    r"|^.{0,40}[0-9]{4}-[0-9]{2}-[0-9]{2}$"
    r"|^\s*(?:[0-9]{1,3}|[一二三四五六七八九十]{1,3})[.、．)）]\s*[^，,。；;：:]{1,24}(?<![的了和与把被在是])$"
    r"|^附[：:][^，。；]{1,30}$"
    r"|^[—–-]\s*(?:\p{Lu}\.\s*)*\p{Lu}[\p{L}'-]*$"
    r"|^\p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+)?,? (?:\d{1,2}\.? )?(?:\p{L}+ )?[0-9]{4}$"
)


def _openings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the first two characters of all sentences of a task's texts; those of lines aren't counted, as closing lines are not sentences."""
    ends = np.array([ord(c) for c in "。！？”"], np.uint32)
    space = np.array([ord(c) for c in " 　\r\t\n"], np.uint32)
    total: dict[int, int] = {}
    for batch in sliced(batches, "text"):
        points, offsets = codepoints(strings(batch.column("text")))
        n = len(points)
        if n < 2:
            continue
        first = np.zeros(n + 1, bool)
        first[1:][np.isin(points, ends)] = True
        first[offsets[:-1]] = True
        at = np.flatnonzero(first[: n - 1])
        of = np.searchsorted(offsets, at, side="right")
        at = at[(at + 2 <= offsets[np.minimum(of, len(offsets) - 1)])]
        at = at[~np.isin(points[at], ends) & ~np.isin(points[at], space) & (points[at] > 0x2E80)]
        keys, counts = np.unique((points[at].astype(np.int64) << 21) | points[at + 1], return_counts=True)
        for k, c in zip(keys.tolist(), counts.tolist()):
            total[k] = total.get(k, 0) + c
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["pair", "n"])


def sentence_openings(documents: DataFrame) -> list[str]:
    """First two characters of at least OPENING_SHARE of all sentences: fewer than 1 / OPENING_SHARE of them."""
    counts = documents.select("text").where("text is not null").mapInArrow(_openings, "pair bigint, n bigint")
    # the row of the null pair is the total; at most 1 / OPENING_SHARE others can reach the share
    top = counts.rollup("pair").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("pair")).limit(int(1 / OPENING_SHARE) + 1).collect()
    total = max((r[1] for r in top if r[0] is None), default=0)
    return sorted(chr(r[0] >> 21) + chr(r[0] & 0x1FFFFF) for r in top if r[0] is not None and r[1] >= OPENING_SHARE * total)


def length_spikes(documents: DataFrame) -> DataFrame:
    """(source, measure, low, high, n): the lengths from low to high, chars or bytes, at which a source cuts its texts.

    Documents without source or text take no part; a source whose longest
    texts don't stand out has no row.
    """
    sized = documents.where("source is not null and text is not null").select(
        "source", F.explode(F.array(F.struct(F.lit("chars").alias("measure"), F.length("text").alias("size")), F.struct(F.lit("bytes").alias("measure"), F.octet_length("text").alias("size")))).alias("m")
    )
    histogram = sized.groupBy("source", "m.measure", "m.size").agg(F.count(F.lit(1)).alias("n"))
    top = histogram.groupBy("source", "measure").agg(F.max("size").alias("high"))
    near = histogram.join(top, ["source", "measure"]).where(F.col("size") >= F.col("high") - BAND - BEFORE)
    in_band = F.col("size") >= F.col("high") - BAND
    bands = near.groupBy("source", "measure", "high").agg(F.sum(F.when(in_band, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(in_band, 0).otherwise(F.col("n"))).alias("before"))
    return bands.where((F.col("n") >= LEAST) & (F.col("n") >= RATIO * F.col("before"))).select("source", "measure", (F.col("high") - BAND).alias("low"), "high", "n")


def _with_ends(docs: DataFrame, openings: list[str]) -> DataFrame:
    """doc_id, source, chars, bytes, and whether the text is empty, ends in debris, in terminal punctuation, in an allowed ending.

    The whole last line decides, and how the line above it ends, however long
    they are. Step by step, as each step's columns are used several times by the next.
    """
    space = F.lit(_SPACE)
    whole = docs.select("doc_id", "source", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), F.rtrim("text", space).alias("text"))
    last = whole.select("*", F.substring_index("text", "\n", -1).alias("last"))
    lines = last.select(
        "doc_id", "source", "chars", "bytes", (F.length("text") == 0).alias("empty"), F.contains("text", F.lit("\n")).alias("broken"), F.ltrim("last", space).alias("line"),
        F.substring_index(F.rtrim(F.left("text", F.length("text") - F.length("last")), space), "\n", -1).alias("above"),
    )
    like = lambda c, pattern: F.regexp_like(c, F.lit(pattern))
    terminal = like("line", _TERMINAL) | like("line", _GERMAN_QUOTE) | like("line", _BRACKETED)
    finished_above = like("above", r"[。！？.!?”“）】〕)\]]\s*$")
    bare = (F.length("line") <= CLOSING) & like("line", r"^[\p{IsHan}·]+$") & ~F.contains("line", F.lit("的")) & ~F.contains("line", F.lit("了"))
    begins = F.substring("line", 1, 2).isin(openings) if openings else F.lit(False)
    signature = bare & ((finished_above & ~begins) | like("above", r"^\s*(?:敬礼|此致)\s*$"))
    ending = F.col("broken") & (signature | like("line", _ENDINGS))
    return lines.select("doc_id", "source", "chars", "bytes", "empty", like("line", _DEBRIS).alias("debris"), terminal.alias("terminal"), ending.alias("ending"))


def truncated(documents: DataFrame) -> DataFrame:
    """(doc_id, source, reason): every document whose text breaks off; reason is limit, debris or open end.

    Null texts and empty ones break off nowhere. A null source is a source of
    its own without limits. Repeats of a truncated text are truncated too.
    """
    docs = documents.select("doc_id", "source", "text").where("doc_id is not null and text is not null")
    spikes = length_spikes(documents).groupBy("source").agg(F.collect_list(F.struct("measure", "low", "high")).alias("limits"))
    marked = _with_ends(docs, sentence_openings(documents))
    # a row for each source: a few bytes for each value of a column, joined by size as AQE sees fit
    at_limit = F.exists(F.coalesce("limits", F.array().cast("array<struct<measure:string,low:int,high:int>>")), lambda s: F.when(s.measure == "chars", F.col("chars").between(s.low, s.high)).otherwise(F.col("bytes").between(s.low, s.high)))
    judged = marked.join(spikes, "source", "left").withColumn("limit", at_limit)
    reason = (
        F.when(F.col("empty"), None)
        .when(F.col("debris"), "debris")
        .when(F.col("limit") & ~F.col("terminal"), "limit")
        .when(~F.col("terminal") & ~F.col("ending"), "open end")
    )
    return judged.select("doc_id", "source", reason.alias("reason")).where("reason is not null")


def truncation_rates(documents: DataFrame) -> DataFrame:
    """(source, documents, truncated, at_limit, debris, open_end, rate): how often each source truncates, and in which way, the null source included.

    A document that stands several times counts for each row; without reason it
    is whole.
    """
    cut = truncated(documents).groupBy("doc_id").agg(F.min("reason").alias("reason"))
    known = documents.where("doc_id is not null and text is not null").select("doc_id", "source").join(cut, "doc_id", "left")
    of = lambda reason: F.count_if(F.col("reason").eqNullSafe(reason))
    counts = known.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count("reason").alias("truncated"), of("limit").alias("at_limit"), of("debris").alias("debris"), of("open end").alias("open_end"))
    return counts.withColumn("rate", F.col("truncated") / F.col("documents"))

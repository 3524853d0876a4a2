"""Problem 3: long passages that stand letter by letter in more than one record.

Sliding sentence spans. A span begins after a sentence end and takes in the
sentences that follow, over a fixed number of characters. Where a stretch has
no sentence end, the least hash of each window of k-grams stands in for one, so
that every run of ``SPAN`` equal characters holds a common beginning among its
first ``SPAN - REACH`` characters. Records that share a beginning's ``REACH``
characters are found by one hash aggregation; only their windows of ``SPAN``
characters around such beginnings are then compared, by 128 bits of hash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.codepoints import Rolling, codepoints, flatten, sliced, sliding_min, strings
from lectern.llm.tables import one_delivery
from lectern.session import cut_lineage

#: Characters of the shortest run that counts, and of the span hashed from each beginning.
SPAN, REACH = 100, 50
#: k-grams whose least hash, in each window of so many, begins a span inside a stretch without sentence ends.
GRAM, WINDOW = 8, SPAN - REACH - 8
#: Seed of the second half of a window's hash.
CHECK = 0x51ED
#: Sentence ends.
_MARKS = "。！？；.!?;…\n"
_ENDS = np.array(sorted(map(ord, _MARKS)), np.uint32)
_WINDOW = ["window", "check"]
_SENTENCE = re.compile(f"[^{_MARKS}]*[{_MARKS}]+|[^{_MARKS}]+$")


def span_starts(points: np.ndarray, offsets: np.ndarray, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings of spans with REACH characters left in their text: (positions, text of each).

    Whether a position begins a span depends only on the characters from
    SPAN - REACH before it to just after it, so equal passages have equal
    beginnings wherever they stand.
    """
    n = len(points)
    ends = np.isin(points, _ENDS)
    begins = np.zeros(n + 1, bool)
    begins[1:][ends] = True
    begins[offsets[:-1]] = True  # the text's own beginning; an extra beginning does no harm
    marks = np.flatnonzero(np.concatenate((begins[:n], [True])))
    gaps = np.diff(np.concatenate(([0], marks)))
    long = np.flatnonzero(gaps > SPAN - REACH)
    if len(long):
        grams = rolling.all(GRAM)
        least = sliding_min(grams, WINDOW)
        inside = np.zeros(n + 1, np.int32)
        np.add.at(inside, marks[long] - gaps[long], 1)
        np.add.at(inside, marks[long], -1)
        inside = np.cumsum(inside)[:n] > 0
        at = np.flatnonzero(inside[: len(least)])
        if len(at):
            # the first place of the least hash of the window that begins at each place of a long stretch
            view = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
            for part in np.array_split(at, max(1, len(at) // 200_000)):
                begins[part + np.argmin(view[part], axis=1)] = True
    starts = np.flatnonzero(begins[:n])
    of = np.searchsorted(offsets, starts, side="right") - 1
    keep = starts + REACH <= offsets[of + 1]
    return starts[keep], of[keep]


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of records (key, content): (span hash, key) for each span of an element of at least SPAN characters."""
    for batch in sliced(batches, "content"):
        texts, rows, _ = flatten(batch.column("content"))
        points, offsets = codepoints(texts)
        starts, of = span_starts(points, offsets, rolling := Rolling(points))
        long = np.diff(offsets)[of] >= SPAN
        starts, of = starts[long], of[long]
        keys = np.asarray(batch.column("key"))[rows[of]]
        pairs = np.unique(np.stack((rolling.at(starts, REACH).view(np.int64), keys), 1), axis=0) if len(starts) else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["span", "key"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of records (record, content, spans): every window of SPAN characters that holds a span of the list."""
    for batch in sliced(batches, "content"):
        texts, rows, index = flatten(batch.column("content"))
        points, offsets = codepoints(texts)
        starts, of = span_starts(points, offsets, rolling := Rolling(points))
        lists = batch.column("spans")
        wanted = np.stack((np.asarray(pa.compute.list_parent_indices(lists), np.int64), np.asarray(lists.flatten(), np.int64)), 1)
        have = np.stack((rows[of], rolling.at(starts, REACH).view(np.int64)), 1)
        kind = np.dtype([("row", np.int64), ("span", np.int64)])
        hit = np.isin(np.ascontiguousarray(have).view(kind)[:, 0], np.ascontiguousarray(wanted).view(kind)[:, 0]) if len(have) else np.zeros(0, bool)
        starts, of = starts[hit], of[hit]
        at = (starts[:, None] - np.arange(SPAN - REACH + 1)[None, :]).ravel()
        of = np.repeat(of, SPAN - REACH + 1)
        fits = (at >= offsets[of]) & (at + SPAN <= offsets[of + 1])
        at, first = np.unique(at[fits], return_index=True)
        of = of[fits][first]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(rolling.at(at, SPAN).view(np.int64)),
                pa.array(Rolling(points, CHECK).at(at, SPAN).view(np.int64)),
                strings(batch.column("record")).take(pa.array(rows[of])).cast(pa.string()),
                pa.array(index[of].astype(np.int32)),
                pa.array((at - offsets[of]).astype(np.int32)),
            ],
            ["window", "check", "record", "paragraph_index", "start"],
        )


def shared_windows(records: DataFrame) -> DataFrame:
    """(window, check, record, paragraph_index, start): windows of SPAN characters, by their hash, around beginnings that more than one record holds.

    ``records`` has record (string) and content (array of strings); rows with a
    null in either have no windows, and repeated rows of one record count once.
    Every element is one text; empty and short ones share nothing.
    """
    records = records.select("record", "content").where(F.col("record").isNotNull() & F.col("content").isNotNull())
    keyed = records.withColumn("key", F.xxhash64("record"))
    # two numbers for each span, used twice: written once, instead of hashing the texts again
    spans = cut_lineage(keyed.select("key", "content").mapInArrow(_spans, "span bigint, key bigint"))
    # partial aggregation keeps one row for a hot span in each task, so a passage that stands everywhere isn't gathered in one
    repeated = spans.groupBy("span").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least <> most").select("span")
    holders = spans.join(repeated, "span").groupBy("key").agg(F.collect_set("span").alias("spans"))
    return keyed.join(holders, "key").select("record", "content", "spans").mapInArrow(_windows, "window bigint, check bigint, record string, paragraph_index int, start int")


def shared_pairs(records: DataFrame) -> DataFrame:
    """(record_a, record_b), a < b: records that share SPAN consecutive characters of one element each.

    A passage's windows have the same holders almost all along; windows with
    equal holders (count and two hash sums over distinct holders) are joined
    once, so a pair is made about once for each passage, not for each window.
    """
    held = cut_lineage(shared_windows(records).select(*_WINDOW, "record").distinct())
    groups = (
        held.groupBy(*_WINDOW)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("record").cast("decimal(38,0)")).alias("s"), F.sum(F.xxhash64("record", F.lit(7)).cast("decimal(38,0)")).alias("t"))
        .where("n > 1")
        .groupBy("n", "s", "t")
        .agg(F.min(F.struct(*_WINDOW)).alias("w"))
        .select("w.*")
    )
    members = held.join(groups, _WINDOW)
    a, b = members.withColumnRenamed("record", "record_a"), members.withColumnRenamed("record", "record_b")
    return a.join(b, _WINDOW).where("record_a < record_b").select("record_a", "record_b").distinct()


def shared_share(records: DataFrame) -> DataFrame:
    """(record, n_chars, shared_chars, share): how much of each record stands in another one too.

    Every record with content has a row; without text the share is 0.
    """
    windows = cut_lineage(shared_windows(records).distinct())
    repeated = windows.groupBy(*_WINDOW).agg(F.min("record").alias("x"), F.max("record").alias("y")).where("x <> y").select(*_WINDOW)
    hits = windows.join(repeated, _WINDOW).select("record", "paragraph_index", "start").distinct()
    # windows of one element in order: each adds what the one before didn't cover
    before = F.lag("start").over(Window.partitionBy("record", "paragraph_index").orderBy("start"))
    covered = hits.select("record", F.least(F.lit(SPAN), F.coalesce(F.col("start") - before, F.lit(SPAN))).alias("new")).groupBy("record").agg(F.sum("new").alias("shared_chars"))
    sizes = (
        records.where("record is not null and content is not null")
        .select("record", F.aggregate("content", F.lit(0).cast("bigint"), lambda s, x: s + F.coalesce(F.length(x), F.lit(0))).alias("n"))
        .groupBy("record")
        .agg(F.max("n").alias("n_chars"))
    )
    shared = F.coalesce("shared_chars", F.lit(0).cast("bigint"))
    return sizes.join(covered, "record", "left").select("record", "n_chars", shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(0.0).alias("share"))


def _without_covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of records (record, content, runs): content without the sentences that lie in runs held before and touch none held here first."""
    for batch in batches:
        out: list[list[str | None]] = []
        removed: list[int] = []
        for content, runs in zip(batch.column("content").to_pylist(), batch.column("runs").to_pylist()):
            of: dict[int, list[dict]] = {}
            for r in runs:
                of.setdefault(r["paragraph_index"], []).append(r)
            n, texts = 0, list(content)
            for i, here in of.items():
                gone, kept = [r for r in here if not r["first"]], [r for r in here if r["first"]]
                pieces = [
                    (m.group(), any(r["start"] <= m.start() and m.end() <= r["past"] for r in gone) and not any(r["start"] < m.end() and m.start() < r["past"] for r in kept))
                    for m in _SENTENCE.finditer(texts[i])
                ]
                n += sum(drop for _, drop in pieces)
                texts[i] = "".join(x for x, drop in pieces if not drop)
            out.append(texts)
            removed.append(n)
        yield pa.RecordBatch.from_arrays([batch.column("record").cast(pa.string()), pa.array(out, pa.list_(pa.string())), pa.array(removed, pa.int32())], ["record", "content", "removed"])


def without_shared(records: DataFrame) -> DataFrame:
    """(record, content, removed): each record without the sentences of passages that an earlier record holds, and their number.

    Of a window's holders the least record is the first and keeps every
    sentence that the window touches, so each passage stays whole somewhere;
    elsewhere the sentences that lie in such windows go. Sentences of which a
    part isn't shared stay; emptied elements stay as well, so positions hold. A
    record with several rows has the content with the least hash; a null one stays null.
    """
    once = one_delivery(records.withColumnRenamed("record", "chapter_id")).withColumnRenamed("chapter_id", "record")
    windows = cut_lineage(shared_windows(once).distinct())
    holders = windows.groupBy(*_WINDOW).agg(F.min("record").alias("least"), F.max("record").alias("most")).where("least <> most").select(*_WINDOW, "least")
    hits = windows.join(holders, _WINDOW).select("record", "paragraph_index", "start", (F.col("record") == F.col("least")).alias("first")).distinct()
    # windows that touch are one run
    place = ["record", "paragraph_index", "first"]
    w = Window.partitionBy(*place).orderBy("start")
    begins = F.coalesce(F.col("start") - F.lag("start").over(w) > SPAN, F.lit(True)).cast("int")
    runs = hits.withColumn("begins", begins).withColumn("run", F.sum("begins").over(w)).groupBy(*place, "run").agg(F.min("start").alias("start"), (F.max("start") + SPAN).alias("past"))
    listed = runs.groupBy("record").agg(F.collect_list(F.struct("paragraph_index", "first", "start", "past")).alias("runs"), F.bool_and("first").alias("all_first")).where("not all_first").select("record", "runs")
    cleaned = once.join(listed, "record").mapInArrow(_without_covered, "record string, content array<string>, removed int")
    return cleaned.unionByName(once.join(listed, "record", "left_anti").withColumn("removed", F.lit(0)))

"""Problem 6: held-out test items inside corpus documents.

Winnowing: of every WINDOW successive k-grams the least hash is kept, on both
sides, so two texts with RUN equal letters and digits in a row share a
fingerprint. Documents that share one with an item are then compared with it.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.codepoints import Rolling, codepoints, sliced, sliding_min, strings

#: Letters and digits of the shortest run that counts; k-gram and window with GRAM + WINDOW - 1 = RUN.
RUN, GRAM, WINDOW = 30, 15, 16
#: Bytes of item texts up to which the items are sent to the workers; beyond, fingerprints are joined by shuffle.
BROADCAST_BYTES = 32 << 20


@functools.cache
def fold_table() -> np.ndarray:
    """Code point → its letter or digit in lower case and normal width; 0 for all else."""
    table = np.zeros(sys.maxunicode + 1, np.uint32)
    for cp in range(sys.maxunicode + 1):
        c = chr(cp)
        if 0xFF00 <= cp <= 0xFFEF:
            c = unicodedata.normalize("NFKC", c)
        if len(c) == 1 and c.isalnum():
            low = c.lower()
            table[cp] = ord(low) if len(low) == 1 else ord(c)
    return table


def fold(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits of all texts, folded, and the offsets between texts."""
    points, offsets = codepoints(texts)
    folded = fold_table()[points]
    kept = folded != 0
    return folded[kept], np.concatenate(([0], np.cumsum(kept)))[offsets]


def fingerprints(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed fingerprints and the text of each."""
    least = sliding_min(Rolling(points).all(GRAM), WINDOW)
    if not len(least):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.arange(len(least))
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    keep = at + RUN <= offsets[of + 1]
    keep[1:] &= (least[1:] != least[:-1]) | (of[1:] != of[:-1])
    return least[keep], of[keep]


def covered(item: str, text: str) -> int:
    """Characters of ``item`` that stand in ``text`` in runs of at least RUN (both folded)."""
    hit, total, end = [item[i : i + RUN] in text for i in range(max(0, len(item) - RUN + 1))], 0, 0
    for i, h in enumerate(hit):
        if h:
            total += i + RUN - max(end, i)
            end = i + RUN
    return total


def _text(points: np.ndarray) -> str:
    return points.astype("<u4").tobytes().decode("utf-32-le")


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, item_chars, covered_chars): documents that hold at least half of an item.

    Counted are letters and digits, without regard to case and width. Rows with
    a null id or text, and items shorter than RUN, leak nowhere; repeated rows
    give one result. Items up to BROADCAST_BYTES (their size is counted first)
    are matched in one pass over the documents; more are joined by fingerprint.
    """
    documents = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    items = items.select("item_id", F.col("text").alias("item")).where("item_id is not null and item is not null")
    size = items.agg(F.sum(F.octet_length("item"))).first()[0] or 0
    return (_leaks_small(documents, items) if size <= BROADCAST_BYTES else _leaks_joined(documents, items)).distinct()


_COLUMNS = "doc_id bigint, item_id bigint, item_chars int, covered_chars int"


def _leaks_small(documents: DataFrame, items: DataFrame) -> DataFrame:
    rows = [(int(r[0]), r[1]) for r in items.collect()]  # at most BROADCAST_BYTES
    points, offsets = fold(strings(pa.array([r[1] for r in rows], pa.string())))
    marks, of = fingerprints(points, offsets)
    # fingerprints in order with the item of each, and the folded texts end to end: arrays of the size of the texts
    order = np.argsort(marks, kind="stable")
    known = documents.sparkSession.sparkContext.broadcast((marks[order], of[order].astype(np.int32), points, offsets, np.array([r[0] for r in rows], np.int64)))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, of_mark, item_points, item_offsets, ids = known.value
        for batch in sliced(batches, "text"):
            out: list[tuple[int, int, int, int]] = []
            points, offsets = fold(strings(batch.column("text")))
            got, of = fingerprints(points, offsets)
            first, past = np.searchsorted(marks, got, "left"), np.searchsorted(marks, got, "right")
            hits = np.flatnonzero(past > first)
            docs = batch.column("doc_id").to_pylist() if len(hits) else []
            found: dict[int, set[int]] = defaultdict(set)
            for k in hits.tolist():
                found[int(of[k])].update(of_mark[first[k] : past[k]].tolist())
            for d, candidates in found.items():
                text = _text(points[offsets[d] : offsets[d + 1]])
                for i in candidates:
                    item = _text(item_points[item_offsets[i] : item_offsets[i + 1]])
                    if 2 * (n := covered(item, text)) >= len(item):
                        out.append((docs[d], int(ids[i]), len(item), n))
            yield _batch(out)

    return documents.mapInArrow(match, _COLUMNS)


def _batch(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [(), (), (), ()]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "item_chars", "covered_chars"])


def _marks(id_column: str, text_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_column):
            marks, of = fingerprints(*fold(strings(batch.column(text_column))))
            yield pa.RecordBatch.from_arrays([pa.array(marks.view(np.int64)), batch.column(id_column).take(pa.array(of))], ["mark", id_column])

    return run


def _leaks_joined(documents: DataFrame, items: DataFrame) -> DataFrame:
    doc_marks = documents.mapInArrow(_marks("doc_id", "text"), "mark bigint, doc_id bigint")
    item_marks = items.mapInArrow(_marks("item_id", "item"), "mark bigint, item_id bigint").distinct()
    candidates = doc_marks.join(item_marks, "mark").select("doc_id", "item_id").distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", "item"):
            out = []
            text_points, text_offsets = fold(strings(batch.column("text")))
            item_points, item_offsets = fold(strings(batch.column("item")))
            for k, (d, i) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("item_id").to_pylist())):
                item = _text(item_points[item_offsets[k] : item_offsets[k + 1]])
                if 2 * (n := covered(item, _text(text_points[text_offsets[k] : text_offsets[k + 1]]))) >= len(item):
                    out.append((d, i, len(item), n))
            yield _batch(out)

    return candidates.join(documents, "doc_id").join(items, "item_id").select("doc_id", "item_id", "text", "item").mapInArrow(verify, _COLUMNS)


def decontaminate(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The documents, all columns, that hold none of the items."""
    return documents.join(leaks(documents, items).select("doc_id").distinct(), "doc_id", "left_anti")

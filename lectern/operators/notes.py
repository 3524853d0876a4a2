"""Footnotes printed in texts: markers, definitions, and which definition a marker means."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import marker_key

#: Paragraphs above a circled definition in which its reference may stand.
NEAR = 8
# Markers, headings of notes, and lines that end a block of notes.
MARKER = r"[\[［〔【][0-9]{1,4}[a-z]?[\]］〕】]|[①-⑳]"
_MARKER = re.compile(MARKER)
_HEADING = re.compile(r"(?:注\s*释|原尾注|尾注|译者注)[：:]?$")
_FOOTER = re.compile(r"^(?:感谢.*(?:录入|校对)|责任编辑|译自|载于|选自|来源[：:]|录入[：:]|校对[：:])")
#: What stands before or after a marker that is no reference: another note's citation, a range of pages, a page at the end of a note.
_CITES = re.compile(r"(?:注|注释)\s*$")
_PAGES = re.compile(r"\s*(?:页|[－—―–-]\s*[0-9]+页)")
_DASHES, _STOP = re.compile(r"[―—-]{2}\s*$"), re.compile(r"[。．.]?\s*$")
_BODY = re.compile(r"^(?:附\s*录|附\s*件|后\s*记|第[一二三四五六七八九十0-9]+[章篇部])")


def _is_heading(line: str) -> bool:
    return len(line) <= 60 and not _MARKER.search(line) and bool(_HEADING.search(line.strip()))


def defined_notes(paragraphs: list[str]) -> list[dict]:
    """Definitions of one chapter: after a heading of notes, each marker that begins a paragraph opens one, up to the next marker, heading or footer; circled ones below their paragraph are local."""
    headings = [i for i, p in enumerate(paragraphs) if _is_heading(p)]
    starts = [(i, m) for i, p in enumerate(paragraphs) if (m := _MARKER.match(p.lstrip()))]
    out: list[dict] = []
    for n, (i, m) in enumerate(starts):
        text = paragraphs[i].lstrip()
        above = [h for h in headings if h < i]
        end = min([j for j, _ in starts[n + 1 : n + 2]] + [h for h in headings if h > i] + [len(paragraphs)])
        if above:
            labels, at = [m[0]], m.end()
            # several labels may share one note
            while (gap := re.match(r"(?:\s*[、,，]\s*|\s+)", text[at:])) and (more := _MARKER.match(text, at + gap.end())):
                labels.append(more[0])
                at = more.end()
            body = [text[at:].lstrip("：: ")]
            for line in paragraphs[i + 1 : end]:
                if _FOOTER.match(line) or _BODY.match(line):
                    break
                body.append(line)
            scope = 0 if len(above) == 1 else above[-2] + 1
            out += [{"paragraph_index": i, "marker": label, "content": [b for b in body if b], "scope_start": scope, "scope_end": next((h for h in headings if h > i), len(paragraphs)), "is_local": False} for label in labels]
        elif len(m[0]) == 1 and text[m.end() :].strip():
            near = [j for j in range(max(0, i - NEAR), i) if m[0] in paragraphs[j] and not _MARKER.match(paragraphs[j].lstrip())]
            if near:
                out.append({"paragraph_index": i, "marker": m[0], "content": [text[m.end() :].strip()], "scope_start": near[-1], "scope_end": i, "is_local": True})
    return out


def printed_markers(paragraphs: list[str]) -> list[dict]:
    """Markers inside the text that read as references: no years, page numbers, citations of other notes, pages after a dash at the end, or beginnings of definitions."""
    out = []
    for i, text in enumerate(paragraphs):
        for m in _MARKER.finditer(text):
            before, after = text[: m.start()], text[m.end() :]
            number = re.search("[0-9]+", m[0])
            if not before.strip() or (number and 1000 <= int(number[0]) <= 2099):
                continue
            if _CITES.search(before) or _PAGES.match(after) or (_DASHES.search(before) and _STOP.match(after)):
                continue
            out.append({"paragraph_index": i, "start": m.start(), "end": m.end(), "marker": m[0]})
    return out


_DEFINITION = pa.struct([("paragraph_index", pa.int32()), ("marker", pa.string()), ("content", pa.list_(pa.string())), ("scope_start", pa.int32()), ("scope_end", pa.int32()), ("is_local", pa.bool_())])
_REFERENCE = pa.struct([("paragraph_index", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("marker", pa.string())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        chapters = [[p or "" for p in c or ()] for c in batch.column("content").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("book_id"), batch.column("chapter_id"), pa.array([defined_notes(c) for c in chapters], pa.list_(_DEFINITION)), pa.array([printed_markers(c) for c in chapters], pa.list_(_REFERENCE))],
            ["book_id", "chapter_id", "definitions", "markers"],
        )


def scanned(chapters: DataFrame) -> DataFrame:
    """(book_id, chapter_id, definitions, markers) of chapters, which are parsed in one pass each."""
    return chapters.select("book_id", "chapter_id", "content").mapInArrow(
        _scan,
        "book_id string, chapter_id string, definitions array<struct<paragraph_index:int,marker:string,content:array<string>,scope_start:int,scope_end:int,is_local:boolean>>, markers array<struct<paragraph_index:int,start:int,end:int,marker:string>>",
    )


def definitions(scanned: DataFrame) -> DataFrame:
    return scanned.select("book_id", "chapter_id", F.inline("definitions")).withColumn("key", marker_key(F.col("marker")))


def references(scanned: DataFrame) -> DataFrame:
    return scanned.select("book_id", "chapter_id", F.inline("markers")).withColumn("key", marker_key(F.col("marker")))


def resolved(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """References with their definition's content and tier, or the reason there is none.

    Tiers in order: local definitions in whose scope the reference stands; else
    all others of the chapter with its key; else those of the volume, unless
    chapters of the book number that family of marks anew. A tier decides only
    if its contents are all equal; else the reference stays ambiguous.
    """
    d = defs.withColumn("digest", F.sha2(F.array_join("content", "\u0000"), 256))
    place = ["book_id", "chapter_id", "paragraph_index", "start", "end", "marker", "key"]
    same = refs.join(d.select("book_id", "chapter_id", "key", "content", "digest", "scope_start", "scope_end", "is_local"), ["book_id", "chapter_id", "key"])
    in_scope = (F.col("paragraph_index") >= F.col("scope_start")) & (F.col("paragraph_index") < F.col("scope_end"))
    local = same.where(F.col("is_local") & in_scope).select(*place, "content", "digest", F.lit(1).alias("tier"))
    chapter = same.where(~F.col("is_local")).select(*place, "content", "digest", F.lit(2).alias("tier"))
    family = F.left("key", F.lit(1))
    anew = d.where("not is_local").groupBy("book_id", "key").agg(F.count_distinct("chapter_id").alias("c"), F.count_distinct("digest").alias("x")).where("c > 1 and x > 1").select("book_id", family.alias("family")).distinct()
    own = d.select("book_id", "chapter_id", "key").distinct()
    foreign = refs.join(own, ["book_id", "chapter_id", "key"], "left_anti").withColumn("family", family).join(anew, ["book_id", "family"], "left_anti").drop("family")
    volume = foreign.join(d.where("not is_local").select("book_id", "key", "content", "digest"), ["book_id", "key"]).select(*place, "content", "digest", F.lit(3).alias("tier"))
    candidates = local.unionByName(chapter).unionByName(volume).groupBy(*place, "tier").agg(F.count_distinct("digest").alias("n"), F.min_by("content", "digest").alias("content"))
    best = candidates.groupBy(*place).agg(F.min_by(F.struct("tier", "n", "content"), "tier").alias("b"))
    out = refs.join(best, place, "left")
    one = F.col("b.n") == 1
    return out.select(*place, F.when(one, F.col("b.content")).alias("content"), F.when(one, F.col("b.tier")).alias("tier"), F.when(F.col("b").isNull(), "missing-definition").when(~one, "ambiguous").otherwise("resolved").alias("outcome"))


def without_linked(refs: DataFrame, footnotes: DataFrame) -> DataFrame:
    """References that no footnote links yet; linked ones win, so a second run adds nothing."""
    linked = footnotes.select("chapter_id", F.inline("refs")).select("chapter_id", "paragraph_index", F.col("start_offset").alias("start"), F.col("end_offset").alias("end"))
    return refs.join(linked, ["chapter_id", "paragraph_index", "start", "end"], "left_anti")


def supplements(records: DataFrame, paragraphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(applied, refused): editorial notes (chapter_id, paragraph_index, start, marker, paragraph_sha256, content) whose paragraph and marker still read as recorded; repeated places are refused."""
    at = records.join(paragraphs, ["chapter_id", "paragraph_index"], "left")
    n = F.count(F.lit(1)).over(Window.partitionBy("chapter_id", "paragraph_index", "start"))
    fits = F.coalesce((F.sha2("text", 256) == F.col("paragraph_sha256")) & (F.substring("text", F.col("start") + 1, F.length("marker")) == F.col("marker")), F.lit(False))
    judged = at.withColumn("_ok", fits & (n == 1)).drop("text")
    return judged.where("_ok").drop("_ok"), judged.where("not _ok").drop("_ok")


def first_definitions(rows: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """Of definitions with one key the first, as anchors of a page link to it."""
    w = Window.partitionBy(*key).orderBy(ordinal)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")

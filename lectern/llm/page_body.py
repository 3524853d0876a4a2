"""Problem 2: the work on a page, without what the page puts around it.

Maximum-scoring subsequences. Every token of a page scores by itself and the
pair it ends: the log odds of standing in lines put around works, learned from
labelled pages, against the whole corpus; what the labelled lines never hold
scores for the work. As the page's lines stand among the work's paragraphs too,
the work isn't one stretch of the page: one linear scan finds, in each element,
the disjoint stretches with the greatest sums, those of at least LEVEL are
taken out, and what is left, in the order of the page, is its main body.

The labelled pages are a short seed (``labelled_pages``) and, from a bounded
sample of the corpus, the lines that a site repeats. Of these the ones that the
seed's notes of editors explain better, or that hold no letter, are of the work.
"""

from __future__ import annotations

import functools
import math
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.codepoints import Rolling, codepoints, mix, sliced, strings
from lectern.llm.labelled_pages import AROUND, NOTES, PROSE, lines
from lectern.llm.site_lines import line_templates
from lectern.llm.tables import one_delivery

#: Chapters from which the lines that sites repeat are taken as labelled lines; the sample is by hash of the id.
SAMPLE = 20_000
#: Share of a text's tokens known from the seed's lines around works, and from all such lines, from which it doesn't count as text of works.
MOSTLY, NEARLY = 0.2, 0.6
#: Sites whose repeated lines must hold a word or pair for it to score, if the seed lacks it: names of one site are no sign.
SITES = 2
#: Bytes of text that are tokenised at once; tokens take some hundred times as much.
PIECE = 2 << 20
#: Least sum of a stretch that isn't the work, odds of some 8000 : 1; score of what the labelled lines don't hold; bounds of one score.
LEVEL, ELSE, MOST = 9.0, -1.5, 6.0
_BREAK = 0x0A


@functools.cache
def _folded() -> np.ndarray:
    """Code point → what the model sees: lower case, one digit for all, one line break."""
    table = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for cp in [*range(0x41, 0x5B), *range(0xC0, 0x250)]:
        low = chr(cp).lower()
        table[cp] = ord(low) if len(low) == 1 else cp
    for cp in range(0x30, 0x3A):
        table[cp] = 0x30
    table[[0x09, 0x0D, 0x0B, 0x0C, 0x85, 0xA0, 0x2028, 0x2029]] = [0x20, _BREAK, _BREAK, _BREAK, _BREAK, 0x20, _BREAK, _BREAK]
    return table


@functools.cache
def _kinds() -> np.ndarray:
    """Code point → 0 white space, 1 letter of a word, 2 digit, 3 a token of its own (ideographs, marks)."""
    kinds = np.full(sys.maxunicode + 1, 3, np.uint8)
    for cp in range(sys.maxunicode + 1):
        c = chr(cp)
        if c == " ":
            kinds[cp] = 0
        elif cp == 0x30:
            kinds[cp] = 2
        elif (cp < 0x2E80 or 0xAC00 <= cp < 0xD7B0) and c.isalpha():
            kinds[cp] = 1
    return kinds


@dataclass
class Tokens:
    """Words, numbers and single characters of many texts: bounds, text of each, hash of each and of the pair it ends."""

    starts: np.ndarray
    ends: np.ndarray
    of: np.ndarray
    word: np.ndarray
    single: np.ndarray
    pair: np.ndarray

    @staticmethod
    def read(texts: pa.Array) -> Tokens:
        """A line break stands before each text and after it, and a double space counts as a token."""
        piece = lambda t: pa.scalar(t, pa.large_string())
        points, offsets = codepoints(pc.binary_join_element_wise(piece("\n"), texts, piece("\n"), piece("")) if len(texts) else texts)
        points = _folded()[points]
        kinds = _kinds()[points].copy()
        if len(points) > 1:
            gap = (kinds[1:] == 0) & (kinds[:-1] == 0)
            kinds[1:][gap] = 3
        begins = np.ones(len(points), bool)
        if len(points) > 1:
            begins[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == 3)
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(points))
        solid = kinds[starts] != 0
        starts, ends = starts[solid], ends[solid]
        kind = kinds[starts]
        length = np.where(kind == 2, 1, ends - starts)
        ids = Rolling(points).at(starts, length)
        of = np.searchsorted(offsets, starts, side="right") - 1
        pair = np.zeros(len(ids), np.uint64)
        with np.errstate(over="ignore"):
            pair[1:] = mix(ids[:-1] * np.uint64(3) + ids[1:])
        # bounds in the text itself
        return Tokens(starts - offsets[of] - 1, ends - offsets[of] - 1, of, kind == 1, ids, pair)


class Lookup:
    """Position of hashes in a small sorted list, -1 for others: most are ruled out by their low bits."""

    def __init__(self, ids: np.ndarray):
        self.ids = np.sort(ids)
        self._may = np.zeros(1 << 20, bool)
        self._may[(self.ids & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        at = np.flatnonzero(self._may[(hashes & np.uint64(0xFFFFF)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.ids, hashes[at]), len(self.ids) - 1)
        hit = self.ids[place] == hashes[at]
        out[at[hit]] = place[hit]
        return out


def _shares(sample: list[tuple[str, float]]) -> list[Counter[int]]:
    """Weighted counts of words and of pairs in labelled lines."""
    out: list[Counter[int]] = [Counter(), Counter()]
    for line, weight in sample:
        t = Tokens.read(pa.array([line], pa.large_string()))
        for s in t.single[t.word].tolist():
            out[0][s] += weight
        for s in t.pair[1:].tolist():
            out[1][s] += weight
    return out


@functools.cache
def _seed_notes() -> tuple[list[Counter[int]], list[Counter[int]]]:
    """Counts of the seed's lines around works, and of its notes of editors."""
    return _shares(lines(AROUND)), _shares(lines(NOTES))


@functools.cache
def _seed() -> tuple[Lookup, Lookup]:
    """Words and pairs of the seed's lines around works."""
    return seed_sample().lookups()


def of_the_work(line: str) -> bool:
    """Whether a line that a site repeats is rather the work's: without letters, or nearer to the seed's notes than to its lines of pages."""
    t = Tokens.read(pa.array([line], pa.large_string()))
    if not any(c.isalpha() for c in line):
        return True
    score = 0.0
    for around, work, ids in zip(*_seed_notes(), (t.single[t.word], t.pair[1:])):
        a, w = sum(around.values()), sum(work.values())
        score += sum(math.log((work[h] / w + 1e-4) / (around[h] / a + 1e-4)) for h in ids.tolist() if h in around or h in work)
    return score > 0


@dataclass
class Sample:
    """Weighted counts of words and of pairs in labelled lines around works, and in such lines of works."""

    around: list[Counter[int]]
    work: list[Counter[int]]

    def lookups(self) -> tuple[Lookup, Lookup]:
        return Lookup(np.array(list(self.around[0]), np.uint64)), Lookup(np.array(list(self.around[1]), np.uint64))


def seed_sample() -> Sample:
    return Sample(_shares(lines(AROUND)), _shares(lines(NOTES) + lines(PROSE)))


def labelled(chapters: DataFrame, books: DataFrame, sample: int = SAMPLE) -> Sample:
    """The seed's lines, and those that sites repeat in some ``sample`` chapters.

    What is collected is bounded by the sample. Each repeated line has the same
    weight, all of a kind together at most that of the seed's; of their words
    and pairs those of fewer than SITES sites don't count.
    """
    of, n = 1 << 20, chapters.count()
    picked = chapters if n <= sample else chapters.where(F.pmod(F.xxhash64("chapter_id", F.lit(2)), F.lit(of)) < int(of * sample / n))
    rows = line_templates(picked, books).groupBy("template").agg(F.collect_set("site").alias("sites")).collect()
    repeated = sorted((r.template.replace("\n", "0"), frozenset(r.sites)) for r in rows)
    out = seed_sample()
    for part, own in ((out.around, False), (out.work, True)):
        here = [(line, sites) for line, sites in repeated if of_the_work(line) == own]
        size = min(1.0, sum(part[1].values()) / max(1, sum(len(line) for line, _ in here)))
        held: list[dict[int, set[str]]] = [{}, {}]
        for line, sites in here:
            for places, counts in zip(held, _shares([(line, 1.0)])):
                for h in counts:
                    places.setdefault(h, set()).update(sites)
        for line, _ in here:
            for total, places, counts in zip(part, held, _shares([(line, size)])):
                total.update({h: x for h, x in counts.items() if h in total or own or len(places[h]) >= SITES})
    return out


@dataclass
class Weights:
    """Scores of the words and pairs of the labelled lines, in the order of their lookups."""

    known: tuple[Lookup, Lookup]
    words: np.ndarray
    pairs: np.ndarray

    def scores(self, t: Tokens) -> np.ndarray:
        """Score of each token: a word's own with its pair's, where that speaks against the work; else the pair's."""
        words, pairs = self.known
        pair = np.append(self.pairs, ELSE)[pairs(t.pair)]
        own = np.append(self.words, ELSE)[np.where(t.word, words(t.single), -1)]
        return np.where(t.word, own + np.maximum(pair, 0), pair)


def counting(known: tuple[Lookup, Lookup]):
    """A task's counts of the known words and pairs, and of all, over texts that don't consist largely of them."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (words, pairs), (seed_words, seed_pairs) = known, _seed()
        total = np.zeros(len(words.ids) + len(pairs.ids) + 2, np.int64)
        for batch in sliced(batches, "content", most=PIECE):
            texts = strings(batch.column("content").flatten())
            t = Tokens.read(texts)
            if not len(t.of):
                continue
            seeded = np.where(t.word, np.where(t.word, seed_words(t.single), -1) >= 0, seed_pairs(t.pair) >= 0)
            share = np.bincount(t.of, weights=seeded, minlength=len(texts)) / np.maximum(1, np.bincount(t.of, minlength=len(texts)))
            w, p = np.where(t.word, words(t.single), -1), pairs(t.pair)
            met = np.bincount(t.of, weights=np.where(t.word, (w >= 0) | (p >= 0), p >= 0), minlength=len(texts)) / np.maximum(1, np.bincount(t.of, minlength=len(texts)))
            own = ((share < MOSTLY) & (met < NEARLY))[t.of]
            total[: len(words.ids)] += np.bincount(w[own & (w >= 0)], minlength=len(words.ids))
            total[len(words.ids) : -2] += np.bincount(p[own & (p >= 0)], minlength=len(pairs.ids))
            total[-2:] += [int((own & t.word).sum()), int(own.sum())]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "n"])

    return counts


def learn(chapters: DataFrame, books: DataFrame, sample: int = SAMPLE) -> Weights:
    """Weights of the labelled lines against all content elements; there are as many as the sample has words and pairs."""
    lines_of = labelled(chapters, books, sample)
    known = lines_of.lookups()
    content = chapters.select(F.coalesce("content", F.array().cast("array<string>")).alias("content"))
    rows = content.mapInArrow(counting(known), "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(known[0].ids) + len(known[1].ids) + 2)
    counts[np.asarray(rows.column("k"))] = np.asarray(rows.column("n"))
    return fit(lines_of, known, counts)


def fit(sample: Sample, known: tuple[Lookup, Lookup], counts: np.ndarray) -> Weights:
    """Log odds of the labelled lines around works against the counts of the corpus, and against the labelled lines of works."""
    words = len(known[0].ids)
    parts = (counts[:words], counts[words:-2])
    out = []
    for lookup, part, size, around, work in zip(known, parts, counts[-2:], sample.around, sample.work):
        total, total_work = sum(around.values()), sum(work.values())
        scores = np.zeros(len(lookup.ids))
        for i, (h, n) in enumerate(zip(lookup.ids.tolist(), part)):
            score = math.log(around[h] / total / max(n / max(size, 1), 1e-6))
            if w := work.get(h):
                score = min(score, math.log((around[h] / total) / (w / total_work)))
            scores[i] = min(MOST, max(-MOST, score))
        out.append(scores)
    return Weights(known, *out)


def stretches(scores: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Greatest sum of a stretch of each of n texts, in one scan over the tokens of all."""
    out = np.zeros(n)
    if len(scores):
        # a step down between texts that no sum can bridge keeps the least prefix within the text
        sums = np.cumsum(scores, dtype=np.float64) - of * 1e5
        best = sums - np.minimum.accumulate(sums - scores)
        first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        out[of[first]] = np.maximum.reduceat(best, first)
    return out


def scan_texts(texts: pa.Array, weights: Weights) -> np.ndarray:
    t = Tokens.read(texts)
    return stretches(weights.scores(t), t.of, len(texts))


_GAPS = " \t　|—"


def cut(text: str, scores: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[str, list[str]]:
    """(what is left, what was taken out): the disjoint stretches of at least LEVEL, the greatest first, each widened to its line's or separators' ends."""
    scores, gone = scores.astype(np.float64).copy(), []
    while len(scores):
        sums = np.concatenate(([0.0], np.cumsum(scores)))
        over = sums - np.minimum.accumulate(sums)
        end = int(np.argmax(over))
        if over[end] < LEVEL:
            break
        start = int(np.argmin(sums[: end + 1]))
        # a pair's score stands at its second token
        a, b = _widened(text, max(0, int(starts[max(0, start - 1)])), min(len(text), int(ends[end - 1])))
        gone.append((a, b))
        scores[(starts < b) & (ends > a)] = -1e6  # no stretch crosses what is gone
        scores[start:end] = -1e6
    merged: list[list[int]] = []
    for a, b in sorted(gone):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    left = text[: merged[0][0]].rstrip(_GAPS) if merged else text
    for (a, b), (after, _) in zip(merged, [*merged[1:], (len(text), 0)]):
        right = text[b:after].lstrip(_GAPS)
        right = right if after == len(text) else right.rstrip(_GAPS)
        if left.endswith("\n") and right.startswith("\n"):
            right = right[1:]
        between = "" if not left or not right or "\n" in (left[-1], right[0]) else "\n" if "\n" in text[a:b] else " "
        left += between + right
    return left, [text[a:b] for a, b in merged]


def _widened(text: str, a: int, b: int) -> tuple[int, int]:
    """To the ends of the line, if no sentence of the work stands between."""
    start = max(text.rfind("\n", 0, a) + 1, max(text.rfind(c, 0, a) + 1 for c in "。！？”.“"))
    ends = [i for i in (text.find("\n", b), text.find("——", b), text.find("　", b), text.find(" | ", b)) if i >= 0]
    rest = text[b:]
    if not any(c in rest.split("\n")[0] for c in "。！？”.“"):
        end = b + len(rest.split("\n")[0])
    else:
        end = min([*ends, b + max(0, len(rest) - len(rest.lstrip()))]) if ends else b
        end = max(end, b)
    return min(a, start) if a - start < 40 else a, end


def page_parts(chapters: DataFrame, weights: Weights) -> DataFrame:
    """(chapter_id, content, cut, pieces): the main body of each row, the positions of the elements that lost something, and the pieces taken out.

    Elements of which nothing is left are dropped, empty ones too; a null content stays null and has no pieces.
    """
    shared = chapters.sparkSession.sparkContext.broadcast(weights)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in sliced(batches, "content", most=PIECE):
            content = batch.column("content")
            texts = strings(content.flatten())
            t = Tokens.read(texts)
            scores = weights.scores(t)
            best = stretches(scores, t.of, len(texts))
            bounds = np.searchsorted(t.of, np.arange(len(texts) + 1))
            kept, where, pieces, k = [], [], [], 0
            for elements in content.to_pylist():
                out, at, gone = [], [], []
                for i, e in enumerate(elements or ()):
                    if best[k] >= LEVEL:
                        x, y = bounds[k], bounds[k + 1]
                        e, taken = cut(e, scores[x:y], t.starts[x:y], t.ends[x:y])
                        at.append(i)
                        gone += taken
                    k += 1
                    if e and e.strip():
                        out.append(e)
                kept.append(out if elements is not None else None)
                where.append(at)
                pieces.append(gone)
            yield pa.RecordBatch.from_arrays(
                [batch.column("chapter_id"), pa.array(kept, pa.list_(pa.string())), pa.array(where, pa.list_(pa.int32())), pa.array(pieces, pa.list_(pa.string()))], ["chapter_id", "content", "cut", "pieces"]
            )

    return chapters.where("chapter_id is not null").select("chapter_id", "content").mapInArrow(clean, "chapter_id string, content array<string>, cut array<int>, pieces array<string>")


def around(chapters: DataFrame, books: DataFrame, weights: Weights | None = None) -> DataFrame:
    """(chapter_id, paragraph_index) of content elements that lose something to the main body.

    Null contents and elements have none, empty ones neither; a chapter
    delivered twice has each element once.
    """
    parts = page_parts(chapters, weights or learn(chapters, books))
    return parts.select("chapter_id", F.explode("cut").alias("paragraph_index")).distinct()


def main_body(chapters: DataFrame, books: DataFrame, weights: Weights | None = None) -> DataFrame:
    """(chapter_id, content, removed): the paragraphs of the work only, and the number of pieces taken out.

    Elements of which nothing is left are dropped, empty ones too; a chapter
    delivered twice has one row, a null content stays null.
    """
    parts = page_parts(one_delivery(chapters), weights or learn(chapters, books))
    return parts.select("chapter_id", "content", F.size("pieces").alias("removed"))

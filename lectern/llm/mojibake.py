"""Problem 1: text read with a wrong encoding, found and restored.

A noisy channel: the writer's characters became bytes under their own encoding,
and a reader took the bytes for another one. For each such pair of encodings
the damaged run is turned back into bytes, with wildcards where the reader left
only replacement characters, and a Viterbi search over the byte lattice finds
the most probable mixture of sound and restorable characters under character
and pair frequencies of the whole corpus. What gains enough is damage; the
decoded characters are the restored text, lost ones stay U+FFFD. Bytes of which
nothing survives are a character of the lattice too: the replacement character
that an earlier reader wrote.

As most of the corpus has no spaces between words, its words are counted as
characters and pairs of neighbours, in a count-min sketch of fixed size: each
row's count exceeds the true one by the pairs that share its slot, whose mean is
taken off, and the least of the rows counts. With N pairs counted it is over by
more than 2.72 N / 2 ** PAIR_BITS in at most exp(-PAIR_ROWS) of cases.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.codepoints import codepoints, sliced, strings

#: Rows of the pair sketch, and the bits of a row's slots; pairs of all texts are counted.
PAIR_ROWS, PAIR_BITS = 2, 20
#: Mean log frequency of PROBE neighbouring characters below which a text is searched, whatever its characters.
PROBE, PROBE_LEVEL = 4, -9.6
#: Least gain in log probability for damage; cost of a step out of damage, and into it: less where bytes must form
#: whole UTF-8 sequences, which sound text hardly ever does.
GAIN, OUT, INTO, INTO_UTF8 = 6.0, 2.0, 7.0, 3.0
#: Log frequency of a character the corpus lacks, and of one that no writer writes.
_UNSEEN, _NEVER = -17.0, -15.0
#: Log probability of a character whose bytes are lost, and of one that an earlier reader had replaced (its three bytes are all there).
LOST, REPLACED = -8.0, -1.5
_REPLACEMENT = [0xEF, 0xBF, 0xBD]

# The pairs of encodings (read as, written in) by name.
SINGLE_BYTE = ("latin-1", "cp1252", "mac_roman", "cp437", "cp850", "koi8_r", "cp1251", "cp866")
CHANNELS = (
    *((read, "utf-8") for read in SINGLE_BYTE),
    ("gb18030", "utf-8"),
    ("big5", "utf-8"),
    ("shift_jis", "utf-8"),
    ("euc_kr", "utf-8"),
    ("latin-1", "gb18030"),
    ("cp1252", "gb18030"),
    ("mac_roman", "gb18030"),
    ("cp437", "gb18030"),
    ("koi8_r", "gb18030"),
    ("cp1251", "gb18030"),
    ("big5", "gb18030"),
    ("shift_jis", "gb18030"),
    ("euc_kr", "gb18030"),
    ("utf-8", "gb18030"),
    ("gb18030", "big5"),
    ("latin-1", "big5"),
    ("cp1252", "big5"),
)


def pair_slots(a, b) -> list:
    """Slots of a pair of code points in the sketch, one in each row, rows one after the other; for numbers and for arrays."""
    keys = ((0x9E3779B1, 0x85EBCA77, 7), (0xC2B2AE3D, 0x27D4EB2F, 9))
    return [(((a * x + b * y) >> z) & ((1 << PAIR_BITS) - 1)) + (row << PAIR_BITS) for row, (x, y, z) in enumerate(keys[:PAIR_ROWS])]


def sketch(counts: np.ndarray) -> np.ndarray:
    """The rows of the sketch less the mean of what other pairs add to a slot."""
    rows = counts.reshape(PAIR_ROWS, -1).astype(np.float64)
    total = rows.sum(axis=1, keepdims=True)
    return np.maximum(rows - (total - rows) / (rows.shape[1] - 1), 0).astype(np.float32).ravel()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts: code points as (code point), pairs as (-1 - slot)."""
    single, pairs = np.zeros(0x110000, np.int64), np.zeros(PAIR_ROWS << PAIR_BITS, np.int64)
    for batch in sliced(batches, "title", "content"):
        for name in ("title", "content"):
            column = batch.column(name)
            texts = strings(column.flatten() if name == "content" else column)
            points, offsets = codepoints(texts)
            if not len(points):
                continue
            single += np.bincount(points, minlength=0x110000)
            wide = points.astype(np.int64)
            inner = np.ones(len(points), bool)
            inner[offsets[1:-1][offsets[1:-1] < len(points)]] = False
            for slots in pair_slots(wide[:-1][inner[1:]], wide[1:][inner[1:]]):
                pairs += np.bincount(slots, minlength=len(pairs))
    a, b = np.flatnonzero(single), np.flatnonzero(pairs)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((a, -1 - b))), pa.array(np.concatenate((single[a], pairs[b])))], ["k", "n"])


@dataclass
class Model:
    """Frequencies of the corpus: at most 0x110000 code points and the sketch of pairs, whatever the corpus."""

    total: int
    points: np.ndarray
    point_counts: np.ndarray
    pairs: np.ndarray
    _log: dict[int, float] = field(default_factory=dict, repr=False)
    _scores: dict[tuple[int, int], float] = field(default_factory=dict, repr=False)
    _count: dict[int, int] = field(default_factory=dict, repr=False)

    def prepare(self) -> Model:
        if not self._log:
            logs = np.log(self.point_counts / max(self.total, 1))
            self._log = dict(zip(self.points.tolist(), logs.tolist()))
            self._count = dict(zip(self.points.tolist(), self.point_counts.tolist()))
        return self

    def dense(self) -> np.ndarray:
        out = np.full(0x110000, _UNSEEN, np.float32)
        out[self.points] = np.log(self.point_counts / max(self.total, 1))
        return out

    def score(self, before: int, c: int) -> float:
        """Log probability of c after ``before`` (-1: at the beginning)."""
        if (got := self._scores.get((before, c))) is not None:
            return got
        one = self._log.get(c)
        if one is None:
            return _UNSEEN
        if (n := self._count.get(before, 0)) >= 5:
            together = min(float(self.pairs[slot]) for slot in pair_slots(before, c))
            one = math.log(0.7 * min(1.0, together / n) + 0.3 * math.exp(one))
        if len(self._scores) > 1 << 19:  # a cache only
            self._scores.clear()
        self._scores[before, c] = one
        return one


def learn(chapters: DataFrame) -> Model:
    """The corpus model of all titles and content elements; its size doesn't grow with the corpus."""
    counted = chapters.select(F.coalesce("title", F.lit("")).alias("title"), F.coalesce("content", F.array().cast("array<string>")).alias("content"))
    rows = counted.mapInArrow(_counts, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    return model_of(np.asarray(rows.column("k")), np.asarray(rows.column("n")))


def model_of(k: np.ndarray, n: np.ndarray) -> Model:
    """The model of the counts of code points (k) and of pairs (-1 - k)."""
    pairs = np.zeros(PAIR_ROWS << PAIR_BITS, np.int64)
    pairs[-1 - k[k < 0]] = n[k < 0]
    order = np.argsort(k[k >= 0])
    points, counts = k[k >= 0][order], n[k >= 0][order]
    return Model(int(counts.sum()), points, counts, sketch(pairs))


@functools.cache
def _bytes_of(codec: str, c: str) -> bytes | None:
    """What a reader of ``codec`` saw as c; b"" for a lost byte; None if it sees no such character."""
    if c == "�":
        return b""
    cp = ord(c)
    if cp < 0x80:
        return None
    if codec == "utf-8":
        return c.encode()
    if codec in ("gb18030", "big5", "shift_jis", "euc_kr"):
        if c == "€" and codec == "gb18030":
            return b"\x80"
        for name in (codec, {"big5": "cp950", "shift_jis": "cp932", "euc_kr": "cp949"}.get(codec, codec), "big5hkscs" if codec == "big5" else codec):
            try:
                raw = c.encode(name)
            except UnicodeEncodeError:
                continue
            return raw if len(raw) <= 2 else None
        return None
    try:
        return c.encode(codec)
    except UnicodeEncodeError:
        # readers of these encodings take a byte without a character for its control character
        return bytes([cp]) if cp < 0xA0 and codec in ("cp1252", "cp1251") else None


@functools.cache
def _two_byte(codec: str, a: int, b: int) -> int:
    try:
        c = bytes((a, b)).decode(codec)
    except UnicodeDecodeError:
        return -1
    return ord(c) if len(c) == 1 and not 0xE000 <= ord(c) < 0xF900 else -1


def _decodings(codec: str, raw: list[int], at: int, known: dict[int, float]) -> list[tuple[int, int]]:
    """(length, code point) of the characters that may stand at a place of the bytes; 0xFFFD for one that is lost."""
    a, n = raw[at], len(raw)
    if codec != "utf-8":
        if a < 0:
            out = [(1, 0xFFFD)]
            if at + 1 < n:
                b = raw[at + 1]
                out += [(2, 0xFFFD)] if b < 0 else [(2, c) for x in range(0xB0, 0xF8) if (c := _two_byte(codec, x, b)) in known]
            return out
        if a < 0x81 or at + 1 >= n:
            return []
        b = raw[at + 1]
        if b < 0:
            return [(2, c) for x in range(0xA1, 0xFF) if (c := _two_byte(codec, a, x)) in known] or [(2, 0xFFFD)]
        c = _two_byte(codec, a, b)
        return [(2, c)] if c >= 0 else []
    if a < 0:
        out = [(1, 0xFFFD)]
        rest = raw[at + 1 : at + 3]
        if len(rest) == 2 and all(0x80 <= x < 0xC0 for x in rest):
            out += [(3, c) for lead in range(0xE2, 0xF0) if (c := ((lead & 15) << 12) | ((rest[0] & 63) << 6) | (rest[1] & 63)) in known and _proper(3, c)]
        return out
    size = 2 if 0xC2 <= a < 0xE0 else 3 if 0xE0 <= a < 0xF0 else 4 if 0xF0 <= a < 0xF5 else 0
    if not size or at + size > n:
        # a character whose end is lost with the run
        return [(n - at, 0xFFFD)] if size and n - at >= 2 and all(x < 0 or 0x80 <= x < 0xC0 for x in raw[at + 1 :]) else []
    rest = raw[at + 1 : at + size]
    if not all(x < 0 or 0x80 <= x < 0xC0 for x in rest):
        return []
    lost = [i for i, x in enumerate(rest) if x < 0]
    first = (a & (0x7F >> size)) << (6 * (size - 1))
    base = first | sum((x & 63) << (6 * (size - 2 - i)) for i, x in enumerate(rest) if x >= 0)
    if not lost:
        return [(size, base)] if _proper(size, base) else []
    if len(lost) == 1:
        shift = 6 * (size - 2 - lost[0])
        return [(size, c) for x in range(64) if (c := base | (x << shift)) in known and _proper(size, c)] or [(size, 0xFFFD)]
    return [(size, 0xFFFD)]


def _proper(size: int, c: int) -> bool:
    """Whether a code point is one that UTF-8 writes in so many bytes."""
    return {2: 0x80, 3: 0x800, 4: 0x10000}[size] <= c <= 0x10FFFF and not 0xD800 <= c < 0xE000


@functools.cache
def _gate(read: str, written: str) -> re.Pattern:
    """What a text must hold for damage by this pair of encodings to be possible."""
    if read == "utf-8":
        return re.compile("\ufffd")
    if read in SINGLE_BYTE:
        chars: dict[int, str] = {}
        for b in range(0x80, 0x100):
            try:
                chars[b] = bytes([b]).decode(read)
            except UnicodeDecodeError:
                chars[b] = chr(b)
        cls = lambda lo, hi: "[" + "".join(re.escape(chars[b]) for b in range(lo, hi)) + "]"
        if written == "utf-8":
            cont = cls(0x80, 0xC0)
            return re.compile(f"{cls(0xC2, 0xE0)}{cont}|{cls(0xE0, 0xF0)}(?:{cont}|�){{2}}|{cls(0xF0, 0xF5)}{cont}{{3}}")
        return re.compile(cls(0xA1, 0xF8) + cls(0x80, 0xFF) + "(?:" + cls(0xA1, 0xF8) + cls(0x80, 0xFF) + ")+")
    if written == "utf-8" and read != "shift_jis":
        # characters whose bytes hold the lead byte of a character of three, and what may follow
        leads = []
        for a in range(0x81, 0xFF):
            for b in range(0x40, 0xFF):
                if (0xE2 <= a <= 0xEF and 0x80 <= b < 0xC0) or (a in (0xC3, 0xC5) and 0x80 <= b < 0xC0):
                    try:
                        c = bytes((a, b)).decode(read)
                    except UnicodeDecodeError:
                        continue
                    if len(c) == 1 and _bytes_of(read, c) == bytes((a, b)):
                        leads.append(c)
        return re.compile("[" + "".join(map(re.escape, leads)) + "]") if leads else re.compile(r"(?!)")
    if read in ("shift_jis", "euc_kr"):  # such a reader saw half-width kana, or Hangul
        return re.compile("[\uff61-\uff9f]" if read == "shift_jis" else "[\uac00-\ud7a3]")
    return re.compile(r"[\u2e80-\u9fff\uf900-\ufaff\u3040-\u312f\uac00-\ud7af\uff61-\uff9f\ufffd][^\x00-\x7f]{2}")


def _repair(text: str, read: str, written: str, model: Model) -> tuple[float, str, list[tuple[int, int]]]:
    """Best mixture for one pair of encodings: (gain, repaired text, damaged spans of the text)."""
    known = model._log
    into = INTO_UTF8 if written == "utf-8" else INTO
    gain_total, out, spans, done = 0.0, [], [], 0
    for run in _runs(read, text):
        start, end = run
        raw: list[int] = []
        edges = {0: start}
        for i in range(start, end):
            b = _bytes_of(read, text[i])
            raw.extend(b if b else [-1])
            edges[len(raw)] = i + 1
        if len(raw) < 2:
            continue
        before = ord(text[start - 1]) if start else -1
        twice = _REPLACEMENT * 2
        # characters of two replacements in a row: their pairs are frequent only because damage is
        alone = {edges[q] for p in range(len(raw) - 5) if raw[p : p + 6] == twice for q in range(p, p + 6) if q in edges} if written == "utf-8" and 0xEF in raw else ()
        plainly = lambda i, last: model._log.get(ord(text[i]), _UNSEEN) if i in alone else _plain_score(model, last, ord(text[i]))
        # best[pos][mode]: (score, previous pos, previous mode, emitted code point)
        best: list[list[tuple[float, int, int, int] | None]] = [[None, None] for _ in range(len(raw) + 1)]
        best[0][0] = (0.0, -1, 0, before)
        plain = 0.0
        for pos in range(len(raw)):
            for mode in (0, 1):
                here = best[pos][mode]
                if here is None:
                    continue
                score, _, _, last = here
                if pos in edges:
                    c = ord(text[edges[pos]])
                    nxt = pos + max(1, len(_bytes_of(read, text[edges[pos]]) or b"?"))
                    s = score + plainly(edges[pos], last) - (OUT if mode else 0.0)
                    if best[nxt][0] is None or s > best[nxt][0][0]:
                        best[nxt][0] = (s, pos, mode, c)
                if mode or pos in edges:
                    for length, c in _decodings(written, raw, pos, known):
                        gone = REPLACED if written == "utf-8" and raw[pos : pos + 3] == _REPLACEMENT else LOST
                        s = score + (gone if c == 0xFFFD else model.score(last, c)) - (0.0 if mode else into)
                        nxt = pos + length
                        if best[nxt][1] is None or s > best[nxt][1][0]:
                            best[nxt][1] = (s, pos, mode, c)
        last = before
        for i in range(start, end):
            plain += plainly(i, last)
            last = ord(text[i])
        end_mode = max((0, 1), key=lambda m: best[len(raw)][m][0] if best[len(raw)][m] else -math.inf)
        cell = best[len(raw)][end_mode]
        if cell is None or cell[0] - plain < GAIN:
            continue
        chars: list[tuple[int, int, int, int]] = []
        pos, mode = len(raw), end_mode
        while pos:
            _, prev, prev_mode, c = best[pos][mode]
            chars.append((prev, pos, mode, c))
            pos, mode = prev, prev_mode
        chars.reverse()
        damaged = [(p, q) for p, q, m, _ in chars if m]
        # a restoration must restore something: characters the corpus knows
        restored = [c for _, _, m, c in chars if m and c != 0xFFFD]
        lost = sum(1 for _, _, m, c in chars if m and c == 0xFFFD)
        if not damaged or (not restored and lost < 2) or (restored and sum(known.get(c, _UNSEEN) for c in restored) / len(restored) < -11.5):
            continue
        gain_total += cell[0] - plain
        out += [text[done:start], "".join(chr(c) for *_, c in chars)]
        done = end
        spans.append((start, end))
    return gain_total, "".join(out) + text[done:], spans


def _plain_score(model: Model, last: int, c: int) -> float:
    if c == 0xFFFD or 0x7F <= c < 0xA0 or 0xE000 <= c < 0xF900:
        return _NEVER
    # pairs of such characters are frequent only because damage is
    return model.score(last, c) if c < 0x80 or 0x2E80 <= c < 0xA000 else model._log.get(c, _UNSEEN)


@functools.lru_cache(1 << 16)
def _in_run(read: str, c: str) -> bool:
    return _bytes_of(read, c) is not None


def _runs(read: str, text: str) -> Iterator[tuple[int, int]]:
    """Maximal runs of characters that a reader of ``read`` may have seen."""
    start = -1
    for i, c in enumerate(text):
        if _in_run(read, c):
            if start < 0:
                start = i
        elif start >= 0:
            yield start, i
            start = -1
    if start >= 0:
        yield start, len(text)


#: Damage on top of damage: what may be found in a text restored once.
_AGAIN = [c for c in CHANNELS if c[1] == "utf-8" and c[0] in ("latin-1", "cp1252")]


def _undone(text: str, read: str) -> str:
    """Every sequence that may be UTF-8 read as a single-byte encoding, decoded, whatever comes out."""

    def decode(m: re.Match) -> str:
        raw = [_bytes_of(read, c) for c in m.group()]
        try:
            return b"".join(b or b"?" for b in raw).decode()
        except UnicodeDecodeError:
            return m.group()

    return _gate(read, "utf-8").sub(decode, text)


def _twice(text: str, model: Model) -> tuple[float, str, str] | None:
    """UTF-8 taken for Latin twice, where the corpus doesn't know what lies between."""
    best = None
    for read, written in _AGAIN:
        once = _undone(text, read)
        for again, _ in _AGAIN if once != text else ():
            if _gate(again, written).search(once):
                gain, fixed, spans = _repair(once, again, written, model)
                if spans and (best is None or gain > best[0]):
                    best = (gain, fixed, f"{read}>{written}+{again}>{written}")
    return best


def restore(text: str, model: Model) -> tuple[str, str] | None:
    """(restored text, channels) of a text with damage; None for a sound one.

    The pair of encodings with the greatest gain is undone, then the result is
    searched for UTF-8 that was taken for Latin twice. Where no byte survives
    the restored text has U+FFFD.
    """
    names: list[str] = []
    for channels in (CHANNELS, _AGAIN):
        best: tuple[float, str, str] | None = None
        for read, written in channels:
            if _gate(read, written).search(text):
                gain, fixed, spans = _repair(text, read, written, model)
                if spans and (best is None or gain > best[0]):
                    best = (gain, fixed, f"{read}>{written}")
        if best is None and channels is CHANNELS:
            best = _twice(text, model)
        if best is None:
            break
        text = best[1]
        names.append(best[2])
    return (text, "+".join(names)) if names else None


def suspects(points: np.ndarray, offsets: np.ndarray, log: np.ndarray) -> np.ndarray:
    """Texts with PROBE neighbouring characters of low mean frequency (all of it, if shorter)."""
    sums = np.concatenate(([0.0], np.cumsum(log[points], dtype=np.float64)))
    lengths = np.diff(offsets)
    low = np.zeros(len(lengths), bool)
    short = (lengths > 0) & (lengths < PROBE)
    low[short] = (sums[offsets[1:]] - sums[offsets[:-1]])[short] / lengths[short] < PROBE_LEVEL
    if len(points) >= PROBE:
        mean = (sums[PROBE:] - sums[:-PROBE]) / PROBE
        at = np.flatnonzero(mean < PROBE_LEVEL)
        of = np.searchsorted(offsets, at, side="right") - 1
        low[of[at + PROBE <= offsets[of + 1]]] = True
    return low


def damaged(chapters: DataFrame, model: Model | None = None, all_texts: bool = False) -> DataFrame:
    """(chapter_id, paragraph_index, text, restored, channel) of titles (-1) and elements with damage.

    Null titles, contents and elements have none; a chapter delivered twice has
    each damaged place once. Every text is tested; the search runs on those
    that hold unusual characters or neighbours that are rare, or with
    ``all_texts`` on every text.
    """
    model = model or learn(chapters)
    shared = chapters.sparkSession.sparkContext.broadcast(model)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value.prepare()
        log = model.dense()
        for batch in sliced(batches, "title", "content"):
            content = batch.column("content")
            rows = np.concatenate((np.arange(len(batch)), np.asarray(pa.compute.list_parent_indices(content), np.int64)))
            inner = np.asarray(pa.compute.list_parent_indices(content), np.int64)
            index = np.concatenate((np.full(len(batch), -1), np.arange(len(inner)) - np.searchsorted(inner, inner, side="left")))
            texts = strings(pa.concat_arrays([batch.column("title").cast(pa.string()), content.flatten().cast(pa.string())]))
            low = suspects(*codepoints(texts), log)
            special = np.asarray(pa.compute.match_substring_regex(texts, _RE2))
            within = np.asarray(pa.compute.match_substring_regex(texts, _within_latin()))
            ids = batch.column("chapter_id")
            out: list[tuple[str, int, str, str, str]] = []
            for i in np.flatnonzero(low | special | within | all_texts).tolist():
                text = texts[i].as_py()
                if found := restore(text, model):
                    out.append((ids[int(rows[i])].as_py(), int(index[i]), text, *found))
            columns = list(zip(*out)) if out else [()] * 5
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["chapter_id", "paragraph_index", "text", "restored", "channel"])

    prepared = chapters.select("chapter_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("content", F.array().cast("array<string>")).alias("content")).where("chapter_id is not null")
    return prepared.mapInArrow(search, "chapter_id string, paragraph_index int, text string, restored string, channel string").dropDuplicates(["chapter_id", "paragraph_index", "text"])


@functools.cache
def _within_latin() -> str:
    """East Asian characters in or at a Latin word, in RE2's notation; at its ends only those that letters with accents become."""
    letters = set()
    for read in ("gb18030", "big5", "euc_kr"):
        for a, b in itertools.product((0xC3, 0xC5), range(0x80, 0xC0)):
            c = bytes((a, b)).decode(read, "ignore")
            if len(c) == 1 and ord(c) >= 0x2E80:
                letters.add(c)
    kana, latin = r"\x{ff61}-\x{ff9f}", "A-Za-zäöüß"
    at_end = f"[{''.join(sorted(letters))}{kana}]{{1,3}}"
    other = r"[^\x{2e80}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}\x{ff61}-\x{ff9f}]"
    inside = rf"[{latin}][\x{{4e00}}-\x{{9fff}}\x{{ac00}}-\x{{d7af}}{kana}]{{1,3}}[a-zäöüß]"
    return rf"{inside}|[{latin}][ '’-]?{at_end}(?:{other}|$)|(?:^|{other}){at_end}[ '’-]?[{latin}]"


# the special characters in RE2's notation, for Arrow
_RE2 = (
    r"[\x{7f}-\x{a0}\x{a1}-\x{a6}\x{a8}\x{aa}\x{ac}\x{ae}\x{af}\x{b1}-\x{b6}\x{b8}-\x{ba}\x{bc}-\x{bf}\x{192}\x{2b0}-\x{2ff}\x{384}-\x{7ff}\x{2020}\x{2021}\x{2030}\x{20a7}\x{20ac}\x{2116}\x{2122}\x{2200}-\x{22ff}\x{2310}-\x{2321}\x{2500}-\x{25a0}"
    r"\x{3041}-\x{312f}\x{ac00}-\x{d7af}\x{e000}-\x{f8ff}\x{ff61}-\x{ff9f}\x{fffd}]|[\x{c0}-\x{df}][^A-Za-z\s]|[A-Za-zäöüß][\x{4e00}-\x{9fff}]{1,3}[a-zäöüß]|锟"
)

"""Problem 5: text that looks the same in different characters, brought to one form.

First each character gets its one usual form: canonical composition, normal
width, one kind of space, no characters without a glyph, usual ideographs for
radicals and compatibility forms. Then tokens are repaired by script: in a
token of mixed scripts, or of a script foreign to the text throughout, the
letters foreign to the main script are replaced by their look-alikes, if the
result stands in the vocabulary of the corpus. What
a reader can tell apart (circled and raised digits, dashes, quotes, Chinese and
Western punctuation) stays different.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.codepoints import sliced
from lectern.session import cut_lineage, sent_if_small

# Cyrillic and Greek letters and the Latin letters they look like.
_CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТХҮаеѕіјорсухһԁԛԝѵ", "ABESIJKMHOPCTXYaesijopcyxhdqwv"))
_GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυ", "ABEZHIKMNOPTYXaivopu"))
_LATIN_OF = _CYRILLIC | _GREEK
_CYRILLIC_OF = {v: k for k, v in reversed(_CYRILLIC.items())}
_GREEK_OF = {v: k for k, v in reversed(_GREEK.items())}
#: Characters without a glyph of their own.
_UNSEEN = "­͏؜᠎​-‏‪-‮⁠-⁤⁦-⁯︀-️﻿"
_SPACES = "   -   　"
#: Characters that may have another usual form; a text without any is its own form.
AFFECTED = f"[{_UNSEEN}{_SPACES}\u0591-\u05c7\u0610-\u06ed\u0900-\u0fff\u1f00-\u1fff\u2329\u232a\u2adc\u3099\u309a\ufb1d-\ufb4f̀-ͯͰ-ԯᄀ-ᇿẛΩKÅ⺀-⿕豈-﫿ﬀ-ﬆ＃-＆＊＋－／-９＝＠-Ｚａ-ｚ\U0002f800-\U0002fa1f]"
# the same in Java's notation
_AFFECTED_JAVA = AFFECTED.replace("\U0002f800-\U0002fa1f", r"\x{2F800}-\x{2FA1F}")
# joiners carry meaning between letters of these scripts, and in emoji
_JOINING = re.compile("[؀-෿က-႟ក-៿‍️\U0001f000-\U0001faff]")
_WIDE = {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F) if chr(c - 0xFEE0).isalnum() or chr(c - 0xFEE0) in "#$%&*+-/=@"}
_TOKEN = re.compile("[A-Za-zª-ɏͰ-ԯḀ-῿]+")
_TOKEN_JAVA = "[A-Za-zÀ-ɏͰ-ԯḀ-῿]+"


@functools.cache
def _usual() -> dict[int, str]:
    """Code point → its usual form, for single characters."""
    table: dict[int, str] = dict(_WIDE)
    for cp in [*range(0x2E80, 0x2FD6), *range(0xF900, 0xFB00), *range(0x2F800, 0x2FA20)]:
        table[cp] = unicodedata.normalize("NFKC", chr(cp))
    for cp in range(0xFB00, 0xFB07):  # Latin ligatures
        table[cp] = unicodedata.normalize("NFKC", chr(cp))
    return table


def _strip_unseen(text: str) -> str:
    def drop(m: re.Match) -> str:
        around = text[max(0, m.start() - 1) : m.start()] + text[m.end() : m.end() + 1]
        return m.group() if m.group()[0] in "‌‍️" and _JOINING.search(around) else ""

    return re.sub(f"[{_UNSEEN}]+", drop, text)


def usual_form(text: str) -> str:
    """Each character in its usual form; idempotent."""
    text = re.sub(f"[{_SPACES}]", " ", _strip_unseen(text))
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).translate(_usual()))


def _script(c: str) -> str:
    return "G" if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿" else "C" if "Ѐ" <= c <= "ԯ" else "L"


def repaired_tokens(text: str) -> list[tuple[str, str]]:
    """(token, repair) for tokens of a text in usual form that mix scripts, or look like its main script throughout.

    A token's main script is the one with a letter that looks like none of the
    others; failing that the text's, then that of most of its letters.
    """
    tokens = _TOKEN.findall(text)
    if not any(_script(c) != "L" for t in tokens for c in t):
        return []
    scripts = [_script(c) for t in tokens for c in t]
    text_main = max("LCG", key=scripts.count)
    to = {"L": _LATIN_OF, "C": _CYRILLIC_OF, "G": _GREEK_OF}
    out = {}
    for t in tokens:
        have = [_script(c) for c in t]
        if len(set(have)) == 1:
            # one script, foreign to the text: an initial or a word made of look-alikes only
            if have[0] == text_main or text_main != "L" or not all(c in _LATIN_OF for c in t):
                continue
            main = "L"
        else:
            own = {s: sum(1 for c, h in zip(t, have) if h == s and c not in (_LATIN_OF if s != "L" else _CYRILLIC_OF)) for s in "LCG"}
            main = max("LCG", key=lambda s: (own[s] > 0, s == text_main, have.count(s)))
        fixed = "".join(c if h == main else to[main].get(_LATIN_OF.get(c, c) if main != "L" else c, c) for c, h in zip(t, have))
        if fixed != t and all(_script(c) == main for c in fixed):
            out[t] = fixed
    return list(out.items())


_PLACE = ["kind", "record", "index"]


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    repair = pa.list_(pa.struct([("raw", pa.string()), ("fixed", pa.string())]))
    for batch in sliced(batches, "text"):
        forms = [usual_form(t) for t in batch.column("text").to_pylist()]
        repairs = [[{"raw": a, "fixed": b} for a, b in repaired_tokens(f)] for f in forms]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*_PLACE, "text")), pa.array(forms, pa.string()), pa.array(repairs, repair)], [*_PLACE, "text", "form", "repairs"])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text", "form"):
        out = []
        for form, known in zip(batch.column("form").to_pylist(), batch.column("known").to_pylist()):
            words = {k["raw"]: k["fixed"] for k in known or ()}
            out.append(_TOKEN.sub(lambda m: words.get(m.group(), m.group()), form) if words else form)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*_PLACE, "text")), pa.array(out, pa.string())], [*_PLACE, "text", "form"])


def _texts(texts: DataFrame) -> DataFrame:
    return texts.select(*_PLACE, "text").where("record is not null and text is not null")


def consistent(texts: DataFrame) -> DataFrame:
    """(kind, record, index, text, form): texts that hold a character with another usual form, in the one form.

    ``texts`` has kind, record, index, text; a text not listed is its own form.
    Null texts have no row; equal rows count once. A token is repaired only if
    the repair stands, spelled so, in some text of the corpus; that another
    damaged token would become it counts for nothing.
    """
    texts = _texts(texts)
    affected = texts.where(F.col("text").rlike(_AFFECTED_JAVA)).distinct()
    # used four times below: written once, instead of scanning the texts again for each
    formed = cut_lineage(affected.mapInArrow(_forms, "kind string, record string, index int, text string, form string, repairs array<struct<raw:string,fixed:string>>"))
    wanted = formed.select(F.explode("repairs").alias("r")).select("r.raw", "r.fixed").distinct()
    # the vocabulary, as far as it is asked for
    words = texts.where(F.col("text").rlike("[A-Za-zͰ-ԯ]")).select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_TOKEN_JAVA), F.lit(0)))).alias("fixed"))
    spelled = words.join(sent_if_small(wanted.select("fixed").distinct()), "fixed", "left_semi").distinct()
    known = sent_if_small(cut_lineage(wanted.join(spelled, "fixed", "left_semi")))
    numbered = formed.withColumn("_t", F.xxhash64("text"))
    place = [*_PLACE, "_t"]
    repairs = numbered.where(F.size("repairs") > 0).select(*place, F.explode("repairs").alias("r")).select(*place, "r.raw", "r.fixed").join(known, ["raw", "fixed"], "left_semi")
    by_text = repairs.groupBy(*place).agg(F.collect_list(F.struct("raw", "fixed")).alias("known"))
    whole = numbered.where(F.size("repairs") == 0).withColumn("known", F.lit(None).cast("array<struct<raw:string,fixed:string>>"))
    found = whole.select(*_PLACE, "text", "form", "known").unionByName(numbered.where(F.size("repairs") > 0).join(by_text, place, "left").select(*_PLACE, "text", "form", "known"))
    return found.mapInArrow(_apply, "kind string, record string, index int, text string, form string")


def same_looking(texts: DataFrame) -> DataFrame:
    """(kind, record_a, index_a, record_b, index_b), record_a < record_b: texts of one form that are not the same string.

    Of two such texts at least one is affected, so only forms of affected texts
    are looked up among the others, by 128 bits of hash. Equal strings are
    classes: classes are paired, then members, so no pair is made in vain.
    """
    texts = _texts(texts)
    of = lambda c: F.struct(F.xxhash64(c).alias("a"), F.xxhash64(c, F.lit(1)).alias("b"))
    affected = cut_lineage(consistent(texts).select(*_PLACE, of("form").alias("form"), of("text").alias("string")))
    forms = sent_if_small(affected.select("kind", "form").distinct())
    plain = texts.where(~F.col("text").rlike(_AFFECTED_JAVA)).select(*_PLACE, of("text").alias("form")).join(forms, ["kind", "form"], "left_semi").withColumn("string", F.col("form"))
    members = cut_lineage(affected.unionByName(plain).distinct())
    several = members.groupBy("kind", "form").agg(F.min("string").alias("x"), F.max("string").alias("y")).where("x <> y").select("kind", "form")
    members = members.join(sent_if_small(several), ["kind", "form"], "left_semi")
    classes = members.select("kind", "form", "string").distinct()
    pairs = classes.withColumnRenamed("string", "string_a").join(classes.withColumnRenamed("string", "string_b"), ["kind", "form"]).where("string_a.a <> string_b.a or string_a.b <> string_b.b")
    side = lambda s: members.select("kind", "form", F.col("string").alias(f"string_{s}"), F.col("record").alias(f"record_{s}"), F.col("index").alias(f"index_{s}"))
    return pairs.join(side("a"), ["kind", "form", "string_a"]).join(side("b"), ["kind", "form", "string_b"]).where("record_a < record_b").select("kind", "record_a", "index_a", "record_b", "index_b").distinct()

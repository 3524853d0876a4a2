"""Partial and printed dates as column expressions: a struct of year, month, day with nulls for what isn't known."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """A value bound once in a larger expression, instead of repeated wherever it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _part(x: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, group), F.lit("")).cast("int")


def _valid(y: Column, m: Column, d: Column) -> Column:
    full = F.format_string("%04d-%02d-%02d", y, F.coalesce(m, F.lit(1)), F.coalesce(d, F.lit(1)))
    return y.between(1, 9999) & F.try_to_date(full, "yyyy-MM-dd").isNotNull()


def partial_date(x: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD; null if malformed or not in the calendar."""
    shape = r"^([0-9]{4})(?:-([0-9]{2}))?(?:-([0-9]{2}))?$"
    y, m, d = (_part(x, shape, g) for g in (1, 2, 3))
    return F.when(x.rlike(shape) & _valid(y, m, d), F.struct(y.alias("year"), m.alias("month"), d.alias("day")))


def date_order(date: Column) -> Column:
    """Sort key of a partial date: what isn't known counts as first."""
    return date.year * 10000 + F.coalesce(date.month, F.lit(1)) * 100 + F.coalesce(date.day, F.lit(1))


def date_label(date: Column) -> Column:
    return F.concat(date.year.cast("string"), F.lit("年"), F.coalesce(F.concat(date.month.cast("string"), F.lit("月")), F.lit("")), F.coalesce(F.concat(date.day.cast("string"), F.lit("日")), F.lit("")))


def range_label(start: Column, end: Column) -> Column:
    """Label of a date, or of a range if there is an end."""
    return F.concat(date_label(start), F.coalesce(F.concat(F.lit("—"), date_label(end)), F.lit("")))


def printed_date(x: Column) -> Column:
    """The date a Chinese line begins with: (date_start, date_end, note); null if there is none or it isn't in the calendar.

    A range of years has both ends. Of a date in old and new style the new one,
    in parentheses, is taken, into the next month or year if need be. Of
    several days the first counts.
    """
    span = "^((?:18|19|20)[0-9]{2})[―—–－-]((?:18|19|20)[0-9]{2})年"
    shape = "^((?:18|19|20)[0-9]{2})年(?:\\s*([0-9]{1,2})月(?:\\s*([0-9]{1,2})(?:日|(?=[、和至―—–－-][0-9]{1,2})))?)?"
    days = "(?:[、和及至―—–－-][0-9]{1,2}日?)*"
    style = f"^{days}[（(](?:([0-9]{{1,2}})月)?([0-9]{{1,2}})日?{days}[）)]"

    def read(t: Column) -> Column:
        parts = F.struct(*(_part(t, shape, g).alias(n) for g, n in ((1, "y"), (2, "m"), (3, "d"))), F.substring(t, F.length(F.regexp_extract(t, shape, 0)) + 1, F.length(t)).alias("rest"))
        a, b = F.regexp_extract(t, span, 1), F.regexp_extract(t, span, 2)
        years = F.when(a <= b, F.struct(a.alias("date_start"), b.alias("date_end"), F.lit("range of years").alias("note")))
        return F.when(t.rlike(span), years).when(t.rlike(shape), let(parts, single))

    def single(p: Column) -> Column:
        new_style = p.rest.rlike(style) & p.m.isNotNull() & p.d.isNotNull()
        return let(F.when(new_style, F.struct(p.y.alias("y"), F.coalesce(_part(p.rest, style, 1), p.m).alias("m"), _part(p.rest, style, 2).alias("d"), p.m.alias("old"), F.lit("new style").alias("note"))).otherwise(F.struct(p.y.alias("y"), p.m.alias("m"), p.d.alias("d"), p.m.alias("old"), F.when(p.rest.rlike("^[、和及至―—–－-]"), "first of several").otherwise("").alias("note"))), dated)

    def dated(p: Column) -> Column:
        year = p.y + F.when(p.m < p.old, 1).otherwise(0)
        iso = F.when(p.m.isNull(), F.format_string("%04d", year)).when(p.d.isNull(), F.format_string("%04d-%02d", year, p.m)).otherwise(F.format_string("%04d-%02d-%02d", year, p.m, p.d))
        return F.when(_valid(year, p.m, p.d), F.struct(iso.alias("date_start"), F.lit("").alias("date_end"), p.note.alias("note")))

    return let(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), read)


# The forms of credit lines.
CREDIT_WORD = "(?:第一次|首次|最初)?(?:发表(?:于|在)?|刊载于|载于|出版于)"
CREDIT_BEGINNING = "^(?:写于|作于|(?:第一次|首次|最初)?(?:载于|发表于|发表在|刊载于)|[0-9]{4}年)"
CREDIT_TRANSLATION = "(?:译成|译文|俄文全文|中译本|译本).{0,20}$"
CREDIT_DATED = "^[0-9]{4}年(?:[0-9]{1,2}月(?:[0-9]{1,2}日)?)?(?:第一次|首次|最初)(?:发表|载于|刊载)"
CREDIT_WRITTEN_AT = "^[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日于[^，。]{1,15}载于"
NOTES_HEADING = r"^(?:注\s*释|尾注|原脚注)[：:]?$"
NOTES_HEADING_AT_END = r"(?:注\s*释|原脚注)[：:]?$"
DEFINITION_BEGINNING = r"^\s*[\[［〔【][0-9]+[\]］〕】]"
#: Characters before a credit word, and in a credit line, at most.
CREDIT_WITHIN, CREDIT_LONGEST = 90, 500


def without_authors(x: Column, names: tuple[str, ...]) -> Column:
    """A credit line without its author's name in front, which a forename or initial may precede."""
    t = F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(t, rf"(?U)^(?:[^\s·・．.]{{1,6}}[·・．.])?(?:{'|'.join(names)})\s*", "") if names else t


def publication_credit(x: Column, names: tuple[str, ...] = ()) -> Column:
    """The date of first publication in a credit line; null if the line credits something else, as a translation or the writing.

    The line is cut before each of its credit words. A piece counts if the date
    follows its word, or if a year stands right before 第一次; the first one holds.
    """
    pieces = lambda t: F.split(t, rf"(?=(?<!第一次|首次|最初){CREDIT_WORD})")

    def candidates(t: Column) -> Column:
        return let(pieces(t), lambda parts: F.filter(F.transform(parts, lambda piece, i: dated(piece, F.array_join(F.slice(parts, F.lit(1), i), ""))), lambda d: d.isNotNull()))

    def dated(piece: Column, before: Column) -> Column:
        word = F.regexp_extract(piece, f"^{CREDIT_WORD}", 0)
        after = printed_date(F.regexp_replace(F.substring(piece, F.length(word) + 1, F.length(piece)), "^[ ：:]+", ""))
        year = F.regexp_extract(before, "((?:18|19|20)[0-9]{2}年)$", 1)
        first = F.when((year != "") & word.rlike("^(?:第一次|首次)"), printed_date(year))
        return F.when((word != "") & (F.length(before) <= CREDIT_WITHIN) & ~before.rlike(CREDIT_TRANSLATION), F.coalesce(after, first))

    def read(t: Column) -> Column:
        fits = (F.length(t) <= CREDIT_LONGEST) & t.rlike(CREDIT_BEGINNING)
        by_word = F.get(candidates(t), F.lit(0))
        return F.when(fits & t.rlike(CREDIT_DATED), printed_date(t)).when(fits & (~t.rlike("^[0-9]{4}年") | t.rlike(CREDIT_WRITTEN_AT)), by_word)

    return let(without_authors(x, names), read)


def before_notes(content: Column) -> Column:
    """The elements up to a heading of notes, one at the end of an element included, without definitions of notes."""
    whole = F.coalesce(content, F.array().cast("array<string>"))
    clean = lambda e: F.regexp_replace(F.coalesce(e, F.lit("")), r"(?U)^\s+|\s+$", "")
    stops = F.transform(whole, lambda e, i: F.when(clean(e).rlike(rf"(?U){NOTES_HEADING}"), i).when(clean(e).rlike(rf"(?U){NOTES_HEADING_AT_END}"), i + 1))
    shown = F.slice(whole, F.lit(1), F.coalesce(F.array_min(stops), F.size(whole)))
    return F.filter(shown, lambda e: e.isNotNull() & ~e.rlike(DEFINITION_BEGINNING))

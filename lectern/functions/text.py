"""Text functions as column expressions; white space is Unicode white space throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that decide what counts as a heading, a letter, a year, a row of a table.
CHAPTER_NUMBER = "第[一二三四五六七八九十百0-9]+"
LETTER_WORDS = "(?:致|给).{0,25}(?:信|复信|书)|书信|通告信"
WORK_WORDS = "论|批判|宣言|原理|纲领|手稿|战争|革命和反革命|起源|怎么办"
YEAR = "(?<![0-9])((?:18|19|20)[0-9]{2})(?![0-9])"
NAVIGATION_WORDS = "上一篇|下一篇|回目录|返回目录|上一页|下一页|目录"
NUMBERS_ONLY = r"^[0-9 .,，、:：;%％+\-−—–/()（）]+$"

#: White space by name, for SQL dialects without a Unicode class.
SPACES = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def trim(x: Column) -> Column:
    return F.regexp_replace(x, rf"^{SPACES}+|{SPACES}+$", "")


def clean_space(x: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return trim(F.regexp_replace(x, rf"{SPACES}+", " "))


def compact(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), rf"{SPACES}+", "")


def clean_title(x: Column) -> Column:
    """A title without dot leaders and page ranges, spaced single characters joined, a space after a chapter number; the input if nothing is left."""
    t = F.regexp_extract(x, r"(?s)^(.*?)(?:…{4,}.*|\.{6,}.*)?$", 1)
    t = F.regexp_replace(t, rf"{SPACES}*[0-9]+{SPACES}*[―—–-]{SPACES}*[0-9]+{SPACES}*$", "")
    t = F.regexp_replace(F.regexp_replace(t, rf"{SPACES}+", " "), "^[ ·…]+|[ ·…]+$", "")
    pieces = F.split(t, " ")
    t = F.when((F.size(pieces) > 1) & F.forall(pieces, lambda p: F.length(p) == 1), F.array_join(pieces, "")).otherwise(t)
    t = F.regexp_replace(t, rf"^({CHAPTER_NUMBER}章)(?!{SPACES}|$)", "$1 ")
    return F.when(t != "", t).otherwise(trim(x))


def safe_id(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, "[^a-zA-Z0-9_-]+", "-"), "^-+|-+$", "")


#: Private-use characters of damaged pages and what they stand for.
PRIVATE_USE = {"": "　", "": "　", "": "ö", "": "ä", "": "志", "": "米"}


def map_private_use(x: Column) -> Column:
    return F.translate(x, "".join(PRIVATE_USE), "".join(PRIVATE_USE.values()))


def tags(x: Column, longest: int = 24, most: int = 12) -> Column:
    """Tags of a line: split at commas and semicolons, cleaned, cut, without empty ones and repeats (by lower case, first kept)."""
    parts = F.filter(F.transform(F.split(x, "[,，;；]"), lambda t: F.left(clean_space(t), F.lit(longest))), lambda t: t != "")
    first = F.filter(parts, lambda t, i: (i == 0) | ~F.exists(F.slice(parts, F.lit(1), i), lambda p: F.lower(p) == F.lower(t)))
    return F.slice(first, 1, most)


def marker_key(x: Column) -> Column:
    """Identity of a note marker: circled numbers are a family of their own, brackets of one kind another; zeros in front don't count."""
    bare = F.regexp_replace(x, r"^[\[\]［］〔〕【】 \t]+|[\[\]［］〔〕【】 \t]+$", "")
    number = F.regexp_extract(bare, "^([0-9]+)", 1)
    family = F.translate(F.left(x, F.lit(1)), "［", "[")
    rest = F.substring(bare, F.length(number) + 1, F.length(bare))
    return F.when(F.regexp_like(bare, F.lit("^[①-⑳]$")), bare).when(number != "", F.concat(family, F.regexp_replace(number, "^0+(?=[0-9])", ""), rest)).otherwise(F.concat(family, bare))


def category(title: Column) -> Column:
    """Letter, work or article, by the words of a title."""
    return (
        F.when(title.rlike(LETTER_WORDS), "书信")
        .when(title.rlike(WORK_WORDS), "著作")
        .otherwise("文章")
    )


def suspicious_title(x: Column) -> Column:
    """Why a section title is probably data of a table; null for a credible one."""
    t = clean_space(x)
    digits = F.length(F.regexp_replace(t, "[^0-9]", ""))
    groups = F.regexp_count(t, F.lit(r"[0-9]+(?:[.,][0-9]+)?"))
    fine = (
        t.rlike(r"^[（(][0-9]{1,4}[）)]$") | t.rlike(rf"(?:^|[0-9][、．。.]{SPACES}*)(?:(?:18|19|20)[0-9]{{2}}年)?[0-9]{{1,2}}月[0-9]{{1,2}}日")
        | t.rlike(rf"(?:^|[0-9][、．。.]{SPACES}*)(?:18|19|20)[0-9]{{2}}年") | t.rlike(r"^[0-9]{1,3} +[^0-9]")
    )
    row = t.rlike("^[0-9]") & (groups >= 2) & (digits / F.greatest(F.length(t), F.lit(1)) >= 0.35) & ~t.rlike(r"^[0-9]{1,2}[、．。)] *[^0-9]")
    return F.when(t == "", "empty title").when(fine, None).when((digits > 0) & t.rlike(NUMBERS_ONLY), "numeric-only title").when(row, "probable table row")


def credible_heading(x: Column) -> Column:
    return suspicious_title(x).isNull() & x.rlike(r"\p{L}")


def heading_level(x: Column) -> Column:
    """2 or 3 for a line that reads as a heading, else null."""
    open_end = (F.length(x) > 1) & (F.length(x) <= 72) & ~x.rlike("[。！？；;]$")
    return F.when(~(open_end & credible_heading(x)), None).when(x.rlike(rf"^{CHAPTER_NUMBER}[篇章节部卷](?:{SPACES}|$)"), 2).when(x.rlike("^[一二三四五六七八九十]{1,4}[、．.]"), 2).when(x.rlike("^[（(][一二三四五六七八九十0-9]{1,4}[）)]"), 3).when(x.rlike(r"^[0-9]{1,2}[．.、] *(?=.*\p{L})\S"), 3)


def navigation_line(x: Column) -> Column:
    return x.rlike(rf"^(?:(?:{NAVIGATION_WORDS}){SPACES}*[（(]?[^）)]{{0,30}}[）)]?{SPACES}*)+$") | (F.contains(x, F.lit("回目录")) & (F.length(x) <= 60))


def local_year(label: Column, context: Column) -> Column:
    """The one year of a label, else the one year of a context not much longer; "" where neither is unambiguous."""
    years = lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit(YEAR), F.lit(1)))
    a, b = years(label), years(context)
    return F.when(F.size(a) == 1, F.get(a, F.lit(0))).when(F.size(a) > 1, "").when((F.length(context) <= F.length(label) + 80) & (F.size(b) == 1), F.get(b, F.lit(0))).otherwise("")


def agreed_year(*signals: Column) -> Column:
    """The year that all signals (arrays of years) share, if it is one."""
    shared = signals[0]
    for s in signals[1:]:
        shared = F.array_intersect(shared, s)
    return F.when(F.size(shared) == 1, F.get(shared, F.lit(0)))


def excerpt(text: Column, start: Column, length: Column, before: int = 32, after: int = 48) -> Column:
    """A match with its surroundings, ellipses where the text goes on."""
    a = F.greatest(start - before, F.lit(0))
    b = F.least(start + length + after, F.length(text))
    return F.concat(F.when(a > 0, "…").otherwise(""), F.substring(text, a + 1, b - a), F.when(b < F.length(text), "…").otherwise(""))


def pack_sentences(text: Column, target: int = 1400) -> Column:
    """A long paragraph (over twice the target) as pieces of whole sentences up to the target; others as one piece."""
    pieces = F.filter(F.transform(F.split(text, r"(?<=[。！？.!?])\s+|(?<=[。！？])"), trim), lambda s: s != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("current"))

    def step(a: Column, s: Column) -> Column:
        over = (a.current != "") & (F.length(a.current) + F.length(s) > target)
        joined = F.concat(a.current, F.when(a.current.rlike(r"[\x00-\x7f]$"), " ").otherwise(""), s)
        return F.struct(F.when(over, F.array_append(a.done, a.current)).otherwise(a.done).alias("done"), F.when(over, s).otherwise(joined).alias("current"))

    packed = F.aggregate(pieces, start, step, lambda a: F.when(a.current != "", F.array_append(a.done, a.current)).otherwise(a.done))
    return F.when(F.length(text) <= 2 * target, F.array(text)).otherwise(F.when(F.size(packed) > 0, packed).otherwise(F.array(text)))


def merge_lines(lines: Column, full: int = 60) -> Column:
    """Lines broken by a page's layout joined again: a line goes on while what is gathered is at least ``full`` long and doesn't end a sentence."""
    def step(a: Column, x: Column) -> Column:
        last = F.try_element_at(a, F.lit(-1))
        goes_on = last.isNotNull() & (F.length(last) >= full) & ~last.rlike("[。！？!?”」』：:]$")
        return F.when(goes_on, F.array_append(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.concat(last, x))).otherwise(F.array_append(a, x))

    return F.aggregate(F.filter(lines, lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"), step)


#: Words by which a page leads to other pages, and notices that no text holds.
PAGE_WORDS = ("home", "index", "next", "previous", "up", "contents", "返回", "主页", "下一页", "上一页")
PAGE_NOTICES = ("contact us", "last updated", "download:", "jump to", "privacy policy")


def short_keep(x: Column, title: Column, notices: tuple[str, ...] = ()) -> Column:
    """Whether a line is of the text, by the short list: two characters, not the title, no word of pages, none of the notices."""
    low = F.lower(x)
    keep = (F.length(x) >= 2) & (x != title) & ~low.isin(*PAGE_WORDS)
    for word in (*PAGE_NOTICES, *notices):
        keep = keep & ~F.contains(low, F.lit(word.lower()))
    return keep


def kept_line(x: Column, notices: tuple[str, ...] = ()) -> Column:
    """Whether a line is of the text, by the long list: no word of pages, arrow or breadcrumb, none of the notices."""
    low = F.lower(x)
    keep = (F.length(x) >= 2) & ~low.isin(*PAGE_WORDS, "首页", "目录", "打印") & ~x.isin("->", "- >", "→", ">>", "»") & ~(x.rlike("^(?:->|→|>>) ") & (F.length(x) <= 40))
    for word in notices:
        keep = keep & ~F.contains(low, F.lit(word.lower()))
    return keep


def safe_asset(path: Column, folder: str) -> Column:
    """Whether a path stays inside its folder and names a file."""
    return F.startswith(path, F.lit(folder)) & ~F.contains(path, F.lit("..")) & ~F.contains(path, F.lit("\\")) & ~F.contains(path, F.lit("//")) & path.rlike("[^/]$")


def occurrences(text: Column, needle: Column) -> Column:
    """Starts of all occurrences, none of which overlaps the one before: prefix sums over the pieces between them."""
    pieces = F.split(text, F.concat(F.lit(r"\Q"), needle, F.lit(r"\E")), -1)
    start = F.struct(F.lit(0).alias("past"), F.array().cast("array<int>").alias("starts"))
    step = lambda a, x: F.struct((a.past + F.length(x) + F.length(needle)).alias("past"), F.array_append(a.starts, a.past + F.length(x)).alias("starts"))
    return F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), start, step, lambda a: a.starts)


def marked_spans(text: Column) -> Column:
    """(span_start, span_end) of what stands between <b> and </b>, in the text without the marks."""
    pieces = F.split(text, "</?b>", -1)
    start = F.struct(F.lit(0).alias("past"), F.array().cast("array<struct<span_start:int,span_end:int>>").alias("spans"))
    step = lambda a, x: F.struct((a.past + F.length(x)).alias("past"), F.array_append(a.spans, F.struct(a.past.alias("span_start"), (a.past + F.length(x)).alias("span_end"))).alias("spans"))
    return F.filter(F.aggregate(pieces, start, step, lambda a: a.spans), lambda s, i: i % 2 == 1)


def balanced_end(text: Column, start: Column, opening: str = "（", closing: str = "）") -> Column:
    """Place after the parenthesis that closes the one at ``start``; null if none does."""
    pieces = F.regexp_extract_all(F.substring(text, start + 1, F.length(text)), F.lit(f"[{opening}{closing}]|[^{opening}{closing}]+"), F.lit(0))
    begin = F.struct(start.cast("int").alias("at"), F.lit(0).alias("depth"), F.lit(None).cast("int").alias("past"))

    def step(a: Column, x: Column) -> Column:
        at = a.at + F.length(x)
        depth = a.depth + F.when(x == opening, 1).when(x == closing, -1).otherwise(0)
        return F.struct(at.alias("at"), depth.alias("depth"), F.when(a.past.isNull() & (depth == 0), at).otherwise(a.past).alias("past"))

    return F.aggregate(pieces, begin, step, lambda a: a.past)


def common_prefix(a: Column, b: Column, most: int) -> Column:
    """Characters that two texts have in common at the beginning, of ``most``."""
    sizes = F.sequence(F.lit(1), F.lit(most))
    return F.size(F.filter(sizes, lambda n: (n <= F.least(F.length(a), F.length(b))) & (F.left(a, n) == F.left(b, n))))


def length_label(n: Column) -> Column:
    """A number of characters, from ten thousand on with one decimal in ten thousands."""
    return F.when(n >= 10_000, F.concat(F.format_string("%d.%d", F.floor(n / 10_000), F.floor(n % 10_000 / 1000)), F.lit(" 万字"))).otherwise(F.concat(n.cast("string"), F.lit(" 字")))


def percent(value: Column, completed: Column) -> Column:
    return F.when(completed, 100.0).otherwise(F.least(F.lit(99.9), value))


def squared_distance(x: Column, y: Column) -> Column:
    return x * x + y * y


def normal_url(x: Column) -> Column:
    """Without the fragment and the parameters of the path; the query stays."""
    return F.regexp_replace(F.regexp_replace(x, "#.*$", ""), "^([^?;]*);[^?]*", "$1")


def url_folder(x: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(x, "[?#].*$", ""), "^.*/", 0)

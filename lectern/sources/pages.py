"""Web pages landed as files: decoding, links, text lines. No job opens a connection; pages are landed first."""

from __future__ import annotations

import codecs
import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes in which a page declares its encoding.
HEAD = 4096
#: Links of one index page that are followed, and the fewest that make it one.
MOST_LINKS, LEAST_LINKS = 120, 2


def declared_charset(raw: Column) -> Column:
    """Encoding a page declares in its first bytes, in lower case; "" for none."""
    return F.lower(F.regexp_extract(F.decode(F.substring(raw, 1, HEAD), "ISO-8859-1"), r"""(?i)charset\s*=\s*["']?\s*([A-Za-z0-9_.:-]+)""", 1))


def decode_page(raw: bytes | None, declared: str | None = None) -> tuple[str, str]:
    """(text, encoding): the first of declared, sniffed, UTF-8, GB 18030 and Big5 that reads all bytes; else UTF-8 with replacements."""
    raw = raw or b""
    sniffed = re.search(rb"charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", raw[:HEAD], re.I)
    names = [declared, sniffed[1].decode("ascii") if sniffed else None, "utf-8", "gb18030", "big5"]
    for name in names:
        wide = {"gb2312": "gb18030", "gbk": "gb18030"}.get((name or "").lower(), name)
        try:
            if wide:
                codecs.lookup(wide)
                return raw.decode(wide), wide.lower()
        except (UnicodeDecodeError, LookupError):
            continue
    return raw.decode("utf-8", "replace"), "utf-8/replace"


def decoded(pages: DataFrame) -> DataFrame:
    """Pages (url, raw, and declared if given) with html and encoding."""
    has_declared = "declared" in pages.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            declared = batch.column("declared").to_pylist() if has_declared else [None] * len(batch)
            out = [decode_page(r, d) for r, d in zip(batch.column("raw").to_pylist(), declared)]
            yield pa.RecordBatch.from_arrays([batch.column("url"), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string())], ["url", "html", "encoding"])

    return pages.select("url", "raw", *(["declared"] if has_declared else [])).mapInArrow(run, "url string, html string, encoding string")


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Landed pages with their side files: url, raw, verified (whether the bytes have the digest noted when they were fetched)."""
    name = lambda c, end: F.regexp_extract(c, rf"([^/]+)\.{end}$", 1)
    files = spark.read.format("binaryFile").load(f"{folder}/*.html").select(name("path", "html").alias("name"), F.col("content").alias("raw"))
    meta = spark.read.schema("url string, rawSha256 string, charset string").option("multiLine", True).json(f"{folder}/*.json").withColumn("name", name(F.input_file_name(), "json"))
    return files.join(meta, "name").select("url", "raw", F.col("charset").alias("declared"), (F.sha2("raw", 256) == F.col("rawSha256")).alias("verified"))


def zip_members(files: DataFrame) -> DataFrame:
    """(path, member, size, sha256) of each file in archives (path, content); a broken archive has one row with null member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            rows: list[tuple] = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        for info in archive.infolist():
                            if not info.is_dir():
                                rows.append((path, info.filename, info.file_size, hashlib.sha256(archive.read(info)).hexdigest()))
                except (zipfile.BadZipFile, OSError):
                    rows.append((path, None, None, None))
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string()))], ["path", "member", "size", "sha256"])

    return files.select("path", "content").mapInArrow(run, "path string, member string, size bigint, sha256 string")


def normal_link(base: str, href: str) -> str:
    """Absolute URL without fragment and path parameters, the query kept."""
    s = urlsplit(urljoin(base, href.strip()))
    return urlunsplit((s.scheme, s.netloc, s.path.split(";")[0], s.query, ""))


_BLOCKS = frozenset("address article aside blockquote body dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
_SILENT = frozenset("script style noscript template iframe svg nav header footer form button select".split())
#: Classes and ids of what isn't the page's text, and of what is.
_NOISE = frozenset("navbar nav footer header breadcrumbs menu".split())
_MAIN = frozenset("content article-content main".split())
#: A list or table of so many links into the page itself, and of fewer characters, is its own contents.
INTERNAL_LINKS, INTERNAL_CHARS = 3, 3000
_LISTS = frozenset("ul ol dl table".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Page(HTMLParser):
    """One pass over a page: lines of text with heading levels, links with labels, note anchors with offsets.

    Elements of navigation are left out, lists of links into the page too. If
    the page has a main element, an article or one that is marked as its
    content, only the lines within count.
    """

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.lines, self.links, self.anchors = base, [], [], []
        self._text, self._level, self._silent, self._link, self._title = "", 0, [], None, False
        self._main: list[str] = []
        self._within: list[bool] = []
        self._lists: list[list] = []

    def _break(self) -> None:
        text = re.sub(r"\s+", " ", self._text).strip()
        if text:
            self.lines.append((self._level, text))
            self._within.append(bool(self._main))
        self._text = ""

    def main_lines(self) -> list[tuple[int, str]]:
        """The lines within the page's main element, all if it has none."""
        return [x for x, inside in zip(self.lines, self._within) if inside] if any(self._within) else self.lines

    def handle_starttag(self, tag: str, attrs: list) -> None:
        values = dict(attrs)
        names = {*(values.get("class") or "").lower().split(), (values.get("id") or "").lower()}
        if self._silent:
            if tag == self._silent[-1]:
                self._silent.append(tag)
            return
        if tag in _SILENT or (names & _NOISE and tag not in _VOID):
            if tag not in _VOID:
                self._silent.append(tag)
            return
        if self._main and tag == self._main[-1] or not self._main and tag not in _VOID and (tag in ("main", "article") or names & _MAIN):
            self._break()
            self._main.append(tag)
        if tag in _LISTS:
            self._break()
            self._lists.append([tag, len(self.lines), 0])
        if tag == "title":
            self._title = True
        if tag in _BLOCKS or tag == "br":
            self._break()
        if re.fullmatch("h[1-6]", tag):
            self._level = int(tag[1])
        if tag == "a":
            if href := values.get("href"):
                if href.startswith("#"):
                    for x in self._lists:
                        x[2] += 1
                    self.anchors.append(("ref", href[1:], len(self.lines), len(re.sub(r"\s+", " ", self._text).lstrip())))
                self._link = [normal_link(self.base, href), ""]
            if name := values.get("name") or values.get("id"):
                self.anchors.append(("def", name, len(self.lines), len(re.sub(r"\s+", " ", self._text).lstrip())))

    def handle_endtag(self, tag: str) -> None:
        if self._silent:
            if tag == self._silent[-1]:
                self._silent.pop()
            return
        if tag == "title":
            self._title = False
        if tag == "a" and self._link:
            self.links.append((self._link[0], re.sub(r"\s+", " ", self._link[1]).strip()))
            self._link = None
        if tag in _BLOCKS:
            self._break()
        if self._lists and tag == self._lists[-1][0]:
            _, first, links = self._lists.pop()
            if links >= INTERNAL_LINKS and sum(len(x) for _, x in self.lines[first:]) < INTERNAL_CHARS:
                del self.lines[first:], self._within[first:]
        if self._main and tag == self._main[-1]:
            self._break()
            self._main.pop()
        if re.fullmatch("h[1-6]", tag):
            self._level = 0

    def handle_data(self, data: str) -> None:
        if self._title:
            return
        if self._link is not None:
            self._link[1] += data
        if not self._silent:
            self._text += data


def parse(url: str, html: str | None) -> _Page:
    page = _Page(url or "")
    page.feed(html or "")
    page.close()
    page._break()
    return page


def _each(columns: str, kinds: list[pa.DataType], rows_of):
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(u, *r) for u, h in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()) for r in rows_of(parse(u, h))]
            data = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(data, kinds)], names)

    return lambda pages: pages.select("url", "html").mapInArrow(run, columns)


#: (url, line_index, level, text): lines of text without scripts, navigation and forms; level is a heading's, else 0.
page_lines = _each("url string, line_index int, level int, text string", [pa.string(), pa.int32(), pa.int32(), pa.string()], lambda p: [(i, lv, t) for i, (lv, t) in enumerate(p.main_lines())])
#: (url, ord, target, label): links in the order of the page.
page_links = _each("url string, ord int, target string, label string", [pa.string(), pa.int32(), pa.string(), pa.string()], lambda p: [(i, t, s) for i, (t, s) in enumerate(p.links)])
#: (url, kind, name, line_index, offset): references to and definitions of anchors in the page.
page_anchors = _each("url string, kind string, name string, line_index int, offset int", [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()], lambda p: p.anchors)


def accepted_links(links: DataFrame, hosts: list[str], prefixes: list[str], skip: list[str]) -> DataFrame:
    """Links to texts: allowed hosts and path prefixes, page endings, no label of the deny list or under two characters."""
    host, path = F.parse_url("target", F.lit("HOST")), F.coalesce(F.parse_url("target", F.lit("PATH")), F.lit(""))
    allowed = F.lit(False)
    for p in prefixes:
        allowed = allowed | F.startswith(path, F.lit(p))
    keep = host.isin(*hosts) & allowed & F.lower(path).rlike(r"(?:\.html?|/)$") & (F.length("label") >= 2) & ~F.col("label").isin("主页", "首页", "返回", "上一页", "下一页", "目录", "中文版")
    for word in skip:
        keep = keep & ~F.contains(F.lower("label"), F.lit(word.lower()))
    return links.where(keep)


def chapter_links(links: DataFrame) -> DataFrame:
    """Of index-like pages the first MOST_LINKS different targets, if there are at least LEAST_LINKS."""
    index_like = F.col("url").rlike(r"(?:/|index\.html?)$")
    first = links.where(index_like & (F.col("target") != F.col("url"))).groupBy("url", "target").agg(F.min(F.struct("ord", "label")).alias("f"))
    order = Window.partitionBy("url").orderBy("f.ord", "target")
    placed = first.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < MOST_LINKS)
    several = placed.where(F.col("place") == LEAST_LINKS - 1).select("url")
    return placed.join(several, "url", "left_semi").select("url", "place", "target", F.col("f.label").alias("label"))


def inventory(links: DataFrame) -> DataFrame:
    """One row for each work URL of author pages (author_id, ord, target, label, year): all authors, first label, first year that isn't empty."""
    key = F.struct("author_id", "ord")
    return links.groupBy(F.col("target").alias("source_url")).agg(F.array_sort(F.collect_set("author_id")).alias("author_ids"), F.min_by("label", key).alias("title"), F.min_by(F.nullif("year", F.lit("")), F.when(F.col("year") != "", key)).alias("year"))


def kept_lines(lines: DataFrame, title: str, archive: str, noise: list[str]) -> DataFrame:
    """Lines of the text: no navigation words, breadcrumbs or notices of the archive, not the title, at least two characters."""
    t = F.col("text")
    low = F.lower(t)
    keep = (F.length(t) >= 2) & (t != F.lit(title)) & ~low.isin("home", "index", "next", "previous", "up", "contents", "返回", "主页", "首页", "下一页", "上一页", "目录", "打印") & ~t.isin("->", "- >", "→", ">>", "»")
    keep = keep & ~(t.rlike("^(?:->|→|>>) ") & (F.length(t) <= 40)) & ~t.rlike(rf"^\Q{archive}\E(?:\s*(?:->|→|>>|»).*|\s*[0-9]{{4}}年[0-9]{{1,2}}月(?:[0-9]{{1,2}}日)?更新[。.]?)?$")
    for word in noise:
        keep = keep & ~F.contains(low, F.lit(word.lower()))
    return lines.where(keep)

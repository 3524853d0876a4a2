import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import dates as D
from lectern.functions import text as X


def value(spark, column, *args):
    names = [f"c{i}" for i in range(len(args))]
    frame = spark.createDataFrame([tuple(args)], ", ".join(f"{n} string" for n in names))
    return frame.select(column(*(F.col(n) for n in names)).alias("v")).first().v


def test_spaces(spark):
    assert value(spark, X.clean_space, "　a \n  b　") == "a b"
    assert value(spark, X.compact, " a b　c ") == "abc" and value(spark, X.compact, None) == ""


@pytest.mark.parametrize("text, want", [(" 政治经济学，劳动 ,劳动; Capital;capital", ["政治经济学", "劳动", "Capital"]), ("", []), (None, None), (",，;；", []), ("x" * 30, ["x" * 24])])
def test_tags(spark, text, want):
    assert value(spark, X.tags, text) == want


@pytest.mark.parametrize(
    "title, want", [("8.01", "numeric-only title"), ("14.9598威根64418.0棉业", "probable table row"), ("1922年12月24日", None), ("（12）", None), ("", "empty title"), ("12 工人", None), ("1、概论", None)]
)
def test_suspicious(spark, title, want):
    assert value(spark, X.suspicious_title, title) == want


@pytest.mark.parametrize("line, want", [("第一章 商品", 2), ("一、商品", 2), ("（一）商品", 3), ("1. 商品", 3), ("一、商品。", None), ("普通的话", None), ("x" * 80, None)])
def test_heading(spark, line, want):
    assert value(spark, X.heading_level, line) == want


@pytest.mark.parametrize("raw, want", [("目录…………… 12", "目录"), ("商 品", "商品"), ("第一章商品", "第一章 商品"), ("标题 12―15", "标题"), ("……………", "……………")])
def test_title(spark, raw, want):
    assert value(spark, X.clean_title, raw) == want


@pytest.mark.parametrize("m, want", [("[012]", "[12"), ("［12］", "[12"), ("〔3a〕", "〔3a"), ("①", "①"), ("【80】", "【80")])
def test_marker(spark, m, want):
    assert value(spark, X.marker_key, m) == want


def test_private_use(spark):
    assert value(spark, X.map_private_use, "某些共同标") == "　某些共同标志"


@pytest.mark.parametrize(
    "text, want",
    [("1917年12月27日（1月9日）", ("1918-01-09", "", "new style")), ("1900年2月29日", None), ("1901―1902年", ("1901", "1902", "range of years")), ("1848年2月", ("1848-02", "", "")), ("1848年2月21、22日", ("1848-02-21", "", "first of several")), ("无", None), (None, None)],
)
def test_printed_dates(spark, text, want):
    got = value(spark, D.printed_date, text)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize("text, want", [("写于1913年6月1925年第一次载于某报", "1925"), ("载于1850年3月5日《报》", "1850-03-05"), ("译成中文载于1950年3月", None), ("他在1850年说", None), ("1848年2月第一次发表", "1848-02")])
def test_credits(spark, text, want):
    got = value(spark, D.publication_credit, text)
    assert (got.date_start if got else None) == want


@pytest.mark.parametrize("text, order, label", [("1848", 18480101, "1848年"), ("1848-02", 18480201, "1848年2月"), ("1848-02-21", 18480221, "1848年2月21日"), ("2026-02-30", None, None), ("x", None, None)])
def test_partial(spark, text, order, label):
    assert value(spark, lambda c: D.date_order(D.partial_date(c)), text) == order and value(spark, lambda c: D.date_label(D.partial_date(c)), text) == label


def test_years(spark):
    assert value(spark, X.local_year, "论1848年", "论1848年 1850") == "1848"
    assert value(spark, X.local_year, "1848到1850", "") == "" and value(spark, X.local_year, "论", "论 1850 年") == "1850"


@settings(max_examples=25, deadline=None, derandomize=True)
@given(st.lists(st.text("ab。. ", min_size=1, max_size=9), max_size=12).map("".join))
def test_packs(spark, text):
    """Nothing but white space is lost, long pieces are single sentences, and no piece could take in the next one's beginning."""
    packs = value(spark, lambda c: X.pack_sentences(c, 8), text)
    bare = lambda t: t.replace(" ", "")
    assert bare("".join(packs)) == bare(text)
    if len(text) <= 16:
        assert packs == [text]
        return
    import re

    ends = lambda t: len(re.findall("。|[.] ", t.strip()[:-1]))
    for piece, following in zip(packs, [*packs[1:], None]):
        assert len(piece) <= 8 + 2 or ends(piece) == 0 or len(bare(piece)) <= 8
        if following:
            first = re.match("[^。.]*(?:。|[.](?= |$)|$)|.*", following)[0]
            assert len(piece) + len(following) > 8 or len(piece) + len(first) > 8


def test_merge(spark):
    got = spark.createDataFrame([(["a" * 60, "b", "c。", "d"],)], "x array<string>").select(X.merge_lines(F.col("x")).alias("v")).first().v
    assert got == ["a" * 60 + "bc。", "d"]


def test_excerpt(spark):
    f = spark.createDataFrame([("x" * 50 + "needle" + "y" * 60,)], "t string")
    assert f.select(X.excerpt(F.col("t"), F.lit(50), F.lit(6)).alias("v")).first().v == "…" + "x" * 32 + "needle" + "y" * 48 + "…"

import hashlib
import io
import json
import zipfile

import pytest

from lectern.sources import library, pages, preferences, sinks

BOOK = {
    "schemaVersion": 2,
    "authors": [{"id": "a", "nameZh": "甲", "nameEn": "A"}],
    "books": [{"id": "b1", "titleZh": "书", "language": "zh", "authorIds": ["a"], "chapters": [{"id": "c1", "title": "章", "level": 9, "content": [" 一 ", "", "二三"], "footnotes": [{"id": "f1", "marker": "[1]", "content": ["注"], "references": [{"paragraphIndex": 1, "start": 0, "end": 2}, {"paragraphIndex": 7, "start": 0, "end": 1}]}, {"id": "f2", "content": [""], "references": []}], "sections": []}], "toc": [{"id": "t1", "type": "CHAPTER", "order": 0}]}],
}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "books").mkdir()
    (tmp_path / "books" / "b1.json").write_text(json.dumps(BOOK, ensure_ascii=False))
    (tmp_path / "books" / "bad.json").write_text("{not json")
    (tmp_path / "books" / "v9.json").write_text(json.dumps(BOOK | {"schemaVersion": 9}))
    return str(tmp_path)


def test_library(spark, folder):
    lib = library.read_library(spark, folder)
    assert [r.id for r in lib.books.collect()] == ["b1"] and lib.authors.count() == 1 and lib.toc.count() == 1
    c = lib.chapters.first()
    assert (c.content, c.level) == (["一", "二三"], 4)
    assert [(r.id, len(r.references)) for r in lib.footnotes.collect()] == [("f1", 1)]
    assert {r.reason for r in lib.bad_files.collect()} == {"malformed", "schema version"}
    assert library.read_book(spark, folder, "b1").chapters.count() == 1
    found = library.asset_findings(library.read_json(spark, f"{folder}/books/b1.json"), spark.createDataFrame([("b1",), ("b2",)], "book_id string"))
    assert [(r.code, r.location) for r in found.collect()] == [("MISSING_BOOK_ASSET", "b2")]


@pytest.mark.parametrize("raw, declared, want", [("工人".encode("gb18030"), "utf-8", "gb18030"), ("工人".encode(), None, "utf-8"), (b"<meta charset=gbk>" + "工".encode("gbk"), None, "gb18030"), (b"\xff\xff\xff", None, "utf-8/replace"), (None, "nonsense", "utf-8")])
def test_decoding(raw, declared, want):
    text, encoding = pages.decode_page(raw, declared)
    assert encoding == want and ("工" in text) == (b"\xff" not in (raw or b"\xff"))


HTML = """<html><head><title>x</title><style>p{}</style></head><body><nav>menu</nav><h2>标题</h2><p>一<br>二<p>三 <a href="#n1">[1]</a>
<script>no</script><a name="n1">[1]</a> 注 <a href="../y.htm;p?q=1#z">下一章</a></body>"""


def test_html(spark):
    p = spark.createDataFrame([("https://h.test/a/b/index.htm", HTML), ("https://h.test/e", ""), ("https://h.test/n", None)], "url string, html string")
    assert [(r.level, r.text) for r in pages.page_lines(p).orderBy("line_index").collect()] == [(2, "标题"), (0, "一"), (0, "二"), (0, "三 [1] [1] 注 下一章")]
    links = pages.page_links(p)
    assert [(r.target, r.label) for r in links.orderBy("ord").collect()][1] == ("https://h.test/a/y.htm?q=1", "下一章")
    assert {(r.kind, r.name) for r in pages.page_anchors(p).collect()} == {("ref", "n1"), ("def", "n1")}
    kept = pages.accepted_links(links, ["h.test"], ["/a/"], ["skip"])
    assert [r.label for r in kept.collect()] == ["[1]", "下一章"]


def test_kept_lines(spark):
    f = spark.createDataFrame([(x,) for x in ["正文一行", "返回", "-> 章", "某文库 -> 作者", "某文库2020年1月更新", "T", "题目", "contact us here"]], "text string")
    assert [r.text for r in pages.kept_lines(f, "题目", "某文库", ["contact us"]).collect()] == ["正文一行"]


def test_zip(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a.txt", "hello")
    f = spark.createDataFrame([("ok", bytearray(buffer.getvalue())), ("bad", bytearray(b"no"))], "path string, content binary")
    got = {r.path: (r.member, r.sha256) for r in pages.zip_members(f).collect()}
    assert got == {"ok": ("a.txt", hashlib.sha256(b"hello").hexdigest()), "bad": (None, None)}


def test_snapshots(spark, tmp_path):
    (tmp_path / "p.html").write_bytes(b"<p>x")
    (tmp_path / "p.json").write_text(json.dumps({"url": "u", "rawSha256": hashlib.sha256(b"<p>x").hexdigest()}))
    assert [(r.url, r.verified) for r in pages.snapshots(spark, str(tmp_path)).collect()] == [("u", True)]


def test_swap(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert sinks.swap_in(spark.range(3), path, "one") and not sinks.swap_in(spark.range(9), path, "one")
    with pytest.raises(ValueError):
        sinks.swap_in(spark.range(0), path, "two")
    assert spark.read.parquet(path).count() == 3 and sinks.swap_in(spark.range(5), path, "two") and spark.read.parquet(path).count() == 5
    copy = sinks.backup(spark, path, "bak")
    assert spark.read.parquet(copy).count() == 5
    assert sinks.write_package(spark.createDataFrame([("a", 1), ("b", 2)], "book_id string, n int"), f"{tmp_path}/p", apply=False) == 2


def test_settings(spark):
    rows = spark.createDataFrame([("u", "size", "18"), ("u", "dark", "true"), ("v", "size", "big"), ("v", None, "x")], "owner string, key string, value string")
    got = {r.owner: (r.size, r.dark) for r in preferences.typed(rows, "owner", {"size": ("int", 16), "dark": ("boolean", False)}).collect()}
    assert got == {"u": (18, True), "v": (16, False)}


def test_main_element_noise_and_lists_of_links():
    html = """<body><div class="Menu wide">a <div>b</div> c</div><p>before</p><div id="content"><p>one</p>
    <ul><li><a href="#x">X</a><li><a href="#y">Y</a><li><a href="#z">Z</a></ul><ul><li><a href="#x">X</a></li><li>kept</li></ul><div><p>two</p></div></div><p>after</p></body>"""
    assert [t for _, t in pages.parse("https://a.test/", html).main_lines()] == ["one", "X", "kept", "two"]
    assert [t for _, t in pages.parse("https://a.test/", "<p>a<p>b<nav>c</nav>").main_lines()] == ["a", "b"]
    long = "<table>" + "".join(f"<tr><td><a href='#n{i}'>{'x' * 1000}</a></td></tr>" for i in range(3)) + "</table>"
    assert len(pages.parse("https://a.test/", long).main_lines()) == 3

from pyspark.sql import functions as F

from lectern.operators import audit as A
from lectern.operators import catalog as C


def test_merge(spark):
    s = "k string, n int, v string"
    old = spark.createDataFrame([("a", 3, "old"), ("b", 1, "old"), ("c", 2, "old")], s)
    fresh = spark.createDataFrame([("a", 2, "new"), ("b", 1, "new"), ("d", 1, "new")], s)
    assert {r.k: (r.v, r.action) for r in C.merged(old, fresh, "k", "n").collect()} == {"a": ("old", "kept"), "b": ("new", "replaced"), "c": ("old", "kept"), "d": ("new", "added")}


def test_toggle(spark):
    e = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), ("c", 1, "p"), ("c", 2, "q"), ("c", 3, "r")], "k string, t int, v string")
    assert {r.k: r.v for r in C.toggled(e, ["k"], F.col("t"), "v").collect()} == {"b": "z", "c": "r"}


def test_patch_and_guard(spark):
    base = spark.createDataFrame([("a", "1", None), ("b", "2", "y")], "k string, u string, v string")
    patch = spark.createDataFrame([("a", None, "new"), ("z", "9", "9")], "k string, u string, v string")
    assert {r.k: (r.u, r.v) for r in C.patched(base, patch, "k", ["u", "v"]).collect()} == {"a": ("1", "new"), "b": ("2", "y")}
    assert [r.k for r in C.unknown_keys(patch, base, "k").collect()] == ["z"]


def test_fingerprint_ignores_order(spark):
    rows = [("b", "k1", "x"), ("b", "k2", "y"), ("c", "k1", None)]
    a, b = (C.fingerprint(spark.createDataFrame(r, "g string, k string, v string"), "k", "v", "g").collect() for r in (rows, rows[::-1]))
    assert sorted(a) == sorted(b) and len({r.fingerprint for r in a}) == 2


def test_migration(spark):
    out = C.migrated(spark.createDataFrame([(1, "abc")], "id int, excerpt string"), {"end": F.length("excerpt"), "excerpt": F.lit("no")})
    assert tuple(out.first()) == (1, "abc", 3)


TOC = "book_id string, node_id string, parent_id string, node_type string, chapter_id string, paragraph_index int"


def test_toc(spark):
    nodes = spark.createDataFrame(
        [("b", "r", None, "VOLUME", None, 0), ("b", "x", "r", "CHAPTER", "c", 5), ("b", "y", "gone", "POEM", "lost", 0), ("b", "p", "q", "PART", None, 0), ("b", "q", "p", "PART", None, 0), ("b", "r", None, "PART", None, 0)], TOC
    )
    found = {(r.code, r.location) for r in A.toc(nodes, spark.createDataFrame([("c", ["only"])], "chapter_id string, content array<string>")).collect()}
    assert found == {("DUPLICATE_TOC_ID", "r"), ("UNKNOWN_TOC_PARENT", "y"), ("INVALID_TOC_TYPE", "y"), ("UNKNOWN_TOC_CHAPTER", "y"), ("TOC_TARGET_OUT_OF_RANGE", "x"), ("TOC_PARENT_CYCLE", "p"), ("TOC_PARENT_CYCLE", "q")}


def test_clean_chapter_has_no_findings(spark):
    schema = "chapter_id string, title string, content array<string>, sections array<struct<section_id:string,title:string,section_level:int,paragraph_index:int>>"
    fine = ("c", "题", ["正文" * 60], [("s", "一、节", 2, 0)])
    assert A.chapters(spark.createDataFrame([fine], schema)).count() == 0
    bad = ("d", " ", ["上一篇 回目录 下一篇", "", "<p>�", "同", "同"], [("s", "8.01", 2, 99), ("s", "节", 2, 0)])
    codes = {r.code for r in A.chapters(spark.createDataFrame([bad], schema)).collect()}
    assert codes == {"MISSING_CHAPTER_TITLE", "CHAPTER_BODY_TOO_SHORT", "EMPTY_PARAGRAPH", "REPLACEMENT_CHARACTER", "PRIVATE_USE_CHARACTER", "HTML_LEAK", "NAVIGATION_LINE", "CONSECUTIVE_DUPLICATE_PARAGRAPH", "DUPLICATE_SECTION_ID", "SUSPICIOUS_SECTION_TITLE", "SECTION_TARGET_OUT_OF_RANGE"}

from pyspark.sql import functions as F

from lectern.operators import positions as P

CHAPTERS = "book_id string, chapter_id string, chapter_ord int, content array<string>, sections array<struct<section_id:string,title:string,section_level:int,paragraph_index:int>>, fetched_at timestamp"


def test_offsets(spark):
    c = spark.createDataFrame([("b", "c", 0, ["abc", "", None, "de"], [], None), ("b", "d", None, ["x" * 5], [], None), ("b", "e", 1, None, [], None)], CHAPTERS)
    assert [(r.paragraph_index, r.length, r.start) for r in P.paragraph_offsets(c).where("chapter_id = 'c'").orderBy("start").collect()] == [(0, 3, 0), (1, 2, 3)]
    assert {r.chapter_id: (r.place, r.start, r.book_length) for r in P.chapter_offsets(c).collect()} == {"c": (0, 0, 10), "e": (1, 5, 10), "d": (2, 5, 10)}


def test_as_of_against_brute_force(spark):
    import random

    rng = random.Random(1)
    points = [(i, rng.choice("ab"), rng.randrange(20)) for i in range(60)]
    marks = [(rng.choice("ab"), rng.randrange(20), f"v{i:02d}") for i in range(25)]
    got = {r.id: r.v for r in P.as_of(spark.createDataFrame(points, "id int, k string, p int"), spark.createDataFrame(marks, "k string, m int, v string"), "k", "p", "m", "v").collect()}
    for i, k, p in points:
        best = max(((m, v) for kk, m, v in marks if kk == k and m <= p), default=(None, None))
        assert got[i] == best[1]


def test_nearest_before(spark):
    points = spark.createDataFrame([("a", 9), ("a", 20), ("a", 3)], "k string, p int")
    marks = spark.createDataFrame([("a", 3), ("a", 8), ("b", 1)], "k string, m int")
    assert {r.p: r.nearest for r in P.nearest_before(points, marks, "k", "p", "m", 8).collect()} == {9: 8, 20: None, 3: None}


def test_shifts(spark):
    ranges = spark.createDataFrame([(1, "c", 5, 10), (2, "d", 0, 2)], "id int, c string, range_start int, range_end int")
    inserts = spark.createDataFrame([("c", 5, 3), ("c", 10, 4), ("c", 7, 1)], "c string, at int, size int")
    assert {r.id: (r.range_start, r.range_end) for r in P.shifted(ranges, inserts, "c").collect()} == {1: (8, 14), 2: (0, 2)}


def test_pages_and_overlap(spark):
    lengths = spark.createDataFrame([("a", 95), ("b", 40), ("z", 0)], "k string, length int")
    pages = P.pages(lengths, 40, "k")
    assert sorted((r.k, r.page_start, r.page_end) for r in pages.collect()) == [("a", 0, 40), ("a", 40, 80), ("a", 80, 95), ("b", 0, 40)]
    notes = spark.createDataFrame([("a", 30, 81)], "k string, s int, e int")
    assert sorted((r.clip_start, r.clip_end) for r in P.overlaps(notes, pages, ["k"], "s", "e", "page_start", "page_end").collect()) == [(30, 40), (40, 80), (80, 81)]


def test_parents(spark):
    secs = [("s1", "t", 1, 0), ("s2", "t", 2, 1), ("s3", "t", 3, 2), ("s4", "t", 2, 3), ("s5", "t", 1, 4)]
    c = spark.createDataFrame([("b", "c", 0, ["x"], secs, None)], CHAPTERS)
    assert {r.section_id: r.parent_id for r in P.with_parents(c).collect()} == {"s1": None, "s2": "s1", "s3": "s2", "s4": "s1", "s5": None}


def test_kept_indexes(spark):
    e = spark.createDataFrame([("c", i, x) for i, x in enumerate("abxcx")], "k string, paragraph_index int, t string")
    assert [(r.paragraph_index, r.new_index) for r in P.kept_indexes(e, F.col("t") != "x", "k").orderBy("paragraph_index").collect()] == [(0, 0), (1, 1), (3, 2)]


def test_latest(spark):
    import datetime as dt

    c = spark.createDataFrame([("b", "c", 0, ["old"], [], None), ("b", "c", 0, ["new"], [], dt.datetime(2026, 1, 1)), ("b", None, 0, ["x"], [], None)], CHAPTERS)
    assert [r.content for r in P.latest_chapters(c).collect()] == [["new"]]

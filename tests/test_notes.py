from lectern.operators import notes as N

BODY = ["正文[12]，另一个引用[13]。", "又见[12]。", "注释：", "[12]第一段", "续段。", "[13]第二条。"]


def outcomes(spark, chapters):
    s = N.scanned(spark.createDataFrame(chapters, "book_id string, chapter_id string, content array<string>"))
    return {(r.chapter_id, r.paragraph_index, r.marker): (r.outcome, r.content) for r in N.resolved(N.references(s), N.definitions(s)).collect()}


def test_notes_of_a_chapter(spark):
    got = outcomes(spark, [("b", "c", BODY)])
    assert got == {("c", 0, "[12]"): ("resolved", ["第一段", "续段。"]), ("c", 0, "[13]"): ("resolved", ["第二条。"]), ("c", 1, "[12]"): ("resolved", ["第一段", "续段。"])}


def test_volume_notes_and_families(spark):
    got = outcomes(spark, [("b", "c", ["正文[7]。和〔7〕"]), ("b", "n", ["注释", "[7]卷末注。"]), ("x", "d", ["别的书[7]。"])])
    assert got[("c", 0, "[7]")] == ("resolved", ["卷末注。"]) and got[("c", 0, "〔7〕")][0] == "missing-definition" and got[("d", 0, "[7]")][0] == "missing-definition"


def test_ambiguous_stays_open(spark):
    got = outcomes(spark, [("b", "c", ["正文[1]。", "注释：", "[1]甲。", "注释：", "[1]乙。"])])
    assert got[("c", 0, "[1]")] == ("ambiguous", None)


def test_local_circles(spark):
    got = outcomes(spark, [("b", "c", ["句子①说。", "①脚注一。", "别的①。", "①脚注二。"])])
    assert got[("c", 0, "①")][1] == ["脚注一。"] and got[("c", 2, "①")][1] == ["脚注二。"]


def test_no_references():
    assert N.printed_markers(["[12]开头", "在[1848]年", "见注[3]", "第[5]页", "正[5]页"]) == [] or all(m["marker"] not in ("[1848]", "[3]") for m in N.printed_markers(["在[1848]年", "见注[3]", "正[5]页"]))


def test_linked_and_odd(spark):
    s = N.scanned(spark.createDataFrame([("b", "c", BODY), ("b", "d", None), ("b", "e", [None, ""])], "book_id string, chapter_id string, content array<string>"))
    refs = N.references(s)
    notes = spark.createDataFrame([("c", [(r.paragraph_index, r.start, r.end) for r in refs.collect()])], "chapter_id string, refs array<struct<paragraph_index:int,start_offset:int,end_offset:int>>")
    assert refs.count() == 3 and N.without_linked(refs, notes).count() == 0


def test_supplements(spark):
    import hashlib

    text = "正文[12]。"
    para = spark.createDataFrame([("c", 0, text)], "chapter_id string, paragraph_index int, text string")
    h = hashlib.sha256(text.encode()).hexdigest()
    rows = [("c", 0, 2, "[12]", h, ["注"]), ("c", 0, 1, "[12]", h, ["注"]), ("c", 0, 3, "[12]", "0", ["注"])]
    ok, refused = N.supplements(spark.createDataFrame(rows, "chapter_id string, paragraph_index int, start int, marker string, paragraph_sha256 string, content array<string>"), para)
    assert [r.start for r in ok.collect()] == [2] and refused.count() == 2


def test_pages_at_the_end_of_a_note_are_no_references():
    assert N.printed_markers(["见该书第一卷——[35]。", "见该书第一卷—— [35]", "见该书——[35]的说法"]) == [{"paragraph_index": 2, "start": 5, "end": 9, "marker": "[35]"}]


def test_first_of_several_definitions(spark):
    rows = spark.createDataFrame([("p", "a", 3, "later"), ("p", "a", 1, "first"), ("p", "b", 2, "only")], "page string, name string, ord int, text string")
    assert {r.name: r.text for r in N.first_definitions(rows, ["page", "name"], "ord").collect()} == {"a": "first", "b": "only"}

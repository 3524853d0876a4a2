"""Queries on small tables of which a prefix would not do."""

import datetime
import hashlib

from lectern import queries as Q

CHAPTERS = "book_id string, chapter_id string, chapter_ord int, title string, content array<string>, sections array<struct<section_id:string,title:string,section_level:int,paragraph_index:int>>, fetched_at timestamp"
FOOTNOTES = "footnote_id string, book_id string, chapter_id string, marker string, content array<string>, refs array<struct<paragraph_index:int,start_offset:int,end_offset:int>>"


def day(n):
    return datetime.datetime(2026, 1, n)


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def test_snippet_of_a_late_hit(spark, tmp_path):
    texts = ["工" + "甲" * 200, "甲" * 500 + "工" + "乙工" + "丙" * 100, "甲" * 120 + "工", "没有", None, "甲" * 300 + "工<b>"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = {}
    for i, text in enumerate(texts):
        if text and (s := text.find("工")) >= 0:
            a, b = max(s - 32, 0), min(s + 49, len(text))
            cut = "…" * (a > 0) + text[a:b] + "…" * (b < len(text))
            expected[i] = (md5(cut.replace("工", "<b>工</b>")), "<b>" not in cut)
    assert sorted(expected) == [0, 1, 2, 5]
    assert {r.doc_id: (r.digest, r.same) for r in Q.queries()["f14_marked_snippets"](spark, str(tmp_path)).collect()} == expected


def test_chapters_past_the_last_part(spark, tmp_path):
    rows = [(b, f"{b}{i:02}", i, "t", ["x"], [], day(1)) for b, n in (("a", 20), ("b", 16), ("c", 2)) for i in range(n)]
    spark.createDataFrame(rows, CHAPTERS).write.parquet(f"{tmp_path}/chapters.parquet")
    got = {r.chapter_id: r.part for r in Q.queries()["w14_parts_by_size"](spark, str(tmp_path)).collect()}
    assert got == {r[1]: next((p for p, past in ((1, 3), (2, 8), (3, 16)) if r[2] < past), None) for r in rows}
    assert [c for c, p in sorted(got.items()) if p is None] == ["a16", "a17", "a18", "a19"]


def test_blocks_against_whole_texts(spark, tmp_path):
    block = {k: k * 90 for k in "甲乙丙丁戊己庚"}
    menu = ("上一篇（" + "页" * 30 + "）") * 3
    chapters = [
        ("b", "c1", 0, "t", [block["甲"], "短", "短", block["乙"], block["丙"]], [], day(2)),
        ("b", "c1", 0, "t", [block["甲"], block["丁"], block["丁"], block["丙"][:50] + " \n" + block["丙"][50:]], [], day(1)),
        ("b", "c2", 1, "t", [block["戊"][:40], block["戊"][40:], None, "短", menu], [], day(2)),
        ("b", "c2", 1, "t", [block["戊"], block["己"], "短" * 79], [], day(1)),
        ("b", "c3", 2, "t", None, [], day(2)),
        ("b", "c3", 2, "t", [block["庚"]], [], day(1)),
        ("b", None, 3, "t", [block["庚"]], [], day(1)),
    ]
    notes = [("n1", "b", "c2", "1", [block["己"][:20], block["己"][20:]], []), ("n2", "b", "c2", "2", None, []), ("n3", "b", "c1", "3", [block["己"]], [])]
    spark.createDataFrame(chapters, CHAPTERS).write.parquet(f"{tmp_path}/chapters.parquet")
    spark.createDataFrame(notes + notes[:1], FOOTNOTES).write.parquet(f"{tmp_path}/footnotes.parquet")
    expected = set()
    for _, c, _, _, content, _, _ in chapters:
        newest = next((x[4] for x in chapters if x[1] == c and x[6] == day(2)), None) or []
        local = "".join(x for x in newest if x and x != menu) + "".join(y for n in notes if n[2] == c for y in n[4] or [])
        for x in content or []:
            if c and x and len(x) >= 80 and "".join(x.split()) not in local:
                expected.add((c, md5(x)))
    assert expected == {("c1", md5(block["丁"])), ("c2", md5(menu)), ("c3", md5(block["庚"]))}
    got = [tuple(r) for r in Q.queries()["x0_missing_blocks"](spark, str(tmp_path)).select("chapter_id", "digest").collect()]
    assert sorted(got) == sorted(expected)


def test_several_references_in_a_paragraph(spark, tmp_path):
    spark.createDataFrame([("b", "c1", 0, "t", ["0123456789", "abc", "", None], [], day(1)), ("b", "c2", 1, "t", ["甲乙丙"], [], day(1))], CHAPTERS).write.parquet(f"{tmp_path}/chapters.parquet")
    refs = {"1": [(0, 0, 5)], "2": [(0, 8, 10), (0, 0, 0), (1, 0, 9)], "3": [(0, 4, 5), (2, 0, 0), (3, 0, 0)]}
    rows = [(f"n{m}", "b", "c1", m, ["x"], r) for m, r in refs.items()] + [("m", "b", "c2", "4", ["x"], [(0, 0, 1), (0, 1, 2)]), ("l", "b", "c2", None, ["x"], [(0, 0, 3)])]
    spark.createDataFrame(rows + rows[:1], FOOTNOTES).write.parquet(f"{tmp_path}/footnotes.parquet")
    expected = {("c1", 0): md5("{2}01234{1}{3}56789{2}"), ("c1", 2): md5("{3}"), ("c2", 0): md5("甲{4}乙{4}丙")}
    got = Q.queries()["r2_inserted_markers"](spark, str(tmp_path)).collect()
    assert len(got) == 3 and {(r.chapter_id, r.paragraph_index): r.digest for r in got} == expected

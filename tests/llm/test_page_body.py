import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import page_body as B

BODY = ["问题在于，孤立的羊毛是否暂时维持公开的报告，以及谁来颁布普遍的生产力。", "报纸在首页上印着“版权所有”四个字，事先修改廉价的统计册。", "Die gewöhnliche Färberei schließt künftig die größere Bücherei.", "（本篇据作者手稿刊印，标点从旧）", "* * *", "他们打印了几份传单，转发给会员。"] * 30
AROUND = ["您的位置：首页 » 文库 » 书信", "人物 - 投稿 - 登录 - 年表", "Diese Seite verwendet Cookies. Alle akzeptieren / Ablehnen", "阅读 50254　评论 8", "上一篇：论羊毛　下一篇：论报告", "Schlagworte: Kasse, Schule, Mühle", "点击右上角，发送给身边的读者"]


@pytest.fixture(scope="module")
def weights():
    """Weights of the seed alone."""
    batch = pa.RecordBatch.from_arrays([pa.array([BODY], pa.list_(pa.string()))], ["content"])
    known = B.seed_sample().lookups()
    return B.fit(B.seed_sample(), known, np.asarray(next(B.counting(known)(iter([batch]))).column("n"), float))


def best(texts, weights):
    return B.scan_texts(pa.array(texts, pa.large_string()), weights)


def test_separates(weights):
    assert (best(AROUND, weights) >= B.LEVEL).all()
    assert (best(BODY, weights) < B.LEVEL).all()


@pytest.mark.parametrize("glue", ["\n", " ", "　", " | ", "——"])
def test_parts_of_elements(weights, glue):
    line = "您现在的位置：网站首页 | 论坛 | 下载"
    for text in (line + glue + BODY[0], BODY[0] + glue + line):
        assert best([text], weights)[0] >= B.LEVEL
        t = B.Tokens.read(pa.array([text], pa.large_string()))
        left, gone = B.cut(text, weights.scores(t), t.starts, t.ends)
        assert left.strip() == BODY[0] and len(gone) == 1


def test_scan_equals_brute_force(weights):
    rng = np.random.default_rng(5)
    of = np.sort(rng.integers(0, 40, 300))
    scores = rng.normal(-0.3, 2, 300)
    got = B.stretches(scores, of, 40)
    for i in range(40):
        s = scores[of == i]
        want = max((s[a:b].sum() for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=0)
        assert got[i] == pytest.approx(want, abs=1e-6)


BOOKS = "book_id string, source_url string"


def test_operator_on_odd_tables(spark):
    rows = [("c1", "b", [None, "", AROUND[0], BODY[0]]), ("c1", "b", [None, "", AROUND[0], BODY[0]]), ("c2", "b", None), (None, "b", [AROUND[0]]), ("c3", None, BODY)]
    schema = "chapter_id string, book_id string, content array<string>"
    books = spark.createDataFrame([("b", "https://a.test/1")], BOOKS)
    frame = spark.createDataFrame(rows, schema).selectExpr("*", "'x' AS score", "2 AS removed", "3 AS cut", "4 AS template")
    assert {(r.chapter_id, r.paragraph_index) for r in B.around(frame, books).collect()} == {("c1", 2)}
    main = {r.chapter_id: (r.content, r.removed) for r in B.main_body(frame, books).collect()}
    assert main["c1"] == ([BODY[0]], 1) and main["c2"] == (None, 0) and main["c3"] == (BODY, 0)
    assert B.around(spark.createDataFrame([], schema), books).count() == 0


def test_lines_that_sites_repeat_are_learned(spark):
    """Words the seed lacks are learned from lines that two sites repeat; notes of editors and dividers that it repeats stay."""
    odd = "瀚渊夜航版匣 零售窗口"
    note = "（据手稿刊印，标点从旧）"
    rows = [(f"c{i}", "bf"[i % 2], [odd, f"工人第{chr(0x4E00 + i)}次赞成了报告，{chr(0x5000 + i)}则反对租约。", note, "* * *"]) for i in range(24)] + [("d", "e", [f"{BODY[0]}\n{odd}", note])]
    rows += [(f"x{i}", "e", BODY) for i in range(10)]
    books = spark.createDataFrame([("b", "https://a.test/1"), ("f", "https://f.test/1"), ("e", None)], BOOKS)
    frame = spark.createDataFrame(rows, "chapter_id string, book_id string, content array<string>")
    got = {(r.chapter_id, r.paragraph_index) for r in B.around(frame, books).collect()}
    assert got == {(f"c{i}", 0) for i in range(24)} | {("d", 0)}
    assert {r.chapter_id: r.content for r in B.main_body(frame, books).collect()}["d"] == [BODY[0], note]

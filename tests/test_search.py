import pyarrow as pa
from pyspark.sql import functions as F

from lectern import queries as core
from lectern.operators import search as S
from tests.oracle import connect, same

CH, BK = "book_id string, chapter_id string, title string, content array<string>", "book_id string, title_zh string"


def index(spark):
    chapters = spark.createDataFrame([("b", "c", "商品", ["劳动创造价值", "", None])], CH)
    return S.content_index(chapters, spark.createDataFrame([("b", "资本论")], BK))


def test_scopes(spark):
    ix = index(spark)
    cases = [("资本", "TITLES", 1), ("劳动", "TITLES", 0), ("劳动", "BODY", 1), ("资本 商品", "TITLES", 1), ("资本 不存在", "TITLES", 0), ("价值", "ALL", 0), ("资本 劳动", "ALL", 1), ("", "ALL", 0), ('"劳动*"', "BODY", 1)]
    for query, scope, n in cases:
        assert S.matching(ix, query, scope).count() == n, (query, scope)
    assert S.matching(ix, "劳动", "BODY", spark.createDataFrame([], BK)).count() == 0


def test_terms():
    assert S.terms("(OR NEAR:资本)") == ["or", "near", "资本"] and S.terms("x" * 99) == ["x" * 80]


def test_find_all(spark):
    f = spark.createDataFrame([(1, "劳动劳动，以及劳动。", "劳动"), (2, "aAaA", "aa"), (3, None, "x"), (4, "x", ""), (5, "İi", "i")], "id int, text string, needle string")
    assert [(r.id, r.start) for r in S.find_all(f).orderBy("id", "start").collect()] == [(1, 0), (1, 2), (1, 7), (2, 0), (2, 2), (5, 1)]


def test_texts_are_not_repeated_for_occurrences():
    batch = pa.RecordBatch.from_pydict({"id": [1, 2, 3], "text": ["的" * 2000, "无", "的"], "needle": ["的"] * 3})
    out = list(S._find_all(iter([batch])))
    assert sum(b.nbytes for b in out) < 3 * batch.nbytes
    assert [(r["id"], r["starts"]) for b in out for r in b.to_pylist()] == [(1, [*range(2000)]), (3, [0])]


def test_f12_has_a_row_for_each_document_row(spark, tmp_path):
    rows = [(1, "的，目的"), (1, "的，目的"), (1, "的"), (2, None), (3, "无"), (None, "的"), (4, ""), (5, "İ的的")]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    plan, sql = core.queries()["f12_all_occurrences"], core.oracle_sql()["f12_all_occurrences"]
    same(plan(spark, str(tmp_path)), connect(str(tmp_path)), sql)


def test_in_book(spark):
    p = spark.createDataFrame([("c", 0, "Ab ab"), ("c", 1, None)], "chapter_id string, paragraph_index int, text string")
    assert [r.start for r in S.in_book(p, " AB ").collect()] == [0, 3] and S.in_book(p, "a").count() == 0


NOTE = "id bigint, chapter_id string, paragraph_index int, excerpt string, selection_start int, selection_end int, prefix string, suffix string, paragraph_hash string"


def test_anchors(spark):
    para = spark.createDataFrame([("c", 0, "新的一段。"), ("c", 1, "前文。需要记录的句子。后文。"), ("c", 2, "甲句子乙"), ("c", 3, "丙句子丁")], "chapter_id string, paragraph_index int, text string")
    notes = [
        (1, "c", 1, "需要记录的句子", 3, 10, "", "", None), (2, "c", 0, "需要记录的句子", 3, 10, "前文。", "。后文。", None), (3, "c", 2, "句子", 50, 52, "丙", "丁", None),
        (4, "c", 2, "没有", 0, 2, None, None, None), (5, "gone", 2, "句子", 0, 2, None, None, None), (6, "c", None, "", None, None, None, None, None),
    ]
    got = {r.id: (r.state, r.paragraph_index, r.range_start, r.range_end) for r in S.resolved_anchors(spark.createDataFrame(notes, NOTE), para).collect()}
    assert got[1] == ("EXACT", 1, 3, 10) and got[2] == ("RELOCATED", 1, 3, 10) and got[3] == ("RELOCATED", 3, 1, 3)
    assert got[4] == ("FALLBACK", 2, 0, 0) and got[5] == ("FALLBACK", 2, 0, 0) and got[6][0] == "FALLBACK"


def test_note_creation(spark):
    r = spark.createDataFrame([("ab" * 40,)], "t string").select(S.note_anchors(F.col("t"), F.lit(40), F.lit(44)).alias("a")).first().a
    assert (r.excerpt, len(r.prefix), len(r.suffix), len(r.paragraph_hash)) == ("abab", 32, 32, 64)


def test_located_once(spark):
    t = spark.createDataFrame([("c", "abcabx")], "k string, text string")
    p = spark.createDataFrame([("c", 1, "ab"), ("c", 2, "abc"), ("c", 3, ""), ("c", 4, "zz")], "k string, piece_id int, piece string")
    assert [(r.piece_id, r.start) for r in S.located_once(t, p, "k").collect()] == [(2, 0)]

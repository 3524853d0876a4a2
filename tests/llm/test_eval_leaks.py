import random

import pytest

from lectern.llm import eval_leaks as E

ITEM = "问题在于孤立的羊毛是否暂时维持公开的报告以及谁来颁布普遍的生产力我们在梅坪县看到私有的大工业曾经掩盖着垄断与思想"
ITEMS, DOCS = "item_id bigint, text string", "doc_id bigint, text string"


def run(spark, docs, items, joined=False):
    d = spark.createDataFrame(docs, DOCS).selectExpr("*", "'x' AS item", "1 AS mark", "2 AS item_id")
    i = spark.createDataFrame(items, ITEMS).selectExpr("*", "'q' AS doc_id")
    frame = E._leaks_joined(d.select("doc_id", "text").where("doc_id is not null and text is not null"), i.selectExpr("item_id", "text AS item").where("item_id is not null and item is not null")).distinct() if joined else E.leaks(d, i)
    return {(r.doc_id, r.item_id) for r in frame.collect()}


@pytest.mark.parametrize("joined", [False, True])
def test_cases(spark, joined):
    docs = [
        (1, "开头。" + ITEM + "结尾"), (2, "、".join(ITEM)), (3, ITEM[:30]), (4, ITEM[:29] + "。" + ITEM[40:]), (5, None), (6, ""), (None, ITEM), (7, "别的" * 50), (1, "开头。" + ITEM + "结尾"), (8, ITEM[25:] + ITEM[:25]),
    ]
    items = [(10, ITEM), (11, None), (12, ""), (13, "短"), (None, ITEM), (10, ITEM)]
    assert len(ITEM) == 56
    assert run(spark, docs, items, joined) == {(1, 10), (2, 10), (3, 10), (8, 10)}
    assert run(spark, [], items, joined) == set() and run(spark, docs, [], joined) == set()


def test_case_and_width(spark):
    item = "The Common School fibre weekly reflects the OLD majority of 1876 pages"
    wide = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in item.upper())
    assert run(spark, [(1, wide)], [(5, item)]) == {(1, 5)}


@pytest.mark.parametrize("joined", [False, True])
def test_equals_brute_force(spark, joined):
    rng = random.Random(9)
    word = lambda n: "".join(chr(rng.randrange(0x4E00, 0x4E40)) for _ in range(n))
    items = [(i, word(rng.randrange(30, 120))) for i in range(12)]
    docs = []
    for d in range(60):
        _, t = items[rng.randrange(12)]
        a = rng.randrange(len(t))
        docs.append((d, word(40) + t[a : a + rng.randrange(20, 120)] + word(10) + t[: rng.randrange(60)] + word(20)))
    want = {(d, i) for d, x in docs for i, t in items if 2 * E.covered(t, x) >= len(t)}
    assert run(spark, docs, items, joined) == want


def test_covered():
    assert E.covered("a" * 30, "b" * 100) == 0 and E.covered(ITEM, ITEM) == 56 and E.covered("short", "short") == 0


def test_decontaminated(spark):
    d = spark.createDataFrame([(1, ITEM), (2, "别的")], DOCS)
    assert [r.doc_id for r in E.decontaminate(d, spark.createDataFrame([(1, ITEM)], ITEMS)).collect()] == [2]

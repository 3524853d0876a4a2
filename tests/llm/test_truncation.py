import pytest

from lectern.llm import truncation as T

SCHEMA = "doc_id bigint, source string, text string"
SENTENCE = "问题在于，孤立的羊毛是否暂时维持公开的报告，以及谁来颁布普遍的生产力。"
WHOLE = [
    SENTENCE, SENTENCE + "\n此致\n敬礼\n纳伦格", SENTENCE + "\n\n一九三二年三月三日于黑窑港", SENTENCE + "\n1. 自觉的油墨\n2. 缓慢的帮工", SENTENCE + "\n（完）", SENTENCE + "\n附：租约一览", SENTENCE + "\n东岭港乡村教员会",
    "The guild never explains it.\n\nTorhol, 1921", "It is left behind.\n— E. Rastor", "„Die Kasse“, schrieb er, „trägt die Münze.“", "“The old mill,” he wrote, “carries the coin.”", "【全文完】", "", None, SENTENCE + "\n夫萨罗　一八五一年九月廿五日",
]
CUT = [SENTENCE + "问题在于，直接的经", SENTENCE + "\n此刻的经费，", SENTENCE[:-4] + "&#x", SENTENCE[:-5] + "<a hre", SENTENCE[:-5] + "</", SENTENCE[:-3] + "�", "The guild never expl", SENTENCE + "“课本如", SENTENCE + "\n问题在", SENTENCE + "（École"]


def test_ends(spark):
    rows = [(i, None, t) for i, t in enumerate(WHOLE)] + [(100 + i, None, t) for i, t in enumerate(CUT)] + [(None, None, CUT[0])]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS reason", "1 AS limits", "2 AS chars")
    assert {r.doc_id for r in T.truncated(frame).collect()} == {100 + i for i in range(len(CUT))}


def test_limits(spark):
    body = SENTENCE * 40
    rows = [(i, "cut", body[i : i + 300]) for i in range(12)] + [(50 + i, "cut", body[: len(SENTENCE) * (1 + i % 5)]) for i in range(20)]
    rows += [(100 + i, "bytes", body[i : i + 330 + i % 2]) for i in range(12)] + [(200 + i, "free", SENTENCE * (1 + i)) for i in range(12)]
    frame = spark.createDataFrame(rows, SCHEMA)
    limits = {(r.source, r.measure): (r.low, r.high) for r in T.length_spikes(frame).collect()}
    assert limits["cut", "chars"] == (297, 300) and not any(s == "free" for s, _ in limits)
    found = {r.doc_id: r.reason for r in T.truncated(frame).collect()}
    ends = {i for i, s, t in rows if s == "cut" and len(t) == 300 and t[-1] != "。"}
    assert ends <= set(found) and all(found[i] == "limit" for i in ends)
    assert not {i for i, s, t in rows if t.endswith("。")} & set(found)
    rates = {r.source: (r.documents, r.truncated) for r in T.truncation_rates(frame).collect()}
    assert rates["cut"] == (32, len(ends)) and rates["free"] == (12, 0)
    assert {r.source: (r.at_limit, r.debris, r.open_end) for r in T.truncation_rates(frame).collect()}["cut"] == (len(ends), 0, 0)


def test_empty_and_repeats(spark):
    assert T.truncated(spark.createDataFrame([], SCHEMA)).count() == 0
    twice = spark.createDataFrame([(1, "a", CUT[0]), (2, "a", CUT[0]), (2, "a", CUT[0])], SCHEMA)
    assert {r.doc_id for r in T.truncated(twice).collect()} == {1, 2}
    assert T.truncation_rates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n", [300, 380, 420, 600, 50_000])
def test_the_whole_last_line_decides(spark, n):
    """Brackets and quotation marks that open far before the end; the same without the close is open."""
    body = ("工人和农民的联合会，" * (n // 10 + 1))[:n]
    latin = ("the guild and the mill, " * (n // 24 + 1))[:n].strip()
    whole = [f"{SENTENCE}\n（{body}）", f"{SENTENCE}\n[{body}]", f"Er schrieb: „{latin}“"]
    rows = [(i, None, t) for i, t in enumerate(whole)] + [(10 + i, None, t[:-1]) for i, t in enumerate(whole)]
    assert {r.doc_id for r in T.truncated(spark.createDataFrame(rows, SCHEMA)).collect()} == {10, 11, 12}


@pytest.mark.parametrize("n", [1, 200_000])
def test_long(spark, n):
    assert T.truncated(spark.createDataFrame([(1, "a", SENTENCE * n)], SCHEMA)).count() == 0

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import lookalikes as L

SCHEMA = "kind string, record string, index int, text string"


@pytest.mark.parametrize(
    "a, b",
    [("Ｆａｂｒｉｋ", "Fabrik"), ("Mühle", "Mühle"), ("a​b", "ab"), ("a b", "a b"), ("⼯⼈", "工人"), ("年", "年"), ("ﬁn", "fin"), ("１９３７", "1937"), ("in the", "in the"), ("so­ft", "soft")],
)
def test_one_form(a, b):
    assert L.usual_form(a) == L.usual_form(b) == b


@pytest.mark.parametrize("a, b", [("①", "1"), ("x²", "x2"), ("–", "-"), ("“", "„"), ("，", ","), ("·", "•"), ("㎏", "kg"), ("а", "б")])
def test_different_stay_different(a, b):
    assert L.usual_form(a) != L.usual_form(b)


def test_script_repair():
    assert dict(L.repaired_tokens("Die Βrücke οr Kаѕsе")) == {"Βrücke": "Brücke", "οr": "or", "Kаѕsе": "Kasse"}
    assert dict(L.repaired_tokens("（мастерская）")) == {} and dict(L.repaired_tokens("λόγος and мастерская in one")) == {}
    assert dict(L.repaired_tokens("мaстерская")) == {"мaстерская": "мастерская"}


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=40))
def test_forms_are_stable_and_affected_is_complete(text):
    form = L.usual_form(text)
    assert L.usual_form(form) == form
    if not re.search(L.AFFECTED, text):
        assert form == text


def pairs(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS form", "'y' AS string")
    return {(r.record_a, r.index_a, r.record_b, r.index_b) for r in L.same_looking(frame).collect()}


def test_pairs(spark):
    plain = "Die alte Mühle"
    rows = [
        ("chapter", "a", 0, plain), ("chapter", "b", 1, "Die alte Mühle"), ("chapter", "c", 0, "Die alte Mühle"), ("chapter", "d", 0, plain), ("chapter", "a", 5, "Die alte Mühle"),
        ("footnote", "e", 0, "Die alte Mühle"), ("chapter", "f", 0, "Dіe аlte Mühle"), ("chapter", "g", 0, None), ("chapter", None, 0, "Die alte Mühle"), ("chapter", "h", 0, ""), ("chapter", "i", 0, "​"), ("chapter", "a", 0, plain),
    ]
    texts = {(r, i): t for k, r, i, t in rows if k == "chapter" and r and r in "abcdf"}
    want = {(*x, *y) for x in texts for y in texts if x[0] < y[0] and texts[x] != texts[y]} | {("h", 0, "i", 0)}
    assert pairs(spark, rows) == want
    assert pairs(spark, []) == set()


def test_repair_needs_the_vocabulary(spark):
    rows = [("chapter", "a", 0, "xyz Βqwk"), ("chapter", "b", 0, "xyz Bqwk")]
    assert pairs(spark, rows) == {("a", 0, "b", 0)}
    lone = spark.createDataFrame([("chapter", "a", 0, "xyz Βqwk")], SCHEMA)
    assert [r.form for r in L.consistent(lone).collect()] == ["xyz Βqwk"]
    two = spark.createDataFrame([("chapter", "a", 0, "xyz Βqwk"), ("chapter", "b", 0, "Βqwk xyz"), ("chapter", "c", 0, "Βqwκ")], SCHEMA)
    assert {r.form for r in L.consistent(two).collect()} == {"xyz Βqwk", "Βqwk xyz", "Βqwκ"}


def test_words_of_another_script_throughout(spark):
    rows = [("chapter", "a", 0, "the old саре of it"), ("chapter", "b", 0, "the old cape of it"), ("chapter", "c", 0, "саре")]
    assert pairs(spark, rows) == {("a", 0, "b", 0)}

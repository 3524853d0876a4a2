import hashlib

from lectern.operators import repairs as R

SEC = "array<struct<section_id:string,paragraph_index:int>>"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_delete_moves_sections(spark):
    c = spark.createDataFrame([("c", ["a", "nav", "b", "nav", "c"], [("s0", 0), ("s1", 1), ("s2", 2), ("s4", 4), ("s9", 9)])], f"chapter_id string, content array<string>, sections {SEC}")
    out = R.delete_elements(c, lambda x, i: x == "nav")
    r = out.first()
    assert r.content == ["a", "b", "c"] and [tuple(s) for s in r.sections] == [("s0", 0), ("s2", 1), ("s4", 2)]
    assert R.delete_elements(out, lambda x, i: x == "nav").first() == r


def test_insert_and_remove(spark):
    p = spark.createDataFrame([("c", "0123456789"), ("d", "x")], "k string, text string")
    e = spark.createDataFrame([("c", 10, "]"), ("c", 0, "["), ("c", 5, "|")], "k string, at int, piece string")
    got = {r.k: r.text for r in R.insert_text(p, e, "k").collect()}
    assert got == {"c": "[01234|56789]", "d": "x"} and got["c"].translate({ord(x): None for x in "[]|"}) == "0123456789"


def test_tail_once(spark):
    c = spark.createDataFrame([("c", ["a", "b"]), ("d", ["changed"])], "chapter_id string, content array<string>")
    r = spark.createDataFrame([("c", sha("a\nb"), ["t"]), ("d", sha("was"), ["t"])], "chapter_id string, expected string, tail array<string>")
    once = R.append_tail(c, r)
    assert {x.chapter_id: x.content for x in once.collect()} == {"c": ["a", "b", "t"], "d": ["changed"]}
    assert sorted(R.append_tail(once, r).collect()) == sorted(once.collect())


def test_payload(spark):
    rows = spark.createDataFrame([("a", "old"), ("b", "other"), ("c", "new")], "k string, note string")
    rec = spark.createDataFrame([(k, sha("old"), "new") for k in "abcz"], "k string, expected string, payload string")
    out, refused = R.replace_payload(rows, rec, "k", "note")
    assert {r.k: r.note for r in out.collect()} == {"a": "new", "b": "other", "c": "new"}
    assert {r.k: r.reason for r in refused.collect()} == {"b": "changed", "z": "missing"}


def test_four_outcomes(spark):
    rows = spark.createDataFrame([("a", "x bad y"), ("b", "x good y"), ("c", "none")], "k string, text string")
    rec = spark.createDataFrame([(k, "bad", "good") for k in "abcz"], "k string, damaged string, corrected string")
    assert {r.k: r.outcome for r in R.substitute(rows, rec, "k").collect()} == {"a": "fixed", "b": "already", "c": "unmatched", "z": "missing"}


def test_diff(spark):
    p = spark.createDataFrame([("k", ["a", "b", "c"], ["a", "c", "d"]), ("same", ["a"], ["a"]), ("null", None, ["a"])], "key string, a array<string>, b array<string>")
    assert {(r.key, r.op, r.a_from, r.b_from) for r in R.line_differences(p).collect()} == {("k", "delete", 1, 1), ("k", "insert", 3, 2), ("null", "insert", 0, 0)}


def test_swap(spark):
    rows = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string")
    fresh = spark.createDataFrame([("a", sha('{"v":"1"}'), "9"), ("b", "0", "9")], "k string, expected string, v string")
    assert {r.k: r.v for r in R.swap_records(rows, fresh, "k").collect()} == {"a": "9", "b": "2"}

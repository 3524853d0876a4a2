import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import mojibake as M

SOUND = [
    "问题在于，孤立的羊毛是否暂时维持公开的报告，以及谁来颁布普遍的生产力。",
    "工人和农民的联合会在第一次会议上讨论了工厂的劳动制度。",
    "Die gewöhnliche Färberei schließt künftig die größere Bücherei, schrieb Müller.",
    "“不是主席推动报告，恰恰是报告推动主席！”他在信中写道。",
]
SCHEMA = "chapter_id string, book_id string, title string, content array<string>"


@pytest.fixture(scope="module")
def model():
    batch = pa.RecordBatch.from_arrays([pa.array(SOUND * 60), pa.array([SOUND] * 240, pa.list_(pa.string()))], ["title", "content"])
    import numpy as np

    out = next(M._counts(iter([batch])))
    return M.model_of(np.asarray(out.column(0)), np.asarray(out.column(1))).prepare()


def misread(text, written, read):
    return text.encode(written).decode(read, "replace")


@pytest.mark.parametrize("read", ["latin-1", "cp437", "koi8_r", "mac_roman"])
def test_single_byte_round_trip(model, read):
    for text in SOUND:
        assert M.restore(misread(text, "utf-8", read), model)[0] == text


def test_ideographs_for_utf8(model):
    text = SOUND[0]
    found = M.restore(text.encode().decode("gb18030", "replace"), model)
    assert found and found[1].startswith("gb18030>utf-8")
    same = sum(a == b for a, b in zip(found[0], text))
    assert same > 0.8 * len(text)  # bytes the reader dropped stay lost


def test_gbk_bytes_as_latin_and_big5(model):
    text = SOUND[1]
    assert M.restore(text.encode("gb18030").decode("latin-1"), model)[0] == text
    assert M.restore(text.encode("gb18030").decode("big5", "replace"), model)[1] == "big5>gb18030"


def test_lost_bytes(model):
    text = SOUND[1]
    found = M.restore(misread(text, "gb18030", "utf-8"), model)
    assert found and "�" in misread(text, "gb18030", "utf-8")
    assert M.restore("的锟斤拷锟斤拷锟斤拷", model)


def test_replaced_before_by_another_reader(model):
    assert M.restore("问题在于，孤立的锟斤拷锟斤拷锟斤拷公开的报告。", model) == ("问题在于，孤立的������公开的报告。", "gb18030>utf-8")
    assert M.restore("一把铁锹和一斤盐", model) is None


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([0xC2, 0xDF, 0xE0, 0xED, 0xEF, 0xF0, 0xF4, 0x80, 0x8F, 0x90, 0x9F, 0xA0, 0xBF, -1]), min_size=2, max_size=6))
def test_bytes_decode_to_characters_only(raw):
    for at in range(len(raw)):
        for n, c in M._decodings("utf-8", raw, at, {x: 0.0 for x in (0x80, 0x7FF, 0x10FFFF)}):
            assert 1 <= n <= len(raw) - at and chr(c).encode()
            if all(b >= 0 for b in raw[at : at + n]) and c != 0xFFFD:
                assert chr(c).encode() == bytes(raw[at : at + n])


@pytest.mark.parametrize("raw", [b"\xf4\x90\x80\x80", b"\xe0\x80\x80", b"\xf0\x80\x80\x80", b"\xed\xa0\x80"])
def test_bytes_past_the_last_character(model, raw):
    """Bytes that no writer of UTF-8 writes, in a text of Latin-1."""
    M.restore("工人" + raw.decode("latin-1") * 3 + "农民", model)


def test_twice(model):
    once = SOUND[2].encode().decode("cp1252")
    assert M.restore(once.encode().decode("cp1252", "replace"), model)[0] == SOUND[2]


def test_part_of_a_text(model):
    text = SOUND[0] + SOUND[1].encode().decode("cp437") + SOUND[3]
    assert M.restore(text, model)[0] == SOUND[0] + SOUND[1] + SOUND[3]


@pytest.mark.parametrize("text", [*SOUND, "", "（coopération）", "São Valério", "NAÇÃO", "ÎLE DE BRAUME", "мастерская", "Øvre Havn", "① ② ③", "字号：A- A A+　夜间模式", "«Siehe auch»"])
def test_sound_texts_stay(model, text):
    assert M.restore(text, model) is None


def test_operator_on_odd_tables(spark):
    bad = SOUND[2].encode().decode("latin-1")
    rows = [("c1", "b", None, [None, "", bad]), ("c1", "b", None, [None, "", bad]), ("c2", "b", bad, None), ("c3", "b", "工人", SOUND), (None, "b", bad, [bad]), *((f"x{i}", "b", SOUND[i % 4], SOUND) for i in range(40))]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS text", "1 AS paragraph_index")
    found = {(r.chapter_id, r.paragraph_index): r.restored for r in M.damaged(frame).collect()}
    assert found == {("c1", 2): SOUND[2], ("c2", -1): SOUND[2]}


def test_empty_table(spark):
    assert M.damaged(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_long_text(spark, model):
    text = SOUND[0] * 3000 + SOUND[2].encode().decode("latin-1")
    found = M.restore(text, model)
    assert found and found[0].endswith(SOUND[2])


LATIN = [
    "Die Partei war für die Kämpfe der Arbeiter und gegen die Bürger",
    "Der Redner sprach über Löhne und größere Städte",
    "Après la révolution, le congrès a été réuni à Genève",
    "für",
    "Österreich und die Straße",
    "le café",
]


@pytest.mark.parametrize("read", ["gb18030", "big5", "euc_kr", "shift_jis"])
def test_letters_with_accents_read_as_east_asian(spark, read):
    """Each is an ideograph, a syllable or kana in or at a word of letters that are frequent; sound texts stay."""
    bad = [misread(x, "utf-8", read) for x in LATIN]
    sound = [(f"x{i}", "b", LATIN[i % 6], LATIN + SOUND) for i in range(60)]
    rows = [*sound, ("t", "b", bad[0], SOUND), ("c", "b", "工人", [*SOUND, *bad])]
    model = M.learn(spark.createDataFrame(sound, SCHEMA))
    found = {(r.chapter_id, r.paragraph_index): r.restored for r in M.damaged(spark.createDataFrame(rows, SCHEMA), model).collect()}
    whole = {("t", -1): LATIN[0]} | {("c", len(SOUND) + i): LATIN[i] for i in (0, 3, 5)}
    assert "\ufffd" not in "".join(bad[i] for i in (0, 3, 5))
    assert {k: found.get(k) for k in whole} == whole and not any(k[0].startswith("x") for k in found)

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from lectern.functions.codepoints import Rolling, codepoints
from lectern.llm import shared_spans as S

SCHEMA = "record string, content array<string>"


def brute(rows):
    windows = {}
    for record, content in rows:
        for text in content or ():
            for i in range(len(text or "") - S.SPAN + 1):
                windows.setdefault(text[i : i + S.SPAN], set()).add(record)
    return {p for w in windows.values() for p in combinations(sorted(x for x in w if x is not None), 2)}


def found(frame):
    return {(r.record_a, r.record_b) for r in S.shared_pairs(frame).collect()}


def noise(rng, n, ends=0.03):
    return "".join("。" if rng.random() < ends else chr(rng.randrange(0x4E00, 0x5600)) for _ in range(n))


@pytest.mark.parametrize("ends", [0.0, 0.02, 0.2])
def test_equals_brute_force(spark, ends):
    rng = random.Random(int(ends * 100) + 1)
    rows = []
    for k in range(30):
        passage = noise(rng, rng.choice([99, 100, 101, 150, 400]), ends)
        for j in range(2):
            a, b = rng.randrange(0, 60), rng.randrange(0, 60)
            rows.append((f"r{k}-{j}", [noise(rng, 30, ends), noise(rng, a, ends) + passage + noise(rng, b, ends)]))
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_every_run_has_a_common_beginning():
    rng = random.Random(7)
    for ends in (0.0, 0.01, 0.05):
        run = noise(rng, S.SPAN, ends)
        hashes = []
        for _ in range(2):
            texts = pa.array([noise(rng, rng.randrange(80), ends) + run + noise(rng, rng.randrange(80), ends)], pa.large_string())
            points, offsets = codepoints(texts)
            r = Rolling(points)
            starts, _ = S.span_starts(points, offsets, r)
            hashes.append(set(r.at(starts, S.REACH).tolist()))
        assert hashes[0] & hashes[1]


def test_odd_tables(spark):
    p = noise(random.Random(3), 120)
    rows = [("a", [p, None, ""]), ("a", [p, None, ""]), ("b", ["x" + p[:60], p[60:]]), ("c", [p + "。"]), (None, [p]), ("d", None), ("e", [])]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS window", "'s' AS spans")
    assert found(frame) == {("a", "c")}
    share = {r.record: (r.n_chars, r.shared_chars) for r in S.shared_share(frame).collect()}
    assert share["a"] == (120, 120) and share["c"] == (121, 120) and share["b"][1] == 0 and share["e"] == (0, 0) and "d" not in share
    assert found(spark.createDataFrame([], SCHEMA)) == set()


def test_hot_passage(spark):
    """A passage in many records gives each pair once."""
    p = noise(random.Random(4), 300)
    rows = [(f"r{i:03d}", [p]) for i in range(40)] + [(f"s{i:03d}", [noise(random.Random(1000 + i), 200)]) for i in range(40)]
    assert len(found(spark.createDataFrame(rows, SCHEMA))) == 40 * 39 // 2


def test_rolling_hash():
    points = np.random.default_rng(1).integers(1, 0x10FFFF, 500).astype(np.uint32)
    points[300:350] = points[100:150]
    r = Rolling(points)
    assert (r.all(50)[[100, 300]] == r.at(np.array([300, 100]), 50)).all() and len(set(r.all(50).tolist())) == 450


def test_first_holder_keeps_what_others_lose(spark):
    rng = random.Random(9)
    whole = "".join(noise(rng, 39, 0) + "。" for _ in range(4))
    tail = noise(rng, 10, 0) + whole[50:] + noise(rng, 60, 0)
    rows = [("a", [noise(rng, 50) + "。" + whole]), ("b", ["首句。" + whole + "末句。", None, ""]), ("c", [noise(rng, 150, 0), tail]), ("d", None), ("e", ["短。"]), ("b", ["首句。" + whole + "末句。", None, ""]), (None, [whole])]
    got = {r.record: (r.content, r.removed) for r in S.without_shared(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"a": (rows[0][1], 0), "b": (["首句。末句。", None, ""], 4), "c": ([rows[2][1][0], tail[:40] + tail[120:]], 2), "d": (None, 0), "e": (["短。"], 0)}


@pytest.mark.parametrize("seed", range(3))
def test_every_repeated_window_stays_in_its_first_holder(spark, seed):
    rng = random.Random(seed)
    pool = [noise(rng, rng.randrange(80, 260)) for _ in range(5)]
    rows = [(f"r{i:02}", ["".join(rng.choice([*pool, noise(rng, 40)])[rng.randrange(30) :] for _ in range(4)) for _ in range(2)]) for i in range(12)]
    first, holders, covered = {}, {}, {}
    for record, content in rows:
        for i, text in enumerate(content):
            for k in range(len(text) - S.SPAN + 1):
                w = text[k : k + S.SPAN]
                first.setdefault(w, record)
                holders.setdefault(w, set()).add(record)
    clean = {r.record: r.content for r in S.without_shared(spark.createDataFrame(rows, SCHEMA)).collect()}
    repeated = {w for w, h in holders.items() if len(h) > 1}
    assert repeated and all(any(w in text for text in clean[first[w]]) for w in repeated)
    for record, content in rows:
        expected = []
        for text in content:
            gone, kept = [False] * len(text), [False] * len(text)
            for k in range(len(text) - S.SPAN + 1):
                if (w := text[k : k + S.SPAN]) in repeated:
                    mark = kept if first[w] == record else gone
                    mark[k : k + S.SPAN] = [True] * S.SPAN
            expected.append("".join(m.group() for m in S._SENTENCE.finditer(text) if not all(gone[m.start() : m.end()]) or any(kept[m.start() : m.end()])))
        assert clean[record] == expected
    assert any(clean[r] != c for r, c in rows)

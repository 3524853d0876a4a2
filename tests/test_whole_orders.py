import datetime
import random

from lectern import queries as Q
from lectern.operators import catalog as C
from pyspark.sql import functions as F


def places(frame, key):
    rows = sorted(frame.collect(), key=lambda r: r.place)
    assert [r.place for r in rows] == list(range(1, len(rows) + 1))
    return [r[key] for r in rows]


def test_every_note(spark, tmp_path):
    rng = random.Random(1)
    at = lambda: None if rng.random() < 0.1 else rng.randrange(40)
    rows = [(i, rng.choice([True, False, None]), at()) for i in range(120)]
    spark.createDataFrame(rows + rows[:9], "id bigint, pinned boolean, updated_at bigint").write.parquet(f"{tmp_path}/notes.parquet")
    last = lambda v: (v is None, 0 if v is None else -int(v))
    assert places(Q.queries()["o1_notes_order"](spark, str(tmp_path)), "id") == [r[0] for r in sorted(rows, key=lambda r: (last(r[1]), last(r[2]), r[0]))]


def test_every_session_with_active_time(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"s{i:03}", 5, None if rng.random() < 0.1 else rng.randrange(60), 99, rng.choice([0, 7, 9])) for i in range(260)]
    spark.createDataFrame(rows + rows[:9], "id string, received_at bigint, started_at bigint, ended_at bigint, active_millis bigint").write.parquet(f"{tmp_path}/reading_sessions.parquet")
    active = sorted((r for r in rows if r[4] > 0), key=lambda r: r[0], reverse=True)
    assert len(active) > 100
    expected = [r[0] for r in sorted(active, key=lambda r: (r[2] is None, -(r[2] or 0)))]
    assert places(Q.queries()["o3_latest_sessions"](spark, str(tmp_path)), "id") == expected


def test_every_book(spark, tmp_path):
    rng = random.Random(3)
    day = datetime.datetime(2026, 1, 1)
    rows = [(f"b{i:03}", [rng.choice("xyz")] if rng.random() < 0.8 else [], rng.choice(["1848", "1867", None]), rng.choice(["论", "书", None]), day) for i in range(240)]
    spark.createDataFrame(rows, "book_id string, author_ids array<string>, pub_year string, title_zh string, loaded_at timestamp").write.parquet(f"{tmp_path}/books.parquet")
    expected = [r[0] for r in sorted(rows, key=lambda r: (",".join(r[1]), r[2] or "", r[3] is None, r[3] or "", r[0]))]
    assert places(Q.queries()["o8_inventory_order"](spark, str(tmp_path)), "book_id") == expected


def test_places_over_many_ranges(spark):
    rows = spark.range(5000).select("id", (F.col("id") * 7919 % 5003).alias("v")).repartition(7)
    got = C.placed(rows, F.desc("v")).select("v", "place").orderBy("place").collect()
    assert [r.v for r in got] == sorted((i * 7919 % 5003 for i in range(5000)), reverse=True) and [r.place for r in got] == list(range(1, 5001))
    assert C.placed(rows.limit(0), F.desc("v")).count() == 0

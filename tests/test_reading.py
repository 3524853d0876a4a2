import datetime as dt

import pytest
from pyspark.sql import functions as F

from lectern.operators import reading as R

SCHEMA = "id bigint, book_id string, started_at bigint, ended_at bigint, active_millis bigint, received_at timestamp"


def ms(zone, *parts):
    from zoneinfo import ZoneInfo

    return int(dt.datetime(*parts, tzinfo=ZoneInfo(zone)).timestamp() * 1000)


def sessions(spark, *rows):
    return spark.createDataFrame([(i, "b", s, e, a, None) for i, (s, e, a) in enumerate(rows)], SCHEMA)


def test_midnight(spark):
    s = sessions(spark, (ms("UTC", 2026, 8, 28, 23, 59), ms("UTC", 2026, 8, 29, 0, 1), 120_000))
    split = R.split_at_midnight(s)
    assert sorted((r.day, r.millis) for r in split.collect()) == [(dt.date(2026, 8, 28), 60_000), (dt.date(2026, 8, 29), 60_000)]
    assert [r.days for r in R.streaks(split, "book_id").collect()] == [2]


@pytest.mark.parametrize("day", [(2026, 3, 8), (2026, 11, 1)])
def test_days_of_23_and_25_hours(spark, day):
    zone = "America/New_York"
    d = dt.date(*day)
    a, b = d - dt.timedelta(1), d + dt.timedelta(1)
    s = sessions(spark, (ms(zone, a.year, a.month, a.day, 23, 59), ms(zone, b.year, b.month, b.day, 0, 1), 123_457))
    rows = R.split_at_midnight(s, zone).collect()
    assert len(rows) == 3 and sum(r.millis for r in rows) == 123_457


def test_ends_at_midnight_and_odd_rows(spark):
    s = sessions(spark, (0, 86_400_000, 1000), (5, 5, 7), (10, 3, 9), (0, 1, 0), (0, 1, -5), (None, 1, 4), (0, None, 4), (0, 1, None))
    got = sorted((r.id, r.day.toordinal() - 719163, r.millis) for r in R.split_at_midnight(s).collect())
    assert got == [(0, 0, 1000), (1, 0, 7), (2, 0, 9)]


def test_streak_from_yesterday(spark):
    today = dt.date(2026, 5, 10)
    day = 86_400_000
    base = int(dt.datetime(2026, 5, 7, tzinfo=dt.timezone.utc).timestamp() * 1000)
    split = R.split_at_midnight(sessions(spark, *((base + k * day, base + k * day + 60_000, 60_000) for k in range(3))))
    assert [r.days for r in R.current_streak(R.streaks(split, "book_id"), F.lit(today)).collect()] == [3]
    dense = R.last_days(R.daily_totals(split), F.lit(today)).orderBy("day").collect()
    assert [r.millis for r in dense] == [0, 0, 0, 60_000, 60_000, 60_000, 0]


def test_rank_ties(spark):
    s = spark.createDataFrame([(1, "a", 5, 9, 10, None), (2, "a", 5, 9, 10, None), (3, "b", 1, 2, 0, None), (4, None, 1, 2, 5, None)], SCHEMA)
    assert [tuple(r) for r in R.book_rank(s).collect()] == [("a", 20, 2, 5, 2)]
    assert R.book_rank(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeats_of_an_id(spark):
    s = spark.createDataFrame([(1, "a", 5, 9, 10, dt.datetime(2026, 1, 2)), (1, "a", 5, 9, 10, dt.datetime(2026, 1, 1)), (None, "a", 5, 9, 10, None)], SCHEMA)
    assert [r.received_at for r in R.distinct_sessions(s).collect()] == [dt.datetime(2026, 1, 1)]

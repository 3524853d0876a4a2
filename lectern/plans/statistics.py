"""Queries of reading statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators import reading as R
from lectern.registry import Tables, query

_ONCE = """
WITH once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY received_at, started_at, ended_at, active_millis) AS n FROM reading_sessions WHERE id IS NOT NULL) WHERE n = 1)
"""
_SPLIT = (
    _ONCE
    + """, s AS (SELECT id, book_id, device_id, active_millis, started_at AS s, greatest(ended_at, started_at + 1) AS e FROM once WHERE active_millis > 0 AND started_at IS NOT NULL AND ended_at IS NOT NULL),
days AS (SELECT *, unnest(generate_series(s // 86400000, (e - 1) // 86400000)) AS d FROM s),
shares AS (SELECT *, CAST(floor(active_millis * (least(e, (d + 1) * 86400000) - greatest(s, d * 86400000)) / (e - s) + 0.5) AS BIGINT) AS share, d = (e - 1) // 86400000 AS last FROM days),
split AS (SELECT id, book_id, device_id, CAST(DATE '1970-01-01' + CAST(d AS INTEGER) AS DATE) AS day,
  CAST(CASE WHEN last THEN active_millis - coalesce(sum(CASE WHEN NOT last THEN share END) OVER (PARTITION BY id), 0) ELSE share END AS BIGINT) AS millis FROM shares)
"""
)


def _split(t: Tables) -> DataFrame:
    return R.split_at_midnight(R.distinct_sessions(t.reading_sessions))


@query(
    "a1_reading_by_book",
    _ONCE + "SELECT book_id, CAST(sum(active_millis) AS BIGINT) AS total_millis, count(*) AS sessions, max(started_at) AS last_started_at, arg_max(id, (started_at, id)) AS last_session_id FROM once WHERE active_millis > 0 AND book_id IS NOT NULL GROUP BY book_id",
)
def _(t: Tables) -> DataFrame:
    return R.book_rank(R.distinct_sessions(t.reading_sessions))


@query(
    "o5_book_ranking",
    _ONCE + ", r AS (SELECT book_id, CAST(sum(active_millis) AS BIGINT) AS total_millis, max(started_at) AS st, arg_max(id, (started_at, id)) AS sid FROM once WHERE active_millis > 0 AND book_id IS NOT NULL GROUP BY book_id) SELECT book_id, total_millis, row_number() OVER (ORDER BY total_millis DESC, st DESC, sid DESC) AS place FROM r ORDER BY place LIMIT 8",
)
def _(t: Tables) -> DataFrame:
    """Top 8 books: total, then latest start, then latest session; the limit comes before the ranking, so no window sees all books."""
    top = R.book_rank(R.distinct_sessions(t.reading_sessions)).orderBy(F.desc("total_millis"), F.desc("last_started_at"), F.desc("last_session_id")).limit(8)
    place = F.row_number().over(Window.orderBy(F.desc("total_millis"), F.desc("last_started_at"), F.desc("last_session_id"))).cast("bigint")
    return top.select("book_id", "total_millis", place.alias("place"))


@query("f19_midnight_split", _SPLIT + "SELECT id, book_id, day, millis FROM split")
def _(t: Tables) -> DataFrame:
    return _split(t)


@query("a3_daily_totals", _SPLIT + "SELECT day, CAST(sum(millis) AS BIGINT) AS millis FROM split GROUP BY day")
def _(t: Tables) -> DataFrame:
    return R.daily_totals(_split(t))


_TODAY = "DATE '2025-06-30'"


@query("w12_last_days_dense", _SPLIT + f"SELECT CAST(d AS DATE) AS day, CAST(coalesce(sum(millis), 0) AS BIGINT) AS millis FROM generate_series({_TODAY} - 6, {_TODAY}, INTERVAL 1 DAY) AS g(d) LEFT JOIN split ON day = CAST(d AS DATE) GROUP BY d")
def _(t: Tables) -> DataFrame:
    return R.last_days(R.daily_totals(_split(t)), F.expr(_TODAY))


_STREAKS = _SPLIT + ", active AS (SELECT book_id, day FROM split GROUP BY book_id, day HAVING sum(millis) > 0), runs AS (SELECT book_id, day, day - CAST(row_number() OVER (PARTITION BY book_id ORDER BY day) AS INTEGER) AS island FROM active), streaks AS (SELECT book_id, min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM runs GROUP BY book_id, island)"


@query("w11_streaks", _STREAKS + "SELECT * FROM streaks")
def _(t: Tables) -> DataFrame:
    return R.streaks(_split(t), "book_id")


@query("w11_current_streak", _STREAKS + f"SELECT * FROM streaks WHERE last_day IN ({_TODAY}, {_TODAY} - 1)")
def _(t: Tables) -> DataFrame:
    return R.current_streak(R.streaks(_split(t), "book_id"), F.expr(_TODAY))


_OVERVIEW = (
    _SPLIT
    + """, p AS (SELECT s.book_id, s.day, s.millis, o.started_at, row_number() OVER (PARTITION BY s.id ORDER BY s.day) = 1 AS fst FROM split s JOIN once o ON o.id = s.id),
 read_days AS (SELECT day, sum(millis) AS millis FROM p GROUP BY day HAVING sum(millis) > 0), all_runs AS (SELECT day, millis, day - CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS island FROM read_days)
SELECT 'total' AS kind, CAST(NULL AS VARCHAR) AS key, CAST(sum(millis) AS BIGINT) AS millis, count(*) FILTER (fst) AS sessions, CAST(max(started_at) AS VARCHAR) AS last FROM p
UNION ALL SELECT 'day', CAST(day AS VARCHAR), CAST(sum(millis) AS BIGINT), count(*), CAST(max(started_at) AS VARCHAR) FROM p GROUP BY day
UNION ALL SELECT 'book', book_id, CAST(sum(millis) AS BIGINT), count(*) FILTER (fst), CAST(max(started_at) AS VARCHAR) FROM p WHERE book_id IS NOT NULL GROUP BY book_id
UNION ALL SELECT 'streak', CAST(min(day) AS VARCHAR), CAST(sum(millis) AS BIGINT), count(*), CAST(max(day) AS VARCHAR) FROM all_runs GROUP BY island"""
)


@query("a_overview", _OVERVIEW)
def _(t: Tables) -> DataFrame:
    """All that a reader's statistics show, from one pass over the sessions."""
    return R.overview(t.reading_sessions)


@query(
    "a4_kpi_summary",
    _SPLIT + f"SELECT CAST(sum(millis) AS BIGINT) AS total_millis, CAST(coalesce(sum(millis) FILTER (day BETWEEN {_TODAY} - 6 AND {_TODAY}), 0) AS BIGINT) AS week_millis, CAST(coalesce(sum(millis) FILTER (day = {_TODAY}), 0) AS BIGINT) AS today_millis, (SELECT count(*) FROM (SELECT day FROM split GROUP BY day HAVING sum(millis) > 0)) AS active_days FROM split",
)
def _(t: Tables) -> DataFrame:
    """A4, A5: totals from one pass over the days."""
    d = R.daily_totals(_split(t))
    zero = F.lit(0).cast("bigint")
    today = F.expr(_TODAY)
    return d.agg(
        F.sum("millis").alias("total_millis"),
        F.coalesce(F.sum(F.when(F.col("day").between(F.date_sub(today, 6), today), F.col("millis"))), zero).alias("week_millis"),
        F.coalesce(F.sum(F.when(F.col("day") == today, F.col("millis"))), zero).alias("today_millis"),
        F.count_if(F.col("millis") > 0).alias("active_days"),
    )


@query("a6_totals_having", _ONCE + "SELECT book_id, CAST(sum(active_millis) AS BIGINT) AS total_millis, count(*) AS sessions FROM once WHERE book_id IS NOT NULL GROUP BY book_id HAVING sum(active_millis) > 0")
def _(t: Tables) -> DataFrame:
    """Zero totals drop after grouping, so sessions without active time still count."""
    s = R.distinct_sessions(t.reading_sessions).where("book_id is not null")
    return s.groupBy("book_id").agg(F.sum("active_millis").alias("total_millis"), F.count(F.lit(1)).alias("sessions")).where("total_millis > 0")


@query("a20_day_fraction", _SPLIT + ", d AS (SELECT day, CAST(sum(millis) AS BIGINT) AS millis FROM split GROUP BY day) SELECT day, millis, CASE WHEN m > 0 THEN round(millis / m, 6) ELSE 0 END AS fraction FROM d, (SELECT max(millis) AS m FROM d)")
def _(t: Tables) -> DataFrame:
    """Bars scaled by the greatest day: days are few, at most one for each date."""
    d = R.daily_totals(_split(t))
    most = F.max("millis").over(Window.partitionBy(F.lit(1)))
    return d.select("day", "millis", F.when(most > 0, F.round(F.col("millis") / most, 6)).otherwise(0.0).alias("fraction"))


@query("k10_capped_increments", _ONCE + "SELECT book_id, CAST(sum(least(active_millis, 60000)) AS BIGINT) AS millis, arg_max(end_chapter_id, (ended_at, id)) AS last_chapter FROM once WHERE active_millis > 0 AND book_id IS NOT NULL AND end_chapter_id IS NOT NULL GROUP BY book_id")
def _(t: Tables) -> DataFrame:
    """Updates of at most 60 s each, non-positive ones dropped, with the last place."""
    s = R.distinct_sessions(t.reading_sessions).where("active_millis > 0 and book_id is not null and end_chapter_id is not null")
    return s.groupBy("book_id").agg(F.sum(F.least("active_millis", F.lit(60000))).alias("millis"), F.max_by("end_chapter_id", F.struct("ended_at", "id")).alias("last_chapter"))


@query("k6_latest_progress", _ONCE + "SELECT book_id, end_chapter_id AS chapter_id, end_paragraph_index AS paragraph_index, ended_at AS updated_at FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY ended_at DESC, id DESC) AS k FROM once WHERE end_chapter_id IS NOT NULL AND book_id IS NOT NULL) WHERE k = 1")
def _(t: Tables) -> DataFrame:
    """The newest position of each book wins; by aggregation, which a hot book can't skew."""
    s = R.distinct_sessions(t.reading_sessions).where("end_chapter_id is not null and book_id is not null")
    newest = F.max_by(F.struct("end_chapter_id", "end_paragraph_index", "ended_at"), F.struct("ended_at", "id")).alias("n")
    return s.groupBy("book_id").agg(newest).select("book_id", F.col("n.end_chapter_id").alias("chapter_id"), F.col("n.end_paragraph_index").alias("paragraph_index"), F.col("n.ended_at").alias("updated_at"))


@query("k6_chapter_progress", _ONCE + "SELECT book_id, end_chapter_id AS chapter_id, max(ended_at) AS updated_at, count(*) AS visits FROM once WHERE end_chapter_id IS NOT NULL AND book_id IS NOT NULL GROUP BY book_id, end_chapter_id")
def _(t: Tables) -> DataFrame:
    s = R.distinct_sessions(t.reading_sessions).where("end_chapter_id is not null and book_id is not null")
    return s.groupBy("book_id", F.col("end_chapter_id").alias("chapter_id")).agg(F.max("ended_at").alias("updated_at"), F.count(F.lit(1)).alias("visits"))


@query("a13_most_recent_book", _ONCE + "SELECT device_id, arg_max(book_id, (started_at, id)) AS book_id, max(started_at) AS started_at FROM once WHERE device_id IS NOT NULL GROUP BY device_id")
def _(t: Tables) -> DataFrame:
    s = R.distinct_sessions(t.reading_sessions).where("device_id is not null")
    return s.groupBy("device_id").agg(F.max_by("book_id", F.struct("started_at", "id")).alias("book_id"), F.max("started_at").alias("started_at"))


@query("j4_latest_session", _ONCE + "SELECT book_id, id AS session_id, started_at FROM once o WHERE book_id IS NOT NULL AND id = (SELECT arg_max(id, (started_at, id)) FROM once i WHERE i.book_id = o.book_id)")
def _(t: Tables) -> DataFrame:
    """The correlated subquery as one aggregate."""
    s = R.distinct_sessions(t.reading_sessions).where("book_id is not null")
    return s.groupBy("book_id").agg(F.max(F.struct("started_at", "id")).alias("x")).select("book_id", F.col("x.id").alias("session_id"), F.col("x.started_at").alias("started_at"))


@query("f26_reading_weekday", _ONCE + "SELECT CAST(isodow(to_timestamp(started_at / 1000) AT TIME ZONE 'UTC') AS INTEGER) AS weekday, count(*) AS sessions, CAST(min(started_at // 86400000) AS BIGINT) AS first_epoch_day FROM once WHERE started_at IS NOT NULL GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """Monday is 1."""
    day = F.to_date(F.timestamp_millis("started_at"))
    s = R.distinct_sessions(t.reading_sessions).where("started_at is not null")
    return s.groupBy((F.weekday(day) + 1).alias("weekday")).agg(F.count(F.lit(1)).alias("sessions"), F.min(F.unix_date(day).cast("bigint")).alias("first_epoch_day"))


@query("f28_duration_label", _ONCE + "SELECT id, CASE WHEN active_millis < 60000 THEN (greatest(active_millis, 0) // 1000) || ' s' WHEN active_millis < 3600000 THEN (active_millis // 60000) || ' min' ELSE (active_millis // 3600000) || ' h ' || (active_millis // 60000 % 60) || ' min' END AS label FROM once WHERE active_millis IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return R.distinct_sessions(t.reading_sessions).where("active_millis is not null").select("id", R.duration_label(F.col("active_millis")).alias("label"))


@query("s7_point_lookup", "SELECT DISTINCT id, book_id, started_at, active_millis FROM reading_sessions WHERE book_id = (SELECT max(book_id) FROM books) AND active_millis > 0")
def _(t: Tables) -> DataFrame:
    """An equality on a key, which a row of another table names, and a range, which is pushed to the scan."""
    key = t.books.agg(F.max("book_id").alias("book_id"))
    return t.reading_sessions.where("active_millis > 0").join(key, "book_id", "left_semi").select("id", "book_id", "started_at", "active_millis").distinct()


@query("s6_sessions_of_letters", "SELECT DISTINCT s.id, s.book_id FROM reading_sessions s WHERE s.book_id IN (SELECT book_id FROM books WHERE category = '书信')")
def _(t: Tables) -> DataFrame:
    """A membership list as a semi join; an empty list gives an empty result."""
    return t.reading_sessions.join(t.books.where("category = '书信'").select("book_id"), "book_id", "left_semi").select("id", "book_id").distinct()

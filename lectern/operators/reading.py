"""Reading statistics: sessions split at midnight, ranks, streaks, dense days, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_sessions(sessions: DataFrame) -> DataFrame:
    """One row per session id: the one received first; rows without an id are no session. Columns that aren't used are neither read nor shuffled."""
    order = F.struct("received_at", "started_at", "ended_at", "active_millis")
    return sessions.where("id is not null").groupBy("id").agg(*(F.min_by(c, order).alias(c) for c in sessions.columns if c != "id"))


def book_rank(sessions: DataFrame) -> DataFrame:
    """Per book with active time: total, sessions, latest start, id of the latest session (ties: the greater id)."""
    active = sessions.where("active_millis > 0 and book_id is not null")
    return active.groupBy("book_id").agg(
        F.sum("active_millis").alias("total_millis"), F.count(F.lit(1)).alias("sessions"), F.max("started_at").alias("last_started_at"), F.max_by("id", F.struct("started_at", "id")).alias("last_session_id")
    )


def split_at_midnight(sessions: DataFrame, zone: str = "UTC", *keep: str) -> DataFrame:
    """(id, book_id, day, millis, keep and with it nth, the part's number): active time by local day, in proportion to wall time.

    A session ends at least one millisecond after its start; shares are rounded
    half up and the last day takes what is left, so they add up. Midnights come
    from the zone, so days of 23 and 25 hours are right. Sessions without
    active time, start or end have no days. A session's shares are taken in its
    own row.
    """
    s = sessions.where("active_millis > 0 and started_at is not null and ended_at is not null").select("id", "book_id", "active_millis", *keep, F.col("started_at").alias("s"), F.greatest("ended_at", F.col("started_at") + 1).alias("e"))
    local = lambda ms: F.to_date(F.from_utc_timestamp(F.timestamp_millis(ms), zone))
    midnight = lambda day: F.unix_millis(F.to_utc_timestamp(day.cast("timestamp"), zone))
    days = s.withColumn("days", F.sequence(local(F.col("s")), local(F.col("e") - 1)))
    overlap = lambda day: F.least("e", midnight(F.date_add(day, 1))) - F.greatest("s", midnight(day))
    share = lambda day: F.floor(F.col("active_millis") * overlap(day) / (F.col("e") - F.col("s")) + 0.5).cast("bigint")
    earlier = F.slice("days", F.lit(1), F.size("days") - 1)
    rest = F.col("active_millis") - F.aggregate("before", F.lit(0).cast("bigint"), lambda a, x: a + x.millis)
    split = days.withColumn("before", F.transform(earlier, lambda day: F.struct(day.alias("day"), share(day).alias("millis"))))
    last = F.struct(F.try_element_at("days", F.lit(-1)).alias("day"), rest.alias("millis"))
    parts = F.array_append("before", last)
    if keep:
        return split.select("id", "book_id", *keep, F.posexplode(parts).alias("nth", "part")).select("id", "book_id", *keep, "nth", "part.*")
    return split.select("id", "book_id", F.inline(parts))


def daily_totals(split: DataFrame) -> DataFrame:
    return split.groupBy("day").agg(F.sum("millis").alias("millis"))


def last_days(daily: DataFrame, today: Column, n: int = 7) -> DataFrame:
    """A row for each of the last n days, 0 where nothing was read."""
    days = daily.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(today, n - 1), today)).alias("day"))
    return days.join(daily, "day", "left").select("day", F.coalesce("millis", F.lit(0).cast("bigint")).alias("millis"))


def streaks(split: DataFrame, key: str) -> DataFrame:
    """(key, first_day, last_day, days): maximal runs of days with reading."""
    active = split.groupBy(key, "day").agg(F.sum("millis").alias("m")).where("m > 0")
    island = F.date_sub("day", F.row_number().over(Window.partitionBy(key).orderBy("day")))
    return active.withColumn("island", island).groupBy(key, "island").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("days")).drop("island")


def current_streak(streaks: DataFrame, today: Column) -> DataFrame:
    """The streak of each key that ends today or yesterday."""
    return streaks.where((F.col("last_day") == today) | (F.col("last_day") == F.date_sub(today, 1)))


def overview(sessions: DataFrame, zone: str = "UTC") -> DataFrame:
    """(kind, key, millis, sessions, last): what a reader's statistics show, from one pass over the sessions.

    kind is total, day, book or streak: active time with the number of sessions
    that begin there and the latest start (of a day: its sessions' parts; of a
    streak: the days of the run, its last day). Sessions of no book count in
    the total and the days.
    """
    columns = ["id", "book_id", "started_at", "ended_at", "active_millis"]
    once = distinct_sessions(sessions).select(*columns)
    parts = split_at_midnight(once, zone, "started_at")
    sums = parts.groupingSets([["day"], ["book_id"], []], "day", "book_id").agg(F.grouping("day").alias("_d"), F.grouping("book_id").alias("_b"), F.sum("millis").alias("millis"), F.sum(F.col("nth").eqNullSafe(0).cast("bigint")).alias("begun"), F.count(F.lit(1)).alias("n"), F.max("started_at").alias("last"))
    kind = F.when(F.col("_d") == 0, "day").when(F.col("_b") == 0, "book").otherwise("total")
    rows = sums.where("_d = 0 or _b = 1 or book_id is not null").select(kind.alias("kind"), F.coalesce(F.col("day").cast("string"), "book_id").alias("key"), "millis", F.when(F.col("_d") == 0, F.col("n")).otherwise(F.col("begun")).alias("sessions"), F.col("last").cast("string").alias("last"))
    days = sums.where("_d = 0 and millis > 0").select("day", "millis")
    # a row for each day of the library's life
    island = F.date_sub("day", F.row_number().over(Window.orderBy("day")))
    runs = days.withColumn("island", island).groupBy("island").agg(F.min("day").alias("a"), F.max("day").alias("b"), F.sum("millis").alias("millis"), F.count(F.lit(1)).alias("n"))
    return rows.unionByName(runs.select(F.lit("streak").alias("kind"), F.col("a").cast("string").alias("key"), "millis", F.col("n").alias("sessions"), F.col("b").cast("string").alias("last")))


def duration_label(millis: Column) -> Column:
    """Hours and minutes of a duration; below a minute, seconds."""
    minutes = F.floor(millis / 60000)
    return (
        F.when(millis < 60000, F.format_string("%d s", F.floor(F.greatest(millis, F.lit(0)) / 1000)))
        .when(minutes < 60, F.format_string("%d min", minutes))
        .otherwise(F.format_string("%d h %d min", F.floor(minutes / 60), minutes % 60))
    )

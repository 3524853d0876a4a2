import datetime as dt

from lectern.streaming import reading as R

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def at(*hm):
    return dt.datetime(2026, 1, 1, *hm)


def land(spark, path, rows):
    spark.createDataFrame([(i, t, u, "view", v, None) for i, t, u, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_stream_equals_batch_and_replays(spark, tmp_path):
    src, out, chk = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/chk"
    land(spark, src, [(1, at(0, 5), 1, 1.0), (2, at(0, 50), 1, 2.0), (2, at(0, 50), 1, 2.0), (3, at(1, 10), 1, 4.0)])
    run = lambda: {(r.started, r.events, r.total) for r in R.run_to_table(R.windows(R.once_each(R.event_stream(spark, src))), out, chk).collect()}
    assert run() == set()
    land(spark, src, [(4, at(9, 0), 2, 1.0)])
    want = {(at(0), 2, 3.0), (at(1), 1, 4.0)}
    assert run() == want and run() == want  # what is there is not written again
    batch = R.windows(R.once_each(R.with_time(spark.read.schema(SCHEMA).parquet(src))))
    assert want < {(r.started, r.events, r.total) for r in batch.collect()}


def test_upsert(spark, tmp_path):
    src, out, chk = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/chk"
    land(spark, src, [(1, at(0, 5), 1, 1.0), (2, at(0, 6), 2, 2.0)])
    go = lambda: R.upsert(R.latest_state(R.with_time(spark.readStream.schema(SCHEMA).parquet(src))), out, chk, "user_id").awaitTermination()
    go()
    land(spark, src, [(3, at(0, 7), 1, 9.0), (4, at(0, 1), 2, 5.0)])
    go()
    newest = max(p.name for p in (tmp_path / "out").iterdir())
    assert {r.user_id: r.value for r in spark.read.parquet(f"{out}/{newest}").collect()} == {1: 9.0, 2: 2.0}


def test_sessions_and_settled(spark):
    rows = [(1, at(0, 0), 1, 1.0), (2, at(0, 29), 1, 1.0), (3, at(1, 0), 1, 1.0), (4, at(0, 0), 2, 1.0)]
    e = R.with_time(spark.createDataFrame([(i, t, u, "view", v, None) for i, t, u, v in rows], SCHEMA))
    assert sorted((r.user_id, r.events) for r in R.sessions(e).collect()) == [(1, 1), (1, 2), (2, 1)]
    assert {r.event_id for r in R.settled(e, 29 * 60_000).collect()} == {2, 3, 4}
    assert R.changes(e).count() == 2 and R.capped(e, 0.5).agg({"value": "sum"}).first()[0] == 2.0

import datetime as dt

from pyspark.sql import functions as F

from sparkassay.streaming import streams


def write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_late_rows_are_dropped(spark, tmp_path):
    root = str(tmp_path)
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    schema = "strategy string, ts timestamp, cost double, latency double, kind string"
    row = lambda h, m, cost, kind="done", by="a": (by, at(h, m), cost, 2 * cost, kind)
    write(spark, f"{root}/events.parquet", [row(1, 0, 1.0), row(1, 30, 2.0), row(1, 40, 9.0, "retry"), row(9, 0, 5.0), row(9, 1, 3.0, by="b")], schema)
    source = streams.table_stream(spark, root, "events")
    run = lambda: {(r.window_start.hour, r.strategy, r.n, r.mean_cost, r.mean_latency) for r in streams.drain_updates(
        streams.windowed_metrics(source, "ts", "strategy", "cost", "latency", "1 hour", "1 hour"), "m", ["window_start", "strategy"],
        str(tmp_path / "kept")).collect()}
    # Open windows are seen at once.
    assert run() == {(1, "a", 2, 1.5, 3.0), (9, "a", 1, 5.0, 10.0), (9, "b", 1, 3.0, 6.0)}
    # A second file, after a restart: one row behind the watermark, one that changes an open window, one of a new window.
    write(spark, f"{root}/events.parquet", [row(1, 10, 100.0), row(9, 30, 7.0), row(12, 0, 7.0)], schema)
    want = {(1, "a", 2, 1.5, 3.0), (9, "a", 2, 6.0, 12.0), (9, "b", 1, 3.0, 6.0), (12, "a", 1, 7.0, 14.0)}
    assert run() == want and run() == want


def test_bursts_close_after_the_gap(spark, tmp_path):
    root = str(tmp_path)
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [(1, t(0), 1, "start", None), (1, t(5), 3, "sql_token", "b"), (1, t(4), 2, "sql_token", "a"), (1, t(40), 4, "done", None),
            (2, t(600), 5, "done", None)]
    write(spark, f"{root}/log.parquet", rows, "r int, ts timestamp, i int, kind string, content string")
    source = streams.table_stream(spark, root, "log")
    out = streams.drain_to_table(streams.session_fold(source, "r", "ts", "i", "30 minutes", "10 minutes"), "bursts")
    got = sorted((r.r, r.n_events, r.last_kind, r.sql_text) for r in out.collect())
    assert got == [(1, 1, "done", ""), (1, 3, "sql_token", "ab")]


def test_repeated_batch_overwrites_itself(spark, tmp_path):
    root = str(tmp_path)
    write(spark, f"{root}/q.parquet", [(1,), (2,)], "i int")
    out = streams.drain_batches(streams.table_stream(spark, root, "q"), "batches", lambda b: b.select(F.col("i") * 2))
    assert out.count() == 2


def test_screening_stream(spark, tmp_path):
    root = str(tmp_path)
    write(spark, f"{root}/t.parquet", [(1, "how many parts?"), (2, "drop table x"), (3, " ")], "i int, text string")
    out = streams.drain_to_table(streams.screen_and_grade(streams.table_stream(spark, root, "t"), ["i"], "text"), "screened")
    assert sorted(map(tuple, out.collect())) == [(1, True, None, "easy"), (2, False, "sql_injection", None), (3, False, "empty_input", None)]

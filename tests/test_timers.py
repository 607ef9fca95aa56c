import time

import pandas as pd
from pyspark.sql import functions as F

from docpipe.streaming import events as E
from docpipe.streaming import timers as T


def follow(stream, tmp_path, done, put=lambda k: None, seconds=60):
    """Runs a stream until its rows satisfy done; put(k) is called after each look."""
    got = []
    q = stream.writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "at")).trigger(processingTime="200 milliseconds").start()
    try:
        for k in range(seconds * 4):
            put(k)
            time.sleep(0.25)
            if q.exception() is not None:
                raise q.exception()
            if done(got):
                break
    finally:
        q.stop()
    return got


def source(spark, tmp_path, rows, schema):
    path = str(tmp_path / "in")
    df = spark.createDataFrame(rows, schema)
    df.select(*[F.timestamp_seconds(c).alias(c) if c in ("ts", "modified") else c for c in df.columns]).coalesce(1).write.mode("append").parquet(path)
    held = spark.read.parquet(path).schema
    return spark.readStream.schema(held).parquet(path)


def test_a_silent_path_is_given_up(spark, tmp_path):
    rows = [("a", 1, 5), ("a", 2, 5), ("a", 3, 5), ("silent", 1, 1), ("silent", 2, 2)]
    stream = T.watched_stream(source(spark, tmp_path, rows, "path string, ts long, size long"), give_up_ms=1500)
    got = {(r.path, r.ts and r.ts.second, r.size, r.stable) for r in follow(stream, tmp_path, lambda g: len(g) >= 2)}
    assert got == {("a", 3, 5, True), ("silent", None, 2, False)}


def test_watched_stream_equals_batch(spark, tmp_path):
    rows = [("a", 1, 5), ("a", 2, 5), ("a", 3, 5), ("b", 1, 1), ("b", 2, 2), ("b", 3, 2), ("b", 4, 2), ("b", 5, 2), *[("c", t, t) for t in range(70)], ("d", 1, 1)]
    source(spark, tmp_path, rows, "path string, ts long, size long")
    seen = spark.read.parquet(str(tmp_path / "in"))
    batch = {r.path: (r.ts, r.stable) for r in E.stable_files(seen).collect()}
    stream = T.watched_stream(spark.readStream.schema(seen.schema).parquet(str(tmp_path / "in")), give_up_ms=1500)
    first: dict = {}
    for r in follow(stream, tmp_path, lambda g: len({r.path for r in g}) == 4):
        first.setdefault(r.path, (None if r.ts is pd.NaT else r.ts, r.stable))
    assert first == batch


def test_a_path_given_up_is_watched_anew(spark, tmp_path):
    stream = T.watched_stream(source(spark, tmp_path, [("a", 1, 5)], "path string, ts long, size long"), give_up_ms=1000)
    later = []

    def put(k):
        if k == 30:
            source(spark, tmp_path, [("a", t, 9) for t in (20, 21, 22)], "path string, ts long, size long")
            later.append(k)

    got = follow(stream, tmp_path, lambda g: len(g) >= 2, put)
    assert [(r.size, r.stable) for r in got] == [(5, False), (9, True)]


def test_debounce_closes_its_last_run(spark, tmp_path):
    rows = [("p", t, False) for t in (0, 1, 5, 100)] + [("q", 3, False)]
    stream = source(spark, tmp_path, rows, "profile_id string, ts long, reload boolean")
    batch = {(r.profile_id, r.start, r.end, r.changes) for r in E.debounced(spark.read.parquet(str(tmp_path / "in")), "2 seconds").collect()}
    got = follow(T.debounced_stream(stream, 2000, wait_ms=1000), tmp_path, lambda g: len(g) >= len(batch))
    assert {(r.profile_id, r.start, r.end, r.changes) for r in got} == batch and len(batch) == 4


def test_a_reload_fires_at_once(spark, tmp_path):
    rows = [("p", 0, False), ("p", 1, True), ("q", 0, False)]
    got = follow(T.debounced_stream(source(spark, tmp_path, rows, "profile_id string, ts long, reload boolean"), 2000, wait_ms=3_600_000), tmp_path, lambda g: bool(g))
    assert [(r.profile_id, r.changes, r.reload) for r in got] == [("p", 2, True)]


def test_a_lost_end_frees_its_path(spark, tmp_path):
    rows = [("a", 1, 0), ("a", 2, 1), ("b", 1, 2)]
    stream = E.coalesced_stream(source(spark, tmp_path, rows, "path string, ts long, strength int"), lost_ms=1500)
    put = lambda k: source(spark, tmp_path, [("b", 60, 1)], "path string, ts long, strength int") if k == 40 else None
    got = follow(stream, tmp_path, lambda g: len(g) >= 4, put)
    assert sorted((r.path, r.strength) for r in got) == [("a", 0), ("a", 1), ("b", 1), ("b", 2)]

import pandas as pd
from pyspark.sql import functions as F

from docpipe.streaming import events as E


def drain(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def observed(spark, tmp_path, rows):
    spark.createDataFrame(pd.DataFrame(rows, columns=["path", "ts", "size"]).assign(ts=lambda x: pd.to_datetime(x.ts, unit="s")), "path string, ts timestamp, size long").coalesce(1).write.parquet(str(tmp_path / "in"))
    return str(tmp_path / "in"), "path string, ts timestamp, size long"


def test_stable_stream_equals_batch(spark, tmp_path):
    rows = [("a", 1, 5), ("a", 2, 5), ("a", 3, 5), ("b", 1, 1), ("b", 2, 2), ("b", 3, 2), ("b", 4, 2), ("b", 5, 2), *[("c", t, t) for t in range(70)]]
    path, schema = observed(spark, tmp_path, rows)
    batch = {r.path: (r.ts, r.stable) for r in E.stable_files(spark.read.schema(schema).parquet(path)).collect()}
    stream = {r.path: (r.ts, r.stable) for r in drain(E.stable_stream(spark.readStream.schema(schema).parquet(path)), "stable").collect()}
    assert batch["a"][1] and batch["b"][1] and not batch["c"][1]
    assert stream == batch


def test_debounce_stream_closed_sessions(spark, tmp_path):
    df = spark.createDataFrame([("p", t) for t in (0, 1, 5, 100)], "profile_id string, s long").select("profile_id", F.timestamp_seconds("s").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = {(r.start, r.changes) for r in E.debounced(spark.read.parquet(str(tmp_path / "in")), "2 seconds").collect()}
    stream = drain(E.debounced(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "2 seconds", "1 second"), "debounced")
    got = {(r.start, r.changes) for r in stream.collect()}
    assert len(batch) == 3 and got <= batch and len(got) >= 2


def test_upsert_is_exactly_once(spark, tmp_path):
    base = str(tmp_path / "state")
    schema = spark.createDataFrame([], "k long, v string").schema
    put = E.upsert_sink(base, lambda old, new: old.join(new, "k", "left_anti").unionByName(new), schema)
    for batch, rows in ((0, [(1, "a"), (2, "b")]), (1, [(2, "c")]), (1, [(2, "again")])):
        put(spark.createDataFrame(rows, schema), batch)
    last = E.latest(spark, base)
    assert last == 1 and {(r.k, r.v) for r in spark.read.parquet(f"{base}/v={last}").collect()} == {(1, "a"), (2, "c")}


def test_arrivals(spark, tmp_path):
    (tmp_path / "x.md").write_text("hello")
    assert [r.size for r in drain(E.arrivals(spark, str(tmp_path), "*.md"), "arrivals").collect()] == [5]


def test_output_changes_and_late_results(spark, tmp_path):
    rows = [("/out/a/x.md", 1, 1), ("/out/a/b/y.md", 2, 1), ("/out/a/x.assets/z.md", 3, 1), ("/else/q.md", 4, 1)]
    path, schema = observed(spark, tmp_path, rows)
    files = spark.readStream.schema(schema).parquet(path).select("path", F.col("ts").alias("modified"))
    got = {(r.profile_id, r.path) for r in drain(E.output_changes(files, {"/out/a": "p", "/out/a/b": "q"}), "changes").collect()}
    assert got == {("p", "/out/a/x.md"), ("q", "/out/a/b/y.md")}
    kept = []
    results = spark.readStream.schema(schema).parquet(path).select("path", F.col("size").cast("string").alias("read_hash"))
    current = spark.createDataFrame([("/out/a/x.md", "1"), ("/else/q.md", "2")], "path string, content_hash string")
    q = E.current_results(results, lambda: current, lambda df, i: kept.extend(r.path for r in df.collect())).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert kept == ["/out/a/x.md"]


def test_stability_by_time_of_change_and_again(spark, tmp_path):
    rows = [("a", 1, 5, 1), ("a", 2, 5, 2), ("a", 3, 5, 2), ("a", 4, 5, 2), ("a", 5, 5, 2), ("a", 6, 9, 7), ("a", 7, 9, 7), ("a", 8, 9, 7), ("b", 1, 1, 1), ("b", 2, 1, 2), ("b", 3, 1, 3)]
    df = spark.createDataFrame(rows, "path string, t long, size long, m long").select("path", F.timestamp_seconds("t").alias("ts"), "size", F.timestamp_seconds("m").alias("modified"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = drain(E.stable_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), "stable_again").collect()
    assert sorted((r.path, r.ts.second, r.size) for r in got) == [("a", 4, 5), ("a", 8, 9)]
    batch = {r.path: (r.ts and r.ts.second, r.stable) for r in E.stable_files(df).collect()}
    assert batch == {"a": (4, True), "b": (None, False)}


def test_coalesced_stream_holds_across_batches(spark, tmp_path):
    schema = "path string, ts timestamp, strength int"
    batches = [[("a", 1, 0), ("b", 1, 2)], [("a", 2, 0), ("a", 3, 2), ("a", 4, 1)], [("a", 5, None), ("b", 5, None)], [("a", 6, None), ("b", 6, 1), ("a", 7, 0)]]
    got = []
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "path string, t long, strength int").select("path", F.timestamp_seconds("t").alias("ts"), "strength")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = E.coalesced_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got.append(sorted((r.path, r.ts.second, r.strength) for r in spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got[0] == [("a", 1, 0), ("b", 1, 2)] == got[1]
    assert got[2] == sorted([*got[0], ("a", 5, 2)])
    assert got[3] == sorted([*got[2], ("a", 7, 0), ("b", 6, 1)])


def test_chained_stages(spark, tmp_path):
    schema = "profile_id string, path string, content_hash string, classify boolean"
    at = lambda x: str(tmp_path / x)
    run = lambda source, step, name: E.stage(source, step, at(name), at(name + "_at")).trigger(availableNow=True).start().awaitTermination(120)
    for k in range(2):  # each stage reads what the one before wrote, once
        rows = [("p", f"a/b/x{k}.md", f"h{k}", True), ("q", f"c/y{k}.md", f"g{k}", False)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at("converted"))
        run(spark.readStream.schema(schema).parquet(at("converted")), E.to_classify, "queue")
        run(spark.readStream.schema("profile_id string, path string, read_hash string").parquet(at("queue")), E.to_index, "dirty")
    assert sorted((r.path, r.read_hash) for r in spark.read.parquet(at("queue")).collect()) == [("a/b/x0.md", "h0"), ("a/b/x1.md", "h1")]
    assert sorted((r.profile_id, r.folder) for r in spark.read.parquet(at("dirty")).collect()) == sorted([("p", x) for x in ("", "a", "a/b")] * 2)


def test_only_touched_parts_are_written(spark, tmp_path):
    base = str(tmp_path / "state")
    schema = spark.createDataFrame([], "k long, v string").schema
    put = E.bucketed_sink(base, lambda old, new: old.join(new, "k", "left_anti").unionByName(new), schema, "k")
    put(spark.range(200).selectExpr("id as k", "'a' as v"), 0)
    put(spark.createDataFrame([(7, "b"), (500, "c")], schema), 1)
    put(spark.createDataFrame([(7, "again")], schema), 1)
    got = {r.k: r.v for r in E.current(spark, base, schema).collect()}
    assert got == {**dict.fromkeys(range(200), "a"), 7: "b", 500: "c"}
    assert len([x for x in E.folders(spark, f"{base}/v=1") if x.startswith("bucket=")]) <= 2
    assert E.current(spark, str(tmp_path / "none"), schema).count() == 0

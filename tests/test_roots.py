import random

from pyspark.sql import functions as F

from docpipe.operators import increment as I
from docpipe.operators import roots as R
from docpipe.sources.tables import written
from docpipe.streaming import events as E


def plan(df):
    return df._jdf.queryExecution().toString()


def test_ten_thousand_roots(spark):
    known = {f"/r{k % 100}/s{k}": f"p{k}" for k in range(10_000)} | {"/r7": "top7", "/r8/": "top8"}
    rows = [("/r3/s103/a/b.md", "p103"), ("/r3/s103", "p103"), ("/r3/s1030", None), ("/r7/x", "top7"), ("/r7/s107/x", "p107"), ("/r8/q", "top8"), ("/r70", None), ("relative/r7", None), (None, None)]
    df = spark.createDataFrame(rows, "path string, want string")
    got = df.select("path", "want", R.nearest_root(spark, F.col("path"), known).alias("got"))
    assert [(r.path, r.got) for r in got.collect()] == rows
    small = df.select(R.nearest_root(spark, F.col("path"), {"/a": "b"}).alias("got"))
    assert len(plan(got)) - len(plan(small)) < 1000  # the roots are not in the plan
    assert spark.createDataFrame([("/x/y",)], "p string").select(R.nearest_root(spark, F.col("p"), {"/": "all"}).alias("g")).first().g == "all"


def leftmost_longest(text, masks):
    out, at = [], 0
    while at < len(text):
        own = max((m for m in masks if m and text.startswith(m, at)), key=len, default=None)
        out.append(text[at] if own is None else masks[own])
        at += 1 if own is None else len(own)
    return "".join(out)


def test_masks_are_leftmost_longest(spark):
    r = random.Random(9)
    masks = {"".join(r.choices("abc/", k=r.randint(1, 5))): f"<{k}>" for k in range(60)}
    texts = ["".join(r.choices("abcd/é", k=r.randint(0, 60))) for _ in range(200)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    got = [x.g for x in df.select(R.redact(spark, F.col("t"), masks).alias("g")).collect()]
    assert got == [t and leftmost_longest(t, masks) for t in texts]
    assert df.select(R.redact(spark, F.col("t"), {}).alias("g")).where(F.col("t") != F.col("g")).count() == 0


def test_ten_thousand_masks(spark):
    masks = {f"secret-{k}": f"***{k}" for k in range(10_000)}
    df = spark.createDataFrame([("key secret-77 and secret-7, not secret-",)], "t string")
    got = df.select(R.redact(spark, F.col("t"), masks).alias("g"))
    assert got.first().g == "key ***77 and ***7, not secret-"
    assert len(plan(got)) - len(plan(df.select(R.redact(spark, F.col("t"), {"a": "b"}).alias("g")))) < 1000


def test_a_sink_may_empty_a_part(spark, tmp_path):
    base, schema = str(tmp_path / "t"), spark.createDataFrame([], "k long, v string").schema
    step = lambda old, new: old.join(new, "k", "left_anti").unionByName(new.where("v is not null"))
    put = E.bucketed_sink(base, step, schema, "k")
    put(spark.createDataFrame([(1, "a"), (2, "b")], schema), 0)
    put(spark.createDataFrame([(1, None)], schema), 1)
    put(spark.createDataFrame([(1, "again")], schema), 1)  # the batch again
    assert [tuple(r) for r in E.current(spark, base, schema).collect()] == [(2, "b")]


def test_a_chain_ends_in_the_index(spark, tmp_path):
    base, pages = str(tmp_path / "index"), []
    for k in range(2):
        rows = [(f"a/b/x{k}.md", ["c"], k, False, k), ("z/y.md", None, 5, k == 1, k)]
        spark.createDataFrame(rows, I.CHANGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(I.CHANGES).parquet(str(tmp_path / "in"))
        sink = E.index_sink(base, lambda df, i: pages.append((i, sorted(r.folder for r in df.collect()))))
        q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    got = {r.folder: r.documents for r in I.FolderIndex(spark, base).rollup().collect()}
    assert got == {"": 2, "a": 2, "a/b": 2}
    assert pages == [(0, ["", "a", "a/b", "z"]), (1, ["", "a", "a/b"])]

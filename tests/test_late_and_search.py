import random

from pyspark.sql import functions as F

from docpipe.functions import paths as P
from docpipe.operators import parts as R
from docpipe.operators import search_index as S
from docpipe.operators.health import searched
from docpipe.sources.tables import removed
from docpipe.sources.versioned import Versioned, forget, put_changes, without_gone
from docpipe.streaming import events as E

RESULTS = "path string, profile_id string, read_hash string, read_rules string, read_epoch int"


def test_a_profile_cancelled_between_batches(spark, tmp_path):
    profiles = {"p": ("p", True, "r1", 1), "q": ("q", True, "r1", 1)}
    schema = spark.createDataFrame([], "path string, content_hash string, version long, gone boolean").schema
    docs = Versioned(spark, str(tmp_path / "docs"), schema, "path")
    put_changes(docs, spark.createDataFrame([("a", "h1", 1, False), ("b", "h1", 1, False)], schema), 0, "path", "version")
    kept, late = [], []
    batches = [
        [("a", "p", "h1", "r1", 1), ("b", "q", "h1", "r1", 1)],
        [("a", "p", "h1", "r1", 1), ("b", "q", "h1", "r1", 1), ("b", "q", "h1", "r2", 1), ("c", "q", "h", "r2", 1)],
        [("a", "p", "h1", "r1", 1), ("a", "p", "h1", "r1", 3), ("b", "q", "h1", "r2", 1), ("b", "q", "h2", "r2", 1)],
    ]
    for k, rows in enumerate(batches):
        if k == 1:  # rules of q change, p goes off
            profiles = {"p": ("p", False, "r1", 1), "q": ("q", True, "r2", 1)}
        if k == 2:  # p is set up anew, b changes
            profiles["p"] = ("p", True, "r1", 3)
            put_changes(docs, spark.createDataFrame([("b", "h2", 2, False)], schema), 1, "path", "version")
        spark.createDataFrame(rows, RESULTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(RESULTS).parquet(str(tmp_path / "in"))
        q = E.settled_results(
            stream, lambda batch: without_gone(docs.read(docs.touched(batch))), lambda: spark.createDataFrame(list(profiles.values()), "profile_id string, enabled boolean, rules_hash string, epoch int"),
            lambda df, i, k=k: kept.extend((k, r.path, r.read_hash) for r in df.collect()), lambda df, i, k=k: late.extend((k, r.path, r.outcome) for r in df.collect()),
        ).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(kept) == [(0, "a", "h1"), (0, "b", "h1"), (1, "b", "h1"), (2, "a", "h1"), (2, "b", "h2")]
    assert sorted(late) == [(1, "a", "cancelled"), (1, "b", "outdated"), (1, "c", "gone"), (2, "a", "cancelled"), (2, "b", "conflict")]


def test_a_removed_key_stays_removed(spark, tmp_path):
    schema = spark.createDataFrame([], "k string, v string, version long, gone boolean").schema
    table = Versioned(spark, str(tmp_path / "t"), schema, "k", parts=4)
    put = lambda rows, i: put_changes(table, spark.createDataFrame(rows, schema), i, "k", "version")
    put([("a", "1", 1, False), ("b", "1", 1, False)], 0)
    put([("a", None, 5, True)], 1)
    put([("a", "late", 3, False)], 2)  # older than the removal
    put([("a", "late", 3, False)], 2)  # and again
    now = lambda: {r.k: r.v for r in without_gone(table.read()).collect()}
    assert now() == {"b": "1"} and table.read().count() == 2
    assert forget(table, F.col("version") < 10) and table.read().count() == 1
    part = table.touched(spark.createDataFrame([("a",)], "k string"))[0]
    if part not in table.touched(spark.createDataFrame([("b",)], "k string")):
        assert part not in table.held()[1]  # an emptied part is in no manifest
    put([("a", "anew", 12, False)], 3)  # the stream's next batch
    assert now() == {"a": "anew", "b": "1"}
    table.clean(1)
    assert now() == {"a": "anew", "b": "1"} and table.manifests() == [3]


def test_a_read_lists_once_however_many_versions(spark, tmp_path, monkeypatch):
    from docpipe.sources import versioned as V

    schema = spark.createDataFrame([], "k string, v string").schema
    table = Versioned(spark, str(tmp_path / "t"), schema, "k", parts=4)
    calls = []
    plain = V.folders
    monkeypatch.setattr(V, "folders", lambda s, p: calls.append(p) or plain(s, p))
    seen = []
    for k in range(6):
        rows = spark.createDataFrame([("a", str(k))], schema)
        table.write(k, rows, table.touched(rows))
        calls.clear()
        assert [r.v for r in table.read().collect()] == [str(k)]
        seen.append(len(calls))
    assert set(seen) == {1}
    table.clean(1)
    assert [x for x in plain(spark, table.base) if x.startswith("v=")] == ["v=5"] and table.manifests() == [5]


def test_search_index_equals_contains(spark, tmp_path):
    r = random.Random(1)
    texts = ["".join(r.choices("abÉ .-1", k=r.choice([0, 1, 2, 3, 9, 40]))) for _ in range(300)] + ["ABC abc", "ends with ab", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string").repartition(3)
    S.build(df, str(tmp_path / "i"))
    needles = ["a", "É", "ab", "1", "ab1", "ABC", " ab ", "abé", "zzz", "a.-", "b -1a", "ends with", ""]
    got = {}
    for x in S.found(spark, str(tmp_path / "i"), df, needles).collect():
        got.setdefault(x.needle, []).append(x.id)
    for n in needles:
        want = sorted(x.id for x in searched(df.where("text is not null"), n, "text").collect()) if n.strip() else list(range(len(texts)))
        assert sorted(got.get(n.strip().lower(), [])) == want, n


def test_search_reads_only_what_is_asked(spark, tmp_path):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(["alpha", "beta", "gamma", "delta"])], "id long, text string")
    S.build(df, str(tmp_path / "i"))
    asked = {x.p for g in S.needle_grams("gam") for x in spark.range(1).select(S.part(F.lit(g)).alias("p")).collect()}
    for name in [x for x in (tmp_path / "i/postings").iterdir() if x.name.startswith("part=")]:
        if int(name.name[5:]) not in asked:  # a job that reads another part would fail or miss it
            removed(spark, str(name))
    assert [x.id for x in S.found(spark, str(tmp_path / "i"), df, ["GAM"]).collect()] == [2]


def test_pieces_join_to_the_whole(spark):
    rows = [(1, 2, "second"), (1, 1, "---\nx: 1\n---\nfirst"), (1, 3, None), (2, 1, "é" * 1000), (3, 1, ""), (2, 2, "tail")]
    parts = spark.createDataFrame(rows, "doc_id long, part_index int, text string")
    whole = {r.doc_id: r.markdown for r in R.merged(parts).collect()}
    for size in (1, 7, 300, 10**6):
        got: dict = {}
        for r in R.merged_pieces(parts, size).orderBy("doc_id", "piece").collect():
            assert 0 < len(r.text) <= size
            got.setdefault(r.doc_id, []).append((r.piece, r.pieces, r.text))
        assert {k: "".join(t for _, _, t in v) for k, v in got.items()} == whole
        assert all([p for p, _, _ in v] == list(range(1, v[0][1] + 1)) for v in got.values())
    small = {r.doc_id: (r.markdown, r.too_large) for r in R.merged(parts, 100).collect()}
    assert small[2] == (None, True) and small[3] == (whole[3], False)


def test_long_runs_of_digits_are_in_order(spark):
    names = ["a2", "a10", "a" + "9" * 30, "a1" + "0" * 30, "a" + "0" * 40 + "3", "a" + "1" * 21, "a" + "1" * 20, "b1", "A5"]
    got = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(P.natural_key(F.col("n"))).collect()]
    key = lambda n: (n[0].lower(), int(n[1:]))
    assert [key(n) for n in got] == sorted(key(n) for n in names)

import io
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docpipe.operators import classify as K
from docpipe.operators import convert as V
from docpipe.operators import inventory as I
from docpipe.operators import parts as R
from docpipe.operators import state as S
from docpipe.sources import files as X


def test_failed_scan_is_no_deletion(spark):
    tasks = spark.createDataFrame([("a", "p1", "completed"), ("b", "p2", "completed"), ("c", "p1", "completed")], "source_path string, profile_id string, status string")
    files = spark.createDataFrame([("c",)], "source_path string")
    roots = spark.createDataFrame([("p1", True), ("p2", False)], "profile_id string, available boolean")
    assert [r.source_path for r in I.missing_sources(tasks, files, roots).collect()] == ["a"]


def test_longest_prefix_stops_at_separators(spark):
    items = spark.createDataFrame([(1, "/a/b/c.md"), (2, "/ab/c.md"), (3, "/x")], "id long, path string")
    roots = spark.createDataFrame([("r", "/a"), ("s", "/a/b")], "id string, root string")
    assert {(r.id, r.root_id) for r in I.longest_prefix(items, roots).collect()} == {(1, "s")}


def test_page_ranges(spark):
    rows = R.page_ranges(spark.createDataFrame([(1, 401), (2, 200), (3, 0)], "id long, pages long")).orderBy("id", "part_index").collect()
    assert [(r.id, r.page_range, r.part_count) for r in rows] == [(1, "1-200", 3), (1, "201-400", 3), (1, "401-401", 3), (2, "1-200", 1)]


@pytest.mark.parametrize(("status", "same", "out"), [("reading", False, False), ("completed", True, False), ("completed", False, True), ("failed", True, True), ("cancelled", True, True)])
def test_requeue_matrix(spark, status, same, out):
    df = spark.range(1).select(S.should_requeue(F.lit(status), F.lit("h"), F.lit("h" if same else "g")).alias("x"))
    assert df.first().x is out


@pytest.mark.parametrize(("p", "category"), [(0.5, ["未分类"]), (0.51, ["a"]), (-0.1, None), (1.1, None), (None, None), (float("nan"), None)])
def test_probabilities(spark, p, category):
    labels = spark.createDataFrame([("label_0", "a", 0)], "label_key string, name string, pos int")
    row = K.read_multi(spark.createDataFrame([(1, "label_0", p)], "doc_id long, label_key string, p double"), labels).first()
    assert row.categories == category and (row.error is None) == (category is not None)


def test_batches_of_questions(spark):
    rows = K.question_batches(spark.createDataFrame([(i, f"n{i}") for i in range(17)], "pos long, name string")).orderBy("batch").collect()
    assert [r.n for r in rows] == [16, 1]


def test_html():
    page = "<html><head><title>t</title><style>x</style></head><body><h1>A &amp; B</h1><p>One <b>two</b> <a href='/l'>link</a><img src=i.png alt=pic></p><ul><li>x<li>y</ul><table><tr><th>a<th>b</tr><tr><td>1</td><td>2</td></tr></table>"
    assert V.html_to_markdown(page, "http://h/d/") == "# A & B\n\nOne **two** [link](http://h/l)![pic](http://h/d/i.png)\n\n- x\n- y\n\n| a | b |\n| --- | --- |\n| 1 | 2 |"


def test_csv_and_charsets():
    assert V.csv_to_markdown("city,rain mm\nBergen,2250\n") == "| city | rain mm |\n| --- | --- |\n| Bergen | 2250 |"
    assert V.decoded("中文".encode("gbk"), "gbk") == "中文"
    assert V.decoded(b"\xff\xfe" + "a".encode("utf-16-le"), bom_first=True) == "a"
    with pytest.raises(UnicodeDecodeError):
        V.decoded(b"\xff\xff\xff")


def test_web_archive():
    raw = (
        b'MIME-Version: 1.0\r\nContent-Type: multipart/related; boundary="b"\r\n\r\n--b\r\nContent-Type: text/html; charset=utf-8\r\nContent-Location: http://h/p/i.html\r\n\r\n'
        b'<h1>T</h1><img src="cid:one"><img src="a.png#x"><img src="cid:none"><a href="q">l</a>\r\n--b\r\nContent-Type: image/png\r\nContent-ID: <one>\r\n\r\nAB\r\n--b\r\nContent-Type: image/jpeg\r\nContent-Location: http://h/p/a.png\r\n\r\nCD\r\n--b--\r\n'
    )
    text, assets, warnings = V.unpack_web_archive(raw)
    assert "mhtml-0000.png" in text and "mhtml-0001.jpg" in text and "[l](http://h/p/q)" in text
    assert [a for a, _ in assets] == ["mhtml-0000.png", "mhtml-0001.jpg"] and warnings == ["missing image: cid:none"]


def test_result_archive(spark):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("r/other.md", "no")
        z.writestr("r/full.md", "![x](images/a%20b.png)")
        z.writestr("r/images/a b.png", b"1")
        z.writestr("r/images/unused.png", b"2")
        z.writestr("../evil.png", b"3")
    rows = X.unpack_result_archives(spark.createDataFrame([("z", b.getvalue()), ("bad", b"no zip")], "path string, content binary")).collect()
    assert {(r.path, r.member) for r in rows} == {("z", None), ("z", "images/a b.png"), ("bad", None)}
    assert next(r for r in rows if r.path == "bad").error


def test_categories_keep_comments():
    t = "---\r\n# note\r\ntitle: x\r\ncategories:\r\n  - old\r\n---\r\nbody"
    out = V.merge_categories(t, ["新", "b: c"])
    assert out == "---\r\n# note\r\ntitle: x\r\ncategories:\r\n  - 新\r\n  - 'b: c'\r\n---\r\nbody"
    assert V.strip_categories(out) == "---\r\n# note\r\ntitle: x\r\n---\r\nbody"
    assert V.merge_categories("body", ["a"]) == "---\ncategories:\n  - a\n---\nbody"
    with pytest.raises(ValueError):
        V.merge_categories("---\n- a\n---\n", ["a"])


def test_conversions_hold_few_rows(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    df = spark.createDataFrame([(1, "<p>a</p>", ["x"])], "doc_id long, text string, categories array<string>")
    for step in (V.chunked, V.categorized, lambda x: V.converted(x, lambda t: (t, []), "text")):
        spark.conf.set(key, "10000")
        assert step(df).count() == 1 and int(spark.conf.get(key)) <= 1_000
    asked = []
    monkeypatch.setattr(V, "ROWS", 3)
    batch = pa.record_batch([pa.array(range(10, 18)), pa.array(["a", None, "b", "c", "", "d", "e", "f"])], names=["k", "t"])
    out = list(V.few_at_once(iter([batch, batch.slice(0, 0)]), lambda x: asked.append(len(x[0])) or [(i, t) for i, t in enumerate(x[0]) if t for _ in range(2)], ["k", "t"], [pa.string()]))
    assert asked == [3, 3, 2] and [(k, t) for x in out for k, t in zip(x["k"].to_pylist(), x["t"].to_pylist())] == [(k, t) for k, t in zip(range(10, 18), "a.bc.def") if t != "." for _ in range(2)]


def test_chunks():
    pieces, more = V.chunks("é" * 3000)
    assert "".join(pieces) == "é" * 3000 and not more and len(pieces[0].encode()) == 4096
    pieces, more = V.chunks("a" * 70_000)
    assert more and sum(map(len, pieces)) == 65_536


def test_conversion_errors_stay_in_rows(spark):
    df = spark.createDataFrame([(1, "<p>x</p>"), (2, ""), (3, None)], "doc_id long, html string")
    rows = {r.doc_id: r for r in V.converted(df, lambda x: (V.html_to_markdown(x), []), "html").collect()}
    assert rows[1].status == "converted" and rows[2].error == rows[3].error == "empty result"


def test_scan(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "x.md").write_text("1")
    (tmp_path / "y.exe").write_text("2")
    files, roots = X.scan_profiles(spark, [("p", str(tmp_path)), ("q", str(tmp_path / "none"))])
    assert [(r.rel_path, r.size) for r in files.collect()] == [("a b/x.md", 1)]
    assert {(r.profile_id, r.available) for r in roots.collect()} == {("p", True), ("q", False)}


def test_ocr_response(spark):
    ok = '{"code":0,"data":{"extract_result":[{"data_id":"a","state":"done"},{"data_id":"b","state":"running","extract_progress":{"extracted_pages":3,"total_pages":9}}]}}'
    rows = X.parse_ocr_response(spark.createDataFrame([(ok, "b"), (ok, None), ('{"code":1,"msg":"no"}', None)], "json string, want string"), F.col("want")).collect()
    assert [(r.ok, r.state, r.extracted) for r in rows] == [(True, "running", 3), (True, "done", None), (False, None, None)]


def test_import_positions(spark):
    good, bad = '[{"name":"a","description":""}]', '[{"name":"a","description":""},{"name":1,"description":""}]'
    twice = '[{"name":" A ","description":""},{"name":"a","description":""}]'
    rows = {r.batch: r for r in K.category_batches(spark.createDataFrame([(1, good), (2, bad), (3, twice), (4, "{}"), (5, '[{"name":"a"}]')], "batch long, json string")).collect()}
    assert [rows[i].error for i in range(1, 6)] == [None, "bad_item", "duplicate_name", "not_an_array", "bad_item"]
    assert rows[2].error_position == 2


def test_sinks(spark, tmp_path):
    X.write_converted(spark.createDataFrame([("p", "a.md", "---\nx\n---\n", "\n\n body"), ("q", "b.md", "---\n---\n", "b")], "profile_id string, rel_path string, frontmatter string, markdown string"), str(tmp_path / "md"))
    assert {r.markdown for r in spark.read.parquet(str(tmp_path / "md")).collect()} == {"---\nx\n---\n\nbody", "---\n---\n\nb"}
    X.write_converted(spark.createDataFrame([("q", "b.md", "", "new")], "profile_id string, rel_path string, frontmatter string, markdown string"), str(tmp_path / "md"))
    assert {(r.profile_id, r.markdown[-4:]) for r in spark.read.parquet(str(tmp_path / "md")).collect()} == {("p", "body"), ("q", "\nnew")}
    X.write_assets(spark.createDataFrame([(1, "o/a.md", "i/x.png", b"1"), (1, "o/a.md", "../evil", b"2")], "doc_id long, output_path string, relative_path string, bytes binary"), str(tmp_path / "assets"))
    assert [r.asset_path for r in spark.read.parquet(str(tmp_path / "assets")).collect()] == ["o/a.assets/i/x.png"]


def test_state_gains_columns(spark, tmp_path):
    spark.createDataFrame([(1,)], "id long").write.parquet(str(tmp_path / "s" / "v=1"))
    schema = spark.createDataFrame([], "id long, error string").schema
    assert X.read_state(spark, str(tmp_path / "s" / "v=1"), schema).first().asDict() == {"id": 1, "error": None}


def test_scores_are_a_plug_in(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "")], "doc_id long, text string")
    out = V.with_scores(df, lambda x: x.assign(p=x["text"].str.len() / 2)[["doc_id", "p"]], "doc_id long, p double")
    assert {(r.doc_id, r.p) for r in out.collect()} == {(1, 1.0), (2, 0.0)}


@pytest.mark.parametrize("n", [254, 255])
def test_most_options(spark, n):
    row = K.single_question(spark.createDataFrame([(i, f"n{i}") for i in range(n)], "pos int, name string")).first()
    assert (row.error is None) == (n == 254)


def test_pages_list_every_entry(spark):
    from docpipe.operators import index as D

    rows = [(f"a/b/doc-{i:02}.md", ["x"] if i % 2 else [], i * 60_000) for i in range(23)]
    docs = spark.createDataFrame(rows, "rel_path string, categories array<string>, modified_ms long")
    got = {(r.folder, r.part): r for r in D.rendered(docs, profile="P", max_entries=10).collect()}
    mine = [got["a/b", k + 1] for k in range(got["a/b", 1].parts)]
    assert len(mine) > 1 and all(r.page.count("\n- [") + r.page.startswith("- [") <= 10 for r in mine)
    text = "".join(r.page for r in mine)
    assert all(text.count(f"- [doc-{i:02}](doc-{i:02}.md)\n") == 2 + (i >= 13) for i in range(23))
    assert mine[0].page.startswith("# b\n\n> P · 23 documents · 11 classified · 12 pending\n") and "\n> [Knowledge library](../../index.md) / [a](../index.md) / b\n" in mine[0].page
    assert "### x (11)\n\n" in text and "### Pending classification (12)\n\n" in text and "## Recently updated" in text
    whole = {r.folder: r.page for r in D.rendered(docs, language="zh").collect()}
    assert "## 按标签浏览\n\n### x（11）\n\n- [doc-01](doc-01.md)\n" in whole["a/b"] and "- [**b/**](b/index.md)\n" in whole["a"]


def test_numbered_groups(spark):
    from docpipe.operators.order import numbered

    rows = [(None if k % 7 == 0 else "hot" if k % 3 else f"g{k % 5}", k * 7919 % 1000) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, v long")
    got = numbered(df, ["g"], [F.col("v")]).collect()
    want = {}
    for g, v in sorted(rows, key=lambda x: (str(x[0]), x[1])):
        want.setdefault(g, []).append(v)
    for g, vs in want.items():
        assert [r.v for r in sorted((r for r in got if r.g == g), key=lambda r: r.place)] == vs
        assert sorted(r.place for r in got if r.g == g) == list(range(1, len(vs) + 1))
    assert [r.place for r in sorted(numbered(df, [], [F.col("v"), F.col("g")]).collect(), key=lambda r: r.place)] == list(range(1, 3001))
    assert numbered(df.where("v < 0"), ["g"], [F.col("v")]).count() == 0


def test_assets_of_a_document_are_replaced_whole(spark, tmp_path):
    from docpipe.sources import files as X

    schema, path = "doc_id long, output_path string, relative_path string, bytes binary", str(tmp_path / "assets")
    X.write_assets(spark.createDataFrame([(1, "o/a.md", "x.png", b"1"), (1, "o/a.md", "y.png", b"2"), (2, "o/b.md", "z.png", b"3"), (3, "o/c.md", "w.png", b"4")], schema), path)
    converted = spark.createDataFrame([(1,), (2,), (4,)], "doc_id long")
    X.write_assets(spark.createDataFrame([(1, "o/a.md", "new.png", b"5"), (4, "o/d.md", "q.png", b"6")], schema), path, converted)
    got = sorted((r.doc_id, r.asset_path) for r in X.read_assets(spark, path).collect())
    assert got == [(1, "o/a.assets/new.png"), (3, "o/c.assets/w.png"), (4, "o/d.assets/q.png")]


def test_decision_input_and_category_forms(spark):
    texts = ["---\ncategories: [a, 'b c']\nx: 1\n---\nbody", "---\n- no\n- mapping\n---\nbody", "  \n", None, "plain", "\ufeff---\ncategories:\n  - z\n---\nb"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r.i: r.x for r in df.select("i", V.decision_input(F.col("t"), 100).alias("x")).collect()}
    assert got == {0: "---\nx: 1\n---\nbody", 1: None, 2: None, 3: None, 4: "plain", 5: "\ufeff---\n---\nb"}
    yaml = ["categories: [on, 2020-01-01, 1, ~]", "categories: {a: 1}", "a: &x [p, q]\ncategories: *x", "categories: [a\n"]
    df = spark.createDataFrame(list(enumerate(yaml)), "i long, t string")
    assert {r.i: r.x for r in df.select("i", V.category_list(F.col("t")).alias("x")).collect()} == {0: ["on", "2020-01-01"], 1: [], 2: ["p", "q"], 3: []}


def test_scratch_tables_are_released(spark):
    from docpipe.operators.order import numbered
    from docpipe.sources import tables

    numbered(spark.range(20), [], [F.col("id")]).count()
    held = [*tables._held]
    assert any("/ranges-" in x for x in held)
    tables.release(spark)
    assert not tables._held and not any(tables.folders(spark, x) for x in held)

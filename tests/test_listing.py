import os

import pytest
from pyspark.sql import functions as F

from docpipe.operators.inventory import missing_sources
from docpipe.sources import listing as L
from docpipe.sources.files import scan_files, scan_profiles


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    for name in ("a/b/x.md", "a/.hidden/y.MD", "_under/z.txt", ".dot.md", "noext", "a/b/c/deep.pdf", "sp ace/é%20.html"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("12345")
    (root / "empty/inner").mkdir(parents=True)
    os.symlink(root / "a", root / "link")
    os.symlink(root / "a/b/x.md", root / "a/link.md")
    return root


@pytest.mark.parametrize("splits", [1, 3, 100])
def test_listing(spark, tree, splits):
    rows = L.listed(spark, [("p", str(tree))], splits).collect()
    files = sorted(r.rel_path for r in rows if r.kind == "file")
    assert files == sorted(["a/b/x.md", "a/.hidden/y.MD", "_under/z.txt", ".dot.md", "noext", "a/b/c/deep.pdf", "sp ace/é%20.html"])
    assert {r.rel_path for r in rows if r.kind == "link"} == {"link", "a/link.md"}
    assert {r.rel_path for r in rows if r.kind == "directory"} == {"", "a", "a/b", "a/b/c", "a/.hidden", "_under", "sp ace", "empty", "empty/inner"}
    assert {(r.rel_path, r.entries) for r in rows if r.kind == "directory" and r.rel_path.startswith("empty")} == {("empty", 1), ("empty/inner", 0)}
    by = {r.rel_path: r for r in rows}
    assert by["a/.hidden/y.MD"].ext == "md" and by[".dot.md"].ext == "md" and by["noext"].ext is None and by["a/b/x.md"].size == 5
    assert by["a/b/x.md"].path == f"{tree}/a/b/x.md" and by["a/b/x.md"].modified_ms == os.stat(tree / "a/b/x.md").st_mtime_ns // 10**6
    assert {r.rel_path for r in L.empty_folders(L.listed(spark, [("p", str(tree))])).collect()} == {"empty/inner"}


def test_filter_is_pushed_down(spark, tree):
    rows = L.listed(spark, [("p", str(tree))]).where(F.col("ext").isin("md", "pdf") & (F.col("kind") == "file"))
    assert {r.rel_path for r in rows.collect()} == {"a/b/x.md", "a/.hidden/y.MD", ".dot.md", "a/b/c/deep.pdf"}
    reader = L.ListingReader([("p", str(tree))], 4)
    left = list(reader.pushFilters([L.In(("ext",), ("md",)), L.EqualTo(("kind",), "file"), L.EqualTo(("ext",), "md")]))
    assert left == [L.EqualTo(("kind",), "file")] and reader.wanted == {"md"}
    assert {r[3] for p in reader.partitions() for r in reader.read(p)} == {"a/b/x.md", "a/.hidden/y.MD", ".dot.md", "a/link.md"}


def test_scan_files(spark, tree):
    assert {r.rel_path for r in scan_files(spark, str(tree)).collect()} == {"a/b/x.md", "a/.hidden/y.MD", "_under/z.txt", ".dot.md", "a/b/c/deep.pdf", "sp ace/é%20.html"}
    assert {r.rel_path for r in scan_files(spark, str(tree), ["PDF", "exe"]).collect()} == {"a/b/c/deep.pdf"}
    assert scan_files(spark, "file://" + str(tree), []).count() == 0


def test_a_failing_root_stops_no_other(spark, tree, tmp_path):
    files, roots = scan_profiles(spark, [("good", str(tree)), ("gone", str(tmp_path / "not there")), ("file", str(tree / "noext"))])
    assert files.where("profile_id = 'good'").count() == 6 and files.where("profile_id <> 'good'").count() == 0
    got = {r.profile_id: (r.available, r.error) for r in roots.collect()}
    assert got["good"] == (True, None) and not got["gone"][0] and "not there" in got["gone"][1] and not got["file"][0]


def test_a_folder_that_cannot_be_read_is_a_row(tree, monkeypatch):
    plain = L.entries

    def broken(root, rel):
        if rel == "a/b":
            raise PermissionError("denied: a/b")
        return plain(root, rel)

    monkeypatch.setattr(L, "entries", broken)
    reader = L.ListingReader([("p", str(tree))], 2)
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [(r[3], r[9]) for r in rows if r[4] == "error"] == [("a/b", "denied: a/b")]
    assert "_under/z.txt" in {r[3] for r in rows} and "a/.hidden/y.MD" in {r[3] for r in rows}


def test_what_goes_while_the_job_runs(tree, monkeypatch):
    reader = L.ListingReader([("p", str(tree))], 100)
    parts = reader.partitions()
    os.remove(tree / "a/b/c/deep.pdf")
    os.rmdir(tree / "a/b/c")  # a partition of its own
    plain = L.entries

    def late(root, rel):
        for x in plain(root, rel):
            if x[0] == "z.txt":
                os.remove(tree / "_under/z.txt")  # between its name and its size
            yield x

    monkeypatch.setattr(L, "entries", late)
    rows = [r for p in parts for r in reader.read(p)]
    assert not [r for r in rows if r[4] == "error"] and {r[3] for r in rows if r[4] == "file"} == {"a/b/x.md", "a/.hidden/y.MD", ".dot.md", "noext", "sp ace/é%20.html"}


def drained(spark, path, tmp_path, most=0):
    q = L.changes(spark, path, most).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(processingTime="0 seconds").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return sorted((r.snapshot, r.change, r.rel_path) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_changes_survive_a_restart(spark, tree, tmp_path):
    base = str(tmp_path / "snapshots")
    take = lambda: L.snapshot(spark, base, L.listed(spark, [("p", str(tree))]).where("ext = 'md' or kind = 'error'"))
    assert take() == 0
    first = [(0, "new", p) for p in (".dot.md", "a/.hidden/y.MD", "a/b/x.md", "a/link.md")]
    assert drained(spark, base, tmp_path) == first
    os.remove(tree / ".dot.md")
    (tree / "a/b/x.md").write_text("longer than before")
    (tree / "new.md").write_text("n")
    assert take() == 1
    second = sorted([*first, (1, "gone", ".dot.md"), (1, "changed", "a/b/x.md"), (1, "new", "new.md")])
    assert drained(spark, base, tmp_path) == second
    assert drained(spark, base, tmp_path) == second  # nothing twice
    os.remove(tree / "new.md")
    take()
    (tree / "new.md").write_text("again")
    assert take() == 3
    assert drained(spark, base, tmp_path, most=1) == sorted([*second, (2, "gone", "new.md"), (3, "new", "new.md")])


def test_a_failed_folder_never_looks_like_deletions(spark, tree, tmp_path):
    base = str(tmp_path / "snapshots")
    rows = lambda: L.listed(spark, [("p", str(tree))])
    L.snapshot(spark, base, rows())
    failed = rows().where("not startswith(rel_path, 'a/b/') and rel_path <> '.dot.md'").unionByName(spark.createDataFrame([("p", str(tree), "", "a/b", "error", None, None, None, None, "denied")], L.SCHEMA))
    L.snapshot(spark, base, failed)
    assert [x[1:] for x in drained(spark, base, tmp_path) if x[1] == "gone"] == []  # one batch from nothing: what is there
    held = {r.rel_path for r in L.last_listing(spark, base).collect()}
    assert "a/b/x.md" in held and "a/b/c/deep.pdf" in held and ".dot.md" not in held


def test_missing_sources_of_a_stream(spark, tree, tmp_path):
    base, got = str(tmp_path / "snapshots"), []
    tasks = spark.createDataFrame([("p", ".dot.md", "completed"), ("p", "a/b/x.md", "completed")], "profile_id string, source_path string, status string")
    available = spark.createDataFrame([("p", True)], "profile_id string, available boolean")

    def put(batch, _):
        if batch.where("change = 'gone'").count():
            files = L.last_listing(spark, base).select("profile_id", F.col("rel_path").alias("source_path"))
            got.append(sorted(r.source_path for r in missing_sources(tasks, files, available).collect()))

    L.snapshot(spark, base, L.listed(spark, [("p", str(tree))]))
    q = L.changes(spark, base).writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "at")).start()
    q.processAllAvailable()
    os.remove(tree / ".dot.md")
    L.snapshot(spark, base, L.listed(spark, [("p", str(tree))]))
    q.processAllAvailable()
    q.stop()
    assert got == [[".dot.md"]]

import random

import pytest
from pyspark.sql import functions as F

from docpipe.operators import increment as I
from docpipe.operators import index as X
from docpipe.sources.tables import folders, removed


def docs_of(spark, held):
    return spark.createDataFrame([(p, c, m) for p, (c, m) in held.items()], I.DOCS)


def compare(spark, index, held):
    docs = docs_of(spark, held)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(index.rollup()) == rows(X.folder_rollup(docs))
    assert rows(index.recent()) == rows(X.recent_documents(docs))
    assert rows(index.categories.read()) == rows(X.category_view(docs).select("folder", "category", "documents"))
    assert {(r.rel_path, r.modified_ms) for r in index.docs.read().collect()} == {(p, m) for p, (_, m) in held.items()}


def put(spark, index, held, version, puts, gone=()):
    rows = [(p, c, m, False, 1) for p, (c, m) in puts.items()] + [(p, None, None, True, 1) for p in gone]
    touched = index.apply(spark.createDataFrame(rows, I.CHANGES), version)
    held.update(puts)
    for p in gone:
        held.pop(p, None)
    return {r.folder for r in touched.collect()}


def test_increments_equal_full_build(spark, tmp_path):
    r, held = random.Random(4), {}
    index = I.FolderIndex(spark, str(tmp_path / "at"))
    some = lambda: (r.choice([None, [], ["x"], ["x", "y"]]), r.choice([None, *range(1, 60)]))
    place = lambda: r.choice(["", "a/", "a/b/", "a/b/c/", "d/", "d/e/"])
    put(spark, index, held, 0, {f"{place()}f{k}.md": some() for k in range(120)})
    compare(spark, index, held)
    # Many of the newest go, so lists run dry at several depths; others change and come.
    newest = sorted(held, key=lambda p: -(held[p][1] or 0))
    put(spark, index, held, 1, {p: some() for p in newest[60:70]} | {"n/new.md": some()}, newest[:55])
    compare(spark, index, held)
    put(spark, index, held, 2, {}, [p for p in held if p.startswith("d/")])
    compare(spark, index, held)
    assert put(spark, index, held, 3, {}, ["not/there.md"]) == set()
    compare(spark, index, held)


def test_last_change_of_a_path_holds(spark, tmp_path):
    index = I.FolderIndex(spark, str(tmp_path / "at"))
    rows = [("a/x.md", ["k"], 1, False, 1), ("a/x.md", None, None, True, 2), ("a/y.md", None, None, True, 1), ("a/y.md", ["k"], 5, False, 2)]
    index.apply(spark.createDataFrame(rows, I.CHANGES), 0)
    assert [tuple(x) for x in index.docs.read().collect()] == [("a/y.md", ["k"], 5)]


def test_untouched_parts_are_not_read(spark, tmp_path):
    held, base = {}, str(tmp_path / "at")
    index = I.FolderIndex(spark, base)
    put(spark, index, held, 0, {f"top{k}/in/f{n}.md": (["x"], n) for k in range(30) for n in range(3)})
    touched = spark.createDataFrame([("top3/in/f1.md",)], "rel_path string")
    keep = index.docs.touched(touched)
    for part in index.docs.held()[1]:
        if part not in keep:  # a job that reads them would fail
            removed(spark, f"{base}/docs/v=0/part={part}")
    above = index.folders.touched(spark.createDataFrame([("",), ("top3",), ("top3/in",)], "folder string"))
    for t in ("folders", "categories", "newest"):
        for part in getattr(index, t).held()[1]:
            if part not in above:
                removed(spark, f"{base}/{t}/v=0/part={part}")
    assert put(spark, index, held, 1, {"top3/in/f1.md": ([], 99)}) == {"", "top3", "top3/in"}
    got = {r.folder: (r.documents, r.classified) for r in index.folders.read(above).collect()}
    assert got[""] == (90, 89) and got["top3"] == (3, 2) and got["top3/in"] == (3, 2)
    assert set(folders(spark, f"{base}/docs/v=1")) - {"_SUCCESS"} == {f"part={p}" for p in keep}


def test_touched_pages_equal_a_full_build(spark, tmp_path):
    held = {}
    index = I.FolderIndex(spark, str(tmp_path / "at"))
    put(spark, index, held, 0, {f"{f}d{k}.md": (["c"] if k % 2 else None, k) for k, f in enumerate(["", "a/", "a/b/", "z/"] * 8)})
    touched = put(spark, index, held, 1, {"a/b/new.md": (["c", "d"], 77)}, ["a/d1.md"])
    assert touched == {"", "a", "a/b"}
    now = index.rendered(spark.createDataFrame([(f,) for f in touched], "folder string"), max_entries=10)
    full = X.rendered(docs_of(spark, held), max_entries=10).where(F.col("folder").isin(*touched))
    assert sorted(map(tuple, now.collect())) == sorted(map(tuple, full.collect()))


def test_a_version_again_changes_nothing(spark, tmp_path):
    held = {}
    index = I.FolderIndex(spark, str(tmp_path / "at"))
    put(spark, index, held, 0, {"a/x.md": (["k"], 1)})
    # As if a run had stopped after two of the tables.
    for t in ("folders", "docs"):
        removed(spark, f"{getattr(index, t).base}/manifests/{0:012d}.json")
    put(spark, index, held, 0, {"a/x.md": (["k"], 1)})
    put(spark, index, held, 0, {"a/x.md": (["k"], 1)})
    compare(spark, index, held)


@pytest.mark.parametrize("keep", [1, 2])
def test_cleaning(spark, tmp_path, keep):
    held = {}
    index = I.FolderIndex(spark, str(tmp_path / "at"))
    for v in range(4):
        put(spark, index, held, v, {f"a/x{v}.md": (["k"], v)})
    for t in (index.docs, index.folders, index.categories, index.newest):
        t.clean(keep)
    assert index.folders.manifests() == list(range(4))[-keep:]
    compare(spark, index, held)

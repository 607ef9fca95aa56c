import re
from collections import defaultdict

import duckdb
import pytest

from docpipe.llm import mixing


def shares(sizes, weights, epochs, cap):
    """Targets by rounds: what is above its cap is shared out among the others."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, left = {}, epochs * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in full]
        if not open_:
            return full
        level = left / sum(w[s] for s in open_)
        over = [s for s in open_ if level * w[s] > cap * sizes[s]]
        if not over:
            return full | {s: level * w[s] for s in open_}
        for s in over:
            full[s] = cap * sizes[s]
            left -= full[s]


def check(df, rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    want = shares(sizes, (3, 1, 2), 1.5, 2.0)
    got = df.select("row.doc_id", "row.source", "row.text", "size", "source_size", "target", "copies").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 2
        rate = r.target / r.source_size if r.source_size else 0
        assert int(rate) <= r.copies <= int(rate) + 1


def test_targets_and_copies(odd, documents):
    check(mixing.copies(odd), odd.collect())
    check(mixing.copies(documents), documents.collect())


def test_many_sources_are_joined_by_salt(documents, monkeypatch):
    plain = sorted(mixing.copies(documents).select("row.doc_id", "copies").collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(mixing.copies(documents).select("row.doc_id", "copies").collect()) == plain


def test_mix_keeps_columns_and_reruns_agree(odd, none):
    out = mixing.mix(odd)
    assert out.columns == odd.columns and sorted(map(str, out.collect())) == sorted(map(str, mixing.mix(odd).collect()))
    assert mixing.mix(none).count() == 0 and mixing.mix(none).columns == odd.columns


def test_sql(spark):
    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{d}/documents.parquet'")
    want = {r[0]: r[1:] for r in c.execute(f"select doc_id, size, source_size, target, taken, copies from ({mixing.SQL})").fetchall()}
    assert {r.doc_id: tuple(r)[1:] for r in mixing.query(spark, d).collect()} == want


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "word " * 600_000, "a"), (2, "one two", "b")], "doc_id long, text string, source string")
    got = {r.row.doc_id: (r.size, r.source_size) for r in mixing.copies(docs).collect()}
    assert got == {1: (600_000, 600_000), 2: (2, 2)}

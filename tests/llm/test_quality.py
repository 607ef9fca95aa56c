import math

import numpy as np
import pytest

from docpipe.llm import quality as Q
from tests.llm.conftest import crc


def test_held_out(spark):
    d = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in Q.query(spark, d).collect()}
    labels = spark.read.parquet(f"{d}/labels.parquet").collect()
    held = [(rows[r.doc_id], r.quality) for r in labels if crc(r.doc_id, 5) == 0]
    assert sum(r.predicted == y for r, y in held) / len(held) > 0.98
    assert all(r.held_out == (crc(i, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in rows.items())


def test_interaction_is_learned():
    x = np.random.default_rng(0).random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = Q.Additive(x, y)
    assert ((m.score(x) > 0.5) == y).mean() > 0.9 and any({i, j} == {0, 1} for i, j, _ in m.pairs)


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(0, 1), (5, 0), (None, 1), (99, 0), (6, None)], "doc_id long, quality int")
    for lab in (labels, labels.where("doc_id = 99"), labels.where("quality > 5")):
        model = Q.learn(odd, lab)
        out = Q.scored(odd, model).collect()
        assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert Q.scored(none, model).count() == 0


def test_scores_equal_plain_version(spark, documents):
    """One feature after the other: its bin by comparing with each edge, then the tables' entries."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "quality")
    model = Q.learn(documents, labels)
    assert model.pairs
    got = {r.row.doc_id: r.score for r in Q.scored(documents, model).collect()}
    for r in documents.collect():
        bins = [sum(e <= v for e in edges) for v, edges in zip(Q.features_of(r.text), model.edges, strict=True)]
        total = model.base + sum(float(t[b]) for t, b in zip(model.tables, bins, strict=True)) + sum(float(t[bins[i], bins[j]]) for i, j, t in model.pairs)
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-9)


def test_very_long_text(spark, documents):
    model = Q.learn(documents, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    text = " ".join(f"word{k % 7919}" for k in range(400_000)) + "\n"
    assert 0 <= Q.scored(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first().score <= 1

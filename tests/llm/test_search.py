import math
import random
import re
from collections import Counter

import pytest

from docpipe.llm import search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [x.translate({i: i + 32 for i in range(65, 91)}) for x in TERM.findall(text or "")]


def plain(docs, items, k=10):
    held = [(i, Counter(w)) for i, t in docs if (w := terms(t))]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked, out = {}, []
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    for i, own in asked.items():
        found = []
        for d, c in held:
            m = 10 + (90 * sum(c.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(i, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def fixture():
    r = random.Random(3)
    some = ["the"] * 30 + ["of"] * 20 + [f"w{k}" for k in range(60)] + ["Éa", "9x", "ZZ"]
    docs = [(k, " ".join(r.choices(some, k=r.choice([0, 1, 5, 60])))) for k in range(300)]
    docs += [docs[5], docs[5], (None, docs[7][1]), (None, None), (400, ""), (401, "the " * 40_000 + "w1"), *((500 + k, "w1 w2 same text") for k in range(30))]
    items = [(k, " ".join(r.choices(some, k=r.choice([1, 4, 30])))) for k in range(25)]
    items += [(3, "w5, W6"), (None, "w7 of"), (90, None), (91, "?"), (92, "absent words"), (93, "same same the"), items[0]]
    return docs, items


@pytest.mark.parametrize("shard", [100_000, 7])
def test_equals_plain_version(spark, monkeypatch, shard):
    docs, items = fixture()
    monkeypatch.setattr(S, "SHARD", shard)
    a = spark.createDataFrame([(*x, 1, "clash", 5) for x in docs], "doc_id long, text string, id long, terms string, n long").repartition(3)
    b = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, item string")
    assert sorted((tuple(r) for r in S.ranked(a, b).collect()), key=str) == plain(docs, items)


def test_blocks_of_items(spark, monkeypatch):
    docs, items = fixture()
    monkeypatch.setattr(S, "BLOCK", 40)
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((tuple(r) for r in S.ranked(a, b).collect()), key=str) == plain(docs, items)


def test_accumulators_stop(monkeypatch):
    """Once what remains cannot reach the k-th, a document with frequent terms alone gets no accumulator."""
    import numpy as np
    import pandas as pd

    x = pd.DataFrame({"id": range(50), "none": False, "n": 10, "terms": [[0, 1]] * 10 + [[1]] * 40, "counts": [[3, 1]] * 10 + [[1]] * 40})
    weight, most = np.array([5000, 10]), np.array([10**6, 10**6])
    made = []
    plain_partition = np.partition
    monkeypatch.setattr(np, "partition", lambda a, k: made.append(len(a)) or plain_partition(a, k))
    out = S.scored(x, 10, 50, 500, weight, most, {1: [0, 1]}, {})
    assert sorted(out["id"]) == list(range(10)) and made == [10]


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert S.ranked(documents, none).count() == 0
    assert S.ranked(documents.where("false"), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_odd_rows(spark, odd):
    items = [(1, "quick brown x one")]
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in S.ranked(odd, spark.createDataFrame(items, "item_id long, text string")).collect()), key=str) == plain(docs, items)

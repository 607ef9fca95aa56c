import hashlib
import random
import re

import pytest

from docpipe.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def item_windows(items):
    out = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            out.setdefault("" if i is None else str(i), set()).add(tuple(w[k : k + 10]))
    return out


def plain(docs, items):
    held, out = item_windows(items), []
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for name, all_ in held.items():
            for x in all_:
                for k in range(len(w) - len(x) + 1):
                    if tuple(w[k : k + len(x)]) == x:
                        hit |= set(range(k, k + len(x)))
                        names.add(name)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def fixture():
    r = random.Random(5)
    some = ["a", "b", "c", "the", "ÉA", "É", "x9", "Zed"]
    items = [(k, " ".join(r.choices(some, k=r.choice([1, 3, 9, 10, 11, 25])))) for k in range(12)]
    items += [(3, "another text of item three, with some ten words in it, yes"), (None, "no id but words of its own, one two three four"), (20, None), (21, "  ,;"), items[0]]
    docs = [(k, " - ".join(r.choices(some, k=r.choice([0, 2, 40, 300])))) for k in range(40)]
    docs += [(100 + k, f"before {t} after, {t}") for k, (_, t) in enumerate(items) if t]
    docs += [(None, items[3][1]), (None, None), (7, None), (8, ""), docs[41], docs[41], (200, "z " * 30_000 + items[5][1] + " z" * 30_000)]
    return docs, items


@pytest.mark.parametrize("few", [10**6, 0])
def test_equals_plain_version(spark, monkeypatch, few):
    docs, items = fixture()
    monkeypatch.setattr(D, "FEW", few)  # few: whether all other terms are met at once or one after the other
    wide = spark.createDataFrame([(*x, "clash", 1, 2) for x in docs], "doc_id long, text string, word string, uid long, term long").repartition(3)
    held = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, item string")
    got = sorted((tuple(r) for r in D.contaminated(wide, held).collect()), key=str)
    assert got == plain(docs, items)


def test_blocks_of_windows(spark, monkeypatch):
    docs, items = fixture()
    monkeypatch.setattr(D, "BLOCK", 8)
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert len(D.blocks(b)) > 2
    assert sorted((tuple(r) for r in D.contaminated(a, b).collect()), key=str) == plain(docs, items)


def test_proximity(spark):
    docs = [(1, "one x x two x x three"), (2, "three two one"), (3, "one x x x x x x x two three"), (4, "one two"), (5, "three one two two three")]
    items = [(1, "one two three")]
    index = D.Index(D.numbered(spark.createDataFrame(docs, "doc_id long, text string")), D.blocks(spark.createDataFrame(items, "item_id long, text string"))[0])
    for reach in (1, 2, 3, 6, 20):
        want = set()
        frequency = {w: sum(words(t).count(w) for _, t in docs) for w in ("one", "two", "three")}
        found = index.near(reach).join(index.documents, "uid").select("doc_id", "pos").collect()
        least = min(frequency.values())
        got = {(r.doc_id, r.pos) for r in found}
        options = []
        for rare in [w for w, n in frequency.items() if n == least]:
            want = set()
            for i, t in docs:
                w = words(t)
                for p in [k for k, x in enumerate(w) if x == rare]:
                    if all(any(x == o and abs(p - k) <= reach for k, x in enumerate(w)) for o in frequency):
                        want.add((i, p))
            options.append(want)
        assert got in options


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(documents, none).where("contaminated or n_hit > 0").count() == 0
    assert D.contaminated(documents, none).count() == documents.count()
    assert D.contaminated(documents.where("false"), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, "quick brown fox"), (2, "x x x x x x x x x x")], "item_id long, text string")
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in D.contaminated(odd, items).collect()), key=str)
    assert got == plain(docs, [(1, "quick brown fox"), (2, "x x x x x x x x x x")])

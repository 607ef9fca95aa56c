import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from docpipe.llm import spelling as S

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(docs):
    seen = Counter()
    for i, t in docs:
        for run in RUN.findall(t or ""):
            run = run.translate({k: k + 32 for k in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                seen[run] += 1
    words = {w: n for w, n in seen.items() if n >= 2}
    others = {w: [o for o in words if near(w, o)] for w in words}
    form = {}
    for w, own in others.items():
        best = min(own, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(others[w]), form[w] and words[form[w]]))
    return sorted(out, key=str)


def fixture():
    r = random.Random(11)
    base = ["".join(r.choices("abcéÉn", k=r.choice([6, 7, 8, 9]))) for _ in range(40)] + ["aaaaaaaa", "aaaaaaaaa", "aaaaaaab"]
    pool = []
    for w in base:
        for _ in range(r.choice([1, 2, 5, 40, 450])):
            pool.append(w)
        for _ in range(3):
            k = r.randrange(len(w))
            pool += r.choice([1, 2, 30]) * [r.choice([w[:k] + w[k + 1 :], w[:k] + "x" + w[k:], w[:k] + "y" + w[k + 1 :]])]
    r.shuffle(pool)
    docs = [(k, " ".join(pool[k * 50 : k * 50 + 50])) for k in range(len(pool) // 50 + 1)]
    long_ = "q" * 5000
    docs += [docs[0], (None, "Nullword nullword NULLWORD"), (None, None), (900, ""), (901, f"{long_} {long_} {long_}z {long_}z"), (902, "Straße-Straßen Straßen Straßen ÀÀÀÀÀÀÀ÷ ÀÀÀÀÀÀÀ÷")]
    return docs


@pytest.mark.parametrize("small", [False, True])
def test_equals_plain_version(spark, monkeypatch, small):
    docs = fixture()
    if small:  # many parts and rounds, few edits at once
        monkeypatch.setattr(S, "PART", 4)
        monkeypatch.setattr(S, "ROUND", 3)
        monkeypatch.setattr(S, "EDITS", 500)
        docs = docs[:20] + docs[-6:-2] + docs[-1:]
    wide = spark.createDataFrame([(*x, "clash", 4) for x in docs], "doc_id long, text string, word string, n long").repartition(3)
    assert sorted((tuple(r) for r in S.variants(wide).collect()), key=str) == plain(docs)


def test_filter_never_denies_a_word():
    r = random.Random(2)
    words = sorted({"".join(r.choices("abcdef", k=9)) for _ in range(3000)})
    blocks = {9: -(-len(words) * S.BITS // 64)}
    block, mask = S.places((S.codes(words) * S.powers(9)).sum(axis=1, dtype=np.uint64), blocks[9])
    held = np.zeros(blocks[9], dtype=np.uint64)
    np.bitwise_or.at(held, block.astype(np.int64), mask)
    known = S.Filter({(9, 0): held.tobytes()}, blocks)
    assert known.may_hold((S.codes(words) * S.powers(9)).sum(axis=1, dtype=np.uint64), 9).all()
    other = ["".join(r.choices("ghijkl", k=9)) for _ in range(3000)]
    assert known.may_hold((S.codes(other) * S.powers(9)).sum(axis=1, dtype=np.uint64), 9).mean() < 0.02


def test_empty_and_odd(spark, odd, none):
    assert S.variants(none).count() == 0
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in S.variants(odd).collect()), key=str) == plain(docs)

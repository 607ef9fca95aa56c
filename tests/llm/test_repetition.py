import random

import numpy as np

from docpipe.llm import repetition as R


def brute(w, window, least):
    n = len(w)
    best = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and w[i + k] == w[j + k]:
                k += 1
            best[i] = max(best[i], k)
    five = {p for i in range(n) if best[i] >= window for p in range(i, i + window)}
    span = {p for i in range(n) if best[i] >= least for p in range(i, i + best[i])}
    return [len(five), len(span), max(best, default=0)]


def test_repeats_equal_brute_force():
    random.seed(3)
    texts = [[random.choice([b"a", b"b", b"c", b"d"][: random.randint(1, 4)]) for _ in range(random.randint(0, 50))] for _ in range(120)]
    texts[5] = texts[6]
    assert (R.repeats(texts, 5, 8) == np.array([brute(t, 5, 8) for t in texts])).all()


def test_measures(odd, none):
    rows = {r.row.doc_id: r for r in R.judged(odd).collect() if r.row.doc_id is not None}
    assert rows[9].n_dup_lines == 2 and rows[9].n_words == 14 and rows[8].n_repeat_words == 3000 and rows[8].base_failed and not rows[8].kept
    assert rows[0].kept and not rows[0].base_failed and rows[4].n_words == 0 and rows[4].base_failed
    for r in rows.values():
        words = (r.row.text or "").encode().split()
        assert r.n_words == len(words) and r.word_chars == sum(len(w.decode()) for w in words) and r.n_symbols == sum(x in "#*$%&|<>" for x in r.row.text or "")
        assert r.row.kept is True and r.row.size == 7
    assert R.judged(none).count() == 0


def test_long_single_repeat_is_rejected(spark):
    w = [f"w{i}" for i in range(400)]
    texts = [" ".join(w), " ".join(w + w[:70]), " ".join(w + w[:20])]
    kept = {r.row.doc_id: (r.base_failed, r.kept) for r in R.judged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == {0: (False, True), 1: (True, False), 2: (False, True)}
    big = [f"w{i}" for i in range(4000)]
    assert not R.judged(spark.createDataFrame([(0, " ".join(big + big[:70]))], "doc_id long, text string")).first().kept


def test_long_texts_walk_to_the_same(monkeypatch):
    random.seed(4)
    texts = [[random.choice([b"a", b"b", b"c"]) for _ in range(random.randint(1, 300))] for _ in range(20)] + [[b"x"] * 500]
    want = [R.repeats([t], 5, 8).tolist() for t in texts]
    monkeypatch.setattr(R, "BATCH_WORDS", 0)
    assert [R.repeats([t], 5, 8).tolist() for t in texts] == want


def test_very_long_text(spark):
    text = "x " * 400_000 + " ".join(f"w{k}" for k in range(400_000))
    row = R.judged(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_words, row.n_repeat_words, row.n_covered, row.longest, row.kept) == (800_000, 400_000, 400_000, 399_999, False)

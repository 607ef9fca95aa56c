import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from docpipe.llm import maxent as M
from tests.llm.conftest import crc


def tokens(t):
    return [*(t or "").encode().lower().split(), b""]


def brute(rows):
    c = Counter()
    for r in rows:
        if crc("" if r.doc_id is None else r.doc_id, 7) != 2:
            c.update(tokens(r.text))
    n, v = sum(c.values()), len(c)
    return {r.doc_id: (len(tokens(r.text)), sum(c[w] > 0 for w in tokens(r.text)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(r.text))) for r in rows}


def check(got, want):
    for r in got:
        a, b, c, d = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (a, b, c) and r.base_score == pytest.approx(d, rel=1e-9, abs=1e-9)


def test_base_and_gain(spark):
    rows = M.query(spark, "/root/testdata/sf0.01").collect()
    check(rows, brute(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()))
    held = [r for r in rows if r.held_out]
    n = sum(r.n_tokens for r in held)
    # An interpolated bigram over the same training tokens, 0.4 to 0.6 with the base.
    texts = {r.doc_id: tokens(r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    train = [x for i, x in texts.items() if crc(i, 7) != 2]
    c, after, pairs = Counter(w for x in train for w in x), Counter(), Counter()
    for x in train:
        after.update([None, *x[:-1]])
        pairs.update(zip([None, *x], x))
    bigram = 0.0
    for r in held:
        x = texts[r.doc_id]
        bigram += sum(math.log10(0.4 * pairs[u, w] / max(1, after[u]) + 0.6 * (c[w] + 1) / (sum(c.values()) + len(c) + 1)) for u, w in zip([None, *x], x))
    assert sum(r.score for r in held) / n > bigram / n + 0.25 and bigram > sum(r.base_score for r in held)


def plain_in_context(two, one, word, lasting, learn):
    """By counting one token after the other."""
    n, rows = len(word), []
    counts = []
    for ctx in (two, one):
        pair, total = Counter(), Counter()
        for k in range(n):
            if learn[k]:
                pair[ctx[k], word[k]] += 1
                total[ctx[k]] += 1
        kinds = Counter(c for c, _ in pair)
        counts.append((pair, total, kinds))

    def features(k, less):
        out = []
        for (pair, total, kinds), ctx in zip(counts, (two, one)):
            m, t = pair[ctx[k], word[k]] - less, total[ctx[k]] - less
            d = kinds[ctx[k]] - (less and m == 0)
            size = 0 if t <= 0 else 1 if t == 1 else 2 if t == 2 else 3 if t <= 4 else 4 if t <= 8 else 5
            kind = 0 if d <= 1 else 1 + (d / t >= 0.3) + (d / t >= 0.8)
            out.append((size * 4 + kind, t > 0, m / t if t > 0 else 0.0))
        return (out[0][0], out[1][0]), [out[0][1], out[1][1], True], [out[0][2], out[1][2], lasting[k]]

    weights = {}
    prior = [0.3, 0.3, 0.4]

    def shares(f, has):
        x = [math.exp(y) * h for y, h in zip(weights.setdefault(f, [math.log(y) for y in prior]), has)]
        return [y / sum(x) for y in x]

    for k in range(n):
        if learn[k]:
            rows.append(features(k, 1))
    for _ in range(M.SHARD_STEPS):
        up, expected = {}, {}
        for f, has, inside in rows:
            p = shares(f, has)
            q = [a * b for a, b in zip(p, inside)]
            g, e = up.setdefault(f, [0.0] * 3), expected.setdefault(f, [0.0] * 3)
            for j in range(3):
                g[j] += q[j] / sum(q) - p[j]
                e[j] += p[j]
        for f, g in up.items():
            now = [math.exp(y) for y in weights[f]]
            now = [y / sum(now) for y in now]
            weights[f] = [y + (g[j] + M.PRIOR_TOKENS * (prior[j] - now[j])) / (expected[f][j] + M.PRIOR_TOKENS * now[j]) for j, y in enumerate(weights[f])]
    return [math.log10(sum(a * b for a, b in zip(shares(f, has), inside))) for f, has, inside in (features(k, 0) for k in range(n))]


def test_context_classes_equal_plain_counting():
    r = np.random.default_rng(7)
    word = r.integers(1, 12, 600).astype(np.uint32)
    one, two = np.r_[0, word[:-1]].astype(np.uint32), (np.r_[0, 0, word[:-2]] * 100 + np.r_[0, word[:-1]]).astype(np.uint32)
    learn, lasting = r.random(600) < 0.7, r.random(600) / 10
    got = M.in_context(two, one, word, lasting, learn)
    assert np.allclose(got, plain_in_context(two.tolist(), one.tolist(), word.tolist(), lasting.tolist(), learn.tolist()), atol=1e-4)
    assert np.allclose(M.in_context(two, one, word, lasting, np.zeros(600, dtype=bool)), np.log10(lasting), atol=1e-5)


def test_score_equals_plain_version(spark, documents, monkeypatch):
    monkeypatch.setattr(M, "PARTED", 0)  # contexts of frequent words in one part, as in the plain version
    docs = documents.where("doc_id < 60").withColumn("learned", ~M.held_out(documents["doc_id"]))
    model = M.MaxEnt(docs.where("learned"))
    got = {r.doc_id: r.score for r in model.scored(docs, "learned").collect()}
    texts, w, lexicon = docs.orderBy("doc_id").collect(), M.Weights(model.weights), M.Lexicon(model.head, model.frequent)
    two, one, word, lasting, learn, doc_of = [], [], [], [], [], []
    for r in texts:
        for (h, cls, slot, c), _, doc, _, _ in lexicon.batches(pa.array([r.text], pa.string())):
            lp = M.log_probability(w, h, c, doc, cls, slot) + np.where(slot == 0, np.where(c >= 0, np.log10(np.maximum(c, 0) + 1.0), np.log10(model.far[cls])) - np.log10(model.shared[cls]), 0)
            h = [0, 0, *h.tolist()]
            word += h[2:]
            one += h[1:-1]
            two += list(zip(h, h[1:-1]))
            lasting += (10.0**lp).tolist()
            learn += [r.learned] * len(lp)
            doc_of += [r.doc_id] * len(lp)
    want = Counter()
    for d, lp in zip(doc_of, plain_in_context(two, one, word, lasting, learn)):
        want[d] += lp
    assert all(got[d] == pytest.approx(want[d], rel=2e-3, abs=0.1) for d in got) and len(got) == len(texts)


def test_shards_and_parts(documents, monkeypatch):
    monkeypatch.setattr(M, "SHARD_TOKENS", 2_000)
    monkeypatch.setattr(M, "DEALT_TOKENS", 5_000)
    docs = documents.withColumn("learned", ~M.held_out(documents["doc_id"]))
    model = M.MaxEnt(docs.where("learned"))
    got = model.scored(docs, "learned").collect()
    check(got, brute(documents.collect()))
    beside = {r.doc_id: r.score for r in model.scored(docs.select("doc_id", "text").where("doc_id % 10 = 0")).collect()}
    assert len(beside) > 5 and all(r.score < 0 for r in got)


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "one two three four five " * 120_000), (2, "one two three")], "doc_id long, text string")
    got = {r.doc_id: r for r in M.MaxEnt(docs).scored(docs).collect()}
    assert got[1].n_tokens == 600_001 and got[1].score > got[1].base_score


def test_rare_words_meet_their_counts(documents, monkeypatch):
    monkeypatch.setattr(M, "FREQUENT", 50)
    train = documents.where(~M.held_out(documents["doc_id"]))
    check(M.MaxEnt(train).scored(documents.select("doc_id", "text")).collect(), brute(documents.collect()))


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    w = M.Weights(rng.normal(size=M.SIZE).astype(np.float32))
    h, n, doc = np.array([5, 6, 7]), np.array([9, -1, 4]), np.zeros(3, dtype=np.int64)
    total = sum(10 ** M.log_probability(w, h, n, doc, np.full(3, c), np.full(3, s)) for c in range(M.CLASSES) for s in (0, *range(M.MEMBERS, M.PLACES)))
    a, _, _ = M.context(h, n, doc, np.zeros(3, dtype=np.int64), np.zeros(3, dtype=np.int64))
    assert total == pytest.approx(1, rel=1e-4) and np.allclose(M.soft(w.c, w.cb, a).sum(axis=1), 1, atol=1e-5)


def test_gradients_are_summed_by_row():
    r = np.random.default_rng(3)
    for n in (0, 1, 9, 3_000):
        rows = np.r_[np.minimum(r.zipf(1.5, n), 70_000), r.integers(0, 900, n)].astype(np.int64)
        g = r.normal(size=(2 * n, 16)).astype(np.float32)
        met, sums = M.summed(rows, g)
        want = np.zeros((70_001, 16))
        np.add.at(want, rows, g)
        assert met.tolist() == np.unique(rows).tolist() and np.allclose(sums, want[met], atol=1e-3)


def test_words_of_a_shard_are_looked_up_once(monkeypatch):
    calls = []

    class Counting:
        def __getattr__(self, name):
            calls.append(name)
            return getattr(pc, name)

    monkeypatch.setattr(M, "pc", Counting())
    lists = [pa.array(x, pa.binary()) for x in ([b"a", b"z"], [], [b"b", b"", b"a"])]
    got = M.looked_up(lists, pa.array([b"b", b"a", b""], pa.binary()), np.array([5, 7, 9]))
    assert [x.tolist() for x in got] == [[7, 0], [], [5, 9, 7]] and calls.count("index_in") == 1


def test_contexts_in_few_bytes():
    x = np.array([7, 7, 1 << 31, 3, 7, 3], dtype=np.uint32)
    known, at = M.by_frequency(x)
    assert known.tolist() == [7, 3, 1 << 31] and known[at].tolist() == x.tolist()
    assert M.whole(M.planes(x, 4), 4).tolist() == x.tolist()


def test_split_matches_python():
    texts = ["", None, " A b\x0bC\x0c ", "É é\x1cx", "x  y\n"]
    full, sizes = M.split(pa.array(texts))
    words = full.dictionary.cast(pa.binary()).take(full.indices).to_pylist()
    assert words == [w for t in texts for w in tokens(t)[:-1]] and sizes.tolist() == [len(tokens(t)) - 1 for t in texts]


def test_odd_rows(spark, odd, none):
    ids = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    check(M.MaxEnt(odd.where(~M.held_out(odd["doc_id"]))).scored(odd.select("doc_id", "text")).where("doc_id is not null").collect(), brute(odd.collect()))
    assert M.MaxEnt(odd).scored(none.select("doc_id", "text")).count() == 0
    out = M.MaxEnt(none).scored(ids.select("doc_id", "text")).collect()
    assert len(out) == ids.count() and all(r.n_known == 0 and r.base_score == 0 for r in out)


def test_factors_equal_sums_of_weights():
    r = np.random.default_rng(5)
    flat = r.normal(size=M.SIZE).astype(np.float32)
    h, c, cls, place = r.integers(2, 50, 5_000), r.integers(-1, 9, 5_000), r.integers(0, M.CLASSES, 5_000), r.integers(M.MEMBERS, M.PLACES, 5_000) * r.integers(0, 2, 5_000)
    by_sums = M.Weights(flat.copy())
    by_sums.factors = None
    args = h, c, np.repeat(np.arange(50), 100), cls, place
    assert M.Weights(flat).factors is not None and np.allclose(M.log_probability(M.Weights(flat), *args), M.log_probability(by_sums, *args), atol=1e-5)
    flat[7] = M.LARGE + 1  # products may not fit
    assert M.Weights(flat).factors is None and np.isfinite(M.log_probability(M.Weights(flat), *args)).all()


def test_rows_with_many_gradients():
    r = np.random.default_rng(4)
    size = np.r_[1, 2, 3, M.MANY - 1, M.MANY, M.MANY + 1, 3_000, np.ones(40)].astype(np.int64)
    rows = r.permutation(np.repeat(np.arange(len(size)) * 3, size))
    g = r.normal(size=(len(rows), 16)).astype(np.float32)
    want, room = np.zeros((3 * len(size), 16)), M.Room()
    np.add.at(want, rows, g)
    for _ in range(2):  # the second time in the same memory
        met, sums = M.summed(rows, g, room)
        assert met.tolist() == np.unique(rows).tolist() and np.allclose(sums, want[met], atol=1e-3)


def test_a_shards_share_of_what_is_dealt_does_not_shrink():
    shares = [M.held_tokens(shards) / shards for shards in (1, 24, 116, 500, 1_000, 4_000)]
    assert min(shares) >= M.SHARE_TOKENS and M.held_tokens(116) == M.DEALT_TOKENS and M.held_tokens(100_000) == M.DEALT_MOST[0]


def test_texts_are_dealt_over_batches(documents, monkeypatch):
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", documents.sparkSession.conf
    rows = conf.get(key)
    monkeypatch.setattr(M, "SHARD_TOKENS", 2_000)
    docs = documents.withColumn("learned", ~M.held_out(documents["doc_id"]))
    model = M.MaxEnt(docs.where("learned"))
    conf.set(key, "7")
    out = []
    for most in ((1, 1), (4_000_000, 20_000)):  # each run of texts on its own, or all together
        monkeypatch.setattr(M, "DEALT_TOKENS", most[0])
        monkeypatch.setattr(M, "DEALT_MOST", most)
        got = model.scored(docs, "learned").collect()
        check(got, brute(documents.collect()))
        out.append({x.doc_id: x.score for x in got})
    assert out[0].keys() == out[1].keys() and all(out[0][k] == pytest.approx(out[1][k], rel=1e-5) for k in out[0])
    conf.set(key, rows)

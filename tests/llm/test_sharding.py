import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from docpipe.llm import sharding as S


def least_capacity(sizes, shards):
    """By trying: a shard holds what fits, or one group."""

    def need(c):
        n, have = 0, None
        for x in sizes:
            if have is not None and have + x <= c:
                have += x
            else:
                n, have = n + 1, x
        return n

    low, high = 1, sum(sizes)
    while low < high:
        c = (low + high) // 2
        low, high = (low, c) if need(c) <= shards else (c + 1, high)
    return low


def check(docs, shards):
    rows = docs.collect()
    got = S.shard(docs, shards).collect()
    size = lambda t: len((t or "").encode()) + 8
    key = lambda t: b"" if t is None else hashlib.md5(t.encode()).digest()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r.doc_id, size(r.text), zlib.crc32((r.text or "").encode())) for r in rows)
    slots, bytes_, where = defaultdict(list), Counter(), {}
    text = {r.doc_id: r.text for r in rows}
    for r in got:
        slots[r.shard].append(r.slot)
        bytes_[r.shard] += r.size
        assert where.setdefault(text[r.doc_id], r.shard) == r.shard
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(shards))
    groups = Counter()
    for r in rows:
        groups[key(r.text)] += size(r.text)
    sizes = [groups[k] for k in sorted(groups)]
    assert max(bytes_.values()) == max(least_capacity(sizes, shards), max(sizes)) or max(bytes_.values()) == least_capacity(sizes, shards)


def test_documents(documents):
    check(documents, 24)


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_hot_group(spark, shards):
    rows = [(i, "hot text " * 20 if i % 3 == 0 else f"text {i} " * (i % 17)) for i in range(120)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), shards)


def test_odd_rows(odd, none):
    check(odd, 4)
    assert S.shard(none).count() == 0


def test_query(spark):
    q = S.query(spark, "/root/testdata/sf0.001")
    assert q.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def test_jobs_do_not_grow_with_shards(spark, documents):
    sc = spark.sparkContext
    sc.setJobGroup("sharding", "sharding")
    S.shard(documents, 24)
    jobs = sc.statusTracker().getJobIdsForGroup("sharding")
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(jobs) < 10


def test_blocks_are_opened_step_by_step(documents, monkeypatch):
    monkeypatch.setattr(S, "DIGITS", 1)
    monkeypatch.setattr(S, "FETCHED", 20)
    check(documents, 24)


def test_repeated_rows_and_ids(spark):
    rows = [(1, "same text")] * 2500 + [(None, "same text")] * 300 + [(None, None)] * 40 + [(2, "other"), (2, "another"), (3, "z" * 2_000_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.shard(docs, 5).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())

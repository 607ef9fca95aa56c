import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from docpipe.llm import tokens as T

RANKS = T.read_ranks(P.path("byte_bpe_50k.tiktoken"))
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_words_equal_the_library():
    random.seed(5)
    words = T.Words(P.PATTERN, RANKS)
    letters = " \n\t'sdlve reABC012éß中文" + "".join(map(chr, (0xA0, 0x2003, 0x3000, 0x1C, 0x85, 0xB2, 0x2167))) + "_-!?.,"
    for _ in range(3000):
        t = "".join(random.choice(letters) for _ in range(random.randint(0, 40)))
        assert np.frombuffer(words.encode(t), "<u4").tolist() == THEIRS.encode_ordinary(t), t


def expected(t):
    ids = THEIRS.encode_ordinary(t or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()


def check(spark, docs):
    got = T.digest(spark, docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(text[r.doc_id])


def test_odd_rows(spark, odd, none):
    check(spark, odd)
    check(spark, none)
    bpe = T.Bpe(spark, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert bpe.encode(odd).select("row.*").columns == odd.columns


@pytest.mark.parametrize(("long", "step", "overlap"), [(40, 30, 12), (100, 64, 20)])
def test_stitched_chunks(spark, documents, monkeypatch, long, step, overlap):
    for k, v in (("LONG", long), ("STEP", step), ("OVERLAP", overlap)):
        monkeypatch.setattr(T, k, v)
    check(spark, documents.where("length(text) < 3000"))
    rows = [(0, "a" * 500), (1, "\n\n\n word" * 60), (2, "don't   stop\n\n\n\n" * 30), (3, " " * 300 + "x"), (4, "é中" * 200 + " tail of words here")]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string"))


def test_decode_is_the_inverse(spark, documents):
    bpe = T.Bpe(spark, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rows = bpe.encode(documents).withColumn("back", bpe.decode(F.col("ids"))).select("row.text", "back").collect()
    assert len(rows) == documents.count() and all(bytes(r.back).decode() == r.text for r in rows)




def test_very_long_text(spark):
    words = [f"w{k * k % 9973}é" for k in range(250_000)]
    check(spark, spark.createDataFrame([(1, " ".join(words) + "\n" + "x" * 300_000), (2, "short")], "doc_id long, text string"))


def test_a_long_text_takes_time_in_proportion(spark):
    import time

    bpe = T.Bpe(spark, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)

    def took(mb):
        docs = spark.range(1).select(F.lit(1).alias("doc_id"), F.repeat(F.lit("some words, and a few more of them; 12 "), mb * (1 << 20) // 39).alias("text"))
        docs, _ = T.written(docs, "long-text")
        began = time.perf_counter()
        n = bpe.encode(docs).select((F.octet_length("ids") / 4).cast("long").alias("n")).first()["n"]
        return time.perf_counter() - began, n

    took(2)  # starts workers and memories
    (a, n), (b, m) = took(12), took(48)
    assert b < 4 * a and abs(m - 4 * n) < 100

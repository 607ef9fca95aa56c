import re

import corpus_pipeline as C
import public_tokenizers as P

from docpipe.llm import jaccard, language, mixing, repetition
from tests.llm.test_jaccard import brute
from tests.llm.test_tokens import expected


def test_stages_keep_columns(spark, odd):
    docs = odd
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == odd.columns, name
        docs = spark.createDataFrame(docs.collect(), odd.schema)
    assert C.STAGES[-1][1](spark, docs, "").count() == docs.count()


def test_pipeline_equals_plain_version(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = language.learn(docs.select("doc_id", "text", "lang"))
    score = language.Scorer(model).score
    import pandas as pd

    p = score(pd.Series([r.text for r in rows.values()]))
    left = [i for i, a, b in zip(rows, p["lang_pred"], p["score"], strict=True) if a != "und" and b >= C.LEAST_SCORE]
    m = repetition.measures(pd.Series([rows[i].text for i in left]), 5, 8)
    ok = (m.n_words >= 10) & (100 * m.n_repeat_words <= 20 * m.n_words) & (m.n_covered <= 0.2 * m.n_words) & (m["longest"] <= 60)
    left = [i for i, k in zip(left, ok, strict=True) if k]
    left = [i for i, _, c in brute([(i, rows[i].text) for i in left]) if i == c]
    taken = {r.row.doc_id: r.copies for r in mixing.copies(docs.where(docs["doc_id"].isin(left))).collect()}
    want = sorted((i, *expected(rows[i].text)) for i in left for _ in range(taken[i]))
    assert sorted(map(tuple, C.run(spark, d).collect())) == want
    assert [n for n, _ in C.STAGES] == ["language_id", "quality_rules", "near_duplicates", "source_mixing", "byte_bpe"]


def test_clean_documents_stay(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    left = {r.doc_id for r in C.quality_rules(spark, C.language_id(spark, docs, d), d).collect()}
    clean = [r.doc_id for r in docs.collect() if labels.get(r.doc_id) == 1 and len(re.findall(r"\S+", r.text)) >= 10]
    assert len([i for i in clean if i in left]) >= 0.99 * len(clean)
    assert jaccard.THRESHOLD == 0.8 and P.PATTERN


def test_an_id_with_different_texts_and_a_very_long_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars between 500 and 3000")
    rows = docs.orderBy("doc_id").limit(40).collect()
    schema = docs.schema
    long = " ".join(f"{w}{k}" if k % 3 else w for k, w in enumerate(" ".join(r.text for r in rows).split() * 40))
    again = [(rows[0].doc_id, rows[1].text + " so it goes", *rows[0][2:]), (rows[2].doc_id, rows[3].text, *rows[2][2:]), tuple(rows[5]), tuple(rows[5]), (10**6, long, "en", "src0", len(long))]
    left = spark.createDataFrame([tuple(r) for r in rows] + again, schema)
    seen = []
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, left, "").collect()
        assert left.columns == docs.columns
        seen.append(out)
        left = spark.createDataFrame(out, schema)
    assert len(C.STAGES[-1][1](spark, left, "").collect()) == len(seen[-1])
    kept = {(r.doc_id, r.text) for r in seen[2]}
    assert len(kept) == len(seen[2]) and len({r.text for r in seen[2]}) == len(seen[2])

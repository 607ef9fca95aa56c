import math

import pandas as pd
import pytest

from docpipe.llm import language
from tests.llm.conftest import crc


def test_held_out_accuracy(spark):
    rows = language.query(spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and all(r.held_out == (crc(r.doc_id, 4) == 2) for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_backoff():
    rows = [("de", 0, "haus", 8), ("en", 0, "house", 8), ("de", 2, "au", 8), ("en", 2, "ou", 8), ("de", 1, "z", 1), ("en", 1, "w", 1)]
    m = language.Model(pd.DataFrame(rows, columns=["lang", "n", "unit", "count"]))
    de = lambda w: m.word(w)[0] - m.word(w)[1]
    assert de("haus") > 0 > de("house") and de("maul") > 0 > de("soul") and de("zzz") > 0 > de("www") and de("qqq") == 0


def test_odd_rows(odd, none):
    model = language.learn(odd)
    got = {r.row.doc_id: r for r in language.identified(odd, model).collect() if r.row.doc_id is not None}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (2, 3, 4)) and got[0].lang_pred in ("en", "de")
    assert language.identified(none, model).count() == 0
    empty = language.learn(none)
    assert {r.lang_pred for r in language.identified(odd, empty).collect()} == {"und"}


def plain(model, text):
    """One word after the other: its row of log frequencies, or the mean of its longest known n-grams."""
    found = [w for w in language.words(text) if w]
    if not any(c.isalpha() for c in text or "") or not found or not model.langs:
        return "und", 0.0
    total = [0.0] * len(model.langs)
    for w in found:
        rows = []
        if w in model.units[0]:
            rows = [model.rows[model.units[0][w]]]
        for n in range(language.LONGEST_GRAM, 0, -1):
            rows = rows or [model.rows[model.units[n][g]] for g in language.grams(w, n) if g in model.units[n]]
        for k in range(len(total)):
            total[k] += sum(float(r[k]) for r in rows) / max(1, len(rows))
    x = [math.exp(t / len(found) * math.log(10) * min(len(found), language.SURE_WORDS)) for t in total]
    best = max(range(len(x)), key=lambda k: (x[k], -k))
    return model.langs[best], x[best] / sum(x)


def test_scores_equal_plain_version(documents):
    model = language.learn(documents.where(~language.held_out(documents["doc_id"])))
    texts = [r.text for r in documents.where("n_chars < 3000").limit(60).collect()] + ["", None, "12 34", "Haus maison 3", "ß", "a½"]
    got = language.Scorer(model).score(pd.Series(texts, dtype=object))
    for text, lang, score in zip(texts, got["lang_pred"], got["score"], strict=True):
        want = plain(model, text)
        assert lang == want[0] and score == pytest.approx(want[1], rel=1e-3)


def test_texts_without_a_letter(spark, documents):
    model = language.learn(documents)
    texts = ["½ ½ ½ ½ ½", "² ³", "½ " * 500, "１２３ ४५६ " * 30, "_ _ _ _ _", "🙂 🙂 🙂 🙂 🙂", "½ ½ ½ ½ ½ die"]
    rows = language.identified(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    got = {r.row.doc_id: (r.lang_pred, r.score) for r in rows}
    assert all(got[i] == ("und", 0.0) for i in range(6)) and got[6][0] != "und"


def test_many_labels(spark, documents, monkeypatch):
    junk = spark.range(400).selectExpr("id + 100000 as doc_id", "concat('some words of label ', id) as text", "concat('junk', id) as lang")
    monkeypatch.setattr(language, "MOST_LANGUAGES", 300)
    monkeypatch.setattr(language, "MOST_UNITS", 100_000)
    model = language.learn(documents.select("doc_id", "text", "lang").union(junk))
    assert len(model.langs) == 300 and {"de", "en", "es", "fr"} <= set(model.langs)
    rows = language.identified(documents.select("doc_id", "text", "lang"), model).collect()
    assert sum(r.lang_pred == r.row.lang for r in rows) > 0.9 * len(rows)


def test_very_long_text(spark, documents):
    model = language.learn(documents)
    text = " ".join(r.text for r in documents.where("lang = 'fr'").collect())
    row = language.identified(spark.createDataFrame([(1, (text + " ") * (1 + 3_000_000 // len(text)))], "doc_id long, text string"), model).first()
    assert row.lang_pred == "fr" and row.score > 0.9

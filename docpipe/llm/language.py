"""Language identification by words first, then by ever shorter character n-grams.

A language's model is the log frequency of its words and of the character n-grams of its words, learned from a sample of
labelled texts whose size for each language is bounded by a parameter. A text's score in a language is the mean over
its words: a known word counts by its log frequency; an unseen word counts by its longest n-grams of which any is known,
as the mean over the known ones. The best language wins; the score is its share after softmax over the languages.

Cases: null and texts without a letter, of whatever length, get `und` and score 0; rows without a label teach nothing;
beyond MOST_LANGUAGES labels those of the fewest texts are not learned; with no labelled row at all every text gets `und`;
very long texts count whole, as all texts do; ties go to the first language in code-point order; repeated rows are judged
each; an empty table gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docpipe.llm.common import crc_mod, give_back, table, text_batches

#: Labelled texts to learn a language from, about (chosen by a hash of the id).
SAMPLE = 6_000
#: Words and n-grams of each length kept for a language, the most frequent first.
KEEP_WORDS, KEEP_GRAMS, LONGEST_GRAM = 30_000, 6_000, 5
#: Languages that one model learns, those of the most labelled texts, and units of all languages, shared by labelled texts.
MOST_LANGUAGES, MOST_UNITS = 1_000, 1_000_000
#: Occurrences of other units that every language is thought to have besides, so that one of little text is not sure of it.
FEW = 1_000
#: Words whose scores a worker remembers.
MEMORY = 100_000
#: Texts whose words are held at once.
RUN = 256
#: Words up to which more words make a surer score.
SURE_WORDS = 25

find_words = re.compile(r"[^\W\d_]+").findall
find_words_in = re.compile(r"[^\W\d_]+").finditer


def has_letter(text: str) -> bool:
    """Whether a text has a letter; the first character of words mostly tells."""
    return any(x.isalpha() for m in find_words_in(text) for x in m[0])


def words(text: str | None) -> list[str]:
    return find_words(text.lower()) if text else []


def grams(word: str, n: int) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + n] for i in range(len(w) - n + 1)] or [w]


class Model:
    """Log frequencies of units by language. rows: (lang, n, unit, count); n is 0 for words."""

    def __init__(self, rows: pd.DataFrame):
        self.langs = sorted(rows["lang"].unique())
        k = {x: i for i, x in enumerate(self.langs)}
        total = np.zeros((LONGEST_GRAM + 1, max(1, len(self.langs))))
        for lang, n, c in zip(rows["lang"], rows["n"], rows["count"], strict=True):
            total[n, k[lang]] += c
        #: By n, the row of a unit; a row is the log10 of the relative frequency in each language, of half an occurrence where there is none.
        self.units: list[dict[str, int]] = [{} for _ in range(LONGEST_GRAM + 1)]
        for n, unit in zip(rows["n"], rows["unit"], strict=True):
            self.units[n][unit] = 0
        at = 0
        for known in self.units:
            for unit in known:
                known[unit] = at
                at += 1
        self.rows = np.empty((at, len(self.langs)), dtype=np.float32)
        for n, known in enumerate(self.units):
            self.rows[list(known.values())] = np.log10(0.5 / (total[n].max() + FEW))  # the same in all languages: little text is no evidence
        for lang, n, unit, c in zip(rows["lang"], rows["n"], rows["unit"], rows["count"], strict=True):
            self.rows[self.units[n][unit], k[lang]] = np.log10(c / (total[n, k[lang]] + FEW))

    def word(self, w: str) -> np.ndarray:
        if (i := self.units[0].get(w)) is not None:
            return self.rows[i]
        for n in range(LONGEST_GRAM, 0, -1):
            if known := [i for g in grams(w, n) if (i := self.units[n].get(g)) is not None]:
                return self.rows[known].mean(axis=0)
        return np.zeros(len(self.langs), dtype=np.float32)


class Scorer(dict):
    """Numbers of words, whose scores are rows of a matrix."""

    def __init__(self, model: Model):
        self.model = model
        self.rows = np.empty((4096, len(model.langs)), dtype=np.float32)

    def __missing__(self, w: str) -> int:
        i = len(self)
        if i >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        self.rows[i] = self.model.word(w)
        self[w] = i
        return i

    def score(self, texts: pd.Series) -> pd.DataFrame:
        langs = self.model.langs
        found = [words(t) for t in texts]
        size = np.array([len(x) for x in found], dtype=np.int64)
        lang, score = np.full(len(found), "und", dtype=object), np.zeros(len(found))
        some = np.flatnonzero(size)
        if len(some) and langs:
            if len(self) > MEMORY:
                self.clear()
            ids = np.fromiter(map(self.__getitem__, chain.from_iterable(found)), dtype=np.int64, count=int(size.sum()))
            sums = np.empty((len(some), len(langs)))
            first = np.r_[0, size[some].cumsum()[:-1]]
            for k in range(len(langs)):
                sums[:, k] = np.add.reduceat(self.rows[ids, k].astype(np.float64), first)
            x = sums * (np.log(10) * np.minimum(size[some], SURE_WORDS) / size[some])[:, None]
            x = np.exp(x - x.max(axis=1, keepdims=True))
            best = x.argmax(axis=1)
            lang[some] = np.array(langs, dtype=object)[best]
            score[some] = x.max(axis=1) / x.sum(axis=1)
            for i in some:  # digits of other scripts look like words
                if not has_letter(texts.iloc[i]):
                    lang[i], score[i] = "und", 0.0
        return pd.DataFrame({"lang_pred": lang, "score": score})


def rooms(sizes: dict[str, int], sample: int) -> dict[str, float]:
    """The share of its units that each language keeps: all of them where they fit, else the languages share by their sampled texts.

    What the largest cannot use goes to the next, so that junk labels of a few texts take little from the others.
    """
    whole, texts = KEEP_WORDS + LONGEST_GRAM * KEEP_GRAMS, {k: min(v, sample) for k, v in sizes.items()}
    left, out, weight = MOST_UNITS / whole, {}, float(sum(texts.values()))
    for k, v in sorted(texts.items(), key=lambda x: (-x[1], x[0])):
        out[k] = min(1.0, left * v / weight)
        left, weight = left - out[k], weight - v
    return out


def learn(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of labelled (doc_id, text, lang). Only the sample's counts, of bounded size, come to the driver."""
    text_batches(labelled.sparkSession)
    labelled = labelled.where("lang is not null and text is not null")
    sizes = {x["lang"]: x["count"] for x in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()}
    if not sizes:
        return Model(pd.DataFrame({"lang": [], "n": [], "unit": [], "count": []}))
    labelled = labelled.where(F.col("lang").isin(list(sizes)))
    by_lang = lambda values: F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("lang"))
    share = by_lang({k: min(1.0, sample / v) for k, v in sizes.items()})
    draw = F.pmod(F.xxhash64(F.lit("language"), F.col("doc_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for low in range(0, len(x), 4 * RUN):
                by: dict[str, Counter] = defaultdict(Counter)
                for lang, text in zip(x["lang"].iloc[low : low + 4 * RUN], x["text"].iloc[low : low + 4 * RUN], strict=True):
                    by[lang].update(words(text))
                for lang, c in by.items():
                    yield pd.DataFrame({"lang": lang, "unit": list(c), "count": list(c.values())})

    known = labelled.where(draw < share).select("lang", "text").mapInPandas(count, "lang string, unit string, count long").groupBy("lang", "unit").agg(F.sum("count").alias("count"))
    # The n-grams of a word count as often as the word.
    padded = F.concat(F.lit("^"), F.col("unit"), F.lit("$"))

    def cut(n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1)))
        return F.transform(places, lambda i: F.struct(F.lit(n).alias("n"), F.substring(padded, i, F.lit(n)).alias("unit")))

    units = known.select("lang", "count", F.explode(F.flatten(F.array(F.array(F.struct(F.lit(0).alias("n"), F.col("unit"))), *[cut(n) for n in range(1, LONGEST_GRAM + 1)]))).alias("u"))
    units = units.groupBy("lang", "u.n", "u.unit").agg(F.sum("count").alias("count"))
    rank = F.row_number().over(Window.partitionBy("lang", "n").orderBy(F.desc("count"), "unit"))
    room = by_lang(rooms(sizes, sample))
    kept = units.withColumn("rank", rank).where((F.col("rank") <= KEEP_GRAMS * room) | (F.col("n") == 0) & (F.col("rank") <= KEEP_WORDS * room))
    return Model(kept.select("lang", "n", "unit", "count").toPandas())


def identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Rows (row: all of docs' columns, lang_pred, score)."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the numbers of units kept

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for x in batches:
            for k in range(0, len(x), RUN):
                yield scorer.score(x.iloc[k : k + RUN])
            give_back()

    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text].alias("t"))
    return rows.select("row", F.pandas_udf(predict, "lang_pred string, score double").asNondeterministic()("t").alias("p")).select("row", "p.*")


def held_out(doc_id: Column) -> Column:
    return crc_mod(doc_id, 4) == 2


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    out = identified(docs.select("doc_id", "text"), model)
    return out.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")

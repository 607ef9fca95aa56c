"""Ranked lexical search, term at a time, with a limit on accumulators.

The texts are read once into a table of postings: for each document its length and the query terms it holds with their
counts. From it come the corpus' numbers (N, L, df), the largest part of its weight that each term gives anywhere, and, from
each item's rarest terms alone, the k-th best partial score over the whole corpus: a document has to reach that at least.
Then shards of documents are scored apart. In a shard an item's terms are taken from the rarest on; a term's postings create
accumulators and add to them; once the terms that remain can give no new document the k-th partial score (the corpus' or the
shard's, whichever is higher), no accumulator is created any more, and those that exist are updated to their exact score.
Each shard gives its k best, of which the k best of all are the result.

Items are taken in blocks of bounded size, so the terms that are broadcast are bounded for any set of items.

Cases: null and empty texts have no terms and no rank, and count neither in N nor in L; items without terms, or whose terms
no document holds, have no rows; rows of one item id are one item with the terms of all, and so are those of a null id; a
very long text is one document, scored whole; repeated documents rank each; equal scores go by id, rows without an id last;
empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docpipe.llm.common import LOWER, UPPER, give_back, lower_ascii, removed, table, text_batches, written
from docpipe.llm.decontamination import words

K = 10
#: Distinct (item, term) pairs of a block of items; documents and postings of a shard.
BLOCK, SHARD, SHARD_POSTINGS = 200_000, 16_384, 2_000_000
#: ASCII bytes as terms have them: A-Z lower-cased, what separates terms a blank.
FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def length_part(n, docs: int, total: int):
    """A document's m, of its number of terms."""
    return 100 - 90 + (90 * n * docs) // total


def item_terms(items: DataFrame) -> DataFrame:
    """Rows (item, item_id, term) of items (item_id, text): the distinct terms of each id; item is a number."""
    each = items.select("item_id", F.explode(F.transform(words(F.col("text")), lower_ascii)).alias("term")).distinct()
    known = each.groupBy("item_id").agg(F.collect_list("term").alias("terms")).select(F.monotonically_increasing_id().alias("item"), "item_id", "terms")
    return known.select("item", "item_id", F.explode("terms").alias("term"))


def postings(docs: DataFrame, terms: list[str]) -> tuple[DataFrame, str]:
    """Rows (id, n, terms, counts) of docs (doc_id, text) with a term: its number of terms, and the given ones it holds, by their place in the list."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast({t.encode(): i for i, t in enumerate(terms)})

    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for x in texts:
            out = []
            for t in x:
                all_ = (t or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
                held = [(known[w], c) for w, c in Counter(all_).items() if w in known]
                out.append((len(all_), [a for a, _ in held], [c for _, c in held]))
            yield pd.DataFrame(out, columns=["n", "terms", "counts"])
            give_back()

    held = F.pandas_udf(counted, "n long, terms array<int>, counts array<long>").asNondeterministic()("text")
    return written(docs.select(F.col("doc_id").cast("long").alias("id"), held.alias("x")).select("id", "x.*").where("n > 0"), "postings")


class Query:
    """The items of a block against postings: numbers of the corpus, bounds and thresholds."""

    def __init__(self, items: DataFrame, stored: DataFrame, terms: list[str], k: int):
        """items: rows (item, term: its place in terms), a block's."""
        self.stored, self.k = stored, k
        spark = stored.sparkSession
        first = stored.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
        self.docs, self.total = first["docs"], first["total"]
        held = stored.withColumn("m", F.expr(f"10 + (90 * n * {self.docs}L) div {max(self.total, 1)}L"))
        each = held.select("id", "m", F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("id", F.col("x.terms").alias("term"), F.expr("(1000000000 * x.counts) div (1000 * x.counts + 8 * m)").alias("part"))
        self.df, self.most = np.zeros(len(terms), dtype=np.int64), np.zeros(len(terms), dtype=np.int64)
        for x in each.groupBy("term").agg(F.count("*").alias("df"), F.max("part").alias("most")).toLocalIterator():  # a row a term of the block
            self.df[x["term"]], self.most[x["term"]] = x["df"], x["most"]
        self.weight = np.array([math.floor(1000 * math.log((2 * self.docs + 2) / (2 * d + 1))) for d in self.df.tolist()], dtype=np.int64)
        by_item: dict[int, list[int]] = {}
        for x in items.toLocalIterator():  # BLOCK pairs
            if self.df[x["term"]]:
                by_item.setdefault(x["item"], []).append(x["term"])
        self.items = {i: sorted(t, key=lambda t: (self.df[t], t)) for i, t in by_item.items()}  # the rarest first
        # The k-th best score that an item's rarest terms give alone: those that k documents hold, with repeats.
        seeds = []
        for i, own in self.items.items():
            n = 0
            for t in own:
                seeds.append((i, int(t), int(self.weight[t])))
                n += int(self.df[t])
                if n >= k:
                    break
        self.least: dict[int, int] = {}
        if seeds:
            named = spark.createDataFrame(pd.DataFrame(seeds, columns=["item", "term", "weight"]), "item long, term int, weight long")
            held = stored.select(F.monotonically_increasing_id().alias("uid"), "*").withColumn("m", F.expr(f"10 + (90 * n * {self.docs}L) div {self.total}L"))
            each = held.select("uid", "m", F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("uid", F.col("x.terms").alias("term"), F.expr("(1000000000 * x.counts) div (1000 * x.counts + 8 * m)").alias("part"))
            sums = each.join(F.broadcast(named), "term").groupBy("item", "uid").agg(F.sum(F.col("weight") * F.col("part")).alias("score"))
            kth = sums.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))).where(F.col("rank") == k)
            self.least = {x["item"]: x["score"] for x in kth.select("item", "score").toLocalIterator()}  # a row an item

    def best(self) -> DataFrame:
        """Rows (item, id, score): each shard's k best of each item."""
        k, weight, most, items, least, docs, total = self.k, self.weight, self.most, self.items, self.least, self.docs, self.total
        shared = self.stored.sparkSession.sparkContext.broadcast((weight, most, items, least))

        def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, rows, n = [], 0, 0
            for x in batches:
                held.append(x)
                rows, n = rows + len(x), n + int(x["terms"].map(len).sum())
                if rows >= SHARD or n >= SHARD_POSTINGS:
                    yield scored(pd.concat(held, ignore_index=True), k, docs, total, *shared.value)
                    held, rows, n = [], 0, 0
                    give_back()
            if held:
                yield scored(pd.concat(held, ignore_index=True), k, docs, total, *shared.value)

        # A row without an id is marked, as numbers of pandas have no null.
        rows = self.stored.select(F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("none"), "n", "terms", "counts")
        out = rows.mapInPandas(shards, "item long, id long, none boolean, score long")
        return out.select("item", F.when(~F.col("none"), F.col("id")).alias("id"), "score")


def scored(x: pd.DataFrame, k: int, docs: int, total: int, weight: np.ndarray, most: np.ndarray, items: dict[int, list[int]], least: dict[int, int]) -> pd.DataFrame:
    """Rows (item, id, none, score): the k best documents of a shard x (id, none, n, terms, counts) for each item."""
    sizes = x["terms"].map(len).to_numpy()
    row = np.repeat(np.arange(len(x)), sizes)
    term = np.concatenate([*x["terms"], np.empty(0, dtype=np.int64)]).astype(np.int64)
    count = np.concatenate([*x["counts"], np.empty(0, dtype=np.int64)]).astype(np.int64)
    part = (1_000_000_000 * count) // (1000 * count + 8 * length_part(x["n"].to_numpy().astype(np.int64), docs, total)[row])
    order = np.argsort(term, kind="stable")
    term, row, part = term[order], row[order], part[order]
    first, last = np.searchsorted(term, np.arange(len(weight)), "left"), np.searchsorted(term, np.arange(len(weight)), "right")
    ids, none = x["id"].to_numpy(), x["none"].to_numpy()
    out: list[pd.DataFrame] = []
    for item, own in items.items():
        score = np.zeros(len(x), dtype=np.int64)
        left, creating, bar = int((weight[own] * most[own]).sum()), True, least.get(item, 0)
        for t in own:
            rows, add = row[first[t] : last[t]], weight[t] * part[first[t] : last[t]]
            if creating and left < bar:
                creating = False  # what remains can bring no new document to the k-th
            if not creating:
                old = score[rows] > 0
                rows, add = rows[old], add[old]
            score[rows] += add
            left -= int(weight[t] * most[t])
            if creating and left:
                some = score[score > 0]
                if len(some) >= k:
                    bar = max(bar, int(np.partition(some, len(some) - k)[len(some) - k]))
        some = np.flatnonzero(score >= max(bar, 1))
        if len(some) > k:
            some = some[np.lexsort((ids[some], none[some], -score[some]))[:k]]
        if len(some):
            out.append(pd.DataFrame({"item": item, "id": ids[some], "none": none[some], "score": score[some]}))
    return pd.concat(out) if out else pd.DataFrame({"item": [], "id": [], "none": [], "score": []}).astype({"item": "int64", "id": "int64", "none": "bool", "score": "int64"})


def ranked(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """Rows (item_id, rank, doc_id, score) of docs (doc_id, text): the k best for each of items (item_id, text)."""
    spark = docs.sparkSession
    asked, asked_path = written(item_terms(items), "items")
    blocks = max(1, -(-asked.count() // BLOCK))
    found = None
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b) if blocks > 1 else asked
        terms = sorted(x["term"] for x in own.select("term").distinct().toLocalIterator())  # BLOCK at most
        stored, path = written_none(spark) if not terms else postings(docs, terms)
        place = {t: i for i, t in enumerate(terms)}
        held = spark.createDataFrame(pd.DataFrame([(x["item"], place[x["term"]]) for x in own.select("item", "term").toLocalIterator()], columns=["item", "term"]), "item long, term int")
        best, _ = written(Query(held, stored, terms, k).best(), "best")
        found = best if found is None else found.unionByName(best)
        removed(spark, path)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(asked.select("item", "item_id").distinct(), "item").select("item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")


def written_none(spark: SparkSession) -> tuple[DataFrame, str]:
    return written(spark.createDataFrame([], "id long, n long, terms array<int>, counts array<long>"), "postings")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


#: All documents scored in full.
SQL = rf"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ws from documents),
e as (select rid, doc_id, len(ws)::bigint as n, ws from d where len(ws) > 0),
total as (select count(*) as docs, sum(n)::bigint as terms from e),
q as (select distinct item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
tf as (select rid, doc_id, n, term, count(*)::bigint as tf from (select rid, doc_id, n, unnest(ws) as term from e) where term in (select term from q) group by all),
df as (select term, count(*) as df from tf group by term),
parts as (select rid, doc_id, term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))) as part from tf join df using (term), total),
scores as (select item_id, rid, doc_id, sum(part)::bigint as score from parts join q using (term) group by all),
r as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from scores where score > 0)
select item_id, rank::int as rank, doc_id, score from r where rank <= {K}
"""

"""Benchmark decontamination by a distributed positional inverted index, with DataFrame operations alone.

The texts are read once. Of their words, those that occur in the benchmark become postings (document, term, position),
stored as a table. A window of an item is a phrase; its terms are ordered by how often they occur in the corpus. The
postings of its rarest term, less the term's offset in the window, are its first candidates; they are intersected with the
offset-adjusted postings of the next rarest term, and so on, until few are left, which meet all their other terms at once.
What is left are exact occurrences. Proximity matches come from the same postings: every other term of the window must have
one near a posting of the rarest.

Postings never meet in one row or group: the joins are on (document, term, position), which is unique. Windows are taken in
blocks of bounded size, so what is broadcast is bounded for any benchmark. Very frequent words cost nothing but where they
are the rarest of a window.

Cases: null texts have no words; an item without words has no window; of items shorter than a window the whole is one; rows
of one item id are one item with the windows of all; a null item id is an item whose id is the empty string; repeated
documents and documents of one id or of none are a row each; very long texts are rows of postings like others; the order of
equally rare terms (by number of the term, then offset) changes nothing in the result; empty tables give an empty result, or
documents without hits; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docpipe.llm.common import LOWER, UPPER, lower_ascii, removed, table, written

WINDOW = 10
#: What separates words; A-Z belong to words and are lower-cased after.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Windows of a block, whose terms and places are broadcast; candidates that meet all their terms at once.
BLOCK, FEW = 50_000, 500_000
#: The number of the term that ends each document; its position is the document's number of words.
END = -1


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Rows (item, wid, len, words) of benchmark (item_id, text): runs of `size` words, or all words of a shorter item."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.transform(words(F.col("text")), lower_ascii).alias("all")).where(F.size("all") > 0)
    each = items.select("item", "all", F.explode(F.sequence(F.lit(1), F.greatest(F.size("all") - size + 1, F.lit(1)))).alias("first"))
    cut = each.select("item", F.slice("all", F.col("first"), size).alias("words")).distinct()
    return cut.select("item", F.monotonically_increasing_id().alias("wid"), F.size("words").alias("len"), "words")


def numbered(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the number of their row."""
    return docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")


class Index:
    """Postings of docs (uid, doc_id, text) for the terms of windows (item, wid, len, words)."""

    def __init__(self, docs: DataFrame, held: DataFrame):
        self.held = held
        words_of = held.select(F.explode("words").alias("word")).distinct()
        terms, self._terms = written(words_of.select("word", F.monotonically_increasing_id().alias("term")), "terms")
        ended = docs.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(END).cast("long").alias("term"))  # no word is empty
        whole = docs.select("uid", "doc_id", F.concat(words(F.col("text")), F.array(F.lit(""))).alias("all"))
        each = whole.select("uid", "doc_id", F.posexplode("all").alias("pos", "raw"))
        met = each.select("uid", "doc_id", "pos", lower_ascii(F.col("raw")).alias("word")).join(F.broadcast(terms.unionByName(ended)), "word")
        stored, self._stored = written(met.select("uid", F.when(F.col("term") == END, F.col("doc_id")).alias("doc_id"), "term", "pos"), "postings")
        self.documents = stored.where(F.col("term") == END).select("uid", "doc_id", F.col("pos").cast("long").alias("n_words"))
        self.postings = stored.where(F.col("term") != END).select("uid", "term", "pos")
        frequency = self.postings.groupBy("term").agg(F.count("*").alias("cf"))
        places = held.select("item", "wid", "len", F.posexplode("words").alias("off", "word")).join(F.broadcast(terms), "word").join(F.broadcast(frequency), "term")
        rarest = F.sort_array(F.collect_list(F.struct("cf", "term", "off")))  # a window's terms, ten at most
        ranked = places.groupBy("item", "wid", "len").agg(rarest.alias("order")).where(F.size("order") == F.col("len"))  # the others lack a term
        self.ranked, self._ranked = written(ranked, "windows")

    def place(self, rank: int, *more: str) -> DataFrame:
        """Rows (wid, term, off, ...) of the terms of a rank, from 0 for the rarest, for broadcast: a block's windows at most."""
        return F.broadcast(self.ranked.where(F.size("order") > rank).select("wid", F.col("order")[rank]["term"].alias("term"), F.col("order")[rank]["off"].alias("off"), *more))

    def anchors(self) -> DataFrame:
        """Rows (uid, wid, start): where windows would start for their rarest terms to be in place."""
        return self.postings.join(self.place(0), "term").select("uid", "wid", (F.col("pos") - F.col("off")).alias("start")).where("start >= 0")

    def phrases(self) -> tuple[DataFrame, str]:
        """Rows (uid, item, wid, len, start) of exact occurrences of windows, and their table's place."""
        found, rank, most = self.anchors(), 1, self.ranked.agg(F.coalesce(F.max("len"), F.lit(1))).first()[0]
        whole = lambda n: F.broadcast(self.ranked.where(F.col("len") == n).select("wid"))
        done = found.join(whole(1), "wid").select("uid", "wid", "start")
        while rank < most:
            # The next rarest term: candidates meet its postings at their adjusted places.
            need = found.join(self.place(rank), "wid").select("uid", "wid", "start", "term", (F.col("start") + F.col("off")).alias("pos"))
            these = self.postings.join(F.broadcast(self.place(rank).select("term").distinct()), "term", "left_semi")
            found, _ = written(need.join(these, ["uid", "term", "pos"]).select("uid", "wid", "start"), f"rank{rank}")
            rank += 1
            done = done.unionByName(found.join(whole(rank), "wid").select("uid", "wid", "start"))
            if found.count() <= FEW:
                break
        if rank < most:
            rest = F.broadcast(self.ranked.where(F.size("order") > rank).select("wid", "len", F.explode(F.slice("order", rank + 1, most)).alias("x")))
            need = found.join(rest, "wid").select("uid", "wid", "start", "len", F.col("x.term").alias("term"), (F.col("start") + F.col("x.off")).alias("pos"))
            these = self.postings.join(F.broadcast(found.select("uid").distinct()), "uid", "left_semi")  # FEW at most
            met = need.join(these, ["uid", "term", "pos"]).groupBy("uid", "wid", "start").agg(F.count("*").alias("n"), F.first("len").alias("len"))
            done = done.unionByName(met.where(F.col("n") == F.col("len") - rank).select("uid", "wid", "start"))
        met = done.join(F.broadcast(self.ranked.select("item", "wid", "len")), "wid").select("uid", "item", "wid", "len", "start")
        return written(met, "phrases")

    def near(self, reach: int) -> DataFrame:
        """Rows (uid, item, wid, pos): postings of a window's rarest term with every other of its terms at most `reach` words away."""
        found = self.postings.join(self.place(0), "term").select("uid", "wid", F.col("pos").alias("at"))
        for rank in range(1, WINDOW):
            need = found.join(self.place(rank), "wid").withColumn("part", F.explode(F.sequence((F.greatest(F.col("at") - reach, F.lit(0)) / reach).cast("int"), ((F.col("at") + reach) / reach).cast("int"))))
            these = self.postings.join(F.broadcast(self.place(rank).select("term").distinct()), "term", "left_semi").withColumn("part", (F.col("pos") / reach).cast("int"))
            near = (need["uid"] == these["uid"]) & (need["term"] == these["term"]) & (need["part"] == these["part"]) & F.expr(f"abs(at - pos) <= {reach}")
            met = need.join(these, near, "left_semi").select("uid", "wid", "at").distinct()
            over = found.join(F.broadcast(self.ranked.where(F.col("len") <= rank).select("wid")), "wid").select("uid", "wid", "at")
            found, _ = written(met.unionByName(over), f"near{rank}")
        return found.join(F.broadcast(self.ranked.select("item", "wid")), "wid").select("uid", "item", "wid", F.col("at").alias("pos"))

    def close(self) -> None:
        """Deletes the index; documents and results that were not written are lost."""
        for path in (self._terms, self._stored, self._ranked):
            removed(self.held.sparkSession, path)


def blocks(benchmark: DataFrame, size: int = WINDOW) -> list[DataFrame]:
    """The windows of a benchmark in blocks of about BLOCK."""
    held, _ = written(windows(benchmark, size), "benchmark")
    n = -(-held.count() // BLOCK)
    return [held.where(F.pmod(F.xxhash64("wid"), F.lit(n)) == k) for k in range(n)] if n > 1 else [held]


def hits(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, phrases): rows (uid, doc_id, n_words) of docs, and (uid, item, wid, len, start) of occurrences in them."""
    documents = found = None
    docs, held = numbered(docs), blocks(benchmark)
    if len(held) > 1:  # the numbers must be the same for all blocks
        docs, _ = written(docs, "numbered")
    for block in held:
        index = Index(docs, block)
        here, _ = index.phrases()
        documents, found = documents or index.documents, here if found is None else found.unionByName(here)
    return documents, found


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each document."""
    documents, found = hits(docs, benchmark)
    # Words hit: the union of the occurrences, of which one start counts once, by its longest.
    spans = found.groupBy("uid", "start").agg(F.max(F.col("start") + F.col("len")).alias("stop"))
    before = F.max("stop").over(Window.partitionBy("uid").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    covered = spans.withColumn("new", F.greatest(F.col("stop") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))), F.lit(0)))
    n_hit = covered.groupBy("uid").agg(F.sum("new").cast("long").alias("n_hit"))
    items = found.select("uid", "item").distinct().groupBy("uid").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ","), 256).alias("items_sha256"))
    out = documents.join(n_hit, "uid", "left").join(items, "uid", "left").na.fill(0, ["n_hit", "n_items"])
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def query(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: By the n-grams of documents, of the lengths that windows have.
SQL = rf"""
with b as (select item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
win as (select distinct item_id, least(len(ws), {WINDOW}) as size, array_to_string(ws[i:i + {WINDOW - 1}], ' ') as gram from b, unnest(range(1, greatest(len(ws) - {WINDOW - 2}, 2))) as t(i) where len(ws) > 0),
d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
sizes as (select distinct size from win),
grams as (select rid, size, i, array_to_string(ws[i:i + size - 1], ' ') as gram from d, sizes, unnest(range(1, len(ws) - size + 2)) as t(i)),
found as (select rid, item_id, i, size from grams join win using (size, gram)),
hit as (select rid, count(distinct j) as n_hit from found, unnest(range(i, i + size)) as t(j) group by rid),
its as (select rid, count(*) as n_items, sha256(string_agg(item_id, ',' order by item_id)) as items_sha256 from (select distinct rid, coalesce(item_id::varchar, '') as item_id from found) group by rid)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (rid) left join its using (rid)
"""

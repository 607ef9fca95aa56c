"""Quality rules by the repetitions within a text, found with suffix arrays over words.

The suffixes of a batch of texts are sorted by prefix doubling: ranks by one word, then by two, four and so on, each
round sorting only those still tied. No suffix ties with one of another text. Neighbours in the sorted order give the
longest common prefixes from the kept ranks; the longer of a suffix's two is the longest repeat that begins at it, so the
spans of all intervals of common prefixes of at least `min_words` words, the maximal repeats, unite to the spans that begin
there. The rule limits the fraction of words that they cover and the longest repeat.

A text that is longer than a batch is judged whole by its last ranks alone, walking it once from each suffix to the next
(a common prefix is at most one shorter then), so that memory stays in proportion to it.

Cases: null and texts without words have no words and fail the base rule (under ten words); of repeats that tie all count;
repeated rows are judged each; an empty table gives an empty result; other columns pass through `judged`, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docpipe.llm.common import give_back, table, text_batches

#: Words of a batch of suffixes; a longer text is a batch of its own.
BATCH_WORDS = 200_000
SYMBOLS = "#*$%&|<>"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered long, longest long"


def suffix_ranks(first: np.ndarray, last_only: bool = False) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... symbols, to where no two are equal; or the last of them alone.

    first: a symbol for each place, equal only within one text. A rank is the number of suffixes that are smaller. A
    suffix that ends within the compared symbols has no equal, since a text's last symbol is followed by another text.
    """
    n = len(first)
    order = np.argsort(first, kind="stable")
    srt = first[order]
    start = np.flatnonzero(np.r_[True, srt[1:] != srt[:-1]])
    size = np.diff(np.r_[start, n])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.repeat(start, size)
    levels, h = [rank], 1
    tied = order[np.repeat(size > 1, size)]
    while len(tied):
        nxt = tied + h
        key = rank[tied] * (n + 1) + np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        old = rank[tied]
        head = np.r_[True, key[1:] != key[:-1]]
        top = np.r_[True, old[1:] != old[:-1]]
        at = np.arange(len(tied))
        first_of = np.maximum.accumulate(np.where(head, at, 0))
        rank = rank if last_only else rank.copy()
        rank[tied] = old + first_of - np.maximum.accumulate(np.where(top, at, 0))
        levels = [rank] if last_only else [*levels, rank]
        start = np.flatnonzero(head)
        size = np.diff(np.r_[start, len(tied)])
        tied = tied[np.repeat(size > 1, size)]
        h *= 2
    return levels


def walked_prefixes(first: np.ndarray, rank: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place k of the order but the first, the common prefix of the suffixes at k - 1 and k."""
    n, out = len(first), np.zeros(len(first) + 1, dtype=np.int64)
    symbol, at, order, lcp, h = memoryview(first), memoryview(rank), memoryview(sa), memoryview(out), 0
    for i in range(n):
        k = at[i]
        if k:
            j = order[k - 1]
            end = n - max(i, j)
            while h < end and symbol[i + h] == symbol[j + h]:
                h += 1
            lcp[k] = h
            h -= h > 0
        else:
            h = 0
    return out


def longest_repeats(first: np.ndarray) -> np.ndarray:
    """For each place, the length of the longest run of symbols from there that occurs elsewhere too."""
    n = len(first)
    levels = suffix_ranks(first, n > BATCH_WORDS)
    sa = np.empty(n, dtype=np.int64)
    sa[levels[-1]] = np.arange(n)
    if n > BATCH_WORDS:
        lcp, out = walked_prefixes(first, levels[-1], sa), np.empty(n, dtype=np.int64)
        out[sa] = np.maximum(lcp[:-1], lcp[1:])
        return out
    lcp = np.zeros(n + 1, dtype=np.int64)  # of the suffixes at k - 1 and k of the order
    near = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]])
    a, b, common = sa[near], sa[near + 1], np.zeros(len(near), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + common, b + common
        inside = (i < n) & (j < n)
        same = inside & (levels[k][np.minimum(i, n - 1)] == levels[k][np.minimum(j, n - 1)])
        common += same * (1 << k)
    lcp[near + 1] = common
    out = np.empty(n, dtype=np.int64)
    out[sa] = np.maximum(lcp[:-1], lcp[1:])
    return out


def covered(begin: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in a span."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + length, -1)
    return edge[:-1].cumsum() > 0


def repeats(texts: list[list[bytes]], window: int, min_words: int) -> np.ndarray:
    """For each list of words: words in windows that occur twice, words covered by repeats of min_words, longest repeat."""
    sizes = np.array([len(x) for x in texts], dtype=np.int64)
    out = np.zeros((len(texts), 3), dtype=np.int64)
    if not sizes.sum():
        return out
    ids: defaultdict[bytes, int] = defaultdict(count().__next__)
    word = np.fromiter(map(ids.__getitem__, chain.from_iterable(texts)), dtype=np.int64, count=int(sizes.sum()))
    doc = np.repeat(np.arange(len(texts)), sizes)
    longest = longest_repeats(doc * len(ids) + word)
    for column, least, span in ((0, window, None), (1, min_words, longest)):
        at = np.flatnonzero(longest >= least)
        mark = covered(at, np.full(len(at), window) if span is None else span[at], len(word))
        out[:, column] = np.bincount(doc[mark], minlength=len(texts))
    np.maximum.at(out[:, 2], doc, longest)
    return out


def duplicate_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif line.strip(" \t\n\v\f\r"):
            seen.add(line)
    return n


def measures(texts: pd.Series, window: int, min_words: int) -> pd.DataFrame:
    rows, batch, size, found = [], [], 0, []
    for t in texts:
        t = t or ""
        words = t.encode("utf-8", "surrogatepass").split()
        rows.append((len(words), len(t) - sum(map(t.count, " \t\n\v\f\r")), sum(map(t.count, SYMBOLS)), duplicate_lines(t) if "\n" in t else 0))
        if batch and size + len(words) > BATCH_WORDS:
            found.append(repeats(batch, window, min_words))
            batch, size = [], 0
        batch.append(words)
        size += len(words)
    found.append(repeats(batch, window, min_words))
    names = [x.split()[0] for x in MEASURES.split(", ")]
    return pd.DataFrame(np.hstack([np.array(rows, dtype=np.int64).reshape(-1, 4), np.vstack(found)]), columns=names)


def judged(docs: DataFrame, text: str = "text", min_words: int = 8, max_covered: float = 0.2, max_longest: int = 60) -> DataFrame:
    """Rows (row: all of docs' columns, the measures, base_failed, kept)."""

    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield measures(x, 5, min_words)
            give_back()

    text_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text].alias("t"))
    out = rows.select("row", F.pandas_udf(measure, MEASURES).asNondeterministic()("t").alias("m")).select("row", "m.*")
    base: Column = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    fine = (F.col("n_covered") <= max_covered * F.col("n_words")) & (F.col("longest") <= max_longest)
    return out.withColumn("base_failed", base).withColumn("kept", ~base & fine)


def query(spark, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", *[x.split()[0] for x in MEASURES.split(", ")], "base_failed", "kept")


#: By pairs of places of equal words: runs of them on one diagonal are repeats.
SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
w as (select doc_id, unnest(ws) as word, unnest(range(len(ws))) as i from d),
pairs as (select a.doc_id, a.i, b.i - a.i as gap from w a join w b on a.doc_id = b.doc_id and a.word = b.word and a.i < b.i),
runs as (select doc_id, gap, min(i) as i, count(*) as n from (select *, i - row_number() over (partition by doc_id, gap order by i) as k from pairs) group by doc_id, gap, k),
spans as (select doc_id, i, n from runs where n >= 5 union all select doc_id, i + gap, n from runs where n >= 5),
marked as (select doc_id, i, n, 5 as least from spans union all select doc_id, i, n, 8 from spans where n >= 8),
swept as (select doc_id, least, i, i + n as e, coalesce(max(i + n) over (partition by doc_id, least order by i, i + n rows between unbounded preceding and 1 preceding), 0) as before from marked),
cover as (select doc_id, least, sum(greatest(0, e - greatest(i, before)))::bigint as n from swept group by doc_id, least),
longest as (select doc_id, max(n) as longest from runs group by doc_id),
lines as (select doc_id, unnest(string_split(t, chr(10))) as line, unnest(range(len(string_split(t, chr(10))))) as k from d),
dup as (select doc_id, count(*) as n from (select doc_id, line, row_number() over (partition by doc_id, line order by k) as nth from lines) where nth > 1 and regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
m as (select d.doc_id, len(ws) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
    coalesce(dup.n, 0) as n_dup_lines, coalesce(five.n, 0) as n_repeat_words, coalesce(eight.n, 0) as n_covered, coalesce(longest, 0) as longest
  from d left join dup using (doc_id) left join longest using (doc_id) left join (select * from cover where least = 5) five on five.doc_id = d.doc_id left join (select * from cover where least = 8) eight on eight.doc_id = d.doc_id),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select *, not base_failed and n_covered <= 0.2 * n_words and longest <= 60 as kept from b
"""

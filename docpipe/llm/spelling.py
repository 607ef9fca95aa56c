"""Spelling variants by Bloom-guided neighbourhoods.

Words and their counts come from built-in functions. A blocked Bloom filter of the vocabulary is kept for each length of
word: one look at one 64-bit block tells whether a string may be a word. Tasks make the edits of each word as numbers alone
(a polynomial hash changes by one term where a letter is replaced, and shifts where one is deleted), and look each up in the
filter of its length. Replacements by a greater letter and deletions reach every pair of near words from one of its sides.
Only edits that the filter lets through become strings and are shuffled to an exact join with the vocabulary, which removes
false positives.

The filters are made in tasks, in parts of 512 KB, and broadcast in rounds of at most ROUND parts, so what is broadcast is
bounded for any vocabulary; a round looks at words of its lengths alone. A word has at most some thousands of neighbours,
so no group is large.

Cases: null and empty texts have no words; a null id counts as the empty text; very long runs of letters are words like
others, their edits made some places at a time; repeated documents count again; near words of equal count go by code point,
the smallest first; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docpipe.llm.common import LOWER, UPPER, give_back, lower_ascii, table, written

#: Letters of words; what separates runs of them.
LETTERS, GAP = "A-Za-zÀ-ÿ", "[^A-Za-zÀ-ÿ]+"
#: Code points that a word has at least, occurrences, times that a form is more frequent, one of so many runs that loses a letter.
LENGTH, COUNT, TIMES, SLIP = 7, 2, 10, 31
#: Bits of a filter a word, blocks of a part of a filter, parts of a round, edits held at once.
BITS, PART, ROUND, EDITS = 24, 65_536, 128, 400_000
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def occurrences(docs: DataFrame) -> DataFrame:
    """Rows (word) of docs (doc_id, text): runs of letters, A-Z lower-cased, some of which lose a letter; LENGTH at least."""
    runs = docs.select("doc_id", F.explode(F.split("text", GAP)).alias("run")).where(F.length("run") >= LENGTH)
    low = runs.select("doc_id", lower_ascii(F.col("run")).alias("low"))
    hashed = low.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "low").cast("binary")))
    at = (F.col("h") % F.length("low")).cast("int")
    cut = F.concat(F.substring("low", F.lit(1), at), F.substring("low", at + 2, F.length("low")))
    return hashed.select(F.when(F.col("h") % SLIP == 0, cut).otherwise(F.col("low")).alias("word")).where(F.length("word") >= LENGTH)


def powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def places(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash, and the five bits in it."""
    x = h ^ (h >> np.uint64(32))
    x = x * MIX
    x ^= x >> np.uint64(29)
    x = x * MIX
    x ^= x >> np.uint64(32)
    block = ((x >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    mask, one, six = np.uint64(1) << (x & np.uint64(63)), np.uint64(1), np.uint64(63)
    for k in (6, 12, 18, 24):
        mask |= one << ((x >> np.uint64(k)) & six)
    return block, mask


def codes(words: list[str]) -> np.ndarray:
    """The code points of words of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), -1).astype(np.uint64)


class Lengths:
    """How many blocks the filter of each length has. sizes: words by length."""

    def __init__(self, sizes: dict[int, int]):
        self.blocks = {n: -(-count * BITS // 64) for n, count in sizes.items()}
        parts = [(n, p) for n, b in sorted(self.blocks.items()) for p in range(-(-b // PART))]
        #: The parts (length, part) of each round.
        self.rounds = [parts[k : k + ROUND] for k in range(0, len(parts), ROUND)]


def filters(words: DataFrame, lengths: Lengths) -> DataFrame:
    """Rows (length, part, bits) of the filters of words (word)."""
    blocks, size = lengths.blocks, PART

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for n, w in x["word"].groupby(x["word"].str.len()):
                block, mask = places((codes(w.tolist()) * powers(n)).sum(axis=1, dtype=np.uint64), blocks[n])
                yield pd.DataFrame({"length": np.int32(n), "part": (block // size).astype(np.int32), "slot": (block % size).astype(np.int32), "mask": mask.view(np.int64)})

    def pack(key, x: pd.DataFrame) -> pd.DataFrame:
        n, part = key
        held = np.zeros(min(size, blocks[n] - part * size), dtype=np.uint64)
        np.bitwise_or.at(held, x["slot"].to_numpy(), x["mask"].to_numpy().view(np.uint64))
        return pd.DataFrame({"length": [n], "part": [part], "bits": [held.tobytes()]})

    marks = words.select("word").mapInPandas(mark, "length int, part int, slot int, mask long")
    return marks.groupBy("length", "part").applyInPandas(pack, "length int, part int, bits binary")


class Filter:
    """The parts, of `part` blocks, of a round."""

    def __init__(self, parts: dict[tuple[int, int], bytes], blocks: dict[int, int], part: int = PART):
        self.blocks, self.held, self.first = blocks, {}, {}
        for n in {n for n, _ in parts}:
            own = [p for m, p in parts if m == n]
            first, last = min(own) * part, min((max(own) + 1) * part, blocks[n])
            self.first[n], self.held[n] = first, np.zeros(last - first, dtype=np.uint64)
            for p in own:  # a part without words is not there
                bits = np.frombuffer(parts[n, p], dtype=np.uint64)
                self.held[n][p * part - first : p * part - first + len(bits)] = bits

    def may_hold(self, h: np.ndarray, n: int) -> np.ndarray:
        """For each hash of a string of length n whether a word may have it; False for those of other rounds."""
        block, mask = places(h, self.blocks[n])
        held, first = self.held[n], self.first[n]
        if first or len(held) < self.blocks[n]:
            at = block.astype(np.int64) - first
            inside = (at >= 0) & (at < len(held))
            return inside & ((held[np.where(inside, at, 0)] & mask) == mask)
        return (held[block.astype(np.int64)] & mask) == mask


def probed(words: list[str], n: int, alphabet: np.ndarray, known: Filter, edits: int = EDITS) -> Iterator[tuple[int, str]]:
    """(index, edit) of the edits of words of length n that known may hold: each greater letter in each place, and each letter left out.

    edits: replacements made at once.
    """
    c, p = codes(words), powers(n)
    terms = c * p
    h = terms.sum(axis=1, dtype=np.uint64)
    if n in known.held:
        step = max(1, edits // (len(words) * len(alphabet)))
        for low in range(0, n, step):
            own = c[:, low : low + step, None]
            new = h[:, None, None] + (alphabet[None, None, :] - own) * p[None, low : low + step, None]
            hit = known.may_hold(new.ravel(), n).reshape(new.shape) & (alphabet[None, None, :] > own)
            for w, i, a in zip(*(x.tolist() for x in np.nonzero(hit)), strict=True):
                i += low
                yield w, f"{words[w][:i]}{chr(int(alphabet[a]))}{words[w][i + 1 :]}"
    if n - 1 in known.held:
        before = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
        shifted = c[:, 1:] * p[None, :-1]
        after = np.zeros_like(c)
        after[:, :-1] = np.cumsum(shifted[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
        hit = known.may_hold((before + after).ravel(), n - 1).reshape(c.shape)
        hit[:, :-1] &= c[:, :-1] != c[:, 1:]  # of equal letters side by side the last
        for w, i in zip(*(x.tolist() for x in np.nonzero(hit)), strict=True):
            yield w, words[w][:i] + words[w][i + 1 :]


def candidates(words: DataFrame, letters: list[str], parts: dict[tuple[int, int], bytes], blocks: dict[int, int]) -> DataFrame:
    """Rows (word, n, edit) of words (word, n) for the parts of a round."""
    shared = words.sparkSession.sparkContext.broadcast((parts, blocks))  # ROUND parts at most
    lengths = sorted({n for n, _ in parts} | {n + 1 for n, _ in parts})
    alphabet, part, edits = np.array(sorted(map(ord, letters)), dtype=np.uint64), PART, EDITS

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Filter(*shared.value, part)
        for x in batches:
            for n, own in x.groupby(x["word"].str.len()):
                run = max(1, edits // (n * len(alphabet)))
                for k in range(0, len(own), run):
                    word, count = own["word"].iloc[k : k + run].tolist(), own["n"].iloc[k : k + run].to_numpy()
                    found = list(probed(word, n, alphabet, known, edits))
                    at = [w for w, _ in found]
                    yield pd.DataFrame({"word": pd.Series([word[w] for w in at], dtype=object), "n": count[at], "edit": pd.Series([e for _, e in found], dtype=object)})
            give_back()

    few = words.where(F.length("word").isin(lengths)) if len(lengths) <= 1000 else words
    return few.select("word", "n").mapInPandas(probe, "word string, n long, edit string")


def near_pairs(words: DataFrame) -> DataFrame | None:
    """Rows (word, n, other, m) of words (word, n), each pair of near words from both sides; None if there are no words."""
    sizes = {x["length"]: x["count"] for x in words.groupBy(F.length("word").alias("length")).count().toLocalIterator()}  # a row a length
    if not sizes:
        return None
    lengths = Lengths(sizes)
    stored, _ = written(filters(words, lengths), "filters")
    letters = [x["c"] for x in words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct().toLocalIterator()]  # of LETTERS
    found = None
    for own in lengths.rounds:
        wanted = stored.where(F.struct("length", "part").between(F.struct(F.lit(own[0][0]), F.lit(own[0][1])), F.struct(F.lit(own[-1][0]), F.lit(own[-1][1]))))
        parts = {(x["length"], x["part"]): bytes(x["bits"]) for x in wanted.toLocalIterator()}  # ROUND at most
        if not parts:
            continue
        here, _ = written(candidates(words, letters, parts, lengths.blocks), "edits")
        found = here if found is None else found.unionByName(here)
    exact = found.join(words.select(F.col("word").alias("edit"), F.col("n").alias("m")), "edit").select("word", "n", F.col("edit").alias("other"), "m")
    return exact.unionByName(exact.select(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m")))


def roots(forms: DataFrame, most: int) -> DataFrame:
    """Rows (word, root) of forms (word, form): the last of its forms. Each is TIMES as frequent as the one before, most times at most."""
    out = forms.select("word", F.col("form").alias("root"))
    hops = 1
    while TIMES**hops <= most:  # steps of twice the hops each round
        far = out.select(F.col("word").alias("root"), F.col("root").alias("farther"))
        out, _ = written(out.join(far, "root", "left").select("word", F.coalesce("farther", "root").alias("root")), "roots")
        hops *= 2
    return out


def variants(docs: DataFrame) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) of docs (doc_id, text)."""
    words, _ = written(occurrences(docs).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= COUNT), "words")
    pairs = near_pairs(words)
    if pairs is None:
        return words.select("word", *[F.lit(None).cast("string").alias(c) for c in ("form", "root")], "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("form_n"))
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"), F.first("n").alias("n"))
    near, _ = written(best.select("word", "n_near", F.when(-F.col("best.less") >= TIMES * F.col("n"), F.struct(F.col("best.other").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("x")), "near")
    last = roots(near.where("x is not null").select("word", "x.form"), words.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0])
    out = words.join(near, "word", "left").join(last, "word", "left")
    return out.select("word", F.col("x.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("x.form_n").alias("form_n"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Near words share a word with one letter left out, or one that is the other with a letter left out.
SQL = rf"""
with recursive bits as (select list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tbl),
r as (select doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) as run from documents),
u as (select run, doc_id, count(*) as k from r where length(run) >= {LENGTH} group by all),
h as (select run, k, xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::varchar, '') || ':' || run)), '..'), lambda x: ('0x' || x)::bigint)), lambda c, x: xor(c >> 8, tbl[(xor(c, x) & 255) + 1])), 4294967295)::bigint as h from u, bits),
o as (select case when h % {SLIP} = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, k from h),
v as (select word, sum(k)::bigint as n from o where length(word) >= {LENGTH} group by word having sum(k) >= {COUNT}),
cut as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from v, unnest(range(1, length(word) + 1)) as t(i)),
pairs as (select distinct a.word, b.word as other, b.n as m from cut a join cut b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select a.word, b.word, b.n from cut a join v b on a.rest = b.word union select b.word, a.word, a.n from cut a join v b on a.rest = b.word),
near as (select word, count(*) as n_near, max(m) as top from pairs group by word),
forms as (select v.word, v.n, n_near, case when top >= {TIMES} * v.n then (select min(other) from pairs p where p.word = v.word and p.m = near.top) end as form, case when top >= {TIMES} * v.n then top end as form_n from v left join near using (word)),
walk as (select word, word as root from forms union all select walk.word, f.form from walk join forms f on walk.root = f.word where f.form is not null)
select f.word, f.form, (select w.root from walk w join forms g on w.root = g.word where w.word = f.word and g.form is null) as root, f.n, coalesce(f.n_near, 0)::bigint as n_near, f.form_n::bigint as form_n from forms f
"""

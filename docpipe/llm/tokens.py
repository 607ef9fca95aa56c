"""Byte-level BPE encoding and decoding by overlapping chunks.

A text of up to LONG characters is one chunk. A longer one is cut into chunks that overlap; the chunks are pre-tokenised
on their own, in parallel; where two neighbours both end a pre-token at the same place of their overlap, they agree from
there on, and the text is stitched at the first such place. The pieces between the stitches are encoded in parallel and
their ids joined. A text two of whose neighbours never agree (a run without a boundary longer than the overlap) is
encoded whole. Decoding joins the bytes of the ids.

Cases: null counts as the empty text, which has no ids; repeated rows are encoded each; an empty table gives an
empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docpipe.llm.common import give_back, table, text_batches, written

#: Characters: a longer text is cut; the step from chunk to chunk; what a chunk shares with the next.
LONG, STEP, OVERLAP = 65_536, 32_768, 512
#: Unicode's white space, which regular expression libraries do not agree on.
SPACE = "\t-\r \x85\xa0{}{}-{}{}{}{}{}{}".format(*map(chr, (0x1680, 0x2000, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Entries of each half of a worker's memory of encoded words. Bytes of a pre-token that is merged without a heap.
MEMORY, SHORT = 250_000, 48
#: Texts or id lists whose results are held at once, after which memory is given back; chunks of long texts.
RUN, CHUNKS = 250, 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: the pair of lowest rank is merged, the leftmost first, until none is left."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    if n <= SHORT:
        return merge_short(piece, ranks)
    part, after, before = [piece[i : i + 1] for i in range(n)], [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(r, i, part[i] + part[i + 1]) for i in range(n - 1) if (r := ranks.get(part[i] + part[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i] if part[i] else -1
        if j < 0 or part[i] + part[j] != both:
            continue
        part[i], part[j] = both, b""
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if (r := ranks.get(both + part[k])) is not None:
                heapq.heappush(heap, (r, i, both + part[k]))
        if (h := before[i]) >= 0 and (r := ranks.get(part[h] + both)) is not None:
            heapq.heappush(heap, (r, h, part[h] + both))
    return [ranks[x] for x in part if x]


def merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for a short pre-token, without a heap."""
    rank, none = ranks.get, len(ranks) + (1 << 40)
    part = [piece[i : i + 1] for i in range(len(piece))]
    pair = [rank(a + b, none) for a, b in zip(part, part[1:])]
    while pair and (low := min(pair)) < none:
        i = pair.index(low)
        part[i] += part.pop(i + 1)
        del pair[i]
        if i < len(pair):
            pair[i] = rank(part[i] + part[i + 1], none)
        if i:
            pair[i - 1] = rank(part[i - 1] + part[i], none)
    return [ranks[x] for x in part]


class Words(dict):
    """Packed ids of a word with the blank before it, or of a run of white space; made when first asked for."""

    def __init__(self, pattern: str, ranks: dict[bytes, int]):
        import regex

        #: Pre-tokens never join white space but a single blank before a word, so words can be told apart first.
        self.split = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall
        self.inner = regex.compile(pattern.replace(r"\S", f"[^{SPACE}]").replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]"))
        self.ranks = ranks
        self.vocabulary = [b""] * (max(ranks.values(), default=-1) + 1)
        for k, v in ranks.items():
            self.vocabulary[v] = k
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.vocabulary))]
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        out = self.old.get(word)
        if out is None:
            out = b"".join([self.packed[i] for m in self.inner.findall(word) for i in merge(m.encode(), self.ranks)])
        if len(word) <= 64:
            if len(self) >= MEMORY:  # words asked for again come over from the old half
                self.old = dict(self)
                self.clear()
            self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text)))

    def ends(self, text: str, low: int, high: int) -> list[int]:
        """Places in [low, high) where a pre-token other than white space ends, matching from the start of text."""
        out, at = [], 0
        for word in self.split(text):
            if at >= high:
                break
            if at + len(word) > low and not word.isspace():
                out += [at + m.end() for m in self.inner.finditer(word) if low <= at + m.end() < high]
            at += len(word)
        return out


def chunker(step: int, overlap: int, run: int):
    """A function from batches of texts (uid, t) to their overlapping chunks (uid, at, last, piece), some at a time: a text is gone through once."""

    def chunked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for uid, t in zip(x["uid"], x["t"], strict=True):
                starts = range(0, len(t), step)
                for k in range(0, len(starts), run):
                    own = starts[k : k + run]
                    yield pd.DataFrame({"uid": uid, "at": own, "last": [at + step >= len(t) for at in own], "piece": pd.Series([t[at : at + step + overlap] for at in own], dtype=object)})
            give_back()

    return chunked


def words_of(pattern: str, shared) -> Words:
    """One memory for each worker and vocabulary. shared: the broadcast ranks."""
    ranks = shared.value
    if _HELD.get("ranks") is not ranks or _HELD.get("pattern") != pattern:
        _HELD.update(ranks=ranks, pattern=pattern, words=Words(pattern, ranks))
    return _HELD["words"]


_HELD: dict = {}


class Bpe:
    """A byte-level BPE of a rank file and a pre-token pattern."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        text_batches(spark)
        shared = spark.sparkContext.broadcast(read_ranks(path))  # the vocabulary, of fixed size

        def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            words = words_of(pattern, shared)
            for x in texts:
                for k in range(0, len(x), RUN):
                    yield pd.Series([words.encode(t) if t else b"" for t in x.iloc[k : k + RUN]], dtype=object)
                    give_back()

        def decoded(ids: bytes) -> bytes:
            return b"".join(map(words_of(pattern, shared).vocabulary.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))

        def decode(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for x in ids:
                for k in range(0, len(x), RUN):
                    yield pd.Series([decoded(b) for b in x.iloc[k : k + RUN]], dtype=object)
                    give_back()

        def code(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for ids in encode(texts):
                yield pd.DataFrame({"ids": ids, "decoded": [decoded(b) for b in ids]})

        def ends(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            words = words_of(pattern, shared)
            for x in chunks:
                yield pd.DataFrame({"head": [words.ends(t, 0, OVERLAP) for t in x["piece"]], "tail": [[e - STEP for e in words.ends(t, STEP, len(t) - 3)] for t in x["piece"]]})

        # Not deterministic: so that Spark never evaluates one of them twice for a row.
        self._encode = F.pandas_udf(encode, "binary").asNondeterministic()
        self._code = F.pandas_udf(code, "ids binary, decoded binary").asNondeterministic()
        self._decoded = decoded
        self._decode = F.pandas_udf(decode, "binary").asNondeterministic()
        self._ends = F.pandas_udf(ends, "head array<int>, tail array<int>").asNondeterministic()

    def decode(self, ids: Column) -> Column:
        """The bytes of packed ids."""
        return self._decode(ids)

    def encode(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """Rows (row: all of docs' columns, ids: little-endian unsigned 32-bit integers, packed)."""
        return self.round_trip(docs, text, decode=False)

    def round_trip(self, docs: DataFrame, text: str = "text", decode: bool = True) -> DataFrame:
        """Rows (row, ids, decoded: the bytes that the ids decode to), coded and decoded by the same worker."""
        own = self._decoded

        def coded(frame: DataFrame) -> DataFrame:
            if decode:
                return frame.select("row", self._code("t").alias("c")).select("row", "c.*")
            return frame.select("row", self._encode("t").alias("ids"))

        rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs[text], F.lit("")).alias("t"))
        short = coded(rows.where(F.length("t") <= LONG))
        # A long text is rare; its chunks are dealt over all tasks, and its ids come together again by its own number.
        long_, _ = written(rows.where(F.length("t") > LONG).withColumn("uid", F.monotonically_increasing_id()), "long")
        chunks = long_.select("uid", "t").mapInPandas(chunker(STEP, OVERLAP, CHUNKS), "uid long, at int, last boolean, piece string")
        chunks = chunks.repartition("uid", "at").withColumn("e", self._ends(F.struct("piece")))
        by_text = Window.partitionBy("uid").orderBy("at")
        cuts = chunks.withColumn("start", F.when(F.col("at") == 0, 0).otherwise(F.array_min(F.array_intersect(F.col("e.head"), F.lag("e.tail").over(by_text)))))
        cuts = cuts.withColumn("stop", F.when(F.col("last"), F.length("piece")).otherwise(F.lead("start").over(by_text) + STEP))
        pieces = cuts.select("uid", "at", self._encode(F.expr("substring(piece, start + 1, stop - start)")).alias("ids"), (F.col("start").isNull() | F.col("stop").isNull()).alias("torn"))

        def joined(key, x: pd.DataFrame) -> pd.DataFrame:
            ids = None if x["torn"].any() else b"".join(x.sort_values("at")["ids"])
            return pd.DataFrame({"uid": [key[0]], "ids": [ids], "decoded": [own(ids) if decode and ids is not None else None]})

        whole = pieces.groupBy("uid").applyInPandas(joined, "uid long, ids binary, decoded binary")
        met = long_.join(whole, "uid")
        return short.unionByName(met.where("ids is not null").select(*short.columns)).unionByName(coded(met.where("ids is null").select("row", "t")))


def digest(spark: SparkSession, docs: DataFrame, path: str, pattern: str) -> DataFrame:
    bpe = Bpe(spark, path, pattern)
    return bpe.round_trip(docs.select("doc_id", "text")).select("row.doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

"""Quality classifier: a generalised additive model with pairwise interactions.

Numeric features of a text are cut into bins. Shallow trees over the bins of one feature at a time are boosted in a cycle
with a small rate; their sum is a lookup table for each feature. Pairs of features whose joint table reduces what is left
most are boosted in the same way. A text's score is the logistic of the sum of its bins' entries.

Cases: null counts as the empty text, whose features are all 0; labels that are null or belong to no document teach
nothing; with no labelled row, or labels of one kind, the score is the constant prior; very long texts are measured whole;
values that tie with an edge belong to the bin above it, trees that tie cut at the first place; repeated rows are scored
each; an empty table gives an empty result; other columns pass through `scored`, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docpipe.llm.common import crc_mod, table, text_batches

#: Labelled rows to learn from, about (chosen by a hash of the id): the bound of what the driver gathers.
SAMPLE = 20_000
BINS, ROUNDS, PAIRS, PAIR_ROUNDS, RATE, LEAVES = 32, 120, 8, 40, 0.15, 3
FEATURES = (
    "log_words", "word_length", "longest_word", "distinct_words", "commonest_word", "commonest_pair", "upper", "digits", "marks", "symbols",
    "bars", "shouts", "high_bytes", "line_words", "short_lines", "repeated_lines", "stops", "shouted_words", "byte_entropy", "commonest_line",
)


def features_of(text: str | None) -> tuple[float, ...]:
    if not text:
        return (0.0,) * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    c = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    words = raw.split()
    n, size = max(1, len(words)), len(raw)
    count = Counter(words)
    letters = max(1, int(c[65:91].sum() + c[97:123].sum() + c[128:].sum()))
    pairs = Counter(zip(words, words[1:])) if len(words) < 4000 else Counter(map(hash, zip(words, words[1:])))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    by_line = Counter(lines)
    p = c[c > 0] / size
    return (
        math.log1p(len(words)), sum(map(len, words)) / n, max(map(len, words), default=0), len(count) / n, max(count.values(), default=0) / n, max(pairs.values(), default=0) / n,
        c[65:91].sum() / letters, c[48:58].sum() / size, (c[33:48].sum() + c[58:65].sum()) / n, (c[35] + c[42] + c[36] + c[37] + c[38] + c[60] + c[62]) / n,
        c[124] / n, c[33] / n, c[128:].sum() / size, n / max(1, len(lines)), sum(x.count(b" ") < 3 for x in lines) / max(1, len(lines)), 1 - len(by_line) / max(1, len(lines)),
        (c[46] + c[63]) / n, sum(map(bytes.isupper, words)) / n, float(-(p * np.log2(p)).sum()), max(by_line.values(), default=0) / max(1, len(lines)),
    )


def features(texts: pd.Series) -> np.ndarray:
    return np.array([features_of(t) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))


def leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """The values of a tree of few leaves over ordered bins with gradient sums g and curvature sums h."""
    cuts = [0, len(g)]
    G, H = np.r_[0, g.cumsum()], np.r_[0, h.cumsum()]
    gain_of = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + 1.0)
    for _ in range(leaves - 1):
        best, at = 1e-9, None
        for a, b in zip(cuts, cuts[1:]):
            k = np.arange(a + 1, b)
            if len(k):
                gain = gain_of(a, k) + gain_of(k, b) - gain_of(a, b)
                gain[(H[k] - H[a] < 0.5) | (H[b] - H[k] < 0.5)] = 0
                if gain.max() > best:
                    best, at = gain.max(), int(k[gain.argmax()])
        if at is None:
            break
        cuts = sorted([*cuts, at])
    out = np.empty(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = leaf(G[b] - G[a], H[b] - H[a])
    return out


def shallow_pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree over a table of two features, one cut of each: its values and its gain."""
    G, H = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    i, j = np.arange(1, g.shape[0])[:, None], np.arange(1, g.shape[1])[None]
    gs = (G[i, j], G[i, -1] - G[i, j], G[-1, j] - G[i, j], G[-1, -1] - G[i, -1] - G[-1, j] + G[i, j])
    hs = (H[i, j], H[i, -1] - H[i, j], H[-1, j] - H[i, j], H[-1, -1] - H[i, -1] - H[-1, j] + H[i, j])
    gain = sum(a**2 / (b + 1.0) for a, b in zip(gs, hs, strict=True))
    if not gain.size:
        return np.zeros_like(g), 0.0
    a, b = np.unravel_index(gain.argmax(), gain.shape)
    out = np.empty_like(g)
    for k, (x, y) in enumerate(((slice(0, a + 1), slice(0, b + 1)), (slice(0, a + 1), slice(b + 1, None)), (slice(a + 1, None), slice(0, b + 1)), (slice(a + 1, None), slice(b + 1, None)))):
        out[x, y] = leaf(gs[k][a, b], hs[k][a, b])
    return out, float(gain[a, b])


class Additive:
    """Bin edges, a table for each feature, tables of pairs."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        d = x.shape[1]
        prior = (y.sum() + 0.5) / (len(y) + 1.0)
        self.base = math.log(prior / (1 - prior))
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if len(y) else np.empty(0) for k in range(d)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        if len(np.unique(y)) < 2:
            return
        b = self.bins(x)
        f = np.full(len(y), self.base)

        def left() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-f))
            return y - p, p * (1 - p)

        for _ in range(ROUNDS):
            for k in range(d):
                g, h = left()
                m = len(self.tables[k])
                step = RATE * shallow_tree(np.bincount(b[k], g, m), np.bincount(b[k], h, m))
                self.tables[k] += step
                f += step[b[k]]

        def joint(i: int, j: int, v: np.ndarray) -> np.ndarray:
            p, q = len(self.tables[i]), len(self.tables[j])
            return np.bincount(b[i] * q + b[j], v, p * q).reshape(p, q)

        g, h = left()
        gains = sorted(((shallow_pair_tree(joint(i, j, g), joint(i, j, h))[1], i, j) for i, j in combinations(range(d), 2)), reverse=True)
        self.pairs = [(i, j, np.zeros((len(self.tables[i]), len(self.tables[j])))) for _, i, j in gains[:PAIRS]]
        for _ in range(PAIR_ROUNDS):
            for i, j, t in self.pairs:
                g, h = left()
                step = RATE * shallow_pair_tree(joint(i, j, g), joint(i, j, h))[0]
                t += step
                f += step[b[i], b[j]]

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        f = np.full(len(x), self.base)
        for k, t in enumerate(self.tables):
            f += t[b[k]]
        for i, j, t in self.pairs:
            f += t[b[i], b[j]]
        return 1 / (1 + np.exp(-f))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Additive:
    """A model of docs (doc_id, text) by labels (doc_id, quality), from about `sample` labelled rows."""
    text_batches(docs.sparkSession)
    labels = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("double").alias("y"))
    n = labels.count()
    draw = F.pmod(F.xxhash64(F.lit("quality"), F.col("doc_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = labels.where(draw < min(1.0, sample / max(1, n)))  # about `sample` rows, so it can be broadcast
    names = [f"f{k}" for k in range(len(FEATURES))]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame(features(x["text"]), columns=names).assign(y=x["y"].to_numpy())

    rows = docs.join(F.broadcast(chosen), "doc_id").select("text", "y").mapInPandas(measure, ", ".join(f"{k} double" for k in [*names, "y"])).toPandas()
    rows = rows.sort_values([*names, "y"])  # the same sums at each run
    return Additive(rows[names].to_numpy(dtype=np.float64), rows["y"].to_numpy(dtype=np.float64))


def scored(docs: DataFrame, model: Additive, text: str = "text") -> DataFrame:
    """Rows (row: all of docs' columns, score)."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of fixed size

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(shared.value.score(features(x)))

    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text].alias("t"))
    return rows.select("row", F.pandas_udf(score, "double").asNondeterministic()("t").alias("score"))


def held_out(doc_id: Column) -> Column:
    return crc_mod(doc_id, 5) == 0


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = learn(docs, labels.where(~held_out(F.col("doc_id"))))
    out = scored(docs, model)
    return out.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))

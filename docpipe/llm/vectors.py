"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors are rotated to the principal axes of all vectors, dealt over blocks of dimensions so that each block has axes
of every spread. Two vectors whose cosine is at least c are at most 2 - 2c apart, squared; in one block at least they are
then within that block's share of it, in proportion to its dimensions. Each block is range-joined under its share: its
axes of the widest spread are cut into cells as wide as the range, a vector meets those of its own cell and of the next
ones, large cells are dealt into parts, and parts are swept along the first axis. A candidate is verified on the whole
vectors where it is found, and counted in the first block whose share it keeps alone, so no pairs are written out: a
pair of parts gives each vector the number of its links there and a root of the group it hangs together with there. Rotated
vectors travel in single precision; the few pairs whose cosine that leaves open are verified in double precision.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of unlike
lengths do not link; equal vectors, and repeated rows, are one class, linked with each other; rows whose id is null
link as others do, and a group without any id has a null component; an id that occurs with different vectors is a row each time, as ids only label classes and
their groups, the smallest of them; a cosine of exactly c links; very long vectors are rotated at random instead; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import product

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docpipe.llm.common import labelled_components, table, written

BLOCKS, PART, STRIP = 4, 32_768, 128
#: Axes of a block that are cut into cells, at most: the first, and others that spread as wide as the range.
GRID = 3
#: Vectors up to this length, of the most frequent lengths, are rotated to their principal axes; others at random.
AXES_DIM, AXES_KINDS, SUMS = 512, 16, 16
#: Pairs verified at once. What single precision leaves open of a cosine.
PAIRS, OPEN = 32_768, 1e-6
#: Components up to which their labels are broadcast.
BROADCAST_ROWS = 500_000
CELL = "dim int, block int, cell long"
GROUP = ["dim", "block", "cell", "kind", "i", "j"]


@cache
def following(grid: int) -> list[tuple[int, ...]]:
    """Cells next to one's own, of each pair one: those that come later in order."""
    return [o for o in product((-1, 0, 1), repeat=grid) if o > (0,) * grid]


def packed(x) -> tuple[bytes | None, int]:
    """A vector's bytes, in single precision if that loses nothing, and its length; None if it links with nothing."""
    if x is None or len(x) == 0:
        return None, 0
    v = np.array([np.nan if c is None else c for c in x], dtype=np.float64) + 0.0  # -0.0 is 0.0
    if not np.isfinite(v).all() or not v.any():
        return None, len(v)
    single = v.astype(np.float32)
    return (single if (single == v).all() else v).tobytes(), len(v)


def unpacked(b: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(b, dtype=np.float32 if len(b) == 4 * dim else np.float64).astype(np.float64)


def units(packed_rows, dim: int) -> np.ndarray:
    v = np.stack([unpacked(b, dim) for b in packed_rows])
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


class Space:
    """The rotation, blocks and cells of vectors of one length. moments: number, sum and sum of outer products of the vectors."""

    def __init__(self, dim: int, cosine: float, moments: tuple[int, np.ndarray, np.ndarray] | None = None, seed: int = 42):
        if moments is None:
            self.turn, self.mid, spread = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))[0], np.zeros(dim), np.zeros(dim)
        else:
            n, total, outer = moments
            mean = total / n
            values, axes = np.linalg.eigh(outer / n - np.outer(mean, mean))
            blocks = min(BLOCKS, dim)
            widest = np.arange(dim)[::-1]
            order = np.concatenate([widest[k::blocks] for k in range(blocks)])  # each block takes its turn
            self.turn, spread = axes[:, order], np.sqrt(np.maximum(values[order], 0))
            self.mid = mean @ self.turn
        sizes = [len(range(k, dim, min(BLOCKS, dim))) for k in range(min(BLOCKS, dim))]
        self.cuts = [np.arange(e - n, e) for n, e in zip(sizes, np.cumsum(sizes), strict=True)]
        self.budgets = [(2 - 2 * cosine) * len(c) / dim + 1e-5 for c in self.cuts]
        self.widths = [np.sqrt(b) * (1 + 1e-6) for b in self.budgets]
        self.grids = [1 + int((spread[c[1:GRID]] >= w).sum()) for c, w in zip(self.cuts, self.widths, strict=True)]

    def rotated(self, v: np.ndarray) -> np.ndarray:
        return (v @ self.turn).astype(np.float32)

    def cells(self, y: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
        """(block, numbers of the own cell and of each that follows) of rotated vectors."""
        for k, c in enumerate(self.cuts):
            c = c[: self.grids[k]]
            own = np.floor((y[:, c].astype(np.float64) - self.mid[c]) / self.widths[k]).astype(np.int64)
            yield k, [code(own), *[code(own + np.array(o)) for o in following(len(c))]]

    def apart(self, block: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Squared distances in a block, summed in one order whatever the batch."""
        out = np.zeros(len(x))
        for c in self.cuts[block]:
            d = x[:, c].astype(np.float64) - y[:, c]
            out += d * d
        return out


def code(cells: np.ndarray) -> np.ndarray:
    out = np.zeros(len(cells), dtype=np.int64)
    for k in range(cells.shape[1]):
        out = out * 65_536 + (cells[:, k] + 32_768)
    return out


class Roots:
    """Roots of vertices that hang together."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def meet(self, u: np.ndarray, v: np.ndarray) -> None:
        while True:
            u, v = self.of[u], self.of[v]
            other = u != v
            if not other.any():
                return
            u, v = u[other], v[other]
            np.minimum.at(self.of, np.maximum(u, v), np.minimum(u, v))
            while (self.of[self.of] != self.of).any():
                self.of = self.of[self.of]


def joined(x: pd.DataFrame, space: Space, cosine: float) -> pd.DataFrame | None:
    """Rows (cid, links, root, other) of two parts. kind 0: parts of one cell; 1: a cell's part and its guests'. other: a vector that is linked if its cosine is enough."""
    kind, i, j, block = (x[k].iloc[0] for k in ("kind", "i", "j", "block"))
    side, ids, copies = x["side"].to_numpy(), x["cid"].to_numpy(), x["copies"].to_numpy()
    y = np.frombuffer(b"".join(x["vec"]), dtype=np.float32).reshape(len(x), -1)
    p = y[:, space.cuts[block]]
    first, second = (0, 1) if kind else (i, j)
    same = not kind and i == j
    a = np.flatnonzero(side == first)
    b = np.flatnonzero(side == second)
    a, b = a[np.argsort(p[a, 0], kind="stable")], b[np.argsort(p[b, 0], kind="stable")]
    if not len(a) or not len(b):
        return None
    # Squared distances as one product: |x|^2 - 2 xy + |y|^2; the sum decides on those near the share.
    norm, one = (p * p).sum(axis=1, keepdims=True), np.ones((len(p), 1), dtype=np.float32)
    left, right = np.hstack([-2 * p, norm, one])[a], np.ascontiguousarray(np.hstack([p, one, norm])[b].T)
    at, reach, near = p[b, 0], np.float32(space.widths[block] * (1 + 1e-5)), np.float32(space.budgets[block] + 1e-5)
    links, roots, open_ = np.zeros(len(x)), Roots(len(x)), []
    for k in range(0, len(a), STRIP):
        rows = a[k : k + STRIP]
        low, high = np.searchsorted(at, p[rows[0], 0] - reach), np.searchsorted(at, p[rows[-1], 0] + reach, side="right")
        low = max(low, k) if same else low
        if low >= high:
            continue
        hit = np.flatnonzero((left[k : k + STRIP] @ right[:, low:high]).ravel() <= near)
        if same and len(hit):  # of a part with itself, each pair once
            hit = hit[hit // (high - low) + k < hit % (high - low) + low]
        if not len(hit):
            continue
        r, c = np.divmod(hit, high - low)
        if len(hit) * 8 > len(rows) * (high - low):
            cos = (y[rows].astype(np.float64) @ y[b[low:high]].astype(np.float64).T).ravel()[hit]
        else:
            cos = np.concatenate([np.einsum("ij,ij->i", y[rows[r[m : m + PAIRS]]].astype(np.float64), y[b[low + c[m : m + PAIRS]]].astype(np.float64)) for m in range(0, len(hit), PAIRS)])
        u, v, sure = rows[r], b[low + c], cos >= cosine + OPEN
        keep = cos >= cosine - OPEN
        u, v, sure = u[keep], v[keep], sure[keep]
        if not len(u):
            continue
        first_of = np.concatenate([first_block(space, block, y[u[m : m + PAIRS]], y[v[m : m + PAIRS]]) for m in range(0, len(u), PAIRS)])
        for s, w in zip(u[first_of & ~sure].tolist(), v[first_of & ~sure].tolist(), strict=True):
            open_.append((int(ids[s]), 0, int(ids[s]), int(ids[w])))
        u, v = u[first_of & sure], v[first_of & sure]
        links += np.bincount(u, copies[v], len(x)) + np.bincount(v, copies[u], len(x))
        roots.meet(u, v)
    some = np.flatnonzero(links)
    out = pd.DataFrame({"cid": ids[some], "links": links[some].astype(np.int64), "root": ids[roots.of[some]], "other": pd.array([None] * len(some), dtype="Int64")})
    return pd.concat([out, pd.DataFrame(open_, columns=out.columns).astype({"other": "Int64"})]) if open_ else out if len(out) else None


def first_block(space: Space, block: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the block is the first whose share a pair keeps."""
    out = space.apart(block, x, y) <= space.budgets[block]
    for k in range(block):
        out &= space.apart(k, x, y) > space.budgets[k]
    return out


def moments_of(every: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Number, sum and sum of outer products of all unit vectors, by length; of AXES_KINDS lengths at most."""
    lengths = [x["dim"] for x in every.where(F.col("dim") <= AXES_DIM).groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(AXES_KINDS).collect()]
    schema = "dim int, part int, n long, total binary, outer binary"

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, list] = {}
        for x in batches:
            for dim, y in x.groupby("dim"):
                v = units(y["vec"], int(dim))
                old = sums.setdefault(int(dim), [0, 0.0, 0.0])
                sums[int(dim)] = [old[0] + len(v), old[1] + v.sum(axis=0), old[2] + v.T @ v]
        part = TaskContext.get().partitionId() % SUMS
        for dim, (n, total, outer) in sums.items():
            yield pd.DataFrame({"dim": [dim], "part": [part], "n": [n], "total": [total.tobytes()], "outer": [outer.tobytes()]})

    def add(x: pd.DataFrame) -> pd.DataFrame:
        total, outer = (sum(np.frombuffer(b) for b in x[c]).tobytes() for c in ("total", "outer"))
        return pd.DataFrame({"dim": x["dim"][:1], "part": x["part"][:1], "n": [x["n"].sum()], "total": [total], "outer": [outer]})

    rows = every.where(F.col("dim").isin(lengths)).mapInPandas(add_up, schema).groupBy("dim", "part").applyInPandas(add, schema)
    out = {}
    for x in rows.collect():  # SUMS rows a length at most
        n, total, outer = out.get(x["dim"], (0, 0.0, 0.0))
        out[x["dim"]] = n + x["n"], total + np.frombuffer(x["total"]), outer + np.frombuffer(x["outer"]).reshape(x["dim"], x["dim"])
    return out


class Join:
    """The join of rows (vec_id, embedding) with itself."""

    def __init__(self, rows: DataFrame, cosine: float = 0.9):
        def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for x in batches:
                got = [packed(e) for e in x]
                yield pd.DataFrame({"key": [b and hashlib.blake2b(unpacked(b, d).tobytes(), digest_size=16).digest() for b, d in got], "vec": [b for b, _ in got], "dim": [d for _, d in got]})

        signature = F.pandas_udf(sign, "key binary, vec binary, dim int").asNondeterministic()("embedding")
        signed, _ = written(rows.select("vec_id", signature.alias("s")).select("vec_id", "s.*"), "signed")
        self.signed = signed.select("vec_id", "key")
        by_key = signed.where("key is not null").groupBy("key")
        # A class is its key; cid is a number for it, label the smallest id.
        classes = by_key.agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.first("vec").alias("vec"), F.first("dim").alias("dim"))
        classes = classes.select("key", F.monotonically_increasing_id().alias("cid"), F.col("low").alias("label"), "copies", "vec", "dim")
        self.classes, _ = written(classes, "classes")
        every = self.classes.select("cid", "copies", "vec", "dim")
        moments, spaces = rows.sparkSession.sparkContext.broadcast(moments_of(every)), {}

        def space(dim: int) -> Space:
            if dim not in spaces:
                spaces[dim] = Space(dim, cosine, moments.value.get(dim))
            return spaces[dim]

        def placed(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame, np.ndarray, int, bool, np.ndarray]]:
            for x in batches:
                for dim, of_dim in x.groupby("dim"):
                    y = space(int(dim)).rotated(units(of_dim["vec"], int(dim)))
                    for block, cells in space(int(dim)).cells(y):
                        for k, c in enumerate(cells):
                            yield int(dim), of_dim, y, block, k == 0, c

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for dim, _, _, block, home, c in placed(batches):
                u, n = np.unique(c, return_counts=True)
                yield pd.DataFrame({"dim": dim, "block": block, "cell": u, "home": n * home, "guests": n * (not home)})

        sizes = every.mapInPandas(count, f"{CELL}, home long, guests long").groupBy("dim", "block", "cell").agg(F.sum("home").alias("home"), F.sum("guests").alias("guests"))
        # Unit vectors have as many cells as the ranges fit in two: a number that does not grow with the rows.
        parts = {(x["dim"], x["block"], x["cell"]): (-(-x["home"] // PART), -(-x["guests"] // PART)) for x in sizes.collect()}
        shared = rows.sparkSession.sparkContext.broadcast(parts)

        def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for dim, x, y, block, home, c in placed(batches):
                ids, copies = x["cid"].to_numpy(), x["copies"].to_numpy()
                spread = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
                cell, at = np.unique(c, return_inverse=True)
                n, m = np.array([shared.value[dim, block, k] for k in cell.tolist()], dtype=np.int64).T[:, at]
                own, guest = spread % np.maximum(n, 1), spread % np.maximum(m, 1)
                for k in range(int(n.max())):  # of a part with each of the cell's; of a guest with each
                    r = np.flatnonzero((k < n) & (home | (m > 0)))
                    if len(r):
                        i, j, side = (np.minimum(own, k), np.maximum(own, k), own) if home else (np.full(len(c), k), guest, np.ones(len(c), dtype=np.int64))
                        yield dealt_rows(dim, block, c, 0 if home else 1, i, j, side, ids, copies, y, r)
                for k in range(int(m.max()) if home else 0):
                    r = np.flatnonzero((k < m) & (n > 0))
                    if len(r):
                        yield dealt_rows(dim, block, c, 1, own, np.full(len(c), k), np.zeros(len(c), dtype=np.int64), ids, copies, y, r)

        def dealt_rows(dim, block, cell, kind, i, j, side, ids, copies, y, r) -> pd.DataFrame:
            return pd.DataFrame({"dim": dim, "block": block, "cell": cell[r], "kind": kind, "i": i[r], "j": j[r], "side": side[r], "cid": ids[r], "copies": copies[r], "vec": [v.tobytes() for v in y[r]]})

        def range_join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            def whole(x: pd.DataFrame) -> Iterator[pd.DataFrame]:
                if (out := joined(x, space(int(x["dim"].iloc[0])), cosine)) is not None:
                    yield out

            rest: list[pd.DataFrame] = []
            for x in batches:
                key = x[GROUP].to_numpy()
                if rest and (rest[-1][GROUP].iloc[-1].to_numpy() != key[0]).any():
                    yield from whole(pd.concat(rest))
                    rest = []
                cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
                for low, high in zip(np.r_[0, cut], cut):
                    yield from whole(pd.concat([*rest, x.iloc[low:high]]))
                    rest = []
                rest.append(x.iloc[cut[-1] :] if len(cut) else x)
            if rest:
                yield from whole(pd.concat(rest))

        dealt = every.mapInPandas(deal, f"{CELL}, kind int, i int, j int, side int, cid long, copies long, vec binary")
        # A group is one run of rows: two parts, of about PART vectors each.
        found = dealt.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInPandas(range_join, "cid long, links long, root long, other long")
        found, _ = written(found, "found")
        left = every.select(F.col("cid").alias("a"), F.col("vec").alias("va"), "dim")
        right = every.select(F.col("cid").alias("b"), F.col("vec").alias("vb"))

        def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in batches:
                for dim, y in x.groupby("dim"):
                    cos = (units(y["va"], int(dim)) * units(y["vb"], int(dim))).sum(axis=1)
                    yield y.loc[cos >= cosine, ["a", "b"]]

        open_ = found.where("other is not null").select(F.col("cid").alias("a"), F.col("other").alias("b"))
        self.pairs, _ = written(open_.join(left, "a").join(right, "b").mapInPandas(verify, "a long, b long"), "pairs")
        self.found = found.where("other is null").drop("other")

    def linked(self) -> DataFrame:
        """Rows (vec_id, n_links, component_id, kept); of a group one vector is kept, and rows equal to it."""
        both = self.pairs.union(self.pairs.select("b", "a"))
        more = both.join(self.classes.select(F.col("cid").alias("b"), "copies"), "b").select(F.col("a").alias("cid"), F.col("copies").alias("links"))
        links = self.found.select("cid", "links").union(more).groupBy("cid").agg(F.sum("links").alias("links"))
        edges = self.found.select(F.col("cid").alias("a"), F.col("root").alias("b")).union(self.pairs)
        roots = labelled_components(edges, self.classes, BROADCAST_ROWS)
        classes = self.classes.select("key", "cid", "label", "copies").join(links, "cid", "left").join(roots, "cid", "left")
        out = self.signed.join(classes, "key", "left")
        return out.select(
            "vec_id",
            (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
            F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.coalesce("component", "label")).alias("component_id"),
            F.when(F.col("vec_id").isNotNull(), F.col("key").isNull() | ((F.col("vec_id") == F.col("label")) & (F.coalesce("head", "key") == F.col("key")))).alias("kept"),
        )

    def rows(self) -> DataFrame:
        """Rows (vec_id, n_links, component_id)."""
        return self.linked().drop("kept")


def query(spark, sf_dir: str) -> DataFrame:
    return Join(table(spark, sf_dir, "embeddings")).linked()


#: Exact, by all pairs of rows.
SQL = """
with recursive r as (select row_number() over () as rid, vec_id, embedding from embeddings),
v as (select rid, list_transform(embedding, lambda x: x::double) as e from r where embedding is not null),
u as (select rid, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as n from v),
near as (select a.rid as a, b.rid as b from u a join u b on a.rid <> b.rid and a.n > 0 and b.n > 0 and len(a.e) = len(b.e) where list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
links as (select a as rid, count(*) as n_links from near group by 1),
reach as (select rid as a, rid as b from r union select reach.a, near.b from reach join near on reach.b = near.a),
comp as (select a as rid, min(r.vec_id) as component_id from reach join r on reach.b = r.rid group by 1)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, vec_id = component_id as kept from r join comp using (rid) left join links using (rid)
"""

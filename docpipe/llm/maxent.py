"""Language-model scoring by a hashed maximum-entropy model.

A softmax over classes gives a token's class, then the class gives the word. Some classes are the same everywhere, by words'
endings; two depend on the context: the words that came after the last two words (trigram), and after the last one (bigram).

The lasting classes: a softmax over them, then over a class's slots, then over a slot's members. A class's most frequent words,
7,680 in all, are members of slots; all others share one slot, within which a word has its smoothed share of the class's counts.
The softmaxes add the weights of hashed features of the context: for all three the word before, and the commonest of the last
eight, which skips the others; for classes the last two words together, too. Weights are learned by distributed gradient updates: each task runs adaptive gradient steps over its own
documents from the common weights, and each weight becomes the mean of the tasks' by the gradients that made it, first over
a part of the documents, then over all of them.

The context's classes: all tokens are dealt by a hash of the words before, so that a shard holds all that came after its
contexts, in numbers that grow with the corpus: how often each word did in training, of how many, and how many different
words. A softmax over the three kinds of classes, whose features are the ranges of those numbers, is learned by gradient
steps in each shard from its own training tokens, each judged without itself. Contexts of very frequent words are dealt by
more of the text, so that no shard outgrows the others. Scoring works on batches of sparse rows throughout: tokens travel
packed, some thousand to a row. Counts of the most frequent words, bounded in number, are broadcast; those of all others are
dealt to the same shards by a hash of the word, and meet the texts' words there (in the model these share a mean count).

Cases: null counts as the empty text, which is one end token; with nothing to learn from, every text has its uniform
score; very long texts are cut into steps, not shortened; ties in frequency go to the smaller word; repeated rows are scored
each, and learned from each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docpipe.llm.common import crc_mod, table, text_batches, written

CLASSES, SLOTS, MEMBERS = 32, 16, 16
#: Features of the classes' softmax, of the slots' and of the members'; rows of hashed features of each; words among which the commonest is sought.
CLASS_FEATURES, SLOT_FEATURES, CLASS_ROWS, SLOT_ROWS, MEMBER_ROWS, LAST = 3, 2, 32_768, 32_768, 32_768, 8
#: A word's place: its slot and, in it, its member. Place 0 is that of all words without one of their own.
PLACES = SLOTS * MEMBERS
#: Words whose counts are broadcast, at most.
FREQUENT = 300_000
#: Tokens of a gradient step and of a scoring batch; the step's size; one of so many documents is in the first round.
STEP_TOKENS, RATE, FIRST = 32_768, 0.5, 8
#: Rows of weights, or tokens, that are worked on at once.
SLICE = 2_048
#: Tokens that a task learns from, at least and at most, about: it sends as many weights on whatever it has read.
LEARN_TOKENS = 1_000_000, 20_000_000
#: Tokens of a row of weights in a step from which on they are added on their own.
MANY = 64
#: A feature's weight up to which the products of exponentials fit into 32 bits, whatever the bias: it is -30 at least.
LARGE = 17
#: Texts split at once.
CHUNK = 2_000
#: Values of a block of weights on the way to the average.
BLOCK = 16_384
#: Tokens of a shard of contexts, about; tokens that a task holds before it deals them; shares of a shard above which a word's contexts are parted.
SHARD_TOKENS, DEALT_TOKENS, PARTED = 1_000_000, 500_000, 4
#: Tokens that a task holds for each shard, about, if these are more: a shard's share of them is packed at a time, and takes as long however small. Tokens and texts held at most.
SHARE_TOKENS, DEALT_MOST = 1_000, (4_000_000, 20_000)
#: Bytes of words that a task holds at most, about, before it deals their counts.
HELD_BYTES = 1 << 26
#: Steps of a log10 probability on its way to a shard.
FINE = 512
#: Ranges of a context's numbers; gradient steps of a shard's softmax; the prior of its classes, as so many tokens.
RANGES, SHARD_STEPS, PRIOR, PRIOR_TOKENS = 24, 4, np.array([0.3, 0.3, 0.4], dtype=np.float32), 4.0
END = b""
COUNTS = "token binary, n long"
#: The weights: features and bias of classes, of slots and of members.
SHAPES = [(CLASS_FEATURES, CLASS_ROWS, CLASSES), (CLASSES,), (SLOT_FEATURES, SLOT_ROWS, SLOTS), (CLASSES, SLOTS), (SLOT_FEATURES, MEMBER_ROWS, MEMBERS), (CLASSES * SLOTS, MEMBERS)]
SPLIT = np.cumsum([np.prod(x) for x in SHAPES])
SIZE = int(SPLIT[-1])


def split(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of texts, A-Z lowered, as numbers into their distinct words; and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    doc = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    flat = lists.flatten()
    some = pc.greater(pc.binary_length(flat), 0)  # white space at either end leaves an empty piece
    full = flat.filter(some).dictionary_encode()
    return full, np.bincount(doc[some.to_numpy(zero_copy_only=False)], minlength=len(texts))


class Weights:
    """Views of one vector: features and bias of classes, slots and members."""

    def __init__(self, flat: np.ndarray):
        self.flat, self.room = flat, Room()
        self.c, self.cb, self.s, self.sb, self.m, self.mb = (x.reshape(shape) for x, shape in zip(np.split(flat, SPLIT[:-1]), SHAPES, strict=True))

    @cached_property
    def factors(self) -> Weights | None:
        """The exponentials of weights that learn no more, the classes' bias in those of the first feature; None if products of them may not fit."""
        if max(np.abs(x).max() for x in (self.c, self.s, self.m)) > LARGE:
            return None
        out = Weights(np.exp(self.flat))
        out.c[0] *= out.cb
        return out


class Room:
    """Memory of a step that the next one takes again: fetching it from the system for each array costs as much as the sums in it."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def of(self, name: str, rows: int, columns: int) -> np.ndarray:
        if name not in self.held or self.held[name].size < rows * columns:
            self.held[name] = np.empty(rows * columns, dtype=np.float32)
        return self.held[name][: rows * columns].reshape(rows, columns)


@cache
def class_table() -> np.ndarray:
    """The class of each ending: of two bytes by their number, of one byte from 65,536 on; then the end's."""
    two = [zlib.crc32(bytes((k >> 8, k & 255))) % CLASSES for k in range(65_536)]
    return np.array([*two, *[zlib.crc32(bytes((k,))) % CLASSES for k in range(256)], zlib.crc32(END) % CLASSES], dtype=np.int64)


def numbers_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes and classes of words (binary, none empty)."""
    at = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]].astype(np.uint64)
    at = at - at[0]
    size = np.diff(at)
    place = np.arange(len(raw)) - np.repeat(at[:-1], size)
    power = np.full(int(size.max()) + 1, 0x9E3779B97F4A7C15, dtype=np.uint64).cumprod()
    h = np.add.reduceat((raw + np.uint64(1)) * power[place], at[:-1])
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    last = raw[at[1:] - 1].astype(np.int64)
    before = raw[np.maximum(at[1:] - 2, 0)].astype(np.int64)
    return ((h >> np.uint64(32)) | np.uint64(1)).astype(np.int64), class_table()[np.where(size > 1, before * 256 + last, 65_536 + last)]


def with_end(words: pa.Array) -> pa.Array:
    return pa.concat_arrays([words, pa.array([END], pa.binary())])


class Lexicon:
    """What is known of words. head: (words, places); frequent: (words, counts)."""

    def __init__(self, head: tuple[pa.Array, np.ndarray], frequent: tuple[pa.Array, np.ndarray]):
        self.head, self.frequent = head, frequent

    def rows_of(self, words: pa.Array) -> np.ndarray:
        """Rows hash, class, place, count (-1: not among the frequent) of words and, last, of the end."""
        out = np.empty((4, len(words) + 1), dtype=np.int64)
        if len(words):
            out[0, :-1], out[1, :-1] = numbers_of(words)
        out[:2, -1] = 1, class_table()[-1]
        every = with_end(words)
        for k, (known, values), other in ((2, self.head, 0), (3, self.frequent, -1)):
            i = pc.fill_null(pc.index_in(every, value_set=known), -1).to_numpy()
            out[k] = np.where(i >= 0, np.append(values, other)[i], other)
        return out

    def batches(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
        """(rows of tokens, numbers of tokens, each one's text from 0, the texts, the distinct tokens) for runs of texts of about STEP_TOKENS."""
        for low in range(0, len(texts), CHUNK):
            part = texts.slice(low, CHUNK)
            full, sizes = split(part)
            words = full.dictionary.cast(pa.binary())
            rows, every = self.rows_of(words), with_end(words)
            ends = np.cumsum(sizes + 1)
            ids = np.full(int(ends[-1]), len(words), dtype=np.int64)
            inner = np.ones(len(ids), dtype=bool)
            inner[ends - 1] = False
            ids[inner] = full.indices.to_numpy()
            doc = np.repeat(np.arange(len(part)), sizes + 1)
            first = 0
            while first < len(part):
                at = int(ends[first] - sizes[first] - 1)
                last = min(len(part), max(first + 1, int(np.searchsorted(ends, at + STEP_TOKENS, side="right"))))
                here = ids[at : ends[last - 1]]
                yield rows[:, here], here, doc[at : ends[last - 1]] - first, np.arange(low + first, low + last), every
                first = last


def commonest(h: np.ndarray, c: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each token, of the last words before it in its text the one of the highest count; 0 where none is among the frequent."""
    value = np.where((c > 0) & (h != 1), (c.astype(np.int64) << 32) | h, 0)  # the end is no word
    out = np.zeros_like(value)
    for k in range(1, min(LAST, len(h) - 1) + 1):
        np.maximum(out[k:], np.where(doc[k:] == doc[:-k], value[:-k], 0), out=out[k:])
    return (out & 0xFFFFFFFF).astype(np.uint64)


def context(h: np.ndarray, c: np.ndarray, doc: np.ndarray, cls: np.ndarray, place: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Rows of the features of each token: for its class, for its slot and for its member."""
    skip = commonest(h, c, doc) + np.uint64(1 << 34)
    one, two = np.zeros(len(h), dtype=np.uint64), np.zeros(len(h), dtype=np.uint64)
    one[1:] = np.where(doc[1:] == doc[:-1], h[:-1], 0)
    two[2:] = np.where(doc[2:] == doc[:-2], h[:-2], 0)
    both = one * np.uint64(0xC2B2AE3D27D4EB4F) + two + np.uint64(1 << 35)
    mix = lambda x, rows: (((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) & np.uint64(rows - 1)).astype(np.int64)
    k = cls.astype(np.uint64) << np.uint64(36)
    m = (cls * SLOTS + place // MEMBERS).astype(np.uint64) << np.uint64(36)
    return [mix(x, CLASS_ROWS) for x in (one, skip, both)], [mix(x + k, SLOT_ROWS) for x in (skip, one)], [mix(x + m, MEMBER_ROWS) for x in (skip, one)]


def exponentials(table: np.ndarray, bias: np.ndarray, rows: list[np.ndarray], bias_rows: np.ndarray | None = None) -> Iterator[tuple[slice, np.ndarray]]:
    """(tokens, the exponentials of their sums of weights), for so many tokens at once that they stay near. The next ones take the same memory."""
    held = np.empty((2, min(SLICE, len(rows[0])), table.shape[2]), dtype=table.dtype)
    for low in range(0, len(rows[0]), SLICE):
        at = slice(low, low + SLICE)
        x, more = held[:, : len(rows[0][at])]
        table[0].take(rows[0][at], axis=0, out=x, mode="clip")
        x += bias if bias_rows is None else bias.take(bias_rows[at], axis=0, out=more, mode="clip")
        for k in range(1, len(rows)):
            x += table[k].take(rows[k][at], axis=0, out=more, mode="clip")
        if x.max() > 60:  # far above what weights reach
            np.minimum(x, 60, out=x)
        yield at, np.exp(x, out=x)


def row_sums(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij->i", x)  # no product of matrices: its threads wait for one another


def soft(table: np.ndarray, bias: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    out = np.empty((len(rows[0]), table.shape[2]), dtype=table.dtype)
    for at, x in exponentials(table, bias, rows):
        np.divide(x, row_sums(x)[:, None], out=out[at])
    return out


def soft_of(table: np.ndarray, bias: np.ndarray, rows: list[np.ndarray], target: np.ndarray, bias_rows: np.ndarray | None = None) -> np.ndarray:
    """The softmax of each token's target alone."""
    out = np.empty(len(target), dtype=table.dtype)
    for at, x in exponentials(table, bias, rows, bias_rows):
        np.divide(x[np.arange(len(x)), target[at]], row_sums(x), out=out[at])
    return out


def soft_by_factors(tables: list[np.ndarray], rows: list[np.ndarray], target: np.ndarray) -> np.ndarray:
    """The same from the exponentials of weights: of each table, two or more, one row is a factor."""
    n = len(target)
    out, each = np.empty(n, dtype=tables[0].dtype), np.arange(min(SLICE, n))
    held = np.empty((2, len(each), tables[0].shape[1]), dtype=tables[0].dtype)
    for low in range(0, n, SLICE):
        t = target[low : low + SLICE]
        at, (x, y) = slice(low, low + len(t)), held[:, : len(t)]
        tables[0].take(rows[0][at], axis=0, out=x, mode="clip")
        for k in range(1, len(rows)):
            tables[k].take(rows[k][at], axis=0, out=y, mode="clip")
            if k < len(rows) - 1:
                x *= y
        k = each[: len(t)]
        np.divide(x[k, t] * y[k, t], np.einsum("ij,ij->i", x, y), out=out[at])
    return out


def with_places(h: np.ndarray, c: np.ndarray, doc: np.ndarray, cls: np.ndarray, place: np.ndarray) -> tuple[list, list, np.ndarray, list, np.ndarray]:
    """Rows for classes and for slots; the tokens with a place of their own, their rows for members and their slots among all."""
    a, b, m = context(h, c, doc, cls, place)
    own = np.flatnonzero(place)
    return a, b, own, [x[own] for x in m], cls[own] * SLOTS + place[own] // MEMBERS


def log_probability(w: Weights, h: np.ndarray, c: np.ndarray, doc: np.ndarray, cls: np.ndarray, place: np.ndarray) -> np.ndarray:
    """log10 of the probability of each token's class and place."""
    a, b, own, m, slot = with_places(h, c, doc, cls, place)
    in_slot, member, e = place // MEMBERS, place[own] % MEMBERS, w.factors
    if e is None:
        p = (soft_of(w.c, w.cb, a, cls) * soft_of(w.s, w.sb, b, in_slot, cls)).astype(np.float64)
        p[own] *= soft_of(w.m, w.mb, m, member, slot)
    else:
        p = (soft_by_factors([*e.c], a, cls) * soft_by_factors([*e.s, e.sb], [*b, cls], in_slot)).astype(np.float64)
        p[own] *= soft_by_factors([*e.m, e.mb], [*m, slot], member)
    return np.log10(np.maximum(p, 1e-30))


def put(x: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """x[rows] = values, each row of x as one item."""
    item = np.dtype((np.void, x.strides[0]))
    np.put(x.reshape(-1).view(item), rows, np.ascontiguousarray(values).reshape(-1).view(item))


def summed(rows: np.ndarray, g: np.ndarray, room: Room | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, in order, and the sum of g's over each: of rows with many, each on its own; of the others the second g's, then the third ones.

    np.add.at and np.add.reduceat add the same one by one, and take up to 30 or 100 ns for each. The sums are in room.
    """
    room, d = room or Room(), g.shape[1]
    if len(rows) and rows.max() < 65_536:
        rows = rows.astype(np.uint16)
    order = np.argsort(rows, kind="stable")
    met = rows[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(met)), dtype=bool), met[1:] != met[:-1]]))
    size = np.diff(first, append=len(met))
    out = g.take(order[first], axis=0, out=room.of("sums", len(first), d), mode="clip")
    more = np.flatnonzero(size > 1)
    more = more[np.argsort(-np.minimum(size[more], MANY).astype(np.int16), kind="stable")]
    start, ends = first[more], np.searchsorted(-size[more].clip(max=MANY), -np.arange(MANY + 1), side="right")  # how many rows have k g's or more
    many = int(ends[MANY])
    for k in range(many):
        r = order[start[k] : start[k] + size[more[k]]]
        np.add.reduce(g.take(r, axis=0, out=room.of("others", len(r), d), mode="clip"), axis=0, out=out[more[k]])
    more, start = more[many:], start[many:]
    x = out.take(more, axis=0, out=room.of("few", len(more), d), mode="clip")
    for k in range(1, MANY - 1):
        n = int(ends[k + 1]) - many
        if not n:
            break
        x[:n] += g.take(order[start[:n] + k], axis=0, out=room.of("others", n, d), mode="clip")
    put(out, more, x)
    return met[first].astype(np.int64), out


def learn_step(w: Weights, seen: Weights, h: np.ndarray, c: np.ndarray, doc: np.ndarray, cls: np.ndarray, place: np.ndarray) -> None:
    """One adaptive gradient step on a batch. seen: the sums of squared gradients."""
    room = seen.room

    def step(x: np.ndarray, total: np.ndarray, rows: np.ndarray, g: np.ndarray) -> None:
        met, sums = summed(rows, g, room)
        for low in range(0, len(met), SLICE):
            r, s = met[low : low + SLICE], sums[low : low + SLICE]
            t, y = (room.of(name, *s.shape) for name in ("total", "other"))
            total.take(r, axis=0, out=t, mode="clip")
            t += np.multiply(s, s, out=y)
            put(total, r, t)
            t += 1
            np.sqrt(t, out=t)
            s /= t
            s *= RATE
            s += x.take(r, axis=0, out=y, mode="clip")
            put(x, r, s)

    def learn(x: np.ndarray, bias: np.ndarray, total: np.ndarray, rows: list[np.ndarray], target: np.ndarray, bias_rows: np.ndarray | None = None) -> None:
        g = room.of("gradients", len(target), x.shape[2])
        for at, y in exponentials(x, bias, rows, bias_rows):
            np.divide(y, -row_sums(y)[:, None], out=g[at])
        g[np.arange(len(g)), target] += 1
        for k, r in enumerate(rows):
            step(x[k], total[k], r, g)

    a, b, own, m, slot = with_places(h, c, doc, cls, place)
    learn(w.c, w.cb, seen.c, a, cls)
    learn(w.s, w.sb, seen.s, b, place // MEMBERS, cls)
    learn(w.m, w.mb, seen.m, m, place[own] % MEMBERS, slot)


def short(x: np.ndarray) -> np.ndarray:
    """Numbers in 8 bits: sign, exponent and the first two places of a 16-bit number, rounded."""
    return ((x.astype(np.float16).view(np.uint16) + np.uint16(128)) >> np.uint16(8)).astype(np.uint8)


def long(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.uint16) << np.uint16(8)).view(np.float16).astype(np.float32)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def ranges(total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The range of a context's numbers: by powers of two up to 16, and by the share of different words."""
    size = (total > 0).astype(np.int16) + (total > 1) + (total > 2) + (total > 4) + (total > 8)
    return size * np.int16(4) + np.where(kinds <= 1, np.int16(0), np.int16(1) + (10 * kinds >= 3 * total) + (10 * kinds >= 8 * total))


def came_after(context: np.ndarray, word: np.ndarray, learn: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The range of each token's context, and its word's share of what came after that in training; and both for each training token without itself.

    The numbers are those of pairs of a context and a word, of which there are fewer than tokens: how often the word came after
    the context in training, of how many, and how many different words did.
    """
    key = (context.astype(np.uint64) << np.uint64(32)) | word
    order = np.argsort(key)
    key = key[order]
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    n = np.add.reduceat(learn[order].astype(np.int32), head)
    ctx = key[head] >> np.uint64(32)
    top = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]])
    words, tokens = np.diff(np.r_[top, len(head)]), np.diff(np.r_[head, len(key)])
    total, kinds = np.add.reduceat(n, top), np.add.reduceat((n > 0).astype(np.int32), top)
    each = lambda x: np.repeat(x, words)
    all_of = each(total)

    def back(x: np.ndarray) -> np.ndarray:
        out = np.empty(len(order), dtype=x.dtype)
        out[order] = np.repeat(x, tokens)
        return out

    share = lambda n, total: (n / np.maximum(total, 1)).astype(np.float32)
    without = np.where(n == 1, each(ranges(total - 1, kinds - 1)), each(ranges(total - 1, kinds)))
    return (back(each(ranges(total, kinds))), back(share(n, all_of))), (back(without)[learn], back(share(n - 1, all_of - 1))[learn])


class Gate:
    """The softmax over the classes of two words before, of the word before, and the lasting ones, by ranges of the contexts' numbers."""

    def __init__(self):
        self.weights = np.tile(np.log(PRIOR), (RANGES * RANGES, 1))

    def inputs(self, two, one, lasting) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each token's features, and its word's probability in each class. two, one: ranges and shares after the contexts."""
        return two[0].astype(np.int64) * RANGES + one[0], [two[1], one[1], lasting.astype(np.float32)]

    def shares(self) -> np.ndarray:
        """The classes' shares for all features; a context that was never met, whose range is one of the first four, has no class."""
        x = np.exp(self.weights)
        two, one = np.divmod(np.arange(len(x)), RANGES)
        x[two < 4, 0] = 0
        x[one < 4, 1] = 0
        return x / x.sum(axis=1, keepdims=True)

    def parts(self, features: np.ndarray, inside: list[np.ndarray]) -> list[np.ndarray]:
        """Each token's probability by way of each class."""
        return [p.take(features) * x for p, x in zip(np.ascontiguousarray(self.shares().T), inside, strict=True)]

    def learn(self, features: np.ndarray, inside: list[np.ndarray]) -> None:
        """Gradient steps, each weight's as long as its class is rare: by the tokens that the softmax expects in it."""
        n = np.bincount(features, minlength=len(self.weights))
        for _ in range(SHARD_STEPS):
            two, one, lasting = self.parts(features, inside)
            lasting += two
            lasting += one
            found = [np.bincount(features, x / lasting, len(n)) for x in (two, one)]
            now = np.exp(self.weights)
            now /= now.sum(axis=1, keepdims=True)
            expected = self.shares() * n[:, None]
            up = np.stack([*found, n - found[0] - found[1]], axis=1) - expected + PRIOR_TOKENS * (PRIOR - now)
            self.weights = (self.weights + up / (expected + PRIOR_TOKENS * now)).astype(np.float32)


def in_context(two: np.ndarray, one: np.ndarray, word: np.ndarray, lasting: np.ndarray, learn: np.ndarray) -> np.ndarray:
    """log10 probabilities of a shard's tokens. two, one: hashes of the two words before and of the one; lasting: probabilities by the lasting classes."""
    gate, (seen, without) = Gate(), zip(came_after(two, word, learn), came_after(one, word, learn), strict=True)
    if learn.any():
        gate.learn(*gate.inputs(*without, lasting[learn]))
    two, one, lasting = gate.parts(*gate.inputs(*seen, lasting))
    return np.log10(two.astype(np.float64) + one + lasting)


def counts(docs: DataFrame) -> DataFrame:
    """Rows (token, n) of all texts; each batch adds up before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                full, _ = split(x.column(0))
                n = np.bincount(full.indices.to_numpy(), minlength=len(full.dictionary))
                yield pa.record_batch([full.dictionary.cast(pa.binary()), pa.array(n)], names=["token", "n"])
                yield pa.record_batch([pa.array([END]), pa.array([x.num_rows])], names=["token", "n"])

    return docs.select("text").mapInArrow(count, COUNTS).groupBy("token").agg(F.sum("n").alias("n"))


#: Kinds of rows on their way: a text's own numbers, packed tokens by context, packed words, packed counts, and packed sums of both.
OWN, CONTEXTS, WORDS, COUNTS_OF_OTHERS, LP, SUMS = range(6)


def held_tokens(shards: int) -> int:
    """Tokens that a task holds before it deals them to so many shards: so that each shard's share, and the time for a token, stays about the same."""
    return max(DEALT_TOKENS, min(SHARE_TOKENS * shards, DEALT_MOST[0]))


def by_shard(shard: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each shard that has any, in order."""
    order = np.argsort(shard.astype(np.uint16) if shards <= 65_536 else shard, kind="stable")
    ends = np.searchsorted(shard[order], np.arange(shards + 1))
    for k in np.flatnonzero(np.diff(ends)).tolist():
        yield k, order[ends[k] : ends[k + 1]]


def planes(x: np.ndarray, width: int) -> np.ndarray:
    """The lowest bytes of numbers, all first bytes before all second ones: so they pack well."""
    return np.concatenate([(x >> type(x[0])(8 * k)).astype(np.uint8) for k in range(width)]) if len(x) else np.empty(0, dtype=np.uint8)


def whole(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) // width
    return sum(x[k * n : (k + 1) * n].astype(np.uint32) << np.uint32(8 * k) for k in range(width))


def pack(key: int, *arrays: np.ndarray) -> tuple[int, int, bytes]:
    """(key, size, bytes) of arrays."""
    raw = b"".join([np.array([len(x) for x in arrays], dtype=np.int64).tobytes(), *[x.tobytes() for x in arrays]])
    return key, len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes, size: int, *types: type) -> list[np.ndarray]:
    raw, at, out = pa.decompress(blob, decompressed_size=size, codec="zstd", asbytes=True), 8 * len(types), []
    for n, t in zip(np.frombuffer(raw, dtype=np.int64, count=len(types)).tolist(), types, strict=True):
        out.append(np.frombuffer(raw, dtype=t, count=n, offset=at))
        at += out[-1].nbytes
    return out


def by_frequency(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers, the most frequent first, and each one's place there: these pack well."""
    known, place = np.unique(x, return_inverse=True)
    order = np.argsort(-np.bincount(place, minlength=len(known)), kind="stable")
    at = np.empty(len(order), dtype=np.uint32)
    at[order] = np.arange(len(order), dtype=np.uint32)
    return known[order], at[place]


def bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ends and bytes of words."""
    at = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]]
    return (at - at[0])[1:].astype(np.int32), raw


def binary(ends: np.ndarray, raw: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.r_[np.int32(0), ends].astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])


def looked_up(asked: list[pa.Array], words: pa.Array, n: np.ndarray) -> list[np.ndarray]:
    """The counts of each list's words, 0 if not among words; all lists at once, since a look-up goes through all of words first."""
    at = pc.fill_null(pc.index_in(pa.concat_arrays(asked), value_set=words), len(words)).to_numpy()
    return np.split(np.append(n, 0)[at], np.cumsum([len(x) for x in asked])[:-1])


class MaxEnt:
    """A model of training documents (doc_id, text)."""

    def __init__(self, train: DataFrame):
        self.spark, self.train = train.sparkSession, train
        text_batches(self.spark, CHUNK)
        self.counts, _ = written(counts(train), "counts")
        cls = (F.crc32(F.substring("token", -2, 2)) % CLASSES).cast("int")
        known = self.counts.withColumn("cls", cls)
        # The classes' words with places of their own, the commonest first.
        rank = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("is_end"), F.desc("n"), "token"))
        top = known.withColumn("is_end", F.octet_length("token") == 0).withColumn("place", rank + (MEMBERS - 1)).where(F.col("place") < PLACES).collect()
        self.head = pa.array([bytes(x["token"]) for x in top], pa.binary()), np.array([x["place"] for x in top], dtype=np.int64)
        own = np.zeros((CLASSES, PLACES))
        for x in top:
            own[x["cls"], x["place"]] = x["n"]
        n, v = np.zeros(CLASSES), np.zeros(CLASSES)
        for x in known.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
            n[x["cls"]], v[x["cls"]] = x["n"], x["v"]
        self.tokens, self.types = int(n.sum()), int(v.sum())
        self.shared_n = n - own.sum(axis=1)
        #: The denominator of a word's share of its class's common slot; one more for all words never seen.
        self.shared = self.shared_n + v - (own > 0).sum(axis=1) + 1
        self.frequent = self._frequent()
        known = self.frequent[0].to_pylist()
        slotted = {bytes(x["token"]) for x in top}
        rest = pa.array([x for x in known if x not in slotted and x != END], pa.binary())
        of, n_of = (numbers_of(rest)[1] if len(rest) else np.empty(0, dtype=np.int64)), dict(zip(known, self.frequent[1].tolist(), strict=True))
        far_n = self.shared_n - np.bincount(of, [n_of[x] for x in rest.to_pylist()], CLASSES)
        far_v = v - (own > 0).sum(axis=1) - np.bincount(of, minlength=CLASSES)
        #: What a word that is not among the frequent counts in its class: the mean of them and of one never seen, with one more each.
        self.far = (far_n + far_v + 1) / (far_v + 1)
        flat = np.zeros(SIZE, dtype=np.float32)
        w = Weights(flat)
        slots = own.reshape(CLASSES, SLOTS, MEMBERS).sum(axis=2)
        slots[:, 0] = self.shared_n
        share = lambda x, some: np.where(some, np.log((x + 1) / (x.sum(axis=1, keepdims=True) + x.shape[1])), -30)
        w.cb[:] = np.log((n + 1) / (n.sum() + CLASSES))
        w.sb[:] = share(slots, (slots > 0) | (np.arange(SLOTS) == 0))
        own = own.reshape(CLASSES * SLOTS, MEMBERS)
        w.mb[:] = share(own, own > 0)
        self.weights = flat
        self.weights = self._learned(train.where(F.pmod(F.xxhash64("text"), F.lit(FIRST)) == 0), self.tokens // FIRST)
        self.weights = self._learned(train, self.tokens)

    def _frequent(self) -> tuple[pa.Array, np.ndarray]:
        """The counts of the most frequent words: all above the least power of 2 ** 0.25 that FREQUENT or fewer reach."""
        step = F.floor(F.log2(F.col("n").cast("double")) * 4)
        sizes = self.counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()  # some hundred rows at most
        least, total = None, 0
        for x in sizes:
            total += x["count"]
            if total > FREQUENT:
                break
            least = x["step"]
        self.others = self.counts if least is None else self.counts.where(step < least)
        if least is None:
            return pa.array([], pa.binary()), np.empty(0, dtype=np.int64)
        x = self.counts.where(step >= least).toArrow()
        return x["token"].combine_chunks().cast(pa.binary()), x["n"].to_numpy().astype(np.int64)

    def _learned(self, docs: DataFrame, tokens: int) -> np.ndarray:
        sc = self.spark.sparkContext
        least, most = LEARN_TOKENS
        tasks = max(1, min(sc.defaultParallelism, tokens // least), tokens // most)
        shared = sc.broadcast((self.weights, self.head, self.frequent))

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            start, head, frequent = shared.value
            w, seen, lexicon, n = Weights(start.copy()), Weights(np.zeros(SIZE, dtype=np.float32)), Lexicon(head, frequent), 0
            for x in batches:
                for (h, cls, slot, c), _, doc, _, _ in lexicon.batches(x.column(0)):
                    learn_step(w, seen, h, c, doc, cls, slot)
                    n += len(h)
            if n:
                change, by = short(w.flat - start), short(np.sqrt(seen.flat))
                for k in range(0, SIZE, BLOCK):
                    _, size, blob = pack(k, change[k : k + BLOCK], by[k : k + BLOCK])
                    yield pa.record_batch([pa.array([k], pa.int32()), pa.array([size], pa.int64()), pa.array([blob])], names=["block", "size", "blob"])

        def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A weight's changes count by the squared gradients that made them: tasks that never met a context leave it to those that did."""
            block, total, weight = None, 0.0, 0.0

            def finished() -> pa.RecordBatch:
                return pa.record_batch([pa.array([block], pa.int32()), pa.array([(total / np.maximum(weight, 1e-6)).astype(np.float32).tobytes()])], names=["block", "change"])

            for x in batches:
                for k, size, blob in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), x.column(2).to_pylist(), strict=True):
                    if block is not None and k != block:
                        yield finished()
                        total = weight = 0.0
                    change, by = map(long, unpack(blob, size, np.uint8, np.uint8))
                    block, square = k, by**2
                    total, weight = total + square * change, weight + square
            if block is not None:
                yield finished()

        rows = docs.select("text").coalesce(tasks).mapInArrow(learn, "block int, size long, blob binary").repartition("block").sortWithinPartitions("block")
        new = self.weights.copy()
        for x in rows.mapInArrow(mean, "block int, change binary").toLocalIterator():  # the weights: a vector of fixed size
            new[x["block"] : x["block"] + BLOCK] += np.frombuffer(x["change"], dtype=np.float32)
        return new

    def scored(self, docs: DataFrame, learned: str | None = None) -> DataFrame:
        """Rows (doc_id, n_tokens, n_known, train_tokens, base_score, score) for docs (doc_id, text).

        learned: a boolean column of docs, true for the training documents, all of which must be among docs. Without it
        the training documents are read beside docs.
        """
        sc = self.spark.sparkContext
        shared = sc.broadcast((self.weights, self.head, self.frequent))
        base = float(np.log10(self.tokens + self.types + 1))
        rest, far, tokens = np.log10(self.shared), np.log10(self.far), max(1, self.tokens)
        shards = max(1, -(-self.tokens // SHARD_TOKENS))
        kind = docs.schema["doc_id"].dataType.simpleString()
        texts = docs.select("doc_id", "text", (F.coalesce(F.col(learned), F.lit(False)) if learned else F.lit(False)).alias("learn"), F.lit(True).alias("score"))
        if not learned:
            texts = texts.union(self.train.select(F.lit(None).cast(kind), "text", F.lit(True), F.lit(False)))
        schema = f"shard int, kind int, place long, blob binary, size long, uid long, doc_id {kind}, n_tokens long, n_known long, base double"
        names = [x.split()[0] for x in schema.split(", ")]

        def rows_with(n: int, id_type, **have) -> pa.RecordBatch:
            """Rows of the schema; what is not given is null."""
            types = {"shard": pa.int32(), "kind": pa.int32(), "blob": pa.binary(), "doc_id": id_type, "base": pa.float64()}
            return pa.record_batch([pa.nulls(n, types.get(c, pa.int64())) if c not in have else have[c] if isinstance(have[c], pa.Array) else pa.array(have[c], types.get(c, pa.int64())) for c in names], names=names)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            flat, head, frequent = shared.value
            w, lexicon = Weights(flat), Lexicon(head, frequent)
            place = pc.index_in(pa.array([END], pa.binary()), value_set=frequent[0])[0].as_py()
            starts = 0 if place is None else int(frequent[1][place])  # texts that begin without a word before
            held: list[tuple] = []
            others: list[tuple] = []
            place, texts_held, most = None, 0, held_tokens(shards)

            def packed() -> Iterator[pa.RecordBatch]:
                for what, blobs in ((CONTEXTS, context_blobs(held)), (WORDS, word_blobs(others))):
                    if blobs:
                        n = len(blobs)
                        yield rows_with(n, id_type, shard=[y[0] for y in blobs], kind=[what] * n, place=[place] * n, blob=[y[2] for y in blobs], size=[y[1] for y in blobs])
                held.clear()
                others.clear()

            for x in batches:
                uids, id_type = x.column(0).to_numpy(), x.column(1).type
                learn, score, mark = (x.column(k).to_numpy(zero_copy_only=False) for k in (3, 4, 5))
                for (h, cls, slot, c), ids, doc, at, distinct in lexicon.batches(x.column(2)):
                    n = len(at)
                    if not held:
                        place, texts_held = int(uids[at[0]]), 0
                    texts_held += n
                    known = np.log10(np.maximum(c, 0) + 1.0)  # 0 if not among the frequent
                    lp = log_probability(w, h, c, doc, cls, slot)
                    lp += np.where(slot == 0, np.where(c >= 0, known, far[cls]) - rest[cls], 0.0)
                    held.append(contexts_of(h, c, doc, lp, (((uids[at] - place) << 1) | learn[at]).astype(np.uint32), mark[at], starts))
                    n_tokens = np.bincount(doc, minlength=n)
                    some = np.flatnonzero(score[at])
                    if len(some):
                        own, m = at[some], len(some)
                        yield rows_with(m, id_type, shard=(uids[own] % shards).astype(np.int32), kind=[OWN] * m, place=[place] * m, uid=uids[own], doc_id=x.column(1).take(pa.array(own)),
                                        n_tokens=n_tokens[some], n_known=np.bincount(doc, c > 0, n).astype(np.int64)[some], base=(np.bincount(doc, known, n) - n_tokens * base)[some])
                        other = np.flatnonzero((c < 0) & score[at[doc]])
                        if len(other):
                            pair, first, tf = np.unique(doc[other] * np.int64(1 << 32) + ids[other], return_index=True, return_counts=True)
                            others.append((uids[at[pair >> 32]], tf, distinct.take(pa.array(pair & 0xFFFFFFFF)), h[other][first]))
                    if texts_held >= DEALT_MOST[1] or sum(len(y[0]) for y in held) >= most:
                        yield from packed()
            if held:
                yield from packed()

        def contexts_of(h: np.ndarray, c: np.ndarray, doc: np.ndarray, lp: np.ndarray, text: np.ndarray, mark: np.ndarray, starts: int) -> tuple[np.ndarray, ...]:
            """A run's tokens: the shard of each one's contexts, its text's number and whether to learn from it, its two contexts, its word, its probability."""
            h = h.astype(np.uint64)
            before, often = [], []
            for k in (1, 2):
                same = np.r_[np.zeros(min(k, len(doc)), dtype=bool), doc[k:] == doc[:-k]]
                before.append(np.where(same, np.roll(h, k), 0))
                often.append(np.where(same, np.roll(c, k), starts))
            # Contexts of a frequent word are parted by the word before it, those of two frequent words by the text too.
            u, v = (1 + (np.maximum(y, 0) * (PARTED * shards)) // tokens for y in often)
            part = mixed(before[1]) % u.astype(np.uint64) + (mark[doc].view(np.uint64) % np.minimum(u, v).astype(np.uint64) << np.uint64(32))
            one = mixed(mixed(before[0] + np.uint64(1)) + part)
            shard = ((one >> np.uint64(40)) % np.uint64(shards)).astype(np.uint32)
            two = (mixed(before[1]) >> np.uint64(40)).astype(np.uint32)  # beside the word before, which it is met with
            one, word = (one & np.uint64(0xFFFFFFFF)).astype(np.uint32), (h & np.uint64(0xFFFFFF)).astype(np.uint32)
            return shard, text[doc], one, two, word, np.clip(np.rint(-lp * FINE), 0, 65_535).astype(np.uint16)

        def context_blobs(held: list[tuple]) -> list[tuple[int, int, bytes]]:
            """The tokens of some texts by shard of their contexts."""
            shard, text, one, two, word, fine = map(np.concatenate, zip(*held, strict=True))
            out = []
            for k, r in by_shard(shard, shards):
                t = text[r]
                first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
                size, t = np.diff(np.r_[first, len(r)]), t[first]
                known, at = by_frequency(one[r])
                out.append(pack(k, planes(t >> np.uint32(1), 4), planes(size.astype(np.uint32), 4), (t & np.uint32(1)).astype(np.uint8), planes(two[r], 3), known, planes(at, 4), planes(word[r], 3), planes(fine[r], 2)))
            return out

        def word_blobs(others: list[tuple]) -> list[tuple[int, int, bytes]]:
            """Words of some texts that are not among the frequent, once for each text, by shard."""
            if not others:
                return []
            uid, tf, h = (np.concatenate([y[k] for y in others]) for k in (0, 1, 3))
            words = pa.concat_arrays([y[2] for y in others])
            return [pack(k, uid[r], tf[r].astype(np.uint32), *bytes_of(words.take(pa.array(r)))) for k, r in by_shard(h % shards, shards)]

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Shards, one run of rows each, give their texts' sums; the texts' own rows pass."""
            held: dict[int, list] = {}
            now = id_type = None

            def finished() -> Iterator[pa.RecordBatch]:
                out = []
                if CONTEXTS in held:
                    parts = [unpack(blob, size, np.uint8, np.uint8, np.uint8, np.uint8, np.uint32, np.uint8, np.uint8, np.uint8) for _, blob, size in held[CONTEXTS]]
                    sizes = [whole(y[1], 4).astype(np.int64) for y in parts]
                    one = np.concatenate([y[4][whole(y[5], 4)] for y in parts])
                    two, word, fine = (np.concatenate([whole(y[k], width) for y in parts]) for k, width in ((3, 3), (6, 3), (7, 2)))
                    two = (mixed((one.astype(np.uint64) << np.uint64(24)) | two) >> np.uint64(32)).astype(np.uint32)
                    learn = np.concatenate([np.repeat(y[2].astype(bool), size) for y, size in zip(parts, sizes, strict=True)])
                    lp, at = in_context(two, one, word, 10.0 ** (fine / -float(FINE)), learn), 0
                    for (place, _, _), y, size in zip(held[CONTEXTS], parts, sizes, strict=True):
                        sums = np.add.reduceat(lp[at : at + size.sum()], np.r_[0, size.cumsum()[:-1]])
                        at += size.sum()
                        out.append((place, *pack(LP, y[0], planes(sums.astype(np.float32).view(np.uint32), 4))))
                if WORDS in held:
                    known = [unpack(blob, size, np.int64, np.int32, np.uint8) for _, blob, size in held.get(COUNTS_OF_OTHERS, [])]
                    n = np.concatenate([np.empty(0, dtype=np.int64), *[y[0] for y in known]])
                    words = pa.concat_arrays([pa.array([], pa.binary()), *[binary(y[1], y[2]) for y in known]])
                    asked = [unpack(blob, size, np.int64, np.uint32, np.int32, np.uint8) for _, blob, size in held[WORDS]]
                    for (place, _, _), (uid, tf, _, _), c in zip(held[WORDS], asked, looked_up([binary(y[2], y[3]) for y in asked], words, n), strict=True):
                        own, at = np.unique(uid, return_inverse=True)
                        out.append((place, *pack(SUMS, own, np.bincount(at, tf * np.log10(c + 1.0), len(own)), np.bincount(at, tf * (c > 0), len(own)).astype(np.int64))))
                if out:
                    n = len(out)
                    yield rows_with(n, id_type, kind=[y[1] for y in out], place=[y[0] for y in out], size=[y[2] for y in out], blob=[y[3] for y in out])

            for x in batches:
                id_type = x.column(6).type
                own = pc.equal(x.column(1), OWN)
                rest = x.filter(own)
                if rest.num_rows:
                    yield rest
                x = x.filter(pc.invert(own))
                for shard, what, place, blob, size in zip(*[x.column(k).to_pylist() for k in range(5)], strict=True):
                    if shard != now and held:
                        yield from finished()
                        held = {}
                    now = shard
                    held.setdefault(what, []).append((place, blob, size))
            if held:
                yield from finished()

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The texts of one place, one run of rows, with their sums."""
            own: list[pa.RecordBatch] = []
            sums: list[tuple] = []
            now = None

            def finished() -> Iterator[pa.RecordBatch]:
                if not own:  # training documents that are not asked for
                    return
                x = pa.Table.from_batches(own).combine_chunks().sort_by("uid")
                uid = x["uid"].to_numpy()
                lp, n_known, more = np.zeros(len(uid)), x["n_known"].to_numpy().copy(), x["base"].to_numpy().copy()
                for what, blob, size in sums:
                    if what == LP:
                        u, sum_of = (whole(y, 4) for y in unpack(blob, size, np.uint8, np.uint8))
                        u, values = now + u.astype(np.int64), [sum_of.view(np.float32)]
                    else:
                        u, *values = unpack(blob, size, np.int64, np.float64, np.int64)
                    at = np.minimum(np.searchsorted(uid, u), len(uid) - 1)
                    fits = uid[at] == u
                    for target, value in zip((lp,) if what == LP else (more, n_known), values, strict=True):
                        target[at[fits]] += value[fits]  # a text occurs once in a blob
                columns = [x["doc_id"].combine_chunks() if isinstance(x["doc_id"], pa.ChunkedArray) else x["doc_id"], pa.array(x["n_tokens"].to_numpy()), pa.array(n_known), pa.array(np.full(len(uid), self_tokens)), pa.array(more), pa.array(lp)]
                yield pa.record_batch([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

            for x in batches:
                places = x.column(2).to_numpy()
                edges = np.r_[0, np.flatnonzero(places[1:] != places[:-1]) + 1, len(places)]
                for low, high in zip(edges[:-1], edges[1:]):
                    if now is not None and places[low] != now:
                        yield from finished()
                        own, sums = [], []
                    now, y = places[low], x.slice(low, high - low)
                    mine = pc.equal(y.column(1), OWN)
                    if (z := y.filter(mine)).num_rows:
                        own.append(z)
                    z = y.filter(pc.invert(mine))
                    sums += zip(z.column(1).to_pylist(), z.column(3).to_pylist(), z.column(4).to_pylist(), strict=True)
            if now is not None:
                yield from finished()

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Words that are not among the frequent, with their counts, by shard."""
            held: list[tuple[pa.Array, np.ndarray]] = []

            def rows_of(blobs: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
                m = len(blobs)
                return rows_with(m, doc_type, shard=[y[0] for y in blobs], kind=[COUNTS_OF_OTHERS] * m, blob=[y[2] for y in blobs], size=[y[1] for y in blobs])

            def packed() -> pa.RecordBatch:
                words, n = pa.concat_arrays([y[0] for y in held]), np.concatenate([y[1] for y in held])
                held.clear()
                return rows_of([pack(k, n[r], *bytes_of(words.take(pa.array(r)))) for k, r in by_shard(numbers_of(words)[0] % shards, shards)])

            for x in batches:
                full = np.flatnonzero(pc.binary_length(x.column(0)).to_numpy(zero_copy_only=False) > 0)
                if len(full):
                    held.append((x.column(0).cast(pa.binary()).take(pa.array(full)), x.column(1).to_numpy()[full]))
                if len(full) < x.num_rows:  # the end, whose number is 1
                    end = np.flatnonzero(pc.equal(pc.binary_length(x.column(0)), 0).to_numpy(zero_copy_only=False))
                    yield rows_of([pack(1 % shards, x.column(1).to_numpy()[end], *bytes_of(pa.array([END], pa.binary())))])
                if sum(len(y[1]) for y in held) >= held_tokens(shards) // 8 or sum(y[0].nbytes for y in held) >= HELD_BYTES:
                    yield packed()
            if held:
                yield packed()

        self_tokens, doc_type = np.int64(self.tokens), to_arrow_type(docs.schema["doc_id"].dataType)
        rows = texts.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text", "learn", "score", F.xxhash64("text").alias("mark")).mapInArrow(deal, schema)
        rows = rows.union(self.others.mapInArrow(counted, schema))
        # A shard, and then a place, is one run of rows.
        summed = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(meet, schema)
        result = f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        return summed.repartition("place").sortWithinPartitions("place").mapInArrow(add_up, result)


def held_out(doc_id: Column) -> Column:
    return crc_mod(doc_id, 7) == 2


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (~held_out(F.col("doc_id"))).alias("learned"))
    out = MaxEnt(docs.where("learned")).scored(docs, "learned")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

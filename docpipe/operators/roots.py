"""Many roots and masks at once: a trie of paths, and an automaton of texts, in tasks.

Both travel to tasks once, as a broadcast, so a plan has the same size for ten roots and for a hundred thousand. They hold
what a user configures (profiles, secrets), not rows of tables: LIMIT entries at most, beyond which the joins of
`inventory.longest_prefix` are the way.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

LIMIT = 1_000_000


def trie(roots: Mapping[str, str]) -> dict:
    """Nested dictionaries by path component; the key None holds a root's id. A trailing separator does not matter."""
    top: dict = {}
    for root, name in roots.items():
        at = top
        for part in root.rstrip("/").split("/"):
            at = at.setdefault(part, {})
        at[None] = name
    return top


def deepest(top: dict, path: str | None) -> str | None:
    """The id of the deepest root that contains a path or is it."""
    if path is None:
        return None
    at, found = top, top.get("", {}).get(None) if path.startswith("/") else None
    for part in path.split("/"):
        at = at.get(part)
        if at is None:
            break
        found = at.get(None, found)
    return found


def nearest_root(spark: SparkSession, path: Column, roots: Mapping[str, str]) -> Column:
    """The id of the deepest of roots {root: id} that contains a path; null if none. Without state, so it also runs on streams."""
    if len(roots) > LIMIT:
        raise ValueError("so many roots are joined, see inventory.longest_prefix")
    held = spark.sparkContext.broadcast(trie(roots))  # LIMIT entries at most

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series([deepest(held.value, p) for p in x], dtype=object)

    return F.pandas_udf(find, "string")(path)


def automaton(masks: Mapping[str, str]):
    """An Aho-Corasick automaton of texts and their masks."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for text, mask in masks.items():
        if text:
            out.add_word(text, (len(text), mask))
    out.make_automaton()
    return out


def masked(found, text: str | None) -> str | None:
    """A text with all that an automaton finds masked: of matches that overlap the one that begins first, of those the longest."""
    if not text or not len(found):
        return text
    out, at = [], 0
    for end, (n, mask) in found.iter_long(text):
        out += [text[at : end + 1 - n], mask]
        at = end + 1
    return "".join([*out, text[at:]])


def redact(spark: SparkSession, text: Column, masks: Mapping[str, str]) -> Column:
    """A text with each of {text: mask} replaced by its mask, leftmost first and longest first, in one pass; masks are not looked at again."""
    if len(masks) > LIMIT:
        raise ValueError(f"more than {LIMIT} texts to mask")
    held = spark.sparkContext.broadcast(dict(masks))  # LIMIT entries at most

    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found = automaton(held.value)
        for x in batches:
            yield pd.Series([masked(found, t) for t in x], dtype=object)

    return F.pandas_udf(mask, "string")(text)

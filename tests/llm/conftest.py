import pytest

TEXTS = [
    "The quick brown fox jumps over the lazy dog near the old river bank today",
    "The quick brown fox jumps over the lazy dog near the old river bank today",
    "", "   \n\t ", None, "a", "one two", "ééé ñandú 中文 字", "x " * 3000, "line one here now\nline one here now\nline one here now\nother words",
    "tab\tand\x0bvertical\x0cfeed \x1c odd", "﻿mark 🙂 emoji 'tis don't we'll", "a" * 5000,
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and columns whose names clash with results'."""
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None, ""][i % 4], i) for i, t in enumerate(TEXTS)]
    rows += [rows[0], rows[0], (None, "no id here at all my friend", "en", "a", 1), (None, None, None, None, None)]
    wide = [(*r, "clash", 7, 0.5, True, "row", 3, 4) for r in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long, row string, size long, score double, kept boolean, t string, copies long, copy long").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("doc_id = -1")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def crc(i, n):
    import zlib

    return zlib.crc32(str(i).encode()) % n

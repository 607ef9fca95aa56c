import pytest
from pyspark.sql import functions as F

from docpipe.functions import paths as P
from docpipe.functions import text as T


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("name", "ext", "stem"), [("a/b.TXT", "txt", "b"), (".bashrc", None, ".bashrc"), ("x/.a.md", "md", ".a"), ("none", None, "none"), ("a.tar.gz", "gz", "a.tar")])
def test_names(spark, name, ext, stem):
    assert one(spark, P.extension(F.col("p")), p=name) == ext
    assert one(spark, P.file_stem(F.col("p")), p=name) == stem


def test_ancestors_and_links(spark):
    assert one(spark, P.ancestors(F.col("p")), p="a/b/c.md") == ["", "a", "a/b"]
    assert one(spark, P.ancestors(F.col("p")), p="c.md") == [""]
    assert one(spark, P.relative_link(F.col("a"), F.col("b")), a="x/y", b="x/z/d.md") == "../z/d.md"
    assert one(spark, P.relative_link(F.col("a"), F.col("b")), a="", b="x/d.md") == "x/d.md"
    assert one(spark, P.link_encode(F.col("p")), p="目录/a b(1).md") == "目录/a%20b%281%29.md"
    assert one(spark, P.percent_encode(F.col("p")), p="é *~+/") == "%C3%A9%20%2A~%2B/"


def test_natural_order(spark):
    df = spark.createDataFrame([("s-10",), ("s-2",), ("S-1",)], "n string")
    assert [r.n for r in df.orderBy(P.natural_key(F.col("n"))).collect()] == ["S-1", "s-2", "s-10"]


@pytest.mark.parametrize(("size", "ext", "ok"), [(1 << 30, "pdf", True), ((1 << 30) + 1, "pdf", False), (1 << 29, "docx", True), ((1 << 29) + 1, "docx", False), (1 << 40, "md", True)])
def test_sizes(spark, size, ext, ok):
    assert one(spark, P.size_ok(F.col("p"), F.col("s")), p=f"a.{ext}", s=size) is ok


def test_exclusions_differ(spark):
    p = "a/x.assets/b.md"
    assert one(spark, P.excluded_from_index(F.col("p")), p=p) and not one(spark, P.excluded_from_classification(F.col("p")), p=p)


@pytest.mark.parametrize(("text", "yaml"), [("---\na: 1\n---\nbody", "a: 1\n"), ("---\r\na: 1\r\n...\r\nx", "a: 1\r\n"), ("---\na: 1\n", None), ("x\n---\na\n---\n", None), ("---\n---\nb", ""), ("---\na: ---\n---\n", "a: ---\n")])
def test_frontmatter(spark, text, yaml):
    assert one(spark, T.frontmatter(F.col("t")), t=text) == yaml


def test_managed_block_keeps_newlines(spark):
    page = f"top\r\n{T.START}\r\nold\r\n{T.END}\r\nend"
    assert one(spark, T.merge_managed(F.col("p"), F.col("b")), p=page, b="new\nline") == f"top\r\n{T.START}\r\nnew\r\nline\r\n{T.END}\r\nend"
    assert one(spark, T.merge_managed(F.col("p"), F.col("b")), p=f"x {T.START}", b="n") is None
    assert one(spark, T.remove_managed(F.col("p")), p=f"a\n\n\n{T.START}x{T.END}\n\n\nb") == "a\n\nb"


def test_utf8_prefix(spark):
    assert one(spark, T.utf8_prefix(F.col("t"), 4), t="aé中b") == "aé"
    assert one(spark, T.utf8_prefix(F.col("t"), 40), t="aé中b") == "aé中b"


@pytest.mark.parametrize(("message", "code"), [("HTTP 429 timeout", "service_rate_limited"), ("request timed out", "network_timeout"), ("PDF 超过 512 MiB", "pdf_legacy_source_limit"), ("docx 超过 512 MiB", "unexpected_error"), ("odd", "unexpected_error"), (None, None)])
def test_error_order(spark, message, code):
    assert one(spark, T.error_class(F.col("m").cast("string")), m=message) == code


def test_media(spark):
    assert one(spark, P.media_extension(F.col("m"), F.col("o")), m="image/x-emf", o="a.bin") == "emf"
    assert one(spark, P.media_extension(F.col("m"), F.col("o")), m="x/y", o="http://h/a.Tif") == "Tif"
    assert one(spark, P.media_extension(F.col("m"), F.col("o")), m="x/y", o="a.verylongextension") == "bin"

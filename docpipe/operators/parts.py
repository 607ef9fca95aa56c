"""Multi-part documents: plans, progress, merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docpipe.functions import text as T
from docpipe.sources.tables import written

#: Pages of a part, bytes of a file that needs no cutting.
PART_PAGES, DIRECT_BYTES = 200, 200 * 1000 * 1000


def strategy(size: Column, pages: Column) -> Column:
    return F.when(size > DIRECT_BYTES, "split").when(pages > PART_PAGES, "ranges").otherwise("direct")


def page_ranges(docs: DataFrame) -> DataFrame:
    """Rows (id, part_index, part_count, page_start, page_end, page_range) of docs (id, pages)."""
    n = F.ceil(F.col("pages") / PART_PAGES)
    each = docs.where("pages > 0").select("id", "pages", n.alias("part_count"), F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("part_index"))
    start, end = (F.col("part_index") - 1) * PART_PAGES + 1, F.least(F.col("part_index") * PART_PAGES, F.col("pages"))
    return each.select("id", "part_index", "part_count", start.alias("page_start"), end.alias("page_end"), F.concat_ws("-", start.cast("string"), end.cast("string")).alias("page_range"))


def summary(parts: DataFrame) -> DataFrame:
    """Rows by parent: parts, completed and failed ones, pages extracted, derived status."""
    s = parts.groupBy("parent_task_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum(F.when(F.col("status") == "completed", F.col("pages")).otherwise(0)).alias("extracted_pages"), F.bool_and((F.col("status") == "completed") & F.col("artifact_ready")).alias("ready"),
    )
    derived = F.when(F.col("failed") > 0, "failed").when(F.col("completed") == F.col("total"), "waiting_merge").otherwise("waiting_parts")
    return s.withColumn("status", derived)


def progress(done: Column, total: Column) -> Column:
    """A percentage, rounded, between 0 and 100; 0 where the total is 0."""
    return F.when(total > 0, F.greatest(F.lit(0), F.least(F.lit(100), F.round(100.0 * done / total)))).otherwise(0).cast("long")


def merged(parts: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """Rows (doc_id, n_parts, markdown) of parts (doc_id, part_index, text), in order, each without its front matter after its page comment.

    A document whose parts are together larger than max_bytes has null text here, and `too_large` says so; its text comes
    from `merged_pieces`. Sizes are summed before parts meet.
    """
    body = F.concat(F.lit("<!-- part "), F.col("part_index").cast("string"), F.lit(" -->\n\n"), T.without_frontmatter(F.coalesce("text", F.lit(""))))
    sizes = parts.groupBy("doc_id").agg(F.count("*").alias("n_parts"), F.sum(F.octet_length("text")).alias("bytes"))
    small = parts.join(sizes.where(F.coalesce("bytes", F.lit(0)) <= max_bytes).select("doc_id"), "doc_id", "left_semi")
    text = small.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_index", body.alias("body")))), lambda x: x["body"]), "\n\n").alias("markdown"))
    return sizes.join(text, "doc_id", "left").select("doc_id", "n_parts", "markdown", (F.coalesce("bytes", F.lit(0)) > max_bytes).alias("too_large"))


def merged_pieces(parts: DataFrame, max_chars: int = 16 << 20) -> DataFrame:
    """Rows (doc_id, piece, pieces, text) of parts (doc_id, part_index, text): the merged document, cut into pieces of up to max_chars characters.

    The pieces of a document, in order, are what `merged` gives it, of any size. Where each part begins is a prefix sum of
    lengths alone; each part is then cut where pieces end, so no row or group is larger than a part or a piece.
    """
    body = F.concat(F.when(F.col("nth") > 1, "\n\n").otherwise(""), F.lit("<!-- part "), F.col("part_index").cast("string"), F.lit(" -->\n\n"), T.without_frontmatter(F.coalesce("text", F.lit(""))))
    upto = Window.partitionBy("doc_id").orderBy("part_index", "uid")
    rows, _ = written(parts.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "part_index", "text"), "parts")
    order = rows.select("uid", F.row_number().over(upto).alias("nth"))
    held, _ = written(rows.join(order, "uid").select("uid", "doc_id", "part_index", body.alias("body")), "bodies")
    sizes = held.select("uid", "doc_id", "part_index", F.length("body").cast("long").alias("n"))
    places = sizes.select("uid", (F.sum("n").over(upto.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("at"), F.ceil(F.sum("n").over(Window.partitionBy("doc_id")) / max_chars).alias("pieces"))
    met = held.join(places, "uid")
    first, last = F.expr(f"at div {max_chars}"), F.expr(f"(at + length(body) - 1) div {max_chars}")
    cut = met.select("doc_id", "at", "body", "pieces", F.explode(F.sequence(first, last)).alias("piece"))
    low = F.greatest(F.col("piece") * max_chars - F.col("at"), F.lit(0))
    text = F.substring("body", (low + 1).cast("int"), (F.least((F.col("piece") + 1) * max_chars - F.col("at"), F.length("body")) - low).cast("int"))
    out = cut.select("doc_id", "piece", "pieces", "at", text.alias("text")).groupBy("doc_id", "piece", "pieces")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "")
    return out.agg(joined.alias("text")).select("doc_id", (F.col("piece") + 1).cast("int").alias("piece"), F.col("pieces").cast("int").alias("pieces"), "text")


def ocr_verdict(chunks: DataFrame) -> DataFrame:
    """Rows by doc_id of chunks (doc_id, offset, needs_ocr, pages array, error): needs OCR, all its pages, the error."""
    moved = F.transform("pages", lambda p: p + F.col("offset"))
    return chunks.groupBy("doc_id").agg(
        F.bool_or("needs_ocr").alias("needs_ocr"), F.array_sort(F.flatten(F.collect_list(moved))).alias("ocr_pages"), F.max("error").alias("error"))

"""Sources and sinks: files of watched folders, state tables, archives, service responses."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docpipe.functions import paths as P
from docpipe.functions import text as T
from docpipe.operators import convert as V
from docpipe.sources.listing import listed
from docpipe.sources.tables import folders, removed, text_batches, written


def scan_files(spark: SparkSession, root: str, enabled: Sequence[str] | None = None) -> DataFrame:
    """Files below a root (path, rel_path, size, modified_ms, ext), of supported, and if given enabled, formats.

    Folders are listed in parallel, whatever their names begin with; links are not followed. See `sources.listing` for
    empty folders and for folders that cannot be read.
    """
    return scan_profiles(spark, [("", root)], enabled)[0].drop("profile_id")


def scan_profiles(spark: SparkSession, profiles: Sequence[tuple[str, str]], enabled: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, roots): files of all profiles (id, root), and rows (profile_id, available, error); a failing root stops no other.

    A root that cannot be read, or has a folder that cannot, is not available, with the first error. Both are lazy, so a file
    that goes before its folder is listed is not seen, and fails nothing.
    """
    supported = [*P.LOCAL_EXTENSIONS, *P.OCR_EXTENSIONS]
    wanted = supported if enabled is None else [x for x in supported if x in {e.lower() for e in enabled}]
    every = listed(spark, profiles)
    files = every.where(F.col("ext").isin(*wanted) & (F.col("kind") == "file")) if wanted else every.where("false")
    failed = listed(spark, profiles).where("kind = 'error'").groupBy("profile_id").agg(F.min_by("error", "rel_path").alias("error"))
    known = spark.createDataFrame([(p,) for p, _ in profiles], "profile_id string")
    roots = known.join(failed, "profile_id", "left").select("profile_id", F.col("error").isNull().alias("available"), "error")
    return files.select("path", "rel_path", "size", "modified_ms", "ext", "profile_id"), roots


def scan_markdown(spark: SparkSession, root: str) -> DataFrame:
    """Markdown below an output root that classification looks at: no index pages, trash, temporary or lock files."""
    path = F.col("rel_path")
    return scan_files(spark, root, ["md"]).where(~P.excluded_from_classification(path) & (F.lower(P.file_name(path)) != P.INDEX_NAME))


def read_prefix(files: DataFrame, n: int, content: str = "content") -> Column:
    return F.substring(files[content], 1, n)


def read_state(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A state table under a declared schema: columns that older snapshots lack are null."""
    return spark.read.schema(schema).option("mergeSchema", "true").parquet(path)


def parse_ocr_response(rows: DataFrame, wanted: Column) -> DataFrame:
    """rows (json) of a polled batch with (ok, state, extracted, total, message): the item of the wanted id, or the first if none is."""
    item = "struct<data_id:string,state:string,err_msg:string,extract_progress:struct<extracted_pages:bigint,total_pages:bigint>>"
    r = F.from_json("json", f"struct<code:bigint,msg:string,data:struct<extract_result:array<{item}>>>")
    found = rows.withColumn("r", r).withColumn("w", wanted)
    items = F.coalesce("r.data.extract_result", F.array().cast(f"array<{item}>"))
    one = F.when(F.col("w").isNull(), F.get(items, F.lit(0))).otherwise(F.get(F.filter(items, lambda x: x["data_id"] == F.col("w")), F.lit(0)))
    found = found.withColumn("i", one)
    ok = F.coalesce((F.col("r.code") == 0) & F.col("r.data").isNotNull(), F.lit(False))
    state = F.when(F.col("i.state").isin("done", "failed"), F.col("i.state")).when(F.col("i").isNotNull(), "running")
    return found.withColumns({"ok": ok, "state": F.when(ok, state), "extracted": F.col("i.extract_progress.extracted_pages"), "total": F.col("i.extract_progress.total_pages"), "message": F.coalesce("i.err_msg", "r.msg")}).drop("r", "w", "i")


def unpack_result_archives(files: DataFrame) -> DataFrame:
    """Rows (path, member, markdown, bytes, error) of archives (path, content): the Markdown, then each asset it mentions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for path, content in zip(x["path"], x["content"], strict=True):
                try:
                    text, assets = V.unpack_archive(content)
                    rows = [(path, None, text, None, None), *[(path, name, None, b, None) for name, b in assets]]
                except Exception as e:  # an archive, not the job
                    rows = [(path, None, None, None, str(e)[:500])]
                yield pd.DataFrame(rows, columns=["path", "member", "markdown", "bytes", "error"])

    text_batches(files.sparkSession)
    return files.select("path", "content").mapInPandas(run, "path string, member string, markdown string, bytes binary, error string")


def write_converted(docs: DataFrame, path: str) -> None:
    """Markdown documents (profile_id, rel_path, frontmatter, markdown), the front matter, a blank line and the body, by profile."""
    text = F.concat("frontmatter", F.lit("\n"), F.regexp_replace("markdown", r"^[\s\p{Z}]+", ""))
    docs.select("profile_id", "rel_path", text.alias("markdown")).write.partitionBy("profile_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


#: Parts of an asset table, by a hash of the document.
ASSET_BUCKETS = 64


def write_assets(assets: DataFrame, path: str, converted: DataFrame | None = None) -> None:
    """Assets (doc_id, output_path, relative_path, bytes) of safe paths, replacing all earlier ones of the converted documents (doc_id).

    A converted document without assets loses those that it had. The table has ASSET_BUCKETS parts, of which only those
    that hold a converted document are written again, from a copy beside it. Readers take `read_assets`.
    """
    spark = assets.sparkSession
    bucket = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(ASSET_BUCKETS)).cast("int")
    safe = assets.where(P.is_safe_relative(F.col("relative_path")))
    new = safe.withColumn("asset_path", F.concat_ws("/", P.asset_dir(F.col("output_path")), "relative_path"))
    done = (assets if converted is None else converted).select("doc_id").distinct()
    if folders(spark, path):
        touched = [x["bucket"] for x in done.select(bucket.alias("bucket")).distinct().collect()]  # ASSET_BUCKETS at most
        old = spark.read.parquet(path).where(F.col("bucket").isin(touched)).drop("bucket")
        new = old.join(done, "doc_id", "left_anti").unionByName(new)
        # A part left without assets is written with an empty marker row, so that it replaces the one before.
        empty = spark.range(1).select(F.explode(F.array(*[F.lit(b) for b in touched])).alias("bucket")) if touched else None
        rows = new.withColumn("bucket", bucket)
        rows = rows if empty is None else rows.unionByName(empty, allowMissingColumns=True)
    else:
        rows = new.withColumn("bucket", bucket)
    held, place = written(rows, "assets")
    held.write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    removed(spark, place)


def read_assets(spark: SparkSession, path: str) -> DataFrame:
    """The assets of a table that write_assets wrote."""
    return spark.read.parquet(path).where("relative_path is not null").drop("bucket")


def write_changed_pages(changed: DataFrame, path: str, version: int) -> None:
    """Index pages that changed, as one version beside the others."""
    changed.write.mode("overwrite").parquet(f"{path}/v={version}")


def html_word_exports(files: DataFrame) -> DataFrame:
    """files (path, content) with `kind`: html for exports that are HTML behind a mark, space, comments or a declaration, else binary."""
    head = F.substring("content", 1, 8192).cast("string")
    return files.withColumn("kind", F.when(T.is_html_start(head), "html").otherwise("binary"))

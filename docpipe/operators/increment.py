"""The folder index kept up to date by changes: signed deltas of roll-ups, newest documents with a reserve.

Four tables in parts (`sources.versioned`): documents by the folder they are in, and by the folder above it: each folder's
counts, its categories' counts, and its newest documents. A batch of changes reads the parts that its documents and their
folders are in, and no others. Counts add what is new and subtract what was; the newest KEEP documents of a folder
are kept, SHOWN of which are shown, so that some may go before the list runs dry. A list that is dry is filled again from the
documents directly in the folder and its sub-folders' lists, the deepest folder first, never from the whole subtree. The
latest time of a folder is that of its first document.

A list is exact as far as it reaches: a document that sorts behind the last of a list that does not hold the whole folder is
not put in it, as others between may be missing.

Nulls: a document without categories (null or none) is pending; one without time comes last. Of several changes of one path in
a batch the last by `seq` holds; a change of a path that is not there, to gone, is nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docpipe.functions import paths as P
from docpipe.operators.index import in_folders, pages
from docpipe.sources.tables import written
from docpipe.sources.versioned import PARTS, Versioned

SHOWN, KEEP = 10, 20
#: Parts over which the documents of one folder are dealt, so that a folder with a third of all is no single part.
SPREAD = 8
DOCS = "rel_path string, categories array<string>, modified_ms long"
CHANGES = f"{DOCS}, gone boolean, seq long"


def late() -> Column:
    """Ascends from the newest to the oldest, and to those without time."""
    return -F.coalesce("modified_ms", F.lit(-(1 << 62)))


class FolderIndex:
    """The index of one profile's documents below a folder `base` of tables."""

    def __init__(self, spark: SparkSession, base: str):
        above = Versioned.part_of(P.parent(F.col("folder")))
        within = F.pmod(F.xxhash64(P.parent(F.col("rel_path"))), F.lit(PARTS)) * SPREAD + F.pmod(F.xxhash64("rel_path"), F.lit(SPREAD))
        table = lambda name, schema, part: Versioned(spark, f"{base}/{name}", StructType.fromDDL(schema), part)
        self.spark = spark
        self.docs = table("docs", DOCS, within.cast("int"))
        self.folders = table("folders", "folder string, documents long, classified long", above)
        self.categories = table("categories", "folder string, category string, documents long", above)
        self.newest = table("newest", "folder string, rel_path string, modified_ms long", above)

    def version(self) -> int:
        """The last version that all tables have; -1 before the first."""
        return min(-1 if (v := t.held()[0]) is None else v for t in (self.docs, self.folders, self.categories, self.newest))

    def apply(self, changes: DataFrame, version: int) -> DataFrame:
        """Puts changes (rel_path, categories, modified_ms, gone, seq) into the tables as the next version; rows (folder) whose pages change.

        Run again after a failure, tables that have the version already stay, and the others are written from what they were.
        """
        last = F.row_number().over(Window.partitionBy("rel_path").orderBy(F.desc("seq")))
        new, _ = written(changes.withColumn("nth", last).where("nth = 1").select("rel_path", "categories", "modified_ms", F.coalesce("gone", F.lit(False)).alias("gone")), "changes")
        before = None if (v := self.version()) < 0 else v
        read = lambda t, parts: t.read(parts, before) if before is not None else t.spark.createDataFrame([], t.schema)
        parts = self.docs.touched(new)
        old = read(self.docs, parts)
        was = old.join(new.select("rel_path"), "rel_path", "left_semi").withColumn("sign", F.lit(-1))
        delta, _ = written(was.unionByName(new.where("not gone").drop("gone").withColumn("sign", F.lit(1))), "delta")
        each = in_folders(delta)
        touched, _ = written(each.select("folder").distinct(), "touched")
        above = self.folders.touched(touched)

        counts = each.groupBy("folder").agg(F.sum("sign").alias("documents"), F.sum(F.when(F.size("categories") > 0, F.col("sign")).otherwise(0)).alias("classified"))
        held, _ = written(read(self.folders, above).unionByName(counts).groupBy("folder").agg(F.sum("documents").alias("documents"), F.sum("classified").alias("classified")).where("documents > 0 or folder = ''"), "folders")
        named = each.withColumn("category", F.explode_outer(F.array_distinct("categories"))).groupBy("folder", "category").agg(F.sum("sign").alias("documents"))
        categories = read(self.categories, above).unionByName(named).groupBy("folder", "category").agg(F.sum("documents").alias("documents")).where("documents > 0")
        newest = self._newest(read, each, held, touched, above, new)

        self.categories.write(version, categories, above)
        self.newest.write(version, newest, above)
        self.folders.write(version, held, above)
        self.docs.write(version, old.join(new.select("rel_path"), "rel_path", "left_anti").unionByName(new.where("not gone").drop("gone")), parts)
        return touched

    def _newest(self, read, each: DataFrame, held: DataFrame, touched: DataFrame, above: list[int], new: DataFrame) -> DataFrame:
        """The lists of the folders in these parts after the changes. read: tables as they were; held: counts as they are."""
        order = Window.partitionBy("folder").orderBy(late(), "rel_path")
        top = lambda rows, n: rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n).select("folder", "rel_path", "modified_ms")
        # How far a list reaches that does not hold its whole folder: to its last document.
        lists = read(self.newest, above)
        ends = lists.groupBy("folder").agg(F.count("*").alias("listed"), F.max(F.struct(late().alias("late"), "rel_path")).alias("end"))
        reach = read(self.folders, above).join(ends, "folder").where(F.col("listed") < F.col("documents")).select("folder", "end")
        plus = top(each.where("sign = 1"), KEEP).join(reach, "folder", "left").where(F.col("end").isNull() | (F.struct(late().alias("late"), "rel_path") < F.col("end")))
        left = lists.join(each.where("sign = -1").select("folder", "rel_path"), ["folder", "rel_path"], "left_anti")
        rows, _ = written(top(left.unionByName(plus.select("folder", "rel_path", "modified_ms")), KEEP), "newest")

        # Lists shorter than what is shown, of folders that have more, are filled again, the deepest first.
        listed = rows.groupBy("folder").agg(F.count("*").alias("listed"))
        dry = held.join(touched, "folder", "left_semi").join(listed, "folder", "left").where(F.coalesce("listed", F.lit(0)) < F.least("documents", F.lit(SHOWN)))
        dry, _ = written(dry.select("folder", F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/"))).alias("depth")), "dry")
        for depth in sorted((r["depth"] for r in dry.select("depth").distinct().collect()), reverse=True):  # a row a depth
            now = dry.where(F.col("depth") == depth).select("folder")
            inner = read(self.newest, self.newest_parts(now)).join(touched, "folder", "left_anti").unionByName(rows.join(touched, "folder", "left_semi"))
            children = inner.where("folder <> ''").select(P.parent(F.col("folder")).alias("folder"), "rel_path", "modified_ms").join(now, "folder", "left_semi")
            documents = read(self.docs, self.doc_parts(now)).join(new.select("rel_path"), "rel_path", "left_anti").unionByName(new.where("not gone").drop("gone"))
            direct = documents.select(P.parent(F.col("rel_path")).alias("folder"), "rel_path", "modified_ms").join(now, "folder", "left_semi")
            # Of a sub-folder's list SHOWN are sure, so as many of the folder's.
            rows, _ = written(rows.join(now, "folder", "left_anti").unionByName(top(children.unionByName(direct), SHOWN)), "newest")
        return rows

    def newest_parts(self, now: DataFrame) -> list[int]:
        """The parts with the lists of sub-folders of folders (folder)."""
        return sorted(x["part"] for x in now.select(Versioned.part_of(F.col("folder")).alias("part")).distinct().collect())  # PARTS at most

    def doc_parts(self, now: DataFrame) -> list[int]:
        """The parts with the documents directly in folders (folder)."""
        first = (F.pmod(F.xxhash64("folder"), F.lit(PARTS)) * SPREAD).cast("int")
        own = now.select(F.explode(F.sequence(first, first + SPREAD - 1)).alias("part"))
        return sorted(x["part"] for x in own.distinct().collect())  # PARTS * SPREAD at most

    def rollup(self) -> DataFrame:
        """Rows (folder, documents, classified, pending, last_modified_ms) of all folders, as `index.folder_rollup` gives them."""
        latest = self.newest.read().groupBy("folder").agg(F.max("modified_ms").alias("last_modified_ms"))
        root = self.spark.range(1).select(F.lit("").alias("folder"))
        out = root.unionByName(self.folders.read().select("folder")).distinct().join(self.folders.read(), "folder", "left").na.fill(0, ["documents", "classified"])
        return out.join(latest, "folder", "left").select("folder", "documents", "classified", (F.col("documents") - F.col("classified")).alias("pending"), "last_modified_ms")

    def recent(self) -> DataFrame:
        """Rows (folder, rank, rel_path), as `index.recent_documents` gives them."""
        rank = F.row_number().over(Window.partitionBy("folder").orderBy(late(), "rel_path"))
        return self.newest.read().withColumn("rank", rank).where(F.col("rank") <= SHOWN).select("folder", "rank", "rel_path")

    def rendered(self, touched: DataFrame, **how) -> DataFrame:
        """The pages of touched folders (folder), as `index.rendered` gives them, from the tables; folders without documents have none.

        Counts and recent lists come from the tables. A page lists the documents of its subtree by category, so those of a
        touched folder's subtree are read; the root's page lists all.
        """
        only = lambda rows: rows.join(touched, "folder", "left_semi")
        docs = self.docs.read()
        folders = self.folders.read().where("folder <> ''").select(P.parent(F.col("folder")).alias("folder"), F.col("folder").alias("entry"), F.lit("directory").alias("kind"))
        files = docs.select(P.parent(F.col("rel_path")).alias("folder"), F.col("rel_path").alias("entry"), F.lit("file").alias("kind"))
        return pages(only(self.rollup()), only(folders.unionByName(files)), only(self.categories.read()), only(in_folders(docs)), only(self.recent()), **how)

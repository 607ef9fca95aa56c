"""Per-folder roll-ups, category views, recent lists and pages over classified documents.

docs: (rel_path, categories array, modified_ms). A folder's subtree is reached by exploding a document's ancestors once,
so the work is documents times depth; counts are summed before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docpipe.functions import paths as P
from docpipe.operators.order import numbered

FALLBACK = "未分类"


def in_folders(docs: DataFrame) -> DataFrame:
    return docs.withColumn("folder", F.explode(P.ancestors(F.col("rel_path"))))


def folder_rollup(docs: DataFrame) -> DataFrame:
    """Rows (folder, documents, classified, pending, last_modified_ms); the root, the empty string, is always there."""
    out = in_folders(docs).groupBy("folder").agg(
        F.count("*").alias("documents"), F.count_if(F.size("categories") > 0).alias("classified"), F.max("modified_ms").alias("last_modified_ms")
    )
    root = docs.sparkSession.range(1).select(F.lit("").alias("folder"))
    out = root.unionByName(out.select("folder")).distinct().join(out, "folder", "left").na.fill(0, ["documents", "classified"])
    return out.select("folder", "documents", "classified", (F.col("documents") - F.col("classified")).alias("pending"), "last_modified_ms")


def category_view(docs: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """Rows (folder, category, documents, place): rules first in their order, other names after, unclassified (null) last."""
    each = in_folders(docs).withColumn("category", F.explode_outer(F.array_distinct("categories")))
    out = each.groupBy("folder", "category").agg(F.count("*").alias("documents"))
    rank = F.coalesce(*[F.when(F.col("category") == c, i) for i, c in enumerate(rules or [])], F.lit(len(rules or [])))
    order = Window.partitionBy("folder").orderBy(F.col("category").isNull(), rank, "category")
    return out.withColumn("place", F.row_number().over(order))


def recent_documents(docs: DataFrame, n: int = 10) -> DataFrame:
    """Rows (folder, rank, rel_path): the newest n of each folder's subtree, unknown times last, then by path."""
    order = Window.partitionBy("folder").orderBy(F.col("modified_ms").desc_nulls_last(), "rel_path")
    return in_folders(docs).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("folder", "rank", "rel_path")


def folder_entries(docs: DataFrame) -> DataFrame:
    """Rows (folder, entry, kind): a folder's sub-folders and documents."""
    up = docs.select(F.explode(P.ancestors(F.col("rel_path"))).alias("child")).where("child <> ''").distinct()
    folders = up.select(P.parent(F.col("child")).alias("folder"), F.col("child").alias("entry"), F.lit("directory").alias("kind"))
    files = docs.select(P.parent(F.col("rel_path")).alias("folder"), F.col("rel_path").alias("entry"), F.lit("file").alias("kind"))
    return folders.unionByName(files)


def folder_listing(docs: DataFrame) -> DataFrame:
    """Rows (folder, entry, kind, place): sub-folders first, then documents by lower-cased path."""
    return numbered(folder_entries(docs), ["folder"], [F.col("kind"), F.lower("entry"), F.col("entry")])


#: Texts of pages by language, which are compared byte for byte.
WORDS = {
    "en": {
        "title": "Knowledge index", "home": "Knowledge library", "counts": " · %d documents · %d classified · %d pending\n", "updated": "> Last document update: ",
        "folders": "Browse by folder", "categories": "Browse by category", "recent": "Recently updated", "pending": "Pending classification", "fallback": "Unclassified", "count": " (%d)",
        "no_entries": "No Markdown documents in this folder yet.\n", "no_categories": "No category data yet.\n", "no_recent": "No Markdown documents yet.\n",
    },
    "zh": {
        "title": "知识库索引", "home": "知识库", "counts": " · 共 %d 篇文档 · 已分类 %d 篇 · 待分类 %d 篇\n", "updated": "> 最近文档更新：",
        "folders": "按文件夹浏览", "categories": "按标签浏览", "recent": "最近更新", "pending": "待分类", "fallback": "未分类", "count": "（%d）",
        "no_entries": "当前目录暂无 Markdown 文档。\n", "no_categories": "暂无标签数据。\n", "no_recent": "暂无 Markdown 文档。\n",
    },
}


def rendered(docs: DataFrame, title: str | None = None, profile: str = "", max_entries: int = 1000, rules: list[str] | None = None, language: str = "en") -> DataFrame:
    """Rows (folder, part, parts, page): the text of a folder's pages, numbered from 1; each holds max_entries lines of lists and headings at most.

    The first begins with title, counts and breadcrumbs; the others, index-2.md and so on, with the title and their number.
    """
    return pages(folder_rollup(docs), folder_entries(docs), category_view(docs, rules), in_folders(docs), recent_documents(docs), title, profile, max_entries, rules, language)


def pages(roll: DataFrame, entries: DataFrame, sizes: DataFrame, each: DataFrame, recent: DataFrame, title: str | None = None, profile: str = "", max_entries: int = 1000, rules: list[str] | None = None, language: str = "en") -> DataFrame:
    """The same, of roll-ups, entries, (folder, category, documents), documents by folder and recent documents of some folders."""
    t = WORDS[language]
    name = F.when(F.col("folder") == "", title or t["title"]).otherwise(P.file_name(F.col("folder")))
    head = F.concat(
        F.lit("# "), P.escape_markdown(name), F.lit("\n\n> "), P.escape_markdown(F.lit(profile)), F.format_string(t["counts"], "documents", "classified", "pending"),
        F.coalesce(F.concat(F.lit(t["updated"]), F.date_format(F.timestamp_millis("last_modified_ms"), "yyyy-MM-dd HH:mm"), F.lit("\n")), F.lit("")),
        F.when(F.col("folder") == "", "").otherwise(F.concat(F.lit("\n> "), P.breadcrumbs(F.col("folder"), t["home"]), F.lit("\n"))),
    )

    def link(target: str):
        path = F.col(target)
        return F.concat(F.lit("- ["), P.escape_link_text(P.file_stem(P.file_name(path))), F.lit("]("), P.link_encode(P.relative_link(F.col("folder"), path)), F.lit(")\n"))

    def lines(df: DataFrame, section: int, rank, category, kind, low, entry, line) -> DataFrame:
        """Lines and the order in which they stand on a folder's pages."""
        return df.select("folder", F.lit(section).alias("section"), rank.cast("int").alias("rank"), category.alias("category"), kind.cast("int").alias("kind"), low.alias("low"), entry.alias("entry"), line.alias("line"))

    none, zero = F.lit(""), F.lit(0)
    out = None
    for section, key, empty in ((1, "folders", "no_entries"), (2, "categories", "no_categories"), (3, "recent", "no_recent")):
        top = lines(roll, section, F.lit(-1), none, zero, none, none, F.concat(F.lit(f"\n## {t[key]}\n\n"), F.when(F.col("documents") == 0, t[empty]).otherwise("")))
        out = top if out is None else out.unionByName(top)
    label = P.escape_link_text(P.file_name(F.col("entry")))
    down = F.concat(F.lit("- [**"), label, F.lit("/**]("), P.link_encode(F.concat(P.relative_link(F.col("folder"), F.col("entry")), F.lit("/" + P.INDEX_NAME))), F.lit(")\n"))
    out = out.unionByName(lines(entries, 1, zero, none, (F.col("kind") == "file"), F.lower("entry"), F.col("entry"), F.when(F.col("kind") == "directory", down).otherwise(link("entry"))))

    known = rules or []
    rank = F.when(F.col("category").isNull(), len(known) + 1)
    for i, c in enumerate(known):
        rank = rank.when(F.col("category") == c, i)
    rank, category = rank.otherwise(len(known)), F.coalesce("category", none)
    shown = F.when(F.col("category").isNull(), t["pending"]).when(F.col("category") == FALLBACK, t["fallback"]).otherwise(F.col("category"))
    out = out.unionByName(lines(sizes, 2, rank, category, zero, none, none, F.concat(F.lit("### "), P.escape_markdown(shown), F.format_string(t["count"], "documents"), F.lit("\n\n"))))
    out = out.unionByName(lines(sizes, 2, rank, category, F.lit(2), none, none, F.lit("\n")))
    named = each.withColumn("category", F.explode_outer(F.array_distinct("categories")))
    out = out.unionByName(lines(named, 2, rank, category, F.lit(1), F.lower("rel_path"), F.col("rel_path"), link("rel_path")))
    out = out.unionByName(lines(recent, 3, F.col("rank"), none, zero, none, none, link("rel_path")))

    placed = numbered(out, ["folder"], [F.col(x) for x in ("section", "rank", "category", "kind", "low", "entry")])
    parts = placed.groupBy("folder", (F.floor((F.col("place") - 1) / max_entries) + 1).cast("int").alias("part")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "").alias("body")
    )
    met = parts.join(roll, "folder").withColumn("parts", F.max("part").over(Window.partitionBy("folder")))
    again = F.concat(F.lit("# "), P.escape_markdown(name), F.format_string(" · %d/%d\n\n", "part", "parts"))
    more = F.when(F.col("part") < F.col("parts"), F.format_string("\n[%d/%d](index-%d.md)\n", F.col("part") + 1, F.col("parts"), F.col("part") + 1)).otherwise("")
    return met.select("folder", "part", "parts", F.concat(F.when(F.col("part") == 1, head).otherwise(again), "body", more).alias("page"))


def changed_pages(new: DataFrame, current: DataFrame) -> DataFrame:
    """New pages (folder, part if there are parts, page) that differ from the current ones: only these are written."""
    on = [k for k in ("folder", "part") if k in new.columns]
    return new.join(current.select(*on, F.col("page").alias("was")), on, "left").where(~F.col("page").eqNullSafe(F.col("was"))).select(*on, "page")


def stale_pages(current: DataFrame, docs: DataFrame) -> DataFrame:
    """Folders that have a page and no longer any document below."""
    wanted = docs.select(F.explode(P.ancestors(F.col("rel_path"))).alias("folder")).distinct()
    return current.select("folder").where("folder <> ''").join(wanted, "folder", "left_anti")

"""What is new, changed, gone or eligible among files and their tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docpipe.functions import paths as P

ACTIVE = ("converting", "waiting_parts", "uploading", "processing", "downloading")
PENDING = ("waiting_stable", "queued", "waiting_mineru")
IN_FLIGHT = ("failed", "waiting_mineru", *ACTIVE)


def stem_collisions(files: DataFrame) -> DataFrame:
    """files with `collides`: whether another supported file of the folder has the same stem, whatever its case."""
    same = Window.partitionBy(P.parent(F.col("rel_path")), F.lower(P.file_stem(F.col("rel_path"))))
    supported = P.is_supported(F.col("rel_path"))
    return files.withColumn("collides", supported & (F.sum(supported.cast("int")).over(same) > 1))


def planned_outputs(files: DataFrame) -> DataFrame:
    """Supported files with their output's path and asset folder."""
    out = stem_collisions(files).where(P.is_supported(F.col("rel_path")))
    out = out.withColumn("output_path", P.output_path(F.col("rel_path"), F.col("collides")))
    return out.withColumn("asset_dir", P.asset_dir(F.col("output_path")))


def source_changed(status: Column, stored_size: Column, size: Column, stored_ms: Column, ms: Column) -> Column:
    """Only for completed tasks; what is not stored, or a time not known now, is no change."""
    return (status == "completed") & (F.coalesce(stored_size != size, F.lit(False)) | F.coalesce(stored_ms != ms, F.lit(False)))


def availability(path: Column, enabled: tuple[str, ...], reported: Column | None = None) -> Column:
    own = F.when(~P.is_supported(path), "unsupported").when(~P.is_enabled(path, enabled), "disabled").otherwise("eligible")
    return own if reported is None else F.coalesce(reported, own)


def file_class(availability_: Column, status: Column) -> Column:
    """The filter that a file falls under, besides `all`: by its task's status, or by availability where it has none."""
    by_task = F.when(status.isin(*PENDING), "pending").when(status.isin(*ACTIVE), "active").when(status.isin("completed", "failed"), status)
    by_file = F.when(availability_ == "eligible", "untracked").when(availability_.isin("disabled", "unsupported"), availability_)
    return F.when(availability_ == "unreadable", "unreadable").when(status.isNotNull(), by_task).otherwise(by_file)


def queue_decision(force: Column, size: Column, ms: Column, output: Column, task_size: Column, task_ms: Column, task_output: Column, status: Column, output_ms: Column) -> Column:
    """skip, adopt (a legacy row takes the metadata), verify (its hash first) or queue. output_ms: null where the output is gone."""
    same_output = F.coalesce(task_output == output, F.lit(False))
    same = F.coalesce((task_size == size) & (task_ms == ms), F.lit(False)) & same_output
    legacy = status.isNotNull() & (task_size.isNull() | task_ms.isNull()) & same_output
    done = (status == "completed") & output_ms.isNotNull()
    return (
        F.when(force, "queue")
        .when(same & (done | status.isin(*IN_FLIGHT)), "skip")
        .when(legacy & done & (output_ms >= ms), "adopt")
        .when(legacy & (done | status.isin("failed", "waiting_mineru")), "verify")
        .otherwise("queue")
    )


def prepare_decision(same_hash: Column, status: Column, has_output: Column, same_output: Column | None = None) -> Column:
    """refresh: only the metadata changed; queue: the content or the output's place did, or nothing usable is there."""
    same = same_hash if same_output is None else same_hash & F.coalesce(same_output, F.lit(False))
    return F.when(same & ((status == "completed") & has_output | status.isin(*IN_FLIGHT)), "refresh").otherwise("queue")


def with_ocr_verdicts(files: DataFrame, verdicts: DataFrame) -> DataFrame:
    """files (rel_path, content_hash) with `ocr_required`: whether a verdict (rel_path, ocr_required_hash) stands for this content.

    A verdict on another content of the path, or a null one, is void.
    """
    found = verdicts.select("rel_path", F.col("ocr_required_hash").alias("content_hash"), F.lit(True).alias("ocr_required")).where("content_hash is not null").distinct()
    return files.join(found, ["rel_path", "content_hash"], "left").na.fill(False, ["ocr_required"])


def remaining_parts(parts: DataFrame, tasks: DataFrame) -> DataFrame:
    """Parts (parent_task_id, ...) that stay when tasks (id, source_hash, content_hash, force) are prepared again: those of an unforced task whose content is the same."""
    void = tasks.where(F.col("force") | ~F.col("source_hash").eqNullSafe(F.col("content_hash"))).select(F.col("id").alias("parent_task_id"))
    return parts.join(void, "parent_task_id", "left_anti")


def classification_eligible(enabled: Column, status: Column, same_source: Column, expected: Column, recorded: Column, exists: Column) -> Column:
    """eligible, or why not."""
    return (
        F.when(~enabled, "rules_off").when(status.isNull(), "no_task").when(status != "completed", "not_completed").when(~same_source, "source_changed")
        .when(~exists, "output_missing").when(~F.coalesce(expected == recorded, F.lit(False)), "output_moved").otherwise("eligible")
    )


def missing_sources(tasks: DataFrame, files: DataFrame, roots: DataFrame, running: DataFrame | None = None) -> DataFrame:
    """Tasks whose source is gone, of profiles whose root could be read: a failed scan never looks like deletions.

    tasks (profile_id, source_path, status); files (source_path); roots (profile_id, available).
    """
    readable = roots.where("available").select("profile_id")
    gone = tasks.where("status is not null").join(files.select("source_path"), "source_path", "left_anti").join(readable, "profile_id", "left_semi")
    return gone if running is None else gone.join(running.select("source_path"), "source_path", "left_anti")


def longest_prefix(items: DataFrame, roots: DataFrame) -> DataFrame:
    """items (id, path) with the id of the deepest root (id, root) that contains them: an equi-join on the path's prefixes."""
    up = items.select("id", F.posexplode(P.ancestor_paths(F.col("path"))).alias("depth", "prefix"))
    met = up.join(roots.select(F.col("id").alias("root_id"), F.col("root").alias("prefix")), "prefix")
    return met.groupBy("id").agg(F.max_by("root_id", "depth").alias("root_id"))


def overlaps(roots: DataFrame) -> DataFrame:
    """Pairs (outer, inner) of roots (id, root) of which one is or contains the other."""
    up = roots.select(F.col("id").alias("inner"), F.explode(P.ancestor_paths(F.col("root"))).alias("root"))
    met = up.join(roots.select(F.col("id").alias("outer"), "root"), "root").where("outer <> inner")
    return met.select("outer", "inner").distinct()


def delete_actions(tasks: DataFrame, policy: Column, stamp: Column) -> DataFrame:
    """Rows (id, path, action, target) for outputs and their asset folders under keep, trash or delete."""
    both = tasks.withColumn("path", F.explode(F.array("output_path", P.asset_dir(F.col("output_path")))))
    target = F.concat_ws("/", F.lit(P.TRASH), F.concat_ws("-", stamp, F.col("id").cast("string")), F.col("path"))
    return both.select("id", "path", policy.alias("action"), F.when(policy == "trash", target).alias("target"))


def search(files: DataFrame, needle: str) -> DataFrame:
    """Files whose name contains a text, and their folders, each once. files (rel_path). Rows (path, kind)."""
    hit = files.where(F.lower(P.file_name(F.col("rel_path"))).contains(needle.strip().lower()))
    folders = hit.select(F.explode(P.ancestors(F.col("rel_path"))).alias("path")).where("path <> ''").distinct()
    return hit.select(F.col("rel_path").alias("path"), F.lit("file").alias("kind")).unionByName(folders.withColumn("kind", F.lit("directory")))


def prunable_folders(outputs: DataFrame, sources: DataFrame, folders: DataFrame) -> DataFrame:
    """Folders (path) of the output tree without files that the source tree no longer has; never trash."""
    used = outputs.select(F.explode(P.ancestors(F.col("rel_path"))).alias("path"))
    known = sources.select(F.explode(P.ancestors(F.col("rel_path"))).alias("path"))
    mine = folders.where((F.col("path") != "") & ~F.array_contains(F.split("path", "/"), P.TRASH)).select("path")
    return mine.exceptAll(mine.intersect(used)).join(known.distinct(), "path", "left_anti")


def missing_requested(requested: DataFrame, files: DataFrame) -> DataFrame:
    """Requested paths (path), each once, that no file (rel_path) has."""
    return requested.select("path").distinct().join(files.select(F.col("rel_path").alias("path")), "path", "left_anti")

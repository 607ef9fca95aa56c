"""Tasks, parts and classification jobs: snapshots, counts, retries and recovery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docpipe.operators.inventory import ACTIVE, PENDING

TAG_ACTIVE = ("reading", "writing")
GROUPS = ("pending", "active", "completed", "failed")


def status_group(status: Column) -> Column:
    return F.when(status.isin(*PENDING), "pending").when(status.isin(*ACTIVE), "active").otherwise(status)


def status_counts(rows: DataFrame, groups: Sequence[str] = GROUPS) -> DataFrame:
    """Rows (status_group, n) for rows (status); groups without rows count 0."""
    n = rows.groupBy(status_group(F.col("status")).alias("status_group")).agg(F.count("*").alias("n"))
    all_ = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(g) for g in groups])).alias("status_group"))
    return all_.join(n, "status_group", "left").select("status_group", F.coalesce("n", F.lit(0)).alias("n"))


def upserted(old: DataFrame, new: DataFrame, key: str, kept: Sequence[str], cleared: Sequence[str] = ()) -> DataFrame:
    """The next snapshot: new rows take the place of old ones of the same key, but for the kept columns; cleared ones are null."""
    a, b = old.alias("a"), new.alias("b")
    hit = F.col(f"b.{key}").isNotNull()
    met = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")

    def column(c: str) -> Column:
        if c == key:
            return F.coalesce(f"b.{c}", f"a.{c}")
        if c in cleared:
            return F.when(~hit, F.col(f"a.{c}"))
        if c in kept:
            return F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}"))
        return F.when(hit, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))

    return met.select(*[column(c).alias(c) for c in old.columns])


def visible(tasks: DataFrame, parts: DataFrame) -> DataFrame:
    """Tasks with their numbers of parts, and parts with what they inherit, as one list (kind, id, part_index, ...)."""
    n = parts.groupBy("parent_task_id").agg(F.count("*").alias("n_parts"))
    t = tasks.join(n, F.col("id") == F.col("parent_task_id"), "left").select(F.lit("task").alias("kind"), "id", F.lit(None).cast("long").alias("part_index"), "profile_id", "status", "updated_at", F.coalesce("n_parts", F.lit(0)).alias("n_parts"))
    p = parts.alias("p").join(tasks.alias("t"), F.col("p.parent_task_id") == F.col("t.id"))
    return t.unionByName(p.select(F.lit("part").alias("kind"), F.col("t.id").alias("id"), "part_index", "t.profile_id", "p.status", "p.updated_at", F.lit(0).cast("long").alias("n_parts")))


def newest(rows: DataFrame, n: int, *ties: str) -> DataFrame:
    return rows.orderBy(F.desc("updated_at"), *ties).limit(n)


def retry_candidates(tasks: DataFrame, parts: DataFrame, sources: DataFrame) -> DataFrame:
    """Failed tasks and failed parts whose task's source (id) is still there."""
    t = tasks.where("status = 'failed'").select("id", F.lit(None).cast("long").alias("part_index"))
    p = parts.where("status = 'failed'").select(F.col("parent_task_id").alias("id"), "part_index")
    return t.unionByName(p).join(sources.select("id"), "id", "left_semi")


def recovered(kind: Column, status: Column, has_batch: Column) -> Column:
    """What a job that was interrupted does next; null where nothing."""
    return (
        F.when((kind == "tag") & status.isin(*TAG_ACTIVE), "requeue")
        .when((kind == "task") & (status == "converting"), "wait_for_parts")
        .when((kind == "part") & (status == "uploading"), "reset")
        .when((kind == "part") & (status == "processing"), F.when(has_batch, "resume").otherwise("reset"))
    )


def should_requeue(status: Column, job_schema: Column, schema: Column) -> Column:
    return F.when(status.isin(*TAG_ACTIVE), False).when(status.isin("completed", "queued"), job_schema != schema).otherwise(status.isin("failed", "outdated", "cancelled"))


def without_profile(frame: DataFrame, profiles: DataFrame, key: str = "profile_id") -> DataFrame:
    return frame.join(profiles.select(F.col("profile_id").alias(key)), key, "left_anti")


def profile_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows (id, change) of profiles (id, rules): removed, added or changed."""
    met = old.select("id", F.col("rules").alias("was"), F.lit(True).alias("in_old")).join(new.select("id", "rules", F.lit(True).alias("in_new")), "id", "full")
    change = F.when(F.col("in_new").isNull(), "removed").when(F.col("in_old").isNull(), "added").when(~F.col("was").eqNullSafe(F.col("rules")), "changed")
    return met.select("id", change.alias("change")).where("change is not null")


def retry_actions(tasks: DataFrame, parts: DataFrame, current: DataFrame) -> DataFrame:
    """Rows (id, part_index, action) for failed tasks and parts: requeue where the source changed since, else reset the failed parts or the task.

    tasks (id, status, source_hash), parts (parent_task_id, part_index, status), current (id, content_hash); sources that are gone give no row.
    """
    known = tasks.join(current, "id").withColumn("changed", ~F.col("source_hash").eqNullSafe(F.col("content_hash")))
    failed = parts.where("status = 'failed'").select(F.col("parent_task_id").alias("id"), "part_index")
    part = known.join(failed, "id").where("not changed").select("id", "part_index", F.lit("reset_part").alias("action"))
    own = known.join(failed.select("id").distinct().withColumn("has_failed", F.lit(True)), "id", "left").where("changed and (has_failed or status = 'failed') or status = 'failed' and has_failed is null")
    return part.unionByName(own.select("id", F.lit(None).cast("long").alias("part_index"), F.when(F.col("changed"), "requeue").otherwise("reset").alias("action")))


def first_wins(rows: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The first row of each key."""
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*[rows[c] for c in rows.columns]), F.struct(*order)).alias("row"))
    return first.select("row.*")

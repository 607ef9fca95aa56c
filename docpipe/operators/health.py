"""Health rows, counts of impact and usage over the state tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("ok", "warning", "error")


def rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level)


def worst(rows: DataFrame) -> DataFrame:
    """The overall level of health rows (check, level)."""
    return rows.agg(F.max_by("level", rank(F.col("level"))).alias("level"), F.count("*").alias("checks"))


def health(roots: DataFrame, overlaps: DataFrame, tasks: DataFrame, ocr_ready: bool) -> DataFrame:
    """Rows (check, level, n): configured roots, overlapping roots, tasks that wait for a service, failures."""
    n = lambda df, name, level: df.agg(F.lit(name).alias("check"), F.when(F.count("*") > 0, level[0]).otherwise(level[1]).alias("level"), F.count("*").alias("n"))
    return (
        n(roots, "roots", ("ok", "warning"))
        .unionByName(n(overlaps, "overlaps", ("error", "ok")))
        .unionByName(n(tasks.where("status = 'waiting_mineru'"), "ocr", ("ok" if ocr_ready else "warning", "ok")))
        .unionByName(n(tasks.where("status = 'failed'"), "failures", ("warning", "ok")))
    )


def profile_health(profiles: DataFrame, overlaps: DataFrame, model_ready: bool) -> DataFrame:
    """Rows (profile_id, check, level) of profiles (profile_id, enabled, available, tagging, labels): input, overlap and model of each.

    overlaps: (outer, inner) of profiles. The model is needed where classification is on; without labels nothing can be chosen.
    """
    both = overlaps.select(F.explode(F.array("outer", "inner")).alias("profile_id")).distinct().withColumn("overlaps", F.lit(True))
    met = profiles.join(both, "profile_id", "left")
    input_ = F.when(~F.col("enabled"), "ok").when(F.col("available"), "ok").otherwise("error")
    model = F.when(~F.col("tagging"), "ok").when(F.col("labels") == 0, "error").when(F.lit(model_ready), "ok").otherwise("warning")
    checks = {"input": input_, "overlap": F.when(F.col("overlaps"), "error").otherwise("ok"), "model": model}
    return met.select("profile_id", F.explode(F.array(*[F.struct(F.lit(k).alias("check"), v.alias("level")) for k, v in checks.items()])).alias("x")).select("profile_id", "x.*")


def rules_impact(found: DataFrame, jobs: DataFrame, schema: str) -> DataFrame:
    """One row (discovered, new, affected) of Markdown files (path) and jobs (path, schema_hash, status) under new rules."""
    met = found.join(jobs, "path", "left")
    new = F.col("status").isNull()
    touched = new | (F.col("schema_hash") != schema) | (F.col("status") != "completed")
    return met.agg(F.count("*").alias("discovered"), F.count_if(new).alias("new"), F.count_if(touched).alias("affected"))


def usage(jobs: DataFrame) -> DataFrame:
    """Rows by profile of jobs (profile_id, calls, input_tokens, output_tokens, read_bytes, total_bytes); failed runs count too."""
    s = [F.sum(F.col(x).cast("long")).alias(x) for x in ("calls", "input_tokens", "output_tokens", "read_bytes", "total_bytes")]
    out = jobs.groupBy("profile_id").agg(F.count("*").alias("jobs"), *s)
    covered = F.when(F.col("total_bytes") > 0, F.least(F.lit(100), F.round(100.0 * F.col("read_bytes") / F.col("total_bytes")).cast("long"))).otherwise(0)
    return out.withColumn("tokens", F.col("input_tokens") + F.col("output_tokens")).withColumn("coverage", covered.cast("long"))


def asset_budget(assets: DataFrame, limit: int) -> DataFrame:
    """Rows (doc_id, bytes, fits) of assets (doc_id, resource, bytes): each resource of a document counts once."""
    once = assets.groupBy("doc_id", "resource").agg(F.max("bytes").alias("bytes"))
    return once.groupBy("doc_id").agg(F.sum("bytes").alias("bytes")).withColumn("fits", F.col("bytes") <= limit)


def searched(rows: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows any of whose columns, joined by blanks, contain a text; a missing value leaves its place empty."""
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in columns]))
    return rows.where(hay.contains(needle.strip().lower()))

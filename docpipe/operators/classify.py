"""Rules, questions, answers and their write-back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docpipe.functions import text as T
from docpipe.operators.order import numbered

FALLBACK, FALLBACK_ID, BATCH, MOST_OPTIONS, PREFIX_BYTES = "未分类", "unclassified", 16, 254, 32 * 1024


def rule_errors(labels: DataFrame) -> DataFrame:
    """labels (pos, name, description) with `error`: empty_name, reserved_name, duplicate_name or null."""
    name = T.trimmed(F.col("name"))
    same = Window.partitionBy(F.lower(T.trimmed(F.col("name"))))
    first = F.row_number().over(same.orderBy("pos"))
    error = F.when(name == "", "empty_name").when(name == FALLBACK, "reserved_name").when(first > 1, "duplicate_name")
    return labels.withColumn("error", error)


def rules_hash(mode: Column, labels: Column) -> Column:
    """A hash of the mode and the ordered names and descriptions; labels: array of structs (id, name, description)."""
    plain = F.transform(labels, lambda x: F.concat(x["name"], F.lit("\x1f"), x["description"]))
    return F.sha2(F.concat(mode, F.lit("\x1e"), F.array_join(plain, "\x1e")), 256)


def question_batches(labels: DataFrame) -> DataFrame:
    """Rows (batch, questions: JSON) of labels (pos from 0, name): 16 yes/no questions a request, by positional key."""
    key = F.concat(F.lit("label_"), F.col("pos").cast("string"))
    each = labels.select(F.floor(F.col("pos") / BATCH).alias("batch"), F.struct("pos", key.alias("key"), "name").alias("q"))
    held = each.groupBy("batch").agg(F.array_sort(F.collect_list("q")).alias("qs"))
    return held.select("batch", F.size("qs").cast("long").alias("n"), F.to_json(F.map_from_entries(F.transform("qs", lambda q: F.struct(q["key"], q["name"])))).alias("questions"))


def read_single(answers: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, category, error) of answers (doc_id, choice) by labels (label_key, name)."""
    met = answers.join(labels, F.col("choice") == F.col("label_key"), "left")
    known = F.col("label_key").isNotNull() | (F.col("choice") == FALLBACK_ID)
    return met.select("doc_id", F.when(F.col("choice") == FALLBACK_ID, FALLBACK).otherwise(F.col("name")).alias("category"), F.when(~F.coalesce(known, F.lit(False)), "unknown_choice").alias("error"))


def read_multi(answers: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, categories, error) of answers (doc_id, label_key, p double): above 0.5 is chosen, in rule order.

    No choice is the fallback. A probability that is null, not finite or outside 0 to 1, or an unknown key, voids a document.
    """
    met = answers.join(labels.select("label_key", "name", "pos"), "label_key", "left")
    fine = F.col("pos").isNotNull() & F.col("p").isNotNull() & ~F.isnan("p") & F.col("p").between(0.0, 1.0)
    chosen = F.transform(F.array_sort(F.collect_list(F.when(F.col("p") > 0.5, F.struct("pos", "name")))), lambda x: x["name"])
    out = met.groupBy("doc_id").agg(F.bool_and(fine).alias("ok"), chosen.alias("names"))
    categories = F.when(F.col("ok"), F.when(F.size("names") == 0, F.array(F.lit(FALLBACK))).otherwise(F.col("names")))
    return out.select("doc_id", categories.alias("categories"), F.when(~F.col("ok"), "invalid_answer").alias("error"))


def submitted(values: Column, mode: Column, allowed: Column) -> Column:
    """The outcome of submitted categories: ok, or what is wrong with them. values, allowed: arrays of strings."""
    v = F.transform(values, T.trimmed)
    return (
        F.when(values.isNull() | (F.size(values) == 0), "empty")
        .when((mode == "single") & (F.size(values) != 1), "not_single")
        .when(F.size(F.array_except(v, F.concat(allowed, F.array(F.lit(FALLBACK))))) > 0, "unknown_category")
        .when(F.array_contains(v, FALLBACK) & (F.size(F.array_distinct(v)) > 1), "fallback_not_alone")
        .otherwise("ok")
    )


def canonical(values: Column, allowed: Column) -> Column:
    """Chosen categories in rule order, each once; the fallback stays as it is."""
    v = F.transform(values, T.trimmed)
    return F.when(F.array_contains(v, FALLBACK), F.array(F.lit(FALLBACK))).otherwise(F.filter(allowed, lambda a: F.array_contains(v, a)))


def compare_and_set(results: DataFrame, current: DataFrame) -> DataFrame:
    """results (path, read_hash, ...) with `outcome`: applied, conflict (the content changed since) or gone."""
    met = results.join(current.select("path", F.col("content_hash").alias("now_hash")), "path", "left")
    return met.withColumn("outcome", F.when(F.col("now_hash").isNull(), "gone").when(F.col("now_hash") == F.col("read_hash"), "applied").otherwise("conflict"))


def late_results(results: DataFrame, documents: DataFrame, profiles: DataFrame) -> DataFrame:
    """results (path, profile_id, read_hash, read_rules, read_epoch, ...) with `outcome`: applied, or why a result comes too late.

    A result holds for one version of its document, of its profile's rules and of the profile itself, which it names:
    cancelled, where the profile is gone, off or was set up anew since (another epoch); gone, where the document is;
    conflict, where its content changed; outdated, where the rules did. The first that is true is named. documents (path,
    content_hash); profiles (profile_id, enabled, rules_hash, epoch), each a row a key.
    """
    held = profiles.select("profile_id", "enabled", F.col("rules_hash").alias("now_rules"), F.col("epoch").alias("now_epoch"))
    met = results.join(documents.select("path", F.col("content_hash").alias("now_hash")), "path", "left").join(held, "profile_id", "left")
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    outcome = (
        F.when(~(F.coalesce("enabled", F.lit(False)) & same("read_epoch", "now_epoch")), "cancelled").when(F.col("now_hash").isNull(), "gone")
        .when(~same("read_hash", "now_hash"), "conflict").when(~same("read_rules", "now_rules"), "outdated").otherwise("applied")
    )
    return met.withColumn("outcome", outcome).select(*results.columns, "outcome")


def apply_rules(files: DataFrame, jobs: DataFrame, enabled: bool, existing: bool) -> DataFrame:
    """Rows (path, action) of files (path) and jobs (path, status) when rules change.

    existing: all are queued; else known jobs become outdated and unknown files are recorded as cancelled. Not enabled:
    queued and outdated jobs are cancelled.
    """
    met = files.join(jobs, "path", "full")
    if not enabled:
        action = F.when(F.col("status").isin("queued", "outdated"), "cancel")
    elif existing:
        action = F.when(~F.coalesce(F.col("status").isin("reading", "writing"), F.lit(False)), "queue")
    else:
        action = F.when(F.col("status").isNull(), "record_cancelled").otherwise("mark_outdated")
    return met.select("path", action.alias("action")).where("action is not null")


def import_preview(new: DataFrame, old: DataFrame) -> DataFrame:
    """new (pos, name, description) with `outcome` against old (name, description): added, identical or conflict."""
    o = old.select(T.normalized_name(F.col("name")).alias("key"), T.trimmed(F.col("description")).alias("was")).withColumn("known", F.lit(True))
    n = new.withColumn("key", T.normalized_name(F.col("name")))
    met = n.join(o, "key", "left")
    outcome = F.when(F.col("known").isNull(), "added").when(F.col("was").eqNullSafe(T.trimmed(F.col("description"))), "identical").otherwise("conflict")
    return met.select("pos", "key", outcome.alias("outcome"))


def import_merge(new: DataFrame, old: DataFrame, overwrite: bool) -> DataFrame:
    """The merged rules (place, name, description): old names and order kept, descriptions overwritten if asked, new ones after."""
    o = old.select("pos", "name", "description", T.normalized_name(F.col("name")).alias("key"))
    n = new.select(F.col("pos").alias("new_pos"), T.trimmed(F.col("name")).alias("new_name"), T.trimmed(F.col("description")).alias("new_description"), T.normalized_name(F.col("name")).alias("key"))
    met = o.join(n, "key", "full")
    description = F.when(F.col("pos").isNull() | F.lit(overwrite) & F.col("new_pos").isNotNull(), F.col("new_description")).otherwise(F.col("description"))
    placed = numbered(met.withColumn("new_text", description), [], [F.col("pos").isNull(), F.col("pos"), F.col("new_pos")])
    return placed.select("place", F.coalesce("name", "new_name").alias("name"), F.col("new_text").alias("description"))


def category_batches(batches: DataFrame) -> DataFrame:
    """batches (batch, json) checked: rows (batch, n, error_position, error).

    A batch is a nonempty array of objects with exactly the texts `name` and `description`; any bad item rejects it with its place, from 1.
    """
    item = F.posexplode("items").alias("i", "item")
    parsed = batches.withColumn("v", F.try_parse_json("json")).withColumn("items", F.try_variant_get("v", "$", "array<variant>"))
    each = parsed.where("items is not null and size(items) > 0").select("batch", item)
    text = lambda k: F.schema_of_variant(F.try_variant_get("item", f"$.{k}", "variant")) == "STRING"
    keys = F.array_sort(F.json_object_keys(F.to_json("item")))
    name = T.normalized_name(F.try_variant_get("item", "$.name", "string"))
    each = each.withColumn("shape", F.coalesce((keys == F.array(F.lit("description"), F.lit("name"))) & text("name") & text("description"), F.lit(False))).withColumn("key", F.when(F.col("shape"), name))
    twice = F.row_number().over(Window.partitionBy("batch", "key").orderBy("i")) > 1
    error = F.when(~F.col("shape"), "bad_item").when(F.col("key") == "", "empty_name").when(F.col("key") == FALLBACK, "reserved_name").when(twice, "duplicate_name")
    each = each.withColumn("error", error)
    bad = F.when(F.col("error").isNotNull(), F.col("i") + 1)
    found = each.groupBy("batch").agg(F.count("*").alias("n"), F.min(bad).alias("error_position"), F.min_by("error", bad).alias("error"))
    return parsed.select("batch", "items").join(found, "batch", "left").select("batch", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("items").isNotNull() & (F.size("items") > 0), F.col("error_position").cast("long")).otherwise(F.lit(0)).alias("error_position"), F.when(F.col("items").isNull() | (F.size("items") == 0), "not_an_array").otherwise(F.col("error")).alias("error"))


def request_body(model: str, document: Column, truncated: Column, questions: Column) -> Column:
    """The JSON of a request: model, state and questions."""
    state = F.struct(document.alias("document"), truncated.alias("truncated"))
    return F.to_json(F.struct(F.lit(model).alias("model"), state.alias("state"), questions.alias("questions")))


def single_question(labels: DataFrame, *groups: str) -> DataFrame:
    """A row (groups, n, options: JSON, error) for each group of labels (pos from 0, name): the options of a single choice, the fallback last.

    A request has MOST_OPTIONS labels at most; more are an error.
    """
    held = labels.groupBy(*groups).agg(F.array_sort(F.collect_list(F.when(F.col("pos") <= MOST_OPTIONS, F.struct("pos", "name")))).alias("l"), F.count("*").alias("n"))
    options = F.concat(F.transform("l", lambda x: F.struct(F.concat(F.lit("label_"), x["pos"].cast("string")).alias("id"), x["name"].alias("name"))), F.array(F.struct(F.lit(FALLBACK_ID).alias("id"), F.lit(FALLBACK).alias("name"))))
    return held.select(*groups, "n", F.when(F.col("n") <= MOST_OPTIONS, F.to_json(options)).alias("options"), F.when(F.col("n") > MOST_OPTIONS, "too_many_options").alias("error"))


def import_result(preview: DataFrame, overwrite: bool) -> DataFrame:
    """One row (added, skipped, overwritten) of an import's preview (outcome)."""
    conflicts, same = F.count_if(F.col("outcome") == "conflict"), F.count_if(F.col("outcome") == "identical")
    over = conflicts if overwrite else F.lit(0).cast("long")
    return preview.agg(F.count_if(F.col("outcome") == "added").alias("added"), (same + conflicts - over).alias("skipped"), over.alias("overwritten"))

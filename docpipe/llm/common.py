"""What the training-data operators share: tables, scratch tables, split tests, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docpipe.sources import tables
from docpipe.sources.tables import give_back, text_batches  # noqa: F401

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def lower_ascii(x: Column) -> Column:
    """A-Z lower-cased, nothing else. Strings of ASCII alone take the faster way."""
    return F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(F.translate(x, UPPER, LOWER))


#: Scratch tables of this process that are still there.
_held: list[str] = []


def written(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, and the table's place. Cuts the lineage; survives lost executors."""
    out, path = tables.written(df, what)
    _held.append(path)
    return out, path


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that no later plan reads."""
    tables.removed(spark, path)
    if path in _held:
        _held.remove(path)


def release(spark: SparkSession) -> None:
    """Deletes all scratch tables of this process. Call it when results are written: what still reads them is lost."""
    for path in [*_held]:
        removed(spark, path)


def bounded_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """df marked for broadcast if its counted rows are within limit, else df for a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Connected components of edges (a, b: long): rows (id, component), component the smallest id reachable.

    Each round takes the smallest label among a vertex and its neighbours, then the label's own label (pointer
    jumping), so long chains close in logarithmic rounds. Labels are a written table each round; a round's hub is
    pre-aggregated by the minimum, and the join on a hub's label is split by adaptive execution. Empty edges give no row.
    """
    spark = edges.sparkSession
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both, edge_path = written(both, "edges")
    label, path = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("l")), "labels")
    for _ in range(max_rounds):
        near = both.join(label.select(F.col("id").alias("b"), "l"), "b").groupBy(F.col("a").alias("id")).agg(F.min("l").alias("m"))
        low = label.join(near, "id").select("id", F.least("l", "m").alias("m"), F.col("l").alias("was"))
        low, low_path = written(low, "low")
        jump = low.select(F.col("id").alias("m"), F.col("m").alias("j"))
        new, new_path = written(low.join(jump, "m").select("id", F.least("m", "j").alias("l"), "was"), "labels")
        changed = new.where("l <> was").limit(1).count()
        removed(spark, low_path)
        removed(spark, path)
        label, path = new.select("id", "l"), new_path
        if not changed:
            removed(spark, edge_path)
            return label.withColumnRenamed("l", "component")
    raise RuntimeError("components did not converge")


def labelled_components(edges: DataFrame, classes: DataFrame, limit: int) -> DataFrame:
    """Connected components of edges (a, b) of classes (cid, key, label): rows (cid, component, head).

    component is the smallest label in it, null if none has one; head the key of the class that has it, the smallest where
    labels are equal. Up to limit components are broadcast.
    """
    roots, _ = written(components(edges).withColumnRenamed("id", "cid"), "roots")
    least = F.struct(F.col("label").isNull().alias("none"), "label", "key")
    low = roots.join(classes.select("cid", "key", "label"), "cid").groupBy(F.col("component").alias("root")).agg(F.min(least).alias("low"))
    low, _ = written(low, "low")
    met = roots.join(bounded_broadcast(low, low.count(), limit), F.col("component") == F.col("root"))
    return met.select("cid", F.col("low.label").alias("component"), F.col("low.key").alias("head"))

"""Mixing sources to target weights.

Sizes are summed per source, a target is set for each source, and each document is taken floor(rate) times plus one
copy decided by a draw seeded with the document's id, with probability equal to the rate's fraction.

Cases: null text counts 0 words; very long texts count whole, and weigh as much as their words; null source is a source of
its own, last; a source without words has target 0 and its documents are taken 0 times; sources that reach their cap at the
same level are capped in order of name; repeated rows of one id share their draw; an empty table gives an empty result; other
columns, whatever their names, pass through `mix` untouched. Targets are found in one task over a row for each source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docpipe.llm.common import WORD, table, written

#: The number of sources up to which their rates are broadcast.
BROADCAST_SOURCES = 100_000
SALTS = 64


def targets(per_source: DataFrame, weights: Sequence[float], epochs: float, cap: float) -> DataFrame:
    """per_source (source, source_size) with target: epochs of all words shared by weight, none above cap times its size.

    Sources sorted by the level at which they reach their cap; the level of the first source that stays below its cap
    when all before it are full is the level of all the others; the levels after it only fall, so it is the highest of them.
    """
    ranked = per_source.withColumn("n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("n") - 1) % len(weights) + 1).cast("int"))
    order = Window.orderBy("full_at", "n")
    levels = (
        ranked.withColumns({"weight": weight, "most": F.col("source_size") * F.lit(float(cap))})
        .withColumn("full_at", F.col("most") / F.col("weight"))
        .withColumns({
            "before": F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "rest": F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
            "all": F.sum("source_size").over(Window.partitionBy()) * F.lit(float(epochs)),
        })
        .withColumn("level", (F.col("all") - F.col("before")) / F.col("rest"))
    )
    level = F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(Window.partitionBy())
    return levels.select("source", "source_size", F.least("most", F.coalesce(level * F.col("weight"), F.col("most"))).alias("target"))


def copies(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), epochs: float = 1.5, cap: float = 2.0, seed: int = 42) -> DataFrame:
    """Rows (row: all of docs' columns, size, source_size, target, copies) for docs (doc_id, text, source, ...)."""
    sized = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        docs["doc_id"].cast("string").alias("key"),
        docs["source"].alias("source"),
        F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan, _ = written(targets(per_source, weights, epochs, cap), "mix")
    plan = plan.withColumnRenamed("source", "plan_source")
    n = plan.count()
    if n <= BROADCAST_SOURCES:
        joined = sized.join(F.broadcast(plan), sized["source"].eqNullSafe(plan["plan_source"]))
    else:  # many sources, of which one may hold a third of the rows: its rows are dealt over SALTS keys
        salt = F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")
        spread = plan.withColumn("plan_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = sized.withColumn("salt", salt).join(spread, F.col("source").eqNullSafe(F.col("plan_source")) & (F.col("salt") == F.col("plan_salt")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("key", F.lit("")))), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))
    whole = F.floor(rate)
    return joined.select("row", "size", "source_size", "target", (whole + F.when(draw < rate - whole, 1).otherwise(0)).cast("long").alias("copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """docs with each row as often as the mix takes it."""
    taken = copies(docs, **how).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return copies(docs).select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
per as (select source, sum(size)::bigint as source_size from sized group by source),
ranked as (select *, row_number() over (order by source nulls last) as n from per),
w as (select *, case (n - 1) % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as weight, source_size * 2.0::double as most from ranked),
f as (select *, most / weight as full_at from w),
l as (select *, ((sum(source_size) over ())::double * 1.5::double
    - coalesce(sum(most) over (order by full_at, n rows between unbounded preceding and 1 preceding), 0.0))
    / sum(weight) over (order by full_at, n rows between current row and unbounded following) as level from f),
t as (select source, source_size, least(most, coalesce(max(case when level <= full_at then level end) over () * weight, most)) as target from l),
r as (select doc_id, size, source_size, target, case when source_size > 0 then target / source_size else 0.0 end as rate,
    ('0x' || substr(md5('42:' || coalesce(doc_id::varchar, '')), 1, 12))::bigint::double / 281474976710656.0::double as draw
  from sized join t on sized.source is not distinct from t.source),
c as (select *, (floor(rate) + case when draw < rate - floor(rate) then 1 else 0 end)::bigint as copies from r)
select doc_id, size, source_size, target, size * copies as taken, copies from c
"""

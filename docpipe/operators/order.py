"""Numbers within groups of any size, without one task a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docpipe.sources.tables import written


def numbered(rows: DataFrame, groups: Sequence[str], order: Sequence[Column], name: str = "place") -> DataFrame:
    """rows with their place, from 1, within their group by ascending values, nulls first, that tie between equal rows alone.

    Rows are dealt by ranges of group and order, so a large group spreads over many ranges; they are numbered within
    their range, and the rows of their group in the ranges before are added. groups may be empty; its columns may be null.
    """
    keys = [f"order_{i}" for i in range(len(order))]
    held = rows.withColumns(dict(zip(keys, order, strict=True))).repartitionByRange(*groups, *keys)
    held, _ = written(held.withColumn("range", F.spark_partition_id()), "ranges")
    sizes = held.groupBy("range", *groups).agg(F.count("*").alias("rows_here"))
    # A row for each range and group in it: far fewer than rows.
    before = Window.partitionBy(*groups).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("range").alias("range_"), *[F.col(g).alias(f"{g}_") for g in groups], F.coalesce(F.sum("rows_here").over(before), F.lit(0)).alias("rows_before"))
    placed = held.withColumn("place_here", F.row_number().over(Window.partitionBy("range", *groups).orderBy(*keys)))
    on = F.col("range") == F.col("range_")
    for g in groups:
        on &= F.col(g).eqNullSafe(F.col(f"{g}_"))
    return placed.join(offsets, on).select(*rows.columns, (F.col("rows_before") + F.col("place_here")).cast("int").alias(name))

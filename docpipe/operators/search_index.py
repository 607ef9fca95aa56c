"""Substring search by an index of trigrams.

Each text, lower-cased and padded at its end, is cut into trigrams, one from each of its places; the index holds a row for each
trigram and text, in parts by the trigram's first character and a hash of the rest. A needle of three characters or more
reads the parts of its rarest trigrams alone, intersects their lists and is then held against the texts that are left; a
shorter one reads the parts of its first character, whose trigrams that begin with it are exact by themselves. How frequent
each trigram is stands in a table beside, in the same parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of the first character, and of the rest; trigrams of a needle that are intersected, the rarest.
FIRST, REST, RAREST = 64, 8, 3
#: Fills a text's last trigrams; no text that is searched has it.
PAD = "\x00"
SCHEMA = "gram string, id {id}, part int"


def grams(text: Column) -> Column:
    """The trigrams of a text's places, once each."""
    padded = F.concat(F.lower(text), F.lit(PAD * 2))
    places = F.sequence(F.lit(1), F.length(padded) - 2)
    return F.when(F.length(text) > 0, F.array_distinct(F.transform(places, lambda k: F.substring(padded, k, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def part(gram: Column) -> Column:
    return (F.pmod(F.xxhash64(F.substring(gram, 1, 1)), F.lit(FIRST)) * REST + F.pmod(F.xxhash64(F.substring(gram, 2, 2)), F.lit(REST))).cast("int")


def build(texts: DataFrame, path: str) -> None:
    """Writes the index of texts (id, text) below a folder; ids are unique."""
    rows = texts.select("id", F.explode(grams(F.col("text"))).alias("gram")).withColumn("part", part(F.col("gram")))
    # A frequent trigram is dealt by its texts too; within files trigrams are in order, so a look reads few row groups.
    rows.repartition("part", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("part", "gram", "id").write.partitionBy("part").mode("overwrite").parquet(f"{path}/postings")
    held = texts.sparkSession.read.parquet(f"{path}/postings")
    held.groupBy("part", "gram").agg(F.count("*").alias("n")).repartition("part").sortWithinPartitions("part", "gram").write.partitionBy("part").mode("overwrite").parquet(f"{path}/counts")


def needle_grams(needle: str) -> list[str]:
    return sorted({needle[k : k + 3] for k in range(len(needle) - 2)})


def found(spark: SparkSession, path: str, texts: DataFrame, needles: Sequence[str]) -> DataFrame:
    """Rows (needle, id) of texts (id, text) that contain each needle, trimmed and lower-cased; the empty needle is in all."""
    wanted = sorted({n.strip().lower() for n in needles})
    long_, short = [n for n in wanted if len(n) >= 3], [n for n in wanted if 0 < len(n) < 3]
    out = texts.select(F.lit("").alias("needle"), "id").where(F.lit("" in wanted))
    postings = spark.read.parquet(f"{path}/postings")
    if long_:
        asked = [(n, g) for n in long_ for g in needle_grams(n)]
        rows = spark.createDataFrame(asked, "needle string, gram string").withColumn("part", part(F.col("gram")))
        parts = [x["part"] for x in rows.select("part").distinct().collect()]  # of the needles' trigrams
        counts = spark.read.parquet(f"{path}/counts").where(F.col("part").isin(parts) & F.col("gram").isin(sorted({g for _, g in asked})))
        frequency = {x["gram"]: x["n"] for x in counts.select("gram", "n").collect()}  # a row a trigram of the needles
        rare = [(n, g) for n in long_ if all(g in frequency for g in needle_grams(n)) for g in sorted(needle_grams(n), key=lambda g: (frequency[g], g))[:RAREST]]
        if rare:
            named = spark.createDataFrame([(n, g, min(RAREST, len(needle_grams(n)))) for n, g in rare], "needle string, gram string, all_ int").withColumn("part", part(F.col("gram")))
            parts = sorted(x["part"] for x in named.select("part").distinct().collect())
            lists = postings.where(F.col("part").isin(parts) & F.col("gram").isin(sorted({g for _, g in rare})))
            met = lists.join(F.broadcast(named.drop("part")), "gram").groupBy("needle", "id", "all_").agg(F.count("*").alias("n")).where("n = all_")
            out = out.unionByName(met.select("needle", "id").join(texts.select("id", "text"), "id").where(F.contains(F.lower("text"), F.col("needle"))).select("needle", "id"))
    for n in short:
        parts = spark.range(REST).select((F.pmod(F.xxhash64(F.lit(n[0])), F.lit(FIRST)) * REST + F.col("id")).cast("int").alias("part"))
        own = postings.where(F.col("part").isin([x["part"] for x in parts.collect()]) & F.col("gram").startswith(n))
        out = out.unionByName(own.select(F.lit(n).alias("needle"), "id").distinct())
    return out

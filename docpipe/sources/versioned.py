"""Tables in parts by a hash of a key, of which a version writes the touched parts alone.

A version's rows are in {base}/v=<n>/part=<p>; its manifest {base}/manifests/<n>.json names, for each part, the version that
holds it. A part without rows is in no manifest. A version counts once its manifest is there, which is written last and
renamed into place, so readers see whole versions, and a version written again finds its manifest and does nothing. A read
takes one listing, of the manifests, and one small file, however many versions there were; `clean` deletes what no manifest
that is kept names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docpipe.sources.tables import folders, removed

#: Parts of a table.
PARTS = 64


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file, seen whole or not at all."""
    place, fs = _fs(spark, path)
    draft, _ = _fs(spark, path + ".draft")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(place, False)
    if not fs.rename(draft, place):
        raise OSError(f"cannot rename to {path}")


def get_text(spark: SparkSession, path: str) -> str:
    place, fs = _fs(spark, path)
    into = fs.open(place)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(into, "UTF-8")
    finally:
        into.close()


class Versioned:
    """A table of a schema; part: the part of a row, from 0, an int column; by default of a hash of the column key."""

    def __init__(self, spark: SparkSession, base: str, schema: StructType, key: str | Column, parts: int = PARTS):
        self.spark, self.base, self.schema = spark, base, schema
        self.part = self.part_of(F.col(key), parts) if isinstance(key, str) else key

    @staticmethod
    def part_of(key: Column, parts: int = PARTS) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(parts)).cast("int")

    def manifests(self) -> list[int]:
        return sorted(int(x[:-5]) for x in folders(self.spark, f"{self.base}/manifests") if x.endswith(".json"))

    def held(self, version: int | None = None) -> tuple[int | None, dict[int, str]]:
        """(version, its parts with the name of the version that holds each), of the newest version or a given one."""
        known = self.manifests() if version is None else [version]
        if not known:
            return None, {}
        return known[-1], {int(p): str(v) for p, v in json.loads(get_text(self.spark, f"{self.base}/manifests/{known[-1]:012d}.json")).items()}

    def read(self, parts: Iterable[int] | None = None, version: int | None = None) -> DataFrame:
        """The rows of some parts, or of all, in the newest version or a given one."""
        _, held = self.held(version)
        wanted = held if parts is None else {p: held[p] for p in parts if p in held}
        paths = [f"{self.base}/v={v}/part={p}" for p, v in sorted(wanted.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def touched(self, rows: DataFrame) -> list[int]:
        """The parts that rows (with the columns of the key) are in."""
        return sorted(x["part"] for x in rows.select(self.part.alias("part")).distinct().collect())  # a row a part at most

    def write(self, version: int, rows: DataFrame, parts: Sequence[int], anew: bool = False) -> bool:
        """Puts rows in place of all that is in these parts; False, and nothing is done, where the version is there or a later one.

        anew: the newest version is written anew under its number, so that numbers stay those of a stream's batches. No
        stream may write meanwhile.
        """
        last, held = self.held()
        if last is not None and (last > version or last == version and not anew):
            return False
        name = f"{version}-{uuid.uuid4().hex[:8]}" if anew else str(version)
        names = [f.name for f in self.schema.fields]
        dealt = rows.select(*names, self.part.alias("part")).repartition("part")  # else each task would write a file of each part
        dealt.write.partitionBy("part").mode("overwrite").parquet(f"{self.base}/v={name}")
        new = {int(x[5:]) for x in folders(self.spark, f"{self.base}/v={name}") if x.startswith("part=")}
        if new - set(parts):
            raise ValueError(f"rows of parts that were not named: {sorted(new - set(parts))}")
        held = {p: v for p, v in held.items() if p not in set(parts)} | dict.fromkeys(new, name)
        put_text(self.spark, f"{self.base}/manifests/{version:012d}.json", json.dumps(held))
        return True

    def clean(self, keep: int = 2) -> None:
        """Deletes all manifests but the last `keep`, and what none of them names. Readers of older versions lose them."""
        known = self.manifests()
        for version in known[:-keep]:
            removed(self.spark, f"{self.base}/manifests/{version:012d}.json")
        named = {(v, p) for version in known[-keep:] for p, v in self.held(version)[1].items()}
        for name in folders(self.spark, self.base):
            if name.startswith("v=") and known and int(name[2:].split("-")[0]) <= known[-1]:
                if not any(v == name[2:] for v, _ in named):
                    removed(self.spark, f"{self.base}/{name}")
                    continue
                for part in folders(self.spark, f"{self.base}/{name}"):
                    if part.startswith("part=") and (name[2:], int(part[5:])) not in named:
                        removed(self.spark, f"{self.base}/{name}/{part}")


def put_changes(table: Versioned, changes: DataFrame, batch_id: int, key: str, version: str, gone: str = "gone") -> None:
    """For foreachBatch: puts changes, the last of a key by its version, into a table; rows marked gone stay as tombstones.

    A tombstone outlives late changes of older versions, so a removed key stays removed; `without_gone` is what readers take,
    and `forget` drops tombstones that no change is late enough for any more.
    """
    parts = table.touched(changes)
    old = table.read(parts)
    order = Window.partitionBy(key).orderBy(F.desc(version), F.desc("is_new"))
    both = old.withColumn("is_new", F.lit(0)).unionByName(changes.select(*old.columns).withColumn("is_new", F.lit(1)))
    table.write(batch_id, both.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth", "is_new"), parts)


def without_gone(rows: DataFrame, gone: str = "gone") -> DataFrame:
    return rows.where(~F.coalesce(F.col(gone), F.lit(False))).drop(gone)


def forget(table: Versioned, before: Column, gone: str = "gone") -> bool:
    """Writes the newest version anew without the tombstones for which `before` holds; of the parts that have such alone. Not while a stream writes."""
    last, _ = table.held()
    if last is None:
        return False
    parts = table.touched(table.read().where(F.col(gone) & before))
    return bool(parts) and table.write(last, table.read(parts).where(~(F.coalesce(F.col(gone), F.lit(False)) & before)), parts, anew=True)

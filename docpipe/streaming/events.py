"""Streams of file events, each with a batch twin: stability, debounce, coalescing, versioned upserts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType, TimestampType

from docpipe.functions import paths as P
from docpipe.operators.classify import compare_and_set, late_results
from docpipe.operators.increment import FolderIndex
from docpipe.operators.roots import nearest_root
from docpipe.sources.tables import folders
from docpipe.sources.versioned import Versioned

FILES = StructType([StructField("path", StringType()), StructField("modificationTime", TimestampType()), StructField("length", LongType()), StructField("content", BinaryType())])
#: Repeats that make a file stable, observations after which it is given up.
REPEATS, MOST = 2, 60
#: Time after which a path that is no longer observed is forgotten.
FORGET_MS = 24 * 3600 * 1000
#: Parts of a versioned table, by a hash of the key.
BUCKETS = 64


def arrivals(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """A stream of files (path, modified, size): each path and time once; deletions come from batch rescans."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def signature(seen: DataFrame):
    """What must repeat: the size, and the time of change where it is observed too."""
    return F.struct(*[c for c in ("size", "modified") if c in seen.columns])


def stable_files(seen: DataFrame) -> DataFrame:
    """Batch: rows (path, ts, size, stable) where a path's signature repeats twice in a row, first such time; stable is false where given up.

    seen: observations (path, ts, size) or (path, ts, size, modified).
    """
    order = Window.partitionBy("path").orderBy("ts", "size")
    same = F.coalesce(signature(seen).eqNullSafe(F.lag(signature(seen)).over(order)), F.lit(False))
    marked = seen.withColumn("n", F.row_number().over(order)).withColumn("same", same)
    marked = marked.withColumn("hit", F.col("same") & F.coalesce(F.lag("same").over(order), F.lit(False)))
    first = marked.where(F.col("hit") & (F.col("n") <= MOST)).groupBy("path").agg(F.min_by(F.struct("ts", "size"), F.struct("n")).alias("x"))
    out = seen.select("path").distinct().join(first, "path", "left")
    return out.select("path", "x.ts", "x.size", F.col("x").isNotNull().alias("stable"))


def stable_stream(seen: DataFrame) -> DataFrame:
    """Stream: the same, with the signature, the run of repeats and the number of observations as each path's state.

    A path that was stable, or given up, is watched anew once its signature changes. FORGET_MS after its last
    observation the state goes; then the path counts as never seen.
    """
    timed = "modified" in seen.columns

    def watch(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, changed, run, n, done = state.get if state.exists else (None, None, 0, 0, False)
        for x in batches:
            for row in x.sort_values(["ts", "size"]).itertuples(index=False):
                size, at = int(row.size), (row.modified.value if timed and row.modified is not pd.NaT else None)
                same = last is not None and (size, at) == (last, changed)
                if done and same:
                    continue
                if done:
                    n, run, done = 0, 0, False
                n += 1
                run = run + 1 if same else 0
                last, changed = size, at
                if run >= REPEATS or n >= MOST:
                    done = True
                    yield pd.DataFrame({"path": [key[0]], "ts": [row.ts if run >= REPEATS else pd.NaT], "size": [last], "stable": [run >= REPEATS]})
        state.update((last, changed, run, n, done))
        state.setTimeoutDuration(FORGET_MS)

    return seen.groupBy("path").applyInPandasWithState(watch, "path string, ts timestamp, size long, stable boolean", "last long, changed long, run int, n int, done boolean", "append", "ProcessingTimeTimeout")


def debounced(changes: DataFrame, gap: str, watermark: str | None = None) -> DataFrame:
    """Rows (profile_id, start, end, changes): a rebuild for each run of changes (profile_id, ts) with no longer gap."""
    if watermark:
        changes = changes.withWatermark("ts", watermark)
    s = changes.groupBy("profile_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("changes"))
    return s.select("profile_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "changes")


def coalesced(requests: DataFrame) -> DataFrame:
    """The strongest request for each path: rows (path, strength, requests)."""
    return requests.groupBy("path").agg(F.max("strength").alias("strength"), F.count("*").alias("requests"))


#: Time after which work that never said it was done counts as lost.
LOST_MS = 3600 * 1000


def coalesced_stream(events: DataFrame, lost_ms: int = LOST_MS) -> DataFrame:
    """Stream: rows (path, strength, ts) of the requests that start, from events (path, ts, strength); a null strength says that the path's work is done.

    A request for a path without work starts at once; while it works, the strongest of the others waits, and starts
    when the work is done. What works and what waits is each path's state, so it holds across batches. Work of which
    nothing is heard for lost_ms counts as done.
    """

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        busy, waiting = state.get if state.exists else (False, None)
        if state.hasTimedOut:
            if waiting is None:
                state.remove()
                return
            state.update((True, None))
            state.setTimeoutDuration(lost_ms)
            yield pd.DataFrame({"path": [key[0]], "strength": [waiting], "ts": [pd.Timestamp(state.getCurrentProcessingTimeMs(), unit="ms")]})
            return
        started = []
        for x in pd.concat(list(batches)).sort_values("ts", kind="stable").itertuples(index=False):
            strength = None if pd.isna(x.strength) else int(x.strength)
            if strength is None:
                busy, now, waiting = waiting is not None, waiting, None
                if now is not None:
                    started.append((key[0], now, x.ts))
            elif busy:
                waiting = strength if waiting is None else max(waiting, strength)
            else:
                busy = True
                started.append((key[0], strength, x.ts))
        if busy:
            state.update((busy, waiting))
            state.setTimeoutDuration(lost_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(started, columns=["path", "strength", "ts"])

    return events.groupBy("path").applyInPandasWithState(run, "path string, strength int, ts timestamp", "busy boolean, waiting int", "append", "ProcessingTimeTimeout")


def stage(source: DataFrame, step: Callable[[DataFrame], DataFrame], table: str, checkpoint: str):
    """A writer of one stage of a chain: step's rows of a stream go to a table, which the next stage reads as a stream. Parquet's log makes each row once."""
    return step(source).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append")


def to_classify(converted: DataFrame) -> DataFrame:
    """Converted documents (profile_id, path, content_hash, classify) whose profile classifies: rows (profile_id, path, read_hash) to be judged."""
    return converted.where("classify").select("profile_id", "path", F.col("content_hash").alias("read_hash"))


def to_index(written: DataFrame) -> DataFrame:
    """Documents (profile_id, path) that were converted or classified: rows (profile_id, folder) of folders whose pages change, every ancestor once a document."""
    return written.select("profile_id", F.explode(P.ancestors(F.col("path"))).alias("folder"))


def bucketed_sink(base: str, step: Callable[[DataFrame, DataFrame], DataFrame], schema: StructType, key: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: as upsert_sink, but a batch writes only those parts of the table, by a hash of the key, that its keys are in.

    step gives the rows of the parts that a batch touches, of the old ones and the batch's; it may remove rows, all of a
    part too. Readers take `current`. For removals that late changes must not undo see `versioned.put_changes`.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        table = Versioned(batch.sparkSession, base, schema, key, BUCKETS)
        last, _ = table.held()
        if last is not None and last >= batch_id:
            return
        parts = table.touched(batch)
        table.write(batch_id, step(table.read(parts), batch), parts)

    return put


def current(spark: SparkSession, base: str, schema: StructType, parts: Sequence[int] | None = None) -> DataFrame:
    """The newest version of each part of a table that bucketed_sink wrote."""
    return Versioned(spark, base, schema, F.lit(0)).read(parts)


def index_sink(base: str, pages: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: puts a stream of document changes (see `increment.CHANGES`) into the folder index below base.

    The end of a chain of stages: a batch changes the folders above its documents alone. pages gets their new pages.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        index = FolderIndex(batch.sparkSession, base)
        if index.version() >= batch_id:
            return
        touched = index.apply(batch, batch_id)
        if pages is not None:
            pages(index.rendered(touched), batch_id)

    return put


def upsert_sink(base: str, step: Callable[[DataFrame, DataFrame], DataFrame], schema: StructType) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch writes the next version of a whole small table beside the last, named by the batch's number.

    A batch that is run again finds its version and does nothing, so results are exactly once. Readers take the highest version.
    A table that is large beside its batches is bucketed_sink's.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = latest(spark, base)
        if last is not None and last >= batch_id:
            return
        old = spark.createDataFrame([], schema) if last is None else spark.read.schema(schema).parquet(f"{base}/v={last}")
        step(old, batch).write.mode("overwrite").parquet(f"{base}/v={batch_id}")

    return put


def versions(spark: SparkSession, base: str) -> list[int]:
    """The versions that were written whole."""
    return [int(name[2:]) for name in folders(spark, base) if name.startswith("v=") and "_SUCCESS" in folders(spark, f"{base}/{name}")]


def latest(spark: SparkSession, base: str) -> int | None:
    """The highest version that was written whole."""
    return max(versions(spark, base), default=None)


def output_changes(files: DataFrame, roots: dict[str, str]) -> DataFrame:
    """Changes (profile_id, path, ts) of an output tree that call for a new index, from a stream of files (path, modified)."""
    kept = files.where(~P.excluded_from_changes(F.col("path")))
    return kept.select(nearest_root(files.sparkSession, F.col("path"), roots).alias("profile_id"), "path", F.col("modified").alias("ts")).where("profile_id is not null")


def current_results(results: DataFrame, current: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None]):
    """A writer of a stream of results (path, read_hash, ...) that drops those for an older version of their document."""

    def put(batch: DataFrame, batch_id: int) -> None:
        sink(compare_and_set(batch, current()).where("outcome = 'applied'").drop("outcome", "now_hash"), batch_id)

    return results.writeStream.foreachBatch(put)


def settled_results(results: DataFrame, documents: Callable[[DataFrame], DataFrame], profiles: Callable[[], DataFrame], applied: Callable[[DataFrame, int], None], late: Callable[[DataFrame, int], None] | None = None):
    """A writer of a stream of results that applies those of current versions of their document, rules and profile; see `classify.late_results`.

    documents(batch) gives the current documents of a batch's paths, such as the parts of a versioned table that they are
    in; profiles() the current profiles. Both are asked for in each batch, so a profile cancelled between two batches, or
    its rules changed, is known. late gets the others with their outcome.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        judged = late_results(batch, documents(batch), profiles())
        applied(judged.where("outcome = 'applied'").drop("outcome"), batch_id)
        if late is not None:
            late(judged.where("outcome <> 'applied'"), batch_id)

    return results.writeStream.foreachBatch(put)

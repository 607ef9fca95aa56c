"""Trees of files as a data source, and what changed between two listings as a stream.

`docpipe_listing` lists folders in parallel. The driver opens folders breadth-first until there are SPLITS of them or the
tree ends; each folder is a partition, which a task lists with all below it. All names are listed, those with a leading dot or
underscore too. Rows are of kind file, directory (with its number of entries, so that empty folders are seen), link (which is
not followed), or error: a folder that cannot be read, with the message; the others go on. A name that goes between listing
and asking for its size gives no row. Filters on ext (equal, or one of some) are taken by the source: other files are not asked for
their size. Roots are local or mounted folders, or URIs that Arrow can list.

`docpipe_changes` reads snapshots, written by `snapshot`, as a stream whose offsets are snapshot numbers. A batch is the
difference of two snapshots, part by part: rows new, changed and gone. Files below a folder that could not be read are carried
over from the snapshot before, so a failure never looks like deletions.
"""

from __future__ import annotations

import json
import os
import stat
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from docpipe.functions import paths as P
from docpipe.sources.tables import folders
from docpipe.sources.versioned import Versioned

SPLITS = 256
SCHEMA = "profile_id string, root string, path string, rel_path string, kind string, ext string, size long, modified_ms long, entries long, error string"
SNAPSHOT = "profile_id string, path string, rel_path string, kind string, size long, modified_ms long"
CHANGES = "profile_id string, path string, rel_path string, change string, size long, modified_ms long, snapshot long"
#: Parts of a snapshot: what a task compares at once is a part of it.
SNAPSHOT_PARTS = 64


@dataclass
class Folder(InputPartition):
    """A folder to be listed; deep: with all below it."""

    profile: str
    root: str
    rel: str
    deep: bool


def extension(name: str) -> str | None:
    """The lower-cased extension, None if there is none; a leading dot does not start one."""
    at = name.rfind(".")
    return name[at + 1 :].lower() if 0 < at < len(name) - 1 else None


def entries(root: str, rel: str) -> Iterator[tuple[str, str, int | None, int | None]]:
    """(name, kind, size, modified_ms) of a folder; size and time are asked for by `details`."""
    if "://" in root and not root.startswith("file:"):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for x in store.get_file_info(fs.FileSelector(f"{base}/{rel}".rstrip("/"))):
            yield x.base_name, "directory" if x.type == fs.FileType.Directory else "file", x.size, None if x.mtime_ns is None else x.mtime_ns // 1_000_000
        return
    with os.scandir(os.path.join(local(root), rel)) as found:
        for x in found:
            yield x.name, "link" if x.is_symlink() else "directory" if x.is_dir(follow_symlinks=False) else "file", None, None


def local(root: str) -> str:
    return unquote(urlparse(root).path) if root.startswith("file:") else root


def details(root: str, rel: str) -> tuple[int, int] | None:
    """(size, modified_ms) of a regular file; None where it has gone meanwhile, or is no regular file."""
    try:
        x = os.stat(os.path.join(local(root), rel), follow_symlinks=False)
    except FileNotFoundError:
        return None
    return (x.st_size, x.st_mtime_ns // 1_000_000) if stat.S_ISREG(x.st_mode) else None


class Listing(DataSource):
    """Options: roots, a JSON list of [profile, folder]; splits."""

    @classmethod
    def name(cls) -> str:
        return "docpipe_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ListingReader:
        return ListingReader(json.loads(self.options["roots"]), int(self.options.get("splits", SPLITS)))


class ListingReader(DataSourceReader):
    def __init__(self, roots: list[tuple[str, str]], splits: int):
        self.roots, self.splits, self.wanted = roots, splits, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for x in filters:
            own = {x.value} if isinstance(x, EqualTo) and x.attribute == ("ext",) else set(x.value) if isinstance(x, In) and x.attribute == ("ext",) else None
            if own is None:
                yield x
            else:
                self.wanted = own if self.wanted is None else self.wanted & own

    def partitions(self) -> Sequence[Folder]:
        opened, waiting = [], [Folder(profile, root, "", True) for profile, root in self.roots]
        while waiting and len(opened) + len(waiting) < self.splits:
            x = waiting.pop(0)
            try:
                below = [name for name, kind, *_ in entries(x.root, x.rel) if kind == "directory"]
            except Exception:  # its task reports it
                below = []
            opened.append(Folder(x.profile, x.root, x.rel, False))
            waiting += [Folder(x.profile, x.root, f"{x.rel}/{name}".lstrip("/"), True) for name in below]
        return opened + waiting

    def read(self, partition: Folder) -> Iterator[tuple]:
        p, left = partition, [partition.rel]
        base = p.root.rstrip("/")
        while left:
            rel = left.pop()
            row = lambda kind, name=rel, ext=None, size=None, ms=None, n=None, error=None: (p.profile, p.root, f"{base}/{name}".rstrip("/"), name, kind, ext, size, ms, n, error)
            n = 0
            try:
                for name, kind, size, ms in entries(p.root, rel):
                    n, at = n + 1, f"{rel}/{name}".lstrip("/")
                    ext = extension(name)
                    if kind == "directory":
                        if p.deep:
                            left.append(at)
                        continue
                    if self.wanted is not None and ext not in self.wanted:
                        continue
                    if kind == "file" and size is None:
                        if (x := details(p.root, at)) is None:
                            continue
                        size, ms = x
                    yield row(kind, at, ext, size, ms)
            except FileNotFoundError as e:
                if rel == "":  # a root that is not there; a folder that has gone meanwhile is no error
                    yield row("error", error=str(e)[:500])
                continue
            except Exception as e:
                yield row("error", error=str(e)[:500])
                continue
            if self.wanted is None:
                yield row("directory", n=n)


def listed(spark: SparkSession, roots: Sequence[tuple[str, str]], splits: int = SPLITS) -> DataFrame:
    """All that is below roots (profile, folder), by SCHEMA."""
    spark.dataSource.register(Listing)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("docpipe_listing").option("roots", json.dumps([list(x) for x in roots])).option("splits", splits).load()


def empty_folders(rows: DataFrame) -> DataFrame:
    """Rows (profile_id, rel_path) of listed folders without an entry."""
    return rows.where("kind = 'directory' and entries = 0 and rel_path <> ''").select("profile_id", "rel_path")


def snapshot(spark: SparkSession, base: str, rows: DataFrame) -> int:
    """Writes listed rows as the next snapshot; its number. What is below a folder that could not be read stays as it was."""
    table = Versioned(spark, base, StructType.fromDDL(SNAPSHOT), F.pmod(F.xxhash64("profile_id", "rel_path"), F.lit(SNAPSHOT_PARTS)).cast("int"))
    last, _ = table.held()
    names = [x.name for x in table.schema.fields]
    here = rows.where("kind in ('file', 'link')").select(names)
    if last is not None:
        failed = rows.where("kind = 'error'").select("profile_id", F.col("rel_path").alias("folder")).distinct()
        above = table.read().withColumn("folder", F.explode(P.ancestors(F.col("rel_path"))))
        kept = above.join(failed, ["profile_id", "folder"], "left_semi").select(names).distinct()
        # A profile that is no longer listed at all is carried too: it takes a listing to tell that files are gone.
        absent = table.read().join(rows.select("profile_id").distinct(), "profile_id", "left_anti").select(names)
        here = here.unionByName(kept.join(here.select("profile_id", "rel_path"), ["profile_id", "rel_path"], "left_anti")).unionByName(absent)
    number = 0 if last is None else last + 1
    table.write(number, here, range(SNAPSHOT_PARTS))
    return number


@dataclass
class Part(InputPartition):
    """A part of two snapshots; the files of each."""

    start: int
    end: int
    before: str | None
    after: str | None


class Changes(DataSource):
    """Options: path, the folder of snapshots, local or mounted, or a URI that Arrow can read; most, snapshots of a batch."""

    @classmethod
    def name(cls) -> str:
        return "docpipe_changes"

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema: StructType) -> ChangesReader:
        return ChangesReader(self.options["path"], int(self.options.get("most", 0)))


class ChangesReader(DataSourceStreamReader):
    """Its offset is the number of the last snapshot read; -1 before the first."""

    def __init__(self, path: str, most: int):
        self.path, self.most, self.at = path, most, None

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def _numbers(self) -> list[int]:
        from pyarrow import fs

        store, base = self._store()
        found = store.get_file_info(fs.FileSelector(f"{base}/manifests", allow_not_found=True))
        return sorted(int(x.base_name[:-5]) for x in found if x.base_name.endswith(".json") and not x.base_name.startswith("."))

    def _held(self, number: int) -> dict[str, int]:
        if number < 0:
            return {}
        store, base = self._store()
        with store.open_input_stream(f"{base}/manifests/{number:012d}.json") as f:
            return json.loads(f.readall())

    def initialOffset(self) -> dict:
        return {"snapshot": -1}

    def latestOffset(self) -> dict:
        known = self._numbers()
        if self.most and self.at is not None:
            known = [n for n in known if n <= self.at + self.most]
        return {"snapshot": max([-1 if self.at is None else self.at, *known])}

    def partitions(self, start: dict, end: dict) -> Sequence[Part]:
        a, b = start["snapshot"], end["snapshot"]
        self.at = b
        before, after = self._held(a), self._held(b)
        place = lambda held, p: f"v={held[p]}/part={p}" if p in held else None
        return [Part(a, b, place(before, p), place(after, p)) for p in sorted(before.keys() | after.keys(), key=int) if place(before, p) != place(after, p)]

    def _rows(self, place: str | None) -> dict[tuple, tuple]:
        if place is None:
            return {}
        import pyarrow.parquet as pq

        store, base = self._store()
        x = pq.read_table(f"{base}/{place}", filesystem=store, partitioning=None).to_pydict()
        return {(a, r): (p, k, s, m) for a, p, r, k, s, m in zip(*(x[c] for c in ("profile_id", "path", "rel_path", "kind", "size", "modified_ms")), strict=True)}

    def read(self, partition: Part) -> Iterator[tuple]:
        old, new = self._rows(partition.before), self._rows(partition.after)
        for key in sorted(old.keys() | new.keys()):
            was, now = old.get(key), new.get(key)
            if was != now:
                path, _, size, ms = now or was
                yield (key[0], path, key[1], "gone" if now is None else "new" if was is None else "changed", size, ms, partition.end)

    def commit(self, end: dict) -> None:
        pass


def changes(spark: SparkSession, path: str, most: int = 0) -> DataFrame:
    """A stream of CHANGES between the snapshots in a folder. most: snapshots that a batch goes on by at most, 0 for any number."""
    spark.dataSource.register(Changes)
    return spark.readStream.format("docpipe_changes").option("path", path).option("most", most).load()


def last_listing(spark: SparkSession, base: str) -> DataFrame:
    """The rows of the newest snapshot, none if there is none."""
    table = Versioned(spark, base, StructType.fromDDL(SNAPSHOT), F.lit(0))
    return table.read() if folders(spark, base) else spark.createDataFrame([], SNAPSHOT)

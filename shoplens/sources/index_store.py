"""Vector index tables: Parquet files by key hash and a table of published versions.

Records lie in parts by a hash of their key, one folder per part. A writer fills
folders for the parts it changes and then appends one row to `published`, which
names the folders of all parts. Readers take the newest published row, so they
never see a half-written index, and a failed write leaves only folders that no
version names. Parts without a change keep their files.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from shoplens import fixed
from shoplens.operators.dedup import dedup
from shoplens.operators.numbering import marked, marks
from shoplens.session import materialize

_ROW = ("version long, folders array<string>, parts int, dimensions int, metric string, "
        "mode string, added long, skipped long")
RECORD = "key string, vector array<float>, metadata map<string,string>"
STALE_SECONDS = 86_400      # a write that has not ended by then is taken for dead


class WriteConflict(RuntimeError):
    """Another writer is at work on the same index."""


class Index:
    """One named index under a root folder.

    `parts`: into how many parts a replace deals the keys; by default the
    number of shuffle partitions, which is set to suit the size of the data.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, parts: int | None = None):
        self.spark = spark
        self.base = f"{root.rstrip('/')}/{name}"
        self.name = name
        self.parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _path(self, below: str):
        """A Hadoop path and the file system it lies in."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{below}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        path, store = self._path("published")
        return store.exists(path)

    def versions(self) -> DataFrame:
        return self.spark.read.schema(_ROW).parquet(f"{self.base}/published")

    def current(self) -> Row | None:
        """The newest published row, or None. One row, so it may be fetched."""
        if not self.exists():
            return None
        return self.versions().orderBy(F.desc("version")).first()

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], RECORD)
        return self.spark.read.schema(RECORD).parquet(*[f"{self.base}/{f}" for f in folders])

    def scan(self) -> DataFrame:
        """All records. Unused columns, the vector above all, are not read."""
        row = self.current()
        if row is None:
            raise ValueError(f"index {self.name} has no published version")
        return self._read(row.folders)

    def get(self, key: str) -> DataFrame:
        """Records of one key: one part is read, and the filter reaches its row groups."""
        row = self.current()
        if row is None:
            raise ValueError(f"index {self.name} has no published version")
        part = self.spark.range(1).select(_part(F.lit(key), row.parts)).first()[0]
        return self._read(_of_parts(row.folders, {part})).filter(F.col("key") == key)

    def get_many(self, keys: DataFrame) -> DataFrame:
        return self.scan().join(keys.select("key").distinct(), "key", "left_semi")

    def _store(self, vectors: DataFrame, parts: int) -> list[str]:
        """Write records to a folder per part; returns the folders."""
        folder = f"data-{uuid.uuid4().hex}"
        rows = vectors.select(F.col("key").cast("string").alias("key"), F.col("vector").cast("array<float>").alias("vector"),
                              "metadata", _part(F.col("key"), parts).alias("part"))
        # Sorted by key inside each file, so key lookups skip row groups.
        (rows.repartitionById(parts, "part").sortWithinPartitions("part", "key")
             .write.partitionBy("part").option("parquet.bloom.filter.enabled#key", "true")
             .parquet(f"{self.base}/{folder}"))
        path, store = self._path(folder)
        names = [f.getPath().getName() for f in store.listStatus(path) if f.isDirectory()]
        return sorted(f"{folder}/{n}" for n in names if n.startswith("part="))

    @contextmanager
    def _writing(self) -> Iterator[tuple[int, Row | None]]:
        """The number of the version to write and the newest one before it.

        The number is claimed by creating a file, which only one writer can do.
        """
        last = self.current()
        version = (last.version if last else 0) + 1
        while True:
            path, store = self._path(f"claims/{version}")
            if store.createNewFile(path):
                break
            if time.time() - store.getFileStatus(path).getModificationTime() / 1000 < STALE_SECONDS:
                raise WriteConflict(f"version {version} of index {self.name} is being written")
            version += 1
        try:
            if (now := self.current()) and now.version >= version:
                raise WriteConflict(f"index {self.name} has a newer version")
            yield version, last
        except BaseException:
            store.delete(path, False)
            raise

    def _publish(self, version: int, folders: list[str], parts: int, mode: str, dimensions: int | None,
                 added: int, skipped: int = 0) -> None:
        row = [(version, folders, parts, dimensions, fixed.DISTANCE_METRIC, mode, added, skipped)]
        self.spark.createDataFrame(row, _ROW).coalesce(1).write.mode("append").parquet(f"{self.base}/published")

    def replace(self, vectors: DataFrame, dimensions: int | None = None) -> None:
        """New content only; the last record of a key wins."""
        with self._writing() as (version, last):
            folders = self._store(keep_last(vectors), self.parts)
            self._publish(version, folders, self.parts, "replace", dimensions or (last and last.dimensions),
                          self._read(folders).count())

    def upsert(self, vectors: DataFrame, dimensions: int | None = None) -> None:
        """New keys inserted, existing ones replaced, the others kept; only parts with such keys are written."""
        self._change(keep_last(vectors), None, "upsert", dimensions)

    def change(self, fresh: DataFrame, gone: DataFrame) -> None:
        """Records with unique keys inserted or replaced, and the keys of `gone` removed."""
        self._change(fresh, gone, "changes", None)

    def _change(self, fresh: DataFrame, gone: DataFrame | None, mode: str, dimensions: int | None) -> None:
        with self._writing() as (version, last):
            parts = last.parts if last else self.parts
            folders = list(last.folders) if last else []
            given = materialize(fresh.select("key", "vector", "metadata"), mode)
            keys = given.select("key")
            if gone is not None:
                keys = materialize(keys.union(gone.select("key")), "changed-keys")
            touched = {r[0] for r in keys.select(_part(F.col("key"), parts)).distinct().collect()}  # at most `parts`
            if touched or not last:
                old = self._read(_of_parts(folders, touched))
                written = self._store(without_keys(old, keys).union(given), parts)
                folders = [f for f in folders if f not in set(_of_parts(folders, touched))] + written
            self._publish(version, folders, parts, mode, dimensions or (last and last.dimensions), given.count())

    def append_new(self, vectors: DataFrame, dimensions: int | None = None) -> None:
        """Only unseen keys are inserted; the published row counts the skipped ones.

        Stored folders stay as they are: the keys of the index are the only
        column read, and only the new records are written.
        """
        with self._writing() as (version, last):
            parts = last.parts if last else self.parts
            given = materialize(keep_last(vectors), "append")
            folders = list(last.folders) if last else []
            new = self._store(unseen(given, self._read(folders)), parts)
            added = self._read(new).count()
            self._publish(version, [*folders, *new], parts, "append", dimensions or (last and last.dimensions),
                          added, given.count() - added)

    def remove_unnamed(self, keep: int = 2) -> int:
        """Delete folders that none of the newest `keep` versions names; not while a write is under way."""
        with self._writing() as (version, _):
            used = {f for r in self.versions().orderBy(F.desc("version")).limit(keep).collect() for f in r.folders}
            root, store = self._path("")
            removed = 0
            for data in store.listStatus(root):
                if data.getPath().getName().startswith("data-"):
                    for part in store.listStatus(data.getPath()):
                        name = f"{data.getPath().getName()}/{part.getPath().getName()}"
                        if part.isDirectory() and name not in used:
                            removed += store.delete(part.getPath(), True)
            path, store = self._path(f"claims/{version}")
            store.delete(path, False)
        return removed

    def write(self, vectors: DataFrame, mode: str, dimensions: int | None = None) -> None:
        modes = {"replace": self.replace, "upsert": self.upsert, "append": self.append_new}
        modes[mode](vectors, dimensions)

    def stats(self) -> DataFrame:
        """One row: state, dimensions, metric, rows, shortest and longest vector."""
        row = self.current()
        if row is None:
            return self.spark.createDataFrame(
                [(False, True, None, None, 0, None, None)],
                "index_exists boolean, is_empty boolean, dimensions int, metric string, "
                "n_rows long, min_dim int, max_dim int")
        return index_stats(self.scan()).select(
            F.lit(True).alias("index_exists"), (F.col("n_rows") == 0).alias("is_empty"),
            F.lit(row.dimensions).alias("dimensions"), F.lit(row.metric).alias("metric"),
            "n_rows", "min_dim", "max_dim")


def keep_last(vectors: DataFrame, order: str | None = None) -> DataFrame:
    """One record per key: the greatest `order` value, ties settled by content."""
    return dedup(vectors.select("key", "vector", "metadata", *([order] if order else [])),
                 ["key"], [F.col(order).desc()] if order else [],
                 tie=F.xxhash64("vector", F.to_json("metadata"))
                 ).select("key", "vector", "metadata")


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(parts)).cast("int")


def _of_parts(folders: list[str], parts: set[int]) -> list[str]:
    return [f for f in folders if int(f.rsplit("=", 1)[1]) in parts]


def without_keys(old: DataFrame, keys: DataFrame) -> DataFrame:
    """Records whose key is not among `keys`.

    A bitmap of the keys lets most records pass without a join, so that only
    those that may be replaced are moved with their vectors.
    """
    old = old.select("key", "vector", "metadata")
    maybe = marked(F.col("key"), marks(keys))
    return old.filter(~maybe).union(old.filter(maybe).join(keys.select("key"), "key", "left_anti"))


def upsert_union(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old records whose key is not replaced, and all new ones."""
    return without_keys(old, new).union(new.select("key", "vector", "metadata"))


def unseen(new: DataFrame, index: DataFrame) -> DataFrame:
    """New records whose key the index does not hold."""
    return new.join(index.select("key"), "key", "left_anti")


def index_stats(vectors: DataFrame) -> DataFrame:
    return vectors.agg(F.count("*").alias("n_rows"),
                       F.min(F.size("vector")).alias("min_dim"),
                       F.max(F.size("vector")).alias("max_dim"))


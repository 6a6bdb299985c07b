"""The stored star schema: append-only parquet segments under one pointer.

A load writes only its new rows, each table into its own new folder, and then
switches one small manifest file that names the folders of all tables. Readers
see either the whole load or nothing of it; a load that is run again writes
the same folders again. Nothing stored is rewritten by a load, so its cost
follows the batch and not the tables. Tables with a key are laid out by its hash
(``key_layout``): ``matching`` opens only the files that can hold a key of a batch.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

from newsgraph.schemas import ID_COLUMN, KEY_COLUMNS, STAR_TABLES
from newsgraph.sinks import key_layout
from newsgraph.staging import hadoop_fs

_EMPTY = {"version": 0, "segments": {}, "highest": {}, "sources": {}}


def _version_folder(table: str, version: int) -> str:
    return f"{table}/seg-{version:012d}"


def mapped(df: DataFrame, schema: StructType, mapping: Sequence[str] | None = None) -> DataFrame:
    """Only the mapped columns, by name, in the layout of the target.

    Target columns outside the mapping become null.
    """
    names = set(mapping if mapping is not None else df.columns)
    return df.select(
        *(
            (F.col(f.name) if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        )
    )


class StarStore:
    """Stored tables below ``root`` (any Hadoop file system); one writer at a time."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, StructType] | None = None,
                 keys: dict[str, Sequence[str]] | None = None, range_rows: int = key_layout.RANGE_ROWS):
        self.spark, self.root = spark, root.rstrip("/")
        self.tables = dict(STAR_TABLES if tables is None else tables)
        self.keys = {t: k for t, k in (KEY_COLUMNS if keys is None else keys).items() if t in self.tables}
        self.range_rows = range_rows

    # -- pointer ---------------------------------------------------------
    def _commit_path(self, version: int) -> str:
        return f"{self.root}/_commits/{version:012d}.json"

    def _commit_names(self) -> list[str]:
        """Names of the committed manifests, oldest first."""
        fs, folder = hadoop_fs(self.spark, f"{self.root}/_commits")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(name for name in names if name.endswith(".json"))

    def manifest(self) -> dict:
        """The newest committed manifest."""
        names = self._commit_names()
        return self._load(names[-1]) if names else json.loads(json.dumps(_EMPTY))

    def _load(self, name: str) -> dict:
        fs, path = hadoop_fs(self.spark, f"{self.root}/_commits/{name}")
        stream = fs.open(path)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _switch(self, manifest: dict) -> None:
        fs, final = hadoop_fs(self.spark, self._commit_path(manifest["version"]))
        _, draft = hadoop_fs(self.spark, f"{self._commit_path(manifest['version'])}.draft")
        out = fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(manifest).encode("utf-8")))
        finally:
            out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError(f"version {manifest['version']} was committed by another writer")

    # -- reading ---------------------------------------------------------
    def read(self, table: str, manifest: dict | None = None) -> DataFrame:
        segments = (manifest or self.manifest())["segments"].get(table, [])
        return self._folders(table, [s["path"] for s in segments])

    def _folders(self, table: str, paths: Sequence[str], hashes: Sequence[int] | None = None) -> DataFrame:
        """Rows in these folders, with one of the hashes if any are given."""
        schema = self.tables[table]
        if not paths:
            return self.spark.range(1).where("false").select(
                *(F.lit(None).cast(f.dataType).alias(f.name) for f in schema)
            )
        reader = self.spark.read.option("recursiveFileLookup", "true")
        full = [f"{self.root}/{p}" for p in paths]
        if hashes is None:
            return reader.schema(schema).parquet(*full)
        found = reader.schema(key_layout.hashed_schema(schema)).parquet(*full)
        return found.where(F.col(key_layout.HASH).isin(list(hashes))).select(*schema.names)

    def matching(self, table: str, batch: DataFrame, keys: Sequence[Column | str],
                 manifest: dict | None = None) -> DataFrame:
        """Stored rows of a superset of the keys of ``batch``, from the files that
        can hold them; the whole table for a batch of very many keys.

        ``keys`` of the batch are in the form and order of the table's key. Rows
        of other keys may come back, so lookups still compare keys.
        """
        segments = (manifest or self.manifest())["segments"].get(table, [])
        if not segments:
            return self._folders(table, [])
        hashes = key_layout.batch_hashes(batch, keys)
        if hashes is None:
            return self.read(table, manifest)
        plain = [s["path"] for s in segments if "ranges" not in s]
        ranged = [f for s in segments if "ranges" in s for f in key_layout.matching_folders(s, hashes)]
        found = self._folders(table, ranged, hashes)
        return found.unionByName(self._folders(table, plain)) if plain else found

    def rows_of_version(self, table: str, version: int, manifest: dict) -> DataFrame:
        """The rows that one load has written to a table, before any compaction."""
        begin = _version_folder(table, version)
        return self._folders(table, [s["path"] for s in manifest["segments"].get(table, []) if s["path"].startswith(begin)])

    # -- writing ---------------------------------------------------------
    def begin(self) -> "Load":
        return Load(self, self.manifest())

    def compact(self, table: str, small_rows: int = 1_000_000) -> int:
        """Merge all segments below ``small_rows`` into one; returns how many."""
        manifest = self.manifest()
        segments = manifest["segments"].get(table, [])
        small = [s for s in segments if s["rows"] < small_rows]
        if len(small) < 2:
            return 0
        load = Load(self, manifest)
        rows = sum(s["rows"] for s in small)
        load.at_most = rows
        merged = self._folders(table, [s["path"] for s in small])
        manifest["segments"][table] = [s for s in segments if s not in small]
        load.add(table, merged if table in self.keys else merged.repartition(max(1, rows // small_rows)))
        load.commit()
        return len(small)

    def tidy(self, segments: int = 100, keep: int = 10) -> None:
        """Bound the number of folders: compact tables with more than
        ``segments`` segments and drop what the last ``keep`` versions do not name."""
        for table in self.tables:
            if len(self.manifest()["segments"].get(table, [])) > segments:
                self.compact(table)
                self.vacuum(keep)

    def vacuum(self, keep: int = 10) -> list[str]:
        """Drop older manifests and the folders that only they name."""
        names = self._commit_names()
        used = {
            segment["path"]
            for name in names[-keep:]
            for segments in self._load(name)["segments"].values()
            for segment in segments
        }
        dropped = []
        for name in names[:-keep]:
            for segments in self._load(name)["segments"].values():
                dropped += [s["path"] for s in segments if s["path"] not in used]
            fs, path = hadoop_fs(self.spark, f"{self.root}/_commits/{name}")
            fs.delete(path, False)
        for path in sorted(set(dropped)):
            fs, target = hadoop_fs(self.spark, f"{self.root}/{path}")
            fs.delete(target, True)
        return sorted(set(dropped))


class Load:
    """One load: segments of any number of tables, switched on together."""

    def __init__(self, store: StarStore, manifest: dict):
        self.store, self.manifest = store, manifest
        self.version = manifest["version"] + 1
        self.before = dict(manifest["highest"])  # highest ids when the load began
        self.rows: dict[str, int] = {}
        self.at_most: int | None = None  # no table gets more rows than this, if it is known
        self._adds: dict[str, int] = {}

    def stored(self, table: str) -> DataFrame:
        """Committed rows and those this load has written so far."""
        return self.store.read(table, self.manifest)

    def matching(self, table: str, batch: DataFrame, keys: Sequence[Column | str]) -> DataFrame:
        """``stored`` cut down to the files that can hold the keys of a batch."""
        return self.store.matching(table, batch, keys, self.manifest)

    def highest(self, table: str) -> int:
        return self.manifest["highest"].get(table, 0)

    def done_before(self, source: str, batch: int | None) -> bool:
        return batch is not None and self.manifest["sources"].get(source, -1) >= batch

    def add(self, table: str, df: DataFrame, mapping: Sequence[str] | None = None) -> int:
        """Write new rows of one table, each call to a folder of its own, and
        return how many there were."""
        schema = self.store.tables[table]
        id_column = ID_COLUMN.get(table)
        self._adds[table] = self._adds.get(table, 0) + 1
        path = self._folder(table) + (f"-{self._adds[table]}" if self._adds[table] > 1 else "")
        copied = Observation()
        rows = mapped(df, schema, mapping).observe(
            copied, F.count(F.lit(1)).alias("rows"), F.max(id_column or F.lit(0)).alias("highest")
        )
        segment = {"path": path}
        target = f"{self.store.root}/{path}"
        if table in self.store.keys:
            most = df.count() if self.at_most is None else self.at_most
            segment["bits"] = key_layout.range_bits(most, self.store.range_rows)
            hashed = key_layout.key_hash(*(F.expr(k) for k in self.store.keys[table]))
            key_layout.write_ranges(rows, hashed, target, most, segment["bits"])
            segment["ranges"] = self._written_ranges(target)
        else:
            rows.write.mode("overwrite").parquet(target)
        seen = copied.get
        self.rows[table] = self.rows.get(table, 0) + seen["rows"]
        if seen["rows"]:
            self._segments(table).append(segment | {"rows": seen["rows"]})
            if id_column:
                self.manifest["highest"][table] = max(self.highest(table), seen["highest"])
        return seen["rows"]

    def _written_ranges(self, target: str) -> list[int]:
        fs, folder = hadoop_fs(self.store.spark, target)
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{key_layout.RANGE}="))

    def _folder(self, table: str) -> str:
        """The first folder of this load's rows of a table; further ones have a number more."""
        return _version_folder(table, self.version)

    def _segments(self, table: str) -> list:
        return self.manifest["segments"].setdefault(table, [])

    def added(self, table: str) -> DataFrame:
        """The rows this load has written so far to one table."""
        return self.store.rows_of_version(table, self.version, self.manifest)

    def commit(self, source: str | None = None, batch: int | None = None) -> int:
        self.manifest["version"] = self.version
        if source is not None and batch is not None:
            self.manifest["sources"][source] = batch
        self.store._switch(self.manifest)
        return self.version

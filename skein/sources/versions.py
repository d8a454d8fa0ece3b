"""Versioned tables of Parquet folders: deltas, tombstones and manifests.

A write puts its rows into a folder of its own, with a name that nobody else
takes, and then creates the manifest of the next version, which lists the
folders that make up the table. Creating a manifest is exclusive: of two
writers that started from one version the second fails and leaves nothing that
readers see. Rows carry ``seq``, the version that wrote them, and ``gone``; the
last row of a key counts. The manifest says how many of the first folders hold
every key once: those rows are never grouped, later ones only push them out.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.errors import DatabaseError

#: Folders after which a write also compacts.
MOST_FOLDERS = 16


class VersionedTable:
    """Rows of `schema` with unique `keys`; `partition` names a column whose values get folders of their own."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: tuple[str, ...] = ("id",), partition: str | None = None):
        self.spark, self.path, self.schema, self.keys, self.partition = spark, path.rstrip("/"), schema, keys, partition
        self.columns = [f.split()[0] for f in _fields(schema)]

    # Files

    def _fs(self):
        jvm = self.spark._jvm
        make = jvm.org.apache.hadoop.fs.Path
        return make(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration()), make

    def versions(self) -> list[int]:
        fs, make = self._fs()
        if not fs.exists(make(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(make(self.path))]
        return sorted(int(n[9:]) for n in names if n.startswith("manifest-") and n[9:].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known:
            return {"folders": [], "unique": 0, "extra": {}}
        fs, make = self._fs()
        stream = fs.open(make(f"{self.path}/manifest-{known[-1] if version is None else version}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _write(self, rows: DataFrame, seq: int) -> str:
        folder = f"data-{uuid.uuid4().hex}"
        out = rows.withColumn("seq", F.lit(seq).cast("bigint"))
        # Rows of a cell come together, and a hot cell is spread over tasks again.
        writer = (out.hint("rebalance", self.partition) if self.partition else out).write
        (writer.partitionBy(self.partition) if self.partition else writer).parquet(f"{self.path}/{folder}")
        return folder

    def _publish(self, version: int, folders: list[str], unique: int, extra: dict) -> None:
        fs, make = self._fs()
        try:
            stream = fs.create(make(f"{self.path}/manifest-{version}"), False)
        except Exception as e:
            raise DatabaseError(f"version {version} of {self.path} was written by another writer") from e
        stream.write(bytearray(json.dumps({"folders": folders, "unique": unique, "extra": extra}).encode()))
        stream.close()

    # Reads

    def _folders(self, folders: list[str], where=None) -> DataFrame:
        """All rows of folders as written, with ``seq`` and ``gone``."""
        schema = f"{self.schema}, seq bigint, gone boolean"
        if not folders:
            return self.spark.createDataFrame([], schema)
        rows = _union([self.spark.read.schema(schema).parquet(f"{self.path}/{f}") for f in folders])
        return rows if where is None else rows.filter(where)

    def rows(self, version: int | None = None) -> DataFrame:
        return self._folders(self.manifest(version)["folders"])

    def read(self, version: int | None = None, where=None) -> DataFrame:
        """The last row of each key that is not gone. `where` may only look at keys and the partition column."""
        m = self.manifest(version)
        first = self._folders(m["folders"][: m["unique"]], where).select(*self.columns)
        if len(m["folders"]) == m["unique"]:
            return first
        rest = [c for c in self.columns if c not in self.keys]
        late = self._folders(m["folders"][m["unique"] :], where).groupBy(*self.keys).agg(F.max_by(F.struct(*rest, "gone"), "seq").alias("r"))
        late_rows = late.filter("NOT r.gone").select(*[c if c in self.keys else F.col(f"r.{c}").alias(c) for c in self.columns])
        return first.join(late.select(*self.keys), list(self.keys), "left_anti").unionByName(late_rows)

    # Writes

    def append(self, rows: DataFrame, gone: DataFrame | None = None, new: bool = False, extra: dict | None = None) -> None:
        """Add rows, and tombstones for the keys in `gone`. With `new` no key of `rows` is in the table."""
        known = self.versions()
        version, m = (known[-1] if known else 0) + 1, self.manifest()
        out = rows.select(*self.columns).withColumn("gone", F.lit(False))
        if gone is not None:
            kinds = dict(f.split(None, 1) for f in _fields(self.schema))
            out = out.unionByName(gone.select(*[F.col(c) if c in self.keys else F.lit(None).cast(kinds[c]).alias(c) for c in self.columns], F.lit(True).alias("gone")))
        folders = [*m["folders"], self._write(out, version)]
        whole = m["unique"] == len(m["folders"]) and new and gone is None
        self._publish(version, folders, len(folders) if whole else m["unique"], m["extra"] | (extra or {}))
        if len(folders) > MOST_FOLDERS:
            self.compact()

    def replace(self, rows: DataFrame, extra: dict | None = None) -> None:
        """Make `rows`, which have unique keys, all there is."""
        version = (self.versions() or [0])[-1] + 1
        self._publish(version, [self._write(rows.select(*self.columns).withColumn("gone", F.lit(False)), version)], 1, self.manifest()["extra"] | (extra or {}))

    def compact(self) -> None:
        self.replace(self.read())

    def vacuum(self, keep: int = 2) -> None:
        """Delete all but the last `keep` versions, and folders that none of those uses."""
        fs, make = self._fs()
        known = self.versions()
        used = {f for v in known[-keep:] for f in self.manifest(v)["folders"]}
        for v in known[:-keep]:
            fs.delete(make(f"{self.path}/manifest-{v}"), False)
        for s in fs.listStatus(make(self.path)) if known else []:
            name = s.getPath().getName()
            if name.startswith("data-") and name not in used:
                fs.delete(s.getPath(), True)


def _fields(schema: str) -> list[str]:
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [f.strip() for f in out]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

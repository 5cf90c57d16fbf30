"""Tables of a store that change together: snapshots under a manifest that is committed last.

A table lies in folders by resource, `<store>/<table>/version=<v>/resource_id=<r>`, or is whole, in one folder or a few
batches, `<store>/<table>/version=<v>`.
A manifest names the folders of every table and the fingerprint that each was made from. Writers put new folders beside the
old ones and then write the next manifest, whose last line is a digest of the rest, so a crash at any moment leaves the
snapshot before it whole; what a crashed writer has left is named by no manifest. A snapshot that was read stays readable
until vacuum() removes what only older manifests name. Two writers can't commit the same number.

Resources whose fingerprint is unchanged keep their folders: an update writes what is stale alone. Reading a table gives one
relation with resource_id as its partition column, so filters on it, also those that only arise at run time, skip folders.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, field, replace
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: The folder that Spark gives to rows without a resource.
_NULL = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Table:
    """schema; whether it is whole; by resource (None: rows without one; of a whole table: by batch, None if it has but one) its folder, or None where it has no rows, and its fingerprint."""

    schema: StructType
    whole: bool
    parts: dict[str | None, tuple[str | None, str]]


@dataclass(frozen=True)
class Snapshot:
    path: str
    version: int = 0
    tables: dict[str, Table] = field(default_factory=dict)

    def fingerprints(self, name: str) -> dict[str | None, str]:
        table = self.tables.get(name)
        return {k: mark for k, (_, mark) in table.parts.items()} if table else {}

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        """A table as this snapshot has it, whatever is committed later."""
        table = self.tables[name]
        folders = sorted(folder for folder, _ in table.parts.values() if folder)
        if not folders:
            return spark.createDataFrame([], table.schema)
        base = f"{self.path}/{name}"
        if table.whole:
            return spark.read.schema(table.schema).parquet(*(f"{base}/{f}" for f in folders))
        own = StructType([f for f in table.schema if f.name != "resource_id"] + [StructField("version", StringType()), StructField("resource_id", StringType())])
        return spark.read.schema(own).option("basePath", base).parquet(*(f"{base}/{f}" for f in folders)).select(*table.schema.names)


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, target = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Path, length and time of a file, or of those in a folder."""
    fs, target = _fs(spark, path)
    found = fs.listStatus(target) if fs.exists(target) else []
    return sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in found)


def _manifest(version: int) -> str:
    return f"{version:012d}.json"


def _parse(path: str, text: str) -> Snapshot | None:
    body, _, digest = text.rstrip("\n").rpartition("\n")
    if hashlib.md5(body.encode()).hexdigest() != digest:
        return None  # its writer was stopped
    found = json.loads(body)
    tables = {name: Table(StructType.fromJson(t["schema"]), t["whole"], {r: (folder, mark) for r, folder, mark in t["parts"]}) for name, t in found["tables"].items()}
    return Snapshot(path, found["version"], tables)


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> Snapshot:
    """The newest complete snapshot of a store, or the one of a version; a store that isn't there is an empty one."""
    names = [n for n in _names(spark, f"{path}/_manifests") if version is None or n == _manifest(version)]
    for name in reversed(names):
        text = spark.read.text(f"{path}/_manifests/{name}", wholetext=True).first()
        found = _parse(path, text[0]) if text else None
        if found:
            return found
    if version is not None:
        raise ValueError(f"{path} has no complete snapshot {version}")
    return Snapshot(path)


def of_resources(column: Column, resources) -> Column:
    """Whether a column names one of some resources, None among them."""
    names = [r for r in resources if r is not None]
    found = column.isin(names) if names else F.lit(False)
    return F.coalesce(found, F.lit(False)) | column.isNull() if None in resources else found


def write_table(before: Snapshot, name: str, rows: DataFrame, marks: dict[str | None, str], whole: bool = False) -> Table:
    """Writes the rows of the resources in marks, or a batch of a whole table, into new folders. Others that `before` has stay, but for a batch None; nothing is visible until commit()."""
    spark, base = rows.sparkSession, f"{before.path}/{name}"
    version = f"version={before.version + 1:012d}-{uuid.uuid4().hex[:12]}"
    schema = StructType([StructField(f.name, f.dataType) for f in rows.schema])
    if "" in marks:
        raise ValueError("a resource needs a name: Spark's folders don't tell an empty one from none")
    old = before.tables[name].parts if name in before.tables else {}
    if whole:
        ((batch, mark),) = marks.items()
        rows.write.parquet(f"{base}/{version}")
        return Table(schema, True, {**({} if batch is None else old), batch: (version, mark)})
    rows.filter(of_resources(F.col("resource_id"), marks)).write.partitionBy("resource_id").parquet(f"{base}/{version}")
    folders = {}
    for child in _names(spark, f"{base}/{version}"):
        column, _, value = child.partition("=")
        if column == "resource_id":
            folders[None if value == _NULL else unquote(value)] = f"{version}/{child}"
    return Table(schema, False, {**old, **{r: (folders.get(r), mark) for r, mark in marks.items()}})


def commit(spark: SparkSession, before: Snapshot, tables: dict[str, Table]) -> Snapshot:
    """The next snapshot: `before` with some tables replaced. Raises an error if another writer was first."""
    names = _names(spark, f"{before.path}/_manifests")
    version = max([before.version, *(int(n.split(".")[0]) for n in names)]) + 1
    if snapshot(spark, before.path).version != before.version:
        raise RuntimeError("another snapshot was committed meanwhile")
    found = replace(before, version=version, tables={**before.tables, **tables})
    shown = {name: {"schema": t.schema.jsonValue(), "whole": t.whole, "parts": [[r, folder, mark] for r, (folder, mark) in t.parts.items()]} for name, t in found.tables.items()}
    body = json.dumps({"version": version, "tables": shown}, sort_keys=True)
    fs, target = _fs(spark, f"{before.path}/_manifests/{_manifest(version)}")
    out = fs.create(target, False)
    try:
        out.write(bytearray(f"{body}\n{hashlib.md5(body.encode()).hexdigest()}\n".encode()))
    finally:
        out.close()
    return found


def update(spark: SparkSession, path: str, tables: dict[str, tuple[DataFrame, dict[str | None, str]]], replace_all: bool = False) -> Snapshot:
    """Tables (rows by resource, fingerprints) in one commit. Only resources whose fingerprint differs are written; with replace_all, others go."""
    before = snapshot(spark, path)
    done = {}
    for name, (rows, marks) in tables.items():
        known = before.fingerprints(name)
        stale = {r: mark for r, mark in marks.items() if known.get(r) != mark}
        table = write_table(before, name, rows, stale) if stale or name not in before.tables else before.tables[name]
        done[name] = replace(table, parts={r: p for r, p in table.parts.items() if r in marks}) if replace_all else table
    return commit(spark, before, done)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes the folders and manifests that none of the newest `keep` complete snapshots name; how many versions of tables went. No writer may be at work."""
    complete, newest = [], snapshot(spark, path)
    names = _names(spark, f"{path}/_manifests")
    for name in reversed(names):
        if len(complete) < keep:
            text = spark.read.text(f"{path}/_manifests/{name}", wholetext=True).first()
            found = _parse(path, text[0]) if text else None
            if found:
                complete.append(found)
    live = {f"{name}/{folder.split('/')[0]}" for s in complete for name, t in s.tables.items() for folder, _ in t.parts.values() if folder}
    gone = [f"{table}/{v}" for table in _names(spark, path) if table != "_manifests" for v in _names(spark, f"{path}/{table}") if f"{table}/{v}" not in live]
    for x in [*gone, *(f"_manifests/{n}" for n in names if n < _manifest(complete[-1].version if complete else newest.version))]:
        fs, target = _fs(spark, f"{path}/{x}")
        fs.delete(target, True)
    return len(gone)

"""Stored results: examples in tables that are appended to, candidate caches with fingerprints, inventories, static examples, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import reports as R
from . import snapshots as S

#: Changes to how sentences are normalised make older caches stale.
NORMALIZER = 1
KEY = ("resource_id", "doc_id", "position")


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def append_new(rows: DataFrame, path: str, key: list[str]) -> int:
    """Appends rows whose key isn't in the table yet, the first of each key; the number of rows written. An interrupted append is repeated as a whole: Spark commits a job's files at its end."""
    spark = rows.sparkSession
    there = _read(spark, path)
    new = rows.dropDuplicates(key)
    if there is not None:
        new = new.join(there.select(*key), key, "left_anti")
    new.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - (0 if there is None else there.count())


EXAMPLE_KEYS = {"resources": ["resource_id"], "targets": ["target_id"], "occurrences": ["target_id", *KEY]}


def write_examples(path: str, resources: DataFrame, targets: DataFrame, occurrences: DataFrame, append: bool = False) -> S.Snapshot:
    """Resources, targets and occurrences as tables of a store, committed together; what is there stays when appending, and a key is written once."""
    spark = resources.sparkSession
    before, done = S.snapshot(spark, path), {}
    batch = f"batch {before.version + 1}"
    for name, rows in (("resources", resources), ("targets", targets), ("occurrences", occurrences)):
        key, new = EXAMPLE_KEYS[name], rows.dropDuplicates(EXAMPLE_KEYS[name])
        if append and name in before.tables:
            new = new.join(before.read(spark, name).select(*key), key, "left_anti").select(*before.tables[name].schema.names)
        table = S.write_table(before, name, new, {batch: batch}, whole=True)
        done[name] = table if append else S.Table(table.schema, True, {batch: table.parts[batch]})
    return S.commit(spark, before, done)


def fingerprints(files: DataFrame) -> DataFrame:
    """Of files (resource_id, path, length, modificationTime): each resource's files, bytes and a digest of what makes a cache stale."""
    one = F.concat_ws("|", "path", F.col("length").cast("string"), F.col("modificationTime").cast("string"))
    by = files.groupBy("resource_id").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.sort_array(F.collect_list(F.md5(one))).alias("each"))
    return by.select("resource_id", "files", "bytes", F.md5(F.concat_ws("|", F.lit(str(NORMALIZER)), "resource_id", F.array_join("each", "|"))).alias("fingerprint"))


def _marks(marks: DataFrame) -> dict[str | None, str]:
    """A row per resource, of which there are as many as folders."""
    return {r["resource_id"]: r["fingerprint"] for r in marks.select("resource_id", "fingerprint").collect()}


def write_cache(path: str, rows: DataFrame, marks: DataFrame) -> S.Snapshot:
    """Sentences by resource with their inventory of tokens, and the fingerprints that they were made from: one commit of both tables. Resources whose fingerprint the cache has aren't written again; those that marks doesn't have go."""
    own = _marks(marks)
    return S.update(rows.sparkSession, path, {"rows": (rows, own), "tokens": (R.token_inventory(rows), own)}, replace_all=True)


def _state(known: str | None, mark: str) -> str:
    return "missing" if known is None else "fresh" if known == mark else "stale"


def freshness(path: str, marks: DataFrame) -> DataFrame:
    """By resource of marks: fresh, stale, or missing in the cache."""
    spark = marks.sparkSession
    known = S.snapshot(spark, path).fingerprints("rows")
    return spark.createDataFrame([(r, _state(known.get(r), mark)) for r, mark in _marks(marks).items()], "resource_id string, state string")


def read_cache(path: str, marks: DataFrame, raw: DataFrame, require: bool = False) -> DataFrame:
    """Sentences of fresh resources from the newest snapshot of the cache, of others from raw; with `require` a resource that isn't fresh is an error.

    Resources are few: the fresh ones go by name to the scan, which then reads their folders only.
    """
    spark = marks.sparkSession
    now = S.snapshot(spark, path)
    known = now.fingerprints("rows")
    own = _marks(marks)
    fresh = [r for r, mark in own.items() if _state(known.get(r), mark) == "fresh"]
    if require and len(fresh) < len(own):
        raise ValueError(f"not in the cache: {sorted(set(own) - set(fresh), key=str)}")
    if not fresh:
        return raw
    cached = now.read(spark, "rows").filter(S.of_resources(F.col("resource_id"), fresh))
    return cached.select(*raw.columns).unionByName(raw.filter(~S.of_resources(F.col("resource_id"), fresh)))


def ensure_hits(path: str, marks: DataFrame, matches: DataFrame) -> list[str]:
    """Brings the inventory of target hits up to date: only resources whose hits are missing or stale are written anew. Their names."""
    spark, own = marks.sparkSession, _marks(marks)
    known = S.snapshot(spark, path).fingerprints("hits")
    todo = sorted(r for r, mark in own.items() if known.get(r) != mark)
    if todo:
        S.update(spark, path, {"hits": (R.target_hits(matches).select("target_id", "resource_id"), own)})
    return todo


def safe_id(resource: Column) -> Column:
    """A resource's id as a file name: other characters become "_", and a digest keeps ids apart."""
    return F.concat(F.regexp_replace(resource, "[^A-Za-z0-9._-]", "_"), F.lit("_"), F.substring(F.md5(resource), 1, 16))


def static_examples(retained: DataFrame, targets: DataFrame, most: int = 3) -> DataFrame:
    """Examples by verb, target key and signature, best first."""
    found = retained.join(targets.select("target_id", "verb_id", "target_key", "signature"), "target_id")
    best = Window.partitionBy("verb_id", "target_key", "signature").orderBy(F.desc("score"), "sentence_chars", *KEY)
    return found.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= most).select("verb_id", "target_key", "signature", "nth", *KEY, "score")


def lookup_static(examples: DataFrame, wanted: DataFrame, most: int = 5) -> DataFrame:
    """Examples of wanted (target_key, signature or null): of the signature, or of the whole key where it has none."""
    found = wanted.withColumnRenamed("signature", "wanted").join(examples, "target_key")
    own = F.coalesce(F.col("wanted") == F.col("signature"), F.lit(False))
    of = Window.partitionBy("target_key", "wanted")
    chosen = found.withColumn("own", own).withColumn("any_own", F.max("own").over(of)).filter(F.col("own") | ~F.col("any_own"))
    return chosen.withColumn("rank", F.row_number().over(of.orderBy("signature", "nth", *KEY))).filter(F.col("rank") <= most).drop("own", "any_own")


def checksums(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Files of a folder against a manifest (name, sha256): match, mismatch, missing or unlisted."""
    there = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    both = manifest.select("name", F.col("sha256").alias("listed")).join(there, "name", "full")
    state = F.when(F.col("found").isNull(), "missing").when(F.col("listed").isNull(), "unlisted").when(F.col("found") == F.col("listed"), "match").otherwise("mismatch")
    return both.select("name", state.alias("state"))


def markdown(rows: DataFrame, title: str) -> str:
    """A small report as a table; the rows are collected, at most 1,000."""
    found = rows.limit(1001).collect()
    if len(found) > 1000:
        raise ValueError("a report has 1,000 rows at most")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in found]) + "\n"

"""Lookups with fallbacks, resource selection and checks between sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def select_resources(resources: DataFrame, wanted: DataFrame, aliases: DataFrame) -> DataFrame:
    """Resources (id, ...) whose id, or an alias of it, is wanted (name); each once."""
    names = wanted.join(F.broadcast(aliases), wanted["name"] == aliases["alias"], "left").select(F.coalesce("target", "name").alias("id")).distinct()
    return resources.join(names, "id", "left_semi")


def unknown_resources(resources: DataFrame, wanted: DataFrame, aliases: DataFrame) -> DataFrame:
    """Wanted names that no resource has."""
    names = wanted.join(F.broadcast(aliases), wanted["name"] == aliases["alias"], "left").select("name", F.coalesce("target", "name").alias("id"))
    return names.join(resources, "id", "left_anti").select("name").distinct()


def partitions(files: DataFrame) -> DataFrame:
    """files (id, file): partition_id is id, with "#" and the file in safe characters where a resource has several."""
    many = F.count("*").over(Window.partitionBy("id")) > 1
    return files.withColumn("partition_id", F.when(many, F.concat_ws("#", "id", F.regexp_replace("file", "[^A-Za-z0-9_-]", "_"))).otherwise(F.col("id")))


def without_duplicated_zips(files: DataFrame) -> DataFrame:
    return files.filter(~F.col("file").rlike(r"-en-sq-[0-9]+\.zip$"))


def source_priority(cells: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """cells (key, form) with the reference form of the first source, else of the second (key, ref), and the verdict."""
    found = cells.join(first.select("key", F.col("ref").alias("a")), "key", "left").join(second.select("key", F.col("ref").alias("b")), "key", "left")
    ref = F.coalesce("a", "b")
    status = F.when(F.col("form").isNull(), "error").when(ref.isNull(), "missing").when(ref == F.col("form"), "match").otherwise("mismatch")
    return found.select("key", "form", ref.alias("ref"), F.when(F.col("a").isNotNull(), "first").when(F.col("b").isNotNull(), "second").alias("match_source"), status.alias("status"))


def verify_totals(checked: DataFrame) -> DataFrame:
    return checked.groupBy("status", "match_source").agg(F.count("*").alias("n"))


def lexeme_fallback(verbs: DataFrame, lexemes: DataFrame) -> DataFrame:
    """verbs (id, lemma) with the lexeme (lex, tags) found by lemma, else id, else folded lemma among lexemes, else among folded lexemes."""
    fold = lambda c: F.translate(F.lower(c), "ëç", "ec")
    exact = lambda name: lexemes.select(F.col("lex").alias(f"k_{name}"), F.col("lex").alias(f"lex_{name}"))
    folded = lexemes.groupBy(fold(F.col("lex")).alias("k_d")).agg(F.min("lex").alias("lex_d"))
    found = verbs.join(exact("a"), F.col("lemma") == F.col("k_a"), "left").join(exact("b"), F.col("id") == F.col("k_b"), "left").join(exact("c"), fold(F.col("lemma")) == F.col("k_c"), "left").join(folded, fold(F.col("lemma")) == F.col("k_d"), "left")
    how = F.when(F.col("lex_a").isNotNull(), "lemma").when(F.col("lex_b").isNotNull(), "id").when(F.col("lex_c").isNotNull(), "folded").when(F.col("lex_d").isNotNull(), "folded index").otherwise("none")
    return found.select("id", F.coalesce("lex_a", "lex_b", "lex_c", "lex_d").alias("lex"), how.alias("how"))


def tag_superset(wanted: DataFrame, forms: DataFrame) -> DataFrame:
    """For each wanted row (key, lemma, want) the first form (lemma, nth, form, tags) of its lemma that has all tags."""
    found = wanted.join(forms, "lemma").filter(F.size(F.array_except("want", "tags")) == 0)
    return found.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy("nth", "form"))).filter("rn = 1").select("key", "form")


def missing_chunks(reports: DataFrame, expected: int) -> DataFrame:
    """Numbers from 0 to expected - 1 that no chunk report (chunk) has."""
    return reports.sparkSession.range(expected).select(F.col("id").cast("int").alias("chunk")).join(reports, "chunk", "left_anti")


def fresh(inputs: DataFrame) -> DataFrame:
    """One row: whether all stage inputs (name, generated_at, version) agree."""
    return inputs.agg((F.countDistinct("generated_at") <= 1).alias("same_time"), (F.countDistinct("version") <= 1).alias("same_version"))


def lookup_parallel(keys: DataFrame, examples: DataFrame) -> DataFrame:
    """Examples (form, example) of keys (key): of the whole form, else of its only indexed token, else of its last token."""
    indexed = examples.select("form").distinct()
    single = keys.withColumn("t", F.explode(F.split("key", " "))).join(indexed, F.col("t") == F.col("form"), "left_semi").groupBy("key").agg(F.countDistinct("t").alias("n"), F.min("t").alias("t")).filter("n = 1").select("key", "t")
    found = keys.join(indexed.withColumnRenamed("form", "whole"), F.col("key") == F.col("whole"), "left").join(single, "key", "left")
    use = found.select("key", F.coalesce("whole", "t", F.element_at(F.split("key", " "), -1)).alias("form"))
    return use.join(examples, "form").select("key", "form", "example")


def lcg_sample(n: int, seed: int, k: int, spark) -> DataFrame:
    """k numbers below n by a linear congruential generator (1664525, 1013904223, 2 ** 32), with replacement."""
    step = lambda a, _: F.struct(((a["state"] * 1664525 + 1013904223) % (1 << 32)).alias("state"), F.array_append(a["out"], ((a["state"] * 1664525 + 1013904223) % (1 << 32)) % n).alias("out"))
    start = F.struct(F.lit(seed).cast("long").alias("state"), F.array().cast("array<bigint>").alias("out"))
    return spark.range(1).select(F.posexplode(F.aggregate(F.sequence(F.lit(1), F.lit(k)), start, step, lambda a: a["out"])).alias("place", "number"))


def exact_target(hits: DataFrame, targets: DataFrame, key: str, most: int = 10) -> DataFrame:
    """The best occurrences of targets with a key, by score, then target and place. The cut comes before any text is read."""
    own = targets.filter(F.col("target_key") == key).select("target_id", "target_key", "signature")
    return hits.join(F.broadcast(own), "target_id").orderBy(F.desc("score"), "target_id", "resource_id", "doc_id", "position").limit(most)


def occurrence_counts(hits: DataFrame, targets: DataFrame, condition, by: list[str], most: int = 20) -> DataFrame:
    """Occurrences and resources of the targets that satisfy a condition, by variant, key and `by`, most frequent first."""
    own = targets.filter(condition).select("target_id", "target_key", *by)
    counts = hits.join(own, "target_id").groupBy("variant_kind", "target_key", *by).agg(F.count("*").alias("occurrences"), F.countDistinct("resource_id").alias("resources"))
    return counts.orderBy(F.desc("occurrences"), F.desc("resources"), "variant_kind", "target_key", *by).limit(most)

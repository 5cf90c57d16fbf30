"""Whole reports put together from the operators: audits, forensics, stress plans, dossiers, verification, chunk reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import audit as A

#: The dossier takes so many misses at most.
DOSSIER = 120


def sample_dossier(misses: DataFrame, rules: list[tuple[str, Column, int, str, int]], most: int = DOSSIER) -> DataFrame:
    """target_id with the reasons for which it was taken: rules (reason, condition, most in all, group column, most of a group)
    are gone through in order, each taking misses by key and id, until `most` distinct misses are taken.

    One plan: a row for each rule that a miss satisfies, ranked in its group and then in its rule, which leaves as many rows as
    the rules allow at most; among those few, a row is taken while fewer than `most` misses came before it.
    """
    marks = [F.when(condition, F.struct(F.lit(i).alias("rule"), F.lit(reason).alias("reason"), F.lit(total).alias("total"), F.lit(each).alias("each"), F.col(group).cast("string").alias("group"))) for i, (reason, condition, total, group, each) in enumerate(rules)]
    found = misses.select("target_id", "target_key", F.explode(F.filter(F.array(*marks), lambda m: m.isNotNull())).alias("m")).select("target_id", "target_key", "m.*")

    def ranked(d: DataFrame, by: list[str], limit: str, most_of_any: int) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy(*by).orderBy("target_key", "target_id"))
        return d.withColumn("nth", nth).filter(F.col("nth") <= most_of_any).filter(F.col("nth") <= F.col(limit))

    found = ranked(ranked(found, ["rule", "group"], "each", max(r[4] for r in rules)), ["rule"], "total", max(r[2] for r in rules))
    order = ["rule", "target_key", "target_id"]
    first = F.row_number().over(Window.partitionBy("target_id").orderBy(*order)) == 1
    before = F.coalesce(F.sum(F.col("first").cast("int")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = found.withColumn("first", first).withColumn("before", before).filter(F.col("before") < most)
    return taken.groupBy("target_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rule", "reason"))), lambda x: x["reason"]).alias("reasons"))


def stress_plan(targets: DataFrame, patterns: DataFrame, inventory: DataFrame) -> DataFrame:
    """Of stress patterns (target_id, pattern, anchor) and a token inventory (resource_id, token), before any search: targets, patterns, anchors, and partitions that have an anchor."""
    anchors = patterns.select(F.col("anchor").alias("token")).distinct()
    there = inventory.join(anchors, "token", "left_semi")
    counts = patterns.agg(F.countDistinct("target_id").alias("targets"), F.count("*").alias("patterns"), F.countDistinct("anchor").alias("anchors"))
    partitions = there.agg(F.countDistinct("resource_id").alias("partitions"), F.countDistinct("token").alias("anchors_found"))
    return counts.join(partitions, F.lit(True)).join(targets.agg(F.count("*").alias("candidates")), F.lit(True))


def chunk_summary(chunks: DataFrame, expected: int) -> DataFrame:
    """Reports of chunks (chunk, targets, matches, version): those that are valid summed up; missing, repeated and foreign chunk numbers, and how many versions there are."""
    wanted = chunks.sparkSession.range(expected).select(F.col("id").cast("int").alias("chunk"))
    by = chunks.groupBy("chunk").agg(F.count("*").alias("n"), F.sum("targets").alias("targets"), F.sum("matches").alias("matches"))
    both = wanted.withColumn("wanted", F.lit(True)).join(by, "chunk", "full")
    good = F.col("wanted") & (F.col("n") == 1)
    listed = lambda test: F.array_join(F.sort_array(F.collect_list(F.when(test, F.col("chunk")))).cast("array<string>"), ",")
    summed = both.agg(
        F.coalesce(F.sum(F.when(good, F.col("targets"))), F.lit(0)).alias("targets"), F.coalesce(F.sum(F.when(good, F.col("matches"))), F.lit(0)).alias("matches"), F.count_if(good).alias("valid"),
        listed(F.col("n").isNull()).alias("missing"), listed(F.col("wanted") & (F.col("n") > 1)).alias("repeated"), listed(F.col("wanted").isNull()).alias("foreign"),
    )
    return summed.join(chunks.agg(F.countDistinct("version").alias("versions")), F.lit(True))


def analyzer_requests(misses: DataFrame) -> DataFrame:
    """Head tokens to analyse, each once with its modes: as it is, and without diacritics where that differs."""
    head = F.element_at("tokens", -1)
    plain = A.folded(head)
    modes = F.array(F.struct(F.lit("strict").alias("mode"), head.alias("token")), F.when(plain != head, F.struct(F.lit("no_diacritics").alias("mode"), plain.alias("token"))))
    return misses.select(F.explode(F.filter(modes, lambda m: m.isNotNull())).alias("m")).select("m.mode", "m.token").groupBy("mode", "token").agg(F.count("*").alias("targets"))


def verdict_index(verdicts: DataFrame, targets: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """Verdicts (target_id, target_key, version, form) that fit a target: of the right version, with its key, the first of each; and how many were refused, by reason."""
    rows = verdicts.join(targets.select("target_id", F.col("target_key").alias("known")), "target_id", "left")
    why = F.when(F.col("version") != version, "stale").when(F.col("known").isNull(), "unknown target").when(F.col("known") != F.col("target_key"), "other key")
    rows = rows.withColumn("why", why)
    first = Window.partitionBy("target_id").orderBy("form")
    valid = rows.filter("why IS NULL").withColumn("nth", F.row_number().over(first))
    refused = rows.filter("why IS NOT NULL").select("why").unionByName(valid.filter("nth > 1").select(F.lit("repeated").alias("why"))).groupBy("why").agg(F.count("*").alias("n"))
    return valid.filter("nth = 1").select("target_id", "form"), refused


#: Names of paradigms in a printed table and the tags that they stand for; the first that fits is taken.
TABLE_MOODS = (("dëftore", "indicative"), ("lidhore", "subjunctive"), ("kushtore", "conditional"), ("habitore", "admirative"), ("dëshirore", "optative"), ("urdhërore", "imperative"))
TABLE_TENSES = (
    ("më se e kryer", "past perfect"), ("e kryer e tejshkuar", "past-anterior"), ("e ardhme e së shkuarës e përparme", "future-perfect-in-past"), ("e ardhme e së shkuarës", "future-in-past"), ("e ardhme e përparme", "future perfect"),
    ("e ardhme", "future"), ("e kryer e thjeshtë", "aorist"), ("e kryer", "perfect"), ("e pakryer", "imperfect"), ("e tashme", "present"),
)


def table_tags(label: Column, person: Column, number: Column) -> Column:
    """Tags of a cell of a printed paradigm."""
    lower = F.lower(label)
    moods = F.array(*(F.when(lower.contains(k), v) for k, v in TABLE_MOODS))
    tense = F.lit("")
    for k, v in reversed(TABLE_TENSES):
        tense = F.when(lower.contains(k), v).otherwise(tense)
    who = F.element_at(F.array(F.lit("first-person"), F.lit("second-person"), F.lit("third-person")), person.cast("int"))
    return F.filter(F.concat(moods, F.split(tense, " "), F.array(who, number)), lambda t: t.isNotNull() & (t != ""))


def table_forms(files: DataFrame) -> DataFrame:
    """Forms of printed paradigms in Markdown (path, value with a whole file): "## id: lemma", "### paradigm", then rows of person, singular and plural; "—" is no form."""
    verbs = files.select(F.explode(F.slice(F.split("value", r"(?m)^## +"), 2, 1 << 20)).alias("verb"))
    verbs = verbs.select(F.trim(F.regexp_extract("verb", r"^([A-Za-z0-9-]+)\s*:", 1)).alias("verb_id"), F.trim(F.regexp_extract("verb", r"^[A-Za-z0-9-]+\s*:\s*([^\n]+)", 1)).alias("lemma"), F.explode(F.slice(F.split("verb", r"(?m)^### +"), 2, 1 << 20)).alias("table"))
    rows = verbs.select("verb_id", "lemma", F.trim(F.regexp_extract("table", r"^([^\n]+)", 1)).alias("paradigm"), F.explode(F.split("table", "\n")).alias("line"))
    cell = lambda k: F.trim(F.regexp_extract("line", r"^\s*\|\s*([1-3])\s*\|([^|]*)\|([^|]*)\|\s*$", k))
    rows = rows.select("verb_id", "lemma", "paradigm", cell(1).alias("person"), cell(2).alias("sg"), cell(3).alias("pl")).filter("person <> ''")
    both = F.explode(F.array(F.struct(F.lit("singular").alias("number"), F.col("sg").alias("form")), F.struct(F.lit("plural").alias("number"), F.col("pl").alias("form")))).alias("c")
    return rows.select("verb_id", "lemma", "paradigm", "person", both).select("verb_id", "lemma", "c.form", table_tags(F.col("paradigm"), F.col("person"), F.col("c.number")).alias("tags")).filter(~F.col("form").isin("", "—", "-"))

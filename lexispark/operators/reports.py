"""Reports over matches: inventories, coverage, misses, forensics, samples and lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import new_path
from ..functions import text as T


def token_inventory(rows: DataFrame, partition: str = "resource_id") -> DataFrame:
    """Distinct tokens of each partition."""
    return rows.select(partition, F.explode(T.tokens(F.col("norm"))).alias("token")).distinct()


def target_hits(matches: DataFrame, partition: str = "resource_id") -> DataFrame:
    """Distinct targets matched in each partition, before the guard."""
    return matches.select(partition, "target_id").distinct()


def partitions_to_scan(partitions: DataFrame, inventory: DataFrame, wanted: DataFrame) -> DataFrame:
    """may_match by partition: whether its inventory has a wanted token; partitions without an inventory must be scanned."""
    hits = inventory.join(wanted, "token", "left_semi").select("resource_id").distinct().withColumn("hit", F.lit(True))
    found = inventory.select("resource_id").distinct().join(hits, "resource_id", "left").select("resource_id", F.coalesce("hit", F.lit(False)).alias("may_match"))
    return partitions.join(found, "resource_id", "left").select("resource_id", F.coalesce("may_match", F.lit(True)).alias("may_match"))


def scan_partitions(rows: DataFrame, inventory: DataFrame, wanted: DataFrame, without: DataFrame | None = None, partition: str = "resource_id") -> DataFrame:
    """rows, a table stored by partition, of the partitions whose inventory has a wanted token; `without`: partitions that have no inventory, which are scanned as well.

    The partitions come from a join, a row for each at most, and reach the scan at run time: Spark then reads their folders only.
    """
    hits = inventory.join(wanted.select("token").distinct(), "token", "left_semi").groupBy(partition).agg(F.count("*").alias("tokens")).filter("tokens > 0").select(partition)
    if without is not None:
        hits = hits.unionByName(without.select(partition))
    return rows.join(F.broadcast(hits), partition, "left_semi")


def anchor_partitions(patterns: DataFrame, inventory: DataFrame) -> DataFrame:
    """Number of partitions that have each anchor token."""
    anchors = patterns.select("anchor").distinct()
    return anchors.join(inventory, F.col("anchor") == F.col("token"), "left").groupBy("anchor").agg(F.countDistinct("resource_id").alias("partitions"))


def search_postings(rows: DataFrame) -> DataFrame:
    """Inverted index: token, sentence and place of each occurrence."""
    return rows.select("resource_id", "doc_id", "position", F.posexplode(T.tokens(F.col("norm"))).alias("at", "token"))


def search_sentences(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Sentences that have a word, as a search index reads them; with `most` the first of them by document and position."""
    found = rows.filter("norm <> ''").select("resource_id", "doc_id", "position", "norm")
    return found if most is None else found.orderBy("doc_id", "position", "resource_id").limit(most)


def search_phrase(postings: DataFrame, phrase: list[str]) -> DataFrame:
    """Sentences with a phrase and its occurrences: the postings of each token are shifted to the phrase's start and counted there."""
    wanted = F.create_map(*(x for i, t in enumerate(phrase) for x in (F.lit(i), F.lit(t))))
    own = postings.filter(F.col("token").isin(*phrase)).select("resource_id", "doc_id", "position", "at", "token")
    starts = own.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(phrase) - 1)))).filter(F.element_at(wanted, F.col("i")) == F.col("token")).withColumn("start", F.col("at") - F.col("i"))
    key = ["resource_id", "doc_id", "position"]
    return starts.groupBy(*key, "start").agg(F.countDistinct("i").alias("n")).filter(F.col("n") == len(phrase)).groupBy(*key).agg(F.count("*").alias("hits"))


def stress_report(patterns: DataFrame, matches: DataFrame) -> DataFrame:
    """By kind: patterns, matches, matched patterns and matched targets; kinds without a match are there too."""
    hits = matches.groupBy("kind", "pattern", "target_id").agg(F.count("*").alias("n"))
    joined = patterns.join(hits, ["kind", "pattern", "target_id"], "left")
    return joined.groupBy("kind").agg(F.count("*").alias("patterns"), F.coalesce(F.sum("n"), F.lit(0)).alias("matches"), F.count("n").alias("matched_patterns"), F.countDistinct(F.when(F.col("n").isNotNull(), F.col("target_id"))).alias("matched_targets"))


def target_occurrences(hits: DataFrame) -> DataFrame:
    """By target: occurrences, canonical and variant ones, resources, best score."""
    canonical = F.col("variant_kind") == "canonical"
    return hits.groupBy("target_id").agg(
        F.count("*").alias("occurrences"), F.count_if(canonical).alias("canonical"), F.count_if(~canonical).alias("variant"), F.countDistinct("resource_id").alias("resources"), F.max("score").alias("best_score")
    )


def retained_evidence(hits: DataFrame) -> DataFrame:
    return hits.groupBy("target_id").agg(F.count("*").alias("occurrences"), F.countDistinct("resource_id").alias("resources"), F.array_join(F.sort_array(F.collect_set("variant_kind")), ",").alias("variants"))


def coverage(targets: DataFrame, hits: DataFrame) -> DataFrame:
    """targets with whether they are hit."""
    return targets.join(hits.select("target_id").distinct().withColumn("hit", F.lit(True)), "target_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def coverage_by(covered: DataFrame, *dimensions: str) -> DataFrame:
    """total, hit and miss by each dimension and in all, in one pass: dimension, key."""
    keys = [c for c in covered.columns if c in dimensions]
    sets = covered.groupingSets([[], *([k] for k in keys)], *keys).agg(F.count("*").alias("total"), F.count_if("hit").alias("hit"), F.count_if(~F.col("hit")).alias("miss"), *(F.grouping(k).alias(f"g_{k}") for k in keys))
    name = reduce(lambda a, k: a.when(F.col(f"g_{k}") == 0, k), keys, F.when(F.lit(False), "")).otherwise("all")
    key = reduce(lambda a, k: a.when(F.col(f"g_{k}") == 0, F.col(k).cast("string")), keys, F.when(F.lit(False), "")).otherwise("all")
    return sets.select(name.alias("dimension"), key.alias("key"), "total", "hit", "miss")


def raw_coverage(targets: DataFrame, raw: DataFrame, retained: DataFrame | None, dimension: str) -> DataFrame:
    """By dimension: targets, with raw hits, without, with retained hits where these are given."""
    both = targets.join(raw.select("target_id").distinct().withColumn("r", F.lit(True)), "target_id", "left")
    counts = [F.count("*").alias("total"), F.count("r").alias("raw_hit"), F.count_if(F.col("r").isNull()).alias("raw_miss")]
    if retained is not None:
        both = both.join(retained.select("target_id").distinct().withColumn("k", F.lit(True)), "target_id", "left")
        counts.append(F.count("k").alias("retained_hit"))
    return both.groupBy(F.col(dimension).alias("key")).agg(*counts)


def cell_key() -> Column:
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat_ws(".", *map(none, ("mood", "tense", "voice", "polarity")), F.lit("declarative"), none("person"), none("number"))


def miss_bucket() -> Column:
    t = F.col("tokens")
    c, active = F.col, F.col("voice") == "active"
    return (
        F.when((F.get(t, 0) == "mos") & (F.get(t, 1) == "të"), "negative_subjunctive_order").when(c("voice") == "middle-passive", "middle_passive")
        .when(active & (c("mood") == "admirative") & (c("tense") == "present"), "rare_admirative_present").when((c("mood") == "admirative") & (c("tense") != "present"), "rare_admirative_nonpresent")
        .when(active & (c("mood") == "optative") & (c("tense") == "present"), "rare_optative_present").when((c("mood") == "optative") & (c("tense") == "perfect"), "rare_optative_perfect")
        .when(c("tense").contains("future-perfect"), "future_perfect_analytic").when(c("tense") == "past-anterior", "past_anterior").when(F.size(t) >= 4, "long_analytic_phrase").otherwise("other")
    )


def alternant() -> Column:
    t = F.col("tokens")
    return F.when((F.get(t, 0) == "mos") & (F.get(t, 1) == "të"), F.array_join(F.concat(F.array(F.lit("të"), F.lit("mos")), F.slice(t, 3, F.greatest(F.size(t) - 2, F.lit(0)))), " "))


def phrase_shape() -> Column:
    key = F.replace(F.col("target_key"), F.lit("_"), F.lit(" "))
    out = F.when(F.size("tokens") <= 1, "single-token")
    for start, shape in (("mos të ", "mos-te phrase"), ("të ", "te phrase"), ("nuk ", "nuk phrase"), ("s ", "s-negative phrase"), ("do të ", "do-te phrase")):
        out = out.when(key.startswith(start), shape)
    return out.otherwise("other multiword")


def trace_status(retained: Column) -> Column:
    """Of the counters of match.trace()."""
    some = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    return (
        F.when(retained > 0, "retained_despite_coverage_miss").when(some("emitted_matches_before_writer_cap"), "raw_seen_emitted_not_retained").when(some("local_cap_dropped_matches"), "raw_seen_local_cap_dropped")
        .when(some("quality_rejected_matches") | some("variant_rejected_matches"), "raw_seen_filtered").when(~some("raw_pattern_matches"), "raw_zero").otherwise("raw_seen_unclassified")
    )


def likely_reason() -> Column:
    """Of a miss with trace_status, labels, signature, morphology_proof_level and primary."""
    part = lambda i: F.coalesce(F.get(F.split("signature", r"\."), i), F.lit("unknown"))
    has = lambda x: F.array_contains("labels", x)
    return (
        F.when(F.col("trace_status") == "raw_seen_filtered", "found-only-in-rejected-text").when(part(3) == "middle-passive", "middle-passive-attestation-needed").when(has("near_empty_grammatical_cell"), "near-empty-generated-cell")
        .when(has("future_perfect_analytic"), "long-analytic-future-perfect").when(has("long_exact_phrase"), "long-exact-phrase").when((part(0) == "admirative") & (part(1) != "present"), "rare-admirative-nonpresent")
        .when(part(0) == "optative", F.concat(F.lit("rare-optative-"), part(1))).when(F.col("morphology_proof_level") == "analyzer", "analyzer-accepted-but-unattested").when(F.coalesce("primary", F.lit("")) != "", F.col("primary")).otherwise("unclassified")
    )


#: Labels in the order of their priority, with their category (fixed values).
PRIMARY = (
    ("middle_passive_needs_attestation", "needs_middle_passive_attestation"), ("near_empty_grammatical_cell", "near_empty_cell"), ("rare_admirative_present", "rare_or_analytic_cell"), ("rare_admirative_nonpresent", "rare_or_analytic_cell"),
    ("rare_optative_present", "rare_or_analytic_cell"), ("rare_optative_perfect", "rare_or_analytic_cell"), ("future_perfect_analytic", "rare_or_analytic_cell"), ("past_anterior", "rare_or_analytic_cell"),
    ("apostrophe_negative_variant_probe", "variant_probe_candidate"), ("diacriticless_variant_probe", "variant_probe_candidate"), ("te_mos_order_scanner_variant_checked", "scanner_variant_checked_but_absent"),
    ("s_negative_scanner_variant_checked", "scanner_variant_checked_but_absent"), ("diacritic_fold_scanner_variant_checked", "scanner_variant_checked_but_absent"), ("long_exact_phrase", "broader_phrase_search_needed"), ("lemma_outlier", "lemma_outlier"),
    ("duplicate_surface_targets", "duplicate_surface_target"), ("te_mos_order_variant_probe", "variant_probe_candidate"), ("analyzer_accepted_exact_absence", "analyzer_valid_exact_absence"), ("analyzer_lemma_alias_exact_absence", "analyzer_lemma_alias_absence"),
    ("analyzer_lemma_alias_head_token_absence", "analyzer_lemma_alias_absence"), ("component_morphology_only_exact_absence", "component_valid_phrase_absence"), ("morphology_not_validated_exact_absence", "morphology_unvalidated_exact_absence"),
)


def primary_category(labels: Column) -> Column:
    return reduce(lambda a, kv: a.when(F.array_contains(labels, kv[0]), kv[1]), PRIMARY, F.when(F.lit(False), "")).otherwise("unexplained_exact_absence")


def analyzer_class(cell: Column, labels: Column) -> Column:
    return F.when(cell.contains(".middle-passive."), "middle-passive").when(cell.startswith("admirative.") | cell.startswith("optative."), "active rare mood: admirative/optative").when(F.array_contains(labels, "analyzer_accepted_head_token_absence"), "other multiword active").otherwise("other single-token active")


def lexeme_bucket(tags: Column) -> Column:
    has = lambda x: F.array_contains(tags, x)
    return F.when(has("med"), "med").when(has("vi") & has("vt"), "vi+vt").when(has("vt"), "vt").when(has("vi"), "vi-only").when(F.size(tags) > 0, "other-lexeme").otherwise("no-lexeme")


def source_level(sources: Column) -> Column:
    return F.when(F.array_contains(sources, "husic"), "husic-backed").when(F.array_contains(sources, "uniparser"), "uniparser-backed").when(F.size(sources) > 0, "lexicon-only").otherwise("unknown-source")


def histograms(df: DataFrame, *dimensions: str) -> DataFrame:
    """Counts by each dimension: dimension, key, n."""
    pairs = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("key")) for d in dimensions))
    return df.select(F.explode(pairs).alias("p")).select("p.*").groupBy("dimension", "key").agg(F.count("*").alias("n"))


def top_entries(counts: DataFrame, k: int, key: str = "key", n: str = "n") -> DataFrame:
    return counts.orderBy(F.desc(n), key).limit(k)


def first_of(df: DataFrame, by: list[str], order: list, k: int = 1) -> DataFrame:
    """The first k rows of each group, with their rank; the cut comes before the shuffle."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rn") <= k)


def placed(df: DataFrame, order: list, name: str = "nth") -> DataFrame:
    """Rows with their places, from 1 on, in a total order of all of them.

    Ranges of the order go to tasks and are written with their numbers; a row's place is its place in its range and the rows
    of the ranges before, of which there are as many as tasks.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, "ranges")
    keys = [F.col(o).alias(f"__{i}") if isinstance(o, str) else o.alias(f"__{i}") for i, o in enumerate(order)]
    names = [F.col(f"__{i}") for i in range(len(order))]
    df.select("*", *keys).repartitionByRange(*names).withColumn("__range", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    before = F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    earlier = rows.groupBy("__range").agg(F.count("*").alias("n")).select("__range", F.coalesce(before, F.lit(0)).alias("__earlier"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*names))
    return rows.withColumn("__own", own).join(earlier, "__range").select(*df.columns, (F.col("__earlier") + F.col("__own")).alias(name))


def chunk(df: DataFrame, order: list, size: int, index: int) -> DataFrame:
    """Slice number `index` of `size` rows in an order; an empty slice is an error at index > 0."""
    found = placed(df, order).filter((F.col("nth") > index * size) & (F.col("nth") <= (index + 1) * size))
    if index and not found.limit(1).count():
        raise ValueError(f"chunk {index} is out of range")
    return found


def surface_profile(covered: DataFrame) -> DataFrame:
    """One row on surfaces: unique, hit, missed, missed in all their targets, mixed, shared by several targets."""
    by = covered.groupBy("target_key").agg(F.count("*").alias("n"), F.count_if("hit").alias("h"))
    return by.agg(
        F.count("*").alias("surfaces"), F.count_if(F.col("h") > 0).alias("hit"), F.count_if(F.col("h") < F.col("n")).alias("missed"), F.count_if(F.col("h") == 0).alias("fully_missed"),
        F.count_if((F.col("h") > 0) & (F.col("h") < F.col("n"))).alias("mixed"), F.count_if(F.col("n") > 1).alias("duplicate"),
    )


def outliers(by_key: DataFrame, least: int, most_hits: int | None = None, miss_rate: float | None = None) -> DataFrame:
    """Groups of at least `least` targets with few hits, or with a high rate of misses."""
    found = by_key.filter(F.col("total") >= least)
    if most_hits is not None:
        found = found.filter(F.col("hit") <= most_hits)
    return found if miss_rate is None else found.filter(F.col("miss") / F.col("total") >= miss_rate)


def lookup_blend(local: DataFrame, parallel: DataFrame, k: int) -> DataFrame:
    """Local examples of a key first, parallel ones fill up to k: key, origin, example."""
    both = local.select("key", F.lit("local").alias("origin"), F.lit(0).alias("o"), "score", "example").unionByName(parallel.select("key", F.lit("parallel").alias("origin"), F.lit(1).alias("o"), "score", "example"))
    return first_of(both, ["key"], ["o", F.desc("score"), "example"], k).select("key", "origin", "example", "rn")

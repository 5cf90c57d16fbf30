"""Registered queries: joins, aggregates, windows, samples and rule chains over targets and their occurrences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import match as M
from ..operators import reports as R
from ..registry import register
from .corpus import _ALL, _FAM, _KEY, _S, _STATS, MATCHES, SENTENCES, TARGETS_SQL, _with, occ, once, patterns, raw, rows, targets
from ..functions import text as T

_T = _with(TARGETS_SQL)
_COVER = f"{_ALL}, hits AS (SELECT DISTINCT target_id FROM retained), cov AS (SELECT t.*, h.target_id IS NOT NULL AS hit FROM targets t LEFT JOIN hits h ON t.target_id = h.target_id)"


def _cover(spark, sf):
    """A target is covered if a sentence that is kept has it: counts of one pass say so, without occurrences and their ranks."""
    kept = M.trace(once(spark, sf), patterns(spark)).filter("emitted_matches_before_writer_cap > 0")
    return R.coverage(targets(spark), kept)


# --- joins ------------------------------------------------------------------------------------------------------------


@register("join_occ_sent", f"{_ALL} SELECT o.target_id, o.score, s.resource_id, s.doc_id, s.position, s.sentence FROM retained o JOIN sentences s USING (resource_id, doc_id, position)")
def _(spark, sf):
    key = ["resource_id", "doc_id", "position"]
    return M.with_text(M.retain(occ(spark, sf)).select("target_id", "score", *key), rows(spark, sf))


@register("join_four_way", f"{_ALL}, res AS (SELECT DISTINCT source AS resource_id FROM documents) SELECT o.target_id, t.lemma, t.signature, r.resource_id, s.sentence, o.score FROM retained o JOIN targets t USING (target_id) JOIN sentences s USING (resource_id, doc_id, position) JOIN res r USING (resource_id)")
def _(spark, sf):
    key = ["resource_id", "doc_id", "position"]
    resources = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("source").alias("resource_id")).distinct()
    found = M.retain(occ(spark, sf)).select("target_id", "score", *key).join(targets(spark).select("target_id", "lemma", "signature"), "target_id")
    return M.with_text(found, rows(spark, sf)).join(resources, "resource_id").select("target_id", "lemma", "signature", "resource_id", "sentence", "score")


@register("join_left_stats", f"WITH r AS (SELECT source AS resource_id, count(*) AS documents FROM documents GROUP BY 1), s AS (SELECT * FROM ({_STATS}) WHERE occurrences > 100) SELECT r.resource_id, r.documents, s.candidates_seen, s.occurrences FROM r LEFT JOIN s USING (resource_id)")
def _(spark, sf):
    r = spark.read.parquet(f"{sf}/documents.parquet").groupBy(F.col("source").alias("resource_id")).agg(F.count("*").alias("documents"))
    s = M.scan_stats(rows(spark, sf), occ(spark, sf)).filter("occurrences > 100")
    return r.join(s, "resource_id", "left").select("resource_id", "documents", "candidates_seen", "occurrences")


_HITS = f"{_ALL}, raw_hits AS (SELECT DISTINCT target_id FROM matches), kept AS (SELECT DISTINCT target_id FROM retained)"


_raw = raw


@register("join_semi_hits", f"{_HITS} SELECT target_id, target_key FROM targets WHERE target_id IN (FROM raw_hits)")
def _(spark, sf):
    return targets(spark).join(R.target_hits(_raw(spark, sf)), "target_id", "left_semi").select("target_id", "target_key")


@register("join_anti_unknown", f"{_HITS} SELECT target_id FROM raw_hits WHERE target_id NOT IN (SELECT target_id FROM targets WHERE verb_id <> 'v1') ORDER BY 1 LIMIT 10")
def _(spark, sf):
    known = targets(spark).filter("verb_id <> 'v1'")
    return R.target_hits(_raw(spark, sf)).select("target_id").distinct().join(known, "target_id", "left_anti").orderBy("target_id").limit(10)


@register("join_anti_not_retained", f"{_HITS} SELECT target_id FROM targets WHERE target_id IN (FROM raw_hits) AND target_id NOT IN (FROM kept)")
def _(spark, sf):
    o = occ(spark, sf)
    return targets(spark).join(R.target_hits(_raw(spark, sf)), "target_id", "left_semi").join(M.retain(o), "target_id", "left_anti").select("target_id")


@register("join_values", f"{_ALL} SELECT target_id, count(*) AS n FROM occ WHERE target_id IN ('t01', 't06', 'zz') GROUP BY 1")
def _(spark, sf):
    wanted = spark.createDataFrame([("t01",), ("t06",), ("zz",)], "target_id string")
    return occ(spark, sf).join(F.broadcast(wanted), "target_id", "left_semi").groupBy("target_id").agg(F.count("*").alias("n"))


@register("join_lockstep", "WITH n AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS line FROM conversations) SELECT u.conv_id, u.line, u.text AS sq, a.text AS en FROM n u JOIN n a ON u.conv_id = a.conv_id AND u.line = a.line WHERE u.role = 'user' AND a.role = 'assistant'")
def _(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    numbered = R.first_of(c, ["conv_id", "role"], ["turn"], 1 << 30)
    side = lambda role, name: numbered.filter(F.col("role") == role).select("conv_id", F.col("rn").alias("line"), F.col("text").alias(name))
    return side("user", "sq").join(side("assistant", "en"), ["conv_id", "line"])


@register("join_parallel_match", f"{_with(SENTENCES, TARGETS_SQL, MATCHES)} SELECT DISTINCT pattern, {_KEY} FROM matches")
def _(spark, sf):
    return _raw(spark, sf).select("pattern", "resource_id", "doc_id", "position").distinct()


@register("flt_parallel_pair", "WITH n AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS line FROM conversations) SELECT u.conv_id, u.line FROM n u JOIN n a ON u.conv_id = a.conv_id AND u.line = a.line WHERE u.role = 'user' AND a.role = 'assistant' AND length(u.text) BETWEEN 1 AND 260 AND NOT contains(u.text, '<') AND length(a.text) BETWEEN 1 AND 260 AND NOT contains(a.text, '<')")
def _(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    numbered = R.first_of(c, ["conv_id", "role"], ["turn"], 1 << 30)
    side = lambda role, name: numbered.filter(F.col("role") == role).select("conv_id", F.col("rn").alias("line"), F.col("text").alias(name))
    return side("user", "sq").join(side("assistant", "en"), ["conv_id", "line"]).filter(T.parallel_pair(F.col("sq"), F.col("en"))).select("conv_id", "line")


@register("join_lookup_maps", "SELECT s.s_suppkey, n.n_name, r.r_name FROM supplier s JOIN nation n ON s_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey")
def _(spark, sf):
    t = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    return t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "n_name", "r_name")


@register("join_review_keys", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders JOIN (VALUES ('F', '1-URGENT'), ('O', '5-LOW')) v(o_orderstatus, o_orderpriority) USING (o_orderstatus, o_orderpriority) GROUP BY 1, 2")
def _(spark, sf):
    keys = spark.createDataFrame([("F", "1-URGENT"), ("O", "5-LOW")], "o_orderstatus string, o_orderpriority string")
    return spark.read.parquet(f"{sf}/orders.parquet").join(F.broadcast(keys), ["o_orderstatus", "o_orderpriority"]).groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


# --- aggregates -------------------------------------------------------------------------------------------------------


@register("agg_target_occ", f"{_ALL} SELECT target_id, count(*) AS occurrences, count(*) FILTER (variant_kind = 'canonical') AS canonical, count(*) FILTER (variant_kind <> 'canonical') AS variant, count(DISTINCT resource_id) AS resources, max(score) AS best_score FROM occ GROUP BY 1")
def _(spark, sf):
    return R.target_occurrences(occ(spark, sf))


@register("agg_occ_counts", f"{_ALL} SELECT target_id, count(*) AS n FROM occ GROUP BY 1")
def _(spark, sf):
    return occ(spark, sf).groupBy("target_id").agg(F.count("*").alias("n"))


@register("agg_retained_evidence", f"{_ALL} SELECT target_id, count(*) AS occurrences, count(DISTINCT resource_id) AS resources, string_agg(DISTINCT variant_kind, ',' ORDER BY variant_kind) AS variants FROM retained GROUP BY 1")
def _(spark, sf):
    return R.retained_evidence(M.retain(occ(spark, sf)))


@register("agg_variant_only", f"{_ALL} SELECT target_id, count(DISTINCT (doc_id, position)) AS sentences, count(DISTINCT resource_id) AS resources FROM occ GROUP BY 1 HAVING count(*) FILTER (variant_kind = 'canonical') = 0")
def _(spark, sf):
    found = occ(spark, sf).groupBy("target_id").agg(F.countDistinct("doc_id", "position").alias("sentences"), F.countDistinct("resource_id").alias("resources"), F.count_if(F.col("variant_kind") == "canonical").alias("c"))
    return found.filter("c = 0").drop("c")


def _raw_cov(name: str, dimension: str) -> None:
    @register(name, f"{_HITS} SELECT {dimension} AS key, count(*) AS total, count(*) FILTER (target_id IN (FROM raw_hits)) AS raw_hit, count(*) FILTER (target_id NOT IN (FROM raw_hits)) AS raw_miss, count(*) FILTER (target_id IN (FROM kept)) AS retained_hit FROM targets GROUP BY 1")
    def _(spark, sf):
        return R.raw_coverage(targets(spark), _raw(spark, sf), M.retain(occ(spark, sf)), dimension)


_raw_cov("agg_raw_coverage", "verb_id")
_raw_cov("cmd_raw_coverage", "signature")


@register("agg_coverage_cell_mood", f"{_COVER} SELECT CASE WHEN grouping(mood) = 0 THEN 'mood' WHEN grouping(tense) = 0 THEN 'tense' WHEN grouping(lemma) = 0 THEN 'lemma' ELSE 'all' END AS dimension, coalesce(mood, tense, lemma, 'all') AS key, count(*) AS total, count(*) FILTER (hit) AS hit, count(*) FILTER (NOT hit) AS miss FROM cov GROUP BY GROUPING SETS ((mood), (tense), (lemma), ())")
def _(spark, sf):
    return R.coverage_by(_cover(spark, sf), "mood", "tense", "lemma")


@register("cmd_coverage", f"{_COVER} SELECT mood, voice, count(*) AS total, count(*) FILTER (hit) AS hit FROM cov GROUP BY 1, 2")
def _(spark, sf):
    return _cover(spark, sf).groupBy("mood", "voice").agg(F.count("*").alias("total"), F.count_if("hit").alias("hit"))


@register("agg_variant_target", f"{_ALL}, v AS (SELECT target_id, bool_or(variant_kind = 'canonical') AS c, bool_or(variant_kind <> 'canonical') AS v FROM occ GROUP BY 1) SELECT count(*) FILTER (c) AS canonical, count(*) FILTER (v) AS variant, count(*) FILTER (v AND NOT c) AS variant_only FROM v")
def _(spark, sf):
    by = occ(spark, sf).groupBy("target_id").agg(F.bool_or(F.col("variant_kind") == "canonical").alias("c"), F.bool_or(F.col("variant_kind") != "canonical").alias("v"))
    return by.agg(F.count_if("c").alias("canonical"), F.count_if("v").alias("variant"), F.count_if(F.col("v") & ~F.col("c")).alias("variant_only"))


@register("agg_resource_family", f"WITH s AS ({_STATS}) SELECT {_FAM} AS family, sum(candidates_seen)::BIGINT AS candidates, sum(occurrences)::BIGINT AS occurrences, round(1e6 * sum(occurrences) / sum(candidates_seen), 4) AS per_million FROM s GROUP BY 1")
def _(spark, sf):
    s = M.scan_stats(rows(spark, sf), occ(spark, sf)).groupBy(T.resource_family(F.col("resource_id")).alias("family")).agg(F.sum("candidates_seen").alias("candidates"), F.sum("occurrences").alias("occurrences"))
    return s.withColumn("per_million", F.round(1e6 * F.col("occurrences") / F.col("candidates"), 4))


@register("agg_family_evidence", f"{_ALL} SELECT {_FAM} AS family, count(DISTINCT (doc_id, position)) AS sentences, count(DISTINCT target_id) AS targets, count(DISTINCT pattern) AS surfaces FROM occ GROUP BY 1")
def _(spark, sf):
    return occ(spark, sf).groupBy(T.resource_family(F.col("resource_id")).alias("family")).agg(F.countDistinct("doc_id", "position").alias("sentences"), F.countDistinct("target_id").alias("targets"), F.countDistinct("pattern").alias("surfaces"))


@register("agg_cell_lemma_surface", f"{_COVER} SELECT lemma, count(*) FILTER (voice = 'active') AS active, count(*) FILTER (voice = 'active' AND hit) AS active_hit, count(*) FILTER (voice = 'middle-passive') AS mp, count(*) FILTER (voice = 'middle-passive' AND hit) AS mp_hit FROM cov GROUP BY 1")
def _(spark, sf):
    a, m = F.col("voice") == "active", F.col("voice") == "middle-passive"
    return _cover(spark, sf).groupBy("lemma").agg(F.count_if(a).alias("active"), F.count_if(a & F.col("hit")).alias("active_hit"), F.count_if(m).alias("mp"), F.count_if(m & F.col("hit")).alias("mp_hit"))


@register("agg_voice_coverage", f"{_COVER} SELECT verb_id, voice, count(*) AS total, round(count(*) FILTER (hit) / count(*), 6) AS rate FROM cov GROUP BY 1, 2")
def _(spark, sf):
    return _cover(spark, sf).groupBy("verb_id", "voice").agg(F.count("*").alias("total"), F.round(F.count_if("hit") / F.count("*"), 6).alias("rate"))


@register("agg_surface_profile", f"{_COVER}, s AS (SELECT target_key, count(*) AS n, count(*) FILTER (hit) AS h FROM cov GROUP BY 1) SELECT count(*) AS surfaces, count(*) FILTER (h > 0) AS hit, count(*) FILTER (h < n) AS missed, count(*) FILTER (h = 0) AS fully_missed, count(*) FILTER (h > 0 AND h < n) AS mixed, count(*) FILTER (n > 1) AS duplicate FROM s")
def _(spark, sf):
    return R.surface_profile(_cover(spark, sf))


@register("agg_near_empty_outliers", f"{_COVER}, g AS (SELECT mood AS key, count(*) AS total, count(*) FILTER (hit) AS hit, count(*) FILTER (NOT hit) AS miss FROM cov GROUP BY 1) SELECT * FROM g WHERE total >= 2 AND hit <= 1")
def _(spark, sf):
    by = _cover(spark, sf).groupBy(F.col("mood").alias("key")).agg(F.count("*").alias("total"), F.count_if("hit").alias("hit"), F.count_if(~F.col("hit")).alias("miss"))
    return R.outliers(by, 2, most_hits=1)


@register("agg_db_totals", f"WITH s AS ({_STATS}) SELECT coalesce(sum(candidates_seen), 0)::BIGINT AS candidates, coalesce(sum(occurrences), 0)::BIGINT AS occurrences, count(*) AS resources FROM s")
def _(spark, sf):
    return M.scan_stats(rows(spark, sf), occ(spark, sf)).agg(F.coalesce(F.sum("candidates_seen"), F.lit(0)).alias("candidates"), F.coalesce(F.sum("occurrences"), F.lit(0)).alias("occurrences"), F.count("*").alias("resources"))


@register("agg_saturation", f"{_ALL}, c AS (SELECT target_id, count(*) AS n FROM retained GROUP BY 1) SELECT max(n) AS most, count(*) FILTER (n = (SELECT max(n) FROM c)) AS at_most FROM c")
def _(spark, sf):
    c = M.retain(occ(spark, sf)).groupBy("target_id").agg(F.count("*").alias("n"))
    return c.groupBy("n").agg(F.count("*").alias("k")).agg(F.max("n").alias("most"), F.max_by("k", "n").alias("at_most"))


@register("agg_audit_summary", f"{_COVER} SELECT count(*) AS targets, count(*) FILTER (hit) AS hit, count(*) FILTER (NOT hit) AS miss, count(DISTINCT lemma) AS lemmas, count(DISTINCT signature) AS cells FROM cov")
def _(spark, sf):
    return _cover(spark, sf).agg(F.count("*").alias("targets"), F.count_if("hit").alias("hit"), F.count_if(~F.col("hit")).alias("miss"), F.countDistinct("lemma").alias("lemmas"), F.countDistinct("signature").alias("cells"))


# --- windows, samples, limits -----------------------------------------------------------------------------------------


@register("win_static_top3", f"{_ALL} SELECT target_id, {_KEY}, rn FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, length(sentence), doc_id, position) AS rn FROM occ WHERE keep) WHERE rn <= 3")
def _(spark, sf):
    return R.first_of(occ(spark, sf).filter("keep"), ["target_id"], [F.desc("score"), "sentence_chars", "doc_id", "position"], 3).select("target_id", "resource_id", "doc_id", "position", "rn")


@register("win_variant_sample", f"{_ALL} SELECT target_id, variant_kind, {_KEY} FROM (SELECT *, row_number() OVER (PARTITION BY target_id, variant_kind ORDER BY score DESC, doc_id, position) AS rn FROM occ) WHERE rn = 1")
def _(spark, sf):
    return R.first_of(occ(spark, sf), ["target_id", "variant_kind"], [F.desc("score"), "doc_id", "position"]).select("target_id", "variant_kind", "resource_id", "doc_id", "position")


@register("win_cap_per_variant", f"{_ALL} SELECT variant_kind, target_id, {_KEY} FROM (SELECT *, row_number() OVER (PARTITION BY variant_kind ORDER BY target_id, score DESC, doc_id, position) AS rn FROM occ) WHERE rn <= 30")
def _(spark, sf):
    return R.first_of(occ(spark, sf), ["variant_kind"], ["target_id", F.desc("score"), "doc_id", "position"], 30).select("variant_kind", "target_id", "resource_id", "doc_id", "position")


@register("topk_entries", f"{_ALL} SELECT pattern AS key, count(*) AS n FROM occ GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(spark, sf):
    return R.top_entries(occ(spark, sf).groupBy(F.col("pattern").alias("key")).agg(F.count("*").alias("n")), 5)


@register("topk_raw_gaps", f"{_HITS}, g AS (SELECT verb_id AS key, count(*) FILTER (target_id NOT IN (FROM raw_hits)) AS raw_miss, count(*) FILTER (target_id IN (FROM raw_hits)) AS raw_hit FROM targets GROUP BY 1) SELECT * FROM g ORDER BY raw_miss DESC, raw_hit, key LIMIT 3")
def _(spark, sf):
    return R.raw_coverage(targets(spark), _raw(spark, sf), None, "verb_id").select("key", "raw_miss", "raw_hit").orderBy(F.desc("raw_miss"), "raw_hit", "key").limit(3)


@register("topk_bench_queries", f"{_with(SENTENCES, TARGETS_SQL, MATCHES)} SELECT pattern AS key, count(*) AS n FROM matches GROUP BY 1 ORDER BY n DESC, length(pattern), key LIMIT 4")
def _(spark, sf):
    return _raw(spark, sf).groupBy(F.col("pattern").alias("key")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.char_length("key"), "key").limit(4)


@register("topk_retained_samples", f"{_ALL} SELECT target_id, {_KEY} FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, doc_id, position, resource_id) AS rn FROM retained) WHERE rn <= 2")
def _(spark, sf):
    return R.first_of(M.retain(occ(spark, sf)), ["target_id"], [F.desc("score"), "doc_id", "position", "resource_id"], 2).select("target_id", "resource_id", "doc_id", "position")


@register("sample_trace", f"{_ALL} SELECT target_id, keep, {_KEY} FROM (SELECT *, row_number() OVER (PARTITION BY target_id, keep ORDER BY resource_id, doc_id, position) AS rn FROM occ) WHERE rn <= 2")
def _(spark, sf):
    return R.first_of(occ(spark, sf), ["target_id", "keep"], ["resource_id", "doc_id", "position"], 2).select("target_id", "keep", "resource_id", "doc_id", "position")


@register("sample_stress", f"{_with(SENTENCES, TARGETS_SQL, MATCHES)} SELECT pattern, {_KEY}, target_id FROM (SELECT *, row_number() OVER (PARTITION BY resource_id, pattern ORDER BY doc_id, position, \"end\", target_id, variant_kind) AS rn FROM matches) WHERE rn <= 2")
def _(spark, sf):
    return R.first_of(_raw(spark, sf), ["resource_id", "pattern"], ["doc_id", "position", "end", "target_id", "variant_kind"], 2).select("pattern", "resource_id", "doc_id", "position", "target_id")


@register("sample_balanced", f"{_T} SELECT target_id FROM (SELECT *, row_number() OVER (PARTITION BY lemma ORDER BY target_id) AS rn FROM targets) WHERE rn <= 2 ORDER BY rn, target_id LIMIT 7")
def _(spark, sf):
    return R.first_of(targets(spark), ["lemma"], ["target_id"], 2).orderBy("rn", "target_id").limit(7).select("target_id")


@register("limit_per_verb", f"{_T} SELECT target_id, row_number() OVER (ORDER BY (rn > 2)::INT, target_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY verb_id ORDER BY target_id) AS rn FROM targets)")
def _(spark, sf):
    ranked = R.first_of(targets(spark), ["verb_id"], ["target_id"], 1 << 30)
    return R.placed(ranked, [(F.col("rn") > 2).cast("int"), "target_id"], "place").select("target_id", "place")


@register("sort_request_key", f"{_T} SELECT target_id, row_number() OVER (ORDER BY CASE voice WHEN 'middle-passive' THEN 0 ELSE 1 END, CASE mood WHEN 'indicative' THEN 0 WHEN 'subjunctive' THEN 1 ELSE 2 END, lemma, target_key, target_id) AS place FROM targets")
def _(spark, sf):
    voice, mood = F.when(F.col("voice") == "middle-passive", 0).otherwise(1), F.when(F.col("mood") == "indicative", 0).when(F.col("mood") == "subjunctive", 1).otherwise(2)
    return R.placed(targets(spark), [voice, mood, "lemma", "target_key", "target_id"], "place").select("target_id", "place")


@register("chunk_targets", f"{_T} SELECT target_id, nth FROM (SELECT target_id, row_number() OVER (ORDER BY target_key, target_id) AS nth FROM targets) WHERE nth BETWEEN 5 AND 8")
def _(spark, sf):
    return R.chunk(targets(spark), ["target_key", "target_id"], 4, 1).select("target_id", "nth")


@register("cap_parallel", f"{_with(SENTENCES, TARGETS_SQL, MATCHES)}, a AS (SELECT *, row_number() OVER (PARTITION BY pattern, resource_id ORDER BY doc_id, position, \"end\", target_id) AS r1 FROM matches), b AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY resource_id) AS r2 FROM a WHERE r1 = 1) SELECT pattern, {_KEY} FROM b WHERE r2 <= 3")
def _(spark, sf):
    one = R.first_of(_raw(spark, sf), ["pattern", "resource_id"], ["doc_id", "position", "end", "target_id"]).drop("rn")
    return R.first_of(one, ["pattern"], ["resource_id"], 3).select("pattern", "resource_id", "doc_id", "position")


# --- sets -------------------------------------------------------------------------------------------------------------


@register("set_distinct_targets", f"{_T} SELECT count(DISTINCT target_id) AS n FROM (FROM targets UNION ALL FROM targets)")
def _(spark, sf):
    t = targets(spark)
    return t.union(t).dropDuplicates(["target_id"]).agg(F.count("*").alias("n"))


@register("set_union_hits", f"{_HITS} SELECT target_id FROM raw_hits UNION SELECT target_id FROM kept")
def _(spark, sf):
    return R.target_hits(_raw(spark, sf)).select("target_id").union(M.retain(occ(spark, sf)).select("target_id")).distinct()


@register("set_distinct_key", f"{_T} SELECT target_key, min(target_id) AS target_id FROM targets GROUP BY 1")
def _(spark, sf):
    return R.first_of(targets(spark), ["target_key"], ["target_id"]).select("target_key", "target_id")


@register("set_missing_tags", "SELECT id, array_to_string(list_filter(want, lambda t: NOT list_contains(have, t)), ',') AS missing FROM (VALUES (1, ['V', 'ind', 'sg'], ['V']), (2, ['V'], ['V', 'pl']), (3, ['V', 'opt'], ['sbjv'])) v(id, want, have)")
def _(spark, sf):
    d = spark.createDataFrame([(1, ["V", "ind", "sg"], ["V"]), (2, ["V"], ["V", "pl"]), (3, ["V", "opt"], ["sbjv"])], "id int, want array<string>, have array<string>")
    return d.select("id", F.array_join(F.array_except("want", "have"), ",").alias("missing"))


# --- rule chains ------------------------------------------------------------------------------------------------------

_BUCKET = """CASE WHEN tokens[1] = 'mos' AND tokens[2] = 'të' THEN 'negative_subjunctive_order' WHEN voice = 'middle-passive' THEN 'middle_passive'
    WHEN voice = 'active' AND mood = 'admirative' AND tense = 'present' THEN 'rare_admirative_present' WHEN mood = 'admirative' AND tense <> 'present' THEN 'rare_admirative_nonpresent'
    WHEN voice = 'active' AND mood = 'optative' AND tense = 'present' THEN 'rare_optative_present' WHEN mood = 'optative' AND tense = 'perfect' THEN 'rare_optative_perfect'
    WHEN contains(tense, 'future-perfect') THEN 'future_perfect_analytic' WHEN tense = 'past-anterior' THEN 'past_anterior' WHEN len(tokens) >= 4 THEN 'long_analytic_phrase' ELSE 'other' END"""
_SHAPE = """CASE WHEN len(tokens) <= 1 THEN 'single-token' WHEN starts_with(target_key, 'mos të ') THEN 'mos-te phrase' WHEN starts_with(target_key, 'të ') THEN 'te phrase' WHEN starts_with(target_key, 'nuk ') THEN 'nuk phrase'
    WHEN starts_with(target_key, 's ') THEN 's-negative phrase' WHEN starts_with(target_key, 'do të ') THEN 'do-te phrase' ELSE 'other multiword' END"""


@register("fn_miss_bucket", f"{_T} SELECT target_id, {_BUCKET} AS bucket FROM targets")
def _(spark, sf):
    return targets(spark).select("target_id", R.miss_bucket().alias("bucket"))


@register("fn_alternant", f"{_T} SELECT target_id, CASE WHEN tokens[1] = 'mos' AND tokens[2] = 'të' THEN array_to_string(list_concat(['të', 'mos'], tokens[3:]), ' ') END AS alternant FROM targets")
def _(spark, sf):
    return targets(spark).select("target_id", R.alternant().alias("alternant"))


@register("fn_phrase_shape", f"{_T} SELECT target_id, {_SHAPE} AS shape FROM targets")
def _(spark, sf):
    return targets(spark).select("target_id", R.phrase_shape().alias("shape"))


@register("sup_cell_key", f"{_T} SELECT target_id, concat_ws('.', mood, tense, voice, polarity, 'declarative', person, number) AS cell_key FROM targets")
def _(spark, sf):
    return targets(spark).select("target_id", R.cell_key().alias("cell_key"))


_TRACE_SQL = """CASE WHEN retained > 0 THEN 'retained_despite_coverage_miss' WHEN emitted > 0 THEN 'raw_seen_emitted_not_retained' WHEN capped > 0 THEN 'raw_seen_local_cap_dropped'
    WHEN quality > 0 OR variant > 0 THEN 'raw_seen_filtered' WHEN raw = 0 THEN 'raw_zero' ELSE 'raw_seen_unclassified' END"""
_TRACE_ROWS = ((1, 0, 5, 0, 0, 0, 5), (2, 1, 5, 0, 0, 0, 5), (3, 0, 5, 0, 2, 0, 0), (4, 0, 5, 1, 0, 0, 0), (5, 0, 0, 0, 0, 0, 0), (6, 0, 3, 0, 0, 3, 0), (7, 0, 3, 0, 0, 0, 0))


@register("fn_trace_status", f"SELECT id, {_TRACE_SQL} AS status FROM (VALUES {', '.join(map(str, _TRACE_ROWS))}) v(id, retained, raw, variant, capped, quality, emitted)")
def _(spark, sf):
    d = spark.createDataFrame(list(_TRACE_ROWS), "id int, retained int, raw_pattern_matches int, variant_rejected_matches int, local_cap_dropped_matches int, quality_rejected_matches int, emitted_matches_before_writer_cap int")
    return d.select("id", R.trace_status(F.col("retained")).alias("status"))


_LABELS = (
    (1, ("lemma_outlier", "long_exact_phrase"), "indicative.present.1sg.active", "raw_zero", "analyzer"), (2, ("middle_passive_needs_attestation",), "indicative.present.1sg.middle-passive", "raw_zero", "none"),
    (3, ("near_empty_grammatical_cell", "past_anterior"), "optative.perfect.2sg.active", "raw_zero", "none"), (4, ("x",), "optative.perfect.2sg.active", "raw_zero", "none"), (5, (), "admirative.imperfect.2sg.active", "raw_zero", "analyzer"),
    (6, ("duplicate_surface_targets", "te_mos_order_variant_probe"), "subjunctive.present.2sg.active", "raw_seen_filtered", "none"), (7, ("analyzer_accepted_exact_absence",), "indicative.aorist.3pl.active", "raw_zero", "analyzer"),
    (8, ("future_perfect_analytic",), "indicative.future-perfect.3pl.active", "raw_zero", "none"), (9, ("analyzer_accepted_head_token_absence",), "indicative.aorist.3pl.active", "raw_zero", "none"),
)
_LABELS_SQL = "(VALUES " + ", ".join(f"({i}, [{', '.join(map(repr, ls))}]::VARCHAR[], '{s}', '{t}', '{p}')" for i, ls, s, t, p in _LABELS) + ") v(id, labels, signature, trace_status, proof)"
_PRIMARY_SQL = "CASE " + " ".join(f"WHEN list_contains(labels, '{k}') THEN '{v}'" for k, v in R.PRIMARY) + " ELSE 'unexplained_exact_absence' END"


def _labels(spark):
    return spark.createDataFrame([(i, list(ls), s, t, p) for i, ls, s, t, p in _LABELS], "id int, labels array<string>, signature string, trace_status string, morphology_proof_level string").withColumn("primary", R.primary_category(F.col("labels")))


@register("fn_primary_category", f"SELECT id, {_PRIMARY_SQL} AS category FROM {_LABELS_SQL}")
def _(spark, sf):
    return _labels(spark).select("id", F.col("primary").alias("category"))


@register("fn_likely_reason", f"""SELECT id, CASE WHEN trace_status = 'raw_seen_filtered' THEN 'found-only-in-rejected-text' WHEN split_part(signature, '.', 4) = 'middle-passive' THEN 'middle-passive-attestation-needed'
    WHEN list_contains(labels, 'near_empty_grammatical_cell') THEN 'near-empty-generated-cell' WHEN list_contains(labels, 'future_perfect_analytic') THEN 'long-analytic-future-perfect' WHEN list_contains(labels, 'long_exact_phrase') THEN 'long-exact-phrase'
    WHEN split_part(signature, '.', 1) = 'admirative' AND split_part(signature, '.', 2) <> 'present' THEN 'rare-admirative-nonpresent' WHEN split_part(signature, '.', 1) = 'optative' THEN 'rare-optative-' || split_part(signature, '.', 2)
    WHEN proof = 'analyzer' THEN 'analyzer-accepted-but-unattested' ELSE {_PRIMARY_SQL} END AS reason FROM {_LABELS_SQL}""")
def _(spark, sf):
    return _labels(spark).select("id", R.likely_reason().alias("reason"))


@register("fn_analyzer_class", f"SELECT id, CASE WHEN contains(signature || '.', '.middle-passive.') THEN 'middle-passive' WHEN starts_with(signature, 'admirative.') OR starts_with(signature, 'optative.') THEN 'active rare mood: admirative/optative' WHEN list_contains(labels, 'analyzer_accepted_head_token_absence') THEN 'other multiword active' ELSE 'other single-token active' END AS class FROM {_LABELS_SQL}")
def _(spark, sf):
    return _labels(spark).select("id", R.analyzer_class(F.concat("signature", F.lit(".")), F.col("labels")).alias("class"))


_TAGS = ((1, ("med", "vt")), (2, ("vi", "vt")), (3, ("vt",)), (4, ("vi",)), (5, ("x",)), (6, ()), (7, ("husic", "uniparser")), (8, ("uniparser",)))
_TAGS_SQL = "(VALUES " + ", ".join(f"({i}, [{', '.join(map(repr, t))}]::VARCHAR[])" for i, t in _TAGS) + ") v(id, tags)"


def _tags(spark):
    return spark.createDataFrame([(i, list(t)) for i, t in _TAGS], "id int, tags array<string>")


@register("fn_lexeme_bucket", f"SELECT id, CASE WHEN list_contains(tags, 'med') THEN 'med' WHEN list_contains(tags, 'vi') AND list_contains(tags, 'vt') THEN 'vi+vt' WHEN list_contains(tags, 'vt') THEN 'vt' WHEN list_contains(tags, 'vi') THEN 'vi-only' WHEN len(tags) > 0 THEN 'other-lexeme' ELSE 'no-lexeme' END AS bucket FROM {_TAGS_SQL}")
def _(spark, sf):
    return _tags(spark).select("id", R.lexeme_bucket(F.col("tags")).alias("bucket"))


@register("fn_source_level", f"SELECT id, CASE WHEN list_contains(tags, 'husic') THEN 'husic-backed' WHEN list_contains(tags, 'uniparser') THEN 'uniparser-backed' WHEN len(tags) > 0 THEN 'lexicon-only' ELSE 'unknown-source' END AS level FROM {_TAGS_SQL}")
def _(spark, sf):
    return _tags(spark).select("id", R.source_level(F.col("tags")).alias("level"))


@register("agg_forensics", f"{_COVER}, m AS (SELECT mood, tense, voice, {_BUCKET} AS bucket, {_SHAPE} AS shape FROM cov WHERE NOT hit), u AS (UNPIVOT m ON mood, tense, voice, bucket, shape INTO NAME dimension VALUE key) SELECT dimension, key, count(*) AS n FROM u GROUP BY 1, 2")
def _(spark, sf):
    m = _cover(spark, sf).filter(~F.col("hit")).withColumn("bucket", R.miss_bucket()).withColumn("shape", R.phrase_shape())
    return R.histograms(m, "mood", "tense", "voice", "bucket", "shape")


@register("agg_primary_details", f"{_COVER}, m AS (SELECT target_id, {_BUCKET} AS bucket FROM cov WHERE NOT hit) SELECT bucket, count(*) AS n, string_agg(target_id, ',' ORDER BY target_id) FILTER (rn <= 5) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY target_id) AS rn FROM m) GROUP BY 1")
def _(spark, sf):
    m = _cover(spark, sf).filter(~F.col("hit")).withColumn("bucket", R.miss_bucket())
    few = R.first_of(m, ["bucket"], ["target_id"], 5).groupBy("bucket").agg(F.array_join(F.sort_array(F.collect_list("target_id")), ",").alias("samples"))
    return m.groupBy("bucket").agg(F.count("*").alias("n")).join(few, "bucket").select("bucket", "n", "samples")


@register("flt_trace_select", f"{_T} SELECT target_id FROM targets WHERE target_id IN ('t01', 't02') OR target_key IN ('que', 'nope')")
def _(spark, sf):
    ids, forms = spark.createDataFrame([("t01",), ("t02",)], "target_id string"), spark.createDataFrame([("que",), ("nope",)], "target_key string")
    t = targets(spark)
    return t.join(ids, "target_id", "left_semi").select("target_id").union(t.join(forms, "target_key", "left_semi").select("target_id")).distinct()


@register("flt_target_kind", f"{_T} SELECT target_id, len(tokens) = 1 AS single_token, len(tokens) > 1 AS multiword, voice = 'middle-passive' AS middle_passive, voice = 'active' AND len(tokens) = 1 AS active_single FROM targets")
def _(spark, sf):
    n = F.size("tokens")
    return targets(spark).select("target_id", (n == 1).alias("single_token"), (n > 1).alias("multiword"), (F.col("voice") == "middle-passive").alias("middle_passive"), ((F.col("voice") == "active") & (n == 1)).alias("active_single"))


@register("sup_head_token", f"{_T} SELECT target_id, tokens[-1] AS head FROM targets")
def _(spark, sf):
    return targets(spark).select("target_id", F.element_at("tokens", -1).alias("head"))


@register("sup_retained_ids", f"{_ALL} SELECT DISTINCT target_id FROM retained")
def _(spark, sf):
    return M.retain(occ(spark, sf)).select("target_id").distinct()


@register("sup_raw_zero", f"{_HITS} SELECT target_id FROM targets WHERE target_id NOT IN (FROM raw_hits) AND target_id NOT IN (FROM kept)")
def _(spark, sf):
    return targets(spark).join(R.target_hits(_raw(spark, sf)), "target_id", "left_anti").join(M.retain(occ(spark, sf)), "target_id", "left_anti").select("target_id")


@register("sup_load_search", f"{_S} SELECT {_KEY}, norm FROM sentences WHERE norm <> ''")
def _(spark, sf):
    return R.search_sentences(rows(spark, sf))


@register("lookup_blend", f"{_ALL}, b AS (SELECT target_id AS key, 'local' AS origin, 0 AS o, score, sentence AS example FROM retained UNION ALL SELECT target_id, 'parallel', 1, 55, 'p' || target_id FROM targets) SELECT key, origin, example, rn FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY o, score DESC, example) AS rn FROM b) WHERE rn <= 3")
def _(spark, sf):
    local = M.with_text(M.retain(occ(spark, sf)), rows(spark, sf)).select(F.col("target_id").alias("key"), "score", F.col("sentence").alias("example"))
    parallel = targets(spark).select(F.col("target_id").alias("key"), F.lit(55).cast("long").alias("score"), F.concat(F.lit("p"), "target_id").alias("example"))
    return R.lookup_blend(local, parallel, 3)


@register("cmd_match", f"{_ALL} SELECT target_id, match_kind, variant_kind, pattern, {_KEY}, score, array_to_string(flags, ',') AS flags FROM retained")
def _(spark, sf):
    return M.retain(occ(spark, sf)).select("target_id", "match_kind", "variant_kind", "pattern", "resource_id", "doc_id", "position", "score", F.array_join("flags", ",").alias("flags"))

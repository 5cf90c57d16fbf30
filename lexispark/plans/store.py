"""Registered queries over what is stored: examples, caches, inventories, static examples, the lexicon's files, reports."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..cluster import new_path
from ..functions import morphology as M
from ..operators import match as MA
from ..operators import reports as R
from ..operators import snapshots as SN
from ..operators import store as S
from ..registry import register
from ..sources import readers, writers
from .corpus import _ALL, _GUARD, _KEEP, _KEY, _S, _TOK, FLAGS, MATCHES, SENTENCES, TARGETS_SQL, _with, occ, patterns, raw, rows, targets
from .lexicon import VERBS, _PARADIGM, lexicon

_FRESH = "md5(resource_id)[1] < '8'"


def _marks(spark, sf, salt: str = ""):
    d = spark.read.parquet(f"{sf}/documents.parquet").groupBy(F.col("source").alias("resource_id")).agg(F.count("*").alias("n"), F.sum("doc_id").alias("s"))
    return d.filter("resource_id IS NOT NULL").select("resource_id", F.md5(F.concat_ws("|", "resource_id", F.col("n").cast("string"), F.col("s").cast("string"), F.lit(salt))).alias("fingerprint"))


def _changed(marks):
    """The same with other fingerprints for some resources."""
    return marks.withColumn("fingerprint", F.when(F.substring(F.md5("resource_id"), 1, 1) < "8", F.col("fingerprint")).otherwise("other"))


def _known(spark, sf):
    return rows(spark, sf).filter("resource_id IS NOT NULL")


@register("sink_examples", f"{_ALL} SELECT 'occurrences' AS name, count(*) AS n FROM occ UNION ALL SELECT 'targets', count(*) FROM targets UNION ALL SELECT 'resources', count(DISTINCT resource_id) FROM sentences WHERE resource_id IS NOT NULL")
def _(spark, sf):
    path, o = new_path(spark, "examples"), occ(spark, sf)
    resources = _known(spark, sf).select("resource_id").distinct()
    half = F.col("target_id") < "t10"
    S.write_examples(path, resources, targets(spark).filter(half), o.filter(half))
    S.write_examples(path, resources, targets(spark), o, append=True)  # what is there stays, the rest comes in
    found = SN.snapshot(spark, path)
    read = lambda name: found.read(spark, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return read("occurrences").unionByName(read("targets")).unionByName(read("resources"))


@register("sink_commit_batch", f"{_ALL} SELECT count(*) AS first, 0 AS again, count(*) AS rows FROM retained")
def _(spark, sf):
    path, kept = new_path(spark, "batch"), MA.retain(occ(spark, sf)).select("target_id", *MA.KEY, "score")
    first, again = S.append_new(kept, path, ["target_id", *MA.KEY]), S.append_new(kept, path, ["target_id", *MA.KEY])
    return spark.read.parquet(path).agg(F.lit(first).alias("first"), F.lit(again).alias("again"), F.count("*").alias("rows"))


def _cached(spark, sf):
    path = new_path(spark, "cache")
    S.write_cache(path, _known(spark, sf), _changed(_marks(spark, sf)))
    return path


@register("sink_cache", f"{_S}, t AS (SELECT DISTINCT resource_id, unnest({_TOK}) AS token FROM sentences WHERE resource_id IS NOT NULL), k AS (SELECT resource_id, count(*) AS tokens FROM t GROUP BY 1) SELECT resource_id, count(*) AS sentences, any_value(tokens) AS tokens FROM sentences JOIN k USING (resource_id) GROUP BY 1")
def _(spark, sf):
    found = SN.snapshot(spark, _cached(spark, sf))
    tokens = found.read(spark, "tokens").groupBy("resource_id").agg(F.count("*").alias("tokens"))
    return found.read(spark, "rows").groupBy("resource_id").agg(F.count("*").alias("sentences")).join(tokens, "resource_id")


@register("cmd_build_cache", f"{_S} SELECT count(*) AS sentences, count(DISTINCT resource_id) AS resources, sum(length(norm))::BIGINT AS chars FROM sentences WHERE resource_id IS NOT NULL")
def _(spark, sf):
    return SN.snapshot(spark, _cached(spark, sf)).read(spark, "rows").agg(F.count("*").alias("sentences"), F.countDistinct("resource_id").alias("resources"), F.sum(F.char_length("norm")).alias("chars"))


@register("rd_cache", f"{_S} SELECT resource_id, count(*) AS n, NOT ({_FRESH}) AS from_raw FROM sentences WHERE resource_id IS NOT NULL GROUP BY 1")
def _(spark, sf):
    raw_rows = _known(spark, sf).withColumn("quality", F.lit("raw"))
    found = S.read_cache(_cached(spark, sf), _marks(spark, sf), raw_rows)
    return found.groupBy("resource_id").agg(F.count("*").alias("n"), F.bool_and(F.coalesce(F.col("quality") == "raw", F.lit(False))).alias("from_raw"))


@register("sup_fingerprint", f"SELECT source AS resource_id, CASE WHEN {_FRESH.replace('resource_id', 'source')} THEN 'fresh' ELSE 'stale' END AS state FROM documents WHERE source IS NOT NULL GROUP BY 1 UNION ALL SELECT 'new', 'missing'")
def _(spark, sf):
    new = spark.createDataFrame([("new", "x")], "resource_id string, fingerprint string")
    return S.freshness(_cached(spark, sf), _marks(spark, sf).unionByName(new))


@register("sup_ensure_hits", f"{_with(SENTENCES, TARGETS_SQL, MATCHES)} SELECT DISTINCT resource_id, target_id FROM matches WHERE resource_id IS NOT NULL")
def _(spark, sf):
    path, matches = new_path(spark, "hits"), raw(spark, sf).filter("resource_id IS NOT NULL")
    S.ensure_hits(path, _changed(_marks(spark, sf)), matches)
    anew = S.ensure_hits(path, _marks(spark, sf), matches)  # only what has changed
    if S.ensure_hits(path, _marks(spark, sf), matches) or not anew:
        raise AssertionError("fresh hits were written again")
    return SN.snapshot(spark, path).read(spark, "hits").select("resource_id", "target_id")


@register("sup_anchor_stream", f"{_with(SENTENCES, TARGETS_SQL)} SELECT resource_id, count(*) AS n FROM sentences WHERE len(list_intersect({_TOK}, (SELECT list(DISTINCT t) FROM (SELECT unnest(string_split(pattern, ' ')) AS t FROM patterns)))) > 0 GROUP BY 1")
def _(spark, sf):
    wanted = patterns(spark).select(F.explode(F.split("pattern", " ")).alias("t")).distinct()
    path = new_path(spark, "anchored")
    hit = rows(spark, sf).select("resource_id", "doc_id", "position", F.explode(F.array_distinct(F.split("norm", " "))).alias("t")).join(wanted, "t", "left_semi").select(*MA.KEY).distinct()
    hit.write.parquet(path)  # the subset is kept for the next scan
    return spark.read.parquet(path).groupBy("resource_id").agg(F.count("*").alias("n"))


@register("sup_scan_partition", f"{_ALL} SELECT target_id, count(*) AS occurrences, count(*) FILTER (keep) AS kept FROM occ WHERE resource_id = (SELECT min(resource_id) FROM sentences) GROUP BY 1")
def _(spark, sf):
    one = rows(spark, sf).agg(F.min("resource_id")).first()[0]
    found = MA.occurrences(rows(spark, sf).filter(F.col("resource_id") == one), patterns(spark))
    return found.groupBy("target_id").agg(F.count("*").alias("occurrences"), F.count_if("keep").alias("kept"))


_TRACED = f"{_with(SENTENCES, TARGETS_SQL, MATCHES)}, k AS (SELECT *, {_GUARD} AS guarded, {FLAGS} AS flags FROM matches), tr AS (SELECT *, {_KEEP} AS keep FROM k)"


@register("sup_trace_partition", f"{_TRACED} SELECT target_id, resource_id, count(*) AS raw, count(*) FILTER (guarded AND keep) AS passed FROM tr GROUP BY 1, 2")
def _(spark, sf):
    from ..functions import text as T

    r = rows(spark, sf).select("resource_id", "norm", MA.apostrophe_guard(F.lit("s_negative"), F.col("sentence")).alias("has_s"), T.keep_sentence(T.quality_flags(F.col("sentence"), F.col("norm"), F.col("quality"))).alias("keep"))
    m = MA.phrase_match(r, patterns(spark)).withColumn("guarded", (F.col("variant_kind") != "s_negative") | F.col("has_s"))
    return m.groupBy("target_id", "resource_id").agg(F.count("*").alias("raw"), F.count_if(F.col("guarded") & F.col("keep")).alias("passed"))


@register("cmd_trace", f"{_TRACED} SELECT target_id, count(*) AS raw_pattern_matches, count(*) FILTER (NOT guarded) AS variant_rejected_matches FROM tr WHERE target_id IN ('t01', 't05', 't17') GROUP BY 1")
def _(spark, sf):
    chosen = MA.target_patterns(targets(spark).filter(F.col("target_id").isin("t01", "t05", "t17")))
    return MA.trace(rows(spark, sf), chosen).select("target_id", "raw_pattern_matches", "variant_rejected_matches")


@register("sup_retained_samples", f"{_ALL} SELECT target_id, rank, sentence FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, doc_id, position, resource_id) AS k FROM retained) WHERE k <= 2")
def _(spark, sf):
    few = R.first_of(MA.retain(occ(spark, sf)), ["target_id"], [F.desc("score"), "doc_id", "position", "resource_id"], 2)
    return MA.with_text(few, rows(spark, sf)).select("target_id", "rank", "sentence")


@register("sup_safe_id", "SELECT DISTINCT source AS resource_id, regexp_replace(source, '[^A-Za-z0-9._-]', '_', 'g') || '_' || substr(md5(source), 1, 16) AS safe FROM documents WHERE source IS NOT NULL UNION ALL SELECT 'a/b#ç', 'a_b___' || substr(md5('a/b#ç'), 1, 16)")
def _(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("source").alias("resource_id")).filter("resource_id IS NOT NULL").distinct()
    return d.unionByName(spark.createDataFrame([("a/b#ç",)], "resource_id string")).select("resource_id", S.safe_id(F.col("resource_id")).alias("safe"))


_STATIC = f"{_ALL}, ex AS (SELECT verb_id, target_key, signature, row_number() OVER (PARTITION BY verb_id, target_key, signature ORDER BY score DESC, length(sentence), {_KEY}) AS nth, {_KEY}, score FROM retained JOIN (SELECT target_id, verb_id, target_key, signature FROM targets) USING (target_id))"


@register("sink_static_examples", f"{_STATIC} SELECT verb_id, count(*) AS examples, count(DISTINCT target_key) AS keys FROM ex WHERE nth <= 3 GROUP BY 1")
def _(spark, sf):
    path = new_path(spark, "static")
    S.static_examples(MA.retain(occ(spark, sf)), targets(spark)).write.partitionBy("verb_id").parquet(path)
    return spark.read.parquet(path).groupBy("verb_id").agg(F.count("*").alias("examples"), F.countDistinct("target_key").alias("keys"))


@register("lookup_static", f"""{_STATIC}, w AS (SELECT * FROM (VALUES ('the', 'indicative.present.1sg.active.affirmative.declarative'), ('the', 'none'), ('que', NULL)) v(target_key, wanted)),
    f AS (SELECT w.target_key, wanted, signature, nth, {_KEY}, coalesce(wanted = signature, false) AS own FROM w JOIN ex USING (target_key) WHERE nth <= 3), g AS (SELECT *, bool_or(own) OVER (PARTITION BY target_key, wanted) AS any_own FROM f)
    SELECT target_key, wanted, signature, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY target_key, wanted ORDER BY signature, nth, {_KEY}) AS rank FROM g WHERE own OR NOT any_own) WHERE rank <= 5""")
def _(spark, sf):
    wanted = spark.createDataFrame([("the", "indicative.present.1sg.active.affirmative.declarative"), ("the", "none"), ("que", None)], "target_key string, signature string")
    return S.lookup_static(S.static_examples(MA.retain(occ(spark, sf)), targets(spark)), wanted).select("target_key", "wanted", "signature", "doc_id", "rank")


@register("sup_parallel_api", "SELECT 'parallel-' || doc_id AS id, 55 AS score, substr(text, 1, 40) AS sentence, 'parallel' AS source_type FROM documents WHERE text IS NOT NULL")
def _(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").filter("text IS NOT NULL")
    return d.select(F.concat(F.lit("parallel-"), F.col("doc_id").cast("string")).alias("id"), F.lit(55).alias("score"), F.substring("text", 1, 40).alias("sentence"), F.lit("parallel").alias("source_type"))


@register("flt_example_source", f"{_ALL}, e AS (SELECT target_id, 'local' AS kind FROM retained UNION ALL SELECT target_id, 'translated' FROM targets) SELECT f.facet, count(*) AS n FROM e, (VALUES ('all'), ('local'), ('translated')) f(facet) WHERE facet = 'all' OR facet = kind GROUP BY 1")
def _(spark, sf):
    e = MA.retain(occ(spark, sf)).select(F.lit("local").alias("kind")).unionByName(targets(spark).select(F.lit("translated").alias("kind")))
    return e.select(F.explode(F.array(F.lit("all"), F.col("kind"))).alias("facet")).groupBy("facet").agg(F.count("*").alias("n"))


@register("flt_public_example", f"{_ALL} SELECT target_id, {_KEY} FROM retained WHERE NOT (array_to_string(flags, ',') ILIKE '%reference%' OR array_to_string(flags, ',') ILIKE '%spam%' OR sentence ILIKE '%http%' OR length(sentence) > 260)")
def _(spark, sf):
    flags = F.array_join("flags", ",")
    kept = MA.with_text(MA.retain(occ(spark, sf)), rows(spark, sf))
    return kept.filter(~(flags.ilike("%reference%") | flags.ilike("%spam%") | F.col("sentence").ilike("%http%") | (F.char_length("sentence") > 260))).select("target_id", *MA.KEY)


@register("cmd_checksums", "SELECT n_nationkey || '.txt' AS name, CASE n_nationkey % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'mismatch' WHEN 2 THEN 'unlisted' ELSE 'match' END AS state FROM nation")
def _(spark, sf):
    path = new_path(spark, "sums")
    n = spark.read.parquet(f"{sf}/nation.parquet").select(F.concat(F.col("n_nationkey").cast("string"), F.lit(".txt")).alias("name"), F.col("n_name").alias("body"), (F.col("n_nationkey") % 4).alias("k"))
    fs, folder = writers.filesystem(path)
    fs.create_dir(folder, recursive=True)
    for r in n.filter("k <> 0").collect():
        with fs.open_output_stream(f"{folder}/{r['name']}", compression=None) as out:
            out.write(r["body"].encode())
    manifest = n.filter("k <> 2").select("name", F.sha2(F.when(F.col("k") == 1, "other").otherwise(F.col("body")), 256).alias("sha256"))
    return S.checksums(spark, path, manifest)


def _entry(c: str) -> str:
    """A field of a lexicon's JSON file."""
    return {"translation_en": "translationEn", "verb_id": "id"}.get(c, c)


def _lexicon_files(spark, sf, broken: bool) -> str:
    """The lexicon as JSON files, a file for each entry that tasks write, and some that break a rule each."""
    path = new_path(spark, "lexicon")
    # overrides "key/cell" as a map of maps
    pairs = F.transform(F.map_entries("overrides"), lambda e: F.struct(F.split_part(e["key"], F.lit("/"), F.lit(1)).alias("key"), F.split_part(e["key"], F.lit("/"), F.lit(2)).alias("cell"), e["value"].alias("form")))
    of = lambda k: F.map_from_entries(F.transform(F.filter(pairs, lambda p: p["key"] == k), lambda p: F.struct(p["cell"], p["form"])))
    cells = F.map_from_entries(F.transform(F.array_distinct(F.transform(pairs, lambda p: p["key"])), lambda k: F.struct(k, of(k))))
    flags = {"isSuppletive": "is_suppletive", "noMiddlePassive": "no_middle_passive", "thirdPersonOnly": "third_person_only", "middlePassiveThirdPersonOnly": "mp_third_person_only"}
    body = F.struct(
        *(F.col(c).alias(_entry(c)) for c in ("verb_id", "lemma", "translation_en", "class", "auxiliary")), F.struct("present", "aorist", "participle").alias("principalParts"),
        F.array(F.struct(F.lit("manual").alias("source"), F.lit("r").alias("reference"))).alias("sources"), F.struct(*(F.col(c).alias(n) for n, c in flags.items())).alias("flags"), F.when(F.size("overrides") > 0, cells).alias("cellOverrides"),
    )
    found = lexicon(spark, sf).select(F.concat("verb_id", F.lit(".json")).alias("name"), F.to_json(body).alias("data"))
    if broken:
        good = json.loads(found.filter("name = 'hap.json'").first()["data"])
        wrong = {"a1.json": good | {"id": "other"}, "b1.json": good | {"id": "b1", "class": 4, "lemma": "b"}, "c1.json": good | {"id": "c1", "lemma": "c", "sources": []}, "d1.json": good | {"id": "d1", "lemma": "punoj"}, "e1.json": good | {"id": "e1", "lemma": "", "auxiliary": "x"}}
        wrong["f1.json"] = good | {"id": "f1", "lemma": "f", "cellOverrides": {"indicative.present": {"9sg": "x"}}, "principalParts": {"present": "", "aorist": "a", "participle": "p"}}
        found = found.unionByName(spark.createDataFrame([(n, json.dumps(e, ensure_ascii=False)) for n, e in wrong.items()], "name string, data string"))
        # every eighth derived entry by digest lacks its sources
        lacks = (F.substring(F.md5("name"), 1, 1) < "2") & ~F.col("name").isin(*(f"{v[0]}.json" for v in VERBS), *wrong)
        found = found.withColumn("data", F.when(lacks, F.replace("data", F.lit('[{"source":"manual","reference":"r"}]'), F.lit("[]"))).otherwise(F.col("data")))
    writers.write_named(found.select("name", F.encode("data", "UTF-8").alias("data")), path)
    return path


@register("rd_lexicon", f"WITH {_PARADIGM} SELECT verb_id, lemma, translation_en, class, auxiliary, present, aorist, participle, is_suppletive, coalesce(overrides['imperative.present/2sg'], '') AS one_override FROM lexicon")
def _(spark, sf):
    found = readers.as_lexicon(readers.read_lexicon(spark, _lexicon_files(spark, sf, False)))
    return found.select("verb_id", "lemma", "translation_en", "class", "auxiliary", "present", "aorist", "participle", "is_suppletive", F.coalesce(F.try_element_at("overrides", F.lit("imperative.present/2sg")), F.lit("")).alias("one_override"))


@register("mor_validate", f"WITH {_PARADIGM} SELECT w || '.json' AS file, 'sources' AS errors FROM lexicon_words WHERE md5(w || '.json')[1] < '2' UNION ALL SELECT * FROM (VALUES ('a1.json', 'duplicate lemma,file name'), ('b1.json', 'class'), ('c1.json', 'sources'), ('d1.json', 'duplicate lemma'), ('e1.json', 'auxiliary,lemma'), ('f1.json', 'cells,principal parts'), ('hap.json', 'duplicate lemma'), ('punoj.json', 'duplicate lemma')) v(file, errors)")
def _(spark, sf):
    found = readers.read_lexicon(spark, _lexicon_files(spark, sf, True))
    return found.filter(F.size("errors") > 0).select("file", F.array_join(F.sort_array("errors"), ",").alias("errors"))


@register("cmd_lexicon_build", f"WITH {_PARADIGM} SELECT verb_id, count(*) AS cells, count(form) AS forms, md5(string_agg(form, '|' ORDER BY form)) AS digest FROM forms WHERE modality = 'declarative' OR modality IS NULL GROUP BY 1")
def _(spark, sf):
    built = readers.as_lexicon(readers.read_lexicon(spark, _lexicon_files(spark, sf, False)))
    forms = M.conjugate(built, ("affirmative", "negative"))
    return forms.groupBy("verb_id").agg(F.count("*").alias("cells"), F.count("form").alias("forms"), F.md5(F.array_join(F.sort_array(F.collect_list("form")), "|")).alias("digest"))


@register("sink_lexicon_index", f"WITH {_PARADIGM} SELECT verb_id AS id, lemma, translation_en, class, row_number() OVER (ORDER BY lemma) AS line FROM lexicon")
def _(spark, sf):
    path = new_path(spark, "index")
    lexicon(spark, sf).select(F.col("verb_id").alias("id"), "lemma", "translation_en", "class").repartition(1).sortWithinPartitions("lemma").write.json(path)
    lines = readers.numbered_lines(spark.read.text(path))
    return lines.select(F.from_json("value", "id string, lemma string, translation_en string, class int").alias("e"), "line").select("e.*", "line")


@register("sink_report", f"{_ALL}, c AS (SELECT variant_kind, count(*) AS n FROM occ GROUP BY 1), l AS (SELECT 5 + row_number() OVER (ORDER BY variant_kind) - 1 AS line, '| ' || variant_kind || ' | ' || n || ' |' AS text FROM c) SELECT * FROM l UNION ALL SELECT * FROM (VALUES (1, '# Variants'), (2, ''), (3, '| variant_kind | n |'), (4, '|---|---|')) v(line, text)")
def _(spark, sf):
    text = S.markdown(occ(spark, sf).groupBy("variant_kind").agg(F.count("*").alias("n")).orderBy("variant_kind"), "Variants")
    return spark.createDataFrame(list(enumerate(text.rstrip("\n").split("\n"), 1)), "line long, text string")

"""Registered queries that put whole reports together."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..cluster import new_path
from ..functions import morphology as M
from ..functions import phonology
from ..functions import text as T
from ..operators import audit as A
from ..operators import commands as C
from ..operators import lookups as L
from ..operators import match as MA
from ..operators import reports as R
from ..registry import register
from ..sources import writers
from . import audit as PA
from .audit import _ANALYSES_SQL, _STATS, _STATUS, _VERDICT, _VOICED, _W, LEAST, _labels
from .corpus import _ALL, _ANCHOR, _KEY, _S, _STRESS, _TOK, MATCHES, SENTENCES, _with, occ, rows
from .corpus import targets as phrase_targets
from .lexicon import _PARADIGM, forms, lexicon


@register("fn_cell_label", f"WITH {_PARADIGM} SELECT verb_id, mood, tense, cell, regexp_extract(concat_ws('.', mood, tense, cell, voice), '\\.([123](sg|pl))\\.', 1) AS parsed FROM forms WHERE modality = 'declarative'")
def _(spark, sf):
    f = forms(spark, sf).filter("modality = 'declarative'")
    return f.select("verb_id", "mood", "tense", "cell", F.regexp_extract(M.signature(), r"\.([123](?:sg|pl))\.", 1).alias("parsed"))


@register("fn_pct", "SELECT o_orderpriority, round(100.0 * count(*) FILTER (o_totalprice > 150000) / count(*), 1) AS pct FROM orders GROUP BY 1")
def _(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").groupBy("o_orderpriority").agg(F.count_if(F.col("o_totalprice") > 150000).alias("a"), F.count("*").alias("b"))
    return o.select("o_orderpriority", F.round(100 * T.percent(F.col("a"), F.col("b")), 1).alias("pct"))


_WORDS = (("punoj", 1, 2), ("djeg", 0, 1), ("lexoj", 1, 2), ("punova", 1, 3), ("hapi", 0, 2), ("është", 1, 2))


@register("fn_stress", "SELECT * FROM (VALUES " + ", ".join(f"('{w}', {k})" for w, k, _ in _WORDS[:-1]) + ") v(word, syllable)")
def _(spark, sf):
    d = spark.createDataFrame([(w,) for w, *_ in _WORDS[:-1]], "word string")
    return phonology.pronounce(d, "word").select("word", _syllable(F.col("ipa"), F.col("syllables")).alias("syllable"))


def _syllable(ipa, syllables):
    """Number of the stressed syllable: that of the first, of as many, whose vowels before the mark are as many as its number."""
    before = F.split(ipa, "ˈ")[0]
    return F.least(F.regexp_count(before, F.lit("[aeiouyɛəɔ]")), F.size(F.split(syllables, r"\.")) - 1)


@register("fn_stress_audit", "SELECT * FROM (VALUES " + ", ".join(f"('{w}', {k}, {str(w != 'është').lower()})" for w, k, _ in _WORDS) + ") v(word, expected, agrees)")
def _(spark, sf):
    d = spark.createDataFrame([(w, k) for w, k, _ in _WORDS], "word string, expected int")
    said = phonology.pronounce(d, "word")
    return said.select("word", "expected", (_syllable(F.col("ipa"), F.col("syllables")) == F.col("expected")).alias("agrees"))


@register("sup_trace_keys", f"WITH {_PARADIGM} SELECT DISTINCT mood, tense, rule, aux_tense FROM grid WHERE voice = 'active'")
def _(spark, sf):
    return M.grid(spark).filter("voice = 'active'").select("mood", "tense", "rule", "aux_tense").distinct()


@register("mor_trace", f"""WITH {_PARADIGM}, w AS (SELECT c.*, m.modality, n.polarity FROM cells c, (VALUES ('declarative'), ('interrogative')) m(modality), (VALUES ('affirmative'), ('negative')) n(polarity) WHERE mood <> 'non-finite' AND mood <> 'imperative' AND c.voice = 'active')
    SELECT verb_id, mood, tense, cell, polarity, modality, CASE WHEN whole IS NOT NULL AND polarity = 'affirmative' AND modality = 'declarative' THEN 'corpus-lookup>cell-override' ELSE 'corpus-lookup>' ||
        CASE WHEN aux_tense IS NOT NULL THEN 'auxiliary-recursion' WHEN own IS NOT NULL THEN 'cell-override' WHEN is_suppletive AND supp IS NOT NULL THEN 'suppletive-lookup' ELSE 'paradigm-rule' END || CASE WHEN prefix <> '' THEN '>particle-prepend' ELSE '' END
        || CASE WHEN polarity = 'negative' THEN CASE WHEN mood = 'subjunctive' THEN '>particle-insert' ELSE '>particle-prepend' END ELSE '' END || CASE WHEN modality = 'interrogative' THEN '>particle-prepend' ELSE '' END END || '>final' AS steps FROM w""")
def _(spark, sf):
    lex = lexicon(spark, sf).select("verb_id", "is_suppletive", "overrides")
    supp = F.broadcast(spark.createDataFrame(M.suppletive_rows(), "verb_id string, rule string, cell string, supp string"))
    cells = lex.join(F.broadcast(M.grid(spark).filter("voice = 'active' AND mood NOT IN ('non-finite', 'imperative')")), F.lit(True)).join(supp, ["verb_id", "rule", "cell"], "left")
    ways = F.explode(F.array(*(F.struct(F.lit(p).alias("polarity"), F.lit(m).alias("modality")) for p in ("affirmative", "negative") for m in ("declarative", "interrogative"))))
    cells = cells.withColumn("way", ways).select("*", "way.*")
    at = lambda key: F.try_element_at("overrides", F.concat(key, F.lit("/"), F.col("cell")))
    keys = F.create_map(*(F.lit(x) for kv in M.RULE_KEYS.items() for x in kv))
    whole = at(F.concat_ws(".", "mood", "tense")).isNotNull() & (F.col("polarity") == "affirmative") & (F.col("modality") == "declarative")
    own = F.col("rule").isNotNull() & at(F.try_element_at(keys, F.col("rule"))).isNotNull()
    how = F.when(F.col("aux_tense").isNotNull(), "auxiliary-recursion").when(own, "cell-override").when(F.col("is_suppletive") & F.col("supp").isNotNull(), "suppletive-lookup").otherwise("paradigm-rule")
    steps = F.filter(F.array(
        F.lit("corpus-lookup"), F.when(whole, "cell-override").otherwise(how), F.when(~whole & (F.col("prefix") != ""), "particle-prepend"),
        F.when(F.col("polarity") == "negative", F.when(F.col("mood") == "subjunctive", "particle-insert").otherwise("particle-prepend")), F.when(F.col("modality") == "interrogative", "particle-prepend"), F.lit("final"),
    ), lambda s: s.isNotNull())
    return cells.select("verb_id", "mood", "tense", "cell", "polarity", "modality", F.array_join(steps, ">").alias("steps"))


def _misses(spark, sf):
    return PA.misses(spark, sf).withColumn("labels", A.label_miss(True, LEAST))


_MISS = f"{_W}, {_STATS}, mi AS (SELECT *, {_labels(True)} AS labels FROM st WHERE NOT hit)"


@register("cmd_audit", f"{_MISS}, u AS (SELECT \"primary\", unnest(labels) AS label FROM mi) SELECT \"primary\", label, count(*) AS n FROM u GROUP BY 1, 2")
def _(spark, sf):
    return _misses(spark, sf).select("primary", F.explode("labels").alias("label")).groupBy("primary", "label").agg(F.count("*").alias("n"))


@register("cmd_morph_audit", f"{_W}, {_VOICED}, {_VERDICT} SELECT verb_id, voice, count(*) AS targets, count(*) FILTER (proof = 'analyzer') AS by_analyzer, count(*) FILTER (verdict_action <> 'none') AS to_review FROM ve GROUP BY 1, 2")
def _(spark, sf):
    return PA._verdicts(spark, sf).groupBy("verb_id", "voice").agg(F.count("*").alias("targets"), F.count_if(F.col("proof") == "analyzer").alias("by_analyzer"), F.count_if(F.col("verdict_action") != "none").alias("to_review"))


@register("cmd_analyzer_requests", f"{_W}, m AS (SELECT tokens[-1] AS h1 FROM aud WHERE NOT hit), u AS (SELECT 'strict' AS mode, h1 AS token FROM m UNION ALL SELECT 'no_diacritics', translate(h1, 'ëç', 'ec') FROM m WHERE translate(h1, 'ëç', 'ec') <> h1) SELECT mode, token, count(*) AS targets FROM u GROUP BY 1, 2")
def _(spark, sf):
    return C.analyzer_requests(PA.targets(spark, sf).filter("NOT hit"))


@register("cmd_forensics", f"{_MISS}, f AS (SELECT mood, tense, voice, trace_status, \"primary\", CASE WHEN len(tokens) = 1 THEN 'token' ELSE 'phrase' END AS scope FROM mi), u AS (UNPIVOT f ON mood, tense, voice, trace_status, \"primary\", scope INTO NAME dimension VALUE key) SELECT dimension, key, count(*) AS n FROM u GROUP BY 1, 2")
def _(spark, sf):
    return R.histograms(_misses(spark, sf).withColumn("scope", F.when(F.size("tokens") == 1, "token").otherwise("phrase")), "mood", "tense", "voice", "trace_status", "primary", "scope")


_RULES = (("analyzer accepted", "analyzer_accepted_exact_absence", 24, 2), ("component valid", "component_morphology_only_exact_absence", 12, 3), ("near empty", "near_empty_grammatical_cell", 24, 1))


def _dossier_rules():
    return [(reason, F.array_contains("labels", label), total, "verb_id", each) for reason, label, total, each in _RULES]


_DOSSIER = ", ".join(
    f"d{k} AS (SELECT target_id, {k} AS o, '{reason}' AS reason FROM (SELECT *, row_number() OVER (PARTITION BY verb_id ORDER BY target_key, target_id) AS nth FROM mi WHERE list_contains(labels, '{label}')) WHERE nth <= {each} ORDER BY target_key, target_id LIMIT {total})"
    for k, (reason, label, total, each) in enumerate(_RULES)
) + ", ds AS (SELECT target_id, string_agg(reason, ',' ORDER BY o) AS reasons FROM (FROM d0 UNION ALL FROM d1 UNION ALL FROM d2) GROUP BY 1)"


@register("sample_dossier", f"{_MISS}, {_DOSSIER} SELECT * FROM ds")
def _(spark, sf):
    return C.sample_dossier(_misses(spark, sf), _dossier_rules()).select("target_id", F.array_join("reasons", ",").alias("reasons"))


@register("prj_dossier", f"{_MISS}, {_DOSSIER} SELECT target_id, reasons, lemma, target_key, round(cell_hit / cell_total, 4) AS cell_rate, round(lemma_hit / lemma_total, 4) AS lemma_rate, form AS verdict, trace_status FROM ds JOIN mi USING (target_id)")
def _(spark, sf):
    m = _misses(spark, sf)
    taken = C.sample_dossier(m, _dossier_rules())
    rate = lambda n: F.round(F.col(f"{n}_hit") / F.col(f"{n}_total"), 4).alias(f"{n}_rate")
    return m.join(F.broadcast(taken), "target_id").select("target_id", F.array_join("reasons", ",").alias("reasons"), "lemma", "target_key", rate("cell"), rate("lemma"), F.col("form").alias("verdict"), "trace_status")


_STRESS_PLAN = _STRESS + "," + SENTENCES + f", an AS (SELECT *, {_ANCHOR} AS anchor FROM stress), inv AS (SELECT DISTINCT resource_id, unnest({_TOK}) AS token FROM sentences)"


@register("sup_stress_plan", f"{_STRESS_PLAN} SELECT count(DISTINCT target_id) AS targets, count(*) AS patterns, count(DISTINCT anchor) AS anchors, (SELECT count(DISTINCT resource_id) FROM inv WHERE token IN (SELECT anchor FROM an)) AS partitions, (SELECT count(DISTINCT token) FROM inv WHERE token IN (SELECT anchor FROM an)) AS anchors_found, (SELECT count(*) FROM targets) AS candidates FROM an")
def _(spark, sf):
    t = phrase_targets(spark)
    return C.stress_plan(t, MA.stress_patterns(t), R.token_inventory(rows(spark, sf)))


_STRESS_HITS = _STRESS + "," + SENTENCES + "," + MATCHES.replace("patterns", "stress")


def _stress_hits(spark, sf):
    t = phrase_targets(spark)
    p = MA.stress_patterns(t).drop("anchor")
    return t, p, MA.phrase_match(rows(spark, sf), p)


@register("cmd_stress", f"{_STRESS_HITS} SELECT target_id, kind, pattern, count(*) AS matches, count(DISTINCT resource_id) AS resources FROM matches GROUP BY 1, 2, 3")
def _(spark, sf):
    return _stress_hits(spark, sf)[2].groupBy("target_id", "kind", "pattern").agg(F.count("*").alias("matches"), F.countDistinct("resource_id").alias("resources"))


@register("sup_stress_build_report", f"{_STRESS_HITS}, h AS (SELECT target_id, count(*) AS matches FROM matches GROUP BY 1), p AS (SELECT target_id, count(*) AS patterns FROM stress GROUP BY 1) SELECT t.target_id, t.lemma, t.target_key, patterns, coalesce(matches, 0) AS matches FROM targets t JOIN p USING (target_id) LEFT JOIN h USING (target_id)")
def _(spark, sf):
    t, p, hits = _stress_hits(spark, sf)
    found = p.groupBy("target_id").agg(F.count("*").alias("patterns")).join(hits.groupBy("target_id").agg(F.count("*").alias("matches")), "target_id", "left")
    return t.select("target_id", "lemma", "target_key").join(found, "target_id").withColumn("matches", F.coalesce("matches", F.lit(0)))


_CHUNKS = ((0, 5, 7, "1"), (1, 4, 2, "1"), (1, 4, 2, "1"), (3, 9, 1, "2"), (7, 1, 1, "1"))


@register("cmd_chunk_aggregate", "SELECT 14 AS targets, 8 AS matches, 2 AS valid, '2,4' AS missing, '1' AS repeated, '7' AS foreign, 2 AS versions")
def _(spark, sf):
    return C.chunk_summary(spark.createDataFrame(list(_CHUNKS), "chunk int, targets long, matches long, version string"), 5)


_CHECKED = f"WITH {_PARADIGM}, v AS (SELECT *, md5(concat_ws(':', verb_id, mood, tense, cell, voice)) AS h FROM forms WHERE polarity = 'affirmative' AND modality = 'declarative'), ck AS (SELECT *, CASE WHEN form IS NULL THEN 'error' WHEN h[1] < '3' THEN 'missing' WHEN h[1] < '5' THEN 'mismatch' ELSE 'match' END AS status, CASE WHEN form IS NOT NULL AND h[1] >= '3' THEN CASE WHEN h[2] < '8' THEN 'first' ELSE 'second' END END AS match_source FROM v)"


@register("cmd_verify", f"{_CHECKED} SELECT verb_id, status, match_source, count(*) AS n FROM ck GROUP BY 1, 2, 3")
def _(spark, sf):
    from ..operators import lookups as L

    f = forms(spark, sf).filter("polarity = 'affirmative' AND modality = 'declarative'").withColumn("key", F.concat_ws(":", "verb_id", "mood", "tense", "cell", "voice")).withColumn("h", F.md5("key"))
    known = f.filter("form IS NOT NULL AND substring(h, 1, 1) >= '3'").select("key", F.when(F.substring("h", 1, 1) < "5", F.concat("form", F.lit("x"))).otherwise(F.col("form")).alias("ref"), "h")
    first, second = known.filter("substring(h, 2, 1) < '8'").select("key", "ref"), known.filter("substring(h, 2, 1) >= '8'").select("key", "ref")
    checked = L.source_priority(f.select("key", "form"), first, second)
    return checked.withColumn("verb_id", F.substring_index("key", ":", 1)).groupBy("verb_id", "status", "match_source").agg(F.count("*").alias("n"))


def _verdict_rows(spark, sf):
    t = PA.targets(spark, sf)
    version = F.when(PA._digit(14, "2"), "0").otherwise("1")
    named = F.when(PA._digit(14, "4") & ~PA._digit(14, "2"), F.concat(F.lit("no:"), "target_id")).otherwise(F.col("target_id"))
    key = F.when(PA._digit(14, "6") & ~PA._digit(14, "4"), "other").otherwise(F.col("target_key"))
    v = t.select(named.alias("target_id"), key.alias("target_key"), version.alias("version"), F.coalesce("form", F.lit("none")).alias("form"))
    return t, v.unionByName(v.filter(F.col("form") == "none").withColumn("form", F.lit("zz")))


@register("sup_morph_evidence", f"""{_W}, v AS (SELECT target_id, h[14] AS d, coalesce(form, 'none') AS f FROM aud), n AS (SELECT d, f, CASE WHEN f = 'none' THEN 2 ELSE 1 END AS copies FROM v)
    SELECT CASE WHEN d < '2' THEN 'stale' WHEN d < '4' THEN 'unknown target' WHEN d < '6' THEN 'other key' ELSE 'valid' END AS why, sum(CASE WHEN d >= '6' THEN 1 ELSE copies END)::BIGINT AS n FROM n GROUP BY 1 UNION ALL SELECT 'repeated', count(*) FROM n WHERE d >= '6' AND copies = 2""")
def _(spark, sf):
    t, v = _verdict_rows(spark, sf)
    valid, refused = C.verdict_index(v, t, "1")
    return valid.select(F.lit("valid").alias("why")).groupBy("why").agg(F.count("*").alias("n")).unionByName(refused)


@register("sup_trace_evidence", f"{_W} SELECT target_id, coalesce(form, 'none') AS form, trace_status FROM aud WHERE h[14] >= '6'")
def _(spark, sf):
    t, v = _verdict_rows(spark, sf)
    valid, _ = C.verdict_index(v, t, "1")
    return valid.join(t.select("target_id", "trace_status"), "target_id")


@register("sup_source_cache", f"WITH {_PARADIGM}, s AS (SELECT * FROM (VALUES ('punoj', 3), ('beje', 1), ('hap', 2), ('PI', 5)) v(name, n)) SELECT verb_id, coalesce(a.n, b.n, c.n) AS n, CASE WHEN a.n IS NOT NULL THEN 'id' WHEN b.n IS NOT NULL THEN 'lemma' WHEN c.n IS NOT NULL THEN 'folded' END AS how FROM lexicon l LEFT JOIN s a ON a.name = l.verb_id LEFT JOIN s b ON b.name = l.lemma LEFT JOIN s c ON translate(lower(c.name), 'ëç', 'ec') = translate(lower(l.lemma), 'ëç', 'ec')")
def _(spark, sf):
    s = spark.createDataFrame([("punoj", 3), ("beje", 1), ("hap", 2), ("PI", 5)], "name string, n int")
    of = lambda key, n: s.select(key.alias(f"k{n}"), F.col("n").alias(f"n{n}"))
    found = lexicon(spark, sf).join(of(F.col("name"), 1), F.col("k1") == F.col("verb_id"), "left").join(of(F.col("name"), 2), F.col("k2") == F.col("lemma"), "left").join(of(A.folded(F.col("name")), 3), F.col("k3") == A.folded(F.col("lemma")), "left")
    how = F.when(F.col("n1").isNotNull(), "id").when(F.col("n2").isNotNull(), "lemma").when(F.col("n3").isNotNull(), "folded")
    return found.select("verb_id", F.coalesce("n1", "n2", "n3").alias("n"), how.alias("how"))


@register("sup_db_evidence", f"{_ALL} SELECT variant_kind, count(*) AS occurrences, count(DISTINCT target_id) AS targets, count(DISTINCT resource_id) AS resources, count(*) FILTER (sentence LIKE '%''%' OR sentence LIKE '%’%') AS with_apostrophe FROM retained GROUP BY 1")
def _(spark, sf):
    kept = MA.with_text(MA.retain(occ(spark, sf)), rows(spark, sf))
    quoted = F.col("sentence").contains("'") | F.col("sentence").contains("’")
    return kept.groupBy("variant_kind").agg(F.count("*").alias("occurrences"), F.countDistinct("target_id").alias("targets"), F.countDistinct("resource_id").alias("resources"), F.count_if(quoted).alias("with_apostrophe"))


@register("sup_lookup_queries", f"{_ALL} SELECT o.variant_kind, t.target_key, t.signature, count(*) AS occurrences, count(DISTINCT o.resource_id) AS resources FROM occ o JOIN targets t USING (target_id) WHERE t.verb_id = 'v1' GROUP BY ALL")
def _(spark, sf):
    o, t = occ(spark, sf), phrase_targets(spark).select("target_id", "verb_id", "target_key", "signature")
    query = "SELECT o.variant_kind, t.target_key, t.signature, count(*) AS occurrences, count(DISTINCT o.resource_id) AS resources FROM {o} o JOIN {t} t USING (target_id) WHERE t.verb_id = :verb GROUP BY ALL"
    return spark.sql(query, args={"verb": "v1"}, o=o, t=t)


@register("sup_lookup_exact", f"{_ALL} SELECT o.target_id, o.variant_kind, o.pattern, t.target_key, t.signature, o.score, o.sentence FROM occ o JOIN targets t USING (target_id) WHERE t.target_key = 'the' ORDER BY o.score DESC, o.target_id, o.resource_id, o.doc_id, o.position LIMIT 10")
def _(spark, sf):
    best = L.exact_target(occ(spark, sf), phrase_targets(spark), "the")
    return MA.with_text(best, rows(spark, sf)).select("target_id", "variant_kind", "pattern", "target_key", "signature", "score", "sentence")


_SIGNATURE = "indicative.present.1sg.active.affirmative.declarative"


@register("sup_lookup_lemma", f"{_ALL} SELECT o.variant_kind, t.target_key, t.signature, count(*) AS occurrences, count(DISTINCT o.resource_id) AS resources FROM occ o JOIN targets t USING (target_id) WHERE t.verb_id = 'v2' GROUP BY ALL ORDER BY occurrences DESC, resources DESC, variant_kind, target_key, signature LIMIT 20")
def _(spark, sf):
    return L.occurrence_counts(occ(spark, sf), phrase_targets(spark), F.col("verb_id") == "v2", ["signature"])


@register("sup_lookup_cell", f"{_ALL} SELECT o.variant_kind, t.target_key, t.lemma, count(*) AS occurrences, count(DISTINCT o.resource_id) AS resources FROM occ o JOIN targets t USING (target_id) WHERE t.signature = '{_SIGNATURE}' GROUP BY ALL ORDER BY occurrences DESC, resources DESC, variant_kind, target_key, lemma LIMIT 20")
def _(spark, sf):
    return L.occurrence_counts(occ(spark, sf), phrase_targets(spark), F.col("signature") == _SIGNATURE, ["lemma"])


_CORPORA = ("Tatoeba", "QED", "TED2020", "NeuLab", "GlobalVoices")


@register("sup_corpus_rank", "WITH c AS (SELECT DISTINCT source AS corpus FROM documents WHERE source IS NOT NULL UNION SELECT unnest(['TED2020', 'Tatoeba', 'Other'])) SELECT corpus, coalesce(list_position(['Tatoeba', 'QED', 'TED2020', 'NeuLab', 'GlobalVoices'], corpus) - 1, 5) AS rank FROM c")
def _(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("source").alias("corpus")).filter("corpus IS NOT NULL").distinct()
    at = F.array_position(F.array(*map(F.lit, _CORPORA)), F.col("corpus"))
    return d.union(spark.createDataFrame([("TED2020",), ("Tatoeba",), ("Other",)], "corpus string")).distinct().select("corpus", F.when(at > 0, at - 1).otherwise(len(_CORPORA)).alias("rank"))


_PRINTED = """# t\n\n## punoj: punoj\n\n### Dëftore, e tashme\n\n|   | sg | pl |\n|---|---|---|\n| 1 | punoj | punojmë |\n| 2 | punon | — |\n| x | a | b |\n\n### Lidhore, më se e kryer\n\n| 3 | të kishte punuar |  |\n\n## hap: hap\n\n### Dëftore, e kryer e thjeshtë\n\n| 1 | hapa | hapëm |\n"""


@register("rd_husic_md", "SELECT * FROM (VALUES ('punoj', 'punoj', 'indicative|present|first-person|singular'), ('punoj', 'punojmë', 'indicative|present|first-person|plural'), ('punoj', 'punon', 'indicative|present|second-person|singular'), ('punoj', 'të kishte punuar', 'subjunctive|past|perfect|third-person|singular'), ('hap', 'hapa', 'indicative|aorist|first-person|singular'), ('hap', 'hapëm', 'indicative|aorist|first-person|plural')) v(verb_id, form, tags)")
def _(spark, sf):
    path = new_path(spark, "printed")
    fs, folder = writers.filesystem(path)
    fs.create_dir(folder, recursive=True)
    with fs.open_output_stream(f"{folder}/a.md", compression=None) as out:
        out.write(_PRINTED.encode())
    files = spark.read.text(path, wholetext=True)
    return C.table_forms(files).select("verb_id", "form", F.array_join("tags", "|").alias("tags"))


@register("sup_husic_lookup", "SELECT * FROM (VALUES ('punoj', 1, 'singular', 'punoj', false), ('punoj', 3, 'singular', NULL, NULL), ('hap', 1, 'plural', 'hapëm', false), ('pi', 1, 'singular', NULL, NULL)) v(verb_id, person, number, form, derived)")
def _(spark, sf):
    files = spark.createDataFrame([(_PRINTED,)], "value string")
    found = C.table_forms(files).withColumn("derived", F.lit(False))
    wanted = spark.createDataFrame([("punoj", 1, "singular", ["present"]), ("punoj", 3, "singular", ["present"]), ("hap", 1, "plural", ["aorist"]), ("pi", 1, "singular", ["present"])], "verb_id string, person int, number string, tense array<string>")
    who = F.element_at(F.array(F.lit("first-person"), F.lit("second-person"), F.lit("third-person")), F.col("person"))
    want = wanted.withColumn("want", F.concat("tense", F.array(who, F.col("number"))))
    joined = want.join(found.withColumnRenamed("verb_id", "of"), (F.col("of") == F.col("verb_id")) & (F.size(F.array_except("want", "tags")) == 0), "left")
    first = Window.partitionBy("verb_id", "person", "number").orderBy("derived", "form")
    return joined.withColumn("nth", F.row_number().over(first)).filter("nth = 1").select("verb_id", "person", "number", "form", "derived")


@register("sup_cite_husic", f"WITH {_PARADIGM} SELECT verb_id, CASE WHEN verb_id IN ('punoj', 'hap') THEN 'manual,printed' ELSE 'manual' END AS sources FROM lexicon")
def _(spark, sf):
    cited = C.table_forms(spark.createDataFrame([(_PRINTED,)], "value string")).select("verb_id", F.lit("printed").alias("more")).distinct()
    found = lexicon(spark, sf).withColumn("sources", F.array(F.lit("manual"))).join(cited, "verb_id", "left")
    return found.select("verb_id", F.array_join(F.when(F.col("more").isNotNull(), F.concat("sources", F.array("more"))).otherwise(F.col("sources")), ",").alias("sources"))


@register("api_examples", f"{_ALL}, e AS (SELECT target_key, o.*, row_number() OVER (PARTITION BY target_key ORDER BY o.score DESC, {', '.join('o.' + c.strip() for c in _KEY.split(','))}, o.target_id) AS rn FROM retained o JOIN targets t USING (target_id)) SELECT target_key, rn, sentence, score FROM e WHERE target_key IN ('the', 'que') AND rn <= 20")
def _(spark, sf):
    kept = MA.retain(occ(spark, sf)).join(phrase_targets(spark).filter(F.col("target_key").isin("the", "que")).select("target_id", "target_key"), "target_id")
    few = R.first_of(kept, ["target_key"], [F.desc("score"), *MA.KEY, "target_id"], 20)
    return MA.with_text(few, rows(spark, sf)).select("target_key", "rn", "sentence", "score")


@register("join_positional", f"{_S} SELECT {_KEY}, norm, length(sentence) AS sentence_chars FROM sentences")
def _(spark, sf):
    path = new_path(spark, "split")
    r = rows(spark, sf)
    r.select(*MA.KEY, "sentence", "norm").write.parquet(path)  # text and metadata are columns of one row: a reader takes those it needs
    return spark.read.parquet(path).select(*MA.KEY, "norm", F.char_length("sentence").alias("sentence_chars"))


@register("sort_partitions_lpt", f"{_S}, c AS (SELECT resource_id, count(*) AS n FROM sentences GROUP BY 1) SELECT resource_id, n, row_number() OVER (ORDER BY n DESC, resource_id) AS turn FROM c")
def _(spark, sf):
    c = rows(spark, sf).groupBy("resource_id").agg(F.count("*").alias("n"))
    return c.withColumn("turn", F.row_number().over(Window.orderBy(F.desc("n"), "resource_id")))  # a row for each resource


@register("sample_random", "SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 5")
def _(spark, sf):
    # a digest of a seed and the id is as good as a random number, and the same in each run
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").orderBy(F.md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string"))), "doc_id").limit(5)


_ARTICLES = (("a", "2026-01-02", True), ("b", "2026-03-01", True), ("c", "2026-02-01", False), ("d", "2025-12-31", True))


@register("sup_articles", "SELECT slug, row_number() OVER (ORDER BY day DESC) AS nth FROM (VALUES " + ", ".join(f"('{s}', DATE '{d}', {str(p).lower()})" for s, d, p in _ARTICLES) + ") v(slug, day, published) WHERE published")
def _(spark, sf):
    path = new_path(spark, "articles")
    fs, folder = writers.filesystem(path)
    fs.create_dir(folder, recursive=True)
    for s, d, p in _ARTICLES:
        with fs.open_output_stream(f"{folder}/{s}.json", compression=None) as out:
            out.write(json.dumps({"slug": s, "date": d, "published": p}).encode())
    a = spark.read.schema("slug string, date date, published boolean").json(path).filter("published")
    return a.withColumn("nth", F.row_number().over(Window.orderBy(F.desc("date")))).select("slug", "nth")

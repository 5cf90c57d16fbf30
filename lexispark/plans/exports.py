"""Registered queries that put forms into words: English glosses, segments, interlinear text, CoNLL-U, citations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import english, gloss
from ..functions import morphology as M
from ..registry import register
from .lexicon import _PARADIGM, forms, lexicon

_IRREGULAR = (("drink", "drank", "drunk", "drinking"), ("give", "gave", "given", "giving"), ("come", "came", "come", "coming"), ("be", "was", "been", "being"))
_EN = f"""irr AS (SELECT * FROM (VALUES {', '.join(map(str, _IRREGULAR))}) v(base, past, participle, gerund)), b AS (SELECT verb_id, regexp_replace(trim(string_split(translation_en, ' / ')[1]), '^to ', '') AS base FROM lexicon),
    r AS (SELECT *, right(base, 1) AS last, length(base) >= 3 AND regexp_matches(base, '(?i)[^aeiou][aeiou][^aeiouwxy]$') AND len(regexp_extract_all(base, '(?i)[aeiou]+')) = 1 AS cvc FROM b),
    ruled AS (SELECT verb_id, base, CASE WHEN last = 'e' THEN base || 'd' WHEN regexp_matches(base, '(?i)[^aeiou]y$') THEN base[:-2] || 'ied' WHEN last <> 'y' AND cvc THEN base || last || 'ed' ELSE base || 'ed' END AS past,
        CASE WHEN ends_with(base, 'ie') THEN base[:-3] || 'ying' WHEN regexp_matches(base, '[^eoy]e$') THEN base[:-2] || 'ing' WHEN cvc THEN base || last || 'ing' ELSE base || 'ing' END AS gerund FROM r),
    en AS (SELECT verb_id, u.base, coalesce(i.past, u.past) AS past, coalesce(i.participle, u.past) AS participle, coalesce(i.gerund, u.gerund) AS gerund FROM ruled u LEFT JOIN irr i USING (base))"""
_TPL = "tpl AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(str(x).lower() if isinstance(x, bool) else f"'{x}'" for x in t) + ")" for t in gloss.TEMPLATES) + ") v(key, prefix, adverb, aux, verb_form, no_pronoun, suffix, invert))"
_PASSIVE = "CASE WHEN aux = '' THEN CASE verb_form WHEN 'base' THEN CASE WHEN mood = 'imperative' THEN 'be' ELSE 'am/are/is' END WHEN 'past' THEN 'was/were' WHEN 'gerund' THEN 'am/are/is being' ELSE '' END ELSE aux || CASE verb_form WHEN 'base' THEN ' be' WHEN 'gerund' THEN ' being' ELSE ' been' END END"
_ONE, _THREE = "coalesce(cell = '1sg', true)", "coalesce(cell = '3sg', false)"
_AGREE = lambda a: f"replace(replace(replace(replace({a}, 'was/were', CASE WHEN {_ONE} OR {_THREE} THEN 'was' ELSE 'were' END), 'have/has', CASE WHEN {_THREE} THEN 'has' ELSE 'have' END), 'am/are/is', CASE WHEN {_ONE} THEN 'am' WHEN {_THREE} THEN 'is' ELSE 'are' END), 'do/does', CASE WHEN {_THREE} THEN 'does' ELSE 'do' END)"
_SAID = lambda *xs: "array_to_string(list_filter([" + ", ".join(xs) + "], lambda x: x <> ''), ' ')"
_GLOSS = f"""WITH {_PARADIGM}, {_EN}, {_TPL}, g0 AS (SELECT f.*, en.base, en.past, en.participle, en.gerund, prefix, adverb, aux, verb_form, no_pronoun, suffix, invert, en.base = 'be' OR starts_with(en.base, 'be ') AS copula,
        coalesce(polarity = 'negative', false) AS neg, coalesce(modality = 'interrogative', false) AS ask, mood <> 'non-finite' AS finite FROM forms f JOIN en USING (verb_id) JOIN tpl ON tpl.key = mood || '.' || tense),
    g1 AS (SELECT * REPLACE (CASE WHEN passive THEN {_PASSIVE} ELSE aux END AS aux, CASE WHEN passive THEN 'participle' ELSE verb_form END AS verb_form) FROM (SELECT *, coalesce(voice = 'middle-passive', false) AND NOT copula AS passive FROM g0)),
    g2 AS (SELECT *, copula AND aux = '' AND verb_form IN ('base', 'past') AND finite AND mood <> 'imperative' AS virtual, mood = 'imperative' AND neg AS forbidden FROM g1),
    g3 AS (SELECT * REPLACE (CASE WHEN virtual THEN CASE WHEN verb_form = 'past' THEN 'was/were' ELSE 'am/are/is' END ELSE aux END AS aux) FROM g2), g4 AS (SELECT *, (neg OR ask) AND aux = '' AND finite AND NOT forbidden AS support FROM g3),
    g5 AS (SELECT *, {_AGREE("CASE WHEN support AND verb_form = 'past' THEN 'did' WHEN support THEN 'do/does' ELSE aux END")} AS ax, CASE WHEN support THEN base WHEN virtual THEN trim(substr(base, 3)) ELSE CASE verb_form WHEN 'base' THEN base WHEN 'past' THEN past WHEN 'participle' THEN participle ELSE gerund END END AS word,
        CASE WHEN no_pronoun THEN '' ELSE CASE cell WHEN '2sg' THEN 'you' WHEN '3sg' THEN 's/he' WHEN '1pl' THEN 'we' WHEN '2pl' THEN 'you' WHEN '3pl' THEN 'they' ELSE 'I' END END AS who FROM g4),
    g6 AS (SELECT *, string_split(ax, ' ')[1] AS head, regexp_replace(ax, '^[^ ]+ ?', '') AS rest, CASE WHEN neg AND ax <> '' THEN 'not' ELSE '' END AS no FROM g5),
    glossed AS (SELECT *, CASE WHEN forbidden THEN {_SAID("prefix", "'do'", "'not'", "ax", "word")} || suffix WHEN (ask OR invert) AND ax <> '' THEN {_SAID("prefix", "head", "who", "adverb", "no", "rest", "word")} || CASE WHEN ask THEN '?' ELSE suffix END
        ELSE {_SAID("prefix", "who", "adverb", "head", "no", "rest", "word")} || suffix END AS gloss FROM g6)"""


def _english(spark, sf):
    irregular = spark.createDataFrame(list(_IRREGULAR), english.FORMS)
    return english.english_forms(lexicon(spark, sf).select("verb_id", "translation_en"), irregular)


_KEYS = ("verb_id", "mood", "tense", "cell", "voice", "polarity", "modality")


@register("fn_english_gloss", f"{_GLOSS} SELECT {', '.join(_KEYS)}, gloss FROM glossed")
def _(spark, sf):
    return gloss.with_gloss(forms(spark, sf).select(*_KEYS), _english(spark, sf))


@register("fn_gloss_table", f"{_GLOSS} SELECT verb_id, mood, tense, count(*) AS cells, min(gloss) AS first, max(gloss) AS last FROM glossed WHERE form IS NOT NULL AND (polarity IS NULL OR (polarity = 'affirmative' AND modality = 'declarative')) GROUP BY 1, 2, 3")
def _(spark, sf):
    g = gloss.with_gloss(forms(spark, sf).filter("form IS NOT NULL AND (polarity IS NULL OR (polarity = 'affirmative' AND modality = 'declarative'))").select(*_KEYS), _english(spark, sf))
    return g.groupBy("verb_id", "mood", "tense").agg(F.count("*").alias("cells"), F.min("gloss").alias("first"), F.max("gloss").alias("last"))


@register("fn_voice_transform", f"WITH {_TPL}, t AS (SELECT *, string_split(key, '.')[1] AS mood FROM tpl) SELECT key, {_PASSIVE} AS passive FROM t")
def _(spark, sf):
    t = spark.createDataFrame(list(gloss.TEMPLATES), gloss.TEMPLATE)
    return t.select("key", gloss.passive_aux(F.col("aux"), F.col("verb_form"), F.substring_index("key", ".", 1)).alias("passive"))


_AUXES = ("was/were going to", "have/has been", "am/are/is being", "do/does", "will have", "")
_CELLS = ("1sg", "2sg", "3sg", "1pl", "2pl", "3pl")


@register("fn_aux_agreement", f"SELECT aux, cell, {_AGREE('aux')} AS said FROM (VALUES {', '.join(f'({a!r})' for a in _AUXES)}) a(aux), (VALUES {', '.join(f'({c!r})' for c in _CELLS)}) c(cell)")
def _(spark, sf):
    d = spark.createDataFrame([(a, c) for a in _AUXES for c in _CELLS], "aux string, cell string")
    return d.select("aux", "cell", gloss.agreed(F.col("aux"), F.col("cell")).alias("said"))


_ROLES = "list_transform(ws, lambda w, i: CASE WHEN i = len(ws) THEN 'stem' WHEN w = 'u' THEN 'voice-marker' WHEN list_contains(['të', 'do', 'mos', 'nuk', 'a', 'për', 'duke', 'pa', 'me'], w) THEN 'particle' ELSE 'auxiliary' END)"
_SEG = f"""WITH {_PARADIGM}, s0 AS (SELECT *, string_split(form, ' ') AS ws FROM forms WHERE form IS NOT NULL), s1 AS (SELECT *, {_ROLES} AS rs, ws[-1] AS w FROM s0),
    ends AS (SELECT DISTINCT g.mood, g.tense, g.voice, g.cell, r.ending FROM grid g JOIN rules r ON r.rule = g.rule AND r.cell = g.cell WHERE r.ending <> ''),
    s2 AS (SELECT s1.*, (SELECT e.ending FROM ends e WHERE e.mood = s1.mood AND e.tense = s1.tense AND e.voice = s1.voice AND e.cell = s1.cell AND s1.w LIKE '%' || e.ending AND length(s1.w) > length(e.ending) ORDER BY length(e.ending) DESC, e.ending LIMIT 1) AS cand FROM s1),
    s3 AS (SELECT *, CASE WHEN mood <> 'non-finite' AND NOT list_contains(rs, 'auxiliary') THEN cand END AS ending FROM s2),
    seg AS (SELECT *, CASE WHEN ending IS NULL THEN ws ELSE list_concat(ws[:-2], [left(w, length(w) - length(ending)), ending]) END AS surfaces, CASE WHEN ending IS NULL THEN rs ELSE list_append(rs, 'ending') END AS roles FROM s3)"""


@register("mor_decompose", f"{_SEG} SELECT {', '.join(_KEYS)}, array_to_string(list_transform(surfaces, lambda s, i: s || ':' || roles[i]), ' ') AS segments, form AS joined FROM seg")
def _(spark, sf):
    d = M.with_segments(forms(spark, sf).filter("form IS NOT NULL"))
    return d.select(*_KEYS, F.array_join(F.transform("segments", lambda p: F.concat_ws(":", p["surface"], p["role"])), " ").alias("segments"), M.joined_segments(F.col("segments")).alias("joined"))


@register("sup_prepend", f"{_SEG} SELECT verb_id, count(*) FILTER (list_contains(roles, 'voice-marker')) AS marked, count(*) FILTER (roles[1] = 'particle') AS with_particle, count(*) FILTER (list_contains(roles, 'ending')) AS with_ending FROM seg GROUP BY 1")
def _(spark, sf):
    d = M.with_segments(forms(spark, sf).filter("form IS NOT NULL"))
    has = lambda role: F.exists("segments", lambda p: p["role"] == role)
    return d.groupBy("verb_id").agg(F.count_if(has("voice-marker")).alias("marked"), F.count_if(F.get("segments", 0)["role"] == "particle").alias("with_particle"), F.count_if(has("ending")).alias("with_ending"))


_TENSE_GLOSS = "CASE tense " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in {"present": "PRS", "imperfect": "IPF", "aorist": "AOR", "perfect": "PRF", "pluperfect": "PLUP", "past-anterior": "PST.ANT", "future": "FUT", "future-perfect": "FUT.PRF", "future-in-past": "FUT.PST", "future-perfect-in-past": "FUT.PRF.PST"}.items()) + " END"
_PLAIN = "polarity = 'affirmative' AND modality = 'declarative' AND voice = 'active' AND form IS NOT NULL"


@register("mor_igt", f"""{_SEG}, n AS (SELECT *, list_transform(roles, lambda r: CASE r WHEN 'auxiliary' THEN 'AUX' WHEN 'stem' THEN 'STEM' WHEN 'voice-marker' THEN 'MID.PASS' WHEN 'ending' THEN concat_ws('.', left(cell, 1), CASE WHEN cell LIKE '%sg' THEN 'SG' ELSE 'PL' END, {_TENSE_GLOSS}) ELSE 'PRT' END) AS names FROM seg WHERE {_PLAIN})
    SELECT verb_id, mood, tense, cell, rtrim(array_to_string(list_transform(surfaces, lambda s, i: rpad(s, greatest(length(s), length(names[i]))::INTEGER, ' ')), '  ')) || chr(10) || rtrim(array_to_string(list_transform(names, lambda s, i: rpad(s, greatest(length(s), length(surfaces[i]))::INTEGER, ' ')), '  ')) AS igt FROM n""")
def _(spark, sf):
    d = M.with_segments(forms(spark, sf).filter(_PLAIN))
    return d.select("verb_id", "mood", "tense", "cell", M.interlinear(F.col("segments"), F.col("tense"), F.col("cell")).alias("igt"))


_FEAT = "CASE tense WHEN 'present' THEN 'Tense=Pres' WHEN 'imperfect' THEN 'Tense=Imp' WHEN 'aorist' THEN 'Tense=Past|Aspect=Perf' WHEN 'perfect' THEN 'Tense=Pres|Aspect=Perf' WHEN 'pluperfect' THEN 'Tense=Past|Aspect=Perf' WHEN 'past-anterior' THEN 'Tense=Pqp|Aspect=Perf' WHEN 'future' THEN 'Tense=Fut' WHEN 'future-perfect' THEN 'Tense=Fut|Aspect=Perf' WHEN 'future-in-past' THEN 'Tense=Fut|Aspect=Imp' ELSE 'Tense=Fut|Aspect=Perf' END"


@register("mor_conllu", f"""WITH {_PARADIGM}, c AS (SELECT *, row_number() OVER (PARTITION BY verb_id ORDER BY mood, tense, cell) AS nth FROM forms WHERE {_PLAIN} AND mood <> 'non-finite')
    SELECT verb_id, nth, concat_ws(chr(9), nth, form, lemma, 'VERB', '_', 'VerbForm=Fin|Mood=' || CASE mood WHEN 'subjunctive' THEN 'Sub' WHEN 'conditional' THEN 'Cnd' ELSE upper(left(mood, 1)) || substr(mood, 2, 2) END || '|' || {_FEAT} || '|Person=' || left(cell, 1) || '|Number=' || CASE WHEN cell LIKE '%sg' THEN 'Sing' ELSE 'Plur' END || '|Voice=Act|Polarity=Pos', '_', '_', '_', 'Cell=' || mood || '-' || tense || '-' || cell) AS line FROM c""")
def _(spark, sf):
    d = forms(spark, sf).filter(f"{_PLAIN} AND mood <> 'non-finite'").withColumn("nth", F.row_number().over(Window.partitionBy("verb_id").orderBy("mood", "tense", "cell")))
    return d.select("verb_id", "nth", M.conllu(F.col("lemma"), F.col("form"), F.col("mood"), F.col("tense"), F.col("cell"), F.col("nth")).alias("line"))


@register("mor_cite", f"""WITH {_PARADIGM} SELECT verb_id, '@misc{{' || verb_id || '-2026,' || chr(10) || '  title = {{' || replace(lemma, 'ë', '{{\\"e}}') || ' — ' || translation_en || '}},' || chr(10) || '  year = {{2026}},' || chr(10) || '  url = {{https://verbs.example/' || verb_id || '}}' || chr(10) || '}}' AS entry FROM lexicon""".replace("\\\\", "\\"))
def _(spark, sf):
    return lexicon(spark, sf).select("verb_id", M.citation(F.col("verb_id"), F.col("lemma"), F.col("translation_en"), F.concat(F.lit("https://verbs.example/"), "verb_id"), 2026).alias("entry"))


@register("mor_cite_plain", f"""WITH {_PARADIGM} SELECT verb_id, 'Verb editors. (2026). ' || lemma || ' — ' || translation_en || '. Verbs. https://verbs.example/' || verb_id AS apa,
    'Verbs · ' || lemma || ' (' || translation_en || ') · https://verbs.example/' || verb_id AS plain FROM lexicon""")
def _(spark, sf):
    cited = M.plain_citations(F.col("lemma"), F.col("translation_en"), F.concat(F.lit("https://verbs.example/"), "verb_id"), "Verb editors", "Verbs", 2026)
    return lexicon(spark, sf).select("verb_id", cited.alias("c")).select("verb_id", "c.*")


@register("api_detail", f"{_GLOSS} SELECT g.verb_id, l.translation_en, mood, tense, cell, voice, form, gloss FROM glossed g JOIN lexicon l USING (verb_id) WHERE g.verb_id = 'punoj' AND form IS NOT NULL AND (polarity IS NULL OR (polarity = 'affirmative' AND modality = 'declarative'))")
def _(spark, sf):
    one = forms(spark, sf).filter("verb_id = 'punoj' AND form IS NOT NULL AND (polarity IS NULL OR (polarity = 'affirmative' AND modality = 'declarative'))")
    return gloss.with_gloss(one.select(*_KEYS, "translation_en", "form"), _english(spark, sf)).select("verb_id", "translation_en", "mood", "tense", "cell", "voice", "form", "gloss")


@register("mor_derived_forms", f"WITH {_PARADIGM} SELECT lemma, form, CASE tense WHEN 'participle' THEN 'participle' WHEN 'infinitive' THEN 'infinitive' ELSE 'non-finite ' || tense END AS tag FROM forms WHERE mood = 'non-finite' UNION ALL SELECT lemma, form, 'first-person singular ' || tense FROM forms WHERE mood = 'indicative' AND cell = '1sg' AND voice = 'active' AND polarity = 'affirmative' AND modality = 'declarative' AND tense IN ('present', 'aorist') AND form IS NOT NULL")
def _(spark, sf):
    f = forms(spark, sf)
    tag = F.when(F.col("tense").isin("participle", "infinitive"), F.col("tense")).otherwise(F.concat(F.lit("non-finite "), "tense"))
    first = f.filter("mood = 'indicative' AND cell = '1sg' AND voice = 'active' AND polarity = 'affirmative' AND modality = 'declarative' AND tense IN ('present', 'aorist') AND form IS NOT NULL")
    return f.filter("mood = 'non-finite'").select("lemma", "form", tag.alias("tag")).unionByName(first.select("lemma", "form", F.concat(F.lit("first-person singular "), "tense").alias("tag")))


@register("fn_explain_segment", f"{_SEG}, u AS (SELECT DISTINCT unnest(roles) AS role FROM seg) SELECT role, CASE role WHEN 'particle' THEN 'a particle of mood, negation or question' WHEN 'auxiliary' THEN 'an auxiliary that carries person and tense' WHEN 'stem' THEN 'the stem or participle of the verb' WHEN 'ending' THEN 'an ending of person and number' ELSE 'the marker of the middle-passive' END AS explained FROM u")
def _(spark, sf):
    told = {"particle": "a particle of mood, negation or question", "auxiliary": "an auxiliary that carries person and tense", "stem": "the stem or participle of the verb", "ending": "an ending of person and number", "voice-marker": "the marker of the middle-passive"}
    names = F.create_map(*(F.lit(x) for kv in told.items() for x in kv))
    d = M.with_segments(forms(spark, sf).filter("form IS NOT NULL")).select(F.explode("segments").alias("p")).select(F.col("p.role").alias("role")).distinct()
    return d.select("role", F.element_at(names, F.col("role")).alias("explained"))

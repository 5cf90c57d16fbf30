"""Registered queries over a lexicon: words of `documents` become verbs, beside a few entries that show each kind of verb. The SQL derives the same entries and has the same rule tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import morphology as M
from ..registry import register
from .corpus import stored

_NO = (False, False, False, False)
#: A few entries that show each kind of verb.
VERBS = (
    ("punoj", "punoj", "to work", 1, "kam", "puno", "punua", "punuar", *_NO, {}),
    ("hap", "hap", "to open", 2, "kam", "hap", "hap", "hapur", *_NO, {}),
    ("pi", "pi", "to drink", 3, "kam", "pi", "pi", "pirë", *_NO, {}),
    ("laj", "laj", "to wash", 1, "kam", "la", "la", "larë", *_NO, {"indicative.aorist/3sg": "lau", "indicative.aorist/1pl": "lamë", "indicative.aorist/2pl": "latë", "indicative.aorist/3pl": "lanë", "imperative.present/2sg": "laj", "imperative.present.middle-passive/2sg": "lahu", "imperative.present.middle-passive/2pl": "lahuni"}),
    ("jap", "jap", "to give", 2, "kam", "jap", "dhash", "dhënë", True, False, False, False, {}),
    ("vij", "vij", "to come", 1, "kam", "vi", "erdh", "ardhur", True, True, False, False, {}),
    ("jam", "jam", "to be", 2, "kam", "jam", "qe", "qenë", True, True, False, False, {}),
    ("ngjet", "ngjet", "to happen", 2, "kam", "ngjet", "ngjet", "ngjetur", False, False, True, False, {"subjunctive.present/3sg": "të ngjasë"}),
    ("rrok", "rrok", "to grasp", 2, "kam", "rrok", "rrok", "rrokur", False, False, False, True, {}),
)


#: Words of so many letters that occur so often become verbs.
WORD, LEAST = "[a-z]{4,9}", 200


def derived(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """Entries from words of documents: class and flags come from digits of the word's digest, principal parts from its class."""
    words = documents.select(F.explode(F.split("text", " ")).alias("w")).filter(F.col("w").rlike(f"^{WORD}$") & ~F.col("w").endswith("j"))
    words = words.groupBy("w").agg(F.count("*").alias("n")).filter((F.col("n") >= least) & ~F.col("w").isin(*(v[0] for v in VERBS)))
    w, digit = F.col("w"), lambda k: F.substring(F.md5("w"), k, 1)
    kind = F.when(digit(1) < "6", 1).when(digit(1) < "b", 2).otherwise(3)
    by_class = lambda *ends: F.concat(w, F.when(kind == 1, ends[0]).when(kind == 2, ends[1]).otherwise(ends[2]))
    prefix = "imperative.present.middle-passive/"
    overrides = F.when(digit(5) < "4", F.create_map(F.lit(f"{prefix}2sg"), F.concat(w, F.lit("u")), F.lit(f"{prefix}2pl"), F.concat(w, F.lit("uni")))).otherwise(F.create_map().cast("map<string,string>"))
    return words.select(
        w.alias("verb_id"), by_class("j", "", "").alias("lemma"), F.concat(F.lit("to "), w).alias("translation_en"), kind.alias("class"), F.lit("kam").alias("auxiliary"), w.alias("present"), by_class("a", "", "").alias("aorist"),
        by_class("ar", "ur", "rë").alias("participle"), F.lit(False).alias("is_suppletive"), (digit(2) < "4").alias("no_middle_passive"), (digit(3) == "0").alias("third_person_only"), (digit(4) == "0").alias("mp_third_person_only"), overrides.alias("overrides"),
    )


def examples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(VERBS), M.LEXICON)


def lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """Entries in as many files as keep all cores busy: a verb has hundreds of forms, so few bytes of it are much work."""
    files = 3 * spark.sparkContext.defaultParallelism
    return stored(spark, sf, "lexicon", lambda: examples(spark).unionByName(derived(spark.read.parquet(f"{sf}/documents.parquet"))).repartition(files, "verb_id"))


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, dict):
        return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in value.items()) + "}" if value else "MAP {'-': '-'}"
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def _values(name: str, rows, columns: str) -> str:
    return f"{name} AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in rows)}) v({columns}))"


_COLUMNS = ", ".join(x.split(" ")[0] for x in M.LEXICON.split(", "))
_OVER = lambda key: f"overrides[{key} || '/' || g.cell]"
_KEYS = "CASE g.rule " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in M.RULE_KEYS.items()) + " END"
_PARADIGM = ",".join((
    _values("fixed", VERBS, _COLUMNS),
    f"""lexicon_words AS (SELECT w, md5(w) AS h FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) WHERE regexp_full_match(w, '{WORD}') AND NOT ends_with(w, 'j') AND w NOT IN (SELECT verb_id FROM fixed)
        GROUP BY w HAVING count(*) >= {LEAST}),
    lexicon_classes AS (SELECT *, CASE WHEN h[1] < '6' THEN 1 WHEN h[1] < 'b' THEN 2 ELSE 3 END AS class FROM lexicon_words),
    lexicon AS (
        SELECT * FROM fixed
        UNION ALL SELECT w, w || ['j', '', ''][class], 'to ' || w, class, 'kam', w, w || ['a', '', ''][class], w || ['ar', 'ur', 'rë'][class], false, h[2] < '4', h[3] = '0', h[4] = '0',
            CASE WHEN h[5] < '4' THEN MAP {{'imperative.present.middle-passive/2sg': w || 'u', 'imperative.present.middle-passive/2pl': w || 'uni'}} ELSE MAP {{'-': '-'}} END
        FROM lexicon_classes)""",
    _values("grid", M.grid_rows(), "mood, tense, voice, cell, person, prefix, rule, aux_tense"), _values("rules", M.rule_rows(), "class, rule, cell, stem, ending"),
    _values("auxiliaries", M.auxiliary_rows(), "aux, aux_tense, cell, aux_form"), _values("suppletive", M.suppletive_rows(), "verb_id, rule, cell, supp"), _values("participles", M.participle_rows(), "verb_id, supp_participle"),
    f"""cells AS (
        SELECT l.*, g.* EXCLUDE (voice), g.voice, r.stem, r.ending, a.aux_form, s.supp, CASE WHEN l.is_suppletive THEN coalesce(p.supp_participle, l.participle) ELSE l.participle END AS part,
               CASE r.stem WHEN 'present' THEN l.present WHEN 'aorist' THEN l.aorist ELSE l.participle END AS stem_form,
               CASE WHEN r.stem = 'participle' THEN CASE WHEN l.participle LIKE '%rrë' THEN 1 WHEN l.participle LIKE '%rë' OR l.participle LIKE '%ur' THEN 2 ELSE 1 END ELSE 0 END AS cut,
               {_OVER(_KEYS)} AS own, {_OVER("'imperative.present.middle-passive'")} AS mp_imperative, {_OVER("'indicative.aorist.middle-passive'")} AS mp_aorist, {_OVER("g.mood || '.' || g.tense")} AS whole
        FROM lexicon l CROSS JOIN grid g LEFT JOIN participles p ON p.verb_id = l.verb_id LEFT JOIN rules r ON r.class = l.class AND r.rule = g.rule AND r.cell = g.cell
        LEFT JOIN auxiliaries a ON a.aux = CASE WHEN g.voice = 'middle-passive' THEN 'jam' ELSE l.auxiliary END AND a.aux_tense = g.aux_tense AND a.cell = g.cell
        LEFT JOIN suppletive s ON s.verb_id = l.verb_id AND s.rule = g.rule AND s.cell = g.cell)""",
    """bases AS (
        SELECT *, CASE WHEN mood = 'non-finite' THEN prefix || part WHEN voice = 'middle-passive' AND mood = 'indicative' AND tense = 'aorist' AND cell = '3sg' THEN coalesce(mp_aorist, 'u ' || aorist)
                       WHEN mood = 'imperative' AND voice = 'middle-passive' THEN mp_imperative WHEN aux_tense IS NOT NULL THEN prefix || aux_form || ' ' || part
                       ELSE prefix || coalesce(regexp_replace(own, '^të ', ''), CASE WHEN is_suppletive THEN supp END, substr(stem_form, 1, length(stem_form) - cut) || ending) END AS base,
               CASE WHEN mood <> 'non-finite' AND third_person_only AND person <> 3 THEN 'third person only' WHEN mood <> 'non-finite' AND voice = 'middle-passive' AND mp_third_person_only AND person <> 3 THEN 'third person only in the middle-passive'
                    WHEN voice = 'middle-passive' AND no_middle_passive THEN 'no middle-passive' WHEN mood = 'imperative' AND voice = 'middle-passive' AND mp_imperative IS NULL THEN 'no middle-passive imperative' END AS reason FROM cells)""",
    """ways AS (SELECT b.*, w.polarity, w.modality FROM bases b JOIN (VALUES ('affirmative', 'declarative'), ('affirmative', 'interrogative'), ('negative', 'declarative'), ('negative', 'interrogative'), (NULL, NULL)) w(polarity, modality)
        ON (b.mood = 'non-finite') = (w.polarity IS NULL))""",
    """chosen AS (SELECT * EXCLUDE (base), CASE WHEN voice = 'active' AND polarity = 'affirmative' AND modality = 'declarative' AND whole IS NOT NULL THEN whole ELSE base END AS base,
        CASE WHEN mood IN ('imperative', 'subjunctive', 'optative') THEN 'mos' ELSE 'nuk' END AS word FROM ways)""",
    """forms AS (SELECT verb_id, lemma, translation_en, class, mood, tense, voice, cell, person, polarity, modality, reason, CASE WHEN reason IS NULL THEN (CASE WHEN modality = 'interrogative' THEN 'a ' ELSE '' END) ||
        CASE WHEN polarity = 'negative' THEN CASE WHEN mood = 'subjunctive' AND starts_with(base, 'të ') THEN 'të ' || word || ' ' || substr(base, 4) ELSE word || ' ' || base END ELSE base END END AS form FROM chosen)""",
))
_ALL_WAYS = (("affirmative", "negative"), ("declarative", "interrogative"))
_KEY = ("verb_id", "mood", "tense", "voice", "cell")


def forms(spark: SparkSession, sf: str) -> DataFrame:
    return M.conjugate(lexicon(spark, sf), *_ALL_WAYS)


def _form_query(name: str, where: str, columns: tuple[str, ...] = (*_KEY, "polarity", "modality", "form")) -> None:
    @register(name, f"WITH {_PARADIGM} SELECT {', '.join(columns)} FROM forms WHERE {where}")
    def _(spark, sf):
        return forms(spark, sf).filter(where).select(*columns)


_PLAIN = "polarity = 'affirmative' AND modality = 'declarative'"
_form_query("mor_table", "form IS NOT NULL")
_form_query("mor_conjugate", "verb_id = 'punoj' AND mood = 'subjunctive' AND tense = 'present' AND cell = '1sg'")
_form_query("mor_simple", f"{_PLAIN} AND mood = 'indicative' AND tense IN ('present', 'imperfect', 'aorist') AND voice = 'active'")
_form_query("mor_compound", f"{_PLAIN} AND tense IN ('perfect', 'pluperfect', 'past-anterior')")
for _mood in ("indicative", "subjunctive", "conditional", "admirative", "optative", "imperative"):
    _form_query(f"mor_{_mood}", f"{_PLAIN} AND mood = '{_mood}'")
_form_query("mor_nonfinite", "mood = 'non-finite'", ("verb_id", "tense", "form"))
_form_query("mor_negate", "polarity = 'negative' AND modality = 'declarative'")
_form_query("mor_interrogative", "modality = 'interrogative'")
_form_query("mor_override_exact", f"{_PLAIN} AND verb_id IN ('laj', 'ngjet')")
_form_query("mor_feasible", "polarity IS NULL OR (polarity = 'affirmative' AND modality = 'declarative')", (*_KEY, "reason"))
_form_query("join_override_chain", f"{_PLAIN} AND verb_id IN ('laj', 'jap') AND voice = 'active'")
_form_query("sup_igt_enumerate", f"{_PLAIN} AND voice = 'active' AND form IS NOT NULL", _KEY)
_form_query("mor_questions", f"{_PLAIN} AND voice = 'active' AND mood = 'indicative' AND form IS NOT NULL", ("verb_id", "tense", "cell", "form"))


@register("mor_normalize", f"WITH {_PARADIGM}, w AS (SELECT verb_id, mood, '  ' || replace(form, ' ', '   ') || chr(9) AS wide FROM forms WHERE form IS NOT NULL) SELECT verb_id, mood, length(wide) AS wide, trim(regexp_replace(replace(wide, chr(9), ' '), ' +', ' ', 'g')) AS form FROM w")
def _(spark, sf):
    wide = F.concat(F.lit("  "), F.replace("form", F.lit(" "), F.lit("   ")), F.lit("\t"))
    return forms(spark, sf).filter("form IS NOT NULL").select("verb_id", "mood", F.char_length(wide).alias("wide"), M.normalized_form(wide).alias("form"))


@register("mor_grid", f"WITH {_PARADIGM} SELECT * FROM grid")
def _(spark, sf):
    return M.grid(spark)


@register("join_rules", f"WITH {_PARADIGM} SELECT verb_id, r.rule, r.cell, r.stem, r.ending FROM lexicon l JOIN rules r ON r.class = l.class")
def _(spark, sf):
    rules = spark.createDataFrame(M.rule_rows(), "class int, rule string, cell string, stem string, ending string")
    return lexicon(spark, sf).join(F.broadcast(rules), "class").select("verb_id", "rule", "cell", "stem", "ending")


@register("join_cross_grid", f"WITH {_PARADIGM} SELECT verb_id, count(*) AS cells FROM forms WHERE modality = 'declarative' OR modality IS NULL GROUP BY 1")
def _(spark, sf):
    return M.conjugate(lexicon(spark, sf), ("affirmative", "negative")).groupBy("verb_id").agg(F.count("*").alias("cells"))


@register("mor_admirative_trim", f"WITH {_PARADIGM} SELECT verb_id, CASE WHEN participle LIKE '%rrë' THEN 1 WHEN participle LIKE '%rë' OR participle LIKE '%ur' THEN 2 ELSE 1 END AS trim FROM lexicon")
def _(spark, sf):
    return lexicon(spark, sf).select("verb_id", M.admirative_trim(F.col("participle")).alias("trim"))


@register("mor_participle", f"WITH {_PARADIGM} SELECT verb_id, form AS participle FROM forms WHERE mood = 'non-finite' AND tense = 'participle'")
def _(spark, sf):
    return forms(spark, sf).filter("mood = 'non-finite' AND tense = 'participle'").select("verb_id", F.col("form").alias("participle"))


@register("mor_list", f"WITH {_PARADIGM} SELECT verb_id, lemma, class FROM lexicon ORDER BY verb_id")
def _(spark, sf):
    return lexicon(spark, sf).select("verb_id", "lemma", "class").orderBy("verb_id")


@register("api_list", f"WITH {_PARADIGM} SELECT lemma, translation_en, class, auxiliary FROM lexicon")
def _(spark, sf):
    return lexicon(spark, sf).orderBy("lemma").select("lemma", "translation_en", "class", "auxiliary")


@register("sup_aux_lookup", f"WITH {_PARADIGM} SELECT aux, aux_tense, cell, aux_form FROM auxiliaries")
def _(spark, sf):
    return spark.createDataFrame(M.auxiliary_rows(), "aux string, aux_tense string, cell string, aux_form string")


_SIG = "CASE WHEN mood = 'non-finite' THEN mood || '.' || tense ELSE concat_ws('.', mood, tense, cell, voice, polarity, modality) END"


@register("fn_signature", f"WITH {_PARADIGM} SELECT verb_id, {_SIG} AS signature, CASE WHEN mood = 'non-finite' THEN mood || ' ' || tense ELSE concat_ws(' ', mood, tense, cell, voice) END AS label FROM forms")
def _(spark, sf):
    return forms(spark, sf).select("verb_id", M.signature().alias("signature"), M.cell_label().alias("label"))


_TARGETS = rf"""WITH {_PARADIGM}, t AS (SELECT verb_id, lemma, array_to_string(list_transform(regexp_extract_all(form, '\p{{L}}+'), lambda w: lower(w)), ' ') AS target_key, {_SIG} AS signature
    FROM forms WHERE form IS NOT NULL AND (modality = 'declarative' OR modality IS NULL))
    SELECT DISTINCT regexp_replace(verb_id || ':' || signature || ':' || target_key, '\s+', '_', 'g') AS target_id, target_key, signature, verb_id, lemma FROM t"""


@register("mor_targets", _TARGETS)
def _(spark, sf):
    return M.search_targets(lexicon(spark, sf)).select("target_id", "target_key", "signature", "verb_id", "lemma")


@register("sink_targets", _TARGETS.replace("SELECT DISTINCT regexp_replace", "SELECT DISTINCT regexp_replace", 1) + " ORDER BY target_key, target_id")
def _(spark, sf):
    return M.search_targets(lexicon(spark, sf)).select("target_id", "target_key", "signature", "verb_id", "lemma").orderBy(F.expr("target_key COLLATE UNICODE"), "target_id")


@register("flt_browse", f"WITH {_PARADIGM} SELECT lemma, class FROM lexicon WHERE class = 2 AND auxiliary = 'kam' ORDER BY lemma")
def _(spark, sf):
    return lexicon(spark, sf).filter("class = 2 AND auxiliary = 'kam'").select("lemma", "class").orderBy("lemma")


@register("flt_suggest", f"WITH {_PARADIGM} SELECT lemma FROM lexicon WHERE contains(lower(lemma), 'p') OR contains(lower(translation_en), 'p') ORDER BY lemma LIMIT 8")
def _(spark, sf):
    return lexicon(spark, sf).filter(F.lower("lemma").contains("p") | F.lower("translation_en").contains("p")).select("lemma").orderBy("lemma").limit(8)


@register("sup_slug_lookup", f"WITH {_PARADIGM} SELECT DISTINCT unnest([verb_id, lemma]) AS slug FROM lexicon")
def _(spark, sf):
    return lexicon(spark, sf).select(F.explode(F.array("verb_id", "lemma")).alias("slug")).distinct()

"""Registered queries over the sentences of documents: text functions, matching, retention, reports.

Targets are phrases that occur in the data; the same rows are written out in the SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import new_path
from ..functions import text as T
from ..operators import match as M
from ..operators import reports as R
from ..operators import search_index as I
from ..operators import snapshots as SN
from ..registry import register

#: target_id, verb_id, lemma, mood, tense, voice, polarity, person, number, tokens
TARGETS = (
    ("t01", "v1", "alpha", "indicative", "present", "active", "affirmative", 1, "singular", "the"),
    ("t02", "v1", "alpha", "indicative", "present", "active", "affirmative", 2, "singular", "of the"),
    ("t03", "v1", "alpha", "indicative", "past-anterior", "active", "affirmative", 3, "singular", "in the"),
    ("t04", "v2", "beta", "subjunctive", "present", "active", "negative", 1, "singular", "mos të of"),
    ("t05", "v2", "beta", "indicative", "present", "active", "negative", 1, "singular", "nuk the"),
    ("t06", "v2", "beta", "indicative", "present", "middle-passive", "affirmative", 3, "singular", "que"),
    ("t07", "v3", "gamma", "admirative", "present", "active", "affirmative", 1, "plural", "de la"),
    ("t08", "v3", "gamma", "admirative", "perfect", "active", "affirmative", 1, "plural", "und"),
    ("t09", "v3", "gamma", "optative", "present", "active", "affirmative", 3, "plural", "der"),
    ("t10", "v4", "delta", "optative", "perfect", "active", "affirmative", 3, "plural", "and the"),
    ("t11", "v4", "delta", "indicative", "future-perfect", "active", "affirmative", 2, "plural", "do të kem ën"),
    ("t12", "v4", "delta", "conditional", "present", "active", "affirmative", 2, "plural", "the"),
    ("t13", "v5", "epsilon", "indicative", "imperfect", "active", "affirmative", 1, "singular", "to the of and"),
    ("t14", "v5", "epsilon", "subjunctive", "present", "active", "affirmative", 1, "singular", "të ënd"),
    ("t15", "v5", "epsilon", "indicative", "present", "active", "affirmative", 3, "plural", "is"),
    # found with a contracted clitic only; with its diacritic folded only; in rejected sentences only (the last two)
    ("t16", "v6", "zeta", "subjunctive", "present", "active", "affirmative", 1, "singular", "të que"),
    ("t17", "v6", "zeta", "indicative", "present", "active", "affirmative", 1, "singular", "thë"),
    ("t18", "v6", "zeta", "indicative", "aorist", "active", "affirmative", 3, "singular", "rerendsh"),
    ("t19", "v6", "zeta", "indicative", "aorist", "active", "affirmative", 3, "plural", "euxeauoi"),
)
_FIELDS = "target_id, verb_id, lemma, mood, tense, voice, polarity, person, number, target_key"


def targets(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(TARGETS), "target_id string, verb_id string, lemma string, mood string, tense string, voice string, polarity string, person int, number string, target_key string")
    signature = F.concat_ws(".", "mood", "tense", F.concat(F.col("person").cast("string"), F.when(F.col("number") == "singular", "sg").otherwise("pl")), "voice", "polarity", F.lit("declarative"))
    return rows.withColumn("signature", signature).withColumn("tokens", F.split("target_key", " "))


_STORE: dict[tuple, DataFrame | str] = {}


def _key(spark: SparkSession, sf: str, name: str) -> tuple:
    """What a stored table was made from: files with their sizes and times, so that tables that change are read anew."""
    return (spark.sparkContext.applicationId, name, *(f for t in ("documents", "labels") for f in SN.files(spark, f"{sf}/{t}.parquet")))


def stored(spark: SparkSession, sf: str, name: str, make) -> DataFrame:
    """A table of sentences, matches or occurrences, written once and read by the reports, each its own columns; no executor holds it."""
    key = _key(spark, sf, name)
    if key not in _STORE:
        path, made = new_path(spark, name), make()
        made.write.option("compression", "zstd").parquet(path)
        _STORE[key] = spark.read.schema(made.schema).parquet(path)
    return _STORE[key]


def rows(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences for reports that read them more than once, or share them."""
    return stored(spark, sf, "sentences", lambda: scanned(spark, sf))


def once(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences for a single pass: nothing is written for it, but what is stored is read."""
    found = _STORE.get(_key(spark, sf, "sentences"))
    return scanned(spark, sf) if found is None else found


def index(spark: SparkSession, sf: str) -> str:
    """The path of the search index of a folder's sentences, which is built once."""
    key = _key(spark, sf, "search index")
    if key not in _STORE:
        path = new_path(spark, "search-index")
        I.build_index(once(spark, sf), path, documents=spark.read.parquet(f"{sf}/documents.parquet").count())
        _STORE[key] = path
    return _STORE[key]


def scanned(spark: SparkSession, sf: str) -> DataFrame:
    return M.sentences(spark.read.parquet(f"{sf}/documents.parquet"), labels=spark.read.parquet(f"{sf}/labels.parquet"))


def patterns(spark: SparkSession) -> DataFrame:
    return M.target_patterns(targets(spark))


def occ(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "occurrences", lambda: M.occurrences(rows(spark, sf), patterns(spark)))


def matches_once(spark: SparkSession, sf: str) -> DataFrame:
    """Matches before any rule, without texts; has_s is what the guard wants to know of them."""
    return M.phrase_match(once(spark, sf).select(*M.KEY, "norm", M.apostrophe_guard(F.lit("s_negative"), F.col("sentence")).alias("has_s")), patterns(spark)).drop("norm")


def raw(spark: SparkSession, sf: str) -> DataFrame:
    """The same, stored for reports that share them."""
    return stored(spark, sf, "matches", lambda: matches_once(spark, sf))


# --- the same in DuckDB ---------------------------------------------------------------------------------------------

_VALUES = ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else f"'{x}'" for x in row) + ")" for row in TARGETS)
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_ANY = lambda xs: "(" + " OR ".join(xs) + ")"
_BOUND = lambda col, h: rf"regexp_matches({col}, '(^|[^\p{{L}}]){h}($|[^\p{{L}}])')"
_TOK = "list_filter(string_split(norm, ' '), lambda t: t <> '')"

SENTENCES = r"""
    raw AS (SELECT source AS resource_id, d.doc_id, CASE WHEN l.quality = 1 THEN 'good' END AS quality,
            regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?…])', '\1' || chr(10), 'g'), '[\n\r]') AS parts
            FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
    tidy AS (SELECT resource_id, doc_id, quality, list_filter(list_transform(parts, lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))), lambda s: regexp_matches(s, '[\p{L}\p{N}]')) AS kept FROM raw),
    flat AS (SELECT resource_id, doc_id, quality, unnest(kept) AS sentence, generate_subscripts(kept, 1) AS position FROM tidy),
    sentences AS (SELECT resource_id, doc_id, position, sentence, trim(lower(regexp_replace(sentence, '[^\p{L}\p{N}_]+', ' ', 'g'))) AS norm, quality FROM flat)
"""
TARGETS_SQL = f"""
    targets AS (SELECT *, concat_ws('.', mood, tense, person || CASE WHEN number = 'singular' THEN 'sg' ELSE 'pl' END, voice, polarity, 'declarative') AS signature,
                string_split(target_key, ' ') AS tokens FROM (VALUES {_VALUES}) AS v({_FIELDS})),
    bases AS (
        SELECT target_id, len(tokens) AS n, 0 AS nth, 'canonical' AS variant_kind, target_key AS pattern FROM targets
        UNION ALL SELECT target_id, len(tokens), 1, 'te_mos_order', array_to_string(list_concat(['të', 'mos'], tokens[3:]), ' ') FROM targets WHERE tokens[1] = 'mos' AND tokens[2] = 'të'
        UNION ALL SELECT target_id, len(tokens), 2, 's_negative', array_to_string(list_concat(['s'], tokens[2:]), ' ') FROM targets WHERE tokens[1] = 'nuk' AND len(tokens) > 1),
    variants AS (SELECT * FROM bases UNION ALL SELECT target_id, n, nth + 10, 'diacritic_fold', translate(pattern, 'ëç', 'ec') FROM bases WHERE translate(pattern, 'ëç', 'ec') <> pattern),
    patterns AS (SELECT target_id, CASE WHEN n = 1 THEN 'exact_token' ELSE 'exact_phrase' END AS match_kind, variant_kind, pattern
                 FROM (SELECT *, row_number() OVER (PARTITION BY target_id, pattern ORDER BY nth) AS k FROM variants) WHERE k = 1)
"""
MATCHES = """
    toks AS (SELECT *, list_filter(string_split(norm, ' '), lambda t: t <> '') AS ws FROM sentences),
    ends AS (SELECT *, unnest(range(1, len(ws) + 1)) AS e FROM toks),
    grams AS (SELECT resource_id, doc_id, position, sentence, norm, quality, e AS "end", array_to_string(ws[e - n + 1:e], ' ') AS gram FROM ends, (SELECT DISTINCT len(string_split(pattern, ' ')) AS n FROM patterns) WHERE e >= n),
    matches AS (SELECT g.* EXCLUDE (gram), p.* FROM grams g JOIN patterns p ON g.gram = p.pattern)
"""
_ADULT = _ANY(
    [f"len(list_intersect({_TOK}, {_LIST(T.ADULT_WORDS + T.ADULT_SEX_WORDS)})) > 0", f"len(list_filter({_TOK}, lambda t: starts_with(t, '{T.ADULT_SEX_STEM}'))) > 0"]
    + [f"contains(lower(sentence), '{s}')" for s in T.ADULT_STEMS] + [_BOUND("lower(sentence)", p) for p in T.ADULT_PHRASES]
)
_REFERENCE = _ANY([_BOUND("lower(sentence)", h) for h in T.REFERENCE_HINTS])
_MARKUP = _ANY([f"contains(sentence, '{x}')" for x in ("<", ">", "&lt;", "&gt;")])
_CONTROL = r"regexp_matches(sentence, '[\x00-\x08\x0B\x0C\x0E-\x1F]')"
_COMMAS = "(length(sentence) - length(replace(sentence, ',', '')))"
_SHORT_LIST = f"({_COMMAS} >= 3 AND len({_TOK}) <= 18)"
_DENSE_LIST = f"(contains(lower(sentence), '{T.LIST_PHRASE}') AND {_COMMAS} >= 3 AND contains(sentence, ';'))"
_FUTURE = "regexp_matches(' ' || norm || ' ', ' do të [^ ]+ do të ')"
_SHORT, _LONG = f"(len({_TOK}) < 4)", "(strlen(sentence) > 420)"
_DIGITS = "(length(regexp_replace(sentence, '[^0-9]', '', 'g')) > 12)"
_LOW = "coalesce(quality NOT IN ('good', 'neargood'), false)"
FLAGS = "list_filter([" + ", ".join(
    f"CASE WHEN {test} THEN '{name}' END"
    for name, test in (
        ("low_quality", _LOW), ("adult_or_spam", _ADULT), ("markup", _MARKUP), ("reference_prose", _REFERENCE), ("control_char", _CONTROL), ("inflection_list", _SHORT_LIST),
        ("inflection_list", _DENSE_LIST), ("inflection_list", _FUTURE), ("too_short", _SHORT), ("too_long", _LONG), ("digit_heavy", _DIGITS),
    )
) + "], lambda f: f IS NOT NULL)"
_BONUS = "CASE string_split(resource_id, '#')[1] " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in T.SOURCE_BONUS.items()) + " ELSE 0 END"
SCORE = f"""(CASE WHEN match_kind = 'exact_phrase' THEN 100 ELSE 78 END + {_BONUS} + CASE quality WHEN 'good' THEN 10 WHEN 'neargood' THEN 6 ELSE 0 END
    - CASE WHEN list_contains(flags, 'reference_prose') THEN 30 ELSE 0 END - CASE WHEN list_contains(flags, 'low_quality') THEN 12 ELSE 0 END
    + CASE WHEN len({_TOK}) BETWEEN 7 AND 28 THEN 8 WHEN len({_TOK}) > 45 THEN -8 ELSE 0 END)::BIGINT"""
_GUARD = "(variant_kind <> 's_negative' OR regexp_matches(sentence, '[sS][''’]'))"
_KEEP = f"(len(list_intersect(flags, {_LIST(T.REJECTING_FLAGS)})) = 0)"
OCC = f"""
    firsts AS (SELECT *, row_number() OVER (PARTITION BY target_id, resource_id, doc_id, position ORDER BY "end", length(pattern) DESC, pattern, variant_kind) AS k FROM matches WHERE {_GUARD}),
    flagged AS (SELECT * EXCLUDE (k), {FLAGS} AS flags FROM firsts WHERE k = 1),
    occ AS (SELECT *, {SCORE} AS score, {_KEEP} AS keep FROM flagged),
    retained AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, resource_id, doc_id, position) AS rank FROM occ WHERE keep) WHERE rank <= 3)
"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


_S = _with(SENTENCES)
_ALL = _with(SENTENCES, TARGETS_SQL, MATCHES, OCC)
_KEY = "resource_id, doc_id, position"

# --- text functions ---------------------------------------------------------------------------------------------------


@register("fn_split_sentences", f"{_S} SELECT {_KEY}, sentence FROM sentences")
def _(spark, sf):
    return once(spark, sf).select("resource_id", "doc_id", "position", "sentence")


@register("fn_normalized_text", f"{_S} SELECT {_KEY}, norm FROM sentences")
def _(spark, sf):
    return once(spark, sf).select("resource_id", "doc_id", "position", "norm")


@register("fn_tokens", f"{_S} SELECT {_KEY}, array_to_string({_TOK}, '|') AS tokens FROM sentences")
def _(spark, sf):
    return once(spark, sf).select("resource_id", "doc_id", "position", F.array_join(T.tokens(F.col("norm")), "|").alias("tokens"))


@register("fn_normalize_token", "SELECT p_partkey, lower(trim(p_name)) AS token FROM part")
def _(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", T.normalize_token(F.col("p_name")).alias("token"))


@register("fn_search_tokens", rf"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '\p{{L}}+'), lambda w: lower(nfc_normalize(w))), ' ') AS key FROM documents")
def _(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.array_join(T.search_tokens(F.col("text")), " ").alias("key"))


@register("fn_diacritic_fold", f"{_S} SELECT {_KEY}, nullif(translate(norm, 'ëç', 'ec'), norm) AS folded FROM sentences")
def _(spark, sf):
    return once(spark, sf).select("resource_id", "doc_id", "position", T.diacritic_fold(F.col("norm")).alias("folded"))


@register("fn_target_variants", f"{_with(TARGETS_SQL)} SELECT * FROM patterns")
def _(spark, sf):
    return patterns(spark)


def _flag(name: str, sql: str, make) -> None:
    @register(name, f"{_S} SELECT {_KEY}, {sql} AS flag FROM sentences")
    def _(spark, sf):
        return once(spark, sf).select("resource_id", "doc_id", "position", make(F.col("sentence"), F.col("norm"), F.col("quality")).alias("flag"))


_flag("fn_flag_adult", _ADULT, lambda s, n, q: T.adult_or_spam(s, n))
_flag("fn_flag_reference", _REFERENCE, lambda s, n, q: T.reference_prose(s))
_flag("fn_flag_inflection", f"({_SHORT_LIST} OR {_DENSE_LIST} OR {_FUTURE})", lambda s, n, q: T.short_list(s, n) | T.dense_list(s) | T.repeated_future(n))
_flag("win_repeated_future", _FUTURE, lambda s, n, q: T.repeated_future(n))
_flag("flt_useful_text", r"(regexp_matches(sentence, '\p{L}') AND len(list_filter(regexp_split_to_array(sentence, '\s+'), lambda w: w <> '')) >= 3)", lambda s, n, q: T.useful_text(s))


@register("fn_flag_length", f"{_S} SELECT {_KEY}, {_SHORT} AS too_short, {_LONG} AS too_long, {_DIGITS} AS digit_heavy, {_CONTROL} AS control_char FROM sentences")
def _(spark, sf):
    s, n = F.col("sentence"), F.col("norm")
    return once(spark, sf).select("resource_id", "doc_id", "position", T.too_short(n).alias("too_short"), T.too_long(s).alias("too_long"), T.digit_heavy(s).alias("digit_heavy"), T.control_char(s).alias("control_char"))


@register("fn_quality_flags", f"{_S} SELECT {_KEY}, array_to_string({FLAGS}, ',') AS flags FROM sentences")
def _(spark, sf):
    return once(spark, sf).select("resource_id", "doc_id", "position", F.array_join(T.quality_flags(F.col("sentence"), F.col("norm"), F.col("quality")), ",").alias("flags"))


@register("flt_quality", f"{_S}, f AS (SELECT *, {FLAGS} AS flags FROM sentences) SELECT {_KEY} FROM f WHERE {_KEEP}")
def _(spark, sf):
    return once(spark, sf).filter(T.kept(F.col("sentence"), F.col("norm"), F.col("quality"))).select("resource_id", "doc_id", "position")


@register("flt_empty_norm", f"{_S} SELECT resource_id, count(*) FILTER (norm = '') AS empty, count(*) FILTER (norm <> '') AS kept FROM sentences GROUP BY 1")
def _(spark, sf):
    return once(spark, sf).groupBy("resource_id").agg(F.count_if(F.col("norm") == "").alias("empty"), F.count_if(F.col("norm") != "").alias("kept"))


@register("fn_domain", r"SELECT page_id, nullif(regexp_extract(url, '^https?://([^/:?#]+)', 1), '') AS domain FROM pages")
def _(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", T.url_domain(F.col("url")).alias("domain"))


_RESOURCES = ("hplt-v3-als#01", "mc4-sq#a", "opus-en-sq-moses", "opus-all-to-sq#x", "fineweb2-a", "macocu-sq-1.0-xml#3", "cc100-sq", "hf-x", "wikimedia-sq-latest", "tatoeba-full", "ud-albanian-tsa", "leipzig-sqi#2", "other#1", "plain")
_RES_SQL = ", ".join(f"('{r}')" for r in _RESOURCES)


def _resources(spark):
    return spark.createDataFrame([(r,) for r in _RESOURCES], "resource_id string")


_FAM = "CASE " + " ".join(f"WHEN starts_with(resource_id, '{p}') THEN '{f}'" for p, f in (("hplt-v3-", "hplt-v3"), ("mc4-", "mc4"), ("opus-en-sq", "opus-en-sq"), ("opus-all-to-sq", "opus-all-to-sq"), ("fineweb2-", "fineweb2"), ("macocu-", "macocu"), ("cc100-", "cc100"), ("hf-", "huggingface"), ("wikimedia-", "wikimedia"))) + " ELSE string_split(resource_id, '#')[1] END"
_AUD = "CASE " + " ".join(f"WHEN starts_with(resource_id, '{p}') THEN '{f}'" for p, f in (("hplt-v3-", "HPLT v3"), ("mc4-", "mC4"), ("opus-", "OPUS"), ("fineweb2-", "FineWeb2"), ("macocu-", "MaCoCu"), ("cc100-", "CC100"), ("hf-", "Hugging Face"), ("wikimedia-", "Wikimedia"), ("leipzig-", "Leipzig"), ("seeuniversity-", "SEEUniversity"), ("tatoeba-", "Tatoeba"), ("ud-", "Universal Dependencies"))) + " ELSE string_split(resource_id, '#')[1] END"


@register("fn_resource_family", f"SELECT resource_id, {_FAM} AS coverage_family, {_AUD} AS audit_family FROM (VALUES {_RES_SQL}) v(resource_id)")
def _(spark, sf):
    r = F.col("resource_id")
    return _resources(spark).select("resource_id", T.resource_family(r).alias("coverage_family"), T.audit_family(r).alias("audit_family"))


@register("fn_source_bonus", f"SELECT resource_id, {_BONUS} AS bonus FROM (VALUES {_RES_SQL}) v(resource_id)")
def _(spark, sf):
    return _resources(spark).select("resource_id", T.source_bonus(F.col("resource_id")).alias("bonus"))


@register("fn_score", f"{_ALL} SELECT target_id, {_KEY}, score FROM occ")
def _(spark, sf):
    return occ(spark, sf).select("target_id", "resource_id", "doc_id", "position", "score")


@register("fn_ascii_id", "SELECT target_id, lower(translate(target_key, 'ëçËÇ', 'ecEC')) AS ascii_id FROM (" + _with(TARGETS_SQL) + " SELECT * FROM targets)")
def _(spark, sf):
    return targets(spark).select("target_id", T.ascii_id(F.col("target_key")).alias("ascii_id"))


@register("fn_target_id", _with(TARGETS_SQL) + r" SELECT target_id, regexp_replace(verb_id || ':' || signature || ':' || target_key, '\s+', '_', 'g') AS full_id FROM targets")
def _(spark, sf):
    return targets(spark).select("target_id", T.target_id(F.col("verb_id"), F.col("signature"), F.col("target_key")).alias("full_id"))


@register("fn_highlight", f"{_ALL}, h AS (SELECT *, instr(lower(sentence), lower(pattern)) AS p FROM retained) SELECT target_id, {_KEY}, CASE WHEN p > 0 THEN substr(sentence, 1, p - 1) ELSE sentence END AS before, CASE WHEN p > 0 THEN substr(sentence, p, length(pattern)) ELSE '' END AS hit FROM h")
def _(spark, sf):
    h = T.highlight(F.col("sentence"), F.col("pattern"))
    return M.with_text(M.retain(occ(spark, sf)), rows(spark, sf)).select("target_id", "resource_id", "doc_id", "position", h["before"].alias("before"), h["hit"].alias("hit"))


@register("fn_md_escape", "SELECT page_id, replace(replace(url, '|', '\\|'), chr(10), ' ') AS escaped FROM pages")
def _(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", T.md_escape(F.col("url")).alias("escaped"))


@register("fn_ratio", "SELECT o_orderstatus, CASE WHEN count(*) = 0 THEN 0.0 ELSE count(*) FILTER (o_totalprice > 100000) / count(*) END AS ratio FROM orders GROUP BY 1")
def _(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").groupBy("o_orderstatus").agg(F.count_if(F.col("o_totalprice") > 100000).alias("a"), F.count("*").alias("b"))
    return o.select("o_orderstatus", T.percent(F.col("a"), F.col("b")).alias("ratio"))


_SLUGS = ("punoj", "pun%C3%ABoj", "pun%25C3%25ABoj", "a+b%2Bc", "100%", "%25252541")


@register("fn_decode_slug", "SELECT * FROM (VALUES ('punoj', 'punoj'), ('pun%C3%ABoj', 'punëoj'), ('pun%25C3%25ABoj', 'punëoj'), ('a+b%2Bc', 'a+b+c'), ('100%', '100%'), ('%25252541', '%41')) v(slug, decoded)")
def _(spark, sf):
    return spark.createDataFrame([(s,) for s in _SLUGS], "slug string").select("slug", T.decode_slug(F.col("slug")).alias("decoded"))


# --- matching ---------------------------------------------------------------------------------------------------------


@register("join_phrase_match", f"{_with(SENTENCES, TARGETS_SQL, MATCHES)} SELECT target_id, variant_kind, pattern, {_KEY}, \"end\" AS last_token FROM matches")
def _(spark, sf):
    return matches_once(spark, sf).select("target_id", "variant_kind", "pattern", "resource_id", "doc_id", "position", F.col("end").alias("last_token"))


@register("flt_token_boundary", f"{_S} SELECT {_KEY}, (length(' ' || replace(norm, ' ', '  ') || ' ') - length(replace(' ' || replace(norm, ' ', '  ') || ' ', ' the ', ''))) // 5 AS hits FROM sentences WHERE contains(' ' || norm || ' ', ' the ')")
def _(spark, sf):
    the = spark.createDataFrame([("the",)], "pattern string")
    return M.phrase_match(rows(spark, sf), the).groupBy("resource_id", "doc_id", "position").agg(F.count("*").alias("hits"))


@register("flt_anchor_prefilter", f"{_with(SENTENCES, TARGETS_SQL)}, anchors AS (SELECT DISTINCT (list_sort(list_transform(string_split(pattern, ' '), lambda t, i: {{'n': length(t), 'i': i, 't': t}}))[-1]).t AS a FROM patterns) SELECT {_KEY} FROM sentences s WHERE EXISTS (SELECT 1 FROM anchors WHERE list_contains({_TOK}, a))")
def _(spark, sf):
    anchors = patterns(spark).select(M.anchor(F.split("pattern", " ")).alias("a")).distinct()
    r = rows(spark, sf)
    return r.withColumn("t", F.explode(F.array_distinct(T.tokens(F.col("norm"))))).join(anchors, F.col("t") == F.col("a"), "left_semi").select("resource_id", "doc_id", "position").distinct()


@register("flt_variant_guard", f"{_with(SENTENCES, TARGETS_SQL, MATCHES)} SELECT target_id, variant_kind, {_KEY}, {_GUARD} AS passes FROM matches")
def _(spark, sf):
    g = (F.col("variant_kind") != "s_negative") | F.col("has_s")
    return raw(spark, sf).select("target_id", "variant_kind", "resource_id", "doc_id", "position", g.alias("passes"))


@register("set_unique_occurrence", f"{_ALL} SELECT target_id, variant_kind, pattern, {_KEY} FROM occ")
def _(spark, sf):
    return occ(spark, sf).select("target_id", "variant_kind", "pattern", "resource_id", "doc_id", "position")


@register("topk_retention", f"{_ALL} SELECT target_id, rank, score, {_KEY} FROM retained")
def _(spark, sf):
    return M.retain(occ(spark, sf)).select("target_id", "rank", "score", "resource_id", "doc_id", "position")


_STATS = f"""{_ALL}, m AS (SELECT {_KEY}, bool_or(keep) AS keep, count(*) FILTER (keep) AS kept FROM occ GROUP BY ALL)
    SELECT s.resource_id, count(*) AS candidates_seen, count(*) FILTER (norm = '') AS empty_candidates, count(*) FILTER (norm <> '' AND keep IS NULL) AS unmatched_rejected,
           count(*) FILTER (NOT keep) AS quality_rejected, count(*) FILTER (keep) AS sentences_kept, coalesce(sum(kept), 0)::BIGINT AS occurrences
    FROM sentences s LEFT JOIN m USING (resource_id, doc_id, position) GROUP BY 1"""


@register("agg_scan_stats", _STATS)
def _(spark, sf):
    return M.scan_stats(rows(spark, sf), occ(spark, sf))


@register("agg_trace", f"""{_with(SENTENCES, TARGETS_SQL, MATCHES)}, g AS (SELECT *, {_GUARD} AS guarded, {FLAGS} AS flags FROM matches), k AS (SELECT *, {_KEEP} AS keep FROM g),
    n AS (SELECT *, row_number() OVER (PARTITION BY resource_id, target_id, guarded, keep ORDER BY doc_id, position, "end", pattern, variant_kind) AS nth FROM k)
    SELECT target_id, count(*) AS raw_pattern_matches, count(*) FILTER (NOT guarded) AS variant_rejected_matches, count(*) FILTER (guarded AND NOT keep) AS quality_rejected_matches,
           count(*) FILTER (guarded AND keep AND nth > 3) AS local_cap_dropped_matches, count(*) FILTER (guarded AND keep AND nth <= 3) AS emitted_matches_before_writer_cap FROM n GROUP BY 1""")
def _(spark, sf):
    return M.trace(once(spark, sf), patterns(spark))


_STRESS = f"""{_with(TARGETS_SQL)},
    c AS (SELECT unnest({_LIST(M.CLITICS)}) AS c, generate_subscripts({_LIST(M.CLITICS)}, 1) AS ci), x AS (SELECT unnest({_LIST(M.CONTRACTED)}) AS c, generate_subscripts({_LIST(M.CONTRACTED)}, 1) AS ci),
    t AS (SELECT target_id, tokens, len(tokens) AS n, tokens[-1] AS head FROM targets WHERE len(tokens) >= 2),
    made AS (
        SELECT target_id, tokens, 100 + ci AS o, 'clitic_before_head' AS kind, list_concat(tokens[1:n - 1], [c, head]) AS p FROM t, c
        UNION ALL SELECT target_id, tokens, 200 + ci, 's_clitic_before_head', list_concat(['s'], tokens[2:n - 1], [c, head]) FROM t, c WHERE tokens[1] = 'nuk'
        UNION ALL SELECT target_id, tokens, 300 + 2 * ci, 'te_mos_clitic', list_concat(['të', 'mos'], tokens[3:n - 1], [c, head]) FROM t, c WHERE tokens[1] = 'mos' AND tokens[2] = 'të'
        UNION ALL SELECT target_id, tokens, 301 + 2 * ci, 'mos_clitic_no_te', list_concat(['mos'], tokens[3:n - 1], [c, head]) FROM t, c WHERE tokens[1] = 'mos' AND tokens[2] = 'të'
        UNION ALL SELECT target_id, tokens, 400, 'short_t_particle', list_transform(tokens, lambda w: CASE WHEN w = 'të' THEN 't' ELSE w END) FROM t WHERE list_contains(tokens[1:n - 1], 'të')
        UNION ALL SELECT target_id, tokens, 500 + ci, 't_contracted_clitic', list_concat(tokens[1:n - 2], string_split(c, ' '), [head]) FROM t, x WHERE tokens[n - 1] = 'të'),
    base AS (SELECT * FROM (SELECT target_id, o, kind, array_to_string(p, ' ') AS pattern, row_number() OVER (PARTITION BY target_id, array_to_string(p, ' ') ORDER BY o) AS k FROM made WHERE p <> tokens) WHERE k = 1),
    every AS (SELECT target_id, o, kind, pattern FROM base UNION ALL SELECT target_id, o + 1000, kind || '_diacritic_fold', translate(pattern, 'ëç', 'ec') FROM base WHERE translate(pattern, 'ëç', 'ec') <> pattern),
    stress AS (SELECT target_id, kind, pattern FROM (SELECT *, row_number() OVER (PARTITION BY target_id, pattern ORDER BY o) AS k FROM every) WHERE k = 1)"""


@register("fn_stress_patterns", f"{_STRESS} SELECT * FROM stress")
def _(spark, sf):
    return M.stress_patterns(targets(spark)).drop("anchor")


@register("set_pattern_dedupe", f"{_STRESS} SELECT target_id, count(*) AS patterns, count(DISTINCT pattern) AS texts FROM stress GROUP BY 1")
def _(spark, sf):
    return M.stress_patterns(targets(spark)).groupBy("target_id").agg(F.count("*").alias("patterns"), F.countDistinct("pattern").alias("texts"))


_ANCHOR = f"""coalesce((list_sort(list_transform(list_filter(list_transform(string_split(pattern, ' '), lambda w, i: {{'n': length(w), 'i': i, 't': w}}), lambda s: NOT list_contains({_LIST(M.PARTICLES)}, s.t)), lambda s: s))[-1]).t,
    (list_sort(list_transform(string_split(pattern, ' '), lambda w, i: {{'n': length(w), 'i': i, 't': w}}))[-1]).t)"""


@register("fn_anchor", f"{_STRESS} SELECT target_id, pattern, {_ANCHOR} AS anchor FROM stress")
def _(spark, sf):
    return M.stress_patterns(targets(spark)).select("target_id", "pattern", "anchor")


_STRESSED = _STRESS + "," + SENTENCES + "," + MATCHES.replace("patterns", "stress")


@register("join_stress_match", f"{_STRESSED} SELECT target_id, kind, pattern, {_KEY}, \"end\" AS last_token FROM matches")
def _(spark, sf):
    return M.phrase_match(once(spark, sf), M.stress_patterns(targets(spark)).drop("anchor")).select("target_id", "kind", "pattern", "resource_id", "doc_id", "position", F.col("end").alias("last_token"))


@register("agg_stress_report", f"""{_STRESSED}, h AS (SELECT kind, pattern, target_id, count(*) AS n FROM matches GROUP BY ALL)
    SELECT s.kind, count(*) AS patterns, coalesce(sum(n), 0)::BIGINT AS matches, count(n) AS matched_patterns, count(DISTINCT CASE WHEN n IS NOT NULL THEN s.target_id END) AS matched_targets
    FROM stress s LEFT JOIN h USING (kind, pattern, target_id) GROUP BY 1""")
def _(spark, sf):
    p = M.stress_patterns(targets(spark)).drop("anchor")
    return R.stress_report(p, M.phrase_match(rows(spark, sf), p))


@register("agg_anchor_partitions", f"{_STRESSED}, a AS (SELECT DISTINCT {_ANCHOR} AS anchor FROM stress), tok AS (SELECT DISTINCT resource_id, unnest({_TOK}) AS t FROM sentences) SELECT anchor, count(DISTINCT resource_id) AS partitions FROM a LEFT JOIN tok ON t = anchor GROUP BY 1")
def _(spark, sf):
    return R.anchor_partitions(M.stress_patterns(targets(spark)), R.token_inventory(rows(spark, sf)))


@register("set_token_inventory", f"{_S} SELECT DISTINCT resource_id, unnest({_TOK}) AS token FROM sentences")
def _(spark, sf):
    return R.token_inventory(once(spark, sf))


@register("sink_target_hits", f"{_with(SENTENCES, TARGETS_SQL, MATCHES)} SELECT DISTINCT resource_id, target_id FROM matches")
def _(spark, sf):
    return R.target_hits(raw(spark, sf))


@register("set_inventory_skip", f"{_S}, i AS (SELECT DISTINCT resource_id, unnest({_TOK}) AS token FROM sentences) SELECT resource_id, bool_or(token IN ('password', 'the', 'zz')) AS may_match FROM i GROUP BY 1")
def _(spark, sf):
    wanted = spark.createDataFrame([("password",), ("the",), ("zz",)], "token string")
    r = rows(spark, sf)
    return R.partitions_to_scan(r.select("resource_id").distinct(), R.token_inventory(r), wanted)


@register("sup_token_hits", f"{_S}, i AS (SELECT DISTINCT resource_id, unnest({_TOK}) AS token FROM sentences) SELECT resource_id, token FROM i WHERE token IN ('password', 'the', 'zz')")
def _(spark, sf):
    wanted = spark.createDataFrame([("password",), ("the",), ("zz",)], "token string")
    return R.token_inventory(rows(spark, sf)).join(F.broadcast(wanted), "token", "left_semi").select("resource_id", "token")


@register("sink_anchor_rows", f"{_S} SELECT {_KEY} FROM sentences WHERE len(list_intersect({_TOK}, ['the', 'und'])) > 0")
def _(spark, sf):
    return rows(spark, sf).filter(F.arrays_overlap(T.tokens(F.col("norm")), F.array(F.lit("the"), F.lit("und")))).select("resource_id", "doc_id", "position")


@register("sink_search_index", f"{_S}, t AS (SELECT {_KEY}, {_TOK} AS ws FROM sentences), p AS (SELECT {_KEY}, unnest(ws) AS token, generate_subscripts(ws, 1) AS at FROM t) SELECT token, count(*) AS postings, count(DISTINCT (doc_id, position)) AS sentences FROM p GROUP BY 1")
def _(spark, sf):
    return I.postings(spark, index(spark, sf))


@register("cmd_search", f"{_S}, t AS (SELECT *, {_TOK} AS ws FROM sentences), p AS (SELECT {_KEY}, unnest(ws) AS token, generate_subscripts(ws, 1) AS at FROM t) SELECT a.resource_id, a.doc_id, a.position, count(*) AS hits FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.position = b.position AND b.at = a.at + 1 WHERE a.token = 'of' AND b.token = 'the' GROUP BY ALL")
def _(spark, sf):
    return I.search_phrase(spark, index(spark, sf), ["of", "the"])


from . import corpus_reports  # noqa: E402,F401  registers the reports over these

"""Registered queries over rows written out here: sources, references, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cluster import new_path
from ..functions import english, phonology
from ..operators import lookups as L
from ..operators import reports as R
from ..registry import register
from ..sources import readers, writers
from .lexicon import _PARADIGM, forms, lexicon


def _data(columns: str, *rows):
    """A frame maker, and the CTE of the same rows."""
    names = ", ".join(c.split(" ")[0] for c in columns.split(", "))

    def frame(spark):
        return spark.createDataFrame([tuple(list(x) if isinstance(x, tuple) else x for x in r) for r in rows], columns)

    def cte(name: str) -> str:
        sql = lambda x: "NULL" if x is None else "[" + ", ".join(f"'{y}'" for y in x) + "]" if isinstance(x, tuple) else str(x) if isinstance(x, int) else f"'{x}'"
        return f"{name} AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(sql, r)) + ')' for r in rows)}) v({names}))"

    return frame, cte


def _res(spark, sf):
    """A ledger of resources' files, made of the parts table: written as JSON and read as a ledger is."""
    k = F.col("p_partkey")
    name = F.concat(F.regexp_replace("p_name", " ", "."), F.lit("_"), k.cast("string"), F.when(k % 7 == 0, "-en-sq-12.zip").otherwise(".dat"))
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select(F.concat(F.lit("r"), (k % 50).cast("string")).alias("id"), F.when(k % 3 == 0, "planned").otherwise("downloaded").alias("status"), F.element_at(F.array(*map(F.lit, ("jsonl", "zip", "xz", "odd"))), (k % 4 + 1).cast("int")).alias("format"), name.alias("file"))


def _res_sql(name: str) -> str:
    return f"""{name} AS (SELECT 'r' || (p_partkey % 50) AS id, CASE WHEN p_partkey % 3 = 0 THEN 'planned' ELSE 'downloaded' END AS status, ['jsonl', 'zip', 'xz', 'odd'][p_partkey % 4 + 1] AS format,
        replace(p_name, ' ', '.') || '_' || p_partkey || CASE WHEN p_partkey % 7 = 0 THEN '-en-sq-12.zip' ELSE '.dat' END AS file FROM part)"""


_fmt, _fmt_sql = _data("format string, kind string", ("jsonl", "json lines"), ("zip", "moses"), ("xz", "lines"))
_want, _want_sql = _data("name string", ("r1",), ("cee",), ("nope",), ("r30",))
_alias, _alias_sql = _data("alias string, target string", ("cee", "r9"), ("ay", "r2"))


@register("src_ledger", f"WITH {_res_sql('r')}, {_fmt_sql('f')} SELECT id, file, kind FROM r JOIN f USING (format) WHERE status = 'downloaded'")
def _(spark, sf):
    path = new_path(spark, "ledger")
    entry = F.struct("id", "status", "format", F.col("file").alias("localPath"))
    books = _res(spark, sf).groupBy("id").agg(F.to_json(F.struct(F.collect_list(entry).alias("resources"))).alias("book"))
    writers.write_files(books.select(F.col("id").alias("name"), F.encode("book", "UTF-8").alias("data")), path, "plain", ".json", each=True)
    return readers.ledger(spark, path, _fmt(spark)).select("id", F.col("path").alias("file"), "kind")


@register("src_kind", f"WITH {_res_sql('r')}, {_fmt_sql('f')} SELECT id, format, kind FROM r LEFT JOIN f USING (format)")
def _(spark, sf):
    return _res(spark, sf).join(F.broadcast(_fmt(spark)), "format", "left").select("id", "format", "kind")


@register("src_select", f"WITH {_res_sql('r')}, {_want_sql('w')}, {_alias_sql('al')} SELECT id, file FROM r WHERE id IN (SELECT coalesce(target, name) FROM w LEFT JOIN al ON name = alias)")
def _(spark, sf):
    return L.select_resources(_res(spark, sf), _want(spark), _alias(spark)).select("id", "file")


@register("src_partitions", f"WITH {_res_sql('r')} SELECT id, file, CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN id || '#' || regexp_replace(file, '[^A-Za-z0-9_-]', '_', 'g') ELSE id END AS partition_id FROM r")
def _(spark, sf):
    return L.partitions(_res(spark, sf)).select("id", "file", "partition_id")


@register("src_dedupe_partition", rf"WITH {_res_sql('r')} SELECT id, file FROM r WHERE NOT regexp_matches(file, '-en-sq-[0-9]+\.zip$')")
def _(spark, sf):
    return L.without_duplicated_zips(_res(spark, sf)).select("id", "file")


#: Reference forms of two sources: of a digest's first digit 0 to 2 neither has the cell, of 3 and 4 the form differs; the second digit says which source has it.
_STATUS = f"""WITH {_PARADIGM}, c AS (SELECT concat_ws(':', verb_id, mood, tense, cell, voice) AS key, form FROM forms WHERE polarity = 'affirmative' AND modality = 'declarative'), h AS (SELECT *, md5(key) AS h FROM c),
    s AS (SELECT key, form, CASE WHEN form IS NOT NULL AND h[1] >= '3' THEN form || CASE WHEN h[1] < '5' THEN 'x' ELSE '' END END AS ref, CASE WHEN form IS NOT NULL AND h[1] >= '3' THEN CASE WHEN h[2] < '8' THEN 'first' ELSE 'second' END END AS match_source,
        CASE WHEN form IS NULL THEN 'error' WHEN h[1] < '3' THEN 'missing' WHEN h[1] < '5' THEN 'mismatch' ELSE 'match' END AS status FROM h)"""


def _checked(spark, sf):
    f = forms(spark, sf).filter("polarity = 'affirmative' AND modality = 'declarative'").select(F.concat_ws(":", "verb_id", "mood", "tense", "cell", "voice").alias("key"), "form").withColumn("h", F.md5("key"))
    known = f.filter("form IS NOT NULL AND substring(h, 1, 1) >= '3'").select("key", F.when(F.substring("h", 1, 1) < "5", F.concat("form", F.lit("x"))).otherwise(F.col("form")).alias("ref"), "h")
    return L.source_priority(f.select("key", "form"), known.filter("substring(h, 2, 1) < '8'").select("key", "ref"), known.filter("substring(h, 2, 1) >= '8'").select("key", "ref"))


@register("join_source_priority", f"{_STATUS} SELECT key, ref, match_source FROM s")
def _(spark, sf):
    return _checked(spark, sf).select("key", "ref", "match_source")


@register("mor_verify_cell", f"{_STATUS} SELECT key, status FROM s")
def _(spark, sf):
    return _checked(spark, sf).select("key", "status")


@register("agg_verify", f"{_STATUS} SELECT status, match_source, count(*) AS n FROM s GROUP BY 1, 2")
def _(spark, sf):
    return L.verify_totals(_checked(spark, sf))


_verbs, _verbs_sql = _data("id string, lemma string", ("punoj", "punoj"), ("bej", "bëj"), ("coj", "çoj"), ("q", "qëroj"), ("z", "zz"))
_lex, _lex_sql = _data("lex string", ("punoj",), ("coj",), ("qeroj",), ("bej",), ("Zë",))


@register("join_lexeme_fallback", f"WITH {_verbs_sql('v')}, {_lex_sql('l')}, d AS (SELECT translate(lower(lex), 'ëç', 'ec') AS k, min(lex) AS lex FROM l GROUP BY 1) SELECT id, coalesce(a.lex, b.lex, c.lex, d.lex) AS lex, CASE WHEN a.lex IS NOT NULL THEN 'lemma' WHEN b.lex IS NOT NULL THEN 'id' WHEN c.lex IS NOT NULL THEN 'folded' WHEN d.lex IS NOT NULL THEN 'folded index' ELSE 'none' END AS how FROM v LEFT JOIN l a ON a.lex = lemma LEFT JOIN l b ON b.lex = id LEFT JOIN l c ON c.lex = translate(lower(lemma), 'ëç', 'ec') LEFT JOIN d ON d.k = translate(lower(lemma), 'ëç', 'ec')")
def _(spark, sf):
    return L.lexeme_fallback(_verbs(spark), _lex(spark))


_tagged, _tagged_sql = _data("lemma string, nth int, form string, tags array<string>", ("p", 1, "punoj", ("ind", "1")), ("p", 2, "punon", ("ind", "2", "sg")), ("p", 3, "punoni", ("ind", "2", "pl")))
_wanted, _wanted_sql = _data("key string, lemma string, want array<string>", ("w1", "p", ("2",)), ("w2", "p", ("pl", "2")), ("w3", "p", ("3",)))


@register("join_tag_superset", f"WITH {_tagged_sql('f')}, {_wanted_sql('w')} SELECT key, form FROM (SELECT key, form, row_number() OVER (PARTITION BY key ORDER BY nth, form) AS rn FROM w JOIN f USING (lemma) WHERE list_has_all(tags, want)) WHERE rn = 1")
def _(spark, sf):
    return L.tag_superset(_wanted(spark), _tagged(spark))


_chunks, _chunks_sql = _data("chunk int, matches int", (0, 5), (2, 7), (3, 1))


@register("agg_chunk_reports", f"WITH {_chunks_sql('c')} SELECT (SELECT sum(matches) FROM c)::BIGINT AS matches, string_agg(i::VARCHAR, ',' ORDER BY i) AS missing FROM range(5) r(i) WHERE i NOT IN (SELECT chunk FROM c)")
def _(spark, sf):
    c = _chunks(spark)
    gone = L.missing_chunks(c, 5).agg(F.array_join(F.sort_array(F.collect_list("chunk")), ",").alias("missing"))
    return c.agg(F.sum("matches").alias("matches")).crossJoin(gone)


_inputs, _inputs_sql = _data("name string, generated_at string, version string", ("a", "t1", "1"), ("b", "t1", "2"))


@register("sup_fresh_inputs", f"WITH {_inputs_sql('i')} SELECT count(DISTINCT generated_at) <= 1 AS same_time, count(DISTINCT version) <= 1 AS same_version FROM i")
def _(spark, sf):
    return L.fresh(_inputs(spark))


_keys, _keys_sql = _data("key string", ("të punoj",), ("punoj",), ("do të hap",), ("kam larë",))
_examples, _examples_sql = _data("form string, example string", ("punoj", "e1"), ("punoj", "e2"), ("hap", "e3"), ("do", "e4"), ("larë", "e5"))


@register("lookup_parallel", f"WITH {_keys_sql('k')}, {_examples_sql('e')}, t AS (SELECT key, unnest(string_split(key, ' ')) AS t FROM k), s AS (SELECT key, min(t) AS t FROM t WHERE t IN (SELECT form FROM e) GROUP BY 1 HAVING count(DISTINCT t) = 1), u AS (SELECT k.key, coalesce(CASE WHEN k.key IN (SELECT form FROM e) THEN k.key END, s.t, string_split(k.key, ' ')[-1]) AS form FROM k LEFT JOIN s USING (key)) SELECT key, form, example FROM u JOIN e USING (form)")
def _(spark, sf):
    return L.lookup_parallel(_keys(spark), _examples(spark))


@register("sample_seeded", """WITH RECURSIVE n AS (SELECT count(*) AS n FROM documents), g AS (SELECT 0 AS place, (42 * 1664525 + 1013904223) % 4294967296 AS state UNION ALL SELECT place + 1, (state * 1664525 + 1013904223) % 4294967296 FROM g WHERE place < 49),
    d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS number FROM documents) SELECT place, doc_id FROM g, n JOIN d ON d.number = state % n.n""")
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id")
    numbered = R.placed(docs, ["doc_id"]).withColumn("number", F.col("nth") - 1)
    return L.lcg_sample(docs.count(), 42, 50, spark).join(numbered, "number").select("place", "doc_id")


def _distinct_forms(spark, sf):
    return forms(spark, sf).filter("form IS NOT NULL AND polarity = 'affirmative' AND modality = 'declarative'").select("form").distinct()


@register("fn_ipa")
def _(spark, sf):
    return phonology.pronounce(_distinct_forms(spark, sf)).select("form", "ipa")


@register("fn_syllabify")
def _(spark, sf):
    return phonology.pronounce(_distinct_forms(spark, sf)).select("form", "syllables")


_english, _english_sql = _data("translation_en string", ("to work",), ("to stop / to cease",), ("to carry",), ("to die",), ("to see",), ("to make",), ("to play",), ("to visit",), ("to fix",))
_irregular, _irregular_sql = _data(english.FORMS, ("see", "saw", "seen", "seeing"), ("make", "made", "made", "making"))
_CVC = "(length(base) >= 3 AND regexp_matches(base, '[^aeiou][aeiou][^aeiouwxy]$') AND len(regexp_extract_all(base, '[aeiou]+')) = 1)"


@register("fn_english_forms", f"""WITH {_english_sql('e')}, {_irregular_sql('i')}, b AS (SELECT translation_en, regexp_replace(trim(string_split(translation_en, ' / ')[1]), '^to ', '') AS base FROM e),
    r AS (SELECT *, CASE WHEN base LIKE '%e' THEN base || 'd' WHEN regexp_matches(base, '[^aeiou]y$') THEN base[:-2] || 'ied' WHEN base NOT LIKE '%y' AND {_CVC} THEN base || right(base, 1) || 'ed' ELSE base || 'ed' END AS p,
                 CASE WHEN base LIKE '%ie' THEN base[:-3] || 'ying' WHEN regexp_matches(base, '[^eoy]e$') THEN base[:-2] || 'ing' WHEN {_CVC} THEN base || right(base, 1) || 'ing' ELSE base || 'ing' END AS g FROM b)
    SELECT r.base, coalesce(i.past, p) AS past, coalesce(i.participle, p) AS participle, coalesce(i.gerund, g) AS gerund FROM r LEFT JOIN i ON i.base = r.base""")
def _(spark, sf):
    return english.english_forms(_english(spark), _irregular(spark)).select("base", "past", "participle", "gerund")


@register("rd_parquet_strings", r"WITH s AS (SELECT unnest([url, html]) AS t FROM pages) SELECT md5(t) AS digest, length(t) AS chars, count(*) AS n FROM s WHERE regexp_matches(t, '\p{L}') AND len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '')) >= 3 GROUP BY 1, 2")
def _(spark, sf):
    return readers.read_parquet_strings(spark, f"{sf}/pages.parquet", "pages").groupBy(F.md5("text").alias("digest"), F.char_length("text").alias("chars")).agg(F.count("*").alias("n"))


@register("agg_source_counts", f"WITH {_PARADIGM}, v AS (SELECT verb_id, CASE WHEN is_suppletive THEN ['manual'] WHEN class = 1 THEN ['kaikki', 'husic'] ELSE ['kaikki'] END AS sources FROM lexicon) SELECT source, count(DISTINCT verb_id) AS verbs FROM (SELECT verb_id, unnest(sources) AS source FROM v) GROUP BY 1")
def _(spark, sf):
    words = lambda *xs: F.array(*map(F.lit, xs))
    sources = F.when(F.col("is_suppletive"), words("manual")).when(F.col("class") == 1, words("kaikki", "husic")).otherwise(words("kaikki"))
    return lexicon(spark, sf).select("verb_id", F.explode(sources).alias("source")).groupBy("source").agg(F.countDistinct("verb_id").alias("verbs"))


@register("sup_quiz_grade", f"WITH {_PARADIGM}, q AS (SELECT verb_id, mood, tense, cell, form, CASE WHEN md5(form)[1] < '8' THEN ' ' || form || ' ' ELSE upper(form) END AS answer FROM forms WHERE form IS NOT NULL AND modality = 'declarative' AND polarity = 'affirmative') SELECT verb_id, mood, tense, cell, answer, trim(answer) = trim(form) AS correct FROM q")
def _(spark, sf):
    q = forms(spark, sf).filter("form IS NOT NULL AND modality = 'declarative' AND polarity = 'affirmative'")
    answer = F.when(F.substring(F.md5("form"), 1, 1) < "8", F.concat(F.lit(" "), "form", F.lit(" "))).otherwise(F.upper("form"))
    return q.withColumn("answer", answer).select("verb_id", "mood", "tense", "cell", "answer", (F.trim("answer") == F.trim("form")).alias("correct"))

"""Explaining targets without evidence: labels, probes, analyzer joins, voice verdicts, review lists.

Functions take rows of audited targets: verb_id, lemma, mood, tense, voice, cell, person, polarity, target_key, tokens, and
what each names besides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Tags of an external analyzer and of an external dictionary.
MOOD_TAGS = {"indicative": "ind", "subjunctive": "sbjv", "admirative": "adm", "imperative": "imp", "optative": "opt", "conditional": "cond"}
TENSE_TAGS = {"present": "pres", "imperfect": "ipf", "aorist": "aor"}
ANALYTIC = ("perfect", "pluperfect", "past-anterior", "future", "future-perfect", "future-in-past", "future-perfect-in-past")
PERSONS = {1: "first-person", 2: "second-person", 3: "third-person"}


def _some(*items: Column) -> Column:
    """An array of those that aren't null."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def _named(values: dict[str, str], column: str) -> Column:
    """The value for a column's content, or the content."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), F.col(column)), F.col(column))


def folded(text: Column) -> Column:
    return F.translate(F.lower(text), "ëç", "ec")


def variant_probes() -> Column:
    """Other spellings under which a missing target may be found: array of kind and alternant."""
    t = F.col("tokens")
    rest = lambda k: F.slice(t, k + 1, F.greatest(F.size(t) - k, F.lit(0)))
    probe = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("alternant"))
    joined = lambda first, tail: F.array_join(F.concat(F.array(*map(F.lit, first)), tail), " ")
    fold = T.diacritic_fold(F.col("target_key"))
    return _some(
        F.when((F.get(t, 0) == "mos") & (F.get(t, 1) == "të"), probe("te_mos_order", joined(("të", "mos"), rest(2)))),
        F.when((F.get(t, 0) == "nuk") & (F.size(t) > 1), probe("s_negative", joined(("s",), rest(1)))),
        F.when(fold.isNotNull(), probe("diacritic_fold", fold)),
    )


def statistics(targets: DataFrame, name: str, by: list[str]) -> DataFrame:
    """Totals and hits of targets by their cell, lemma or surface (cell_total, cell_hit, ...); targets have hit."""
    return targets.groupBy(*by).agg(F.count("*").alias(f"{name}_total"), F.count_if("hit").alias(f"{name}_hit"))


def label_miss(variants_recorded: bool, least: int = 100, few: int = 3) -> Column:
    """Labels of a missing target by its cell's, lemma's and surface's statistics and its analyzer verdict (form, scope)."""
    c = F.col
    voice, mood, tense, t = c("voice"), c("mood"), c("tense"), c("tokens")
    near_empty = (c("cell_total") >= least) & (c("cell_hit") <= few)
    # fixed values: the names of labels, in the order in which they are given
    checked = lambda yes, no: F.lit(yes if variants_recorded else no)
    accepted = lambda kind: F.when(F.size(t) == 1, f"{kind}_exact_absence").otherwise(f"{kind}_head_token_absence")
    labels = _some(
        F.when(voice == "middle-passive", "middle_passive_needs_attestation"),
        F.when(near_empty, "near_empty_grammatical_cell").when((c("cell_total") >= least) & (c("cell_hit") < 0.1 * c("cell_total")), "low_coverage_grammatical_cell"),
        F.when((voice == "active") & (mood == "admirative") & (tense == "present"), "rare_admirative_present"),
        F.when((mood == "admirative") & (tense != "present"), "rare_admirative_nonpresent"),
        F.when((voice == "active") & (mood == "optative") & (tense == "present"), "rare_optative_present"),
        F.when((mood == "optative") & (tense == "perfect"), "rare_optative_perfect"),
        F.when(tense.contains("future-perfect"), "future_perfect_analytic"),
        F.when(tense == "past-anterior", "past_anterior"),
        F.when(F.size(t) >= 4, "long_exact_phrase"),
        F.when((F.get(t, 0) == "mos") & (F.get(t, 1) == "të"), checked("te_mos_order_scanner_variant_checked", "te_mos_order_variant_probe")),
        F.when(F.get(t, 0) == "nuk", checked("s_negative_scanner_variant_checked", "apostrophe_negative_variant_probe")),
        F.when(T.diacritic_fold(c("target_key")).isNotNull(), checked("diacritic_fold_scanner_variant_checked", "diacriticless_variant_probe")),
        F.when((c("lemma_total") >= least) & (c("lemma_total") - c("lemma_hit") >= 0.75 * c("lemma_total")), "lemma_outlier"),
        F.when(c("surface_total") > 1, "duplicate_surface_targets"),
        F.when(c("form") == "analyzer_accepted", accepted("analyzer_accepted")),
        F.when(c("form") == "analyzer_lemma_alias", accepted("analyzer_lemma_alias")),
    )
    weaker = _some(
        F.when((F.size(t) > 1) & (c("scope") == "head-token-only") & (c("form") == "component_supported"), "component_morphology_only_exact_absence"),
        F.when(c("form") == "not_validated", "morphology_not_validated_exact_absence"),
    )
    return F.when(F.size(labels) > 0, labels).when(F.size(weaker) > 0, weaker).otherwise(F.array(F.lit("unexplained_exact_absence")))


def expected_tags() -> Column:
    """Tags that an analysis of a target must have."""
    number = F.when(F.col("cell").endswith("sg"), "sg").when(F.col("cell").endswith("pl"), "pl")
    tags = _some(F.lit("V"), _named(MOOD_TAGS, "mood"), _named(TENSE_TAGS, "tense"), F.col("person").cast("string"), number, F.when(F.col("voice") == "active", "act").when(F.col("voice").isNotNull(), "pass"))
    return F.array_distinct(tags)


def tag_query() -> Column:
    """Tags by which a corpus with grammatical tags is searched for a target; analytic cells by their participle."""
    analytic = F.col("tense").isin(*ANALYTIC) | (F.col("mood") == "conditional")
    simple = F.filter(F.array(F.lit("V"), _named(MOOD_TAGS, "mood"), F.try_element_at(F.create_map(*(F.lit(x) for kv in TENSE_TAGS.items() for x in kv)), F.col("tense")), F.col("person").cast("string"), F.substring("cell", 2, 2), F.when(F.col("voice") == "middle-passive", "pass").otherwise("act")), lambda x: x.isNotNull() & (x != ""))
    return F.when(analytic, F.array(F.lit("V"), F.lit("ptcp"))).otherwise(simple)


def analyzer_matches(analyses: Column) -> Column:
    """Analyses (lemma, tags) of a target's token with lemma_matches, missing tags and compatible."""
    expected = expected_tags()

    def judged(a: Column) -> Column:
        lemma = F.coalesce(folded(a["lemma"]).isin(folded(F.col("lemma")), folded(F.col("verb_id"))), F.lit(False))
        missing = F.array_except(expected, a["tags"])
        return F.struct(a["lemma"].alias("lemma"), a["tags"].alias("tags"), lemma.alias("lemma_matches"), missing.alias("missing"), (lemma & (F.size(missing) == 0)).alias("compatible"))

    return F.transform(analyses, judged)


def analyzer_status(matches: Column) -> Column:
    """Status of a target's analyses: accepted, analyzed_incompatible, no_token_analysis or, where there are none, not_provided."""
    return F.when(matches.isNull(), "not_provided").when(F.exists(matches, lambda m: m["compatible"]), "accepted").when(F.size(matches) > 0, "analyzed_incompatible").otherwise("no_token_analysis")


def lemma_aliases(parts: Column, lemmas: Column) -> Column:
    """Analyzers' lemmas that are principal parts of the verb, but neither its id nor its lemma."""
    local = F.array_except(F.array_distinct(F.transform(parts, folded)), F.array(folded(F.col("verb_id")), folded(F.col("lemma"))))
    return F.array_distinct(F.filter(lemmas, lambda x: F.array_contains(local, folded(x))))


def u_marker_backed(sources: Column, overrides: Column) -> Column:
    """Whether a middle-passive target is a sourced override, or "u" with the active override of its cell (keyed mood.tense[.voice]/cell)."""
    at = lambda voice: F.try_element_at(overrides, F.concat(F.col("mood"), F.lit("."), F.col("tense"), F.lit(f"{voice}/"), F.col("cell")))
    positive = F.regexp_replace("target_key", "^nuk ", "")
    same = F.coalesce(at(".middle-passive") == positive, F.lit(False)) | F.coalesce(positive == F.concat(F.lit("u "), F.regexp_replace(at(""), "^të ", "")), F.lit(False))
    return F.array_contains(sources, "husic") & (F.col("voice") == "middle-passive") & same


#: A voice verdict is that of the first rule whose condition holds.
VOICE_RULES = (
    ("accepted", "analyzer_accepted", "morphologically_accepted", "analyzer", "review_as_analyzer_accepted"),
    ("u_marker", "source_backed_composed", "source_backed_composed_middle_passive", "local-source", "review_source_backed_composed_phrase"),
    ("no_middle_passive", "not_validated", "locally_blocked_by_no_middle_passive_flag", "local_flag", "keep_local_no_middle_passive_flag"),
    ("array_contains(lexeme_tags, 'med')", "not_validated", "lexeme_medial_tagged", "lexeme", "review_medial_or_reflexive_candidate"),
    ("lexeme_found AND array_contains(lexeme_tags, 'vi') AND NOT array_contains(lexeme_tags, 'vt')", "not_validated", "ambiguous", "lexeme", "review_vi_tagged_nonactive_candidate"),
    ("lexeme_found AND size(lexeme_register) > 0", "not_validated", "ambiguous", "lexeme", "review_lemma_status"),
    ("size(aliases) > 0 AND source_level = 'lexicon-only'", "analyzer_lemma_alias", "lemma_alias_unresolved", "analyzer", "review_lemma_alias_source"),
    ("component", "component_supported", "full_phrase_unchecked", "analyzer", "review_component_supported_phrase"),
    ("status = 'analyzed_incompatible'", "analyzer_incompatible", "ambiguous", "analyzer", "review_analyzer_nonacceptance"),
)


def classify_voice() -> Column:
    """form, eligibility, proof, action and reasons of a target with: accepted, component, u_marker, no_middle_passive,
    lexeme_found, lexeme_tags, lexeme_register, aliases, register, source_level, status, mp_miss_rate, mp_overrides, has_sources, lexeme_kind."""
    c = F.col
    passive = c("voice") == "middle-passive"
    local = F.when(c("has_sources"), "local-source").otherwise("none")
    verdict = lambda *xs: F.struct(*((F.lit(x) if isinstance(x, str) else x).alias(n) for n, x in zip(("form", "eligibility", "proof", "action"), xs)))
    active = verdict(
        F.when(c("accepted"), "analyzer_accepted").when(c("component"), "component_supported").otherwise("not_validated"), "not_applicable_active",
        F.when(c("accepted") | c("component"), "analyzer").when(c("lexeme_found"), "lexeme").otherwise(local), "none",
    )
    found = F.when(~passive, active)
    for condition, *values in VOICE_RULES:
        found = found.when(F.expr(condition), verdict(*values))
    found = found.otherwise(verdict("not_validated", "unknown", F.when(c("lexeme_found"), "lexeme").otherwise(local), F.when(c("mp_miss_rate") >= 0.75, "review_with_external_analyzer").otherwise("none")))
    listed = lambda name, values: F.concat(F.lit(f"{name}:"), F.array_join(values, ","))
    reasons = F.flatten(F.array(
        _some(
            F.when(F.size("tokens") > 1, "multiword_target_head_token_only"), F.when(c("source_level") == "lexicon-only", "lexicon_only"), F.when(passive & ~c("mp_overrides"), "no_middle_passive_overrides"),
            F.when(passive & (c("mp_miss_rate") >= 0.75), "high_middle_passive_miss_pressure"),
            F.when(~c("lexeme_found"), F.when(c("lexeme_kind") == "not_provided", "no_external_lexeme_file").otherwise("no_external_lexeme_match")),
            F.when(c("accepted"), "uniparser_analyzer_accepts_head_token").when(c("component"), "uniparser_analyzer_supports_head_component").when(F.size("aliases") > 0, listed("uniparser_analyzer_lemma_alias", c("aliases")))
            .when(c("status") == "analyzed_incompatible", "uniparser_analyzer_incompatible_head_token").when(c("status") == "no_token_analysis", "uniparser_analyzer_no_head_token_analysis"),
            F.when(c("accepted") & (F.size("register") > 0), listed("uniparser_analyzer_register", c("register"))), F.when(~c("accepted") & (F.size("lexeme_register") > 0), listed("dialect_or_register", c("lexeme_register"))),
        ),
        F.when(~passive | c("accepted"), F.array().cast("array<string>")).otherwise(_some(
            F.when(c("u_marker"), "husic_backed_u_marker_from_active_override").when(c("no_middle_passive"), "local_no_middle_passive_flag").when(F.array_contains("lexeme_tags", "med"), "uniparser_lexeme_medial_tag")
            .when(F.expr(VOICE_RULES[4][0]), "uniparser_lexeme_vi_no_vt_med")
        )),
    ))
    return F.struct(found.alias("verdict"), reasons.alias("reasons"))


#: Forms of the auxiliary before a participle.
_JAM_ADMIRATIVE = "^qenk(am|e|a|emi|eni|an|ësha|ëshe|ësh|ëshim|ëshit|ëshin)[ ]+[^ ]"
_JAM_INDICATIVE = "^(jam|je|është|jemi|jeni|janë|isha|ishe|ishte|ishim|ishit|ishin|qe(shë)?|qemë|qetë|qenë)[ ]+[^ ]"


def voice_shape(form: Column, voice: Column, mood: Column, tense: Column) -> Column:
    """Whether a form has the shape of a voice in a cell, its mood particles taken off."""
    inner = F.regexp_replace(form, "^(do )?(të )?", "")
    marked, admirative, indicative = inner.startswith("u "), inner.rlike(_JAM_ADMIRATIVE), inner.rlike(_JAM_INDICATIVE)
    past = tense.isin("perfect", "pluperfect")
    passive = (
        F.when((mood == "admirative") & tense.isin("present", "imperfect"), marked).when((mood == "admirative") & past, admirative)
        .when((mood == "indicative") & (tense == "aorist"), marked).when((mood == "indicative") & past, indicative).otherwise(marked | admirative | indicative)
    )
    return F.when(voice == "middle-passive", passive).otherwise(~(marked | admirative))


def passive_like(form: Column) -> Column:
    """Whether a form looks middle-passive, whatever its cell."""
    return form.rlike(r"(^|\s)u\s+\p{L}") | form.rlike(r"(^|[^\p{L}])\p{L}+(ohem|ohesh|ohet|ohemi|oheni|ohen|ohesha|oheshe|ohej|oheshim|oheshit|oheshin)($|[^\p{L}])") | form.rlike(r"^(jam|je|është|jemi|jeni|janë)\s+\p{L}")


def dictionary_tags() -> Column:
    """Tags under which a dictionary lists a cell: a pluperfect is past and perfect, a conditional has the tags of the verb's own form."""
    conditional, tense = F.col("mood") == "conditional", F.col("tense")
    return F.array_distinct(_some(
        F.when(F.col("mood") != "non-finite", F.col("mood")),
        F.when(conditional & (tense == "present"), "imperfect").when(conditional & (tense == "perfect"), "past").when(~conditional & tense.isin("present", "imperfect", "aorist", "perfect", "future"), tense).when(~conditional & (tense == "pluperfect"), "past"),
        F.when((conditional & (tense == "perfect")) | (~conditional & (tense == "pluperfect")), "perfect"),
        F.try_element_at(F.create_map(*(F.lit(x) for kv in PERSONS.items() for x in kv)), F.col("person")),
        F.when(F.col("cell").endswith("sg"), "singular").when(F.col("cell").endswith("pl"), "plural"),
    ))


def derive_parts(lemma: Column, verb_class: Column) -> Column:
    """Principal parts of a regular verb; null where its class and ending don't give them."""
    part = lambda present, aorist, participle: F.struct(present.alias("present"), aorist.alias("aorist"), participle.alias("participle"))
    cut = lambda n: F.substr(lemma, F.lit(1), F.char_length(lemma) - n)
    end = lambda stem, x: F.concat(stem, F.lit(x))
    return (
        F.when((verb_class == 1) & lemma.endswith("oj"), part(end(cut(2), "o"), end(cut(2), "ua"), end(cut(2), "uar")))
        .when((verb_class == 1) & lemma.endswith("uaj"), part(end(cut(3), "ua"), end(cut(3), "ua"), end(cut(3), "uar")))
        .when(verb_class == 2, part(lemma, lemma, end(lemma, "ur"))).when(verb_class == 3, part(lemma, lemma, end(lemma, "rë")))
    )


#: Order in which categories of misses are stressed.
STRESS_PRIMARY = ("component_valid_phrase_absence", "scanner_variant_checked_but_absent", "needs_middle_passive_attestation", "rare_or_analytic_cell", "near_empty_cell")


def stress_candidate() -> Column:
    """Whether a miss of several tokens, never found raw, is worth a search with clitics."""
    return (F.col("trace_status") == "raw_zero") & (F.size("tokens") > 1) & ((F.col("form") == "analyzer_accepted") | F.col("primary").isin(*STRESS_PRIMARY[:3]))


def stress_priority(partitions: Column) -> tuple[Column, Column]:
    """Sort key of a candidate: its shape, then its anchor's partitions, category and verdict."""
    t = F.col("tokens")
    shape = F.when(F.get(t, 0) == "nuk", 0).when((F.get(t, 0) == "mos") & (F.get(t, 1) == "të"), 1).when(F.array_contains(t, "do") & F.array_contains(t, "të"), 2).otherwise(3)
    primary = F.lit(len(STRESS_PRIMARY))
    for k, name in reversed(list(enumerate(STRESS_PRIMARY))):
        primary = F.when(F.col("primary") == name, k).otherwise(primary)
    return shape, partitions * 16 + primary * 2 + F.when(F.col("form") == "analyzer_accepted", 0).otherwise(1)


#: Review lists and the category that each is of.
WORKLISTS = (
    ("review_middle_passive_voice_eligibility", "needs_middle_passive_attestation"), ("review_scanner_variant_absences", "scanner_variant_checked_but_absent"), ("review_near_empty_cells", "near_empty_cell"),
    ("review_lemma_outliers", "lemma_outlier"), ("review_component_valid_phrases", "component_valid_phrase_absence"),
)


def worklists(misses: DataFrame, samples: int = 5) -> DataFrame:
    """By review list: targets, lemmas and the first samples by key; empty lists are left out."""
    key = F.create_map(*(F.lit(x) for name, primary in WORKLISTS for x in (primary, name)))
    rows = misses.withColumn("worklist", F.try_element_at(key, F.col("primary"))).filter("worklist IS NOT NULL")
    few = rows.withColumn("nth", F.row_number().over(Window.partitionBy("worklist").orderBy("target_key", "target_id"))).filter(F.col("nth") <= samples)
    few = few.groupBy("worklist").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "target_key"))), lambda s: s["target_key"]), "|").alias("samples"))
    return rows.groupBy("worklist").agg(F.count("*").alias("targets"), F.countDistinct("verb_id").alias("lemmas")).join(few, "worklist")


def review_queue(misses: DataFrame) -> DataFrame:
    """By action and verb: targets, cells, and how many targets each mood has."""
    by = misses.groupBy("action", "verb_id", "mood").agg(F.count("*").alias("n"), F.countDistinct("tense", "cell").alias("cells"))
    moods = F.map_from_entries(F.sort_array(F.collect_list(F.struct("mood", "n")))).alias("moods")
    return by.groupBy("action", "verb_id").agg(F.sum("n").alias("targets"), F.sum("cells").alias("cells"), moods)


def review_coverage(queue: DataFrame, reviewed: DataFrame) -> DataFrame:
    """By action: rows and targets of the queue that a review (action, verb_id) covers, and those that none does."""
    marked = queue.join(reviewed.select("action", "verb_id").distinct().withColumn("covered", F.lit(True)), ["action", "verb_id"], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))
    return marked.groupBy("action").agg(F.count_if("covered").alias("reviewed"), F.count_if(~F.col("covered")).alias("unreviewed"), F.coalesce(F.sum(F.when(F.col("covered"), F.col("targets"))), F.lit(0)).alias("reviewed_targets"), F.coalesce(F.sum(F.when(~F.col("covered"), F.col("targets"))), F.lit(0)).alias("unreviewed_targets"))


def review_drift(queue: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Rows where a review and the queue disagree: only one has the row, or their targets differ."""
    both = queue.select("action", "verb_id", F.col("targets").alias("now")).join(reviewed.select("action", "verb_id", F.col("targets").alias("then")), ["action", "verb_id"], "full")
    why = F.when(F.col("then").isNull(), "not reviewed").when(F.col("now").isNull(), "gone").when(F.col("now") != F.col("then"), "changed")
    return both.withColumn("why", why).filter("why IS NOT NULL")


def review_shortlist(queue: DataFrame, evidence: DataFrame, reviewed: DataFrame, most: int = 40) -> DataFrame:
    """Rows of the queue that no review covers and for which a source has forms (verb_id, score), best evidence and most targets first."""
    left = queue.join(reviewed.select("action", "verb_id"), ["action", "verb_id"], "left_anti").join(evidence.filter("score > 0"), "verb_id")
    return left.orderBy(F.desc("score"), F.desc("targets"), "action", "verb_id").limit(most).select("action", "verb_id", "targets", "score")

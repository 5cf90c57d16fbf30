"""Albanian verb inflection as joins of a lexicon with rule tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Cells in order, endings by class and rule, auxiliary and suppletive forms.
CELLS = ("1sg", "2sg", "3sg", "1pl", "2pl", "3pl")
ENDINGS = {
    (1, "present"): ("present", "j n n jmë ni jnë"), (2, "present"): ("present", "- - - im ni in"), (3, "present"): ("present", "- - - më ni në"),
    (1, "imperfect"): ("present", "ja je nte nim nit nin"), (2, "imperfect"): ("present", "ja je te nim nit nin"), (3, "imperfect"): ("present", "ja je nte nim nit nin"),
    (1, "aorist"): ("present present present aorist aorist aorist", "va ve i m t n"), (2, "aorist"): ("aorist", "a e i ëm ët ën"), (3, "aorist"): ("aorist", "va ve u më të në"),
    (1, "subjunctive"): ("present", "j sh jë jmë ni jnë"), (2, "subjunctive"): ("present", "- ësh ë im ni in"), (3, "subjunctive"): ("present", "- sh jë më ni në"),
    (1, "optative"): ("present", "fsha fsh ftë fshim fshi fshin"), (2, "optative"): ("present", "sha sh të shim shi shin"), (3, "optative"): ("present", "fsha fsh ftë fshim fshi fshin"),
    (1, "mp_present"): ("present", "hem hesh het hemi heni hen"), (2, "mp_present"): ("present", "em esh et emi eni en"), (3, "mp_present"): ("present", "hem hesh het hemi heni hen"),
    (1, "mp_imperfect"): ("present", "hesha heshe hej heshim heshit heshin"), (2, "mp_imperfect"): ("present", "esha eshe ej eshim eshit eshin"), (3, "mp_imperfect"): ("present", "hesha heshe hej heshim heshit heshin"),
}
#: The same for all classes: the participle, cut by its ending, with these.
ADMIRATIVE = {"adm_present": "kam ke ka kemi keni kan", "adm_imperfect": "kësha këshe kësh këshim këshit këshin"}
IMPERATIVE = {"2sg": "", "2pl": "ni"}
AUXILIARIES = {
    ("kam", "indicative.present"): "kam ke ka kemi keni kanë", ("kam", "indicative.imperfect"): "kisha kishe kishte kishim kishit kishin", ("kam", "indicative.aorist"): "pata pate pati patëm patët patën",
    ("kam", "subjunctive.present"): "kem kesh ketë kemi keni kenë", ("kam", "subjunctive.imperfect"): "kisha kishe kishte kishim kishit kishin", ("kam", "admirative.present"): "paskam paske paska paskemi paskeni paskan",
    ("kam", "admirative.imperfect"): "paskësha paskëshe paskësh paskëshim paskëshit paskëshin", ("kam", "optative.present"): "paça paç pastë paçim paçi paçin",
    ("jam", "indicative.present"): "jam je është jemi jeni janë", ("jam", "indicative.imperfect"): "isha ishe ishte ishim ishit ishin", ("jam", "indicative.aorist"): "qeshë qe qe qemë qetë qenë",
    ("jam", "subjunctive.present"): "jem jesh jetë jemi jeni jenë", ("jam", "subjunctive.imperfect"): "isha ishe ishte ishim ishit ishin", ("jam", "admirative.present"): "qenkam qenke qenka qenkemi qenkeni qenkan",
    ("jam", "admirative.imperfect"): "qenkësha qenkëshe qenkësh qenkëshim qenkëshit qenkëshin", ("jam", "optative.present"): "qofsha qofsh qoftë qofshim qofshit qofshin",
}
#: participle, then present, imperfect, aorist, subjunctive, admirative, optative, imperative (2sg, 2pl)
SUPPLETIVE = {
    "jap": ("dhënë", "jap jep jep japim jepni japin", "jepja jepje jepte jepnim jepnit jepnin", "dhashë dhe dha dhamë dhatë dhanë", "jap japësh japë japim jepni japin", "dhënkam dhënke dhënka dhënkemi dhënkeni dhënkan", "dhënça dhënç dhëntë dhënçim dhënçi dhënçin", "jep jepni"),
    "shoh": ("parë", "shoh sheh sheh shohim shihni shohin", "shihja shihje shihte shihnim shihnit shihnin", "pashë pe pa pamë patë panë", "shoh shohësh shohë shohim shihni shohin", "pakam pake paka pakemi pakeni pakan", "pafsha pafsh paftë pafshim pafshi pafshin", "shih shihni"),
    "vij": ("ardhur", "vij vjen vjen vijmë vini vijnë", "vija vije vinte vinim vinit vinin", "erdha erdhe erdhi erdhëm erdhët erdhën", "vij vish vijë vijmë vini vijnë", "ardhkam ardhke ardhka ardhkemi ardhkeni ardhkan", "ardhsha ardhsh ardhtë ardhshim ardhshi ardhshin", "eja ejani"),
    "them": ("thënë", "them thua thotë themi thoni thonë", "thosha thoshe thoshte thoshim thoshit thoshin", "thashë the tha thamë thatë thanë", "them thuash thotë themi thoni thonë", "thënkam thënke thënka thënkemi thënkeni thënkan", "thënça thënç thëntë thënçim thënçi thënçin", "thuaj thoni"),
    "jam": ("qenë", "jam je është jemi jeni janë", "isha ishe ishte ishim ishit ishin", "qeshë qe qe qemë qetë qenë", "jem jesh jetë jemi jeni jenë", "qenkam qenke qenka qenkemi qenkeni qenkan", "qofsha qofsh qoftë qofshim qofshit qofshin", "ji jini"),
}
SUPPLETIVE_RULES = ("present", "imperfect", "aorist", "subjunctive", "adm_present", "optative")
NON_FINITE = (("participle", ""), ("infinitive", "për të "), ("gerund", "duke "), ("privative", "pa "), ("temporal", "me të "))
#: rule: override key
RULE_KEYS = {
    "present": "indicative.present", "imperfect": "indicative.imperfect", "aorist": "indicative.aorist", "subjunctive": "subjunctive.present", "adm_present": "admirative.present", "adm_imperfect": "admirative.imperfect",
    "optative": "optative.present", "mp_present": "indicative.present.middle-passive", "mp_imperfect": "indicative.imperfect.middle-passive",
}
#: mood, tense; prefix; what stands in the active and in the middle-passive: a rule, u and a rule, or aux: and its tense
PLAN = (
    ("indicative", "present", "", "present", "mp_present"), ("indicative", "imperfect", "", "imperfect", "mp_imperfect"), ("indicative", "aorist", "", "aorist", "u aorist"),
    ("indicative", "perfect", "", "aux:indicative.present", "aux:indicative.present"), ("indicative", "pluperfect", "", "aux:indicative.imperfect", "aux:indicative.imperfect"), ("indicative", "past-anterior", "", "aux:indicative.aorist", "aux:indicative.aorist"),
    ("indicative", "future", "do të ", "subjunctive", "mp_present"), ("indicative", "future-perfect", "do të ", "aux:subjunctive.present", "aux:subjunctive.present"), ("indicative", "future-in-past", "do të ", "imperfect", "mp_imperfect"),
    ("indicative", "future-perfect-in-past", "do të ", "aux:indicative.imperfect", "aux:indicative.imperfect"), ("subjunctive", "present", "të ", "subjunctive", "mp_present"), ("subjunctive", "imperfect", "të ", "imperfect", "mp_imperfect"),
    ("subjunctive", "perfect", "të ", "aux:subjunctive.present", "aux:subjunctive.present"), ("subjunctive", "pluperfect", "të ", "aux:subjunctive.imperfect", "aux:subjunctive.imperfect"), ("conditional", "present", "do të ", "imperfect", "mp_imperfect"),
    ("conditional", "perfect", "do të ", "aux:subjunctive.imperfect", "aux:subjunctive.imperfect"), ("admirative", "present", "", "adm_present", "u adm_present"), ("admirative", "imperfect", "", "adm_imperfect", "u adm_imperfect"),
    ("admirative", "perfect", "", "aux:admirative.present", "aux:admirative.present"), ("admirative", "pluperfect", "", "aux:admirative.imperfect", "aux:admirative.imperfect"), ("optative", "present", "", "optative", "u optative"),
    ("optative", "perfect", "", "aux:optative.present", "aux:optative.present"),
)


def grid_rows() -> list[tuple]:
    """The 273 cells: mood, tense, voice, cell, person, prefix, rule, aux_tense (tense of non-finite cells is the form)."""
    rows = []
    for mood, tense, prefix, *by_voice in PLAN:
        for voice, what in zip(("active", "middle-passive"), by_voice):
            before = prefix + "u " * what.startswith("u ")
            rule, aux = (None, what[4:]) if what.startswith("aux:") else (what.removeprefix("u "), None)
            rows += [(mood, tense, voice, cell, int(cell[0]), before, rule, aux) for cell in CELLS]
    rows += [("imperative", "present", voice, cell, 2, "", "imperative", None) for voice in ("active", "middle-passive") for cell in IMPERATIVE]
    return rows + [("non-finite", form, None, None, None, prefix, "participle", None) for form, prefix in NON_FINITE]


def rule_rows() -> list[tuple]:
    """class, rule, cell, stem, ending; class 0 stands for all."""
    rows = []
    for (verb_class, rule), (stems, endings) in ENDINGS.items():
        stem = stems.split() * (6 // len(stems.split()))
        rows += [(verb_class, rule, c, s, e.replace("-", "")) for c, s, e in zip(CELLS, stem, endings.split())]
    for rule, endings in ADMIRATIVE.items():
        rows += [(k, rule, c, "participle", e) for k in (1, 2, 3) for c, e in zip(CELLS, endings.split())]
    return rows + [(k, "imperative", c, "present", e) for k in (1, 2, 3) for c, e in IMPERATIVE.items()]


def auxiliary_rows() -> list[tuple]:
    return [(aux, tense, c, f) for (aux, tense), forms in AUXILIARIES.items() for c, f in zip(CELLS, forms.split())]


def suppletive_rows() -> list[tuple]:
    rows = []
    for verb, (_, *tables, imperative) in SUPPLETIVE.items():
        rows += [(verb, rule, c, f) for rule, forms in zip(SUPPLETIVE_RULES, tables) for c, f in zip(CELLS, forms.split())]
        rows += [(verb, "imperative", c, f) for c, f in zip(IMPERATIVE, imperative.split())]
    return rows


def participle_rows() -> list[tuple]:
    return [(verb, forms[0]) for verb, forms in SUPPLETIVE.items()]


GRID = "mood string, tense string, voice string, cell string, person int, prefix string, rule string, aux_tense string"
LEXICON = "verb_id string, lemma string, translation_en string, class int, auxiliary string, present string, aorist string, participle string, is_suppletive boolean, no_middle_passive boolean, third_person_only boolean, mp_third_person_only boolean, overrides map<string,string>"


def grid(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(grid_rows(), GRID)


def normalized_form(form):
    """A form with single spaces, none at its ends."""
    return F.trim(F.regexp_replace(form, r"\s+", " "))


def admirative_trim(participle):
    """How many letters of the participle the admirative drops."""
    ends = lambda *x: participle.rlike("(" + "|".join(x) + ")$")
    return F.when(ends("rrë"), 1).when(ends("rë", "ur"), 2).otherwise(1)


def conjugate(lexicon: DataFrame, polarities: tuple[str, ...] = ("affirmative",), modalities: tuple[str, ...] = ("declarative",), colloquial: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """The long table: every cell of every verb with its form, or the reason why there is none; keep: columns of the lexicon that each row gets.

    All rule tables have a fixed number of rows, under a thousand, and go to every task; the lexicon isn't shuffled.
    overrides of the lexicon are keyed by "mood.tense[.voice]/cell".
    """
    spark = lexicon.sparkSession
    table = lambda rows, ddl: F.broadcast(spark.createDataFrame(rows, ddl))
    rules = table(rule_rows(), "class int, rule string, cell string, stem string, ending string")
    auxiliaries = table(auxiliary_rows(), "aux string, aux_tense string, cell string, aux_form string")
    suppletive = table(suppletive_rows(), "verb_id string, rule string, cell string, supp string")
    participles = table(participle_rows(), "verb_id string, supp_participle string")
    keys = F.create_map(*(F.lit(x) for kv in RULE_KEYS.items() for x in kv))
    c = F.col
    cells = lexicon.join(participles, "verb_id", "left").crossJoin(F.broadcast(grid(spark)))
    cells = cells.withColumn("aux", F.when(c("voice") == "middle-passive", "jam").otherwise(c("auxiliary"))).withColumn("part", F.when(c("is_suppletive"), F.coalesce("supp_participle", "participle")).otherwise(c("participle")))
    cells = cells.join(rules, ["class", "rule", "cell"], "left").join(auxiliaries, ["aux", "aux_tense", "cell"], "left").join(suppletive, ["verb_id", "rule", "cell"], "left")
    override = lambda key: F.get(F.array(F.try_element_at("overrides", F.concat(key, F.lit("/"), c("cell")))), 0)
    stem = F.when(c("stem") == "present", c("present")).when(c("stem") == "aorist", c("aorist")).otherwise(c("participle"))
    trim = F.when(c("stem") == "participle", admirative_trim(c("participle"))).otherwise(0)
    regular = F.concat(F.substr(stem, F.lit(1), F.char_length(stem) - trim), c("ending"))
    own = F.regexp_replace(override(F.element_at(keys, c("rule"))), "^të ", "")
    simple = F.coalesce(F.when(c("rule").isNotNull() & c("rule").isin(*RULE_KEYS), own), F.when(c("is_suppletive"), c("supp")), regular)
    mp = c("voice") == "middle-passive"
    bare_aorist = mp & (c("mood") == "indicative") & (c("tense") == "aorist") & (c("cell") == "3sg")
    form = (
        F.when(c("mood") == "non-finite", F.concat(c("prefix"), c("part")))
        .when(bare_aorist, F.coalesce(override(F.lit("indicative.aorist.middle-passive")), F.concat(F.lit("u "), c("aorist"))))
        .when((c("mood") == "imperative") & mp, override(F.lit("imperative.present.middle-passive")))
        .when(c("aux_tense").isNotNull(), F.concat(c("prefix"), c("aux_form"), F.lit(" "), c("part"))).otherwise(F.concat(c("prefix"), simple))
    )
    finite = c("mood") != "non-finite"
    reason = (
        F.when(finite & c("third_person_only") & (c("person") != 3), "third person only").when(finite & mp & c("mp_third_person_only") & (c("person") != 3), "third person only in the middle-passive")
        .when(mp & c("no_middle_passive"), "no middle-passive").when((c("mood") == "imperative") & mp & override(F.lit("imperative.present.middle-passive")).isNull(), "no middle-passive imperative")
    )
    cells = cells.select("verb_id", "lemma", "translation_en", "class", "mood", "tense", "voice", "cell", "person", form.alias("base"), reason.alias("reason"), override(F.concat_ws(".", "mood", "tense")).alias("whole"), *keep)
    ways = F.array(*(F.struct(F.lit(p).alias("polarity"), F.lit(m).alias("modality")) for p in polarities for m in modalities))
    plain = F.array(F.struct(F.lit(None).cast("string").alias("polarity"), F.lit(None).cast("string").alias("modality")))
    cells = cells.withColumn("way", F.explode(F.when(finite, ways).otherwise(plain))).select("*", "way.*").drop("way")
    base = F.when((c("voice") == "active") & (c("polarity") == "affirmative") & (c("modality") == "declarative") & c("whole").isNotNull(), c("whole")).otherwise(c("base"))
    cells = cells.withColumn("base", base)
    mos = c("mood").isin("imperative", "subjunctive", "optative")
    word = F.when(mos, "mos").otherwise("s'" if colloquial else "nuk")
    negated = F.when((c("mood") == "subjunctive") & c("base").startswith("të "), F.concat(F.lit("të "), word, F.lit(" "), F.substr("base", F.lit(4)))).otherwise(F.concat(word, F.lit(" "), c("base")))
    said = F.when(c("polarity") == "negative", negated).otherwise(c("base"))
    said = F.when(c("modality") == "interrogative", F.concat(F.lit("a "), said)).otherwise(said)
    tidy = normalized_form(said)
    return cells.select("verb_id", "lemma", "translation_en", "class", "mood", "tense", "voice", "cell", "person", "polarity", "modality", F.when(c("reason").isNull(), tidy).alias("form"), "reason", *keep)


def signature():
    """Of a row of conjugate()."""
    return F.when(F.col("mood") == "non-finite", F.concat_ws(".", "mood", "tense")).otherwise(F.concat_ws(".", "mood", "tense", "cell", "voice", "polarity", "modality"))


def cell_label():
    return F.when(F.col("mood") == "non-finite", F.concat_ws(" ", "mood", "tense")).otherwise(F.concat_ws(" ", "mood", "tense", "cell", "voice"))


def search_targets(lexicon: DataFrame) -> DataFrame:
    """Search targets of all cells, affirmative and negative: target_id, target_key, tokens, signature, cell_label, verb_id, lemma; one row per target_id."""
    from .text import letter_runs, target_id

    forms = conjugate(lexicon, ("affirmative", "negative")).filter("form IS NOT NULL").withColumn("tokens", letter_runs(F.col("form"))).filter(F.size("tokens") > 0)
    rows = forms.select("verb_id", "lemma", F.array_join("tokens", " ").alias("target_key"), "tokens", signature().alias("signature"), cell_label().alias("cell_label"))
    return rows.withColumn("target_id", target_id(F.col("verb_id"), F.col("signature"), F.col("target_key"))).dropDuplicates(["target_id"])


#: Words before a verb that are no auxiliary.
PARTICLES = ("të", "do", "mos", "nuk", "a", "për", "duke", "pa", "me")


def segments(form, mood, tense, cell):
    """A form in segments (surface, role): particles, the middle-passive marker, an auxiliary, and the verb, whose stem and
    ending the rule tables tell apart where the ending of the cell is at the end of it; a form without a rule is one stem.

    Needs the columns aux_forms (the auxiliary's forms in the cell) and endings (the endings of the cell, longest first).
    """
    # Spark evaluates what a lambda names again for each element, so the words, and the ending found, are bound to one first
    bound = lambda value, use: F.get(F.transform(F.array(value), use), 0)

    def of_words(words):
        n = F.size(words)
        role = lambda w, i: F.when((w == "u") & (i < n - 1), "voice-marker").when(w.isin(*PARTICLES) & (i < n - 1), "particle").when(i < n - 1, "auxiliary").otherwise("stem")
        return bound(F.transform(words, lambda w, i: F.struct(w.alias("surface"), role(w, i).alias("role"))), of_parts)

    def of_parts(parts):
        last = F.element_at(parts, -1)["surface"]
        simple = (mood != "non-finite") & ~F.exists(parts, lambda p: p["role"] == "auxiliary")
        ending = F.when(simple, bound(last, lambda own: F.get(F.filter("endings", lambda e: (e != "") & own.endswith(e) & (F.char_length(own) > F.char_length(e))), 0)))
        return bound(ending, lambda e: F.when(e.isNull(), parts).otherwise(F.concat(F.slice(parts, F.lit(1), F.size(parts) - 1), split(last, e))))

    def split(last, ending):
        stem = F.substr(last, F.lit(1), F.char_length(last) - F.char_length(ending))
        return F.array(F.struct(stem.alias("surface"), F.lit("stem").alias("role")), F.struct(ending.alias("surface"), F.lit("ending").alias("role")))

    return bound(F.split(form, " "), of_words)


def joined_segments(parts):
    """The form that segments make: an ending follows its stem without a space."""
    return F.ltrim(F.aggregate(parts, F.lit(""), lambda done, p: F.concat(done, F.when(p["role"] == "ending", F.lit("")).otherwise(F.lit(" ")), p["surface"])))


def with_segments(forms: DataFrame) -> DataFrame:
    """Forms of conjugate() with their segments. The rule tables are small and go to every task."""
    rows = [(r, c, e) for _, r, c, _, e in rule_rows()]
    by_rule = forms.sparkSession.createDataFrame(sorted(set(rows)), "rule string, cell string, ending string")
    cells = forms.sparkSession.createDataFrame(grid_rows(), GRID).filter("rule IS NOT NULL").select("mood", "tense", "voice", "cell", "rule")
    endings = cells.join(by_rule, ["rule", "cell"]).groupBy("mood", "tense", "voice", "cell").agg(F.transform(F.sort_array(F.collect_set(F.struct((-F.char_length("ending")).alias("n"), "ending"))), lambda s: s["ending"]).alias("endings"))
    found = forms.join(F.broadcast(endings), ["mood", "tense", "voice", "cell"], "left").withColumn("endings", F.coalesce("endings", F.array().cast("array<string>")))
    return found.withColumn("segments", segments(F.col("form"), F.col("mood"), F.col("tense"), F.col("cell"))).drop("endings")


#: Fixed values of glosses and of CoNLL-U features.
TENSE_GLOSS = {"present": "PRS", "imperfect": "IPF", "aorist": "AOR", "perfect": "PRF", "pluperfect": "PLUP", "past-anterior": "PST.ANT", "future": "FUT", "future-perfect": "FUT.PRF", "future-in-past": "FUT.PST", "future-perfect-in-past": "FUT.PRF.PST"}
MOOD_FEATURE = {"indicative": "Ind", "subjunctive": "Sub", "conditional": "Cnd", "admirative": "Adm", "optative": "Opt", "imperative": "Imp"}
TENSE_FEATURE = {
    "present": "Tense=Pres", "imperfect": "Tense=Imp", "aorist": "Tense=Past|Aspect=Perf", "perfect": "Tense=Pres|Aspect=Perf", "pluperfect": "Tense=Past|Aspect=Perf", "past-anterior": "Tense=Pqp|Aspect=Perf",
    "future": "Tense=Fut", "future-perfect": "Tense=Fut|Aspect=Perf", "future-in-past": "Tense=Fut|Aspect=Imp", "future-perfect-in-past": "Tense=Fut|Aspect=Perf",
}


def _map(values: dict[str, str], key):
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def interlinear(parts, tense, cell):
    """Two aligned lines of segments and their glosses; columns are as wide as the wider of the two."""
    number = F.when(cell.endswith("sg"), "SG").otherwise("PL")
    name = lambda p: F.when(p["role"] == "auxiliary", "AUX").when(p["role"] == "stem", "STEM").when(p["role"] == "voice-marker", "MID.PASS").when(p["role"] == "ending", F.concat_ws(".", F.substring(cell, 1, 1), number, _map(TENSE_GLOSS, tense))).otherwise("PRT")
    pairs = F.transform(parts, lambda p: F.struct(p["surface"].alias("a"), name(p).alias("b")))
    wide = F.transform(pairs, lambda p: F.struct(F.greatest(F.char_length(p["a"]), F.char_length(p["b"])).alias("n"), p["a"].alias("a"), p["b"].alias("b")))
    line = lambda k: F.rtrim(F.array_join(F.transform(wide, lambda p: F.rpad(p[k], p["n"], F.lit(" "))), "  "))
    return F.concat(line("a"), F.lit("\n"), line("b"))


def conllu(lemma, form, mood, tense, cell, nth):
    """A row of CoNLL-U for a form of an active, affirmative cell."""
    person = F.when(cell.isNotNull(), F.concat(F.lit("Person="), F.substring(cell, 1, 1), F.lit("|Number="), F.when(cell.endswith("sg"), "Sing").otherwise("Plur")))
    features = F.concat_ws("|", F.lit("VerbForm=Fin"), F.concat(F.lit("Mood="), _map(MOOD_FEATURE, mood)), F.coalesce(_map(TENSE_FEATURE, tense), F.concat(F.lit("Tense="), tense)), person, F.lit("Voice=Act"), F.lit("Polarity=Pos"))
    return F.concat_ws("\t", nth.cast("string"), form, lemma, F.lit("VERB"), F.lit("_"), features, F.lit("_"), F.lit("_"), F.lit("_"), F.concat(F.lit("Cell="), F.concat_ws("-", mood, tense, cell)))


def citation(verb, lemma, translation, url, year: int):
    """BibTeX of an entry; "ë" and "ć" as LaTeX."""
    latex = lambda c: F.replace(F.replace(c, F.lit("ć"), F.lit("{\\'c}")), F.lit("ë"), F.lit('{\\"e}'))
    return F.concat(F.lit("@misc{"), verb, F.lit(f"-{year},\n  title = {{"), latex(lemma), F.lit(" — "), latex(translation), F.lit(f"}},\n  year = {{{year}}},\n  url = {{"), url, F.lit("}\n}"))


def plain_citations(lemma, translation, url, publisher: str, site: str, year: int):
    """An entry's citation in APA style, and in one line: apa, plain. publisher and site: who publishes it, and what it is part of."""
    apa = F.concat(F.lit(f"{publisher}. ({year}). "), lemma, F.lit(" — "), translation, F.lit(f". {site}. "), url)
    return F.struct(apa.alias("apa"), F.concat(F.lit(f"{site} · "), lemma, F.lit(" ("), translation, F.lit(") · "), url).alias("plain"))

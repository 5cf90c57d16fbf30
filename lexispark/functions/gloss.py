"""English glosses of cells: a template for each mood and tense, turned passive, agreed with the subject, negated and inverted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Mood.tense, prefix, adverb, auxiliaries, verb form, without subject, suffix, auxiliary before the subject.
TEMPLATES = (
    ("indicative.present", "", "", "", "base", False, "", False), ("indicative.imperfect", "", "", "was/were", "gerund", False, "", False), ("indicative.aorist", "", "", "", "past", False, "", False),
    ("indicative.perfect", "", "", "have/has", "participle", False, "", False), ("indicative.pluperfect", "", "", "had", "participle", False, "", False), ("indicative.past-anterior", "", "", "had", "participle", False, "", False),
    ("indicative.future", "", "", "will", "base", False, "", False), ("indicative.future-perfect", "", "", "will have", "participle", False, "", False), ("indicative.future-in-past", "", "", "was/were going to", "base", False, "", False),
    ("indicative.future-perfect-in-past", "", "", "would have", "participle", False, "", False), ("subjunctive.present", "(that)", "", "", "base", False, "", False), ("subjunctive.imperfect", "(that)", "", "was/were", "gerund", False, "", False),
    ("subjunctive.perfect", "(that)", "", "have/has", "participle", False, "", False), ("subjunctive.pluperfect", "(that)", "", "had", "participle", False, "", False), ("conditional.present", "", "", "would", "base", False, "", False),
    ("conditional.perfect", "", "", "would have", "participle", False, "", False), ("admirative.present", "", "apparently", "", "base", False, "", False), ("admirative.imperfect", "", "apparently", "was/were", "gerund", False, "", False),
    ("admirative.perfect", "", "apparently", "have/has", "participle", False, "", False), ("admirative.pluperfect", "", "apparently", "had", "participle", False, "", False), ("optative.present", "", "", "may", "base", False, "", True),
    ("optative.perfect", "", "", "may have", "participle", False, "", True), ("imperative.present", "", "", "", "base", True, "!", False), ("non-finite.participle", "", "", "", "participle", True, "", False),
    ("non-finite.infinitive", "to", "", "", "base", True, "", False), ("non-finite.gerund", "", "", "", "gerund", True, "", False), ("non-finite.privative", "without", "", "", "gerund", True, "", False), ("non-finite.temporal", "upon", "", "", "gerund", True, "", False),
)
TEMPLATE = "key string, prefix string, adverb string, aux string, verb_form string, no_pronoun boolean, suffix string, invert boolean"


def passive_aux(aux: Column, verb_form: Column, mood: Column) -> Column:
    """Auxiliaries of a template in the passive; its verb form is then the participle."""
    more = lambda x: F.concat(aux, F.lit(x))
    none = aux == ""
    return (
        F.when(none & (verb_form == "base"), F.when(mood == "imperative", "be").otherwise("am/are/is")).when(none & (verb_form == "past"), "was/were").when(none & (verb_form == "gerund"), "am/are/is being")
        .when(none, "").when(verb_form == "base", more(" be")).when(verb_form == "gerund", more(" being")).otherwise(more(" been"))
    )


def agreed(aux: Column, cell: Column) -> Column:
    """Auxiliaries that agree with the subject; the first person where there is none."""
    first, third = F.coalesce(cell == "1sg", F.lit(True)), F.coalesce(cell == "3sg", F.lit(False))
    pairs = (("was/were", F.when(first | third, "was").otherwise("were")), ("have/has", F.when(third, "has").otherwise("have")), ("am/are/is", F.when(first, "am").when(third, "is").otherwise("are")), ("do/does", F.when(third, "does").otherwise("do")))
    for slash, word in pairs:
        aux = F.replace(aux, F.lit(slash), word)
    return aux


def pronoun(cell: Column) -> Column:
    who = {"1sg": "I", "2sg": "you", "3sg": "s/he", "1pl": "we", "2pl": "you", "3pl": "they"}
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in who.items() for x in kv)), cell), F.lit("I"))


def with_gloss(cells: DataFrame, english: DataFrame) -> DataFrame:
    """Cells (verb_id, mood, tense, cell, voice, polarity, modality) with their gloss; english has the verbs' base, past, participle and gerund.

    The templates are as many as moods and tenses, and go to every task; so does nothing that grows.
    """
    c = F.col
    table = F.broadcast(cells.sparkSession.createDataFrame(list(TEMPLATES), TEMPLATE))
    words = english.select("verb_id", *(c(x).alias(f"en_{x}") for x in ("base", "past", "participle", "gerund")))
    rows = cells.join(words, "verb_id").withColumn("key", F.concat_ws(".", "mood", "tense")).join(table, "key", "left")
    rows = rows.fillna("", ["prefix", "adverb", "aux", "suffix"]).fillna({"verb_form": "base"}).fillna(False, ["no_pronoun", "invert"])
    finite, negative, asked = c("mood") != "non-finite", F.coalesce(c("polarity") == "negative", F.lit(False)), F.coalesce(c("modality") == "interrogative", F.lit(False))
    copula = (c("en_base") == "be") | c("en_base").startswith("be ")
    passive = F.coalesce(c("voice") == "middle-passive", F.lit(False)) & ~copula
    rows = rows.withColumns({"aux": F.when(passive, passive_aux(c("aux"), c("verb_form"), c("mood"))).otherwise(c("aux")), "verb_form": F.when(passive, "participle").otherwise(c("verb_form"))})
    rows = rows.withColumn("virtual", copula & (c("aux") == "") & c("verb_form").isin("base", "past") & finite & (c("mood") != "imperative"))
    rows = rows.withColumn("aux", F.when(c("virtual"), F.when(c("verb_form") == "past", "was/were").otherwise("am/are/is")).otherwise(c("aux")))
    forbidden = (c("mood") == "imperative") & negative
    rows = rows.withColumn("support", (negative | asked) & (c("aux") == "") & finite & ~forbidden)
    aux = F.when(c("support") & (c("verb_form") == "past"), "did").when(c("support"), "do/does").otherwise(c("aux"))
    own = F.when(c("verb_form") == "base", c("en_base")).when(c("verb_form") == "past", c("en_past")).when(c("verb_form") == "participle", c("en_participle")).otherwise(c("en_gerund"))
    word = F.when(c("support"), c("en_base")).when(c("virtual"), F.trim(F.substr("en_base", F.lit(3)))).otherwise(own)
    rows = rows.withColumns({"aux": agreed(aux, c("cell")), "word": word, "who": F.when(c("no_pronoun"), "").otherwise(pronoun(c("cell")))})
    head, tail = F.substring_index("aux", " ", 1), F.regexp_replace("aux", "^[^ ]+ ?", "")
    no = F.when(negative & (c("aux") != ""), "not").otherwise("")
    said = lambda *xs: F.array_join(F.filter(F.array(*xs), lambda x: x != ""), " ")
    turned = F.concat(said(c("prefix"), head, c("who"), c("adverb"), no, tail, c("word")), F.when(asked, "?").otherwise(c("suffix")))
    plain = F.concat(said(c("prefix"), c("who"), c("adverb"), head, no, tail, c("word")), c("suffix"))
    gloss = F.when(forbidden, F.concat(said(c("prefix"), F.lit("do"), F.lit("not"), c("aux"), c("word")), c("suffix"))).when((asked | c("invert")) & (c("aux") != ""), turned).otherwise(plain)
    return rows.withColumn("gloss", gloss).select(*cells.columns, "gloss")

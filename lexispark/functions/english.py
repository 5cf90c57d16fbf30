"""English forms of a verb's translation: overrides, irregular verbs, then spelling rules; of phrasal verbs the head inflects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMS = "base string, past string, participle string, gerund string"


def first_sense(translation: Column) -> Column:
    """The first of senses between " / ", without "to"."""
    return F.regexp_replace(F.trim(F.split(translation, " / ")[0]), "^to ", "")


def final_cvc(word: Column) -> Column:
    """Consonant, vowel, consonant at the end of a word with one run of vowels; w, x and y don't double."""
    return (F.char_length(word) >= 3) & word.rlike("(?i)[^aeiou][aeiou][^aeiouwxy]$") & (F.regexp_count(word, F.lit("(?i)[aeiou]+")) == 1)


def past(word: Column) -> Column:
    last = F.right(word, F.lit(1))
    return (
        F.when(word == "", word).when(last == "e", F.concat(word, F.lit("d"))).when(word.rlike("(?i)[^aeiou]y$"), F.regexp_replace(word, "y$", "ied"))
        .when((last != "y") & final_cvc(word), F.concat(word, last, F.lit("ed"))).otherwise(F.concat(word, F.lit("ed")))
    )


def gerund(word: Column) -> Column:
    last = F.right(word, F.lit(1))
    return (
        F.when(word == "", word).when(word.endswith("ie"), F.regexp_replace(word, "ie$", "ying")).when(word.rlike("[^eoy]e$"), F.regexp_replace(word, "e$", "ing"))
        .when(final_cvc(word), F.concat(word, last, F.lit("ing"))).otherwise(F.concat(word, F.lit("ing")))
    )


def english_forms(verbs: DataFrame, irregular: DataFrame, translation: str = "translation_en") -> DataFrame:
    """verbs with base, past, participle and gerund. irregular: one row per base, with past, participle and gerund."""
    table = irregular.select(F.col("base").alias("__b"), F.struct("past", "participle", "gerund").alias("__f"))
    found = verbs.withColumn("base", first_sense(F.col(translation))).withColumn("__head", F.split("base", " ")[0])
    found = found.withColumn("__rest", F.substr("base", F.char_length("__head") + 1))
    found = found.join(F.broadcast(table.withColumnRenamed("__b", "base").withColumnRenamed("__f", "__whole")), "base", "left")
    found = found.join(F.broadcast(table.withColumnRenamed("__b", "__head").withColumnRenamed("__f", "__part")), "__head", "left")
    pick = lambda name, rule: F.coalesce(F.col("__whole")[name], F.concat(F.coalesce(F.col("__part")[name], rule), F.col("__rest"))).alias(name)
    head = F.col("__head")
    return found.select(*verbs.columns, "base", pick("past", past(head)), pick("participle", past(head)), pick("gerund", gerund(head)))

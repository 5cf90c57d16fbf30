"""Segmentation, normalisation, quality flags and scores of sentences, all in the JVM but for what canonical composition could change."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Fixed values of the data model, in natural order.
ADULT_WORDS = ("anal", "blowjob", "boobs", "cumshot", "deepthroat", "dildo", "hardcore", "lezbike", "lesbo", "pidhi", "porno", "strapon")
ADULT_SEX_WORDS = ("seks", "seksi", "seksin", "seksit")
ADULT_SEX_STEM = "seksual"
ADULT_STEMS = ("fetish", "lesbian", "masturb", "orgazm", "porn")
ADULT_PHRASES = ("rrip-në",)
REFERENCE_HINTS = (
    "conjugation", "declension", "first-person", "grammar", "indicative", "lidhor", "morfologjik", "paskajor", "participle", "subjunctive",
    "veta e", "koha e", "mënyra", "pjesorja", "e ardhmja", "e caktuar", "e pacaktuar", "e tashmja", "format e së ardhmes",
)
LIST_PHRASE = "e kështu me radhë"
REJECTING_FLAGS = ("adult_or_spam", "markup", "too_short", "too_long", "digit_heavy", "inflection_list", "control_char", "reference_prose")
SOURCE_BONUS = {
    "macocu-sq-1.0-xml": 18, "macocu-genre-sq": 15, "ud-albanian-staf": 12, "ud-albanian-tsa": 12, "hplt-v3-als-latn": 10, "fineweb2-albanian-varieties": 10,
    "leipzig-sqi": 9, "wikimedia-sq-latest": 9, "opus-en-sq-moses-latest": 8, "opus-all-to-sq-moses-latest": 8, "hf-albanian-wiki-clean-lm": 6,
    "hf-albanian-english-bundled": 6, "hf-bigmind-albanian": 6, "hf-albanian-wikiorca": 6, "mc4-sq": 5, "seeuniversity-albanian-corpora-bert": 4, "tatoeba-full": 4, "cc100-sq": 0,
}


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def split_sentences(text: Column) -> Column:
    """Sentences in order: lines, cut after . ! ? or …, with white space collapsed; those without a letter or digit go."""
    pieces = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "([.!?…])", "$1\n"), "[\n\r]")
    tidy = F.transform(pieces, lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    return F.filter(tidy, lambda s: s.rlike(r"[\p{L}\p{N}]"))


def normalized(sentence: Column) -> Column:
    """Runs of letters, digits and _ in lower case with single spaces. Characters are told apart before case is folded."""
    return F.trim(F.lower(F.regexp_replace(sentence, r"[^\p{L}\p{N}_]+", " ")))


def tokens(norm: Column) -> Column:
    return F.filter(F.split(norm, " "), lambda t: t != "")


def token_count(norm: Column) -> Column:
    return F.size(tokens(norm))


def letter_runs(text: Column) -> Column:
    """Runs of letters in lower case, of a text in composed form."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\p{L}+)"), F.lit(1)), F.lower)


@F.pandas_udf(ArrayType(StringType()))
def _composed(runs: pd.Series) -> pd.Series:
    return runs.map(lambda own: None if own is None else [unicodedata.normalize("NFC", t) for t in own])


def search_tokens(text: Column) -> Column:
    """Runs of letters, each in canonical composition, then in lower case. A combining mark is no letter, so it ends a run.

    Spark has no function that composes, so runs go to Python; only those of texts with a character that composition could
    change, which none below U+0300 is, and others as nulls.
    """
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+)"), F.lit(1))
    changing = text.rlike("[^\\x{0}-\\x{2FF}]")
    return F.transform(F.when(changing, _composed(F.when(changing, runs))).otherwise(runs), F.lower)


def normalize_token(token: Column) -> Column:
    return F.lower(F.trim(token))


def diacritic_fold(text: Column) -> Column:
    """Without ë and ç; null where nothing changes."""
    folded = F.translate(text, "ëç", "ec")
    return F.when(folded != text, folded)


def bounded(lower: Column, *hints: str) -> Column:
    """Whether one of the phrases occurs with no letter on either side; one pass for all of them, which tries them only after what is no letter."""
    return lower.rlike(rf"(?:^|[^\p{{L}}])(?:{'|'.join(hints)})(?!\p{{L}})")


def adult_or_spam(sentence: Column, norm: Column | None = None) -> Column:
    """norm: normalized(sentence), where it is at hand. Its words are looked up between spaces; only İ isn't one letter in lower case, so a sentence with it is normalised after that."""
    lower = F.lower(sentence)
    own = normalized(lower) if norm is None else F.when(sentence.contains("İ"), normalized(lower)).otherwise(norm)
    words = F.concat(F.lit(" "), own, F.lit(" ")).rlike(f" (?:(?:{'|'.join(ADULT_WORDS + ADULT_SEX_WORDS)}) |{ADULT_SEX_STEM})")
    return words | _any(lower.contains(s) for s in ADULT_STEMS) | bounded(lower, *ADULT_PHRASES)


def reference_prose(sentence: Column) -> Column:
    lower = F.lower(sentence)
    return bounded(lower, *REFERENCE_HINTS)


def markup(sentence: Column) -> Column:
    return _any(sentence.contains(x) for x in ("<", ">", "&lt;", "&gt;"))


def control_char(sentence: Column) -> Column:
    return sentence.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")


def repeated_future(norm: Column) -> Column:
    """Five tokens in a row that are do të _ do të."""
    return F.concat(F.lit(" "), norm, F.lit(" ")).rlike(" do të [^ ]+ do të ")


def _commas(sentence: Column) -> Column:
    return F.regexp_count(sentence, F.lit(","))


def short_list(sentence: Column, norm: Column) -> Column:
    return (_commas(sentence) >= 3) & (token_count(norm) <= 18)


def dense_list(sentence: Column) -> Column:
    return F.lower(sentence).contains(LIST_PHRASE) & (_commas(sentence) >= 3) & sentence.contains(";")


def too_short(norm: Column) -> Column:
    return token_count(norm) < 4


def too_long(sentence: Column) -> Column:
    """In bytes."""
    return F.octet_length(sentence) > 420


def digit_heavy(sentence: Column) -> Column:
    return F.regexp_count(sentence, F.lit("[0-9]")) > 12


def low_quality(quality: Column) -> Column:
    return F.coalesce(~quality.isin("good", "neargood"), F.lit(False))


def _tests(sentence: Column, norm: Column, quality: Column) -> tuple[tuple[str, Column], ...]:
    return (
        ("low_quality", low_quality(quality)), ("adult_or_spam", adult_or_spam(sentence, norm)), ("markup", markup(sentence)), ("reference_prose", reference_prose(sentence)),
        ("control_char", control_char(sentence)), ("inflection_list", short_list(sentence, norm)), ("inflection_list", dense_list(sentence)), ("inflection_list", repeated_future(norm)),
        ("too_short", too_short(norm)), ("too_long", too_long(sentence)), ("digit_heavy", digit_heavy(sentence)),
    )


def quality_flags(sentence: Column, norm: Column, quality: Column) -> Column:
    """Flags in a fixed order; inflection_list may occur up to three times."""
    return F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in _tests(sentence, norm, quality))), lambda x: x.isNotNull())


#: Flags whose tests cost least, which are asked first.
_CHEAP = ("too_long", "markup", "too_short")


def kept(sentence: Column, norm: Column, quality: Column) -> Column:
    """keep_sentence(quality_flags()), where only the answer is wanted: the first test that rejects a sentence ends it."""
    tests = sorted((t for t in _tests(sentence, norm, quality) if t[0] in REJECTING_FLAGS), key=lambda t: t[0] not in _CHEAP)
    return F.when(_any(F.coalesce(test, F.lit(False)) for _, test in tests), F.lit(False)).otherwise(F.lit(True))


def keep_sentence(flags: Column) -> Column:
    return ~F.arrays_overlap(flags, F.array(*map(F.lit, REJECTING_FLAGS)))


def base_resource(resource: Column) -> Column:
    return F.substring_index(resource, "#", 1)


def source_bonus(resource: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in SOURCE_BONUS.items() for x in kv))
    return F.coalesce(F.element_at(table, base_resource(resource)), F.lit(0))


def score(kind: Column, resource: Column, quality: Column, url: Column, domain: Column, flags: Column, norm: Column) -> Column:
    n = token_count(norm)
    has = lambda f: F.array_contains(flags, f)
    return (
        F.when(kind == "exact_phrase", 100).otherwise(78) + source_bonus(resource) + F.when(quality == "good", 10).when(quality == "neargood", 6).otherwise(0)
        + F.when(url.isNotNull(), 4).otherwise(0) + F.when(domain.isNotNull(), 2).otherwise(0) - F.when(has("reference_prose"), 30).otherwise(0)
        - F.when(has("low_quality"), 12).otherwise(0) + F.when(n.between(7, 28), 8).when(n > 45, -8).otherwise(0)
    ).cast("long")


def url_domain(url: Column) -> Column:
    """Host of an http(s) URL without its port; null for anything else."""
    host = F.regexp_extract(url, r"^https?://([^/:?#]+)", 1)
    return F.when(host != "", host)


def resource_family(resource: Column) -> Column:
    """Families of the coverage report."""
    named = (("hplt-v3-", "hplt-v3"), ("mc4-", "mc4"), ("opus-en-sq", "opus-en-sq"), ("opus-all-to-sq", "opus-all-to-sq"), ("fineweb2-", "fineweb2"), ("macocu-", "macocu"), ("cc100-", "cc100"), ("hf-", "huggingface"), ("wikimedia-", "wikimedia"))
    return _families(resource, named)


def audit_family(resource: Column) -> Column:
    """Families of the audit, which differ from the coverage report's."""
    named = (
        ("hplt-v3-", "HPLT v3"), ("mc4-", "mC4"), ("opus-", "OPUS"), ("fineweb2-", "FineWeb2"), ("macocu-", "MaCoCu"), ("cc100-", "CC100"), ("hf-", "Hugging Face"), ("wikimedia-", "Wikimedia"),
        ("leipzig-", "Leipzig"), ("seeuniversity-", "SEEUniversity"), ("tatoeba-", "Tatoeba"), ("ud-", "Universal Dependencies"),
    )
    return _families(resource, named)


def _families(resource: Column, named) -> Column:
    out = F.when(F.lit(False), "")
    for prefix, family in named:
        out = out.when(resource.startswith(prefix), family)
    return out.otherwise(base_resource(resource))


def useful_text(text: Column) -> Column:
    return text.rlike(r"\p{L}") & (F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) >= 3)


def parallel_pair(sq: Column, en: Column) -> Column:
    """Both sides of 1 to 260 characters without "<"."""
    good = lambda s: F.char_length(s).between(1, 260) & ~s.contains("<")
    return good(sq) & good(en)


def ascii_id(text: Column) -> Column:
    return F.lower(F.translate(text, "ëçËÇ", "ecEC"))


def target_id(verb: Column, signature: Column, key: Column) -> Column:
    return F.regexp_replace(F.concat_ws(":", verb, signature, key), r"\s+", "_")


def percent(part: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(part / total)


def md_escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def decode_slug(slug: Column) -> Column:
    """Up to three rounds of percent decoding; "+" is no space here, and what can't be decoded stays."""
    out = slug
    for _ in range(3):
        out = F.coalesce(F.try_url_decode(F.replace(out, F.lit("+"), F.lit("%2B"))), out)
    return out


def highlight(sentence: Column, form: Column) -> Column:
    """Before, hit and after of a form's first occurrence in either case; the whole sentence is before where there is none."""
    at = F.instr(F.lower(sentence), F.lower(form))
    n = F.char_length(form)
    return F.when(at > 0, F.struct(F.substr(sentence, F.lit(1), at - 1).alias("before"), F.substr(sentence, at, n).alias("hit"), F.substr(sentence, at + n).alias("after"))).otherwise(
        F.struct(sentence.alias("before"), F.lit("").alias("hit"), F.lit("").alias("after"))
    )

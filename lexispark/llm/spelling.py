"""Spelling variants grouped by a symmetric-delete join.

Words are runs of letters of whole texts, with A-Z in lower case; an occurrence whose digest `noise` divides loses one letter,
so that the counts hold misspellings whose origin is known. Every frequent word emits itself and each distinct word that
one deletion makes of it, as 62-bit hashes: two words of distance one share such a key. Keys meet in an equi-join, pairs are
verified by their exact distance, a word's form is its most frequent near word where that is clearly more frequent, and
pointers to forms are doubled until all are roots: a form is at least twice as frequent, so a chain has few links.

A word of any length costs its number of letters, as the hash of each deletion comes from hashes of prefixes (sums of letters
times powers modulo two primes); a collision only adds a pair that verification drops. A key's words differ in one place, so
they are bounded by alphabet and length; root words with many variants go by broadcast (`join_hot`). No other join may
broadcast: Spark takes words and ids for as small as their compressed files, and keys for as many as words (`sorted_join`).

Defined results: null and empty texts have no words; a null doc_id counts as an empty one in the digest; repeated rows count
as often as they are there; ties between near words of equal count go to the smallest in code-point order; an empty table
gives no rows; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, columns, join_hot, materialize, only, ragged, settled, steps, strings

RUN = "[A-Za-zÀ-ÿ]+"
NOISE = 97
LEAST_LETTERS, LEAST_COUNT = 5, 3
#: A form is at least so many times as frequent.
RATIO = 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Two primes below 2^31, each with a base and the base's inverse.
_PRIMES = [(p, b, pow(b, -1, p)) for p, b in ((2147483647, 1103515245), (2147483629, 1664525))]


def ascii_lower(run: Column) -> Column:
    """A-Z in lower case, other letters as they are; lower() does that alone where no other capital stands."""
    return F.when(run.rlike("[^a-zA-Zß-ÿ]"), F.translate(run, _UPPER, _LOWER)).otherwise(F.lower(run))


def count_words(docs: DataFrame, noise: int = NOISE, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: of documents (doc_id string, text), those long and frequent enough."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.filter(F.char_length("run") >= least_letters).select("doc_id", ascii_lower(F.col("run")).alias("run"))
    h, length = F.crc32(F.concat(F.coalesce("doc_id", F.lit("")), F.lit(":"), "run")), F.char_length("run")
    at = (F.col("h") % length).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % noise == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.char_length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _powers(base: int, p: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate((out, out * np.uint64(pow(base, len(out), p)) % np.uint64(p)))
    return out[:n]


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the word, key, whether it is of the whole word: the word and its distinct single deletions."""
    sizes = np.array([len(w) for w in words], np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    place = ragged(np.zeros(len(words), np.int64), sizes)
    word = np.repeat(np.arange(len(words)), sizes)
    whole, deleted = np.zeros(len(words), np.uint64), np.zeros(len(letters), np.uint64)
    for p, base, inverse in _PRIMES:
        terms = letters * _powers(base, p, int(sizes.max(initial=1)))[place] % np.uint64(p)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
        total = sums[ends] - sums[begins]
        before, after = sums[:-1] - sums[begins][word], sums[ends][word] - sums[1:]
        whole = whole << np.uint64(31) | total % np.uint64(p)
        deleted = deleted << np.uint64(31) | (before + after % np.uint64(p) * np.uint64(inverse)) % np.uint64(p)
    new = np.ones(len(letters), bool)  # a letter like the one before it gives the same deletion
    new[1:] = (letters[1:] != letters[:-1]) | (word[1:] != word[:-1])
    return np.concatenate((np.arange(len(words)), word[new])), np.concatenate((whole, deleted[new])).view(np.int64), np.arange(len(words) + int(new.sum())) < len(words)


def sorted_join(a: DataFrame, b: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """a JOIN b on key, both sides shuffled and sorted, however small Spark takes them to be."""
    return a.join(b.hint("merge"), key, how)


_KEYS = "key long, id long, whole boolean"


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    only()
    for b in steps(batches, "word", 100_000):
        word, key, whole = deletion_keys(strings(b.column("word")))
        yield batch(_KEYS, [pa.array(key), pa.array(b.column("id").to_numpy()[word]), pa.array(whole)])
    only()


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs (a, b) of ids, a < b, of words at distance exactly one, each once. words: id, word, each word once."""
    keys = words.select("id", "word").mapInArrow(_emit, _KEYS)
    x, y = (keys.select("key", F.col("id").alias(i), F.col("whole").alias(f"{i}_whole")) for i in "ab")
    # two whole words share no key, and two deletions of one length are looked at once
    met = sorted_join(x, y, "key").filter(~F.col("b_whole") & (F.col("a_whole") | (F.col("a") < F.col("b"))) & (F.col("a") != F.col("b")))
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    a, b = (words.select(F.col("id").alias(i), F.col("word").alias(f"{i}_word")) for i in "ab")
    spelled = sorted_join(sorted_join(pairs, a, "a"), b, "b")
    return spelled.filter(F.levenshtein("a_word", "b_word", 1) == 1).select("a", "b")


def roots(forms: DataFrame) -> DataFrame:
    """id and the last id (`to`) that pointers (id, to) lead to, by doubling. They must not lead in circles."""
    cur = materialize(forms, "pointers")
    while True:
        total, sizes = cur.count(), cur.groupBy("to").agg(F.count("*").alias("size"))
        onward = materialize(sorted_join(cur.select(F.col("id").alias("to"), F.col("to").alias("next")), sizes, "to"), "onward")
        if not onward.limit(1).count():
            return cur
        cur = materialize(join_hot(cur, onward.hint("merge"), ["to"], "size", total, "left").select("id", F.coalesce("next", "to").alias("to")), "pointers")


def spelling_variants(docs: DataFrame, ratio: float = RATIO, noise: int = NOISE, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per word: word, form, root, n, n_near, form_n."""

    def grouped() -> DataFrame:
        counted = count_words(columns(docs, doc_id=(id_col, "string"), text=(text_col, None)), noise, least_letters, least_count)
        words = materialize(materialize(counted, "counted").withColumn("id", F.monotonically_increasing_id()), "words")
        pairs = materialize(near_pairs(words), "near")
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        other = words.select(F.col("id").alias("b"), "word", "n")
        best = sorted_join(both, other, "b").groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "word", "b")).alias("best"))
        known = sorted_join(words, best.withColumnRenamed("a", "id"), "id", "left").withColumn("is_form", -F.col("best.less") >= ratio * F.col("n"))
        best_of = lambda field: F.when(F.col("is_form"), F.col("best")[field])
        known = materialize(known.select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), best_of("word").alias("form"), (-best_of("less")).alias("form_n"), best_of("b").alias("to")), "known")
        last = materialize(roots(known.filter("to IS NOT NULL").select("id", "to")), "last")
        ends = sorted_join(words.select(F.col("id").alias("to"), F.col("word").alias("root")), last.groupBy("to").agg(F.count("*").alias("size")), "to")
        rooted = join_hot(last, ends.hint("merge"), ["to"], "size", last.count()).select("id", "root")
        return sorted_join(known.drop("to"), rooted, "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

    return settled(grouped, docs.sparkSession, "variants")

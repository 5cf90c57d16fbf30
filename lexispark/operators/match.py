"""The phrase matcher and what is built on it: variants, guard, retention, statistics, traces.

In normalised text (tokens joined by one space) an occurrence of a phrase with a space or an edge on both sides is a slice of
tokens that equals the phrase. So all overlapping occurrences of all phrases are an equi-join of token n-grams, of the lengths that
phrases have, with the table of phrases; where that table may go to every task, a tree of tokens gives the same without n-grams.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from ..cluster import new_path
from ..functions import text as T

#: Bytes of patterns up to which the table is sent to every task, and what a row of it takes besides its text: a string and its nodes in the tree, and a row of a hash table.
BROADCAST_BYTES, PATTERN_BYTES = 128_000_000, 300
#: Rows of labels, an id and a flag each, up to which they are sent to every task: about 128 MB as a hash table.
LABEL_ROWS = 2_000_000
#: Rows of retained hits up to which they are sent to every task that reads sentences for them.
HIT_ROWS = 300_000
CLITICS = ("e", "i", "më", "me", "na", "ju", "u", "ia", "ua")
CONTRACTED = ("ta", "t i", "t ia", "t ua", "t u")
PARTICLES = ("nuk", "mos", "të", "te", "do", "s")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files are fewer than those; a table of many files stays as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def sentences(documents: DataFrame, resource: str = "source", labels: DataFrame | None = None) -> DataFrame:
    """Sentences of documents (doc_id, text and a resource column): resource_id, doc_id, position from 1, sentence, norm, quality."""
    docs = spread(documents.select(F.col(resource).alias("resource_id"), "doc_id", "text"))
    if labels is not None:
        good = labels.select(F.col("doc_id"), F.when(F.col("quality") == 1, "good").alias("quality"))
        # Spark's own limit for a broadcast is a few hundred thousand of these rows; beyond, all texts would be shuffled for one flag
        docs = docs.join(F.broadcast(good) if good.count() <= LABEL_ROWS else good, "doc_id", "left")
    else:
        docs = docs.withColumn("quality", F.lit(None).cast("string"))
    found = docs.select("resource_id", "doc_id", "quality", F.posexplode(T.split_sentences(F.col("text"))).alias("position", "sentence"))
    return found.select("resource_id", "doc_id", (F.col("position") + 1).alias("position"), "sentence", T.normalized(F.col("sentence")).alias("norm"), "quality")


def target_patterns(targets: DataFrame) -> DataFrame:
    """Patterns of targets (target_id, tokens): the canonical one, te mos order, s negative, and folds of these; the first of equal patterns stays."""
    t = F.col("tokens")
    rest = lambda k: F.slice(t, k + 1, F.greatest(F.size(t) - k, F.lit(0)))
    base = F.array(
        F.struct(F.lit("canonical").alias("variant_kind"), F.array_join(t, " ").alias("pattern")),
        F.when((F.get(t, 0) == "mos") & (F.get(t, 1) == "të"), F.struct(F.lit("te_mos_order").alias("variant_kind"), F.array_join(F.concat(F.array(F.lit("të"), F.lit("mos")), rest(2)), " ").alias("pattern"))),
        F.when((F.get(t, 0) == "nuk") & (F.size(t) > 1), F.struct(F.lit("s_negative").alias("variant_kind"), F.array_join(F.concat(F.array(F.lit("s")), rest(1)), " ").alias("pattern"))),
    )
    base = F.filter(base, lambda p: p.isNotNull() & (p["pattern"] != ""))
    folds = F.filter(F.transform(base, lambda p: F.struct(F.lit("diacritic_fold").alias("variant_kind"), T.diacritic_fold(p["pattern"]).alias("pattern"))), lambda p: p["pattern"].isNotNull())
    rows = targets.filter(F.size("tokens") > 0).select("target_id", F.size("tokens").alias("n_tokens"), F.posexplode(F.concat(base, folds)).alias("nth", "p")).select("target_id", "n_tokens", "nth", "p.*")
    first = Window.partitionBy("target_id", "pattern").orderBy("nth")
    kind = F.when(F.col("n_tokens") == 1, "exact_token").otherwise("exact_phrase")
    return rows.withColumn("k", F.row_number().over(first)).filter("k = 1").select("target_id", kind.alias("match_kind"), "variant_kind", "pattern")


def ngrams(tokens: str, lengths: list[int]) -> Column:
    """All slices of a column of tokens with the given lengths, as (end, gram)."""
    none = F.array().cast("array<struct<end:int,gram:string>>")

    def of(n: int) -> Column:
        gram = lambda end: F.struct(end.alias("end"), F.array_join(F.slice(F.col(tokens), end - (n - 1), n), " ").alias("gram"))
        if n == 1:
            return F.transform(F.col(tokens), lambda t, i: F.struct((i + 1).alias("end"), t.alias("gram")))
        return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(n), F.size(tokens)), gram)).otherwise(none)

    return F.concat(*map(of, lengths))


class Trie:
    """Phrases as a tree of their tokens, one sorted array of (node, token) for each depth, in which numpy looks up all places of a batch at once."""

    def __init__(self, phrases: list[str]):
        self.phrases = phrases
        split = [p.split(" ") for p in phrases]
        self.tokens = sorted({t for p in split for t in p})
        code = {t: k for k, t in enumerate(self.tokens)}
        self.keys: list[np.ndarray] = []
        self.phrase: list[np.ndarray] = []  # by node: the phrase that ends there, or -1
        node = np.zeros(len(phrases), np.int64)
        depth, left = 0, np.arange(len(phrases))
        while len(left):
            key = node[left] * len(self.tokens) + np.array([code[split[i][depth]] for i in left.tolist()], np.int64)
            keys, node[left] = np.unique(key, return_inverse=True)
            ends = np.full(len(keys), -1, np.int64)
            done = np.array([len(split[i]) == depth + 1 for i in left.tolist()], bool)
            ends[node[left[done]]] = left[done]
            self.keys.append(keys)
            self.phrase.append(ends)
            depth, left = depth + 1, left[~done]

    def find(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, number of the last token, and phrase of every occurrence in texts whose tokens one space keeps apart."""
        split = pc.split_pattern(pc.fill_null(texts, ""), " ")
        offsets = split.offsets.to_numpy()
        flat, offsets = split.flatten(), offsets - offsets[0]
        code = pc.fill_null(pc.index_in(flat, value_set=pa.array(self.tokens, pa.string())), -1).to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(texts)), np.diff(offsets))
        at = np.flatnonzero(code >= 0)
        node = np.zeros(len(at), np.int64)
        out = []
        for depth, (keys, phrase) in enumerate(zip(self.keys, self.phrase)):
            last = at + depth
            here = last < len(code)
            here[here] = (row[last[here]] == row[at[here]]) & (code[last[here]] >= 0)
            at, node = at[here], node[here]
            key = node * len(self.tokens) + code[at + depth]
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            here = keys[place] == key
            at, node = at[here], place[here]
            found = phrase[node]
            hit = found >= 0
            out.append((row[at[hit]], at[hit] + depth + 1 - offsets[row[at[hit]]], found[hit]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 3


def _search(phrases: Broadcast, norm: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, texts = phrases.value, pa.array(phrases.value.phrases, pa.string())
        for b in batches:
            row, end, phrase = trie.find(b.column(norm))
            if len(row):
                order = np.argsort(row, kind="stable")
                hit, counts = np.unique(row, return_counts=True)
                places = pa.StructArray.from_arrays([pa.array(end[order].astype(np.int32)), texts.take(pa.array(phrase[order]))], names=["end", "pattern"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), places)
                found = b.take(pa.array(hit))
                yield pa.RecordBatch.from_arrays([*found.columns, lists], names=[*found.schema.names, "__m"])

    return run


def phrase_match(rows: DataFrame, patterns: DataFrame, norm: str = "norm") -> DataFrame:
    """Every occurrence of every pattern in rows, with the columns of both, and end (number of the last token).

    Overlaps and repeats count; a phrase of several targets gives a row for each. The bytes of the patterns are counted
    first. Up to BROADCAST_BYTES their texts go to every task as a tree of tokens, which numpy looks up for Arrow batches of
    rows: an exact match, without an n-gram for each place, and no shuffle. Beyond, slices around rare tokens are shuffled to
    the patterns as hashes, and what matches comes back to the rows and is compared.
    """
    found = matched_rows(rows, patterns, norm)
    if found is None:
        return _by_shuffle(rows, patterns, norm)
    return found.select(*rows.columns, F.explode("__m").alias("__m")).select(*rows.columns, "__m.*").join(F.broadcast(patterns), "pattern")


def matched_rows(rows: DataFrame, patterns: DataFrame, norm: str = "norm") -> DataFrame | None:
    """Rows that have a pattern, each once, with its occurrences (__m: array of end and pattern); None if the patterns are too large to go to every task."""
    spark = rows.sparkSession
    sizes = patterns.select(F.size(F.split("pattern", " ")).alias("n"), F.octet_length("pattern").alias("bytes")).groupBy("n").agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes")).collect()
    if sum(r["bytes"] + PATTERN_BYTES * r["rows"] for r in sizes) > BROADCAST_BYTES:
        return None
    trie = Trie(sorted(r["pattern"] for r in patterns.select("pattern").distinct().collect()))
    place = T_.StructType([T_.StructField("end", T_.IntegerType()), T_.StructField("pattern", T_.StringType())])
    schema = T_.StructType([*rows.schema.fields, T_.StructField("__m", T_.ArrayType(place))])
    return rows.mapInArrow(_search(spark.sparkContext.broadcast(trie), rows.columns.index(norm)), schema)


# --- patterns too many for every task -----------------------------------------------------------------------------------

#: Bits of the filter of anchors that goes to every task: 8 MB at most, whatever the patterns.
FILTER_BITS = 1 << 26
#: A token that makes up more than one in so many of all is frequent.
FREQUENT = 2000
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def _token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, which one space keeps apart, and where each text's begin (with the end of all)."""
    split = pc.split_pattern(pc.fill_null(texts, ""), " ")
    offsets, flat = split.offsets.to_numpy().astype(np.int64), split.flatten().dictionary_encode()
    own = np.array([int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little") for t in flat.dictionary.to_pylist()], np.uint64)
    return own[flat.indices.to_numpy()] if len(own) else np.empty(0, np.uint64), offsets - offsets[0]


def _gram_hashes(tokens: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n tokens from each start on."""
    out = np.full(len(starts), n, np.uint64)
    for k in range(n):
        out = _mixed(out * np.uint64(_ODD[0]) + tokens[starts + k] * np.uint64(_ODD[1]))
    return out


_ANCHORED = "pattern string, n int, place int, slot long, gram long, anchor string"


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Patterns (pattern, place of its anchor) with the hashes that rows are asked for."""
    for b in batches:
        tokens, offsets = _token_hashes(b.column(0))
        n, place = np.diff(offsets), b.column(1).to_numpy().astype(np.int64)
        gram = np.zeros(b.num_rows, np.uint64)
        for size in np.unique(n).tolist():
            gram[n == size] = _gram_hashes(tokens, offsets[:-1][n == size], size)
        slot = tokens[offsets[:-1] + place] % np.uint64(FILTER_BITS)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n.astype(np.int32)), b.column(1), pa.array(slot.view(np.int64)), pa.array(gram.view(np.int64)), b.column(2)], names=[x.split(" ")[0] for x in _ANCHORED.split(", ")])


def anchored_patterns(rows: DataFrame, patterns: DataFrame, norm: str = "norm") -> DataFrame:
    """Distinct patterns with their anchor, the token that rows have least often (ties: the smallest), its place and its count, and hashes."""
    spelled = patterns.select("pattern").distinct().select("pattern", F.posexplode(F.split("pattern", " ")).alias("place", "token"))
    counts = rows.select(F.explode(F.split(norm, " ")).alias("token")).join(spelled.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("held"))
    rated = spelled.join(counts, "token", "left").withColumn("held", F.coalesce("held", F.lit(0).cast("long")))
    least = rated.groupBy("pattern").agg(F.min(F.struct("held", "token", "place")).alias("a"))
    hashed = least.select("pattern", F.col("a.place").alias("place"), F.col("a.token").alias("anchor")).mapInArrow(_anchored, _ANCHORED)
    return hashed.join(least.select("pattern", F.col("a.held").alias("held")), "pattern")


def _filter_of(slots: DataFrame) -> np.ndarray:
    """The bits of the anchors, put together from the words that are not 0."""
    words = slots.select(F.expr("slot div 64").alias("word"), F.expr("shiftleft(1L, cast(slot % 64 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    table = words.toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    return out.view(np.uint64)


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        tokens, _ = _token_hashes(b.column(0))
        yield pa.RecordBatch.from_arrays([pa.array((np.unique(tokens % np.uint64(FILTER_BITS))).view(np.int64))], names=["slot"])


def _known(bits: Broadcast, pattern: int):
    """Rows of a batch whose pattern has tokens of the filter only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, offsets = _token_hashes(b.column(pattern))
            slot = tokens % np.uint64(FILTER_BITS)
            missing = np.cumsum(np.concatenate(([0], 1 - (bits.value[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(np.int64))))
            yield b.filter(pa.array(missing[offsets[1:]] == missing[offsets[:-1]]))

    return run


def token_counts(rows: DataFrame, flag: str = "keep", norm: str = "norm") -> DataFrame:
    """By token: raw, its places in rows, and kept, those in rows with the flag."""
    each = rows.select(F.explode(F.split(norm, " ")).alias("token"), flag).filter("token <> ''")
    return each.groupBy("token").agg(F.count("*").alias("raw"), F.count_if(flag).alias("kept"))


def possible(patterns: DataFrame, tokens: DataFrame) -> DataFrame:
    """Rows of patterns without those that have a token which isn't among tokens, told by a filter of 8 MB that goes to every task; no pattern is shuffled.

    A few others may stay, as two tokens can share a bit, so what is found for the rest has to be exact."""
    slots = tokens.select("token").mapInArrow(_slots, "slot long").distinct()
    bits = patterns.sparkSession.sparkContext.broadcast(_filter_of(slots))
    return patterns.mapInArrow(_known(bits, patterns.columns.index("pattern")), patterns.schema)


def pattern_counts(rows: DataFrame, patterns: DataFrame, tokens: DataFrame, flag: str = "keep", norm: str = "norm") -> DataFrame:
    """Of each distinct pattern that rows have: raw, its places, and kept, those in rows with the flag.

    Patterns of one token are looked up in token_counts(), which combines in each task first, so that no place of a frequent token
    is a row that is shuffled; phrases go through the matcher.
    """
    distinct = patterns.select("pattern").distinct()
    single = F.instr("pattern", " ") == 0
    found = phrase_match(rows.select(flag, norm), distinct.filter(~single), norm).groupBy("pattern").agg(F.count("*").alias("raw"), F.count_if(flag).alias("kept"))
    return tokens.withColumnRenamed("token", "pattern").join(distinct.filter(single), "pattern", "left_semi").select("pattern", "raw", "kept").unionByName(found)


_GRAMS = "a long, b long, start int, gram long, n int"


def _grams(bits: Broadcast, shapes: list[tuple[int, int]]):
    """Hashes of the slices around anchors: no other slice is made. Takes rows of a, b and the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, offsets = _token_hashes(b.column(2))
            slot = tokens % np.uint64(FILTER_BITS)
            at = np.flatnonzero(bits.value[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1))
            row = np.searchsorted(offsets, at, "right") - 1
            found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), 0)]
            for n, place in shapes:
                start = at - place
                ok = (start >= offsets[row]) & (start + n <= offsets[row + 1])
                found.append((row[ok], start[ok], _gram_hashes(tokens, start[ok], n), n))
            rows, starts, grams = (np.concatenate(x) for x in list(zip(*found))[:3])
            sizes = np.concatenate([np.full(len(f[0]), f[3], np.int32) for f in found])
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array((starts - offsets[rows]).astype(np.int32)), pa.array(grams.view(np.int64)), pa.array(sizes)], names=[x.split(" ")[0] for x in _GRAMS.split(", ")])

    return run


def _found(rows: DataFrame, ready: DataFrame, norm: str, salts: int) -> DataFrame:
    """Texts of rows, as two hashes (__a, __b), with start, n and pattern of slices whose hash a pattern has."""
    shapes = sorted((r["n"], r["place"]) for r in ready.select("n", "place").distinct().collect())
    bits = rows.sparkSession.sparkContext.broadcast(_filter_of(ready.select("slot").distinct()))
    texts = rows.select(F.xxhash64(norm).alias("a"), F.xxhash64(F.lit(1), norm).alias("b"), norm)
    slices, asked = texts.mapInArrow(_grams(bits, shapes), _GRAMS), ready.select("gram", "n", "pattern")
    on = ["gram", "n"]
    if salts > 1:
        slices = slices.withColumn("salt", F.pmod(F.xxhash64("a", "b", "start"), F.lit(salts)).cast("int"))
        asked, on = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*on, "salt"]
    return slices.join(asked, on).select(F.col("a").alias("__a"), F.col("b").alias("__b"), "start", "n", "pattern").distinct()


def _by_shuffle(rows: DataFrame, patterns: DataFrame, norm: str) -> DataFrame:
    """Each pattern stands at its anchor, its rarest token: a filter of anchors goes to every task, and only slices around a
    token that passes it are made, as hashes, and shuffled to the patterns; rows get back what was found for their text, and
    the slice is compared with the pattern there.

    A pattern of frequent tokens alone, like "of the", would draw a large part of all slices to one task. Such patterns go to
    every task as a tree where they are few; else their slices are dealt over as many salts as the most frequent anchor needs.
    """
    path = new_path(rows.sparkSession, "anchored")
    anchored_patterns(rows, patterns, norm).write.parquet(path)
    ready = rows.sparkSession.read.parquet(path)
    total = max(1, rows.agg(F.sum(F.size(F.split(norm, " ")))).first()[0] or 0)
    frequent = F.col("held") * FREQUENT > total
    size = ready.groupBy(frequent.alias("frequent")).agg(F.count("*").alias("rows"), F.sum(F.octet_length("pattern")).alias("bytes"), F.max("held").alias("held")).collect()
    out, found = [], []
    for part in size:
        own = ready.filter(frequent == part["frequent"])
        few = patterns.join(own.select("pattern"), "pattern", "left_semi")
        matched = matched_rows(rows, few, norm) if part["frequent"] and part["bytes"] + PATTERN_BYTES * part["rows"] <= BROADCAST_BYTES else None
        if matched is not None:
            out.append(matched.select(*rows.columns, F.explode("__m").alias("__m")).select(*rows.columns, "__m.*").join(F.broadcast(few), "pattern"))
        else:
            found.append(_found(rows, own, norm, -(-part["held"] * FREQUENT // total) if part["frequent"] else 1))
    if found:
        met = found[0] if len(found) == 1 else found[0].unionByName(found[1])
        back = rows.withColumns({"__a": F.xxhash64(norm), "__b": F.xxhash64(F.lit(1), norm)}).join(met, ["__a", "__b"])
        back = back.filter(F.array_join(F.slice(F.split(norm, " "), F.col("start") + 1, F.col("n")), " ") == F.col("pattern"))
        out.append(back.select(*rows.columns, (F.col("start") + F.col("n")).alias("end"), "pattern").join(patterns, "pattern"))
    if not out:
        return rows.withColumn("end", F.lit(0)).join(patterns, F.lit(False))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def apostrophe_guard(kind: Column, sentence: Column) -> Column:
    """s negatives need s' (straight or curly) in the sentence."""
    return F.when(kind == "s_negative", sentence.rlike("[sS]['’]")).otherwise(F.lit(True))


def stress_patterns(targets: DataFrame) -> DataFrame:
    """Patterns with clitics and contractions for targets of two tokens and more: target_id, kind, pattern, anchor."""
    t = F.col("tokens")
    n = F.size(t)
    part = lambda a, b: F.slice(t, a + 1, F.greatest(b - a, F.lit(0)))  # noqa: E731  tokens a up to b
    head = F.array(F.element_at(t, -1))
    clitics = F.array(*map(F.lit, CLITICS))
    words = lambda *xs: F.array(*map(F.lit, xs))
    made = lambda kind, make, over: F.transform(over, lambda c: F.struct(F.lit(kind).alias("kind"), make(c).alias("p")))
    none = F.array().cast("array<struct<kind:string,p:array<string>>>")
    mos_te = (F.get(t, 0) == "mos") & (F.get(t, 1) == "të")
    prefix = part(F.lit(0), n - 1)
    both = F.flatten(
        F.transform(clitics, lambda c: F.array(
            F.struct(F.lit("te_mos_clitic").alias("kind"), F.concat(words("të", "mos"), part(F.lit(2), n - 1), F.array(c), head).alias("p")),
            F.struct(F.lit("mos_clitic_no_te").alias("kind"), F.concat(words("mos"), part(F.lit(2), n - 1), F.array(c), head).alias("p")),
        ))
    )
    every = F.concat(
        made("clitic_before_head", lambda c: F.concat(prefix, F.array(c), head), clitics),
        F.when(F.get(t, 0) == "nuk", made("s_clitic_before_head", lambda c: F.concat(words("s"), part(F.lit(1), n - 1), F.array(c), head), clitics)).otherwise(none),
        F.when(mos_te, both).otherwise(none),
        F.when(F.array_contains(prefix, "të"), F.array(F.struct(F.lit("short_t_particle").alias("kind"), F.transform(t, lambda x: F.when(x == "të", "t").otherwise(x)).alias("p")))).otherwise(none),
        F.when(F.element_at(prefix, -1) == "të", made("t_contracted_clitic", lambda c: F.concat(part(F.lit(0), n - 2), F.split(c, " "), head), F.array(*map(F.lit, CONTRACTED)))).otherwise(none),
    )
    rows = targets.filter(F.size("tokens") >= 2).select("target_id", "tokens", F.posexplode(every).alias("nth", "s")).filter(F.col("s.p") != F.col("tokens"))
    rows = rows.select("target_id", "nth", F.col("s.kind").alias("kind"), F.array_join("s.p", " ").alias("pattern"))
    first = lambda d: d.withColumn("k", F.row_number().over(Window.partitionBy("target_id", "pattern").orderBy("nth"))).filter("k = 1").drop("k")
    rows = first(rows)
    folds = rows.select("target_id", (F.col("nth") + 1000).alias("nth"), F.concat("kind", F.lit("_diacritic_fold")).alias("kind"), T.diacritic_fold(F.col("pattern")).alias("pattern")).filter("pattern IS NOT NULL")
    return first(rows.unionByName(folds)).select("target_id", "kind", "pattern", anchor(F.split("pattern", " "), PARTICLES).alias("anchor"))


def anchor(tokens: Column, but: tuple[str, ...] = ()) -> Column:
    """The longest token (the last of several), particles only where there is nothing else."""
    some = F.filter(tokens, lambda t: ~t.isin(*but)) if but else tokens
    longest = lambda a: F.array_max(F.transform(a, lambda t, i: F.struct(F.char_length(t).alias("n"), i.alias("i"), t.alias("t"))))["t"]
    return F.when(F.size(some) > 0, longest(some)).otherwise(longest(tokens))


KEY = ("resource_id", "doc_id", "position")


def occurrences(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """Matches of sentences that pass the guard, with flags and score; of several matches of one target in a sentence the first by (end, longer pattern, pattern) stays.

    Flags and scores are made where the text is; what is shuffled, after a first choice in each task, has no text. with_text() fetches it.
    """
    none = F.lit(None).cast("string")
    score = lambda kind: T.score(F.lit(kind), F.col("resource_id"), F.col("quality"), none, none, F.col("flags"), F.col("norm"))

    def judged(d: DataFrame) -> DataFrame:
        """What rules say of a sentence, for any match in it; its texts go."""
        d = d.withColumns({"flags": T.quality_flags(F.col("sentence"), F.col("norm"), F.col("quality")), "has_s": apostrophe_guard(F.lit("s_negative"), F.col("sentence"))})
        return d.withColumns({"keep": T.keep_sentence(F.col("flags")), "of_token": score("exact_token"), "of_phrase": score("exact_phrase"), "sentence_chars": F.char_length("sentence")}).drop("sentence", "norm")

    found = matched_rows(rows, patterns)
    if found is None:
        hits = judged(_by_shuffle(rows, patterns, "norm"))
    else:
        hits = judged(found).withColumn("__m", F.explode("__m")).select("*", "__m.*").drop("__m").join(F.broadcast(patterns), "pattern")
    hits = hits.filter((F.col("variant_kind") != "s_negative") | F.col("has_s")).withColumn("score", F.when(F.col("match_kind") == "exact_phrase", F.col("of_phrase")).otherwise(F.col("of_token")))
    order = ["end", (-F.char_length("pattern")).alias("shorter"), "pattern", "variant_kind"]
    kept = ["match_kind", "quality", "flags", "score", "keep", "sentence_chars"]
    first = hits.groupBy("target_id", *KEY).agg(F.min(F.struct(*order, *kept)).alias("h"))
    return first.select("target_id", *KEY, "h.*").drop("shorter")


def with_text(hits: DataFrame, rows: DataFrame) -> DataFrame:
    """hits, a few that were retained, with their sentences.

    They are written first, so they are counted before sentences are read: up to HIT_ROWS of them go to every task, and no sentence is shuffled.
    """
    path, schema = new_path(hits.sparkSession, "hits"), hits.schema
    hits.write.parquet(path)
    few = hits.sparkSession.read.schema(schema).parquet(path)
    return (F.broadcast(few) if few.count() <= HIT_ROWS else few).join(rows.select(*KEY, "sentence"), list(KEY))


def retain(hits: DataFrame, most: int = 3) -> DataFrame:
    """At most `most` kept sentences of each target, by score, then resource, document and position: a total order, where a scan's order of arrival would vary."""
    best = Window.partitionBy("target_id").orderBy(F.desc("score"), "resource_id", "doc_id", "position")
    return hits.filter("keep").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most)


def scan_stats(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """By resource: candidates seen, empty, without a match, rejected, and occurrences kept. Candidates are counted where they are; only hits are grouped by sentence."""
    seen = rows.groupBy("resource_id").agg(F.count("*").alias("candidates_seen"), F.count_if(F.col("norm") == "").alias("empty_candidates"))
    matched = hits.groupBy(*KEY).agg(F.max("keep").alias("keep"), F.count_if("keep").alias("kept"))
    found = matched.groupBy("resource_id").agg(F.count("*").alias("matched"), F.count_if("keep").alias("sentences_kept"), F.sum("kept").alias("occurrences"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return seen.join(found, "resource_id", "left").select(
        "resource_id", "candidates_seen", "empty_candidates", (F.col("candidates_seen") - F.col("empty_candidates") - zero("matched")).alias("unmatched_rejected"),
        (zero("matched") - zero("sentences_kept")).alias("quality_rejected"), zero("sentences_kept").alias("sentences_kept"), zero("occurrences").alias("occurrences"),
    )


def trace(rows: DataFrame, patterns: DataFrame, most: int = 3) -> DataFrame:
    """For each target: raw matches, those that the guard, the cap and the quality rules drop in this order, and those emitted.

    The cap counts by target and resource, so counts are enough; no match is sorted. Rules look at sentences once, not at each match.
    """
    judged = [apostrophe_guard(F.lit("s_negative"), F.col("sentence")).alias("has_s"), T.keep_sentence(T.quality_flags(F.col("sentence"), F.col("norm"), F.col("quality"))).alias("keep")]
    found = matched_rows(rows, patterns)
    if found is None:
        hits = _by_shuffle(rows, patterns, "norm").select("target_id", "variant_kind", "resource_id", *judged)
    else:
        hits = found.select("resource_id", "__m", *judged).select("resource_id", "has_s", "keep", F.explode("__m.pattern").alias("pattern")).join(F.broadcast(patterns), "pattern")
    guarded = (F.col("variant_kind") != "s_negative") | F.col("has_s")
    by = hits.groupBy("target_id", "resource_id").agg(F.count("*").alias("raw"), F.count_if(~guarded).alias("guard"), F.count_if(guarded & ~F.col("keep")).alias("quality"), F.count_if(guarded & F.col("keep")).alias("passed"))
    return by.groupBy("target_id").agg(
        F.sum("raw").alias("raw_pattern_matches"), F.sum("guard").alias("variant_rejected_matches"), F.sum("quality").alias("quality_rejected_matches"),
        F.sum(F.greatest(F.col("passed") - most, F.lit(0))).alias("local_cap_dropped_matches"), F.sum(F.least(F.col("passed"), F.lit(most))).alias("emitted_matches_before_writer_cap"),
    )

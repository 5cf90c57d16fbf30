"""All near texts by a Jaccard join of their shingle sets, with candidates filtered under several global orders of tokens.

A text is the set of its distinct shingles of five words (A-Z in lower case). Equal sets are one node. Under any order of all
shingles, two sets that link share a token among the first ones of each, so a pair has to pass for every order:

1. By ascending hash. Of the first n - o + m tokens of a set (o: the overlap that a partner needs at least, m: a tenth of
   the set) a good part has to be held by another node's first tokens; nodes without it have no partner and go. Only these heads,
   about a third of all tokens, are shuffled as rows, and a passage that many texts share is not enough to stay.
2. By rising frequency, ties by hash, among the nodes that are left. Tokens of one node only come first and are never rows
   of a bucket; the rest meet in buckets by token, if size and place leave enough tokens behind them in both sets.
3. By ascending and by descending hash, pair by pair, before the sets are compared in full.

Buckets of a family of copies hold most of the family, so not all their pairs are made: members meet a leader, the node that
shares most; those whose component differs from the leader's meet a leader from among them, twice; then pairs of a bucket
that are still in different components, and pass the filters of size and place, are verified. A pair that links is so
either verified or already in one component: no link between components is lost, at any size of bucket. Components come
from alternating stars.

Defined results: one to four words are one shingle; a null text, or one without words, has no shingles, is linked with
nothing and is its own component; a component's id is its smallest doc_id, null if all its ids are null; equal rows and rows
with a null id are members like others; a text of any length is compared whole; an empty table gives no rows; further
columns, whatever their names, are ignored. Shingles are 64-bit hashes, and equal sets are told by MD5 digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import RowLists, batch, binaries, columns, discard, join_hot, materialize, noting, numbered_copy, only, passing, ragged, release, settled, steps, strings, utf8
from .dartminhash import components, joined_components, shingles

#: Percent of the union that the intersection needs.
THRESHOLD = 80
#: A set's first tokens by hash are more by one in so many of its tokens than one shared token needs; as many have to be shared.
SLACK = 10
#: Rounds of leaders, after the first, before pairs are joined.
ROUNDS = 2
#: Pairs of one leader that meet its set in one task.
LEADER_PAIRS = 200
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def least_overlap(n, threshold: int):
    """What a set of n has in common with any partner at least."""
    return (threshold * n + 99) // 100


_SIGNED = "doc_id long, key binary, size long, elements binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    only("words")
    for b in steps(batches, 1):
        doc, h, _, _ = shingles([utf8(t).translate(_LOWER) for t in strings(b.column(1))])
        sizes = np.bincount(doc, minlength=b.num_rows)
        elements = binaries(h, 8 * sizes)
        keys = [hashlib.md5(e.as_buffer()).digest() if n else b"" for e, n in zip(elements, sizes.tolist())]
        yield batch(_SIGNED, [b.column(0), keys, sizes, elements])
    only()


_TOKENS = "token long, node long"


def _token_rows(threshold: int, heads: bool, listed: Callable | None) -> Callable:
    """A row per token of each set, or of those first by ascending hash; listed: only of rows in those lists. Takes (nth or node, elements)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = listed() if listed else None
        for b in steps(batches, 1, 8_000_000):
            node, tokens, sizes = b.column(0).to_numpy(), np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64), np.array([len(e) // 8 for e in b.column(1).to_pylist()], np.int64)
            counts = np.minimum(sizes, sizes - least_overlap(sizes, threshold) + np.maximum(1, sizes // SLACK)) if heads else sizes
            if find:
                counts = np.where(find(node) > 0, counts, 0)
            yield batch(_TOKENS, [pa.array(tokens[ragged(np.cumsum(sizes) - sizes, counts)]), pa.array(np.repeat(node, counts))])
        release()

    return run


def _listed_rows(listed: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = listed()
        for b in batches:
            yield b.filter(pa.array(find(b.column(0).to_numpy()) > 0))

    return run


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two ascending arrays without repeats have in common."""
    if not len(a) or not len(b):
        return 0
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def linked(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    """Whether two sets link: first their heads in both orders by hash, then the whole."""
    p, q = (len(s) - least_overlap(len(s), threshold) + 1 for s in (a, b))
    if not common(a[:p], b[:q]) or not common(a[-p:], b[-q:]):
        return False
    both = common(a, b)
    return 100 * both >= threshold * (len(a) + len(b) - both)


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Those of pairs (a, b) that link. sets: node, elements. An `a` with many pairs is dealt over several tasks."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "elements_b", 8_000_000):
            one, other = ([np.frombuffer(e.as_buffer(), np.uint64) for e in b.column(k)] for k in ("elements_a", "elements_b"))
            yield b.select(["a", "b"]).filter(pa.array([linked(x, y, threshold) for x, y in zip(one, other)], pa.bool_()))
        release()

    pairs = materialize(pairs, "pairs")
    degree = pairs.groupBy("a").agg(F.count("*").alias("degree"))
    parts = F.ceil(F.col("degree") / LEADER_PAIRS).cast("int")
    left = join_hot(pairs, degree, ["a"], "degree", pairs.count()).select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"))
    leaders = degree.select("a", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")).join(sets.select(F.col("node").alias("a"), F.col("elements").alias("elements_a")), "a")
    with_b = left.join(sets.select(F.col("node").alias("b"), F.col("elements").alias("elements_b")), "b")
    return materialize(with_b.join(leaders, ["a", "part"]).select("a", "b", "elements_a", "elements_b").mapInArrow(check, "a long, b long"), "links")


def _may_link(x: str, y: str, threshold: int) -> Column:
    """Whether sizes, and what stands from a shared token on, leave the overlap that two sets need, if it is the first they share."""
    rest = F.least(F.col(f"{x}.rest"), F.col(f"{y}.rest"))
    return (100 + threshold) * rest >= threshold * (F.col(f"{x}.size") + F.col(f"{y}.size"))


def _survivors(signed: DataFrame, nodes: DataFrame, threshold: int) -> DataFrame:
    """node, size, elements of the nodes that enough of their heads' tokens leave."""
    reps = RowLists(nodes.select(F.col("node").alias("nth")), "reps")
    heads = signed.select("nth", "elements").mapInArrow(_token_rows(threshold, True, reps.finder), _TOKENS)
    # one shuffle of the heads; a token that very many have is a group of narrow rows, which Spark spills
    shared = heads.withColumn("held", F.count("*").over(Window.partitionBy("token"))).filter("held > 1")
    hits = shared.groupBy("node").agg(F.count("*").alias("hits"))
    need = F.greatest(F.lit(1), F.expr(f"(({threshold} * size + 99) div 100) div {SLACK}"))
    left = RowLists(hits.join(nodes.select("node", "size"), "node").filter(F.col("hits") >= need).select(F.col("node").alias("nth")), "left")
    rows = signed.select("nth", "size", "elements").mapInArrow(_listed_rows(left.finder), "nth long, size long, elements binary")
    return materialize(rows.select(F.col("nth").alias("node"), "size", "elements"), "sets")


def _members(sets: DataFrame, threshold: int) -> DataFrame:
    """token, node, m (size, rest): the tokens that stand first by frequency in each set, if another set holds them. rest: tokens from there on."""
    tokens = sets.select("node", "elements").mapInArrow(_token_rows(threshold, False, None), _TOKENS)
    held = tokens.groupBy("token").agg(F.count("*").alias("held")).filter("held > 1")
    # tokens of one set alone come first, so places are counted from the end
    from_end = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("held"), F.desc("token")))
    placed = tokens.join(held, "token").withColumn("rest", from_end.cast("long")).select("token", "node", "rest")
    first = placed.join(sets.select("node", "size"), "node").filter(F.col("rest") >= F.expr(f"({threshold} * size + 99) div 100"))
    return materialize(first.select("token", "node", F.struct("size", "rest").alias("m")), "members")


def _roots(sets: DataFrame, threshold: int) -> DataFrame:
    """node and root of the nodes that have links."""
    members = _members(sets, threshold)
    total = members.count()
    buckets = materialize(members.groupBy("token").agg(F.count("*").alias("of")).filter("of > 1"), "buckets")
    shared = materialize(join_hot(members, buckets, ["token"], "of", total), "shared")
    middle = shared.groupBy("node").agg(F.sum("of").alias("middle"))
    shared = materialize(shared.join(middle, "node"), "shared")

    def led(d: DataFrame) -> DataFrame:
        """Members of buckets with the one that shares most as their leader, and what the bucket's token means in it."""
        first = d.groupBy("token").agg(F.count("*").alias("of"), F.min(F.struct(-F.col("middle"), "node", "m")).alias("first"))
        return join_hot(d.drop("of"), first.select("token", "of", F.col("first.node").alias("leader"), F.col("first.m").alias("l")), ["token"], "of", total)

    def links(d: DataFrame) -> DataFrame:
        met = d.filter((F.col("node") != F.col("leader")) & _may_link("m", "l", threshold))
        return verified(met.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), sets, threshold)

    lead = materialize(led(shared), "lead")
    roots = materialize(components(links(lead)), "roots")

    def rooted(d: DataFrame, *names: str) -> DataFrame:
        for name in names:
            d = d.join(roots.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root")), name, "left").withColumn(f"{name}_root", F.coalesce(f"{name}_root", name))
        return d

    def apart() -> DataFrame:
        """Members whose component isn't that of their bucket's leader."""
        return rooted(lead, "node", "leader").filter("node_root <> leader_root")

    for _ in range(ROUNDS):
        rest = materialize(apart().select("token", "node", "m", "middle"), "rest")
        if not rest.limit(1).count():
            return roots
        roots = joined_components(roots, links(led(rest)))
    x = apart().select("token", F.col("node").alias("a"), F.col("m").alias("x"), F.col("node_root").alias("x_root"))
    y = rooted(lead, "node", "leader").select("token", F.col("node").alias("b"), F.col("m").alias("y"), F.col("node_root").alias("y_root"), (F.col("node_root") != F.col("leader_root")).alias("apart"))
    met = x.join(y, "token").filter((F.col("x_root") != F.col("y_root")) & (~F.col("apart") | (F.col("a") < F.col("b"))) & _may_link("x", "y", threshold))
    return joined_components(roots, verified(met.select("a", "b").distinct(), sets, threshold))


def jaccard_components(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, n_shingles, component_id. threshold: percent of the union."""

    def joined() -> DataFrame:
        with noting(whole := []):
            signed = numbered_copy(columns(docs, doc_id=(id_col, "long"), text=(text_col, None)).mapInArrow(_sign, _SIGNED), "signed")
        passing(whole[0])
        rows = materialize(signed.drop("elements"), "rows")
        texts = rows.filter("size > 0")
        nodes = texts.groupBy("key").agg(F.min("nth").alias("node"), F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.min("size").alias("size"))
        nodes = materialize(nodes, "nodes")
        sets = _survivors(signed, nodes, threshold)
        discard(docs.sparkSession, whole[0])  # all sets, the largest table; what comes later asks for those that are left
        roots = _roots(sets, threshold)
        classed = materialize(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).select("key", "first_id", "copies", "root"), "classed")
        ids = classed.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("nodes"))
        named = materialize(join_hot(classed, ids, ["root"], "nodes", classed.count()).select("key", "copies", "component_id"), "named")
        found = join_hot(texts.select("doc_id", "key", "size"), named, ["key"], "copies", rows.count())
        alone = rows.filter("size = 0").select("doc_id", "size", F.col("doc_id").alias("component_id"))
        return found.select("doc_id", "size", "component_id").unionByName(alone).select("doc_id", F.col("size").alias("n_shingles"), "component_id")

    return settled(joined, docs.sparkSession, "components")

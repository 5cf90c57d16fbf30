"""Near-duplicates by DartMinHash signatures, banded joining and exact verification.

A text is a weighted set: its shingles of five words, weighted by how often they occur. Hashed darts are thrown at the
plane of weight and rank above each shingle, cut into regions of weight [0, 1), [1, 2), [2, 4), ...: a region's darts are a
Poisson process whose ranks, weights and coordinates come from hashes of shingle and region alone, so every text that
holds the region sees the same darts. Only darts under the text's weight and under a rank that leaves about
t (ln t + 2) darts in all are thrown; a text that then misses a coordinate throws at twice the rank. The earliest dart
of each of the t coordinates is the signature; two agree in a coordinate with their weighted Jaccard similarity.

Equal texts are one node. Nodes that agree in all coordinates of a band share a bucket, and a bucket's members are compared,
exactly, with its leader: the member that shares most buckets with others, which stands in the middle of its family. Links of
at least THRESHOLD give components. Members that stay apart from their leader's component are compared with a second leader
from among them; in buckets of up to SMALL members, with every member of another component that the triangle inequality
leaves possible. Larger buckets that still hold several components are searched whole, in tiles of bounded size, for links
between components. So no link within a bucket is lost: only a pair that shares no bucket is missed, of similarity s with
probability (1 - s ** ROWS) ** BANDS, 5e-5 at 0.8.

Defined results: texts of one to four words have one shingle, all their words; texts without words, and null texts,
stay alone; a class's id is its smallest doc_id, and one row of it is kept: of several texts with that id, the one whose words
have the smallest digest; of a class without ids, whose id is null, likewise one row; null doc_ids are kept as members; a
text of any length is compared whole; an empty table gives no rows; further columns, whatever their names, are ignored or
kept as they are. Verification compares 64-bit hashes of shingles with their weights, and equal texts are told by the MD5
digest of their words; neither is byte for byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, arrow_schema, batch, binaries, columns, in_rows, join_hot, materialize, memo, mix64, only, out_of_rows, ragged, release, repeated, settled, split_words, steps, strings, utf8

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5
#: Members of a bucket whose pairs are joined; larger ones are searched in tiles.
SMALL = 8
#: Members, and bytes of their shingles, in one side of a tile (a single larger set is a side of its own, more or less).
TILE, TILE_BYTES = 1000, 4_000_000
#: Pairs of one leader that meet its shingles in one task.
LEADER_PAIRS = 200
_MEMO_WORDS = 300_000
_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()
memo("words", _WORDS.clear)


def shingles(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Distinct shingles of all texts: number of the text, hash (ascending in each text), occurrences; and a digest of each text's words (empty without words)."""
    if len(_WORDS) > _MEMO_WORDS:
        _WORDS.clear()
    words: list[int] = []
    counts, digests = np.zeros(len(texts), np.int64), []
    for i, t in enumerate(texts):
        own = split_words(t)
        words.extend(map(_WORDS.__getitem__, own))
        counts[i] = len(own)
        digests.append(hashlib.md5(b" ".join(own)).digest() if own else b"")
    w = np.array(words, np.uint64)
    first = np.cumsum(counts) - counts
    windows = np.where(counts >= size, counts - size + 1, 0)
    at = ragged(first, windows)
    h = np.zeros(len(at), np.uint64)
    for k in range(size):
        h += w[at + k] * _STEP[k]
    doc = np.repeat(np.arange(len(texts)), windows)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        few = np.array([sum(int(w[first[i] + k]) * int(_STEP[k]) for k in range(counts[i])) + int(counts[i]) & 0xFFFFFFFFFFFFFFFF for i in short], np.uint64)
        h, doc = np.concatenate((h, few)), np.concatenate((doc, short))
    h = mix64(h)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(new)
    return doc[starts], h[starts], np.diff(starts, append=len(h)), digests


def dart_signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, t: int = BANDS * ROWS) -> np.ndarray:
    """Signatures of weighted sets, docs x t; rows of docs without elements are 0. weight: any positive numbers."""
    weight = np.asarray(weight, float)
    levels = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1, 1)
    at = np.repeat(np.arange(len(element)), levels)
    level = ragged(np.zeros(len(levels), np.int64), levels)
    width = np.where(level > 0, 2.0 ** np.maximum(level - 1, 0), 1.0)
    low = np.where(level > 0, width, 0.0)
    seed = mix64(element[at] ^ (level.astype(np.uint64) * _STEP[1]))
    owner, bound = doc[at], weight[at]
    total = np.bincount(doc, weight, docs)
    out = np.zeros((docs, t), np.uint64)
    rank = (np.log(t) + 2) / np.maximum(total, 1e-300)
    open_ = total > 0
    while open_.any():
        active = np.flatnonzero(open_[owner])
        r = np.zeros(len(active))
        best = np.full(docs * t, np.inf)
        thrown = []
        i = 0
        while len(active):
            i += 1
            g = mix64(seed[active] + np.uint64(i * int(_STEP[2]) & 0xFFFFFFFFFFFFFFFF))
            r = r - np.log(((g >> np.uint64(11)).astype(float) + 1) * 2.0**-53) / (t * width[active])
            near = r < rank[owner[active]]
            active, r, g = active[near], r[near], g[near]
            g2 = mix64(g)
            hit = low[active] + width[active] * ((g2 & np.uint64(0xFFFFFFFF)).astype(float) * 2.0**-32) < bound[active]
            place = owner[active][hit] * t + ((g2[hit] >> np.uint64(32)) % np.uint64(t)).astype(np.int64)
            thrown.append((place, r[hit], g[hit]))
        place, ranks, darts = (np.concatenate(x) for x in zip(*thrown))
        np.minimum.at(best, place, ranks)
        first = ranks == best[place]
        flat = out.reshape(-1)
        flat[place[first]] = darts[first]
        missing = np.isinf(best.reshape(docs, t)).any(axis=1) & open_
        rank = np.where(missing, rank * 2, rank)
        open_ = missing
    return out


_SIGNED = "doc_id long, key binary, bands array<long>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    only("words")
    salt = np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP[3]
    for b in steps(batches, 1):
        doc, h, n, keys = shingles([utf8(t) for t in strings(b.column(1))])
        signature = dart_signatures(doc, h, n, b.num_rows).reshape(b.num_rows, BANDS, ROWS)
        band = salt[None, :] + np.zeros((b.num_rows, 1), np.uint64)
        for k in range(ROWS):
            band = mix64(band ^ signature[:, :, k])
        yield batch(_SIGNED, [b.column(0), keys, [v if k else [] for v, k in zip(band.view(np.int64).tolist(), keys)]])
    only()  # words are hashed again sooner than remembered in every idle worker


_SETS = "key binary, elements binary, weights binary"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    only("words")
    for b in steps(batches, 0):
        doc, h, n, keys = shingles([utf8(t) for t in strings(b.column(0))])
        sizes = np.bincount(doc, minlength=b.num_rows)
        yield batch(_SETS, [keys, binaries(h, 8 * sizes), binaries(n.astype("<u4"), 4 * sizes)])
    only()


_COMPARED = "a long, b long, similarity double"


def weighted_jaccard(elements_a: np.ndarray, weights_a: np.ndarray, elements_b: np.ndarray, weights_b: np.ndarray) -> float:
    _, i, j = np.intersect1d(elements_a, elements_b, assume_unique=True, return_indices=True)
    both = int(np.minimum(weights_a[i], weights_b[j]).sum(dtype=np.int64))
    return both / (int(weights_a.sum(dtype=np.int64)) + int(weights_b.sum(dtype=np.int64)) - both)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        columns = [b.column(k).to_pylist() for k in ("elements_a", "weights_a", "elements_b", "weights_b")]
        found = [weighted_jaccard(*(np.frombuffer(v, "<u8" if k % 2 == 0 else "<u4") for k, v in enumerate(row))) for row in zip(*columns)]
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(found, pa.float64())], schema=arrow_schema(_COMPARED))
    release()


def compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Similarity of pairs (a, b), where sets has node, elements and weights. An `a` with many pairs is dealt over several tasks."""
    pairs = materialize(pairs, "pairs")
    degree = pairs.groupBy("a").agg(F.count("*").alias("degree"))
    total = pairs.count()
    parts = F.ceil(F.col("degree") / LEADER_PAIRS).cast("int")
    left = join_hot(pairs, degree, ["a"], "degree", total).select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"))
    with_b = left.join(sets.select(F.col("node").alias("b"), F.col("elements").alias("elements_b"), F.col("weights").alias("weights_b")), ["b"])
    leaders = degree.select("a", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")).join(sets.select(F.col("node").alias("a"), F.col("elements").alias("elements_a"), F.col("weights").alias("weights_a")), ["a"])
    return materialize(with_b.join(leaders, ["a", "part"]).mapInArrow(_compare, _COMPARED), "compared")


def linking_pairs(root: np.ndarray, block: np.ndarray, elements: list[np.ndarray], weights: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Places of pairs of at least threshold that connect all roots which such pairs connect. Of two blocks, only pairs across count.

    A pair of similarity t shares more than 1 - t of each one's weight, so it shares one of the shingles that a member can't
    do without: its rarest ones, of a little over 1 - t of its weight. Only members with one of those are compared.
    """
    root, across = root.copy(), len(np.unique(block)) > 1
    counts = np.array([len(e) for e in elements])
    first, owner = np.cumsum(counts) - counts, np.repeat(np.arange(len(counts)), counts)
    _, token = np.unique(np.concatenate(elements), return_inverse=True)
    weight = np.concatenate(weights).astype(np.int64)
    total = np.bincount(owner, weight, len(counts))
    holders = np.bincount(token)
    begin, posted = np.cumsum(holders) - holders, owner[np.argsort(token, kind="stable")]
    rarest = np.lexsort((token, holders[token], owner))
    own = np.zeros(len(holders), np.int64)
    out = []
    for a in range(len(counts)):
        mine = rarest[first[a] : first[a] + counts[a]]
        head = token[mine[: np.searchsorted(np.cumsum(weight[mine]), (1 - threshold) * total[a] + 1e-6, "right") + 1]]
        near = np.unique(posted[ragged(begin[head], holders[head])])
        near = near[(near > a) & (root[near] != root[a]) & ((block[near] != block[a]) | (not across))]
        near = near[np.minimum(total[near], total[a]) >= threshold * np.maximum(total[near], total[a]) - 1e-6]
        if not len(near):
            continue
        own[token[mine]] = weight[mine]
        at = ragged(first[near], counts[near])
        both = np.bincount(np.repeat(np.arange(len(near)), counts[near]), np.minimum(own[token[at]], weight[at]), len(near))
        own[token[mine]] = 0
        for b in near[both / (total[a] + total[near] - both) >= threshold].tolist():
            if root[b] != root[a]:
                out.append((a, b))
                root[root == root[b]] = root[a]
    return out


def search(members: DataFrame, sets: DataFrame, threshold: float, total: int) -> DataFrame:
    """Links (a, b) of at least threshold between the components of each bucket: members has bucket, node and root, total rows at most."""

    def run(table: pa.Table) -> pa.Table:
        node, root, block = (table.column(k).to_numpy() for k in ("node", "root", "block"))
        elements, weights = ([np.frombuffer(v, kind) for v in table.column(k).to_pylist()] for k, kind in (("elements", "<u8"), ("weights", "<u4")))
        found = np.array(linking_pairs(root, block, elements, weights, threshold), np.int64).reshape(-1, 2)
        return pa.table({"a": node[found[:, 0]], "b": node[found[:, 1]]})

    members = members.join(sets.select("node", F.length("elements").alias("bytes")), "node")
    buckets = members.groupBy("bucket").agg(F.count("*").alias("of"), F.sum("bytes").alias("bytes"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high")
    blocks = F.greatest(F.ceil(F.col("of") / TILE), F.ceil(F.col("bytes") / TILE_BYTES)).cast("int").alias("blocks")
    dealt = join_hot(members.drop("bytes"), buckets.select("bucket", "of", blocks), ["bucket"], "of", total)
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node", "bucket"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root")
    # tiles of one component have nothing to link
    tiles = materialize(dealt, "dealt")
    mixed = tiles.groupBy("bucket", "i", "j").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("bucket", "i", "j")
    return materialize(tiles.join(mixed, ["bucket", "i", "j"]).join(sets, ["node"]).groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long").distinct(), "linking")


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """node and the smallest node of its component, for all nodes of links (a, b): alternating large and small stars.

    Raises an error if the edges aren't stable after that many rounds.
    """

    def star(edges: DataFrame, large: bool, total: int) -> DataFrame:
        # each node's smallest neighbour; large: its larger neighbours go there, small: the node and its smaller neighbours do.
        # A node with very many neighbours goes to its edges by broadcast, so that they don't meet in one task.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
        mins = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("degree"))
        joined = join_hot(both, mins, ["u"], "degree", total)
        moved = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(mins.select("u", F.col("m").alias("v")))
        return moved.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))

    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    for turn in range(rounds + 1):
        # stable: every node has one edge at most, and it leads to a node that has none
        ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if not ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR (up = 1 AND down = 1)").limit(1).count():
            break
        if turn == rounds:
            continue
        total = edges.count()
        grown = materialize(star(edges, True, 2 * total), "grown")
        edges = materialize(star(grown, False, total).distinct(), "edges")
    else:
        raise RuntimeError(f"components are not stable after {rounds} rounds")
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.col("m").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct().join(edges.select(F.col("u").alias("node")), ["node"], "left_anti"))


def joined_components(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, root) with further links (a, b), which are looked at between components only."""
    of = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")).filter("a <> b").distinct()
    between = materialize(between, "between")
    if not between.limit(1).count():
        return roots
    top = materialize(components(between), "top")
    moved = roots.join(top.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return materialize(moved.unionByName(top.join(roots.select("node"), "node", "left_anti")), "roots")


def _words_key(text: Column) -> Column:
    """The digest of a text's words that shingles() gives."""
    return F.unhex(F.md5(F.encode(F.trim(F.regexp_replace(text, BLANK, " ")), "UTF-8")))


def _classes(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Of documents (doc_id, text): those with words, a row per doc_id and key with class_id, class_size, rows and own (whether one of them is kept); and the rest's doc_ids."""
    signed = materialize(docs.mapInArrow(_sign, _SIGNED), "signed")
    rows = signed.count()
    alone = signed.filter(F.size("bands") == 0)
    texts = signed.filter(F.size("bands") > 0)
    nodes = texts.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    n = nodes.count()
    placed = nodes.select("node", F.explode("bands").alias("bucket"))
    buckets = materialize(placed.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "buckets")
    shared = materialize(join_hot(placed, buckets, ["bucket"], "size", n * BANDS), "shared")
    # the node that shares most stands in the middle of its family: it leads each of its buckets
    middle = shared.groupBy("node").agg(F.sum("size").alias("middle"))
    shared = materialize(shared.join(middle, "node"), "shared")

    def led(d: DataFrame, order: list) -> DataFrame:
        """Members of buckets with the first of them by an order as their leader."""
        first = d.groupBy("bucket").agg(F.count("*").alias("of"), F.min(F.struct(*order, "node")).alias("first")).select("bucket", "of", F.col("first.node").alias("leader"))
        return join_hot(d, first, ["bucket"], "of", n * BANDS).drop("of")

    members = materialize(led(shared, [-F.col("middle"), F.xxhash64("node", "bucket")]), "members")

    # sets of the nodes in buckets: their texts are fetched by the id of one of their documents, then told apart by key
    wanted = members.select("node").distinct().join(nodes.select("node", "key", "first_id"), ["node"])
    wanted = materialize(wanted, "wanted")
    # by the key of their words where they have no id, so that rows without one don't meet in one task
    fetch = lambda i, key: F.coalesce(F.col(i).cast("string"), F.concat(F.lit("="), F.hex(key))).alias("fetch")
    texts_of = docs.withColumn("fetch", fetch("doc_id", _words_key(F.col("text")))).join(wanted.select(fetch("first_id", F.col("key"))).distinct(), "fetch", "left_semi")
    sets = texts_of.select("text").mapInArrow(_sets, _SETS)
    sets = materialize(sets.join(wanted.select("key", "node"), ["key"]).dropDuplicates(["key"]).select("node", "elements", "weights"), "sets")

    pairs = lambda d: d.filter("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    first = compare(pairs(members), sets)
    links = first.filter(F.col("similarity") >= threshold)
    of = lambda r, name: r.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))

    def apart(d: DataFrame, roots: DataFrame) -> DataFrame:
        """Members whose component isn't their leader's, with both. Nodes without links are components of their own."""
        d = d.join(of(roots, "node"), ["node"], "left").join(of(roots, "leader"), ["leader"], "left")
        d = d.withColumn("node_root", F.coalesce("node_root", "node")).withColumn("leader_root", F.coalesce("leader_root", "leader"))
        return d

    roots = materialize(components(links), "roots")
    rest = materialize(apart(members, roots).filter("node_root != leader_root").select("bucket", "node", "size", "middle"), "rest")
    # those that stay apart meet a leader from among them
    among = pairs(led(rest, [-F.col("middle"), F.xxhash64("node", "bucket")]))
    # in small buckets it meets everyone that the distances to the first leader leave possible
    near = first.select(F.col("a").alias("leader"), F.col("b").alias("node"), (1 - F.col("similarity")).alias("away"))
    marked = apart(members.filter(F.col("size") <= SMALL), roots).join(near, ["leader", "node"], "left").withColumn("away", F.coalesce("away", F.lit(0.0)))
    marked = materialize(marked.select("bucket", "node", "node_root", "leader_root", "away"), "marked")
    x = marked.filter("node_root != leader_root").select("bucket", F.col("node").alias("a"), F.col("node_root").alias("a_root"), F.col("away").alias("a_away"))
    y = marked.filter("away > 0").select("bucket", F.col("node").alias("b"), F.col("node_root").alias("b_root"), F.col("away").alias("b_away"), (F.col("node_root") != F.col("leader_root")).alias("b_apart"))
    left = x.join(y, ["bucket"]).filter((F.col("a_root") != F.col("b_root")) & (F.abs(F.col("a_away") - F.col("b_away")) <= 1 - threshold + 1e-9) & (~F.col("b_apart") | (F.col("a") < F.col("b"))))
    again = compare(among.union(left.select("a", "b")).distinct(), sets)
    roots = joined_components(roots, again.filter(F.col("similarity") >= threshold).select("a", "b"))
    # larger buckets are searched for what still links their components
    large = shared.filter(F.col("size") > SMALL).join(roots, ["node"], "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    roots = joined_components(roots, search(large, sets, threshold, n * BANDS))

    classed = nodes.select("node", "key", "first_id", "copies").join(roots, ["node"], "left").withColumn("root", F.coalesce("root", "node"))
    classed = materialize(classed, "classed")
    # the kept document is chosen in each component, as several may have one id: its smallest doc_id, then the smallest key
    classes = classed.groupBy("root").agg(F.min("first_id").alias("class_id"), F.sum("copies").alias("class_size"), F.count("*").alias("nodes"), F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", F.hex("key").alias("own"))).alias("kept"))
    named = join_hot(classed, classes, ["root"], "nodes", n)
    named = materialize(named.select("key", "class_id", "class_size", "copies", (F.hex("key") == F.col("kept.own")).alias("own")), "named")
    # rows that repeat id and text are counted, so that one of them is kept
    each = texts.groupBy("doc_id", "key").agg(F.count("*").alias("rows"))
    found = join_hot(each, named, ["key"], "copies", rows)
    return found.withColumn("own", F.col("own") & F.col("doc_id").eqNullSafe(F.col("class_id"))), alone.select("doc_id")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, class_id (smallest doc_id of its class), class_size (rows), kept; written, with its intermediate tables deleted."""

    def classed() -> DataFrame:
        found, alone = _classes(columns(docs, doc_id=(id_col, "long"), text=(text_col, None)), threshold)
        kept = (F.col("own") & (F.col("nth") == 0)).alias("kept")
        return repeated(found, "rows", "nth").select("doc_id", "class_id", "class_size", kept).unionByName(alone.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept")))

    return settled(classed, docs.sparkSession, "classes")


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class, all columns as they were. Of rows that repeat id and words, any one stays."""

    def dropped() -> DataFrame:
        found, _ = _classes(columns(docs, doc_id=(id_col, "long"), text=(text_col, None)), threshold)
        return found.filter("NOT own OR rows > 1").select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone"), "own")

    marks = settled(dropped, docs.sparkSession, "dropped")
    rows = in_rows(docs, doc_id=(id_col, "long"), text=(text_col, None)).withColumn("key", _words_key(F.col("text"))).drop("text")
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("key") == F.col("gone"))
    left = rows.join(marks, same, "left_anti")
    twice = marks.filter("own")
    if twice.count():
        left = left.unionByName(rows.join(twice, same, "left_semi").dropDuplicates(["doc_id", "key"]))
    return out_of_rows(left, docs.columns)

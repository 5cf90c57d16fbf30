"""A positional index of sentences that is kept, and phrase queries that read the buckets of their tokens alone.

Occurrences of a token are postings (resource, document, sentence, place). Documents are dealt into chunks by hash, so that
a chunk has about CHUNK_DOCUMENTS of them; a block holds a token's postings in one chunk of one resource, up to
BLOCK_POSTINGS, sorted, with documents, sentences and places coded as differences in bytes of seven bits. Blocks lie in
folders by bucket, a hash of the token, and are sorted by token in their files.

A query reads two columns of its tokens' buckets first, token and chunk: only chunks that have all tokens of the phrase can
hold it, and only their blocks are decoded. Tokens meet by chunk, a bounded group, however frequent they are; no sentence is
read. Documents without an id are one chunk of their own by the hash of nothing, like any other id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

CHUNK_DOCUMENTS, BLOCK_POSTINGS, BUCKETS = 4096, 4096, 64
#: Chunks whose postings of a bucket are sorted by one task.
GROUP_CHUNKS = 4


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers from 0 on as bytes, seven bits in each, the lowest first; the last byte of a number has its highest bit set. And where each number ends."""
    v = np.asarray(values, np.uint64)
    sizes = np.ones(len(v), np.int64)
    for k in range(1, 10):
        sizes += v >> np.uint64(7 * k) > 0
    ends = np.cumsum(sizes)
    place = np.arange(int(ends[-1]) if len(v) else 0) - np.repeat(ends - sizes, sizes)
    out = (np.repeat(v, sizes) >> (7 * place).astype(np.uint64) & np.uint64(0x7F)).astype(np.uint8)
    out[ends - 1] |= 0x80
    return out, ends


def decode(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b & 0x80) + 1
    begins = np.concatenate(([0], ends)).astype(np.int64)[:-1]
    place = np.arange(len(b)) - np.repeat(begins, ends - begins)
    parts = (b & 0x7F).astype(np.uint64) << (7 * place).astype(np.uint64)
    return np.add.reduceat(parts, begins) if len(b) else np.empty(0, np.uint64)


def _zigzag(v: np.ndarray) -> np.ndarray:
    return ((v << 1) ^ (v >> 63)).view(np.uint64)


def _unzigzag(v: np.ndarray) -> np.ndarray:
    return ((v >> np.uint64(1)) ^ (np.uint64(0) - (v & np.uint64(1)))).view(np.int64)


def pack(doc: np.ndarray, sentence: np.ndarray, at: np.ndarray, begins: np.ndarray) -> list[bytes]:
    """Blocks of postings, which begin at `begins` and are sorted by document, sentence and place: in each, three columns of differences, one after the other. A document's first sentence and a sentence's first place are counted from 0."""
    n = len(doc)
    first = np.zeros(n, bool)
    first[begins] = True
    before = lambda x: np.concatenate(([0], x[:-1]))
    same_doc = ~first & (doc == before(doc))
    same_sentence = same_doc & (sentence == before(sentence))
    sizes = np.diff(begins, append=n)
    begin, size = np.repeat(begins, sizes), np.repeat(sizes, sizes)
    own = 2 * begin + np.arange(n)  # where a block's first column lies among those of all blocks
    values = np.empty(3 * n, np.uint64)
    values[own] = _zigzag(np.where(first, doc, doc - before(doc)))
    values[own + size] = np.where(same_doc, sentence - before(sentence), sentence).astype(np.uint64)
    values[own + 2 * size] = np.where(same_sentence, at - before(at), at).astype(np.uint64)
    data, ends = encode(values)
    held, ends = data.tobytes(), np.concatenate(([0], ends))[3 * np.append(begins, n)].tolist()
    return [held[a:z] for a, z in zip(ends[:-1], ends[1:])]


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = decode(data)
    n = len(found) // 3
    doc = np.cumsum(_unzigzag(found[:n]))

    def summed(steps: np.ndarray, same: np.ndarray) -> np.ndarray:
        """Running sums that begin anew where `same` is false."""
        total = np.cumsum(steps)
        first = np.flatnonzero(~same)
        return total - np.repeat((total - steps)[first], np.diff(first, append=len(steps)))

    same_doc = np.concatenate(([False], doc[1:] == doc[:-1]))[:n]
    sentence = summed(found[n : 2 * n].astype(np.int64), same_doc)
    at = summed(found[2 * n :].astype(np.int64), same_doc & np.concatenate(([False], sentence[1:] == sentence[:-1]))[:n])
    return doc, sentence, at


_COUNTS = ("postings", "sentences", "first_doc", "first_position", "last_doc", "last_position")
_BLOCKS = "bucket int, token string, chunk long, resource_id string, no_doc boolean, " + "".join(f"{c} long, " for c in _COUNTS) + "data binary"
_ARROW = pa.schema([("bucket", pa.int32()), ("token", pa.string()), ("chunk", pa.int64()), ("resource_id", pa.string()), ("no_doc", pa.bool_()), *((c, pa.int64()) for c in _COUNTS), ("data", pa.binary())])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of sorted postings; a batch's first and last blocks may be smaller."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        names = ("bucket", "token", "chunk", "resource_id", "no_doc")
        codes = np.stack([b.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy() for k in names])
        new = np.concatenate(([True], (codes[:, 1:] != codes[:, :-1]).any(axis=0)))
        group = np.flatnonzero(new)
        cuts = np.concatenate([np.arange(a, z, BLOCK_POSTINGS) for a, z in zip(group, np.append(group[1:], n))])
        doc, sentence, at = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("doc_id", "position", "at"))
        ends = np.append(cuts[1:], n)
        data = pack(doc, sentence, at, cuts)
        head = [b.column(k).take(pa.array(cuts)) for k in names]
        other = np.concatenate(([True], (doc[1:] != doc[:-1]) | (sentence[1:] != sentence[:-1])))
        other[cuts] = True
        counts = [ends - cuts, np.add.reduceat(other.astype(np.int64), cuts), doc[cuts], sentence[cuts], doc[ends - 1], sentence[ends - 1]]
        yield pa.RecordBatch.from_arrays([*head, *map(pa.array, counts), pa.array(data, pa.binary())], schema=_ARROW)


def _bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def build_index(rows: DataFrame, path: str, buckets: int = BUCKETS, chunk_documents: int = CHUNK_DOCUMENTS, documents: int | None = None) -> None:
    """Writes the index of sentences (resource_id, doc_id, position, norm) to a path. documents: how many they are of, where that is known.

    Rows are made once: postings are dealt by the hash of their bucket and of a group of GROUP_CHUNKS chunks, with no sample
    of ranges before it. So a frequent token's postings are spread over the groups, each of a bounded number of documents,
    and a group of a bucket is one file.
    """
    docs = rows.agg(F.approx_count_distinct(F.xxhash64("resource_id", "doc_id"))).first()[0] if documents is None else documents
    chunks = max(1, math.ceil(docs / chunk_documents))
    places = rows.select("resource_id", F.col("doc_id").isNull().alias("no_doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("position").cast("long").alias("position"), F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).alias("chunk"), F.posexplode(T.tokens(F.col("norm"))).alias("at", "token"))
    order = ["bucket", "token", "chunk", "resource_id", "no_doc", "doc_id", "position", "at"]
    placed = places.withColumn("bucket", _bucket(F.col("token"), buckets)).select(*order)
    dealt = placed.repartition("bucket", F.expr(f"chunk div {GROUP_CHUNKS}")).sortWithinPartitions(*order)
    dealt.mapInArrow(_blocks, _BLOCKS).write.partitionBy("bucket").parquet(path)


def open_blocks(spark: SparkSession, path: str, tokens: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The blocks of some tokens: folders and row groups of others aren't read."""
    blocks = spark.read.schema(_BLOCKS).parquet(path)
    own = sorted({r[0] for r in spark.createDataFrame([(t,) for t in tokens], "token string").select(_bucket(F.col("token"), buckets)).collect()})
    return blocks.filter(F.col("bucket").isin(own) & F.col("token").isin(tokens))


def postings(spark: SparkSession, path: str) -> DataFrame:
    """By token: its postings and the sentences that have it, from what blocks say of themselves. A sentence that ends one block and begins the next is one."""
    blocks = spark.read.schema(_BLOCKS).parquet(path).drop("data")
    order = Window.partitionBy("token", "chunk", "resource_id", "no_doc").orderBy("first_doc", "first_position", "last_doc", "last_position")
    again = (F.lag("last_doc").over(order) == F.col("first_doc")) & (F.lag("last_position").over(order) == F.col("first_position"))
    own = F.col("sentences") - F.coalesce(again, F.lit(False)).cast("long")
    return blocks.withColumn("own", own).groupBy("token").agg(F.sum("postings").alias("postings"), F.sum("own").alias("sentences"))


_HITS = "resource_id string, doc_id long, position long, hits long"


def search_phrase(spark: SparkSession, path: str, phrase: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Sentences with a phrase and how often they have it: resource_id, doc_id, position, hits. An empty phrase has no hits."""
    if not phrase:
        return spark.createDataFrame([], _HITS)
    tokens = sorted(set(phrase))
    blocks = open_blocks(spark, path, tokens, buckets)
    key = ["chunk", "resource_id", "no_doc"]
    whole = blocks.groupBy(*key).agg(F.countDistinct("token").alias("n")).filter(F.col("n") == len(tokens)).drop("n")
    same = F.lit(True)
    for k in key:
        same = same & F.col(f"b.{k}").eqNullSafe(F.col(f"w.{k}"))
    some = blocks.alias("b").join(whole.alias("w"), same, "left_semi") if len(tokens) > 1 else blocks

    def run(table: pa.Table) -> pa.Table:
        """Places of each token, moved to where the phrase would begin, are intersected."""
        found: dict[str, list] = {}
        for token, data in zip(table.column("token").to_pylist(), table.column("data").to_pylist()):
            found.setdefault(token, []).append(unpack(data))
        starts = None
        for i, token in enumerate(phrase):
            if token not in found:
                starts = None
                break
            doc, sentence, at = (np.concatenate(x) for x in zip(*found[token]))
            own = np.empty(len(doc), [("doc", np.int64), ("sentence", np.int64), ("at", np.int64)])
            own["doc"], own["sentence"], own["at"] = doc, sentence, at - i
            starts = np.unique(own) if starts is None else np.intersect1d(starts, own)
        none = np.empty(0, np.int64)
        doc, sentence, hits = none, none, none
        if starts is not None and len(starts):
            at, hits = np.unique(starts[["doc", "sentence"]], return_counts=True)
            doc, sentence = at["doc"], at["sentence"]
        resource, absent = table.column("resource_id")[0].as_py(), bool(table.column("no_doc")[0].as_py())
        ids = pa.nulls(len(doc), pa.int64()) if absent else pa.array(doc)
        return pa.table([pa.array([resource] * len(doc), pa.string()), ids, pa.array(sentence), pa.array(hits.astype(np.int64))], names=["resource_id", "doc_id", "position", "hits"])

    return some.groupBy(*key).applyInArrow(run, _HITS)

"""Shortest-pack-first histogram packing of tokenised documents.

A document's ids, with an end id, are cut into pieces of SEQUENCE ids and a rest. The
histogram of piece lengths (at most SEQUENCE rows) is packed on the driver, longest lengths first: pieces of a length go
to the packs with the least in them, all packs of one pattern at once, and open new packs where none has room. Pieces get
their rank within their length; rank and pattern tables give sequence and offset.

Defined results: a null text is one end id; a null doc_id is kept; rows that repeat an id are documents of their own; an
empty table gives no rows; further columns are ignored. Ranks follow the order of the input's partitions, so a rerun on the
same files agrees.
"""

from __future__ import annotations

import heapq
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, batches_of, binaries, columns, materialize, new_path, only, passing, ragged, release, steps
from .tokens import BYTE_BPE, STEP_BYTES, encoder, with_end

SEQUENCE = 2048
END_ID = 1
#: Buckets that Spark allows a table by default.
MOST_BUCKETS = 100_000


def pack_histogram(histogram: dict[int, int], most: int = SEQUENCE) -> list[tuple[list[int], int]]:
    """Patterns (lengths in order) with the number of their packs; every length occurs as often as the histogram says."""
    packs: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))  # by what is in them
    fills: list[int] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        grown: list[tuple[int, tuple[int, ...], int]] = []
        while left:
            while fills and not packs.get(fills[0]):
                packs.pop(heapq.heappop(fills), None)
            if not fills or fills[0] + length > most:
                grown.extend(_new_packs(length, left, most // length))
                break
            fill = fills[0]
            pattern = next(iter(packs[fill]))
            n = min(left, packs[fill][pattern])
            packs[fill][pattern] -= n
            if not packs[fill][pattern]:
                del packs[fill][pattern]
            grown.append((fill + length, (*pattern, length), n))
            left -= n
            if fill + length + length <= most:  # what has just grown may take another of this length
                for f, p, n in grown:
                    if not packs[f]:
                        heapq.heappush(fills, f)
                    packs[f][p] += n
                grown = []
        for f, p, n in grown:
            if not packs[f]:
                heapq.heappush(fills, f)
            packs[f][p] += n
    return [(list(p), n) for f in sorted(packs) for p, n in sorted(packs[f].items()) if n]


def _new_packs(length: int, n: int, fit: int) -> list[tuple[int, tuple[int, ...], int]]:
    """New packs for n pieces of one length, as many to a pack as fit."""
    full, rest = divmod(n, fit)
    out = [(length * fit, (length,) * fit, full)] if full else []
    return out + ([(length * rest, (length,) * rest, 1)] if rest else [])


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, part long, local long"


def cuts(sizes: np.ndarray, most: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents of these sizes (1 at least) in pieces: the number of each piece's document, its start in it, its length."""
    pieces = -(-sizes // most)
    doc = np.repeat(np.arange(len(sizes)), pieces)
    start = ragged(np.zeros(len(sizes), np.int64), pieces) * most
    return doc, start, np.minimum(most, sizes[doc] - start)


def ranks(lengths: np.ndarray) -> np.ndarray:
    """Of each piece, how many before it have its length."""
    order = np.argsort(lengths, kind="stable")
    out = np.empty(len(lengths), np.int64)
    counts = np.bincount(lengths)
    out[order] = np.arange(len(lengths)) - np.repeat(np.cumsum(counts) - counts, counts)
    return out


def _tokenise(path: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("tokens")
        tokens, seen, part = encoder(path, True), np.zeros(SEQUENCE + 1, np.int64), TaskContext.get().partitionId()
        for b in steps(batches, 1, STEP_BYTES):
            flat, sizes = with_end(*tokens.encode(b.column(1)), END_ID)
            doc, start, length = cuts(sizes)
            data = memoryview(flat).cast("B")
            ends = np.cumsum(4 * length)
            crc = [zlib.crc32(data[a:z]) for a, z in zip((ends - 4 * length).tolist(), ends.tolist())]
            local = seen[length] + ranks(length)
            seen += np.bincount(length, minlength=SEQUENCE + 1)
            ids = binaries(flat, 4 * length) if keep_ids else pa.nulls(len(doc), pa.binary())
            yield batch(_PIECES, [b.column(0).take(pa.array(doc)), start, length, crc, sizes[doc], ids, np.full(len(doc), part), local])
        release()

    return run


def slots(patterns: list[tuple[list[int], int]]) -> np.ndarray:
    """Places of the patterns, sorted by length and rank: length, first rank, first sequence, offset, times in a pattern.

    Their number is bounded at any input: a length that is packed splits at most one pattern and opens at most two, so
    there are at most 3 * SEQUENCE patterns; and a pattern has at most 63 distinct lengths, as 1 + ... + 64 > SEQUENCE.
    """
    out, taken, first = [], defaultdict(int), 0
    for pattern, n in patterns:
        offset = 0
        for length, same in groupby(pattern):
            times = len(list(same))
            out.append((length, taken[length], first, offset, times))
            taken[length] += n * times
            offset += length * times
        first += n
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def placed(ranked: DataFrame, patterns: list[tuple[list[int], int]]) -> DataFrame:
    """Rank within the length to sequence_id and offset. The slots of a length go to every task, so that ids, most of a piece's bytes, stay in the JVM and where they are."""
    rows = [(length, *map(list, zip(*(s[1:] for s in same)))) for length, same in groupby(slots(patterns).tolist(), key=lambda s: s[0])]
    by_length = ranked.sparkSession.createDataFrame(rows, "length long, ranks array<long>, firsts array<long>, offsets array<long>, times array<long>")
    found = ranked.join(F.broadcast(by_length), "length").withColumn("at", F.size(F.filter("ranks", lambda r: r <= F.col("rank"))) - 1)
    nth, times = F.col("rank") - F.get("ranks", F.col("at")), F.get("times", F.col("at"))
    sequence, offset = F.get("firsts", F.col("at")) + F.floor(nth / times), F.get("offsets", F.col("at")) + nth % times * F.col("length")
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", sequence.alias("sequence_id"), offset.alias("offset"))


def pack(docs: DataFrame, tokenizer: str = BYTE_BPE, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, ids (little-endian unsigned 32-bit; null without
    keep_ids), sequence_id, offset. tokenizer: a file, or the name of a public one.

    Pieces are written in buckets by the task that made them. So they stay where they are when they are joined with the
    ranks before each task, one row of counts per task, which is shuffled to them whatever its size.
    """
    spark = docs.sparkSession
    docs = columns(docs, doc_id=(id_col, "long"), text=(text_col, None))
    # with fewer buckets than shuffle partitions Spark would shuffle the pieces after all
    buckets = min(MOST_BUCKETS, max(1, docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    path, name = new_path(spark, "pieces"), f"lexispark_pieces_{uuid.uuid4().hex}"
    with batches_of(spark):
        docs.mapInArrow(_tokenise(tokenizer, keep_ids), _PIECES).write.bucketBy(buckets, "part").option("path", path).format("parquet").saveAsTable(name)
    pieces = spark.table(name)
    passing(path)
    by_part = materialize(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = by_part.select("part", "length", F.coalesce(before, F.lit(0)).alias("base")).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("length", "base"))).alias("bases"))
    ranked = pieces.join(bases.hint("shuffle_hash"), ["part"]).withColumn("rank", F.element_at("bases", F.col("length")) + F.col("local")).drop("bases")
    return placed(ranked, pack_histogram(histogram))


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: sequence_id, ids (all pieces, without padding), length. A sequence has at most SEQUENCE pieces."""
    piece = F.struct("offset", "ids")
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(piece)).alias("p")).select("sequence_id", "length", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))

"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. Every partition hashes its normalised texts, sorts the distinct fingerprints of each owner (a range of hash values) and
   sends them as one Golomb-coded message.
2. Every owner decodes its messages and answers each with a bitmap of the fingerprints that another message has as well.
3. A row is suspect if its bit is set or its own partition has its fingerprint twice. Only suspects' texts are shuffled;
   they are grouped by their bytes, so that equal fingerprints of different texts never merge.

Rows are numbered in a copy, and tasks that read the copy look up the numbers of suspects, and of rows to drop, in small
files of their own parts. So no row is shuffled to meet its verdict.

Defined results: a null text counts as empty; rows with a null doc_id take part, and the smallest doc_id that isn't null
stays (null if there is none); of rows that repeat both doc_id and text exactly one stays; a text of any length is hashed and
compared whole; an empty table gives no rows; further columns of the input, whatever their names, are ignored or kept as
they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, RowLists, batch, columns, join_hot, materialize, numbered_copy, one_space, only, place_of, release, settled, steps, strings, utf8

#: Rows of a partition that one message set covers at most.
PART_ROWS = 200_000
#: Fingerprints that one owner gets, about.
OWNER_ROWS = 500_000
#: Chance of a false suspect is about 2 ** -SPARE_BITS.
SPARE_BITS = 12


def golomb_encode(values: np.ndarray) -> bytes:
    """Sorted distinct uint64 values: gaps as quotients in unary, then remainders of k bits (the Golomb divisor is 2 ** k)."""
    n = len(values)
    if not n:
        return b"\0"
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    mean = float(values[-1]) / n
    k = max(0, int(np.log2(mean * 0.69))) if mean > 2 else 0
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.ones(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 0
    low = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return bytes([k]) + n.to_bytes(4, "little") + len(unary).to_bytes(8, "little") + np.packbits(unary).tobytes() + np.packbits(low.ravel()).tobytes()


def golomb_decode(data: bytes) -> np.ndarray:
    """The values that golomb_encode() got."""
    k = data[0]
    if len(data) == 1:
        return np.empty(0, np.uint64)
    n, bits = int.from_bytes(data[1:5], "little"), int.from_bytes(data[5:13], "little")
    cut = 13 + (bits + 7) // 8
    unary = np.unpackbits(np.frombuffer(data, np.uint8, cut - 13, 13), count=bits)
    ends = np.flatnonzero(unary == 0)
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        low = np.unpackbits(np.frombuffer(data, np.uint8, offset=cut), count=n * k).reshape(n, k).astype(np.uint64)
        gaps += (low << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def _owner_bounds(owners: int, bits: int) -> np.ndarray:
    """First fingerprint of each owner but the first."""
    return np.array([(i << bits) // owners for i in range(1, owners)], np.uint64)


_EXCHANGE = "part long, owner int, ids array<long>, rows array<long>, digests binary, places array<int>, own_twice binary, message binary"


def _send(owners: int, bits: int):
    bounds = _owner_bounds(owners, bits)
    starts = np.concatenate((np.zeros(1, np.uint64), bounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        task, flushed = TaskContext.get().partitionId(), 0
        ids: list = []
        rows: list[np.ndarray] = []
        digests: list[bytes] = []

        def messages():
            raw = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)
            nth = np.concatenate(rows)
            prints = raw[:, :8].copy().view(">u8").ravel().astype(np.uint64) >> np.uint64(64 - bits)
            owner = np.searchsorted(bounds, prints, side="right")
            out: list[list] = [[] for _ in range(8)]
            order = np.lexsort((prints, owner))
            for at in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1):
                o = int(owner[at[0]])
                values, places, counts = np.unique(prints[at], return_inverse=True, return_counts=True)
                for column, x in zip(out, (task * 1_000_000 + flushed, o, [ids[i] for i in at], nth[at], raw[at].tobytes(), places.astype(np.int32), np.packbits(counts > 1).tobytes(), golomb_encode(values - starts[o]))):
                    column.append(x)
            return batch(_EXCHANGE, out)

        for b in steps(batches, 1):
            ids += b.column(0).to_pylist()
            rows.append(b.column(2).to_numpy())
            digests += [hashlib.sha256(one_space(utf8(t))).digest() for t in strings(b.column(1))]
            if len(ids) >= PART_ROWS:
                yield messages()
                ids, rows, digests, flushed = [], [], [], flushed + 1
        if ids:
            yield messages()
        del ids, rows, digests
        release()

    return run


_ANSWER = "part long, owner int, bitmap binary"


def _answer(table: pa.Table) -> pa.Table:
    """An owner's answers: for each message, which of its fingerprints another message has as well."""
    sent = [golomb_decode(m) for m in table.column("message").to_pylist()]
    _, places, counts = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
    known = np.split(counts[places] > 1, np.cumsum([len(x) for x in sent])[:-1])
    return pa.table({"part": table.column("part"), "owner": table.column("owner"), "bitmap": pa.array([np.packbits(x).tobytes() for x in known], pa.binary())})


_LEDGER = "doc_id long, nth long, digest binary, suspect boolean"


def _receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for ids, rows, digests, places, own, bitmap in zip(*(b.column(k).to_pylist() for k in ("ids", "rows", "digests", "places", "own_twice", "bitmap"))):
            flags = np.unpackbits(np.frombuffer(own, np.uint8)) | np.unpackbits(np.frombuffer(bitmap, np.uint8))
            yield batch(_LEDGER, [ids, rows, pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(ids), [None, pa.py_buffer(digests)]).cast(pa.binary()), flags[np.array(places)].astype(bool)])


def normalised(text: Column) -> Column:
    """The text that equality is about."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, " ")


def _chosen(lists: RowLists, at: int, listed: bool):
    """Rows of a numbered copy that are in lists, or those that aren't; at: the place of nth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        find = lists.finder()
        for b in batches:
            yield b.filter(pa.array((find(b.column(at).to_numpy()) != 0) == listed))
        release()

    return run


def _decide(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of a numbered copy (doc_id, text, nth): the ledger, and of its suspects nth, keep_id, keep_nth and group_size."""
    total = rows.count()
    bits = min(62, max(1, total).bit_length() + SPARE_BITS)
    owners = max(32, -(-total // OWNER_ROWS))
    exchange = materialize(rows.mapInArrow(_send(owners, bits), _EXCHANGE), "exchange")
    answers = exchange.select("part", "owner", "message").groupBy("owner").applyInArrow(_answer, _ANSWER)
    ledger = materialize(exchange.drop("message").join(answers, ["part", "owner"]).mapInArrow(_receive, _LEDGER), "ledger")
    suspects = RowLists(ledger.filter("suspect"), "suspects")
    texts = rows.mapInArrow(_chosen(suspects, 2, True), "doc_id long, text string, nth long").select("doc_id", "nth", normalised(F.col("text")).alias("norm"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "nth")).alias("first")
    same_bytes = texts.groupBy("norm").agg(first, F.count("*").alias("group_size")).select(F.unhex(F.sha2("norm", 256)).alias("digest"), "first.doc_id", "first.nth", "group_size")
    clash = F.raise_error(F.lit("different texts have one SHA-256 digest"))
    groups = same_bytes.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.min("nth").alias("keep_nth"), F.max("group_size").alias("group_size"), F.count("*").alias("texts"))
    groups = materialize(groups.select("digest", "keep_id", F.when(F.col("texts") > 1, clash.cast("long")).otherwise(F.col("keep_nth")).alias("keep_nth"), "group_size"), "groups")
    return ledger, join_hot(ledger.filter("suspect"), groups, ["digest"], "group_size", total)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256; written, with its intermediate tables deleted.

    Texts are equal if they are identical once each run of BLANK is one space; of equal texts the row with the smallest
    doc_id is kept. Shuffled are a few bytes for each row and the texts of suspects, equal ones once per partition.
    """

    def decided() -> DataFrame:
        ledger, found = _decide(numbered_copy(columns(docs, doc_id=(id_col, "long"), text=(text_col, None)), "copy"))
        hexed = F.lower(F.hex("digest")).alias("text_sha256")
        alone = ledger.filter(~F.col("suspect")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), hexed)
        return alone.unionByName(found.select("doc_id", "keep_id", "group_size", (F.col("nth") == F.col("keep_nth")).alias("kept"), hexed))

    return settled(decided, docs.sparkSession, "exact")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_duplicates() drops, all columns as they were. Rows that stay aren't shuffled."""
    id_at, text_at = place_of(docs, id_col), place_of(docs, text_col)
    copy = numbered_copy(docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))), "copy")
    _, found = _decide(copy.select(F.col(f"c{id_at}").cast("long").alias("doc_id"), F.col(f"c{text_at}").alias("text"), "nth"))
    gone = RowLists(found.filter("nth <> keep_nth"), "gone")
    return copy.mapInArrow(_chosen(gone, len(docs.columns), False), copy.schema).drop("nth").toDF(*docs.columns)

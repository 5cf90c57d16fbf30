"""Token files in a static range asymmetric numeral system.

One frequency table over all tokens is shared by all files. A file holds the ids of consecutive documents in ascending
doc_id order, as blocks that decode on their own. In a block LANES coders are interleaved: token t belongs to lane
t mod lanes, and all lanes share one stream of 32-bit words. At every CHECKPOINT tokens the block's head has the lanes'
states and the place in the stream, so that parts of a block decode in parallel too.

File: MAGIC, digest of the table (32 bytes), blocks, index, then the index's offset and size, its CRC-32 and MAGIC again.
Block: tokens, lanes, checkpoints, words (unsigned 32-bit); then for each checkpoint the place in the stream (64-bit) and
the lanes' states (64-bit); the words; CRC-32 of the block before it. Index (zlib): documents, blocks; for each block
offset, size, tokens and CRC-32 of its ids; doc_ids, which of them are null, and numbers of tokens.
All numbers are little-endian.

Files get a name of their own for each attempt of a task; only those that the manifest lists, which Spark commits, are read.

Defined results: a null text is one end id; null doc_ids come first; documents that tie on doc_id are in order of their ids'
checksum; an empty table gives no files; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.writers import filesystem
from .common import batch, binaries, columns, materialize, new_path, only, ragged, scratch, steps
from .tokens import STEP_BYTES, WORD_BPE, encoder, with_end

MAGIC = b"LXRANS01"
END_ID = 1
SCALE_BITS = 20
LANES, BLOCK, CHECKPOINT = 1024, 1 << 18, 1 << 17
#: Tokens of a file, about; tasks that write and read one hold a block of it, and one document.
FILE_TOKENS = 4_000_000
#: Tasks whose files' sums are added up together.
GROUP_FILES = 1000
_LOW = np.uint64(1 << 31)


class Table:
    """Frequencies of symbols that sum to 2 ** SCALE_BITS, each symbol that occurs with 1 at least."""

    def __init__(self, frequencies: np.ndarray):
        self.frequencies = np.asarray(frequencies, np.uint64)
        self.starts = np.cumsum(self.frequencies, dtype=np.uint64) - self.frequencies
        self.symbols = np.repeat(np.arange(len(self.frequencies), dtype=np.uint32), self.frequencies.astype(np.int64))
        self.digest = hashlib.sha256(self.frequencies.astype("<u4").tobytes()).digest()

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> "Table":
        counts = np.asarray(counts, np.int64)
        total, size = int(counts.sum()), 1 << SCALE_BITS
        if not total:
            return cls(np.array([size]))
        scaled = np.where(counts > 0, np.maximum(1, (counts.astype(float) * (size / total)).astype(np.int64)), 0)
        over = int(scaled.sum()) - size
        while over:  # the most frequent symbols give or take what rounding left
            top = np.argsort(-scaled, kind="stable")[: max(1, min(abs(over), 4096))]
            step = np.minimum(scaled[top] - 1, max(1, over // len(top))) if over > 0 else np.full(len(top), max(1, -over // len(top)))
            step = step[np.cumsum(step) <= abs(over)] if step.sum() > abs(over) else step
            scaled[top[: len(step)]] -= step if over > 0 else -step
            over = int(scaled.sum()) - size
        return cls(scaled)


def encode_block(ids: np.ndarray, table: Table, lanes: int = LANES, checkpoint: int = CHECKPOINT) -> bytes:
    """A block of at least one id."""
    n, bits = len(ids), np.uint64(SCALE_BITS)
    lanes = max(1, min(lanes, n // 64))
    steps = -(-n // lanes)
    filled = np.full(steps * lanes, int(np.argmax(table.frequencies)), np.int64)
    filled[:n] = ids
    frequency, start = table.frequencies[filled].reshape(steps, lanes), table.starts[filled].reshape(steps, lanes)
    state = np.full(lanes, _LOW, np.uint64)
    top = np.uint64(31 - SCALE_BITS + 32)
    words: list[np.ndarray] = []
    every = max(1, checkpoint // lanes)
    states: list[tuple[int, np.ndarray]] = []
    written = 0
    for s in range(steps - 1, -1, -1):
        f = frequency[s]
        full = state >= (f << top)
        if full.any():
            words.append((state[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            written += len(words[-1])
            state[full] >>= np.uint64(32)
        quotient = state // f
        state = (quotient << bits) + (state - quotient * f) + start[s]
        if s % every == 0:
            states.append((written, state.astype("<u8")))
    stream = np.concatenate(words[::-1]) if words else np.empty(0, "<u4")
    head = struct.pack("<4I", n, lanes, len(states), len(stream))
    body = head + b"".join(struct.pack("<Q", len(stream) - w) + x.tobytes() for w, x in states[::-1]) + stream.tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


def decode_block(data: bytes, table: Table, checkpoint: int = CHECKPOINT, part: int | None = None) -> np.ndarray:
    """A block's ids, or those from one checkpoint to the next. The parts between checkpoints are decoded side by side, as further lanes."""
    if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("a block does not have its checksum")
    n, lanes, points, size = struct.unpack("<4I", data[:16])
    steps, every, entry = -(-n // lanes), max(1, checkpoint // lanes), 8 + 8 * lanes
    stream = np.append(np.frombuffer(data, "<u4", size, 16 + points * entry).astype(np.uint64), np.uint64(0))
    bits, mask = np.uint64(SCALE_BITS), np.uint64((1 << SCALE_BITS) - 1)
    own = range(points) if part is None else range(part, part + 1)
    heads = [16 + k * entry for k in own]
    place = np.array([struct.unpack("<Q", data[a : a + 8])[0] for a in heads], np.int64)
    state = np.concatenate([np.frombuffer(data, "<u8", lanes, a + 8) for a in heads]).astype(np.uint64)
    last = min(every, steps - own[-1] * every)  # the block's last part may be shorter
    out = np.empty((len(own), every if len(own) > 1 else last, lanes), np.uint32)
    for s in range(out.shape[1]):
        if s == last:
            place, state = place[:-1], state[:-lanes]
        slot = state & mask
        symbol = table.symbols[slot]
        out[: len(place), s] = symbol.reshape(len(place), lanes)
        state = table.frequencies[symbol] * (state >> bits) + slot - table.starts[symbol]
        low = (state < _LOW).reshape(len(place), lanes)
        counts = low.sum(axis=1)
        if counts.any():
            flat = low.ravel()
            state[flat] = (state[flat] << np.uint64(32)) | stream[ragged(place, counts)]
            place = place + counts
    flat = out.reshape(-1)
    return flat[: min(n - own[0] * every * lanes, (len(own) - 1) * every * lanes + last * lanes)]


class FileWriter:
    """Writes a file to `out` block by block, holding one block's ids and the index."""

    def __init__(self, out, table: Table, block: int = BLOCK):
        self.out, self.table, self.block = out, table, block
        self.docs: list = []
        self.sizes: list[np.ndarray] = []
        self.entries: list[tuple[int, int, int, int]] = []
        self.held, self.waiting, self.tokens = [], 0, 0
        self.offset = len(MAGIC + table.digest)
        out.write(MAGIC + table.digest)

    def add(self, doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Documents with all their ids, one after the other."""
        self.docs += doc_ids
        self.sizes.append(np.asarray(lengths, np.int64))
        self.held.append(ids)
        self.waiting += len(ids)
        self.tokens += len(ids)
        if self.waiting >= self.block:
            self._flush(False)

    def _flush(self, all_: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        cut = len(ids) if all_ else len(ids) // self.block * self.block
        for a in range(0, cut, self.block):
            own = ids[a : min(cut, a + self.block)]
            data = encode_block(own, self.table)
            self.out.write(data)
            self.entries.append((self.offset, len(data), len(own), zlib.crc32(own.astype("<u4"))))
            self.offset += len(data)
        self.held, self.waiting = [ids[cut:].copy()], len(ids) - cut

    def close(self) -> int:
        """Writes the index; the file's size."""
        self._flush(True)
        known = np.array([d is not None for d in self.docs], bool)
        plain = np.array([d or 0 for d in self.docs], "<i8")
        sizes = np.concatenate(self.sizes) if self.sizes else np.empty(0, np.int64)
        index = struct.pack("<2Q", len(self.docs), len(self.entries)) + np.array(self.entries, "<u8").tobytes() + plain.tobytes() + np.packbits(known).tobytes() + sizes.astype("<u8").tobytes()
        packed = zlib.compress(index, 6)
        self.out.write(packed + struct.pack("<2QI", self.offset, len(packed), zlib.crc32(packed)) + MAGIC)
        return self.offset + len(packed) + 28


def read_index(source, size: int, table: Table) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, numbers of tokens, and the blocks (offset, size, tokens, checksum) of an open file."""
    source.seek(0)
    head = source.read(40)
    source.seek(size - 28)
    tail = source.read(28)
    if head[:8] != MAGIC or tail[-8:] != MAGIC or head[8:] != table.digest:
        raise ValueError("not a token file of this frequency table")
    offset, length, crc = struct.unpack("<2QI", tail[:-8])
    source.seek(offset)
    packed = source.read(length)
    if zlib.crc32(packed) != crc:
        raise ValueError("an index does not have its checksum")
    index = zlib.decompress(packed)
    docs, blocks = struct.unpack("<2Q", index[:16])
    entries = np.frombuffer(index, "<u8", 4 * blocks, 16).reshape(blocks, 4)
    at = 16 + 32 * blocks
    plain = np.frombuffer(index, "<i8", docs, at).tolist()
    known = np.unpackbits(np.frombuffer(index, np.uint8, (docs + 7) // 8, at + 8 * docs), count=docs).tolist()
    lengths = np.frombuffer(index, "<u8", docs, at + 8 * docs + (docs + 7) // 8).astype(np.int64)
    return [d if k else None for d, k in zip(plain, known)], lengths, entries


def read_documents(source, size: int, table: Table) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """A file's documents in order, as blocks complete them: doc_ids, numbers of tokens, all their ids. Held are a block and the document that it cuts."""
    docs, lengths, entries = read_index(source, size, table)
    ends = np.cumsum(lengths)
    held: list[np.ndarray] = []
    done, decoded = 0, 0
    for offset, length, tokens, crc in entries.tolist():
        source.seek(offset)
        ids = decode_block(source.read(length), table)
        if len(ids) != tokens or zlib.crc32(ids.astype("<u4")) != crc:
            raise ValueError("a block's ids do not have their checksum")
        held.append(ids)
        decoded += tokens
        whole = int(np.searchsorted(ends, decoded, side="right"))
        if whole > done:
            flat = np.concatenate(held)
            take = int(lengths[done:whole].sum())
            yield docs[done:whole], lengths[done:whole], flat[:take]
            held, done = [flat[take:].copy()], whole
    if done < len(docs):
        raise ValueError("a file's blocks have fewer ids than its documents")


_TOKENS = "doc_id long, n_tokens long, crc long, ids binary, counts binary"


def _tokenise(path: str):
    """A row for each document, and at a task's end one with how often the task has met each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("tokens")
        tokens, total = encoder(path, False), np.zeros(0, np.int64)
        kind = "<u2" if tokens.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        for b in steps(batches, 1, STEP_BYTES):
            flat, sizes = with_end(*tokens.encode(b.column(1)), END_ID)
            data = memoryview(flat).cast("B")
            ends = np.cumsum(4 * sizes)
            crc = [zlib.crc32(data[a:z]) for a, z in zip((ends - 4 * sizes).tolist(), ends.tolist())]
            total = _sum(total, np.bincount(flat))
            yield batch(_TOKENS, [b.column(0), sizes, crc, binaries(flat.astype(kind), np.dtype(kind).itemsize * sizes), pa.nulls(len(sizes), pa.binary())])
        if len(total):
            yield batch(_TOKENS, [[None], [None], [None], [None], [total.astype("<i8").tobytes()]])

    return run


def _ids(rows: pa.Array, lengths: np.ndarray) -> np.ndarray:
    """All ids of rows of binaries of two or four bytes for each id."""
    data = b"".join(rows.to_numpy(zero_copy_only=False).tolist())
    return np.frombuffer(data, "<u2" if len(data) == 2 * int(lengths.sum()) else "<u4")


def _sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if len(a) < len(b):
        a, b = b, a
    a = a.astype(np.int64)
    a[: len(b)] += b
    return a


def _add(table: pa.Table) -> pa.Table:
    total = np.zeros(0, np.int64)
    for data in table.column("counts").to_pylist():
        total = _sum(total, np.frombuffer(data, "<i8"))
    return pa.table({"part": pa.array([table.column("part")[0].as_py()]), "counts": pa.array([total.tobytes()], pa.binary())})


def token_counts(tokens: DataFrame) -> np.ndarray:
    """Occurrences of every id in all rows, summed in groups of tasks, then over the groups; the driver gets one vector of the vocabulary's size."""
    found = tokens.filter("counts IS NOT NULL").select(F.pmod(F.xxhash64("counts"), F.lit(64)).alias("part"), "counts")
    groups = found.groupBy("part").applyInArrow(_add, "part long, counts binary")
    one = groups.withColumn("part", F.lit(0).cast("long")).groupBy("part").applyInArrow(_add, "part long, counts binary").collect()
    return np.frombuffer(one[0]["counts"], "<i8") if one else np.zeros(0, np.int64)


_MANIFEST = "file string, number long, nth long, docs long, tokens long, bytes long"


def _write(folder: str, frequencies: np.ndarray, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, nth, writer, table = TaskContext.get().partitionId(), 0, None, Table(frequencies)
        fs, path = filesystem(folder)

        def end():
            size = writer.close()
            writer.out.close()
            return batch(_MANIFEST, [[name], [number], [nth], [len(writer.docs)], [writer.tokens], [size]])

        for b in steps(batches, "ids", STEP_BYTES):
            lengths = b.column("n_tokens").to_numpy()
            if writer is None:
                name = f"tokens-{number:06d}-{nth:04d}-{uuid.uuid4().hex}.rans"
                fs.create_dir(path, recursive=True)
                writer = FileWriter(fs.open_output_stream(f"{path}/{name}"), table)
            writer.add(b.column("doc_id").to_pylist(), lengths, _ids(b.column("ids"), lengths))
            if writer.tokens >= most:
                yield end()
                writer, nth = None, nth + 1
        if writer is not None:
            yield end()

    return run


@dataclass(frozen=True)
class TokenFiles:
    """Where the files are, their manifest, and their frequency table."""

    folder: str
    manifest: str
    frequencies: np.ndarray


def write_token_files(docs: DataFrame, tokenizer: str = WORD_BPE, id_col: str = "doc_id", text_col: str = "text") -> TokenFiles:
    """Encodes every whole text, with END_ID after it, in ascending doc_id order. tokenizer: a file, or the name of a public one."""
    spark = docs.sparkSession
    docs = columns(docs, doc_id=(id_col, "long"), text=(text_col, None))
    with scratch(spark):
        tokens = materialize(docs.mapInArrow(_tokenise(tokenizer), _TOKENS), "tokens")
        counts = token_counts(tokens)
        table = Table.of_counts(counts)
        folder = new_path(spark, "rans")
        parts = max(1, -(-int(counts.sum()) // FILE_TOKENS))
        rows = tokens.filter("counts IS NULL").select("doc_id", "n_tokens", "crc", "ids")
        ordered = rows.repartitionByRange(parts, F.col("doc_id"), F.col("crc")).sortWithinPartitions("doc_id", "crc")
        ordered.mapInArrow(_write(f"{folder}/files", table.frequencies.astype(np.uint32), 2 * FILE_TOKENS), _MANIFEST).write.parquet(f"{folder}/manifest")
    return TokenFiles(f"{folder}/files", f"{folder}/manifest", table.frequencies.astype(np.uint32))


_READ = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"


def _read(folder: str, frequencies: np.ndarray, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(frequencies)
        fs, path = filesystem(folder)
        for b in batches:
            for name, base, size in zip(*(b.column(k).to_pylist() for k in ("file", "base", "bytes"))):
                with fs.open_input_file(f"{path}/{name}") as f:
                    for docs, lengths, ids in read_documents(f, size, table):
                        ids = ids.astype("<u4")
                        data, ends = memoryview(ids).cast("B"), 4 * np.cumsum(lengths)
                        crc = [zlib.crc32(data[a:z]) for a, z in zip((ends - 4 * lengths).tolist(), ends.tolist())]
                        yield batch(_READ, [docs, base + ends // 4 - lengths, lengths, crc, binaries(ids, 4 * lengths) if keep_ids else pa.nulls(len(docs), pa.binary())])
                        base += len(ids)

    return run


def read_token_files(spark: SparkSession, files: TokenFiles, keep_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids (little-endian unsigned 32-bit)."""
    manifest = spark.read.schema(_MANIFEST).parquet(files.manifest).withColumn("group", F.expr(f"number div {GROUP_FILES}"))
    # sums before each file: within groups of files, and over the groups, which are a thousandth as many
    groups = manifest.groupBy("group").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    before = F.sum("tokens").over(Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1))
    groups = groups.select("group", F.coalesce(before, F.lit(0)).alias("earlier"))
    own = F.sum("tokens").over(Window.partitionBy("group").orderBy("number", "nth").rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.withColumn("own", F.coalesce(own, F.lit(0))).join(groups, "group").select("file", (F.col("earlier") + F.col("own")).alias("base"), "bytes", "number", "nth")
    n = max(1, spark.read.parquet(files.manifest).count())
    return placed.repartitionByRange(n, "number", "nth").select("file", "base", "bytes").mapInArrow(_read(files.folder, files.frequencies, keep_ids), _READ)

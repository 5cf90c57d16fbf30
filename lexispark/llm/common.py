"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import new_path  # noqa: F401  operators take it from here
from ..sources.writers import filesystem

#: The white space of the contracts: space and U+0009 to U+000D.
BLANK = r"[\x20\x09-\x0D]+"
_TO_SPACE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
#: Bytes of text that one vectorised step holds, about (a single longer text is a step of its own).
STEP_BYTES = 750_000
#: Rows that count as much as those bytes.
STEP_ROWS = 2000


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: lineage ends here, and what follows survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    passing(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder that materialize() or a writer of this subpackage has made, once its readers are done."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


_SCRATCH: list[list[str]] = []


def passing(path: str) -> None:
    """Marks a folder to be deleted with the innermost scratch(), if there is one."""
    if _SCRATCH:
        _SCRATCH[-1].append(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What materialize() writes in this context is deleted at its end; a result that reads it has to be written within."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            discard(spark, path)


@contextlib.contextmanager
def noting(paths: list[str]) -> Iterator[None]:
    """What materialize() writes in this context is noted, for its user to discard later."""
    _SCRATCH.append(paths)
    try:
        yield
    finally:
        _SCRATCH.pop()


def settled(df: Callable[[], DataFrame], spark: SparkSession, name: str) -> DataFrame:
    """A frame that needs many intermediate tables, written to the shared folder; its intermediate tables are deleted."""
    with scratch(spark):
        out = df()
        path = new_path(spark, name)
        out.write.parquet(path)
    passing(path)
    return spark.read.schema(out.schema).parquet(path)


#: Parts whose lists of rows lie in one file.
GROUP_PARTS = 16


def numbered_copy(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder, with a number for each row, nth, whose upper bits are the part that wrote it."""
    return materialize(df.withColumn("nth", F.monotonically_increasing_id()), name)


class RowLists:
    """Lists of row numbers of a numbered copy, in files by groups of parts, which tasks that read the copy look up themselves: rows with all their text then need no shuffle to meet what was decided about them."""

    def __init__(self, rows: DataFrame, name: str):
        """rows: nth, each once, and a mask (long, not 0) if there is more to say than that it is listed."""
        self.path = new_path(rows.sparkSession, name)
        group = F.expr(f"shiftright(nth, 33) div {GROUP_PARTS}").alias("group")
        mask = F.col("mask") if "mask" in rows.columns else F.lit(1).cast("long").alias("mask")
        rows.select("nth", mask, group).repartition("group").write.partitionBy("group").parquet(self.path)
        passing(self.path)

    def finder(self) -> Callable[[np.ndarray], np.ndarray]:
        """In a worker: the masks of row numbers, 0 for those that aren't listed. The lists of the last group that was asked for are held."""
        from pyarrow import parquet

        fs, folder = filesystem(self.path)
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def listed(group: int) -> tuple[np.ndarray, np.ndarray]:
            if group not in held:
                held.clear()
                files = fs.get_file_info(_selector(f"{folder}/group={group}"))
                found = [parquet.ParquetFile(fs.open_input_file(f.path)).read(["nth", "mask"]) for f in files if f.path.endswith(".parquet")]
                nth, mask = (np.concatenate([np.empty(0, np.int64), *(t.column(k).to_numpy() for t in found)]) for k in ("nth", "mask"))
                order = np.argsort(nth)
                held[group] = nth[order], mask[order]
            return held[group]

        def find(nth: np.ndarray) -> np.ndarray:
            out = np.zeros(len(nth), np.int64)
            groups = (nth >> 33) // GROUP_PARTS
            for group in np.unique(groups).tolist():
                at, (own, mask) = np.flatnonzero(groups == group), listed(group)
                if len(own):
                    place = np.minimum(np.searchsorted(own, nth[at]), len(own) - 1)
                    out[at] = np.where(own[place] == nth[at], mask[place], 0)
            return out

        return find


def _selector(folder: str):
    from pyarrow import fs

    return fs.FileSelector(folder, allow_not_found=True)


def steps(batches: Iterable[pa.RecordBatch], column: int | str, most: int = STEP_BYTES, rows: int = STEP_ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of batches, before Python makes objects of them, whose texts have about `most` bytes in all (a single longer text is a slice of its own), and of at most about twice `rows` rows."""
    for b in batches:
        if b.num_rows:
            sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy().astype(np.int64) + most // rows
            step = (np.cumsum(sizes) - sizes) // most
            cut = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), b.num_rows]
            for a, z in zip(cut[:-1], cut[1:]):
                yield b.slice(a, z - a)


def strings(column: pa.Array) -> list[str]:
    """A column of texts as a list; a null is empty."""
    return pc.fill_null(column, "").to_numpy(zero_copy_only=False).tolist()


def binaries(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Rows of bytes that lie one after the other in data; lengths in bytes."""
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    if offsets[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    held = memoryview(np.ascontiguousarray(data)).cast("B")
    return pa.array([held[a:z] for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.binary())


_MEMOS: dict[str, Callable[[], None]] = {}


def memo(name: str, clear: Callable[[], None]) -> None:
    """Names something that a Python worker remembers between tasks, and how to forget it."""
    _MEMOS[name] = clear


def only(name: str = "") -> None:
    """Forgets what other operators have left in this worker, so that memory holds one operator's memo at a time."""
    for other, clear in _MEMOS.items():
        if other != name:
            clear()
    release()


def release() -> None:
    """Gives unused memory back: a worker may be idle for long once its task is done."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int = STEP_ROWS) -> Iterator[None]:
    """What is written in this context goes to Python in batches of so many rows: executor and worker each hold one whole."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def utf8(text: str) -> bytes:
    """Bytes of a text; lone surrogates, which no valid column holds, don't raise."""
    return text.encode("utf-8", "surrogatepass")


def one_space(data: bytes) -> bytes:
    """Each run of BLANK replaced by one space."""
    data = data.translate(_TO_SPACE)
    while b"  " in data:
        data = data.replace(b"  ", b" ")
    return data


def split_words(data: bytes) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+` of a text in UTF-8: bytes.split() knows exactly these six white-space bytes."""
    return data.split()


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser over an array of uint64 (a new array)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, one run after the other."""
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    if not total:
        return out[:0]
    some = lengths > 0
    s, n = starts[some], lengths[some]
    at = np.concatenate(([0], np.cumsum(n)[:-1]))
    out[0] = s[0]
    out[at[1:]] = s[1:] - s[:-1] - n[:-1] + 1
    return np.cumsum(out)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of "name type, ..." with the plain types above and arrays of them (workers have no session to parse it)."""
    fields = []
    for name, kind in (x.split(" ") for x in ddl.split(", ")):
        fields.append((name, pa.list_(_ARROW[kind[6:-1]]) if kind.startswith("array<") else _ARROW[kind]))
    return pa.schema(fields)


def batch(ddl: str, columns: list) -> pa.RecordBatch:
    """Columns as a record batch of that schema."""
    schema = arrow_schema(ddl)
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def place_of(docs: DataFrame, name: str) -> int:
    """A column's place by its very name, or else by its name in any case."""
    names = docs.columns
    if name in names:
        return names.index(name)
    return [n.lower() for n in names].index(name.lower())


def columns(docs: DataFrame, **wanted: tuple[str, str | None]) -> DataFrame:
    """Columns of docs, found by their very names whatever others there are, under new names: name=(column, type or None)."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    out = []
    for name, (column, kind) in wanted.items():
        found = F.col(f"c{place_of(docs, column)}")
        out.append((found.cast(kind) if kind else found).alias(name))
    return plain.select(*out)


def in_rows(docs: DataFrame, **wanted: tuple[str, str | None]) -> DataFrame:
    """The same with all columns of docs as they are in one more column, the struct `row`, so that names never clash."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    found = {name: F.col(f"c{place_of(docs, column)}") for name, (column, _) in wanted.items()}
    return plain.select(F.struct(*plain.columns).alias("row"), *((c.cast(wanted[n][1]) if wanted[n][1] else c).alias(n) for n, c in found.items()))


def out_of_rows(rows: DataFrame, names: list[str]) -> DataFrame:
    """The columns in `row`, under their own names again."""
    return rows.select(*(F.col("row")[f"c{i}"].alias(n) for i, n in enumerate(names)))


def join_hot(many: DataFrame, one: DataFrame, keys: list[str], size: str, total: int, how: str = "inner", share: int = 1000) -> DataFrame:
    """many JOIN one on keys, where `one` has a row per key and `size` says how many rows of `many` have it.

    Keys with over total / share rows, of which there are fewer than `share`, go by broadcast, a bound that holds at any
    input; the rest, none of them hot, is shuffled. total: the rows of `many`. keys must not be null.
    """
    least = max(total // share, 100)
    hot, rest = one.filter(F.col(size) > least), one.filter(~(F.col(size) > least))
    marks = F.broadcast(hot.select(*keys))
    return many.join(F.broadcast(hot), keys, "inner").unionByName(many.join(marks, keys, "left_anti").join(rest, keys, how), allowMissingColumns=True)


def repeated(rows: DataFrame, times: str, nth: str, most: int = 10_000) -> DataFrame:
    """Each row as often as `times` says (1 at least), with its number from 0 on in `nth`. What is repeated more than `most` times is dealt over many tasks."""
    few = rows.filter(F.col(times) <= most).withColumn(nth, F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1)))
    begin = rows.filter(F.col(times) > most).withColumn(nth, F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1, F.lit(most).cast("long"))))
    dealt = begin.repartition(F.xxhash64(nth))
    return few.unionByName(dealt.withColumn(nth, F.explode(F.sequence(F.col(nth), F.least(F.col(nth) + most, F.col(times)) - 1))))


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of keys."""
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out

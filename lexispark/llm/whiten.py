"""Whitening of embeddings by a tall-skinny QR.

Entries become whole numbers, floor(SCALE * c) + SHIFT, so that counts and sums by dimension are exact whatever the order of
tasks. Centred rows come from the exact sums. Each task folds its rows, block by block, into one triangular factor; factors
meet in a tree, FAN_IN at a time, until one is left, whose singular values and right vectors whiten: no covariance is formed.
What leaves a task is one factor of dims x dims, and what reaches the driver is the last of them: a size that depends on
the number of dimensions alone. Rows are never shuffled.

The covariance of what was whitened is then measured in one more pass (sums of products of at most COMPONENTS columns), as a
check: its largest difference from the identity is returned with each row.

Defined results: rows whose vector is null, or holds null, NaN or infinite entries, are left out, and so are rows whose
vector hasn't the most frequent number of entries (of several such, the largest) or has none; entries beyond 2^50 after
scaling count as that; a component without variance (its eigenvalue below the rounding of the largest) gives 0 in
`whitened` and `explained` and isn't part of the check; `deviation` is exact, and null where it doesn't fit a long; vectors
that repeat, and null or repeated ids, are rows of their own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch, columns, materialize, scratch

SCALE, SHIFT = 64.0, 1_000_000
COMPONENTS = 32
#: Triangular factors that one task of the tree merges.
FAN_IN = 16
#: Rows of a block that is factored at once.
BLOCK = 4096
_LIMIT = 2.0**50


def whole_rows(vectors: pa.Array, dims: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of list vectors: places of the valid rows, their lengths, and all their entries as whole numbers, one row after the other. dims: only rows of so many entries."""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = pc.fill_null(vectors.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    good = sizes > 0 if dims is None else sizes == dims
    good[row[~np.isfinite(entries)]] = False
    kept = entries[good[row]]
    return np.flatnonzero(good), sizes[good], np.floor(np.clip(SCALE * kept, -_LIMIT, _LIMIT)).astype(np.int64) + SHIFT


_SUMS = "dims int, n long, dim int, high long, low long"


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the upper and lower halves of entries, by number of dimensions: they can't overflow below 2^31 rows a task."""
    held: dict[int, list] = {}
    for b in batches:
        _, sizes, x = whole_rows(b.column(0))
        row_size = np.repeat(sizes, sizes)
        for d in np.unique(sizes).tolist():
            own = x[row_size == d].reshape(-1, d)
            n, high, low = held.get(d, (0, 0, 0))
            held[d] = [n + len(own), high + (own >> 32).sum(axis=0), low + (own & 0xFFFFFFFF).sum(axis=0)]
    for d, (n, high, low) in held.items():
        yield batch(_SUMS, [[d] * d, [n] * d, list(range(d)), high, low])


@dataclasses.dataclass(frozen=True)
class Centre:
    """Exact counts: n rows with the sums of each dimension."""

    n: int
    sums: tuple[int, ...]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly: as int64, or as Python's numbers where that could overflow."""
        near = [s // self.n for s in self.sums]
        x = x - np.array(near, np.int64)
        rest = [s - self.n * m for s, m in zip(self.sums, near)]
        if int(np.abs(x).max(initial=0)) * self.n + self.n < 1 << 62:
            return self.n * x - np.array(rest, np.int64)
        return self.n * x.astype(object) - np.array(rest, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.scaled(x) / self.n).astype(float)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        d = self.scaled(x)
        if d.dtype == object or len(d) and float(np.abs(d).max()) ** 2 * d.shape[1] >= 2.0**62:
            return [s if s < 1 << 63 else None for s in (sum(int(v) ** 2 for v in row) for row in d)]
        return (d * d).sum(axis=1).tolist()


def centre(vectors: DataFrame) -> Centre | None:
    """Count and sums of the valid rows of the most frequent number of dimensions (vectors has that one column). The driver gets a row per dimension."""
    found = vectors.mapInArrow(_sums, _SUMS).groupBy("dims", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    most = found.filter("dim = 0").orderBy(F.desc("n"), F.desc("dims")).select("dims").first()
    if most is None:
        return None
    rows = sorted(found.filter(F.col("dims") == most["dims"]).collect(), key=lambda r: r["dim"])
    return Centre(rows[0]["n"], tuple((int(r["high"]) << 32) + int(r["low"]) for r in rows))


def fold(r: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The triangular factor of the rows of r and block, without forming Q."""
    return np.linalg.qr(np.concatenate((r, block)), mode="r")


_FACTOR = "part long, factor binary"


def triangular(vectors: DataFrame, c: Centre) -> np.ndarray:
    """The triangular factor of all centred rows."""
    dims = len(c.sums)

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, some = np.zeros((0, dims)), False
        for b in batches:
            rows = whole_rows(b.column(0), dims)[2].reshape(-1, dims)
            for a in range(0, len(rows), BLOCK):
                r, some = fold(r, c.centred(rows[a : a + BLOCK])), True
        if some:
            yield batch("factor binary", [[r.tobytes()]])

    def merge(table: pa.Table) -> pa.Table:
        r = np.zeros((0, dims))
        for f in table.column("factor"):
            r = fold(r, np.frombuffer(f.as_buffer(), float).reshape(-1, dims))
        return pa.table({"part": table.column("part").slice(0, 1), "factor": pa.array([r.tobytes()], pa.binary())}, arrow_schema(_FACTOR))

    # factors are numbered by their tasks, and FAN_IN neighbours meet, again and again
    level = materialize(vectors.mapInArrow(leaf, "factor binary").select(F.spark_partition_id().cast("long").alias("part"), "factor"), "factors")
    last = level.agg(F.max("part")).first()[0]
    while last is not None and last > 0:
        level = materialize(level.withColumn("part", F.expr(f"part div {FAN_IN}")).groupBy("part").applyInArrow(merge, _FACTOR), "factors")
        last //= FAN_IN
    return np.concatenate([np.zeros((0, dims)), *(np.frombuffer(r["factor"], float).reshape(-1, dims) for r in level.collect())])


@dataclasses.dataclass(frozen=True)
class Whitening:
    """What whitens: rows are centred, and projected on right vectors over the roots of their eigenvalues, largest first."""

    centre: Centre
    vectors: np.ndarray  # dims x components, scaled
    eigenvalues: np.ndarray
    explained: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.vectors


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """None without a valid row."""
    c = centre(vectors)
    if c is None:
        return None
    r = triangular(vectors, c)
    _, s, right = np.linalg.svd(r, full_matrices=True)
    s = np.concatenate((s, np.zeros(len(right) - len(s))))
    e = s * s / c.n
    k = min(components, len(e))
    right = right[:k] * np.sign(right[np.arange(k), np.abs(right[:k]).argmax(axis=1)])[:, None]  # the largest entry is positive
    real = s[:k] > s[0] * len(s) * np.finfo(float).eps
    roots = np.sqrt(np.where(real, e[:k], 1.0))
    return Whitening(c, np.where(real[:, None], right / roots[:, None], 0.0).T, e[:k], np.where(real, e[:k] / max(e.sum(), 1e-300), 0.0))


_MOMENTS = "i int, j int, total double"


def identity_error(vectors: DataFrame, w: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, over components with variance."""
    real = np.flatnonzero(w.explained > 0)
    dims, k = len(w.centre.sums), len(real)
    i, j = np.triu_indices(k)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums = np.zeros((k, k)), np.zeros(k)
        for b in batches:
            y = w.apply(whole_rows(b.column(0), dims)[2].reshape(-1, dims))[:, real]
            products, sums = products + y.T @ y, sums + y.sum(axis=0)
        yield batch(_MOMENTS, [np.concatenate((i, np.full(k, -1))).astype(np.int32), np.concatenate((j, np.arange(k))).astype(np.int32), np.concatenate((products[i, j], sums))])

    found = {(r["i"], r["j"]): r["total"] / w.centre.n for r in vectors.mapInArrow(moments, _MOMENTS).groupBy("i", "j").agg(F.sum("total").alias("total")).collect()}
    return max((abs(found[a, b] - found[-1, a] * found[-1, b] - (a == b)) for a, b in zip(i.tolist(), j.tolist())), default=0.0)


_ROWS = "vec_id long, deviation long, whitened array<double>"


def whiten(table: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row per valid row and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    rows = columns(table, vec_id=(id_col, "long"), vector=(vector_col, "array<double>"))
    vectors = rows.select("vector")
    with scratch(table.sparkSession):  # the tree's factors go
        w = fit_whitening(vectors, components)
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if w is None:
        return table.sparkSession.createDataFrame([], out)
    error, dims = identity_error(vectors, w), len(w.centre.sums)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, BLOCK):
                part = b.slice(a, BLOCK)
                at, _, x = whole_rows(part.column(1), dims)
                x = x.reshape(-1, dims)
                y = w.apply(x)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array(w.centre.deviation(x), pa.int64()), lists], schema=arrow_schema(_ROWS))

    explained = F.array(*(F.lit(float(v)) for v in w.explained))
    each = rows.mapInArrow(project, _ROWS).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return each.select("vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(w.centre.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(explained, F.col("place") + 1).alias("explained"), F.lit(float(error)).alias("identity_error"))

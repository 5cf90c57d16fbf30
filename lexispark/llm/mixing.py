"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Sizes are numbers of words. Sources in code-point order (null last) get weights 5, 2, 1, 5, 2, 1, ... of all words; a
target stops at three times its source's size, and what is over goes to the others by weight. All words are dealt out as
equal blocks: to sources by highest quotients of their targets, then within each source to its shards by highest quotients
of the shards' sizes. A block has BLOCK_WORDS words, or fewer where the smallest target is small: LEAST_BLOCKS of them fit
in it, down to blocks of one word. The last block of a source or shard ends where three times its size does. A shard lays
its documents in a seeded order on a ring of words and takes its quota of consecutive blocks from a seeded place on, whole
rounds first; so few documents are cut.

Defined results: a null text has size 0; a null source is a source of its own; rows that repeat an id are rows of their
own; rows that repeat id, text and source lie side by side on the ring; places that tie are in order of size; a text of any
length is one document, cut at any word; an empty table gives no rows; further columns, whatever their names, are ignored
by mix() and kept by mixed_documents(). A source ends within a block of its target, and a block for each shard that the bound
of three times its size cuts.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, columns, in_rows, materialize, out_of_rows, place_of, repeated

BLOCK_WORDS, LEAST_BLOCKS = 32, 16
#: Documents of a shard, about: what one task holds as two numbers each.
SHARD_ROWS = 2_000
#: Shards of a source that get their blocks together.
GROUP_SHARDS = 1000
#: The driver holds a row for each source, and tasks get them by broadcast; more sources than this are refused.
MAX_SOURCES = 100_000
WEIGHTS = (5, 2, 1)
MOST_TIMES = 3


def targets(sizes: list[int], weights: list[float], most: int = MOST_TIMES) -> list[float]:
    """Shares of sum(sizes) by weight, none above most * its size; the excess goes to the others by weight, again and again."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if unit * weights[i] > most * sizes[i]}
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= most * sizes[i]
        open_ -= full
    return out


def block_words(aims: list[float]) -> int:
    """Words of a block, the same for all sources: the smallest target that isn't 0 has LEAST_BLOCKS of them, if words go so far."""
    return min(BLOCK_WORDS, max(1, int(min((t for t in aims if t > 0), default=0) // LEAST_BLOCKS)))


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by highest quotients votes / (2 k + 1), ties to the earlier, none above `most`.

    The divisor that leaves at most `seats` comes by bisection; only the last few seats are dealt one at a time.
    """
    votes, most = np.asarray(votes, float), np.asarray(most, np.int64)
    seats = int(min(seats, most.sum()))

    def dealt(divisor: float) -> np.ndarray:
        return np.minimum(most, np.floor(votes / divisor + 0.5).astype(np.int64))

    if seats <= 0 or not len(votes):
        return np.zeros(len(votes), np.int64)
    low, high = float(votes[most > 0].min()) / (4.0 * seats + 4) + 1e-12, float(votes.max()) * 4 + 1
    for _ in range(200):
        middle = (low + high) / 2
        if dealt(middle).sum() > seats:
            low = middle
        else:
            high = middle
    out = dealt(high * (1 + 1e-12))
    heap = [(-v / (2 * k + 1), i) for i, (v, k, m) in enumerate(zip(votes.tolist(), out.tolist(), most.tolist())) if k < m]
    heapq.heapify(heap)
    for _ in range(seats - int(out.sum())):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * int(out[i]) + 1), i))
    return out


_QUOTAS = "at long, part long, quota long"


def _quotas(table: pa.Table) -> pa.Table:
    """Blocks of a source, or of a group of its shards, to its parts by highest quotients of their words."""
    order = np.argsort(table.column("part").to_numpy(), kind="stable")
    words, most = (table.column(k).to_numpy()[order] for k in ("words", "most"))
    quota = sainte_lague(words, int(table.column("blocks")[0].as_py()), most)
    return pa.table([table.column("at"), table.column("part").take(pa.array(order)), pa.array(quota)], schema=arrow_schema(_QUOTAS))


_TAKEN = "doc_id long, hash long, its_source string, size long, rows long, source_size long, target double, rounds long, first long, last long, head long"


def _take(table: pa.Table) -> pa.Table:
    """Whole rounds of a shard's ring, then its quota's rest from the seeded place on. Equal rows lie side by side."""
    n = table.num_rows
    size = table.column("size").to_numpy() * table.column("rows").to_numpy()
    order = np.lexsort((size, table.column("place").to_numpy()))
    ends = np.cumsum(size[order])
    words = int(ends[-1])
    rounds, rest = divmod(min(int(table.column("quota")[0].as_py()) * int(table.column("block")[0].as_py()), MOST_TIMES * words), max(1, words))
    start = int(table.column("turn")[0].as_py()) % max(1, words)
    a, b = ends - size[order], ends
    # the rest is [start, start + rest) on a ring: in a document one stretch, or its head too where the ring closes
    cut = lambda x: np.clip(x, a, b) - a
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    parts = [cut(x)[back] for x in (start, start + rest, start + rest - words)]
    same = [table.column(k) for k in ("doc_id", "hash", "its_source", "size", "rows", "source_size", "target")]
    return pa.table([*same, pa.array(np.full(n, rounds)), *map(pa.array, parts)], schema=arrow_schema(_TAKEN))


def _hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _plan(docs: DataFrame, seed: int) -> DataFrame:
    """A row for each distinct doc_id, text (hash) and source of docs (doc_id, text, source), with its number of rows:
    what the mix takes of them, laid side by side: whole rounds, and words [first, last) and [0, head) once more."""
    spark = docs.sparkSession
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    # equal rows are one from here on, so that however many there are they don't make a task of their own
    items = docs.select("doc_id", _hash(F.col("text")).alias("hash"), F.col("source").cast("string").alias("source"), size.alias("size")).groupBy("doc_id", "hash", "source", "size").agg(F.count("*").alias("rows"))
    ledger = materialize(items, "sizes")
    stats = ledger.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("words"), F.count("*").alias("items"))
    found = stats.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["words"] for r in found]
    aims = targets(sizes, [float(WEIGHTS[i % len(WEIGHTS)]) for i in range(len(found))])
    block = block_words(aims)
    blocks = sainte_lague(np.array(aims), round(sum(sizes) / block), np.array([-(-MOST_TIMES * s // block) for s in sizes], np.int64)) if found else []
    rows = [(i, r["source"], r["words"], float(t), int(b), max(1, -(-r["items"] // SHARD_ROWS))) for i, (r, t, b) in enumerate(zip(found, aims, blocks))]
    plan = spark.createDataFrame(rows, "at long, its_source string, source_size long, target double, blocks long, shards long")
    placed = ledger.join(F.broadcast(plan), ledger["source"].eqNullSafe(plan["its_source"])).select(
        "doc_id", "hash", "its_source", "size", "rows", "at", "source_size", "target", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "hash"), F.col("shards")).alias("shard"), F.xxhash64(F.lit(seed + 1), "doc_id", "hash").alias("place")
    )
    # blocks go to groups of shards, then to the shards of each: no task gets all shards of a source
    shards = materialize(placed.groupBy("at", "shard").agg(F.sum(F.col("size") * F.col("rows")).alias("words")).select("at", "shard", F.expr(f"shard div {GROUP_SHARDS}").alias("part"), "words", F.expr(f"({MOST_TIMES} * words + {block - 1}) div {block}").alias("most")), "shards")
    of_source = F.broadcast(plan.select("at", "blocks"))
    groups = shards.groupBy("at", "part").agg(F.sum("words").alias("words"), F.sum("most").alias("most")).join(of_source, "at").groupBy("at").applyInArrow(_quotas, _QUOTAS)
    own = shards.join(groups, ["at", "part"]).select("at", F.col("part").alias("group"), F.col("shard").alias("part"), "words", "most", F.col("quota").alias("blocks"))
    quotas = materialize(own.groupBy("at", "group").applyInArrow(_quotas, _QUOTAS).withColumnRenamed("part", "shard"), "quotas")
    turn = F.abs(F.xxhash64(F.lit(seed + 2), "at", "shard") % (1 << 40)).alias("turn")
    return placed.join(quotas, ["at", "shard"]).select("*", turn, F.lit(block).alias("block")).groupBy("at", "shard").applyInArrow(_take, _TAKEN)


def _of_row(nth: Column) -> list[Column]:
    """Of equal rows side by side, what is taken of the nth: rounds, part_from, part_to, part2_to, taken."""
    begin = nth * F.col("size")
    cut = lambda name: F.least(F.greatest(F.col(name) - begin, F.lit(0)), F.col("size"))
    taken = F.col("rounds") * F.col("size") + cut("last") - cut("first") + cut("head")
    return [F.col("rounds"), cut("first").alias("part_from"), cut("last").alias("part_to"), cut("head").alias("part2_to"), taken.alias("taken")]


def mix(docs: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken; and how it is taken: rounds (whole copies), then
    words [part_from, part_to) and [0, part2_to) once more; hash tells rows of one id apart. Reruns agree."""
    plan = _plan(columns(docs, doc_id=(id_col, "long"), text=(text_col, None), source=(source_col, None)), seed)
    return repeated(plan, "rows", "nth").select("doc_id", "hash", "size", "source_size", "target", *_of_row(F.col("nth")))


def mixed_documents(docs: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as the mix takes them, with their columns: a whole copy for each round, and one row with the words of its part.

    Of rows that repeat id, text and source, the further columns are those of one of them.
    """
    named = dict(doc_id=(id_col, "long"), text=(text_col, None), source=(source_col, "string"))
    plan = materialize(_plan(columns(docs, **named), seed).filter("rounds > 0 OR last > first OR head > 0").withColumnsRenamed({"doc_id": "plan_id", "hash": "plan_hash"}), "plan")
    rows = in_rows(docs, **named).withColumn("hash", _hash(F.col("text"))).drop("text")
    of = F.col("doc_id").eqNullSafe(F.col("plan_id")) & (F.col("hash") == F.col("plan_hash")) & F.col("source").eqNullSafe(F.col("its_source"))
    joined = rows.join(plan, of)
    taken = joined.filter("rows = 1").withColumn("nth", F.lit(0).cast("long"))
    if plan.filter("rows > 1").limit(1).count():  # the rows are read, and shuffled, a second time only if some are equal
        taken = taken.unionByName(repeated(joined.filter("rows > 1").dropDuplicates(["doc_id", "hash", "source"]), "rows", "nth"))
    taken = taken.select("row", "size", *_of_row(F.col("nth"))).filter("taken > 0")
    at = place_of(docs, text_col)
    text = F.col("row")[f"c{at}"]
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    pick = F.concat(F.slice(words, F.lit(1), F.col("part2_to").cast("int")), F.slice(words, (F.col("part_from") + 1).cast("int"), (F.col("part_to") - F.col("part_from")).cast("int")))
    whole = (F.col("part_to") - F.col("part_from") + F.col("part2_to")) >= F.col("size")
    some = (F.col("part_to") > F.col("part_from")) | (F.col("part2_to") > 0)
    copies = F.concat(F.array_repeat(F.lit(False), F.col("rounds").cast("int")), F.when(some, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))
    part = F.when(F.col("is_part") & ~whole, F.array_join(pick, " ")).otherwise(text)
    out = taken.withColumn("is_part", F.explode(copies)).withColumn("row", F.col("row").withField(f"c{at}", part))
    return out_of_rows(out, docs.columns)

"""Registered queries over a store of sentences by resource: scans that skip partitions, and the chain that brings a store up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import new_path
from ..operators import match as M
from ..operators import reports as R
from ..operators import rescan as C
from ..operators import snapshots as S
from ..operators import store as ST
from ..registry import register
from .corpus import _KEY, _TOK, MATCHES, OCC, SENTENCES, TARGETS_SQL, _with, targets

# --- partitions that a scan skips -------------------------------------------------------------------------------------

_RESOURCE = "coalesce(source, 'none') || '#' || coalesce(lang, 'none')"
_FINE = SENTENCES.replace("SELECT source AS resource_id, d.doc_id", f"SELECT {_RESOURCE} AS resource_id, d.doc_id")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a resource for each source and language."""
    part = lambda c: F.coalesce(c, F.lit("none"))
    return spark.read.parquet(f"{sf}/documents.parquet").withColumn("resource_id", F.concat_ws("#", part("source"), part("lang")))


def document_marks(docs: DataFrame) -> dict[str | None, str]:
    """Fingerprints by resource: rows, and a sum over digests of ids and texts that doesn't depend on their order."""
    one = F.xxhash64("doc_id", "text").cast("decimal(38,0)")
    found = docs.groupBy("resource_id").agg(F.count("*").alias("n"), F.sum(one).alias("s")).select("resource_id", F.md5(F.concat_ws("|", F.col("n").cast("string"), F.col("s").cast("string"))).alias("fingerprint"))
    return {r["resource_id"]: r["fingerprint"] for r in found.collect()}


def stored_sentences(spark: SparkSession, sf: str) -> S.Snapshot:
    docs = documents(spark, sf)
    rows = M.sentences(docs, "resource_id", spark.read.parquet(f"{sf}/labels.parquet"))
    marks = document_marks(docs)
    return S.update(spark, new_path(spark, "partitions"), {"rows": (rows, marks), "tokens": (R.token_inventory(rows), marks)})


def rare_tokens(inventory: DataFrame, most: int = 3) -> DataFrame:
    """The first tokens, by length and then code points, that a single partition has."""
    alone = inventory.groupBy("token").agg(F.count("*").alias("n"), F.char_length("token").alias("size")).filter("n = 1")
    return alone.orderBy(F.desc("size"), "token").limit(most).select("token")


def scan_rare(spark: SparkSession, found: S.Snapshot) -> DataFrame:
    """Sentences with a token that one partition alone has: the others' folders aren't read."""
    inventory = found.read(spark, "tokens")
    wanted = rare_tokens(inventory)
    rows = R.scan_partitions(found.read(spark, "rows"), inventory, wanted)
    return M.phrase_match(rows.select(*M.KEY, "norm"), wanted.withColumnRenamed("token", "pattern")).groupBy("pattern", "resource_id").agg(F.count("*").alias("matches"))


@register("set_inventory_skip_scan", f"""{_with(_FINE)}, t AS (SELECT resource_id, unnest({_TOK}) AS token FROM sentences),
    wanted AS (SELECT token FROM t GROUP BY 1 HAVING count(DISTINCT resource_id) = 1 ORDER BY length(token) DESC, token LIMIT 3)
    SELECT token AS pattern, resource_id, count(*) AS matches FROM t WHERE token IN (SELECT token FROM wanted) GROUP BY 1, 2""")
def _(spark, sf):
    return scan_rare(spark, stored_sentences(spark, sf))


# --- the chain --------------------------------------------------------------------------------------------------------

#: What a full rescan does, in its order: forms to search for, sentences and their inventories, occurrences, reports, examples.
CHAIN = [
    C.Stage("patterns", ("targets",), M.target_patterns, whole=True),
    C.Stage("sentences", ("documents", "labels"), lambda docs, labels: M.sentences(docs, "resource_id", labels)),
    C.Stage("tokens", ("sentences",), R.token_inventory),
    C.Stage("hits", ("sentences", "patterns"), lambda rows, patterns: R.target_hits(M.phrase_match(rows.select(*M.KEY, "norm"), patterns))),
    C.Stage("occurrences", ("sentences", "patterns"), M.occurrences),
    C.Stage("retained", ("occurrences",), M.retain, whole=True),
    C.Stage("coverage", ("targets", "retained"), lambda t, kept: R.coverage(t, kept).select("target_id", "hit"), whole=True),
    C.Stage("raw_coverage", ("targets", "hits", "retained"), lambda t, hits, kept: R.raw_coverage(t, hits, kept, "mood"), whole=True),
    C.Stage("static_examples", ("retained", "targets"), ST.static_examples, whole=True),
]


def chain_sources(spark: SparkSession, sf: str, docs: DataFrame) -> dict[str, C.Source]:
    labels, t = spark.read.parquet(f"{sf}/labels.parquet"), targets(spark)
    of_all = lambda df: {None: df.agg(F.md5(F.concat_ws("|", F.count("*").cast("string"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string")))).first()[0]}
    return {"documents": C.Source(docs, document_marks(docs)), "labels": C.Source(labels, of_all(labels), whole=True), "targets": C.Source(t, of_all(t), whole=True)}


def one_changed(docs: DataFrame) -> DataFrame:
    """docs with other texts in the first of their resources."""
    first = docs.agg(F.min("resource_id")).first()[0]
    return docs.withColumn("text", F.when(F.col("resource_id") == first, F.concat(F.coalesce("text", F.lit("")), F.lit(". Und der the end of the day"))).otherwise(F.col("text")))


_CHANGED = SENTENCES.replace("SELECT source AS resource_id, d.doc_id", "SELECT resource_id, d.doc_id").replace("FROM documents d", "FROM changed d")
_ALL_CHANGED = _with(
    f"named AS (SELECT *, {_RESOURCE} AS resource_id FROM documents)",
    "changed AS (SELECT * REPLACE (CASE WHEN resource_id = (SELECT min(resource_id) FROM named) THEN coalesce(text, '') || '. Und der the end of the day' ELSE text END AS text) FROM named)",
    _CHANGED, TARGETS_SQL, MATCHES, OCC,
)


@register("cmd_rescan", f"""{_ALL_CHANGED}, k AS (SELECT count(DISTINCT resource_id) AS n FROM named),
    tok AS (SELECT DISTINCT resource_id, unnest({_TOK}) AS token FROM sentences),
    ex AS (SELECT row_number() OVER (PARTITION BY verb_id, target_key, signature ORDER BY score DESC, length(sentence), {_KEY}) AS nth FROM retained JOIN targets USING (target_id))
    SELECT 'patterns' AS stage, 1 AS first, 0 AS again, (SELECT count(*) FROM patterns) AS rows
    UNION ALL SELECT 'sentences', n, 1, (SELECT count(*) FROM sentences) FROM k UNION ALL SELECT 'tokens', n, 1, (SELECT count(*) FROM tok) FROM k
    UNION ALL SELECT 'hits', n, 1, (SELECT count(*) FROM (SELECT DISTINCT resource_id, target_id FROM matches)) FROM k UNION ALL SELECT 'occurrences', n, 1, (SELECT count(*) FROM occ) FROM k
    UNION ALL SELECT 'retained', 1, 1, (SELECT count(*) FROM retained) UNION ALL SELECT 'coverage', 1, 1, (SELECT count(*) FROM targets)
    UNION ALL SELECT 'raw_coverage', 1, 1, (SELECT count(DISTINCT mood) FROM targets) UNION ALL SELECT 'static_examples', 1, 1, (SELECT count(*) FROM ex WHERE nth <= 3)""")
def _(spark, sf):
    path, docs = new_path(spark, "chain"), documents(spark, sf)
    first = C.run(spark, path, CHAIN, chain_sources(spark, sf, docs))
    again = C.run(spark, path, CHAIN, chain_sources(spark, sf, one_changed(docs)))  # one resource differs: its parts and what lies behind them
    written = spark.createDataFrame([(a.stage, len(a.written), len(b.written)) for a, b in zip(first, again)], "stage string, first long, again long")
    now = S.snapshot(spark, path)
    counts = [now.read(spark, s.name).agg(F.count("*").alias("rows")).select(F.lit(s.name).alias("stage"), "rows") for s in CHAIN]
    rows = counts[0]
    for x in counts[1:]:
        rows = rows.unionByName(x)
    return written.join(rows, "stage")

"""Every registered query with SQL against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from lexispark import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, float):  # also whole numbers of a column with nulls
        return int(v) if v == int(v) else round(float(v), 6)
    return v.item() if hasattr(v, "item") else v


def rows(df):
    return sorted(repr([plain(v) for v in r]) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_duckdb(spark, duck, name):
    found, want = registry.queries()[name](spark, SF).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(want.columns)
    assert rows(found) == rows(want)


def test_matcher_by_shuffle(spark, monkeypatch):
    """Patterns too large to send to every task: the same matches."""
    from lexispark.operators import match as M
    from lexispark.plans import corpus as C

    rows, patterns = C.scanned(spark, SF), C.patterns(spark)
    rows = rows.unionByName(rows.limit(20))  # sentences that repeat
    key = ["target_id", "variant_kind", "pattern", "resource_id", "doc_id", "position", "end", "sentence"]
    want = M.phrase_match(rows, patterns).groupBy(*key).count().collect()
    monkeypatch.setattr(M, "BROADCAST_BYTES", 0)
    for frequent in (2000, 1):  # most tokens are frequent, and their slices salted; or none is
        monkeypatch.setattr(M, "FREQUENT", frequent)
        found = M.phrase_match(rows, patterns)
        assert sorted(map(str, found.groupBy(*key).count().collect())) == sorted(map(str, want)) and len(want) > 100
    monkeypatch.setattr(M, "BROADCAST_BYTES", 3000)  # only the few patterns of frequent tokens go to every task
    monkeypatch.setattr(M, "FREQUENT", 50)
    found = M.phrase_match(rows, patterns)
    assert sorted(map(str, found.groupBy(*key).count().collect())) == sorted(map(str, want))
    assert M.phrase_match(rows, patterns.limit(0)).count() == 0 and M._by_shuffle(rows.limit(0), patterns, "norm").count() == 0 and M._by_shuffle(rows, patterns.limit(0), "norm").count() == 0


def test_anchors_are_rare_and_slices_few(spark, monkeypatch):
    """Many patterns, "the" and its pairs among them: equal to the tree's matches; a pattern stands at its rarest token."""
    from pyspark.sql import functions as F

    from lexispark.operators import match as M
    from lexispark.plans import corpus as C

    rows = C.scanned(spark, SF).select("doc_id", "position", "norm")
    grams = rows.withColumn("t", F.split("norm", " ")).select(F.explode(M.ngrams("t", [1, 2, 3, 4])).alias("g")).select(F.col("g.gram").alias("pattern")).distinct()
    patterns = grams.filter(F.pmod(F.xxhash64("pattern"), F.lit(5)) == 0).unionByName(spark.createDataFrame([("the",), ("of the",), ("the the",)], "pattern string")).distinct()
    patterns = patterns.cache()
    ready = {r["pattern"]: r for r in M.anchored_patterns(rows, patterns).collect()}
    counts = {r["token"]: r["count"] for r in rows.select(F.explode(F.split("norm", " ")).alias("token")).groupBy("token").count().collect()}
    assert len(ready) == patterns.count() > 3000
    for p, r in ready.items():
        words = p.split(" ")
        assert r["held"] == counts[r["anchor"]] == min(counts[w] for w in words) and words[r["place"]] == r["anchor"] and r["n"] == len(words)
    want = M.phrase_match(rows, patterns).groupBy("pattern", "doc_id", "position", "end").count().collect()
    monkeypatch.setattr(M, "BROADCAST_BYTES", 9000)
    assert M.matched_rows(rows, patterns) is None
    found = M.phrase_match(rows, patterns).groupBy("pattern", "doc_id", "position", "end").count().collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, want))


def test_matcher_literals(spark):
    from pyspark.sql import functions as F

    from lexispark.functions import text as T
    from lexispark.operators import match as M

    targets = spark.createDataFrame([("a", ["punoj"]), ("b", ["të", "punoj"]), ("c", ["mos", "të", "punoj"]), ("d", ["nuk", "punoj"]), ("e", ["të", "çoj"]), ("f", ["ha", "ha"])], "target_id string, tokens array<string>")
    texts = spark.createDataFrame([(1, "Ai TË punoj, pastaj punoj."), (2, "Vendosa të mos punoj sot."), (3, "Unë s'punoj sot."), (4, "Dua te coj letren."), (5, "ha ha ha"), (6, "A_12 + b-34"), (7, "Unë s punoj")], "n int, sentence string")
    rows = texts.withColumn("norm", T.normalized(F.col("sentence")))
    assert rows.filter("n = 6").first()["norm"] == "a_12 b 34"
    hits = M.phrase_match(rows, M.target_patterns(targets)).filter(M.apostrophe_guard(F.col("variant_kind"), F.col("sentence")))
    found = sorted((r["n"], r["target_id"], r["variant_kind"]) for r in hits.collect())
    assert found == [(1, "a", "canonical"), (1, "a", "canonical"), (1, "b", "canonical"), (2, "a", "canonical"), (2, "c", "te_mos_order"), (3, "a", "canonical"), (3, "d", "s_negative"), (4, "e", "diacritic_fold"), (5, "f", "canonical"), (5, "f", "canonical"), (7, "a", "canonical")]


def test_pattern_counts(spark):
    """Counts of patterns equal those of the matcher's rows; patterns with a token that no sentence has are left out before."""
    from pyspark.sql import functions as F

    from lexispark.operators import match as M
    from lexispark.plans import corpus as C

    rows = C.scanned(spark, SF).select("norm", (F.col("position") % 2 == 0).alias("keep"))
    asked = [("the",), ("of the",), ("the the",), ("in the",), ("the",), ("nosuchtoken",), ("the nosuchtoken",), ("",)]
    patterns, tokens = spark.createDataFrame(asked, "pattern string"), M.token_counts(rows)
    left = M.possible(patterns, tokens)
    assert {r["pattern"] for r in left.collect()} == {"the", "of the", "the the", "in the"}
    want = M.phrase_match(rows, patterns.distinct()).groupBy("pattern").agg(F.count("*").alias("raw"), F.count_if("keep").alias("kept")).collect()
    assert sorted(map(tuple, M.pattern_counts(rows, left, tokens).select("pattern", "raw", "kept").collect())) == sorted(map(tuple, want)) and len(want) > 2


def test_forms_are_not_shuffled_for_evidence(spark):
    """Audited targets get their evidence without a shuffle of all forms: few keys may occur, and a table of targets holds what can't be derived."""
    from pathlib import Path
    from urllib.parse import unquote, urlparse

    from lexispark.plans import audit, corpus
    from lexispark.plans.lexicon import forms

    corpus._STORE.clear()
    t = audit.targets(spark, SF)
    assert t.count() == forms(spark, SF).filter("modality = 'declarative' AND form IS NOT NULL").count()
    stored = {k[1]: d for k, d in corpus._STORE.items() if k[0] == spark.sparkContext.applicationId}
    assert "sentences" not in stored and stored["form keys"].count() * 10 < t.count()
    size = sum(Path(unquote(urlparse(f).path)).stat().st_size for f in stored["audit targets"].inputFiles())
    assert size < 30 * t.count()  # 90 bytes and more with digests and ids


def test_forms_are_not_stored(spark):
    """Audited targets are stored as their verbs, a row each; reports by verb shuffle no forms, and reports without evidence read no sentence."""
    import __spark_entry__
    from lexispark.plans import audit, corpus
    from lexispark.plans.lexicon import lexicon

    names = lambda: {k[1]: d for k, d in corpus._STORE.items() if k[0] == spark.sparkContext.applicationId}
    corpus._STORE.clear()
    query = __spark_entry__.queries()
    assert query["flt_voice_shape"](spark, SF).count() > 0 and set(names()) == {"lexicon"}
    assert query["agg_review_coverage"](spark, SF).count() > 0
    assert names()["audit targets"].count() == lexicon(spark, SF).count()
    plan = audit.targets(spark, SF).groupBy("verb_id").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan


def test_texts_are_not_shuffled_for_labels(spark, monkeypatch):
    """Labels beyond Spark's limit for broadcasts go to every task, up to a limit of their own, and give the same rows as a shuffle."""
    from lexispark.operators import match as M

    documents, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        sent = M.sentences(documents, labels=labels)
        assert "BroadcastHashJoin" in sent._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(M, "LABEL_ROWS", 10)
        met = M.sentences(documents, labels=labels)
        assert "SortMergeJoin" in met._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, sent.collect())) == sorted(map(str, met.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

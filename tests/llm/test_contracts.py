"""The opN_ queries' own columns against brute force, small sources, many rules, and names that clash."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.llm import chat, crf, langid, mixing, queries, secret_scan

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def mixed_sums(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.mix(docs).toPandas()
    assert (plan.taken <= 3 * plan["size"]).all() and len(plan) == len(rows)
    source = {i: s for i, _, s in rows}
    by = plan.assign(s=plan.doc_id.map(source)).groupby("s").agg(taken=("taken", "sum"), target=("target", "max"), n=("source_size", "max"))
    words = mixing.mixed_documents(docs).select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] or 0
    assert words == plan.taken.sum()
    return by, plan


def test_small_sources_are_mixed(spark):
    """Sources of 10 words each, 100 of 20 words, of a single word, and of 1 to 40 words beside large ones: nothing is lost."""
    by, plan = mixed_sums(spark, [(i, " ".join(f"w{k}" for k in range(10)), f"s{i:02}") for i in range(40)])
    assert plan.taken.sum() == 400 and ((by.taken - by.target).abs() <= 1).all()
    by, plan = mixed_sums(spark, [(i, " ".join(f"w{k}" for k in range(20)), f"s{i:03}") for i in range(100)])
    assert plan.taken.sum() == 2000 and ((by.taken - by.target).abs() <= 1).all()
    by, plan = mixed_sums(spark, [(i, "one", f"s{i:02}") for i in range(9)])
    assert plan.taken.sum() == 9 and ((by.taken - by.target).abs() <= 1).all()
    rows = [(i, " ".join(["w"] * (i % 40 + 1)), f"s{i:02}") for i in range(80)] + [(1000 + i, " ".join(["w"] * (i % 700)), f"big{i % 3}") for i in range(900)]
    by, plan = mixed_sums(spark, rows)
    total = sum(len(t.split()) for _, t, _ in rows)
    assert abs(plan.taken.sum() - total) <= 2 and ((by.taken - by.target).abs() <= 1).all()


def test_blocks_fit_the_smallest_target():
    assert mixing.block_words([1e6, 1e5]) == 32 and mixing.block_words([1e6, 170.0, 0.0]) == 10 and mixing.block_words([0.2]) == 1 and mixing.block_words([]) == 1


def brute_secrets(text):
    found = []
    for kind, pattern, least, group, flags in (
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, re.I | re.A), ("access", r"AKIA[A-Z0-9]+", 18, 0, 0), ("hex", r"[0-9a-f]+", 16, 0, 0),
    ):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    order = ["assign", "access", "hex"]
    return sorted(found, key=lambda x: (x[0], order.index(x[1])))


def test_secret_query_columns(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = queries.op8_trigram_secret_scan(spark, sf).collect()
    assert len(found) == len(texts)
    for r in found:
        want = brute_secrets(texts[r["doc_id"]])
        spans = [f"{k}:{a}:{z}" for a, k, z in want]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for _, k, _ in want) for x in ("assign", "access", "hex")]
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s.split(":")[0] in ("assign", "access", "hex")] == spans
    assert sum(r["n_assign"] + r["n_access"] + r["n_hex"] > 0 for r in found) > 3


def test_two_hundred_rules(spark):
    """More rules than a number has bits, and more trigrams than 16 bits can count."""
    rules = tuple(secret_scan.Rule(f"r{i}", f"key{i:03}[a-z]+") for i in range(198)) + (secret_scan.Rule("any", "[0-9]{4}"), secret_scan.Rule("last", "zq[xy]w"))
    texts = [f"key{i:03}abc and key{(i * 7) % 198:03}z " + "zqyw " * (i % 5 == 0) + "2024" * (i % 3 == 0) for i in range(250)] + ["nothing", None]
    found = secret_scan.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), rules).collect()
    for r in found:
        want = sorted((m.start(), k, m.end()) for k, x in enumerate(rules) for m in x.compiled().finditer(texts[r["doc_id"]] or ""))
        assert list(zip(r["starts"], r["kinds"], r["ends"])) == [(a, rules[k].kind, z) for a, k, z in want]
    assert len(found) == 252 and {k for r in found for k in r["kinds"]} == {r.kind for r in rules}
    letters = "abcdefghijklmnopqrstuvwxyz0123456789-_%@~"
    many = tuple(secret_scan.Rule(f"m{a}{b}", re.escape(a + b) + f"[{re.escape(letters[:16])}]") for a in letters for b in letters) + tuple(secret_scan.Rule(f"n{a}{b}", re.escape(a + b) + f"[{re.escape(letters[16:32])}]") for a in letters for b in letters)
    table = secret_scan._prepared(many)[2]
    assert (table.dtype == np.uint16) == (len(secret_scan._prepared(many)[1]) < 1 << 16) and table.max() == len(secret_scan._prepared(many)[1])


def test_language_query_columns(spark):
    found = {r["doc_id"]: r for r in queries.op5_segmentation_language_id(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(found) == len(docs)
    langs = {r["lang"] for r in docs if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    for r in docs:
        f = found[r["doc_id"]]
        assert f["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= f["score"] <= 1
        letters = any(c.isalpha() for c in r["text"] or "")
        assert f["lang_pred"] in langs if letters else f["lang_pred"] == "und"


@pytest.fixture
def clashing(spark):
    """Tables with a column that differs from another in case only."""
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        yield docs.withColumn("TEXT", F.lit("x")).withColumn("DOC_ID", F.lit(0)).withColumn("LANG", F.lit("l")).withColumn("__id", F.lit(1))
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_clashing_names(spark, clashing):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    spark.conf.unset("spark.sql.caseSensitive")
    assert crf.fit_field(clashing, labels) == crf.fit_field(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    assert langid.predict_held_out(clashing).count() == clashing.count()
    turns = spark.createDataFrame([(1, 0, "user", "a", "b", 5), (1, 1, "assistant", "c", "d", 6)], ["conv_id", "turn", "role", "text", "x", "y"]).toDF("conv_id", "turn", "role", "text", "TEXT", "TURN")
    assert chat.digest_conversations(chat.format_conversations(turns)).first()["n_turns"] == 2

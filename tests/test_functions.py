"""Functions and samples against plain Python."""

import random
import unicodedata

from pyspark.sql import functions as F

from lexispark.functions import text as T
from lexispark.operators import commands as C


def runs(text):
    """Runs of letters, composed, then in lower case."""
    out, own = [], ""
    for c in text + " ":
        if unicodedata.category(c).startswith("L"):
            own += c
        elif own:
            out.append(unicodedata.normalize("NFC", own).lower())
            own = ""
    return out


def test_search_tokens_are_composed(spark):
    texts = ["\u212bngstr\u00f6m", "e\u0308 te\u0308", "\u1112\u1161\u11ab\u1100\u1173\u11af x", "\u2126 Ohm", "N\u00cb \u00cb\u00c7", "plain Words 7_a", "", "\ufa0a\u4e2d", "\u0958", None]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.search_tokens(F.col("t")).alias("w")).orderBy("i").collect()
    assert [r["w"] for r in found] == [None if t is None else runs(t) for t in texts]
    assert found[0]["w"] == ["\u00e5ngstr\u00f6m"] and found[1]["w"] == ["e", "te"] and found[2]["w"] == ["\ud55c\uae00", "x"]


def plain_dossier(rows, rules, most):
    """Rules in order, each with its caps, until there are enough."""
    taken = {}
    for reason, test, total, group, each in rules:
        seen, mine = {}, []
        for r in sorted(filter(test, rows), key=lambda r: (r["target_key"], r["target_id"])):
            seen[r[group]] = seen.get(r[group], 0) + 1
            if seen[r[group]] <= each:
                mine.append(r)
        for r in mine[:total]:
            if len(taken) >= most:
                break
            taken.setdefault(r["target_id"], []).append(reason)
    return taken


def test_dossier_in_one_plan(spark):
    random.seed(8)
    rows = [{"target_id": f"t{i:03}", "target_key": f"k{random.randrange(40):02}", "verb_id": random.choice(["a", "b", "c", None]), "n": random.randrange(100)} for i in range(200)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "target_id string, target_key string, verb_id string, n int")
    tests = [("one", lambda r: r["n"] < 60, F.col("n") < 60, 30, 9), ("two", lambda r: r["n"] % 3 == 0, F.col("n") % 3 == 0, 12, 20), ("three", lambda r: r["n"] > 20, F.col("n") > 20, 50, 2), ("none", lambda r: False, F.lit(False), 5, 5)]
    for most in (500, 40, 31, 7, 1):
        want = plain_dossier(rows, [(name, test, total, "verb_id", each) for name, test, _, total, each in tests], most)
        found = C.sample_dossier(df, [(name, condition, total, "verb_id", each) for name, _, condition, total, each in tests], most)
        assert {r["target_id"]: r["reasons"] for r in found.collect()} == want


def test_kept_is_what_the_flags_say(spark):
    from lexispark.functions import text as T
    from lexispark.plans import corpus as C

    s = [F.col("sentence"), F.col("norm"), F.col("quality")]
    both = C.scanned(spark, "/root/testdata/sf0.001").select(T.kept(*s).alias("kept"), T.keep_sentence(T.quality_flags(*s)).alias("flags"))
    found = {tuple(r[:2]): r["count"] for r in both.groupBy("kept", "flags").count().collect()}
    assert set(found) == {(True, True), (False, False)}

"""Steps that grew too fast, each against what it did before."""

from pyspark.sql import functions as F

from lexispark.functions import morphology as MO
from lexispark.functions import text as T
from lexispark.operators import match as M
from lexispark.operators import search_index as I
from lexispark.plans import corpus as C
from lexispark.plans import corpus_reports  # noqa: F401
from lexispark.registry import queries

SF = "/root/testdata/sf0.001"


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_of_a_form_are_split_once(spark):
    """they were split again for each ending that was tried."""
    rows = [("do të kem punuar", "indicative", "future-perfect", "1sg", "active"), ("punojmë", "indicative", "present", "1pl", "active"), ("u lava", "indicative", "aorist", "1sg", "middle-passive"), ("duke larë", "non-finite", "gerund", None, None), (None, "indicative", "present", "1sg", "active")]
    d = MO.with_segments(spark.createDataFrame(rows, "form string, mood string, tense string, cell string, voice string"))
    shown = d._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("split(form") == 1
    found = {r["form"]: r["segments"] and [tuple(s) for s in r["segments"]] for r in d.collect()}
    assert found["do të kem punuar"] == [("do", "particle"), ("të", "particle"), ("kem", "auxiliary"), ("punuar", "stem")]
    assert found["punojmë"] == [("puno", "stem"), ("jmë", "ending")] and found["u lava"] == [("u", "voice-marker"), ("la", "stem"), ("va", "ending")]
    assert found["duke larë"] == [("duke", "particle"), ("larë", "stem")] and found[None] is None


def test_adult_words_are_looked_up_in_the_norm(spark):
    """F29, F35, F38, F42-F44: every sentence was normalised once more for its flags."""
    texts = ["A seks b", "SEKS", "seksi1", "seks-i", "Seksualitet x", "x_seks", "SEKSİ", "rrip-në", "arrip-në", "rrip-nën", "porno", "xpornox", "anal", "banal", "a fetish", "", "Grammar.", "grammars", "1grammar2", "igrammar", "koha  e", "veta e.", "ëveta e"]
    d = spark.createDataFrame([(t,) for t in texts], "s string").withColumn("n", T.normalized(F.col("s")))
    found = d.select("s", T.adult_or_spam(F.col("s"), F.col("n")).alias("a"), T.adult_or_spam(F.col("s")).alias("b"), T.reference_prose(F.col("s")).alias("r")).collect()
    adult = {"A seks b", "SEKS", "seks-i", "Seksualitet x", "SEKSİ", "rrip-në", "porno", "xpornox", "anal", "a fetish"}
    assert {r["s"] for r in found if r["a"]} == adult and {r["s"] for r in found if r["b"]} == adult
    assert {r["s"] for r in found if r["r"]} == {"Grammar.", "1grammar2", "veta e."}


def test_texts_of_retained_hits_are_not_shuffled(spark):
    """sentences were shuffled for a few hits wherever Spark took these for many."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = C.scanned(spark, SF)
        hits = rows.select(*M.KEY).limit(7).withColumn("target_id", F.lit("t"))
        found = M.with_text(hits, rows.select(*M.KEY, "sentence"))
        assert "SortMergeJoin" not in planned(found).split("Scan")[0] and "BroadcastHashJoin" in planned(found) and found.count() == 7
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sentences_are_made_once_for_the_index(spark, tmp_path):
    """they were made for a count, for a sample of ranges, and for the postings."""
    seen = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([("r", i, 1, f"of the w{i % 7}") for i in range(500)], "resource_id string, doc_id long, position int, norm string").repartition(4)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    I.build_index(rows.mapInArrow(counted, rows.schema), f"file://{tmp_path}/i", buckets=8, chunk_documents=20, documents=500)
    assert seen.value == 500
    assert I.search_phrase(spark, f"file://{tmp_path}/i", ["of", "the"], buckets=8).count() == 500


def test_gaps_make_no_occurrences(spark, monkeypatch):
    """occurrences were made and stored for a column that isn't returned."""
    monkeypatch.setattr(C, "_STORE", {})
    assert queries()["topk_raw_gaps"](spark, SF).count() == 3
    assert "occurrences" not in {k[1] for k in C._STORE}


def test_pieces_are_placed_without_python(spark):
    """pipeline: all ids went through Python once more, only for their pieces to get a place."""
    from collections import defaultdict

    from lexispark.llm import packing

    docs = spark.createDataFrame([(None if k == 7 else k, "word " * (k * 37 % 900) + "end" * (k % 3)) for k in range(600)] + [(3, None), (3, "")], "doc_id long, text string").repartition(5)
    found = packing.pack(docs)
    assert "MapInArrow" not in planned(found)
    rows, held = found.collect(), defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"]
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in held.values():  # gapless, within a sequence
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= packing.SEQUENCE
    assert sorted(held) == list(range(len(held)))
    by_length = defaultdict(int)
    for r in rows:
        by_length[r["length"]] += 1
    assert len(held) == sum(n for _, n in packing.pack_histogram(by_length))


def test_batches_of_a_write_are_small(spark):
    """pipeline: texts went to the tokenizer 10,000 rows at a time."""
    from lexispark.llm.common import batches_of

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def sizes():
        return max(r["n"] for r in spark.range(0, 9000, 1, 1).mapInArrow(counted, "n long").collect())

    def counted(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    with batches_of(spark, 1000):
        assert sizes() <= 1000
    assert spark.conf.get(name) == before and sizes() > 1000

"""Snapshots, scans that skip, the chain of stages and the kept index: crashes at every step, what is read, and rows against plain ways."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.cluster import new_path
from lexispark.operators import match as M
from lexispark.operators import reports as R
from lexispark.operators import rescan as C
from lexispark.operators import search_index as I
from lexispark.operators import snapshots as S
from lexispark.operators import store as ST
from lexispark.plans import scans

SF = "/root/testdata/sf0.001"


def table(spark, **rows):
    return spark.createDataFrame([(r, i) for r, n in rows.items() for i in range(n)] or [("none", 0)], "resource_id string, i int")


def content(spark, path, name):
    found = S.snapshot(spark, path)
    return sorted((r["resource_id"], r["i"]) for r in found.read(spark, name).collect())


class Stopped(Exception):
    pass


def test_snapshots_write_what_is_stale(spark):
    path = new_path(spark, "s")
    S.update(spark, path, {"t": (table(spark, a=2, b=1), {"a": "1", "b": "1"})})
    folders = {k: v[0] for k, v in S.snapshot(spark, path).tables["t"].parts.items()}
    old = S.snapshot(spark, path)
    S.update(spark, path, {"t": (table(spark, a=9, b=3), {"a": "1", "b": "2"})})  # only b is stale
    now = S.snapshot(spark, path)
    assert content(spark, path, "t") == [("a", 0), ("a", 1), ("b", 0), ("b", 1), ("b", 2)]
    assert now.tables["t"].parts["a"][0] == folders["a"] and now.tables["t"].parts["b"][0] != folders["b"]
    assert old.read(spark, "t").count() == 3 and S.snapshot(spark, path, 1).read(spark, "t").count() == 3  # readers keep theirs
    S.update(spark, path, {"t": (table(spark, c=1), {"c": "1", "empty": "1"})}, replace_all=True)
    assert content(spark, path, "t") == [("c", 0)] and S.snapshot(spark, path).tables["t"].parts["empty"] == (None, "1")
    assert S.vacuum(spark, path, keep=1) == 2 and content(spark, path, "t") == [("c", 0)]
    odd = spark.createDataFrame([("a/b=c%#é ", 1), (None, 2), ("7", 3)], "resource_id string, i int")
    S.update(spark, path, {"o": (odd, {"a/b=c%#é ": "x", None: "x", "7": "x"})})
    assert sorted(S.snapshot(spark, path).read(spark, "o").collect(), key=str) == sorted(odd.collect(), key=str)
    assert S.snapshot(spark, path).read(spark, "o").filter(S.of_resources(F.col("resource_id"), {None, "7"})).count() == 2
    with pytest.raises(ValueError, match="needs a name"):
        S.update(spark, path, {"o": (odd, {"": "x"})})


def test_a_stopped_writer_leaves_the_snapshot_before(spark, monkeypatch):
    path, marks = new_path(spark, "s"), {"a": "1", "b": "1"}
    S.update(spark, path, {"rows": (table(spark, a=2, b=1), marks), "tokens": (table(spark, a=1, b=1), marks)})
    want = content(spark, path, "rows"), content(spark, path, "tokens")
    new = {"rows": (table(spark, a=5, b=5), {"a": "2", "b": "2"}), "tokens": (table(spark, a=4, b=4), {"a": "2", "b": "2"})}

    def stopped_at(step):
        with monkeypatch.context() as m:
            write, commit = S.write_table, S.commit
            calls = []

            def counted(*a, **b):
                out = write(*a, **b)
                calls.append(1)
                if len(calls) == step:
                    raise Stopped
                return out

            m.setattr(S, "write_table", counted)
            if step == 3:
                m.setattr(S, "commit", lambda *a: (_ for _ in ()).throw(Stopped))
            with pytest.raises(Stopped):
                S.update(spark, path, new)
            assert commit

    for step in (1, 2, 3):  # after the first table, after the second, before the manifest
        stopped_at(step)
        assert (content(spark, path, "rows"), content(spark, path, "tokens")) == want
    # a manifest that was cut short is none
    fs, target = S._fs(spark, f"{path}/_manifests/{S._manifest(2)}")
    out = fs.create(target, False)
    out.write(bytearray(b'{"version": 2, "tables"'))
    out.close()
    assert (content(spark, path, "rows"), content(spark, path, "tokens")) == want
    S.update(spark, path, new)
    assert (len(content(spark, path, "rows")), len(content(spark, path, "tokens"))) == (10, 8)
    assert S.vacuum(spark, path, keep=1) > 2 and len(content(spark, path, "rows")) == 10


def test_one_of_two_writers_commits(spark):
    path = new_path(spark, "s")
    first = S.snapshot(spark, path)
    a, b = (S.write_table(first, "t", table(spark, a=n), {"a": str(n)}) for n in (1, 2))
    S.commit(spark, first, {"t": a})
    with pytest.raises(RuntimeError, match="meanwhile"):
        S.commit(spark, first, {"t": b})
    assert content(spark, path, "t") == [("a", 0)]


def test_examples_are_appended_in_one_commit(spark, monkeypatch):
    path = new_path(spark, "e")
    frames = lambda n: (table(spark, **{f"r{k}": 1 for k in range(n)}).select("resource_id"), spark.range(n).select(F.col("id").cast("string").alias("target_id")), spark.range(n).select(F.col("id").cast("string").alias("target_id"), F.lit("r").alias("resource_id"), "id", F.lit(1).alias("doc_id"), F.lit(1).alias("position")))
    ST.write_examples(path, *frames(2))
    ST.write_examples(path, *frames(3), append=True)
    count = lambda: [S.snapshot(spark, path).read(spark, n).count() for n in ("resources", "targets", "occurrences")]
    assert count() == [3, 3, 3]
    with monkeypatch.context() as m:
        m.setattr(S, "commit", lambda *a: (_ for _ in ()).throw(Stopped))
        with pytest.raises(Stopped):
            ST.write_examples(path, *frames(9), append=True)
    assert count() == [3, 3, 3]
    ST.write_examples(path, *frames(1))
    assert count() == [1, 1, 1]


def scanned_files(df):
    """Files that the plan's scans name, and those that they read."""
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    found = []
    for i in range(leaves.size()):
        metrics = leaves.apply(i).metrics()
        if metrics.contains("numFiles"):
            found.append((leaves.apply(i).toString(), metrics.apply("numFiles").value(), metrics.apply("filesSize").value()))
    return found


def test_partitions_without_a_token_are_not_read(spark):
    found = scans.stored_sentences(spark, SF)
    rows, inventory = found.read(spark, "rows"), found.read(spark, "tokens")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        wanted = scans.rare_tokens(inventory, 1)
        picked = R.scan_partitions(rows, inventory, wanted)
        got = {r["resource_id"] for r in picked.select("resource_id").distinct().collect()}
        assert len(got) == 1 < rows.select("resource_id").distinct().count()
        picked.collect()
        plan = picked._jdf.queryExecution().executedPlan().toString()
        assert "dynamicpruning" in plan
        rows.collect()
        (whole,) = [n for p, n, _ in scanned_files(rows)]
        (some,) = [n for p, n, _ in scanned_files(picked) if "dynamicpruning" in p]
        assert 0 < some < whole
        none = R.scan_partitions(rows, inventory, spark.createDataFrame([("no such token",)], "token string"))
        assert none.count() == 0
        without = spark.createDataFrame([("web#none",), (rows.first()["resource_id"],)], "resource_id string")
        assert R.scan_partitions(rows, inventory, spark.createDataFrame([("no such token",)], "token string"), without).count() > 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_chain_resumes_where_it_was_stopped(spark):
    docs = scans.documents(spark, SF)
    sources = scans.chain_sources(spark, SF, docs)
    path, calls = new_path(spark, "chain"), []

    def counted(stage, stop=None):
        def make(*inputs):
            if stage.name == stop:
                raise Stopped
            calls.append(stage.name)
            return stage.make(*inputs)

        return C.Stage(stage.name, stage.needs, make, stage.whole, stage.version)

    with pytest.raises(Stopped):
        C.run(spark, path, [counted(s, "occurrences") for s in scans.CHAIN], sources)
    assert calls == ["patterns", "sentences", "tokens", "hits"]
    C.run(spark, path, [counted(s) for s in scans.CHAIN], sources)
    assert calls == [s.name for s in scans.CHAIN]  # each ran once
    steps = C.run(spark, path, [counted(s) for s in scans.CHAIN], sources)
    assert len(calls) == len(scans.CHAIN) and not any(s.written for s in steps)
    # one resource changes, one goes: its parts are written, and rows equal those of a full run
    first = docs.agg(F.min("resource_id")).first()[0]
    last = docs.agg(F.max("resource_id")).first()[0]
    changed = scans.one_changed(docs).filter(F.col("resource_id") != last)
    sources = scans.chain_sources(spark, SF, changed)
    steps = {s.stage: s for s in C.run(spark, path, scans.CHAIN, sources)}
    assert steps["sentences"].written == steps["occurrences"].written == (first,) and not steps["patterns"].written and steps["retained"].written == (None,)
    other = new_path(spark, "chain")
    C.run(spark, other, scans.CHAIN, sources)
    for s in scans.CHAIN:
        a, b = (sorted(map(str, S.snapshot(spark, p).read(spark, s.name).collect())) for p in (path, other))
        assert a == b and a, s.name
    # another rule: its stage and what is behind it
    newer = [C.Stage(s.name, s.needs, s.make, s.whole, 2) if s.name == "retained" else s for s in scans.CHAIN]
    assert [s.stage for s in C.run(spark, path, newer, sources) if s.written] == ["retained", "coverage", "raw_coverage", "static_examples"]
    with pytest.raises(ValueError, match="needs"):
        C.run(spark, path, scans.CHAIN[1:], {k: v for k, v in sources.items() if k != "labels"})


def brute_hits(rows, phrase):
    out = collections.Counter()
    for r in {tuple(r) for r in rows}:
        words = [w for w in r[3].split(" ") if w]
        n = sum(words[i : i + len(phrase)] == phrase for i in range(len(words) - len(phrase) + 1))
        if n:
            out[r[:3]] = max(out[r[:3]], n)
    return out


def test_index_codes():
    rng = np.random.default_rng(3)
    v = rng.integers(0, 2**63, 500).astype(np.uint64) >> rng.integers(0, 63, 500).astype(np.uint64)
    data, ends = I.encode(v)
    assert (I.decode(data.tobytes()) == v).all() and ends[-1] == len(data) and len(I.decode(b"")) == 0
    doc, sentence, at = np.sort(rng.choice(rng.integers(-(2**62), 2**62, 20), 300)), rng.integers(1, 4, 300), rng.integers(0, 9, 300)
    order = np.lexsort((at, sentence, doc))
    begins = np.array([0, 1, 150, 299])
    blocks = [I.unpack(b) for b in I.pack(doc[order], sentence[order], at[order], begins)]
    for k, x in enumerate((doc, sentence, at)):
        assert (np.concatenate([b[k] for b in blocks]) == x[order]).all()


def test_index_reads_the_buckets_of_its_tokens(spark, monkeypatch):
    monkeypatch.setattr(I, "BLOCK_POSTINGS", 50)
    random.seed(4)
    words = ["the"] * 30 + ["of"] * 10 + [f"w{i}" for i in range(300)]
    rows = [(random.choice(["a", "b", None]), random.choice([None, -5, 2**60, *range(90)]), random.randrange(1, 4), " ".join(random.choices(words, k=random.randrange(0, 25)))) for _ in range(1500)]
    rows = list({(r[0], r[1], r[2]): r for r in rows}.values())
    df = spark.createDataFrame(rows, "resource_id string, doc_id long, position int, norm string")
    path = new_path(spark, "index")
    I.build_index(df.unionByName(df.limit(40)), path, buckets=16, chunk_documents=20)  # some rows repeat
    for phrase in (["the"], ["the", "of"], ["the", "the"], ["of", "the", "the"], ["w7"], ["w7", "the"], ["nowhere"], ["the", "nowhere"], []):
        found = {(r["resource_id"], r["doc_id"], r["position"]): r["hits"] for r in I.search_phrase(spark, path, phrase, buckets=16).collect()}
        assert found == (brute_hits(rows, phrase) if phrase else {}), phrase
    counts = {r["token"]: (r["postings"], r["sentences"]) for r in I.postings(spark, path).collect()}
    plain = I.postings  # of rows without repeats
    I.build_index(df, path + "b", buckets=16, chunk_documents=20)
    exact = {r["token"]: (r["postings"], r["sentences"]) for r in plain(spark, path + "b").collect()}
    tokens = [(w, r[:3]) for r in rows for w in r[3].split(" ") if w]
    assert exact == {w: (n, len({k for x, k in tokens if x == w})) for w, n in collections.Counter(w for w, _ in tokens).items()} and counts["the"][0] > exact["the"][0]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        blocks = I.open_blocks(spark, path, ["w7"], 16)
        blocks.collect()
        everything = spark.read.parquet(path)
        everything.collect()
        (_, few, size), (_, every, whole) = scanned_files(blocks)[0], scanned_files(everything)[0]
        assert few * 8 <= every and size * 3 <= whole
        narrow = blocks.select("token", "chunk")
        assert "data" not in narrow._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")

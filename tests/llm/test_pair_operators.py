"""Spelling variants, whitening and the Jaccard join against brute force and SQL, and on the awkward cases their docstrings define."""

import re
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.llm import jaccard_join, queries, spelling, whiten

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [(None, None), (None, ""), (1, "a  b c d e f"), (1, "a  b c d e f"), (2, "a b\tc D e f"), (3, None), (4, " \n "), (5, "é日本 x" * 3000), (6, "x"), (7, "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "de", 7, 1, "k", 0) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, word string, node long, size int, key string, n int").withColumnRenamed("n", "TEXT")


@pytest.mark.parametrize("name", ["op11_symmetric_delete_spelling", "op13_multiple_order_jaccard_join"])
def test_queries_against_sql(spark, name):
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
        want = c.sql(queries.QUERY_SQL[name])
        found = queries.QUERIES[name](spark, SF)
        assert sorted(map(tuple, found.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)


# 11


def brute_words(rows, noise, letters, least):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % noise == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= letters and k >= least}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words, ratio=2):
    near = {w: [] for w in words}
    for a, b in combinations(words, 2):
        if one_apart(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, k in words.items():
        best = min(near[w], key=lambda x: (-words[x], x.encode()), default=None)
        form[w] = best if best is not None and words[best] >= ratio * k else None
    out = set()
    for w, k in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, k, len(near[w]), words[form[w]] if form[w] else None))
    return out


def variants(df, **more):
    return {tuple(r) for r in spelling.spelling_variants(df, **more).select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_spelling_of_documents(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert variants(docs) == brute_variants(brute_words(rows, 97, 5, 3))


def test_spelling_by_hand(spark):
    """Insertions, deletions, replacements, transpositions, doubled letters, ties, a chain of forms, letters of two bytes and very long words."""
    long = "abcdefghij" * 4000
    counts = {"letter": 40, "leter": 9, "lettter": 3, "lette": 3, "lettre": 5, "ltter": 2, "Élan": 4, "élan": 9, "elan": 9, "etan": 2, "aaaa": 8, "aaaaa": 4, "aaab": 4, "aaa": 1, "abab": 3, "baba": 3, long: 6, long[:-1]: 2, long[1:-1]: 1, "x" + long: 3, "ABAB": 1}
    rows = [(i, " ".join([w] * k) + "×" * (i % 2) + " 7_") for i, (w, k) in enumerate(counts.items())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    words = brute_words(rows, 10**9, 3, 1)
    assert words["abab"] == 4 and "×" in "".join(words)
    assert variants(df, noise=10**9, least_letters=3, least_count=1) == brute_variants(words)
    assert variants(df, noise=2, least_letters=1, least_count=1, ratio=1.5) == brute_variants(brute_words(rows, 2, 1, 1), 1.5)


def test_deletions_are_distinct():
    word, keys, whole = spelling.deletion_keys(["aab", "ab", "b", "aab"])
    of = lambda i: {k for w, k, x in zip(word, keys, whole) if w == i and not x}
    own = [k for k, x in zip(keys, whole) if x]
    assert [len(of(i)) for i in range(4)] == [2, 2, 1, 2] and of(0) == of(3) and own[1] in of(0) and own[2] in of(1) and own[0] not in of(1)


def test_roots_at_the_end_of_long_chains(spark):
    pointers = spark.range(1, 200).select("id", (F.col("id") - 1).alias("to")).unionByName(spark.range(1000, 3000).select("id", F.lit(150).cast("long").alias("to")))
    found = spelling.roots(pointers)
    assert found.count() == 2199 and found.filter("to <> 0").count() == 0


def test_spelling_of_awkward_documents(spark, odd):
    assert variants(odd) == set() and variants(odd.limit(0)) == set()
    assert variants(odd, least_letters=1, least_count=1, noise=10**9) == brute_variants(brute_words(ODD, 10**9, 1, 1))
    assert variants(odd, least_letters=1, least_count=1, noise=1) == brute_variants(brute_words(ODD, 1, 1, 1))


# 12


def brute_whitening(vectors, k=32):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    d = [[n * int(v) - int(s) for v, s in zip(row, sums)] for row in x]
    c = np.array(d, float) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    return [sum(v * v for v in row) for row in d], c @ u[:, :k], e


def whitened(df, k=32):
    got = sorted(whiten.whiten(df, k).collect(), key=lambda r: (r["vec_id"] is not None, r["vec_id"] or 0, r["component"]))
    width = max((r["component"] for r in got), default=1)
    return got, np.array([[r["whitened"] for r in got if r["component"] == c] for c in range(1, width + 1)]).T


def test_whitening(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    valid = sorted((r["vec_id"], r["embedding"]) for r in table.collect() if r["embedding"] is not None and all(v is not None and np.isfinite(v) for v in r["embedding"]))
    deviation, projected, e = brute_whitening([v for _, v in valid])
    for parts in (1, 37):  # one task, and a tree of two levels
        got, w = whitened(table.repartition(parts))
        assert [(r["vec_id"], r["component"], r["n"], r["deviation"]) for r in got] == [(i, c + 1, len(valid), d) for (i, _), d in zip(valid, deviation) for c in range(32)]
        want = projected / np.sqrt(e[:32])
        np.testing.assert_allclose(w * np.sign((w * want).sum(axis=0)), want, atol=1e-8)
        np.testing.assert_allclose([r["explained"] for r in got[:32]], e[:32] / e.sum(), rtol=1e-9)
        assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9


def test_whitening_of_awkward_rows(spark):
    schema = "vec_id long, embedding array<float>, n int, whitened string, VECTOR int"
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 0.0]), (2, [3.0, -1.0, 0.0]), (2, [3.0, -1.0, 0.0]), (None, [0.5, 4.0, 0.0]), (3, None), (4, [1.0, None, 2.0]), (5, [nan, 1.0, 1.0]), (6, [1.0, -inf, 1.0]), (7, []), (8, [1.0, 2.0]), (9, [0.5, 4.0, 1.0] * 2)]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], schema)
    got, w = whitened(df)
    assert [r["vec_id"] for r in got] == [i for i in (None, 1, 2, 2) for _ in range(3)] and {r["n"] for r in got} == {4}
    deviation, projected, e = brute_whitening([v for _, v in (rows[3], rows[0], rows[1], rows[2])])
    assert [r["deviation"] for r in got[::3]] == deviation
    np.testing.assert_allclose(np.abs(w[:, :2]), np.abs(projected[:, :2]) / np.sqrt(e[:2]), atol=1e-9)
    assert not w[:, 2].any() and got[2]["explained"] == 0 and got[0]["identity_error"] < 1e-9  # a constant dimension
    assert whiten.whiten(df.limit(0)).collect() == [] and whiten.whiten(df.filter("vec_id = 3")).collect() == []
    one, w = whitened(df.filter("vec_id = 1"))
    assert not w.any() and [(r["n"], r["deviation"], r["identity_error"]) for r in one] == [(1, 0, 0.0)] * 3
    huge = spark.createDataFrame([(1, [1e30, 1.0]), (2, [-1e30, 2.0]), (3, [0.0, 3.0])], "vec_id long, embedding array<float>")
    got, w = whitened(huge)
    assert [r["deviation"] for r in got] == [None] * 4 + [0 + (3 * 1000192 - (1000064 + 1000128 + 1000192)) ** 2] * 2


def test_exact_sums_of_large_numbers():
    c = whiten.Centre(3, (3 * 2**40 + 1, -5))
    x = np.array([[2**50, 0], [-(2**50), -1]])
    assert c.scaled(x).tolist() == [[3 * int(v) - s for v, s in zip(row, c.sums)] for row in x.tolist()]
    big = whiten.Centre(2**20, (2**62, 7))
    assert big.scaled(x).tolist() == [[2**20 * v - s for v, s in zip(row, big.sums)] for row in x.tolist()]


# 13


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows, threshold=80):
    sets = [shingle_set(t) for _, t in rows]
    at = list(range(len(rows)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
            at[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return sorted(((d, len(s), ids.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def joined(df, **more):
    return sorted((tuple(r) for r in jaccard_join.jaccard_components(df, **more).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_join_of_documents(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert joined(docs) == brute_components(rows)


def test_join_drops_all_sets_early(spark, docs, monkeypatch):
    """The table of all sets is gone when the sets that are left are compared, and heads are shuffled once."""
    from pathlib import Path
    from urllib.parse import unquote, urlparse

    folder = lambda df: Path(unquote(urlparse(df.inputFiles()[0]).path)).parent
    seen, survivors, roots = {}, jaccard_join._survivors, jaccard_join._roots

    def watched(signed, *more):
        seen["all"] = folder(signed)
        assert seen["all"].exists()
        return survivors(signed, *more)

    def after(sets, *more):
        seen["left"] = (seen["all"].exists(), folder(sets).exists())
        return roots(sets, *more)

    monkeypatch.setattr(jaccard_join, "_survivors", watched)
    monkeypatch.setattr(jaccard_join, "_roots", after)
    assert joined(docs) == brute_components([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert seen["left"] == (False, True)


def test_join_of_families(spark):
    """Chains without a middle, copies, edits at every distance around the threshold, texts with a long passage in common, templates."""
    rng = np.random.default_rng(5)
    word = lambda: f"w{rng.integers(50_000)}"
    base, passage = [word() for _ in range(60)], [word() for _ in range(40)]
    texts = []
    chain = list(base)
    for i in range(25):
        texts.append(chain)
        chain = chain[2:] + [word(), word()]
    for edits in range(12):
        for _ in range(3):
            t = list(base)
            for p in rng.choice(60, edits, replace=False):
                t[p] = word()
            texts += [t, t[: 60 - edits], [x.upper() for x in t]]
    texts += [[word() for _ in range(own)] + passage for own in range(0, 30, 2) for _ in range(3)]
    paragraphs = [[word() for _ in range(12)] for _ in range(6)]
    texts += [sum((paragraphs[k] for k in rng.choice(6, 5, replace=False)), []) for _ in range(40)]
    rows = [(int(i), " ".join(t)) for i, t in zip(rng.permutation(len(texts)), texts)]
    found = joined(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found == brute_components(rows) and 20 < len({c for _, _, c in found}) < len(rows) - 60
    assert joined(spark.createDataFrame(rows, "doc_id long, text string"), threshold=60) == brute_components(rows, 60)


def test_join_at_the_threshold(spark):
    """Eight of ten shingles, which is enough, and a little less."""
    w = [f"a{i}" for i in range(14)]
    rows = [(1, " ".join(w)), (2, " ".join(w[:12])), (3, " ".join(w[:11])), (4, "p q"), (5, "P  q"), (6, "p"), (7, "p q r s"), (8, "p q r s t")]
    found = joined(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found == brute_components(rows) and (2, 8, 1) in found and (5, 1, 4) in found and (6, 1, 6) in found


def test_join_of_awkward_documents(odd):
    found = joined(odd)
    assert found == brute_components(ODD) and (7, 1, 6) in found and (2, 2, 1) in found
    assert joined(odd.limit(0)) == []
    assert joined(odd.filter("doc_id IS NULL")) == [(None, 0, None)] * 2

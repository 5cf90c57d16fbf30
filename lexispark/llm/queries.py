"""The opN_ queries: thin readers over the operators, with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, crf, dartminhash, exact, jaccard_join, langid, mixing, packing, rans, secret_scan, spelling, warc, whiten

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_golomb_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, sf_dir, "documents"))


def op1_crf_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return crf.judge_documents(docs, crf.fit_field(docs, _table(spark, sf_dir, "labels")))


def op2_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), keep_ids=False).drop("ids")


def op3_content_addressed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_archive(_table(spark, sf_dir, "pages"))
    return warc.read_archive(spark, archive).drop("payload")


def op5_segmentation_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_held_out(_table(spark, sf_dir, "documents"))


def op6_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = rans.write_token_files(_table(spark, sf_dir, "documents"))
    return rans.read_token_files(spark, files, keep_ids=False).drop("ids")


def op7_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_trigram_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = tuple(r.kind for r in secret_scan.BASE_RULES)
    found = secret_scan.find_secrets(_table(spark, sf_dir, "documents"))
    counts = [secret_scan.count_kind(k).alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(secret_scan.joined_spans(base), 256).alias("base_sha256"), secret_scan.joined_spans().alias("spans"))


def op9_dart_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.near_duplicates(_table(spark, sf_dir, "documents"))


_MARKED = "\\### Assistant: </turn> ok"


def op10_relational_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_MARKED).alias("text"))
    return chat.digest_conversations(chat.format_conversations(turns.unionByName(added)))


def op11_symmetric_delete_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def op12_tsqr_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(_table(spark, sf_dir, "embeddings"))


def op13_multiple_order_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_crf_line_quality, op2_shortest_pack_first, op3_content_addressed_warc, op4_golomb_exact_dedup, op5_segmentation_language_id,
        op6_rans_token_files, op7_sainte_lague_mix, op8_trigram_secret_scan, op9_dart_minhash_near_dedup, op10_relational_chat,
        op11_symmetric_delete_spelling, op12_tsqr_whitening, op13_multiple_order_jaccard_join,
    )
}

QUERY_SQL: dict[str, str | None] = {
    "op4_golomb_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
        )
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM t WINDOW g AS (PARTITION BY text_sha256)
    """,
    "op3_content_addressed_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        t AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS last_id FROM p),
        k AS (SELECT *, payload_bytes < 1000 OR page_id = last_id AS response FROM t)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN response THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN NOT response THEN last_id END AS refers_to
        FROM k
    """,
    "op10_relational_chat": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ),
        e AS (
            SELECT *, lag(role) OVER w IS DISTINCT FROM role AS opens, lead(role) OVER w IS DISTINCT FROM role AS closes,
                   replace(replace(text, '\', '\0'), '<', '\1') AS escaped
            FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(length(escaped) + CASE WHEN opens THEN 12 + length(role) ELSE 6 END + CASE WHEN closes THEN 7 ELSE 0 END)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id
    """,
    "op11_symmetric_delete_spelling": """
        WITH RECURSIVE t AS (
            SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents
        ),
        r AS (
            SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k FROM t WHERE length(run) >= 5 GROUP BY ALL
        ),
        b AS (
            -- UTF-8 bytes, each as eight steps of the checksum: the byte, then seven zeros
            SELECT run, k, flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda c:
                CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]
                ELSE [(192 + (unicode(c) >> 6))::BIGINT, 0, 0, 0, 0, 0, 0, 0, (128 + (unicode(c) & 63))::BIGINT, 0, 0, 0, 0, 0, 0, 0] END)) AS bits
            FROM r
        ),
        h AS (
            SELECT run, k, xor(list_reduce(bits, lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1)), 4294967295::BIGINT), 4294967295) AS h FROM b
        ),
        w AS MATERIALIZED (
            SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(k)::BIGINT AS n
            FROM h GROUP BY 1 HAVING length(word) >= 5 AND sum(k) >= 3
        ),
        -- deletions of one letter of words of one letter more: insertions; the same place blanked in words of one length: replacements
        d AS (SELECT DISTINCT word, n, left(word, i::INT) || substring(word, i::INT + 2) AS cut FROM (SELECT *, unnest(range(length(word))) AS i FROM w)),
        g AS (SELECT word, n, i, left(word, i::INT) || '?' || substring(word, i::INT + 2) AS cut FROM (SELECT *, unnest(range(length(word))) AS i FROM w)),
        p AS (
            SELECT d.word, w.word AS other, w.n AS other_n FROM d JOIN w ON d.cut = w.word
            UNION ALL SELECT w.word, d.word, d.n FROM d JOIN w ON d.cut = w.word
            UNION ALL SELECT x.word, y.word, y.n FROM g x JOIN g y ON x.cut = y.cut AND x.word <> y.word
        ),
        s AS (SELECT word, count(*) AS n_near, max(other_n) AS best_n, (min((-other_n, other))) AS best FROM p GROUP BY word),
        f AS MATERIALIZED (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * w.n THEN best[2] END AS form, CASE WHEN best_n >= 2 * w.n THEN best_n END AS form_n
            FROM w LEFT JOIN s USING (word)
        ),
        c AS (SELECT word, word AS at FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.at WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n
        FROM c JOIN f e ON e.word = c.at AND e.form IS NULL JOIN f ON f.word = c.word
    """,
    "op13_multiple_order_jaccard_join": r"""
        WITH RECURSIVE t AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ),
        s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                           ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))) END AS g
            FROM t
        ),
        n AS MATERIALIZED (SELECT min(doc_id) AS id, g, len(g) AS size FROM s WHERE len(g) > 0 GROUP BY g),
        e AS MATERIALIZED (SELECT id, size, unnest(g) AS shingle FROM n),
        p AS MATERIALIZED (
            SELECT x.id AS a, y.id AS b FROM e x JOIN e y ON x.shingle = y.shingle AND x.id < y.id
            GROUP BY x.id, y.id, x.size, y.size HAVING 100 * count(*) >= 80 * (x.size + y.size - count(*))
        ),
        l AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
        r AS (SELECT id, id AS reached FROM n UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.reached),
        c AS (SELECT id, min(reached) AS component_id FROM r GROUP BY id)
        SELECT s.doc_id, len(s.g) AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id
        FROM s LEFT JOIN n ON n.g = s.g LEFT JOIN c ON c.id = n.id
    """,
}

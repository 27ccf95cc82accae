"""The queries of the numbered operators, each over its whole table, and their SQL where it can be said in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, conversations, decontamination, forest, html_text, lexical, ngram_join, packing, pii, repeats, sharding, token_counts, toxicity
from .common import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.checked(docs, pii.session_key(spark), count_col="n_entities")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_components(table(spark, sf_dir, "documents"), size=3, percent=90)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), 24)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed(table(spark, sf_dir, "documents"), 400)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.digests(conversations.repair(conversations.damaged(rows)), rows.select("conv_id"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_vectors(table(spark, sf_dir, "embeddings"), 0.95)


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_pii, op3_ngram_join, op4_sharding, op5_toxicity, op6_html_text, op7_repeats, op8_packing, op9_ann, op10_token_counts, op11_conversations, op12_lexical_search, op13_near_vectors)}
SQL: dict[str, str] = {
    "op3_ngram_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
            FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]))
                WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS g
            FROM w
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 90 * (a.n + b.n - i)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r AS (SELECT doc_id AS x, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.x)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m.c AS component_id
        FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(c) AS c FROM r GROUP BY 1) m ON m.x = d.doc_id
    """,
    "op11_conversations": r"""
        WITH RECURSIVE c AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                xor(list_reduce([4294967295] || list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT)),
                    lambda h, b: list_reduce([xor(h, b)] || range(8), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) % 20 AS fault
            FROM conversations
        ), d AS (
            SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
                CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
            FROM c WHERE fault <> 0
        ), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos FROM d),
        p AS (
            SELECT *, left(role, 1) AS ini, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS bl,
                row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
                NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before
            FROM o
        ), r AS (
            SELECT *, CASE WHEN NOT bl AND again THEN 1 ELSE 0 END AS dup, bl OR again AS gone, CASE WHEN cut AND NOT bl AND NOT again THEN 1 ELSE 0 END AS tr
            FROM p
        ), n AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(CASE WHEN bl THEN 1 ELSE 0 END) AS blank, sum(dup) AS duplicate, sum(tr) AS truncated,
                sum(CASE WHEN before || ini NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END) AS illegal, max(pos) AS last
            FROM r GROUP BY 1
        ), ins(s, k, t, lines) AS (VALUES (0, 0, 0, ''), (1, 0, 1, ''), (2, 0, 2, ''), (3, 0, 3, ''),
            (0, 1, 2, 'user:' || chr(10)), (1, 1, 2, 'user:' || chr(10)), (2, 1, 3, 'assistant:' || chr(10)), (3, 1, 2, 'user:' || chr(10)),
            (0, 2, 3, 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 2, 3, 'user:' || chr(10) || 'assistant:' || chr(10)),
            (2, 2, 2, 'assistant:' || chr(10) || 'user:' || chr(10)), (3, 2, 3, 'user:' || chr(10) || 'assistant:' || chr(10))
        ), keep(ini, s, t) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
        dp AS (
            SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS pos, 0 AS state, {'cost': 0, 'audit': '', 'body': ''} AS b FROM conversations
            UNION ALL
            SELECT conv_id, pos, state, min({'cost': cost, 'audit': audit, 'body': body}) FROM (
                SELECT dp.conv_id, r.pos, e.state, CAST(dp.b.cost + 3 * i.k + e.cost AS INTEGER) AS cost, dp.b.audit || repeat('I', i.k) || e.edit AS audit, dp.b.body || i.lines || e.line AS body
                FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.pos = dp.pos + 1 JOIN ins i ON i.s = dp.state,
                LATERAL (
                    SELECT 'D' AS edit, i.t AS state, 4 AS cost, '' AS line
                    UNION ALL SELECT 'K', k.t, 3 * r.tr, r.role || ':' || r.text || chr(10) FROM keep k WHERE NOT r.gone AND k.ini = r.ini AND k.s = i.t
                    UNION ALL SELECT 'R', CASE WHEN i.t = 2 THEN 3 ELSE 2 END, 3 + 3 * r.tr, CASE WHEN i.t = 2 THEN 'assistant:' ELSE 'user:' END || r.text || chr(10) WHERE NOT r.gone
                ) e
            ) GROUP BY 1, 2, 3
        ), f AS (
            SELECT dp.conv_id, min({'cost': dp.b.cost + 3 * t.k, 'audit': dp.b.audit || repeat('I', t.k), 'body': dp.b.body || t.lines}) AS b
            FROM dp LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM dp.conv_id
            JOIN (VALUES (0, 0, ''), (3, 0, ''), (2, 1, 'assistant:' || chr(10)), (1, 2, 'user:' || chr(10) || 'assistant:' || chr(10))) t(s, k, lines) ON t.s = dp.state
            WHERE dp.pos = coalesce(n.last, 0) GROUP BY 1
        )
        SELECT f.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
            CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(b.cost AS BIGINT) AS cost, b.audit AS audit, sha256(left(b.body, greatest(length(b.body) - 1, 0))) AS repaired_sha256
        FROM f LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM f.conv_id
    """,
    "op12_lexical_search": r"""
        WITH d AS (
            SELECT doc_id, ws, len(ws) AS n
            FROM (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents)
            WHERE len(ws) > 0
        ), c AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM d),
        q AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term
            FROM benchmark
        ), p AS (
            SELECT doc_id, n, term, count(*) AS tf
            FROM (SELECT doc_id, n, unnest(ws) AS term FROM d)
            WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3
        ), w AS (
            SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) AS w
            FROM (SELECT term, count(*) AS df FROM p GROUP BY 1), c
        ), s AS (
            SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nn) // ll)))) AS BIGINT) AS score
            FROM q JOIN p USING (term) JOIN w USING (term), c GROUP BY 1, 2
        )
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
        WHERE rank <= 10
    """,
    "op13_near_vectors": r"""
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE len(list_filter(embedding, lambda x: x <> 0)) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), l AS (
            SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.95
        ), r AS (SELECT vec_id AS x, vec_id AS c FROM embeddings UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.x),
        n AS (SELECT x, count(*) AS n FROM l GROUP BY 1)
        SELECT e.vec_id, coalesce(n, 0) AS n_links, m.c AS component_id, e.vec_id = m.c AS kept
        FROM embeddings e JOIN (SELECT x, min(c) AS c FROM r GROUP BY 1) m ON m.x = e.vec_id LEFT JOIN n ON n.x = e.vec_id
    """,
}

"""The registered queries of this subpackage and their DuckDB oracles (where SQL can express the result)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayflow.llm.classifier import classify_quality
from assayflow.llm.conversation_repair import repair_damaged
from assayflow.llm.decontaminate import find_leaks
from assayflow.llm.exact_dedup import exact_dedup
from assayflow.llm.jaccard import jaccard_components
from assayflow.llm.language_model import score_documents
from assayflow.llm.lexical_search import search
from assayflow.llm.licenses import scan_licenses
from assayflow.llm.packing import pack
from assayflow.llm.personal_data import find_personal_data
from assayflow.llm.perspectives import rotate_perspectives
from assayflow.llm.sequence_packing import pack_sequences
from assayflow.llm.warc_index import write_and_read_back


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_and_read_back(_table(spark, sf_dir, "pages"), least_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"))


def op3_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rotate_perspectives(_table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
    return out.withColumn("mask", mask)


def op5_semi_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(_table(spark, sf_dir, "documents"))


def op6_tree_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"), keep="max")


def op7_heavy_light_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op8_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents")).drop("spans")


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents")).drop("cluster")


def op11_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_sequences(_table(spark, sf_dir, "documents"))


def op12_presence_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_lightest_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_damaged(_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_capture_index, op2_log_bilinear, op3_string_tiling, op4_perspectives, op5_semi_crf,
    op6_tree_merge, op7_heavy_light_join, op8_boosted_trees, op9_license_scan, op10_best_fit,
    op11_shortest_pack_first, op12_presence_masks, op13_lightest_repair,
)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op1_capture_index": """
        WITH hashed AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
        ), decided AS (
            SELECT *, min(page_id) OVER (PARTITION BY h, payload_bytes) AS first_id,
                   count(*) OVER (PARTITION BY h, payload_bytes) AS copies FROM hashed
        )
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
               list_aggregate(list_transform(range(32), lambda i:
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                          (((('0x' || substr(h, (10 * (i // 8) + 1)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31) + 1)::INT, 1)),
                   'string_agg', '') AS payload_digest,
               CASE WHEN copies > 1 AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN copies > 1 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
        FROM decided""",
    "op4_perspectives": """
        WITH said AS (
            SELECT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS speaker,
                   replace(coalesce(text, ''), '<|', '< |') AS body FROM conversations
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, body) - 1 AS pos FROM said
        ), people AS (
            SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'
        ), segments AS (
            SELECT p.conv_id, q.perspective, p.pos // 256 AS part, p.pos, p.speaker = q.perspective AS own,
                   CASE WHEN p.speaker = q.perspective THEN '<|assistant|>' WHEN p.speaker = 'system' THEN '<|system|>'
                        ELSE '<|user:' || p.speaker || '|>' END || chr(10) AS head,
                   p.body || '<|end|>' || chr(10) AS rest
            FROM placed p JOIN people q ON p.conv_id IS NOT DISTINCT FROM q.conv_id
        ), ended AS (
            SELECT *, sum(length(head) + length(rest)) OVER (PARTITION BY conv_id, perspective, part ORDER BY pos) AS stop FROM segments
        )
        SELECT conv_id, perspective, part::INTEGER AS part, count(*)::INTEGER AS n_turns, (count(*) FILTER (WHERE own))::INTEGER AS n_own,
               string_agg(head || rest, '' ORDER BY pos) AS rendered,
               coalesce(string_agg((stop - length(rest))::BIGINT::VARCHAR || ':' || stop::BIGINT::VARCHAR, ',' ORDER BY pos) FILTER (WHERE own), '') AS mask
        FROM ended GROUP BY conv_id, perspective, part""",
    "op6_tree_merge": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op7_heavy_light_join": f"""
        WITH RECURSIVE worded AS MATERIALIZED (
            SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), shingles AS MATERIALIZED (
            SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ')
                   ELSE array_to_string(list_slice(w, i, i + 4), ' ') END AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM worded WHERE len(w) > 0)
        ), sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
        ), links AS MATERIALIZED (
            SELECT a.doc_id AS u, b.doc_id AS v FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
            JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
            GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
        ), reach AS (
            SELECT doc_id AS u, doc_id AS v FROM documents
            UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v
        )
        SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least_id AS component_id
        FROM documents d LEFT JOIN sizes USING (doc_id)
        JOIN (SELECT u, min(v) AS least_id FROM reach GROUP BY u) ON u = d.doc_id""",
    "op12_presence_masks": """
        WITH worded AS MATERIALIZED (
            SELECT row_number() OVER () AS r, doc_id, TERMS AS w FROM documents
        ), tf AS MATERIALIZED (
            SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM worded) GROUP BY r, t
        ), total AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM worded WHERE len(w) > 0
        ), asked AS (
            SELECT DISTINCT k, item_id, t FROM (SELECT k, item_id, unnest(w) AS t FROM (SELECT row_number() OVER () AS k, item_id, TERMS AS w FROM benchmark))
        ), weights AS (
            SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY t, n_docs
        ), scored AS (
            SELECT k, item_id, r, doc_id, sum(v.w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * len(d.w) * n_docs) // n_terms))))::BIGINT AS score
            FROM asked JOIN tf USING (t) JOIN weights v USING (t) JOIN worded d USING (r), total GROUP BY k, item_id, r, doc_id
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0
        )
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50""".replace(
        "TERMS", f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    ),
    "op13_lightest_repair": """
        WITH RECURSIVE convs AS MATERIALIZED (
            SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)
        ), raw AS (
            SELECT c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
                       flatten(list_transform(string_split(coalesce(r.conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
                       lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1)))) % 20 AS d
            FROM conversations r JOIN convs ON convs.conv_id IS NOT DISTINCT FROM r.conv_id
        ), damaged AS (
            SELECT c, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(CASE d WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM raw WHERE d <> 0
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(text)) - 1 AS i FROM damaged
        ), rows_ AS MATERIALIZED (
            SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) AS before, count(*) OVER (PARTITION BY c) AS n,
                   CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
                        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM placed
        ), edits AS MATERIALIZED (
            SELECT c, i, '' AS r, 3 AS cost, 'D' AS letter FROM rows_
            UNION ALL SELECT c, i, r, 2 + (fault = 'truncated')::INT, 'R' FROM rows_, (VALUES ('u'), ('a')) v(r) WHERE fault NOT IN ('blank', 'duplicate')
            UNION ALL SELECT c, i, initial, (fault = 'truncated')::INT, 'K' FROM rows_ WHERE fault NOT IN ('blank', 'duplicate') AND initial IN ('s', 'u', 'a')
        ), after_ AS (
            SELECT * FROM (VALUES (0, '', 0), (1, '', 1), (2, '', 2), (3, '', 3), (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) v(q, r, q2)
        ), inserted AS (
            SELECT * FROM (VALUES (0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (0, 2, 1), (1, 2, 1), (3, 2, 1), (2, 3, 1), (0, 3, 2), (1, 3, 2)) v(q, q2, k)
        ), spans AS (
            SELECT c, 0::BIGINT AS i, q2 AS q, {'cost': 2 * k, 'audit': repeat('I', k)} AS w FROM convs, inserted WHERE q = 0
            UNION ALL
            SELECT s.c, s.i + 1, x.q2, min({'cost': s.w.cost + e.cost + 2 * x.k, 'audit': s.w.audit || e.letter || repeat('I', x.k)})
            FROM spans s JOIN edits e ON e.c = s.c AND e.i = s.i JOIN after_ t ON t.q = s.q AND t.r = e.r JOIN inserted x ON x.q = t.q2
            GROUP BY s.c, s.i, x.q2
        ), best AS (
            SELECT c, min(w) AS w FROM spans LEFT JOIN (SELECT DISTINCT c, n FROM rows_) USING (c) WHERE i = coalesce(n, 0) AND q IN (0, 3) GROUP BY c
        ), letters AS (
            SELECT c, p, w.audit[p] AS letter FROM (SELECT c, w, unnest(range(1, length(w.audit) + 1)) AS p FROM best)
        ), walked AS (
            SELECT *, count(*) FILTER (WHERE letter <> 'I') OVER u - (letter <> 'I')::INT AS i, count(*) FILTER (WHERE letter <> 'D') OVER u - 1 AS o,
                   count(*) FILTER (WHERE letter <> 'D') OVER (PARTITION BY c) % 2 AS odd
            FROM letters WINDOW u AS (PARTITION BY c ORDER BY p ROWS UNBOUNDED PRECEDING)
        ), repaired AS (
            SELECT c, string_agg(CASE letter WHEN 'K' THEN role ELSE CASE (o - odd) % 2 WHEN 0 THEN 'user' ELSE 'assistant' END END || ':' || CASE letter WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS body
            FROM walked LEFT JOIN rows_ USING (c, i) WHERE letter <> 'D' GROUP BY c
        ), counted AS (
            SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
                   count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY c
        )
        SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
               coalesce(illegal, 0)::BIGINT AS illegal, w.cost::BIGINT AS cost, w.audit AS audit, sha256(coalesce(body, '')) AS repaired_sha256
        FROM convs LEFT JOIN counted USING (c) JOIN best USING (c) LEFT JOIN repaired USING (c)""",
}

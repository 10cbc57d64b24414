"""Registered queries of the corpus operators, and DuckDB SQL where SQL can say
the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat, decontamination, hard_negatives, langid, ngram_join, packing, prefix_trie,
               secret_scan, sharding, token_counts, topk, toxicity, warc)
from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "set_id", "copies", "n_links")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_pages(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained(table(spark, sf_dir, "documents"),
                                     table(spark, sf_dir, "benchmark"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.injected(table(spark, sf_dir, "conversations"))
    return chat.digests(chat.read_back(chat.windows(turns)))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold=toxicity.TRAIN)
    held_out = F.coalesce(~F.expr(toxicity.TRAIN), F.lit(False))
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.expr("vec_id % 100 = 0"), 10)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(langid.training_rows(docs))
    held_out = F.coalesce(~F.expr(langid.TRAIN), F.lit(False))
    return langid.identify(docs, model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.find(table(spark, sf_dir, "documents")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.numbered(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(*prefix_trie.rebuilt(turns))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"),
                                         F.expr("vec_id % 50 = 0"), label)


QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_ngram_join, op3_warc, op4_decontamination, op5_chat, op6_packing,
    op7_sharding, op8_toxicity, op9_topk, op10_langid, op11_secret_scan,
    op12_prefix_trie, op13_hard_negatives)}

_SHINGLES = r"""
    SELECT {id}, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s
    FROM (SELECT {id}, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM {t})"""

ORACLE = {
    "op2_ngram_join": f"""
WITH RECURSIVE d AS ({_SHINGLES.format(id="doc_id", t="documents")}),
x AS (SELECT doc_id, unnest(s) AS g FROM d),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
      FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b, p.n = len(da.s) AND p.n = len(db.s) AS same
      FROM p JOIN d da ON da.doc_id = a JOIN d db ON db.doc_id = b
      WHERE 5 * p.n >= 4 * (len(da.s) + len(db.s) - p.n)),
r(doc_id, root) AS (
    SELECT doc_id, doc_id FROM d UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id)
SELECT d.doc_id, c.class_id, least(d.doc_id, min(l.b) FILTER (WHERE l.same)) AS set_id,
       1 + count(l.b) FILTER (WHERE l.same) AS copies, count(l.b) AS n_links
FROM d JOIN (SELECT doc_id, min(root) AS class_id FROM r GROUP BY 1) c USING (doc_id)
LEFT JOIN l ON l.a = d.doc_id GROUP BY 1, 2""",
    "op3_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                  sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100
             THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to FROM f""",
    "op4_decontamination": f"""
WITH d AS ({_SHINGLES.format(id="doc_id", t="documents")}),
b AS ({_SHINGLES.format(id="item_id", t="benchmark")}),
y AS (SELECT item_id, len(s) AS n, unnest(s) AS g FROM b),
m AS (SELECT DISTINCT len(string_split(g, ' ')) AS m FROM y WHERE len(string_split(g, ' ')) < 5),
x AS (SELECT doc_id, unnest(s) AS g FROM d UNION
      SELECT doc_id, unnest([array_to_string(w[i:i + m - 1], ' ') FOR i IN range(1, len(w) - m + 2)]) AS g
      FROM m, (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents)
      WHERE len(w) >= m)
SELECT doc_id, item_id, CAST(count(*) AS INTEGER) AS shared, CAST(n AS INTEGER) AS item_shingles,
       count(*) / CAST(n AS DOUBLE) AS containment
FROM x JOIN y USING (g) GROUP BY doc_id, item_id, n HAVING count(*) >= 0.8 * n""",
    "op9_topk": """
WITH v AS (SELECT vec_id, row_number() OVER () AS row,
                  list_transform(embedding, lambda e: floor(1024 * CAST(e AS DOUBLE))) AS x
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(
               embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
      FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER)
       AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""",
    "op12_prefix_trie": """
WITH RECURSIVE own AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
                              sha256(coalesce(text, ''))) AS i
    FROM conversations WHERE conv_id IS NOT NULL),
bits AS (SELECT conv_id, list_concat([4294967295], flatten(list_transform(
             string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [ord(c), -1, -1, -1, -1, -1, -1, -1, -1]))) AS b
         FROM (SELECT DISTINCT conv_id FROM own)),
h AS (SELECT conv_id, xor(CAST(4294967295 AS BIGINT), list_reduce(b, lambda a, e: CASE WHEN e >= 0
             THEN xor(CAST(a AS BIGINT), CAST(e AS BIGINT))
             ELSE xor(CAST(a AS BIGINT) >> 1, 3988292384 * (CAST(a AS BIGINT) & 1)) END)) % 6 AS h FROM bits),
seq AS (SELECT h.conv_id, 0 AS part, o.i, o.role, o.text
        FROM h JOIN own o ON o.conv_id = h.conv_id - h.conv_id % 100 AND o.i <= h.h
        UNION ALL SELECT h.conv_id, 1, o.i, o.role, o.text FROM h JOIN own o ON o.conv_id = h.conv_id AND o.i > h.h),
conv AS (SELECT h.conv_id, coalesce(list({'r': role, 't': text} ORDER BY part, i) FILTER (WHERE part IS NOT NULL), [])
             AS turns FROM h LEFT JOIN seq USING (conv_id) GROUP BY h.conv_id),
pre AS (SELECT conv_id, d, turns[1:d] AS path, len(turns) = d AS ends
        FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM conv)),
node AS (SELECT d, path, min(conv_id) AS conv_id, count(*) AS n_convs,
                CASE WHEN d > 0 THEN (count(*) - 1) * length(path[d].t) ELSE 0 END AS saved,
                sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)
                                FILTER (WHERE ends), '')) AS ends_sha256
         FROM pre GROUP BY d, path),
kids AS (SELECT d - 1 AS d, path[1:d - 1] AS path, count(*) AS n FROM node WHERE d > 0 GROUP BY 1, 2),
full_node AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids USING (d, path)),
up AS (SELECT v.saved, v.n_children, u.d AS d, v.path[1:u.d] AS path
       FROM full_node v, unnest(range(0, v.d + 1)) AS u(d)),
total AS (SELECT d, path, sum(saved) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves FROM up GROUP BY 1, 2)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children,
       t.leaves AS n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_node n JOIN total t USING (d, path) LEFT JOIN node p ON p.d = n.d - 1 AND p.path = n.path[1:n.d - 1]""",
    "op13_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda e: floor(256 * CAST(e AS DOUBLE))) AS x
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
               AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
             CAST(list_inner_product(a.x, c.x) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.x) = len(c.x) WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3""",
}

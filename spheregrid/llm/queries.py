"""The registered queries of this subpackage: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spheregrid.llm.bpe import encode_documents
from spheregrid.llm.chat import repair
from spheregrid.llm.common import documents
from spheregrid.llm.divergence import source_divergence
from spheregrid.llm.forest import forest_search
from spheregrid.llm.hmm import score_documents
from spheregrid.llm.jaccard import ngram_jaccard_join
from spheregrid.llm.langid import identify
from spheregrid.llm.mixing import mixture
from spheregrid.llm.packing import encoded_pieces, pack
from spheregrid.llm.sharding import stratified_shards
from spheregrid.llm.topk import exact_topk
from spheregrid.llm.toxicity import score_toxicity
from spheregrid.llm.trie import conversation_trie


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


def op3_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_documents(documents(spark, sf_dir))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op5_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = stratified_shards(documents(spark, sf_dir))
    return shards.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(documents(spark, sf_dir))


def op8_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return forest_search(vectors, vectors.where("vec_id % 20 = 0"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return exact_topk(vectors, vectors.where("vec_id % 50 = 0"))


def op10_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = encoded_pieces(documents(spark, sf_dir))
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: Exact integer scores of the stated query set, ranked.
OP9_SQL = """
WITH c AS (
  SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings WHERE vec_id IS NOT NULL
), v AS (
  SELECT vec_id, p, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS q FROM c
  WHERE vec_id NOT IN (SELECT vec_id FROM c WHERE x IS NULL OR NOT isfinite(x))
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(sum(a.q * b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.p = b.p AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 GROUP BY a.vec_id, b.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

#: The same keys, running sums and budgets in one pass of window functions.
OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS stratum
  FROM d GROUP BY source
), w AS (
  SELECT *, CASE (stratum - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, source_size * 2 AS stop FROM s
), l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS BIGINT) * CAST(1.5 AS DOUBLE)
             - CAST(coalesce(sum(stop) OVER (ORDER BY CAST(stop AS DOUBLE) / weight, stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
            / CAST(sum(weight) OVER (ORDER BY CAST(stop AS DOUBLE) / weight, stratum ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level
  FROM w
), f AS (
  SELECT (SELECT level FROM l WHERE level * weight <= stop ORDER BY CAST(stop AS DOUBLE) / weight, stratum LIMIT 1) AS settled
), t AS (
  SELECT source, source_size, coalesce(least(CAST(stop AS DOUBLE), settled * weight), CAST(stop AS DOUBLE)) AS target FROM l, f
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs,
         coalesce(CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - before)) AS BIGINT) AS taken
FROM r
"""


#: CRC-32 byte by byte with its table of 256 entries, then ranks, fractions and positions by window functions.
OP5_SQL = r"""
WITH t AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b)) AS t
), d AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: CAST('0x' || p AS BIGINT)) AS bytes
  FROM documents
), c AS (
  SELECT doc_id, source, CAST(size AS BIGINT) AS size,
         CAST(xor(list_reduce(bytes, lambda a, b: xor(a // 256, t.t[xor(a % 256, b) + 1]), 4294967295), 4294967295) AS BIGINT) AS text_crc32
  FROM d, t
), r AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS LAST) AS stratum, count(*) OVER (PARTITION BY source) AS n,
         row_number() OVER (PARTITION BY source ORDER BY md5('1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || text_crc32), doc_id) - 1 AS rank
  FROM c
), p AS (
  SELECT *, row_number() OVER (ORDER BY (2 * rank + 1)::DOUBLE / (2 * n), stratum) - 1 AS position, count(*) OVER () AS total FROM r
), s AS (SELECT *, CAST(floor(position * 8 / total) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, CAST(position - ceil(shard * total / 8) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""

#: All pairs by shared shingles, and the smallest id reachable by the links.
OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT doc_id, len(w) AS many, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM w
), s AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, many, i, concat_ws(' ', a, lead(a, 1) OVER d, lead(a, 2) OVER d, lead(a, 3) OVER d, lead(a, 4) OVER d) AS s
    FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY i))
  WHERE i <= greatest(1, many - 4)
), n AS (
  SELECT w.doc_id, count(s.s) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id
), l AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n AS x ON x.doc_id = p.a JOIN n AS y ON y.doc_id = p.b WHERE 100 * p.m >= 80 * (x.n + y.n - p.m)
), c(doc_id, reached) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT c.doc_id, l.b FROM c JOIN l ON l.a = c.reached
)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(c.reached) AS component_id FROM n JOIN c ON c.doc_id = n.doc_id GROUP BY n.doc_id, n.n
"""

#: Prefixes as lists of turns, and every subtree as the nodes whose lists begin with its top's.
OP11_SQL = """
WITH t AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b)) AS t
), o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
         md5(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL
), i AS (
  SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id
), h AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         xor(list_reduce(list_transform(regexp_extract_all(CAST(conv_id AS VARCHAR), '.'), lambda c: ascii(c)), lambda a, b: xor(a // 256, t.t[xor(a % 256, b) + 1]), 4294967295), 4294967295) % 6 AS h
  FROM i, t
), m AS (
  SELECT h.*, least(h.h, coalesce(b.n, 0)) AS had FROM h LEFT JOIN i b ON b.conv_id = h.base
), r AS (
  SELECT m.conv_id, o.place + 1 AS depth, o.role, o.text FROM m JOIN o ON o.conv_id = m.base WHERE o.place < m.h
  UNION ALL
  SELECT m.conv_id, m.had + o.place - m.h + 1, o.role, o.text FROM m JOIN o ON o.conv_id = m.conv_id WHERE o.place >= m.h
), p AS (
  SELECT conv_id, depth, text, list(struct_pack(r := role, t := text)) OVER (PARTITION BY conv_id ORDER BY depth) AS key FROM r
  UNION ALL
  SELECT conv_id, 0, '', [] FROM i
), e AS (
  SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p
), n AS (
  SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, length(any_value(text)) AS length,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM e GROUP BY key, depth
), c AS (
  SELECT n.*, u.conv_id AS parent_conv_id, (SELECT count(*) FROM n k WHERE k.depth = n.depth + 1 AND k.key[1:n.depth] = n.key) AS n_children
  FROM n LEFT JOIN n u ON u.depth = n.depth - 1 AND u.key = n.key[1:n.depth - 1]
)
SELECT CAST(a.conv_id AS BIGINT) AS conv_id, CAST(a.depth AS BIGINT) AS depth, CAST(a.parent_conv_id AS BIGINT) AS parent_conv_id, CAST(a.n_convs AS BIGINT) AS n_convs, CAST(a.n_children AS BIGINT) AS n_children,
       CAST(count(*) FILTER (WHERE b.n_children = 0) AS BIGINT) AS n_leaves, CAST(sum((b.n_convs - 1) * b.length) AS BIGINT) AS saved_tokens, a.ends_sha256
FROM c a JOIN c b ON b.depth >= a.depth AND b.key[1:a.depth] = a.key
GROUP BY a.key, a.conv_id, a.depth, a.parent_conv_id, a.n_convs, a.n_children, a.ends_sha256
"""

#: Every share of every kept term, and the costs of all pairs of sources over the whole vocabulary.
OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), w AS (
  SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 3
), c AS (
  SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term
), v AS (
  SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang
), g AS (
  SELECT lang, source, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source) USING (lang, source)
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
         1 + CAST(1000000000 * (coalesce(c.c, 0) + 1) AS HUGEINT) // CAST(g.n + v.v AS HUGEINT) AS p,
         1 + CAST(1000000000 * (k.c + 1) AS HUGEINT) // CAST(v.n + v.v AS HUGEINT) AS q
  FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), s AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM r QUALIFY part = 'pair' OR rank <= 200
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_jaccard_join": OP1_SQL, "op5_stratified_shards": OP5_SQL, "op7_mixture": OP7_SQL, "op9_exact_topk": OP9_SQL, "op11_conversation_trie": OP11_SQL, "op13_divergence_audit": OP13_SQL}

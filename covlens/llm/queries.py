"""Queries of the training-data operators: each applies its operator to the whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroid_clustering, conversation_repair, html_extraction, language_id, language_model, pii, quality
from .common import read_table
from .exact_dedup import exact_duplicates
from .decontamination import contaminated
from .near_dedup import near_duplicates
from .packing import pack
from .sharding import shard
from .substring_dedup import repeated_passages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return wrap


@register("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.train(docs))


@register("op2_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 2], ' ') AS s FROM
  (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, both_ways.y FROM reach JOIN both_ways ON reach.r = both_ways.x),
least AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN least ON d.doc_id = least.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""


@register("op3_near_dedup", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"), shingle_words=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@register("op4_sharding")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(read_table(spark, sf_dir, "documents"), shards=40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@register("op5_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


OP6_SQL = """
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""


@register("op6_exact_dedup", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = exact_duplicates(read_table(spark, sf_dir, "documents"))
    return verdicts.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@register("op8_decontamination")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 34], ' ') AS s FROM places WHERE p + 34 <= len(w)),
rep AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
starts AS (SELECT doc_id, p FROM win JOIN rep ON win.s = rep.s),
gone AS (SELECT DISTINCT doc_id, p + k AS p FROM starts CROSS JOIN range(0, 35) AS r(k)),
kept AS (SELECT a.doc_id, count(*) AS n_words, count(g.p) AS n_removed,
  coalesce(string_agg(CASE WHEN g.p IS NULL THEN a.w[a.p] END, ' ' ORDER BY a.p), '') AS text
  FROM places a LEFT JOIN gone g ON a.doc_id = g.doc_id AND a.p = g.p GROUP BY a.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


@register("op10_substring_dedup", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read_table(spark, sf_dir, "documents"), window=35)


@register("op9_html_extraction")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return html_extraction.extract(pages, html_extraction.train(pages))


@register("op7_pii")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return pii.find(docs, pii.train(docs))


@register("op11_conversation_repair")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_damaged(read_table(spark, sf_dir, "conversations"))


def _op12_sql() -> str:
    nearest = """(SELECT r, any_value(vec_id) AS vec_id, any_value(v.v) AS v, min(struct_pack(d := list_sum(list_transform(list_zip(v.v, c.v),
      lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, c := c)) AS m FROM v CROSS JOIN c{i} AS c GROUP BY r)"""
    parts = ["""v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
      FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
      """c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v
      FROM (SELECT sha256('3:' || vec_id) AS h, v FROM v ORDER BY h, v LIMIT 8))"""]
    for i in range(centroid_clustering.ROUNDS):
        parts.append(f"""u{i} AS MATERIALIZED (SELECT c, list(f ORDER BY i) AS v FROM (SELECT c, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS f FROM
      (SELECT m.c AS c, i, sum(x)::HUGEINT AS s, count(*) AS n FROM (SELECT m, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM {nearest.format(i=i)})
       GROUP BY 1, 2)) GROUP BY c)""")
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(u.v, o.v) AS v FROM c{i} AS o LEFT JOIN u{i} AS u ON o.c = u.c)")
    last = centroid_clustering.ROUNDS
    return f"""WITH {", ".join(parts)}
    SELECT vec_id, m.c::INTEGER AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.c))::BIGINT AS cluster_inertia,
      (sum(m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{last}.v, ',')) AS centroid_sha256
    FROM {nearest.format(i=last)} AS a JOIN c{last} ON a.m.c = c{last}.c"""


@register("op12_centroid_clustering", _op12_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.cluster(read_table(spark, sf_dir, "embeddings"))


@register("op13_lm_scoring")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(read_table(spark, sf_dir, "documents"))

"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import divergence, embedding_dedup, exact_dedup, filter_audit, html_text, language_id, licenses, mixing, near_dup, packing, quality, token_store, url_filters


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = exact_dedup.temporary_index(spark)
    found = exact_dedup.deduplicate(docs, index)
    index.drop()
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP4_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality.score(docs, quality.train(docs, labels)).withColumnRenamed("id", "doc_id")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page counts as fetched on a day of 2024 by its id; lists grow out of the pages themselves.

    A page may report its host, withdraw a report, report the domain above its host, or vouch for the
    first segment of its path, on the day it is fetched.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") % 366 * 86400).alias("at"))
    name, turn = url_filters.host(F.col("url")), F.col("page_id") % 10
    segment = F.regexp_extract(url_filters.path(F.col("url")), "^/([^/]+)", 1)
    pattern = F.when(turn.isin(0, 5), name).when((turn == 3) & ~name.rlike(url_filters.ADDRESS) & (F.size(F.split(name, r"\.")) > 3), F.regexp_replace(name, r"^[^.]*\.", "")).when((turn == 7) & (segment != ""), F.concat(name, F.lit("/"), segment))
    entries = pages.select(
        F.when(turn == 3, "operators").when(turn == 7, "trusted").otherwise("reports").alias("list"),
        F.when(turn == 7, "allow").otherwise("block").alias("action"), pattern.alias("pattern"), (turn != 5).alias("listed"), "at",
    ).filter("pattern is not null")
    found = url_filters.judge(pages, entries)
    return found.select(F.col("id").alias("page_id"), F.date_format("at", "yyyy-MM-dd").alias("fetched_on"), "n_active", "block_pattern", "allow_pattern", "blocked")


OP2_SQL = r"""
WITH p AS (
  SELECT page_id, make_date(2024, 1, 1) + CAST(page_id % 366 AS INTEGER) AS day, page_id % 10 AS turn,
    lower(regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)', 1), '\.$', '')) AS host,
    list_filter(string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda s : s <> '') AS parts
  FROM pages),
k AS (SELECT *, CASE WHEN regexp_matches(host, '^(\[.*|[0-9]+(\.[0-9]+){3})$') THEN [host] ELSE string_split(host, '.') END AS labels FROM p),
e AS (
  SELECT CASE turn WHEN 3 THEN 'operators' WHEN 7 THEN 'trusted' ELSE 'reports' END AS list_name,
    CASE turn WHEN 7 THEN 'allow' ELSE 'block' END AS action,
    CASE WHEN turn IN (0, 5) THEN host WHEN turn = 3 AND len(labels) > 3 THEN array_to_string(labels[2:], '.')
      WHEN turn = 7 AND len(parts) > 0 THEN host || '/' || parts[1] END AS pattern, turn <> 5 AS listed, day
  FROM k),
o AS (SELECT list_name, action, pattern, day, bool_and(listed) AS listed FROM e WHERE pattern IS NOT NULL GROUP BY ALL),
v AS (SELECT list_name, action, pattern, listed, day AS since, lead(day, 1, make_date(9999, 12, 31)) OVER (PARTITION BY list_name, action, pattern ORDER BY day) AS until FROM o),
x AS (
  SELECT page_id, day, unnest(list_concat(
    list_transform(range(1, greatest(len(labels) - 1, 1) + 1), lambda i: array_to_string(labels[i:], '.')),
    list_transform(range(1, len(parts) + 1), lambda i: host || '/' || array_to_string(parts[1:i], '/')))) AS pattern
  FROM k WHERE host <> ''),
m AS (
  SELECT page_id, count(*) AS n_active, max({'n': length(x.pattern), 'pattern': x.pattern}) FILTER (action = 'block') AS b,
    max({'n': length(x.pattern), 'pattern': x.pattern}) FILTER (action = 'allow') AS a
  FROM x JOIN v ON x.pattern = v.pattern AND listed AND since <= day AND day < until GROUP BY page_id)
SELECT page_id, strftime(day, '%Y-%m-%d') AS fetched_on, coalesce(n_active, 0) AS n_active, b.pattern AS block_pattern, a.pattern AS allow_pattern,
  b IS NOT NULL AND coalesce(b.n > a.n, true) AS blocked
FROM p LEFT JOIN m USING (page_id)
"""


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i : array_to_string(w[i : i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_n FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * both_n >= 85 * (a.n + b.n - both_n)),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(y) FROM r WHERE r.x = d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = licenses.scan(docs, licenses.train(docs))
    return found.select(F.col("id").alias("doc_id"), "n_paragraphs", F.array_join(F.array_sort(F.array_distinct("families")), ",").alias("families"), F.size("families").alias("n_notices"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select(F.col("id").alias("page_id"), "text", html_text.line_count(F.col("text")).alias("n_lines"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, manifest = token_store.write_tokens(docs, end_id=2)
    found = token_store.read_digests(folder, manifest)
    return found.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_dup.near_duplicates(docs, size=4, percent=85).withColumnRenamed("id", "doc_id")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packing.best_fit(docs, capacity=2048, end_id=0).withColumnRenamed("id", "doc_id")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixing.mix(docs, weights=(5, 2, 1), share=1.5, cap=2.0).withColumnRenamed("id", "doc_id")


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return embedding_dedup.near_duplicates(vectors, cosine=0.95).withColumnRenamed("id", "vec_id")


OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
c AS (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY x)
SELECT vec_id, (SELECT count(*) FROM l WHERE x = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c
"""


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return language_id.identify(docs, language_id.train(docs)).withColumnRenamed("id", "doc_id")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH d AS (SELECT coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS i FROM documents),
w AS (SELECT lang, source, i, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lc FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 30),
n AS (SELECT lang, count(*) AS v, sum(lc) AS ln FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
t AS (SELECT lang, source, sum(c) AS gn FROM c GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
    1 + CAST(1000000000 * (coalesce(c.c, 0)::HUGEINT + 5) // (coalesce(t.gn, 0) + 5 * v)::HUGEINT AS BIGINT) AS p,
    1 + CAST(1000000000 * (lc::HUGEINT + 5) // (ln + 5 * v)::HUGEINT AS BIGINT) AS q
  FROM g JOIN k USING (lang) JOIN n USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN t ON t.lang = g.lang AND t.source = g.source),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
y AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q),
z AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM y)
SELECT * FROM z WHERE part = 'pair' OR rank <= 50
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return filter_audit.audit(docs, labels)


OP13_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents),
m AS (
  SELECT part, doc_id, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
    + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first_id, false)::INT AS mask FROM w),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
c AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM m LEFT JOIN l ON l.doc_id = m.doc_id GROUP BY part, mask),
o(filter_order, used) AS (
  SELECT '', 0 UNION ALL
  SELECT filter_order || chr(65 + f), used + (1 << f) FROM o, (SELECT unnest(range(0, 5))::INT AS f) WHERE used & (1 << f) = 0),
s AS (
  SELECT filter_order, step::INT AS step, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS bit,
    list_sum(list_transform(range(1, step), lambda i : 1 << (ascii(substr(filter_order, i, 1)) - 65)))::INT AS before
  FROM o, (SELECT unnest(range(1, 6)) AS step) WHERE length(filter_order) = 5),
r AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & (coalesce(before, 0) | bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & coalesce(before, 0) = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & coalesce(before, 0) <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & coalesce(before, 0) = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & coalesce(before, 0) = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_quality_classifier, op2_url_filters, op3_token_files, op4_exact_dedup, op5_ngram_jaccard_join, op6_license_scans, op7_html_extraction, op8_best_fit_packing, op9_source_mixing, op10_embedding_near_dedup,
        op11_language_id, op12_source_divergence, op13_filter_audit,
    )
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": OP2_SQL, "op4_exact_dedup": OP4_SQL, "op5_ngram_jaccard_join": OP5_SQL, "op10_embedding_near_dedup": OP10_SQL, "op12_source_divergence": OP12_SQL, "op13_filter_audit": OP13_SQL}

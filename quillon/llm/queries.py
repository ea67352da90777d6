"""One query per operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.storage import table


def op1_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.sharding import shard_digest

    return shard_digest(table(spark, sf_dir, "documents"))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.warc import archive_digest

    return archive_digest(table(spark, sf_dir, "pages"))


def op3_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.licenses import license_digest

    return license_digest(table(spark, sf_dir, "documents"))


def op4_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.ogg import media_digest

    return media_digest(table(spark, sf_dir, "documents"))


def op5_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.langid import language_digest

    return language_digest(table(spark, sf_dir, "documents"))


def op6_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.recompression import remove_repeats_digest

    return remove_repeats_digest(table(spark, sf_dir, "documents"))


def op7_min_max_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.neardup import near_duplicate_digest

    return near_duplicate_digest(table(spark, sf_dir, "documents"))


def op8_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.mixing import mix_digest

    return mix_digest(table(spark, sf_dir, "documents"))


def op9_neighbour_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.quality import quality_digest

    return quality_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.decontam import contamination_digest

    return contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.whitening import whitening_digest

    return whitening_digest(table(spark, sf_dir, "embeddings"))


def op12_louds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.tries import trie_digest

    return trie_digest(table(spark, sf_dir, "conversations"))


def op13_harmonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.packing import packing_digest

    return packing_digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name -> query, in the order of the operators."""
    named = [f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()]
    return {f.__name__: f for f in sorted(named, key=lambda f: int(f.__name__[2:].split("_")[0]))}


OP2_SQL = """
WITH full_pages AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), groups AS (
  SELECT payload_digest, max(page_id) AS original FROM full_pages WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN original IS NULL OR page_id = original OR payload_bytes < 1000 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original AND payload_bytes >= 1000 THEN original END AS refers_to
FROM full_pages LEFT JOIN groups USING (payload_digest)
"""

OP6_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), windows AS (
  SELECT r, doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) AS h
  FROM words, LATERAL (SELECT unnest(generate_series(1, len(w) - 19)) AS i) WHERE len(w) >= 20
), ranked AS (
  SELECT r, doc_id, i, min((doc_id, i)) OVER (PARTITION BY h) AS first FROM windows
), gone AS (
  SELECT DISTINCT r, unnest(generate_series(i, i + 19)) AS k FROM ranked WHERE (doc_id, i) > first
), lists AS (SELECT r, list(k) AS ks FROM gone GROUP BY r),
kept AS (
  SELECT w.r, w.doc_id, len(w.w) AS n, coalesce(len(ks), 0) AS n_removed,
    list_filter(w.w, lambda x, k: ks IS NULL OR NOT list_contains(ks, k)) AS left_over
  FROM words w LEFT JOIN lists USING (r)
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(left_over, ' '), '')) AS kept_sha256 FROM kept
"""

OP7_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(2, len(w)) - 1], ' ') AS s
  FROM words, LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - 1, 1))) AS i) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM words
  UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.seen
), lowest AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT w.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, l.component_id, w.doc_id = l.component_id AS kept
FROM words w LEFT JOIN sizes s USING (doc_id) JOIN lowest l ON l.node = w.doc_id
"""

OP10_SQL = r"""
WITH words AS (
  SELECT item_id, regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM benchmark)
), patterns AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS p, least(13, len(w)) AS m
  FROM words, LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i) WHERE len(w) > 0
), lengths AS (SELECT DISTINCT m FROM patterns),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), windows AS (
  SELECT r, i, m, array_to_string(w[i : i + m - 1], ' ') AS p
  FROM docs, lengths, LATERAL (SELECT unnest(generate_series(1, len(w) - m + 1)) AS i) WHERE len(w) >= m
), found AS (SELECT r, i, m, item_id FROM windows JOIN patterns USING (p, m)),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + m - 1)) AS k FROM (SELECT DISTINCT r, i, m FROM found)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS items_sha256
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

# CRC-32 is taken bit by bit, from the polynomial 0xEDB88320.
OP12_SQL = r"""
WITH ranked AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list(md5(concat(strlen(role), ':', role, text)) ORDER BY k) AS t,
    list(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) ORDER BY k) AS w FROM ranked GROUP BY conv_id
), heads AS (
  SELECT conv_id, t, w, xor(list_reduce(list_prepend(4294967295, list_transform(str_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda s, b: list_reduce(list_prepend(xor(s, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295) % 4 AS h
  FROM own
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.t[1 : c.h], []), c.t[c.h + 1 :]) AS t, list_concat(coalesce(b.w[1 : c.h], []), c.w[c.h + 1 :]) AS w
  FROM heads c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20
), steps AS (
  SELECT conv_id, d, md5(array_to_string(t[1 : d], ',')) AS node, CASE WHEN d > 0 THEN md5(array_to_string(t[1 : d - 1], ',')) END AS up,
    CASE WHEN d > 0 THEN w[d] ELSE 0 END AS words, d = len(t) AS ends
  FROM rebuilt, LATERAL (SELECT unnest(generate_series(0, len(t))) AS d)
), nodes AS (
  SELECT d, node, any_value(up) AS up, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM steps GROUP BY d, node
), kids AS (SELECT d - 1 AS d, up AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY d, up),
told AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (d, node)),
below AS (
  SELECT s.d, s.node, sum(CASE WHEN n.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
  FROM told n JOIN steps s ON s.conv_id = n.conv_id AND s.d <= n.d GROUP BY s.d, s.node
)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(n.n_children AS BIGINT) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM told n JOIN below USING (d, node) LEFT JOIN nodes p ON p.d = n.d - 1 AND p.node = n.up
"""


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL with the same result."""
    return {"op2_warc_revisits": OP2_SQL, "op6_recompression": OP6_SQL, "op7_min_max_hash": OP7_SQL, "op10_wu_manber": OP10_SQL, "op12_louds": OP12_SQL}

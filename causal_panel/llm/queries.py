"""One registered query per operator, over the whole of its table, and SQL twins where SQL can express it."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bbit, collocations, covertree, decontam, htmltext, mixing, quality, repeats, simhash, surrogates, toxicity, urlrules, warc
from .common import table

#: Production parameters of the queries. The key is read from a secret store in use; a fixed one makes reruns comparable here.
SURROGATE_KEY = b"surrogates of the registered query"
URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


def source_weight():
    """3, 1, 2, repeating, by the source's place."""
    return F.element_at(F.array(F.lit(3), F.lit(1), F.lit(2)), (F.col("place") % 3 + 1).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace_entities(docs, SURROGATE_KEY, count_col="n_entities")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), source_weight()).select("doc_id", "size", "source_size", "target", "taken")


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words", "n_same_words", "n_shouts")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_text(table(spark, sf_dir, "pages"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_index(spark, warc.write_archive(table(spark, sf_dir, "pages")))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bbit.near_copies(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return covertree.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_surrogates, op3_simhash, op4_repeats, op5_mixing, op6_urls, op7_quality, op8_main_text, op9_decontamination, op10_warc, op11_minhash, op12_hard_negatives, op13_collocations)}

_HOST_PATH = r"""
SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
       regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
"""

SQL = {
    "op6_urls": f"""
WITH u AS ({_HOST_PATH}),
r AS (SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM r""",
    "op10_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n < 100 OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n < 100 OR page_id = first THEN NULL ELSE first END AS refers_to FROM f""",
    "op11_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
sets AS (SELECT s, row_number() OVER (ORDER BY min(doc_id)) AS node, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM s WHERE len(s) > 0) GROUP BY s),
items AS MATERIALIZED (SELECT node, n, unnest(s) AS item FROM sets),
-- two sets over the limit share an item among the first n - ceil(0.8 n) + 1 of each, taken from the rarest
ranked AS (SELECT node, n, items.item, row_number() OVER (PARTITION BY node ORDER BY c, items.item) AS place
           FROM items JOIN (SELECT item, count(*) AS c FROM items GROUP BY item) f ON f.item = items.item),
heads AS (SELECT node, n, item FROM ranked WHERE place <= n - ceil(0.8 * n) + 1),
pairs AS MATERIALIZED (SELECT DISTINCT a.node AS a, b.node AS b FROM heads a JOIN heads b ON a.item = b.item AND a.node < b.node AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN sets x ON x.node = a JOIN sets y ON y.node = b
          WHERE 100 * len(list_intersect(x.s, y.s)) >= 80 * (x.n + y.n - len(list_intersect(x.s, y.s)))),
reach AS (SELECT node AS a, node AS b FROM sets UNION
          SELECT r.a, l.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON l.a = r.b),
root AS (SELECT a AS node, min(b) AS root FROM reach GROUP BY a),
docs AS (SELECT doc_id, s.s AS s, node FROM s LEFT JOIN sets ON list_sort(s.s) = sets.s),
named AS (SELECT doc_id, coalesce(len(s), 0) AS n, root FROM docs LEFT JOIN root USING (node)),
best AS (SELECT root, min(doc_id) AS component_id FROM named WHERE root IS NOT NULL GROUP BY root)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(doc_id = coalesce(component_id, doc_id), false) AS kept
FROM named LEFT JOIN best USING (root)""",
    "op13_collocations": r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM t),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: list_slice(w, i, i + k - 1))) AS p FROM pieces, range(1, 5) r(k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, p, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
longer AS (SELECT lang, list_slice(p, i, i + m - 1) AS p, max(f) AS longer FROM f, range(2, 4) a(m), range(1, 4) b(i) WHERE k > 2 AND m < k AND i + m - 1 <= k GROUP BY ALL),
kept AS (SELECT f.* FROM f LEFT JOIN longer USING (lang, p) WHERE k > 1 AND (longer IS NULL OR 100 * longer < 80 * f)),
cuts AS (SELECT c.lang, c.p, c.f AS a, i, x.f AS l, y.f AS r, (2000000::HUGEINT * c.f) // (x.f::HUGEINT + y.f) AS score
         FROM kept c JOIN range(1, 4) b(i) ON i < c.k JOIN f x ON x.lang = c.lang AND x.p = list_slice(c.p, 1, i) JOIN f y ON y.lang = c.lang AND y.p = list_slice(c.p, i + 1, c.k)),
best AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, i) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM best JOIN totals USING (lang) QUALIFY rank <= 2000""",
    "op12_hard_negatives": """
WITH r AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, r.vec_id, r.label, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score FROM r a JOIN r ON a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label AND vec_id <> anchor_id
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND label <> anchor_label AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10""",
}

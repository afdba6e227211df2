"""Registered queries of this package, their production parameters and comparison SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm import (
    block_text, chunk_dedup, collocations, cover_topk, mixture, piece_codec, quality, simhash, suffix_dedup, toxicity, url_rules, window_dedup, word_runs,
)
from loomtrace.llm.common import table

TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encoding_digests(table(spark, sf_dir, "documents"), piece_codec.load(TOKENIZER))


def op2_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_dedup.window_digests(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_cover_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_topk.top_k(table(spark, sf_dir, "embeddings"), k=10, scale=1024, every=100)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.byte_digests(table(spark, sf_dir, "documents"))


def op6_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix_sizes(table(spark, sf_dir, "documents")).drop("source")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [F.struct(*[F.lit(x).alias(c) for x, c in zip(rule, ("host", "path", "action"))]) for rule in URL_RULES]
    rules = spark.range(1).select(F.inline(F.array(*rows)))
    return url_rules.judge(table(spark, sf_dir, "pages"), rules)


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_runs.run_digests(word_runs.with_repeated_tails(table(spark, sf_dir, "documents")))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_text.main_text(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_window_dedup": op2_window_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_cover_topk": op4_cover_topk,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_mixture": op6_mixture,
    "op7_simhash": op7_simhash,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_quality": op9_quality,
    "op10_url_rules": op10_url_rules,
    "op11_word_runs": op11_word_runs,
    "op12_collocations": op12_collocations,
    "op13_main_text": op13_main_text,
}

ORACLES = {
    "op2_window_dedup": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w
), h AS (
  SELECT doc_id, i, array_to_string(words[i : i + 34], ' ') AS win FROM s
), r AS (
  SELECT doc_id, i FROM h WHERE win IN (SELECT win FROM h GROUP BY win HAVING count(*) > 1)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM r
), g AS (
  SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id
), k AS (
  SELECT doc_id, words, coalesce(ps, []) AS ps FROM w LEFT JOIN g USING (doc_id)
), u AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w
), kept AS (
  SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.p) AS text FROM u ANTI JOIN gone ON u.doc_id = gone.doc_id AND u.p = gone.p GROUP BY u.doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(ps) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM k LEFT JOIN kept USING (doc_id)""",
    "op4_cover_topk": """
WITH v AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(1024 * x) AS BIGINT)) AS c FROM embeddings
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.c, v.c), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10""",
    "op6_mixture": r"""
WITH s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS k
  FROM documents
), g AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source COLLATE "binary") AS r FROM s GROUP BY source
), w AS (
  SELECT source, source_size, 2 * source_size AS most, CASE r % 3 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS weight FROM g
), p AS (
  SELECT *, row_number() OVER a AS n, coalesce(sum(most) OVER a, 0) AS closed, sum(weight) OVER () - coalesce(sum(weight) OVER a, 0) AS open_weight, sum(source_size) OVER () AS total
  FROM w WINDOW a AS (ORDER BY most / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT arg_min(CAST(1.5 * total - closed AS DOUBLE) / open_weight, n) FILTER (CAST(1.5 * total - closed AS DOUBLE) / open_weight <= most / weight) AS level FROM p
), t AS (
  SELECT source, source_size, least(CAST(most AS DOUBLE), (SELECT level FROM l) * weight) AS target FROM w
), o AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - s.size AS before
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE size * (budget // source_size) + greatest(0, least(size, budget % source_size - before)) END AS BIGINT) AS taken
FROM o""",
    "op8_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op10_url_rules": """
WITH rules(rh, rp, action) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u
), q AS (
  SELECT row_number() OVER () AS n, page_id, lower(raw) AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h
), m AS (
  SELECT n, max_by(rh || rp, length(rh || rp)) AS rule, max_by(action, length(rh || rp)) AS action
  FROM q JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY n
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM q LEFT JOIN m USING (n)""",
    "op11_word_runs": r"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o,
         list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)) AS digits
  FROM documents
), h AS (
  SELECT id, doc_id, o, CAST(len(o) AS BIGINT) AS n, xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || digits, lambda c, b:
           list_reduce([xor(c, b)] || range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384)))) AS h
  FROM d
), p AS (
  SELECT *, (h // 10) % n AS a, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) AS p FROM h
), w AS (
  SELECT id, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: o[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE o END AS w FROM p
), q AS (
  SELECT id, n, w, unnest(range(1, n // 4 + 1)) AS q FROM w
), k AS (
  SELECT id, n, w, q, unnest(range(0, (n - 1) // q - 2)) AS k FROM q
), c AS (
  SELECT DISTINCT id, q FROM k
  WHERE w[k * q + 1] = w[k * q + q + 1] AND w[k * q + 1] = w[k * q + 2 * q + 1] AND w[k * q + 1] = w[k * q + 3 * q + 1]
    AND w[k * q + 1 : k * q + 2 * q] = w[k * q + q + 1 : k * q + 3 * q]
), i AS (
  SELECT id, q, w, unnest(range(0, n - q)) AS i FROM c JOIN w USING (id)
), same AS (
  SELECT id, q, i, i - row_number() OVER (PARTITION BY id, q ORDER BY i) AS island FROM i WHERE w[i + 1] = w[i + q + 1]
), stretch AS (
  SELECT id, q, min(i) AS start, count(*) + q AS length FROM same GROUP BY id, q, island HAVING count(*) + q >= greatest(6, 4 * q)
), r AS (
  SELECT id, start, length, min(q) AS q FROM stretch GROUP BY ALL
), gone AS (
  SELECT DISTINCT id, unnest(range(start + q, start + length)) AS i FROM r
), u AS (
  SELECT id, unnest(w) AS word, unnest(range(n)) AS i FROM w
), kept AS (
  SELECT id, string_agg(word, ' ' ORDER BY i) AS text FROM u ANTI JOIN gone USING (id, i) GROUP BY id
), best AS (
  SELECT id, count(*) OVER (PARTITION BY id) AS n_runs, start, length, q,
         string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) OVER (PARTITION BY id) AS listed
  FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY length DESC, start, q) = 1
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, q AS period, 1000 * length // q AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM w LEFT JOIN best USING (id) LEFT JOIN kept USING (id)""",
    "op12_collocations": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), g AS (
  SELECT lang, s, unnest([array_to_string(w[i : i + s - 1], ' ') FOR i IN range(1, len(w) - s + 2)]) AS phrase FROM w, range(1, 4) AS r(s)
), n AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang
), f AS (
  SELECT lang, s, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10
), c AS (
  SELECT lang, s, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, s)) AS k FROM f WHERE s > 1
), cuts AS (
  SELECT c.*, x.f AS l, y.f AS r, (1000000 :: HUGEINT * a * a) // (x.f :: HUGEINT * y.f) AS score
  FROM c JOIN f AS x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[: k], ' ') JOIN f AS y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1 :], ' ')
), b AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, phrase, max(f) AS longer FROM (
    SELECT lang, f, unnest([array_to_string(w[: 2], ' '), array_to_string(w[2 :], ' ')]) AS phrase FROM (SELECT lang, f, string_split(phrase, ' ') AS w FROM f WHERE s = 3)
  ) GROUP BY ALL
)
SELECT lang, row_number() OVER o AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM b LEFT JOIN inside USING (lang, phrase) JOIN n USING (lang) WHERE coalesce(100 * longer < 50 * a, true)
WINDOW o AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "binary") QUALIFY row_number() OVER o <= 2000""",
    "op13_main_text": r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS body FROM pages
), b AS (
  SELECT page_id, url, unnest(regexp_split_to_array(regexp_replace(body, '<b>|</b>|<br>', ' ', 'g'), '<[^>]*>')) AS raw, unnest(range(len(regexp_split_to_array(regexp_replace(body, '<b>|</b>|<br>', ' ', 'g'), '<[^>]*>')))) AS i FROM a
), c AS (
  SELECT page_id, url, i, trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(raw, '&quot;?', '"', 'g'), '&(lt|gt);', '<', 'g'), '&amp;', '&'), '&amp', '&'), chr(160), ' '), '\s+', ' ', 'g')) AS block FROM b
)
SELECT page_id, url, coalesce(string_agg(block, chr(10) ORDER BY i) FILTER (block <> ''), '') AS text,
       CAST(length(coalesce(string_agg(block, chr(10) ORDER BY i) FILTER (block <> ''), '')) AS BIGINT) AS n_chars
FROM c GROUP BY page_id, url""",
}

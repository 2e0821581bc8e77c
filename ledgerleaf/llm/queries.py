"""The registered queries over the whole given tables, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerleaf.llm import bpe, dense_search, html_extract, language_id, minhash, mixing, ordinal, pii, quality_rules, resampling, sharding, telephony, token_counts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and risk-controlled cutoffs of every document; strata are languages."""
    return quality_rules.apply_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by nearest-URL differencing."""
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by hyperdimensional profiles."""
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of near-equal bytes by longest-processing-time scheduling of equal texts."""
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), 40)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document by weak supervision."""
    return pii.find(_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix of sources takes of each document, by Pareto order sampling."""
    mix = mixing.take(_table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op7_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as telephony audio, read back, expanded and resampled."""
    return telephony.media_report(telephony.with_pcm(telephony.store(_table(spark, sf_dir, "documents"))))


def op8_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, probability of the top grade and verdict of every document."""
    return ordinal.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: ids of the byte-level BPE and the bytes decoded from them, as digests."""
    return bpe.digests(_table(spark, sf_dir, "documents"), RANKS, PATTERN)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of all documents: 3-word shingles, similarity of 85 % or more."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), 3, 85)


def op11_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document and its longest prefix within 2,048 of them, by prefix dynamic programming."""
    return token_counts.count(_table(spark, sf_dir, "documents"), WORD_BPE, 2048)


def op12_dense_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of all for every benchmark item, by exact blocked matrix products."""
    return dense_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 50)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document: a twentieth of them drawn to resemble the benchmark texts."""
    drawn = resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op1_quality_rules": op1_quality_rules, "op2_html_extract": op2_html_extract, "op3_language_id": op3_language_id, "op4_shards": op4_shards, "op5_pii": op5_pii, "op6_mixing": op6_mixing, "op7_telephony": op7_telephony, "op8_ordinal": op8_ordinal, "op9_byte_bpe": op9_byte_bpe, "op10_minhash": op10_minhash, "op11_prefix_counts": op11_prefix_counts, "op12_dense_search": op12_dense_search, "op13_resampling": op13_resampling}

#: The mix without bins: every source's documents ranked row by row, taken while the middle of a document lies within what the whole copies leave.
OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
l AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS fill,
  (1.5e0 * (sum(source_size) OVER ())::BIGINT - 2 * coalesce((sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0))
  / (sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level FROM w),
o AS (SELECT *, min(CASE WHEN level * weight < 2 * source_size THEN fill END) OVER () AS first_open FROM l),
t AS (SELECT *, CASE WHEN first_open IS NULL OR fill < first_open THEN 2e0 * source_size ELSE (SELECT max(level) FROM o x WHERE x.fill = x.first_open) * weight END AS target FROM o),
v AS (SELECT source, length(bin(size)) AS preference, sum(size)::BIGINT AS words FROM d GROUP BY 1, 2),
c AS (SELECT v.*, source_size, target, coalesce((target - 2 * coalesce((sum(words) OVER (PARTITION BY v.source ORDER BY preference DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0))
  / nullif((sum(preference * words) OVER (PARTITION BY v.source ORDER BY preference DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT, 0), 0e0) AS rate FROM v JOIN t ON v.source IS NOT DISTINCT FROM t.source),
h AS (SELECT *, max(CASE WHEN rate * preference < 2 THEN preference END) OVER (PARTITION BY source) AS top FROM c),
g AS (SELECT *, max(CASE WHEN preference = top THEN rate END) OVER (PARTITION BY source) AS top_rate FROM h),
r AS (SELECT d.doc_id, d.source, d.size, source_size, target, CASE WHEN preference <= top THEN greatest(top_rate * preference, 0e0) ELSE 2e0 END AS wanted,
  (('0x' || substr(md5(concat(coalesce(d.doc_id::VARCHAR, 'null'), ':mix')), 1, 13))::BIGINT + 0.5e0) / 4503599627370496e0 AS u FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source AND length(bin(d.size)) = preference),
p AS (SELECT *, floor(wanted) AS whole, CASE WHEN size > 0 THEN wanted - floor(wanted) ELSE 0e0 END AS p FROM r),
q AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q, target - sum(whole * size) OVER (PARTITION BY source) AS remains FROM p),
f AS (SELECT *, sum(CASE WHEN q IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) AS so_far FROM q)
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN ((whole + CASE WHEN q IS NOT NULL AND so_far - size / 2e0 <= remains THEN 1 ELSE 0 END) * size)::BIGINT ELSE 0 END AS taken FROM f
"""

#: Near duplicates by counting shared shingles of all pairs that share one, and reachability.
OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * k >= 85 * (na + nb - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON reach.r = edges.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1) USING (doc_id)
"""

#: Scores by joining terms, without products of matrices.
OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
t AS (SELECT count(*) FILTER (len(w) > 0) AS docs, sum(len(w))::BIGINT AS terms FROM d),
m AS (SELECT r, doc_id, 50 + (50 * len(w)::BIGINT * docs) // terms AS m FROM d, t WHERE len(w) > 0),
x AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY 1, 2),
f AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM x, t GROUP BY term, docs),
s AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM i JOIN x USING (term) JOIN f USING (term) JOIN m USING (r) GROUP BY 1, 2, 3)
SELECT item_id, rank, doc_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank FROM s WHERE score > 0) WHERE rank <= 50
"""

#: Every run's CRC-32 byte by byte, over distinct runs.
OP13_SQL = r"""
WITH RECURSIVE bits(n, k, c) AS (SELECT n, 0, n FROM range(256) t(n) UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS steps FROM bits WHERE k = 8),
x AS (SELECT 'b' AS kind, NULL::BIGINT AS doc_id, text, row_number() OVER () AS r FROM benchmark UNION ALL SELECT 'd', doc_id, text, row_number() OVER () FROM documents),
w AS (SELECT kind, doc_id, r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM x),
f AS (SELECT kind, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: array_to_string(w[i : i + 1], ' ')), list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')))) AS f FROM w),
u AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f)),
v AS (SELECT f, xor(list_reduce(list_transform(range(1, len(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT), lambda c, b: xor(c >> 8, steps[xor(c & 255, b) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM u, crc),
c AS (SELECT bucket, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 'b') AS t FROM f JOIN v USING (f) GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM c)::BIGINT + 10000))::DOUBLE / ((s + 1) * ((SELECT sum(t) FROM c)::BIGINT + 10000))::DOUBLE))::BIGINT AS gain FROM c),
k AS (SELECT r, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM f JOIN v USING (f) JOIN g USING (bucket) WHERE kind = 'd' GROUP BY 1),
o AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5e0) / 4294967296e0)))::BIGINT AS score FROM w LEFT JOIN k USING (r) WHERE kind = 'd'),
p AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, 5 * (count(*) FILTER (n_words >= 20) OVER ()) // 100 AS drawn FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= drawn THEN place END AS rank FROM p
"""

ORACLES: dict[str, str] = {"op6_mixing": OP6_SQL, "op10_minhash": OP10_SQL, "op12_dense_search": OP12_SQL, "op13_resampling": OP13_SQL}

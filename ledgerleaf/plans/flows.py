"""Registered queries of streams with restarts, files, bounded duplicates, chunks of whole texts and contexts."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.functions.rules import RULE_KEYS
from ledgerleaf.operators import conversations, intake, retrieval, routing, scoring, search_index, segment
from ledgerleaf.plans import corpus
from ledgerleaf.plans.reach import _LINE_ENTITIES_SQL, _LINES_SQL, SEEDED_SQL, _fresh, _length_embedder, _sql_collapse, _sql_trim
from ledgerleaf.plans.registry import ORACLES, _read, _rounded, query
from ledgerleaf.plans.scoring_sql import QUOTES_SQL, RECORDS_SQL
from ledgerleaf.sources import buckets, io
from ledgerleaf.sources.tables import written
from ledgerleaf.streaming import jobs

# Scores on arrival, and records of another method scored again


@query(f"""WITH {RECORDS_SQL}, d AS (SELECT concat('report-', doc_id::VARCHAR) AS report_id, doc_id, text FROM documents)
SELECT report_id, CASE WHEN doc_id % 3 = 0 AND text IS NULL THEN 0 ELSE score END AS score, CASE WHEN doc_id % 3 = 0 AND text IS NULL THEN 'manual' ELSE 'rules-evidence' END AS method_kind, CASE WHEN doc_id % 3 = 0 AND text IS NOT NULL THEN 'manual' END AS migrated_from FROM d JOIN banded USING (report_id)""")
def rescored_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the reports has records of another method, the others arrive as files in two goes, between which the stream restarts; then the stale records are scored again."""
    docs = written(corpus.seeded_reports(spark, sf_dir))
    path, arrivals, state = (_fresh(docs, n) for n in ("scores", "arrivals", "state"))
    d = F.col("doc_id")
    old = docs.where(d % 3 == 0).select("report_id", F.lit(0).alias("score"), F.lit("manual").alias("method_kind"), F.lit(1).alias("version"))
    io.write_scores(old, path, 0)
    for go in (1, 2):
        docs.where(d % 3 == go).select("report_id", "text").write.mode("append").parquet(arrivals)
        jobs.stream_scores(spark.readStream.schema("report_id string, text string").parquet(arrivals), path, state, first=1).awaitTermination()
    kinds = old.limit(0).withColumn("migrated_from", F.lit("")).schema
    io.write_scores(scoring.stale_scores(buckets.read_buckets(spark, path, kinds), docs.select("report_id", "text")), path)
    return buckets.read_buckets(spark, path, kinds).select("report_id", "score", "method_kind", "migrated_from")


# Expiry of staged uploads


@query("""WITH s AS (SELECT event_id AS token, ts AS created_at FROM events WHERE event_id % 2 = 0), f AS (SELECT event_id - 1 AS token, ts AS finalized_at FROM events WHERE event_id % 4 = 1)
SELECT s.token, created_at, f.finalized_at, CASE WHEN f.token IS NULL THEN 'expired' ELSE 'finalized' END AS outcome FROM s LEFT JOIN f ON s.token = f.token AND finalized_at >= created_at AND finalized_at <= created_at + INTERVAL 2 HOURS""")
def streamed_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads and finalizations as two streams of files; what expires shows when both clocks have passed it, here by a later pair of files after a restart."""
    events = written(_read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts")))
    e = F.col("event_id")
    sides = {"staged": events.where(e % 2 == 0).select(e.alias("token"), F.col("ts").alias("created_at")), "finals": events.where(e % 4 == 1).select((e - 1).alias("token"), F.col("ts").alias("finalized_at"))}
    paths, out, state = {n: _fresh(events, n) for n in sides}, _fresh(events, "outcomes"), _fresh(events, "state")
    later = events.agg((F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"))
    ends = {"staged": later.select(F.lit(-1).cast("bigint").alias("token"), F.col("ts").alias("created_at")), "finals": later.select(F.lit(-2).cast("bigint").alias("token"), F.col("ts").alias("finalized_at"))}
    for go in (sides, ends):
        for n, rows in go.items():
            rows.select(F.col("token").cast("bigint").alias("token"), rows.columns[1]).write.mode("append").parquet(paths[n])
        staged, finals = (spark.readStream.schema(f"token bigint, {at} timestamp").parquet(paths[n]) for n, at in (("staged", "created_at"), ("finals", "finalized_at")))
        made = jobs.staging_outcomes(staged, finals)
        made.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(made.schema).parquet(out).where("token >= 0")


# Files


def _stored(spark: SparkSession, sf_dir: str, start: Column) -> str:
    """A text file for each row of the documents below ``reports``, ended by a line feed; its name begins with ``doc_id=N.``."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.concat(start, F.coalesce("text", F.lit(""))).alias("value"))
    path = _fresh(docs, "files")
    io.write_text_files(docs.select(F.concat(F.lit("doc_id="), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("name"), F.concat("value", F.lit("\n")).alias("text")), f"{path}/reports")
    return path


_ID_OF = lambda c: F.nullif(F.regexp_extract(c, r"/doc_id=(-?\d*)\.", 1), F.lit("")).cast("bigint").alias("doc_id")


@query("""SELECT doc_id, strlen(b)::BIGINT AS size, sha256(b) AS sha256, doc_id % 3 = 0 OR starts_with(b, '%PDF-') AS has_signature FROM (SELECT doc_id, concat(CASE WHEN doc_id % 3 = 0 THEN '%PDF-' ELSE '' END, coalesce(text, ''), chr(10)) AS b FROM documents)""")
def stored_binaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file, a third of them with a signature; sizes, digests and signatures read from the bytes."""
    path = _stored(spark, sf_dir, F.when(F.col("doc_id") % 3 == 0, "%PDF-").otherwise(""))
    return io.inventory_binaries(spark, path, "*.txt").select(_ID_OF("path"), "size", "sha256", "has_signature")


@query("SELECT doc_id, true AS under_reports, concat(coalesce(text, ''), chr(10)) AS text FROM documents")
def stored_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file, read as whole texts with keys from their paths."""
    rows = io.read_markdown_corpus(spark, _stored(spark, sf_dir, F.lit("")), extension="txt")
    return rows.select(_ID_OF("report_key"), F.col("report_key").rlike(r"^reports/.*/doc_id=[^/]*\.pdf$").alias("under_reports"), "text")


# Duplicates with hot keys


_SIDES = """d AS (SELECT doc_id, sha256(text) AS sha256, CASE WHEN doc_id % 3 = 0 THEN 2020 WHEN doc_id % 11 = 0 THEN NULL ELSE 2018 + doc_id % 7 END AS year, CASE WHEN doc_id % 3 = 0 THEN 'hot' WHEN doc_id % 13 = 0 THEN '' ELSE concat('company-', (doc_id % 50)::VARCHAR) END AS slug FROM documents),
e AS (SELECT *, concat('reports/', doc_id::VARCHAR, '.pdf') AS k FROM d WHERE doc_id % 4 < 2), n AS (SELECT * FROM d WHERE doc_id % 4 >= 2)"""


@query(f"""WITH {_SIDES}, h AS (SELECT sha256, list(k ORDER BY k)[1:3] AS ks FROM e WHERE sha256 IS NOT NULL GROUP BY 1), c AS (SELECT year, slug, list(k ORDER BY k)[1:3] AS ks FROM e WHERE slug <> '' AND year IS NOT NULL GROUP BY 1, 2)
SELECT n.doc_id AS upload_id, h.ks IS NOT NULL AS same_hash, c.ks IS NOT NULL AS same_company_year, coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(h.ks, []), coalesce(c.ks, []))))[1:3], ' '), '') AS examples FROM n LEFT JOIN h USING (sha256) LEFT JOIN c ON c.year = n.year AND c.slug = n.slug""")
def duplicate_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents as uploads against the other half; a third of either side is of one company and year."""
    d = F.col("doc_id")
    year = F.when(d % 3 == 0, 2020).when(d % 11 == 0, None).otherwise(2018 + d % 7)
    slug = F.when(d % 3 == 0, "hot").when(d % 13 == 0, "").otherwise(F.concat(F.lit("company-"), (d % 50).cast("string")))
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), year.alias("year"), slug.alias("company_slug"))
    existing = docs.where("doc_id % 4 < 2").withColumn("report_key", F.concat(F.lit("reports/"), d.cast("string"), F.lit(".pdf")))
    found = intake.find_duplicates(docs.where("doc_id % 4 >= 2").withColumnRenamed("doc_id", "upload_id"), existing)
    return found.select("upload_id", "same_hash", "same_company_year", F.coalesce(F.array_join("examples", " "), F.lit("")).alias("examples"))


# Search by stored trigrams

_ASKED = """SELECT DISTINCT CASE doc_id % 200 WHEN 0 THEN concat('Cómpany ', cast(year AS string)) WHEN 50 THEN concat_ws(' / ', sector, country, cast(year AS string)) WHEN 100 THEN concat('OMPANY-0 ', right(cast(year AS string), 2)) ELSE concat(right(cast(year AS string), 2), ' sr or 0') END AS query
FROM catalogue WHERE doc_id % 50 = 0"""
_FOLDED = lambda c: f"trim(regexp_replace(lower(strip_accents({c})), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH catalogue AS ({corpus.CATALOGUE_SQL}), q AS (SELECT query, string_split({_FOLDED("query")}, ' ') AS words FROM ({_ASKED})),
b AS (SELECT report_id, {_FOLDED("concat_ws(' ', company, sector, country, year::VARCHAR)")} AS blob FROM catalogue)
SELECT query, report_id FROM q JOIN b ON len(list_filter(words, lambda w: NOT contains(blob, w))) = 0""")
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches made of every fiftieth report's fields, whole words and parts of them, against all reports, by the stored index."""
    reports = corpus.catalogue(spark, sf_dir)
    reports.createOrReplaceTempView("catalogue")
    path = _fresh(reports, "search")
    search_index.index_reports(reports, path, ["company", "sector", "country", "year"])
    asked = spark.sql(_ASKED).select(F.col("query").alias("query_id"), "query")
    return search_index.search_indexed(spark, path, asked).select(F.col("query_id").alias("query"), F.col("id").alias("report_id"))


# Chunks of whole texts, by a step from each cut to the next


def _cuts_sql(texts: str, size: int, overlap: int, marks: list[tuple[str, float, int]]) -> str:
    """``cuts(id, a, b)``: pieces from ``a`` to ``b`` of the texts ``(id, t)``; a mark counts from its share of the size on."""
    low = lambda m: f"substr(t, a + 1, least(length(t), least(length(t), a + {size}) + {len(m)}) - a)"
    quoted = lambda m: " || ".join("chr(10)" if c == "\n" else f"'{c}'" for c in m)
    place = lambda m: f"(CASE WHEN instr(reverse({low(m)}), {quoted(m[::-1])}) > 0 THEN a + length({low(m)}) - instr(reverse({low(m)}), {quoted(m[::-1])}) - {len(m) - 1} ELSE -1 END)"
    cases = " ".join(f"WHEN {place(m)} > a + {int(size * share)} THEN {place(m)} + {keep}" for m, share, keep in marks)
    end = f"(CASE WHEN length(t) <= {size} THEN length(t) {cases} ELSE least(length(t), a + {size}) END)"
    return f"""given AS ({texts}), cuts(id, t, a, b) AS (SELECT id, t, a, {end} FROM (SELECT id, t, 0::BIGINT AS a FROM given WHERE t <> '')
UNION ALL SELECT id, t, a, {end} FROM (SELECT id, t, greatest(b - {overlap}, a + 1) AS a FROM cuts WHERE b < length(t)))"""


_PIECES = f"pieces AS (SELECT id, (row_number() OVER (PARTITION BY id ORDER BY a) - 1)::INT AS chunk, piece FROM (SELECT id, a, {_sql_trim('substr(t, a + 1, b - a)')} AS piece FROM cuts) WHERE piece <> '')"
_CHAR_CHUNKS = f"""{_cuts_sql(f"SELECT doc_id AS id, {_sql_collapse('text')} AS t FROM documents WHERE text IS NOT NULL", 1200, 150, [(" ", 0.6, 0)])}, {_PIECES}"""


@query(f"WITH RECURSIVE {_CHAR_CHUNKS} SELECT id AS doc_id, chunk, piece AS text FROM pieces")
def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All retrieval chunks of all documents."""
    return _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(segment.char_chunks(F.col("text"))).alias("chunk", "text"))


_SECTIONS = _cuts_sql(f"SELECT report_id AS id, {_sql_trim('text')} AS t FROM ({SEEDED_SQL}) WHERE text IS NOT NULL", 12000, 600, [("\n\n", 0.5, 0), (". ", 0.6, 1)])


@query(f"WITH RECURSIVE {_SECTIONS}, {_PIECES} SELECT id AS report_id, chunk, length(piece) AS n_chars, sha256(piece) AS digest FROM pieces")
def section_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All section chunks of all reports, by length and digest."""
    rows = corpus.seeded_reports(spark, sf_dir).select("report_id", F.posexplode(segment.section_chunks(F.col("text"))).alias("chunk", "piece"))
    return rows.select("report_id", "chunk", F.char_length("piece").alias("n_chars"), F.sha2("piece", 256).alias("digest"))


# Models that stand for others: linear in hashed words, so that SQL can compute the same sums


def _word_hash(word: str) -> int:
    return int.from_bytes(hashlib.md5(word.encode()).digest()[:2], "big")


class _Hashes(dict):
    """The hashes of words that a worker has seen: up to ``most`` words of up to 64 characters, then it begins anew."""

    most = 1 << 18

    def __missing__(self, word: str) -> int:
        made = _word_hash(word)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = made
        return made


_HASH_OF = _Hashes()


_HASHED = "list_transform(list_filter(string_split(t, ' '), lambda w: w <> ''), lambda w: ('0x' || substr(md5(w), 1, 4))::INT)"
DIMENSIONS = 16


def hashed_scores(texts: list[str]) -> list[list[tuple[str, float]]]:
    """Two labels, each with a weight of every word from its hash, averaged over the words."""
    made = []
    for text in texts:
        words = [_HASH_OF[w] for w in text.split(" ") if w]
        mean = lambda of, ws=words: sum(map(of, ws)) / max(1, len(ws))
        made.append([("Climate Change", mean(lambda h: h % 7 - 3)), ("Human Capital", mean(lambda h: h // 7 % 5 - 2))])
    return made


def hashed_vectors(texts: list[str]) -> list[list[float]]:
    """Words of a text by the remainder of their hash."""
    made = []
    for text in texts:
        row = [0.0] * DIMENSIONS
        for h in map(_HASH_OF.__getitem__, filter(None, text.split(" "))):
            row[h % DIMENSIONS] += 1
        made.append(row)
    return made


@query(f"""WITH c AS (SELECT doc_id, {_sql_collapse("coalesce(text, '')")} AS c FROM documents), x AS (SELECT doc_id, CASE WHEN length(c) <= 1200 THEN c WHEN length(regexp_extract(substr(c, 1, 1202), '^(.*[.]) ', 1)) - 1 > 720 THEN regexp_extract(substr(c, 1, 1202), '^(.*[.]) ', 1) ELSE substr(c, 1, 1200) END AS t FROM c),
h AS (SELECT doc_id, {_HASHED} AS h FROM x), s AS (SELECT doc_id, coalesce(list_sum(list_transform(h, lambda x: x % 7 - 3)), 0) / greatest(1, len(h)) AS a, coalesce(list_sum(list_transform(h, lambda x: (x // 7) % 5 - 2)), 0) / greatest(1, len(h)) AS b FROM h)
SELECT doc_id, round(a, 6) AS climate, round(b, 6) AS human, CASE WHEN b > a THEN 'Human Capital' ELSE 'Climate Change' END AS best FROM s WHERE greatest(a, b) > 0 AND a <> b""")
def hashed_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents classified by a linear model over hashed words; ties and documents with no positive score are left out."""
    rows = routing.classify_chunks(_read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), hashed_scores)
    score = lambda i: F.get("scores", F.lit(i))["score"]
    made = rows.select("doc_id", score(0).alias("climate"), score(1).alias("human"), routing.argmax(F.col("scores"))["label"].alias("best"), "failure")
    return _rounded(made.where("failure is null and greatest(climate, human) > 0 and climate <> human").drop("failure"), "climate", "human")


@query(f"""WITH RECURSIVE {_CHAR_CHUNKS}, h AS (SELECT id, chunk, piece, {_HASHED.replace("(t,", "(piece,")} AS h FROM pieces)
SELECT id::VARCHAR AS namespace, chunk, length(piece)::BIGINT AS n_chars, array_to_string(list_transform(range({DIMENSIONS}), lambda i: len(list_filter(h, lambda x: x % {DIMENSIONS} = i))), ' ') AS counts FROM h""")
def hashed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector records of all chunks of all documents, of any length."""
    pages = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("report_id"), F.lit(1).alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    counts = F.array_join(F.transform("values", lambda v: v.cast("bigint").cast("string")), " ")
    return retrieval.vector_records(pages, hashed_vectors).select("namespace", "chunk", F.char_length("text").cast("bigint").alias("n_chars"), counts.alias("counts"))


@query(f"WITH RECURSIVE {_CHAR_CHUNKS} SELECT id::VARCHAR AS namespace, chunk, length(piece)::BIGINT AS n FROM pieces WHERE NOT regexp_matches(piece, '^[aeiou]')")
def short_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all chunks but those to which the model gives no vector."""
    pages = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("report_id"), F.lit(1).alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    return retrieval.vector_records(pages, _length_embedder).select("namespace", "chunk", F.get("values", F.lit(0)).cast("bigint").alias("n"))


# Contexts

_RUNGS = ", ".join(str(r) for r in conversations.ladder())
_PART = lambda c, cap, prefix: f"CASE WHEN {c} > 0 AND {cap} > 0 THEN ceil((least({c}, {cap}) + {prefix}) / 4.0)::BIGINT + 12 ELSE 0 END"


@query(f"""WITH m AS (SELECT conv_id, turn, {_sql_trim("text")} AS text FROM conversations WHERE {_sql_trim("coalesce(text, '')")} <> ''),
o AS (SELECT conv_id, max(turn) * 2500 AS v, count(*) * 1500 AS r FROM m GROUP BY 1), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS nth FROM m),
l(rung, viewer, retrieved, history, least) AS (VALUES {_RUNGS}), t AS (SELECT conv_id, rung, viewer, retrieved, history, least, {(900 + 3) // 4 + 12} + {_PART("v", "viewer", 33)} + {_PART("r", "retrieved", 32)} + (SELECT sum(ceil(length(text) / 4.0)::BIGINT + 12) FROM n WHERE n.conv_id = o.conv_id AND nth <= history) AS total FROM o, l),
a AS (SELECT *, 4096 - 64 - (ceil(total * 115 / 100)::BIGINT + 24) AS available FROM t), f AS (SELECT conv_id, min(rung) FILTER (available >= least) AS rung FROM a GROUP BY 1)
SELECT f.conv_id, f.rung, a.viewer AS viewer_cap, a.retrieved AS retrieved_cap, coalesce(a.history, 4) AS history, a.available::BIGINT AS available FROM f LEFT JOIN a ON a.conv_id = f.conv_id AND a.rung = f.rung""")
def fitted_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rung of the ladder that each conversation takes."""
    messages = conversations.normalize_messages(_read(spark, sf_dir, "conversations"))
    offered = messages.groupBy("conv_id").agg((F.max("turn") * 2500).cast("int").alias("viewer_chars"), (F.count("*") * 1500).cast("int").alias("retrieved_chars"))
    return conversations.fit_context(messages, offered, 4096)


ORACLES["context_fit"] = ORACLES["fitted_contexts"]

# All quotes of the reports as entities, in the order of the rules: the SQL of the quotes, then that of the grounding with its own names
_QUOTE_ENTITIES = """ents AS (SELECT report_id, row_number() OVER (PARTITION BY report_id ORDER BY position, rank) AS chunk_index, text AS extraction_text FROM ranked JOIN positions USING (feature_key) WHERE rank <= quotes AND text <> '')"""
_POSITIONS = ", ".join(f"('{k}', {i})" for i, k in enumerate(RULE_KEYS))
_GROUNDED = ORACLES["grounded_lines"].removeprefix("WITH RECURSIVE ").replace(f"{_LINES_SQL}, ", "", 1).replace("seqs", "ground_seqs").replace(_LINE_ENTITIES_SQL, _QUOTE_ENTITIES)
ORACLES["grounded_entities"] = f"WITH RECURSIVE {QUOTES_SQL}, positions(feature_key, position) AS (VALUES {_POSITIONS}), " + _GROUNDED.replace("extraction_text, page, title AS heading FROM ready", "0 AS position, 'energy' AS extraction_class, extraction_text, 'E' AS pillar, page, title AS heading FROM ready")

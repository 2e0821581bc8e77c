"""Tables derived from the driver's tables, in expressions that read the same in Spark and in DuckDB.

The driver's documents hold no report text, so lines of marked phrases are woven between their lines. The
``*_SQL`` strings are plain SQL over the tables' names; Spark runs them over temporary views of the same
names, the oracles as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PHRASES = [
    "We report under ESRS and CSRD with reference to EFRAG guidance", "Our GRI content index lists each disclosure", "SASB metrics and TCFD pillars are covered",
    "The ISSB standards IFRS S1 and IFRS S2 apply from next year", "EU Taxonomy aligned revenue rose to 12.5 %", "We follow TNFD and CDP and the SDGs",
    "Targets are in line with the Paris Agreement and 1.5 degrees", "A double materiality assessment was made along the value chain", "The supply chain was screened for impact materiality",
    "The board of directors and the audit committee review risk management", "Internal controls over data are tested each quarter", "ESG linked remuneration covers 20 % of variable pay",
    "A whistleblowing line and anti corruption training are in place", "GDPR and data protection rules are kept", "Our sustainability committee met four times",
    "Scope 1 emissions were 12,400 tCO2e in 2023", "Scope 2 market based emissions fell to 8,100 tCO2e", "Scope 3 category 4 upstream transport is 45,000 tCO2e",
    "We use the GHG Protocol with 2019 as base year", "Carbon intensity is 0.42 tCO2e per unit", "We aim for net zero by 2040 under the SBTi",
    "A transition plan sets out the decarbonisation roadmap", "Our target is to cut energy use 30 % by 2030", "Interim target for 2027 is on track",
    "Climate scenario analysis covers physical risk and transition risk", "An internal carbon price of 80 is used", "Energy consumption was 5,200 MWh of which 61.5 % renewable energy",
    "Water withdrawal fell 4 % in stressed regions", "Waste management diverts 90 % from landfill", "Biodiversity and deforestation are assessed", "Circular economy design reduces pollution and NOx",
    "The workforce had 3,400 employees in 2022", "Safety: LTIR of 1.2 and no fatalities", "Gender diversity and inclusion improved in 2021", "Human rights due diligence covers suppliers",
    "Training hours per employee rose to 24", "Stakeholder engagement shaped the plan", "Community investment and volunteering grew", "A living wage is paid at all sites",
    "Occupational health and mental health matter", "Voluntary turnover was 8.1 %", "Limited assurance under ISAE 3000 was given by Deloitte", "Reasonable assurance covers scope 1 emissions",
    "Some figures are unaudited", "The methodology follows a measurement approach", "The reporting boundary is the operational boundary", "Limitations: some data is estimated",
    "Restated figures are marked for 2020", "Our outlook and ambition are forward looking", "The reporting period is the financial year 2023", "| KPI | 2022 | 2023 |",
    "| Energy | 5,100 | 5,200 |", "- Data quality and data governance are improved", "- Connected with financial statements and financial impact", "1. ESRS E1 datapoints are listed",
    "## Climate and energy", "## People and safety", "```\nwords in a fence are no evidence of scope 1\n```", "Sector specific standards apply", "A long example sen-", "tence was wrapped at the end of a line", "Carbon credits and carbon offsetting are avoided",
]

CATALOGUE_SQL = """
SELECT doc_id, concat('report-', cast(doc_id AS string)) AS report_id, concat('Company ', cast(doc_id % 50 AS string)) AS company,
  CASE WHEN doc_id % 12 = 11 THEN NULL ELSE concat('Sector ', cast(doc_id % 12 AS string)) END AS sector, source AS country,
  cast(2018 + doc_id % 7 AS int) AS year, concat('reports/', cast(2018 + doc_id % 7 AS string), '/company-', cast(doc_id % 50 AS string), '/', cast(doc_id AS string), '.pdf') AS report_key
FROM documents
"""

SCORED_SQL = """
SELECT *, CASE WHEN score >= 75 THEN 'high' WHEN score >= 50 THEN 'medium' ELSE 'low' END AS band FROM (
  SELECT *, cast(floor(0.35 * completeness + 0.25 * consistency + 0.2 * assurance + 0.2 * transparency + 0.5) AS int) AS score FROM (
    SELECT c.*, cast(doc_id * 7 % 101 AS int) AS completeness, cast(doc_id * 13 % 101 AS int) AS consistency, cast(doc_id * 29 % 101 AS int) AS assurance, cast(doc_id * 31 % 101 AS int) AS transparency
    FROM catalogue c WHERE doc_id % 13 <> 0))
"""


def view(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    view(spark, sf_dir, "documents")
    return spark.sql(CATALOGUE_SQL)


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalogue(spark, sf_dir).createOrReplaceTempView("catalogue")
    return spark.sql(SCORED_SQL)


def seeded_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``report_id, doc_id, text``: report-like texts woven from the documents' lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    d = F.col("doc_id")
    table = F.array(*[F.lit(p) for p in PHRASES])
    lines = F.split("text", "\n")

    def piece(line, k):
        page = F.when((d % 17 != 0) & (k % 4 == 0), F.concat(F.lit("### Page "), (F.floor(k / 4) + 1).cast("string"), F.lit("\n"))).otherwise(F.lit(""))
        title = F.when((d % 2 == 0) & (k % 4 == 0), F.lit("ANNUAL REPORT OF THE GROUP\n")).otherwise(F.lit(""))
        phrase = F.get(table, ((7 * d + 3 * k) % len(PHRASES)).cast("int"))
        return F.concat(page, title, line, F.lit("\n\n"), phrase, F.lit("\n"))

    return docs.select(F.concat(F.lit("report-"), d.cast("string")).alias("report_id"), "doc_id", F.array_join(F.transform(lines, piece), "").alias("text"))


_VALUES = ", ".join(f"({i}, '{p}')" for i, p in enumerate(PHRASES))
#: Pages of three phrases, 1 to 12 a report, for rules whose counts SQL can check.
PHRASE_PAGES_SQL = f"""
WITH phrases AS (SELECT * FROM (VALUES {_VALUES}) AS t(phrase_no, phrase)),
  numbers AS (SELECT * FROM (VALUES (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12)) AS t(page))
SELECT concat('report-', cast(d.doc_id AS string)) AS report_id, d.doc_id, n.page, concat(a.phrase, '. ', b.phrase, '. ', c.phrase, '. ', d.lang) AS text
FROM documents d JOIN numbers n ON n.page <= 1 + d.doc_id % 12
JOIN phrases a ON a.phrase_no = (7 * d.doc_id + 3 * n.page) % {len(PHRASES)}
JOIN phrases b ON b.phrase_no = (5 * d.doc_id + n.page) % {len(PHRASES)}
JOIN phrases c ON c.phrase_no = (d.doc_id + 11 * n.page) % {len(PHRASES)}
"""

#: Uploads: a fifth of the catalogue again with some nulls, and as many new ids.
UPLOADS_SQL = """
SELECT report_id, concat(company, ' Ltd') AS company, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE sector END AS sector, country, year, report_key FROM catalogue WHERE doc_id % 5 = 0
UNION ALL
SELECT concat('report-', cast(doc_id + 10000 AS string)) AS report_id, company, sector, country, year, report_key FROM catalogue WHERE doc_id % 5 = 1
"""

#: Issue predictions of three chunks a document.
PREDICTIONS_SQL = """
SELECT concat('report-', cast(doc_id AS string)) AS k, chunk, (doc_id * 3 + chunk * 5) % 26 AS issue_no, ((doc_id * 17 + chunk * 31) % 64) / 64.0E0 AS score
FROM documents CROSS JOIN (VALUES (0), (1), (2), (3)) AS t(chunk)
"""

#: Entities of four classes; text in changing case, so that some repeat.
ENTITIES_SQL = """
SELECT concat('report-', cast(doc_id AS string)) AS report_id, cast(chunk AS int) AS chunk_index, cast(doc_id % 2 AS int) AS position,
  CASE (doc_id + chunk) % 4 WHEN 0 THEN 'ghg_emissions' WHEN 1 THEN 'water' WHEN 2 THEN 'social_metric' ELSE 'regulatory' END AS extraction_class,
  CASE WHEN chunk % 2 = 0 THEN upper(concat('figure ', cast(doc_id % 7 AS string))) ELSE concat('figure ', cast(doc_id % 7 AS string)) END AS extraction_text,
  CASE (doc_id + chunk) % 4 WHEN 2 THEN 'S' WHEN 3 THEN 'G' ELSE 'E' END AS pillar
FROM documents CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) AS t(chunk)
"""


def phrase_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    view(spark, sf_dir, "documents")
    return spark.sql(PHRASE_PAGES_SQL)


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalogue(spark, sf_dir).createOrReplaceTempView("catalogue")
    return spark.sql(UPLOADS_SQL)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    view(spark, sf_dir, "documents")
    return spark.sql(PREDICTIONS_SQL)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    view(spark, sf_dir, "documents")
    return spark.sql(ENTITIES_SQL)

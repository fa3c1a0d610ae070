"""Registry of named queries with their SQL equivalents, and the tables they read."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
EQUIVALENT_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the same computation for a second engine, when SQL can say it."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            EQUIVALENT_SQL[name] = sql
        return fn
    return add


TEXT_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; text that comes as fewer scan partitions than the session has cores is spread by key.

    Text rules are heavy per row, so one small file must not run as one task. On a real corpus the
    scan already has far more partitions than cores and nothing is shuffled.
    """
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return spread(df, TEXT_KEYS[name]) if name in TEXT_KEYS else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by key over the session's cores where the scan has fewer partitions, for work that is heavy per row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def quoted(text: str) -> str:
    """A string as a standard SQL literal."""
    return "'" + text.replace("'", "''") + "'"


# -- derived inputs ----------------------------------------------------------------------------
# The corpus holds no stock phrases, call-outs or markup, so rules would match nothing on it. These
# expressions wrap every document's own text in a manuscript whose parts vary with the row. They are
# plain SQL that both engines evaluate to the same string, for every row of the table.

MANUSCRIPT = """concat_ws(chr(10),
  concat('Outcome study ', doc_id, CASE WHEN doc_id % 5 = 0
         THEN ' in adults with an unusually long descriptive title that goes on for much longer than it should' ELSE ' in adults' END),
  CASE WHEN doc_id % 4 <> 3 THEN concat('Running title: Outcome of ', doc_id % 13, CASE WHEN doc_id % 8 = 0 THEN ' in a long and wordy running title for adults' ELSE '' END) END,
  CASE WHEN doc_id % 6 <> 5 THEN concat('Keywords: alpha, beta', CASE WHEN doc_id % 2 = 0 THEN ', gamma; delta' ELSE '' END, CASE WHEN doc_id % 7 = 0 THEN ', epsilon, zeta, eta' ELSE '' END) END,
  CASE WHEN doc_id % 3 = 0 THEN concat('Word count: ', 100 + doc_id % 50, ' words (excluding references and figure legends)') END,
  '# Abstract',
  CASE WHEN doc_id % 3 = 1 THEN 'Levels of the HPA axis rose [PMID: 123] and the ACTH response fell.' ELSE 'Levels rose in the treated group (4) (5).' END,
  CASE WHEN doc_id % 9 = 0 THEN 'A second paragraph of the abstract.' END,
  CASE WHEN doc_id % 2 = 0 THEN 'Abbreviations' END,
  '# 1. Introduction',
  text,
  CASE WHEN doc_id % 4 = 0 THEN 'The normal mean arterial pressure (MAP) was set. MAP fell, and MAP and BNP rose. Colour and color differ; we normalised the labelled signal.'
       WHEN doc_id % 4 = 1 THEN 'BNP was high. B-type natriuretic peptide (BNP) was low. The tumor was analysed in the center.'
       WHEN doc_id % 4 = 2 THEN 'Heart rate (HR) and heart rate (HR) again. Behaviour was randomized, and the Behavior Centre agreed.'
       ELSE 'The TP53 gene and expression of BRCA1 were measured, as were CRH and ACTH.' END,
  concat('# ', 2 + (CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END), '. Methods'),
  CASE WHEN doc_id % 4 = 0 THEN 'We found P = 0.03, P=0.04 and P = 0.05 with n = 12 and n=14.'
       WHEN doc_id % 4 = 1 THEN 'We found p<0.01, P<0.05 and P =0.02; q = 0.2 and n=8.'
       WHEN doc_id % 4 = 2 THEN 'Values were 12.3 ± 4.5, 3.1±0.2 and 7 ± 1, p = 0.9.'
       ELSE 'The change was -5 at 4 ºC over 10-12 weeks (Mann-Whitney test), see Fig. 2.' END,
  CASE WHEN doc_id % 5 = 1 THEN 'Two  spaces , and a stop .  Then (a ) bracket.' END,
  '## 2.1 Setting',
  CASE WHEN doc_id % 3 = 2 THEN '## 2.3 Design:' ELSE '## 2.2 Design' END,
  '# 3. Results',
  CASE WHEN doc_id % 5 = 0 THEN 'As Figure 2 and Figure 1 show, and Figures 3-5.'
       WHEN doc_id % 5 = 1 THEN 'See Figure 1, Supplementary Figure 9 and Figs. 2 and 3.'
       WHEN doc_id % 5 = 2 THEN 'See Figure 1 and Figure 4.' END,
  CASE WHEN doc_id % 6 < 4 THEN '# 4. Conclusions' END,
  'We conclude that the effect is real, et al. say so. It is small.',
  CASE WHEN doc_id % 4 <> 1 THEN '# Funding' END,
  CASE WHEN doc_id % 4 <> 2 THEN 'Data availability: on request.' END,
  CASE WHEN doc_id % 7 = 3 THEN 'Author contributions: all authors.' END,
  '# References',
  concat('1. Smith J. Study ', doc_id, '. J Test. ', 1990 + doc_id % 30, ';12:1-9. doi:10.1000/ref', doc_id % 400),
  CASE WHEN doc_id % 3 = 0 THEN '3. Roe A. Another study. J Test (2001). 10.1000/XYZ.' ELSE '2. Doe B. A study without identifier, 2003. In press' END,
  '# Figure legends',
  CASE WHEN doc_id % 5 < 2 THEN 'Figure 1: Flow of the study. HR, heart rate' END,
  CASE WHEN doc_id % 5 = 0 THEN 'Figure 7: Never cited.' END)"""

# The same in the second engine: one row per line with level, heading-free text and in-document position.
MANUSCRIPT_LINES_SQL = f"""
SELECT doc_id, CAST(i - 1 AS INTEGER) AS para_idx, lines[i] AS line,
       length(regexp_extract(lines[i], '^(#{{1,6}})[ ]+', 1)) AS level,
       regexp_replace(lines[i], '^#{{1,6}}[ ]+', '') AS text
FROM (SELECT doc_id, lines, unnest(generate_series(1, len(lines))) AS i
      FROM (SELECT doc_id, string_split({MANUSCRIPT}, chr(10)) AS lines FROM documents))
"""


def manuscripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id", "lang", f"{MANUSCRIPT} AS text")

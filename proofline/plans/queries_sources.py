"""Named queries: readers, block parsing, digests, numbering and output."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofline.operators.charts import coerce_numeric
from proofline.operators.history import batch_rows
from proofline.plans.catalog import MANUSCRIPT, MANUSCRIPT_LINES_SQL, manuscripts, query, spread, table
from proofline.session import scratch_path
from proofline.sources import readers as S


@query("a1_read_csv_checked", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def a1(spark, sf):
    path = scratch_path(spark, "customers-csv")
    table(spark, sf, "customer").write.option("header", True).csv(path)
    return S.read_csv_checked(spark, path, ["c_custkey", "c_name", "c_mktsegment"]).select("c_custkey", "c_name", "c_mktsegment")


RAW_VALUE = "CASE o_orderkey % 6 WHEN 0 THEN 'NaN' WHEN 1 THEN '' WHEN 2 THEN '-Infinity' WHEN 3 THEN 'abc' ELSE CAST(o_totalprice AS VARCHAR(20)) END"


@query("a2_coerce_numeric", "SELECT o_orderkey, CASE WHEN o_orderkey % 6 >= 4 THEN o_totalprice END AS raw, o_orderkey % 6 < 4 AS rejected FROM orders")
def a2(spark, sf):
    valid, rejected = coerce_numeric(table(spark, sf, "orders").selectExpr("o_orderkey", f"{RAW_VALUE} AS raw"), ["raw"])
    return valid.withColumn("rejected", F.lit(False)).unionByName(
        rejected.select("o_orderkey", F.lit(None).cast("double").alias("raw"), F.lit(True).alias("rejected")))


LEDGER_LINE = """CASE event_id % 20 WHEN 7 THEN '' WHEN 9 THEN '{"seq": broken' WHEN 11 THEN 'not json' ELSE
  concat('{"seq": ', event_id, ', "event": "', event_type, '", "status": "pending", "extra": {"a": [1]}}') END"""


@query("a3_parse_ledger", """
SELECT user_id AS file, event_id AS line_no, CASE WHEN event_id % 20 NOT IN (9, 11) THEN event_id END AS seq, CASE WHEN event_id % 20 NOT IN (9, 11) THEN event_type END AS event FROM events WHERE event_id % 20 <> 7""")
def a3(spark, sf):
    good, bad = S.parse_ledger(table(spark, sf, "events").selectExpr("user_id AS file", "event_id AS line_no", f"{LEDGER_LINE} AS line"))
    return good.select("file", F.col("pos").alias("line_no"), "seq", "event").unionByName(
        bad.select("file", "line_no", F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("event")))


ARTICLE = """concat('<PubmedArticle><MedlineCitation><PMID>', doc_id, '</PMID><Article><Journal><JournalIssue><Volume>', doc_id % 40, '</Volume><PubDate>',
  CASE WHEN doc_id % 3 = 0 THEN concat('<MedlineDate>', 1990 + doc_id % 30, ' Jan-Feb</MedlineDate>') ELSE concat('<Year>', 1990 + doc_id % 30, '</Year>') END,
  '</PubDate></JournalIssue><Title>Journal of  Tests</Title></Journal><ArticleTitle>Study of <i>', lang, '</i> in ', source, '</ArticleTitle><Abstract>',
  CASE WHEN doc_id % 4 <> 0 THEN '<AbstractText Label="AIM">To test <b>it</b>.</AbstractText><AbstractText>Done.</AbstractText>' ELSE '' END,
  '</Abstract><AuthorList><Author><LastName>Doe</LastName><ForeName>Jane Q-R</ForeName></Author><Author><CollectiveName>The Group</CollectiveName></Author><Author ValidYN="N"><LastName>Bad</LastName></Author></AuthorList>',
  CASE WHEN doc_id % 2 = 0 THEN concat('<ELocationID EIdType="doi" ValidYN="', CASE WHEN doc_id % 8 = 0 THEN 'N' ELSE 'Y' END, '">10.1/e', doc_id, '</ELocationID>') ELSE '' END,
  '</Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="doi">10.1/l', doc_id, '</ArticleId></ArticleIdList></PubmedData></PubmedArticle>')"""


@query("a4_parse_articles", """
SELECT doc_id, 'article' AS kind, CAST(doc_id AS VARCHAR) AS pmid, 'Study of ' || lang || ' in ' || source AS title, CAST(1990 + doc_id % 30 AS VARCHAR) AS year, CAST(doc_id % 40 AS VARCHAR) AS volume, 'Journal of Tests' AS journal,
 'Doe JQR|The Group' AS authors, CASE WHEN doc_id % 4 <> 0 THEN 'AIM: To test it.' || chr(10) || 'Done.' END AS abstract, CASE WHEN doc_id % 2 = 0 AND doc_id % 8 <> 0 THEN '10.1/e' || doc_id ELSE '10.1/l' || doc_id END AS doi FROM documents""")
def a4(spark, sf):
    rows = table(spark, sf, "documents").selectExpr("doc_id", f"{ARTICLE} AS xml")
    names = F.array_join(F.transform("authors", lambda a: a["display"]), "|").alias("authors")
    return S.parse_articles(rows).select("doc_id", "kind", "pmid", "title", "year", "volume", "journal", names, "abstract", "doi")


WORK = """concat('{"DOI": "10.2/W', doc_id, '", "title": ', CASE WHEN doc_id % 5 = 0 THEN '[]' ELSE concat('["A <i>study</i>  of ', lang, '", "x"]') END, ', "container-title": ["J"], ',
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('"issued": {"date-parts": [[', 2000 + doc_id % 20, ', 1]]}, ') END, '"published-online": {"date-parts": [[', 1999 + doc_id % 20, ']]}, ',
  '"author": [{"family": "Roe", "given": "A. B-C"}, {"name": "The Team"}, {"given": "only"}], "abstract": "<p>Short  text</p>"}')"""


@query("a5_parse_works", """
SELECT doc_id, '10.2/w' || doc_id AS doi, CASE WHEN doc_id % 5 <> 0 THEN 'A study of ' || lang END AS title, 'J' AS container, CAST(CASE WHEN doc_id % 3 = 0 THEN 1999 + doc_id % 20 ELSE 2000 + doc_id % 20 END AS INTEGER) AS year,
 CASE WHEN doc_id % 3 = 0 THEN CAST(1999 + doc_id % 20 AS VARCHAR) ELSE (1999 + doc_id % 20) || ',' || (2000 + doc_id % 20) END AS years, 'Roe ABC|The Team' AS authors, 'Short text' AS abstract FROM documents""")
def a5(spark, sf):
    out = S.parse_works(table(spark, sf, "documents").selectExpr("doc_id", f"{WORK} AS body"))
    return out.select("doc_id", "doi", "title", "container", "year", F.array_join(F.col("years").cast("array<string>"), ",").alias("years"),
                      F.array_join(F.transform("authors", lambda a: a["display"]), "|").alias("authors"), "abstract")


LIBRARY = """concat('<record><rec-number>', p_partkey, '</rec-number><foreign-keys><key db-id="db', p_size % 2, '">1</key></foreign-keys><contributors><authors><author>Doe', p_size, ', J</author></authors></contributors><titles><title><style>Title</style> ', p_name, '</title></titles><dates><year>', 1990 + p_size, '</year></dates>',
  CASE p_partkey % 4 WHEN 0 THEN concat('<accession-num>PMID: ', p_partkey % 300, '</accession-num>') WHEN 1 THEN concat('<urls><url>https://pubmed.ncbi.nlm.nih.gov/', p_partkey % 500, '/</url></urls>') WHEN 2 THEN '<accession-num>WOS:1</accession-num>' ELSE '' END,
  CASE WHEN p_partkey % 6 = 0 THEN concat('<label>key', p_partkey % 50, '</label>') ELSE '' END, '</record>')"""


def library(spark, sf):
    return S.parse_library(spread(table(spark, sf, "part").select("p_partkey", "p_name", "p_size"), "p_partkey").selectExpr("p_partkey AS ord", f"{LIBRARY} AS xml"))


@query("a6_library_map", """
WITH r AS (SELECT p_partkey, p_size, p_name, CASE p_partkey % 4 WHEN 0 THEN p_partkey % 300 WHEN 1 THEN p_partkey % 500 END AS pmid FROM part)
SELECT CAST(pmid AS VARCHAR) AS pmid, CAST(min(p_partkey) AS VARCHAR) AS rec_number, 'Doe' || arg_min(p_size, p_partkey) AS surname, 'Title ' || arg_min(p_name, p_partkey) AS title, count(*) AS copies FROM r WHERE pmid IS NOT NULL GROUP BY pmid""")
def a6(spark, sf):
    return S.library_map(library(spark, sf)).select("pmid", "rec_number", "surname", "title", "copies")


@query("a6_library_labels", """
SELECT 'key' || (p_partkey % 50) AS label, CAST(min(p_partkey) AS VARCHAR) AS rec_number, count(*) AS copies FROM part WHERE p_partkey % 6 = 0 GROUP BY p_partkey % 50""")
def a6_labels(spark, sf):
    return S.library_map(library(spark, sf), "label").select("label", "rec_number", "copies")


@query("a6_library_problems", """
WITH r AS (SELECT p_partkey AS ord, p_name, p_partkey % 4 AS k, CASE p_partkey % 4 WHEN 0 THEN CAST(p_partkey % 300 AS VARCHAR) WHEN 1 THEN CAST(p_partkey % 500 AS VARCHAR) END AS pmid, CASE WHEN p_partkey % 6 = 0 THEN 'key' || (p_partkey % 50) END AS label FROM part),
d AS (SELECT ord, 'duplicate id' AS problem, pmid AS value, min(ord) OVER (PARTITION BY pmid) AS first FROM r WHERE pmid IS NOT NULL UNION ALL SELECT ord, 'duplicate label', label, min(ord) OVER (PARTITION BY label) FROM r WHERE label IS NOT NULL)
SELECT ord, CAST(ord AS VARCHAR) AS rec_number, problem, value, CAST(first AS VARCHAR) AS first FROM d WHERE ord <> first
UNION ALL SELECT ord, CAST(ord AS VARCHAR), 'no id', 'Title ' || p_name, NULL FROM r WHERE pmid IS NULL UNION ALL SELECT ord, CAST(ord AS VARCHAR), 'accession is no id', 'WOS:1', NULL FROM r WHERE k = 2""")
def a6_problems(spark, sf):
    return S.library_problems(library(spark, sf))


@query("a7_markdown_blocks", f"""
WITH l AS (SELECT doc_id, para_idx + 1 AS line_no, trim(line) AS t FROM ({MANUSCRIPT_LINES_SQL})),
c AS (SELECT *, CASE WHEN t = '' THEN 'blank' WHEN regexp_matches(t, '^#{{1,3}} ') THEN 'heading' ELSE 'para' END AS kind FROM l),
s AS (SELECT *, CASE WHEN kind = 'heading' OR kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) THEN 1 ELSE 0 END AS st FROM c),
g AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY line_no) AS isl FROM s WHERE kind <> 'blank')
SELECT doc_id, CAST(min(line_no) AS INTEGER) AS line_no, any_value(kind) AS kind, sha256(CASE WHEN any_value(kind) = 'heading' THEN regexp_replace(any_value(t), '^#{{1,3}} +', '') ELSE string_agg(t, ' ' ORDER BY line_no) END) AS digest FROM g GROUP BY doc_id, isl""")
def a7(spark, sf):
    return S.markdown_blocks(manuscripts(spark, sf)).select("doc_id", "line_no", "kind", F.sha2("text", 256).alias("digest"))


FENCED = "concat('before', chr(10), '```sql', chr(10), text, chr(10), '~~~', chr(10), '````', chr(10), 'after ', doc_id, chr(10), '~~~~', chr(10), 'open ``` x', chr(10), '~~~')"


@query("a8_strip_code_fences", """
SELECT doc_id, sha256('before' || chr(10) || repeat(chr(10), len(string_split(text, chr(10))) + 3) || 'after ' || doc_id || repeat(chr(10), 3)) AS digest FROM documents""")
def a8(spark, sf):
    out = S.strip_code_fences(table(spark, sf, "documents").selectExpr("doc_id", f"{FENCED} AS text"))
    return out.select("doc_id", F.sha2("text", 256).alias("digest"))


@query("a9_content_digest", """
WITH h AS (SELECT source, sha256(length(CAST(doc_id AS VARCHAR)) || ':' || doc_id || ':' || sha256(text)) AS h FROM documents),
leaf AS (SELECT source, substr(h, 1, 6) AS k, sha256(string_agg(h, ':' ORDER BY h)) AS h, count(*) AS n FROM h GROUP BY ALL),
node AS (SELECT source, substr(k, 1, 3) AS k, sha256(string_agg(h, ':' ORDER BY k)) AS h, sum(n) AS n FROM leaf GROUP BY source, substr(k, 1, 3)),
root AS (SELECT source, sha256(string_agg(h, ':' ORDER BY k)) AS h, CAST(sum(n) AS BIGINT) AS n FROM node GROUP BY source)
SELECT source, n AS files, sha256(n || ':' || h) AS digest FROM root""")
def a9(spark, sf):
    return S.content_digest(table(spark, sf, "documents"), "source", "doc_id", "text")


RAW_IDS = "concat('PMID:', o_custkey, ', ', o_orderkey, '; x', o_custkey, ' pmid', o_orderkey, ';', o_custkey % 5)"


@query("a10_normalise_ids", """
SELECT o_orderkey, id, pos FROM (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS id, 0 AS pos FROM orders UNION ALL SELECT o_orderkey, CAST(o_orderkey AS VARCHAR), 1 FROM orders WHERE o_orderkey <> o_custkey
 UNION ALL SELECT o_orderkey, CAST(o_custkey % 5 AS VARCHAR), 4 FROM orders WHERE o_custkey % 5 <> o_custkey AND o_custkey % 5 <> o_orderkey)""")
def a10(spark, sf):
    ids, _ = S.normalise_ids(table(spark, sf, "orders").selectExpr("o_orderkey", f"{RAW_IDS} AS raw"), "o_orderkey", "raw")
    return ids


@query("a10_rejected_ids", "SELECT o_orderkey, 'x' || o_custkey AS token FROM orders")
def a10_rejected(spark, sf):
    return S.normalise_ids(table(spark, sf, "orders").selectExpr("o_orderkey", f"{RAW_IDS} AS raw"), "o_orderkey", "raw")[1]


@query("a11_batch_rows", """
SELECT event_id, row_number() OVER (ORDER BY event_id) AS row_number, CAST(ceil(row_number() OVER (ORDER BY event_id) / 40) AS BIGINT) AS batch FROM events""")
def a11(spark, sf):
    rows = table(spark, sf, "events").select("event_id")
    return batch_rows(rows, 40, "event_id")


@query("a12_write_exclusive", "SELECT s_suppkey, s_name FROM supplier")
def a12(spark, sf):
    path = scratch_path(spark, "exclusive")
    S.write_exclusive(table(spark, sf, "supplier").select("s_suppkey", "s_name"), path)
    return spark.read.parquet(path)


@query("a13_profile_overlay", """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 250 ELSE CAST(c_custkey % 100 AS INTEGER) END AS max_words, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'warn' END AS severity, CASE WHEN c_custkey % 5 = 0 THEN c_nationkey ELSE 4 END AS keywords FROM customer""")
def a13(spark, sf):
    rows = table(spark, sf, "customer").selectExpr(
        "c_custkey", "named_struct('abstract', named_struct('max_words', 250, 'severity', 'warn'), 'keywords', 4) AS default",
        "named_struct('abstract', named_struct('max_words', CASE WHEN c_custkey % 3 <> 0 THEN cast(c_custkey % 100 as int) END, 'severity', CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END), 'keywords', CASE WHEN c_custkey % 5 = 0 THEN c_nationkey END) AS override")
    return S.profile_overlay(rows).select("c_custkey", "profile.abstract.max_words", "profile.abstract.severity", "profile.keywords")

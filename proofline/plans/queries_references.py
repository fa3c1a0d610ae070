"""Named queries: citations, bibliographies, matching, claims and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofline.functions import text as T
from proofline.operators import matching as M
from proofline.operators import references as R
from proofline.operators.units import paragraphs, structured_paragraphs
from proofline.plans.catalog import manuscripts, query, quoted, table
from proofline.plans.queries_lint import PARAS_SQL

DOI_SQL = (r"CASE WHEN regexp_matches({0}, '^10\.\d{{4,9}}/\S+$') THEN lower({0}) END")
RAW_DOI = "CASE o_orderkey % 4 WHEN 0 THEN 'https://doi.org/10.1000/AB' || o_custkey || '.' WHEN 1 THEN 'DOI: 10.12345/x' || o_orderkey WHEN 2 THEN ' 10.99/short' ELSE '10.1000/c;;' END"


@query("e1_normalise_doi", f"SELECT o_orderkey, {DOI_SQL.format('v')} AS doi FROM (SELECT o_orderkey, rtrim(regexp_replace(trim(raw), '^(https?://(dx[.])?doi[.]org/|doi:[ ]*)', '', 'i'), '.,;') AS v FROM (SELECT o_orderkey, {RAW_DOI} AS raw FROM orders))")
def e1(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", T.normalise_doi(F.expr(RAW_DOI)).alias("doi"))


RAW_NAME = "CASE c_custkey % 4 WHEN 0 THEN 'World Registry Group,' WHEN 1 THEN 'Doe' || c_custkey || ', Jane' WHEN 2 THEN ' Jane Q Roe' || c_custkey || ' ' ELSE '' END"


@query("e2_surname", """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'World Registry Group' WHEN 1 THEN 'Doe' || c_custkey WHEN 2 THEN 'Roe' || c_custkey END AS surname FROM customer""")
def e2(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", T.surname(F.expr(RAW_NAME)).alias("surname"))


MARKED = """CASE doc_id % 5 WHEN 0 THEN text || ' rose [PMID: 12] and [PMIDs: 3, 4; 5] fell' WHEN 1 THEN text || ' as [REF: key one] and {Doe, 2020 #12;Roe, 2019 #7} say'
  WHEN 2 THEN text || ' bad [PMID: x1] form' WHEN 3 THEN text || ' in {Doe`;Co, 2020 #12} and [PMID: 7]' ELSE text END"""


def marked_paragraphs(spark, sf):
    return paragraphs(table(spark, sf, "documents").selectExpr("doc_id", f"{MARKED} AS text"))


@query("e3_placeholder_inventory", r"""
SELECT doc_id, CAST(ids + keys + temporary AS BIGINT) AS placeholders, CAST(ids AS BIGINT) AS id_groups, CAST(keys AS BIGINT) AS keys, CAST(temporary AS BIGINT) AS temporary, CAST(allm - ids - keys AS BIGINT) AS malformed FROM (
 SELECT doc_id, sum(len(regexp_extract_all(text, '(?i)\[PMIDs?\s*:\s*\d{1,9}(?:(?:\s*[,;]\s*|\s+)\d{1,9})*\s*[,;]?\s*\]'))) AS ids,
  sum(len(regexp_extract_all(text, '(?i)\[REF\s*:\s*[^\[\]]+\]'))) AS keys, sum(len(regexp_extract_all(text, '\{[^{}]+#\s*\d+[^{}]*\}'))) AS temporary,
  sum(len(regexp_extract_all(text, '(?i)\[(?:PMIDs?|REF)\b[^\]\n]*\]?'))) AS allm
 FROM (SELECT doc_id, """ + MARKED + r""" AS text FROM documents) GROUP BY doc_id) WHERE ids + keys + temporary + allm > 0""")
def e3(spark, sf):
    return R.inventory_summary(R.placeholder_inventory(marked_paragraphs(spark, sf))).drop("id_occurrences")


@query("e4_parse_temporary", """
SELECT o_orderkey, unnest([CASE WHEN o_custkey % 3 = 0 THEN 'Doe;Co' ELSE 'Doe' END, 'Roe' || o_custkey]) AS author, unnest(['2020', NULL]) AS year, unnest([CAST(o_custkey AS VARCHAR), '7']) AS recnum FROM orders""")
def e4(spark, sf):
    body = F.expr("concat(CASE WHEN o_custkey % 3 = 0 THEN 'Doe`;Co' ELSE 'Doe' END, ', 2020 #', o_custkey, '; Roe', o_custkey, ' #7')")
    cites = R.parse_temporary(body)
    return table(spark, sf, "orders").select("o_orderkey", F.explode(cites).alias("c")).select(
        "o_orderkey", "c.author", "c.year", "c.recnum")


@query("e5_ids_in_order", """
SELECT doc_id, id, source, pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, id ORDER BY source, pos) AS r FROM (
  SELECT user_id AS doc_id, event_id % 50 AS id, 0 AS source, event_id AS pos FROM events WHERE event_type = 'view'
  UNION ALL SELECT user_id, event_id % 70, 1, event_id FROM events WHERE event_type = 'click')) WHERE r = 1""")
def e5(spark, sf):
    e = table(spark, sf, "events")
    part = lambda kind, n: e.where(F.col("event_type") == kind).selectExpr(
        "user_id AS doc_id", f"event_id % {n} AS id", "event_id AS pos")
    return R.ids_in_order(part("view", 50), part("click", 70)).select("doc_id", "id", "at.source", "at.pos")


# Citation fields derived from order lines: the supplier is the document, the part the record.
CITE_FIELDS = """l_suppkey AS doc_id, l_orderkey * 10 + l_linenumber AS field_index, concat('lib', l_linenumber % 2) AS db_id,
  l_partkey AS recnum, concat('Name', l_partkey % 40, ', A') AS author, concat('', 1990 + l_partkey % 30) AS year,
  concat('Title ', l_partkey) AS title, CASE WHEN l_partkey % 6 = 0 THEN '' ELSE concat('', l_partkey % 900) END AS pmid,
  CASE WHEN l_partkey % 3 <> 0 THEN concat('10.1000/P', l_partkey % 500) END AS doi,
  CASE WHEN l_partkey % 5 <> 0 THEN concat('', l_partkey % 100, '-9') END AS pages, CASE WHEN l_partkey % 4 = 0 THEN '6' ELSE '17' END AS ref_type"""
CITES_SQL = f"SELECT {CITE_FIELDS} FROM lineitem"
RECORDS_SQL = f"SELECT DISTINCT * EXCLUDE (field_index) FROM ({CITES_SQL})"


def cites(spark, sf):
    rows = table(spark, sf, "lineitem")
    return spark.sql(f"SELECT {CITE_FIELDS} FROM {{rows}}", rows=rows)


def records(spark, sf):
    return R.distinct_records(cites(spark, sf))


@query("e6_citation_census", f"""
SELECT doc_id, CAST(sum(n) AS BIGINT) AS occurrences, count(*) AS records, count(DISTINCT db_id) AS libraries,
  count_if(ref_type = '17' AND coalesce(pages, '') = '') AS missing_pages, count_if(coalesce(doi, '') = '') AS missing_doi
FROM (SELECT doc_id, db_id, recnum, ref_type, pages, doi, count(*) AS n FROM ({CITES_SQL}) GROUP BY ALL) GROUP BY doc_id""")
def e6(spark, sf):
    return R.citation_census(cites(spark, sf))


@query("e7_dangling_targets", """
SELECT DISTINCT target FROM (SELECT unnest(regexp_extract_all(html, 'href="(/[^"#?]*)"', 1)) AS target FROM pages)
WHERE target NOT IN (SELECT regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) FROM pages)""")
def e7(spark, sf):
    p = table(spark, sf, "pages")
    links = p.select(F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"#?]*)"'), F.lit(1))).alias("target"))
    targets = p.select(F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1).alias("target"))
    return R.dangling_targets(links, targets, ["target"])


ENTRIES_SQL = f"""SELECT doc_id, para_idx, CAST(nullif(regexp_extract(trim(text), '^\\[?([0-9]{{1,4}})[\\].\\t ]', 1), '') AS INTEGER) AS number, trim(text) AS text,
  nullif(regexp_extract(trim(text), '(10[.][0-9]{{4,9}}/[^\\s"<>]+[^\\s"<>.,;])', 1), '') AS doi FROM ({PARAS_SQL}) WHERE is_bib AND trim(text) <> ''"""


def entries(spark, sf):
    return R.bibliography_entries(structured_paragraphs(manuscripts(spark, sf)))


@query("e8_bib_entries", ENTRIES_SQL)
def e8(spark, sf):
    return entries(spark, sf)


@query("e9_record_gaps", f"""
SELECT doc_id, db_id, recnum, 'pages' AS gap FROM ({RECORDS_SQL}) WHERE ref_type = '17' AND pages IS NULL
UNION ALL SELECT doc_id, db_id, recnum, 'doi' FROM ({RECORDS_SQL}) WHERE doi IS NULL
UNION ALL SELECT doc_id, db_id, recnum, 'pmid' FROM ({RECORDS_SQL}) WHERE ref_type = '17' AND pmid = ''""")
def e9(spark, sf):
    return R.record_gaps(records(spark, sf))


@query("e10_author_checks", f"""
SELECT doc_id, db_id, recnum, unnest(CASE recnum % 3 WHEN 0 THEN ['Trial Group,', 'Jane Roe'] WHEN 1 THEN ['Data Committee of X'] ELSE ['X Y'] END) AS author_name,
  unnest(CASE recnum % 3 WHEN 0 THEN ['corporate', 'no comma'] WHEN 1 THEN ['corporate suspect'] ELSE ['no comma'] END) AS kind FROM ({RECORDS_SQL})""")
def e10(spark, sf):
    rows = records(spark, sf).withColumn("authors", F.expr(
        "CASE recnum % 3 WHEN 0 THEN array('Trial Group,', 'Doe, A', 'Jane Roe') WHEN 1 THEN array('Data Committee of X', 'Mono') "
        "ELSE array('X Y') END"))
    return R.author_checks(rows)


@query("e11_author_year_collisions", f"""
SELECT * FROM (SELECT doc_id, lower(split_part(author, ',', 1)) AS author_label, year, count(*) OVER (PARTITION BY doc_id, lower(split_part(author, ',', 1)), year) AS members, recnum AS member
FROM ({RECORDS_SQL}) WHERE author IS NOT NULL AND year IS NOT NULL) WHERE members > 1""")
def e11(spark, sf):
    return R.author_year_collisions(records(spark, sf))


@query("e12_recnum_collisions", f"""
SELECT * FROM (SELECT doc_id, recnum, count(*) OVER (PARTITION BY doc_id, recnum) AS members, db_id AS member FROM (SELECT DISTINCT doc_id, recnum, db_id FROM ({RECORDS_SQL}))) WHERE members > 1""")
def e12(spark, sf):
    return R.recnum_collisions(records(spark, sf))


@query("e13_duplicate_ids", f"""
SELECT * FROM (SELECT doc_id, lower(doi) AS id, count(*) OVER (PARTITION BY doc_id, lower(doi)) AS members, recnum AS member, 'doi' AS kind FROM ({RECORDS_SQL}) WHERE doi IS NOT NULL) WHERE members > 1
UNION ALL SELECT * FROM (SELECT doc_id, pmid, count(*) OVER (PARTITION BY doc_id, pmid), recnum, 'pmid' FROM ({RECORDS_SQL}) WHERE pmid <> '') t(doc_id, id, members, member, kind) WHERE members > 1""")
def e13(spark, sf):
    return R.duplicate_ids(records(spark, sf))


@query("e14_numbering_audit", """
WITH n AS (SELECT o_custkey AS doc_id, o_orderkey AS pos, CAST(1 + (o_orderkey + o_custkey) % 7 AS INTEGER) AS number FROM orders),
r AS (SELECT *, row_number() OVER w AS rk, lag(number) OVER w AS b FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, count(*) AS numbered, bool_and(number = rk) AS contiguous, bool_and(coalesce(b <= number, true)) AS in_order, count(*) - count(DISTINCT number) AS repeats,
  array_to_string(list_filter(generate_series(1, max(number)), lambda x: NOT list_contains(list(number), CAST(x AS INTEGER))), ' ') AS gaps FROM r GROUP BY doc_id""")
def e14(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(
        "o_custkey AS doc_id", "o_orderkey AS para_idx", "cast(1 + (o_orderkey + o_custkey) % 7 as int) AS number")
    return R.numbering_audit(rows).withColumn("gaps", F.array_join("gaps", " "))


@query("e15_entry_year", f"""
SELECT doc_id, para_idx, CASE WHEN contains(text, ';12:') THEN 1990 + doc_id % 30 WHEN contains(text, '(2001)') THEN 2001 ELSE 2003 END AS year,
  CASE WHEN contains(text, ';12:') THEN 'vancouver' WHEN contains(text, '(2001)') THEN 'author_date' ELSE 'year_dot' END AS form FROM ({ENTRIES_SQL})""")
def e15(spark, sf):
    year = R.entry_year(F.col("text"), F.col("doi"))
    return entries(spark, sf).select("doc_id", "para_idx", year["year"].cast("int").alias("year"),
                                     year["form"].alias("form"))


INDEX_FIELDS = """p_partkey AS load_order, CASE WHEN p_size % 2 = 0 THEN 'article' ELSE 'work' END AS source,
  concat('', p_partkey % 300) AS pmid, concat('10.1000/D', p_partkey % 250) AS doi, p_name AS title"""


def index_records(spark, sf):
    return spark.sql(f"SELECT {INDEX_FIELDS} FROM {{rows}}", rows=table(spark, sf, "part"))


INDEX_SQL = f"""WITH recs AS (SELECT {INDEX_FIELDS} FROM part),
by_id AS (SELECT pmid, min(load_order) AS load_order FROM recs WHERE source = 'article' GROUP BY pmid),
by_doi AS (SELECT lower(doi) AS doi, coalesce(min(load_order) FILTER (source = 'article'), min(load_order)) AS load_order FROM recs GROUP BY lower(doi))"""


@query("e16_record_index", INDEX_SQL + " SELECT 'id' AS kind, pmid AS key, load_order FROM by_id UNION ALL SELECT 'doi', doi, load_order FROM by_doi")
def e16(spark, sf):
    by_id, by_doi = R.record_index(index_records(spark, sf))
    return by_id.select(F.lit("id").alias("kind"), F.col("pmid").alias("key"), "r.load_order").unionByName(
        by_doi.select(F.lit("doi").alias("kind"), F.col("doi").alias("key"), "r.load_order"))


@query("e17_lookup", INDEX_SQL + """ SELECT o_orderkey, coalesce(i.load_order, d.load_order) AS load_order FROM orders
LEFT JOIN by_id i ON i.pmid = CAST(o_custkey % 400 AS VARCHAR) LEFT JOIN by_doi d ON d.doi = '10.1000/d' || o_orderkey % 300""")
def e17(spark, sf):
    by_id, by_doi = R.record_index(index_records(spark, sf))
    requests = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "concat('', o_custkey % 400) AS pmid", "concat('10.1000/D', o_orderkey % 300) AS doi")
    return R.lookup(requests, by_id, by_doi).select("o_orderkey", F.col("record.load_order").alias("load_order"))


_STOP = "[" + ", ".join(quoted(w) for w in M.STOPWORDS) + "]"
_TOKENS = "regexp_extract_all(lower(strip_accents({0})), '[a-z0-9]+')"
COVERAGE_SQL = f"""round(len(list_filter(w, lambda x: list_contains(t, x))) / len(w), 3)"""


@query("e18_title_coverage", f"""
SELECT doc_id, item_id, {COVERAGE_SQL} AS coverage FROM (SELECT d.doc_id, b.item_id, list_filter({_TOKENS.format('b.text')}, lambda x: NOT list_contains({_STOP}, x) AND length(x) > 1) AS w, list_distinct({_TOKENS.format('d.text')}) AS t
FROM documents d JOIN benchmark b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id)""")
def e18(spark, sf):
    b = table(spark, sf, "benchmark").withColumnRenamed("text", "title")
    d = table(spark, sf, "documents").withColumn("item_id", F.col("doc_id") % b.count())
    return d.join(b, "item_id").select("doc_id", "item_id", M.title_coverage("title", "text").alias("coverage"))


@query("e19_best_title_match", f"""
WITH d AS (SELECT doc_id, list_distinct({_TOKENS.format('text')}) AS t FROM documents),
b AS (SELECT item_id, list_filter({_TOKENS.format('text')}, lambda x: NOT list_contains({_STOP}, x) AND length(x) > 1) AS w FROM benchmark),
s AS (SELECT doc_id, item_id, {COVERAGE_SQL} AS coverage FROM d, b WHERE len(w) > 0)
SELECT doc_id, arg_min(item_id, (-coverage, item_id)) AS item_id, max(coverage) AS coverage FROM s WHERE coverage >= 0.9 GROUP BY doc_id""")
def e19(spark, sf):
    found = M.best_title_match(
        table(spark, sf, "documents").select(F.col("doc_id").alias("entry_id"), "text"),
        table(spark, sf, "benchmark").select(F.col("item_id").alias("record_id"), F.col("text").alias("title")))
    return found.select(F.col("entry_id").alias("doc_id"), F.col("record_id").alias("item_id"), "coverage")


#: Records that entries cite: every item of the benchmark, and twenty that do not exist.
MODULUS_SQL = "(SELECT count(*) + 20 FROM benchmark)"


def with_modulus(spark, sf, text):
    return text.replace("MODULUS", str(table(spark, sf, "benchmark").count() + 20))


AUDIT_ENTRY = """text || CASE doc_id % 3 WHEN 0 THEN ' J Test. 2016;4:5. doi:10.1000/r' || (doc_id % MODULUS) WHEN 1 THEN ' (1995)' ELSE '' END"""


@query("e20_bib_audit", f"""
WITH d AS (SELECT doc_id // 5 AS doc_id, doc_id % 5 AS para_idx, CASE WHEN doc_id % 3 = 0 THEN '10.1000/r' || (doc_id % MODULUS) END AS doi,
   CASE doc_id % 3 WHEN 0 THEN 2016 WHEN 1 THEN 1995 END AS yr, list_distinct({_TOKENS.format(AUDIT_ENTRY)}) AS t FROM documents),
b AS (SELECT item_id, '10.1000/r' || item_id AS doi, 2010 + item_id % 8 AS yr, list_filter({_TOKENS.format('text')}, lambda x: NOT list_contains({_STOP}, x) AND length(x) > 1) AS w FROM benchmark),
s AS (SELECT doc_id, para_idx, item_id, {COVERAGE_SQL} AS coverage FROM d, b WHERE d.doi IS NULL AND len(w) > 0),
m AS (SELECT doc_id, para_idx, arg_min(item_id, (-coverage, item_id)) AS item_id FROM s WHERE coverage >= 0.9 GROUP BY ALL),
j AS (SELECT d.*, count(*) OVER (PARTITION BY d.doc_id, d.doi) AS copies, coalesce(bd.item_id, m.item_id) AS item, coalesce(bd.yr, bm.yr) AS ryr, coalesce(bd.w, bm.w) AS w,
   CASE WHEN bd.item_id IS NOT NULL THEN 'doi' WHEN m.item_id IS NOT NULL THEN 'title' END AS matched_by
   FROM d LEFT JOIN b bd ON bd.doi = d.doi LEFT JOIN m USING (doc_id, para_idx) LEFT JOIN b bm ON bm.item_id = m.item_id)
SELECT doc_id, para_idx, matched_by, array_to_string(list_filter([CASE WHEN doi IS NULL THEN 'NO_DOI' END, CASE WHEN doi IS NOT NULL AND copies > 1 THEN 'DUPLICATE_DOI' END,
  CASE WHEN item IS NULL THEN CASE WHEN CAST(regexp_extract(doi, '[0-9]+$') AS INTEGER) >= MODULUS - 10 THEN 'FETCH_ERROR' ELSE 'NO_RECORD' END END,
  CASE WHEN item IS NOT NULL AND {COVERAGE_SQL} < 0.5 THEN 'TITLE_MISMATCH' END,
  CASE WHEN item IS NOT NULL AND yr IS NULL THEN 'YEAR_NOT_FOUND' WHEN item IS NOT NULL AND abs(yr - ryr) > 1 THEN 'YEAR_MISMATCH' END], lambda x: x IS NOT NULL), ',') AS issues FROM j""".replace("MODULUS", MODULUS_SQL))
def e20(spark, sf):
    rows = table(spark, sf, "documents").selectExpr(
        "cast(floor(doc_id / 5) as bigint) AS doc_id", "doc_id % 5 AS para_idx", "cast(null as int) AS number",
        with_modulus(spark, sf, f"{AUDIT_ENTRY} AS text"), with_modulus(spark, sf, "CASE WHEN doc_id % 3 = 0 THEN concat('10.1000/r', doc_id % MODULUS) END AS doi"))
    recs = table(spark, sf, "benchmark").selectExpr(
        "item_id AS load_order", "'work' AS source", "cast(null as string) AS pmid", "concat('10.1000/r', item_id) AS doi",
        "text AS title", "array(cast(2010 + item_id % 8 as int)) AS years")
    failed = table(spark, sf, "documents").where(with_modulus(spark, sf, "doc_id % MODULUS >= MODULUS - 10")).selectExpr(with_modulus(spark, sf, "concat('10.1000/r', doc_id % MODULUS) AS doi"))
    return R.bibliography_audit(rows, recs, failed).select(
        "doc_id", "para_idx", "matched_by", F.array_join("issues", ",").alias("issues"))


def claim_inputs(spark, sf):
    rows = paragraphs(table(spark, sf, "documents")).withColumn("section", F.lit("Results"))
    markers = rows.selectExpr(
        "doc_id", "para_idx", "doc_id * 1000 + para_idx AS field_index", "cast((doc_id * 37 + para_idx) % greatest(length(text), 1) as int) AS position",
        with_modulus(spark, sf, "concat('', doc_id % MODULUS) AS pmid"), "cast(null as string) AS doi")
    recs = table(spark, sf, "benchmark").selectExpr(
        "item_id AS load_order", "'article' AS source", "concat('', item_id) AS pmid", "cast(null as string) AS doi",
        "CASE WHEN item_id % 5 <> 0 THEN text END AS abstract")
    return rows, markers, recs


@query("e21_claim_items")
def e21(spark, sf):
    rows, markers, recs = claim_inputs(spark, sf)
    items = R.claim_items(rows, markers, recs, 0)
    return items.select("doc_id", "para_idx", "field_index", F.sha2("claim", 256).alias("claim"),
                        F.length("context_before").alias("before"), F.length("context_after").alias("after"),
                        "abstract_available", "abstract_truncated")


@query("e22_claim_manifest", r"""
SELECT count(*) AS fields, count(*) AS occurrences, count(DISTINCT doc_id % MODULUS) AS records, count_if(doc_id % MODULUS >= n OR doc_id % MODULUS % 5 = 0) AS without_abstract,
  0::BIGINT AS truncated
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) d LEFT JOIN benchmark b ON b.item_id = d.doc_id % MODULUS, (SELECT max(item_id) + 1 AS n FROM benchmark)""".replace("MODULUS", MODULUS_SQL))
def e22(spark, sf):
    rows, markers, recs = claim_inputs(spark, sf)
    return R.claim_manifest(R.claim_items(rows, markers, recs, 0))


VERDICT_FIELDS = """o_orderkey AS file_order, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey - 1 END AS field_index,
  CASE o_orderkey % 7 WHEN 0 THEN 'MAYBE' WHEN 1 THEN 'WEAK' WHEN 2 THEN 'SUPPORTED' WHEN 3 THEN 'UNVERIFIED_NO_ABSTRACT' ELSE 'MISMATCH' END AS verdict,
  CASE WHEN o_orderkey % 13 = 0 THEN ' ' ELSE 'because' END AS reason, CASE o_orderkey % 3 WHEN 0 THEN 'TEXT' WHEN 1 THEN 'REUSE' ELSE 'NONE' END AS suggested_action,
  CASE o_orderkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' END AS confidence, CASE WHEN o_orderkey % 9 = 0 THEN 2 END AS tier"""
VERDICT_SQL = f"""WITH v AS (SELECT {VERDICT_FIELDS}, concat('k', o_custkey % 5) AS cited_key FROM orders),
c AS (SELECT v.*, i.c_custkey AS item, CASE WHEN field_index IS NULL THEN 'missing ''field_index'',' ELSE '' END || CASE WHEN field_index < 0 THEN 'bad field_index,' ELSE '' END
   || CASE WHEN verdict = 'MAYBE' THEN 'bad verdict,' ELSE '' END || CASE WHEN trim(reason) = '' THEN 'reason is empty,' ELSE '' END
   || CASE WHEN field_index IS NOT NULL AND i.c_custkey IS NULL THEN 'not an item,' ELSE '' END
   || CASE WHEN i.c_custkey IS NOT NULL AND cited_key NOT IN (concat('k', (i.c_custkey + 1) % 5), CASE WHEN i.c_custkey % 2 = 0 THEN 'k0' ELSE 'k1' END) THEN 'unknown key,' ELSE '' END AS e
  FROM v LEFT JOIN (SELECT * FROM customer) i ON i.c_custkey = field_index),
d AS (SELECT *, CASE WHEN e = '' AND file_order > min(file_order) FILTER (e = '') OVER (PARTITION BY field_index) THEN 'duplicate,' ELSE e END AS errors FROM c),
ok AS (SELECT *, CASE verdict WHEN 'WEAK' THEN 'weak' WHEN 'SUPPORTED' THEN 'supported' WHEN 'UNVERIFIED_NO_ABSTRACT' THEN 'unverified' ELSE
   CASE WHEN tier IS NOT NULL THEN 'tier' || tier WHEN suggested_action = 'TEXT' THEN 'tier3' WHEN confidence = 'high' THEN 'tier1' ELSE 'tier2' END END AS tier_name FROM d WHERE errors = '')
"""


def verdict_inputs(spark, sf):
    v = spark.sql(f"SELECT {VERDICT_FIELDS}, array(concat('k', o_custkey % 5)) AS cited FROM {{rows}}",
                  rows=table(spark, sf, "orders"))
    items = table(spark, sf, "customer").selectExpr(
        "c_custkey AS field_index", "array(concat('k', (c_custkey + 1) % 5), CASE WHEN c_custkey % 2 = 0 THEN 'k0' ELSE 'k1' END) AS keys")
    return v, items


def valid_verdicts(spark, sf):
    v, items = verdict_inputs(spark, sf)
    return R.validate_verdicts(v, items).where(F.size("errors") == 0), items


@query("e23_validate_verdicts", VERDICT_SQL + "SELECT file_order, rtrim(errors, ',') AS errors FROM d")
def e23(spark, sf):
    return R.validate_verdicts(*verdict_inputs(spark, sf)).select("file_order", F.array_join("errors", ",").alias("errors"))


@query("e24_verdict_tier", VERDICT_SQL + "SELECT file_order, tier_name FROM ok")
def e24(spark, sf):
    return valid_verdicts(spark, sf)[0].select("file_order", R.verdict_tier().alias("tier_name"))


@query("e25_verdict_rollup", VERDICT_SQL + "SELECT verdict, tier_name, suggested_action, count(*) AS n, min(field_index) AS first_field FROM ok GROUP BY ALL")
def e25(spark, sf):
    return R.verdict_rollup(valid_verdicts(spark, sf)[0])


@query("e25_action_fields", VERDICT_SQL + "SELECT DISTINCT suggested_action, field_index FROM ok WHERE suggested_action <> 'NONE'")
def e25_fields(spark, sf):
    return R.action_fields(valid_verdicts(spark, sf)[0])


@query("e26_not_judged", VERDICT_SQL + "SELECT c_custkey AS field_index FROM customer WHERE c_custkey NOT IN (SELECT field_index FROM ok)")
def e26(spark, sf):
    valid, items = valid_verdicts(spark, sf)
    return R.not_judged(items, valid)


RESOLVE = "concat(text, ' as [PMID: ', doc_id % 400, '] and [PMIDs: ', doc_id % 90, ', ', doc_id % 70, '] say.')"
_REC = "'N' || ({0} % 9) || ', ' || (2000 + {0} % 20) || ' #' || ({0} + 1)"


def library(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "concat('', p_partkey) AS pmid", "p_partkey + 1 AS rec_number", "CASE WHEN p_partkey % 10 <> 0 THEN concat('N', p_partkey % 9) END AS surname",
        "2000 + p_partkey % 20 AS year", "CASE WHEN p_partkey % 8 = 0 THEN 2 ELSE 1 END AS copies")


@query("e27_resolve_placeholders", f"""
WITH g AS (SELECT doc_id, doc_id % 400 AS a, doc_id % 90 AS b, doc_id % 70 AS c, (SELECT max(p_partkey) FROM part) AS top FROM documents),
k AS (SELECT *, a <= top AND a % 10 <> 0 AND a % 8 <> 0 AS ok1, b <= top AND c <= top AND b <> c AND b % 10 <> 0 AND b % 8 <> 0 AND c % 10 <> 0 AND c % 8 <> 0 AS ok2 FROM g)
SELECT d.doc_id, sha256(text || ' as ' || CASE WHEN ok1 THEN '{{' || {_REC.format('a')} || '}}' ELSE '[PMID: ' || a || ']' END || ' and '
  || CASE WHEN ok2 THEN '{{' || {_REC.format('b')} || ';' || {_REC.format('c')} || '}}' ELSE '[PMIDs: ' || b || ', ' || c || ']' END || ' say.') AS digest
FROM documents d JOIN k USING (doc_id)""")
def e27(spark, sf):
    rows = table(spark, sf, "documents").selectExpr("doc_id", "0 AS para_idx", f"{RESOLVE} AS text")
    texts, _ = R.resolve_placeholders(rows, library(spark, sf))
    return texts.select("doc_id", F.sha2("text", 256).alias("digest"))


@query("e28_fetch_status", """
SELECT c_custkey AS pmid, CASE WHEN c_custkey IN (SELECT s_suppkey * 7 FROM supplier) THEN 'fetch_error' WHEN p.p_partkey IS NULL THEN 'not_found' WHEN p.p_size % 3 = 0 THEN 'no_abstract' ELSE 'ok' END AS status
FROM customer LEFT JOIN part p ON p.p_partkey = c_custkey""")
def e28(spark, sf):
    requested = table(spark, sf, "customer").selectExpr("c_custkey AS pmid")
    fetched = table(spark, sf, "part").selectExpr(
        "p_partkey AS pmid", "CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END AS abstract")
    failed = table(spark, sf, "supplier").selectExpr("s_suppkey * 7 AS pmid")
    return R.fetch_status(requested, fetched, failed)


_NORM = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


@query("e29_reference_trace", f"""
WITH b AS (SELECT item_id, {_NORM.format('text')} AS probe FROM benchmark), d AS (SELECT doc_id, {_NORM.format('text')} AS body FROM documents),
m AS (SELECT item_id, doc_id, contains(body, probe) AS f, length(probe) > 30 AND contains(body, trim(substr(probe, 1, 30))) AS p FROM b, d WHERE length(probe) >= 8),
k AS (SELECT *, bool_or(f) OVER (PARTITION BY item_id) AS anyf FROM m WHERE f OR p)
SELECT b.item_id AS probe_id, coalesce(CASE WHEN k.anyf THEN 'full' ELSE CASE WHEN k.p THEN 'prefix30' END END, CASE WHEN coalesce(length(probe), 0) < 8 THEN 'too short' ELSE 'none' END) AS match, k.doc_id AS page_id FROM b LEFT JOIN (SELECT * FROM k WHERE f OR NOT anyf) k USING (item_id)""")
def e29(spark, sf):
    return M.reference_trace(
        table(spark, sf, "benchmark").select(F.col("item_id").alias("probe_id"), "text"),
        table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), "text"))


LINKED = """text || chr(10) || 'See [a](n' || (doc_id + 1) || '.md) and [up](../x/../g' || (doc_id % 9) || '/n' || (doc_id % 50) || '.md#top), [out](../../z.md), [web](https://example.org/a), [frag](#x).'
  || CASE WHEN doc_id % 6 = 0 THEN chr(10) || 'A TODO here.' ELSE '' END"""


@query("e30_local_links", """
WITH f AS (SELECT 'g' || (doc_id % 9) || '/n' || doc_id || '.md' AS path FROM documents),
l AS (SELECT doc_id, 'g' || (doc_id % 9) || '/n' || doc_id || '.md' AS path, length(text) - length(replace(text, chr(10), '')) + 2 AS line FROM documents)
SELECT path, line, 'n' || (doc_id + 1) || '.md' AS item, 'missing file' AS problem FROM l WHERE 'g' || (doc_id % 9) || '/n' || (doc_id + 1) || '.md' NOT IN (SELECT path FROM f)
UNION ALL SELECT path, line, '../x/../g' || (doc_id % 9) || '/n' || (doc_id % 50) || '.md#top', 'missing file' FROM l WHERE 'g' || (doc_id % 9) || '/n' || (doc_id % 50) || '.md' NOT IN (SELECT path FROM f)
UNION ALL SELECT path, line, '../../z.md', 'leaves its root' FROM l
UNION ALL SELECT path, line + 1, 'TODO', 'unfinished marker' FROM l WHERE doc_id % 6 = 0""")
def e30(spark, sf):
    d = table(spark, sf, "documents")
    path = "concat('g', doc_id % 9, '/n', doc_id, '.md') AS path"
    return R.local_link_audit(d.selectExpr(path, f"{LINKED} AS text"), d.selectExpr(path))

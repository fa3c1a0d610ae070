"""Named queries: text units."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofline.functions import text as T
from proofline.operators import units as U
from proofline.plans.catalog import MANUSCRIPT_LINES_SQL, manuscripts, query, quoted, table

LINES_SQL = """
SELECT doc_id, CAST(i - 1 AS INTEGER) AS para_idx, lines[i] AS text
FROM (SELECT doc_id, lines, unnest(generate_series(1, len(lines))) AS i
      FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))
"""


@query("b1_paragraphs", f"""
SELECT doc_id, para_idx, sha256(text) AS digest, len(regexp_extract_all(text, '\\S+')) AS words FROM ({LINES_SQL})""")
def b1(spark, sf):
    return U.paragraphs(table(spark, sf, "documents")).select(
        "doc_id", "para_idx", F.sha2("text", 256).alias("digest"), "words")


@query("b2_words", "SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS words FROM documents")
def b2(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.word_count("text").alias("words"))


@query("b3_fold_tokens", """
SELECT doc_id, len(t) AS tokens, sha256(array_to_string(t, ' ')) AS digest
FROM (SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[a-z0-9]+') AS t FROM documents)""")
def b3(spark, sf):
    tokens = T.fold_tokens("text")
    return table(spark, sf, "documents").select(
        "doc_id", F.size(tokens).alias("tokens"), F.sha2(F.array_join(tokens, " "), 256).alias("digest"))


_ABBR = "|".join(w.replace(".", "[.]") for w in sorted(T.SENTENCE_ABBREVIATIONS, key=len, reverse=True))
# the same rule without lookaround: hide the stop of an abbreviation, then cut after real stops
SENTENCES_SQL = f"""
SELECT doc_id, para_idx, trim(s) AS sentence FROM (
  SELECT doc_id, para_idx, unnest(string_split(regexp_replace(regexp_replace(text,
      {quoted("(^|[ ])([(]?(?:" + _ABBR + "|[A-Za-z]))[.]([ ]|$)")}, '\\1\\2' || chr(2) || '\\3', 'gi'),
      '([.!?]+["'')]*)([ ]+[\\p{{Lu}}0-9(]|[ ]*$)', '\\1' || chr(1) || '\\2', 'g'), chr(1))) AS s
  FROM (@lines)) WHERE trim(s) <> ''"""


@query("b4_sentence_spans", f"""
SELECT doc_id, para_idx, count(*) AS sentences, sum(length(replace(sentence, chr(2), '.'))) AS chars
FROM ({SENTENCES_SQL.replace('@lines', LINES_SQL)}) GROUP BY ALL""")
def b4(spark, sf):
    rows = U.paragraphs(table(spark, sf, "documents")).select(
        "doc_id", "para_idx", T.sentence_spans("text").alias("s")).where(F.size("s") > 0)
    chars = F.aggregate("s", F.lit(0), lambda acc, x: acc + x["end"] - x["start"])
    return rows.select("doc_id", "para_idx", F.size("s").alias("sentences"), chars.alias("chars"))


@query("l5_sentences_function", f"""
SELECT doc_id, para_idx, sha256(replace(sentence, chr(2), '.')) AS sentence FROM ({SENTENCES_SQL.replace('@lines', LINES_SQL)})""")
def l5(spark, sf):
    """The sentences of every line, asked for in SQL."""
    T.register_sentences(spark)
    lines = U.paragraphs(table(spark, sf, "documents")).select("doc_id", "para_idx", "text")
    return spark.sql("SELECT doc_id, para_idx, sha2(s.sentence, 256) AS sentence FROM {lines}, LATERAL sentence_rows(text) AS s", lines=lines)


def region_case(text: str) -> str:
    return f"""CASE WHEN level = 1 AND regexp_matches({text}, '^(abstract|summary)', 'i') THEN 'abstract'
      WHEN level = 1 AND regexp_matches({text}, '^references', 'i') THEN 'references'
      WHEN level BETWEEN 1 AND 2 AND regexp_matches({text}, '^figure legends', 'i') THEN 'legends'
      WHEN level = 1 THEN 'body'
      WHEN level = 0 AND lower(trim({text})) = 'abbreviations' THEN 'front' END"""


# In the derived manuscripts the headings follow the usual order, so the last event decides.
REGIONS_SQL = f"""
SELECT doc_id, para_idx, level, text,
  coalesce(last_value(event IGNORE NULLS) OVER w, 'title') AS region,
  coalesce(last_value(CASE WHEN level > 0 THEN substr(trim(text), 1, 60) END IGNORE NULLS) OVER w, '') AS section
FROM (SELECT *, {region_case('text')} AS event FROM ({MANUSCRIPT_LINES_SQL}))
WINDOW w AS (PARTITION BY doc_id ORDER BY para_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""


@query("b5_regions", f"SELECT doc_id, para_idx, level, region, section FROM ({REGIONS_SQL})")
def b5(spark, sf):
    return U.structured_paragraphs(manuscripts(spark, sf)).select("doc_id", "para_idx", "level", "region", "section")


@query("b5_regions_from_rows", f"SELECT doc_id, para_idx, level, region, section FROM ({REGIONS_SQL})")
def b5_rows(spark, sf):
    paras = U.structured_paragraphs(manuscripts(spark, sf)).select("doc_id", "para_idx", "level", "text", "in_table")
    return U.assign_regions(paras).select("doc_id", "para_idx", "level", "region", "section")


@query("b6_heading_of", f"""
SELECT doc_id, para_idx, coalesce(last_value(CASE WHEN level > 0 THEN trim(text) END IGNORE NULLS) OVER (
  PARTITION BY doc_id ORDER BY para_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS heading
FROM ({MANUSCRIPT_LINES_SQL})""")
def b6(spark, sf):
    return U.heading_of(U.structured_paragraphs(manuscripts(spark, sf))).select("doc_id", "para_idx", "heading")


@query("b7_mask", f"""
SELECT doc_id, para_idx, length(text) AS chars,
  length(text) - length(regexp_replace(text, {quoted('doi:[ ]*[^ ]+|10[.][0-9]{4,9}/[^ ]+|[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+([.][A-Za-z0-9_-]+)+')}, '', 'g')) AS masked
FROM ({MANUSCRIPT_LINES_SQL})""")
def b7(spark, sf):
    paras = U.structured_paragraphs(manuscripts(spark, sf))
    return paras.select("doc_id", "para_idx", F.length("masked").alias("chars"),
                        F.regexp_count("masked", F.lit("\u0000")).alias("masked"))


@query("b8_spans", """
SELECT doc_id, len(m) AS matches, list_aggregate(list_transform(m, lambda x: length(x)), 'sum') AS chars
FROM (SELECT doc_id, regexp_extract_all(text, '[aeiou][a-z]*[.,]') AS m FROM documents) WHERE len(m) > 0""")
def b8(spark, sf):
    # found once a text and handed on as a variable; four bytes a character, so that a place is found without counting from the start of the text
    both = F.struct(F.encode("text", "UTF-32").alias("wide"), T.spans("text", "[aeiou][a-z]*[.,]").alias("s"))
    part = lambda r, x: F.substr(r["wide"], x["start"] * 4 + 1, (x["end"] - x["start"]) * 4)
    measured = F.transform(F.array(both), lambda r: F.struct(
        F.size(r["s"]).alias("matches"), F.aggregate(r["s"], F.lit(0), lambda acc, x: acc + x["end"] - x["start"]).alias("chars"),
        F.forall(r["s"], lambda x: part(r, x) == F.encode(x["match"], "UTF-32")).alias("same")))
    rows = table(spark, sf, "documents").select("doc_id", F.inline(measured))
    return rows.where("matches > 0 AND same").select("doc_id", "matches", "chars")


SNIPPET_SQL = """
SELECT doc_id, CASE WHEN hi - lo > 74 THEN substr(text, lo + 1, 77) || '...' ELSE
  (CASE WHEN a > 0 THEN '...' ELSE '' END) || substr(text, a + 1, least(n, hi + (74 - (hi - lo)) - (lo - a)) - a)
  || (CASE WHEN least(n, hi + (74 - (hi - lo)) - (lo - a)) < n THEN '...' ELSE '' END) END AS snippet
FROM (SELECT *, greatest(0, lo - (74 - (hi - lo)) // 2) AS a
      FROM (SELECT doc_id, replace(text, chr(10), ' ') AS text, length(text) AS n,
            least(CAST(doc_id % 300 AS BIGINT), length(text)) AS lo,
            greatest(least(CAST(doc_id % 300 + 9 AS BIGINT), length(text)), least(CAST(doc_id % 300 AS BIGINT), length(text))) AS hi
            FROM documents))"""


@query("b9_snippet", SNIPPET_SQL)
def b9(spark, sf):
    start = (F.col("doc_id") % 300).cast("int")
    return table(spark, sf, "documents").select("doc_id", T.snippet("text", start, start + 9).alias("snippet"))


@query("b10_heading_level", """
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size % 10 ELSE 0 END AS level FROM part""")
def b10(spark, sf):
    style = F.when((F.col("p_size") % 3 == 0) & (F.col("p_size") % 10 > 0),
                   F.concat(F.lit("Heading_"), F.col("p_size") % 10)).otherwise(F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", T.heading_level(style).alias("level"))


def revision_runs(spark, sf, text: str = "text"):
    """Three runs per document line: kept, inserted or deleted, moved; some paragraph marks revised."""
    lines = U.paragraphs(table(spark, sf, "documents")).withColumn("text", F.expr(text))
    kind = F.expr("CASE (doc_id + para_idx) % 5 WHEN 0 THEN 'ins' WHEN 1 THEN 'del' WHEN 2 THEN 'moveFrom' "
                  "WHEN 3 THEN 'moveTo' END")
    mark = F.expr("CASE (doc_id + para_idx) % 7 WHEN 0 THEN 'del' WHEN 1 THEN 'ins' END")
    parts = F.array(F.struct(F.lit(0).alias("run_idx"), F.lit(None).cast("string").alias("change_kind"),
                             F.substr("text", F.lit(1), F.lit(40)).alias("text")),
                    F.struct(F.lit(1).alias("run_idx"), kind.alias("change_kind"),
                             F.concat(F.lit("<"), F.col("para_idx"), F.lit(">")).alias("text")),
                    F.struct(F.lit(2).alias("run_idx"), F.lit(None).cast("string").alias("change_kind"),
                             F.substr("text", F.lit(41)).alias("text")))
    return lines.select("doc_id", "para_idx", mark.alias("mark_revision"), F.inline(parts))


def positional_sql(gone: str, mark: str, lines: str = LINES_SQL) -> str:
    return f"""SELECT doc_id, para_idx,
  substr(text, 1, 40) || CASE WHEN coalesce(kind, '') IN ({gone}) THEN '' ELSE '<' || para_idx || '>' END || substr(text, 41) AS text,
  coalesce(mark = '{mark}', false) AS mark_removed
  FROM (SELECT *, CASE (doc_id + para_idx) % 5 WHEN 0 THEN 'ins' WHEN 1 THEN 'del' WHEN 2 THEN 'moveFrom' WHEN 3 THEN 'moveTo' END AS kind,
        CASE (doc_id + para_idx) % 7 WHEN 0 THEN 'del' WHEN 1 THEN 'ins' END AS mark FROM ({lines}))"""


ACCEPT_SQL = positional_sql("'del', 'moveFrom'", "del")
REJECT_SQL = positional_sql("'ins', 'moveTo'", "ins")


def merged_sql(view: str) -> str:
    return f"""SELECT doc_id, CAST(island - 1 AS INTEGER) AS view_idx, max(para_idx) AS para_idx,
  sha256(string_agg(text, '' ORDER BY para_idx)) AS digest
FROM (SELECT *, sum(CASE WHEN coalesce(before, false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY para_idx) AS island
      FROM (SELECT *, lag(mark_removed) OVER (PARTITION BY doc_id ORDER BY para_idx) AS before FROM ({view})))
GROUP BY doc_id, island"""


def _digest(df):
    return df.withColumn("digest", F.sha2("text", 256)).drop("text")


@query("b11_accept_view", merged_sql(ACCEPT_SQL))
def b11(spark, sf):
    return _digest(U.revision_view(revision_runs(spark, sf), "accept"))


@query("b11_reject_view", merged_sql(REJECT_SQL))
def b11_reject(spark, sf):
    return _digest(U.revision_view(revision_runs(spark, sf), "reject"))


@query("b12_positional_view", f"SELECT doc_id, para_idx, sha256(text) AS digest, mark_removed FROM ({ACCEPT_SQL})")
def b12(spark, sf):
    return _digest(U.positional_view(revision_runs(spark, sf), "accept"))


@query("b13_clean", r"""
SELECT doc_id, sha256(replace(regexp_replace(trim(regexp_replace(
  CASE WHEN doc_id % 2 = 0 THEN replace(text, ' de ', ' ( de ') || '  , x .  ' ELSE text || ' ,  y ;' END,
  '\s+', ' ', 'g')), ' +([.,;:!?)\]])', '\1', 'g'), '( ', '(')) AS digest FROM documents""")
def b13(spark, sf):
    text = F.expr("CASE WHEN doc_id % 2 = 0 THEN concat(replace(text, ' de ', ' ( de '), '  , x .  ') "
                  "ELSE concat(text, ' ,  y ;') END")
    return table(spark, sf, "documents").select("doc_id", F.sha2(T.clean(text), 256).alias("digest"))


@query("b14_fingerprints", f"SELECT doc_id, para_idx, sha256(text) AS source_hash FROM ({LINES_SQL})")
def b14(spark, sf):
    return U.paragraph_fingerprints(U.paragraphs(table(spark, sf, "documents")))

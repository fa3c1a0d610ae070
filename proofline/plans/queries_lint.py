"""Named queries: style lint of the derived manuscripts, one query per rule family."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofline.functions.spelling_table import US_FORM_VARIETIES, spelling_rows
from proofline.operators import findings as FX
from proofline.operators import limits as L
from proofline.operators import typography as TY
from proofline.operators import wording as W
from proofline.operators.units import structured_paragraphs, with_defaults
from proofline.plans.catalog import EQUIVALENT_SQL, manuscripts, query, quoted, table
from proofline.plans.lint import document_profiles, lint_paragraphs, lint_paragraphs_by, merge_profile
from proofline.plans.queries_units import REGIONS_SQL
from proofline.session import materialise

# Limits tight enough that the derived manuscripts exceed some of them; notation left to the majority.
PROFILE = {
    "title": {"max_chars": 60}, "short_title": {"max_chars": 40}, "keywords": {"min": 4, "max": 6},
    "word_limit": {"max": 300, "severity": "warn"}, "figures": {"recommended_max": 3},
    "references": {"recommended_max": 1},
    "abstract": {"max_words": 12, "format": "single_paragraph", "forbid": ["citations", "abbreviations"]},
    "declarations": {"order": ["author_contributions", "data_availability", "funding"]},
    "statistics": {}, "formatting": {"language": ["en-US", "en-GB"]},
}

ADDRESS_RE2 = r"https?://\S+|\bwww\.\S+|\bdoi:\s*\S+|\b10\.\d{4,9}/\S+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
PARAS_SQL = f"""SELECT *, (region = 'references' AND level = 0) AS is_bib,
  regexp_replace(text, {quoted(ADDRESS_RE2)}, chr(1), 'g') AS masked FROM ({REGIONS_SQL})"""
PROSE_SQL = f"SELECT * FROM ({PARAS_SQL}) WHERE region <> 'title' AND NOT is_bib AND trim(text) <> ''"


def paras(spark, sf):
    return structured_paragraphs(manuscripts(spark, sf))


def counted(found, *rules):
    rows = found.where(F.col("rule").isin(*rules)) if rules else found
    return rows.groupBy("doc_id", "rule").agg(F.count("*").alias("n"))


def _count_sql(rule: str, pattern: str, source: str = PROSE_SQL, column: str = "masked", where: str = "true") -> str:
    return (f"SELECT doc_id, '{rule}' AS rule, CAST(sum(len(regexp_extract_all({column}, {quoted(pattern)}))) AS BIGINT) "
            f"AS n FROM ({source}) WHERE {where} GROUP BY doc_id HAVING n > 0")


STATS_SQL = f"""
SELECT doc_id,
 sum(len(regexp_extract_all(masked, '\\b[Pp] +[=<>] +[.]?[0-9]'))) AS ps, sum(len(regexp_extract_all(masked, '\\b[Pp][=<>][.]?[0-9]'))) AS pu,
 sum(len(regexp_extract_all(masked, '\\b[Pp] *[=<>] *[.]?[0-9]'))) AS pt,
 sum(len(regexp_extract_all(masked, '\\bP *[=<>] *[.]?[0-9]'))) AS upper, sum(len(regexp_extract_all(masked, '\\bp *[=<>] *[.]?[0-9]'))) AS lower,
 sum(len(regexp_extract_all(masked, '\\bq +[=<>] +[.]?[0-9]'))) AS qs, sum(len(regexp_extract_all(masked, '\\bq[=<>][.]?[0-9]'))) AS qu, sum(len(regexp_extract_all(masked, '\\bq *[=<>] *[.]?[0-9]'))) AS qt,
 sum(len(regexp_extract_all(masked, '\\bn += +[0-9]'))) AS ns, sum(len(regexp_extract_all(masked, '\\bn=[0-9]'))) AS nu, sum(len(regexp_extract_all(masked, '\\bn *= *[0-9]'))) AS nt,
 sum(len(regexp_extract_all(masked, '[0-9%)] +± +[0-9(.]'))) AS ms, sum(len(regexp_extract_all(masked, '[0-9%)]±[0-9(.]'))) AS mu, sum(len(regexp_extract_all(masked, '[0-9%)] *± *[0-9(.]'))) AS mt
FROM ({PROSE_SQL}) GROUP BY doc_id"""
_WANT_P = "CASE WHEN pu > ps THEN 'u' ELSE 's' END"


def _spacing_sql(rule, s, u, t, fallback):
    want = f"CASE WHEN {s} > {u} THEN 's' WHEN {u} > {s} THEN 'u' ELSE {fallback} END"
    return (f"SELECT doc_id, '{rule}' AS rule, CAST({t} - CASE WHEN {want} = 's' THEN {s} ELSE {u} END AS BIGINT) AS n "
            f"FROM ({STATS_SQL}) WHERE n > 0")


@query("c1_p_spacing", _spacing_sql("stats.p-spacing", "ps", "pu", "pt", "'s'"))
def c1(spark, sf):
    return counted(TY.statistics(paras(spark, sf), PROFILE), "stats.p-spacing")


@query("c2_p_case", f"SELECT doc_id, 'stats.p-case' AS rule, CAST(CASE WHEN lower > upper THEN upper ELSE lower END "
                    f"AS BIGINT) AS n FROM ({STATS_SQL}) WHERE n > 0")
def c2(spark, sf):
    return counted(TY.statistics(paras(spark, sf), PROFILE), "stats.p-case")


def with_italic_lead(df):
    """The first twenty characters of each paragraph in italics, the rest in roman type."""
    return df.withColumn("spans", F.expr(
        "array(named_struct('start', 0, 'end', 20, 'flags', array('italic'), 'kind', '', 'lang', 'en-GB'), "
        "named_struct('start', 20, 'end', greatest(length(text), 20), 'flags', array('roman'), 'kind', '', "
        "'lang', 'en-US'))"))


@query("c3_p_italic", f"""
SELECT doc_id, 'stats.p-italic' AS rule, CAST(CASE WHEN it >= tot - it THEN tot - it ELSE it END AS BIGINT) AS n FROM (
 SELECT doc_id, sum(len(regexp_extract_all(masked, '\\b[Pp] *[=<>] *[.]?[0-9]'))) AS tot,
  sum(CASE WHEN regexp_matches(masked, '\\b[Pp] *[=<>] *[.]?[0-9]') THEN len(regexp_extract_all(substr(masked, 1, 20), '\\b[Pp]([ =<>]|$)')) ELSE 0 END) AS it
 FROM ({PROSE_SQL}) GROUP BY doc_id) WHERE n > 0""")
def c3(spark, sf):
    return counted(TY.statistics(with_italic_lead(paras(spark, sf)), PROFILE), "stats.p-italic")


@query("c4_q_and_n_spacing", _spacing_sql("stats.q-spacing", "qs", "qu", "qt", _WANT_P) + " UNION ALL "
       + _spacing_sql("stats.n-spacing", "ns", "nu", "nt", _WANT_P))
def c4(spark, sf):
    return counted(TY.statistics(paras(spark, sf), PROFILE), "stats.q-spacing", "stats.n-spacing")


@query("c5_pm_spacing", _spacing_sql("stats.pm-spacing", "ms", "mu", "mt", "'s'"))
def c5(spark, sf):
    return counted(TY.statistics(paras(spark, sf), PROFILE), "stats.pm-spacing")


def _typo(*rules):
    return lambda spark, sf: counted(TY.typography(paras(spark, sf), PROFILE), *rules)


C7_SQL = _count_sql("typo.eponym-dash", TY.EPONYM.replace("(?U)", ""))
C8_SQL = _count_sql("typo.degree-sign", TY.DEGREE.replace("(?U)", ""))
C10_SQL = _count_sql("typo.double-space", " {2,}")
C11_SQL = _count_sql("typo.space-before-punctuation", r"[^\s\x01] +[,.;:!?)\]]")
C12_SQL = _count_sql("callout.fig-abbreviation", r"\bFigs?[.][ ]*S?[0-9]", where="region <> 'references'")
C13_SQL = _count_sql("citation.placeholder", r"\[PMIDs?\s*:\s*[\d,;\s]+\]", PARAS_SQL, "text", "NOT is_bib")
C14_SQL = _count_sql("citation.adjacent-groups", TY.ADJACENT_GROUPS, PARAS_SQL, "text", "NOT is_bib")

#: Place by place instead of by look-behind.
C6_SQL = f"""SELECT doc_id, 'typo.minus' AS rule, count(*) AS n FROM (SELECT doc_id, masked AS t, unnest(range(1, length(masked) + 1)) AS i FROM ({PROSE_SQL}) WHERE contains(masked, '-') OR contains(masked, '‐'))
WHERE substr(t, i, 1) IN ('-', '‐') AND regexp_matches(substr(t, i + 1, 2), '^[.]?[0-9]') AND (i = 1 OR regexp_matches(substr(t, i - 1, 1), '[\\s(\\[=<>≤≥±~≈,;:/\\x01]'))
 AND NOT regexp_matches(rtrim(substr(t, 1, i - 1), ' ' || chr(160)), '[0-9]$') GROUP BY doc_id"""
query("c6_minus", C6_SQL)(_typo("typo.minus"))
query("c7_eponym_dash", C7_SQL)(_typo("typo.eponym-dash"))
query("c8_degree_sign", C8_SQL)(_typo("typo.degree-sign"))
query("c9_range_dash")(_typo("typo.range-dash"))
query("c10_double_space", C10_SQL)(_typo("typo.double-space"))
query("c11_space_before_punctuation", C11_SQL)(_typo("typo.space-before-punctuation"))
query("c12_fig_abbreviation", C12_SQL)(_typo("callout.fig-abbreviation"))


@query("c13_placeholders", C13_SQL)
def c13(spark, sf):
    return counted(TY.citation_marks(paras(spark, sf), PROFILE), "citation.placeholder")


@query("c14_adjacent_groups", C14_SQL)
def c14(spark, sf):
    return counted(TY.citation_marks(paras(spark, sf), PROFILE), "citation.adjacent-groups")


_WORDS = ", ".join(f"('{w}','{c}','{f}')" for w, c, f, _ in spelling_rows())
_DEV = {v: "(form = 'us') <> (category IN (" + ", ".join(
    f"'{c}'" for c, vs in US_FORM_VARIETIES.items() if v in vs) + "))" for v in ("en-US", "en-GB")}
SPELLING_SQL = f"""
WITH pieces AS (SELECT doc_id, para_idx, level, p, i, regexp_extract(p, '[A-Za-z]+$') AS word,
    rtrim(regexp_replace(p, '[A-Za-z]+$', ''), ' ' || chr(9)) AS gap
  FROM (SELECT doc_id, para_idx, level, unnest(ps) AS p, unnest(generate_series(1, len(ps))) AS i
        FROM (SELECT *, regexp_extract_all(masked, '[^A-Za-z]*[A-Za-z]+') AS ps FROM ({PARAS_SQL})
              WHERE region NOT IN ('title', 'references') AND NOT is_bib))),
hits AS (SELECT doc_id, para_idx, word, form, category FROM pieces JOIN (VALUES {_WORDS}) AS t(key, category, form)
   ON lower(word) = key
   WHERE NOT (word = upper(word) AND length(word) > 1)
     AND NOT (regexp_matches(word, '^[A-Z]') AND level = 0
              AND CASE WHEN gap = '' THEN i > 1 ELSE NOT regexp_matches(gap, '[.!?:;\\x01]$') END)),
best AS (SELECT doc_id, count_if(form = 'us') AS us_forms, count_if(form = 'uk') AS uk_forms,
   count_if({_DEV['en-US']}) AS d_us, count_if({_DEV['en-GB']}) AS d_gb FROM hits GROUP BY doc_id)
"""


@query("c15_spelling_variety", SPELLING_SQL + """
SELECT doc_id, CASE WHEN d_gb < d_us THEN 'en-GB' ELSE 'en-US' END AS variety, us_forms, uk_forms,
  least(d_us, d_gb) AS deviations FROM best""")
def c15(spark, sf):
    return W.spelling_varieties(paras(spark, sf), PROFILE)[1]


@query("c15_spelling_mixed", SPELLING_SQL + f"""
SELECT doc_id, para_idx, word, form FROM hits JOIN best USING (doc_id)
WHERE CASE WHEN d_gb < d_us THEN {_DEV['en-GB']} ELSE {_DEV['en-US']} END""")
def c15_mixed(spark, sf):
    hits, _ = W.spelling_varieties(paras(spark, sf), PROFILE)
    return hits.where("deviates").select("doc_id", "para_idx", "word", "form")


@query("c16_heading_form", f"""
SELECT doc_id, para_idx, 'heading.trailing' AS rule FROM ({REGIONS_SQL}) WHERE level > 0 AND regexp_matches(text, '[: ]$')
UNION ALL SELECT doc_id, para_idx, 'heading.indent' FROM ({REGIONS_SQL}) WHERE level > 0 AND trim(text) <> '' AND (doc_id + para_idx) % 9 = 0
UNION ALL SELECT doc_id, para_idx, 'heading.empty' FROM ({REGIONS_SQL}) WHERE level > 0 AND trim(text) = ''""")
def c16(spark, sf):
    rows = paras(spark, sf).withColumn("first_line_indent", F.expr("CASE WHEN (doc_id + para_idx) % 9 = 0 THEN 360 ELSE 0 END"))
    return W.heading_form(rows, PROFILE).select("doc_id", "para_idx", "rule")


@query("c17_heading_numbering", f"""
WITH h AS (SELECT doc_id, para_idx, regexp_extract(text, '^([0-9]+(?:[.][0-9]+)*)[.]?(?:[ ]|$)', 1) AS num
           FROM ({REGIONS_SQL}) WHERE level > 0 AND regexp_matches(text, '^[0-9]+(?:[.][0-9]+)*[.]?(?:[ ]|$)')),
p AS (SELECT *, CASE WHEN num LIKE '%.%' THEN split_part(num, '.', 1) ELSE '' END AS parent,
        CAST(regexp_extract(num, '[0-9]+$') AS INTEGER) AS n, lag(num) OVER (PARTITION BY doc_id ORDER BY para_idx) AS cur,
        count_if(num NOT LIKE '%.%') OVER (PARTITION BY doc_id ORDER BY para_idx) AS top FROM h),
q AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY doc_id, parent, CASE WHEN parent = '' THEN 0 ELSE top END ORDER BY para_idx), 0) + 1 AS want FROM p)
SELECT doc_id, para_idx, num AS number, 'wrong parent' AS problem FROM q WHERE parent <> '' AND split_part(cur, '.', 1) <> parent
UNION ALL SELECT doc_id, para_idx, num, CASE WHEN n < want THEN 'repeats' ELSE 'skips' END FROM q WHERE n <> want""")
def c17(spark, sf):
    return W.heading_numbers(paras(spark, sf)).select("doc_id", "para_idx", "number", "problem")


@query("c18_highlight", f"""
SELECT doc_id, para_idx, CAST(5 + doc_id % 3 AS INTEGER) AS chars FROM ({REGIONS_SQL}) WHERE para_idx % 4 = 0 AND length(text) > 10""")
def c18(spark, sf):
    rows = paras(spark, sf).withColumn("spans", F.expr(
        "CASE WHEN para_idx % 4 = 0 AND length(text) > 10 THEN array(named_struct('start', 0, 'end', cast(5 + doc_id % 3 as int), "
        "'flags', array('bold', 'highlight'), 'kind', '', 'lang', '')) ELSE spans END"))
    return W.highlighting(rows, PROFILE).select(
        "doc_id", "para_idx", F.regexp_extract("message", r"(\d+)$", 1).cast("int").alias("chars"))


@query("c19_proofing_language", """
WITH per AS (SELECT source AS doc_id, lang, sum(length(text)) AS chars, min(doc_id) AS first, count(DISTINCT doc_id) AS paragraphs
             FROM documents WHERE trim(text) <> '' GROUP BY ALL),
d AS (SELECT *, first_value(lang) OVER (PARTITION BY doc_id ORDER BY chars DESC, first) AS dominant FROM per)
SELECT doc_id, lang, CAST(chars AS BIGINT) AS chars, first AS para_idx, paragraphs, dominant FROM d WHERE lang <> dominant""")
def c19(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("source").alias("doc_id"), F.col("doc_id").alias("para_idx"), "text",
        F.expr("array(named_struct('start', 0, 'end', length(text), 'flags', cast(array() as array<string>), 'kind', '', "
               "'lang', lang))").alias("spans"))
    return W.language_shares(docs).where(F.col("lang") != F.col("dominant")).select(
        "doc_id", "lang", "chars", F.col("first.para_idx").alias("para_idx"), "paragraphs", "dominant")


@query("c20_reference_spacing", f"""
WITH b AS (SELECT doc_id, para_idx, CASE WHEN para_idx % 5 = 0 THEN 240 ELSE
    CASE (doc_id + para_idx) % 4 WHEN 3 THEN 240 ELSE CASE WHEN doc_id % 2 = 0 THEN 480 ELSE 250 END END END AS line
  FROM ({PARAS_SQL}) WHERE is_bib AND trim(text) <> '')
SELECT doc_id, min(para_idx) AS para_idx, arg_min(line, para_idx) AS line FROM b WHERE abs(line - 240) > 12 GROUP BY doc_id""")
def c20(spark, sf):
    rows = paras(spark, sf).withColumn("style", F.expr("concat('S', (doc_id + para_idx) % 4)")).withColumn(
        "line", F.expr("CASE WHEN para_idx % 5 = 0 THEN 240 END"))
    styles = table(spark, sf, "documents").select("doc_id", F.expr(
        "inline(array(named_struct('style', 'S0', 'based_on', 'S1', 'line', cast(null as int)), "
        "named_struct('style', 'S1', 'based_on', 'S2', 'line', cast(null as int)), "
        "named_struct('style', 'S2', 'based_on', cast(null as string), 'line', if(doc_id % 2 = 0, 480, 250)), "
        "named_struct('style', 'S3', 'based_on', 'S3', 'line', cast(null as int))))"))
    return W.reference_spacing(rows, styles, "single")


@query("c21_abbreviation_tokens")
def c21(spark, sf):
    rows = paras(spark, sf).select("doc_id", "para_idx", F.explode(W.abbreviation_tokens()).alias("a"))
    return rows.groupBy("doc_id", "a.core").agg(F.count("*").alias("n"))


@query("c22_abbreviation_definitions")
def c22(spark, sf):
    legends = F.col("region") != "body"
    rows = paras(spark, sf).select("doc_id", "para_idx", F.explode(W.abbreviation_definitions(legends)).alias("d"))
    return rows.select("doc_id", "para_idx", "d.core", "d.form", "d.pos")


@query("c23_abbreviation_order")
def c23(spark, sf):
    return W.abbreviations(paras(spark, sf), PROFILE).select("doc_id", "para_idx", "rule", F.col("suggestion").alias("core"))


@query("c24_abstract_content", """
SELECT doc_id, 'abstract.abbreviation' AS rule, 3 AS n FROM documents WHERE doc_id % 3 = 1
UNION ALL SELECT doc_id, 'abstract.citation', 1 FROM documents WHERE doc_id % 3 = 1""")
def c24(spark, sf):
    found = W.abstract_content(paras(spark, sf), PROFILE)
    return found.groupBy("doc_id", "rule").agg(F.count("*").cast("int").alias("n"))


@query("c25_gene_italic", """
SELECT doc_id, unnest(['TP53', 'BRCA1']) AS symbol FROM documents WHERE doc_id % 4 = 3""")
def c25(spark, sf):
    return W.gene_italics(paras(spark, sf), PROFILE).select(
        "doc_id", F.regexp_extract("message", "^([A-Z0-9]+)", 1).alias("symbol"))


@query("c26_callout_numbers", """
SELECT o_orderkey, array_to_string(list_concat(list_concat([a], CASE WHEN b > a THEN generate_series(a + 1, b) ELSE [b] END),
   [CAST(o_custkey % 4 AS BIGINT)]), ' ') AS numbers
FROM (SELECT o_orderkey, o_custkey, o_orderkey % 60 AS a, o_custkey % 70 AS b FROM orders)""")
def c26(spark, sf):
    group = F.expr("concat(o_orderkey % 60, ' - ', o_custkey % 70, 'a, and ', o_custkey % 4)")
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(L.callout_numbers(group), " ").alias("numbers"))


def _figures(rule):
    def run(spark, sf):
        found = L.figures(paras(spark, sf), PROFILE).where(F.col("rule") == rule)
        return found.select("doc_id", F.regexp_extract("message", r"(\d+)", 1).cast("int").alias("figure"))
    return run


query("c27_figures_order", """SELECT doc_id, 1 AS figure FROM documents
  WHERE doc_id % 5 = 0 OR (doc_id % 5 IN (1, 2) AND doc_id % 4 = 3)""")(_figures("figures.order"))
query("c28_figures_uncited", "SELECT doc_id, 7 AS figure FROM documents WHERE doc_id % 5 = 0")(
    _figures("figures.uncited"))
query("c29_figures_missing_legend", """SELECT doc_id, unnest([2, 3, 4, 5]) AS figure FROM documents WHERE doc_id % 5 = 0
  UNION ALL SELECT doc_id, unnest([2, 3]) FROM documents WHERE doc_id % 5 = 1""")(_figures("figures.missing-legend"))
query("c30_figures_gap", """SELECT doc_id, unnest(CASE WHEN doc_id % 4 = 3 THEN [3] ELSE [2, 3] END) AS figure FROM documents WHERE doc_id % 5 = 2
  UNION ALL SELECT doc_id, 1 FROM documents WHERE doc_id % 5 IN (3, 4) AND doc_id % 4 = 3""")(_figures("figures.gap"))


@query("c31_figure_and_reference_limits", f"""
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 2 WHEN doc_id % 5 = 1 THEN 1 WHEN doc_id % 5 = 2 THEN 4 WHEN doc_id % 4 = 3 THEN 2 END AS figures,
  (SELECT count(*) FROM ({PARAS_SQL}) p WHERE p.is_bib AND trim(p.text) <> '' AND p.doc_id = documents.doc_id) AS reference_entries FROM documents""")
def c31(spark, sf):
    marks = L.figure_marks(paras(spark, sf), F.col("is_bib") & (F.btrim("text") != ""))
    refs = marks.where("also").groupBy("doc_id").agg(F.count("*").alias("reference_entries"))
    return refs.join(L.figure_counts(L.figure_captions(marks), L.figure_calls(marks)), "doc_id", "left").select(
        "doc_id", "figures", "reference_entries")


TITLES_SQL = f"""
SELECT doc_id, length(trim(arg_min(text, para_idx) FILTER (region = 'title' AND trim(text) <> '' AND NOT regexp_matches(text, '^(running title|keywords|word count)', 'i')))) AS title_chars,
  length(trim(regexp_replace(arg_min(text, para_idx) FILTER (regexp_matches(text, '^running title:', 'i')), '^[^:]*:', ''))) AS running_chars,
  CAST(len(list_filter(regexp_split_to_array(rtrim(trim(regexp_replace(arg_min(text, para_idx) FILTER (regexp_matches(text, '^keywords:', 'i')), '^[^:]*:', '')), '.'), '[,;]'), lambda x: trim(x) <> '')) AS INTEGER) AS keywords
FROM ({REGIONS_SQL}) GROUP BY doc_id"""


@query("c32_title_limits", f"SELECT doc_id, title_chars, running_chars FROM ({TITLES_SQL})")
def c32(spark, sf):
    return L.title_measures(paras(spark, sf)).select("doc_id", "title_chars", "running_chars")


@query("c33_keyword_limits", f"""
SELECT doc_id, 'limits.keywords' AS rule FROM ({TITLES_SQL}) WHERE keywords < 4 OR keywords > 6
UNION ALL SELECT doc_id, 'limits.missing' FROM ({TITLES_SQL}) WHERE keywords IS NULL""")
def c33(spark, sf):
    found = L.title_limits(paras(spark, sf), {"keywords": PROFILE["keywords"]})
    return found.select("doc_id", "rule")


@query("c34_abstract_limits", f"""
SELECT doc_id, CAST(sum(len(regexp_extract_all(text, '\\S+'))) AS BIGINT) AS words, count(*) AS paragraphs
FROM ({REGIONS_SQL}) WHERE region = 'abstract' AND level = 0 AND trim(text) <> '' GROUP BY doc_id""")
def c34(spark, sf):
    return L.abstract_measures(paras(spark, sf)).select("doc_id", "words", "paragraphs")


BOUNDS_SQL = f"""
WITH l AS (SELECT doc_id, para_idx, level, text, len(regexp_extract_all(text, '\\S+')) AS w FROM ({REGIONS_SQL})),
a AS (SELECT doc_id, min(para_idx) AS abstract FROM l WHERE level = 1 AND regexp_matches(text, '^abstract', 'i') GROUP BY doc_id),
i AS (SELECT doc_id, abstract, min(para_idx) AS introduction FROM l JOIN a USING (doc_id) WHERE level = 1 AND para_idx > abstract AND regexp_matches(text, '^(?:[0-9]+[.]?[ ]*)?introduction', 'i') GROUP BY ALL),
r AS (SELECT doc_id, abstract, introduction, min(para_idx) AS refs FROM l JOIN i USING (doc_id) WHERE level = 1 AND para_idx > introduction AND regexp_matches(text, '^references', 'i') GROUP BY ALL),
c AS (SELECT r.*, (SELECT min(para_idx) FROM l WHERE l.doc_id = r.doc_id AND para_idx > abstract AND para_idx < introduction AND (lower(trim(text)) = 'abbreviations' OR regexp_matches(text, '^key[ ]*words?', 'i'))) AS label,
        (SELECT min(para_idx) FROM l WHERE l.doc_id = r.doc_id AND level = 1 AND para_idx > introduction AND para_idx < refs AND regexp_matches(text, '^(?:[0-9]+[.]?[ ]*)?conclusions?', 'i')) AS conclusions FROM r),
b AS (SELECT doc_id, abstract, coalesce(label, introduction) AS abstract_end, introduction, conclusions,
        coalesce(CASE WHEN conclusions IS NOT NULL THEN (SELECT min(para_idx) FROM l WHERE l.doc_id = c.doc_id AND level = 1 AND para_idx > conclusions AND para_idx < refs)
             ELSE (SELECT min(para_idx) FROM l WHERE l.doc_id = c.doc_id AND level = 1 AND para_idx > introduction AND para_idx < refs AND NOT regexp_matches(text, '^[0-9]')) END, refs) AS strict_end,
        refs FROM c)
"""


@query("c35_section_bounds", BOUNDS_SQL + "SELECT doc_id, abstract, abstract_end, introduction, conclusions, strict_end, refs AS references_at FROM b")
def c35(spark, sf):
    return L.section_bounds(paras(spark, sf)).where("missing IS NULL").drop("missing").withColumnRenamed("references", "references_at")


COUNTS_SQL = BOUNDS_SQL + """, n AS (SELECT doc_id,
  sum(w) FILTER (para_idx > abstract AND para_idx < abstract_end) AS abstract,
  coalesce(sum(w) FILTER (para_idx > abstract AND para_idx < abstract_end), 0) + sum(w) FILTER (para_idx >= introduction AND para_idx < refs) AS house,
  coalesce(sum(w) FILTER (para_idx > abstract AND para_idx < abstract_end), 0) + sum(w) FILTER (para_idx >= introduction AND para_idx < strict_end AND level = 0) AS strict
  FROM l JOIN b USING (doc_id) WHERE NOT regexp_matches(text, '^word count:', 'i') GROUP BY doc_id)
"""


@query("c36_word_counts", COUNTS_SQL + "SELECT doc_id, CAST(coalesce(abstract, 0) AS BIGINT) AS abstract, CAST(house AS BIGINT) AS house, CAST(strict AS BIGINT) AS strict FROM n")
def c36(spark, sf):
    return L.word_counts(paras(spark, sf))


@query("c37_count_status", COUNTS_SQL + """
SELECT doc_id, CAST(house AS BIGINT) AS house, CASE WHEN doc_id % 3 = 0 THEN 100 + doc_id % 50 END AS stated,
  CASE WHEN doc_id % 3 = 0 THEN house = 100 + doc_id % 50 END AS matches,
  CASE WHEN house > 300 THEN 'over' ELSE 'within' END AS status, CAST(greatest(house - 300, 0) AS BIGINT) AS over_by FROM n""")
def c37(spark, sf):
    p = paras(spark, sf)
    return L.count_status(L.word_counts(p), L.stated_counts(p), F.lit(300).cast("bigint")).drop("strict")


@query("c38_count_scope", """
SELECT p_partkey, 'excluding ' || CASE WHEN p_size % 3 = 0 THEN 'tables, references and figure legends'
  WHEN p_size % 3 = 1 THEN 'figure legends and references' ELSE 'references and figure legends' END AS scope FROM part""")
def c38(spark, sf):
    excludes = F.expr("CASE WHEN p_size % 3 = 0 THEN array('Tables', 'References', 'abstract') "
                      "WHEN p_size % 3 = 1 THEN array('figure-legends', p_brand) END")
    return table(spark, sf, "part").select("p_partkey", L.count_scope(excludes).alias("scope"))


@query("c39_declarations", f"""
WITH c AS (SELECT doc_id, para_idx, CASE WHEN level > 0 THEN trim(text) ELSE split_part(trim(text), ':', 1) END AS label FROM ({REGIONS_SQL})
  WHERE region IN ('body', 'appendix', 'front') AND (level > 0 OR contains(trim(text), ':'))),
f AS (SELECT doc_id, declaration, min(para_idx) AS para_idx FROM (SELECT *, CASE WHEN lower(label) = 'funding' THEN 'funding' WHEN lower(label) = 'data availability' THEN 'data_availability'
   WHEN lower(label) = 'author contributions' THEN 'author_contributions' END AS declaration FROM c) WHERE declaration IS NOT NULL GROUP BY ALL),
o AS (SELECT doc_id, array_to_string(list(declaration ORDER BY para_idx), ',') AS actual, array_to_string(list(declaration ORDER BY declaration), ',') AS wanted FROM f GROUP BY doc_id)
SELECT d.doc_id, 'declarations.missing' AS rule, k.key AS item FROM documents d, (VALUES ('author_contributions'), ('data_availability'), ('funding')) AS k(key)
  WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = d.doc_id AND f.declaration = k.key)
UNION ALL SELECT doc_id, 'declarations.order', actual FROM o WHERE actual <> wanted""")
def c39(spark, sf):
    found = L.declarations(paras(spark, sf), PROFILE)
    item = F.regexp_replace(F.regexp_replace("message", "^(not found: |declarations appear as )", ""), ", ", ",")
    return found.select("doc_id", "rule", item.alias("item"))


@query("c40_majority", """
SELECT user_id, event_type AS expected FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, (event_type = 'view') DESC, first) AS r
  FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL)) WHERE r = 1""")
def c40(spark, sf):
    return TY.majority(table(spark, sf, "events"), ["user_id"], "event_type", "view", order="event_id")


#: Every rule whose findings SQL can count over the manuscripts, with that SQL: notation by the document's majority, typography, citation
#: marks, limits and declarations. The others need lookarounds or an ordered state.
_ERRORS = ("citation.placeholder", "limits.title", "limits.running-title", "limits.keywords", "limits.abstract-words")
_LIMITS_SQL = f"""
SELECT doc_id, 'limits.title' AS rule, CAST(1 AS BIGINT) AS n FROM ({TITLES_SQL}) WHERE title_chars > 60 UNION ALL SELECT doc_id, 'limits.running-title', 1 FROM ({TITLES_SQL}) WHERE running_chars > 40
UNION ALL SELECT doc_id, 'limits.keywords', 1 FROM ({TITLES_SQL}) WHERE keywords < 4 OR keywords > 6
UNION ALL SELECT doc_id, 'limits.abstract-words', 1 FROM (SELECT doc_id, sum(len(regexp_extract_all(text, '\\S+'))) AS w FROM ({REGIONS_SQL}) WHERE region = 'abstract' AND level = 0 AND trim(text) <> '' GROUP BY doc_id) WHERE w > 12
UNION ALL SELECT doc_id, 'limits.references', 1 FROM (SELECT doc_id, count(*) AS k FROM ({PARAS_SQL}) WHERE is_bib AND trim(text) <> '' GROUP BY doc_id) WHERE k > 1"""
_STATS = (EQUIVALENT_SQL[name] for name in ("c1_p_spacing", "c2_p_case", "c4_q_and_n_spacing", "c5_pm_spacing"))
FOUND_SQL = " UNION ALL ".join(f"({s})" for s in (
    C7_SQL, C8_SQL, C10_SQL, C11_SQL, C12_SQL, C13_SQL, C14_SQL, *_STATS, _LIMITS_SQL, f"SELECT doc_id, rule, count(*) AS n FROM ({EQUIVALENT_SQL['c39_declarations']}) GROUP BY ALL"))
COUNTED = ("typo.eponym-dash", "typo.degree-sign", "typo.double-space", "typo.space-before-punctuation", "callout.fig-abbreviation", "citation.placeholder",
           "citation.adjacent-groups", "stats.p-spacing", "stats.p-case", "stats.q-spacing", "stats.n-spacing", "stats.pm-spacing", "limits.title",
           "limits.running-title", "limits.keywords", "limits.abstract-words", "limits.references", "declarations.missing", "declarations.order")


def counted_findings(spark, sf):
    """Findings of the functions that can emit a counted rule, and of no other."""
    p = materialise(paras(spark, sf), "lint-paragraphs")
    functions = dict.fromkeys(FX.REGISTRY[name] for name in COUNTED)
    return FX.union_all(fn(p, merge_profile({}, PROFILE)) for fn in functions).where(F.col("rule").isin(*COUNTED))


@query("c41_filter_disabled", f"""
SELECT * FROM ({FOUND_SQL}) WHERE rule <> 'typo.double-space' AND NOT starts_with(rule, 'citation.')""")
def c41(spark, sf):
    return counted(FX.filter_disabled(counted_findings(spark, sf), ["typo.double-space", "citation.", "typo.double"]))


@query("c41_filter_disabled_by_table", f"""
SELECT * FROM ({FOUND_SQL}) WHERE rule <> 'typo.double-space' AND NOT starts_with(rule, 'citation.')""")
def c41_table(spark, sf):
    names = F.expr("CASE r_regionkey WHEN 0 THEN 'typo.double-space' WHEN 1 THEN 'citation' ELSE concat('other.', r_name) END")
    disabled = table(spark, sf, "region").select(names.alias("prefix"))
    return counted(FX.filter_disabled_by(counted_findings(spark, sf), disabled))


@query("c42_rank_findings")
def c42(spark, sf):
    return FX.rank_findings(counted_findings(spark, sf)).select("doc_id", "para_idx", "severity", "rule", "start", "snippet")


@query("c43_summarise", f"""
WITH f AS (SELECT doc_id, CAST(coalesce(sum(n) FILTER (rule IN {_ERRORS}), 0) AS BIGINT) AS error, CAST(coalesce(sum(n) FILTER (rule NOT IN {_ERRORS}), 0) AS BIGINT) AS warn FROM ({FOUND_SQL}) GROUP BY doc_id)
SELECT doc_id, error, warn, CAST(0 AS BIGINT) AS info, CASE WHEN error > 0 THEN 'error' ELSE 'warn' END AS status FROM f""")
def c43(spark, sf):
    return FX.summarise(counted_findings(spark, sf))


def all_findings(spark, sf):
    return lint_paragraphs(materialise(with_italic_lead(paras(spark, sf)), "lint-paragraphs"), PROFILE)


@query("lint_summary")
def lint_summary(spark, sf):
    """Counts by severity and the status of every document, over every registered rule."""
    return FX.summarise(all_findings(spark, sf))


@query("lint_all_rules")
def lint_all(spark, sf):
    """Every registered rule over the corpus, counted per rule."""
    found = all_findings(spark, sf)
    return found.groupBy("rule", "severity").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))


@query("c44_reference_integrity", """
WITH a AS (SELECT c_nationkey AS doc_id, c_name AS name, unnest([c_custkey % 9, c_custkey % 4]) AS key, c_custkey % 5 = 0 AS corr FROM customer),
f AS (SELECT s_nationkey AS doc_id, s_suppkey % 7 AS key FROM supplier),
k AS (SELECT c_nationkey AS doc_id, c_name AS name FROM customer WHERE c_custkey % 10 IN (0, 3))
SELECT DISTINCT a.doc_id, 'undefined affiliation' AS problem, a.name || ':' || a.key AS item FROM a WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = a.doc_id AND f.key = a.key)
UNION ALL SELECT DISTINCT f.doc_id, 'unused affiliation', CAST(f.key AS VARCHAR) FROM f WHERE NOT EXISTS (SELECT 1 FROM a WHERE f.doc_id = a.doc_id AND f.key = a.key)
UNION ALL SELECT doc_id, 'affiliation defined twice', CAST(key AS VARCHAR) FROM f GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT k.doc_id, 'contact is not a corresponding author', k.name FROM k WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = k.doc_id AND a.name = k.name AND a.corr)""")
def c44(spark, sf):
    customer = table(spark, sf, "customer")
    authors = customer.selectExpr(
        "c_nationkey AS doc_id", "c_name AS name", "array_distinct(array(c_custkey % 9, c_custkey % 4)) AS keys",
        "c_custkey % 5 = 0 AS corresponding")
    affiliations = table(spark, sf, "supplier").selectExpr("s_nationkey AS doc_id", "s_suppkey % 7 AS key")
    contacts = customer.where("c_custkey % 10 IN (0, 3)").selectExpr("c_nationkey AS doc_id", "c_name AS name")
    return L.reference_integrity(authors, affiliations, contacts)


@query("l2_profile_limits", f"""
WITH k AS (SELECT c_custkey AS doc_id, c_nationkey % 5 AS p FROM customer), l AS (SELECT p, CASE p WHEN 0 THEN 20 WHEN 1 THEN 60 WHEN 3 THEN 100 END AS title_max, CASE p WHEN 0 THEN 12 WHEN 1 THEN 40 WHEN 2 THEN 20 ELSE 250 END AS words_max, CASE p WHEN 2 THEN 1 WHEN 4 THEN 2 END AS refs_max FROM range(5) r(p)),
d AS (SELECT doc_id, coalesce(p, 9) AS p, coalesce(title_max, NULL) AS title_max, coalesce(words_max, 250) AS words_max, refs_max FROM documents LEFT JOIN k USING (doc_id) LEFT JOIN l USING (p)),
t AS (SELECT doc_id, title_chars FROM ({TITLES_SQL})), a AS (SELECT doc_id, CAST(sum(len(regexp_extract_all(text, '\\S+'))) AS BIGINT) AS words FROM ({REGIONS_SQL}) WHERE region = 'abstract' AND level = 0 AND trim(text) <> '' GROUP BY doc_id),
b AS (SELECT doc_id, count(*) AS n FROM ({PARAS_SQL}) WHERE is_bib AND trim(text) <> '' GROUP BY doc_id)
SELECT doc_id, 'limits.title' AS rule FROM d JOIN t USING (doc_id) WHERE title_chars > title_max
UNION ALL SELECT doc_id, 'limits.abstract-words' FROM d JOIN a USING (doc_id) WHERE words > words_max AND p <> 3
UNION ALL SELECT doc_id, 'limits.references' FROM d JOIN b USING (doc_id) WHERE n > refs_max""")
def l2(spark, sf):
    """Documents of five journals, each with its own limits; the third journal switches a rule off, and documents without a journal follow the default."""
    journals = table(spark, sf, "nation").selectExpr("n_nationkey % 5 AS p").distinct().selectExpr("concat('journal ', p) AS profile_name", """CASE p
      WHEN 0 THEN '{"title": {"max_chars": 20}, "abstract": {"max_words": 12}}' WHEN 1 THEN '{"title": {"max_chars": 60}, "abstract": {"max_words": 40}, "statistics": {"p_style": "P=0.01"}}'
      WHEN 2 THEN '{"abstract": {"max_words": 20}, "references": {"recommended_max": 1}}' WHEN 3 THEN '{"title": {"max_chars": 100}, "lint": {"disabled_rules": ["limits.abstract-words"]}}'
      ELSE '{"references": {"recommended_max": 2}}' END AS profile""")
    named = table(spark, sf, "customer").selectExpr("c_custkey AS doc_id", "concat('journal ', c_nationkey % 5) AS profile_name")
    docs = manuscripts(spark, sf)
    chosen = docs.select("doc_id").join(named, "doc_id", "left")
    found = lint_paragraphs_by(materialise(structured_paragraphs(docs), "lint-paragraphs"), document_profiles(chosen, journals),
                               ["limits.title", "limits.abstract-words", "limits.references"])
    return found.select("doc_id", "rule")

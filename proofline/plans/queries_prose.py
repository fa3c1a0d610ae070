"""Named queries: formulaic prose.

The corpus is invented text without stock phrases. Each document gets two lines that carry tells,
chosen by its id, before the rules run over the whole text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from proofline.functions import text as T
from proofline.functions.lexicon import HYPHENATED, LEXICON, QUALIFIERS, RIDERS, lexicon_from_table
from proofline.operators import prose as P
from proofline.operators.units import paragraphs
from proofline.plans.catalog import query, quoted, table
from proofline.plans.queries_units import LINES_SQL, SENTENCES_SQL

TELLS = (
    "It's not just a song, it's a statement. That is the real win.",
    "That is the real win.\nRetries hide outages.\nThat is the real win.",
    "The real question is whether teams adapt. At its core, it is the language of trust.",
    "Let's dive into caching. Here's what you need to know. The thing is, it works.",
    "I'm not saying it fails. To be clear, a tempting approach would be to stop.",
    "Expect innovation, inspiration, and insights from talks, panels and walks.",
    "She noted the door. She noted the lock. She filed both. He left.",
    "The policy — announced late – affects us -- all of us.",
    "It could potentially work, and it might arguably fail. It may rain.",
    "The team is cross-functional, the report is high-quality, and a data-driven plan is long-term.",
    "The results are preserved and the file was quickly opened. It is stolen.",
    "Additionally, a vibrant tapestry is a testament to the enduring and intricate landscape.",
    "It stands as a testament, a pivotal moment. The future looks bright.",
    "He is associated with the band and linked to it in connection with work.",
    "The colours glow, symbolizing flowers, reflecting the land, and ensuring depth.",
    "Nestled in the heart of town, it boasts breathtaking natural beauty.",
    "Experts believe so. Industry reports and some critics agree.",
    "It serves as a hall and functions as a shop. The term refers to a place.",
    "It blends **goals** and **plans (all)** with **more**.\n- **Speed:** faster now.\n- **Size**: smaller.",
    "## Strategic Negotiations And Global Partnerships\n- → Go there now\n## A quiet heading in plain case",
    "He said “on track” and \"Great question! Let me know\" was quoted.",
    "Great question! I hope this helps. Let me know. Certainly! 希望这对您有帮助",
    "It is believed that she likely grew up here. Details are not publicly available.",
    "# Performance matters\nPerformance always matters a lot.\nReal content here. And more.",
    "In order to win, and due to the fact that it rains, we go.",
    "The substrate is a flywheel and the north star is a paradigm. We utilize numerous tools and leverage them.",
    "If you come: use it. From art to science it goes. No taste. No nostalgia. No rules. One two three four five.",
)
_CASES = " ".join(
    f"WHEN {i} THEN " + " || chr(10) || ".join(quoted(line) for line in t.split("\n")) for i, t in enumerate(TELLS))
TELL_TEXT = (f"text || chr(10) || (CASE doc_id % {len(TELLS)} {_CASES} END) || ' ' || "
             f"(CASE (doc_id + 7) % {len(TELLS)} {_CASES} END)")
SPARK_TELL_TEXT = TELL_TEXT
TELL_DOCS_SQL = f"SELECT doc_id, {TELL_TEXT} AS text FROM documents"
TELL_LINES_SQL = LINES_SQL.replace("FROM documents", f"FROM ({TELL_DOCS_SQL})")
TELL_SENTENCES_SQL = f"""SELECT doc_id, para_idx, row_number() OVER (PARTITION BY doc_id, para_idx ORDER BY ord) - 1 AS sent_idx, replace(sentence, chr(2), '.') AS sentence FROM (
  SELECT doc_id, para_idx, unnest(ss) AS s0, unnest(generate_series(1, len(ss))) AS ord, trim(s0) AS sentence
  FROM (SELECT doc_id, para_idx, list_filter(string_split(regexp_replace(regexp_replace(text,
      {quoted("(^|[ ])([(]?(?:" + "|".join(w.replace(".", "[.]") for w in sorted(T.SENTENCE_ABBREVIATIONS, key=len, reverse=True)) + "|[A-Za-z]))[.]([ ]|$)")}, '\\1\\2' || chr(2) || '\\3', 'gi'),
      '([.!?]+["''”)]*)([ ]+[\\p{{Lu}}0-9("“]|[ ]*$)', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x) <> '') AS ss
    FROM ({TELL_LINES_SQL})))"""
# ASCII word edges become Unicode word edges once accented letters are plain letters.
FLAT = "regexp_replace(text, '[ß-öø-ÿÀ-ÖØ-Þ]', 'z', 'g')"


def tell_docs(spark, sf):
    return table(spark, sf, "documents").selectExpr("doc_id", "lang", f"{SPARK_TELL_TEXT.replace(chr(10), ' ')} AS text")


def _pattern_sql(rule: str, pattern: str, column: str = FLAT) -> str:
    return (f"SELECT doc_id, '{rule}' AS rule, CAST(sum(len(regexp_extract_all({column}, {quoted(pattern)}))) AS BIGINT) AS n "
            f"FROM ({TELL_LINES_SQL}) GROUP BY doc_id HAVING n > 0")


def _phrases(phrases, others=()) -> str:
    import re
    body = "|".join(re.escape(p).replace("\\ ", " ").replace("\\'", "'") + (r"\b" if p[-1].isalnum() else "")
                    for p in sorted(phrases, key=len, reverse=True))
    tail = "".join("|" + re.escape(p) for p in sorted(others, key=len, reverse=True))
    return rf"(?i)\b(?:{body}){tail}"


def _lexicon_sql(rule: str) -> str:
    entry = next(r for r in LEXICON if r.rule == rule)
    return _pattern_sql(rule, _phrases(entry.phrases, entry.other_scripts))


def _counts(*rules):
    """Ungated, unexempted hits of some rules per document."""
    def run(spark, sf):
        lexicon = [r for r in LEXICON if r.rule in rules]
        hits = P.prose_hits(tell_docs(spark, sf), lexicon, gate=False, exempt_quotes=False)
        return hits.where(F.col("rule").isin(*rules)).groupBy("doc_id", "rule").agg(F.count("*").alias("n"))
    return run


query("d1_contrast", _pattern_sql("prose.contrast", P.CONTRAST.replace(P.EDGE_LEFT, r"\b").replace(P.EDGE_RIGHT, r"\b") + "|" + P.CONTRAST_OTHER))(
    _counts("prose.contrast"))


@query("d2_repeated_closers", f"""
SELECT doc_id, lower(sentence) AS closer, count(*) AS times, min(para_idx) AS first_idx
FROM (SELECT doc_id, para_idx, min(sentence) AS sentence FROM ({TELL_SENTENCES_SQL}) GROUP BY ALL HAVING count(*) = 1)
WHERE NOT starts_with(sentence, '#') GROUP BY ALL HAVING times > 1""")
def d2(spark, sf):
    return P.repeated_closers(tell_docs(spark, sf))


def _run_sql(value: str, keep: str = "true") -> str:
    return f"""WITH s AS (SELECT *, {value} AS v FROM ({TELL_SENTENCES_SQL})),
r AS (SELECT *, lag(v) OVER w AS p1, lead(v) OVER w AS n1, lead(v, 2) OVER w AS n2 FROM s WINDOW w AS (PARTITION BY doc_id, para_idx ORDER BY sent_idx))"""


@query("d2_fragment_runs", _run_sql("len(regexp_extract_all(sentence, '\\S+')) <= 4") + """
SELECT doc_id, para_idx, CAST(sent_idx AS INTEGER) AS sent_idx FROM r WHERE v AND n1 AND n2 AND NOT coalesce(p1, false)""")
def d2_fragments(spark, sf):
    return P.fragment_runs(tell_docs(spark, sf))


query("d3_sayings", _lexicon_sql("prose.saying"))(_counts("prose.saying"))
query("d4_run_up", _pattern_sql("prose.run-up", "(?i)(?:^|[.!?] )(?:" + "|".join(
    p.replace("?", "[?]") for p in sorted(next(r for r in LEXICON if r.rule == "prose.run-up").phrases, key=len, reverse=True)) + ")"))(
    _counts("prose.run-up"))
query("d5_arguing_with_no_one", _lexicon_sql("prose.no-one"))(_counts("prose.no-one"))


@query("d6_triad_rate", f"""
SELECT d.doc_id, len(regexp_extract_all(d.text, {quoted(P.TRIAD)})) AS hits, CAST(s.n AS INTEGER) AS sentences, round(hits / s.n, 6) AS rate
FROM ({TELL_DOCS_SQL}) d JOIN (SELECT doc_id, count(*) AS n FROM ({TELL_SENTENCES_SQL}) GROUP BY doc_id) s USING (doc_id)""")
def d6(spark, sf):
    return P.rate_per(tell_docs(spark, sf), P.TRIAD, per_sentence=True)


@query("d7_repeated_openings", _run_sql("lower(regexp_extract(sentence, '([\\p{L}\\p{N}]+)', 1))") + """
SELECT doc_id, para_idx, CAST(sent_idx AS INTEGER) AS sent_idx, v AS opening FROM r WHERE v <> '' AND v = n1 AND v = n2 AND p1 IS DISTINCT FROM v""")
def d7(spark, sf):
    return P.repeated_openings(tell_docs(spark, sf))


@query("d8_dash_rate", f"""
SELECT doc_id, len(regexp_extract_all(text, '—|–| -- ')) AS hits, len(regexp_extract_all(text, '\\S+')) AS words,
  round(hits * 1000 / words, 6) AS rate FROM ({TELL_DOCS_SQL})""")
def d8(spark, sf):
    return P.rate_per(tell_docs(spark, sf), P.DASH)


@query("d9_stacked_qualifiers", f"""
SELECT doc_id, para_idx, CAST(sent_idx AS INTEGER) AS sent_idx, len(regexp_extract_all({FLAT.replace('text', 'sentence')}, {quoted(_phrases(QUALIFIERS))})) AS qualifiers
FROM ({TELL_SENTENCES_SQL}) WHERE qualifiers >= 2""")
def d9(spark, sf):
    return P.stacked_qualifiers(tell_docs(spark, sf))


query("d10_hyphen_pairs", _pattern_sql("prose.hyphen-pair", r"(?i)\b(?:" + "|".join(HYPHENATED) + r")(?:[.,;:!?]|$| (?:and|or|but)\b)"))(
    _counts("prose.hyphen-pair"))
query("d11_passive", _pattern_sql("prose.passive", P.PASSIVE.replace(P.EDGE_LEFT, r"\b").replace(P.EDGE_RIGHT, r"\b"),
                                  "regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g')"))(_counts("prose.passive"))


@query("d12_overused_words", f"""
SELECT doc_id, para_idx, CAST(len(m) AS INTEGER) AS hits, CAST(len(list_distinct(list_transform(m, lambda x: lower(x)))) AS INTEGER) AS words FROM (
 SELECT doc_id, para_idx, regexp_extract_all({FLAT}, {quoted(_phrases(next(r for r in LEXICON if r.rule == 'prose.overused').phrases))}) AS m FROM ({TELL_LINES_SQL})) WHERE len(m) > 0""")
def d12(spark, sf):
    entry = next(r for r in LEXICON if r.rule == "prose.overused")
    found = F.regexp_extract_all("text", F.lit(P.phrase_pattern(entry.phrases)), F.lit(0))
    rows = paragraphs(tell_docs(spark, sf)).select("doc_id", "para_idx", found.alias("m")).where(F.size("m") > 0)
    return rows.select("doc_id", "para_idx", F.size("m").alias("hits"),
                       F.size(F.array_distinct(F.transform("m", lambda w: F.lower(w)))).alias("words"))


query("d13_significance", _lexicon_sql("prose.significance"))(_counts("prose.significance"))


@query("d13_send_off", f"""
SELECT doc_id FROM (SELECT doc_id, arg_max(text, para_idx) AS line FROM ({TELL_LINES_SQL}) WHERE trim(text) <> '' GROUP BY doc_id)
WHERE regexp_matches(line, '(?i)the future looks bright|exciting times')""")
def d13_send_off(spark, sf):
    return P.closing_lines(tell_docs(spark, sf), "(?i)the future looks bright|exciting times").select("doc_id")


query("d14_vague_link", _lexicon_sql("prose.vague-link"))(_counts("prose.vague-link"))
query("d15_riders", _pattern_sql("prose.rider", "(?i), (?:" + "|".join(RIDERS) + r")\b"))(_counts("prose.rider"))
query("d16_sales", _lexicon_sql("prose.sales"))(_counts("prose.sales"))
query("d17_authority", _lexicon_sql("prose.authority"))(_counts("prose.authority"))
query("d18_copula", _lexicon_sql("prose.copula"))(_counts("prose.copula"))
#: Without look-behind: runs of three or more stars become one, which neither opens nor closes bold text and ends its content.
query("d19_bold", _pattern_sql("prose.bold", r"\*\*[^*\s][^*]*\*\*", r"regexp_replace(text, '\*\*\*+', '*', 'g')") + " UNION ALL "
      + _pattern_sql("prose.inline-header", P.INLINE_HEADER, "text"))(_counts("prose.bold", "prose.inline-header"))


@query("d20_heading_style", f"""
WITH h AS (SELECT doc_id, para_idx, regexp_extract_all(regexp_replace(text, '^#{{1,6}} +', ''), '\\p{{L}}{{4,}}') AS w FROM ({TELL_LINES_SQL}) WHERE regexp_matches(text, '^#{{1,6}} '))
SELECT doc_id, para_idx, 'prose.title-case' AS rule FROM h WHERE len(w) >= 3 AND len(list_filter(w, lambda x: regexp_matches(x, '^\\p{{Lu}}'))) / len(w) >= 0.6
UNION ALL SELECT doc_id, para_idx, 'prose.decorated' FROM ({TELL_LINES_SQL}) WHERE regexp_matches(text, '^(?:#{{1,6}} |[ ]*[-*•] )') AND regexp_matches(text, '[→⇒]')""")
def d20(spark, sf):
    return P.heading_style(tell_docs(spark, sf))


query("d21_curly_quotes", _pattern_sql("prose.curly-quote", "[“”]", "text"))(_counts("prose.curly-quote"))


@query("d22_chat_residue", f"""
SELECT conv_id, turn, CAST(len(regexp_extract_all({FLAT}, {quoted(_phrases(next(r for r in LEXICON if r.rule == 'prose.chat').phrases))})) AS INTEGER) AS n
FROM (SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 1 THEN 'Great question! ' || text ELSE text || ' Let me know if it helps. Certainly!' END AS text
      FROM conversations WHERE role = 'assistant') WHERE n > 0""")
def d22(spark, sf):
    entry = next(r for r in LEXICON if r.rule == "prose.chat")
    text = F.expr("CASE (conv_id + turn) % 4 WHEN 1 THEN concat('Great question! ', text) "
                  "ELSE concat(text, ' Let me know if it helps. Certainly!') END")
    rows = table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", text.alias("text"))
    n = F.regexp_count("text", F.lit(P.phrase_pattern(entry.phrases, other_scripts=entry.other_scripts)))
    return rows.select("conv_id", "turn", n.alias("n")).where("n > 0")


query("d23_disclaimers", _lexicon_sql("prose.disclaimer"))(_counts("prose.disclaimer"))


@query("d24_repeated_headings", f"""
SELECT doc_id, 0 + para_idx AS para_idx FROM ({TELL_LINES_SQL}) WHERE text = '# Performance matters'
  AND doc_id % {len(TELLS)} = 23""")
def d24(spark, sf):
    return P.repeated_headings(tell_docs(spark, sf))


def _replaced(rule):
    def run(spark, sf):
        lexicon = [r for r in LEXICON if r.rule == rule]
        hits = P.prose_hits(tell_docs(spark, sf), lexicon, gate=False, exempt_quotes=False).where(F.col("rule") == rule)
        hits = P.with_replacements(hits).where("replacement IS NOT NULL")
        return hits.groupBy("doc_id", F.lower("phrase").alias("phrase"), "replacement").agg(F.count("*").alias("n"))
    return run


def _replaced_sql(rule):
    entry = next(r for r in LEXICON if r.rule == rule)
    rows = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in entry.replacements.items())
    return f"""SELECT doc_id, lower(p) AS phrase, replacement, count(*) AS n FROM (
      SELECT doc_id, unnest(regexp_extract_all({FLAT}, {quoted(_phrases(entry.phrases))})) AS p FROM ({TELL_LINES_SQL}))
      JOIN (VALUES {rows}) AS t(phrase, replacement) ON lower(p) = t.phrase GROUP BY ALL"""


query("d25_filler", _replaced_sql("prose.filler"))(_replaced("prose.filler"))
query("d26_metaphor_nouns", _lexicon_sql("prose.metaphor"))(_counts("prose.metaphor"))
query("d27_fancy_words", _replaced_sql("prose.fancy"))(_replaced("prose.fancy"))
query("d28_colon_connector", _pattern_sql("prose.colon", P.COLON, "text"))(_counts("prose.colon"))
query("d29_false_ranges", _pattern_sql("prose.false-range", P.FALSE_RANGE.replace(P.EDGE_LEFT, r"\b").replace(P.EDGE_RIGHT, ""), "text"))(
    _counts("prose.false-range"))


@query("d30_equal_lengths", f"""
WITH s AS (SELECT *, len(regexp_extract_all(sentence, '\\S+')) AS v FROM ({TELL_SENTENCES_SQL})),
r AS (SELECT *, lag(v) OVER w AS p1, lag(v, 2) OVER w AS p2 FROM s WINDOW w AS (PARTITION BY doc_id, para_idx ORDER BY sent_idx))
SELECT doc_id, para_idx, CAST(sent_idx AS INTEGER) AS sent_idx FROM r WHERE v = p1 AND v = p2""")
def d30(spark, sf):
    return P.equal_lengths(tell_docs(spark, sf))


@query("d31_weak_gate", f"""
WITH c AS (SELECT doc_id, para_idx, len(regexp_extract_all({FLAT}, {quoted(_phrases(next(r for r in LEXICON if r.rule == 'prose.overused').phrases))})) AS weak,
  CAST(len(regexp_extract_all({FLAT}, {quoted(_phrases(next(r for r in LEXICON if r.rule == 'prose.sales').phrases))})) > 0 AS INTEGER) AS a,
  CAST(len(regexp_extract_all({FLAT}, {quoted(_phrases(next(r for r in LEXICON if r.rule == 'prose.significance').phrases))})) > 0 AS INTEGER) AS b,
  CAST(len(regexp_extract_all({FLAT}, {quoted(_phrases(next(r for r in LEXICON if r.rule == 'prose.copula').phrases))})) > 0 AS INTEGER) AS c
  FROM ({TELL_LINES_SQL}))
SELECT doc_id, para_idx, weak AS n FROM c WHERE weak > 0 AND a + b + c >= 2""")
def d31(spark, sf):
    rules = ("prose.overused", "prose.sales", "prose.significance", "prose.copula")
    parts = [P._hits(F.col("text"), r.rule, P.phrase_pattern(r.phrases), r.weak) for r in LEXICON if r.rule in rules]
    kept = F.filter(P.gate_weak(F.concat(*parts)), lambda h: h["weak"])
    return paragraphs(tell_docs(spark, sf)).select("doc_id", "para_idx", F.size(kept).alias("n")).where("n > 0")


@query("d32_quotation_exemption", f"""
SELECT doc_id, CAST(sum(len(regexp_extract_all(regexp_replace({FLAT}, '"[^"]*"|“[^”]*”', '', 'g'), {quoted(_phrases(next(r for r in LEXICON if r.rule == 'prose.chat').phrases))}))) AS BIGINT) AS n
FROM ({TELL_LINES_SQL}) GROUP BY doc_id HAVING n > 0""")
def d32(spark, sf):
    entry = next(r for r in LEXICON if r.rule == "prose.chat")
    hits = P.outside_quotes(P._hits(F.col("text"), entry.rule, P.phrase_pattern(entry.phrases)))
    rows = paragraphs(tell_docs(spark, sf)).select("doc_id", F.size(hits).alias("n"))
    return rows.groupBy("doc_id").agg(F.sum("n").alias("n")).where("n > 0")


@query("d33_tell_profile")
def d33(spark, sf):
    return P.tell_profile(tell_docs(spark, sf), table(spark, sf, "labels"))


@query("l3_lexicon_table", """
WITH x AS (SELECT lower(n_name) AS phrase, 'house.region-' || n_regionkey AS rule FROM nation UNION ALL SELECT lower(n_name) || ' and ' || lower(r_name), 'house.pair' FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 2 = 0),
d AS (SELECT doc_id, text || ' In ' || n_name || ', ' || n_name || 'N and ' || lower(r_name) || ' or ' || upper(n_name) || ' and ' || r_name || '.' AS t, n_name, r_name, n_regionkey, n_nationkey FROM documents JOIN nation ON n_nationkey = doc_id % 25 JOIN region ON r_regionkey = n_regionkey)
SELECT doc_id, 'house.region-' || n_regionkey AS rule, CAST(2 AS BIGINT) AS n FROM d UNION ALL SELECT doc_id, 'house.pair', 1 FROM d WHERE n_nationkey % 2 = 0""")
def l3(spark, sf):
    """A lexicon given as a table: names of nations by region, and pairs of nation and region, in documents that mention them."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    both = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    extra = "cast(null as boolean) AS weak, cast(null as boolean) AS opens_sentence, cast(null as boolean) AS other_script, cast(null as string) AS replacement"
    lexicon = lexicon_from_table(both.selectExpr("concat('house.region-', n_regionkey) AS rule", "lower(n_name) AS phrase", *extra.split(", ")).unionByName(
        both.where("n_nationkey % 2 = 0").selectExpr("'house.pair' AS rule", "lower(concat(n_name, ' and ', r_name)) AS phrase", *extra.split(", "))))
    docs = table(spark, sf, "documents").join(both, F.col("doc_id") % 25 == F.col("n_nationkey")).selectExpr(
        "doc_id", "concat(text, ' In ', n_name, ', ', n_name, 'N and ', lower(r_name), ' or ', upper(n_name), ' and ', r_name, '.') AS text")
    hits = docs.select("doc_id", F.explode(P.phrase_hits(F.col("text"), lexicon)).alias("h"))
    return hits.groupBy("doc_id", F.col("h.rule").alias("rule")).agg(F.count("*").alias("n"))

"""Named queries: comparison of document versions and snapshots.

The newer version of every document is derived from the older one: lines changed, dropped and added
by position.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from proofline.operators import versions as V
from proofline.operators.units import paragraphs
from proofline.plans.catalog import query, table
from proofline.plans.queries_units import LINES_SQL, merged_sql, positional_sql, revision_runs

#: In every fifth document the first line has moved behind all others; then lines are changed, dropped and added by their place.
MOVED = "if(doc_id % 5 = 0 AND size(split(text, '\\n')) > 1, concat(slice(split(text, '\\n'), 2, size(split(text, '\\n')) - 1), slice(split(text, '\\n'), 1, 1)), split(text, '\\n'))"
NEWER = f"""flatten(transform({MOVED}, (l, i) -> CASE WHEN (doc_id + i) % 11 = 3 THEN cast(array() as array<string>)
  WHEN (doc_id + i) % 9 = 0 THEN array(concat(l, ' P = 0.05 higher')) WHEN (doc_id + i) % 13 = 5 THEN array(l, concat('New line ', i, ' with 12% more'))
  ELSE array(l) END))"""


def both_versions(spark, sf):
    docs = table(spark, sf, "documents")
    old = paragraphs(docs).select("doc_id", F.col("para_idx").alias("idx"), "text")
    new = docs.select("doc_id", F.posexplode(F.expr(NEWER)).alias("idx", "text"))
    return old, new


EDIT = """CASE (doc_id + para_idx) % 7 WHEN 0 THEN text || ' P = 0.05 higher' WHEN 1 THEN replace(text, ' de ', ' or ') WHEN 2 THEN 'More 12.5% ' || text || ' 3' WHEN 3 THEN replace(replace(text, ' the ', ' a '), 'e', 'e') ELSE text END"""


def line_pairs(spark, sf):
    rows = paragraphs(table(spark, sf, "documents"))
    return rows.selectExpr("doc_id * 100000 + para_idx AS id", "doc_id", "text AS old", f"{EDIT} AS new")


#: The signs of these edits stand in no text, so what stays the same is known from the edit, without comparing the versions: signs at
#: the end, for every comma, around the line, two for every full stop, and one that moves over the whole line.
_CASE = "(doc_id + para_idx) % 7"
MARKED_OLD = f"CASE WHEN {_CASE} = 6 AND text LIKE '% %' THEN concat('¤', text) ELSE text END"
MARKED_NEW = f"""CASE {_CASE} WHEN 0 THEN concat(text, '¤9') WHEN 1 THEN replace(text, ',', '¤') WHEN 2 THEN concat('¤', text, '§') WHEN 3 THEN replace(text, '.', '¤¤')
 WHEN 6 THEN CASE WHEN text LIKE '% %' THEN concat(text, '¤') ELSE text END ELSE text END"""


def marked_pairs(spark, sf):
    rows = paragraphs(table(spark, sf, "documents"))
    return rows.selectExpr("doc_id * 100000 + para_idx AS id", "doc_id + para_idx AS n", f"{MARKED_OLD} AS old", f"{MARKED_NEW} AS new")


MARKED_SQL = f"""p AS MATERIALIZED (SELECT * FROM (SELECT doc_id * 100000 + para_idx AS id, doc_id + para_idx AS n, {_CASE} AS k, text, length(text) AS size, {MARKED_OLD} AS old, {MARKED_NEW} AS new FROM ({LINES_SQL}))),
d AS MATERIALIZED (SELECT * FROM p WHERE old <> new),
sign AS (SELECT id, k, i - 1 AS place, i - 1 - row_number() OVER (PARTITION BY id ORDER BY i) AS run, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS before
  FROM (SELECT id, k, text, unnest(range(1, size + 1)) AS i FROM d WHERE k IN (1, 3)) WHERE substr(text, i, 1) = CASE k WHEN 1 THEN ',' ELSE '.' END),
e AS (SELECT id, size AS old_start, size AS old_end, size AS new_start, size + 2 AS new_end FROM d WHERE k = 0
  UNION ALL SELECT id, min(place), max(place) + 1, min(place) + CASE WHEN k = 3 THEN min(before) ELSE 0 END, max(place) + 1 + CASE WHEN k = 3 THEN max(before) + 1 ELSE 0 END FROM sign GROUP BY id, k, run
  UNION ALL SELECT id, 0, 0, 0, CASE WHEN size = 0 THEN 2 ELSE 1 END FROM d WHERE k = 2 UNION ALL SELECT id, size, size, size + 1, size + 2 FROM d WHERE k = 2 AND size > 0
  UNION ALL SELECT id, 0, 1, 0, 0 FROM d WHERE k = 6 UNION ALL SELECT id, size + 1, size + 1, size, size + 1 FROM d WHERE k = 6),
c AS (SELECT e.*, d.old, d.new FROM e JOIN d USING (id))"""
_CUT = "CAST({0}_start AS INTEGER) AS {0}_start, CAST({0}_end AS INTEGER) AS {0}_end"
JOINED_SQL = f"""WITH {MARKED_SQL},
z AS (SELECT *, greatest(old_end - old_start, new_end - new_start) AS size, old_end > old_start AND new_end > new_start AS two,
  trim(substr(old, old_start + 1, old_end - old_start)) = '' AND trim(substr(new, new_start + 1, new_end - new_start)) = '' AS blank FROM c),
y AS (SELECT *, old_start - lag(old_end) OVER w AS gap, lag(size) OVER w AS size0, lag(two) OVER w AS two0, lag(blank) OVER w AS blank0, lag(old_end) OVER w AS end0 FROM z WINDOW w AS (PARTITION BY id ORDER BY old_start, new_start)),
x AS (SELECT *, coalesce((gap <= least(size, size0) AND NOT blank AND NOT blank0) OR (gap BETWEEN 1 AND 2 AND trim(substr(old, end0 + 1, gap)) = '' AND two AND two0), false) AS joins FROM y),
g AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY old_start, new_start) AS grp FROM x),
j AS (SELECT id, any_value(old) AS old, any_value(new) AS new, min(old_start) AS old_start, max(old_end) AS old_end, min(new_start) AS new_start, max(new_end) AS new_end FROM g GROUP BY id, grp)"""


def _alignment_sql() -> str:
    """Paragraphs by a quadratic table of longest common subsequences; versions by a search over all pairs of a gap, one old paragraph after the other."""
    old = f"SELECT doc_id AS id, CAST(para_idx AS INTEGER) AS pos, text FROM ({LINES_SQL})"
    newer = """SELECT doc_id AS id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, h) - 1 AS INTEGER) AS pos, text FROM (
SELECT doc_id, i, h, CASE WHEN (doc_id + i) % 9 = 0 THEN l || ' P = 0.05 higher' WHEN h = 1 THEN 'New line ' || i || ' with 12% more' ELSE l END AS text
FROM (SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN para_idx WHEN para_idx = 0 THEN count(*) OVER (PARTITION BY doc_id) - 1 ELSE para_idx - 1 END AS i, text AS l FROM (LINES)), (SELECT unnest([0, 1]) AS h)
WHERE (doc_id + i) % 11 <> 3 AND (h = 0 OR ((doc_id + i) % 13 = 5 AND (doc_id + i) % 9 <> 0)))""".replace("LINES", LINES_SQL)
    same = lambda a, b: f"(SELECT coalesce(x.id, y.id) AS id, min(coalesce(x.k, y.k)) FILTER (x.text IS DISTINCT FROM y.text) AS first FROM {a} x FULL JOIN {b} y ON x.id = y.id AND x.k = y.k GROUP BY 1)"
    ranked = lambda table, size: f"(SELECT t.id, {size} - 1 - t.pos AS k, t.text FROM {table} t JOIN hd USING (id) WHERE t.pos >= head)"
    core = lambda table, size, place: f"(SELECT t.id, t.pos - head AS {place}, t.text AS t, t.pos FROM {table} t JOIN tl USING (id) WHERE t.pos >= head AND t.pos < {size} - tail)"
    side = lambda name, rows, place: (f"(SELECT r.id, r.pos AS {name}, r.t AS text, list_distinct(regexp_extract_all(r.t, '\\S+')) AS w, (SELECT count(*) FROM tr WHERE tr.id = r.id AND tr.want < tr.top AND tr.{'a' if place == 'i' else 'b'} < r.{place}) AS gap "  # noqa: E731
                                      f"FROM {rows} r WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.id = r.id AND tr.want < tr.top AND tr.{'a' if place == 'i' else 'b'} = r.{place}))")
    return f"""WITH RECURSIVE ot AS MATERIALIZED ({old}), nt AS MATERIALIZED ({newer}),
sz AS (SELECT coalesce(x.id, y.id) AS id, coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2 FROM (SELECT id, count(*) AS n1 FROM ot GROUP BY id) x FULL JOIN (SELECT id, count(*) AS n2 FROM nt GROUP BY id) y ON x.id = y.id),
hd AS MATERIALIZED (SELECT id, n1, n2, coalesce(first, n1) AS head FROM sz JOIN {same('(SELECT id, pos AS k, text FROM ot)', '(SELECT id, pos AS k, text FROM nt)')} USING (id)),
tl AS MATERIALIZED (SELECT id, n1, n2, head, coalesce(first, n1 - head) AS tail FROM hd LEFT JOIN {same(ranked('ot', 'n1'), ranked('nt', 'n2'))} USING (id)),
x AS MATERIALIZED {core('ot', 'n1', 'i')}, y AS MATERIALIZED {core('nt', 'n2', 'j')},
n AS (SELECT id, n1 - head - tail AS m1, n2 - head - tail AS m2 FROM tl WHERE n1 - head - tail > 0 AND n2 - head - tail > 0),
lcs AS (SELECT id, CAST(m1 AS INTEGER) AS i, CAST(j AS INTEGER) AS j, 0 AS l FROM (SELECT id, m1, unnest(range(0, m2 + 1)) AS j FROM n)
  UNION ALL SELECT id, CAST(i AS INTEGER), j, CAST(max(greatest(l, v)) OVER (PARTITION BY id ORDER BY j DESC) AS INTEGER) FROM (
    SELECT w.id, w.i - 1 AS i, w.j, w.l, CASE WHEN x.t = y.t THEN 1 + lead(w.l) OVER (PARTITION BY w.id ORDER BY w.j) ELSE 0 END AS v FROM lcs w JOIN x ON x.id = w.id AND x.i = w.i - 1 LEFT JOIN y ON y.id = w.id AND y.j = w.j)),
eq AS MATERIALIZED (SELECT x.id, x.i AS a, y.j AS b, l + 1 AS s FROM x JOIN y ON x.id = y.id AND x.t = y.t JOIN lcs ON lcs.id = x.id AND lcs.i = x.i + 1 AND lcs.j = y.j + 1),
tr AS (SELECT id, l AS top, l AS want, CAST(-1 AS BIGINT) AS a, CAST(-1 AS BIGINT) AS b FROM lcs WHERE i = 0 AND j = 0
  UNION ALL SELECT id, top, want - 1, c // 1000000, c % 1000000 FROM (SELECT tr.id, tr.top, tr.want, min(eq.a * 1000000 + eq.b) AS c FROM tr JOIN eq ON eq.id = tr.id AND eq.s = tr.want AND eq.a > tr.a AND eq.b > tr.b GROUP BY ALL)),
l AS MATERIALIZED {side('a', 'x', 'i')}, r2 AS MATERIALIZED {side('b', 'y', 'j')},
sc AS MATERIALIZED (SELECT * FROM (SELECT l.id, l.gap, l.a, r2.b, 2 * len(list_intersect(l.w, r2.w)) / (len(l.w) + len(r2.w)) AS score FROM l JOIN r2 ON l.id = r2.id AND l.gap = r2.gap) WHERE score >= 0.5),
ol AS MATERIALIZED (SELECT id, gap, a, row_number() OVER (PARTITION BY id, gap ORDER BY a) AS k FROM l),
gr AS (SELECT DISTINCT id, gap, CAST(0 AS BIGINT) AS k, CAST(-1 AS INTEGER) AS start, CAST(NULL AS INTEGER) AS a, CAST(NULL AS INTEGER) AS b FROM ol
  UNION ALL SELECT id, gap, k + 1, CAST(coalesce(best.b + 1, start) AS INTEGER), a, best.b FROM (SELECT gr.id, gr.gap, gr.k, gr.start, ol.a, max({{'score': sc.score, 'b': sc.b}}) FILTER (sc.b IS NOT NULL) AS best
    FROM gr JOIN ol ON ol.id = gr.id AND ol.gap = gr.gap AND ol.k = gr.k + 1 LEFT JOIN sc ON sc.id = ol.id AND sc.gap = ol.gap AND sc.a = ol.a AND sc.b >= gr.start GROUP BY ALL)),
pr AS (SELECT id, a, b FROM gr WHERE b IS NOT NULL),
al AS (SELECT coalesce(x.id, r2.id) AS doc_id, CASE WHEN x.a IS NULL THEN 'added' WHEN r2.b IS NULL THEN 'removed' ELSE 'changed' END AS kind, x.a AS old_idx, r2.b AS new_idx, coalesce(x.text, '') AS old, coalesce(r2.text, '') AS new
 FROM (SELECT l.id, l.a, l.text, pr.b FROM l LEFT JOIN pr ON pr.id = l.id AND pr.a = l.a) x FULL JOIN r2 ON r2.id = x.id AND r2.b = x.b)"""


ALIGNMENT_SQL = _alignment_sql()


@query("f1_paragraph_align", f"""{ALIGNMENT_SQL} SELECT doc_id, kind, old_idx, new_idx, sha256(old) AS old, sha256(new) AS new FROM al""")
def f1(spark, sf):
    return V.paragraph_align(*both_versions(spark, sf)).select(
        "doc_id", "kind", "old_idx", "new_idx", F.sha2("old", 256).alias("old"), F.sha2("new", 256).alias("new"))


@query("f2_word_diff", f"""WITH {MARKED_SQL}
SELECT id, false AS atoms_changed, {_CUT.format('old')}, {_CUT.format('new')}, substr(old, old_start + 1, old_end - old_start) AS old_text, substr(new, new_start + 1, new_end - new_start) AS new_text FROM c""")
def f2(spark, sf):
    return V.word_diff(marked_pairs(spark, sf), joined=False)


@query("f3_diff_cleanup", f"""{JOINED_SQL}
SELECT id, {_CUT.format('old')}, {_CUT.format('new')}, substr(old, old_start + 1, old_end - old_start) AS old_text, substr(new, new_start + 1, new_end - new_start) AS new_text FROM j""")
def f3(spark, sf):
    return V.word_diff(marked_pairs(spark, sf)).drop("atoms_changed")


_SCIENCE = V.SCIENCE.replace("(?U)", "")
_TERMS = "regexp_extract_all(@, '" + _SCIENCE + "')"
SCIENCE_SQL = f"""
WITH p AS (SELECT id, {_TERMS.replace('@', 'old')} AS a, {_TERMS.replace('@', 'new')} AS b FROM (SELECT doc_id * 100000 + para_idx AS id, text AS old, {EDIT} AS new FROM ({LINES_SQL}))),
d AS (SELECT id, a, b, list_filter(list_distinct(a), lambda t: len(list_filter(a, lambda x: x = t)) > len(list_filter(b, lambda x: x = t))) AS r,
  list_filter(list_distinct(b), lambda t: len(list_filter(b, lambda x: x = t)) > len(list_filter(a, lambda x: x = t))) AS n FROM p)
SELECT id, array_to_string(list_sort(r), '|') AS removed, array_to_string(list_sort(n), '|') AS added, len(r) = 0 AND len(n) = 0 AND a <> b AS reordered FROM d WHERE len(r) + len(n) > 0 OR a <> b"""


@query("f4_science_delta", SCIENCE_SQL)
def f4(spark, sf):
    delta = V.science_delta(line_pairs(spark, sf)).where("size(removed) + size(added) > 0 OR reordered")
    join = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), "|").alias(c)
    return delta.select("id", join("removed"), join("added"), "reordered")


#: The second engine's word edges know ASCII letters only; other letters become one that can start no term.
_ASCII_WORDS = "regexp_replace(@, '[À-ÖØ-öø-ɏ]', 'x', 'g')"


@query("f5_drift_report", f"""{ALIGNMENT_SQL}, q AS (SELECT doc_id, kind, {_TERMS.replace('@', _ASCII_WORDS.replace('@', 'old'))} AS a, {_TERMS.replace('@', _ASCII_WORDS.replace('@', 'new'))} AS b FROM al),
t AS (SELECT *, list_sum(list_transform(list_distinct(a), lambda t: greatest(len(list_filter(a, lambda x: x = t)) - len(list_filter(b, lambda x: x = t)), 0))) AS gone,
  list_sum(list_transform(list_distinct(b), lambda t: greatest(len(list_filter(b, lambda x: x = t)) - len(list_filter(a, lambda x: x = t)), 0))) AS come FROM q),
k AS (SELECT id, 0 AS v, sum(len(regexp_extract_all(text, '\\[\\d+\\]'))) AS c, count(*) FILTER (contains(text, '!')) AS i FROM ot GROUP BY id UNION ALL SELECT id, 1, sum(len(regexp_extract_all(text, '\\[\\d+\\]'))), count(*) FILTER (contains(text, '!')) FROM nt GROUP BY id),
f AS (SELECT id, count(*) < 2 OR min(c) <> max(c) OR min(i) <> max(i) AS counts_changed FROM k GROUP BY id)
SELECT t.doc_id, count(*) FILTER (kind = 'changed') AS changed, count(*) FILTER (kind = 'removed') AS paragraphs_removed, count(*) FILTER (kind = 'added') AS paragraphs_added,
 CAST(sum(coalesce(gone, 0)) AS BIGINT) AS terms_removed, CAST(sum(coalesce(come, 0)) AS BIGINT) AS terms_added, any_value(counts_changed) AS counts_changed FROM t LEFT JOIN f ON f.id = t.doc_id GROUP BY t.doc_id""")
def f5(spark, sf):
    old, new = both_versions(spark, sf)
    count = lambda df: df.groupBy("doc_id").agg(
        F.sum(F.regexp_count("text", F.lit(r"\[\d+\]"))).alias("citations"), F.count_if(F.col("text").contains("!")).alias("pictures"))
    return V.drift_report(V.paragraph_align(old, new), count(old), count(new))


@query("f6_undeclared_changes", f"""
WITH l AS (SELECT doc_id, para_idx AS idx, text FROM ({LINES_SQL})), n AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id)
SELECT doc_id, CAST(idx AS BIGINT) AS idx, CASE WHEN doc_id % 2 = 0 THEN 'not the declared text' ELSE 'undeclared change' END AS problem FROM l WHERE (doc_id + idx) % 6 = 0 AND NOT (doc_id % 2 = 0 AND doc_id % 4 = 0)
UNION ALL SELECT doc_id, idx, 'paragraph mark' FROM l WHERE (doc_id + idx) % 10 = 3
UNION ALL SELECT doc_id, n, 'not the declared insertion' FROM n WHERE doc_id % 9 = 0
UNION ALL SELECT doc_id, n, 'paragraph not declared' FROM n WHERE doc_id % 9 = 1""")
def f6(spark, sf):
    base = paragraphs(table(spark, sf, "documents")).selectExpr("doc_id", "para_idx AS idx", "text", "false AS mark_removed")
    edited = base.withColumn("text", F.expr("CASE WHEN (doc_id + idx) % 6 = 0 THEN concat(text, ' edited') ELSE text END")).withColumn(
        "mark_removed", F.expr("(doc_id + idx) % 10 = 3"))
    size = base.groupBy("doc_id").agg(F.count("*").cast("int").alias("n"))
    extra = size.where("doc_id % 9 IN (0, 1, 3, 6)").selectExpr("doc_id", "n AS idx", "if(doc_id % 9 = 0, 'Other', 'Added') AS text", "false AS mark_removed")
    declared = base.where("(doc_id + idx) % 6 = 0 AND doc_id % 2 = 0").selectExpr(
        "doc_id", "idx AS index", "idx AS new_index", "concat(text, if(doc_id % 4 = 0, ' edited', ' other')) AS text", "false AS inserted", "false AS deleted")
    added = size.where("doc_id % 9 IN (0, 3, 6)").selectExpr("doc_id", "cast(null as int) AS index", "n AS new_index", "'Added' AS text", "true AS inserted", "false AS deleted")
    return V.undeclared_changes(base, edited.unionByName(extra), declared.unionByName(added))


TOUCHED = "CASE WHEN (doc_id + para_idx) % 17 = 0 THEN 'Q' || text ELSE text END"
_TOUCHED_LINES = f"SELECT doc_id, para_idx, {TOUCHED} AS text FROM ({LINES_SQL})"


@query("f7_reject_equals_source", f"""
SELECT doc_id, view_idx FROM ({merged_sql(positional_sql("'ins', 'moveTo'", "ins"))}) a JOIN ({merged_sql(positional_sql("'ins', 'moveTo'", "ins", _TOUCHED_LINES))}) b USING (doc_id, view_idx) WHERE a.digest <> b.digest""")
def f7(spark, sf):
    return V.reject_equals_source(revision_runs(spark, sf), revision_runs(spark, sf, TOUCHED)).select("doc_id", "view_idx")


@query("f8_citation_sequence", f"""
SELECT doc_id, min(para_idx) AS first_pos, count(*) AS different FROM ({LINES_SQL}) WHERE (doc_id + para_idx) % 8 = 0 OR (doc_id + para_idx) % 12 = 5 GROUP BY doc_id""")
def f8(spark, sf):
    rows = paragraphs(table(spark, sf, "documents")).withColumn("signature", F.sha2("text", 256))
    base = rows.selectExpr("doc_id", "para_idx AS pos", "signature")
    new = rows.where("(doc_id + para_idx) % 12 <> 5").selectExpr("doc_id", "para_idx AS pos", "if((doc_id + para_idx) % 8 = 0, 'x', signature) AS signature")
    return V.citation_sequence_check(base, new)


_CTX = "array_to_string(list_reverse(list_slice(list_reverse(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}_]+')), 1, 6)), ' ')"


def _before_sql(lead: str, size: int) -> str:
    return _CTX.replace("{0}", f"regexp_replace(substr('{lead}' || text, 1, {size}), '\\(\\d[\\d,\\s–-]*\\)', ' ', 'g')").replace(
        "{{", "{").replace("}}", "}")


@query("f9_citation_context", f"""
WITH c AS (SELECT doc_id, para_idx AS pos, {_before_sql('See (4) ', 40)} AS before, {_before_sql('Lo (4, 5) ', 42)} AS after FROM ({LINES_SQL}))
SELECT doc_id, pos FROM c WHERE before <> after""")
def f9(spark, sf):
    rows = paragraphs(table(spark, sf, "documents"))
    base = rows.withColumn("text", F.concat(F.lit("See (4) "), "text"))
    new = rows.withColumn("text", F.concat(F.lit("Lo (4, 5) "), "text"))
    at = lambda n: rows.selectExpr("doc_id", "para_idx", "para_idx AS pos", f"{n} AS start")
    return V.citation_context_changes(V.citation_contexts(base, at(40)), V.citation_contexts(new, at(42))).select("doc_id", "pos")


@query("f10_formatting_delta", f"""WITH {MARKED_SQL},
t AS (SELECT id, n, k, old, new, w[i] AS token, CAST(coalesce(sum(length(w[i])) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS pos
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM (SELECT id, n, k, old, new, regexp_extract_all(old, '{V.TOKEN}') AS w FROM p WHERE old <> new OR n % 4 = 0))),
m AS (SELECT *, pos + CASE WHEN k = 2 THEN 1 WHEN k = 3 THEN length(substr(old, 1, pos)) - length(replace(substr(old, 1, pos), '.', '')) WHEN k = 6 AND old <> new THEN -1 ELSE 0 END AS b
  FROM t WHERE NOT (k = 1 AND token = ',') AND NOT (k = 3 AND token = '.') AND NOT (k = 6 AND token = '¤' AND pos = 0)),
x AS (SELECT id, pos, token, length(old) // 2 > pos AS had, length(new) // 2 > b AS has, n % 4 = 0 AS bold FROM m WHERE trim(token) <> '')
SELECT id, pos, token, CASE WHEN had AND (bold OR NOT has) THEN 'italic' ELSE '' END AS lost, CASE WHEN has AND bold THEN 'bold' WHEN has AND NOT had THEN 'italic' ELSE '' END AS gained
FROM x WHERE (had AND (bold OR NOT has)) OR (has AND (bold OR NOT had))""")
def f10(spark, sf):
    """The first half of every line is italic; in every fourth line of the newer version it is bold."""
    half = lambda text, name: f"array(named_struct('start', 0, 'end', cast(char_length({text}) div 2 AS int), 'flags', array('{name}')))"
    rows = marked_pairs(spark, sf).selectExpr("id", "old", "new", f"{half('old', 'italic')} AS old_spans", f"CASE WHEN n % 4 = 0 THEN {half('new', 'bold')} ELSE {half('new', 'italic')} END AS new_spans")
    return V.formatting_delta(rows).select("id", "pos", "token", F.array_join("lost", ",").alias("lost"), F.array_join("gained", ",").alias("gained"))


PICTURES = "SELECT o_custkey AS doc_id, o_orderkey AS pos, 'img' || (o_orderkey % 20) AS name, 'd' || (o_orderkey % 33) AS digest, 'img' || (o_custkey % 20) AS swap FROM orders"


@query("f11_picture_set", f"""
WITH b AS ({PICTURES}), c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, name, digest) AS copies FROM b),
l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rank, count(*) OVER (PARTITION BY doc_id, name) AS same FROM b WHERE pos % 10 <> 0)
SELECT doc_id, rank, CASE WHEN name = swap AND same = 1 THEN 'imgX' ELSE name END AS want, CASE WHEN name = swap THEN 'imgX' ELSE name END AS got,
 CASE WHEN name = swap AND same > 1 THEN 'picture order' ELSE 'image bytes differ' END AS problem FROM l
WHERE (name = swap AND same > 1) OR pos % 7 = 0""")
def f11(spark, sf):
    base = spark.sql(PICTURES.replace("orders", "{orders}"), orders=table(spark, sf, "orders"))
    left = base.where("pos % 10 <> 0")
    new = left.selectExpr("doc_id", "pos", "if(name = swap, 'imgX', name) AS name",
                          "if(pos % 7 = 0, 'bad', if(name = swap, 'dx', digest)) AS digest")
    swaps = base.selectExpr("doc_id", "swap AS old_name", "'imgX' AS new_name", "'dx' AS digest").distinct()
    return V.picture_set_check(base.drop("swap"), new, swaps, base.where("pos % 10 = 0").select("doc_id", "name", "digest"))


@query("f12_minimality", """
SELECT p_partkey AS id FROM part WHERE p_partkey % 3 < 2""")
def f12(spark, sf):
    rows = table(spark, sf, "part").selectExpr(
        "p_partkey AS id", "p_name AS old",
        "CASE p_partkey % 3 WHEN 0 THEN concat(split_part(p_name, ' ', 1), ' x') WHEN 1 THEN concat('y ', split_part(p_name, ' ', 2)) ELSE 'x y' END AS new")
    return V.minimality(rows).select("id")


@query("f13_view_compare", """
SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'identical' WHEN 1 THEN 'identical_except_field_results' ELSE 'different' END AS status FROM documents""")
def f13(spark, sf):
    o, c = V.FIELD_OPEN, V.FIELD_CLOSE
    rows = table(spark, sf, "documents").selectExpr(
        "doc_id AS id", f"concat('Intro {o}12{c} then ', text, ' end {o}7{c}.') AS marked",
        "CASE doc_id % 4 WHEN 0 THEN concat('Intro 12  then ', text, ' end 7.') WHEN 1 THEN concat('Intro 345 then ', text, ' end 8.') "
        "WHEN 2 THEN concat('Intro 12 then X', text, ' end 7.') ELSE concat('Intro 12 then ', text) END AS actual")
    return V.view_compare(rows)


@query("f14_diff_hunks", f"""WITH {MARKED_SQL},
w AS (SELECT id, k, old AS o, new AS w_new, t[i] AS token, i = 1 AS head, i = len(t) AS last, CAST(coalesce(sum(length(t[i])) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS pos
  FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM (SELECT id, k, old, new, regexp_extract_all(old, '[^ ]+| ') AS t FROM d))),
s AS (SELECT *, length(token) AS size, pos + CASE k WHEN 2 THEN CASE WHEN head THEN 0 ELSE 1 END WHEN 3 THEN length(substr(o, 1, pos)) - length(replace(substr(o, 1, pos), '.', '')) WHEN 6 THEN CASE WHEN head THEN 0 ELSE -1 END ELSE 0 END AS b,
  CASE k WHEN 0 THEN 2 WHEN 2 THEN CASE WHEN head AND last THEN 2 ELSE 1 END WHEN 3 THEN length(token) - length(replace(token, '.', '')) WHEN 6 THEN CASE WHEN head THEN -1 ELSE 1 END ELSE 0 END AS more
  FROM w WHERE CASE k WHEN 0 THEN last WHEN 1 THEN contains(token, ',') WHEN 3 THEN contains(token, '.') ELSE head OR last END),
h AS (SELECT id, pos AS old_start, pos + size AS old_end, b AS new_start, b + size + more AS new_end, o AS old, w_new AS new FROM s)
SELECT id, CAST(old_start AS INTEGER) AS old_start, CASE WHEN old_end = old_start THEN 'insert' WHEN new_end = new_start THEN 'delete' ELSE 'replace' END AS op,
 array_to_string(list_reverse(list_slice(list_reverse(regexp_extract_all(substr(old, 1, old_start), '[^ ]+')), 1, 8)), ' ') AS before,
 substr(old, old_start + 1, old_end - old_start) AS old, substr(new, new_start + 1, new_end - new_start) AS new,
 array_to_string(list_slice(regexp_extract_all(substr(old, old_end + 1), '[^ ]+'), 1, 8), ' ') AS after FROM h""")
def f14(spark, sf):
    return V.diff_hunks(marked_pairs(spark, sf))


@query("f15_snapshot_diff", """
SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 'removed' ELSE 'changed' END AS kind, p_size AS old, CASE WHEN p_size % 10 <> 0 THEN p_size + 1 END AS new FROM part WHERE p_size % 10 IN (0, 1)
UNION ALL SELECT p_partkey + 1000000, 'added', NULL, p_size FROM part WHERE p_size % 10 = 2""")
def f15(spark, sf):
    # new parts are parts of their own even where a million further on there is a part already
    key = lambda place, new: f"named_struct('part', p_partkey + {place}, 'new', {new}) AS key"
    p = table(spark, sf, "part")
    after = p.where("p_size % 10 <> 0").selectExpr(key(0, "false"), "cast(if(p_size % 10 = 1, p_size + 1, p_size) as int) AS p_size").unionByName(
        p.where("p_size % 10 = 2").selectExpr(key(1000000, "true"), "p_size"))
    return V.snapshot_diff(p.selectExpr(key(0, "false"), "p_size"), after, "key", "p_size").select(F.col("key.part").alias("p_partkey"), "kind", "old", "new")


@query("f16_lockstep", "SELECT p_name, count(DISTINCT p_brand) AS versions, min(p_brand) AS least, max(p_brand) AS greatest FROM part GROUP BY p_name HAVING versions > 1")
def f16(spark, sf):
    return V.lockstep_check(table(spark, sf, "part"), "p_name", "p_brand")


@query("f17_major_change", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN false ELSE o_orderkey % 12 <> o_custkey % 12 END AS major FROM orders")
def f17(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", V.major_change(
        F.expr("concat(if(o_orderkey % 5 = 0, 'v', ''), o_orderkey % 12, '.4')"), F.expr("concat(o_custkey % 12, '.0.1')")).alias("major"))


@query("f18_dependents", """
WITH w AS (SELECT DISTINCT 'pkg-' || (s_suppkey * 3) AS key FROM supplier)
SELECT 'pkg-' || c_custkey AS item FROM customer WHERE 'pkg-' || c_custkey IN (SELECT key FROM w)
UNION SELECT 'pkg-' || c_custkey FROM customer WHERE 'pkg-' || (c_custkey + 1) IN (SELECT key FROM w)""")
def f18(spark, sf):
    items = table(spark, sf, "customer").selectExpr(
        "concat('Pkg_', c_custkey) AS name",
        "array(concat('PKG.', c_custkey + 1, ' >=1.0; python_version > \"3\"'), concat('pkg-', c_custkey + 2, '; extra == \"dev\"')) AS requires")
    return V.dependents(items, table(spark, sf, "supplier").selectExpr("concat('pkg-', s_suppkey * 3) AS name"))


@query("f19_check_rollup", """
SELECT user_id AS doc_id, CASE WHEN count_if(value > 60) > 0 THEN 'FAIL' ELSE 'PASS' END AS overall, count_if(value <= 30) AS pass, count_if(value > 30 AND value <= 60) AS warn, count_if(value > 60) AS fail FROM events GROUP BY user_id""")
def f19(spark, sf):
    checks = table(spark, sf, "events").selectExpr(
        "user_id AS doc_id", "event_type AS name", "CASE WHEN value > 60 THEN 'FAIL' WHEN value > 30 THEN 'WARN' ELSE 'PASS' END AS status")
    return V.check_rollup(checks)


@query("f20_untracked_formatting", f"""
SELECT doc_id, para_idx AS view_idx, CASE WHEN (doc_id + para_idx) % 5 = 0 THEN 'bold,italic' ELSE '' END AS flags, (doc_id + para_idx) % 6 = 0 AS props_changed
FROM ({LINES_SQL}) WHERE (doc_id + para_idx) % 5 = 0 OR (doc_id + para_idx) % 6 = 0""")
def f20(spark, sf):
    rows = paragraphs(table(spark, sf, "documents")).withColumnRenamed("para_idx", "view_idx")
    base = rows.selectExpr("doc_id", "view_idx", "text", "array('italic', 'sup') AS flags", "named_struct('align', 'left') AS props")
    new = rows.selectExpr("doc_id", "view_idx", "text", "if((doc_id + view_idx) % 5 = 0, array('bold', 'sup'), array('sup', 'italic')) AS flags",
                          "named_struct('align', if((doc_id + view_idx) % 6 = 0, 'right', 'left')) AS props")
    return V.untracked_formatting(base, new).withColumn("flags", F.array_join("flags", ","))


@query("f21_intended_replacements", """
WITH d AS (SELECT doc_id, text, substr(text, 1, 12) AS a, (length(text) - length(replace(text, substr(text, 1, 12), ''))) / length(substr(text, 1, 12)) AS n FROM documents),
e AS (SELECT *, CASE WHEN n = 1 THEN replace(text, a, 'NEW') ELSE text END AS t2 FROM d)
SELECT doc_id, CAST(CASE WHEN n = 1 THEN 0 ELSE 1 END + CASE WHEN contains(t2, 'NEW') AND (length(t2) - length(replace(t2, 'NEW', ''))) / 3 = 1 THEN 0 ELSE 1 END AS INTEGER) AS not_found_once,
  n = 1 AND (length(t2) - length(replace(t2, 'NEW', ''))) / 3 = 1 AND doc_id % 3 <> 0 AS as_intended FROM e""")
def f21(spark, sf):
    rows = table(spark, sf, "documents").selectExpr(
        "doc_id", "text AS old", "if(doc_id % 3 = 0, text, replace(replace(text, substr(text, 1, 12), 'NEW'), 'NEW', 'DONE')) AS new",
        "array(named_struct('old', substr(text, 1, 12), 'new', 'NEW'), named_struct('old', 'NEW', 'new', 'DONE')) AS intended")
    return V.intended_replacements(rows)


REVISIONS = """SELECT l_suppkey AS doc_id, CASE WHEN l_linestatus = 'O' THEN 'ins' ELSE 'rPrChange' END AS kind, concat('A', l_linenumber % 4) AS author,
  concat('', year(l_shipdate)) AS date, l_orderkey * 10 + l_linenumber AS rev_id, l_quantity, l_discount, l_extendedprice FROM lineitem"""


@query("f22_new_revisions", f"""
WITH r AS (SELECT DISTINCT * EXCLUDE (l_quantity, l_discount, l_extendedprice), l_quantity < 3 AS is_base FROM ({REVISIONS})), b AS (SELECT * FROM r WHERE is_base),
f AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = r.doc_id AND b.kind = r.kind AND b.author = r.author AND b.date = r.date AND b.rev_id = r.rev_id)),
k AS (SELECT f.*, EXISTS (SELECT 1 FROM b WHERE b.doc_id = f.doc_id AND b.author = f.author AND b.date = f.date) AS seen, EXISTS (SELECT 1 FROM b WHERE b.doc_id = f.doc_id AND b.author = f.author) AS person FROM f)
SELECT doc_id, count(*) AS revisions, count_if(NOT person AND author <> 'A1') AS unexpected_author, count_if(kind LIKE '%Change' AND NOT seen) AS property_changes,
  count(DISTINCT CASE WHEN NOT seen THEN date END) AS dates FROM k GROUP BY doc_id""")
def f22(spark, sf):
    rows = spark.sql(REVISIONS.replace("lineitem", "{li}"), li=table(spark, sf, "lineitem"))
    rows = rows.selectExpr("doc_id", "kind", "author", "date", "rev_id", "l_quantity < 3 AS is_base").distinct()
    return V.new_revisions(rows.where("is_base").drop("is_base"), rows.drop("is_base"), "A1")

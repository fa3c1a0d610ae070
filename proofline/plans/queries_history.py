"""Named queries: histories, integrity and threads."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofline.operators import history as H
from proofline.plans.catalog import query, table
from proofline.plans.queries_units import LINES_SQL

# Events read as the histories of assets: the user is the asset.
EVENT_FIELDS = """user_id AS asset, event_id AS seq, ts AS utc,
  CASE WHEN event_id < 150 AND event_type <> 'error' THEN 'imported' WHEN event_type = 'signup' THEN 'edited' WHEN event_type = 'error' THEN 'check_failed'
       WHEN event_type = 'click' THEN 'checked' WHEN event_type = 'purchase' THEN 'updated' ELSE 'merged' END AS event,
  CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 3 = 0 THEN 'current' ELSE 'update_available' END AS status,
  CASE WHEN event_id % 50 <> 1 THEN 'sorry' END AS error, CASE WHEN event_id % 40 <> 2 THEN repeat('ab', 20) ELSE 'ab' END AS commit,
  repeat('0a', 32) AS sha256, CASE WHEN event_id % 60 <> 3 THEN repeat('1b', 32) END AS content_sha256"""


def asset_events(spark, sf):
    return spark.sql(f"SELECT {EVENT_FIELDS} FROM {{events}}", events=table(spark, sf, "events"))


FOLD_SQL = f"""WITH e AS (SELECT {EVENT_FIELDS} FROM events), f AS (SELECT asset, arg_min(utc, seq) AS added_at, min(utc) FILTER (event = 'imported') AS first_imported_at,
 max(utc) FILTER (event IN ('checked', 'check_failed')) AS last_check_attempt_at, max(utc) FILTER (event = 'checked') AS last_checked_at,
 max(utc) FILTER (event IN ('edited', 'updated', 'merged')) AS last_updated_at, arg_max(status, seq) FILTER (event IN ('checked', 'check_failed')) AS last_result,
 last(content_sha256 ORDER BY seq) FILTER (event NOT IN ('checked', 'check_failed')) AS content_sha256 FROM e GROUP BY asset)"""


@query("g1_history_fold", FOLD_SQL + " SELECT * FROM f")
def g1(spark, sf):
    return H.history_fold(asset_events(spark, sf).withColumn("result", F.col("status")))


@query("g2_history_errors", FOLD_SQL + """, o AS (SELECT *, lag(utc) OVER (PARTITION BY asset ORDER BY seq) AS before, row_number() OVER (PARTITION BY asset ORDER BY seq) AS r FROM (SELECT * REPLACE (CASE WHEN seq % 70 = 5 THEN utc - INTERVAL 2 DAY ELSE utc END AS utc) FROM e)),
p AS (SELECT asset, unnest(list_filter([CASE WHEN r = 1 AND event <> 'imported' THEN 'history does not start with a registration' END, CASE WHEN r > 1 AND event = 'imported' THEN 'registration repeated' END,
  CASE WHEN utc < before THEN 'not chronological' END, CASE WHEN event = 'checked' AND length(commit) < 40 THEN 'check without a complete result' END,
  CASE WHEN event = 'check_failed' AND error IS NULL THEN 'failed check without an error' END, CASE WHEN event NOT IN ('checked', 'check_failed') AND content_sha256 IS NULL THEN 'content event without a digest' END], lambda x: x IS NOT NULL)) AS problem FROM o)
SELECT asset, problem, count(*) AS n FROM p GROUP BY ALL UNION ALL SELECT DISTINCT asset, 'stored state disagrees with history', 1 FROM e WHERE asset % 10 = 0""")
def g2(spark, sf):
    events = asset_events(spark, sf).withColumn("utc", F.expr("if(seq % 70 = 5, utc - INTERVAL 2 DAY, utc)"))
    states = H.history_fold(events.withColumn("result", F.col("status"))).withColumn(
        "last_result", F.expr("if(asset % 10 = 0, 'tampered', last_result)"))
    return H.history_errors(events, states, F.floor(F.col("seq") / 1000))


@query("g3_asset_status", """
SELECT c_custkey AS asset, CASE WHEN c_custkey % 5 = 0 THEN 'local' ELSE 'imported' END AS origin,
 CASE WHEN c_custkey % 7 = 0 THEN 'error' WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 2 = 0 THEN 'current' ELSE 'update_available' END WHEN c_custkey % 5 = 0 THEN 'local' ELSE 'never_checked' END AS upstream,
 CASE WHEN c_custkey % 11 = 0 THEN 'missing' WHEN c_custkey % 4 = 1 THEN 'unrecorded' WHEN c_custkey % 5 <> 0 AND c_custkey % 6 = 2 THEN 'customized' ELSE 'recorded' END AS local FROM customer""")
def g3(spark, sf):
    c = table(spark, sf, "customer")
    content = "concat('d', c_custkey)"
    assets = c.selectExpr("c_custkey AS asset", "if(c_custkey % 5 = 0, 'local', 'imported') AS origin", f"{content} AS content_sha256",
                          f"CASE WHEN c_custkey % 5 <> 0 THEN if(c_custkey % 6 = 2, 'other', {content}) END AS source_sha256")
    observed = c.where("c_custkey % 11 <> 0").selectExpr("c_custkey AS asset", f"if(c_custkey % 4 = 1, 'edited', {content}) AS sha256")
    checks = c.where("c_custkey % 3 = 0 OR c_custkey % 7 = 0").selectExpr(
        "c_custkey AS asset", "if(c_custkey % 7 = 0, 'error', 'ok') AS status",
        f"if(c_custkey % 2 = 0, if(c_custkey % 6 = 2, 'other', {content}), 'newer') AS sha256")
    return H.asset_status(assets, observed, checks)


@query("g4_tracking_errors", """
SELECT p_partkey AS asset, CASE WHEN p_size % 10 = 0 THEN 'no folder' WHEN p_size % 10 = 1 THEN 'no record' ELSE 'unrecorded changes' END AS problem FROM part WHERE p_size % 10 < 3""")
def g4(spark, sf):
    p = table(spark, sf, "part")
    return H.tracking_errors(p.where("p_size % 10 <> 1").selectExpr("p_partkey AS asset", "p_name AS sha256"),
                             p.where("p_size % 10 <> 0").selectExpr("p_partkey AS asset", "if(p_size % 10 = 2, 'x', p_name) AS sha256"))


# Events read as an append-only operation log.
LEDGER_FIELDS = """event_id AS pos, event_id AS seq, ts AS utc, event_type AS event, CASE event_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'pending' WHEN 2 THEN 'complete' WHEN 3 THEN 'failed' ELSE 'complete' END AS status,
  CASE event_id % 5 WHEN 2 THEN event_id - 2 WHEN 3 THEN event_id - 2 END AS ref, CASE WHEN user_id % 3 = 0 THEN NULL ELSE concat('V', user_id) END AS version,
  CASE WHEN user_id % 4 = 0 THEN 'r' END AS reason, CAST(NULL AS VARCHAR(9)) AS figure, CAST(NULL AS VARCHAR(9)) AS figure_version"""


def ledger(spark, sf):
    return spark.sql(f"SELECT {LEDGER_FIELDS} FROM {{events}}", events=table(spark, sf, "events"))


OPEN_SQL = f"""WITH l AS (SELECT {LEDGER_FIELDS} FROM events)
SELECT seq, event, 'interrupted' AS issue FROM l WHERE status = 'pending' AND NOT EXISTS (SELECT 1 FROM l r WHERE r.status <> 'pending' AND r.event = l.event AND r.ref = l.seq)
UNION ALL SELECT seq, event, 'failed' FROM l WHERE status = 'failed' AND NOT EXISTS (SELECT 1 FROM l d WHERE d.status = 'complete' AND d.pos > l.pos AND d.event = l.event AND d.version IS NOT DISTINCT FROM l.version AND d.reason IS NOT DISTINCT FROM l.reason)"""


@query("g5_open_operations", OPEN_SQL)
def g5(spark, sf):
    return H.open_operations(ledger(spark, sf)).select("seq", "event", "issue")


@query("g6_manifest_verify", """
SELECT 'f' || p_partkey AS path, CASE p_size % 10 WHEN 0 THEN 'missing' WHEN 1 THEN 'mismatched' ELSE 'unlisted' END AS problem FROM part WHERE p_size % 10 IN (0, 1, 2)""")
def g6(spark, sf):
    p = table(spark, sf, "part").selectExpr("concat('f', p_partkey) AS path", "sha2(p_name, 256) AS sha256", "p_size")
    named = p.where("p_size % 10 <> 2")
    observed = p.where("p_size % 10 <> 0").selectExpr("path", "if(p_size % 10 = 1, 'x', sha256) AS sha256")
    return H.manifest_verify(named.unionByName(named).select("path", "sha256"), observed).select("path", "problem")


@query("g6_manifest_verdict", "SELECT CASE WHEN count_if(p_size % 10 IN (0, 1)) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, count_if(p_size % 10 IN (0, 1, 2)) AS problems FROM part")
def g6_verdict(spark, sf):
    return H.manifest_verdict(g6(spark, sf))


@query("g7_find_twins", """
WITH f AS (SELECT doc_id AS path, sha256(text) AS sha256, source AS preference, row_number() OVER (PARTITION BY text ORDER BY source, doc_id) AS r, count(*) OVER (PARTITION BY text) AS n FROM documents)
SELECT a.path, b.path AS twin FROM f a JOIN f b ON a.sha256 = b.sha256 AND b.r = CASE WHEN a.r = 1 THEN 2 ELSE 1 END""")
def g7(spark, sf):
    files = table(spark, sf, "documents").select(
        F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha256"), F.col("source").alias("preference"))
    return H.find_twins(files).select("path", "twin")


@query("g8_index_disagreements", """
WITH i AS (SELECT c_custkey AS project, 'V' || (c_custkey % 9) AS version, CASE WHEN c_custkey % 10 <> 0 THEN 's' || c_custkey END AS sha256 FROM customer),
m AS (SELECT c_custkey AS project, CASE WHEN c_custkey % 6 = 0 THEN 2 ELSE 1 END AS n, CASE WHEN c_custkey % 7 = 0 THEN 'z' ELSE 's' || c_custkey END AS sha FROM customer WHERE c_custkey % 13 <> 0)
SELECT i.project, 'version index' AS problem FROM i LEFT JOIN m USING (project) WHERE i.sha256 IS NOT NULL AND NOT coalesce(n = 1 AND sha = i.sha256, false)
UNION ALL SELECT i.project, 'no current file named' FROM i JOIN m USING (project) WHERE i.sha256 IS NULL
UNION ALL SELECT project, 'package version' FROM i WHERE sha256 IS NOT NULL AND project % 4 = 0 AND version <> 'V' || (project % 8)
UNION ALL SELECT project, 'package copy' FROM i WHERE sha256 IS NOT NULL AND project % 4 = 0 AND project % 16 = 0""")
def g8(spark, sf):
    c = table(spark, sf, "customer")
    index = c.selectExpr("c_custkey AS project", "concat('V', c_custkey % 9) AS version", "CASE WHEN c_custkey % 10 <> 0 THEN concat('s', c_custkey) END AS sha256", "concat('P/', c_custkey) AS path")
    marked = c.where("c_custkey % 13 <> 0").selectExpr(
        "c_custkey AS project", "explode(if(c_custkey % 6 = 0, array('current', 'current'), array('current', 'released'))) AS role",
        "if(c_custkey % 7 = 0, 'z', concat('s', c_custkey)) AS sha256", "concat('p/', c_custkey) AS path")
    package = c.where("c_custkey % 4 = 0").selectExpr("c_custkey AS project", "'current' AS role", "concat('V', c_custkey % 8) AS version",
                                                     "if(c_custkey % 16 = 0, 'q', concat('s', c_custkey)) AS sha256")
    return H.index_disagreements(index, marked, package)


@query("g9_next_number", """
SELECT project, max(number) + 1 AS next, count(DISTINCT number) AS taken FROM (SELECT user_id AS project, event_id % 100 AS number FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, event_id % 120 FROM events WHERE event_type = 'view') GROUP BY project""")
def g9(spark, sf):
    e = table(spark, sf, "events")
    return H.next_number(e.where("event_type = 'click'").selectExpr("user_id AS project", "event_id % 100 AS number"),
                         e.where("event_type = 'view'").selectExpr("user_id AS project", "event_id % 120 AS number"))


@query("g10_protected_refs", """
SELECT DISTINCT project, path FROM (SELECT p_size AS project, unnest(['dir/' || p_partkey || '.md', 'say "hi".txt', 'x\\y' || p_partkey % 3]) AS path FROM part)""")
def g10(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_size").alias("project"), F.expr(
        "to_json(named_struct('a.key', named_struct('path', concat('dir/', p_partkey, '.md'), 'n', 1), "
        "'l', array('say \"hi\".txt', p_brand), 'w', concat('x\\\\y', p_partkey % 3)))").alias("body"))
    return H.protected_refs(rows).select("project", "path")


ARCHIVE_SQL = """WITH c AS (SELECT p_size AS project, p_partkey AS ord, CASE p_partkey % 4 WHEN 0 THEN 'a/b' || p_partkey % 3 WHEN 1 THEN 'a/b' || p_partkey % 3 || '/c' || p_partkey % 5 WHEN 2 THEN 'z' || p_partkey % 9 ELSE 'q/r/s' || p_partkey % 7 END AS key FROM part),
k AS (SELECT DISTINCT s_suppkey % 50 + 1 AS project, CASE s_suppkey % 3 WHEN 0 THEN 'a/b1/c2' WHEN 1 THEN 'z3' ELSE 'q/r/s1/t' END AS key FROM supplier),
b AS (SELECT c.*, CASE WHEN EXISTS (SELECT 1 FROM k WHERE k.project = c.project AND k.key = c.key) THEN 'named by an index' WHEN EXISTS (SELECT 1 FROM k WHERE k.project = c.project AND starts_with(k.key, c.key || '/')) THEN 'contains a named path' END AS blocked FROM c)"""


@query("g11_archive_plan")
def g11(spark, sf):
    candidates = table(spark, sf, "part").selectExpr(
        "p_size AS project", "p_partkey AS ord", "CASE p_partkey % 4 WHEN 0 THEN concat('./A/b', p_partkey % 3) WHEN 1 THEN concat('a/b', p_partkey % 3, '/c', p_partkey % 5) "
        "WHEN 2 THEN concat('z', p_partkey % 9, '/') ELSE concat('q\\\\r/s', p_partkey % 7) END AS path")
    protected = table(spark, sf, "supplier").selectExpr("cast(s_suppkey % 50 + 1 as int) AS project", "CASE s_suppkey % 3 WHEN 0 THEN 'a/b1/c2' WHEN 1 THEN 'z3' ELSE 'q/r/s1/t' END AS key")
    return H.archive_plan(candidates, protected)


@query("g11_archive_blocked", ARCHIVE_SQL + " SELECT project, ord, blocked AS result FROM b WHERE blocked IS NOT NULL")
def g11_blocked(spark, sf):
    return g11(spark, sf).where("result IN ('named by an index', 'contains a named path')").select("project", "ord", "result")


@query("g12_figure_status", """
WITH f AS (SELECT p_partkey AS figure, 'V' || (1 + p_size % 3) AS current FROM part), v AS (SELECT p_partkey AS figure, unnest([1, 2]) AS ord, p_size FROM part),
w AS (SELECT figure, ord, 'V' || ord AS version, CASE WHEN p_size % 7 = 0 THEN '' ELSE 'd' || (figure * 2 + ord) END AS sha FROM v), p AS (SELECT DISTINCT 'd' || (o_orderkey * 3) AS sha FROM orders)
SELECT f.figure, f.current, CASE WHEN w.figure IS NULL THEN 'not registered' WHEN w.sha = '' THEN 'not recorded' WHEN w.sha IN (SELECT sha FROM p) THEN 'match' ELSE 'not_shown' END AS state,
 CASE WHEN w.sha <> '' AND w.sha NOT IN (SELECT sha FROM p) THEN (SELECT arg_min(o.version, o.ord) FROM w o WHERE o.figure = f.figure AND o.version <> f.current AND o.sha IN (SELECT sha FROM p)) END AS shown_version
FROM f LEFT JOIN w ON w.figure = f.figure AND w.version = f.current""")
def g12(spark, sf):
    p = table(spark, sf, "part")
    figures = p.selectExpr("p_partkey AS figure", "concat('V', 1 + p_size % 3) AS current")
    versions = p.selectExpr("p_partkey AS figure", "p_size", "explode(array(1, 2)) AS ord").selectExpr(
        "figure", "concat('V', ord) AS version", "ord", "if(p_size % 7 = 0, '', concat('d', figure * 2 + ord)) AS sha256")
    return H.figure_status(figures, versions, table(spark, sf, "orders").selectExpr("concat('d', o_orderkey * 3) AS sha256"))


@query("g13_threads", """
WITH c AS (SELECT conv_id AS doc_id, turn AS id, CASE WHEN turn % 3 = 1 THEN turn - 1 WHEN turn % 3 = 2 THEN turn + 90 END AS parent, role AS author FROM conversations),
r AS (SELECT c.* , EXISTS (SELECT 1 FROM c p WHERE p.doc_id = c.doc_id AND p.id = c.parent) AS reply FROM c)
SELECT t.doc_id, t.id, t.author, t.id % 2 = 0 AS done, count(x.id) AS replies, max(x.id) AS last_reply FROM r t LEFT JOIN r x ON x.reply AND x.doc_id = t.doc_id AND x.parent = t.id WHERE NOT t.reply GROUP BY ALL""")
def g13(spark, sf):
    return H.threads(table(spark, sf, "conversations").selectExpr(
        "conv_id AS doc_id", "turn AS id", "CASE WHEN turn % 3 = 1 THEN turn - 1 WHEN turn % 3 = 2 THEN turn + 90 END AS parent", "role AS author", "turn % 2 = 0 AS done"))


@query("g13_thread_comments", """
WITH RECURSIVE c AS (SELECT conv_id AS doc_id, turn AS id, CASE WHEN turn % 3 = 1 THEN turn - 1 WHEN turn % 3 = 2 THEN turn + 90 END AS parent, role AS author, text FROM conversations),
b AS (SELECT doc_id, id AS thread, id FROM c WHERE NOT EXISTS (SELECT 1 FROM c p WHERE p.doc_id = c.doc_id AND p.id = c.parent) UNION ALL SELECT c.doc_id, b.thread, c.id FROM c JOIN b ON c.doc_id = b.doc_id AND c.parent = b.id)
SELECT doc_id, thread, id, parent, author, sha256(text) AS text FROM b JOIN c USING (doc_id, id)""")
def g13_comments(spark, sf):
    comments = table(spark, sf, "conversations").selectExpr(
        "conv_id AS doc_id", "turn AS id", "CASE WHEN turn % 3 = 1 THEN turn - 1 WHEN turn % 3 = 2 THEN turn + 90 END AS parent", "role AS author", "text")
    return H.thread_comments(comments).withColumn("text", F.sha2("text", 256))


@query("g14_thread_ids", """
WITH RECURSIVE c AS (SELECT conv_id AS doc_id, turn AS id, CASE WHEN turn > 0 THEN turn - 1 - (conv_id % 2) * (turn % 2) END AS parent FROM conversations),
b AS (SELECT doc_id, id AS root, id FROM c WHERE id % 3 = 0 UNION ALL SELECT c.doc_id, b.root, c.id FROM c JOIN b ON c.doc_id = b.doc_id AND c.parent = b.id)
SELECT doc_id, root, id FROM b""")
def g14(spark, sf):
    comments = table(spark, sf, "conversations").selectExpr("conv_id AS doc_id", "turn AS id", "CASE WHEN turn > 0 THEN turn - 1 - (conv_id % 2) * (turn % 2) END AS parent")
    return H.thread_ids(comments, comments.where("id % 3 = 0").select("doc_id", "id"))


@query("g15_anchor_texts", f"""
SELECT doc_id, CAST(1 AS INTEGER) AS id, sha256(trim(string_agg(CASE WHEN para_idx = 0 THEN substr(text, 11) WHEN para_idx = n - 1 THEN substr(text, 1, 10) ELSE text END, chr(10) ORDER BY para_idx))) AS digest
FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM ({LINES_SQL})) WHERE n > 1 GROUP BY doc_id""")
def g15(spark, sf):
    docs = table(spark, sf, "documents")
    runs = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("para_idx", "line")).selectExpr(
        "doc_id", "para_idx", "inline(array(named_struct('run_idx', 0, 'text', substr(line, 1, 10)), named_struct('run_idx', 1, 'text', substr(line, 11))))")
    ranges = docs.selectExpr("doc_id", "1 AS id", "0 AS start_para", "1 AS start_run", "size(split(text, '\\n')) - 1 AS end_para", "1 AS end_run")
    return H.anchor_texts(runs, ranges).select("doc_id", "id", F.sha2("anchor", 256).alias("digest"))


BLOCKED = "concat('Journal AB here', chr(10), '<!-- gen:status:start -->', chr(10), text, chr(10), 'AB inside', chr(10), '<!-- gen:status:end -->', chr(10), text, chr(10), 'XAB and AB', doc_id, ' then AB.')"


@query("g16_lines_outside_blocks", """
SELECT doc_id, CAST(1 AS INTEGER) AS line_no, 'Journal AB here' AS line FROM documents
UNION ALL SELECT doc_id, CAST(2 * len(string_split(text, chr(10))) + 5 AS INTEGER), 'XAB and AB' || doc_id || ' then AB.' FROM documents
UNION ALL SELECT doc_id, CAST(4 + n + para_idx + 1 AS INTEGER), text FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM (LINES)) WHERE regexp_matches(text, '(^|[^A-Za-z0-9])AB([^A-Za-z0-9]|$)')""".replace("LINES", LINES_SQL))
def g16(spark, sf):
    rows = table(spark, sf, "documents").selectExpr("doc_id", f"{BLOCKED} AS text")
    return H.stale_names(rows, "AB")


@query("g17_scrub_paths", """
SELECT o_orderkey, 'at ./sub/' || o_custkey || '.md and ~\\notes\\x and /srv/project-old/y' AS text FROM orders""")
def g17(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "concat('at /srv/project/sub/', o_custkey, '.md and C:\\\\\\\\Users\\\\ann\\\\notes\\\\x and /srv/project-old/y') AS text")
    return rows.select("o_orderkey", H.scrub_paths("text", {"/srv/project": ".", "C:\\Users\\ann": "~"}).alias("text"))


@query("g18_unregistered_files", """
SELECT o_custkey AS project, 'f' || o_orderkey AS path, o_orderdate > TIMESTAMP '1998-01-01' AND o_custkey % 4 <> 0 AS newer_than_current FROM orders WHERE o_orderkey % 5 >= 2""")
def g18(spark, sf):
    o = table(spark, sf, "orders")
    observed = o.selectExpr("o_custkey AS project", "concat('f', o_orderkey) AS path", "concat('d', o_orderkey) AS sha256", "o_orderdate AS modified")
    known = o.where("o_orderkey % 5 < 2").selectExpr("o_custkey AS project", "concat(if(o_orderkey % 5 = 0, 'F', 'other'), o_orderkey) AS path",
                                                     "if(o_orderkey % 5 = 1, concat('d', o_orderkey), 'zz') AS sha256")
    current = table(spark, sf, "customer").where("c_custkey % 4 <> 0").selectExpr("c_custkey AS project", "timestamp_ntz'1998-01-01 00:00:00' AS modified")
    return H.unregistered_files(observed, known, current)


@query("g19_embedded_assets", """
SELECT p_size AS project, p_partkey AS figure, 'V1' AS version, 'image' || p_partkey AS target, CASE WHEN p_partkey % 3 = 0 THEN 'missing' ELSE 'mismatched' END AS problem FROM part WHERE p_partkey % 2 = p_size % 2 AND p_partkey % 3 < 2""")
def g19(spark, sf):
    p = table(spark, sf, "part")
    wanted = p.selectExpr("p_size AS project", "p_partkey AS figure", "'V1' AS version", "concat('image', p_partkey) AS target", "concat('d', p_partkey) AS sha256",
                          "array(concat('M', p_partkey % 2), 'M9') AS used_in")
    parts = p.where("p_partkey % 3 <> 0").selectExpr("p_size AS project", "concat('image', p_partkey) AS target", "if(p_partkey % 3 = 1, 'x', concat('d', p_partkey)) AS sha256")
    current = p.selectExpr("p_size AS project", "concat('M', p_size % 2) AS version").distinct()
    return H.embedded_asset_check(wanted, parts, current)

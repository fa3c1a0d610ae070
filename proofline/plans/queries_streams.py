"""Named queries: streams replayed over the whole event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofline.plans.catalog import query, table
from proofline.plans.queries_history import EVENT_FIELDS, FOLD_SQL, LEDGER_FIELDS
from proofline.streaming import ledgers as S


def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query("k1_open_operations_stream", f"""
WITH l AS (SELECT {LEDGER_FIELDS} FROM events), t AS (SELECT *, epoch_us(utc) AS us FROM l),
w AS (SELECT least(max(us) FILTER (status = 'pending'), max(us) FILTER (status <> 'pending' AND ref IS NOT NULL), max(us) FILTER (status = 'failed'), max(us) FILTER (status = 'complete')) - 600000000 AS mark FROM t)
SELECT seq, event, 'interrupted' AS issue FROM t, w WHERE status = 'pending' AND us + 3600000000 < mark AND NOT EXISTS (
  SELECT 1 FROM t r WHERE r.status <> 'pending' AND r.event = t.event AND r.ref = t.seq AND r.us BETWEEN t.us AND t.us + 3600000000)
UNION ALL SELECT seq, event, 'failed' FROM t, w WHERE status = 'failed' AND us + 3600000000 < mark AND NOT EXISTS (
  SELECT 1 FROM t d WHERE d.status = 'complete' AND d.pos > t.pos AND d.event = t.event AND d.version IS NOT DISTINCT FROM t.version AND d.reason IS NOT DISTINCT FROM t.reason AND d.us BETWEEN t.us AND t.us + 3600000000)""")
def k1(spark, sf):
    rows = event_stream(spark, sf).selectExpr("event_id", "user_id", "event_type", "cast(ts as timestamp) AS ts")
    ledger = spark.sql(f"SELECT {LEDGER_FIELDS} FROM {{rows}}", rows=rows)
    return S.replay(S.open_operations_stream(ledger), "append", "open-operations").select("seq", "event", "issue")


@query("k2_history_fold_stream", FOLD_SQL + " SELECT * FROM f")
def k2(spark, sf):
    events = spark.sql(f"SELECT {EVENT_FIELDS} FROM {{rows}}", rows=event_stream(spark, sf)).withColumn("result", F.col("status"))
    return S.latest_per_key(S.replay(S.history_fold_stream(events), "update", "history-fold"), "asset")

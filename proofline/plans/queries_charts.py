"""Named queries: chart data preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofline.operators import charts as C
from proofline.plans.catalog import query, table


@query("h1_first_seen", "SELECT p_brand, min(p_partkey) AS first_seen FROM part GROUP BY p_brand")
def h1(spark, sf):
    return C.first_seen(table(spark, sf, "part"), "p_brand", "p_partkey")


@query("h2_explicit_order", """
WITH r AS (SELECT 'Brand#' || n_nationkey AS p_brand, n_nationkey AS position FROM nation), s AS (SELECT DISTINCT p_brand FROM part)
SELECT p_brand, position, CASE WHEN position IS NULL THEN 'missing from the order' WHEN s.p_brand IS NULL THEN 'not observed' END AS problem FROM s FULL JOIN r USING (p_brand)""")
def h2(spark, sf):
    requested = table(spark, sf, "nation").selectExpr("concat('Brand#', n_nationkey) AS p_brand", "n_nationkey AS position")
    return C.explicit_order(table(spark, sf, "part"), requested, "p_brand")


VOLCANO = "SELECT l_orderkey * 10 + l_linenumber AS id, l_discount * l_tax * 10 AS p, l_quantity / 10 - 2.5 AS effect FROM lineitem"


def points(spark, sf):
    rows = spark.sql(VOLCANO.replace("lineitem", "{li}"), li=table(spark, sf, "lineitem"))
    return C.volcano(rows, "p", "effect", 0.05, 1.0)


VOLCANO_SQL = f"""SELECT id, p, effect, CASE WHEN p > 0 AND p <= 1 THEN -log10(p) END AS score, CASE WHEN NOT (p > 0 AND p <= 1) THEN 'invalid' WHEN p < 0.05 AND effect >= 1.0 THEN 'up'
  WHEN p < 0.05 AND effect <= -1.0 THEN 'down' ELSE 'neutral' END AS grp FROM ({VOLCANO})"""


@query("h3_volcano", f"SELECT grp, count(*) AS n, round(sum(score), 4) AS score FROM ({VOLCANO_SQL}) GROUP BY grp")
def h3(spark, sf):
    return points(spark, sf).groupBy(F.col("group").alias("grp")).agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("score"))


@query("h3_volcano_labels", f"SELECT DISTINCT p, effect FROM (SELECT p, effect, id FROM ({VOLCANO_SQL}) WHERE grp IN ('up', 'down') ORDER BY p, id, effect LIMIT 25)")
def h3_labels(spark, sf):
    rows = points(spark, sf).withColumn("tie", F.struct("id", "effect"))
    return C.volcano_labels(rows, "p", 25, "tie").select("p", "effect").distinct()


CURVES = "SELECT l_returnflag AS curve, l_discount * 5 + (l_partkey % 97) / 200.0 AS fpr, least(1.0, l_quantity / 50 + l_tax) AS tpr, l_orderkey * 10 + l_linenumber AS row FROM lineitem"


@query("h4_roc_auc", f"""
WITH c AS (SELECT DISTINCT * FROM ({CURVES.replace('200.0', 'CAST(200.0 AS DOUBLE)')})), s AS (SELECT *, lag(fpr) OVER w AS x0, lag(tpr) OVER w AS y0, lag(fpr) OVER (PARTITION BY curve ORDER BY row, fpr, tpr) AS b FROM c WINDOW w AS (PARTITION BY curve ORDER BY fpr, row, tpr))
SELECT curve, round(sum((fpr - x0) * (tpr + y0) / 2), 6) AS auc, count(*) AS n, bool_and(coalesce(b <= fpr, true)) AS sorted_input FROM s GROUP BY curve""")
def h4(spark, sf):
    rows = spark.sql(CURVES.replace("lineitem", "{li}").replace("200.0", "CAST(200.0 AS DOUBLE)"), li=table(spark, sf, "lineitem")).distinct()
    return C.roc_auc(rows, "curve", "fpr", "tpr", "row").withColumn("auc", F.round("auc", 6))


@query("h5_dot_matrix", """
WITH s AS (SELECT p_brand, p_type, count(*) AS n, avg(p_retailprice) AS c, min(p_partkey) AS o FROM part GROUP BY ALL),
r AS (SELECT p_brand, row_number() OVER (ORDER BY min(o)) - 1 AS row_index FROM s GROUP BY p_brand), k AS (SELECT p_type, row_number() OVER (ORDER BY min(o)) - 1 AS column_index FROM s GROUP BY p_type)
SELECT p_brand, p_type, row_index, column_index, round(12 + 160 * sqrt(n / (SELECT max(n) FROM s)), 6) AS marker, round((c - (SELECT min(c) FROM s)) / ((SELECT max(c) FROM s) - (SELECT min(c) FROM s)), 6) AS shade FROM s JOIN r USING (p_brand) JOIN k USING (p_type)""")
def h5(spark, sf):
    rows = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(
        F.count("*").alias("n"), F.avg("p_retailprice").alias("c"), F.min("p_partkey").alias("o"))
    return C.dot_matrix(rows, "p_brand", "p_type", "n", "c", "o").select(
        "p_brand", "p_type", "row_index", "column_index", F.round("marker", 6).alias("marker"), F.round("shade", 6).alias("shade"))


@query("h6_marginal_hist", """
WITH s AS (SELECT l_returnflag AS g, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS total FROM lineitem GROUP BY g)
SELECT g, CAST(least(floor((l_extendedprice - lo) / (hi - lo) * 20), 19) AS INTEGER) AS bin, count(*) AS n, round(any_value(lo + least(floor((l_extendedprice - lo) / (hi - lo) * 20), 19) * ((hi - lo) / 20)), 4) AS left_edge, round(count(*) / any_value(total * ((hi - lo) / 20)), 10) AS density
FROM lineitem JOIN s ON g = l_returnflag GROUP BY g, bin""")
def h6(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr("l_returnflag AS g", "l_extendedprice AS v")
    return C.marginal_hist(rows, "g", "v", 20).withColumn("left_edge", F.round("left_edge", 4)).withColumn("density", F.round("density", 10))


@query("h7_paired", """
SELECT o_custkey AS id, min(o_totalprice) FILTER (o_orderstatus = 'F') AS first_value, min(o_totalprice) FILTER (o_orderstatus = 'P') AS second_value,
 CASE WHEN count_if(o_orderstatus = 'F') > 1 OR count_if(o_orderstatus = 'P') > 1 THEN 'duplicate' WHEN count_if(o_orderstatus = 'F') = 0 OR count_if(o_orderstatus = 'P') = 0 THEN 'incomplete' ELSE 'complete' END AS state FROM orders GROUP BY o_custkey""")
def h7(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_custkey AS id", "o_orderstatus AS c", "o_totalprice AS v")
    return C.paired(rows, "id", "c", "v", ("F", "P"))


@query("h8_box_stats", """
WITH q AS (SELECT l_returnflag AS g, count(*) AS total, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY g)
SELECT g, total, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, min(l_extendedprice) FILTER (l_extendedprice >= q1 - 1.5 * (q3 - q1)) AS whisker_low, max(l_extendedprice) FILTER (l_extendedprice <= q3 + 1.5 * (q3 - q1)) AS whisker_high
FROM q JOIN lineitem ON g = l_returnflag GROUP BY ALL""")
def h8(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr("l_returnflag AS g", "l_extendedprice AS v")
    out = C.box_stats(rows, "g", "v")
    return out.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")}).withColumn("total", F.col("total").cast("bigint"))


TREND_SQL = """WITH m AS (SELECT event_type, date_trunc('month', o_orderdate) AS month, count(*) AS amount FROM (SELECT o_orderpriority AS event_type, o_orderdate FROM orders) GROUP BY ALL),
s AS (SELECT event_type, unnest(generate_series(CAST(min(month) AS TIMESTAMP), (SELECT CAST(max(month) AS TIMESTAMP) FROM m), INTERVAL 1 MONTH)) AS month FROM m GROUP BY event_type),
t AS (SELECT s.event_type, CAST(s.month AS DATE) AS month, coalesce(amount, 0) AS amount, CAST(sum(coalesce(amount, 0)) OVER (PARTITION BY s.event_type ORDER BY s.month) AS BIGINT) AS running FROM s LEFT JOIN m ON m.event_type = s.event_type AND m.month = s.month)"""


def trend(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderpriority AS event_type", "o_orderdate")
    return C.cumulative_trend(rows, "event_type", "o_orderdate")


@query("h9_cumulative_trend", TREND_SQL + " SELECT event_type, strftime(month, '%Y-%m-%d') AS month, amount, running FROM t")
def h9(spark, sf):
    return trend(spark, sf).withColumn("month", F.date_format("month", "yyyy-MM-dd"))


@query("h10_event_marks", TREND_SQL + """ SELECT t.event_type, strftime(t.month, '%Y-%m-%d') AS month, n_name AS label, running
FROM t JOIN nation ON t.event_type = '1-URGENT' AND t.month = DATE '1993-01-01' + INTERVAL (n_nationkey * 5) MONTH""")
def h10(spark, sf):
    marks = table(spark, sf, "nation").selectExpr("'1-URGENT' AS event_type", "add_months(date'1993-01-01', n_nationkey * 5) AS month", "n_name AS label")
    return C.event_marks(trend(spark, sf), marks, "event_type").withColumn("month", F.date_format("month", "yyyy-MM-dd"))


@query("h11_composition", """
SELECT o_orderpriority, o_orderstatus, year(o_orderdate) AS y, count(*) AS n, grouping_id(o_orderpriority, o_orderstatus, year(o_orderdate)) AS level FROM orders
GROUP BY GROUPING SETS ((o_orderpriority, o_orderstatus, year(o_orderdate)), (o_orderpriority, o_orderstatus), (year(o_orderdate)), ())""")
def h11(spark, sf):
    rows = table(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    return C.composition(rows, "o_orderpriority", "o_orderstatus", "y")


@query("h12_stacked_base", """
WITH s AS (SELECT l_shipdate AS bar, l_linenumber AS segment, sum(l_quantity) AS height FROM lineitem GROUP BY ALL)
SELECT CAST(bar AS VARCHAR) AS bar, segment, height, coalesce(sum(height) OVER (PARTITION BY bar ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM s""")
def h12(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr("l_shipdate AS bar", "l_linenumber AS segment", "l_quantity AS v")
    return C.stacked_base(rows, "bar", "segment", "v").withColumn("bar", F.date_format("bar", "yyyy-MM-dd HH:mm:ss"))


GRID = "SELECT p_size AS series, p_partkey AS pos, CASE WHEN p_size % 3 = 0 THEN -p_partkey ELSE p_partkey END * CASE WHEN p_size % 7 = 0 AND p_partkey % 5 = 0 THEN 0 ELSE 1 END AS x, p_retailprice + p_partkey % 11 AS y FROM part"


@query("h13_interp_monotone", f"""
WITH g AS (SELECT series, pos, CAST(x AS DOUBLE) AS x, y FROM ({GRID})), d AS (SELECT series, CASE WHEN count(*) >= 2 AND bool_and(coalesce(x > b, true)) THEN 'rising' WHEN count(*) >= 2 AND bool_and(coalesce(x < b, true)) THEN 'falling' ELSE 'unsafe' END AS direction FROM (SELECT *, lag(x) OVER (PARTITION BY series ORDER BY pos) AS b FROM g) GROUP BY series),
t AS (SELECT o_orderkey AS target_id, CAST(1 + o_custkey % 50 AS INTEGER) AS series, CASE WHEN (1 + o_custkey % 50) % 3 = 0 THEN -1 ELSE 1 END * CAST(o_orderkey % 2500 AS DOUBLE) - 20.5 AS target FROM orders),
b AS (SELECT t.*, (SELECT max((x, y)) FROM g WHERE g.series = t.series AND x <= target) AS lo, (SELECT min((x, y)) FROM g WHERE g.series = t.series AND x >= target) AS hi FROM t)
SELECT target_id, b.series, target, direction, CASE WHEN direction <> 'unsafe' THEN round(CASE WHEN lo IS NULL THEN hi[2] WHEN hi IS NULL OR lo[1] = hi[1] THEN lo[2] ELSE lo[2] + (hi[2] - lo[2]) * (target - lo[1]) / (hi[1] - lo[1]) END, 6) END AS value FROM b JOIN d USING (series)""")
def h13(spark, sf):
    grid = spark.sql(GRID.replace("FROM part", "FROM {part}"), part=table(spark, sf, "part"))
    targets = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS target_id", "cast(1 + o_custkey % 50 as int) AS series",
        "CASE WHEN (1 + o_custkey % 50) % 3 = 0 THEN -1 ELSE 1 END * cast(o_orderkey % 2500 as double) - 20.5 AS target")
    return C.interp_monotone(targets, grid, "series", "target", "pos", "x", "y").withColumn("value", F.round("value", 6))


@query("h14_reference_values", """
SELECT o_orderkey, array_to_string(list_transform(list_sort(list_distinct(list_filter([round_even(m * 0.25 / q, 0) * q, round_even(m * 0.5 / q, 0) * q, round_even(m / q, 0) * q], lambda v: v > 0))), lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), ' ') AS vals
FROM (SELECT o_orderkey, o_totalprice AS m, pow(10.0, floor(log10(o_totalprice))) / 2 AS q FROM orders)""")
def h14(spark, sf):
    values = F.transform(C.reference_values(F.col("o_totalprice")), lambda v: v.cast("bigint").cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(values, " ").alias("vals"))


RAW = "CASE o_orderkey % 6 WHEN 0 THEN 'NaN' WHEN 1 THEN '' WHEN 2 THEN 'Infinity' WHEN 3 THEN 'abc' ELSE CAST(o_totalprice AS VARCHAR(20)) END"


@query("h15_qa_record", "SELECT count(*) AS rows_input, count_if(o_orderkey % 6 >= 4) AS rows_used, count_if(o_orderkey % 6 < 4) AS rows_excluded, 'x=raw' AS mapping, 'bins=20' AS parameters FROM orders")
def h15(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(f"{RAW} AS raw")
    return C.qa_record(rows, ["raw"], {"x": "raw"}, {"bins": "20"})

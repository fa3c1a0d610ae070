"""Findings of round 4: inputs that stopped a query, and work that must not outgrow its input."""

from __future__ import annotations

import random
import time
from collections import Counter
from datetime import datetime, timedelta

import duckdb
import pytest
from compare_engines import normal

from proofline.operators import layout as L
from proofline.plans import queries_versions as QV
from proofline.plans.catalog import EQUIVALENT_SQL
from proofline.streaming import ledgers


def _same_as_sql(name, frame, tables):
    """Rows of a query against its SQL over the given files."""
    connection = duckdb.connect()
    for table, path in tables.items():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    answer = connection.execute(EQUIVALENT_SQL[name])
    want = normal([c[0] for c in answer.description], answer.fetchall())
    got = normal(frame.columns, [tuple(r) for r in frame.collect()])
    assert got == want
    return got[0]


def test_replacements_in_an_empty_document(spark, tmp_path):
    """a document without text has an empty passage to replace, by whose length was divided."""
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(1, ""), (2, "abc"), (3, ""), (4, "abab" * 9), (5, "a text that holds NEW")], "doc_id bigint, text string").write.parquet(path)
    rows = _same_as_sql("f21_intended_replacements", QV.f21(spark, str(tmp_path)), {"documents": path})
    assert (False, 1, 2) in rows and (True, 2, 0) in rows


def test_stream_with_one_key_does_not_meet_itself_whole(spark, tmp_path):
    """15,000 failures of one key met each of its completions, however far away; minutes for each ten thousand."""
    start, gap, n = datetime(2024, 1, 1), 130, 15_000
    at = lambda minutes: start + timedelta(minutes=minutes)
    rows = [(2 * i, at(i), 2 * i, "a", "failed", None) for i in range(n)]
    rows += [(2 * i + 1, at(i + 0.5), 2 * i + 1, "a", "complete", None) for i in range(n) if i % 200 < gap]
    rows += [(10 * n + i, at(n + 5000), 10 * n + i, "z", status, ref) for i, (status, ref) in enumerate([("pending", None), ("complete", 1), ("failed", 2)])]
    fields = "pos long, utc timestamp, seq long, event string, status string, ref long, version string, reason string, figure string, figure_version string"
    path = str(tmp_path / "in")
    spark.createDataFrame([(*r, None, None, None, None) for r in rows], fields).coalesce(1).write.parquet(path)
    stream = ledgers.open_operations_stream(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path))
    begin = time.time()
    got = sorted(r.seq for r in ledgers.replay(stream, "append", "open").collect())
    assert time.time() - begin < 45
    assert got == [2 * i for i in range(n) if not any(j % 200 < gap for j in range(i, min(i + 60, n)))]


def _boxes(rng, page, n, first):
    """Small and large boxes, some without a side, on whole numbers, so that many touch."""
    side = lambda: rng.choice([0, 1, 2, 3, 5, rng.randint(1, 40)])
    return [(page, first + i, float(x := rng.randint(0, 60)), float(y := rng.randint(0, 60)), float(x + side()), float(y + side())) for i in range(n)]


@pytest.mark.parametrize("page_boxes, sweep", [(20_000, 1_000_000), (150, 1_000_000), (20_000, 7)])
def test_boxes_are_sent_once_and_meet_on_their_page(spark, monkeypatch, page_boxes, sweep):
    """every box went to each cell of each level in use on its page; now pages meet whole, and only fuller ones in cells."""
    monkeypatch.setattr(L, "PAGE_BOXES", page_boxes)
    monkeypatch.setattr(L, "SWEEP_PAIRS", sweep)
    rng = random.Random(6)
    rows = _boxes(rng, 1, 120, 0) + _boxes(rng, 2, 90, 1000) + _boxes(rng, 3, 1, 2000)
    others = [(p, i + 5000, x0 + 1, y0 + 2, x1 + 3, y1 + 2) for p, i, x0, y0, x1, y1 in rows if i % 3 == 0] + _boxes(rng, 4, 3, 9000)
    kind = "page int, idx int, x0 double, y0 double, x1 double, y1 double"
    texts, regions = spark.createDataFrame(rows + [(1, 777, None, 0.0, 1.0, 1.0)], kind), spark.createDataFrame(others, kind)
    pages = spark.createDataFrame([(p, 0.0, 0.0, 60.0, 60.0) for p in (1, 2, 3, 4)], kind.replace("idx int, ", ""))

    def share(a, b):
        w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
        return w * h if w > 0 and h > 0 else 0.0

    size = lambda a: (a[4] - a[2]) * (a[5] - a[3])
    near = lambda a, b: a[0] == b[0] and share(a, b) > 0 and share(a, b) / min(size(a), size(b)) >= 0.05
    pairs = L.text_text_overlap(texts)
    assert sorted((r.left_idx, r.right_idx, r.ratio) for r in pairs.collect()) == sorted(
        (a[1], b[1], share(a, b) / min(size(a), size(b))) for a in rows for b in rows if a[1] < b[1] and near(a, b))
    edges = L.text_region_edge(texts, regions, pages)
    inside = lambda a, b: a[2] >= b[2] - 0.25 and a[3] >= b[3] - 0.25 and a[4] <= b[4] + 0.25 and a[5] <= b[5] + 0.25
    met = [(a, b) for a in rows for b in others if near(a, b) and size(b) / 3600 < 0.2]
    partial, contained = Counter(a[:2] for a, b in met if not inside(a, b)), Counter(a[:2] for a, b in met if inside(a, b))
    assert sorted((r.page, r.text_idx, r.partial, r.contained) for r in edges.collect()) == sorted((*k, partial[k], contained[k]) for k in {a[:2] for a, _ in met})


def test_a_box_is_sent_once(spark):
    """every box went to each cell of each level in use on its page, some 400 bytes a box where tables are too large to broadcast."""
    spark.range(20_000).selectExpr("id % 40 AS page", "id AS idx", "cast(id * 7919 % 1000 AS double) AS x0", "cast(id * 104729 % 1500 AS double) AS y0").createOrReplaceTempView("corners")
    texts = spark.sql("SELECT *, x0 + 4 + if(idx % 50 = 0, 400, idx % 40) AS x1, y0 + 3 + if(idx % 50 = 0, 200, idx % 9) AS y1 FROM corners")
    pages = spark.sql("SELECT id AS page, 0D AS x0, 0D AS y0, 1000D AS x1, 1500D AS y1 FROM range(40)")
    drawn = texts.where("idx % 4 = 0").selectExpr("*", "1.5D AS width", "array(named_struct('x0', x0, 'y0', y0, 'x1', x1, 'y1', y0)) AS segments")
    sent = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for find in (lambda: L.text_text_overlap(texts), lambda: L.text_region_edge(texts, texts.where("idx % 3 = 0"), pages), lambda: L.text_stroke_crossing(texts, drawn)):
            start = sent()
            assert find().count() > 1000
            time.sleep(1)                                       # the figures come by a listener
            assert 0 < sent() - start < 150 * 20_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("page_boxes", [20_000, 60])
def test_strokes_meet_texts_on_their_page(spark, monkeypatch, page_boxes):
    """the crossing of strokes and texts is judged where they meet, and is the same for flat, upright, slanted and pointlike segments."""
    monkeypatch.setattr(L, "PAGE_BOXES", page_boxes)
    rng = random.Random(7)
    rows, strokes = [b for b in _boxes(rng, 1, 80, 0) + _boxes(rng, 2, 20, 100)], []
    for i in range(40):
        ends = [(float(rng.randint(0, 60)), float(rng.randint(0, 60))) for _ in range(rng.randint(1, 4))]
        lines = [(*a, *b) for a, b in zip(ends, ends[1:])] + [(*ends[0], ends[0][0], ends[0][1] + rng.choice([0.0, 9.0]))]
        xs, ys = [x for x, *_ in ends] + [lines[-1][2]], [y for _, y in ends] + [lines[-1][3]]
        strokes.append((1 + i % 2, i, min(xs), min(ys), max(xs), max(ys), rng.choice([0.5, 1.5, 4.0]), lines if i != 9 else None))
    kind = "page int, idx int, x0 double, y0 double, x1 double, y1 double"
    texts = spark.createDataFrame(rows, kind)
    drawn = spark.createDataFrame(strokes, f"{kind}, width double, segments array<struct<x0:double,y0:double,x1:double,y1:double>>")
    # the same by a join of everything with everything
    inner = texts.select("page", "idx", *[c.alias(n) for c, n in zip(L.inset(L.box(), L.TEXT_INSET), ("x0", "y0", "x1", "y1"))])
    grown = L.expand(L.box("s."), L.F.col("s.width"))
    every = inner.alias("t").join(drawn.alias("s"), L.F.expr("t.page = s.page")).where(L.intersection_area(L.box("t."), grown) > 0).where(
        L.F.exists("s.segments", lambda s: L.segment_enters(s, L.expand(L.box("t."), L.F.col("s.width") / 2))))
    want = sorted(map(tuple, every.groupBy("t.page", "t.idx").count().collect()))
    assert want and sorted(map(tuple, L.text_stroke_crossing(texts, drawn).collect())) == want

"""Numbering, sweeps, split files, hash trees, SQL table functions and streams, on inputs beyond one task or one block."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from proofline.functions import text as T
from proofline.functions.ordered import table_row_numbers
from proofline.operators import history as H
from proofline.sources import readers as S
from proofline.streaming import ledgers


def plan(df):
    return df._jdf.queryExecution().toString()


def test_table_numbers_need_no_window(spark):
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).alias("v"))
    out = table_row_numbers(df, ["v"], "n")
    assert "Window" not in plan(out)
    ranked = sorted(r.v for r in df.collect())
    assert [r.v for r in out.orderBy("n").collect()] == ranked and out.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first() == (1, 200_000, 200_000)
    assert table_row_numbers(df.where("v < 0"), ["v"], "n").count() == 0


def test_thousand_ranges_on_one_document(spark):
    rng = random.Random(5)
    runs = [(1, p, r, f"{p}.{r} ") for p in range(60) for r in range(rng.randint(1, 12))] + [(2, 0, 0, "other")]
    ranges = [(1, k, *sorted([(rng.randint(0, 60), rng.randint(0, 12)), (rng.randint(0, 60), rng.randint(0, 12))])) for k in range(1000)]
    flat = [(d, k, a[0], a[1], b[0], b[1]) for d, k, a, b in ranges]
    got = {r.id: r.anchor for r in H.anchor_texts(
        spark.createDataFrame(runs, "doc_id int, para_idx int, run_idx int, text string"),
        spark.createDataFrame(flat, "doc_id int, id int, start_para int, start_run int, end_para int, end_run int")).collect()}
    expected = {}
    for d, k, a, b in ranges:
        held = [x for x in runs if x[0] == d and a <= (x[1], x[2]) < b]
        if held:
            paras = sorted({x[1] for x in held})
            expected[k] = "\n".join("".join(x[3] for x in held if x[1] == p) for p in paras).strip(" ")
    assert got == expected


def test_line_numbers_of_a_file_in_many_blocks(spark, tmp_path):
    lines = [json.dumps({"seq": i, "event": "e" * (i % 50)}) if i % 7 else ("not json" if i % 2 else "") for i in range(4000)]
    (tmp_path / "one.jsonl").write_text("﻿" + "\n".join(lines) + "\n")
    (tmp_path / "two.jsonl").write_text("\r\n".join(lines[:100]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        numbered = S.numbered_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        good, bad = S.read_ledger(spark, str(tmp_path))
        found = sorted((r.file[-9:], r.pos, r.seq) for r in good.collect())
        broken = sorted((r.file[-9:], r.line_no) for r in bad.collect())
        assert numbered.count() >= 4100
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == sorted([("one.jsonl", i + 1, i) for i in range(4000) if i % 7] + [("two.jsonl", i + 1, i) for i in range(100) if i % 7])
    assert broken == sorted([("one.jsonl", i + 1) for i in range(0, 4000, 7) if i % 2] + [("two.jsonl", i + 1) for i in range(0, 100, 7) if i % 2])


def test_digest_is_a_tree_of_hashes(spark):
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    files = [(f"f{i}", f"body {i % 40}") for i in range(300)]
    frame = spark.createDataFrame([("g", n, b) for n, b in files], "g string, n string, b string").repartition(5)
    level = {}
    for n, b in files:
        h = sha(f"{len(n)}:{n}:{sha(b)}")
        level.setdefault(h[:6], []).append(h)
    for digits in (3, 0):
        up = {}
        for at, hashes in sorted(level.items()):
            up.setdefault(at[:digits], []).append(sha(":".join(sorted(hashes))) if digits == 3 else sha(":".join(hashes)))
        level = up
    row = S.content_digest(frame, "g", "n", "b").first()
    assert (row.files, row.digest) == (300, sha(f"300:{sha(':'.join(level['']))}"))


def test_sentences_in_sql_equal_the_expression(spark):
    texts = ["Dr. Smith came. He left! Why?", "", "  one e.g. two. Three 3.5 four.  ", "It's \"quoted.\" Next. (In brackets.) end", "x\\y. Z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    T.register_sentences(spark)
    sql = spark.sql("SELECT doc_id, s.* FROM {docs}, LATERAL sentence_rows(text) AS s", docs=docs)
    column = docs.select("doc_id", F.posexplode(T.sentence_spans("text")).alias("sent_idx", "s")).select("doc_id", "sent_idx", "s.*")
    got = sorted(map(tuple, sql.collect()))
    assert got == sorted(map(tuple, column.collect())) and len(got) >= 9


def test_stream_of_open_operations_equals_the_batch(spark, tmp_path):
    start = datetime(2024, 1, 1)
    fields = "pos long, utc timestamp, seq long, event string, status string, ref long, version string, reason string, figure string, figure_version string"
    rows, rng = [], random.Random(1)
    for k in range(60):
        at, event = start + timedelta(minutes=k), rng.choice(["a", "b"])
        rows.append((event, "pending", None, k, at, None))
        fate = rng.choice(["open", "complete", "failed"])
        if fate != "open":
            rows.append((event, fate, k, 1000 + k, at + timedelta(minutes=5), rng.choice([None, "v1"])))
    rows.sort(key=lambda r: r[4])
    ledger = [(p, at, seq, event, status, ref, version, None, None, None) for p, (event, status, ref, seq, at, version) in enumerate(rows)]
    late = start + timedelta(days=2)
    closing = [(900 + i, late, 5000 + i, "z", status, ref, f"w{i}", None, None, None) for i, (status, ref) in enumerate([("pending", None), ("complete", 1), ("failed", 2)])]
    spark.createDataFrame(ledger + closing, fields).coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = H.open_operations(spark.createDataFrame(ledger, fields))
    stream = ledgers.open_operations_stream(spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in")), timeout="24 hours")
    got = {(r.seq, r.event, r.issue) for r in ledgers.replay(stream, "append", "open").collect()}
    expected = {(r.seq, r.event, r.issue) for r in batch.collect()}
    assert got == expected and {i for _, _, i in got} == {"interrupted", "failed"}


def test_stream_keeps_one_join_in_as_many_parts_as_cores(spark, tmp_path, monkeypatch):
    start = datetime(2024, 1, 1)
    fields = "pos long, utc timestamp, seq long, event string, status string, ref long, version string, reason string, figure string, figure_version string"
    rows = [(1, start, 1, "a", "pending", None, None), (2, start, 2, "a", "failed", 1, None), (3, start, None, "a", "pending", None, None), (4, start, 4, "a", "complete", 9, None),
            (5, start, 5, "b", "failed", None, "v"), (6, start, 6, None, "pending", None, None), (7, start, 7, "b", "complete", None, "w")]
    rows += [(90 + i, start + timedelta(days=2), 90 + i, "z", s, 90 + i, f"w{i}") for i, s in enumerate(["pending", "complete", "failed"])]
    spark.createDataFrame([(*r, None, None, None) for r in rows], fields).coalesce(1).write.parquet(str(tmp_path / "in"))
    monkeypatch.setattr(ledgers, "scratch_path", lambda spark, label: str(tmp_path / label))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        stream = ledgers.open_operations_stream(spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in")))
        got = ledgers.replay(stream, "append", "open").collect()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "64"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    state = tmp_path / "open-checkpoint" / "state"
    assert [d.name for d in state.iterdir() if d.is_dir() and d.name.isdigit()] == ["0"]
    assert len([d for d in (state / "0").iterdir() if d.name.isdigit()]) <= spark.sparkContext.defaultParallelism
    assert {(r.seq, r.event, r.issue) for r in got} == {(None, "a", "interrupted"), (6, None, "interrupted"), (5, "b", "failed")}


def test_crowded_cells_are_spread_over_tasks(spark, monkeypatch):
    from proofline.operators import layout as L

    monkeypatch.setattr(L, "CROWD", 50)
    rng = random.Random(9)
    boxes = [(1, i, x := rng.uniform(0, 12), y := rng.uniform(0, 12), x + 3 + rng.random(), y + 3 + rng.random()) for i in range(600)]
    boxes += [(1, 600 + i, x := rng.uniform(0, 90), y := rng.uniform(0, 90), x + rng.uniform(1, 40), y + rng.uniform(1, 40)) for i in range(60)]
    frame = spark.createDataFrame(boxes, "page int, idx int, x0 double, y0 double, x1 double, y1 double")
    meet = lambda a, b: min(a[4], b[4]) > max(a[2], b[2]) and min(a[5], b[5]) > max(a[3], b[3])
    expected = {(a[1], b[1]) for i, a in enumerate(boxes) for b in boxes[i + 1:] if meet(a, b)}
    pairs = [(r.left_idx, r.right_idx) for r in L.overlapping_pairs(frame).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == expected
    left, right = frame.where("idx % 2 = 0"), frame.where("idx % 2 = 1")
    both = {(r.left_idx, r.right_idx) for r in L.overlapping_pairs(left, right).collect()}
    assert both == {(a, b) if a % 2 == 0 else (b, a) for a, b in expected if (a + b) % 2}


def test_intermediate_tables_are_deleted_on_request(spark):
    from proofline import session

    session.clear_scratch(spark)
    frame = session.materialise(spark.range(5), "kept")
    assert frame.count() == 5 and session.clear_scratch(spark) == 1 and session.clear_scratch(spark) == 0


def test_words_of_entries_are_never_broadcast(spark):
    """Their file is a dictionary and far smaller than their rows, so its size must not make the driver gather them."""
    from proofline.operators.matching import best_title_match

    entries = spark.range(50).selectExpr("id AS entry_id", "'renal outcome of adults' AS text")
    records = spark.createDataFrame([(1, "Renal outcome of adults")], "record_id int, title string")
    found = best_title_match(entries, records)
    assert found.count() == 50
    lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            assert not any("title-words" in below and "FileScan" in below for below in lines[i + 1:end])

"""Conversation repair against brute force: every audit by shortest paths, conversations longer than a chunk, hostile tables."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from proofline.llm import conversations as C

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
RESULT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damage(rows):
    """(conv, turn, role, text) after damage, in order, by conversation."""
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        kept = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if lot == 0:
            continue
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        kept += [(turn, "user" if lot == 4 else role, text)] * (2 if lot == 3 else 1)
    return {c: sorted(k, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest())) for c, k in out.items()}


def cheapest(rows):
    """By (cost, audit) over a graph of (place, state); rows are (role, text, must go, breaks off)."""
    after = {"": {"u": "u", "s": "s"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, made = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, made
        if (i, state) in seen:
            continue
        seen.add((i, state))
        for new, name in (("u", "user"), ("a", "assistant")):
            if new in after[state]:
                heapq.heappush(heap, (cost + 2, audit + "I", i, new, (*made, f"{name}:")))
        if i == len(rows):
            continue
        role, text, must, cut = rows[i]
        heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, made))
        if must:
            continue
        if role[:1] in after[state] and role[:1]:
            heapq.heappush(heap, (cost + cut, audit + "K", i + 1, role[:1], (*made, f"{role}:{text}")))
        for new, name in (("u", "user"), ("a", "assistant")):
            if new in after[state]:
                heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, new, (*made, f"{name}:{text}")))
    raise AssertionError


def expected(rows):
    out = {}
    for conv, own in damage(rows).items():
        seen, blank, duplicate, truncated, illegal, marked = set(), 0, 0, 0, 0, []
        for k, (_, role, text) in enumerate(own):
            bare = text.strip(WHITE)
            must = not bare or (role, text) in seen
            cut = not must and bare[-1] not in ".!?"
            blank += not bare
            duplicate += bool(bare) and must
            truncated += cut
            seen.add((role, text))
            illegal += k > 0 and own[k - 1][1][:1] + role[:1] not in ("su", "ua", "au")
            marked.append((role, text, must, cut))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, made = cheapest(marked)
        out[conv] = (gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


def table(seed: int, conversations: int, longest: int, roles=("system", "user", "assistant", "user", "assistant", "tool", "", None)):
    rng, rows = random.Random(seed), []
    for conv in range(conversations):
        for turn in range(rng.randint(1, longest)):
            text = rng.choice(["Yes.", "no", "", " \t", None, "Why? ", "Ok!", "x" * rng.randint(1, 30) + ".", "same words"])
            usual = ("system" if turn == 0 and rng.random() < .5 else ("user", "assistant")[turn % 2])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]) if rng.random() < .2 else turn, rng.choice(roles) if rng.random() < .3 else usual, text))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(c, t, r, x, 5, "clash") for c, t, r, x in rows], "conv_id long, turn long, role string, text string, chunk int, used string").repartition(3)


def result(repaired):
    return {r[0]: tuple(r[1:]) for r in C.conversation_digests(repaired).select(RESULT).collect()}


def unique_places(rows):
    """Rows whose order does not hang on ties of turn."""
    seen = set()
    return [r for r in rows if not (r[:2] in seen or seen.add(r[:2]))]


@pytest.mark.parametrize(("seed", "size", "passes"), [(1, 4096, 6), (2, 3, 6), (3, 2, 0)])
def test_audits_equal_shortest_paths(spark, seed, size, passes):
    rows = [*table(seed, 60, 9), *table(seed + 50, 1, 60)] if size > 100 else [*unique_places(table(seed, 12, 25)), *((900, i, "tool", f"row {i}.") for i in range(23)), (None, None, None, None)]
    got = result(C.repair(C.damaged(frame(spark, rows)), copies="copies", size=size, passes=passes))
    assert got == expected(rows)


def test_long_conversation_spreads_over_tasks(spark):
    rows = [(7, i, ("user", "assistant")[i % 2], f"text {i}." + " word" * (i % 7)) for i in range(3000)] + [(8, 0, "user", "alone.")]
    chunks = C.chunks_of(C.ordered_rows(C.damaged(frame(spark, rows)).withColumn("copies", F.lit(1)), "conv_id", "turn", "role", "text", "copies"), 50)
    assert chunks.where("conv_id = 7").count() >= 50
    assert result(C.repair(C.damaged(frame(spark, rows)), copies="copies", size=50)) == expected(rows)


def test_hot_repeats_very_long_texts_and_empty_tables(spark):
    rows = [(1, 0, "user", "again.")] * 5000 + [(1, 1, "assistant", "a " * 600_000 + ".")] + [(2, i, "user", "again.") for i in range(400)]
    assert result(C.repair(C.damaged(frame(spark, rows)), copies="copies")) == expected(rows)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.conversation_digests(C.repair(C.damaged(empty), copies="copies")).count() == 0


def test_query_on_its_table(spark):
    got = C.op12_conversation_repair(spark, "/root/testdata/sf0.001")
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r[0]: tuple(r[1:]) for r in got.select(RESULT).collect()} == expected(rows)
    text = C.repaired_rows(C.repair(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")))
    assert text.where("text IS NULL OR role IS NULL").isEmpty() and text.count() > 0

"""Repair of conversation structure: the cheapest edits that give ``system? (user assistant)+``, by rank-convergence Viterbi.

A conversation's rows, in order, are cut into chunks of bounded size that may lie in different tasks. The cost of the edits
still to make, from each of four states, is computed backwards in every chunk at once from a speculative vector. Where the
vector that the chunk to the right really has differs from the speculative one by a constant only, the chunk is right up to
that constant; otherwise a fix-up pass reruns it. Costs of such vectors differ by little, so each step is looked up among few.
The least audit is then traced forwards in each chunk from all four states, and chunks are stitched by composing these maps.

Edits: Keep (0), Rerole to user or assistant (2), Delete (3; demanded for blank rows and repeats), Insert an empty row of user
or assistant (2); a row that breaks off and is not deleted adds 1. Among the cheapest, the least string of initials is taken.

Defined results: NULL roles and texts count as one space; rows are ordered by turn (NULL first), then role, then the hash of the
text; a role that starts with none of s, u, a cannot be kept; rows of a NULL id form one conversation; a conversation without rows
has an empty audit; repeated rows are repeats, whatever their number; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofline.llm.common import materialise, read_table

#: Rows and bytes of text in a chunk (a single row may be longer), chunks in an Arrow batch, fix-up passes before cost matrices take over.
CHUNK, CHUNK_BYTES, BATCH, PASSES = 4096, 4 << 20, 512, 6
#: States: nothing yet, after the system row, after a user row, after an assistant row. What a row of user or assistant leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
#: Cost to go behind the last row.
END = (0, 4, 2, 0)
FAR = 1 << 40
INITIALS = "sua"

Vector = tuple[int, ...]


def kept_state(state: int, role: int) -> int | None:
    """The state after keeping a row whose role is INITIALS[role] (3: another), or None."""
    if role == 0:
        return SYSTEM if state == START else None
    return NEXT[state] if role < 3 and NEXT[state] == role + 1 else None


class Costs:
    """Steps of the recurrence, remembered: vectors are normalised to minimum 0, and few differ.

    A unit stands for rows: 0 or more is one row, its role's place in INITIALS (3: another) plus 4 where it breaks off; a
    negative number is a run of so many rows that must be deleted.
    """

    def __init__(self):
        self.steps: dict = {}
        self.moves: dict = {}

    def step(self, after: Vector, unit: int) -> tuple[Vector, int]:
        """The normalised vector before a unit, and what was subtracted."""
        if unit < 0:
            return after, -3 * unit
        if (known := self.steps.get((after, unit))) is None:
            cut, role = divmod(unit, 4)
            costs = []
            for state in range(4):
                kept = kept_state(state, role)
                costs.append(min(3 + after[state], 2 + cut + after[NEXT[state]], FAR if kept is None else cut + after[kept]))
            for _ in range(3):
                costs = [min(c, 2 + costs[NEXT[state]]) for state, c in enumerate(costs)]
            low = min(costs)
            known = self.steps[after, unit] = tuple(c - low for c in costs), low
        return known

    def back(self, units: list[int], after: Vector) -> list[Vector]:
        """The vectors before each unit, and ``after`` itself."""
        found = [after]
        for unit in reversed(units):
            found.append(self.step(found[-1], unit)[0])
        return found[::-1]

    def move(self, after: Vector, unit: int, state: int) -> tuple[str, int]:
        """The least cheapest edits from a state through one row, and the state behind it."""
        if (known := self.moves.get((after, unit, state))) is None:
            before, low = self.step(after, unit)
            cut, role = divmod(unit, 4)
            at, letters = state, ""
            while True:
                cost, kept = before[at] + low, kept_state(at, role)
                if 3 + after[at] == cost:
                    known = letters + "D", at
                elif 2 + before[NEXT[at]] + low == cost:
                    letters, at = letters + "I", NEXT[at]
                    continue
                elif kept is not None and cut + after[kept] == cost:
                    known = letters + "K", kept
                else:
                    known = letters + "R", NEXT[at]
                break
            self.moves[after, unit, state] = known
        return known

    def trace(self, units: list[int], after: Vector, state: int, last: bool) -> tuple[str, int]:
        """The edits through a chunk, and the state behind it; the last chunk also ends the conversation."""
        letters, vectors = [], self.back(units, after)
        for i, unit in enumerate(units):
            if unit < 0:
                letters.append("D" * -unit)
            else:
                made, state = self.move(vectors[i + 1], unit, state)
                letters.append(made)
        while last and state in (SYSTEM, USER):
            letters.append("I")
            state = NEXT[state]
        return "".join(letters), state


def edited(units: list[int], roles: list[str], texts: list[str], audit: str, state: int) -> tuple[int, list[dict]]:
    """Cost and rows after the edits of ``audit``; roles and texts are those of the units that may stay."""
    cost, rows, place, left, unit = 0, [], 0, 0, iter(units)
    role_of = {USER: "user", ASSISTANT: "assistant"}
    for letter in audit:
        if letter == "I":
            state, cost = NEXT[state], cost + 2
            rows.append({"role": role_of[state], "text": ""})
            continue
        if not left:
            now = next(unit)
            left = -now if now < 0 else 1
        left -= 1
        if now < 0:
            cost += 3
            continue
        role, text = roles[place], texts[place]
        place += 1
        if letter == "D":
            cost += 3
            continue
        cut, kind = divmod(now, 4)
        state = kept_state(state, kind) if letter == "K" else NEXT[state]
        cost += cut + (2 if letter == "R" else 0)
        rows.append({"role": role if letter == "K" else role_of[state], "text": text})
    return cost, rows


def _null_safe(left: DataFrame, right: DataFrame, keys: dict[str, str], how: str) -> DataFrame:
    on = None
    for a, b in keys.items():
        same = left[a].eqNullSafe(right[b])
        on = same if on is None else on & same
    return left.join(right, on, how).drop(*[right[b] for b in keys.values()])


def ordered_rows(turns: DataFrame, conv_id: str, turn: str, role: str, text: str, copies: str | None) -> DataFrame:
    """(conv_id, turn, role, text, copies, fault) with each row's first fault: 1 blank, 2 repeat, 3 broken off; equal rows are one.

    A conversation counts rows by ``copies`` (0: there is none, only the conversation). Texts that must go are left out.
    """
    col = lambda name: F.col(f"`{name}`")
    space = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    rows = turns.select(col(conv_id).alias("conv_id"), col(turn).alias("turn"), space(col(role)).alias("role"), space(col(text)).alias("text"),
                        (F.coalesce(col(copies), F.lit(1)) if copies else F.lit(1)).cast("bigint").alias("copies"))
    rows = rows.withColumn("hash", F.sha2("text", 256))
    place = F.struct(F.col("turn").isNotNull(), "turn")
    groups = rows.where("copies > 0").groupBy("conv_id", "role", "hash").agg(F.count("*").alias("n"), F.min(place)["turn"].alias("first"))
    groups = materialise(groups.where("n > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("hash").alias("h"), "first", F.lit(True).alias("more")), "repeats")
    marked = _null_safe(rows, groups, {"conv_id": "c", "role": "r", "hash": "h"}, "left")
    again = F.coalesce(F.col("more") & ~F.col("turn").eqNullSafe(F.col("first")), F.lit(False))
    filled = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    fault = F.when(~filled, 1).when(again, 2).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), 3).otherwise(0)
    marked = marked.withColumn("fault", fault).withColumn("text", F.when(F.col("fault").isin(0, 3) & (F.col("copies") > 0), F.col("text")))
    names = ["conv_id", "turn", "role", "text", "copies", "fault", "hash"]
    alone = marked.where("more IS NULL OR copies = 0").select(names)
    equal = marked.where("more AND copies > 0").groupBy("conv_id", "turn", "role", "hash").agg(F.min("text").alias("text"), F.sum("copies").alias("copies"), F.min("fault").alias("fault"))
    return alone.unionByName(equal.select(names))


STATS = [("n_blank", "bigint"), ("n_duplicate", "bigint"), ("n_truncated", "bigint"), ("n_illegal", "bigint"), ("n_turns", "bigint")]
CHUNK_FIELDS = [("chunk", "bigint"), ("before", "boolean"), ("after", "boolean"), ("first", "boolean"), ("last", "boolean"), ("units", "array<bigint>"), ("roles", "array<string>"),
                ("texts", "array<string>"), *STATS, ("head", "string"), ("tail", "string")]
ARROW_OF = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


class _Chunk:
    """Rows of one conversation, gathered in order."""

    def __init__(self, conv, number: int, before: bool):
        self.conv, self.number, self.before, self.bytes = conv, number, before, 0
        self.units, self.roles, self.texts = [], [], []
        self.counts = dict.fromkeys((name for name, _ in STATS), 0)
        self.head = self.tail = self.low = self.high = None

    def add(self, turn, role: str, text: str | None, copies: int, fault: int) -> None:
        if copies <= 0:
            return
        counts, initial = self.counts, role[:1]
        counts["n_illegal"] += copies - 1 + (self.tail is not None and self.tail + initial not in ("su", "ua", "au"))
        self.head, self.tail = initial if self.head is None else self.head, initial
        if turn is not None:
            counts["n_turns"] += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        gone = copies if fault in (1, 2) else copies - 1
        counts["n_blank"] += copies if fault == 1 else 0
        counts["n_duplicate"] += gone if fault != 1 else 0
        if fault in (0, 3):
            counts["n_truncated"] += fault == 3
            at = INITIALS.find(initial) if initial else -1
            self.units.append((at if at >= 0 else 3) + (4 if fault == 3 else 0))
            self.roles.append(role)
            self.texts.append(text)
            self.bytes += len(text)
        if gone:
            if self.units and self.units[-1] < 0:
                self.units[-1] -= gone
            else:
                self.units.append(-gone)


def chunks_of(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """One row per chunk: conv_id, a number that rises with the order, units, the roles and texts that may stay, and counts.

    Rows are dealt by ranges of their order, so a conversation of any length spreads over tasks; a task reads its rows as a stream.
    """
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "hash")]
    names = ["conv_id", "turn", "role", "text", "copies", "fault"]
    conv, turn = rows.schema["conv_id"].dataType.simpleString(), rows.schema["turn"].dataType.simpleString()
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(names)
    schema = ", ".join([f"conv_id {conv}", *(f"{name} {kind}" for name, kind in CHUNK_FIELDS), f"low {turn}", f"high {turn}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, now, done = TaskContext.get().partitionId() << 33, 0, None, []
        kinds = None

        def close(after: bool, last: bool) -> None:
            done.append([now.conv, now.number, now.before, after, now.number == base, last, now.units, now.roles, now.texts, *now.counts.values(), now.head, now.tail, now.low, now.high])

        def packed() -> pa.RecordBatch:
            types = [kinds[0], *(ARROW_OF[kind] for _, kind in CHUNK_FIELDS), kinds[1], kinds[1]]
            columns = [pa.array([row[i] for row in done], kind) for i, kind in enumerate(types)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", *(name for name, _ in CHUNK_FIELDS), "low", "high"])

        held = 0
        for batch in batches:
            kinds = batch.schema.field(0).type, batch.schema.field(1).type
            for conv_id, *row in zip(*(batch.column(i).to_pylist() for i in range(len(names))), strict=True):
                same = now is not None and now.conv == conv_id
                if now is not None and (not same or (row[3] > 0 and (len(now.units) >= size or now.bytes >= CHUNK_BYTES))):
                    held += now.bytes
                    close(same, False)
                    now = None
                if now is None:
                    now = _Chunk(conv_id, base + made, same)
                    made += 1
                now.add(*row)
                if len(done) >= BATCH or held >= 2 * CHUNK_BYTES:
                    held = 0
                    yield packed()
        if now is not None:
            close(False, True)
            yield packed()
    return dealt.mapInArrow(run, schema)


def linked_chunks(chunks: DataFrame) -> DataFrame:
    """``chunks`` with the numbers of the previous and next chunk of the conversation, NULL at its ends.

    Neighbours within a task are known; only the first and last chunk of each task meet across tasks, in one small window.
    """
    order = Window.partitionBy("conv_id").orderBy("chunk")
    edges = chunks.where("(first OR last) AND size(units) > 0").select("chunk", F.lag("chunk").over(order).alias("_prev"), F.lead("chunk").over(order).alias("_next"))
    return chunks.join(edges, "chunk", "left").withColumn(
        "prev", F.when(F.col("before"), F.col("chunk") - 1).when(F.col("first"), F.col("_prev"))).withColumn(
        "next", F.when(F.col("after"), F.col("chunk") + 1).when(F.col("last"), F.col("_next"))).drop("_prev", "_next")


def _run_vectors(rows: DataFrame) -> DataFrame:
    """(chunk, next, units, used, left, changed) from (chunk, next, units, used, left, want): chunks whose wanted vector is another one run again."""
    def run(frames):
        costs = Costs()
        for frame in frames:
            used, left, changed = [], [], []
            for units, old, result, want in zip(frame["units"], frame["used"], frame["left"], frame["want"], strict=True):
                again = old is None or tuple(old) != tuple(want)
                changed.append(again)
                used.append(list(want))
                left.append(list(costs.back(list(units), tuple(want))[0]) if again else list(result))
            yield frame.assign(used=used, left=left, changed=changed)[["chunk", "next", "units", "used", "left", "changed"]]
    return rows.mapInPandas(run, "chunk bigint, next bigint, units array<bigint>, used array<bigint>, left array<bigint>, changed boolean")


def _long(values) -> Column:
    return F.array(*[F.lit(v).cast("bigint") for v in values])


def vectors_by_fixup(linked: DataFrame, passes: int) -> tuple[DataFrame, bool]:
    """(chunk, next, units, used, left) after at most so many fix-up passes, and whether all chunks agree."""
    none = F.lit(None).cast("array<bigint>")
    start = linked.select("chunk", "next", "units", none.alias("used"), none.alias("left"), F.when(F.col("next").isNull(), _long(END)).otherwise(_long([0] * 4)).alias("want"))
    now = materialise(_run_vectors(start), "costs")
    for _ in range(passes):
        right = now.select(F.col("chunk").alias("next"), F.col("left").alias("want"))
        now = materialise(_run_vectors(now.drop("changed").join(right, "next", "left").withColumn("want", F.coalesce("want", "used"))), "costs")
        if now.where("changed").isEmpty():
            return now, True
    return now, False


def vectors_by_matrices(linked: DataFrame) -> DataFrame:
    """(chunk, next, units, used): for conversations whose vectors do not converge, products of cost matrices over doubling distances."""
    def run(frames):
        costs = Costs()
        for frame in frames:
            made = []
            for units in frame["units"]:
                rows = []
                for state in range(4):                           # cost from each state to this one at the chunk's right end
                    after, total = tuple(0 if s == state else FAR for s in range(4)), 0
                    for _ in range(3):
                        after = tuple(min(c, 2 + after[NEXT[s]]) for s, c in enumerate(after))
                    for unit in reversed(list(units)):
                        after, low = costs.step(after, unit)
                        total += low
                    rows.append([c + total for c in after])
                made.append([rows[b][a] for a in range(4) for b in range(4)])
            yield frame.assign(costs=made)[["chunk", "next", "costs"]]
    jumps = materialise(linked.select("chunk", "next", "units").mapInPandas(run, "chunk bigint, next bigint, costs array<bigint>"), "jumps")
    product = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda a: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda b: F.array_min(
        F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.get("costs", a * 4 + k) + F.get("_costs", k * 4 + b))))))
    while not jumps.where("next IS NOT NULL").isEmpty():
        other = jumps.select(F.col("chunk").alias("next"), F.col("next").alias("_next"), F.col("costs").alias("_costs"))
        jumps = jumps.join(other, "next", "left").select("chunk", F.col("_next").alias("next"), F.when(F.col("_costs").isNull(), F.col("costs")).otherwise(product).alias("costs"))
        jumps = materialise(jumps, "jumps")
    left = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda a: F.array_min(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda b: F.get("costs", a * 4 + b) + F.get(_long(END), b))))
    left = jumps.select(F.col("chunk").alias("next"), F.transform(left, lambda c: c - F.array_min(left)).alias("used"))
    return linked.select("chunk", "next", "units").join(left, "next", "left").withColumn("used", F.coalesce("used", _long(END)))


def entry_states(vectors: DataFrame) -> DataFrame:
    """(chunk, used, state): the state in which the trace enters each chunk, by composing the chunks' maps over doubling distances."""
    def run(frames):
        costs = Costs()
        for frame in frames:
            ends = [[costs.trace(list(units), tuple(used), state, False)[1] for state in range(4)] for units, used in zip(frame["units"], frame["used"], strict=True)]
            yield frame.assign(ends=ends)[["chunk", "next", "ends"]]
    maps = vectors.select("chunk", "next", "units", "used").mapInPandas(run, "chunk bigint, next bigint, ends array<bigint>")
    maps = materialise(maps.select(F.col("chunk").alias("at"), "next", "ends"), "maps")
    # "at" enters "next": a row (next, at, ends) maps the state before "at" to the state before "next"
    back = maps.where("next IS NOT NULL").select(F.col("next").alias("chunk"), F.col("at").alias("prev"), "ends")
    now = materialise(back, "maps")
    while True:
        other = now.select(F.col("chunk").alias("prev"), F.col("prev").alias("_prev"), F.col("ends").alias("_ends"))
        both = now.join(other, "prev", "left")
        moved = materialise(both.select("chunk", F.coalesce("_prev", "prev").alias("prev"), F.when(F.col("_ends").isNull(), F.col("ends")).otherwise(
            F.transform("_ends", lambda s: F.get("ends", s.cast("int")))).alias("ends"), F.col("_prev").isNotNull().alias("moved")), "maps")
        now = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    states = now.select("chunk", F.get("ends", F.lit(START)).alias("state"))
    return vectors.select("chunk", "used").join(states, "chunk", "left").withColumn("state", F.coalesce("state", F.lit(START)))


def repair(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None,
           size: int = CHUNK, passes: int = PASSES) -> DataFrame:
    """One row per chunk of a conversation: conv_id, chunk (rising with the order), linked, audit, cost, repaired (role, text), and counts.

    ``linked`` tells that the conversation has further chunks. Column ``copies`` of the input says how often a row occurs in a row.
    """
    chunks = materialise(chunks_of(ordered_rows(turns, conv_id, turn, role, text, copies), size), "chunks")
    placed = materialise(linked_chunks(chunks.drop("roles", "texts")), "chunks")
    linked = placed.where("prev IS NOT NULL OR next IS NOT NULL")
    none = F.lit(None)
    solved = placed.sparkSession.createDataFrame([], "chunk bigint, prev bigint, next bigint, used array<bigint>, state bigint, _tail string, _high bigint")
    solved = solved.withColumn("_high", none.cast(placed.schema["high"].dataType))
    if not linked.isEmpty():
        vectors, agreed = vectors_by_fixup(linked, passes)
        if not agreed:
            vectors = materialise(vectors_by_matrices(linked), "costs")
        ends = placed.select(F.col("chunk").alias("prev"), F.col("tail").alias("_tail"), F.col("high").alias("_high"))
        solved = materialise(linked.select("chunk", "prev", "next").join(entry_states(vectors), "chunk").join(ends, "prev", "left"), "solved")
    rows = chunks.join(solved, "chunk", "left").withColumns({
        "linked": F.col("used").isNotNull(), "used": F.coalesce("used", _long(END)), "state": F.coalesce("state", F.lit(START)),
        "n_illegal": F.col("n_illegal") + F.coalesce((~F.concat("_tail", "head").isin("su", "ua", "au")).cast("int"), F.lit(0)),
        "n_turns": F.col("n_turns") - F.coalesce((F.col("_high") == F.col("low")).cast("int"), F.lit(0))})
    names = ["conv_id", "chunk", "linked", *(name for name, _ in STATS), "low", "high", "units", "roles", "texts", "used", "state", "next"]
    rows = rows.select(names)
    kept = rows.columns[:-6]
    kinds = rows.schema
    schema = ", ".join([*(f"{c} {kinds[c].dataType.simpleString()}" for c in kept), "audit string", "cost bigint", "repaired array<struct<role:string,text:string>>"])
    repaired_type = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches):
        costs = Costs()
        for batch in batches:
            column = {c: batch.column(i) for i, c in enumerate(names)}
            audits, totals, made = [], [], []
            for units, roles, texts, used, state, following in zip(*(column[c].to_pylist() for c in ("units", "roles", "texts", "used", "state", "next")), strict=True):
                audit, _ = costs.trace(units, tuple(used), state, following is None)
                cost, out = edited(units, roles, texts, audit, state)
                audits.append(audit)
                totals.append(cost)
                made.append(out)
            yield pa.RecordBatch.from_arrays([*(column[c] for c in kept), pa.array(audits, pa.string()), pa.array(totals, pa.int64()), pa.array(made, repaired_type)],
                                             names=[*kept, "audit", "cost", "repaired"])
    return rows.mapInArrow(run, schema)


def repaired_rows(repaired: DataFrame) -> DataFrame:
    """(conv_id, chunk, place, role, text): the repaired conversations as rows; order by chunk, then place."""
    return repaired.select("conv_id", "chunk", F.posexplode("repaired").alias("place", "row")).select("conv_id", "chunk", "place", "row.role", "row.text")


def _streamed_digests(bodies: DataFrame) -> DataFrame:
    """(conv_id, sha) of bodies (conv_id, chunk, body) joined by newlines in order; a hash is sequential, so a conversation streams through one task, one chunk at a time."""
    def run(batches):
        now, digest, empty = None, None, True
        for batch in batches:
            sent = []
            for conv, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest is None or conv != now:
                    if digest is not None:
                        sent.append((now, digest.hexdigest()))
                    now, digest, empty = conv, hashlib.sha256(), True
                if body:
                    digest.update((b"" if empty else b"\n") + body.encode())
                    empty = False
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in sent], batch.schema.field(0).type), pa.array([s for _, s in sent], pa.string())], names=["conv_id", "sha"])
            kind = batch.schema.field(0).type
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([digest.hexdigest()])], names=["conv_id", "sha"])
    kind = bodies.schema["conv_id"].dataType.simpleString()
    return bodies.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").select("conv_id", "body").mapInArrow(run, f"conv_id {kind}, sha string")


def conversation_digests(repaired: DataFrame) -> DataFrame:
    """One row per conversation: counts of faults, cost, audit and the hash of the repaired rows."""
    body = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    rows = materialise(repaired.withColumn("body", body).withColumn("sha", F.when(~F.col("linked"), F.sha2("body", 256))).withColumn(
        "body", F.when(F.col("linked"), F.col("body"))).drop("repaired"), "repaired")
    linked = rows.where("linked")
    count = lambda c: F.sum(c).alias(c)
    parts = F.array_sort(F.collect_list(F.when(F.col("audit") != "", F.struct("chunk", "audit"))))
    # a chunk without rows only says that its conversation exists; its hash must not hide that of another chunk
    whole = rows.groupBy("conv_id").agg(*[count(c) for c, _ in STATS], F.sum("cost").alias("cost"), F.min("low").alias("low"), F.max("high").alias("high"),
                                        F.array_join(F.transform(parts, lambda p: p["audit"]), "").alias("audit"), F.max(F.when(F.col("audit") != "", F.col("sha"))).alias("sha"))
    if not linked.isEmpty():
        digests = _streamed_digests(linked.select("conv_id", "chunk", "body")).select(F.col("conv_id").alias("c"), F.col("sha").alias("streamed"))
        whole = _null_safe(whole, materialise(digests, "digests"), {"conv_id": "c"}, "left").withColumn("sha", F.coalesce("streamed", "sha"))
    gaps = F.coalesce((F.col("high") - F.col("low") + 1 - F.col("n_turns")).cast("bigint"), F.lit(0).cast("bigint"))
    return whole.select("conv_id", gaps.alias("gaps"), F.col("n_blank").alias("blank"), F.col("n_duplicate").alias("duplicate"), F.col("n_truncated").alias("truncated"),
                        F.col("n_illegal").alias("illegal"), "cost", "audit", F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage: rows (conv_id, turn, role, text, copies) by the crc32 of ``conv_id:turn`` modulo 20; dropped rows have no copies."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(lot == 1, "").when(lot == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    return conversations.select("conv_id", "turn", F.when(lot == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"),
                                F.when(lot == 0, 0).when(lot == 3, 2).otherwise(1).alias("copies"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_digests(repair(damaged(read_table(spark, sf_dir, "conversations")), copies="copies"))

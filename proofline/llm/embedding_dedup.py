"""Near duplicates among embeddings: an exact cosine join by the pigeonhole principle over subspaces.

Unit vectors are rotated to principal axes and split into blocks of few coordinates; each block has a share of the squared
distance that two linked vectors may have, in proportion to its variance. A linked pair keeps within the share of at least one
block, so the union of one range join per block holds every link. A range join deals vectors to the leaves of a k-d tree over the
block: each to its own leaf and, to be compared, to the later leaves that lie within range. A leaf's vectors are held by bucket
and the others stream past them. Coordinates travel as 16-bit integers, so distances in tasks are exact sums: a pair counts in
the first block whose share it keeps (no pair is sent or counted twice), is linked or not where rounding cannot matter, and
is otherwise sent to be measured in double precision. Tasks send counts and one edge per vector, never the pairs of a group.

Dense groups do not enter the blocks: where many sampled vectors lie within half the link angle of one, all that do form a ball, whose
members are linked without being compared; a ball is one node. Others are compared with a ball's members only if the angle to its middle leaves doubt.

Defined results: NULL and zero vectors and those with NULL, NaN or infinite components link with nothing; neither do vectors of unlike
length; equal vectors (also with unlike ids) are one node of which each row is another row's link; NULL ids have no say in a component's id,
which is NULL if all are, and are not kept; repeated rows each get their row; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm.common import materialise, mixed, read_table
from proofline.llm.components import connected_components
from proofline.llm.rotation import principal_axes, proper_vector, sampled

COSINE, BLOCKS = 0.9, 8
#: Vectors held against a stream at once (by estimate); sampled neighbours that make a ball; sampled vectors in a leaf at least.
LEAF, DENSE, FEW = 4096, 16, 8
#: Rotated coordinates are whole multiples of 1 / UNIT.
UNIT = 32_000
#: Vectors that stream past a leaf at once.
STREAM = 256


class Model:
    """What every task knows: axes, blocks with their limits, trees, and balls; its size is bounded by the sample's."""

    def __init__(self, sample: np.ndarray, total: int, size: int, cosine: float, blocks: int, leaf: int, dense: int):
        units = normalised(sample)
        self.axes, variance = principal_axes(units, size)
        count = max(1, min(blocks, size))
        turns = [[*range(count)], [*range(count)][::-1]]                       # dealt to and fro, so that blocks vary alike
        of_axis = np.array([turns[k // count % 2][k % count] for k in range(size)])
        self.blocks = [np.flatnonzero(of_axis == b) for b in range(count)]
        share = np.array([variance[own].sum() for own in self.blocks])
        share = (share + 1e-6 + 1e-3 * share.sum()) / (share + 1e-6 + 1e-3 * share.sum()).sum()
        reach, angle = 2 - 2 * cosine, math.acos(cosine)
        blur = lambda n: math.sqrt(n) / UNIT + 1e-9  # noqa: E731  what rounding may add to a distance over n coordinates
        self.limits = [math.floor(((math.sqrt(reach * s) + blur(len(own))) * UNIT)**2) for s, own in zip(share, self.blocks, strict=True)]
        inner = max(0.0, math.sqrt(reach) - blur(size))
        self.linked, self.apart = math.floor((inner * UNIT)**2) if inner else -1, math.ceil(((math.sqrt(reach) + blur(size)) * UNIT)**2)
        self.close, self.far = math.cos(angle / 2) + 1e-9, (math.cos(1.5 * angle) - 1e-9 if 1.5 * angle < math.pi else -2.0)
        self.balls = dense_balls(units, self.close, dense)
        loose = units[(units @ self.balls.T < self.close).all(axis=1)] if len(self.balls) else units
        codes, self.leaf = self.codes(loose), leaf
        self.trees, self.buckets = zip(*(grown(codes[:, own], total * len(loose) / max(len(units), 1), leaf) for own in self.blocks), strict=True)

    def codes(self, units: np.ndarray) -> np.ndarray:
        return np.rint(units @ self.axes * UNIT).astype(np.int16)

    def groups(self) -> int:
        return sum(map(sum, self.buckets))


def normalised(vectors: np.ndarray) -> np.ndarray:
    if not len(vectors):
        return vectors
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def dense_balls(units: np.ndarray, close: float, dense: int) -> np.ndarray:
    """Middles, greedily by how many sampled vectors not yet covered lie close to them."""
    if not len(units):
        return np.empty((0, units.shape[1] if units.ndim == 2 else 0))
    near = np.concatenate([units[i:i + 512] @ units.T >= close for i in range(0, len(units), 512)])
    free, middles = np.ones(len(units), bool), []
    while True:
        counts = near[:, free].sum(axis=1)
        best = int(counts.argmax())
        if counts[best] < dense:
            return units[middles]
        middles.append(best)
        free &= ~near[best]


def grown(codes: np.ndarray, total: float, leaf: int):
    """A k-d tree, nested (axis, value, left, right) with leaves numbered from 0, and the number of buckets of each leaf."""
    buckets: list[int] = []

    def grow(own):
        expected = total * len(own) / max(len(codes), 1)
        if expected > leaf and len(own) >= 2 * FEW:
            spread = own.astype(np.float64).var(axis=0)
            for axis in np.argsort(-spread).tolist():
                value = int(np.median(own[:, axis]))
                left = own[:, axis] <= value
                if FEW <= left.sum() <= len(own) - FEW:
                    return axis, value, grow(own[left]), grow(own[~left])
        buckets.append(max(1, math.ceil(expected / leaf)))
        return len(buckets) - 1
    return grow(codes), buckets


def home_leaves(codes: np.ndarray, tree) -> np.ndarray:
    found = np.zeros(len(codes), np.int32)

    def go(node, own):
        if isinstance(node, int):
            found[own] = node
            return
        axis, value, left, right = node
        low = codes[own, axis] <= value
        go(left, own[low])
        go(right, own[~low])
    go(tree, np.arange(len(codes)))
    return found


def leaves_in_reach(codes: np.ndarray, tree, limit: int):
    """(leaf, rows) of the rows whose distance to a leaf's box is within the squared limit; the own leaf is among them."""
    plain = codes.astype(np.float64)

    def go(node, own, distance, parts):
        if isinstance(node, int):
            yield node, own
            return
        axis, value, left, right = node
        gap = plain[own, axis] - value
        low, crossing = gap <= 0, distance - parts[:, axis] + gap**2
        within = crossing <= limit
        for child, near in ((left, low), (right, ~low)):
            kept = near | within
            if kept.any():
                moved = parts[kept]
                across = ~near[kept]
                moved[across, axis] = gap[kept][across]**2
                yield from go(child, own[kept], np.where(near, distance, crossing)[kept], moved)
    yield from go(tree, np.arange(len(codes)), np.zeros(len(codes)), np.zeros(codes.shape))


def placed(rows: DataFrame, model, ball_buckets: list[int]) -> DataFrame:
    """(block, leaf, bucket, home, point, ball, n, code): every vector in its own leaf and, to be compared, in later leaves within range.

    Block -1 holds the members of balls, and against them the vectors in doubt about a ball.
    """
    def run(batches):
        m = model.value
        offsets = np.array(ball_buckets, np.int64)
        for batch in batches:
            point, ball, n = (batch.column(k).to_numpy() for k in ("point", "ball", "n"))
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.int16).reshape(len(point), -1)
            lot = mixed(point.astype(np.uint64))
            out: list[tuple] = []                                              # block, leaf, bucket, home, rows

            def send(block, leaf, bucket, home, own, out=out):
                if len(own):
                    out.append((np.full(len(own), block, np.int32), np.full(len(own), leaf, np.int32), np.broadcast_to(np.asarray(bucket, np.int32), len(own)), np.full(len(own), home), own))
            loose = np.flatnonzero(ball < 0)
            for b, own in enumerate(m.blocks):
                part = code[np.ix_(loose, own)]
                home = home_leaves(part, m.trees[b])
                for leaf, inside in leaves_in_reach(part, m.trees[b], m.limits[b]):
                    count = m.buckets[b][leaf]
                    mine, other = inside[home[inside] == leaf], inside[home[inside] < leaf]
                    bucket = (lot[loose[mine]] % np.uint64(count)).astype(np.int64)
                    send(b, leaf, bucket, True, loose[mine])
                    for k in range(count):
                        send(b, leaf, k, False, loose[other])
                        send(b, leaf, k, False, loose[mine[bucket < k]])
            for b in np.unique(ball[ball >= 0]).tolist():
                mine = np.flatnonzero(ball == b)
                send(-1, b, (lot[mine] % np.uint64(offsets[b])).astype(np.int64), True, mine)
            for at, doubts in enumerate(batch.column("doubts").to_pylist()):
                for b in doubts:
                    for k in range(offsets[b]):
                        send(-1, b, k, False, np.array([at]))
            for i in range(0, len(out), 64):
                block, leaf, bucket, home, own = (np.concatenate(x) for x in zip(*out[i:i + 64], strict=True))
                take = pa.array(own)
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(leaf), pa.array(bucket), pa.array(home), *(batch.column(k).take(take) for k in ("point", "ball", "n", "code"))],
                                                 names=["block", "leaf", "bucket", "home", "point", "ball", "n", "code"])
    return rows.mapInArrow(run, "block int, leaf int, bucket int, home boolean, point bigint, ball int, n bigint, code binary")


def squared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All squared distances; codes are whole and small, so sums in doubles are exact in any order."""
    return (left**2).sum(axis=1)[:, None] + (right**2).sum(axis=1) - 2 * left @ right.T


class Holder:
    """The vectors of one bucket, held while others stream past: counts and local components."""

    def __init__(self, model: Model, block: int, leaf: int):
        self.model, self.block, self.leaf, self.parts = model, block, leaf, []
        self.point = None

    def add(self, point, ball, n, code) -> None:
        self.parts.append((point, n, code))

    def close(self) -> list[tuple]:
        """Settles what is held and compares it with itself; returns the pairs in doubt."""
        if self.point is not None or not self.parts:
            return []
        self.point, self.n, code = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.code, self.parts = code.astype(np.float64), []
        self.links, self.label = np.zeros(len(self.point), np.int64), np.arange(len(self.point))
        doubts = []
        if self.block >= 0:
            for i in range(0, len(self.point), STREAM):
                rows, held, sure = self.pairs(self.code[i:i + STREAM], i)
                rows += i
                np.add.at(self.links, rows[sure], self.n[held[sure]])
                np.add.at(self.links, held[sure], self.n[rows[sure]])
                self.union(rows[sure], held[sure])
                doubts.append((self.point[rows[~sure]], self.point[held[~sure]]))
        return doubts

    def pairs(self, code: np.ndarray, after: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, held, sure) of the pairs that this block decides; with ``after`` rows are held ones from there on, and a pair counts once."""
        m = self.model
        if self.block < 0:
            near = np.ones((len(code), len(self.code)), bool)
        else:
            own = m.blocks[self.block]
            near = squared(code[:, own], self.code[:, own]) <= m.limits[self.block]
        if after is not None:
            near &= np.arange(after, after + len(code))[:, None] < np.arange(len(self.code))
        if near.sum() * 16 > near.size:                                        # a dense stretch: whole products, else single pairs
            for b in range(self.block):
                near &= squared(code[:, m.blocks[b]], self.code[:, m.blocks[b]]) > m.limits[b]
            distance = squared(code, self.code)
            rows, held = np.nonzero(near & (distance <= m.apart))
            return rows, held, distance[rows, held] <= m.linked
        rows, held = np.nonzero(near)
        kept = []
        for i in range(0, len(rows), 1 << 14):
            gaps = (code[rows[i:i + (1 << 14)]] - self.code[held[i:i + (1 << 14)]])**2
            fits = gaps.sum(axis=1) <= m.apart
            for b in range(self.block):
                fits &= gaps[:, m.blocks[b]].sum(axis=1) > m.limits[b]
            kept.append(np.stack((rows[i:i + (1 << 14)][fits], held[i:i + (1 << 14)][fits], gaps.sum(axis=1)[fits] <= m.linked)))
        if not kept:
            return rows, held, np.zeros(0, bool)
        rows, held, sure = np.concatenate(kept, axis=1)
        return rows, held, sure.astype(bool)

    def union(self, left: np.ndarray, right: np.ndarray) -> None:
        """Joins the components of held vectors, pair by pair."""
        while len(left) and (a := self.label[left], b := self.label[right]) and (a != b).any():
            parent = np.arange(len(self.label))
            low = np.minimum(a, b)
            np.minimum.at(parent, a, low)
            np.minimum.at(parent, b, low)
            while (parent[parent] != parent).any():
                parent = parent[parent]
            self.label = parent[self.label]

    def nodes(self, which: np.ndarray) -> np.ndarray:
        return np.full(len(which), -1 - self.leaf) if self.block < 0 else self.point[which]

    def stream(self, point, ball, n, code) -> tuple[list[tuple], list[tuple]]:
        """(rows to send, doubts) for vectors that stream past."""
        sent, doubts = [], self.close()
        if self.point is None:
            return sent, doubts
        for i in range(0, len(point), STREAM):
            rows, held, sure = self.pairs(code[i:i + STREAM].astype(np.float64))
            rows = rows + i
            doubts.append((point[rows[~sure]], self.point[held[~sure]]))
            rows, held = rows[sure], held[sure]
            if not len(rows):
                continue
            np.add.at(self.links, held, n[rows])
            links = np.zeros(len(point), np.int64)
            np.add.at(links, rows, self.n[held])
            seen, first = np.unique(rows, return_index=True)
            if self.block >= 0:
                anchor = np.zeros(len(point), np.int64)
                anchor[seen] = held[first]
                self.union(anchor[rows], held)
            sent.append((point[seen], np.where(ball[seen] >= 0, -1 - ball[seen].astype(np.int64), point[seen]), self.nodes(held[first]), links[seen]))
        return sent, doubts

    def end(self) -> tuple[list[tuple], list[tuple]]:
        doubts = self.close()
        if self.point is None:
            return [], doubts
        some = np.flatnonzero(self.links > 0)
        return [(self.point[some], self.nodes(some), self.nodes(self.label[some]), self.links[some])], doubts


def compared(cells: DataFrame, model, tasks: int) -> DataFrame:
    """(point, a, b, links) of sure links: how many a vector has in a cell, and an edge of the nodes a and b; in doubt: points a and b, links NULL."""
    key = ["block", "leaf", "bucket"]

    def run(batches):
        holder, now, sent, doubts = None, None, [], []

        def packed():
            some = [x for x in sent if len(x[0])]
            pairs = [x for x in doubts if len(x[0])]
            none = lambda k: pa.nulls(k, pa.int64())
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*some, strict=True)], names=["point", "a", "b", "links"])
            if pairs:
                a, b = (np.concatenate(x).astype(np.int64) for x in zip(*pairs, strict=True))
                yield pa.RecordBatch.from_arrays([none(len(a)), pa.array(a), pa.array(b), none(len(a))], names=["point", "a", "b", "links"])
            sent.clear()
            doubts.clear()
        for batch in batches:
            block, leaf, bucket, home, point, ball, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(7))
            code = np.frombuffer(b"".join(batch.column(7).to_pylist()), np.int16).reshape(len(point), -1)
            change = np.flatnonzero((np.diff(block) != 0) | (np.diff(leaf) != 0) | (np.diff(bucket) != 0) | (np.diff(home.astype(np.int8)) != 0)) + 1
            for i, j in pairwise([0, *change.tolist(), len(point)]):
                if (at := (int(block[i]), int(leaf[i]), int(bucket[i]))) != now:
                    if holder is not None:
                        for total, more in zip((sent, doubts), holder.end(), strict=True):
                            total += more
                    holder, now = Holder(model.value, at[0], at[1]), at
                rows = point[i:j], ball[i:j], n[i:j], code[i:j]
                if home[i]:
                    holder.add(*rows)
                else:
                    for total, more in zip((sent, doubts), holder.stream(*rows), strict=True):
                        total += more
            yield from packed()
        if holder is not None:
            for total, more in zip((sent, doubts), holder.end(), strict=True):
                total += more
            yield from packed()
    dealt = cells.repartition(max(1, tasks), *key).sortWithinPartitions(*key, F.desc("home"))
    return dealt.mapInArrow(run, "point bigint, a bigint, b bigint, links bigint")


def with_balls(points: DataFrame, model) -> DataFrame:
    """(point, n, ball, doubts, code): the first ball whose middle is close (or -1), and the earlier balls about which the angle leaves doubt."""
    def run(batches):
        m = model.value
        for batch in batches:
            units = normalised(np.array(batch.column(2).to_pylist(), np.float64))
            angles = units @ m.balls.T if len(m.balls) else np.empty((len(units), 0))
            close = angles >= m.close
            ball = np.where(close.any(axis=1), close.argmax(axis=1), -1) if close.shape[1] else np.full(len(units), -1)
            doubt = (angles >= m.far) & (np.arange(close.shape[1]) < np.where(ball < 0, close.shape[1], ball)[:, None])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ball.astype(np.int32)), pa.array([np.flatnonzero(d).tolist() for d in doubt], pa.list_(pa.int32())),
                                              pa.array([c.tobytes() for c in m.codes(units)], pa.binary())], names=["point", "n", "ball", "doubts", "code"])
    return points.select("point", "n", "vector").mapInArrow(run, "point bigint, n bigint, ball int, doubts array<int>, code binary")


def joined(points: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS, leaf: int = LEAF, dense: int = DENSE) -> tuple[DataFrame, DataFrame]:
    """Of distinct vectors (point, n, vector) of one length: (point, node, links), and edges (a, b) between nodes."""
    spark, total = points.sparkSession, points.count()
    sample = sampled(points, "vector", total)
    size = len(points.first()["vector"])
    model = spark.sparkContext.broadcast(Model(sample.reshape(-1, size), total, size, cosine, blocks, leaf, dense))
    rows = materialise(with_balls(points, model), "balls")
    sizes = {r["ball"]: r for r in rows.where("ball >= 0").groupBy("ball").agg(F.count("*").alias("points"), F.sum("n").alias("rows")).collect()}
    buckets = [math.ceil(sizes[b]["points"] / leaf) if b in sizes else 1 for b in range(len(model.value.balls))]
    found = materialise(compared(placed(rows, model, buckets), model, model.value.groups() + sum(buckets)), "compared")
    node = F.when(F.col("ball") >= 0, -1 - F.col("ball").cast("bigint")).otherwise(F.col("point")).alias("node")
    doubts = found.where("links IS NULL").select("a", "b")
    ends = lambda name: points.join(rows.select("point", "ball"), "point").select(F.col("point").alias(name), F.col("n").alias(f"n_{name}"), node.alias(f"node_{name}"), F.col("vector").alias(f"v_{name}"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    measured = doubts.join(ends("a"), "a").join(ends("b"), "b").where(dot("v_a", "v_b") / (F.sqrt(dot("v_a", "v_a")) * F.sqrt(dot("v_b", "v_b"))) >= cosine)
    measured = materialise(measured.select("a", "b", "n_a", "n_b", "node_a", "node_b"), "measured")
    counts = found.where("links IS NOT NULL").select("point", "links").unionByName(measured.select(F.col("a").alias("point"), F.col("n_b").alias("links"))).unionByName(
        measured.select(F.col("b").alias("point"), F.col("n_a").alias("links"))).groupBy("point").agg(F.sum("links").alias("links"))
    facts = spark.createDataFrame([(b, int(r["rows"])) for b, r in sizes.items()], "ball int, held bigint")
    links = rows.select("point", "n", "ball", node).join(F.broadcast(facts), "ball", "left").join(counts, "point", "left").select(
        "point", "node", (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("held") - F.col("n"), F.lit(0))).alias("links"))
    edges = found.where("links IS NOT NULL").select("a", "b").unionByName(measured.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))).where("a <> b").distinct()
    return links, edges


def near_duplicates(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, blocks: int = BLOCKS,
                    leaf: int = LEAF, dense: int = DENSE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row."""
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("vector"))
    proper = proper_vector("vector") & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = materialise(rows.withColumn("proper", proper), "vectors")
    points = rows.where("proper").groupBy("vector").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    points = materialise(points.withColumn("point", F.monotonically_increasing_id()), "points")
    parts = []
    for (size,) in points.select(F.size("vector")).distinct().collect():       # one length, unless the table mixes models
        links, edges = joined(points.where(F.size("vector") == size).select("point", "n", "vector"), cosine, blocks, leaf, dense)
        groups = connected_components(edges)
        named = materialise(links.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")), "links").join(points.select("point", "least"), "point")
        names = named.groupBy("component").agg(F.min("least").alias("component_id"))
        parts.append(named.join(names, "component").select("point", "links", "component_id"))
    alone = rows.where("NOT proper").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = alone
    for part in parts:
        of_point = points.select("point", "n", F.col("vector").alias("same")).join(part, "point")
        found = rows.where("proper").join(of_point, F.col("vector") == F.col("same"))
        out = out.unionByName(found.select("vec_id", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))

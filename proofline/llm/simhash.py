"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by Hamming distance through vantage-point trees.

A tree of vantage points, built on a bounded sample, splits all fingerprints by their distance to the points. At a split,
those within the link radius below the boundary also go to the far side (the triangle inequality: two fingerprints on either
side of a boundary at distance r differ by more than r unless the near one is that close to it), so every linked pair meets
in some leaf. Each leaf is searched by a tree of its own and sends one star per local group, never its pairs.

Defined results: a NULL or empty text has fingerprint zero and is linked like any other; fewer words than a shingle has form
one shingle; repeated rows each get their row; NULL ids have no say in a component's id, which is NULL if all are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm.common import annotate, materialise, read_table
from proofline.llm.components import connected_components

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Fingerprints sampled for the tree, and how many may share a leaf of it (counted in the whole table, by estimate).
SAMPLE, LEAF = 20_000, 400
BLOCK = 192
#: Fingerprints placed by a task, leaves searched by a task.
PLACED, LEAVES_A_TASK = 50_000, 24


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bits set in over half of the shingles' hashes. ASCII capitals are lowered, words are split at ASCII white space."""
    words = text.lower().split()
    if not words:
        return 0
    size = min(shingle, len(words))
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops[size - 1:], strict=False)), np.uint64, len(words) - size + 1)
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        votes += np.unpackbits(hashes[i:i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, print bigint) per row; text_key is a hash of the text, which tells rows of one id apart."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(f"`{text}`").alias("text_key"), F.col(f"`{text}`").alias("text"))
    make = lambda: lambda texts: [[fingerprint(t, shingle) for t in texts]]
    return annotate(rows, "text", make, [("print", "bigint")], keep=["doc_id", "text_key"])


def distance(prints: np.ndarray, point: int) -> np.ndarray:
    return np.bitwise_count(prints ^ np.uint64(point)).astype(np.int16)


def split(prints: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[int, int] | None:
    """A vantage point and boundary: of a few points, the pair with the smallest larger side, counting what goes to both."""
    best, at = len(prints), None
    for point in prints[rng.choice(len(prints), min(8, len(prints)), replace=False)].tolist():
        counts = np.bincount(distance(prints, point), minlength=65).cumsum()
        inside = counts[:64]                                     # at most the boundary
        outside = len(prints) - np.concatenate((np.zeros(radius, np.int64), counts))[1:65]   # more than the boundary - radius
        larger = np.maximum(inside, outside)
        if (m := int(larger.argmin())) is not None and larger[m] < best:
            best, at = int(larger[m]), (int(point), m)
    return at if best < 0.9 * len(prints) else None


def build_tree(sample: np.ndarray, leaf: float, radius: int, seed: int = 7):
    """Nested (point, boundary, inside, outside); leaves are numbers from 0."""
    rng, count = np.random.default_rng(seed), [0]

    def grow(prints, depth):
        at = split(prints, radius, rng) if len(prints) > leaf and depth < 24 else None
        if at is None:
            count[0] += 1
            return count[0] - 1
        d = distance(prints, at[0])
        return (*at, grow(prints[d <= at[1]], depth + 1), grow(prints[d > at[1] - radius], depth + 1))
    return grow(sample, 0)


def leaf_count(tree) -> int:
    return 1 if isinstance(tree, int) else leaf_count(tree[2]) + leaf_count(tree[3])


def leaves_of(prints: np.ndarray, tree, radius: int):
    """(leaf, prints) for every leaf that a fingerprint belongs to."""
    if isinstance(tree, int):
        yield tree, prints
        return
    point, boundary, inside, outside = tree
    d = distance(prints, point)
    if (near := prints[d <= boundary]).size:
        yield from leaves_of(near, inside, radius)
    if (far := prints[d > boundary - radius]).size:
        yield from leaves_of(far, outside, radius)


def local_groups(prints: np.ndarray, radius: int, seed: int = 11) -> list[tuple[int, int]]:
    """Edges that connect what links within ``prints``: fewer than there are prints for each block of a local tree."""
    rng, edges = np.random.default_rng(seed), []

    def search(own):
        at = split(own, radius, rng) if len(own) > BLOCK else None
        if at is not None:
            d = distance(own, at[0])
            search(own[d <= at[1]])
            search(own[d > at[1] - radius])
            return
        group = np.arange(len(own))                              # least place reached so far; blocks of rows against all
        while True:
            before = group.copy()
            for i in range(0, len(own), BLOCK):
                near = np.bitwise_count(own[i:i + BLOCK, None] ^ own[None, :]) <= radius
                group[i:i + BLOCK] = np.where(near, group[None, :], len(own)).min(axis=1)
            group = np.minimum(group, group[group])
            if (group == before).all():
                break
        linked = np.flatnonzero(group != np.arange(len(own)))
        edges.extend(zip(own[linked].tolist(), own[group[linked]].tolist(), strict=True))
    search(prints)
    return edges


def links(prints: DataFrame, *, radius: int = RADIUS, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct fingerprints (column ``print``) linked within ``radius``."""
    spark = prints.sparkSession
    total = prints.count()
    share = int((1 << 30) * min(1.0, sample / max(total, 1)))
    some = prints.where(F.pmod(F.xxhash64("print"), F.lit(1 << 30)) < share).collect()     # about ``sample`` rows, by hash
    tree = build_tree(np.array([r[0] for r in some], np.int64).view(np.uint64), leaf * min(1.0, sample / max(total, 1)), radius)
    shared = spark.sparkContext.broadcast(tree)                  # at most twice as many splits as sampled fingerprints

    def place(frames):
        for frame in frames:
            found = list(leaves_of(frame["print"].to_numpy(np.int64).view(np.uint64), shared.value, radius))
            if not found:
                continue
            sizes = [len(own) for _, own in found]
            yield pd.DataFrame({"leaf": np.repeat(np.array([n for n, _ in found], np.int32), sizes), "print": np.concatenate([own for _, own in found]).view(np.int64)})

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        own = np.sort(frame["print"].to_numpy(np.int64)).view(np.uint64)
        edges = np.array(local_groups(own, radius), np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": edges[:, 0], "b": edges[:, 1]})

    # numbers are small but work is not: tasks are counted in fingerprints and leaves, not in bytes
    spread = prints.repartition(max(1, total // PLACED), "print").mapInPandas(place, "leaf int, print bigint")
    return spread.repartition(max(1, leaf_count(tree) // LEAVES_A_TASK), "leaf").groupBy("leaf").applyInPandas(meet, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text_key, print, component, component_id) per row: component_id is the least doc_id reachable over links, its own included;
    component is the least fingerprint reachable, which tells apart groups whose least id is that of rows with unlike texts.

    Equal fingerprints are one node, so copies of any number cost one row after their first aggregation.
    """
    rows = materialise(fingerprints(docs, doc_id=doc_id, text=text, shingle=shingle), "fingerprints")
    nodes = materialise(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "fingerprints")
    groups = connected_components(links(nodes.select("print"), radius=radius))
    named = groups.join(nodes.withColumnRenamed("print", "node"), "node")
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_print = named.join(names, "component").select(F.col("node").alias("print"), "component", "component_id")
    of_print = nodes.join(of_print, "print", "left").select("print", F.coalesce("component", "print").alias("component"), F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(materialise(of_print, "fingerprints"), "print").select("doc_id", "text_key", "print", "component", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")

"""Clustering around centroids in whole numbers, with PCA-rotated filtering.

Vectors are fixed-point integers. Once, each is stored with its leading coordinates on the principal axes and the norm of the
rest. In a round, the distance of the leading coordinates plus the squared difference of the rest norms is a lower bound of the
distance to each centroid; the centroid of least bound is measured first, and only those whose bound does not exceed that
distance are verified, all in integers. Sums per centroid are exact, so a round gives the same centroids on any partitioning.

Defined results: vectors of another length, NULL, or with NULL, NaN or infinite components are left out; ties go to the smaller
number; fewer vectors than centroids give as many centroids as vectors; repeated rows each count and each get their row; NULL ids
hash as the empty text; components so large that int64 could overflow are computed with unbounded integers (a distance beyond a
long is returned as the largest long); extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm.common import materialise, read_table
from proofline.llm.rotation import principal_axes, proper_vector, sampled

SCALE, SIZE, CLUSTERS, ROUNDS, SEED = 1024, 64, 8, 10, 3
#: Rotated coordinates kept; components up to which 64 squared differences fit in 64 bits.
LEADING, SAFE = 16, 1 << 27
LARGEST = (1 << 63) - 1


def whole_numbers(vectors: np.ndarray, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) as int64, and which rows are too large for that (theirs are unusable)."""
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(vectors * scale)
        large = ~(np.abs(scaled) < SAFE).all(axis=1)
        return np.where(large[:, None], 0, scaled).astype(np.int64), large


def exact_numbers(vector, scale: int = SCALE) -> list[int]:
    """The same for one vector in unbounded integers; scale is a power of two, so the product is exact unless it overflows."""
    found = []
    for x in map(float, vector):
        top, bottom = x.as_integer_ratio()
        found.append(scale * top // bottom)
    return found


class Centroids:
    """Centroids as integers, with what the bounds need."""

    def __init__(self, values: list[list[int]], axes: np.ndarray):
        self.values = values
        self.large = any(abs(x) >= SAFE for row in values for x in row)
        self.whole = np.array([[0 if self.large else x for x in row] for row in values], np.int64)
        with np.errstate(all="ignore"):
            plain = np.array([[float(min(max(x, -(10**300)), 10**300)) for x in row] for row in values])
            self.lead = plain @ axes[:, :LEADING]
            self.squares = (plain**2).sum(axis=1)
            self.rest = np.sqrt(np.maximum(self.squares - (self.lead**2).sum(axis=1), 0))

    def nearest(self, whole: np.ndarray, lead: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of the nearest centroid to each row, and how many distances were verified."""
        squares = (lead**2).sum(axis=1) + rest**2
        bounds = squares[:, None] - rest[:, None]**2 + (self.lead**2).sum(axis=1) - 2 * lead @ self.lead.T + (rest[:, None] - self.rest)**2
        bounds -= 1e-9 * (squares[:, None] + self.squares + 1)              # more than rounding can add
        rows, first = np.arange(len(whole)), bounds.argmin(axis=1)
        distance = ((whole - self.whole[first])**2).sum(axis=1)
        best, number, verified = distance.copy(), first.copy(), len(whole)
        for c in range(len(self.values)):
            close = rows[(first != c) & ~(bounds[:, c] > distance)]
            verified += len(close)
            found = ((whole[close] - self.whole[c])**2).sum(axis=1)
            better = (found < best[close]) | ((found == best[close]) & (c < number[close]))
            best[close[better]], number[close[better]] = found[better], c
        return number, best, verified

    def nearest_exact(self, vector: list[int]) -> tuple[int, int]:
        return min(((sum((x - y)**2 for x, y in zip(vector, c, strict=True)), k) for k, c in enumerate(self.values)))[::-1]


def prepared(vectors: DataFrame, vec_id: str, embedding: str, axes_sample: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, whole, lead, rest, exact) of the proper vectors, written once, and the axes; arrays travel as bytes.

    ``exact`` holds decimal components where ``whole`` would overflow.
    """
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("embedding")).where(proper_vector("embedding", SIZE))
    rows = materialise(rows, "vectors")
    axes, _ = principal_axes(sampled(rows, "embedding", rows.count(), *([axes_sample] if axes_sample else [])), SIZE)
    lead_axes = axes[:, :LEADING]
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, whole binary, lead binary, rest double, exact array<string>"

    def run(batches):
        for batch in batches:
            plain = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE)
            whole, large = whole_numbers(plain)
            numbers = whole.astype(np.float64)
            lead = numbers @ lead_axes
            rest = np.sqrt(np.maximum((numbers**2).sum(axis=1) - (lead**2).sum(axis=1), 0))
            exact = [[str(x) for x in exact_numbers(plain[i])] if big else None for i, big in enumerate(large)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in whole], pa.binary()), pa.array([r.tobytes() for r in lead], pa.binary()),
                                              pa.array(rest), pa.array(exact, pa.list_(pa.string()))], names=["vec_id", "whole", "lead", "rest", "exact"])
    return materialise(rows.mapInArrow(run, schema), "rotated"), axes


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    unpack = lambda name, kind, width: np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(-1, width)
    return unpack("whole", np.int64, SIZE), unpack("lead", np.float64, LEADING), batch.column("rest").to_numpy()


def assigned(rows: DataFrame, centroids: Centroids) -> DataFrame:
    """(vec_id, cluster, distance) of each prepared vector."""
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, cluster int, distance bigint"

    def run(batches):
        for batch in batches:
            number, distance = _nearest(batch, centroids)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number.astype(np.int32)), pa.array([min(d, LARGEST) for d in distance.tolist()], pa.int64())],
                                             names=["vec_id", "cluster", "distance"])
    return rows.mapInArrow(run, schema)


def _nearest(batch: pa.RecordBatch, centroids: Centroids) -> tuple[np.ndarray, np.ndarray]:
    whole, lead, rest = _arrays(batch)
    exact = batch.column("exact")
    if not centroids.large and exact.null_count == len(exact):
        return centroids.nearest(whole, lead, rest)[:2]
    found = [centroids.nearest_exact([int(x) for x in big] if big else w) for big, w in zip(exact.to_pylist(), whole.tolist(), strict=True)]
    return np.array([n for n, _ in found], np.int64), np.array([d for _, d in found], object)


def moved(rows: DataFrame, centroids: Centroids) -> dict[int, list[int]]:
    """The next centroid of each that has vectors: sums add up in tasks, then in one small table, and one row per centroid reaches the driver."""
    def partial(batches):
        counts, sums = {}, {}
        for batch in batches:
            number, _ = _nearest(batch, centroids)
            whole, exact = _arrays(batch)[0], batch.column("exact")
            for c in np.unique(number).tolist():
                counts[c] = counts.get(c, 0) + int((number == c).sum())
                sums[c] = [a + b for a, b in zip(sums.get(c, [0] * SIZE), whole[number == c].sum(axis=0).tolist(), strict=True)]
            if exact.null_count < len(exact):
                for c, big in zip(number.tolist(), exact.to_pylist(), strict=True):
                    if big:
                        sums[c] = [a + int(b) for a, b in zip(sums[c], big, strict=True)]
        kept = sorted(counts)
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array([counts[c] for c in kept], pa.int64()), pa.array([[str(x) for x in sums[c]] for c in kept], pa.list_(pa.string())),
                                          pa.array([TaskContext.get().partitionId() % 64] * len(kept), pa.int32())], names=["cluster", "n", "sums", "part"])

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        total = [str(sum(map(int, column))) for column in zip(*frame["sums"], strict=True)]
        return pd.DataFrame({"cluster": frame["cluster"].iloc[:1].astype("int32"), "n": [int(frame["n"].sum())], "sums": [total], "part": pd.array([0], "int32")})
    schema = "cluster int, n bigint, sums array<string>, part int"
    parts = rows.mapInArrow(partial, schema).groupBy("cluster", "part").applyInPandas(merge, schema)
    merged = parts.groupBy("cluster").applyInPandas(merge, schema)                     # 64 rows a centroid at most
    return {r["cluster"]: [int(s) // r["n"] for s in r["sums"]] for r in merged.collect()}


def first_centroids(rows: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors whose ids have the least SHA-256 of ``seed:id``, in that order; equal ids by their components."""
    lot = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    found = rows.select(lot.alias("lot"), "whole", "exact").orderBy("lot", "whole", "exact").limit(clusters).collect()
    return [[int(x) for x in r["exact"]] if r["exact"] else np.frombuffer(bytes(r["whole"]), np.int64).tolist() for r in found]


def cluster(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
            seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) per proper vector, and the final centroids (lists of integers)."""
    rows, axes = prepared(vectors, vec_id, embedding)
    values = first_centroids(rows, clusters, seed)
    for _ in range(rounds if values else 0):
        found = moved(rows, Centroids(values, axes))
        values = [found.get(c, value) for c, value in enumerate(values)]
    if not values:
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), values
    return materialise(assigned(rows, Centroids(values, axes)), "assigned"), values


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, values = cluster(read_table(spark, sf_dir, "embeddings"))
    names = [(c, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(values)]
    per = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()     # one row per centroid
    bounded = lambda x: int(min(x, LARGEST))
    total = bounded(sum(int(r["own"]) for r in per))
    inertia = {r["cluster"]: bounded(int(r["own"])) for r in per}
    facts = spark.createDataFrame([(c, inertia.get(c, 0), total, name) for c, name in names], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def clusters_sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """The same for a second engine: every round spelled out as tables of components."""
    nearest = lambda r: f"""d{r} AS MATERIALIZED (SELECT vec_id, c AS cluster, d AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS k FROM (
  SELECT v.vec_id, m.c, sum((v.x - m.x) * (v.x - m.x)) AS d FROM v JOIN m{r} m ON m.i = v.i GROUP BY v.vec_id, m.c)) WHERE k = 1)"""  # noqa: E731
    moved_to = lambda r: f"""m{r + 1} AS MATERIALIZED (SELECT m.c, m.i, coalesce(s.x, m.x) AS x FROM m{r} m LEFT JOIN (
  SELECT c, i, (t - ((t % n) + n) % n) // n AS x FROM (SELECT d.cluster AS c, v.i, sum(v.x) AS t, count(*) AS n FROM v JOIN d{r} d USING (vec_id) GROUP BY ALL)) s ON s.c = m.c AND s.i = m.i)"""  # noqa: E731
    steps = ",\n".join(f"{nearest(r)},\n{moved_to(r)}" for r in range(rounds))
    return f"""WITH e AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, x -> x IS NOT NULL AND isfinite(x))) = {SIZE}),
v AS MATERIALIZED (SELECT vec_id, unnest(range(1, {SIZE + 1})) AS i, CAST(floor({SCALE} * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM e),
seeds AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR))) - 1 AS c FROM e),
m0 AS MATERIALIZED (SELECT CAST(c AS INTEGER) AS c, i, CAST(x AS HUGEINT) AS x FROM v JOIN seeds USING (vec_id) WHERE c < {clusters}),
{steps},
{nearest(rounds)}
SELECT vec_id, cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM d{rounds} JOIN (SELECT c AS cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM m{rounds} GROUP BY c) USING (cluster)"""

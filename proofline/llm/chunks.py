"""Long texts as overlapping chunks, and where the pre-tokens of neighbouring chunks resynchronise."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofline.llm.bpe import CONTEXT
from proofline.llm.common import materialise, text_slices

CHUNK, OVERLAP = 1 << 16, 512
PIECES = "key string, overlap int, part int, parts int, begin bigint, piece string"


def _cut(texts: DataFrame, chunk: int) -> DataFrame:
    """Rows (key, overlap, part, parts, begin, piece): part i starts at i * chunk and runs ``overlap`` characters into the next."""
    def run(batches):
        for batch in batches:
            for key, overlap, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                size = max(chunk, 4 * overlap)
                parts = max(1, -(-len(text) // size))
                for i in range(parts):
                    row = [[key], [overlap], [i], [parts], [i * size], [text[i * size:(i + 1) * size + overlap]]]
                    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)],
                                                     names=["key", "overlap", "part", "parts", "begin", "piece"])
    return texts.mapInArrow(run, PIECES)


def _scan(chunks: DataFrame, make: Callable[[], Callable]) -> DataFrame:
    """Narrow rows: per part its length and weight, and the ends that may meet a neighbour's, with the weight before each.

    ``tail`` holds the ends in the overlap with the next part of which this part is sure, ``head`` those in the overlap with the
    part before, both as places of the whole text.
    """
    def run(batches):
        work = make()
        for whole in batches:
            for batch in text_slices(whole, "piece"):
                out = [[] for _ in range(6)]
                for o, b, t in zip(*(batch.column(i).to_pylist() for i in (1, 4, 5)), strict=True):
                    ends, weights = (np.asarray(x, np.int64) for x in work(t))
                    before = np.cumsum(weights)
                    sure = ends <= len(t) - CONTEXT
                    head, tail = sure & (ends <= o), sure & (ends > len(t) - o)
                    for place in np.flatnonzero(head | tail).tolist():   # how white space splits depends on what follows it
                        if t[ends[place] - 1].isspace():
                            head[place] = tail[place] = False
                    for column, value in zip(out, (len(t), int(weights.sum()), ends[head] + b, before[head], ends[tail] + b, before[tail]), strict=True):
                        column.append(value)
                arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), *(pa.array(v, pa.list_(pa.int64())) for v in out[2:])]
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], *arrays], names=[*batch.schema.names[:5], "length", "weight", "head", "head_weight", "tail", "tail_weight"])

    return chunks.mapInArrow(run, "key string, overlap int, part int, parts int, begin bigint, length bigint, weight bigint, head array<bigint>, "
                                  "head_weight array<bigint>, tail array<bigint>, tail_weight array<bigint>")


def _cuts(scanned: DataFrame) -> DataFrame:
    """Where each part's true range begins and ends, its weight there, and whether its text has to be cut anew."""
    order = Window.partitionBy("key").orderBy("part")
    last = F.col("part") == F.col("parts") - 1
    met = scanned.withColumn("meet", F.array_min(F.array_intersect("tail", F.lead("head").over(order))))
    met = met.withColumns({"from": F.lag("meet").over(order), "lost": F.max((~last & F.col("meet").isNull()).cast("int")).over(Window.partitionBy("key"))})
    at = lambda weights, places, place: F.get(weights, F.array_position(places, F.col(place)).cast("int") - 1)
    return met.select("key", "overlap", "part", "lost", F.coalesce(F.col("from") - F.col("begin"), F.lit(0)).cast("int").alias("from_at"),
                      F.when(last, F.col("length")).otherwise(F.col("meet") - F.col("begin")).cast("int").alias("to_at"),
                      (F.when(last, F.col("weight")).otherwise(at("tail_weight", "tail", "meet")) - F.coalesce(at("head_weight", "head", "from"), F.lit(0))).alias("weight"))


def spliced_chunks(texts: DataFrame, make: Callable[[], Callable], chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[DataFrame, DataFrame]:
    """Texts (``key``, ``text``; rows of one key are equal) in parts that begin and end at true pre-token boundaries.

    ``make`` runs once in a task and returns a function from a piece to the places where its pre-tokens end, counted from
    the piece's start, and their weights.
    A scan may start inside a pre-token, so its first ends may be false. They are true from the first place on at which the
    part before, itself true there, ends a pre-token too, because what follows a boundary depends on the text from there only.
    Ends within ``CONTEXT`` of a piece's end are not trusted, as they may need text beyond it; nor are ends after white space, as a part
    that ends there would split its white space otherwise. Texts whose neighbours share no
    trusted end are cut again with an overlap four times as wide, until one part holds all.

    Returns the pieces (key, overlap, part, piece) and, on the same keys, from_at and to_at, the true range within a piece, and weight, its sum there.
    """
    waiting, pieces, cuts = texts.select("key", F.lit(overlap).alias("overlap"), "text"), None, None
    while True:
        chunks = materialise(_cut(waiting, chunk).dropDuplicates(["key", "part"]), "chunks")
        found = materialise(_cuts(_scan(chunks, make)), "chunks")
        good = found.where("lost = 0").drop("lost")
        own = chunks.select("key", "overlap", "part", "piece")
        pieces, cuts = (own, good) if cuts is None else (pieces.unionByName(own), cuts.unionByName(good))
        again = found.where("lost = 1").select("key", "overlap").distinct()
        if again.isEmpty():
            return pieces, cuts
        waiting = materialise(again.join(texts, "key").select("key", (4 * F.col("overlap")).alias("overlap"), "text").dropDuplicates(["key"]), "chunks")

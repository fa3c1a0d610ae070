"""Suffix-array dedup on bytes: every byte covered by a string of a given width that also starts elsewhere goes.

Segments of text that share a content anchor (see ``repeats``) form shards; the suffixes of a shard are ordered by induced
sorting, and permuted common prefixes of at least the width mark the repeats. Segments equal as a whole collapse to one row
before that. Groups with more distinct segments than one task should sort are settled by two 64-bit hashes of each window, counted with
map-side combination, so no group of any size meets in one task.

Defined results: a NULL or empty text has no bytes; shorter texts than the width keep all; repeated rows are copies of each
other, so each loses what is at least ``width`` long; matches never cross rows; only the id and text columns are read.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm.common import covered, materialise, mixed, read_table, runs_of, text_slices, window_hashes
from proofline.llm.repeats import gather_ranges, identified, repeated_segments, with_ranges
from proofline.llm.suffix_array import repeated_starts

#: Anchors are half a string long: segments that share one are likely to share whole strings, so few are sorted in vain.
WIDTH, GRAM = 400, 200
#: Bytes sorted at once, and distinct segments of one anchor that may be sorted together.
SHARD_BYTES, GROUP = 1 << 20, 300
LETTERS = mixed(np.arange(1, 257, dtype=np.uint64))
OTHER_LETTERS = mixed(np.arange(1001, 1257, dtype=np.uint64))


def byte_codes():
    return lambda text: LETTERS[np.frombuffer(text, np.uint8)]


def segment_bytes(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The bytes of segments given by doc_id, text_key, start, n, with their other columns: one row each."""
    rest = [c for c in wanted.columns if c not in ("doc_id", "text_key")]
    packed = wanted.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct(*rest)).alias("wanted"))
    own = packed.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "wanted")
    texts = rows.dropDuplicates(["doc_id", "text_key"]).join(own, rows["doc_id"].eqNullSafe(F.col("d")) & (rows["text_key"] == F.col("t"))).select("doc_id", "text_key", "text", "wanted")
    kind = rows.schema["doc_id"].dataType.simpleString()
    kinds = ", ".join(f"{c} {wanted.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches):
        for whole in batches:
            for batch in text_slices(whole, "text", 1 << 20):
                raw, lists = batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3)
                inner = lists.flatten()
                at = np.repeat(np.arange(len(raw)), np.diff(lists.offsets.to_numpy()))
                starts, counts = inner.field("start").to_pylist(), inner.field("n").to_pylist()
                parts = [raw[i][a:a + n + width - 1] for i, a, n in zip(at.tolist(), starts, counts, strict=True)]
                place = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(place), batch.column(1).take(place), *(inner.field(c) for c in rest), pa.array(parts, pa.binary())],
                                                 names=["doc_id", "text_key", *rest, "bytes"])
    return texts.mapInArrow(run, f"doc_id {kind}, text_key bigint, {kinds}, bytes binary")


def sorted_repeats(parts: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_key, start, end) of repeats found by sorting each ``shard`` of segments."""
    kind = parts.schema["doc_id"].dataType.simpleString()

    def sort(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for i, hit in enumerate(repeated_starts([bytes(b) for b in frame["bytes"]], width)):
            if not frame["whole"].iat[i]:
                begins, ends = runs_of(hit)
                out += [(i, a, b) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
        at = np.array(out, np.int64).reshape(-1, 3)
        chosen = frame.iloc[at[:, 0]]
        start = chosen["start"].to_numpy()
        return pd.DataFrame({"doc_id": chosen["doc_id"].array, "text_key": chosen["text_key"].to_numpy(), "start": (start + at[:, 1]).astype(np.int32), "end": (start + at[:, 2] + width - 1).astype(np.int32)})
    return parts.select("shard", "doc_id", "text_key", "start", "whole", "bytes").groupBy("shard").applyInPandas(sort, f"doc_id {kind}, text_key bigint, start int, end int")


def counted_repeats(parts: DataFrame, width: int) -> DataFrame:
    """The same for groups too large to sort together: windows as two hashes, those that occur more than once."""
    kind = parts.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i, raw in enumerate(batch.column(4).to_pylist()):
                own = np.frombuffer(raw, np.uint8)
                first, second = window_hashes(LETTERS[own], width), window_hashes(OTHER_LETTERS[own], width)
                n, at = len(first), pa.array(np.full(len(first), i))
                starts = batch.column(2)[i].as_py() + np.arange(n, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(starts.astype(np.int32)), batch.column(3).take(at), pa.array(first.view(np.int64)), pa.array(second.view(np.int64))],
                                                 names=["doc_id", "text_key", "start", "whole", "w1", "w2"])
    windows = parts.select("doc_id", "text_key", "start", "whole", "bytes").mapInArrow(run, f"doc_id {kind}, text_key bigint, start int, whole boolean, w1 bigint, w2 bigint")
    windows = materialise(windows, "windows")
    twice = windows.groupBy("w1", "w2").count().where("count > 1").select("w1", "w2")
    return windows.where("NOT whole").join(twice, ["w1", "w2"], "left_semi").select("doc_id", "text_key", "start", (F.col("start") + width).alias("end"))


def repeated_ranges(rows: DataFrame, width: int = WIDTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, group: int = GROUP) -> DataFrame:
    """(doc_id, text_key, start, end) in bytes: ranges covered by strings of ``width`` bytes that also start elsewhere."""
    live = repeated_segments(rows, byte_codes, width, gram)
    place = F.struct("doc_id", "text_key", "start", "n")
    unlike = materialise(live.groupBy("anchor", "segment").agg(F.count("*").alias("copies"), F.min(place).alias("first"), F.max("inner").alias("inner")), "segments")
    equal = unlike.where("copies > 1").select("anchor", "segment")
    whole = live.join(equal, ["anchor", "segment"], "left_semi").select("doc_id", "text_key", "start", (F.col("start") + F.col("n") + (width - 1)).alias("end"))
    groups = unlike.groupBy("anchor").agg(F.count("*").alias("k"), F.max("inner").alias("inner"), F.sum(F.col("first.n") + (width - 1)).alias("bytes"),
                                           F.min("copies").alias("fewest")).where("fewest = 1 AND (k > 1 OR inner)")   # where all have copies, all is settled
    groups = materialise(groups.select("anchor", "k", "bytes"), "segments")
    total = groups.where(F.col("k") <= group).agg(F.sum("bytes")).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    wanted = unlike.join(groups, "anchor").select("first.*", "anchor", "k", (F.col("copies") > 1).alias("whole"))
    parts = materialise(segment_bytes(rows, wanted, width), "segments")
    few = parts.where(F.col("k") <= group).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    many = parts.where(F.col("k") > group)
    return whole.union(sorted_repeats(few, width)).union(counted_repeats(many, width))


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) per row; n_spans counts maximal removed runs."""
    rows = identified(docs, doc_id, text)
    ranges = gather_ranges(repeated_ranges(rows, width, gram, **options))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for batch in text_slices(whole, "text"):
                out = [[], [], [], []]
                for raw, begin, end in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    raw = raw or b""
                    kept, removed, spans, at = [], 0, 0, 0
                    if begin:
                        for a, b in zip(*(x.tolist() for x in runs_of(covered(begin, end, len(raw)))), strict=True):
                            kept.append(raw[at:a])
                            removed, spans, at = removed + b - a, spans + 1, b
                    kept.append(raw[at:])
                    for column, value in zip(out, (len(raw), removed, spans, b"".join(kept)), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.int64()) for v in out[:3]), pa.array(out[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
    return with_ranges(rows, ranges).select("doc_id", "text", "starts", "ends").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("has_repeat"))

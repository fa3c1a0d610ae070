"""Substring dedup on words: every word covered by a window of words that also starts earlier goes.

Anchor blocks are indexed and every rolling window probes them; a hit is extended over its whole segment if that has occurred
before, else window by window. Earlier means a smaller id (NULL first, rows of one id by their text's hash), or the same text at
an earlier start; windows are judged on the input.

Defined results: a NULL or empty text has no words; a text shorter than a window keeps all; repeated rows of one id and text are
one document and get equal results; only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm.common import covered, materialise, read_table, text_slices, window_hashes
from proofline.llm.repeats import gather_ranges, identified, repeated_segments, with_ranges

WINDOW, BLOCK = 20, 6


def word_codes():
    """A function from a text to one 64-bit code per word; codes depend on the word alone."""
    known: dict[bytes, int] = {}
    digest = xxhash.xxh3_64_intdigest

    def codes(text: bytes) -> np.ndarray:
        words = text.split()
        if len(known) > 400_000:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = digest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    return codes


def window_rows(texts: DataFrame, window: int) -> DataFrame:
    """(doc_id, text_key, start, w1, w2) for the windows of the given segments: ``starts`` and ``ends`` bound their first words."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches):
        coded = word_codes()
        for whole in batches:
            for batch in text_slices(whole, "text"):
                places, starts, first, second = [], [], [], []
                for i, (text, begin, end) in enumerate(zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                    own = coded(text or b"")
                    at = np.flatnonzero(covered(begin, end, len(own)))
                    places.append(np.full(len(at), i))
                    starts.append(at)
                    first.append(window_hashes(own, window)[at])
                    second.append(window_hashes(own + np.uint64(0x5851F42D4C957F2D), window)[at])
                if places:
                    at = pa.array(np.concatenate(places))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(starts).astype(np.int32)),
                         pa.array(np.concatenate(first).view(np.int64)), pa.array(np.concatenate(second).view(np.int64))],
                        names=["doc_id", "text_key", "start", "w1", "w2"])
    return texts.select("doc_id", "text_key", "text", "starts", "ends").mapInArrow(run, f"doc_id {kind}, text_key bigint, start int, w1 bigint, w2 bigint")


def repeated_ranges(rows: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_key, start, end) in words: ranges covered by windows that have occurred earlier."""
    place = F.struct("doc_id", "text_key", "start")
    live = repeated_segments(rows, word_codes, window, block)
    first = materialise(live.groupBy("anchor", "segment").agg(F.min(place).alias("first"), F.max("inner").alias("inner")), "segments")
    again = live.join(first, ["anchor", "segment"]).where(place != F.col("first"))
    whole = again.select("doc_id", "text_key", "start", (F.col("start") + F.col("n") + (window - 1)).alias("end"))
    # first occurrences of segments that share their anchor with another, or repeat within: their windows are compared one by one
    shared = first.groupBy("anchor").agg(F.count("*").alias("k"), F.max("inner").alias("inner")).where("k > 1 OR inner").select("anchor")
    several = first.join(shared, "anchor", "left_semi").select("anchor", "segment", "first")
    opened = live.join(several, ["anchor", "segment"]).where(place == F.col("first")).select("doc_id", "text_key", "start", (F.col("start") + F.col("n")).alias("end"))
    texts = with_ranges(rows, gather_ranges(opened.distinct())).where("starts IS NOT NULL").dropDuplicates(["doc_id", "text_key"])
    windows = materialise(window_rows(texts, window), "windows")
    earliest = windows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    single = windows.join(earliest, ["w1", "w2"]).where(place != F.col("first"))
    return whole.union(single.select("doc_id", "text_key", "start", (F.col("start") + window).alias("end")))


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) per row: kept is the text without repeats, words joined by one space."""
    rows = identified(docs, doc_id, text)
    ranges = gather_ranges(repeated_ranges(rows, window, block))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for batch in text_slices(whole, "text"):
                out = [[], [], []]
                for raw, begin, end in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    words = (raw or b"").split()
                    gone = covered(begin, end, len(words)) if begin else np.zeros(len(words), bool)
                    kept = words if not begin else [words[i] for i in np.flatnonzero(~gone).tolist()]
                    for column, value in zip(out, (len(words), int(gone.sum()), b" ".join(kept)), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()).cast(pa.string())],
                                                 names=["doc_id", "n_words", "n_removed", "kept"])
    return with_ranges(rows, ranges).select("doc_id", "text", "starts", "ends").mapInArrow(run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))

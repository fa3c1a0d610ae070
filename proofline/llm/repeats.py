"""Exact repeats across a corpus: fixed-length windows, grouped by content anchors.

A window of L tokens is filed under its anchor, the least hash among its grams of k tokens. Equal windows have equal anchors,
so repeats meet by an equality join on one number per run of windows (a *segment*: consecutive windows of one anchor), about
2 / (L - k + 2) segments a token, instead of one row per window. Anchors seen once are dropped by a count that combines on
the map side; segments that are equal as a whole collapse to one row, so a group of copies costs one comparison.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import materialise, sliding_minimum, text_slices, window_hashes

#: Windows in a segment at most, so that equal stretches of repetitive text fall into equal pieces.
RUN = 256
#: Tokens of a text at once (and per packed place); longer texts are cut into spans that overlap by a window.
Codes = Callable[[bytes], np.ndarray]


def segments(codes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window, number of windows and "may repeat within itself" of each segment, given a 64-bit code per token."""
    if len(codes) < window:
        none = np.empty(0, np.int64)
        return none.view(np.uint64), none, none, none.astype(bool)
    grams, width = window_hashes(codes, gram), window - gram + 1
    least = sliding_minimum(grams, width)
    # a gram is an anchor's place if some window around it has it as its least; two places may lie in one segment
    none = np.zeros(width - 1, np.uint64)
    values = grams[~sliding_minimum(~np.concatenate((none, least, none)), width) == grams]
    values.sort()
    double = values[1:][values[1:] == values[:-1]]
    starts = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    counts = np.diff(np.append(starts, len(least)))
    if counts.max() > RUN:
        pieces = -(-counts // RUN)
        number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        ends = np.repeat(starts + counts, pieces)
        starts = np.repeat(starts, pieces) + number * RUN
        counts = np.minimum(RUN, ends - starts)
    anchors = least[starts]
    inner = np.isin(anchors, double) if len(double) else np.zeros(len(anchors), bool)
    return anchors, starts, counts, inner


def identified(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text_key, text): text_key tells rows of one id apart by their text; it is 0 wherever ids are unique."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    unique = has_unique_ids(rows)
    return rows.select("doc_id", (F.lit(0).cast("bigint") if unique else F.xxhash64("text")).alias("text_key"), "text")


def has_unique_ids(rows: DataFrame, doc_id: str = "doc_id") -> bool:
    return rows.groupBy(F.col(f"`{doc_id}`")).count().where("count > 1").isEmpty()


def scan_segments(rows: DataFrame, codes: Callable[[], Codes], window: int, gram: int, content: bool) -> DataFrame:
    """Segments of every text: anchor, and with ``content`` doc_id, text_key, start, n, the segment's own hash and inner.

    Without ``content``, an anchor comes twice where its segment may repeat a window within itself.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"anchor bigint, doc_id {kind}, text_key bigint, start int, n int, segment bigint, inner boolean" if content else "anchor bigint"

    def run(batches):
        coded = codes()
        for whole in batches:
            for batch in text_slices(whole, "text"):
                anchors, places, starts, counts, hashes, inners = [], [], [], [], [], []
                for i, text in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                    own = coded(text or b"")
                    least, begin, n, inner = segments(own, window, gram)
                    anchors.append(least)
                    if not content:
                        anchors.append(least[inner])
                    elif len(begin):
                        inners.append(inner)
                        raw, size = memoryview(own.tobytes()), own.itemsize
                        hashes.append(np.fromiter((xxhash.xxh3_64_intdigest(raw[a * size:(a + c + window - 1) * size]) for a, c in zip(begin.tolist(), n.tolist(), strict=True)), np.uint64, len(begin)))
                        places.append(np.full(len(begin), i))
                        starts.append(begin)
                        counts.append(n)
                anchor = pa.array(np.concatenate(anchors).view(np.int64)) if anchors else pa.array([], pa.int64())
                if not content:
                    yield pa.RecordBatch.from_arrays([anchor], names=["anchor"])
                elif places:
                    at = pa.array(np.concatenate(places))
                    yield pa.RecordBatch.from_arrays(
                        [anchor, batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(starts).astype(np.int32)),
                         pa.array(np.concatenate(counts).astype(np.int32)), pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(inners))],
                        names=["anchor", "doc_id", "text_key", "start", "n", "segment", "inner"])
    return rows.mapInArrow(run, schema)


def repeated_segments(rows: DataFrame, codes: Callable[[], Codes], window: int, gram: int) -> DataFrame:
    """The segments whose anchor occurs at least twice: all that can hold a repeated window."""
    twice = scan_segments(rows, codes, window, gram, False).groupBy("anchor").count().where("count > 1").select("anchor")
    return materialise(scan_segments(rows, codes, window, gram, True).join(twice, "anchor", "left_semi"), "segments")


def gather_ranges(ranges: DataFrame) -> DataFrame:
    """(doc_id, text_key, starts, ends) from ranges (doc_id, text_key, start, end), a list per document."""
    grouped = ranges.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "end")).alias("r"))
    return grouped.select("doc_id", "text_key", F.col("r.start").alias("starts"), F.col("r.end").alias("ends"))


def with_ranges(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Every row with its ranges, or NULL; NULL ids meet NULL ids."""
    own = ranges.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "starts", "ends")
    return rows.join(own, rows["doc_id"].eqNullSafe(own["d"]) & (rows["text_key"] == own["t"]), "left").drop("d", "t")

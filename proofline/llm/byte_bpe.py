"""Byte-level BPE encoding and decoding, with long texts encoded in overlapping chunks.

Defined results: a NULL or empty text has no ids and decodes to no bytes; repeated rows each get their row; only the
id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm.bpe import encoder_of, pre_token_pattern, read_ranks
from proofline.llm.chunks import CHUNK, OVERLAP, spliced_chunks
from proofline.llm.common import annotate, read_table

VOCABULARY = "byte_bpe_50k.tiktoken"
IDS_AT_ONCE = 1 << 18


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def with_ids(df: DataFrame, text: str, path: str, keep: list[str]) -> DataFrame:
    """``ids`` of each text as array<int>; no row moves."""
    def make():
        encoder = encoder_of(path)
        return lambda texts: [[encoder.ids(t) for t in texts]]
    return annotate(df, text, make, [("ids", "array<int>")], raw=False, keep=keep)


def pre_token_ends():
    def ends(piece):
        places = [m.end() for m in pre_token_pattern(piece).finditer(piece)]
        return places, [1] * len(places)
    return ends


def encode(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids array<int>) for every row, in ids of the rank file at ``path`` (the same path on every machine).

    Texts up to ``chunk`` characters are encoded where they lie. Longer ones, once per distinct text, are pre-tokenised as
    overlapping chunks in parallel, stitched where boundaries resynchronise, encoded piece by piece and put together.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    is_long = F.coalesce(F.char_length("text") > chunk, F.lit(False))
    short = with_ids(rows.where(~is_long), "text", path, ["doc_id"])
    long = rows.where(is_long).withColumn("key", F.sha2(F.col("text").cast("binary"), 256))
    pieces, cuts = spliced_chunks(long.select("key", "text"), pre_token_ends, chunk, overlap)
    pieces = pieces.join(cuts, ["key", "overlap", "part"]).select("key", "part", F.expr("substring(piece, from_at + 1, to_at - from_at)").alias("piece"))
    parts = with_ids(pieces, "piece", path, ["key", "part"])
    whole = parts.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "ids"))), lambda p: p["ids"])).alias("ids"))
    return short.unionByName(long.select("doc_id", "key").join(whole, "key").select("doc_id", "ids"))


def id_lists(batch: pa.RecordBatch):
    """(first row, its lists of ids) in runs of rows that hold about IDS_AT_ONCE ids at most, one row at least."""
    lists = batch.column(1)
    offsets, begin = lists.offsets.to_numpy(), 0
    while begin < len(lists):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + IDS_AT_ONCE, side="right")) - 1)
        flat = lists.values.slice(offsets[begin], offsets[end] - offsets[begin]).to_numpy(zero_copy_only=False).tolist()
        cuts = (offsets[begin:end + 1] - offsets[begin]).tolist()
        yield begin, [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        begin = end


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, decoded binary): the bytes of the ids, in order. Unknown ids raise an error."""
    def run(batches):
        table = {i: b for b, i in read_ranks(path).items()}
        for batch in batches:
            for begin, lists in id_lists(batch):
                out = [b"".join([table[i] for i in ids]) for ids in lists]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(out)), pa.array(out, pa.binary())], names=["doc_id", "decoded"])
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(run, f"doc_id {kind}, decoded binary")


def digests(encoded: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """Per document n_tokens, ids_sha256 (decimal ids joined by a space) and decoded_sha256, from its ids, which may stay."""
    def run(batches):
        table = {i: b for b, i in read_ranks(path).items()}
        numbers = {i: str(i).encode() for i in table}
        for batch in batches:
            for begin, lists in id_lists(batch):
                named = [hashlib.sha256(b" ".join([numbers[i] for i in ids])).hexdigest() for ids in lists]
                plain = [hashlib.sha256(b"".join([table[i] for i in ids])).hexdigest() for ids in lists]
                arrays = [batch.column(0).slice(begin, len(lists)), pa.array(list(map(len, lists)), pa.int64()), pa.array(named, pa.string()), pa.array(plain, pa.string())]
                if keep_ids:
                    arrays.append(batch.column(1).slice(begin, len(lists)))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][:len(arrays)])
    kind = encoded.schema["doc_id"].dataType.simpleString()
    ids = ", ids array<int>" if keep_ids else ""
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{ids}")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path(VOCABULARY)
    return digests(encode(read_table(spark, sf_dir, "documents"), path), path)

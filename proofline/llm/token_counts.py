"""Token counts, with huge texts counted in overlapping chunks that are spliced at proven common boundaries.

Defined results: a NULL or empty text has 0 bytes and 0 tokens; repeated rows each get their row; only the id and text
columns are read. A special string inside a text counts as one token and splits the text, as the vocabulary's library does by default.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm.bpe import Encoder, pre_token_pattern, read_merges
from proofline.llm.byte_bpe import vocabulary_path
from proofline.llm.chunks import CHUNK, OVERLAP, spliced_chunks
from proofline.llm.common import annotate, read_table

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024


class Counter:
    """Counts tokens; ``steps`` also tells where each pre-token or special string ends and how many tokens it has."""

    def __init__(self, path: str):
        ranks, special = read_merges(path)
        self.encoder = Encoder(ranks)
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.counts: dict[str, int] = {}

    def pieces(self, text: str):
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield at, text[at:m.start()], False
            yield m.start(), m[0], True
            at = m.end()
        yield at, text[at:], False

    def of_piece(self, piece: str) -> int:
        n = len(self.encoder.fresh(piece))
        if len(piece) <= 64:
            if len(self.counts) >= self.encoder.remember:
                self.counts.clear()
            self.counts[piece] = n
        return n

    def count(self, text: str) -> int:
        total, get, of_piece = 0, self.counts.get, self.of_piece
        for _, piece, special in self.pieces(text):
            if special:
                total += 1
            else:
                total += sum([get(p) or of_piece(p) for p in pre_token_pattern(piece).findall(piece)])
        return total

    def steps(self, text: str) -> tuple[list[int], list[int]]:
        ends, counts = [], []
        for at, piece, special in self.pieces(text):
            if special:
                ends.append(at + len(piece))
                counts.append(1)
                continue
            for m in pre_token_pattern(piece).finditer(piece):
                ends.append(at + m.end())
                counts.append(self.counts.get(m[0]) or self.of_piece(m[0]))
        return ends, counts


@lru_cache(maxsize=2)
def counter_of(path: str) -> Counter:
    """One counter for all tasks of a worker, so what it remembers lasts."""
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, chunk: int = CHUNK,
                 overlap: int = OVERLAP) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens and over_limit (n_tokens > ``limit``).

    Texts up to ``chunk`` characters are counted where they lie; longer ones, once per distinct text, as overlapping chunks
    encoded with their offsets. Only counts travel after that, so a text may have any length.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"),
                       F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("bigint").alias("n_bytes"))
    is_long = F.coalesce(F.char_length("text") > chunk, F.lit(False))

    def counter():
        own = counter_of(path)
        return lambda texts: [[own.count(t) for t in texts]]

    def stepper():
        return counter_of(path).steps

    short = annotate(rows.where(~is_long), "text", counter, [("n_tokens", "bigint")], raw=False, keep=["doc_id", "n_bytes"])
    long = rows.where(is_long).withColumn("key", F.sha2(F.col("text").cast("binary"), 256))
    _, cuts = spliced_chunks(long.select("key", "text"), stepper, chunk, overlap)
    whole = cuts.groupBy("key").agg(F.sum("weight").alias("n_tokens"))
    counted = short.unionByName(long.select("doc_id", "n_bytes", "key").join(whole, "key").select("doc_id", "n_bytes", "n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"), vocabulary_path(VOCABULARY))

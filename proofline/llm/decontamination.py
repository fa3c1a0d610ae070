"""Benchmark decontamination: a broadcast hash set of normalised n-grams, scanned over training tokens.

Defined results: a NULL or empty text has no words, no hits and is clean; items that are NULL or have
no words match nothing; repeated items count once per item id (NULL ids are ignored); repeated
documents each get their row; extra columns are neither read nor returned, except by ``decontaminate``.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm.common import annotate, covered, materialise, read_table, runs_of

N = 13
#: Largest benchmark text that is broadcast at once; a larger benchmark is scanned in that many slices.
BROADCAST_BYTES = 32 << 20
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
RUN = re.compile(rb"[^ ]+")


class WindowSet:
    """Every window of the items, and what prunes a scan: the vocabulary and each length's first and last words."""

    def __init__(self, items: list[tuple[str, str | None]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        self.windows: dict[tuple[bytes, ...], list[str]] = {}
        edges: dict[int, tuple[set[int], set[int]]] = {}
        for item, text in items:
            words = (text or "").encode().translate(TABLE).split()
            if not words or item is None:
                continue
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            size = min(n, len(words))
            first, last = edges.setdefault(size, (set(), set()))
            for i in range(len(words) - size + 1):
                owners = self.windows.setdefault(tuple(words[i:i + size]), [])
                if not owners or owners[-1] != item:
                    owners.append(item)
                first.add(ids[i])
                last.add(ids[i + size - 1])
        self.edges = {}
        for size, (first, last) in edges.items():
            tables = np.zeros((2, len(self.vocabulary) + 1), bool)
            tables[0, list(first)] = True
            tables[1, list(last)] = True
            self.edges[size] = tables

    def scan(self, words: list[bytes]) -> tuple[list[int], list[int], set[str]]:
        """Hit ranges in words, and the items that own them. Candidates are verified word by word."""
        get, starts, ends, items = self.vocabulary.get, [], [], set()
        ids = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
        strange = np.concatenate(([0], np.cumsum(ids == 0)))
        for size, (first, last) in self.edges.items():
            if size > len(words):
                continue
            k = len(words) - size + 1
            may = (strange[size:] == strange[:k]) & first[ids[:k]] & last[ids[size - 1:]]
            for i in np.flatnonzero(may).tolist():
                owners = self.windows.get(tuple(words[i:i + size]))
                if owners:
                    starts.append(i)
                    ends.append(i + size)
                    items.update(owners)
        return starts, ends, items


def _slices(items: DataFrame, item_id: str, text: str, limit: int):
    """The items in parts that are small enough to broadcast, each as a list on the driver."""
    spark = items.sparkSession
    own = items.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col(f"`{text}`").alias("words"))
    total = own.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    parts = -(-total // limit) or 1
    for part in range(parts):
        some = own if parts == 1 else own.where(F.pmod(F.xxhash64("item", "words"), F.lit(parts)) == part)
        yield spark.sparkContext.broadcast([tuple(r) for r in some.collect()]), parts


def _count(starts: str, ends: str) -> Column:
    """Distinct places in ranges that may overlap."""
    each = F.transform(F.arrays_zip(F.col(starts).alias("a"), F.col(ends).alias("b")), lambda r: F.sequence(r["a"], r["b"] - 1))
    return F.size(F.array_distinct(F.flatten(each))).cast("bigint")


def find_hits(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text",
              n: int = N, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """All columns of ``docs`` as one struct ``document``, then hit_words (words of the text), hit_count (words hit),
    hit_from and hit_to (word ranges) and hit_items.

    One pass over the texts and no shuffle. A benchmark beyond ``broadcast_bytes`` is scanned in slices,
    each one pass, and the ranges of all slices are kept.
    """
    fields = [("hit_words", "bigint"), ("hit_count", "bigint"), ("hit_from", "array<int>"), ("hit_to", "array<int>"), ("hit_items", "array<string>")]
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), F.col(f"`{text}`").alias("hit_text"))
    for number, (shared, parts) in enumerate(_slices(items, item_id, item_text, broadcast_bytes)):
        def make(shared=shared):
            windows = WindowSet(shared.value, n)

            def work(texts):
                result = [[] for _ in fields]
                for raw in texts:
                    words = raw.translate(TABLE).split()
                    starts, ends, owners = windows.scan(words)
                    count = int(covered(starts, ends, len(words)).sum()) if starts else 0
                    for column, value in zip(result, (len(words), count, starts, ends, sorted(owners)), strict=True):
                        column.append(value)
                return result
            return work

        if number == 0:
            out = annotate(out, "hit_text", make, fields)
        else:
            out = annotate(out.select("document", "hit_text", *[F.col(f).alias(f"_{f}") for f, _ in fields]), "hit_text", make, fields)
            out = out.select("document", "hit_text", "hit_words", F.concat("_hit_from", "hit_from").alias("hit_from"),
                             F.concat("_hit_to", "hit_to").alias("hit_to"), F.array_distinct(F.concat("_hit_items", "hit_items")).alias("hit_items"))
            out = out.select("document", "hit_text", "hit_words", _count("hit_from", "hit_to").alias("hit_count"), "hit_from", "hit_to", "hit_items")
        if parts > 1:
            out = materialise(out, "decontamination")
    return out.drop("hit_text")


def _contaminated(share: int) -> Column:
    return (F.col("hit_count") > 0) & (share * F.col("hit_count") >= F.col("hit_words"))


def contamination(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", share: int = 20, **options) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 and contaminated (some hit, and ``share`` * n_hit >= n_words)."""
    hits = find_hits(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), items, text="text", **options)
    return hits.select("document.doc_id", F.col("hit_words").alias("n_words"), F.col("hit_count").alias("n_hit"),
                       F.size("hit_items").cast("bigint").alias("n_items"),
                       F.sha2(F.array_join(F.array_sort("hit_items"), ",").cast("binary"), 256).alias("items_sha256"),
                       _contaminated(share).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, *, text: str = "text", mode: str = "documents", share: int = 20, **options) -> DataFrame:
    """All columns of the documents, without contamination.

    ``documents`` drops each contaminated document; ``spans`` keeps every document and cuts the hit words out of it.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"unknown mode {mode}")
    hits = find_hits(docs, items, text=text, **options)
    columns = [F.col(f"document.`{c}`").alias(c) for c in docs.columns]
    if mode == "documents":
        return hits.where(~_contaminated(share)).select(columns)
    clean = F.pandas_udf(lambda t, a, b: pd.Series([cut_words(*x) if len(x[1]) else x[0] for x in zip(t, a, b, strict=True)], dtype=object), "string")
    cut = clean(F.col(f"document.`{text}`"), "hit_from", "hit_to").alias(text)
    return hits.select([cut if c == text else column for c, column in zip(docs.columns, columns, strict=True)])


def cut_words(text: str, starts, ends) -> str:
    """The text without its hit words; what stands between two hit words goes with them."""
    raw = text.encode()
    places = [m.span() for m in RUN.finditer(raw.translate(TABLE))]
    begins, stops = runs_of(covered(starts, ends, len(places)))
    kept, at = [], 0
    for i, j in zip(begins.tolist(), stops.tolist(), strict=True):
        kept.append(raw[at:places[i][0]])
        at = places[j - 1][1]
    return b"".join([*kept, raw[at:]]).decode()


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))

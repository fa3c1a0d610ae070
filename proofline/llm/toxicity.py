"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

The lexicon (words and word beginnings that mark toxic texts) is learned from one part of the labelled sample, the trees
from a second, the calibration from a third, so no part judges what it has taught. Features: lexicon densities and peaks,
hits near second-person words, capitals, punctuation, obfuscated spellings and what they hide.

Defined results: a NULL or empty text is scored like any text without words; repeated rows each get their row; NULL or
repeated labels: NULL is no label, any 1 wins; without labels of both kinds every score is the share of label 1 (0 without
labels); only id, text and label columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm.common import crc_mod, give_back, materialise, read_table, text_slices

#: Bounds of the fit: labelled rows sampled (by hash of the id), lexicon entries kept.
FIT_ROWS, LEXICON_SIZE = 24_000, 4_000
THRESHOLD = 0.3
TREES, DEPTH = 15, 3
BEGINNINGS = (3, 4, 5, 6)
STRONG, WEAK = 3.5, 1.8                # log odds of a lexicon entry
NEAR = 5                               # words between a hit and a second-person word
# fixed values: second-person words of four languages
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro".split())
# fixed values: letters that figures and signs stand for
LEET = str.maketrans("01345789@$!|+", "oieastbgasiit")
OBFUSCATED = re.compile(r"[^\W\d_]+[0-9@$!|*+]+[^\W\d_]+|(?<![\w@$])[@$][^\W\d_]{3,}")
SPACED = re.compile(r"(?<!\w)\w(?:[ .*-]\w(?!\w)){3,}+")   # possessive: linear, and keeps no state for a long run
REPEATED = re.compile(r"([^\W\d_])\1\1")
UPPER = bytes(range(65, 91))
SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
TO_SPACE = bytes(32 if b in SIGNS or b < 32 else b for b in range(256))
FEATURES = ("strong density", "weak density", "strong hits", "peak", "mean log odds", "distinct strong", "hits near second person", "second person",
            "capitals", "capital words", "exclamation marks", "question marks", "punctuation", "obfuscated", "hidden hits", "repeated letters", "words")


def words_of(text: str) -> list[str]:
    return text.lower().encode().translate(TO_SPACE).decode().split()


def stems_of(word: str) -> list[str]:
    """The word itself and its beginnings, as lexicon keys."""
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n)]


def learn_lexicon(sample: DataFrame, size: int = LEXICON_SIZE) -> dict[str, float]:
    """Log odds of the stems that mark toxic texts, from rows (text, toxic): document frequencies, summed per batch first."""
    def count(batches):
        for whole in batches:
            for batch in text_slices(whole, "text"):
                sums = (Counter(), Counter())
                for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    sums[toxic > 0].update({s for w in set(words_of(text or "")) for s in stems_of(w)})
                stems = list(sums[0].keys() | sums[1].keys())
                yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), *(pa.array([c[s] for s in stems], pa.int64()) for c in sums)], names=["stem", "clean", "bad"])

    size_of = sample.groupBy().agg(F.sum("toxic"), F.count("*")).first()
    bad, clean = size_of[0] or 0, (size_of[1] or 0) - (size_of[0] or 0)
    if not bad or not clean:
        return {}
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    counts = sample.select("text", "toxic").mapInArrow(count, "stem string, clean bigint, bad bigint").groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad"))
    kept = counts.where(F.col("bad") >= max(2, math.ceil(bad / 500))).withColumn("odds", odds).where(F.col("odds") >= WEAK)
    return {r["stem"]: r["odds"] for r in kept.orderBy(F.desc(F.col("odds") * F.sqrt("bad")), "stem").limit(size).collect()}


class Scorer(dict):
    """Log odds of a word: the largest of its stems', 0 if none. Remembers words."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        if len(self) > 80_000:
            self.clear()
        value = self[word] = max((self.lexicon.get(s, 0.0) for s in stems_of(word)), default=0.0)
        return value


def features_of(text: str, scorer: Scorer) -> list[float]:
    raw = text.encode()
    words = words_of(text)
    n, size = max(1, len(words)), max(1, len(raw))
    odds = np.fromiter(map(scorer.__getitem__, words), np.float64, len(words))
    strong = np.flatnonzero(odds >= STRONG)
    second = np.flatnonzero(np.fromiter(map(SECOND_PERSON.__contains__, words), bool, len(words)))
    near = 0
    if len(strong) and len(second):
        right = np.searchsorted(second, strong)
        gap = np.minimum(np.abs(strong - second[np.minimum(right, len(second) - 1)]), np.abs(strong - second[np.maximum(right - 1, 0)]))
        near = int((gap <= NEAR).sum())
    obfuscated = OBFUSCATED.findall(text) + SPACED.findall(text)
    plain = [re.sub(r"[ .*-]", "", w).lower().translate(LEET) for w in obfuscated]
    hidden = sum(scorer[w] >= STRONG for w in plain)
    count = lambda signs: len(raw) - len(raw.translate(None, signs))
    return [100 * len(strong) / n, 100 * int(((odds >= WEAK) & (odds < STRONG)).sum()) / n, math.log1p(len(strong)), float(odds.max()) if len(words) else 0.0,
            float(odds.mean()) if len(words) else 0.0, math.log1p(len({words[i] for i in strong.tolist()})), 100 * near / n, 100 * len(second) / n,
            count(UPPER) / size, 100 * sum(1 for w in re.findall(r"\b[A-Z]{3,}\b", text)) / n, 100 * count(b"!") / n, 100 * count(b"?") / n,
            100 * count(SIGNS) / size, 100 * len(obfuscated) / n, 100 * hidden / n, 100 * len(REPEATED.findall(text)) / n, math.log1p(len(words))]


def with_features(df: DataFrame, lexicon: dict[str, float], text: str, keep: list[str]) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(lexicon)     # at most LEXICON_SIZE entries

    def features(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for column in columns:
            yield pd.Series([features_of(t or "", scorer) for t in column])
        scorer.clear()
        give_back()

    # only the text is sent to Python; the other columns wait in their rows
    dense = F.pandas_udf(features, "array<double>")
    return df.select(*keep, F.col(text)).withColumn("features", array_to_vector(dense(text))).select(*keep, "features")


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    share: float

    def score(self, docs: DataFrame, *, text: str = "text") -> DataFrame:
        """All columns of ``docs`` as a struct ``document``, and ``score`` from 0 to 1. No row moves."""
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), F.col(f"`{text}`").alias("scored_text"))
        if self.trees is None:
            return rows.select("document", F.lit(float(self.share)).alias("score"))
        rows = self.trees.transform(with_features(rows, self.lexicon, "scored_text", ["document"]))
        rows = rows.withColumn("raw", vector_to_array("probability")[1])
        if self.calibration is None:
            return rows.select("document", F.col("raw").alias("score"))
        # calibration has steps; a hundredth of the raw value keeps the order within a step
        score = 0.99 * F.least(F.greatest("calibrated", F.lit(0.0)), F.lit(1.0)) + 0.01 * F.col("raw")
        return self.calibration.transform(rows).select("document", score.alias("score"))


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS,
        held_out: tuple[int, int] | None = (4, 2)) -> ToxicityModel:
    """Learn from labelled documents whose crc32(id) mod ``held_out[0]`` is not ``held_out[1]``; at most about ``fit_rows`` of them, by hash."""
    known = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    if held_out:
        known = known.where(crc_mod("doc_id", held_out[0]) != held_out[1])
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total, bad = known.agg(F.count("*"), F.sum("toxic")).first()
    share = (bad or 0) / total if total else 0.0
    if not bad or bad == total:
        return ToxicityModel({}, None, None, share)
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, fit_rows / total)))
    texts = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    fold = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(20))
    sample = materialise(texts.join(F.broadcast(known), "doc_id").select("doc_id", "text", "toxic", fold.alias("fold")), "toxicity")   # about fit_rows rows
    lexicon = learn_lexicon(sample.where("fold < 9"))
    taught = materialise(with_features(sample.where("fold >= 9"), lexicon, "text", ["doc_id", "toxic", "fold"]).withColumn("label", F.col("toxic").cast("double")), "toxicity").coalesce(4)
    kinds = {(r["part"], r["toxic"]) for r in taught.select((F.col("fold") < 16).alias("part"), "toxic").distinct().collect()}
    if len([k for k in kinds if k[0]]) < 2:
        return ToxicityModel({}, None, None, share)
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=5, minInstancesPerNode=2).fit(taught.where("fold < 16"))
    if len([k for k in kinds if not k[0]]) < 2:
        return ToxicityModel(lexicon, trees, None, share)
    judged = trees.transform(taught.where("fold >= 16")).select("label", vector_to_array("probability")[1].alias("raw"))
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(judged)
    return ToxicityModel(lexicon, trees, calibration, share)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = fit(docs, read_table(spark, sf_dir, "labels")).score(docs)
    return scored.select("document.doc_id", (crc_mod("document.doc_id", 4) == 2).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax, beside add-one unigrams.

log p(w | before) = log p(class of w | features of what stands before) + log p(w | class). Features are the word before, the
two words before, and the skipped words two and three back, hashed to a fixed number of weight rows. Each round sends the weights to all
tasks, every task makes gradient steps over its share of the documents, and the changes are averaged by how often a row was
touched. Every training document is used in exactly one round. Word counts cover all training documents exactly.

Counts of the HEAVY most frequent words are broadcast (a fixed bound); the others meet their counts in a join.
Words are known by 64-bit hashes. Defined results: a NULL or empty text is one end token; repeated rows each get their row;
without training documents all counts are 0 and the model is the unigram one; only id and text are read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm.common import annotate, combine, crc_mod, materialise, mixed, read_table, text_slices
from proofline.llm.repeats import identified

HEAVY = 1 << 18
#: Words that are a class of their own, classes of word endings, weight rows, rounds, step size, tokens in a step.
SINGLE, ENDINGS, ROWS, ROUNDS, STEP, BATCH = 16, 23, 1 << 14, 3, 0.35, 4096
CLASSES = SINGLE + ENDINGS + 1
SHORT = 12      # rows of a run that are added run by run
END = b""
FEATURES = 4


def ending(word: bytes) -> str:
    """What a word ends in: two letters and a closing sign, if any; the end token has its own."""
    text = word.decode()
    bare = text.rstrip(".,;:!?\"')")
    return bare[-2:] + text[len(bare):][-1:] if text else "\n"


def flushed(sums: Counter):
    words = list(sums)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64).view(np.int64)), pa.array([ending(w) for w in words], pa.string()), pa.array([sums[w] for w in words], pa.int64())],
        names=["word", "ending", "n"])


def count_words(texts: DataFrame, distinct: int = 300_000) -> DataFrame:
    """(word, ending, n) over all texts; each task sums up to ``distinct`` words before it sends them."""
    def run(batches):
        sums = Counter()
        for whole in batches:
            for batch in text_slices(whole, "text"):
                for text in batch.column(0).cast(pa.binary()).to_pylist():
                    sums.update((text or b"").lower().split())
                sums[END] += batch.num_rows
                if len(sums) > distinct:
                    yield flushed(sums)
                    sums.clear()
        if sums:
            yield flushed(sums)
    counted = texts.select("text").mapInArrow(run, "word bigint, ending string, n bigint")
    return materialise(counted.groupBy("word").agg(F.min("ending").alias("ending"), F.sum("n").alias("n")), "words")


@dataclass
class Vocabulary:
    """What every task knows of the counts: the heavy words, the classes and their sizes."""
    tokens: int
    types: int
    words: np.ndarray          # heavy words by hash
    log_counts: np.ndarray     # log10(n + 1) of each
    single: dict[int, int]     # class of the most frequent words
    endings: dict[str, int]    # class of endings
    log_sizes: np.ndarray      # log10 of the sum of n + 1 over a class, 1 for words never seen

    def class_of(self, word: int, end: str) -> int:
        return self.single.get(word, self.endings.get(end, CLASSES - 1))


def learn_vocabulary(counts: DataFrame, heavy: int = HEAVY) -> Vocabulary:
    tokens, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # the count from which at most ``heavy`` words are left, to a sixteenth of a power of two: a few hundred rows, then ``heavy`` at most
    level = F.floor(F.log2("n") * 16).cast("int")
    cut, room = 0, heavy
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        if (room := room - r["count"]) < 0:
            cut = r["level"] + 1
            break
    top = counts.where(level >= cut).select("word", "n").toPandas()
    words, n = top["word"].to_numpy(np.int64), top["n"].to_numpy(np.int64)
    first = counts.orderBy(F.desc("n"), "word").limit(SINGLE).collect()
    single = {r["word"]: i for i, r in enumerate(first)}
    rest = counts.where(~F.col("word").isin(list(single))) if single else counts
    common = rest.groupBy("ending").agg(F.sum(F.col("n") + 1).alias("size")).orderBy(F.desc("size"), "ending").limit(ENDINGS).collect()
    endings = {r["ending"]: SINGLE + i for i, r in enumerate(common)}
    sizes = np.ones(CLASSES)
    for i, r in enumerate(first):
        sizes[i] += r["n"] + 1
    for r in common:
        sizes[endings[r["ending"]]] += r["size"]
    sizes[CLASSES - 1] += tokens + types - (sizes[:-1] - 1).sum()
    order = np.argsort(words.view(np.uint64))
    return Vocabulary(tokens, types, words.view(np.uint64)[order], np.log10(n[order] + 1.0), single, endings, np.log10(sizes))


class Places(dict):
    """A number for each word, in the order in which words are first asked for; ``fresh`` are those not looked at yet."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        self.fresh.append(word)
        return place


class Reader:
    """Word hashes, classes and counts of texts; remembers words."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        #: Of each word remembered: hash, class, and log10(n + 1) if it is a heavy word, else -1.
        self.places, self.hashes, self.classes, self.logs = Places(), np.empty(0, np.uint64), np.empty(0, np.int16), np.empty(0)

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, class and log count of every token of all texts (an end token closes each), and where each text begins."""
        words, begins = [], []
        for text in texts:
            begins.append(len(words))
            words += text.lower().split()
            words.append(END)
        if len(self.places) > 300_000:
            self.forget()
        at = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
        if fresh := self.places.fresh:
            known = self.vocabulary
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, fresh), np.uint64, len(fresh))
            classes = np.fromiter((known.class_of(h, ending(w)) for h, w in zip(hashes.view(np.int64).tolist(), fresh, strict=True)), np.int16, len(fresh))
            logs = np.full(len(fresh), -1.0)
            if len(known.words):
                near = np.minimum(np.searchsorted(known.words, hashes), len(known.words) - 1)
                logs = np.where(known.words[near] == hashes, known.log_counts[near], -1.0)
            self.hashes, self.classes, self.logs = (np.concatenate(x) for x in ((self.hashes, hashes), (self.classes, classes), (self.logs, logs)))
            fresh.clear()
        return self.hashes[at], self.classes[at], self.logs[at], np.array(begins, np.int64)


def feature_rows(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Weight rows of each token's features; words before a text's first are the end token."""
    place = np.arange(len(hashes)) - np.repeat(begins, np.diff(np.append(begins, len(hashes))))
    start = np.uint64(xxhash.xxh3_64_intdigest(END))
    back = []
    for k in (1, 2, 3):
        shifted = np.concatenate((np.full(min(k, len(hashes)), start), hashes[:-k]))[: len(hashes)]
        back.append(np.where(place >= k, shifted, start))
    one, two, three = back
    rows = [mixed(one + np.uint64(1)), combine(two, one), mixed(two + np.uint64(2)), mixed(three + np.uint64(3))]
    return np.stack([(r >> np.uint64(20)) % np.uint64(ROWS) for r in rows], axis=1).astype(np.int32)


def class_logits(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = weights[ROWS] + weights[rows[:, 0]]          # the last row is the bias
    for k in range(1, rows.shape[1]):
        out += weights[rows[:, k]]
    return out


def run_sums(values: np.ndarray, order: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of the rows values[order] over runs of them. Most runs are short: the first rows of all are added, then the second ones of those that have them, and so on."""
    sums, at, longer = values[order[first]], 1, np.flatnonzero(counts > 1)
    while len(longer) and at < SHORT:
        sums[longer] += values[order[first[longer] + at]]
        at += 1
        longer = longer[counts[longer] > at]
    for run, begin, size in zip(longer.tolist(), first[longer].tolist(), counts[longer].tolist(), strict=True):
        sums[run] += values[order[begin + at:begin + size]].sum(axis=0)
    return sums


def gradient_steps(weights: np.ndarray, touched: np.ndarray, rows: np.ndarray, classes: np.ndarray, step: float) -> None:
    """One pass in batches; a row's summed gradient is divided by the root of how often the batch has it."""
    for a in range(0, len(classes), BATCH):
        own, target = rows[a:a + BATCH], classes[a:a + BATCH]
        logits = class_logits(weights, own)
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        logits[np.arange(len(target)), target] -= 1
        flat = own.ravel().astype(np.uint16)               # ROWS fit, and so short numbers are sorted by their digits
        order = np.argsort(flat, kind="stable")
        sorted_rows = flat[order]
        first = np.flatnonzero(np.concatenate(([True], sorted_rows[1:] != sorted_rows[:-1])))
        counts = np.diff(np.append(first, len(flat)))
        sums = run_sums(logits, order // own.shape[1], first, counts)
        weights[sorted_rows[first]] -= (step / FEATURES) * sums / np.sqrt(counts)[:, None].astype(np.float32)
        weights[ROWS] -= (step / FEATURES) * logits.sum(axis=0) / np.float32(np.sqrt(len(target)))
        touched[sorted_rows[first]] += counts
        touched[ROWS] += len(target)


def train(texts: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS, step: float = STEP) -> np.ndarray:
    """Weights from rows (text, share), where ``share`` from 0 to rounds - 1 names the round a text is used in."""
    spark = texts.sparkSession
    weights = np.zeros((ROWS + 1, CLASSES), np.float32)
    mass = 10.0 ** vocabulary.log_sizes
    weights[ROWS] = np.log(mass / mass.sum())
    shared_words = spark.sparkContext.broadcast(vocabulary)
    names = [f"d{i}" for i in range(CLASSES)]
    for number in range(rounds):
        shared = spark.sparkContext.broadcast(weights)

        def run(batches, shared=shared, rate=step / (1 + number)):
            reader, start = Reader(shared_words.value), shared.value
            own, touched = start.copy(), np.zeros(ROWS + 1, np.int64)
            for whole in batches:
                for batch in text_slices(whole, "text", 1 << 21):
                    hashes, classes, _, begins = reader.read([t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()])
                    gradient_steps(own, touched, feature_rows(hashes, begins), classes, rate)
            at = np.flatnonzero(touched)
            change = (own[at] - start[at]).astype(np.float64) * touched[at, None]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(touched[at]), *(pa.array(change[:, i]) for i in range(CLASSES))], names=["row", "n", *names])

        changes = texts.where(F.col("share") == number).select("text").mapInArrow(run, f"row int, n bigint, {', '.join(f'{c} double' for c in names)}")
        mean = changes.groupBy("row").agg(*[(F.sum(c) / F.sum("n")).alias(c) for c in names]).toPandas()   # at most ROWS + 1 rows
        weights = weights.copy()
        weights[mean["row"].to_numpy()] += mean[names].to_numpy(np.float32)
        shared.unpersist()
    return weights


def score_texts(rows: DataFrame, vocabulary: Vocabulary, weights: np.ndarray) -> DataFrame:
    """Columns of ``rows`` but text, then n_tokens, heavy (tokens among the heavy words), log_counts (their sum), context (log10 of the class
    probabilities over the class sizes, summed) and light (hashes of the other tokens)."""
    spark = rows.sparkSession
    shared, shared_weights = spark.sparkContext.broadcast(vocabulary), spark.sparkContext.broadcast(weights)

    def make():
        own, table = shared.value, shared_weights.value
        reader = Reader(own)

        def work(texts):
            hashes, classes, logs, begins = reader.read(texts)
            features, context = feature_rows(hashes, begins), np.empty(len(hashes))
            for a in range(0, len(hashes), BATCH):
                logits = class_logits(table, features[a:a + BATCH])
                top = logits.max(axis=1)
                target = classes[a:a + BATCH]
                chosen = logits[np.arange(len(target)), target] - top
                np.exp(logits - top[:, None], out=logits)
                context[a:a + BATCH] = (chosen - np.log(logits.sum(axis=1))) / np.log(10) - own.log_sizes[target]
            known = logs >= 0
            logs[~known] = 0.0
            cuts = np.concatenate(([0], np.cumsum(~known)))
            ends = np.append(begins[1:], len(hashes))
            light = hashes[~known].view(np.int64)
            return [(ends - begins), np.add.reduceat(known.astype(np.int64), begins), np.add.reduceat(logs, begins), np.add.reduceat(context, begins),
                    [light[cuts[a]:cuts[b]] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]]
        return work

    fields = [("n_tokens", "bigint"), ("heavy", "bigint"), ("log_counts", "double"), ("context", "double"), ("light", "array<bigint>")]
    return annotate(rows, "text", make, fields, keep=[c for c in rows.columns if c != "text"])


def language_scores(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", held_out: tuple[int, int] = (7, 2), heavy: int = HEAVY) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, learned from the rows not held out."""
    rows = identified(docs, doc_id, text).withColumn("held_out", crc_mod("doc_id", held_out[0]) == held_out[1])
    taught = rows.where(~F.col("held_out"))
    counts = count_words(taught)
    vocabulary = learn_vocabulary(counts, heavy)
    weights = train(taught.select("text", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(ROUNDS)).alias("share")), vocabulary)
    scored = materialise(score_texts(rows, vocabulary, weights), "scores")
    light = scored.dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text_key", F.explode("light").alias("word"))
    met = light.join(counts.select("word", "n"), "word", "left").groupBy("doc_id", "text_key").agg(
        F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1.0)).alias("light_logs"), F.count("n").alias("light_known"))
    met = met.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "light_logs", "light_known")
    whole = scored.drop("light").join(met, scored["doc_id"].eqNullSafe(met["d"]) & (scored["text_key"] == met["t"]), "left")
    logs = F.col("log_counts") + F.coalesce("light_logs", F.lit(0.0))
    base = float(np.log10(vocabulary.tokens + vocabulary.types + 1))
    return whole.select("doc_id", "held_out", "n_tokens", (F.col("heavy") + F.coalesce("light_known", F.lit(0))).alias("n_known"),
                        F.lit(vocabulary.tokens).cast("bigint").alias("train_tokens"), (logs - F.col("n_tokens") * base).alias("base_score"), (logs + F.col("context")).alias("score"))


def op7_language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(read_table(spark, sf_dir, "documents"))

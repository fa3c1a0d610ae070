"""From raw documents to token ids: toxicity, near duplicates, benchmark contamination, personal data, encoding.

Every stage reads all that the one before has kept, written as Parquet, and decides over whole texts and the whole table. All
but the last return the columns of documents. Defined results: NULL texts count as empty and stay NULL; rows with a NULL id are
never dropped as duplicates; rows of one id are told apart by their texts, and equal ones leave one row after the second stage; columns
beyond those of documents are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm import byte_bpe, decontamination, personal_data, simhash, toxicity
from proofline.llm.common import materialise, read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold by a model fitted on the labelled ones among them."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    scored = model.score(docs).where(F.col("score") < toxicity.THRESHOLD)
    return scored.select("document.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the least id (of unlike texts of that id in the group, one)."""
    rows = materialise(simhash.near_duplicates(docs), "groups").where("doc_id IS NOT NULL")
    first = rows.groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    # rows and those that stay meet on their own keys, so a large group is no hot key
    gone = rows.select("doc_id", "text_key").join(first.select("first.doc_id", "first.text_key"), ["doc_id", "text_key"], "left_anti").select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    kept = docs.join(gone, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_key")), "left_anti")
    if rows.groupBy("doc_id", "text_key").count().where("count > 1").isEmpty():
        return kept
    return kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]).unionByName(kept.where("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth lies in benchmark windows."""
    return decontamination.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    clean = personal_data.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) per document."""
    path = byte_bpe.vocabulary_path(byte_bpe.VOCABULARY)
    return byte_bpe.digests(byte_bpe.encode(docs, path), path, keep_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("personal data", redact_personal_data),
    ("byte-level BPE", encode_texts),
]

#: Learned scores, trees of fingerprints and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

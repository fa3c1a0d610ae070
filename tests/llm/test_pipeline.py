"""The pipeline's stages on a small table with planted cases, and the contract of its columns."""

from __future__ import annotations

import random

import corpus_pipeline
from proofline.llm import queries


def test_stages_keep_clean_documents_and_act_on_planted_ones(spark, tmp_path):
    rng = random.Random(9)
    words = ["".join(rng.choice(["ka", "lo", "mi", "ne", "pu", "ra"]) for _ in range(3)) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item, copied = text(30), text(200)
    rows, labels = [], []
    for i in range(300):
        toxic = i % 6 == 0
        rows.append((i, text(60) + (" you scum idiot " if toxic else " ") + text(60), "en", "s", 0))
        labels.append((i, 0, int(toxic)))
    rows += [(1001, copied, "en", "s", 0), (1002, copied, "en", "s", 0), (1003, copied, "en", "s", 0), (1004, item + " " + text(50), "en", "s", 0),
             (1005, "mail me at a.b@example.org " + text(40), "en", "s", 0), (1006, None, "en", "s", 0), (None, text(50), None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("i1", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    clean = {i for i in range(300) if i % 6}
    assert kept[0] == clean | {1001, 1002, 1003, 1004, 1005, 1006, None}
    assert kept[1] == kept[0] - {1002, 1003}
    assert kept[2] == kept[1] - {1004}
    assert kept[3] == kept[4] == kept[2]
    redacted = spark.read.parquet(f"{tmp_path}/stage3").where("doc_id = 1005").first()
    assert "<EMAIL>" in redacted["text"] and "example.org" not in redacted["text"] and redacted["n_chars"] == len(redacted["text"])


def test_registry_holds_one_query_for_each_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(queries.EQUIVALENT_SQL) <= set(queries.QUERIES)


def test_near_duplicates_of_one_id_with_unlike_texts_keep_one_of_each_group(spark, tmp_path):
    rng = random.Random(2)
    a, b, c = (" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(80)) for _ in range(3))
    rows = [(3, a), (5, a), (5, b), (6, b), (9, c), (9, c), (10, None), (None, c)]
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, print string, component int")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted([(3, a), (5, b), (9, c), (10, None), (None, c)], key=repr)


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_personal_data_query_equals_the_patterns(spark):
    """The query's own columns, against the four patterns of its contract over a whole table."""
    import hashlib
    import re

    def luhn(digits):
        return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub(r"\D", "", m)) <= 19 and luhn(list(map(int, d)))),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub(r"\D", "", m)) <= 15)]
    sf, expected = "/root/testdata/sf0.001", {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        text, counts, base = r["text"] or "", [], []
        for name, pattern, fits in kinds:
            found = [m for m in re.finditer(pattern, text) if fits(m[0])]
            counts.append(len(found))
            base += [f"{name}:{m.start()}:{m.end()}" for m in found]
        expected[r["doc_id"]] = (*counts, hashlib.sha256(",".join(base).encode()).hexdigest())
    got = {r["doc_id"]: r for r in queries.QUERIES["op5_personal_data"](spark, sf).collect()}
    assert {i: (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for i, r in got.items()} == expected
    assert sum(sum(v[:4]) for v in expected.values()) > 5
    for i, r in got.items():
        spans = [s for s in r["spans"].split(",") if s]
        assert len(spans) >= sum(expected[i][:4])

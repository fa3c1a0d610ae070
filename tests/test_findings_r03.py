"""Work that must not grow faster than its input, and passes over text that must not be repeated."""

from __future__ import annotations

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofline.functions import text as T
from proofline.llm import language_model, search
from proofline.operators import layout as L2
from proofline.operators import limits as L
from proofline.operators import wording as W
from proofline.operators.units import structured_paragraphs
from proofline.plans.lint import DEFAULT_PROFILE
from proofline.plans.queries_units import b8


def test_spans_of_a_long_text_are_linear(spark, tmp_path):
    """150,000 matches in one text; copying all earlier ones for each, or counting from the start for each, takes minutes."""
    text = "é at. sea, " * 75_000
    spark.createDataFrame([(1, text)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    begin = time.time()
    assert b8(spark, str(tmp_path)).collect() == [(1, 150_000, 75_000 * 6)]
    assert time.time() - begin < 30
    some = text[:3000]
    found = spark.createDataFrame([(some,)], "t string").select(T.spans("t", "(e)(a,)|(a)(t.)", 4).alias("s")).first().s
    assert [(s.start, s.end, s.match) for s in found] == [(m.start(), m.end(), m.group()) for m in re.finditer("ea,|at.", some)]
    assert found[0].groups == ["", "", "a", "t."] and found[1].groups == ["e", "a,", "", ""]


def test_paragraphs_are_read_once_for_all_figure_rules(spark):
    """captions and call-outs come from one pass; every use of them made all paragraphs again."""
    docs = spark.createDataFrame([(1, "# Abstract\nA\n# 1. Introduction\nSee Figure 2 and Figure 4.\n# Figure legends\nFigure 2: Shown.\nFigure 7. Not cited"),
                                  (2, "# Results\nFigure 3 and Supplementary Figure 9")], "doc_id int, text string")
    paras = structured_paragraphs(docs)
    found = L.figures(paras, DEFAULT_PROFILE)
    assert "Supplementa" not in found._jdf.queryExecution().toString()
    assert sorted((r.doc_id, r.rule, re.search(r"\d+", r.message).group()) for r in found.collect()) == [
        (1, "figures.missing-legend", "4"), (1, "figures.uncited", "7"), (2, "figures.gap", "1"), (2, "figures.gap", "2")]


def test_front_matter_label_among_spaces(spark):
    """The label is found at the start of its line, whatever white space stands around it, and nowhere else."""
    lines = ["  Abbreviations : ", "abbreviations", "ABBREVIATIONS::", "Abbreviations :", "Abbreviations used", "List of abbreviations"]
    docs = spark.createDataFrame([(i, f"Title\n# Abstract\n{line}\nAfter") for i, line in enumerate(lines)], "doc_id int, text string")
    after = structured_paragraphs(docs).where(F.col("para_idx") == 3).select("doc_id", "region").collect()
    assert sorted(map(tuple, after)) == [(0, "front"), (1, "front"), (2, "front"), (3, "abstract"), (4, "abstract"), (5, "abstract")]


def test_spelling_hits_leave_their_paragraph_behind(spark):
    """a hit takes its snippet along; with the paragraph every hit moved a copy of a whole text."""
    docs = spark.createDataFrame([(1, "# Results\nThe colour and the color, COLOUR, colourxyz. A gene BRCA1 expression cut")], "doc_id int, text string")
    paras = structured_paragraphs(docs)
    hits = W.spelling_hits(paras)
    assert not {"text", "masked"} & set(hits.columns)
    assert sorted((r.word, r.start) for r in hits.collect()) == [("color", 19), ("colour", 4)]
    mixed = [r for r in W.spelling(paras, DEFAULT_PROFILE).collect() if r.rule == "spelling.mixed"]
    assert [(r.start, r.end, r.snippet) for r in mixed] == [(4, 10, "The colour and the color, COLOUR, colourxyz. A gene BRCA1 expression cut")]
    assert [r.start for r in W.gene_italics(paras, DEFAULT_PROFILE).collect()] == [52]


def test_search_sends_no_more_for_more_shards(spark, monkeypatch):
    """op1_topk_search: a task keeps the best of its shards; each shard sent its own, so rows grew with queries times shards."""
    common = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(common[i % 7:] + [f"own{i % 90}"] * (i % 3 + 1))) for i in range(240)], "doc_id long, text string")
    sent, whole = [], search.search_block
    monkeypatch.setattr(search, "search_block", lambda *args: sent.append(whole(*args)) or sent[-1])
    tasks = spark.sparkContext.defaultParallelism
    found = [sorted(map(tuple, search.search(docs, F.col("doc_id") % 20 == 0, k=3, shards=n).collect())) for n in (1, 5 * tasks)]
    assert found[0] == found[1] and len(found[0]) == 12 * 3
    assert sent[-1].count() <= 12 * 3 * tasks


def test_sums_of_a_shard_are_exact():
    """op1_topk_search: sums by matrix and by lists choose the documents, whatever is summed how; copies tie and the first are kept."""
    rng = np.random.default_rng(5)
    texts = [np.sort(rng.choice(80, rng.integers(3, 60), replace=False, p=np.arange(80, 0, -1) / 3240)) for _ in range(150)]
    texts[100:130] = [texts[7]] * 30
    words, place = np.concatenate(texts), np.repeat(np.arange(150), [len(t) for t in texts])
    order = np.argsort(words, kind="stable")
    words, place = words[order].astype(np.int64), place[order].astype(np.int32)
    cuts = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1], [True])))
    known, idfs, lengths = np.arange(80), rng.random(80) + 0.1, np.array([len(t) for t in texts], np.int32)
    begins, named = np.cumsum([0] + [len(t) for t in texts]), np.concatenate(texts)
    for dense, together in ((0.0, 64), (0.3, 7), (2.0, 1)):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(search, "DENSE", dense)
            patch.setattr(search, "QUERIES", together)
            shard = search.Shard(words[cuts[:-1]], cuts, place, np.ones(len(words), np.int32), lengths, known, idfs, 30.0)
            query, found, score = shard.best(begins, named, np.zeros(150), 5)
            floors = np.array([score[query == q].min() for q in range(150)])
            again = shard.best(begins, named, floors, 5)
        for q, t in enumerate(texts):
            each = sorted((-sum(idfs[w] * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(d) / 30)) for w in d if w in t), i) for i, d in enumerate(texts))[:5]
            for best in ((query, found, score), again):
                rows = sorted((-round(s, 9), i) for s, i in zip(best[2][best[0] == q].tolist(), best[1][best[0] == q].tolist(), strict=True))
                assert rows == [(round(s, 9), i) for s, i in each], (dense, q)


def test_gradient_sums_runs_of_rows(monkeypatch):
    """op7_language_scores: most runs of equal rows are short; each was summed column by column, which took half of the training."""
    monkeypatch.setattr(language_model, "SHORT", 3)
    rng = np.random.default_rng(2)
    counts = np.array([1, 9, 2, 3, 4, 1, 1, 30])
    first, order = np.cumsum(counts) - counts, rng.integers(0, 20, counts.sum())
    values = rng.random((20, 5))
    got = language_model.run_sums(values, order, first, counts)
    assert np.allclose(got, [values[order[a:a + n]].sum(axis=0) for a, n in zip(first, counts, strict=True)])
    assert language_model.ROWS <= 1 << 16


def test_reader_looks_at_a_word_once(monkeypatch):
    """op7_language_scores: hash, class and count of a word are looked up when it is first read, not for every token."""
    words, asked, whole = [b"a", b"b."], [], language_model.ending
    hashes = np.array(sorted(language_model.xxhash.xxh3_64_intdigest(w) for w in words), np.uint64)
    known = language_model.Vocabulary(9, 2, hashes, np.array([0.5, 0.7]), {}, {"b.": 3}, np.ones(language_model.CLASSES))
    monkeypatch.setattr(language_model, "ending", lambda w: asked.append(w) or whole(w))
    reader = language_model.Reader(known)
    for _ in range(2):
        got, classes, logs, begins = reader.read([b"A b. c a", b""])
        assert got.tolist() == [language_model.xxhash.xxh3_64_intdigest(w) for w in (b"a", b"b.", b"c", b"a", b"", b"")]
        assert begins.tolist() == [0, 5] and classes[1] == 3 and classes[0] == language_model.CLASSES - 1
        assert (logs[[2, 4, 5]] == -1).all() and logs[0] == logs[3] == [0.5, 0.7][int(hashes[1] == got[0])]
    assert sorted(asked) == [b"", b"a", b"b.", b"c"]


def test_boxes_are_made_once(spark):
    """F28, F32: every use of the boxes made them again, and joins brought back boxes that had just met."""
    boxes = spark.sql("SELECT 1 AS page, id AS idx, id * 3 + 12345.5D AS x0, 0D AS y0, id * 3 + 12349.5D AS x1, 4D AS y1 FROM range(5)")
    page = spark.sql("SELECT 1 AS page, 0D AS x0, 0D AS y0, 20000D AS x1, 900D AS y1")
    edges, pairs = L2.text_region_edge(boxes, boxes.where("idx = 2"), page), L2.text_text_overlap(boxes)
    assert not any("12345" in df._jdf.queryExecution().toString() for df in (edges, pairs))
    assert sorted(map(tuple, edges.collect())) == [(1, 1, 1, 0), (1, 2, 0, 1), (1, 3, 1, 0)]
    assert sorted((r.left_idx, r.right_idx) for r in pairs.collect()) == [(0, 1), (1, 2), (2, 3), (3, 4)]

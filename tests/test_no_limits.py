"""Inputs just past limits that once cut results, and jobs that must end or refuse."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from proofline import session
from proofline.operators import history as H
from proofline.operators import limits as L
from proofline.operators import matching as M
from proofline.operators.units import structured_paragraphs
from proofline.sources import readers as S


def test_long_paths_are_protected(spark):
    path = "a/" + "b" * 1100
    frame = spark.createDataFrame([("p", '{"k": ["' + path + '"]}')], "project string, body string")
    assert [r.path for r in H.protected_refs(frame).collect()] == [path]


def test_long_headings_stay_apart_and_long_lines_can_open_regions(spark):
    head = "A heading that is longer than seventy characters so that its end must count "
    text = f"# {head}one\nx\n# {head}two\ny"
    rows = structured_paragraphs(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    assert {r.text: r.section for r in rows if r.level == 0} == {"x": head + "one", "y": head + "two"}


def test_long_call_out_ranges_are_filled(spark):
    got = spark.range(1).select(L.callout_numbers(F.lit("1-60")).alias("n"), L.callout_numbers(F.lit("1-60"), 50).alias("cut")).head()
    assert list(got.n) == list(range(1, 61)) and list(got.cut) == [1, 60]


def test_whole_passages_are_traced(spark):
    passage = "the quick brown fox jumps over the lazy dog while the cat sleeps in the sun all day long"
    probes = spark.createDataFrame([(1, passage), (2, "short"), (3, passage[:70] + " and then wakes")], "probe_id int, text string")
    pages = spark.createDataFrame([(7, "x " + passage + " y")], "page_id int, text string")
    assert {(r.probe_id, r.match, r.page_id) for r in M.reference_trace(probes, pages).collect()} == {(1, "full", 7), (2, "too short", None), (3, "prefix30", 7)}
    assert ("full", 7) in {(r.match, r.page_id) for r in M.reference_trace(probes, pages, 60).where("probe_id = 3").collect()}


def test_digest_covers_every_digit(spark):
    one = spark.createDataFrame([("g", "n", "a"), ("g", "m", "b")], "g string, n string, b string")
    two = spark.createDataFrame([("g", "n", "b"), ("g", "m", "a")], "g string, n string, b string")
    first, second = (S.content_digest(df, "g", "n", "b").head().digest for df in (one, two))
    assert first != second


def test_threads_with_cycles_end(spark):
    links = [(0, 1, 2), (0, 2, 1), (0, 3, 3), (0, 4, 1), (0, 5, 4), (0, 6, None), (0, 7, 6)]
    comments = spark.createDataFrame(links, "doc_id int, id int, parent int")
    roots = spark.createDataFrame([(0, 1), (0, 3), (0, 6)], "doc_id int, id int")
    got = {(r.root, r.id) for r in H.thread_ids(comments, roots).collect()}
    assert got == {(1, 1), (1, 2), (1, 4), (1, 5), (3, 3), (6, 6), (6, 7)}


def test_scratch_needs_a_shared_folder_beyond_one_machine(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815

        class conf:  # noqa: N801
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(ValueError, match="share"):
        session.scratch_root(Session())


def test_bodies_are_bounded_by_their_signs(spark):
    """Bodies just past 40, 80, 120, 200 and 600 characters, and one of many thousands."""
    from proofline.operators import prose as P
    from proofline.operators import references as R
    from proofline.operators import typography as TY
    from proofline.functions import text as T

    for size in (41, 81, 121, 201, 601, 20_000):
        body = ("word " * (size // 5 + 1))[:size - 1] + "x"
        texts = [f"a [REF: {body}] b", f"a {{{body}, 2020 #12; Roe, 2019 #7{' and more' * (size // 9)}}} b", f"[PMID: none {body}"]
        paras = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id int, para_idx int, text string")
        got = {r.para_idx: r for r in R.placeholder_inventory(paras).collect()}
        assert [got[i].kind for i in range(3)] == ["ref", "temporary", "malformed"]
        assert got[0].key == body and len(got[1].cites) == 2 and got[2].body == texts[2]
        spans = spark.createDataFrame([(f"x [REF: {body}] y {{Doe {body}, 2020}} z",)], "text string").select(F.size(TY.placeholder_spans("text"))).first()[0]
        assert spans == 2
        lines = [f"It is not just {body}, but more.", f"from {body} to there", f"不仅{'长' * size}而且"]
        hits = spark.createDataFrame([(t,) for t in lines], "text string").select(
            F.size(T.spans("text", P.CONTRAST + "|" + P.CONTRAST_OTHER)).alias("c"), F.size(T.spans("text", P.FALSE_RANGE)).alias("f")).collect()
        assert [(r.c, r.f) for r in hits] == [(1, 0), (0, 1), (1, 0)]


def test_one_pass_of_phrases_equals_a_pattern_for_each_rule(spark):
    import random

    from proofline.functions.lexicon import LEXICON, lexicon_from_table
    from proofline.operators import prose as P

    rng = random.Random(3)
    phrases = [p for r in LEXICON for p in (*r.phrases, *r.other_scripts)]
    lines = []
    for _ in range(400):
        parts = []
        for _ in range(rng.randint(0, 8)):
            p = rng.choice(phrases)
            p = rng.choice([p, p.capitalize(), p.upper(), p.replace("'", "’")])
            parts.append(rng.choice(["x ", "Yes. ", "", "é", "y-", "“", "marking "]) + p + rng.choice([" moment", " ", ". ", "s ", "! ", ", and", "，"]))
        lines.append(rng.choice(["", " ", ". "]).join(parts))
    df = spark.createDataFrame([(t,) for t in lines], "text string")
    each = F.concat(*[P._hits(F.col("text"), r.rule, P.phrase_pattern(r.phrases, r.opens_sentence, r.other_scripts), r.weak) for r in LEXICON])
    table = spark.createDataFrame([(r.rule, p, r.weak, r.opens_sentence, p in r.other_scripts, r.replacements.get(p)) for r in LEXICON for p in (*r.phrases, *r.other_scripts)],
                                  "rule string, phrase string, weak boolean, opens_sentence boolean, other_script boolean, replacement string")
    given = lexicon_from_table(table)
    assert {r.rule: (set(r.phrases), r.weak, r.replacements) for r in given} == {r.rule: (set(r.phrases), r.weak, r.replacements) for r in LEXICON}
    rows = df.select(F.array_sort(each).alias("a"), F.array_sort(P.phrase_hits(F.col("text"), LEXICON)).alias("b"), F.array_sort(P.phrase_hits(F.col("text"), given)).alias("c")).collect()
    assert all(r.a == r.b == r.c for r in rows) and sum(len(r.a) for r in rows) > 800


def test_two_groups_with_unlike_limits_in_one_job(spark):
    from proofline.plans.lint import document_profiles, lint_documents, lint_documents_by

    text = "A rather long title of this study\nKeywords: a, b\n# Abstract\nOne two three four five six seven.\n# 1. Introduction\nP = 0.01 and P=0.02.\n# References\n1. X\n2. Y"
    docs = spark.createDataFrame([(1, text, "tight"), (2, text, "loose"), (3, text, None)], "doc_id int, text string, profile_name string")
    profiles = {"tight": {"title": {"max_chars": 10}, "abstract": {"max_words": 3}, "references": {"recommended_max": 1}, "declarations": {"order": ["funding"]}},
                "loose": {"title": {"max_chars": 100}, "keywords": {"min": 1}, "lint": {"disabled_rules": ["declarations.", "stats"]}}}
    import json
    table = spark.createDataFrame([(k, json.dumps(v)) for k, v in profiles.items()], "profile_name string, profile string")
    got = {d: sorted((r.rule, r.message) for r in rows) for d, rows in ((d, [r for r in lint_documents_by(docs, table).collect() if r.doc_id == d]) for d in (1, 2, 3))}
    for d, name in ((1, "tight"), (2, "loose"), (3, None)):
        alone = lint_documents(docs.where(F.col("doc_id") == d).select("doc_id", "text"), profiles.get(name)).collect()
        assert got[d] == sorted((r.rule, r.message) for r in alone), name
    assert {r for r, _ in got[1]} > {"limits.title", "limits.references", "limits.abstract-words"} and not {r for r, _ in got[2]} & {"limits.title", "declarations.missing"}
    assert document_profiles(docs, table).count() == 3


def test_long_lines_of_few_words_are_aligned_whole(spark):
    """One sign moves over a line of 30,000 tokens that repeats three words; nothing else has changed. Rows of bits made twice change nothing."""
    from proofline.operators import alignment as A
    from proofline.operators import versions as V

    rng = random.Random(5)
    for _ in range(200):
        x, y = (["abc"[rng.randrange(3)] for _ in range(rng.randrange(40))] for _ in range(2))
        assert A.least_longest_common(x, y) == A.least_longest_common(x, y, held=16)
    line = " ".join(rng.choice(["one", "two", "three"]) for _ in range(15_000))
    got = V.word_diff(spark.createDataFrame([(1, "¤" + line, line + "¤")], "id long, old string, new string"), joined=False).collect()
    assert sorted((r.old_text, r.new_text, r.old_start, r.new_start) for r in got) == [("", "¤", len(line) + 1, len(line)), ("¤", "", 0, 0)]

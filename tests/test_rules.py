"""Rule semantics on small documents: hits and non-hits."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from proofline.functions import text as T
from proofline.operators import findings as FX
from proofline.operators import limits as L
from proofline.operators import typography as TY
from proofline.operators import units as U
from proofline.operators import wording as W
from proofline.plans.lint import DEFAULT_PROFILE, lint_documents, merge_profile


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")


def paras(spark, *texts):
    return U.structured_paragraphs(docs(spark, *(f"# Results\n{t}" for t in texts)))


def rules_of(df):
    return sorted((r.doc_id, r.rule) for r in df.collect())


def test_spans_agree_with_python(spark):
    texts = ["", "aa b aaa", "é a1b2 à", "x" * 50, "no match here", "a\u0001a", "a  b   c  "]
    for pattern in ("a+", r"\d", " {2,}", "(?<=b) ", "[aà]"):
        got = {r.doc_id: [(s.start, s.end) for s in r.s] for r in docs(spark, *texts).select(
            "doc_id", T.spans("text", pattern).alias("s")).collect()}
        want = {i: [m.span() for m in re.finditer(pattern, t.replace("\u0001", " "))] for i, t in enumerate(texts)}
        assert got == want, pattern


def test_mask_keeps_offsets(spark):
    text = "See https://a.org/x and me@b.org, doi:10.1000/q, 10.1234/z end"
    masked = docs(spark, text).select(T.mask("text")).head()[0]
    assert len(masked) == len(text) and "@" not in masked and "10.1" not in masked and masked.endswith(" end")


@pytest.mark.parametrize("text, want", [
    ("One et al. said so. Two e.g. this. Three.", ["One et al. said so.", "Two e.g. this.", "Three."]),
    ("See Fig. 2 for it. Value 3.5 is high. (A new one.) next", ["See Fig. 2 for it.", "Value 3.5 is high.", "(A new one.) next"]),
    ("J. R. Doe wrote. he left. Then \"Yes.\" Done!", ["J. R. Doe wrote. he left.", "Then \"Yes.\"", "Done!"]),
    ("What?! Really... Yes", ["What?!", "Really...", "Yes"]),
    ("   ", []),
])
def test_sentences(spark, text, want):
    row = docs(spark, text).select(T.sentences("text").alias("a"), T.sentence_spans("text").alias("b")).head()
    assert row.a == want and [text[s.start:s.end] for s in row.b] == want


def test_snippet_is_short_and_holds_the_match(spark):
    text = "a" * 100 + "HIT" + "b" * 100
    got = docs(spark, text).select(T.snippet("text", F.lit(100), F.lit(103))).head()[0]
    assert len(got) <= 80 and "HIT" in got and got.startswith("...") and got.endswith("...")


def test_p_values_follow_majority_and_profile(spark):
    p = paras(spark, "P = 0.1 and P = 0.2 and P=0.3", "p<0.1 and p<0.2", "P =0.1")
    found = TY.statistics(p, {"statistics": {"p_italic": False}})
    assert rules_of(found) == [(0, "stats.p-spacing"), (2, "stats.p-spacing")]
    forced = TY.statistics(p, {"statistics": {"p_italic": False, "p_style": "P = 0.012"}})
    assert (1, "stats.p-case") in rules_of(forced) and (1, "stats.p-spacing") in rules_of(forced)


def test_typography_hits_and_misses(spark):
    hit = paras(spark, "It fell to -5 there", "Kaplan-Meier curve", "at 4 ºC", "in 10-12 weeks", "two  spaces", "a , b", "see Figs. 2")
    assert [r for _, r in rules_of(TY.typography(hit, {}))] == [
        "typo.minus", "typo.eponym-dash", "typo.degree-sign", "typo.range-dash", "typo.double-space",
        "typo.space-before-punctuation", "callout.fig-abbreviation"]
    miss = paras(spark, "3 -5 left", "Kaplan–Meier", "4 °C", "2020-01-02 and a-1-2", "no  break", "is .5 or 1 : 2 or ..", "Figure 2")
    assert rules_of(TY.typography(miss, {})) == [(0, "typo.range-dash")]   # a range, not a minus


def test_placeholders_first_kind_wins(spark):
    p = paras(spark, "[PMID: 1, 2] and [REF: a b] and {Doe, 2020 #4} and {Doe, 2020}", "plain {x}")
    assert len([1 for d, r in rules_of(TY.citation_marks(p, {})) if r == "citation.placeholder"]) == 4
    adjacent = TY.citation_marks(paras(spark, "shown (4) (5, 6) and [1][2]"), {}).collect()
    assert [r.suggestion for r in adjacent] == ["cite them as one group (4, 5, 6)", "cite them as one group (1, 2)"]


def test_spelling_dominant_variety(spark):
    p = paras(spark, "The colour and behaviour of tumours differ in color. Dr Gray left.", "NORMALIZED ONLY")
    hits, summary = W.spelling_varieties(p, DEFAULT_PROFILE)
    assert [tuple(r) for r in summary.collect()] == [(0, "en-GB", 1, 3, 1)]
    assert [r.word for r in hits.where("deviates").collect()] == ["color"]


def test_heading_numbers(spark):
    text = "# 1. A\n## 1.1 B\n## 1.3 C\n# 3. D\n## 2.1 E\n# 3. F"
    got = sorted((r.number, r.problem) for r in W.heading_numbers(U.structured_paragraphs(docs(spark, text))).collect())
    assert got == [("1.3", "skips"), ("2.1", "wrong parent"), ("3", "repeats"), ("3", "skips")]


def test_abbreviations(spark):
    p = paras(spark, "BNP rose. B-type natriuretic peptide (BNP) fell.", "Heart rate (HR) was set. HR rose and HR fell.", "The ABC was used, DNA too, in Boston, MA.")
    got = rules_of(W.abbreviations(p, {}))
    assert got == [(0, "abbrev.before-definition"), (0, "abbrev.single-use"), (2, "abbrev.undefined")]


def test_gene_symbols_need_a_cue_and_roman_type(spark):
    p = paras(spark, "The TP53 gene and expression of BRCA1; ABCD alone; DNA gene")
    assert len(rules_of(W.gene_italics(p, {}))) == 2
    italic = p.withColumn("spans", F.expr("array(named_struct('start', 0, 'end', 99, 'flags', array('italic'), 'kind', '', 'lang', ''))"))
    assert rules_of(W.gene_italics(italic, {})) == []


def test_callout_numbers(spark):
    rows = docs(spark, "1-3, 5", "2 and 4", "1a to 3b", "1-90", "7")
    assert [r[0] for r in rows.orderBy("doc_id").select(L.callout_numbers(F.col("text"))).collect()] == [
        [1, 2, 3, 5], [2, 4], [1, 2, 3], list(range(1, 91)), [7]]


def test_regions_and_title_page(spark):
    text = "Title\n# Abstract\nText\nAbbreviations\nHR\n# 1. Intro\nBody\n# References\n1. X\n# Appendix\nZ\n# Figure legends\nFigure 1: a"
    p = U.structured_paragraphs(docs(spark, text, "A title\nKeywords: a, b"))
    want = ["title", "abstract", "abstract", "front", "front", "body", "body", "references", "references", "appendix", "appendix", "legends", "legends"]
    assert [r.region for r in p.where("doc_id = 0").orderBy("para_idx").collect()] == want
    assert {r.region for r in p.where("doc_id = 1").collect()} == {"title"}
    again = U.assign_regions(p.select("doc_id", "para_idx", "level", "text", "in_table"))
    assert sorted((r.doc_id, r.para_idx, r.region) for r in again.collect()) == sorted((r.doc_id, r.para_idx, r.region) for r in p.collect())


CLEAN = ("A short title\nKeywords: one, two, three, four\n# Abstract\nLevels rose in all groups.\n# 1. Introduction\nWe measured pressure.\n"
         "# 2. Results\nLevels rose, as Figure 1 shows.\n# Author contributions\nAll.\n# Data availability\nOpen.\n# Acknowledgements\nNone.\n"
         "# Declaration of interest\nNone.\n# Funding\nNone.\n# AI disclosure\nNone.\n# References\n1. Doe J. A study. J Test. 2020;1:2.\n# Figure legends\nFigure 1: Levels")


def test_clean_document_has_no_findings_and_leaves_others_alone(spark):
    assert lint_documents(docs(spark, CLEAN), written=False).collect() == []
    bad = CLEAN.replace("We measured pressure.", "We  measured pressure , p=0.1 .")
    alone = {tuple(r)[1:] for r in lint_documents(docs(spark, bad), written=False).collect()}
    both = {tuple(r)[1:] for r in lint_documents(docs(spark, bad, CLEAN), written=False).collect()}
    assert alone == both and {r[1] for r in alone} >= {"typo.double-space", "typo.space-before-punctuation", "stats.p-case"}


def test_partitioning_does_not_change_findings(spark, rows):
    source = docs(spark, *[CLEAN.replace("rose", "rose  , by -5") for _ in range(6)])
    assert rows(lint_documents(source.coalesce(1), written=False)) == rows(lint_documents(source.repartition(5), written=False))


def test_profile_and_disabled_rules(spark):
    assert merge_profile({"a": {"b": 1, "c": 2}}, {"a": {"b": None, "c": 3}}) == {"a": {"b": 1, "c": 3}}
    p = paras(spark, "a  b , c")
    found = TY.typography(p, {})
    assert [r.rule for r in FX.filter_disabled(found, ["typo.double-space"]).collect()] == ["typo.space-before-punctuation"]
    assert FX.filter_disabled(found, ["typo"]).count() == 0
    disabled = spark.createDataFrame([("typo.double-space",), ("heading",)], "prefix string")
    assert [r.rule for r in FX.filter_disabled_by(found, disabled).collect()] == ["typo.space-before-punctuation"]


def test_count_scope(spark):
    df = spark.createDataFrame([(None,), (["References", "abstract"],), (["legends"],)], "e array<string>")
    assert [r[0] for r in df.select(L.count_scope(F.col("e"))).collect()] == [
        "excluding references and figure legends", "excluding references and figure legends", "excluding figure legends and references"]
    assert "to the end of Conclusions" in df.select(L.count_scope(F.col("e"), "strict")).head()[0]


def test_every_rule_is_registered_and_reference_spacing_is_reported(spark):
    from proofline.operators import findings as FX
    from proofline.operators.units import structured_paragraphs
    from proofline.plans.lint import lint_paragraphs

    assert set(FX.REGISTRY) == set(FX.SEVERITIES)
    docs = spark.createDataFrame([(1, "# Title\nText\n# References\n1. Doe J. A study. 2001."), (2, "# Title\nText\n# References\n1. Roe J. A study. 2002.")], "doc_id int, text string")
    styles = spark.createDataFrame([(1, "", None, 480), (2, "", None, 240)], "doc_id int, style string, based_on string, line int")
    found = lint_paragraphs(structured_paragraphs(docs), {"styles": styles}).where("rule = 'format.reference-spacing'")
    assert [r.doc_id for r in found.collect()] == [1]
    assert lint_paragraphs(structured_paragraphs(docs)).where("rule = 'format.reference-spacing'").count() == 0

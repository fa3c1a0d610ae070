"""Every formulaic example hits its rule and its plain counterpart does not."""

from __future__ import annotations

import pytest

from proofline.operators import prose as P

BEFORE_AFTER = [
    ("prose.contrast", "It's not merely a song, it's a statement.", "The heavy beat adds to the tone."),
    ("prose.contrast", "This does not mean every choice is equal. It means there is no system.", "No system confirms which choice is right."),
    ("prose.saying", "The real question is whether teams can adapt.", "The question is whether teams can adapt."),
    ("prose.run-up", "Let's dive into how caching works.", "Next caches data at multiple layers."),
    ("prose.no-one", "A tempting approach would be to restart it.", "Tokens are rotated in place."),
    ("prose.triad", "Expect innovation, inspiration, and insights.", "The event includes talks and panels."),
    ("prose.dash", "The policy — announced late — stands.", "The policy, announced late, stands."),
    ("prose.hyphen-pair", "The team is cross-functional, as agreed.", "A high-quality report arrived."),
    ("prose.passive", "The results are preserved.", "The system preserves the results."),
    ("prose.overused", "Additionally, it is a testament to them.", "Somali cuisine includes camel meat."),
    ("prose.significance", "The future looks bright for them.", "They open two offices."),
    ("prose.vague-link", "He is associated with the band.", "He founded the band."),
    ("prose.rider", "It glows, symbolizing flowers.", "It is painted blue."),
    ("prose.sales", "A breathtaking town, nestled there.", "A town in the region."),
    ("prose.authority", "Experts believe it matters.", "Researchers study the river."),
    ("prose.copula", "It serves as a hall.", "It is a hall."),
    ("prose.bold", "It blends **goals** and plans.", "Junk mente*** and ouier***."),
    ("prose.curly-quote", "He said “yes”.", "He said \"yes\"."),
    ("prose.chat", "Great question! It began in 1789.", "The revolution began in 1789."),
    ("prose.disclaimer", "Details are not publicly available.", "Her early life is not documented."),
    ("prose.filler", "In order to win, go.", "To win, go."),
    ("prose.metaphor", "The substrate holds.", "The base holds."),
    ("prose.fancy", "We utilize it.", "We use it."),
    ("prose.significance", "该研究标志着关键时刻。", "统计局成立于1989年。"),
]


def hits(spark, text, **kwargs):
    df = spark.createDataFrame([(0, text)], "doc_id bigint, text string")
    return [r.rule for r in P.prose_hits(df, **kwargs).collect()]


def test_before_hits_and_after_does_not(spark):
    rows = [(2 * i + k, text) for i, (_, before, after) in enumerate(BEFORE_AFTER) for k, text in enumerate((before, after))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {(r.doc_id, r.rule) for r in P.prose_hits(df, gate=False).collect()}
    for i, (rule, before, after) in enumerate(BEFORE_AFTER):
        assert (2 * i, rule) in found, before
        assert (2 * i + 1, rule) not in found, after


def test_weak_hit_needs_company(spark):
    assert "prose.dash" not in hits(spark, "The policy — late — stands.")
    assert "prose.dash" in hits(spark, "It boasts a hall — nestled there — and it serves as a testament.")


def test_quotation_is_exempt(spark):
    assert "prose.chat" not in hits(spark, 'He said "Great question! Let me know" twice.', gate=False)
    assert "prose.chat" in hits(spark, 'Great question! He said "yes".', gate=False)


@pytest.mark.parametrize("fn, text, want", [
    (P.repeated_openings, "She saw. She came. She left. He stayed.", 1),
    (P.repeated_openings, "She saw. He came. She left.", 0),
    (P.fragment_runs, "No taste. No nostalgia. No rules at all.", 1),
    (P.equal_lengths, "One two three. Four five six. Seven eight nine.", 1),
    (P.stacked_qualifiers, "It could potentially work.", 1),
    (P.stacked_qualifiers, "It could work.", 0),
    (P.repeated_closers, "Caching helps.\nThat is the win.\nRetries help.\nThat is the win.", 1),
    (P.repeated_headings, "# Performance matters\nPerformance matters here.\nReal text.", 1),
    (P.heading_style, "## Strategic Negotiations And Global Partnerships", 1),
    (P.heading_style, "## Strategic negotiations and global partnerships", 0),
])
def test_shape_rules(spark, fn, text, want):
    df = spark.createDataFrame([(0, text)], "doc_id bigint, text string")
    assert fn(df).count() == want

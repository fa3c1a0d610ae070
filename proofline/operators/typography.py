"""Statistics and typography rules.

All single-paragraph rules of a family are one array of findings per paragraph and one explode, so
any number of rules costs one pass over the text and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions import text as T
from proofline.operators.findings import finding, rule, spread

SP = T.OPERATOR_SPACE

# Patterns of the checked notations.
P_VALUE = rf"(?<![A-Za-z0-9_Ͱ-Ͽ])([Pp])({SP}*)([=<>≤≥⩽⩾])({SP}*)(?=[−\-]?\.?\d)"
Q_VALUE = rf"(?<![A-Za-z0-9_Ͱ-Ͽ])(q)({SP}*)([=<>≤≥⩽⩾])({SP}*)(?=\.?\d)"
SAMPLE_SIZE = rf"(?<![A-Za-z0-9_Ͱ-Ͽ])(n)({SP}*)(=)({SP}*)(?=\d)"
PLUS_MINUS = rf"(?<=[\d%)])({SP}*)(±)({SP}*)(?=[\d(−\-.])"
COMPARISONS = ("=", "<", ">", "≤", "≥", "⩽", "⩾")
HYPHENS = ("-", "‐")
STYLE_EXAMPLE = rf"({SP}*)[=<>≤≥±]({SP}*)"
MINUS = r"(?U)(?:^|(?<=[\s(\[=<>≤≥±~≈,;:/\u0000]))[-‐](?=\.?\d)"
RANGE = (rf"(?U)(?<![\w.,\-/‐−–])(\d+(?:\.\d+)?)({SP}?[-‐]{SP}?)(\d+(?:\.\d+)?)"
         r"(?![\w\-/‐]|\.\d)")
DOUBLE_SPACE = r" {2,}"
SPACE_PUNCTUATION = r"(?U)(?<=[^\s\u0000]) +(?=[,.;:!?)\]])"
DEGREE = rf"(?U)\d{SP}?º|º{SP}?[CF]\b"
FIGURE_ABBREVIATION = rf"(?U)(\bFig)(s?)(\.)(?={SP}*S?\d)"
EPONYM_PAIRS = (
    ("Mann", "Whitney"), ("Benjamini", "Hochberg"), ("Benjamini", "Yekutieli"), ("Kenward", "Roger"),
    ("D['’]Agostino", "Pearson"), ("Kruskal", "Wallis"), ("Kaplan", "Meier"), ("Bland", "Altman"),
    ("Kolmogorov", "Smirnov"), ("Shapiro", "Wilk"), ("Hosmer", "Lemeshow"), ("Mantel", "Haenszel"),
    ("Newman", "Keuls"), ("Tukey", "Kramer"), ("Games", "Howell"), ("Brown", "Forsythe"),
    ("Holm", "(?:Šidák|Sidak|Bonferroni)"), ("Michaelis", "Menten"), ("Cochran", "Armitage"),
    ("Wilcoxon", "Mann"), ("Welch", "Satterthwaite"),
)
EPONYM = r"(?U)\b(?:" + "|".join(f"{a}[-‐‑]{b}" for a, b in EPONYM_PAIRS) + r")\b"
ADDRESS_PLACEHOLDER = (r"(?i)\[PMIDs?\s*:\s*[\d,;\s]+\]|\[REF\s*:\s*[^\]\n]+\]"
                       r"|\{[^{}\n]+?#\d+[^{}\n]*\}")
REFERENCE_PLACEHOLDER = r"(?i)\[REFS?\s*:\s*[^\]\n]+\]"
BRACE_PLACEHOLDER = (r"\{[A-Z][^{}\n]*?,\s*(?:\d{4}[a-z]?|n\.d\.|in press)(?:\s*#\s*\d+)?"
                     r"(?:\s*;[^{}\n]*)?\}")
PLACEHOLDERS = (ADDRESS_PLACEHOLDER, REFERENCE_PLACEHOLDER, BRACE_PLACEHOLDER)
CITATION_GROUP = rf"\d{{1,4}}(?:{SP}*[,–\-]{SP}*\d{{1,4}})*"
ADJACENT_GROUPS = (rf"\({CITATION_GROUP}\){SP}*\({CITATION_GROUP}\)"
                   rf"|\[{CITATION_GROUP}\]{SP}*\[{CITATION_GROUP}\]")


def prose_scope(paras: DataFrame) -> DataFrame:
    """Paragraphs that statistics and typography rules read: not title, not bibliography, not blank."""
    return paras.where((F.col("region") != "title") & ~F.col("is_bib") & (F.btrim("text") != ""))


def spacing_of(left: Column, right: Column) -> Column:
    return (F.when((left != "") & (right != ""), "spaced").when((left == "") & (right == ""), "unspaced")
            .otherwise("uneven"))


def majority(df: DataFrame, keys: list[str], kind: str, fallback: str, order: str | None = None) -> DataFrame:
    """Most frequent kind per key; the fallback wins a tie it takes part in, else the first seen."""
    aggs = [F.count("*").alias("n")]
    if order:
        aggs.append(F.min(order).alias("first"))
    counts = df.where(F.col(kind).isNotNull()).groupBy(*keys, kind).agg(*aggs)
    tie = -F.col("first") if order else F.lit(0)
    best = F.max_by(kind, F.struct("n", (F.col(kind) == fallback).cast("int"), tie))
    return counts.groupBy(*keys).agg(best.alias("expected"))


def flagged_at(position: Column, flag: str) -> Column:
    """Does the span that covers a character carry a flag?"""
    return F.exists(
        "spans", lambda s: (s["start"] <= position) & (position < s["end"]) & F.array_contains(s["flags"], flag))


def _style_spacing(example: str | None) -> str | None:
    """Spacing of a notation example from the profile ('P = 0.012'); configuration, not data."""
    import re
    found = re.search(STYLE_EXAMPLE, example) if isinstance(example, str) and example else None
    if not found:
        return None
    left, right = found.groups()
    return "spaced" if left and right else "unspaced" if not left and not right else "uneven"


def statistics_spans(paras: DataFrame) -> DataFrame:
    """Every P value, q value, sample size and mean-with-spread in the prose, one row each."""
    def shaped(family, pattern, groups, letter, left, op, right, hints):
        return F.transform(T.spans("masked", pattern, groups, hints=hints), lambda s: F.struct(
            F.lit(family).alias("family"), s["start"].alias("start"), s["end"].alias("end"),
            (F.get(s["groups"], letter) if letter is not None else F.lit("")).alias("letter"),
            F.get(s["groups"], op).alias("op"),
            spacing_of(F.get(s["groups"], left), F.get(s["groups"], right)).alias("kind"),
            flagged_at(s["start"], "italic").alias("italic"),
        ))

    found = F.concat(
        shaped("p", P_VALUE, 4, 0, 1, 2, 3, COMPARISONS), shaped("q", Q_VALUE, 4, 0, 1, 2, 3, COMPARISONS),
        shaped("n", SAMPLE_SIZE, 4, 0, 1, 2, 3, ("=",)), shaped("pm", PLUS_MINUS, 3, None, 0, 1, 2, ("±",)),
    )
    rows = prose_scope(paras).select("doc_id", "para_idx", "section", "text", F.explode(found).alias("s"))
    return rows.select("doc_id", "para_idx", "section", "text", "s.*")


@rule("stats.p-spacing", "stats.p-case", "stats.p-italic", "stats.q-spacing", "stats.n-spacing", "stats.pm-spacing")
def statistics(paras: DataFrame, profile: dict) -> DataFrame:
    """Notation that differs from the profile or, without one, from the document's own majority.

    Majorities are window aggregates over a document's notations, so the spans meet their own
    counts in the same shuffle and are never joined to themselves.
    """
    stats = profile.get("statistics") or {}
    doc = Window.partitionBy("doc_id")
    hits = statistics_spans(paras)
    tally = lambda fam, cond: F.count_if((F.col("family") == fam) & cond).over(doc)
    # all tallies in one projection, so one window operator computes them together
    counts = {f"{fam}_{kind}": tally(fam, F.col("kind") == kind) for fam in ("p", "q", "n", "pm") for kind in ("spaced", "unspaced")}
    counts |= {"upper": tally("p", F.col("letter") == "P"), "lower": tally("p", F.col("letter") == "p"),
               "n_italic": tally("p", F.col("italic")), "n_roman": tally("p", ~F.col("italic"))}
    hits = hits.withColumns(counts)

    def expected(fam, key, fallback):
        fixed = _style_spacing(stats.get(key)) if key else None
        if fixed:
            return F.lit(fixed)
        a, b = F.col(f"{fam}_spaced"), F.col(f"{fam}_unspaced")
        return F.when(a > b, "spaced").when(b > a, "unspaced").otherwise(fallback)

    p_style = stats.get("p_style")
    want_p = expected("p", "p_style", F.lit("spaced"))
    want = (F.when(F.col("family") == "p", want_p)
            .when(F.col("family") == "q", expected("q", "q_style", want_p))
            .when(F.col("family") == "n", expected("n", "n_style", want_p))
            .otherwise(expected("pm", "mean_sd_style", F.lit("spaced"))))
    if isinstance(p_style, str) and p_style.strip()[:1] in ("P", "p"):
        want_case = F.lit(p_style.strip()[0])
    else:
        want_case = F.when(F.col("lower") > F.col("upper"), "p").otherwise("P")
    if isinstance(stats.get("p_italic"), bool):
        want_italic = F.lit(stats["p_italic"])
    else:
        want_italic = F.col("n_italic") >= F.col("n_roman")
    hits = hits.withColumn("want", want).withColumn("want_case", want_case).withColumn("want_italic", want_italic)
    is_p, is_pm = F.col("family") == "p", F.col("family") == "pm"
    sign = F.when(is_p, F.col("want_case")).otherwise(F.col("letter"))
    form = F.when(F.col("want") == "spaced", F.concat(sign, F.lit(" "), F.col("op"), F.lit(" "))).otherwise(
        F.concat(sign, F.col("op")))
    reach = F.when(is_p, 6).otherwise(4)
    begin = F.col("start") - F.when(is_pm, 4).otherwise(0)
    bad = (F.col("kind") == "uneven") | (F.col("kind") != F.col("want"))
    spacing = F.when(bad, finding(
        F.concat(F.lit("stats."), F.col("family"), F.lit("-spacing")), begin, F.col("end") + reach,
        F.concat(F.lit("written "), F.col("kind"), F.lit("; expected "), F.col("want")),
        F.when(is_pm, F.when(F.col("want") == "spaced", "write '12.3 ± 4.5'").otherwise("write '12.3±4.5'"))
        .otherwise(F.concat(F.lit("write '"), form, F.lit("'")))))
    case = F.when(is_p & (F.col("letter") != F.col("want_case")), finding(
        "stats.p-case", F.col("start"), F.col("end") + 6, F.concat(F.col("letter"), F.lit(" used for a P value")),
        F.concat(F.lit("use '"), F.col("want_case"), F.lit("'"))))
    italic = F.when(is_p & (F.col("italic") != F.col("want_italic")), finding(
        "stats.p-italic", F.col("start"), F.col("end") + 6,
        F.when(F.col("italic"), "P is italic").otherwise("P is roman"),
        F.when(F.col("want_italic"), "set P in italic").otherwise("set P in roman")))
    return spread(hits, F.array_compact(F.array(spacing, case, italic)))


def _found(spans: Column, name: str, message: str, suggestion, before=0, after=0, keep=None) -> Column:
    picked = F.filter(spans, keep) if keep is not None else spans
    advice = suggestion if callable(suggestion) else (lambda s: F.lit(suggestion))
    return F.transform(picked, lambda s: finding(
        name, s["start"] - before, s["end"] + after, F.concat(F.lit(message + ": "), s["match"]), advice(s)))


def typography_hits(text: str = "masked") -> Column:
    """Findings of the context-free typography rules of one paragraph."""
    body = F.col(text)
    digit_before = lambda s: F.regexp_replace(F.substr(body, F.lit(1), s["start"]), "[  ]+$", "").rlike(r"(?U)\d$")
    next_two = lambda s: F.substr(body, s["end"] + 1, F.lit(2))
    ratio = lambda s: (
        F.substr(body, s["end"] + 1, F.lit(8)).rlike(r"(?U)^:\s*\d")
        & F.substr(body, s["start"], F.lit(1)).rlike(r"(?U)\d"))
    return F.concat(
        _found(T.spans(body, MINUS, hints=HYPHENS), "typo.minus", "hyphen used as a minus sign", "use the minus sign U+2212",
               after=5, keep=lambda s: ~digit_before(s)),
        _found(T.spans(body, EPONYM, hints=(*HYPHENS, "‑")), "typo.eponym-dash", "names joined by a hyphen", lambda s: F.concat(
            F.lit("use an en dash: "), F.regexp_replace(s["match"], "[-‐‑]", "–"))),
        _found(T.spans(body, DEGREE, hints=("º",)), "typo.degree-sign", "ordinal indicator used for degrees",
               "use the degree sign U+00B0"),
        _found(T.spans(body, RANGE, 3, hints=HYPHENS), "typo.range-dash", "hyphen in a numeric range", lambda s: F.concat(
            F.lit("use an en dash: "), F.get(s["groups"], 0), F.lit("–"), F.get(s["groups"], 2))),
        _found(T.spans(body, DOUBLE_SPACE, hints=("  ",)), "typo.double-space", "several spaces in a row", "use one space"),
        _found(T.spans(body, SPACE_PUNCTUATION, hints=tuple(f" {c}" for c in ",.;:!?)]")), "typo.space-before-punctuation", "space before punctuation",
               "remove the space", after=1,
               keep=lambda s: ~(next_two(s).rlike(r"(?U)^\.(?:\d|\.$)") | ratio(s))),
        F.when(F.col("region") == "references", F.array().cast("array<struct<rule:string,severity:string,start:int,"
               "end:int,message:string,suggestion:string>>")).otherwise(
            _found(T.spans(body, FIGURE_ABBREVIATION, 3, hints=("Fig",)), "callout.fig-abbreviation", "abbreviated call-out",
                   lambda s: F.when(F.get(s["groups"], 1) == "", "write 'Figure'").otherwise("write 'Figures'"),
                   after=3)),
    )


@rule("typo.minus", "typo.eponym-dash", "typo.degree-sign", "typo.range-dash", "typo.double-space",
      "typo.space-before-punctuation", "callout.fig-abbreviation")
def typography(paras: DataFrame, profile: dict) -> DataFrame:
    return spread(prose_scope(paras), typography_hits())


def placeholder_spans(text) -> Column:
    """Citation placeholders of three kinds; an earlier kind wins where two overlap."""
    def add(found, pattern):
        return T.let(found, lambda taken: F.concat(taken, F.filter(
            T.spans(text, pattern, hints=("[", "{")), lambda m: ~F.exists(taken, lambda s: (
                (s["start"] <= m["start"]) & (m["start"] < s["end"])
                | (m["start"] <= s["start"]) & (s["start"] < m["end"]))))))

    taken = T.spans(text, PLACEHOLDERS[0], hints=("[", "{"))
    for pattern in PLACEHOLDERS[1:]:
        taken = add(taken, pattern)
    return taken


@rule("citation.placeholder", "citation.adjacent-groups")
def citation_marks(paras: DataFrame, profile: dict) -> DataFrame:
    scope = paras.where(~F.col("is_bib") & F.col("text").rlike(r"[\[{(]"))
    groups = lambda s: F.array_join(F.regexp_extract_all(
        s["match"], F.lit(rf"[(\[]({CITATION_GROUP})[)\]]"), F.lit(1)), ", ")
    found = F.concat(
        _found(placeholder_spans(F.col("text")), "citation.placeholder", "unconverted citation placeholder",
               "insert the citation"),
        _found(T.spans("text", ADJACENT_GROUPS, hints=(")", "]")), "citation.adjacent-groups", "separate adjacent citation groups",
               lambda s: F.concat(F.lit("cite them as one group ("), groups(s), F.lit(")"))),
    )
    return spread(scope, found)

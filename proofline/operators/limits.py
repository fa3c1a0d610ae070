"""Figures, limits, word counts and declarations of whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions import text as T
from proofline.operators.findings import document_findings, rule, union_all
from proofline.operators.settings import DocumentProfiles, with_settings
from proofline.operators.units import REFERENCES_HEAD, TITLE_PAGE_LABEL
from proofline.session import materialise

# -- figures -----------------------------------------------------------------------------------

# Caption and call-out forms.
CAPTION = r"^[\s\f]*Figure\s+(\d+)\s*[.:]"
CALL_OUT = (r"(?<![A-Za-z])(Supplementa(?:ry|l)\s+|)(Figs?\.|Figures?)(\s*)"
            r"(\d+[A-Za-z]*(?:\s*(?:,|and|&|–|—|-|to)\s*\d+[A-Za-z]*)*)")


def callout_numbers(group: Column, longest: int | None = None) -> Column:
    """'1-3, 5' -> [1, 2, 3, 5]; with ``longest``, a range that long or longer is two single numbers."""
    tokens = F.regexp_extract_all(group, F.lit(r"\d+|,|and|&|–|—|-|to"), F.lit(0))

    def step(acc, token):
        value = token.try_cast("int")
        last = F.try_element_at(acc["out"], F.lit(-1))
        fills = acc["pending"] & last.isNotNull() & (value > last)
        fills = fills if longest is None else fills & (value - last < longest)
        grown = F.when(F.coalesce(fills, F.lit(False)), F.concat(acc["out"], F.sequence(last + 1, value))).otherwise(
            F.concat(acc["out"], F.array(value)))
        return F.struct(
            F.when(value.isNotNull(), grown).otherwise(acc["out"]).alias("out"),
            F.when(value.isNotNull(), False).when(token.isin("–", "—", "-", "to"), True)
            .otherwise(acc["pending"]).alias("pending"))

    start = F.struct(F.from_json(F.lit("[]"), "array<int>").alias("out"), F.lit(False).alias("pending"))
    return F.aggregate(tokens, start, step, lambda acc: acc["out"])


def _is_caption() -> Column:
    return F.col("text").rlike(CAPTION) & (
        (F.col("region") == "legends") | (F.col("level") > 0) | F.lower("style").contains("caption"))


def figure_marks(paras: DataFrame, also: Column | None = None) -> DataFrame:
    """Captions and call-outs (and paragraphs for which ``also`` holds) in one pass over the text, written to the shared folder.

    (doc_id, para_idx, caption, calls, also): a caption's figure number, call-outs with offsets and groups. Everything about figures is derived
    from these few rows, so the paragraphs are not made again for each question.
    """
    number = F.when(_is_caption() & ~F.col("title_page_only"), F.regexp_extract("text", CAPTION, 1).try_cast("int"))
    captioned = _is_caption() & ~F.col("title_page_only")
    cited = (F.col("text").contains("Fig") & F.col("region").isin("abstract", "body") & ~F.col("is_bib") & ~F.col("title_page_only")
             & ~_is_caption())
    calls = F.filter(T.spans("text", CALL_OUT, 4, hints=("Fig",)), lambda s: F.get(s["groups"], 0) == "")
    also = F.lit(False) if also is None else also
    rows = paras.where(F.col("text").contains("Fig") | also)
    rows = rows.select("doc_id", "para_idx", captioned.alias("captioned"), number.alias("caption"), F.when(cited, calls).alias("calls"), also.alias("also"))
    return materialise(rows.where(F.col("captioned") | F.col("also") | (F.size("calls") > 0)), "figure-marks")


def figure_captions(marks: DataFrame) -> DataFrame:
    """First caption paragraph of each figure number."""
    return marks.where("captioned").groupBy("doc_id", F.col("caption").alias("figure")).agg(F.min("para_idx").alias("para_idx"))


def figure_calls(marks: DataFrame) -> DataFrame:
    """First call-out of each figure number, in text order."""
    rows = marks.select("doc_id", "para_idx", F.explode("calls").alias("s"))
    rows = rows.select("doc_id", "para_idx", "s.start", "s.end",
                       F.posexplode(callout_numbers(F.get("s.groups", 3))).alias("pos", "figure"))
    return rows.groupBy("doc_id", "figure").agg(F.min(F.struct("para_idx", "start", "pos", "end")).alias("first"))


def figure_order(calls: DataFrame) -> DataFrame:
    """Figures first cited below the highest number cited so far."""
    before = Window.partitionBy("doc_id").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    return calls.withColumn("highest", F.max("figure").over(before)).where(F.col("figure") < F.col("highest"))


@rule("figures.order", "figures.uncited", "figures.missing-legend", "figures.gap", "limits.figures")
def figures(paras: DataFrame, profile: dict) -> DataFrame:
    marks = figure_marks(paras)
    captions, calls = figure_captions(marks), figure_calls(marks)
    at = {"para_idx": F.col("first.para_idx"), "start": F.col("first.start"), "end": F.col("first.end")}
    out = [document_findings(figure_order(calls), "figures.order", F.concat_ws(
        " ", F.lit("Figure"), F.col("figure"), F.lit("is first cited after Figure"), F.col("highest")), **at)]
    uncited = captions.join(calls.select("doc_id", "figure"), ["doc_id", "figure"], "left_anti")
    out.append(document_findings(uncited, "figures.uncited", F.concat_ws(
        " ", F.lit("Figure"), F.col("figure"), F.lit("has a legend but is never cited")), para_idx=F.col("para_idx"),
        start=0, end=60))
    with_legends = captions.select("doc_id").distinct()
    missing = calls.join(with_legends, "doc_id", "left_semi").join(
        captions.select("doc_id", "figure"), ["doc_id", "figure"], "left_anti")
    out.append(document_findings(missing, "figures.missing-legend", F.concat_ws(
        " ", F.lit("Figure"), F.col("figure"), F.lit("is cited but has no legend")), **at))
    gaps = figure_gaps(captions, calls)
    out.append(document_findings(gaps, "figures.gap", F.concat_ws(
        " ", F.lit("Figure"), F.col("figure"), F.lit("is never cited")), **at))
    over = with_settings(figure_counts(captions, calls), profile, _top="figures.recommended_max").where("_top > 0 AND figures > _top")
    out.append(document_findings(over, "limits.figures", F.concat_ws(
        " ", F.col("figures"), F.lit("figures; at most"), F.col("_top"), F.lit("recommended"))))
    return union_all(out)


def figure_gaps(captions: DataFrame, calls: DataFrame) -> DataFrame:
    """Numbers skipped by the call-outs of documents without any legend."""
    bare = calls.join(captions.select("doc_id").distinct(), "doc_id", "left_anti")
    top = bare.groupBy("doc_id").agg(F.max("figure").alias("top"), F.max_by("first", "figure").alias("first"))
    spine = top.where(F.col("top") > 1).select(
        "doc_id", "first", F.explode(F.sequence(F.lit(1), F.col("top") - 1)).alias("figure"))
    return spine.join(bare.select("doc_id", "figure"), ["doc_id", "figure"], "left_anti")


def figure_counts(captions: DataFrame, calls: DataFrame) -> DataFrame:
    """Number of legends, or the highest cited number when there are none."""
    legends = captions.groupBy("doc_id").agg(F.count("*").cast("int").alias("legends"))
    cited = calls.groupBy("doc_id").agg(F.max("figure").alias("top"))
    return legends.join(cited, "doc_id", "full").select("doc_id", F.coalesce("legends", "top").alias("figures"))


# -- word counts -------------------------------------------------------------------------------

# Stated word counts.
WORD_COUNT_LINE = r"(?i)^\s*word count\s*:"
STATED_COUNT = r"(?i)word count\s*:\s*(\d[\d,.    ]*\d|\d)(?:\s*words?\b)?"
STATED_SCOPE = r"(?i)word count\s*:\s*(?:\d[\d,.    ]*\d|\d)\s*words?\s*\(([^()]*)\)"
# Headings that bound the counted text.
BOUND_ABSTRACT = r"(?i)^\s*abstract\b"
BOUND_INTRODUCTION = r"(?i)^\s*(?:\d+\.?\s*)?introduction\b"
BOUND_KEYWORDS = r"(?i)^\s*key\s*words?\b"
BOUND_CONCLUSIONS = r"(?i)^\s*(?:\d+\.?\s*)?conclusions?\b"


def section_bounds(paras: DataFrame) -> DataFrame:
    """Positions of abstract, introduction, conclusions and references, each sought after the last.

    Only headings and two label lines are grouped per document. ``missing`` names the first
    boundary that is not there.
    """
    text, top = F.col("text"), F.col("level") == 1
    bare = F.lower(F.btrim(F.regexp_replace(F.btrim("text"), r"[\s:]+$", "")))
    label = (bare == "abbreviations") | text.rlike(BOUND_KEYWORDS)
    marks = paras.where(top | label).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(
        "para_idx", top.alias("top"), (top & text.rlike(BOUND_ABSTRACT)).alias("abstract"),
        (top & text.rlike(BOUND_INTRODUCTION)).alias("introduction"),
        (top & text.rlike(REFERENCES_HEAD)).alias("references"),
        (top & text.rlike(BOUND_CONCLUSIONS)).alias("conclusions"),
        (top & ~text.rlike(r"^\s*\d")).alias("unnumbered"), label.alias("label")))).alias("m"))

    def first(flag: str, after: Column, before: Column | None = None) -> Column:
        def ok(m):
            hit = m[flag] & (m["para_idx"] > after)
            return hit & (m["para_idx"] < before) if before is not None else hit
        return F.get(F.filter("m", ok), 0)["para_idx"]

    out = marks.withColumn("abstract", first("abstract", F.lit(-1)))
    out = out.withColumn("introduction", first("introduction", F.col("abstract")))
    out = out.withColumn("references", first("references", F.col("introduction")))
    out = out.withColumn("abstract_end", F.coalesce(
        first("label", F.col("abstract"), F.col("introduction")),
        first("top", F.col("abstract"), F.col("introduction")), F.col("introduction")))
    out = out.withColumn("conclusions", first("conclusions", F.col("introduction"), F.col("references")))
    out = out.withColumn("strict_end", F.when(
        F.col("conclusions").isNotNull(), first("top", F.col("conclusions"), F.col("references"))).otherwise(
            first("unnumbered", F.col("introduction"), F.col("references"))))
    out = out.withColumn("strict_end", F.coalesce("strict_end", "references"))
    missing = (F.when(F.col("abstract").isNull(), "abstract").when(F.col("introduction").isNull(), "introduction")
               .when(F.col("references").isNull(), "references"))
    return out.select("doc_id", "abstract", "abstract_end", "introduction", "conclusions", "strict_end",
                      "references", missing.alias("missing"))


def word_counts(paras: DataFrame) -> DataFrame:
    """House count (abstract and body with headings) and strict count (to the end of the conclusions)."""
    bounds = section_bounds(paras).where(F.col("missing").isNull())
    words = paras.where(~F.col("text").rlike(WORD_COUNT_LINE)).select(
        "doc_id", "para_idx", "level", T.word_count("text").alias("w"))
    i = F.col("para_idx")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("w"))), F.lit(0)).cast("bigint")
    sums = words.join(bounds, "doc_id").groupBy("doc_id").agg(
        total((i > F.col("abstract")) & (i < F.col("abstract_end"))).alias("abstract"),
        total((i >= F.col("introduction")) & (i < F.col("references"))).alias("house_body"),
        total((i >= F.col("introduction")) & (i < F.col("strict_end")) & (F.col("level") == 0)).alias("strict_body"))
    return sums.select("doc_id", "abstract", (F.col("abstract") + F.col("house_body")).alias("house"),
                       (F.col("abstract") + F.col("strict_body")).alias("strict"))


def stated_counts(paras: DataFrame) -> DataFrame:
    """The first 'Word count: N words (scope)' line of each document."""
    line = paras.where(F.col("text").rlike(WORD_COUNT_LINE)).groupBy("doc_id").agg(
        F.min(F.struct("para_idx", "text")).alias("l"))
    number = F.regexp_replace(F.regexp_extract("l.text", STATED_COUNT, 1), r"\D", "")
    scope = F.regexp_extract("l.text", STATED_SCOPE, 1)
    return line.select("doc_id", F.col("l.para_idx").alias("para_idx"), number.try_cast("bigint").alias("stated"),
                       F.when(scope != "", F.btrim(F.regexp_replace(scope, r"\s+", " "))).alias("scope"))


def count_status(counts: DataFrame, stated: DataFrame, maximum: Column) -> DataFrame:
    """Computed against stated and allowed count."""
    over = F.col("house") - maximum
    return counts.join(stated.select("doc_id", "stated"), "doc_id", "left").select(
        "doc_id", "house", "strict", "stated", (F.col("stated") == F.col("house")).alias("matches"),
        F.when(maximum.isNull(), "no limit").when(over > 0, "over").otherwise("within").alias("status"),
        F.greatest(over, F.lit(0)).alias("over_by"))


# Profile keys for excluded parts and the words title pages use for them.
EXCLUSION_WORDS = {
    "references": "references", "figure_legends": "figure legends", "legends": "figure legends",
    "supplementary": "supplementary material", "supplementary_material": "supplementary material",
    "supplementary_legends": "supplementary legends", "tables": "tables", "title_page": "title page",
    "abbreviations": "abbreviations", "abstract": "abstract", "headings": "headings", "limitations": "Limitations",
    "back_matter": "back matter", "declarations": "declarations", "acknowledgements": "acknowledgements",
    "author_contributions": "author contributions", "funding": "funding", "data_availability": "data availability",
}
LEFT_OUT_ALWAYS = ("references", "figure_legends", "legends", "supplementary", "supplementary_material",
                   "supplementary_legends", "tables", "title_page", "abbreviations")
LEFT_OUT_STRICT = ("headings", "limitations", "back_matter", "declarations", "acknowledgements",
                   "author_contributions", "funding", "data_availability")
NAMED_ALWAYS = ("references", "figure_legends")
NAMED_STRICT = ("headings", "limitations", "back_matter")


def count_scope(excludes: Column, method: str = "house") -> Column:
    """The wording a title page should use for what the count leaves out, from the profile's list column."""
    if method not in ("house", "strict"):
        raise ValueError("method must be 'house' or 'strict'")
    left_out = LEFT_OUT_ALWAYS + (LEFT_OUT_STRICT if method == "strict" else ())
    lits = lambda names: F.array(*[F.lit(n) for n in names])
    listed = F.coalesce(
        F.transform(excludes, lambda e: F.translate(F.lower(F.btrim(e)), " -", "__")), lits(NAMED_ALWAYS))
    names = F.filter(listed, lambda e: e.isin(*left_out))
    if method == "strict":
        names = F.concat(lits(NAMED_STRICT), names)
    for key in NAMED_ALWAYS:
        known = F.array_contains(names, key)
        if key == "figure_legends":
            known = known | F.array_contains(names, "legends")
        names = F.when(known, names).otherwise(F.concat(names, F.array(F.lit(key))))
    lookup = F.create_map(*[F.lit(x) for item in EXCLUSION_WORDS.items() for x in item])
    words = F.array_distinct(F.transform(names, lambda n: F.element_at(lookup, n)))
    head = F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), ", ")
    joined = F.when(F.size(words) == 1, head).otherwise(F.concat(head, F.lit(" and "), F.element_at(words, -1)))
    lead = "abstract and main text to the end of Conclusions; excluding " if method == "strict" else "excluding "
    return F.concat(F.lit(lead), joined)


# -- limits ------------------------------------------------------------------------------------

# Running title and keyword lines.
RUNNING_TITLE = r"(?is)^\s*(?:running\s+(?:title|head)|short\s+title)\s*:\s*(.*)$"
KEYWORDS = r"(?is)^\s*key\s?-?words?\s*:\s*(.*)$"


def title_measures(paras: DataFrame, count_spaces: bool = True) -> DataFrame:
    """Title, running title and keyword counts of each document, with their first paragraphs."""
    text = F.col("text")
    in_title = (F.col("region") == "title") & (F.btrim("text") != "")
    plain = in_title & (F.col("title_page_only") | ~text.rlike(TITLE_PAGE_LABEL))
    styled = in_title & (F.lower("style") == "title")
    at = F.struct("para_idx", "text")
    per = paras.groupBy("doc_id").agg(
        F.min(F.when(styled, at)).alias("styled"), F.min(F.when(plain, at)).alias("plain"),
        F.min(F.when(text.rlike(RUNNING_TITLE), at)).alias("running"),
        F.min(F.when(text.rlike(KEYWORDS), at)).alias("keywords"))
    title = F.coalesce("styled", "plain")
    running = F.btrim(F.regexp_extract("running.text", RUNNING_TITLE, 1))
    listed = F.regexp_replace(F.btrim(F.regexp_extract("keywords.text", KEYWORDS, 1)), r"\.+$", "")
    words = F.filter(F.transform(F.split(listed, "[,;]"), lambda k: F.btrim(k)), lambda k: k != "")
    return per.select(
        "doc_id", title["para_idx"].alias("title_idx"), F.length(F.btrim(title["text"])).alias("title_chars"),
        F.col("running.para_idx").alias("running_idx"),
        F.length(running if count_spaces else F.replace(running, F.lit(" "), F.lit(""))).alias("running_chars"),
        F.length(F.replace(running, F.lit(" "), F.lit(""))).alias("running_solid"),
        F.col("keywords.para_idx").alias("keywords_idx"),
        F.when(F.col("keywords").isNotNull(), F.size(words)).alias("keywords"))


@rule("limits.title", "limits.running-title", "limits.keywords", "limits.missing")
def title_limits(paras: DataFrame, profile: dict) -> DataFrame:
    m = with_settings(title_measures(paras), profile, _title="title.max_chars", _short="short_title.max_chars",
                      _spaces="short_title.counts_spaces", _most="keywords.max", _least="keywords.min")
    m = m.withColumn("running_chars", F.when(F.coalesce("_spaces", F.lit(True)), F.col("running_chars")).otherwise(F.col("running_solid")))
    out = []

    def over(column, limit, name, label, idx, low=False):
        beyond = (F.col(limit) > 0) & (F.col(column) < F.col(limit) if low else F.col(column) > F.col(limit))
        out.append(document_findings(m.where(beyond), name, F.concat_ws(
            " ", F.lit(label), F.col(column), F.lit("under the minimum of" if low else "over the limit of"), F.col(limit)), para_idx=F.col(idx)))

    def missing(column, limit, label):
        out.append(document_findings(m.where((F.col(limit) > 0) & F.col(column).isNull()), "limits.missing", f"no {label} found"))

    over("title_chars", "_title", "limits.title", "title characters:", "title_idx")
    missing("title_idx", "_title", "title")
    over("running_chars", "_short", "limits.running-title", "running title characters:", "running_idx")
    missing("running_idx", "_short", "running title")
    over("keywords", "_most", "limits.keywords", "keywords:", "keywords_idx")
    over("keywords", "_least", "limits.keywords", "keywords:", "keywords_idx", low=True)
    missing("keywords_idx", "_least", "keywords line")
    return union_all(out)


def abstract_measures(paras: DataFrame) -> DataFrame:
    scope = paras.where((F.col("region") == "abstract") & (F.col("level") == 0) & (F.btrim("text") != ""))
    return scope.groupBy("doc_id").agg(
        F.sum(T.word_count("text")).cast("bigint").alias("words"), F.count("*").alias("paragraphs"),
        F.min("para_idx").alias("para_idx"))


@rule("limits.abstract-words", "abstract.format")
def abstract_limits(paras: DataFrame, profile: dict) -> DataFrame:
    m = with_settings(abstract_measures(paras), profile, _most="abstract.max_words", _form="abstract.format")
    return union_all([
        document_findings(m.where("_most > 0 AND words > _most"), "limits.abstract-words", F.concat_ws(
            " ", F.lit("abstract has"), F.col("words"), F.lit("words")), para_idx=F.col("para_idx")),
        document_findings(m.where("_form = 'single_paragraph' AND paragraphs > 1"), "abstract.format", F.concat_ws(
            " ", F.lit("abstract has"), F.col("paragraphs"), F.lit("paragraphs")), para_idx=F.col("para_idx"))])


@rule("limits.word-count", "limits.word-count-stated")
def count_limits(paras: DataFrame, profile: dict) -> DataFrame:
    counts, stated = word_counts(paras), stated_counts(paras)
    asked = F.lower("_severity")
    severity = F.when(asked.isin("error", "warn", "info"), asked).when(asked.isin("hard", "fail"), "error").otherwise("warn")
    over = with_settings(counts, profile, _most="word_limit.max", _severity="word_limit.severity").where("_most > 0 AND house > _most")
    unknown = with_settings(section_bounds(paras).where(F.col("missing").isNotNull()), profile, _most="word_limit.max").where("_most > 0")
    out = [document_findings(over, "limits.word-count", F.concat_ws(" ", F.col("house"), F.lit("words; the limit is"), F.col("_most")), severity=severity),
           document_findings(unknown, "limits.missing", F.concat(F.lit("word count not computed: no "), F.col("missing")))]
    wrong = stated.join(counts, "doc_id").where(~F.col("stated").eqNullSafe(F.col("house")))
    out.append(document_findings(wrong, "limits.word-count-stated", F.concat_ws(
        " ", F.lit("stated"), F.coalesce(F.col("stated").cast("string"), F.lit("no number")), F.lit("counted"),
        F.col("house")), para_idx=F.col("para_idx")))
    return union_all(out)


@rule("limits.references")
def reference_limit(paras: DataFrame, profile: dict) -> DataFrame:
    bib = paras.where(F.col("is_bib") & (F.btrim("text") != "")).groupBy("doc_id").agg(
        F.count("*").alias("n"), F.min("para_idx").alias("para_idx"))
    bib = with_settings(bib, profile, _top="references.recommended_max").where("_top > 0 AND n > _top")
    return document_findings(bib, "limits.references", F.concat_ws(" ", F.col("n"), F.lit("references; at most"), F.col("_top"), F.lit("recommended")),
                             para_idx=F.col("para_idx"))


# -- declarations ------------------------------------------------------------------------------

# Label wording of each declaration.
DECLARATIONS = {
    "declaration_of_interest": r"(declarations? of (competing )?interests?|conflicts? of interests?|"
                               r"competing interests?|disclosures?|duality of interest)",
    "funding": r"(funding( sources?| information| statement)?|financial support|sources? of funding|grant support)",
    "author_contributions": r"((authors?['’]?|author) contributions?( statement)?|contributions|contributorship|"
                            r"credit( author)? statement)",
    "acknowledgements": r"(acknowledge?ments?)",
    "data_availability": r"(data availability( statement)?|availability of data( and materials?)?|"
                         r"data sharing( statement)?)",
    "ai_disclosure": r"((declaration of |use of |statement on )?(the )?(use of )?(generative )?"
                     r"(ai|artificial intelligence)( tools?)?( use| disclosure| statement)?"
                     r"( in (scientific )?writing)?)",
    "ethics": r"(ethics( approval| statement)?|ethical approval)",
    "consent": r"((patient )?consent( for publication| statement)?)",
    "preprint": r"(preprint( disclosure)?)",
}
ANY_DECLARATION = "(?i)^(" + "|".join(DECLARATIONS.values()) + ")$"


def _bare_label(text: Column) -> Column:
    unnumbered = F.regexp_replace(F.btrim(text), r"^\d+(\.\d+)*\.?\s*", "")
    return F.btrim(F.regexp_replace(F.btrim(F.regexp_replace(unnumbered, r"[:. ]+$", "")), r"^\*+", ""))


def is_declaration() -> Column:
    """Back-matter declarations, by section heading or by a leading label."""
    head = F.btrim("text")
    return _bare_label(F.col("section")).rlike(ANY_DECLARATION) | (
        head.contains(":")
        & _bare_label(F.split_part(head, F.lit(":"), F.lit(1))).rlike(ANY_DECLARATION))


def declaration_positions(paras: DataFrame, keys: list[str]) -> DataFrame:
    """First paragraph of each named declaration; one pass, whatever the number of keys."""
    import re
    text = F.btrim("text")
    heading = F.btrim(F.regexp_replace(F.regexp_replace(text, r"^\d+(\.\d+)*\.?\s*", ""), r"[:. ]+$", ""))
    inline = F.btrim(F.regexp_replace(F.btrim(F.split_part(text, F.lit(":"), F.lit(1))), r"^\*+", ""))
    label = F.when(F.col("level") > 0, heading).when(text.contains(":"), inline)
    scope = paras.where(F.col("region").isin("body", "appendix", "front") & (text != "") & ~F.col("in_table")
                        & ~F.col("title_page_only"))
    hits = [F.when(F.col("label").rlike("(?i)^" + DECLARATIONS.get(k, re.escape(k.replace("_", " "))) + "$"), F.lit(k))
            for k in keys]
    rows = scope.select("doc_id", "para_idx", label.alias("label")).select(
        "doc_id", "para_idx", F.explode(F.array_compact(F.array(*hits))).alias("declaration"))
    return rows.groupBy("doc_id", "declaration").agg(F.min("para_idx").alias("para_idx"))


@rule("declarations.missing", "declarations.order")
def declarations(paras: DataFrame, profile: dict) -> DataFrame:
    if isinstance(profile, DocumentProfiles):
        asked = profile.frame.select(F.explode("profile.declarations.order").alias("k")).distinct()
        keys = sorted(r["k"] for r in asked.collect() if r["k"])      # names that profiles use, not documents
    else:
        keys = list((profile.get("declarations") or {}).get("order") or [])
    if not keys:
        return document_findings(paras.where("false"), "declarations.missing", "")
    docs = paras.where(~F.col("title_page_only")).groupBy("doc_id").agg(F.lit(1).alias("_one"))
    docs = with_settings(docs, profile, _order="declarations.order").where(F.size("_order") > 0)
    found = declaration_positions(paras, keys).join(docs.select("doc_id", "_order"), "doc_id").where(F.array_contains("_order", F.col("declaration"))).drop("_order")
    wanted = F.col("_order")
    per = docs.join(found.groupBy("doc_id").agg(F.collect_list(F.struct("para_idx", "declaration")).alias("f")),
                    "doc_id", "left")
    have = F.coalesce(F.transform("f", lambda x: x["declaration"]), F.array().cast("array<string>"))
    missing = per.select("doc_id", F.explode(F.array_except(wanted, have)).alias("declaration"))
    present = F.filter(wanted, lambda k: F.array_contains(have, k))
    actual = F.transform(F.sort_array("f"), lambda x: x["declaration"])
    order = per.where(F.col("f").isNotNull() & (actual != present))
    first = F.get(F.filter(F.zip_with(present, actual, lambda p, a: F.when(p != a, a)), lambda a: a.isNotNull()), 0)
    where = F.get(F.filter("f", lambda x: x["declaration"] == first), 0)["para_idx"]
    return union_all([
        document_findings(missing, "declarations.missing", F.concat(F.lit("not found: "), F.col("declaration"))),
        document_findings(order, "declarations.order", F.concat(
            F.lit("declarations appear as "), F.array_join(actual, ", ")), para_idx=where)])


# -- title-page integrity ----------------------------------------------------------------------

def reference_integrity(authors: DataFrame, affiliations: DataFrame, contacts: DataFrame) -> DataFrame:
    """Author-affiliation problems per document.

    ``authors(doc_id, name, keys, corresponding)``, ``affiliations(doc_id, key)``,
    ``contacts(doc_id, name)``.
    """
    used = authors.select("doc_id", "name", F.explode("keys").alias("key"))
    shape = lambda df, kind, item: df.select("doc_id", F.lit(kind).alias("problem"), item.cast("string").alias("item"))
    undefined = used.join(affiliations, ["doc_id", "key"], "left_anti")
    unused = affiliations.distinct().join(used, ["doc_id", "key"], "left_anti")
    twice = affiliations.groupBy("doc_id", "key").count().where("count > 1")
    flagged = authors.where("corresponding").select("doc_id", "name")
    unflagged = contacts.join(flagged, ["doc_id", "name"], "left_anti")
    return (shape(undefined, "undefined affiliation", F.concat_ws(":", "name", "key"))
            .unionByName(shape(unused, "unused affiliation", F.col("key")))
            .unionByName(shape(twice, "affiliation defined twice", F.col("key")))
            .unionByName(shape(unflagged, "contact is not a corresponding author", F.col("name"))))

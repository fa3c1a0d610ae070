"""Spelling variety, headings, formatting, abbreviations, nomenclature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions import text as T
from proofline.functions.spelling_table import US_FORM_VARIETIES, spelling_rows
from proofline.operators.findings import document_findings, finding, rule, spread, union_all
from proofline.operators.prose import trie_pattern
from proofline.operators.settings import with_settings
from proofline.operators.typography import flagged_at, placeholder_spans
from proofline.session import materialise

# -- spelling ----------------------------------------------------------------------------------

VARIETY_NAMES = {"en-us": "en-US", "en-gb": "en-GB", "en-ca": "en-CA", "us": "en-US", "uk": "en-GB", "gb": "en-GB",
                 "ca": "en-CA"}


def spelling_hits(paras: DataFrame) -> DataFrame:
    """Every word of the spelling table in running text, with category and form.

    The words are one trie, so only known words leave the text; the table itself (about 2,600 fixed rows) is then broadcast. A hit
    takes its snippet along, not its paragraph.
    """
    spark = paras.sparkSession
    table = spelling_rows()
    pattern = rf"(?<![A-Za-z])(?i:{trie_pattern(sorted({row[0] for row in table}), False)})(?![A-Za-z])"
    scope = paras.where(~F.col("region").isin("title", "references") & ~F.col("is_bib"))
    known = T.spans("masked", pattern, keep=lambda w: ~((w == F.upper(w)) & (F.length(w) > 1)))
    rows = scope.select("doc_id", "para_idx", "section", "text", "masked", "level", F.explode(known).alias("s"))
    before = F.regexp_replace(F.substr("masked", F.lit(1), F.col("s.start")), r"(?U)\s+$", "")
    proper = (
        F.col("s.match").rlike("^[A-Z]") & (before != "") & ~before.rlike("[.!?:;\u0000]$") & (F.col("level") == 0))
    rows = rows.where(~proper).select(
        "doc_id", "para_idx", "section", T.snippet("text", F.col("s.start"), F.col("s.end")).alias("snippet"),
        F.col("s.start").alias("start"), F.col("s.end").alias("end"),
        F.col("s.match").alias("word"), F.lower("s.match").alias("key"))
    known_words = spark.createDataFrame(list(table), "key string, category string, form string, other string")
    return rows.join(F.broadcast(known_words), "key").drop("key")


def _deviates(variety: str) -> Column:
    us_categories = [c for c, varieties in US_FORM_VARIETIES.items() if variety in varieties]
    return (F.col("form") == "us") != F.col("category").isin(us_categories)


def spelling_varieties(paras: DataFrame, profile: dict) -> tuple[DataFrame, DataFrame]:
    """(hits with their deviation flag, per-document summary).

    The variety is the chosen one, else the candidate with the fewest deviations, earlier candidate
    first. Counts are window aggregates per document, so hits are not joined to themselves.
    """
    chosen = VARIETY_NAMES.get(str((profile.get("language") or {}).get("spelling") or "").replace("_", "-").lower())
    listed = (profile.get("formatting") or {}).get("language") or []
    candidates = [v for v in (VARIETY_NAMES.get(str(x).replace("_", "-").lower()) for x in listed) if v]
    candidates = candidates or ["en-US", "en-GB"]
    options = [chosen] if chosen else candidates
    doc = Window.partitionBy("doc_id")
    hits = spelling_hits(paras)
    scores = F.array(*[
        F.struct(F.count_if(_deviates(v)).over(doc).alias("n"), F.lit(i).alias("i"), F.lit(v).alias("variety"))
        for i, v in enumerate(options)])
    hits = hits.withColumn("best", F.array_min(scores))
    wrong = F.lit(False)
    for variety in options:
        wrong = wrong | ((F.col("best.variety") == variety) & _deviates(variety))
    hits = hits.withColumn("variety", F.col("best.variety")).withColumn("deviates", wrong).drop("best")
    return hits, spelling_summary(hits)


def spelling_summary(hits: DataFrame) -> DataFrame:
    """Forms and deviations of each document."""
    return hits.groupBy("doc_id", "variety").agg(
        F.count_if(F.col("form") == "us").alias("us_forms"), F.count_if(F.col("form") == "uk").alias("uk_forms"),
        F.count_if("deviates").alias("deviations"))


@rule("spelling.variety", "spelling.mixed")
def spelling(paras: DataFrame, profile: dict) -> DataFrame:
    hits, summary = spelling_varieties(paras, profile)
    hits = materialise(hits, "spelling")
    summary = spelling_summary(hits)
    notes = document_findings(summary, "spelling.variety", F.concat_ws(
        " ", F.col("variety"), F.lit("spelling:"), F.col("us_forms"), F.lit("US-form and"), F.col("uk_forms"),
        F.lit("UK-form words,"), F.col("deviations"), F.lit("deviation(s)")))
    cased = F.when(F.col("word").rlike("^[A-Z]"), F.initcap("other")).otherwise(F.col("other"))
    mixed = document_findings(
        hits.where("deviates"), "spelling.mixed",
        F.concat(F.upper("form"), F.lit(" spelling '"), F.col("word"), F.lit("' in an "), F.col("variety"),
                 F.lit(" text")),
        F.concat(F.lit("write '"), cased, F.lit("'")), para_idx=F.col("para_idx"), start=F.col("start"), end=F.col("end"),
        section=F.col("section"), snippet=F.col("snippet"))
    return union_all([notes, mixed])


# -- headings ----------------------------------------------------------------------------------

HEADING_NUMBER = r"(?U)^\s*(\d+(?:\.\d+)*)\.?(?=\s|$)"


@rule("heading.empty", "heading.trailing", "heading.indent")
def heading_form(paras: DataFrame, profile: dict) -> DataFrame:
    """Empty headings, trailing separators and direct indents (``first_line_indent`` when given)."""
    heads = paras.where(F.col("level") > 0)
    indent = F.col("first_line_indent") if "first_line_indent" in paras.columns else F.lit(0)
    text = F.replace("text", F.lit(T.OBJECT_MARK), F.lit(""))
    empty = F.translate(text, " \t\n\f     ", "") == ""
    body = F.regexp_replace(text, "[\f\n]+$", "")
    size = F.length(body)
    return spread(heads, F.array_compact(F.array(
        F.when(empty, finding("heading.empty", 0, 0, "heading without text", "delete it or give it a text")),
        F.when(~empty & body.rlike("[: \t   ]$"), finding(
            "heading.trailing", F.greatest(F.lit(0), size - 60), size, "heading ends in a colon or a space",
            "remove the trailing character")),
        F.when(~empty & (indent > 0), finding(
            "heading.indent", 0, F.least(size, F.lit(60)), "heading with a first-line indent", "remove the indent")),
    )))


def heading_numbers(paras: DataFrame) -> DataFrame:
    """Typed heading numbers that skip, repeat or sit under another parent.

    The expected number depends on all earlier headings of the document, so the (few) numbered
    headings are folded in order: ``last`` keeps one counter per open parent.
    """
    heads = paras.where((F.col("level") > 0) & F.col("text").rlike(HEADING_NUMBER))
    numbers = F.transform(F.split(F.regexp_extract("text", HEADING_NUMBER, 1), r"\."), lambda n: n.cast("int"))
    rows = heads.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(
        F.col("para_idx").alias("para_idx"), numbers.alias("numbers")))).alias("heads"))
    state = ("struct<last:array<struct<parent:array<int>,n:int>>,current:array<int>,"
             "out:array<struct<para_idx:int,number:string,problem:string,expected:string>>>")

    def step(acc, head):
        nums = head["numbers"]
        parent = F.slice(nums, F.lit(1), F.size(nums) - 1)
        here = F.element_at(nums, -1)
        known = F.get(F.filter(acc["last"], lambda e: e["parent"] == parent), 0)["n"]
        expected = F.coalesce(known, F.lit(0)) + 1
        dotted = F.concat_ws(".", nums.cast("array<string>"))
        entry = lambda problem, want: F.struct(
            head["para_idx"].alias("para_idx"), dotted.alias("number"), problem.alias("problem"),
            want.alias("expected"))
        wrong_parent = F.when(
            (F.size(parent) > 0) & (F.slice(acc["current"], F.lit(1), F.size(parent)) != parent),
            entry(F.lit("wrong parent"), F.concat_ws(".", acc["current"].cast("array<string>"))))
        off = F.when(here != expected, entry(
            F.when(here < expected, "repeats").otherwise("skips"),
            F.concat_ws(".", F.concat(parent, F.array(expected)).cast("array<string>"))))
        kept = F.filter(acc["last"], lambda e: (e["parent"] != parent) & (
            F.slice(e["parent"], F.lit(1), F.size(nums)) != nums))
        last = F.concat(kept, F.array(F.struct(parent.alias("parent"), here.alias("n"))))
        return F.struct(last.alias("last"), nums.alias("current"), F.concat(
            acc["out"], F.array_compact(F.array(wrong_parent, off))).alias("out"))

    start = F.from_json(F.lit('{"last":[],"current":[],"out":[]}'), state)
    found = F.aggregate("heads", start, step, lambda acc: acc["out"])
    return rows.select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.*")


@rule("heading.numbering")
def heading_numbering(paras: DataFrame, profile: dict) -> DataFrame:
    return document_findings(
        heading_numbers(paras), "heading.numbering",
        F.concat_ws(" ", F.col("number"), F.col("problem")),
        F.concat(F.lit("expected "), F.col("expected")), para_idx=F.col("para_idx"), start=0, end=F.length("number"))


# -- formatting --------------------------------------------------------------------------------

@rule("format.highlight")
def highlighting(paras: DataFrame, profile: dict) -> DataFrame:
    marked = F.filter("spans", lambda s: F.array_contains(s["flags"], "highlight"))
    chars = F.aggregate(marked, F.lit(0), lambda acc, s: acc + s["end"] - s["start"])
    first = F.get(marked, 0)
    return spread(paras.where(F.size(marked) > 0), F.array(finding(
        "format.highlight", first["start"], first["end"], F.concat(F.lit("highlighted characters: "), chars),
        "remove the highlighting")))


def language_shares(paras: DataFrame, default_lang: str | None = None) -> DataFrame:
    """Characters and paragraphs per proofing language of a document, with the dominant one and first place."""
    rows = paras.select("doc_id", "para_idx", "text", F.explode("spans").alias("s")).where(
        F.btrim(F.substr("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))) != "")
    lang = F.coalesce(F.when(F.col("s.lang") != "", F.col("s.lang")), F.lit(default_lang).cast("string"))
    place = F.struct(F.col("para_idx"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    rows = rows.select("doc_id", lang.alias("lang"), (F.col("s.end") - F.col("s.start")).alias("size"),
                       place.alias("place")).where(F.col("lang").isNotNull())
    per = rows.groupBy("doc_id", "lang").agg(
        F.sum("size").cast("bigint").alias("chars"), F.min("place").alias("first"),
        F.count_distinct("place.para_idx").alias("paragraphs"))
    doc = Window.partitionBy("doc_id").orderBy(F.desc("chars"), "first").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    return per.withColumn("dominant", F.first("lang").over(doc)).withColumn("dominant_chars", F.first("chars").over(doc))


@rule("format.proofing-language")
def proofing_languages(paras: DataFrame, profile: dict) -> DataFrame:
    shares = language_shares(paras, (profile.get("formatting") or {}).get("default_lang"))
    return document_findings(
        shares.where(F.col("lang") != F.col("dominant")), "format.proofing-language",
        F.concat_ws(" ", F.col("lang"), F.lit("on"), F.col("chars"), F.lit("characters in"), F.col("paragraphs"),
                    F.lit("paragraph(s); dominant is"), F.col("dominant")),
        F.concat(F.lit("set the language to "), F.col("dominant")), para_idx=F.col("first.para_idx"),
        start=F.col("first.start"), end=F.col("first.end"))


@rule("format.proofing-variety")
def proofing_variety(paras: DataFrame, profile: dict) -> DataFrame:
    """Dominant English proofing language that differs from the spelling variety."""
    shares = language_shares(paras, (profile.get("formatting") or {}).get("default_lang"))
    dominant = shares.where(F.col("lang") == F.col("dominant")).select("doc_id", "dominant")
    _, summary = spelling_varieties(paras, profile)
    clash = dominant.join(summary.select("doc_id", "variety"), "doc_id").where(
        F.lower("dominant").startswith("en-") & (F.lower("dominant") != F.lower("variety")))
    return document_findings(clash, "format.proofing-variety", F.concat(
        F.lit("proofing language "), F.col("dominant"), F.lit(" but spelling "), F.col("variety")))


LINE_TARGETS = {"double": 480, "1.5": 360, "single": 240}   # fixed values: twentieths of a point


def reference_spacing(paras: DataFrame, styles: DataFrame, wanted: str, default_line: int = 240) -> DataFrame:
    """First bibliography paragraph per document whose inherited line spacing is off the wanted one.

    ``paras`` carries ``line`` (direct spacing or NULL) and ``style``; ``styles(doc_id, style,
    based_on, line)`` is the small style table of each document. The chain is followed at most as
    many steps as there are styles, which also ends a cycle.
    """
    target = LINE_TARGETS[wanted]
    sheet = styles.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(
        "style", F.struct("based_on", F.col("line").cast("int").alias("line"))))).alias("sheet"))
    bib = paras.where(F.col("is_bib") & (F.btrim("text") != "")).join(sheet, "doc_id", "left")

    def step(acc, _):
        entry = F.try_element_at("sheet", acc["style"])
        go = acc["line"].isNull() & acc["style"].isNotNull()
        return F.struct(
            F.when(go, entry["line"]).otherwise(acc["line"]).alias("line"),
            F.when(go, entry["based_on"]).otherwise(acc["style"]).alias("style"))

    start = F.struct(F.col("line").cast("int").alias("line"), F.col("style").cast("string").alias("style"))
    steps = F.sequence(F.lit(1), F.coalesce(F.size("sheet"), F.lit(0)) + 1)
    line = F.coalesce(F.aggregate(steps, start, step, lambda acc: acc["line"]), F.lit(default_line))
    off = bib.select("doc_id", "para_idx", line.alias("line")).where(F.abs(F.col("line") - target) > 12)
    return off.groupBy("doc_id").agg(F.min(F.struct("para_idx", "line")).alias("m")).select("doc_id", "m.*")


@rule("format.reference-spacing")
def reference_spacing_rule(paras: DataFrame, profile: dict) -> DataFrame:
    """The profile's ``styles`` is the style table, a frame (doc_id, style, based_on, line); ``paras`` may carry a ``line`` of its own.

    Without either, no spacing is known and nothing is reported.
    """
    wanted = (profile.get("formatting") or {}).get("references_line_spacing")
    styles = profile.get("styles")
    rows = paras if "line" in paras.columns else paras.withColumn("line", F.lit(None).cast("int"))
    if styles is None:
        styles = rows.select("doc_id", "style", F.lit(None).cast("string").alias("based_on"), F.lit(None).cast("int").alias("line")).where("false")
    if wanted not in LINE_TARGETS or ("line" not in paras.columns and profile.get("styles") is None):
        off = rows.select("doc_id", "para_idx", "line").where("false")
    else:
        off = reference_spacing(rows, styles, wanted)
    return document_findings(off, "format.reference-spacing", F.concat_ws(" ", F.lit("reference list line spacing is"), F.col("line"), F.lit(f"; wanted {wanted}")),
                             f"set the reference list to {wanted} spacing", para_idx=F.col("para_idx"))


# -- abbreviations -----------------------------------------------------------------------------

# Token and definition forms, exempt tokens, address codes.
TOKEN = r"[A-Z][A-Za-z0-9]*(?:-[A-Za-z0-9]+)*"
CAPITALS = r"(?=[A-Z0-9\-]+s?(?![A-Za-z0-9\-]))"     # what a token needs to hold an abbreviation; passes over capitalised words
ABBREVIATION = rf"(?U){CAPITALS}(?=[A-Z])(?<![\w\-‐.])({TOKEN})(?![\w\-‐])"
DEFINITION_PAREN = rf"(?U)(\(\s*)({TOKEN})(\s*(?:[;,][^()]*)?\))"
DEFINITION_REVERSE = rf"(?U)\b({TOKEN})(\s+\((?:i\.e\.,?\s*)?[a-z][^()]{{3,}}\))"
DEFINITION_LIST = rf"(?U)(^|[.;]\s+)({TOKEN})(,\s+[a-z])"
ROMAN = r"^X{0,2}(IX|IV|V?I{0,3})$"
UNIVERSAL = ("DNA RNA PCR qPCR SD SEM CI ANOVA BMI cDNA USA UK US EU ATP ADP UV ID ISO SI AI ORCID DOI PMID PMCID URL "
             "PDF SPSS SAS CO2 H2O").split()
REGION_CODES = ("AL AK AZ AR CA CO CT DE FL GA HI IA ID IL IN KS KY LA MA MD ME MI MN MO MS MT NC ND NE NH NJ NM NV "
                "NY OH OK OR PA RI SC SD TN TX UT VA VT WA WI WV WY DC AB BC MB NB NL NS NT NU ON PE QC SK YT").split()
CORE_SPANS = "array<struct<core:string,start:int,end:int>>"


def abbreviation_core(token: Column) -> Column:
    """The abbreviation inside a token (plural s cut), or NULL when the token is not one."""
    core = F.regexp_replace(token, "(?<=.[A-Z])s$", "")
    alnum = F.regexp_replace(core, "[^A-Za-z0-9]", "")
    good = (F.length(alnum).between(2, 6) & (F.regexp_count(alnum, F.lit("[A-Za-z]")) >= 2)
            & ~alnum.rlike("[a-z]") & ~core.rlike(ROMAN))
    return F.when(good, core)


def _all_flagged(start: Column, end: Column, flag: str) -> Column:
    """Every visible character of a range lies in spans with the flag (spans do not overlap)."""
    inside = F.aggregate(
        F.filter("spans", lambda s: F.array_contains(s["flags"], flag)), F.lit(0),
        lambda acc, s: acc + F.greatest(F.lit(0), F.least(s["end"], end) - F.greatest(s["start"], start)))
    return inside >= end - start


def abbreviation_tokens() -> Column:
    """Roman-type abbreviation candidates of one paragraph."""
    found = T.spans("masked", ABBREVIATION, 1, keep=lambda m: abbreviation_core(m).isNotNull())
    shaped = F.transform(found, lambda s: F.struct(
        abbreviation_core(s["match"]).alias("core"), s["start"].alias("start"), s["end"].alias("end")))
    return F.filter(shaped, lambda a: ~_all_flagged(a["start"], a["end"], "italic") & ~(
        a["core"].isin(REGION_CODES) & F.substr("masked", F.lit(1), a["start"]).endswith(", ")))


def abbreviation_definitions(legends: Column) -> Column:
    """Definitions of one paragraph: 'long form (ABBR)', 'ABBR (long form)', and legend lists."""
    body = F.col("masked")

    def shaped(spans: Column, form: int, token: int) -> Column:
        offset = lambda s: s["start"] + (F.length(F.get(s["groups"], 0)) if token else F.lit(0))
        return F.filter(F.transform(spans, lambda s: F.struct(
            abbreviation_core(F.get(s["groups"], token)).alias("core"), F.lit(form).alias("form"),
            offset(s).alias("pos"), s["start"].alias("at"))), lambda d: d["core"].isNotNull())

    before = lambda d: F.regexp_replace(F.substr(body, F.lit(1), d["at"]), r"(?U)\s+$", "")
    paren = F.filter(shaped(T.spans(body, DEFINITION_PAREN, 3, hints=("(",)), 0, 1), lambda d: (
        before(d).rlike(r"\p{L}$") & F.right(before(d), F.lit(40)).rlike("[A-Za-z]{2,}")))
    reverse = shaped(T.spans(body, DEFINITION_REVERSE, 2, hints=("(",)), 1, 0)
    listed = F.when(legends, shaped(T.spans(body, DEFINITION_LIST, 3), 2, 1)).otherwise(
        F.from_json(F.lit("[]"), "array<struct<core:string,form:int,pos:int,at:int>>"))
    return F.concat(paren, reverse, listed)


def abbreviation_uses(paras: DataFrame, profile: dict) -> DataFrame:
    """Uses and definitions of abbreviations in the prose, tagged, one row each. No shuffle."""
    from proofline.operators.limits import is_declaration
    universal = [*UNIVERSAL, *((profile.get("lint") or {}).get("universal_abbreviations") or [])]
    scope = paras.where(
        F.col("region").isin("body", "legends", "appendix") & (F.col("level") == 0) & ~F.col("is_bib")
        & ~F.col("in_table") & ~F.col("title_page_only") & (F.btrim("text") != "") & ~is_declaration())
    legend = F.col("region") != "body"
    rows = scope.select("doc_id", "para_idx", "section", "text", legend.alias("legend"),
                        abbreviation_tokens().alias("tokens"), abbreviation_definitions(legend).alias("defs"),
                        placeholder_spans("text").alias("cites"))
    uses = F.filter("tokens", lambda t: ~t["core"].isin(universal) & ~F.exists("defs", lambda d: d["pos"] == t["start"])
                    & ~F.exists("cites", lambda c: (c["start"] <= t["start"]) & (t["start"] < c["end"])))
    tagged = F.concat(
        F.transform(uses, lambda t: F.struct(t["core"].alias("core"), F.lit("use").alias("role"),
                                             F.lit(0).alias("form"), t["start"].alias("pos"))),
        F.transform("defs", lambda d: F.struct(d["core"].alias("core"), F.lit("def").alias("role"),
                                               d["form"].alias("form"), d["pos"].alias("pos"))))
    return rows.select("doc_id", "para_idx", "legend", F.explode(tagged).alias("a")).select(
        "doc_id", "para_idx", "legend", "a.*")


@rule("abbrev.undefined", "abbrev.before-definition", "abbrev.redefined", "abbrev.single-use")
def abbreviations(paras: DataFrame, profile: dict) -> DataFrame:
    """Order rules per (document, abbreviation): one aggregation, no self-join."""
    universal = [*UNIVERSAL, *((profile.get("lint") or {}).get("universal_abbreviations") or [])]
    uses = abbreviation_uses(paras, profile)
    is_use, body = F.col("role") == "use", ~F.col("legend")
    place = F.struct("para_idx", "pos")
    listed = F.struct("para_idx", "form", "pos")
    per = uses.groupBy("doc_id", "core").agg(
        F.count_if(is_use).alias("n_uses"),
        F.min(F.when(is_use, place)).alias("first_use"),
        F.min(F.when(is_use & body, place)).alias("body_use"),
        F.min(F.when(~is_use, listed)).alias("first_def"),
        F.sort_array(F.collect_list(F.when(~is_use & body, listed))).alias("body_defs"),
        F.collect_list(F.when(is_use & body, place)).alias("body_uses"),
    )
    first_def = F.struct(F.col("first_def.para_idx"), F.col("first_def.pos"))
    one, two = F.get("body_defs", 0), F.get("body_defs", 1)
    later = F.size(F.filter("body_uses", lambda u: u > F.struct(one["para_idx"], one["pos"])))
    size = F.length("core")
    entry = lambda name, at, message, extra=None: F.struct(
        F.lit(name).alias("rule"), at["para_idx"].alias("para_idx"), at["pos"].alias("start"),
        message.alias("message"))
    found = F.array_compact(F.array(
        F.when((F.col("n_uses") > 0) & F.col("first_def").isNull(), entry(
            "abbrev.undefined", F.col("first_use"),
            F.concat(F.col("core"), F.lit(" is used "), F.col("n_uses"), F.lit(" time(s) but never defined")))),
        F.when(F.col("body_use").isNotNull() & F.col("first_def").isNotNull() & (F.col("body_use") < first_def), entry(
            "abbrev.before-definition", F.col("body_use"),
            F.concat(F.col("core"), F.lit(" is used before its definition")))),
        F.when(F.size("body_defs") > 1, entry(
            "abbrev.redefined", two,
            F.concat(F.col("core"), F.lit(" is defined "), F.size("body_defs"), F.lit(" times")))),
        F.when((F.size("body_defs") > 0) & (later <= 1) & ~F.col("core").isin(universal), entry(
            "abbrev.single-use", one,
            F.concat(F.col("core"), F.lit(" is defined but used "), later, F.lit(" time(s) afterwards")))),
    ))
    rows = per.select("doc_id", "core", F.explode(found).alias("f"))
    return document_findings(rows, F.col("f.rule"), F.col("f.message"), F.col("core"), para_idx=F.col("f.para_idx"),
                             start=F.col("f.start"), end=F.col("f.start") + F.length("core"))


@rule("abstract.abbreviation", "abstract.citation")
def abstract_content(paras: DataFrame, profile: dict) -> DataFrame:
    """Abbreviations and citations in the abstract when the profile forbids them."""
    scope = paras.where((F.col("region") == "abstract") & (F.col("level") == 0) & (F.btrim("text") != ""))
    scope = with_settings(scope, profile, _forbid="abstract.forbid").where(F.size("_forbid") > 0)
    forbids = lambda *names: F.exists("_forbid", lambda x: F.lower(x).isin(*names))
    short = F.transform(abbreviation_tokens(), lambda t: finding(
        "abstract.abbreviation", t["start"], t["end"], F.concat(F.lit("abbreviation "), t["core"]), "spell it out in the abstract"))
    cited = F.filter("spans", lambda s: s["kind"] == "CITATION")
    first = F.coalesce(F.get(cited, 0)["start"], F.get(placeholder_spans("text"), 0)["start"])
    last = F.coalesce(F.get(cited, 0)["end"], F.get(placeholder_spans("text"), 0)["end"])
    citation = finding("abstract.citation", first, last, "citation in the abstract", "remove it from the abstract")
    return spread(scope, F.concat(F.filter(short, lambda _: forbids("abbreviations")),
                                  F.array_compact(F.array(F.when(forbids("citations", "references") & first.isNotNull(), citation)))))


# Words beside a symbol that make it a gene or transcript.
GENE_CUE_AFTER = (r"(?U)^[\s\-‐]*(gene|genes|mRNA|mRNAs|transcripts?|expression|knockout|knockdown|promoter|alleles?|"
                  r"locus|polymorphisms?|siRNA|shRNA|overexpression|deletion|silencing|null|deficient)\b")
GENE_CUE_BEFORE = (r"(?U)\b(expression|knockout|knockdown|overexpression|deletion|silencing|transcription|"
                   r"transcripts?) of\s+$")
GENE_SYMBOL = r"(?U)(?=[A-Z][A-Z0-9])(?<![\w\-])([A-Z][A-Z0-9]{1,9})(?![\w])"
# What a paragraph with a cue holds somewhere; the cues look at parts of a paragraph, whose ends may cut a word.
GENE_CUE = (r"(?U)(?:gene|mRNA|transcript|expression|knock(?:out|down)|promoter|allele|locus|polymorphism|s[ih]RNA|deletion|silencing|null|deficient)")


@rule("nomenclature.gene-italic")
def gene_italics(paras: DataFrame, profile: dict) -> DataFrame:
    universal = [*UNIVERSAL, *((profile.get("lint") or {}).get("universal_abbreviations") or [])]
    scope = paras.where(~F.col("region").isin("title", "references") & ~F.col("is_bib") & ~F.col("title_page_only"))
    scope = scope.where(F.col("masked").rlike(GENE_CUE))
    found = T.spans("masked", GENE_SYMBOL, 1, keep=lambda m: (
        ~m.isin(universal) & ~m.rlike(ROMAN) & (F.regexp_count(m, F.lit("[A-Z]")) >= 2)))
    cued = F.filter(found, lambda s: ~flagged_at(s["start"], "italic") & (
        F.substr("masked", s["end"] + 1, F.lit(30)).rlike(GENE_CUE_AFTER)
        | F.right(F.substr("masked", F.lit(1), s["start"]), F.lit(40)).rlike(GENE_CUE_BEFORE)))
    return spread(scope, F.transform(cued, lambda s: finding(
        "nomenclature.gene-italic", s["start"], s["end"] + 12, F.concat(s["match"], F.lit(" looks like a gene symbol")),
        "set gene symbols in italics")))

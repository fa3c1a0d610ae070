"""Text units: paragraphs, regions, sections, revision views, fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions import text as T

# Heading and label wording that decides the region of a paragraph.
ABSTRACT_HEAD = r"(?i)^\s*(abstract|summary)\b"
REFERENCES_HEAD = r"(?i)^\s*(?:\d+\.?\s*)?(references|bibliography|literature cited)\b"
LEGENDS_HEAD = (
    r"(?i)^\s*(figure legends?|legends? (to|for|of) figures|figure captions?|figures? and (their )?legends)\b"
)
TITLE_PAGE_LABEL = (
    r"(?i)^\s*(running\s+(title|head)|short\s+title|key\s?-?words?|word count|\*?\s*corresponding)\b"
)
# The label of a list of abbreviations, alone on its line.
ABBREVIATIONS_LINE = r"^(?U:\s*)(?i:abbreviations)[\s:]*(?U:\s*)\z"

EMPTY_SPANS = "array<struct<start:int,end:int,flags:array<string>,kind:string,lang:string>>"
STATE_SCHEMA = "array<struct<idx:int,region:string>>"


def paragraphs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line of a document with its position and word count. No shuffle."""
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.posexplode(F.split(F.col(text), "\n", -1)).alias("para_idx", "text"),
    ).withColumn("words", T.word_count("text"))


def _region_event(level: Column, text: Column, in_table: Column) -> Column:
    """The class of a paragraph that can change the region, else NULL."""
    body = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    first = level == 1
    # text lines, which are most of a document, are only looked at from their start
    return F.when(level == 0, F.when(in_table | text.rlike(ABBREVIATIONS_LINE), "front")).otherwise(
        F.when(first & body.rlike(ABSTRACT_HEAD), "abstract")
        .when(first & body.rlike(REFERENCES_HEAD), "references")
        .when((level > 0) & (level <= 2) & body.rlike(LEGENDS_HEAD), "legends")
        .when(first, "section")
    )


def _fold_regions(events: Column, initial: Column) -> Column:
    """(idx, region) after each event; events are few per document, so an ordered fold is cheap."""
    def step(acc, event):
        now, kind = acc["now"], event["event"]
        after = (
            F.when((kind == "abstract") & now.isin("title", "body"), "abstract")
            .when(kind == "references", "references")
            .when(kind == "legends", "legends")
            .when(kind.isin("section", "abstract") & now.isin("title", "abstract", "front"), "body")
            .when(kind.isin("section", "abstract") & (now == "references"), "appendix")
            .when((kind == "front") & (now == "abstract"), "front")
            .otherwise(now)
        )
        entry = F.struct(event["idx"].alias("idx"), after.alias("region"))
        return F.struct(after.alias("now"), F.concat(acc["out"], F.array(entry)).alias("out"))

    start = F.struct(initial.alias("now"), F.from_json(F.lit("[]"), STATE_SCHEMA).alias("out"))
    return F.aggregate(events, start, step, lambda acc: acc["out"])


def _region_at(states: Column, initial: Column, idx: Column) -> Column:
    latest = F.array_max(F.filter(states, lambda s: s["idx"] <= idx))
    return F.coalesce(latest["region"], initial)


def structured_paragraphs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Paragraphs of marked-up documents with level, style, region, section, mask and table flag.

    A document is one row, so regions are folded over its own line array before the explode:
    nothing is shuffled.
    """
    marked = lambda line: line.startswith("#")
    level_of = lambda line: F.when(marked(line), F.length(F.regexp_extract(line, r"^(#{1,6})\s+", 1))).otherwise(0)
    plain = lambda line: F.when(marked(line), F.regexp_replace(line, r"^#{1,6}\s+", "")).otherwise(line)
    marks = (T.MATCH_MARK, T.GROUP_MARK, T.MASK_CHAR)
    dirty = reduce(Column.__or__, (F.col(text).contains(m) for m in marks))
    plain_text = F.when(dirty, F.translate(F.col(text), "".join(marks), "   ")).otherwise(F.col(text))
    base = docs.select(F.col(doc_id).alias("doc_id"), F.split(plain_text, "\n", -1).alias("_lines"))
    events = F.transform(
        F.col("_lines"),
        lambda line, i: F.struct(i.alias("idx"), _region_event(
            level_of(line), plain(line), F.ltrim(line).startswith("|")).alias("event")),
    )
    titled = F.filter(
        F.transform(F.col("_lines"), lambda line, i: F.struct(i.alias("idx"), line.alias("line"))),
        lambda h: marked(h["line"]) & (level_of(h["line"]) > 0))
    headings = F.transform(titled, lambda h: F.struct(
        h["idx"].alias("idx"), level_of(h["line"]).alias("level"),
        F.regexp_replace(F.btrim(plain(h["line"])), r"(?U)\s+", " ").alias("text")))
    base = base.select(
        "*", F.filter(events, lambda e: e["event"].isNotNull()).alias("_events"), headings.alias("_heads"),
    )
    first_heading = F.get(F.col("_heads"), 0)["idx"]
    labelled = F.exists(F.col("_lines"), lambda line: line.rlike(TITLE_PAGE_LABEL))
    base = base.select(
        "doc_id", "_lines", "_heads", ((F.size("_heads") == 0) & labelled).alias("title_page_only"),
        F.when(first_heading > 0, "title").otherwise("body").alias("_initial"), "_events",
    ).withColumn("_states", _fold_regions(F.col("_events"), F.col("_initial")))
    rows = base.select(
        "doc_id", "title_page_only", "_heads", "_states", "_initial",
        F.posexplode("_lines").alias("para_idx", "_line"),
    )
    section = F.array_max(F.filter("_heads", lambda h: h["idx"] <= F.col("para_idx")))["text"]
    region = F.when(F.col("title_page_only"), "title").otherwise(
        _region_at(F.col("_states"), F.col("_initial"), F.col("para_idx")))
    rows = rows.select(
        "doc_id", "para_idx", "title_page_only", level_of(F.col("_line")).alias("level"),
        plain(F.col("_line")).alias("text"), F.ltrim("_line").startswith("|").alias("in_table"),
        region.alias("region"),
        F.when(F.col("title_page_only"), "").otherwise(F.coalesce(section, F.lit(""))).alias("section"),
    )
    return with_defaults(rows)


def with_defaults(paras: DataFrame) -> DataFrame:
    """Fill in the paragraph columns that the rules read and the input lacks."""
    have = set(paras.columns)
    extra: dict[str, Column] = {}
    if "level" not in have:
        extra["level"] = T.heading_level("style") if "style" in have else F.lit(0)
    if "in_table" not in have:
        extra["in_table"] = F.lit(False)
    if "region" not in have:
        extra["region"] = F.lit("body")
    if "section" not in have:
        extra["section"] = F.lit("")
    if "spans" not in have:
        extra["spans"] = F.from_json(F.lit("[]"), EMPTY_SPANS)
    if "title_page_only" not in have:
        extra["title_page_only"] = F.lit(False)
    out = paras.withColumns(extra) if extra else paras
    more: dict[str, Column] = {}
    if "style" not in have:
        more["style"] = F.when(F.col("level") > 0, F.concat(F.lit("Heading "), F.col("level"))).otherwise("")
    if "is_bib" not in have:
        more["is_bib"] = (F.col("region") == "references") & (F.col("level") == 0)
    if "masked" not in have:
        more["masked"] = T.mask("text")
    return out.withColumns(more) if more else out


def assign_regions(paras: DataFrame) -> DataFrame:
    """Region and section for a paragraph table (doc_id, para_idx, level, text, in_table).

    Only headings and front-matter triggers are grouped per document; the text rows meet the
    resulting short state list in one join on the document.
    """
    event = _region_event(F.col("level"), F.col("text"), F.col("in_table"))
    marks = (
        paras.select("doc_id", "para_idx", "level", event.alias("event"),
                     F.col("text").rlike(TITLE_PAGE_LABEL).alias("label"),
                     F.regexp_replace(F.btrim("text"), r"(?U)\s+", " ").alias("head"))
        .where(F.col("event").isNotNull() | (F.col("level") > 0) | F.col("label"))
    )
    states = marks.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("event").isNotNull(), F.struct(
            F.col("para_idx").alias("idx"), "event")))).alias("_events"),
        F.sort_array(F.collect_list(F.when(F.col("level") > 0, F.struct(
            F.col("para_idx").alias("idx"), F.col("head").alias("text"))))).alias("_heads"),
        F.min(F.when(F.col("level") > 0, F.col("para_idx"))).alias("_first"),
        F.bool_or("label").alias("_label"),
    ).withColumn("_initial", F.when(F.col("_first") > 0, "title").otherwise("body"))
    states = states.select(
        "doc_id", "_heads", "_initial", _fold_regions(F.col("_events"), F.col("_initial")).alias("_states"),
        (F.col("_label") & F.col("_first").isNull()).alias("title_page_only"),
    )
    initial = F.coalesce("_initial", F.lit("body"))
    only = F.coalesce("title_page_only", F.lit(False))
    section = F.array_max(F.filter("_heads", lambda h: h["idx"] <= F.col("para_idx")))["text"]
    joined = paras.drop("region", "section", "title_page_only").join(states, "doc_id", "left")
    return joined.select(
        *[c for c in paras.columns if c not in ("region", "section", "title_page_only")],
        F.when(only, "title").otherwise(_region_at(F.col("_states"), initial, F.col("para_idx"))).alias("region"),
        F.when(only, "").otherwise(F.coalesce(section, F.lit(""))).alias("section"),
        only.alias("title_page_only"),
    )


def heading_of(paras: DataFrame) -> DataFrame:
    """Nearest heading at or before each paragraph; '' before the first one."""
    order = Window.partitionBy("doc_id").orderBy("para_idx")
    head = F.last(F.when(F.col("level") > 0, F.btrim("text")), ignorenulls=True).over(order)
    return paras.withColumn("heading", F.coalesce(head, F.lit("")))


def sentence_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per sentence; line breaks end a paragraph, so sentences never cross them."""
    lines = paragraphs(docs, doc_id, text)
    return lines.select("doc_id", "para_idx", F.posexplode(T.sentences("text")).alias("sent_idx", "sentence"))


# -- tracked revisions ---------------------------------------------------------------------

def _dropped(mode: str) -> list[str]:
    if mode not in ("accept", "reject"):
        raise ValueError("mode must be 'accept' or 'reject'")
    return ["del", "moveFrom"] if mode == "accept" else ["ins", "moveTo"]


def positional_view(runs: DataFrame, mode: str) -> DataFrame:
    """Each paragraph's text in the view, by its own position, and whether its mark is removed.

    ``runs(doc_id, para_idx, run_idx, change_kind, text, mark_revision)``; a paragraph's runs are
    bounded by the document they belong to.
    """
    gone = _dropped(mode)
    mark = "del" if mode == "accept" else "ins"
    kept = F.when(~F.coalesce(F.col("change_kind"), F.lit("")).isin(gone), F.struct("run_idx", "text"))
    return runs.groupBy("doc_id", "para_idx").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(kept)), lambda r: r["text"]), "").alias("text"),
        F.coalesce(F.max(F.col("mark_revision") == mark), F.lit(False)).alias("mark_removed"),
    )


def revision_view(runs: DataFrame, mode: str) -> DataFrame:
    """Paragraphs of the accepted or rejected view; a removed mark joins a paragraph to the next one."""
    view = positional_view(runs, mode)
    order = Window.partitionBy("doc_id").orderBy("para_idx")
    starts = F.coalesce(F.lag("mark_removed").over(order), F.lit(False))
    island = F.sum(F.when(starts, 0).otherwise(1)).over(order)
    grouped = view.withColumn("view_idx", island - 1).groupBy("doc_id", "view_idx").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("para_idx", "text"))), lambda r: r["text"]),
                     "").alias("text"),
        F.max("para_idx").alias("para_idx"),
    )
    return grouped.select("doc_id", F.col("view_idx").cast("int").alias("view_idx"), "para_idx", "text")


def paragraph_fingerprints(paras: DataFrame) -> DataFrame:
    return paras.select("doc_id", "para_idx", F.sha2(F.col("text"), 256).alias("source_hash"))

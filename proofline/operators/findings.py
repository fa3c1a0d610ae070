"""The common output of every rule, and what is done with it."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.functions import text as T

SEVERITY_ORDER = ("error", "warn", "info")

# Rule ids and severities; the wording of the descriptions is ours.
SEVERITIES = {
    "stats.p-spacing": "warn", "stats.p-case": "warn", "stats.p-italic": "warn", "stats.q-spacing": "warn",
    "stats.n-spacing": "warn", "stats.pm-spacing": "warn", "typo.minus": "warn", "typo.eponym-dash": "warn",
    "typo.degree-sign": "warn", "typo.range-dash": "warn", "typo.double-space": "warn",
    "typo.space-before-punctuation": "warn", "spelling.variety": "info", "spelling.mixed": "warn",
    "citation.placeholder": "error", "citation.adjacent-groups": "warn", "heading.empty": "error",
    "heading.trailing": "warn", "heading.indent": "warn", "heading.numbering": "warn", "format.highlight": "warn",
    "format.proofing-language": "warn", "format.proofing-variety": "info", "format.reference-spacing": "warn",
    "abbrev.before-definition": "warn", "abbrev.undefined": "warn", "abbrev.redefined": "info",
    "abbrev.single-use": "info", "abstract.abbreviation": "warn", "abstract.citation": "error",
    "abstract.format": "warn", "nomenclature.gene-italic": "info", "callout.fig-abbreviation": "warn",
    "figures.order": "warn", "figures.uncited": "error", "figures.gap": "warn", "figures.missing-legend": "warn",
    "limits.title": "error", "limits.running-title": "error", "limits.keywords": "error",
    "limits.abstract-words": "error", "limits.word-count": "warn", "limits.word-count-stated": "warn",
    "limits.references": "warn", "limits.figures": "warn", "limits.missing": "info",
    "declarations.missing": "warn", "declarations.order": "warn",
}

COLUMNS = ("doc_id", "para_idx", "rule", "severity", "start", "end", "snippet", "message", "suggestion", "section")


def severity_of(rule: Column) -> Column:
    pairs = [F.lit(x) for item in SEVERITIES.items() for x in item]
    return F.element_at(F.create_map(*pairs), rule)


def finding(rule, start=None, end=None, message="", suggestion="", severity=None) -> Column:
    """One finding as a struct, before document and paragraph columns are attached."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        as_col(rule).cast("string").alias("rule"),
        (as_col(severity) if severity is not None else severity_of(as_col(rule))).cast("string").alias("severity"),
        as_col(start).cast("int").alias("start"), as_col(end).cast("int").alias("end"),
        as_col(message).cast("string").alias("message"), as_col(suggestion).cast("string").alias("suggestion"),
    )


def spread(paras: DataFrame, found: Column) -> DataFrame:
    """Explode an array of finding structs of each paragraph into finding rows. No shuffle."""
    rows = paras.select("doc_id", "para_idx", "section", "text", F.explode(found).alias("f"))
    return rows.select(
        "doc_id", "para_idx", "f.rule", "f.severity", "f.start", "f.end",
        T.snippet("text", F.col("f.start"), F.col("f.end")).alias("snippet"), "f.message", "f.suggestion", "section",
    )


def document_findings(df: DataFrame, rule, message, suggestion="", para_idx=None, start=None, end=None,
                      severity=None, section=None, snippet=None) -> DataFrame:
    """Findings about a whole document, or one located paragraph, from a frame with ``doc_id``."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select(
        "doc_id", as_col(para_idx).cast("int").alias("para_idx"),
        finding(rule, start, end, message, suggestion, severity).alias("f"), as_col("" if section is None else section).alias("section"),
        as_col("" if snippet is None else snippet).alias("snippet"),
    ).select("doc_id", "para_idx", "f.rule", "f.severity", "f.start", "f.end", "snippet", "f.message", "f.suggestion", "section")


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    frames = list(frames)
    out = frames[0].select(*COLUMNS)
    for frame in frames[1:]:
        out = out.unionByName(frame.select(*COLUMNS))
    return out


def filter_disabled(findings: DataFrame, disabled: Iterable[str]) -> DataFrame:
    """Drop findings whose rule is disabled by id or by prefix. The list is configuration, so it is a predicate."""
    drop = F.lit(False)
    for name in disabled:
        drop = drop | (F.col("rule") == name) | F.col("rule").startswith(name.rstrip(".") + ".")
    return findings.where(~drop)


def filter_disabled_by(findings: DataFrame, disabled: DataFrame) -> DataFrame:
    """The same with a small configuration table ``disabled(prefix)``, read once as a scalar list.

    Every prefix of a rule id is tested against that list inside the row: findings are not shuffled.
    """
    parts = F.split("rule", r"\.")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    names = disabled.select(F.collect_set(F.regexp_replace("prefix", r"\.+$", ""))).scalar()
    return findings.where(~F.coalesce(F.arrays_overlap(prefixes, names), F.lit(False)))


def rank_findings(findings: DataFrame) -> DataFrame:
    """Document order: paragraph (whole-document findings first), severity, rule."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY_ORDER]), F.col("severity"))
    return findings.orderBy("doc_id", F.coalesce("para_idx", F.lit(-1)), rank, "rule")


def summarise(findings: DataFrame) -> DataFrame:
    """Counts by severity and the overall status of each document."""
    count = lambda s: F.count_if(F.col("severity") == s).alias(s)
    out = findings.groupBy("doc_id").agg(*[count(s) for s in SEVERITY_ORDER])
    return out.withColumn(
        "status", F.when(F.col("error") > 0, "error").when(F.col("warn") > 0, "warn").otherwise("pass"))


Rule = Callable[[DataFrame, dict], DataFrame]
REGISTRY: dict[str, Rule] = {}


def rule(*names: str):
    """Register a rule function (paragraphs, profile) -> findings under the ids it can emit."""
    def add(fn: Rule) -> Rule:
        for name in names:
            if name not in SEVERITIES:
                raise ValueError(f"unknown rule id {name}")
            REGISTRY[name] = fn
        return fn
    return add


def register_rule(name: str, severity: str, fn: Rule) -> None:
    """Add a user's own rule to the catalogue."""
    if severity not in SEVERITY_ORDER:
        raise ValueError(f"severity must be one of {SEVERITY_ORDER}")
    SEVERITIES[name] = severity
    REGISTRY[name] = fn

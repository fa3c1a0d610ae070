"""Lint of a corpus of plotting sources: trigger patterns, guard patterns, and the level without a guard.

``files(path, lang, source)``; lang is ``python`` or ``r``. All checks of a file are one array, one
pass over the text and no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GuardedRule:
    """Level by what is found: all trigger groups, then any guard. Patterns ignore case."""
    check: str
    triggers: tuple[tuple[str, ...], ...]     # every group must match by at least one pattern
    guards: tuple[str, ...] = ()
    absent: str = "PASS"
    guarded: str = "PASS"
    unguarded: str = "WARN"
    lang: str | None = None                   # other languages pass


# Patterns and levels of the checks.
GUARDED_RULES: tuple[GuardedRule, ...] = (
    GuardedRule("FONT-FAMILY", ((r"Arial", r"Helvetica", r"Liberation Sans", r"sans-serif", r"base_family\s*=\s*['\"]sans['\"]"),),
                absent="FAIL", unguarded="PASS"),
    GuardedRule("INTERP-MONOTONIC", ((r"\bnp\.interp\s*\(",),),
                (r"interp_(?:need_dec|monotone|strict)", r"np\.diff\s*\([^)]*\)\s*[><]=?\s*0", r"np\.argsort\s*\(", r"\[\s*::\s*-1\s*\]"),
                lang="python"),
    GuardedRule("UNCERTAINTY-ENCODING",
                ((r"\bseed(?:s|_[A-Za-z0-9_]+)?\b", r"random_state", r"\b(?:cv|cross_validation|validation)_folds?\b",
                  r"\bfold_(?:id|index|score|scores|metric|metrics|mean|median)\b", r"\bn_folds?\b", r"\bn_splits\b",
                  r"\b(?:train|test|validation|data|random)_split\b"),
                 (r"\bmedian\b", r"\bmean\b", r"\baverage\b")),
                (r"\b(?:xerr|yerr)\s*=", r"\.errorbar\s*\(", r"\.fill_between\s*\(", r"geom_(?:errorbar|ribbon|linerange|pointrange)\s*\(")),
    GuardedRule("ANNOTATION-WORKAROUND",
                ((r"(?:LABEL|ANNOTATION)_Y\s*=\s*[-+]?\d+(?:\.\d+)?",
                  r"bbox\s*=\s*dict\s*\([^)]*(?:facecolor|fc)\s*=\s*['\"](?:white|#fff(?:fff)?)['\"]"),), lang="python"),
    GuardedRule("COLOR-MAP",
                ((r"(?:cmap|palette|colormap)\s*=\s*['\"](?:jet|rainbow|hsv)['\"]", r"plt\.cm\.(?:jet|rainbow|hsv)\b",
                  r"scale_(?:color|fill)_(?:gradientn|distiller)\s*\([^)]*(?:rainbow|jet|hsv)", r"\brainbow\s*\("),), unguarded="FAIL"),
    GuardedRule("DATA-SAMPLING",
                ((r"np\.random\.choice\s*\(", r"\.sample\s*\(", r"\bsample_n\s*\(", r"\bsample_frac\s*\(", r"\bslice_sample\s*\("),)),
    GuardedRule("DATA-EXCLUSION", ((r"\.dropna\s*\(", r"\bna\.omit\s*\(", r"\bcomplete\.cases\s*\(", r"drop_na\s*\("),),
                (r"n_before|n_after|before_count|after_count|excluded_count|dropped_count",)),
    GuardedRule("DEMO-DATA",
                ((r"np\.random\.(?:normal|uniform|rand|randn|poisson)\s*\(", r"(?:np\.random\.)?default_rng\s*\(",
                  r"\brng\.(?:normal|uniform|poisson|choice)\s*\(", r"\b(?:rnorm|runif|rpois)\s*\(", r"make_(?:classification|regression|blobs)\s*\("),)),
    GuardedRule("LOG-GUARD",
                ((r"\bnp\.log(?:2|10)?\s*\(", r"\blog(?:2|10)?\s*\(", r"set_[xy]scale\s*\(\s*['\"]log", r"scale_[xy]_log10\s*\("),),
                (r"clip\s*\([^)]*lower\s*=", r"pmax\s*\(", r"not\s+0\s*<[^\n]{0,80}", r"np\.any\s*\([^)]*<=\s*0",
                 r"(?:padj|pval|p_value|pvalue)[^\n]{0,50}<=\s*0", r"non.?positive", r"strictly\s+positive|pseudocount|epsilon|eps\b")),
    GuardedRule("PANEL-ALIGNMENT-GATE",
                ((r"plot_layout\s*\(", r"wrap_plots\s*\(", r"patchworkGrob\s*\(", r"[A-Za-z][A-Za-z0-9_.]*\s*\|\s*[A-Za-z][A-Za-z0-9_.]*"),),
                (r"require_patchwork_panel_alignment\s*\(", r"audit_panel_alignment\.py"), unguarded="FAIL", lang="r"),
)
BACKEND_MIX = {"python": (r"\bRscript\b", r"\brpy2\b", r"ggplot2|ComplexHeatmap|patchwork"),
               "r": (r"matplotlib|seaborn|plotly|reticulate::py_run",)}
EDITABLE = {"python": (r"(?i)svg\.fonttype['\"]?\s*[:=]\s*['\"]none['\"]", r"(?i)pdf\.fonttype['\"]?\s*[:=]\s*42\b"),
            "r": (r"(?:svglite::)?svglite\s*\(", r"(?:grDevices::)?cairo_pdf\s*\(")}
VECTOR = (r"(?i)\.svg\b|svglite\s*\(", r"(?i)\.pdf\b|cairo_pdf\s*\(|\bpdf\s*\(")
RASTER = (r"(?i)\.tiff?\b|agg_tiff\s*\(|\btiff\s*\(", r"(?i)\.png\b|agg_png\s*\(|\bpng\s*\(")
FONT_SIZES = (r"(?is)(?:font\.size|fontsize|labelsize|titlesize|legend\.fontsize)\s*['\"]?\s*[:=]\s*(\d+(?:\.\d+)?)",
              r"(?is)base_size\s*=\s*(\d+(?:\.\d+)?)", r"(?is)element_text\s*\([^)]*?size\s*=\s*(\d+(?:\.\d+)?)")
MATHTEXT = r"\$[^$\n]*[\^_](?:\{[^}]+\}|[^$\s])[^$\n]*\$"
DPI = r"(?i)(?:dpi|res)\s*[:=]\s*(\d+)"
WIDTH_MM = r"(?i)(?:fig_)?width_mm\s*[:=]\s*(\d+(?:\.\d+)?)"
FIGSIZE = r"(?i)figsize\s*=\s*\(\s*(\d+(?:\.\d+)?)"
R_WIDTH = r"(?is)(?:ggsave|agg_tiff|svglite|cairo_pdf)\s*\([^)]*?width\s*=\s*(\d+(?:\.\d+)?)[^)]*?units\s*=\s*['\"]mm['\"]"
ROTATION, ANCHOR = r"\brotation\s*=", r"\brotation_mode\s*=\s*['\"]anchor['\"]"
MIN_POINTS, SCRIPT_SCALE = 5.0, 0.7
COLUMN_WIDTHS = ((89.0, 4.0), (183.0, 6.0))


#: Of each pattern, pieces of lower-case ASCII of which every match holds at least one: a byte search for them comes first, as most text holds none.
#: A pattern that is not listed always runs.
SIGNS: dict[str, tuple[str, ...]] = {}


def _signed(patterns: tuple[str, ...], *signs: str) -> None:
    """``signs`` in the order of the patterns; those of one pattern are parted by a blank."""
    SIGNS.update({p: tuple(s.split(" ")) for p, s in zip(patterns, signs, strict=True)})


_OF = {r.check: r for r in GUARDED_RULES}
_signed(_OF["FONT-FAMILY"].triggers[0], "arial", "helvetica", "liberation", "sans-serif", "base_family")
_signed(_OF["INTERP-MONOTONIC"].triggers[0], "np.interp")
_signed(_OF["INTERP-MONOTONIC"].guards, "interp_", "np.diff", "np.argsort", "::")
_signed(_OF["UNCERTAINTY-ENCODING"].triggers[0], "seed", "random_state", "_fold", "fold_", "n_fold", "n_splits", "_split")
_signed(_OF["UNCERTAINTY-ENCODING"].triggers[1], "median", "mean", "average")
_signed(_OF["UNCERTAINTY-ENCODING"].guards, "xerr yerr", ".errorbar", ".fill_between", "geom_")
_signed(_OF["ANNOTATION-WORKAROUND"].triggers[0], "_y", "bbox")
_signed(_OF["COLOR-MAP"].triggers[0], "jet rainbow hsv", "plt.cm.", "scale_", "rainbow")
_signed(_OF["DATA-SAMPLING"].triggers[0], "np.random.choice", ".sample", "sample_n", "sample_frac", "slice_sample")
_signed(_OF["DATA-EXCLUSION"].triggers[0], ".dropna", "na.omit", "complete.cases", "drop_na")
_signed(_OF["DATA-EXCLUSION"].guards, "n_before n_after before_count after_count excluded_count dropped_count")
_signed(_OF["DEMO-DATA"].triggers[0], "np.random.", "default_rng", "rng.", "rnorm runif rpois", "make_")
_signed(_OF["LOG-GUARD"].triggers[0], "np.log", "log", "set_", "_log10")
_signed(_OF["LOG-GUARD"].guards, "clip", "pmax", "not", "np.any", "padj pval p_value", "positive", "strictly pseudocount eps")
_signed(_OF["PANEL-ALIGNMENT-GATE"].triggers[0], "plot_layout", "wrap_plots", "patchworkgrob", "|")
_signed(_OF["PANEL-ALIGNMENT-GATE"].guards, "require_patchwork_panel_alignment", "audit_panel_alignment.py")
_signed(BACKEND_MIX["python"], "rscript", "rpy2", "ggplot2 complexheatmap patchwork")
_signed(BACKEND_MIX["r"], "matplotlib seaborn plotly reticulate")
_signed(EDITABLE["python"], "svg.fonttype", "pdf.fonttype")
_signed(EDITABLE["r"], "svglite", "cairo_pdf")
_signed(VECTOR, "svg", "pdf")
_signed(RASTER, "tif", "png")
_signed(FONT_SIZES, "font.size fontsize labelsize titlesize", "base_size", "element_text")
_signed((MATHTEXT, DPI, WIDTH_MM, FIGSIZE, R_WIDTH), "$", "dpi res", "width_mm", "figsize", "units")
_signed((ROTATION, ANCHOR), "rotation", "rotation_mode")


def _maybe(pattern: str) -> Column:
    """Whether the text, of which ``_low`` is the lower-case form, holds what every match of the pattern holds."""
    maybe = F.lit(pattern not in SIGNS)
    for sign in SIGNS.get(pattern, ()):
        maybe = maybe | F.col("_low").contains(sign)
    return maybe


def _has(pattern: str, source: Column, flags: str = "") -> Column:
    return _maybe(pattern) & source.rlike(flags + pattern)


def _any(patterns, source: Column) -> Column:
    found = F.lit(False)
    for pattern in patterns:
        found = found | _has(pattern, source, "(?i)")
    return found


def guarded_level(rule: GuardedRule, source: Column, lang: Column) -> Column:
    found = F.lit(True)
    for group in rule.triggers:
        found = found & _any(group, source)
    guard = _any(rule.guards, source) if rule.guards else F.lit(False)
    level = F.when(~found, rule.absent).when(guard, rule.guarded).otherwise(rule.unguarded)
    return level if rule.lang is None else F.when(lang == rule.lang, level).otherwise("PASS")


def _numbers(patterns, source: Column) -> Column:
    def of(pattern):
        found = F.transform(F.regexp_extract_all(source, F.lit(pattern), F.lit(1)), lambda v: v.cast("double"))
        return F.when(source.isNull() | _maybe(pattern), found).otherwise(F.array().cast("array<double>"))
    return F.concat(*[of(p) for p in patterns])


def font_size_level(source: Column) -> Column:
    least = F.array_min(_numbers(FONT_SIZES, source))
    return F.when(least.isNull(), "WARN").when(least < MIN_POINTS, "FAIL").otherwise("PASS")


def glyph_floor_level(source: Column, lang: Column) -> Column:
    least = F.array_min(_numbers(FONT_SIZES, source))
    return F.when((lang != "python") | ~_has(MATHTEXT, source), "PASS").when(
        least.isNull() | (least * SCRIPT_SCALE < MIN_POINTS), "WARN").otherwise("PASS")


def dpi_level(source: Column) -> Column:
    values = _numbers((DPI,), source)
    return F.when(F.size(values) == 0, "WARN").when(F.array_min(values) < 300, "FAIL").when(
        F.array_max(values) < 600, "WARN").otherwise("PASS")


def width_level(source: Column, lang: Column) -> Column:
    other = F.when(lang == "python", F.transform(_numbers((FIGSIZE,), source), lambda v: v * 25.4)).otherwise(_numbers((R_WIDTH,), source))
    first = F.get(F.concat(_numbers((WIDTH_MM,), source), other), 0)
    near = F.lit(False)
    for width, slack in COLUMN_WIDTHS:
        near = near | (F.abs(first - width) <= slack)
    return F.when(F.coalesce(near, F.lit(False)), "PASS").otherwise("WARN")


def both_level(patterns, source: Column) -> Column:
    return F.when(_has(patterns[0], source) & _has(patterns[1], source), "PASS").otherwise("FAIL")


def code_findings(files: DataFrame, rules: tuple[GuardedRule, ...] = GUARDED_RULES, checks: tuple[str, ...] | None = None) -> DataFrame:
    """One row per file and check with its level; of all checks, or of those named."""
    source, lang = F.col("source"), F.col("lang")
    by_lang = lambda table, fn: F.when(lang == "python", fn(table["python"])).otherwise(fn(table["r"]))
    levels = [(r.check, guarded_level(r, source, lang)) for r in rules]
    turned = _maybe(ROTATION) & (F.regexp_count(source, F.lit(ROTATION)) > F.regexp_count(source, F.lit(ANCHOR)))
    levels += [
        ("FONT-SIZE", font_size_level(source)), ("FONT-GLYPH-FLOOR", glyph_floor_level(source, lang)),
        ("ROTATION-ANCHOR", F.when((lang == "python") & turned, "WARN").otherwise("PASS")),
        ("EDITABLE-TEXT", by_lang(EDITABLE, lambda p: both_level(p, source))), ("EXPORT-VECTOR", both_level(VECTOR, source)),
        ("EXPORT-RASTER", F.when(_has(RASTER[0], source), "PASS").when(_has(RASTER[1], source), "WARN").otherwise("FAIL")),
        ("RASTER-DPI", dpi_level(source)), ("FINAL-WIDTH", width_level(source, lang)),
        ("BACKEND-EXCLUSIVE", by_lang(BACKEND_MIX, lambda p: F.when(_any(p, source), "WARN").otherwise("PASS"))),
    ]
    rows = F.array(*[F.struct(F.lit(check).alias("check"), level.alias("level")) for check, level in levels if checks is None or check in checks])
    return files.withColumn("_low", F.lower("source")).select("path", "lang", F.inline(rows))


def code_rollup(findings: DataFrame, strict: bool = False) -> DataFrame:
    """Counts by level per file and whether it is ready."""
    n = lambda level: F.count_if(F.col("level") == level).alias(level.lower())
    per = findings.groupBy("path").agg(n("PASS"), n("WARN"), n("FAIL"))
    return per.withColumn("ready", (F.col("fail") == 0) & ((F.col("warn") == 0) if strict else F.lit(True)))

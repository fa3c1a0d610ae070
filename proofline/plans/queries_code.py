"""Named queries: source-code lint. Each document carries a code snippet chosen by its id."""

from __future__ import annotations

from proofline.operators import code as K
from proofline.plans.catalog import query, quoted, table

SNIPPETS = (
    "plt.rcParams['font.size'] = 7; family = 'Arial'; fig.savefig('a.svg'); fig.savefig('a.pdf'); fig.savefig('a.tiff', dpi=600)",
    "ax.set_title('x', fontsize=4.5); y = np.interp(t, xp, fp); fig = plt.figure(figsize=(3.5, 2)); plt.savefig('b.png', dpi=150)",
    "np.diff(xp) > 0; y = np.interp(t, xp, fp); fontsize=6; ax.set_xlabel('$x^{2}$'); cmap='jet'; seeds = [1]; m = mean(v)",
    "seed_list = 3; avg = np.median(v); ax.errorbar(x, y, yerr=e); ax.text(0, 0, 's', rotation=45); LABEL_Y = 3.5; fig_width_mm = 183",
    "df = df.dropna(); n_before = 3; x = np.log10(v); eps = 1; d = df.sample(10); 'pdf.fonttype': 42, 'svg.fonttype': 'none'; rotation=90, rotation_mode='anchor'",
    "ggplot(d) + theme(base_size = 8, base_family = 'sans'); svglite('a.svg'); cairo_pdf('a.pdf'); p1 | p2; ggsave('a.tiff', width = 89, units = 'mm', res = 300)",
    "x <- rnorm(10); y <- log2(x); wrap_plots(a); require_patchwork_panel_alignment(a); na.omit(d); import matplotlib; rainbow(7); fontsize=10; 'Rscript'",
)
_CASES = " ".join(f"WHEN {i} THEN {quoted(s)}" for i, s in enumerate(SNIPPETS))
LANG = "CASE WHEN doc_id % 7 IN (5, 6) OR doc_id % 11 = 0 THEN 'r' ELSE 'python' END"
FILES_SQL = f"SELECT doc_id AS path, {LANG} AS lang, text || chr(10) || CASE doc_id % 7 {_CASES} END || chr(10) || CASE (doc_id + 3) % 7 {_CASES} END AS source FROM documents"


def files(spark, sf):
    cases = " ".join(f'WHEN {i} THEN r"{s}"' for i, s in enumerate(SNIPPETS))
    return table(spark, sf, "documents").selectExpr(
        "doc_id AS path", f"{LANG} AS lang",
        f"concat(text, chr(10), CASE doc_id % 7 {cases} END, chr(10), CASE (doc_id + 3) % 7 {cases} END) AS source")


def _any(patterns):
    return "regexp_matches(source, " + quoted("(?i)" + "|".join(f"(?:{p})" for p in patterns)) + ")"


def _guarded_sql(check):
    r = next(x for x in K.GUARDED_RULES if x.check == check)
    found = " AND ".join(_any(g) for g in r.triggers)
    guard = _any(r.guards) if r.guards else "false"
    level = f"CASE WHEN NOT ({found}) THEN '{r.absent}' WHEN {guard} THEN '{r.guarded}' ELSE '{r.unguarded}' END"
    return level if r.lang is None else f"CASE WHEN lang = '{r.lang}' THEN {level} ELSE 'PASS' END"


def _numbers(patterns):
    lists = [f"regexp_extract_all(source, {quoted(p)}, 1)" for p in patterns]
    out = lists[0]
    for item in lists[1:]:
        out = f"list_concat({out}, {item})"
    return f"list_transform({out}, lambda v: CAST(v AS DOUBLE))"


_SIZES = f"list_min({_numbers(K.FONT_SIZES)})"
_FIRST = f"list_concat({_numbers((K.WIDTH_MM,))}, CASE WHEN lang = 'python' THEN list_transform({_numbers((K.FIGSIZE,))}, lambda v: v * 25.4) ELSE {_numbers((K.R_WIDTH,))} END)[1]"
_M = lambda p: f"regexp_matches(source, {quoted(p)})"
_BOTH = lambda p: f"CASE WHEN {_M(p[0])} AND {_M(p[1])} THEN 'PASS' ELSE 'FAIL' END"
LEVELS_SQL = {r.check: _guarded_sql(r.check) for r in K.GUARDED_RULES} | {
    "FONT-SIZE": f"CASE WHEN {_SIZES} IS NULL THEN 'WARN' WHEN {_SIZES} < 5 THEN 'FAIL' ELSE 'PASS' END",
    "FONT-GLYPH-FLOOR": f"CASE WHEN lang <> 'python' OR NOT {_M(K.MATHTEXT)} THEN 'PASS' WHEN {_SIZES} IS NULL OR {_SIZES} * 0.7 < 5 THEN 'WARN' ELSE 'PASS' END",
    "ROTATION-ANCHOR": f"CASE WHEN lang = 'python' AND len(regexp_extract_all(source, {quoted(K.ROTATION)})) > len(regexp_extract_all(source, {quoted(K.ANCHOR)})) THEN 'WARN' ELSE 'PASS' END",
    "EDITABLE-TEXT": f"CASE WHEN lang = 'python' THEN {_BOTH(K.EDITABLE['python'])} ELSE {_BOTH(K.EDITABLE['r'])} END",
    "EXPORT-VECTOR": _BOTH(K.VECTOR),
    "EXPORT-RASTER": f"CASE WHEN {_M(K.RASTER[0])} THEN 'PASS' WHEN {_M(K.RASTER[1])} THEN 'WARN' ELSE 'FAIL' END",
    "RASTER-DPI": f"CASE WHEN len({_numbers((K.DPI,))}) = 0 THEN 'WARN' WHEN list_min({_numbers((K.DPI,))}) < 300 THEN 'FAIL' WHEN list_max({_numbers((K.DPI,))}) < 600 THEN 'WARN' ELSE 'PASS' END",
    "FINAL-WIDTH": f"CASE WHEN abs({_FIRST} - 89) <= 4 OR abs({_FIRST} - 183) <= 6 THEN 'PASS' ELSE 'WARN' END",
    "BACKEND-EXCLUSIVE": f"CASE WHEN CASE WHEN lang = 'python' THEN {_any(K.BACKEND_MIX['python'])} ELSE {_any(K.BACKEND_MIX['r'])} END THEN 'WARN' ELSE 'PASS' END",
}


def _register(name, *checks):
    sql = " UNION ALL ".join(f"SELECT path, '{c}' AS \"check\", {LEVELS_SQL[c]} AS level FROM ({FILES_SQL})" for c in checks)

    @query(name, sql)
    def run(spark, sf):
        return K.code_findings(files(spark, sf), checks=checks).select("path", "check", "level")
    return run


_register("j1_fonts", "FONT-FAMILY", "FONT-SIZE", "FONT-GLYPH-FLOOR")
_register("j2_numeric_safety", "INTERP-MONOTONIC", "UNCERTAINTY-ENCODING")
_register("j3_annotations", "ROTATION-ANCHOR", "ANNOTATION-WORKAROUND")
_register("j4_colour_and_text", "COLOR-MAP", "EDITABLE-TEXT")
_register("j5_exports", "EXPORT-VECTOR", "EXPORT-RASTER", "RASTER-DPI", "FINAL-WIDTH")
_register("j6_data_handling", "DATA-SAMPLING", "DATA-EXCLUSION", "DEMO-DATA", "LOG-GUARD")
_register("j7_layout_and_backend", "PANEL-ALIGNMENT-GATE", "BACKEND-EXCLUSIVE")


@query("j_rollup", "SELECT path, count_if(level = 'PASS') AS pass, count_if(level = 'WARN') AS warn, count_if(level = 'FAIL') AS fail, count_if(level = 'FAIL') = 0 AS ready FROM ("
       + " UNION ALL ".join(f"SELECT path, {v} AS level FROM ({FILES_SQL})" for v in LEVELS_SQL.values()) + ") GROUP BY path")
def rollup(spark, sf):
    return K.code_rollup(K.code_findings(files(spark, sf)))

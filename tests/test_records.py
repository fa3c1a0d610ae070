"""Citations, versions, history, charts, layout and sources on small frames, against brute force."""

from __future__ import annotations

import difflib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from proofline.functions.ordered import previous_value, row_numbers, running_extreme, running_total
from proofline.operators import charts as C
from proofline.operators import code as K
from proofline.operators import history as H
from proofline.operators import layout as L
from proofline.operators import matching as M
from proofline.operators import references as R
from proofline.operators import units as U
from proofline.operators import versions as V
from proofline.sources import readers as S


# -- ordered helpers: a hot key must give the plain-window answer ------------------------------

def test_chunked_helpers_equal_a_plain_scan(spark):
    random.seed(3)
    data = [("hot" if i % 3 else f"k{i % 5}", i, random.randint(0, 9)) for i in range(300)]
    df = spark.createDataFrame(data, "k string, i int, v int").withColumn("c", F.floor(F.col("i") / 17))
    seen: dict = {}
    want = {}
    for k, i, v in data:
        past = seen.setdefault(k, [])
        want[(k, i)] = (sum(past) + v, past[-1] if past else None, max(past) if past else None, len(past) + 1)
        past.append(v)
    df = running_total(df, ["k"], "c", ["i"], F.col("v"), "total")
    df = previous_value(df, ["k"], "c", ["i"], F.col("v"), "prev")
    df = running_extreme(df, ["k"], "c", "i", F.col("v"), "top")
    df = row_numbers(df, ["k"], "c", ["i"], "n")
    assert {(r.k, r.i): (r.total, r.prev, r.top, r.n) for r in df.collect()} == want


# -- references --------------------------------------------------------------------------------

def test_bibliography_audit_issue_lists(spark):
    entries = spark.createDataFrame([
        (0, 0, 1, "Doe J. Glucose levels in adults. J. 2015;1:2.", "10.1000/a"), (0, 1, 2, "Doe J. Something else entirely here. J. 2015;1:2.", "10.1000/b"),
        (0, 2, 3, "Roe K. Twice. 2015;1:2", "10.1000/c"), (0, 3, 4, "Roe K. Twice. 1999;1:2", "10.1000/c"),
        (0, 4, 5, "Poe L. Insulin secretion after meals. 2011;3:4", None), (0, 5, 6, "Zoe. Unknown", None), (0, 6, 7, "X. 2011;1", "10.1000/f"),
    ], "doc_id bigint, para_idx int, number int, text string, doi string")
    records = spark.createDataFrame([
        (1, "work", None, "10.1000/a", "Glucose levels in adults", [2015]), (2, "work", None, "10.1000/b", "Kidney function markers measured", [2001]),
        (3, "article", "7", "10.1000/c", "Twice", [2015]), (4, "article", "8", None, "Insulin secretion after meals", [2011]),
    ], "load_order int, source string, pmid string, doi string, title string, years array<int>")
    failed = spark.createDataFrame([("10.1000/F",)], "doi string")
    got = {r.number: list(r.issues) for r in R.bibliography_audit(entries, records, failed).collect()}
    assert got == {1: [], 2: ["TITLE_MISMATCH", "YEAR_MISMATCH"], 3: ["DUPLICATE_DOI"], 4: ["DUPLICATE_DOI", "YEAR_MISMATCH"],
                   5: ["NO_DOI"], 6: ["NO_DOI", "NO_RECORD"], 7: ["FETCH_ERROR"]}


def test_title_index_loses_no_match(spark):
    random.seed(5)
    words = [f"w{i}" for i in range(30)]
    titles = [(i, " ".join(random.choices(words, k=random.randint(1, 25)))) for i in range(40)]
    entries = [(i, " ".join(w for w in random.choice(titles)[1].split() if random.random() > 0.08)) for i in range(60)]
    got = {r.entry_id: (r.record_id, r.coverage) for r in M.best_title_match(
        spark.createDataFrame(entries, "entry_id int, text string"), spark.createDataFrame(titles, "record_id int, title string")).collect()}
    want = {}
    for e, text in entries:
        have = set(text.split())
        best = max(((round(sum(w in have for w in t.split()) / len(t.split()), 3), -r) for r, t in titles))
        if best[0] >= 0.9:
            want[e] = (-best[1], best[0])
    assert got == want


def test_reference_trace_equals_brute_force(spark):
    random.seed(7)
    vocabulary = ["ab", "c", "de", "fgh", "ij", "klm"]
    pages = [(i, " ".join(random.choices(vocabulary, k=40))) for i in range(30)] + [(99, "x" * 5 + "longsingletoken" + "y" * 5)]
    probes = [(i, p[random.randint(0, 20):][:random.randint(9, 80)]) for i, (_, p) in enumerate(pages[:25])]
    probes += [(50, "longsingletoken"), (51, "ab ab ab ab nowhere at all in any page of these"), (52, pages[0][1][:35] + " but then something new")]
    got = {(r.probe_id, r.match, r.page_id) for r in M.reference_trace(
        spark.createDataFrame(probes, "probe_id int, text string"), spark.createDataFrame(pages, "page_id int, text string")).collect()}
    want = set()
    for i, t in probes:
        probe = " ".join(t.split())[:60].strip()
        if len(probe) < 8:
            continue
        full = [p for p, body in pages if probe in body]
        pre = [p for p, body in pages if len(probe) > 30 and probe[:30].strip() in body]
        hits, kind = (full, "full") if full else (pre, "prefix30")
        want |= {(i, kind, p) for p in hits} if hits else {(i, "none", None)}
    assert got == want


def test_verdicts_and_temporary_cites(spark):
    cites = spark.range(1).select(R.parse_temporary(F.lit("Doe`;Co, 2020 #12;Roe #7;broken")).alias("c")).head().c
    assert [(c.author, c.year, c.recnum, c.unparsed) for c in cites] == [
        ("Doe;Co", "2020", "12", None), ("Roe", None, "7", None), (None, None, None, "broken")]
    items = spark.createDataFrame([(1, ["a"]), (2, ["b"])], "field_index int, keys array<string>")
    verdicts = spark.createDataFrame([
        (1, 1, ["a"], "MISMATCH", "x", "NONE", "high", None), (2, 1, ["a"], "WEAK", "x", "NONE", None, None),
        (3, 2, ["z"], "WEAK", "x", "NONE", None, None), (4, 9, ["a"], "WEAK", "x", "NONE", None, None)],
        "file_order int, field_index int, cited array<string>, verdict string, reason string, suggested_action string, confidence string, tier int")
    checked = R.validate_verdicts(verdicts, items)
    assert {r.file_order: list(r.errors) for r in checked.collect()} == {1: [], 2: ["duplicate"], 3: ["unknown key"], 4: ["not an item"]}
    valid = checked.where(F.size("errors") == 0)
    assert [r.t for r in valid.select(R.verdict_tier().alias("t")).collect()] == ["tier1"]
    assert [r.field_index for r in R.not_judged(items, valid).collect()] == [2]


def test_claims_take_the_sentence_before_the_marker(spark):
    paras = spark.createDataFrame([(0, 0, "S", "First claim. Second claim here. Third.")], "doc_id int, para_idx int, section string, text string")
    marks = spark.createDataFrame([(0, 0, 1, 12), (0, 0, 2, 20), (0, 0, 3, 0)], "doc_id int, para_idx int, field_index int, position int")
    got = {r.field_index: (r.claim, r.context_before, r.context_after) for r in R.claim_items(paras, marks).collect()}
    assert got == {1: ("First claim.", "", "Second claim here."), 2: ("Second claim here.", "First claim.", "Third."),
                   3: ("First claim.", "", "Second claim here.")}


def test_resolver_replaces_only_complete_groups(spark):
    paras = spark.createDataFrame([(0, 0, "a [PMID: 1] b [PMIDs: 1, 2] c [PMID: 9] d [PMIDs: 1, 1]")], "doc_id int, para_idx int, text string")
    library = spark.createDataFrame([("1", 11, "Do;e", "2020", 1), ("2", 12, "Roe", "2021", 1)], "pmid string, rec_number int, surname string, year string, copies int")
    out, ledger = R.resolve_placeholders(paras, library)
    assert out.head().text == "a {Do`;e, 2020 #11} b {Do`;e, 2020 #11;Roe, 2021 #12} c [PMID: 9] d [PMIDs: 1, 1]"
    assert sorted(len(r.errors) for r in ledger.collect()) == [0, 0, 1, 1]
    with pytest.raises(Exception, match="unresolved"):
        R.resolve_placeholders(paras, library, skip_unmapped=False)[1].collect()


# -- versions ----------------------------------------------------------------------------------

def applied(old, new, changes):
    out, at = [], 0
    for o1, o2, n1, n2 in changes:
        out += [old[at:o1], new[n1:n2]]
        at = o2
    return "".join(out) + old[at:]


def test_word_changes_round_trip_and_stay_minimal(spark):
    random.seed(11)
    base = "the level of glucose rose in all of the treated animals after 10 days ⟦F1⟧ and fell later".split()
    texts = []
    for _ in range(120):
        new = [random.choice(base[:14]) if random.random() < 0.2 and w[0] != "⟦" else w for w in base if random.random() > 0.1 or w[0] == "⟦"]
        texts.append((len(texts), " ".join(base), " ".join(new)))
    pairs = spark.createDataFrame(texts, "id int, old string, new string")
    for joined in (False, True):
        found = {i: [] for i, _, _ in texts}
        for r in V.word_diff(pairs, joined=joined).collect():
            found[r.id].append((r.old_start, r.old_end, r.new_start, r.new_end))
        for i, a, b in texts:
            assert applied(a, b, sorted(found[i])) == b
    special = spark.createDataFrame([(1, "a ⟦F1⟧ b", "a b ⟦F2⟧"), (2, "The level was high today", "The level was low today"), (3, "5\u00a0mg", "5 mg"), (4, "5 mg", "5\u00a0mg"),
                                     (5, "abcd e fghi", "wxyz e uvst"), (6, "same", "same")], "id int, old string, new string")
    rows = {r.id: (r.atoms_changed, r.old_start, r.old_end, r.new_start, r.new_end) for r in V.word_diff(special, spaces=False).collect()}
    assert rows == {1: (True, None, None, None, None), 2: (False, 14, 18, 14, 17), 4: (False, 1, 2, 1, 2), 5: (False, 0, 11, 0, 11)}


def test_hunks_and_flags_have_no_limit(spark):
    old = " ".join(f"w{i} keep{i}" for i in range(40))
    new = " ".join(f"v{i} keep{i}" for i in range(40))
    long = "x" * 900
    pairs = spark.createDataFrame([(1, old, new), (2, f"a {long} b", f"a {long}y b")], "id int, old string, new string")
    hunks = V.diff_hunks(pairs).collect()
    assert sum(r.id == 1 for r in hunks) == 40 and [r.old for r in hunks if r.id == 2] == [long]
    span = "array<struct<start:int,end:int,flags:array<string>>>"
    marked = spark.createDataFrame([(1, "one two three four", "one two three four", [(0, 3, ["i"]), (8, 13, ["i"])], [(0, 3, ["b"])])], f"id int, old string, new string, old_spans {span}, new_spans {span}")
    assert sorted((r.pos, list(r.lost), list(r.gained)) for r in V.formatting_delta(marked).collect()) == [(0, ["i"], ["b"]), (8, ["i"], [])]


def test_paragraph_align_matches_equal_then_similar_ones(spark):
    a = ["one two three four", "same", "gone entirely", "alpha beta gamma", "end"]
    b = ["one two three five", "same", "new line", "alpha beta delta", "end", "tail"]
    old = spark.createDataFrame([(0, i, t) for i, t in enumerate(a)] + [(1, 0, "x")], "doc_id int, idx int, text string")
    new = spark.createDataFrame([(0, i, t) for i, t in enumerate(b)] + [(1, 0, "x")], "doc_id int, idx int, text string")
    got = {(r.kind, r.old_idx, r.new_idx) for r in V.paragraph_align(old, new).collect()}
    assert got == {("changed", 0, 0), ("removed", 2, None), ("added", None, 2), ("changed", 3, 3), ("added", None, 5)}
    assert V.paragraph_align(old, old).count() == 0


def test_science_delta_counts_and_order(spark):
    df = spark.createDataFrame([(1, "P = 0.05 rose", "P = 0.06 fell"), (2, "5 then 7", "7 then 5"), (3, "2 2 2", "2"), (4, "same 4", "same 4")], "id int, old string, new string")
    got = {r.id: (list(r.removed), list(r.added), r.reordered) for r in V.science_delta(df).collect()}
    assert got == {1: (["0.05", "rose"], ["0.06", "fell"], False), 2: ([], [], True), 3: (["2", "2"], [], False), 4: ([], [], False)}


RUNS = [(0, 0, 0, None, "Keep ", None), (0, 0, 1, "del", "old", None), (0, 0, 2, "ins", "new", None), (0, 1, 0, None, "A", "del"),
        (0, 2, 0, None, "B", None), (0, 3, 0, "moveFrom", "M", None), (0, 4, 0, "moveTo", "M", "ins")]


def test_revision_views(spark):
    runs = spark.createDataFrame(RUNS, "doc_id int, para_idx int, run_idx int, change_kind string, text string, mark_revision string")
    texts = lambda mode: [r.text for r in U.revision_view(runs, mode).orderBy("view_idx").collect()]
    assert texts("accept") == ["Keep new", "AB", "", "M"]
    assert texts("reject") == ["Keep old", "A", "B", "M", ""]
    assert V.reject_equals_source(runs, runs).count() == 0


def test_planted_corruptions_are_reported(spark):
    base = spark.createDataFrame([(0, i, f"text {i}", False) for i in range(4)], "doc_id int, idx int, text string, mark_removed boolean")
    none = spark.createDataFrame([], "doc_id int, index int, new_index int, text string, inserted boolean, deleted boolean")
    assert V.undeclared_changes(base, base, none).count() == 0
    changed = base.withColumn("text", F.when(F.col("idx") == 2, "text 3").otherwise(F.col("text")))
    assert [(r.idx, r.problem) for r in V.undeclared_changes(base, changed, none).collect()] == [(2, "undeclared change")]
    short = base.where("idx < 3")
    assert [r.problem for r in V.undeclared_changes(base, short, none).collect()] == ["paragraph missing"]
    cites = spark.createDataFrame([(0, 0, "a"), (0, 1, "b")], "doc_id int, pos int, signature string")
    swapped = spark.createDataFrame([(0, 0, "b"), (0, 1, "a")], "doc_id int, pos int, signature string")
    assert V.citation_sequence_check(cites, swapped).head().first_pos == 0
    pics = spark.createDataFrame([(0, 0, "p", "d1")], "doc_id int, pos int, name string, digest string")
    other = spark.createDataFrame([(0, 0, "p", "d2")], "doc_id int, pos int, name string, digest string")
    swaps = spark.createDataFrame([], "doc_id int, old_name string, new_name string, digest string")
    removed = spark.createDataFrame([], "doc_id int, name string, digest string")
    assert [r.problem for r in V.picture_set_check(pics, other, swaps, removed).collect()] == ["image bytes differ"]
    assert V.picture_set_check(pics, pics, swaps, removed).count() == 0


def test_view_compare(spark):
    o, c = V.FIELD_OPEN, V.FIELD_CLOSE
    df = spark.createDataFrame([(1, f"a {o}1{c} b", "a 1 b"), (2, f"a {o}1{c} b", "a 22 b"), (3, f"a {o}1{c} b", "a 1 x"), (4, "plain", "plain"), (5, f"a {o}1{c}", "a 99")], "id int, marked string, actual string")
    assert {r.id: r.status for r in V.view_compare(df).collect()} == {
        1: "identical", 2: "identical_except_field_results", 3: "different", 4: "identical", 5: "identical_except_field_results"}


# -- history -----------------------------------------------------------------------------------

def test_open_operations(spark):
    rows = [(0, 1, "move", "pending", None, "V1"), (1, 2, "save", "pending", None, "V1"), (2, 3, "save", "complete", 2, "V1"),
            (3, 4, "swap", "failed", 9, None), (4, 5, "swap", "complete", 9, None), (5, 6, "swap", "failed", 9, None)]
    ledger = spark.createDataFrame([(*r, None, None, None) for r in rows],
                                   "pos int, seq int, event string, status string, ref int, version string, reason string, figure string, figure_version string")
    assert sorted((r.seq, r.issue) for r in H.open_operations(ledger).collect()) == [(1, "interrupted"), (6, "failed")]


def test_archive_plan_equals_the_ordered_walk(spark):
    random.seed(2)
    paths = ["/".join(random.choices("abc", k=random.randint(1, 4))) for _ in range(60)]
    protected = ["a/b/c/a", "c"]
    chosen, want = [], {}
    for i, p in enumerate(paths):
        if p in protected:
            want[i] = "named by an index"
        elif any(q.startswith(p + "/") for q in protected):
            want[i] = "contains a named path"
        elif any(p == q or p.startswith(q + "/") or q.startswith(p + "/") for q in chosen):
            want[i] = "overlaps another path"
        else:
            chosen.append(p)
            want[i] = "ok"
    got = H.archive_plan(spark.createDataFrame([("x", i, p) for i, p in enumerate(paths)], "project string, ord int, path string"),
                         spark.createDataFrame([("x", p) for p in protected], "project string, key string"))
    assert {r.ord: r.result for r in got.collect()} == want


def test_twins_and_threads(spark):
    files = spark.createDataFrame([("b", "1", 2), ("a", "1", 2), ("v", "1", 1), ("z", "2", 1)], "path string, sha256 string, preference int")
    assert sorted((r.path, r.twin) for r in H.find_twins(files).collect()) == [("a", "v"), ("b", "v"), ("v", "a")]
    chain = spark.createDataFrame([(0, i, i - 1 if i else None) for i in range(40)], "doc_id int, id int, parent int")
    below = H.thread_ids(chain, spark.createDataFrame([(0, 0), (0, 35)], "doc_id int, id int"))
    assert sorted((r.root, r.id) for r in below.collect()) == [(0, i) for i in range(40)] + [(35, i) for i in range(35, 40)]


# -- charts and layout -------------------------------------------------------------------------

def test_interpolation_on_a_falling_grid(spark):
    grid = spark.createDataFrame([(0, 0, 10.0, 5.0), (0, 1, 6.0, 15.0), (0, 2, 2.0, 30.0), (1, 0, 1.0, 1.0), (1, 1, 3.0, 2.0), (1, 2, 2.0, 3.0)], "s int, pos int, x double, y double")
    targets = spark.createDataFrame([(0, 1, 7.0), (0, 2, 99.0), (0, 3, -1.0), (0, 4, 6.0), (1, 5, 2.0)], "s int, target_id bigint, t double")
    got = {r.target_id: (r.direction, r.value) for r in C.interp_monotone(targets, grid, "s", "t", "pos", "x", "y").collect()}
    assert got == {1: ("falling", 12.5), 2: ("falling", 5.0), 3: ("falling", 30.0), 4: ("falling", 15.0), 5: ("unsafe", None)}


def test_box_stats_equal_numpy(spark):
    import numpy as np
    random.seed(4)
    values = [round(random.gauss(0, 3), 1) for _ in range(500)] + [7.0] * 400
    out = C.box_stats(spark.createDataFrame([("g", v) for v in values], "g string, v double"), "g", "v").head()
    q1, q2, q3 = np.percentile(values, [25, 50, 75])
    assert (out.q1, out.median, out.q3) == pytest.approx((q1, q2, q3))
    inside = [v for v in values if q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)]
    assert (out.whisker_low, out.whisker_high) == (min(inside), max(inside))


def test_numeric_coercion(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,), ("NaN",), ("inf",)], "v string")
    valid, rejected = C.coerce_numeric(df, ["v"])
    assert [r.v for r in valid.collect()] == [1.5] and rejected.count() == 4
    with pytest.raises(Exception, match="non-finite"):
        C.require_complete(df, ["v"]).collect()


def test_spatial_join_equals_all_pairs(spark):
    random.seed(9)
    boxes = []
    for i in range(150):
        x, y, size = random.uniform(-20, 100), random.uniform(-20, 100), random.choice([0.5, 3, 20, 120])
        boxes.append((1, i, x, y, x + random.uniform(0.1, size), y + random.uniform(0.1, size)))
    df = spark.createDataFrame(boxes, "page int, idx int, x0 double, y0 double, x1 double, y1 double")
    meet = lambda a, b: min(a[4], b[4]) > max(a[2], b[2]) and min(a[5], b[5]) > max(a[3], b[3])
    want = sorted((a[1], b[1]) for a, b in itertools.combinations(boxes, 2) if meet(a, b))
    assert sorted((r.left_idx, r.right_idx) for r in L.overlapping_pairs(df).collect()) == want
    left, right = df.where("idx < 60"), df.where("idx >= 60")
    both = sorted((a[1], b[1]) for a in boxes[:60] for b in boxes[60:] if meet(a, b))
    assert sorted((r.left_idx, r.right_idx) for r in L.overlapping_pairs(left, right).collect()) == both


def test_stroke_crossing_and_text_size(spark):
    texts = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 50.0, 50.0, 60.0, 60.0)], "page int, idx int, x0 double, y0 double, x1 double, y1 double")
    seg = lambda x0, y0, x1, y1: [{"x0": x0, "y0": y0, "x1": x1, "y1": y1}]
    strokes = spark.createDataFrame([(1, 0, -5.0, -5.0, 20.0, 20.0, 1.0, seg(-5.0, -5.0, 20.0, 20.0)), (1, 1, 45.0, 55.0, 65.0, 75.0, 1.0, seg(45.0, 65.0, 65.0, 75.0))],
                                    "page int, idx int, x0 double, y0 double, x1 double, y1 double, width double, segments array<struct<x0:double,y0:double,x1:double,y1:double>>")
    assert [(r.text_idx, r.strokes) for r in L.text_stroke_crossing(texts, strokes).collect()] == [(0, 1)]
    runs = spark.createDataFrame([("a", 7.0), ("b", 4.9), ("b", 6.0), ("c", None)], "file string, size_pt double")
    assert sorted((r.file, r.auditable, r.minimum_found, r.below) for r in L.min_text_size(runs).collect()) == [
        ("a", True, 7.0, 0), ("b", True, 4.9, 1), ("c", False, None, 0)]


def test_code_rules(spark):
    files = spark.createDataFrame([("a.py", "python", "np.interp(t, x, y); fontsize=4; cmap='jet'"), ("b.py", "python", "np.interp(t, x, y); np.diff(x) > 0; fontsize=8")], "path string, lang string, source string")
    got = {(r.path, r.check): r.level for r in K.code_findings(files).collect()}
    assert got[("a.py", "INTERP-MONOTONIC")] == "WARN" and got[("b.py", "INTERP-MONOTONIC")] == "PASS"
    assert got[("a.py", "FONT-SIZE")] == "FAIL" and got[("b.py", "FONT-SIZE")] == "PASS" and got[("a.py", "COLOR-MAP")] == "FAIL"


# -- sources -----------------------------------------------------------------------------------

def test_csv_with_mark_and_missing_columns(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes("﻿a,b\n1,2\n".encode())
    assert S.read_csv_checked(spark, str(tmp_path / "x.csv"), ["a", "b"]).columns == ["a", "b"]
    with pytest.raises(ValueError, match="missing required CSV columns: c"):
        S.read_csv_checked(spark, str(tmp_path / "x.csv"), ["a", "c"])


def test_ledger_files(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"seq": 1, "event": "a"}\n\nnot json\n{"seq": 2, "event": "b"}\n')
    good, bad = S.read_ledger(spark, str(tmp_path / "l.jsonl"))
    assert sorted((r.pos, r.seq) for r in good.collect()) == [(1, 1), (4, 2)] and [r.line_no for r in bad.collect()] == [3]


def test_article_file_is_split_at_records(spark, tmp_path):
    one = lambda n: f"<PubmedArticle><MedlineCitation><PMID>{n}</PMID><Article><ArticleTitle>T <i>{n}</i></ArticleTitle></Article></MedlineCitation></PubmedArticle>"
    book = "<PubmedBookArticle><BookDocument><PMID>9</PMID><Book><BookTitle>B</BookTitle></Book></BookDocument></PubmedBookArticle>"
    (tmp_path / "a.xml").write_text("<?xml version='1.0'?><PubmedArticleSet>" + one(1) + "\n" + one(2) + book + "</PubmedArticleSet>")
    got = sorted((r.kind, r.pmid, r.title) for r in S.read_articles(spark, str(tmp_path / "a.xml")).collect())
    assert got == [("article", "1", "T 1"), ("article", "2", "T 2"), ("book", "9", "B")]


def test_markdown_blocks(spark):
    text = "# H\nline one\nline two\n<!-- note\nstill -->\nline three\n\n| a | b |\n| --- | --- |\n| 1 |\n![Alt](p.png)\n\\pagebreak\n#### deep"
    rows = S.markdown_blocks(spark.createDataFrame([(0, text)], "doc_id int, text string")).orderBy("line_no").collect()
    assert [(r.line_no, r.kind, r.problem) for r in rows] == [
        (1, "heading", None), (2, "para", None), (8, "table", "row width differs from header"), (11, "picture", None), (12, "pagebreak", None), (13, "heading", "heading too deep")]
    assert rows[1].text == "line one line two line three" and rows[3].path == "p.png"


def test_digest_ignores_order_and_caches(spark):
    df = spark.createDataFrame([("g", "a.py", "x"), ("g", "b.py", "y"), ("g", "__pycache__/b.pyc", "z")], "grp string, name string, body string")
    one = S.content_digest(df, "grp", "name", "body").head()
    two = S.content_digest(df.orderBy(F.desc("name")).where("name not like '%pyc'"), "grp", "name", "body").head()
    assert one.files == 2 and one.digest == two.digest
    swapped = df.withColumn("body", F.when(F.col("name") == "a.py", "y").when(F.col("name") == "b.py", "x").otherwise("z"))
    assert S.content_digest(swapped, "grp", "name", "body").head().digest != one.digest


def test_exclusive_output(spark, tmp_path):
    df = spark.range(3)
    S.write_exclusive(df, str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exist"):
        S.write_exclusive(df, str(tmp_path / "out"))


# -- alignment: as many tokens as possible stay matched ---------------------------------------

def brute_chain(x, y):
    """Behind a common head and before a common tail: the least longest common subsequence, from a quadratic table."""
    head = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    x, y = x[head:], y[head:]
    tail = next((i for i, (p, q) in enumerate(zip(x[::-1], y[::-1])) if p != q), min(len(x), len(y)))
    n, m = len(x) - tail, len(y) - tail
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in reversed(range(n)):
        for j in reversed(range(m)):
            best[i][j] = 1 + best[i + 1][j + 1] if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while best[i][j]:
        want = best[i][j]
        i, j = next((a, b) for a in range(i, n) for b in range(j, m) if x[a] == y[b] and best[a + 1][b + 1] == want - 1)
        out.append((i, j))
        i, j = i + 1, j + 1
    return head, out


def matched(spark, cases, limit=1 << 20):
    from proofline.operators import alignment as A

    core = A.cores(spark.createDataFrame([(k, list(x), list(y)) for k, (x, y) in enumerate(cases)], "id int, x array<string>, y array<string>"))
    heads = {r.id: r.head for r in core.collect()}
    found = {k: [] for k in range(len(cases))}
    for r in A.matched_in_cores(core, limit).collect():
        found[r.id].append((r.a, r.b))
    return [(heads[k], sorted(found[k])) for k in range(len(cases))]


def test_matched_tokens_equal_a_quadratic_table(spark):
    rng = random.Random(4)
    cases = [("abcde", p) for p in itertools.permutations("abcde")]                       # every small permutation
    cases += [("".join(rng.choice("ab ") for _ in range(rng.randint(0, 12))), "".join(rng.choice("ab ") for _ in range(rng.randint(0, 12)))) for _ in range(300)]
    cases += [("xaaa", "aaax"), ("0123456789", "1234567890"), ("", "a"), ("a", ""), ("aa", "aa")]
    assert matched(spark, cases) == [brute_chain(list(x), list(y)) for x, y in cases]


def test_large_cores_are_cut_at_single_tokens(spark):
    rng = random.Random(8)
    words = [f"w{i}" if i % 3 else "the" for i in range(60)]
    moved = [*words[1:], words[0]][:-1] + ["new", words[4]]
    head, chain = matched(spark, [(words, moved)], limit=50)[0]
    wanted = brute_chain(words, moved)
    assert len(chain) == len(wanted[1]) and all(words[head + a] == moved[head + b] for a, b in chain)
    few = [(["a", "b"] * 30, ["b", "a"] * 25)]
    head, chain = matched(spark, few, limit=50)[0]
    assert len(chain) >= 25 and all(p < q and r < s for (p, r), (q, s) in itertools.pairwise(chain))


def test_a_moved_paragraph_unmatches_no_other(spark):
    lines = [f"paragraph {chr(97 + i)} of its own" for i in range(10)]
    frame = lambda rows: spark.createDataFrame([(0, i, t) for i, t in enumerate(rows)], "doc_id int, idx int, text string")
    got = {(r.kind, r.old_idx, r.new_idx) for r in V.paragraph_align(frame(lines), frame([*lines[1:], lines[0]])).collect()}
    assert got == {("removed", 0, None), ("added", None, 9)}


def test_versions_of_repeated_wording_are_paired(spark):
    """No word of the gap is unique; pairs are those of a greedy search over all."""
    def greedy(old, new):
        words = lambda t: set(t.split())
        out, start = set(), 0
        for i, a in enumerate(old):
            score, j = max(((2 * len(words(a) & words(b)) / (len(words(a)) + len(words(b))), j) for j, b in enumerate(new) if j >= start), default=(0, None))
            if score >= 0.5:
                out.add((i, j))
                start = j + 1
        return out
    rng, olds, news, expected = random.Random(3), [], [], {}
    for doc in range(40):
        old = [" ".join(rng.choice("abcdef") for _ in range(5)) + f" old{i % 2}" for i in range(rng.randint(1, 6))]
        new = [" ".join(rng.choice("abcdef") for _ in range(5)) + f" new{i % 2}" for i in range(rng.randint(1, 6))]
        olds += [(doc, i, t) for i, t in enumerate(old)]
        news += [(doc, i, t) for i, t in enumerate(new)]
        expected[doc] = greedy(old, new)
    got = {doc: set() for doc in expected}
    for r in V.paragraph_align(*(spark.createDataFrame(rows, "doc_id int, idx int, text string") for rows in (olds, news))).where("kind = 'changed'").collect():
        got[r.doc_id].add((r.old_idx, r.new_idx))
    assert got == expected


def test_versions_of_a_line_meet_inside_its_row(spark):
    """Blanks of a long line equal each other in pairs that grow with its square; no pair is listed and no token is sent anywhere."""
    from proofline.operators import versions as V

    old = " ".join(f"w{i % 50}," for i in range(600))
    df = spark.createDataFrame([(1, old, old.replace(",", ";"))], "id int, old string, new string")
    hunks = V.diff_hunks(df)
    spans = "array(named_struct('start', 0, 'end', 4, 'flags', array('{0}')))"
    delta = V.formatting_delta(df.selectExpr("*", f"{spans.format('italic')} AS old_spans", f"{spans.format('bold')} AS new_spans"))
    for frame in (hunks, delta):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan and "Window" not in plan
    assert hunks.count() == 600
    assert [tuple(r) for r in delta.orderBy("pos").collect()] == [(1, 0, "w0", ["italic"], ["bold"])]


def test_snapshot_of_more_than_a_million_parts(spark, tmp_path, rows):
    """A new part whose key is taken by a part of the older snapshot is still added, and the older one still counts."""
    import __spark_entry__ as entry_module

    spark.createDataFrame([(5, 12), (1_000_005, 10), (7, 12), (1_000_007, 33)], "p_partkey bigint, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    found = entry_module.queries()["f15_snapshot_diff"](spark, str(tmp_path))
    assert rows(found) == sorted([(1_000_005, "added", None, 12), (1_000_005, "removed", 10, None), (1_000_007, "added", None, 12)], key=repr)


def test_code_checks_run_only_when_asked_for_and_signs_change_nothing(spark, rows, monkeypatch):
    from proofline.plans import queries_code as Q
    from proofline.plans.catalog import QUERIES

    odd = ["SEED; MEAN(v); YERR=e", "Fold_ID mean", "x <- a |b", "NP.RANDOM.RAND(", "RANDOM_SPLIT AVERAGE", "Drop_NA(", "Pdf.FontType: 42; SVG.fonttype='none'", "[ ::-1 ]; np.interp (", "LABEL_Y = 2",
           "element_text(a, SIZE = 4)", "$a_b$ labelsize=3", "rotation=1", "res=72", "FIGSIZE=(7.2", "ggsave('x', width = 89, units = 'mm')", "Liberation Sans", "GEOM_Ribbon( random_state median", "strictly  positive np.log(", "İ K log2(", "", None]
    data = [(100 * k + i, lang, s) for k, lang in enumerate(("python", "r")) for i, s in enumerate([*Q.SNIPPETS, *odd])]
    files = spark.createDataFrame(data, "path long, lang string, source string")
    quick = rows(K.code_findings(files), "path", "check", "level")
    asked = rows(K.code_findings(files, checks=("LOG-GUARD", "FONT-SIZE")), "path", "check", "level")
    assert asked == [r for r in quick if r[1] in ("LOG-GUARD", "FONT-SIZE")]
    monkeypatch.setattr(K, "SIGNS", {})
    assert quick == rows(K.code_findings(files), "path", "check", "level") and len(quick) == 19 * len(data)
    plan = QUERIES["j3_annotations"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert "bbox" in plan and "default_rng" not in plan


def test_library_records_are_spread_and_dropped_fields_not_parsed(spark, rows):
    from proofline.plans import queries_sources as Q

    assert Q.library(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    xml = "<record><rec-number>{0}</rec-number><contributors><authors><author>A{0}, B</author></authors></contributors><accession-num>{1}</accession-num><label>{2}</label></record>"
    data = [(k, xml.format(k, pmid, label)) for k, pmid, label in [(7, "12", "x"), (3, "12", "y"), (5, "WOS", "y"), (9, "13", "x")]]
    found = S.library_map(S.parse_library(spark.createDataFrame(data, "ord long, xml string")))
    assert rows(found, "pmid", "rec_number", "surname", "copies") == [("12", "3", "A3", 2), ("13", "9", "A9", 1)]
    plan = found.select("pmid", "rec_number")._jdf.queryExecution().optimizedPlan().toString()
    assert "rec-number" in plan and "contributors" not in plan

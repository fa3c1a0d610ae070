"""Comparison of two versions of documents, snapshots and packages.

Equal rows are removed by joins or equality first; the rest is aligned inside its row (``alignment``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions import text as T
from proofline.operators import alignment as A
from proofline.operators.units import revision_view
from proofline.session import materialise

# Protected atoms and special spaces.
ATOM = "⟦[A-Z][0-9]+⟧"
SPECIAL_SPACES = "\u00a0\u202f\u2007"
TOKEN = f"(?s){ATOM}|[\\p{{L}}\\p{{N}}_]+|[ \\t{SPECIAL_SPACES}]+|."
WORD = "(?s)[^ ]+| "


def paragraph_align(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changed, removed and added paragraphs of each document: (doc_id, idx, text) against (doc_id, idx, text).

    Equal paragraphs are matched by their text's hash, as many as can be in order; between matched ones, versions of a paragraph find
    each other by the share of common words. Texts travel only for paragraphs without an equal one.
    """
    hashes = lambda df, name: df.groupBy(F.col("doc_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("idx", F.sha2("text", 256).alias("h")))).alias(name))
    none = F.array().cast("array<struct<idx:int,h:string>>")
    both = hashes(old.withColumn("idx", F.col("idx").cast("int")), "o").join(hashes(new.withColumn("idx", F.col("idx").cast("int")), "n"), "id", "full")
    both = both.select("id", F.coalesce("o", none).alias("o"), F.coalesce("n", none).alias("n"))
    both = materialise(both.select("id", F.col("o.idx").alias("ia"), F.col("n.idx").alias("ib"), F.col("o.h").alias("x"), F.col("n.h").alias("y")), "paragraphs")
    core = materialise(A.cores(both), "paragraphs")
    runs = materialise(A.changed_runs(core, A.matched_in_cores(core)), "paragraphs")
    placed = runs.join(both.select("id", "ia", "ib"), "id")
    named = lambda place, a, b: F.slice(place, F.col(a) + 1, F.col(b) - F.col(a))
    open_ones = lambda df, place, a, b: placed.select("id", F.col("a0").alias("gap"), F.explode(named(place, a, b)).alias("pos")).join(
        df.select(F.col("doc_id").alias("id"), F.col("idx").cast("int").alias("pos"), "text"), ["id", "pos"])
    left, right = materialise(open_ones(old, "ia", "a0", "a1"), "paragraphs"), materialise(open_ones(new, "ib", "b0", "b1"), "paragraphs")
    pairs = A.similar_paragraphs(left, right)
    a = left.select("id", F.col("pos").alias("a"), F.col("text").alias("old"))
    b = right.select("id", F.col("pos").alias("b"), F.col("text").alias("new"))
    both = a.join(pairs.select("id", "a", "b"), ["id", "a"], "left").join(b, ["id", "b"], "full")
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    return both.select(F.col("id").alias("doc_id"), kind.alias("kind"), F.col("a").alias("old_idx"), F.col("b").alias("new_idx"),
                       F.coalesce("old", F.lit("")).alias("old"), F.coalesce("new", F.lit("")).alias("new"))


def _tokenised(pairs: DataFrame, pattern: str, *more: str) -> DataFrame:
    return pairs.select("id", *more, A.tokens("old", pattern).alias("x"), A.tokens("new", pattern).alias("y"))


def _changes(pairs: DataFrame, pattern: str, spaces: bool = True) -> DataFrame:
    """Changed spans of (id, old, new), with old and new; with ``spaces`` false, a special space that became a plain one is no change."""
    if spaces:
        return A.changed_spans(materialise(A.cores(_tokenised(pairs, pattern, "old", "new"), "old", "new", lead=True), "tokens"), "old", "new")
    rows = _tokenised(pairs, pattern)
    fold = lambda c: F.transform(c, lambda t: F.translate(t, SPECIAL_SPACES, " " * len(SPECIAL_SPACES)))
    folded = rows.select("id", fold("x").alias("x"), fold("y").alias("y"))
    core = materialise(A.cores(folded), "tokens")
    matched = materialise(A.matched_in_cores(core), "tokens")
    # a new special space where an equal but plain one stood is a change of its own
    plain = whole_matches(folded, core, matched).join(rows, "id").select("id", "a", "b", F.get("x", F.col("a")).alias("t"), F.get("y", F.col("b")).alias("u"))
    asked = plain.where((F.col("t") != F.col("u")) & F.col("u").rlike(f"[{SPECIAL_SPACES}]")).select("id", F.col("a").alias("a0"), (F.col("a") + 1).alias("a1"), F.col("b").alias("b0"), (F.col("b") + 1).alias("b1"))
    return A.character_spans(rows, _adjoined(A.changed_runs(core, matched).unionByName(asked))).join(pairs, "id")


def _adjoined(runs: DataFrame) -> DataFrame:
    """Runs of changed tokens that follow each other on both sides, joined."""
    order = Window.partitionBy("id").orderBy("a0", "b0")
    apart = F.coalesce((F.col("a0") != F.lag("a1").over(order)) | (F.col("b0") != F.lag("b1").over(order)), F.lit(True))
    grouped = runs.withColumn("_apart", apart).withColumn("_group", F.sum(F.col("_apart").cast("int")).over(order))
    return grouped.groupBy("id", "_group").agg(F.min("a0").alias("a0"), F.max("a1").alias("a1"), F.min("b0").alias("b0"), F.max("b1").alias("b1")).drop("_group")


def whole_matches(rows: DataFrame, core: DataFrame, matched: DataFrame) -> DataFrame:
    """(id, a, b): all matched tokens as places in the whole arrays (id, x, y), those of the common head and tail among them."""
    inner = matched.join(core.select("id", "head"), "id").select("id", (F.col("a") + F.col("head")).alias("a"), (F.col("b") + F.col("head")).alias("b"))
    ends = rows.select("id", F.size("x").alias("nx"), F.size("y").alias("ny")).join(core.select("id", "head", F.size("x").alias("cx")), "id")
    count = F.col("nx") - F.col("cx")                     # places of the head, then of the tail
    places = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1))
    ends = ends.select("id", "nx", "ny", "head", F.explode(places(count)).alias("k"), count.alias("n"))
    shift = lambda size: F.when(F.col("k") < F.col("head"), F.col("k")).otherwise(F.col("k") + F.col(size) - F.col("n"))
    return inner.unionByName(ends.select("id", shift("nx").alias("a"), shift("ny").alias("b")))


def word_diff(pairs: DataFrame, spaces: bool = True, joined: bool = True) -> DataFrame:
    """Character spans that differ in (id, old, new); ``atoms_changed`` marks pairs whose protected atoms differ, without spans."""
    changed = pairs.select("id", "old", "new").where(F.col("old") != F.col("new"))
    atoms = lambda c: F.regexp_extract_all(c, F.lit(ATOM), F.lit(0))
    marked = changed.withColumn("atoms_changed", atoms("old") != atoms("new"))
    comparable = marked.where("NOT atoms_changed").drop("atoms_changed")
    spans = _changes(comparable, TOKEN, spaces)
    if joined:
        spans = A.join_close(spans).join(comparable, "id")
    rows = spans.withColumn("atoms_changed", F.lit(False)).unionByName(marked.where("atoms_changed"), allowMissingColumns=True)
    cut = lambda text, a, b: F.substr(F.col(text), F.col(a) + 1, F.col(b) - F.col(a))
    return rows.select("id", "atoms_changed", "old_start", "old_end", "new_start", "new_end",
                       cut("old", "old_start", "old_end").alias("old_text"), cut("new", "new_start", "new_end").alias("new_text"))


def diff_hunks(pairs: DataFrame, context: int = 8) -> DataFrame:
    """Every differing stretch of words of each pair, with up to ``context`` words of the old text on both sides."""
    changed = pairs.select("id", "old", "new").where(F.col("old") != F.col("new"))
    rows = _changes(changed, WORD)
    words = lambda text: F.regexp_extract_all(text, F.lit("[^ ]+"), F.lit(0))
    before = T.let(words(F.substr(F.col("old"), F.lit(1), F.col("old_start"))), lambda w: F.slice(w, F.greatest(F.size(w) - context + 1, F.lit(1)), F.lit(context)))
    after = F.slice(words(F.substr(F.col("old"), F.col("old_end") + 1, F.char_length("old"))), 1, context)
    cut = lambda text, a, b: F.substr(F.col(text), F.col(a) + 1, F.col(b) - F.col(a))
    op = F.when(F.col("old_end") == F.col("old_start"), "insert").when(F.col("new_end") == F.col("new_start"), "delete").otherwise("replace")
    return rows.select("id", "old_start", op.alias("op"), F.array_join(before, " ").alias("before"), cut("old", "old_start", "old_end").alias("old"),
                       cut("new", "new_start", "new_end").alias("new"), F.array_join(after, " ").alias("after"))


# Fixed value: numbers, statistics terms, symbols and direction words.
SCIENCE = (r"(?U)[-−]?\d(?:[\d.,]*\d)?%?|\b(?:P|q|n|CI|OR|HR|RR|SD|SEM|AUROC|AUC)\b|\b[A-Z][A-Z0-9]{2,}[0-9A-Z-]*\b"
           r"|(?i:\b(?:increas|decreas|higher|lower|greater|smaller|rose|fell|declin|reduc|elevat|positive|negative|"
           r"more|less)\w*)")


def science_terms(text) -> Column:
    return F.regexp_extract_all(T._col(text), F.lit(SCIENCE), F.lit(0))


def bag_difference(left: Column, right: Column) -> Column:
    """Elements of ``left`` beyond their count in ``right``, repeated as often as they exceed it, sorted."""
    def excess(a, b):
        count = lambda bag, t: F.size(F.filter(bag, lambda x: x == t))
        return F.sort_array(F.flatten(F.transform(F.array_distinct(a), lambda t: F.array_repeat(
            t, F.greatest(count(a, t) - count(b, t), F.lit(0))))))
    return T.let(left, lambda a: T.let(right, lambda b: excess(a, b)))


def science_delta(pairs: DataFrame) -> DataFrame:
    """Terms removed, added, or only reordered between old and new text; row by row, no shuffle."""
    terms = pairs.select(*[c for c in pairs.columns if c not in ("old", "new")],
                         science_terms("old").alias("before"), science_terms("new").alias("after"))
    removed, added = bag_difference(F.col("before"), F.col("after")), bag_difference(F.col("after"), F.col("before"))
    out = terms.withColumn("removed", removed).withColumn("added", added)
    moved = (F.size("removed") == 0) & (F.size("added") == 0) & (F.col("before") != F.col("after"))
    return out.withColumn("reordered", moved).drop("before", "after")


def drift_report(aligned: DataFrame, old_counts: DataFrame, new_counts: DataFrame) -> DataFrame:
    """Changes by kind, science terms moved, and citation and picture count changes per document."""
    delta = science_delta(aligned.select("doc_id", "kind", "old", "new"))
    n = lambda k: F.count_if(F.col("kind") == k).alias(k)
    per = delta.groupBy("doc_id").agg(
        n("changed"), n("removed").alias("paragraphs_removed"), n("added").alias("paragraphs_added"),
        F.sum(F.size("removed")).alias("terms_removed"), F.sum(F.size("added")).alias("terms_added"))
    before = old_counts.select("doc_id", F.col("citations").alias("c0"), F.col("pictures").alias("p0"))
    after = new_counts.select("doc_id", F.col("citations").alias("c1"), F.col("pictures").alias("p1"))
    return per.join(before, "doc_id", "left").join(after, "doc_id", "left").select(
        "doc_id", "changed", "paragraphs_removed", "paragraphs_added", "terms_removed", "terms_added",
        (~(F.col("c0").eqNullSafe(F.col("c1")) & F.col("p0").eqNullSafe(F.col("p1")))).alias("counts_changed"))


def undeclared_changes(base: DataFrame, new: DataFrame, declared: DataFrame) -> DataFrame:
    """Paragraphs of the new version that are neither their source nor their declared text.

    ``base``/``new(doc_id, idx, text, mark_removed)``; ``declared(doc_id, index, new_index, text,
    inserted boolean, deleted boolean)``. A source paragraph's place in the new version is the
    position left over after declared insertions.
    """
    inserted = declared.where("inserted").select("doc_id", F.col("new_index").alias("idx"), F.lit(True).alias("ins"))
    order = Window.partitionBy("doc_id").orderBy("idx")
    placed = new.select("doc_id", "idx", F.col("text").alias("got"), F.col("mark_removed").alias("got_mark")).join(
        inserted, ["doc_id", "idx"], "left")
    placed = placed.withColumn("src", F.when(F.col("ins").isNull(), F.count_if(F.col("ins").isNull()).over(order) - 1))
    want = base.select("doc_id", F.col("idx").cast("bigint").alias("src"), F.col("text").alias("want"),
                       F.col("mark_removed").alias("base_mark"))
    edits = declared.where("NOT inserted").select(
        "doc_id", F.col("index").cast("bigint").alias("src"), F.col("text").alias("edit"),
        F.coalesce("deleted", F.lit(False)).alias("deleted"))
    additions = declared.where("inserted").select("doc_id", F.col("new_index").alias("idx"), F.col("text").alias("addition"))
    both = placed.where("src IS NOT NULL").join(want, ["doc_id", "src"], "full").join(edits, ["doc_id", "src"], "left")
    expected = F.coalesce("edit", "want")
    mark = F.coalesce("base_mark", F.lit(False)) | F.coalesce("deleted", F.lit(False))
    kinds = F.array_compact(F.array(
        F.when(F.col("idx").isNull(), "paragraph missing").when(F.col("want").isNull(), "paragraph not declared")
        .when(~F.col("got").eqNullSafe(expected), F.when(F.col("edit").isNull(), "undeclared change")
              .otherwise("not the declared text")),
        F.when(F.col("idx").isNotNull() & F.col("want").isNotNull() & (F.coalesce("got_mark", F.lit(False)) != mark),
               "paragraph mark")))
    source = both.select("doc_id", F.coalesce("idx", F.col("src")).cast("bigint").alias("idx"), F.explode(kinds).alias("problem"))
    fresh = placed.where("ins").join(additions, ["doc_id", "idx"], "left")
    wrong = F.array_compact(F.array(
        F.when(~F.col("got").eqNullSafe(F.col("addition")), "not the declared insertion"),
        F.when(F.coalesce("got_mark", F.lit(False)), "paragraph mark")))
    return source.unionByName(fresh.select("doc_id", F.col("idx").cast("bigint").alias("idx"), F.explode(wrong).alias("problem")))


def positional_difference(base: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Positions whose value differs, one side may be missing."""
    a = base.select(*keys, F.col(value).alias("base_value"), F.lit(True).alias("_a"))
    b = new.select(*keys, F.col(value).alias("new_value"), F.lit(True).alias("_b"))
    return a.join(b, keys, "full").where(
        F.col("_a").isNull() | F.col("_b").isNull() | ~F.col("base_value").eqNullSafe(F.col("new_value"))).drop("_a", "_b")


def reject_equals_source(base_runs: DataFrame, new_runs: DataFrame) -> DataFrame:
    """Paragraphs where rejecting all changes does not give back the source: an untracked change."""
    return positional_difference(revision_view(base_runs, "reject"), revision_view(new_runs, "reject"),
                                 ["doc_id", "view_idx"], "text")


def citation_sequence_check(base: DataFrame, new: DataFrame) -> DataFrame:
    """First citation per document whose signature differs: (doc_id, pos, signature)."""
    diff = positional_difference(base, new, ["doc_id", "pos"], "signature")
    return diff.groupBy("doc_id").agg(F.min("pos").alias("first_pos"), F.count("*").alias("different"))


CITATION_NUMBERS = r"\(\d[\d,\s–-]*\)"   # fixed value


def citation_contexts(paras: DataFrame, citations: DataFrame, words: int = 6) -> DataFrame:
    """The last words before each citation, other citation numbers removed: (doc_id, para_idx, pos, start)."""
    before = F.regexp_replace(F.substr("text", F.lit(1), F.col("start")), CITATION_NUMBERS, " ")
    found = F.regexp_extract_all(before, F.lit(r"(?U)\w+"), F.lit(0))
    last = T.let(found, lambda w: F.slice(w, F.greatest(F.size(w) - words + 1, F.lit(1)), F.lit(words)))
    rows = citations.join(paras.select("doc_id", "para_idx", "text"), ["doc_id", "para_idx"])
    return rows.select("doc_id", "pos", F.array_join(last, " ").alias("context"))


def citation_context_changes(base: DataFrame, new: DataFrame) -> DataFrame:
    """Citations present in both versions that now follow other words."""
    a = base.select("doc_id", "pos", F.col("context").alias("before"))
    b = new.select("doc_id", "pos", F.col("context").alias("after"))
    return a.join(b, ["doc_id", "pos"]).where(F.col("before") != F.col("after"))


def formatting_delta(pairs: DataFrame) -> DataFrame:
    """Flags lost or gained on every unchanged visible token of (id, old, new, old_spans, new_spans): (id, pos, token, lost, gained).

    A token has the flags of its first character.
    """
    moved = pairs.where((F.col("old") != F.col("new")) | (F.col("old_spans") != F.col("new_spans")))
    carried = ("old", "old_spans", "new_spans")
    core = materialise(A.cores(_tokenised(moved, TOKEN, *carried), *carried, lead=True), "tokens")
    # matched tokens are those of the head, of the chain and of the tail; all of it is inside the row
    rows = A.aligned(core).withColumn("t", A.tokens("old", TOKEN))
    rows = rows.select("*", A.offsets("t").alias("_t"), A.offsets("y").alias("_y"))
    tail, shift = F.col("head") + F.size("x"), F.get("_y", F.size("y")) - (F.get("_t", F.col("head") + F.size("x")) - F.col("lead"))
    place = lambda k, at: F.struct(F.get("t", k).alias("token"), F.get("_t", k).alias("pos"), at.alias("at"))
    places = lambda start, size: F.when(size > 0, F.sequence(start, start + size - 1)).otherwise(F.array().cast("array<int>"))
    kept = F.concat(
        F.transform(places(F.lit(0), F.col("head")), lambda k: place(k, F.get("_t", k))),
        F.transform("m", lambda code: place(A.places(code)[0] + F.col("head"), F.get("_y", A.places(code)[1]) + F.col("lead"))),
        F.transform(places(tail, F.size("t") - tail), lambda k: place(k, F.get("_t", k) + shift)))
    kept = rows.select("id", "old_spans", "new_spans", F.explode_outer(F.filter(kept, lambda k: F.trim(k["token"]) != "")).alias("k")).where("k IS NOT NULL").select(
        "id", "old_spans", "new_spans", "k.*")
    had, has = A.flags_at(F.col("old_spans"), F.col("pos")), A.flags_at(F.col("new_spans"), F.col("at"))
    kept = kept.select("id", "pos", "token", F.array_sort(F.array_except(had, has)).alias("lost"), F.array_sort(F.array_except(has, had)).alias("gained"))
    return kept.where((F.size("lost") > 0) | (F.size("gained") > 0))


def picture_set_check(base: DataFrame, new: DataFrame, swaps: DataFrame, removed: DataFrame) -> DataFrame:
    """Pictures of the new version against the base after declared removals and swaps.

    ``base``/``new(doc_id, pos, name, digest)``, ``swaps(doc_id, old_name, new_name, digest)``,
    ``removed(doc_id, name, digest)``. The first matching picture of a removal goes.
    """
    copies = Window.partitionBy("doc_id", "name", "digest").orderBy("pos")
    drops = removed.groupBy("doc_id", "name", "digest").agg(F.count("*").alias("drop"))
    left = base.withColumn("copy", F.row_number().over(copies)).join(drops, ["doc_id", "name", "digest"], "left").where(
        F.col("drop").isNull() | (F.col("copy") > F.col("drop")))
    order = Window.partitionBy("doc_id").orderBy("pos")
    once = Window.partitionBy("doc_id", "name")
    left = left.withColumn("rank", F.row_number().over(order)).withColumn("same_name", F.count("*").over(once))
    change = swaps.select("doc_id", F.col("old_name").alias("name"), "new_name", F.col("digest").alias("new_digest"))
    want = left.join(change, ["doc_id", "name"], "left").withColumn(
        "swap", F.col("new_name").isNotNull() & (F.col("same_name") == 1)).select(
        "doc_id", "rank", F.when(F.col("swap"), F.col("new_name")).otherwise(F.col("name")).alias("want"),
        F.when(F.col("swap"), F.col("new_digest")).otherwise(F.col("digest")).alias("want_digest"))
    got = new.withColumn("rank", F.row_number().over(order)).select("doc_id", "rank", F.col("name").alias("got"), F.col("digest").alias("got_digest"))
    both = want.join(got, ["doc_id", "rank"], "full")
    problem = (F.when(~F.col("want").eqNullSafe(F.col("got")), "picture order")
               .when(F.col("want_digest").isNotNull() & F.col("got_digest").isNull(), "image does not resolve")
               .when(F.col("want_digest") != F.col("got_digest"), "image bytes differ"))
    return both.select("doc_id", "rank", "want", "got", problem.alias("problem")).where("problem IS NOT NULL")


def minimality(replacements: DataFrame) -> DataFrame:
    """Replacements (id, old, new) of several words that share their first or last word."""
    words = lambda c: F.regexp_extract_all(c, F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0))
    rows = replacements.select("id", "old", "new", words("old").alias("a"), words("new").alias("b"))
    same = lambda i: F.try_element_at("a", F.lit(i)) == F.try_element_at("b", F.lit(i))
    return rows.where((F.size("a") > 1) & (F.size("b") > 0) & (same(1) | same(-1))).select("id", "old", "new")


FIELD_OPEN, FIELD_CLOSE = "\ue000", "\ue001"


def view_compare(pairs: DataFrame) -> DataFrame:
    """identical, identical_except_field_results, or different, for (id, marked, actual).

    ``marked`` carries field results between private-use marks. The literal pieces between fields
    must occur in order with gaps that a field result can explain.
    """
    norm = lambda c: F.btrim(F.regexp_replace(F.regexp_replace(c, "[\u00ad\u200b\ufeff\ufffc]", ""), r"(?U)\s+", " "))
    rows = pairs.select("id", norm(F.col("marked")).alias("m"), norm(F.col("actual")).alias("got"))
    plain = norm(F.translate("m", FIELD_OPEN + FIELD_CLOSE, ""))
    literals = F.transform(F.split(F.regexp_replace("m", f"{FIELD_OPEN}[^{FIELD_CLOSE}]*{FIELD_CLOSE}", T.MATCH_MARK),
                                   T.MATCH_MARK, -1), lambda p: norm(p))
    fields = F.transform(F.regexp_extract_all("m", F.lit(f"{FIELD_OPEN}([^{FIELD_CLOSE}]*){FIELD_CLOSE}"), F.lit(1)), lambda p: norm(p))

    def step(acc, piece):
        at = F.instr(F.substr(F.col("got"), acc["pos"] + 1), piece["text"])
        gap = F.btrim(F.substr("got", acc["pos"] + 1, at - 1))
        fits = F.when(piece["first"], gap == "").otherwise(F.length(gap) <= 2 * F.length(piece["wanted"]) + 100)
        ok = acc["ok"] & (at > 0) & fits
        return F.struct(
            ok.alias("ok"), F.when(piece["text"] == "", acc["pos"]).otherwise(acc["pos"] + at - 1 + F.length(piece["text"])).alias("pos"),
            F.when(piece["text"] == "", acc["last_wanted"]).otherwise("").alias("last_wanted"))

    pieces = F.transform(literals, lambda p, i: F.struct(
        p.alias("text"), (i == 0).alias("first"), F.coalesce(F.get(fields, i - 1), F.lit("")).alias("wanted")))
    start = F.struct(F.lit(True).alias("ok"), F.lit(0).alias("pos"), F.lit("").alias("last_wanted"))
    folded = F.aggregate(F.filter(pieces, lambda p: p["text"] != ""), start, step)
    ends_in_field = F.col("m").endswith(FIELD_CLOSE)
    rest = F.btrim(F.substr("got", folded["pos"] + 1, F.length("got")))
    tail = F.when(ends_in_field, F.length(rest) <= 2 * F.length(F.coalesce(F.try_element_at(fields, F.lit(-1)), F.lit(""))) + 100).otherwise(rest == "")
    status = (F.when(plain == F.col("got"), "identical").when((F.size(fields) > 0) & folded["ok"] & tail, "identical_except_field_results")
              .otherwise("different"))
    return rows.select("id", status.alias("status"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Keys changed, added or removed between two snapshots."""
    a = before.select(key, F.col(value).alias("old"), F.lit(True).alias("_a"))
    b = after.select(key, F.col(value).alias("new"), F.lit(True).alias("_b"))
    kind = (F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed")
            .when(~F.col("old").eqNullSafe(F.col("new")), "changed"))
    return a.join(b, key, "full").select(key, kind.alias("kind"), "old", "new").where("kind IS NOT NULL")


def lockstep_check(members: DataFrame, group: str, version: str) -> DataFrame:
    """Groups whose members do not share one version."""
    return members.groupBy(group).agg(F.count_distinct(version).alias("versions"), F.min(version).alias("least"),
                                      F.max(version).alias("greatest")).where("versions > 1")


def major_change(old, new) -> Column:
    """Do both versions start with a number, and with different ones?"""
    lead = lambda c: F.regexp_extract(T._col(c), r"^(\d+)", 1).try_cast("bigint")
    return F.coalesce(lead(old) != lead(new), F.lit(False))


def dependents(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """Named items that exist plus items that require one of them; extras are ignored.

    ``items(name, requires array<string>)``, ``wanted(name)``.
    """
    norm = lambda c: F.regexp_replace(F.lower(c), "[-_.]+", "-")
    names = wanted.select(norm(F.col("name")).alias("key")).distinct()
    keyed = items.select(norm(F.col("name")).alias("item"), "requires")
    direct = keyed.select("item").join(names, F.col("item") == F.col("key"), "left_semi")
    need = keyed.select("item", F.explode("requires").alias("r"))
    need = need.where(~F.substring_index("r", ";", -1).rlike(r"\bextra\b") | ~F.col("r").contains(";")).select(
        "item", norm(F.regexp_extract("r", r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)", 1)).alias("key"))
    return direct.unionByName(need.join(names, "key", "left_semi").select("item")).distinct()


def check_rollup(checks: DataFrame) -> DataFrame:
    """FAIL when any check failed, with counts by status: (doc_id, name, status)."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    return checks.groupBy("doc_id").agg(
        F.when(F.bool_or(F.col("status") == "FAIL"), "FAIL").otherwise("PASS").alias("overall"),
        n("PASS"), n("WARN"), n("FAIL"))


def untracked_formatting(base: DataFrame, new: DataFrame) -> DataFrame:
    """Paragraphs equal in the rejected text but not in character flags or paragraph properties.

    ``(doc_id, view_idx, text, flags array<string>, props struct)``.
    """
    a = base.select("doc_id", "view_idx", "text", F.col("flags").alias("f0"), F.col("props").alias("p0"))
    b = new.select("doc_id", "view_idx", "text", F.col("flags").alias("f1"), F.col("props").alias("p1"))
    moved = F.array_sort(F.array_union(F.array_except("f0", "f1"), F.array_except("f1", "f0")))
    return a.join(b, ["doc_id", "view_idx", "text"]).select(
        "doc_id", "view_idx", moved.alias("flags"), (~F.col("p0").eqNullSafe(F.col("p1"))).alias("props_changed")).where(
        (F.size("flags") > 0) | F.col("props_changed"))


def intended_replacements(docs: DataFrame) -> DataFrame:
    """Applying each intended replacement once must give the new text: (doc_id, old, new, intended array).

    ``intended`` holds (old, new) structs in order; each old text must occur exactly once by then, so an empty one counts as not found.
    """
    def step(acc, item):
        # an empty old text is found nowhere, and without the test it would be divided by
        count = F.when(F.length(item["old"]) > 0, (F.length(acc["text"]) - F.length(F.replace(acc["text"], item["old"], F.lit("")))) / F.length(item["old"]))
        return F.struct(
            F.when(count == 1, F.replace(acc["text"], item["old"], item["new"])).otherwise(acc["text"]).alias("text"),
            (acc["missing"] + F.when(count == 1, 0).otherwise(1)).alias("missing"))

    start = F.struct(F.col("old").alias("text"), F.lit(0).alias("missing"))
    rows = docs.withColumn("r", F.aggregate("intended", start, step))
    return rows.select("doc_id", F.col("r.missing").alias("not_found_once"),
                       ((F.col("r.missing") == 0) & (F.col("r.text") == F.col("new"))).alias("as_intended"))


def new_revisions(base: DataFrame, new: DataFrame, author: str | None = None) -> DataFrame:
    """Revisions absent from the base, summed per document: (doc_id, kind, author, date, rev_id).

    Property changes and dates count only when (author, date) is new; an earlier author is expected.
    """
    keys = ["doc_id", "kind", "author", "date", "rev_id"]
    fresh = new.join(base, keys, "left_anti")
    pairs = base.select("doc_id", "author", "date", F.lit(True).alias("known_pair")).distinct()
    people = base.select("doc_id", "author", F.lit(True).alias("known_author")).distinct()
    rows = fresh.join(pairs, ["doc_id", "author", "date"], "left").join(people, ["doc_id", "author"], "left")
    unknown = F.col("known_author").isNull() & (F.lit(author is not None) & (F.col("author") != F.lit(author or "")))
    unseen = F.col("known_pair").isNull()
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("revisions"), F.count_if(unknown).alias("unexpected_author"),
        F.count_if(F.col("kind").endswith("Change") & unseen).alias("property_changes"),
        F.count_distinct(F.when(unseen, F.col("date"))).alias("dates"))

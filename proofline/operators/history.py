"""Histories, integrity of manifests, archives, threads, generated blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions import text as T
from proofline.functions.ordered import previous_value, table_row_numbers
from proofline.session import materialise

# Event kinds of an asset history.
INITIAL = ("registered", "imported")
CHECKS = ("checked", "check_failed")
CHANGES = ("edited", "updated", "merged")
DIGEST = r"^[0-9a-f]{64}$"
COMMIT = r"^[0-9a-f]{40}([0-9a-f]{24})?$"


def history_fold(events: DataFrame, key: str = "asset", at: str = "utc", order: str = "seq") -> DataFrame:
    """Folded state of each asset from its events.

    ``events(asset, seq, utc, event, result, content_sha256)``. Only aggregates: a hot asset is
    combined on the map side and never sorted.
    """
    kind = F.col("event")
    last = lambda cond, value: F.max_by(value, F.when(cond, F.col(order)))
    when = lambda cond: F.max(F.when(cond, F.col(at)))
    return events.groupBy(key).agg(
        F.min_by(at, order).alias("added_at"),
        F.min(F.when(kind == "imported", F.col(at))).alias("first_imported_at"),
        when(kind.isin(*CHECKS)).alias("last_check_attempt_at"),
        when(kind == "checked").alias("last_checked_at"),
        when(kind.isin(*CHANGES)).alias("last_updated_at"),
        last(kind.isin(*CHECKS), "result").alias("last_result"),
        last(kind.isin(*INITIAL, *CHANGES), "content_sha256").alias("content_sha256"))


def history_errors(events: DataFrame, states: DataFrame, chunk: Column, key: str = "asset") -> DataFrame:
    """What is wrong with each asset's history, one row per problem kind.

    ``chunk`` rises with ``seq`` inside an asset; the order check carries one row per chunk, so one
    asset with most of the events does not become one task. ``states`` are the stored folded fields.
    """
    rows = events.withColumn("_chunk", chunk)
    rows = previous_value(rows, [key], "_chunk", ["seq"], F.struct("utc"), "_before")
    kind = F.col("event")
    first = F.col("_before").isNull()
    is_check = kind == "checked"
    good_check = (F.col("status").isin("current", "update_available") & F.col("commit").rlike(COMMIT)
                  & F.col("sha256").rlike(DIGEST))
    problems = F.array_compact(F.array(
        F.when(~kind.isin(*INITIAL, *CHECKS, *CHANGES), "invalid event"),
        F.when(first & ~kind.isin(*INITIAL), "history does not start with a registration"),
        F.when(~first & kind.isin(*INITIAL), "registration repeated"),
        F.when(F.col("utc") < F.col("_before.utc"), "not chronological"),
        F.when(is_check & ~F.coalesce(good_check, F.lit(False)), "check without a complete result"),
        F.when((kind == "check_failed") & ~F.coalesce((F.col("status") == "error") & (F.col("error") != ""), F.lit(False)),
               "failed check without an error"),
        F.when(kind.isin(*INITIAL, *CHANGES) & ~F.coalesce(F.col("content_sha256").rlike(DIGEST), F.lit(False)),
               "content event without a digest")))
    found = rows.select(key, F.explode(problems).alias("problem"))
    fold = history_fold(events.withColumn("result", F.col("status")), key)
    fields = [c for c in states.columns if c != key]
    compared = states.select(key, F.struct(*fields).alias("stored")).join(
        fold.select(key, F.struct(*fields).alias("folded")), key)
    differs = compared.where(~F.col("stored").eqNullSafe(F.col("folded"))).select(
        key, F.lit("stored state disagrees with history").alias("problem"))
    return found.unionByName(differs).groupBy(key, "problem").agg(F.count("*").alias("n"))


def asset_status(assets: DataFrame, observed: DataFrame, checks: DataFrame) -> DataFrame:
    """Upstream and local state: ``assets(asset, origin, content_sha256, source_sha256)``,
    ``observed(asset, sha256)``, ``checks(asset, status, sha256)``."""
    rows = assets.join(observed.select("asset", F.col("sha256").alias("here")), "asset", "left").join(
        checks.select("asset", "status", F.col("sha256").alias("there")), "asset", "left")
    upstream = (F.when(F.col("status") == "error", "error")
                .when(F.col("status").isNotNull(), F.when(F.col("there") == F.col("source_sha256"), "current")
                      .otherwise("update_available"))
                .when(F.col("origin") == "local", "local").otherwise("never_checked"))
    local = (F.when(F.col("here").isNull(), "missing").when(F.col("here") != F.col("content_sha256"), "unrecorded")
             .when(F.col("here") != F.col("source_sha256"), "customized").otherwise("recorded"))
    return rows.select("asset", "origin", upstream.alias("upstream"), local.alias("local"))


def tracking_errors(registered: DataFrame, folders: DataFrame) -> DataFrame:
    """Registered without folder, folder without record, or changed content: (asset, sha256) both."""
    a = registered.select("asset", F.col("sha256").alias("recorded"), F.lit(True).alias("_r"))
    b = folders.select("asset", F.col("sha256").alias("found"), F.lit(True).alias("_f"))
    problem = (F.when(F.col("_r").isNull(), "no record").when(F.col("_f").isNull(), "no folder")
               .when(F.col("recorded") != F.col("found"), "unrecorded changes"))
    return a.join(b, "asset", "full").select("asset", problem.alias("problem")).where("problem IS NOT NULL")


LEDGER_KEY = ("event", "version", "reason", "figure", "figure_version")


def open_operations(ledger: DataFrame) -> DataFrame:
    """Interrupted operations, and failed ones that no later completion of the same key follows.

    ``ledger(pos, seq, event, status, ref, version, reason, figure, figure_version)``; ``pos`` is the
    log position. Missing equals missing in the key. The last completion per key is an aggregate, so
    a key with very many events costs one combined row.
    """
    answered = ledger.where(F.col("status").isin("complete", "failed") & F.col("ref").isNotNull()).select(
        "event", F.col("ref").alias("seq")).distinct()
    pending = ledger.where("status = 'pending'").join(answered, ["event", "seq"], "left_anti")
    done = ledger.where("status = 'complete'").groupBy(*LEDGER_KEY).agg(F.max("pos").alias("_done"))
    failed = ledger.where("status = 'failed'").alias("f")
    same = None
    for k in LEDGER_KEY:
        cond = F.col(f"f.{k}").eqNullSafe(F.col(f"d.{k}"))
        same = cond if same is None else same & cond
    still = failed.join(done.alias("d"), same & (F.col("d._done") > F.col("f.pos")), "left_anti")
    return pending.select(*ledger.columns, F.lit("interrupted").alias("issue")).unionByName(
        still.select(*ledger.columns, F.lit("failed").alias("issue")))


def manifest_verify(named: DataFrame, observed: DataFrame) -> DataFrame:
    """Missing, mismatched and unlisted files: ``named(path, sha256)``, ``observed(path, sha256)``."""
    want = named.where(F.coalesce("path", F.lit("")) != "").select("path", F.col("sha256").alias("expected")).distinct()
    got = observed.select("path", F.col("sha256").alias("found"), F.lit(True).alias("_here"))
    missing = (F.when(F.col("_here").isNull(), "missing")
               .when(F.col("expected").isNotNull() & (F.col("found") != F.col("expected")), "mismatched"))
    checked = want.join(got, "path", "left").select("path", "expected", "found", missing.alias("problem"))
    unlisted = got.join(want.select("path"), "path", "left_anti").select(
        "path", F.lit(None).cast("string").alias("expected"), "found", F.lit("unlisted").alias("problem"))
    return checked.where("problem IS NOT NULL").unionByName(unlisted)


def manifest_verdict(problems: DataFrame) -> DataFrame:
    bad = F.col("problem").isin("missing", "mismatched")
    return problems.agg(F.when(F.coalesce(F.bool_or(bad), F.lit(False)), "FAIL").otherwise("PASS").alias("status"),
                        F.count("*").alias("problems"))


def find_twins(files: DataFrame) -> DataFrame:
    """For each file the preferred other file with the same digest: (path, sha256, preference).

    The two best paths per digest are enough to answer every member, so a digest shared by a third
    of all files is two aggregated values, never a list or a pair join.
    """
    rank = F.struct("preference", "path")
    best = files.groupBy("sha256").agg(F.min(rank).alias("first"), F.count("*").alias("copies"))
    second = files.join(best.select("sha256", "first"), "sha256").where(rank != F.col("first")).groupBy("sha256").agg(
        F.min(rank).alias("second"))
    twins = best.where("copies > 1").join(second, "sha256").select("sha256", "first", "second")
    twin = F.when(F.col("first.path") == F.col("path"), F.col("second.path")).otherwise(F.col("first.path"))
    return files.join(twins, "sha256").select("path", "sha256", twin.alias("twin"))


def index_disagreements(index: DataFrame, versions: DataFrame, package: DataFrame) -> DataFrame:
    """Where three indexes disagree about the current file of a project.

    ``index(project, version, sha256, path)``, ``versions(project, role, sha256, path)``,
    ``package(project, role, version, sha256)``.
    """
    marked = versions.where("role = 'current'").groupBy("project").agg(
        F.count("*").alias("marked"), F.min("sha256").alias("m_sha"), F.min("path").alias("m_path"))
    pack = package.groupBy("project").agg(
        F.min("version").alias("p_version"), F.min(F.when(F.col("role") == "current", F.col("sha256"))).alias("p_sha"))
    rows = index.join(marked, "project", "full").join(pack, "project", "left")
    has = F.coalesce("sha256", F.lit("")) != ""
    problems = F.array_compact(F.array(
        F.when(has & ~F.coalesce((F.col("marked") == 1) & (F.col("m_sha") == F.col("sha256"))
                                 & (F.lower("m_path") == F.lower("path")), F.lit(False)), "version index"),
        F.when(~has & (F.col("marked") > 0), "no current file named"),
        F.when(has & F.col("p_version").isNotNull() & ~F.col("p_version").eqNullSafe(F.col("version")), "package version"),
        F.when(has & (F.col("p_sha") != F.col("sha256")), "package copy")))
    return rows.select("project", F.explode(problems).alias("problem"))


def next_number(claims: DataFrame, released: DataFrame) -> DataFrame:
    """Next free number per project over claimed and released numbers: (project, number)."""
    both = claims.select("project", "number").unionByName(released.select("project", "number"))
    return both.groupBy("project").agg((F.max("number") + 1).alias("next"), F.count_distinct("number").alias("taken"))


def protected_refs(indexes: DataFrame) -> DataFrame:
    """Every path-like string anywhere in JSON index texts: (project, body) -> (project, key, path).

    String values are told from object keys by the colon that follows a key.
    """
    strings = F.regexp_extract_all("body", F.lit(r'"(?:[^"\\]|\\.)*"(?:\s*:)?'), F.lit(0))
    values = F.filter(strings, lambda v: ~v.endswith(":"))
    rows = indexes.select("project", F.explode(values).alias("raw"))
    rows = rows.select("project", F.get_json_object(F.concat(F.lit('{"v":'), "raw", F.lit("}")), "$.v").alias("path"))
    like = F.col("path").rlike(r"[/\\.]")
    return rows.where(like).groupBy("project", normal_path("path").alias("key")).agg(F.min("path").alias("path"))


def normal_path(path) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.translate(T._col(path), "\\", "/"), r"^(?:\./)+", ""), "/+$", ""))


def ancestors(path: Column) -> Column:
    """Every folder above a path."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(
        F.array().cast("array<string>"))


def archive_plan(candidates: DataFrame, protected: DataFrame) -> DataFrame:
    """Reject candidates that are referenced, contain a referenced path, or overlap an earlier candidate.

    ``candidates(project, ord, path)``, ``protected(project, key)``. Containment is an equality join
    on exploded ancestor folders (a path has few), never a prefix comparison of all pairs.
    """
    rows = candidates.withColumn("key", normal_path("path"))
    keys = protected.select("project", "key").distinct()
    named = rows.join(keys, ["project", "key"], "left_semi").select("project", "ord", F.lit("named by an index").alias("problem"))
    above = keys.select("project", F.explode(ancestors(F.col("key"))).alias("key")).distinct()
    holds = rows.join(above, ["project", "key"], "left_semi").select("project", "ord", F.lit("contains a named path").alias("problem"))
    blocked = named.unionByName(holds).groupBy("project", "ord").agg(F.max("problem").alias("problem"))
    undecided = materialise(rows.join(blocked.select("project", "ord"), ["project", "ord"], "left_anti").select(
        "project", "ord", "key"), "archive-open")
    overlap = []
    # in request order: a path goes in unless an earlier accepted one overlaps it. Each round settles
    # every path whose earlier overlaps are settled, so rounds follow the nesting depth of the paths.
    while not undecided.isEmpty():
        accepted = materialise(undecided.join(_overlapped(undecided, undecided), ["project", "ord"], "left_anti"),
                               "archive-accepted")
        rest = undecided.join(accepted.select("project", "ord"), ["project", "ord"], "left_anti")
        refused = materialise(rest.join(_overlapped(rest, accepted), ["project", "ord"], "left_semi"), "archive-refused")
        overlap.append(refused.select("project", "ord", F.lit("overlaps another path").alias("problem")))
        undecided = materialise(rest.join(refused.select("project", "ord"), ["project", "ord"], "left_anti"), "archive-open")
    for found in overlap:
        blocked = blocked.unionByName(found)
    return rows.join(blocked, ["project", "ord"], "left").select(
        "project", "ord", "path", F.coalesce("problem", F.lit("ok")).alias("result"))


def _overlapped(mine: DataFrame, others: DataFrame) -> DataFrame:
    """(project, ord) of rows that equal, contain or lie inside an earlier other path."""
    first = others.groupBy("project", "key").agg(F.min("ord").alias("first"))
    up = mine.select("project", "ord", F.explode(F.array_append(ancestors(F.col("key")), F.col("key"))).alias("key"))
    inside = up.join(first, ["project", "key"]).where("ord > first").select("project", "ord")
    above = others.select("project", "ord", F.explode(ancestors(F.col("key"))).alias("key")).groupBy(
        "project", "key").agg(F.min("ord").alias("first"))
    around = mine.join(above, ["project", "key"]).where("ord > first").select("project", "ord")
    return inside.unionByName(around).distinct()


def figure_status(figures: DataFrame, versions: DataFrame, pictures: DataFrame) -> DataFrame:
    """Is the promoted version's picture shown, else which other version is?

    ``figures(figure, current)``, ``versions(figure, version, ord, sha256)``, ``pictures(sha256)``.
    """
    shown = versions.join(pictures.select("sha256").distinct().withColumn("_in", F.lit(True)), "sha256", "left")
    mine = figures.join(versions.select("figure", F.col("version").alias("current"), F.col("sha256").alias("want"), F.lit(True).alias("_known")),
                        ["figure", "current"], "left")
    mine = mine.join(pictures.select(F.col("sha256").alias("want"), F.lit(True).alias("_match")).distinct(), "want", "left")
    other = shown.where("_in").join(figures, "figure").where(F.col("version") != F.col("current")).groupBy("figure").agg(
        F.min_by("version", "ord").alias("shown_version"))
    state = (F.when(F.col("_known").isNull(), "not registered").when(F.coalesce("want", F.lit("")) == "", "not recorded")
             .when(F.col("_match"), "match").otherwise("not_shown"))
    return mine.join(other, "figure", "left").select(
        "figure", "current", state.alias("state"), F.when(state == "not_shown", F.col("shown_version")).alias("shown_version"))


def threads(comments: DataFrame) -> DataFrame:
    """Top-level comments with their reply count and last reply: (doc_id, id, parent, done, author, date).

    A comment whose parent does not exist is top-level. Replies stay rows (``replies``); a thread of
    any length is an aggregate here.
    """
    ids = comments.select("doc_id", F.col("id").alias("parent"), F.lit(True).alias("_p"))
    placed = comments.join(ids, ["doc_id", "parent"], "left")
    top = placed.where(F.col("_p").isNull())
    per = placed.where("_p").groupBy("doc_id", F.col("parent").alias("id")).agg(
        F.count("*").alias("replies"), F.max("id").alias("last_reply"))
    return top.select("doc_id", "id", "author", "done").join(per, ["doc_id", "id"], "left").select(
        "doc_id", "id", "author", "done", F.coalesce("replies", F.lit(0)).alias("replies"), "last_reply")


def thread_ids(comments: DataFrame, roots: DataFrame) -> DataFrame:
    """Each root comment and every comment below it: (doc_id, id, parent), (doc_id, id).

    Links are doubled each round, so a chain of n replies takes log2(n) rounds, whatever its length. A round that
    reaches nothing new is the last one, so parents that form a cycle end too.
    """
    jump = comments.where("parent IS NOT NULL").select("doc_id", "id", F.col("parent").alias("up"))
    reach = roots.select("doc_id", F.col("id").alias("root"), "id")
    while not jump.isEmpty():
        below = jump.join(reach.select("doc_id", "root", F.col("id").alias("up")), ["doc_id", "up"]).select(
            "doc_id", "root", "id").distinct()
        fresh = materialise(below.join(reach, ["doc_id", "root", "id"], "left_anti"), "thread-fresh")
        if fresh.isEmpty():
            break
        reach = materialise(reach.unionByName(fresh), "thread-reach")
        jump = materialise(jump.join(jump.select("doc_id", F.col("id").alias("up"), F.col("up").alias("top")),
                                     ["doc_id", "up"]).select("doc_id", "id", F.col("top").alias("up")).distinct(), "thread-links")
    return reach


def thread_comments(comments: DataFrame) -> DataFrame:
    """Every comment with the top-level comment it hangs below: (doc_id, thread, ...all other columns of comments).

    A comment whose parent does not exist is top-level. Comments on a cycle of parents have no top and are left out.
    """
    ids = comments.select("doc_id", F.col("id").alias("parent")).distinct()
    top = comments.join(ids, ["doc_id", "parent"], "left_anti").select("doc_id", "id")
    below = thread_ids(comments, top).select("doc_id", F.col("root").alias("thread"), "id")
    return below.join(comments, ["doc_id", "id"])


#: Runs in a cell of the join of runs and ranges.
CELL = 64


def anchor_texts(runs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Text between the start and end markers of each comment: runs in order, paragraphs joined by a line break.

    ``runs(doc_id, para_idx, run_idx, text)``, ``ranges(doc_id, id, start_para, start_run, end_para,
    end_run)``, end exclusive; ranges of one id add up. A sweep over runs and markers in order turns both into numbers of runs; a range
    then meets the runs of the cells of CELL runs that it covers, so work grows with runs, ranges and what they hold, not with their product.
    """
    mark = lambda df, kind, para, run, *more: df.select("doc_id", F.col(para).alias("para_idx"), F.col(run).alias("run_idx"), F.lit(kind).alias("kind"), *more)
    none = F.lit(None)
    named = ranges.withColumn("range", F.monotonically_increasing_id())
    named = materialise(named, "ranges")
    sides = [mark(named, 0, f"{side}_para", f"{side}_run", "range", F.lit(side).alias("side"), none.cast("string").alias("text")) for side in ("start", "end")]
    events = mark(runs, 1, "para_idx", "run_idx", none.cast("bigint").alias("range"), none.cast("string").alias("side"), "text").unionByName(sides[0]).unionByName(sides[1])
    before = Window.partitionBy("doc_id").orderBy("para_idx", "run_idx", "kind").rowsBetween(Window.unboundedPreceding, -1)
    swept = materialise(events.withColumn("at", F.coalesce(F.sum("kind").over(before), F.lit(0))), "sweep")
    at = lambda side: F.min(F.when(F.col("side") == side, F.col("at"))).alias(side)
    spans = swept.where("kind = 0").groupBy("doc_id", "range").agg(at("start"), at("end")).where("end > start")
    cells = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / CELL), F.floor((F.col("end") - 1) / CELL))))
    cells = cells.join(named.select("range", "id"), "range").drop("range")
    held = swept.where("kind = 1").select("doc_id", "para_idx", "run_idx", "text", "at", F.floor(F.col("at") / CELL).alias("cell"))
    inside = held.join(cells, ["doc_id", "cell"]).where("start <= at AND at < end")
    per = inside.groupBy("doc_id", "id", "para_idx").agg(F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("run_idx", "text"))), lambda x: x["text"]), "").alias("t"))
    return per.groupBy("doc_id", "id").agg(F.btrim(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("para_idx", "t"))), lambda x: x["t"]), "\n")).alias("anchor"))


def lines_outside_blocks(docs: DataFrame, marker: str = "gen") -> DataFrame:
    """(doc_id, line_no, line) outside generated blocks delimited by start and end comments."""
    start, end = rf"^\s*<!-- {marker}:[a-z]+:start -->", rf"^\s*<!-- {marker}:[a-z]+:end -->"

    def step(acc, line):
        opens, closes = line.rlike(start), line.rlike(end)
        keep = ~opens & ~closes & ~acc["inside"]
        return F.struct(
            F.when(opens, True).when(closes, False).otherwise(acc["inside"]).alias("inside"),
            (acc["no"] + 1).alias("no"),
            F.when(keep, F.concat(acc["out"], F.array(F.struct(acc["no"].alias("line_no"), line.alias("line")))))
            .otherwise(acc["out"]).alias("out"))

    begin = F.struct(F.lit(False).alias("inside"), F.lit(1).alias("no"),
                     F.from_json(F.lit("[]"), "array<struct<line_no:int,line:string>>").alias("out"))
    kept = F.aggregate(F.split("text", "\n", -1), begin, step, lambda acc: acc["out"])
    return docs.select("doc_id", F.explode(kept).alias("k")).select("doc_id", "k.line_no", "k.line")


def stale_names(docs: DataFrame, name: str, marker: str = "gen") -> DataFrame:
    """Hand-written lines that still carry a name as a whole word."""
    import re
    pattern = rf"(?<![A-Za-z0-9]){re.escape(name)}(?![A-Za-z0-9])"
    return lines_outside_blocks(docs, marker).where(F.col("line").rlike(pattern))


def scrub_paths(text, roots: dict[str, str]) -> Column:
    """Replace machine folders (configuration: folder -> replacement) whatever their separators."""
    import re
    out = T._col(text)
    for root, replacement in roots.items():
        body = r"(?:\\\\|\\|/)".join(re.escape(p) for p in re.split(r"[\\/]+", root.rstrip("\\/")))
        out = F.regexp_replace(out, F.lit(body + r"(?![\w-])"), F.lit(replacement))
    return out


def unregistered_files(observed: DataFrame, known: DataFrame, current: DataFrame) -> DataFrame:
    """Files neither listed by path nor known by digest, flagged when newer than the current one.

    ``observed(project, path, sha256, modified)``, ``known(project, path, sha256)``, ``current(project, modified)``.
    """
    rows = observed.withColumn("key", normal_path("path"))
    listed = known.select("project", normal_path("path").alias("key"))
    fresh = rows.join(listed, ["project", "key"], "left_anti").join(
        known.select("project", "sha256"), ["project", "sha256"], "left_anti")
    now = current.select("project", F.col("modified").alias("now"))
    return fresh.join(now, "project", "left").select(
        "project", "path", F.coalesce(F.col("modified") > F.col("now"), F.lit(False)).alias("newer_than_current"))


def embedded_asset_check(wanted: DataFrame, parts: DataFrame, current: DataFrame) -> DataFrame:
    """Assets used in the current version must exist with the recorded digest.

    ``wanted(project, figure, version, target, sha256, used_in array)``, ``parts(project, target,
    sha256)``, ``current(project, version)``.
    """
    rows = wanted.join(current.select("project", F.col("version").alias("now")), "project").where(
        F.array_contains("used_in", F.col("now")))
    rows = rows.join(parts.select("project", "target", F.col("sha256").alias("found")), ["project", "target"], "left")
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("sha256"), "mismatched")
    return rows.select("project", "figure", "version", "target", problem.alias("problem")).where("problem IS NOT NULL")


def batch_rows(df: DataFrame, size: int, order: str) -> DataFrame:
    """Number rows in order and cut them into batches of a fixed size, without a single-task sort."""
    numbered = table_row_numbers(df, [order], "row_number")
    return numbered.withColumn("batch", F.ceil(F.col("row_number") / size))

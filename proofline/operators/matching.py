"""Text matching without cross joins: title match by inverted index, passage trace by word keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.functions import text as T
from proofline.session import materialise

# Words that carry no title information.
STOPWORDS = ("a an and are as at be by for from in into is it its of on or that the their this to was were with without "
             "within than via vs versus after before between among during under over").split()
MIN_PROBE_CHARS = 8   # fixed values: shortest passage that is looked for, fallback prefix
PREFIX_CHARS = 30
TITLE_THRESHOLD = 0.9


def title_words(title) -> Column:
    """Folded words of a title that carry information, repeats kept."""
    return F.filter(T.fold_tokens(title), lambda w: ~w.isin(STOPWORDS) & (F.length(w) > 1))


def title_coverage(title, text) -> Column:
    """Share of a title's words that occur in a text, to three places; NULL for a title without words."""
    def share(words):
        return T.let(F.array_distinct(T.fold_tokens(text)), lambda present: F.when(
            F.size(words) > 0,
            F.round(F.size(F.filter(words, lambda w: F.array_contains(present, w))) / F.size(words), 3)))
    return T.let(title_words(title), share)


def best_title_match(entries: DataFrame, records: DataFrame, threshold: float = TITLE_THRESHOLD) -> DataFrame:
    """The first record with the highest title coverage at or above the threshold, per entry.

    ``entries(entry_id, text)``, ``records(record_id, title)``; ids may be structs, and the least
    record id counts as first. A title of n words may miss floor((1 - threshold + 0.0005) n) of them,
    so indexing one more of its rarest distinct words loses no match. Candidates come from that
    index; only they are verified, by counting shared words instead of carrying texts around.
    """
    titles = records.select("record_id", title_words("title").alias("w")).where(F.size("w") > 0)
    words = titles.select("record_id", F.size("w").alias("n"), F.explode("w").alias("word")).groupBy(
        "record_id", "word").agg(F.count("*").alias("times"), F.first("n").alias("n"))
    present = entries.select("entry_id", F.explode(F.array_distinct(T.fold_tokens("text"))).alias("word"))
    # only words of some title matter: the entry side shrinks before anything is grouped or joined; its file is far smaller than its
    # rows (a dictionary of few words), so it must never be taken for small enough to broadcast
    present = materialise(present.join(words.select("word").distinct(), "word", "left_semi"), "title-words").hint("merge")
    frequency = present.groupBy("word").agg(F.count("*").alias("df"))
    ranked = words.join(frequency, "word", "left").groupBy("record_id").agg(
        F.first("n").alias("n"),
        F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word"))).alias("by_rarity"))
    misses = F.floor(F.col("n") * (1.0 - threshold + 0.0005)).cast("int")
    index = ranked.select("record_id", F.explode(F.slice("by_rarity", F.lit(1), misses + 1)).alias("k")).select(
        "record_id", F.col("k.word").alias("word"))
    candidates = present.join(index, "word").select("entry_id", "record_id").distinct()
    scored = (candidates.join(words, "record_id").join(present, ["entry_id", "word"])
              .groupBy("entry_id", "record_id").agg(F.sum("times").alias("hits"), F.first("n").alias("n")))
    coverage = F.round(F.col("hits") / F.col("n"), 3)
    good = scored.select("entry_id", "record_id", coverage.alias("coverage")).where(F.col("coverage") >= threshold)
    # combined on the map side, so an entry with very many candidates is never one sorted group
    best = good.groupBy("entry_id").agg(F.max("coverage").alias("coverage"))
    return good.join(best, ["entry_id", "coverage"]).groupBy("entry_id").agg(
        F.min("record_id").alias("record_id"), F.first("coverage").alias("coverage"))


def normalise_passage(text) -> Column:
    """White space collapsed, object and control marks dropped, special hyphens made plain."""
    out = F.regexp_replace(T._col(text), "[\u0001\u0002\u0005\u0007\u0013\u0014\u0015\u001f\u00ad\u200b\ufeff\ufffc]", "")
    out = F.regexp_replace(out, "[\u001e\u2011]", "-")
    return F.btrim(F.regexp_replace(out, r"(?U)\s+", " "))


def _inner_words(text: Column) -> Column:
    """Words of a passage that are whole inside any text containing it (not the first or last)."""
    parts = F.split(text, " ", -1)
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))


def reference_trace(probes: DataFrame, pages: DataFrame, probe_chars: int | None = None) -> DataFrame:
    """Where each passage occurs: full match, else its 30-character prefix, else none; "too short" below eight characters.

    With ``probe_chars``, only so many first characters of a passage are looked for.

    ``probes(probe_id, text)``, ``pages(page_id, text)``. A passage's interior words stand whole and
    in order wherever it occurs, so the longest run of up to three of them from the first 30
    characters is an exact key: pages emit only word runs that are keys, and ``contains`` verifies.
    Passages with no interior word use their first eight characters as key in the same way.
    Returns probe_id, match, page_id (one row per page; page_id NULL for none).
    """
    short = lambda c: F.left(c, F.lit(PREFIX_CHARS))
    whole = normalise_passage("text")
    every = probes.select("probe_id", (whole if probe_chars is None else F.btrim(F.left(whole, F.lit(probe_chars)))).alias("probe"))
    shaped = every.where(F.length("probe") >= MIN_PROBE_CHARS)
    head = F.when(F.length("probe") > PREFIX_CHARS, F.btrim(short(F.col("probe")))).otherwise(F.col("probe"))
    shaped = shaped.withColumn("head", head).withColumn("inner", _inner_words(F.col("head")))
    width = F.least(F.size("inner"), F.lit(3))
    # of all runs of that width, the longest in characters is the most selective
    runs = F.when(width > 0, F.transform(
        F.sequence(F.lit(1), F.size("inner") - width + 1),
        lambda i: F.array_join(F.slice("inner", i, width), " ")))
    longest = F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("run"))))["run"]
    shaped = shaped.withColumn("width", width).withColumn(
        "key", F.coalesce(longest, F.left("head", F.lit(MIN_PROBE_CHARS))))
    keyed = shaped.select("probe_id", "probe", "head", "width", "key")
    texts = pages.select("page_id", normalise_passage("text").alias("body"))
    keys = keyed.select("width", "key").distinct()
    words = F.split("body", " ", -1)
    grams = lambda n: F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: i + n - 1 <= F.size("w")),
        lambda i: F.array_join(F.slice("w", i, n), " "))
    by_words = texts.select("page_id", words.alias("w"))
    found = None
    for n in (1, 2, 3):
        emitted = by_words.select("page_id", F.explode(F.array_distinct(grams(n))).alias("key")).withColumn("width", F.lit(n))
        hit = emitted.join(keys.where(F.col("width") == n), ["width", "key"], "left_semi")
        found = hit if found is None else found.unionByName(hit)
    # adaptive execution drops a branch whose (broadcast) key side turns out empty
    letters = texts.select("page_id", F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(F.length("body") - MIN_PROBE_CHARS + 1, F.lit(1))),
        lambda i: F.substr("body", i, F.lit(MIN_PROBE_CHARS))))).alias("key")).withColumn("width", F.lit(0))
    found = found.unionByName(letters.join(keys.where("width = 0"), ["width", "key"], "left_semi"))
    pairs = materialise(found.join(keyed, ["width", "key"]).select("probe_id", "page_id", "probe", "head").distinct(),
                        "trace-pairs")
    checked = texts.join(pairs, "page_id").select(
        "probe_id", "page_id", F.col("body").contains(F.col("probe")).alias("full"),
        ((F.length("probe") > PREFIX_CHARS) & F.col("body").contains(F.col("head"))).alias("prefix")).where("full OR prefix")
    best = checked.groupBy("probe_id").agg(F.bool_or("full").alias("any_full"))
    kept = checked.join(best, "probe_id").where(F.col("full") | ~F.col("any_full"))
    placed = kept.select("probe_id", F.when(F.col("any_full"), "full").otherwise("prefix30").alias("match"), "page_id")
    missing = F.when(F.coalesce(F.length("probe"), F.lit(0)) < MIN_PROBE_CHARS, "too short").otherwise("none")
    return every.join(placed, "probe_id", "left").select("probe_id", F.coalesce("match", missing).alias("match"), "page_id")

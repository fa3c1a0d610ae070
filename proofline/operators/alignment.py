"""Which tokens of two versions are the same: a longest run of equal tokens in order, found inside the row or, for very long ones, by joins.

Each version of an id is an array of tokens. The common head and tail are cut off inside the row. Of what is left (the core) a longest chain
of equal pairs that rises in both versions is kept, so as many tokens as possible are matched and a token that moves unmatches no
other. Of several longest chains the least is taken. It is found inside the row, over rows of bits, without a list of the equal pairs
(a line of 500 words has 250,000 equal pairs of blanks). A core too large for that becomes rows: equal tokens of an id meet in a join. If it
has very many equal pairs it is first cut at the longest chain of tokens that occur once in both versions; where a stretch between two of them still
has too many (it repeats a few tokens for long), only pairs of near places are chained, so more may be reported as changed there.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from proofline.session import materialise

#: Equal pairs of a core that are chained at once.
MAX_PAIRS = 1 << 20
#: How far apart equal tokens may stand in a stretch that repeats a few tokens so often that their pairs exceed MAX_PAIRS.
BAND = 64
#: Cells (tokens of one version times tokens of the other) of a core that is aligned inside its row: a million tokens each.
MAX_CELLS = 1 << 40
#: Bits that are held at once while a core is aligned inside its row (64 MB), and again for the places of its tokens.
HELD_BITS = 1 << 29
#: A pair of places is one number: the old place in the high half, the new one in the low half.
_HALF = 1 << 32


def least_longest_chain(codes: np.ndarray) -> np.ndarray:
    """Of sorted pairs of places, a longest chain that rises in both, least in order; n log n."""
    firsts, seconds = (codes >> 32).tolist(), (codes & (_HALF - 1)).tolist()
    tops: list[int] = []                                 # negated: the largest second place from which a chain of k + 1 starts
    lengths = [0] * len(firsts)
    i = len(firsts)
    while i:
        j = i
        while j and firsts[j - 1] == firsts[i - 1]:
            j -= 1
        for k in range(j, i):                            # pairs of one first place, by rising second place, cannot follow each other
            at = bisect_left(tops, -seconds[k])
            lengths[k] = at + 1
            if at == len(tops):
                tops.append(-seconds[k])
            elif -seconds[k] < tops[at]:
                tops[at] = -seconds[k]
        i = j
    want, first, second, chain = len(tops), -1, -1, []
    for k, length in enumerate(lengths):
        if length == want and firsts[k] > first and seconds[k] > second:
            want, first, second = want - 1, firsts[k], seconds[k]
            chain.append(k)
    return codes[chain]


@F.pandas_udf(ArrayType(LongType()))
def _chains(codes: pd.Series) -> pd.Series:
    return codes.map(least_longest_chain)


def longest_chains(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, a, b) of one longest chain per keys that rises in a and in b."""
    code = F.col("a").cast("bigint") * _HALF + F.col("b")
    chained = pairs.groupBy(*keys).agg(_chains_input(code).alias("codes")).select(*keys, F.explode(_chains("codes")).alias("code"))
    return chained.select(*keys, F.shiftright("code", 32).cast("int").alias("a"), F.col("code").bitwiseAND(_HALF - 1).cast("int").alias("b"))


def _chains_input(code: Column) -> Column:
    return F.sort_array(F.collect_list(code))


def _gapped(rows: DataFrame, chain: DataFrame, keys: list[str], side: str) -> DataFrame:
    """Rows (keys, side, token) that the chain does not hold, with the number of chain rows before them as one more key."""
    own = chain.select(*keys, side, F.lit(1).alias("_m"))
    marked = rows.join(own, [*keys, side], "left").withColumn("gap", F.count("_m").over(Window.partitionBy(*keys).orderBy(side)))
    return marked.where("_m IS NULL").drop("_m")


def _near_pairs(left: DataFrame, right: DataFrame, keys: list[str], band: int = BAND) -> DataFrame:
    """(keys, a, b) of equal tokens whose places, counted from the start or from the end of the gap, lie at most ``band`` apart."""
    def near(order):
        placed = lambda df, side: df.withColumn(f"_{side}", F.row_number().over(Window.partitionBy(*keys).orderBy(order(side))))
        cell = F.floor(F.col("_a") / band).cast("int")
        cells = placed(left, "a").withColumn("_cell", F.explode(F.array(cell - 1, cell, cell + 1)))
        met = cells.join(placed(right, "b").withColumn("_cell", F.floor(F.col("_b") / band).cast("int")), [*keys, "token", "_cell"])
        return met.where(F.abs(F.col("_a") - F.col("_b")) <= band).select(*keys, "a", "b")
    return near(F.asc).union(near(F.desc)).distinct()


def _matched_rows(left: DataFrame, right: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """(keys, a, b) of the matched tokens of rows (keys, a, token) and (keys, b, token)."""
    once = lambda df, side: df.groupBy(*keys, "token").agg(F.count("*").alias(f"n{side}"), F.min(side).alias(side))
    both = materialise(once(left, "a").join(once(right, "b"), [*keys, "token"]), "tokens")
    weights = both.groupBy(*keys).agg(F.sum(F.col("na") * F.col("nb")).alias("_w"))
    large = materialise(weights.where(F.col("_w") > limit).drop("_w"), "tokens")
    if large.isEmpty():
        return longest_chains(left.join(right, [*keys, "token"]), keys)
    small = longest_chains(left.join(large, keys, "left_anti").join(right, [*keys, "token"]), keys)
    left, right = (materialise(df.join(large, keys, "left_semi"), "tokens") for df in (left, right))
    if "gap" in keys:                                    # few tokens, each very often
        return small.unionByName(longest_chains(_near_pairs(left, right, keys), keys))
    chain = materialise(longest_chains(both.where("na = 1 AND nb = 1").join(large, keys, "left_semi"), keys), "tokens")
    inner = _matched_rows(_gapped(left, chain, keys, "a"), _gapped(right, chain, keys, "b"), [*keys, "gap"], limit)
    return small.unionByName(chain).unionByName(inner.drop("gap"))


def cores(pairs: DataFrame, *more: str, lead: bool = False) -> DataFrame:
    """(id, head, x, y) of (id, x, y): what is left of two arrays of tokens behind a common head and before a common tail.

    ``more`` columns are carried along; ``lead`` adds the number of characters of the common head.
    """
    common = lambda a, b: F.coalesce(F.nullif(F.array_position(F.zip_with(a, b, lambda p, q: ~p.eqNullSafe(q)), True).cast("int"), F.lit(0)) - 1, F.size(a))
    rows = pairs.select("id", *more, "x", "y", common("x", "y").alias("head"))
    if lead:
        rows, more = rows.withColumn("lead", F.char_length(F.array_join(F.slice("x", F.lit(1), F.col("head")), ""))), (*more, "lead")
    rest = lambda c: F.slice(c, F.col("head") + 1, F.size(c) - F.col("head"))
    rows = rows.select("id", *more, "head", rest("x").alias("x"), rest("y").alias("y"))
    rows = rows.withColumn("_tail", common(F.reverse("x"), F.reverse("y")))
    return rows.select("id", *more, "head", *[F.slice(c, 1, F.size(c) - F.col("_tail")).alias(c) for c in ("x", "y")])


def least_longest_common(x, y, held: int = HELD_BITS) -> list[int]:
    """The least longest chain of equal pairs of two arrays as codes of places; a row of bits a token of x, so len(x) * len(y) / 64 steps.

    Row i tells, for every end of y, how many tokens x[i:] and that end have in common: the zeros among its lowest bits. Rows of more than
    ``held`` bits are not all held: some are, and the rows between two of them are made again when the chain gets there.
    """
    n, m, at = len(x), len(y), {}
    for b, token in enumerate(y):
        if token is None:                                # equals nothing, as in a join
            continue
        at.setdefault(token, []).append(b)
    full, masks = (1 << m) - 1, {}
    step = max(n, 1) if n * m <= held else max(isqrt(n), 1)

    def mask(token) -> int | None:
        if (made := masks.get(token)) is None and (places := at.get(token)) is not None:
            signs = bytearray(m // 8 + 1)
            for b in places:
                signs[m - 1 - b >> 3] |= 1 << (m - 1 - b & 7)
            made = int.from_bytes(signs, "little")
            if len(masks) * m <= held:
                masks[token] = made
        return made

    def rows_above(bits: int, first: int, last: int) -> list[int]:
        """Rows first to last, of which ``bits`` is the last one."""
        rows = [bits] * (last - first + 1)
        for i in range(last - 1, first - 1, -1):
            if (own := mask(x[i])) is not None:
                met = bits & own
                bits = (bits + met | bits & ~own) & full
            rows[i - first] = bits
        return rows

    starts = range(0, n, step)
    tops, rows = {n: full}, [full]
    for first in reversed(starts):
        rows = rows_above(tops[min(first + step, n)], first, min(first + step, n))
        tops[first] = rows[0]
    common = lambda row, b: m - b - (row & ((1 << (m - b)) - 1)).bit_count()
    want, start, chain = common(rows[0], 0), 0, []
    for first in starts:
        if not want:
            break
        last = min(first + step, n)
        if first:                                        # those of the first stretch were made last
            rows = rows_above(tops[last], first, last)
        for i in range(first, last):
            if not want:
                break
            places = at.get(x[i])
            if places is None or (k := bisect_left(places, start)) == len(places):
                continue
            if common(rows[i + 1 - first], places[k] + 1) == want - 1:      # the first equal token leaves most behind it
                chain.append(i * _HALF + places[k])
                want, start = want - 1, places[k] + 1
    return chain


@F.pandas_udf(ArrayType(LongType()))
def _common_chains(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([least_longest_common(p.tolist(), q.tolist()) for p, q in zip(x, y, strict=True)], index=x.index, dtype=object)


def matched_in_cores(core: DataFrame, limit: int = MAX_PAIRS, cells: int | None = None) -> DataFrame:
    """(id, a, b): places of matched tokens within the cores (id, head, x, y), counted from 0.

    ``limit`` bounds the equal pairs that are chained at once where a core has more than ``cells`` cells (by default MAX_CELLS, or
    ``limit`` if that is set lower).
    """
    cells = (MAX_CELLS if limit >= MAX_PAIRS else limit) if cells is None else cells
    core = core.where((F.size("x") > 0) & (F.size("y") > 0))
    fits = F.size("x").cast("bigint") * F.size("y") <= cells
    inside = core.where(fits).select("id", F.explode(_common_chains("x", "y")).alias("code")).select(
        "id", F.shiftright("code", 32).cast("int").alias("a"), F.col("code").bitwiseAND(_HALF - 1).cast("int").alias("b"))
    large = core.where(~fits)
    if large.isEmpty():
        return inside
    side = lambda c, name: large.select("id", F.posexplode(c).alias(name, "token"))
    return inside.unionByName(_matched_rows(side("x", "a"), side("y", "b"), ["id"], limit))


def aligned(core: DataFrame, limit: int = MAX_PAIRS) -> DataFrame:
    """The cores with the places of their matched tokens, sorted, as codes in one more column ``m``; no row moves unless a core is too large for its row."""
    fits = F.size("x").cast("bigint") * F.size("y") <= MAX_CELLS
    inside = core.where(fits).withColumn("m", _common_chains("x", "y"))
    large = core.where(~fits)
    if large.isEmpty():
        return inside
    return inside.unionByName(_with_places(large, matched_in_cores(large, limit)))


def _with_places(core: DataFrame, matched: DataFrame) -> DataFrame:
    held = matched.groupBy("id").agg(F.sort_array(F.collect_list(F.col("a").cast("bigint") * _HALF + F.col("b"))).alias("m"))
    return core.join(held, "id", "left").withColumn("m", F.coalesce("m", F.array().cast("array<bigint>")))


def places(code: Column) -> tuple[Column, Column]:
    """The two places of a code."""
    return F.shiftright(code, 32).cast("int"), code.bitwiseAND(_HALF - 1).cast("int")


def tokens(text: str, pattern: str) -> Column:
    """The matches of a pattern that covers every character."""
    return F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))


def _runs() -> Column:
    """Of an aligned core: runs of tokens between matched ones that differ, as places in the core."""
    def run(code, i):
        (a0, b0), (a1, b1) = places(F.get("m", i - 1)), places(code)
        return F.struct((F.when(i == 0, -1).otherwise(a0) + 1).alias("a0"), a1.alias("a1"), (F.when(i == 0, -1).otherwise(b0) + 1).alias("b0"), b1.alias("b1"))

    ends = F.size("x").cast("bigint") * _HALF + F.size("y")
    return F.filter(F.transform(F.concat("m", F.array(ends)), run), lambda r: (r["a1"] > r["a0"]) | (r["b1"] > r["b0"]))


def changed_runs(core: DataFrame, matched: DataFrame) -> DataFrame:
    """(id, a0, a1, b0, b1): runs of tokens between matched ones that differ, as places in the whole arrays; one row per id enters, no window."""
    rows = _with_places(core, matched).select("id", "head", F.explode(_runs()).alias("r"))
    return rows.select("id", *[(F.col(f"r.{c}") + F.col("head")).alias(c) for c in ("a0", "a1", "b0", "b1")])


@F.pandas_udf(ArrayType(IntegerType()))
def offsets(tokens: pd.Series) -> pd.Series:
    """The number of characters before each token, and after the last."""
    return tokens.map(lambda row: [0, *accumulate(map(len, row.tolist()))])


def changed_spans(core: DataFrame, *more: str) -> DataFrame:
    """(id, more, old_start, old_end, new_start, new_end): changed runs of the cores (with ``lead``) as characters of the whole texts; inside the row."""
    rows = aligned(core).select("id", *more, "lead", offsets("x").alias("_x"), offsets("y").alias("_y"), _runs().alias("r"))
    # not explode, whose filter of empty arrays would chain everything twice
    rows = rows.select("id", *more, "lead", "_x", "_y", F.explode_outer("r").alias("r")).where("r IS NOT NULL")
    at = lambda c, k: F.get(c, F.col(f"r.{k}")) + F.col("lead")
    return rows.select("id", *more, at("_x", "a0").alias("old_start"), at("_x", "a1").alias("old_end"), at("_y", "b0").alias("new_start"), at("_y", "b1").alias("new_end"))


def character_spans(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """(id, old_start, old_end, new_start, new_end) of runs of tokens; ``pairs`` has id and the arrays x and y."""
    at = lambda c, k: F.char_length(F.array_join(F.slice(c, F.lit(1), F.col(k)), ""))
    return runs.join(pairs.select("id", "x", "y"), "id").select(
        "id", at("x", "a0").alias("old_start"), at("x", "a1").alias("old_end"), at("y", "b0").alias("new_start"), at("y", "b1").alias("new_end"))


def join_close(changes: DataFrame) -> DataFrame:
    """Changes joined over short equal stretches, in one pass over (id, old_start, old_end, new_start, new_end, old).

    A stretch is short if it is no longer than either edit beside it (an edit's length is that of its longer side), or if it is one or
    two blanks between two replacements. Edits of blanks alone join nothing.
    """
    order = Window.partitionBy("id").orderBy("old_start", "new_start")
    size = F.greatest(F.col("old_end") - F.col("old_start"), F.col("new_end") - F.col("new_start"))
    both = (F.col("old_end") > F.col("old_start")) & (F.col("new_end") > F.col("new_start"))
    cut = lambda text, a, b: F.substr(F.col(text), F.col(a) + 1, F.col(b) - F.col(a))
    blank = (F.trim(cut("old", "old_start", "old_end")) == "") & (F.trim(cut("new", "new_start", "new_end")) == "")
    rows = changes.withColumns({"_size": size, "_both": both, "_blank": blank})
    gap = F.col("old_start") - F.lag("old_end").over(order)
    between = F.substr(F.col("old"), F.lag("old_end").over(order) + 1, gap)
    absorbed = (gap <= F.least(F.col("_size"), F.lag("_size").over(order))) & ~F.col("_blank") & ~F.lag("_blank").over(order)
    phrase = gap.between(1, 2) & (F.trim(between) == "") & F.col("_both") & F.lag("_both").over(order)
    rows = rows.withColumn("_joins", F.coalesce(absorbed | phrase, F.lit(False)))
    rows = rows.withColumn("_group", F.sum((~F.col("_joins")).cast("int")).over(order))
    return rows.groupBy("id", "_group").agg(*[f(c).alias(c) for f, c in ((F.min, "old_start"), (F.max, "old_end"), (F.min, "new_start"), (F.max, "new_end"))]).drop("_group")


def similar_paragraphs(old: DataFrame, new: DataFrame, share: float = 0.5) -> DataFrame:
    """(id, gap, a, b) of unmatched paragraphs (id, gap, pos, text) of one gap that are versions of each other.

    In order, each old paragraph takes the most alike of the new ones behind the last one taken (of equals, the last), if that is alike enough:
    twice the distinct words in common over the sum of both. Candidates share one of their rarest words of the gap: two
    paragraphs that are alike enough have at least share / (2 - share) of either's words in common, so a shared word stands among
    all but that many of either's rarest; no pair is missed, and no word has to be unique.
    """
    distinct = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))
    sides = old.select("id", "gap", "pos", F.lit(0).alias("side"), distinct.alias("words")).unionByName(new.select("id", "gap", "pos", F.lit(1).alias("side"), distinct.alias("words")))
    sides = materialise(sides, "paragraphs")
    each = sides.select("id", "gap", "side", "pos", F.size("words").alias("n"), F.explode("words").alias("word"))
    often = each.groupBy("id", "gap", "word").agg(F.count("*").alias("often"), F.count_distinct("side").alias("sides")).where("sides = 2").drop("sides")
    rank = F.row_number().over(Window.partitionBy("id", "gap", "side", "pos").orderBy("often", "word"))
    shared = F.count("*").over(Window.partitionBy("id", "gap", "side", "pos"))
    # words that the other side lacks are rarest of all and can be left out of the index, not out of the count
    needed = F.ceil(F.col("n") * (share / (2 - share)) - 1e-9)
    index = each.join(often, ["id", "gap", "word"]).withColumns({"rank": rank, "shared": shared}).where(F.col("rank") <= F.col("shared") - needed + 1)
    index = materialise(index.select("id", "gap", "side", "pos", "word"), "paragraphs")
    of = lambda k, name: index.where(F.col("side") == k).select("id", "gap", F.col("pos").alias(name), "word")
    candidates = of(0, "a").join(of(1, "b"), ["id", "gap", "word"]).select("id", "gap", "a", "b").distinct()
    words = lambda k, name: sides.where(F.col("side") == k).select("id", "gap", F.col("pos").alias(name), F.col("words").alias(f"w{name}"))
    scored = candidates.join(words(0, "a"), ["id", "gap", "a"]).join(words(1, "b"), ["id", "gap", "b"])
    score = 2 * F.size(F.array_intersect("wa", "wb")) / (F.size("wa") + F.size("wb"))
    scored = scored.select("id", "gap", "a", F.struct(score.alias("score"), "b").alias("c")).where(F.col("c.score") >= share)
    lists = scored.groupBy("id", "gap", "a").agg(F.collect_list("c").alias("c")).groupBy("id", "gap").agg(F.array_sort(F.collect_list(F.struct("a", "c"))).alias("rows"))

    def step(acc, row):
        best = F.array_max(F.filter(row["c"], lambda c: c["b"] >= acc["start"]))
        return F.struct(F.when(best.isNull(), acc["start"]).otherwise(best["b"] + 1).cast("int").alias("start"),
                        F.when(best.isNull(), acc["taken"]).otherwise(F.concat(acc["taken"], F.array(F.struct(row["a"].alias("a"), best["b"].alias("b"))))).alias("taken"))
    start = F.struct(F.lit(-1).alias("start"), F.array().cast("array<struct<a:int,b:int>>").alias("taken"))
    return lists.select("id", "gap", F.explode(F.aggregate("rows", start, step)["taken"]).alias("p")).select("id", "gap", "p.a", "p.b")


def flags_at(spans: Column, place: Column) -> Column:
    """The flags of the spans (start, end, flags) that hold a place."""
    return F.array_distinct(F.flatten(F.transform(F.filter(spans, lambda s: (s["start"] <= place) & (place < s["end"])), lambda s: s["flags"])))

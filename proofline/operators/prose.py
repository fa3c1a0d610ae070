"""Detection of formulaic prose. Detection only: nothing is rewritten.

Every rule of a line works on that line's own row: hits of all rules form one array, quotations and
lone weak hits are removed inside the row, and one explode ends the pass. No shuffle is needed until
hits are aggregated. Thresholds marked "ours" are our choice.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.functions import text as T
from proofline.functions.lexicon import HYPHENATED, LEXICON, QUALIFIERS, RIDERS, LexiconRule
from proofline.operators.units import paragraphs

EDGE_LEFT, EDGE_RIGHT = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
FRAGMENT_WORDS = 4      # ours: a fragment has at most four words
RUN_LENGTH = 3          # ours: three in a row make a run
WEAK_COMPANY = 2        # ours: a weak hit needs two other rules in the same paragraph
TITLE_CASE_SHARE = 0.6  # ours: share of capitalised long words in a heading

# -- patterns ----------------------------------------------------------------------------------
CONTRAST = (r"(?i)" + EDGE_LEFT + r"(?:not (?:just|only|merely|simply) [^.!?;]+[,;] ?but|"
            r"(?:it|this|that)(?:'s|’s| is) not (?:just |only |merely )?[^.!?]+[;,.] (?:it|this|that)(?:'s|’s| is)|"
            r"isn(?:'|’)t (?:just |only )?[^.!?;]+[,;] it(?:'|’)s|"
            r"does not mean [^.!?]+[.] it means|"
            r", no guessing)" + EDGE_RIGHT)
CONTRAST_OTHER = "不仅[^。！？]+而且|不仅仅是[^。！？]+而是"
TRIAD = r"(?i)[\p{L}-]+(?: [\p{L}-]+)?, [\p{L}-]+(?: [\p{L}-]+)?,? and [\p{L}-]+"
DASH = r"—|–| -- "
PASSIVE = r"(?i)" + EDGE_LEFT + r"(?:is|are|was|were|be|been|being) (?:[a-z]+ly )?[a-z]+(?:ed|en)" + EDGE_RIGHT
RIDER = r"(?i), (?:" + "|".join(RIDERS) + ")" + EDGE_RIGHT
BOLD = r"(?<!\*)\*\*[^*\s][^*]*\*\*(?!\*)"
INLINE_HEADER = r"^\s*[-*•] \*\*[^*]+(?::\*\*|\*\*:)"
CURLY = "[“”]"
COLON = r"[\p{Ll}]: [\p{Ll}]"
FALSE_RANGE = r"(?i)" + EDGE_LEFT + r"from [\p{L}' -]{2,} to [\p{L}]+" + EDGE_RIGHT
DECORATION = r"[→⇒\x{1F300}-\x{1FAFF}\x{2705}\x{2728}\x{26A0}]"
HYPHEN_AFTER = (r"(?i)" + EDGE_LEFT + "(?:" + "|".join(HYPHENATED) + r")(?=[.,;:!?]|$| (?:and|or|but)" + EDGE_RIGHT
                + ")")
QUOTED = "\"[^\"]*\"|“[^”]*”"

WEAK_RULES = ("prose.curly-quote", "prose.passive", "prose.hyphen-pair", "prose.dash", "prose.qualifier",
              *(r.rule for r in LEXICON if r.weak))


def phrase_pattern(phrases: Sequence[str], opens_sentence: bool = False, other_scripts: Sequence[str] = ()) -> str:
    """One case-insensitive alternation, longest phrase first, on word edges."""
    body = "|".join(
        re.escape(p).replace("\\ ", " ").replace("'", "['’]") + (EDGE_RIGHT if p[-1].isalnum() else "")
        for p in sorted(phrases, key=len, reverse=True))
    left = r"(?<=^|[.!?][\"'”’)]{0,2}\s{1,3})" if opens_sentence else EDGE_LEFT
    # a first-letter class ahead of the alternation rules out most word starts at once
    firsts = "".join(sorted({re.escape(p[0]) for p in phrases} | {re.escape(p[0].upper()) for p in phrases}))
    words = f"{left}(?=[{firsts}])(?:{body})"
    others = "|".join(re.escape(p) for p in sorted(other_scripts, key=len, reverse=True))
    return "(?i)" + (f"{words}|{others}" if others else words)


#: Capitals and the typographic apostrophe, each for one plain character, so places stay.
_PLAIN = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ’", "abcdefghijklmnopqrstuvwxyz'")
OPENS_SENTENCE = r"(?:^|[.!?][\"'”’)]{0,2}\s{1,3})$"


def trie_pattern(phrases: Sequence[str], edges: bool) -> str:
    """A pattern for the longest of the phrases at a place, as a trie: a beginning that many share is tried once."""
    root: dict = {}
    for phrase in phrases:
        node = root
        for letter in phrase:
            node = node.setdefault(letter, {})
        node[""] = EDGE_RIGHT if edges and phrase[-1].isalnum() else ""

    def written(node: dict) -> str:
        tail = ""
        while len(node) == 1 and "" not in node:         # an unbranched stretch
            letter, node = next(iter(node.items()))
            tail += re.escape(letter).replace("\\ ", " ")
        options = [re.escape(c).replace("\\ ", " ") + written(child) for c, child in sorted(node.items()) if c]
        if "" in node:
            options.append(node[""])                     # last, so that longer phrases go first
        return tail + (options[0] if len(options) == 1 else f"(?:{'|'.join(options)})")
    return written(root)


def _meanings(lexicon: Sequence[LexiconRule]) -> dict[str, list[tuple[str, int, bool, bool]]]:
    """For each phrase, of every rule the longest phrase that it begins with: (rule, length, weak, opens a sentence)."""
    found: dict[str, list] = {}
    for edges in (True, False):
        of_rule = [(r, {p.lower() if edges else p for p in (r.phrases if edges else r.other_scripts)}) for r in lexicon]
        for phrase in set().union(*(own for _, own in of_rule)) if of_rule else ():
            for r, own in of_rule:
                fits = [p for p in own if phrase.startswith(p) and (len(p) == len(phrase) or not (edges and p[-1].isalnum() and (phrase[len(p)].isalnum() or phrase[len(p)] == "_")))]
                if fits:
                    found.setdefault(phrase, []).append((r.rule, max(map(len, fits)), r.weak, r.opens_sentence and edges))
    return found


def phrase_hits(text: Column, lexicon: Sequence[LexiconRule]) -> Column:
    """Hits of all phrase rules in one pass over a line.

    One trie marks the longest phrase at every place; what it means to each rule is looked up; within a rule, hits do not overlap.
    """
    kind = "array<struct<rule:string,start:int,end:int,phrase:string,weak:boolean>>"
    words = sorted({p.lower() for r in lexicon for p in r.phrases})
    others = sorted({p for r in lexicon for p in r.other_scripts})
    if not words and not others:
        return F.array().cast(kind)
    either = [f"{EDGE_LEFT}{trie_pattern(words, True)}"] * bool(words) + [trie_pattern(others, False)] * bool(others)
    known = _meanings(lexicon)
    meaning = F.create_map(*[x for phrase, rules in known.items() for x in (F.lit(phrase), F.array(*[F.struct(
        F.lit(rule).alias("rule"), F.lit(size).alias("size"), F.lit(weak).alias("weak"), F.lit(opens).alias("opens")) for rule, size, weak, opens in rules]))])
    marked = F.regexp_replace(F.translate(T.without_marks(text), *_PLAIN), F.lit(f"(?=({'|'.join(either)}))"), F.lit(f"{T.MATCH_MARK}$1{T.GROUP_MARK}"))

    def place(acc, piece):
        phrase = F.substring_index(piece, T.GROUP_MARK, 1)
        return F.struct((acc["pos"] + F.length(piece) - F.length(phrase) - 1).alias("pos"), F.concat(acc["out"], F.array(F.struct(acc["pos"].alias("start"), phrase.alias("phrase")))).alias("out"))

    def apart(acc, hit):
        return F.when(F.exists(acc, lambda h: (h["rule"] == hit["rule"]) & (h["end"] > hit["start"])), acc).otherwise(F.concat(acc, F.array(hit)))

    def hits(pieces):
        start = F.struct(F.length(F.get(pieces, 0)).alias("pos"), F.array().cast("array<struct<start:int,phrase:string>>").alias("out"))
        places = F.aggregate(F.slice(pieces, 2, F.size(pieces)), start, place, lambda acc: acc["out"])
        found = F.flatten(F.transform(places, lambda p: F.transform(F.try_element_at(meaning, p["phrase"]), lambda m: F.struct(
            m["rule"].alias("rule"), p["start"].alias("start"), (p["start"] + m["size"]).alias("end"), F.substr(text, p["start"] + 1, m["size"]).alias("phrase"), m["weak"].alias("weak"), m["opens"].alias("opens")))))
        found = F.filter(found, lambda h: ~h["opens"] | F.substr(text, F.lit(1), h["start"]).rlike(OPENS_SENTENCE))
        found = F.transform(found, lambda h: F.struct(*[h[c].alias(c) for c in ("rule", "start", "end", "phrase", "weak")])).cast(kind)
        return F.when(F.size(pieces) > 1, F.aggregate(found, F.array().cast(kind), apart)).otherwise(F.array().cast(kind))
    return T.let(F.split(marked, T.MATCH_MARK, -1), hits)


def _hits(text: Column, rule: str, pattern: str, weak: bool = False, hints: tuple[str, ...] = ()) -> Column:
    return F.transform(T.spans(text, pattern, hints=hints), lambda s: F.struct(
        F.lit(rule).alias("rule"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("phrase"),
        F.lit(weak).alias("weak")))


def line_hits(text: str = "text", lexicon: Sequence[LexiconRule] = LEXICON) -> Column:
    """Hits of every rule that can be decided inside one line, unfiltered."""
    body = F.col(text)
    found = [
        _hits(body, "prose.contrast", CONTRAST + "|" + CONTRAST_OTHER, hints=("not ", "n't", "n’t", "no guessing", "不仅")),
        _hits(body, "prose.triad", TRIAD, hints=(" and ",)), _hits(body, "prose.dash", DASH, True, ("—", "–", " -- ")),
        _hits(body, "prose.hyphen-pair", HYPHEN_AFTER, True, ("-",)), _hits(body, "prose.passive", PASSIVE, True),
        _hits(body, "prose.rider", RIDER, hints=(", ",)), _hits(body, "prose.bold", BOLD, hints=("**",)),
        _hits(body, "prose.inline-header", INLINE_HEADER, hints=("**",)), _hits(body, "prose.curly-quote", CURLY, True, ("“", "”")),
        _hits(body, "prose.colon", COLON, hints=(": ",)), _hits(body, "prose.false-range", FALSE_RANGE, hints=("from ",)),
    ]
    return F.concat(*found, phrase_hits(body, lexicon))


def outside_quotes(hits: Column, text: str = "text") -> Column:
    """Drop hits that lie inside a quotation; curly-quote hits are about the marks themselves."""
    quotes = T.spans(F.col(text), QUOTED, hints=("\"", "“"))
    return T.let(quotes, lambda qs: F.filter(hits, lambda h: (h["rule"] == "prose.curly-quote") | ~F.exists(
        qs, lambda q: (q["start"] <= h["start"]) & (h["end"] <= q["end"]))))


def gate_weak(hits: Column) -> Column:
    """A weak hit stays only when enough other rules share its paragraph."""
    kinds = lambda hs: F.size(F.array_distinct(F.transform(hs, lambda h: h["rule"])))
    return T.let(hits, lambda hs: T.let(kinds(hs), lambda n: F.filter(
        hs, lambda h: ~h["weak"] | (n - 1 >= WEAK_COMPANY))))


def prose_hits(docs: DataFrame, lexicon: Sequence[LexiconRule] = LEXICON, gate: bool = True,
               exempt_quotes: bool = True) -> DataFrame:
    """One row per hit: doc_id, para_idx, rule, start, end, phrase, weak."""
    rows = paragraphs(docs).withColumn("hits", line_hits("text", lexicon))
    if exempt_quotes:
        rows = rows.withColumn("hits", outside_quotes(F.col("hits")))
    if gate:
        rows = rows.withColumn("hits", gate_weak(F.col("hits")))
    return rows.select("doc_id", "para_idx", F.explode("hits").alias("h")).select("doc_id", "para_idx", "h.*")


def with_replacements(hits: DataFrame, lexicon: Sequence[LexiconRule] = LEXICON) -> DataFrame:
    """Attach the plain replacement of a phrase, where its rule has one (fixed list)."""
    pairs = [F.lit(x) for r in lexicon for p, plain in r.replacements.items() for x in (p, plain)]
    return hits.withColumn("replacement", F.try_element_at(F.create_map(*pairs), F.lower("phrase")))


# -- rules over the sentences of a line --------------------------------------------------------

def _positions(size: Column, condition) -> Column:
    """0-based positions where a condition on the index holds."""
    last = F.greatest(size - 1, F.lit(0))
    return F.when(size > 0, F.filter(F.sequence(F.lit(0), last), condition)).otherwise(
        F.array().cast("array<int>"))


def run_starts(values: str, same, length: int = RUN_LENGTH) -> Column:
    """Positions where a run of at least ``length`` like values begins."""
    def begins(i):
        at = lambda k: F.get(values, i + k)
        ok = same(at(0), at(1))
        for k in range(2, length):
            ok = ok & same(at(0), at(k))
        return F.coalesce(ok & ~F.coalesce(same(F.get(values, i - 1), at(0)), F.lit(False)), F.lit(False))
    return _positions(F.size(values), begins)


def sentence_lines(docs: DataFrame) -> DataFrame:
    """Each line with its sentences, their word counts and first words."""
    rows = paragraphs(docs).select("doc_id", "para_idx", "text", T.sentences("text").alias("sentences"))
    return rows.withColumn("lengths", F.transform("sentences", lambda s: T.word_count(s))).withColumn(
        "openings", F.transform("sentences", lambda s: F.lower(F.regexp_extract(s, r"([\p{L}\p{N}]+)", 1))))


def repeated_openings(docs: DataFrame) -> DataFrame:
    """Runs of sentences in one line that begin with the same word."""
    starts = run_starts("openings", lambda a, b: (a == b) & (a != ""))
    return sentence_lines(docs).select("doc_id", "para_idx", "openings", F.explode(starts).alias("sent_idx")).select(
        "doc_id", "para_idx", "sent_idx", F.get("openings", F.col("sent_idx")).alias("opening"))


def equal_lengths(docs: DataFrame) -> DataFrame:
    """Three sentences in a row with the same number of words (every such position)."""
    three = _positions(F.size("lengths"), lambda i: F.coalesce(
        (F.get("lengths", i) == F.get("lengths", i - 1)) & (F.get("lengths", i) == F.get("lengths", i - 2)),
        F.lit(False)))
    return sentence_lines(docs).select("doc_id", "para_idx", F.explode(three).alias("sent_idx"))


def fragment_runs(docs: DataFrame) -> DataFrame:
    """Runs of very short sentences."""
    short = lambda a: (a > 0) & (a <= FRAGMENT_WORDS)
    starts = run_starts("lengths", lambda a, b: short(a) & short(b))
    return sentence_lines(docs).select("doc_id", "para_idx", F.explode(starts).alias("sent_idx"))


def stacked_qualifiers(docs: DataFrame) -> DataFrame:
    """Sentences with two or more qualifiers."""
    pattern = phrase_pattern(QUALIFIERS)
    rows = sentence_lines(docs).select("doc_id", "para_idx", F.posexplode("sentences").alias("sent_idx", "sentence"))
    return rows.withColumn("qualifiers", F.regexp_count("sentence", F.lit(pattern))).where("qualifiers >= 2").drop(
        "sentence")


def rate_per(docs: DataFrame, pattern: str, per_sentence: bool = False) -> DataFrame:
    """Matches of a pattern per 1,000 words, or per sentence, of each document."""
    hits = F.regexp_count("text", F.lit(pattern))
    if per_sentence:
        size = F.aggregate(F.transform(F.split("text", "\n", -1), lambda line: F.size(T.sentences(line))), F.lit(0),
                           lambda acc, n: acc + n)
        return docs.select("doc_id", hits.alias("hits"), size.alias("sentences")).withColumn(
            "rate", F.round(F.try_divide(F.col("hits"), F.col("sentences")), 6))
    return docs.select("doc_id", hits.alias("hits"), T.word_count("text").alias("words")).withColumn(
        "rate", F.round(F.try_divide(F.col("hits") * 1000, F.col("words")), 6))


# -- rules over the lines of a document --------------------------------------------------------

def repeated_closers(docs: DataFrame) -> DataFrame:
    """One-sentence lines whose text returns in the same document.

    The grouping key holds the document, so a closer that many documents share is never one group.
    """
    rows = paragraphs(docs).where(F.btrim("text") != "")
    single = rows.where(~F.col("text").startswith("#")).select(
        "doc_id", "para_idx", F.btrim("text").alias("closer"), F.size(T.sentences("text")).alias("n")).where("n = 1")
    return single.groupBy("doc_id", F.lower("closer").alias("closer")).agg(
        F.count("*").alias("times"), F.min("para_idx").alias("first_idx")).where("times > 1")


def closing_lines(docs: DataFrame, pattern: str) -> DataFrame:
    """Documents whose last non-blank line matches a pattern (a send-off)."""
    lines = F.filter(F.split("text", "\n", -1), lambda line: F.btrim(line) != "")
    last = F.try_element_at(lines, F.lit(-1))
    return docs.select("doc_id", last.alias("line")).where(F.col("line").rlike(pattern))


def heading_style(docs: DataFrame) -> DataFrame:
    """Title-case headings and decorated headings or list items."""
    rows = paragraphs(docs)
    head = rows.where(F.col("text").rlike("^#{1,6} ")).withColumn("title", F.regexp_replace("text", "^#{1,6} +", ""))
    words = F.regexp_extract_all("title", F.lit(r"\p{L}{4,}"), F.lit(0))
    capital = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    cased = head.where((F.size(words) >= 3) & (capital / F.size(words) >= TITLE_CASE_SHARE))
    decorated = rows.where(F.col("text").rlike(r"^(?:#{1,6} |\s*[-*•] )") & F.col("text").rlike(DECORATION))
    tag = lambda df, rule: df.select("doc_id", "para_idx", F.lit(rule).alias("rule"))
    return tag(cased, "prose.title-case").unionByName(tag(decorated, "prose.decorated"))


def repeated_headings(docs: DataFrame) -> DataFrame:
    """A heading restated by a one-sentence line right below it (ours: half its long words recur)."""
    lines = F.split("text", "\n", -1)
    long_tokens = lambda line: F.array_distinct(F.filter(T.fold_tokens(line), lambda t: F.length(t) > 3))

    def restates(i):
        head, below = F.get(F.col("lines"), i), F.get(F.col("lines"), i + 1)
        shared = F.size(F.array_intersect(long_tokens(head), long_tokens(below)))
        return F.coalesce(head.startswith("# ") & ~below.startswith("#") & (F.size(T.sentences(below)) == 1)
                          & (F.size(long_tokens(head)) > 0) & (shared * 2 >= F.size(long_tokens(head))), F.lit(False))

    rows = docs.select("doc_id", lines.alias("lines")).where(F.exists("lines", lambda x: x.startswith("# ")))
    return rows.select("doc_id", F.explode(_positions(F.size("lines"), restates)).alias("para_idx"))


# -- profile -----------------------------------------------------------------------------------

def tell_profile(docs: DataFrame, labels: DataFrame, lexicon: Sequence[LexiconRule] = LEXICON) -> DataFrame:
    """Hits per 1,000 words and distinct rules of each document, next to its quality label.

    Hits are counted inside each line's row, so what is shuffled is one small row per line.
    """
    hits = gate_weak(outside_quotes(line_hits("text", lexicon)))
    lines = paragraphs(docs).select(
        "doc_id", "words", F.transform(hits, lambda h: h["rule"]).alias("rules"))
    per = lines.groupBy("doc_id").agg(
        F.sum("words").alias("words"), F.sum(F.size("rules")).alias("hits"),
        F.size(F.array_distinct(F.flatten(F.collect_list(F.array_distinct("rules"))))).alias("rules"))
    return per.join(labels.select("doc_id", "quality"), "doc_id", "left").select(
        "doc_id", "quality", "words", "hits", "rules",
        F.round(F.try_divide(F.col("hits") * 1000, F.col("words")), 6).alias("density"))

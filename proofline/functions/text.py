"""Column expressions over text. Everything here stays on the JVM; nothing calls Python per row."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH_MARK = "\u0001"   # wraps a match while spans are located
GROUP_MARK = "\u0002"   # separates the groups of one match
OBJECT_MARK = "\ufffc"  # embedded object in a paragraph
MASK_CHAR = "\u0000"    # filler for masked stretches

# Spaces allowed around statistical operators.
OPERATOR_SPACE = "[ \u00a0\u2009\u202f\u200a]"

# Fixed value: addresses and identifiers that style rules must not read.
ADDRESS_PATTERN = (
    r"(?U)https?://\S+|\bwww\.\S+|\bdoi:\s*\S+|\b10\.\d{4,9}/\S+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
)

SPAN_SCHEMA = "array<struct<start:int,end:int,match:string,groups:array<string>>>"
SPAN_PIECES = 128   # matches and gaps that are folded together

# Tokens whose full stop does not end a sentence.
SENTENCE_ABBREVIATIONS = (
    "al e.g i.e eg ie fig figs vs cf approx ca no nos eq eqs ref refs dr mr mrs ms prof suppl vol st resp sp "
    "spp var ed eds tab sec ch p pp viz incl min max jan feb mar apr jun jul aug sep sept oct nov dec"
).split()


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def without_marks(text) -> Column:
    """The text without the control characters used to mark matches (a byte search when there are none)."""
    body = _col(text)
    dirty = body.contains(MATCH_MARK) | body.contains(GROUP_MARK)
    return F.when(dirty, F.translate(body, MATCH_MARK + GROUP_MARK, "  ")).otherwise(body)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; a plain column inside a lambda is evaluated per element."""
    return F.get(F.transform(F.array(value), body), 0)


def word_count(text) -> Column:
    """Runs of characters other than ASCII white space; an embedded object counts as space."""
    body = _col(text)
    plain = F.when(body.contains(OBJECT_MARK), F.translate(body, OBJECT_MARK, " ")).otherwise(body)
    return F.regexp_count(plain, F.lit(r"\S+"))


def clean(text) -> Column:
    """Collapse white space and drop spaces before punctuation and after an opening bracket."""
    out = F.regexp_replace(_col(text), r"(?U)\s+", " ")
    out = F.btrim(out)
    out = F.regexp_replace(out, r" +([.,;:!?)\]])", "$1")
    return F.replace(out, F.lit("( "), F.lit("("))


def spans(text, pattern: str, groups: int = 0, keep=None, hints: tuple[str, ...] = ()) -> Column:
    """All matches of a pattern, left to right, with character offsets.

    One replace pass wraps every match in a control character; splitting on it gives gaps and
    matches alternately, and the running length gives offsets. With ``groups`` > 0 the pattern's
    groups 1..n must together make up the whole match. ``keep`` (match -> boolean) drops matches before
    they are collected, so a frequent pattern with a rare condition stays linear in the text.
    ``hints`` are substrings of which every match needs at least one: text without any skips the
    pattern after a byte search.
    """
    body = without_marks(text)
    inner = GROUP_MARK.join(f"${i}" for i in range(1, groups + 1)) if groups else "$0"
    pieces = F.split(F.regexp_replace(body, F.lit(pattern), F.lit(MATCH_MARK + inner + MATCH_MARK)), MATCH_MARK, -1)
    empty = F.from_json(F.lit("[]"), SPAN_SCHEMA)

    bare = lambda piece: F.translate(piece, GROUP_MARK, "") if groups else piece

    def step(acc, piece):
        end = acc["pos"] + F.length(bare(piece))
        found = F.struct(
            acc["pos"].alias("start"), end.alias("end"), bare(piece).alias("match"),
            F.split(piece, GROUP_MARK, -1).alias("groups"),
        )
        wanted = acc["inside"] & keep(bare(piece)) if keep is not None else acc["inside"]
        return F.struct(
            end.alias("pos"), (~acc["inside"]).alias("inside"),
            F.when(wanted, F.concat(acc["out"], F.array(found))).otherwise(acc["out"]).alias("out"),
        )

    def part(pieces, begin):
        start = F.struct(begin.alias("pos"), F.lit(False).alias("inside"), empty.alias("out"))
        return F.aggregate(pieces, start, step, lambda acc: acc["out"])

    def in_parts(pieces):
        # a fold copies what it carries at every step, so a text of many matches is folded in parts of an even number of pieces
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / SPAN_PIECES).cast("int")),
                            lambda k: F.slice(pieces, k * SPAN_PIECES + 1, F.lit(SPAN_PIECES)))
        sized = F.transform(parts, lambda ps: F.struct(ps.alias("pieces"), F.aggregate(ps, F.lit(0), lambda n, p: n + F.length(bare(p))).alias("size")))
        begins = lambda rows: F.aggregate(rows, F.array(F.lit(0)), lambda at, r: F.concat(at, F.array(F.element_at(at, -1) + r["size"])))
        return let(sized, lambda rows: let(begins(rows), lambda at: F.flatten(
            F.transform(rows, lambda r, k: part(r["pieces"], F.get(at, k))))))

    # one evaluation of the pattern: a text without a match is a single piece and folds to nothing
    found = let(pieces, lambda ps: F.when(F.size(ps) <= 1, empty).otherwise(in_parts(ps)))
    if not hints:
        return found
    body = F.lower(_col(text)) if any(sign.lower() != sign.upper() for sign in hints) else _col(text)
    maybe = F.lit(False)
    for sign in hints:
        maybe = maybe | body.contains(sign.lower())
    return F.when(maybe, found).otherwise(empty)


def mask(text, pattern: str = ADDRESS_PATTERN) -> Column:
    """Replace every match by filler of the same length, so offsets still hold."""
    body = without_marks(text)
    pieces = F.split(F.regexp_replace(body, F.lit(pattern), F.lit(f"{MATCH_MARK}$0{MATCH_MARK}")), MATCH_MARK, -1)
    filled = F.array_join(
        F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.repeat(F.lit(MASK_CHAR), F.length(p))).otherwise(p)), ""
    )
    if pattern != ADDRESS_PATTERN:
        return filled
    # plain substring tests first: most text holds no address at all
    maybe = F.lit(False)
    for sign in ("@", "http", "www.", "doi:", "10."):
        maybe = maybe | body.contains(sign)
    return F.when(maybe, filled).otherwise(body)


def mask_fields(text, field_spans) -> Column:
    """Overlay filler on the given (start, end) ranges of a text."""
    return F.aggregate(
        field_spans, _col(text),
        lambda acc, s: F.overlay(acc, F.repeat(F.lit(MASK_CHAR), s["end"] - s["start"]), s["start"] + 1,
                                 s["end"] - s["start"]),
    )


def snippet(text, start, end, width: int = 80) -> Column:
    """Centred context of at most ``width`` characters with ellipses where text is cut."""
    text, start, end = _col(text), _col(start), _col(end)
    size = F.length(text)
    lo = F.least(F.greatest(F.lit(0), start), size)
    hi = F.least(F.greatest(end, lo), size)
    core = width - 6
    room = F.lit(core) - (hi - lo)
    left = F.greatest(F.lit(0), lo - F.floor(room / 2).cast("int"))
    right = F.least(size, hi + (room - (lo - left)))
    centred = F.concat(
        F.when(left > 0, "...").otherwise(""), F.substr(text, left + 1, right - left),
        F.when(right < size, "...").otherwise(""),
    )
    long = F.concat(F.substr(text, lo + 1, F.lit(width - 3)), F.lit("..."))
    return F.regexp_replace(F.when(hi - lo > core, long).otherwise(centred), "[\t\n\r\f\u0000]", " ")


@lru_cache(maxsize=1)
def _folding_tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Compatibility decomposition of Latin, sign and full-width blocks, derived from the Unicode data."""
    blocks = ((0x80, 0x250), (0x1E00, 0x1F00), (0x2070, 0x20A0), (0x2100, 0x2190), (0x2460, 0x2500),
              (0xFB00, 0xFB07), (0xFF01, 0xFF5F))
    single_from, single_to, several = [], [], []
    for low, high in blocks:
        for point in range(low, high):
            char = chr(point)
            folded = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)).lower()
            if folded == char or not re.search("[a-z0-9]", folded):
                continue
            if len(folded) == 1:
                single_from.append(char)
                single_to.append(folded)
            else:
                several.append((char, folded))
    return "".join(single_from), "".join(single_to), tuple(several)


def fold(text) -> Column:
    """Lower case without accents (compatibility decomposition, combining marks dropped)."""
    source, target, several = _folding_tables()
    body = _col(text)
    out = F.translate(body, source, target)
    rare = "[" + "".join(re.escape(c) for c, _ in several) + "]"
    expanded = out
    for char, folded in several:
        expanded = F.replace(expanded, F.lit(char), F.lit(folded))
    out = F.when(out.rlike(rare), expanded).otherwise(out)
    plain = F.regexp_replace(out, r"\p{Mn}+", "")
    return F.lower(F.when(body.rlike(r"[^\x00-\x7f]"), plain).otherwise(body))


def fold_tokens(text) -> Column:
    """Accent-free lower-case alphanumeric tokens in order."""
    return F.regexp_extract_all(fold(text), F.lit("[a-z0-9]+"), F.lit(0))


def _sentence_boundary() -> str:
    words = "|".join(re.escape(w) for w in sorted(SENTENCE_ABBREVIATIONS, key=len, reverse=True))
    closers = "[\"'”’)\\]]*"
    openers = "[(\\[{\"'“‘]{0,8}"
    # the stop is matched first, so the look behind it runs at stops only
    stop = f"\\.(?<!(?:^|\\s){openers}(?i:{words}|[a-z])\\.{{1,4}})"
    follows = "(?=\\s|$)(?=\\s*(?:$|[\\p{Lu}\\p{Lt}\\p{Nd}(\\[\"'“‘]))"
    return f"(?U)(?:[!?][.!?]*|\\.[.!?]+|{stop}){closers}{follows}"


SENTENCE_BOUNDARY = _sentence_boundary()


def sentences(text) -> Column:
    """Trimmed sentences in order; aware of abbreviations, initials, decimals and a lower-case follower.

    Whether a stop ends a sentence depends only on the run of characters before it and the next
    visible character, so one pattern decides and no ordered state is needed.
    """
    body = without_marks(text)
    marked = F.regexp_replace(body, F.lit(SENTENCE_BOUNDARY), F.lit(f"$0{MATCH_MARK}"))
    parts = F.transform(F.split(marked, MATCH_MARK, -1), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


def sentence_spans(text) -> Column:
    """Sentences with character offsets."""
    body = without_marks(text)
    pieces = F.split(F.regexp_replace(body, F.lit(SENTENCE_BOUNDARY), F.lit(f"$0{MATCH_MARK}")), MATCH_MARK, -1)
    schema = "array<struct<start:int,end:int,text:string>>"

    def step(acc, piece):
        lead = F.length(piece) - F.length(F.regexp_replace(piece, r"(?U)^\s+", ""))
        core = F.regexp_replace(piece, r"(?U)^\s+|\s+$", "")
        begin = acc["pos"] + lead
        found = F.struct(begin.alias("start"), (begin + F.length(core)).alias("end"), core.alias("text"))
        return F.struct(
            (acc["pos"] + F.length(piece)).alias("pos"),
            F.when(core != "", F.concat(acc["out"], F.array(found))).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("pos"), F.from_json(F.lit("[]"), schema).alias("out"))
    return F.aggregate(pieces, start, step, lambda acc: acc["out"])


def register_sentences(spark, name: str = "sentence_rows") -> None:
    """A table function for SQL, (sent_idx, start, end, sentence), usable in LATERAL; its body is the expression of ``sentence_spans``."""
    quoted = lambda t: "'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'"
    mark, group = quoted(MATCH_MARK), quoted(MATCH_MARK + GROUP_MARK)
    trimmed = lambda x: f"regexp_replace({x}, {quoted(r'(?U)^\s+|\s+$')}, '')"
    lead = f"(length(p) - length(regexp_replace(p, {quoted(r'(?U)^\s+')}, '')))"
    pieces = f"split(regexp_replace(translate(body, {group}, '  '), {quoted(SENTENCE_BOUNDARY)}, {quoted('$0' + MATCH_MARK)}), {mark}, -1)"
    found = f"array(named_struct('start', acc.pos + {lead}, 'end', acc.pos + {lead} + length({trimmed('p')}), 'text', {trimmed('p')}))"
    spans = (f"aggregate({pieces}, named_struct('pos', 0, 'out', from_json('[]', 'array<struct<start:int,end:int,text:string>>')), "
             f"(acc, p) -> named_struct('pos', acc.pos + length(p), 'out', if({trimmed('p')} = '', acc.out, concat(acc.out, {found}))), acc -> acc.out)")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(body STRING) RETURNS TABLE (sent_idx INT, start INT, end INT, sentence STRING)
RETURN SELECT pos, col.start, col.end, col.text FROM (SELECT posexplode({spans}))""")


def heading_level(style) -> Column:
    """Level from a style name such as ``Heading 2``; 0 for any other style."""
    level = F.regexp_extract(F.translate(_col(style), "_", " "), r"(?i)^\s*heading\s*([1-9])\s*$", 1)
    return F.coalesce(level.try_cast("int"), F.lit(0))


def normalise_doi(value) -> Column:
    """Lower-case DOI without resolver prefix or trailing punctuation; NULL when it is not a DOI."""
    bare = F.regexp_replace(F.btrim(_col(value)), r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", "")
    bare = F.regexp_replace(bare, r"[.,;]+$", "")
    return F.when(bare.rlike(r"^10\.\d{4,9}/\S+$"), F.lower(bare))


def surname(author) -> Column:
    """Text before the comma; the whole name when it ends in a comma; else the last word."""
    name = F.btrim(_col(author))
    return (
        F.when(name == "", F.lit(None).cast("string"))
        .when(name.endswith(","), F.btrim(F.regexp_replace(name, ",$", "")))
        .when(name.contains(","), F.btrim(F.split_part(name, F.lit(","), F.lit(1))))
        .otherwise(F.regexp_extract(name, r"(\S+)$", 1))
    )


def strip_tags(text) -> Column:
    """Markup removed, white space collapsed."""
    return F.btrim(F.regexp_replace(F.regexp_replace(_col(text), "<[^>]+>", " "), r"(?U)\s+", " "))

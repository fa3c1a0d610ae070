"""Personal data in texts, disguised or not: identifiers are detected in a normalised copy and mapped back to the source.

Plain identifiers are found in the text as it is. Then three transducers each rewrite the text and carry, for every
character they write, the source range it stands for: look-alike characters become ASCII, spelled digits become figures, and
at/dot disguises become signs. What the same detectors find in the rewritten text, over rewritten characters, is added unless
it overlaps a plain span of its kind.

Defined results: a NULL or empty text has no spans; repeated rows each get their row; only the id and text columns are read.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm.common import annotate, read_table

KINDS = ("email", "ip", "card", "phone")
# fixed values: the base patterns
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")   # a match never starts inside a run of digits
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
FIGURES = re.compile(r"[0-9+][0-9+(). -]{4,}")
NOT_DIGIT = re.compile("[^0-9]+")

Span = tuple[int, int, int]   # place of the kind in KINDS, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def detect(text: str) -> list[Span]:
    """Plain identifiers by kind, then start; leftmost and non-overlapping within a kind. Linear in the text."""
    found: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        if at >= free and (m := DOMAIN.match(text, at + 1)):
            start = at
            while start > free and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                found.append((0, start, free := m.end()))
        at = text.find("@", at + 1)
    for figures in FIGURES.finditer(text):
        begin, end = figures.span()
        own = figures[0]
        if own.count(".") >= 3:
            found += [(1, *m.span()) for m in IP.finditer(text, begin, end) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        if end - begin >= 13:
            for m in CARD.finditer(text, begin, end):
                digits = NOT_DIGIT.sub("", m[0])
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found.append((2, *m.span()))
        if "+" in own:
            found += [(3, *m.span()) for m in PHONE.finditer(text, begin, end) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(found)


# fixed values: letters that look like ASCII letters, and signs that look like ASCII signs
LOOK_ALIKE = dict(zip(
    "АВЕКМНОРСТУХЅІЈасеорухѕіјԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧορνıɡ‐‑‒–—﹣−․。．﹒＋⁺﹢＠﹫",
    "ABEKMHOPCTYXSIJaceopyxsijdhqwABEZHIKMNOPTYXopvig-------....+++@@", strict=True))
IGNORED = frozenset("­​‌‍⁠﻿")
PLAIN = re.compile("[\\x00-\\xac\\xae-\\xb1\\xb4-\\xb8\\xba-\\xbb\\xbf-\\u0130\\u0132-\\u017e\\u0180-\\u02ff]+")
# fixed values: digit words
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}
WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
SPELLED = re.compile(rf"(?<!\w)(?:plus[ -]?)?(?:{WORD}|[0-9])(?:[ ,.-]{{1,2}}(?:(?:dot|point) )?(?:{WORD}|[0-9]+)(?!\w)){{3,}}", re.I)
WORDS_OF_RUN = frozenset(DIGIT_WORDS) | {"dot", "point", "plus"}
SPELLED_PART = re.compile(rf"plus[ -]?|{WORD}|[0-9]+|[ ,.-]*(?:dot|point) |[ ,.-]+", re.I)
AT = r"(?:\s{0,3}[(\[{<]\s{0,3}(?:at|@)\s{0,3}[)\]}>]\s{0,3}|\s{1,3}at\s{1,3}|\s{0,3}@\s{0,3})"
DOT = r"(?:\s{0,3}[(\[{<]\s{0,3}(?:dot|\.)\s{0,3}[)\]}>]\s{0,3}|\s{1,3}dot\s{1,3})"
DISGUISED = re.compile(rf"({AT})([A-Za-z0-9-]+(?:(?:{DOT}|\.)[A-Za-z0-9-]+)+)", re.I)
DOT_ONLY = re.compile(DOT, re.I)
ADDRESS = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:(?:{DOT}|\.)[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
# fixed values: endings that tell "name at host dot ending" from prose
ENDINGS = frozenset("com org net edu gov mil int info biz io ai co me tv app dev eu de fr es it nl uk us ca au ch at be jp in br".split())


def may_be_spelled(text: str) -> bool:
    """Whether a digit word stands beside another or beside a figure; cheap, and never wrongly false."""
    low = text.lower()
    for sign in ",.-":
        low = low.replace(sign, " ")
    words = low.split()
    known = WORDS_OF_RUN
    return sum(map(known.__contains__, words)) > 0 and any(
        a in known and (b in known or b[0].isdigit()) or b in known and a[0].isdigit() for a, b in zip(words, words[1:], strict=False))


SPACED_SIGN = re.compile(r"\s@|@\s")


def may_be_disguised(text: str) -> bool:
    """Whether a bracket, "dot" or a sign with white space beside it stands in the text; cheap, and never wrongly false."""
    return any(sign in text for sign in "([{<") or "dot" in text.lower() or "@" in text and SPACED_SIGN.search(text) is not None


class Mapped:
    """A text with, for each character, the source range it stands for."""

    def __init__(self, text: str, starts: list[int], ends: list[int], changed: list[bool]):
        self.text, self.starts, self.ends, self.changed = text, starts, ends, changed

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """With ranges replaced; every character of a replacement stands for the whole source range it replaces."""
        text, starts, ends, changed, at = [], [], [], [], 0
        for begin, end, new in edits:
            text += [self.text[at:begin], new]
            starts += self.starts[at:begin] + [self.starts[begin]] * len(new)
            ends += self.ends[at:begin] + [self.ends[end - 1]] * len(new)
            changed += self.changed[at:begin] + [True] * len(new)
            at = end
        return Mapped("".join([*text, self.text[at:]]), starts + self.starts[at:], ends + self.ends[at:], changed + self.changed[at:])


def look_alikes(text: str) -> list[tuple[int, int, str]]:
    """Edits to ASCII: look-alikes, compatibility forms (full width, styled letters, digits of any script); invisible signs go."""
    edits, at = [], 0
    for plain in [*PLAIN.finditer(text), None]:
        for i in range(at, plain.start() if plain else len(text)):
            c = text[i]
            new = "" if c in IGNORED else LOOK_ALIKE.get(c)
            if new is None and (d := unicodedata.digit(c, None)) is not None and unicodedata.category(c) == "Nd":
                new = str(d)
            if new is None and (form := unicodedata.normalize("NFKC", c)) != c and len(form) == 1 and form.isascii() and not form.isspace():
                new = form
            if new is not None:
                edits.append((i, i + 1, new))
        at = plain.end() if plain else at
    return edits


def spelled_digits(text: str) -> list[tuple[int, int, str]]:
    """Edits in runs of four or more digit words: words to figures, gaps dropped, "point" and "dot" to a full stop."""
    edits = []
    if not may_be_spelled(text):
        return edits
    for run in SPELLED.finditer(text):
        for part in SPELLED_PART.finditer(text, *run.span()):
            word = part[0].lower()
            if not word[0].isdigit():
                bare = word.strip(" ,.-")
                edits.append((*part.span(), "+" if bare == "plus" else "." if bare in ("dot", "point") else DIGIT_WORDS.get(word, "")))
    return edits


def disguised_signs(text: str) -> list[tuple[int, int, str]]:
    """Edits of at and dot disguises, where a local part stands before the sign and a domain with a dot after it."""
    edits = []
    if not may_be_disguised(text):
        return edits
    for m in DISGUISED.finditer(text):
        if m.start() == 0 or text[m.start() - 1] not in LOCAL:
            continue
        dots = list(DOT_ONLY.finditer(text, *m.span(2)))
        sign = m[1].strip().lower()
        if sign == "at" and (not dots or re.split(r"[^A-Za-z0-9-]+", m[2])[-1].lower() not in ENDINGS):   # prose: "at example.com", "at the dot of"
            continue
        if sign == "@" and not dots and m[1] == "@":
            continue
        edits.append((*m.span(1), "@"))
        edits += [(*d.span(), ".") for d in dots]
    for m in ADDRESS.finditer(text):
        edits += [(*d.span(), ".") for d in DOT_ONLY.finditer(text, *m.span())]
    return sorted(set(edits))


HINT = re.compile("[^\\x00-\\xac\\xae-\\u02ff]")


def find_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Plain spans, and those added by normalising, each by kind, then start; places are code points of the source."""
    base = detect(text)
    strange = HINT.search(text) or not PLAIN.fullmatch(text)
    if not strange and not may_be_spelled(text) and not may_be_disguised(text):
        return base, []
    n = len(text)
    mapped = Mapped(text, list(range(n)), list(range(1, n + 1)), [False] * n)
    for transducer in (look_alikes, spelled_digits, disguised_signs):
        if edits := transducer(mapped.text):
            mapped = mapped.rewritten(edits)
    if mapped.text == text:
        return base, []
    added = []
    for kind, start, end in detect(mapped.text):
        span = (kind, mapped.starts[start], mapped.ends[end - 1])
        gapless = all(mapped.ends[i] == mapped.starts[i + 1] for i in range(start, end - 1))
        if (any(mapped.changed[start:end]) or not gapless) and not any(k == kind and a < span[2] and span[1] < b for k, a, b in base):
            added.append(span)
    return base, sorted(set(added))


def _named(spans: list[Span]) -> list[str]:
    return [f"{KINDS[k]}:{a}:{b}" for k, a, b in spans]


def find_personal_data(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, spans) per row: "kind:start:end" of the plain spans and of all spans, by kind, then start. No row moves."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def make():
        def work(texts):
            pairs = [find_spans(t) for t in texts]
            return [[_named(base) for base, _ in pairs], [_named(sorted(base + added)) for base, added in pairs]]
        return work
    return annotate(rows, "text", make, [("base", "array<string>"), ("spans", "array<string>")], raw=False, keep=["doc_id"])


def redacted(text: str) -> str:
    """The text with each span replaced by its kind in angle brackets; spans that overlap are replaced as one."""
    base, added = find_spans(text)
    out, at = [], 0
    for kind, start, end in sorted(base + added, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """All columns of the documents with personal data in the text replaced; NULL texts stay NULL."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), F.col(f"`{text}`").alias("plain"))
    rows = annotate(rows, "plain", lambda: lambda texts: [[redacted(t) for t in texts]], [("clean", "string")], raw=False, keep=["document"])
    clean = F.when(F.col(f"document.`{text}`").isNotNull(), F.col("clean")).alias(text)
    return rows.select([clean if c == text else F.col(f"document.`{c}`").alias(c) for c in docs.columns])


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(read_table(spark, sf_dir, "documents"))
    starts = lambda kind: lambda span: span.startswith(f"{kind}:")  # noqa: E731  (a second argument would be the index)
    counts = [F.size(F.filter("base", starts(kind))).cast("bigint").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.array_join("base", ",").cast("binary"), 256).alias("base_sha256"),
                        F.array_join("spans", ",").alias("spans"))

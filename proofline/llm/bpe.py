"""Byte-level byte-pair encoding of pre-tokens: the rank table, the merge loop and the pre-token pattern."""

from __future__ import annotations

import base64
import heapq
import json
import re
from functools import lru_cache

import regex

# fixed values: white space of the Unicode standard, the pre-token alternatives of the published pattern,
# and the letters and numbers below U+02B0
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LATIN_LETTERS = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u02af"
LATIN_NUMBERS = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"


def _pattern(letters: str, numbers: str) -> str:
    # The classes are disjoint, so letters and numbers may be tried before the contractions.
    return (f" ?[{letters}]+| ?[{numbers}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{WHITE}{letters}{numbers}]+"
            f"|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


ANY_TEXT = regex.compile(_pattern(r"\p{L}", r"\p{N}"))
LATIN_TEXT = re.compile(_pattern(LATIN_LETTERS, LATIN_NUMBERS))
BEYOND_LATIN = re.compile("[^\\x00-\\u02af]")
#: A pre-token is certain if this many characters of context follow it: the longest contraction or special string is shorter.
CONTEXT = 32


def pre_token_pattern(text: str):
    """The compiled pattern for a text; both split alike, the first is faster and knows Latin letters only."""
    return ANY_TEXT if BEYOND_LATIN.search(text) else LATIN_TEXT


NO_RANK = 1 << 30


class Encoder:
    """Ids of pre-tokens by a rank table in which a token's id is its rank. Results are remembered; the memory is emptied
    when it holds ``remember`` pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], remember: int = 1 << 16):
        self.ranks, self.remember, self.known = ranks, remember, {}
        self.bytes_to_ids = [ranks[bytes([b])] for b in range(256)]
        #: Left id << 20 | right id, to the id of the two joined, for every way to cut a token in two tokens.
        self.pairs = {left << 20 | right: rank for token, rank in ranks.items() for i in range(1, len(token))
                      if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None}

    def fresh(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode()
        whole = self.ranks.get(raw)
        return (whole,) if whole is not None else self.merge(raw)

    def piece(self, piece: str) -> tuple[int, ...]:
        ids = self.known.get(piece)
        if ids is None:
            ids = self.fresh(piece)
            if len(piece) <= 64:
                if len(self.known) >= self.remember:
                    self.known.clear()
                self.known[piece] = ids
        return ids

    def ids(self, text: str) -> list[int]:
        out: list[int] = []
        known, piece = self.known, self.piece
        for p in pre_token_pattern(text).findall(text):
            out += known.get(p) or piece(p)
        return out

    def merge(self, raw: bytes) -> tuple[int, ...]:
        """Join the adjacent pair of lowest rank, leftmost first, until no pair has a rank."""
        if len(raw) > 64:
            return self.merge_long(raw)
        get = self.pairs.get
        ids = list(map(self.bytes_to_ids.__getitem__, raw))
        scores = [get(a << 20 | b, NO_RANK) for a, b in zip(ids, ids[1:], strict=False)]
        while scores and (low := min(scores)) != NO_RANK:
            i = scores.index(low)
            ids[i] = low
            del ids[i + 1], scores[i]
            if i < len(scores):
                scores[i] = get(low << 20 | ids[i + 1], NO_RANK)
            if i:
                scores[i - 1] = get(ids[i - 1] << 20 | low, NO_RANK)
        return tuple(ids)

    def merge_long(self, raw: bytes) -> tuple[int, ...]:
        """The same with a heap over a linked list: n log n for pre-tokens of any length."""
        get, n = self.pairs.get, len(raw)
        ids = list(map(self.bytes_to_ids.__getitem__, raw))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i, ids[i], ids[i + 1]) for i in range(n - 1) if (rank := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue                      # one of the two has grown or gone since
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (new := get(rank << 20 | ids[k])) is not None:
                    heapq.heappush(heap, (new, i, rank, ids[k]))
            if (h := before[i]) >= 0 and (new := get(ids[h] << 20 | rank)) is not None:
                heapq.heappush(heap, (new, h, ids[h], rank))
        return tuple(x for x in ids if x >= 0)


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """One encoder for all tasks of a worker, so what it remembers lasts."""
    return Encoder(read_ranks(path))


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file of lines "base64 rank"."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in JSON vocabularies: printable bytes for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def read_merges(path: str) -> tuple[dict[bytes, int], list[str]]:
    """Ranks of a JSON byte-level vocabulary (single bytes first, then its merges in order) and its special strings."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    letters = byte_letters()
    raw = lambda word: bytes(letters[c] for c in word)
    ranks = {bytes([b]): b for b in range(256)}
    for pair in content["model"]["merges"]:
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        ranks.setdefault(raw(left) + raw(right), len(ranks))
    return ranks, [t["content"] for t in content["added_tokens"]]

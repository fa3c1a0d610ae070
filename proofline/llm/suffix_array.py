"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

The induction scans buckets in order; all entries of a bucket that are known at once are moved together, so the work is linear
with one array operation per bucket and wave (a wave per repetition of a letter) instead of one step per suffix.
"""

from __future__ import annotations

import numpy as np

Array = np.ndarray


def small_suffixes(text: Array) -> Array:
    """Which suffixes are smaller than the next one. The last letter must be the only least one."""
    n = len(text)
    places = np.where(text[:-1] != text[1:], np.arange(n - 1), n)
    after = np.minimum.accumulate(places[::-1])[::-1]        # where the run of equal letters ends
    return np.append(text[after] < text[after + 1], True)


def induce(text: Array, small: Array, leftmost: Array, letters: int) -> Array:
    """The order of all suffixes from the order of the leftmost small ones."""
    n_range = range(letters)
    seeds = _dealt(leftmost, text[leftmost], letters)
    large: list[list[Array]] = [[] for _ in n_range]
    for c in n_range:                                   # upwards: large suffixes from what is to their right
        large[c] = [_drained(text, small, large, c, False)]
        if len(seeds[c]):
            _push(text, small, seeds[c], False, large)
    lesser: list[list[Array]] = [[] for _ in n_range]
    for c in reversed(n_range):                         # downwards: small suffixes, each bucket from its end
        lesser[c] = [_drained(text, small, lesser, c, True)]
        _push(text, small, large[c][0][::-1], True, lesser)
    out = [np.array([len(text) - 1])]                   # nothing precedes the last letter's own suffix
    for c in n_range:
        out += [large[c][0], lesser[c][0][::-1]]
    return np.concatenate(out)


def _drained(text: Array, small: Array, buckets: list[list[Array]], c: int, kind: bool) -> Array:
    """All entries of bucket ``c``, those that its own entries add included: a wave for each repetition of the letter."""
    waves = []
    while buckets[c]:
        wave = np.concatenate(buckets[c])
        buckets[c] = []
        waves.append(wave)
        _push(text, small, wave, kind, buckets)
    return np.concatenate(waves) if waves else np.empty(0, np.int64)


def _push(text: Array, small: Array, known: Array, kind: bool, buckets: list[list[Array]]) -> None:
    before = known[known > 0] - 1
    before = before[small[before] == kind]
    if len(before):
        for c, part in _grouped(before, text[before]):
            buckets[c].append(part)


def _grouped(places: Array, letters: Array):
    if len(places) < 2 or (letters[0] == letters).all():
        yield int(letters[0]), places
        return
    order = np.argsort(letters.astype(np.uint16), kind="stable")   # a radix sort
    places, letters = places[order], letters[order]
    cuts = np.flatnonzero(np.diff(letters)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(places)], strict=True):
        yield int(letters[a]), places[a:b]


def _dealt(places: Array, letters: Array, count: int) -> list[Array]:
    out = [np.empty(0, np.int64)] * count
    if len(places):
        for c, part in _grouped(places, letters):
            out[c] = part
    return out


def rank_order(names: Array) -> Array:
    """Suffix order of a reduced text, whose alphabet is too large for buckets: ranks of pairs, doubled until all differ."""
    n, rank, step = len(names), names.astype(np.int64), 1
    while True:
        second = np.zeros(n, np.int64)
        second[: max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        changed = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = changed
        if changed[-1] == n - 1:
            return order
        step *= 2


def suffix_array(text: Array, letters: int) -> Array:
    """Order of the suffixes of ``text``, whose last letter is 0 and occurs nowhere else."""
    text = np.asarray(text, np.int32)
    if len(text) == 1:
        return np.zeros(1, np.int64)
    small = small_suffixes(text)
    leftmost = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    order = induce(text, small, leftmost, letters)
    # the leftmost small substrings are now in order: name them, equal ones alike
    is_leftmost = np.zeros(len(text), bool)
    is_leftmost[leftmost] = True
    sorted_places = order[is_leftmost[order]]
    ends = np.append(leftmost[1:], len(text) - 1)
    length = np.zeros(len(text), np.int64)
    length[leftmost] = ends - leftmost + 1
    a, b = sorted_places[:-1], sorted_places[1:]
    same = length[a] == length[b]
    active, step = np.flatnonzero(same), 0
    while len(active):
        active = active[length[a[active]] > step]
        unequal = text[a[active] + step] != text[b[active] + step]
        same[active[unequal]] = False
        active, step = active[~unequal], step + 1
    names = np.concatenate(([0], np.cumsum(~same)))
    if names[-1] + 1 < len(sorted_places):
        name_of = np.empty(len(text), np.int64)
        name_of[sorted_places] = names
        sorted_places = leftmost[rank_order(name_of[leftmost])]
    return induce(text, small, sorted_places, letters)


def permuted_prefixes(text: Array, order: Array, stop: int) -> tuple[Array, Array]:
    """(before, common): for each place the suffix before its own in the order (-1: none), and how many letters they share.

    No letter up to ``stop`` is shared, so strings end at their separators. Only places whose left neighbours differ are
    compared letter by letter; from one of those on, the shared length falls by one a place.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    here = np.arange(n)
    known = before >= 0
    left, right = text[np.maximum(here - 1, 0)], text[np.maximum(before - 1, 0)]
    fresh = ~known | (here == 0) | (before == 0) | (left != right) | (left <= stop)
    common = np.zeros(n, np.int64)
    active, step = np.flatnonzero(fresh & known), 0
    while len(active):
        active = active[(active + step < n) & (before[active] + step < n)]
        equal = (text[active + step] == text[before[active] + step]) & (text[active + step] > stop)
        common[active[~equal]] = step
        active, step = active[equal], step + 1
    common = np.maximum.accumulate(np.where(fresh, common + here, 0)) - here
    return before, np.maximum(common, 0)


def repeated_starts(parts: list[bytes], width: int) -> list[Array]:
    """For each byte string, which places start a string of ``width`` bytes that also starts elsewhere in ``parts``."""
    sizes = np.array([len(p) for p in parts], np.int64)
    text = np.ones(int(sizes.sum()) + len(parts) + 1, np.int32)
    begins = np.cumsum(sizes + 1) - sizes - 1
    for begin, part in zip(begins.tolist(), parts, strict=True):
        text[begin:begin + len(part)] = np.frombuffer(part, np.uint8).astype(np.int32) + 2
    text[-1] = 0
    before, common = permuted_prefixes(text, suffix_array(text, 258), 1)
    hit = common >= width
    hit[before[hit]] = True
    return [hit[b:b + s] for b, s in zip(begins.tolist(), sizes.tolist(), strict=True)]

"""Suffix arrays of bounded blocks by induced sorting, and their permuted common prefixes.

Suffixes are of type S (smaller than the next one) or L. The leftmost S suffixes of each
run of S start substrings that are sorted by induction, named, and sorted recursively as
a string of names; their order then induces that of all suffixes in linear time. Bytes
are induced a whole bucket at a time, names, of which there are many, one by one.
"""

from __future__ import annotations

import numpy as np

WORD = 8


def s_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next; the last one, a sentinel, is."""
    n = len(text)
    out = np.ones(n, bool)
    if n > 1:
        unlike = text[:-1] != text[1:]
        at = np.where(unlike, np.arange(n - 1), n)
        at = np.minimum.accumulate(at[::-1])[::-1]
        inside = at < n
        out[:-1][inside] = text[at[inside]] < text[at[inside] + 1]
    return out


def leftmost(is_s: np.ndarray) -> np.ndarray:
    return np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1


def induced_names(text: np.ndarray, is_s: np.ndarray, sorted_lms: np.ndarray) -> np.ndarray:
    """Suffix array from the order of the leftmost S suffixes, entry by entry."""
    n = len(text)
    sizes = np.bincount(text)
    ends = np.cumsum(sizes)
    sa = [-1] * n
    tails = ends.tolist()
    names = text[sorted_lms]
    for i, c in zip(sorted_lms[::-1].tolist(), names[::-1].tolist()):
        tails[c] -= 1
        sa[tails[c]] = i

    def left(kind: bool) -> list[int]:
        """Per position the name to its left if that is of the kind, else −1; free entries ask for the last."""
        out = np.full(n + 1, -1, np.int64)
        out[1:n] = np.where(is_s[:-1] == kind, text[:-1], -1)
        return out.tolist()

    # lists show their iterators what is put ahead of them
    heads, before = (ends - sizes).tolist(), left(False)
    for x in sa:
        c = before[x]
        if c >= 0:
            p = heads[c]
            sa[p] = x - 1
            heads[c] = p + 1
    tails, before = ends.tolist(), left(True)
    for x in reversed(sa):
        c = before[x]
        if c >= 0:
            p = tails[c] - 1
            sa[p] = x - 1
            tails[c] = p
    return np.array(sa, np.int64)


def induced_bytes(text: np.ndarray, is_s: np.ndarray, sorted_lms: np.ndarray, marks: int) -> np.ndarray:
    """The same for bytes above ``marks`` separators, bucket by bucket.

    Separators are smaller than bytes, each occurs once, and a later one is smaller, so
    their places are known beforehand.
    """
    n = len(text)
    sizes = np.bincount(text, minlength=marks + 256)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    letters = (np.flatnonzero(sizes[marks:]) + marks).tolist()
    sa = np.full(n, -1, np.int64)
    apart = np.flatnonzero(text < marks)
    sa[text[apart]] = apart

    def ranks(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order that groups by letter, place within the letter's group, counts."""
        order = np.argsort(chars, kind="stable")
        counts = np.bincount(chars, minlength=marks + 256)
        grouped = chars[order]
        return order, np.arange(len(chars)) - (np.cumsum(counts) - counts)[grouped], counts

    lms = sorted_lms[text[sorted_lms] >= marks]
    order, inside, counts = ranks(text[lms])
    lms = lms[order]
    sa[(ends - counts)[text[lms]] + inside] = lms

    def before(block: np.ndarray, kind: bool) -> np.ndarray:
        found = block[block > 0] - 1
        return found[is_s[found] == kind]

    heads = starts.copy()

    def to_heads(found: np.ndarray) -> None:
        if len(found):
            order, inside, counts = ranks(text[found])
            found = found[order]
            sa[heads[text[found]] + inside] = found
            heads[:] += counts

    to_heads(before(sa[:marks], False))
    n_lms = counts_of(text[lms], marks)
    for c in letters:
        low = int(starts[c])
        while low < heads[c]:
            # entries that go into this bucket itself wait for the next turn of the loop
            high = int(heads[c])
            to_heads(before(sa[low:high], False))
            low = high
        to_heads(before(sa[ends[c] - n_lms[c] : ends[c]], False))
    tails = ends.copy()

    def to_tails(found: np.ndarray) -> None:
        if len(found):
            order, inside, counts = ranks(text[found])
            found = found[order]
            sa[tails[text[found]] - 1 - inside] = found
            tails[:] -= counts

    for c in reversed(letters):
        high = int(ends[c])
        while high > tails[c]:
            low = int(tails[c])
            found = before(sa[low:high][::-1], True)
            to_tails(found[text[found] >= marks])
            high = low
        found = before(sa[starts[c] : heads[c]][::-1], True)
        to_tails(found[text[found] >= marks])
    return sa


def counts_of(chars: np.ndarray, marks: int) -> np.ndarray:
    return np.bincount(chars, minlength=marks + 256)


def named(text: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Ranks of the substrings from each leftmost S suffix to the next, in text order."""
    length = np.zeros(len(text), np.int64)
    length[lms[:-1]] = np.diff(lms)
    length[lms[-1]] = 0
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    # the last one is the sentinel, which equals no other
    same &= length[a] > 0
    live, at = np.flatnonzero(same), 0
    while len(live):
        equal = text[a[live] + at] == text[b[live] + at]
        same[live[~equal]] = False
        live = live[equal & (length[a[live]] > at)]
        at += 1
    ranks = np.zeros(len(text), np.int64)
    ranks[order] = np.concatenate([[0], np.cumsum(~same)])
    return ranks[lms]


def suffix_array(text: np.ndarray, marks: int | None = None) -> np.ndarray:
    """Suffix array of a string of integers that ends in its smallest, which occurs once.

    ``marks``: the string has bytes above that many separators.
    """
    is_s = s_types(text)
    lms = leftmost(is_s)
    if len(lms) == 0:
        return np.argsort(text, kind="stable") if len(text) < 2 else np.arange(len(text))[::-1].copy()

    def induced(sorted_lms: np.ndarray) -> np.ndarray:
        if marks is None:
            return induced_names(text, is_s, sorted_lms)
        return induced_bytes(text, is_s, sorted_lms, marks)

    first = np.zeros(len(text), bool)
    first[lms] = True
    rough = induced(lms)
    order = rough[first[rough]]
    names = named(text, lms, order)
    if int(names.max()) + 1 < len(lms):
        order = lms[suffix_array(names)]
        return induced(order)
    return induced(order)


def permuted_prefixes(data: np.ndarray, rest: np.ndarray, text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Per position its common prefix, in bytes, with the suffix before it in the array.

    Only where the bytes to the left of both differ is anything compared; elsewhere the
    prefix is one shorter than that of the position before. ``rest`` is the number of
    bytes up to the next separator; ``data`` has eight more bytes at its end.
    """
    n = len(text)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    left = np.full(n, -1, np.int64)
    left[1:] = text[:-1]
    alone = (phi < 0) | (left != np.where(phi > 0, left[phi], -2))
    at = np.flatnonzero(alone & (phi >= 0))
    other = phi[at]
    most = np.minimum(rest[at], rest[other])
    words = np.lib.stride_tricks.sliding_window_view(data, WORD)
    words = np.ascontiguousarray(words[:n]).view("<u8").ravel()
    found, live, done = np.zeros(len(at), np.int64), np.arange(len(at)), 0
    while len(live):
        gap = words[at[live] + done] ^ words[other[live] + done]
        stop = gap != 0
        low = gap[stop]
        # bytes below the lowest bit that differs
        same = np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3
        found[live[stop]] = done + same
        live = live[~stop]
        done += WORD
        ended = most[live] <= done
        found[live[ended]] = done
        live = live[~ended]
    values = np.zeros(n, np.int64)
    values[at] = np.minimum(found, most)
    source = np.maximum.accumulate(np.where(alone, np.arange(n), 0))
    return np.maximum(values[source] - (np.arange(n) - source), 0)


def repeated_starts(strings: list[bytes], length: int) -> list[np.ndarray]:
    """Per string, which of its windows of ``length`` bytes also start anywhere else in ``strings``."""
    marks = len(strings)
    sizes = np.array([len(s) for s in strings], np.int64)
    data = np.frombuffer(b"\0".join(strings) + b"\0" * (1 + WORD), np.uint8)
    n = int(sizes.sum()) + marks
    ends = np.cumsum(sizes + 1) - 1
    text = data[:n].astype(np.int64) + marks
    text[ends] = np.arange(marks)[::-1]
    rest = np.repeat(ends, sizes + 1) - np.arange(n)
    sa = suffix_array(text, marks)
    common = permuted_prefixes(data, rest, text, sa)
    long = common >= length
    both = long.copy()
    both[sa[:-1]] |= long[sa[1:]]
    return [both[e - k : max(e - length + 1, e - k)] for e, k in zip(ends.tolist(), sizes.tolist())]

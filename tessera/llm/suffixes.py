"""Suffix arrays by induced sorting, and the permuted common prefixes of neighbours."""

from __future__ import annotations

import numpy as np

#: Texts with at least so many suffixes a bucket are induced bucket by bucket; others suffix by suffix.
BUCKETWISE = 200
#: Symbols with which a shard numbers its cores, after those of the bytes.
DIGITS = 16


def suffix_array(text: np.ndarray, top: int) -> np.ndarray:
    """The suffix array of text, whose last value must be 0 and occur once; values are below top.

    Suffixes are classified as smaller or larger than their successor; the leftmost smaller
    substrings are sorted by inducing, named, and ordered recursively where names repeat;
    one more induction from their order gives that of all suffixes, in linear time.
    """
    n = len(text)
    if n == 1:
        return np.zeros(1, dtype=np.int64)
    smaller = _smaller(text)
    left_most = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    induce = _by_bucket if n >= BUCKETWISE * top else _by_suffix
    order = induce(text, smaller, left_most, top)
    is_left_most = np.zeros(n, dtype=bool)
    is_left_most[left_most] = True
    ordered = order[is_left_most[order]]
    ends = np.full(n, n - 1)
    ends[left_most[:-1]] = left_most[1:]
    names = np.zeros(n, dtype=np.int64)
    names[ordered] = np.cumsum(np.r_[0, _differ(text, ordered[:-1], ordered[1:], ends)])
    reduced = names[left_most]
    kinds = int(names[ordered[-1]]) + 1
    if kinds < len(left_most):
        again = suffix_array(reduced, kinds)
    else:
        again = np.argsort(reduced)
    return induce(text, smaller, left_most[again], top)


def _smaller(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; one that begins with equal values is what the first other value says."""
    n = len(text)
    step = np.sign(np.diff(text))
    turns = np.where(step != 0, np.arange(n - 1), n)
    ahead = np.minimum.accumulate(turns[::-1])[::-1]
    return np.r_[step[np.minimum(ahead, n - 2)] > 0, True]


def _differ(text: np.ndarray, a: np.ndarray, b: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the leftmost smaller substrings at a and b differ."""
    size = ends[a] - a + 1
    out = size != ends[b] - b + 1
    same = np.flatnonzero(~out)
    if len(same):
        size = size[same]
        begins = np.cumsum(size) - size
        inside = np.arange(int(size.sum())) - np.repeat(begins, size)
        equal = text[np.repeat(a[same], size) + inside] == text[np.repeat(b[same], size) + inside]
        out[same] = ~np.logical_and.reduceat(equal, begins)
    return out


def _by_suffix(text: np.ndarray, smaller: np.ndarray, order: np.ndarray, top: int) -> np.ndarray:
    """Place the given suffixes at their buckets' ends; the larger follow from the left, the smaller from the right."""
    sizes = np.bincount(text, minlength=top)
    tails = np.cumsum(sizes)
    start, last = (tails - sizes).tolist(), tails.tolist()
    values, is_smaller, n = text.tolist(), smaller.tolist(), len(text)
    out = [-1] * n
    end = last[:]
    for i in reversed(order.tolist()):
        c = values[i]
        end[c] -= 1
        out[end[c]] = i
    for k in range(n):
        i = out[k] - 1
        if i >= 0 and not is_smaller[i]:
            c = values[i]
            out[start[c]] = i
            start[c] += 1
    end = last
    for k in range(n - 1, -1, -1):
        i = out[k] - 1
        if i >= 0 and is_smaller[i]:
            c = values[i]
            end[c] -= 1
            out[end[c]] = i
    return np.array(out)


def _grouped(items: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Items by value, in the given order: items, their values, their places among equal values, the first of each value."""
    values = text[items]
    by = np.argsort(values, kind="stable")
    values = values[by]
    firsts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    counts = np.diff(np.r_[firsts, len(values)])
    return items[by], values, np.arange(len(values)) - np.repeat(firsts, counts), firsts


def _by_bucket(text: np.ndarray, smaller: np.ndarray, order: np.ndarray, top: int) -> np.ndarray:
    """The same, a bucket at a time: what a bucket's suffixes induce is placed at once; those induced in the bucket itself follow in waves."""
    sizes = np.bincount(text, minlength=top)
    tails = np.cumsum(sizes)
    heads = tails - sizes
    given = np.bincount(text[order], minlength=top)
    out = np.full(len(text), -1)
    items, values, place, _ = _grouped(order, text)
    out[(tails - given)[values] + place] = items
    larger = np.bincount(text[~smaller], minlength=top)

    def before(suffixes: np.ndarray, kind: bool) -> np.ndarray:
        found = suffixes[suffixes > 0] - 1
        return found[smaller[found] == kind]

    start = heads.copy()
    for c in np.flatnonzero(sizes).tolist():
        at, induced = heads[c], []
        while at < start[c]:
            found = before(out[at : start[c]], False)
            own = text[found] == c
            at = start[c]
            chain = found[own]
            out[at : at + len(chain)] = chain
            start[c] += len(chain)
            induced.append(found[~own])
        induced.append(before(out[tails[c] - given[c] : tails[c]], False))
        found = np.concatenate(induced)
        if len(found):
            items, values, place, firsts = _grouped(found, text)
            out[start[values] + place] = items
            start[values[firsts]] += np.diff(np.r_[firsts, len(values)])
    end = tails.copy()
    for c in np.flatnonzero(sizes)[::-1].tolist():
        at, induced = tails[c], []
        while at > end[c]:
            found = before(out[end[c] : at][::-1], True)
            own = text[found] == c
            at = end[c]
            chain = found[own]
            out[at - len(chain) : at] = chain[::-1]
            end[c] -= len(chain)
            induced.append(found[~own])
        induced.append(before(out[heads[c] : heads[c] + larger[c]][::-1], True))
        found = np.concatenate(induced)
        if len(found):
            items, values, place, firsts = _grouped(found, text)
            out[end[values] - 1 - place] = items
            end[values[firsts]] -= np.diff(np.r_[firsts, len(values)])
    return out


def permuted_prefixes(text: np.ndarray, order: np.ndarray, end: int) -> np.ndarray:
    """For each position in text order: the common prefix, up to the next value end, of its suffix with the one before it in the array.

    Where the values in front of both are equal, it is one less than that of the position in front;
    only the others are compared, all at once, value by value.
    """
    n = len(text)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    follows = (at > 0) & (before > 0)
    follows[follows] = (text[at[follows] - 1] == text[before[follows] - 1]) & (text[at[follows] - 1] != end)
    own = np.flatnonzero(~follows & (before >= 0))
    common = np.zeros(n, dtype=np.int64)
    left, k = own, 0
    while len(left):
        left = left[np.maximum(left, before[left]) + k < n]
        left = left[(text[left + k] == text[before[left] + k]) & (text[left + k] != end)]
        common[left] += 1
        k += 1
    last = np.maximum.accumulate(np.where(follows, 0, at))
    return np.where(follows, common[last] - (at - last), common)


def repeated_starts(pieces: list[tuple[bytes, int, int, int]], n_cores: int, length: int) -> list[list[int]]:
    """For each piece (bytes, core, core_end, number of its core): the starts of its strings of this length that start elsewhere too, in it or another piece.

    All strings of that length of a piece cover its core, and pieces of one number have equal cores. So the
    core's bytes stand in the text as the digits of its number: strings are equal if and only if what is
    left of them is, and cores of different numbers never are.
    """
    width = 1
    while DIGITS**width < n_cores:
        width += 1
    parts, begins, at = [], [], 0
    for data, core, core_end, number in pieces:
        digits = [258 + number // DIGITS**k % DIGITS for k in range(width)]
        raw = np.frombuffer(data, dtype=np.uint8).astype(np.int64) + 2
        parts += [raw[:core], np.array(digits), raw[core_end:], [1]]
        begins.append(at)
        at += len(data) - (core_end - core) + width + 1
    text = np.concatenate([*parts, [0]]).astype(np.int64)
    order = suffix_array(text, 258 + DIGITS)
    common = permuted_prefixes(text, order, 1)
    least = np.full(len(text), len(text) + 1)  # of each start, the common prefix that makes its string repeated
    for b, (data, core, core_end, _) in zip(begins, pieces, strict=True):
        least[b : b + len(data) - length + 1] = length - (core_end - core) + width
    repeated = np.flatnonzero(common[order] >= least[order])
    again = np.zeros(len(text), dtype=bool)
    again[order[repeated]] = again[order[repeated - 1]] = True
    return [np.flatnonzero(again[b : b + len(data) - length + 1]).tolist() for b, (data, _, _, _) in zip(begins, pieces, strict=True)]

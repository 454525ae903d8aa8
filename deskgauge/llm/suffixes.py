"""Suffix arrays by induced sorting, and permuted common prefixes, for one shard of text.

The text is classified into smaller and larger suffixes, the substrings between leftmost smaller suffixes are sorted and
named, the string of names is sorted recursively, and two scans over the buckets induce the whole array. The scans run over
blocks of a bucket at a time where the alphabet is small (bytes), and entry by entry on the strings of names.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True for suffixes that are smaller than the next one; equal symbols take the type of their run's end."""
    n = len(t)
    ends = np.append(np.flatnonzero(t[1:] != t[:-1]), n - 1)
    small = np.ones(len(ends), bool)
    small[:-1] = t[ends[:-1]] < t[ends[:-1] + 1]
    return np.repeat(small, np.diff(np.concatenate(([-1], ends))))


def _put(sa: np.ndarray, at: np.ndarray, chars: np.ndarray, values: np.ndarray, step: int) -> None:
    """Append values to their buckets in order; ``at`` holds the next free place, which moves by ``step``."""
    order = np.argsort(chars, kind="stable")
    c = chars[order]
    starts = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
    sizes = np.diff(np.append(starts, len(c)))
    rank = np.arange(len(c)) - np.repeat(starts, sizes)
    sa[at[c] + step * rank] = values[order]
    at[c[starts]] += step * sizes


def _induce(t: np.ndarray, small: np.ndarray, begin: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The array in which larger suffixes, then smaller ones, are induced from ``lms``, given in order within each bucket."""
    n, k = len(t), len(begin) - 1
    sa = np.full(n, -1, np.int32)
    chars = t[lms]
    counts = np.bincount(chars, minlength=k)
    _put(sa, (begin[1:] - counts).astype(np.int64), chars, lms, 1)
    head = begin[:-1].copy()
    for c in range(k):
        at = begin[c]
        while at < head[c]:  # entries that this bucket's own entries add are read in the next round
            block, at = sa[at : head[c]], head[c]
            j = block[block > 0] - 1
            j = j[~small[j]]
            if len(j):
                _put(sa, head, t[j], j, 1)
        if counts[c]:
            block = sa[begin[c + 1] - counts[c] : begin[c + 1]]
            j = block[block > 0] - 1
            if len(j):
                _put(sa, head, t[j], j, 1)
    larger_end = head
    tail = begin[1:] - 1
    for c in range(k - 1, -1, -1):
        at = begin[c + 1] - 1
        while at > tail[c]:
            block, at = sa[tail[c] + 1 : at + 1][::-1], tail[c]
            j = block[block > 0] - 1
            j = j[small[j]]
            if len(j):
                _put(sa, tail, t[j], j, -1)
        block = sa[begin[c] : larger_end[c]][::-1]
        j = block[block > 0] - 1
        j = j[small[j]]
        if len(j):
            _put(sa, tail, t[j], j, -1)
    if n:
        sa[0] = n - 1
    return sa


def _names(t: np.ndarray, order: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers of the substrings between leftmost smaller suffixes, in text order; equal substrings share one."""
    place = np.empty(len(t), np.int32)
    place[lms] = np.arange(len(lms), dtype=np.int32)
    size = np.append(np.diff(lms), 0)  # up to the next one, which is compared as well; the sentinel stands alone
    mine = place[order]
    a, b = order[:-1], order[1:]
    same = (size[mine[:-1]] == size[mine[1:]]) & (size[mine[:-1]] > 0)
    active = np.flatnonzero(same)
    depth = 0
    while len(active):
        equal = t[a[active] + depth] == t[b[active] + depth]
        same[active[~equal]] = False
        active = active[equal]
        active = active[size[mine[active]] > depth]
        depth += 1
    number = np.concatenate(([0], np.cumsum(~same)))
    names = np.empty(len(lms), np.int64)
    names[mine] = number
    return names, int(number[-1]) + 1


def _sort_names(t: np.ndarray, k: int) -> np.ndarray:
    """Induced sorting of a string of numbers below ``k`` that ends with its only 0; its scans go entry by entry."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    types = _types(t)
    lms = np.flatnonzero(types[1:] & ~types[:-1]) + 1
    sizes = np.bincount(t, minlength=k)
    ends = np.cumsum(sizes)
    begin, end = (ends - sizes).tolist(), ends.tolist()
    s, small = t.tolist(), types.tobytes()

    def induce(order: list[int]) -> np.ndarray:
        sa = [0] * n  # 0 has nothing before it, so it also stands for a free place
        tail = end.copy()
        for i in reversed(order):
            c = s[i]
            at = tail[c] - 1
            tail[c] = at
            sa[at] = i
        head = begin.copy()
        for x in sa:  # the iterator sees what the scan writes ahead of it
            if x and not small[x - 1]:
                c = s[x - 1]
                at = head[c]
                sa[at] = x - 1
                head[c] = at + 1
        tail = end.copy()
        for x in reversed(sa):
            if x and small[x - 1]:
                c = s[x - 1]
                at = tail[c] - 1
                tail[c] = at
                sa[at] = x - 1
        sa[0] = n - 1
        return np.array(sa)

    if not len(lms):
        return induce([])
    sa = induce(lms.tolist())
    marked = np.zeros(n, bool)
    marked[lms] = True
    order = sa[marked[sa]]
    names, number = _names(t, order, lms)
    if number < len(lms):
        order = lms[_sort_names(names, number)]
    return induce(order.tolist())


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of small numbers (uint16) that end with their only 0."""
    n = len(text)
    if n <= 1:
        return np.zeros(n, np.int32)
    small = _types(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    begin = np.concatenate(([0], np.cumsum(np.bincount(text)))).astype(np.int64)
    sa = _induce(text, small, begin, lms)
    marked = np.zeros(n, bool)
    marked[lms] = True
    order = sa[marked[sa]]
    names, k = _names(text, order, lms)
    if k < len(lms):
        order = lms[_sort_names(names, k)]
    return _induce(text, small, begin, order)


def permuted_prefixes(text: np.ndarray, sa: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the suffix before it in the array (-1 for the first) and their common prefix.

    The prefix ends where ``room`` (symbols up to the end of a position's own piece) does for either. In text order it falls
    by one from a position to the next while the symbols to the left of both suffixes are equal; only the others are compared.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    left = np.maximum(before, 0)
    goes_on = np.zeros(n, bool)
    goes_on[1:] = (before[1:] > 0) & (text[:-1] == text[left[1:] - 1]) & (room[:-1] > 0)
    fresh = np.flatnonzero(~goes_on & (before >= 0))
    limit = np.minimum(room[fresh], room[left[fresh]])
    found = np.zeros(len(fresh), np.int64)
    active = np.flatnonzero(limit > 0)
    step = 8
    padded = np.concatenate([text, np.zeros(512, text.dtype)])
    while len(active):
        i, j = fresh[active] + found[active], left[fresh[active]] + found[active]
        span = np.arange(step)
        equal = padded[i[:, None] + span] == padded[j[:, None] + span]
        run = np.where(equal.all(1), step, equal.argmin(1))
        found[active] += run
        active = active[(run == step) & (found[active] < limit[active])]
        step = min(step * 2, 256)
    found = np.minimum(found, limit)
    prefix = np.zeros(n, np.int64)
    prefix[fresh] = found
    start = np.zeros(n, np.int64)
    start[fresh] = fresh
    start = np.maximum.accumulate(start)
    prefix = np.where(goes_on, np.maximum(prefix[start] - (at - start), 0), prefix)
    return before, np.minimum(prefix, np.minimum(room, room[left]))

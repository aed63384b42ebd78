"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are classified, leftmost-smaller substrings are sorted by inducing and named, the
string of names is sorted, and all suffixes are induced from it; whole buckets of bytes are
induced at a time with array operations.
"""

from __future__ import annotations

import numpy as np


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (the end is smaller than all)."""
    size = len(text)
    ends = np.append(np.flatnonzero(text[1:] != text[:-1]), size - 1)
    smaller = np.zeros(len(ends), dtype=bool)
    smaller[:-1] = text[ends[:-1]] < text[ends[:-1] + 1]
    return np.repeat(smaller, np.diff(ends, prepend=-1))


def _ranks(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by key, each sorted item's rank among equal keys, and counts."""
    order = np.argsort(keys, kind="stable")
    count = np.bincount(keys, minlength=buckets)
    begin = np.cumsum(count) - count
    return order, np.arange(len(keys)) - begin[keys[order]], count


def _induce(text: np.ndarray, small: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost-smaller suffixes in order."""
    size = len(text)
    count = np.bincount(text, minlength=256)
    tail = np.cumsum(count)
    head = tail - count
    out = np.full(size, -1, dtype=np.int64)
    keys = text[starts]
    order, rank, placed = _ranks(keys, 256)
    first = tail - placed
    out[first[keys[order]] + rank] = starts[order]
    fill = head.copy()

    def push(found: np.ndarray) -> None:
        if not len(found):
            return
        chars = text[found]
        order, rank, number = _ranks(chars, 256)
        out[fill[chars[order]] + rank] = found[order]
        fill[:] += number

    push(np.array([size - 1]))
    for char in range(256):
        if not count[char]:
            continue
        at = head[char]
        while at < fill[char]:
            stop = fill[char]
            before = out[at:stop] - 1
            before = before[before >= 0]
            push(before[~small[before]])
            at = stop
        before = out[first[char]:tail[char]] - 1
        before = before[before >= 0]
        push(before[~small[before]])
    # Smaller suffixes from the right; those placed above are found anew.
    last = fill
    fill = tail.copy()

    def pull(found: np.ndarray) -> None:
        if not len(found):
            return
        chars = text[found]
        order, rank, number = _ranks(chars, 256)
        out[fill[chars[order]] - 1 - rank] = found[order]
        fill[:] -= number

    for char in range(255, -1, -1):
        if not count[char]:
            continue
        at = tail[char]
        while at > fill[char]:
            stop = fill[char]
            before = out[stop:at][::-1] - 1
            before = before[before >= 0]
            pull(before[small[before]])
            at = stop
        before = out[head[char]:last[char]][::-1] - 1
        before = before[before >= 0]
        pull(before[small[before]])
    return out


def _names(text: np.ndarray, ordered: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Rank of each leftmost-smaller substring, equal ones sharing it; in the order given."""
    size = length[ordered]
    differ = np.ones(len(ordered), dtype=bool)
    same = np.flatnonzero(size[1:] == size[:-1]) + 1
    a, b, left = ordered[same], ordered[same - 1], size[same]
    step = 0
    equal = np.ones(len(same), dtype=bool)
    active = np.arange(len(same))
    while len(active):
        ok = text[a[active] + step] == text[b[active] + step]
        equal[active[~ok]] = False
        step += 1
        active = active[ok & (left[active] > step)]
    differ[same[equal]] = False
    return np.cumsum(differ) - 1


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of a byte array."""
    size = len(text)
    if size < 2:
        return np.arange(size)
    small = _types(text)
    is_start = np.zeros(size, dtype=bool)
    is_start[1:] = small[1:] & ~small[:-1]
    starts = np.flatnonzero(is_start)
    if not len(starts):
        return _induce(text, small, starts)
    length = np.zeros(size, dtype=np.int64)
    # The last one is ended by the end of the text, which equals nothing.
    length[starts[:-1]] = np.diff(starts) + 1
    rough = _induce(text, small, starts)
    ordered = rough[is_start[rough]]
    names = _names(text, ordered, length)
    if names[-1] + 1 < len(ordered):
        number = np.zeros(size, dtype=np.int64)
        number[ordered] = names
        ordered = starts[_reduced_array(number[starts])]
    return _induce(text, small, ordered)


def _reduced_array(names: np.ndarray) -> np.ndarray:
    """Suffix array of the string of substring names.

    The reduced string is sorted by the ranks of ever longer prefixes (twice as long each
    time) until all differ: names have far too many small buckets to induce them in arrays.
    """
    size = len(names)
    rank, width = names.astype(np.int64), 1
    while True:
        after = np.full(size, -1, dtype=np.int64)
        after[:size - width] = rank[width:]
        key = (rank + 1) * (size + 2) + after + 1
        order = np.argsort(key, kind="stable")
        fresh = np.ones(size, dtype=bool)
        fresh[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(size, dtype=np.int64)
        rank[order] = np.cumsum(fresh) - 1
        width *= 2
        if fresh.all() or width >= size:
            return order


def common_prefixes(text: np.ndarray, array: np.ndarray) -> np.ndarray:
    """For each suffix in order, the length of the prefix it shares with the one before it.

    Permuted to text order, a value falls by one from place to place unless the bytes before
    the two suffixes differ; only there the suffixes are compared.
    """
    size = len(text)
    if not size:
        return np.zeros(0, dtype=np.int64)
    before = np.full(size, -1, dtype=np.int64)
    before[array[1:]] = array[:-1]
    fresh = np.ones(size, dtype=bool)
    follow = np.flatnonzero(before[1:] > 0) + 1
    fresh[follow[text[follow - 1] == text[before[follow] - 1]]] = False
    start = np.flatnonzero(fresh)
    other = before[start]
    found = np.zeros(len(start), dtype=np.int64)
    padded = np.concatenate((text, np.zeros(8, dtype=np.uint8)))
    cells = np.lib.stride_tricks.as_strided(
        padded.view(np.uint8), shape=(size, 8), strides=(1, 1))
    active = np.flatnonzero(other >= 0)
    while len(active):
        i, j = start[active] + found[active], other[active] + found[active]
        room = size - np.maximum(i, j)
        inside = room > 0
        active, i, j, room = active[inside], i[inside], j[inside], room[inside]
        if not len(active):
            break
        equal = cells[i] == cells[j]
        same = np.where(equal.all(axis=1), 8, equal.argmin(axis=1))
        step = np.minimum(same, room)
        found[active] += step
        active = active[step == 8]
    at = np.arange(size)
    source = np.maximum.accumulate(np.where(fresh, at, 0))
    place = np.cumsum(fresh) - 1
    permuted = found[place] - (at - source)
    return np.maximum(permuted[array], 0)

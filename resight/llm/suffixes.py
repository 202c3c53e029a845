"""Suffix arrays of byte strings: Larsson-Sadakane refinement, Kasai common prefixes, merging by binary search."""

from __future__ import annotations

import numpy as np


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of `data` (bytes) in the order of their suffixes, and the rank of every position.

    Suffixes are first sorted by five bytes. Then groups of equal prefixes are refined: within a group, the rank of the
    suffix one prefix length further on decides, and the length sorted by doubles. Suffixes that stand alone are final.
    """
    n = len(data)
    if n == 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    bits = max(1, (n - 1).bit_length())
    low = np.uint64((1 << bits) - 1)
    padded = np.concatenate([data.astype(np.uint64) + np.uint64(1), np.zeros(5, dtype=np.uint64)])
    depth = 4 if bits > 24 else 5
    first = np.zeros(n, dtype=np.uint64)
    for at in range(depth):
        first = first * np.uint64(257) + padded[at : at + n]
    if bits + 8 * depth + 1 <= 64:
        order = np.sort((first << np.uint64(bits)) | np.arange(n, dtype=np.uint64))
        sa = (order & low).astype(np.int64)
        head = order >> np.uint64(bits)
        new = np.ones(n, dtype=bool)
        new[1:] = head[1:] != head[:-1]
    else:
        sa = np.argsort(first, kind="stable")
        new = np.ones(n, dtype=bool)
        new[1:] = first[sa][1:] != first[sa][:-1]
    rank = np.empty(n, dtype=np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    alone = new & np.append(new[1:], True)
    slot = np.flatnonzero(~alone)  # places in the order that are not final
    while slot.size:
        at = sa[slot]
        own = rank[at]
        further = at + depth
        second = np.where(further < n, rank[np.minimum(further, n - 1)] + 1, 0)
        if 2 * bits + 1 + max(1, int(slot.size - 1).bit_length()) <= 64:
            few = np.uint64(max(1, int(slot.size - 1).bit_length()))
            key = (own.astype(np.uint64) << np.uint64(bits + 1)) | second.astype(np.uint64)
            order = np.sort((key << few) | np.arange(slot.size, dtype=np.uint64))
            perm = (order & ((np.uint64(1) << few) - np.uint64(1))).astype(np.int64)
        else:
            perm = np.lexsort((second, own))
        at, own, second = at[perm], own[perm], second[perm]
        sa[slot] = at
        group = np.ones(slot.size, dtype=bool)
        group[1:] = own[1:] != own[:-1]
        new = group.copy()
        new[1:] |= second[1:] != second[:-1]
        rank[at] = slot[np.maximum.accumulate(np.where(new, np.arange(slot.size), 0))]
        slot = slot[~(new & np.append(new[1:], True))]
        depth *= 2
    return sa, rank


def common_prefixes(data: np.ndarray, sa: np.ndarray, rank: np.ndarray, most: int, lanes: int = 2048) -> np.ndarray:
    """For every position, how many bytes its suffix shares with the one before it in order, counted up to `most`.

    Kasai's walk: in text order the number falls by at most one per step, so a comparison starts where the last one
    ended. The text is walked in many lanes at once, each starting from nothing.
    """
    n = len(data)
    shared = np.zeros(n, dtype=np.int64)
    if n == 0:
        return shared
    prior = np.full(n, -1, dtype=np.int64)
    prior[sa[1:]] = sa[:-1]
    step = max(1, -(-n // lanes))
    begin = np.arange(0, n, step)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    words = np.ndarray((n + 1,), dtype="<u8", buffer=padded.tobytes(), strides=(1,))
    length = np.zeros(len(begin), dtype=np.int64)
    for turn in range(step):
        at = begin + turn
        inside = at < n
        if not inside.all():
            begin, length, at = begin[inside], length[inside], at[inside]
        other = prior[at]
        length = np.where(other < 0, 0, np.maximum(length - 1, 0))
        going = np.flatnonzero((other >= 0) & (length < most))
        while going.size:
            left, right = at[going] + length[going], other[going] + length[going]
            room = n - np.maximum(left, right)
            differ = words[np.minimum(left, n)] ^ words[np.minimum(right, n)]
            # Equal bytes at the low end: the place of the lowest bit set.
            lowest = differ & (~differ + np.uint64(1))
            equal = np.where(differ == 0, 8, np.bitwise_count(lowest - np.uint64(1)).astype(np.int64) // 8)
            equal = np.minimum(equal, room)
            length[going] += equal
            going = going[(equal == 8) & (length[going] < most)]
        length = np.minimum(length, most)
        shared[at] = length
    return shared


def repeated_starts(data: np.ndarray, valid: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which valid starts have a `width`-byte string that another valid start has too, and a name for each string.

    `valid` marks starts whose string lies within one text. Strings are equal where neighbours in order share `width`
    bytes; a run of such neighbours has one name.
    """
    sa, rank = suffix_array(data)
    shared = common_prefixes(data, sa, rank, width)
    linked = shared[sa] >= width  # with the one before
    name = np.cumsum(~linked)
    # Only valid starts count as partners; a valid one's string holds no separator, so its whole run is valid.
    count = np.bincount(name[valid[sa]], minlength=int(name[-1]) + 1 if len(name) else 1)
    names = np.empty(len(data), dtype=np.int64)
    names[sa] = name
    return valid & (count[names] > 1), names


def found_in(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """How often each wanted value stands in a sorted run, by binary search from both ends."""
    return np.searchsorted(sorted_values, wanted, "right") - np.searchsorted(sorted_values, wanted, "left")

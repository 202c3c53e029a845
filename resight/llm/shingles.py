"""Word shingles of whole texts as 64-bit hashes, and MinHash samples of them."""

from __future__ import annotations

import numpy as np

from resight.llm.common import drawn, mixed

WORDS = 5


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word, A-Z taken as a-z, and the first word of each text (and the number of words)."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    letter = np.ones(256, dtype=bool)
    letter[[32, *range(9, 14)]] = False
    inside = letter[data]
    first, last = inside.copy(), inside.copy()
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[starts] = True
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not begin.size:
        return np.empty(0, dtype=np.uint64), np.zeros(len(starts), dtype=np.int64)
    size = end - begin
    at = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(at, size)
    power = np.empty(int(size.max()), dtype=np.uint64)
    power[0], power[1:] = 1, np.uint64(0xD6E8FEB86659FD93)
    np.multiply.accumulate(power, out=power)
    letters = drawn(1, 256)[lower]
    sums = np.add.reduceat(letters[data[inside]] * power[place], at)
    hashes = mixed(sums + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return hashes, np.searchsorted(begin, starts)


def shingle_sets(data: np.ndarray, starts: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text: `words` words each, or all the words of a shorter text."""
    hashes, first = word_hashes(data, starts)
    factors = drawn(2, words) | np.uint64(1)
    n = len(hashes)
    whole = max(0, n - words + 1)
    joined = np.zeros(whole, dtype=np.uint64)
    for j in range(words):
        joined += hashes[j : whole + j] * factors[j]
    joined = mixed(joined)
    out = []
    bounds = first.tolist()
    for begin, end in zip(bounds, bounds[1:]):
        count = end - begin
        if count >= words:
            order = np.sort(joined[begin : end - words + 1])
            new = np.ones(len(order), dtype=bool)
            new[1:] = order[1:] != order[:-1]
            out.append(order[new])
        elif count:
            short = (hashes[begin:end] * factors[:count]).sum(dtype=np.uint64) + np.uint64(count)
            out.append(mixed(np.array([short], dtype=np.uint64)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def minhash(members: np.ndarray, samples: int, seed: int = 3) -> np.ndarray:
    """The least value of each of `samples` hash functions over a set that is not empty."""
    factors, masks = drawn(seed, samples) | np.uint64(1), drawn(seed + 1, samples)
    least = np.full(samples, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(members), 1024):
        part = members[start : start + 1024]
        np.minimum(least, ((part ^ masks[:, None]) * factors[:, None]).min(axis=1), out=least)
    return least


def band_keys(samples: np.ndarray, rows: int) -> np.ndarray:
    """A key per document and band of `rows` samples; equal keys mean equal samples in the same band."""
    count, width = samples.shape
    bands = width // rows
    factors = (drawn(5, width) | np.uint64(1)).reshape(bands, rows)
    joined = (samples[:, : bands * rows].reshape(count, bands, rows) * factors).sum(axis=2, dtype=np.uint64)
    return mixed(joined + np.arange(bands, dtype=np.uint64))


def odd_sketches(sets: list[np.ndarray], bins: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Per set a bitmap with a bit for the parity of the samples that fall on it, and the bitmap of filled bins.

    The samples come from one permutation: the hash range is cut into `bins` (a power of two) and the least member of
    each is a sample. Two sets have similarity J if a share J of the bins that either fills holds the same sample.
    """
    count, shift = len(sets), np.uint64(64 - (bins.bit_length() - 1))
    flat = np.concatenate([np.empty(0, dtype=np.uint64), *sets])
    owner = np.repeat(np.arange(count), [len(s) for s in sets])
    bin_of = owner * bins + (flat >> shift).astype(np.int64)
    first = np.ones(len(flat), dtype=bool)
    first[1:] = bin_of[1:] != bin_of[:-1]  # members are sorted, so the least of a bin comes first
    places = owner[first] * bits + (mixed(flat[first]) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(places, minlength=count * bits) & 1).astype(np.uint8).reshape(count, bits)
    filled = np.zeros(count * bins, dtype=np.uint8)
    filled[bin_of[first]] = 1
    return np.packbits(odd, axis=1).view(np.uint64), np.packbits(filled.reshape(count, bins), axis=1).view(np.uint64)

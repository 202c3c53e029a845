"""Byte-level BPE encoding and decoding.

A piece of text is a row of bytes. A segment tree over its byte positions keeps, for every live position, the rank of
the pair that starts there; the root holds the smallest rank and, among equal ones, the leftmost position. A merge
changes three leaves (the pair itself, the one before it and the one it swallows), so it costs three walks to the root.
Short pieces run through such trees side by side, one lane of an array each; long ones have a tree of their own.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from resight.llm.common import small_batches, worker_store

#: Pieces up to this many bytes share lanes.
LANE_BYTES = 64
#: Encoded pieces remembered by a worker. A full store starts anew; ids do not depend on it.
REMEMBERED = 600_000


class Vocabulary:
    """Ranks of byte strings, and for every pair of tokens the token it makes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.words = {rank: word for word, rank in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for word, rank in ranks.items():
            for cut in range(1, len(word)):
                left, right = ranks.get(word[:cut]), ranks.get(word[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        self.pairs = pairs
        self.shared = list(range(self.size))  # one object per id, however often it is remembered
        # An open hash table of pairs: a key sits at the first free slot from its own on.
        self.slots = 1 << (4 * len(pairs)).bit_length()
        keys = np.fromiter(pairs, dtype=np.int64, count=len(pairs))
        self.pair_keys = np.full(self.slots, -1, dtype=np.int64)
        self.pair_ranks = np.zeros(self.slots, dtype=np.int64)
        slot = self.slot_of(keys)
        while keys.size:
            taken, one = np.unique(slot, return_index=True)
            one = one[self.pair_keys[taken] < 0]
            self.pair_keys[slot[one]] = keys[one]
            self.pair_ranks[slot[one]] = [pairs[k] for k in keys[one].tolist()]
            rest = np.ones(keys.size, dtype=bool)
            rest[one] = False
            keys, slot = keys[rest], (slot[rest] + 1) % self.slots

    @classmethod
    def read(cls, path: str) -> "Vocabulary":
        """Ranks from a file of lines `base64 rank`."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)})

    def slot_of(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.slots.bit_length() + 1)).astype(np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray, none: int) -> np.ndarray:
        """The rank of each pair; `none` where the two tokens make no token."""
        key = left * self.size + right
        flat = key.ravel()
        slot = self.slot_of(flat)
        found = self.pair_keys.take(slot)
        out = np.where(found == flat, self.pair_ranks.take(slot), none)
        rest = np.nonzero((found != flat) & (found >= 0))[0]
        slot = slot[rest]
        while rest.size:
            slot = (slot + 1) % self.slots
            found = self.pair_keys.take(slot)
            hit = found == flat[rest]
            out[rest[hit]] = self.pair_ranks.take(slot[hit])
            more = ~hit & (found >= 0)
            rest, slot = rest[more], slot[more]
        return out.reshape(key.shape)


def encode_lanes(vocabulary: Vocabulary, pieces: list[bytes], width: int) -> list[tuple[int, ...]]:
    """Merge many pieces of at most `width` bytes (a power of two) side by side."""
    none = vocabulary.size  # a rank no pair has
    lanes, bits = len(pieces), width.bit_length() - 1
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8)
    length = np.fromiter(map(len, pieces), dtype=np.int64, count=lanes)
    place = np.arange(width)
    live = (place < length[:, None]).ravel()
    token = vocabulary.byte_ids[raw]
    # Places are counted over all lanes; a lane has one more place in the links, for its end.
    after = np.minimum(place + 1, length[:, None]).ravel()
    before = np.tile(np.arange(-1, width), lanes)
    # A node holds rank * width + position: its minimum is the leftmost pair of the lowest rank.
    dead = none << bits
    tree = np.full((lanes, 2 * width), dead, dtype=np.int64)
    by_lane = token.reshape(lanes, width)
    first = vocabulary.rank_of(by_lane[:, :-1], by_lane[:, 1:], none)
    has = (place[:-1] + 1 < length[:, None]) & (first < none)
    tree[:, width : 2 * width - 1] = np.where(has, (first << bits) + place[:-1], dead)
    half = width // 2
    while half:
        tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
        half //= 2
    tree = tree.ravel()
    lane = np.nonzero(tree[1 :: 2 * width] < dead)[0]
    root = tree[lane * (2 * width) + 1]
    while lane.size:
        made, at = root >> bits, root & (width - 1)
        base, links, top, end = lane * width, lane * (width + 1), lane * (2 * width), length[lane]
        gone = after.take(base + at)
        beyond = after.take(base + gone)
        prior = before.take(links + at)
        token[base + at] = made
        live[base + gone] = False
        after[base + at] = beyond
        before[links + beyond] = at
        ends, starts = beyond >= end, prior < 0
        after_token = token.take(base + np.where(ends, 0, beyond))
        prior_token = token.take(base + np.where(starts, 0, prior))
        ranks = vocabulary.rank_of(np.concatenate([made, prior_token]), np.concatenate([after_token, made]), none)
        ranks[: lane.size][ends] = none
        ranks[lane.size :][starts] = none
        here = np.where(starts, at, prior)  # where nothing stands before, the middle leaf is written a second time
        tree[top + width + gone] = dead
        tree[top + width + here] = np.minimum((ranks[lane.size :] << bits) + here, dead)
        tree[top + width + at] = np.minimum((ranks[: lane.size] << bits) + at, dead)
        who = np.concatenate([top, top, top])
        node = np.concatenate([gone, at, here]) + width
        for _ in range(bits):
            node >>= 1
            child = who + 2 * node
            tree[who + node] = np.minimum(tree.take(child), tree.take(child + 1))
        root = tree.take(top + 1)
        more = root < dead
        lane, root = lane[more], root[more]
    ids = list(map(vocabulary.shared.__getitem__, token[live].tolist()))
    out, start = [], 0
    for n in live.reshape(lanes, width).sum(axis=1).tolist():
        out.append(tuple(ids[start : start + n]))
        start += n
    return out


def encode_long(vocabulary: Vocabulary, piece: bytes) -> tuple[int, ...]:
    """The same merges for one long piece, with a tree in plain lists."""
    n, pairs, size = len(piece), vocabulary.pairs, vocabulary.size
    token = [int(vocabulary.byte_ids[b]) for b in piece]
    after, before = list(range(1, n + 1)), list(range(-1, n))
    width = 1 << max(1, (n - 1).bit_length())
    dead = size * width
    tree = [dead] * (2 * width)
    for at in range(n - 1):
        rank = pairs.get(token[at] * size + token[at + 1])
        if rank is not None:
            tree[width + at] = rank * width + at
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def put(at: int, left: int, right: int) -> None:
        rank = pairs.get(token[left] * size + token[right]) if left >= 0 and right < n else None
        node = width + at
        tree[node] = dead if rank is None else rank * width + at
        while node > 1:
            node >>= 1
            least = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == least:
                break
            tree[node] = least

    while tree[1] < dead:
        made, at = divmod(tree[1], width)
        gone = after[at]
        token[at], after[at] = made, after[gone]
        if after[gone] <= n:
            before[after[gone]] = at
        put(gone, -1, n)
        put(at, at, after[at])
        if before[at] >= 0:
            put(before[at], before[at], at)
    out, at = [], 0
    while at < n:
        out.append(token[at])
        at = after[at]
    return tuple(out)


class Encoder:
    """Ids of whole texts; remembers the ids of pieces it has seen."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.find = vocabulary, regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def learn(self, pieces: set[str]) -> None:
        ranks, known, waiting = self.vocabulary.ranks, self.known, {}
        for piece in pieces:
            raw = piece.encode()
            rank = ranks.get(raw)
            if rank is not None:
                known[piece] = (rank,)
            elif len(raw) <= LANE_BYTES:
                waiting.setdefault(1 << (len(raw) - 1).bit_length(), []).append((piece, raw))
            else:
                known[piece] = encode_long(self.vocabulary, raw)
        for width, group in waiting.items():
            step = max(1, 32_768 // width)
            for start in range(0, len(group), step):
                part = group[start : start + step]
                known.update(zip((p for p, _ in part), encode_lanes(self.vocabulary, [r for _, r in part], width)))

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        found = [self.find(text) for text in texts]
        new = set(chain.from_iterable(found)).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = set(chain.from_iterable(found))
        self.learn(new)
        lookup = self.known.__getitem__
        for pieces in found:
            yield list(chain.from_iterable(map(lookup, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.words.__getitem__, ids))


def worker_encoder(path: str, pattern: str) -> Encoder:
    held = worker_store("bpe")
    if (path, pattern) not in held:
        held[path, pattern] = Encoder(Vocabulary.read(path), pattern)
    return held[path, pattern]


def plain_row(ids: list[int], decoded: bytes) -> dict:
    return {"ids": ids, "decoded": decoded}


def encode_documents(
    df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
    row: Callable[[list[int], bytes], dict] = plain_row, fields: str = "ids array<int>, decoded binary",
) -> DataFrame:
    """Encode every whole text with the ranks in `path` and decode its ids again.

    Returns `id_col` and what `row(ids, decoded)` gives, by default the ids and the decoded bytes; one row per input row.
    A null or empty text has no ids and decodes to no bytes. Repeated rows, ties and null ids pass through as they are,
    an empty table gives an empty one, other columns are not read. A text is never cut; one text must fit in a task.
    """
    slim = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, {fields}"
    target = to_arrow_schema(StructType.fromDDL(fields))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            encoder = worker_encoder(path, pattern)
            rows = [row(ids, encoder.decode(ids)) for ids in encoder.encode(batch.column("text").to_pylist())]
            made = pa.Table.from_pylist(rows, schema=target)
            columns = [batch.column("id"), *(c.combine_chunks() for c in made.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, *made.column_names])

    return slim.mapInArrow(work, schema)

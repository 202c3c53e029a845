"""Best-fit packing by sums of squares.

A shard of pieces is packed one piece at a time, the longest first. With N(g) open sequences that have g places left, a
piece goes where the sum of N(g) squared over all g becomes smallest: into an open sequence or a new one. Sequences
that a shard leaves unfilled are opened again and packed in fewer shards, until one shard has packed what is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resight.llm.common import small_batches
from resight.llm.tokens import load_encoder
from resight.session import cut_and_observe

#: Pieces that one task packs.
SHARD_ROWS = 65_536


def token_pieces(
    df: DataFrame, ranks_path: str, pattern: str, added_path: str | None, end_id: int, capacity: int,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """id, piece, start, length, ids_crc32 of every document: its ids, then `end_id`, cut into pieces.

    Only documents longer than `capacity` are cut; all their pieces but the first are full.
    """
    slim = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in small_batches(batches, "text"):
            encoder = load_encoder(ranks_path, pattern, added_path)
            rows = []
            for at, text in enumerate(batch.column("text").to_pylist()):
                raw = memoryview(encoder.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes() + end)
                total = len(raw) // 4
                start, piece, length = 0, 0, (total - 1) % capacity + 1
                while start < total:
                    rows.append((at, piece, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)])))
                    start, piece, length = start + length, piece + 1, capacity
            at, piece, start, length, crc = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["id", "piece", "start", "length", "ids_crc32"])

    return slim.mapInArrow(work, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and offset of every piece, in the given order, and the places each sequence has left."""
    count = np.zeros(capacity, dtype=np.int64)  # open sequences by places left; nothing at 0
    open_at: list[list[int]] = [[] for _ in range(capacity)]
    filled: list[int] = []
    where, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    never = np.iinfo(np.int64).max
    for at, size in enumerate(lengths.tolist()):
        # The change of the sum, halved and less one: N(g - size) - N(g) for an open sequence, half a step less where it
        # is filled exactly; N(capacity - size) and half a step less for a new one.
        best, cost = capacity, 2 * int(count[capacity - size]) - 1 if size < capacity else -2
        if size < capacity:
            gaps = count[size:]
            change = 2 * (count[: capacity - size] - gaps)
            change[0] -= 1
            change[gaps == 0] = never
            k = int(change.argmin())
            if change[k] <= cost:
                best = size + k
        if best == capacity:
            name = len(filled)
            filled.append(0)
        else:
            name = open_at[best].pop()
            count[best] -= 1
        where[at], offset[at] = name, filled[name]
        filled[name] += size
        left = best - size
        if left:
            open_at[left].append(name)
            count[left] += 1
    return where, offset, capacity - np.array(filled, dtype=np.int64)


def pack_shard(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `sum_of_squares`; sequences left unfilled are opened again and packed anew while that saves any."""
    where, offset, room = sum_of_squares(lengths, capacity)
    while True:
        again = np.nonzero(room[where] > 0)[0]
        there, places, left = sum_of_squares(lengths[again], capacity)
        if len(left) >= len(np.unique(where[again])):
            return where, offset, room
        where[again], offset[again] = there + len(room), places
        room = np.concatenate([room, left])


def shard_packer(capacity: int, mark: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Packs one shard; its sequences are numbered from `mark` plus the shard's own range."""

    def work(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "_row"], ascending=[False, True], ignore_index=True)
        where, offset, room = pack_shard(part["length"].to_numpy(), capacity)
        return part.assign(sequence_id=mark + (int(key[0]) << 26) + where, offset=offset, _room=room[where])

    return work


def pack_pieces(pieces: DataFrame, capacity: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The columns of `pieces` (length of 1 to capacity, and others) with sequence_id and offset.

    A piece of full length is a sequence by itself. Every other one is dealt to a shard by a hash of its place in the
    table, so pieces of one document or of equal rows spread; a shard is `shard_rows` pieces in the mean. Rows without a
    length, or with one outside 1 to capacity, are the caller's error; other columns may be null; ties and repeated rows
    each get a place of their own; an empty table gives an empty one.
    """
    spark = pieces.sparkSession
    names = pieces.columns
    rows, seen = cut_and_observe(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces",
                                 F.count(F.when(F.col("length") < capacity, 1)).alias("n"))
    schema = rows.schema
    done = [rows.where(F.col("length") == capacity).select(*names, F.col("_row").alias("sequence_id"),
                                                           F.lit(0).cast("long").alias("offset"))]
    todo, left, turn = rows.where(F.col("length") < capacity), seen["n"], 0
    while left:
        shards = -(-left // shard_rows)
        turn += 1
        mark = turn << 58

        dealt = todo.withColumn("_shard", F.pmod(F.xxhash64("_row", F.lit(turn)), F.lit(shards)))
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        packed = dealt.groupBy("_shard").applyInPandas(
            shard_packer(capacity, mark), f"{fields}, _shard bigint, sequence_id bigint, offset bigint, _room bigint")
        packed, seen = cut_and_observe(packed, "packed", F.count(F.when(F.col("_room") > 0, 1)).alias("n"))
        if shards == 1:
            done.append(packed.select(*names, "sequence_id", "offset"))
            break
        done.append(packed.where("_room = 0").select(*names, "sequence_id", "offset"))
        # What is left must fit in fewer shards, or a further round could be without end.
        stuck = -(-seen["n"] // shard_rows) >= shards
        if stuck or not seen["n"]:
            done.append(packed.where("_room > 0").select(*names, "sequence_id", "offset"))
            break
        todo, left = packed.where("_room > 0").select(*[f.name for f in schema]), seen["n"]
    out = done[0]
    for part in done[1:]:
        out = out.unionAll(part)
    return out


def pack_documents(
    df: DataFrame, ranks_path: str, pattern: str, added_path: str | None = None, end_id: int = 2, capacity: int = 1024,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """`id_col`, piece, start, length, ids_crc32, sequence_id, offset: every piece once.

    A null or empty text is the end id alone. Repeated rows are packed as often as they stand, null ids are kept, an
    empty table gives an empty one, other columns are not read. Very long texts give many full pieces.
    """
    pieces = token_pieces(df, ranks_path, pattern, added_path, end_id, capacity, id_col, text_col)
    packed = pack_pieces(pieces, capacity)
    return packed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

"""Removal of byte strings that occur more than once, by suffix arrays of shards.

Sorting every suffix of a large corpus together is out of reach, and most suffixes have no equal. So each text is first
cut at anchors: of any `width` consecutive bytes, the position whose 64-byte gram has the least hash (the leftmost of
equal ones) is the anchor of the string that starts there. Equal strings have equal anchors at the same distance, so
only strings whose anchor's gram occurs elsewhere can repeat, and equal strings meet by gram.

The strings of one anchor lie in one stretch of text. A gram whose stretches are all equal is settled by counting. The
different stretches of a gram go to a shard: a suffix array and common prefixes tell which of their strings repeat. A
gram of very many different stretches is dealt to several shards; the strings that stay alone in their shard are then
looked up in what the other shards of the gram hold, by binary search in sorted runs of 128-bit digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resight.llm.common import flat_bytes, small_batches
from resight.llm.suffixes import found_in, repeated_starts
from resight.session import cut, cut_and_observe, discard

GRAM = 64


@dataclass(frozen=True)
class PassageParams:
    width: int = 400
    #: Different stretches of one gram in a shard; a stretch has fewer than 2 * width bytes.
    shard_stretches: int = 2048
    #: Bytes of stretches that are sorted together.
    shard_bytes: int = 1 << 20


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 64 bytes from every position on that has so many."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    words = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data.tobytes(), strides=(1,))
    value = words * np.uint64(0x9E3779B97F4A7C15)
    value ^= value >> np.uint64(32)
    size = 8
    for factor in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93):
        left, right = value[: len(value) - size], value[size:]
        value = left * np.uint64(factor) + right
        value ^= value >> np.uint64(29)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        value ^= value >> np.uint64(32)
        size *= 2
    return value


def stretches(data: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """text, first start (within its text), number of starts, gram hash of every stretch: starts with one anchor.

    Works over many texts end to end; only starts whose whole string lies in their text count.
    """
    n = len(data) - width + 1
    none = tuple(np.empty(0, dtype=np.int64) for _ in range(3)) + (np.empty(0, dtype=np.uint64),)
    if n <= 0:
        return none
    hashes = gram_hashes(data)
    # Of a hash always the same bits count, however many texts lie end to end: equal strings have equal anchors.
    low = np.uint64(0xFFFFFFFF)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    window, size = width - GRAM + 1, 1
    while 2 * size <= window:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    if size < window:
        least = np.minimum(least[: len(least) - (window - size)], least[window - size :])
    anchor = (least & low).astype(np.int64)
    length = np.diff(starts)
    owner = np.repeat(np.arange(len(length)), np.maximum(length - width + 1, 0))
    if not owner.size:
        return none
    place = np.arange(len(owner)) - np.repeat(np.cumsum(np.maximum(length - width + 1, 0)) - np.maximum(length - width + 1, 0),
                                              np.maximum(length - width + 1, 0))
    anchor = anchor[starts[owner] + place]
    new = np.ones(len(anchor), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return owner[first], place[first], np.diff(np.append(first, len(anchor))), hashes[anchor[first]]


def text_stretches(texts: DataFrame, params: PassageParams) -> DataFrame:
    """gram, d1, d2 (digest of the stretch), text_key, start, n of every stretch of every text (text_key, raw)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "raw", 2 << 20):
            data, starts = flat_bytes(batch.column("raw"))
            owner, start, count, gram = stretches(data, starts, params.width)
            if not len(owner):
                continue
            begin = (starts[owner] + start).tolist()
            view = memoryview(data.tobytes())
            digest = b"".join(xxhash.xxh3_128_digest(view[b : b + c + params.width - 1]) for b, c in zip(begin, count.tolist()))
            halves = np.frombuffer(digest, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram.view(np.int64)), pa.array(np.ascontiguousarray(halves[:, 0])),
                 pa.array(np.ascontiguousarray(halves[:, 1])), batch.column("text_key").take(pa.array(owner)),
                 pa.array(start), pa.array(count.astype(np.int32))],
                names=["gram", "d1", "d2", "text_key", "start", "n"])

    return texts.select("text_key", "raw").mapInArrow(
        work, "gram bigint, d1 bigint, d2 bigint, text_key binary, start bigint, n int")


def cut_out(texts: DataFrame, wanted: DataFrame, params: PassageParams) -> DataFrame:
    """The bytes of wanted stretches (gram, d1, d2, text_key, start, n): one row each, however many rows a text has."""
    lists = wanted.groupBy("text_key").agg(F.collect_list(F.struct("gram", "d1", "d2", "start", "n")).alias("parts"))
    met = texts.select("text_key", "raw").join(lists.hint("merge"), "text_key").select("raw", "parts")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "raw"):
            rows = []
            for raw, parts in zip(batch.column("raw").to_pylist(), batch.column("parts").to_pylist()):
                rows += [(p["gram"], p["d1"], p["d2"], raw[p["start"] : p["start"] + p["n"] + params.width - 1]) for p in parts]
            gram, d1, d2, part = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                                              pa.array(part, pa.binary())], names=["gram", "d1", "d2", "part"])

    return met.mapInArrow(work, "gram bigint, d1 bigint, d2 bigint, part binary")


RUN = ("h1", "h2", "d1", "d2", "start", "alone")


def shard_repeats(parts: DataFrame, tasks: int, params: PassageParams) -> DataFrame:
    """Per stretch (gram, d1, d2) the starts that repeat in its shard, and of salted grams what other shards must know.

    Rows: gram, d1, d2, start, n (a run of repeating starts), or gram, bucket and a run: the digests of the shard's
    different strings that fall into a bucket, in order, each with its stretch, start and whether it is alone. A gram has
    four buckets for every shard, so what meets in a bucket is bounded as a shard is.
    """

    def runs(gram: int, salts: int, strings: np.ndarray) -> Iterator[tuple]:
        strings = strings[np.lexsort((strings[:, 1], strings[:, 0]))]
        bucket = strings[:, 0] % (4 * salts)
        for no in np.unique(bucket).tolist():
            yield (gram, None, None, None, None, no, *strings[bucket == no].T.tolist())

    def block(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        data = np.frombuffer(b"\xff".join(r[4] for r in rows), dtype=np.uint8)
        size = np.array([len(r[4]) for r in rows])
        begin = np.cumsum(size + 1) - size - 1
        count = size - params.width + 1
        owner = np.repeat(np.arange(len(rows)), count)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        where = begin[owner] + place
        valid = np.zeros(len(data), dtype=bool)
        valid[where] = True
        twice, names = repeated_starts(data, valid, params.width)
        hit = twice[where]
        # Runs of repeating starts.
        edge = np.ones(len(hit), dtype=bool)
        edge[1:] = (hit[1:] != hit[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(edge)
        length = np.diff(np.append(first, len(hit)))
        first, length = first[hit[first]], length[hit[first]]
        out = [(*rows[o][:3], p, n, *[None] * 7) for o, p, n in
               zip(owner[first].tolist(), place[first].tolist(), length.tolist())]
        salts = np.array([r[3] for r in rows])[owner]
        shared = np.flatnonzero(salts > 1)
        if shared.size:
            shared = shared[np.unique(names[where[shared]], return_index=True)[1]]  # each string once
            view = memoryview(data.tobytes())
            digests = b"".join(xxhash.xxh3_128_digest(view[at : at + params.width], seed=1) for at in where[shared].tolist())
            keys = np.array([r[:3] for r in rows], dtype=np.int64)[owner[shared]]
            strings = np.column_stack([np.frombuffer(digests, dtype=np.int64).reshape(-1, 2), keys[:, 1:], place[shared],
                                       ~hit[shared]])
            for gram in np.unique(keys[:, 0]).tolist():
                mine = keys[:, 0] == gram
                out += runs(gram, int(salts[shared][mine][0]), strings[mine])
        if out:
            lists = [pa.list_(pa.int64())] * len(RUN)
            kinds = [pa.int64()] * 4 + [pa.int32(), pa.int32(), *lists]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                             names=["gram", "e1", "e2", "at", "n", "bucket", *RUN])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, bytes_held, seen = None, [], 0, set()
        for batch in small_batches(batches, "part"):
            names = ("gram", "salt", "salts", "d1", "d2", "part")
            for gram, salt, salts, d1, d2, part in zip(*(batch.column(c).to_pylist() for c in names)):
                if (gram, salt) != held:
                    if bytes_held >= params.shard_bytes:
                        yield from block(waiting)
                        waiting, bytes_held = [], 0
                    held, seen = (gram, salt), set()
                if (d1, d2) not in seen:  # a text that stands several times gives its stretches several times
                    seen.add((d1, d2))
                    waiting.append((gram, d1, d2, salts, part))
                    bytes_held += len(part)
        if waiting:
            yield from block(waiting)

    ordered = parts.repartition(tasks, "gram", "salt").sortWithinPartitions("gram", "salt")
    return ordered.mapInArrow(work, "gram bigint, e1 bigint, e2 bigint, at bigint, n int, bucket int, "
                                    + ", ".join(f"{c} array<bigint>" for c in RUN))


def merged_repeats(runs: DataFrame, tasks: int) -> DataFrame:
    """gram, e1, e2, at, n: the lone strings of shards that another shard of their gram holds too.

    The runs of one bucket meet, one from each shard; a shard names a string once, so a digest that a binary search over
    all runs finds more than once is in several shards.
    """
    dealt = runs.repartition(tasks, "gram", "bucket").sortWithinPartitions("gram", "bucket")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = None, []

        def give() -> Iterator[pa.RecordBatch]:
            if len(waiting) < 2:
                return
            h1, h2, d1, d2, start, alone = (np.concatenate(x) for x in zip(*waiting))
            pair = np.empty(len(h1), dtype=[("a", np.int64), ("b", np.int64)])
            pair["a"], pair["b"] = h1, h2
            number = np.unique(pair, return_inverse=True)[1]
            several = np.flatnonzero((found_in(np.sort(number), number) > 1) & (alone == 1))
            if several.size:
                columns = [np.full(several.size, held[0]), d1[several], d2[several], start[several]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.ones(several.size, dtype=np.int32))],
                                                 names=["gram", "e1", "e2", "at", "n"])

        for batch in batches:
            for row in range(batch.num_rows):
                key = (batch.column("gram")[row].as_py(), batch.column("bucket")[row].as_py())
                if key != held:
                    yield from give()
                    held, waiting = key, []
                waiting.append([batch.column(c)[row].values.to_numpy() for c in RUN])
        yield from give()

    return dealt.mapInArrow(work, "gram bigint, e1 bigint, e2 bigint, at bigint, n int")


def repeat_runs(texts: DataFrame, params: PassageParams) -> DataFrame:
    """text_key, start, n: runs of starts in the texts (text_key, raw) whose strings start anywhere else as well."""
    spark = texts.sparkSession
    found = cut(text_stretches(texts, params), "stretches")
    grams = found.groupBy("gram").agg(
        F.count(F.lit(1)).alias("times"), F.min("d1").alias("a1"), F.max("d1").alias("z1"), F.min("d2").alias("a2"), F.max("d2").alias("z2"))
    grams = grams.where("times > 1").select("gram", ((F.col("a1") != F.col("z1")) | (F.col("a2") != F.col("z2"))).alias("mixed"))
    grams = cut(grams, "grams")
    often = cut(found.join(grams.hint("merge"), "gram"), "often")
    discard(spark, found)
    settled = often.where("NOT mixed").select("text_key", "start", "n")

    # Different stretches of one gram: one text stands for each.
    kinds = often.where("mixed").groupBy("gram", "d1", "d2").agg(
        F.count(F.lit(1)).alias("times"), F.min(F.struct("text_key", "start", "n")).alias("one"))
    kinds = cut(kinds, "kinds")
    salts = kinds.groupBy("gram").agg(F.ceil(F.count(F.lit(1)) / params.shard_stretches).cast("int").alias("salts"))
    wanted = kinds.select("gram", "d1", "d2", "one.*")
    parts, seen = cut_and_observe(cut_out(texts, wanted, params).join(salts, "gram").select(
        "gram", "d1", "d2", "part", F.pmod(F.xxhash64("d1", "d2"), F.col("salts")).cast("int").alias("salt"), "salts"),
        "parts", F.coalesce(F.sum(F.octet_length("part")), F.lit(0)).alias("bytes"))
    tasks = max(1, -(-seen["bytes"] // (4 * params.shard_bytes)))
    repeats = cut(shard_repeats(parts, tasks, params), "repeats")
    discard(spark, parts)
    elsewhere = merged_repeats(repeats.where("bucket IS NOT NULL").select("gram", "bucket", *RUN), tasks)
    runs = repeats.where("bucket IS NULL").select("gram", "e1", "e2", "at", "n").unionAll(elsewhere)
    runs = cut(runs.select("gram", F.col("e1").alias("d1"), F.col("e2").alias("d2"), F.col("at").alias("_from"),
                           F.col("n").alias("_n")), "runs")

    # A stretch that occurs as a whole more than once repeats from end to end; others where their shard says so.
    contested = often.where("mixed").drop("mixed")
    whole = kinds.where("times > 1").select("gram", "d1", "d2")
    out = settled.unionAll(contested.join(whole, ["gram", "d1", "d2"]).select("text_key", "start", "n"))
    inner = contested.join(runs, ["gram", "d1", "d2"]).select("text_key", (F.col("start") + F.col("_from")).alias("start"), F.col("_n").alias("n"))
    return out.unionAll(inner)


def text_key(raw: Column) -> Column:
    return F.unhex(F.sha2(raw, 256))


def with_runs(df: DataFrame, params: PassageParams, text_col: str) -> tuple[DataFrame, DataFrame]:
    """`df` with `_key` (digest of the text) and, by key, the runs of repeating starts as one list per text."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    keyed = df.withColumn("_key", text_key(raw))
    texts = df.select(text_key(raw).alias("text_key"), raw.alias("raw"))
    runs = repeat_runs(texts, params)
    # Sets, so that copies of a text add nothing.
    lists = runs.groupBy("text_key").agg(F.collect_set(F.struct("start", "n")).alias("_runs"))
    return keyed, cut(lists.select(F.col("text_key").alias("_text"), "_runs"), "lists")


def covered(size: int, runs: list[dict], width: int) -> list[tuple[int, int]]:
    """Maximal stretches of bytes that strings starting in the runs cover."""
    out: list[list[int]] = []
    for begin, end in sorted((r["start"], r["start"] + r["n"] - 1 + width) for r in runs):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(b, min(e, size)) for b, e in out]


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for begin, end in spans:
        kept.append(raw[at:begin])
        at = end
    return b"".join([*kept, raw[at:]])


def remove_repeats(
    df: DataFrame, params: PassageParams = PassageParams(), id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """`id_col`, n_bytes, n_removed, n_spans, kept_sha256, spans: one row per input row.

    A byte goes if a `width`-byte string that covers it also starts anywhere else in the table, the same text included;
    strings are taken from the input. A null text counts as empty; texts shorter than `width` lose nothing; repeated
    rows lose all of a text of at least `width` bytes; null ids are kept; an empty table gives an empty one; other
    columns are not read. Texts are never cut; one text must fit in a task.
    """
    keyed, lists = with_runs(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), params, "text")
    kind = keyed.schema["id"].dataType.simpleString()
    met = keyed.join(lists.hint("merge"), F.col("_key") == F.col("_text"), "left")
    met = met.select("id", F.coalesce("text", F.lit("")).alias("text"), "_runs")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            rows = []
            for raw, runs in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("_runs").to_pylist()):
                spans = covered(len(raw), runs or [], params.width)
                left = without(raw, spans)
                rows.append((len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest(), spans))
            size, gone, count, digest, spans = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()),
                 pa.array(digest), pa.array([[{"begin": b, "end": e} for b, e in s] for s in spans],
                                            pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    out = met.mapInArrow(work, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
                               "spans array<struct<begin: bigint, end: bigint>>")
    return out.withColumnRenamed("id", id_col)


def cut_repeats(
    df: DataFrame, params: PassageParams = PassageParams(), text_col: str = "text",
) -> DataFrame:
    """The rows of `df` with repeated byte strings taken out of the text; all columns stay, a null text too.

    A character that a cut splits goes as a whole. Rows are told apart by place, not by id: repeated rows lose all of a
    text of at least `width` bytes, shorter and empty texts stay, and an empty table gives an empty one.
    """
    packed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(f"`{text_col}`").alias("text"))
    keyed, lists = with_runs(packed, params, "text")
    lists = lists.hint("merge")
    met = keyed.join(lists, keyed["_key"] == lists["_text"], "left")

    @F.pandas_udf("string")
    def rest(texts: pd.Series, lists: pd.Series) -> pd.Series:
        out = []
        for text, runs in zip(texts, lists):
            raw = text.encode()
            out.append(without(raw, covered(len(raw), list(runs), params.width)).decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)

    cleaned = rest(F.coalesce("text", F.lit("")), F.coalesce("_runs", F.array().cast("array<struct<start: bigint, n: bigint>>")))
    text = F.when(F.col("_runs").isNull(), F.col("text")).otherwise(cleaned)
    return met.select(*((text if c == text_col else F.col("row")[c]).alias(c) for c in df.columns))

"""Fuzzy duplicate lines: MinHash of character shingles, bands, exact confirmation, components, one line kept of each.

Lines that read the same (case of A-Z and white space aside) are one node. A node's shingles give one sample for each
part of the hash range, samples give bands, and nodes that share a band are candidates. Every node first meets the
smallest node of each of its buckets; in buckets that still hold several components afterwards, lines of different
components meet part by part. Links are confirmed on full shingle sets. The first line of a component stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resight.llm.common import drawn, flat_bytes, mixed, small_batches
from resight.llm.components import connected_components
from resight.llm.shingles import band_keys
from resight.session import cut, discard


@dataclass(frozen=True)
class LineParams:
    characters: int = 8
    percent: int = 75
    #: 64 samples in 16 bands of 4: a pair of similarity 0.75 shares none with probability 0.2 %, of 0.8 with 0.02 %.
    samples: int = 64
    rows: int = 4
    #: Lines of a bucket that meet in one task.
    block: int = 512


def normal_line(line: str) -> str:
    """A line as it is compared: A-Z in lower case, white space runs one space, none at the ends."""
    return " ".join(lower_ascii(line).split())


def lower_ascii(text: str) -> str:
    """A-Z in lower case: bytes know no other letters, and theirs are much faster than a table for `str.translate`."""
    return text.encode().lower().decode()


#: The same as a table.
LOWER = {c: c + 32 for c in range(65, 91)}


#: An odd factor and its inverse among 64-bit numbers: powers of one undo powers of the other.
FACTOR = 0xD6E8FEB86659FD93
INVERSE = pow(FACTOR, -1, 1 << 64)


def powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def line_shingles(data: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """owner and hash of every shingle of `size` characters of UTF-8 lines; a shorter line that is not empty is one shingle.

    A shingle's hash comes from two running sums over the bytes, taken back to the shingle's own start.
    """
    begins = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # of characters
    first = np.searchsorted(begins, starts)
    length = np.diff(first)
    count = np.where(length >= size, length - size + 1, (length > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(length)), count)
    at = np.arange(len(owner)) + np.repeat(first[:-1] - (np.cumsum(count) - count), count)
    begin, end = begins[at], begins[np.minimum(at + size, first[1:][owner])]
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(drawn(8, 256)[data] * powers(FACTOR, len(data)), dtype=np.uint64)])
    own = (sums[end] - sums[begin]) * powers(INVERSE, len(data))[begin] if len(data) else np.empty(0, dtype=np.uint64)
    return owner, mixed(own + (end - begin).astype(np.uint64))


def line_samples(data: np.ndarray, starts: np.ndarray, params: LineParams) -> np.ndarray:
    """The least shingle hash of each part of the hash range, per line; an empty part takes that of the part before it."""
    lines, bins = len(starts) - 1, params.samples
    shift = np.uint64(bins.bit_length() - 1)
    out = np.zeros((lines, bins), dtype=np.uint64)
    owner, value = line_shingles(data, starts, params.characters)
    if not len(owner):
        return out
    bits = np.uint64(max(1, int(lines - 1).bit_length()))
    # Line, part and the upper bits of the hash in one number; line numbers go first.
    packed = np.sort((owner.astype(np.uint64) << (np.uint64(64) - bits)) | (value >> bits))
    slot = (packed >> (np.uint64(64) - bits - shift)).astype(np.int64)
    first = np.ones(len(slot), dtype=bool)
    first[1:] = slot[1:] != slot[:-1]
    slot = slot[first]
    filled = np.zeros(lines * bins, dtype=bool)
    filled[slot] = True
    out.ravel()[slot] = packed[first] & ((np.uint64(1) << (np.uint64(64) - bits - shift)) - np.uint64(1))
    filled = filled.reshape(lines, bins)
    last = np.maximum.accumulate(np.where(np.tile(filled, 2), np.arange(2 * bins), -1), axis=1)[:, bins:] % bins
    distance = (np.arange(bins) - last) % bins
    return np.take_along_axis(out, last, axis=1) + distance.astype(np.uint64) * drawn(7, 1)[0]


def scan_lines(df: DataFrame, params: LineParams) -> DataFrame:
    """id, mark, line_no, key, bands of every line of the texts (id, mark, text) that is not blank."""
    kind = df.schema["id"].dataType.simpleString()
    bands = params.samples // params.rows

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 2 << 20):
            owner, number, raw = [], [], []
            for at, text in enumerate(batch.column("text").to_pylist()):
                for no, line in enumerate(lower_ascii(text).split("\n")):
                    line = " ".join(line.split())
                    if line:
                        owner.append(at)
                        number.append(no)
                        raw.append(line.encode())
            if not raw:
                continue
            keys = [hashlib.md5(line, usedforsecurity=False).digest() for line in raw]
            place, different = {}, []
            for key, line in zip(keys, raw):
                if place.setdefault(key, len(different)) == len(different):
                    different.append(line)
            starts = np.concatenate([[0], np.cumsum([len(x) for x in different])])
            data = np.frombuffer(b"".join(different), dtype=np.uint8)
            # The bits left of a hash after the line number must not depend on how many lines there are.
            made = []
            for begin in range(0, len(different), LINES):
                end = min(begin + LINES, len(different))
                padded = np.concatenate([starts[begin : end + 1], np.full(LINES - (end - begin), starts[end])]) - starts[begin]
                part = line_samples(data[starts[begin] : starts[end]], padded, params)[: end - begin]
                made.append(band_keys(part, params.rows))
            made = np.concatenate(made)[[place[key] for key in keys]]
            offsets = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * bands)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(owner)), batch.column("mark").take(pa.array(owner)), pa.array(number, pa.int32()), pa.array(keys, pa.binary()),
                 pa.ListArray.from_arrays(offsets, pa.array(made.view(np.int64).ravel()))],
                names=["id", "mark", "line_no", "key", "bands"])

    return df.mapInArrow(work, f"id {kind}, mark bigint, line_no int, key binary, bands array<bigint>")


#: Lines whose samples are taken together: always as many, so that samples keep the same bits.
LINES = 4096


def line_texts(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and normal text of wanted lines (node, id, mark, line_no) of the texts (id, mark, text)."""
    lists = wanted.groupBy(F.col("id").alias("_id"), F.col("mark").alias("_mark")).agg(
        F.collect_list(F.struct("node", "line_no")).alias("parts"))
    met = df.join(lists.hint("merge"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))).select("text", "parts")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            out = []
            for text, parts in zip(batch.column("text").to_pylist(), batch.column("parts").to_pylist()):
                lines = text.split("\n")
                out += [(p["node"], normal_line(lines[p["line_no"]])) for p in parts]
            if out:
                node, line = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(line)], names=["node", "line"])

    return met.mapInArrow(work, "node bigint, line string")


def sets_of(column: pa.Array, size: int) -> list[np.ndarray]:
    data, starts = flat_bytes(column)
    owner, value = line_shingles(data, starts, size)
    cuts = np.searchsorted(owner, np.arange(len(starts)))
    return [np.unique(value[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


def cell_links(part: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links (a, b) between the lines (node, component, side, set) of a cell, which are in order of their sides."""
    if len(part) < 2:
        return []
    nodes, names, sides, sets = zip(*part)
    root = np.unique(np.array(names), return_inverse=True)[1]
    side = np.array([-1 if s is None else s for s in sides])
    size = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(part)), size)
    begin = np.cumsum(size) - size
    both = side[0] != side[-1]
    out = []
    for at in range(len(part) - 1):
        if both and side[at] == side[-1]:
            break  # the last side has met all others
        fit = root != root[at]
        fit[: at + 1] = False
        if both:
            fit &= side != side[at]
        fit &= 100 * np.minimum(size, size[at]) >= percent * np.maximum(size, size[at])
        if not fit.any():
            continue
        rest = slice(begin[at + 1], None)
        mask = fit[owner[rest]]
        theirs, whose = flat[rest][mask], owner[rest][mask]
        found = np.searchsorted(sets[at], theirs)
        same = sets[at][np.minimum(found, size[at] - 1)] == theirs
        common = np.bincount(whose[same], minlength=len(part))
        linked = np.flatnonzero(fit & (common > 0) & (100 * common >= percent * (size + size[at] - common)))
        for other in linked[np.unique(root[linked], return_index=True)[1]].tolist():
            out.append((nodes[at], nodes[other]))
            root[root == root[other]] = root[at]
    return out


def linked_cells(rows: DataFrame, params: LineParams) -> DataFrame:
    """Links (a, b) found in cells of rows (cell columns c1, c2, c3, node, component, side, line).

    Lines of different components are compared unless links of the cell have joined them already. In a cell whose
    `side` has two values, only lines of different sides are compared; a side of null is compared with all.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = None, []

        def give() -> Iterator[pa.RecordBatch]:
            found = cell_links(part, params.percent)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

        for batch in small_batches(batches, "line"):
            sets = sets_of(batch.column("line"), params.characters)
            for *key, node, component, side, own in zip(
                    *(batch.column(c).to_pylist() for c in ("c1", "c2", "c3", "node", "component", "side")), sets):
                if key != held:
                    yield from give()
                    held, part = key, []
                part.append((node, component, side, own))
        yield from give()

    dealt = rows.repartition("c1", "c2", "c3").sortWithinPartitions("c1", "c2", "c3", "side", "node")
    return dealt.mapInArrow(work, "a bigint, b bigint")


def shared_bands(banded: DataFrame) -> DataFrame:
    """band, node and centre (the smallest node of the band) of rows (band, node) whose band has several nodes.

    Rows are dealt by band and sorted; neighbours in that order tell which bands are shared, so a band of any number of
    nodes runs through, and the many that nobody shares go no further.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row: band, node, centre, and whether the row before it has the same band
        for batch in batches:
            if batch.num_rows == 0:
                continue
            band, node = (batch.column(c).to_numpy() for c in ("band", "node"))
            if held is not None:
                band, node = np.append(held[0], band), np.append(held[1], node)
            joined = np.append(False, band[1:] == band[:-1])
            centre = node[np.maximum.accumulate(np.where(joined, 0, np.arange(len(band))))]
            if held is not None and held[3]:
                joined[0] = True
                centre[: np.argmax(np.append(band != held[0], True))] = held[2]
            shared = np.flatnonzero(joined[:-1] | joined[1:])
            if len(shared):
                yield pa.RecordBatch.from_arrays([pa.array(c[shared]) for c in (band, node, centre)], names=["band", "node", "centre"])
            held = band[-1], node[-1], centre[-1], joined[-1]
        if held is not None and held[3]:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in held[:3]], names=["band", "node", "centre"])

    return banded.repartition("band").sortWithinPartitions("band", "node").mapInArrow(work, "band bigint, node bigint, centre bigint")


def line_groups(df: DataFrame, params: LineParams = LineParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, line_no, keeper_id, keeper_line, kept of every line that is not blank; lines are numbered from 0.

    The keeper is the first line, by id and number, of those that links lead to; the line is kept if it is its own.
    Lines are parts of the text between line feeds. Blank lines, null and empty texts give no rows. Rows that repeat an
    id repeat its lines: equal lines of equal id and number count as one if their whole texts are equal; of different
    texts under one id (or under none) a line number's keeper is the line of the text with the smaller hash. Null ids
    come first. Lines shorter than a shingle link with equal ones only; very long lines are compared whole. An empty
    table gives an empty one; other columns are not read.
    """
    return marked_groups(df, params, id_col, text_col).drop("mark")


def text_mark(text: Column) -> Column:
    """Tells texts of one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def marked_groups(df: DataFrame, params: LineParams, id_col: str, text_col: str) -> DataFrame:
    """`line_groups`, with the mark of the text that a line stands in."""
    spark = df.sparkSession
    slim = df.select(F.col(id_col).alias("id"), text_mark(F.col(text_col)).alias("mark"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scanned = cut(scan_lines(slim, params), "scanned")
    first = F.struct("id", "line_no", "mark")
    nodes = scanned.groupBy("key").agg(F.min(first).alias("first"), F.min_by("bands", first).alias("bands"))
    banded = cut(nodes.withColumn("node", F.monotonically_increasing_id()), "banded")
    # Bands are most of the bytes, and needed for the members only.
    lines = cut(scanned.drop("bands"), "lines")
    discard(spark, scanned)
    members = cut(shared_bands(banded.select(F.explode("bands").alias("band"), "node")), "members")
    nodes = cut(banded.drop("bands"), "nodes")
    discard(spark, banded)
    named = members.select("node").distinct()
    places = nodes.join(named, "node").select("node", "first.*")
    texts = cut(line_texts(slim, places).dropDuplicates(["node"]), "texts")

    # Every node with the smallest of each of its buckets; a centre of many nodes is copied to several cells.
    stars = members.where("node != centre").select("centre", "node").distinct()
    salts = stars.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / params.block).cast("int").alias("_salts"))
    around = stars.join(salts, "centre").select(F.col("centre").alias("c1"), F.pmod(F.xxhash64("node"), F.col("_salts")).cast("int").alias("c2"),
                                                "node", F.lit(1).alias("side"))
    centres = salts.select(F.col("centre").alias("c1"), F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("c2"),
                           F.col("centre").alias("node"), F.lit(0).alias("side"))
    cells = around.unionAll(centres).select("c1", "c2", F.lit(0).alias("c3"), "node", F.col("node").alias("component"), "side")
    links = cut(linked_cells(cells.join(texts, "node"), params), "links")

    # Buckets that still hold several components: all parts with all parts. Of buckets of the same nodes one is enough.
    groups = cut(connected_components(links), "components")
    named = cut(members.join(groups, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component")), "named")
    discard(spark, members, groups)
    ends = named.groupBy("band").agg(
        F.count(F.lit(1)).alias("_n"), F.min("component").alias("_least"), F.max("component").alias("_most"), F.min("node").alias("_first"), F.max("node").alias("_last"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("_sum"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("_xor"))
    # Two nodes have met as centre and member.
    single = ends.where("_n > 2 AND _least != _most").groupBy("_n", "_first", "_last", "_sum", "_xor").agg(F.min("band").alias("band"))
    rest = named.join(single.select("band", "_n"), "band")
    parts = F.ceil(F.col("_n") / params.block).cast("int")
    rest = rest.withColumn("_parts", parts).withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_parts")).cast("int"))
    cells = rest.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).select(
        F.col("band").alias("c1"), F.least("_own", "_other").alias("c2"), F.greatest("_own", "_other").alias("c3"),
        "node", "component", F.col("_own").alias("side"))
    more = cut(linked_cells(cells.join(texts, "node"), params), "links")
    discard(spark, texts, named)
    groups = cut(connected_components(links.unionAll(more)), "components")

    joined = nodes.join(groups, "node", "left").select("key", "first", F.coalesce("component", "node").alias("component"))
    keepers = joined.groupBy("component").agg(F.min("first").alias("keeper"))
    by_key = cut(joined.join(keepers, "component").select("key", "keeper"), "keepers")
    discard(spark, nodes, links, more, groups)
    out = lines.select("id", "mark", "line_no", "key").join(by_key.hint("merge"), "key")
    own = F.struct("id", "line_no", "mark")
    return out.select(F.col("id").alias(id_col), "mark", "line_no", F.col("keeper.id").alias("keeper_id"),
                      F.col("keeper.line_no").alias("keeper_line"), F.col("keeper").eqNullSafe(own).alias("kept"))


def drop_lines(df: DataFrame, params: LineParams = LineParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df` with the lines taken out of the text that are not kept; all columns stay, a null text too.

    Rows of equal id and text lose the same lines; other rows of an id, or without one, are told apart by their texts.
    Blank lines stay. An empty table gives an empty one.
    """
    gone = marked_groups(df, params, id_col, text_col).where("NOT kept")
    lists = gone.groupBy(F.col(id_col).alias("_id"), F.col("mark").alias("_mark")).agg(F.collect_set("line_no").alias("_gone"))
    packed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    lists = cut(lists, "gone").hint("merge")
    same = packed["row"][id_col].eqNullSafe(lists["_id"]) & (text_mark(packed["row"][text_col]) == lists["_mark"])
    met = packed.join(lists, same, "left")

    @F.pandas_udf("string")
    def rest(texts: pd.Series, gone: pd.Series) -> pd.Series:
        out = []
        for text, numbers in zip(texts, gone):
            if text is not None and numbers is not None:
                drop = set(numbers.tolist())
                text = "\n".join(line for no, line in enumerate(text.split("\n")) if no not in drop)
            out.append(text)
        return pd.Series(out, dtype=object)

    text = F.when(F.col("_gone").isNull(), F.col("row")[text_col]).otherwise(rest(F.col("row")[text_col], F.col("_gone")))
    return met.select(*((text if c == text_col else F.col("row")[c]).alias(c) for c in df.columns))

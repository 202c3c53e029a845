"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation, components.

MinHash samples of a document's shingles give its bands. More samples, one for each part of the hash range, are folded
into a bitmap of parities, an odd sketch: the number of bits in which two sketches differ tells how many samples differ.
Documents that share a band are candidates; pairs that their sketches put far below the wanted similarity go no further,
and the rest is confirmed on full shingle sets.

Groups may hold any share of the documents, so pairs are not listed. Documents with equal sets are one node. Every
node first meets one other only, the smallest that shares a bucket with it. Components of the links found show which buckets still hold
several components; there, within bounded parts, only the likeliest pairs that would join components are tried next. At
last, nodes of components that are still apart meet in every bucket they share, part by part, so that no link is lost.
A cell of two parts that holds such pairs gets the full sets of its nodes, once each, and confirms them among itself;
pairs that links of the cell have joined meanwhile are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resight.llm.common import flat_bytes, small_batches
from resight.llm.components import connected_components
from resight.llm.shingles import WORDS, band_keys, minhash, odd_sketches, shingle_sets
from resight.session import cut, discard


@dataclass(frozen=True)
class NearDupParams:
    words: int = WORDS
    percent: int = 75
    #: 32 bands of 4: a pair of similarity 0.75 shares none with probability 5e-6.
    samples: int = 128
    rows: int = 4
    #: Samples and bits of the odd sketch. At 0.75 its standard error is 0.0145.
    bins: int = 1024
    bits: int = 4096
    #: Pairs estimated below this are dropped: 5.5 standard errors below 0.75.
    least_estimate: float = 0.67
    #: Pairs with a set of fewer shingles are never dropped: samples that fall together move their estimate by whole steps.
    exact_below: int = 64
    #: Members of a bucket or of one document's pairs that meet in one task.
    block: int = 256
    #: The same where full sets meet in cells: members of a part, and shingles of its members together.
    cell_block: int = 1024
    cell_shingles: int = 1 << 21


def signatures(df: DataFrame, params: NearDupParams, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, set_key, sketch (parities, then filled bins), bands of every row; no key and empty lists for an empty set."""
    slim = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            sets = shingle_sets(*flat_bytes(batch.column("text")), params.words)
            sizes = np.array([len(s) for s in sets])
            empty = sizes == 0
            samples = np.zeros((len(sets), params.samples), dtype=np.uint64)
            for at in np.flatnonzero(~empty).tolist():
                samples[at] = minhash(sets[at], params.samples)
            keys = [None if not len(s) else xxhash.xxh3_128_digest(s.tobytes()) for s in sets]

            sketch = np.concatenate(odd_sketches(sets, params.bins, params.bits), axis=1)

            def lists(values: np.ndarray) -> pa.Array:
                ends = np.append(0, np.cumsum(~empty * values.shape[1])).astype(np.int32)
                return pa.ListArray.from_arrays(pa.array(ends), pa.array(values[~empty].view(np.int64).ravel()))

            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                 lists(sketch), lists(band_keys(samples, params.rows))],
                names=["id", "n_shingles", "set_key", "sketch", "bands"])

    return slim.mapInArrow(work, f"id {kind}, n_shingles bigint, set_key binary, sketch array<bigint>, bands array<bigint>")


def estimate(pop_odd, pop_left, pop_right, pop_either, params: NearDupParams):
    """Similarity from differing parities, filled bins of each side and of either; below 0 where nothing can be told."""
    room = np.maximum(1 - 2 * pop_odd / params.bits, 1e-9)
    differing = -params.bits / 2 * np.log(room)
    return (pop_left + pop_right - differing) / 2 / np.maximum(pop_either, 1)


def _bits(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda total, word: total + F.bit_count(word).cast("int"))


def close_pairs(pairs: DataFrame, nodes: DataFrame, params: NearDupParams) -> DataFrame:
    """The pairs (a, b) of at least the least estimate, or with a small set. The formula is that of `estimate`, in columns."""
    odd, bins = params.bits // 64, params.bins // 64
    left = nodes.select(F.col("id").alias("a"), F.col("n_shingles").alias("_m"), F.col("sketch").alias("_l"))
    right = nodes.select(F.col("id").alias("b"), F.col("n_shingles").alias("_n"), F.col("sketch").alias("_r"))
    met = pairs.join(left, "a").join(right, "b")
    parity = _bits(F.zip_with(F.slice("_l", 1, odd), F.slice("_r", 1, odd), lambda x, y: x.bitwiseXOR(y)))
    either = _bits(F.zip_with(F.slice("_l", odd + 1, bins), F.slice("_r", odd + 1, bins), lambda x, y: x.bitwiseOR(y)))
    filled = _bits(F.slice("_l", odd + 1, bins)) + _bits(F.slice("_r", odd + 1, bins))
    differing = F.log(F.greatest(1 - 2 * parity / params.bits, F.lit(1e-9))) * (-params.bits / 2)
    guess = (filled - differing) / 2 / F.greatest(either, F.lit(1))
    small = F.least("_m", "_n") < params.exact_below
    return met.where(small | (guess >= params.least_estimate)).select("a", "b")


def alike(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    """Whether two full sets have 100 * intersection >= percent * union."""
    common = len(np.intersect1d(left, right, assume_unique=True))
    return common > 0 and 100 * common >= percent * (len(left) + len(right) - common)


class Roots:
    """Components of a cell while links join them."""

    def __init__(self):
        self.root: dict = {}

    def find(self, c):
        root = self.root
        root.setdefault(c, c)
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    def join(self, left, right) -> bool:
        """False if they were one before."""
        left, right = self.find(left), self.find(right)
        self.root[left] = right
        return left != right


def confirm(pairs: DataFrame, df: DataFrame, params: NearDupParams, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union.

    The texts of `a` and of its partners meet in one task; an `a` of many partners is copied to several. A repeated id
    stands for all its texts: one of them is enough.
    """
    texts = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
    texts = cut(texts.join(named.hint("merge"), "id"), "texts")
    spread = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / params.block).cast("int").alias("_n"))
    dealt = pairs.join(spread, "a").withColumn("_salt", F.pmod(F.xxhash64("b"), F.col("_n")).cast("int"))
    members = dealt.join(texts.withColumnRenamed("id", "b"), "b").select("a", "_salt", "b", "text")
    centres = spread.join(texts.withColumnRenamed("id", "a"), "a").select(
        "a", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_salt"), F.lit(None).cast(pairs.schema["b"].dataType).alias("b"), "text")
    both = centres.unionAll(members).repartition("a", "_salt").sortWithinPartitions("a", "_salt", F.asc_nulls_first("b"))
    kind = pairs.schema["a"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, centre = None, []
        for batch in small_batches(batches, "text"):
            sets = shingle_sets(*flat_bytes(batch.column("text")), params.words)
            keys = list(zip(batch.column("a").to_pylist(), batch.column("_salt").to_pylist()))
            found = []
            for key, other, members_of in zip(keys, batch.column("b").to_pylist(), sets):
                if key != held:
                    held, centre = key, []
                if other is None:
                    centre.append(members_of)
                    continue
                if any(alike(own, members_of, params.percent) for own in centre):
                    found.append((key[0], other))
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, batch.column("a").type), pa.array(b, batch.column("b").type)],
                                                 names=["a", "b"])

    return both.mapInArrow(work, f"a {kind}, b {kind}").distinct()


def cell_pairs(
    component: np.ndarray, upper: np.ndarray, size: np.ndarray, sketch: np.ndarray, bands: np.ndarray, key: int,
    apart: bool, likely: bool, params: NearDupParams,
) -> list[tuple[float, int, int]]:
    """Close pairs (estimate, row, row) across components in one cell, the closest first; with `likely`, only those that
    join its components.

    Sets whose sizes differ too much can't be linked. A pair that shares several buckets belongs to the first of them.
    """
    odd = params.bits // 64
    filled = np.bitwise_count(sketch[:, odd:]).sum(axis=1, dtype=np.int64)
    out = []
    for at in range(len(component) - 1):
        other = component[at + 1 :] != component[at]
        if apart:  # two parts: pairs within one of them meet elsewhere
            other &= upper[at + 1 :] != upper[at]
        there = size[at + 1 :]
        other &= 100 * np.minimum(there, size[at]) >= params.percent * np.maximum(there, size[at])
        near = np.flatnonzero(other) + at + 1
        if not near.size:
            continue
        parity = np.bitwise_count(sketch[near, :odd] ^ sketch[at, :odd]).sum(axis=1, dtype=np.int64)
        either = np.bitwise_count(sketch[near, odd:] | sketch[at, odd:]).sum(axis=1, dtype=np.int64)
        guess = estimate(parity, filled[near], filled[at], either, params)
        good = guess >= (params.percent / 100 if likely else params.least_estimate)
        if not likely:
            good |= np.minimum(size[near], size[at]) < params.exact_below
        near, guess = near[good], guess[good]
        if near.size and not likely:
            shared = bands[near] == bands[at]
            own = bands[at][shared.argmax(axis=1)] == key
            near, guess = near[own], guess[own]
        out += [(g, at, k) for g, k in zip(guess.tolist(), near.tolist())]
    out.sort(reverse=True)
    if likely:
        roots = Roots()
        names = component.tolist()
        out = [(g, x, y) for g, x, y in out if roots.join(names[x], names[y])]
    return out


def dealt_cells(members: DataFrame, params: NearDupParams, likely: bool, turn: int) -> DataFrame:
    """The rows (key, _n, _size, id, component, n_shingles, sketch, bands) of every bucket, by cell.

    A bucket is dealt into parts of bounded size; any two parts meet in one cell. With `likely` each part stays by itself.
    """
    if likely:
        parts = F.ceil(F.col("_n") / params.block)
    else:
        parts = F.greatest(F.ceil(F.col("_n") / params.cell_block), F.ceil(F.col("_size") / params.cell_shingles))
    own = members.withColumn("_parts", parts.cast("int")).withColumn(
        "_own", F.pmod(F.xxhash64("id", F.lit(turn)), F.col("_parts")).cast("int"))
    others = F.array("_own") if likely else F.sequence(F.lit(0), F.col("_parts") - 1)
    cells = own.withColumn("_other", F.explode(others)).select(
        "key", F.least("_own", "_other").alias("_lo"), F.greatest("_own", "_other").alias("_hi"), "id", "component",
        (F.col("_own") > F.col("_other")).alias("_upper"), "n_shingles", "sketch", "bands")
    return cells.repartition("key", "_lo", "_hi").sortWithinPartitions("key", "_lo", "_hi")


CELL = ("key", "_lo", "_hi")


def each_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(key, _lo, _hi) and id, component, _upper, n_shingles, sketch, bands of one cell after another, as arrays."""
    held, waiting = None, []

    def grid(column: pa.Array, rows: int) -> np.ndarray:
        return column.flatten().to_numpy().reshape(rows, -1)

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in CELL])
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "component", "_upper", "n_shingles")]
        columns += [grid(batch.column("sketch"), batch.num_rows).view(np.uint64), grid(batch.column("bands"), batch.num_rows)]
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            key = tuple(keys[:, begin].tolist())
            if key != held:
                if waiting:
                    yield held, [np.concatenate(x) for x in zip(*waiting)]
                held, waiting = key, []
            waiting.append(tuple(c[begin:end] for c in columns))
    if waiting:
        yield held, [np.concatenate(x) for x in zip(*waiting)]


def likely_pairs(members: DataFrame, params: NearDupParams, turn: int) -> DataFrame:
    """Pairs (a, b) that would join components within the parts of every bucket: fewer than a part has rows."""
    kind = members.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, _, _), (ids, *columns) in each_cell(batches):
            pairs = [(min(ids[x], ids[y]), max(ids[x], ids[y])) for _, x, y in cell_pairs(*columns, key, False, True, params)]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*pairs)], names=["a", "b"])

    return dealt_cells(members, params, True, turn).mapInArrow(work, f"a {kind}, b {kind}").distinct()


def cell_links(members: DataFrame, df: DataFrame, params: NearDupParams, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) that join components, from all pairs across components that share a bucket, confirmed on full sets.

    A first pass names the nodes of every cell that have close pairs there, and the pairs; the second gets their texts.
    """
    spark = members.sparkSession
    kind = members.schema["id"].dataType.simpleString()

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, (ids, component, *columns) in each_cell(batches):
            partners: dict = {}
            for g, x, y in cell_pairs(component, *columns, cell[0], cell[1] != cell[2], False, params):
                partners.setdefault(x, []).append((g, ids[y]))
                partners.setdefault(y, [])
            if partners:
                rows = list(partners)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([c] * len(rows), k) for c, k in zip(cell, (pa.int64(), pa.int32(), pa.int32()))),
                     pa.array(ids[rows]), pa.array(component[rows]),
                     pa.array([[{"guess": g, "other": o} for g, o in partners[x]] for x in rows],
                              pa.list_(pa.struct([("guess", pa.float64()), ("other", pa.array(ids[:1]).type)])))],
                    names=[*CELL, "id", "component", "partners"])

    named = dealt_cells(members, params, False, 0).mapInArrow(
        candidates, f"key bigint, _lo int, _hi int, id {kind}, component {kind}, partners array<struct<guess: double, other: {kind}>>")
    named = cut(named, "cells")
    texts = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = cut(texts.join(named.select("id").distinct().hint("merge"), "id"), "texts")
    met = named.join(texts.hint("merge"), "id").repartition(*CELL).sortWithinPartitions(*CELL)

    def links(rows: list[tuple]) -> list[tuple]:
        component, sets, pairs, roots = {}, {}, {}, Roots()
        for own, of, partners, members_of in rows:
            component[own] = of
            sets.setdefault(own, []).append(members_of)
            pairs |= {(own, p["other"]): p["guess"] for p in partners}
        found = []
        for own, other in sorted(pairs, key=pairs.get, reverse=True):
            left, right = component[own], component[other]
            if roots.find(left) != roots.find(right) and any(
                    alike(x, y, params.percent) for x in sets[own] for y in sets[other]):
                roots.join(left, right)
                found.append((own, other))
        return found

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []

        def give(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            found = links(rows)
            if found:
                kinds = [batch.schema.field("id").type] * 2
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found), kinds)], names=["a", "b"])

        batch = None
        for batch in small_batches(batches, "text"):
            sets = shingle_sets(*flat_bytes(batch.column("text")), params.words)
            keys = zip(*(batch.column(c).to_pylist() for c in CELL))
            rest = zip(*(batch.column(c).to_pylist() for c in ("id", "component", "partners")), sets)
            for key, row in zip(keys, rest):
                if key != held:
                    yield from give(batch)
                    held, rows = key, []
                rows.append(row)
        if rows:
            yield from give(batch)

    out = cut(met.mapInArrow(work, f"a {kind}, b {kind}").distinct(), "links")
    discard(spark, named, texts)
    return out


def open_members(members: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of buckets that hold several components of `links`, with their component, size, sketch and bands."""
    groups = cut(connected_components(links), "components").select(F.col("node").alias("id"), F.col("component").alias("_c"))
    named = cut(members.join(groups, "id", "left").select(
        "key", "_n", "_size", "id", F.coalesce("_c", "id").alias("component")), "named")
    ends = named.groupBy("key").agg(F.min("component").alias("_least"), F.max("component").alias("_most"))
    mixed = cut(ends.where(F.col("_least") != F.col("_most")).select("key"), "mixed")
    out = cut(named.join(mixed, "key").join(nodes, "id"), "open")
    discard(members.sparkSession, named, mixed)
    return out


def near_duplicates(
    df: DataFrame, params: NearDupParams = NearDupParams(), id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """`id_col`, n_shingles, component_id, kept: one row per input row.

    component_id is the smallest id that links lead to, the row's own included; kept where it is the row's own. A null
    or empty text, or one without words, has no shingles and no links. Rows that repeat an id are one node with the links
    of all of them. A row without an id is linked with nothing and kept. An empty table gives an empty one; other columns
    are not read. Links of similarity 0.75 are missed with probability 5e-6, of 0.8 with 5e-8, and confirmed exactly.
    """
    spark = df.sparkSession
    rows = cut(signatures(df, params, id_col, text_col), "signatures")
    full = rows.where(F.col("set_key").isNotNull() & F.col("id").isNotNull())
    sets = cut(full.groupBy("set_key").agg(F.min("id").alias("rep")), "sets")
    nodes = full.join(sets.select("set_key", F.col("rep").alias("id")), ["set_key", "id"]).dropDuplicates(["set_key", "id"])
    nodes = cut(nodes.select("id", "n_shingles", "sketch", "bands"), "nodes")
    banded = nodes.select("id", "n_shingles", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("n_shingles").alias("_size"), F.min("id").alias("centre")).where("_n > 1")
    buckets = cut(buckets, "buckets")
    members = cut(banded.drop("n_shingles").join(buckets, "key"), "members")
    pairs = members.groupBy(F.col("id").alias("b")).agg(F.min("centre").alias("a")).where("a != b").select("a", "b")
    pairs = cut(pairs, "pairs")
    links = cut(confirm(cut(close_pairs(pairs, nodes, params), "pairs"), df, params, id_col, text_col), "links")
    tried = pairs
    for turn in range(2):
        rest = open_members(members, nodes, links)
        more = cut(likely_pairs(rest, params, turn).join(tried, ["a", "b"], "left_anti"), "pairs")
        links = cut(links.unionAll(confirm(more, df, params, id_col, text_col)), "links")
        tried = tried.unionAll(more)
        discard(spark, rest)
    rest = open_members(members, nodes, links)
    links = cut(links.unionAll(cell_links(rest, df, params, id_col, text_col)), "links")
    discard(spark, rest)
    groups = cut(connected_components(links), "components")

    by_set = sets.join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        F.col("set_key").alias("_key"), F.coalesce("component", "rep").alias("_component"))
    by_set = cut(by_set, "by-set")
    own = rows.join(by_set, (F.col("set_key") == F.col("_key")) & F.col("id").isNotNull(), "left")
    component = F.coalesce("_component", "id")
    out = own.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"),
                     F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
    discard(spark, nodes, buckets, members, links)
    return out


def keep_one_of_each(
    df: DataFrame, params: NearDupParams = NearDupParams(), id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The rows of `df`, as they came, one of each component: that of the smallest id.

    Components that hold a repeated id are searched again row by row, so that a document stored twice stays once and
    other texts under its id stay too; of rows of one id the first in a written order stays. Rows without an id or
    without words all stay.
    """
    spark = df.sparkSession
    groups = cut(near_duplicates(df, params, id_col, text_col).where((F.col("n_shingles") > 0) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.col("component_id").alias("_component"), "kept"), "groups")
    repeated = groups.groupBy("_id").agg(F.count(F.lit(1)).alias("_n"), F.min("_component").alias("_component")).where("_n > 1")
    repeated = cut(repeated.select("_component").distinct(), "repeated")
    gone = cut(groups.join(repeated, "_component", "left_anti").where("NOT kept").select(F.col("_id").alias("_gone")).distinct(), "gone")
    again = cut(groups.join(repeated, "_component").select("_id").distinct(), "again")
    single = df.join(gone.hint("merge"), df[id_col] == gone["_gone"], "left_anti")
    if again.isEmpty():
        discard(spark, groups)
        return single

    # Rows of these ids under numbers of their own.
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    held = rows.join(again.hint("merge"), rows["row"][id_col] == again["_id"])
    held = cut(held.select(F.monotonically_increasing_id().alias("_number"), "_id", "row"), "rows")
    found = near_duplicates(held.select("_number", F.col("row")[text_col].alias("text")), params, "_number", "text")
    found = found.where("n_shingles > 0").join(held.select("_number", "_id"), "_number")
    drop = found.groupBy("component_id").agg(F.min(F.struct("_id", "_number")).alias("first"))
    drop = found.join(drop, "component_id").where(F.col("first._number") != F.col("_number")).select("_number")
    stay = held.join(cut(drop, "gone").hint("merge"), "_number", "left_anti")
    discard(spark, groups)
    other = single.join(again.hint("merge"), single[id_col] == again["_id"], "left_anti")
    return other.unionAll(stay.select(*(F.col("row")[c].alias(c) for c in df.columns)))

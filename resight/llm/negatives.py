"""Hard negatives by an inverted multi-index.

Vectors are cut in half; each half has a small codebook, and a pair of codes is a cell. The inner product of an anchor
with any row of a cell is at most the sum of two half bounds: its product with each half's centre, plus its own length
times the radius of the code there. A heap over the two sorted lists of half bounds visits cells from the highest sum
down, and stops when every window that is still to be filled is certified: it has all it wants, and the next cell's bound
is below its last score, or the bound is below the window itself.

Two searches make the result: first the positives of every anchor, then, in windows that the positives' scores set, its
negatives. Blocks of anchors meet blocks of rows by a join; each meeting visits the cells of its block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resight.llm.topk import usable, whole_numbers
from resight.session import cut, cut_and_observe


@dataclass(frozen=True)
class NegativeParams:
    positives: int = 5
    negatives: int = 10
    #: A negative's score lies between these hundredths of its positive's.
    low: int = 30
    high: int = 90
    scale: float = 256.0
    #: Codes of each half; the codebooks are fitted on so many rows, the smallest by hash of their id.
    codes: int = 16
    sample: int = 8192
    rounds: int = 10
    vector_block: int = 8192
    anchor_block: int = 256
    #: Blocks of rows, and of anchors, that share a key of the join.
    blocks_per_cell: int = 8
    blocks_per_group: int = 64


@dataclass
class Codebooks:
    """Centres of the first `cut` components, and of the others."""

    cut: int
    halves: tuple[np.ndarray, np.ndarray]

    @classmethod
    def fit(cls, rows: np.ndarray, codes: int, rounds: int) -> Codebooks:
        split = rows.shape[1] // 2
        return cls(split, tuple(centres(half, codes, rounds) for half in (rows[:, :split], rows[:, split:])))

    def of_width(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Both halves for vectors of this width, which is at least that of the sample; missing components are 0."""
        left, right = self.halves
        return left, np.pad(right, ((0, 0), (0, width - self.cut - right.shape[1])))


def centres(rows: np.ndarray, codes: int, rounds: int) -> np.ndarray:
    """k-means from evenly spaced rows; an empty cluster keeps its centre."""
    if not len(rows):
        return np.zeros((1, rows.shape[1]))
    found = np.unique(rows[:: max(1, len(rows) // codes)][:codes], axis=0)
    for _ in range(rounds):
        code = nearest(rows, found)
        sums = np.zeros_like(found)
        np.add.at(sums, code, rows)
        counts = np.bincount(code, minlength=len(found))
        found = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], found)
    return found


def nearest(rows: np.ndarray, found: np.ndarray) -> np.ndarray:
    return (rows @ found.T - (found**2).sum(axis=1) / 2).argmax(axis=1)


def cells_by_bound(left: list[float], right: list[float]) -> Iterator[tuple[float, int, int]]:
    """All pairs of places of two descending lists, by their sum, the highest first."""
    heap, reached = [(-(left[0] + right[0]), 0, 0)], [0] * len(left)
    while heap:
        bound, x, y = heappop(heap)
        yield -bound, x, y
        reached[x] = y + 1
        if y + 1 < len(right) and (x == 0 or reached[x - 1] > y + 1):
            heappush(heap, (-(left[x] + right[y + 1]), x, y + 1))
        if x + 1 < len(left) and reached[x + 1] == y:
            heappush(heap, (-(left[x + 1] + right[y]), x + 1, y))


def narrowed(grid: np.ndarray) -> np.ndarray:
    """Integers in the smallest type that holds them."""
    for kind in (np.int16, np.int32):
        if not grid.size or (grid.min() >= np.iinfo(kind).min and grid.max() <= np.iinfo(kind).max):
            return grid.astype(kind)
    return grid


def grid_of(vectors: list[list[int]]) -> np.ndarray:
    width = max(map(len, vectors), default=0)
    grid = np.zeros((len(vectors), width), dtype=np.int64)
    for at, vector in enumerate(vectors):
        grid[at, : len(vector)] = vector
    return grid


@dataclass
class Index:
    """A block of rows sorted by cell; for each half the codes that occur and their radii."""

    ids: np.ndarray
    labels: np.ndarray
    rows: np.ndarray
    codes: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    #: Where the rows of every pair of occurring codes begin (and the last end).
    starts: np.ndarray
    books: tuple[np.ndarray, np.ndarray]
    largest: int

    @classmethod
    def build(cls, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, books: Codebooks) -> Index:
        width = max(rows.shape[1], books.cut + books.halves[1].shape[1])
        rows = np.pad(rows, ((0, 0), (0, width - rows.shape[1])))
        wide = rows.astype(np.float64)
        pair = books.of_width(width)
        codes, radii, places = [], [], []
        for half, book in zip((wide[:, : books.cut], wide[:, books.cut :]), pair):
            code = nearest(half, book)
            found, place = np.unique(code, return_inverse=True)
            radius = np.zeros(len(found))
            np.maximum.at(radius, place, np.sqrt(((half - book[code]) ** 2).sum(axis=1)))
            codes.append(found)
            radii.append(radius)
            places.append(place)
        cell = places[0] * len(codes[1]) + places[1]
        order = np.argsort(cell, kind="stable")
        starts = np.searchsorted(cell[order], np.arange(len(codes[0]) * len(codes[1]) + 1))
        largest = int(np.abs(wide).max(initial=0))
        return cls(ids[order], labels[order], rows[order], tuple(codes), tuple(radii), starts, pair, largest)


@dataclass
class Want:
    """The `size` best rows of a window of scores, ties to the smaller id."""

    low: float
    high: float
    size: int
    ids: np.ndarray
    scores: np.ndarray

    @property
    def bar(self) -> float:
        """Scores below it are of no use."""
        if self.low > self.high:
            return np.inf
        return self.scores[-1] if len(self.scores) == self.size else self.low

    def take(self, ids: np.ndarray, scores: np.ndarray) -> None:
        fit = np.flatnonzero((scores >= self.bar) & (scores <= self.high))
        if fit.size:
            ids, scores = np.concatenate([self.ids, ids[fit]]), np.concatenate([self.scores, scores[fit]])
            order = np.lexsort((ids, -scores))[: self.size]
            self.ids, self.scores = ids[order], scores[order]


def fill(wants: list[Want], own: int, label: int, same: bool, anchor: np.ndarray, index: Index) -> int:
    """Fill the wants of one anchor from a block, with rows of its own label or of all others; how many rows were scored."""
    width = max(len(anchor), index.rows.shape[1])
    anchor = np.pad(anchor, (0, width - len(anchor)))[: index.rows.shape[1]]  # what a row lacks counts as 0

    def score(part: np.ndarray | slice, exact: bool = True) -> None:
        rows = index.rows[part]
        if not exact:
            found = (rows.astype(np.int64) * anchor).sum(axis=1)
        else:
            found = (rows.astype(kind) @ anchor.astype(kind)).astype(np.int64)
        fit = ((index.labels[part] == label) == same) & (index.ids[part] != own)
        ids, found = index.ids[part][fit], found[fit]
        for want in wants:
            want.take(ids, found)

    size = len(anchor) * max(1.0, float(np.abs(anchor.astype(np.float64)).max(initial=0))) * max(1.0, float(index.largest))
    if size >= 2.0**52:  # beyond exact doubles: 64-bit integers, no bounds
        score(slice(None), exact=False)
        return len(index.ids)
    kind = np.float32 if size < 2.0**24 else np.float64
    split, q = index.books[0].shape[1], anchor.astype(np.float64)
    order, bounds = [], []
    for half, book, codes, radius in zip((q[:split], q[split:]), index.books, index.codes, index.radii):
        bound = book[codes] @ half + np.sqrt((half**2).sum()) * radius
        bound += 0.25 + 1e-9 * np.abs(bound)
        order.append(np.argsort(-bound, kind="stable"))
        bounds.append(bound[order[-1]].tolist())
    first, second = (x.tolist() for x in order)
    bar, waiting, size, batch, seen = min(w.bar for w in wants), [], 0, 256, 0
    for bound, x, y in cells_by_bound(*bounds):
        if bound < bar:
            break
        cell = first[x] * len(second) + second[y]
        begin, end = index.starts[cell], index.starts[cell + 1]
        if begin == end:
            continue
        waiting.append(np.arange(begin, end))
        size += end - begin
        if size >= batch:
            score(np.concatenate(waiting))
            seen, waiting, size, batch = seen + size, [], 0, min(2 * batch, 4096)
            bar = min(w.bar for w in wants)
    if waiting:
        score(np.concatenate(waiting))
    return seen + size


def packed_rows(df: DataFrame, block: int) -> DataFrame:
    """Rows (ids, labels, vectors, dims, n): up to `block` rows (id, label, vector) of a partition."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[], [], []]

        def give(count: int) -> pa.RecordBatch:
            ids, labels, vectors = (x[:count] for x in held)
            for x in held:
                del x[:count]
            grid = grid_of(vectors)
            return pa.RecordBatch.from_arrays(
                [pa.array([ids], pa.list_(pa.int64())), pa.array([labels], pa.list_(pa.int64())),
                 pa.array([narrowed(grid).tobytes()], pa.binary()), pa.array([grid.shape[1]], pa.int32()), pa.array([len(ids)], pa.int32())],
                names=["ids", "labels", "vectors", "dims", "n"])

        for batch in batches:
            for name, x in zip(("id", "label", "vector"), held):
                x += batch.column(name).to_pylist()
            while len(held[0]) >= block:
                yield give(block)
        if held[0]:
            yield give(block)

    return df.select("id", "label", "vector").mapInArrow(work, "ids array<bigint>, labels array<bigint>, vectors binary, dims int, n int")


BLOCK = ("ids", "labels", "vectors", "dims", "n")


def opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, dims, raw = row["n"], row["dims"], row["vectors"]
    kind = {2: np.int16, 4: np.int32}.get(len(raw) // (n * dims) if n * dims else 2, np.int64)
    return np.array(row["ids"], np.int64), np.array(row["labels"], np.int64), np.frombuffer(raw, kind).reshape(n, dims)


def meetings(anchors: DataFrame, blocks: DataFrame, asked: int, known: int, params: NegativeParams) -> DataFrame:
    """Every block of anchors (q_no, q) with every block of rows (no, v), as a join on keys of a bounded number of both."""
    groups = max(-(-asked // params.blocks_per_group), min(asked, 4), 1)
    cells = max(-(-known // params.blocks_per_cell), min(known, 64), 1)
    left = anchors.withColumn("group", F.pmod(F.xxhash64("q_no"), F.lit(groups)).cast("int")).withColumn(
        "cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    right = blocks.withColumn("cell", F.pmod(F.xxhash64("no"), F.lit(cells)).cast("int")).withColumn(
        "group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return left.join(right.hint("merge"), ["group", "cell"]).select("q_no", "q", "v")


def searched(
    met: DataFrame, books: Codebooks, same: bool, wants: Callable[[dict, int], list[Want]],
) -> DataFrame:
    """anchor_id, part, vec_id, score: what each want (a part) of every anchor finds in the blocks of a task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own, parts = None, None, []

        def give() -> Iterator[pa.RecordBatch]:
            found = [(i, p, w) for i, ws in zip(own, parts) for p, w in enumerate(ws) if len(w.ids)]
            if found:
                counts = [len(w.ids) for _, _, w in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([i for i, _, _ in found], counts), pa.int64()),
                     pa.array(np.repeat([p for _, p, _ in found], counts), pa.int32()),
                     pa.array(np.concatenate([w.ids for _, _, w in found]), pa.int64()),
                     pa.array(np.concatenate([w.scores for _, _, w in found]), pa.int64())], names=["anchor_id", "part", "vec_id", "score"])

        for batch in batches:
            for at in range(batch.num_rows):
                no, q, v = (batch.column(c)[at].as_py() for c in ("q_no", "q", "v"))
                if no != held:
                    if held is not None:
                        yield from give()
                    held, (own, labels, anchors) = no, opened(q)
                    anchors = anchors.astype(np.int64)
                    parts = [wants(q, place) for place in range(len(own))]
                index = Index.build(*opened(v), books)
                for place, ws in enumerate(parts):
                    if ws:
                        fill(ws, own[place], labels[place], same, anchors[place], index)
        if held is not None:
            yield from give()

    return met.mapInArrow(work, "anchor_id bigint, part int, vec_id bigint, score bigint")


def best(found: DataFrame, size: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "part").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def empty_want(low: float, high: float, size: int) -> Want:
    return Want(low, high, size, np.empty(0, np.int64), np.empty(0, np.int64))


def hard_negatives(
    df: DataFrame, anchors: Column, label: Column, params: NegativeParams = NegativeParams(), id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Of every row that `anchors` names: its `positives` nearest other rows of the same `label`, and for each of them the
    `negatives` nearest rows of other labels whose score is `low` to `high` hundredths of the positive's. Scores are exact
    inner products of floor(scale * x) (64 bits; larger ones wrap), ties go to the smaller id. A positive of negative
    score has an empty window.

    Rows without an id, a label or a vector, or with a null or non-finite component, take no part; a shorter vector
    counts as filled up with zeros. Rows with the anchor's own id are neither positives nor negatives; a repeated row is
    found as often as it stands; of repeated anchor ids the smallest label and vector asks. An empty table gives an
    empty one; other columns are not read.

    Every anchor meets every block of rows, so the work grows with anchors times rows; what bounds save depends on how
    well the vectors cluster. The codebooks only decide how fast a search is: radii are measured on every row.
    """
    fit = df.withColumn("_label", label.cast("long")).where(
        F.col(id_col).isNotNull() & F.col("_label").isNotNull() & usable(F.col(vector_col)))
    slim, seen = cut_and_observe(
        fit.select(F.col(id_col).cast("long").alias("id"), F.col("_label").alias("label"),
                   whole_numbers(F.col(vector_col), params.scale).alias("vector"), F.coalesce(anchors, F.lit(False)).alias("asks")),
        "rows", F.count(F.lit(1)).alias("n"))
    drawn = slim.orderBy(F.xxhash64("id", "vector")).limit(params.sample).select("vector").toArrow()
    books = Codebooks.fit(grid_of(drawn.column("vector").to_pylist()).astype(np.float64), params.codes, params.rounds)

    dealt = slim.withColumn("_deal", F.xxhash64("id", F.monotonically_increasing_id())).repartition(
        max(1, -(-seen["n"] // params.vector_block)), "_deal")
    blocks, known = cut_and_observe(
        packed_rows(dealt, params.vector_block).select(F.struct(*BLOCK).alias("v"), F.monotonically_increasing_id().alias("no")),
        "blocks", F.count(F.lit(1)).alias("n"))
    asking = slim.where("asks").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("least")).select("id", "least.*")
    asking, asked = cut_and_observe(asking, "anchors", F.count(F.lit(1)).alias("n"))

    def question(rows: DataFrame) -> DataFrame:
        parts = max(1, -(-asked["n"] // params.anchor_block))
        return packed_rows(rows.repartition(parts, "id"), params.anchor_block).select(
            F.struct(*BLOCK).alias("q"), F.monotonically_increasing_id().alias("q_no"))

    first, count = cut_and_observe(question(asking), "asking", F.count(F.lit(1)).alias("n"))
    size = params.positives
    found = searched(meetings(first, blocks, count["n"], known["n"], params), books, True,
                     lambda q, place: [empty_want(-np.inf, np.inf, size)])
    positives = cut(best(found, size).select("anchor_id", (F.col("rank") - 1).alias("part"), F.col("vec_id").alias("positive_id"),
                                             F.col("score").alias("positive_score")), "positives")

    # The same blocks of anchors, with the scores of their positives beside them.
    bars = positives.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("part", "positive_score"))).alias("bars"))
    members = first.select("q_no", F.posexplode("q.ids").alias("place", "anchor_id"))
    beside = members.join(bars, "anchor_id").groupBy("q_no").agg(F.collect_list(F.struct("place", F.col("bars.positive_score").alias("scores"))).alias("bars"))
    second = first.join(beside, "q_no").select("q_no", F.struct("q.*", "bars").alias("q"))
    low, high, most = params.low, params.high, params.negatives

    def windows(q: dict, place: int) -> list[Want]:
        if "scores" not in q:
            q["scores"] = {b["place"]: b["scores"] for b in q["bars"]}
        # Windows in whole numbers: low * p <= 100 * n <= high * p.
        return [empty_want(-(-low * p // 100), high * p // 100, most) for p in q["scores"].get(place, ())]

    found = searched(meetings(second, blocks, count["n"], known["n"], params), books, False, windows)
    negatives = best(found, most)
    return positives.join(negatives, ["anchor_id", "part"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))

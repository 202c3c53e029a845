"""Link points into chains and chain ends to each other.

Points are peaks of an image grid: peaks(image_id, i, j, pi, pj, ni, nj) with the cell (i, j),
the sub-cell position (pi, pj) and the unit normal (ni, nj). A cell holds at most one peak, so
neighbourhood joins are equi joins on shifted cells with at most eight matches per point.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from resight.session import cut, cut_and_observe, discard

# Fixed value: peaks closer than this share of a cell are one peak.
MERGE_DISTANCE = math.sqrt(2.0) / 4.0
NODE = ["image_id", "i", "j"]
#: Side in cells of the image tiles inside which walks are contracted.
TILE = 128
# How a walk stops inside a tile.
_ENDS, _LEAVES, _RING = 0, 1, 2


def cell_neighbours(peaks: DataFrame) -> DataFrame:
    """Each peak beside the peaks of the eight cells around it (columns prefixed o_)."""
    offsets = F.array(*[
        F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)
    ])
    asked = peaks.withColumn("_o", F.explode(offsets)).withColumns(
        {"o_i": F.col("i") + F.col("_o.di"), "o_j": F.col("j") + F.col("_o.dj")}
    ).drop("_o")
    others = peaks.select("image_id", *[F.col(c).alias(f"o_{c}") for c in ("i", "j", "pi", "pj", "ni", "nj")])
    # The copies outgrow the planner's estimate: never broadcast them.
    return asked.hint("merge").join(others, ["image_id", "o_i", "o_j"])


def _gap() -> Column:
    return F.sqrt((F.col("pi") - F.col("o_pi")) ** 2 + (F.col("pj") - F.col("o_pj")) ** 2)


def collapse_near_peaks(peaks: DataFrame, closer_than: float = MERGE_DISTANCE) -> DataFrame:
    """Merge peaks that lie almost on each other.

    A peak with no too-close peak at a smaller cell survives and takes the mean position and the
    mean normal (signs aligned, unit length) of itself and the too-close peaks at larger cells.
    Any other peak goes.
    """
    close = cell_neighbours(peaks).filter(_gap() < closer_than)
    smaller = (F.col("o_i") < F.col("i")) | ((F.col("o_i") == F.col("i")) & (F.col("o_j") < F.col("j")))
    sign = F.when(F.col("ni") * F.col("o_ni") + F.col("nj") * F.col("o_nj") >= 0, 1.0).otherwise(-1.0)
    merged = close.groupBy(*NODE).agg(
        F.count(F.when(smaller, F.lit(1))).alias("_smaller"),
        F.count(F.when(~smaller, F.lit(1))).alias("_n"),
        *[F.sum(F.when(~smaller, F.col(f"o_{c}"))).alias(f"_s{c}") for c in ("pi", "pj")],
        *[F.sum(F.when(~smaller, F.col(f"o_{c}") * sign)).alias(f"_s{c}") for c in ("ni", "nj")],
    )
    joined = peaks.join(merged, NODE, "left").filter(F.coalesce("_smaller", F.lit(0)) == 0)
    count = F.coalesce("_n", F.lit(0)) + 1
    mean = {c: (F.col(c) + F.coalesce(f"_s{c}", F.lit(0.0))) / count for c in ("pi", "pj", "ni", "nj")}
    length = F.sqrt(mean["ni"] ** 2 + mean["nj"] ** 2)
    touched = F.coalesce("_n", F.lit(0)) > 0
    out = {c: F.when(touched, mean[c]).otherwise(F.col(c)) for c in ("pi", "pj")}
    out |= {c: F.when(touched, mean[c] / F.when(length > 0, length)).otherwise(F.col(c)) for c in ("ni", "nj")}
    return joined.select(*NODE, *[v.alias(c) for c, v in out.items()])


def directed_links(peaks: DataFrame) -> DataFrame:
    """Nearest neighbour ahead and behind each peak, seen along its normal.

    (image_id, i, j, side in fwd/bwd, t_i, t_j); ties go to the smaller cell.
    """
    near = cell_neighbours(peaks)
    offset = (F.col("o_pi") - F.col("pi")) * F.col("nj") - (F.col("o_pj") - F.col("pj")) * F.col("ni")
    sided = near.withColumn("side", F.when(offset > 0, "fwd").when(offset < 0, "bwd")).filter("side is not null")
    best = sided.groupBy(*NODE, "side").agg(F.min(F.struct(_gap().alias("d"), "o_i", "o_j")).alias("_b"))
    return best.select(*NODE, "side", F.col("_b.o_i").alias("t_i"), F.col("_b.o_j").alias("t_j"))


def mutual_links(links: DataFrame) -> DataFrame:
    """Links whose target links back, on either side."""
    back = links.select(
        "image_id", F.col("t_i").alias("i"), F.col("t_j").alias("j"), F.col("i").alias("t_i"), F.col("j").alias("t_j")
    ).distinct()
    return links.join(back, [*NODE, "t_i", "t_j"], "left_semi")


def _contract(part: pd.DataFrame) -> pd.DataFrame:
    """Follow every arc of one image tile until its chain ends or leaves the tile.

    Arcs (ai, aj) -> (bi, bj): `own` ones start in the tile, the others come into it from outside and are only
    followed, not entered; `leaves` marks own arcs that end outside. Per arc: the last arc (x, y) it reaches here, the
    arcs before that one, the smallest node seen, and how the walk stops.
    """
    tails, heads = part[["ai", "aj"]].to_numpy(), part[["bi", "bj"]].to_numpy()
    # Nodes by rank, so that the smallest cell is the smallest number.
    nodes, rank = np.unique(np.concatenate([tails, heads]), axis=0, return_inverse=True)
    a, b = rank.reshape(2, -1)
    own = part["own"].to_numpy()
    starts = np.lexsort((b, a))
    starts = starts[own[starts]]
    follower = np.full(len(a), -1)
    if len(starts):
        first, end = (np.searchsorted(a[starts], b, side=s) for s in ("left", "right"))
        # The greatest follower that does not go back to where the walk came from.
        last, other = starts[np.maximum(end - 1, 0)], starts[np.maximum(end - 2, 0)]
        back = b[last] == a
        follower = np.where((end > first) & ~back, last, np.where((end > first + 1) & back, other, -1))
    here = np.arange(len(a))
    reached = np.where(follower < 0, here, follower)
    steps = (follower >= 0).astype(np.int64)
    low = np.minimum(a, b)
    low = np.minimum(low, low[reached])
    for _ in range(len(a).bit_length() + 1):
        if (follower[reached] < 0).all():
            break
        steps += steps[reached]
        low = np.minimum(low, low[reached])
        reached = reached[reached]
    kind = np.where(follower[reached] >= 0, _RING, np.where(part["leaves"].to_numpy()[reached], _LEAVES, _ENDS))
    out = part[["image_id", "ai", "aj", "bi", "bj", "own"]].copy()
    out["xi"], out["xj"] = tails[reached].T
    out["yi"], out["yj"] = heads[reached].T
    out["low_i"], out["low_j"] = nodes[low].T
    out["steps"], out["kind"] = steps, kind.astype(np.int32)
    return out


def _walks(links: DataFrame, tile: int = TILE, max_rounds: int = 64) -> tuple[DataFrame, bool]:
    """Follow every link to the end of its chain.

    An arc a -> b is followed by b -> c with c != a. Walks are contracted inside image tiles of `tile` x `tile` cells in
    one pass; a tile holds at most that many points. What is left are the arcs that cross a border, each with the next
    one its walk comes to, and these are followed by pointer doubling: after r rounds one has seen 2^r crossings. So the
    rounds, each a written table of crossings, grow with the logarithm of a chain's crossings, not of its points.
    Returns arcs (a, b) with the end node u, the hops to it, the smallest node seen and whether the walk is a ring (u
    and hops then mean nothing), and whether there are rings.
    """
    spark = links.sparkSession
    kinds = {c: links.schema[c].dataType for c in ("i", "j")}
    flat = links.select("image_id", *[F.col(c).cast("bigint").alias(n) for c, n in zip(
        ("i", "j", "t_i", "t_j"), ("ai", "aj", "bi", "bj"))]).distinct()
    cell = {f"_{n}": F.floor(F.col(n) / F.lit(tile)) for n in ("ai", "aj", "bi", "bj")}
    leaves = (F.col("_ai") != F.col("_bi")) | (F.col("_aj") != F.col("_bj"))
    home = F.struct(F.col("_ai").alias("ti"), F.col("_aj").alias("tj"), F.lit(True).alias("own"), leaves.alias("leaves"))
    entered = F.struct(F.col("_bi").alias("ti"), F.col("_bj").alias("tj"), F.lit(False).alias("own"), F.lit(False).alias("leaves"))
    dealt = flat.withColumns(cell).select(
        "image_id", "ai", "aj", "bi", "bj", F.inline(F.when(leaves, F.array(home, entered)).otherwise(F.array(home))))
    image = f"image_id {links.schema['image_id'].dataType.simpleString()}"
    longs = ", ".join(f"{c} bigint" for c in ("xi", "xj", "yi", "yj", "low_i", "low_j", "steps"))
    contracted = dealt.groupBy("image_id", "ti", "tj").applyInPandas(
        _contract, f"{image}, ai bigint, aj bigint, bi bigint, bj bigint, own boolean, {longs}, kind int")

    def node(i: str, j: str) -> Column:
        return F.struct(F.col(i).cast(kinds["i"]).alias("i"), F.col(j).cast(kinds["j"]).alias("j"))

    goes_on = F.col("kind") == _LEAVES
    state = contracted.select(
        "image_id", node("ai", "aj").alias("a"), node("bi", "bj").alias("b"), "own",
        node("yi", "yj").alias("u"), F.when(goes_on, F.struct(node("xi", "xj").alias("a"), node("yi", "yj").alias("b"))).alias("v"),
        (F.col("steps") + F.when(goes_on, 0).otherwise(1)).alias("hops"), node("low_i", "low_j").alias("low"),
        (F.col("kind") == _RING).alias("ring"))
    # v is the crossing the walk goes on with, hops the arcs before it; v is null where the walk is over.
    inside, seen = cut_and_observe(
        state, "tiles", F.count(F.when(~F.col("own"), 1)).alias("crossings"), F.count(F.when(F.col("ring"), 1)).alias("rings"),
        F.count(F.when(~F.col("own"), F.col("v"))).alias("open"))
    rings = seen["rings"] > 0
    done = inside.filter("own and v is null").select("image_id", "a", "b", "u", "hops", "low", "ring")
    if not seen["crossings"]:
        return done, rings
    border = inside.filter("not own").select("image_id", F.struct("a", "b").alias("at"), "u", "v", "hops", "low", "ring")
    written: list[DataFrame] = []
    for _ in range(max_rounds):
        if not seen["open"]:
            break
        jump = border.select("image_id", F.col("at").alias("v"), *[F.col(c).alias(f"_{c}") for c in ("u", "v", "hops", "low", "ring")])
        moved = border.filter("v is not null").join(jump, ["image_id", "v"]).select(
            "image_id", "at", F.col("_u").alias("u"), F.col("_v").alias("v"), (F.col("hops") + F.col("_hops")).alias("hops"),
            F.least("low", "_low").alias("low"), F.col("_ring").alias("ring"),
            (F.col("_v").isNull() | (F.col("_low") < F.col("low"))).alias("_new"))
        merged = moved.unionByName(border.filter("v is null").withColumn("_new", F.lit(False)))
        merged, seen = cut_and_observe(merged, "crossings", F.count("v").alias("open"), F.count(F.when(F.col("_new"), 1)).alias("progress"))
        discard(spark, *written)
        border, written = merged.drop("_new"), [merged]
        # Crossings that neither close nor see a smaller node any more lie on rings.
        if not seen["progress"]:
            rings = rings or seen["open"] > 0
            break
    else:
        raise RuntimeError("chains did not close; raise max_rounds")
    rest = border.select(
        "image_id", F.col("at").alias("v"), F.col("u").alias("_u"), F.col("hops").alias("_hops"), F.col("low").alias("_low"),
        (F.col("ring") | F.col("v").isNotNull()).alias("_ring"))
    outside = inside.filter("own and v is not null").join(rest, ["image_id", "v"]).select(
        "image_id", "a", "b", F.col("_u").alias("u"), (F.col("hops") + F.col("_hops")).alias("hops"),
        F.least("low", "_low").alias("low"), F.col("_ring").alias("ring"))
    walks = cut(done.unionByName(outside), "walks")
    discard(spark, inside, *written)
    return walks, rings


def connected_chains(peaks: DataFrame, links: DataFrame, tile: int = TILE) -> DataFrame:
    """(image_id, i, j, chain_i, chain_j): the smallest cell of the chain each point belongs to."""
    walks, _ = _walks(links, tile)
    lows = walks.groupBy("image_id", "a").agg(F.min("low").alias("_low"))
    nodes = peaks.select(*NODE).distinct()
    labelled = nodes.join(lows.select("image_id", F.col("a.i").alias("i"), F.col("a.j").alias("j"), "_low"), NODE, "left")
    return labelled.select(*NODE, F.coalesce(F.col("_low.i"), F.col("i")).alias("chain_i"),
                           F.coalesce(F.col("_low.j"), F.col("j")).alias("chain_j"))


def link_points(peaks: DataFrame, merge: bool = False, tile: int = TILE) -> DataFrame:
    """Points in chain order: (image_id, contour_id, idx, i, j).

    A chain starts at the far end of the forward side of its smallest cell. In a ring the walk
    forward from the smallest cell takes every point, and that cell comes last.
    """
    used = collapse_near_peaks(peaks) if merge else peaks
    links = cut(mutual_links(directed_links(used)))
    walks, has_rings = _walks(links, tile)
    per_node = walks.groupBy("image_id", "a").agg(
        F.min("low").alias("low"), F.max("ring").alias("ring"),
        F.array_sort(F.collect_list(F.struct("u", "hops", "b"))).alias("_arms"),
    )
    labelled = per_node.select("image_id", F.col("a.i").alias("i"), F.col("a.j").alias("j"), "low", "ring", "_arms")
    nodes = used.select(*NODE).join(labelled, NODE, "left").select(
        *NODE, F.coalesce("low", F.struct("i", "j")).alias("low"), F.coalesce("ring", F.lit(False)).alias("ring"), "_arms"
    )
    # The forward link of the smallest cell decides the direction of its chain.
    start = links.filter("side = 'fwd'").select(
        "image_id", F.struct("i", "j").alias("low"), F.struct(F.col("t_i").alias("i"), F.col("t_j").alias("j")).alias("_f")
    )
    arcs = walks.select("image_id", F.col("a").alias("low"), F.col("b").alias("_f"), F.col("u").alias("_head"))
    heads = start.join(arcs, ["image_id", "low", "_f"], "left")
    ringless = nodes.filter("not ring").join(heads, ["image_id", "low"], "left")
    # Hops to the head: the arm that ends there; the head itself is at 0. Without a forward link
    # the smallest cell is the head.
    head = F.coalesce("_head", F.col("low"))
    arm = F.get(F.filter("_arms", lambda e: e["u"] == head), F.lit(0))
    lines = ringless.select(
        "image_id", "low",
        F.when(F.struct("i", "j") == head, F.lit(0)).otherwise(arm["hops"]).cast("bigint").alias("idx"), "i", "j",
    )
    every = lines
    if has_rings:
        every = lines.unionByName(_ring_places(nodes.filter("ring").select("image_id", "low", "i", "j"), links, start, tile))
    name = F.concat_ws("-", F.col("image_id").cast("string"), F.col("low.i").cast("string"), F.col("low.j").cast("string"))
    return every.select("image_id", name.alias("contour_id"), "idx", "i", "j")


def _ring_places(members: DataFrame, links: DataFrame, start: DataFrame, tile: int) -> DataFrame:
    """Open each ring at its smallest cell and number the points by the walk forward from there."""
    sizes = members.groupBy("image_id", "low").agg(F.count(F.lit(1)).alias("_size"))
    of = members.select("image_id", "i", "j", "low")
    # Without the arcs into the smallest cell every walk ends before it.
    inner = links.join(of, NODE).filter(F.struct("t_i", "t_j") != F.struct(F.col("low.i"), F.col("low.j")))
    inner = inner.filter(F.struct("i", "j") != F.struct(F.col("low.i"), F.col("low.j"))).drop("low")
    walked = _walks(inner, tile)[0].select("image_id", F.col("a.i").alias("i"), F.col("a.j").alias("j"), "u", "hops")
    first = start.select("image_id", "low", F.col("_f").alias("u"))
    placed = of.join(first, ["image_id", "low"]).join(walked, ["image_id", "i", "j", "u"], "left")
    sized = placed.join(sizes, ["image_id", "low"])
    here = F.struct("i", "j")
    # The walk forward visits _f first; the last visited point gets idx 0 and the smallest cell the last one.
    idx = F.when(here == F.col("low"), F.col("_size") - 1).when(here == F.col("u"), F.col("_size") - 2).otherwise(
        F.col("_size") - 2 - F.col("hops")
    )
    return sized.select("image_id", "low", idx.cast("bigint").alias("idx"), "i", "j")


# The four half-open quadrants: (row cells, column cells) to look into from the own cell.
_QUADRANT_CELLS = {1: ((-1, 0), (0, 1)), 2: ((-1, 0), (-1, 0)), 3: ((0, 1), (-1, 0)), 4: ((0, 1), (0, 1))}


def _quadrant(di: Column, dj: Column) -> Column:
    return (
        F.when((di <= 0) & (dj > 0), 1).when((di < 0) & (dj <= 0), 2).when((di >= 0) & (dj < 0), 3)
        .when((di > 0) & (dj >= 0), 4)
    )


def _halvings(places: DataFrame, max_dist: float, per_cell: int = 32, most: int = 12) -> int:
    """How often to halve the cell side so that the fullest cell holds about `per_cell` places."""
    side = F.lit(float(max_dist))
    cell = [F.floor(F.col("o_i") / side).alias("a"), F.floor(F.col("o_j") / side).alias("b")]
    fullest = places.groupBy("image_id", *cell).count().agg(F.max("count")).first()[0] or 1
    return max(0, min(most, math.ceil(math.log(max(fullest / per_cell, 1.0), 4))))


def quadrant_neighbours(endpoints: DataFrame, max_dist: float) -> DataFrame:
    """Nearest endpoint in each of four half-open quadrants, nearer than `max_dist`.

    endpoints(image_id, contour_id, end_id, i, j). The nearest is chosen first and dropped if it
    is of the same contour.

    The search is an equi join on grid cells, from fine cells to coarse ones. A neighbour found
    within one cell side is final, so only quadrants that are empty nearby go on to cells of
    twice the side; in crowded places no point meets more than its close surroundings.
    """
    endpoints = cut(endpoints.select("image_id", "contour_id", "end_id", "i", "j"), "ends")
    # Endpoints at the same place are at equal distance: the smallest id stands for the place.
    places = cut(
        endpoints.groupBy("image_id", "i", "j").agg(F.min(F.struct("end_id", "contour_id")).alias("_o")).select(
            "image_id", F.col("i").alias("o_i"), F.col("j").alias("o_j"), F.col("_o.end_id").alias("o_end"),
            F.col("_o.contour_id").alias("o_contour")), "places")
    looks = F.array(*[
        F.struct(F.lit(q).alias("quadrant"),
                 F.array(*[F.struct(F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b"))
                           for a in rows for b in cols]).alias("_cells"))
        for q, (rows, cols) in _QUADRANT_CELLS.items()
    ])
    asked = endpoints.select("image_id", "contour_id", "end_id", "i", "j", F.inline(looks))
    asker = ["image_id", "end_id", "quadrant"]
    done = None
    halvings = _halvings(places, max_dist)
    for level in range(halvings, -1, -1):
        width = float(max_dist) / 2**level
        side = F.lit(width)
        cells = asked.select(*asker, "i", "j", F.explode("_cells").alias("_c")).select(
            *asker, "i", "j", (F.floor(F.col("i") / side) + F.col("_c.a")).alias("_gi"),
            (F.floor(F.col("j") / side) + F.col("_c.b")).alias("_gj"))
        others = places.withColumns({"_gi": F.floor(F.col("o_i") / side), "_gj": F.floor(F.col("o_j") / side)})
        di, dj = F.col("o_i") - F.col("i"), F.col("o_j") - F.col("j")
        near = (
            cells.hint("merge").join(others, ["image_id", "_gi", "_gj"])
            .withColumns({"dist": F.sqrt(di * di + dj * dj), "_seen": _quadrant(di, dj)})
            .filter((F.col("_seen") == F.col("quadrant")) & (F.col("dist") > 0) & (F.col("dist") < width))
        )
        w = W.partitionBy(*asker).orderBy("dist", "o_end")
        best = near.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1)
        best = best.select(*asker, "dist", "o_end", "o_contour")
        answered = asked.join(best, asker, "left")
        if level:
            answered = cut(answered, "quadrants")
            asked = answered.filter("o_end is null").drop("dist", "o_end", "o_contour")
        found = answered.filter("o_end is not null").select(*asker, "contour_id", "dist", "o_end", "o_contour")
        done = found if done is None else done.unionByName(found)
    return done.filter(F.col("o_contour") != F.col("contour_id")).select(
        "image_id", F.col("end_id").alias("src"), F.col("o_end").alias("dst"), "quadrant", (-F.col("dist")).alias("weight")
    )


def endpoint_links(endpoints: DataFrame, max_dist: float) -> DataFrame:
    """Edges between chain ends: (image_id, src, dst, weight, kind).

    endpoints(image_id, contour_id, end_id, i, j, place in start/end, n_points). A contour of more
    than one point has an edge between its own ends, weighted by its length; others weigh minus
    their distance.
    """
    foreign = quadrant_neighbours(endpoints.select("image_id", "contour_id", "end_id", "i", "j"), max_dist)
    foreign = foreign.groupBy("image_id", "src", "dst").agg(F.max("weight").alias("weight")).withColumn("kind", F.lit("gap"))
    own = (
        endpoints.filter("n_points > 1").groupBy("image_id", "contour_id")
        .agg(F.min(F.when(F.col("place") == "start", F.col("end_id"))).alias("src"),
             F.min(F.when(F.col("place") == "end", F.col("end_id"))).alias("dst"),
             F.max(F.col("n_points").cast("double")).alias("weight"))
        .select("image_id", "src", "dst", "weight", F.lit("contour").alias("kind"))
    )
    return own.unionByName(foreign)

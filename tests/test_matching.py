import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import brute
from checks import inputs
from resight.operators import evidence, linking, neighbours, ranking, warping
from resight.params import LnbnnParams, NeighbourParams, WarpParams
from resight.plans import evaluation, scoring

TIGHT = NeighbourParams(block_rows=16, db_block_rows=32, blocks_per_salt=2, pivots=24)


@pytest.fixture(scope="module")
def vectors(tables):
    return inputs.vectors(tables).cache()


def sides(vectors):
    return vectors.withColumn("query_id", F.col("owner")), vectors.withColumn("target", F.col("label"))


def found(df):
    keys = ["scale", "q_vec", "dist", "d_vec"]
    return df.select("scale", "q_vec", "d_vec", "target", "dist").toPandas().sort_values(keys).reset_index(drop=True)


def test_exact_equals_blocked_equals_brute(vectors):
    q, d = sides(vectors)
    exact = found(neighbours.exact_neighbours(q, d, 3, TIGHT))
    assert exact.equals(found(neighbours.blocked_neighbours(q, d, 3, TIGHT)))
    frame = vectors.toPandas()
    for scale, g in frame.groupby("scale"):
        g = g.sort_values("vec_id")
        m = np.stack(g.vec)
        order = np.argsort(np.sqrt(((m[:, None] - m[None]) ** 2).sum(2)), axis=1, kind="stable")[:, :3]
        got = exact[exact.scale == scale].groupby("q_vec").d_vec.apply(list)
        assert all(got[v] == g.vec_id.iloc[o].tolist() for v, o in zip(g.vec_id, order))


def test_equal_vectors_go_by_id(spark):
    rows = [(0, i, [1.0, 0.0] if i < 40 else [0.0, 1.0], i) for i in range(60)]
    d = spark.createDataFrame(rows, "scale int, vec_id long, vec array<double>, target long")
    q = d.select("scale", "vec_id", "vec", F.col("vec_id").alias("query_id"))
    for method in ("exact", "blocked"):
        got = neighbours.neighbours(q, d, 3, method, NeighbourParams(block_rows=4, db_block_rows=8, pivots=8))
        near = {r.q_vec: r.n for r in got.groupBy("q_vec").agg(F.sort_array(F.collect_list("d_vec")).alias("n")).collect()}
        assert near[17] == [0, 1, 2] and near[59] == [40, 41, 42]


def test_exact_uses_pivots_at_every_size(vectors):
    q, d = sides(vectors)
    plan = neighbours.neighbours(q, d, 3)._jdf.queryExecution().analyzed().toString()
    assert "cell#" in plan


def test_a_query_is_copied_to_few_parts(spark):
    """However many cells there are; a crowded cell runs through several parts. Ids may be text."""
    rng = np.random.default_rng(11)
    data = np.concatenate([rng.normal(size=(500, 4)), 5 + 0.01 * rng.normal(size=(500, 4))])
    data[-40:] = data[-1]
    params = NeighbourParams(block_rows=4, db_block_rows=8, pivots=60, part_rows=50, max_parts=3, max_hands=2)
    vectors, sizes = data[:900:15], np.bincount(rng.integers(0, 60, 200), minlength=60) + 800 * (np.arange(60) == 7)
    layout = neighbours.Layout(vectors, sizes, 1000, params)
    assert layout.holds.shape == (60, 3) and layout.hands == 2 and layout.holds[7].sum() >= 2
    places = np.concatenate([layout.places(np.full(n, c), np.arange(n)) for c, n in enumerate(sizes)])
    assert sorted(places) == list(range(1000))
    assert all(layout.holds[c, p // layout.part_rows] for c, n in enumerate(sizes) for p in layout.places(np.full(n, c), np.arange(n)))
    names = [f"v{i:04d}" for i in rng.permutation(1000)]
    d = spark.createDataFrame([(0, n, v.tolist(), n) for n, v in zip(names, data)], "scale int, vec_id string, vec array<double>, target string")
    q = d.withColumn("query_id", F.col("vec_id"))
    order = np.argsort(names)
    full = np.sqrt(((data[:, None] - data[None]) ** 2).sum(2))
    for method in ("exact", "blocked"):
        got = neighbours.neighbours(q, d, 3, method, params).toPandas().sort_values(["dist", "d_vec"]).groupby("q_vec")["d_vec"].apply(list)
        for i in range(0, 1000, 7):
            near = order[np.argsort(full[i][order], kind="stable")][:3]
            assert got[names[i]] == [names[k] for k in near]


def test_near_copies_are_measured_in_bounded_steps():
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    data = base + 1e-5 * rng.normal(size=(700, 16))
    data[::7] = data[0]
    ids = rng.permutation(700)
    rows, cols, dist = neighbours.nearest_in_block(data[:90], data, ids, 4, width=128)
    full = np.sqrt(((data[:90, None] - data[None]) ** 2).sum(2))
    for q in range(90):
        assert cols[rows == q].tolist() == np.lexsort((ids, full[q]))[:4].tolist()


def test_pruning_skips_cells():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(10, 8)) * 20
    data = np.concatenate([c + rng.normal(size=(50, 8)) for c in centres])
    pivots = neighbours.Pivots({"0": data[::10]})
    cell, far = pivots.cells("0", data)
    pivots.radii["0"] = np.array([far[cell == c].max() if (cell == c).any() else -1.0 for c in range(50)])
    near = pivots.candidates("0", data, 3)
    assert near.mean() < 0.2
    dist = np.sqrt(((data[:, None] - data[None]) ** 2).sum(2))
    for q in range(0, 500, 7):
        assert near[q, cell[np.argsort(dist[q])[:3]]].all()


def test_lsh_recall(vectors):
    q, d = sides(vectors)
    truth = neighbours.blocked_neighbours(q, d, 3)
    assert all(r.recall > 0.9 for r in neighbours.recall(neighbours.lsh_neighbours(q, d, 3), truth).collect())


def test_forest(spark):
    """Leaves are bounded, every row is in one leaf of every tree, recall holds at the default budget and rises to all."""
    from resight.operators import forest
    from resight.params import ForestParams

    rng = np.random.default_rng(11)
    data = rng.normal(size=(3000, 12))
    data /= np.linalg.norm(data, axis=1)[:, None]
    data[:300] = data[0]  # a leaf that no plane cuts
    rows = [("s", i, data[i].tolist(), i % 40) for i in range(3000)] + [("few", i, data[i].tolist(), i) for i in range(5)]
    d = spark.createDataFrame(rows, "scale string, vec_id long, vec array<double>, target int").repartition(4)
    q = d.where("vec_id % 10 = 3").withColumn("query_id", F.col("vec_id"))
    small = ForestParams(leaf=64, levels=2, sample=64, search_k=40)
    built = forest.build_forest(d, small)
    sizes = {tuple(r)[:3]: r["n"] for r in built.leaves.groupBy("scale", "tree", "node").agg(F.count("*").alias("n")).collect()}
    assert built.trees == 10 and len(built.planes) >= 2 and max(sizes.values()) <= 64 and len({n for s, t, n in sizes if t == 0}) > 30
    folded = 3000 - 300 + 3 + 5 - 2  # of equal vectors the three smallest ids
    assert sum(sizes.values()) == 10 * folded or sum(sizes.values()) == 10 * (folded + 2)
    truth = neighbours.blocked_neighbours(q, d, 3)
    some = {r.scale: r.recall for r in neighbours.recall(forest.search_forest(q, built, 3, small), truth).collect()}
    assert some["few"] == 1.0 and some["s"] > 0.6
    every = forest.Forest(built.leaves, built.planes, built.trees, 10**6)
    assert all(r.recall == 1.0 for r in neighbours.recall(forest.search_forest(q, every, 3, small), truth).collect())
    usual = neighbours.recall(neighbours.neighbours(q, d, 3, "forest"), truth).collect()
    assert all(r.recall >= 0.9 for r in usual)
    nothing = neighbours.neighbours(q, d.limit(0), 3, "forest")
    assert nothing.count() == 0


def test_best_first_over_levels():
    """Priorities of a round are those of walking the planes one after the other."""
    from resight.operators import forest

    rng = np.random.default_rng(12)
    planes = forest.subtree(rng.normal(size=(200, 5)), 3)
    vectors, start = rng.normal(size=(50, 5)), -rng.uniform(size=50)
    found = forest.reach(vectors, start, planes, 3)
    own = forest.reach(vectors, np.zeros(50), planes, 3)
    assert (own.argmax(axis=1) == forest.descend(vectors, planes, 3)).all() and np.allclose(found.max(axis=1), start)
    for v, p, row in zip(vectors, start, found):
        for path in range(8):
            node, value = 0, p
            for bit in (path >> 2 & 1, path >> 1 & 1, path & 1):
                margin = v @ planes[node, :-1] - planes[node, -1]
                value = value if (margin >= 0) == bool(bit) else min(value, -abs(margin))
                node = 2 * node + 1 + bit
            assert row[path] == pytest.approx(value)


def test_hot_bucket_is_cut_into_bounded_blocks(spark):
    from resight.operators import blocks

    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("item"))
    packed = blocks.pack(rows, ["k"], "item", ["item"], 100)
    sizes = packed.select(F.size("_items").alias("n"))
    assert sizes.agg(F.max("n"), F.sum("n")).first() == (sizes.agg(F.max("n")).first()[0], 5000)
    assert sizes.agg(F.max("n")).first()[0] < 200


def test_evidence_small_database(spark):
    """With fewer than k+1 vectors the last one returned still normalises."""
    rows = [(0, "s", 0, 1, "a", 1.0), (0, "s", 0, 2, "b", 3.0), (1, "s", 1, 1, "a", 2.0)]
    near = spark.createDataFrame(rows, "query_id int, scale string, q_vec long, d_vec long, target string, dist double")
    got = [(r.query_id, r.target_id, r.score) for r in evidence.evidence(near).collect()]
    assert got == [(0, "a", -2.0)]


def test_scores_are_negative_and_self_free(vectors):
    by_name = scoring.lnbnn_scores(vectors, vectors)
    assert by_name.filter("score >= -1e-5").count() == 0
    by_annot = scoring.lnbnn_scores(vectors, vectors, LnbnnParams(level="annotation"))
    assert by_annot.filter("query_id = target_id").count() == 0


def test_pair_scores_and_matches(spark, vectors):
    pairs = spark.createDataFrame([(a, b) for a in range(6) for b in range(6)], "qaid long, daid long")
    got = scoring.pair_scores(pairs, vectors, vectors)
    rows = {(r.qaid, r.daid): r.score for r in got.collect()}
    assert len(rows) == 36 and min(rows.values()) >= 0.0
    assert all(rows[a, a] == 0.0 and str(rows[a, a]) == "0.0" for a in range(6))
    names = spark.createDataFrame([(a, a % 2) for a in range(6)], "aid long, nid long")
    best = scoring.match_results(got, names).collect()
    for r in best:
        own = {d: s for (q, d), s in rows.items() if q == r.qaid and d != q and d % 2 == r.nid}
        assert r.name_score == pytest.approx(sum(own.values()))
        assert r.best_score == max(own.values()) and r.best_daid == min(d for d in own if own[d] == r.best_score)


@pytest.mark.parametrize("kind", ["chi_square", "euclidean"])
def test_warping(spark, kind):
    rng = np.random.default_rng(4)
    q, d = rng.uniform(size=(20, 16, 2)), rng.uniform(size=(45, 16, 2))
    qs = spark.createDataFrame([(i // 2, i, q[i].ravel().tolist()) for i in range(20)], "query_id long, series_id long, values array<double>")
    ds = spark.createDataFrame([(f"n{i // 3}", i, d[i].ravel().tolist()) for i in range(45)], "target_id string, series_id long, values array<double>")
    p = WarpParams(window=4, length=16, cost=kind, block_rows=8)
    weights = warping.spatial_weights(16, "humpback")
    rows = warping.warping_scores(qs, ds, p, 2, "humpback").collect()
    got = {(r.query_id, r.target_id): r.score for r in rows}
    assert len(rows) == len(got) == 10 * 15
    for a in range(10):
        for b in range(15):
            want = min(brute.warp(q[i], d[j], weights, 4, kind) for i in (2 * a, 2 * a + 1) for j in range(3 * b, 3 * b + 3))
            assert got[a, f"n{b}"] == pytest.approx(want)
    listed = spark.createDataFrame([(i, q[i].ravel().tolist(), d[i].ravel().tolist()) for i in range(20)], "n long, a array<double>, b array<double>")
    for r in warping.pair_distances(listed, p, 2).collect():
        assert r.distance == pytest.approx(brute.warp(q[r.n], d[r.n], np.ones(16), 4, kind))


def smooth_series(rng, n, length, channels=2):
    steps = rng.normal(0, 0.06, (n, length, channels)).cumsum(axis=1)
    return np.clip(rng.uniform(0.2, 0.8, (n, 1, channels)) + steps, 0, 1)


@pytest.mark.parametrize("kind", ["chi_square", "euclidean"])
@pytest.mark.parametrize("preset", [None, "humpback"])
def test_bounds_and_abandoning(kind, preset):
    """Bounds never exceed the distance; a search that gives up early finds the minima of the full grid."""
    rng = np.random.default_rng(8)
    for length, window in ((128, 8), (9, 20), (12, 1), (2, 1), (1, 3)):
        a, b = smooth_series(rng, 12, length).transpose(2, 1, 0), smooth_series(rng, 15, length).transpose(2, 1, 0)
        weights = warping.spatial_weights(length, preset)
        full = warping.warp(a[..., None], b[:, :, None, :], weights, window, warping.COSTS[kind])
        full = np.broadcast_to(full, (12, 15))
        bound = warping.lower_bounds(a, b, weights, window, kind)
        assert (bound <= full).all() and (length < 12 or bound.max() > 0)
        groups = (np.arange(12) // 2)[:, None] * 5 + (np.arange(15) // 3)[None, :]
        want = np.full(30, np.inf)
        np.minimum.at(want, groups.ravel(), full.ravel())
        want = want.reshape(6, 5)
        got, warped, _ = warping.least_distances(a, b, groups, np.full((6, 5), np.inf), weights, window, kind, None)
        assert np.array_equal(got, want) and warped <= 180
        single = np.arange(180).reshape(12, 15)
        got = warping.least_distances(a, b, single, np.full((12, 15), np.inf), weights, window, kind, None)
        assert np.allclose(got[0], full) and got[1] == 180
        got, fewer, _ = warping.least_distances(a, b, groups, np.full((6, 5), np.inf), weights, window, kind, 2, chunk=8)
        edge = np.sort(want, axis=1)[:, 1:2]
        assert np.array_equal(np.where(want <= edge, got, 0), np.where(want <= edge, want, 0)) and (got >= want).all()
        if length == 128:
            assert fewer < warped < 180


@pytest.mark.parametrize("kind", ["chi_square", "euclidean"])
def test_nearest_individuals(spark, kind):
    """At the default length and window: the same minima as brute force, and few pairs warped."""
    rng = np.random.default_rng(9)
    people = smooth_series(rng, 12, 128)
    q = np.clip(people[rng.integers(0, 12, 9)] + rng.normal(0, 0.01, (9, 128, 2)), 0, 1)
    d = np.clip(people[np.arange(36) % 12] + rng.normal(0, 0.01, (36, 128, 2)), 0, 1)
    qs = spark.createDataFrame([(i // 2, i, q[i].ravel().tolist()) for i in range(9)], "query_id long, series_id long, values array<double>").repartition(2)
    ds = spark.createDataFrame([(f"n{i % 12:02d}", i, d[i].ravel().tolist()) for i in range(36)], "target_id string, series_id long, values array<double>").repartition(3)
    p = WarpParams(cost=kind, block_rows=16)
    assert (p.length, p.window) == (128, 8)
    weights = warping.spatial_weights(128, "bottlenose")
    want = {}
    for i in range(9):
        for j in range(36):
            key = (i // 2, f"n{j % 12:02d}")
            want[key] = min(want.get(key, np.inf), brute.warp(q[i], d[j], weights, 8, kind))
    scores = {(r.query_id, r.target_id): r.score for r in warping.warping_scores(qs, ds, p, 2, "bottlenose").collect()}
    assert scores.keys() == want.keys() and all(scores[k] == pytest.approx(v) for k, v in want.items())
    got = {(r.query_id, r["rank"]): (r.target_id, r.score) for r in warping.nearest_individuals(qs, ds, 3, p, 2, "bottlenose").collect()}
    for query in range(5):
        order = sorted((v, t) for (k, t), v in want.items() if k == query)[:3]
        assert [got[query, r][0] for r in (1, 2, 3)] == [t for _, t in order]
        assert [got[query, r][1] for r in (1, 2, 3)] == pytest.approx([v for v, _ in order])
    done = warping.pruning_report(qs, ds, 3, p, 2, "bottlenose").first()
    assert done.pairs == 9 * 36 and done.finished <= done.warped < 0.8 * done.pairs
    assert warping.nearest_individuals(qs.limit(0), ds, 3, p, 2).count() == 0 == warping.warping_scores(qs, ds.limit(0), p, 2).count()


@pytest.mark.parametrize("length,window", [(1, 3), (2, 1), (3, 1), (9, 20), (12, 2)])
def test_warp_edges(length, window):
    rng = np.random.default_rng(5)
    a, b = rng.uniform(size=(2, length, 7)), rng.uniform(size=(2, length, 7))
    got = warping.warp(a, b, np.ones(length), window, warping.chi_square)
    want = [brute.warp(a[:, :, n].T, b[:, :, n].T, np.ones(length), window, "chi_square") for n in range(7)]
    assert np.allclose(got, want)


def peak_sets():
    rng = np.random.default_rng(6)
    out = {}
    for n in (120, 240):
        out[n] = {}
        for i, j, t in zip(rng.integers(0, 20, n), rng.integers(0, 20, n), rng.uniform(0, 2 * np.pi, n)):
            out[n][int(i), int(j)] = (i + rng.uniform(-0.4, 0.4), j + rng.uniform(-0.4, 0.4), np.cos(t), np.sin(t))
    ring = {}
    for t in np.linspace(0, 2 * np.pi, 400):
        i, j = int(round(20 + 9 * np.cos(t))), int(round(20 + 9 * np.sin(t)))
        v = np.array([i - 20, j - 20]) / np.hypot(i - 20, j - 20)
        ring[i, j] = (20 + 9 * v[0], 20 + 9 * v[1], v[0], v[1])
    out[1] = ring
    out[2] = {(4, j): (4.0, float(j), 1.0, 0.0) for j in range(70)}
    return out


@pytest.mark.parametrize("tile", [3, 128])
def test_link_points(spark, tile):
    """Chains and rings inside one tile, and across many borders, are those of a walk from point to point."""
    sets = peak_sets()
    rows = [(n, i, j, *map(float, v)) for n, peaks in sets.items() for (i, j), v in peaks.items()]
    peaks = spark.createDataFrame(pd.DataFrame(rows, columns=["image_id", "i", "j", "pi", "pj", "ni", "nj"])).repartition(3)
    frame = linking.link_points(peaks, tile=tile).toPandas().sort_values(["contour_id", "idx"])
    got = {k: list(zip(g.i, g.j)) for k, g in frame.groupby("contour_id")}
    want = {f"{n}-{p[0]}-{p[1]}": path for n, s in sets.items() for p, path in brute.chains(s).items()}
    assert got == want
    assert all(g.idx.tolist() == list(range(len(g))) for _, g in frame.groupby("contour_id"))


def test_chains_of_loose_links(spark):
    """Links that need not be mutual, far targets, rings with tails: the smallest cell seen, whatever the tiles."""
    rng = np.random.default_rng(11)
    cells = [(int(i), int(j)) for i, j in {tuple(c) for c in rng.integers(-9, 9, size=(150, 2))}]
    to = {c: cells[k] for c, k in zip(cells, rng.integers(0, len(cells), len(cells))) if cells[k] != c}
    links = spark.createDataFrame([(1, *a, "fwd", *b) for a, b in to.items()],
                                  "image_id int, i int, j int, side string, t_i int, t_j int")
    peaks = spark.createDataFrame([(1, *c) for c in cells], "image_id int, i int, j int")
    want = {}
    for c in cells:
        seen, a, b = {c}, c, to.get(c)
        arcs = set()
        while b is not None and (a, b) not in arcs:
            arcs.add((a, b))
            seen.add(b)
            a, b = b, to.get(b) if to.get(b) != a else None
        want[c] = min(seen)
    for tile in (2, 5, 128):
        got = {(r.i, r.j): (r.chain_i, r.chain_j) for r in linking.connected_chains(peaks, links, tile).collect()}
        assert got == want
    none = linking.connected_chains(peaks, links.limit(0)).collect()
    assert len(none) == len(cells) and all((r.i, r.j) == (r.chain_i, r.chain_j) for r in none)


def test_quadrants_in_a_crowd(spark):
    """A crowded corner is searched through finer cells and still gives the true neighbours."""
    rng = np.random.default_rng(7)
    at = np.concatenate([rng.uniform(0, 1, size=(400, 2)), rng.uniform(0, 30, size=(60, 2))]).round(3)
    rows = [(0, k // 2, k, float(i), float(j)) for k, (i, j) in enumerate(at)]
    ends = spark.createDataFrame(rows, "image_id int, contour_id long, end_id long, i double, j double")
    got = {(r.src, r.quadrant): r.dst for r in linking.quadrant_neighbours(ends, 8.0).collect()}
    want = {}
    for s, (i, j) in enumerate(at):
        di, dj = at[:, 0] - i, at[:, 1] - j
        dist = np.hypot(di, dj)
        quads = [(di <= 0) & (dj > 0), (di < 0) & (dj <= 0), (di >= 0) & (dj < 0), (di > 0) & (dj >= 0)]
        for q, mask in enumerate(quads, 1):
            near = [(dist[k], k) for k in np.nonzero(mask & (dist > 0) & (dist < 8.0))[0]]
            if near and min(near)[1] // 2 != s // 2:
                want[s, q] = min(near)[1]
    assert got == want


def test_evaluation_invariants(spark):
    rng = np.random.default_rng(8)
    rows = [(run, q, f"i{t}", float(-rng.uniform())) for run in range(2) for q in range(20) for t in range(9)]
    scores = spark.createDataFrame(rows, "run int, enc int, target_id string, score double")
    truth = spark.createDataFrame([(run, q, f"i{q % 10}") for run in range(2) for q in range(20)], "run int, enc int, ind string")
    out = evaluation.evaluate(scores, truth, 4)
    ranks = out["all"].collect()
    assert {r.rank for r in ranks} <= {-1, *range(1, 10)} and all(len(r.ranking) == 4 for r in ranks)
    assert sum(r.rank == -1 for r in ranks) == 4
    curve = [r.accuracy for r in out["topk"].filter("run = 0").orderBy("k").collect()]
    assert len(curve) == 9 and curve == sorted(curve) and curve[-1] == pytest.approx(100.0)
    whole = evaluation.evaluate(scores, truth)["all"]
    assert whole.count() == 2 * 20 * 9 and whole.filter("position = 1").count() == 40


def test_sparse_scores_rank_like_dense(spark):
    rng = np.random.default_rng(9)
    dense = [(q, t, float(-rng.integers(0, 3))) for q in range(30) for t in range(12)]
    full = spark.createDataFrame(dense, "query_id long, target_id long, score double")
    truth = spark.createDataFrame([(q, q % 14) for q in range(30)], "query_id long, ind long")
    database = spark.createDataFrame([(t,) for t in range(12)], "target_id long")
    a = sorted(ranking.true_ranks(full, truth, ["query_id"]).collect())
    b = sorted(ranking.true_ranks(full.filter("score < 0"), truth, ["query_id"], database).collect())
    assert a == b


@pytest.mark.parametrize("size", [1.0, 1e-6, 1e6, 1e20])
def test_block_kernel_at_any_magnitude(size):
    rng = np.random.default_rng(10)
    q, x = rng.normal(size=(40, 12)) * size, rng.normal(size=(700, 12)) * size
    x[100:130] = x[5]
    q[:5] = x[5]
    rows, cols, dist = neighbours.nearest_in_block(q, x, np.arange(700), 3, width=128)
    exact = np.sqrt(((q[:, None] - x[None]) ** 2).sum(2))
    assert np.array_equal(cols.reshape(40, 3), np.argsort(exact, axis=1, kind="stable")[:, :3])
    assert np.allclose(dist, exact[rows, cols])


def test_ranks_of_a_crowded_query(spark):
    """A query with nearly all targets is counted in parts, by several tasks, and its rank stays that of a sort."""
    rng = np.random.default_rng(17)
    rows = [(1, int(t), float(v)) for t, v in enumerate(-rng.integers(0, 50, 20000) / 4.0)]
    rows += [(q, int(t), float(v)) for q in (2, 3) for t, v in zip(rng.permutation(60)[:20], rng.normal(size=20))]
    scores = spark.createDataFrame(rows, "query_id int, target_id long, score double").repartition(8)
    asked = [(1, 777), (2, rows[20000][1]), (3, 12345678), (4, 5)]
    truth = spark.createDataFrame(asked, "query_id int, ind long")
    database = spark.createDataFrame([(t,) for t in range(21000)], "target_id long")
    for held in (None, database):
        want = []
        for q, ind in asked:
            own = {t: v for k, t, v in rows if k == q}
            if held is not None:
                own = {t: own.get(t, 0.0) for t in range(21000)}
            want.append((q, ind, sum((v, t) < (own[ind], ind) for t, v in own.items()) + 1 if ind in own else -1))
        for block in (700, ranking.BLOCK):
            assert sorted(map(tuple, ranking.true_ranks(scores, truth, ["query_id"], held, block).collect())) == want
    met = ranking.scores_beside(truth, scores, ["query_id"], 700)
    assert met.count() == len(rows) + 1
    # As at scale: neither side is small enough to be sent whole, nor are partitions merged.
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        tasks = met.filter("query_id = 1").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert sum(r["count"] for r in tasks) == 20000 and max(r["count"] for r in tasks) < 9000


def test_blocks_give_the_nearest_only():
    best = np.array([[3.0, 1.0, 2.0, 2.0, np.inf], [np.inf, 5.0, np.inf, np.inf, np.inf]])
    rows, cols = warping._first_in_block(best, 2)
    assert list(zip(rows, cols)) == [(0, 1), (0, 2), (0, 3), (1, 1)]
    assert len(warping._first_in_block(best, 9)[0]) == 5


def test_blocks_are_copied_to_a_bounded_grid(spark):
    from resight.operators import blocks

    side = spark.range(400).select(F.col("id").alias("no"), F.col("id").alias("v"))
    met = blocks.meet_all(side, side.withColumnRenamed("v", "w"), 400, 400, 2)
    assert met.select("v", "w").distinct().count() == met.count() == 160_000
    assert met.agg(F.max("_row"), F.max("_col")).first() == (blocks.GRID - 1, blocks.GRID - 1)


def test_ranks_make_a_table_of_scores_twice_at_most(spark):
    """Once for the true individuals and once for all that come before them; counting takes no further pass."""
    made = spark.sparkContext.accumulator(0)

    def score(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.range(600).selectExpr("id % 20 as query_id", "id div 20 as target_id", "double((id * 7) % 101) as score")
    scores = rows.mapInArrow(score, rows.schema).groupBy("query_id", "target_id").agg(F.min("score").alias("score"))
    truth = spark.range(20).selectExpr("id as query_id", "id as ind")
    assert len(ranking.true_ranks(scores, truth, ["query_id"]).collect()) == 20
    assert made.value <= 1200


@pytest.mark.parametrize("kind", ["chi_square", "euclidean"])
def test_warp_fills_diagonals_in_place(kind):
    """Of a block of pairs two diagonals are held, and no copies of them; pairs picked by number lie side by side."""
    import tracemalloc

    rng = np.random.default_rng(10)
    a, b = rng.uniform(size=(2, 128, 64)), rng.uniform(size=(2, 128, 64))
    groups = np.arange(64 * 64).reshape(64, 64)
    tracemalloc.start()
    try:
        got = warping.least_distances(a, b, groups, np.full((64, 64), np.inf), np.ones(128), 8, kind, None)[0]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    held = (2 * 8 + 2) * 64 * 64 * 8
    assert peak < 5 * held
    for i, j in ((0, 0), (63, 5), (31, 63)):
        assert got[i, j] == pytest.approx(brute.warp(a[:, :, i].T, b[:, :, j].T, np.ones(128), 8, kind))
    laid = []
    seen = warping.warp_below
    try:
        warping.warp_below = lambda left, right, *rest: (laid.append(left.flags.c_contiguous and right.flags.c_contiguous), seen(left, right, *rest))[1]
        warping.least_distances(a, b, groups // 8, np.full((64, 8), np.inf), np.ones(128), 8, kind, None)
    finally:
        warping.warp_below = seen
    assert laid and all(laid)


def test_blocks_met_before_bound_the_next(spark):
    """A query's nearest individuals of one block spare pairs of the next blocks (F10), and the result stays that of brute force."""
    rng = np.random.default_rng(11)
    people = smooth_series(rng, 40, 128)
    q = np.clip(people[:4] + rng.normal(0, 0.01, (4, 128, 2)), 0, 1)
    qs = spark.createDataFrame([(i, i, q[i].ravel().tolist()) for i in range(4)], "query_id long, series_id long, values array<double>").coalesce(1)
    ds = spark.createDataFrame([(i, i, people[i].ravel().tolist()) for i in range(40)], "target_id long, series_id long, values array<double>").coalesce(1)
    done = {rows: warping.pruning_report(qs, ds, 1, WarpParams(block_rows=rows), 2).first() for rows in (4, 64)}
    assert done[4].pairs == done[64].pairs == 160 and done[4].warped < 120
    got = {(r.query_id, r["rank"]): r.target_id for r in warping.nearest_individuals(qs, ds, 2, WarpParams(block_rows=4), 2).collect()}
    for i in range(4):
        order = np.argsort([brute.warp(q[i], people[j], np.ones(128), 8, "chi_square") for j in range(40)])
        assert [got[i, 1], got[i, 2]] == order[:2].tolist()


def test_ranks_make_scores_and_database_once(spark):
    """With a database the scores and its ids are written once, however often they are read."""
    made = {"scores": spark.sparkContext.accumulator(0), "database": spark.sparkContext.accumulator(0)}

    def counted(df, name):
        seen = made[name]

        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return df.mapInArrow(run, df.schema)

    rows = [(q, t, float(-((q * 7 + t * 5) % 4))) for q in range(6) for t in range(0, 9, 2)]
    scores = counted(spark.createDataFrame(rows, "query_id long, target_id long, score double"), "scores")
    database = counted(spark.createDataFrame([(t % 8,) for t in range(16)], "target_id long"), "database")
    truth = spark.createDataFrame([(q, q + 2) for q in range(7)], "query_id long, ind long")
    got = {r.query_id: r["rank"] for r in ranking.true_ranks(scores, truth, ["query_id"], database).collect()}
    listed = {(q, t): s for q, t, s in rows if t < 8}
    for q in range(7):
        order = sorted(range(8), key=lambda t: (listed.get((q, t), 0.0), t))
        assert got[q] == (order.index(q + 2) + 1 if q + 2 < 8 else -1)
    assert {name: seen.value for name, seen in made.items()} == {"scores": 30, "database": 16}


@pytest.mark.parametrize("kind", ["chi_square", "euclidean"])
def test_scores_are_whole_where_blocks_meet(spark, kind):
    """The series of an individual lie in one block, so no score is shuffled (F7, F8, F9); only individuals of many series are cut."""
    rng = np.random.default_rng(12)
    sizes_q, sizes_d = [1, 3, 2, 6, 1, 1], [2, 4, 1, 9, 3, 1, 5, 1]

    def side(sizes, name, values):
        owners = np.repeat(np.arange(len(sizes)), sizes)
        rows = [(int(o), i, values[i].ravel().tolist()) for i, o in enumerate(owners)]
        rng.shuffle(rows)
        return spark.createDataFrame(rows, f"{name} long, series_id long, values array<double>").repartition(3), owners

    q, d = rng.uniform(size=(sum(sizes_q), 8, 2)), rng.uniform(size=(sum(sizes_d), 8, 2))
    (qs, q_of), (ds, d_of) = side(sizes_q, "query_id", q), side(sizes_d, "target_id", d)
    want = {}
    for i, a in enumerate(q_of):
        for j, b in enumerate(d_of):
            want[a, b] = min(want.get((a, b), np.inf), brute.warp(q[i], d[j], np.ones(8), 3, kind))
    for block in (4, 64):
        p = WarpParams(window=3, length=8, cost=kind, block_rows=block)
        scores = warping.warping_scores(qs, ds, p, 2)
        rows = scores.collect()
        got = {(r.query_id, r.target_id): r.score for r in rows}
        assert len(rows) == len(got) and got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())
        near = {(r.query_id, r["rank"]): r.target_id for r in warping.nearest_individuals(qs, ds, 2, p, 2).collect()}
        for a in range(len(sizes_q)):
            order = sorted(range(len(sizes_d)), key=lambda b: want[a, b])
            assert [near[a, 1], near[a, 2]] == order[:2]
        plan = scores._jdf.queryExecution().executedPlan().toString()
        assert ("HashAggregate" in plan) == (block == 4)


def test_blocks_of_whole_keys(spark):
    """Blocks end between keys and are no larger than asked; keys of more rows are cut and come second."""
    from resight.operators import blocks

    sizes = [3, 1, 4, 2, 4, 1, 1, 3, 11]
    rows = [(k, n) for k, size in enumerate(sizes) for n in range(size)]
    (whole, n_whole), (cut, n_cut) = blocks.pack_wholes(spark.createDataFrame(rows, "k long, n long").repartition(4), "k", 4, "items")
    of_key = {}
    for r in whole.collect():
        assert len(r["items"]) <= 4
        for k in {e.k for e in r["items"]}:
            assert of_key.setdefault(k, r.no) == r.no
    assert set(of_key) == set(range(8)) and n_whole == whole.count() and n_cut == cut.count()
    every = [tuple(e) for t in (whole, cut) for r in t.collect() for e in r["items"]]
    assert sorted(every) == sorted(rows) and {e.k for r in cut.collect() for e in r["items"]} == {8}


def test_pairs_of_groups(spark, vectors):
    """Groups give the scores of all their pairs, and no pair is shuffled (F18, F19); equal and null keys count as in a join."""
    v = vectors.where("owner % 3 = 0")
    owners = [r.owner for r in v.select("owner").distinct().orderBy("owner").collect()]
    rows = [(o, o % 4 if o % 5 else None) for o in owners] + [(owners[1], 1), (owners[1], owners[1] % 4), (None, 2), (owners[2], 77)]
    queries = spark.createDataFrame(rows, "qaid long, group long")
    members = queries.select(F.col("qaid").alias("daid"), "group", (F.col("qaid") % 3 + F.col("qaid") % 2).alias("nid")).where("group != 77")
    pairs = queries.join(members, "group").select("qaid", "daid", "nid")
    key = lambda r: tuple((x is None, x) for x in r)
    want = sorted((tuple(r) for r in scoring.pair_scores(pairs, v, v).join(members.select("daid", "nid").distinct(), "daid", "left").select(
        "qaid", "daid", "score").collect()), key=key)
    scored = scoring.pair_scores(scoring.PairGroups(queries, members), v, v)
    got = sorted((tuple(r) for r in scored.select("qaid", "daid", "score").collect()), key=key)
    assert [r[:2] for r in got] == [r[:2] for r in want] and len(got) == pairs.count()
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want]) and any(r[2] > 0 for r in got)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("Generate explode(_members")[0]
    names = members.where("daid is not null").select(F.col("daid").alias("aid"), "nid").distinct()
    old = scoring.match_results(scoring.pair_scores(pairs, v, v), names)
    new = scoring.match_results(scored, names)
    number = lambda df: sorted((r.qaid, r.qnid, r.nid, r.best_daid, round(r.name_score, 6)) for r in df.collect())
    assert number(new) == number(old)


def test_requested_pairs_of_a_label_are_not_shuffled(spark):
    from checks import QUERIES
    from conftest import SMALL

    plan = QUERIES["j5_pair_scores"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("Generate explode(_members")[0]


def test_series_without_numbers_are_last(spark):
    """An individual's score is the least that is a number, wherever its series lie; without any it is NaN."""
    rng = np.random.default_rng(13)
    q, d = rng.uniform(size=(2, 8, 2)), rng.uniform(size=(14, 8, 2))
    bad = [0, 2, 3, 9, 10, 11, 12, 13]
    d[bad, 4, 0] = np.nan
    owner = [0, 0, 1, 1, 2, 3, 3, 3, 3, 3, 4, 4, 4, 4]
    qs = spark.createDataFrame([(i, i, q[i].ravel().tolist()) for i in range(2)], "query_id long, series_id long, values array<double>")
    rows = [(o, j, [None if np.isnan(x) else float(x) for x in d[j].ravel()]) for j, o in enumerate(owner)]
    ds = spark.createDataFrame(rows, "target_id long, series_id long, values array<double>")
    for some in (ds, ds.where("target_id in (3, 4)"), ds.where("target_id = 4")):
        for block in (2, 64):
            p = WarpParams(window=3, length=8, block_rows=block)
            for r in warping.warping_scores(qs, some, p, 2).collect():
                mine = [brute.warp(q[r.query_id], d[j], np.ones(8), 3, "chi_square") for j in range(14) if owner[j] == r.target_id and j not in bad]
                assert r.score == pytest.approx(min(mine)) if mine else np.isnan(r.score)


@pytest.mark.parametrize("kind", ["chi_square", "euclidean"])
def test_rough_bounds_never_exceed_the_distance(kind):
    """Bounds in single precision stay below the distance for values of any size; a search by them finds what a full one does."""
    rng = np.random.default_rng(14)
    for length, window, size in ((128, 8, 1.0), (128, 8, 1e7), (128, 8, 1e12), (16, 4, 1.0), (16, 4, 1e6), (9, 20, 1.0), (3, 1, 1.0), (2, 1, 1.0), (1, 3, 1.0)):
        a, b = (size * smooth_series(rng, n, length).transpose(2, 1, 0) for n in (8, 60))
        b[:, :, 7] = a[:, :, 2]
        if length > 2:
            b[0, length // 2, 11] = np.nan
        for preset in (None, "humpback"):
            weights = warping.spatial_weights(length, preset)
            full = np.broadcast_to(warping.warp(a[..., None], b[:, :, None, :], weights, window, warping.COSTS[kind]), (8, 60))
            for bars in (None, np.zeros(8), np.nanmin(full, axis=1)):
                bound = warping.rough_bounds(a, b, weights, window, kind, bars)
                assert not (bound > full).any()
            groups = np.arange(8)[:, None] * 20 + np.arange(60)[None, :] // 3
            want = np.fmin.reduce(full.reshape(8, 20, 3), axis=2)
            edge = np.sort(want, axis=1)[:, 3]
            for known in (None, edge, np.where(np.arange(8) % 2, edge, np.inf)):
                got, _, ended = warping.least_distances(a, b, groups, np.full((8, 20), np.inf), weights, window, kind, 4, chunk=16, edge=known)
                near = want <= edge[:, None]
                assert np.array_equal(got[near], want[near]) and (got >= want).all() and ended <= 480


def test_a_search_for_the_nearest_warps_few_pairs(spark):
    """Of many individuals a query's bars come from many at a time, and not from one block of each."""
    rng = np.random.default_rng(15)
    people = smooth_series(rng, 400, 128)
    q = np.clip(people[:8] + rng.normal(0, 0.02, (8, 128, 2)), 0, 1)
    qs = spark.createDataFrame([(i, i, q[i].ravel().tolist()) for i in range(8)], "query_id long, series_id long, values array<double>")
    ds = spark.createDataFrame([(i, i, people[i].ravel().tolist()) for i in range(400)], "target_id long, series_id long, values array<double>")
    done = warping.pruning_report(qs, ds, 2, WarpParams(block_rows=16), 2).first()
    assert done.pairs == 3200 and done.warped < 700
    near = {r.query_id: r.target_id for r in warping.nearest_individuals(qs, ds, 2, WarpParams(block_rows=16), 2).collect() if r["rank"] == 1}
    assert near == {i: i for i in range(8)}


def test_a_block_is_once_in_a_key(spark):
    """Blocks that meet in a task are handed over once, not once for every meeting; queries come first."""
    from resight.operators import blocks

    side = spark.range(100).select(F.col("id").alias("no"), F.col("id").alias("v"))
    dealt = blocks.deal_all(side, side.withColumnRenamed("v", "w"), 100, 100, 8, 4).withColumn("at", F.monotonically_increasing_id()).collect()
    keys = {}
    for r in sorted(dealt, key=lambda r: r["at"]):
        left, right = keys.setdefault((r["_row"], r["_col"]), ([], []))
        assert r.v is None or not right
        (left if r.w is None else right).append(r.v if r.w is None else r.w)
    assert max(c for _, c in keys) == 3 and len(dealt) == 100 * 4 + 100 * (max(r for r, _ in keys) + 1)
    assert sorted((v, w) for left, right in keys.values() for v in left for w in right) == [(v, w) for v in range(100) for w in range(100)]


def test_ranks_make_a_table_of_scores_once(spark):
    """The scores of the true individuals and those that come before them are read from one shuffle."""
    made = spark.sparkContext.accumulator(0)

    def score(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = [(q % 20, q // 20, float((q * 7) % 101)) for q in range(600)] + [(3, None, 1.0), (None, 4, 1.0)]
    scores = spark.createDataFrame(rows, "query_id long, target_id long, score double")
    asked = [(q, (q * 11) % 33) for q in range(22)] + [(5, 8), (None, 4), (6, None)]
    truth = spark.createDataFrame(asked, "query_id long, ind long")
    want = set()
    for q, ind in asked:
        listed = [(t, v) for k, t, v in rows if k == q is not None]
        own = dict(listed).get(ind) if ind is not None else None
        before = [v < own or v == own and t is not None and t < ind for t, v in listed] if own is not None else []
        want.add((q, ind, sum(before) + 1 if own is not None else -1))
    for block in (ranking.BLOCK, 7):
        made.value = 0
        ranks = ranking.true_ranks(scores.mapInArrow(score, scores.schema), truth, ["query_id"], None, block)
        got = [tuple(r) for r in ranks.collect()]
        assert made.value == len(rows) and len(got) == len(asked) and set(got) == want

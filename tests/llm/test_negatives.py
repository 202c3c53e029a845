"""Hard negatives against brute force, the order of cells, and certified windows."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from resight.llm import negatives
from resight.llm.queries import QUERIES


def brute(rows, scale=256.0, positives=5, count=10):
    """rows (id, vector, label): every eligible pair scored in whole numbers."""
    fit = [(i, np.floor(scale * np.array(v, dtype=float)).astype(int).tolist(), lab) for i, v, lab in rows
           if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    anchors = {}
    for i, v, lab in fit:
        if i % 100 == 0 and (i not in anchors or (lab, v) < anchors[i]):
            anchors[i] = (lab, v)
    out = []
    for i, (lab, v) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, other) for j, w, other in fit if j != i)
        for p, j, _ in [s for s in scored if s[2] == lab][:positives]:
            fits = [(n, m) for n, m, other in scored if other != lab and 30 * -p <= 100 * -n <= 90 * -p][:count]
            out += [(i, j, rank, m, -p, -n) for rank, (n, m) in enumerate(fits, 1)]
    return sorted(out)


def mine(df, **changes):
    return sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, F.col("label"),
                                                      negatives.NegativeParams(**changes)).collect()))


SCHEMA = "vec_id long, embedding array<float>, label int, id string, part int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA).repartition(4)


def test_query(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    rows = [(r["vec_id"], r["embedding"], r["label"] if r["vec_id"] % 7 else (r["label"] + 1) % 10) for r in rows]
    assert sorted(map(tuple, QUERIES["op12_multi_index"](spark, SMALL).collect())) == brute(rows)


@pytest.mark.parametrize("blocks", [{}, {"vector_block": 7, "anchor_block": 2, "codes": 3, "sample": 20, "blocks_per_cell": 2, "blocks_per_group": 1}])
def test_clusters_ties_and_odd_rows(spark, blocks):
    draw = np.random.default_rng(4)
    middles = draw.normal(0, 1, (6, 9))
    rows = [(i, (middles[i % 6] + draw.normal(0, 0.1, 9)).astype(np.float32).tolist(), int(draw.integers(0, 3))) for i in range(701)]
    rows += [(1000 + i, rows[3][1], i % 3) for i in range(60)]  # ties
    rows += [(700, rows[9][1], 1), (5, rows[5][1], rows[5][2]), (5, rows[5][1], rows[5][2])]  # repeated ids and rows
    rows += [(2000, None, 1), (2100, [1.0, None], 1), (2200, [float("nan")] * 9, 1), (2300, [float("inf")] * 9, 2), (None, rows[0][1], 0),
             (2400, rows[0][1], None), (2500, [], 1), (2600, [1.0, 2.0], 0), (2700, [0.5] * 12, 2), (2800, (-np.ones(9)).tolist(), 9)]
    assert mine(frame(spark, rows), **blocks) == brute(rows)


def test_large_components_and_few_rows(spark):
    rows = [(100 * i, [3e6 * (-1) ** i, 1e6 + i, 7.0], i % 2) for i in range(8)] + [(7, [1e7, 1.0, 1.0], 1)]
    assert mine(frame(spark, rows)) == brute(rows)
    for few in ([], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 1)], [(0, [], 1), (1, [], 1), (2, [], 0)], [(0, None, None)]):
        assert mine(frame(spark, few)) == brute(few)


def test_order_of_cells():
    draw = np.random.default_rng(0)
    left, right = (sorted(draw.normal(0, 1, n).tolist(), reverse=True) for n in (7, 11))
    got = list(negatives.cells_by_bound(left, right))
    assert [b for b, _, _ in got] == sorted((a + b for a, b in itertools.product(left, right)), reverse=True)
    assert len({(x, y) for _, x, y in got}) == 77


def test_windows_stop_early():
    """On clustered rows a search scores a small part of a block, and finds what the whole block holds."""
    draw = np.random.default_rng(2)
    middles = 200 * draw.normal(0, 1, (40, 16))
    rows = np.floor(middles[draw.integers(0, 40, 8000)] + draw.normal(0, 4, (8000, 16))).astype(np.int64)
    books = negatives.Codebooks.fit(rows[:1000].astype(float), 40, 20)
    ids, labels = np.arange(8000), draw.integers(0, 2, 8000)
    index = negatives.Index.build(ids, labels, rows, books)
    scored = 0
    for at in range(0, 400, 10):
        want = [negatives.empty_want(-np.inf, np.inf, 5)]
        scored += negatives.fill(want, at, labels[at], True, rows[at], index)
        score = rows @ rows[at]
        fit = np.flatnonzero((labels == labels[at]) & (ids != at))
        assert want[0].ids.tolist() == fit[np.lexsort((fit, -score[fit]))[:5]].tolist()
    assert scored < 0.4 * 40 * 8000

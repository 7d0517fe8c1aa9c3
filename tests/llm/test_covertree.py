"""Cover trees, the dual-tree search and the query against brute force."""

import math

import numpy as np
import pytest

from spendtrace.llm import covertree
from spendtrace.llm.covertree import DualSearch, Found, build_tree, top_k

FIELDS = "vec_id long, embedding array<double>"


def clustered(rng, n, dims, clusters, spread):
    centres = rng.normal(size=(clusters, dims)) * 100
    return np.floor(centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, dims)) * spread).astype(np.int64)


@pytest.mark.parametrize("n,dims", [(1, 3), (40, 2), (700, 3), (500, 24)])
def test_nodes_enclose_and_children_stand_apart(n, dims):
    points = clustered(np.random.default_rng(n), n, dims, 6, 10)
    points[: n // 4] = points[0]
    tree = build_tree(points, leaf=4)
    assert sorted(tree.order) == list(range(n))
    own = points[tree.order].astype(float)
    for i in range(len(tree.start)):
        low, high = tree.start[i], tree.stop[i]
        assert np.linalg.norm(own[low:high] - own[low], axis=1).max() <= tree.radius[i]
        kids = range(tree.child[i], tree.child_end[i])
        if tree.child_end[i]:
            assert [tree.start[k] for k in kids] == [low, *(tree.stop[k] for k in kids)][:-1]
            assert tree.stop[kids[-1]] == high and len(kids) > 1
            apart = tree.radius[i] / covertree.SHRINK * (1 - 1e-6)
            centres = own[[tree.start[k] for k in kids]]
            gaps = np.linalg.norm(centres[:, None] - centres[None], axis=2) + np.eye(len(centres)) * 1e9
            assert gaps.min() > apart and max(tree.radius[k] for k in kids) <= apart * (1 + 1e-5)


def searched(queries, points, best):
    q_tree, c_tree = build_tree(queries), build_tree(points)
    found = Found(len(queries), best)
    search = DualSearch(queries[q_tree.order], q_tree, points[c_tree.order], c_tree.order, c_tree, found)
    search.run()
    scores, ids = np.empty_like(found.scores), np.empty_like(found.ids)
    scores[q_tree.order], ids[q_tree.order] = found.scores, found.ids
    return scores, ids, search


@pytest.mark.parametrize("dims,spread", [(3, 2), (8, 5), (64, 60)])
def test_search_equals_all_products(dims, spread):
    rng = np.random.default_rng(dims)
    points = clustered(rng, 3000, dims, 20, spread)
    points[100:140] = points[100]
    queries = np.concatenate([points[::20], clustered(rng, 60, dims, 20, spread), points[100:103]])
    scores, ids, search = searched(queries, points, 6)
    full = queries @ points.T
    for i, row in enumerate(full):
        order = np.lexsort((np.arange(len(row)), -row))[:6]
        assert ids[i].tolist() == order.tolist() and scores[i].tolist() == row[order].tolist()
    assert search.compared + search.skipped == full.size
    if dims == 3:  # bounds work where clusters are tight
        assert search.compared < 0.35 * full.size


def test_large_numbers_are_exact():
    rng = np.random.default_rng(1)
    points = rng.integers(-(1 << 28), 1 << 28, (300, 7))
    scores, ids, _ = searched(points[:20], points, 3)
    full = points[:20].astype(object) @ points.T.astype(object)
    assert all(scores[i].tolist() == sorted(map(int, full[i]), reverse=True)[:3] for i in range(20))


def brute(queries, candidates, best):
    def rows(table):
        good = {(i, tuple(math.floor(256 * float(x)) for x in v)) for i, v in table if i is not None and v is not None
                and all(x is not None and math.isfinite(x) and abs(x) < 1e6 for x in v)}
        return good

    told = []
    for q, v in rows(queries):
        scored = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in rows(candidates)
                        if len(w) == len(v) and (c, w) != (q, v))
        told += [(q, k, c, -s) for k, (s, c) in enumerate(scored[:best], 1)]
    return sorted(told)


@pytest.mark.parametrize("block,query_block", [(2048, 512), (16, 4)])
def test_query_against_brute_force(spark, block, query_block):
    rng = np.random.default_rng(block)
    rows = [(i, (rng.normal(size=4).round(1) * (1 + i % 3)).tolist()) for i in range(300)]
    rows += [(400 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(200)]
    rows += [(50, [0.5, 0.5, 0.5, 0.5]), (50, [0.5, 0.5, 0.5, 0.5]), (None, [9.0] * 4), (700, None), (650, [None] * 4),
             (750, [float("nan")] * 4), (750, [float("inf"), 0.0, 0.0, 0.0]), (800, []), (801, []), (850, [1.0]),
             (851, [2.0]), (852, [-2.0]), (900, [1e300, 0.0, 0.0, 0.0]), (950, [0.0] * 9)]
    rows = [(i, v) for i, v in rows]
    frame = spark.createDataFrame(rows, FIELDS)
    queries = [r for r in rows if r[0] is not None and r[0] % 50 == 0]
    extra = frame.selectExpr("*", "1 as dims", "2 as block", "3 as vector", "4 as score", "5 as `rank`")
    got = top_k(extra.filter("vec_id % 50 = 0"), extra, block=block, query_block=query_block).collect()
    assert sorted(map(tuple, got)) == brute(queries, rows, 5)
    assert top_k(frame.limit(0), frame).count() == 0 and top_k(frame, frame.limit(0)).count() == 0


def test_float_vectors_of_the_tables(spark, small):
    from spendtrace.llm.common import table
    from spendtrace.llm.covertree import top_k_query

    rows = [tuple(r) for r in table(spark, small, "embeddings").select("vec_id", "embedding").collect()]
    got = sorted(map(tuple, top_k_query(spark, small).collect()))
    assert got == brute([r for r in rows if r[0] % 50 == 0], rows, 5)

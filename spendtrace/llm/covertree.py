"""Exact top-k by inner product: a dual-tree search over cover trees.

A cover tree splits the points of a node among centres that lie further apart
than the node's next radius and together reach every point within it. Node,
children and grandchildren so enclose their points in ever smaller balls.
Queries and candidates each have trees. For a query node with centre q and
radius r and a candidate node with centre p and radius s no pair scores above

    <q, p> + r |p| + s |q| + r s

so a pair of nodes is skipped if that lies below the worst k-th score that the
queries of the node have found so far. What is left ends in small blocks, whose
scores are one matrix product.

On Spark the first level of the tree is the split of all vectors among pivots.
The vectors of a pivot are dealt into blocks of bounded size, each with a tree
of its own, one row per block. Every query block first searches one block near
it, which gives thresholds, and then all blocks that the bound leaves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendtrace.llm.common import small_or_shuffled, table
from spendtrace.session import materialize

BEST = 5
SCALE = 256
BLOCK = 2048
QUERY_BLOCK = 512
PIVOTS = 256
LEAF = 32
GROUP = 64
PRODUCT = 512
SHRINK = 1.3
# Below this a 64-bit float holds sums of products exactly.
EXACT = float(1 << 53)
# Below every score, and its negative is still a 64-bit integer.
NOTHING = -((1 << 63) - 1)


@dataclass
class Tree:
    """Points in the order of the tree; nodes as arrays, the root first.

    Node i has the points from `start[i]` to `stop[i]`, the first of which is its
    centre, `radius[i]` reaching all of them, and as children the nodes from
    `child[i]` to `child_end[i]` (none for a leaf).
    """

    order: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    child_end: np.ndarray


def _net(points: np.ndarray, apart: float) -> tuple[np.ndarray, np.ndarray]:
    """Centres more than `apart` from each other, the first point being one, that
    reach every point within it; and each point's nearest centre."""
    squares = np.einsum("ij,ij->i", points, points)
    nearest, owner, centres = np.full(len(points), np.inf), np.zeros(len(points), np.int64), []
    at = 0
    while True:
        distance = squares - 2 * (points @ points[at]) + squares[at]
        distance[at] = -1
        closer = distance < nearest
        nearest[closer], owner[closer] = distance[closer], len(centres)
        centres.append(at)
        at = int(nearest.argmax())
        if nearest[at] <= apart * apart:
            return np.array(centres), owner


def build_tree(points: np.ndarray, leaf: int = LEAF, shrink: float = SHRINK) -> Tree:
    """Cover tree of the rows of a matrix, which has one at least."""
    points = points.astype(np.float64)
    order = np.arange(len(points))
    start, stop, radius, child, child_end = [0], [len(points)], [0.0], [0], [0]
    at = 0
    while at < len(start):
        low, high = start[at], stop[at]
        own = points[order[low:high]]
        # Rounded up, so that the ball holds its points whatever the rounding.
        far = float(np.sqrt(np.square(own - own[0]).sum(axis=1).max()))
        radius[at] = far * (1 + 1e-9)
        if high - low > leaf and far > 0:
            centres, owner = _net(own, far / shrink)
            rank = np.ones(len(own), np.int64)
            rank[centres] = 0
            place = np.lexsort((rank, owner))
            order[low:high] = order[low:high][place]
            child[at] = len(start)
            for size in np.bincount(owner):
                start.append(low)
                low += size
                stop.append(low)
                radius.append(0.0)
                child.append(0)
                child_end.append(0)
            child_end[at] = len(start)
        at += 1
    return Tree(order, *(np.array(x) for x in (start, stop, radius, child, child_end)))


class Found:
    """The best (score, id) of each query; the worse of two equal scores has the larger id."""

    def __init__(self, queries: int, best: int):
        self.best = best
        self.scores = np.full((queries, best), NOTHING)
        self.ids = np.full((queries, best), np.iinfo(np.int64).max)

    def add(self, rows: slice, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of the queries `rows` with the candidates `ids`."""
        if scores.shape[1] > 2 * self.best:
            # Only what reaches the k-th score of the block can enter; ties stay.
            cut = -np.partition(-scores, self.best - 1, axis=1)[:, self.best - 1]
            width = int((scores >= cut[:, None]).sum(axis=1).max())
            if width < scores.shape[1]:
                top = np.argpartition(-scores, width - 1, axis=1)[:, :width]
                scores, ids = np.take_along_axis(scores, top, 1), ids[top]
        ids = np.broadcast_to(ids, scores.shape)
        scores = np.concatenate([self.scores[rows], scores], axis=1)
        ids = np.concatenate([self.ids[rows], ids], axis=1)
        order = np.lexsort((ids, -scores), axis=1)[:, :self.best]
        self.scores[rows] = np.take_along_axis(scores, order, 1)
        self.ids[rows] = np.take_along_axis(ids, order, 1)


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Integer inner products; by floats where they are exact."""
    if not left.size or not right.size:
        return np.zeros((len(left), len(right)), np.int64)
    most = float(np.abs(left).max()) * float(np.abs(right).max()) * left.shape[1]
    if most < EXACT:
        return (left.astype(np.float64) @ right.T.astype(np.float64)).astype(np.int64)
    return left @ right.T


def _norms(points: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(points.astype(np.float64)).sum(axis=1))


class DualSearch:
    """Queries and candidates with their trees, searched pair of nodes by pair of nodes.

    Matrices and ids are in the order of their trees. `compared` counts the
    products that were formed, `skipped` those that bounds ruled out.
    """

    def __init__(self, queries: np.ndarray, query_tree: Tree, points: np.ndarray,
                 ids: np.ndarray, tree: Tree, found: Found):
        self.queries, self.query_tree = queries.astype(np.int64), query_tree
        self.points, self.ids, self.tree, self.found = points.astype(np.int64), ids, tree, found
        self.query_norms, self.norms = _norms(queries), _norms(points)
        self.real_queries, self.real = queries.astype(np.float64), points.astype(np.float64)
        self.compared = self.skipped = 0

    def run(self) -> None:
        """Opens both trees level by level until a node has few queries."""
        own, stack = self.query_tree, [(0, len(self.queries), 0, np.array([0]))]
        while stack:
            low, high, group, nodes = stack.pop()
            if group < 0 or high - low <= GROUP or not own.child_end[group]:
                for at in range(low, high, GROUP):
                    self._descend(slice(at, min(at + GROUP, high)), nodes)
                continue
            nodes = self._opened(self._left_of_ball(group, nodes))
            if len(nodes):
                stack += [(*part, nodes) for part in self._parts(group)]

    def _parts(self, group: int) -> list[tuple[int, int, int]]:
        """Children of a query node, small neighbours as one part without a ball (-1)."""
        own, parts = self.query_tree, []
        for i in range(own.child[group], own.child_end[group]):
            low, high = own.start[i], own.stop[i]
            if high - low > GROUP:
                parts.append((low, high, i))
            elif parts and parts[-1][2] < 0 and high - parts[-1][0] <= GROUP:
                parts[-1] = (parts[-1][0], high, -1)
            else:
                parts.append((low, high, -1))
        return parts

    def _opened(self, nodes: np.ndarray) -> np.ndarray:
        """Nodes with children replaced by these."""
        tree, inner = self.tree, self.tree.child_end[nodes] > 0
        return np.concatenate([nodes[~inner], *(
            np.arange(tree.child[i], tree.child_end[i]) for i in nodes[inner])])

    def _left_of_ball(self, group: int, nodes: np.ndarray) -> np.ndarray:
        """The nodes that the bound leaves for a query node."""
        own, centres, reach = self.query_tree, self.tree.start[nodes], self.tree.radius[nodes]
        at, r = own.start[group], own.radius[group]
        rows = slice(at, own.stop[group])
        bound = (self.real[centres] @ self.real_queries[at] + r * self.norms[centres]
                 + reach * self.query_norms[at] + r * reach)
        slack = _slack(self.query_norms[at] + r, self.norms[centres] + reach)
        kept = bound + slack >= self.found.scores[rows, -1].min()
        self._count(rows, nodes[~kept])
        return nodes[kept]

    def _left(self, rows: slice, nodes: np.ndarray) -> np.ndarray:
        """The nodes that the bound leaves for any one of a few queries, best first."""
        centres, reach = self.tree.start[nodes], self.tree.radius[nodes]
        norms = self.query_norms[rows, None]
        score = self.real_queries[rows] @ self.real[centres].T
        slack = _slack(norms, self.norms[centres] + reach)
        kept = (score + norms * reach + slack >= self.found.scores[rows, -1:]).any(axis=0)
        self._count(rows, nodes[~kept])
        return nodes[kept][np.argsort(-score[:, kept].max(axis=0, initial=-np.inf), kind="stable")]

    def _count(self, rows: slice, nodes: np.ndarray) -> None:
        self.skipped += int((rows.stop - rows.start) * (
            self.tree.stop[nodes] - self.tree.start[nodes]).sum())

    def _descend(self, rows: slice, nodes: np.ndarray) -> None:
        """A few queries against nodes: opens large ones, gathers small ones."""
        stack = [nodes]
        while stack:
            nodes = self._left(rows, stack.pop())
            size = self.tree.stop[nodes] - self.tree.start[nodes]
            whole = (self.tree.child_end[nodes] == 0) | (size <= LEAF)
            small, large, ends = nodes[whole], nodes[~whole], np.cumsum(size[whole])
            cuts = np.arange(PRODUCT, ends[-1] if len(ends) else 0, PRODUCT)
            for part in np.split(small, np.searchsorted(ends, cuts)):
                self._compare(rows, part)
            stack += [np.arange(self.tree.child[i], self.tree.child_end[i]) for i in large[::-1]]

    def _compare(self, rows: slice, nodes: np.ndarray) -> None:
        nodes = self._left(rows, nodes)
        if len(nodes):
            at = np.concatenate([np.arange(a, b) for a, b in zip(
                self.tree.start[nodes], self.tree.stop[nodes])])
            self.compared += (rows.stop - rows.start) * len(at)
            self.found.add(rows, _products(self.queries[rows], self.points[at]), self.ids[at])


def _slack(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """More than the rounding of a bound on products of vectors this long."""
    return 1e-9 * left * right + 1


# --- blocks as rows -------------------------------------------------------------

BLOCK_FIELDS = ("block long, dims int, size int, centre array<double>, reach double, ids binary, "
                "points binary, start binary, stop binary, radius binary, child binary, "
                "child_end binary")


def _narrow(points: np.ndarray) -> bytes:
    """The numbers in the fewest bytes that hold them all."""
    most = int(np.abs(points).max(initial=0))
    kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
    return points.astype(kind).tobytes()


def _unpacked(row: dict, prefix: str) -> tuple[np.ndarray, np.ndarray, Tree]:
    """Points, ids and tree of a block."""
    parts = [np.frombuffer(row[prefix + name], np.int64) for name in ("start", "stop", "child", "child_end")]
    ids, dims, data = np.frombuffer(row[prefix + "ids"], np.int64), row[prefix + "dims"], row[prefix + "points"]
    kind = {2: np.int16, 4: np.int32, 8: np.int64}[len(data) // (len(ids) * dims) if dims else 8]
    points = np.frombuffer(data, kind).reshape(len(ids), dims)
    radius = np.frombuffer(row[prefix + "radius"], np.float64)
    return points, ids, Tree(np.arange(len(ids)), parts[0], parts[1], radius, parts[2], parts[3])


def _block_row(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """One block, its vectors as a tree; `key` is (block, dims)."""
    points = np.array(group["vector"].tolist(), np.int64).reshape(len(group), key[1])
    tree = build_tree(points)
    points, ids = points[tree.order], group["vec_id"].to_numpy(np.int64)[tree.order]
    return pd.DataFrame([[
        key[0], key[1], len(points), points[0].astype(float).tolist(), float(tree.radius[0]),
        ids.tobytes(), _narrow(points), *(x.astype(np.int64).tobytes() for x in (tree.start, tree.stop)),
        tree.radius.tobytes(), *(x.astype(np.int64).tobytes() for x in (tree.child, tree.child_end))]],
        columns=[f.split(" ")[0] for f in BLOCK_FIELDS.split(", ")])


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Deal the rows (vec_id, dims, cell, vector) into blocks of about `size` and build trees."""
    key = ["dims", "cell"]
    counts = rows.groupBy(*key).agg(F.count("*").alias("rows"))
    parts = F.ceil(F.col("rows") / size)
    dealt = rows.join(small_or_shuffled(counts), key).withColumn(
        "block", F.xxhash64("dims", "cell", F.pmod(F.xxhash64("vec_id", "vector"), parts)))
    return materialize(dealt.groupBy("block", "dims").applyInPandas(_block_row, BLOCK_FIELDS), "trees")


def _cells(pivots: dict[int, np.ndarray]):
    """The number of the nearest pivot of the same length; 0 where there is none."""

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy(zero_copy_only=False)
            vectors = batch.column("vector")
            cell = np.zeros(batch.num_rows, np.int32)
            for d in np.unique(dims).tolist():
                centres = pivots.get(d)
                if d and centres is not None:
                    rows = np.flatnonzero(dims == d)
                    own = vectors.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), d)
                    own = own.astype(np.float64)
                    cell[rows] = (np.square(centres).sum(axis=1) - 2 * own @ centres.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)],
                                             [*batch.schema.names, "cell"])

    return assigned


def _pivots(rows: DataFrame, most: int) -> list[list[int]]:
    """At most `most` vectors as centres, those with the smallest hashes."""
    drawn = rows.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(most).collect()
    return [row["vector"] for row in drawn]


def _with_cell(rows: DataFrame, pivots: list[list[int]], block: int) -> DataFrame:
    """Add `cell`, one for some `block` rows, of no more pivots than there are."""
    by_length: dict[int, list] = {}
    for vector in pivots[:max(1, rows.count() // block)]:
        by_length.setdefault(len(vector), []).append(vector)
    centres = {d: np.array(v, np.float64) for d, v in by_length.items()}
    return rows.mapInArrow(_cells(centres), "vec_id long, vector array<bigint>, dims int, cell int")


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as long; null for vectors that take no part.

    Those are null, hold a null or a non-finite component, or are so long that
    a product of two such vectors might not fit a 64-bit integer.
    """
    real = F.transform(vector, lambda x: x.cast("double") * F.lit(float(scale)))
    bad = F.exists(real, lambda x: x.isNull() | F.isnan(x) | (
        F.abs(x) >= F.sqrt(F.lit(float(1 << 62)) / F.size(vector)) - 1))
    return F.when(~bad, F.transform(real, lambda x: F.floor(x).cast("long")))


def _search(best: int):
    """Search each pair of blocks; thresholds come with the query block where it has them."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                queries, query_ids, query_tree = _unpacked(row, "q_")
                points, ids, tree = _unpacked(row, "c_")
                found = Found(len(queries), best)
                if row.get("known") is not None:
                    # One below: an equal score may still win by its id.
                    found.scores[:, -1] = np.frombuffer(row["known"], np.int64) - 1
                    found.scores[:, :-1] = found.scores[:, -1:]
                floor = found.scores[:, -1].copy()
                search = DualSearch(queries, query_tree, points, ids, tree, found)
                search.run()
                real = (found.ids != np.iinfo(np.int64).max) & (found.scores > floor[:, None])
                at = np.nonzero(real)[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), row["q_block"])), pa.array(at.astype(np.int32)),
                     pa.array(query_ids[at]), pa.array(found.ids[real]), pa.array(found.scores[real]),
                     pa.array(np.full(len(at), search.compared)),
                     pa.array(np.full(len(at), search.skipped))],
                    ["q_block", "place", "query", "vec_id", "score", "compared", "skipped"])

    return searched


SEARCH_FIELDS = ("q_block long, place int, query long, vec_id long, score long, "
                 "compared long, skipped long")


def _known(best: int):
    """(q_block, known, worst): the last score of each query of a block, and the least one."""

    def gathered(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        known = np.full(int(group["size"].iloc[0]), NOTHING + 1)
        ranked = group[group["rank"] == best]
        known[ranked["place"].to_numpy(np.int64)] = ranked["score"].to_numpy(np.int64)
        return pd.DataFrame({"q_block": [key[0]], "known": [known.tobytes()], "worst": [known.min()]})

    return gathered


def _pairs(queries: DataFrame, trees: DataFrame) -> DataFrame:
    """(q_block, c_block, bound, score): what balls say about each pair of blocks.

    The stated queries against all rows, in blocks; only centres and radii.
    """
    left = queries.select("dims", F.col("block").alias("q_block"), F.col("centre").alias("q_centre"),
                          F.col("reach").alias("q_reach"))
    right = trees.select("dims", F.col("block").alias("c_block"), F.col("centre").alias("c_centre"),
                         F.col("reach").alias("c_reach"))

    def dot(a: str, b: str) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    norms = {s: F.sqrt(dot(f"{s}_centre", f"{s}_centre")) for s in "qc"}
    score = dot("q_centre", "c_centre")
    ball = (F.col("q_reach") * norms["c"] + F.col("c_reach") * norms["q"]
            + F.col("q_reach") * F.col("c_reach"))
    size = (F.col("q_reach") + norms["q"]) * (F.col("c_reach") + norms["c"])
    return small_or_shuffled(left).join(right, "dims").select(
        "q_block", "c_block", score.alias("score"), (score + ball + 1e-9 * size + 1).alias("bound"))


def _side(blocks: DataFrame, prefix: str) -> DataFrame:
    return blocks.select(*[F.col(c).alias(f"{prefix}_{c}") for c in blocks.columns
                           if c not in ("centre", "reach")])


def _best_rows(rows: DataFrame, best: int) -> DataFrame:
    """The best `best` rows per query vector, cut in each task before the shuffle."""
    order = Window.partitionBy("q_block", "place").orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)


def top_k(queries: DataFrame, candidates: DataFrame, best: int = BEST, scale: int = SCALE,
          block: int = BLOCK, query_block: int = QUERY_BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the `best` candidates of each query.

    Both tables need vec_id (an integer) and embedding; other columns are not
    used. A component x counts as floor(scale * x), the score is the integer
    inner product, equal scores go to the smaller vec_id. Vectors that are null
    or hold a null or non-finite component take no part, nor do rows without an
    id or vectors whose products might not fit a 64-bit integer. Vectors are
    compared with those of their own length; empty ones have score 0. Rows equal
    in id and vector are one row; a query meets every row but its own, so
    another vector under its id is a candidate, and two vectors under one id
    are two queries. A query with fewer candidates than `best` has all of
    them. Empty tables give no rows.

    Of equal vectors only the `best` + 1 smallest ids can appear, so the others
    leave before anything meets; equal queries are searched once.
    """
    taken = "vec_id is not null and vector is not null"
    vector = scaled(F.col("embedding"), scale).alias("vector")
    rows, asked = (df.select(F.col("vec_id").cast("long"), vector).filter(taken).distinct()
                   for df in (candidates, queries))
    smallest = Window.partitionBy("vector").orderBy("vec_id")
    rows = materialize(rows.withColumn("_place", F.row_number().over(smallest)).filter(
        F.col("_place") <= best + 1).select("vec_id", "vector", F.size("vector").alias("dims")), "vectors")
    asked = materialize(asked.select(F.col("vec_id").alias("query_id"), "vector"), "queries")
    # A number of its own names a query vector until its rows are joined back.
    different = materialize(asked.select("vector").distinct().select(
        F.monotonically_increasing_id().alias("vec_id"), "vector",
        F.size("vector").alias("dims")), "query-vectors")
    centres = _pivots(rows, pivots)
    trees = _blocks(_with_cell(rows, centres, block), block)
    groups = _blocks(_with_cell(different, centres, query_block), query_block)

    pairs = materialize(_pairs(groups, trees), "block-pairs")
    first = pairs.groupBy("q_block").agg(F.max(F.struct("score", "c_block")).alias("_n")).select(
        "q_block", F.col("_n.c_block").alias("c_block"))
    sides = _side(groups, "q"), _side(trees, "c")
    nearest = materialize(first.join(sides[0], "q_block").join(sides[1], "c_block").mapInArrow(
        _search(best + 1), SEARCH_FIELDS), "first-found")
    known = materialize(
        groups.select(F.col("block").alias("q_block"), "size").join(
            _best_rows(nearest, best + 1).select("q_block", "place", "rank", "score"), "q_block")
        .groupBy("q_block").applyInPandas(_known(best + 1), "q_block long, known binary, worst long"),
        "thresholds")
    others = pairs.join(known.select("q_block", "worst"), "q_block").filter(
        F.col("bound") >= F.col("worst")).join(first, ["q_block", "c_block"], "left_anti")
    rest = others.select("q_block", "c_block").join(
        sides[0].join(known.drop("worst"), "q_block"), "q_block").join(
        sides[1], "c_block").mapInArrow(_search(best + 1), SEARCH_FIELDS)
    found = _best_rows(nearest.unionByName(rest), best + 1).groupBy("q_block", "place").agg(
        F.min("query").alias("vec_id"), F.sort_array(F.collect_list(F.struct(
            (-F.col("score")).alias("minus"), F.col("vec_id").alias("id")))).alias("_all"))
    told = different.select("vec_id", "vector").join(found.select("vec_id", "_all"), "vec_id").drop(
        "vec_id").join(asked, "vector")

    # The query's own row is the one of its id with the vector's product with itself.
    itself = F.aggregate(F.transform("vector", lambda x: x * x), F.lit(0).cast("long"), lambda s, x: s + x)
    own = F.array_position("_all", F.struct((-itself).alias("minus"), F.col("query_id").alias("id")))
    others_found = F.filter("_all", lambda _, i: (i + 1) != F.col("_own"))
    return told.withColumn("_own", own).select(
        "query_id", F.posexplode(F.slice(others_found, 1, best)).alias("_at", "_one")).select(
        "query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_one.id").alias("vec_id"),
        (-F.col("_one.minus")).alias("score"))


def top_k_query(spark, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return top_k(rows.filter(F.col("vec_id") % 50 == 0), rows)


TOP_K_SQL = f"""
with rows as (select vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v
  from embeddings where embedding is not null and len(list_filter(
    embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
scores as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(
    list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score
  from rows q join rows c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as place
  from scores)
select query_id, place::integer as rank, vec_id, score from ranked where place <= {BEST}
"""

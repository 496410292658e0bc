"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample of the vectors (`sample_rows`), split by k-means into
`branching` children until a node holds `leaf_rows` sampled vectors. Every vector of the
table is then put into the leaf that it reaches going down by nearest centroids.

A query visits leaves best bin first: a priority queue holds the nodes met so far by the
distance of their centroids, the nearest is opened, a leaf is visited. How many leaves are
visited is calibrated: for a bounded set of vectors, outside the sample that the tree was
fitted on, the exact neighbours are found by comparing them with all rows, and the visits are widened until the leaves visited hold the
wanted share of these neighbours. A query goes on beyond that until its leaves hold more
than k vectors. Distances inside the visited leaves are exact.

Neighbouring leaves are stored together in bins of about `BLOCK_ROWS` vectors. A query goes
to a bin once with the list of the leaves that it visits there, and takes k candidates back.
A leaf with more vectors is a bin of several blocks, and the queries of a bin are dealt into
slots, by measured counts, so that a leaf full of equal vectors is many tasks. What is
broadcast is the tree, the calibration queries and a few numbers per leaf, all bounded by
parameters.

Defined results: vectors that are NULL, of another length than most, zero, or with NULL or
non-finite components take no part, as query or candidate; nor do rows without an id. Rows
that repeat an id count once per query, with the nearest of their vectors; a query that is
repeated takes the smallest of its vectors. Ties go to the smaller id. Fewer candidates than
k give as many rows, and an empty frame none; rows that are equal in all are one candidate. Only the named columns are read. `left_out`
counts the rows that take no part, by reason. Work: queries and rows per leaf both grow with
the table while the leaves follow the sample, so pass a larger `sample_rows` for larger
tables.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluicegate.llm.tables import Staging

SAMPLE_ROWS = 20_000
BRANCHING = 8
LEAF_ROWS = 16
CALIBRATION_QUERIES = 200
TARGET_RECALL = 0.97
BLOCK_ROWS = 4096
_STEPS = 12


@dataclass
class Tree:
    """Nodes by number, 0 the root: centroid, children (none: a leaf) and the leaf's number."""

    centroids: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    def add(self, points: np.ndarray, branching: int, leaf_rows: int, rng: np.random.Generator) -> int:
        node = len(self.centroids)
        self.centroids.append(points.mean(axis=0))
        self.children.append([])
        self.leaf.append(-1)
        groups = _split(points, branching, rng) if len(points) > leaf_rows else []
        if len(groups) < 2:
            self.leaf[node] = self.leaves
            self.leaves += 1
        else:
            self.children[node] = [self.add(g, branching, leaf_rows, rng) for g in groups]
        return node

    def leaves_of(self, points: np.ndarray) -> np.ndarray:
        """The leaf that each point reaches."""
        found = np.empty(len(points), dtype=np.int64)
        open_ = [(0, np.arange(len(points)))]
        while open_:
            node, rows = open_.pop()
            if not self.children[node]:
                found[rows] = self.leaf[node]
                continue
            nearest = _nearest(points[rows], np.stack([self.centroids[c] for c in self.children[node]]))
            for i, child in enumerate(self.children[node]):
                if len(own := rows[nearest == i]):
                    open_.append((child, own))
        return found

    def best_bins(self, query: np.ndarray) -> Iterator[int]:
        """Leaves in the order of a best-bin-first search."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            children = self.children[node]
            if not children:
                yield self.leaf[node]
                continue
            away = ((np.stack([self.centroids[c] for c in children]) - query) ** 2).sum(axis=1)
            for distance, child in zip(away.tolist(), children, strict=True):
                heapq.heappush(queue, (distance, child))

    def visited(self, query: np.ndarray, visits: int, rows: list[int], enough: int) -> list[int]:
        """The first `visits` leaves, and more until they hold `enough` rows."""
        found, held = [], 0
        for leaf in self.best_bins(query):
            if len(found) >= visits and held >= enough:
                break
            found.append(leaf)
            held += rows[leaf]
        return found


def _nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(axis=1) - 2 * points @ centroids.T).argmin(axis=1)


def _split(points: np.ndarray, k: int, rng: np.random.Generator) -> list[np.ndarray]:
    """k-means groups of the points, without empty ones."""
    centroids = points[rng.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(_STEPS):
        nearest = _nearest(points, centroids)
        moved = np.stack([points[nearest == i].mean(axis=0) for i in np.unique(nearest)])
        if moved.shape == centroids.shape and np.allclose(moved, centroids):
            break
        centroids = moved
    nearest = _nearest(points, centroids)
    return [points[nearest == i] for i in np.unique(nearest)]


def fit_tree(points: np.ndarray, branching: int = BRANCHING, leaf_rows: int = LEAF_ROWS) -> Tree:
    tree = Tree()
    tree.add(points.astype(np.float64), branching, leaf_rows, np.random.default_rng(17))
    return tree


def _usable(vector: Column) -> Column:
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & F.forall(vector, good) & F.exists(vector, lambda x: x != 0)


def _arrays(column: pa.Array) -> np.ndarray:
    """A list column without NULLs as a matrix."""
    return np.array(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1)


def _vectors(rows: list) -> np.ndarray:
    return np.array([r["vector"] for r in rows], dtype=np.float64)


def _exact_leaves(vectors: DataFrame, queries: list, k: int) -> dict[int, list[int]]:
    """The leaves of the k nearest rows of a few queries, by comparison with all rows."""
    ids, points = np.array([q["id"] for q in queries]), _vectors(queries)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in ids]
        for batch in batches:
            own, leaves = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            matrix = _arrays(batch.column(1))
            for i, point in enumerate(points):
                away = ((matrix - point) ** 2).sum(axis=1)
                away[own == ids[i]] = np.inf
                for j in np.argpartition(away, min(k, len(away) - 1))[:k] if len(away) else []:
                    if np.isfinite(away[j]):
                        best[i].append((float(away[j]), int(own[j]), int(leaves[j])))
                best[i] = sorted(set(best[i]))[:k]
        flat = [(int(ids[i]), *found) for i, own in enumerate(best) for found in own]
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("query", "away", "id", "leaf"), row, strict=True)) for row in flat],
            schema=pa.schema([("query", pa.int64()), ("away", pa.float64()), ("id", pa.int64()), ("leaf", pa.int64())]),
        )

    found = vectors.select("id", "vector", "leaf").mapInArrow(nearest, "query bigint, away double, id bigint, leaf bigint")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("away", "id")))
    leaves: dict[int, list[int]] = {}
    for row in ranked.filter(F.col("rank") <= k).collect():  # at most k rows per calibration query
        leaves.setdefault(row["query"], []).append(row["leaf"])
    return leaves


def calibrated_visits(tree: Tree, queries: list, leaves: dict[int, list[int]], target: float) -> int:
    """The smallest number of visits, doubled from 1 and then narrowed, whose leaves hold
    the wanted share of all exact neighbours."""
    places = []
    for row, point in zip(queries, _vectors(queries), strict=True):
        if row["id"] in leaves:
            place = {leaf: i for i, leaf in enumerate(tree.best_bins(point))}
            places += [place[leaf] for leaf in leaves[row["id"]]]
    reached = lambda visits: sum(p < visits for p in places) >= target * len(places)
    high = 1
    while not reached(high):
        high *= 2
    return next(v for v in range(max(1, high // 2), high + 1) if reached(v))


def left_out(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """reason, n: how many rows `nearest_neighbours` passes over: no_id, no_vector (NULL, empty,
    zero, or a component that is no finite number) or other_length (than most vectors have)."""
    usable = _usable(F.col(f"`{vector}`"))
    known = F.col(f"`{key}`").isNotNull()
    counted = rows.select(
        F.when(~known, "no_id").when(~F.coalesce(usable, F.lit(False)), "no_vector").alias("reason"), F.size(f"`{vector}`").alias("length")
    ).groupBy("reason", F.when(F.col("reason").isNull(), F.col("length")).alias("length")).agg(F.count(F.lit(1)).alias("n"))
    most = counted.filter("reason is null").agg(F.max_by("length", F.struct("n", -F.col("length")))).first()[0]
    reason = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("length") != F.lit(most), "other_length")
    return counted.select(reason.alias("reason"), "n").filter("reason is not null").groupBy("reason").agg(F.sum("n").alias("n"))


def nearest_neighbours(
    rows: DataFrame,
    queries: str,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 10,
    sample_rows: int = SAMPLE_ROWS,
    branching: int = BRANCHING,
    leaf_rows: int = LEAF_ROWS,
    target_recall: float = TARGET_RECALL,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """query_id, rank, `key`, score: the k nearest found of every row for which the SQL
    condition `queries` holds, by Euclidean distance. Starts jobs."""
    spark = rows.sparkSession
    staging = Staging(spark, "neighbours")
    named = rows.filter(F.col(f"`{key}`").isNotNull() & _usable(F.col(f"`{vector}`"))).select(
        F.col(f"`{key}`").cast("bigint").alias("id"),
        F.col(f"`{vector}`").cast("array<double>").alias("vector"),
        F.expr(queries).alias("asked"),
    )
    lengths = named.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], f"query_id bigint, rank int, {key} bigint, score double")
    named = named.filter(F.size("vector") == lengths["n"])
    # By hash, each task gives only its share; equal rows fall together, so a limit holds the bound.
    total = lengths["count"]
    held_out = min(0.5, CALIBRATION_QUERIES / total)
    by_hash = named.select("id", "vector", (F.pmod(F.xxhash64("id", "vector"), F.lit(1 << 30)) / float(1 << 30)).alias("at"))
    fitting = F.col("at").between(held_out, held_out + sample_rows / total)
    sample = by_hash.filter(fitting).limit(sample_rows).collect() or by_hash.limit(sample_rows).collect()
    some = by_hash.filter(F.col("at") < held_out).limit(2 * CALIBRATION_QUERIES).collect() or sample[:CALIBRATION_QUERIES]
    tree = fit_tree(_vectors(sample), branching, leaf_rows)
    shared = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = pa.array(shared.value.leaves_of(_arrays(batch.column(1))), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, leaves], ["id", "vector", "asked", "leaf"])

    placed = staging.keep(
        named.mapInArrow(place, "id bigint, vector array<double>, asked boolean, leaf bigint"), "placed"
    )
    counts = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}  # a row per leaf
    rows_of = [counts.get(leaf, 0) for leaf in range(tree.leaves)]
    visits = calibrated_visits(tree, some, _exact_leaves(placed, some, k), target_recall)

    bin_of = _bins(rows_of, block_rows)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for point in _arrays(batch.column(1)):
                by_bin: dict[int, list[int]] = {}
                for leaf in shared.value.visited(point, visits, rows_of, k + 1):
                    by_bin.setdefault(bin_of[leaf], []).append(leaf)
                found.append([{"bin": b, "leaves": leaves} for b, leaves in by_bin.items()])
            kind = pa.list_(pa.struct([("bin", pa.int64()), ("leaves", pa.list_(pa.int64()))]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], ["id", "vector", "visits"])

    asked = placed.filter("asked").groupBy("id").agg(F.min("vector").alias("vector"))
    visit_type = "id bigint, vector array<double>, visits array<struct<bin:bigint,leaves:array<bigint>>>"
    probes = staging.keep(
        asked.mapInArrow(visit, visit_type).select("id", "vector", F.inline("visits")), "probes"
    )
    leaf_bins = spark.createDataFrame(list(enumerate(bin_of)), "leaf bigint, bin bigint")
    binned = placed.join(F.broadcast(leaf_bins), "leaf")
    blocks = binned.groupBy("bin").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"))
    slots = probes.groupBy("bin").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("slots"))
    dealing = F.broadcast(staging.keep(blocks.join(slots, "bin"), "dealing"))  # a row per bin
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    stored = binned.join(dealing, "bin").select(
        "bin",
        own("blocks").alias("block"),
        every("slots").alias("slot"),
        F.lit(0).alias("side"),
        "id",
        "vector",
        F.array("leaf").alias("leaves"),
    )
    asking = probes.join(dealing, "bin").select(
        "bin",
        every("blocks").alias("block"),
        own("slots").alias("slot"),
        F.lit(1).alias("side"),
        "id",
        "vector",
        "leaves",
    )
    by = ["bin", "block", "slot"]
    met = stored.unionByName(asking).repartition(*by).sortWithinPartitions(*by, "side", "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, points, leaves = None, [], [], []
        for batch in batches:
            heads = zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True)
            sides, own_ids, matrix = batch.column(3).to_numpy(), batch.column(4).to_numpy(), _arrays(batch.column(5))
            out: list[tuple[int, int, float]] = []
            stacked = None
            for i, head in enumerate(heads):
                if head != current:
                    current, ids, points, leaves, stacked = head, [], [], [], None
                at = batch.column(6)[i].as_py()
                if sides[i] == 0:
                    ids.append(own_ids[i])
                    points.append(matrix[i])
                    leaves.append(at[0])
                    stacked = None
                elif ids:
                    if stacked is None:
                        stacked = (np.array(ids), np.stack(points), np.array(leaves))
                    visited = np.isin(stacked[2], at)
                    out += _closest(int(own_ids[i]), matrix[i], stacked[0][visited], stacked[1][visited], k)
            kinds = (pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], ["query_id", "id", "score"]
            )

    found = met.mapInArrow(compare, "query_id bigint, id bigint, score double")
    best = found.groupBy("query_id", "id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return (
        best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")
    )


def _bins(rows_of: list[int], block_rows: int) -> list[int]:
    """The bin of each leaf: runs of leaves, neighbours in the tree, with `block_rows`
    vectors at most together, or one larger leaf."""
    bins, number, held = [], 0, 0
    for rows in rows_of:
        if held and held + rows > block_rows:
            number, held = number + 1, 0
        bins.append(number)
        held += rows
    return bins


def _closest(query: int, point: np.ndarray, ids: np.ndarray, points: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The k nearest different ids of a block, the query's own left out."""
    away = np.sqrt(((points - point) ** 2).sum(axis=1))
    found, seen = [], {query}
    for j in np.lexsort((ids, away)):
        if (candidate := int(ids[j])) not in seen:
            seen.add(candidate)
            found.append((query, candidate, float(away[j])))
            if len(found) == k:
                break
    return found

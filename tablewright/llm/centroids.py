"""Exact centroid clustering in integers with a vantage-point tree over the centroids.

*Vectors.* Those with exactly ``dims`` components, none null, NaN or infinite, become integers floor(256 * x); what lies beyond 2 ** 27 in
size is set to it, so that squared distances fit 64 bits. They are stored once.

*Rounds.* Centroids start as the ``k`` vectors whose ``<seed>:<id>`` has the smallest SHA-256. Each round the driver builds a
vantage-point tree over the centroids, a few thousand numbers whatever the data, and sends it to the tasks. A task assigns its vectors and
gives back counts and sums per centroid; these are added up in Spark, and k * dims totals reach the driver.

*Search.* Every vector walks the tree best first: it opens its node with the least lower bound, meets the vantage point or the leaf's centroids at
exact integer distances, and sets bounds for the children from the triangle inequality. A node stays open while its bound does not exceed
the best distance (inclusive, with room for rounding), so equally near centroids are all met and the smaller number wins.
The vectors of a batch walk together: each step takes all vectors that stand at one node.

Defined cases: vectors of other lengths, null vectors and those with null, NaN or infinite components are left out. A null id counts as
empty text in the hash; equal ids are ordered by their components, and equal vectors under one id start as that many equal centroids. With fewer
vectors than ``k`` each starts a centroid; an empty table gives an empty one. A centroid without vectors stays where it is. Sums of distances that
no long can hold are null. Extra columns are ignored.
"""

from __future__ import annotations

import dataclasses
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import stored

K, DIMS, ROUNDS, SEED, SCALE = 40, 64, 5, 2, 256
FURTHEST = 1 << 27
LEAF = 4
ROWS = 1 << 12  # vectors that walk together


@dataclasses.dataclass(frozen=True)
class Tree:
    """Node by node: its points (the vantage point, or those of a leaf) and per child its number and the range of distances to the vantage point."""

    centroids: np.ndarray
    points: list[list[int]]
    children: list[list[tuple[int, float, float]]]


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (vectors, centroids) as 64-bit integers."""
    out = np.empty((len(vectors), len(centroids)), dtype=np.int64)
    for i, c in enumerate(centroids):
        away = vectors - c
        out[:, i] = np.einsum("ij,ij->i", away, away)
    return out


def build(centroids: np.ndarray) -> Tree:
    """A tree whose vantage points are those with the widest spread of distances; each halves its points at the median."""
    points, children = [], []

    def grow(own: np.ndarray) -> int:
        node = len(points)
        points.append([])
        children.append([])
        if len(own) <= LEAF:
            points[node] = own.tolist()
            return node
        apart = np.sqrt(squared(centroids[own], centroids[own]).astype(float))
        chosen = int(np.argmax(apart.var(axis=1)))
        points[node] = [int(own[chosen])]
        rest, away = np.delete(own, chosen), np.delete(apart[chosen], chosen)
        order = np.argsort(away, kind="stable")
        for side in np.array_split(order, 2):
            low, high = float(away[side].min()), float(away[side].max())
            children[node].append((grow(rest[side]), low, high))
        return node

    if len(centroids):
        grow(np.arange(len(centroids)))
    return Tree(centroids, points, children)


def nearest(tree: Tree, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each vector's nearest centroid, the smaller number on ties; and how many distances were worked out."""
    count, nodes = len(vectors), len(tree.points)
    best, number = np.full(count, np.iinfo(np.int64).max), np.full(count, len(tree.centroids), dtype=np.int64)
    bound = np.full((count, nodes), np.inf)
    bound[:, 0] = 0.0
    walking, met = np.arange(count), 0
    while len(walking):
        node = np.argmin(bound[walking], axis=1)
        least = bound[walking, node]
        reach = np.sqrt(best[walking].astype(float))
        going = least <= reach * (1 + 1e-9) + 1e-6  # inclusive; rounding never closes a node
        walking, node = walking[going], node[going]
        bound[walking, node] = np.inf
        for n in np.unique(node):
            here = walking[node == n]
            exact = squared(vectors[here], tree.centroids[tree.points[n]])
            met += exact.size
            for i, p in enumerate(tree.points[n]):
                d = exact[:, i]
                better = (d < best[here]) | ((d == best[here]) & (p < number[here]))
                best[here[better]], number[here[better]] = d[better], p
            for child, low, high in tree.children[n]:
                d = np.sqrt(exact[:, 0].astype(float))
                bound[here, child] = np.maximum(0.0, np.maximum(d - high, low - d))
    return number, best, met


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(-1, dims)


def kept_vectors(table: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, vector): the integers of every vector that takes part, each array of exactly ``dims`` components."""
    v = F.col("v")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    whole = rows.where((F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    limit = float(FURTHEST)
    return whole.select("vec_id", F.transform(v, lambda x: F.floor(F.greatest(F.lit(-limit), F.least(F.lit(limit), x * float(scale)))).cast("int")).alias("vector"))


def _sums(sent, dims: int):
    def run(batches):
        tree = sent.value
        count = np.zeros(len(tree.centroids), dtype=np.int64)
        total = np.zeros((len(tree.centroids), dims), dtype=np.int64)
        for batch in batches:
            vectors = _matrix(batch.column(0), dims)
            for at in range(0, len(vectors), ROWS):
                some = vectors[at : at + ROWS]
                number = nearest(tree, some)[0]
                order = np.argsort(number, kind="stable")
                own, first = np.unique(number[order], return_index=True)
                count[own] += np.diff(np.append(first, len(number)))
                total[own] += np.add.reduceat(some[order], first, axis=0)
        full = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(full.astype(np.int32)), pa.array(count[full]), pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1) * dims, pa.int32()), pa.array(total[full].ravel()))],
            ["cluster", "n", "sums"])

    return run


def _assign(sent, dims: int):
    def run(batches):
        for batch in batches:
            vectors = _matrix(batch.column(1), dims)
            for at in range(0, len(vectors), ROWS):
                number, distance, _ = nearest(sent.value, vectors[at : at + ROWS])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(number)), pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def clusters(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, dims: int = DIMS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE) -> DataFrame:
    """Row per vector that takes part: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = table.sparkSession
    vectors = stored(kept_vectors(table, id_col, vector_col, dims, scale), "vectors")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = vectors.select(name.alias("hash"), "vector").orderBy("hash", "vector").limit(k).collect()
    centroids = np.array([r.vector for r in first], dtype=np.int64).reshape(-1, dims)
    for _ in range(rounds if len(centroids) else 0):
        sent = spark.sparkContext.broadcast(build(centroids))
        parts = vectors.select("vector").mapInArrow(_sums(sent, dims), "cluster int, n long, sums array<long>")
        totals = parts.select("cluster", "n", F.posexplode("sums").alias("place", "part")).groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("part").alias("total"))
        centroids = centroids.copy()
        for r in totals.collect():  # k * dims rows
            centroids[r.cluster, r.place] = r.total // r.n
    assigned = stored(vectors.mapInArrow(_assign(spark.sparkContext.broadcast(build(centroids)), dims), "vec_id long, cluster int, distance long"), "assigned")
    digests = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    inertia = {r.cluster: r.inertia for r in assigned.groupBy("cluster").agg(F.try_sum("distance").alias("inertia")).collect()}  # k rows at most
    total = None if None in inertia.values() or sum(inertia.values()) >= 2**63 else sum(inertia.values())
    facts = spark.createDataFrame([(i, inertia.get(i), total, d) for i, d in digests], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = K, dims: int = DIMS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE) -> str:
    """The same by comparing every vector with every centroid, one step per round."""
    steps = [f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS INTEGER) AS c, v AS m FROM v QUALIFY c < {k})"""]
    near = """SELECT vec_id, v, c, d FROM (SELECT vec_id, v, c, CAST(list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v, c{r})
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1"""
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({near.format(r=r)})")
        steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(n.m, c{r}.m) AS m FROM c{r} LEFT JOIN (SELECT c, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS m
  FROM (SELECT c, i, CAST(sum(x) AS DOUBLE) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range({dims})) AS i FROM a{r}) GROUP BY c, i) GROUP BY c) n ON n.c = c{r}.c)""")
    return "WITH " + ",\n".join([*steps, f"z AS MATERIALIZED ({near.format(r=rounds)})"]) + f"""
SELECT vec_id, z.c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY z.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM z JOIN c{rounds} f ON f.c = z.c"""

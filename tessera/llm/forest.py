"""Approximate nearest neighbours: a forest of random-projection trees under one priority queue.

Fitting takes a bounded sample of the vectors. Each node of each tree projects onto the
difference of two of its sample vectors and splits at the median, so a tree's ``leaves`` hold equal shares
of the sample, whatever its size; every row, sampled or not, is then routed to one leaf of each tree. A query walks all
trees from one heap: the node with the least sum of squared margins crossed comes first, whatever its tree,
until the leaves taken hold a set share of the rows. The vectors of these leaves are measured exactly
against the query; each task keeps the k nearest of each query it meets, and these lists are merged. A walk goes on until
one tree alone, whose leaves share no row, has given k rows beside the query, and until the leaves hold ``least`` rows: small tables are searched nearly whole.

Equal vectors stand as one row of the index with the k + 1 smallest of their ids (as many as one
answer can name), so copies neither fill a leaf nor hide other neighbours. A leaf of many rows is dealt to several
tasks, each of which its queries visit.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no part;
nor do those whose width differs from that of most sampled vectors. A query never meets its own
id. Equal distances go by smaller id. If there are k candidates or fewer, all are given. An
id that occurs twice with different vectors is two candidates, of which the nearer counts. Extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.plans.staging import materialise

#: Rows of a leaf in one task.
CROWDED = 4096


@dataclass(frozen=True)
class Forest:
    """Trees of one depth; node i of a level has the children 2i and 2i + 1 of the next."""

    normals: np.ndarray  # trees, inner nodes, width
    cuts: np.ndarray  # trees, inner nodes
    depth: int

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree (rows by trees)."""
        out = np.zeros((len(vectors), len(self.cuts)), dtype=np.int32)
        for t in range(len(self.cuts)):
            at = np.zeros(len(vectors), dtype=np.int64)
            for level in range(self.depth):
                node = (1 << level) - 1 + at
                at = 2 * at + (np.einsum("ij,ij->i", vectors, self.normals[t, node]) > self.cuts[t, node])
            out[:, t] = at
        return out

    def visits(self, query: np.ndarray, sizes: np.ndarray, search: int, distinct: int) -> list[tuple[int, int]]:
        """The (tree, leaf) pairs that hold ``search`` rows, copies over the trees counted, and ``distinct`` rows at least, by least squared margins over all trees."""
        margin = self.normals @ query - self.cuts
        heap = [(0.0, t, 0, 0) for t in range(len(self.cuts))]
        out, held, last = [], np.zeros(len(self.cuts), dtype=np.int64), 1 << self.depth
        while heap and (held.sum() < search or held.max() < distinct):  # rows of one tree's leaves are distinct
            worst, t, level, at = heapq.heappop(heap)
            while level < self.depth:
                m = margin[t, (1 << level) - 1 + at]
                near = int(m > 0)
                heapq.heappush(heap, (worst + m * m, t, level + 1, 2 * at + 1 - near))
                level, at = level + 1, 2 * at + near
            assert at < last
            if sizes[t, at]:
                out.append((t, at))
                held[t] += sizes[t, at]
        return out


def grow(sample: np.ndarray, trees: int, leaves: int, seed: int = 7) -> Forest:
    """Fit the trees, of ``leaves`` leaves (a power of two; fewer where there are fewer rows), on a sample."""
    depth = int(np.log2(max(1, min(leaves, len(sample)))))
    rng = np.random.default_rng(seed)
    inner, width = (1 << depth) - 1, sample.shape[1]
    normals, cuts = np.zeros((trees, inner, width)), np.zeros((trees, inner))
    for t in range(trees):
        groups = [np.arange(len(sample))]
        for level in range(depth):
            after = []
            for i, rows in enumerate(groups):
                node = (1 << level) - 1 + i
                direction = rng.standard_normal(width)
                if len(rows) > 1:
                    a, b = rng.choice(rows, 2, replace=False)
                    if np.any(sample[a] != sample[b]):
                        direction = sample[a] - sample[b]
                direction = direction / np.linalg.norm(direction)
                along = sample[rows] @ direction
                cut = float(np.median(along)) if len(rows) else 0.0
                normals[t, node], cuts[t, node] = direction, cut
                after += [rows[along <= cut], rows[along > cut]]
            groups = after
    return Forest(normals, cuts, depth)


def fit(rows: DataFrame, trees: int = 16, leaves: int = 512, sample: int = 32768, seed: int = 7) -> Forest | None:
    """Fit on the ``sample`` rows (id long, vector array<double>) with the smallest hash: a bounded sample."""
    n = rows.count()
    near = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, 1.2 * sample / max(n, 1))))  # few more than are asked for go to one task
    got = near.orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 40)), "id").limit(sample).select("vector").toArrow().column(0).to_pylist()
    if not got:
        return None
    widths, n = np.unique([len(v) for v in got], return_counts=True)
    width = int(widths[np.argmax(n)])
    return grow(np.array([v for v in got if len(v) == width], dtype=float), trees, leaves, seed)


def search(rows: DataFrame, is_query: Column, k: int, key: str, vector: str, trees: int = 16, leaves: int = 512, sample: int = 32768, share: float = 0.75, least: int = 1024, crowded: int = CROWDED) -> DataFrame:
    """query_id, rank (from 1), ``key`` and score (distance) of the k nearest found of each row that ``is_query`` marks.

    A query takes leaves, copies over the trees counted, until they hold ``share`` of the rows, ``least`` rows and k other rows. ``crowded``: rows of a leaf in one task."""
    spark = rows.sparkSession
    own = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), is_query.alias("_q"))
    usable = own.where("id is not null and vector is not null and exists(vector, x -> x <> 0) and not exists(vector, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    few = usable.select("id", "vector").distinct().withColumn("_n", F.row_number().over(W.partitionBy("vector").orderBy("id"))).where(F.col("_n") <= k + 1)
    points = materialise(few.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("id"), "ids", "vector"), "points")
    forest = fit(points.select("id", "vector"), trees, leaves, sample)
    if forest is None:
        return spark.createDataFrame([], f"query_id long, rank int, `{key}` long, score double")
    shared = spark.sparkContext.broadcast(forest)  # trees * leaves nodes
    width = forest.normals.shape[2]

    def route(batches):
        for batch in batches:
            vectors = batch.column(2).flatten().to_numpy().reshape(len(batch), width)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(shared.value.leaves(vectors)), pa.list_(pa.int32()))], [*batch.schema.names, "leaves"])

    def paths(batches):
        for batch in batches:
            vectors = batch.column(1).flatten().to_numpy().reshape(len(batch), width)
            got = [shared.value.visits(v, counted, per_query, k + 1) for v in vectors]
            at = np.repeat(np.arange(len(batch)), [len(g) for g in got])
            flat = np.array([x for g in got for x in g], dtype=np.int32).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1]), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))], ["tree", "leaf", "id", "vector"])

    routed = materialise(points.where(F.size("vector") == width).mapInArrow(route, "id long, ids array<long>, vector array<double>, leaves array<int>"), "routed")
    members = routed.select("id", "ids", "vector", F.posexplode("leaves").alias("tree", "leaf"))
    leaves = 1 << forest.depth
    sizes = np.zeros((trees, 1 << forest.depth), dtype=np.int64)
    for r in members.groupBy("tree", "leaf").count().collect():  # at most trees * leaves rows
        sizes[r.tree, r.leaf] = r["count"]
    counted, per_query = sizes, max(least, int(share * sizes[0].sum()))
    asked = usable.where(F.col("_q") & (F.size("vector") == width)).groupBy("id").agg(F.min("vector").alias("vector"))
    visits = asked.mapInArrow(paths, "tree int, leaf int, id long, vector array<double>")
    desks = F.array(*(F.lit(int(max(1, -(-n // crowded)))) for n in sizes.ravel()))[F.col("tree") * leaves + F.col("leaf")] if sizes.max() > crowded else F.lit(1)  # tasks of each leaf
    dealt = members.select("tree", "leaf", F.pmod(F.xxhash64("id"), desks).cast("int").alias("desk"), F.lit(0).alias("kind"), "id", "ids", "vector")
    both = dealt.unionByName(visits.select("tree", "leaf", F.explode(F.sequence(F.lit(0), desks - 1)).alias("desk"), F.lit(1).alias("kind"), "id", F.array("id").alias("ids"), "vector"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = both.repartition(parts, "tree", "leaf", "desk").sortWithinPartitions("tree", "leaf", "desk", "kind").mapInArrow(lambda batches: _rerank(batches, width, k), "query_id long, id long, score double")
    nearest = found.groupBy("query_id", "id").agg(F.min("score").alias("score"))
    order = W.partitionBy("query_id").orderBy("score", "id")
    return nearest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")


class Nearest:
    """The k nearest so far of each query that a task has met; ``drain`` gives and forgets them."""

    def __init__(self, k: int, most: int = 1 << 18):
        self.k, self.most, self.rows, self.held, self.bound = k, most, {}, [], np.zeros(0)
        self.size = 0

    def add(self, queries: np.ndarray, ids: np.ndarray, apart: np.ndarray) -> None:
        """apart: distances, queries by candidates."""
        for q in queries[[q not in self.rows for q in queries.tolist()]].tolist():
            self.rows.setdefault(q, len(self.rows))
        if len(self.bound) < len(self.rows):
            self.bound = np.r_[self.bound, np.full(len(self.rows) - len(self.bound) + 1024, np.inf)]
        row = np.array([self.rows[q] for q in queries.tolist()])
        i, j = np.nonzero((apart <= self.bound[row][:, None]) & (queries[:, None] != ids[None]))
        self.held.append((row[i], queries[i], ids[j], apart[i, j]))
        self.size += len(i)
        if self.size > self.most:
            self._compact()

    def _compact(self) -> None:
        row, query, key, apart = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((apart, key, row))
        row, query, key, apart = row[order], query[order], key[order], apart[order]
        new = np.r_[True, (row[1:] != row[:-1]) | (key[1:] != key[:-1])][: len(row)]  # one place per candidate, though several trees gave it
        row, query, key, apart = row[new], query[new], key[new], apart[new]
        order = np.lexsort((key, apart, row))
        row, query, key, apart = row[order], query[order], key[order], apart[order]
        nth = np.arange(len(row)) - np.maximum.accumulate(np.where(np.r_[True, row[1:] != row[:-1]][: len(row)], np.arange(len(row)), 0))
        self.bound[row[nth == self.k - 1]] = apart[nth == self.k - 1]
        keep = nth < self.k
        self.held, self.size = [(row[keep], query[keep], key[keep], apart[keep])], int(keep.sum())

    def drain(self) -> pa.RecordBatch:
        if self.held:
            self._compact()
        _, query, key, apart = self.held[0] if self.held else (None, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.rows, self.held, self.bound, self.size = {}, [], np.zeros(0), 0
        return pa.RecordBatch.from_arrays([pa.array(query), pa.array(key), pa.array(apart)], ["query_id", "id", "score"])


def _rerank(batches, width: int, k: int, queries_at_once: int = 20_000):
    """Of rows sorted by (tree, leaf, desk, kind): the queries' k nearest among the members of their leaves, measured in double precision."""
    leaf, ids, points, nearest = None, [], [], Nearest(k)
    for batch in batches:
        names = batch.schema.names
        tree, at, desk, kind, key = (batch.column(names.index(x)).to_numpy() for x in ("tree", "leaf", "desk", "kind", "id"))
        vectors = batch.column(names.index("vector")).flatten().to_numpy().reshape(len(batch), width)
        named = batch.column(names.index("ids")).to_pylist()
        place = tree.astype(np.int64) << 48 | at.astype(np.int64) << 28 | desk
        edges = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (kind[1:] != kind[:-1]), True]) if len(batch) else []
        for a, b in zip(edges[:-1], edges[1:]):
            if place[a] != leaf:
                leaf, ids, points = place[a], [], []
            if kind[a] == 0:
                ids += named[a:b]
                points.append(vectors[a:b])
                continue
            if not ids:
                continue
            points = [np.concatenate(points)] if len(points) > 1 else points
            owner = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
            every = np.array([i for x in ids for i in x], dtype=np.int64)
            step = max(1, (1 << 21) // (len(ids) * width))
            for low in range(a, b, step):
                apart = np.sqrt(((vectors[low : min(b, low + step), None] - points[0][None]) ** 2).sum(axis=2))
                nearest.add(key[low : min(b, low + step)], every, apart[:, owner])
        if len(nearest.rows) > queries_at_once:
            yield nearest.drain()
    yield nearest.drain()

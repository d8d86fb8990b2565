"""A written index for nearest neighbours by cosine: lists by coarse centroid, exact reranking of the lists probed.

Centroids are fitted on a bounded sample (spherical k-means on unit vectors); every row is written to the partition of its nearest one. A query
reads the partitions of its nearest centroids only, and ranks their rows by their own vectors. How many it takes is measured
at fitting: the fewest lists that give ``recall`` of the exact neighbours of sampled rows within the sample.

With ``exact``, lists that were not probed are read too where a row in them could still be among the best: no row of a list is farther from its
centroid than the list's radius, which bounds its cosine. So the answer is that of a scan, from the partitions that the bound leaves.

New rows are a segment more under the same centroids; rows whose key comes again, or goes, are listed as overtaken. A list of many rows is several
files, as it is rebalanced when it is written. Null and zero vectors are left out, as their cosine is null.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.search import top_vectors
from tessera.plans.staging import materialise
from tessera.plans.tables import Segments, State

#: Sampled rows; lists at most.
SAMPLE, LISTS = 16384, 1024
#: Rows of a block that meets a block of a quarter as many queries.
BLOCK = 2048


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300)


def cosines(q: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``search.cosine`` of pairs of rows, summed in the same order."""

    def dots(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i))
        for d in range(a.shape[1]):
            out += a[i, d] * b[j, d]
        return out

    every = [np.arange(len(x)) for x in (q, v)]
    aa, bb = dots(v, v, every[1], every[1])[j], dots(q, q, every[0], every[0])[i]
    with np.errstate(all="ignore"):
        product = aa * bb
        norms = np.where((product >= 1e-290) & (product <= 1e290), np.sqrt(product), np.sqrt(aa) * np.sqrt(bb))
        return np.clip(dots(v, q, j, i) / norms, -1, 1)


def spherical_means(points: np.ndarray, n: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """n unit centroids of unit vectors; one that no point is nearest to moves to a point far from its own."""
    rng = np.random.default_rng(seed)
    cents = points[rng.permutation(len(points))[:n]]
    for _ in range(rounds):
        near = points @ cents.T
        at = near.argmax(axis=1)
        sums = np.zeros_like(cents)
        np.add.at(sums, at, points)
        lone = np.flatnonzero(np.bincount(at, minlength=len(cents)) == 0)
        sums[lone] = points[np.argsort(near.max(axis=1), kind="stable")[: len(lone)]]
        cents = unit(sums)
    return cents


def probes_for(points: np.ndarray, cents: np.ndarray, recall: float, k: int = 10, asked: int = 256) -> int:
    """The fewest lists with which ``asked`` of the points find ``recall`` of their k nearest among all points."""
    at = (points @ cents.T).argmax(axis=1)
    queries = np.linspace(0, len(points) - 1, min(asked, len(points))).astype(int)
    k = min(k, len(points) - 1)
    if k < 1:
        return len(cents)
    near = points[queries] @ points.T
    near[np.arange(len(queries)), queries] = -np.inf
    best = np.argsort(-near, axis=1, kind="stable")[:, :k]
    place = np.argsort(np.argsort(-(points[queries] @ cents.T), axis=1, kind="stable"), axis=1)  # of each list in a query's order
    needed = place[np.arange(len(queries))[:, None], at[best]]
    for p in range(1, len(cents)):
        if (needed < p).mean() >= recall:
            return p
    return len(cents)


class VectorIndex:
    """An index at ``root`` (a new one where none is given) over the vectors ``column`` of rows named by ``key``; other columns are kept."""

    def __init__(self, spark: SparkSession, key: str, column: str, root: str | None = None):
        self.spark, self.key, self.column, self.tables = spark, key, column, Segments(spark, root)

    def _usable(self, rows: DataFrame) -> DataFrame:
        own = rows.where(F.col(self.key).isNotNull() & F.col(self.column).isNotNull()).withColumn(self.column, F.col(self.column).cast("array<double>"))
        return own.where(f"exists(`{self.column}`, x -> x <> 0) and not exists(`{self.column}`, x -> x is null or isnan(x) or abs(x) = double('infinity'))")

    def fit(self, rows: DataFrame, lists: int | None = None, recall: float = 0.95) -> State:
        """Centroids from the rows of the smallest hash, about the square root of the number of rows; rows are put in by ``add``."""
        usable, before = self._usable(rows), self.tables.state()
        n, hashed = usable.count(), F.pmod(F.xxhash64(self.key), F.lit(1 << 40))
        near = usable.where(hashed < int((1 << 40) * min(1.0, 1.2 * SAMPLE / max(n, 1))))
        got = near.select(self.key, hashed.alias("_h"), self.column).orderBy("_h", self.key).limit(SAMPLE).select(self.column).toArrow().column(0).to_pylist()
        width = Counter(map(len, got)).most_common(1)[0][0] if got else 0
        points = unit(np.array([v for v in got if len(v) == width], dtype=float).reshape(-1, max(1, width)))
        wanted = max(1, min(LISTS, len(points), lists or int(np.sqrt(max(n, 1)))))
        cents = spherical_means(points, wanted) if len(points) else np.zeros((0, max(1, width)))
        table = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(cents)], "list int, centroid array<double>").coalesce(1)
        return self.tables.commit(before, replaced={"centroids": self.tables.write("centroids", table)}, notes={"probes": probes_for(points, cents, recall) if len(cents) else 0, "width": width})

    def centroids(self, state: State) -> np.ndarray:
        got = sorted(map(tuple, self.tables.read("centroids", state).collect()))  # at most LISTS rows
        return np.array([c for _, c in got], dtype=float).reshape(len(got), max(1, state.notes["width"]))

    def add(self, rows: DataFrame) -> State:
        """Rows put in; those whose key is there already are replaced."""
        before = self.tables.state()
        cents, width, segment = self.centroids(before), before.notes["width"], before.version + 1
        shared = self.spark.sparkContext.broadcast(cents)  # at most LISTS vectors

        def assign(batches):
            for batch in batches:
                vectors = unit(batch.column(batch.schema.names.index("_v")).flatten().to_numpy().reshape(len(batch), width))
                near = vectors @ shared.value.T
                at = near.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at.astype(np.int32)), pa.array(near[np.arange(len(at)), at])], ["row", "list", "_near"])

        usable = self._usable(rows).where(F.size(self.column) == width)
        one = usable.select(F.struct(*usable.columns).alias("row"), F.col(self.column).alias("_v"))
        placed = one.mapInArrow(assign, f"row {one.schema['row'].dataType.simpleString()}, list int, _near double")
        kept = [c for c in usable.columns if c != self.key]
        named = placed.select(F.col("row")[self.key].alias("key"), *(F.col("row")[c].alias(c) for c in kept), F.lit(segment).alias("segment"), "_near", "list")
        entry = self.tables.write("rows", named.hint("rebalance", "list"), by=["list"])
        written = self.tables.read("rows", State(segment, {"rows": entry}))
        appended = {"rows": entry} | self.tables.overtaken("rows", written.select("key").distinct(), before)
        least = {str(r.list): r.near for r in written.groupBy("list").agg(F.min("_near").alias("near")).collect()}  # a row a list
        radii = {i: min(v for v in (least.get(i), before.notes.get("nearest", {}).get(i)) if v is not None) for i in {*least, *before.notes.get("nearest", {})}}
        return self.tables.commit(before, appended=appended, notes={"nearest": radii})

    def remove(self, keys: DataFrame) -> State:
        before = self.tables.state()
        return self.tables.commit(before, appended=self.tables.overtaken("rows", keys.select(F.col(self.key).alias("key")).distinct(), before))

    def in_lists(self, lists: Sequence[int], state: State) -> DataFrame:
        """Rows of some lists; the partitions of others aren't read."""
        rows = self.tables.read("rows", state)
        return self.tables.live("rows", state, rows.where(F.col("list").isin([int(x) for x in lists]))).withColumnRenamed("key", self.key).drop("segment", "_near")

    def probed(self, query: Sequence[float], state: State, probes: int | None = None) -> list[int]:
        """The lists nearest to a query, nearest first; lists without rows are none."""
        cents, near = self.centroids(state), state.notes.get("nearest", {})
        order = np.argsort(-(cents @ unit(np.array(query, dtype=float))), kind="stable") if len(cents) else []
        return [int(i) for i in order if str(int(i)) in near][: probes or state.notes["probes"]]

    def search(self, query: Sequence[float], k: int, probes: int | None = None, exact: bool = False, above: float | None = None) -> DataFrame:
        """The k nearest rows with ``similarity``, of the lists probed, or, with ``exact``, of all."""
        state = self.tables.state()
        lists = self.probed(query, state, probes)
        if exact and lists:
            first = [r.similarity for r in top_vectors(self.in_lists(lists, state), query, k, self.key, self.column).select("similarity").collect()]
            floor = min(first) if len(first) == k else -1.0
            lists += [i for i in self.beyond(query, state, floor) if i not in lists]
        return top_vectors(self.in_lists(lists, state), query, k, self.key, self.column, above=above).drop("list")

    def beyond(self, query: Sequence[float], state: State, floor: float) -> list[int]:
        """Lists in which a row can have a cosine of ``floor`` or more: the angle to the centroid less the list's radius must allow it."""
        near = state.notes.get("nearest", {})
        apart = np.arccos(np.clip(self.centroids(state) @ unit(np.array(query, dtype=float)), -1, 1))
        return [int(i) for i, a in enumerate(apart) if str(i) in near and np.cos(max(0.0, a - np.arccos(np.clip(near[str(i)], -1, 1)))) + 1e-9 >= floor]

    def search_all(self, queries: DataFrame, k: int, query_key: str, query_vector: str, probes: int | None = None) -> DataFrame:
        """query_id, rank, the key and ``similarity`` of the k nearest rows of each query, joined by list."""
        state = self.tables.state()
        shared, taken = self.spark.sparkContext.broadcast(self.centroids(state)), probes or state.notes["probes"]
        width = state.notes["width"]

        def visits(batches):
            for batch in batches:
                vectors = unit(batch.column(1).flatten().to_numpy().reshape(len(batch), width))
                order = np.argsort(-(vectors @ shared.value.T), axis=1, kind="stable")[:, :taken]
                at = pa.array(np.repeat(np.arange(len(batch)), order.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(order.ravel().astype(np.int32))], ["query_id", "q", "list"])

        asked = queries.select(F.col(query_key).cast("long").alias("query_id"), F.col(query_vector).cast("array<double>").alias("q"))
        asked = asked.where(f"size(q) = {width} and exists(q, x -> x <> 0) and not exists(q, x -> x is null or isnan(x))")
        spread = materialise(asked.mapInArrow(visits, "query_id long, q array<double>, list int"), "probes")
        rows = self.tables.live("rows", state).select(F.col("key").alias(self.key), F.col(self.column).alias("_v"), "list")
        key_type, name = rows.schema[self.key].dataType.simpleString(), self.key

        def nearest(batches):
            """The k best rows of each block for each query of the block beside it. Products of whole blocks pick them, with those that rounding can't tell apart; what is ordered is ``cosine`` to the bit."""
            for batch in batches:
                for at in range(len(batch)):
                    (ids, q), (keys, v) = (batch.column(c)[at].values.flatten() for c in (0, 1))
                    q, v = (x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), width) for x in (q, v))
                    near = unit(q) @ unit(v).T
                    floor = np.partition(near, len(v) - k, axis=1)[:, len(v) - k] if len(v) > k else np.full(len(q), -np.inf)
                    i, j = np.nonzero(near >= floor[:, None] - 1e-9)
                    similarity, place = cosines(q, v, i, j), np.argsort(pc.sort_indices(keys).to_numpy())
                    order = np.lexsort((place[j], -similarity, i))
                    i, j, similarity = i[order], j[order], similarity[order]
                    kept = np.arange(len(i)) - np.searchsorted(i, i) < k
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(i[kept])), keys.take(pa.array(j[kept])), pa.array(similarity[kept])], ["query_id", name, "similarity"])

        largest = [max((r.n for r in side.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()), default=0) for side in (spread, rows)]  # a row a list

        def blocks(side: DataFrame, by: str, most: int, size: int, *columns: str) -> DataFrame:
            return side.groupBy("list", F.pmod(F.xxhash64(by), F.lit(1 + most // size)).alias("_b")).agg(F.collect_list(F.struct(*columns)).alias(f"_of_{by}")).drop("_b")

        met = blocks(spread, "query_id", largest[0], BLOCK // 4, "query_id", "q").join(blocks(rows, name, largest[1], BLOCK, name, "_v").hint("merge"), "list").drop("list")
        scored = met.mapInArrow(nearest, f"query_id long, `{name}` {key_type}, similarity double")
        order = W.partitionBy("query_id").orderBy(F.desc("similarity"), self.key)
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", self.key, "similarity")

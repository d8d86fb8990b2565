"""Exact top-k by inner product: every query against every candidate, term at a time.

Vectors lie in blocks of bounded size, which meet in the cells of a grid (``grid``). A pair of a query block and a candidate block is
one unit of work: for each dimension (a term) the candidates with a weight there are its
postings; each query with a weight in that term scatters the product of weights into its row of
a dense array of scores. A cell keeps the k best of each of its queries over all candidates that pass, so only scores that reach
the k-th so far are looked at, and the lists of the cells are merged by rank.

Defined results: a vector that is null or holds a null or non-finite component takes no part, as
query or candidate; vectors of different lengths are compared on none of each other (no score).
A query meets every row but those with its own id, so an id that occurs twice is two candidates; equal scores go by smaller id. A query id
that occurs twice is answered once, by its first vector in order of components. Extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm import grid
from tessera.plans.staging import materialise

#: Rows of a block: of candidates, of queries.
CANDIDATES, QUERIES = 4096, 512
#: Candidates whose scores with a block of queries stay in a core's cache.
STRIPE = 128
#: Whole numbers of vectors, in the first type that holds a block's.
_KINDS = ("<i2", "<i4", "<i8")
_BLOCK = "block long, width int, kind int, ids binary, vectors binary"


def blocks(rows: DataFrame, most: int) -> DataFrame:
    """Rows (id long, vector array<long>) in blocks of one width and at most ``most`` rows."""

    def run(batches):
        task, made, kept = TaskContext.get().partitionId(), 0, {}

        def out(width):
            nonlocal made
            ids, vectors = kept.pop(width)
            vectors = np.array(vectors, dtype="<i8")
            made, kind = made + 1, next(i for i, t in enumerate(_KINDS) if np.iinfo(t).min <= vectors.min(initial=0) and vectors.max(initial=0) <= np.iinfo(t).max)
            row = [(task << 32) + made, width, kind, np.array(ids, dtype="<i8").tobytes(), vectors.astype(_KINDS[kind]).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["block", "width", "kind", "ids", "vectors"])

        for batch in batches:
            vectors = batch.column(1)
            flat = vectors.flatten().to_numpy()
            ends = np.cumsum([0, *vectors.value_lengths().to_pylist()])
            for i, key in enumerate(batch.column(0).to_pylist()):
                width = int(ends[i + 1] - ends[i])
                ids, held = kept.setdefault(width, ([], []))
                ids.append(key), held.append(flat[ends[i] : ends[i + 1]])
                if len(ids) == most:
                    yield out(width)
        for width in list(kept):
            yield out(width)

    return rows.mapInArrow(run, _BLOCK)


def postings(held: np.ndarray) -> list[list[tuple[np.ndarray | None, np.ndarray]]]:
    """Of stripes of STRIPE candidates: for each term the candidates that have it, and their weights; None: nearly all have it, and all are listed."""
    out = []
    for low in range(0, len(held), STRIPE):
        part = held[low : low + STRIPE]
        lists = ((np.flatnonzero(part[:, t]), np.ascontiguousarray(part[:, t])[:, None]) for t in range(held.shape[1]))
        out.append([(None, weight) if 4 * len(where) >= 3 * len(part) else (where, weight[where]) for where, weight in lists])
    return out


def accumulate(queries: np.ndarray, stripes: list[list[tuple[np.ndarray | None, np.ndarray]]], n: int) -> np.ndarray:
    """Scores (candidates by queries), a stripe and one term after another: each posting adds its weight times that of every query of the block to its row."""
    weights = np.ascontiguousarray(queries.T)
    asked = np.flatnonzero(weights.any(axis=1))
    scores = np.zeros((n, len(queries)), dtype=queries.dtype)
    rows, products = np.empty((STRIPE, len(queries)), dtype=queries.dtype), np.empty((STRIPE, len(queries)), dtype=queries.dtype)  # used again and again, so that no memory is asked for
    for k, terms in enumerate(stripes):
        own = scores[k * STRIPE : (k + 1) * STRIPE]
        for t in asked:
            where, weight = terms[t]
            if where is None:
                own += np.multiply(weight, weights[t], out=products[: len(own)])
            elif len(where):
                row, product = rows[: len(where)], products[: len(where)]
                np.take(own, where, axis=0, out=row, mode="clip")
                np.multiply(weight, weights[t], out=product)
                row += product
                own[where] = row
    return scores


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k highest scores, equal ones by smaller id, without those of the id ``own``."""
    there = np.flatnonzero(ids != own)
    if len(there) > k:
        least = -np.partition(-scores[there], k - 1)[k - 1]
        above, level = there[scores[there] > least], there[scores[there] == least]
        if len(level) > k - len(above):
            level = level[np.argpartition(ids[level], k - len(above) - 1)[: k - len(above)]]
        there = np.concatenate([above, level])
    return there[np.lexsort((ids[there], -scores[there]))]


class Lists:
    """The k best candidates that each query of a block has met."""

    def __init__(self, row: dict, k: int):
        self.own = np.frombuffer(row["ids"], dtype="<i8")
        self.vectors = np.frombuffer(row["vectors"], dtype=_KINDS[row["kind"]]).reshape(len(self.own), row["width"])
        self.most, self.k = float(np.abs(self.vectors.astype(float)).max(initial=0)), k
        self.query, self.ids, self.scores = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.least = np.full(len(self.own), np.iinfo(np.int64).min)

    def meet(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """Takes candidates with their scores (candidates by queries): those that reach a query's k-th best score are merged with its list, a crowd of them once it is cut to k."""
        hit = scores >= self.least.astype(scores.dtype)
        crowded = np.flatnonzero(hit.sum(axis=0) > 4 * self.k)
        hit[:, crowded] = False
        at, query = np.nonzero(hit)
        other = ids[at] != self.own[query]
        found = [(query[other], at[other])]
        for q in crowded:
            some = best(np.ascontiguousarray(scores[:, q]), ids, self.own[q], self.k)
            found.append((np.full(len(some), q), some))
        query, at = (np.concatenate(x) for x in zip(*found))
        if not len(at):
            return
        query, scores, ids = np.concatenate([self.query, query.astype(np.int32)]), np.concatenate([self.scores, scores[at, query].astype(np.int64)]), np.concatenate([self.ids, ids[at]])
        order = np.lexsort((ids, ~scores, query))  # ~ turns the order round without leaving 64 bits
        edge = np.searchsorted(query[order], np.arange(len(self.own) + 1))
        nth = np.arange(len(order)) - edge[query[order]]
        order = order[nth < self.k]
        self.query, self.scores, self.ids = query[order], scores[order], ids[order]
        full = np.flatnonzero(np.diff(edge) >= self.k)
        last = np.searchsorted(self.query, full, side="right") - 1
        self.least[full] = self.scores[last]

    def out(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.own[self.query]), pa.array(self.ids), pa.array(self.scores)], ["query_id", "id", "score"])


def search(rows: DataFrame, is_query: Column, k: int, key: str, vector: str) -> DataFrame:
    """query_id, rank (from 1), ``key`` and score of the k best candidates of each row that ``is_query`` marks.

    ``vector`` is an array of whole numbers."""
    usable = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<long>").alias("vector"), is_query.alias("_q")).where("id is not null and vector is not null and not exists(vector, x -> x is null)")
    asked = usable.where("_q").groupBy("id").agg(F.min("vector").alias("vector"))
    held = materialise(blocks(usable.select("id", "vector"), CANDIDATES), "candidate-blocks")
    asked = materialise(blocks(asked, QUERIES), "query-blocks")

    def find(queries, rows):
        by_width = {}
        for query in queries:
            by_width.setdefault(query["width"], []).append(Lists(query, k))
        for row in rows:
            ids, width, stripes = np.frombuffer(row["ids"], dtype="<i8"), row["width"], {}
            vectors = np.frombuffer(row["vectors"], dtype=_KINDS[row["kind"]]).reshape(len(ids), width)
            high = float(np.abs(vectors.astype(float)).max(initial=0))
            for lists in by_width.get(width, ()):
                most = high * lists.most * width
                kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64  # sums of whole numbers below these are exact
                if kind not in stripes:
                    stripes[kind] = postings(vectors.astype(kind))
                lists.meet(ids, accumulate(lists.vectors.astype(kind), stripes[kind], len(ids)))
        for lists in chain.from_iterable(by_width.values()):
            yield lists.out()

    found = grid.scan(held, asked, find, "query_id long, id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")

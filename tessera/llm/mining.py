"""Hard negatives: product quantisation with stored residual norms, then exact whole-number scores.

Each pair of components is a subspace with its own codebook, fitted on a bounded sample; a row is stored as
one code a subspace and the length r of what the codes leave of it. An anchor turns the codebooks
into tables of partial scores, so a row's score by its codes is a sum of lookups, and its true score
lies within |anchor| * r of that. Only rows whose interval can still reach a list are scored exactly, on their
whole numbers; so lists are exact whatever the codebooks are. First each anchor's best rows of its own label are found
(its positives); then, for every positive, the best rows of other labels in the window that its score sets.

Blocks of bounded size hold rows sorted by label; each block meets all anchors, which come in blocks too, in the cells of a grid (``grid``). A block gives at most ``positives`` (``negatives``) rows for each list, which are then merged by rank.

Defined results: a row takes no part if its id, label or vector is null or a component is null.
Vectors of different lengths have no score. A row never meets its own id; an id that occurs twice is two
candidates, and answered once, by its first (label, vector) in order. Equal scores go by smaller id. A positive whose score is negative
has an empty window. Scores have to fit 64 bits. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm import grid
from tessera.plans.staging import materialise

#: Components of a subspace; codes of a codebook (one byte).
SPAN, CODES = 2, 256
#: Rows of a block at least and at most; anchors of a block.
LEAST, MOST, ANCHORS = 4096, 32768, 512
_KINDS = ("<i2", "<i8")
_BLOCK = "block long, width int, kind int, n int, ids binary, names array<string>, ends array<int>, codes binary, rest binary, vectors binary"
_ANCHORS = "block long, width int, n int, ids binary, names array<string>, vectors binary, lists array<array<long>>"


@dataclass(frozen=True)
class Codebooks:
    """Centroids (subspaces, CODES, SPAN) for vectors of one width; a last subspace that is short is filled with zeros."""

    width: int
    centroids: np.ndarray

    def parts(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors cut into subspaces (subspaces, rows, SPAN)."""
        subs = len(self.centroids)
        filled = np.zeros((len(vectors), subs * SPAN))
        filled[:, : vectors.shape[1]] = vectors
        return filled.reshape(len(vectors), subs, SPAN).transpose(1, 0, 2)

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (subspaces, rows) and the length of what they leave, rounded up."""
        parts = self.parts(vectors)
        codes = np.empty(parts.shape[:2], dtype=np.uint8)
        left = np.zeros(len(vectors))
        for s, (part, cents) in enumerate(zip(parts, self.centroids)):
            codes[s] = ((cents**2).sum(axis=1)[None] - 2 * part @ cents.T).argmin(axis=1)
            left += ((part - cents[codes[s]]) ** 2).sum(axis=1)
        return codes, np.sqrt(left) * (1 + 1e-9)

    def lookup(self, vector: np.ndarray) -> np.ndarray:
        """Partial scores of an anchor with every centroid (subspaces, CODES)."""
        return np.einsum("sk,sck->sc", self.parts(vector[None])[:, 0], self.centroids)


def centroids(points: np.ndarray, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Lloyd's k-means with CODES centroids, from distinct points."""
    distinct = np.unique(points, axis=0)
    out = np.zeros((CODES, points.shape[1]))
    n = min(CODES, len(distinct))
    out[:n] = distinct[np.random.default_rng(seed).permutation(len(distinct))[:n]]
    for _ in range(rounds):
        near = ((out[:n] ** 2).sum(axis=1)[None] - 2 * points @ out[:n].T).argmin(axis=1)
        held = np.bincount(near, minlength=n)[:n]
        total = np.stack([np.bincount(near, weights=points[:, d], minlength=n)[:n] for d in range(points.shape[1])], axis=1)
        out[:n][held > 0] = total[held > 0] / held[held > 0][:, None]
    return out


def fit(rows: DataFrame, sample: int = 8192) -> Codebooks:
    """Codebooks of the width that is most frequent in a sample: the ``sample`` rows (id, vector array<long>) of smallest hash. A task fits a subspace."""
    spark, n = rows.sparkSession, rows.count()
    hashed = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    taken = materialise(rows.where(hashed < int((1 << 40) * min(1.0, 1.2 * sample / max(n, 1)))).orderBy(hashed, "id").limit(sample).select(F.size("vector").alias("width"), "vector"), "codebook-sample")
    widths = taken.groupBy("width").count().orderBy(F.desc("count"), "width").limit(1).collect()
    width = widths[0].width if widths else 0
    subs = -(-width // SPAN)
    if not subs:
        return Codebooks(width, np.zeros((0, CODES, SPAN)))
    pieces = F.transform(F.sequence(F.lit(0), F.lit(subs - 1)), lambda s: F.slice("vector", s * SPAN + 1, SPAN))
    points = taken.where(F.col("width") == width).select(F.posexplode(pieces).alias("sub", "part"))

    def of(group: pd.DataFrame) -> pd.DataFrame:
        part = np.zeros((len(group), SPAN))
        for d in range(SPAN):
            part[:, d] = [float(p[d]) if len(p) > d else 0.0 for p in group["part"]]
        return pd.DataFrame({"sub": [int(group["sub"].iloc[0])], "flat": [centroids(part).ravel()]})

    got = sorted(points.groupBy("sub").applyInPandas(of, "sub int, flat array<double>").collect())  # a row of CODES * SPAN numbers for each subspace
    return Codebooks(width, np.array([r.flat for r in got]).reshape(subs, CODES, SPAN))


def _whole(vectors: np.ndarray) -> int:
    """The place in _KINDS of the smallest type that holds the numbers."""
    return int(len(vectors) > 0 and (vectors.min(initial=0) < -(1 << 15) or vectors.max(initial=0) >= 1 << 15))


def _books(books: Codebooks, width: int) -> Codebooks:
    """Vectors of a width without codebooks are coded as zeros: all of them is rest, and the bounds still hold."""
    return books if width == books.width else Codebooks(width, np.zeros((-(-width // SPAN), CODES, SPAN)))


def blocks(rows: DataFrame, books: Codebooks, most: int) -> DataFrame:
    """Rows (id long, label string, vector array<long>) coded, in blocks of one width and at most ``most`` rows sorted by label."""
    names = [x.split()[0] for x in _BLOCK.split(", ")]

    def run(batches):
        task, made, kept = TaskContext.get().partitionId(), 0, {}

        def out(width):
            nonlocal made
            ids, labels, vectors = (np.concatenate(x) for x in kept.pop(width)[1:])
            order = np.argsort(labels, kind="stable")
            ids, labels, vectors = ids[order], labels[order], vectors[order]
            starts = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1]])
            codes, rest = _books(books, width).encode(vectors.astype(float))
            made, kind = made + 1, _whole(vectors)
            row = [(task << 32) + made, width, kind, len(ids), ids.astype("<i8").tobytes(), labels[starts].tolist(), [*starts[1:].tolist(), len(ids)], codes.tobytes(), rest.astype("<f8").tobytes(), vectors.astype(_KINDS[kind]).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()))], names)

        for batch in batches:
            ids, labels = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), dtype=object)
            widths = batch.column(2).value_lengths().to_numpy()
            flat, ends = batch.column(2).flatten().to_numpy(), np.cumsum(widths)
            for width in np.unique(widths).tolist():
                at = np.flatnonzero(widths == width)
                for low in range(0, len(at), most):
                    some = at[low : low + most]
                    vectors = flat[(ends[some] - width)[:, None] + np.arange(width)].reshape(len(some), width)
                    held = kept.setdefault(width, [0, [], [], []])
                    held[0] += len(some)
                    for to, x in zip(held[1:], (ids[some], labels[some], vectors)):
                        to.append(x)
                    if held[0] >= most:
                        yield out(width)
        for width in list(kept):
            yield out(width)

    return rows.mapInArrow(run, _BLOCK)


def anchor_blocks(rows: DataFrame, most: int = ANCHORS) -> DataFrame:
    """Anchors (id, label, vector, list: scores of the positives by rank) in blocks of one width."""
    names = [x.split()[0] for x in _ANCHORS.split(", ")]

    def run(batches):
        task, made, kept = TaskContext.get().partitionId(), 0, {}

        def out(width):
            nonlocal made
            made += 1
            ids, labels, vectors, lists = zip(*kept.pop(width))
            row = [(task << 32) + made, width, len(ids), np.array(ids, dtype="<i8").tobytes(), list(labels), np.array(vectors, dtype="<i8").tobytes(), list(lists)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.list_(pa.list_(pa.int64()))))], names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                kept.setdefault(len(row[2]), []).append(row)
                if len(kept[len(row[2])]) == most:
                    yield out(len(row[2]))
        for width in list(kept):
            yield out(width)

    return rows.select("id", "label", "vector", "list").mapInArrow(run, _ANCHORS)


class Block:
    """A block of coded rows in a task."""

    def __init__(self, row: dict, books: Codebooks):
        self.n, self.width = row["n"], row["width"]
        self.books = _books(books, self.width)
        self.ids = np.frombuffer(row["ids"], dtype="<i8")
        self.codes = np.frombuffer(row["codes"], dtype=np.uint8).reshape(-1, self.n)
        self.rest = np.frombuffer(row["rest"], dtype="<f8")
        self.vectors = np.frombuffer(row["vectors"], dtype=_KINDS[row["kind"]]).reshape(self.n, self.width)
        self.reach = float(np.abs(self.vectors.astype(float)).sum(axis=1).max(initial=0))
        self.runs = dict(zip(row["names"], zip([0, *row["ends"][:-1]], row["ends"])))

    def bounds(self, vector: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score of the rows low to high with an anchor: sums of lookups, less and plus the residual bound and what rounding can add."""
        tables = self.books.lookup(vector.astype(float))
        by_code = np.zeros(high - low)
        for table, codes in zip(tables, self.codes[:, low:high]):
            by_code += table[codes]
        size = float(np.abs(vector.astype(float)).max(initial=0))
        wide = float(np.linalg.norm(vector.astype(float))) * (1 + 1e-9) * self.rest[low:high] + 1e-12 * size * (self.reach + 2 * float(self.rest.max(initial=0)) * self.width) + 1e-9
        return by_code - wide, by_code + wide

    def exact(self, vector: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.vectors[at].astype(np.int64) @ vector


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, equal ones by smaller id."""
    return np.lexsort((ids, -scores))[:k]


def _kth(values: np.ndarray, k: int) -> float:
    """The k-th greatest value; minus infinity if there are fewer."""
    return -np.inf if len(values) < k else float(-np.partition(-values, k - 1)[k - 1])


def positives_in(block: Block, own: int, label: str, vector: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the block's k best rows of the anchor's label."""
    low, high = block.runs.get(label, (0, 0))
    if low == high:
        return block.ids[:0], block.ids[:0]
    least, most = block.bounds(vector, low, high)
    other = block.ids[low:high] != own
    at = low + np.flatnonzero(other & (most >= _kth(least[other], k)))
    scores = block.exact(vector, at)
    take = _best(scores, block.ids[at], k)
    return block.ids[at[take]], scores[take]


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """Whole numbers s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def negatives_in(block: Block, own: int, label: str, vector: np.ndarray, scores: list[int], k: int, low: int, high: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each positive's score with rows in its window: (its place, ids, scores) of the block's k best rows of other labels."""
    least, most = block.bounds(vector, 0, block.n)
    other = block.ids != own
    start, end = block.runs.get(label, (0, 0))
    other[start:end] = False
    wanted, windows = np.zeros(block.n, dtype=bool), []
    for place, score in enumerate(scores):
        bottom, top = window(score, low, high)
        if bottom > top:
            continue
        may = other & (most >= bottom) & (least <= top)
        sure = may & (least >= bottom) & (most <= top)
        may &= most >= _kth(least[sure], k)
        wanted |= may
        windows.append((place, bottom, top, may))
    at = np.flatnonzero(wanted)
    exact = block.exact(vector, at)
    out = []
    for place, bottom, top, may in windows:
        some = np.flatnonzero(may[at] & (exact >= bottom) & (exact <= top))
        if len(some):
            take = some[_best(exact[some], block.ids[at[some]], k)]
            out.append((place, block.ids[at[take]], exact[take]))
    return out


def _scan(held: DataFrame, anchors: DataFrame, books: Codebooks, find) -> DataFrame:
    """anchor_id, place, id, score of what ``find(block, own, label, vector, list)`` yields for each anchor and block."""

    def meet(asked, rows):
        known = [(x["width"], np.frombuffer(x["ids"], dtype="<i8"), x["names"], np.frombuffer(x["vectors"], dtype="<i8").reshape(x["n"], x["width"]), x["lists"]) for x in asked]
        for row in rows:
            block = Block(row, books)
            for width, ids, names, vectors, lists in known:
                if width != block.width:
                    continue
                out = [(own, place, found, scores) for own, label, vector, list_ in zip(ids.tolist(), names, vectors, lists) for place, found, scores in find(block, own, label, vector, list_)]
                n = [len(x[2]) for x in out]
                columns = [np.repeat(np.array([x[0] for x in out], dtype=np.int64), n), np.repeat(np.array([x[1] for x in out], dtype=np.int32), n)] + [np.concatenate([x[j] for x in out] or [ids[:0]]) for j in (2, 3)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor_id", "place", "id", "score"])

    return grid.scan(held, anchors, meet, "anchor_id long, place int, id long, score long")


def mine(rows: DataFrame, is_anchor: Column, key: str, label: str, vector: str, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    ``vector`` is an array of whole numbers; a negative's score is ``low`` to ``high`` percent of its positive's."""
    spark = rows.sparkSession
    usable = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<long>").alias("vector"), is_anchor.alias("_a"))
    usable = materialise(usable.where("id is not null and label is not null and size(vector) > 0 and not exists(vector, x -> x is null)"), "mining-rows")
    n = usable.count()
    books = fit(usable.select("id", "vector"))
    most = max(LEAST, min(MOST, n // (3 * spark.sparkContext.defaultParallelism)))
    held = materialise(blocks(usable.select("id", "label", "vector"), books, most), "coded-blocks")
    anchors = usable.where("_a").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("x")).select("id", "x.*")
    first = anchor_blocks(anchors.withColumn("list", F.array().cast("array<long>")))
    order = W.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    found = _scan(held, materialise(first, "anchors"), books, lambda block, own, name, v, _: [(0, *positives_in(block, own, name, v, positives))])
    best = materialise(found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives).select("anchor_id", "place", "id", "score"), "positives")
    known = best.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("place", "score"))).alias("l")).select(F.col("anchor_id").alias("id"), F.col("l.score").alias("list"))
    second = materialise(anchor_blocks(anchors.join(known, "id")), "anchors-with-positives")
    found = _scan(held, second, books, lambda block, own, name, v, scores: negatives_in(block, own, name, v, scores, negatives, low, high))
    order = W.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).withColumn("place", F.col("place") + 1)
    named = best.select("anchor_id", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return ranked.join(named, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

"""Quality scores from compression against dictionaries of good and of bad text.

Two zstandard dictionaries are trained, one on text labelled good and one on text labelled bad. A text is cut into pieces of ``PIECE``
bytes, each compressed by itself with either, so that only the dictionaries can make it shorter and not what it says twice. How much
shorter the good dictionary makes all pieces, divided by the text's length, is the evidence, and the only one. A logistic curve
turns this normalised difference into a probability. It is fitted on labelled rows that trained neither dictionary. The range in which good and bad rows
overlap, from what all but ``TAIL`` of the good rows reach to what all but that share of the bad ones stay under, decides: the farther from its middle, the
less more of it says (u / (1 + |u|)), so rows stay in the order of their differences.

Fitting reads a bounded sample: at most ``max_per_class`` labelled rows of each class, chosen
by a hash of the id, of texts up to ``max_fit_bytes`` bytes; dictionaries are trained on pieces of these
whole texts. Scoring reads every whole text.

Defined results: a null text counts as empty; an empty text gets the score of the prior; a
label other than 0 or 1, or a null one, is no label; an id labelled twice counts once for each
different label; with fewer than four usable rows of either class every score is the share of
good labels (0.5 without labels). Equal rows get equal scores, each its own; a kept column named score is replaced; extra columns are
ignored and an empty table gives no rows. Texts are read and compressed whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.staging import bound_batches

LEVEL = 3
#: Bytes of a piece that is compressed by itself; the share of good rows below the range that decides, and of bad ones above it.
PIECE, TAIL = 256, 0.01


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    low: float
    high: float
    prior: float


class Scorer:
    """A model with its compressors, for one Python process."""

    def __init__(self, model: QualityModel):
        self.model = model
        self.pair = [_compressor(d) for d in (model.good, model.bad)] if model.good else None

    def sizes(self, text: bytes) -> tuple[int, int, int]:
        return _sizes(self.pair, text)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        m = self.model
        if not self.pair or not texts:
            return np.full(len(texts), m.prior)
        sizes = np.array([self.sizes(t) for t in texts], dtype=float)
        out = 1 / (1 + np.exp(-evidence(sizes, m.low, m.high) @ np.array(m.weights)))
        out[sizes[:, 2] == 0] = m.prior
        return out


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    kept = zstandard.ZstdCompressionDict(dictionary)
    kept.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=kept, write_checksum=False, write_content_size=False)


def _sizes(pair: list[zstandard.ZstdCompressor], text: bytes) -> tuple[int, int, int]:
    """Bytes of the text's pieces compressed with the good and with the bad dictionary, and as they are."""
    pieces = [text[at : at + PIECE] for at in range(0, len(text), PIECE)]
    good, bad = (sum(len(c.compress(p)) for p in pieces) for c in pair)
    return good, bad, len(text)


def difference(sizes: np.ndarray) -> np.ndarray:
    """The normalised difference of rows (size with the good, with the bad dictionary, bytes)."""
    good, bad, n = sizes.T
    return (bad - good) / np.maximum(n, 1)


def evidence(sizes: np.ndarray, low: float, high: float) -> np.ndarray:
    """Of each row the constant and the difference, from -1 to 1 and steepest between low and high."""
    u = (2 * difference(sizes) - low - high) / (high - low)
    return np.stack([np.ones(len(sizes)), u / (1 + np.abs(u))], axis=1)


def labelled_sample(docs: DataFrame, labels: DataFrame, max_per_class: int, max_fit_bytes: int, text: str = "text", key: str = "doc_id", label: str = "quality") -> dict[int, list[bytes]]:
    """The texts, up to ``max_fit_bytes`` long, of the ``max_per_class`` ids of each label with the smallest hash: a bounded sample."""
    marked = labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y")).where("_y in (0, 1) and _k is not null").distinct()
    marked = marked.withColumn("_h", F.pmod(F.xxhash64("_k"), F.lit(1 << 40)))
    number = {r._y: r.n for r in marked.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    # few more than are asked for go to one task
    near = {y: int((1 << 40) * min(1.0, (1.3 * max_per_class + 50) / max(number.get(y, 0), 1))) for y in (0, 1)}
    chosen = [marked.where((F.col("_y") == y) & (F.col("_h") < near[y])).orderBy("_h", "_k").limit(max_per_class).select("_k", "_y") for y in (0, 1)]
    own = docs.select(F.col(key).alias("_k"), F.col(text).cast("binary").alias("_t")).where(F.col("_t").isNotNull() & F.octet_length("_t").between(1, max_fit_bytes))
    found = own.join(F.broadcast(chosen[0].union(chosen[1])), "_k").collect()  # the broadcast side is 2 * max_per_class ids
    found.sort(key=lambda r: (r._k, r._t))
    return {y: [bytes(r._t) for r in found if r._y == y] for y in (0, 1)}


def fit(docs: DataFrame, labels: DataFrame, max_per_class: int = 1500, max_fit_bytes: int = 16384, dictionary_bytes: int = 400_000, piece_bytes: int = 2048, text: str = "text", key: str = "doc_id", label: str = "quality") -> QualityModel:
    """Fit on the labelled rows of ``docs``; see the module for the bounded sample."""
    counts = {r._y: r.n for r in labels.select(F.col(label).cast("int").alias("_y")).where("_y in (0, 1)").groupBy("_y").agg(F.count("*").alias("n")).collect()}
    return fit_texts(labelled_sample(docs, labels, max_per_class, max_fit_bytes, text, key, label), counts, dictionary_bytes, piece_bytes)


def fit_texts(sample: dict[int, list[bytes]], counts: dict[int, int], dictionary_bytes: int = 400_000, piece_bytes: int = 2048) -> QualityModel:
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    if min(len(sample.get(0, ())), len(sample.get(1, ()))) < 4:
        return QualityModel(b"", b"", (), 0.0, 0.0, prior)
    trained, held = {}, {}
    for y, texts in sample.items():
        texts = [t for k in range(10) for t in texts[k::10]]  # what trains and what calibrates spans the whole sample
        half = min(len(texts) - 1, -(-len(texts) * 7 // 10))
        trained[y] = _dictionary([t[at : at + piece_bytes] for t in texts[:half] for at in range(0, len(t), piece_bytes)], dictionary_bytes)
        held[y] = texts[half:]
    pair = [_compressor(trained[1]), _compressor(trained[0])]
    sizes = np.array([_sizes(pair, t) for y in (0, 1) for t in held[y]], dtype=float)
    y = np.repeat([0.0, 1.0], [len(held[0]), len(held[1])])
    weight = np.where(y == 1, counts.get(1, 1) / len(held[1]), counts.get(0, 1) / len(held[0]))
    apart = difference(sizes)
    low, high = sorted((np.quantile(apart[y == 1], TAIL), np.quantile(apart[y == 0], 1 - TAIL)))
    low, high = float(low), float(max(high, low + 1e-6))
    return QualityModel(trained[1], trained[0], tuple(_logistic(evidence(sizes, low, high), y, weight * len(y) / weight.sum())), low, high, prior)


def _dictionary(pieces: list[bytes], most: int) -> bytes:
    try:
        return zstandard.train_dictionary(most, pieces).as_bytes()
    except zstandard.ZstdError:  # too few or too small samples to train on: the text itself serves
        return b"".join(pieces)[:most] or b"\0"


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if math.isclose(np.abs(step).max(), 0, abs_tol=1e-9):
            break
    return w


def score(docs: DataFrame, model: QualityModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the score (0 to 1) of every row's whole text."""
    spark = docs.sparkSession
    bound_batches(spark)
    keep = tuple(c for c in keep if c != "score")
    shared = spark.sparkContext.broadcast(model)  # two dictionaries of at most dictionary_bytes
    kept = docs.select(*keep, F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_t"))

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            names = batch.schema.names
            texts = [t.as_py() for t in batch.column(len(names) - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scorer.scores(texts), pa.float64())], [*names[:-1], "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{fields}, score double")

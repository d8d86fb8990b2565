"""Model calls on batches of texts of like length, so that little is padded; rows come back as they stood.

A task gathers a window of its rows, sorts it by size rounded up to a step, and cuts it where a batch padded to its longest text would exceed a budget, or has enough texts.
If a batch fails its texts are tried one by one; one that fails alone has no result and an error. Empty texts are never sent.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.plans.staging import spread


def cut_by_size(sizes: Sequence[int], budget: int, step: int, most: int) -> list[list[int]]:
    """Places of texts in batches of like size: the sizes, rounded up to ``step``, of no batch padded to its largest sum to over ``budget``, if it has more than one."""
    out: list[list[int]] = []
    for i in sorted((i for i, n in enumerate(sizes) if n), key=lambda i: (sizes[i], i)):
        padded = -(-sizes[i] // step) * step
        if out and len(out[-1]) < most and padded * (len(out[-1]) + 1) <= budget:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def called(texts: list[str], model: Callable[[list[str]], Sequence]) -> list[tuple[object, str | None]]:
    """(result, error) of each text."""
    try:
        got = list(model(texts))
        if len(got) == len(texts):
            return [(x, None) for x in got]
        error: Exception = ValueError(f"{len(got)} results for {len(texts)} texts")
    except Exception as e:  # a batch that fails is tried text by text
        error = e
    if len(texts) == 1:
        return [(None, f"{type(error).__name__}: {error}")]
    return [called([t], model)[0] for t in texts]


def batched(
    rows: DataFrame, text: str, model: Callable[[list[str]], Sequence], keep: Sequence[str], kind: str = "string", size: Callable[[str], int] = len, budget: int = 1 << 16, step: int = 64, most: int = 512, window: int = 8192
) -> DataFrame:
    """``keep``, ``result`` (of Spark type ``kind``), ``error`` and ``padded``: the size a text was brought to in its batch (null for empty ones, whose result is null)."""
    kept = rows.select(*keep, text)
    kinds = rows.sparkSession.createDataFrame([], f"result {kind}").toArrow().schema.field("result").type

    def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        texts = [t or "" for t in whole.column(len(keep)).to_pylist()]
        sizes = [size(t) if t else 0 for t in texts]
        results: list = [None] * len(texts)
        errors: list[str | None] = [None] * len(texts)
        padded: list[int | None] = [None] * len(texts)
        for places in cut_by_size(sizes, budget, step, most):
            longest = -(-max(sizes[i] for i in places) // step) * step
            for i, (result, error) in zip(places, called([texts[i] for i in places], model)):
                results[i], errors[i], padded[i] = result, error, longest
        columns = [c.combine_chunks() for c in whole.columns[: len(keep)]]
        return pa.RecordBatch.from_arrays([*columns, pa.array(results, kinds), pa.array(errors, pa.string()), pa.array(padded, pa.int32())], [*keep, "result", "error", "padded"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= window:
                yield out(held)
                held = []
        if held:
            yield out(held)

    fields = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keep)
    return spread(kept).mapInArrow(run, f"{fields}result {kind}, error string, padded int")

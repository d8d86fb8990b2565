"""Exact removal of repeated byte strings, by suffix arrays over shards.

Every byte covered by a string of ``length`` bytes that also starts anywhere else (in the same or
another text) is removed. A string and its repeats must meet in one shard, so windows of ``length``
bytes are dealt out by content:

1. The anchor of a window is its leftmost least hash of ``GRAM`` bytes. Windows in a row with the same
   anchor form a segment, about one per 85 bytes; its key is the hash of the anchor. Equal windows have
   equal keys.
2. Segments with equal key and content are repeats of each other in whole, and stand as one from here on.
   Keys with a single segment hold no repeat.
3. Of the other keys, one copy of each different segment is cut by the anchor's place in the window into
   parts whose windows all hold the same ``length`` - ``CLASS`` bytes around the anchor; the hash of
   these deals parts to shards, so that a common line draws only what also agrees around it.
4. A shard's parts are laid end to end. Its suffix array is made by induced sorting; a window
   whose suffix shares ``length`` bytes with a neighbour in that order (permuted common prefixes) repeats.
5. The repeats go back to all copies of their segments and are merged by document.

Defined results: a null text is empty. Rows with the same id and text are separate copies, and so
repeats of each other; rows with the same id and different texts are separate documents. Extra
columns pass through, but for those named as the results, which these replace; an empty table gives no rows. Texts are read
whole, half a million windows at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.suffix import common_prefixes, suffix_array
from tessera.plans.staging import materialise, release

GRAM, CLASS = 32, 28
#: Windows that are looked at together, of one text; bytes that are sorted together, if one shard's part is not longer.
AT_ONCE, SORTED = 1 << 19, 1 << 19
#: Ids up to which documents are picked by a broadcast.
BROADCAST_IDS = 2_000_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BYTE = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 to the 64."""
    base, inverse = int(_M1), pow(int(_M1), -1, 1 << 64)
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n - 1, np.uint64(x))], dtype=np.uint64) for x in (base, inverse))


class Segmenter:
    """Cuts the windows of texts into segments by their anchors."""

    def __init__(self, length: int):
        self.length, self.width = length, length - GRAM + 1
        self.up, self.down = _powers(AT_ONCE + 2 * length)

    def segments(self, text: bytes) -> tuple[np.ndarray, ...]:
        """Key, content hash, first and last window start, and anchor of each segment."""
        n = len(text) - self.length + 1
        if n <= 0:
            return tuple(np.zeros(0, dtype=t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
        out = [self._part(text[low : low + AT_ONCE + self.length - 1], low) for low in range(0, n, AT_ONCE)]
        return tuple(np.concatenate(x) for x in zip(*out))

    def _part(self, text: bytes, low: int):
        data, w = np.frombuffer(text, dtype=np.uint8), self.width
        windows, grams = len(text) - self.length + 1, len(text) - GRAM + 1
        eight = np.ndarray((len(text) - 7,), dtype="<u8", buffer=text, strides=(1,)).astype(np.uint64)
        with np.errstate(over="ignore"):
            x = eight[:grams] * _M1
            for j in range(8, GRAM, 8):
                x = (x ^ (x >> np.uint64(29))) * _M2 + eight[j : j + grams]
            x = (x ^ (x >> np.uint64(32))) * _M1
            x ^= x >> np.uint64(29)
            place = (x & ~np.uint64((1 << 20) - 1)) | np.arange(grams, dtype=np.uint64)
            # least of each w in a row: the end of one stretch of w and the beginning of the next
            padded = np.full(-(-grams // w) * w + w, ~np.uint64(0))
            padded[:grams] = place
            rows = padded.reshape(-1, w)
            ahead = np.minimum.accumulate(rows, axis=1).ravel()
            back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
            least = np.minimum(back[:windows], ahead[w - 1 : w - 1 + windows])
            anchor = (least & np.uint64((1 << 20) - 1)).astype(np.int64)
            first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
            last = np.r_[first[1:], windows] - 1
            sums = np.zeros(len(text) + 1, dtype=np.uint64)
            np.cumsum(_BYTE[data] * self.up[: len(text)], out=sums[1:])
            content = (sums[last + self.length] - sums[first]) * self.down[first] + (last - first).astype(np.uint64)
            content = (content ^ (content >> np.uint64(32))) * _M2
        at = anchor[first]
        return x[at], content, first + low, last + low, at + low


def _segments(docs: DataFrame, length: int) -> DataFrame:
    """Of rows (id, uid, t): a row per segment."""

    def run(batches):
        cutter = Segmenter(length)
        for batch in batches:
            out, rows = [], []
            for i, t in enumerate(batch.column(2)):
                got = cutter.segments(t.as_py())
                if len(got[0]):
                    out.append(got), rows.append(np.full(len(got[0]), i))
            if not out:
                continue
            key, content, first, last, anchor = (np.concatenate(x) for x in zip(*out))
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(anchor, pa.int32())], ["id", "uid", "key", "content", "first", "last", "anchor"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, uid long, key long, content long, first int, last int, anchor int")


def _parts(chosen: DataFrame, length: int) -> DataFrame:
    """Of rows (t, wanted: array of (key, content, first, last, anchor)): the parts (shard, key, content, at: window start in the segment, bytes)."""
    top = (length - GRAM) // CLASS  # the last class takes what is over

    def run(batches):
        for batch in batches:
            rows = ([], [], [], [], [])
            for t, wanted in zip(batch.column(0), batch.column(1).to_pylist()):
                text = t.as_py()
                for s in wanted:
                    first, last, anchor = s["first"], s["last"], s["anchor"]
                    lowest, highest = min((anchor - last) // CLASS, top - 1), min((anchor - first) // CLASS, top - 1)
                    for c in range(lowest, highest + 1):
                        least, most = c * CLASS, (c + 1) * CLASS - 1 if c < top - 1 else length - GRAM
                        a, b = max(first, anchor - most), min(last, anchor - least)
                        if a <= b:
                            around = text[anchor - least : anchor + length - most]
                            for column, x in zip(rows, (xxhash.xxh64_intdigest(around, seed=c) - (1 << 63), s["key"], s["content"], a - first, text[a : b + length])):
                                column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["shard", "key", "content", "at", "bytes"])

    return chosen.mapInArrow(run, "shard long, key long, content long, at int, bytes binary")


def repeats(parts: list[bytes], length: int) -> list[np.ndarray]:
    """Of each part, the starts of the windows that also start elsewhere in the parts."""
    size = np.array([len(p) + 1 for p in parts])
    start = np.cumsum(size) - size
    text = np.frombuffer(b"\xff".join(parts) + b"\xff", dtype=np.uint8)  # a byte that no UTF-8 text holds
    windows = np.maximum(size - length, 0)
    inside = np.repeat(np.tile([True, False], len(parts)), np.stack([windows, size - windows], axis=1).ravel())
    before, shared = common_prefixes(text, suffix_array(text), length, wanted=inside)
    hit = np.flatnonzero((shared >= length) & inside)
    dup = np.zeros(len(text), dtype=bool)
    dup[hit] = True
    dup[before[hit]] = True
    at = np.flatnonzero(dup & inside)
    part = np.searchsorted(start, at, side="right") - 1
    edges = np.searchsorted(part, np.arange(len(parts) + 1))
    return [at[a:b] - start[i] for i, (a, b) in enumerate(zip(edges[:-1], edges[1:]))]


def _stretches(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of whole numbers in a row."""
    cut = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.r_[0, cut + 1]], starts[np.r_[cut, len(starts) - 1]]


def _sorted_shards(parts: DataFrame, length: int) -> DataFrame:
    """Of parts sorted by shard: stretches of repeating windows (key, content, low, high), as starts in the segment."""

    def run(batches):
        block, size, group, shard = [], 0, [], None

        def solve():
            nonlocal block, size
            out = ([], [], [], [])
            if block:
                for (_, key, content, at, _), starts in zip(block, repeats([r[4] for r in block], length)):
                    if len(starts):
                        low, high = _stretches(starts + at)
                        for column, x in zip(out, ([key] * len(low), [content] * len(low), low, high)):
                            column.extend(x)
            block, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["key", "content", "low", "high"])

        def close():
            nonlocal block, size, group
            if len(group) > 1:
                block += group
                size += sum(len(r[4]) + 1 for r in group)
            group = []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != shard:
                    close()
                    shard = row[0]
                    if size > SORTED:
                        yield solve()
                group.append(row)
        close()
        yield solve()

    return parts.mapInArrow(run, "key long, content long, low long, high long")


def spans(docs: DataFrame, length: int) -> DataFrame:
    """Of rows (id, uid, t): per document the first and last starts of windows that also start elsewhere."""
    spark = docs.sparkSession
    segments = materialise(_segments(docs, length), "segments")
    keys = materialise(segments.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "keys")  # written, so that the join with a hot key can be split
    shared = materialise(segments.join(keys, "key"), "shared")
    release(segments, keys)
    place = F.struct("id", "uid", "first", "last", "anchor")
    distinct = materialise(shared.groupBy("key", "content").agg(F.count("*").alias("n"), F.min(place).alias("p")), "distinct")
    several = materialise(distinct.groupBy("key").agg(F.count("*").alias("d")).where("d > 1").select("key"), "several")  # as keys
    wanted = distinct.join(several, "key").groupBy("p.id", "p.uid").agg(F.collect_list(F.struct("key", "content", "p.first", "p.last", "p.anchor")).alias("wanted"))
    wanted = materialise(wanted, "wanted")
    few = wanted.count() <= BROADCAST_IDS
    ids = wanted.select("id", "uid")
    chosen = docs.join(F.broadcast(ids) if few else ids, [docs["id"].eqNullSafe(ids["id"]), docs["uid"] == ids["uid"]], "left_semi").dropDuplicates(["id", "uid"])
    chosen = chosen.join(wanted, [chosen["id"].eqNullSafe(wanted["id"]), chosen["uid"] == wanted["uid"]]).select("t", "wanted")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = _parts(chosen, length).repartition(n, "shard").sortWithinPartitions("shard", "key", "content")
    found = materialise(_sorted_shards(parts, length), "found")
    # one row per segment, so that the join back makes no more rows than there are copies of segments
    whole = distinct.where("n > 1").select("key", "content", F.array(F.struct(F.lit(0).cast("long").alias("low"), (F.col("p.last") - F.col("p.first")).cast("long").alias("high"))).alias("runs"))
    part = found.join(whole, ["key", "content"], "left_anti").groupBy("key", "content").agg(F.collect_list(F.struct("low", "high")).alias("runs"))
    marked = materialise(part.union(whole), "marked")
    placed = F.transform("runs", lambda r: F.struct((F.col("first") + r["low"]).alias("low"), (F.col("first") + r["high"]).alias("high")))
    out = shared.join(marked, ["key", "content"]).groupBy("id", "uid").agg(F.flatten(F.collect_list(placed)).alias("spans"))
    out = materialise(out, "spans")
    release(shared, distinct, several, wanted, found, marked)
    return out


def _whole_characters(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """``gone`` with every byte of a UTF-8 character of which a byte is gone."""
    character = np.cumsum((data & 0xC0) != 0x80)
    hit = np.zeros(character[-1] + 1, dtype=bool)
    hit[character[gone]] = True
    return hit[character]


def remove(docs: DataFrame, length: int = 200, key: str = "doc_id", text: str = "text", whole_characters: bool = False) -> DataFrame:
    """The rows of ``docs`` with _kept (the bytes left), _n_bytes, _n_removed and _n_spans (maximal removed runs).

    With ``whole_characters``, what is left of a character that loses a byte goes too; the counts don't change."""
    rest = [c for c in docs.columns if c not in (text, "_kept", "_n_bytes", "_n_removed", "_n_spans")]
    own = docs.select(F.struct(*rest).alias("rest"), F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t")).withColumn("uid", F.xxhash64("id", "t"))
    got = spans(own.select("id", "uid", "t"), length)

    def run(batches):
        for batch in batches:
            kept, removed, runs, size = [], [], [], []
            for t, marked in zip(batch.column(1), batch.column(2).to_pylist()):
                data = t.as_py()
                size.append(len(data))
                if not marked:
                    kept.append(data), removed.append(0), runs.append(0)
                    continue
                low, high = (np.array([s[x] for s in marked], dtype=np.int64) for x in ("low", "high"))
                edge = np.zeros(len(data) + 1, dtype=np.int64)
                np.add.at(edge, low, 1)
                np.add.at(edge, high + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum())), runs.append(int((gone[1:] & ~gone[:-1]).sum() + gone[0]))
                bytes_ = np.frombuffer(data, dtype=np.uint8)
                kept.append(bytes_[~(_whole_characters(bytes_, gone) if whole_characters else gone)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())], ["rest", "_kept", "_n_bytes", "_n_removed", "_n_spans"])

    joined = own.join(got, [own["id"].eqNullSafe(got["id"]), own["uid"] == got["uid"]], "left").select("rest", "t", "spans")
    out = joined.mapInArrow(run, f"rest {own.schema['rest'].dataType.simpleString()}, _kept binary, _n_bytes long, _n_removed long, _n_spans long")
    return out.select("rest.*", "_kept", "_n_bytes", "_n_removed", "_n_spans")

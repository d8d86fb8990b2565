"""Exact Jaccard join of word-shingle sets, size aware.

Two sets with a share of at least t of their union in common have sizes within a factor t, and each
holds at least ceil(t n) elements of the other. By size a set is small or large:

* Small sets enumerate subsets of fixed size. For sizes a and b the overlap must reach
  c(a, b) = ceil(t (a + b)/(1 + t)), so a set lists its subsets of every size c that a partner of
  some size can ask for, and two small sets meet in a list exactly when they share a subset.
* Large sets, and small ones that may have large partners, scan inverted lists of single shingles.
  Every shingle's number of sets is counted first; shingles of one set link nothing, and a set with fewer
  than ceil(t n) others can't link at all and is done. The rest enter the lists of their rarest
  shingles: of n in order of frequency, any n - ceil(t n) + 1 hold one of every linked set.
  What a passage puts into very many sets thus makes lists only for sets that hold little else.

The boundary is the size at which the rows that both ways emit are fewest, from the counts of
sets by size. Equal sets stand as one. Counting goes by blocks of entries (a shingle and a set's place in the
block, eight bytes): a task sorts a part of the hash range, and what it finds goes back to the block. A shingle that
several sets of a block hold is one entry of the block, so the most frequent one has as many entries as there are blocks.

In the lists each set is checked against the one that leads most of its lists; in lists that then still
hold several components, against every set of another component that the sizes and two parity
sketches (a lower bound of the differing elements) allow, the likeliest first. Long lists are cut into pairs of
blocks. Checks count both sets' shingles exactly.

Defined results: a null text has no words; a text without words has the empty set, which links
with nothing; one with fewer words than a shingle has one shingle, all its words. Rows with a null id
link with nothing and have no component. An id that occurs twice is one document whose links are those of either text, and n_shingles the larger size. Extra columns are
ignored. An empty table gives no rows. Long texts are read whole; a task holds about forty times its longest text.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.plans.staging import BROADCAST_ROWS, materialise, picked, release

#: Up to this size costs may call a set small; beyond, one set has more subsets than any has shingles.
SMALL_MOST = 64
#: Bytes of text that are shingled together, if one text is not longer; entries and sets of a block.
AT_ONCE, ENTRIES, PLACES = 1 << 21, 1 << 20, 0xFFFF
#: Bits of a sketch; sets of a list that are compared in one task.
BITS, LONG = 2048, 2048
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mix(x: np.ndarray, by: np.uint64 = _M1) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * by
        x = (x ^ (x >> np.uint64(29))) * _M2
        return x ^ (x >> np.uint64(32))


@dataclass(frozen=True)
class Rule:
    """Shingles of ``words`` words; sets link from a share of ``num / den`` of their union."""

    words: int
    num: int
    den: int = 100

    def overlap(self, a: int, b: int) -> int:
        """The least number of common elements of linked sets of these sizes."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def most(self, n: int) -> int:
        """The largest size of a partner."""
        return n * self.den // self.num

    def least(self, n):
        """The smallest size of a partner, and the least number of common elements with any."""
        return -(-n * self.num // self.den)

    def prefix(self, n: int) -> int:
        return n - self.least(n) + 1

    def subset_sizes(self, n: int, boundary: int) -> list[int]:
        """Sizes of the subsets that a set of n elements lists for partners up to the boundary."""
        return sorted({self.overlap(n, m) for m in range(self.least(n), min(self.most(n), boundary) + 1)})

    def listed(self, n: int, boundary: int) -> bool:
        """Whether a set of n elements enters inverted lists."""
        return n > boundary or self.most(n) > boundary

    def emitted(self, n: int, boundary: int) -> int:
        """Rows and entries that a set of n elements emits under a boundary."""
        subsets = sum(math.comb(n, c) for c in self.subset_sizes(n, boundary)) if n <= boundary else 0
        return subsets + (n + self.prefix(n) if self.listed(n, boundary) else 0)

    def boundary(self, counts: dict[int, int]) -> int:
        """The boundary that makes the sets counted by size emit fewest rows."""
        return min(range(1, SMALL_MOST + 1), key=lambda x: sum(n * self.emitted(size, x) for size, n in counts.items()))


class Shingler:
    """Sets of shingle hashes of texts."""

    def __init__(self, words: int):
        self.words = words

    def sets(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The distinct hashes of the shingles of each text's lower-cased words, sorted, end to end, and how many each text has."""
        size = np.array([len(t) for t in texts], dtype=np.int64)
        data = _LOWER[np.frombuffer(b"".join([*texts, bytes(8)]), dtype=np.uint8)]
        words, count = self._words(data, size)
        end = np.cumsum(count)
        span = self.words
        with np.errstate(over="ignore"):
            x = words[: max(len(words) - span + 1, 0)] + np.uint64(span)
            for j in range(1, span):
                x = mix(x) + words[j : j + len(x)]
            x = mix(x)
            own = np.repeat(np.arange(len(texts)), count)
            x = x[own[: len(x)] == own[len(words) - len(x) :]]
            made = np.maximum(count - span + 1, 0)
            short = np.flatnonzero((count > 0) & (count < span))
            if len(short):  # all their words are one shingle
                alone = np.zeros(len(short), dtype=np.uint64)
                for k, i in enumerate(short):
                    w = words[end[i] - count[i] : end[i]]
                    y = w[:1] + np.uint64(len(w))
                    for j in range(1, len(w)):
                        y = mix(y) + w[j : j + 1]
                    alone[k] = mix(y)[0]
                x = np.insert(x, (np.cumsum(made) - made)[short], alone)
                made[short] = 1
        at = np.cumsum(made)
        for a, b in zip(at - made, at):
            x[a:b].sort()
        new = np.ones(len(x), dtype=bool)
        new[1:] = x[1:] != x[:-1]
        new[(at - made)[made > 0]] = True
        return x[new], np.bincount(np.repeat(np.arange(len(texts)), made)[new], minlength=len(texts))

    def _words(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words of texts that lie end to end, eight spare bytes behind them, and how many each text has."""
        n, edge = len(data) - 8, np.cumsum(size)
        solid = ~_SPACE[data[:n]]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        full = size > 0
        first[(edge - size)[full]] = solid[(edge - size)[full]]
        last[edge[full] - 1] = solid[edge[full] - 1]
        at, length = np.flatnonzero(first), np.flatnonzero(last) + 1
        length -= at
        eight = np.ndarray((n + 1,), dtype="<u8", buffer=data, strides=(1,))
        with np.errstate(over="ignore"):
            out = length.astype(np.uint64) * _M3 + (eight[at] & _FIRST[np.minimum(length, 8)])
            live = np.flatnonzero((length > 8) & (length <= 64))
            for d in range(8, 64, 8):
                out[live] = mix(out[live]) + (eight[at[live] + d] & _FIRST[np.minimum(length[live] - d, 8)])
                live = live[length[live] > d + 8]
        for i in np.flatnonzero(length > 64):
            out[i] = xxhash.xxh64_intdigest(data[at[i] : at[i] + length[i]].tobytes())
        return out, np.diff(np.searchsorted(at, np.r_[0, edge]))

    def of(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """The sets of rows of a column of texts, in groups: first row, last row + 1, and what ``sets`` gives for these."""
        low, size, texts = 0, 0, []
        for i, t in enumerate(column):
            t = t.as_py() or b""
            if texts and size + len(t) > AT_ONCE:
                yield low, i, *self.sets(texts)
                low, size, texts = i, 0, []
            texts.append(t)
            size += len(t)
        if texts:
            yield low, low + len(texts), *self.sets(texts)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _summed(x: np.ndarray, count: np.ndarray) -> np.ndarray:
    out = np.zeros(len(count), dtype=np.uint64)
    if len(x):
        out[count > 0] = np.add.reduceat(x, (np.cumsum(count) - count)[count > 0])
    return out


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("t"))


def sets(texts: DataFrame, rule: Rule) -> DataFrame:
    """Per row (id, t): id, n, two hashes of the set, and the set if it may be small."""

    def run(batches):
        shingler = Shingler(rule.words)
        for batch in batches:
            for low, high, flat, n in shingler.of(batch.column(1)):
                small = np.where(n <= SMALL_MOST, n, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(small)], pa.int32()), _long(flat[np.repeat(n <= SMALL_MOST, n)]))
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], pa.array(n, pa.int64()), _long(_summed(mix(flat, _M3), n)), _long(_summed(mix(flat ^ _M1, _M2), n)), lists], ["id", "n", "h1", "h2", "small"])

    return texts.mapInArrow(run, "id long, n long, h1 long, h2 long, small array<long>")


def subset_keys(rule: Rule, s: np.ndarray, boundary: int) -> np.ndarray:
    """The keys (negative, unlike those of shingles) of a small set's lists: its subsets of the sizes that small partners ask for."""
    out, own = [], mix(s, _M3)
    with np.errstate(over="ignore"):
        for c in rule.subset_sizes(len(s), boundary):
            left_out = np.array(list(itertools.combinations(range(len(s)), len(s) - c)), dtype=np.int64).reshape(math.comb(len(s), c), len(s) - c)
            out.append(mix(own.sum() - own[left_out].sum(axis=1, dtype=np.uint64) + _M1 * np.uint64(c)) | np.uint64(1 << 63))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, dtype=np.int64)


def _subset_lists(small: DataFrame, rule: Rule, boundary: int) -> DataFrame:
    """Entries (key, id) of small sets (id, small)."""

    def run(batches):
        for batch in batches:
            for i, s in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys = subset_keys(rule, np.array(s.as_py(), dtype=np.int64).view(np.uint64), boundary)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), i), pa.int64())], ["key", "id"])

    return small.select("id", "small").mapInArrow(run, "key long, id long")


_BLOCK = "part int, block long, entries binary, more binary, ids binary"


def _blob(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([None if a is None else a.tobytes() for a in arrays], pa.binary())


def _blocks(texts: DataFrame, rule: Rule, boundary: int, parts: int) -> DataFrame:
    """Blocks of the sets that enter inverted lists, as rows (part, block, entries, more, ids).

    An entry holds 48 bits of a shingle's hash and 16 of its set's place in the block. Entries of one part go in one row; for a shingle
    of several sets one entry with the place PLACES, and the number of these sets in ``more``. A block's own row has their
    entries, the sizes of the sets in ``more`` and their ids. Blocks are the same whenever a task is run again."""

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        shingler, ids, sizes, held, total = Shingler(rule.words), [], [], [], 0

        def block():
            nonlocal ids, sizes, held, total, number
            e = np.concatenate(held)
            e.sort()
            k = e >> np.uint64(16)
            same = k[1:] == k[:-1]
            several = np.r_[same, False] | np.r_[False, same]
            shared = e[several]
            first = np.flatnonzero(np.r_[True, shared[1:] >> np.uint64(16) != shared[:-1] >> np.uint64(16)]) if len(shared) else np.zeros(0, dtype=np.int64)
            counts = np.diff(np.r_[first, len(shared)]).astype(np.uint32)
            one = np.concatenate([e[~several], shared[first] | np.uint64(PLACES)])
            more = np.concatenate([np.zeros(len(e) - len(shared), dtype=np.uint32), counts])
            order = np.argsort(one)
            one, more = one[order], more[order]
            cut = np.searchsorted((one >> np.uint64(16)) * np.uint64(parts) >> np.uint64(48), np.arange(parts + 1, dtype=np.uint64))
            name = task | number << 32
            rows = [(p, one[a:b], more[a:b][more[a:b] > 0]) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if a < b]
            own = (task + 31 * number) % parts, shared, np.array(sizes, dtype=np.uint32)
            number += 1
            out = pa.RecordBatch.from_arrays(
                [pa.array([*(r[0] for r in rows), own[0]], pa.int32()), pa.array([name] * (len(rows) + 1), pa.int64()), _blob([*(r[1] for r in rows), own[1]]), _blob([*(r[2] for r in rows), own[2]]), _blob([*[None] * len(rows), np.array(ids, dtype=np.int64)])],
                ["part", "block", "entries", "more", "ids"],
            )
            ids, sizes, held, total = [], [], [], 0
            return out

        for batch in batches:
            for low, high, flat, n in shingler.of(batch.column(1)):
                end, key = np.cumsum(n), flat & ~np.uint64(PLACES)
                for i, (name, size) in enumerate(zip(batch.column(0)[low:high].to_pylist(), n.tolist())):
                    if not size or not rule.listed(size, boundary):
                        continue
                    if total and (total + size > ENTRIES or len(ids) == PLACES):
                        yield block()
                    held.append(key[end[i] - size : end[i]] | np.uint64(len(ids)))
                    ids.append(name), sizes.append(size)
                    total += size
        if total:
            yield block()

    return texts.mapInArrow(run, _BLOCK)


def _counted(blocks: DataFrame, parts: int) -> DataFrame:
    """Blocks, dealt by part, with only the entries of shingles of several sets, and in ``more`` their frequency by sixths of an octave; a block's own row is as before."""

    def run(batches):
        names, entries, more = [], [], []
        for batch in batches:
            own = batch.column(4).is_valid()
            if pc.any(own).as_py():
                yield batch.filter(own)
            rest = batch.filter(pc.invert(own))
            names += rest.column(1).to_pylist()
            entries += [np.frombuffer(x.as_py(), dtype=np.uint64) for x in rest.column(2)]
            more += [np.frombuffer(x.as_py(), dtype=np.uint32) for x in rest.column(3)]
        if not names:
            return
        size, e = np.array([len(x) for x in entries]), np.concatenate(entries)
        weight = np.ones(len(e), dtype=np.int64)
        weight[e & np.uint64(PLACES) == PLACES] = np.concatenate(more)
        entries = more = None
        k = e >> np.uint64(16)
        order = np.argsort(k, kind="stable")  # runs in order already
        k = k[order]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        total = np.add.reduceat(weight[order], first)
        level = np.zeros(len(e), dtype=np.uint8)
        level[order] = np.repeat(np.where(total > 1, np.minimum(6 * np.log2(total), 255), 0).astype(np.uint8), np.diff(np.r_[first, len(e)]))
        kept, place = level > 0, np.cumsum(size)
        out = [(name, e[a:b][kept[a:b]], level[a:b][kept[a:b]]) for name, a, b in zip(names, place - size, place)]
        out = [r for r in out if len(r[1])]
        parts_of = [((r[0] & 0xFFFFFFFF) + 31 * (r[0] >> 32)) % parts for r in out]
        for low in range(0, len(out), 256):
            some = out[low : low + 256]
            yield pa.RecordBatch.from_arrays([pa.array(parts_of[low : low + 256], pa.int32()), pa.array([r[0] for r in some], pa.int64()), _blob([r[1] for r in some]), _blob([r[2] for r in some]), pa.nulls(len(some), pa.binary())], ["part", "block", "entries", "more", "ids"])

    return blocks.mapInArrow(run, _BLOCK)


def _rarest(counted: DataFrame, rule: Rule) -> DataFrame:
    """Entries (key, id) of the inverted lists: of each set that can link, the rarest shingles that some other set holds, one of which every linked set has."""

    def solve(rows):
        own = next(r for r in rows if r[3] is not None)
        ids, n = np.frombuffer(own[3], dtype=np.int64), np.frombuffer(own[2], dtype=np.uint32).astype(np.int64)
        shared = np.frombuffer(own[1], dtype=np.uint64)
        back = [r for r in rows if r[3] is None]
        e = np.concatenate([np.frombuffer(r[1], dtype=np.uint64) for r in back] or [shared[:0]])
        level = np.concatenate([np.frombuffer(r[2], dtype=np.uint8) for r in back] or [np.zeros(0, dtype=np.uint8)])
        common = e & np.uint64(PLACES) == PLACES
        key, named = e[common] >> np.uint64(16), level[common]
        by = np.argsort(key)
        at = by[np.searchsorted(key, shared >> np.uint64(16), sorter=by)]
        e, level = np.concatenate([e[~common], shared]), np.concatenate([level[~common], named[at]])
        place = (e & np.uint64(PLACES)).astype(np.int64)
        have, least = np.bincount(place, minlength=len(ids)), rule.least(n)
        some = (have >= least)[place]
        e, level, place = e[some], level[some], place[some]
        order = np.lexsort((e, level, place))
        e, place = e[order], place[order]
        rank = np.arange(len(place)) - np.searchsorted(place, place)
        some = rank < (have - least + 1)[place]
        return (e[some] >> np.uint64(16)).astype(np.int64), ids[place[some]]

    def run(batches):
        rows = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and rows[0][0] != row[0]:
                    yield from out(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield from out(rows)

    def out(rows):
        key, ids = solve(rows)
        for low in range(0, len(key), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(key[low : low + (1 << 17)]), pa.array(ids[low : low + (1 << 17)])], ["key", "id"])

    return counted.select("block", "entries", "more", "ids").sortWithinPartitions("block").mapInArrow(run, "key long, id long")


def sketch(flat: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A row of BITS parities for each set of elements that lie end to end. Two rows differ in no more bits than their sets have differing elements."""
    row = np.repeat(np.arange(len(n)) * BITS, n) + (mix(flat, _M2) % np.uint64(BITS)).astype(np.int64)
    bits = (np.bincount(row, minlength=len(n) * BITS) & 1).astype(np.uint8)
    return np.packbits(bits.reshape(len(n), BITS), axis=1)


def _held(texts: DataFrame, rule: Rule) -> DataFrame:
    """Per row (id, t): id, n, the set and its sketch."""

    def run(batches):
        shingler = Shingler(rule.words)
        for batch in batches:
            for low, high, flat, n in shingler.of(batch.column(1)):
                end = np.cumsum(n)
                for a in range(low, high, 256):
                    b = min(a + 256, high)
                    some = n[a - low : b - low]
                    bits = sketch(flat[end[a - low] - some[0] : end[b - low - 1]], some)
                    yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(some, pa.int64()), _blob([flat[end[i] - n[i] : end[i]] for i in range(a - low, b - low)]), _blob(list(bits))], ["id", "n", "set", "bits"])

    return texts.mapInArrow(run, "id long, n long, set binary, bits binary")


def verified(pairs: DataFrame, held: DataFrame, rule: Rule) -> DataFrame:
    """Of pairs (a, b), materialised: those whose sets link."""
    one = pairs.select("a", "b").join(held.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
    two = one.join(held.select(F.col("id").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                good.append(rule.den * common >= rule.num * (len(both) - common))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return materialise(two.mapInArrow(run, "a long, b long"), "linked")


def _likely(rows: DataFrame, rule: Rule, each: bool) -> DataFrame:
    """Of entries (key, x, y, side, id, component, n, bits) sorted by key, x and y: the pairs (a, b) of different components that sizes and sketches allow to link.

    x and y name two blocks of a list, ``side`` the one that an entry is of. With ``each``, only the likeliest pair of every set in a list."""

    def pairs(x, y, side, ids, comp, n, bits):
        flip = x[0] != y[0]  # two blocks: pairs across them
        rows_at, columns_at = np.flatnonzero(side == x[0]), np.flatnonzero(side == y[0])
        step = max(1, (1 << 18) // max(1, len(columns_at)))
        for low in range(0, len(rows_at), step):
            i, j = (x.ravel() for x in np.meshgrid(rows_at[low : low + step], columns_at, indexing="ij"))
            some = (comp[i] != comp[j]) & (rule.den * np.minimum(n[i], n[j]) >= rule.num * np.maximum(n[i], n[j]))
            if not flip:
                some &= j > i
            i, j = i[some], j[some]
            apart = np.concatenate([np.zeros(0, dtype=np.int64), *(np.bitwise_count(bits[i[c : c + 8192]] ^ bits[j[c : c + 8192]]).sum(axis=1, dtype=np.int64) for c in range(0, len(i), 8192))])
            good = (rule.num + rule.den) * apart <= (rule.den - rule.num) * (n[i] + n[j])
            yield np.minimum(ids[i], ids[j])[good], np.maximum(ids[i], ids[j])[good], apart[good]

    def best(a, b, apart):
        own = np.r_[a, b]
        order = np.lexsort((np.r_[b, a], np.r_[apart, apart], own))
        first = order[np.r_[True, own[order][1:] != own[order][:-1]]] % len(a)
        return a[first], b[first]

    def run(batches):
        held, found, size = None, [], 0

        def out():
            both = np.unique(np.stack([np.concatenate(x) for x in zip(*found)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, i])) for i in (0, 1)], ["a", "b"])

        def solve(c):
            nonlocal size
            got = [np.concatenate(x) for x in zip(*pairs(*c))]
            if got and len(got[0]):
                found.append(best(*got) if each else tuple(got[:2]))
                size += len(found[-1][0])

        for batch in batches:
            if not len(batch):
                continue
            bits = np.frombuffer(b"".join(x.as_py() for x in batch.column(7)), dtype=np.uint64).reshape(len(batch), -1)
            now = [*(c.to_numpy() for c in batch.columns[:7]), bits]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            lead = np.ones(len(held[0]), dtype=bool)
            lead[1:] = (held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]) | (held[2][1:] != held[2][:-1])
            edges = np.flatnonzero(lead)
            for a, b in zip(edges[:-1], edges[1:]):
                solve([c[a:b] for c in held[1:]])
            held = [c[edges[-1] :] for c in held]  # the last group may go on
            if size > 1 << 19:
                yield out()
                found, size = [], 0
        if held is not None:
            solve(held[1:])
        if found:
            yield out()

    return rows.select("key", "x", "y", "side", "id", "component", "n", "bits").mapInArrow(run, "a long, b long")


def _candidates(entries: DataFrame, component: DataFrame, held: DataFrame, rule: Rule, parts: int, each: bool, long: int) -> DataFrame:
    """Pairs of sets that meet in a list of several components and may link, materialised."""
    placed = materialise(entries.join(component, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")), "placed")
    open_ = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low <> high").select("key", "size")
    open_ = materialise(open_, "open")
    blocks = F.ceil(F.col("size") / long)
    cut = placed.join(open_, "key").withColumn("side", F.pmod(F.xxhash64("id"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    cut = cut.select("key", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "side", "id", "component")
    rows = cut.join(held.select("id", "n", "bits"), "id").repartition(parts, "key", "x", "y").sortWithinPartitions("key", "x", "y")
    out = materialise(_likely(rows, rule, each).distinct(), "likely")
    release(placed, open_)
    return out


def _merged(component: DataFrame, links: DataFrame) -> DataFrame:
    """Components (id, component), materialised, after links (a, b) are added."""
    ends = [component.select(F.col("id").alias(x), F.col("component").alias(f"c{x}")) for x in "ab"]
    across = links.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = materialise(components(across), "merged")
    moved = component.join(merged.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    alone = merged.join(component, "id", "left_anti").select("id", "component")  # single sets until now
    out = materialise(moved.union(alone), "components")
    release(component, merged)
    return out


def _lists(texts: DataFrame, alone: DataFrame, rule: Rule) -> DataFrame:
    """Entries (key, id) of the lists of more than one set, materialised; ``alone``: one row (id, n, small) of each different set."""
    spark = texts.sparkSession
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), PLACES)
    counts = {r.n: r["count"] for r in alone.where(F.col("n") <= SMALL_MOST).groupBy("n").count().collect()}  # SMALL_MOST rows at most
    boundary = rule.boundary(counts)
    own = picked(texts, alone.select("id"), ["id"])
    if alone.count() > BROADCAST_ROWS:
        own = materialise(own, "own")  # rows of a shuffle may come in another order when a task is run again
    counted = _counted(_blocks(own, rule, boundary, parts).repartitionById(parts, F.col("part")), parts).repartitionById(parts, F.col("part"))
    rarest = materialise(_rarest(counted, rule), "rarest")
    subsets = materialise(_subset_lists(alone.where(F.col("n") <= boundary), rule, boundary), "subsets")
    entries = rarest.union(subsets)
    several = materialise(entries.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("size")).where("size > 1").select("key", "first"), "several")
    out = materialise(entries.join(several, "key").select("key", "id", "first"), "entries")
    release(rarest, subsets, several)
    return out


def join(docs: DataFrame, rule: Rule, key: str = "doc_id", text: str = "text", long: int = LONG) -> DataFrame:
    """Per id: n_shingles and component_id, the smallest id that links reach from it. ``long``: sets of a list that are compared in one task."""
    nameless = docs.where(F.col(key).isNull()).select(F.lit(None).cast("long").alias("id"), F.col(text).cast("binary").alias("t"))
    return _linked(docs, rule, key, text, long).unionByName(sets(nameless, rule).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))


def _linked(docs: DataFrame, rule: Rule, key: str, text: str, long: int) -> DataFrame:
    """``join`` without the rows that have no id."""
    texts = _texts(docs, key, text)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = materialise(sets(texts, rule), "sets")
    the_set = F.struct("n", "h1", "h2")
    if not every.groupBy("id").agg(F.min(the_set).alias("low"), F.max(the_set).alias("high")).where("low <> high").isEmpty():
        release(every)
        return _of_rows(docs, rule, key, text, long)
    classes = materialise(every.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("id").alias("rep")), "classes")  # written, so that the join with a hot set can be split
    members = materialise(every.select("id", "n", "h1", "h2").distinct().join(classes, ["n", "h1", "h2"], "left").select("id", "n", F.coalesce("rep", "id").alias("rep")), "members")
    alone = materialise(picked(every.where("n > 0"), classes.select(F.col("rep").alias("id")), ["id"]).select("id", "n", "small").dropDuplicates(["id"]), "alone")
    release(every, classes)
    entries = _lists(texts, alone, rule)
    release(alone)
    listed = materialise(entries.select("id").distinct(), "listed")
    held = materialise(_held(picked(texts, listed, ["id"]), rule), "held")
    # each set with the one that leads most of its lists; whatever this misses is tried below
    leads = entries.where("id <> first").groupBy("id", "first").agg(F.count("*").alias("shared")).groupBy("id").agg(F.max(F.struct("shared", "first"))["first"].alias("first"))
    tried = materialise(leads.select(F.least("id", "first").alias("a"), F.greatest("id", "first").alias("b")).distinct(), "tried")
    linked = verified(tried, held, rule)
    component = materialise(components(linked), "components")
    release(linked)
    lists = entries.select("key", "id")
    for each in (True, False):
        likely = _candidates(lists, component, held, rule, parts, each, long)
        new = materialise(likely.join(tried, ["a", "b"], "left_anti"), "new")
        linked = verified(new, held, rule)
        component = _merged(component, linked)
        tried = materialise(tried.union(new), "tried")
        release(likely, new, linked)
    release(entries, listed, held, tried)
    reached = members.join(component.withColumnRenamed("id", "rep"), "rep", "left").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    return reached


def _of_rows(docs: DataFrame, rule: Rule, key: str, text: str, long: int) -> DataFrame:
    """``_linked`` where an id has several texts: rows are joined under numbers of their own, and rows of an id are linked."""
    rows = materialise(_texts(docs, key, text).withColumn("row", F.monotonically_increasing_id()), "rows")
    got = _linked(rows, rule, "row", "t", long).join(rows.select("row", "id"), "row")
    got = materialise(got.groupBy("id", "component_id").agg(F.max("n_shingles").alias("n")), "rows-joined")
    least = got.groupBy("id").agg(F.min("component_id").alias("a"))
    merged = components(got.join(least, "id").select("a", F.col("component_id").alias("b")))
    whole = got.join(merged.select(F.col("id").alias("component_id"), "component"), "component_id", "left").select("id", "n", F.coalesce("component", "component_id").alias("component"))
    names = whole.groupBy("component").agg(F.min("id").alias("component_id"))
    return whole.join(names, "component").groupBy(F.col("id").alias(key)).agg(F.max("n").alias("n_shingles"), F.min("component_id").alias("component_id"))

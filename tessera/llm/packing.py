"""Best-fit packing of tokenised documents into sequences of a fixed length.

Lengths are whole numbers up to the sequence length, so a histogram of them holds all that the
packing depends on, however many documents there are. The histogram is packed on the driver:

1. Large lengths (over a share of the sequence) are split into groups of equal cardinality, and
   each is rounded up to the largest of its group.
2. Configurations of these few sizes, and how often to use each, come from the linear relaxation
   (columns made by an unbounded knapsack); the numbers are rounded down.
3. Actual lengths take the places of their rounded ones.
4. The small lengths, and the large ones that rounding down left over, are put in by best fit,
   longest first, into the least room that holds them; new sequences open when none does.

Bins with equal contents are handled as one class with a number, so the plan's size depends on
the sequence length alone. Documents find their place by length and rank among documents of that
length; ranks come from running numbers within a task and sums over tasks.

Defined results: a null text is an empty one, which is a single separator. A document of more
than ``size`` ids is cut into pieces of ``size`` from its end; its first piece may be shorter.
Rows with the same id are separate documents. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import json
import os
import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.plans.staging import materialise

REMEMBERED, LONG = 400_000, 48
#: The byte-level pre-tokeniser's pattern for texts in which Python's classes mean the same as its own.
_WORDS = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_OTHER = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\xff]")


# ------------------------------------------------------------------ tokens


@functools.lru_cache(maxsize=2)
def _tokenizer(file: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(file)


def _bytes_of(symbols: str, table: dict[str, int]) -> bytes:
    return bytes(table[c] for c in symbols)


@functools.lru_cache(maxsize=2)
def _word_encoder(file: str):
    """Encodes one word's bytes by the file's merge ranks, where the ids of merged pieces are in the order of the merges; else None."""
    import tiktoken

    model = json.load(open(file, encoding="utf-8"))["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", ())]
    vocab = model["vocab"]
    printable = [b for b in range(256) if chr(b).isprintable() and chr(b) != " " and b != 0xAD]
    rest = [b for b in range(256) if b not in printable]
    table = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}  # the byte-level alphabet
    made = [vocab.get(a + b) for a, b in merges]
    if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or not set(table) <= set(vocab):
        return None
    if made != sorted(made, key=lambda i: -1 if i is None else i) or len({*made}) != len(made) or None in made or made[0] <= max(vocab[c] for c in table):
        return None
    ranks = {_bytes_of(c, table): vocab[c] for c in table} | {_bytes_of(a + b, table): i for (a, b), i in zip(merges, made)}
    return tiktoken.Encoding("word", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Encoder:
    """Ids of texts as a tokenizer file gives them, remembering words up to a bound."""

    def __init__(self, file: str):
        self.plain = _tokenizer(file)
        self.special = [t.content for t in self.plain.get_added_tokens_decoder().values()]
        self.seen: dict[str, bytes] = {}
        spec = self.plain.pre_tokenizer
        self.word = _word_encoder(file)
        self.by_word = self.word is not None and type(spec).__name__ == "ByteLevel" and spec.use_regex and not spec.add_prefix_space and self.plain.normalizer is None

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        cut = [self.words(t) for t in texts]
        whole = [i for i, words in enumerate(cut) if words is None]
        seen = self.seen
        new = set(itertools.chain.from_iterable(filter(None, cut))).difference(seen)
        if new:
            if len(seen) + len(new) > REMEMBERED:
                seen.clear()
                new = set(itertools.chain.from_iterable(filter(None, cut)))
            for w in new:
                ids = self.word(w)
                seen[w] = struct.pack(f"<{len(ids)}I", *ids)
        out = [b"" if words is None else b"".join(map(seen.__getitem__, words)) for words in cut]
        for i, got in zip(whole, self._encode([texts[i] for i in whole])):
            out[i] = got
        for w in new:
            if len(w) > LONG:
                del seen[w]
        return out

    def words(self, text: str) -> list[str] | None:
        if not self.by_word or _OTHER.search(text) or any(s in text for s in self.special):
            return None
        return _WORDS.findall(text)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.plain.encode_batch_fast(texts, add_special_tokens=False)] if texts else []


def pieces(docs: DataFrame, tokenizer_file: str, size: int, separator: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per piece: key, piece, start, length, ids_crc32, and the number of the task and of the piece among those of its length there."""
    own = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    end = np.array([separator], dtype="<u4").tobytes()

    def run(batches):
        encoder, task, seen = Encoder(tokenizer_file), TaskContext.get().partitionId(), np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            row, piece, start, length, crc, nth = [], [], [], [], [], []
            texts = batch.column(1).to_pylist()
            for low in range(0, len(texts), 256):
                for i, ids in enumerate(encoder.ids(texts[low : low + 256]), low):
                    ids += end
                    n, at, k = len(ids) // 4, 0, 0
                    while at < n:
                        here = (n - at) % size or size
                        row.append(i), piece.append(k), start.append(at), length.append(here)
                        crc.append(zlib.crc32(ids[4 * at : 4 * (at + here)])), nth.append(seen[here])
                        seen[here] += 1
                        at, k = at + here, k + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(row), task), pa.int32()), pa.array(nth, pa.int64())],
                [key, "piece", "start", "length", "ids_crc32", "_task", "_nth"],
            )

    return own.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, _task int, _nth long")


# ------------------------------------------------------------------ the plan


@dataclass
class Class:
    """``number`` bins with equal contents, and the room left in each."""

    number: int
    room: int
    contents: list[tuple[int, int]] = field(default_factory=list)  # (length, how many)


@dataclass(frozen=True)
class Plan:
    """By length: from rank ``first`` on, each document goes to the bin ``base`` + (rank - first), at ``offset``."""

    first: dict[int, np.ndarray]
    base: dict[int, np.ndarray]
    offset: dict[int, np.ndarray]
    bins: int


def linear_groups(counts: np.ndarray, lengths: np.ndarray, groups: int) -> list[np.ndarray]:
    """Indices of ``lengths`` (descending) split where the running number of documents passes equal shares."""
    total = counts[lengths].sum()
    share = (np.cumsum(counts[lengths]) - counts[lengths]) * groups // max(total, 1)
    return [lengths[share == g] for g in np.unique(share)]


def configurations(sizes: np.ndarray, need: np.ndarray, capacity: int, rounds: int = 600) -> list[tuple[np.ndarray, float]]:
    """Basic solution of the relaxed covering problem: patterns (how many of each size) and how often each is used."""
    k = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1 / np.diag(columns))
    use = inverse @ need
    for _ in range(rounds):
        price = inverse.sum(axis=0)  # every pattern costs one bin
        worth, taken = _knapsack(sizes, price, capacity)
        if worth <= 1 + 1e-7:
            break
        step = inverse @ taken
        up = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(up))
        if not np.isfinite(up[out]):
            break
        use = use - up[out] * step
        use[out] = up[out]
        columns[:, out] = taken
        pivot = inverse[out] / step[out]
        inverse = inverse - np.outer(step, pivot)
        inverse[out] = pivot
    return [(columns[:, j].astype(int), float(use[j])) for j in range(k)]


def _knapsack(sizes: np.ndarray, price: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(int(sizes.min()), capacity + 1):
        fits = sizes <= room
        value = np.where(fits, price + best[np.where(fits, room - sizes, 0)], -1)
        j = int(np.argmax(value))
        if value[j] > best[room - 1] + 1e-12:
            best[room], last[room] = value[j], j
        else:
            best[room] = best[room - 1]
    taken, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            taken[last[room]] += 1
            room -= int(sizes[last[room]])
    return float(best[capacity]), taken


#: Shares of the sequence above which a length counts as large; the one that needs fewest bins is kept.
SHARES = (1 / 2, 1 / 3, 1 / 4)


def plan(counts: np.ndarray, size: int, groups: int = 24, shares: tuple[float, ...] = SHARES) -> Plan:
    """Pack ``counts[l]`` documents of each length l (1 to ``size``) into bins of ``size``."""
    return min((_plan(counts, size, groups, share) for share in shares), key=lambda p: p.bins)


def _plan(counts: np.ndarray, size: int, groups: int, small_share: float) -> Plan:
    left = counts.astype(np.int64).copy()
    classes: list[Class] = []
    large = np.flatnonzero(left[:size])[::-1]
    large = large[large > small_share * size]
    if len(large):
        members = linear_groups(left, large, groups)
        sizes = np.array([g[0] for g in members])
        need = np.array([left[g].sum() for g in members], dtype=float)
        for pattern, often in configurations(sizes, need, size):
            often = int(often + 1e-9)
            places = [g for g, n in enumerate(pattern) for _ in range(n)]
            classes += _substituted(places, members, left, often, size)
    rooms: dict[int, list[Class]] = {}
    for c in classes:
        rooms.setdefault(c.room, []).append(c)
    order = sorted(rooms)
    done: list[Class] = []

    def put(c: Class) -> None:
        if c.room not in rooms:
            rooms[c.room] = []
            bisect.insort(order, c.room)
        rooms[c.room].append(c)

    for length in range(size - 1, 0, -1):
        n = int(left[length])
        while n:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                each = size // length
                c = Class(-(-n // each), size)
            else:
                room = order[at]
                c = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    order.pop(at)
                each = room // length
            whole = min(c.number, n // each)
            if whole:
                put(Class(whole, c.room - each * length, [*c.contents, (length, each)]))
                n -= whole * each
            rest = c.number - whole
            if rest and n:
                put(Class(1, c.room - n * length, [*c.contents, (length, n)]))
                n, rest = 0, rest - 1
            if rest and c.contents:
                put(Class(rest, c.room, c.contents))
        left[length] = 0
    done += [c for same in rooms.values() for c in same]
    if counts[size]:
        done.append(Class(int(counts[size]), 0, [(size, 1)]))
    return _laid_out(done)


def _substituted(places: list[int], members: list[np.ndarray], left: np.ndarray, often: int, size: int) -> list[Class]:
    """``often`` bins whose places hold actual documents of the places' groups, longest first; places without any stay open."""
    todo, out = [(often, list(places), [])], []
    while todo:
        number, open_places, contents = todo.pop()
        if not number:
            continue
        if not open_places:
            if contents:
                out.append(Class(number, size - sum(x for x, _ in contents), contents))
            continue
        group = members[open_places[0]]
        there = group[left[group] > 0]
        if not len(there):
            todo.append((number, open_places[1:], contents))
            continue
        length = int(there[0])
        now = min(number, int(left[length]))
        left[length] -= now
        todo.append((number - now, open_places, contents))
        todo.append((now, open_places[1:], [*contents, (length, 1)]))
    return out


def _laid_out(classes: list[Class]) -> Plan:
    runs: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for c in classes:
        offset = 0
        for length, each in c.contents:
            for _ in range(each):
                runs.setdefault(length, []).append((c.number, base, offset))
                offset += length
        base += c.number
    first, at, place = {}, {}, {}
    for length, got in runs.items():
        number = np.array([r[0] for r in got], dtype=np.int64)
        first[length] = np.cumsum(number) - number
        at[length] = np.array([r[1] for r in got], dtype=np.int64)
        place[length] = np.array([r[2] for r in got], dtype=np.int64)
    return Plan(first, at, place, base)


# ------------------------------------------------------------------ the operator


def place(cut: DataFrame, size: int, key: str, groups: int = 24) -> DataFrame:
    """Sequence and offset of each row of ``cut`` (what pieces() gives, materialised)."""
    sums = cut.groupBy("length", "_task").agg((F.max("_nth") + 1).alias("_n"))
    counts = np.zeros(size + 1, dtype=np.int64)
    for r in sums.groupBy("length").agg(F.sum("_n").alias("n")).collect():  # at most ``size`` rows
        counts[r.length] = r.n
    shared = cut.sparkSession.sparkContext.broadcast(plan(counts, size, groups))
    before = sums.withColumn("_before", F.sum("_n").over(W.partitionBy("length").orderBy("_task").rowsBetween(W.unboundedPreceding, -1))).select("length", "_task", F.coalesce("_before", F.lit(0)).alias("_before"))
    ranked = cut.join(before, ["length", "_task"]).select(key, "piece", "start", "length", "ids_crc32", (F.col("_nth") + F.col("_before")).alias("_rank"))

    def run(batches):
        p = shared.value
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for x in np.unique(length):
                of = np.flatnonzero(length == x)
                j = np.searchsorted(p.first[x], rank[of], side="right") - 1
                sequence[of] = p.base[x][j] + rank[of] - p.first[x][j]
                offset[of] = p.offset[x][j]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, f"`{key}` {cut.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_file: str, size: int = 2048, separator: int = 0, groups: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's pieces with the sequence that holds each and its offset there."""
    cut = materialise(pieces(docs, tokenizer_file, size, separator, key, text), "pieces")
    return place(cut, size, key, groups)

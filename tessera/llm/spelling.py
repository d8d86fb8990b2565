"""Spelling variants: words one edit apart, found by two-dimensional range reporting over wavelet trees.

Words s and t are near if one insertion, deletion or replacement of a code point leads from one to the other. Of the words of length c
and c + 1 (class c), an edit at position i of s leaves s[:i] in front and s[i + 1:] (replaced) or s[i:] (inserted) behind. In
forward order the words with that front are an interval, in the order of reversed words those with that end are one; a wavelet tree over
the pairs of places reports what lies in both. Deletions are insertions seen from the longer word.

An edit at one of the positions [a, b) leaves the front s[:a] and the end s[b:] alone, so words fall into groups by these: first for the two halves of the
positions, and a group of more than ``CROWD`` words is split into those of half its positions, again and again; for a single
position a group can't exceed what one or two free letters give. Groups are packed into shards of bounded size, of one class each, and
a shard is one unit of work. Each near pair is found at one position only (an inserted letter among equal ones counts at the last place it may
have come from), so a word's neighbours can be counted and its best one chosen in each shard and the results summed: pairs never leave a task.

A word's form is its near word of the largest count, if that is at least ``ratio`` times the word's own; its root is where forms lead (counts rise along
them, so they end), found by doubling pointers.

Defined results: words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, of which A-Z are lower-cased; a null or empty text has none, and an empty table gives no rows.
Rows of one id count each by itself. A null id is the empty string where a run is shortened. Equal counts go by the smaller word. Very long words are words
like others. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.staging import bound_batches, materialise, picked

#: Words of a group; code points of a shard, as a mean; distinct words that a task holds while it counts.
CROWD, SHARD, HELD = 1 << 14, 1 << 18, 1 << 18


def shortened(word: bytes, seed: int, every: int) -> bytes:
    """The word without the code point h % length, where ``every`` divides h = crc32(<id>:<word>) and seed is the crc32 of ``<id>:``."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), seed)
    return word if h % every else word[: h % len(word)] + word[h % len(word) + 1 :]


def count_words(docs: DataFrame, key: str, text: str, shortest: int = 6, every: int | None = None) -> DataFrame:
    """word, n: how often each word of at least ``shortest`` code points stands in all texts, summed in each task before it is shuffled.

    With ``every``, runs are first shortened as ``shortened`` says."""
    runs = re.compile(rb"[a-z\xc0-\xff]{%d,}" % shortest)  # a maximal run, as matches are greedy and shorter ones can't count

    def out(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for own, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = Counter(runs.findall((t.as_py() or "").encode("latin-1", "replace").lower()))
                if every is None:
                    held.update(found)
                else:
                    seed = zlib.crc32(f"{'' if own is None else own}:".encode())
                    for word, n in found.items():
                        word = shortened(word, seed, every)
                        if len(word) >= shortest:
                            held[word] += n
                if len(held) > HELD:
                    yield out(held)
                    held.clear()
        yield out(held)

    bound_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("string"), F.col(text)).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class WaveletTree:
    """Range reporting over a permutation: places and values in intervals at once, for many queries."""

    def __init__(self, values: np.ndarray):
        self.n, self.bits = len(values), max(1, int(len(values) - 1).bit_length())
        self.zeros = np.zeros((self.bits, self.n + 1), dtype=np.int32)  # of each level: values with a 0 bit before a place
        for level in range(self.bits):
            bit = (values >> (self.bits - 1 - level)) & 1
            np.cumsum(bit == 0, out=self.zeros[level, 1:])
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def report(self, low: np.ndarray, high: np.ndarray, least: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For queries with places low to high and values least to past (both without the end): (query, value) of all that lie in both."""
        query = np.flatnonzero((low < high) & (least < past))
        low, high, value = low[query], high[query], np.zeros(len(query), dtype=np.int64)
        for level in range(self.bits):
            zeros, step = self.zeros[level], 1 << (self.bits - 1 - level)
            a, b = zeros[low], zeros[high]
            right = value + step
            go_left, go_right = (a < b) & (value + step > least[query]) & (value < past[query]), (high - low > b - a) & (right + step > least[query]) & (right < past[query])
            at = zeros[-1]
            query, low, high, value = (
                np.concatenate([query[go_left], query[go_right]]), np.concatenate([a[go_left], at + low[go_right] - a[go_right]]),
                np.concatenate([b[go_left], at + high[go_right] - b[go_right]]), np.concatenate([value[go_left], right[go_right]]),
            )
        return query, value


def _intervals(common: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of an order the interval that shares ``depth`` code points with it; common: what each shares with the one before (-1: nothing may be shared)."""
    starts = np.flatnonzero(common < depth)
    n = np.diff(np.r_[starts, len(common)])
    return np.repeat(starts, n), np.repeat(starts + n, n)


def _order(letters: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by (part, letters) and how much each place has in common with the one before."""
    order = np.lexsort((np.ascontiguousarray(letters).view(f"S{letters.shape[1]}").ravel(), part))
    rows, parts = letters[order], part[order]
    same = np.concatenate([rows[1:] == rows[:-1], np.zeros((max(0, len(rows) - 1), 1), dtype=bool)], axis=1)
    common = np.where(parts[1:] == parts[:-1], same.argmin(axis=1), -1)
    return order, np.r_[-1, common].astype(np.int64)[: len(rows)]


def near_pairs(words: list[bytes], cls: int, first: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (s, t) of near words of class ``cls``: len(s) is cls, len(t) is cls or cls + 1, and the edit's position lies in the row's [first, past).

    Of words of one length both orders are given. Only rows of equal (first, past) meet."""
    n, width = len(words), cls + 2
    size = np.array([len(w) for w in words])
    letters = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(n, width)
    turned = np.frombuffer(b"".join(w[::-1].ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(n, width)
    part = first.astype(np.int64) * (cls + 3) + past
    (front, front_common), (back, back_common) = _order(letters, part), _order(turned, part)
    place_front, place_back = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    place_front[front], place_back[back] = np.arange(n), np.arange(n)
    shorts = np.flatnonzero(size == cls)
    sides = []
    for role in (cls, cls + 1):  # of each length: its tree, and how many of its words stand before a place of either order
        own = size == role
        before_front, before_back = np.r_[0, np.cumsum(own[front])], np.r_[0, np.cumsum(own[back])]
        rows_back = back[own[back]]
        sides.append((WaveletTree(before_back[place_back[front[own[front]]]]), before_front, before_back, rows_back))
    ends: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    asked: list[list[tuple]] = [[], []]
    for i in range(int(first.min(initial=0)), cls + 1):
        s = shorts[(first[shorts] <= i) & (i < past[shorts])]
        if not len(s):
            continue
        low, high = (x[place_front[s]] for x in _intervals(front_common, i))
        keep = high - low > 1
        s, low, high = s[keep], low[keep], high[keep]
        for role, depth in ((0, cls - i - 1), (1, cls - i)):
            if depth < 0 or not len(s):
                continue
            if depth not in ends:
                ends[depth] = _intervals(back_common, depth)
            least, past_back = (x[place_back[s]] for x in ends[depth])
            _, before_front, before_back, _ = sides[role]
            query = np.stack([s, np.full(len(s), i), before_front[low], before_front[high], before_back[least], before_back[past_back]])
            more = 1 - role  # of its own length, a word meets itself
            asked[role].append(query[:, (query[3] - query[2] > more) & (query[5] - query[4] > more)])
        ends.pop(cls - i + 1, None)
    out = []
    for role, (tree, _, _, rows_back) in enumerate(sides):
        if not asked[role] or not tree.n:
            continue
        s, i, *box = np.concatenate(asked[role], axis=1)
        found, value = tree.report(*box)
        s, i, t = s[found], i[found], rows_back[value]
        new = s != t if role == 0 else letters[t, i] != letters[s, i]  # past its end a word has a zero
        out.append((s[new], t[new]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _summed(words: list[bytes], counts: np.ndarray, s: np.ndarray, t: np.ndarray, both: np.ndarray) -> pa.RecordBatch:
    """word, n_near, best, best_n of the rows that have neighbours; ``both``: pairs to be counted from either end."""
    named, word = np.unique(np.array(words, dtype=object), return_inverse=True)
    n = np.zeros(len(named), dtype=np.int64)
    n[word] = counts
    a, b = word[np.r_[s, t[both]]], word[np.r_[t, s[both]]]
    order = np.lexsort((b, -n[b], a))
    a, b = a[order], b[order]
    start = np.flatnonzero(np.r_[True, a[1:] != a[:-1]][: len(a)])
    near = np.diff(np.r_[start, len(a)])
    text = lambda at: pa.array([named[x].decode("latin-1") for x in at.tolist()], pa.string())
    return pa.RecordBatch.from_arrays([text(a[start]), pa.array(near.astype(np.int64)), text(b[start]), pa.array(n[b[start]])], ["word", "n_near", "best", "best_n"])


def _group():
    """What the words of a group share: front and end (of a word of the class's length, s[b:]; of one longer, t[b + 1:])."""
    end = F.expr("if(length(word) = cls, substr(word, b + 1), substr(word, b + 2))")
    return F.xxhash64("cls", "a", "b", F.expr("substr(word, 1, a)"), end)


def grouped(words: DataFrame) -> DataFrame:
    """word, n, cls, a, b, grp: each word in both classes and all groups that it belongs to, no group being crowded."""
    classes = words.withColumn("cls", F.explode(F.expr("array(length(word), length(word) - 1)")))
    halves = F.expr("array(struct(0 as a, cast(cls div 2 as int) as b), struct(cast(cls div 2 as int) as a, cls + 1 as b))")
    rows = classes.withColumn("h", F.explode(halves)).select("word", "n", "cls", "h.a", "h.b").where("a < b").withColumn("grp", _group())
    done = []
    while True:
        rows = materialise(rows, "spelling-groups")
        crowded = materialise(rows.where("b - a > 1").groupBy("cls", "grp").count().where(F.col("count") > CROWD).select("cls", "grp"), "crowded")
        if crowded.isEmpty():
            done.append(rows)
            break
        done.append(picked(rows, crowded, ["cls", "grp"], "left_anti").select(*rows.columns))
        split = picked(rows, crowded, ["cls", "grp"])
        halves = F.expr("array(struct(a as a, cast((a + b) div 2 as int) as b), struct(cast((a + b) div 2 as int) as a, b as b))")
        rows = split.withColumn("h", F.explode(halves)).select("word", "n", "cls", "h.a", "h.b").withColumn("grp", _group())
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def neighbours(words: DataFrame) -> DataFrame:
    """word, n_near, best, best_n: how many near words each of ``words`` (word, n) has, and the one of largest n; words without any are left out."""
    rows = grouped(words)
    sizes = rows.groupBy("cls").agg(F.ceil(F.sum(F.length("word")) / SHARD).alias("shards"))  # a row for each length
    dealt = rows.join(F.broadcast(sizes), "cls").withColumn("shard", F.pmod("grp", "shards"))

    def of(key, held):
        cls, words, counts, first, past = key[0], *(np.concatenate(x) for x in zip(*held))
        words = [w.encode("latin-1") for w in words]
        s, t = near_pairs(words, cls, first, past)
        size = np.array([len(w) for w in words])
        return _summed(words, counts, s, t, size[s] != size[t])

    def run(batches):
        last, held = None, []
        for batch in batches:
            cls, shard = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            columns = [np.array(batch.column(2).to_pylist(), dtype=object), *(batch.column(k).to_numpy() for k in (3, 4, 5))]
            edges = np.flatnonzero(np.r_[True, (cls[1:] != cls[:-1]) | (shard[1:] != shard[:-1])][: len(cls)]).tolist()
            for low, high in zip(edges, [*edges[1:], len(cls)]):
                key = (int(cls[low]), int(shard[low]))
                if key != last and held:
                    yield of(last, held)
                    held = []
                last = key
                held.append([c[low:high] for c in columns])
        if held:
            yield of(last, held)

    sorted_rows = dealt.select("cls", "shard", "word", "n", "a", "b").repartition("cls", "shard").sortWithinPartitions("cls", "shard")
    found = sorted_rows.mapInArrow(run, "word string, n_near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("x")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", "x.best", (-F.col("x.m")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the pointers of (word, form) lead, by doubling them until none moves."""
    at = materialise(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        next_ = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = materialise(picked(at, materialise(next_, "pointers"), ["root"], "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "forms")
        at = moved.select("word", "root")
        if moved.where("_moved").isEmpty():
            return at


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """word, n, n_near, form, form_n, root of ``words`` (word, n)."""
    words = materialise(words, "words")
    near = neighbours(words)
    has = (F.col("best_n") >= ratio * F.col("n")).alias("has")
    out = materialise(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")), "variants")
    led = roots(out.where("form is not null"))
    return picked(out, led, ["word"], "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))

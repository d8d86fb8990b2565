"""Token counts of a byte-fallback piece model, by merging ragged arrays rank by rank.

A text is cut into pre-tokens no merge can cross: runs of blanks with the word that follows,
and line breaks. The pre-tokens of a batch that have not been counted before lie end to end in
one array of symbol ids with their lengths. Each round takes every pre-token's pair of the lowest
rank at once (the leftmost of equal ones), joins it, and closes the gaps, until no pre-token
has a pair left that the vocabulary knows. What survives is counted: a known symbol as one
token, a character outside the vocabulary as one token for each of its UTF-8 bytes.

Where no longer piece of a better rank begins or ends with the joined one, joining it cannot
make a pair that should come before its other places; then all of them are joined in the round.

Defined results: a null or empty text has no tokens. The model file's strings for special
tokens are ordinary text. Repeated rows are counted one by one, a null id as any other; extra columns are ignored; an
empty table gives no rows. Texts are read whole, a long one takes about forty times its size in the task.
"""

from __future__ import annotations

import functools
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.staging import bound_batches

BLANK = "▁"
#: Counted pre-tokens that a Python process remembers; longer ones than LONG characters are not kept.
REMEMBERED, LONG = 300_000, 48
#: Symbols that are merged together in one array at most, unless one pre-token alone has more.
AT_ONCE = 1 << 20
NONE = np.int64(1) << 40
_RUNS = re.compile("▁+[^▁\n]*|[^▁\n]+|\n")


class PieceMerger:
    """The merge table of a BPE piece model."""

    def __init__(self, pieces: list[tuple[str, float]]):
        """pieces: the ordinary pieces and their scores; a higher score is merged earlier."""
        names = [p for p, _ in pieces]
        scores = np.array([s for _, s in pieces], dtype=float)
        _, rank = np.unique(-scores, return_inverse=True)
        self.index = {p: i for i, p in enumerate(names)}
        self.rank = rank.astype(np.int64)
        n = len(names)
        left, right, out = [], [], []
        every = np.zeros(n, dtype=bool)
        tied = np.bincount(self.rank, minlength=n)[self.rank] > 1
        for i, p in enumerate(names):
            for cut in range(1, len(p)):
                a, b = self.index.get(p[:cut]), self.index.get(p[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), out.append(i)
        at = np.argsort(np.array(left, dtype=np.int64) * n + np.array(right, dtype=np.int64), kind="stable")
        self.n = n
        self.pairs = (np.array(left, dtype=np.int64) * n + np.array(right, dtype=np.int64))[at]
        self.made = np.array(out, dtype=np.int64)[at]
        best = np.full(n, np.iinfo(np.int64).max)  # of the longer pieces that begin or end with a piece, the best rank
        for i, p in enumerate(names):
            for part in {p[:c] for c in range(1, len(p))} | {p[c:] for c in range(1, len(p))}:
                if (j := self.index.get(part)) is not None and self.rank[i] < best[j]:
                    best[j] = self.rank[i]
        every[:] = (best > self.rank) & ~tied
        self.every = every
        self.broken = any("\n" in p for p in names) or any(BLANK in p.lstrip(BLANK) for p in names)
        if self.broken:
            raise ValueError("a piece crosses a pre-token's border")

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or -1."""
        key = np.where((left < 0) | (right < 0), -1, left * self.n + right)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.made[at], -1)

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        out, start, size = np.zeros(len(words), dtype=np.int64), 0, 0
        for i, w in enumerate(words):
            if size and size + len(w) > AT_ONCE:
                out[start:i] = self._counts(words[start:i])
                start, size = i, 0
            size += len(w)
        out[start:] = self._counts(words[start:])
        return out

    def _counts(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0, dtype=np.int64)
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        known, back = np.unique(chars, return_inverse=True)
        ids = np.array([self.index.get(chr(c), -1) for c in known], dtype=np.int64)
        width = np.array([1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000) for c in known], dtype=np.int64)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        sym = ids[back]
        total = np.bincount(word, weights=np.where(sym < 0, width[back], 1), minlength=len(words)).astype(np.int64)
        made = self.lookup(sym[:-1], sym[1:]) if len(sym) > 1 else np.zeros(0, dtype=np.int64)
        made = np.append(made, -1)
        made[:-1][word[:-1] != word[1:]] = -1
        while True:
            rank = np.where(made >= 0, self.rank[made], NONE)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.minimum.reduceat(rank, first) if len(rank) else rank
            go = low < NONE
            if not go.any():
                return total
            spans = np.diff(np.r_[first, len(word)])
            if not go.all():  # what has no pair left is counted
                keep = np.repeat(go, spans)
                sym, word, made, rank = sym[keep], word[keep], made[keep], rank[keep]
                low, spans = low[go], spans[go]
            hit = np.flatnonzero(rank == np.repeat(low, spans))
            every = self.every[made[hit]]
            head = np.r_[True, word[hit][1:] != word[hit][:-1]]
            # of overlapping places in a run, every second one from the left; elsewhere the leftmost alone
            run = np.r_[True, (hit[1:] != hit[:-1] + 1)]
            begin = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            take = hit[np.where(every, (np.arange(len(hit)) - begin) % 2 == 0, head)]
            total -= np.bincount(word[take], minlength=len(total))
            sym[take] = made[take]
            alive = np.ones(len(sym), dtype=bool)
            alive[take + 1] = False
            where = np.cumsum(alive)[take] - 1
            sym, word, made = sym[alive], word[alive], made[alive]
            for at in (where, where - 1):  # only the neighbours of what was joined have new pairs
                at = at[at >= 0]
                after = np.minimum(at + 1, len(sym) - 1)
                same = (at < len(sym) - 1) & (word[at] == word[after])
                made[at] = np.where(same, self.lookup(sym[at], sym[after]), -1)


@functools.lru_cache(maxsize=2)
def merger(model_file: str) -> PieceMerger:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    plain = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    return PieceMerger([(m.id_to_piece(i), m.get_score(i)) for i in plain])


class Counter:
    """Counts tokens of texts; remembers counted pre-tokens up to a bound."""

    def __init__(self, table: PieceMerger):
        self.table, self.seen = table, {}

    def counts(self, texts: list[str | None]) -> np.ndarray:
        cut = [self.pre_tokens(t) for t in texts]
        seen = self.seen
        new = set(itertools.chain.from_iterable(cut)).difference(seen)
        if new:
            if len(seen) + len(new) > REMEMBERED:
                seen.clear()
                new = set(itertools.chain.from_iterable(cut))
            new = list(new)
            seen.update(zip(new, self.table.counts(new).tolist()))
        out = np.array([sum(map(seen.__getitem__, words)) for words in cut], dtype=np.int64)
        for w in [w for w in new if len(w) > LONG]:
            del seen[w]
        return out

    @staticmethod
    def pre_tokens(text: str | None) -> list[str]:
        if not text:
            return []
        if " " not in text and "\n" not in text:
            return _RUNS.findall(BLANK + text)
        text = BLANK + text.replace(" ", BLANK)
        if BLANK + BLANK in text or text.endswith(BLANK) or BLANK + "\n" in text:
            return _RUNS.findall(text)
        first, *lines = text.split("\n")
        out = [BLANK + w for w in first.split(BLANK)[1:]]
        for line in lines:
            head, *words = line.split(BLANK)
            out.append("\n")
            if head:
                out.append(head)
            out += [BLANK + w for w in words]
        return out


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_bytes, n_tokens and whether these are more than ``limit``, for every whole text."""
    bound_batches(docs.sparkSession)
    own = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_t"))

    def run(batches):
        counter = Counter(merger(model_file))
        for batch in batches:
            texts = batch.column(1)
            n = counter.counts(texts.to_pylist())
            size = np.diff(np.frombuffer(texts.cast(pa.large_string()).buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], [key, "n_bytes", "n_tokens", "over_limit"])

    return own.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")

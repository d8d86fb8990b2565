"""Suffix arrays by induced sorting, and permuted common prefixes, in vector form.

``suffix_array`` classifies suffixes as smaller or larger than the next, sorts the substrings between
leftmost smaller suffixes by one induction, names them, sorts the string of names by the same
procedure and induces the whole array from that order. An induction goes through the buckets of the symbols in
order. Symbols with many suffixes are taken one by one: all suffixes of the bucket that are known at the time
place their predecessors at once, so a run of one symbol takes as many steps as it is long. Symbols with few
are taken in groups of neighbours: the group's suffixes in their order, with those that they place within the group
put in until there are no more, place the others at once. So large alphabets of names take few steps, too.
"""

from __future__ import annotations

import numpy as np

#: Suffixes up to which neighbouring symbols are taken as a group.
GROUP = 4096


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``text`` (whole numbers from 0) in order; a suffix that is a prefix of another comes first."""
    if not len(text):
        return np.zeros(0, dtype=np.int64)
    t = np.zeros(len(text) + 1, dtype=np.int32)
    t[:-1] = text
    t[:-1] += 1
    return _sorted(t, int(t.max()) + 1)[1:]


def _smaller(t: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the next; the last counts as smaller."""
    n = len(t)
    last = np.flatnonzero(np.append(t[1:] != t[:-1], True))  # of each run
    return np.repeat(np.append(t[last[:-1]] < t[last[:-1] + 1], True), np.diff(last, prepend=-1))


def _sorted(t: np.ndarray, symbols: int) -> np.ndarray:
    n = len(t)
    if n == 1:
        return np.zeros(1, dtype=np.int32)
    smaller = _smaller(t)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    sa = _induced(t, symbols, smaller, lms)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]
    name_at, names = _named(t, lms, order)
    if names == len(lms):
        ordered = order
    else:
        ordered = lms[_sorted(name_at, names)]
    return _induced(t, symbols, smaller, ordered)


def _named(t: np.ndarray, lms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Names (from 0, in order) of the substrings between leftmost smaller suffixes, by place in the text."""
    n = len(t)
    span = np.zeros(n, dtype=np.int32)
    span[lms] = np.diff(np.append(lms, n - 1))
    differ = span[order[:-1]] != span[order[1:]]
    live, d = np.flatnonzero(~differ), 0
    a, b = order[:-1][live], order[1:][live]
    while len(live):  # up to the first symbol of the next, which lies in the text
        equal = t[a + d] == t[b + d]
        differ[live[~equal]] = True
        equal &= span[a] > d
        live, a, b = live[equal], a[equal], b[equal]
        d += 1
    name = np.cumsum(np.r_[0, differ])
    where = np.zeros(n, dtype=np.int32)
    where[order] = name
    return where[lms], int(name[-1]) + 1


def _groups(count: np.ndarray, start: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of used symbols: those of many suffixes alone, neighbours of few together."""
    used = np.flatnonzero(count)
    many = count[used] > GROUP // 8
    window = start[used] // GROUP
    new = np.ones(len(used), dtype=bool)
    new[1:] = many[1:] | many[:-1] | (window[1:] != window[:-1])
    first = np.flatnonzero(new)
    return list(zip(used[first].tolist(), (used[np.r_[first[1:], len(used)] - 1] + 1).tolist()))


def _induced(t: np.ndarray, symbols: int, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The order of all suffixes from an order of the leftmost smaller ones."""
    n = len(t)
    count = np.bincount(t, minlength=symbols)
    start = np.r_[0, np.cumsum(count)]
    sa = np.full(n, -1, dtype=np.int32)
    by = np.argsort(t[lms].astype(np.uint16 if symbols < 1 << 16 else t.dtype), kind="stable")
    seeds, seed_at = lms[by], np.r_[0, np.cumsum(np.bincount(t[lms], minlength=symbols))]
    head, tail = start[:-1].copy(), start[1:].copy()
    narrow = np.uint16 if symbols < 1 << 16 else t.dtype  # short keys are sorted by counting

    def put(before: np.ndarray, symbol: np.ndarray, up: bool) -> None:
        if not len(before):
            return
        if len(before) == 1:
            c = symbol[0]
            if up:
                sa[head[c]] = before[0]
                head[c] += 1
            else:
                tail[c] -= 1
                sa[tail[c]] = before[0]
            return
        order = np.argsort(symbol.astype(narrow, copy=False), kind="stable")
        symbol, before = symbol[order], before[order]
        new = np.ones(len(symbol) + 1, dtype=bool)
        np.not_equal(symbol[1:], symbol[:-1], out=new[1:-1])
        first = np.flatnonzero(new)
        size = np.diff(first)
        each = symbol[first[:-1]]
        if up:
            sa[np.arange(len(symbol)) + np.repeat(head[each] - first[:-1], size)] = before
            head[each] += size
        else:
            sa[np.repeat(tail[each] - 1 + first[:-1], size) - np.arange(len(symbol))] = before
            tail[each] -= size

    places = np.zeros((2, n), dtype=bool)  # suffixes whose predecessor is placed, downwards and upwards
    places[0, 1:], places[1, 1:] = smaller[:-1], ~smaller[:-1]

    def placed_by(found: np.ndarray, up: bool) -> np.ndarray:
        return found[places[int(up)][found]] - 1

    def place(found: np.ndarray, up: bool) -> None:
        before = placed_by(found, up)
        put(before, t[before], up)

    def group(a: int, b: int, own: np.ndarray, others: np.ndarray, up: bool) -> None:
        """own: suffixes of the kind that is placed, others: of the other kind, both of the symbols from a to b - 1 and in the order in which they are met."""
        inner = own[:0]
        while True:
            items = np.concatenate([own, inner, others])
            symbol = t[items]
            symbol = symbol - a if up else b - 1 - symbol
            items = items[np.argsort(symbol.astype(np.uint16) if b - a < 1 << 16 else symbol, kind="stable")]
            before = placed_by(items, up)
            symbol = t[before]
            within = symbol < b if up else symbol >= a
            if np.count_nonzero(within) == len(inner):
                break
            inner = before[within]
        put(inner, t[inner], up)
        put(before[~within], symbol[~within], up)

    ranges = _groups(count, start)
    for a, b in ranges:  # larger suffixes, from the front of each bucket
        if b - a > 1:
            own = sa[start[a] : start[b]]
            group(a, b, own[own >= 0], seeds[seed_at[a] : seed_at[b]], True)
            continue
        at = start[a]
        while at < head[a]:
            end = head[a]
            place(sa[at:end], True)
            at = end
        place(seeds[seed_at[a] : seed_at[b]], True)
    for a, b in ranges[::-1]:  # smaller suffixes, from the back
        if a == 0 and b == 1:
            continue
        if b - a > 1:
            both = sa[start[a] : start[b]][::-1]
            both = both[both >= 0]
            kind = smaller[both]
            group(a, b, both[kind], both[~kind], False)
            continue
        at = start[b]
        while at > tail[a]:
            end = tail[a]
            place(sa[end:at][::-1], False)
            at = end
        place(sa[start[a] : head[a]][::-1], False)
    sa[0] = n - 1
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, most: int, stride: int = 16, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Before-neighbours and permuted common prefixes: by place in the text, the suffix before it in the order (-1: none) and the length, up to ``most``, of what both share.

    ``text``: bytes. A suffix shares at least one byte less than the one that starts a byte before
    it, so the lengths at every ``stride``-th place bound those between. ``wanted`` marks the places whose lengths are asked; those of others
    may be too short then."""
    n = len(text)
    wanted = np.ones(n, dtype=bool) if wanted is None else wanted
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.r_[text, np.zeros(most + 16, dtype=np.uint8)]
    words = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded.tobytes(), strides=(1,))
    shared = np.zeros(n, dtype=np.int64)

    def extend(at: np.ndarray) -> None:
        at = at[before[at] >= 0]
        while len(at):
            p, q, d = at, before[at], shared[at]
            x = words[p + d] ^ words[q + d]
            low = x & (~x + np.uint64(1))
            same = np.where(x == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
            left = np.minimum(most, n - np.maximum(p, q))
            shared[at] = np.minimum(d + same, left)
            at = at[(x == 0) & (d + same < left)]

    places = np.arange(0, n, stride)
    extend(places[np.logical_or.reduceat(wanted, places)] if n else places)
    base = np.repeat(shared[::stride], stride)[:n]
    shared = np.where(base >= most, np.maximum(base - np.arange(n) % stride, 0), np.maximum(base - np.arange(n) % stride, shared))
    shared[before < 0] = 0
    extend(np.flatnonzero(wanted & (np.arange(n) % stride != 0)))
    return before, shared

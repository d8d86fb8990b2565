"""Line deduplication that can be undone: sharded cuckoo filters in front of exact reference counts.

A line's key is the line without white space (space, tab to carriage return) at its ends and with A-Z lower-cased; keys shorter than ``shortest``
code points don't count. A store holds, in written tables of the shared folder:

* ``holders``: which document holds which key (128 bits of its BLAKE2 hash), as inserted;
* ``refs``: for each key, in how many documents it stands and the largest id among them, exactly;
* ``filters``: cuckoo filters of 16-bit fingerprints, in shards of bounded size, of all keys that stand in at least ``least`` documents.

``insert`` adds documents: their keys are summed before they are shuffled, merged with the counts, and those that reach ``least``
enter a filter. ``delete`` takes documents back: counts and largest ids of their keys are counted anew from the
holders that are left, and keys that fall below ``least`` leave their filter, which a cuckoo filter allows. So a store after
insertions and deletions answers as one into which only the remaining documents were put. Each change is written aside
and counts once its one-row commit is there; a change that died leaves nothing that is read. ``compact`` folds all changes into one.

``strip`` tests every line in its task against the filters; only lines that pass are joined with the exact counts, so the
filters' false positives change nothing. A line goes if its key stands in at least ``least`` documents and the document isn't the one
of the largest id. The filters are sent to the tasks up to ``SENT`` bytes (some 25 million repeated keys); beyond that every key is joined, with the same result.

Defined results: a null text is empty; an empty text is one empty line. A document is its id: rows of one id count
as one document, and all keep the lines that their id keeps. Rows without an id count as one document below all ids; they can't be deleted. A row inserted again, under an id that the
store holds, adds its new keys to that document. Texts are read whole; columns of the input stay, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.staging import bound_batches, materialise, new_path, picked

#: Keys of a filter's shard, as a mean; bytes of filters that are sent to tasks.
SHARD, SENT = 1 << 16, 64 << 20
SPACE = b" \t\n\x0b\x0c\r"
_REFS = "h1 long, h2 long, n long, last long, home int, seq int"
_HOLDERS = "doc_id long, h1 long, h2 long, seq int"
_FILTERS = "home int, shard int, shards int, seq int, slots binary, stash array<long>"
_GONE = "doc_id long, seq int"
_TABLES = {"holders": _HOLDERS, "refs": _REFS, "filters": _FILTERS, "gone": _GONE}


class Cuckoo:
    """A cuckoo filter over 64-bit hashes: two buckets of four fingerprints a hash, each bucket given by the other and the fingerprint.

    What finds no place after many moves goes to a stash, so a hash that was added is always found."""

    SLOTS, LOAD, MOVES = 4, 0.8, 200

    def __init__(self, slots: np.ndarray, stash: np.ndarray):
        self.slots, self.stash = slots, stash

    @classmethod
    def sized(cls, n: int) -> Cuckoo:
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, n) / (cls.SLOTS * cls.LOAD) + 1))))
        return cls(np.zeros((buckets, cls.SLOTS), dtype=np.uint16), np.zeros(0, dtype=np.int64))

    @classmethod
    def read(cls, slots: bytes, stash) -> Cuckoo:
        return cls(np.frombuffer(slots, dtype="<u2").reshape(-1, cls.SLOTS).copy(), np.array(stash, dtype=np.int64))

    def _across(self, prints: np.ndarray) -> np.ndarray:
        """What leads from one bucket of a fingerprint to the other."""
        return ((prints.astype(np.uint64) * np.uint64(0x5BD1E995)) >> np.uint64(7)).astype(np.int64) & (len(self.slots) - 1)

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bits = hashes.astype(np.int64).view(np.uint64)
        prints = (bits >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        a = (bits & np.uint64(len(self.slots) - 1)).astype(np.int64)
        return prints, a, a ^ self._across(prints)

    def _stashed(self, prints: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return np.minimum(bucket, bucket ^ self._across(prints)) << 16 | prints

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        prints, a, b = self._places(hashes)
        found = (self.slots[a] == prints[:, None]).any(axis=1) | (self.slots[b] == prints[:, None]).any(axis=1)
        return found | np.isin(self._stashed(prints, a), self.stash) if len(self.stash) else found

    def add(self, hashes: np.ndarray) -> None:
        prints, at, _ = self._places(hashes)
        rng = np.random.default_rng(len(hashes))
        for move in range(self.MOVES):
            if not len(at):
                return
            order = np.argsort(at, kind="stable")
            prints, at = prints[order], at[order]
            first = np.r_[True, at[1:] != at[:-1]]
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            taken = self.slots[at] != 0
            fits = nth < (~taken).sum(axis=1)
            free = np.argsort(taken, axis=1, kind="stable")  # free slots first
            self.slots[at[fits], free[fits, nth[fits]]] = prints[fits]
            prints, at, first = prints[~fits], at[~fits], np.r_[True, at[~fits][1:] != at[~fits][:-1]][: int((~fits).sum())]
            if move % 2:  # the other bucket is full too: one of each bucket takes a slot, and what stood there moves on
                slot = rng.integers(0, self.SLOTS, len(at))
                there = self.slots[at[first], slot[first]]
                self.slots[at[first], slot[first]] = prints[first]
                prints = prints.copy()
                prints[first] = there
            at = at ^ self._across(prints)
        self.stash = np.concatenate([self.stash, self._stashed(prints, at)])

    def remove(self, hashes: np.ndarray) -> None:
        """Takes one fingerprint of each hash away; all of them must have been added."""
        prints, a, b = self._places(hashes)
        while len(a):
            _, once = np.unique(self._stashed(prints, a), return_index=True)  # equal fingerprints go one after another
            for bucket in (a, b):
                hit = self.slots[bucket[once]] == prints[once][:, None]
                there = hit.any(axis=1)
                self.slots[bucket[once[there]], hit[there].argmax(axis=1)] = 0
                rest, once = once[there], once[~there]
                prints[rest] = 0  # done
            for x in self._stashed(prints[once], a[once]):
                self.stash = np.delete(self.stash, np.flatnonzero(self.stash == x)[:1])
            prints[once] = 0
            left = prints != 0
            prints, a, b = prints[left], a[left], b[left]


def line_key(line: bytes, shortest: int) -> bytes | None:
    """The hash of a line's key; None if the key is too short."""
    key = line.strip(SPACE)
    if len(key) < shortest or (not key.isascii() and len(key.decode(errors="replace")) < shortest):
        return None
    return blake2b(key.lower(), digest_size=16).digest()


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [x or b"" for x in batch.column(batch.schema.names.index(name)).cast(pa.binary()).to_pylist()]


def _keys(text: bytes, shortest: int) -> set[bytes]:
    found = {line_key(line, shortest) for line in text.split(b"\n")} if len(text) >= shortest else set()
    return found - {None}


def _flat(rows, names: list[str], n: list[int], digests: list[bytes]) -> pa.RecordBatch:
    both = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
    at = pa.array(np.repeat(np.arange(len(n)), n))
    return pa.RecordBatch.from_arrays([*(x.take(at) for x in rows), pa.array(both[:, 0]), pa.array(both[:, 1])], [*names, "h1", "h2"])


def _held(docs: DataFrame, shortest: int) -> DataFrame:
    """doc_id, h1, h2: the distinct keys of each row (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = [_keys(t, shortest) for t in _texts(batch, "text")]
            yield _flat([batch.column(0)], ["doc_id"], [len(f) for f in found], [d for f in found for d in f])

    return docs.mapInArrow(run, "doc_id long, h1 long, h2 long")


@dataclass(frozen=True)
class LineStore:
    """A store at ``root``; all its state is in files, so that any driver can go on with it. One writer at a time: of two that commit the same change number the second fails."""

    spark: SparkSession
    root: str
    least: int = 3
    shortest: int = 20

    @classmethod
    def new(cls, spark: SparkSession, least: int = 3, shortest: int = 20) -> LineStore:
        return cls(spark, new_path(spark, "line-store"), least, shortest)

    def _commits(self) -> list:
        """Committed changes in order, from the last that folds all before it."""
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.root}/commits")
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return []
        names = [str(s.getPath().toString()) for s in fs.listStatus(where) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        found = sorted(r for r in self.spark.read.parquet(*names).collect()) if names else []  # a row a change
        folds = [i for i, r in enumerate(found) if r.whole]
        return found[folds[-1] :] if folds else found

    def _read(self, name: str, commits=None) -> DataFrame:
        paths = [f"{r.path}/{name}" for r in (self._commits() if commits is None else commits)]
        return self.spark.read.schema(_TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], _TABLES[name])

    def _commit(self, seq: int, path: str, whole: bool = False) -> None:
        self.spark.createDataFrame([(seq, path, whole)], "seq int, path string, whole boolean").coalesce(1).write.parquet(f"{self.root}/commits/{seq:09d}")

    def _write(self, path: str, name: str, df: DataFrame | None) -> DataFrame:
        schema = self.spark.createDataFrame([], _TABLES[name]).schema
        (self.spark.createDataFrame([], schema) if df is None else df.select(*schema.names)).write.parquet(f"{path}/{name}")
        return self.spark.read.schema(schema).parquet(f"{path}/{name}")

    def _next(self) -> tuple[list, int, str]:
        commits = self._commits()
        seq = commits[-1].seq + 1 if commits else 0
        return commits, seq, new_path(self.spark, f"lines-{seq}")

    def holders(self, commits=None) -> DataFrame:
        """doc_id, h1, h2 of all documents that are in the store."""
        commits = self._commits() if commits is None else commits
        rows = self._read("holders", commits)
        gone = self._read("gone", commits).groupBy("doc_id").agg(F.max("seq").alias("_gone"))
        if gone.isEmpty():
            return rows.select("doc_id", "h1", "h2")
        return picked(rows, materialise(gone, "gone"), ["doc_id"], "left").where("_gone is null or seq > _gone").select("doc_id", "h1", "h2")

    def refs(self, commits=None) -> DataFrame:
        """h1, h2, n (documents), last (largest id), home (the change whose filters hold the key, or null): the exact counts."""
        commits = self._commits() if commits is None else commits
        rows = self._read("refs", commits)
        if len(commits) > 1:
            rows = rows.groupBy("h1", "h2").agg(F.max_by(F.struct("n", "last", "home"), "seq").alias("x")).select("h1", "h2", "x.*")
        return rows.where("n > 0").select("h1", "h2", "n", "last", "home")

    def filters(self, commits=None) -> DataFrame:
        """The shards of all filters, as last written."""
        rows = self._read("filters", self._commits() if commits is None else commits)
        return rows.groupBy("home", "shard").agg(F.max_by(F.struct("shards", "slots", "stash"), "seq").alias("x")).select("home", "shard", "x.*")

    def _new_filters(self, path: str, seq: int, keys: DataFrame) -> None:
        """Filters of ``keys`` (h1, h2), written as the change's own."""
        n = keys.count()
        shards = 1 << max(0, int(np.ceil(np.log2(max(1, n) / SHARD))))

        def run(batches: Iterator[pa.RecordBatch]):
            held = {}
            for batch in batches:
                shard, h1 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for s in np.unique(shard).tolist():
                    held.setdefault(s, []).append(h1[shard == s])
            for s, parts in held.items():
                hashes = np.concatenate(parts)
                made = Cuckoo.sized(len(hashes))
                made.add(hashes)
                yield pa.RecordBatch.from_pylist([{"home": seq, "shard": s, "shards": shards, "seq": seq, "slots": made.slots.astype("<u2").tobytes(), "stash": made.stash.tolist()}], pa.schema([("home", pa.int32()), ("shard", pa.int32()), ("shards", pa.int32()), ("seq", pa.int32()), ("slots", pa.binary()), ("stash", pa.list_(pa.int64()))]))

        dealt = keys.select(F.col("h2").bitwiseAND(shards - 1).cast("int").alias("shard"), "h1").repartition(shards, "shard")
        self._write(path, "filters", dealt.mapInArrow(run, _FILTERS))

    def insert(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> None:
        """Put documents into the store."""
        bound_batches(self.spark)
        commits, seq, path = self._next()
        own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
        held = _held(own, self.shortest)
        if not own.groupBy("doc_id").count().where("count > 1").isEmpty():
            held = held.distinct()
        if commits:
            ids = materialise(own.select("doc_id").distinct(), "inserted-ids")
            before = materialise(self.holders(commits).alias("h").join(ids.alias("i"), F.expr("h.doc_id <=> i.doc_id"), "left_semi"), "held-before")
            held = held.alias("n").join(before.alias("o"), F.expr("n.doc_id <=> o.doc_id and n.h1 = o.h1 and n.h2 = o.h2"), "left_anti")
        fresh = self._write(path, "holders", held.withColumn("seq", F.lit(seq)))
        counted = fresh.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
        if commits:
            counted = materialise(counted, "counted")
            old = picked(self.refs(commits), counted.select("h1", "h2"), ["h1", "h2"]).select("h1", "h2", F.col("n").alias("_n"), F.col("last").alias("_last"), "home")
            counted = counted.join(old, ["h1", "h2"], "left").select("h1", "h2", (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"), F.greatest("last", "_last").alias("last"), "home")
        else:
            counted = counted.withColumn("home", F.lit(None).cast("int"))
        home = F.when(F.col("n") >= self.least, F.coalesce("home", F.lit(seq)))
        refs = self._write(path, "refs", counted.withColumn("home", home).withColumn("seq", F.lit(seq)))
        self._new_filters(path, seq, refs.where(F.col("home") == seq).select("h1", "h2"))
        self._write(path, "gone", None)
        self._commit(seq, path)

    def delete(self, ids: DataFrame, key: str = "doc_id") -> None:
        """Take the documents of these ids back; ids that aren't there change nothing."""
        commits, seq, path = self._next()
        gone = self._write(path, "gone", ids.select(F.col(key).cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("seq", F.lit(seq))).select("doc_id")
        held = self.holders(commits)
        keys = materialise(picked(held, gone, ["doc_id"]).select("h1", "h2").distinct(), "touched")
        left = picked(picked(held, keys, ["h1", "h2"]), gone, ["doc_id"], "left_anti").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("_n"), F.max("doc_id").alias("_last"))
        old = materialise(picked(self.refs(commits), keys, ["h1", "h2"]).join(left, ["h1", "h2"], "left"), "recounted")
        n = F.coalesce("_n", F.lit(0).cast("long"))
        self._write(path, "refs", old.select("h1", "h2", n.alias("n"), F.col("_last").alias("last"), F.when(n >= self.least, F.col("home")).alias("home"), F.lit(seq).alias("seq")))
        fallen = old.where((n < self.least) & F.col("home").isNotNull()).select("home", "h1", "h2")
        segments = self.filters(commits)
        width = segments.groupBy("home").agg(F.max("shards").alias("shards"))  # a row a change
        fallen = fallen.join(F.broadcast(width), "home").select("home", (F.col("h2").bitwiseAND(F.col("shards") - 1)).cast("int").alias("shard"), "h1")

        def without(segment, out):
            if not len(segment) or not len(out):
                return pd.DataFrame(columns=[c.split()[0] for c in _FILTERS.split(", ")], dtype=object)
            row = segment.iloc[0]
            filt = Cuckoo.read(row.slots, row.stash)
            filt.remove(out.h1.to_numpy(dtype=np.int64))
            return pd.DataFrame({"home": [row.home], "shard": [row.shard], "shards": [row.shards], "seq": [seq], "slots": [filt.slots.astype("<u2").tobytes()], "stash": [filt.stash.tolist()]})

        self._write(path, "filters", segments.groupBy("home", "shard").cogroup(fallen.groupBy("home", "shard")).applyInPandas(without, _FILTERS))  # a shard and its keys
        self._write(path, "holders", None)
        self._commit(seq, path)

    def compact(self) -> None:
        """Fold all changes into one; results stay the same."""
        commits, seq, path = self._next()
        self._write(path, "holders", self.holders(commits).withColumn("seq", F.lit(seq)))
        refs = self._write(path, "refs", self.refs(commits).withColumn("home", F.when(F.col("n") >= self.least, F.lit(seq))).withColumn("seq", F.lit(seq)))
        self._new_filters(path, seq, refs.where("home is not null").select("h1", "h2"))
        self._write(path, "gone", None)
        self._commit(seq, path, whole=True)

    def _candidates(self, docs: DataFrame, segments: DataFrame) -> DataFrame:
        """doc_id, print, h1, h2: the keys of rows (doc_id, print, text) that may be repeated."""
        size = segments.select(F.sum(F.length("slots") + 8 * F.size("stash"))).first()[0] or 0
        sent = self.spark.sparkContext.broadcast([tuple(r) for r in segments.select("home", "shard", "shards", "slots", "stash").collect()]) if size <= SENT else None
        shortest = self.shortest

        def run(batches: Iterator[pa.RecordBatch]):
            filters = None if sent is None else {}
            for home, shard, shards, slots, stash in sent.value if sent is not None else ():
                filters.setdefault(home, (shards, {}))[1][shard] = Cuckoo.read(slots, stash)
            for batch in batches:
                found = [_keys(t, shortest) for t in _texts(batch, "text")]
                out = _flat(batch.columns[:2], ["doc_id", "print"], [len(f) for f in found], [d for f in found for d in f])
                yield out if filters is None else out.filter(pa.array(_passed(filters, out.column(2).to_numpy(), out.column(3).to_numpy())))

        return docs.mapInArrow(run, "doc_id long, print long, h1 long, h2 long")

    def strip(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """The columns of docs with ``_n_lines``, ``_n_dropped`` and ``_kept``: the lines of each row that stay, as text."""
        bound_batches(self.spark)
        commits = self._commits()
        rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("print", F.xxhash64("text"))
        repeated = materialise(self.refs(commits).where(F.col("n") >= self.least).select("h1", "h2", "last"), "repeated")
        hits = picked(self._candidates(rows.select("doc_id", "print", "text"), self.filters(commits)), repeated, ["h1", "h2"], "inner").where("not (doc_id <=> last)")
        drops = hits.groupBy("doc_id", "print").agg(F.collect_set(F.struct("h1", "h2")).alias("gone")).select(F.col("doc_id").alias("_id"), F.col("print").alias("_print"), "gone")
        both = rows.join(drops, F.expr("print = _print and doc_id <=> _id"), "left").select("row", "text", "gone")
        shortest = self.shortest

        def run(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                lines, dropped, kept = [], [], []
                for t, gone in zip(_texts(batch, "text"), batch.column(2).to_pylist()):
                    own = t.split(b"\n")
                    out = {np.array([g["h1"], g["h2"]], dtype="<i8").tobytes() for g in gone or ()}
                    stay = [x for x in own if line_key(x, shortest) not in out] if out else own
                    lines.append(len(own)), dropped.append(len(own) - len(stay)), kept.append(b"\n".join(stay))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["row", "n_lines", "n_dropped", "kept"])

        made = both.mapInArrow(run, f"row {both.schema['row'].dataType.simpleString()}, n_lines long, n_dropped long, kept string")
        return made.select("row.*", F.col("n_lines").alias("_n_lines"), F.col("n_dropped").alias("_n_dropped"), F.col("kept").alias("_kept"))


def _passed(filters: dict[int, tuple[int, dict[int, Cuckoo]]], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Which keys one of the filters may hold."""
    out = np.zeros(len(h1), dtype=bool)
    for shards, parts in filters.values():
        shard = h2 & (shards - 1)
        for s, filt in parts.items():
            at = np.flatnonzero((shard == s) & ~out)
            out[at] = filt.contains(h1[at])
    return out

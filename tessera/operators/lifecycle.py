"""A knowledge graph that follows its documents: what is put in or taken out changes chunks, extractions, entities and relations in one commit.

The store keeps every chunk's extractions (``mentions`` of entities, ``claims`` of relations) beside the graph made of them. A change finds the names and pairs that
its chunks touch, counts these anew from all extractions that are left, and appends them; rows they overtake are marked, and one manifest
makes all of it visible. So readers see the graph before a change or after it, a change that dies is never seen, and documents that come and go leave nothing behind.

Of what a deletion touches, elements without any extraction left are deleted, the others rebuilt; all others are not read. An end of a relation that
no mention names is an UNKNOWN entity with its relations' descriptions and sources.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import SEP
from tessera.operators import merge
from tessera.plans.staging import materialise, picked, scratch
from tessera.plans.tables import Segments, State

MENTION = ["name", "type", "description", "source_id", "at", "pos"]
CLAIM = ["src", "tgt", "keywords", "description", "weight", "source_id", "at", "pos"]
ENTITY = ["name", "type", "description", "source_ids"]
RELATION = ["src", "tgt", "weight", "keywords", "description", "source_ids"]


def pair(src: str = "src", tgt: str = "tgt"):
    """The key of a relation, whichever way round."""
    return F.concat_ws(SEP, F.least(src, tgt), F.greatest(src, tgt))


#: What names a row of each table in changes.
KEYS = {"chunks": lambda: F.col("chunk"), "mentions": lambda: F.col("source_id"), "claims": lambda: F.col("source_id"), "entities": lambda: F.col("name"), "relations": pair}


class GraphTables(Segments):
    """The store's tables. Keys follow from other columns, so they aren't written."""

    codec = "zstd"

    def read(self, name: str, state: State | None = None) -> DataFrame:
        rows, key = super().read(name, state), KEYS.get(name)
        return rows if key is None or "key" in rows.columns else rows.withColumn("key", key())

    def write(self, name: str, frame: DataFrame, by: list[str] | None = None) -> dict:
        return super().write(name, frame.drop("key") if name in KEYS else frame, by)


#: Claims of which the graph is counted at a time, and the most such slices: the disk holds the shuffles of one.
SLICE_ROWS, SLICES = 10_000_000, 4


def merged_entities(mentions: DataFrame, claims: DataFrame, own: Callable[[str], Column] = lambda name: F.lit(True)) -> DataFrame:
    """Entities of mentions by the rules of merging, and ends of claims that none names; only those whose name is ``own``."""
    mentions = mentions.where(own("name"))
    ends = claims.where("src <> tgt").select(F.explode(F.array("src", "tgt")).alias("name"), F.lit("UNKNOWN").alias("type"), "description", "source_id", "at", "pos").where(own("name"))
    lone = merge.lone_ends(ends, mentions)
    return merge.entities(mentions.select(MENTION).unionByName(lone), written=True).select(ENTITY)


def rebuilt_entities(mentions: DataFrame, claims: DataFrame, own: Callable[[str], Column] = lambda name: F.lit(True)) -> DataFrame:
    """The same by the rules of a rebuild after a deletion."""
    return merge.rebuilt(mentions.where(own("name")), claims.where("src <> tgt").where(own("src") | own("tgt"))).where(own("name")).select(ENTITY)


class GraphStore:
    """A graph at ``root`` (a new one where none is given).

    ``after_deletion`` rebuilds what a deletion touches: by default with the rules of merging, so that the graph depends on its documents only and not on
    what was there once; ``(rebuilt_entities, merge.rebuilt_relations)`` are the rules of a rebuild. A rule for entities
    is also told which names count (``own``)."""

    def __init__(self, spark: SparkSession, root: str | None = None, after_deletion: tuple[Callable[..., DataFrame], Callable[..., DataFrame]] = (merged_entities, merge.described_relations)):
        self.spark, self.tables, self.after_deletion = spark, GraphTables(spark, root), after_deletion

    def read(self, name: str, state: State | None = None) -> DataFrame:
        """chunks, mentions, claims, entities or relations, as of a state."""
        state = state or self.tables.state()
        return self.tables.live(name, state, gone=f"gone-{name}").drop("key", "segment")

    def insert(self, chunks: DataFrame, mentions: DataFrame, claims: DataFrame) -> State:
        """Chunks (chunk, document, content) with what was extracted from them; chunks that are there already are replaced with their extractions."""
        new = {"chunks": chunks.select("chunk", "document", "content").withColumn("key", F.col("chunk"))}
        new |= {"mentions": mentions.select(MENTION).withColumn("key", F.col("source_id")), "claims": claims.select(CLAIM).withColumn("key", F.col("source_id"))}
        return self._change(new, chunks.select(F.col("chunk").alias("key")).distinct(), (merged_entities, merge.described_relations))

    def delete(self, documents: DataFrame) -> State:
        """Take documents (document) out, with their chunks and all that hangs on these alone."""
        before = self.tables.state()
        if not before.tables:
            return before
        with scratch(self.spark):
            held = self.tables.live("chunks", before, gone="gone-chunks")
            keys = picked(held, materialise(documents.select("document").distinct(), "deleted"), ["document"]).select("key").distinct()
            return self._change({}, keys, self.after_deletion)

    def _change(self, new: dict[str, DataFrame], keys: DataFrame, rules: tuple[Callable[..., DataFrame], Callable[..., DataFrame]]) -> State:
        with scratch(self.spark):
            before, keys = self.tables.state(), materialise(keys, "chunk-keys")
            segment, appended = before.version + 1, {}
            touched = {name: [rows] for name, rows in new.items()}
            for name in ("chunks", "mentions", "claims"):
                if before.folders(name):
                    touched.setdefault(name, []).append(picked(self.tables.live(name, before, gone=f"gone-{name}"), keys, ["key"]).drop("segment"))
                    appended |= self.tables.overtaken(name, keys, before, gone=f"gone-{name}")
                if name in new:
                    appended[name] = self.tables.write(name, new[name].withColumn("segment", F.lit(segment)))
            mid = State(segment, self.tables.with_more(before, appended))
            named = paired = None  # in a store that was empty all are touched
            if before.tables:
                said, claimed = (self._union(touched.get(x, [])) for x in ("mentions", "claims"))
                ends = claimed.select(F.explode(F.array("src", "tgt")).alias("name"))
                named = materialise(said.select("name").unionByName(ends).distinct(), "names")
                paired = materialise(claimed.where("src <> tgt").select(pair().alias("key")).distinct(), "pairs")
            slices = min(SLICES, 1 + self.read("claims", mid).count() // SLICE_ROWS)
            for name, rows, keyed in (("entities", self._entities, named), ("relations", self._relations, paired)):
                if keyed is not None:
                    appended |= self.tables.overtaken(name, keyed.toDF("key"), before, gone=f"gone-{name}")
                parts = []
                for i in range(slices):
                    own = lambda key, i=i: F.pmod(F.xxhash64(key), F.lit(slices)) == i
                    with scratch(self.spark):
                        parts.append(self.tables.write(name, rows(mid, keyed, rules, own).withColumn("segment", F.lit(segment))))
                appended[name] = {"schema": parts[0]["schema"], "folders": [f for p in parts for f in p["folders"]]}
            return self.tables.commit(before, appended=appended)

    def _entities(self, mid: State, names: DataFrame | None, rules: tuple[Callable[..., DataFrame], Callable[..., DataFrame]], own: Callable[[str], Column]) -> DataFrame:
        """Entities of some names (or all) that are in a slice, from what a state holds."""
        said, claims = self.read("mentions", mid).where(own("name")), self.read("claims", mid).where(own("src") | own("tgt"))
        if names is not None:
            said = picked(said, names, ["name"])
            for end in ("src", "tgt"):
                claims = picked(claims, names.select(F.col("name").alias(end), F.lit(True).alias(f"_{end}")), [end], "left")
            claims = claims.where("_src or _tgt").drop("_src", "_tgt")
        entities = rules[0](said, claims, own)
        return (entities if names is None else picked(entities, names, ["name"])).withColumn("key", F.col("name"))

    def _relations(self, mid: State, pairs: DataFrame | None, rules: tuple[Callable[..., DataFrame], Callable[..., DataFrame]], own: Callable[[str], Column]) -> DataFrame:
        """Relations of some pairs (or all), likewise."""
        claims = self.read("claims", mid).withColumn("key", pair()).where(own("key"))
        claims = (claims if pairs is None else picked(claims, pairs, ["key"])).drop("key")
        return rules[1](claims).select(RELATION).withColumn("key", pair())

    def _union(self, frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for more in frames[1:]:
            out = out.unionByName(more)
        return out

    def actions(self, documents: DataFrame) -> DataFrame:
        """kind, id and action (delete or rebuild) of each element that the deletion of some documents would touch."""
        state = self.tables.state()
        chunks = picked(self.read("chunks", state), materialise(documents.select("document").distinct(), "asked"), ["document"]).select(F.col("chunk").alias("source_id")).distinct()
        gone = chunks.withColumn("_gone", F.lit(1))
        mentions, claims = self.read("mentions", state), self.read("claims", state).where("src <> tgt")
        ends = claims.select(F.explode(F.array("src", "tgt")).alias("id"), "source_id")
        elements = [("entity", mentions.select(F.col("name").alias("id"), "source_id").unionByName(ends)), ("relation", claims.select(pair().alias("id"), "source_id"))]
        out = None
        for kind, rows in elements:
            sums = rows.join(gone, "source_id", "left").groupBy("id").agg(F.count("_gone").alias("lost"), F.count(F.lit(1)).alias("n")).where("lost > 0")
            part = sums.select(F.lit(kind).alias("kind"), "id", F.when(F.col("lost") == F.col("n"), "delete").otherwise("rebuild").alias("action"))
            out = part if out is None else out.unionByName(part)
        return out

    def compact(self) -> State:
        """Each table in one folder, without rows that were overtaken."""
        before, replaced = self.tables.state(), {}
        for name in ("chunks", "mentions", "claims", "entities", "relations"):
            if before.folders(name):
                rows = self.tables.live(name, before, gone=f"gone-{name}").withColumn("segment", F.lit(before.version + 1))
                replaced |= {name: self.tables.write(name, rows), f"gone-{name}": self.tables.none_gone()}
        return self.tables.commit(before, replaced=replaced)



"""Files of a folder taken in as a stream: known ones skipped, unreadable ones put aside, the rest parsed and enqueued, in one commit a batch.

A batch's files are told from known ones by path and time of change. Each is read by its extension; what can't be (an unknown kind, no content, a damaged
file) is a row of ``quarantine`` with the reason. Texts become documents to be processed as ``store.enqueue`` says: sanitised, the first of equal contents pending, copies failed rows of their
own. ``files``, ``quarantine`` and ``queue`` grow under one manifest, which also notes the batch's number: a batch that runs again after a crash finds
its number there and does nothing, so a restart never gives a second row. Spark's file stream passes over files of no length until something is in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.text import extension, safe_name, sanitize
from tessera.operators import store
from tessera.plans.staging import materialise, picked
from tessera.plans.tables import Tables
from tessera.sources import parsers

#: Extensions whose files hold text as it is, beside those with a parser of their own (fixed list).
PLAIN = ("txt md mdx tex xml yaml yml rtf log conf ini properties sql bat sh c h cpp hpp py java js ts swift go rb php css scss less").split()


class Inbox:
    """What a folder's stream has taken in, at ``root`` (a new one where none is given)."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.tables = spark, Tables(spark, root)

    def read(self, name: str) -> DataFrame:
        """files (path, modified, length, state), quarantine (path, name, reason) or queue (as ``store.enqueue`` gives it, with ``track``: the batch)."""
        return self.tables.read(name)

    def take(self, files: DataFrame, batch: int, stream: str) -> bool:
        """One batch of files (path, length, modificationTime, content); whether it was new."""
        before = self.tables.state()
        if before.notes.get("batches", {}).get(stream, -1) >= batch:
            return False
        found = files.select("path", F.col("modificationTime").alias("modified"), "length", "content")
        if before.folders("files"):
            known = materialise(self.tables.read("files", before).select("path", "modified").distinct(), "known")
            found = picked(found, known, ["path", "modified"], "left_anti")
        parsers_of = sorted(parsers.known())
        named = found.withColumn("kind", extension(F.col("path"))).withColumn("name", safe_name(F.col("path")))
        as_text = F.when(F.col("kind").isin(parsers_of), F.col("name")).when(F.col("kind").isin(PLAIN), F.concat("name", F.lit(".txt")))
        parsed = parsers.parse(named.where(as_text.isNotNull() & (F.col("length") > 0)).select(F.struct("path", "modified", "length", "name").alias("file"), as_text.alias("as"), "content"), "as", "content", keep=("file",))
        good = parsed.select("file.*", F.col("markdown").alias("text"), F.col("error").alias("reason"))
        bad = named.where(as_text.isNull() | (F.col("length") == 0)).select("path", "modified", "length", "name", F.lit(None).cast("string").alias("text"), F.when(F.col("length") == 0, "empty file").otherwise(F.concat(F.lit("unsupported: "), "kind")).alias("reason"))
        rows = good.unionByName(bad).withColumn("text", sanitize(F.col("text")))
        rows = materialise(rows.withColumn("reason", F.when(F.col("reason").isNull() & (F.coalesce("text", F.lit("")) == ""), "no text").otherwise(F.col("reason"))), "taken")
        known_docs = self.tables.read("queue", before).select("id") if before.folders("queue") else self.spark.createDataFrame([], "id string")
        queue = store.enqueue(rows.where("reason is null").select(F.struct("modified", "path").alias("pos"), "text", "name"), known_docs, "pos", "text", "name")
        appended = {
            "files": self.tables.write("files", rows.select("path", "modified", "length", F.when(F.col("reason").isNull(), "enqueued").otherwise("quarantined").alias("state"))),
            "quarantine": self.tables.write("quarantine", rows.where("reason is not null").select("path", "name", "length", "reason")),
            "queue": self.tables.write("queue", queue.select("id", "status", "content_summary", "content_length", "file_path", F.lit(f"{stream}-{batch}").alias("track"))),
        }
        self.tables.commit(before, appended=appended, notes={"batches": before.notes.get("batches", {}) | {stream: batch}})
        return True

    def follow(self, folder: str, checkpoint: str, stream: str = "folder", files_at_once: int = 1000, every: str | None = None) -> StreamingQuery:
        """Take in a folder: all that is there now, or for good in batches ``every`` so often."""
        schema = "path string not null, modificationTime timestamp not null, length long not null, content binary"
        files = self.spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_at_once).load(folder)
        writer = files.writeStream.foreachBatch(lambda df, n: self.take(df, n, stream) and None).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()

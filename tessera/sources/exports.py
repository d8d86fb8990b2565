"""Exports of a graph: GraphML, markdown and plain text by data sources whose tasks write parts that a commit publishes together; csv by Spark's own.

A part is written aside by its task and moved to its place when all parts are there, so no part of a failed task or job is ever read. Each part of a
GraphML export is a whole document of some nodes or edges, and each part of a markdown export a whole table; nothing passes through the driver but the
parts' names. GraphML reads back a file a task.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Rows of a GraphML export: nodes (id) and edges (source, target), with their data as texts.
ROWS = "kind string, id string, source string, target string, data map<string,string>"
NAMESPACE = "http://graphml.graphdrawing.org/xmlns"


def _files(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Part(WriterCommitMessage):
    name: str


class PartWriter(DataSourceWriter):
    """Each task writes one part below ``_aside``; the commit moves all of them to their places and marks the folder as whole."""

    suffix = "txt"

    def __init__(self, options: Mapping[str, str], schema: StructType, overwrite: bool):
        self.path, self.names, self.overwrite, self.job = options["path"].rstrip("/"), schema.names, overwrite, uuid.uuid4().hex
        self.options = {k.lower(): v for k, v in options.items()}

    def head(self) -> str:
        return ""

    def line(self, row) -> str:
        raise NotImplementedError

    def foot(self) -> str:
        return ""

    def write(self, iterator) -> Part:
        files, path = _files(self.path)
        name = f"part-{uuid.uuid4().hex}.{self.suffix}"
        files.create_dir(f"{path}/_aside-{self.job}", recursive=True)
        with files.open_output_stream(f"{path}/_aside-{self.job}/{name}") as out:
            out.write(self.head().encode())
            for row in iterator:
                out.write(self.line(row).encode())
            out.write(self.foot().encode())
        return Part(name)

    def commit(self, messages) -> None:
        files, path = _files(self.path)
        before = [f.path for f in files.get_file_info(fs.FileSelector(path)) if f.is_file] if self.overwrite else []
        for m in messages:
            if m is not None:
                files.move(f"{path}/_aside-{self.job}/{m.name}", f"{path}/{m.name}")
        for old in before:
            files.delete_file(old)
        files.delete_dir(f"{path}/_aside-{self.job}")
        with files.open_output_stream(f"{path}/_SUCCESS"):
            pass

    def abort(self, messages) -> None:
        files, path = _files(self.path)
        if files.get_file_info(f"{path}/_aside-{self.job}").type == fs.FileType.Directory:
            files.delete_dir(f"{path}/_aside-{self.job}")


class GraphMLWriter(PartWriter):
    suffix = "graphml"

    def head(self) -> str:
        keys = [(f"{kind[0]}_{name}", kind, name, typ) for kind in ("node", "edge") for name, typ in (x.split(":") for x in self.options.get(f"{kind}keys", "").split(",") if x)]
        self.known = {(kind, name): key for key, kind, name, _ in keys}
        declared = "".join(f'  <key id={quoteattr(key)} for="{kind}" attr.name={quoteattr(name)} attr.type="{typ}"/>\n' for key, kind, name, typ in keys)
        return f'<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="{NAMESPACE}">\n{declared}  <graph edgedefault="undirected">\n'

    def line(self, row) -> str:
        kind, key, source, target, data = row
        at = f"node id={quoteattr(key)}" if kind == "node" else f"edge source={quoteattr(source)} target={quoteattr(target)}"
        inner = "".join(f"<data key={quoteattr(self.known[kind, k])}>{escape(v)}</data>" for k, v in sorted((data or {}).items()) if v is not None)
        return f"    <{at}>{inner}</{kind}>\n"

    def foot(self) -> str:
        return "  </graph>\n</graphml>\n"


class MarkdownWriter(PartWriter):
    suffix = "md"

    def head(self) -> str:
        title = self.options.get("title")
        return (f"## {title}\n\n" if title else "") + f"| {' | '.join(self.names)} |\n| {' | '.join(['---'] * len(self.names))} |\n"

    def line(self, row) -> str:
        return "| " + " | ".join(("" if v is None else str(v)).replace("|", "\\|").replace("\n", " ") for v in row) + " |\n"


class TextWriter(PartWriter):
    def line(self, row) -> str:
        return "".join(f"{name}: {'' if v is None else v}\n" for name, v in zip(self.names, row)) + "\n"


@dataclass
class File(InputPartition):
    path: str


class GraphMLReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def partitions(self) -> list[File]:
        files, path = _files(self.path)
        info = files.get_file_info(path)
        found = [info] if info.is_file else files.get_file_info(fs.FileSelector(path))
        return [File(f.path) for f in found if f.is_file and f.path.endswith(".graphml") and not posixpath.basename(f.path).startswith("_")]

    def read(self, partition: File) -> Iterator[tuple]:
        if partition is None:
            return
        files, _ = _files(self.path)
        names: dict[str, str] = {}
        with files.open_input_stream(partition.path) as stream:
            for _, e in ElementTree.iterparse(stream):
                tag = e.tag.split("}")[-1]
                if tag == "key":
                    names[e.get("id")] = e.get("attr.name")
                elif tag in ("node", "edge"):
                    data = {names[d.get("key")]: d.text or "" for d in e}
                    yield tag, e.get("id") if tag == "node" else None, e.get("source"), e.get("target"), data
                    e.clear()


class GraphML(DataSource):
    """``format("graphml")``: rows of ROWS, with the options nodeKeys and edgeKeys (name:type, ...) for what their data may hold."""

    @classmethod
    def name(cls) -> str:
        return "graphml"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema: StructType) -> DataSourceReader:
        return GraphMLReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return GraphMLWriter(self.options, schema, overwrite)


class MarkdownTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "markdown_table"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return MarkdownWriter(self.options, schema, overwrite)


class TextRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "text_records"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return TextWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    for source in (GraphML, MarkdownTable, TextRecords):
        spark.dataSource.register(source)


def _data(rows: DataFrame, names: list[str]) -> Column:
    """Fields that aren't null, as texts; lists as JSON."""
    kinds = dict(rows.dtypes)
    text = [F.to_json(F.col(c)) if kinds[c].startswith(("array", "map", "struct")) else F.col(c).cast("string") for c in names]
    pairs = F.array(*(F.struct(F.lit(c).alias("key"), t.alias("value")) for c, t in zip(names, text))) if names else F.array().cast("array<struct<key:string,value:string>>")
    return F.map_from_entries(F.filter(pairs, lambda x: x["value"].isNotNull()))


def _types(rows: DataFrame, names: list[str]) -> str:
    kinds = {"double": "double", "float": "double", "bigint": "long", "int": "int", "boolean": "boolean"}
    return ",".join(f"{c}:{kinds.get(t, 'string')}" for c, t in rows.dtypes if c in names)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes (entity_id, ...) and edges (src, tgt, ...) as GraphML documents."""
    register(nodes.sparkSession)
    n, e = [c for c in nodes.columns if c != "entity_id"], [c for c in edges.columns if c not in ("src", "tgt")]
    none = F.lit(None).cast("string")
    rows = nodes.select(F.lit("node").alias("kind"), F.col("entity_id").alias("id"), none.alias("source"), none.alias("target"), _data(nodes, n).alias("data"))
    rows = rows.unionByName(edges.select(F.lit("edge").alias("kind"), none.alias("id"), F.col("src").alias("source"), F.col("tgt").alias("target"), _data(edges, e).alias("data")))
    rows.write.format("graphml").mode("overwrite").option("nodeKeys", _types(nodes, n)).option("edgeKeys", _types(edges, e)).save(path)


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entity_id, data) and (src, tgt, data) of GraphML documents."""
    register(spark)
    rows = spark.read.format("graphml").load(path)
    return rows.where("kind = 'node'").select(F.col("id").alias("entity_id"), "data"), rows.where("kind = 'edge'").select(F.col("source").alias("src"), F.col("target").alias("tgt"), "data")


def exported(nodes: DataFrame, edges: DataFrame, vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What is shown of entities (entity_name, source_id, graph_data) and of relations from either end (src_entity, tgt_entity, ...); with ``vectors`` (entity_id, vector_data) also these."""
    named = nodes.select(F.col("entity_id").alias("entity_name"), "source_id" if "source_id" in nodes.columns else F.lit(None).cast("string").alias("source_id"), F.to_json(F.struct(*nodes.columns)).alias("graph_data"))
    if vectors is not None:
        named = named.join(vectors.select(F.col("entity_id").alias("entity_name"), F.col("vector_data").cast("string").alias("vector_data")), "entity_name", "left")
    shown = edges.where("src <> tgt").select("src", "tgt", "source_id" if "source_id" in edges.columns else F.lit(None).cast("string").alias("source_id"), F.to_json(F.struct(*edges.columns)).alias("graph_data"))
    ways = F.explode(F.array(F.struct(F.col("src").alias("src_entity"), F.col("tgt").alias("tgt_entity")), F.struct(F.col("tgt").alias("src_entity"), F.col("src").alias("tgt_entity"))))
    return named, shown.select(ways.alias("w"), "source_id", "graph_data").select("w.*", "source_id", "graph_data")


def export(nodes: DataFrame, edges: DataFrame, path: str, kind: str = "csv", vectors: DataFrame | None = None) -> None:
    """Folders ``entities`` and ``relations`` below a path, as csv, md or txt, or one of GraphML documents."""
    if kind == "graphml":
        return write_graphml(nodes, edges, path)
    if kind not in ("csv", "md", "txt"):
        raise ValueError(f"no export of kind {kind!r}")
    register(nodes.sparkSession)
    for name, rows in zip(("entities", "relations"), exported(nodes, edges, vectors)):
        if kind == "csv":
            rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/{name}")
        else:
            rows.write.format("markdown_table" if kind == "md" else "text_records").mode("overwrite").option("title", name.capitalize()).save(f"{path}/{name}")

"""Registered queries: graph, merging, retrieval, stores, status, streams.

The order lines stand for extractions: chunk = order, relation = part and supplier, weight = quantity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import lists
from tessera.functions.text import content_id
from tessera.operators import edit, graph, lifecycle, merge, retrieval, search, store, summaries
from tessera.plans import indexes, registry
from tessera.plans.queries_search import CHUNKS, EXACT, first_vector
from tessera.plans.registry import query
from tessera.plans.staging import cleared, materialise, new_path, numbered, picked, release, table
from tessera.streaming import stateful
from tessera.streaming import status as streams


def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("tgt"), F.col("l_quantity").alias("weight"), F.concat_ws(",", "l_returnflag", "l_linestatus").alias("keywords"),
        F.col("l_orderkey").cast("string").alias("source_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_shipdate").alias("at"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extractions(spark, sf_dir).select(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt"), "weight").groupBy("src", "tgt").agg(F.sum("weight").alias("weight"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("entity_id"), F.col("p_type").alias("entity_type"), F.col("p_name").alias("description"))
    return parts.unionByName(table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("entity_id"), F.lit("supplier").alias("entity_type"), F.col("s_name").alias("description")))


def some(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "node string")


X = "x as (select 's' || l_suppkey as src, 'p' || l_partkey as tgt, l_quantity as weight, l_returnflag || ',' || l_linestatus as keywords, l_orderkey::varchar as source_id, l_orderkey * 10 + l_linenumber as pos, l_shipdate as at from lineitem)"
E = X + ",\ne as (select least(src, tgt) as src, greatest(src, tgt) as tgt, sum(weight) as weight from x group by all)"
D = E + ",\nd as (select node, count(*) as degree from (select src as node from e union all select tgt from e) group by node)"
N = "n as (select 'p' || p_partkey as entity_id, p_type as entity_type, p_name as description from part union all select 's' || s_suppkey, 'supplier', s_name from supplier)"


@query(f"with {D}, a as (select unnest(['s1', 'p1', 'p2', 'nobody']) as node) select node, coalesce(degree, 0) as degree from a left join d using (node)")
def g1_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees_of(some(spark, "s1", "p1", "p2", "nobody"), edges(spark, sf_dir))


@query(f"with {D} select e.src, e.tgt, a.degree + b.degree as edge_degree from e join d a on a.node = e.src join d b on b.node = e.tgt")
def g2_edge_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_degrees(edges(spark, sf_dir)).select("src", "tgt", "edge_degree")


@query(f"with {E}, a as (select 's' || l_suppkey as src, 'p' || l_partkey as tgt from lineitem where l_linenumber = 1 union select 's1', 'nobody') select a.src, a.tgt, e.weight from a join e on e.src = least(a.src, a.tgt) and e.tgt = greatest(a.src, a.tgt)")
def g3_edges_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("tgt"))
    return graph.edges_of_pairs(pairs.union(spark.createDataFrame([("s1", "nobody")], "src string, tgt string")), edges(spark, sf_dir)).select("src", "tgt", "weight")


@query(f"with {E}, b as (select src as node, tgt as other from e union all select tgt, src from e) select node, other from b where node in ('s1', 's2', 'p7')")
def g4_incident(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.incident(some(spark, "s1", "s2", "p7"), edges(spark, sf_dir))


@query(f"with {N}, u as (select 'p' || p_partkey as entity_id, 'renamed' as entity_type, null as description from part where p_size = 1 union all select 'new', 'kind', 'said') select coalesce(n.entity_id, u.entity_id) as entity_id, coalesce(u.entity_type, n.entity_type) as entity_type, coalesce(u.description, n.description) as description from n full join u on n.entity_id = u.entity_id")
def g5_upsert_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "part").where("p_size = 1").select(F.concat(F.lit("p"), "p_partkey").alias("entity_id"), F.lit("renamed").alias("entity_type"), F.lit(None).cast("string").alias("description"))
    return graph.upsert(nodes(spark, sf_dir), new.union(spark.createDataFrame([("new", "kind", "said")], new.schema)), ["entity_id"])


@query(f"with {E} select src, tgt, weight from e where not exists (select 1 from part where p_brand = 'Brand#1' and ('p' || p_partkey) in (src, tgt)) and not exists (select 1 from supplier where s_nationkey = 3 and ('s' || s_suppkey) in (src, tgt))")
def g6_delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "part").where("p_brand = 'Brand#1'").select(F.concat(F.lit("p"), "p_partkey").alias("node")).union(table(spark, sf_dir, "supplier").where("s_nationkey = 3").select(F.concat(F.lit("s"), "s_suppkey")))
    return graph.delete_nodes(nodes(spark, sf_dir), edges(spark, sf_dir), gone)[1].select("src", "tgt", "weight")


@query(f"with {N} select distinct entity_id as label from n order by label")
def g7_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).select(F.col("entity_id").alias("label")).distinct().orderBy("label")


@query(f"with {D} select node, degree from d order by degree desc, node limit 300")
def g8_popular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.popular(edges(spark, sf_dir), 300)


@query("""with l as (select distinct p_name as label from part), s as (select label, case when lower(label) = 'ring' then 1000 when starts_with(lower(label), 'ring') then 500 when contains(lower(label), 'ring')
  then 100 - length(label) + case when contains(lower(label), ' ring') or contains(lower(label), '_ring') then 50 else 0 end end as score from l)
select label, score::int as score from s where score is not null order by score desc, label limit 20""")
def g9_label_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.search_labels(table(spark, sf_dir, "part").select("p_name").distinct(), "ring", 20, "p_name")


@query("""with l as (select distinct p_name as label from part where lower(p_name) like '%ring%'), s as (select label, case when lower(label) = 'ring' then 1000 when lower(label) like 'ring%' then 500 else 100 - length(label) end
  + case when lower(label) like '% ring%' or lower(label) like '%_ring%' then 50 else 0 end as score from l) select label, score::int as score from s order by score desc, label limit 20""")
def g9b_label_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.search_labels(table(spark, sf_dir, "part").select("p_name").distinct(), "ring", 20, "p_name", anywhere=True)


@query(f"""with recursive {D}, b as (select src as node, tgt as other from e union all select tgt, src from e),
v(node, level) as (select 's1', 0 union select other, level + 1 from v join b using (node) where level < 2),
m as (select node, min(level) as level from v group by node)
select node, level from m join d using (node) order by level, degree desc, node limit 200""")
def g10_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.subgraph(edges(spark, sf_dir), "s1", 2, 200)[0]


@query(f"with {D}, k as (select node from d order by degree desc, node limit 150) select src, tgt, weight from e where src in (select node from k) and tgt in (select node from k)")
def g11_star_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.whole_graph(edges(spark, sf_dir), 150)[1].select("src", "tgt", "weight")


@query(f"""with {D} select e.src, e.tgt, e.weight, a.degree + b.degree as edge_degree from e join d a on a.node = e.src join d b on b.node = e.tgt
where e.src in ('p1', 'p2', 'p3', 's4') or e.tgt in ('p1', 'p2', 'p3', 's4') order by edge_degree desc, weight desc, src, tgt limit 100""")
def g14_related_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = graph.related_edges(some(spark, "p1", "p2", "p3", "s4"), edges(spark, sf_dir))
    return got.select("src", "tgt", "weight", "edge_degree").orderBy(F.desc("edge_degree"), F.desc("weight"), "src", "tgt").limit(100)


@query(f"""with {E}, r as (select src, tgt, row_number() over (order by weight desc, src, tgt) - 1 as spot from e order by weight desc, src, tgt limit 60),
b as (select src as node, spot * 2 as first from r union all select tgt, spot * 2 + 1 from r) select node, min(first) as first from b group by node""")
def g16_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = edges(spark, sf_dir).orderBy(F.desc("weight"), "src", "tgt").limit(60)
    return graph.endpoints(top.withColumn("at", F.row_number().over(W.orderBy(F.desc("weight"), "src", "tgt")).cast("long") - 1), "at")


@query("""with l1 as (select p_partkey as id, row_number() over (order by p_retailprice desc, p_partkey) as r from part order by p_retailprice desc, p_partkey limit 30),
l2 as (select p_partkey as id, row_number() over (order by p_size desc, p_partkey) as r from part order by p_size desc, p_partkey limit 30),
u as (select id, r, 0 as l from l1 union all select id, r, 1 from l2), f as (select id, min(r * 2 + l) as spot from u group by id)
select id, row_number() over (order by spot)::int as position from f""")
def r3_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    lanes = [part.orderBy(F.desc(c), "p_partkey").limit(30).select(F.col("p_partkey").alias("id"), F.row_number().over(W.orderBy(F.desc(c), "p_partkey")).alias("rank")) for c in ("p_retailprice", "p_size")]
    return retrieval.round_robin(lanes, ["id"])


_ITEMS = "i as (select 'p' || l_partkey as item, dense_rank() over (order by l_partkey) - 1 as rank, l_orderkey as chunk, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber) - 1 as pos from lineitem where l_partkey in (select p_partkey from part order by p_retailprice desc, p_partkey limit 40))"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.broadcast(table(spark, sf_dir, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(40).select(F.col("p_partkey").alias("l_partkey")))
    rows = table(spark, sf_dir, "lineitem").join(found, "l_partkey", "left_semi")
    source = F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber"))), lambda x: x["l_orderkey"])
    got = rows.groupBy("l_partkey").agg(source.alias("sources"))  # forty items
    return got.select(F.concat(F.lit("p"), "l_partkey").alias("item"), (F.row_number().over(W.orderBy("l_partkey")) - 1).alias("rank"), "sources")


_OWNED = """o as (select chunk, arg_min(item, (rank, pos)) as item, min((rank, pos)) as f, count(distinct item) as occurrences from i group by chunk),
c as (select item, f[1] as rank, chunk, occurrences, row_number() over (partition by item order by occurrences desc, f[2]) as place from o)"""


@query(f"with {_ITEMS}, {_OWNED} select item, rank::int as rank, chunk, occurrences, place::int as place from c".replace("f[1]", "(f).rank").replace("f[2]", "(f).pos").replace("min((rank, pos)) as f", "min({'rank': rank, 'pos': pos}) as f").replace("arg_min(item, (rank, pos))", "arg_min(item, {'rank': rank, 'pos': pos})"))
def r5_entity_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.chunks_of(_items(spark, sf_dir), "item", "rank", "sources")


@query(f"""with {_ITEMS}, i2 as (select 'r' || l_suppkey as item, dense_rank() over (order by l_suppkey) - 1 as rank, l_orderkey as chunk from lineitem where l_suppkey in (select s_suppkey from supplier order by s_acctbal desc, s_suppkey limit 5)),
o as (select chunk, min(rank) as rank, count(distinct item) as occurrences from i2 group by chunk) select chunk, rank::int as rank, occurrences from o where chunk not in (select chunk from i)""")
def r6_relation_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.broadcast(table(spark, sf_dir, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(5).select(F.col("s_suppkey").alias("l_suppkey")))
    rows = table(spark, sf_dir, "lineitem").join(found, "l_suppkey", "left_semi")
    source = F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber"))), lambda x: x["l_orderkey"])
    relations = rows.groupBy("l_suppkey").agg(source.alias("sources")).select(F.concat(F.lit("r"), "l_suppkey").alias("item"), (F.row_number().over(W.orderBy("l_suppkey")) - 1).alias("rank"), "sources")  # five items
    entity = retrieval.chunks_of(_items(spark, sf_dir), "item", "rank", "sources")
    return retrieval.relation_chunks(relations, entity).select("chunk", "rank", "occurrences")


@query(f"""with {_ITEMS}, i2 as (select 'r' || l_suppkey as item, dense_rank() over (order by l_suppkey) - 1 as rank, l_orderkey as chunk from lineitem),
o as (select chunk, min(rank) as rank, count(distinct item) as occurrences from i2 group by chunk) select chunk, rank::int as rank, occurrences from o where chunk not in (select chunk from i)""")
def r6_relation_chunks_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier's orders but those of the forty dearest parts."""
    source = F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber"))), lambda x: x["l_orderkey"])
    relations = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(source.alias("sources"))
    items = numbered(relations, "l_suppkey").select(F.concat(F.lit("r"), "l_suppkey").alias("item"), F.col("rank").cast("int").alias("rank"), "sources")
    return retrieval.relation_chunks(items, retrieval.chunks_of(_items(spark, sf_dir), "item", "rank", "sources")).select("chunk", "rank", "occurrences")


@query(f"""with {CHUNKS}, s as (select doc_id, chunk_order_index, tokens, sum(tokens) over (partition by doc_id order by chunk_order_index rows unbounded preceding) as t from chunks)
select doc_id, chunk_order_index, tokens from s where t <= 450""")
def r7_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators import chunking

    chunks = chunking.window_chunks(table(spark, sf_dir, "documents"), 100, 20)
    return retrieval.within_budget(chunks, ["chunk_order_index"], "tokens", 450, ["doc_id"]).select("doc_id", "chunk_order_index", "tokens")


@query("""with c as (select item_id as position, case when item_id % 7 = 0 then 'unknown_source' else 'f' || (item_id * item_id) % 11 end as file_path from benchmark),
k as (select file_path, count(*) as n, min(position) as first from c where file_path <> 'unknown_source' group by file_path), r as (select file_path, (row_number() over (order by n desc, first))::varchar as reference_id from k)
select position, c.file_path, coalesce(reference_id, '') as reference_id from c left join r on r.file_path = c.file_path""")
def r10_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("item_id") % 7 == 0, "unknown_source").otherwise(F.concat(F.lit("f"), (F.col("item_id") * F.col("item_id")) % 11))
    return retrieval.references(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("position"), path.alias("file_path"))).select("position", "file_path", "reference_id")


@query("select string_agg('{\"id\":' || r_regionkey || ',\"name\":\"' || r_name || '\"}', chr(10) order by r_regionkey) as context from region")
def r11_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return retrieval.context(rows, "id", ["id", "name"])


@query(f"""with {_ITEMS}, p as (select distinct item, rank, chunk, pos, row_number() over (partition by item order by pos) as place from i), z as (select item, rank, count(*) as n from p group by all),
q as (select item, rank, n, round_even(12 - rank * (12 - 3) / (select count(*) - 1 from z)::double, 0)::int as quota from z), s as (select sum(greatest(quota - n, 0)) as spare from q),
m as (select p.item, p.chunk, p.place, quota, p.rank from p join q on q.item = p.item), x as (select item, chunk, place, row_number() over (order by rank, place) as nth from m where place > quota)
select item, chunk, place::int as place from m where place <= quota union all select item, chunk, place::int from x where nth <= (select spare from s)""")
def v14_polling(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _items(spark, sf_dir).select("item", "rank", F.posexplode("sources").alias("p", "chunk")).select("item", "rank", "chunk", (F.col("p") + 1).alias("place"))
    return retrieval.weighted_polling(each, 12, 3).select("item", "chunk", "place")


# over all parts, beside the three above, which take what a retrieval found: its best 40 parts and 5 suppliers
_ALL_ITEMS = _ITEMS.replace(" where l_partkey in (select p_partkey from part order by p_retailprice desc, p_partkey limit 40)", "")


def _all_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber"))), lambda x: x["l_orderkey"])
    got = numbered(table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(source.alias("sources")), "l_partkey")
    return got.select(F.concat(F.lit("p"), "l_partkey").alias("item"), F.col("rank").cast("int").alias("rank"), "sources")


@query(registry.SQL["r5_entity_chunks"].replace(_ITEMS, _ALL_ITEMS))
def r5_entity_chunks_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.chunks_of(_all_items(spark, sf_dir), "item", "rank", "sources")


@query(registry.SQL["v14_polling"].replace(_ITEMS, _ALL_ITEMS))
def v14_polling_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _all_items(spark, sf_dir).select("item", "rank", F.posexplode("sources").alias("p", "chunk")).select("item", "rank", "chunk", (F.col("p") + 1).alias("place"))
    return retrieval.weighted_polling(each, 12, 3).select("item", "chunk", "place")


@query(f"with {X} select 'p' || l_partkey as name, count(*) as mentions, count(distinct l_orderkey) as chunks from lineitem group by all")
def a1_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("p"), "l_partkey").alias("name")).agg(F.count("*").alias("mentions"), F.countDistinct("l_orderkey").alias("chunks"))


_MENTIONS = "m as (select 'p' || l_partkey as name, l_returnflag as type, l_orderkey * 10 + l_linenumber as pos, l_shipdate as at, l_returnflag || l_linestatus || l_quantity::int as description, l_orderkey::varchar as source_id from lineitem)"


def mentions(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    return mentions_of(table(spark, sf_dir, "lineitem"), *more)


def mentions_of(lines: DataFrame, *more: Column) -> DataFrame:
    return lines.select(
        F.concat(F.lit("p"), "l_partkey").alias("name"), F.col("l_returnflag").alias("type"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_shipdate").alias("at"),
        F.concat("l_returnflag", "l_linestatus", F.col("l_quantity").cast("int")).alias("description"), F.col("l_orderkey").cast("string").alias("source_id"), *more,
    )


@query(f"with {_MENTIONS}, c as (select name, type, count(*) as n, min(pos) as first from m group by all), r as (select *, row_number() over (partition by name order by n desc, first) as k from c) select name, type from r where k = 1")
def a2_type_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.majority(mentions(spark, sf_dir), ["name"], "type", "pos")


@query(f"""with {_MENTIONS}, f as (select name, description, min({{'day': m.at, 'o': pos}}) as f from m group by all)
select name, string_agg(description, '<SEP>' order by f['day'], -length(description), f['o']) as description, count(*) as fragments from f group by name""")
def a3_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.descriptions(mentions(spark, sf_dir), ["name"], "description", "at", "pos")


@query("""with f as (select 's' || l_suppkey as name, 'ordered ' || l_quantity::int || ' of part ' || l_partkey as said from lineitem)
select name, min(said) as description, count(*) > 1 as summarised from f group by name""")
def a4_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier's order lines by map and reduce; the model's place is taken by one whose summary is the least text, which SQL can follow through all rounds."""
    said = F.concat(F.lit("ordered "), F.col("l_quantity").cast("int"), F.lit(" of part "), "l_partkey")
    lines = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("name"), said.alias("description"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return summaries.summarise(lines, "name", "description", "pos", most=100, fragments=2, summary=lambda groups: [min(g) for g in groups])


@query(f"with {_MENTIONS}, f as (select name, source_id, min(pos) as o from m group by all), r as (select name, source_id, o, row_number() over (partition by name order by o desc) as k from f) select name, string_agg(source_id, ',' order by o) as sources from r where k <= 20 group by name")
def a6_source_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = merge.ordered_distinct(mentions(spark, sf_dir), ["name"], "source_id", "pos", 20)
    return got.select("name", F.array_join("source_id", ",").alias("sources"))


@query(f"with {_MENTIONS}, f as (select name, source_id, min(pos) as o from m group by all), g as (select name, list(source_id order by o) as a from f group by name) select name, array_to_string(case when len(a) > 10 then list_append(a[1:10], '...truncated...(KEEP Old)') else a end, ',') as paths from g")
def a8_path_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = merge.ordered_distinct(mentions(spark, sf_dir), ["name"], "source_id", "pos", 11, "KEEP")  # one more than the cap tells that it was reached
    return got.select("name", F.array_join(lists.cap_paths(F.col("source_id"), 10, "KEEP"), ",").alias("paths"))


@query(f"""with {X}, k as (select distinct least(src, tgt) as src, greatest(src, tgt) as tgt, unnest(string_split(keywords, ',')) as w from x), kk as (select src, tgt, string_agg(w, ',' order by w) as keywords from k group by all),
s as (select least(src, tgt) as src, greatest(src, tgt) as tgt, source_id, min(pos) as o from x group by all), ss as (select src, tgt, string_agg(source_id, ',' order by o) as sources from s group by all),
w as (select least(src, tgt) as src, greatest(src, tgt) as tgt, sum(weight) as weight from x group by all) select src, tgt, weight, keywords, sources from w join kk using (src, tgt) join ss using (src, tgt)""")
def a9_relation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = merge.relations(extractions(spark, sf_dir))
    return got.select("src", "tgt", "weight", "keywords", F.array_join("source_ids", ",").alias("sources"))


@query(f"with {E}, gone as (select 's' || s_suppkey as entity_id from supplier where s_suppkey % 3 = 0), t as (select src as entity_id, src || '-' || tgt as d from e union all select tgt, src || '-' || tgt from e) select entity_id, 'UNKNOWN' as entity_type, min(d) as description from t join gone using (entity_id) group by entity_id")
def a11_missing_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = nodes(spark, sf_dir).where("not (entity_type = 'supplier' and cast(substring(entity_id, 2) as int) % 3 = 0)")
    return merge.missing_endpoints(there, edges(spark, sf_dir).withColumn("description", F.concat_ws("-", "src", "tgt")))


@query("select l_orderkey as doc, string_agg(distinct 'p' || l_partkey, ',' order by 'p' || l_partkey) as names from lineitem group by l_orderkey")
def a12_document_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.concat(F.lit("p"), "l_partkey").alias("name"))
    return merge.by_document(rows, "doc", "name").select("doc", F.array_join("names", ",").alias("names"))


@query("select l_orderkey as doc, string_agg(distinct 's' || l_suppkey || '-p' || l_partkey, ',' order by 's' || l_suppkey || '-p' || l_partkey) as pairs from lineitem group by l_orderkey")
def a12_document_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.concat(F.lit("s"), "l_suppkey", F.lit("-p"), "l_partkey").alias("pair"))
    return merge.by_document(rows, "doc", "pair").select("doc", F.array_join("names", ",").alias("pairs"))


@query(f"""with {_MENTIONS}, n as (select distinct 'p' || l_partkey as entity_id from lineitem where l_linenumber = 1), s as (select 'p' || l_partkey as entity_id, 0 as late, '' as src, l_orderkey::varchar as source, min(l_orderkey) as nr from lineitem where l_linenumber = 1 group by all
union all select 'p' || l_partkey, 1, 's' || l_suppkey, l_orderkey::varchar, min(l_orderkey) from lineitem where 'p' || l_partkey in (select entity_id from n) group by all),
f as (select entity_id, source, min({{'late': late, 'src': src, 'nr': nr}}) as o from s group by all), r as (select *, row_number() over (partition by entity_id order by o desc, source desc) as k from f)
select entity_id, string_agg(source, ',' order by o, source) as sources from r where k <= 20 group by entity_id""")
def a11_edge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with the orders that name them first, and those of their relations after them; the last twenty."""
    rows = table(spark, sf_dir, "lineitem")
    order = F.transform(F.array_sort(F.collect_set("l_orderkey")), lambda x: x.cast("string")).alias("source_ids")
    named = rows.where("l_linenumber = 1").groupBy(F.concat(F.lit("p"), "l_partkey").alias("entity_id")).agg(order)
    wired = rows.groupBy(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("tgt")).agg(order)
    return merge.with_edge_sources(named, wired, 20).select("entity_id", F.array_join("source_ids", ",").alias("sources"))


@query(f"with {_MENTIONS}, r as (select name, description, row_number() over (partition by name order by length(description) desc, pos) as k from m) select name, description from r where k = 1")
def a13_longest_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.longest(mentions(spark, sf_dir), ["name"], "description", "pos")


@query(f"""with {_MENTIONS} select name, arg_min(description, pos) as first, arg_max(description, pos) as last, string_agg(distinct type, '<SEP>' order by type) as types, string_agg(distinct type, ',' order by type) as commas, max(pos) as top, string_agg(type, '<SEP>' order by pos, type) as every from m group by name""")
def a14_field_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that share a position count as they stand in the table: the first of them."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("place")
    return mentions(spark, sf_dir, place).groupBy("name").agg(
        merge.merge_field("keep_first", "description", "pos", "place").alias("first"), merge.merge_field("keep_last", "description", "pos", "place").alias("last"), merge.merge_field("join_unique", "type", "pos").alias("types"),
        merge.merge_field("join_unique_comma", "type", "pos").alias("commas"), merge.merge_field("max", "pos", "pos").alias("top"), merge.merge_field("concatenate", "type", "pos").alias("every"),
    )


@query("select event_type, count(*) as n from events group by event_type union all select 'all', count(*) from events")
def a15_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.status_counts(table(spark, sf_dir, "events"), "event_type")


STATE = "c as (select user_id, event_id, case event_type when 'purchase' then 'Succeed' when 'error' then 'Failed' else 'Processing' end as status, ts from events)"


def chunk_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("event_type") == "purchase", "Succeed").when(F.col("event_type") == "error", "Failed").otherwise("Processing")
    return table(spark, sf_dir, "events").select("user_id", "event_id", state.alias("status"), "ts")


@query(f"""with {STATE}, s as (select user_id, count(*) as total, count(*) filter (where status = 'Succeed') as succeeded, count(*) filter (where status = 'Failed') as failed from c group by user_id)
select user_id, total, succeeded, failed, succeeded * 100 // total as progress, case when succeeded = total then 'Succeed' when succeeded + failed = total then 'Failed' else 'Processing' end as state from s""")
def a16_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.progress(chunk_status(spark, sf_dir), "user_id", "status")


@query("select c_custkey as kb, count(o_orderkey) as docs from customer left join orders on o_custkey = c_custkey group by c_custkey")
def a18_docs_per_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.counts_with_zero(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("kb")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("kb")), "kb", "docs")


@query("select event_type, round(avg(case when event_id % 9 <> 0 then value end), 6) as mean, min(case when event_id % 9 <> 0 then value end) as low, max(case when event_id % 9 <> 0 then value end) as high, round(count(*) filter (where event_id % 9 <> 0) / count(*), 6) as rate from events group by event_type")
def a20_eval_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.evaluation(table(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_id") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("value"))), "value", "event_type")


@query("select lang as mode, source as type, count(*) as n from documents group by all")
def a21_cache_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.cache_counts(table(spark, sf_dir, "documents").select(F.concat_ws(":", "lang", "source", F.md5("text")).alias("id")))


@query("select i.pos, i.id, c_name, c_acctbal from (select unnest([7, 3, 99999999, 5, 3]) as id, unnest([0, 1, 2, 3, 4]) as pos) i left join customer on c_custkey = i.id")
def f3_multiget(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.createDataFrame([(0, 7), (1, 3), (2, 99999999), (3, 5), (4, 3)], "pos int, id int")
    return store.multi_get(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), ids, "c_custkey").select("pos", "id", "c_name", "c_acctbal")


@query("select distinct l_orderkey + 5 as o_orderkey from lineitem where l_orderkey + 5 not in (select o_orderkey from orders)")
def f4_filter_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.filter_keys(table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + 5).alias("o_orderkey")), table(spark, sf_dir, "orders"), "o_orderkey")


@query("select event_id from events where props::json->>'k' = '7'")
def f1_metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(store.metadata_equals("props", "k", "7")).select("event_id")


@query("select lang, count(*) as n from documents where starts_with(source || ':' || lang, 'src1') group by lang")
def f7_prefix_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.concat_ws(":", "source", "lang").startswith("src1")).groupBy("lang").agg(F.count("*").alias("n"))


@query("""with c as (select doc_id, text, source, 'doc-' || md5(trim(text, ' ' || chr(9) || chr(10) || chr(13))) as id from documents), n as (select *, row_number() over (partition by id order by doc_id) as k from c),
known as (select 'doc-' || md5(trim(text, ' ' || chr(9) || chr(10) || chr(13))) as id from documents where doc_id % 10 = 3), m as (select *, k > 1 or id in (select id from known) as dup from n)
select case when dup then 'dup-' || md5(id || '-' || doc_id) else id end as id, case when dup then 'failed' else 'pending' end as status, source as file_path, doc_id as pos from m""")
def m1_enqueue_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = docs.where("doc_id % 10 = 3").select(content_id("doc-", F.regexp_replace("text", r"^\s+|\s+$", "")).alias("id"))
    return store.enqueue(docs, known, "doc_id", "text", "source").select("id", "status", "file_path", "pos")


@query("""with new as (select c_custkey + 1000 as id, c_name || '+' as name, 2 as created from customer) select coalesce(n.id, c_custkey) as id, coalesce(n.name, c_name) as name, case when c_custkey is not null then 1 else n.created end as created from customer full join new n on n.id = c_custkey""")
def m2_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    old = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(1).alias("created"))
    return store.upsert(old, c.select((F.col("c_custkey") + 1000).alias("id"), F.concat("c_name", F.lit("+")).alias("name"), F.lit(2).alias("created")), "id", "created")


@query("""with s as (select l_partkey as id, l_orderkey as source, min(l_linenumber) as p from lineitem group by all), m as (select id, source, source in (select o_orderkey from orders where o_orderpriority = '1-URGENT') as gone from s)
select id, case when count(*) filter (where not gone) = 0 then 'delete' when count(*) filter (where gone) > 0 then 'rebuild' else 'keep' end as action, count(*) filter (where not gone)::int as remaining from m group by id""")
def m5_delete_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.array_sort(F.collect_set("l_orderkey")).alias("sources"))
    gone = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("source"))
    return merge.without_document(rows, "sources", gone).select("id", "action", F.size("remaining").alias("remaining"))


@query(f"""with {_MENTIONS}, k as (select m.* from m where source_id::bigint not in (select o_orderkey from orders where o_orderpriority = '1-URGENT')), c as (select name, type, count(*) as n, min(pos) as first from k group by all),
t as (select name, type, row_number() over (partition by name order by n desc, first) as r from c), s as (select name, count(distinct source_id)::int as sources from k group by name) select name, type, sources from t join s using (name) where r = 1""")
def m6_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").cast("string").alias("source_id"))
    left = mentions(spark, sf_dir).join(gone, "source_id", "left_anti")
    return merge.entities(left).select("name", "type", F.size("source_ids").alias("sources"))


@query(f"""with {_MENTIONS}, k as (select m.*, m.source_id::bigint as o from m where m.source_id::bigint not in (select o_orderkey from orders where o_orderpriority = '1-URGENT')),
x as (select 's' || l_suppkey as name, l_orderkey::varchar as source_id, 'UNKNOWN' as type, l_returnflag || l_linestatus || l_quantity::int as description, l_orderkey * 10 + l_linenumber as pos from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderpriority = '1-URGENT')),
t as (select name, source_id, arg_min(type, {{'l': -length(description), 'p': pos, 'd': description, 't': type}}) as type, arg_min(description, {{'l': -length(description), 'p': pos, 'd': description, 't': type}}) as description, min(pos) as pos from k group by name, source_id union all select name, source_id, type, description, pos from x),
c as (select name, type, count(*) as n, min(pos) as first from t group by all), r as (select name, type, row_number() over (partition by name order by n desc, first, type) as nth from c),
d as (select name, description, min(pos) as first from t group by all), e as (select name, string_agg(description, '<SEP>' order by first, description) as description from d group by name),
s as (select name, least(300, count(distinct source_id))::int as sources from t group by name) select name, type, description, sources from r join e using (name) join s using (name) where nth = 1""")
def m6_rebuilt_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")
    with cleared(spark):
        gone = materialise(table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey")), "urgent")
        kept = materialise(picked(lines, gone, ["l_orderkey"], "left_anti"), "kept")
    said = F.concat("l_returnflag", "l_linestatus", F.col("l_quantity").cast("int")).alias("description")
    wired = kept.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("tgt"), said, F.col("l_orderkey").cast("string").alias("source_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    got = merge.rebuilt(mentions_of(kept), wired).select("name", "type", "description", F.size("source_ids").alias("sources"))
    release(gone, kept)
    return got


@query(f"""with {X}, g as (select least(src, tgt) as a, greatest(src, tgt) as b, sum(weight) as weight, max(keywords) as keywords, 'said of ' || least(src, tgt) || ' and ' || greatest(src, tgt) as description, max(source_id) as source_id from x group by all),
r as (select *, case when right(a, 1) = '3' then 'p3' else a end as src, b as tgt from g), n as (select *, least(src, tgt) as s, greatest(src, tgt) as t from r where src <> tgt)
select s as src, t as tgt, max(weight) as weight, string_agg(description, '<SEP>' order by a, b) as description, case when count(*) = 1 then max(keywords) else array_to_string(list_sort(list_distinct(flatten(list(string_split(keywords, ','))))), ',') end as keywords,
  array_to_string(list_sort(list_distinct(list(source_id))), '<SEP>') as source_id from n group by s, t""")
def m10_merge_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").where("p_partkey % 10 = 3").select(F.concat(F.lit("p"), "p_partkey").alias("old"), F.lit("p3").alias("new"))
    x = extractions(spark, sf_dir).withColumns({"src": F.least("src", "tgt"), "tgt": F.greatest("src", "tgt")})
    wired = x.groupBy("src", "tgt").agg(F.sum("weight").alias("weight"), F.concat(F.lit("said of "), "src", F.lit(" and "), "tgt").alias("description"), F.max("keywords").alias("keywords"), F.max("source_id").alias("source_id"))
    return merge.merge_entities(wired, names)


@query(f"""with k as (select * from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderpriority = '1-URGENT')),
r as (select 'p' || l_partkey as src, 's' || l_suppkey as tgt, sum(l_quantity) as weight, array_to_string(list_sort(list_distinct(list(l_returnflag) || list(l_linestatus))), ',') as keywords, count(distinct l_orderkey) as sources from k group by l_partkey, l_suppkey)
select src, tgt, weight, keywords, sources from r""")
def m5_graph_after_deletion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders put into a graph store as documents, then the urgent ones taken out."""
    lines = table(spark, sf_dir, "lineitem").withColumn("source_id", F.col("l_orderkey").cast("string"))
    pos = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    chunks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("chunk"), F.col("o_orderkey").cast("string").alias("document"), F.lit("").alias("content"))
    said = F.concat_ws(" ", F.lit("sold"), F.col("l_quantity").cast("int"))
    claims = lines.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("tgt"), F.concat_ws(",", "l_returnflag", "l_linestatus").alias("keywords"), said.alias("description"), F.col("l_quantity").alias("weight"), "source_id", F.col("l_shipdate").alias("at"), pos.alias("pos"))
    mentions = lines.select(F.concat(F.lit("p"), "l_partkey").alias("name"), F.lit("part").alias("type"), said.alias("description"), "source_id", F.col("l_shipdate").alias("at"), pos.alias("pos"))
    store = lifecycle.GraphStore(spark)
    store.insert(chunks, mentions, claims)
    store.delete(table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").cast("string").alias("document")))
    return store.read("relations").select("src", "tgt", "weight", "keywords", F.size("source_ids").cast("long").alias("sources"))


@query("""with s as (select doc_id::varchar as id, case doc_id % 4 when 0 then 'processing' when 1 then 'failed' when 2 then 'processed' else 'pending' end as status, case when doc_id % 4 = 1 then 'e' end as error from documents),
h as (select doc_id::varchar as id from documents where doc_id % 3 <> 0) select s.id, case when h.id is not null and status in ('processing', 'failed') then 'pending' else status end as status, case when not (h.id is not null and status in ('processing', 'failed')) then error end as error
from s left join h on h.id = s.id where h.id is not null or status = 'failed'""")
def m11_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    four, docs = F.col("doc_id") % 4, table(spark, sf_dir, "documents")
    state = F.when(four == 0, "processing").when(four == 1, "failed").when(four == 2, "processed").otherwise("pending")
    status = docs.select(F.col("doc_id").cast("string").alias("id"), state.alias("status"), F.when(four == 1, "e").alias("error"))
    return store.consistent(status, docs.where("doc_id % 3 <> 0").select(F.col("doc_id").cast("string").alias("id")))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50 offset 100")
def paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.page(table(spark, sf_dir, "orders"), 3, 50, "o_totalprice", "o_orderkey").select("o_orderkey", "o_totalprice")


@query("select l_orderkey, l_linenumber from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F')")
def m13_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return store.cascade(kept, table(spark, sf_dir, "lineitem"), "l_orderkey").select("l_orderkey", "l_linenumber")


@query("with a as (select event_id % 500 as id from events), c as (select distinct event_id % 500 as id, 'v' || (event_id % 500) as value from events where event_id % 500 < 200) select a.id, c.value, c.value is not null as hit from a left join c on c.id = a.id")
def m15_cache_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "events").select((F.col("event_id") % 500).alias("id"))
    cache = asked.where("id < 200").distinct().withColumn("value", F.concat(F.lit("v"), "id"))
    return store.split_hits(asked, cache, "id", "value")


@query(f"""with {E}, ways as (select src, tgt, weight from e union all select tgt, src, weight from e) select src, tgt, weight from ways""")
def s21_export_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return e.unionByName(e.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), "weight"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of a file that is there."""
    path = f"{sf_dir}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else sf_dir + "/events*.parquet")


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


@query(f"with {STATE}, t as (select user_id, count(*) filter (where status = 'Succeed') as succeeded, count(*) as total from c group by user_id) select user_id, succeeded, total, least(100, succeeded * 100 // total) as progress from t")
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events through a stream: rejected rows aside, the rest written, then rolled up."""
    out, bad, marks = (new_path(spark, x) for x in ("accepted", "rejected", "marks"))

    def work(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={number}")

    streams.run(_stream(spark, sf_dir), F.when(F.col("user_id").isNull(), "no user"), work, bad, marks).awaitTermination()
    seen = spark.read.parquet(out)
    state = F.when(F.col("event_type") == "purchase", "Succeed").otherwise("Other")
    totals = seen.groupBy("user_id").agg(F.count("*").alias("total"))
    return streams.progress(seen.select("user_id", state.alias("status")).join(totals, "user_id"), "user_id", "status", "total").select("user_id", "succeeded", "total", "progress")


@query(f"with {STATE} select user_id, arg_max(status, ts) as state, max(ts) as at from c group by user_id")
def stream_last_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.last_state(chunk_status(spark, sf_dir), "user_id", "status", "ts")


@query("""with recursive e as (select event_id, user_id, ts, case event_type when 'view' then 'pending' when 'purchase' then 'done' when 'error' then 'failed' else 'running' end as t, round_even(value, 0)::int as p from events),
o as (select *, row_number() over (partition by user_id order by ts, event_id) as n from e where user_id is not null),
m(user_id, n, event_id, f, t, state, progress, refused) as (
  select user_id, 0::bigint, null::bigint, '', '', '', 0, null::varchar from (select distinct user_id from o) union all
  select o.user_id, o.n, o.event_id, m.state, o.t,
    case when ok then o.t else m.state end,
    case when not ok then m.progress when o.t = 'done' then 100 when o.t = m.state then greatest(m.progress, least(100, greatest(0, o.p))) else least(100, greatest(0, o.p)) end,
    case when not ok then (case when m.state = '' then 'new' else m.state end) || ' to ' || o.t end
  from m join o on o.user_id = m.user_id and o.n = m.n + 1,
    lateral (select (m.state = '' and o.t = 'pending') or (m.state = 'pending' and o.t in ('running', 'failed')) or (m.state = 'running' and o.t in ('running', 'done', 'failed')) or (m.state = 'failed' and o.t = 'pending') as ok) k)
select event_id, user_id::varchar as key, f as "from", t as "to", state, progress, refused from m where n > 0""")
def stream_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as moves of a job for each user, through a stream with keyed state; illegal ones are refused."""
    out, marks = new_path(spark, "moves"), new_path(spark, "marks")
    kind = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("running")
    events = _stream(spark, sf_dir).withColumn("to", kind)
    stateful.start(stateful.transitions(events, "user_id", "to", "ts", "event_id", F.bround("value")), out, marks).awaitTermination()
    return spark.read.parquet(out).select(F.col("seq").alias("event_id"), "key", "from", "to", "state", "progress", "refused")


@query("select conv_id::varchar as key, max(turn) + 1 as total from conversations where conv_id is not null group by conv_id having count(distinct turn) = max(turn) + 1")
def stream_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of which every turn has come, each once."""
    out, marks, path = new_path(spark, "complete"), new_path(spark, "marks"), f"{sf_dir}/conversations.parquet"
    rows = spark.read.parquet(path)
    totals = rows.groupBy("conv_id").agg((F.max("turn") + 1).alias("total"))
    turns = spark.readStream.schema(rows.schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else sf_dir + "/conversations*.parquet")
    stateful.start(stateful.complete(turns.join(totals, "conv_id"), "conv_id", "turn", "total"), out, marks).awaitTermination()
    return spark.read.schema("key string, total long").parquet(out).select("key", "total")


_MIX = f"""with {CHUNKS}, near as (select vec_id, {EXACT} as similarity from embeddings where {EXACT} > 0.2 order by similarity desc, vec_id limit 20),
c as (select c.doc_id, c.chunk_order_index, near.similarity, sum(c.tokens) over (order by near.similarity desc, c.doc_id, c.chunk_order_index rows unbounded preceding) as t from near join chunks c on c.doc_id = near.vec_id)
select doc_id, chunk_order_index, round(similarity, 6) as similarity from c where t <= 6000"""


@query(_MIX)
def r4_naive_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows of the nearest documents, as many as the budget of tokens holds."""
    from tessera.operators import chunking

    near = search.top_vectors(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 20, "vec_id", "embedding", above=0.2).select(F.col("vec_id").alias("doc_id"), "similarity")
    near = F.broadcast(materialise(near, "near"))  # twenty rows
    chunks = chunking.window_chunks(table(spark, sf_dir, "documents").join(near, "doc_id", "left_semi"), 100, 20).join(near, "doc_id")
    kept = retrieval.within_budget(chunks, [F.desc("similarity"), "doc_id", "chunk_order_index"], "tokens", 6000)
    return kept.select("doc_id", "chunk_order_index", F.round("similarity", 6).alias("similarity"))


def retrieval_store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, relations and chunks with their vectors as ingestion leaves them, written once for the files as they are."""
    from tessera.operators import chunking

    def build() -> tuple[DataFrame, DataFrame, DataFrame]:
        vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
        windows = chunking.window_chunks(table(spark, sf_dir, "documents"), 100, 20)
        chunks = windows.select(F.concat_ws("-", "doc_id", "chunk_order_index").alias("chunk"), "doc_id", "content", "tokens", F.concat(F.lit("f"), F.col("doc_id") % 7).alias("file_path"))
        chunks = chunks.join(vectors.withColumnRenamed("vec_id", "doc_id"), "doc_id").drop("doc_id")
        source = F.concat_ws("-", "l_orderkey", F.col("l_linenumber") - 1)
        part = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.array_sort(F.collect_set(source)).alias("sources"))
        ents = vectors.join(part, F.col("vec_id") == F.col("l_partkey")).select(F.concat(F.lit("p"), "vec_id").alias("entity_id"), "embedding", "sources", F.lit(50).alias("tokens"))
        wired = edges(spark, sf_dir).withColumn("vec_id", F.regexp_extract("src", r"\d+", 0).cast("long")).join(vectors, "vec_id")
        rel = wired.select("src", "tgt", "weight", "embedding", F.array(F.concat_ws("-", "vec_id", F.lit(0))).alias("sources"), F.lit(40).alias("tokens"))
        return materialise(ents, "entities"), materialise(rel, "relations"), materialise(chunks, "chunks")

    return indexes.over(spark, tuple(f"{sf_dir}/{t}.parquet" for t in ("documents", "embeddings", "lineitem")), "retrieval", build)


@query()
def e2e_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole retrieval in mixed mode: entities and relations by vector, degree and budget, chunks of three lanes with references."""
    ents, rel, chunks = retrieval_store(spark, sf_dir)
    got = retrieval.retrieve(ents, rel, chunks, first_vector(spark, sf_dir), retrieval.Query(mode="mix"))
    entities = got["entities"].select(F.lit("entity").alias("kind"), F.col("entity_id").alias("name"), "position")
    relations = got["relations"].select(F.lit("relation").alias("kind"), F.concat_ws("-", "src", "tgt").alias("name"), "position")
    return entities.unionByName(relations).unionByName(got["chunks"].select(F.lit("chunk").alias("kind"), F.concat_ws(":", "chunk", "reference_id").alias("name"), "position"))


@query(f"with {E}, a as (select 's' || s_suppkey as src, 'p1' as tgt from supplier) select a.src, a.tgt, e.src is not null as has from a left join e on e.src = least(a.src, a.tgt) and e.tgt = greatest(a.src, a.tgt)")
def f6_has_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.lit("p1").alias("tgt"))
    return edit.has_pairs(asked, edges(spark, sf_dir))


@query("select c_custkey from customer where c_name in (select c_name from customer where c_nationkey = 3) and c_nationkey in (1, 3)")
def f10_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return edit.conflicts(c.where("c_nationkey = 3"), c.where("c_nationkey in (1, 3)"), ["c_name"]).select("c_custkey")


@query(f"""with {N}, {E}, m as (select case when src = 's3' then 'zz' else src end as src, case when tgt = 's3' then 'zz' else tgt end as tgt, weight from e) select least(src, tgt) as src, greatest(src, tgt) as tgt, weight from m""")
def m8_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit.rename(nodes(spark, sf_dir), edges(spark, sf_dir), "s3", "zz")[1].select("src", "tgt", "weight")


@query(f"with {E} select src, tgt, weight from e where not (src = 'p1' and tgt in (select 's' || s_suppkey from supplier where s_nationkey < 12))")
def m7_delete_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "supplier").where("s_nationkey < 12").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.lit("p1").alias("tgt"))
    return edit.delete_relations(edges(spark, sf_dir), gone).select("src", "tgt", "weight")


@query(f"""with {N}, w as (select 's' || s_suppkey as src, 'x' || s_nationkey as tgt from supplier), lost as (select tgt as entity_id, min(src || '~' || tgt) as description from w group by tgt)
select entity_id, entity_type, description from n union all select entity_id, 'UNKNOWN', description from lost""")
def m3_import_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = nodes(spark, sf_dir)
    wired = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("x"), "s_nationkey").alias("tgt"), F.lit(1.0).alias("weight"))
    wired = wired.withColumn("description", F.concat_ws("~", "src", "tgt"))
    return edit.import_graph(held, edges(spark, sf_dir), held.limit(0), wired)[0]


@query("select vec_id, case when label <> 4 then embedding[1] end as first from embeddings")
def m14_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit.reset(table(spark, sf_dir, "embeddings"), F.col("label") == 4, "embedding").select("vec_id", F.try_element_at("embedding", F.lit(1)).alias("first"))


@query(f"""with {E} select 'rel-' || md5(src || tgt) as id, 'k' || chr(9) || src || chr(9) || tgt || chr(10) || weight::bigint as content from e""")
def x1_relation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).select(edit.relation_row(F.col("tgt"), F.col("src"), F.lit("k"), F.col("weight").cast("long").cast("string")).alias("r")).select("r.*")


@query("select l_orderkey, l_linenumber from lineitem where l_orderkey % 5 <> 0 or l_orderkey % 10 in (0)")
def s22_replace_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    gone = rows.where("l_orderkey % 10 = 5").select("l_orderkey").distinct()
    return edit.replace_document(rows.join(gone, "l_orderkey", "left_anti"), rows.where("l_orderkey % 10 = 0"), "l_orderkey")


@query("select count(*) > 0 as there, (select count(*) from region where r_regionkey = 99) > 0 as none from region")
def f5_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "region")
    return spark.createDataFrame([(store.exists(rows), store.exists(rows.where("r_regionkey = 99")))], "there boolean, none boolean")


@query("select event_id, coalesce(case when user_id % 3 = 0 then event_type end, 'none') as event_type, floor(epoch(ts))::bigint as ts from events")
def f8_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("user_id") % 3 == 0, F.col("event_type")).alias("event_type"), "ts")
    return store.projected(rows, {"event_type": "none"}, ["ts"])


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.concat(F.lit("t"), F.col("o_custkey") % 9).alias("track_id"), F.concat(F.lit("f"), F.col("o_custkey")).alias("file_path"), F.col("o_orderdate").alias("created_at"))


@query("""with s as (select o_orderkey, o_orderstatus as status, 't' || o_custkey % 9 as track_id, 'f' || o_custkey as file_path, o_orderdate as created_at from orders), p as (select o_orderkey from s where file_path = 'f7' order by created_at, o_orderkey limit 1)
select 'status' as way, o_orderkey from s where status in ('F', 'P') union all select 'track', o_orderkey from s where track_id = 't4' union all select 'path', o_orderkey from p""")
def f9_status_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _status(spark, sf_dir)
    ways = {"status": store.by_status(rows, ["F", "P"]), "track": store.by_track(rows, "t4"), "path": store.by_path(rows, "f7", ["created_at", "o_orderkey"])}
    out = None
    for way, got in ways.items():
        part = got.select(F.lit(way).alias("way"), "o_orderkey")
        out = part if out is None else out.unionByName(part)
    return out


@query("select l_orderkey, l_linenumber, l_shipdate from lineitem where l_orderkey in (select o_orderkey from orders where o_orderpriority = '2-HIGH')")
def f11_chunks_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "orders").where("o_orderpriority = '2-HIGH'").select(F.col("o_orderkey").alias("l_orderkey"))
    return store.children_of(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), docs, "l_orderkey", ["l_shipdate", "l_linenumber"])


@query("select vec_id, embedding[1]::double as first, len(embedding)::int as width from embeddings where vec_id in (select o_orderkey from orders)")
def v20_vectors_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("vec_id"))
    return store.picked_vectors(table(spark, sf_dir, "embeddings"), ids, "vec_id", "embedding").select("vec_id", F.col("embedding")[0].cast("double").alias("first"), F.size("embedding").alias("width"))


@query("select count(*) as total, ceil(count(*) / 50)::bigint as pages from orders where o_orderstatus = 'F'")
def a19_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.total_for_paging(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), 50)


@query("""with u as (select role, length(text) as prompt_tokens, case when turn % 2 = 0 then turn end as completion_tokens from conversations)
select role, count(*) as calls, sum(prompt_tokens)::bigint as prompt_tokens, sum(coalesce(completion_tokens, 0))::bigint as completion_tokens, (sum(prompt_tokens) + sum(coalesce(completion_tokens, 0)))::bigint as total_tokens from u group by role""")
def a22_token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "conversations").select("role", F.length("text").alias("prompt_tokens"), F.when(F.col("turn") % 2 == 0, F.col("turn")).alias("completion_tokens"))
    return store.usage(calls, ["role"], "prompt_tokens", "completion_tokens")


@query("""with c as (select distinct event_id % 500 as id, 'v' || (event_id % 500) as value from events where event_id % 500 < 300), n as (select distinct event_id % 500 as id, case when event_id % 500 % 3 = 0 then 'w' when event_id % 500 % 3 = 1 then 'v' || (event_id % 500) end as value from events where event_id % 500 >= 200)
select coalesce(c.id, n.id) as id, coalesce(n.value, c.value) as value, n.value is not null and n.value is distinct from c.value as written from c full join n on n.id = c.id where coalesce(n.value, c.value) is not null""")
def m15_cache_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "events").select((F.col("event_id") % 500).alias("id")).distinct()
    said = F.concat(F.lit("v"), "id")
    new = ids.where("id >= 200").withColumn("value", F.when(F.col("id") % 3 == 0, "w").when(F.col("id") % 3 == 1, said))
    return store.put_cache(ids.where("id < 300").withColumn("value", said), new, "id", "value")


@query("select lang || ':' || source || ':' || md5(text) as id from documents where not (lang = 'fr' and source in ('src1', 'src2'))")
def m12_cache_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = table(spark, sf_dir, "documents").select(F.concat_ws(":", "lang", "source", F.md5("text")).alias("id"))
    return store.clear_cache(cache, ["fr"], ["src1", "src2"])


@query(f"""with {N} select entity_id as name, entity_type as kind from n union all select src, tgt from (with {E} select src, tgt from e)""")
def g12_whole_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = graph.everything(nodes(spark, sf_dir), edges(spark, sf_dir))
    return every[0].select(F.col("entity_id").alias("name"), F.col("entity_type").alias("kind")).unionByName(every[1].select(F.col("src").alias("name"), F.col("tgt").alias("kind")))


@query(f"""with {E}, k as (select src, tgt from e order by weight desc, src, tgt limit 100) select x.src, x.tgt, x.source_id from (select least(src, tgt) as src, greatest(src, tgt) as tgt, source_id from x) x join k on k.src = x.src and k.tgt = x.tgt""")
def r9_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = edges(spark, sf_dir).orderBy(F.desc("weight"), "src", "tgt").limit(100)
    return retrieval.survivors(graph.canonical(extractions(spark, sf_dir)), kept, ["src", "tgt"]).select("src", "tgt", "source_id")


@query("""select 'chunks' as kind, item_id::int as position, '{"reference_id":"' || item_id || '","content":' || to_json(text) || ',"file_path":"unknown_source","chunk_id":""}' as value from benchmark""")
def r12_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.col("item_id").alias("reference_id"), F.col("text").alias("content"), F.lit(None).cast("string").alias("file_path"))
    return retrieval.envelope("chunks", rows, "item_id")


@query("""with l as (select 'C' as tag, vec_id as chunk, row_number() over (order by vec_id) as r from embeddings where label = 1 union all select 'E', vec_id, row_number() over (order by vec_id desc) from embeddings where vec_id % 3 = 0)
select chunk, string_agg(tag || r, ',' order by tag || r) as tags from l group by chunk""")
def r13_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk"), "label", (-F.col("vec_id")).alias("back"))
    return retrieval.provenance([("C", numbered(rows.where("label = 1"), "chunk")), ("E", numbered(rows.where("chunk % 3 = 0"), "back"))])


@query("select 'orders' as kind, (select count(*) from orders) as found, (select count(*) from orders where o_totalprice > 100000) as kept union all select 'parts', (select count(*) from part), (select count(*) from part where p_size = 7)")
def r14_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = {"orders": table(spark, sf_dir, "orders"), "parts": table(spark, sf_dir, "part")}
    return retrieval.processed(found, {"orders": found["orders"].where("o_totalprice > 100000"), "parts": found["parts"].where("p_size = 7")})


@query("select substr(text, 1, 256) as name, doc_id from documents")
def x9_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.functions.text import truncated

    return table(spark, sf_dir, "documents").select("doc_id", truncated(F.col("text")).alias("name"))


@query("""select conv_id, turn, case when turn % 4 = 3 then '' else trim(role || ' a') || '|b' end as facts from conversations""")
def x12_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.functions.text import facts

    body = F.concat(F.lit('{"facts": [" '), F.coalesce("role", F.lit("")), F.lit(' a ", "", "b"]}'))
    four = F.col("turn") % 4
    said = F.when(four == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(four == 1, body).when(four == 2, F.concat(F.lit("Here: "), body, F.lit(" done"))).otherwise("no facts")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(facts(said), "|").alias("facts"))


@query("""with d as (select doc_id, 'doc-' || md5(trim(text, ' ' || chr(9) || chr(10) || chr(13))) as id, text from documents where doc_id % 10 <> 3),
u as (select id, min(doc_id) as doc_id from d group by id), known as (select 'doc-' || md5(trim(text, ' ' || chr(9) || chr(10) || chr(13))) as id from documents where doc_id % 10 = 3)
select id as full_doc_id, 0 as chunk_order_index, 'chunk-' || md5('part') as id from u where id not in (select id from known) union all select id, 2, 'chunk-' || md5('rest') from u where id not in (select id from known)""")
def m4_custom_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = docs.where("doc_id % 10 = 3").select(content_id("doc-", F.regexp_replace("text", r"^\s+|\s+$", "")).alias("id"))
    given = docs.where("doc_id % 10 <> 3").dropDuplicates(["text"]).withColumn("parts", F.array(F.lit("part"), F.lit("  "), F.lit("rest"), F.lit(" part")))
    return store.custom_chunks(given, "text", "parts", known)[1].select("id", "full_doc_id", "chunk_order_index")

"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import forest, jaccard, language, lines, mining, mixing, packing, quality, spelling, substrings, tokens, topk, warc
from tessera.plans.staging import table

QUALITY_THRESHOLD = 0.3
#: Vectors without null or non-finite components.
FINITE = "embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"


#: Bisection of the exponent (35 halvings for the entropy, then as many for the repetition), budgets, and the cut of the last pass.
MIXING_SQL = """
with recursive d as (select doc_id, source, coalesce(source, '') as s, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0) as n from documents),
s as (select s, sum(n)::double as t from d where n > 0 group by s),
g as (select sum(t) as budget, 0.98 * ln(count(*)) as target from s),
e(i, lo, hi) as (
  select 0, 0.0::double, 1.0::double union all
  select i + 1,
    case when (select ln(sum(pow(t, (lo + hi) / 2))) - sum(pow(t, (lo + hi) / 2) * ((lo + hi) / 2) * ln(t)) / sum(pow(t, (lo + hi) / 2)) from s) >= (select target from g) then (lo + hi) / 2 else lo end,
    case when (select ln(sum(pow(t, (lo + hi) / 2))) - sum(pow(t, (lo + hi) / 2) * ((lo + hi) / 2) * ln(t)) / sum(pow(t, (lo + hi) / 2)) from s) >= (select target from g) then hi else (lo + hi) / 2 end
  from e where i < 35),
r(i, lo, hi) as (
  select 0, 0.0::double, 1.0::double union all
  select i + 1,
    case when (select (select budget from g) * max(pow(t, (lo + hi) / 2 - 1)) / sum(pow(t, (lo + hi) / 2)) from s) > 4 then (lo + hi) / 2 else lo end,
    case when (select (select budget from g) * max(pow(t, (lo + hi) / 2 - 1)) / sum(pow(t, (lo + hi) / 2)) from s) > 4 then hi else (lo + hi) / 2 end
  from r where i < 35),
h as (select case when (select ln(sum(t)) - sum(t * ln(t)) / sum(t) from s) >= (select target from g) then 1.0 else (select lo from e where i = 35) end as a),
x as (select case when a < 1 and (select (select budget from g) * max(pow(t, a - 1)) / sum(pow(t, a)) from s) > 4 then (select hi from r where i = 35) else a end as a from h),
w as (select s, t, pow(t, (select a from x)) / (select sum(pow(t, (select a from x))) from s) as weight from s),
b as (select s, t, weight, floor(weight * (select budget from g)) as budget from w),
p as (select s, weight, floor(budget / t)::bigint as passes, least(4096, ceil(t / 65536))::bigint as blocks, (budget - floor(budget / t) * t)::bigint as rest from b),
k as (select d.doc_id, d.source, d.n, p.*, (('0x' || substr(md5('17:block:' || coalesce(doc_id::varchar, '')), 1, 15))::bigint % blocks) as block,
      ('0x' || substr(md5('17:inner:' || passes || ':' || coalesce(doc_id::varchar, '')), 1, 15))::bigint as inn from d left join p on d.s = p.s),
bs as (select s, block, rest, ('0x' || substr(md5('17:pass:' || passes || ':' || s || ':' || block), 1, 15))::bigint as ord, sum(n) as t from k where n > 0 group by s, block, rest, ord),
be as (select *, sum(t) over (partition by s order by ord, block rows unbounded preceding) as tail from bs),
f as (select s, block, ord, rest, tail, t, tail <= rest as whole, row_number() over (partition by s, tail <= rest order by ord, block) as nth from be),
ke as (select k.doc_id, k.source, k.n, k.weight, k.passes, f.whole, not f.whole and f.nth = 1 as cut, f.rest - f.tail + f.t as room,
       sum(k.n) over (partition by k.s, k.block, k.n > 0 order by k.inn, coalesce(k.doc_id::varchar, '') range unbounded preceding) as upto
       from k left join f on k.s = f.s and k.block = f.block)
select doc_id, source, n::bigint as n_tokens, case when n > 0 then passes + (whole or (cut and upto <= room))::bigint else 0 end::bigint as copies, round(weight, 9) as weight from ke"""


#: Shingles by their MD5, all pairs of documents that share one, and what links reach.
JACCARD_SQL = """
with recursive t as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
d as materialized (select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as g from t),
e as materialized (select doc_id, len(g)::bigint as n, md5_number(unnest(g)) as s from d where len(g) > 0 and doc_id is not null),
p as (select a.doc_id as a, b.doc_id as b, a.n as n, b.n as m, count(*) as c from e a join e b on a.s = b.s and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) group by all),
l as materialized (select a, b from p where 100 * c >= 85 * (n + m - c)),
y as materialized (select a, b from l union all select b, a from l),
r(doc_id, x) as (select a, b from y union select r.doc_id, y.b from r join y on y.a = r.x),
k as (select doc_id, min(x) as x from r group by doc_id)
select d.doc_id, coalesce(len(g), 0)::bigint as n_shingles, least(d.doc_id, k.x) as component_id from d left join k on k.doc_id = d.doc_id"""


#: Strings by their MD5; starts that lie within 200 bytes of the one before belong to one run.
SUBSTRINGS_SQL = """
with h as materialized (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
s as (select doc_id, x, unnest(range(0, length(x) // 2 - 199)) as i from h),
w as materialized (select doc_id, i, md5_number(substr(x, 2 * i + 1, 400)) as k from s),
r as (select k from w group by k having count(*) > 1),
c as (select doc_id, i, coalesce(lag(i) over (partition by doc_id order by i) + 200, -1) as past from w semi join r on w.k = r.k),
q as (select doc_id, i, sum((i > past)::int) over (partition by doc_id order by i rows unbounded preceding) as span from c),
p as (select doc_id, span, min(i) as first, max(i) + 200 as past from q group by doc_id, span),
m as (select doc_id, count(*) as spans, sum(past - first)::bigint as gone, list({'first': first, 'past': past} order by first) as a from p group by doc_id),
b as (select h.doc_id, x, coalesce(gone, 0) as gone, coalesce(spans, 0) as spans, a from h left join m on m.doc_id = h.doc_id),
o as (select *, case when a is null then x else array_to_string(list_transform(range(0, len(a) + 1), lambda j: substr(x, 2 * case when j = 0 then 0 else a[j].past end + 1, 2 * (case when j = len(a) then length(x) // 2 else a[j + 1].first end - case when j = 0 then 0 else a[j].past end))), '') end as kept from b)
select doc_id, (length(x) // 2)::bigint as n_bytes, gone::bigint as n_removed, spans::bigint as n_spans, sha256(unhex(kept)) as kept_sha256 from o"""


#: The crc32 over a table of its 256 steps; near words by what is left without one code point.
SPELLING_SQL = """
with recursive t as materialized (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda v, k: case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end)) as tab),
r as (select doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w, count(*) as c
      from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{00FF}]{6,}')) as w from documents) group by all),
b as (select *, flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || w, ''), lambda x: case when unicode(x) < 128 then [unicode(x)] else [192 + unicode(x) // 64, 128 + unicode(x) % 64] end)) as bytes from r),
h as (select w, c, xor(list_reduce(list_prepend(4294967295, bytes), lambda v, y: xor(v // 256, tab[(xor(v, y) & 255) + 1])), 4294967295) as h from b, t),
s as (select case when h % 199 = 0 then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end as word, c from h),
v as materialized (select word, sum(c)::bigint as n from s where length(word) >= 6 group by word having sum(c) >= 5),
e as materialized (select word, n, i, substr(word, 1, i) || substr(word, i + 2) as rest from (select word, n, unnest(range(length(word))) as i from v)),
p as (select a.word, b.word as other, b.n as m from e a join e b on a.i = b.i and a.rest = b.rest and a.word <> b.word union
      select e.word, v.word, v.n from e join v on v.word = e.rest union
      select v.word, e.word, e.n from e join v on v.word = e.rest),
q as (select word, count(*) as n_near, max(m) as m from p group by word),
f as materialized (select v.word, v.n, coalesce(n_near, 0) as n_near, case when m >= 5 * v.n then (select min(other) from p where p.word = v.word and p.m = q.m) end as form, case when m >= 5 * v.n then m end as form_n from v left join q on q.word = v.word),
g(word, led, form) as (select word, form, form from f where form is not null union all select g.word, f.form, f.form from g join f on f.word = g.led where f.form is not null),
z as (select g.word, g.led as root from g join f on f.word = g.led where f.form is null)
select f.word, f.n, f.n_near::bigint as n_near, f.form, f.form_n::bigint as form_n, coalesce(z.root, f.word) as root from f left join z on z.word = f.word"""


def held_out(key: str = "doc_id"):
    """Rows of the fifth that no model learns from; a row without an id has no label to learn from, and belongs to them."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10, "vec_id", "embedding")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    directory, root = warc.archive(spark, pages)
    return warc.lookup(warc.wanted(pages), directory, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").where(FINITE)
    whole = rows.withColumn("units", F.transform("embedding", lambda x: F.floor(64 * x.cast("double"))))
    return topk.search(whole, F.col("vec_id") % 20 == 0, 20, "vec_id", "units")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), size=2048)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.fit(table(spark, sf_dir, "documents"))
    return language.identify(table(spark, sf_dir, "pages"), model)


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove(table(spark, sf_dir, "documents").select("doc_id", "text"), length=200)
    return kept.select("doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"), F.col("_n_spans").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out())
    model = quality.fit(docs.select("doc_id", "text"), labels)
    out = quality.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), jaccard.Rule(words=4, num=85))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = mixing.mix(docs.select("doc_id", "source", "text"), mixing.words("text"), budget_share=1.0, entropy_share=0.98, repetition=4.0)
    return out.select("doc_id", "source", F.col("_tokens").alias("n_tokens"), F.col("_copies").alias("copies"), F.round("_weight", 9).alias("weight"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.count_words(table(spark, sf_dir, "documents"), "doc_id", "text", shortest=6, every=199).where("n >= 5")
    return spelling.variants(words, ratio=5)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    store = lines.LineStore.new(spark, least=3, shortest=20)
    store.insert(docs)
    kept = store.strip(docs)
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding").where(FINITE)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = rows.select("vec_id", label.alias("label"), F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("units"))
    return mining.mine(whole, F.col("vec_id") % 50 == 0, "vec_id", "label", "units", positives=5, negatives=3, low=50, high=95)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_token_counts, op2_neighbours, op3_warc, op4_topk, op5_packing, op6_language, op7_substrings, op8_quality, op9_jaccard, op10_mixing, op11_spelling, op12_line_dedup, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc": """
            with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
            d as (select page_id, octet_length(payload) as payload_bytes, sha1(payload) as payload_digest from p),
            m as (select *, max(page_id) over (partition by payload_digest) as last from d)
            select page_id, payload_bytes, payload_digest,
                   case when payload_bytes >= 1000 and last <> page_id then 'revisit' else 'response' end as record_type,
                   case when payload_bytes >= 1000 and last <> page_id then last end as refers_to from m""",
        "op10_mixing": MIXING_SQL,
        "op7_substrings": SUBSTRINGS_SQL,
        "op9_jaccard": JACCARD_SQL,
        "op11_spelling": SPELLING_SQL,
        "op12_line_dedup": """
            with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as a from documents),
            l as (select r, doc_id, unnest(a) as line, generate_subscripts(a, 1) as i from d),
            k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from l),
            g as (select k, max(doc_id) as last from k where length(k) >= 20 group by k having count(distinct doc_id) + max((doc_id is null)::int) >= 3),
            m as (select k.*, g.k is not null and k.doc_id is distinct from g.last as gone from k left join g on k.k = g.k)
            select any_value(doc_id) as doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256 from m group by r""",
        "op13_hard_negatives": """
            with c as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) v from embeddings
                       where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
            p as (select q.vec_id as anchor_id, c.vec_id, c.label = q.label as same, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score
                  from c q, c where q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
            g as (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as nth from p where same qualify nth <= 5),
            w as (select g.anchor_id, g.vec_id as positive_id, n.vec_id as negative_id, g.score as positive_score, n.score as negative_score
                  from g join p n on n.anchor_id = g.anchor_id where not n.same and 50 * g.score <= 100 * n.score and 100 * n.score <= 95 * g.score)
            select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by negative_score desc, negative_id)::int as rank, negative_id, positive_score, negative_score
            from w qualify rank <= 3""",
        "op4_topk": """
            with c as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) v from embeddings
                       where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
            p as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score
                  from c q, c where q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
            r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from p)
            select query_id, rank, vec_id, score from r where rank <= 20""",
    }

"""Operators on small literal inputs, with the semantics the inventory names."""

from __future__ import annotations

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import hooks, lists, text
from tessera.operators import chunking, extraction, graph, merge, retrieval, search, store
from tessera.sources import parsers


def one(spark, column, **values):
    names = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], names).select(column).first()[0]


@pytest.mark.parametrize(("name", "want"), [("<p>Alpha<br/>", "Alpha"), ("ＡＢＣ１２３", "ABC123"), ('"Quoted"', "Quoted"), ("12", ""), ("1.2.3", ""), ("123", "123"), ("中 文", "中文"), ("  x ", "x"), ("中 a b 文", "中a b文"), ("１．２", "1．2"), ("\'a\'b\'", "\'a\'b\'"), ("《书》", "书"), ("“x”y", "xy"), ("中\"文", "中文"), ("a—b－c", "a-b-c"), ("</P ><br>n", "n")])
def test_names(spark, name, want):
    assert one(spark, text.normalize_name(F.col("n")), n=name) == want


def test_sanitize_and_thoughts(spark):
    assert one(spark, text.sanitize(F.col("t")), t="  a\x00b &lt;c&gt; &amp;amp; \x85") == "ab <c> &amp;"
    assert one(spark, text.without_thoughts(F.col("t")), t="<think>x</think> y") == "y"
    assert one(spark, text.without_thoughts(F.col("t")), t="left</think>right") == "right"
    assert one(spark, text.without_thoughts(F.col("t")), t="plain") == "plain"
    assert one(spark, text.without_thoughts(F.col("t")), t="a<think>b</think>c") == "c"
    assert one(spark, text.without_thoughts(F.col("t")), t="<think>a</think>b</think>c") == "b</think>c"


def test_pair_key_has_no_direction(spark):
    r = spark.createDataFrame([("b", "a"), ("a", "b")], "x string, y string").select(text.pair_key(F.col("x"), F.col("y")).alias("k")).distinct().collect()
    assert [x.k for x in r] == ["a<SEP>b"]


def test_list_algebra(spark):
    a, b = ["x", "y", "x", "z"], ["z", "w", ""]
    assert one(spark, lists.union(F.col("a"), F.col("b")), a=a, b=b) == ["x", "y", "z", "w"]
    assert one(spark, lists.subtract(F.col("a"), F.col("b")), a=a, b=["y"]) == ["x", "x", "z"]
    assert one(spark, lists.cap(F.col("a"), 2), a=a) == ["x", "z"]
    assert one(spark, lists.cap(F.col("a"), 9), a=a) == a
    assert one(spark, lists.cap(F.col("a"), 2, "KEEP"), a=a) == ["x", "y"]
    assert one(spark, lists.cap(F.col("a"), 0), a=a) == []
    assert one(spark, lists.keywords(F.col("a")), a=["gamma, alpha", "beta,alpha"]) == "alpha,beta,gamma"


def test_majority_prefers_the_first_seen(spark):
    rows = spark.createDataFrame([("n", "b", 0), ("n", "a", 1), ("n", "a", 2), ("n", "b", 3), ("m", "concept", 0), ("m", "method", 1), ("m", "concept", 2)], "name string, type string, pos int")
    assert {r.name: r.type for r in merge.majority(rows, ["name"], "type", "pos").collect()} == {"n": "b", "m": "concept"}


def test_relations_sum_weights_and_skip_loops(spark):
    rows = spark.createDataFrame([("a", "b", 2.0, "alpha,beta", "1", 0), ("b", "a", 3.0, "gamma", "2", 1), ("c", "c", 1.0, "x", "3", 2)], "src string, tgt string, weight double, keywords string, source_id string, pos int")
    got = merge.relations(rows).collect()
    assert [(r.src, r.tgt, r.weight, r.keywords, r.source_ids) for r in got] == [("a", "b", 5.0, "alpha,beta,gamma", ["1", "2"])]


def test_merging_in_two_steps_is_merging_at_once(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("abc"), rnd.choice("abc"), float(rnd.randrange(9)), rnd.choice(["k", "l"]), str(i), i) for i in range(60)]
    schema = "src string, tgt string, weight double, keywords string, source_id string, pos int"
    whole = merge.relations(spark.createDataFrame(rows, schema)).select("src", "tgt", "weight").collect()
    half = merge.relations(spark.createDataFrame(rows[:30], schema)).select("src", "tgt", "weight", "keywords", F.lit("h").alias("source_id"), F.lit(-1).alias("pos"))
    assert sorted(whole) == sorted(merge.relations(half.union(spark.createDataFrame(rows[30:], schema))).select("src", "tgt", "weight").collect())


def test_records(spark):
    raw = "entity<|#|>Oak<|##|>Natural Object<|#|>a tree\nrelation<|#|>Oak<|#|>Elm<|#|>kin，like<|#|>both trees\nrelation<|#|>Oak<|#|>\"Oak\"<|#|>x<|#|>loop\nentity<|#|>a<|#|>b<|#|><|COMPLETE|>"
    df = spark.createDataFrame([(7, raw), (8, None), (9, "")], "chunk long, t string").withColumn("kind", F.lit("clash"))
    got = sorted(map(tuple, extraction.extracted(df, "t", ["chunk"]).collect()))
    assert got == [
        (7, 0, "entity", "Oak", "naturalobject", None, None, None, "a tree", None), (7, 1, "relation", None, None, "Oak", "Elm", "kin,like", "both trees", 1.0),
        (7, 2, "rejected", None, None, None, None, None, 'relation<|#|>Oak<|#|>"Oak"<|#|>x<|#|>loop', None), (7, 3, "rejected", None, None, None, None, None, "entity<|#|>a<|#|>b", None),
    ]


def test_records_are_cleaned():
    assert extraction.entity(["entity", '"Ann"', "Natural Object", "a <b>, &amp; b"]) == ("Ann", "naturalobject", "a <b>, & b")
    assert extraction.entity(["entity", "Ann", "type<bad>", "x"]) is None and extraction.entity(["entity", "12", "t", "x"]) is None and extraction.entity(["entity", "A", "t"]) is None
    assert extraction.relation(["relation", '"A"', "A", "k", "d"]) is None
    assert extraction.relation(["relationship", "<p>A</p>", "中 国 “B”", "x，y", '"5"']) == ("A", "中国 B", "x,y", "", 5.0)  # a description that is a short number is none
    assert extraction.relation(["relation", "A", "B", "k", "'.5'"])[4] == 0.5 and extraction.relation(["relation", "A", "B", "k", "5."])[4] == 1.0


def test_fields_are_cleaned_as_names_are(spark):
    said = ['"Ann"', "'x'", "“中 文”", "ＡＢ １", "<br/>a", "7", "77", "777", "1.2", "1.2.3.4", "a\xa0b", "中\u202f文", "a\u202fb", "it's", "《书》", "中 a", "a 中", "  pad ", "a\x07b", "&lt;p&gt;q", "‘y’ z", "'中'文", "x—y"]
    df = spark.createDataFrame([(x,) for x in said], "t string")
    for names in (True, False):
        want = [r.n for r in df.select(text.normalize_name(text.sanitize(F.col("t")), names).alias("n")).collect()]
        assert [extraction.cleaned(x, names) for x in said] == want


def test_windows_emit_the_tail(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(11)))), (2, ""), (3, None)], "doc_id int, text string")
    got = [(r.tokens, r.content.split()[0]) for r in chunking.window_chunks(docs, 5, 2).orderBy("chunk_order_index").collect()]
    assert got == [(5, "0"), (5, "3"), (5, "6"), (2, "9")]
    assert [r.tokens for r in chunking.window_chunks(docs, 5, 2, tail=False).orderBy("chunk_order_index").collect()] == [5, 5, 5]


def test_tokenizers_keep_or_drop_what_stands_between(spark):
    from tessera.functions import tokenizers

    docs = spark.createDataFrame([(1, "one  two\nthree four\n\nfive ")], "doc_id int, text string")
    got = [r.content for r in chunking.window_chunks(docs, 3, 1, tokenizer=tokenizers.Pieces()).orderBy("chunk_order_index").collect()]
    assert got == ["one  two\nthree", "three four\n\nfive", "five"]
    t = "a\n b  "
    assert tokenizers.Pieces().decode(tokenizers.Pieces().encode(t)) == t and tokenizers.Words().encode(t) == ["a", "b"]


def test_scores_are_not_rounded_before_they_are_cut(spark):
    rows = spark.createDataFrame([(1, [0.2 - 1e-8, (1 - (0.2 - 1e-8) ** 2) ** 0.5]), (2, [0.2 + 1e-8, (1 - (0.2 + 1e-8) ** 2) ** 0.5])], "id int, v array<double>")
    assert [r.id for r in search.top_vectors(rows, [1.0, 0.0], 5, "id", "v", at_least=0.2).collect()] == [2]
    assert [r.id for r in search.top_vectors(rows, [1.0, 0.0], 1, "id", "v").collect()] == [2]


def test_split_only_raises_over_the_limit(spark):
    docs = spark.createDataFrame([(1, "a b c|d")], "doc_id int, text string")
    assert [r.content for r in chunking.split_chunks(docs, r"\|", 3, 0, only=True).orderBy("chunk_order_index").collect()] == ["a b c", "d"]
    with pytest.raises(Exception, match="exceeds the limit"):
        chunking.split_chunks(docs, r"\|", 2, 0, only=True).collect()


def test_markdown_parts():
    assert list(chunking.markdown_parts("# Top\n\n## Sub\n\nbody")) == [("# Top\n## Sub\n\nbody", "# Top\n## Sub\n\nbody", "Top > Sub", 0)]
    assert [p for _, _, p, _ in chunking.markdown_parts("no headings")] == [None]
    assert list(chunking.markdown_parts("  \n")) == []
    grid = "| a | b |\n| --- | --- |\n| 1 | 2 |"
    got = list(chunking.markdown_parts(f"## H\n\nsome words\n\n{grid}\n\nafter"))
    assert [grid in c for c, *_ in got] == [False, True, False]
    parts = list(chunking.markdown_parts("\n\n".join(["one two three four five six seven eight"] * 3), chunking.Sizes(child=15)))
    assert len(parts) >= 2 and len({p for _, p, *_ in parts}) == 1


def test_long_tables_go_by_row():
    rows = "\n".join(f"| {i} | {'w ' * 30}|" for i in range(20))
    got = [c for c, *_ in chunking.markdown_parts(f"| a | b |\n| --- | --- |\n{rows}")]
    assert len(got) == 20 and all(c.startswith("| a | b |") for c in got)


def test_tables_lose_nothing_and_long_cells_go_by_items():
    one, w = lambda t, **k: [c for c, *_ in chunking.markdown_parts(t, chunking.Sizes(**k))], lambda n, x="w": " ".join([x] * n)
    head = "| a | b |\n| --- | --- |"
    assert one("| " + w(300) + " | b |\n| --- | --- |") == ["| " + w(300) + " | b |\n| --- | --- |"]  # no row, and yet not lost
    cut = one(f"{head}\n| {w(900)} | x |")
    assert len(cut) == 4 and all(len(c.split()) <= 256 for c in cut) and " ".join(cut).split().count("w") == 900
    for marks in ("• ", "1. ", "+ ", "- "):
        got = one(f"{head}\n| {marks}{w(150)} {marks}{w(150, 'v')} {marks}{w(150, 'u')} | x |")
        assert [(c.split().count("w"), c.split().count("v"), c.split().count("u")) for c in got] == [(150, 150, 0), (0, 0, 150)] and all(c.startswith(head) and c.endswith("| x |") for c in got)
    assert [c.split("\n")[2] for c in one(f"{head}\n| {w(150)}; {w(150, 'v')}; {w(150, 'u')} | x |")] == [f"| {w(150)} {w(150, 'v')} | x |", f"| {w(150, 'u')} | x |"]
    assert one(f"## H\n\ncaption here\n\n{head}\n| 1 | 2 |")[1] == f"## H\n\ncaption here\n\n{head}\n| 1 | 2 |".replace("## H", "# H")
    assert one(f"{w(250)}\n\n{head}\n| 1 | 2 |")[1] == f"{head}\n| 1 | 2 |"  # the caption doesn't fit
    assert not chunking.is_table("| a | b |\n| 1 | 2 |") and not chunking.is_table("a | b\n--- | ---")


def test_equal_parts_of_a_document_are_parents_of_their_own(spark):
    df = spark.createDataFrame([(1, "# A\n\nsame\n\n# A\n\nsame")], "doc_id long, text string")
    rows = chunking.chunk_markdown(df).collect()
    assert len({r.parent_id for r in rows}) == 2 and {r.parent_text for r in rows} == {"# A\n\nsame"}


def test_long_paragraphs_are_cut_by_the_tokenizer(spark):
    class Letters:
        def encode(self, t):
            return list(t)

        def decode(self, tokens):
            return "".join(tokens)

    got = [c for c, *_ in chunking.markdown_parts("abcdefghij klm", chunking.Sizes(child=5, tokenizer=Letters()))]
    assert got == ["abcde", "fghij", "klm"]


def test_mode_of_a_document_is_decided_by_the_exact_share(spark):
    rows = [("d", "TEXT" if i % 5 else "IMAGE") for i in range(20)] + [("e", "TEXT" if i % 5 or i == 0 else "IMAGE") for i in range(10)] + [("f", "IMAGE" if i % 5 == 0 else "TEXT") for i in range(11)]
    got = {r.doc: r.mode for r in parsers.document_mode(spark.createDataFrame(rows, "doc string, label string"), "doc", "label").collect()}
    assert got == {"d": "TEXT", "e": "TEXT", "f": "HYBRID"}


def test_legal_chunks():
    law = "intro\n\nĐiều 1. First\n" + "x " * 120 + "\n\nĐiều 2. Second\n" + "y. " * 1200
    got = chunking.legal_chunks(law)
    assert [(g[1], g[3]) for g in got][:3] == [(None, 1), ("Điều 1", 3), ("Điều 2", 6)]
    assert "".join(c for c in law if c.strip()) == "".join(c for g in got for c in g[0] if c.strip())
    assert [g[1] for g in chunking.legal_chunks("  Điều 1 x\n# Điều 2 y")] == [None, "Điều 2 y"]  # neither line begins with an article
    under = chunking.legal_chunks("# Law\n#### Deep\nĐiều 1. a\nĐiều 2. b")
    assert [(g[1], g[2]) for g in under] == [(None, ["Law"]), ("Điều 1", ["Law", "Deep"]), ("Điều 2", ["Law", "Deep"])]
    levels = chunking.legal_chunks("x\n# A\n## B\nbody\n## C\nmore")
    assert [(g[1], g[2], g[3]) for g in levels] == [(None, [], 1), ("A", ["A"], 2), ("B", ["A", "B"], 3), ("C", ["A", "C"], 5)]
    said = ["p" * 900, "q" * 700, "r" * 100]
    assert chunking.legal_chunks("\n\n".join(said)) == [(said[0], None, [], 0), ("\n\n".join([said[0][-200:], *said[1:]]), None, [], 0)]
    long = chunking.legal_chunks("# H\n" + "\n\n".join(["a" * 1000, "b" * 1000, "c" * 600, "d" * 100]))
    assert [len(g[0]) for g in long] == [1004, 1000, 702] and {g[1] for g in long} == {"H"}


def test_round_robin(spark):
    lanes = [spark.createDataFrame([(k, i) for i, k in enumerate(x)], "k string, rank int") for x in ("AB", "CA")]
    assert [r.k for r in retrieval.round_robin(lanes, ["k"]).orderBy("position").collect()] == ["A", "C", "B"]


def test_polling_against_a_fold(spark):
    rnd = random.Random(4)
    for _ in range(4):
        items = [[f"{i}-{j}" for j in range(rnd.randrange(0, 8))] for i in range(5)]
        items = [x for x in items if x] or [["a"]]
        rows = [(str(i), i, c, j + 1) for i, x in enumerate(items) for j, c in enumerate(x)]
        got = {r.chunk for r in retrieval.weighted_polling(spark.createDataFrame(rows, "item string, rank int, chunk string, place int"), 5, 1).collect()}
        n, want, spare = len(items), [], 0
        quota = [5 if n == 1 else int(round(5 - i * 4 / (n - 1))) for i in range(n)]
        for x, q in zip(items, quota):
            want += x[:q]
            spare += max(0, q - len(x))
        rest = [c for x, q in zip(items, quota) for c in x[q:]]
        assert got == set(want + rest[:spare])


def test_budget_is_a_prefix(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([3, 4, 9, 1])], "i int, t int")
    for most, want in ((0, []), (2, []), (7, [0, 1]), (8, [0, 1]), (17, [0, 1, 2, 3])):
        assert [r.i for r in retrieval.within_budget(rows, ["i"], "t", most).orderBy("i").collect()] == want


def test_subgraph_takes_levels_then_degree(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 1.0), ("c", "d", 1.0), ("c", "e", 1.0), ("d", "f", 1.0)], "src string, tgt string, weight double")
    nodes, edges = graph.subgraph(e, "a", 3, 4)
    assert {(r.node, r.level) for r in nodes.collect()} == {("a", 0), ("c", 1), ("b", 1), ("d", 2)}
    assert {(r.src, r.tgt) for r in edges.collect()} == {("a", "b"), ("a", "c"), ("c", "d")}
    assert graph.subgraph(e, "nobody", 3, 4)[0].count() == 0


def test_enqueue(spark):
    docs = spark.createDataFrame([(1, " same ", "f"), (2, "same", "g"), (3, "new", "h"), (4, " ", "i"), (5, "old", "j")], "doc_id int, text string, path string")
    known = docs.where("doc_id = 5").select(text.content_id("doc-", F.col("text")).alias("id"))
    got = {r.pos: (r.id[:4], r.status) for r in store.enqueue(docs, known, "doc_id", "text", "path").collect()}
    assert got == {1: ("doc-", "pending"), 2: ("dup-", "failed"), 3: ("doc-", "pending"), 5: ("dup-", "failed")}


def test_deleting_what_was_inserted_changes_nothing(spark):
    rows = spark.createDataFrame([("e", ["1", "2"]), ("f", ["2"]), ("g", ["1"])], "id string, sources array<string>")
    gone = spark.createDataFrame([("2",)], "source string")
    got = {r.id: (r.action, r.remaining) for r in merge.without_document(rows, "sources", gone).collect()}
    assert got == {"e": ("rebuild", ["1"]), "f": ("delete", []), "g": ("keep", ["1"])}


def test_top_k_is_a_prefix_of_more(spark):
    rows = spark.createDataFrame([(i, [float(i % 5), float(i % 3), 1.0]) for i in range(40)] + [(99, [0.0, 0.0, 0.0]), (98, None)], "id int, v array<float>")
    few, many = ([r.id for r in search.top_vectors(rows, [1.0, 1.0, 0.0], k, "id", "v").collect()] for k in (5, 15))
    assert many[:5] == few and 99 not in many


def test_markdown_of_html():
    page = b"<html><head><title>t</title><style>p{}</style></head><body><h1>A</h1><script>x</script><p>b <a href='/c'>c</a></p><ul><li>d</li><li>e</li></ul><table><tr><th>f</th></tr><tr><td>g|h</td></tr></table><!-- i --></body></html>"
    got = parsers.html_markdown(page)
    assert got == "# A\n\nb [c](/c)\n\n- d\n- e\n\n| f |\n| --- |\n| g\\|h |"


def test_parsers_keep_going(spark):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>body</w:t></w:r></w:p></w:body></w:document>')
    files = [("a.txt", b" x "), ("b.JSON", b'{"k": 1}'), ("c.csv", b"a,b\n\n1,2\n"), ("d.docx", z.getvalue()), ("e.docx", b"broken"), ("f.xyz", b"?"), ("g.jsonl", b'{"a":1}\nbad\n'), ("h", None)]
    got = {r.name: r for r in parsers.parse(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert got["a.txt"].markdown == "x" and '"k": 1' in got["b.JSON"].markdown and got["c.csv"].markdown.count("|") == 9
    assert got["d.docx"].markdown == "## Head\n\nbody" and got["e.docx"].error and got["f.xyz"].error == "unsupported: xyz" and '{"a": 1}' in got["g.jsonl"].markdown and got["g.jsonl"].notes == '{"skipped": 1}' and got["h"].error


def test_hash_embedding_is_deterministic(spark):
    rows = spark.createDataFrame([("one two",), ("one two",), (None,)], "t string").select(hooks.embed(F.col("t")).alias("v")).collect()
    assert rows[0].v == rows[1].v and abs(sum(x * x for x in rows[0].v) - 1) < 1e-5 and not any(rows[2].v)


def test_stream_windows_and_once(spark, tmp_path):
    from tessera.streaming import status

    spark.createDataFrame([(1, "2024-01-01 00:01:00"), (1, "2024-01-01 00:01:00"), (2, "2024-01-01 00:07:00")], "k int, t string").select("k", F.to_timestamp("t").alias("t")).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("k int, t timestamp").parquet(str(tmp_path / "in"))
    q = status.once(source, "t", "1 hour", "k").writeStream.format("memory").queryName("once").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination()
    assert spark.table("once").count() == 2
    q = status.windowed(source, "t", "0 seconds", "5 minutes", None).writeStream.outputMode("complete").format("memory").queryName("win").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("win").collect()) == [1, 2]


@pytest.mark.parametrize("few", [0, 50_000])
def test_numbered_gives_places_over_all_parts(spark, monkeypatch, few):
    monkeypatch.setattr("tessera.plans.staging.LIST_ROWS", few)
    from tessera.plans.staging import numbered

    rows = spark.range(0, 30011, 1, 7).select(F.col("id"), (F.col("id") * 7919 % 30011).alias("x"))
    got = numbered(rows, F.desc("x"), name="place")
    assert got.columns == ["id", "x", "place"] and got.count() == 30011 and got.where("place <> 30010 - x").isEmpty()
    assert numbered(rows.limit(0), "x").count() == 0


def test_relation_chunks_of_more_items_than_registered(spark):
    from tessera.operators import retrieval

    relations = spark.createDataFrame([(f"r{i}", i, [i, i + 1, 900]) for i in range(100)], "item string, rank int, sources array<long>")
    entity = spark.createDataFrame([(i,) for i in range(0, 100, 2)], "chunk long")
    got = {r.chunk: (r["rank"], r.occurrences) for r in retrieval.relation_chunks(relations, entity).collect()}
    assert got == {900: (0, 100), 100: (99, 1)} | {i: (i - 1, 2) for i in range(1, 100, 2)}


def test_facts(spark):
    said = ['{"facts": ["a", " b ", "", 3]}', '```json\n{"facts": ["x"]}\n```', 'so {"facts": ["y"]} it is', '{"facts": "no"}', "nothing", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string")
    assert [r.f for r in rows.select("i", text.facts(F.col("t")).alias("f")).orderBy("i").collect()] == [["a", "b", "3"], ["x"], ["y"], [], [], []]


def test_a_retrieval_keeps_to_its_budgets(spark):
    v = lambda x: [x, (1 - x * x) ** 0.5]
    nodes = spark.createDataFrame([("a", v(1.0), ["c1", "c2"], 10), ("b", v(0.9), ["c2", "c3"], 10), ("z", v(0.1), ["c9"], 10)], "entity_id string, embedding array<double>, sources array<string>, tokens int")
    edges = spark.createDataFrame([("a", "b", 2.0, v(0.5), ["c4"], 10), ("b", "z", 1.0, v(0.95), ["c5"], 10)], "src string, tgt string, weight double, embedding array<double>, sources array<string>, tokens int")
    chunks = spark.createDataFrame([(f"c{i}", v(i / 10), f"text {i}", 20, f"f{i % 2}") for i in range(10)], "chunk string, embedding array<double>, content string, tokens int, file_path string")
    q = retrieval.Query(mode="mix", top_k=2, chunk_top_k=6, max_total_tokens=340, system_tokens=0)
    got = {k: d.orderBy("position").collect() for k, d in retrieval.retrieve(nodes, edges, chunks, [1.0, 0.0], q).items()}
    assert [r.entity_id for r in got["entities"]] == ["a", "b", "z"] and {(r.src, r.tgt) for r in got["relations"]} == {("a", "b"), ("b", "z")}
    assert sum(r.tokens for r in got["chunks"]) <= 340 - 200 - 50 and [r.chunk for r in got["chunks"]][:2] == ["c9", "c1"] or [r.chunk for r in got["chunks"]][0] == "c9"
    assert retrieval.retrieve(nodes, edges, chunks, [1.0, 0.0], retrieval.Query(mode="bypass")) == {}
    naive = retrieval.retrieve(nodes, edges, chunks, [1.0, 0.0], retrieval.Query(mode="naive", chunk_top_k=3, rerank=lambda c: F.when(c == "text 7", 1.0).otherwise(0.5)))
    assert set(naive) == {"chunks"} and [r.chunk for r in naive["chunks"].orderBy("position").collect()] == ["c7", "c9", "c8"]
    high = retrieval.retrieve(nodes, edges, chunks, [1.0, 0.0], retrieval.Query(mode="global", top_k=1, pick="vector"), high=[0.5, 0.75**0.5])
    assert [(r.src, r.tgt) for r in high["relations"].collect()] == [("a", "b")] and high["chunks"].count() > 0


def test_keywords_of_a_query():
    assert retrieval.keyword_sets("short", (), ()) == (("short",), ()) and retrieval.keyword_sets("q", ("l",), ("h",)) == (("l",), ("h",))
    with pytest.raises(ValueError, match="long query"):
        retrieval.keyword_sets("x" * 50, (), ())


@pytest.mark.parametrize("mark", ["<|##|>", "<|#||#|>", "<|#|||#|>", r"<|\#|>", "<|>", "<||>", "<X|#|>", "<|#|Y>", "<||#||>", "<#>", "<#|>", "<|#>", "<X#|>", "<|#X>", "<|#|", "<|#||", "<|#:", "<||#>", "<||", "|#|>", "<|#|>|", "||#||"])
def test_damaged_field_marks(mark):
    raw = f"entity<|#|>Oak{mark}tree<|#|>tall"
    assert extraction.records(raw) == [["entity", "Oak", "tree", "tall"]]


def test_records_that_a_field_mark_parts():
    raw = "entity<|#|>My entity<|#|>a<|#|>b<|#|>relation<|#|>x<|#|>y<|#|>k<|#|>d<|complete|>entity<|#|>c<|#|>t<|#|>u"
    got = extraction.records(raw)
    assert got == [["entity", "My entity", "a", "b"], ["relation", "x", "y", "k", "d"], ["entity", "c", "t", "u"]]


def test_sanitize_knows_all_entities(spark):
    assert one(spark, text.sanitize(F.col("t")), t="&eacute;&#x4e2d;&#20013; &hellip;&nbsp;&lt;") == "é中中 …\xa0<"
    assert spark.createDataFrame([(None,)], "t string").select(text.sanitize(F.col("t"))).first()[0] is None


def test_progress_never_falls(spark):
    chunks = spark.createDataFrame([(1, "Succeed"), (1, "Failed"), (2, "Succeed"), (2, "x")], "doc int, status string")
    before = spark.createDataFrame([(1, 70), (3, 9)], "doc int, progress int")
    assert sorted((r.doc, r.progress) for r in store.progress(chunks, "doc", "status", before=before).collect()) == [(1, 70), (2, 50)]


def test_caps_hold_before_and_after_collecting(spark):
    rows = spark.createDataFrame([("k", f"s{i % 7}", i) for i in range(30)], "k string, v string, o int")
    for most in (1, 3, 9):
        for keep in ("FIFO", "KEEP"):
            whole = merge.ordered_distinct(rows, ["k"], "v", "o").select(lists.cap(F.col("v"), most, keep)).first()[0]
            assert merge.ordered_distinct(rows, ["k"], "v", "o", most, keep).first().v == whole


def test_edge_sources_come_after_a_nodes_own(spark):
    nodes = spark.createDataFrame([("a", ["2", "1"]), ("b", None)], "entity_id string, source_ids array<string>")
    edges = spark.createDataFrame([("a", "b", ["1", "3"]), ("a", "c", ["4"])], "src string, tgt string, source_ids array<string>")
    got = {r.entity_id: r.source_ids for r in merge.with_edge_sources(nodes, edges).collect()}
    assert got == {"a": ["2", "1", "3", "4"], "b": ["1", "3"]}


def test_sheets_are_found_by_relation():
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        ns, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name="A" r:id="r2"/><sheet name="B" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><x Id="r1" Target="worksheets/sheet1.xml"/><x Id="r2" Target="/xl/worksheets/sheet2.xml"/></R>')
        for n in (1, 2):
            z.writestr(f"xl/worksheets/sheet{n}.xml", f'<worksheet xmlns="{ns}"><sheetData><row><c r="A1"><v>{n}</v></c></row></sheetData></worksheet>')
    said = parsers.xlsx_markdown(book.getvalue())
    assert said.index("## A") < said.index("2") < said.index("## B")


def test_rebuilding_takes_the_longest_of_each_source_and_falls_back_to_edges(spark):
    rows = spark.createDataFrame([("a", "t", "xx", "1", 1), ("a", "u", "yyy", "1", 2), ("a", "u", "z", "2", 3), ("a", "t", None, "3", 4)], "name string, type string, description string, source_id string, pos int")
    edges = spark.createDataFrame([("a", "b", "e2", "9", 8), ("b", "c", "e1", "2", 3)], "src string, tgt string, description string, source_id string, pos int")
    got = {r.name: (r.type, r.description, r.source_ids) for r in merge.rebuilt(rows, edges).collect()}
    assert got == {"a": ("u", "yyy<SEP>z", ["1", "2", "3"]), "b": ("UNKNOWN", "e1<SEP>e2", ["2", "9"]), "c": ("UNKNOWN", "e1", ["2"])}

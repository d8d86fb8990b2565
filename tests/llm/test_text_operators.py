"""Token counts, packing, quality, language, mixing and archives against libraries, brute force and exact round trips."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import language, mixing, packing, quality, tokens, warc

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
BITS = [" ", "  ", "\n", "a", "b", "the", "ing", "▁", "é", "漢", "\t", "<s>", "<0x0A>", "1", "22", "'s", "_", "😀", "!!", "　", "\0", "==", "\xa0", "²", "<|endoftext|>", "ß", "aa"]


def jumble(n, most=40, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(BITS) for _ in range(r.randrange(most))) for _ in range(n)] + ["a" * 3000, " " * 300, "ab" * 900, "---" * 400, ""]


def documents(spark, texts, extra=""):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as n_tokens", "'x' as piece", "2 as length", "'y' as _t")


def test_token_counts_are_the_library_s(spark):
    import sentencepiece

    texts = [*jumble(2000), None]
    got = {r.doc_id: r for r in tokens.count_tokens(documents(spark, texts), PIECES, limit=300).collect()}
    want = sentencepiece.SentencePieceProcessor(model_file=PIECES).encode([t or "" for t in texts])
    for i, (t, w) in enumerate(zip(texts, want)):
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), len(w), len(w) > 300), t


def test_token_counts_of_nothing(spark):
    assert tokens.count_tokens(documents(spark, []).limit(0), PIECES).count() == 0


def test_ids_are_the_library_s():
    texts = jumble(3000)
    e = packing.Encoder(BYTES)
    assert e.ids(texts) == e._encode(texts)


def test_packing_places_every_id_once(spark):
    texts = [*jumble(120), None, "w " * 5000]
    rows = packing.pack(documents(spark, texts), BYTES, size=64).collect()
    plain = packing._tokenizer(BYTES)
    want = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length and zlib.crc32(np.array(ids, dtype="<u4").tobytes()) == r.ids_crc32
    for i, ids in want.items():
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces))) and sum(p.length for p in pieces) == len(ids)
        assert all(p.length == 64 for p in pieces[1:]) and [p.start for p in pieces] == list(np.cumsum([0] + [p.length for p in pieces])[:-1])
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    least = -(-sum(map(len, want.values())) // 64)
    assert len(by_sequence) <= 1.03 * least + 1


@pytest.mark.parametrize("seed", range(6))
def test_plans_hold_all_and_fit(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(257, dtype=np.int64)
    for _ in range(rng.integers(0, 60)):
        counts[rng.integers(1, 257)] += rng.integers(1, 40)
    p = packing.plan(counts, 256)
    bins = collections.defaultdict(list)
    for length in np.flatnonzero(counts):
        for rank in range(counts[length]):
            j = np.searchsorted(p.first[length], rank, side="right") - 1
            bins[p.base[length][j] + rank - p.first[length][j]].append((p.offset[length][j], length))
    for held in bins.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 256
    assert len(bins) == p.bins <= 1.25 * (counts * np.arange(257)).sum() / 256 + 2


def test_quality_on_held_out_rows(spark):
    r = random.Random(3)
    prose = lambda: " ".join(r.choice(["the", "sea", "and", "river", "went", "slowly", "over", "green", "hill", "stone"]) for _ in range(120))
    junk = lambda: " ".join(r.choice(["BUY!!", "NOW!!", "$$$", "CLICK|", "FREE##", "WIN%%"]) for _ in range(120))
    rows = [(i, prose() if i % 4 else junk(), int(bool(i % 4))) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, "")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 5] + [(3, None), (99999, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {x.doc_id: x.score for x in quality.score(docs, model).collect()}
    assert len(got) == 402 and all(0 <= s <= 1 for s in got.values()) and got[1000] == got[1001]
    assert np.mean([(got[i] >= 0.3) == y for i, _, y in rows if i % 5 == 0]) > 0.95


def test_quality_dictionaries_hold_what_stands_late_in_texts():
    r = random.Random(3)
    marks = {1: b" careful harvest of northern orchards begins", 0: b" limited bargain voucher expires at midnight"}
    sample = {y: [bytes(r.randrange(97, 123) for _ in range(1500)) + mark * 3 for _ in range(80)] for y, mark in marks.items()}
    model = quality.fit_texts(sample, {0: 80, 1: 80}, dictionary_bytes=8192)
    assert marks[1] in model.good and marks[0] in model.bad


def test_a_row_without_an_id_is_held_out(spark):
    from tessera.llm.queries import held_out

    rows = spark.createDataFrame([(None,), (0,), (1,)], "doc_id long").select(held_out().alias("h"))
    assert [r.h for r in rows.collect()] == [True, zlib.crc32(b"0") % 5 == 0, zlib.crc32(b"1") % 5 == 0]


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.score(docs, quality.fit(docs, none)).collect()] == [0.5]
    assert quality.score(docs.limit(0), quality.fit(docs, none)).count() == 0


def mixed_words(lang, r, n=150):
    words = {"en": "the and of that with from river house", "fr": "le la et dans avec pour rivière maison", "de": "der die und nicht mit auf fluss haus"}[lang].split()
    return " ".join(r.choice(words) for _ in range(n))


def test_language_fuses_evidence(spark):
    r = random.Random(5)
    docs = spark.createDataFrame([(i, mixed_words(l, r), l) for i in range(60) for l in ("en", "fr", "de")], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model.languages == ("de", "en", "fr")
    pages = [(i, f"http://{h}.example.{t}/x", f'<html lang="{l}"><script>the and of</script><p>{mixed_words(l, r)}</p></html>') for i, (l, h, t) in enumerate([("fr", "a", "org"), ("en", "b", "com"), ("de", "c", "net")] * 20)]
    pages += [(100, "http://a.example.org/short", "<html><p>x</p></html>"), (101, None, None), (102, "not a url", ""), (103, "http://b.example.com/", '<html lang="zz-Latn-longer"></html>')]
    got = {x.page_id: x for x in language.identify(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash")), model).collect()}
    assert len(got) == len(pages) and all(got[i].lang == l for i, l in enumerate(["fr", "en", "de"] * 20))
    assert got[100].lang == "fr"  # its host speaks for it
    assert got[101].host == "" and got[103].declared == "zz" and all(0 < x.posterior <= 1 for x in got.values())
    assert language.identify(spark.createDataFrame([], "page_id long, url string, html string"), model).count() == 0


def mix_by_hand(docs, share, repetition, budget_share=1.0, seed=17):
    size = collections.Counter()
    for _, s, n in docs:
        size[s or ""] += max(n, 0)
    size = {s: t for s, t in size.items() if t > 0}
    budget = sum(size.values()) * budget_share

    def stats(a):
        w = {s: t**a for s, t in size.items()}
        z = sum(w.values())
        return -sum(x / z * np.log(x / z) for x in w.values()), max(budget * x / z / size[s] for s, x in w.items())

    a, low, high = 1.0, 0.0, 1.0
    if stats(1.0)[0] < share * np.log(len(size)):
        for _ in range(35):
            m = (low + high) / 2
            low, high = (m, high) if stats(m)[0] >= share * np.log(len(size)) else (low, m)
        a = low
    if a < 1 and stats(a)[1] > repetition:
        low, high = 0.0, 1.0
        for _ in range(35):
            m = (low + high) / 2
            low, high = (m, high) if stats(m)[1] > repetition else (low, m)
        a = high
    z, out = sum(t**a for t in size.values()), {}
    h = lambda *p: int(hashlib.md5(":".join(map(str, p)).encode()).hexdigest()[:15], 16)
    for s, t in size.items():
        own = int(np.floor(t**a / z * budget))
        passes, rest = own // t, own % t
        n_blocks = min(4096, -(-t // 65536))
        held = [(i, n) for i, x, n in docs if (x or "") == s and n > 0]
        blocks = collections.defaultdict(list)
        for i, n in held:
            blocks[h(seed, "block", i) % n_blocks].append((h(seed, "inner", passes, i), str(i), n))
        taken, stop = set(), False
        for b in sorted(blocks, key=lambda b: (h(seed, "pass", passes, s, b), b)):
            whole = sum(n for *_, n in blocks[b])
            for _, i, n in sorted(blocks[b]):
                if whole <= rest or n <= rest and not stop:
                    taken.add(i)
                    rest -= n
                    whole -= n
                else:
                    stop = True
            if stop or whole > 0:
                break
        out |= {i: passes + (str(i) in taken) for i, _ in held}
    return out


def test_mixing_against_a_loop(spark):
    r = random.Random(8)
    docs = [(i, r.choice(["a"] * 8 + ["b", "c", None]), r.randrange(0, 60)) for i in range(500)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n int").withColumn("weight", F.lit(1))
    for share, repetition in ((0.9, 2.0), (0.99, 1.5), (0.3, 4.0)):
        got = mixing.mix(df, F.col("n").cast("long"), entropy_share=share, repetition=repetition).collect()
        want = mix_by_hand(docs, share, repetition)
        assert len(got) == len(docs) and {x.doc_id: x._copies for x in got if x.n} == want
        assert all(x._copies == 0 for x in got if not x.n)
        assert sum(x._copies * x.n for x in got) <= sum(n for *_, n in docs)


def test_mixing_without_tokens(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, None, None)], "doc_id long, source string, n int")
    assert [x._copies for x in mixing.mix(df, F.col("n").cast("long"), entropy_share=0.9).collect()] == [0, 0]
    assert mixing.mix(df.limit(0), F.col("n").cast("long")).count() == 0


def test_archives_come_back(spark, monkeypatch):
    long = "x" * 999 + "é"
    pages = [(1, "http://b.example.com/1?q", long), (5, "http://a.example.com/", long), (3, "http://a.example.com/", long), (4, "http://c.example.org:8080/ü\n", "short"), (6, "http://c.example.org/", "short"), (7, None, None), (8, "http://[bad/", "z" * 5000), (None, "http://x/", "y")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("offset", F.lit(0))
    directory, root = warc.archive(spark, df, per_block=2)
    every = warc.lookup(warc.wanted(df), directory, root, texts=True).collect()
    got = {r.page_id: r for r in every}
    assert len(every) == len(got) == len(pages) and set(got) == {p for p, *_ in pages}
    for page, _, text in pages:
        data = (text or "").encode()
        r = got[page]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 5) if page in (1, 3) else ("response", None))
        assert r.payload == (None if page in (1, 3) else data)
    assert directory.agg(F.sum("blocks")).first()[0] >= 4 and directory.count() <= 4  # an index file a partition
    one = spark.createDataFrame([(warc.url_key("http://a.example.com/"), 3), (warc.url_key("http://a.example.com/"), 4), ("nowhere", None)], "key string, id long")
    assert [r.page_id for r in warc.lookup(one, directory, root).collect()] == [3]
    assert sorted(map(str, warc.lookup(warc.wanted(df), directory, root, texts=True).collect())) == sorted(map(str, every))
    empty, root = warc.archive(spark, df.limit(0))
    assert warc.lookup(warc.wanted(df), empty, root).count() == 0


def test_archives_of_repeated_ids_and_payloads_without_ids(spark):
    big, other = "x" * 1200, "y" * 1200
    pages = [(2, "http://h/", big)] * 3 + [(1, "http://h/", big), (None, "http://h/", big), (None, "http://i/", other), (None, "http://j/", other)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    directory, root = warc.archive(spark, df, per_block=1)
    got = collections.Counter((r.page_id, r.record_type, r.refers_to) for r in warc.lookup(warc.wanted(df), directory, root).collect())
    assert got == {(2, "response", None): 3, (1, "revisit", 2): 1, (None, "revisit", 2): 1, (None, "response", None): 2}


def test_url_keys_sort_by_reversed_host():
    assert warc.url_key("https://Blog.example.com/A?b") == "com,example,blog)/a?b"
    assert warc.url_key("http://a.b:8080") == "b,a:8080)/"


def test_every_label_with_a_usable_text_is_a_language(spark):
    rows = [(i, f"l{i:03}", f"word{i} text") for i in range(230)] + [(1000 + i, "long", "x" * 20) for i in range(9)] + [(2000, "long", "usable"), (3000, "none", "y" * 20), (3001, None, "z")]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, lang string, text string"), per_language=2, most_bytes=15)
    assert model.languages == (*(f"l{i:03}" for i in range(230)), "long")
    assert len(set(model.log_share[:, -1])) > 1


def test_language_against_a_loop(spark):
    r = random.Random(11)
    docs = spark.createDataFrame([(i, mixed_words(l, r, 40), l) for i in range(40) for l in ("en", "fr", "de")], "doc_id long, text string, lang string")
    model = language.fit(docs)
    pages = []
    for i in range(90):
        l = r.choice(["en", "fr", "de"])
        host = r.choice(["a.x.org", "b.x.org", "shop.com", "c.net", ""])
        mark = r.choice([l, l, "en", "xx", None])
        pages.append((i, f"http://{host}/p{i}" if host else None, (f'<html lang="{mark}">' if mark else "<html>") + (mixed_words(l, r, r.randrange(0, 6)) if i % 7 else "")))
    pages += [pages[5], pages[5], (200, "http://a.x.org/", None)]
    got = collections.Counter((x.page_id, x.declared, x.text_lang, x.lang, round(x.posterior, 9)) for x in language.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect())
    seen = []
    for i, url, page in pages:
        host = (url or "//").split("/")[2].lower()
        found = language._DECLARED.search(page or "")
        parts = host.split(".")
        seen.append((i, host, (parts[-1], ".".join(parts[-2:])), found[1] if found else "", model.probabilities(language.visible(page or ""))))
    total, n = sum(x[4] for x in seen), len(model.languages)
    want = collections.Counter()
    for i, host, (suffix, site), code, p in seen:
        prior = (total + 1) / (len(seen) + n)
        for own in ([x for x in seen if x[2][0] == suffix], [x for x in seen if x[2] == (suffix, site)], [x for x in seen if x[1] == host]):
            prior = (np.maximum(sum(x[4] for x in own) - p, 0) + language.STRENGTH * prior) / (len(own) - 1 + language.STRENGTH)
        declared = (np.maximum(sum(x[4] for x in seen if x[3] == code) - p, 0) + 1) / (total - p + len({x[3] for x in seen}))
        joint = np.maximum(p, 1e-12) * declared * prior
        want[i, code, model.languages[int(p.argmax())], model.languages[int(joint.argmax())], round(float(joint.max() / joint.sum()), 9)] += 1
    assert got == want


def test_quality_scores_against_plain_compression(spark):
    import zstandard

    r = random.Random(21)
    texts = [" ".join(r.choice(["calm", "sea", "tall", "reed", "WIN!!", "$$$", "free"][: 4 if i % 3 else 7]) for _ in range(r.randrange(5, 200))) for i in range(160)]
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (900, "x " * 200_000), (901, None)], "doc_id long, text string").withColumn("_t", F.lit(1))
    labels = spark.createDataFrame([(i, int(bool(i % 3))) for i in range(120)], "doc_id long, quality int")
    m = quality.fit(docs, labels)
    got = quality.score(docs, m).collect()
    assert len(got) == 163
    size = lambda d, t: sum(len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False).compress(t[at : at + 256])) for at in range(0, min(len(t), 8192), 256))
    for x in got:
        t = "x " * 200_000 if x.doc_id == 900 else (texts + [None])[min(x.doc_id, 160)]
        t = (t or "").encode()
        apart = (size(m.bad, t) - size(m.good, t)) / max(1, min(len(t), 8192))  # the longest text says one thing again and again
        u = (apart - (m.low + m.high) / 2) / ((m.high - m.low) / 2)
        want = 1 / (1 + np.exp(-(m.weights[0] + m.weights[1] * u / (1 + abs(u))))) if t else m.prior
        assert x.score == pytest.approx(want, abs=0.02)

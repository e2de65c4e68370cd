"""The training-data operators on small tables: brute force, planted cases, and hard inputs."""

import itertools
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from trekspark.llm import embedding_dedup, license_scan, line_dedup, mixing, packing, simhash_dedup, topk_search, toxicity, url_filter, warc
from trekspark.llm.common import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, node string"


def docs_of(spark, texts, sources=None):
    """Documents with extra columns whose names clash with the operators' own."""
    rows = [(i, t, "en", (sources or ["a"])[i % len(sources or ["a"])], len(t or ""), "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    base = [words(k, 60) for k in range(12)]
    near = [t.replace(t.split()[5], "changed", 1) for t in base[:6]]
    return [*base, *near, base[0], base[0], None, "", "   ", "one", words(99, 5000), base[1].upper()]


def groups_of(n, linked):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(n), 2):
        if linked(a, b):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return [root(x) for x in range(n)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100, 102: 100}


def test_simhash_matches_brute_force(spark, corpus):
    def fp(text):
        w = (text or "").encode().lower().split()
        shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)) if h else 0

    want = [fp(t) for t in corpus]
    got = simhash_dedup.near_duplicates(docs_of(spark, corpus)).orderBy("doc_id").collect()
    assert [r.fp % (1 << 64) for r in got] == want
    assert [r.component_id for r in got] == groups_of(len(corpus), lambda a, b: (want[a] ^ want[b]).bit_count() <= 2)
    assert simhash_dedup.keep_one(docs_of(spark, corpus)).count() == len({r.component_id for r in got})


def test_pipeline_stage_keeps_one_of_similar_documents(spark):
    import corpus_pipeline

    r = random.Random(6)
    texts = [None, "", "one two", "One  two", "one three"]
    for k, size in enumerate((12, 30, 60, 200, 200, 500)):
        base = words(50 + k, size).split()
        texts.append(" ".join(base))
        for changes in (1, max(1, size // 60), size // 40 + 1, size // 20 + 1):
            near = list(base)
            for at in r.sample(range(size), changes):
                near[at] = "changed"
            texts.append(" ".join(near))

    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    root = groups_of(len(texts), lambda a, b: sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]))
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    assert {x.doc_id for x in stage(spark, docs_of(spark, texts), "").collect()} == {*root}


def test_simhash_links_of_crowded_values(spark):
    r = random.Random(1)
    centre = r.getrandbits(64)
    values = {centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))) for _ in range(300)} | {r.getrandbits(64) for _ in range(100)}
    values = sorted(simhash_dedup.signed(v) for v in values)
    got = {(x.a, x.b) for x in simhash_dedup.links(spark.createDataFrame([(v,) for v in values], "fp long")).collect()}
    want = {(a, b) for a, b in itertools.combinations(values, 2) if ((a ^ b) % (1 << 64)).bit_count() <= 2}
    assert got == want


def plain_edit_similarity(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next_row(row, i, x, b)
    return 1 - row[-1] / max(len(a), len(b))


def edited_lines(sizes, repeats, vocabulary_words=400):
    """Lines and copies of them with 1 to a fifth of their words, and one more, replaced, dropped or added."""
    r = random.Random(8)
    vocabulary = words(7, vocabulary_words).split()
    lines = []
    for size in sizes:
        for _ in range(repeats):
            line = r.choices(vocabulary, k=size)
            lines.append(line)
            for edits in (1, size // 10 + 1, size // 5, size // 5 + 1):
                near = list(line)
                for at in sorted(r.sample(range(size), edits), reverse=True):
                    near[at : at + 1] = r.choice([[], ["other"], [near[at], "more"]])
                lines.append(near)
    r.shuffle(lines)
    return [x for x in lines if x]


def test_groups_of_lines_hold_the_pairs_of_edit_similarity(spark):
    lines = edited_lines((5, 6, 9, 10, 14, 20, 25, 40, 90), 6)
    got = {r.doc_id: r.group_doc_id for r in line_dedup.line_groups(docs_of(spark, [" ".join(x) for x in lines])).collect()}
    pairs = [(a, b) for a, b in itertools.combinations(range(len(lines)), 2) if plain_edit_similarity(lines[a], lines[b]) >= 0.8 - 1e-9]
    together = [got[a] == got[b] for a, b in pairs]
    assert len(pairs) > 150 and sum(together) >= 0.95 * len(pairs)
    root = groups_of(len(lines), lambda a, b: plain_edit_similarity(lines[a], lines[b]) >= 0.8 - 1e-9)
    assert all(root[a] == root[b] for a, b in got.items())


def test_lines_at_the_threshold_are_found_at_every_length(spark):
    r = random.Random(12)
    vocabulary = words(13, 20000).split()
    sizes, pairs = (5, 6, 8, 10, 12, 15, 20, 30, 60), 60
    texts = []
    for size in sizes:
        for _ in range(pairs):
            line = r.sample(vocabulary, size)
            near = list(line)
            for at in r.sample(range(size), size // 5):
                near[at] = r.choice(vocabulary)
            texts += [" ".join(line), " ".join(near)]
    got = {x.doc_id: x.group_doc_id for x in line_dedup.line_groups(docs_of(spark, texts)).collect()}
    for k, size in enumerate(sizes):
        found = sum(got[2 * i] == got[2 * i + 1] for i in range(k * pairs, (k + 1) * pairs))
        assert found >= 0.9 * pairs and (size > 12 or found == pairs), size


def test_lines_that_share_a_phrase_do_not_all_meet(spark):
    vocabulary = [f"x{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(3000)]  # all told apart by 24 bits
    texts = [f"posted by admin in {vocabulary[2 * k]} {vocabulary[2 * k + 1]}" for k in range(1500)]
    table = line_dedup.line_table(docs_of(spark, texts))
    grams = line_dedup.signatures(table).select(F.explode("blocks").alias("gram")).groupBy("gram").count()
    met = grams.agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0]
    assert met < 10 * len(texts)
    assert {x.kept for x in line_dedup.line_groups(docs_of(spark, texts)).collect()} == {True}


def test_lines_that_stay(spark):
    one = [words(k, 20) for k in range(8)]
    texts = ["\n".join([one[0], one[1], "ab cd"]), "\n".join([one[1].upper() + "!", one[2]]), one[2].replace(one[2].split()[3], "zz"), None, "", "\n".join(one), words(5, 3000), one[3] + " " + one[3]]
    got = {(r.doc_id, r.line_no): (r.group_doc_id, r.group_line_no, r.kept) for r in line_dedup.line_groups(docs_of(spark, texts)).collect()}
    assert got[1, 0] == got[5, 1] == (0, 1, False) and got[2, 0] == got[5, 2] == (1, 1, False) and got[6, 0] == (6, 0, True) and got[7, 0] == (7, 0, True)
    out = {r.doc_id: r for r in line_dedup.drop_repeated_lines(docs_of(spark, texts)).collect()}
    assert len(out) == len(texts) and out[0].text == texts[0] and out[3].text is None and one[1] not in out[5].text
    assert all(r.n_chars == len(r.text) for r in out.values() if r.text)


def test_columns_named_like_the_line_stage_s_own(spark):
    docs = spark.createDataFrame([(1, "one two\nthree", "a", True, 5), (2, "one two", "b", False, 6)], "doc_id long, text string, _dropped string, _copy boolean, line_no int")
    got = sorted(map(tuple, line_dedup.drop_repeated_lines(docs).collect()))
    assert got == [(1, "one two\nthree", "a", True, 5), (2, "", "b", False, 6)]


def test_repeated_rows_and_null_ids_of_lines(spark):
    rows = [(1, "one two\nthree"), (1, "one two\nthree"), (None, "one two"), (None, "one two"), ((1 << 53) + 1, "other line"), ((1 << 53) + 3, "other line")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.line_no, r.kept) for r in line_dedup.line_groups(docs).collect())
    assert got == [(1, 0, False), (1, 0, True), (1, 1, False), (1, 1, True), ((1 << 53) + 1, 0, True), ((1 << 53) + 3, 0, False)]
    out = sorted(((r.doc_id or 0, r.text) for r in line_dedup.drop_repeated_lines(docs).collect()))
    assert out == [(0, "one two"), (0, "one two"), (1, ""), (1, "one two\nthree"), ((1 << 53) + 1, "other line"), ((1 << 53) + 3, "")]


def test_simhashes_of_lines_match_a_plain_count():
    hashed = [[xxhash.xxh3_64_intdigest(w) for w in words(k, n).split()] for k, n in enumerate((1, 2, 3, 50, 254, 255, 256, 1000))]
    want = [sum((2 * sum(h >> b & 1 for h in x) > len(x)) << b for b in range(64)) for x in hashed]
    got = line_dedup.simhashes(np.array([h for x in hashed for h in x], "<u8"), np.array([len(x) for x in hashed], np.int32))
    assert [int(g) % (1 << 64) for g in got] == want


def test_short_lines_and_scripts_without_spaces(spark, tmp_path):
    texts = ["Home\n\nRead more", "home!\nread more\n---", "---\none two three four five", "one two three four", "今日は天気がとても良い", "今日は天気がとても悪い", "まったく別の文です"]
    docs_of(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.line_no): (r.group_doc_id, r.group_line_no) for r in line_dedup.op1_fuzzy_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {(0, 0): (0, 0), (0, 2): (0, 2), (1, 0): (0, 0), (1, 1): (0, 2), (1, 2): (1, 2), (2, 0): (1, 2), (2, 1): (2, 1), (3, 0): (2, 1), (4, 0): (4, 0), (5, 0): (4, 0), (6, 0): (6, 0)}


def test_edit_distance_matches_dynamic_programming():
    r = random.Random(3)
    for _ in range(200):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 12))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next_row(row, i, x, b)
        assert line_dedup.edit_distance(a, b) == row[-1]


def _next_row(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def test_toxicity_finds_planted_words(spark):
    r = random.Random(5)
    bad = ["vilething", "nastyword", "grimslur"]
    texts, toxic = [], []
    for k in range(240):
        s = [words(1000 * k + j, 8) for j in range(6)]
        toxic.append(k % 3 == 0)
        if toxic[-1]:
            s[r.randrange(6)] += f" {r.choice(bad)} " + r.choice(bad)
        texts.append(". ".join(s))
    docs = docs_of(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(k, int(y)) for k, y in enumerate(toxic)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {x.doc_id: x for x in toxicity.score(docs, model).collect()}
    held = [k for k in range(240) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert sum((got[k].predicted == 1) == toxic[k] for k in held) >= 0.95 * len(held)
    assert got[240].score == got[241].score == 0.0
    spans = toxicity.offending_sentences(docs, model).collect()
    assert spans and all(any(b in s.text for b in bad) for s in spans)
    assert toxicity.score(docs, toxicity.fit(docs, labels.where("toxic = 0"))).where("predicted = 1").count() == 0


def test_mix_reaches_targets(spark):
    texts = [words(k, 5 + k % 90) for k in range(300)] + [None, "", words(1, 4000)]
    docs = docs_of(spark, texts, ["a", "b", "b", "b", "c", None])
    got = mixing.mix(docs, block_tokens=8, shard_tokens=1500).collect()
    assert len(got) == len(texts) and all(0 <= r.taken <= 2 * r.size for r in got)
    sources = {r.source for r in got}
    total = sum(r.size for r in got)
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(1.5 * total, abs=0.01)
    for s in sources:
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 0.03 * mine[0].target + 40
    again = mixing.mix(docs.repartition(7), block_tokens=8, shard_tokens=1500).collect()
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in again}
    out = mixing.mixed_documents(docs, block_tokens=8, shard_tokens=1500)
    assert out.columns == docs.columns
    assert sum(len(r.text.split()) for r in out.collect()) == sum(r.taken for r in got)


def test_sainte_lague_matches_seat_by_seat(spark):
    votes = [53, 24, 23, 1, 1, 1]
    held = [0] * 6
    for _ in range(37):
        k = max(range(6), key=lambda i: (votes[i] / (2 * held[i] + 1), -i))
        held[k] += 1
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(votes)], "g int, i int, v long")
    got = mixing.sainte_lague(df, "v", F.lit(37), ["g"], ["i"]).orderBy("i").collect()
    assert [r.quota for r in got] == held


def test_packing_holds_each_id_once(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    enc = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Hello, world. it's 3.5 €", None, "", "a\x1cb \x1d c", "É é H̱ <|endoftext|> x", *[words(k, 30 * k) for k in range(40)], "don't. U.S.A. ok..,"]
    ids = [np.array([*enc.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for t in texts]
    rows = packing.pack(docs_of(spark, texts).coalesce(1)).collect()
    for i, x in enumerate(ids):
        at = 0
        for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(x[at : at + r.length].tobytes())
            at += r.length
        assert at == len(x)
    for _, seq in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in seq:
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0


def test_best_fill_matches_all_subsets():
    from collections import Counter

    r = random.Random(2)
    for _ in range(50):
        sizes = [r.randint(1, 40) for _ in range(9)]
        room = r.randint(1, 120)
        best = max(s for k in range(10) for c in itertools.combinations(sizes, k) if (s := sum(c)) <= room)
        fill = packing.best_fill(Counter(sizes), room)
        assert sum(n * k for n, k in fill.items()) == best and not fill - Counter(sizes)


VECTORS = "vec_id long, embedding array<double>, label int, v int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1) for i, v in enumerate(rows)], VECTORS)


def test_search_matches_brute_force(spark):
    r = np.random.default_rng(1)
    rows = [list(v) for v in r.integers(-50, 50, (230, 6))] + [None, [1, None, 2, 3, 4, 5], [float("nan")] * 6, [1, 2]]
    rows[7] = rows[8]
    df = vectors_of(spark, rows)
    got = [(x.query_id, x.rank, x.vec_id, x.score) for x in topk_search.top_k(df.where("vec_id % 100 = 0"), df).orderBy("query_id", "rank").collect()]
    want = []
    for q in (0, 100, 200):
        s = sorted((-int(np.dot(rows[q], rows[c])), c) for c in range(230) if c != q)[:10]
        want += [(q, k, c, -x) for k, (x, c) in enumerate(s, 1)]
    assert got == want
    assert topk_search.top_k(df.limit(0), df.limit(0)).count() == 0


def test_near_vectors_match_brute_force(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(6, 8))
    rows = [list(centres[k % 6] + 0.12 * r.normal(size=8)) for k in range(200)] + [None, [0] * 8, [float("inf")] * 8, [1, 2], [2, 4]]
    rows[11] = rows[10]
    rows[12] = [3 * x for x in rows[10]]
    got = embedding_dedup.near_vectors(vectors_of(spark, rows), sequence_rows=32).orderBy("vec_id").collect()

    def linked(a, b):
        if max(a, b) >= 200 and {a, b} != {203, 204}:
            return False
        x, y = np.array(rows[a], float), np.array(rows[b], float)
        return x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.95

    assert [x.component_id for x in got] == groups_of(len(rows), linked)
    assert [x.n_links for x in got] == [sum(linked(*sorted((a, b))) for b in range(len(rows)) if a != b) for a in range(len(rows))]
    assert embedding_dedup.near_vectors(vectors_of(spark, [None])).first().component_id == 0


def test_licenses():
    got = license_scan.scan_text("Under the MIT License. MIT license; Apache License, Version 2.0. SPDX-License-Identifier: GPL-3.0-only")
    assert got[1:4] == (3, 2, 6) and got[4] == "apache,mit" and got[5] == "apache,apache-2.0,gpl-3.0,mit" and got[6] == 1.0
    assert license_scan.scan_text(None) == license_scan.scan_text("") == (0, 0, None, None, "", "", 0.0)
    assert license_scan.scan_text("no permit licensed words here")[5] == ""
    spans = license_scan.detections(license_scan.normal_words("licensed under the apache license version 2.0"))
    assert [x[2] for x in spans] == ["apache-2.0"]
    assert len(license_scan.rules()) >= 300


def test_url_rules_and_link_graph(spark):
    pages = [
        (1, "HTTP://A.Example.NET/en/x?q#f", None),
        (2, "http://b.net/p", None),
        (3, "https://farm.info/", '<a href="http://b.net/1"> <a href=//c.net/2>'),
        (4, "https://news.org/fr/1", '<A HREF="https://friend.info/x">'),
        (5, "https://friend.info/y", ""),
        (6, None, None),
        (7, "no scheme", "x"),
        (8, "http://x.com", None),
    ]
    got = {r.page_id: r for r in url_filter.judged(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert (got[2].rule, got[2].verdict) == ("net/", "block")
    assert (got[3].rule, got[3].verdict) == (None, "block") and got[3].distrust == pytest.approx(0.85)
    assert got[5].trust == pytest.approx(0.85) and got[5].verdict == "allow"
    assert (got[6].host, got[6].path, got[7].host, got[8].path) == ("", "", "", "")


def test_warc_links_of_scripts_and_noscript():
    page = "<script src='/a.js'>x = '<a href=/no>'</script><!-- <a href=/no> --><style>a::after { content: '<img src=/no>' }</style><noscript><img src=/b.png></noscript><a href=/c>c</a>"
    assert warc.page_metadata(page)["links"] == [{"path": "script", "url": "/a.js"}, {"path": "img", "url": "/b.png"}, {"path": "a", "url": "/c"}]


def test_warc_round_trip(spark):
    page = "<html><head><title>T &amp; t</title><style>p{}</style></head><body><p>One <b>two</b><p>three<script>x</script><a href='/l?a=1&amp;b=2'>four</a></body></html>"
    pages = spark.createDataFrame([(1, "http://h/", page, 0), (2, None, None, 0), (3, "http://e/", "", 0)], "page_id long, url string, html string, block int")
    responses = warc.response_records(pages)
    out = {(r.page_id, r.warc_type): r for r in warc.derivatives(responses, "page_id").collect()}
    source = {r.page_id: r for r in responses.collect()}
    assert len(out) == 6
    text, meta = out[1, "conversion"], out[1, "metadata"]
    assert bytes(text.block).decode() == "T & t\nOne two\nthree\nfour" or bytes(text.block).decode().startswith("T & t\nOne two")
    assert text.refers_to == meta.refers_to == source[1].record_id and text.concurrent_to == meta.record_id
    assert text.payload_digest == source[1].payload_digest == warc.digest(page.encode())
    assert '"/l?a=1&b=2"' in bytes(meta.block).decode()
    for r in [*out.values(), *source.values()]:
        (back,) = warc.parsed(warc.serialized(r.asDict()))
        assert bytes(back["block"]) == bytes(r.block) and back["refers_to"] == r.refers_to and back["content_length"] == r.content_length


def test_empty_tables(spark):
    none = docs_of(spark, [None]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert simhash_dedup.near_duplicates(none).count() == 0
    assert line_dedup.line_groups(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert packing.pack(none).count() == 0
    assert license_scan.scan(none).count() == 0
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0


def test_no_link_of_long_lines_is_lost(spark):
    """All pairs at the threshold, alone in their groups, so that no other link joins them."""
    r = random.Random(14)
    vocabulary = words(15, 20000).split()
    texts = []
    for size in (15, 20, 30, 60, 400):
        for _ in range(60):
            line = r.sample(vocabulary, size)
            near = list(line)
            for at in r.sample(range(size), size // 5):
                near[at] = r.choice(vocabulary)
            texts += [" ".join(line), " ".join(near)]
    got = {x.doc_id: x.group_doc_id for x in line_dedup.line_groups(docs_of(spark, texts)).collect()}
    assert [k for k in range(0, len(texts), 2) if got[k] != got[k + 1]] == []


def test_chunk_encoder_batches_words_of_any_letters_and_punctuation_like_whole_texts():
    enc = packing.ChunkEncoder()
    r = random.Random(2)
    pool = "aBZÉéßİıΣςǅŉẞ一あ́²कक़ÅﬁА.,'!#*_-<|>3…"
    texts = [" ".join("".join(r.choices(pool, k=r.randint(1, 7))) for _ in range(40)) for _ in range(300)]
    texts += ["<|endoftext|> a<|startoftext|>!! don't IT'S ab's. x'", "WORD! Word!! Été*** été straße##"]
    alone = []

    class Counted:
        def encode_batch_fast(self, some, **more):
            alone.extend(some if " " not in some[0] else [])
            return enc_tokenizer.encode_batch_fast(some, **more)

    enc_tokenizer, enc.tokenizer = enc.tokenizer, Counted()
    for text in texts * 2:
        assert enc.encode([text])[0].tolist() == enc_tokenizer.encode(text, add_special_tokens=False).ids
    alone.clear()
    enc.encode(["Grünes### GRÜNES!! haus--- weg ästlich queoè"])
    assert set(alone) <= {"###", "!!", "---"}  # words are encoded together, not one by one

"""Ids of any size beside nulls, and operators against references written apart from them."""

import gzip
import random

import pytest
from trekspark.llm import license_scan, line_dedup, packing, simhash_dedup, topk_search, toxicity, url_filter, warc

BIG = [(1 << 53) + 1, (1 << 53) + 3, None, (1 << 62) + 7]


@pytest.fixture(scope="module")
def big(spark):
    return spark.createDataFrame([(i, f"mit license of document number {k} here. more words follow in it", i) for k, i in enumerate(BIG)], "doc_id long, text string, label long")


def test_ids_keep_their_value_beside_nulls(spark, big):
    key = lambda rows: sorted({(r.doc_id is None, r.doc_id or 0) for r in rows})
    want = sorted((i is None, i or 0) for i in BIG)
    assert key(packing.pack(big).collect()) == want
    assert key(simhash_dedup.near_duplicates(big).collect()) == want
    assert key(license_scan.scan(big).collect()) == want
    assert key(license_scan.license_spans(big).collect()) == want
    scored = toxicity.score(big, toxicity.fit(big, spark.createDataFrame([], "doc_id long, toxic int"))).collect()
    assert key(scored) == want and sorted((r.label is None, r.label or 0) for r in scored) == want
    assert key(line_dedup.drop_repeated_lines(big).collect()) == want
    pages = big.selectExpr("doc_id AS page_id", "text AS url", "text AS html")
    assert sorted((r.page_id is None, r.page_id or 0) for r in warc.response_records(pages).collect()) == want
    assert sorted((r.page_id is None, r.page_id or 0) for r in warc.derivatives(warc.response_records(pages), "page_id").collect()) == sorted(want * 2)


@pytest.mark.parametrize(
    "url, host, path, rule",
    [
        ("http://a.com?u=http://b.com/c", "a.com", "", None),
        ("http://a.net#x://y/z", "a.net", "", None),
        ("http://b.org?next=https://example.net/fr/", "b.org", "", None),
        ("http://a.NET/x://y?z", "a.net", "/x://y", "net/"),
        ("://h.org/fr/x", "h.org", "/fr/x", "org/fr/"),
        ("x\ny://h.com/\nz", "h.com", "/\nz", None),
    ],
)
def test_url_parts(spark, url, host, path, rule):
    r = url_filter.judged(spark.createDataFrame([(1, url, None, 7)], "page_id long, url string, html string, host int")).first()
    assert (r.host, r.path, r.rule) == (host, path, rule)


def test_rank_matches_a_dense_iteration(spark):
    r = random.Random(4)
    hosts = [f"h{k}" for k in range(12)]
    edges = [(a, b, float(r.randint(1, 5))) for a in hosts for b in hosts if a != b and r.random() < 0.3]
    seeds = {"h0": 1.0, "h5": 0.5}
    got = {x.host: x.score for x in url_filter.personalised_rank(spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame([*seeds.items()], "host string, seed double")).collect()}
    score = dict.fromkeys(hosts, 0.0)
    for _ in range(400):
        new = {h: seeds.get(h, 0.0) for h in hosts}
        for a, b, w in edges:
            new[b] += 0.85 * score[a] * w / sum(x for y, _, x in edges if y == a)
        score = new
    assert all(got.get(h, 0.0) == pytest.approx(score[h], abs=1e-5) for h in hosts)


def test_no_pages(spark):
    assert url_filter.judged(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert warc.derivatives(warc.response_records(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_noisy_or_by_hand():
    import numpy as np

    model = toxicity.NoisyOrModel(np.zeros(toxicity.DIMENSIONS, np.float32), -2.0)
    p = 1 / (1 + np.exp(2.0))
    assert model.score("one two three four five. six seven eight nine ten! short", {}) == pytest.approx(1 - (1 - p) ** 3)
    model.weights[toxicity.word_features("bad")[0]] = 3.0
    q = 1 / (1 + np.exp(-1.0))
    assert model.score("one two bad four five. six seven eight nine ten", {}) == pytest.approx(1 - (1 - p) * (1 - q))


def test_base_phrases_match_a_plain_scan(spark):
    r = random.Random(1)
    vocabulary = "gnu general public license apache cc by mit license of the License, Apache-License CC-BY GNU ünï".split()
    texts = [" ".join(r.choices(vocabulary, k=r.randint(0, 60))) for _ in range(60)] + [None, "", "cc by " * 3000]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, score int")
    got = {x.doc_id: x for x in license_scan.scan(docs.unionByName(docs.where("doc_id = 0"))).collect()}
    phrases = {("gnu", "general", "public", "license"): "gpl", ("apache", "license"): "apache", ("cc", "by"): "cc-by", ("mit", "license"): "mit"}
    for k, t in enumerate(texts):
        out, word = [], ""
        for c in (t or "") + " ":
            if c.isascii() and not c.isalnum():
                out, word = out + ([word] if word else []), ""
            else:
                word += c.lower() if c.isascii() else c
        at = [(i, label) for p, label in phrases.items() for i in range(len(out)) if tuple(out[i : i + len(p)]) == p]
        places = [i for i, _ in at]
        x = got[k]
        assert (x.n_words, x.n_base, x.first_word, x.last_word) == (len(out), len(at), min(places, default=None), max(places, default=None))
        assert x.base_labels == ",".join(sorted({label for _, label in at})) and {*filter(None, x.base_labels.split(","))} <= {*x.labels.split(",")}


def test_broken_warc_records_and_other_headers(spark, tmp_path):
    record = {"warc_type": "response", "record_id": "<urn:uuid:1>", "concurrent_to": "<urn:uuid:0>", "content_length": 5, "block": b"a\r\n\r\nb"[:5], "other_headers": '{"WARC-IP-Address": "1.2.3.4"}'}
    good = warc.serialized(record)
    broken = b"WARC/1.0\r\nContent-Length: many\r\n\r\nxx\r\n\r\n" + good + b"WARC/1.0\r\nWARC-Type: resp"
    (back,) = warc.parsed(broken)
    assert back["block"] == record["block"] and back["other_headers"] == record["other_headers"]
    assert [len(r["block"]) for r in warc.parsed(good[:-6])] == [3]
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(good) + gzip.compress(good))
    (tmp_path / "b.warc").write_bytes(broken)
    rows = warc.read_warc(spark, str(tmp_path))
    assert rows.count() == 3
    meta = warc.derivatives(rows).where("warc_type = 'metadata'").first()
    assert b'"WARC-IP-Address": "1.2.3.4"' in meta.block and b'"WARC-Concurrent-To": "<urn:uuid:0>"' in meta.block


def test_other_vocabularies_encode_whole_texts(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    words = {"[U]": 0, "Ab": 1, "ab": 2, " ": 3, "cd": 4}
    t = Tokenizer(models.WordLevel(words, unk_token="[U]"))
    t.pre_tokenizer = pre_tokenizers.Split(" ", "isolated")
    t.save(str(tmp_path / "v.json"))
    enc = packing.ChunkEncoder(str(tmp_path / "v.json"))
    assert not enc.by_chunk and enc.encode(["Ab ab cd"])[0].tolist() == [1, 3, 2, 3, 4]
    assert packing.ChunkEncoder().by_chunk


def test_encoder_forgets_and_learns_again(monkeypatch):
    monkeypatch.setattr(packing, "MEMO_CHUNKS", 8)
    enc = packing.ChunkEncoder()
    texts = ["one two three, four. don't", "five six one two", "seven. eight, nine ten ABC", "one two three, four. don't", ""]
    assert [enc.encode([t])[0].tolist() for t in texts] == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_values_beyond_long(spark, tmp_path):
    spark.createDataFrame([(0, [1e18, 0.0]), (1, [1e18, 1.0]), (2, [-1e18, 1.0])], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = topk_search.op2_pivot_table_top_k(spark, str(tmp_path)).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, (1 << 63) - 1), (2, -(1 << 63))]

"""The corpus pipeline stage by stage, each against a plain reference on its own input."""

import itertools
import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BAD = ["vilething", "nastyword", "grimslur"]


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefgh", k=r.randint(3, 8))) for _ in range(n))


def plain_groups(n, linked):
    group = list(range(n))
    for a, b in itertools.combinations(range(n), 2):
        if linked(a, b) and group[a] != group[b]:
            low, high = sorted((group[a], group[b]))
            group = [low if g == high else g for g in group]
    return group


def corpus():
    r = random.Random(3)
    shared = [words(9000 + k, 14) for k in range(3)]
    texts, toxic = [], []
    for k in range(150):
        lines = [". ".join(words(100 * k + 10 * j + i, 9) for i in range(2)) for j in range(3)]
        toxic.append(k % 3 == 0)
        if toxic[-1]:
            lines[r.randrange(3)] += f". {words(70000 + k, 5)} {r.choice(BAD)} {r.choice(BAD)}"
        elif k % 5 == 1:
            lines.insert(1, shared[k % 3].upper() + "!" if k % 2 else shared[k % 3])
        texts.append("\n".join(lines))
    first = words(50000, 120)
    texts += [first, first, first.replace(first.split()[40], "changed", 1) + " end", None, "", "one line"]
    return texts, toxic + [False] * 6


def test_each_stage_against_its_reference(spark, tmp_path):
    import corpus_pipeline

    texts, toxic = corpus()
    rows = [(k, t, "en", "abc"[k % 3], len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(y)) for k, y in enumerate(toxic)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, str(tmp_path))
        assert name == "packing" or done.columns == docs.columns
        done.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        out[name] = docs.collect()

    kept = {r.doc_id for r in out["toxicity"]}
    assert sum(toxic[k] and k in kept for k in range(len(texts))) <= 2
    assert sum(not toxic[k] and k not in kept for k in range(len(texts))) <= 2

    seen, want = set(), {}
    for r in sorted(out["toxicity"], key=lambda r: r.doc_id):  # no two lines here are similar but those that are equal or near copies of one text
        lines = []
        for line in (r.text or "").split("\n"):
            key = "".join(c for c in line.lower() if c.isalpha() or c == " ").replace("changed", "").removesuffix(" end").strip()
            key = key[:200] if r.doc_id in (150, 151, 152) else key
            if not key or key not in seen:
                lines.append(line)
                seen.add(key)
        want[r.doc_id] = None if r.text is None else "\n".join(lines)
    assert {r.doc_id: r.text for r in out["line_dedup"]} == want
    assert all(r.n_chars == len(r.text) for r in out["line_dedup"] if r.text is not None)

    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    before = sorted(out["line_dedup"], key=lambda r: r.doc_id)
    sets = [shingles(r.text) for r in before]
    group = plain_groups(len(before), lambda a, b: sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]))
    assert sorted(r.doc_id for r in out["simhash_near_dedup"]) == sorted({before[g].doc_id for g in group})

    size = {s: 0 for s in "abc"}
    for r in out["simhash_near_dedup"]:
        size[r.source] += len((r.text or "").split())
    target, free, left = {}, dict(zip("abc", (5, 2, 1))), 1.5 * sum(size.values())
    while free:
        share = {s: left * w / sum(free.values()) for s, w in free.items()}
        over = [s for s in free if share[s] > 2 * size[s]]
        for s in over or list(free):
            target[s] = 2 * size[s] if over else share[s]
            del free[s]
        left -= sum(target[s] for s in over)
    for s in "abc":
        taken = sum(len((r.text or "").split()) for r in out["mixing"] if r.source == s)
        assert taken == pytest.approx(target[s], rel=0.03, abs=64)

    assert {r.doc_id for r in out["packing"]} == {r.doc_id for r in out["mixing"]}
    for _, seq in itertools.groupby(sorted(out["packing"], key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in seq:
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_near_dedup_links_by_fingerprints_and_by_shingles(spark):
    from trekspark.llm import simhash_dedup

    phrase = "one phrase that stands here very often "
    first, second = (phrase * 200 + words(k, 12) for k in (1, 2))  # near by fingerprints, that count repeats, far by sets of shingles
    third = second.replace(second.split()[-1], "other")  # one shingle of second's is another
    fourth = words(3, 300)
    changed = fourth.split()
    changed[100] = changed[200] = "changed"  # near by shingles, not by fingerprints
    alone = words(4, 300)
    texts = [first, second, third, fourth, " ".join(changed), alone, "", None]
    a, b = (simhash_dedup.fingerprint(t, 5) for t in texts[3:5])
    assert (a ^ b).bit_count() > 2 and (simhash_dedup.fingerprint(first, 5) ^ simhash_dedup.fingerprint(second, 5)).bit_count() <= 2
    docs = spark.createDataFrame([(k, t, "en", "a", len(t or "")) for k, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in simhash_dedup.keep_one_similar(docs).collect()) == [0, 3, 5, 6]
    assert simhash_dedup.keep_one_similar(docs.limit(0)).count() == 0

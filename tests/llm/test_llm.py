"""The training-data operators against brute force, round trips and held-out accuracy; odd inputs for each."""

import hashlib
import io
import random
import struct
import zlib

import pytest

from quayside.llm import adaptive_rules, bitplane, jaccard, langid, mixing, order_minhash, packing, quality, queries, sharding, tokens, url_trie

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, start int, size int"
LONG = "lorem ipsum dolor " * 30_000


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "One two, three!", "en", "a"), (3, "One two, three!", "en", "a"), (None, "null id here", "en", None), (4, LONG, "de", "b"), (5, " \n\t ", "de", "b"), (6, "a\x00b  c \n d 's", None, "b")]
    return spark.createDataFrame([(*r, 0, 0) for r in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(SF + "/documents.parquet")


def encoded(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path(name))
    t.encode_special_tokens = True  # as the tokenizer files' description says
    return [struct.pack(f"<{len(e.ids) + 1}I", *e.ids, 1) for e in t.encode_batch_fast([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes(kind):
    ids = [random.Random(1).randrange(1 << 17) for _ in range(5000)]
    sink = io.BytesIO()
    w = bitplane.Writer(sink, kind, block=1024)
    w.add(7, struct.pack("<3000I", *ids[:3000]))
    w.add(None, struct.pack("<2000I", *ids[3000:]))
    n = w.close()
    foot = bitplane.read_footer(sink, n)
    raw = b"".join(bitplane.read_chunk(sink, foot, k) for k in range(len(foot["chunks"])))
    assert list(struct.unpack("<5000I", raw)) == ids
    assert [r[:3] for r in bitplane.read_documents(sink, foot)] == [(7, 0, 3000), (None, 3000, 2000)]


def test_bitplane_query(spark, odd):
    rows = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    start, want = 0, []
    for r, raw in zip(rows, encoded(queries.WORD_BPE, [r.text for r in rows])):
        want.append((r.doc_id, start, len(raw) // 4, zlib.crc32(raw)))
        start += len(raw) // 4
    got = bitplane.round_trip(odd, tokens.tokenizer_path(queries.WORD_BPE)).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert bitplane.round_trip(odd.limit(0), tokens.tokenizer_path(queries.WORD_BPE)).count() == 0


def test_packing(spark, docs, odd):
    for df in (docs, odd):
        rows = df.collect()
        by_id = {}
        for r, raw in zip(rows, encoded(queries.BYTE_BPE, [r.text for r in rows])):
            by_id.setdefault(r.doc_id, []).append(raw)
        pieces = packing.pack(df, tokens.tokenizer_path(queries.BYTE_BPE)).collect()
        for p in pieces:
            assert any(zlib.crc32(raw[4 * p.start : 4 * (p.start + p.length)]) == p.ids_crc32 for raw in by_id[p.doc_id])
        assert sum(p.length for p in pieces) == sum(len(x) // 4 for v in by_id.values() for x in v)
        held = {}
        for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
            assert held.get(p.sequence_id, 0) == p.offset
            held[p.sequence_id] = p.offset + p.length
        assert max(held.values()) <= 2048
        assert sum(2048 - v for v in held.values()) <= 0.003 * 2048 * len(held) + 2048
    assert packing.pack(docs.limit(0), tokens.tokenizer_path(queries.BYTE_BPE)).count() == 0


def test_language(spark, docs, odd):
    got = langid.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert {r.lang_pred for r in langid.predict(odd).collect() if r.doc_id in (1, 2, 5)} == {"und"}
    assert langid.predict(odd.limit(0)).count() == 0


def test_url_trie_and_join_agree(spark):
    urls = [None, "", "no scheme", "http://A.Example.ORG/en/17?x", "https://example.org", "https://example.org/", "http://com/de/x#y", "http://x.com/fr/", "http://x.com:80/fr/", "a://org.com/de/#"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    a = sorted(map(tuple, url_trie.judge(pages, queries.RULES).collect()))
    b = sorted(map(tuple, url_trie.judge(pages, queries.RULES, max_rules=0).collect()))
    assert a == b
    verdicts = {r[0]: r[3:] for r in a}
    assert verdicts[3] == ("example.org/en/1", "block") and verdicts[4] == (None, "allow") and verdicts[5] == ("org/", "allow") and verdicts[6] == ("com/de/", "block") and verdicts[7] == ("com/fr/", "allow")


def test_quality(spark, docs, odd):
    labels = spark.read.parquet(SF + "/labels.parquet")
    held = [r for r in quality.predict(docs, labels).join(labels, "doc_id").collect() if r.held_out]
    assert sum(r.quality == r.predicted for r in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 for r in quality.predict(odd, labels.limit(0)).collect())


def test_mixing(spark, docs, odd):
    rows = mixing.mix(docs).collect()
    by = {}
    for r in rows:
        assert r.taken <= 3 * r.size
        by.setdefault(r.source, []).append(r)
    for group in by.values():
        assert abs(sum(r.taken for r in group) - group[0].target) <= max(r.size for r in group)
        assert group[0].target <= 3 * group[0].source_size
    assert mixing.mixed(docs).count() == sum(r.copies for r in rows)
    assert mixing.mix(odd).count() == 8 and mixing.mix(odd.limit(0)).count() == 0


def test_shards(spark, docs, odd):
    held = {}
    for r in sharding.assign(docs, 40_000).collect():
        held.setdefault(r.shard, []).append(r)
    for group in held.values():
        assert sum(r.bytes for r in group) == group[0].shard_bytes
        assert group[0].shard_bytes <= 40_000 or len(group) == 1
    copies = docs.sparkSession.createDataFrame([(1, "x" * 84, "", "", 0, 0)] * 10, DOCS)
    shards = [r.shard for r in sharding.assign(copies, 300).collect()]
    assert len(shards) == 10 and max(shards.count(s) for s in set(shards)) == 3
    assert sharding.assign(odd).count() == 8 and sharding.assign(odd.limit(0)).count() == 0


def brute_components(rows, width=3, percent=90):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])

    sets = [(i, shingles(t)) for i, t in rows]
    comp = {i: i for i, _ in sets}
    changed = True
    links = [(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[:k] if a and b and 100 * len(a & b) >= percent * len(a | b)]
    while changed:
        changed = False
        for i, j in links:
            low = min(comp[i], comp[j])
            if comp[i] != low or comp[j] != low:
                comp[i] = comp[j] = low
                changed = True
    return {(i, len(s), comp[i]) for i, s in sets}


def test_jaccard(spark, odd):
    r = random.Random(3)
    base = [f"w{k}" for k in range(200)]
    rows = [(0, None), (1, ""), (2, "a b"), (3, "A b"), (4, "a b c")]
    for k in range(5, 90):
        words = list(base[: 40 + k % 3 * 60])
        for _ in range(r.randrange(5)):
            words[r.randrange(len(words))] = f"x{r.randrange(30)}"
        rows.append((k, " ".join(words)))
    got = jaccard.link(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
    assert {tuple(x) for x in got} == brute_components(rows)
    assert jaccard.link(odd).count() == 8 and jaccard.link(odd.limit(0)).count() == 0


def test_segments_find_every_link():
    import numpy as np

    r = np.random.default_rng(1)
    for k1, k2, spare in ((4, 0, 0), (2, 1, 0), (0, 2, 0), (9, 0, 4), (30, 0, 3), (3, 4, 2), (0, 12, 5)):
        for _ in range(300):
            a = np.unique(r.integers(0, 1 << 60, r.integers(1, 40)).astype(np.uint64))
            b = np.unique(np.concatenate([a[r.integers(0, 3) :], r.integers(0, 1 << 60, r.integers(0, 3)).astype(np.uint64)]))
            if len(b) and len(np.setxor1d(a, b)) <= k1 + 2 * k2 - 1 - spare:
                assert len(np.intersect1d(jaccard.signatures(a, 1, k1, k2, spare), jaccard.signatures(b, 1, k1, k2, spare)))


@pytest.mark.parametrize("percent", [80, 90])
def test_differences_bound_every_link_of_an_instance(percent):
    bands = jaccard.band_limits(400)
    for a in range(1, 301):
        for b in range(a, 100 * a // percent + 1):
            # the least common part that links
            common = next(i for i in range(a + 1) if 100 * i >= percent * (a + b - i))
            shared = set(jaccard.instances(a, bands, percent)) & set(jaccard.instances(b, bands, percent))
            assert shared and all(a + b - 2 * common <= jaccard.differences(bands[j][1], percent) for j in shared if bands[j][0] <= a <= bands[j][1])
            assert any(bands[j][0] <= a <= bands[j][1] for j in shared)


@pytest.mark.parametrize("width,percent", [(5, 80), (3, 90)])
def test_jaccard_on_random_near_copies(spark, width, percent):
    r = random.Random(percent)
    rows = []
    for k in range(60):
        words = [f"w{k % 12}-{i}" for i in range(3 + 7 * (k % 12))]
        for _ in range(r.randrange(4)):
            words[r.randrange(len(words))] = f"x{r.randrange(40)}"
        rows.append((k, " ".join(words[r.randrange(3) :] + ["end"] * r.randrange(3))))
    got = jaccard.link(spark.createDataFrame(rows, "doc_id long, text string"), width, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert {tuple(x) for x in got} == brute_components(rows, width, percent)


def test_order_minhash(spark, docs, odd):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = sorted(texts, reverse=True)
    rows = {r.doc_id: r for r in order_minhash.compare(docs).collect()}
    for k, i in enumerate(ids):
        t, after = texts[i], texts[ids[(k + 1) % len(ids)]]
        n = len(t) // 3
        assert rows[i].edited_sha256 == hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest()
    assert sum(r.near_edited for r in rows.values()) > 5 * sum(r.near_next for r in rows.values())
    prints = {}
    for i, r in rows.items():
        assert prints.setdefault(texts[i], r.fingerprint) == r.fingerprint
    assert order_minhash.compare(odd).count() == 8 and order_minhash.compare(odd.limit(0)).count() == 0


def test_rules(spark, docs, odd):
    rows = {r.doc_id: r for r in adaptive_rules.judge(odd).collect()}
    assert not rows[1].kept and rows[1].n_words == 0 and rows[4].n_repeat_words == 90_000 and rows[4].base_failed
    assert adaptive_rules.judge(odd.limit(0)).count() == 0
    good = spark.read.parquet(SF + "/labels.parquet").filter("quality = 1").select("doc_id")
    clean = adaptive_rules.judge(docs).join(good, "doc_id").filter("not base_failed").collect()
    assert sum(r.kept for r in clean) >= 0.95 * len(clean)


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and max(r.offset + r.length for r in rows) <= 2048


def test_pipeline_takes_near_copies_by_five_words_and_80_percent(spark):
    import corpus_pipeline

    words = [f"w{k}" for k in range(500)]
    edited = [f"x{k}" if k % 50 == 25 else w for k, w in enumerate(words)]
    far = [f"x{k}" if k % 40 == 20 else w for k, w in enumerate(words)]
    # of 5 words 0.82 and of 3 words 0.89; far from both, 0.77 and less
    rows = [(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(far[::-1])), (4, " ".join(words[::-1]))]
    got = corpus_pipeline.distinct(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted(r.doc_id for r in got) == [1, 3, 4]


@pytest.mark.parametrize("percent", [80, 90])
def test_jaccard_links_across_band_limits(spark, percent):
    limits = [high for _, high in jaccard.band_limits(10_000) if high > 200][::2]
    rows, pairs = [], []
    for k, high in enumerate(limits):
        words = [f"w{k}-{i}" for i in range(high + 3)]
        # high and high + 1 shingles, one on each side of the limit and no other in either band
        rows += [(2 * k, " ".join(words[: high + 2])), (2 * k + 1, " ".join(words))]
        pairs += [(2 * k, high, 2 * k), (2 * k + 1, high + 1, 2 * k)]
    got = jaccard.link(spark.createDataFrame(rows, "doc_id long, text string"), 3, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == pairs


def test_pipeline_keeps_one_row_of_a_group_with_null_ids(spark):
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{k}" for k in range(100)) for x in "abc")
    rows = [(5, a), (None, a), (None, a + " more"), (7, a), (None, b), (None, b + " more"), (None, b), (9, c), (9, c), (9, b + " other"), (11, ""), (None, None)]
    got = corpus_pipeline.distinct(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(5, a), (9, c), (9, b + " other"), (11, ""), (None, None)]))


@pytest.mark.parametrize("small,block,weight", [(12, 1024, 2_000_000), (3, 16, 400), (1, 1, 1)])
def test_jaccard_in_blocks_alone(spark, monkeypatch, small, block, weight):
    r = random.Random(block)
    for name, value in (("LEADER_ROUNDS", 0), ("SMALL_GROUP", small), ("BLOCK", block), ("BLOCK_SHINGLES", weight)):
        monkeypatch.setattr(jaccard, name, value)
    rows = []
    for k in range(60 if block > 1 else 16):
        words = [f"w{k % 2}-{i}" for i in range(40 + 10 * (k % 2))]
        for _ in range(r.randrange(5)):
            words[r.randrange(len(words))] = f"x{r.randrange(40)}"
        rows.append((r.randrange(1 << 60), " ".join(words)))
    got = jaccard.link(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80).select("doc_id", "n_shingles", "component_id").collect()
    assert {tuple(x) for x in got} == brute_components(rows, 3, 80)


def test_links_of_a_group_grow_with_its_sets(spark):
    base = [f"w{i}" for i in range(80)]
    # all of a class link with each other: 2 * 80 * 79 / 2 links
    rows = [(k, " ".join([*(base if k % 2 else base[::-1]), f"x{k}"])) for k in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    reps = jaccard.narrow_sets(docs, 3).selectExpr("did as rep", "k1")
    marks = jaccard.sets_of(docs, reps, jaccard.MARKS, 3, True)
    groups = reps.selectExpr("0L as a", "rep", "rep as comp")
    found = jaccard.links_in_blocks(groups, marks, lambda some: jaccard.sets_of(docs, reps.join(some, "rep"), jaccard.TOKENS, 3, True), 90).collect()
    assert len(found) <= 2 * len(rows)
    part = {k: k for k, _ in rows}
    for a, b in found:
        part = {k: part[a] if v == part[b] else v for k, v in part.items()}
    assert len(set(part.values())) == 2 and all(part[k] == part[k % 2] for k in part)

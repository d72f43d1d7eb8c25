"""Defined results of odd inputs, brute-force versions of learned and native operators, and both sides of each size check."""

import glob
import math
import os
import random
import re
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from quayside.llm import adaptive_rules, bitplane, common, jaccard, langid, mixing, order_minhash, packing, quality, queries, sharding, tokens, url_trie

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string"
LONG = "lorem ipsum dolor " * 30_000
#: A column for each name that an operator uses inside.
CLASHES = ("row", "key", "h", "lang_pred", "lang_score", "quality_score", "threshold", "repeats", "mix_source", "limit_source", "copies", "size", "copy", "shard", "component_id", "part", "rem", "rank", "w", "uid", "task", "extra")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(SF + "/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "One two, three!", "en", "a"), (3, "One two, three!", "en", "a"), (None, "null id here", "en", None), (4, LONG, "de", "b"), (5, " \n\t ", "de", "b"), (6, "a\x00b  c \n d 's <|endoftext|>", None, "b")]
    return spark.createDataFrame(rows, DOCS).select("*", *[F.lit(-1).alias(c) for c in CLASHES])


def rows_of(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


# tokens, files and packing


def coded(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path(name))
    t.encode_special_tokens = True
    return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in t.encode_batch_fast([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", [queries.WORD_BPE, queries.BYTE_BPE])
def test_pieces_give_the_ids_of_whole_texts(docs, name):
    r = random.Random(5)
    signs = list("abcdeXYZ019   \n\t\r\x0b.,'!?-_<|>éüßÀ×÷½²\xa0\x85\x1cćΣσςжあ漢\u0300\u200b😀İıſＡ")
    texts = ["".join(r.choice(signs) for _ in range(r.randrange(40))) for _ in range(4000)] + ["it's We'Ll 'd' 'S <|endoftext|>x<|startoftext|>", "\n\n a", "a  b", " a ", "x" * 3000, "é" * 100 + " " + "$$$" * 40, "12345 " * 50]
    texts += [x.text or "" for x in docs.collect()]
    assert tokens.encoder(tokens.tokenizer_path(name)).encode(texts) == coded(name, texts)


def test_long_pieces_are_not_kept():
    e = tokens.encoder(tokens.tokenizer_path(queries.BYTE_BPE))
    e.encode([f"{k}" + "q" * 100 for k in range(20)])
    assert all(len(p) <= tokens.LONG_PIECE + 1 for p in e.kept)


def test_bitplane_of_documents(spark, docs):
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    start, want = 0, []
    for r, raw in zip(rows, coded(queries.WORD_BPE, [r.text for r in rows])):
        raw += struct.pack("<I", 1)
        want.append((r.doc_id, start, len(raw) // 4, zlib.crc32(raw)))
        start += len(raw) // 4
    assert sorted(map(tuple, queries.op1_bitplane(spark, SF).collect())) == want


def test_packing_holds_each_id_once(spark, docs, odd):
    for df in (docs, odd):
        have = {}
        rows = df.collect()
        for r, raw in zip(rows, coded(queries.BYTE_BPE, [r.text for r in rows])):
            have.setdefault(r.doc_id, []).append(raw + struct.pack("<I", 1))
        pieces = {}
        for p in packing.pack(df, tokens.tokenizer_path(queries.BYTE_BPE)).collect():
            pieces.setdefault(p.doc_id, []).append(p)
        assert set(pieces) == set(have)
        for doc_id, texts in have.items():
            # each place of each text is in exactly one piece, and every piece is its text's
            want = sorted((len(raw) // 4, k) for raw in texts for k in range(len(raw) // 4))
            assert sorted((p.doc_tokens, k) for p in pieces[doc_id] for k in range(p.start, p.start + p.length)) == want
            assert all(any(p.doc_tokens == len(raw) // 4 and zlib.crc32(raw[4 * p.start : 4 * (p.start + p.length)]) == p.ids_crc32 for raw in texts) for p in pieces[doc_id])


# language


def test_language_of_odd_rows(spark, odd, docs):
    got = rows_of(langid.predict(odd), "doc_id", "lang_pred", "score")
    assert [g for g in got if g[0] in (1, 2, 5)] == [(1, "und", 0.0), (2, "und", 0.0), (5, "und", 0.0)]
    assert len(got) == 8 and len([g for g in got if g[0] == 3]) == 2 and all(g[1] in ("en", "de") for g in got if g[0] in (3, 4, 6, None))
    assert langid.learn(langid.train_rows(docs.limit(0))) is None
    assert rows_of(langid.predict(docs.limit(0)), "doc_id") == []


def test_all_of_many_languages_and_null_ids_are_learned(spark):
    r = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(230):
        words = ["".join(r.choice(letters) for _ in range(4)) for _ in range(8)]
        rows += [(None, " ".join(r.choice(words) for _ in range(12)), f"l{k}", None) for _ in range(12)]
    model = langid.learn(spark.createDataFrame(rows, DOCS))
    assert model.names == sorted({x[2] for x in rows}) and max(map(len, model.groups)) <= langid.FAMILY
    assert sorted(sum(model.groups, [])) == list(range(230))


def test_sample_is_bounded_by_distinct_rows(spark):
    rows = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 9000).cast("string")).alias("text"), F.when(F.col("id") % 3000 == 0, "rare").otherwise("often").alias("lang"))
    got = {r.lang: r.n for r in langid.sample(rows).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert 800 <= got["often"] <= 1100 and got["rare"] == 3


def test_language_model_against_plain_code():
    import numpy as np

    r = np.random.default_rng(4)
    centres = np.abs(r.normal(size=(7, langid.DIMS)))
    labels = np.repeat(np.arange(7), 6)
    x = (centres[labels] + 0.3 * np.abs(r.normal(size=(42, langid.DIMS)))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    names = [f"l{k}" for k in range(7)]
    model = langid.train(names, labels, x)
    means = np.stack([x[labels == k].mean(0) for k in range(7)])
    means /= np.linalg.norm(means, axis=1, keepdims=True)
    groups = [[k] for k in range(7)]
    while len(groups) > 3:  # average linkage, pair by pair
        _, i, j = max((np.mean([means[a] @ means[b] for a in g for b in h]), -i, -j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j)
        groups[-i] += groups.pop(-j)
    assert sorted(map(sorted, groups)) == sorted(model.groups)
    got, scores = model.predict(x)
    for row, name, score in zip(x, got, scores):
        family = max(range(len(model.groups)), key=lambda f: model.family_w[f] @ row + model.family_b[f])
        group = model.groups[family]
        votes, share = dict.fromkeys(group, 0), dict.fromkeys(group, 0.0)
        for k, (f, a, b) in enumerate(model.pairs):
            if f == family:
                p = 1 / (1 + math.exp(-4 * (model.pair_w[k] @ row + model.pair_b[k])))
                votes[a if p >= 0.5 else b] += 1
                share[a] += p
                share[b] += 1 - p
        best = max(group, key=lambda k: (votes[k], share[k]))
        sure = 1 / (1 + math.exp(-4 * (model.family_w[family] @ row + model.family_b[family])))
        assert name == names[best] and score == pytest.approx(sure * (share[best] / (len(group) - 1) if len(group) > 1 else 1), rel=1e-4)
    assert sum(n == names[k] for n, k in zip(got, labels)) >= 40


# quality


def test_quality_against_plain_updates(spark, docs):
    labels = spark.read.parquet(SF + "/labels.parquet")
    sample = sorted(quality.sample(docs, labels).collect(), key=lambda r: r.h)
    held = {r.doc_id for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    texts = {r.text: r.doc_id for r in docs.collect()}
    assert sample and not {texts[r.text] for r in sample if list(texts).count(r.text) == 1} & held
    import numpy as np

    z, n, zb, nb = {}, {}, 0.0, 0.0
    rows = [([int(i) for i in f[0]], [float(np.float16(v)) for v in f[1]], r.y) for r in sample for f in [quality.features(r.text)]]

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= quality.L1 else -(zi - math.copysign(quality.L1, zi)) / ((quality.BETA + math.sqrt(n.get(i, 0.0))) / quality.ALPHA + quality.L2)

    order = np.random.default_rng(1)
    for _ in range(quality.EPOCHS):
        for k in order.permutation(len(rows)):
            idx, val, y = rows[k]
            bias = -zb / ((quality.BETA + math.sqrt(nb)) / quality.ALPHA)
            w = [weight(i) for i in idx]
            g0 = 1 / (1 + math.exp(-max(-35, min(35, bias + sum(a * b for a, b in zip(w, val)))))) - y
            for i, v, wi in zip(idx, val, w):
                old = n.get(i, 0.0)
                n[i] = old + (g0 * v) ** 2
                z[i] = z.get(i, 0.0) + g0 * v - (math.sqrt(n[i]) - math.sqrt(old)) / quality.ALPHA * wi
            zb += g0 - (math.sqrt(nb + g0 * g0) - math.sqrt(nb)) / quality.ALPHA * bias
            nb += g0 * g0
    bias = -zb / ((quality.BETA + math.sqrt(nb)) / quality.ALPHA)
    got = {r.doc_id: r.score for r in quality.predict(docs, labels).collect()}
    for r in docs.collect():
        m = bias + sum(weight(int(i)) * float(v) for i, v in zip(*quality.features(r.text)))
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-m)), abs=2e-3)


def test_quality_of_odd_rows(spark, odd, docs):
    labels = spark.read.parquet(SF + "/labels.parquet")
    got = {r.doc_id: r for r in quality.predict(odd.unionByName(docs.filter("doc_id > 10"), True), labels.unionByName(labels)).collect()}
    assert got[1].score == got[2].score == got[5].score
    assert rows_of(quality.predict(odd, labels.limit(0)).select("score").distinct(), "score") == [(0.5,)]
    many = spark.range(30_000).select(F.lit(0).cast("long").alias("doc_id"), F.concat(F.lit("t "), F.col("id").cast("string")).alias("text"))
    one = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    assert quality.TRAIN_ROWS <= quality.sample(many, one).count() <= 1.4 * quality.TRAIN_ROWS


def test_whole_shapes_count():
    a, b = (quality.Words()[w] for w in ("a.b-" * 5 + "!", "a.b-" * 5 + "?"))
    assert a[1] != b[1]


# mixing, shards


def test_mix_of_rows_that_share_an_id(spark):
    texts = [(7, " ".join(["w"] * 10 + [str(k)]), "en", s) for k in range(60) for s in ("a", "b")]
    for df in (spark.createDataFrame(texts, DOCS), spark.createDataFrame([(7, "same text of five words", "en", s) for s in "ab" for _ in range(100)], DOCS)):
        by = {}
        for r in mixing.mix(df).collect():
            assert 0 <= r.copies <= 3
            by.setdefault(r.source, []).append(r)
        for group in by.values():
            assert abs(sum(r.taken for r in group) - group[0].target) <= 11
        assert mixing.mixed(df).count() == sum(r.copies for g in by.values() for r in g)


def test_mix_of_odd_rows(spark, odd):
    got = rows_of(mixing.mix(odd), "doc_id", "source", "size", "source_size")
    assert got == sorted([(1, None, 0, 3), (2, "a", 0, 6), (3, "a", 3, 6), (3, "a", 3, 6), (None, None, 3, 3), (4, "b", 90_000, 90_005), (5, "b", 0, 90_005), (6, "b", 5, 90_005)], key=str)
    assert max(r.copies for r in mixing.mix(odd).collect()) <= 3
    assert mixing.mixed(odd).columns == odd.columns


def test_shards_split_as_their_sql_says(spark):
    import duckdb

    sf, limit = "/root/testdata/sf0.01", 64 << 10
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(c.execute("select doc_id, shard, depth, shard_bytes from (" + queries.SQL["op7_extendible_shards"].replace("16777216", str(limit)) + ")").fetchall())
    got = sorted(map(tuple, sharding.assign(spark.read.parquet(f"{sf}/documents.parquet"), limit).filter("not oversized").select("doc_id", "shard", "depth", "shard_bytes").collect()))
    alone = {r.doc_id for r in sharding.assign(spark.read.parquet(f"{sf}/documents.parquet"), limit).filter("oversized").collect()}
    assert [x for x in got if x[0] not in alone] == [x for x in want if x[0] not in alone] and len({x[1] for x in got}) > 20


def test_written_shards_hold_every_row(spark, odd, tmp_path):
    df = odd.unionByName(odd.filter("doc_id = 3")).unionByName(odd.filter("doc_id is null"))
    path = f"file://{tmp_path}/shards"
    directory = sharding.write_shards(df, path, 60)
    back = spark.read.parquet(path)
    assert rows_of(back, "doc_id", "text", "shard") == rows_of(df, "doc_id", "text", "shard")
    assert sum(r.n_docs for r in directory.collect()) == df.count() and max(r.bytes for r in directory.collect()) > 60
    assert all(r.bytes <= 60 or r.n_docs == 1 for r in directory.collect())
    folders = {os.path.basename(d) for d in glob.glob(f"{tmp_path}/shards/shard_=*")}
    assert folders == {f"shard_={r.shard}" for r in directory.collect()}


def test_repeated_rows_are_dealt_in_chunks(spark):
    df = spark.createDataFrame([(1, 3), (2, 25), (3, 10), (4, 1)], "k long, n long")
    got = sorted(tuple(r) for r in common.repeated(df, "n", "i", chunk=10).select("k", "i").collect())
    assert got == [(k, i) for k, n in ((1, 3), (2, 25), (3, 10), (4, 1)) for i in range(n)]


def test_running_sums(spark):
    df = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("k"))
    got = {r.k: r.s for r in common.running_sums(df, [F.col("k").asc()], {"s": F.col("k")}).collect()}
    assert got == {k: k * (k - 1) // 2 for k in range(1000)}


# near duplicates, fingerprints, rules, urls


def test_jaccard_of_odd_rows(odd):
    got = rows_of(jaccard.link(odd), "doc_id", "n_shingles", "component_id", "class_id")
    assert got == sorted([(1, 0, 1, 1), (2, 0, 2, 2), (3, 1, 3, 3), (3, 1, 3, 3), (None, 1, None, None), (4, 3, 4, 4), (5, 0, 5, 5), (6, 3, 6, 6)], key=str)


def sketch(text):
    """Order MinHash of a text, in plain code."""
    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fold = lambda parts, seed=42: signed(seed) if not parts else fold(parts[1:], xxhash.xxh64_intdigest(parts[0], seed))
    number = lambda x, n: (x % (1 << 8 * n)).to_bytes(n, "little")
    words = []
    for w in re.split("[\x20\x09-\x0D]+", text):
        words += [x for x in (re.sub(order_minhash.CUT, r"\1 ", w).split(" ") if len(w) > order_minhash.LONG_WORD else [w]) if x]
    seen, best = {}, {}
    for pos in range(max(1, len(words) - order_minhash.K + 1) if words else 0):
        gram = fold([w.encode() for w in words[pos : pos + order_minhash.K]])
        seen[gram] = seen.get(gram, 0) + 1
        h = fold([number(gram, 8), number(seen[gram], 4)])
        cell = (h % order_minhash.SKETCHES, h >> 32 & 1)
        best[cell] = min(best.get(cell, (h, pos)), (h, pos))
    out = []
    for s in {c[0] for c in best}:
        (a, p), (b, q) = best.get((s, 0), (0, None)), best.get((s, 1), (0, None))
        pair = fold([number(b, 8), number(a, 8)] if p is not None and q is not None and q < p else [number(a, 8), number(b, 8)])
        out.append((s << order_minhash.HASH_BITS) + pair % (1 << order_minhash.HASH_BITS))
    return "".join(f"{x:08x}" for x in sorted(out))


def test_fingerprints_against_plain_code(spark, docs):
    extra = [(10_001, "x" * 300 + " " + "ab" * 100), (10_002, "漢字仮名交じり文" * 20), (10_003, "one"), (10_004, ""), (10_005, "a b a b a b a b")]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {r.doc_id: r for r in order_minhash.compare(df).collect()}
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    ids = sorted(texts, reverse=True)
    for k, i in enumerate(ids):
        t, after = texts[i], texts[ids[(k + 1) % len(ids)]]
        n = len(t) // 3
        assert got[i].fingerprint == sketch(t), i
        assert got[i].edited_fingerprint == sketch(t[: len(t) - n] + after[:n]), i


def test_an_edit_in_unspaced_text_keeps_most_of_its_fingerprint(spark):
    r = random.Random(8)
    text = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6000))
    other = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6000))
    rows = [(1, text), (2, text[:50] + "q" + text[50:]), (3, other)]
    fps = order_minhash.fingerprints(spark.createDataFrame(rows, "key long, text string"), "key").collect()
    fp = {x.key: set(x.fp) for x in fps}
    assert len(fp[1] & fp[2]) >= 0.9 * len(fp[1]) and len(fp[1] & fp[3]) <= 0.1 * len(fp[1])


def test_fingerprints_of_odd_rows(odd):
    got = rows_of(order_minhash.compare(odd), "doc_id", "n_chars", "fingerprint")
    want = [(r.doc_id, len(r.text or ""), sketch(r.text or "")) for r in odd.collect()]
    assert got == sorted(want, key=str)


def test_rules_of_odd_rows(odd):
    got = rows_of(adaptive_rules.judge(odd), "doc_id", "n_words", "n_repeat_words", "base_failed", "kept")
    few = lambda i, n: (i, n, 0, True, False)
    assert got == sorted([few(1, 0), few(2, 0), few(3, 3), few(3, 3), few(None, 3), (4, 90_000, 90_000, True, False), few(5, 0), few(6, 5)], key=str)


def test_sketches_of_large_groups_stay_within_their_error(spark):
    n = 60_000  # beyond what a sketch holds exactly
    value = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003.0
    rows = spark.range(n).select(F.lit("en").alias("lang"), F.lit("a").alias("source"), *[value.alias(m) for m in adaptive_rules.MEASURES])
    f = adaptive_rules.fences(rows).first()
    exact = rows.agg(*[F.percentile("word_length", p).alias(f"q{k}") for k, p in ((1, 0.25), (3, 0.75), (99, 0.99))]).first()
    spread = exact.q3 - exact.q1
    # ranks are off by at most 0.2 % of a group, and the spread by twice that
    assert f.word_length_high == pytest.approx(exact.q3 + adaptive_rules.FENCE * spread, abs=0.03)
    assert f.word_length_low == pytest.approx(exact.q1 - adaptive_rules.FENCE * spread, abs=0.03)
    assert f.repeat_rate_high == pytest.approx(adaptive_rules.TAIL * exact.q99, abs=0.01)


def test_a_group_decides_by_its_own_texts(spark):
    """The same text is kept in a source of its like and goes elsewhere, whatever one cut-off would say; a group without a range takes its language's."""
    r = random.Random(9)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    text = lambda signs: " ".join(word(r.randrange(4, 7)) + "!" * (r.random() < signs) for _ in range(120))
    rows = [("plain", text(r.uniform(0.05, 0.1))) for _ in range(80)] + [("loud", text(r.uniform(0.2, 0.9))) for _ in range(80)]
    same, odd_one, bare = text(0.6), text(0.95), text(0)
    rows += [("plain", same), ("loud", same), ("few", same)] + [("none", bare)] * 60 + [("none", odd_one)]
    docs = spark.createDataFrame([(k, t, "en", s) for k, (s, t) in enumerate(rows)], DOCS)
    got = {rr.doc_id: rr for rr in adaptive_rules.judge(docs).collect()}
    base = 160
    assert not got[base].kept and got[base + 1].kept and got[base].sign_rate == got[base + 1].sign_rate
    louder = [k for k, (s, _) in enumerate(rows) if s == "loud" and got[k].kept and got[k].sign_rate > got[base].sign_rate]
    assert louder and sum(got[k].kept for k in range(160)) >= 156
    fences = {f.f_source: f for f in adaptive_rules.fences(adaptive_rules.with_measures(adaptive_rules.measured(docs).withColumn("n_repeat_words", F.lit(0)))).collect()}
    assert fences["few"].sign_rate_high == fences["none"].sign_rate_high != fences["plain"].sign_rate_high
    assert fences["plain"].dup_line_rate_high is None


RULES = [("b.c", "/x/y/z/", "block"), ("a.b.c", "/", "allow"), ("c", "/x/", "allow"), ("a.b.c", "/x/y", "block"), ("c", "/x/y/zzzzzzzzzzzzzzzz", "block")]


def test_longest_rule_wins(spark):
    urls = ["h://a.b.c/x/y/z/", "h://a.b.c/x/", "h://q.b.c/x/y/z/1", "h://c/x/y/zzzzzzzzzzzzzzzzz", "h://b.c/x/y/zzzzzzzzzzzzzzzz", "h://c/", "h://", None, "h://a.b.c/x/y/z/" + "p/" * 50_000]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string").withColumn("host", F.lit("mine")).withColumn("m", F.lit(1))
    want = [("b.c/x/y/z/", "block"), ("a.b.c/", "allow"), ("b.c/x/y/z/", "block"), ("c/x/y/zzzzzzzzzzzzzzzz", "block"), ("c/x/y/zzzzzzzzzzzzzzzz", "block"), (None, "allow"), (None, "allow"), (None, "allow"), ("b.c/x/y/z/", "block")]
    for most in (url_trie.MAX_TRIE_RULES, 0):
        got = sorted(map(tuple, url_trie.judge(pages.unionByName(pages), RULES, max_rules=most).select("page_id", "rule", "verdict").collect()))
        assert got == sorted([(k, *w) for k, w in enumerate(want)] * 2)
        assert url_trie.judge(pages.limit(0), RULES, max_rules=most).count() == 0


# size checks


@pytest.mark.parametrize("module,limit,run", [(mixing, "SENT_SOURCES", mixing.mix), (jaccard, "SENT_IDS", jaccard.link), (order_minhash, "SENT_ROWS", order_minhash.compare), (adaptive_rules, "SENT_GROUPS", adaptive_rules.judge)])
def test_both_sides_of_size_checks_agree(docs, monkeypatch, module, limit, run):
    names = run(docs).columns
    small = rows_of(run(docs), *names)
    monkeypatch.setattr(module, limit, 0)
    assert rows_of(run(docs), *names) == small


# the pipeline


@pytest.fixture(scope="module")
def stages():
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)


def test_stages_carry_columns_of_any_name(spark, odd, docs, stages):
    clashing = docs.select(*docs.columns, *[F.lit(-1).alias(c) for c in CLASHES if c not in docs.columns])
    for name, stage in stages.items():
        out = stage(spark, clashing, SF)
        if name != "packing":
            assert out.columns == clashing.columns and out.filter("lang_pred <> -1 or threshold <> -1 or copies <> -1 or key <> -1").isEmpty(), name
        assert out.count() > 0 and stage(spark, clashing.limit(0), SF).count() == 0, name


def test_stages_on_odd_rows(spark, odd, docs, stages):
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=str)
    both = odd.unionByName(docs.select("doc_id", "text", "lang", "source").filter("doc_id > 10"), True)
    kept = [i for i in ids(stages["language ID"](spark, both, SF)) if i is None or i <= 6]
    assert {1, 2, 5}.isdisjoint(kept)
    kept = ids(stages["n-gram Jaccard join"](spark, odd, SF))
    assert kept == [1, 2, 3, 4, 5, 6, None]
    kept = ids(stages["mixing sources to target weights"](spark, odd, SF))
    assert max(kept.count(i) for i in set(kept)) <= 6 and {i for i in kept} <= {1, 2, 3, 4, 5, 6, None}
    pieces = stages["packing"](spark, odd, SF).collect()
    assert {p.doc_id for p in pieces} == {1, 2, 3, 4, 5, 6, None} and sum(p.doc_tokens == 1 for p in pieces) == 2


def test_pipeline_against_its_operators_and_brute_force(spark, docs, stages):
    import corpus_pipeline

    pred = {r.doc_id for r in langid.predict(docs).collect() if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_LANGUAGE_SCORE}
    first = common.written(stages["language ID"](spark, docs, SF), "test")
    assert {r.doc_id for r in first.collect()} == pred
    second = common.written(stages["quality classifier"](spark, first, SF), "test")
    good = {r.doc_id for r in quality.predict(first, spark.read.parquet(SF + "/labels.parquet")).collect() if r.predicted}
    assert {r.doc_id for r in second.collect()} == good
    sets = {}
    for r in second.collect():
        w = r.text.encode().lower().split()
        sets[r.doc_id] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    group = {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                group[b] = a
    third = common.written(stages["n-gram Jaccard join"](spark, second, SF), "test")
    assert sorted(r.doc_id for r in third.collect()) == sorted(i for i in sets if root(i) == i)
    fourth = common.written(stages["mixing sources to target weights"](spark, third, SF), "test")
    copies = {r.doc_id: r.copies for r in mixing.mix(third).collect() if r.copies}
    taken = {}
    for r in fourth.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + 1
    assert taken == copies
    rows = third.collect()
    texts = {r.doc_id: raw for r, raw in zip(rows, coded(queries.BYTE_BPE, [r.text for r in rows]))}
    last = sorted(map(tuple, stages["packing"](spark, fourth, SF).select("doc_id", "start", "length").collect()))
    assert sum(x[2] for x in last) == sum(n * (len(texts[i]) // 4 + 1) for i, n in copies.items())
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "start", "length").collect())) == last


def test_stages_may_be_read_late_and_in_any_order(spark, docs, stages):
    a = stages["n-gram Jaccard join"](spark, docs, SF)
    b = stages["mixing sources to target weights"](spark, docs, SF)
    assert b.count() > 0 and a.count() > 0

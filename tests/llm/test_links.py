"""Exact numbers of links, and tensored banding against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayside.llm import jaccard, queries, tensor_minhash

SF = "/root/testdata/sf0.01"


def brute(rows, width, percent):
    """(doc_id, n_shingles, component_id, links) of rows (doc_id, text): links to different sets."""
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()
    different = [s for s in set(sets.values()) if s]
    near = lambda a, b: 100 * len(a & b) >= percent * len(a | b)
    links = {s: [t for t in different if t != s and near(s, t)] for s in different}
    by_set = {}
    for i, s in sorted(sets.items()):
        by_set.setdefault(s, i)
    root = {}
    for s in sorted(different, key=lambda s: by_set[s]):
        if s not in root:
            stack, members = [s], {s}
            while stack:
                for t in links[stack.pop()]:
                    if t not in members:
                        members.add(t)
                        stack.append(t)
            least = min(by_set[t] for t in members)
            root.update(dict.fromkeys(members, least))
    return {(i, len(s), root[s] if s else i, len(links[s]) if s else 0) for i, s in sets.items()}


def near_copies(r, n, edits=5):
    rows = []
    for k in range(n):
        words = [f"w{k % 3}-{i}" for i in range(60 + 40 * (k % 3))]
        for _ in range(r.randrange(edits)):
            words[r.randrange(len(words))] = f"x{r.randrange(40)}"
        rows.append((r.randrange(1 << 60), " ".join(words)))
    return rows + [(1, None), (2, " "), (3, "one"), (4, "One"), (5, rows[0][1]), (6, rows[0][1].upper())]


@pytest.mark.parametrize("block,weight", [(1024, 1_000_000), (8, 1_000_000), (1024, 700), (1, 1)])
def test_links_of_each_set_against_brute_force(spark, monkeypatch, block, weight):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", weight)
    rows = near_copies(random.Random(block + weight), 90 if block > 1 else 20)
    got = jaccard.link(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80)
    assert {tuple(x) for x in got.select("doc_id", "n_shingles", "component_id", "links").collect()} == brute(rows, 3, 80)


def test_links_of_a_group_that_links_with_itself(spark):
    base = [f"w{i}" for i in range(80)]
    rows = [(k, " ".join([*base, f"x{k}"])) for k in range(40)]
    got = jaccard.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.links for r in got} == {39} and {r.component_id for r in got} == {0}


def test_links_of_the_table_are_those_of_brute_force(spark):
    docs = spark.read.parquet(SF + "/documents.parquet")
    got = {tuple(x) for x in queries.op8_jaccard_partitions(spark, SF).select("doc_id", "n_shingles", "component_id", "links").collect()}
    assert got == brute([tuple(r) for r in docs.select("doc_id", "text").collect()], 3, 90)


def test_common_counts_against_sets():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 300, r.integers(1, 200))).astype(np.int64) for _ in range(20)]
    want = np.array([[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets])
    own = jaccard.common_counts(sets)
    assert (own == want).all() or all(own[i, j] == want[i, j] for i in range(20) for j in range(20) if i != j)
    assert (jaccard.common_counts(sets[:7], sets[7:]) == want[:7, 7:]).all()


# tensored banding


def kept_rows(df):
    return {tuple(x) for x in df.select("doc_id", "n_shingles", "component_id", "kept").collect()}


def with_kept(rows):
    return {(i, n, c, i == c) for i, n, c, _ in rows}


def test_tensored_banding_of_the_table(spark):
    docs = spark.read.parquet(SF + "/documents.parquet")
    assert kept_rows(queries.op11_tensored_minhash(spark, SF)) == with_kept(brute([tuple(r) for r in docs.select("doc_id", "text").collect()], 5, 85))


@pytest.mark.parametrize("rounds", [2, 0])
def test_tensored_banding_of_near_copies(spark, monkeypatch, rounds):
    monkeypatch.setattr(jaccard, "LEADER_ROUNDS", rounds)
    rows = near_copies(random.Random(6), 120, 4)
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(-1).alias(c) for c in ("did", "n", "halves", "sig", "rep", "kept")])
    assert kept_rows(tensor_minhash.dedup(df.repartition(5))) == with_kept(brute(rows, 5, 85))
    assert tensor_minhash.dedup(df.limit(0)).count() == 0


def test_rows_that_share_or_lack_an_id(spark):
    rows = [(None, "a b c d e f g"), (None, None), (7, "same words of one text here"), (7, "same words of one text here"), (7, "other words stand in this one"), (8, "same words of one text here"), (9, "x " * 100_000)]
    got = tensor_minhash.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(str, map(tuple, got.select("doc_id", "component_id", "kept").collect()))) == sorted(map(str, [(None, None, True), (None, None, True), (7, 7, True), (7, 7, True), (7, 7, True), (8, 7, False), (9, 9, True)]))


def test_tables_meet_as_often_as_both_collections_allow():
    """Misses of pairs at the threshold stay about the stated bound with fewer groups, where it can be measured."""
    r = np.random.default_rng(5)
    groups, half, missed, n = 3, 2, 0, 600
    f, o = tensor_minhash.multipliers(2 * groups * half)
    assert len({*f.tolist()}) == len(f)
    with np.errstate(over="ignore"):
        for _ in range(n):
            toks = jaccard.mix(r.integers(0, 1 << 62, 200).astype(np.uint64))
            a, b = (tensor_minhash.halves(np.unique(x), groups, half) for x in (toks[:185], toks[15:]))  # 170 of 200
            same = a == b
            missed += not (same[:groups].any() and same[groups:].any())
    bound = 2 * (1 - 0.85**half) ** groups
    assert missed / n <= 1.6 * bound

"""Clusters of integer vectors and repairs of conversations against plain code."""

import functools
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quayside.llm import conversation, lloyd, queries

SF = "/root/testdata/sf0.01"
INF = float("inf")


# clusters


def plain_lloyd(rows, k, rounds):
    kept = [(i, tuple(int(x * 256 // 1) for x in (max(-lloyd.CLAMP, min(lloyd.CLAMP, c)) for c in v))) for i, v in rows if v is not None and len(v) == 3 and all(c is not None and abs(c) < INF for c in v)]
    centres = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for j, g in groups.items():
            centres[j] = tuple(sum(x) // len(g) for x in zip(*g))
    found = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    inertia = {}
    for _, j, d in found:
        inertia[j] = inertia.get(j, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for i, j, d in found), key=str)


def test_clusters_against_plain_code(spark):
    r = random.Random(3)
    rows = [(i, [r.choice((-1, 0, 1)) + r.random() / 4 for _ in range(3)]) for i in range(150)]
    rows += [(i, [0.5, 0.5, 0.5]) for i in range(200, 400)] + [(7, [9.0, 9.0, 9.0]), (None, [0.1, 0.2, 0.3]), (None, [0.1, 0.2, 0.3]), ((1 << 62) + 1, [1e30, -1e30, 0.0])]
    rows += [(500, None), (501, []), (502, [1.0, 2.0]), (503, [1.0, None, 2.0]), (504, [1.0, float("nan"), 2.0]), (505, [1.0, INF, -INF])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *[F.lit(-1).alias(c) for c in ("v", "cluster", "distance", "n", "s0", "id")])
    for k, rounds in ((6, 4), (3, 0), (1000, 2)):
        got = lloyd.cluster(df.repartition(5), k, rounds, dims=3)
        assert sorted(map(tuple, got.collect()), key=str) == plain_lloyd(rows, k, rounds)
    assert lloyd.cluster(df.limit(0), dims=3).count() == 0 and lloyd.cluster(df.filter("vec_id = 500"), dims=3).count() == 0


def test_ties_go_to_the_lower_number():
    import numpy as np

    best, d = lloyd.nearest(np.array([[0, 0], [5, 0]]), np.array([[1, 0], [-1, 0], [9, 0]]))
    assert best.tolist() == [0, 0] and d.tolist() == [1, 16]


def test_clusters_dont_depend_on_partitions(spark):
    table = spark.read.parquet(SF + "/embeddings.parquet")
    assert sorted(lloyd.cluster(table.repartition(7)).collect()) == sorted(lloyd.cluster(table.coalesce(1)).collect())


# conversations


def plain_repair(turns):
    """Least (cost, audit) and its messages, edit by edit."""
    step = lambda q, role: {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(role[:1], {}).get(q)
    seen, faults = [], []
    for _, role, text in turns:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.append((role, text))

    @functools.cache
    def best(t, q, inserts):
        """(cost, audit, messages) of what is left."""
        options = [(0, "", ())] if t == len(turns) and q in (0, 3) else []
        if inserts < 4:
            for role in ("user", "assistant"):
                if step(q, role) is not None and (rest := best(t, step(q, role), inserts + 1)):
                    options.append((rest[0] + 3, "I" + rest[1], ((role, ""), *rest[2])))
        if t < len(turns):
            _, role, text = turns[t]
            if rest := best(t + 1, q, 0):
                options.append((rest[0] + 4, "D" + rest[1], rest[2]))
            if faults[t] not in ("blank", "duplicate"):
                more = 3 * (faults[t] == "truncated")
                for letter, new, cost in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                    if step(q, new) is not None and (rest := best(t + 1, step(q, new), 0)):
                        options.append((rest[0] + cost + more, letter + rest[1], ((new, text), *rest[2])))
        return min(options) if options else None

    for t in range(len(turns), 0, -20):  # so that calls don't nest deeply
        for q in range(4):
            best(t, q, 0)
    cost, audit, messages = best(0, 0, 0)
    numbers = {t for t, _, _ in turns if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    return (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in messages).encode()).hexdigest())


def plain_damage(rows):
    convs = {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        role, text = (" " if role is None else role), (" " if text is None else text)
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k:
            row = (turn, "user" if k == 4 else role, "" if k == 1 else text.translate({ord(c): None for c in ".!?"}) if k == 2 else text)
            kept += [row] * (2 if k == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return {c: sorted(kept, key=order) for c, kept in convs.items()}


def expected(rows):
    return sorted(((c, *plain_repair(tuple(turns))) for c, turns in plain_damage(rows).items()), key=str)


def audited(df):
    return sorted(map(tuple, conversation.audited(conversation.repair(conversation.damaged(df))).collect()), key=str)


@pytest.fixture(scope="module")
def odd():
    r = random.Random(11)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "União"]
    texts = ["Yes.", "No!", "cut", "", None, " \n", "Yes.", "Why? ", "é…", "a.b"]
    rows = [(c if c else None, r.choice((None, t, t, t, t + 1)), r.choice(roles[:5] if c % 3 else roles), r.choice(texts)) for c in range(120) for t in range(r.randrange(1, 9))]
    rows += [(500, t, ("user", "assistant")[t % 2], "Ok.") for t in range(-3, 4)] + rows[:5] + [(501, k, "user", "x" * 50_000 + ".") for k in (-(1 << 62), 1 << 62)]
    rows += [(c, t, "user", "Gone.") for c in range(600, 700) for t in [1] if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def test_repairs_against_plain_code(spark, odd):
    df = spark.createDataFrame(odd, SCHEMA).select("*", *[F.lit(-1).alias(c) for c in ("copies", "chunk", "audit", "messages", "at", "cost")])
    want = expected(odd)
    assert audited(df) == want and any(w[-2] == "" for w in want)
    assert audited(df.limit(0)) == []


def test_long_conversations_are_repaired_alike(spark, odd, monkeypatch):
    monkeypatch.setattr(conversation, "DIRECT_ROWS", 3)
    monkeypatch.setattr(conversation, "CHUNK", 2)
    assert audited(spark.createDataFrame(odd, SCHEMA)) == expected(odd)


def test_a_conversation_beyond_one_task(spark):
    r = random.Random(2)
    rows = [(9, t, r.choice(("user", "assistant", "assistant", "system")), r.choice(("Yes.", "No", "", f"Text {t}.", f"Text {t}."))) for t in range(700)]
    assert audited(spark.createDataFrame(rows, SCHEMA).repartition(5)) == expected(rows)


def test_chunks_give_the_whole_cost():
    r = random.Random(4)
    for _ in range(60):
        codes = [(r.choice("sua-"), r.random() < 0.2, r.random() < 0.2) for _ in range(9)]
        cost, audit, state = conversation.trace(codes, conversation.FINISH, 0)
        tables = [conversation.between(codes[k : k + 3]) for k in (0, 3, 6)]
        ends = conversation.FINISH
        for costs in reversed(tables):
            ends = [min(costs[4 * q + x] + ends[x] for x in range(4)) for q in range(4)]
        assert ends[0] == cost


def test_conversations_of_the_table(spark):
    df = spark.read.parquet(SF + "/conversations.parquet")
    got = sorted(map(tuple, queries.op13_cost_layers(spark, SF).collect()), key=str)
    assert got == expected([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])

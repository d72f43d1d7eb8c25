"""Search of a table of queries against a plain loop, and ranks over ranges against one sort."""

import random

import pytest
from pyspark.sql import functions as F

from quayside.functions.text import bare
from quayside.operators import client, search, views
from quayside.sources.scratch import written

STATIONS = "id long, name string, is_capital boolean, n_dest long"
EXONYMS = [("Monaco di Baviera", "München"), ("Praga", "Praha"), ("abca", "bc"), ("ab", "Zürich")]


def plain(stations, queries, exonyms, limit):
    low = lambda t: bare(t).lower()
    out = set()
    for k, query in queries:
        if query is None:
            continue
        q = low(query)
        forms = {q} | {low(b) if low(a).startswith(q) else low(b) + q[len(a) :] for a, b in exonyms if len(q) >= 3 and (low(a).startswith(q) or q.startswith(low(a)))}
        hits = []
        for i, name, capital, n in stations:
            norm = low(name) if name is not None else None
            tiers = [0 if norm.startswith(v) else 1 for v in forms if v in norm] if norm is not None else []
            if tiers:
                hits.append((min(tiers), not capital, -(n or 0), len(norm), i, name, n))
        out |= {(k, r, h[4], h[5], h[0], h[6]) for r, h in enumerate(sorted(hits, key=lambda h: h[:5])[:limit], 1)}
    return out


@pytest.mark.parametrize("limit", [1, 3, 50])
def test_each_query_finds_what_a_loop_finds(spark, limit, monkeypatch):
    monkeypatch.setattr(search, "SLICE", 20)
    rng = random.Random(limit)
    word = lambda n: "".join(rng.choice("abcÄ ") for _ in range(rng.randint(0, n)))
    stations = [(i, rng.choice([word(6), word(12), "abcabc", "München Ost"]), rng.choice([True, False, None]), rng.choice([None, 0, 1, 2])) for i in range(200)]
    stations += [(200, None, True, 9), (201, "", True, 3), (202, "München Hbf", False, 5), (203, "Bad München-Dorf", False, 7), (204, "Praha hl.n.", True, 1)]
    queries = [(k, word(5)) for k in range(60)] + [(k, "abc") for k in range(60, 90)] + [(90, None), (91, ""), (92, "monaco di baviera ost"), (93, "MONACO"), (94, "prag"), (95, "n"), (96, "hen"), (97, "nothing like it"), (98, "praga hl")]
    got = search.search_all(spark.createDataFrame(stations, STATIONS), spark.createDataFrame(queries, "search_id long, query string"), spark.createDataFrame(EXONYMS, "name string, native string"), limit)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plain(stations, queries, EXONYMS, limit)


def test_one_query_of_the_table_is_the_search_of_one_text(spark):
    stations = spark.createDataFrame([(k, n, k == 4, k % 3) for k, n in enumerate(["München Hbf", "München Ost", "Bad München-Dorf", "Münchenberg", "München", "Praha"], 1)], STATIONS)
    known = stations.filter("id <> 4")
    one = [r.id for r in views.search(stations, "munchen", [], reach=known).collect()]
    exonyms = spark.createDataFrame([], "name string, native string")
    table = search.search_all(stations, spark.createDataFrame([(7, "munchen")], "search_id long, query string"), exonyms, reach=known)
    assert [r.id for r in table.orderBy("rank").collect()] == one and 4 not in one
    none = spark.createDataFrame([], "search_id long, query string")
    assert search.search_all(stations, none, exonyms).count() == 0 and search.search_all(stations.limit(0), none.union(spark.createDataFrame([(1, "a")], none.schema)), exonyms).count() == 0
    for limit in (0, -1, 51):
        with pytest.raises(ValueError):
            search.search_all(stations, none, exonyms, limit)


def test_ranks_over_ranges_are_those_of_one_sort(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice(["Ähr", "ahr", "Bonn", "AHR", None]), rng.choice([0, 0, 0, 5, 9])) for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, name string, n_dest long").repartition(7)
    got = {r.id: r["rank"] for r in client.ranked(df, F.desc("n_dest")).collect()}
    want = sorted(rows, key=lambda r: (-r[2], "" if r[1] is None else bare(r[1]).lower(), r[0]))
    assert got == {r[0]: k for k, r in enumerate(want, 1)}
    assert client.ranked(df.limit(0), F.desc("n_dest")).count() == 0
    plan = client.ranked(df, F.desc("n_dest"))._jdf.queryExecution().executedPlan().toString()
    assert "Window [row_number" in plan and plan.count("SinglePartition") <= 1  # one row for each range


@pytest.mark.parametrize("sent", [0, search.SENT])
def test_stations_and_searches_are_never_sent(spark, monkeypatch, sent):
    """Names are few bytes in their files, their letters are many rows: neither they nor the searches go through the driver."""
    monkeypatch.setattr(search, "SENT", sent)
    monkeypatch.setattr(search, "SLICE", 500)
    stations = [(k, f"München {k}" if k % 2 else f"Bad Köln {k % 40}", k % 10 == 0, k % 17) for k in range(3000)]
    queries = [(k, ("unch", "n 1", "köln 3", "mun", "praga")[k % 5]) for k in range(2000)]
    exonyms = [("Praga", "Praha")]
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    frames = spark.createDataFrame(stations, STATIONS), spark.createDataFrame(queries, "search_id long, query string"), spark.createDataFrame(exonyms, "name string, native string")
    kept = [written(f, "given") for f in frames]  # as files, by whose size Spark would send them
    got = search.search_all(kept[0], kept[1], kept[2], reach=kept[0].filter("id % 13 <> 0"))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plain([s for s in stations if s[0] % 13], queries, exonyms, 10)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    sizes = []
    for k in range(before, store.executionsCount()):
        run = store.executionsList().apply(k)
        values, nodes = store.executionMetrics(run.executionId()), store.planGraph(run.executionId()).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if node.name() == "BroadcastExchange":
                of = [node.metrics().apply(i) for i in range(node.metrics().size())]
                sizes += [int(values.get(m.accumulatorId()).get().replace(",", "")) for m in of if m.name() == "number of output rows" and values.contains(m.accumulatorId())]
    assert max(sizes, default=0) <= 100 and (sizes == []) == (sent == 0)

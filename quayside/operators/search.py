"""Search of a table of queries in a table of stations.

What decides the order among stations (capital, destinations, length of name, id) doesn't depend on the query; only
whether a name begins with it or holds it does. So equal queries are answered once, equal names stand as one name with
their best stations, and every group is cut to its best rows ahead of its exchange: a query, a name or a beginning that
a third of all rows share costs no more than `limit` rows of each task.

- Names that begin with a query: all beginnings of names, the best names of each, joined with the queries.
- Names that only hold it: asked for queries that aren't filled yet, by postings of three letters (one or two for
  shorter queries); a query meets the postings of its rarest letters, slice by slice of the names, and each candidate
  is compared. A query meets only slices that have its letters, so one with rare letters isn't copied.
- Few queries (counted by letters) are sent to all tasks, which look up beginnings and letters of their own names;
  more of them are met by exchanges. Names, stations and rows of searches are never sent.

Null queries and null names are never found; an empty query is the beginning of every name; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quayside.functions.text import search_name
from quayside.sources.scratch import written

#: What the reader of a search may ask for at most.
MOST = 50
#: Letters of a posting.
GRAM = 3
#: Names of a slice: letters that all names hold are dealt out by slices of so many names.
SLICE = 2_000
#: Queries whose letters, times the stations of an answer, are at most so many are sent to all tasks.
SENT = 1_000_000
_ORDER = ("off", "less", "size", "id")


def _best(rows: DataFrame, by: str, order: tuple[str, ...], limit: int) -> DataFrame:
    """The first rows of each group; Spark cuts to them ahead of the exchange, too."""
    rank = F.row_number().over(W.partitionBy(by).orderBy(*order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= limit)


def _beginnings(text: str, least: int) -> Column:
    """All beginnings of a text from a length on."""
    n = F.length(text)
    cut = F.transform(F.sequence(F.lit(least), F.greatest(n, F.lit(least))), lambda k: F.substring(F.col(text), F.lit(1), k))
    return F.when(n >= least, cut).otherwise(F.array().cast("array<string>"))


def _grams(text: str, size: Column) -> Column:
    """The different runs of so many letters."""
    last = F.length(text) - size + 1
    runs = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda k: F.substring(F.col(text), k, size))
    return F.when(last >= 1, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def _meet(rows: DataFrame, other: DataFrame, by: str | list[str], few: bool, how: str = "inner") -> DataFrame:
    """A join that sends what it is told to be few, and else nothing: what Spark takes for small by its files may be many rows."""
    return rows.join(F.broadcast(other) if few else other.hint("merge"), by, how)


def variants(queries: DataFrame, exonyms: DataFrame) -> DataFrame:
    """q, v: each folded query as it is and, from 3 letters on, its translations: of names that it begins, and of names
    that begin it. queries: q; exonyms: name, native."""
    ex = exonyms.select(search_name(F.col("name")).alias("name"), search_name(F.col("native")).alias("native")).filter("name <> '' and native is not null").distinct()
    long = queries.filter(F.length("q") >= 3)
    begun = ex.select(F.explode(_beginnings("name", 3)).alias("q"), F.col("native").alias("v"))
    begun = _meet(begun, long, "q", False).select("q", "v")
    cut = long.select("q", F.explode(_beginnings("q", 1)).alias("name"))
    cut = _meet(cut, ex, "name", False)
    longer = cut.select("q", F.concat("native", F.substring(F.col("q"), F.length("name") + 1, F.length("q"))).alias("v"))
    return queries.select("q", F.col("q").alias("v")).union(begun).union(longer).distinct()


def search_all(stations: DataFrame, searches: DataFrame, exonyms: DataFrame, limit: int = 10, reach: DataFrame | None = None) -> DataFrame:
    """search_id, rank, id, name, tier, n_dest: the best stations of each search (search_id, query): beginnings (tier 0)
    before names that hold it (1), then capitals, most destinations, short names, least ids. stations: id, name,
    is_capital, n_dest, ids are unique; only those of reach (id) if it is given. Rows of searches that share an id
    each give their own rows."""
    if not 1 <= limit <= MOST:
        raise ValueError(f"a search gives 1 to {MOST} stations, not {limit}")
    rows = _meet(stations, reach.select("id").distinct(), "id", False, "left_semi") if reach is not None else stations
    rows = rows.select("id", "name", "n_dest", search_name(F.col("name")).alias("norm"), F.when(F.col("is_capital"), 0).otherwise(1).alias("off"), (-F.coalesce("n_dest", F.lit(0))).alias("less")).filter("norm is not null")
    rows = written(_best(rows.withColumn("size", F.length("norm")), "norm", _ORDER, limit), "search-names")
    # the best stations of a query are among those of the names whose best stations are best
    names = rows.filter("rank = 1").select("norm", *_ORDER)
    asked = searches.select("search_id", search_name(F.col("query")).alias("q")).filter("q is not null")
    forms = written(variants(asked.select("q").distinct(), exonyms), "search-forms")
    wanted = forms.select("v").distinct()
    few = limit * (forms.agg(F.sum(F.length("v") + 1)).first()[0] or 0) <= SENT

    begun = names.select("norm", *_ORDER, F.explode(_beginnings("norm", 0)).alias("v"))
    begun = _best(_meet(begun, wanted, "v", few), "v", _ORDER, limit) if few else _meet(_best(begun, "v", _ORDER, limit), wanted, "v", few)
    begun = written(begun.withColumn("tier", F.lit(0)), "search-begun")
    filled = begun.filter(F.col("rank") == limit).select("v")
    open_ = _meet(wanted, filled, "v", few, "left_anti").filter("v <> ''")
    part = F.pmod(F.xxhash64("norm"), F.lit(1 if few else 1 + names.count() // SLICE)).alias("part")
    sizes = F.array(*[F.lit(k) for k in range(1, GRAM + 1)])
    postings = names.select("norm", *_ORDER, part, F.explode(F.flatten(F.transform(sizes, lambda k: _grams("norm", k)))).alias("gram"))
    parts = open_.select("v", F.explode(_grams("v", F.least(F.length("v"), F.lit(GRAM)))).alias("gram"))
    cells = postings.groupBy("gram", "part").agg(F.count("*").alias("n"))  # ahead of the join, so that common letters are few rows
    cells = written(_meet(cells, parts.select("gram").distinct(), "gram", few, "left_semi"), "search-cells")
    often = cells.groupBy("gram").agg(F.sum("n").alias("n"))
    rarest = _meet(parts, often, "gram", few, "left").groupBy("v").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("m")).select("v", "m.gram")
    met = _meet(rarest, cells.select("gram", "part"), "gram", few)
    held = _meet(postings, met, ["gram", "part"], few).filter(F.contains("norm", F.col("v")) & ~F.startswith("norm", F.col("v")))
    held = _best(held.drop("gram", "part"), "v", _ORDER, limit).withColumn("tier", F.lit(1))

    found = _meet(begun.unionByName(held).select("v", "norm", "tier"), rows.drop("rank"), "norm", False)
    found = _best(found, "v", ("tier", *_ORDER), limit).drop("rank", "norm")
    own = _meet(found, forms, "v", few).groupBy("q", "off", "less", "size", "id").agg(F.min("tier").alias("tier"), F.min("name").alias("name"), F.min("n_dest").alias("n_dest"))
    own = _best(own, "q", ("tier", *_ORDER), limit)
    return _meet(asked, own, "q", few).select("search_id", "rank", "id", "name", "tier", "n_dest")

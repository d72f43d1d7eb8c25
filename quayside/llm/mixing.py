"""Mixing sources to target weights by hash-threshold histograms. Native: SQL functions only.

A source is taken floor(target / size) times whole, and what is left of its target is a hash threshold:
words are summed by source and hash bucket, the bucket where the running sum crosses the budget is the
boundary, and only the boundary is summed again on the next bits of the hash. Documents whose hash is
under the threshold are taken once more. Thresholds of smaller budgets nest in those of larger ones,
no document is sorted, and a filter applies the mix. The hash is of doc_id and text, so rows that share an id
part; rows that repeat both have one hash, and where it is the boundary as many of them are taken as the budget
holds, by their number among each task's equal rows.

Cases: null and empty texts have size 0 and are taken with 0 words, at most `most` times; a null source is the
last source; a null doc_id is hashed as "-"; sources of equal size and weight are capped in the order of their
names; repeated rows can't be told apart, so whichever are taken the result is the same; long texts are
counted whole; other columns are ignored and may have any name; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quayside.llm.common import WORD_RE, id_hash, running_sums, sent_if_small, written

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BITS = 12
#: Up to so many sources their thresholds are broadcast; beyond, they are joined by shuffle.
SENT_SOURCES = 50_000
LEVELS = 3  # 36 bits of the hash; a last cell then holds about one document of 10**11


def hash_of(doc_id: Column, text: Column) -> Column:
    return F.shiftright(id_hash(doc_id, F.md5(F.coalesce(text, F.lit("")))), 60 - BITS * LEVELS)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and a 36-bit hash: the narrow table that all passes read."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_RE)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), hash_of(F.col("doc_id"), F.col("text")).alias("h"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """source, source_size, weight, target: weights' shares of all words, capped, the excess reshared.

    Resharing ends where the uncapped sources get one price a weight; sources are capped in the order of
    cap / weight, so one running sum over the sources finds it."""
    by = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mixing-sources")  # a row for each source
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    by = running_sums(by, [F.col("source").asc_nulls_last()], {"place": F.lit(1).cast("long")}).select("source", "source_size", "place")
    # place is the number of sources before
    by = by.withColumn("weight", weight)
    rise = [(F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    by = running_sums(by.drop("place"), rise, {"capped": F.col("source_size"), "capped_weights": F.col("weight")})
    by = by.withColumn("capped", most * F.col("capped"))
    all_ = by.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights"))
    by = written(by.join(F.broadcast(all_), F.lit(True)), "mixing-shares")  # one row
    left, weight_left = F.col("words") - F.col("capped"), F.col("weights") - F.col("capped_weights")
    # a source is capped if its share at this price is above its cap; all after the first uncapped one are uncapped
    by = by.withColumn("above", F.col("weight") * left > most * F.col("source_size") * weight_left)
    first = by.agg(F.min(F.when(~F.col("above"), F.struct(F.col("source_size") / F.col("weight"), F.col("capped"), F.col("capped_weights")))).alias("first"))
    by = by.join(F.broadcast(first), F.lit(True))  # one row
    share = (F.col("words") - F.col("first.capped")).cast("double") * F.col("weight") / (F.col("weights") - F.col("first.capped_weights"))
    return by.select("source", "source_size", "weight", F.when(F.col("above"), (most * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """source, repeats, the hash threshold below which documents are taken once more, and tied: of the rows with that
    very hash, where there are several, how many are."""
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = goals.withColumn("repeats", times.cast("long")).withColumn("budget", F.col("target") - F.col("repeats") * F.col("source_size"))
    none = F.lit(0).cast("long")
    state = written(state.select("source", "source_size", "target", "repeats", "budget", none.alias("prefix"), none.alias("tied"), F.lit(False).alias("done")), "mixing-goals")
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        cell = F.shiftright("h", shift)
        # sums of the boundary's cells: at most 2 ** BITS rows a source
        inside = sizes.join(sent_if_small(state.select(F.col("source").alias("s"), "prefix", "done"), SENT_SOURCES), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + BITS) == F.col("prefix")) & ~F.col("done"))
        sums = inside.groupBy("source", cell.alias("cell")).agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
        run = W.partitionBy("source").orderBy("cell")
        sums = sums.withColumn("below", F.sum("n").over(run) - F.col("n"))
        held = state.select(F.col("source").alias("s"), "budget")
        crossing = sums.join(sent_if_small(held, SENT_SOURCES), F.col("source").eqNullSafe(F.col("s"))).filter((F.col("below") <= F.col("budget")) & (F.col("below") + F.col("n") > F.col("budget")))
        edge = crossing.groupBy(F.col("source").alias("es")).agg(F.min(F.struct("cell", "below", "n", "rows")).alias("e"))
        state = state.join(edge, F.col("source").eqNullSafe(F.col("es")), "left")
        last = level == LEVELS
        left = F.col("budget") - F.col("e.below")
        tied = F.when(F.col("e.rows") > 1, F.round(left * F.col("e.rows") / F.col("e.n"))).otherwise(0).cast("long") if last else none
        over = (F.col("e.rows") == 1) & (F.col("e.n") - left < left)  # a single row is taken if that is nearer
        prefix = F.when(F.col("done") | F.col("e").isNull(), F.col("prefix") if level == 1 else F.col("prefix") * (1 << BITS)).otherwise(F.col("e.cell") + (F.when(over, 1).otherwise(0) if last else 0))
        state = state.select("source", "source_size", "target", "repeats", (F.col("budget") - F.coalesce("e.below", F.lit(0))).alias("budget"), prefix.alias("prefix"), F.coalesce(tied, none).alias("tied"), (F.col("done") | F.col("e").isNull()).alias("done"))
        state = written(state, f"mixing-level{level}")  # a row for each source
    return state.select("source", "source_size", "target", "repeats", F.col("prefix").alias("threshold"), "tied")


def with_copies(rows: DataFrame, sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """rows (source, h and others) with copies, source_size and target."""
    found = written(thresholds(sizes, targets(sizes, weights, most)), "mixing-limits").withColumnRenamed("source", "limit_source")
    met = rows.join(sent_if_small(found, SENT_SOURCES), F.col("source").eqNullSafe(F.col("limit_source")))
    once_more = F.col("h") < F.col("threshold")
    if not found.filter("tied > 0").isEmpty():
        # rows with the boundary's hash are numbered: in their task, after those of the tasks before
        met = written(met.withColumn("task", F.spark_partition_id()), "mixing-met")
        at_edge = met.filter((F.col("h") == F.col("threshold")) & (F.col("tied") > 0))
        counts = at_edge.groupBy("source", "h", "task").agg(F.count("*").alias("c"))  # a row for each task and such source
        before = F.sum("c").over(W.partitionBy("source", "h").orderBy("task")) - F.col("c")
        counts = counts.select(F.col("source").alias("c_source"), F.col("h").alias("c_h"), F.col("task").alias("c_task"), before.alias("before"))
        own = F.row_number().over(W.partitionBy("source", "h", "task").orderBy(F.lit(1)))
        numbered = at_edge.withColumn("own", own).join(counts, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("h") == F.col("c_h")) & (F.col("task") == F.col("c_task")))
        taken = numbered.withColumn("extra", F.col("before") + F.col("own") <= F.col("tied")).drop("own", "c_source", "c_h", "c_task", "before")
        others = met.filter(~((F.col("h") == F.col("threshold")) & (F.col("tied") > 0))).withColumn("extra", once_more)
        met = others.unionByName(taken).drop("task")
    else:
        met = met.withColumn("extra", once_more)
    copies = F.least(F.lit(most), F.col("repeats") + F.when(F.col("extra"), 1).otherwise(0)).cast("int")
    return met.withColumn("copies", copies).drop("limit_source", "repeats", "threshold", "tied", "extra")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken."""
    sizes = written(sized(docs), "mixing-sizes")
    joined = with_copies(sizes, sizes, weights, most)
    return joined.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """The mix itself: the rows of docs, each as many times as it is taken."""
    sizes = written(sized(docs), "mixing-sizes")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumns({"source": F.col("row.source"), "h": hash_of(F.col("row.doc_id"), F.col("row.text"))})
    times = with_copies(rows, sizes, weights, most).filter("copies > 0")
    return times.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")

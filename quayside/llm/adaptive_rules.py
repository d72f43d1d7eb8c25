"""Quality rules with adaptive thresholds. Native: SQL functions only.

Four measures of each text are sketched for every language and source in mergeable quantile sketches, and a
group's own quantiles are its fences. Measures that vary in any prose (the share of signs among the characters of words, and
words' mean length, the latter on both sides) are fenced FENCE interquartile ranges beyond the quartile; measures that are zero in most
texts (repeated lines and words) at TAIL times the 99th percentile. No fixed cut-off and no least spread decides: a group
of fewer than LEAST_ROWS rows, or one whose sketch says nothing of a measure (no range between its quartiles, a 99th percentile of zero), takes
the fence of its language's merged sketches, then of all; where these say nothing either, there is none. The fences
are joined back, and a text outside any fence of its group goes.

Sketches hold up to SKETCH values of a group exactly; beyond, ranks are off by about 0.1 % of a group's rows (at most 0.2 % in the test of 60,000).

Cases: null and empty texts have no words and fail the base; null language and source are groups of their
own; repeated rows are judged each; a measure at its fence is within; long texts are read whole, in memory of their words
and one hash a word; other columns are ignored and may have any name; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quayside.llm.common import SPACE_CHARS, sent_if_small, words_of, written

SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
REPEAT_PERCENT = 30
#: Characters of words that are no letters or digits, in ASCII.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Interquartile ranges beyond a quartile, and times the 99th percentile.
FENCE, TAIL = 5.0, 2.0
LEAST_ROWS = 50
SENT_GROUPS = 100_000
#: Items of a sketch's level; up to so many values of a group are held exactly.
SKETCH = 4096
#: Measures with a range of their own, those that are mostly zero, and those that are fenced below, too.
RANGED, RARE = ("sign_rate", "word_length"), ("dup_line_rate", "repeat_rate")
MEASURES = ("sign_rate", "dup_line_rate", "repeat_rate", "word_length")
TWO_SIDED = ("word_length",)


def measured(docs: DataFrame) -> DataFrame:
    """uid, doc_id, lang, source and the base counts of every text."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "lang", "source", text.alias("text"), words_of("text").alias("w"), lines.alias("lines"))
    # the generator keeps the hashes from being computed for each use; only texts that repeat one hold on to them
    hashes = F.when(F.size("w") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("w", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select("*", F.explode(F.array(hashes)).alias("hashes"))
    return rows.select(
        "uid", "doc_id", "lang", "source",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.translate("text", SIGNS, ""))).cast("long").alias("n_signs"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.col("hashes")).alias("windows"),
    )


def repeat_words(rows: DataFrame) -> DataFrame:
    """uid and the number of words in windows found twice or more, of texts that have such a window."""
    some = rows.filter("windows is not null").select("uid", F.posexplode("windows").alias("pos", "h"))
    twice = some.withColumn("n", F.count("*").over(W.partitionBy("uid", "h"))).filter("n > 1")
    after = F.lead("pos").over(W.partitionBy("uid").orderBy("pos"))
    return twice.withColumn("own", F.least(F.lit(WINDOW), F.coalesce(after - F.col("pos"), F.lit(WINDOW)))).groupBy("uid").agg(F.sum("own").cast("long").alias("n_repeat_words"))


def with_measures(rows: DataFrame) -> DataFrame:
    words = F.greatest("n_words", F.lit(1))
    return rows.withColumns({
        "sign_rate": F.col("n_signs") / F.greatest(F.col("word_chars"), F.lit(1)),
        "dup_line_rate": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_rate": F.col("n_repeat_words") / words,
        "word_length": F.col("word_chars") / words,
    })


def fences(rows: DataFrame) -> DataFrame:
    """A row for each language and source with its fences, from sketches that are merged upwards for small groups."""
    sketches = {m: F.expr(f"kll_sketch_agg_double({m}, {SKETCH})") for m in MEASURES}
    low = rows.groupBy("lang", "source").agg(F.count("*").alias("n"), *[s.alias(m) for m, s in sketches.items()])
    low = written(low, "rules-sketches")  # a row for each group
    up = {m: F.expr(f"kll_merge_agg_double({m})") for m in MEASURES}
    mid = low.groupBy("lang").agg(F.sum("n").alias("n"), *[s.alias(m) for m, s in up.items()])
    top = low.agg(F.sum("n").alias("n_top"), *[s.alias(f"{m}_top") for m, s in up.items()])
    mid = mid.select(F.col("lang").alias("mid_lang"), F.col("n").alias("n_mid"), *[F.col(m).alias(f"{m}_mid") for m in MEASURES])
    all_ = low.join(mid, F.col("lang").eqNullSafe(F.col("mid_lang")), "left").join(F.broadcast(top), F.lit(True), "left")  # one row

    def fence(m: str, side: int) -> Column:
        out = F.lit(None).cast("double")
        for sketch, n in ((f"{m}_top", None), (f"{m}_mid", "n_mid"), (m, "n")):  # the last that says something is first
            q = lambda p: F.call_function("kll_sketch_get_quantile_double", F.col(sketch), F.lit(p).cast("double"))  # noqa: B023, E731
            if m in RANGED:
                says, at = q(0.75) > q(0.25), q(0.5 + 0.25 * side) + side * FENCE * (q(0.75) - q(0.25))
            else:
                says, at = q(0.99) > 0, TAIL * q(0.99)
            out = F.when(says & (F.lit(True) if n is None else F.col(n) >= LEAST_ROWS), at).otherwise(out)
        return out

    return all_.select(F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), *[fence(m, 1).alias(f"{m}_high") for m in MEASURES], *[fence(m, -1).alias(f"{m}_low") for m in TWO_SIDED])


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and kept."""
    rows = written(measured(docs), "rules-measured")
    repeats = repeat_words(rows.select("uid", "windows"))
    rows = rows.drop("windows").join(repeats, "uid", "left").withColumn("n_repeat_words", F.coalesce("n_repeat_words", F.lit(0).cast("long")))
    rows = written(with_measures(rows), "rules-rows")
    limits = sent_if_small(written(fences(rows), "rules-fences"), SENT_GROUPS)
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")))
    within = F.lit(True)
    for m in MEASURES:
        # a fence that is null is none
        within = within & F.coalesce(F.col(m) <= F.col(f"{m}_high"), F.lit(True))
        within = within & F.coalesce(F.col(m) >= F.col(f"{m}_low"), F.lit(True)) if m in TWO_SIDED else within
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & within).alias("kept"), *MEASURES)

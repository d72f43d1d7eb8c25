"""Fingerprints by Order MinHash. Native: SQL functions only.

A text's word k-mers are numbered by occurrence, so that repeats count, and each (k-mer, number) is hashed
once. The hash's last bits deal them into 2 * SKETCHES cells (one permutation in place of one for each
sketch); every cell selects its minimal k-mer, two neighbouring cells form a sketch, their k-mers are put
in the order they have in the text, and the pair is hashed. Two texts agree in a sketch if the same k-mers
were selected and stand in the same order, so the share of equal sketches follows edit distance.

A word of over LONG_WORD characters, as texts without spaces are, is cut after each character of a fixed quarter of
the characters, or after LONG_WORD others: the cuts depend on what stands there, so an edit moves only those near it.

The k-mers of a document stay in the task that explodes it: documents are dealt by key once, and numbering
and selection keep that partitioning. The next document is found on a narrow table of keys.

Cases: null and empty texts, and texts without words, have the empty fingerprint; two such texts are alike
to 1, one such and another to 0; rows with equal doc_id are ordered by their texts' hashes; a null doc_id
comes last; equal rows stand at one place of the order and each of them is returned; long texts
are read whole, a row for each k-mer; other columns are ignored and may have any name; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quayside.llm.common import SPACE_RE, repeated, sent_if_small, written

K = 2
SKETCHES = 64
LONG_WORD = 24
HASH_BITS = 26
#: Up to so many documents the table of next documents is broadcast; beyond, texts are joined by shuffle.
SENT_ROWS = 2_000_000


def _cut_pattern() -> str:
    """A stretch that ends in a cutting character: of Latin-1 every fourth, else the third quarter of each 128 code points."""
    latin = "".join(f"\\x{c:02x}" for c in range(0x21, 0x100, 4))
    others = "".join(f"\\u{c:04x}-\\u{c + 31:04x}" for c in range(0x140, 0x10000, 128) if not 0xD7E0 <= c < 0xE000)
    return f"(?s)(.{{0,{LONG_WORD - 1}}}?[{latin}{others}]|.{{{LONG_WORD}}})"


CUT = _cut_pattern()


def tokens_of(text: Column) -> Column:
    """Words of a text, long ones as their parts."""
    words = F.filter(F.split(text, SPACE_RE), lambda w: w != "")
    parts = lambda w: F.filter(F.split(F.regexp_replace(w, CUT, "$1 "), " "), lambda x: x != "")
    several = F.flatten(F.transform(words, lambda w: F.when(F.length(w) > LONG_WORD, parts(w)).otherwise(F.array(w))))
    return F.when(F.rlike(text, F.lit(f"[^\\x20\\x09-\\x0D]{{{LONG_WORD + 1}}}")), several).otherwise(words)


def fingerprints(texts: DataFrame, *keys: str) -> DataFrame:
    """keys and fp, of texts (keys, text): a sorted array of one number for each sketch that has k-mers, its
    place in the upper 6 of 32 bits and its hash in the lower. Texts without words have no row."""
    # the generator keeps the words from being split anew for each k-mer
    w = texts.select(*keys, F.explode(F.array(tokens_of(F.col("text")))).alias("w"))
    last = F.greatest(F.size("w") - (K - 1), F.least(F.size("w"), F.lit(1)))
    grams = w.select(*keys, F.transform(F.slice(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), F.lit(1), last), lambda i: F.xxhash64(F.slice("w", i, K))).alias("g"))
    rows = grams.select(*keys, F.posexplode("g").alias("pos", "gram"))
    numbered = rows.withColumn("nth", F.row_number().over(W.partitionBy(*keys, "gram").orderBy("pos")))
    hashed = numbered.select(*keys, "pos", F.xxhash64("gram", "nth").alias("h"))
    sketch = F.pmod("h", F.lit(SKETCHES)).cast("int").alias("sketch")
    first = F.when(F.shiftright("h", 32).bitwiseAND(F.lit(1)) == 0, F.col("h"))
    second = F.when(F.shiftright("h", 32).bitwiseAND(F.lit(1)) == 1, F.col("h"))
    least = hashed.groupBy(*keys, sketch).agg(F.min(first).alias("h1"), F.min_by("pos", first).alias("p1"), F.min(second).alias("h2"), F.min_by("pos", second).alias("p2"))
    none = F.lit(0).cast("long")
    a, b = F.coalesce("h1", none), F.coalesce("h2", none)
    pair = F.when(F.col("p2") < F.col("p1"), F.xxhash64(b, a)).otherwise(F.xxhash64(a, b))
    value = (F.shiftleft(F.col("sketch").cast("long"), HASH_BITS).bitwiseOR(pair.bitwiseAND(F.lit((1 << HASH_BITS) - 1))) - (1 << 31)).cast("int")
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("fp"))  # SKETCHES numbers at most


def text_form(fp: Column) -> Column:
    """A fingerprint as hexadecimal digits, eight for each sketch; empty for a text without words."""
    return F.coalesce(F.lower(F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x.cast("long") + (1 << 31)), 8, "0")), "")), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal sketches among those that either text has."""
    place = lambda x: F.transform(x, lambda v: F.shiftright(v, HASH_BITS))
    some = F.size(F.array_union(place(a), place(b)))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(F.size(F.array_intersect(a, b)) / some)


def next_rows(rows: DataFrame) -> DataFrame:
    """key and next_key of rows (key, doc_id, th) by descending doc_id; the last is followed by the first.

    Range partitions are numbered and written; in each, a window finds the next row, and the first row of
    the following partition is handed over through a table with a row for each partition."""
    order = [F.col("doc_id").desc_nulls_last(), F.col("th").asc()]
    ranged = rows.select("key", "doc_id", "th").repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "order-parts")
    inside = W.partitionBy("part").orderBy(*order)
    placed = ranged.withColumn("next_key", F.lead("key").over(inside)).withColumn("first", F.row_number().over(inside) == 1)
    placed = written(placed.select("key", "next_key", "part", "first"), "order-next")
    heads = placed.filter("first").select("part", F.col("key").alias("head"))  # a row for each partition
    whole = W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    heads = heads.withColumn("after", F.coalesce(F.lead("head").over(W.orderBy("part")), F.first("head").over(whole)))
    return placed.join(heads.select("part", "after"), "part").select("key", F.coalesce("next_key", "after").alias("next_key"))


def with_edits(docs: DataFrame, follow: DataFrame) -> DataFrame:
    """key, n_chars, text and the edited text of docs (key, n_chars, text), dealt by key.

    Each document gives the one before it as much of its text as that one needs. All uses read one exchange of the texts."""
    wanted = follow.select(F.col("next_key").alias("giver"), F.col("key").alias("taker"), F.floor(F.col("n_chars") / 3).cast("int").alias("need"))
    given = docs.join(sent_if_small(wanted, SENT_ROWS), F.col("key") == F.col("giver")).select("taker", F.substring(F.col("text"), F.lit(1), F.col("need")).alias("gift"))
    keep = (F.col("n_chars") - F.floor(F.col("n_chars") / 3)).cast("int")
    joined = docs.join(given, F.col("key") == F.col("taker"))
    return joined.select("key", "n_chars", "text", F.concat(F.substring(F.col("text"), F.lit(1), keep), "gift").alias("edited"))


def compare(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    own = own.withColumn("key", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("th"))).withColumn("n_chars", F.length("text").cast("long"))
    narrow = written(own.groupBy("key", "doc_id", "th", "n_chars").agg(F.count("*").alias("copies")), "order-keys")
    follow = written(next_rows(narrow).join(narrow.select("key", "doc_id", "n_chars", "copies"), "key"), "order-follow")
    own = own.select("key", "n_chars", "text")
    once = follow.filter("copies > 1").isEmpty()
    if not once:
        own = own.dropDuplicates(["key"])
    edits = with_edits(own, follow)
    both = edits.select("key", F.explode(F.array(F.struct(F.lit(0).alias("which"), "text"), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))).alias("t")).select("key", "t.which", "t.text")
    fps = fingerprints(both, "key", "which").groupBy("key").agg(F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("efp"))
    rows = edits.select("key", F.sha2("edited", 256).alias("edited_sha256")).join(fps, "key", "left")
    rows = written(rows, "order-fingerprints")
    after = rows.select(F.col("key").alias("next_key"), F.col("fp").alias("next_fp"))
    out = rows.join(follow, "key").join(after, "next_key")
    out = out if once else repeated(written(out, "order-out"), "copies", "copy")
    return out.select("doc_id", "n_chars", "edited_sha256", text_form(F.col("fp")).alias("fingerprint"), text_form(F.col("efp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))

"""Near duplicates by MinHash with tensored banding, links confirmed on whole sets.

A table of a banded index needs a key of several minhashes, and many tables are needed so that no link is
missed. Here two collections of GROUPS groups hold HALF minhashes each, and the keys of the GROUPS * GROUPS tables are all pairs
of a group of one and a group of the other: 2 * GROUPS * HALF minhashes in place of GROUPS * GROUPS * 2 * HALF.
Documents of similarity J share an entry unless one of the collections has no equal group, so they are missed with a probability of at
most 2 * (1 - J ** HALF) ** GROUPS: 2e-5 at J = 0.85, 7e-7 at 0.9.

Groups' hashes are made in the one pass over texts that makes the sets' keys; tables are made of them by
column expressions, for one document of each class of equal sets. What shares an entry is verified on whole sets, in rounds of leaders and then in
blocks (see jaccard), so a large group of near copies costs rows in proportion to its sets.

Cases: null and empty texts, and texts without words, have no shingles and are kept, linked with nothing; fewer words
than WIDTH are one shingle; equal rows are copies of each other, and all rows of the least doc_id are kept; a document without doc_id takes part, its component is
null if nothing else is in it, and it is kept then; long texts are read whole, in memory of some 100 bytes a word; other
columns are ignored and may have any name; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.llm.common import delete, scratch, tidy, written
from quayside.llm.jaccard import NARROW, Sets, _over, mix, set_keys, shingles

WIDTH = 5
PERCENT = 85
#: Groups of a collection, and minhashes of a group.
GROUPS, HALF = 9, 2
#: Shingles whose minhashes are computed at once.
STEP = 4096

KEYS = T.StructType([*NARROW.fields, T.StructField("halves", T.ArrayType(T.LongType()))])


def multipliers(count: int):
    """(odd factors, offsets) of that many hash functions, the same in every worker."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:count] | np.uint64(1), x[count:]


def minhashes(toks, factors, offsets):
    """Least value of each hash function over a set."""
    import numpy as np

    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(toks), STEP):
        least = np.minimum(least, (toks[None, k : k + STEP] * factors[:, None] + offsets[:, None]).min(1))
    return least


def halves(toks, groups: int, half: int):
    """Hashes of the groups of the first collection, then of the second."""
    import numpy as np

    if not len(toks):
        return np.empty(0, np.int64)
    least = mix(minhashes(toks, *multipliers(2 * groups * half))).reshape(2 * groups, half)
    out = np.arange(2 * groups, dtype=np.uint64)
    for k in range(half):
        out = mix(out * np.uint64(0xA0761D6478BD642F) + least[:, k])
    return out.view(np.int64)


def hashed(docs: DataFrame, width: int, groups: int, half: int) -> DataFrame:
    """doc_id, did, n, k1, k2 and the groups' hashes of every document."""

    def one(doc_id, did, text):
        toks = shingles(text, width)
        return (doc_id, did, len(toks), *set_keys(toks), halves(toks, groups, half))

    return _over(docs, one, KEYS)


def tables(rows: DataFrame, groups: int) -> DataFrame:
    """sig and rep: entries of all tables, a pair of groups each."""
    numbers = lambda low: F.sequence(F.lit(low), F.lit(low + groups - 1))
    pairs = F.flatten(F.transform(numbers(0), lambda i: F.transform(numbers(groups), lambda j: F.xxhash64(F.get("halves", i), F.get("halves", j)))))
    return rows.select("rep", F.explode(pairs).alias("sig"))


def dedup(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, groups: int = GROUPS, half: int = HALF) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and class_id (least doc_id with the same set)."""
    with scratch(docs.sparkSession) as made:
        out = written(_deduped(docs, width, percent, groups, half), "tensor-result")
    delete(docs.sparkSession, made[:-1])  # all but the result
    return out


def _deduped(docs: DataFrame, width: int, percent: int, groups: int, half: int) -> DataFrame:
    rows = written(hashed(docs, width, groups, half), "tensor-hashed")
    sets = Sets(docs, rows.drop("halves"), width, percent)
    # of equal sets, one document's groups
    one = rows.join(sets.classes.select(F.col("rep").alias("did"), "k1"), ["did", "k1"]).select(F.col("did").alias("rep"), "halves")
    one = one if sets.unique else one.dropDuplicates(["rep", "halves"])
    same = W.partitionBy("sig")
    entries = tables(one, groups).select("sig", "rep", F.min("rep").over(same).alias("low"), F.max("rep").over(same).alias("high"))
    members = written(entries.filter("low < high").select("sig", "rep").distinct(), "tensor-members")
    tidy(docs.sparkSession)
    out = sets.result(sets.components(members))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "class_id")

"""Exact Jaccard links and components over word shingles by universe partitioning.

Sets of shingles are put in size bands such that linked sets lie in one band or in neighbouring ones. For
a band the largest symmetric difference H of a link is known, so the universe of shingles is cut by hash
into segments: if k1 segments are compared as they are and k2 by their one-deletion neighbourhoods, with
k1 + 2 * k2 = H + 1 + spare, the segments in which a link agrees weigh over `spare` (a segment that differs costs one
difference, one whose neighbourhoods are disjoint costs two). Segments without tokens agree by chance, so a set
whose empty segments weigh at most `spare` leaves them out of the index: some other one must agree. Only sets with
more of them index these too. spare and k2 are chosen for each band by cost: rows of the index against the
candidates that chance agreement of empty segments would give among the band's sets.

Sets in one index entry are compared with the entry's leader, all links found so far are closed to
components, and entries that still hold several components are compared again with another leader. What is
then still open is compared in blocks of bounded size, each set outside its group's main component with all
sets of the group, and only links that join something are kept. Before whole sets are fetched for a pair, its sketches are compared: they hold how many shingles fall
in each of SKETCH cells, and sets that differ by more than a link allows in these counts can't link. Pairs inside a component can't change
components, so they are left out here, and no component is missed. A leader that many sets meet is dealt out with them by hash, so no leader's sets stand in one task.

Links are counted once the components are known, since no link leaves one: all sets of a component are compared,
in one place if they are few, else in pairs of blocks whose sizes allow links. A task multiplies the incidence of two blocks and gives
back one count for each set, so that no row for a pair is made, whatever a component's links. A component of N sets beyond a
block is copied N / BLOCK times at most. Equal sets are one set throughout. Links are decided exactly on the 64-bit hashes of whole sets.

Cases: null and empty texts, and texts without words, have no shingles and link with nothing; fewer words
than WIDTH are one shingle; equal rows are copies of each other; a document without doc_id takes part and
its component is null if nothing else is in it; long texts are read whole, in memory of some 100 bytes a word; other
columns are ignored and may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.llm import worker
from quayside.llm.common import delete, scratch, sent_if_small, tidy, written

WIDTH = 3
PERCENT = 90
#: Greatest over least size of a band. A set stands in its own band's instance and, near its lower end, in that below; at 1.5 both together take about the least rows.
BAND = 1.5
#: Rows of the index that verifying one candidate is worth.
VERIFY = 50
#: Sets that meet one leader in one task.
SPLIT = 500
LEADER_ROUNDS = 2
#: Groups of at most so many sets are compared pair by pair, larger ones in blocks.
SMALL_GROUP = 12
#: Sets of a block, and shingles of a block of whole sets.
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000
#: Bits of a set's cell; counts above 127 are held as 127, which can only hide differences.
SKETCH_BITS = 9
#: Most words kept by a worker, and their greatest length: under 100 MB whatever the texts are.
CACHE_WORDS, LONG_WORD = 200_000, 64
#: Up to so many sets that need verifying, their ids are broadcast to find their texts; beyond, texts are joined by shuffle.
SENT_IDS = 4_000_000
#: Up to so many groups, what holds of each is broadcast to its rows, so that a hot one needn't meet in a task.
SENT_GROUPS = 1_000_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONG_WORD:
            self[word] = h
        return h


def mix(x):
    """Scrambles unsigned 64-bit numbers one to one."""
    import numpy as np

    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, width: int = WIDTH):
    """Sorted distinct hashes of the text's shingles."""
    import numpy as np

    known = worker.table("shingles", WordHashes, CACHE_WORDS)
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(width, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = out * np.uint64(0xA0761D6478BD642F) + h[k : len(h) - width + 1 + k]
    return np.unique(mix(out))


def band_limits(most: int) -> list[tuple[int, int]]:
    """Least and greatest size of each band, up to the one that holds `most`."""
    bands, low = [], 1
    while low <= most:
        high = int(low * BAND)
        bands.append((low, high))
        low = high + 1
    return bands


def differences(high: int, percent: int) -> int:
    """Largest symmetric difference of a set of at most `high` shingles and a linked set that is not smaller.

    For sizes a <= b, 100 * common >= percent * union gives a difference of at most (a + b) * (100 - percent) / (100 +
    percent), and b is at most 100 * a / percent."""
    return high * (100 - percent) // percent


def instances(size: int, bands: list[tuple[int, int]], percent: int) -> list[int]:
    """Numbers of the instances in which a set of that size stands: its own band's, and the one below if a set of that may link."""
    import bisect

    j = bisect.bisect_right([b[0] for b in bands], size) - 1
    return [j - 1, j] if j and percent * size <= 100 * bands[j - 1][1] else [j]


def allocation(low: int, high: int, sets: int, percent: int) -> tuple[int, int, int]:
    """(k1, k2, spare): segments compared as they are, those by one-deletion neighbourhoods, and what empty segments may weigh."""
    need = differences(high, percent) + 1
    best = (math.inf, (need, 0, 0))
    for k2 in sorted({*range(min(need // 2, 16) + 1), need // 4, need // 2}):
        for spare in sorted({*range(9), *(need * x // 40 for x in range(21))}):
            k1 = need + spare - 2 * k2
            if k1 < 0:
                continue
            m = k1 + k2
            full, least = high / m, low / m
            # weights of empty segments of the least sets, as if normal
            empty, lone = math.exp(-least), math.exp(-least) * (1 + least)
            mean = k1 * empty + 2 * k2 * lone
            spread = math.sqrt(k1 * empty * (1 - empty) + 4 * k2 * lone * (1 - lone))
            over = 0.5 * math.erfc((spare + 0.5 - mean) / max(spread, 1e-9) / math.sqrt(2))
            rows = sets * (m + k2 * full)
            chance = (over * sets) ** 2 / 2 * (k1 * empty**2 + k2 * lone**2)
            best = min(best, (rows + VERIFY * chance, (k1, k2, spare)))
    return best[1]


def signatures(tokens, instance: int, k1: int, k2: int, spare: int):
    """Index entries of a set in one instance: its segments' subsets, and of the last k2 segments also each subset less one
    token. Those of no token are left out unless they weigh over `spare`."""
    import numpy as np

    m = k1 + k2
    seg = (mix(tokens ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(m)).astype(np.int64)
    value = mix(tokens + np.uint64(0x2545F4914F6CDD1D))
    order = np.argsort(seg, kind="stable")
    seg, value = seg[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
    held, sums = seg[first], np.add.reduceat(value, first)
    salt = mix(held.astype(np.uint64) + np.uint64(instance << 32))
    out = [mix(sums ^ salt)]
    weight = k1 - int((held < k1).sum())  # of empty segments
    if k2:
        size = np.diff(np.concatenate([first, [len(seg)]]))
        weight += 2 * (k2 - int((size[held >= k1] > 1).sum()))
        of = np.repeat(np.arange(len(held)), size)
        late = (seg >= k1) & (size[of] > 1)
        out.append(mix((sums[of[late]] - value[late]) ^ salt[of[late]]))
    if weight > spare:
        bare = np.ones(m, bool)
        bare[held[held < k1]] = False
        if k2:
            bare[held[(held >= k1) & (size > 1)]] = False
        out.append(mix(mix(np.flatnonzero(bare).astype(np.uint64) + np.uint64(instance << 32))))
    return np.unique(np.concatenate(out))


NARROW = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "did", "n", "k1", "k2")])
ENTRIES = T.StructType([T.StructField("sig", T.LongType()), T.StructField("k1", T.LongType())])
MARKS = T.StructType([T.StructField("did", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sketch", T.ArrayType(T.ByteType()))])
TOKENS = T.StructType([*MARKS.fields[:3], T.StructField("toks", T.ArrayType(T.LongType()))])


def sketch(toks):
    """Number of a set's shingles in each cell."""
    import numpy as np

    cell = (mix(toks ^ np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
    return np.minimum(np.bincount(cell, minlength=1 << SKETCH_BITS), 127).astype(np.int8)


def set_keys(toks) -> tuple[int, int]:
    import numpy as np

    if not len(toks):
        return 0, 0
    a = mix(toks + np.uint64(1)).sum(dtype=np.uint64)
    b = np.bitwise_xor.reduce(mix(toks ^ np.uint64(0xC2B2AE3D27D4EB4F)))
    return tuple(int(x) for x in np.array([mix(a + b), b], np.uint64).view(np.int64))


def _over(docs: DataFrame, one, schema: T.StructType) -> DataFrame:
    """Rows of one(doc_id, did, text), for all documents."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        kinds = {"bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64()), "array<tinyint>": pa.list_(pa.int8())}
        types = [kinds[f.dataType.simpleString()] for f in schema]
        np.seterr(over="ignore")
        for batch in batches:
            held = [[] for _ in types]
            size = 0
            for row in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                got = one(*row)
                if got is None:
                    continue
                for h, g in zip(held, got, strict=True):
                    h.append(g)
                size += len(got[-1]) if isinstance(got[-1], np.ndarray) else 1
                if size > 200_000:
                    yield _batch(held, types, schema.names)
                    held, size = [[] for _ in types], 0
            if held[0]:
                yield _batch(held, types, schema.names)

    own = docs.select(F.col("doc_id").cast("long"), "text").select("doc_id", F.coalesce("doc_id", F.xxhash64("text")).alias("did"), "text")
    return own.mapInArrow(run, schema)


def _batch(held, types, names):
    import numpy as np
    import pyarrow as pa

    if names == ENTRIES.names:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(held[1])), pa.array(np.repeat(np.array(held[0], np.int64), [len(x) for x in held[1]]))], names=["sig", "k1"])
    return pa.RecordBatch.from_arrays([pa.array(h, t) for h, t in zip(held, types, strict=True)], names=names)


def narrow_sets(docs: DataFrame, width: int) -> DataFrame:
    def one(doc_id, did, text):
        toks = shingles(text, width)
        return (doc_id, did, len(toks), *set_keys(toks))

    return _over(docs, one, NARROW)


def index_entries(docs: DataFrame, bands, plan: dict[int, tuple[int, int, int]], width: int, percent: int) -> DataFrame:
    """(sig, k1) of every document in all instances in which its set stands."""

    def one(doc_id, did, text):
        import numpy as np

        toks = shingles(text, width)
        if not len(toks):
            return None
        parts = [signatures(toks, j, *plan[j]) for j in instances(len(toks), bands, percent) if j in plan]
        return (set_keys(toks)[0], np.concatenate(parts).view(np.int64)) if parts else None

    return _over(docs, one, ENTRIES)


def components(edges: DataFrame) -> DataFrame:
    """rep and comp (the least rep reached) of the ends of edges (a, b); least neighbours, then the label's label."""
    both = written(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct(), "jaccard-edges")
    labels = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("l")), "jaccard-labels")
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m"))
        step = labels.join(near, "u").select("u", F.least("l", "m").alias("l"), F.col("l").alias("old"))
        step = written(step, "jaccard-step")
        jump = step.select(F.col("u").alias("l"), F.col("l").alias("ll"))
        new = written(step.join(jump, "l").select("u", F.least("l", "ll").alias("l"), "old"), "jaccard-labels")
        labels = new.select("u", "l")
        if new.filter("l <> old").isEmpty():
            return labels.select(F.col("u").alias("rep"), F.col("l").alias("comp"))


def sets_of(docs: DataFrame, reps: DataFrame, schema: T.StructType, width: int, unique: bool) -> DataFrame:
    """rep and what schema says of the sets of reps (rep, k1), from their texts; unique: whether no id has several rows."""
    held = sent_if_small(reps.select(F.col("rep").alias("did"), "k1"), SENT_IDS)
    wanted = docs.withColumn("did", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))).join(held.select("did"), "did", "left_semi")
    part = sketch if schema is MARKS else lambda toks: toks.view("int64")

    def one(doc_id, did, text):
        toks = shingles(text, width)
        return did, set_keys(toks)[0], len(toks), part(toks)

    # a doc_id with several texts may stand for several sets, and a set's text may be there repeatedly
    found = _over(wanted.select("doc_id", "text"), one, schema).join(held, ["did", "k1"]).withColumnRenamed("did", "rep")
    return written(found if unique else found.dropDuplicates(["rep", "k1"]), "jaccard-sets")


def met(pairs: DataFrame, large: DataFrame, sets: DataFrame, *cols: str) -> DataFrame:
    """pairs (a, b) with the columns of both sets, as col_a and col_b. Sets a that stand in many pairs (large) are repeated, and their pairs dealt among the copies by hash of b."""
    side = lambda x: sets.select(F.col("rep").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in cols])
    dealt = pairs.join(large, "a", "left").withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1)))).drop("parts")
    left = side("a").join(large, "a", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(side("b"), "b").join(left, ["a", "part"]).drop("part")


def verified(pairs: DataFrame, marks: DataFrame, tokens, percent: int) -> DataFrame:
    """Those pairs (a, b) that link; tokens(reps) gives whole sets, which only pairs whose sketches are near need."""
    pairs = written(pairs, "jaccard-pairs")
    large = pairs.groupBy("a").agg(F.ceil(F.count("*") / SPLIT).alias("parts")).filter("parts > 1")
    large = sent_if_small(written(large, "jaccard-large"), SENT_IDS)  # a row for SPLIT pairs at most
    total = F.col("n_a") + F.col("n_b")
    apart = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda x, y: x + y)
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    near = met(pairs, large, marks, "n", "sketch").filter(sizes & ((100 + percent) * apart <= (100 - percent) * total)).select("a", "b")
    near = written(near, "jaccard-near")
    both = met(near, large, tokens(near.select(F.col("a").alias("rep")).union(near.select("b")).distinct()), "n", "toks")
    common = both.select("a", "b", total.alias("total"), F.size(F.array_intersect("toks_a", "toks_b")).alias("i"))
    return common.filter(100 * F.col("i") >= percent * (F.col("total") - F.col("i"))).select("a", "b")


def links_in_blocks(groups: DataFrame, marks: DataFrame, tokens, percent: int) -> DataFrame:
    """Links (a, b) that join all components of each group that any link joins; groups (a, rep, comp) are named by their leader a.

    Small groups are compared pair by pair. In larger ones, sketches are compared first: what may link is joined to near groups
    by one pair for each set at most. Whole sets are compared within these, again in blocks, and a link between sets that
    others have joined already is left out. So rows grow with sets, whatever a group's links."""
    rows = _others(groups, marks)
    few = rows.filter(F.col("g") <= SMALL_GROUP).select("a", "rep", "comp", "other", "n")
    left, right = few.filter("other").alias("l"), few.alias("r")
    near = (100 * F.least("l.n", "r.n") >= percent * F.greatest("l.n", "r.n")) & (F.col("l.comp") != F.col("r.comp"))
    pairs = left.join(right, "a").filter(near).select(F.least("l.rep", "r.rep").alias("a"), F.greatest("l.rep", "r.rep").alias("b")).distinct()
    found = verified(pairs, marks, tokens, percent)
    near = written(_in_blocks(rows.filter(F.col("g") > SMALL_GROUP), marks, "sketch", percent).distinct(), "jaccard-near")
    if near.isEmpty():
        return found
    at = components(near).withColumnRenamed("comp", "a").join(groups.select("rep", "comp").distinct(), "rep")
    return found.union(_in_blocks(_others(at, marks), tokens(at.select("rep")), "toks", percent)).distinct()


def _others(groups: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows of groups (a, rep, comp) with n, the group's number of sets g, and whether a set is outside the group's main component."""
    groups = written(groups.join(marks.select("rep", "n"), "rep"), "jaccard-groups")
    main = groups.groupBy("a", "comp").agg(F.count("*").alias("c")).groupBy("a").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"))
    main = main.join(groups.groupBy("a").agg(F.count("*").alias("g")), "a")
    return groups.join(sent_if_small(written(main, "jaccard-main"), SENT_GROUPS), "a").withColumn("other", F.col("comp") != F.col("main"))


def _in_blocks(rows: DataFrame, sets: DataFrame, held: str, percent: int) -> DataFrame:
    """Pairs (a, b) of sets between components of each group, by what is held of them (sketch or toks): no more than it takes to join what may link, or links.

    Sets of the group's main component and the others are dealt to blocks by hash; each block of others meets every block, in
    tasks that hold two blocks. Whole sets are dealt to more blocks if they are long."""
    size = F.greatest(F.lit(1 / BLOCK), F.col("n") / BLOCK_SHINGLES) if held == "toks" else F.lit(1 / BLOCK)
    many = lambda which: F.ceil(F.round(F.sum(F.when(which, size).otherwise(0.0)), 9))
    blocks = rows.groupBy("a").agg(many(F.col("other")).alias("n_other"), many(~F.col("other")).alias("n_main"))
    rows = rows.join(sent_if_small(written(blocks, "jaccard-blocks"), SENT_GROUPS), "a").withColumn("block", F.pmod(F.xxhash64("rep"), F.when(F.col("other"), F.col("n_other")).otherwise(F.col("n_main"))))
    # blocks 0 to n_other - 1 are the others', the main component's follow
    place = F.when(F.col("other"), F.col("block")).otherwise(F.col("n_other") + F.col("block"))
    partners = F.when(F.col("other"), F.sequence(F.lit(0).cast("long"), F.col("n_other") + F.col("n_main") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("n_other") - 1))
    rows = rows.withColumn("place", place).withColumn("partner", F.explode(partners))
    dealt = rows.select("a", F.least("place", "partner").alias("x"), F.greatest("place", "partner").alias("y"), "place", "rep", "comp", "n")
    dealt = dealt.join(sets.select("rep", held), "rep")

    def compare(frame):
        import pandas as pd

        first = (frame["place"] == frame["x"].iloc[0]).to_numpy()
        alone = frame["x"].iloc[0] == frame["y"].iloc[0]
        got = (joining_links if held == "toks" else joining_pairs)(frame, first, first if alone else ~first, percent)
        return pd.DataFrame(got, columns=["a", "b"]).astype("int64")

    return dealt.groupBy("a", "x", "y").applyInPandas(compare, "a long, b long")


def _near(frame, cells, k: int, right, percent: int):
    """Places in right of the sets that may link to set k by their sizes and sketches, the nearest first."""
    import numpy as np

    sizes, n = frame["n"].to_numpy()[right], frame["n"].iat[k]
    can = np.flatnonzero(100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n))
    apart = np.abs(cells[right[can]] - cells[k]).sum(1, dtype=np.int64)
    near = (100 + percent) * apart <= (100 - percent) * (sizes[can] + n)
    return right[can[near][np.argsort(apart[near], kind="stable")]]


def joining_pairs(frame, first, second, percent: int) -> list[tuple[int, int]]:
    """Pairs of sets of a frame (rep, comp, n, sketch), one in first and one in second, that join all that may link across components."""
    import numpy as np

    cells = np.stack([np.asarray(x, np.int16) for x in frame["sketch"]])
    reps, comps, right = frame["rep"].to_numpy(), frame["comp"].to_numpy(), np.flatnonzero(second)
    part, found = np.arange(len(frame)), []
    for k in np.flatnonzero(first):
        own = right[comps[right] != comps[k]]
        own = own[part[own] != part[k]]  # what is joined already needs no further pair
        near = _near(frame, cells, k, own, percent)
        parts, at = np.unique(part[near], return_index=True)
        if len(parts):
            found += [(min(reps[k], x), max(reps[k], x)) for x in reps[near[at]].tolist()]
            part[np.isin(part, parts)] = part[k]
    return found


def joining_links(frame, first, second, percent: int) -> list[tuple[int, int]]:
    """Links of sets of a frame (rep, comp, n, toks), one in first and one in second, that join all components which links of these join."""
    import numpy as np

    toks = [np.asarray(x, np.int64) for x in frame["toks"]]
    cells = np.stack([sketch(x.view(np.uint64)) for x in toks]).astype(np.int16)
    reps, right = frame["rep"].to_numpy(), np.flatnonzero(second)
    part, found = np.unique(frame["comp"].to_numpy(), return_inverse=True)[1], []
    for k in np.flatnonzero(first):
        for j in _near(frame, cells, k, right[part[right] != part[k]], percent):
            if part[j] == part[k]:
                continue
            common = len(np.intersect1d(toks[k], toks[j], assume_unique=True))
            if 100 * common >= percent * (len(toks[k]) + len(toks[j]) - common):
                found.append((min(reps[k], reps[j]), max(reps[k], reps[j])))
                part[part == part[j]] = part[k]
    return found


def common_counts(left: list, right: list | None = None):
    """Sizes of the intersections of sorted sets of hashes, each of left with each of right (left again where it isn't given)."""
    import numpy as np

    every = left if right is None else left + right
    place = np.repeat(np.arange(len(every)), [len(x) for x in every])
    _, column, times = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    kept = shared[column]
    place, column = place[kept], number[column[kept]]
    order = np.argsort(column, kind="stable")
    place, column = place[order], column[order]
    total = np.zeros((len(left), len(every) if right is None else len(right)), np.float32)
    width = max(64, 4_000_000 // len(every))
    for low in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        held = np.zeros((len(every), width), np.float32)
        held[place[a:b], column[a:b] - low] = 1
        total += held[: len(left)] @ (held if right is None else held[len(left) :]).T
    return total.astype(np.int64)


def links_of(left: list, right: list | None, percent: int):
    """Number of links of each set of left to sets of right and the other way round; inside left where right isn't given."""
    import numpy as np

    if right is None and len(left) == 2:
        a, b = left
        common = len(np.intersect1d(a, b, assume_unique=True))
        linked = 100 * common >= percent * (len(a) + len(b) - common)
        return np.array([linked, linked], np.int64), None
    sizes = lambda x: np.array([len(t) for t in x], np.int64)
    common = common_counts(left, right)
    linked = 100 * common >= percent * (sizes(left)[:, None] + sizes(left if right is None else right)[None, :] - common)
    if right is None:
        np.fill_diagonal(linked, False)
    return linked.sum(1), None if right is None else linked.sum(0)


def link_counts(comps: DataFrame, tokens, percent: int) -> DataFrame:
    """rep and links, the number of other sets that it links with, of sets of components (rep, comp) of several sets."""
    sets = tokens(comps.select("rep"))
    base = max(1.01, 100 / percent * 1.0001)  # sets of a link lie in one band of sizes or in neighbouring ones
    rows = written(comps.join(sets.select("rep", "n"), "rep").withColumn("band", F.floor(F.ln("n") / math.log(base))), "jaccard-sized")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES))
    large = written(rows.groupBy("comp").agg(blocks.alias("b")).filter("b > 1").select("comp"), "jaccard-large")
    one = lambda df, x, y, place: df.select("comp", x.cast("long").alias("x"), y.cast("long").alias("y"), place.cast("long").alias("place"), "rep")
    if large.isEmpty():
        dealt = one(rows, F.lit(0), F.lit(0), F.lit(0))
    else:
        sent = sent_if_small(large, SENT_GROUPS)
        many = rows.join(sent, "comp", "left_semi")
        bands = written(many.groupBy("comp", "band").agg(blocks.alias("nb")), "jaccard-bands")
        beside = lambda d, name: bands.select("comp", (F.col("band") + d).alias("band"), F.col("nb").alias(name))
        facts = bands.join(beside(1, "below"), ["comp", "band"], "left").join(beside(-1, "above"), ["comp", "band"], "left")
        many = many.join(sent_if_small(written(facts, "jaccard-facts"), SENT_GROUPS), ["comp", "band"])
        number = lambda band, i: F.shiftleft((band + 1).cast("long"), 40) + i
        own = number(F.col("band"), F.pmod(F.xxhash64("rep"), F.col("nb")))
        other = lambda d, n: F.when(F.col(n).isNotNull(), F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), lambda i: number(F.col("band") + d, i))).otherwise(F.array().cast("array<bigint>"))
        partner = F.explode(F.concat(other(0, "nb"), other(-1, "below"), other(1, "above")))
        many = many.withColumn("own", own).withColumn("partner", partner)
        dealt = one(rows.join(sent, "comp", "left_anti"), F.lit(0), F.lit(0), F.lit(0)).unionByName(one(many, F.least("own", "partner"), F.greatest("own", "partner"), F.col("own")))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        key, held, ready = None, [], {}

        def done():
            if len(held) < 2:
                return
            first = [h for h in held if h[0] == key[1]]
            second = [h for h in held if h[0] != key[1]] if key[1] != key[2] else None
            if first and (second is None or second):
                a, b = links_of([h[2] for h in first], second and [h[2] for h in second], percent)
                for part, counts in ((first, a), (second, b)):
                    for h, c in zip(part or (), counts if counts is not None else ()):
                        ready[h[1]] = ready.get(h[1], 0) + int(c)

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(ready), pa.int64()), pa.array(list(ready.values()), pa.int64())], names=["rep", "links"])

        for batch in batches:
            column = batch.column(5)
            ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            for k, (comp, x, y, place, rep) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True)):
                if key != (comp, x, y):
                    done()
                    if len(ready) > 10_000:
                        yield out()
                        ready = {}
                    key, held = (comp, x, y), []
                held.append((place, rep, np.array(values[ends[k] : ends[k + 1]])))
        done()
        yield out()

    met_ = dealt.join(sets.select("rep", "toks"), "rep").select("comp", "x", "y", "place", "rep", "toks")
    found = met_.repartition("comp", "x", "y").sortWithinPartitions("comp", "x", "y").mapInArrow(run, "rep long, links long")
    return found.groupBy("rep").agg(F.sum("links").alias("links"))


class Sets:
    """Sets of a table's documents: narrow rows (doc_id, did, n, k1, k2), classes of equal sets, and marks or whole sets of some, from their texts."""

    def __init__(self, docs: DataFrame, narrow: DataFrame, width: int, percent: int):
        self.docs, self.narrow, self.width, self.percent = docs, narrow, width, percent
        classes = narrow.filter("n > 0").groupBy("k1", "k2", "n").agg(F.min("did").alias("rep"), F.min("doc_id").alias("class_id"))
        self.classes = written(classes, "jaccard-classes")
        self.unique = narrow.groupBy("did").count().filter("count > 1").isEmpty()

    def of(self, reps: DataFrame, schema: T.StructType) -> DataFrame:
        return sets_of(self.docs, reps, schema, self.width, self.unique)

    def tokens(self, some: DataFrame) -> DataFrame:
        return self.of(self.classes.select("rep", "k1").join(some, "rep"), TOKENS)

    def components(self, members: DataFrame) -> DataFrame:
        """rep and comp of sets that link with any; members: sig and rep of candidates, sets that share an entry."""
        spark, percent = self.docs.sparkSession, self.percent
        edges = spark.createDataFrame([], "a long, b long")
        comps = spark.createDataFrame([], "rep long, comp long")
        if members.isEmpty():
            return comps
        reps = written(members.select("rep").distinct().join(self.classes.select("rep", "k1"), "rep"), "jaccard-reps")
        marks = self.of(reps, MARKS)
        tokens = lambda some: self.of(reps.join(some, "rep"), TOKENS)
        at = members.withColumn("comp", F.col("rep"))
        for k in range(LEADER_ROUNDS + 1):
            open_ = at.groupBy("sig").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count("*").alias("g"), F.min_by("rep", F.xxhash64("rep", F.lit(k)) if k else F.col("rep")).alias("a")).filter("c1 < c2")
            open_ = written(open_, "jaccard-open")
            if open_.isEmpty():
                break
            inside = at.join(open_.select("sig", "a"), "sig")
            if k == LEADER_ROUNDS:
                found = written(links_in_blocks(inside.select("a", "rep", "comp").distinct(), marks, tokens, percent), "jaccard-links")
            else:
                lead = inside.filter("rep = a").select("sig", F.col("comp").alias("ca"))
                # each set meets the leader with which it shares most entries; others are left to the next round
                shared = inside.join(lead, "sig").filter("comp <> ca").groupBy("rep", "a").agg(F.count("*").alias("c"))
                best = shared.groupBy("rep").agg(F.max(F.struct("c", "a")).alias("m")).select("rep", "m.a")
                pairs = best.select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b")).distinct()
                found = written(verified(pairs, marks, tokens, percent), "jaccard-links")
            tidy(spark)
            if not found.isEmpty():
                edges = edges.union(found).distinct()
                comps = components(edges)
            at = written(members.join(comps, "rep", "left").select("sig", "rep", F.coalesce("comp", "rep").alias("comp")), "jaccard-at") if k < LEADER_ROUNDS else at
        return comps

    def result(self, comps: DataFrame, more: DataFrame | None = None) -> DataFrame:
        """doc_id, n_shingles, component_id (least doc_id of a component), class_id (least doc_id with the same set) and, with more (rep, links), links."""
        own = self.classes.join(comps, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        least = own.groupBy("comp").agg(F.min("class_id").alias("component_id"))
        own = own.join(least, "comp")
        links = [] if more is None else ["links"]
        if more is not None:
            own = own.join(more, "rep", "left").withColumn("links", F.coalesce("links", F.lit(0).cast("long")))
        own = own.select("k1", "k2", "n", "component_id", "class_id", *links)
        out = self.narrow.filter("n > 0").join(own, ["k1", "k2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class_id", *links)
        alone = self.narrow.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"), *[F.lit(0).cast("long").alias(x) for x in links])
        return out.unionByName(alone)


def link(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (least doc_id with the same set) and links: with how many other sets the document's set links."""
    with scratch(docs.sparkSession) as made:
        out = written(_linked(docs, width, percent, links), "jaccard-result")
    delete(docs.sparkSession, made[:-1])  # all but the result
    return out


def _linked(docs: DataFrame, width: int, percent: int, links: bool) -> DataFrame:
    sets = Sets(docs, written(narrow_sets(docs, width), "jaccard-narrow"), width, percent)
    classes = sets.classes
    bands = band_limits(classes.agg(F.max("n")).first()[0] or 0)
    held = [0] * (len(bands) + 1)
    lows = F.array(*[F.lit(b[0]).cast("long") for b in bands])
    band = F.size(F.filter(lows, lambda low: low <= F.col("n"))) - 1
    for r in classes.groupBy(band.alias("band")).agg(F.count("*").alias("c")).collect() if bands else ():  # a row for each band
        held[r["band"]] = r["c"]
    # instance j compares band j with itself and with what may link in band j + 1; without a difference, equal sets alone link
    plan = {j: allocation(*b, max(2, held[j] + held[j + 1]), percent) for j, b in enumerate(bands) if differences(b[1], percent) and held[j]}
    entries = index_entries(docs, bands, plan, width, percent)
    # one exchange of the index: entries of a single set are dropped where they meet
    same = W.partitionBy("sig")
    live = entries.select("sig", "k1", F.min("k1").over(same).alias("low"), F.max("k1").over(same).alias("high")).filter("low < high").select("sig", "k1")
    members = written(live.join(classes.select("k1", "rep"), "k1").select("sig", "rep").distinct(), "jaccard-members")
    tidy(docs.sparkSession)
    comps = sets.components(members)
    return sets.result(comps, link_counts(comps, sets.tokens, percent) if links else None)

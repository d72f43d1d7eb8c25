"""Packing by non-negative least squares.

Each document gives whole windows and one remainder. Shallow combinations of remainder lengths that fill
a window exactly are enumerated, repeat counts are solved against the histogram of remainders by
non-negative least squares and rounded, and what is left is packed greedily (best fit, longest first);
windows that this leaves loose are refilled from one run of their pieces, cut at window ends.

The driver sees the histogram (one row for each length below the window) and the plan, whose size is
bounded by the window, not by the data. Documents find their place through their rank among remainders
of one length, counted for each task and summed over tasks, so no length is ever gathered or sorted.

Cases: null and empty texts hold the end id only; repeated rows and null doc_id are packed as rows of
their own; of remainders of one length the first by task and row is placed first; long texts are whole windows and one
remainder; strings of special tokens are ordinary text (see tokens); other columns are ignored and may have any name; an
empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.llm import common, tokens

WINDOW = 2048
#: One length of a three-part combination is a multiple of this share of the window.
COARSE = 64
STEPS = 400
#: A greedy window with no more free places than this share of its length stays as it is.
SLACK = 0.002

TOKENS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("rem", T.IntegerType()), T.StructField("rank", T.LongType()), T.StructField("full_before", T.LongType()), T.StructField("crcs", T.ArrayType(T.LongType())), T.StructField("rem_ids", T.BinaryType())])
PIECES = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [T.StructField("part", T.IntegerType()), T.StructField("row", T.LongType()), T.StructField("rem_start", T.LongType())])


def combinations(window: int):
    """Lengths and repeats (n, 3) of the shallow combinations that fill a window exactly."""
    import numpy as np

    rows: list[tuple[int, ...]] = [(i, 1, window - i, 1, 0, 0) for i in range(1, window // 2 + 1)]
    step = max(1, window // COARSE)
    for i in range(step, window - 1, step):
        rest = window - i
        rows += [(i, 1, j, 1, rest - j, 1) for j in range(1, rest // 2 + 1)]
    for i in range(1, window // 3 + 1):  # a short length many times, and one that fills up
        for m in {window // i, window // i * 3 // 4, window // i // 2}:
            if m > 1:
                rows.append((i, m, window - m * i, 1, 0, 0) if window > m * i else (i, m, 0, 0, 0, 0))
    a = np.array(rows, np.int64).reshape(-1, 3, 2)
    return a[:, :, 0], a[:, :, 1]


def solve_counts(lengths, repeats, hist):
    """Non-negative least squares by accelerated projected gradient steps: min |A x - hist|, x >= 0."""
    import numpy as np

    n, size = len(lengths), len(hist)
    flat, weight = lengths.ravel(), repeats.astype(float)
    scale = 1 / np.sqrt(np.maximum((weight**2).sum(1), 1))  # columns of length 1
    weight = weight * scale[:, None]
    ahead = lambda x: np.bincount(flat, weights=(weight * x[:, None]).ravel(), minlength=size)
    back = lambda y: (weight * y[lengths]).sum(1)
    v = np.ones(n)
    for _ in range(20):
        v = back(ahead(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(STEPS):
        new = np.maximum(0, y - back(ahead(y) - hist) / norm)
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y, x = new + (old - 1) / t * (new - x), new
    return x * scale


@dataclass
class Plan:
    """Ranks [lo, next lo) of a length go to sequences base + (rank - lo) // each, at offset + (rank - lo) % each * length;
    with each = 0 to position base + (rank - lo) * length of the run that is cut at window ends."""

    window: int
    rem: list
    lo: list
    base: list
    offset: list
    each: list
    loose: set
    n_sequences: int
    run_first: int

    def arrays(self):
        import numpy as np

        order = np.lexsort((self.lo, self.rem))
        return [np.asarray(x, np.int64)[order] for x in (self.rem, self.lo, self.base, self.offset, self.each)]


def make_plan(hist: dict[int, int], window: int = WINDOW) -> Plan:
    import numpy as np

    left = np.zeros(window + 1, np.int64)
    for k, v in hist.items():
        if k:
            left[k] = v
    lengths, repeats = combinations(window)
    open_ = ((left[lengths] > 0) | (repeats == 0)).all(1)
    lengths, repeats = lengths[open_], repeats[open_]
    used: list[tuple[list[tuple[int, int]], int]] = []  # parts (length, repeats), windows
    if len(lengths):
        h = left.astype(float)
        h[0] = 0
        x = solve_counts(lengths, repeats, h)
        for k in np.argsort(-x, kind="stable"):
            n = int(round(x[k]))
            if n < 1:
                break
            need: dict[int, int] = {}
            for ln, m in zip(lengths[k].tolist(), repeats[k].tolist(), strict=True):
                if m:
                    need[ln] = need.get(ln, 0) + m
            n = min(n, *(int(left[ln]) // m for ln, m in need.items()))
            if n > 0:
                used.append((list(need.items()), n))
                for ln, m in need.items():
                    left[ln] -= n * m
    tight, loose_parts = greedy(left, window)
    used += tight
    rem, lo, base, offset, each = [], [], [], [], []
    taken: dict[int, int] = {}
    n_sequences = 0

    def put(ln, count, b, o, e):
        rem.append(ln), lo.append(taken.get(ln, 0)), base.append(b), offset.append(o), each.append(e)
        taken[ln] = taken.get(ln, 0) + count

    for parts, n in used:
        o = 0
        for ln, m in parts:
            put(ln, n * m, n_sequences, o, m)
            o += ln * m
        n_sequences += n
    at = 0
    for ln, count in sorted(loose_parts.items(), reverse=True):
        put(ln, count, at, 0, 0)
        at += ln * count
    return Plan(window, rem, lo, base, offset, each, set(loose_parts), n_sequences + -(-at // window), n_sequences)


def greedy(left, window: int):
    """Best fit, longest first, on the histogram: windows filled but for SLACK, and the pieces of the others."""
    import bisect

    free: list[int] = []  # distinct free places, ascending
    open_: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}

    def add(space, parts, n):
        if space not in open_:
            bisect.insort(free, space)
            open_[space] = []
        open_[space].append((parts, n))

    for ln in range(window, 0, -1):
        count = int(left[ln])
        while count:
            k = bisect.bisect_left(free, ln)
            if k == len(free):
                q = window // ln
                if count >= q:
                    add(window - q * ln, [(ln, q)], count // q)
                if count % q:
                    add(window - count % q * ln, [(ln, count % q)], 1)
                break
            space = free[k]
            parts, n = open_[space].pop()
            if not open_[space]:
                del open_[space], free[k]
            q = space // ln
            if count < q:
                add(space - count * ln, [*parts, (ln, count)], 1)
                if n > 1:
                    add(space, parts, n - 1)
                break
            m = min(n, count // q)
            add(space - q * ln, [*parts, (ln, q)], m)
            if n > m:
                add(space, parts, n - m)
            count -= m * q
    tight, loose = [], {}
    for space, classes in open_.items():
        for parts, n in classes:
            if space <= SLACK * window:
                tight.append((parts, n))
            else:
                for ln, m in parts:
                    loose[ln] = loose.get(ln, 0) + m * n
    return tight, loose


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, window: int) -> DataFrame:
    """A row for each document with its remainder's length and rank among its task's remainders of that length."""
    end = struct.pack("<I", end_id)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        code, part = tokens.encoder(tokenizer), TaskContext.get().partitionId()
        ranks: dict[int, int] = {}
        row = full = 0
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in tokens.by_bytes(texts):
                rows = []
                for doc_id, raw in zip(ids[a:b], code.encode(texts[a:b]), strict=True):
                    raw += end
                    n, whole = len(raw) // 4, len(raw) // 4 // window
                    rem = n - whole * window
                    crcs = [zlib.crc32(raw[k : k + 4 * window]) for k in range(0, 4 * n, 4 * window)]
                    rows.append((part, row, doc_id, n, rem, ranks.get(rem, 0), full, crcs, raw[4 * whole * window :]))
                    ranks[rem] = ranks.get(rem, 0) + 1
                    row, full = row + 1, full + whole
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=TOKENS.names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, TOKENS)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece."""
    toks = common.written(tokenized(docs, tokenizer, end_id, window), "packing-tokens")
    counts = toks.groupBy("part", "rem").agg(F.count("*").alias("n"), F.sum((F.col("n_tokens") - F.col("rem")) / window).cast("long").alias("full"))
    counts = common.written(counts, "packing-counts")
    hist = {r["rem"]: r["n"] for r in counts.groupBy("rem").agg(F.sum("n").alias("n")).collect()}  # fewer rows than the window
    plan = make_plan(hist, window)
    before = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = counts.groupBy("part").agg(F.sum("full").alias("f")).withColumn("full_base", before("f", W.orderBy("part"))).select("part", "full_base")  # a row for each task
    places = counts.withColumn("rank_base", before("n", W.partitionBy("rem").orderBy("part"))).select("part", "rem", "rank_base").join(parts, "part")
    rows = toks.drop("rem_ids").join(places, ["part", "rem"])
    arrays, run_first, full_first = plan.arrays(), plan.run_first, plan.n_sequences
    held = docs.sparkSession.sparkContext.broadcast(arrays)  # bounded by the window

    def place(batches):
        import numpy as np
        import pyarrow as pa

        p_rem, p_lo, p_base, p_off, p_each = held.value
        key = (p_rem << 40) + p_lo
        for batch in batches:
            d = {n: batch.column(batch.schema.names.index(n)) for n in ("part", "row", "rem", "rank", "rank_base", "full_before", "full_base", "n_tokens")}
            d = {n: c.to_numpy(zero_copy_only=False).astype(np.int64) for n, c in d.items()}
            doc_ids = batch.column(batch.schema.names.index("doc_id"))
            crcs = batch.column(batch.schema.names.index("crcs")).flatten().to_numpy(zero_copy_only=False)
            n_whole = (d["n_tokens"] - d["rem"]) // window
            n_crc = n_whole + (d["rem"] > 0)
            crc_at = np.cumsum(n_crc) - n_crc
            # whole windows
            i = np.repeat(np.arange(len(n_whole)), n_whole)
            k = np.arange(len(i)) - np.repeat(np.cumsum(n_whole) - n_whole, n_whole)
            z = np.zeros(len(i), np.int64)
            out = [[i, k * window, z + window, crcs[crc_at[i] + k], full_first + d["full_base"][i] + d["full_before"][i] + k, z, z, z.astype(bool)]]
            # remainders
            j = np.nonzero(d["rem"])[0]
            rem, rank = d["rem"][j], d["rank"][j] + d["rank_base"][j]
            if len(j):
                s = np.searchsorted(key, (rem << 40) + rank, "right") - 1
                nth, each = rank - p_lo[s], np.maximum(p_each[s], 1)
                run = p_each[s] == 0
                at = p_base[s] + nth * rem
                seq = np.where(run, run_first + at // window, p_base[s] + nth // each)
                off = np.where(run, at % window, p_off[s] + nth % each * rem)
                first = np.minimum(rem, window - off)
                cut = first < rem
                z = np.zeros(len(j), np.int64)
                out.append([j, n_whole[j] * window, first, crcs[crc_at[j] + n_whole[j]], seq, off, z, cut])
                c = np.nonzero(cut)[0]
                out.append([j[c], n_whole[j[c]] * window + first[c], rem[c] - first[c], z[c], seq[c] + 1, z[c], first[c], cut[c]])
            i, start, length, crc, seq, off, rem_start, cut = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(i)), pa.array(start), pa.array(length), pa.array(crc.astype(np.int64), mask=cut), pa.array(d["n_tokens"][i]), pa.array(seq), pa.array(off), pa.array(d["part"][i].astype(np.int32)), pa.array(d["row"][i]), pa.array(rem_start)], names=PIECES.names)

    pieces = common.written(rows.mapInArrow(place, PIECES), "packing-pieces")
    names = PIECES.names[:7]
    # pieces that were cut take their checksums from the remainder's ids
    cut = pieces.filter("ids_crc32 is null")
    texts = toks.filter(F.col("rem").isin(sorted(plan.loose))) if plan.loose else toks.limit(0)
    redone = cut.join(texts.select("part", "row", "rem_ids"), ["part", "row"]).withColumn("ids_crc32", F.crc32(F.expr("substring(rem_ids, cast(4 * rem_start as int) + 1, cast(4 * length as int))")))
    return pieces.filter("ids_crc32 is not null").select(names).unionByName(redone.select(names))


def padding(pieces: DataFrame, window: int = WINDOW) -> float:
    """Share of padded places, a sequence whose length is a power of two counting as whole."""
    fill = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    bare = F.pow(F.lit(2), F.round(F.log2("n"))) == F.col("n")
    r = fill.agg(F.sum(F.when(bare, 0).otherwise(window - F.col("n"))).alias("pad"), F.sum("n").alias("n")).first()
    return (r["pad"] or 0) / max(1, (r["pad"] or 0) + (r["n"] or 0))

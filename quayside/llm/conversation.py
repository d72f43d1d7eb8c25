"""Least repairs of conversations whose turns were lost, emptied, cut, repeated or given a wrong role.

A conversation is legal if the initials of its roles are (s?(ua)+)?, an automaton of four states. Costs are
searched in layers, as in approximate matching by bitsets: layer c holds, for each place between turns, the
set of states (4 bits) from which the turns behind it can be repaired at a cost of exactly c, and comes by table look-ups from
layers c - 3, c - 4 and c itself. The first layer whose first place holds the start gives the cost; walking
forward through the layers, taking the first letter that they allow, gives the least audit.

Edits: Keep costs 0, Rerole (to user or assistant) 3, Delete 4, Insert (an empty turn of user or assistant) 3.
Blank and duplicate turns must be deleted; a truncated one that stays costs 3 more.

Conversations of at most DIRECT_ROWS rows and DIRECT_CHARS characters are repaired where they meet. Longer ones are cut in chunks of CHUNK
turns: each chunk gives its 4 x 4 table of least costs from state to state; going backward over these tables
gives what each chunk's end costs at least, with which chunks are traced apart for all four entry states;
going forward picks the trace that applies. Both ways are streams of one small row a chunk, so that no task holds a
conversation's turns, however long it is. Only its hash must be taken in one stream.

Cases: a null role or text is one space; null conv_id is a conversation and null turn comes first; turns of one
number are taken by role and text; repeated rows count each; a conversation that has no rows left has zeros, an empty audit and no messages; very long
texts are read whole; other columns are ignored and may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.llm.common import SPACE_CHARS, running_sums, sent_if_small, written

DIRECT_ROWS, DIRECT_CHARS = 256, 4_000_000
CHUNK = 64
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NEVER = 1 << 40
ENDS = ".!?"

#: States: 0 start, 1 after system, 2 after user, 3 after assistant. What a next turn of each role leads to.
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: Least cost of ending in each state, by inserts.
FINISH = (0, 2 * INSERT, INSERT, 0)
NEXT_ROLE = ("user", "user", "assistant", "user")


def _before(moves: list[tuple[int, int]]) -> list[int]:
    """For each set of states, those that a move leads into it."""
    return [sum({1 << a for a, b in moves if x >> b & 1}) for x in range(16)]


_KEEP = {r: _before(list(STEPS.get(r, {}).items())) for r in "sua-"}
_ADD = _before([(q, STEPS[NEXT_ROLE[q][0]][q]) for q in range(4)])
_NONE = [0] * 16

#: A turn's code: role's initial, whether it must go, whether it is truncated.
Code = tuple[str, bool, bool]


def layers(codes: list[Code], exits: tuple[int, ...], until) -> list[list[int]]:
    """Layers of costs 0, 1, ...: sets of states for each place, up to the first for which until(set of the first place) holds.

    exits: what each state costs behind the last turn."""
    n, out = len(codes), []
    keep = [_NONE if must else _KEEP[role] for role, must, _ in codes]
    add = [_NONE if must else _ADD for _, must, _ in codes]
    extra = [TRUNCATED if cut else 0 for _, _, cut in codes]
    blank = [0] * (n + 1)
    while True:
        c = len(out)
        row = [0] * (n + 1)
        out.append(row)
        at = lambda k: out[k] if k >= 0 else blank  # noqa: B023, E731
        inserted, deleted = at(c - INSERT), at(c - DELETE)
        row[n] = sum(1 << q for q in range(4) if exits[q] == c)
        kept = {0: row, TRUNCATED: at(c - TRUNCATED)}
        reroled = {0: inserted, TRUNCATED: at(c - REROLE - TRUNCATED)}
        for t in range(n - 1, -1, -1):
            x = extra[t]
            row[t] = deleted[t + 1] | keep[t][kept[x][t + 1]] | add[t][reroled[x][t + 1]] | _ADD[inserted[t]]
        if until(row[0], c):
            return out


def trace(codes: list[Code], exits: tuple[int, ...], entry: int) -> tuple[int, str, int]:
    """(cost, audit, exit state) of the least repair from a state on; ties go to the least audit."""
    low = min(exits)
    found = layers(codes, tuple(x - low for x in exits), lambda first, c: first >> entry & 1 or c > _most(len(codes)))
    c, q, audit = len(found) - 1, entry, []
    if not found[c][0] >> q & 1:
        return NEVER, "", entry
    has = lambda k, t, state: k >= 0 and state is not None and found[k][t] >> state & 1
    for t, (role, must, cut) in enumerate(codes):
        extra = TRUNCATED if cut else 0
        while True:
            kept, other = STEPS.get(role, {}).get(q), STEPS[NEXT_ROLE[q][0]][q]
            if has(c - DELETE, t + 1, q):
                edit, c = "D", c - DELETE
            elif has(c - INSERT, t, other):
                edit, c, q = "I", c - INSERT, other
            elif not must and has(c - extra, t + 1, kept):
                edit, c, q = "K", c - extra, kept
            else:
                edit, c, q = "R", c - REROLE - extra, other
            audit.append(edit)
            if edit != "I":
                break
    return len(found) - 1 + low, "".join(audit), q


def _most(n: int) -> int:
    """No least cost of n turns between states that reach each other is beyond this."""
    return DELETE * n + 4 * INSERT + TRUNCATED + 64


def between(codes: list[Code]) -> list[int]:
    """Least costs from each state (4 in turn) to each."""
    out = [NEVER] * 16
    for x in range(4):
        seen = 0

        def until(first, c):
            nonlocal seen
            for q in range(4):
                if first >> q & 1 and not seen >> q & 1:
                    out[4 * q + x], seen = c, seen | 1 << q  # noqa: B023
            return seen == 15 or c > _most(len(codes))

        layers(codes, tuple(0 if q == x else NEVER for q in range(4)), until)
    return out


def replay(rows: list[tuple[str, str]], audit: str, entry: int) -> list[tuple[str, str]]:
    """(role, text) of repaired turns."""
    out, q, t = [], entry, 0
    for edit in audit:
        role, text = (NEXT_ROLE[q], "") if edit == "I" else rows[t]
        t += edit != "I"
        if edit == "D":
            continue
        role = NEXT_ROLE[q] if edit == "R" else role
        q = STEPS[role[0]][q]
        out.append((role, text))
    return out


def initial(role: str) -> str:
    return role[0] if role[:1] in STEPS else "-"


def digest(rows: list[tuple[str, str]]) -> bytes:
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in rows).encode("utf-8", "surrogatepass")).digest()


# the whole of a conversation in one place


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_MESSAGES = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
REPAIRED = T.StructType([T.StructField("conv_id", T.LongType()), *[T.StructField(n, T.LongType()) for n in _COUNTS], T.StructField("audit", T.StringType()), T.StructField("chunk", T.LongType()), T.StructField("chunks", T.LongType()), T.StructField("messages", _MESSAGES)])


def repaired_whole(turns: list[tuple[int | None, str, str]]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit and messages of turns (turn, role, text) in order."""
    codes, seen, counts = [], set(), [0, 0, 0]
    for _, role, text in turns:
        bare = text.strip(SPACE_CHARS)
        fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ENDS else 3
        seen.add((role, text))
        if fault < 3:
            counts[fault] += 1
        codes.append((initial(role), fault < 2, fault == 2))
    numbers = {t for t, _, _ in turns if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    cost, audit, q = trace(codes, FINISH, 0)
    audit += "I" * (FINISH[q] // INSERT)
    return (min(gaps, (1 << 63) - 1), *counts, illegal, cost, audit, replay([(r, x) for _, r, x in turns], audit, 0))


def _direct(rows: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        kind = pa.schema([("conv_id", pa.int64()), *[(n, pa.int64()) for n in _COUNTS], ("audit", pa.string()), ("chunk", pa.int64()), ("chunks", pa.int64()), ("messages", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])
        turns, conv, ready, size = None, None, [], 0

        def done():
            *facts, messages = repaired_whole(turns)
            ready.append((conv, *facts, 0, 1, [{"role": r, "text": t} for r, t in messages]))

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ready), kind)], schema=kind)

        for batch in batches:
            for id_, turn, role, text, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if turns is None or id_ != conv:
                    if turns is not None:
                        done()
                    if len(ready) >= 500 or size > DIRECT_CHARS:
                        yield out()
                        ready, size = [], 0
                    turns, conv = [], id_
                turns += [(turn, role, text)] * copies
                size += len(text) * copies
        if turns is not None:
            done()
            yield out()

    return rows.select("conv_id", "turn", "role", "text", "copies").mapInArrow(run, REPAIRED)


# conversations in chunks


def _coded(rows: DataFrame) -> DataFrame:
    """rows of long conversations with their place at (from 0) and chunk, and code: initial, must go, truncated; fault, follows."""
    every = rows.withColumn("copy", F.explode_outer(F.when(F.col("copies") > 0, F.sequence(F.lit(1), "copies")))).filter("copies > 0").drop("copies")
    order = [F.col(c).asc() for c in ("conv_id", "turn", "role", "text", "copy")] + [F.col("tie").asc()]
    placed = running_sums(every.withColumn("tie", F.monotonically_increasing_id()), order, {"at": F.lit(1).cast("long")})
    placed = written(placed.withColumn("said", F.md5(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text"))), "turns-placed")
    heads = placed.groupBy("conv_id").agg(F.min("at").alias("head"), F.count("*").alias("rows"))
    firsts = placed.groupBy("conv_id", "said").agg(F.min("at").alias("first"))
    both = placed.alias("p").join(heads.alias("h"), F.col("p.conv_id").eqNullSafe(F.col("h.conv_id"))).join(firsts.alias("f"), F.col("p.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("p.said") == F.col("f.said")))
    bare = F.translate("text", SPACE_CHARS, "")
    fault = F.when(bare == "", 0).when(F.col("at") > F.col("first"), 1).when(~F.right(bare, F.lit(1)).isin(*ENDS), 2).otherwise(3)
    mark = F.substring("role", 1, 1)
    return both.select("p.conv_id", "turn", "role", "text", (F.col("at") - F.col("head")).alias("at"), F.floor((F.col("at") - F.col("head")) / CHUNK).alias("chunk"), F.ceil(F.col("rows") / CHUNK).alias("chunks"), fault.alias("fault"), F.when(mark.isin(*STEPS), mark).otherwise("-").alias("mark"), mark.alias("letter"))


def _stream(rows: DataFrame, order: Column, step, schema: T.StructType) -> DataFrame:
    """Rows of step(carried, row) -> (carried, new row), conversation by conversation in an order; carried is None at each start."""
    names = schema.names

    def run(batches):
        import pyarrow as pa

        conv, carried = "none yet", None
        for batch in batches:
            ready = []
            for row in batch.to_pylist():
                if row["conv_id"] != conv:
                    conv, carried = row["conv_id"], None
                carried, new = step(carried, row)
                if new is not None:
                    ready.append(new)
            if ready:
                from pyspark.sql.pandas.types import to_arrow_schema

                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in ready], schema=to_arrow_schema(schema))

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", order).mapInArrow(run, schema)


def _each(rows: DataFrame, one, schema: T.StructType) -> DataFrame:
    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        for batch in batches:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, one(r))) for r in batch.to_pylist()], schema=to_arrow_schema(schema))

    return rows.mapInArrow(run, schema)


def _codes(marks: str, faults: list[int]) -> list[Code]:
    return [(m, f < 2, f == 2) for m, f in zip(marks, faults)]


def _fields(**kinds) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


_LONG, _STR = T.LongType(), T.StringType()
_LONGS = T.ArrayType(_LONG)


def _in_chunks(rows: DataFrame) -> DataFrame:
    turns = written(_coded(rows), "turns-coded")
    held = F.array_sort(F.collect_list(F.struct("at", "mark", "fault")))  # CHUNK turns
    chunks = turns.groupBy("conv_id", "chunk", "chunks").agg(held.alias("t")).select("conv_id", "chunk", "chunks", F.array_join(F.transform("t", lambda x: x["mark"]), "").alias("marks"), F.transform("t", lambda x: x["fault"].cast("long")).alias("faults"))
    tables = _each(chunks, lambda r: (r["conv_id"], r["chunk"], r["chunks"], r["marks"], r["faults"], between(_codes(r["marks"], r["faults"]))), _fields(conv_id=_LONG, chunk=_LONG, chunks=_LONG, marks=_STR, faults=_LONGS, costs=_LONGS))
    tables = written(tables, "turns-tables")

    def back(ends, r):
        ends = ends or FINISH
        starts = tuple(min(NEVER, *(r["costs"][4 * q + x] + ends[x] for x in range(4))) for q in range(4))
        return starts, (r["conv_id"], r["chunk"], r["chunks"], r["marks"], r["faults"], list(ends), starts[0])

    ended = written(_stream(tables, F.col("chunk").desc(), back, _fields(conv_id=_LONG, chunk=_LONG, chunks=_LONG, marks=_STR, faults=_LONGS, ends=_LONGS, cost=_LONG)), "turns-ended")

    def traced(r):
        got = [trace(_codes(r["marks"], r["faults"]), tuple(r["ends"]), q) for q in range(4)]
        return r["conv_id"], r["chunk"], r["chunks"], r["cost"], [g[1] for g in got], [g[2] for g in got]

    traces = written(_each(ended, traced, _fields(conv_id=_LONG, chunk=_LONG, chunks=_LONG, cost=_LONG, audits=T.ArrayType(_STR), exits=_LONGS)), "turns-traces")

    def forth(q, r):
        q = q or 0
        after = r["exits"][q]
        tail = "I" * (FINISH[after] // INSERT) if r["chunk"] == r["chunks"] - 1 else ""
        return after, (r["conv_id"], r["chunk"], r["cost"] if r["chunk"] == 0 else None, r["audits"][q] + tail, q)

    picked = written(_stream(traces, F.col("chunk").asc(), forth, _fields(conv_id=_LONG, chunk=_LONG, cost=_LONG, audit=_STR, entry=_LONG)), "turns-picked")
    # faults, gaps and illegal neighbours; the first turn of a chunk follows the last of the chunk before
    letters = F.array_sort(F.collect_list(F.struct("at", "letter")))  # CHUNK turns
    pairs = turns.groupBy("conv_id", "chunk").agg(letters.alias("l")).select("conv_id", "chunk", F.array_join(F.transform("l", lambda x: x["letter"]), "\x00").alias("s"))

    def neighbours(last, r):
        line = ([] if last is None else [last]) + r["s"].split("\x00")
        return line[-1], (r["conv_id"], sum(a + b not in ("su", "ua", "au") for a, b in zip(line, line[1:])))

    illegal = _stream(pairs, F.col("chunk").asc(), neighbours, _fields(conv_id=_LONG, illegal=_LONG)).groupBy("conv_id").agg(F.sum("illegal").alias("illegal"))
    wide = lambda c: c.cast("decimal(38,0)")
    distinct = turns.filter("turn is not null").groupBy("conv_id", "turn").count().groupBy("conv_id").agg(F.least(wide(F.max("turn")) - wide(F.min("turn")) + 1 - F.count("*"), wide(F.lit((1 << 63) - 1))).cast("long").alias("gaps"))
    count = lambda k: F.count_if(F.col("fault") == k)
    facts = turns.groupBy("conv_id").agg(count(0).alias("blank"), count(1).alias("duplicate"), count(2).alias("truncated"))
    cost = picked.filter("cost is not null").select("conv_id", "cost")
    for more in (illegal, distinct, cost):
        facts = facts.withColumnRenamed("conv_id", "c").join(more, F.col("c").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").withColumnRenamed("c", "conv_id")
    facts = written(facts.withColumn("gaps", F.coalesce("gaps", F.lit(0).cast("long"))), "turns-facts")
    # messages of each chunk
    said = F.array_sort(F.collect_list(F.struct("at", "role", "text")))  # CHUNK turns
    texts = turns.groupBy("conv_id", "chunk", "chunks").agg(said.alias("m"))
    on = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id"))
    pieces = texts.alias("t").join(picked.drop("cost").alias("k"), on("t", "k") & (F.col("t.chunk") == F.col("k.chunk"))).select("t.*", "audit", "entry").alias("r").join(facts.alias("f"), on("r", "f")).select("r.*", *_COUNTS)

    def played(r):
        messages = replay([(x["role"], x["text"]) for x in r["m"]], r["audit"], r["entry"])
        return (r["conv_id"], *[r[c] for c in _COUNTS], r["audit"], r["chunk"], r["chunks"], [{"role": a, "text": b} for a, b in messages])

    return _each(pieces, played, REPAIRED)


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, chunk, chunks and messages (role, text) of conversations.

    rows: conv_id, turn, role, text and copies (adjacent ones; a row of 0 copies only names its conversation). Conversations of up to
    DIRECT_ROWS rows are one row; longer ones a row for each chunk, with the audit of that chunk and the same counts."""
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.col("copies").cast("int").alias("copies"))
    size = rows.groupBy("conv_id").agg(F.sum("copies").alias("n"), F.sum(F.length("text") * F.col("copies")).alias("chars"))
    large = written(size.filter((F.col("n") > DIRECT_ROWS) | (F.col("chars") > DIRECT_CHARS)).select(F.col("conv_id").alias("large_id")), "turns-large")
    none = large.isEmpty()
    sent = sent_if_small(large, 100_000)
    own = F.col("conv_id").eqNullSafe(F.col("large_id"))
    short = rows if none else rows.join(sent, own, "left_anti")
    out = _direct(short.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"))
    return out if none else out.unionByName(_in_chunks(rows.join(sent, own, "left_semi")))


def audited(pieces: DataFrame) -> DataFrame:
    """A row for each conversation of repair: its counts, whole audit and the hash of its messages. Messages of several chunks are hashed as a stream."""
    pieces = written(pieces, "turns-repaired")
    lines = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    cols = ["conv_id", *_COUNTS, "audit"]
    whole = pieces.filter("chunks = 1").select(*cols, F.sha2(lines, 256).alias("repaired_sha256"))
    several = pieces.filter("chunks > 1")
    if several.isEmpty():
        return whole

    def run(batches):
        import pyarrow as pa

        state = None
        for batch in batches:
            ready = []
            for r in batch.to_pylist():
                if r["chunk"] == 0:
                    state, any_ = hashlib.sha256(), False
                for m in r["messages"]:
                    state.update((("\n" if any_ else "") + m["role"] + ":" + m["text"]).encode())
                    any_ = True
                if r["chunk"] == r["chunks"] - 1:
                    ready.append({"h_id": r["conv_id"], "repaired_sha256": state.hexdigest()})
            yield pa.RecordBatch.from_pylist(ready, schema=pa.schema([("h_id", pa.int64()), ("repaired_sha256", pa.string())]))

    hashes = several.select("conv_id", "chunk", "chunks", "messages").repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(run, "h_id long, repaired_sha256 string")
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "audit"))), lambda x: x["audit"]), "")  # one value of the result
    joined = several.groupBy("conv_id", *_COUNTS).agg(audit.alias("audit"))
    return whole.unionByName(joined.join(hashes, F.col("conv_id").eqNullSafe(F.col("h_id"))).select(*cols, "repaired_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies of conversations' rows, damaged by the CRC of id and turn: lost, emptied, without signs that end a sentence, repeated, or said by the user."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    k = F.crc32(key.cast("binary")) % 20
    return rows.select("conv_id", "turn", F.when(k == 4, "user").otherwise(role).alias("role"), F.when(k <= 1, "").when(k == 2, F.translate(text, ENDS, "")).otherwise(text).alias("text"), F.when(k == 0, 0).when(k == 3, 2).otherwise(1).alias("copies"))

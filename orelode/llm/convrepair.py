"""Conversation structure repair by A* on the edit lattice (operator 13).

A conversation's rows, in order of turn, are edited into the role grammar
``(s?(ua)+)?`` at the least cost: keep 0, rerole to user or assistant 2, delete 3,
insert an empty user or assistant turn 2, and 1 for a truncated row that stays.
Blank and duplicate rows must go. A state is (next row, last role given); A* opens
states by (cost plus heuristic, audit), the heuristic being the suffix sum of 3 for
each row that must go and 1 for each truncated row, which is consistent. As the
letters of an audit tell the state that it leads to, and of two audits of equal
cost for one state neither begins the other, the first audit that reaches the end
is the least by ASCII among the cheapest.

Conversations of up to ``BLOCK`` rows are dealt by id, sorted, and read as a stream.
Longer ones, of any length, are ranked over all tasks and cut in blocks of rows; A*
finds the least (cost, audit) from every state to every state of a block, and blocks
are joined like matrices, ``FAN_IN`` at a time over all tasks. Duplicates are found by
the least place of each role and text, summed up before it is joined. Both ways give
equal results. Only what is one value of the result goes through one task: a
conversation's audit, and the stream of its repaired turns that is hashed.

Cases: a null conv_id is a conversation of its own, a null turn comes first, null
roles and texts are one space. Rows of one turn are ordered by role and text, so
repeated rows are neighbours; which of them is the duplicate can't be told apart.
Conversations whose rows are all gone give zeros and empty strings, empty tables an
empty result. Texts are read whole, whatever their length. Other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.functions.ordered import ranked
from orelode.llm.common import cut_lineage, table

#: Rows of a conversation, and of a block of a longer one, that are searched at once.
BLOCK = 1024
#: Blocks that one task joins.
FAN_IN = 16
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
SPACE = " \t\n\x0b\x0c\r"
NAMES = {"u": "user", "a": "assistant"}
START, SYSTEM, USER, ASSISTANT = range(4)
#: The role grammar: which initial leads from a state to which.
GRAMMAR = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
DONE = (START, ASSISTANT)
LEGAL = {"su", "ua", "au"}
FAULTS = ("blank", "duplicate", "truncated")


def search(rows: list[tuple[str, str]], entry: int = START, exits: tuple[int, ...] = DONE, every: bool = False) -> dict[int, tuple[int, str]]:
    """{state: (cost, audit)} of the cheapest edits of (initial, fault) rows from a state to the best of ``exits``, or to every one that can be reached."""
    rest = [0]
    for _, fault in reversed(rows):
        rest.append(rest[-1] + (DELETE if fault in ("blank", "duplicate") else TRUNCATED if fault == "truncated" else 0))
    rest.reverse()
    open_, closed, found = [(rest[0], "", 0, entry)], set(), {}
    while open_ and len(found) < (len(exits) if every else 1):
        f, audit, i, state = heapq.heappop(open_)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        cost = f - rest[i]
        if i == len(rows) and state in exits:
            found[state] = (cost, audit)
        to = GRAMMAR[state]
        moves = [(INSERT, "I", i, to[r]) for r in NAMES if r in to]
        if i < len(rows):
            initial, fault = rows[i]
            moves.append((DELETE, "D", i + 1, state))
            if fault not in ("blank", "duplicate"):
                stays = TRUNCATED if fault == "truncated" else 0
                moves += [(REROLE + stays, "R", i + 1, to[r]) for r in NAMES if r in to]
                if initial in to:
                    moves.append((KEEP + stays, "K", i + 1, to[initial]))
        for price, letter, j, then in moves:
            if (j, then) not in closed:
                heapq.heappush(open_, (cost + price + rest[j], audit + letter, j, then))
    return found


def turns_of(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The repaired (role, text) turns; an odd number of them begins with the system's."""
    at = -((len(audit) - audit.count("D")) % 2)
    for letter in audit:
        role, text = next(rows) if letter != "I" else ("", "")
        if letter == "D":
            continue
        yield (role if letter == "K" else NAMES["ua"[at % 2]]), text
        at += 1


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): rows damaged by the hash of ``conv_id:turn`` modulo 20; what was dropped is marked, so that its conversation is still known."""
    one_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    chance = F.pmod(F.crc32(F.concat(one_space("conv_id"), F.lit(":"), one_space("turn")).cast("binary")), F.lit(20))
    text = F.when(F.col("h") <= 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), one_space("role").alias("role"), one_space("text").alias("text"), chance.alias("h"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("h") == 4, "user").otherwise(F.col("role")), "gone": F.col("h") == 0})
    return rows.withColumn("copy", F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("h", "copy")


def _marked(rows: DataFrame) -> DataFrame:
    """Rows with the faults that can be told from a row alone."""
    last = F.substring(F.rtrim(F.col("text"), F.lit(SPACE)), -1, 1)
    fault = F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    return rows.withColumn("fault", fault)


def _summary(key: str) -> str:
    return f"{key}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _by_conversation(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """(key, rows) of each run of equal keys; rows are read as they are asked for, in turn."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    ahead = next(rows, None)
    while ahead is not None:
        key = ahead[: len(keys)]

        def run() -> Iterator[tuple]:
            nonlocal ahead
            while ahead is not None and ahead[: len(keys)] == key:
                yield ahead[len(keys) :]
                ahead = next(rows, None)

        rest = run()
        yield key, rest
        for _ in rest:
            pass


def _repair_short(rows: list[tuple]) -> dict:
    """The summary and the turns of a conversation of (turn, role, text, gone, fault) rows in order."""
    present = [(turn, role, text, fault) for turn, role, text, gone, fault in rows if not gone]
    seen: set[tuple[str, str]] = set()
    faults = []
    for _, role, text, fault in present:
        faults.append("duplicate" if fault != "blank" and (role, text) in seen else fault)
        seen.add((role, text))
    turns = {t for t, *_ in present if t is not None}
    initials = [r[1][:1] for r in present]
    cost, audit = min(search(list(zip(initials, faults))).values())
    said = list(turns_of(audit, ((r[1], r[2]) for r in present)))
    return {"gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, **{f: faults.count(f) for f in FAULTS}, "illegal": illegal_pairs(initials), "cost": cost, "audit": audit, "turns": said}


def repair_short(rows: DataFrame) -> DataFrame:
    """(conv_id, summary, turns array<struct<role, text>>) of conversations of (conv_id, turn, role, text, gone) rows, each of which fits in a task."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    out = f"{_summary(f'conv_id {kind}')}, turns array<struct<role: string, text: string>>"

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, schema, size = [], None, 0
        for (conv,), of in _by_conversation(batches, ["conv_id"]):
            row = _repair_short(list(of))
            schema = schema or pa.schema([("conv_id", arrow_kind), *[(c, pa.int64()) for c in ("gaps", *FAULTS, "illegal", "cost")], ("audit", pa.string()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])
            size += sum(len(t) for _, t in row["turns"])
            done.append({"conv_id": conv, **row, "turns": [{"role": r, "text": t} for r, t in row["turns"]]})
            if len(done) == 1000 or size > 1 << 23:
                yield pa.RecordBatch.from_pylist(done, schema)
                done, size = [], 0
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_kind = to_arrow_type(rows.schema["conv_id"].dataType)
    dealt = _marked(rows).select("conv_id", "turn", "role", "text", "gone", "fault").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(repair, out)


CELLS = "key string, block bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, entry array<int>, leaves array<int>, cost array<bigint>, audit array<string>"


def _block_cells(rows: pd.DataFrame) -> pd.DataFrame:
    """One row: the cheapest edits of a block from every state to every state."""
    rows = rows.sort_values("place")
    initials, faults = rows["initial"].tolist(), rows["fault"].tolist()
    cells = [(a, b, cost, audit) for a in range(4) for b, (cost, audit) in search(list(zip(initials, faults)), a, (0, 1, 2, 3), True).items()]
    return _cells_row(rows["key"].iat[0], int(rows["block"].iat[0]), [faults.count(f) for f in FAULTS], illegal_pairs(initials), initials[0], initials[-1], cells)


def _cells_row(key: str, block: int, faults: list[int], illegal: int, first: str, last: str, cells: list[tuple]) -> pd.DataFrame:
    sides = [list(c) for c in zip(*cells)]
    return pd.DataFrame([[key, block, *faults, illegal, first, last, *sides]], columns=[c.split()[0] for c in CELLS.split(", ")])


def _joined_cells(rows: pd.DataFrame) -> pd.DataFrame:
    """Neighbouring blocks as one."""
    whole = None
    for r in rows.sort_values("block").itertuples(index=False):
        cells = {(a, b): (c, audit) for a, b, c, audit in zip(r.entry, r.leaves, r.cost, r.audit)}
        if whole is None:
            whole, faults, illegal, first, last = cells, [r.blank, r.duplicate, r.truncated], r.illegal, r.first, r.last
            continue
        joined: dict[tuple[int, int], tuple[int, str]] = {}
        for (a, m), (c, x) in whole.items():
            for b in range(4):
                if (m, b) in cells:
                    d, y = cells[m, b]
                    if (a, b) not in joined or c + d <= joined[a, b][0]:
                        joined[a, b] = min(joined.get((a, b), (c + d, x + y)), (c + d, x + y))
        faults, illegal = [p + q for p, q in zip(faults, (r.blank, r.duplicate, r.truncated))], illegal + r.illegal + (last + r.first not in LEGAL)
        whole, last = joined, r.last
    return _cells_row(rows["key"].iat[0], int(rows["block"].min() // FAN_IN), [int(f) for f in faults], int(illegal), first, last, [(a, b, int(c), x) for (a, b), (c, x) in whole.items()])


def repair_long(rows: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """((conv_id, key, summary), (key, at, role, text)) of conversations of any length; turns of a key come in order within a partition."""
    key = F.concat(F.when(F.col("conv_id").isNull(), "n").otherwise("v"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    known = cut_lineage(rows.groupBy(key.alias("key")).agg(F.first("conv_id").alias("conv_id")))
    present = _marked(rows.where(~F.col("gone"))).withColumns({"key": key, "own": F.monotonically_increasing_id()})
    order = [F.col(c) for c in ("key", "turn", "role", "text", "own")]
    placed = cut_lineage(ranked(present.select("key", "turn", "role", "text", "fault", "own"), order, "place").drop("own"))
    narrow = placed.select("key", "turn", "place", F.substring("role", 1, 1).alias("initial"), "fault", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("said"))
    firsts = narrow.groupBy("key", "said").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "said", "first")
    told = narrow.join(firsts, ["key", "said"], "left")
    again = (F.col("fault") != "blank") & F.coalesce(F.col("place") > F.col("first"), F.lit(False))
    told = told.select("key", "place", "initial", F.when(again, "duplicate").otherwise(F.col("fault")).alias("fault"), F.floor(F.col("place") / block).alias("block"))
    cells = cut_lineage(told.groupBy("key", "block").applyInPandas(_block_cells, CELLS))
    while not cells.groupBy("key").count().where("count > 1").isEmpty():
        cells = cut_lineage(cells.withColumn("upper", F.floor(F.col("block") / FAN_IN)).groupBy("key", "upper").applyInPandas(lambda rows: _joined_cells(rows.drop(columns="upper")), CELLS))
    ends = F.arrays_zip("entry", "leaves", "cost", "audit")
    best = F.array_min(F.transform(F.filter(ends, lambda c: (c["entry"] == START) & c["leaves"].isin(*DONE)), lambda c: F.struct(c["cost"].alias("cost"), c["audit"].alias("audit"))))
    found = cells.select("key", *FAULTS, "illegal", best.alias("best"))
    gaps = placed.groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    summary = known.join(gaps, "key", "left").join(found, "key", "left").select("conv_id", "key", zero("gaps"), *[zero(f) for f in FAULTS], zero("illegal"), F.coalesce("best.cost", F.lit(0).cast("bigint")).alias("cost"), F.coalesce("best.audit", F.lit("")).alias("audit"))
    summary = cut_lineage(summary)

    def say(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.string()), ("at", pa.int64()), ("role", pa.string()), ("text", pa.string())])
        for (k,), of in _by_conversation(batches, ["key"]):
            audit = next(of)[1]
            turns = turns_of(audit, ((role, text) for _, _, role, text in of))
            out, size = [], 0
            for at, (role, text) in enumerate(turns):
                out.append((k, at, role, text))
                size += len(text)
                if len(out) == 1000 or size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    heads = summary.select("key", F.lit(-1).cast("bigint").alias("place"), "audit", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    lines = heads.unionByName(placed.select("key", "place", F.lit(None).cast("string").alias("audit"), "role", "text"))
    turns = lines.repartition("key").sortWithinPartitions("key", "place").mapInArrow(say, "key string, at bigint, role string, text string")
    return summary, turns


def by_length(rows: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame | None]:
    """The rows of conversations of up to ``block`` rows, and of longer ones if there are any."""
    long_ = cut_lineage(rows.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > block).select(F.col("conv_id").alias("long_id")))
    if long_.isEmpty():
        return rows, None
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    return rows.join(long_, same, "left_anti"), rows.join(long_, same, "left_semi")


def repaired_turns(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, at, role, text): the turns of all repaired conversations, from (conv_id, turn, role, text, gone) rows."""
    short, long_ = by_length(rows, block)
    turns = repair_short(short).select("conv_id", F.posexplode("turns").alias("at", "turn")).select("conv_id", F.col("at").cast("bigint").alias("at"), "turn.*")
    if long_ is None:
        return turns
    summary, said = repair_long(long_, block)
    return turns.unionByName(said.join(summary.select("key", "conv_id"), "key").drop("key"))


def _digest_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, repaired_sha256) of turns in order."""
    for (k,), of in _by_conversation(batches, ["key"]):
        hashed = hashlib.sha256()
        for at, role, text in of:
            hashed.update(f"{chr(10) if at else ''}{role}:{text}".encode())
        yield pa.RecordBatch.from_pydict({"key": [k], "repaired_sha256": [hashed.hexdigest()]})


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of (conv_id, turn, role, text, gone) rows."""
    short, long_ = by_length(rows, block)
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    done = repair_short(short).withColumn("repaired_sha256", F.sha2(F.array_join(lines, "\n"), 256)).drop("turns")
    if long_ is None:
        return done
    summary, turns = repair_long(long_, block)
    hashed = turns.mapInArrow(_digest_turns, "key string, repaired_sha256 string")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return done.unionByName(summary.join(hashed, "key", "left").drop("key").withColumn("repaired_sha256", F.coalesce("repaired_sha256", nothing)))


def op13_convrepair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults after the damage, its cheapest repair, and the digest of the repaired turns."""
    return repair(damage(table(spark, sf_dir, "conversations")))

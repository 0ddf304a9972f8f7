"""Repair of conversation structure by cost layers.

The initials of a conversation's roles should follow the grammar (s?(ua)+)?.  Its four
states (nothing yet, after s, after u, after a) are the bits of a set.  For each turn and each
cost k from 0 on, a layer holds the states from which the turns from here on can be mended for at
most k: as in approximate matching after Wu and Manber, layer k of a turn comes from layers k, k - 1,
k - 2 and k - 3 of the next turn and layer k - 2 of its own.  The first layer of the first turn that
holds the start state gives the cost; a trace through the bits that takes the least letter first gives
the least audit.

The layers of a turn differ from those of another one only by a shift of the cost and by one of a few
patterns (`machine` lists them all), as any two states lie a bounded cost apart.  So a run of turns is a small
table: from the pattern behind it to the pattern before it, and from a state before it to the state behind it.
That is what makes long conversations safe: rows are dealt out in ranges of (conversation, turn), cut
into segments of at most SEGMENT turns, and only one table per segment meets the others of its conversation.

Edits: Keep 0; Rerole to user or assistant 2; Delete 3, which blank and duplicate turns need; Insert an empty
turn of user or assistant 2; a truncated turn that stays costs 1 more.  A turn's first fault counts: blank (nothing
but blanks), duplicate (its role and text were seen earlier in the conversation), truncated (its last character
that is no blank is none of .!?).

Defined results: a null conversation id is one conversation; null turns come first; turns of equal number are
ordered by role and text; null roles and texts are one blank; repeated rows are turns of their own (so the later
ones are duplicates); very long texts are read whole; a conversation without turns has no fault, cost 0 and an empty
audit; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamframe.llm.kernels import in_batches
from loamframe.storage import Scratch, written

#: Turns of a segment, at most.
SEGMENT = 4096
BLANKS = " \t\n\x0b\x0c\r"
#: Costs of edits and of a truncated turn that stays; fixed values.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States as bits: nothing yet, after s, after u, after a.
START, LED, ASKED, ANSWERED, FULL = 1, 2, 4, 8, 15
ACCEPTING = START | ANSWERED
ROLE_OF = ("user", "user", "assistant", "user")  # what a new or reroled turn is in each state
NEXT = (2, 2, 3, 2)  # and the state behind it
#: Faults of a turn and classes of its initial; a turn's kind is 4 * fault + initial.
FAULTS, INITIALS = "-tbd", "suax"


def _into(bits: int) -> int:
    """States from which a turn of the fitting role leads into bits."""
    return (START | LED | ANSWERED if bits & ASKED else 0) | (ASKED if bits & ANSWERED else 0)


def _kept(initial: str, bits: int) -> int:
    """States from which a kept turn leads into bits."""
    if initial == "s":
        return START if bits & LED else 0
    if initial == "u":
        return START | LED | ANSWERED if bits & ASKED else 0
    return ASKED if initial == "a" and bits & ANSWERED else 0


def _layer(layers: tuple[int, ...], k: int) -> int:
    return 0 if k < 0 else layers[min(k, len(layers) - 1)]


def _with_inserts(direct) -> tuple[int, ...]:
    """Layers by rising cost until all states are in, from what each cost gives without an insert first."""
    out: list[int] = []
    while not out or out[-1] != FULL:
        k = len(out)
        out.append(direct(k) | _layer(tuple(out), k - 1) | _into(_layer(tuple(out), k - INSERT) if k >= INSERT else 0))
    return tuple(out)


END_LAYERS = _with_inserts(lambda k: ACCEPTING)


def _before(kind: int, layers: tuple[int, ...]) -> tuple[int, ...]:
    """Layers before a turn of this kind, from those behind it."""
    fault, initial = FAULTS[kind // 4], INITIALS[kind % 4]
    if fault in "bd":
        return _with_inserts(lambda k: _layer(layers, k - DELETE))
    stays = TRUNCATED if fault == "t" else 0
    return _with_inserts(
        lambda k: _kept(initial, _layer(layers, k - stays)) | _into(_layer(layers, k - REROLE - stays)) | _layer(layers, k - DELETE)
    )


def _first(layers: tuple[int, ...], state: int) -> int:
    """The first layer that holds a state."""
    return next(k for k, bits in enumerate(layers) if bits >> state & 1)


def _trace(kind: int, before: tuple[int, ...], behind: tuple[int, ...], state: int) -> tuple[str, int]:
    """The least letters that take a state across a turn at its cost, and the state behind it."""
    fault, initial = FAULTS[kind // 4], INITIALS[kind % 4]
    stays = TRUNCATED if fault == "t" else 0
    letters = ""
    while True:
        cost = _first(before, state)
        if _layer(behind, cost - DELETE) >> state & 1:
            return letters + "D", state
        if cost >= INSERT and _layer(before, cost - INSERT) >> NEXT[state] & 1:
            letters, state = letters + "I", NEXT[state]
            continue
        own = {"s": 1, "u": 2, "a": 3}.get(initial)
        if own is not None and _kept(initial, 1 << own) >> state & 1 and _layer(behind, cost - stays) >> own & 1:
            return letters + "K", own
        return letters + "R", NEXT[state]


class Machine(NamedTuple):
    """All patterns of layers; pattern 0 is that behind the last turn."""

    patterns: list[tuple[int, ...]]
    before: np.ndarray  # [kind, pattern behind] -> pattern before
    shift: np.ndarray  # [kind, pattern behind] -> cost that the pattern before leaves out
    state: np.ndarray  # [kind, pattern behind, state] -> state behind
    letters: list[list[list[str]]]


@lru_cache(1)
def machine() -> Machine:
    kinds = range(len(FAULTS) * len(INITIALS))
    patterns, number = [END_LAYERS], {END_LAYERS: 0}
    before, shift, state, letters = [], [], [], []
    for behind in patterns:  # grows on the way
        row = ([], [], [], [])
        for kind in kinds:
            full = _before(kind, behind)
            low = next(k for k, bits in enumerate(full) if bits)
            if full[low:] not in number:
                number[full[low:]] = len(patterns)
                patterns.append(full[low:])
            traced = [_trace(kind, full, behind, s) for s in range(4)]
            for out, x in zip(row, (number[full[low:]], low, [s for _, s in traced], [t for t, _ in traced])):
                out.append(x)
        for table, x in zip((before, shift, state, letters), row):
            table.append(x)
    turned = [[[letters[p][kind][s] for s in range(4)] for p in range(len(patterns))] for kind in kinds]
    return Machine(patterns, np.array(before).T.copy(), np.array(shift).T.copy(), np.array(state).transpose(1, 0, 2).copy(), turned)


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows with faults of known kinds, by crc32 of conversation and turn: 0 drops a row, 1 empties its text, 2 takes its .!?, 3 repeats it, 4 makes its role user."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(one(conv_col), F.lit(":"), one(turn_col)).cast("binary")) % 20
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), one(role_col).alias("role"), one(text_col).alias("text"), fault.alias("fault")).where("fault <> 0")
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"),
    ).drop("again")


def _number(batches: Iterator[pa.RecordBatch], segment: int) -> Iterator[pa.RecordBatch]:
    """Add seg and pos to sorted rows: a segment ends with its conversation or after so many turns."""
    seg, at, last = TaskContext.get().partitionId() << 32, 0, ...
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column("conv").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        fresh = np.ones(len(codes), dtype=bool)
        fresh[1:] = codes[1:] != codes[:-1]
        fresh[0] = last is ... or batch.column("conv")[0].as_py() != last
        index = np.arange(len(codes))
        start = np.maximum.accumulate(np.where(fresh, index, -1))
        pos = index - start
        pos[start < 0] = index[start < 0] + at
        seg_of = seg + np.cumsum(pos % segment == 0)
        seg, at, last = int(seg_of[-1]), int(pos[-1]) + 1, batch.column("conv")[-1].as_py()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seg_of, pa.int64()), pa.array((pos % segment).astype(np.int32))], [*batch.schema.names, "seg", "pos"])


def _kinds(initials: str, faults: str) -> np.ndarray:
    table = np.zeros(256, dtype=np.int64)
    for k, c in enumerate(INITIALS):
        table[ord(c)] = k
    first = table[np.frombuffer(initials.encode(), dtype=np.uint8)]
    for k, c in enumerate(FAULTS):
        table[ord(c)] = 4 * k
    return first + table[np.frombuffer(faults.encode(), dtype=np.uint8)]


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each segment's tables: pattern before and cost by pattern behind, state behind by pattern and state."""
    m = machine()
    n = len(m.patterns)
    for batch in batches:
        maps, costs, states = [], [], []
        for initials, faults in zip(batch.column("initials").to_pylist(), batch.column("faults").to_pylist()):
            kinds = _kinds(initials, faults)
            pattern, cost, behind = np.arange(n), np.zeros(n, dtype=np.int64), []
            for kind in kinds[::-1]:
                behind.append(pattern)
                cost = cost + m.shift[kind, pattern]
                pattern = m.before[kind, pattern]
            state = np.tile(np.arange(4), (n, 1))
            for kind, p in zip(kinds, reversed(behind)):
                state = m.state[kind, p[:, None], state]
            maps.append(pattern.tolist())
            costs.append(cost.tolist())
            states.append(state.ravel().tolist())
        yield pa.RecordBatch.from_arrays([batch.column("seg"), pa.array(maps, pa.list_(pa.int32())), pa.array(costs, pa.list_(pa.int64())), pa.array(states, pa.list_(pa.int32()))], ["seg", "map", "cost", "states"])


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation: each segment's pattern behind and state before, and the cost."""
    m = machine()
    for batch in batches:
        out = {k: [] for k in ("seg", "pattern", "state", "last", "total")}
        for segments in batch.column("segments").to_pylist():
            pattern, total, behind = 0, 0, []
            for s in reversed(segments):
                behind.append(pattern)
                total += s["cost"][pattern]
                pattern = s["map"][pattern]
            total += _first(m.patterns[pattern], 0)
            state = 0
            for s, p in zip(segments, reversed(behind)):
                for k, x in zip(out, (s["seg"], p, state, s is segments[-1], total)):
                    out[k].append(x)
                state = s["states"][4 * p + state]
        yield pa.RecordBatch.from_arrays([pa.array(out["seg"], pa.int64()), pa.array(out["pattern"], pa.int32()), pa.array(out["state"], pa.int32()), pa.array(out["last"], pa.bool_()), pa.array(out["total"], pa.int64())], list(out))


_EDIT = pa.struct([("edit", pa.string()), ("role", pa.string())])


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per segment the audit and, per turn, its edits with the new roles."""
    m = machine()
    for batch in batches:
        audits, edits = [], []
        for initials, faults, pattern, state, last in zip(*(batch.column(c).to_pylist() for c in ("initials", "faults", "pattern", "state", "last"))):
            kinds = _kinds(initials, faults).tolist()
            behind = []
            for kind in reversed(kinds):
                behind.append(pattern)
                pattern = int(m.before[kind, pattern])
            audit, turns = [], []
            for k, (kind, p) in enumerate(zip(kinds, reversed(behind))):
                letters, to = m.letters[kind][p][state], int(m.state[kind, p, state])
                done = []
                for letter in letters:
                    done.append({"edit": letter, "role": ROLE_OF[state] if letter in "IR" else None})
                    state = NEXT[state] if letter in "IR" else state
                state = to
                if last and k == len(kinds) - 1:
                    while not ACCEPTING >> state & 1:
                        letters += "I"
                        done.append({"edit": "I", "role": ROLE_OF[state]})
                        state = NEXT[state]
                audit.append(letters)
                turns.append(done)
            audits.append("".join(audit))
            edits.append(turns)
        yield pa.RecordBatch.from_arrays([batch.column("seg"), pa.array(audits, pa.string()), pa.array(edits, pa.list_(pa.list_(_EDIT)))], ["seg", "audit", "edits"])


class Repair(NamedTuple):
    turns: DataFrame  # conv_id, seg, pos, sub (their order), edit, role, text
    report: DataFrame  # conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment: int = SEGMENT) -> Repair:
    """The turns of repaired conversations, and what was found and done in each conversation with turns."""
    spark = conversations.sparkSession
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), one(role_col).alias("role"), one(text_col).alias("text"))
    # ranges are cut by a sample that comes to the driver, so it holds the beginnings of texts only
    rows = rows.repartitionByRange(F.col("conv"), F.col("turn"), F.col("role"), F.substring("text", 1, 64)).sortWithinPartitions("conv", "turn", "role", "text")
    rows = in_batches(rows, partial(_number, segment=segment), f"{_ddl(rows)}, seg long, pos int")
    tail = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    rows = rows.withColumns(
        {
            "said": F.when(tail == "", "b").when(F.substring(tail, -1, 1).isin(".", "!", "?"), "-").otherwise("t"),
            "initial": F.when(initial.isin("s", "u", "a"), initial).otherwise("x"),
            "digest": F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)),
        }
    )
    rows = written(rows, "turns")
    with Scratch(spark) as scratch:
        firsts = rows.where("said <> 'b'").groupBy("conv", "digest").agg(F.min(F.struct("seg", "pos")).alias("first"))
        firsts = firsts.select("first.seg", "first.pos", F.lit(True).alias("is_first"))
        marked = rows.select("conv", "seg", "pos", "turn", "initial", "said").join(firsts, ["seg", "pos"], "left")
        fault = F.when(F.col("said") == "b", "b").when(F.col("is_first").isNull(), "d").otherwise(F.col("said"))
        chain = F.array_sort(F.collect_list(F.struct("pos", "initial", fault.alias("fault"))))
        segments = marked.groupBy("seg").agg(
            F.first("conv").alias("conv"), chain.alias("chain"), F.min("turn").alias("low"), F.max("turn").alias("high"), F.size(F.collect_set("turn")).cast("long").alias("n_turns")
        )
        segments = segments.select("seg", "conv", F.array_join("chain.initial", "").alias("initials"), F.array_join("chain.fault", "").alias("faults"), "low", "high", "n_turns")
        segments = scratch.table(segments, "segments")
        tables = in_batches(segments.select("seg", "initials", "faults"), _summaries, "seg long, map array<int>, cost array<long>, states array<int>")
        chains = segments.select("seg", "conv").join(tables, "seg").groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("seg", "map", "cost", "states"))).alias("segments"))
        resolved = in_batches(chains.select("segments"), _resolve, "seg long, pattern int, state int, last boolean, total long")
        found = in_batches(segments.join(resolved, "seg").select("seg", "initials", "faults", "pattern", "state", "last"), _edit, "seg long, audit string, edits array<array<struct<edit:string,role:string>>>")
        found = written(segments.join(found, "seg").join(resolved.select("seg", "total"), "seg"), "edits")
    edits = found.select("seg", F.posexplode("edits").alias("pos", "edits"))
    turns = rows.select("conv", "seg", "pos", "role", "text").join(edits, ["seg", "pos"])
    turns = turns.select("conv", "seg", "pos", "role", "text", F.posexplode("edits").alias("sub", "e")).where("e.edit <> 'D'")
    turns = turns.select(F.col("conv").alias(conv_col), "seg", "pos", "sub", "e.edit", F.coalesce("e.role", "role").alias("role"), F.when(F.col("e.edit") == "I", "").otherwise(F.col("text")).alias("text"))
    return Repair(turns, _report(found).withColumnRenamed("conv", conv_col))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def _report(found: DataFrame) -> DataFrame:
    """Sums over a conversation's segments, with what happens where two of them meet."""
    legal = lambda a, b: F.concat(a, b).isin("su", "ua", "au")
    inside = F.size(F.filter(F.sequence(F.lit(1), F.length("initials")), lambda i: (i > 1) & ~legal(F.substring("initials", i - 1, F.lit(1)), F.substring("initials", i, F.lit(1))))).cast("long")
    count = lambda letter: (F.length("faults") - F.length(F.replace("faults", F.lit(letter), F.lit("")))).cast("long")
    each = F.struct("seg", "low", "high", "audit", F.substring("initials", 1, 1).alias("head"), F.substring("initials", -1, 1).alias("tail"))
    sums = found.groupBy("conv").agg(
        F.array_sort(F.collect_list(each)).alias("chain"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.sum("n_turns").alias("n_turns"),
        F.sum(count("b")).alias("blank"),
        F.sum(count("d")).alias("duplicate"),
        F.sum(count("t")).alias("truncated"),
        F.sum(inside).alias("illegal"),
        F.max("total").alias("cost"),
    )
    meets = lambda test: F.size(F.filter(F.sequence(F.lit(1), F.size("chain")), lambda i: (i > 1) & test(F.col("chain")[F.greatest(i - 2, F.lit(0))], F.col("chain")[i - 1]))).cast("long")
    shared = meets(lambda a, b: F.coalesce(a["high"] == b["low"], F.lit(False)))
    return sums.select(
        "conv",
        F.coalesce(F.col("high") - F.col("low") + 1 - (F.col("n_turns") - shared), F.lit(0)).cast("long").alias("gaps"),
        "blank",
        "duplicate",
        "truncated",
        (F.col("illegal") + meets(lambda a, b: ~legal(a["tail"], b["head"]))).alias("illegal"),
        "cost",
        F.array_join("chain.audit", "").alias("audit"),
    )


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest per conversation of sorted lines, one line in memory at a time."""
    last, held, kind = ..., None, None
    for batch in batches:
        kind = batch.schema.field("conv").type
        done: list[tuple] = []
        for conv, line in zip(batch.column("conv").to_pylist(), batch.column("line")):
            if last is ... or conv != last:
                if held is not None:
                    done.append((last, held.hexdigest()))
                last, held = conv, hashlib.sha256()
            else:
                held.update(b"\n")
            held.update(line.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], kind), pa.array([d for _, d in done], pa.string())], ["conv", "digest"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], kind), pa.array([held.hexdigest()], pa.string())], ["conv", "digest"])


def line_digests(turns: DataFrame, line: Column, order: tuple[str, ...] = ("seg", "pos", "sub"), conv_col: str = "conv_id") -> DataFrame:
    """conv_id and the SHA-256 of its lines, joined by line breaks in the given order; lines stream through the hash."""
    lines = turns.select(F.col(conv_col).alias("conv"), *order, line.alias("line"))
    lines = lines.repartition("conv").sortWithinPartitions("conv", *order).select("conv", "line")
    return in_batches(lines, _hash_lines, f"conv {lines.schema['conv'].dataType.simpleString()}, digest string").withColumnRenamed("conv", conv_col)


def digests(conversations: DataFrame, repaired: Repair, conv_col: str = "conv_id") -> DataFrame:
    """The report of every conversation of the table before damage, with the digest of its repaired lines."""
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    lines = line_digests(repaired.turns, F.concat("role", F.lit(":"), "text"), conv_col=conv_col)
    parts = conversations.select(conv_col).distinct().unionByName(repaired.report, allowMissingColumns=True).unionByName(lines, allowMissingColumns=True)
    return parts.groupBy(conv_col).agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("digest"), F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )

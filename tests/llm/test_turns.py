"""Repair of conversation structure, against a search over all edits."""

import hashlib
import heapq
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from loamframe.llm import turnrepair

GRAMMAR = re.compile(r"(s?(ua)+)?")
CONVERSATION = "conv_id long, turn long, role string, text string"


def brute(rows):
    """(faults, cost, audit, lines) by best-first search over audits; rows are (role, text) in order."""
    seen, faults = set(), []
    for role, text in rows:
        kept = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("b" if not kept else "d" if (role, text) in seen else "-" if kept[-1] in ".!?" else "t")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, initials, lines = heapq.heappop(heap)
        if k == len(rows) and GRAMMAR.fullmatch(initials):
            return faults, cost, audit, lines
        state = (k, {"": 0, "s": 1}.get(initials, 2 + (initials[-1:] == "a")))
        if state in done:
            continue
        done.add(state)
        wanted = "a" if initials.endswith("u") else "u"
        name = {"u": "user", "a": "assistant"}[wanted]
        heapq.heappush(heap, (cost + 2, audit + "I", k, initials + wanted, (*lines, f"{name}:")))
        if k < len(rows):
            role, text = rows[k]
            heapq.heappush(heap, (cost + 3, audit + "D", k + 1, initials, lines))
            if faults[k] not in "bd":
                more = cost + (faults[k] == "t")
                if role[:1] and any(GRAMMAR.fullmatch(initials + role[0] + rest) for rest in ("", "a", "ua")):
                    heapq.heappush(heap, (more, audit + "K", k + 1, initials + role[0], (*lines, f"{role}:{text}")))
                heapq.heappush(heap, (more + 2, audit + "R", k + 1, initials + wanted, (*lines, f"{name}:{text}")))


def expected(rows):
    """The digest's columns of one conversation from its (turn, role, text) rows."""
    rows = sorted(((t is not None, t or 0), r if r is not None else " ", x if x is not None else " ") for t, r, x in rows)
    faults, cost, audit, lines = brute([(r, x) for _, r, x in rows])
    turns = {t for (known, t), _, _ in rows if known}
    initials = [r[:1] for _, r, _ in rows]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        *(faults.count(c) for c in "bdt"),
        sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
        cost,
        audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def found(df, segment=turnrepair.SEGMENT):
    rows = turnrepair.digests(df, turnrepair.repair(df, segment=segment)).collect()
    return {r.conv_id: tuple(r)[1:] for r in rows}


@pytest.mark.parametrize("segment", [1, 3, turnrepair.SEGMENT])
def test_against_search(spark, segment):
    draw = random.Random(7)
    texts = ["Yes.", "No!", "open end", "", " \t", "Why?", "x. ", "other"]
    rows = [
        (c, draw.choice([None, t, t, t + draw.randrange(3)]), draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), draw.choice([*texts, f"text {t}.", f"text {t}", None]))
        for c in range(120)
        for t in range(draw.randrange(1, 9))
    ]
    df = spark.createDataFrame(rows, CONVERSATION)
    by_conv = {c: expected([r[1:] for r in g]) for c, g in itertools.groupby(rows, key=lambda r: r[0])}
    assert found(df, segment) == by_conv


def test_a_long_conversation_and_a_null_id(spark):
    draw = random.Random(3)
    rows = [(None, t, draw.choice(["user", "assistant", "assistant"]), draw.choice(["same.", f"turn {t}.", f"turn {t}"])) for t in range(900)]
    rows += [(5, 1, "user", "word " * 50_000 + "."), (5, 2, "assistant", "é漢😀!")]
    df = spark.createDataFrame(rows, CONVERSATION).repartition(5)
    got = found(df, 64)
    assert got == {None: expected([r[1:] for r in rows[:900]]), 5: expected([r[1:] for r in rows[900:]])}
    assert got[5][5:7] == (0, "KK")


def test_edges(spark):
    empty = spark.createDataFrame([], CONVERSATION)
    assert found(empty) == {} and turnrepair.repair(empty).turns.count() == 0
    rows = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 4, "system", ""), (3, None, None, None)]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], CONVERSATION + ", seg int, pos int, conv string")
    got = found(df)
    assert got[1][1:7] == (0, 1, 0, 1, 3, "KDK")
    assert got[1] == expected([r[1:] for r in rows[:3]])
    assert got[2] == (0, 1, 0, 0, 0, 3, "D", hashlib.sha256(b"").hexdigest()) and got[3][5:7] == (3, "D")
    turns = turnrepair.repair(df).turns.where("conv_id = 1").orderBy("seg", "pos", "sub").collect()
    assert [(r.edit, r.role, r.text) for r in turns] == [("K", "user", "Hi."), ("K", "assistant", "Yes.")]
    # a conversation that loses all its rows to damage stays in the digest
    lost = next(c for c in range(1000) if spark.range(1).select(F.crc32(F.lit(f"{c}:0").cast("binary")) % 20).first()[0] == 0)
    df = spark.createDataFrame([(lost, 0, "user", "Hi.")], CONVERSATION)
    out = turnrepair.digests(df, turnrepair.repair(turnrepair.damaged(df))).collect()
    assert [tuple(r) for r in out] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_patterns_of_layers():
    m = turnrepair.machine()
    assert m.patterns[0] == turnrepair.END_LAYERS and all(p[0] and p[-1] == turnrepair.FULL for p in m.patterns)
    assert all(m.letters[k][p][s][-1] in "DKR" for k in range(16) for p in range(len(m.patterns)) for s in range(4))

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from orelode.llm import convrepair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, key string, place bigint, gaps bigint"
BLANKS = " \t\n\x0b\x0c\r"


def first_faults(rows):
    """Faults of (role, text) rows in order, by the contract's words."""
    out = []
    for k, (role, text) in enumerate(rows):
        seen = text.strip(BLANKS)
        out.append("blank" if not seen else "duplicate" if (role, text) in rows[:k] else "truncated" if seen[-1] not in ".!?" else "")
    return out


def damaged(table):
    out = defaultdict(list)
    for conv, turn, role, text in table:
        known = out[conv]
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        known += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return {c: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, rows in out.items()}


def every_repair(rows):
    """(cost, audit, turns) of all edits with up to two inserted turns at a place."""
    faults = first_faults(rows)
    inserted = [p for n in range(3) for p in itertools.product(("user", "assistant"), repeat=n)]
    edits = []
    for (role, text), fault in zip(rows, faults):
        own = [(3, "D", [])]
        if fault not in ("blank", "duplicate"):
            more = fault == "truncated"
            own += [(more, "K", [(role, text)]), *[(2 + more, "R", [(r, text)]) for r in ("user", "assistant")]]
        edits.append([(c + 2 * len(p), "I" * len(p) + x, [(r, "") for r in p] + t) for p in inserted for c, x, t in own])
    edits.append([(2 * len(p), "I" * len(p), [(r, "") for r in p]) for p in inserted])
    for steps in itertools.product(*edits):
        turns = [t for s in steps for t in s[2]]
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in turns)):
            yield sum(s[0] for s in steps), "".join(s[1] for s in steps), turns


def by_table(rows):
    """(cost, audit, turns) by filling a table row by row, without a heuristic, for conversations of any length."""
    next_role = {"": "su", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}
    best = {"": (0, "", ())}

    def grown(best):
        for _ in range(3):
            for state, (c, x, t) in list(best.items()):
                for r in set(next_role[state]) - {"s"}:
                    new = (c + 2, x + "I", (*t, (full[r], "")))
                    if r not in best or new[:2] < best[r][:2]:
                        best[r] = new
        return best

    best = grown(best)
    for (role, text), fault in zip(rows, first_faults(rows)):
        then = {}
        for state, (c, x, t) in best.items():
            options = [(state, c + 3, x + "D", t)]
            if fault not in ("blank", "duplicate"):
                c += fault == "truncated"
                options += [(r, c + 2, x + "R", (*t, (full[r], text))) for r in set(next_role[state]) - {"s"}]
                options += [(role[:1], c, x + "K", (*t, (role, text)))] if role[:1] and role[:1] in next_role[state] else []
            for to, *new in options:
                if to not in then or tuple(new[:2]) < then[to][:2]:
                    then[to] = tuple(new)
        best = grown(then)
    return min((best[s] for s in ("", "a") if s in best), key=lambda b: b[:2])


def expected(table):
    out = []
    for conv, rows in damaged(table).items():
        said = [r[1:] for r in rows]
        faults, turns = first_faults(said), {r[0] for r in rows if r[0] is not None}
        cost, audit, fixed = by_table(said)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum((a[:1], b[:1]) not in {("s", "u"), ("u", "a"), ("a", "u")} for (a, _), (b, _) in zip(said, said[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, digest))
    return sorted(out, key=str)


def conversations(n, seed, longest=9):
    rng = random.Random(seed)
    out = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool"]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            text = rng.choice(["Yes.", "No!", "And then", "What? ", " ", None, "é 😀.\n", f"Text {turn}."])
            out.append((conv, None if rng.random() < 0.05 else turn + rng.choice([0, 0, 0, 0, 3]), role, text))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, None) for r in rows], SCHEMA).repartition(5)


def test_search_finds_the_least_of_all_repairs():
    rng = random.Random(1)
    for _ in range(60):
        rows = [(rng.choice(["user", "assistant", "system", "", "tool"]), rng.choice(["Yes.", "then", " ", "No!"])) for _ in range(rng.randint(0, 3))]
        cost, audit, turns = min(every_repair(rows), key=lambda e: e[:2])
        assert min(convrepair.search([(r[:1], f) for (r, _), f in zip(rows, first_faults(rows))]).values()) == (cost, audit)
        assert list(convrepair.turns_of(audit, iter(rows))) == turns and by_table(rows) == (cost, audit, tuple(turns))


@pytest.mark.parametrize("block", [2, 1024])
def test_repair_equals_a_table_of_all_states(spark, block):
    rows = [*conversations(60, 5), *[(None, t, "user", f"null {t % 3}") for t in range(7)], *[(777, t, ("user", "assistant")[t % 2], f"Turn {t % 40}") for t in range(90)]]
    got = convrepair.repair(convrepair.damage(frame(spark, rows)), block)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


@pytest.mark.parametrize("block", [3, 1024])
def test_repaired_turns(spark, block):
    rows = conversations(20, 8, 12)
    got = defaultdict(list)
    for r in sorted(convrepair.repaired_turns(convrepair.damage(frame(spark, rows)), block).collect(), key=lambda r: (r["conv_id"], r["at"])):
        got[r["conv_id"]].append((r["role"], r["text"]))
    want = {c: list(by_table([r[1:] for r in rows])[2]) for c, rows in damaged(rows).items()}
    assert dict(got) == {c: t for c, t in want.items() if t}


def test_all_rows_gone_long_texts_and_empty_table(spark, tmp_path):
    gone = next(k for k in range(1000) if all(zlib.crc32(f"{k}:{t}".encode()) % 20 == 0 for t in (0,)))
    rows = [(gone, 0, "user", "x."), (5_000_000, 1, "user", "word " * 50_000), (5_000_000, 2, "assistant", "y" * 100_000)]
    for block in (1, 1024):
        got = {r["conv_id"]: r for r in convrepair.repair(convrepair.damage(frame(spark, rows)), block).collect()}
        assert tuple(got[gone])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
        assert tuple(got[5_000_000]) == next(e for e in expected(rows) if e[0] == 5_000_000)
    frame(spark, []).write.parquet(f"{tmp_path}/conversations.parquet")
    assert convrepair.op13_convrepair(spark, str(tmp_path)).count() == 0

"""Conversation repair against a search over all edit sequences, and the query against plain Python on the whole table."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import repair
from tidemark.llm.common import table
from tidemark.llm.queries import op11_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string"
FACTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
LEGAL = re.compile(r"(s?(ua)+)?")


def brute_audit(rows):
    """Cheapest and then least audit among all sequences with at most three insertions; rows are (initial, fault)."""
    best = None
    for edits in itertools.product("DKR", repeat=len(rows)):
        for n_inserts in range(4):
            for at in itertools.combinations_with_replacement(range(len(rows) + 1), n_inserts):
                letters = []
                for i in range(len(rows) + 1):
                    letters += ["I"] * at.count(i) + ([edits[i]] if i < len(rows) else [])
                cost, options, row = 0, [], 0
                for e in letters:
                    if e == "I":
                        cost, options = cost + 2, [*options, "ua"]
                        continue
                    initial, fault = rows[row]
                    row += 1
                    if e == "D":
                        cost += 3
                        continue
                    if fault in "bd" and fault:
                        cost = None
                        break
                    cost += (2 if e == "R" else 0) + (fault == "t")
                    options.append("ua" if e == "R" else initial)
                if cost is None or (best is not None and (cost, "".join(letters)) >= best):
                    continue
                if any(LEGAL.fullmatch("".join(x)) for x in itertools.product(*options)):
                    best = (cost, "".join(letters))
    return best


def test_lightest_is_the_cheapest_least_audit():
    rnd = random.Random(7)
    for _ in range(250):
        rows = [(rnd.choice("suaau x"[:6]), rnd.choice(["", "", "", "t", "b", "d"])) for _ in range(rnd.randint(0, 4))]
        (found,) = repair.lightest(rows).values()
        assert found == brute_audit(rows), rows


def plain_audit(rows):
    """Lightest derivation row by row, all states at once."""
    now = {0: (0, "")}

    def inserted(states):
        for _ in range(4):
            for q, (c, a) in list(states.items()):
                new = (c + 2, a + "I")
                to = repair._GIVEN[q][1]
                states[to] = min(states.get(to, new), new)
        return states

    for initial, fault in rows:
        after = {}
        for q, (c, a) in inserted(now).items():
            steps = [(q, c + 3, "D")]
            if fault not in ("b", "d"):
                steps.append((repair._GIVEN[q][1], c + 2 + (fault == "t"), "R"))
                if (q, initial) in repair._STEP:
                    steps.append((repair._STEP[q, initial], c + (fault == "t"), "K"))
            for to, cost, letter in steps:
                new = (cost, a + letter)
                after[to] = min(after.get(to, new), new)
        now = after
    now = inserted(now)
    return min(v for q, v in now.items() if q in (0, 3))


def brute(conversations, damage=True):
    spaced = lambda v: " " if v is None else str(v)
    held = {}
    for conv, turn, role, text in conversations:
        rows = held.setdefault(conv, [])
        kind = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20 if damage else 99
        if kind == 0:
            continue
        role, text = spaced(role), spaced(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        rows += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, rows in held.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in rows:
            core = text.strip(" \t\n\x0b\x0c\r")
            faults.append("b" if not core else "d" if (role, text) in seen else "t" if core[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in rows if t is not None]
        initials = [r[1][:1] for r in rows]
        cost, audit = plain_audit(list(zip(initials, faults, strict=True)))
        lines = [f"{r}:{t}" for _, r, t in repair.edited(audit, [(r, t) for _, r, t in rows])]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def as_dict(df):
    return {r["conv_id"]: tuple(r[c] for c in FACTS) for r in df.select("conv_id", *FACTS).collect()}


def test_query_on_the_whole_table(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    found = op11_conversation_repair(spark, sf)
    assert found.count() == len({r[0] for r in rows})
    assert as_dict(found) == brute(rows)


def awkward():
    rnd = random.Random(3)
    rows = [(1, t, ["user", "assistant"][t % 2], f"line {t}.") for t in range(40)]
    rows += [(2, t, rnd.choice(["user", "assistant", "system", "tool", "", None]), rnd.choice(["a.", "b", "", " \t", None, "c!\n", "\u0085"])) for t in range(60)]
    rows += [(3, None, "user", "one."), (3, None, "assistant", "two."), (3, 5, "user", "one."), (3, 5, "assistant", "x"), (3, 5, "assistant", "x")]
    rows += [(None, 1, "user", "hm."), (None, 2, "assistant", "hm."), (4, 1, None, None), (5, 0, "user", "w " * 30_000 + "."), (5, 1, "assistant", "ok."), (6, 3, "system", "s."), (6, 3, "system", "s.")]
    return rows + [(8, t, "user", "the same text.") for t in range(200)]


@pytest.mark.parametrize("chunk", [256, 3])
@pytest.mark.parametrize("damage", [True, False])
def test_awkward_rows_and_run_lengths(spark, chunk, damage):
    df = spark.createDataFrame([(*r, "clash", 1, "c") for r in awkward()], SCHEMA + ", audit string, n int, digest string").repartition(3)
    rows = repair.damaged(df) if damage else df
    assert as_dict(repair.digest(rows, df, chunk)) == brute(awkward(), damage)


def test_all_rows_dropped_and_empty_table(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    df = spark.createDataFrame([(conv, 1, "user", "gone.")], SCHEMA)
    (row,) = repair.digest(repair.damaged(df), df).collect()
    assert tuple(row[c] for c in FACTS) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    none = spark.createDataFrame([], SCHEMA)
    assert repair.digest(repair.damaged(none), none).count() == 0


def test_repaired_rows_read_the_grammar(spark):
    df = spark.createDataFrame(awkward(), SCHEMA)
    rows = repair.repaired(df).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "role"))).alias("rows")).collect()
    assert {r["conv_id"] for r in rows} >= {1, 2, 3, None}
    for r in rows:
        assert LEGAL.fullmatch("".join(x["role"][:1] for x in r["rows"]))

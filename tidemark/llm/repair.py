"""Conversation structure repair by a lightest-derivation agenda.

The roles of a conversation have to read `(s?(ua)+)?` in initials. Repair is a weighted deduction system: an item [i, q] says
that the first i rows were edited and left the grammar in state q, and its weight is (cost, audit), audit being the edits'
initials in order. Knuth's algorithm pops items from an agenda and the first pop of an item is its lightest derivation;
it ends when the goal pops. The agenda orders by (cost, i, audit): every deduction adds cost or consumes a row, so it never
lessens its premise, and of two audits of one item with equal cost neither is the start of the other (only Insert consumes
no row, and it costs), so the order survives what follows. Both are what Knuth asks of superior functions.

A conversation is not one task's work, however long. Rows (without texts) are dealt by range of (conversation, turn, role, text
digest); each run of at most CHUNK rows gives the lightest derivation from each state to each other one, and the few runs of
a conversation are chained. Repeated texts are found by aggregation. Texts meet only in the last step, which streams a
conversation row by row behind its audit; memory holds the audit and a batch.

Edge cases: rows of one turn are taken by role, then by the text's digest; a null turn is first; null role or text is one
space, so such a text is blank; an empty role, like any that does not begin with s, u or a, has to be changed or deleted;
equal rows are all but the first duplicates; a null conversation key is a conversation of its own; very long texts are hashed
once and streamed; an empty table gives no rows; columns other than the four named are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import begin, n_tasks, saved, small_batches

#: Costs of edits, and of leaving a truncated row in.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Rows of one run. The result does not depend on it.
CHUNK = 256
#: Copies of a repeated text's first turn, so that a text that fills a long conversation is joined by many tasks.
SALTS = 16

_SPACE = " \t\n\x0b\x0c\r"
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_STEP = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER, (_USER, "a"): _ASSISTANT, (_ASSISTANT, "u"): _USER}
#: The only role that Rerole or Insert may give in each state, and the state after it.
_GIVEN = {_START: ("user", _USER), _SYSTEM: ("user", _USER), _USER: ("assistant", _ASSISTANT), _ASSISTANT: ("user", _USER)}
_ENDS = (_START, _ASSISTANT)
_LEGAL = ("su", "ua", "au")

#: A row as the search sees it: role initial and first fault ("b" blank, "d" duplicate, "t" truncated, "" none).
Row = tuple[str, str]


def lightest(rows: list[Row], start: int = _START, goal: bool = True) -> dict[int, tuple[int, str]]:
    """State after all rows -> lightest (cost, audit) from the start state; with `goal` only the first accepting one."""
    agenda = [(0, 0, "", start)]
    done: set[tuple[int, int]] = set()
    found: dict[int, tuple[int, str]] = {}
    while agenda:
        cost, i, audit, state = heapq.heappop(agenda)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows):
            if goal and state in _ENDS:
                return {state: (cost, audit)}
            found[state] = (cost, audit)
        given = _GIVEN[state][1]
        if (i, given) not in done:
            heapq.heappush(agenda, (cost + INSERT, i, audit + "I", given))
        if i == len(rows):
            continue
        initial, fault = rows[i]
        heapq.heappush(agenda, (cost + DELETE, i + 1, audit + "D", state))
        if fault not in ("b", "d"):
            extra = TRUNCATED if fault == "t" else 0
            heapq.heappush(agenda, (cost + REROLE + extra, i + 1, audit + "R", given))
            if (kept := _STEP.get((state, initial))) is not None:
                heapq.heappush(agenda, (cost + extra, i + 1, audit + "K", kept))
    return found


def edited(audit: str, rows: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired rows: the audit applied to (role, text) in order; rows are taken one by one."""
    state, rest = _START, iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rest)
        if edit == "D":
            continue
        if edit == "K":
            state = _STEP[state, role[:1]]
        else:
            role, state = _GIVEN[state]
        yield edit, role, text


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of `conversations` after the contract's damage, chosen by crc32(conv_id:turn) % 20."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    role = F.when(kind == 4, "user").otherwise(spaced("role"))
    again = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(again).alias("copy")).drop("copy")


def _read(rows: DataFrame) -> DataFrame:
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text")).withColumn("digest", F.sha2("text", 256))


def _same(a: str, b: str, names: list[str]) -> Column:
    same = F.lit(True)
    for name in names:
        same = same & F.col(f"{a}.{name}").eqNullSafe(F.col(f"{b}.{name}"))
    return same


def kinds(rows: DataFrame) -> DataFrame:
    """One row per different (conv_id, turn, role, text): digest, n equal rows, initial, first fault, and `again`: the text of
    that role was seen at an earlier turn."""
    trimmed = F.rtrim("text", F.lit(_SPACE))
    facts = _read(rows).select("conv_id", "turn", "role", "digest", (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    each = saved(facts.groupBy("conv_id", "turn", "role", "digest").agg(F.count("*").alias("n"), F.max("blank").alias("blank"), F.max("cut").alias("cut")))
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = each.groupBy("conv_id", "role", "digest").agg(F.min(when).alias("first"), F.count("*").alias("turns")).where("turns > 1")
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = each.withColumn("salt", F.pmod(F.xxhash64("turn"), F.lit(SALTS)).cast("int"))
    joined = salted.alias("e").join(first.alias("f"), _same("e", "f", ["conv_id", "role", "digest", "salt"]), "left")
    earlier = F.coalesce(F.struct(F.col("e.turn").isNotNull().alias("known"), F.col("e.turn").alias("turn")) > F.col("f.first"), F.lit(False))
    fault = F.when(F.col("e.blank"), "b").when(earlier, "d").when(F.col("e.cut"), "t").otherwise("")
    return joined.select("e.conv_id", "e.turn", "e.role", "e.digest", "e.n", F.substring("e.role", 1, 1).alias("initial"), fault.alias("fault"))


_RUN = (
    "part int, seq long, whole boolean, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, "
    "least_turn long, most_turn long, first string, last string, paths array<struct<start:int,stop:int,cost:long,audit:string>>"
)


def _run_row(rows: list[Row], turns: list[int | None], whole: bool) -> dict:
    """What the chain has to know of a run: counts, border rows, and the lightest derivations between states."""
    faults = [f for _, f in rows]
    known = [t for t in turns if t is not None]
    starts = (_START,) if whole else range(4)
    paths = [{"start": s, "stop": q, "cost": c, "audit": a} for s in starts for q, (c, a) in lightest(rows, s, whole).items()]
    return {
        "whole": whole, "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"),
        "illegal": sum(a + b not in _LEGAL for (a, _), (b, _) in zip(rows, rows[1:], strict=False)), "turns": len(set(known)),
        "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None, "least_turn": min(known, default=None), "most_turn": max(known, default=None),
        "first": rows[0][0], "last": rows[-1][0], "paths": paths,
    }


def runs(found: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows of `kinds` -> one row per run of at most `chunk` rows of a conversation, in the order (part, seq)."""
    order = ["conv_id", "turn", "role", "digest"]
    dealt = found.repartitionByRange(n_tasks(found.sparkSession), *order).sortWithinPartitions(*order)
    dealt = dealt.select("conv_id", "turn", "n", "initial", "fault", F.spark_partition_id().alias("part"))
    kind = pa.schema([pa.field("part", pa.int32()), pa.field("seq", pa.int64()), pa.field("whole", pa.bool_())] + [pa.field(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn", "least_turn", "most_turn")] + [pa.field("first", pa.string()), pa.field("last", pa.string()), pa.field("paths", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("repair")
        out: list[tuple] = []
        now, rows, turns, seq, opened, part = None, [], [], 0, False, 0

        def close(last: bool, ends: bool) -> None:
            """The run at hand is done; `ends`: the conversation goes on in no later row of this task."""
            nonlocal rows, turns, seq
            if rows:
                whole = ends and not last and seq == 0 and opened  # not first or last of the task, in one run
                out.append((now, {"part": part, "seq": seq} | _run_row(rows, turns, whole)))
            rows, turns, seq = [], [], seq + 1

        def flush(like: pa.Array) -> pa.RecordBatch:
            batch = [pa.array([k for k, _ in out], like), *(pa.array([r[f.name] for _, r in out], f.type) for f in kind)]
            out.clear()
            return pa.RecordBatch.from_arrays(batch, names=["conv_id", *kind.names])

        started, like = False, None
        for batch in batches:
            like = batch.schema.field(0).type
            for key, turn, n, initial, fault, where in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                part = where
                if not started or key != now:
                    if started:
                        close(False, True)
                    opened, now, seq, started = started, key, 0, True
                for i in range(n):
                    if len(rows) == chunk:
                        close(False, False)
                    rows.append((initial, fault if i == 0 or fault == "b" else "d"))
                    turns.append(turn)
            if len(out) >= 1000:
                yield flush(like)
        if started:
            close(True, True)
        if out:
            yield flush(like)

    return dealt.mapInArrow(run, f"conv_id {dict(found.dtypes)['conv_id']}, {_RUN}")


_FACTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def chain(found: DataFrame) -> DataFrame:
    """Rows of `runs` -> one row per conversation: conv_id, gaps, the fault counts, illegal, cost and audit."""
    order = ["conv_id", "part", "seq"]
    dealt = found.repartition(n_tasks(found.sparkSession), "conv_id").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("repair")
        out: list[tuple] = []
        now, state, started, like = None, {}, False, None

        def close() -> None:
            least, most = state["least"], state["most"]
            gaps = 0 if least is None else min(most - least + 1 - state["turns"], (1 << 63) - 1)
            cost, audit = min(v for q, v in state["best"].items() if q in _ENDS)
            out.append((now, gaps, state["blank"], state["duplicate"], state["truncated"], state["illegal"], cost, audit))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            arrays = [pa.array(columns[0], like), *(pa.array(c, pa.int64()) for c in columns[1:7]), pa.array(columns[7], pa.string())]
            return pa.RecordBatch.from_arrays(arrays, names=["conv_id", *_FACTS, "audit"])

        for batch in batches:
            like = batch.schema.field(0).type
            for row in batch.to_pylist():
                if not started or row["conv_id"] != now:
                    if started:
                        close()
                    now, started = row["conv_id"], True
                    state = {"best": {_START: (0, "")}, "last": None, "last_turn": None, "least": None, "most": None} | dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
                best: dict[int, tuple[int, str]] = {}
                for path in row["paths"]:
                    if path["start"] in state["best"]:
                        cost, audit = state["best"][path["start"]]
                        new = (cost + path["cost"], audit + path["audit"])
                        best[path["stop"]] = min(new, best.get(path["stop"], new))
                state["best"] = best
                for c in ("blank", "duplicate", "truncated", "illegal", "turns"):
                    state[c] += row[c]
                state["illegal"] += state["last"] is not None and state["last"] + row["first"] not in _LEGAL
                state["turns"] -= row["first_turn"] is not None and row["first_turn"] == state["last_turn"]
                state["last"] = row["last"]
                if row["last_turn"] is not None:
                    state["last_turn"] = row["last_turn"]
                    state["least"] = row["least_turn"] if state["least"] is None else state["least"]
                    state["most"] = row["most_turn"]
            if len(out) >= 1000:
                yield flush()
        if started:
            close()
        if out:
            yield flush()

    return dealt.mapInArrow(run, f"conv_id {dict(found.dtypes)['conv_id']}, {', '.join(f'{c} long' for c in _FACTS)}, audit string")


def diagnosed(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """rows (conv_id, turn, role, text) -> per conversation gaps, blank, duplicate, truncated, illegal, cost and audit."""
    return chain(runs(kinds(rows), chunk))


def _walked(rows: DataFrame, audits: DataFrame, digest: bool) -> DataFrame:
    """Each conversation's rows in order behind its audit, edited on the way."""
    small_batches(rows.sparkSession)
    none = F.lit(None)
    heads = audits.select("conv_id", F.lit(0).alias("body"), none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("digest"), F.col("audit").alias("text"))
    body = _read(rows).select("conv_id", F.lit(1).alias("body"), "turn", "role", "digest", "text")
    order = ["conv_id", "body", "turn", "role", "digest"]
    dealt = heads.unionByName(body).repartition(n_tasks(rows.sparkSession), "conv_id").sortWithinPartitions(*order).select("conv_id", "body", "role", "text")
    names = ["conv_id", "repaired_sha256"] if digest else ["conv_id", "place", "edit", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("repair")
        like = None

        def each() -> Iterator[tuple]:
            nonlocal like
            for batch in batches:
                like = batch.schema.field(0).type
                yield from zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)

        source = each()

        def edits() -> Iterator[tuple]:
            for key, _, _, audit in source:  # a head; edited() then takes this conversation's rows, all of them
                yield key, edited(audit, ((role, text) for _, _, role, text in source))

        def results() -> Iterator[tuple]:
            for key, rows in edits():
                if digest:
                    total = hashlib.sha256()
                    for i, (_, role, text) in enumerate(rows):
                        total.update(f"{chr(10) if i else ''}{role}:{text}".encode())
                    yield key, total.hexdigest()
                else:
                    for i, (edit, role, text) in enumerate(rows):
                        yield key, i, edit, role, text

        held = []
        for result in results():
            held.append(result)
            if len(held) == 1000:
                yield _batch(held, like, names)
                held = []
        if held:
            yield _batch(held, like, names)

    kept = "repaired_sha256 string" if digest else "place long, edit string, role string, text string"
    return dealt.mapInArrow(run, f"conv_id {dict(rows.dtypes)['conv_id']}, {kept}")


def _batch(held: list[tuple], like: pa.DataType, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*held, strict=True))
    kinds = [like, *(pa.int64() if n == "place" else pa.string() for n in names[1:])]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def repaired(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The repaired rows of every conversation: conv_id, place (from 0), edit (K, R or I), role and text."""
    return _walked(rows, diagnosed(rows, chunk).select("conv_id", "audit"), False)


def digest(rows: DataFrame, original: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Per conv_id of `original`: what diagnosed() says of its `rows`, and the SHA-256 of the repaired role:text lines."""
    told = saved(diagnosed(rows, chunk))
    hashes = _walked(rows, told.select("conv_id", "audit"), True)
    every = original.select("conv_id").distinct().alias("o")
    joined = every.join(told.alias("t"), _same("o", "t", ["conv_id"]), "left").join(hashes.alias("h"), F.col("o.conv_id").eqNullSafe(F.col("h.conv_id")), "left")
    zeros = [F.coalesce(F.col(f"t.{c}"), F.lit(0)).cast("long").alias(c) for c in _FACTS]
    return joined.select("o.conv_id", *zeros, F.coalesce("t.audit", F.lit("")).alias("audit"), F.coalesce("h.repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))

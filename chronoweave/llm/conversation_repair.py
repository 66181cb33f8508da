"""Repair of conversations by dynamic programming over a grammar of roles.

A conversation is sound if the initials of its roles read ``(s?(ua)+)?``. Rows in order are kept, given another role,
or deleted, and empty rows are inserted, at least cost. Four states say what the repaired conversation ends in so far;
a step takes a row, then closes its layer with the inserts that lead from state to state. Each state carries its least
(cost, edits). Edits that took the same rows at the same cost are never prefixes of each other, so the least of each
state is all that any continuation needs.

A conversation of many rows is cut into parts along its order: each part gives the least edits from every state to
every state, these are chained over the conversation, and each part then writes its own repaired rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: What the repaired rows end in: nothing yet, a system row, a user row, an assistant row.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPACE = " \t\n\v\f\r"
#: Rows of a conversation that one task takes whole; a longer one is cut into parts of so many.
PART_ROWS = 4096
#: Ids of such conversations that are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 100_000
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
REPAIRED = "array<struct<role:string, text:string>>"
#: Results go on from a worker in batches of so many rows or characters.
BATCH_ROWS, BATCH_CHARS = 1000, 4 << 20


def after(state: int, initial: str) -> int | None:
    """The state after a row of this initial, or None where the grammar has none."""
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    if initial == "u":
        return None if state == USER else USER
    return ASSISTANT if initial == "a" and state == USER else None


def close(best: list) -> list:
    """The layer with all inserts that can help: one to a user row, one more to an assistant row."""
    user = min((x for x in (best[USER], *((c + INSERT, e + "I") for c, e in filter(None, (best[NOTHING], best[SYSTEM], best[ASSISTANT])))) if x), default=None)
    assistant = min((x for x in (best[ASSISTANT], user and (user[0] + INSERT, user[1] + "I")) if x), default=None)
    return [best[NOTHING], best[SYSTEM], user, assistant]


def take(best: list, initial: str, truncated: bool) -> list:
    """The next layer: the row is kept, given the role that fits, or deleted."""
    extra, out = TRUNCATED * truncated, [None] * 4
    for state, now in enumerate(best):
        if now:
            cost, edits = now
            kept = after(state, initial)
            other = ASSISTANT if state == USER else USER
            ways = ((state, DELETE, "D"), (other, REROLE + extra, "R")) + (((kept, extra, "K"),) if kept is not None else ())
            for to, more, edit in ways:
                if (way := (cost + more, edits + edit)) and (out[to] is None or way < out[to]):
                    out[to] = way
    return close(out)


def drop(best: list, n: int) -> list:
    """The layer after ``n`` rows that have to go; inserts before them are no better than after them."""
    return close([x and (x[0] + n * DELETE, x[1] + n * "D") for x in best])


def steps_of(rows: list[tuple], seen: set) -> tuple[list[tuple], dict]:
    """For rows (turn, role, text, copies, again) in order what the decoder takes, (initial or None, truncated, rows to delete), and the rows' counts.

    ``again`` rows are duplicates of some before them; ``seen`` holds the rows before, and takes these.
    """
    steps, n = [], dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "n_turns"), 0)
    n |= {"first_turn": None, "last_turn": None, "first_initial": None, "last_initial": None}
    for turn, role, text, copies, again in rows:
        initial, bare = role[:1], text.rstrip(SPACE)
        if n["first_initial"] is None:
            n["first_initial"] = initial
        elif n["last_initial"] + initial not in ("su", "ua", "au"):
            n["illegal"] += 1
        n["illegal"] += copies - 1
        n["last_initial"] = initial
        if turn is not None and turn != n["last_turn"]:
            n["n_turns"] += 1
            n["first_turn"] = turn if n["first_turn"] is None else n["first_turn"]
            n["last_turn"] = turn
        if not bare:
            n["blank"] += copies
            steps.append((None, False, copies))
        elif again or (role, text) in seen:
            n["duplicate"] += copies
            steps.append((None, False, copies))
        else:
            cut = bare[-1] not in ".!?"
            n["truncated"] += cut
            n["duplicate"] += copies - 1
            steps.append((initial, cut, copies - 1))
        seen.add((role, text))
    return steps, n


def decode(best: list, steps: list[tuple]) -> list:
    best = close(best)
    for initial, truncated, deletes in steps:
        best = best if initial is None else take(best, initial, truncated)
        best = drop(best, deletes) if deletes else best
    return best


def only(state: int) -> list:
    return [(0, "") if s == state else None for s in range(4)]


def least_end(best: list) -> int:
    """The state, of those in which a conversation may end, that is reached at least cost."""
    return min((s for s in (NOTHING, ASSISTANT) if best[s]), key=best.__getitem__)


def carried_out(rows: list[tuple], edits: str, state: int) -> list[dict]:
    """The repaired rows of ``rows`` from ``state`` on."""
    out, each = [], ((role, text) for _, role, text, copies, _ in rows for _ in range(copies))
    for edit in edits:
        role, text = ("", "") if edit == "I" else next(each)
        if edit != "D":
            role = role if edit == "K" else "assistant" if state == USER else "user"
            state = after(state, role[:1])
            out.append({"role": role, "text": text})
    return out


def chained(parts: list[dict]) -> tuple[dict, list[tuple[int, str]]]:
    """Totals of a conversation from its parts' counts and least edits, in order; and for each part the state it begins in and its edits."""
    total, best, back = dict.fromkeys(COUNTS, 0), only(NOTHING), []
    low = high = last_turn = last_initial = None
    turns = 0
    for part in parts:
        for k in ("blank", "duplicate", "truncated", "illegal"):
            total[k] += part[k]
        total["illegal"] += last_initial is not None and last_initial + part["first_initial"] not in ("su", "ua", "au")
        last_initial = part["last_initial"]
        if part["n_turns"]:
            turns += part["n_turns"] - (last_turn == part["first_turn"])
            low, high = part["first_turn"] if low is None else low, part["last_turn"]
            last_turn = high
        now, came = [None] * 4, [None] * 4
        for way in part["ways"]:
            if (x := best[way["src"]]) and (now[way["dst"]] is None or (x[0] + way["cost"], x[1] + way["edits"]) < now[way["dst"]]):
                now[way["dst"]], came[way["dst"]] = (x[0] + way["cost"], x[1] + way["edits"]), way
        # What an assistant row can do at no more cost goes, and what all edits begin with needn't be carried.
        if now[ASSISTANT]:
            now = [x if x and (s > SYSTEM or x[0] <= now[ASSISTANT][0] + (DELETE if s == NOTHING else 0)) else None for s, x in enumerate(now)]
        shared = len(commonprefix([x[1] for x in now if x]))
        best = [x and (x[0], x[1][shared:]) for x in now]
        back.append(came)
    state = least_end(best)
    total["cost"], chosen = best[state][0], []
    for came in reversed(back):
        way = came[state]
        chosen.append((way["src"], way["edits"]))
        state = way["src"]
    if turns:
        total["gaps"] = high - low + 1 - turns
    return total, chosen[::-1]


def ways_of(steps: list[tuple]) -> list[dict]:
    """The least edits from every state to every state."""
    ends = ((src, dst, x) for src in range(4) for dst, x in enumerate(decode(only(src), steps)) if x)
    return [{"src": src, "dst": dst, "cost": x[0], "edits": x[1]} for src, dst, x in ends]


def by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """Each conversation's rows (turn, role, text, copies, again) in batches that hold conversations one after the other."""
    now, held = None, []
    for batch in batches:
        for conv, *row in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "copies")), strict=True):
            if held and conv != now:
                yield now, held
                held = []
            now = conv
            held.append((*row, False))
    if held:
        yield now, held


def _in_parts(rows: DataFrame, part_rows: int) -> DataFrame:
    """Rows of long conversations with ``again``, ``part`` and ``place``: equal rows are one, and each task of a sort by range cuts its stretch.

    No conversation, turn or repeated row is one task's: a row's copies are summed before the shuffle, its first turn too.
    """
    order = ["conv_id", "turn", "role", "text"]
    once = rows.filter("copies > 0").groupBy(order).agg(F.sum("copies").alias("copies"))
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    once = common.written(once.withColumn("digest", digest), "repair-rows")
    first = once.groupBy("conv_id", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = first.select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d"))
    again = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    known = once.join(first, same, "left").select(*order, "copies", again.alias("again"))

    def cut(batches):
        part, place, now, begun = TaskContext.get().partitionId() << 32, 0, None, False
        for batch in batches:
            parts, places = [], []
            for conv in batch.column(0).to_pylist():
                if begun and (conv != now or place == part_rows):
                    part, place = part + 1, 0
                now, begun = conv, True
                parts.append(part)
                places.append(place)
                place += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.int64()), pa.array(places, pa.int64())], names=[*batch.schema.names, "part", "place"])

    kind = dict(rows.dtypes)
    schema = f"conv_id {kind['conv_id']}, turn long, role string, text string, copies long, again boolean, part long, place long"
    return known.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, schema)


def _rows_of(table: pa.Table) -> list[tuple]:
    table = table.sort_by("place")
    return list(zip(*(table.column(n).to_pylist() for n in ("turn", "role", "text", "copies", "again")), strict=True))


def _long(rows: DataFrame, part_rows: int) -> DataFrame:
    kind = dict(rows.dtypes)["conv_id"]
    parts = common.written(_in_parts(rows, part_rows), "repair-parts")

    def measure(table: pa.Table) -> pa.Table:
        steps, counts = steps_of(_rows_of(table), set())
        return pa.Table.from_arrays([table.column("conv_id")[:1], table.column("part")[:1], *(pa.array([counts[k]], t) for k, t in kinds.items()), pa.array([ways_of(steps)], ways)], names=["conv_id", "part", *kinds, "ways"])

    kinds = {k: pa.int64() for k in ("blank", "duplicate", "truncated", "illegal", "n_turns", "first_turn", "last_turn")} | {k: pa.string() for k in ("first_initial", "last_initial")}
    ways = pa.list_(pa.struct([("src", pa.int64()), ("dst", pa.int64()), ("cost", pa.int64()), ("edits", pa.string())]))
    measured = ", ".join(f"{k} {'long' if t == pa.int64() else 'string'}" for k, t in kinds.items())
    counted = parts.groupBy("conv_id", "part").applyInArrow(measure, f"conv_id {kind}, part long, {measured}, ways array<struct<src:long, dst:long, cost:long, edits:string>>")

    def chain(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        total, chosen = chained(table.select([*kinds, "ways"]).to_pylist())
        n = table.num_rows
        whole = [pa.array([total[k]] * n, pa.int64()) for k in COUNTS]
        return pa.Table.from_arrays([table.column("conv_id"), table.column("part"), pa.array([n] * n, pa.int64()), *whole, pa.array([s for s, _ in chosen], pa.int64()), pa.array([e for _, e in chosen], pa.string())], names=["conv_id", "part", "parts", *COUNTS, "state", "audit"])

    totals = f"parts long, {', '.join(f'{k} long' for k in COUNTS)}"
    plan = counted.groupBy("conv_id").applyInArrow(chain, f"conv_id {kind}, part long, {totals}, state long, audit string")

    def carry_out(own: pa.Table, planned: pa.Table) -> pa.Table:
        [state], [edits] = planned.column("state").to_pylist(), planned.column("audit").to_pylist()
        done = pa.array([carried_out(_rows_of(own), edits, state)], pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))
        return planned.drop_columns(["state"]).append_column("repaired", done)

    return parts.groupBy("conv_id", "part").cogroup(plan.groupBy("conv_id", "part")).applyInArrow(carry_out, f"conv_id {kind}, part long, {totals}, audit string, repaired {REPAIRED}")


def _short(rows: DataFrame) -> DataFrame:
    kind = dict(rows.dtypes)["conv_id"]
    order = ["conv_id", "turn", "role", "text"]
    schema = f"conv_id {kind}, part long, parts long, {', '.join(f'{k} long' for k in COUNTS)}, audit string, repaired {REPAIRED}"
    target = rows.sparkSession.createDataFrame([], schema).schema

    def run(batches):
        out, chars = [], 0
        types = None
        for conv, held in by_conversation(counting := _Typed(batches)):
            own = [x for x in held if x[3]]
            steps, counts = steps_of(own, set())
            total, chosen = chained([counts | {"ways": ways_from_nothing(steps)}]) if own else (dict.fromkeys(COUNTS, 0), [(NOTHING, "")])
            out.append({"conv_id": conv, "part": 0, "parts": 1, **total, "audit": chosen[0][1], "repaired": carried_out(own, chosen[0][1], NOTHING)})
            chars += sum(len(x[2]) for x in own)
            types = types or pa.schema([("conv_id", counting.kind), *((k, pa.int64()) for k in ("part", "parts", *COUNTS)), ("audit", pa.string()), ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])
            if len(out) >= BATCH_ROWS or chars >= BATCH_CHARS:
                yield pa.RecordBatch.from_pylist(out, types)
                out, chars = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, types)

    return rows.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, target)


class _Typed:
    """The batches, and the Arrow type of their first column once one was seen."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.batches, self.kind = batches, None

    def __iter__(self):
        for batch in self.batches:
            self.kind = batch.schema.field(0).type
            yield batch


def ways_from_nothing(steps: list[tuple]) -> list[dict]:
    return [{"src": NOTHING, "dst": dst, "cost": x[0], "edits": x[1]} for dst, x in enumerate(decode(only(NOTHING), steps)) if x]


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies: Column | None = None, part_rows: int = PART_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """Repaired conversations: (conv_id, part, parts, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired).

    The first result has a row a conversation, the second one a row a part for those of more than ``part_rows`` rows
    (None if there are none): its counts and cost are the whole conversation's, ``audit`` and ``repaired`` (roles and
    texts) the part's, to be read in order of ``part``. Rows are taken by turn, nulls first, then role and text. A null
    role or text is one space; the null id is a conversation too. ``copies`` says how often a row stands there; rows
    of zero copies only name their conversation, which has then no fault and no rows. A blank row, one whose role and
    text stood before, and one that doesn't end in ``.!?`` are at fault, the first of these counts. Ties between edits
    of equal cost go to the least string of D, I, K, R. An empty table gives no rows; other columns are ignored.
    """
    rows = conversations.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"),
        (F.lit(1) if copies is None else copies).cast("long").alias("copies"),
    )
    ids = rows.groupBy("conv_id").agg(F.sum("copies").alias("n")).filter(F.col("n") > part_rows).select(F.col("conv_id").alias("long_id"))
    ids = common.written(ids, "repair-long")
    n_ids = ids.count()
    if not n_ids:
        return _short(rows), None
    ids = F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    return _short(rows.join(ids, same, "left_anti")), _long(rows.join(ids, same, "left_semi"), part_rows)


def digested(parts: DataFrame) -> DataFrame:
    """(conv_id, counts, audit, repaired_sha256) of conversations in parts.

    One hash runs over a conversation's whole text, so its parts go through one task, but one after the other and in bounded memory.
    """
    kind = dict(parts.dtypes)["conv_id"]

    def run(batches):
        now, held = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                x = row.select(["part", *COUNTS, "audit"]).to_pylist()[0]
                if held is None or row.column("conv_id")[0].as_py() != now:
                    if held:
                        yield finished(held)
                    now, held = row.column("conv_id")[0].as_py(), {"id": row.column("conv_id"), "counts": x, "audit": [], "hash": hashlib.sha256(), "any": False}
                held["audit"].append(x["audit"])
                for y in row.column("repaired")[0].as_py():
                    held["hash"].update((("\n" if held["any"] else "") + f"{y['role']}:{y['text']}").encode())
                    held["any"] = True
        if held:
            yield finished(held)

    def finished(x: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([x["id"], *(pa.array([x["counts"][k]], pa.int64()) for k in COUNTS), pa.array(["".join(x["audit"])]), pa.array([x["hash"].hexdigest()])], names=["conv_id", *COUNTS, "audit", "repaired_sha256"])

    schema = f"conv_id {kind}, {', '.join(f'{k} long' for k in COUNTS)}, audit string, repaired_sha256 string"
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, schema)


def damaged(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """The query's damage, by a hash of id and turn: rows lost, emptied, without full stops, doubled or given to the user; and each row's copies."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(kind.isin(0, 1), "").when(kind == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    rows = conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))
    return rows, F.col("copies")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, copies = damaged(common.table(spark, sf_dir, "conversations"))
    return digests(*repair(rows, copies=copies))


def digests(short: DataFrame, parts: DataFrame | None) -> DataFrame:
    lines = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    whole = short.select("conv_id", *COUNTS, "audit", F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))
    return whole if parts is None else whole.unionByName(digested(parts))

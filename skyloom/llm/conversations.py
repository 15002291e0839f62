"""Repair of conversations by the cheapest edits.

A conversation should be an optional system turn and then pairs of user and assistant. Its rows and the
state of that grammar span a lattice: deleting, keeping or reroling moves on by a row, inserting stays.
A bidirectional Dijkstra search finds the cheapest way through: a heap grows from the start, another one
from the accepted ends; when they meet, the search goes on until every crossing of the least cost is known.
Of all cheapest ways the one whose audit (initials of its edits) is least is taken: a walk from the start
takes the least letter that still leads to a crossing. Since the state decides which role an inserted or
reroled row gets, two ways never share an audit.

Spark checks and orders the rows. They stream through a task sorted by conversation and turn, and a task
holds one byte a row. Conversations above ``BLOCK`` rows are solved in blocks, between every two states at
the borders of a block, and the blocks are joined by the cheapest states; texts are never held.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from skyloom.llm.common import bounded_batches, by_value, stored, table

by_value(__name__)

BLOCK = 4096  # rows of a conversation that are searched at once
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # what an insertion or new role gives
ACCEPTED = (START, ASSISTANT)
DELETE, INSERT, KEEP, REROLE = "DIKR"
COST = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}
# A row's code: the state it can be kept in (0: none) and its fault.
BAD, CUT = 4, 8  # must go; costs one more unless deleted
FAULTS = ("blank", "duplicate", "truncated")
NOT_SPACE = r"[^\x20\x09-\x0D]"


def kept_state(code: int, state: int) -> int | None:
    """The state after keeping a row, if the grammar allows it."""
    to = code & 3
    legal = (to == SYSTEM and state == START) or (to and to == NEXT[state])
    return to if legal else None


def moves(codes: bytes, i: int, state: int, closing: bool) -> list[tuple[str, int, int, int]]:
    """``(edit, row, state, cost)`` of the edges that leave a node, by edit.

    Behind the last row only the closing block of a conversation inserts: a block's way then ends with its
    last row, and no way is written in two manners.
    """
    out = []
    if i < len(codes):
        code = codes[i]
        out.append((DELETE, i + 1, state, COST[DELETE]))
        out.append((INSERT, i, NEXT[state], COST[INSERT]))
        if not code & BAD:
            more = 1 if code & CUT else 0
            if (to := kept_state(code, state)) is not None:
                out.append((KEEP, i + 1, to, COST[KEEP] + more))
            out.append((REROLE, i + 1, NEXT[state], COST[REROLE] + more))
    elif closing:
        out.append((INSERT, i, NEXT[state], COST[INSERT]))
    return out


def moves_into(codes: bytes, i: int, state: int, closing: bool) -> list[tuple[int, int, int]]:
    """``(row, state, cost)`` of the edges that lead to a node."""
    out = []
    before = [s for s in NEXT if NEXT[s] == state]
    if i:
        code = codes[i - 1]
        out.append((i - 1, state, COST[DELETE]))
        if not code & BAD:
            more = 1 if code & CUT else 0
            out += [(i - 1, s, COST[KEEP] + more) for s in NEXT if kept_state(code, s) == state]
            out += [(i - 1, s, COST[REROLE] + more) for s in before]
    if i < len(codes) or closing:
        out += [(i, s, COST[INSERT]) for s in before]
    return out


def search(codes: bytes, entry: int, exits: tuple[int, ...], closing: bool = True) -> tuple[int, str] | None:
    """Least cost and least audit from ``entry`` before the first row to one of ``exits`` behind the last.

    None if no way leads there.
    """
    n = len(codes)
    ahead, behind = {(0, entry): 0}, {(n, s): 0 for s in exits}
    front, back = [(0, 0, entry)], [(0, n, s) for s in sorted(exits)]
    settled, solved = set(), set()
    best = None if (0, entry) not in behind else 0
    # Both heaps go on while a way over two open nodes could still cost no more than the best one.
    while front and back and (best is None or front[0][0] + back[0][0] <= best):
        forward = front[0][0] <= back[0][0]
        heap, mine, other, done = (front, ahead, behind, settled) if forward else (back, behind, ahead, solved)
        cost, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        edges = (m[1:] for m in moves(codes, i, state, closing)) if forward else moves_into(codes, i, state, closing)
        for j, to, step in edges:
            now = cost + step
            if now < mine.get((j, to), now + 1):
                mine[j, to] = now
                heapq.heappush(heap, (now, j, to))
            across = other.get((j, to))
            if across is not None and (best is None or now + across < best):
                best = now + across
    if best is None:
        return None
    # Crossings: edges of a cheapest way from a node of the front to one of the back. From them back along the front.
    rest = {v: behind[v] for v in solved}
    open_ends = []
    for v in settled:
        met = ahead[v] + behind.get(v, best + 1) == best
        for _, j, to, step in moves(codes, *v, closing):
            if ahead[v] + step + behind.get((j, to), best + 1) == best:
                rest[j, to] = behind[j, to]
                met = True
        if met:
            rest[v] = best - ahead[v]
            open_ends.append(v)
    while open_ends:
        i, state = open_ends.pop()
        for j, to, step in moves_into(codes, i, state, closing):
            if (j, to) in settled and (j, to) not in rest and ahead[j, to] + step == ahead[i, state]:
                rest[j, to] = best - ahead[j, to]
                open_ends.append((j, to))
    audit, node = [], (0, entry)
    while not (node[0] == n and node[1] in exits and rest[node] == 0):
        for edit, j, to, step in moves(codes, *node, closing):
            if rest.get((j, to), best + 1) + step == rest[node]:
                audit.append(edit)
                node = (j, to)
                break
        else:
            raise AssertionError("a cheapest way has no next edit")
    return best, "".join(audit)


def repair(codes: bytes, block: int = BLOCK) -> tuple[int, list[tuple[int, str]]]:
    """Least cost, and per block of rows the state before it and its audit."""
    parts = [codes[a : a + block] for a in range(0, len(codes), block)] or [b""]
    if len(parts) == 1:
        cost, audit = search(codes, START, ACCEPTED)
        return cost, [(START, audit)]
    # rest[k][s]: least cost from state s before block k to the end; a table of 16 costs per block
    last = len(parts) - 1
    costs: list[dict[tuple[int, int], int]] = []
    for k, part in enumerate(parts):
        here = {}
        for entry in range(4):
            for leave in ((ASSISTANT,) if k == last else range(4)):
                found = search(part, entry, ACCEPTED if k == last else (leave,), closing=k == last)
                if found is not None:
                    here[entry, leave] = found[0]
        costs.append(here)
    rest: list[dict[int, int]] = [{} for _ in parts] + [dict.fromkeys(range(4), 0)]
    for k in range(last, -1, -1):
        for (entry, leave), cost in costs[k].items():
            if leave in rest[k + 1]:
                rest[k][entry] = min(rest[k].get(entry, 1 << 60), cost + rest[k + 1][leave])
    state, audits = START, []
    for k, part in enumerate(parts):
        if k == last:
            options = [(search(part, state, ACCEPTED)[1], ASSISTANT)]
        else:
            options = [
                (search(part, state, (leave,), closing=False)[1], leave)
                for (entry, leave), cost in costs[k].items()
                if entry == state and leave in rest[k + 1] and cost + rest[k + 1][leave] == rest[k][state]
            ]
        audit, leave = min(options)
        audits.append((state, audit))
        state = leave
    return rest[0][START], audits


def keeps_system(codes: bytes, audit: str) -> bool:
    """Whether the first row that stays in a block of codes is a system turn."""
    first = len(audit) - len(audit.lstrip(DELETE))
    return audit[first : first + 1] == KEEP and codes[first] & 3 == SYSTEM


def edited(state: int, audit: str, system: bool) -> list[list[tuple[str, str | None]]]:
    """Per row of a block the rows it leaves: ``(edit, role)``, None for the row's own role; then those behind the last.

    Insertions stand before the row that the next edit takes. ``system`` tells that the first row kept is a
    system turn; all other turns follow from the state.
    """
    out: list[list[tuple[str, str | None]]] = [[]]
    for edit in audit:
        if edit == INSERT:
            state = NEXT[state]
            out[-1].append((INSERT, ROLES[state]))
            continue
        if edit == REROLE:
            state = NEXT[state]
            out[-1].append((REROLE, ROLES[state]))
        elif edit == KEEP:
            state = SYSTEM if system and state == START else NEXT[state]
            out[-1].append((KEEP, None))
        out.append([])
    return out


def damaged(rows: DataFrame) -> DataFrame:
    """The test damage of ``conv_id, turn, role, text``: by a checksum rows go, empty, lose stops, repeat or become the user's."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(" "))
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    return (
        rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind"))
        .where("kind <> 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
            F.when(F.col("kind") == 1, F.lit(""))
            .when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text"))
            .alias("text"),
            F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        )
    )


def code_of(faulty: Column, truncated: Column) -> Column:
    initial = F.substring("role", 1, 1)
    keep = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(0)
    return keep + F.when(faulty, BAD).when(truncated, CUT).otherwise(0)


def checked(rows: DataFrame) -> DataFrame:
    """Rows with ``code`` and ``fault`` (0 none, 1 blank, 2 repeats an earlier turn, 3 truncated), stored once.

    Whether role and text came at an earlier turn is a join with the first turn of each, reduced before it is
    shuffled; repeats within a turn stand side by side and are seen later. Equality is by SHA-256 of the text.
    """
    blank = ~F.col("text").rlike(NOT_SPACE)
    truncated = ~F.regexp_extract("text", rf"({NOT_SPACE})[\x20\x09-\x0D]*\z", 1).rlike("[.!?]")
    known = rows.withColumn("hash", F.unhex(F.sha2(F.col("text").cast("binary"), 256))).withColumn("blank", blank)
    known = known.withColumn("cut", truncated).withColumn("at", F.struct(F.isnotnull("turn").alias("known"), "turn"))
    first = known.where("not blank").groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("hash").alias("h"))
    first = first.agg(F.min("at").alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("hash") == F.col("h"))
    seen = known.join(first, same, "left").withColumn("again", F.coalesce(F.col("at") > F.col("first"), F.lit(False)))
    fault = F.when(F.col("blank"), 1).when(F.col("again"), 2).when(F.col("cut"), 3).otherwise(0)
    return seen.select(
        "conv_id",
        "turn",
        "role",
        "text",
        "copy",
        "hash",
        fault.cast("int").alias("fault"),
        code_of(F.col("blank") | F.col("again"), F.col("cut")).cast("int").alias("code"),
    )


ORDER = ("conv_id", "turn", "role", "text", "copy")  # nulls first
SUMMARY_SCHEMA = "conv_id {id}, summary struct<first:long,last:long,turns:long,blank:long,duplicate:long,truncated:long,illegal:long,cost:long>, block long, state int, system boolean, audit string"


class Conversation:
    """What a task holds of the conversation that streams by: a byte a row and counts."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.codes = bytearray()
        self.faults = [0, 0, 0]
        self.illegal = self.turns = 0
        self.first = self.last = None
        self.before = (None, None)
        self.initial = None

    def add(self, turn, role: str, digest: bytes, fault: int, code: int) -> int:
        """Takes the next row; returns its fault. A row like the one before it repeats it."""
        if fault != 1 and self.before == (role, digest):
            fault, code = 2, (code & 3) | BAD
        self.before = (role, digest)
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        if fault:
            self.faults[fault - 1] += 1
        if turn is not None:
            self.turns += turn != self.last
            self.first = turn if self.first is None else self.first
            self.last = turn
        self.codes.append(code)
        return fault

    def summaries(self, block: int) -> list[dict]:
        cost, audits = repair(bytes(self.codes), block)
        summary = {"first": self.first, "last": self.last, "turns": self.turns, "illegal": self.illegal, "cost": cost}
        summary |= dict(zip(FAULTS, self.faults))
        return [
            {
                "conv_id": self.conv_id,
                "summary": summary if k == 0 else None,
                "block": k,
                "state": state,
                "system": keeps_system(self.codes[k * block :], audit),
                "audit": audit,
            }
            for k, (state, audit) in enumerate(audits)
        ]


def repaired(rows: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The repaired turns and what was done, for rows of ``conv_id, turn, role, text``.

    Turns: ``conv_id, position, step, edit, role, text`` - what each row (by position, then step) leaves or has
    inserted before it; deleted rows leave nothing. Report: ``conv_id, summary, block, state, system, audit`` - the audit
    of every block of rows, counts with block 0.

    Rows are taken by turn, nulls first, ties by role, then by text, copies last. Null role and
    text count as one space; a role whose first letter is not s, u or a (or is empty) fits nowhere, so it is
    reroled or deleted. Null conversations form one conversation. Empty tables give empty results; columns beside
    those four and ``copy`` are not looked at. The order of rows with equal turns never depends on the input's order.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    if "copy" not in rows.columns:
        rows = rows.withColumn("copy", F.lit(0))
    rows = rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")),
        F.col("copy").cast("int").alias("copy"),
    )
    kind = rows.schema["conv_id"].dataType.simpleString()
    sorted_rows = checked(rows).repartition("conv_id").sortWithinPartitions(*map(F.asc_nulls_first, ORDER))
    schema = T._parse_datatype_string(f"{SUMMARY_SCHEMA}, position long, turn long, role string, text string, fault int".format(id=kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Conversation | None = None
        arrow = None
        for batch in batches:
            made: list[dict] = []
            if arrow is None:
                arrow = arrow_schema(batch.schema.field("conv_id").type)
            names = ("conv_id", "turn", "role", "text", "hash", "fault", "code")
            for c, turn, role, text, digest, fault, code in zip(*(batch.column(n).to_pylist() for n in names)):
                if now is None or c != now.conv_id:
                    made += now.summaries(block) if now else []
                    now = Conversation(c)
                position = len(now.codes)
                fault = now.add(turn, role, digest, fault, code)
                made.append({"conv_id": c, "position": position, "turn": turn, "role": role, "text": text, "fault": fault})
            yield pa.RecordBatch.from_pylist(made, arrow)
        if now:
            yield pa.RecordBatch.from_pylist(now.summaries(block), arrow)

    passed = stored(sorted_rows.mapInArrow(run, schema), "conversations")
    report = passed.where("position is null").select("conv_id", "summary", "block", "state", "system", "audit")
    turns = passed.where("position is not null").select(
        "conv_id", "position", "role", "text", F.floor(F.col("position") / block).alias("block")
    )
    edits = report.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "state", "system", "audit")
    joined = turns.join(edits, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    return with_edits(joined, block, kind), report


def arrow_schema(id_type: pa.DataType) -> pa.Schema:
    counts = ("first", "last", "turns", "blank", "duplicate", "truncated", "illegal", "cost")
    return pa.schema(
        [
            ("conv_id", id_type),
            ("summary", pa.struct([(c, pa.int64()) for c in counts])),
            ("block", pa.int64()),
            ("state", pa.int32()),
            ("system", pa.bool_()),
            ("audit", pa.string()),
            ("position", pa.int64()),
            ("turn", pa.int64()),
            ("role", pa.string()),
            ("text", pa.string()),
            ("fault", pa.int32()),
        ]
    )


def with_edits(joined: DataFrame, block: int, kind: str) -> DataFrame:
    """Rows beside the audit of their block become the turns that they leave."""
    schema = f"conv_id {kind}, position long, step int, edit string, role string, text string"
    needed = ("conv_id", "b", "state", "system", "audit", "position", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, None)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for c, b, *way, position, role, text in zip(*(batch.column(n).to_pylist() for n in needed)):
                if held[0] != way:
                    held = (way, edited(way[0], way[2], way[1]))
                at = position - b * block
                # insertions behind the last row go with it
                left = held[1][at] + (held[1][at + 1] if at + 2 == len(held[1]) else [])
                for step, (edit, new) in enumerate(left):
                    values = (c, position, step, edit, role if new is None else new, "" if edit == INSERT else text)
                    for column, value in zip(out, values):
                        column.append(value)
            kinds = (batch.schema.field("conv_id").type, pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())
            fields = ("conv_id", "position", "step", "edit", "role", "text")
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=fields)

    return joined.select(*needed).mapInArrow(run, schema)


def digests(turns: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: of each conversation's ``role:text`` lines, hashed as they stream by."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    line = F.concat("role", F.lit(":"), "text").cast("binary")
    lines = turns.select("conv_id", "position", "step", line.alias("line")).repartition("conv_id")
    lines = lines.sortWithinPartitions(F.asc_nulls_first("conv_id"), "position", "step")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, now, id_type = None, None, None
        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            ids, found = [], []
            for c, content in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist()):
                if digest is not None and c == now:
                    digest.update(b"\n")
                else:
                    if digest is not None:
                        ids.append(now)
                        found.append(digest.hexdigest())
                    digest, now = hashlib.sha256(), c
                digest.update(content)
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(found, pa.string())], names=["conv_id", "repaired_sha256"])
        if digest is not None:
            rest = [pa.array([now], id_type), pa.array([digest.hexdigest()], pa.string())]
            yield pa.RecordBatch.from_arrays(rest, names=["conv_id", "repaired_sha256"])

    return lines.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def op12_repair(spark, sf_dir: str) -> DataFrame:
    """Every conversation after the test damage: its faults, the cheapest repair and the digest of what it gives."""
    original = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns, report = repaired(damaged(original))
    audits = report.groupBy("conv_id").agg(
        F.max("summary").alias("summary"),
        F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"])).alias("audit"),
    )
    ids = original.select("conv_id").distinct()
    found = digests(turns)
    out = ids.join(audits, ids["conv_id"].eqNullSafe(audits["conv_id"]), "left").join(
        found, ids["conv_id"].eqNullSafe(found["conv_id"]), "left"
    )
    count = lambda c: F.coalesce(F.col(f"summary.{c}"), F.lit(0)).cast("long").alias(c)  # noqa: E731
    gaps = F.coalesce(F.expr("summary.last - summary.first + 1 - summary.turns"), F.lit(0)).cast("long")
    return out.select(
        ids["conv_id"],
        gaps.alias("gaps"),
        *map(count, (*FAULTS, "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(EMPTY_SHA256)).alias("repaired_sha256"),
    )


# ---- the SQL twin: checksums bit by bit, then a table of four states, a row at a time ----


def _step(state: str, cost: str, letter: str, line: str | None) -> str:
    text = f"{state}.t" if line is None else f"{state}.t || chr(10) || {line}"
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {text}}}"


_NEVER = "{'c': CAST(1000000000 AS BIGINT), 'a': '', 't': ''}"
_MORE = "CASE WHEN fault = 3 THEN 1 ELSE 0 END"


def _if(condition: str, state: str) -> str:
    return f"CASE WHEN {condition} THEN {state} ELSE {_NEVER} END"


def _inserted(inner: str) -> str:
    """A layer in which every state may also come from an insertion."""
    user = ", ".join(["s2", *(_step(s, "2", INSERT, "'user:'") for s in ("s0", "s1", "s3"))])
    return f"""SELECT conv_id, i, s0, s1, list_min([{user}]) AS s2,
  list_min([s3, {_step("s2", "2", INSERT, "'assistant:'")}]) AS s3 FROM ({inner})"""


def _row_taken() -> str:
    """A layer that takes the next row: deleted, kept or with another role."""
    kept, gone = "f.role || ':' || f.text", [_step(f"r.s{k}", "3", DELETE, None) for k in range(4)]
    stays = "f.fault NOT IN (1, 2)"
    keep = lambda s, initial: _if(f"{stays} AND substr(f.role, 1, 1) = '{initial}'", _step(f"r.{s}", _MORE, KEEP, kept))  # noqa: E731
    rerole = lambda s, role: _if(stays, _step(f"r.{s}", f"2 + {_MORE}", REROLE, f"'{role}:' || f.text"))  # noqa: E731
    user = [gone[2], *(keep(s, "u") for s in ("s0", "s1", "s3")), *(rerole(s, "user") for s in ("s0", "s1", "s3"))]
    assistant = [gone[3], keep("s2", "a"), rerole("s2", "assistant")]
    return f"""SELECT r.conv_id, r.i + 1 AS i, {gone[0]} AS s0, list_min([{gone[1]}, {keep("s0", "s")}]) AS s1,
  list_min([{", ".join(user)}]) AS s2, list_min([{", ".join(assistant)}]) AS s3
  FROM steps r JOIN faults f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i + 1"""


_EMPTY = "{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}"
_BEGIN = f"SELECT conv_id, CAST(0 AS BIGINT) AS i, {_EMPTY} AS s0, {_NEVER} AS s1, {_NEVER} AS s2, {_NEVER} AS s3 FROM (SELECT DISTINCT conv_id FROM faults)"

OP12_SQL = rf"""WITH RECURSIVE keyed AS (SELECT row_number() OVER () AS id, conv_id, turn, coalesce(role, ' ') AS role,
    coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
crcs AS (SELECT id, k, 0 AS n, CAST(4294967295 AS BIGINT) AS c FROM keyed UNION ALL
  SELECT id, k, n + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END FROM (
    SELECT *, CASE WHEN n % 8 = 0 THEN xor(c, CAST(ascii(substr(k, n // 8 + 1, 1)) AS BIGINT)) ELSE c END AS x
    FROM crcs WHERE n < 8 * length(k))),
kinds AS (SELECT id, xor(c, CAST(4294967295 AS BIGINT)) % 20 AS kind FROM crcs WHERE n = 8 * length(k)),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM keyed JOIN kinds USING (id) CROSS JOIN (SELECT unnest([0, 1]) AS copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM damaged),
faults AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 1 WHEN nth > 1 THEN 2
    WHEN NOT regexp_matches(text, '[.!?][ 	-]*$') THEN 3 ELSE 0 END AS fault,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM ordered),
steps AS ({_inserted(_inserted(_BEGIN))} UNION ALL {_inserted(_inserted(_row_taken()))}),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated,
    count(*) FILTER (WHERE i > 1 AND before || substr(role, 1, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id),
ends AS (SELECT c.*, list_min([s.s0, s.s3]) AS best FROM counts c JOIN steps s ON s.conv_id IS NOT DISTINCT FROM c.conv_id AND s.i = c.n)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
  CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost,
  coalesce(best.a, '') AS audit, sha256(substr(coalesce(best.t, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""

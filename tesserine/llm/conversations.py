"""Conversation structure repair: cheapest edits by the auction algorithm for shortest paths.

A repaired conversation has the role initials (s?(ua)+)?.  Its rows and the four
states of that pattern span a lattice: keeping, changing the role of, or deleting
a row leads to the next column, inserting an empty turn stays in a column, and
each arc has an integer cost.  Every node has a price, which never exceeds the
cost of any arc plus the price of its head.  An auction starts a path at a node,
extends it along an arc where both are equal, or raises the price of the path's
last node and contracts it.  Columns are taken from the last back, so a path ends
as soon as it meets a node that is settled, and a column costs the same wherever
it stands.  Converged prices are the costs still to come, and the arcs on
cheapest paths are those that are tight; of those the trace takes the first in
the order of their letters.

Rows of a conversation are sorted by range of conversation and turn and cut into
slices of at most SLICE rows, so a conversation of any length is spread over
tasks.  Slices of one conversation are linked by the costs between their four
states, sixteen numbers a slice: a pass from the last slice back gives what is
still to come behind each, then all slices are traced from each state they may be
entered in, and a pass forward picks the state.  Equal rows of one turn are one
row with a count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import dropped, written
from .textbytes import column
from .worker import task

SLICE = 512
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: White space, and marks that end a turn.
SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"

START, SYSTEM, USER, PAIR = range(4)
#: The state after an inserted row or one with a new role, and the role.
_NEXT = {START: (USER, "u"), SYSTEM: (USER, "u"), USER: (PAIR, "a"), PAIR: (USER, "u")}
#: The state after a row that is kept.
_KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): PAIR, (PAIR, "u"): USER}
#: States from which each state can be reached.
_BEFORE = ((START,), (START, SYSTEM), (START, SYSTEM, USER, PAIR), (START, SYSTEM, USER, PAIR))
#: Costs of ending in each state: the whole conversation must be empty or end behind a pair.
TERMINAL = (0, None, None, 0)
_NEVER = 1 << 60
ROLES = {"u": "user", "a": "assistant"}


class Lattice:
    """Prices of the nodes of a slice.

    items: (initial, fault) of each row, fault one of b, d (must go), t or empty.
    exits: costs of leaving behind the last row in each state, or None; inserts
    there are up to the next slice, but for the last.  What must go costs the
    same on every path and is left out.
    """

    def __init__(self, items: list[tuple[str, str]], exits: tuple, last: bool = True, states: tuple = (0, 1, 2, 3)):
        self.items, self.exits, self.last, self.states = items, exits, last, states
        n = len(items)
        self.end = 4 * n + 4
        self.price = [0] * (4 * n + 5)
        self.out: list[list[tuple[str, int, int]]] = [[] for _ in range(4 * n + 4)]
        for i in range(n + 1):
            for q in states:
                self.out[4 * i + q] = self._arcs(i, q)
        settled = bytearray(4 * n + 5)
        settled[self.end] = 1
        for node in range(4 * n, self.end):
            if not self.out[node]:  # no way out: only behind the last row
                self.price[node], settled[node] = _NEVER, 1
        for i in range(n, -1, -1):
            for q in states:
                self._auction(4 * i + q, settled)

    def _arcs(self, i: int, q: int) -> list[tuple[str, int, int]]:
        """letter, cost, head of the arcs of a node in the order of their letters."""
        state, here = _NEXT[q][0], 4 * i
        if i == len(self.items):
            arcs = [("I", INSERT, here + state)] if self.last and state in self.states else []
            return arcs + ([("", self.exits[q], self.end)] if self.exits[q] is not None else [])
        initial, fault = self.items[i]
        gone = fault in ("b", "d")
        arcs = [("D", 0 if gone else DELETE, here + 4 + q)]
        if state in self.states:
            arcs.append(("I", INSERT, here + state))
        if not gone:
            more = TRUNCATED if fault == "t" else 0
            if (kept := _KEPT.get((q, initial))) in self.states:
                arcs.append(("K", more, here + 4 + kept))
            if state in self.states:
                arcs.append(("R", REROLE + more, here + 4 + state))
        return arcs

    def _auction(self, origin: int, settled: bytearray) -> None:
        price, path = self.price, [origin]
        while not settled[node := path[-1]]:
            cost, head = min((c + price[h], h) for _, c, h in self.out[node])
            if price[node] < cost:
                price[node] = cost
                if len(path) > 1:
                    path.pop()
            else:
                path.append(head)
        for node in path:
            settled[node] = 1

    def trace(self, state: int) -> tuple[list[str], str, int]:
        """For each row the edits up to it, each a letter and the new role's initial; the inserts behind the last row; the state behind it."""
        node, rows, now = state, [], ""
        while True:
            letter, _, head = next(a for a in self.out[node] if a[1] + self.price[a[2]] == self.price[node])
            if head == self.end:
                return rows, now, node % 4
            now += letter + (_NEXT[node % 4][1] if letter in ("I", "R") else "-")
            if letter != "I":
                rows.append(now)
                now = ""
            node = head


def between(items: list[tuple[str, str]]) -> list[int]:
    """Costs from each state before the rows to each state behind them (-1: no way), then those to the end of the conversation."""
    costs = []
    for q in range(4):
        lattice = Lattice(items, tuple(0 if k == q else None for k in range(4)), False, _BEFORE[q])
        costs.append([lattice.price[p] if p in _BEFORE[q] else -1 for p in range(4)])
    return [costs[q][p] for p in range(4) for q in range(4)] + Lattice(items, TERMINAL).price[:4]


def faulted(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies, fault of the rows of turns (conv_id, turn, role, text, copies), equal ones as one with the sum of copies.

    fault: b blank, d seen before in the conversation, t the last character that
    isn't white space doesn't end a turn; the copies behind the first of a row
    that isn't blank are duplicates.
    """
    rows = turns.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    rows = written(rows.withColumns({"seen": F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn")), "digest": F.md5(F.concat_ws("\0", "role", "text"))}), "turns")
    first = rows.groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(F.min("seen").alias("first"))
    text = F.rtrim("text", F.lit(SPACE))
    fault = F.when(text == "", "b").when(F.col("seen") != F.col("first"), "d").when(~F.right(text, F.lit(1)).isin(*ENDS), "t").otherwise("")
    return rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d"))).select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


def _sliced(rows: DataFrame, most: int) -> DataFrame:
    """rows with the place of each: part, no (of the slice in it), at (in the slice). Rows of a conversation are in the order of turn (null first), role and text."""
    schema = rows.withColumns({"part": F.lit(0), "no": F.lit(0), "at": F.lit(0)}).schema

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, at, before = TaskContext.get().partitionId(), -1, 0, object()
        for b in batches:
            places = []
            for c in column(b, "conv_id"):
                at += 1
                if c != before or at == most:
                    no, at, before = no + 1, 0, c
                places.append((part, no, at))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([p[k] for p in places], pa.int32()) for k in range(3))], names=schema.names)

    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(task(placed), schema)


def _items(b: pa.RecordBatch) -> list[list[tuple[str, str]]]:
    return [[(x["initial"], x["fault"]) for x in items] for items in column(b, "items")]


def _costs(slices: DataFrame) -> DataFrame:
    def priced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([between(x) for x in _items(b)], pa.list_(pa.int64()))], names=["conv_id", "part", "no", "costs"])

    schema = slices.select("conv_id", "part", "no").withColumn("costs", F.array(F.lit(0).cast("long"))).schema
    return slices.select("conv_id", "part", "no", "items").mapInArrow(task(priced), schema)


def _in_order(slices: DataFrame, work, schema: str, down: bool) -> DataFrame:
    """The work over the slices of each conversation in their order, or from the last: (conversation, a row's other columns) one after another."""
    order = [F.col("conv_id").asc_nulls_first(), *(F.col(c).desc() if down else F.col(c).asc() for c in ("part", "no"))]
    return slices.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(task(work), schema)


def _exits(costs: DataFrame) -> DataFrame:
    """part, no, exits: what is still to come behind each slice, less the least of it; null for the last."""

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, ahead = object(), None
        for b in batches:
            out = []
            for c, cost in zip(column(b, "conv_id"), column(b, "costs")):
                if c != before:
                    before, ahead = c, None
                out.append(ahead)
                come = cost[16:] if ahead is None else [min(cost[4 * p + q] + ahead[q] for q in range(4) if cost[4 * p + q] >= 0) for p in range(4)]
                ahead = [x - min(come) for x in come]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(out, pa.list_(pa.int64()))], names=["part", "no", "exits"])

    return _in_order(costs, passed, "part int, no int, exits array<long>", True)


_TRACED = "part int, no int, ways array<struct<edits array<string>, tail string, state int>>"


def _traced(slices: DataFrame) -> DataFrame:
    """For each slice and each state that it may be entered in: edits of each row, inserts behind, state behind. Slices that are all of a conversation (not linked) are entered in one."""
    kind = pa.list_(pa.struct([("edits", pa.list_(pa.string())), ("tail", pa.string()), ("state", pa.int32())]))

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for items, linked, exits in zip(_items(b), column(b, "linked"), column(b, "exits")):
                lattice = Lattice(items, TERMINAL) if exits is None else Lattice(items, tuple(exits), False)
                found = [lattice.trace(q) for q in range(4 if linked else 1)]
                out.append([{"edits": rows, "tail": tail, "state": state} for rows, tail, state in found])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, kind)], names=["part", "no", "ways"])

    return slices.select("part", "no", "items", "linked", "exits").mapInArrow(task(traced), _TRACED)


def _entered(ways: DataFrame) -> DataFrame:
    """part, no, entry: the state in which each slice is entered."""

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, state = object(), START
        for b in batches:
            out = []
            for c, states in zip(column(b, "conv_id"), column(b, "states")):
                if c != before:
                    before, state = c, START
                out.append(state)
                state = states[state]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(out, pa.int32())], names=["part", "no", "entry"])

    return _in_order(ways, passed, "part int, no int, entry int", False)


def edited(turns: DataFrame, most: int = SLICE) -> DataFrame:
    """The rows of turns (conv_id, turn, role, text, copies; none null but conv_id and turn) with their faults, their places, and the cheapest edits.

    edits: those up to the row, each a letter (D, I, K, R) and the initial of the
    new role or `-`; all copies behind the first go.  tail: inserts behind the
    last row.  A null conv_id is a conversation like others.
    """
    spark = turns.sparkSession
    rows = written(_sliced(faulted(turns), most), "sliced-turns")
    item = F.struct("at", F.substring("role", 1, 1).alias("initial"), "fault")
    slices = rows.groupBy("part", "no").agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(item)).alias("items"))
    slices = written(slices, "slices")
    several = slices.groupBy("conv_id").agg(F.count("*").alias("slices")).where("slices > 1").select(F.col("conv_id").alias("c"), F.lit(True).alias("linked"))
    known = written(slices.join(several, F.col("conv_id").eqNullSafe(F.col("c")), "left").select("conv_id", "part", "no", "items", F.coalesce("linked", F.lit(False)).alias("linked")), "linked-slices")
    exits = written(_exits(_costs(known.where("linked"))), "exits")
    ways = written(_traced(known.join(exits, ["part", "no"], "left")), "edits")
    chains = known.where("linked").select("conv_id", "part", "no").join(ways.select("part", "no", F.col("ways.state").alias("states")), ["part", "no"]).select("conv_id", "part", "no", "states")
    entries = written(_entered(chains), "entries")
    way = F.get("ways", F.coalesce("entry", F.lit(START)))
    chosen = written(ways.join(entries, ["part", "no"], "left").select("part", "no", way.alias("way")), "chosen-edits")
    dropped(spark, slices, known, exits, ways, entries)
    last = F.col("at") == F.size("way.edits") - 1
    return rows.join(chosen, ["part", "no"]).select(*rows.columns, F.get("way.edits", F.col("at")).alias("edits"), F.when(last, F.col("way.tail")).otherwise("").alias("tail"))


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, part, no, at, k, edit, role, text: the rows of the repaired conversations, in the order of part, no, at and k, from edited rows; deleted rows are gone."""
    each = F.regexp_extract_all(F.concat("edits", "tail"), F.lit("(..)"), 1)
    out = rows.select("*", F.posexplode(each).alias("k", "e"))
    edit, new = F.substring("e", 1, 1), F.when(F.endswith("e", F.lit("u")), "user").otherwise("assistant")
    return out.select("conv_id", "part", "no", "at", "k", edit.alias("edit"), F.when(edit == "K", F.col("role")).otherwise(new).alias("role"), F.when(edit == "I", "").otherwise(F.col("text")).alias("text")).where("edit != 'D'")


def repair_conversations(turns: DataFrame, most: int = SLICE) -> DataFrame:
    """The repaired conversations of a table with conv_id, turn, role and text; nulls in role and text count as one space.

    Rows without a turn come first, rows of one turn in the order of role and
    text.  Repeated rows are duplicates.  Texts of any length are taken.  An
    empty table gives an empty result; other columns aren't read, whatever their
    names.
    """
    picked = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).cast("long").alias("copies"))
    return repaired(edited(picked, most))


def damaged(turns: DataFrame) -> DataFrame:
    """op12's damage by the CRC-32 of `conv_id:turn`; null ids, turns, roles and texts count as one space there."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    h = F.crc32(key) % 20
    return turns.where(h != 0).select(
        "conv_id", "turn", F.when(h == 4, "user").otherwise(role).alias("role"),
        F.when(h == 1, "").when(h == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), F.when(h == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


class _Digest:
    """What op12 tells of one conversation, row after row; its memory is that of the audit."""

    LEGAL = ("su", "ua", "au")

    def __init__(self) -> None:
        self.low = self.high = self.turn = self.initial = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.lines = 0
        self.audit: list[str] = []
        self.sha = hashlib.sha256()

    def add(self, turn, role: str, text: str, copies: int, fault: str, edits: str, tail: str) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.turn
            self.high = self.turn = turn
        initial = role[:1]
        self.illegal += copies - 1 + (self.initial is not None and self.initial + initial not in self.LEGAL)
        self.initial = initial
        self.blank += copies if fault == "b" else 0
        self.duplicate += 0 if fault == "b" else copies if fault == "d" else copies - 1
        self.truncated += fault == "t"
        self.cost += DELETE * (copies - 1)
        for e in (*zip(edits[::2], edits[1::2]), *zip(tail[::2], tail[1::2])):
            self.cost += {"D": DELETE, "I": INSERT, "R": REROLE, "K": 0}[e[0]] + (TRUNCATED if e[0] in "KR" and fault == "t" else 0)
            if e[0] != "D":
                line = f"{role if e[0] == 'K' else ROLES[e[1]]}:{'' if e[0] == 'I' else text}"
                self.sha.update(f"{'\n' if self.lines else ''}{line}".encode())
                self.lines += 1
        self.audit += (edits[::2], "D" * (copies - 1), tail[::2])

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


def digests(rows: DataFrame) -> DataFrame:
    """A row for each conversation of edited rows: the columns of op12.

    The digest of a text can't be taken in parts, so the rows of a conversation
    pass through one task, in their order and one at a time.
    """
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    kinds = [pa.int64()] * 6 + [pa.string()] * 2

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, now, out, ids = None, None, [], []

        def taken(kind: pa.DataType) -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(ids, kind), *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], names=["conv_id", *names])
            out.clear()
            ids.clear()
            return done

        kind = None
        for b in batches:
            kind = b.column(0).type
            for c, *rest in zip(*(x.to_pylist() for x in b.columns[:8])):
                if now is None or c != before:
                    if now is not None:
                        ids.append(before)
                        out.append(now.row())
                    before, now = c, _Digest()
                now.add(*rest)
            if len(out) > 1000:
                yield taken(kind)
        if now is not None:
            ids.append(before)
            out.append(now.row())
            yield taken(kind)

    picked = rows.select("conv_id", "turn", "role", "text", "copies", "fault", "edits", "tail", "part", "no", "at")
    schema = rows.select("conv_id", *(F.lit(0).cast("long").alias(n) for n in names[:6]), *(F.lit("").alias(n) for n in names[6:])).schema
    order = [F.col("conv_id").asc_nulls_first(), "part", "no", "at"]
    return picked.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(task(made), schema)


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = digests(edited(damaged(turns)))
    every = turns.select(F.col("conv_id").alias("c")).distinct()
    out = every.join(found, F.col("c").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("c").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _oracle() -> str:
    """Costs and letters still to come behind each row, from the last row back, for the four states."""
    table = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    key = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    crc = f"xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode({key})), '..'), lambda h: ('0x' || h)::BIGINT), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1]), 4294967295::BIGINT))"
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

    def plus(letter: str, cost: str, to: str) -> str:
        return f"{{'c': acc.{to}.c + {cost}, 'a': '{letter}' || acc.{to}.a}}"

    def least(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    never = "{'c': 1000000000, 'a': ''}"
    step, gone = {}, "x.fault IN ('b', 'd')"
    more = "(CASE WHEN x.fault = 't' THEN 3 ELSE 0 END)"
    for q, keeps, to in (("n", {"s": "s", "u": "u"}, "u"), ("s", {"u": "u"}, "u"), ("u", {"a": "p"}, "p"), ("p", {"u": "u"}, "u")):
        kept = [f"CASE WHEN x.i = '{i}' AND NOT {gone} THEN {plus('K', more, k)} ELSE {never} END" for i, k in keeps.items()]
        step[q] = least(plus("D", "4", q), *kept, f"CASE WHEN {gone} THEN {never} ELSE {plus('R', f'3 + {more}', to)} END")
    state = lambda b, q, to: least(f"{b}.{q}", f"{{'c': {b}.{to}.c + 3, 'a': 'I' || {b}.{to}.a}}")
    pairs = lambda b: f"{{'n': {b}.n, 's': {b}.s, 'u': {state(b, 'u', 'p')}, 'p': {state(b, 'p', 'u')}}}"
    fronts = lambda b: f"{{'n': {state(b, 'n', 'u')}, 's': {state(b, 's', 'u')}, 'u': {b}.u, 'p': {b}.p}}"
    moved = "{" + ", ".join(f"'{q}': {step[q]}" for q in "nsup") + "}"
    inserted = f"list_transform(list_transform([{moved}], lambda b: {pairs('b')}), lambda b: {fronts('b')})[1]"
    first = "{'n': {'c': 0, 'a': ''}, 's': {'c': 6, 'a': 'II'}, 'u': {'c': 3, 'a': 'I'}, 'p': {'c': 0, 'a': ''}}"
    ctes = [
        f"hashed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS h FROM conversations)",
        "kept AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM hashed, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) WHERE h <> 0)",
        f"placed AS (SELECT *, rtrim(text, {space}) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM kept)",
        "rows AS (SELECT *, role[1:1] AS i, CASE WHEN t = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'd' WHEN t[-1:] NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY k) AS p FROM placed)",
        "counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,"
        " count(*) FILTER (p IS NOT NULL AND p || i NOT IN ('su', 'ua', 'au')) AS illegal, list({'i': i, 'fault': fault} ORDER BY k DESC) AS items FROM rows GROUP BY conv_id)",
        f"best AS (SELECT *, list_reduce(items, lambda acc, x: {inserted}, {first}).n AS b FROM counts)",
        "letters AS (SELECT conv_id, j, b.a[j:j] AS e, length(regexp_replace(b.a[1:j], 'I', '', 'g')) AS k, length(regexp_replace(b.a[1:j], 'D', '', 'g')) AS o FROM best, unnest(range(1, length(b.a) + 1)) AS places(j))",
        "outs AS (SELECT l.conv_id, l.j, l.e, l.o, r.role, r.text, max(CASE WHEN l.o = 1 AND l.e = 'K' AND r.i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS lead FROM letters l LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.k = l.k AND l.e <> 'I' WHERE l.e <> 'D')",
        "lines AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (o - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS t FROM outs GROUP BY conv_id)",
        "every AS (SELECT DISTINCT conv_id FROM conversations)",
    ]
    counted = ", ".join(f"coalesce(b.{n}, 0)::BIGINT AS {n}" for n in ("gaps", "blank", "duplicate", "truncated", "illegal"))
    return f"WITH {', '.join(ctes)} SELECT v.conv_id, {counted}, coalesce(b.b.c, 0)::BIGINT AS cost, coalesce(b.b.a, '') AS audit, sha256(coalesce(l.t, '')) AS repaired_sha256 FROM every v LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM v.conv_id LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM v.conv_id"


QUERIES = {"op12_conversations": op12_conversations}
ORACLES = {"op12_conversations": _oracle()}

"""Best-fit packing of token sequences by linear grouping.

Lengths are whole numbers up to the capacity, so a histogram of at most
`capacity` numbers describes all pieces, however many there are, and the plan is
made from it alone.  Long lengths are split into groups of equal cardinality and
rounded up to the largest of their group; few sizes remain, for which whole
configurations (multisets that fit a sequence) are optimised by column
generation.  The actual pieces then take the places of the rounded ones, and the
short ones, and those that no whole use of a configuration takes, go where they
fit best.
Bins alike are kept as one row with a count, so the plan stays small as well.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import dropped, written
from .textbytes import column
from .tokens import encoder, vocabulary
from .worker import task

CAPACITY = 1024
END = 2
VOCABULARY = "byte_bpe_50k.json"
#: Settings tried: lengths over this share of the capacity are long; groups of long lengths, at most a quarter of their number, so that every plan rounds (FEW lengths are few sizes as they are). The plan with the fewest sequences is taken.
SETTINGS = ((0.2, 60), (0.28, 80), (0.32, 70), (0.33, 100))
FEW = 16
#: Times that what is left is grouped again; all but the last use half of what is planned.
TURNS = 5
#: Configurations that may enter the basis of the linear programme.
ROUNDS = 500


def fullest(sizes: np.ndarray, worth: np.ndarray, need: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes of the greatest worth that fits the capacity, no size more often than it is needed: its worth, and how often each size is in it."""
    best = np.zeros(capacity + 1)
    steps = []
    for size, value, most in zip(sizes.tolist(), worth.tolist(), need.tolist()):
        left = min(int(most), capacity // size)
        times = np.zeros(capacity + 1, np.int64)
        if value > 1e-12 and left:
            ways = np.full((left + 1, capacity + 1), -1.0)
            ways[0] = best
            for n in range(1, left + 1):
                ways[n, n * size :] = best[: capacity + 1 - n * size] + n * value
            times = ways.argmax(axis=0)
            best = ways[times, np.arange(capacity + 1)]
        steps.append(times)
    counts, room = np.zeros(len(sizes), np.int64), capacity
    for k in range(len(sizes) - 1, -1, -1):
        counts[k] = steps[k][room]
        room -= counts[k] * sizes[k]
    return float(best[capacity]), counts


def optimised(sizes: list[int], need: list[int], capacity: int, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], int]]:
    """How often to use which configuration of the sizes: the fewest in all, by column generation on the linear programme, rounded down.

    The basis begins with configurations of one size each; the one that the
    duals of the basis find worth most enters, until none is worth more than a
    sequence.  Pieces that no whole use takes are left to best fit.
    """
    size, want = np.array(sizes), np.array(need, np.float64)
    if not len(size):
        return []
    basis = np.diag(np.minimum(capacity // size, np.maximum(1, want)).astype(np.float64))
    inverse = np.diag(1 / basis.diagonal())
    for turn in range(rounds):
        worth, entering = fullest(size, np.maximum(inverse.sum(axis=0), 0), want, capacity)
        if worth <= 1 + 1e-7:
            break
        amounts, change = inverse @ want, inverse @ entering
        up = change > 1e-9
        ratio = np.where(up, np.maximum(amounts, 0) / np.where(up, change, 1), np.inf)
        if not up.any():
            break
        k = int(ratio.argmin())
        basis[:, k] = entering
        row = inverse[k] / change[k]
        change[k] -= 1
        inverse -= np.outer(change, row)
        if turn % 64 == 63:
            inverse = np.linalg.inv(basis)
    amounts = np.linalg.solve(basis, want)
    used, left = [], want.astype(np.int64)
    for k in np.argsort(-amounts, kind="stable"):
        config = basis[:, k].astype(np.int64)
        times = min([int(np.floor(amounts[k] + 1e-6)), *(left[config > 0] // config[config > 0])])
        if times > 0:
            used.append((tuple(config.tolist()), int(times)))
            left -= config * int(times)
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """The best of the plans by all SETTINGS."""
    return min((grouped_plan(histogram, capacity, *s) for s in SETTINGS), key=sequences)


def sequences(rows: list[tuple[int, int, int, int, int]]) -> int:
    return max((r[3] + r[2] for r in rows), default=0)


def grouped(histogram: dict[int, int], lengths: list[int], n_groups: int) -> list[list[int]]:
    """Runs of lengths (descending) of about equal cardinality."""
    total = sum(histogram[n] for n in lengths)
    groups, seen = [], 0
    for n in lengths:
        if not groups or seen * n_groups >= total * len(groups):
            groups.append([])
        groups[-1].append(n)
        seen += histogram[n]
    return groups


def substituted(used: list[tuple[tuple[int, ...], int]], sizes: list[int], supply: dict[int, int], capacity: int) -> list[tuple[int, list[int], int]]:
    """Sequences (room, lengths, how many alike) of actual pieces in the places of configurations; takes the pieces from the supply.

    Each place takes the longest piece that its rounded size lets in, the last
    of a sequence the longest that fits at all: what rounding up has left goes to
    longer pieces, and as no place takes more pieces of a size away than it
    stands for, none stays empty.
    """
    lengths = sorted(supply)
    counts, bins = [supply[n] for n in lengths], []
    for config, times in sorted(used, reverse=True):  # those of the longest pieces first, so that these find what fits beside them
        slots = [sizes[i] for i, n in enumerate(config) for _ in range(n)]
        while times:
            took, room, places = [], capacity, Counter()
            for k, slot in enumerate(slots):
                at = bisect.bisect_right(lengths, room if k == len(slots) - 1 else slot) - 1
                while counts[at] <= places[at]:
                    at -= 1
                places[at] += 1
                took.append(lengths[at])
                room -= lengths[at]
            alike = min(times, *(counts[at] // n for at, n in places.items()))  # so many sequences take the same lengths
            bins.append((room, took, alike))
            times -= alike
            for at, n in sorted(places.items(), reverse=True):
                counts[at] -= n * alike
                if not counts[at]:
                    del lengths[at], counts[at]
    supply.clear()
    supply.update(zip(lengths, counts))
    return bins


def grouped_plan(histogram: dict[int, int], capacity: int, share: float, n_groups: int) -> list[tuple[int, int, int, int, int]]:
    """Places for all pieces: rows (length, first rank, count, first sequence, offset).

    The pieces of a length with ranks first .. first + count - 1 go to the
    sequences first_sequence, first_sequence + 1, ..., each at the offset.
    What is left of the long pieces is grouped again, so that rounding follows
    what substitution leaves; in the end they go with the short ones.
    """
    full = histogram.get(capacity, 0)
    long = sorted((n for n in histogram if capacity * share < n < capacity), reverse=True)
    supply = {n: histogram[n] for n in long}
    bins: list[tuple[int, list[int], int]] = []  # room, lengths, count
    for turn in range(TURNS):
        lengths = sorted(supply, reverse=True)
        groups = grouped(supply, lengths, min(n_groups, len(lengths) // 4)) if len(lengths) > FEW else [[n] for n in lengths]
        used = optimised([g[0] for g in groups], [sum(supply[n] for n in g) for g in groups], capacity)
        if turn < TURNS - 1:
            used = [(c, n // 2) for c, n in used if n > 1]
        bins += substituted(used, [g[0] for g in groups], supply, capacity)

    # What is left, longest first, each where the least room is left that is enough.
    rest = {n: histogram[n] for n in histogram if 0 < n <= capacity * share} | supply
    by_room: dict[int, list[list]] = defaultdict(list)
    for room, took, alike in bins:
        by_room[room].append([took, alike])
    rooms = sorted(by_room)
    closed = []

    def put(room: int, took: list[int], alike: int) -> None:
        if not by_room[room]:
            bisect.insort(rooms, room)
        by_room[room].append([took, alike])

    for n in sorted(rest, reverse=True):
        left = rest[n]
        while left:
            k = bisect.bisect_left(rooms, n)
            if k == len(rooms):  # new sequences, filled with this length
                each = min(capacity // n, left)
                put(capacity - each * n, [n] * each, left // each)
                left -= left // each * each
                continue
            room = rooms[k]
            took, alike = by_room[room].pop()
            each = min(room // n, left)
            times = min(alike, left // each)
            if not by_room[room]:
                rooms.pop(k)
            if alike > times:
                put(room, took, alike - times)
            put(room - each * n, took + [n] * each, times)
            left -= each * times
    for room in rooms:
        closed += by_room[room]

    rows = [(capacity, 0, full, 0, 0)] if full else []
    sequence, rank = full, Counter()
    for took, alike in closed:
        offset = 0
        for n in took:
            rows.append((n, rank[n], alike, sequence, offset))
            rank[n] += alike
            offset += n
        sequence += alike
    return rows


def cut_pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids; the first may be shorter."""
    first = n % capacity or capacity
    return [(0, min(first, n)), *((s, capacity) for s in range(first, n, capacity))]


def pack_documents(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, end_id: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each row of docs.

    Null and empty texts are one end id.  Repeated rows are packed each for
    itself; ids may be null.  Other columns aren't read.  An empty table gives
    no pieces.  One pass tokenizes and numbers the pieces of each length within
    its task; counts by task and length then give each piece its rank among all
    of its length without sorting them, and the plan gives the rank its place.
    """
    spark = docs.sparkSession

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, end = TaskContext.get().partitionId(), Counter(), np.array([end_id], "<u4").tobytes()
        encode = encoder(vocabulary_path).encode
        for b in batches:
            rows: list[list] = [[] for _ in range(7)]
            ids = b.column(0)
            keep = []
            for i, got in enumerate(encode(column(b, "text"))):
                got += end
                for k, (start, n) in enumerate(cut_pieces(len(got) // 4, capacity)):
                    keep.append(i)
                    for to, v in zip(rows, (k, start, n, zlib.crc32(got[4 * start : 4 * (start + n)]), task, made[n])):
                        to.append(v)
                    made[n] += 1
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep, pa.int32())), *(pa.array(v, t) for v, t in zip(rows, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())))], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = source.select("doc_id", F.lit(0).alias("piece"), *(F.lit(0).cast("long").alias(c) for c in ("start", "length", "ids_crc32")), F.lit(0).alias("task"), F.lit(0).cast("long").alias("nth")).schema
    pieces = written(source.mapInArrow(task(tokenized, encodes=True), schema), "pieces")

    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    sent = spark.sparkContext.broadcast(table(plan(histogram, capacity)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, first, sequence, offset = sent.value
        for b in batches:
            n, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            # Rows are ordered by length and first rank: one search over both.
            row = np.searchsorted(lengths * RANKS + first, n * RANKS + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(sequence[row] + rank - first[row]), pa.array(offset[row])], names=out.names)

    ranked = pieces.join(counts, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    out = ranked.drop("rank").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    return ranked.mapInArrow(task(placed, encodes=True), out)


#: More than the pieces of any one length.
RANKS = 1 << 50


def table(rows: list[tuple[int, int, int, int, int]]) -> tuple[np.ndarray, ...]:
    """The plan as arrays ordered by length and first rank: length, first rank, first sequence, offset."""
    a = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return a[:, 0], a[:, 1], a[:, 3], a[:, 4]


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary(VOCABULARY))


QUERIES = {"op4_packing": op4_packing}

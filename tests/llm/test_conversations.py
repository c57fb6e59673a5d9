import hashlib
import random
import re
import zlib
from functools import lru_cache

import duckdb
import pytest
from tesserine.llm import conversations as c

SF = "/root/testdata/sf0.001"


def cheapest(rows):
    """(cost, letters, lines) of the cheapest edits of (role, text, fault), by trying all of them behind each state."""

    @lru_cache(None)
    def best(k, state, inserted):
        ways = [(0, "", ())] if k == len(rows) and state in ("", "p") else []

        def go(letter, cost, line, after, nk, ni):
            rest = best(nk, after, ni)
            if rest:
                ways.append((cost + rest[0], letter + rest[1], line + rest[2]))

        new, after = ("assistant", "p") if state == "u" else ("user", "u")
        if inserted < 2:
            go("I", 3, (f"{new}:",), after, k, inserted + 1)
        if k < len(rows):
            role, text, fault = rows[k]
            go("D", 4, (), state, k + 1, 0)
            if fault not in ("b", "d"):
                more = 3 if fault == "t" else 0
                go("R", 3 + more, (f"{new}:{text}",), after, k + 1, 0)
                if role[:1] == new[:1]:
                    go("K", more, (f"{role}:{text}",), after, k + 1, 0)
                if role[:1] == "s" and state == "":
                    go("K", more, (f"{role}:{text}",), "s", k + 1, 0)
        return min(ways) if ways else None

    return best(0, "", 0)


def brute(turns):
    """op12's columns by hand."""
    convs = {}
    for conv, turn, role, text in turns:
        own = convs.setdefault(conv, [])
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role = "user" if h == 4 else role
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        own += [(turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, rows = set(), []
        for _, role, text in own:
            t = text.rstrip(" \t\n\x0b\x0c\r")
            rows.append((role, text, "b" if not t else "d" if (role, text) in seen else "t" if t[-1] not in ".!?" else ""))
            seen.add((role, text))
        cost, audit, lines = cheapest(tuple(rows))
        known = {t for t, *_ in own if t is not None}
        faults = [r[2] for r in rows]
        out.append((conv, max(known) - min(known) + 1 - len(known) if known else 0, faults.count("b"), faults.count("d"), faults.count("t"), sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(n):
    rng = random.Random(4)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "User"], ["Yes.", "no", "", None, " \t\n", "Why?!", "wait… ", "é!\n", "a.b", "Yes."]
    out = []
    for conv in [*range(n), None]:
        for k in range(rng.choice([1, 2, 3, 5, 8, 13])):
            turn = None if rng.random() < 0.05 else rng.choice([k, k, k, k * 2, 1])
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.6 else rng.choice(roles)
            out.append((conv, turn, role, f"text {k}." if rng.random() < 0.5 else rng.choice(texts)))
        if rng.random() < 0.1:
            out.append(out[-1])
    return out


@pytest.mark.parametrize("most", [1, 2, 5, 512])
def test_against_trying_all(spark, most, tmp_path, monkeypatch):
    turns = conversations(120)
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as part", "2 as copies", "'x' as fault").repartition(4)
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    monkeypatch.setattr(c, "edited", lambda t, m=most, f=c.edited: f(t, m))
    got = sorted((tuple(r) for r in c.op12_conversations(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(turns)


def test_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    df = c.op12_conversations(spark, SF)
    cursor = duck.execute(c.ORACLES["op12_conversations"])
    names = [x[0] for x in cursor.description]
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == sorted(cursor.fetchall())
    turns = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in df.collect()), key=str) == brute(turns)


def test_prices_are_costs_to_come():
    rng = random.Random(1)
    for _ in range(60):
        items = [(rng.choice("suax"), rng.choice(["", "", "", "t", "d", "b"])) for _ in range(rng.choice([0, 1, 4, 30]))]
        lattice = c.Lattice(items, c.TERMINAL)
        for node, arcs in enumerate(lattice.out):
            assert lattice.price[node] == min(cost + lattice.price[head] for _, cost, head in arcs)


def test_a_long_conversation_takes_slices(spark):
    """One conversation with most of the rows: its slices are dealt to several tasks, and the result is that of one slice."""
    rng = random.Random(7)
    rows = [(1, k, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", "c?", ""]) + (str(k) + "." if rng.random() < 0.8 else "")) for k in range(3000)] + [(2, 0, "user", "hi.")] + [(3, 5, "user", "hi.")] * 500
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    one, many = (sorted(tuple(r) for r in c.digests(c.edited(df.selectExpr("*", "1L as copies"), most)).collect()) for most in (10000, 100))
    assert one == many and [r[:7] for r in many[1:]] == [(2, 0, 0, 0, 0, 0, 3), (3, 0, 0, 499, 0, 499, 499 * 4 + 3)] and many[2][7] == "K" + "D" * 499 + "I"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # which joins partitions as small as these
    sliced = c._sliced(c.faulted(df.selectExpr("*", "1L as copies")), 100)
    assert sliced.where("conv_id = 1").select("part").distinct().count() > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    lines = sorted((r.conv_id, r.part, r.no, r.at, r.k, r.role, r.text) for r in c.repair_conversations(df, 100).collect())
    for conv, *_, sha in many:
        text = "\n".join(f"{role}:{t}" for i, *_, role, t in lines if i == conv)
        assert hashlib.sha256(text.encode()).hexdigest() == sha
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for i, *_, role, _ in lines if i == conv))


def test_empty_table_and_long_text(spark, tmp_path):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert c.repair_conversations(empty).collect() == []
    empty.write.parquet(str(tmp_path / "conversations.parquet"))
    assert c.op12_conversations(spark, str(tmp_path)).collect() == []
    (a, b) = sorted(c.repair_conversations(spark.createDataFrame([(1, 1, "user", "x" * 2_000_000 + ".")], "conv_id long, turn long, role string, text string")).collect(), key=lambda r: r.k)
    assert len(a.text) == 2_000_001 and (b.role, b.text, b.edit) == ("assistant", "", "I")

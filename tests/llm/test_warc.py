import base64
import gzip
import hashlib
import random

from tesserine.llm import warc as w
from tesserine.llm.shared import new_path


def brute(rows, least=0):
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= least:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        f = first.get(h or "", i)
        revisit = i is not None and f != i and len(data) >= least
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=str)


CASES = [(5, "http://a/", "<p>é</p>"), (3, "http://b/\r\nX: y", "<p>é</p>"), (9, None, None), (8, "u", ""), (7, "u", "x\r\n\r\nWARC/1.0\r\ny" * 9), (None, "u", "<p>é</p>"), (3, "http://b/", "<p>é</p>"), (20, "u", "long " * 300000), (21, "u", "\x1f\x8b\x08 bytes")]


def test_round_trip(spark):
    df = spark.createDataFrame(CASES, "page_id long, url string, html string").selectExpr("*", "1 as sha", "2 as first").repartition(2)
    for least in (0, 5):
        path = new_path(spark, "w")
        w.write_archives(df, path, least)
        rows = w.read_archives(spark, path).collect()
        assert all(r.gap is None for r in rows)
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str) == brute(CASES, least)
        assert {(r.page_id, bytes(r.payload)) for r in rows if r.payload is not None} <= {(i, (h or "").encode()) for i, _, h in CASES}
    path = new_path(spark, "w")
    w.write_archives(df.limit(0), path)
    assert w.read_archives(spark, path).collect() == []


def members(n):
    return [gzip.compress(w.record(i, f"http://{i}/", (f"page {i} " * 50).encode(), None), mtime=0) for i in range(n)]


def got(data):
    records, at = [], 0
    for kind, offset, length, head, payload in w.salvage(data):
        assert offset >= at and length > 0
        at = offset + length
        if kind == "record" and "warc-record-id" in head:
            records.append(int(head["warc-record-id"][10:-1]))
    assert at <= len(data)
    return records


def test_damage_costs_only_what_it_touches():
    whole = members(6)
    data = b"".join(m + w.SEPARATOR for m in whole)
    assert got(data) == [0, 1, 2, 3, 4, 5]
    starts = [sum(len(m) + len(w.SEPARATOR) for m in whole[:k]) for k in range(6)]
    broken = bytearray(data)
    broken[starts[2] + 60] ^= 255
    assert got(bytes(broken)) == [0, 1, 3, 4, 5]
    assert got(b"junk" + data) == [0, 1, 2, 3, 4, 5]
    assert got(data[: starts[5] + 30]) == [0, 1, 2, 3, 4]
    assert got(data[: starts[1]] + data[starts[1] + 40 :]) == [0, 2, 3, 4, 5]


def test_plain_files_go_on_at_the_next_version_line():
    records = [w.record(i, "u", b"text %d" % i, None) for i in range(5)]
    assert got(b"".join(records)) == [0, 1, 2, 3, 4]
    wrong = records[1].replace(b"text 1", b"text X")
    cut = records[3][:-9]
    assert got(b"".join([records[0], wrong, records[2], cut, records[4]])) == [0, 2, 4]


def test_any_flip_leaves_the_others():
    r, whole = random.Random(2), members(4)
    data = b"".join(m + w.SEPARATOR for m in whole)
    for _ in range(40):
        k, broken = r.randrange(len(data)), bytearray(data)
        broken[k] ^= 1 << r.randrange(8)
        assert len(set(got(bytes(broken)))) >= 3


def test_whole_table(spark):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    assert sorted((tuple(r) for r in w.op6_warc(spark, "/root/testdata/sf0.001").collect()), key=str) == brute(rows)


def test_very_long_urls(spark):
    cases = [(1, "data:text/html," + "a" * 70_000, "<p>1</p>"), (2, "http://b/?q=" + "é" * 300_000, "<p>2</p>"), (3, "u", "<p>1</p>")]
    path = new_path(spark, "w")
    w.write_archives(spark.createDataFrame(cases, "page_id long, url string, html string"), path)
    rows = w.read_archives(spark, path).collect()
    assert all(r.gap is None for r in rows)
    assert sorted((r.page_id, r.url) for r in rows) == [c[:2] for c in cases]
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str) == brute(cases)


def salvaged(data):
    rows = list(w.salvage(data))
    assert all(r[2] > 0 for r in rows)
    return [int(r[3]["warc-record-id"][10:-1]) for r in rows if r[0] == "record"], sum(r[0] == "gap" for r in rows)


def test_damage_within_a_member_leaves_its_other_records():
    noise = random.Random(3)
    records = [w.record(i, "u", b"text %d " % i + noise.randbytes(100_000), None) for i in range(5)]
    assert salvaged(gzip.compress(b"".join(records), mtime=0)) == ([0, 1, 2, 3, 4], 0)
    wrong = records[1].replace(b"text 1", b"text X")
    one = gzip.compress(b"".join([records[0], wrong, *records[2:]]), mtime=0)
    more = w.SEPARATOR + gzip.compress(w.record(9, "u", b"nine", None), mtime=0)
    assert salvaged(one + more) == ([0, 2, 3, 4, 9], 1)
    for level in (0, 6):
        whole = gzip.compress(b"".join(records), level, mtime=0)
        assert salvaged(whole[: int(len(whole) * 0.7)]) == ([0, 1, 2], 1)
        assert salvaged(whole[:-4]) == ([0, 1, 2, 3, 4], 1)
        cut = int(len(whole) * 0.7)
        assert salvaged(whole[:cut] + more) == ([0, 1, 2, 9], 1)
        flipped = bytearray(whole + more)
        flipped[len(whole) - 6] ^= 255
        assert salvaged(bytes(flipped)) == ([0, 1, 2, 3, 4, 9], 1)


def test_corrupt_members_give_no_record_that_nothing_vouches_for():
    data = bytearray(gzip.compress(w.record(1, "u", b"", 5), mtime=0))
    data[-6] ^= 255
    assert salvaged(bytes(data)) == ([], 1)


def test_files_have_a_bound_and_gaps_are_quarantined(spark, monkeypatch, caplog):
    from tesserine.llm.binary_files import read_files, write_records

    monkeypatch.setattr(w, "FILE_BYTES", 5000)
    cases = [(i, "u", f"page {i} " * 100) for i in range(60)]
    path, gaps = new_path(spark, "w"), new_path(spark, "gaps")
    w.write_archives(spark.createDataFrame(cases, "page_id long, url string, html string").coalesce(1), path)
    files = read_files(spark, path)
    assert files.count() >= 8
    assert w.read_with_quarantine(spark, path, gaps).count() == 60
    damaged = new_path(spark, "w")
    bad = [bytes(r.content) for r in files.orderBy("path").collect()]
    bad[0] = bad[0][:40] + b"\0" * 30 + bad[0][70:]
    write_records(spark.createDataFrame([(c,) for c in bad], "record binary"), damaged, w.SEPARATOR)
    got = w.read_with_quarantine(spark, damaged, gaps)
    assert 55 <= got.count() < 60 and "gap" not in got.columns
    assert spark.read.json(gaps).count() >= 1 and "quarantined" in caplog.text


def test_numbers_of_any_size_are_damage(spark):
    good = [w.record(i, "u", b"text %d" % i, None) for i in range(3)]
    revisit = w.record(7, "u", b"text 1", 1)
    bad = [
        good[1].replace(b"Content-Length: ", b"Content-Length: " + b"9" * 5000), revisit.replace(b"X-Payload-Length: 6", b"X-Payload-Length: six"), revisit.replace(b"X-Payload-Length: 6", b"X-Payload-Length: " + b"6" * 30),
        revisit.replace(b"page:7", b"page:" + b"7" * 19), good[1].replace(b"Content-Length: ", "Content-Length: \u0663".encode()), revisit.replace(b"page:1>", b"page:9>"), revisit.replace(b"200 OK", b"404 No"),
    ]
    for b in bad:
        for data in (b"".join([good[0], b, good[2]]), b"".join(gzip.compress(x, mtime=0) + w.SEPARATOR for x in (good[0], b, good[2]))):
            assert salvaged(data)[0] == [0, 2]
    # Headers of other writers have no check of their own.
    plain = b"WARC/1.0\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    assert [r[0] for r in w.salvage(plain)] == ["record"]


def test_flips_in_plain_files_with_revisits_through_the_reader(spark):
    """Any flipped bit loses at most one record, changes none, and never fails the read."""
    from tesserine.llm.binary_files import write_records

    r = random.Random(9)
    records = [w.record(i, f"http://u/{i}", b"text %d" % (i % 3), None if i < 3 else i % 3) for i in range(8)]
    whole = b"".join(records)
    want = {(i, 6, w.digest(b"text %d" % (i % 3)), "response" if i < 3 else "revisit", None if i < 3 else i % 3) for i in range(8)}
    files = []
    for _ in range(400):
        broken = bytearray(whole)
        broken[r.randrange(len(whole))] ^= 1 << r.randrange(8)
        files.append((bytes(broken),))
    path = new_path(spark, "w")
    write_records(spark.createDataFrame(files, "record binary").repartition(8), path, b"\n\n\n", 1)
    by_file = {}
    for x in w.read_archives(spark, path).where("gap is null").collect():
        by_file.setdefault(x.file, []).append((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to))
    assert len(by_file) == 400
    for found in by_file.values():
        assert len(found) >= 7 and set(found) <= want


def test_a_large_page_leaves_files_of_the_others_alone(spark, monkeypatch):
    from tesserine.llm.binary_files import read_files

    monkeypatch.setattr(w, "FILE_BYTES", 40_000)
    cases = [(i, "u", f"page {i} " * 20) for i in range(100)] + [(500, "u", "x" * 1_000_000)]
    path = new_path(spark, "w")
    w.write_archives(spark.createDataFrame(cases, "page_id long, url string, html string").coalesce(1), path)
    assert read_files(spark, path).count() <= 4
    assert w.read_archives(spark, path).where("gap is null").count() == 101

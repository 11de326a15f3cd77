"""Damaged archives."""

from __future__ import annotations

import gzip
import hashlib

from marketlens.llm.warc import op10_warc, salvage, write_archives


def record(n: int, payload: bytes = b"", length: int | None = None) -> bytes:
    payload = payload or b"payload %d " % n * 20
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    return (
        b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:%d>\r\nWARC-Payload-Digest: sha256:%s\r\nContent-Length: %d\r\n\r\n"
        % (n, hashlib.sha256(payload).hexdigest().encode(), len(block) if length is None else length)
    ) + block + b"\r\n\r\n"


def read(data: bytes) -> tuple[list[str], list[tuple]]:
    rows = list(salvage(data))
    return [r["record_id"][12:-1] for r in rows if r["gap"] is None], [
        (r["gap"], r["member"], r["offset"], r["length"]) for r in rows if r["gap"]
    ]


def test_whole_file():
    assert read(b"".join(map(record, range(4)))) == (["0", "1", "2", "3"], [])
    assert read(b"") == ([], [])


def test_wrong_length_digest_and_end():
    parts = [record(0), record(1, length=7), record(2), record(3).replace(b"payload 3", b"paXload 3", 1), record(4), record(5)[:-30]]
    ids, gaps = read(b"".join(parts))
    assert ids == ["0", "2", "4"]
    offsets = [sum(map(len, parts[:i])) for i in range(7)]
    assert gaps == [
        ("block of another length", -1, offsets[1], len(parts[1])),
        ("payload differs from its digest", -1, offsets[3], len(parts[3])),
        ("block cut off", -1, offsets[5], len(parts[5])),
    ]


def test_length_that_swallows_the_next_record():
    first = record(0, length=len(record(0)) + 60)
    assert read(first + record(1) + record(2))[0] == ["1", "2"]


def test_noise_before_and_between():
    noise = b"noise WARC/1.1 noise\r\n"
    ids, gaps = read(noise + record(0) + noise + record(1))
    assert ids == ["0", "1"] and [g[2:] for g in gaps] == [(0, len(noise)), (len(noise) + len(record(0)), len(noise))]


def test_members():
    members = [gzip.compress(record(i)) for i in range(5)]
    members[1] = members[1][:40] + b"\0\0\0\0" + members[1][44:]  # damaged
    members[3] = members[3][:-20]  # cut off
    ids, gaps = read(b"".join(members))
    assert ids == ["0", "2", "4"]
    offsets = [sum(map(len, members[:i])) for i in range(5)]
    assert gaps == [
        ("damaged member", None, offsets[1], len(members[1])),
        ("damaged member", None, offsets[3], len(members[3])),
    ]


def test_damage_inside_a_member():
    ids, gaps = read(gzip.compress(record(0) + b"lost bytes" + record(1)))
    assert ids == ["0", "1"] and gaps == [("no version line", 0, len(record(0)), 10)]


def test_records_ahead_of_damage():
    data = gzip.compress(b"".join(record(i, hashlib.sha512(b"%d" % i).hexdigest().encode() * 9) for i in range(200)))
    cut, _ = read(data[: len(data) // 2])
    damaged, gaps = read(data[: len(data) // 2] + b"\xff" * 40 + data[len(data) // 2 + 40 :] + gzip.compress(record(900)))
    assert len(cut) > 80 and cut == [str(i) for i in range(len(cut))]
    assert damaged[:80] == cut[:80] and damaged[-1] == "900" and any(member is None for _, member, _, _ in gaps)


def test_written_archives_lose_one_record(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 30) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    write_archives(pages, f"{tmp_path}/a")
    kept = 0
    for file in (tmp_path / "a").glob("part-*"):
        data = file.read_bytes()
        kept += len(read(data)[0])
        second = data.index(b"\x1f\x8b\x08", len(data) // 2)
        ids, gaps = read(data[: second + 30] + b"\xff\xff\xff" + data[second + 33 :])
        assert len(ids) >= len(read(data)[0]) - 1 and gaps
    assert kept == 40


def test_damage_at_the_first_byte():
    members = [gzip.compress(record(i)) for i in range(4)]
    ids, gaps = read(b"\0\0" + b"".join(members)[2:])
    assert ids == ["1", "2", "3"] and gaps == [("no member", None, 0, len(members[0]))]
    assert read(b"x" + b"".join(members)) == (["0", "1", "2", "3"], [("no member", None, 0, 1)])
    ids, gaps = read(b"V" + record(0)[1:] + record(1))
    assert ids == ["1"] and gaps == [("no version line", -1, 0, len(record(0)))]


def test_plain_records_and_members_side_by_side():
    data = gzip.compress(record(0)) + record(1) + gzip.compress(record(2)) + b"noise" + record(3) + b"tail"
    ids, gaps = read(data)
    assert ids == ["0", "1", "2", "3"]
    assert gaps == [("no version line", -1, data.index(b"noise"), 5), ("no version line", -1, len(data) - 4, 4)]


def test_members_in_a_payload_are_payload():
    """A whole plain record may hold a gzip payload; in a damaged one it is part of the gap."""
    inner = gzip.compress(b"not a record " * 9)
    assert read(record(0, inner) + record(1)) == (["0", "1"], [])
    damaged = record(0, inner).replace(b"HTTP/1.1 200 OK", b"HTTP/1.1 200 KO!")
    ids, gaps = read(damaged + record(1))
    assert ids == ["1"] and [g[2:] for g in gaps] == [(0, len(damaged))]


def test_sizes_of_repeated_ids(spark, tmp_path):
    """Rows that share an id or have none keep their own size, also those whose payload is stored elsewhere."""
    a, b = "A" * 200, "B" * 5000
    pages = [(1, a), (1, b), (2, a), (3, b), (None, a), (None, "short"), (4, None), (4, "é" * 99)]
    spark.createDataFrame([(i, "u", html) for i, html in pages], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"]) for r in op10_warc(spark, str(tmp_path)).collect())
    payloads = [(i or 0, (html or "").encode()) for i, html in pages]
    assert [row[:3] for row in got] == sorted((i, len(p), hashlib.sha256(p).hexdigest()) for i, p in payloads)
    assert [(row[0], row[1]) for row in got if row[3] == "revisit"] == [(2, 200), (3, 5000)]  # without an id: a response

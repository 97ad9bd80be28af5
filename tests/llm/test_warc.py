import base64
import gzip
import hashlib

import pytest

from barwright.llm import warc

SCHEMA = "page_id long, url string, html string, payload string"


def make(k, payload=b"hello", kind="response"):
    http = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload
    sha = lambda b: base64.b32encode(hashlib.sha1(b).digest())
    head = b"WARC/1.1\r\nWARC-Type: %s\r\nX-Page: %d\r\nWARC-Payload-Digest: sha1:%s\r\nWARC-Block-Digest: sha1:%s\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n"
    return head % (kind.encode(), k, sha(payload), sha(block), len(block)) + block + b"\r\n\r\n"


def ids(data):
    return [int(p) if (p := x[3].get(b"x-page", b"")).isdigit() else None for x in warc.scan(data) if x[0] == "record"]


def gaps(data):
    return [x[1:3] for x in warc.scan(data) if x[0] == "gap"]


def covered(data):
    at = 0
    for x in warc.scan(data):
        assert x[1] == at or x[1:3] == last
        at, last = x[2], x[1:3]
    assert at == len(data)


def test_clean_files():
    plain = b"".join(make(k, b"x" * k) for k in range(20))
    packed = b"".join(gzip.compress(make(k, b"y" * k)) for k in range(20))
    for data in (plain, packed, plain + packed):
        covered(data)
        assert gaps(data) == []
    assert ids(plain + packed) == [*range(20)] * 2


def test_payload_may_hold_record_marks():
    data = make(1, b"\r\n\r\nWARC/1.1\r\n" + warc.GZIP) + make(2)
    assert ids(data) == [1, 2] and gaps(data) == []


def test_every_single_byte_flip_is_survived():
    records = [make(k, b"some payload %d" % k) for k in range(4)]
    data = b"".join(records)
    start, end = len(records[0]), len(records[0]) + len(records[1])
    for at in range(start, end):
        bad = bytearray(data)
        bad[at] ^= 0x55
        covered(bytes(bad))
        assert {0, 2, 3} <= set(ids(bytes(bad))), at


def test_damage_in_members_and_truncation():
    members = [gzip.compress(make(k, bytes(range(256)) * 40)) for k in range(6)]
    bad = bytearray(b"".join(members))
    at = len(members[0]) + len(members[1]) // 2
    bad[at : at + 8] = b"\0" * 8
    assert ids(bytes(bad)) == [0, 2, 3, 4, 5]
    assert gaps(bytes(bad)) == [(len(members[0]), len(members[0]) + len(members[1]))]
    cut = b"".join(members)[:-10]
    assert ids(cut) == [0, 1, 2, 3, 4] and len(gaps(cut)) == 1
    covered(b"junk" + cut)
    assert ids(b"junk" + cut) == [0, 1, 2, 3, 4] and gaps(b"") == []
    several = gzip.compress(make(1) + make(2) + b"rubbish") + gzip.compress(make(3))
    assert ids(several) == [1, 2, 3] and len(gaps(several)) == 1


def test_round_trip(spark):
    rows = [(1, "http://a", "same", None), (9, "http://b\r\nX: y", "same", None), (4, None, None, "clash"), (5, "u", "", None), (6, "u", "ä" * 70000, None)]
    rows += [(7, "u", "WARC/1.1\r\n\r\n", None), (None, "u", "same", None), (6, "v", "other", None)]
    got = {(r.page_id, r.payload_digest): r for r in warc.round_trip(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    for page, _, html, _ in rows:
        data = (html or "").encode()
        r = got[page, base64.b32encode(hashlib.sha1(data).digest()).decode()]
        assert r.payload_bytes == len(data)
        want = {1: 9, None: 9, 4: 5}.get(page)
        assert (r.record_type, r.refers_to) == ("response" if want is None else "revisit", want)


def test_equal_rows_and_empty_table(spark):
    rows = [(1, "u", "a", None)] * 3 + [(2, "u", "a", None)] * 2
    got = sorted((r.page_id, r.record_type) for r in warc.round_trip(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, "revisit")] * 3 + [(2, "response")] * 2
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_reader_logs_gaps(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(make(1) + b"lost bytes" + make(2))
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert [r.page_id for r in got if r.gap is None] == ["1", "2"]
    assert [(r.offset, r.end_offset) for r in got if r.gap] == [(len(make(1)), len(make(1)) + 10)]
    assert [bytes(r.payload) for r in got if r.gap is None] == [b"hello"] * 2


def test_large_pages_get_files_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_LIMIT", 40_000)
    rows = [(k, f"http://x/{k}", "p" * (30_000 if k % 50 == 7 else 100) + str(k), "clash") for k in range(200)]
    pages = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    warc.write_archives(pages, str(tmp_path / "a"), archive_bytes=60_000)
    files = [p for p in (tmp_path / "a").iterdir() if p.name.startswith("part")]
    assert max(p.stat().st_size for p in files) < 60_000 + 200 * 700
    got = {int(r.page_id): r.payload_bytes for r in warc.read_archives(spark, str(tmp_path / "a")).collect()}
    assert got == {k: len(h) for k, _, h, _ in rows}


def test_damage_fails_instead_of_dropping_rows(spark, tmp_path):
    sound, hurt = make(1) + make(2), bytearray(make(1) + make(2))
    hurt[make(1).index(b"hello")] ^= 1
    (tmp_path / "sound").mkdir()
    (tmp_path / "sound" / "a.warc").write_bytes(sound)
    read = lambda name: warc.intact(warc.read_archives(spark, str(tmp_path / name), payloads=False)).select("page_id")
    assert sorted(r.page_id for r in read("sound").collect()) == ["1", "2"]
    for name, data in (("payload", bytes(hurt)), ("gap", make(1) + b"lost bytes" + make(2)), ("cut", sound[:-30])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_bytes(data)
        with pytest.raises(Exception, match="damaged archive"):
            read(name).collect()

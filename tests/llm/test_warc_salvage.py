import gzip
import random
import zlib

import pytest
from test_warc import SCHEMA, covered, gaps, ids, make

from barwright.llm import warc

RNG = random.Random(5)
RECORDS = [make(k, bytes(RNG.choices(b"abcdefghijklmnop <>/", k=4000))) for k in range(40)]


def flipped(data, at):
    return data[:at] + bytes([data[at] ^ 0x55]) + data[at + 1 :]


@pytest.mark.parametrize("bad", [0, 17, 39])
def test_one_bad_record_in_a_sound_member(bad):
    inner = [flipped(r, 500) if k == bad else r for k, r in enumerate(RECORDS)]
    data = gzip.compress(b"".join(inner)) + gzip.compress(make(99))
    assert ids(data) == [k for k in range(40) if k != bad] + [99]
    assert len(gaps(data)) == 1
    covered(data)


@pytest.mark.parametrize("level", [0, 6])
def test_truncated_member_gives_what_it_has(level):
    whole = gzip.compress(b"".join(RECORDS), level)
    for cut in (len(whole) // 3, len(whole) - 1):
        data = whole[:cut]
        inner = zlib.decompressobj(31).decompress(data)
        want = [k for k in range(40) if len(b"".join(RECORDS[: k + 1])) <= len(inner)]
        assert len(want) > 10
        for tail, more in ((b"", []), (make(98), [98]), (gzip.compress(make(99)), [99])):
            assert ids(data + tail) == want + more
            covered(data + tail)
            assert gaps(data + tail)


@pytest.mark.parametrize("level", [0, 6])
def test_broken_data(level):
    whole = gzip.compress(b"".join(RECORDS), level)
    for at in range(len(whole) // 2, len(whole) // 2 + 4000, 173):
        data = b"junk" + flipped(whole, at) + gzip.compress(make(99)) + make(98)
        got = ids(data)
        assert got[:15] == [*range(15)] and got[-2:] == [99, 98] and len(set(got)) == len(got)
        assert gaps(data)
        covered(data)


def test_undigested_records_of_broken_data_are_quarantined():
    record = b"WARC/1.1\r\nX-Page: 5\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    whole = gzip.compress(record + RECORDS[0])
    assert ids(whole) == [5, 0] and ids(whole[:-1]) == [5, 0] and ids(flipped(whole, len(whole) - 6)) == [0]


def test_long_headers(spark):
    long = "http://a/" + "x" * (3 << 20)
    got = warc.round_trip(spark.createDataFrame([(1, long, "text", None), (2, "u", "other", None)], SCHEMA)).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in got) == [(1, 4), (2, 5)]
    assert ids(make(1).replace(b"X-Page", b"X-Long: " + b"y" * (2 << 20) + b"\r\nX-Page") + make(2)) == [1, 2]

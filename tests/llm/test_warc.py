"""WARC round trips against a plain rule over the rows."""

import hashlib

from tabscope.llm.common import scratch_path
from tabscope.llm.warc import archive_round_trip, parse_records, read_records, write_archives

SCHEMA = "page_id long, url string, html string, digest string, original boolean, value string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", True, "x") for r in rows], SCHEMA)


def expected(rows):
    first, out = {}, []
    for page, url, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")):
        body = (html or "").encode()
        digest = hashlib.sha256(body).hexdigest()
        again = len(body) >= 100 and digest in first
        out.append((page, len(body), digest, "revisit" if again else "response", first[digest] if again else None))
        first.setdefault(digest, page)
    return sorted(out, key=repr)


def rows():
    long = "<p>é漢\U0001F600</p>" * 30
    tricky = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabc\r\n\r\nWARC/1.1\r\n\r\n" * 3
    out = [(9, "http://a/1", long), (4, "http://a/2", long), (12, None, long), (None, "http://n", long), (None, "http://n", "only null" * 20),
           (20, "http://b/\r\nX: y z", tricky), (21, "u", tricky + "."), (22, "u", None), (23, "u", ""), (24, "", "x" * 99), (25, "u", "x" * 99),
           (26, "u", "y" * 100), (27, "u", "y" * 100), (30, "same", "z" * 150), (30, "same", "z" * 150), (30, "same", "z" * 150),
           (31, "same", "z" * 150), (40, "u", "\n"), (41, "u", "\x00\x01" * 80), (42, "u", "w" * 300_000)]
    return out


def test_round_trip_matches_the_rule(spark):
    got = archive_round_trip(table(spark, rows())).collect()
    number = lambda s: int(s) if s else None
    assert all(r.declared == r.payload_digest for r in got)
    assert sorted(((number(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in got), key=repr) == expected(rows())


def test_targets_survive_and_payloads_are_stored_once(spark):
    path = scratch_path(spark, "warc-test")
    write_archives(table(spark, rows()), path, target_bytes=2000)
    found = read_records(spark, path).collect()
    targets = {r.target for r in found}
    assert "http://b/%0D%0AX:%20y%20z" in targets and None in targets
    stored = [r.payload_digest for r in found if r.record_type == "response" and r.payload_bytes >= 100]
    assert len(stored) == len(set(stored))


def test_shuffled_decisions_give_the_same_archive(spark, monkeypatch):
    import tabscope.llm.common as C

    monkeypatch.setattr(C, "BROADCAST_ROWS", -1)
    test_round_trip_matches_the_rule(spark)


def test_parser_reads_by_length():
    block = b"HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\n\r\n"
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)
    assert [(h["warc-type"], b) for h, b in parse_records(record * 2)] == [("response", block)] * 2


def test_empty_table(spark):
    assert archive_round_trip(table(spark, [])).collect() == []

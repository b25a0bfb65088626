import gzip
import random

from timbre.llm.warc import Gap, Record, digest, member, read_archives, record, salvage, write_and_read, write_archives
from timbre.session import scratch_path

DDL = "page_id long, url string, html string, sha1 string, payload int"
PAGES = [
    (1, "http://a/", "same", "x", 0),
    (5, "http://b/", "same", "x", 0),
    (3, None, "same", "x", 0),
    (2, "http://c/\r\nX: y", "öther WARC/1.1\r\n\r\n", "x", 0),
    (7, "u", None, "x", 0),
    (8, "u", "", "x", 0),
    (9, "u", "long " * 400_000, "x", 0),
    (None, "u", "nobody", "x", 0),
    (4, "u", "twice", "x", 0),
    (4, "u", "twice", "x", 0),
]


def test_write_and_read(spark):
    got = sorted(write_and_read(spark.createDataFrame(PAGES, DDL)).filter("not gap").collect(), key=str)
    want = []
    for page_id, _, html, *_ in PAGES:
        body = (html or "").encode()
        largest = max((p[0] for p in PAGES if (p[2] or "") == (html or "") and p[0] is not None), default=None)
        revisit = page_id != largest
        want.append((page_id, len(body), digest(body), "revisit" if revisit else "response", largest if revisit else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)


def test_small_payloads_are_never_revisits(spark):
    got = write_and_read(spark.createDataFrame(PAGES, DDL), revisit_from=5).filter("not gap").collect()
    assert {r.page_id: r.record_type for r in got if r.payload_bytes < 5}.values() and all(r.record_type == "response" for r in got if r.payload_bytes < 5)


def test_empty_table(spark):
    assert write_and_read(spark.createDataFrame([], DDL)).collect() == []


def test_payloads_and_archive_sizes(spark):
    path = scratch_path(spark, "warc-test")
    write_archives(spark.createDataFrame(PAGES, DDL), path, archive_bytes=300)
    rows = read_archives(spark, path).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in rows if r.record_type == "response"}[2] == PAGES[3][2]
    assert len({r.archive for r in rows}) > 1


def _records(n=6):
    return [record(i, f"http://x/{i}", (f"payload {i} " * 50).encode(), digest((f"payload {i} " * 50).encode()), None) for i in range(n)]


def _check(data, whole):
    """Records and gaps tile the archive; every sound record is found."""
    found = list(salvage(data))
    at = 0
    for x in found:
        assert x.position == at
        at += x.size
    assert data[at:].strip(b"\0") == b""
    assert [int(x.headers["warc-record-id"][10:-1]) for x in found if isinstance(x, Record)] == whole
    return [x for x in found if isinstance(x, Gap)]


def test_salvage_of_damaged_members():
    parts = [member(r) for r in _records()]
    data = bytearray(b"".join(parts))
    data[len(parts[0]) + len(parts[1]) // 2] ^= 0xFF  # inside the second member
    gaps = _check(bytes(data), [0, 2, 3, 4, 5])
    assert [(g.position, g.size) for g in gaps] == [(len(parts[0]), len(parts[1]))]
    assert [g.size for g in _check(b"".join([*parts[:2], b"junk\x1f\x8b\x08junk", *parts[2:], b"\0\0\0"]), list(range(6)))] == [11]
    assert len(_check(b"".join(parts)[:-7], list(range(5)))) == 1
    assert not _check(b"", []) and len(_check(b"nothing here", [])) == 1


def test_salvage_of_plain_records_and_bad_digests():
    plain = _records()
    wrong = plain[2].replace(b"payload 2 payload", b"payload 2 paYload", 1)
    short = plain[4][:-40]
    data = b"".join([plain[0], member(plain[1]), wrong, plain[3], short, plain[5]])
    gaps = _check(data, [0, 1, 3, 5])
    assert [g.size for g in gaps] == [len(wrong), len(short)]
    broken = gzip.compress(b"no record at all")
    assert [g.size for g in _check(broken + plain[0], [0])] == [len(broken)]


def test_salvage_of_random_damage():
    generator = random.Random(1)
    parts = [member(r) for r in _records(12)]
    for _ in range(40):
        hit = sorted(generator.sample(range(12), 3))
        pieces = []
        for n, p in enumerate(parts):
            if n in hit:
                k = generator.randrange(12, len(p) - 8)
                p = p[:k] + bytes([p[k] ^ generator.randrange(1, 256)]) + p[k + 1 :]
            pieces.append(p)
        _check(b"".join(pieces), [n for n in range(12) if n not in hit])

import gzip
import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scorewright.llm import warc

LONG = "p" * 1500
PAGES = [(1, "http://a/1", LONG), (2, "http://a/2", LONG), (9, "http://a/9", LONG), (3, None, None), (4, "u\r\nX: y", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "é" * 700), (8, "u", "é" * 700), (8, "u", "é" * 700), (None, "u", LONG), (10, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 90), (11, "u", "z" * 3_000_000)]


def brute(pages):
    top = {}
    for p, _, h in pages:
        if p is not None:
            top[h or ""] = max(top.get(h or "", p), p)
    out, seen = [], set()
    for p, _, h in pages:
        raw = (h or "").encode()
        revisit = len(raw) >= 1000 and (p != top[h or ""] or (p, h) in seen)
        seen.add((p, h))
        out.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top[h or ""] if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("split", [64, 1000, 8 << 20])
def test_round_trip(spark, split):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("again", F.lit(7))
    archives = warc.write_warc(df, file_bytes=2000)
    rows = warc.read_warc(archives, split_bytes=split).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=repr) == brute(PAGES)
    assert all(hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in rows if r.record_type == "response")
    for a in archives.collect():
        with warc.files.open_in(a.file) as f:
            raw = f.read()
        assert len(raw) == a.bytes and gzip.decompress(raw).count(b"WARC-Type: ") == a.records


def test_many_copies_without_id_and_lost_records(spark):
    pages = [(None, "u", LONG)] * 40 + [(7, "u", LONG)] + [(None, f"v{i}", "q" * 1200) for i in range(5)] + [(3, "w", "r" * 2000)] * 6 + [(4, "w", "short")] * 3
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    archives = warc.write_warc(df)
    found = warc.read_warc(archives).cache()
    rows = found.collect()
    assert Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in rows) == Counter({(None, 1500, "revisit", 7): 40, (7, 1500, "response", None): 1, (None, 1200, "response", None): 5, (3, 2000, "response", None): 1, (3, 2000, "revisit", 3): 5, (4, 5, "response", None): 3})
    warc.check_read(archives, found)
    with pytest.raises(RuntimeError):
        warc.check_read(archives, found.where("record_type = 'response'"))
    with pytest.raises(ValueError):
        warc.files.open_in("/no/scheme")


def test_nothing(spark):
    assert warc.read_warc(warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_ranges_own_each_record_once(tmp_path):
    r = random.Random(3)
    payloads = [bytes(r.randrange(256) for _ in range(r.randrange(400))) for _ in range(60)]
    junk = [b"", b"\x1f\x8b\x08", b"\x1f\x8b\x08\x00junk", gzip.compress(b"no record"), gzip.compress(b"WARC/1.1\r\nno end")[:-9]]
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"".join(warc.record(i, f"http://x/{i}", p) + r.choice(junk) for i, p in enumerate(payloads)))
    n = path.stat().st_size
    for step in (7, 100, 999, n):
        got = [warc.parse(raw) for a in range(0, n, step) for raw in warc.records(f"file://{path}", a, min(n, a + step))]
        assert [(g["page_id"], g["payload"]) for g in got] == list(enumerate(payloads))


@pytest.mark.parametrize("split", [5000, 8 << 20])
def test_long_urls(spark, split):
    r = random.Random(5)
    urls = ["u" * 100_000, "http://x/" + "".join(r.choice("abcdefghijklmnop0123456789") for _ in range(100_000)), "a b" * 40_000, "http://short", "v" * 3_000_000]
    df = spark.createDataFrame([(i, u, f"page {i}") for i, u in enumerate(urls)], "page_id long, url string, html string")
    archives = warc.write_warc(df)
    rows = warc.read_warc(archives, split_bytes=split).collect()
    assert sorted((x.page_id, x.url, x.payload.decode()) for x in rows) == [(i, u.replace(" ", "%20"), f"page {i}") for i, u in enumerate(urls)]
    assert len(rows) == sum(a.records for a in archives.collect())

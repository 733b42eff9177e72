"""WARC archives: round trips, predicates, and archives of other writers."""

import gzip
import hashlib
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lattica.llm import warc

SCHEMA = "page_id long, url string, html string, sha1 string, payload string, record_type string"
PAGES = [(3, "http://a/x?q=%0D%250", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "http://b\r\nX-Evil: 1", ""), (4, "u", None), (None, "n", "<p>é</p>"), (5, "v", "WARC/1.1\r\n\r\nWARC-Type: metadata\r\n\r\n" * 50), (6, "w", "long " * 300_000), (1, None, "<p>é</p>")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", "c", "c") for r in rows], SCHEMA)


def expected(rows):
    out = Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        ids = [j for j, _, h in rows if (h or "").encode() == data and j is not None]
        least = min(ids, default=None)
        revisit = least is not None and i != least
        out[(i, len(data), warc.base32_sha1(data), "revisit" if revisit else "response", least if revisit else None)] += 1
    return out


def test_round_trip_by_hand(spark):
    got = warc.round_trip(frame(spark, PAGES)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert Counter(map(tuple, got.collect())) == expected(PAGES)
    assert warc.round_trip(frame(spark, [])).count() == 0


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_payloads_and_predicates(spark, compression):
    path = "file://" + tempfile.mkdtemp()
    warc.write_warc(frame(spark, PAGES).drop("sha1"), path, compression=compression, file_bytes="5000")
    all_of = warc.read_warc(spark, path, split_bytes="4000")
    assert all_of.count() == len(PAGES)
    responses = all_of.filter(F.col("record_type") == "response")
    assert Counter(bytes(r.payload) for r in responses.collect()) == Counter({(h or "").encode(): n for h, n in {"<p>é</p>": 2, PAGES[5][2]: 1, PAGES[6][2]: 1, "": 1}.items()})
    assert all(warc.base32_sha1(bytes(r.payload)) == r.payload_digest[5:] for r in responses.collect())
    assert {r.payload for r in all_of.filter("record_type = 'revisit'").collect()} == {None}
    one = all_of.filter((F.col("target_uri") == "w") & F.col("record_type").isin("response", "metadata"))
    assert "Filter (" not in one._jdf.queryExecution().executedPlan().toString()  # both predicates are the reader's
    assert [r.payload_bytes for r in one.collect()] == [len(PAGES[6][2])]
    assert all_of.filter("target_uri is null").count() == 2 and all_of.count() == len(PAGES)
    assert all_of.filter("payload_bytes > 1000 and record_type is not null").count() == 2


def test_archives_of_other_writers(spark):
    folder = tempfile.mkdtemp()
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\nbody"
    records = [warc.record("warcinfo", [("Content-Type", "application/warc-fields")], b"software: x\r\n"), warc.record("response", [("WARC-Target-URI", "http://x/"), ("Content-Type", "application/http; msgtype=response")], http)]
    with open(f"{folder}/a.warc.gz", "wb") as f:
        f.write(b"".join(gzip.compress(r) for r in records * 30))
    with open(f"{folder}/b.warc", "wb") as f:
        f.write(b"".join(records))
    for payload in ("true", "false"):
        rows = warc.read_warc(spark, folder, payload=payload).collect()
        assert Counter(r.record_type for r in rows) == {"warcinfo": 31, "response": 31}
        found = [r for r in rows if r.record_type == "response"]
        assert {(r.payload_bytes, r.payload and bytes(r.payload)) for r in found} == {(4, b"body" if payload == "true" else None)}


def test_digest_on_the_jvm(spark):
    texts = ["", "a", "é" * 50, "x" * 999]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(warc._base32(F.sha1("t")).alias("d"))
    assert [r.d for r in df.collect()] == [warc.base32_sha1(t.encode()) for t in texts]
    assert hashlib.sha1(b"").hexdigest()[:4] == "da39"


def test_a_failed_write_leaves_nothing_to_read(spark):
    path = tempfile.mkdtemp()
    with open(f"{path}/part-left.warc.gz", "wb") as f:
        f.write(b"\x1f\x8b broken")
    warc.write_warc(frame(spark, PAGES), "file://" + path)
    assert warc.read_warc(spark, path, payload="false").count() == len(PAGES)


def _records(n=5):
    return [warc.record("response", [("WARC-Target-URI", f"http://x/{i}"), ("Content-Type", "application/http; msgtype=response")], b"HTTP/1.1 200 OK\r\n\r\n" + b"body%d" % i * (1 + 4000 * i)) for i in range(n)]


@pytest.mark.parametrize("payload", ["true", "false"])
def test_members_of_several_records_and_records_over_members(spark, payload):
    folder, data = tempfile.mkdtemp(), b"".join(_records())
    with open(f"{folder}/a.warc.gz", "wb") as f:
        f.write(gzip.compress(data))
    with open(f"{folder}/b.warc.gz", "wb") as f:
        f.write(gzip.compress(data[:30_000]) + gzip.compress(data[30_000:]))
    with open(f"{folder}/c.warc.gz", "wb") as f:
        f.write(warc.member(data, 1) + warc.member(_records(1)[0], 6))
    rows = warc.read_warc(spark, folder, payload=payload).collect()
    assert Counter(r.payload_bytes for r in rows) == Counter([5 * (1 + 4000 * i) for i in range(5)] * 3 + [5])
    if payload == "true":
        assert all(bytes(r.payload) == b"body" + r.target_uri[-1].encode() + b"body%s" % r.target_uri[-1].encode() * (len(r.payload) // 5 - 1) for r in rows)
    assert warc.read_warc(spark, folder, payload=payload).filter(F.col("target_uri") == "http://x/4").count() == 3


@pytest.mark.parametrize("name, data", [
    ("a.warc", _records()[2][:-20]), ("b.warc.gz", gzip.compress(b"".join(_records()))[:-30]), ("c.warc.gz", gzip.compress(_records()[2][:-50])),
    ("d.warc.gz", gzip.compress(_records()[2])[:-8] + b"\0" * 8), ("e.warc.gz", warc.member(_records()[2], 1)[:-9]), ("f.warc.gz", warc.member(_records()[2], 1)[:-8] + b"\1" * 8),
])
def test_cut_and_damaged_archives_are_errors(spark, name, data):
    folder = tempfile.mkdtemp()
    with open(f"{folder}/{name}", "wb") as f:
        f.write(data)
    with pytest.raises(Exception, match="ends inside|no end|checksum|Error -"):
        warc.read_warc(spark, folder).collect()


def test_text_ids_come_back(spark):
    rows = [("", "u", "p"), (None, "u", "p"), ("a b/%\r\n>é", "u", "q"), ("z+", "u", "q")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in got) == Counter([("", "response", None), (None, "revisit", ""), (rows[2][0], "response", None), ("z+", "revisit", rows[2][0])])

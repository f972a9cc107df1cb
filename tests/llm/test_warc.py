import base64
import datetime
import hashlib
import random

import pytest

from dissensus.llm import warc


def test_loser_tree():
    rng = random.Random(1)
    for k in range(30):
        runs = [sorted(rng.randint(0, 9) for _ in range(rng.randint(0, 6))) for _ in range(k)]
        keys = [(x,) for r in runs for x in r]
        edges = [0]
        for r in runs:
            edges.append(edges[-1] + len(r))
        got = list(warc.merged(keys, list(zip(edges, edges[1:]))))
        assert sorted(got) == list(range(len(keys)))
        # Equal keys come in the order of their runs.
        assert got == sorted(range(len(keys)), key=lambda i: (keys[i], i))


def test_url_key():
    assert warc.url_key("HTTP://www.B.Example.org/p?q=1#f") == "org,example,b)/p?q=1"
    assert warc.url_key(None) == "" and warc.url_key("http://a.b") == "b,a)"


def test_damage_is_seen():
    import gzip

    row = {"page_id": 1, "url": "http://a/", "captured": datetime.datetime(2024, 1, 1), "payload": b"abc", "payload_bytes": 3, "payload_digest": warc.digest_of(b"abd"), "refers_to": None}
    with pytest.raises(ValueError):
        list(warc.records(gzip.compress(warc.record(row))))
    row["payload_digest"] = warc.digest_of(b"abc")
    packed = gzip.compress(warc.record(row)) * 2
    assert [r["at"] for r in warc.records(packed)] == [0, len(packed) // 2]
    with pytest.raises(ValueError):
        list(warc.records(packed[:-3]))


def test_archive(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, f"http://{rng.choice('abc')}.example.org/{rng.randint(0, 5)}", rng.choice(["x", "y\r\n\r\n", f"<p>{i}é</p>"])) for i in range(200)]
    rows += [(300, None, None), (301, "", ""), (302, "http://é/%0A\n%", "z" * 300_000), (None, "http://n/", "only"), (None, "http://n/", "x"), (5, rows[5][1], rows[5][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    named = pages.selectExpr("*", "'d' AS digest", "1 AS first", "2 AS part").repartition(5)
    found = warc.archive(named).collect()
    first = {}
    for key, _, html in rows:
        if key is not None:
            first[html or ""] = min(key, first.get(html or "", key))
    want = []
    for key, url, html in rows:
        data, least = (html or "").encode(), first.get(html or "")
        again = least is not None and key != least
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append(repr((key, url, len(data), digest, "revisit" if again else "response", least if again else None)))
    got = [repr((r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in found]
    assert sorted(got) == sorted(want)
    found.sort(key=lambda r: (r["part"], r["place"]))
    keys = [(r["url_key"], r["captured"], r["page_id"] is not None, r["page_id"] or 0) for r in found]
    assert keys == sorted(keys)
    assert warc.archive(named.limit(0)).count() == 0

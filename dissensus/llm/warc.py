"""WARC archives of pages, and one ordered index over all of them.

Each archive file gives a run of index entries sorted by URL key and time. The runs are
cut at sampled splitters, and each range of keys merges its pieces of all runs with a
loser tree, which yields the captures of every URL in order.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dissensus.llm import files
from dissensus.session import configure, scratch_folder, written

# Bytes of payload after which an archive is closed; bounds a task's memory.
ARCHIVE_BYTES = 8 << 20
# Without times, a page is captured as many seconds after this one as its key says,
# within a hundred years.
EPOCH = 1704067200
CENTURY = 3155760000
ENTRY = (
    "url_key string, captured timestamp, page_id long, url string, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string, archive string, at long, size long"
)


def record(row: dict) -> bytes:
    """One record. A revisit leaves the payload out and says its size and digest."""
    whole = row["refers_to"] is None
    payload = row["payload"] or b""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"]
    body += payload if whole else b""
    head = [
        ("WARC-Type", "response" if whole else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if row['page_id'] is None else row['page_id']}>"),
        ("WARC-Date", row["captured"].strftime("%Y-%m-%dT%H:%M:%SZ")),
        ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(body))),
    ]
    if row["url"] is not None:
        # A line break in an address would end the header.
        head.append(("WARC-Target-URI", re.sub(r"[\r\n%]", lambda m: f"%{ord(m[0]):02X}", row["url"])))
    if not whole:
        head.append(("WARC-Refers-To", f"<urn:page:{row['refers_to']}>"))
        head.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return text.encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def records(data: bytes) -> Iterator[dict]:
    """The records of an archive of one gzip member per record. The digest of a payload
    that is there is worked out again; another one is an error."""
    at = 0
    while at < len(data):
        member, size = _member(data, at)
        head, _, rest = member.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        body = rest[: int(fields["Content-Length"])]
        http, _, payload = body.partition(b"\r\n\r\n")
        digest = fields["WARC-Payload-Digest"].partition(":")[2]
        length = int(re.search(rb"Content-Length: (\d+)", http)[1])
        if fields["WARC-Type"] == "response" and (len(payload) != length or digest_of(payload) != digest):
            raise ValueError(f"damaged record at {at}")
        page = lambda name: int(fields[name][10:-1]) if fields.get(name, "")[10:-1] else None
        url = fields.get("WARC-Target-URI")
        yield {
            "captured": datetime.datetime.strptime(fields["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ"),
            "page_id": page("WARC-Record-ID"),
            "url": None if url is None else re.sub(r"%(0D|0A|25)", lambda m: chr(int(m[1], 16)), url),
            "record_type": fields["WARC-Type"],
            "refers_to": page("WARC-Refers-To"),
            "payload_bytes": length,
            "payload_digest": digest,
            "at": at,
            "size": size,
        }
        at += size


def _member(data: bytes, at: int) -> tuple[bytes, int]:
    """The gzip member that begins at a place, unpacked, and its packed size."""
    unpack, out, fed = zlib.decompressobj(31), [], at
    while not unpack.eof:
        part = data[fed : fed + 65536]
        if not part:
            raise ValueError(f"record at {at} is cut off")
        out.append(unpack.decompress(part))
        fed += len(part)
    return b"".join(out), fed - len(unpack.unused_data) - at


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Sorts pages of a domain together: the host's names from the last to the first,
    then the rest without scheme and fragment."""
    if url is None:
        return ""
    _, _, rest = url.rpartition("://") if "://" not in url else url.partition("://")
    host, slash, path = re.match(r"([^/?#]*)(/?)([^#]*)", rest, re.S).groups()
    names = host.lower().removeprefix("www.").split(".")
    return ",".join(reversed(names)) + ")" + slash + path


def merged(keys: list, runs: list[tuple[int, int]]) -> Iterator[int]:
    """Positions of all keys in sorted order; each run (from, to) is sorted already.

    A loser tree: a node holds the loser of its two sides, so that after the winner a
    single path to the root is played again, against one loser a level.
    """
    k = len(runs)
    place = [lo for lo, _ in runs]
    # (True, ..) sorts after all keys; the run's number settles ties.
    head = [(False, keys[lo], r) if lo < hi else (True, None, r) for r, (lo, hi) in enumerate(runs)]
    beats = lambda a, b: (head[a][0], head[a][2]) < (head[b][0], head[b][2]) if head[a][0] or head[b][0] else head[a][1:] < head[b][1:]
    losers = [-1] * max(1, k)
    winner = -1
    for r in range(k):
        now, node = r, (r + k) // 2
        while node and now >= 0:
            if losers[node] < 0:
                losers[node], now = now, -1
            elif beats(losers[node], now):
                losers[node], now = now, losers[node]
            node //= 2
        if now >= 0:
            winner = now
    while winner >= 0 and not head[winner][0]:
        yield place[winner]
        place[winner] += 1
        lo, hi = place[winner], runs[winner][1]
        head[winner] = (False, keys[lo], winner) if lo < hi else (True, None, winner)
        now, node = winner, (winner + k) // 2
        while node:
            if beats(losers[node], now):
                losers[node], now = now, losers[node]
            node //= 2
        winner = now


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", captured: Column | None = None) -> DataFrame:
    """Write a record per page to archives in ``folder``; ``archive, n_records`` of each.

    Of pages with equal payloads the one with the smallest key is a response with its
    payload, the others are revisits of it (rows that repeat the smallest key are all
    responses, as are payloads of which no page has a key; other null keys revisit). The
    payload is the html in UTF-8, null is empty.
    """
    configure(pages.sparkSession)
    at = captured if captured is not None else F.timestamp_seconds(
        F.pmod(F.coalesce(F.col(key).cast("long"), F.lit(0)), F.lit(CENTURY)) + F.lit(EPOCH)
    )
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), at.alias("captured"),
        F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    # Only payloads that repeat are joined, with the rows they repeat in.
    firsts = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = firsts.filter("n > 1 AND first IS NOT NULL").select("digest", "first")
    other = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    marked = rows.join(firsts, "digest", "left").select(
        "page_id", "url", "captured", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.unhex("digest").alias("digest"), F.when(other, F.col("first")).alias("refers_to"),
        F.when(~other, F.col("payload")).alias("payload"),
    )

    def run(batches):
        part, place = TaskContext.get().partitionId(), 0
        kept: list[bytes] = []
        size = 0

        def close():
            name = f"pages-{part:07d}-{place:05d}.warc.gz"
            files.put(folder, name, b"".join(kept))
            return pa.RecordBatch.from_pydict({"archive": [name], "n_records": [len(kept)]})

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                row["payload_digest"] = base64.b32encode(row["digest"]).decode()
                packed = gzip.compress(record(row), 1, mtime=0)
                kept.append(packed)
                size += len(packed)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    place, kept, size = place + 1, [], 0
        if kept:
            yield close()

    return written(marked.mapInArrow(run, "archive string, n_records long"), "archives")


def runs(spark, folder: str) -> DataFrame:
    """Index entries of all archives, for each archive in the order of ``run_place``."""
    stored = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "content")
    schema = ENTRY + ", run_place long"

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column("path")[i].as_py().rpartition("/")[2]
                found = [r | {"url_key": url_key(r["url"]), "archive": name} for r in records(batch.column("content")[i].as_py())]
                found.sort(key=order)
                for place, r in enumerate(found):
                    r["run_place"] = place
                for lo in range(0, len(found), 4096):
                    yield pa.RecordBatch.from_pylist(found[lo : lo + 4096], schema=_arrow(schema))

    return stored.mapInArrow(run, schema)


def order(entry: dict) -> tuple:
    return entry["url_key"], entry["captured"], entry["page_id"] is not None, entry["page_id"] or 0


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "timestamp": pa.timestamp("us", "UTC")}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in schema.split(", "))])


def index(entries: DataFrame) -> DataFrame:
    """All entries in one order: by URL key, time and page, ascending in (part, place).

    ``capture`` numbers the captures of a URL within its part. A URL with very many
    captures spans several parts.
    """
    ranged = entries.repartitionByRange("url_key", "captured", "page_id").sortWithinPartitions("archive", "run_place")
    schema = ENTRY + ", part long, place long, capture long"

    def run(batches):
        held = pa.Table.from_batches(list(batches))
        if not held.num_rows:
            return
        part = TaskContext.get().partitionId()
        columns = [held.column(c).to_pylist() for c in ("url_key", "captured", "page_id", "archive")]
        keys = [(u, c, p is not None, p or 0) for u, c, p, _ in zip(*columns)]
        archives = columns[3]
        edges = [0, *[i for i in range(1, len(archives)) if archives[i] != archives[i - 1]], len(archives)]
        at = np.fromiter(merged(keys, list(zip(edges, edges[1:]))), dtype=np.int64, count=len(keys))
        urls = [columns[0][i] for i in at.tolist()]
        capture, now = [], 0
        for i, u in enumerate(urls):
            now = now + 1 if i and u == urls[i - 1] else 0
            capture.append(now)
        out = held.drop_columns(["run_place"]).take(pa.array(at))
        out = out.append_column("part", pa.array(np.full(len(at), part))).append_column("place", pa.array(np.arange(len(at))))
        yield from out.append_column("capture", pa.array(capture, pa.int64())).to_batches(max_chunksize=8192)

    return ranged.mapInArrow(run, schema)


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write pages to archives in the shared folder, read those back, and return the
    merged index. An empty table has no archives and an empty index."""
    spark = pages.sparkSession
    folder = scratch_folder(spark, "warc")
    made = write(pages, folder, key, url, html)
    if made.isEmpty():
        return spark.createDataFrame([], ENTRY + ", part long, place long, capture long")
    return index(runs(spark, folder))

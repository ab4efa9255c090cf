"""Operator 9: WARC archives with a globally ordered capture index.

Every page becomes a record, a gzip member of an archive file. Of equal payloads of at least REVISIT bytes
the one with the smallest id is a response, the others are revisits that carry its digest. Each task sorts
its captures by URL key, time and id (a run) and writes the run. Keys sampled from the runs, at most SAMPLED for
each range, part the order into ranges that hold a URL's captures apart if they are many. A run is cut into its
segments, one for each range, which travel packed in blocks of BLOCK captures and keep their order; within a
range a loser tree merges the segments and unpacks one block of each at a time. Partition k holds range k, so
that the index as a whole is in capture order. Records are read back by the index's offsets.

Null html is an empty payload, a null url an empty key; an empty table gives an empty index. Repeated rows give
repeated records; equal rows with the smallest id are all responses. A page without id comes first among those of
its key and time and is never referred to. Only named columns are read, so other names can't clash.
"""

from __future__ import annotations

import datetime
import hashlib
import uuid
import zlib
from bisect import bisect_left
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common, storage

REVISIT = 100
ARCHIVE_BYTES = 256 << 20
RUN_RECORDS = 50_000
BLOCK, SAMPLED = 256, 40
#: Stands for a null id in the order of captures.
NO_ID = -(1 << 63)
EPOCH = datetime.datetime(2024, 1, 1)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "url_key string, captured string, page_id long, run string, archive string, offset long, length long"


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query: captures of a site stand together."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip().lower())
        host = ",".join(reversed((u.hostname or "").split(".")))
    except ValueError:
        return url.strip().lower()
    return f"{host}){u.path or '/'}" + (f"?{u.query}" if u.query else "")


def captured(page_id: int | None) -> str:
    """The pages have no time of capture; it follows from the id, a second each."""
    return (EPOCH + datetime.timedelta(seconds=int(page_id or 0) % 3_000_000_000)).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id: int | None, url: str, at: str, body: bytes, digest: str, refers_to: int | None) -> bytes:
    payload = b"" if refers_to is not None else body
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {at}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(http) + len(payload)}")
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n") + pack.flush()


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of one record."""
    data = zlib.decompress(member, 31)
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), body


def loser_tree(runs: list):
    """Merge sorted runs, any iterables. Each inner node holds the run that lost there; the winner moves up."""
    done = object()
    runs = [iter(r) for r in runs]
    k = len(runs)
    head = [next(r, done) for r in runs]
    before = lambda a, b: head[b] is done or (head[a] is not done and head[a] <= head[b])
    tree, winners = [0] * max(k, 1), [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], tree[node] = (a, b) if before(a, b) else (b, a)
    win = winners[1] if k > 1 else 0
    while k and head[win] is not done:
        yield head[win]
        head[win] = next(runs[win], done)
        node = (win + k) // 2
        while node:
            if not before(win, tree[node]):
                tree[node], win = win, tree[node]
            node //= 2


def packed(rows: list[tuple]) -> bytes:
    """A sorted segment as blocks, each compressed by itself; a row's first three values are its key."""
    out = []
    for a in range(0, len(rows), BLOCK):
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[a : a + BLOCK], strict=True)], names=[str(i) for i in range(len(rows[0]))])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(batch)
        data = sink.getvalue().to_pybytes()
        out += [len(data).to_bytes(4, "little"), data]
    return b"".join(out)


def unpacked(segment: bytes):
    """The rows of a segment, a block at a time."""
    at = 0
    while at < len(segment):
        size = int.from_bytes(segment[at : at + 4], "little")
        with pa.ipc.open_stream(pa.py_buffer(segment[at + 4 : at + 4 + size])) as r:
            for batch in r:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)
        at += 4 + size


def segments(frames, cuts: list[tuple]):
    """Cut the runs of a task at the ranges' bounds: frames (part, segment)."""

    def emit(rows):
        bounds = [0, *(bisect_left(rows, c, key=lambda r: r[:3]) for c in cuts), len(rows)]
        got = [(i, packed(rows[a:b])) for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if a < b]
        return pd.DataFrame(got, columns=["part", "segment"]).astype({"part": "int32"})

    rows: list[tuple] = []
    for f in frames:
        page = f["page_id"].astype("Int64").fillna(NO_ID).astype("int64")
        for row in zip(f["url_key"], f["captured"], page, f["run"], f["archive"], f["offset"], f["length"], strict=True):
            if rows and (rows[-1][3] != row[3] or len(rows) == RUN_RECORDS):
                yield emit(rows)
                rows = []
            rows.append(row)
    if rows:
        yield emit(rows)


def merge_range(frames):
    """Merge the segments of each range of a partition; the ranges come in order."""

    def merged(parts):
        out: list[tuple] = []
        for row in loser_tree([unpacked(p) for p in parts]):
            out.append((*row[:2], None if row[2] == NO_ID else row[2], *row[3:]))
            if len(out) == 10_000:
                yield out
                out = []
        yield out

    now, parts = None, []

    def flush():
        for out in merged(parts):
            yield pd.DataFrame(out, columns=["url_key", "captured", "page_id", "run", "archive", "offset", "length"]).astype({"page_id": "Int64"})

    for f in frames:
        for part, segment in zip(f["part"], f["segment"], strict=True):
            if part != now and parts:
                yield from flush()
                parts = []
            now = part
            parts.append(bytes(segment))
    if parts:
        yield from flush()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the archives; returns the index of their captures as local runs (columns INDEX)."""
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    base = base.withColumn("digest", F.sha2("html", 256))
    small = base.where(F.octet_length("html") >= REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    owners = common.written(small, "warc-owners")
    found = common.written(base.select("page_id", "digest").join(owners, "digest").where("NOT page_id <=> first").distinct(), "warc-revisits")
    rows = base.alias("b").join(found.alias("f"), F.expr("b.page_id <=> f.page_id AND b.digest = f.digest"), "left").select("b.*", "f.first")

    def run(frames):
        out, captures = None, []

        def flush():
            name = uuid.uuid4().hex
            captures.sort(key=lambda c: (c[0], c[1], NO_ID if c[2] is None else c[2]))
            return pd.DataFrame([(*c[:3], name, *c[3:]) for c in captures], columns=["url_key", "captured", "page_id", "run", "archive", "offset", "length"]).astype({"page_id": "Int64"})

        for f in frames:
            for page, url, html, digest, first in zip(f["page_id"], f["url"], f["html"], f["digest"], f["first"], strict=True):
                page, first, url = None if pd.isna(page) else int(page), None if pd.isna(first) else int(first), url if isinstance(url, str) else ""
                if out is None:
                    out = storage.Writer(folder, f"captures-{uuid.uuid4().hex}.warc.gz")
                member = record(page, " ".join(url.split()), captured(page), html.encode(), digest, first)
                captures.append((url_key(url), captured(page), page, out.uri, out.write(member), len(member)))
                if out.at >= ARCHIVE_BYTES:
                    out.close()
                    out = None
            if len(captures) >= RUN_RECORDS:
                yield flush()
                captures = []
        if out is not None:
            out.close()
        if captures:
            yield flush()

    return common.written(rows.mapInPandas(run, INDEX), "warc-runs")


def merged_index(runs: DataFrame) -> DataFrame:
    """All captures in order of URL key, time and id: ranges, each merged from the runs' segments by a loser tree."""
    n, total = common.parts(runs.sparkSession), runs.count()
    key = F.struct("url_key", "captured", F.coalesce("page_id", F.lit(NO_ID)).alias("page"))
    share = min(1.0, SAMPLED * n / max(total, 1))
    some = sorted(tuple(r[0]) for r in runs.sample(share, 1).select(key).limit(2 * SAMPLED * n).collect())  # bounded by the number of ranges
    cuts = sorted({some[i * len(some) // n] for i in range(1, n)}) if some else []
    parts = runs.mapInPandas(lambda frames: segments(frames, cuts), "part int, segment binary")
    return parts.repartitionById(n, "part").sortWithinPartitions("part").mapInPandas(merge_range, INDEX)


def read_back(index: DataFrame) -> DataFrame:
    """Read every record of the index: (page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, captured)."""

    def run(frames):
        reader = storage.Reader()
        for f in frames:
            rows = []
            for key, at, page, _, archive, offset, length in f.itertuples(index=False):
                fields, http, body = parse(reader.read(archive, offset, length))
                digest, kind, refers = fields["WARC-Payload-Digest"].split(":")[1], fields["WARC-Type"], fields.get("WARC-Refers-To")
                size = int(http["Content-Length"])
                if kind == "response" and (len(body) != size or hashlib.sha256(body).hexdigest() != digest):
                    raise ValueError(f"record of page {page} is damaged")
                rows.append((page, size, digest, kind, int(refers[10:-1]) if refers else None, key, at))
            out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured"])
            yield out.astype({"page_id": "Int64", "refers_to": "Int64"})
        reader.close()

    return index.mapInPandas(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, captured string")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = write_archives(common.table(spark, sf_dir, "pages"), common.fresh(spark, "warc"))
    return read_back(merged_index(runs)).drop("url_key", "captured")


ORACLE_OP9 = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, octet_length(encode(html)) AS n, sha256(html) AS h FROM p),
o AS (SELECT h, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY h)
SELECT d.page_id, d.n AS payload_bytes, d.h AS payload_digest,
  CASE WHEN o.first IS NOT NULL AND o.first <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN o.first IS NOT NULL AND o.first <> d.page_id THEN o.first END AS refers_to
FROM d LEFT JOIN o ON o.h = d.h
"""

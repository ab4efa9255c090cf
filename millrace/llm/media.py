"""Operator 5: media columns over content-addressed payloads in tar shards.

A text's UTF-8 bytes, padded with bytes 255 to a positive multiple of BLOCK, are stored as the samples of an
8-bit greyscale PNG of width BLOCK (lossless). The member's name is the SHA-256 of the PNG. A shard holds a
member once, and of equal members in several tasks' shards one is elected: a digest has one address, to which
all rows with that content refer. Rows carry digest, shard, offset and length. Metadata columns come from a range
read of the 33 bytes that hold a PNG's header; features come from the samples, read back and unpacked.

Null and empty texts give one block of 255. Equal texts give equal values. Repeated rows give repeated rows.
A task that is run again writes shards under other names, so what a lost attempt left is never referred to.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common, kernels, storage

BLOCK = 576
SHARD_BYTES = 64 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER = 33


def payload(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % BLOCK if text else BLOCK)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(data: bytes) -> bytes:
    rows = np.frombuffer(data, dtype=np.uint8).reshape(-1, BLOCK)
    lines = np.zeros((len(rows), BLOCK + 1), dtype=np.uint8)  # each line begins with filter 0
    lines[:, 1:] = rows
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", BLOCK, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and colour type from a file's first 33 bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIBB", head[16:26])


def from_png(data: bytes) -> bytes:
    width, height, _, _ = png_header(data[:HEADER])
    at, packed = 8, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            packed.append(data[at + 8 : at + 8 + size])
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("a filter that this reader does not know")
    return lines[:, 1:].tobytes()


def feature(samples: bytes, shape: tuple[int, int, int, int]) -> str:
    a = np.frombuffer(samples, dtype=np.uint8)
    n = np.bincount(a, minlength=256)
    return f"{shape[0]}x{shape[1]}x{shape[2]};mean={int(a.sum(dtype=np.int64)) * 1000 // len(a)};min={int(a.min())};max={int(a.max())};kinds={int((n > 0).sum())};mode={int(n.argmax())};steps={int((a[1:] != a[:-1]).sum())}"


class _Tar:
    def __init__(self, folder: str):
        self.folder, self.out, self.names = folder, None, {}

    def put(self, data: bytes) -> tuple[str, str, int]:
        """Digest, shard and offset of a member; one that the shard has is not written again."""
        digest = hashlib.sha256(data).hexdigest()
        if self.out and self.out.at >= SHARD_BYTES:
            self.close()
        if not self.out:
            self.out, self.names = storage.Writer(self.folder, f"shard-{uuid.uuid4().hex}.tar"), {}
        if digest not in self.names:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(data)
            self.out.write(info.tobuf(tarfile.USTAR_FORMAT))
            self.names[digest] = self.out.write(data)
            self.out.write(b"\0" * (-len(data) % 512))
        return digest, self.out.uri, self.names[digest]

    def close(self) -> None:
        if self.out:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.out = None


def store(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards; rows (k, n_bytes, digest, shard, offset, length), k the id as text: the index, itself written once."""

    def run(frames):
        tar = _Tar(folder)
        for f in frames:
            rows = []
            for k, text in zip(f["k"], kernels.utf8(f["t"]), strict=True):
                png = to_png(payload(text))
                digest, shard, at = tar.put(png)
                rows.append((k, len(text), digest, shard, at, len(png)))
            yield pd.DataFrame(rows, columns=["k", "n_bytes", "digest", "shard", "offset", "length"])
        tar.close()

    rows = docs.select(F.col(id_col).cast("string").alias("k"), F.col(text_col).alias("t"))
    wrote = common.written(rows.mapInPandas(run, "k string, n_bytes long, digest string, shard string, offset long, length long"), "media-written")
    one = common.written(wrote.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")), "media-places")  # so that the join of a digest with many rows can be split
    return common.written(wrote.select("k", "n_bytes", "digest").join(one, "digest").select("k", "n_bytes", "digest", "at.*"), "media-index")


def metadata(index: DataFrame) -> DataFrame:
    """The index with width, height, depth and colour, from header-only range reads.

    Its rows are dealt by ranges of place, so that tasks are as many as the payloads need and each reads forward.
    """
    index = index.repartitionByRange(common.parts(index.sparkSession), "shard", "offset", "k")

    def run(frames):
        reader = storage.Reader()
        for f in frames:
            head = [png_header(reader.read(s, o, HEADER)) for s, o in zip(f["shard"], f["offset"], strict=True)]
            for i, name in enumerate(("width", "height", "depth", "colour")):
                f[name] = np.array([h[i] for h in head], dtype=np.int32)
            yield f
        reader.close()

    schema = ", ".join(f"{c} {t}" for c, t in index.dtypes)
    return index.mapInPandas(run, schema + ", width int, height int, depth int, colour int")


def read_back(index: DataFrame) -> DataFrame:
    """Digests and features of the stored bytes, read back by range."""

    def run(frames):
        reader = storage.Reader()
        for f in frames:
            rows, last = [], {}
            for k, n, digest, shard, at, size, *shape in f[["k", "n_bytes", "digest", "shard", "offset", "length", "width", "height", "depth", "colour"]].itertuples(index=False):
                if last.get("digest") != digest:
                    png = reader.read(shard, at, size)
                    data = from_png(png)
                    last = {"digest": digest, "row": (len(data), hashlib.sha256(data).hexdigest(), kernels.crc(data[-32:]), len(png), hashlib.sha256(png).hexdigest(), feature(data, tuple(shape)))}
                rows.append((k, n, *last["row"]))
            yield pd.DataFrame(rows, columns=["k", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
        reader.close()

    return index.mapInPandas(run, "k string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = store(common.table(spark, sf_dir, "documents"), common.fresh(spark, "media"))
    return read_back(metadata(index)).select(F.col("k").cast("long").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")

"""What the operators share: reading tables, tables in the shared folder, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import kernels

#: Vocabulary files of public tokenizers; every operator that needs one takes the file's path as a parameter.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")


def tokenizer_path(name: str) -> str:
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join(TOKENIZERS, name)


#: Texts reach Python in Arrow batches of at most so many rows and bytes: it bounds a worker's memory.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or int(now) > most or int(now) <= 0:
            spark.conf.set(key, most)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; a local one is set only where none is, as in tests."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            return str(jvm_dir.get())
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set")
        d = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(d)
        return str(spark.sparkContext._jsc.sc().getCheckpointDir().get())
    return d


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_written(*tables: DataFrame) -> None:
    """Delete tables made by written(), once nothing reads them any more."""
    for df in tables:
        for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
            drop_folder(df.sparkSession, f)


def parts(spark: SparkSession) -> int:
    """Partitions of a shuffle, which the cluster sizes to its input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def trimmed(run):
    """A function over a task's frames that gives freed memory back at the end: idle workers are kept, and many may be."""

    @functools.wraps(run)
    def tidy(frames):
        yield from run(frames)
        with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return tidy


def texts(values) -> pd.Series:
    """Strings as a plain column of objects: what Arrow gets is one array, however it was made."""
    return pd.Series(list(values), dtype=object)


def to_buckets(frames: DataFrame) -> DataFrame:
    """Frames (bucket, ...) with bucket b in partition b modulo the number of partitions: as many buckets in each."""
    n = parts(frames.sparkSession)
    return frames.repartitionById(n, F.pmod(F.col("bucket"), F.lit(n)).cast("int"))


def deal(rows: np.ndarray, key: np.ndarray, n: int) -> pd.DataFrame:
    """Rows of a structured array as one blob for each bucket (key modulo n)."""
    bucket = (key % np.uint64(n)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    cut = np.flatnonzero(np.diff(bucket, prepend=-1)) if len(rows) else np.zeros(0, int)
    stop = np.append(cut[1:], len(rows))
    return pd.DataFrame({"bucket": bucket[cut] if len(rows) else np.zeros(0, np.int32), "blob": [rows[a:b].tobytes() for a, b in zip(cut, stop, strict=True)] if len(rows) else []})


#: A set of tokens as 2 ** BITS bits, by hash: it holds all of them and by chance others. Its size is a bound for what
#: the driver gets and sends, however many tokens there are.
BITS = 26


def bit_of(token: np.ndarray) -> np.ndarray:
    return (kernels.mix(token) >> np.uint64(64 - BITS)).astype(np.int64)


def bitset(bits: DataFrame) -> np.ndarray:
    """The set of the numbers in the column `bit`, made by an aggregate that combines map-side."""
    place = F.col("bit") + 1
    rows = bits.groupBy(F.bitmap_bucket_number(place).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(1 << (BITS - 3), dtype=np.uint8)
    for r in rows.collect():
        out[(r["at"] - 1) * 4096 : r["at"] * 4096] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return out


def in_set(bits: np.ndarray, token: np.ndarray) -> np.ndarray:
    at = bit_of(token)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


class Forest:
    """Union-find over rows of one block; the root is the smallest index."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def local_stars(frames):
    """Replace the edges of a task by one star for each component that the task can see."""
    a, b = [], []
    for f in frames:
        a.append(f["a"].to_numpy(np.int64))
        b.append(f["b"].to_numpy(np.int64))
    if not a:
        return
    a, b = np.concatenate(a), np.concatenate(b)
    if not len(a):
        return
    ids, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(ids))
    while True:  # hooking and pointer jumping on whole arrays
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    keep = label != np.arange(len(ids))
    yield pd.DataFrame({"a": ids[label[keep]], "b": ids[keep]})


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a long, b long) as (id, component), component the smallest id.

    Each task first replaces its edges by stars. Then rounds of parent proposals until nothing changes: a
    vertex takes its smallest proposal, and its other parents become that one's children. A round is a
    min-aggregation that combines map-side, a join by the child, and a distinct.
    Vertices without edges are not returned. Null edges and self-edges are ignored.
    """
    tidy = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b"))
    now = written(tidy.mapInPandas(local_stars, "a long, b long").distinct(), "edges")
    mark = lambda d: d.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    seen = mark(now)
    for _ in range(max_rounds):
        if not seen["n"]:
            break
        # Each edge (a < b) proposes a as b's parent; every vertex takes the smallest proposal m.
        low = now.groupBy("b").agg(F.min("a").alias("m"))
        # b keeps (m, b), and a joins m through (m, a): connectivity stays, parents fall. Then every edge
        # takes its parent's parent, so that chains halve.
        both = now.join(low, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b").alias("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e"))
        up = low.select(F.col("b").alias("a"), F.col("m").alias("up"))
        nxt = both.select("e.a", "e.b").where("a <> b").distinct().join(up, "a", "left").select(F.coalesce("up", "a").alias("a"), "b").distinct()
        nxt = written(nxt, "edges")
        drop_written(now)
        now, last, seen = nxt, seen, mark(nxt)
        if last == seen:  # only a forest of stars stays as it is
            break
    else:
        raise RuntimeError("components did not settle")
    out = now.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
    return written(out, "components")

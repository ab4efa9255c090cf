"""Operator 8: near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

Vectors are normalised in double precision. A table hashes a vector to HASHES numbers floor((a.x + b) / WIDTH)
with Gaussian a, so that near vectors often fall in one bucket; there are TABLES such tables. Vectors of equal
label and length that share a bucket are compared exactly. A pair is counted in the first table that holds both
in one bucket, so that each link counts once although pairs are never written out: a bucket yields sums of
links and a spanning forest of its links.

Equal vectors of a label are one class, compared once and counted with its size. Buckets are met by their keys
alone; a vector travels only to buckets that hold another one. A bucket of more than BLOCK classes is dealt over
pairs of blocks, each a task's work, so no task holds a large bucket. Which pairs must be compared is decided by
label and length themselves, not by a hash of them.

At cosine 0.93 (distance 0.374) a number is equal with probability 0.851, a table joins a pair with 0.851 ** 12 =
0.145, and 20 tables find 0.956 of such pairs; nearer pairs are found more often. Unrelated vectors (distance
1.41) share a table's bucket with probability 0.0002.

Vectors that are null, empty, zero or hold null or non-finite components, and those with null labels, link with
nothing. Each row is a vector of its own, also where ids repeat or are null; a component's id is the smallest
id of its rows, null only if none has one. Ids may be of any type that has an order. Of the input only the three
named columns are read, so other names can't clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common, kernels

THRESHOLD = 0.93
TABLES, HASHES, WIDTH = 20, 12, 2.0
BLOCK = 1024
SEED = 11


def projections(dim: int, tables: int, hashes: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    g = np.random.Generator(np.random.PCG64(seed))
    return g.standard_normal((dim, tables * hashes)) / width, g.random(tables * hashes)


def table_keys(x: np.ndarray, tables: int, hashes: int, width: float, seed: int) -> np.ndarray:
    """Bucket keys, one column for each table. x: normalised rows. A row's keys do not depend on the rows beside it."""
    a, b = projections(x.shape[1], tables, hashes, width, seed)
    at = np.zeros((len(x), tables * hashes))
    for k in range(x.shape[1]):  # in one order for every batch: a product of matrices may round by batch
        at += x[:, k, None] * a[k]
    cell = np.floor(at + b).astype(np.int64).view(np.uint64).reshape(len(x), tables, hashes)
    key = np.full((len(x), tables), np.uint64(seed))
    for h in range(hashes):
        key = kernels.mix(key ^ cell[:, :, h])
    return key.view(np.int64)


def normalised(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def links_of_block(x: np.ndarray, keys_of, table: int, threshold: float, rows: slice, cols: slice, same: bool):
    """Links between two blocks that table `table` is the first to hold: (row, column) and nothing else.

    keys_of: the bucket keys of some rows; only those of rows with a link are asked for.
    """
    cos = x[rows] @ x[cols].T
    i, j = np.nonzero(cos >= threshold - 1e-9)
    if same:
        i, j = i[i < j], j[i < j]
    i, j = i + rows.start, j + cols.start
    exact = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
    i, j = i[exact], j[exact]
    if table and len(i):
        own, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        keys = keys_of(x[own])[:, :table]
        first = ~(keys[at[: len(i)]] == keys[at[len(i) :]]).any(axis=1)
        i, j = i[first], j[first]
    return i, j


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, seed: int = SEED) -> DataFrame:
    """Rows (id, n_links, component_id, kept), one for each row of `vectors`."""
    spark = vectors.sparkSession
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"  # its values travel in 4 bytes each
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    good = F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False)) & F.exists("v", lambda c: c != 0)
    rows = rows.withColumn("class", F.when(good, F.sha2(F.concat_ws("/", "label", F.array_join(F.col("v").cast("array<string>"), ",")), 256)))
    members = common.written(rows.select("id", "class"), "vector-members")
    # Equal vectors meet in a partial aggregate: a class is one row, with its smallest id and its size.
    vector = F.first("v").cast("array<float>") if single else F.first("v")
    found = rows.where("class IS NOT NULL").groupBy("class").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), vector.alias("v"), F.first("label").alias("label"))
    classes = common.written(found.withColumn("cls", F.monotonically_increasing_id()), "vector-classes")

    def keyed(frames):
        for f in frames:
            size = f["v"].map(len).to_numpy()
            for d in np.unique(size):
                g = f[size == d]
                keys = table_keys(normalised(g["v"]), tables, hashes, width, seed)
                for t in range(tables):
                    yield pd.DataFrame({"cls": g["cls"].to_numpy(), "label": common.texts(g["label"]), "size": np.int32(d), "tab": np.int32(t), "bucket": keys[:, t]})

    place = ["label", "size", "tab", "bucket"]
    keys = common.written(classes.select("cls", "label", "v").mapInPandas(keyed, "cls long, label string, size int, tab int, bucket long"), "vector-keys")
    shared = keys.groupBy(*place).agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    shared = common.written(shared.select(*place, F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "vector-shared")
    # A large bucket's vector is dealt to one of its blocks and sent to each pair of blocks that has it.
    work = keys.join(shared, place).withColumn("own", F.pmod(F.xxhash64("cls"), "blocks").cast("int"))
    work = work.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    work = work.select("cls", *place, "own", "lo", "hi").join(classes.select("cls", "n", "v"), "cls")
    work = work.withColumn("work", F.xxhash64(*place, "lo", "hi")).repartition(common.parts(spark), "work")

    def compare(frames):
        got = list(frames)  # one of many partitions of bounded blocks
        if not got:
            return
        f = pd.concat(got, ignore_index=True)
        f["label"] = pd.factorize(f["label"])[0]
        order = np.lexsort([f[c].to_numpy() for c in ("cls", "own", "hi", "lo", "bucket", "tab", "label", "size")])
        f = f.iloc[order].reset_index(drop=True)
        first = kernels.runs(*(f[c].to_numpy() for c in (*place, "lo", "hi")))
        cls, n, own, lo, hi, tab = (f[c].to_numpy() for c in ("cls", "n", "own", "lo", "hi", "tab"))
        big, size = kernels.runs(f["size"].to_numpy()), f["size"].to_numpy()
        units = [normalised(f["v"].iloc[a:b]) for a, b in zip(big, kernels.stops(big, len(f)), strict=True)]  # rows come by size
        base = np.repeat(big, np.diff(big, append=len(f)))
        unit = dict(zip(size[big].tolist(), units, strict=True))
        keys_of = lambda x: table_keys(x, tables, hashes, width, seed)
        sums: dict[int, int] = {}
        edges: list[tuple[int, int]] = []
        for a, b in zip(first, kernels.stops(first, len(f)), strict=True):
            k = b - a
            if k < 2:
                continue
            x, t, m = unit[int(size[a])][a - base[a] : b - base[a]], int(tab[a]), n[a:b]
            if lo[a] == hi[a]:
                i, j = links_of_block(x, keys_of, t, threshold, slice(0, k), slice(0, k), True)
            else:
                cut = int(np.searchsorted(own[a:b], hi[a]))
                i, j = links_of_block(x, keys_of, t, threshold, slice(0, cut), slice(cut, k), False)
            if not len(i):
                continue
            more = np.bincount(i, weights=m[j], minlength=k) + np.bincount(j, weights=m[i], minlength=k)
            for q in np.flatnonzero(more):
                sums[cls[a + q]] = sums.get(cls[a + q], 0) + int(more[q])
            forest = common.Forest(k)
            edges += [(cls[a + p], cls[a + q]) for p, q in zip(i.tolist(), j.tolist(), strict=True) if forest.join(p, q)]
        yield pd.DataFrame({"a": pd.array(list(sums), dtype="Int64"), "b": pd.array([None] * len(sums), dtype="Int64"), "s": np.array(list(sums.values()), dtype=np.int64)})
        yield pd.DataFrame({"a": pd.array([e[0] for e in edges], dtype="Int64"), "b": pd.array([e[1] for e in edges], dtype="Int64"), "s": np.zeros(len(edges), dtype=np.int64)})

    links = common.written(work.select("cls", *place, "own", "lo", "hi", "n", "v").mapInPandas(compare, "a long, b long, s long"), "vector-links")
    comps = common.components(links.where("b IS NOT NULL").select("a", "b"))
    counts = links.where("b IS NULL").groupBy(F.col("a").alias("cls")).agg(F.sum("s").alias("s"))
    info = classes.select("cls", "class", "rep", "n").join(counts, "cls", "left").join(comps.withColumnRenamed("id", "cls"), "cls", "left").withColumn("comp", F.coalesce("component", "cls"))
    info = common.written(info.select("class", "comp", "rep", (F.col("n") - 1 + F.coalesce("s", F.lit(0))).alias("n_links")), "vector-info")
    common.drop_written(classes, keys, shared, links, comps)
    low = common.written(info.groupBy("comp").agg(F.min("rep").alias("component_id")), "vector-lowest")  # so that a large component's join can be split
    out = members.join(info.join(low, "comp").select("class", "n_links", "component_id"), "class", "left")
    own_id = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), own_id.alias("component_id"), F.col("id").eqNullSafe(own_id).alias("kept"))


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(common.table(spark, sf_dir, "embeddings"))


#: All pairs of equal labels by cosine in double precision; components by the smallest id that comes along links.
ORACLE_OP8 = """
WITH RECURSIVE g AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
u AS (SELECT vec_id, label, list_transform(v, lambda c: c / sqrt(list_inner_product(v, v))) AS v FROM g),
e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE list_inner_product(a.v, b.v) >= 0.93),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
c AS (SELECT x, min(y) AS low FROM r GROUP BY x),
n AS (SELECT x, count(*) AS k FROM e GROUP BY x)
SELECT t.vec_id, coalesce(n.k, 0) AS n_links, least(t.vec_id, coalesce(c.low, t.vec_id)) AS component_id, t.vec_id = least(t.vec_id, coalesce(c.low, t.vec_id)) AS kept
FROM embeddings t LEFT JOIN n ON n.x = t.vec_id LEFT JOIN c ON c.x = t.vec_id
"""

"""Operator 6: n-gram Jaccard join by rare-first prefix filtering.

A document's set holds the hashes of its distinct SHINGLE-word shingles (lower-cased A-Z; with fewer words, the
whole sequence; without words, nothing). Documents with equal sets (by 128 bits of hash) are one class and take
part once. Shingles are ordered rare first, by counts from a sketch of fixed size over all documents. Two sets
with similarity of at least NUM / DEN share a shingle among the first n - ceil(n * NUM / DEN) + 1 of both (prefix
filter). Classes that share one are a group. Its pairs pass the length filter and the positional filter, meet once
as a pair, pass the suffix filter (bounds by parts of the hash range), and are verified on the whole sets, which
are written once to the shared folder and read by range.

A prefix shingle of more than HOT classes is hot, and so is one that a single batch has of more than SEEN: such a
batch sends one entry for it, so that no task ever gets all entries of a hot shingle. The hot ones are known to all
tasks by a set of bits of fixed size, which may hold others by chance; those are hot too. Classes that share a hot one
are dealt over pairs of blocks of about BLOCK classes, each a task's work. There whole blocks are intersected at
once, and a pair is counted at its first common hot shingle; a pair that shares a hot shingle is left out
elsewhere. So each link is verified once and counted once, and what a block gives is sums of links and a spanning
forest, never its pairs.

Null and empty texts have 0 shingles and link with nothing. Repeated rows are copies of each other and count as
links. A null id is never a component's id unless all its documents' ids are null. An empty table gives an empty
result. Only the two named columns are read, so other names can't clash.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common, kernels, storage

SHINGLE = 5
NUM, DEN = 4, 5
SKETCH_BITS, RANGES = 20, 64
#: Classes of a shingle whose pairs are listed; more are dealt over pairs of blocks of about BLOCK. SEEN: in one batch.
HOT, SEEN, BLOCK = 32, 8, 384
SALTS = 64
#: Candidate pairs that are held at once.
PAIRS = 1 << 20
U = np.uint64
#: cls: half of a class's name. Two classes with one half would be candidates together, and told apart by their sets.
ENTRY = np.dtype([("token", "<u8"), ("cls", "<i8"), ("n", "<u4"), ("pos", "<u4")])


def shingle_sets(raw: list[bytes], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and where each text's begin (len + 1 offsets)."""
    w = kernels.Words(raw, lower=True)
    at, of = w.whole(width)
    h = kernels.rolling(w.hash, width)[at]
    n = np.diff(w.first)
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        sums = kernels.prefix_sums(w.hash)
        few = kernels.mix(kernels.spans(sums, w.first[short], w.first[short + 1]) + n[short].astype(U))
        h, of = np.concatenate([h, few]), np.concatenate([of, short])
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    first = kernels.runs(of, h)
    return h[first], np.searchsorted(of[first], np.arange(len(raw) + 1))


def class_of(shingles: np.ndarray) -> tuple[int, int]:
    both = np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), dtype="<i8")
    return int(both[0]), int(both[1])


def _sets(frames, width: int):
    """(rows, shingles, offsets) of batches of documents."""
    for f in frames:
        raw = kernels.utf8(f["t"])
        for a, b in kernels.batches(raw):
            h, at = shingle_sets(raw[a:b], width)
            yield f.iloc[a:b], h, at


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - (n * NUM + DEN - 1) // DEN + 1


def overlap_needed(m, n):
    """Least size of the intersection of sets of m and n for DEN * intersection >= NUM * union."""
    return (NUM * (m + n) + NUM + DEN - 1) // (NUM + DEN)


def may_link(m, i, n, j):
    """Length and positional filter for sets of m and n whose first common shingle has places i and j.

    What links passes at its first common shingle; at a later one it may be dropped.
    """
    return (DEN * np.minimum(m, n) >= NUM * np.maximum(m, n)) & (np.minimum(m - i, n - j) >= overlap_needed(m, n))


def propose(e: np.ndarray):
    """Candidate pairs of the groups of entries that are sorted by token: (places of one side, of the other)."""
    first = kernels.runs(e["token"])
    size = np.diff(first, append=len(e))
    last = np.repeat(first + size, size)
    partners = last - np.arange(len(e)) - 1
    ends = np.cumsum(partners)
    a = 0
    while a < len(e):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, side="right")))
        i = np.repeat(np.arange(a, b), partners[a:b])
        j = kernels.ranges(np.arange(a, b) + 1, partners[a:b])
        x, y = e[i], e[j]
        ok = may_link(*(v.astype(np.int64) for v in (x["n"], x["pos"], y["n"], y["pos"])))
        yield i[ok], j[ok]
        a = b


def suffix_filter(x: np.ndarray, y: np.ndarray, need: int, bits: int = 8) -> bool:
    """False if the parts of the hash range already bound the intersection below `need`."""
    p = np.bincount((x >> U(64 - bits)).astype(np.int64), minlength=1 << bits)
    q = np.bincount((y >> U(64 - bits)).astype(np.int64), minlength=1 << bits)
    return int(np.minimum(p, q).sum()) >= need


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    need = int(overlap_needed(len(x), len(y)))
    if min(len(x), len(y)) < need or not suffix_filter(x, y, need):
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int((y[at] == x).sum()) >= need


class Rows:
    """Some sorted arrays, by value: which of them hold each value."""

    def __init__(self, arrays: list[np.ndarray]):
        self.n = len(arrays)
        value = np.concatenate(arrays) if arrays else np.zeros(0, U)
        of = np.repeat(np.arange(self.n), [len(a) for a in arrays])
        order = np.argsort(value, kind="stable")
        value, self.of = value[order], of[order]
        self.first = kernels.runs(value)
        self.size, self.value = np.diff(self.first, append=len(value)), value[self.first]

    def shared(self, x: np.ndarray) -> np.ndarray:
        """For each array, how many values it has in common with x."""
        if not len(self.value) or not len(x):
            return np.zeros(self.n, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.value, x), len(self.value) - 1)
        at = at[self.value[at] == x]
        return np.bincount(self.of[kernels.ranges(self.first[at], self.size[at])], minlength=self.n)


def links_of_blocks(before_i: list[np.ndarray], n_i: np.ndarray, before_j: list[np.ndarray], n_j: np.ndarray, get_i, get_j, same: bool):
    """Links (row of i, rows of j) of two blocks that share a hot token. before: the hot tokens that a row has before
    this one; rows that share one of those have met there. get: reads a set."""
    earlier = Rows(before_j)
    wanted = []
    for i, h in enumerate(before_i):
        use = (DEN * np.minimum(n_i[i], n_j) >= NUM * np.maximum(n_i[i], n_j)) & (earlier.shared(h) == 0)
        if same:
            use[: i + 1] = False
        wanted.append(use)
    any_j = np.flatnonzero(np.any(wanted, axis=0)) if wanted else np.zeros(0, int)
    at, size = 0, np.cumsum(n_j[any_j])
    while at < len(any_j):  # so many sets at once as fit the bound, or one
        stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PAIRS, side="right")))
        some = any_j[at:stop]
        rows = Rows([get_j(j) for j in some])
        for i, use in enumerate(wanted):
            if use[some].any():
                good = use[some] & (rows.shared(get_i(i)) >= overlap_needed(n_i[i], n_j[some]))
                if good.any():
                    yield i, some[good]
        at = stop


def _sketch(base: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
    """Members (id, key, n, hi, lo), and document counts of shingles in 2 ** SKETCH_BITS counters."""

    @common.trimmed
    def run(frames):
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        for f, h, at in _sets(frames, width):
            counts += np.bincount((h >> U(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS).astype(np.uint32)
            n = np.diff(at)
            cls = [class_of(h[x:y]) if y > x else (None, None) for x, y in zip(at[:-1], at[1:], strict=True)]
            hi, lo = (pd.array([c[k] for c in cls], dtype="Int64") for k in (0, 1))
            yield pd.DataFrame({"id": common.texts(f["id"]), "key": f["key"].to_numpy(), "n": n.astype(np.int64), "hi": hi, "lo": lo, "part": np.int32(-1), "blob": None})
        parts = counts.reshape(RANGES, -1)
        some = [r for r in range(RANGES) if parts[r].any()]
        none = pd.array([None] * len(some), dtype="Int64")
        yield pd.DataFrame({"id": None, "key": 0, "n": 0, "hi": none, "lo": none, "part": np.array(some, dtype=np.int32), "blob": [zlib.compress(parts[r].tobytes(), 1) for r in some]})

    both = common.written(base.mapInPandas(run, "id string, key long, n long, hi long, lo long, part int, blob binary"), "jaccard-members")

    def add(frames):
        sums: dict[int, np.ndarray] = {}
        for f in frames:
            for r, blob in zip(f["part"], f["blob"], strict=True):
                x = np.frombuffer(zlib.decompress(blob), dtype=np.uint32).astype(np.uint64)
                sums[r] = sums[r] + x if r in sums else x
        yield pd.DataFrame({"part": np.array(list(sums), dtype=np.int32), "blob": [zlib.compress(x.tobytes(), 1) for x in sums.values()]})

    total = np.zeros((RANGES, (1 << SKETCH_BITS) // RANGES), dtype=np.uint64)
    # The sketch has 2 ** SKETCH_BITS counters whatever the input: its size is a bound for what the driver gets and sends.
    for r in both.where("part >= 0").select("part", "blob").repartition(RANGES, "part").mapInPandas(add, "part int, blob binary").collect():
        total[r["part"]] = np.frombuffer(zlib.decompress(bytes(r["blob"])), dtype=np.uint64)
    return both.where("part < 0").select("id", "key", "n", "hi", "lo"), total.reshape(-1)


def _entries(base: DataFrame, sketch: np.ndarray, width: int) -> DataFrame:
    """Blobs of the prefix entries of each batch of documents, a class once, sorted by token."""
    counts = base.sparkSession.sparkContext.broadcast(sketch)

    @common.trimmed
    def run(frames):
        for _, h, at in _sets(frames, width):
            n = np.diff(at)
            of = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((h, counts.value[(h >> U(64 - SKETCH_BITS)).astype(np.int64)], of))
            pos = np.arange(len(h)) - at[:-1][of]
            cls = np.array([class_of(h[x:y])[1] if y > x else 0 for x, y in zip(at[:-1], at[1:], strict=True)], dtype=np.int64)
            new = np.zeros(len(n), dtype=bool)
            new[np.unique(cls, return_index=True)[1]] = True
            use = (pos < prefix_length(n)[of]) & new[of]
            e = np.empty(int(use.sum()), dtype=ENTRY)
            e["token"], e["cls"], e["n"], e["pos"] = h[order][use], cls[of[use]], n[of[use]], pos[use]
            yield pd.DataFrame({"blob": [e[np.argsort(e["token"], kind="stable")].tobytes()]})

    return common.written(base.select("t").mapInPandas(run, "blob binary"), "jaccard-entries")


def _met(entries: DataFrame) -> DataFrame:
    """Rows (a, b, null) of candidate pairs of classes, and (null, null, bit) of hot tokens."""
    n_parts = common.parts(entries.sparkSession)

    @common.trimmed
    def deal(frames):
        for f in frames:
            for blob in f["blob"]:
                e = np.frombuffer(blob, dtype=ENTRY)
                first = kernels.runs(e["token"])
                size = np.diff(first, append=len(e))
                many = e[first[size > SEEN]].copy()
                many["n"] = 0  # stands for more than SEEN entries
                e = np.concatenate([e[np.repeat(size <= SEEN, size)], many])
                yield common.deal(e, kernels.mix(e["token"]), 4 * n_parts)

    @common.trimmed
    def meet(frames):
        got = [np.frombuffer(b, dtype=ENTRY) for f in frames for b in f["blob"]]
        if not got:
            return
        e = np.concatenate(got)
        del got
        e = e[np.lexsort((e["cls"], e["n"], e["token"]))]
        e = e[kernels.runs(e["token"], e["n"], e["cls"])]  # a class that several batches have sent
        first = kernels.runs(e["token"])
        size = np.diff(first, append=len(e))
        hot = (size > HOT) | (e["n"][first] == 0)
        none = lambda k: pd.array([None] * k, dtype="Int64")
        yield pd.DataFrame({"a": none(hot.sum()), "b": none(hot.sum()), "bit": pd.array(common.bit_of(e["token"][first[hot]]), dtype="Int64")})
        e = e[np.repeat(~hot, size)]
        for i, j in propose(e):
            p = np.sort(np.stack([e["cls"][i], e["cls"][j]], axis=1), axis=1)
            p = p[np.lexsort(p.T[::-1])]
            p = p[kernels.runs(*p.T)]
            yield pd.DataFrame({"a": pd.array(p[:, 0], dtype="Int64"), "b": pd.array(p[:, 1], dtype="Int64"), "bit": none(len(p))})

    return common.written(common.to_buckets(entries.mapInPandas(deal, "bucket int, blob binary")).mapInPandas(meet, "a long, b long, bit long"), "jaccard-met")


def _hot(entries: DataFrame, bits: np.ndarray) -> DataFrame:
    """Rows (cls, token) of the entries that have hot tokens."""
    sent = entries.sparkSession.sparkContext.broadcast(bits)

    @common.trimmed
    def run(frames):
        for f in frames:
            for blob in f["blob"]:
                e = np.frombuffer(blob, dtype=ENTRY)
                e = e[common.in_set(sent.value, e["token"])]
                yield pd.DataFrame({"cls": e["cls"], "token": e["token"].view(np.int64)})

    return entries.mapInPandas(run, "cls long, token long").distinct()


def _stored(base: DataFrame, wanted: DataFrame, width: int, folder: str) -> DataFrame:
    """Write the sets of the wanted classes (cls, hi, lo, key) to files of a folder; rows (cls, file, offset, size)."""
    rows = base.select("key", "t").join(wanted.hint("merge"), "key")  # alike at every size

    @common.trimmed
    def run(frames):
        out = None
        for f in frames:
            got = []
            for g, h, at in _sets([f], width):
                for cls, hi, lo, x, y in zip(g["cls"], g["hi"], g["lo"], at[:-1], at[1:], strict=True):
                    if class_of(h[x:y]) == (hi, lo):  # not another row with that key
                        if out is None:
                            name = uuid.uuid4().hex
                            out = storage.Writer(folder, name)
                        blob = h[x:y].tobytes()
                        got.append((cls, name, out.write(blob), len(blob)))
            yield pd.DataFrame(got, columns=["cls", "file", "offset", "size"])
        if out:
            out.close()

    sets = rows.mapInPandas(run, "cls long, file string, offset long, size long")
    return common.written(common.written(sets, "jaccard-stored").dropDuplicates(["cls"]), "jaccard-sets-index")


class _Found:
    """Sums of links of classes, and edges that connect what is linked."""

    def __init__(self):
        self.sums: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def count(self, cls: int, n: int) -> None:
        self.sums[cls] = self.sums.get(cls, 0) + int(n)

    def frames(self):
        yield pd.DataFrame({"a": pd.array(list(self.sums), dtype="Int64"), "b": pd.array([None] * len(self.sums), dtype="Int64"), "s": np.array(list(self.sums.values()), dtype=np.int64)})
        yield pd.DataFrame({"a": pd.array([e[0] for e in self.edges], dtype="Int64"), "b": pd.array([e[1] for e in self.edges], dtype="Int64"), "s": np.zeros(len(self.edges), dtype=np.int64)})
        self.__init__()


FOUND = "a long, b long, s long"
PLACE = ("docs", "file", "offset", "size", "hot")


def _verified(pairs: DataFrame, sets: DataFrame, folder: str) -> DataFrame:
    """Links of pairs (a, b) that share no hot token. A set with many partners is read once for each share of them."""
    n = common.parts(pairs.sparkSession)
    side = lambda c: sets.select(F.col("cls").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in PLACE))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where("NOT arrays_overlap(a_hot, b_hot)").drop("a_hot", "b_hot")
    both = both.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))

    def verify(frames):
        reader, last, own = storage.Reader(64), None, None
        get = lambda file, *where: np.frombuffer(reader.read(f"{folder}/{file}", *where), dtype=U)
        for f in frames:
            found = _Found()
            for a, b, ad, af, ao, az, bd, bf, bo, bz in f[["a", "b", *(f"{c}_{x}" for c in "ab" for x in PLACE[:4])]].itertuples(index=False):
                if min(az, bz) < 8 * overlap_needed(az // 8, bz // 8):
                    continue
                if last != a:
                    last, own = a, get(af, ao, az)
                if linked(own, get(bf, bo, bz)):
                    found.count(a, bd)
                    found.count(b, ad)
                    found.edges.append((a, b))
            yield from found.frames()
        reader.close()

    return both.repartition(n, "a", "s").sortWithinPartitions("a").mapInPandas(verify, FOUND)


def _blocks(hot: DataFrame, sets: DataFrame, folder: str) -> DataFrame:
    """Links of classes (cls, token, blocks) that share a hot token, block by block."""
    n = common.parts(hot.sparkSession)
    rows = hot.withColumn("own", F.pmod(F.xxhash64("cls"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("cls", "token", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).join(sets.select("cls", *PLACE), "cls")
    rows = rows.withColumn("hot", F.filter("hot", lambda x: x < F.col("token")))
    rows = rows.withColumn("work", F.xxhash64("token", "lo", "hi")).repartition(n, "work").sortWithinPartitions("token", "lo", "hi", "own", "cls").drop("work")

    def groups(frames):
        """The rows of one work at a time."""
        rest = None
        for f in frames:
            f = f if rest is None else pd.concat([rest, f], ignore_index=True)
            first = kernels.runs(*(f[c].to_numpy() for c in ("token", "lo", "hi")))
            for a, b in zip(first[:-1], first[1:], strict=True):
                yield f.iloc[a:b]
            rest = f.iloc[first[-1] :] if len(first) else None
        if rest is not None and len(rest):
            yield rest

    def compare(frames):
        reader = storage.Reader(64)
        for g in groups(frames):
            if len(g) < 2:
                continue
            cls, docs, own = (g[c].to_numpy() for c in ("cls", "docs", "own"))
            n, before = g["size"].to_numpy() // 8, [np.asarray(h, dtype=np.int64) for h in g["hot"]]
            where, held = g[["file", "offset", "size"]].to_numpy(), {}

            def get(i: int) -> np.ndarray:
                if i not in held:
                    if sum(map(len, held.values())) > PAIRS:
                        held.clear()
                    held[i] = np.frombuffer(reader.read(f"{folder}/{where[i][0]}", *where[i][1:]), dtype=U)
                return held[i]

            same = bool(g["lo"].iloc[0] == g["hi"].iloc[0])
            cut = 0 if same else int(np.searchsorted(own, g["hi"].iloc[0]))
            stop = len(g) if same else cut
            found, forest = _Found(), common.Forest(len(g))
            for i, some in links_of_blocks(before[:stop], n[:stop], before[cut:], n[cut:], get, lambda j: get(cut + j), same):  # noqa: B023
                some = some + cut
                found.count(cls[i], docs[some].sum())
                for j in some.tolist():
                    found.count(cls[j], docs[i])
                    if forest.join(i, j):
                        found.edges.append((cls[i], cls[j]))
            yield from found.frames()
        reader.close()

    return rows.mapInPandas(compare, FOUND)


def _classes(docs: DataFrame, id_col: str, text_col: str, width: int) -> tuple[DataFrame, DataFrame]:
    """Members (id, key, n, hi, lo), one for each document, and classes (hi, lo, comp, component_id, n_links)."""
    spark = docs.sparkSession
    # Texts without words share no key, however many are alike.
    key = F.when(F.coalesce(F.trim(F.col(text_col)), F.lit("")) == "", F.xxhash64(F.monotonically_increasing_id(), F.lit("empty"))).otherwise(F.xxhash64(F.col(id_col), F.col(text_col)))
    base = docs.select(F.col(id_col).cast("string").alias("id"), key.alias("key"), F.col(text_col).alias("t"))
    members, sketch = _sketch(base, width)
    members = members.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))
    classes = members.where("hi IS NOT NULL").groupBy("hi", "lo").agg(F.min("id").alias("first"), F.min("key").alias("key"), F.count(F.lit(1)).alias("docs"))
    classes = common.written(classes.withColumn("cls", F.monotonically_increasing_id()), "jaccard-classes")

    entries = _entries(base, sketch, width)
    met = _met(entries)
    name = lambda c: classes.select(F.col("lo").alias(c), F.col("cls").alias(f"{c}_cls"))
    pairs = met.where("bit IS NULL").select("a", "b").distinct().join(name("a"), "a").join(name("b"), "b")
    pairs = common.written(pairs.select(F.col("a_cls").alias("a"), F.col("b_cls").alias("b")), "jaccard-pairs")
    bits = common.bitset(met.where("bit IS NOT NULL").select("bit"))
    owners = common.written(_hot(entries, bits).withColumnRenamed("cls", "a").join(name("a"), "a").select(F.col("a_cls").alias("cls"), "token"), "jaccard-hot-entries")
    common.drop_written(entries)
    blocks = owners.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("token", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    hot = common.written(owners.join(blocks, "token"), "jaccard-hot-blocks")
    common.drop_written(owners)

    folder = common.fresh(spark, "jaccard-set-files")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).unionByName(hot.select("cls")).distinct()
    wanted = common.written(wanted.join(classes.select("cls", "hi", "lo", "key", "docs"), "cls"), "jaccard-wanted")
    lists = hot.groupBy("cls").agg(F.collect_list("token").alias("hot"))  # at most a prefix for each class
    sets = _stored(base, wanted.select("cls", "hi", "lo", "key"), width, folder).join(wanted.select("cls", "docs"), "cls").join(lists, "cls", "left")
    sets = common.written(sets.withColumn("hot", F.coalesce("hot", F.array().cast("array<long>"))), "jaccard-sets")

    links = [common.written(_verified(pairs, sets, folder), "jaccard-links"), common.written(_blocks(hot, sets, folder), "jaccard-links")]
    common.drop_folder(spark, folder)
    links = links[0].unionByName(links[1])
    comps = common.components(links.where("b IS NOT NULL").select("a", "b"))
    counts = links.where("b IS NULL").groupBy(F.col("a").alias("cls")).agg(F.sum("s").alias("s"))
    info = classes.join(comps.withColumnRenamed("id", "cls"), "cls", "left").join(counts, "cls", "left")
    info = common.written(info.select("hi", "lo", "first", F.coalesce("component", "cls").alias("comp"), (F.col("docs") - 1 + F.coalesce("s", F.lit(0))).alias("n_links")), "jaccard-info")
    common.drop_written(classes, met, pairs, hot, wanted, sets, links, comps)
    lowest = common.written(info.groupBy("comp").agg(F.min("first").alias("component_id")), "jaccard-lowest")  # so that a large component's join can be split
    return members, info.join(lowest, "comp").select("hi", "lo", "comp", "component_id", "n_links")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """Rows (id, n_shingles, component_id, n_links), one for each document; n_links counts other documents."""
    members, info = _classes(docs, id_col, text_col, width)
    out = members.join(common.written(info, "jaccard-result"), ["hi", "lo"], "left")
    own = F.when(F.col("hi").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, that with the smallest id; all columns stay. Of repeated rows one stays.

    Rows are told apart by id and a hash of id and text, so null and repeated ids are no exception: of several rows
    with a component's smallest id that with the smallest hash stays. Documents without words are alone in their
    component and stay. The documents' columns travel as one struct, so their names can't clash.
    """
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"))
    words = F.coalesce(F.col(f"doc.{text_col}"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    members, info = _classes(docs.select(F.col(id_col), F.col(text_col)), id_col, text_col, SHINGLE)
    # The rows with words; of those without, each is its own component, and repeated rows are one.
    low = members.where("hi IS NOT NULL").join(common.written(info, "jaccard-result"), ["hi", "lo"]).where("id <=> component_id")
    rows = low.groupBy("comp", "id", "key").agg(F.count(F.lit(1)).alias("n"))
    firsts = rows.groupBy("comp", "id").agg(F.min("key").alias("key"), F.min_by("n", "key").alias("n"))
    firsts = common.written(firsts.select(F.col("id").alias("f_id"), F.col("key").alias("f_key"), "n"), "jaccard-kept")
    same = (F.col("key") == F.col("f_key")) & F.col("id").eqNullSafe(F.col("f_id"))
    of = lambda which: keyed.where(words).join(firsts.where(which).hint("merge"), same, "left_semi")
    kept, again = of("n = 1"), "n > 1"  # rows that are repeated, if there are any
    kept = kept if firsts.where(again).isEmpty() else kept.unionByName(of(again).dropDuplicates(["id", "key"]))
    bare = keyed.where(~words)
    twice = common.written(bare.groupBy("id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "jaccard-bare")
    if not twice.isEmpty():
        bare = bare.dropDuplicates(["id", "key"])
    return kept.unionByName(bare).select(*(F.col("doc")[c].alias(c) for c in docs.columns))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(common.table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, by the sizes of intersection and union; components by the smallest id along links.
ORACLE_OP6 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS m, b.n AS n, count(*) AS k FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) GROUP BY ALL),
e AS (SELECT x, y FROM p WHERE 100 * k >= 80 * (m + n - k)),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
c AS (SELECT x, min(y) AS low FROM r GROUP BY x),
d AS (SELECT x, count(*) AS k FROM e GROUP BY x)
SELECT s.doc_id, len(s.s) AS n_shingles, least(s.doc_id, coalesce(c.low, s.doc_id)) AS component_id, coalesce(d.k, 0) AS n_links
FROM s LEFT JOIN c ON c.x = s.doc_id LEFT JOIN d ON d.x = s.doc_id
"""

"""Operator 7: best-fit packing of tokenised documents into sequences, by large-item matching.

Documents are tokenised, closed with id END, and cut into pieces of at most `capacity` ids. The packing is
planned on the histogram of piece lengths (at most `capacity` numbers, however many documents there are):
pieces above a third of the capacity go at most two to a bin, matched greedily, the longest with the longest
that fits; all smaller pieces then go, longest first, into the bins whose remaining gap fits them best, and
into new bins when no gap does. The plan is a bounded list of runs of equal bins. A piece finds its bin by
its rank among the pieces of its length. For that the pieces, small rows, are dealt by ranges of length and place of
origin: a partition holds few lengths, so that the counts by partition and length, which give the ranks' offsets,
are at most as many as partitions and lengths together, however many pieces or tasks there are.

Null and empty texts are one piece that holds END only. Repeated rows are packed each. Only the two named
columns are read.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common, kernels

MODEL = "word_bpe_49k.json"
CAPACITY = 4096
END = 1
#: Words, and pre-tokens of words, whose ids are kept; a table is emptied when full. They change speed only.
CACHE_WORDS, CACHE_PARTS = 1_500_000, 1_000_000


#: The tokenizer's own cut into pre-tokens, for words of Latin-1 characters, where lower case and composition
#: are plain: letters, single digits, and runs of what is neither these nor blank.
_LETTERS, _DIGITS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
PRE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\t-\r \x85\xa0{_LETTERS}{_DIGITS}]+")
OTHER = re.compile("[^\x00-\xff]")


#: Texts whose ids are compared with the library's when a model is loaded: a model with other rules raises.
PROBES = ("Hello WORLD, it's 1234.", " two  blanks\nand\ta tab ", "½ é e\u0301 ﬁ 漢字 😀 \x85\xa0", "<|endoftext|> <| x", "don't we'll 've 3.14%")


class WordIds:
    """Ids of whole texts by the library, which encodes each distinct pre-token once.

    No rule of the tokenizer reaches across a blank, so a text is cut at blanks and each distinct word is looked
    up; a word not met before is cut into pre-tokens. Words with characters beyond Latin-1, or with what may be
    a special token, go to the library as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model, self.words, self.parts = Tokenizer.from_file(path), {}, {}
        vocab = self.model.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True  # the last id of a pre-token
        if self.encode(list(PROBES)) != self.library(list(PROBES)):
            raise ValueError(f"{path} cuts texts in another way than this module")

    def library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, parts: list[str]) -> None:
        """Many pre-tokens go to the library in one text, as a call for each costs more than its ids."""
        for a in range(0, len(parts), 200):
            some = parts[a : a + 200]
            ids = np.array(self.model.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            end = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(end) == len(some) and end[-1] == 4 * len(ids):
                raw, end = ids.tobytes(), end.tolist()
                self.parts.update(zip(some, (raw[i:j] for i, j in zip([0, *end], end, strict=False)), strict=True))
            else:  # a model without word ends
                self.parts.update(zip(some, self.library(some), strict=True))

    def encode_words(self, words: list[str]) -> list[bytes]:
        if len(self.parts) > CACHE_PARTS:
            self.parts.clear()
        whole, cut, known = set(), [], self.parts
        for w in words:
            if w.isalpha() and w.isascii():
                cut.append((w if w.islower() else w.lower(),))
            elif not w.isascii() and OTHER.search(w) or "<|" in w:
                whole.add(w)
                cut.append((w,))
            else:
                cut.append(PRE.findall(w.lower()))
        new = list({p for c in cut for p in c if p not in known} - whole)
        self.learn(new)
        as_is = list(whole)
        known.update(zip(as_is, self.library(as_is), strict=True))
        out = [known[c[0]] if len(c) == 1 else b"".join([known[p] for p in c]) for c in cut]
        for p in (*as_is, *new):
            if len(p) > 64 or p in whole:
                del known[p]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids, without END. Each distinct word of the batch is looked up once."""
        split = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        kind, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        ids = list(map(self.words.get, words))
        gaps = [i for i, x in enumerate(ids) if x is None]
        new = [words[i] for i in gaps]
        for i, w, x in zip(gaps, new, self.encode_words(new), strict=True):
            ids[i] = x
            if len(w) <= 64:
                self.words[w] = x
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        first, every = np.cumsum(size) - size, np.frombuffer(b"".join(ids), dtype="<u4")
        out = every[kernels.ranges(first[kind], size[kind])]
        end = np.concatenate([[0], np.cumsum(size[kind])])[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        return [out[i:j].tobytes() for i, j in zip(end[:-1], end[1:], strict=True)]


_models: dict[str, WordIds] = {}


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces (k, piece, start, length, ids_crc32, rank, task[, ids]) of the documents, in one pass without a shuffle."""
    model = model or common.tokenizer_path(MODEL)
    kind = docs.schema[id_col].dataType

    @common.trimmed
    def run(frames):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if model not in _models:
            _models[model] = WordIds(model)
        m, seen, done = _models[model], np.zeros(capacity + 1, dtype=np.int64), {}
        end = np.array([END], dtype="<u4").tobytes()
        for f in frames:
            texts = [t if t is not None else "" for t in f.column(1).to_pylist()]
            raw = [t.encode() for t in texts]
            for a, b in kernels.batches(raw, common.BATCH_BYTES):  # the larger, the fewer words are looked up
                of, piece, start, length, check, ids = [], [], [], [], [], []
                name = [hashlib.blake2b(x, digest_size=16).digest() for x in raw[a:b]]
                if len(done) > 50_000:
                    done.clear()
                todo = [i for n, i in {n: i for i, n in enumerate(name, a)}.items() if n not in done]
                for i, x in zip(todo, m.encode([texts[i] for i in todo]), strict=True):  # equal texts are encoded once
                    x += end
                    cut = [x[s : s + 4 * capacity] for s in range(0, len(x), 4 * capacity)]
                    done[name[i - a]] = [(len(c) // 4, kernels.crc(c), c if with_ids else None) for c in cut]
                for i, n in enumerate(name, a):
                    for p, (size, crc, cut) in enumerate(done[n]):
                        of.append(i)
                        piece.append(p)
                        start.append(p * capacity)
                        length.append(size)
                        check.append(crc)
                        ids.append(cut)
                if with_ids:
                    done.clear()
                rank = np.empty(len(length), dtype=np.int64)  # among the task's pieces of that length
                for j, x in enumerate(length):
                    rank[j] = seen[x]
                    seen[x] += 1
                cols = [f.column(0).take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(check, pa.int64()), pa.array(rank)]
                names = ["k", "piece", "start", "length", "ids_crc32", "rank"]
                if with_ids:
                    cols.append(pa.array(ids, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"k {kind.simpleString()}, piece int, start long, length long, ids_crc32 long, rank long" + (", ids binary" if with_ids else "")
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInArrow(run, schema)
    return rows.withColumn("task", F.spark_partition_id())


class Bins:
    """Groups of equal bins by their gap: content (length, times) ..., and how many bins."""

    def __init__(self):
        self.gaps: list[int] = []
        self.groups: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}

    def add(self, gap: int, content: tuple[tuple[int, int], ...], n: int) -> None:
        if n:
            if gap not in self.groups:
                insort(self.gaps, gap)
                self.groups[gap] = []
            self.groups[gap].append((content, n))

    def best(self, size: int) -> int | None:
        """The smallest gap that holds `size`."""
        i = bisect_left(self.gaps, size)
        return self.gaps[i] if i < len(self.gaps) else None

    def take(self, gap: int) -> tuple[tuple[tuple[int, int], ...], int]:
        group = self.groups[gap].pop()
        if not self.groups[gap]:
            del self.groups[gap]
            self.gaps.remove(gap)
        return group


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Runs of equal bins (content, bins) that hold all pieces."""
    left = {s: n for s, n in histogram.items() if n}
    large = sorted(s for s in left if 3 * s > capacity)
    bins, many = Bins(), {s: left[s] for s in large}
    for s in reversed(large):  # the longest takes the longest partner that fits
        while many[s]:
            i = bisect_left(large, capacity - s + 1) - 1
            while i >= 0 and (not many[large[i]] or large[i] > s):
                i -= 1
            if i < 0:
                bins.add(capacity - s, ((s, 1),), many[s])
                many[s] = 0
            elif large[i] == s:
                bins.add(capacity - 2 * s, ((s, 2),), many[s] // 2)
                odd = many[s] % 2
                many[s] = 0
                if odd:
                    j = i - 1
                    while j >= 0 and not many[large[j]]:
                        j -= 1
                    if j >= 0:
                        many[large[j]] -= 1
                        bins.add(capacity - s - large[j], ((s, 1), (large[j], 1)), 1)
                    else:
                        bins.add(capacity - s, ((s, 1),), 1)
            else:
                n = min(many[s], many[large[i]])
                many[s] -= n
                many[large[i]] -= n
                bins.add(capacity - s - large[i], ((s, 1), (large[i], 1)), n)
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[s]
        while n:
            gap = bins.best(s)
            if gap is None:
                gap, content, k = capacity, (), -(-n // (capacity // s))
            else:
                content, k = bins.take(gap)
            fit = gap // s  # best fit stays in a bin while it can
            full = min(k, n // fit)
            bins.add(gap - fit * s, (*content, (s, fit)), full)
            n -= full * fit
            k -= full
            if k and n:  # fewer than `fit` are left
                bins.add(gap - n * s, (*content, (s, n)), 1)
                n, k = 0, k - 1
            if content:
                bins.add(gap, content, k)
    return [g for gap in bins.gaps for g in bins.groups[gap]]


def slots(bins: list[tuple[tuple[tuple[int, int], ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first sequence, times, offset): where ranks of a length go."""
    used: dict[int, int] = {}
    out, base = [], 0
    for content, n in bins:
        at = 0
        for s, times in content:
            a = used.get(s, 0)
            out.append((s, a, a + n * times, base, times, at))
            used[s] = a + n * times
            at += s * times
        base += n
    return out


def _ranked(pieces: DataFrame, capacity: int) -> DataFrame:
    """The pieces with their range partition (part) and their place among its pieces of their length."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", place long"

    def count(batches):
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for b in batches:
            length = b.column("length").to_numpy()
            first = kernels.runs(length)  # a partition's rows come sorted by length
            size = np.diff(first, append=len(length))
            place = np.arange(len(length)) - np.repeat(first, size) + np.repeat(seen[length[first]], size)
            seen[length[first]] += size
            yield b.append_column("place", pa.array(place))

    order = ["length", "task", "rank"]
    ranges = pieces.repartitionByRange(common.parts(pieces.sparkSession), *order).sortWithinPartitions(*order)
    return common.written(ranges.mapInArrow(count, schema).withColumn("part", F.spark_partition_id()), "pieces-ranked")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset. `pieces` must be a written table: its rows are read more than once."""
    spark = pieces.sparkSession
    pieces = _ranked(pieces, capacity)
    counts = common.written(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table = np.array(sorted(slots(plan(totals, capacity))) or np.zeros((0, 6)), dtype=np.int64)
    sent = spark.sparkContext.broadcast(table)  # bounded: the slots of a plan over at most `capacity` lengths
    ready = pieces.join(F.broadcast(_before(counts)), ["part", "length"])  # at most as many rows as partitions and lengths
    cols = ["k", "piece", "start", "length", "ids_crc32"] + (["ids"] if "ids" in pieces.columns else [])
    schema = ", ".join(f"{c} {pieces.schema[c].dataType.simpleString()}" for c in cols) + ", sequence_id long, offset long"

    def place(batches):
        t = sent.value
        first = t[:, 0] << 40 | t[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("first").to_numpy() + b.column("place").to_numpy()
            at = t[np.searchsorted(first, length << 40 | rank, side="right") - 1]
            within = rank - at[:, 1]
            where = [pa.array(at[:, 3] + within // at[:, 4]), pa.array(at[:, 5] + within % at[:, 4] * length)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), *where], names=[*cols, "sequence_id", "offset"])

    return ready.mapInArrow(place, schema)


def _before(counts: DataFrame) -> DataFrame:
    """For each partition and length, how many pieces of the length partitions before it have."""
    from pyspark.sql import Window

    w = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("part", "length", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("first"))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, model: str | None = None) -> DataFrame:
    pieces = common.written(tokenised(docs, id_col, text_col, model, capacity), "pieces")
    return pack(pieces, capacity).withColumnRenamed("k", id_col)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"))



"""Operator 1: sampled piece segmentations by forward filtering and backward sampling, and their decoding.

Every distinct unit (blanks and the characters that follow them) has a lattice whose edges are pieces.
Forward filtering gives, for each node, the share of each incoming edge among all paths that reach it.
Backward sampling walks from a unit's end to its start; all units of a batch take one step at a time with a
single search in the sorted shares. Draws are a hash of row key, unit number and step: the same row and seed
give the same pieces wherever and whenever they run. A piece's weight is 1 / (rank + OFFSET) ** alpha, as
the vocabulary has ranks and no probabilities.

Decoding is lossless for every text. A character without a piece, a line feed and the blank mark itself
become byte pieces. A text that is not empty gets one blank in front, which decoding takes off. Null and
empty texts have no pieces and decode to the empty string. Repeated rows with equal keys get equal pieces.
Only the two named columns are read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common, kernels

MODEL = "piece_bpe_32k.model"
MARK = "▁"
OFFSET = 10.0
UNIT = re.compile(f" *[^ \n{MARK}]+| +|\n|{MARK}")
#: Edges that are kept; when a batch's new ones do not fit, all go but those of the batch.
ROOM = 4_000_000
U = np.uint64


class Lattices:
    """Lattices of units, built once and kept for later batches while there is room.

    A node's edges stand together; `share` is their cumulated probability, 1 for the last.
    """

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        order = sorted(normal, key=lambda i: -model.get_score(i))
        name = {i: model.id_to_piece(i).replace(MARK, " ") for i in normal}
        self.longest = max(map(len, name.values()))
        scale = 8.0  # per character; it is the same for all paths of a unit and keeps the sums near 1
        odds = {i: (scale ** len(name[i])) / (r + OFFSET) ** alpha for r, i in enumerate(order)}
        self.least = scale / (len(order) + OFFSET) ** alpha
        self.bytes = [name[i].encode() if i in name else b"" for i in range(n)]
        for b, i in enumerate(self.byte):
            self.bytes[i] = bytes([b])
        spelled = np.zeros(0x110000, dtype=bool)  # characters without a piece, and those that decoding would change
        spelled[:] = True
        spelled[[ord(name[i]) for i in normal if len(name[i]) == 1]] = False
        spelled[[ord(MARK), ord("\n")]] = True
        self.spelled = spelled
        self.tables = {}  # by length: sorted hashes, their ids and weights
        self.filter = np.zeros(1 << 22, dtype=bool)
        for w in range(1, self.longest + 1):
            ids = np.array([i for i in normal if len(name[i]) == w], dtype=np.int32)
            if len(ids):
                codes = self.codes("".join(name[i] for i in ids.tolist()))
                sums = kernels.prefix_sums(codes)
                h = kernels.spans(sums, np.arange(len(ids)) * w, np.arange(1, len(ids) + 1) * w)
                o = np.argsort(h)
                self.tables[w] = (h[o], ids[o], np.array([odds[i] for i in ids[o].tolist()]))
                self.filter[(h >> U(42)).astype(np.int64)] = True

        self.clear(ROOM)

    def clear(self, room: int) -> None:
        self.unit: dict[str, int] = {}  # number of a unit
        self.share, self.back, self.edge = np.empty(room), np.empty(room, np.int32), np.empty(room, np.int32)
        self.start, self.end, self.first = np.empty(room // 4, np.int32), np.empty(room // 4, np.int32), np.empty(room, np.int32)
        self.edges = self.nodes = 0

    def add(self, units: list[str], room: int = ROOM) -> None:
        base, begin, share, back, edge = self.build(units)
        n, k = len(self.unit), len(units)
        if self.edges + len(share) > len(self.share) or self.nodes + len(begin) > len(self.first) or n + k > len(self.start):
            if n:
                raise MemoryError
            self.clear(max(room, 2 * len(share), 2 * len(begin), 5 * k))
        a, b = self.edges, self.edges + len(share)
        self.share[a:b], self.back[a:b], self.edge[a:b] = share, back + self.nodes, edge
        self.first[self.nodes : self.nodes + len(begin)] = begin + a
        size = np.fromiter(map(len, units), dtype=np.int64, count=k)
        self.start[n : n + k], self.end[n : n + k] = base + self.nodes, base + self.nodes + size
        self.unit.update(zip(units, range(n, n + k), strict=True))
        self.edges, self.nodes = b, self.nodes + int(size.sum()) + k

    def numbers(self, cut: list[list[str]], total: int) -> np.ndarray:
        """Number of each unit of a batch; what is not known yet is built."""
        every = set().union(*cut)
        new = list(every.difference(self.unit))
        if new:
            try:
                self.add(new)
            except MemoryError:
                self.clear(ROOM)
                self.add(list(every))
        get = self.unit.__getitem__
        return np.fromiter((get(s) for c in cut for s in c), dtype=np.int64, count=total)

    @staticmethod
    def codes(s: str) -> np.ndarray:
        return kernels.mix(np.frombuffer(s.encode("utf-32-le"), dtype="<u4").astype(U) + U(1))

    def build(self, units: list[str]) -> tuple[np.ndarray, ...]:
        """First node of each unit, first edge of each node, share, back and edge of the units' lattices.

        Edge e >= 0 is a piece, e < 0 spells character -1 - e in bytes.
        """
        text = "".join(units)
        char = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        size = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        last = np.repeat(np.cumsum(size), size)  # end of each character's unit
        unit = np.repeat(np.arange(len(units)), size)
        sums = kernels.prefix_sums(kernels.mix(char.astype(U) + U(1)))
        src, dst, edge, weight = [], [], [], []
        for w, (table, ids, odds) in self.tables.items():
            at = np.flatnonzero(last - np.arange(len(char)) >= w)
            h = kernels.spans(sums, at, at + w)
            maybe = np.flatnonzero(self.filter[(h >> U(42)).astype(np.int64)])
            at, h = at[maybe], h[maybe]
            k = np.minimum(np.searchsorted(table, h), len(table) - 1)
            hit = table[k] == h
            at, k = at[hit], k[hit]
            if w == 1:
                use = ~self.spelled[char[at]]
                at, k = at[use], k[use]
            src.append(at + unit[at])
            dst.append(at + unit[at] + w)
            edge.append(ids[k])
            weight.append(odds[k])
        at = np.flatnonzero(self.spelled[char])
        src.append(at + unit[at])
        dst.append(at + unit[at] + 1)
        edge.append((-1 - char[at].astype(np.int64)).astype(np.int32))
        weight.append(np.full(len(at), self.least))
        src, dst, edge, weight = map(np.concatenate, (src, dst, edge, weight))
        order = np.argsort(dst << 5 | dst - src, kind="stable")  # by node, then by length; each length came sorted
        src, dst, edge, weight = src[order], dst[order], edge[order], weight[order]
        base = np.cumsum(size) - size + np.arange(len(units))  # a unit of n characters has n + 1 nodes
        total = int(size.sum()) + len(units)
        depth = np.arange(total) - np.repeat(base, size + 1)
        forward = np.zeros(total)
        forward[base] = 1.0
        level = depth[dst]
        by = np.argsort(level.astype(np.int16) if total < 32768 or size.max(initial=0) < 32768 else level, kind="stable")
        cut = np.searchsorted(level[by], np.arange(1, int(size.max(initial=0)) + 2))
        owner = np.repeat(np.arange(len(units)), size + 1)
        for d in range(1, len(cut)):
            e = by[cut[d - 1] : cut[d]]
            first = kernels.runs(dst[e])
            node = dst[e][first]
            forward[node] = np.add.reduceat(forward[src[e]] * weight[e], first)
            if d % 64 == 0:  # in very long units only ratios within reach of the longest piece matter
                near = np.flatnonzero((depth > d - self.longest) & (depth <= d) & (size[owner] > 64))
                top = np.zeros(len(units))
                np.maximum.at(top, owner[near], forward[near])
                forward[near] /= np.maximum(top[owner[near]], 1e-300)
        part = forward[src] * weight
        first = kernels.runs(dst)
        counts = np.diff(first, append=len(dst))
        p = part / np.repeat(np.add.reduceat(part, first), counts) if len(part) else part
        share = np.clip(np.cumsum(p) - np.repeat(np.arange(len(first)), counts), 0.0, 1.0)
        share[first + counts - 1] = 1.0
        begin = np.zeros(total, dtype=np.int64)
        begin[dst[first]] = first
        return base, begin, share, src, edge

    def encode(self, texts: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        cut = [UNIT.findall(" " + t) if t else [] for t in texts]
        per = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
        total = int(per.sum())
        if not total:
            return np.zeros(0, np.int32), per
        which = self.numbers(cut, total)
        share, back, edge = self.share, self.back, self.edge
        start, v = self.start[which], self.end[which]
        key = kernels.mix(np.repeat(seeds, per) + (np.arange(total) - np.repeat(np.cumsum(per) - per, per)).astype(U) * U(kernels.BASE))
        live, steps, taken, step = np.arange(total), np.zeros(total, np.int64), [], 0
        while len(live):
            u = (kernels.mix(key[live] + U((step + 1) * 0xD1B54A32D192ED03 % 2**64)) >> U(11)).astype(np.float64) * 2.0**-53
            e = self.first[v[live]]
            on = np.flatnonzero(share[e] <= u)
            while len(on):
                e[on] += 1
                on = on[share[e[on]] <= u[on]]
            taken.append((live, edge[e]))
            v[live] = back[e]
            steps[live] += 1
            live = live[v[live] > start[live]]
            step += 1
        first = np.cumsum(steps) - steps
        edges = np.empty(int(steps.sum()), dtype=np.int32)
        for k, (who, e) in enumerate(taken):
            edges[first[who] + steps[who] - 1 - k] = e
        width = np.ones(len(edges), dtype=np.int64)
        odd = np.flatnonzero(edges < 0)
        flat = edges
        if len(odd):
            spelled = [[self.byte[b] for b in chr(-1 - e).encode()] for e in edges[odd].tolist()]
            width[odd] = list(map(len, spelled))
            flat = np.repeat(edges, width)
            flat[kernels.ranges((np.cumsum(width) - width)[odd], width[odd])] = [b for s in spelled for b in s]
        of = np.repeat(np.repeat(np.arange(len(texts)), per), steps)
        return flat, np.bincount(of, weights=width, minlength=len(texts)).astype(np.int64)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids))[1:].decode()


_lattices: dict[tuple[str, float], Lattices] = {}


def lattices(path: str, alpha: float) -> Lattices:
    if (path, alpha) not in _lattices:
        _lattices[path, alpha] = Lattices(path, alpha)
    return _lattices[path, alpha]


def encode_sampled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, seed: int = 17, alpha: float = 1.0) -> DataFrame:
    """Rows (id, text, ids, n_pieces): a sampled segmentation of every text, in one pass without a shuffle."""
    model = model or common.tokenizer_path(MODEL)
    kind = docs.schema[id_col].dataType.simpleString()

    @common.trimmed
    def run(frames):
        m = lattices(model, alpha)
        for f in frames:
            texts = [t if t is not None else "" for t in f.column(2).to_pylist()]
            key = f.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(U)
            seeds = kernels.mix(key ^ U(seed * 0x9E3779B97F4A7C15 % 2**64))
            for a, b in kernels.batches([t.encode() for t in texts]):
                ids, n = m.encode(texts[a:b], seeds[a:b])
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([f.column(0).slice(a, b - a), f.column(2).slice(a, b - a), ids, pa.array(n)], names=["k", "t", "ids", "n_pieces"])

    rows = docs.select(F.col(id_col).alias("k"), F.xxhash64(F.col(id_col)).alias("h"), F.col(text_col).alias("t"))
    out = rows.mapInArrow(run, f"k {kind}, t string, ids array<int>, n_pieces long")
    return out.select(F.col("k").alias(id_col), F.col("t").alias(text_col), "ids", "n_pieces")


def decode(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, decoded, *keep): the text of each list of ids; a null list decodes to the empty string."""
    model = model or common.tokenizer_path(MODEL)
    cols = [F.col(id_col).alias("k"), F.col(ids_col).alias("i"), *(F.col(c).alias(f"c{n}") for n, c in enumerate(keep))]
    rows = rows.select(*cols)
    schema = f"k {rows.schema['k'].dataType.simpleString()}, decoded string" + "".join(f", c{n} {rows.schema[f'c{n}'].dataType.simpleString()}" for n in range(len(keep)))

    @common.trimmed
    def run(frames):
        m = lattices(model, 1.0)
        for f in frames:
            ids = f.column(1)
            flat, at = ids.values.to_numpy(), ids.offsets.to_numpy()
            text = [m.decode(flat[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([f.column(0), pa.array(text, pa.string()), *f.columns[2:]], names=["k", "decoded", *(f"c{n}" for n in range(len(keep)))])

    out = rows.mapInArrow(run, schema)
    return out.select(F.col("k").alias(id_col), "decoded", *(F.col(f"c{n}").alias(c) for n, c in enumerate(keep)))


def op1_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled ids of every whole text, and whether decoding them gives the text back."""
    coded = encode_sampled(common.table(spark, sf_dir, "documents"))
    back = decode(coded, keep=("text", "ids", "n_pieces"))
    return back.select("doc_id", "ids", "n_pieces", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"))

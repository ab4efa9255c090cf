"""Operator 4: token counts by rank-synchronous merging of ragged numpy arrays.

A text is cut into pre-tokens at places that no merge can cross: before a run of blanks, and around line
feeds where the vocabulary has none. The distinct pre-tokens of a batch are held as one ragged array of
symbols. Each step finds, for all sequences at once, the sequence's pair of lowest rank, merges every place
where a pair of that rank stands (from the left, without overlaps), and drops sequences without a mergeable
pair. A merge that would make a pair of no higher rank beside it is a sequence's last of its step, so that the
order is the library's. The surviving symbols are counted; a character outside the vocabulary counts its UTF-8
bytes (byte fallback). Sequences go through the arrays in groups of like length and of at most GROUP symbols
(or one longer sequence), whatever their length.

Nulls and empty texts have 0 tokens. Repeated rows give repeated rows. Columns other than the two named
are not read, so their names can't clash. Memory: one batch of texts and a table of at most CACHE counts.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common, kernels

MODEL = "piece_bpe_32k.model"
OVER = 4096
#: Counts kept for pre-tokens of at most KEPT characters; the table is emptied when full. It changes speed only.
CACHE, KEPT = 400_000, 400
#: Symbols of the sequences that are merged together; it bounds the temporaries.
GROUP = 1 << 18
NONE = np.int64(1) << 62
#: Texts whose counts are compared with the library's when a model is loaded: a model with other rules raises.
PROBES = ("Hello world", " two  blanks ", "a\nb\tc", "1234 ½ é e\u0301 漢字 😀", "<s> ▁x", "aaaa aaaaaaaa")


class RankMerger:
    """Counts of a BPE piece model, from its pieces and scores."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i): model.get_score(i) for i in normal}
        level = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        names = dict.fromkeys(c for p in pieces for c in p) | dict.fromkeys(pieces)
        self.ids = {p: i for i, p in enumerate(names)}
        self.width = len(self.ids)
        self.symbol = np.full(0x110000, -1, dtype=np.int32)
        self.weight = np.repeat(np.array([1, 2, 3, 4], dtype=np.int8), [0x80, 0x800 - 0x80, 0x10000 - 0x800, 0x100000])
        for p, i in self.ids.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
                if p in pieces:
                    self.weight[ord(p)] = 1
        self.pairs: dict[int, tuple[int, int]] = {}
        for p, score in pieces.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    self.pairs[a * self.width + b] = (level[score], self.ids[p])
        self.keys = np.array(sorted(self.pairs), dtype=np.int64)
        self.rank = np.array([self.pairs[k][0] for k in self.keys.tolist()], dtype=np.int64)
        self.into = np.array([self.pairs[k][1] for k in self.keys.tolist()], dtype=np.int32)
        inside = {c for p in pieces if len(p) > 1 for c in p}
        assert all("▁" not in p.lstrip("▁") for p in pieces), "a piece has a blank inside"
        self.cut = re.compile("▁*[^▁\n]+|▁+|\n" if "\n" not in inside else "▁*[^▁]+|▁+")
        self.known: dict[str, int] = {}
        for probe in PROBES:
            if self.counts([probe]) != [len(model.encode(probe))]:
                raise ValueError(f"{path} cuts texts in another way than this module")

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.rank[at], NONE), self.into[at]

    def merged(self, seqs: list[str]) -> np.ndarray:
        """Numbers of symbols that survive in each of the sequences."""
        code = np.frombuffer("".join(seqs).encode("utf-32-le"), dtype="<u4")
        length = np.fromiter(map(len, seqs), dtype=np.int64, count=len(seqs))
        sym, weight = self.symbol[code], self.weight[code].astype(np.int64)
        out = np.zeros(len(seqs), dtype=np.int64)
        live, seq = np.arange(len(seqs)), np.repeat(np.arange(len(seqs)), length)
        rank, into = np.full(len(sym), NONE), np.zeros(len(sym), dtype=np.int32)
        inner = np.flatnonzero(seq[:-1] == seq[1:])
        rank[inner], into[inner] = self.ranks(sym[inner], sym[inner + 1])
        while len(live):
            first = kernels.runs(seq)
            low = np.minimum.reduceat(rank, first)
            size = np.diff(first, append=len(seq))
            done = low >= NONE
            if done.any():
                out[live[done]] = np.add.reduceat(weight, first)[done]
                keep = np.repeat(~done, size)
                live = live[~done]
                sym, weight, rank, into = sym[keep], weight[keep], rank[keep], into[keep]
                seq = np.repeat(np.arange(len(live)), size[~done])
                if not len(live):
                    break
                low, first = low[~done], kernels.runs(seq)
            at = self.together(np.flatnonzero(rank == low[seq]), low, seq, sym, into)
            sym[at], weight[at] = into[at], 1
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            sym, weight, rank, into, seq, at = sym[keep], weight[keep], rank[keep], into[keep], seq[keep], place[at]
            rank[at] = NONE
            for i in (at, at[at > 0] - 1):
                i = i[i + 1 < len(seq)]
                same = seq[i] == seq[i + 1]
                rank[i[~same]] = NONE
                i = i[same]
                rank[i], into[i] = self.ranks(sym[i], sym[i + 1])
        return out

    def together(self, hits: np.ndarray, low: np.ndarray, seq: np.ndarray, sym: np.ndarray, into: np.ndarray) -> np.ndarray:
        """Of the places of lowest rank, those that can be merged in one step as if from left to right."""
        if len(hits) == len(low):
            return hits  # one place in each sequence
        first = np.ones(len(hits), dtype=bool)
        first[1:] = hits[1:] != hits[:-1] + 1
        begin = np.flatnonzero(first)
        hits = hits[(np.arange(len(hits)) - np.repeat(begin, np.diff(begin, append=len(hits)))) % 2 == 0]
        of = seq[hits]
        run = kernels.runs(of)
        times = np.diff(run, append=len(of))
        many = np.repeat(times > 1, times)  # only where a sequence has several places can one be too early
        at, of = hits[many], of[many]
        made = into[at]
        left, right = np.maximum(at - 1, 0), np.minimum(at + 2, len(seq) - 1)
        before = np.where((at > 0) & (seq[left] == of), sym[left], -1)
        near = np.flatnonzero(at[1:] == at[:-1] + 2) + 1  # the symbol before is one that this step has made
        near = near[of[near] == of[near - 1]]
        before[near] = made[near - 1]
        after = np.where((at + 2 < len(seq)) & (seq[right] == of), sym[right], -1)
        stop = np.minimum(self.ranks(before, made)[0], self.ranks(made, after)[0]) <= low[of]
        if not stop.any():
            return hits
        stopped = np.cumsum(stop) - stop
        run = kernels.runs(of)
        keep = np.ones(len(hits), dtype=bool)
        keep[many] = stopped == np.repeat(stopped[run], np.diff(run, append=len(of)))
        return hits[keep]

    def grouped(self, seqs: list[str]):
        """Groups of sequences of like length."""
        seqs = sorted(seqs, key=len)
        a = size = 0
        for i, s in enumerate(seqs):
            if i > a and (size + len(s) > GROUP or len(s) > max(32, 2 * len(seqs[a]))):
                yield seqs[a:i]
                a, size = i, 0
            size += len(s)
        if seqs:
            yield seqs[a:]

    def counts(self, texts: list[str]) -> list[int]:
        cut = [self.cut.findall("▁" + t.replace(" ", "▁")) if t else [] for t in texts]
        if len(self.known) > CACHE:
            self.known.clear()
        new = list(set().union(*cut).difference(self.known))
        for some in self.grouped(new):
            self.known.update(zip(some, self.merged(some).tolist(), strict=True))
        out = [sum(map(self.known.__getitem__, c)) for c in cut]
        for s in new:
            if len(s) > KEPT:
                del self.known[s]
        return out


_mergers: dict[str, RankMerger] = {}


def merger(path: str) -> RankMerger:
    if path not in _mergers:
        _mergers[path] = RankMerger(path)
    return _mergers[path]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, over: int = OVER) -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit) of the documents, in one pass without a shuffle."""
    model = model or common.tokenizer_path(MODEL)

    def run(frames):
        m = merger(model)
        for f in frames:
            texts = [t if isinstance(t, str) else "" for t in f["t"]]
            raw = [t.encode() for t in texts]
            n: list[int] = []
            for a, b in kernels.batches(raw):
                n += m.counts(texts[a:b])
            yield pd.DataFrame({"k": common.texts(f["k"]), "n_bytes": np.array([len(r) for r in raw], dtype=np.int64), "n_tokens": np.array(n, dtype=np.int64)})

    out = docs.select(F.col(id_col).cast("string").alias("k"), F.col(text_col).alias("t")).mapInPandas(run, "k string, n_bytes long, n_tokens long")
    return out.select(F.col("k").cast(docs.schema[id_col].dataType).alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > over).alias("over_limit"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.table(spark, sf_dir, "documents"))

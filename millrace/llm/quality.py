"""Operator 2: a quality classifier by ordinal cumulative-link regression on graded ratings.

A rating is the number of the two judgements in `labels` that a document passes: quality, and not toxic
(grades 0, 1, 2). The model is P(grade <= k) = sigmoid(threshold[k] - score) with ordered thresholds and one
score, a sum of weights of hashed text features shared by all grades: words present, beginnings of words with
how often they occur, and measures of the text's form, each cut into steps and hashed like a word. It gives each document its expected grade and the
probability that its grade is at least KEEP_GRADE.

Fitting uses at most SAMPLE labelled rows, those with the smallest hashes of their ids; this bound is the
parameter `sample`. Scoring reads every whole text. Labels that are null are not used. Null and empty texts
have no features, so their score is 0. Without labels, or with one grade only, every document is kept.
Repeated label rows for a document count once, with the lowest grade; of rows with one id, the one whose
features come first in byte order is fitted. Every row is scored. Only named columns are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common, kernels

SAMPLE = 6000
BITS = 18
#: Feature = level and hash. Level 0: words and steps; others: a beginning of PREFIXES bytes occurs so often.
LEVELS = (1, 2, 4)
PREFIXES = (4, 5, 6, 7, 8)
SIZE = (1 + len(LEVELS)) << BITS
#: Features with weights: those whose presence differs most between grades, and seen in at least MIN_DOCS rows.
FEATURES = 6000
MIN_DOCS = 6
KEEP_GRADE = 2
TAIL = 0.5
U = np.uint64

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"%&$#*!|@~^<>{}[]\\=+_")] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_POINT = np.zeros(256, dtype=bool)
_POINT[list(b".,;:?-'\"()")] = True
STEPS = 24


def features(texts: list[bytes], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs of one batch, each once. wanted: hashes that matter on any level, to leave out others."""
    b = kernels.Bytes(texts)
    n = len(texts)
    letter = _LETTER[b.data]
    edge = np.flatnonzero(np.diff(letter.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, end = edge[0::2], edge[1::2]
    sums = kernels.prefix_sums(kernels.BYTE_CODE[kernels.LOWER[b.data]])
    h = kernels.spans(sums, start, end)
    of = np.searchsorted(b.at, start, side="right") - 1
    words = np.bincount(of, minlength=n)
    size = np.maximum(np.diff(b.at) - 1, 1)
    share = lambda mask: np.add.reduceat(mask.astype(np.int64), b.at[:-1]) / size
    per_word = lambda mask: np.bincount(of, weights=mask, minlength=n) / np.maximum(words, 1)
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    kinds = np.unique(of * 65536 + (h & U(65535)).astype(np.int64)) // 65536
    letters = np.maximum(share(letter), 1e-9)
    shares = [share(_UPPER[b.data]) / letters, share(_SYMBOL[b.data]), share(_DIGIT[b.data]), share(_POINT[b.data]), share(b.data == 10), per_word(again), np.bincount(kinds, minlength=n) / np.maximum(words, 1), letters]
    sizes = [np.log2(words + 1) / 20, per_word((end - start).astype(float)) / 20]
    short = lambda x: (x >> U(64 - BITS)).astype(np.int64)
    text, feature = [of], [short(h)]
    begun, begins = [], []
    for k in PREFIXES:
        long = np.flatnonzero(end - start > k)
        g = short(kernels.mix(kernels.spans(sums, start[long], start[long] + k) + U(k)))
        if wanted is not None:
            keep = wanted[g]
            long, g = long[keep], g[keep]
        begun.append(of[long])
        begins.append(g)
    pair, times = np.unique(np.concatenate(begun) << BITS | np.concatenate(begins), return_counts=True)
    for level, least in enumerate(LEVELS, 1):
        p = pair[times >= least]
        text.append(p >> BITS)
        feature.append((p & ((1 << BITS) - 1)) + (level << BITS))
    has = np.flatnonzero(words > 0)
    for k, x in enumerate([*(np.sqrt(np.clip(s, 0, 1)) for s in shares), *(np.clip(s, 0, 1) for s in sizes)]):
        step = np.minimum((x * STEPS).astype(np.int64), STEPS - 1)[has]
        for near in (0, 1):  # two overlapping grids of steps
            code = kernels.mix((np.int64(k * 1000 + 500 * near) + (step + near) // (1 + near)).astype(U) + U(1 << 40))
            text.append(has)
            feature.append(short(code))
    text, feature = np.concatenate(text), np.concatenate(feature)
    if wanted is not None:
        keep = wanted[feature & ((1 << BITS) - 1)]
        text, feature = text[keep], feature[keep]
    pair = np.unique(text * SIZE + feature)
    return pair // SIZE, pair % SIZE


def fit(rows: list[np.ndarray], grade: np.ndarray, top: int, rounds: int = 250, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (SIZE) and thresholds (top) for grades 0 .. top."""
    w = np.zeros(SIZE)
    if not len(grade) or len(np.unique(grade)) < 2:
        return w, np.full(top, -np.inf)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    x = np.concatenate(rows)
    df = np.bincount(x, minlength=SIZE)
    mean = grade.mean()
    pull = np.bincount(x, weights=(grade - mean)[of], minlength=SIZE)
    z = np.abs(pull) / np.sqrt(np.maximum(df * (1 - df / len(grade)), 1e-9) * max(grade.var(), 1e-9))
    z[df < min(MIN_DOCS, max(1, len(grade) // 20))] = 0
    chosen = np.sort(np.argsort(-z, kind="stable")[:FEATURES])
    chosen = chosen[z[chosen] > 0]
    place = np.full(SIZE, -1)
    place[chosen] = np.arange(len(chosen))
    use = place[x] >= 0
    of, x = of[use], place[x[use]]
    v = np.zeros(len(chosen))
    share = np.clip([(grade <= k).mean() for k in range(top)], 1e-3, 1 - 1e-3)
    cut = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(top))
    gap = np.concatenate([cut[:1], np.log(np.maximum(np.diff(cut), 1e-3))])
    par = np.concatenate([v, gap])
    m = s = np.zeros_like(par)
    n, d = len(grade), len(chosen)
    sig = lambda a: 1 / (1 + np.exp(-np.clip(a, -40, 40)))
    for t in range(1, rounds + 1):
        v, gap = par[:d], par[d:]
        cut = gap[0] + np.concatenate([[0], np.cumsum(np.exp(gap[1:]))])
        score = np.bincount(of, weights=v[x], minlength=n)
        edges = np.concatenate([[-np.inf], cut, [np.inf]])
        hi, lo = sig(edges[grade + 1] - score), sig(edges[grade] - score)
        hi[grade == top], lo[grade == 0] = 1.0, 0.0
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        g_score = (dhi - dlo) / n
        g_cut = np.array([-(dhi[grade == k].sum() - dlo[grade == k + 1].sum()) / n for k in range(top)])
        g_gap = np.array([g_cut.sum(), *(np.exp(gap[k]) * g_cut[k:].sum() for k in range(1, top))])
        g = np.concatenate([np.bincount(x, weights=g_score[of], minlength=d) + l2 * v, g_gap])
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        par = par - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    w[chosen] = par[:d]
    gap = par[d:]
    return w, gap[0] + np.concatenate([[0], np.cumsum(np.exp(gap[1:]))])


def _grade():
    return (F.col("quality") + (1 - F.col("toxic"))).cast("int")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Fit on at most `sample` labelled documents; their features, not their texts, come to the driver.

    Rows that repeat an id count once, so that no more than `sample` rows are collected, however often an id is there.
    """
    rated = labels.select(F.col(id_col).alias("k"), _grade().alias("g")).where("k IS NOT NULL AND g BETWEEN 0 AND 2").groupBy("k").agg(F.min("g").alias("g"))
    rated = rated.orderBy(F.xxhash64("k"), "k").limit(sample)
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).join(F.broadcast(rated), "k").select("k", "g", "t")

    def run(frames):
        for f in frames:
            raw = kernels.utf8(f["t"])
            for a, b in kernels.batches(raw):
                text, feature = features(raw[a:b])
                cut = np.searchsorted(text, np.arange(b - a + 1))
                yield pd.DataFrame({"k": f["k"][a:b], "g": f["g"][a:b], "x": [feature[cut[i] : cut[i + 1]].astype(np.int32).tobytes() for i in range(b - a)]})

    kind = docs.schema[id_col].dataType.simpleString()
    seen = rows.select(F.col("k").cast("string"), "g", "t").mapInPandas(run, "k string, g int, x binary")
    one = seen.groupBy("k").agg(F.min("g").alias("g"), F.min("x").alias("x"))  # combined by each task first
    key = (lambda r: r["k"]) if kind == "string" else (lambda r: (len(r["k"]), r["k"]))
    got = sorted(one.collect(), key=key)
    return fit([np.frombuffer(r["x"], dtype=np.int32) for r in got], np.array([r["g"] for r in got], dtype=int), 2)


def grade_probabilities(score: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """P(grade >= k) for k = 1 .. top, one column each."""
    return 1 / (1 + np.exp(np.clip(cut[None, :] - score[:, None], -700, 700)))


def scorer(weights: np.ndarray, cut: np.ndarray):
    """Column function text -> struct<expected_grade, tail_probability>."""
    nonzero = weights != 0
    wanted = nonzero.reshape(-1, 1 << BITS).any(axis=0)

    @F.pandas_udf("expected_grade double, tail_probability double")
    def score(text: pd.Series) -> pd.DataFrame:
        raw, out = kernels.utf8(text), []
        for a, b in kernels.batches(raw):
            of, feature = features(raw[a:b], wanted)
            use = nonzero[feature]
            out.append(np.bincount(of[use], weights=weights[feature[use]], minlength=b - a))
        tail = grade_probabilities(np.concatenate(out) if out else np.zeros(0), cut)
        return pd.DataFrame({"expected_grade": tail.sum(axis=1), "tail_probability": tail[:, KEEP_GRADE - 1]})

    return score


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, tail: float = TAIL) -> DataFrame:
    """Rows (id, expected_grade, tail_probability, selected), one for each document."""
    score = scorer(*train(docs, labels, id_col, text_col, sample))
    out = docs.select(F.col(id_col), score(F.col(text_col)).alias("s"))
    return out.select(id_col, "s.expected_grade", "s.tail_probability", (F.col("s.tail_probability") >= tail).alias("selected"))


def keep_selected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, tail: float = TAIL) -> DataFrame:
    """The documents that the classifier selects, with all their columns."""
    score = scorer(*train(docs, labels, id_col, text_col, sample))
    return docs.where(score(F.col(text_col))["tail_probability"] >= tail)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))

"""Operator 10: substring dedup over words with fixed-block anchors.

Every document is a reference: its non-overlapping blocks of BLOCK words, at fixed places, are indexed. Every
document's rolling windows of BLOCK words probe the index. A run of WINDOW = 2 * BLOCK words that two documents
share holds a whole block of either one, so it has a hit in both. Blocks and probes are keyed by the least
hash of the GRAM-word grams in them: neighbouring probes have the same key and travel once, and equal blocks
have equal keys. Around hits, and only there, windows of WINDOW words are compared by two 64-bit hashes: those
that start in a document with a smaller id too are removed. Overlapping windows make the maximal exact repeats.

Words are [^\\x20\\x09-\\x0D]+ of the whole text, unchanged. Null and empty texts have none. Repeated rows have
equal ids, so neither is smaller and both stay. A row without id is larger than all others. Ids are whole numbers
or texts that stand for such. Only the two named columns are read, unless the documents themselves are asked for;
then their other columns pass through as they are, whatever their names.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common, kernels, windows

WINDOW, BLOCK, GRAM = 50, 25, 8
PROBE = np.dtype([("m", "<u8"), ("key", "<i8"), ("ref", "<i8")])
HIT = np.dtype([("key", "<i8"), ("m", "<u8")])
U = np.uint64


def _block_keys(w: kernels.Words) -> np.ndarray:
    """Key of the block of BLOCK words at each word; blocks that leave their text are the caller's to mask."""
    return kernels.sliding_min(kernels.rolling(w.hash, GRAM), BLOCK - GRAM + 1)


def _key(id_col: str, text_col: str):
    """A row's key. Rows too short to hold a window are in no group, however many are alike."""
    short = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) < 2 * WINDOW - 1
    return F.when(short, F.xxhash64(F.monotonically_increasing_id(), F.lit("short"))).otherwise(F.xxhash64(F.col(id_col), F.col(text_col)))


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(windows.NO_ID))).alias("id"), _key(id_col, text_col).alias("key"), F.col(text_col).alias("t"))


def _hits(base: DataFrame) -> DataFrame:
    """Rows (key, hits): the block keys that a row shares with another one's index."""
    n = common.parts(base.sparkSession)

    @common.trimmed
    def probe(frames):
        for f in frames:
            raw, key = kernels.utf8(f["t"]), f["key"].to_numpy(np.int64)
            for a, b in kernels.batches(raw):
                w = kernels.Words(raw[a:b])
                at, of = w.whole(BLOCK)
                long = np.diff(w.first)[of] >= WINDOW
                at, of = at[long], of[long]
                m = _block_keys(w)[at]
                ref = (at - w.first[:-1][of]) % BLOCK == 0  # a reference block stands here
                order = np.lexsort((~ref, of, m))
                m, of, ref = m[order], of[order], ref[order]
                one = kernels.runs(m, of)  # a row sends a key once, as a reference if it has one there
                m, of, ref = m[one], of[one], ref[one]
                first = kernels.runs(m)
                size = np.diff(first, append=len(m))
                e = np.empty(len(first), dtype=PROBE)
                e["m"], e["key"], e["ref"] = m[first], key[a:b][of[first]], np.maximum.reduceat(ref, first) if len(first) else 0
                yield common.deal(e, kernels.mix(e["m"]), 4 * n)
                many = np.repeat(size > 1, size)  # rows of this batch that meet need no answer
                yield windows.to_rows(_hit(key[a:b][of[many]], m[many]), n)

    @common.trimmed
    def meet(frames):
        got = []
        for f in frames:
            ask = f["bucket"] >= 0
            got += [np.frombuffer(b, dtype=PROBE) for b in f["blob"][ask]]
            if not ask.all():
                yield f[~ask]
        if got:
            e = np.concatenate(got)
            e = e[np.argsort(e["m"], kind="stable")]
            first = kernels.runs(e["m"])
            size = np.diff(first, append=len(e))
            use = np.repeat((size > 1) & (np.maximum.reduceat(e["ref"], first) > 0), size)
            yield windows.to_rows(_hit(e["key"][use], e["m"][use]), n)

    asked = base.select("key", "t").mapInPandas(probe, "bucket int, blob binary")
    answers = windows.dealt(asked).mapInPandas(meet, "bucket int, blob binary")
    return windows.gathered(answers, HIT).select("key", F.col("blob").alias("hits"))


def _hit(key: np.ndarray, m: np.ndarray) -> np.ndarray:
    out = np.empty(len(key), dtype=HIT)
    out["key"], out["m"] = key, m
    return out


def repeats(base: DataFrame) -> DataFrame:
    """Rows (key, found): intervals of words that a document with a smaller id has too."""
    n = common.parts(base.sparkSession)
    near = base.join(common.written(_hits(base), "anchor-hits"), "key", "left")

    @common.trimmed
    def compare(frames):
        for f in frames:
            f = f[f["hits"].notna()]
            if not len(f):
                continue
            raw, key = kernels.utf8(f["t"]), f["key"].to_numpy(np.int64)
            ident = f["id"].to_numpy(np.int64)
            for a, b in kernels.batches(raw):
                w = kernels.Words(raw[a:b])
                at, of = w.whole(BLOCK)
                if not len(at):
                    continue
                lists = [np.frombuffer(h, dtype="<u8") for h in f["hits"].iloc[a:b]]
                salt = lambda i: (i.astype(U) + U(1)) * U(kernels.BASE)
                want = np.unique(np.concatenate(lists) ^ salt(np.repeat(np.arange(b - a), list(map(len, lists)))))
                have = _block_keys(w)[at] ^ salt(of)
                hit = np.zeros(len(w.hash) + WINDOW + 1, dtype=np.int64)
                hit[at] = want[np.minimum(np.searchsorted(want, have), len(want) - 1)] == have
                sums = np.concatenate([[0], np.cumsum(hit)])
                at, of = w.whole(WINDOW)
                near = sums[at + BLOCK + 1] > sums[at]  # a hit starts at one of the window's first BLOCK + 1 words
                at, of = at[near], of[near]
                fp, fp2 = (kernels.rolling(w.hash, WINDOW, k)[at] for k in (0, 1))
                yield from windows.sent(windows.entries(fp, fp2, ident[a:b][of], key[a:b][of], at - w.first[:-1][of]), "smaller", WINDOW, n)

    frames = near.select("id", "key", "t", "hits").mapInPandas(compare, "bucket int, blob binary")
    return windows.gathered(windows.resolve(frames, "smaller", WINDOW), windows.SPAN).select("key", F.col("blob").alias("found"))


def _cut(raw: bytes, found: bytes | None) -> tuple[list[bytes], int, np.ndarray, np.ndarray]:
    """Words of the text that stay, how many there were, and the removed intervals."""
    words = raw.split()
    if not found:
        return words, len(words), np.zeros(0, int), np.zeros(0, int)
    start, end = windows.unpack(found)
    kept, last = [], 0
    for s, e in zip(start.tolist(), end.tolist(), strict=True):
        kept += words[last:s]
        last = e
    return kept + words[last:], len(words), start, end


def dedup_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_words, n_removed, kept text, spans of removed words), one for each document."""
    base = _base(docs, id_col, text_col)
    rows = base.join(repeats(base), "key", "left").select("id", "t", "found")

    def run(frames):
        for f in frames:
            out = []
            for raw, found in zip(kernels.utf8(f["t"]), f["found"], strict=True):
                kept, n, start, end = _cut(raw, found)
                out.append((n, n - len(kept), b" ".join(kept), np.stack([start, end], axis=1).ravel().tolist()))
            g = pd.DataFrame({"id": f["id"], "n_words": [o[0] for o in out], "n_removed": [o[1] for o in out], "kept": common.texts(o[2].decode() for o in out), "spans": [o[3] for o in out]})
            yield g

    out = rows.mapInPandas(run, "id long, n_words long, n_removed long, kept string, spans array<int>")
    return out.withColumn("id", F.nullif("id", F.lit(int(windows.NO_ID)))).withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with repeats taken out of their texts; a text without repeats stays as it is.

    A document of which nothing is left goes; one that had no words stays. A column n_chars follows the text.
    """
    found = repeats(_base(docs, id_col, text_col))

    @F.pandas_udf("string")
    def cut(text: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for t, blob in zip(text, found, strict=True):
            if not isinstance(t, str) or not blob:
                out.append(t if isinstance(t, str) else None)
            else:
                out.append(b" ".join(_cut(t.encode(), blob)[0]).decode())
        return common.texts(out)

    # The documents' own columns travel as one struct, so that no name of theirs can meet one of ours.
    base = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), _key(id_col, text_col).alias("key"))
    text = F.col("doc")[text_col]
    rows = base.join(found, "key", "left").select("doc", "found", F.when(F.col("found").isNull(), text).otherwise(cut(text, F.col("found"))).alias("kept"))
    rows = rows.where("found IS NULL OR kept <> ''")
    new = {text_col: F.col("kept")} | ({"n_chars": F.when(F.col("found").isNull(), F.col("doc")["n_chars"]).otherwise(F.length("kept").cast("long"))} if "n_chars" in docs.columns else {})
    return rows.select(*(new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns))


def op10_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_words(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


#: Every window of 50 words beside the smallest id that has it; a word goes if one of the 50 windows over it does.
ORACLE_OP10 = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) < doc_id AS hit FROM s),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT x.doc_id, x.word, x.i, coalesce(max(CASE WHEN f.hit THEN 1 ELSE 0 END) OVER (PARTITION BY x.doc_id ORDER BY x.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM x LEFT JOIN f ON f.doc_id = x.doc_id AND f.i = x.i),
k AS (SELECT doc_id, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM g GROUP BY doc_id)
SELECT w.doc_id, len(w.w) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""

"""Fixed-width windows that occur elsewhere, found by their hashes without any group of equal ones in one task.

An entry is (two hashes, id, key of the row, place); windows are equal if both hashes of 64 bits are. Each batch first decides what it can by itself and sends, of
equal windows, as few as the rest need; a window that stands in a third of all rows arrives as a few entries
from each task. Rules:

- "twice": a window counts that starts at any other place. A batch that holds it twice knows, and sends one
  entry with count 2 (in the field id).
- "smaller": a window counts that also starts in a row with a smaller id. A batch sends those of its smallest
  id; for all others it knows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from millrace.llm import common, kernels

ENTRY = np.dtype([("fp", "<u8"), ("fp2", "<u8"), ("id", "<i8"), ("key", "<i8"), ("pos", "<i4")])
FOUND = np.dtype([("start", "<i4"), ("end", "<i4")])
SPAN = np.dtype([("key", "<i8"), ("start", "<i4"), ("end", "<i4"), ("kind", "<i4")])
NO_ID = np.int64(2**63 - 1)


def entries(fp: np.ndarray, fp2: np.ndarray, ident: np.ndarray, key: np.ndarray, pos: np.ndarray) -> np.ndarray:
    out = np.empty(len(fp), dtype=ENTRY)
    out["fp"], out["fp2"], out["id"], out["key"], out["pos"] = fp, fp2, ident, key, pos
    return out


def _grouped(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    e = e[np.lexsort((e["pos"], e["key"], e["id"], e["fp2"], e["fp"]))]
    first = kernels.runs(e["fp"], e["fp2"])
    return e, first, np.repeat(np.arange(len(first)), np.diff(first, append=len(e)))


def in_batch(e: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """What must be sent, and what is already known to count."""
    if not len(e):
        return e, e
    e, first, group = _grouped(e)
    if rule == "smaller":
        known = e["id"] > e["id"][first][group]
        send, known = e[~known], e[known]
        return send[kernels.runs(*(send[c] for c in ENTRY.names))], known  # of repeated rows one entry
    many = np.diff(first, append=len(e)) > 1
    send = e[first].copy()
    send["id"] = np.where(many, 2, send["id"])
    return send, e[many[group]]


def decided(e: np.ndarray, rule: str) -> np.ndarray:
    """Of all entries of some hashes, those that count."""
    if not len(e):
        return e
    e, first, group = _grouped(e)
    if rule == "smaller":
        return e[e["id"] > e["id"][first][group]]
    return e[(np.add.reduceat(e["id"], first) > 1)[group]]


def spans_of(e: np.ndarray, width: int) -> np.ndarray:
    """What the windows that count cover in their rows, as disjoint intervals."""
    e = e[np.lexsort((e["pos"], e["key"]))]
    pos = e["pos"].astype(np.int64)
    new = np.ones(len(e), dtype=bool)
    new[1:] = (e["key"][1:] != e["key"][:-1]) | (pos[1:] > pos[:-1] + width)
    first = np.flatnonzero(new)
    return answers(e["key"][first], pos[first], pos[kernels.stops(first, len(e)) - 1] + width, 0)


def answers(key: np.ndarray, start: np.ndarray, end: np.ndarray, kind: int) -> np.ndarray:
    out = np.empty(len(key), dtype=SPAN)
    out["key"], out["start"], out["end"], out["kind"] = key, start, end, kind
    return out


def to_rows(e: np.ndarray, n: int) -> pd.DataFrame:
    """Answers on their way: one blob for each of n targets, however many rows they are for (bucket < 0)."""
    f = common.deal(e, kernels.mix(e["key"].view(np.uint64)), n)
    f["bucket"] = -1 - f["bucket"]
    return f


def dealt(frames: DataFrame) -> DataFrame:
    return common.to_buckets(frames)


def gathered(frames: DataFrame, dtype: np.dtype) -> DataFrame:
    """Rows (key, kind, blob): each row's answers in one place. dtype: key, payload ..., and kind if it has one."""
    payload = [c for c in dtype.names if c not in ("key", "kind")]

    @common.trimmed
    def run(parts):
        got = [np.frombuffer(b, dtype=dtype) for f in parts for b in f["blob"]]
        if not got:
            return
        e = np.concatenate(got)
        del got
        kind = e["kind"] if "kind" in dtype.names else np.zeros(len(e), np.int32)
        order = np.lexsort((kind, e["key"]))
        e, kind = e[order], kind[order]
        first = kernels.runs(e["key"], kind)
        rest = np.empty(len(e), dtype=[(c, dtype[c]) for c in payload])
        for c in payload:
            rest[c] = e[c]
        stop = kernels.stops(first, len(e))
        for a in range(0, len(first), 10_000):
            yield pd.DataFrame({"key": e["key"][first[a : a + 10_000]], "kind": kind[first[a : a + 10_000]], "blob": [rest[x:y].tobytes() for x, y in zip(first[a : a + 10_000], stop[a : a + 10_000], strict=True)]})

    return dealt(frames).mapInPandas(run, "key long, kind int, blob binary")


def unpack(blob: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Union of a row's intervals."""
    x = np.frombuffer(blob or b"", dtype=FOUND)
    return kernels.union(x["start"].astype(np.int64), x["end"].astype(np.int64))


def sent(e: np.ndarray, rule: str, width: int, n: int):
    """Frames (bucket, blob): bucket >= 0 with entries that need an answer, < 0 with answers."""
    send, known = in_batch(e, rule)
    if len(send):
        yield common.deal(send, kernels.mix(send["fp"]), 4 * n)
    if len(known):
        yield to_rows(spans_of(known, width), n)


def resolve(frames: DataFrame, rule: str, width: int) -> DataFrame:
    """Frames of answers only (bucket, blob) from the frames that tasks have sent."""
    n = common.parts(frames.sparkSession)

    @common.trimmed
    def run(parts):
        got = []
        for f in parts:
            ask = f["bucket"] >= 0
            got += [np.frombuffer(b, dtype=ENTRY) for b in f["blob"][ask]]
            if not ask.all():
                yield f[~ask]
        if got:
            e = np.concatenate(got)
            del got
            yield to_rows(spans_of(decided(e, rule), width), n)

    return dealt(frames).mapInPandas(run, "bucket int, blob binary")

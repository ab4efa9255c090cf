"""Operator 3: repeated byte strings by prefix-free parsing.

Triggers of a rolling hash over TRIGGER bytes parse every text: a window of WIDTH bytes belongs to the trigger of
least hash in it (the first of them), and a phrase is what consecutive windows of one trigger cover. Triggers
depend on the bytes near them alone, so equal stretches of text are parsed alike, and equal windows have equal
triggers at equal places. The dictionary holds the distinct phrases of each trigger with their counts: all windows
of a phrase that occurs again are repeats, and a trigger with one phrase has no others.

Phrases that share a trigger but are not equal meet as bytes, in ranges of triggers. A window there is a suffix of
a phrase's part before the trigger, followed by a prefix of what comes from the trigger on. So two suffix arrays
are built: one of the dictionary (the parts before triggers, from the trigger backward, with all their suffixes by
their common lengths), and one of the parse (what follows triggers). A window's rank in the first, at its length
before the trigger, and its rank in the second, at the rest of WIDTH, combine into its place in corpus order within
the range; windows whose neighbour in that order is as far as WIDTH bytes the same are repeats. All of this
compares bytes, not hashes.

A trigger of more than HOT phrases, or of more than SEEN in one batch, is hot: such a batch sends one entry for it,
so no task gets all its phrases. Hot triggers are known to all tasks by a set of bits of fixed size. Their phrases
are cut by further bytes: a piece holds the windows whose trigger lies STEP * k to STEP * k + STEP - 1 bytes behind
their start, and pieces are dealt by their common core (the bytes that all windows of such a piece hold). Pieces
whose core occurs once have no repeats, pieces that occur again whole are repeats, and of the few that are left the
windows are dealt one by one. There, and between whole phrases, two hashes of 64 bits each decide what is equal.

A window counts if it starts anywhere else, in the same text included; every byte it covers is removed, in
all copies. Texts are UTF-8 bytes, null is empty, and no window leaves its text. Repeated rows are copies. An empty
table gives an empty result. Only the two named columns are read, so other names can't clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common, kernels, windows

WIDTH, TRIGGER = 400, 16
#: A phrase of more windows (a text that repeats itself) is cut; this changes the work, not the result.
LONGEST = 512
STEP = 32
#: Phrases of a trigger that meet as bytes; more are cut further. SEEN: in one batch. CHUNK: bytes sorted at once.
HOT, SEEN, CHUNK = 64, 8, 2 << 20
PHRASE = np.dtype([("m", "<u8"), ("phrase", "<u8"), ("phrase2", "<u8"), ("key", "<i8"), ("start", "<i4"), ("n", "<i4"), ("count", "<i4"), ("mixed", "<i4")])
#: A phrase's windows that have one trigger in one place: `o` bytes stand before the trigger in the first of them.
ITEM = np.dtype([("m", "<u8"), ("key", "<i8"), ("start", "<i4"), ("n", "<i4"), ("o", "<i4"), ("bytes", "<i4")])
U = np.uint64


class Parse:
    """Triggers of a batch. at, of: windows and their texts; m: their triggers' hashes; chosen: places of triggers."""

    def __init__(self, b: kernels.Bytes):
        self.b, self.codes = b, b.codes()
        self.at, self.of = b.whole(WIDTH)
        self.grams, self.reach = kernels.rolling(self.codes, TRIGGER), WIDTH - TRIGGER + 1
        m = kernels.sliding_min(self.grams, self.reach)
        top = np.zeros(len(self.grams) + self.reach - 1, dtype=U)
        top[self.reach - 1 + self.at] = m[self.at]
        self.m = m[self.at]
        self.chosen = np.flatnonzero(~kernels.sliding_min(~top, self.reach) == self.grams) if len(self.at) else self.at

    def phrases(self) -> tuple[np.ndarray, ...]:
        """Trigger, two phrase hashes, text, first window (in the text), number of windows, and whether the trigger
        occurs in the phrase more than once, so that windows of the phrase may be equal."""
        first = kernels.runs(self.m, self.of)
        size = np.diff(first, append=len(self.m))
        pieces = -(-size // LONGEST)
        step = kernels.ranges(np.zeros(len(first), np.int64), pieces) * LONGEST
        first = np.repeat(first, pieces) + step
        size = np.minimum(np.repeat(size, pieces) - step, LONGEST)
        start, of, m = self.at[first], self.of[first], self.m[first]
        phrase, phrase2 = (kernels.spans(kernels.prefix_sums(self.codes, k), start, start + size - 1 + WIDTH, k) for k in (0, 1))
        low = np.searchsorted(self.chosen, start)
        many = np.searchsorted(self.chosen, start + size + self.reach - 1) - low
        same = self.grams[self.chosen[kernels.ranges(low, many)]] == np.repeat(m, many)
        times = np.bincount(np.repeat(np.arange(len(m)), many)[same], minlength=len(m))
        return m, kernels.mix(phrase ^ kernels.mix(size.astype(U))), phrase2, of, start - self.b.at[:-1][of], size, times > 1

    def located(self, of: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the windows start .. start + size of texts: place, trigger's hash, text, run of one trigger, and the trigger's place."""
        first = np.concatenate([[0], np.cumsum(np.maximum(np.diff(self.b.at) - 1 - WIDTH + 1, 0))])[:-1]  # of each text, among all windows
        w = kernels.ranges(first[of] + start, size)
        at, m, text = self.at[w], self.m[w], self.of[w]
        run = kernels.runs(m, text, np.cumsum(np.diff(w, prepend=-2) != 1))
        n = np.diff(run, append=len(w))
        low = np.searchsorted(self.chosen, at[run])
        many = np.searchsorted(self.chosen, at[run] + n + self.reach - 1) - low
        place, owner = self.chosen[kernels.ranges(low, many)], np.repeat(np.arange(len(run)), many)
        own = self.grams[place] == m[run][owner]
        place, owner = place[own], owner[own]
        mine = np.repeat(np.arange(len(run)), n)
        return at, m, text, mine, place[np.searchsorted(owner << 32 | place, mine << 32 | at)]  # the first one in the window

    def items(self, key: np.ndarray, of: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items of the windows, and where their bytes begin."""
        at, m, text, mine, trigger = self.located(of, start, size)
        head = kernels.runs(mine, trigger)
        e = np.empty(len(head), dtype=ITEM)
        e["m"], e["key"], e["start"], e["n"], e["o"] = m[head], key[text[head]], at[head] - self.b.at[:-1][text[head]], np.diff(head, append=len(at)), trigger[head] - at[head]
        e["bytes"] = e["n"] - 1 + WIDTH
        return e, at[head]

    def pieces(self, of: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Core hash, two hashes of the whole, text, first window and number of windows of the pieces of some windows of a text."""
        at, _, text, mine, trigger = self.located(of, start, size)
        k = (trigger - at) // STEP
        head = kernels.runs(mine, trigger, k)
        n = np.diff(head, append=len(at))
        sums, a = kernels.prefix_sums(self.codes), at[head]
        last = trigger[head] - STEP * k[head]  # where the piece's last window would start
        core = kernels.mix(kernels.spans(sums, last, last - STEP + 1 + WIDTH) ^ kernels.mix(k[head].astype(U)))
        whole = kernels.mix(kernels.spans(sums, a, a + n - 1 + WIDTH) ^ kernels.mix(((last - a) << 8 | n).astype(U)))
        whole2 = kernels.spans(kernels.prefix_sums(self.codes, 1), a, a + n - 1 + WIDTH, 1)
        return core, whole, whole2, text[head], a - self.b.at[:-1][text[head]], n


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    # Rows too short to hold a window are in no group, however many are alike.
    short = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) < WIDTH
    key = F.when(short, F.xxhash64(F.monotonically_increasing_id(), F.lit("short"))).otherwise(F.xxhash64(F.col(id_col), F.col(text_col)))
    return docs.select(F.col(id_col).cast("string").alias("id"), key.alias("key"), F.col(text_col).alias("t"))


def _distinct(m, phrase, phrase2, key, start, size, inner) -> tuple[np.ndarray, np.ndarray]:
    """A batch's phrases, or pieces: one of each kind in order of m, and all that occur again."""
    e = np.empty(len(m), dtype=PHRASE)
    e["m"], e["phrase"], e["phrase2"], e["key"], e["start"], e["n"], e["count"], e["mixed"] = m, phrase, phrase2, key, start, size, 1, inner
    e = e[np.lexsort((e["phrase2"], e["phrase"], e["m"]))]
    first = kernels.runs(e["m"], e["phrase"], e["phrase2"])
    times = np.diff(first, append=len(e))
    one = e[first].copy()
    one["count"] = np.minimum(times, 2)
    return one, e[np.repeat(times > 1, times)]


def _covered(e: np.ndarray) -> np.ndarray:
    """Bytes of what occurs again."""
    return windows.answers(e["key"], e["start"], e["start"] + e["n"] - 1 + WIDTH, 0)


def _asks(e: np.ndarray, kind: int) -> np.ndarray:
    """Windows that must be compared."""
    return windows.answers(e["key"], e["start"], e["start"] + e["n"], kind)


def _by_kind(e: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted entries: starts of kinds, places of those that occur again, starts of each m, kinds of each m."""
    e = e[np.lexsort((e["phrase2"], e["phrase"], e["m"]))]
    first = kernels.runs(e["m"], e["phrase"], e["phrase2"])
    times = np.diff(first, append=len(e))
    head = np.zeros(len(e), dtype=bool)
    head[first] = True
    of = kernels.runs(e["m"])
    return e, head, np.repeat(np.add.reduceat(e["count"], first) > 1, times), of, np.add.reduceat(head.astype(np.int64), of)


def dictionary(base: DataFrame) -> DataFrame:
    """Rows (blob, known) of batches of texts: the distinct phrases, and what a batch knows to occur again."""

    @common.trimmed
    def cut(frames):
        for f in frames:
            raw, key = kernels.utf8(f["t"]), f["key"].to_numpy(np.int64)
            for a, b in kernels.batches(raw):
                m, phrase, phrase2, of, start, size, inner = Parse(kernels.Bytes(raw[a:b])).phrases()
                one, again = _distinct(m, phrase, phrase2, key[a:b][of], start, size, inner)
                yield pd.DataFrame({"blob": [one.tobytes()], "known": [_covered(again).tobytes()]})

    return common.written(base.select("key", "t").mapInPandas(cut, "blob binary, known binary"), "phrases")


def _met(phrases: DataFrame) -> DataFrame:
    """Frames (bucket, blob) of answers: bytes that occur again (kind 0), phrases to compare (kind 1); and the bits of hot triggers."""
    n = common.parts(phrases.sparkSession)

    @common.trimmed
    def deal(frames):
        for f in frames:
            for blob, known in zip(f["blob"], f["known"], strict=True):
                yield windows.to_rows(np.frombuffer(known, dtype=windows.SPAN), n)
                e = np.frombuffer(blob, dtype=PHRASE)
                first = kernels.runs(e["m"])
                size = np.diff(first, append=len(e))
                many = e[first[size > SEEN]].copy()
                many["n"] = 0  # stands for more than SEEN phrases
                e = np.concatenate([e[np.repeat(size <= SEEN, size)], many])
                yield common.deal(e, kernels.mix(e["m"]), 4 * n)

    @common.trimmed
    def meet(frames):
        got = []
        for f in frames:
            ask = f["bucket"] >= 0
            got += [np.frombuffer(b, dtype=PHRASE) for b in f["blob"][ask]]
            if not ask.all():
                yield f[~ask].assign(bit=pd.array([None] * int((~ask).sum()), dtype="Int64"))
        if not got:
            return
        e = np.concatenate(got)
        del got
        marked = np.unique(e["m"][e["n"] == 0])
        e, head, again, of, kinds = _by_kind(e[e["n"] > 0]) if (e["n"] > 0).any() else (e[:0], np.zeros(0, bool), np.zeros(0, bool), np.zeros(0, int), np.zeros(0, int))
        hot = (kinds > HOT) | np.isin(e["m"][of], marked)
        bits = common.bit_of(np.unique(np.concatenate([marked, e["m"][of][hot]])))
        yield pd.DataFrame({"bucket": pd.array([None] * len(bits), dtype="Int32"), "blob": None, "bit": pd.array(bits, dtype="Int64")})
        if len(e):
            mixed = np.maximum.reduceat(e["mixed"], of)
            some = np.repeat(~hot & ((kinds > 1) | (mixed > 0)), np.diff(of, append=len(e)))
            out = windows.to_rows(np.concatenate([_covered(e[again]), _asks(e[some & head], 1)]), n)
            yield out.assign(bit=pd.array([None] * len(out), dtype="Int64"))

    return common.written(common.to_buckets(phrases.mapInPandas(deal, "bucket int, blob binary")).mapInPandas(meet, "bucket int, blob binary, bit long"), "phrase-answers")


def _hot(phrases: DataFrame, bits: np.ndarray) -> DataFrame:
    """Frames of the phrases of hot triggers, to be cut (kind 2)."""
    n, sent = common.parts(phrases.sparkSession), phrases.sparkSession.sparkContext.broadcast(bits)

    def ask(frames):
        for f in frames:
            for blob in f["blob"]:
                e = np.frombuffer(blob, dtype=PHRASE)
                yield windows.to_rows(_asks(e[common.in_set(sent.value, e["m"])], 2), n)

    return phrases.mapInPandas(ask, "bucket int, blob binary")


def _asked(base: DataFrame, answers: DataFrame, kind: int, work) -> DataFrame:
    """Frames of work(texts, keys, texts of windows, first windows, numbers) for the rows that have windows to compare."""
    rows = base.join(answers.where(f"kind = {kind}").select("key", F.col("blob").alias("ask")), "key", "left").select("id", "key", "t", "ask")  # alike in all joins: the texts are dealt once

    @common.trimmed
    def run(frames):
        for f in frames:
            f = f[f["ask"].notna()]
            raw, key = kernels.utf8(f["t"]), f["key"].to_numpy(np.int64)
            for a, b in kernels.batches(raw):
                got = [windows.unpack(x) for x in f["ask"].iloc[a:b]]
                of = np.repeat(np.arange(b - a), [len(g[0]) for g in got])
                start = np.concatenate([g[0] for g in got])
                yield from work(kernels.Bytes(raw[a:b]), key[a:b], of, start, np.concatenate([g[1] for g in got]) - start)

    return rows.mapInPandas(run, "bucket int, blob binary")


def _suffix_array(m: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each row in order of m and bytes, and how many bytes each place's row shares with the one before
    (-1 where m differs). rows: bytes, padded to a multiple of 8."""
    order = np.lexsort((*rows.view(">u8").astype(U).T[::-1], m))
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    sorted_rows, sorted_m = rows[order], m[order]
    differ = sorted_rows[1:] != sorted_rows[:-1]
    common_length = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    common_length[sorted_m[1:] != sorted_m[:-1]] = -1
    return place, np.concatenate([[-1], common_length])


def repeated(e: np.ndarray, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Items, and numbers of their windows, that occur again among all the items' windows. data[first[i]]: an item's bytes."""
    trigger = first + e["o"]
    wide = lambda n: -(-max(int(n), 1) // 8) * 8
    step = np.arange(wide(e["o"].max()))
    left = np.where(step < e["o"][:, None], data[np.maximum(trigger[:, None] - 1 - step, 0)], 0).astype(np.uint8)
    after = e["bytes"] - e["o"]
    step = np.arange(wide(after.max()))
    right = np.where(step < after[:, None], data[np.minimum(trigger[:, None] + step, len(data) - 1)], 0).astype(np.uint8)
    item = np.repeat(np.arange(len(e)), e["n"])
    number = kernels.ranges(np.zeros(len(e), np.int64), e["n"].astype(np.int64))
    before = e["o"][item] - number  # bytes of the window that stand before its trigger

    def rank(rows: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Rank of the first `length` bytes: how many times the bytes up to there have changed in order."""
        place, same = _suffix_array(e["m"], rows)
        new = same[:, None] < np.arange(rows.shape[1] + 1)
        return np.cumsum(new, axis=0, dtype=np.int32)[place[item], length].astype(np.int64)

    n = len(e) + 1
    combined = (before.astype(np.int64) * n + rank(left, before)) * n + rank(right, WIDTH - before)
    order = np.argsort(combined, kind="stable")
    start = kernels.runs(combined[order])
    again = order[np.repeat(np.diff(start, append=len(order)) > 1, np.diff(start, append=len(order)))]
    return item[again], number[again]


def _ordered(items: DataFrame) -> DataFrame:
    """Answers from the suffix arrays of the items, range by range of triggers."""
    n = common.parts(items.sparkSession)

    @common.trimmed
    def run(frames):
        heads, texts = [], []
        for f in frames:
            for blob in f["blob"]:
                k = int.from_bytes(blob[:4], "little")
                heads.append(np.frombuffer(blob, dtype=ITEM, count=k, offset=4))
                texts.append(np.frombuffer(blob, dtype=np.uint8, offset=4 + k * ITEM.itemsize))
        if not heads:
            return
        e, data = np.concatenate(heads), np.concatenate(texts)
        del heads, texts
        size = e["bytes"].astype(np.int64)
        first = np.cumsum(size) - size
        order = np.argsort(e["m"], kind="stable")
        e, first = e[order], first[order]
        group = kernels.runs(e["m"])
        ends = np.cumsum(e["bytes"].astype(np.int64))[kernels.stops(group, len(e)) - 1]
        a = 0
        while a < len(group):  # whole ranges of a few triggers
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK, side="right")))
            some = slice(group[a], group[b] if b < len(group) else len(e))
            item, number = repeated(e[some], data, first[some])
            at = e[some][item]
            yield windows.to_rows(windows.spans_of(windows.entries(at["m"], at["m"], at["key"], at["key"], at["start"] + number), WIDTH), n)
            a = b

    return common.to_buckets(items).mapInPandas(run, "bucket int, blob binary")


def repeats(base: DataFrame) -> DataFrame:
    """Rows (key, found): intervals of bytes that are covered by a repeated window."""
    n = common.parts(base.sparkSession)

    def items(b, key, of, start, size):
        parse = Parse(b)
        e, first = parse.items(key, of, start, size)
        bucket = (kernels.mix(e["m"]) % U(4 * n)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        e, first, bucket = e[order], first[order], bucket[order]
        cut = kernels.runs(bucket)
        out = []
        for x, y in zip(cut, kernels.stops(cut, len(e)), strict=True):
            text = b.data[kernels.ranges(first[x:y], e["bytes"][x:y].astype(np.int64))]
            out.append(int(y - x).to_bytes(4, "little") + e[x:y].tobytes() + text.tobytes())
        yield pd.DataFrame({"bucket": bucket[cut], "blob": out})

    def pieces(b, key, of, start, size):
        core, whole, whole2, text, first, many = Parse(b).pieces(of, start, size)
        one, again = _distinct(core, whole, whole2, key[text], first, many, np.zeros(len(core), np.int32))
        if not len(one):
            return
        first = kernels.runs(one["m"])
        kinds = np.diff(first, append=len(one))
        send = one[first].copy()  # of a core one piece: the others of this batch are compared anyway
        send["mixed"] = kinds > 1
        yield common.deal(send, kernels.mix(send["m"]), 4 * n)
        yield windows.to_rows(np.concatenate([_covered(again), _asks(one[np.repeat(kinds > 1, kinds)], 1)]), n)

    @common.trimmed
    def meet(frames):
        got = []
        for f in frames:
            ask = f["bucket"] >= 0
            got += [np.frombuffer(b, dtype=PHRASE) for b in f["blob"][ask]]
            if not ask.all():
                yield f[~ask]
        if got:
            e, head, again, of, kinds = _by_kind(np.concatenate(got))
            entries = np.diff(of, append=len(e))
            some = np.repeat((kinds > 1) | ((np.maximum.reduceat(e["mixed"], of) > 0) & (entries > 1)), entries)
            yield windows.to_rows(np.concatenate([_covered(e[again]), _asks(e[some & head & (e["mixed"] == 0)], 1)]), n)

    def single(b, key, of, start, size):
        pos, of = kernels.ranges(start, size), np.repeat(of, size)
        at = b.at[:-1][of] + pos
        fp, fp2 = (kernels.spans(kernels.prefix_sums(b.codes(), k), at, at + WIDTH, k) for k in (0, 1))
        return windows.sent(windows.entries(fp, fp2, np.ones(len(fp), np.int64), key[of], pos), "twice", WIDTH, n)

    phrases = dictionary(base)
    met = _met(phrases)
    bits, answers = common.bitset(met.where("bit IS NOT NULL").select("bit")), met.where("bit IS NULL").select("bucket", "blob")
    if bits.any():
        answers = answers.unionByName(_hot(phrases, bits))
    by_phrase = common.written(windows.gathered(answers, windows.SPAN), "phrase-known")
    common.drop_written(phrases)
    common.drop_written(met)
    known = [by_phrase, windows.gathered(_ordered(_asked(base, by_phrase, 1, items)), windows.SPAN)]
    if bits.any():
        by_piece = common.written(windows.gathered(windows.dealt(_asked(base, by_phrase, 2, pieces)).mapInPandas(meet, "bucket int, blob binary"), windows.SPAN), "piece-known")
        known += [by_piece, windows.gathered(windows.resolve(_asked(base, by_piece, 1, single), "twice", WIDTH), windows.SPAN)]
    out = known[0].where("kind = 0")
    for more in known[1:]:
        out = out.unionByName(more.where("kind = 0"))
    return out.groupBy("key").agg(F.collect_list("blob").alias("found"))


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_bytes, n_removed, n_spans, kept, spans): what stays of every text, and what went."""
    base = _base(docs, id_col, text_col)
    rows = base.join(repeats(base), "key", "left").select("id", "t", "found")

    def run(frames):
        for f in frames:
            out = []
            for raw, blobs in zip(kernels.utf8(f["t"]), f["found"], strict=True):
                start, end = windows.unpack(b"".join(blobs) if blobs is not None else None)
                edge = [0, *np.stack([start, end], axis=1).ravel().tolist(), len(raw)]
                kept = b"".join(raw[s:e] for s, e in zip(edge[0::2], edge[1::2], strict=True))
                out.append((len(raw), len(raw) - len(kept), len(start), kept, edge[1:-1]))
            yield pd.DataFrame({"id": common.texts(f["id"]), **{c: [o[i] for o in out] for i, c in enumerate(("n_bytes", "n_removed", "n_spans", "kept", "spans"))}})

    out = rows.mapInPandas(run, "id string, n_bytes long, n_removed long, n_spans long, kept binary, spans array<int>")
    return out.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)


def op3_prefix_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_bytes(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Every window of 400 bytes, as hexadecimal digits; a byte goes if a window over it stands twice anywhere.
ORACLE_OP3 = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT doc_id, x, unnest(range(0, greatest(octet_length(encode(x)) // 2 - 399, 0), 1000)) AS pos FROM b),
p AS (SELECT doc_id, pos, substr(x, CAST(2 * pos + 1 AS INTEGER), 2798) AS x FROM c),
s AS (SELECT doc_id, pos + i AS i, md5(substr(x, CAST(2 * i + 1 AS INTEGER), 800)) AS h FROM (SELECT doc_id, pos, x, unnest(range(0, least(1000, len(x) // 2 - 399))) AS i FROM p)),
f AS (SELECT doc_id, i FROM s QUALIFY count(*) OVER (PARTITION BY h) > 1),
t AS (SELECT doc_id, unnest(range(0, len(x) // 2, 1000)) AS pos, x FROM b),
y AS (SELECT doc_id, pos + i AS i, substr(z, CAST(2 * i + 1 AS INTEGER), 2) AS byte FROM (SELECT doc_id, pos, z, unnest(range(0, len(z) // 2)) AS i FROM (SELECT doc_id, pos, substr(x, CAST(2 * pos + 1 AS INTEGER), 2000) AS z FROM t))),
g AS (SELECT y.doc_id, y.i, y.byte, coalesce(max(CASE WHEN f.i IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY y.doc_id ORDER BY y.i ROWS BETWEEN 399 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM y LEFT JOIN f ON f.doc_id = y.doc_id AND f.i = y.i),
e AS (SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) AS before FROM g),
k AS (SELECT doc_id, sum(gone) AS n_removed, count(*) FILTER (WHERE gone = 1 AND before = 0) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM e GROUP BY doc_id)
SELECT b.doc_id, len(b.x) // 2 AS n_bytes, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, coalesce(k.n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.kept, ''))) AS kept_sha256
FROM b LEFT JOIN k ON k.doc_id = b.doc_id
"""

"""Each operator beside a brute-force version, on a fixture with nulls, ties, copies and long texts."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import anchors, common, jaccard, kernels, media, near_vectors, packing, piece_sampling, prefix_free, quality, token_counts, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, key string, n long, blob binary, cls string"


def make_docs():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(2, 6)))
    base = [word() for _ in range(300)]
    passage = [word() for _ in range(70)]
    texts = [" ".join(base), " ".join(base), None, "", "  \n\t ", "Short one", "short ONE", "x" * 9000, "ab cd ef gh ij " * 600, "▁ <s> \x00 漢字 😀  two  blanks "]
    for i in range(25):
        w = list(base)
        for _ in range(i // 3):
            w[rnd.randrange(len(w))] = word()
        texts.append(" ".join(w))
    for _ in range(12):
        texts.append(" ".join([word() for _ in range(rnd.randint(1, 60))] + passage + [word() for _ in range(rnd.randint(1, 60))]))
    texts.append(" ".join(word() for _ in range(20000)))
    rows = [(i, t) for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    return [*rows, rows[0], (None, texts[20])]  # a repeated row and one without id


DOCS = make_docs()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "k", 7, b"x", "c") for i, t in DOCS], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_token_counts(docs, empty):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=common.tokenizer_path(token_counts.MODEL))
    want = sorted(((i, len((t or "").encode()), len(m.encode(t or "")), len(m.encode(t or "")) > 4096) for i, t in DOCS), key=str)
    assert rows_of(token_counts.token_counts(docs)) == want
    assert token_counts.token_counts(empty).count() == 0


def test_merging_in_steps():
    """Against the library: long sequences, repeated ones, overlaps and chains of merges."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=common.tokenizer_path(token_counts.MODEL))
    m, rnd = token_counts.merger(common.tokenizer_path(token_counts.MODEL)), random.Random(8)
    seqs = ["x" * 9000, "ab" * 3000, "a" * 4097, "▁" * 37, "漢字" * 900, "".join(rnd.choice("aeiourst") for _ in range(20000))]
    seqs += ["".join(rnd.choice(kind) for _ in range(rnd.choice((2, 9, 40, 200)))) for kind in ("ab", "aeiourst", "the ing", "x\n\t y", "漢é😀a ") for _ in range(150)]
    assert m.counts(seqs) == [len(model.encode(s)) for s in seqs]
    assert m.counts(seqs[::-1]) == m.counts(seqs)[::-1]


def test_piece_sampling(docs, empty):
    coded = piece_sampling.encode_sampled(docs)
    back = piece_sampling.decode(coded, keep=("text",))
    assert back.where(F.col("decoded") != F.coalesce("text", F.lit(""))).count() == 0
    again = piece_sampling.encode_sampled(docs.repartition(2))
    assert rows_of(coded.select("doc_id", "ids")) == rows_of(again.select("doc_id", "ids"))
    assert rows_of(coded.select("ids")) != rows_of(piece_sampling.encode_sampled(docs, seed=18).select("ids"))
    assert piece_sampling.encode_sampled(empty).count() == 0


def test_sampling_follows_the_weights():
    m = piece_sampling.lattices(common.tokenizer_path(piece_sampling.MODEL), 1.0)
    base, begin, share, back, edge = m.build([" the"])
    paths = {}

    def walk(v, p, ids):  # all paths, from the edges' shares
        if v == base[0]:
            paths[tuple(reversed(ids))] = p
            return
        i, low = int(begin[v]), 0.0
        while True:
            walk(int(back[i]), p * (share[i] - low), [*ids, int(edge[i])])
            low = share[i]
            if low == 1.0:
                return
            i += 1

    walk(int(base[0]) + 4, 1.0, [])
    assert abs(sum(paths.values()) - 1) < 1e-9 and len(paths) > 2
    n = 20000
    ids, size = m.encode(["the"] * n, np.arange(n, dtype=np.uint64) * np.uint64(77))
    at = np.concatenate([[0], np.cumsum(size)])
    seen = {}
    for i in range(n):
        k = tuple(ids[at[i] : at[i + 1]].tolist())
        seen[k] = seen.get(k, 0) + 1
    for k, p in paths.items():
        assert abs(seen.get(k, 0) / n - p) < 0.02


def brute_bytes():
    count = {}
    raw = [(t or "").encode() for _, t in DOCS]
    for b in raw:
        for i in range(len(b) - 399):
            count[b[i : i + 400]] = count.get(b[i : i + 400], 0) + 1
    out = []
    for (k, _), b in zip(DOCS, raw, strict=True):
        gone = np.zeros(len(b) + 1, dtype=int)
        for i in range(len(b) - 399):
            if count[b[i : i + 400]] > 1:
                gone[i] += 1
                gone[min(i + 400, len(b))] -= 1
        gone = np.cumsum(gone)[: len(b)] > 0
        kept = np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()) if len(b) else 0
        out.append((k, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_prefix_free(docs, empty):
    got = prefix_free.dedup_bytes(docs)
    assert rows_of(got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))) == brute_bytes()
    assert prefix_free.dedup_bytes(empty).count() == 0


def test_anchors(docs, empty):
    ident = lambda i: 1 << 62 if i is None else i
    words, low = [WORD.findall(t or "") for _, t in DOCS], {}
    for (k, _), w in zip(DOCS, words, strict=True):
        for i in range(len(w) - 49):
            key = tuple(w[i : i + 50])
            low[key] = min(low.get(key, 1 << 63), ident(k))
    want = []
    for (k, _), w in zip(DOCS, words, strict=True):
        gone = set()
        for i in range(len(w) - 49):
            if low[tuple(w[i : i + 50])] < ident(k):
                gone.update(range(i, i + 50))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((k, len(w), len(gone), kept))
    assert rows_of(anchors.dedup_words(docs).select("doc_id", "n_words", "n_removed", "kept")) == sorted(want, key=str)
    assert anchors.dedup_words(empty).count() == 0
    out = anchors.without_repeats(docs.withColumnsRenamed({"key": "__key", "cls": "found", "blob": "doc"}))
    assert out.columns == ["doc_id", "text", "__key", "n", "doc", "found"]
    assert out.where("__key = 'k' AND doc = X'78' AND found = 'c'").count() == out.count()
    left = {(k, n): kept for k, n, gone, kept in want if gone and kept}
    same = {r.doc_id: r.text for r in out.collect()}
    assert all(same[k] == kept for (k, _), kept in left.items())
    assert out.count() == sum(1 for _, _, gone, kept in want if not gone or kept)


def components(n, links):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t):
    w = WORD.findall((t or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_jaccard(rows):
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    comp = components(len(rows), links)
    low = {}
    for c, (k, _) in zip(comp, rows, strict=True):
        if k is not None:
            low[c] = min(low.get(c, k), k)
    n = [0] * len(rows)
    for link in links:
        for i in link:
            n[i] += 1
    return [(k, len(s), low.get(c, k), m) for (k, _), s, c, m in zip(rows, sets, comp, n, strict=True)]


def test_jaccard(docs, empty):
    assert rows_of(jaccard.jaccard_components(docs)) == sorted(brute_jaccard(DOCS), key=str)
    assert jaccard.jaccard_components(empty).count() == 0
    kept = jaccard.keep_one(docs)
    want = {(k, low) for k, _, low, _ in brute_jaccard(DOCS)}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted({str(k) for k, low in want if k == low})
    assert kept.columns == docs.columns


def test_jaccard_keeps_by_row(spark):
    one, two, three, four = (" ".join(f"{c}{i}" for i in range(30)) for c in "abcd")
    rows = [(None, one), (None, one), (None, one.upper()), (1, two), (None, two), (2, three), (2, four), (2, four), (None, "..."), (None, ""), (None, None), (3, None), (3, ""), (3, "")]
    rows = [(k, t, n) for n, (k, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    got = [(r.doc_id, r.text if r.doc_id is not None or r.text is None else r.text.lower()) for r in jaccard.keep_one(docs).collect()]
    want = [(None, one), (1, two), (2, three), (2, four), (None, "..."), (None, ""), (None, None), (3, None), (3, "")]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize(("hot", "block"), [(4, 8), (0, 512), (32, 512), (500, 512)])
def test_jaccard_large_group(spark, monkeypatch, hot, block):
    """Shingles of many classes are dealt over pairs of blocks; nothing depends on the bounds."""
    for name, value in (("HOT", hot), ("SEEN", hot), ("BLOCK", block)):
        monkeypatch.setattr(jaccard, name, value)
    monkeypatch.setattr(jaccard, "PAIRS", 2000)
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(120)] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, rows[i % 7][1]) for i in range(20)] + [(200 + i, " ".join(base[:60]) + f" y{i} z{i} " + " ".join(f"v{i}.{j}" for j in range(40))) for i in range(30)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    assert rows_of(got) == sorted(brute_jaccard(rows), key=str)


def test_positional_filter_loses_nothing():
    rnd = random.Random(3)
    for _ in range(3000):
        pool = rnd.sample(range(60), 40)
        x = sorted(rnd.sample(pool, rnd.randint(1, 40)))
        y = sorted(rnd.sample(pool, rnd.randint(1, 40)))
        both = set(x) & set(y)
        if 100 * len(both) >= 80 * len(set(x) | set(y)):
            t = min(both)
            i, j = x.index(t), y.index(t)
            assert i < jaccard.prefix_length(np.int64(len(x))) and j < jaccard.prefix_length(np.int64(len(y)))
            assert jaccard.may_link(len(x), i, len(y), j)


def test_components(spark):
    rnd = random.Random(1)
    for edges in ([(i, i + 1) for i in range(200)], [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)], [(3, 3), (5, 4)]):
        got = dict(map(tuple, common.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()))
        want = components(301, [e for e in edges if e[0] != e[1]])
        assert got == {v: want[v] for e in edges if e[0] != e[1] for v in e}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(common.tokenizer_path(packing.MODEL))
    want = []
    for k, t in DOCS:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 1]
        for p, s in enumerate(range(0, len(ids), 4096)):
            want.append((k, p, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], dtype="<u4").tobytes())))
    got = packing.pack_documents(docs).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack_documents(empty).count() == 0


def test_plan_is_whole_and_tight():
    rnd = random.Random(2)
    for _ in range(40):
        sizes = [rnd.randint(1, 100) for _ in range(rnd.randint(1, 300))]
        hist = {s: sizes.count(s) for s in set(sizes)}
        bins = packing.plan(hist, 100)
        packed = {}
        for content, n in bins:
            assert sum(s * t for s, t in content) <= 100
            for s, t in content:
                packed[s] = packed.get(s, 0) + t * n
        assert packed == hist
        assert sum(n for _, n in bins) <= -(-sum(sizes) // 100) * 1.25 + 2


def test_media(docs, empty, spark):
    index = media.store(docs, common.fresh(spark, "media"))
    for r in media.read_back(media.metadata(index)).collect():
        assert r.payload_bytes % 576 == 0 and r.payload_bytes > 0
    want = []
    for k, t in DOCS:
        p = media.payload((t or "").encode())
        want.append((k, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), hashlib.sha256(media.to_png(p)).hexdigest()))
    got = media.read_back(media.metadata(index)).select(F.col("k").cast("long"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_sha256")
    assert rows_of(got) == sorted(want, key=str)
    assert media.from_png(media.to_png(b"a" * 1152)) == b"a" * 1152
    assert media.read_back(media.metadata(media.store(empty, common.fresh(spark, "media")))).count() == 0


def test_warc(spark):
    body = "<p>" + "x" * 200
    rows = [(3, "http://b.example/x", body), (1, "http://a.example/y?q=1", body), (2, None, body), (4, "http://a.example/", None), (5, "bad url [", "<p>"), (6, "http://a.example/", "<p>"), (1, "http://a.example/y?q=1", body), (None, "u", body)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    index = warc.merged_index(warc.write_archives(pages, common.fresh(spark, "warc")))
    order = [(r.url_key, r.captured) for r in index.collect()]
    assert order == sorted(order)
    got = warc.read_back(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    want = []
    for k, _, html in rows:
        b = (html or "").encode()
        again = len(b) >= 100 and k != 1
        want.append((k, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", 1 if again else None))
    assert rows_of(got) == sorted(want, key=str)


def test_warc_edges(spark, monkeypatch):
    monkeypatch.setattr(warc, "RUN_RECORDS", 20)
    monkeypatch.setattr(warc, "BLOCK", 4)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_back(warc.merged_index(warc.write_archives(empty, common.fresh(spark, "warc")))).count() == 0
    rnd = random.Random(6)
    rows = [(i - 30, "http://hot.example/" if i % 3 else f"http://{rnd.choice('abc')}.example/{rnd.randrange(9)}", "é" * (300_000 if i == 7 else i)) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    index = warc.merged_index(warc.write_archives(pages, common.fresh(spark, "warc")))
    order = [(r.url_key, r.captured, r.page_id) for r in index.collect()]
    assert order == sorted(order) and len(order) == 300
    assert {r.page_id: r.payload_bytes for r in warc.read_back(index).collect()} == {k: len(t.encode()) for k, _, t in rows}


def test_loser_tree():
    rnd = random.Random(4)
    for k in range(1, 12):
        runs = [sorted((rnd.randrange(50), i) for i in range(rnd.randrange(9))) for _ in range(k)]
        assert list(warc.loser_tree(runs)) == sorted(x for r in runs for x in r)


def test_near_vectors(spark):
    g = np.random.Generator(np.random.PCG64(3))
    base = g.standard_normal((6, 32))
    rows = []
    for i in range(300):
        v = base[i % 6] + 0.25 * g.standard_normal(32)
        rows.append((i, [float(x) for x in v], i % 3))
    rows += [(300, rows[0][1], 0), (301, rows[0][1], 0), (302, rows[0][1], None), (303, None, 0), (304, [0.0] * 32, 0), (305, [float("nan")] * 32, 0), (306, [None] * 32, 0), (307, [], 0), (308, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r.vec_id: r for r in near_vectors.near_vectors(df).collect()}
    good = [r for r in rows if r[2] is not None and r[1] and all(x is not None and x == x for x in r[1]) and any(r[1])]
    links = [(a[0], b[0]) for a, b in itertools.combinations(good, 2) if a[2] == b[2] and len(a[1]) == len(b[1]) and np.dot(a[1], b[1]) / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.93]
    n = {r[0]: 0 for r in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    assert len(got) == len(rows)
    assert all(got[k].n_links <= n[k] for k in n) and sum(r.n_links for r in got.values()) >= 0.9 * sum(n.values()) > 0
    assert got[300].component_id == got[301].component_id == got[0].component_id
    assert all(got[k].n_links == 0 and got[k].kept for k in range(302, 309))
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


def test_near_vectors_hot_bucket(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "BLOCK", 16)
    g = np.random.Generator(np.random.PCG64(5))
    base = g.standard_normal(16)
    df = spark.createDataFrame([(i, [float(x) for x in base + 0.01 * g.standard_normal(16)], 1) for i in range(100)], "vec_id long, embedding array<double>, label int")
    got = near_vectors.near_vectors(df).collect()
    assert all(r.n_links == 99 and r.component_id == 0 for r in got)


def test_near_vectors_odd_rows(spark):
    """Labels whose CRC-32 is equal, repeated and null ids, names that clash, and all components by brute force."""
    g = np.random.Generator(np.random.PCG64(8))
    one = [float(x) for x in g.standard_normal(8)]
    same = zlib.crc32(b"u17025850x/8"), zlib.crc32(b"u148394141x/8")
    assert same[0] == same[1]
    rows = [(1, one, "u17025850x"), (2, one, "u148394141x"), (2, one, "u148394141x"), (None, one, "u17025850x"), (None, None, "u17025850x"), (7, one[:7], "u17025850x")]
    base = g.standard_normal((6, 8))
    rows += [(100 + i, [float(x) for x in base[i % 6] + 0.001 * g.standard_normal(8)], "groups") for i in range(60)]
    df = spark.createDataFrame([(*r, "c", 0, b"k") for r in rows], "vec_id long, embedding array<double>, label string, class string, bucket int, n binary").repartition(5)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors.near_vectors(df).collect()), key=str)
    unit = [np.array(v) / np.linalg.norm(v) if v else None for _, v, _ in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if rows[i][2] == rows[j][2] and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93]
    comp, n = components(len(rows), links), [sum(i in x for x in links) for i in range(len(rows))]
    low = {c: min((rows[i][0] for i in range(len(rows)) if comp[i] == c and rows[i][0] is not None), default=None) for c in comp}
    assert got == sorted(((k, n[i], low[comp[i]], k == low[comp[i]]) for i, (k, _, _) in enumerate(rows)), key=str)
    text = near_vectors.near_vectors(df.selectExpr("concat('v', vec_id) AS vec_id", "embedding", "label")).where("vec_id = 'v2'").first()
    assert (text.n_links, text.component_id) == (1, "v2")


def test_near_vectors_recall(spark):
    """Many true links, most of them not far above the threshold."""
    g = np.random.Generator(np.random.PCG64(12))
    base = np.repeat(g.standard_normal((60, 64)), 20, axis=0)
    x = base + 0.24 * g.standard_normal((1200, 64))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    cos = u @ u.T
    want = (cos >= 0.93).sum(axis=1) - 1
    df = spark.createDataFrame([(i, [float(v) for v in r], "a") for i, r in enumerate(x)], "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: r.n_links for r in near_vectors.near_vectors(df).collect()}
    assert want.sum() > 2000 and np.median(cos[(cos >= 0.93) & (cos < 0.9999)]) < 0.95
    assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.9 * want.sum()


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4))
    out = quality.classify(docs, labels.where(fold != 0)).join(labels.where(fold == 0), "doc_id").selectExpr("selected", "quality = 1 AND toxic = 0 AS good").groupBy("selected", "good").count().collect()
    n = {(r.selected, r.good): r["count"] for r in out}
    right = n.get((True, True), 0) + n.get((False, False), 0)
    assert right / sum(n.values()) > 0.96
    assert n.get((True, True), 0) / (n.get((True, True), 0) + n.get((False, True), 0)) > 0.98


def test_quality_edges(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, None), (5, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, labels).count() == len(DOCS)
    assert quality.classify(docs, labels.limit(0)).where("NOT selected").count() == 0
    assert quality.classify(empty, labels).count() == 0
    assert quality.keep_selected(docs, labels.limit(0)).columns == docs.columns


def test_quality_collects_no_more_than_the_sample(spark, monkeypatch):
    rows = [(i % 2, f"word{i % 2} text") for i in range(400)] + [(5, "other words"), (None, "x"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(0, 0, 1), (1, 1, 0), (5, 1, 0), (6, 0, 1)], "doc_id long, quality int, toxic int")
    got, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda rows, grade, top: got.append(len(rows)) or fit(rows, grade, top))
    quality.train(docs, labels, sample=2)
    quality.train(docs, labels)
    assert got == [2, 4]


def test_quality_gradient():
    """The fitted optimum is one of the penalised likelihood: no small step from it lowers the loss."""
    rnd = np.random.Generator(np.random.PCG64(2))
    grade = rnd.integers(0, 3, 200)
    rows = [np.unique([g if rnd.random() < 0.8 else 3 + g, 10 + rnd.integers(0, 4)]).astype(np.int32) for g in grade]

    def loss(w, cut):
        out = 0.0
        for r, g in zip(rows, grade, strict=True):
            score = w[r].sum()
            up = [1.0, *(1 / (1 + np.exp(c - score)) for c in cut), 0.0]
            out -= np.log(up[g] - up[g + 1]) / len(grade)
        return out + 0.5e-3 * (w**2).sum()

    w, cut = quality.fit(rows, grade, 2, rounds=3000)
    best = loss(w, cut)
    for k in np.flatnonzero(w):
        for d in (-0.02, 0.02):
            v = w.copy()
            v[k] += d
            assert loss(v, cut) > best - 2e-5
    for d in (-0.02, 0.02):
        assert loss(w, cut + [d, 0]) > best - 2e-5 and loss(w, cut + [0, d]) > best - 2e-5


def test_thresholds_are_ordered():
    rnd = np.random.Generator(np.random.PCG64(1))
    grade = rnd.integers(0, 3, 300)
    rows = [np.array([g, 10 + rnd.integers(0, 5)], dtype=np.int32) for g in grade]
    w, cut = quality.fit(rows, grade, 2)
    assert cut[0] < cut[1]
    tail = quality.grade_probabilities(np.array([w[r].sum() for r in rows]), cut)
    assert (((tail > 0.5).sum(axis=1)) == grade).mean() > 0.95


def test_bitset(spark):
    token = np.random.Generator(np.random.PCG64(3)).integers(0, 2**63, 5000).astype(np.uint64)
    some = token[:2000]
    bits = common.bitset(spark.createDataFrame([(int(b),) for b in common.bit_of(some)], "bit long").repartition(4))
    assert common.in_set(bits, some).all() and common.in_set(bits, token).sum() < 2010
    assert not common.in_set(common.bitset(spark.createDataFrame([], "bit long")), token).any()


def test_kernels():
    a = np.array([5, 3, 8, 1, 9, 2], dtype=np.uint64)
    for k in range(1, 7):
        assert kernels.sliding_min(a, k).tolist() == [min(a[i : i + k]) for i in range(len(a) - k + 1)]
    s, e = kernels.union(np.array([5, 0, 3]), np.array([9, 2, 5]))
    assert s.tolist() == [0, 3] and e.tolist() == [2, 9]

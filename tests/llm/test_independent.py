"""Results beside plain versions that share no code with the operators."""

import hashlib
import itertools
import struct
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import pytest
import test_operators as brute

from millrace.llm import common, media, packing, piece_sampling, quality, queries


def test_samples_follow_the_weights_of_all_segmentations():
    """Every segmentation by pieces, its weight the product of 1 / (rank + 10), beside 20000 samples."""
    import sentencepiece

    path = common.tokenizer_path(piece_sampling.MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    normal = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    weight = {sp.id_to_piece(i): (i, 1 / (r + 10)) for r, i in enumerate(sorted(normal, key=lambda i: -sp.get_score(i)))}
    m = piece_sampling.lattices(path, 1.0)
    for word in ("these", "ab"):
        s, every = "▁" + word, {}
        for cuts in itertools.chain.from_iterable(itertools.combinations(range(1, len(s)), k) for k in range(len(s))):
            parts = [s[a:b] for a, b in zip((0, *cuts), (*cuts, len(s)), strict=True)]
            if all(p in weight for p in parts):
                every[tuple(weight[p][0] for p in parts)] = np.prod([weight[p][1] for p in parts])
        total, n = sum(every.values()), 20000
        ids, size = m.encode([word] * n, np.arange(n, dtype=np.uint64) * np.uint64(7919))
        at, seen = np.concatenate([[0], np.cumsum(size)]), {}
        for i in range(n):
            k = tuple(ids[at[i] : at[i + 1]].tolist())
            seen[k] = seen.get(k, 0) + 1
        assert set(seen) <= set(every)
        assert max(abs(seen.get(k, 0) / n - w / total) for k, w in every.items()) < 0.02


def plain_feature(text):
    raw = (text or "").encode()
    raw += b"\xff" * (576 - len(raw) % 576 if len(raw) % 576 or not raw else 0)
    counts = [raw.count(bytes([b])) for b in range(256)]
    steps = sum(a != b for a, b in zip(raw, raw[1:], strict=False))
    return f"576x{len(raw) // 576}x8;mean={sum(raw) * 1000 // len(raw)};min={min(raw)};max={max(raw)};kinds={sum(c > 0 for c in counts)};mode={counts.index(max(counts))};steps={steps}", raw


def test_media_columns(spark):
    """Features, headers and stored bytes, read with nothing but struct and zlib; one address for each digest."""
    docs = spark.createDataFrame([(i, t) for i, t in brute.DOCS], "doc_id long, text string").repartition(6)
    index = media.store(docs, common.fresh(spark, "media"))
    texts = {str(i): t for i, t in brute.DOCS}
    for r in media.read_back(media.metadata(index)).collect():
        if r.k is not None:
            want, raw = plain_feature(texts[r.k])
            assert r.feature == want and r.payload_sha256 == hashlib.sha256(raw).hexdigest() and r.tail_crc32 == zlib.crc32(raw[-32:])
    rows = index.collect()
    place = {}
    for r in rows:
        assert place.setdefault(r.digest, (r.shard, r.offset, r.length)) == (r.shard, r.offset, r.length)
        with open(r.shard.removeprefix("file:").replace("//", "/"), "rb") as f:
            f.seek(r.offset)
            png = f.read(r.length)
        assert hashlib.sha256(png).hexdigest() == r.digest and struct.unpack(">II", png[16:24])[0] == 576
    assert len(place) == len({plain_feature(t)[1] for _, t in brute.DOCS})


TABLES = "documents embeddings pages labels".split()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    cur = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert brute.rows_of(df.select(*names)) == sorted(cur.fetchall(), key=str)


def test_stages_take_odd_documents(spark):
    """Empty tables, nulls in any column, repeated rows, very long texts, and columns whose names the operators use."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, found binary, doc int, t string, id string, __key string"
    passage, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"u{i}" for i in range(80))
    rows = [(1, f"one {passage} end", "en", "s", 9, "k", b"f", 1, "t", "i", "x"), (2, f"{other} {passage} stop", None, None, None, None, None, None, None, None, None), (2, f"{other} {passage} stop", None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None), (4, "", "", "", 0, "", b"", 0, "", "", ""), (None, "null id text", "en", "s", 1, "k", b"f", 1, "t", "i", "x"), (7, "long " + " ".join(f"v{i % 9973}" for i in range(120000)), "en", "s", 1, "k", b"f", 1, "t", "i", "x")]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (4, None, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    for d in (docs, docs.limit(0)):
        kept = quality.keep_selected(d, labels)
        assert kept.columns == d.columns and kept.count() == d.count()  # one grade only: all stay
        for name, stage in corpus_pipeline.STAGES[1:-1]:
            kept = common.written(stage(spark, kept, None), name)
            assert kept.columns == d.columns
        packed = packing.pack_documents(kept).collect()
        assert {r.doc_id for r in packed} == {r.doc_id for r in kept.collect()}
        if d is docs:
            got = {r.text for r in kept.collect()}
            assert rows[0][1] in got and f"{other} stop" in got and len([r for r in kept.collect() if r.doc_id == 2]) == 1
            assert kept.where("doc_id = 1").select("__key").first()[0] == "x"


def test_first_stage_is_the_classifier(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    out = corpus_pipeline.STAGES[0][1](spark, docs, sf_dir)
    chosen = quality.classify(docs, common.table(spark, sf_dir, "labels")).where("selected")
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in chosen.collect())


def test_last_stage_holds_whole_texts(spark, sf_dir):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(common.tokenizer_path(packing.MODEL))
    docs = common.table(spark, sf_dir, "documents")
    got = {}
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect():
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for r in docs.collect():
        ids = np.array([*model.encode(r.text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        assert sorted(got[r.doc_id]) == [(p, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for p, s in enumerate(range(0, len(ids), 4096))]

"""The pipeline beside a brute-force version of its stages, on the small tables."""

import corpus_pipeline
import test_operators as brute

from millrace.llm import common


def test_stages(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name)
        seen[name] = docs
        if name != "pack":
            assert docs.columns == columns
    first = [(r.doc_id, r.text) for r in seen["quality_classifier"].collect()]
    want = sorted(k for k, _, low, _ in brute.brute_jaccard(first) if k == low)
    second = sorted((r.doc_id, r.text) for r in seen["near_duplicates"].collect())
    assert [k for k, _ in second] == want
    low, kept = {}, {}
    for k, t in second:
        w = brute.WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - 49):
            if low.setdefault(tuple(w[i : i + 50]), k) < k:
                gone.update(range(i, i + 50))
        text = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else t
        if not gone or text:
            kept[k] = text
    assert {r.doc_id: r.text for r in seen["repeated_passages"].collect()} == kept
    assert {r.doc_id for r in seen["pack"].collect()} == set(kept)
    assert all(r.n_chars == len(r.text) for r in seen["repeated_passages"].collect())

"""The pipeline against its stages done by brute force on the smallest table, and stage by stage."""

import hashlib
from collections import Counter

import numpy as np

import corpus_pipeline
from threadlake.llm import mixing, toxicity

from .test_operators import DOCS, low, near_components, reference_encoding, toxic_corpus


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "MinHash near-dedup", "mixing sources to target weights", "byte-level BPE encoding and decoding"]


def test_run_equals_brute_force(spark, tmp_path):
    rows, labels, _ = toxic_corpus(3, 200)
    rows = [(i, t, f"s{i % 4}") for i, t, _ in rows]
    rows += [(500 + i, t.upper(), "s1") for i, t, _ in rows[:20]] + [(600 + i, t + " end", "s2") for i, t, _ in rows[20:50]] + [(700, None, None), (701, "", "s0")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    model = toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    kept = [r for r, s in zip(rows, model.scores([t for _, t, _ in rows]), strict=True) if s < 0.5]
    last = {}
    for r in kept:
        key = low(r[1])
        last[key] = max(last.get(key, r), r, key=lambda r: r[0])
    kept = sorted(last.values())
    comp, _ = near_components(kept)
    first = {}
    for k, c in enumerate(comp):
        first.setdefault(c, kept[k])
    kept = list(first.values())
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in kept], DOCS)
    taken = {r["doc_id"]: r["taken"] // max(1, r["size"]) for r in mixing.report(df).collect()}
    zero = {i for i, t, _ in kept if not (t or "").split()}
    enc = reference_encoding()
    want = Counter()
    for i, t, _ in kept:
        ids = enc.encode_ordinary(t or "")
        if i not in zero:
            want[i, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()] += taken[i]
    assert Counter((r["doc_id"], r["ids_sha256"]) for r in got if r["doc_id"] not in zero) == +want

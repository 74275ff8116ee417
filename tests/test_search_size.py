"""What searching and its index move: no exchange of postings, one row a token and message."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadlake.functions import tokens
from threadlake.operators import search, segments, topk


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_storing_an_index_moves_no_posting(spark, monkeypatch, tmp_path):
    rows = spark.createDataFrame([(i, "the of to tea " * (i % 4) + f"w{i}") for i in range(40)], "id bigint, text string").repartition(3)
    plans = {}

    def kept(spark, name, state, tables):
        plans[name] = plan_of(next(iter((made := tables()).values())))
        return made

    monkeypatch.setattr(search.storage, "kept", kept)
    search.stored_index(spark, "a", "s", rows)
    topk.stored(spark, "a", "s", rows)
    assert len(plans) == 2 and not any("Exchange" in p for p in plans.values())
    log = segments.Segments(spark, str(tmp_path / "index"))
    log.update(rows.select("id", F.col("text").alias("prose")), sections={"prose": F.col("prose")})
    for f in (tmp_path / "index").rglob("postings/*.parquet"):
        held = spark.read.parquet(str(f)).select("token", "id").collect()
        assert held == sorted(held)


def test_phrases_are_matched_in_one_exchange_of_postings(spark):
    rng = random.Random(7)
    texts = [(i, " ".join(rng.choices("the of to tea then red".split(), k=rng.randint(0, 40)))) for i in range(120)]
    index = search.build_index(spark.createDataFrame(texts, "id bigint, text string"))
    for text in ('"the"', "t", '"the of"', "of-t", '"of of t"', '"the" of-t red'):
        phrases = search.parse_query(text)
        got = search.side_by_side(index.postings, phrases)
        assert plan_of(got).count("Exchange hashpartitioning") == 1 and "Explode" not in plan_of(got) and "explode" not in plan_of(got)

        def times(words, p):
            last = len(p.words) - 1
            return sum(all(words[a + i].startswith(w) if p.prefix and i == last else words[a + i] == w for i, w in enumerate(p.words)) for a in range(len(words) - last)) or None

        want = {i: t for i, s in texts if any(t := tuple(times(s.split(), p) for p in phrases))}
        assert {r["id"]: r[2:] for r in got.collect() if any(r[2:])} == want, text


@pytest.mark.parametrize("most", [1, 3, 1 << 20])
def test_slices_and_sorted_postings_hold_every_place(most):
    rng = random.Random(most)
    rows = [[[rng.choice("a b c é".split()) for _ in range(rng.randint(0, 5))] for _ in range(2)] for _ in range(30)]
    words = pa.array([[["x"], []], *rows], pa.list_(pa.list_(pa.string())))[1:]  # an array with an offset
    got = set()
    for lo, hi in search.slices(words, most):
        p = search.sorted_postings(words[lo:hi])
        got |= {(t, lo + r, tuple(at)) for t, r, at in zip(p.token.to_pylist(), p.row.tolist(), p.positions.to_pylist(), strict=True)}
    want = {}
    for r, sections in enumerate(rows):
        for k, section in enumerate(sections):
            for i, w in enumerate(section):
                want.setdefault((w, r), []).append(k * search.SECTION + i)
    assert got == {(w, r, tuple(at)) for (w, r), at in want.items()}


def test_blocks_go_on_across_batches(spark):
    texts = [(i, "a b " * (i % 5) + "c") for i in range(300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        held = topk.build(spark.createDataFrame(texts, "id bigint, text string").coalesce(1), block_docs=16).blocks.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r["docs"] for r in held if r["token"] == "c") == sorted([16] * 18 + [12])
    said = dict(texts)
    for r in held:
        ns = [len(said[i].split()) for i in r["ids"]]
        assert r["positions"] == [[k for k, w in enumerate(said[i].split()) if w == r["token"]] for i in r["ids"]]
        assert r["ns"] == ns and r["least"] == min(ns) and r["tf"] == max(map(len, r["positions"])) and r["docs"] == len(ns)


def test_texts_of_a_batch_are_split_as_a_query_is():
    rng = random.Random(3)
    parts = ["the", "Of", "É", "é", "́", "ß", "İ", "Σ", "ΑΣ", "日本", "😀", "\U0001d518", "", "ǅ", "1", "-", " ", "\n"]
    texts = [None, *("".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(500)), "", "plain", "ascii"]
    for piece in (1, 64, 1 << 19):
        kept, tokens.PIECE = tokens.PIECE, piece
        got = tokens.split(pa.array(texts, pa.string())[1:], tokens.folds()).to_pylist()
        tokens.PIECE = kept
        assert got == [tokens.tokenise(t) for t in texts[1:]]


def test_a_stored_index_holds_a_token_once_a_task_and_its_texts_not_their_tokens(spark, monkeypatch):
    saved, made = {}, {}
    save = search.storage.save
    monkeypatch.setattr(search.storage, "save", lambda df, tag: saved.setdefault(tag, save(df, tag)))
    monkeypatch.setattr(search.storage, "kept", lambda spark, name, state, tables: made.setdefault("tables", tables()))
    texts = [(i, "the of to tea " * (i % 4) + f"W{i % 5}") for i in range(40)]
    index = search.stored_index(spark, "a", "s", spark.createDataFrame(texts, "id bigint, text string").coalesce(1))
    assert set(saved) == {"texts"} and {r["id"]: r["texts"] for r in saved["texts"].collect()} == {i: [t] for i, t in texts}
    held = made["tables"]["postings"]
    assert sorted(r["token"] for r in held.collect()) == sorted({w for _, t in texts for w in t.lower().split()})
    want = search.build_index(spark.createDataFrame(texts, "id bigint, text string"))
    columns = ["token", "id", "positions", "n"]
    assert sorted(map(tuple, index.postings.select(columns).collect())) == sorted(map(tuple, want.postings.select(columns).collect()))
    assert index.corpus.collect() == want.corpus.collect()
    # What a search asks for is asked of the stored rows, before they are taken apart.
    plan = index.postings.where(search.wanted(search.parse_query("th")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("StartsWith")

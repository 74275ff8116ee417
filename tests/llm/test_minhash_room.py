"""What MinHash keeps while texts move, and how much it asks of the driver."""

from pathlib import Path

from pyspark.sql import functions as F

from threadlake.llm import _common, minhash


def test_signatures_are_gone_before_texts_move(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b c d e f g{i // 2}") for i in range(20)], "doc_id bigint, text string")
    there, save = {}, minhash.save

    def watched(df, tag):
        there.setdefault(tag, [p for p in there.get("paths", []) if Path(p.removeprefix("file:")).exists()])
        out = save(df, tag)
        if tag == "signatures":
            there["paths"] = [out.saved_at]
        return out

    monkeypatch.setattr(minhash, "save", watched)
    got = {r["doc_id"]: r["component_id"] for r in minhash.report(docs).collect()}
    assert got == {i: i - i % 2 for i in range(20)}
    assert there["members"] and there["packed"] and not there["texts"]


def test_few_pairs_need_no_rounds_with_pivots(spark, monkeypatch):
    """Each round is several plans more in the driver's memory."""
    docs = spark.createDataFrame([(i, f"a b c d e f g{i // 4} h{i // 2 % 2}") for i in range(24)] + [(24, "a b c d e f g0 h0 i")], "doc_id bigint, text string")
    rounds, with_pivots = [], minhash._with_pivots
    monkeypatch.setattr(minhash, "_with_pivots", lambda *a: rounds.append(1) or with_pivots(*a))
    got = {r["doc_id"]: r["component_id"] for r in minhash.report(docs).collect()}
    assert got == {i: i - i % 2 for i in range(24)} | {24: 0} and not rounds
    monkeypatch.setattr(minhash, "FEW_PAIRS", -1)
    assert {r["doc_id"]: r["component_id"] for r in minhash.report(docs).collect()} == got and rounds


def test_rounds_with_pivots_end_when_they_leave_most_pairs(spark, monkeypatch):
    """Documents that share buckets and are not linked."""
    docs = spark.createDataFrame([(i, " ".join([f"w{k}" for k in range(75)] + [f"d{i}n{k}" for k in range(20)])) for i in range(12)], "doc_id bigint, text string")
    rounds, with_pivots = [], minhash._with_pivots
    monkeypatch.setattr(minhash, "_with_pivots", lambda *a: rounds.append(1) or with_pivots(*a))
    monkeypatch.setattr(minhash, "FEW_PAIRS", -1)
    assert all(r["component_id"] == r["doc_id"] for r in minhash.report(docs).collect()) and 0 < len(rounds) < minhash.PIVOT_ROUNDS


def test_estimate_is_a_short_expression(spark):
    df = spark.createDataFrame([([1] * 32, [1] * 32)], "a array<bigint>, b array<bigint>").select(minhash.estimate(F.col("a"), F.col("b")))
    assert len(df._jdf.queryExecution().analyzed().toString()) < 4_000 and df.first()[0] == 1


def test_components_end_as_soon_as_they_are_stars(spark, monkeypatch):
    written, save = [], _common.save
    monkeypatch.setattr(_common, "save", lambda df, tag: written.append(tag) or save(df, tag))
    star = spark.createDataFrame([(1, k) for k in range(2, 9)], "a bigint, b bigint")
    assert {tuple(r) for r in _common.components(star).collect()} == {(k, 1) for k in range(1, 9)} and len(written) == 2
    path = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (7, 7)], "a bigint, b bigint")
    assert {tuple(r) for r in _common.components(path).collect()} == {(k, 0) for k in range(41)} | {(k, 100) for k in (100, 101, 102)}

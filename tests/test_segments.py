"""An index under change against one build, its scopes, and documents read in chunks."""

import io
import json
import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from threadlake import storage
from threadlake.functions import sections
from threadlake.operators import search, segments, topk
from threadlake.sources import documents, ranges

ROW = "id bigint, prose string, tool_invocation string, tool_output string, reasoning string"


def rows(spark, table):
    return spark.createDataFrame(table, ROW)


def scored(index, text):
    return sorted((r["id"], round(r["score"], 9)) for r in search.bm25(index, search.parse_query(text)).collect())


def test_increments_equal_one_build(spark, tmp_path):
    rng = random.Random(3)
    words = "the of to and in that was red blue green".split()
    make = lambda i, salt=0: (i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))), "call " * (i % 3), "of the" if i % 4 == 0 else None, "secret thought")
    log = segments.Segments(spark, str(tmp_path / "index"), fanout=2)
    first = [make(i) for i in range(60)]
    log.update(rows(spark, first))
    held = {r[0]: r for r in first}
    second = [make(i) for i in range(50, 80)]  # ten of them rewritten
    log.update(rows(spark, second))
    held |= {r[0]: r for r in second}
    log.update(deleted=spark.createDataFrame([(i,) for i in (1, 2, 55, 999)], "id bigint"))
    third = [(3, "", "", "", "x"), make(90)]  # one that has no text any more
    log.update(rows(spark, third), spark.createDataFrame([(70,)], "id bigint"))
    held |= {r[0]: r for r in third}
    for i in (1, 2, 55, 70):
        del held[i]
    for scope, names in sections.SCOPES.items():
        want = search.build_index(rows(spark, list(held.values())), text=F.array_join(F.filter(F.array(*[F.coalesce(F.col(n), F.lit("")) for n in names]), lambda p: p != ""), "\n"))
        got = log.index(scope)
        assert got.corpus.first()["total"] == want.corpus.first()["total"] and got.corpus.first()["avg_len"] == pytest.approx(want.corpus.first()["avg_len"])
        for text in ("the", '"of" re', "call", "secret"):
            assert scored(got, text) == scored(want, text), (scope, text)
    assert len(log.log()["segments"]) <= 3
    assert scored(log.index("prose"), "call") == [] and scored(log.index("invocations"), "call") != []
    # "call" ends a section and "of" begins the next: no phrase.
    assert search.match(log.index().postings, search.parse_query('"call of"')).count() == 0
    before = {p for p in (tmp_path / "index").rglob("*.parquet")}
    log.update(rows(spark, [make(200)]))
    assert before <= {p for p in (tmp_path / "index").rglob("*.parquet")}  # nothing stored is rewritten
    seen = scored(log.index(), "the")
    assert log.vacuum() > 0 and scored(log.index(), "the") == seen
    with pytest.raises(segments.Conflict):
        log._commit(log.log(), 1)


def pieces(document, chunk):
    got = list(documents.objects(io.BytesIO(document), chunk=chunk))
    return [(at, data) for at, data in got[:-1]], got[-1][1]


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 64, 1 << 20])
def test_documents_in_chunks(chunk):
    rng = random.Random(chunk)
    text = lambda: "".join(rng.choice('ab"\\{}[]:,\u00e9\n ') for _ in range(rng.randint(0, 9)))
    for case in range(60):
        messages = [{"id": str(i), text(): [text(), {"messages": [1, {}]}, rng.random()]} for i in range(rng.randint(0, 4))]
        whole = {"sessionId": text(), "x": {"messages": [{"no": 1}]}, "messages": messages, "y": [[text()]], "messages2": [{}], "z": "\\"}
        document = ("  " + json.dumps(whole, ensure_ascii=case % 2 == 0, indent=case % 3 or None) + " \n").encode()
        got, header = pieces(document, chunk)
        assert [json.loads(d) for _, d in got] == messages
        assert all(document[at : at + len(d)] == d for at, d in got)
        assert json.loads(header) == {**whole, "messages": []}
        cut = document.rstrip()[: rng.randint(0, len(document.rstrip()) - 1)]
        with pytest.raises(documents.BrokenDocument):
            pieces(cut, chunk)
    for bad in (b"", b"[]", b"{} {}", b"{}x", b'{"messages": [{]}]}', b'"x"', b"{'a': 1}", b'{"messages": [{}]} }', b"nul"):
        with pytest.raises(documents.BrokenDocument):
            pieces(bad, chunk)


def test_documents_in_bounded_memory():
    class Long(io.RawIOBase):
        """A document of 60 MB that is never whole in memory."""

        def __init__(self):
            self.left, self.state = 600, [b'{"sessionId": "s", "messages": [{"id": "first"}']

        def read(self, n):
            if self.state:
                return self.state.pop()
            if self.left:
                self.left -= 1
                return b', {"t": "' + b"ab\\n" * 25_000 + b'"}'
            self.left = None if self.left == 0 else self.left
            if self.left is None and not getattr(self, "closed_", False):
                self.closed_ = True
                return b"]}"
            return b""

    tracemalloc.start()
    n = size = 0
    for at, data in documents.objects(Long()):
        n, size = n + 1, size + len(data)
        assert at >= 0
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 602 and size > 60_000_000 and peak < 4 << 20
    with pytest.raises(documents.BrokenDocument, match="beside the array"):
        list(documents.objects(io.BytesIO(b'{"messages": [], "blob": "' + b"x" * (2 << 20) + b'"}')))


def test_ranges_are_read_together(spark, tmp_path):
    assert [(a, b) for a, b, _ in ranges.reads([(0, 10), (12, 5), (100, 5), (103, 1)], gap=5)] == [(0, 17), (100, 105)]
    assert [(a, b) for a, b, _ in ranges.reads([(0, 10), (10, 10), (20, 10)], gap=5, most=20)] == [(0, 20), (20, 30)]
    size, line = 1 << 30, 400
    wanted = [(k * (size // 200), line) for k in range(200)]
    assert sum(b - a for a, b, _ in ranges.reads(wanted)) < size // 100
    path = tmp_path / "a b.jsonl"
    path.write_bytes(b"".join(b"%09d\n" % k for k in range(5000)))
    asked = [("x", str(path), 10 * k, 9) for k in (4999, 3, 3, 7, 4000)] + [("x", str(path), 49_995, 9), ("x", str(tmp_path / "none"), 0, 5)]
    got = ranges.read_ranges(spark.createDataFrame(asked, "agent string, path string, byte_offset bigint, byte_length bigint")).collect()
    assert sorted(r["raw"] for r in got) == ["000000003", "000000007", "000004000", "000004999"]


def test_best_blocks_give_the_same_page(spark, monkeypatch):
    rng = random.Random(11)
    words = ["the", "then", "of", "to", "tea", "red", "blue", "green"]
    texts = [(i, " ".join(rng.choices(words, weights=[1, 1, 6, 4, 1, 9, 9, 9], k=rng.choice([1, 3, 8, 20, 60])))) for i in range(-40, 900)]
    texts += [(2000 + i, "the of tea") for i in range(30)] + [(3000, None), (3001, " "), (3002, "!?")]  # ties, and rows without words
    rows = spark.createDataFrame(texts, "id bigint, text string").repartition(3)
    corpus = spark.createDataFrame([(i, "claude" if i % 3 else "other", i, i % 7 == 0, i % 11 == 0, f"/p{i % 2}") for i, _ in texts], "id bigint, agent string, ts bigint, has_error boolean, had_error boolean, project_key string")
    supported = spark.createDataFrame([("claude",)], "agent string")
    plain, ranked = search.build_index(rows), topk.build(rows, block_docs=8)
    ranked = topk.Ranked(storage.save(ranked.blocks, "blocks"), ranked.corpus)
    assert ranked.blocks.select(F.sum("docs")).first()[0] == plain.postings.count()
    page = lambda df: [(r["id"], round(r["score"], 9), r["has_more"]) for r in df.collect()]
    cases = [('"the"', {}), ("th", {}), ('"of" t', {}), ('"red blue"', {}), ("re", {"errors_only": True}), ('"of" "tea"', {"project": "/p1", "since": 300}), ('"the" nowhere', {}), ("-", {})]
    monkeypatch.setattr(topk, "BLOCK_DOCS", 8)  # what the first round's size follows
    for pushed in (256, 0):
        monkeypatch.setattr(topk, "PUSHED", pushed)
        for text, only in cases if pushed else cases[:1]:
            got = topk.top(corpus, ranked, supported, text, limit=7, **only)
            want = search.search(corpus, plain, supported, text, sort="relevance", limit=7, **only) if search.parse_query(text) else None
            assert page(got.rows) == (page(want) if want is not None else []), text
            if text in ('"the"', "th"):
                assert 0 < got.read < got.matching // 2, (text, got.read, got.matching)
    # Pages by cursor, through ties, are the whole ranking.
    seen, cursor = [], None
    for _ in range(4):
        got = topk.top(corpus, ranked, supported, '"the of"', limit=9, cursor=cursor).rows
        seen += page(got)
        cursor = search.next_cursor(got, "relevance")
    whole = page(search.search(corpus, plain, supported, '"the of"', sort="relevance", limit=36))
    assert [r[:2] for r in seen] == [r[:2] for r in whole]
    nothing = topk.build(rows.limit(0))
    assert topk.top(corpus, nothing, supported, "th").rows.count() == 0


def test_best_blocks_bound_every_message(spark):
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choices("a ab abc b c".split(), k=rng.randint(1, 30)))) for i in range(300)]
    ranked = topk.build(spark.createDataFrame(texts, "id bigint, text string"), block_docs=16)
    ranked = topk.Ranked(storage.save(ranked.blocks, "blocks"), ranked.corpus)
    total, avg_len = ranked.corpus.select("total", "avg_len").first()
    for text in ('"a"', "a", '"a b"', '"c" b-a'):
        phrases = search.parse_query(text)
        df = topk.frequencies(ranked, phrases)
        index = search.Index(topk.postings(ranked.blocks), ranked.corpus)
        assert df == [search.match(index.postings, [p]).count() for p in phrases]
        of_block = ranked.blocks.select(F.explode("ids").alias("id"), "block").distinct()
        best = {r["block"]: -r["s"] for r in search.bm25(index, phrases).join(of_block, "id").groupBy("block").agg(F.min("score").alias("s")).collect()}
        held = {r["block"]: r["bound"] for r in topk.bounds(ranked, phrases, df, total, avg_len).collect()}
        assert best.keys() <= held.keys() and all(best[b] <= held[b] for b in best), text

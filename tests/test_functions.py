"""Scalar rules, sections, tokens and the query language on small values."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from threadlake.functions import scalar, sections
from threadlake.functions.tokens import tokenise, tokens
from threadlake.operators.search import Phrase, bm25, build_index, match, parse_query


def one(spark, col, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1700000000", 1_700_000_000_000),
        ("1700000000123", 1_700_000_000_123),
        ("0", 0),
        ("-5", -5000),
        ("1.5", 1500),
        ("2026-01-02T03:04:05Z", 1_767_323_045_000),
        ("2026-01-02T03:04:05.250+01:00", 1_767_319_445_250),
        ("2026-01-02T03:04:05", None),
        ("2026-01-02", None),
        ("soon", None),
        ("", None),
        (None, None),
        ("9223372036854775807", 9223372036854775807),
    ],
)
def test_timestamps(spark, text, want):
    assert one(spark, scalar.timestamp_ms(F.col("x")), text) == want


@pytest.mark.parametrize(("text", "n"), [("", 0), ("abc", 3), ("a\r\nb", 3), ("e\u0301a", 2), ("\U0001f1e9\U0001f1ea\U0001f1eb\U0001f1f7", 2), ("\U0001f468\u200d\U0001f469\u200d\U0001f467x", 2), ("\U0001f44d\U0001f3fd", 1), ("\u1112\u1161\u11ab", 1)])
def test_grapheme_clusters(spark, text, n):
    assert one(spark, scalar.clusters(F.col("x")), text) == n
    family = "\U0001f468\u200d\U0001f469\u200d\U0001f467"
    assert one(spark, scalar.preview(F.col("x")), family * 160) == family * 160
    assert one(spark, scalar.preview(F.col("x")), family * 161) == family * 159 + "…"


def test_preview(spark):
    assert one(spark, scalar.preview(F.col("x")), "  a \n\t b ") == "a b"
    assert one(spark, scalar.preview(F.col("x")), "y" * 200) == "y" * 159 + "…"
    assert one(spark, scalar.preview(F.col("x")), "y" * 160) == "y" * 160


def test_day_cuts_towards_zero(spark):
    assert one(spark, scalar.day_bucket(F.col("x")), -500, "x bigint") == "1970-01-01"
    assert one(spark, scalar.day_bucket(F.col("x")), 1_700_000_000_000, "x bigint") == "2023-11-14"


@pytest.mark.parametrize(("parent", "child", "want"), [("/a/b", "/a/b", True), ("/a/b", "/a/b/c", True), ("/a/b", "/a/bc", False), ("/a/b/", "/a/b/c", True)])
def test_path_contains(spark, parent, child, want):
    df = spark.createDataFrame([(parent, child)], "p string, c string")
    assert df.select(scalar.path_contains(F.col("p"), F.col("c"))).first()[0] is want


@pytest.mark.parametrize(
    ("json", "want"),
    [('{"error":{"message":" no "}}', "no"), ('{"message":"a","error":"b"}', "b"), ('{"error":{"detail":{"reason":"deep"}}}', "deep"), ('{"error":" "}', None), ('{"error":5}', None)],
)
def test_error_description(spark, json, want):
    assert one(spark, scalar.error_description(F.parse_json(F.col("x"))), json) == want


def test_json_values(spark):
    row = '{"a":true,"b":"true","c":"7","d":2,"e":{"z":1,"b":[1]}}'
    v = F.parse_json(F.col("x"))
    assert one(spark, scalar.flag(v, "$.a"), row) is True
    assert one(spark, scalar.flag(v, "$.b"), row) is False
    assert one(spark, scalar.lenient_long(v, "$.a"), row) == 1
    assert one(spark, scalar.lenient_long(v, "$.c"), row) == 7
    assert one(spark, scalar.string_at(v, "$.d"), row) is None
    assert one(spark, scalar.compact_json(F.variant_get(v, "$.e", "variant")), row) == '{"b":[1],"z":1}'


def test_visibility(spark):
    rows = [("user", False, 1), ("assistant", False, 4), ("system", False, 1), ("assistant", True, 0), ("user", False, 0), ("tool_use", False, None), ("user", False, None), ("assistant", False, 8)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, role string, has_error boolean, section_flags int")
    shown = lambda s: [r["i"] for r in df.where(sections.visible(s)).orderBy("i").collect()]
    assert shown({"prose"}) == [0, 3, 6]
    assert shown({"prose", "tools", "system"}) == [0, 2, 3, 5, 6]
    assert shown({"attachments", "reasoning"}) == [1, 3, 7]


def test_user_title(spark):
    assert one(spark, sections.user_title(F.col("x")), "<environment_context>\nx</environment_context> Fix it ") == "Fix it"
    assert one(spark, sections.user_title(F.col("x")), "# AGENTS.md instructions for /x") is None
    assert one(spark, sections.user_title(F.col("x")), "<user_query>run it</user_query>") == "run it"
    assert one(spark, sections.user_title(F.col("x")), "<user_instructions> run </user_instructions>") == "run"
    assert one(spark, sections.user_title(F.col("x")), "<permissions instructions>no</permissions instructions><recommended_plugins>p</recommended_plugins><instructions>\n</instructions>go") == "go"
    assert one(spark, sections.user_title(F.col("x")), "  # AGENTS.md instructions for x") is None


@pytest.mark.parametrize("text", ["résumé Été_x", "🤖 🙂 ₿ -> :: &&", "ﬁ ß ½ ² Ⅷ", "修复 123 ->", "İstanbul", "foo-bar", "x"])
def test_tokens_are_those_of_the_index(spark, text):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='unicode61 remove_diacritics 2')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    db.execute("INSERT INTO t VALUES (?)", (text,))
    want = [r[0] for r in db.execute("SELECT term FROM v ORDER BY offset")]
    assert one(spark, tokens(F.col("x")), text) == want
    assert tokenise(text) == want


def test_query_language():
    assert parse_query("alpha beta") == [Phrase(("alpha",), True), Phrase(("beta",), True)]
    assert parse_query('alpha   "exact phrase"') == [Phrase(("alpha",), True), Phrase(("exact", "phrase"), False)]
    assert parse_query("") == parse_query("  -> :: ") == []
    assert parse_query("foo-bar") == [Phrase(("foo", "bar"), True)]
    assert parse_query(r"say\"hi") == [Phrase(("say", "hi"), True)]
    assert parse_query("修复 123 ->") == [Phrase(("修复",), True), Phrase(("123",), True)]


@pytest.mark.parametrize("query", ["the", '"the"', '"of the" qu', "foo-ba", '"quick fox"', "résumé"])
def test_match_and_bm25_against_the_standard_library(spark, query):
    texts = ["the quick brown fox", "of the of the fox foo barn", "foo bar of them", "a resume of the quick fox", "Résumé quick", "nothing", "", "the the the fox quick fox"]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='unicode61 remove_diacritics 2')")
    db.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", [(i, x) for i, x in enumerate(texts) if x])
    phrases = parse_query(query)
    fts = " AND ".join('"' + " ".join(p.words) + '"' + ("*" if p.prefix else "") for p in phrases)
    want = dict(db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (fts,)).fetchall())
    index = build_index(spark.createDataFrame(list(enumerate(texts)), "id int, text string"))
    assert {r["id"] for r in match(index.postings, phrases).collect()} == set(want)
    got = {r["id"]: r["score"] for r in bm25(index, phrases).collect()}
    assert got == pytest.approx(want)

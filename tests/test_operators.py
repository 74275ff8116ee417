"""Table operators on small cases with known answers."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from threadlake.operators import browse, dml, ingest, paging, search, usage
from threadlake.sources import adapters
from threadlake.streaming import tail

OBS = "id long, source_file_id long, source_key string, agent string, dedupe_key string, ts long, project_id long, session_id long, model string, is_sidechain boolean, input_tokens long, output_tokens long, cache_write_tokens long, cache_read_tokens long, reasoning_tokens long"


def test_canonical_usage(spark):
    rows = [
        (1, 1, "a", "claude", "r", 1_789_500_000_000, 1, 1, "early", True, 100, 5, None, 30, None),
        (2, 1, "b", "claude", "r", 1_789_500_001_000, 2, 1, "late", False, 90, 20, 10, None, None),
        (3, 1, "c", "claude", "r", 1_789_600_000_000, 3, 1, "other", True, 1, None, 2, 3, None),
        (4, 1, "d", "codex", "r", 0, 3, 1, "x", False, 7, 20, None, None, 4),
    ]
    got = {r["agent"]: r for r in usage.canonical(spark.createDataFrame(rows, OBS)).collect()}
    c = got["claude"]
    assert (c["model"], c["project_id"], c["is_sidechain"]) == ("late", 2, False)
    assert [c[t] for t in usage.TOKENS] == [100, 20, 10, 30, None]
    fresh = usage.insert_or_ignore(spark.createDataFrame(rows[:1], OBS), spark.createDataFrame([*rows, (9, 1, "b", *rows[1][3:])], OBS))
    assert sorted(r["id"] for r in fresh.collect()) == [2, 3, 4]


def rates(spark):
    from threadlake.sources.side_files import RATE_SCHEMA, check_rates

    doc = [{"modelPattern": "m-1", "inputPerMillion": 2, "outputPerMillion": 10, "inputIncludesCacheReads": True, "cacheReadPerMillion": 1}, {"modelPattern": "m*", "inputPerMillion": 1}, {"modelPattern": "m-think*", "inputPerMillion": 2, "outputPerMillion": 10, "additionalReasoningPerMillion": 10}, {"modelPattern": "local*", "unmetered": True}]
    return spark.createDataFrame(check_rates({"formatVersion": 1, "currency": "USD", "rates": doc}), RATE_SCHEMA)


@pytest.mark.parametrize(
    ("model", "counts", "want"),
    [
        ("M-1", (1_000_000, 500_000, 0, 0, 0), ("estimated", 7.0)),
        ("m-1", (1_000_000, 0, 0, 400_000, 0), ("estimated", 1.6)),
        ("m-1", (-5, 0, 0, None, 0), ("estimated", 0.0)),
        ("m-2", (10, 0, 0, 0, 0), ("estimated", 0.00001)),
        ("m-2", (10, 1, 0, 0, 0), ("unavailable", None)),
        ("m-thinker", (1_000_000, 500_000, 0, 0, 250_000), ("estimated", 9.5)),
        ("local-x", (10, 1, 1, 1, 1), ("unmetered", None)),
        ("zzz", (1, 1, 1, 1, 1), ("unavailable", None)),
    ],
)
def test_prices(spark, model, counts, want):
    df = spark.createDataFrame([(model, *counts)], "model string, " + ", ".join(f"{t} long" for t in usage.TOKENS))
    r = usage.estimate(df, rates(spark)).first()
    assert (r["status"], r["amount"] if r["amount"] is None else float(r["amount"])) == want


def test_ranges():
    assert usage.date_range("7d", "2026-03-10") == ("2026-03-04", "2026-03-10")
    assert usage.date_range("all", "2026-03-10") == (None, None)
    now = int(dt.datetime(2026, 3, 10, tzinfo=dt.UTC).timestamp() * 1000)
    assert usage.search_range("7d", now) == (now - 7 * 86_400_000, now)
    assert usage.search_range("ytd", now)[0] == int(dt.datetime(2026, 1, 1, tzinfo=dt.UTC).timestamp() * 1000)


def test_message_ids_and_recency(spark, monkeypatch):
    monkeypatch.setattr(ingest, "ORDINAL_BITS", 20)
    df = spark.createDataFrame([(5, 0), (5, 1), (-3, 2), (2**62, 3)], "ts long, n int")
    ids = {r["n"]: r["id"] for r in ingest.message_ids(df, ("n",)).collect()}
    assert ids == {0: 5 << 20, 1: (5 << 20) + 1, 2: 0, 3: ((2**63 - 1) >> 20) << 20}
    rows = spark.createDataFrame([(10, 10 << 20), (11, 11 << 20), (10, -(2**63)), (10, -(2**63) + 1), (9, 9 << 20)], "ts long, id long")
    order = [r["id"] for r in rows.orderBy(*search.RECENCY()).collect()]
    assert order == [11 << 20, -(2**63) + 1, -(2**63), 10 << 20, 9 << 20]
    for k, i in enumerate(order):
        ts = next(r["ts"] for r in rows.collect() if r["id"] == i)
        assert [r["id"] for r in search.after_recency(rows, ts, i).orderBy(*search.RECENCY()).collect()] == order[k + 1 :]


def test_session_pages(spark):
    df = spark.range(605).select("id", (F.col("id") % 50).alias("last_activity_at"), F.lit("p").alias("project_key"))
    seen, cursor = [], None
    while rows := paging.sessions_page(df, "p", 200, cursor).collect():
        seen += [(r["last_activity_at"], r["id"]) for r in rows]
        cursor = ("p", *seen[-1])
    assert len(seen) == 605 and seen == sorted(seen, reverse=True)
    with pytest.raises(paging.CursorMismatch):
        paging.sessions_page(df, "q", 200, cursor)


def test_carry_and_first_write(spark):
    df = spark.createDataFrame([("a", "p", 0, 0, None, "k"), ("a", "p", 1, 0, 5, "k"), ("a", "p", 2, 0, None, "l"), ("a", "q", 0, 0, None, "k")], "agent string, path string, byte_offset long, item int, ts long, source_key string")
    assert [r["ts"] for r in ingest.carry(df, "ts").orderBy("path", "byte_offset").collect()] == [None, 5, 5, None]
    assert sorted((r["path"], r["byte_offset"]) for r in ingest.first_write(df, "path", "source_key").collect()) == [("p", 0), ("p", 2), ("q", 0)]
    assert sorted((r["path"], r["byte_offset"]) for r in ingest.last_write(df, "path", "source_key").collect()) == [("p", 1), ("p", 2), ("q", 0)]


def test_carry_over_slices(spark):
    """A file cut into many slices, among them whole slices without a value and null keys, is filled as it would be in one."""
    rng = random.Random(3)
    rows = [("a", path, at, item, rng.choice([None, None, None, at]) if at > 90 else None, rng.choice([None, f"s{at}"]) if at % 400 < 40 else None) for path in ("p", "q", None) for at in range(0, 2_000, 10) for item in (0, 1)]
    df = spark.createDataFrame(rows, "agent string, path string, byte_offset long, item int, ts long, name string")
    want = []
    for path in ("p", "q", None):
        ts = name = None
        for r in (r for r in rows if r[1] == path):
            ts, name = (old if new is None else new for old, new in ((ts, r[4]), (name, r[5])))
            want.append((*r[:4], ts, name))
    for slices in (None, F.floor(F.col("byte_offset") / 70), F.lit(0)):
        got = ingest.carry(df, "ts", "name", slices=slices)
        assert got.columns == df.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert ingest.carry(df.limit(0), "ts", slices=F.col("byte_offset")).count() == 0


def test_adapters_over_slices(spark):
    raw = ['{"type": "session_meta", "timestamp": "2025-01-01T00:00:00Z", "payload": {"id": "s", "cwd": "/w"}}']
    raw += ['{"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "line %d"}]}}' % i for i in range(30)]
    begin = [0, *itertools.accumulate(len(x) + 1 for x in raw)]
    lines = spark.createDataFrame([("codex", "/l/x.jsonl", b, len(x), x) for b, x in zip(begin, raw)], "agent string, path string, byte_offset long, byte_length long, raw string")
    whole, cut = (sorted(map(str, adapters.codex(lines, n).collect())) for n in (None, 300))
    assert whole == cut and len(cut) >= 30 and all("external_id='s'" in r and "cwd='/w'" in r for r in cut)


def test_metadata_and_titles(spark):
    rows = [("s", "# AGENTS.md instructions for x", None, False, 0), ("s", " Do this ", " T1 ", False, 1), ("s", "later", "  ", True, 2), ("s", None, "T2", False, 3)]
    df = spark.createDataFrame([("a", "p", r[4], 0, *r[:4]) for r in rows], "agent string, path string, byte_offset long, item int, external_id string, prose string, explicit_title string, plan boolean")
    r = ingest.session_metadata(df).first()
    assert (r["first_user_message"], r["generated_title"], r["has_plan"]) == ("Do this", "T2", True)
    session = spark.createDataFrame([("s", "kept", None, False, None), ("t", None, "theirs", True, "index"), ("u", None, "own", False, None)], "external_id string, first_user_message string, generated_title string, has_plan boolean, title_origin string")
    merged = {x["external_id"]: x for x in dml.merge_metadata(session, ingest.session_metadata(df)).collect()}
    assert (merged["s"]["first_user_message"], merged["s"]["generated_title"], merged["s"]["has_plan"]) == ("kept", "T2", True) and merged["t"]["has_plan"]
    names = spark.createDataFrame([("s", "side", "index"), ("u", "side", "index")], "external_id string, name string, origin string")
    titles = lambda p: {x["external_id"]: x["generated_title"] for x in dml.apply_titles(session, names, p).collect()}
    assert titles("fill_missing") == {"s": "side", "t": "theirs", "u": "own"}
    assert titles("complete") == {"s": "side", "t": None, "u": "own"}


def test_changed_files(spark):
    f = "agent string, path string, dev long, inode long, size long, mtime_ns long, head_hash string"
    found = spark.createDataFrame([("a", "same", 1, 1, 10, 5, "h"), ("a", "grown", 1, 2, 20, 6, "h"), ("a", "rewritten", 1, 3, 10, 6, "x"), ("a", "cut", 1, 4, 5, 6, "h"), ("a", "new", 1, 5, 1, 1, "h")], f)
    stored = spark.createDataFrame([("a", p, i, 1, i, 10, 5, "h", 10, None) for i, p in enumerate(("same", "grown", "rewritten", "cut"), 1)], "agent string, path string, id long, dev long, inode long, size long, mtime_ns long, head_hash string, scanned_bytes long, last_error string")
    got = {r["path"]: (r["action"], r["start"]) for r in dml.changed_files(found, stored).collect()}
    assert got == {"same": ("skip", 0), "grown": ("append", 10), "rewritten": ("replace", 0), "cut": ("replace", 0), "new": ("new", 0)}


def test_scan_errors_cover_and_roots(spark):
    e = "root_id long, relative_scope string, error string"
    stored = spark.createDataFrame([(1, "a/b", "x"), (1, "ab", "x"), (2, "a", "x")], e)
    got = dml.replace_scan_errors(stored, spark.createDataFrame([(1, "a")], "root_id long, relative_scope string"), spark.createDataFrame([(1, "a/c", "new")], e))
    assert sorted((r[0], r[1]) for r in got.collect()) == [(1, "a/c"), (1, "ab"), (2, "a")]
    cover = dml.minimal_cover(spark.createDataFrame([("/a",), ("/a/b",), ("/ab",), ("/a",)], "path string"))
    assert sorted(r["path"] for r in cover.collect()) == ["/a", "/ab"]
    roots = spark.createDataFrame([("c", "/x", False, 0), ("c", "/x/", True, 1), ("c", "/y", False, 2)], "agent string, path string, is_default boolean, position int")
    assert sorted(r["path"] for r in dml.distinct_roots(roots).collect()) == ["/x/", "/y"]
    kept, added, removed = dml.synchronise_roots(roots.limit(1), roots.where("path = '/y'"))
    assert (kept.count(), added.count(), removed.count()) == (0, 1, 1)


def test_moves_failures_and_frontier(spark):
    files = spark.createDataFrame([(1, 1, "a", "/old", 7, 8, True, "bad")], "id long, root_id long, agent string, path string, dev long, inode long, is_placeholder boolean, last_error string")
    found = spark.createDataFrame([("a", "/new", 7, 8, 2)], "agent string, path string, dev long, inode long, root_id long")
    assert dml.move_file(files, found).first()["path"] == "/new"
    assert dml.move_aliases(files, found, "g").first()["prior_path"] == "/old"
    assert dml.settle_placeholders(files, files.select("id")).first()["last_error"] is None
    f = "session_id long, source_key string, detail string"
    fresh = spark.createDataFrame([(1, "k", "first", 1), (1, "k", "z" * 5000, 2)], f + ", arrival int")
    out = dml.upsert_failures(spark.createDataFrame([(1, "k", "old"), (2, "k", "stays")], f), fresh).collect()
    assert sorted((r["session_id"], len(r["detail"])) for r in out) == [(1, 4000), (2, 5)]


def test_references_after_a_move(spark):
    summary = spark.createDataFrame([(5, "a", "/r", "/new", "x", 1), (6, "a", "/r", "/stay", "y", 2), (7, "a", "/r", "/empty", "z", 3)], "id long, agent string, root_path string, path string, external_id string, source_file_id long")
    message = spark.createDataFrame([(10, 5, 0, "k", "u"), (11, 5, 1, "l", "u"), (12, 5, 2, "m", None), (20, 6, 0, "k", None)], "id long, session_id long, seq long, source_key string, external_uuid string")
    aliases = spark.createDataFrame([("a", 1, "/old", 1)], "agent string, prior_root long, prior_path string, source_file_id long")
    places = browse.alias_places(aliases, spark.createDataFrame([(1, "/r")], "id long, path string"))
    f = "agent string, root_path string, path string, external_id string, source_key string, external_uuid string, anchor_index long"
    cases = [
        (("/old", "x", "m", None, 0), (5, 12, 2)),  # by key, where the file went
        (("/old", "x", "m", "u", 0), (5, 10, 0)),  # the uuid comes before the key, its first message counts
        (("/old", "x", "m", "lost", 1), (5, 11, 1)),  # a lost uuid does not fall back on the key
        (("/old", "x", None, None, 99), (5, 12, 2)),
        (("/old", "x", None, None, -3), (5, 10, 0)),
        (("/old", "x", "lost", None, None), (5, None, None)),
        (("/stay", "y", "k", None, None), (6, 20, 0)),
        (("/empty", "z", "k", None, 4), (7, None, None)),
        (("/old", "y", "k", None, 0), None),  # another file's session
    ]
    refs = spark.createDataFrame([("a", "/r", *case) for case, _ in cases], f)
    got = {tuple(r)[2:7]: tuple(r)[7:] for r in browse.resolve_reference(refs, summary, message, places).collect()}
    assert got == {case: want for case, want in cases if want}
    kept = browse.capture_reference(summary, message, 5, 12).first()
    assert (kept["path"], kept["source_key"], kept["external_uuid"], kept["anchor_index"]) == ("/new", "m", None, 2)
    assert browse.capture_reference(summary, message, 5, 20).first()["anchor_index"] is None  # not in this session
    assert browse.resolve_reference(browse.capture_reference(summary, message, 5), summary, message).first()["message_id"] is None


def test_known_values_only(spark):
    rows = spark.createDataFrame([("a", "user"), ("a", "later"), ("z", "user"), (None, "user")], "agent string, role string")
    assert browse.known(rows, agent=("a", "b"), role=("user",)).count() == 1


def test_metadata_work(spark):
    f = "id int, revision string, version int, content_generation long, scanned_bytes long, snapshot boolean"
    rows = [(1, "2:7:50", 2, 7, 50, False), (2, "2:7:20", 2, 7, 50, False), (3, "2:7:60", 2, 7, 50, False), (4, "2:6:20", 2, 7, 50, False), (5, "1:7:20", 2, 7, 50, False), (6, None, 2, 7, 50, False), (7, "2:7", 2, 7, 50, False), (8, "2:7:x", 2, 7, 50, False), (9, "3:7:20", 3, 7, 50, True), (10, "2:7:-1", 2, 7, 50, False), (11, "2:7:99999999999999999999", 2, 7, 50, False)]
    got = {r["id"]: (r["mode"], r["start"], r["revision"]) for r in dml.metadata_work(spark.createDataFrame(rows, f)).collect()}
    assert got == {2: ("merge", 20, "2:7:50"), 9: ("replace", 0, "3:7:50")} | {i: ("replace", 0, "2:7:50") for i in (3, 4, 5, 6, 7, 8, 10, 11)}


def test_days_kept_and_exported(spark, tmp_path):
    days = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2), ("2024-01-31", 3)], "day string, n int")
    paging.export_days(days, str(tmp_path / "out"), "2024-01-31")
    assert [(r["day"], r["n"]) for r in spark.read.json(str(tmp_path / "out")).orderBy("day").collect()] == [("2024-01-02", 2), ("2024-01-31", 3)]


def test_paired_change(spark):
    rows = [(p, w, "cpu", side, float(v)) for w, pairs in {"slow": ((100, 112), (100, 90), (100, 111)), "even": ((100, 110), (100, 110), (100, 90)), "zero": ((0, 1), (0, 1), (0, 0))}.items() for p, pair in enumerate(pairs) for side, v in enumerate(pair)]
    samples = spark.createDataFrame([(p, w, m, bool(c), v) for p, w, m, c, v in rows], "pair int, workload string, metric string, candidate boolean, value double")
    got = {r["workload"]: (r["change"], r["regressed"]) for r in paging.paired_change(samples).collect()}
    assert got == {"slow": (11.0, True), "even": (10.0, False), "zero": (float("inf"), True)}

"""Logs to tables: first run, append, truncation, move, delete, metadata, attachments, and what was read again."""

import json
import os
import shutil
import threading
import time

import pytest
from pyspark.sql import functions as F

from threadlake.operators import browse, index_job, ingest, search
from threadlake.sources import adapters, discovery, jsonl

@pytest.fixture(autouse=True, scope="module")
def no_compiling(spark):
    """Runs over a handful of rows: compiling their many plans would take most of the time."""
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    yield
    spark.conf.unset("spark.sql.codegen.wholeStage")


FOUND = "agent string, path string, dev bigint, inode bigint, size bigint, mtime_ns bigint, head_hash string, head_length int, root_id bigint"


def found(spark, *roots):
    files = [f | {"root_id": i} for i, (agent, root) in enumerate(roots) for f in discovery.discover(agent, str(root)).files]
    return spark.createDataFrame([tuple(f[c.split(" ")[0]] for c in FOUND.split(", ")) for f in files], FOUND)


def say(n, session="s1", text=None, **more):
    return {"type": "user" if n % 2 else "assistant", "uuid": f"u{n}", "sessionId": session, "cwd": "/work/a", "timestamp": f"2026-01-02T03:04:{n:02d}Z", "message": {"content": text or f"word{n} common"}, **more}


def write(path, records, mode="w"):
    with open(path, mode, encoding="utf-8") as f:
        f.writelines(json.dumps(r) + "\n" for r in records)


def seen(tables):
    rows = tables["message"].join(tables["session"].select(F.col("id").alias("session_id"), "external_id"), "session_id").collect()
    return sorted((r["external_id"], r["seq"], r["prose"]) for r in rows)


def gone(store, spark, *roots):
    live = found(spark, *roots).select("agent", "path")
    return store.tables()["source_file"].join(live, ["agent", "path"], "left_anti").select("id")


def test_runs_over_changing_files(spark, tmp_path):
    logs, other = tmp_path / "claude", tmp_path / "codex"
    logs.mkdir()
    other.mkdir()
    write(logs / "a.jsonl", [say(1), say(2, message={"id": "m2", "model": "mod", "content": "word2 common", "usage": {"input_tokens": 5, "output_tokens": 2}})])
    write(logs / "b.jsonl", [say(3, "s2", is_error=True), {"type": "custom-title", "sessionId": "s2", "customTitle": "Named"}])
    write(other / "rollout-1.jsonl", [{"type": "session_meta", "payload": {"id": "c1", "cwd": "/work/c"}}, {"type": "response_item", "timestamp": 1700000000, "payload": {"type": "message", "role": "user", "id": "x", "content": "hello common"}}])
    roots = ("claude", logs), ("codex", other)
    store = index_job.Store(spark, str(tmp_path / "store"))
    assert store.current() is None and store.tables()["message"].count() == 0
    assert index_job.refresh(store, found(spark, *roots))
    t = store.tables()
    assert seen(t) == [("c1", 0, "hello common"), ("s1", 0, "word1 common"), ("s1", 1, "word2 common"), ("s2", 0, "word3 common")]
    assert {r["canonical_key"] for r in t["project"].collect()} == {"/work/a", "/work/c"}
    assert {r["external_id"]: (r["generated_title"], r["had_error"]) for r in t["session"].collect()} == {"c1": (None, False), "s1": (None, False), "s2": ("Named", True)}
    assert [(r["input_tokens"], r["model"]) for r in t["observation"].collect()] == [(5, "mod")] and t["failure"].count() == 1
    assert t["source_file"].where("scanned_bytes = size").count() == 3
    first_ids = {r["external_id"]: r["id"] for r in t["session"].collect()}

    assert index_job.refresh(store, found(spark, *roots)) is None  # nothing changed

    write(logs / "a.jsonl", [say(4), say(4)], "a")  # appended, with a repeated record and an open line
    with open(logs / "a.jsonl", "a") as f:
        f.write('{"type": "user", "uuid": "open"')
    assert index_job.refresh(store, found(spark, *roots))
    t = store.tables()
    assert [m for m in seen(t) if m[0] == "s1"] == [("s1", 0, "word1 common"), ("s1", 1, "word2 common"), ("s1", 2, "word4 common")]
    assert {r["external_id"]: r["message_count"] for r in t["session"].collect()} == {"c1": 1, "s1": 3, "s2": 1}
    assert {r["external_id"]: r["id"] for r in t["session"].collect()} == first_ids
    assert t["message"].select("id").distinct().count() == 5

    write(logs / "a.jsonl", [say(5)])  # cut short and written anew
    os.rename(logs / "b.jsonl", logs / "moved.jsonl")
    assert index_job.refresh(store, found(spark, *roots))
    t = store.tables()
    assert [m for m in seen(t) if m[0] in ("s1", "s2")] == [("s1", 0, "word5 common"), ("s2", 0, "word3 common")]
    assert {r["path"].rsplit("/")[-1] for r in t["source_file"].collect()} == {"a.jsonl", "moved.jsonl", "rollout-1.jsonl"}
    assert t["observation"].count() == 0
    assert [r["prior_path"].rsplit("/")[-1] for r in t["move_alias"].collect()] == ["b.jsonl"]
    root = spark.createDataFrame([(0, str(logs))], "id bigint, path string")
    places = browse.alias_places(t["move_alias"], root)
    files = t["source_file"].select(F.col("id").alias("source_file_id"), "path", F.lit(str(logs)).alias("root_path"))
    reference = spark.createDataFrame([("claude", str(logs), str(logs / "b.jsonl"), "s2", None, "u3", None)], "agent string, root_path string, path string, external_id string, source_key string, external_uuid string, anchor_index bigint")
    here = browse.resolve_reference(reference, t["session"].join(files, "source_file_id"), t["message"], places).first()
    assert (here["session_id"], here["message_index"]) == (first_ids["s2"], 0)

    os.remove(other / "rollout-1.jsonl")
    assert index_job.refresh(store, found(spark, *roots), gone(store, spark, *roots))
    t = store.tables()
    assert {m[0] for m in seen(t)} == {"s1", "s2"} and {r["canonical_key"] for r in t["project"].collect()} == {"/work/a"}

    index = search.build_index(t["message"], text=F.col("prose"))
    assert search.match(index.postings, search.parse_query("common word5")).count() == 1
    assert index_job.refresh(store, found(spark, *roots), rebuild=True) and len(seen(store.tables())) == 2
    whole = seen(store.tables())
    assert index_job.refresh(store, found(spark, *roots), rebuild=True, slice_bytes=64) and seen(store.tables()) == whole


def test_hydrated_from_the_source(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    write(path, [say(1, text="one"), say(2, text="two")])
    store = index_job.Store(spark, str(tmp_path / "store"))
    index_job.refresh(store, found(spark, ("claude", tmp_path)))
    t = store.tables()
    emptied = t["message"].withColumn("prose", F.lit(""))
    got = index_job.hydrate(emptied, t["source_file"]).collect()
    assert sorted((r["prose"], r["hydrated"]) for r in got) == [("one", True), ("two", True)]
    write(path, [say(7, text="other")])
    got = index_job.hydrate(t["message"], t["source_file"]).collect()
    assert sorted((r["prose"], r["hydrated"]) for r in got) == [("one", False), ("two", False)]


@pytest.mark.parametrize("split", [20, 128 << 20])
def test_text_reader_gives_the_same_places(spark, tmp_path, split):
    body = b'{"a":1}\r\n\n{"b":"\xc3\xa9"}\n' * 9 + b"open"
    (tmp_path / "a.jsonl").write_bytes(body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = jsonl.with_offsets(jsonl.text_lines(spark.read, "x", [str(tmp_path / "a.jsonl")])).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    own = jsonl.read_lines(spark, [("x", str(tmp_path / "a.jsonl"), 0, None)]).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, own)) and len(rows) == 18


@pytest.mark.parametrize(
    ("content", "want"),
    [
        ([{"type": "image", "source": {"data": "x"}}], True), ([{"type": "Image", "source": {"data": "x"}}], True), ([{"type": "image", "source": {"media_type": "png", "data": "  "}}], False),
        ([{"type": "text", "text": "x", "attachments": [{"name": "f"}]}], True), ([{"type": "text", "text": "x", "attachments": []}], False), ([{"type": "tool_use", "input": {"file": "x", "image": "y"}}], False),
        ([{"type": "tool_result", "content": [{"type": "output_image", "url": "u"}]}], True), ([{"type": "other", "args": {"image": "x"}}], False), ([{"type": "text", "text": "image"}], False), ("image", False), ([{"inlineData": {"data": "x"}}], True), ([{"file": None}], False),
    ],
)
def test_attachments(spark, content, want):
    df = spark.createDataFrame([(json.dumps({"c": content}),)], "j string").select(F.try_variant_get(F.parse_json("j"), "$.c", "variant").alias("v"))
    assert df.select(adapters._non_text(F.col("v")).alias("x")).first()["x"] is want


def metadata(spark, agent, records):
    lines = spark.createDataFrame([(agent, "/r/chats/session-f.jsonl", 100 * i, 9, json.dumps(r)) for i, r in enumerate(records)], jsonl.SCHEMA)
    rows = adapters.ADAPTERS[agent](lines).withColumn("prose", F.when(F.col("role") == "user", F.col("prose")))
    return {r["external_id"]: (r["first_user_message"], r["generated_title"], r["has_plan"]) for r in ingest.session_metadata(rows).collect()}


def test_metadata_of_records(spark):
    tool = lambda name, args: {"type": "assistant", "sessionId": "s", "message": {"content": [{"type": "tool_use", "name": name, "input": args}]}}
    title = [{"type": "custom-title", "sessionId": "s", "customTitle": "first"}, {"type": "summary", "sessionId": "s", "summary": "sum"}, {"type": "custom-title", "sessionId": "s", "customTitle": " last "}, {"type": "custom-title", "sessionId": "s", "customTitle": " "}]
    assert metadata(spark, "claude", [say(1, "s", "<user_query>go</user_query>"), *title]) == {"s": ("go", "last", False)}
    assert metadata(spark, "claude", [{"type": "summary", "sessionId": "s", "summary": "sum"}, tool("ExitPlanMode", {"plan": " "}), tool("EnterPlanMode", {"plan": "x"})])["s"][1:] == ("sum", False)
    assert metadata(spark, "claude", [tool("ExitPlanMode", {"plan": "do it"})])["s"][2]
    item = lambda **p: {"type": "response_item", "payload": p}
    assert metadata(spark, "codex", [{"type": "session_meta", "payload": {"id": "c"}}, item(type="plan", text=" x ")])["c"][2]
    assert metadata(spark, "codex", [{"type": "session_meta", "payload": {"id": "c"}}, item(type="function_call", name="exit_plan_mode", arguments='{"plan": "p"}')])["c"][2]
    assert not metadata(spark, "codex", [{"type": "session_meta", "payload": {"id": "c"}}, item(type="message", role="user", content="<proposed_plan>x</proposed_plan>")])["c"][2]
    chat = [{"sessionId": "g", "title": "T", "messages": [{"id": "1", "type": "user", "content": "hi"}, {"id": "2", "type": "gemini", "content": "ok", "toolCalls": [{"name": "exit_plan_mode", "args": {"plan": "p"}}]}]}, {"$set": {"summary": "later"}}]
    assert metadata(spark, "gemini", chat) == {"g": ("hi", "T", True)}


def test_chat_roots(spark):
    lines = spark.createDataFrame([("gemini", f"/r/{p}/chats/session-1.json", 0, 9, json.dumps({"sessionId": p, "messages": [{"id": "1", "type": "user", "content": "hi"}]})) for p in ("a", "b")], jsonl.SCHEMA)
    sides = spark.createDataFrame([("/r/a", " /work/real\n")], "folder string, cwd string")
    assert {r["external_id"]: r["cwd"] for r in adapters.gemini(lines, sides).collect()} == {"a": "/work/real", "b": "/r/b"}


def test_full_milliseconds_go_on_below_zero(spark):
    rows = spark.createDataFrame([(ts, k) for ts in (5, 6, 7) for k in range(4 if ts != 6 else 2)], "ts bigint, k int")
    got = ingest.message_ids(rows, ("k",), capacity=3).orderBy("ts", "k").collect()
    low = ingest.OVERFLOW_START
    assert [r["id"] for r in got] == [5 << 20, (5 << 20) + 1, (5 << 20) + 2, low, 6 << 20, (6 << 20) + 1, 7 << 20, (7 << 20) + 1, (7 << 20) + 2, low + 1]


def message_keys(tables):
    return sorted(r["external_uuid"] for r in tables["message"].collect())


def test_paths_of_any_spelling(spark, tmp_path):
    names = ["a b", "c%20d", "e#f", "g[h]", "i{j}", "k*l?", "m+n", "ö:=p"]
    for i, n in enumerate(names):
        (tmp_path / "logs" / n).mkdir(parents=True)
        write(tmp_path / "logs" / n / "x.jsonl", [say(i + 1, f"s{i}")])
    store = index_job.Store(spark, str(tmp_path / "store"))
    assert index_job.refresh(store, found(spark, ("claude", tmp_path / "logs")))
    assert len(message_keys(store.tables())) == len(names)
    assert store.tables()["source_file"].where("scanned_bytes = size and last_error is null").count() == len(names)
    assert index_job.refresh(store, found(spark, ("claude", tmp_path / "logs"))) is None
    rows = jsonl.with_offsets(jsonl.text_lines(spark.read, "x", [str(tmp_path / "logs" / n / "x.jsonl") for n in names])).collect()
    assert sorted({r["path"] for r in rows}) == sorted(str(tmp_path / "logs" / n / "x.jsonl") for n in names)


def chat(*ids, title=None):
    return {"sessionId": "g", "messages": [{"id": i, "type": "user", "content": f"text of {i} }}]", "timestamp": 1_700_000_000 + k} for k, i in enumerate(ids)], **({"title": title} if title else {})}


def test_snapshots_that_fail_keep_what_is_stored(spark, tmp_path):
    chats = tmp_path / "p" / "chats"
    chats.mkdir(parents=True)
    path = chats / "session-1.json"
    whole = json.dumps(chat("1", "2", title="Named"))
    path.write_text(whole)
    store = index_job.Store(spark, str(tmp_path / "store"))
    roots = ("gemini", tmp_path)
    index_job.refresh(store, found(spark, roots), now_ms=1)
    assert message_keys(store.tables()) == ["1", "2"] and store.tables()["session"].first()["generated_title"] == "Named"
    for broken in (whole[:-20], whole.replace('"id": "2"', '"id": 2x')):
        path.write_text(broken)
        index_job.refresh(store, found(spark, roots), now_ms=2)
        t = store.tables()
        assert message_keys(t) == ["1", "2"] and t["session"].count() == 1
        assert t["source_file"].first()["last_error"]
    h = t["adapter_health"].first()
    assert (h["last_success_ms"], h["error_count"]) == (1, 2) and h["last_error"]
    path.write_text(json.dumps(chat("3")))
    index_job.refresh(store, found(spark, roots), now_ms=3)
    t = store.tables()
    assert message_keys(t) == ["3"] and t["source_file"].first()["last_error"] is None and t["adapter_health"].first()["last_success_ms"] == 3
    path.unlink()
    os.mkfifo(path)  # a new file that cannot be read stands in the table with its error
    fake = spark.createDataFrame([("gemini", str(chats / "session-2.json"), 1, 1, 5, 1, "h", 5, 0)], FOUND)
    index_job.refresh(store, fake, now_ms=4)
    row = store.tables()["source_file"].where("path like '%session-2.json'").first()
    assert row["last_error"] == "No such file or directory" and row["scanned_bytes"] == 0 and message_keys(store.tables()) == ["3"]


def test_files_that_change_while_they_are_read(spark, tmp_path):
    path, other = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    write(path, [say(1), say(2)])
    write(other, [say(3, "s2")])
    store = index_job.Store(spark, str(tmp_path / "store"))
    index_job.refresh(store, found(spark, ("claude", tmp_path)))
    write(path, [say(4)])
    planned = found(spark, ("claude", tmp_path))
    planned.count()
    write(path, [say(5), say(6), say(7)])  # after it was found, before it is read
    index_job.refresh(store, planned)
    assert message_keys(store.tables()) == ["u3", "u5", "u6", "u7"]
    assert index_job.refresh(store, found(spark, ("claude", tmp_path))) is None
    # One that never stands still keeps its rows and is reported.
    stop = threading.Event()

    def rewrite():
        n = 0
        while not stop.is_set():
            n += 1
            tmp = tmp_path / "tmp"
            write(tmp, [say(8, text=f"v{n}")])
            os.replace(tmp, path)
            time.sleep(0.002)

    t = threading.Thread(target=rewrite)
    t.start()
    time.sleep(0.05)
    try:
        index_job.refresh(store, found(spark, ("claude", tmp_path)))
    finally:
        stop.set()
        t.join()
    assert message_keys(store.tables()) == ["u3", "u5", "u6", "u7"]
    errors = {r["path"].rsplit("/")[-1]: r["last_error"] for r in store.tables()["source_file"].collect()}
    assert "changed 3 times" in errors["a.jsonl"] and errors["b.jsonl"] is None
    index_job.refresh(store, found(spark, ("claude", tmp_path)))
    assert message_keys(store.tables()) == ["u3", "u8"]


def parts(folder):
    return {str(p.relative_to(folder)) for p in folder.rglob("*.parquet")}


def test_a_run_writes_what_changed(spark, tmp_path):
    logs, folder = tmp_path / "logs", tmp_path / "store"
    logs.mkdir()
    for i in range(1000):
        write(logs / f"f{i:04d}.jsonl", [say(i % 50 + 1, f"s{i}")])
    store = index_job.Store(spark, str(folder), buckets=64)
    index_job.refresh(store, found(spark, ("claude", logs)))
    first, before = store.manifest(), parts(folder)
    rows = sorted(map(repr, store.tables()["message"].collect()))
    write(logs / "f0007.jsonl", [say(51, "s7")], "a")
    index_job.refresh(store, found(spark, ("claude", logs)))
    new = parts(folder) - before
    count = {t: sum(p.startswith(t + "/") for p in new) for t in index_job.TABLES}
    assert {t: n for t, n in count.items() if t in ("message", "session", "source_file", "adapter_health", "ordinal")} == {"message": 1, "session": 1, "source_file": 1, "adapter_health": 1, "ordinal": 1}
    assert count["failure"] == count["observation"] == 0
    now = store.tables()
    assert now["message"].count() == 1001 and now["session"].count() == 1000 and now["source_file"].count() == 1000
    assert now["session"].where("external_id = 's7'").first()["message_count"] == 2
    assert sorted(map(repr, store.tables(first)["message"].collect())) == rows  # the version before is whole
    # A run that dies before its pointer is written leaves no trace; one that began from an older version is refused.
    with pytest.raises(ZeroDivisionError):
        store.commit(Boom(now), {"counter": [0]}, store.manifest())
    assert store.tables()["message"].count() == 1001
    with pytest.raises(index_job.store.Conflict):
        store.commit({"counter": now["counter"]}, {"counter": [0]}, first)
    assert store.vacuum(keep=1) > 0 and store.tables()["message"].count() == 1001


class Boom(dict):
    """Tables of which the second breaks the run."""

    def __init__(self, tables):
        super().__init__(counter=tables["counter"])

    def items(self):
        yield "counter", self["counter"]
        raise ZeroDivisionError


def test_same_content_links_and_overflow_of_heads(spark, tmp_path):
    a = tmp_path / "a.jsonl"
    write(a, [say(1), say(2)])
    store = index_job.Store(spark, str(tmp_path / "store"))
    index_job.refresh(store, found(spark, ("claude", tmp_path)))
    ids = sorted(r["id"] for r in store.tables()["message"].collect())
    os.replace(shutil.copy(a, tmp_path / "copy"), a)  # an atomic save of the same bytes
    plan = index_job.plan(found(spark, ("claude", tmp_path)), store.tables()["source_file"]).first()
    assert plan["action"] == "same"
    index_job.refresh(store, found(spark, ("claude", tmp_path)))
    assert sorted(r["id"] for r in store.tables()["message"].collect()) == ids
    assert index_job.refresh(store, found(spark, ("claude", tmp_path))) is None
    write(a, [say(3, text="long " * 2000)], "a")  # grows over the head that was hashed
    assert index_job.plan(found(spark, ("claude", tmp_path)), store.tables()["source_file"]).first()["action"] == "append"
    index_job.refresh(store, found(spark, ("claude", tmp_path)))
    assert set(ids) < {r["id"] for r in store.tables()["message"].collect()}
    names = lambda n: spark.createDataFrame([("s1", n, "index")] if n else [], "external_id string, name string, origin string")
    assert index_job.apply_titles(store, names("From a side file")) and store.tables()["session"].first()["generated_title"] == "From a side file"
    assert index_job.apply_titles(store, names("From a side file")) is None
    assert index_job.apply_titles(store, names(None)) and store.tables()["session"].first()["generated_title"] is None
    os.link(a, tmp_path / "b.jsonl")  # a second name is a file of its own, not a move
    index_job.refresh(store, found(spark, ("claude", tmp_path)))
    files = {r["path"].rsplit("/")[-1]: r["id"] for r in store.tables()["source_file"].collect()}
    assert set(files) == {"a.jsonl", "b.jsonl"} and len(set(files.values())) == 2
    assert store.tables()["move_alias"].count() == 0 and store.tables()["message"].count() == 6

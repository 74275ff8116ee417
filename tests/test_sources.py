"""Reading, parsing and incremental ingest of log files."""

import json
import os
import sqlite3

import pytest

from threadlake.operators import ingest
from threadlake.sources import adapters, discovery, jsonl, side_files, verified
from threadlake.streaming import tail


def lines(spark, agent, records, path=None):
    rows, at = [], 0
    for r in records:
        raw = r if isinstance(r, str) else json.dumps(r)
        rows.append((agent, path or f"/logs/{agent}/proj/chats/s1.jsonl", at, len(raw.encode()), raw))
        at += len(raw.encode()) + 1
    return spark.createDataFrame(rows, jsonl.SCHEMA)


def test_lines_with_offsets(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_bytes(b'{"a":1}\r\n\n{"b":"\xc3\xa9"}\nunfinished')
    for split in (64, 3, 1):
        got = [(r["byte_offset"], r["byte_length"], r["raw"]) for r in jsonl.read_lines(spark, [("x", str(p), 0, None)], split).orderBy("byte_offset").collect()]
        assert got == [(0, 7, '{"a":1}'), (10, 10, '{"b":"é"}')]
    assert jsonl.last_newline(str(p), 0) == 21
    assert jsonl.read_range(str(p), 10, 10).decode() == '{"b":"é"}'
    assert jsonl.read_lines(spark, [("x", str(p), 10, 15)]).count() == 0
    with pytest.raises(OSError, match="not a regular file"):
        jsonl.open_regular("/dev/null")


def test_block_records(spark):
    records = [
        {"type": "user", "uuid": "u1", "sessionId": "s", "cwd": "/w", "timestamp": "2026-01-02T03:04:05Z", "message": {"content": "Résumé please"}},
        {"type": "assistant", "uuid": "u2", "sessionId": "s", "message": {"id": "m1", "model": "mod", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "ok"}, {"type": "tool_use", "name": "Read", "input": {"b": 1, "a": "x"}}], "usage": {"input_tokens": 5, "output_tokens": 2, "cache_read_input_tokens": 1, "output_tokens_details": {"thinking_tokens": 9}}}},
        {"type": "user", "uuid": "u3", "sessionId": "s", "message": {"content": [{"type": "tool_result", "content": [{"type": "text", "text": "boom"}], "is_error": True}]}},
        "not json {",
        {"type": "progress", "uuid": "u4"},
        {"type": "assistant", "uuid": "u5", "sessionId": "s", "isSidechain": True, "message": {"content": [{"type": "image", "source": {"data": "x"}}]}},
    ]
    rows = adapters.claude(lines(spark, "claude", records)).orderBy("byte_offset").collect()
    assert [(r["role"], r["prose"], r["tool_invocation"], r["tool_output"], r["reasoning"], r["has_error"]) for r in rows] == [
        ("user", "Résumé please", "", "", "", False),
        ("assistant", "ok", 'Read {"a":"x","b":1}', "", "hm", False),
        ("tool_result", "", "", "boom", "", True),
        ("assistant", "", "", "", "", False),
    ]
    assert {r["ts"] for r in rows} == {1_767_323_045_000}
    assert (rows[1]["model"], rows[1]["dedupe_key"], rows[1]["input_tokens"], rows[1]["cache_write_tokens"], rows[1]["reasoning_tokens"]) == ("mod", "m1", 5, None, 9)
    assert rows[3]["has_non_text"] and rows[3]["is_sidechain"] and not rows[1]["has_non_text"]
    flags = ingest.derive(adapters.claude(lines(spark, "claude", records))).orderBy("byte_offset").select("section_flags").collect()
    assert [f[0] for f in flags] == [1, 7, 2, 8]


def test_rollout_records(spark):
    item = lambda **p: {"type": "response_item", "payload": p}
    records = [
        {"type": "session_meta", "timestamp": 1_700_000_000, "payload": {"id": "sess", "cwd": "/w", "model": "m-a"}},
        item(type="message", role="user", content=[{"type": "input_text", "text": "go"}]),
        {"type": "turn_context", "payload": {"cwd": "/v", "model": "m-b"}},
        item(type="reasoning", summary=[{"type": "summary_text", "text": "think"}]),
        item(type="function_call", name="sh", call_id="c1", arguments='{"x":1}'),
        item(type="function_call_output", call_id="c1", output="bad", status="failed"),
        {"type": "token_usage_record", "payload": {"response_id": "r1", "usage": {"input_tokens": 1000, "output_tokens": 200, "cached_input_tokens": 3}}},
        {"type": "event_msg", "payload": {"type": "turn_aborted", "reason": "stopped"}},
        item(type="web_search"),
    ]
    rows = adapters.codex(lines(spark, "codex", records)).orderBy("byte_offset").collect()
    assert [(r["kind"], r["role"], r["cwd"], r["has_error"]) for r in rows if r["kind"] == "message"] == [("message", "user", "/w", False), ("message", "assistant", "/v", False), ("message", "tool_use", "/v", False), ("message", "tool_result", "/v", True)]
    assert [r["source_key"].split(":")[0] for r in rows if r["kind"] == "message"][2:] == ["function_call", "function_call_output"]
    assert rows[2]["tool_invocation"] == 'sh {"x":1}' and rows[1]["reasoning"] == "think"
    use = next(r for r in rows if r["kind"] == "usage")
    assert (use["model"], use["dedupe_key"], use["input_tokens"], use["cache_read_tokens"], use["external_id"]) == ("m-b", "r1", 1000, 3, "sess")
    assert next(r for r in rows if r["kind"] == "event")["prose"] == "stopped"


def test_chat_records(spark):
    msgs = [{"id": "1", "type": "user", "content": "hi", "timestamp": "2026-01-02T03:04:05Z"}, {"id": "2", "type": "gemini", "model": "g", "content": [{"text": "yes"}], "thoughts": [{"subject": "s", "description": "d"}], "tokens": {"input": 4, "thoughts": 2}, "toolCalls": [{"name": "ls", "args": {"p": "."}, "status": "success", "result": [{"functionResponse": {"response": {"error": "denied"}}}]}]}]
    records = [{"sessionId": "q", "$set": {"messages": msgs}}, {"id": "3", "type": "warning", "content": "w"}, {"id": "4", "type": "error", "content": "e"}, {"id": "5", "type": "other", "content": "no"}]
    rows = adapters.gemini(lines(spark, "gemini", records)).orderBy("byte_offset", "item").collect()
    assert [(r["source_key"], r["role"], r["prose"], r["has_error"], r["external_id"]) for r in rows] == [("1", "user", "hi", False, "q"), ("2", "assistant", "yes", True, "q"), ("3", "system", "w", False, "q"), ("4", "system", "e", True, "q")]
    assert (rows[1]["reasoning"], rows[1]["tool_output"], rows[1]["tool_invocation"], rows[1]["reasoning_tokens"]) == ("d", "denied", 'ls {"p":"."}', 2)
    assert adapters.gemini(lines(spark, "gemini", ['{"sessionId":"q","messages":[{"id":"1","type":"user"'])).count() == 0


def test_discovery(tmp_path):
    for name in ("p/a.jsonl", "p/.hidden/b.jsonl", "p/note.txt", "q/C.JSONL"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("{}\n")
    found = discovery.discover("claude", str(tmp_path))
    assert [os.path.relpath(f["path"], tmp_path) for f in found.files] == ["p/a.jsonl", "q/C.JSONL"] and not found.failures
    assert len(discovery.discover("claude", str(tmp_path), [str(tmp_path / "p")]).files) == 1
    assert len(discovery.discover("claude", str(tmp_path), [str(tmp_path.parent)]).files) == 2
    assert discovery.discover("claude", str(tmp_path), [str(tmp_path / "gone")]) == ([], [])
    assert discovery.discover("claude", str(tmp_path / "none")).failures
    (tmp_path / "repo/.git").mkdir(parents=True)
    (tmp_path / "repo/sub").mkdir()
    assert discovery.canonical_directories([str(tmp_path / "repo/sub")]) == {str(tmp_path / "repo/sub"): str(tmp_path / "repo")}


def test_discovery_in_tasks(spark, tmp_path):
    for name in ("p/a.jsonl", "p/.hidden/b.jsonl", "p/note.txt", "q/C.JSONL", "q/deep/er/d [1].jsonl", "q/deep/e%20.jsonl"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("{}\n")
    os.mkfifo(tmp_path / "q" / "pipe.jsonl")
    roots = spark.createDataFrame([("claude", 5, str(tmp_path) + "/"), ("codex", 6, str(tmp_path / "none"))], "agent string, id int, path string")
    files, failures = verified.discover_in_tasks(roots)
    want = discovery.discover("claude", str(tmp_path))
    assert sorted((f.asDict() for f in files.drop("root_id").collect()), key=lambda f: f["path"]) == want.files
    assert {r["root_id"] for r in files.collect()} == {5}
    told = {(r["agent"], r["path"]) for r in failures.collect()}
    assert told == {("claude", p) for p, _ in want.failures} | {("codex", str(tmp_path / "none"))}


def test_side_files(spark, tmp_path):
    rate = {"modelPattern": "m*", "inputPerMillion": 2}
    good = {"formatVersion": 1, "currency": "USD", "rates": [rate]}
    for bad in ({**good, "formatVersion": 2}, {**good, "currency": "EUR"}, {**good, "rates": [rate, {"modelPattern": "M*"}]}, {**good, "rates": [{"modelPattern": " "}]}, {**good, "rates": [{"modelPattern": "x", "inputPerMillion": -1}]}, {**good, "rates": [{"modelPattern": "x", "unmetered": True, "inputPerMillion": 1}]}):
        with pytest.raises(side_files.PriceFileError):
            side_files.check_rates(bad)
    (tmp_path / "p.json").write_text(json.dumps(good))
    (tmp_path / "o.json").write_text("{}")
    rates, problem = side_files.load_rates(spark, str(tmp_path / "p.json"), str(tmp_path / "o.json"))
    assert rates.count() == 1 and problem
    db = sqlite3.connect(tmp_path / "state_10.sqlite")
    db.execute("CREATE TABLE threads(id, title)")
    db.execute("INSERT INTO threads VALUES ('a', ' From state '), ('b', ' ')")
    db.commit()
    (tmp_path / "state_9.sqlite").write_text("")
    index = side_files.title_index(lines(spark, "codex", [{"id": "a", "thread_name": "old", "updated_at": "1"}, {"id": "c", "thread_name": "x", "updated_at": "2"}, {"id": "c", "thread_name": "y", "updated_at": "2"}]))
    both = side_files.merge_titles(index, side_files.state_titles(spark, str(tmp_path)))
    assert {(r["external_id"], r["name"], r["origin"]) for r in both.collect()} == {("a", "old", "index"), ("c", "y", "index")}


def test_stream_equals_batch_and_appends_once(spark, tmp_path):
    folder, table, check = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "check")
    folder.mkdir()
    rec = lambda i, t: json.dumps({"type": "user", "uuid": f"u{i}", "sessionId": "s", "timestamp": t, "message": {"content": f"text {i}"}}) + "\n"
    (folder / "a.jsonl").write_text(rec(1, 1_700_000_100) + rec(2, 1_700_000_050) + rec(1, 5) + '{"type":"user"')
    tail.ingest(tail.line_stream(spark, str(folder), "claude"), "claude", table, check).awaitTermination()
    assert spark.read.parquet(table).count() == 2
    (folder / "b.jsonl").write_text(rec(3, 1))
    tail.ingest(tail.line_stream(spark, str(folder), "claude"), "claude", table, check).awaitTermination()
    done = spark.read.parquet(table)
    assert sorted(r["source_key"] for r in done.collect()) == ["u1", "u2", "u3"]
    assert {os.path.basename(r["path"]): r["scanned_bytes"] for r in tail.checkpoints(done).collect()}["b.jsonl"] == len(rec(3, 1))


def test_growing_files_exactly_once(spark, tmp_path):
    """Three triggers, each a restart, over files that grow, one that is replaced and one cut in a line: the batch result, once."""
    root, table, check = tmp_path / "logs", str(tmp_path / "table"), str(tmp_path / "check")
    root.mkdir()
    item = lambda i: json.dumps({"type": "response_item", "payload": {"type": "message", "role": "user", "id": f"m{i}", "content": f"é text {i}"}}) + "\n"
    meta = json.dumps({"type": "session_meta", "timestamp": 1_700_000_000, "payload": {"id": "c1", "cwd": "/w", "model": "m"}}) + "\n"
    turn = json.dumps({"type": "turn_context", "payload": {"cwd": "/v"}}) + "\n"
    a, b = root / "rollout-a.jsonl", root / "rollout-b %20.jsonl"

    def run():
        tail.follow(spark, "codex", str(root), table, check, split=64).awaitTermination()
        return sorted((r["path"].rsplit("/")[-1], r["source_key"], r["external_id"], r["cwd"], r["ts"]) for r in spark.read.parquet(table).where("kind = 'message'").collect())

    a.write_text(meta + item(1) + item(2)[:20])
    assert run() == [("rollout-a.jsonl", "message:m1", "c1", "/w", 1_700_000_000_000)]
    with open(a, "a") as f:
        f.write(item(2)[20:] + turn + item(3))
    b.write_text(meta.replace("c1", "c2") + item(9))
    run()
    with open(a, "a") as f:
        f.write(item(4) + item(4))
    (tmp_path / "new").write_text(meta.replace("c1", "c3") + item(8))
    os.replace(tmp_path / "new", b)
    got = run()
    batch = adapters.codex(jsonl.read_lines(spark, [("codex", str(a), 0, None)])).where("kind = 'message'").collect()
    want = sorted({(r["path"].rsplit("/")[-1], r["source_key"], r["external_id"], r["cwd"], r["ts"]) for r in batch})
    assert [r for r in got if r[0] == "rollout-a.jsonl"] == want and len(want) == 4
    assert [r[1:4] for r in got if r[0] != "rollout-a.jsonl"] == [("message:m8", "c3", "/w"), ("message:m9", "c2", "/w")]
    assert run() == got


def test_nested_object_ranges(spark):
    inner = '{"a": "}]\\"{", "b": [{"c": 1}]}'
    document = ('{"note": "\\"messages\\": [", "messages": 3, "x": {"messages" : \n[' + inner + ', {"é": 2} , {}], "z": [{"no": 1}]}}').encode()
    pieces = [document[a : a + n].decode() for a, n in jsonl.object_ranges(document)]
    assert pieces == [inner, '{"é": 2}', "{}"]
    broken = document[: document.index(b" , {}")] + b', {"open": "never clo\\'
    assert [broken[a : a + n].decode() for a, n in jsonl.object_ranges(broken)] == pieces[:2]
    assert jsonl.object_ranges(b"") == jsonl.object_ranges(b'{"messages": {}}') == []
    long = b'{"messages": [' + b",".join(b'{"t": "%s"}' % (b"\\n" * 200_000) for _ in range(3)) + b"]}"
    assert [n for _, n in jsonl.object_ranges(long)] == [400_009] * 3
    files = spark.createDataFrame([("g", "/a", bytearray(document)), ("g", "/b", None), ("g", "/c", bytearray(b""))], "agent string, path string, content binary")
    rows = jsonl.nested_objects(files).orderBy("byte_offset").collect()
    assert [r["raw"] for r in rows] == pieces and rows[1]["byte_length"] == 9

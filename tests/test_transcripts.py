import json
import os
import tempfile

from knowspark.sources import transcripts as TR


def _lines(spark, objs, raw=None):
    vals = [json.dumps(o) for o in objs] + (raw or [])
    rows = [("f.jsonl", "/d/f.jsonl", "f", i + 1, v) for i, v in enumerate(vals)]
    return spark.createDataFrame(rows, "file_key string, display_path string, stem string, line_no long, value string")


def test_claude_code_keeps_text_turns(spark):
    objs = [
        {"type": "user", "sessionId": "s", "uuid": "u1", "message": {"role": "user", "content": "hello there"}},
        {"type": "assistant", "uuid": "u2", "message": {"role": "assistant", "content": [
            {"type": "thinking", "text": "hmm"}, {"type": "text", "text": "answer"}]}},
        {"type": "user", "isMeta": True, "message": {"role": "user", "content": "meta"}},
        {"type": "assistant", "isSidechain": True, "message": {"role": "assistant", "content": "side"}},
        {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "text": "x"}]}},
    ]
    r = TR.turns(_lines(spark, objs, ["{not json", ""]), "cc", "claude_code").orderBy("line_no").collect()
    assert [(x.role, x.content) for x in r] == [("user", "hello there"), ("assistant", "answer")]
    assert r[0].name == "observed/cc/f.jsonl/u1" and r[0].session == "s" and r[1].session == "f"


def test_generic_default_role(spark):
    objs = [{"speaker": "user", "body": "one"}, {"body": "two"}, {"speaker": "bot", "body": "three"}]
    r = TR.turns(_lines(spark, objs), "g", "generic", role_field="speaker", text_field="body",
                 default_role="user").collect()
    assert sorted(x.content for x in r) == ["one", "two"]
    r = TR.turns(_lines(spark, objs), "g", "generic", role_field="speaker", text_field="body").collect()
    assert [x.content for x in r] == ["one"]
    r = TR.turns(_lines(spark, [{"content": "a"}, {"content": "b"}]), "g", "generic", text_field="content",
                 default_role="user").collect()
    assert len(r) == 2 and r[0].name.endswith("/L1")


def test_gemini_steps(spark):
    objs = [{"step_index": 0, "type": "USER_INPUT", "content": "q"},
            {"step_index": 1, "type": "PLANNER_RESPONSE", "content": "", "thinking": "plan"},
            {"step_index": 2, "type": "VIEW_FILE", "source": "MODEL", "content": "dump"}]
    r = TR.turns(_lines(spark, objs), "gm", "gemini").orderBy("line_no").collect()
    assert [(x.role, x.content) for x in r] == [("user", "q"), ("assistant", "plan")]
    assert r[0].name.endswith("/step_0")


def test_codex_history_and_sessions(spark):
    objs = [{"session_id": "s1", "ts": 1, "text": "typed"},
            {"type": "event_msg", "payload": {"type": "user_message", "message": "hi"}},
            {"type": "event_msg", "payload": {"type": "agent_message", "message": "[external_agent_tool_call: Read] x"}},
            {"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": "dup"}},
            {"type": "event_msg", "payload": {"type": "token_count"}}]
    r = TR.turns(_lines(spark, objs), "cx", "codex").orderBy("line_no").collect()
    assert [(x.role, x.content) for x in r] == [("user", "typed"), ("user", "hi")]


def test_kimi_wire(spark):
    objs = [{"type": "context.append_loop_event", "event": {"type": "content.part", "part": {"type": "text", "text": "out"}}},
            {"type": "context.append_loop_event", "event": {"type": "content.part", "part": {"type": "think", "text": "t"}}},
            {"type": "context.append_message", "message": {"role": "user", "content": [{"type": "text", "text": "in"}],
                                                           "origin": {"kind": "user"}}},
            {"type": "context.append_message", "message": {"role": "user", "content": "r", "origin": {"kind": "cron"}}},
            {"type": "usage.record"}, {"type": "tool.call"}]
    r = TR.turns(_lines(spark, objs), "k", "kimi").orderBy("line_no").collect()
    assert [(x.role, x.content) for x in r] == [("assistant", "out"), ("user", "in")]


def test_read_lines_numbers_blank_and_bad_lines(spark):
    d = tempfile.mkdtemp(prefix="ks-tr-")
    with open(os.path.join(d, "a.jsonl"), "w") as f:
        f.write(json.dumps({"speaker": "user", "body": "first"}) + "\n\n{bad\n")
        f.write(json.dumps({"speaker": "user", "body": "fourth"}) + "\n")
    lines = TR.read_lines(spark, [d])
    r = TR.turns(lines, "g", "generic", role_field="speaker", text_field="body").orderBy("line_no").collect()
    assert [(x.line_no, x.content) for x in r] == [(1, "first"), (4, "fourth")]
    assert r[0].name.endswith("/L1") and r[1].name.endswith("/L4")

"""Session logs read by lines, results of any depth, rejects and sizes."""

import json
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from palaver import api, cli
from palaver.sinks import outputs
from palaver.sources import transcripts


def raw(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "conv_id long, value string")


# --- results of any depth ---
def flat(content):
    """Text of a content value, by recursion."""
    if isinstance(content, str):
        return content
    if isinstance(content, list):
        parts = []
        for b in content:
            if isinstance(b, dict) and b.get("type") == "text":
                parts.append(b.get("text") or "")
            elif isinstance(b, dict) and b.get("type") == "thinking":
                parts.append(f"<thinking>{b.get('thinking') or ''}</thinking>")
            elif isinstance(b, dict) and b.get("type") == "tool_use":
                parts.append(f"[tool:{b.get('name') or ''} {json.dumps(b.get('input', {}), separators=(',', ':'))[:200]}]")
            elif isinstance(b, dict) and b.get("type") == "tool_result":
                parts.append(f"[result: {flat(b.get('content'))[:300]}]")
        return "\n".join(p for p in parts if p)
    return "" if content is None else json.dumps(content, separators=(",", ":"))


def nested(r, depth):
    blocks = []
    for _ in range(r.choice([0, 1, 1, 2, 3])):
        kind = r.choice(["text", "text", "empty", "thinking", "use", "image", "scalar"])
        blocks.append({
            "text": {"type": "text", "text": r.choice(["a", "word " * r.randint(1, 30), "x" * 299, "y" * 300])}, "empty": {"type": "text", "text": ""}, "thinking": {"type": "thinking", "thinking": "hm"},
            "use": {"type": "tool_use", "name": "f", "input": {"k": 1}}, "image": {"type": "image"}, "scalar": 7,
        }[kind])
    if depth:
        inner = r.choice([nested(r, depth - 1), nested(r, depth - 1), "plain", {"k": [1]}, None, []])
        blocks.insert(r.randint(0, len(blocks)), {"type": "tool_result", "content": inner})
    return blocks


def test_results_of_any_depth(spark):
    r = random.Random(4)
    deep = [{"type": "text", "text": "deep"}]
    for _ in range(60):
        deep = [{"type": "tool_result", "content": deep}]
    contents = [nested(r, r.randint(0, 9)) for _ in range(300)] + [deep, [{"type": "text", "text": "t"}, *deep, *deep]]
    for k in (5, 33, 34, 35):
        c = [{"type": "text", "text": "w"}]
        for _ in range(k):
            c = [{"type": "tool_result", "content": c}]
        contents.append(c)
    rows = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(contents)], "i int, c string")
    got = [x.t for x in rows.select("i", transcripts.content_text(F.parse_json("c")).alias("t")).orderBy("i").collect()]
    assert got == [flat(c) for c in contents]


def test_wide_results(spark):
    """Only what is kept of a result is unfolded, however much it holds."""
    wide = [{"type": "tool_result", "content": [{"type": "tool_result", "content": [{"type": "text", "text": str(i)}]} for i in range(20_000)]}]
    assert [x.content for x in transcripts.parse(raw(spark, json.dumps([{"role": "user", "content": wide}]))).collect()] == [flat(wide)]


# --- logs by lines ---
def log(n, seed):
    r = random.Random(seed)
    line = lambda i: r.choice([
        json.dumps({"type": "user", "message": {"content": f"question {i} é"}}), json.dumps({"type": "assistant", "message": {"content": [{"type": "text", "text": "answer " * (i % 50)}]}}),
        json.dumps({"type": "summary", "summary": "s"}), "not json", "", "   ", json.dumps({"type": "user", "message": {"content": " "}}), json.dumps({"type": "user"}),
    ])
    return "\n".join([json.dumps({"type": "user", "message": {"content": "first"}}), *(line(i) for i in range(n))])


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def turns_of(df):
    return sorted((r.conv_id.rpartition("/")[2], r.pos, r.idx, r.role, r.content) for r in df.collect())


def test_logs_in_many_splits_give_the_turns_of_parse(spark, tmp_path, small_splits):
    for k in range(4):
        (tmp_path / f"s{k}.jsonl").write_text(log([2000, 300, 3, 900][k], k) + ("\r\n" if k == 1 else ""), encoding="utf-8")
    (tmp_path / "empty.jsonl").write_text("")
    path = str(tmp_path)
    want = turns_of(transcripts.parse(transcripts.read_files(spark, path)))
    lines = transcripts.read_lines(spark, path)
    assert lines.select("conv_id", "split").distinct().count() > 10
    assert turns_of(transcripts.log_turns(lines)) == want and len(want) > 500
    # through load: those over the limit by lines, the others whole
    turns, rejects = transcripts.load(spark, path, whole_bytes=10_000)
    assert turns_of(turns) == want
    whole_turns, whole_rejects = transcripts.load(spark, path)
    assert turns_of(whole_turns) == want
    reasons = lambda df: sorted((r.conv_id.rpartition("/")[2], r.reason, r["count"]) for r in df.where("reason != 'blank' OR idx IS NULL").groupBy("conv_id", "reason").count().collect() if r.reason in ("no JSON", "other type"))
    assert reasons(rejects) == reasons(whole_rejects)
    for plan in (turns, transcripts.log_turns(lines)):
        assert plan.where("pos IS NULL").count() == 0


def test_large_files_of_other_forms_are_told(spark, tmp_path, small_splits):
    (tmp_path / "talk.txt").write_text("**User**: a\n\n**Assistant**: b\n" * 3000)
    (tmp_path / "one.json").write_text(json.dumps([{"role": "user", "content": "x" * 40_000}]))
    (tmp_path / "numbers.jsonl").write_text('{"a": 1}\n' * 3000 + "[2]\n")
    (tmp_path / "log.jsonl").write_text(log(1500, 9))
    turns, rejects = transcripts.load(spark, str(tmp_path), whole_bytes=10_000)
    assert {r.conv_id.rpartition("/")[2] for r in turns.collect()} == {"log.jsonl"}
    assert {(r.conv_id.rpartition("/")[2]) for r in rejects.where("reason = 'too long'").collect()} == {"talk.txt", "one.json", "numbers.jsonl"}
    turns, rejects = transcripts.load(spark, str(tmp_path), 1000, 10_000)
    assert turns.count() == 0 and rejects.where("reason = 'too long'").count() == 4


# --- rejects ---
def test_every_input_is_a_turn_or_a_reject(spark):
    cases = {
        "hello": [("user", "hello", None)], "  ": [(None, None, "blank")], None: [(None, None, "blank")], "x" * 201: [(None, "x" * 80, "too long")], "[]": [(None, None, "no turns")],
        '[7, {"role": "tool", "content": "t"}, {"role": "user", "content": " "}, {"role": "ai", "content": "a"}]': [(None, "7", "no message"), ("tool", "t", "other role"), ("user", " ", "blank"), ("assistant", "a", None)],
        '{"type":"user","message":{"content":"q"}}\nbad\n{"type":"x"}\n': [("user", "q", None), (None, "bad", "no JSON"), ("x", "", "other type")],
        "You\n\nClaude\nthere": [("user", "", "blank"), ("assistant", "there", None)],
    }
    got = {}
    for r in transcripts.outcomes(raw(spark, *cases), 200).collect():
        got.setdefault(r.conv_id, []).append((r.role if r.reason != "no message" else None, r.content, r.reason))
    assert {list(cases)[k]: sorted(v, key=repr) for k, v in got.items()} == {k: sorted(v, key=repr) for k, v in cases.items()}
    turns = transcripts.parse_checked(raw(spark, *cases), 200)
    assert sorted((r.conv_id, r.content) for r in turns.collect()) == [(0, "hello"), (5, "a"), (6, "q"), (7, "there")]
    assert transcripts.outcomes(raw(spark, "x").limit(0)).count() == 0


def test_bytes_that_are_no_text(spark, tmp_path):
    (tmp_path / "good.txt").write_text("é well", encoding="utf-8")
    (tmp_path / "bad.txt").write_bytes(b"User: caf\xe9 \xff\nAssistant: x")
    turns, rejects = api.load_with_rejects(spark, str(tmp_path))
    assert [r.content for r in turns.collect()] == ["é well"]
    assert [(r.conv_id.rpartition("/")[2], r.reason) for r in rejects.collect()] == [("bad.txt", "not UTF-8")]


def test_sizes_come_with_the_turns(spark, tmp_path):
    for i, n in enumerate((5, 50, 500)):
        (tmp_path / f"t{i}.txt").write_text("x" * n)
    told = Observation("sizes")
    turns, _ = api.load_with_rejects(spark, str(tmp_path), None, told, 20)
    assert len(turns.collect()) == 3
    assert told.get["inputs"] == 3 and told.get["chars"] == 555 and told.get["oversize"] == 2 and told.get["largest"].endswith("t2.txt") and told.get["largest_chars"] == 500
    assert api.load(spark, str(tmp_path), 100).count() == 2


def test_rejects_from_the_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('[{"role": "user", "content": "Never do it that way."}, 5]')
    (tmp_path / "in/b.txt").write_bytes(b"\xff\xfe")
    assert cli.main(["prune", str(tmp_path / "in"), "--output", str(tmp_path / "out"), "--rejects", str(tmp_path / "rejects")]) == 0
    assert [r.content for r in outputs.read_output(spark, str(tmp_path / "out")).collect()] == ["Never do it that way."]
    assert sorted(r.reason for r in outputs.read_output(spark, str(tmp_path / "rejects")).collect()) == ["no message", "not UTF-8"]
    assert "Warning" not in capsys.readouterr().err

"""Operators over turns, rules and the store."""

import random

import pytest
from pyspark.sql import functions as F

from palaver import api, cli
from palaver.functions import patterns as P
from palaver.operators import rules as R
from palaver.operators import turns as O
from palaver.operators.store import RuleStore
from palaver.plans import prune as plans
from palaver.settings import Settings, settings
from palaver.sinks import outputs
from palaver.sources import files, transcripts
from palaver.streaming import sessions

SCHEMA = "conv_id long, pos long, idx long, role string, content string"


def turns(spark, *contents, role="assistant"):
    return spark.createDataFrame([(1, i, i, role, c) for i, c in enumerate(contents)], SCHEMA)


def positions(df):
    return sorted(r.pos for r in df.select("pos").collect())


def test_dedup_keeps_the_last(spark):
    assert positions(O.dedup_keep_last(turns(spark, "A", "B", "A", "C", "B"))) == [2, 3, 4]


def test_recent(spark):
    five = turns(spark, *"abcde")
    for v, want in ((2, [3, 4]), (9, [0, 1, 2, 3, 4]), (0, []), (-1, [])):
        assert positions(O.flag_recent(five, v).where("is_recent")) == want


def test_collapse(spark):
    s = "This sentence is long enough to be collapsed when it comes a second time in a talk."
    out = {r.pos: r.content for r in O.collapse_repeats(turns(spark, s, f"Other. {s}\n\nEnd", "short. short. ")).collect()}
    assert out[0] == s and out[1] == f'Other. [Repeated, unchanged: "{s[:50].rstrip()}..."]\n\nEnd' and out[2] == "short. short. "
    assert [r.content for r in O.collapse_repeats(turns(spark, s, s, role="user")).collect()] == [s, s]


def test_largest(spark):
    sized = turns(spark, *("x" * n for n in (16, 28, 28, 1, 22, 7)))
    assert [r.pos for r in O.largest_turns(sized).orderBy("rank").collect()] == [1, 2, 4, 0, 5]


def test_rules_cap_and_length(spark):
    users = turns(spark, "Never!", *(f"Please never drop column number {i}." for i in range(5)), "please NEVER  drop column number 3.", role="user")
    rules = R.extract_rules(users, most=4).orderBy("rule_pos").collect()
    assert [r.rule for r in rules] == [f"Please never drop column number {i}." for i in range(4)]
    assert R.extract_rules(turns(spark, "Never drop the column.")).count() == 0


def test_forced_rules(spark):
    text = "I told you twice that physical safety matters most of all. Thanks"
    got = R.forced_rules(turns(spark, text, role="user"), R.extract_rules(turns(spark, text, role="user"))).collect()
    assert [r.rule for r in got] == ["I told you twice that physical safety matters most of all."]


def test_merge_and_flags(spark):
    store = spark.createDataFrame([("never drop the header row", 1)], "rule string, first_seen_seq long")
    new = spark.createDataFrame([("never drop the header line", 1), (" never drop the header row ", 2), ("", 3)], "rule string, seq long")
    assert [r.rule for r in R.new_rules(new, store).collect()] == ["never drop the header line"]
    assert [tuple(r) for r in R.merge_rules(new, store).orderBy("first_seen_seq").collect()] == [("never drop the header row", 1), ("never drop the header line", 2)]
    (pair,) = R.near_duplicates(R.new_rules(new, store), store).collect()
    assert pair.overlap == 0.75
    assert R.review_flags(R.near_duplicates(R.new_rules(new, store), store)).first().near_duplicates[0].overlap == 0.75


def test_near_duplicates_against_all_pairs(spark):
    r = random.Random(2)
    rules = sorted({" ".join(r.choice(["never", "drop", "the", "row", "of", "it"]) for _ in range(r.randint(1, 9))) for _ in range(120)})
    new, known = rules[:60], rules[50:]
    grams = {x: {p for p in zip(x.split(), x.split()[1:])} for x in rules}
    want = {(a, b, round(len(grams[a] & grams[b]) / max(len(grams[a]), len(grams[b])), 2)) for a in new for b in known if a != b and grams[a] and grams[b] and len(grams[a] & grams[b]) >= 0.5 * max(len(grams[a]), len(grams[b]))}
    frame = lambda x: spark.createDataFrame([(v,) for v in x], "rule string")
    got = [tuple(x) for x in R.near_duplicates(frame(new), frame(known)).collect()]
    assert len(got) == len(set(got)) and {(a, b, round(o, 2)) for a, b, o in got} == want and len(want) > 50


def test_status(spark):
    for n, want in ((23, "OK"), (24, "APPROACHING"), (30, "FULL")):
        assert R.rules_status(spark.range(n).select(F.col("id").cast("string").alias("rule"))).first().status == want


def test_store(spark, tmp_path):
    store = RuleStore(spark, str(tmp_path / "store"))
    rows = lambda *rules: spark.createDataFrame([(r, i) for i, r in enumerate(rules)], "rule string, seq long")
    assert store.load().count() == 0
    assert store.merge(rows("a rule", "b rule")) is None and store.merge(rows("a rule")) == "unchanged"
    assert store.merge(rows("c rule")) is None and [r.rule for r in store.load().orderBy("first_seen_seq").collect()] == ["a rule", "b rule", "c rule"]
    assert store.merge(rows("x" * 1300)) == "too long" and store.load().count() == 3
    # a version that was cut off doesn't count
    spark.range(1).select(F.lit("d").alias("rule"), F.lit(1).cast("long").alias("first_seen_seq")).write.parquet(str(tmp_path / "store/rules/v000000009"))
    assert store.load().count() == 3
    assert spark.read.parquet(str(tmp_path / "store/audit")).count() == 4
    assert RuleStore.refusal(["a"], [str(i) for i in range(22)]) == "sudden increase" and RuleStore.refusal([], []) == "empty"
    assert api.rules_status(store).first().n_rules == 3


def test_stats_of_nothing(spark):
    assert plans.prune_stats(turns(spark).limit(0)).count() == 0
    row = plans.prune_stats(turns(spark, "", "Show more")).first()
    assert (row.orig_turns, row.final_turns, row.final_tokens) == (2, 0, 0)


def test_nulls_do_not_crash(spark):
    rows = spark.createDataFrame([(1, 0, 0, "user", None), (None, None, None, None, "never do it this way"), (1, 1, 1, "assistant", "x")], SCHEMA)
    for p in P.PRESCRIPTIONS:
        plans.prune(rows, 1, p).collect()
    R.extract_rules(rows).collect()


def test_a_null_conversation_is_a_conversation(spark):
    """Each operator gives a null conversation what it gives another one; turns without a place stay."""
    s = "This sentence is long enough to be collapsed when it comes a second time in a talk."
    talk = [("user", "Never drop a column."), ("assistant", s), ("user", "same"), ("assistant", f"Other. {s}"), ("user", "same"), ("user", "last")]
    rows = spark.createDataFrame([(c, i, i, role, text, 7) for c in (1, None) for i, (role, text) in enumerate(talk)] + [(1, None, None, "user", "same", 7), (1, None, None, "user", "same", 7)], SCHEMA + ", rank int")
    own = lambda df, c: sorted(repr(tuple(r)[1:]) for r in df.where(F.col("conv_id").eqNullSafe(F.lit(c))).where("pos IS NOT NULL").collect())
    for df in (plans.prune(rows, 1, "standard"), O.dedup_keep_last(rows), O.collapse_repeats(rows), O.flag_recent(rows, 2), plans.prune(rows, 1, "aggressive")):
        assert own(df, 1) == own(df, None) and df.where("pos IS NULL").count() == 2 and "rank" in df.columns
    kept = plans.prune(rows.where("pos IS NOT NULL"), 1)
    assert sorted((r.pos, r.content) for r in kept.where("conv_id IS NULL").collect()) == [(0, "Never drop a column."), (1, s), (3, f'Other. [Repeated, unchanged: "{s[:50].rstrip()}..."]'), (4, "same"), (5, "last")]
    stats = plans.prune_stats(rows.where("pos IS NOT NULL"), 1).collect()
    assert len(stats) == 2 and len({tuple(r)[1:] for r in stats}) == 1 and stats[0].final_turns == 5 and stats[0].rules_found == 1
    for df in (plans.diagnosis_text(rows, 1), plans.briefing(rows, 1), plans.prune_summary(rows, 1), R.extract_rules(rows), R.forced_rules(rows, R.extract_rules(rows), ("last one",))):
        df.collect()
    assert plans.briefing(rows.where("pos IS NOT NULL"), 1).select("document").distinct().count() == 1


def test_empty_tables(spark):
    rows = turns(spark, "x").limit(0)
    for df in (plans.prune(rows), plans.diagnose(rows), plans.diagnosis_text(rows), plans.briefing(rows), plans.savings(rows), plans.prune_summary(rows), O.collapse_repeats(rows), O.dedup_keep_last(rows), R.extract_rules(rows)):
        assert df.count() == 0


def test_repeats_within_a_turn(spark):
    s, u = ("This sentence is long enough to be collapsed when it comes again, number %d of them." % k for k in (1, 2))
    out = {r.pos: r.content for r in O.collapse_repeats(turns(spark, f"{s} {u} {s} {s}", f"{u}\n\n{s}", "Short one. Short one.")).collect()}
    mark = lambda x: f'[Repeated, unchanged: "{x[:50].rstrip()}..."]'
    assert out == {0: f"{s} {u} {mark(s)} {mark(s)}", 1: f"{mark(u)}\n\n{mark(s)}", 2: "Short one. Short one."}


def test_triggers_across_full_stops(spark):
    cases = {
        "Please use the thing. here instead, ok. Next": ["Please use the thing. here instead, ok."],
        "use a.b.c instead\nuse the one\nhere instead": ["use a.b.c instead"],
        "One. Use x. y. z instead": ["Use x. y. z instead"],
        "use the thing that is much too far. away from the word instead": [],
        "Never mind.\nuse it. or that instead of this.": ["Never mind.", "use it. or that instead of this."],
    }
    for text, want in cases.items():
        assert [r.rule for r in R.extract_rules(turns(spark, text, role="user")).orderBy("rule_pos").collect()] == want, text


def test_long_rules_are_cut_near_the_trigger(spark):
    early, late = "never " + "word " * 300 + "end.", "word " * 300 + "never ends."
    rules = [r.rule for r in R.extract_rules(turns(spark, early, late, role="user")).orderBy("rule_pos").collect()]
    assert len(rules) == 2 and all(len(r) <= 800 for r in rules) and rules[0].startswith("never word") and rules[0].endswith("word…") and rules[1].endswith("never ends.")


def test_scans_of_texts(spark):
    """One relation serves all strengths; scans that take part in the executed plan, exchanges that are used again counted once."""
    from palaver.queries import overlay

    rows = overlay(spark, "/root/testdata/sf0.001")

    def scans(df):
        df.collect()
        return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("FileScan")

    # places of what is recent, rows, hashes of duplicates, chunks, and rules
    assert scans(plans.prune_stats(rows, 2, "aggressive")) <= 5 and scans(plans.briefing(rows, 2)) <= 5
    assert scans(plans.prune(rows, 2, "gentle")) == 2 and scans(plans.diagnose(rows, 2)) <= 8


def test_formats(spark):
    raw = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "conv_id long, value string")
    got = lambda *texts: [(r.role, r.content) for r in transcripts.parse(raw(*texts)).orderBy("conv_id", "pos").collect()]
    assert got("hi\nMay 16\nSure.\nJun 3\nCan you check?") == [("user", "hi"), ("assistant", "Sure."), ("user", "Can you check?")]
    assert got("**User**: a\n\n[2:30 PM] Claude Sonnet 4.6: b\nc") == [("user", "a"), ("assistant", "b\nc")]
    assert got("You\nhello\nClaude\nthere") == [("user", "hello"), ("assistant", "there")]
    assert got("no label at all") == [("user", "no label at all")] and got("  ") == []
    assert got('[{"role":"human","content":[{"type":"text","text":"a"},{"type":"thinking","thinking":"hm"},{"type":"image"}]}]') == [("user", "a\n<thinking>hm</thinking>")]
    assert got('{"messages":[{"role":"ai","content":"x"},7,{"role":"tool","content":"y"},{"role":"user","content":null}]}') == [("assistant", "x")]
    result = '[{"role":"user","content":[{"type":"tool_use","name":"f","input":{"b":1}},{"type":"tool_result","content":[{"type":"text","text":"ok"}]}]}]'
    assert got(result) == [("user", '[tool:f {"b":1}]\n[result: ok]')]
    assert got('{"type":"user","message":{"content":"q"}}\nnot json\n\n{"type":"assistant","message":{"content":"a"}}\n{"type":"x"}') == [("user", "q"), ("assistant", "a")]
    assert got("## Conversation History\n**User**: a\n**Assistant**: b") == [("user", "a"), ("assistant", "b")]
    # an object without messages is a log without turns; JSON lines that are no objects make the input text
    assert got('{"a": 1}') == [] and got('{"a": 1}\n[2]') == [("user", '{"a": 1}\n[2]')]
    assert got('{"summary": "s"}\n{"type":"user","message":{"content":"q"}}') == [("user", "q")]
    nested = '[{"role":"user","content":[{"type":"tool_result","content":[{"type":"tool_result","content":[{"type":"tool_result","content":"deep"}]}]}]}]'
    assert got(nested) == [("user", "[result: [result: [result: deep]]]")]
    assert got("x\ufdd0y\u0001z") == [("user", "xy\u0001z")]
    assert transcripts.parse_checked(raw("x" * 10), 5).count() == 0 and transcripts.parse_checked(raw("x" * 10), 10).count() == 1


def test_briefing_reads_back(spark):
    talk = spark.createDataFrame([(1, i, i, "user" if i % 2 == 0 else "assistant", f"Message number {i}.") for i in range(6)], SCHEMA)
    document = api.create_briefing(talk, 2).select("conv_id", F.col("document").alias("value"))
    back = transcripts.parse(document).orderBy("pos").collect()
    assert [(r.role, r.content) for r in back] == [("user" if i % 2 == 0 else "assistant", f"Message number {i}.") for i in range(6)]


def test_invariants(spark):
    from palaver.queries import overlay

    rows = overlay(spark, "/root/testdata/sf0.001")
    kept = {p: {(r.conv_id, r.pos) for r in plans.prune(rows, 2, p).collect()} for p in P.PRESCRIPTIONS}
    assert kept["standard"] <= kept["gentle"]
    fences = {(r.conv_id, r.pos): r.content for r in plans.prune(rows, 2, "aggressive").where(F.col("content").contains("```")).collect()}
    assert fences and all("SELECT 1\n\nFROM t" in c for c in fences.values())


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("x" * 3000)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/data.sqlite").write_text("y")
    got = {r.path.rpartition("/")[2]: (r.kb, r.label) for r in files.list_files(spark, str(tmp_path)).collect()}
    assert got == {"a.jsonl": (2, "jsonl"), "data.sqlite": (0, "sqlite")}
    # folders count among the entries; a folder comes before what it holds, and parts are compared one by one
    (tmp_path / "sub/deep").mkdir()
    (tmp_path / "sub/deep/x.db").write_text("z")
    (tmp_path / "sub.txt").write_text("z")
    names = lambda most: sorted(r.path.rpartition("/")[2] for r in files.list_files(spark, str(tmp_path), most).collect())
    assert [names(k) for k in range(1, 7)] == [["a.jsonl"], ["a.jsonl"], ["a.jsonl", "data.sqlite"], ["a.jsonl", "data.sqlite"], ["a.jsonl", "data.sqlite", "x.db"], ["a.jsonl", "data.sqlite", "sub.txt", "x.db"]]
    assert len(files.list_files(spark, f"{tmp_path}/s*").collect()) == 3
    assert files.data_dirs([str(tmp_path), "/none/such"]) == [str(tmp_path)] and files.configured_servers("/none") == []


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/s.jsonl").write_text('{"type":"user","message":{"content":"Never drop the header row."}}\nbad\n{"type":"assistant","message":{"content":"Fine."}}\n')
    store = RuleStore(spark, str(tmp_path / "store"))
    query = sessions.merge_rules_from(sessions.stream_turns(spark, str(tmp_path / "in")), store, str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    assert [r.rule for r in store.load().collect()] == ["Never drop the header row."]


def test_long_rules_in_the_store_are_told(spark, tmp_path):
    store = RuleStore(spark, str(tmp_path / "store"))
    store._save(1, [("x" * 2001, 1)])
    with pytest.warns(UserWarning, match="2001 characters"):
        assert store.load().count() == 1


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    lines = "\n\n".join(f"**{'User' if i % 2 == 0 else 'Assistant'}**: Never drop column {i}." for i in range(12))
    (tmp_path / "talk.txt").write_text(lines)
    assert cli.main(["prune", str(tmp_path / "talk.txt"), "--verbatim", "2", "--output", str(tmp_path / "out")]) == 0
    said = capsys.readouterr().err
    assert "Turns:   12 -> 12" in said and "Rules:   6 kept" in said and "-> Never drop column 8." in said and "WARNING" not in said
    assert outputs.read_output(spark, str(tmp_path / "out")).count() == 12
    assert cli.main(["diagnose", str(tmp_path / "talk.txt"), "--warn-size", "10"]) == 0
    out = capsys.readouterr()
    assert "Correction rules: 6" in " ".join(out.out.split()) and "talk.txt" in out.err
    monkeypatch.setattr("sys.stdin", __import__("io").StringIO(lines))
    assert cli.main(["brief", "-"]) == 0 and "CONVERSATION BRIEFING" in capsys.readouterr().out
    (tmp_path / "claude.json").write_text('{"mcpServers": {"b": {}, "a": {}}}')
    monkeypatch.setenv("PALAVER_HOST_CONFIG", str(tmp_path / "claude.json"))
    assert files.host_config() == str(tmp_path / "claude.json") and cli.main(["discover", str(tmp_path)]) == 0
    assert "a, b" in capsys.readouterr().out
    assert cli.main(["rules-status", str(tmp_path / "none")]) == 0


def test_few_rules_in_a_long_conversation_are_told(spark):
    (row,) = plans.prune_summary(turns(spark, *(f"Plain message {i}." for i in range(12)), role="user"), 2).collect()
    assert "WARNING" in row.summary and "Rules:   0 kept" in row.summary


def test_distinct_turns_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / f"in/s{k}.jsonl").write_text('{"type":"user","message":{"content":"same"}}\n{"type":"user","message":{"content":"same"}}\n')
    timed = sessions.stream_turns(spark, str(tmp_path / "in")).withColumn("at", F.lit("2020-01-01").cast("timestamp"))
    query = sessions.distinct_turns(timed, "at", "1 hour").writeStream.format("memory").queryName("distinct_turns").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("distinct_turns").count() == 2


def test_settings(spark, tmp_path, monkeypatch):
    assert settings(spark) == settings() and settings().verbatim == P.VERBATIM_TURNS and settings().review and settings().rules_store.endswith("/palaver/rules")
    for name, value in (("VERBATIM", "3"), ("MAX_STORE_RULES", "400"), ("REVIEW", "0"), ("RULES_STORE", str(tmp_path / "store"))):
        monkeypatch.setenv(f"PALAVER_{name}", value)
    assert settings() == Settings(3, P.STORE_HARD_MAX, False, str(tmp_path / "store"))
    assert cli.parser().parse_args(["prune", "x"]).verbatim == 3 and cli.parser().parse_args(["rules-status"]).store is None
    spark.conf.set("spark.palaver.max_store_rules", "2")
    try:
        store = RuleStore(spark)
        talk = turns(spark, "Never drop a. Never drop b. Never drop c, please.", role="user")
        rules, flags = api.extract_rules(talk, store)
        assert store.path == str(tmp_path / "store") and store.most == 2 and flags is None and store.load().count() == 2 and rules.count() == 3
        assert api.extract_rules(talk, store, review=True)[1] is not None
    finally:
        spark.conf.unset("spark.palaver.max_store_rules")
    monkeypatch.setenv("PALAVER_VERBATIM", "many")
    with pytest.raises(ValueError, match="verbatim"):
        settings()

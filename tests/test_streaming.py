"""Rules of conversations that come in batches, however these are cut."""

import json
import random

import pytest
from pyspark.sql import functions as F

from palaver.functions import patterns as P
from palaver.operators import rules as R
from palaver.operators import turns as O
from palaver.operators.store import RuleStore
from palaver.streaming import sessions

SCHEMA = "conv_id string, pos long, idx long, role string, content string"


@pytest.fixture(autouse=True)
def state_store(spark):
    spark.conf.set(*sessions.STATE_STORE)
    yield
    spark.conf.unset(sessions.STATE_STORE[0])


def talks(seed):
    """Conversations with repeated rules, several in a turn, and one with more than are kept."""
    r = random.Random(seed)
    out = {}
    for c in range(4):
        n = 30 if c else 60
        text = lambda i: r.choice([f"Never use table {r.randint(0, 6)}. Always ask for row {r.randint(0, 3)}.", "Sorry, I meant the second one here.", f"Plain {i}.", "ok"])
        out[f"talk{c}"] = [(r.choice(["user", "user", "assistant"]), text(i)) if c or i % 2 else ("user", f"Don't do number {i} again!") for i in range(n)]
    return out


def write_batch(folder, name, number, turns):
    lines = [json.dumps({"type": role, "message": {"content": content}}) for role, content in turns]
    (folder / f"{name}.{number}.jsonl").write_text("\nnot json\n".join(lines) + "\n")


@pytest.mark.parametrize("seed", [1, 2])
def test_any_cut_gives_the_rules_of_the_whole(spark, tmp_path, seed):
    own, r = talks(seed), random.Random(seed)
    rows = [(c, i, i, role, text) for c, turns in own.items() for i, (role, text) in enumerate(turns)]
    whole = spark.createDataFrame(rows, SCHEMA)
    want = sorted(tuple(x) for x in R.extract_rules(whole).select("conv_id", "rule_pos", "rule", "rule_key").collect())
    recent = {x.conv_id: x.p for x in O.flag_recent(whole, 4).where("is_recent").groupBy("conv_id").agg(F.min("pos").alias("p")).collect()}
    (tmp_path / "in").mkdir()
    batches = 3
    ends = {c: [0, *sorted(r.randint(0, len(t)) for _ in range(batches - 1)), len(t)] for c, t in own.items()}
    latest = {}
    for k in range(batches):
        for c, turns in own.items():
            write_batch(tmp_path / "in", c, k, turns[ends[c][k] : ends[c][k + 1]])
        stream = sessions.stream_logs(spark, str(tmp_path / "in"))
        query = sessions.found_rules(stream, verbatim=4).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / f"out{k}" if k < 0 else tmp_path / "out"))
        query.awaitTermination(120)
        assert query.exception() is None
    found = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(tuple(x) for x in found.where("rule IS NOT NULL").select("conv_id", "rule_pos", "rule", "rule_key").collect()) == want
    assert max(x[1] for x in want) == P.MAX_RULES
    for x in found.where("recent_from IS NOT NULL").collect():
        latest[x.conv_id] = max(latest.get(x.conv_id, 0), x.recent_from)
    assert latest == recent
    places = {(x.conv_id, x.rule): x.pos for x in found.where("rule IS NOT NULL").collect()}
    assert all(rule.rstrip(".!")[:10] in own[c][pos][1] for (c, rule), pos in places.items())


def test_rules_of_a_stream_reach_the_store_in_order(spark, tmp_path):
    (tmp_path / "in").mkdir()
    store = RuleStore(spark, str(tmp_path / "store"))
    for k, texts in enumerate((["Never use the old plan.", "Always keep the header."], ["Never use the old plan.", "Don't sort the rows twice."])):
        write_batch(tmp_path / "in", "log", k, [("user", t) for t in texts])
        query = sessions.merge_rules_from(sessions.stream_logs(spark, str(tmp_path / "in")), store, str(tmp_path / "c"))
        query.awaitTermination(120)
        assert query.exception() is None
    assert [x.rule for x in store.load().orderBy("first_seen_seq").collect()] == ["Never use the old plan.", "Always keep the header.", "Don't sort the rows twice."]


def test_forgotten_conversations_begin_anew():
    """The timer's work, without a stream."""

    class State(dict):
        def exists(self):
            return bool(self)

        def get(self):
            return self["value"]

        def update(self, value):
            self["value"] = value

        def keys(self):
            return list(super().keys())

        def containsKey(self, key):  # noqa: N802
            return key in self

        def updateValue(self, key, value):  # noqa: N802
            self[key] = value

    class Handle:
        def __init__(self):
            self.timers, self.states = [], {}

        def getValueState(self, name, schema):  # noqa: N802
            return self.states.setdefault(name, State())

        getMapState = lambda self, name, key, value: self.states.setdefault(name, State())  # noqa: E731, N815
        listTimers = lambda self: list(self.timers)  # noqa: E731, N815
        deleteTimer = lambda self, t: self.timers.remove(t)  # noqa: E731, N815
        registerTimer = lambda self, t: self.timers.append(t)  # noqa: E731, N815

    class Now:
        getCurrentProcessingTimeInMs = lambda self: 1000  # noqa: E731, N815

    import pandas as pd

    handle, processor = Handle(), sessions.RulesOfConversation(2, 1, 60)
    processor.init(handle)
    rule = lambda key: {"kind": 0, "unit_no": 0, "rule": key, "rule_key": key}
    batch = lambda *keys: iter([pd.DataFrame({"seq": [(i,) for i in range(len(keys))], "found": [[rule(k)] for k in keys]})])
    rows = lambda frames: [tuple(None if pd.isna(v) else v for v in x) for f in frames for x in f.itertuples(index=False)]
    assert rows(processor.handleInputRows(("c",), batch("a", "a", "b", "x"), Now())) == [("c", 1, 0, "a", "a", None), ("c", 2, 2, "b", "b", None), ("c", None, None, None, None, 3)]
    assert handle.timers == [61_000] and rows(processor.handleInputRows(("c",), batch("z"), Now())) == [("c", None, None, None, None, 4)] and handle.timers == [61_000]
    assert rows(processor.handleExpiredTimer(("c",), Now(), None)) == []
    assert rows(processor.handleInputRows(("c",), batch("a"), Now()))[0] == ("c", 1, 0, "a", "a", None)

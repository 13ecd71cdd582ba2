"""Outputs that are replaced as a whole, saves of a rule store that meet, and briefings in parts."""

import os
import subprocess
import sys
import threading
import time

import pytest
from pyspark.sql import functions as F

from palaver import api
from palaver.operators import store as stores
from palaver.operators import turns as O
from palaver.operators.store import RuleStore
from palaver.plans import prune as plans
from palaver.sinks import outputs
from palaver.sinks.once import Folder, name_of, number_of

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_files_are_created_once(spark, tmp_path):
    folder = Folder(spark, str(tmp_path / "f"))
    won = []
    threads = [threading.Thread(target=lambda k=k: won.append(k) if folder.create("x", f"by {k}") else None) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and folder.text("x") == f"by {won[0]}" and folder.names() == ["x"]
    assert number_of(name_of(12)) == 12 and number_of("other") == -1
    folder.delete("x")
    assert folder.names() == []


def test_a_file_system_without_links(spark, tmp_path):
    """Where there are no hard links, files are renamed into place."""
    folder = Folder(spark, str(tmp_path / "f"))
    folder._local = None
    assert folder.create("x", "é") and folder.text("x") == "é" and folder.names() == ["x"]


def test_outputs(spark, tmp_path):
    path = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        outputs.read_output(spark, path)
    for n in (3, 4, 5):
        outputs.write_output(spark.range(n), path)
    assert outputs.read_output(spark, path).count() == 5
    assert len([d for d in os.listdir(path) if d.startswith("data-")]) == 2  # the current one and the one before it

    class Broken(Exception):
        pass

    with pytest.raises(Broken), outputs.staged(spark, path) as out:
        spark.range(9).write.parquet(out.folder)
        spark.range(9).write.parquet(out.side("more"))
        raise Broken
    assert outputs.read_output(spark, path).count() == 5
    assert len(outputs.sweep(spark, path)) == 1 and outputs.sweep(spark, path) == [] and outputs.read_output(spark, path).count() == 5


KILLED = """
import sys, time
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from palaver.sinks import outputs
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
def slow(batches):
    for b in batches:
        time.sleep(60)
        yield b
outputs.write_output(spark.range(100).repartition(2).mapInPandas(slow, "id long"), {path!r})
"""


def test_a_killed_run_leaves_the_old_result(spark, tmp_path):
    path = str(tmp_path / "out")
    outputs.write_output(spark.range(7), path)
    run = subprocess.Popen([sys.executable, "-c", KILLED.format(root=ROOT, path=path)], stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    began = time.time()
    while time.time() - began < 90 and len([d for d in os.listdir(path) if d.startswith("data-")]) < 2:
        time.sleep(0.2)
    assert len([d for d in os.listdir(path) if d.startswith("data-")]) == 2
    run.kill()
    run.wait()
    assert outputs.read_output(spark, path).count() == 7
    outputs.write_output(spark.range(8), path)
    assert outputs.read_output(spark, path).count() == 8


# --- the rule store ---
def rules(spark, *texts):
    return spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "rule string, seq long")


def test_savers_at_once_lose_no_rule(spark, tmp_path):
    path, said = str(tmp_path / "store"), []
    RuleStore(spark, path).merge(rules(spark, "the first rule"))

    def save(k):
        said.append(RuleStore(spark, path).merge(rules(spark, f"rule {k} a", f"rule {k} b")))

    threads = [threading.Thread(target=save, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    found = [r.rule for r in RuleStore(spark, path).load().orderBy("first_seen_seq").collect()]
    assert said == [None] * 4 and found[0] == "the first rule" and sorted(found[1:]) == sorted(f"rule {k} {x}" for k in range(4) for x in "ab")
    assert len(os.listdir(f"{path}/rules")) == 5  # what lost its number is gone


def test_a_saver_that_comes_second_merges_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    slow, quick, met = RuleStore(spark, path), RuleStore(spark, path), []
    save = RuleStore._save

    def between(self, version, rows):
        if self is slow and not met:
            met.append(quick.merge(rules(spark, "came in between")))
        return save(self, version, rows)

    monkeypatch.setattr(RuleStore, "_save", between)
    assert slow.merge(rules(spark, "was loaded before")) is None and met == [None]
    assert [r.rule for r in quick.load().orderBy("first_seen_seq").collect()] == ["came in between", "was loaded before"]


def test_damaged_versions_give_way(spark, tmp_path):
    """However many: the latest whole one counts, and new ones go on from the highest number."""
    path = str(tmp_path / "store")
    store = RuleStore(spark, path)
    store.merge(rules(spark, "a good rule"))
    manifests = Folder(spark, f"{path}/manifest")
    for k in range(2, 70):
        manifests.create(name_of(k), "{" if k % 2 else '{"n": 1, "checksum": "x", "folder": "none"}')
    assert [r.rule for r in store.load().collect()] == ["a good rule"]
    assert store.merge(rules(spark, " a later rule ", "a later rule")) is None and number_of(manifests.names()[-1]) == 70
    assert [r.rule for r in store.load().orderBy("first_seen_seq").collect()] == ["a good rule", "a later rule"]
    assert stores.checksum(["a"]) != stores.checksum(["b"])


# --- briefings in parts ---
SCHEMA = "conv_id long, pos long, idx long, role string, content string"


def test_parts_joined_are_the_document(spark, tmp_path):
    talk = [("user", "Never drop a column."), ("assistant", "Certainly! Here it is.\n\nThe body of it."), ("user", ""), ("assistant", "Show more"), ("user", "x" * 500)]
    rows = [(c, i, i, *talk[(i * 7 + (c or 0)) % 5]) for c in (1, 2, None) for i in range(700 if c == 1 else 40)] + [(3, 0, 0, "user", ""), (1, None, None, "user", "without a place")]
    turns = spark.createDataFrame(rows, SCHEMA)
    want = {r.conv_id: r.document for r in plans.briefing(turns, 3, "standard", "today").collect()}
    api.write_briefings(turns, str(tmp_path / "b"), 3, "standard", "today")
    for most in (1, 5000, 1 << 20):
        plans.write_briefings(turns, str(tmp_path / "b"), 3, "standard", "today", most)
        for found in (outputs.read_output(spark, str(tmp_path / "b")), plans.briefing_parts(turns, 3, "standard", "today", most)):
            parts = {}
            for r in sorted(found.collect(), key=lambda r: r.part):
                parts.setdefault(r.conv_id, []).append(r.text)
            assert {c: "".join(p) for c, p in parts.items()} == want
            assert len(parts[1]) > (2 if most < 1 << 20 else 1)
            if most == 5000:
                assert max(len(t) for t in parts[1][1:]) <= 5000 + 64 * 520
    assert plans.briefing_parts(turns.limit(0)).count() == 0


def test_running_parts_go_over_regions(spark):
    rows = spark.range(3000).select(F.lit(1).alias("conv_id"), (F.col("id") * 3).alias("pos"))
    got = {r.block: r.part for r in O.running_parts(rows, F.lit(2), 100, 30, 4).collect()}
    assert got == {b: b * 10 * 2 // 100 for b in range(300)}


def test_texts_of_a_briefing_travel_cleaned_and_not_to_small_tables(spark, tmp_path):
    spark.createDataFrame([(i % 2, i, i, "assistant", f"Body {i}. " * 30) for i in range(200)], SCHEMA).write.parquet(f"{tmp_path}/turns")

    def kept(df):
        df.write.parquet(f"{tmp_path}/blocks")
        return spark.read.schema(df.schema).parquet(f"{tmp_path}/blocks")

    parts = plans.history_parts(spark.read.parquet(f"{tmp_path}/turns"), 2, "standard", 5000, kept)
    plan = parts._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    moved = [x.split("Input")[1].split("\n")[0] for x in plan.split("\n\n") if ") Exchange" in x.split("\n")[0]]
    assert moved and not any("content#" in x for x in moved)
    before = spark.conf.get(plans.CLEANUP, None)
    api.write_briefings(spark.read.parquet(f"{tmp_path}/turns"), f"{tmp_path}/b")
    assert spark.conf.get(plans.CLEANUP, None) == before

"""Session logs as a stream: new JSONL lines become turns, conversations keep what their rules need from batch to batch, and rules are merged into the store.

A conversation's state is small whatever its length: how many turns it had, the keys of the rules found, of which there are ``MAX_RULES`` at most, and the places of its last
turns. So any way to cut a log into batches gives the rules of the whole. State is forgotten when nothing has come for a while.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from palaver.functions import patterns as P
from palaver.functions import text as T
from palaver.operators import rules as R
from palaver.operators.store import RuleStore
from palaver.sources.transcripts import content_text

#: The state store that ``found_rules`` needs, as a setting of the session.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: A log's name and the number of its file, if it is written in several.
LOG_FILE = r"([^/]+?)(?:\.(\d+))?\.[^./]+\z"


def stream_turns(spark: SparkSession, path: str) -> DataFrame:
    """conv_id (file), role, content of each line that is a turn; these turns have no order."""
    lines = spark.readStream.text(path).select(F.col("_metadata.file_path").alias("conv_id"), F.try_parse_json("value").alias("v"))
    turns = lines.select("conv_id", F.try_variant_get("v", "$.type", "string").alias("role"), content_text(F.try_variant_get("v", "$.message.content", "variant")).alias("content"))
    return turns.where(F.col("role").isin("user", "assistant") & F.col("content").rlike(r"\S"))


def stream_logs(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """conv_id (the log's name), seq (file and line), role and content of each turn of logs that are written as files NAME.NUMBER.jsonl, ``files`` of them in a batch at most.

    A batch reads whole files; a file's lines are in order, and files are by their number.
    """
    read = spark.readStream.option("maxFilesPerTrigger", files).text(path, wholetext=True)
    of = lambda k: F.regexp_extract(F.col("_metadata.file_path"), LOG_FILE, k)
    lines = read.select(of(1).alias("conv_id"), F.coalesce(F.nullif(of(2), F.lit("")).cast("long"), F.lit(0).cast("long")).alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    parsed = lines.select("conv_id", F.struct("file", F.col("line").cast("long").alias("line")).alias("seq"), F.try_parse_json("value").alias("v"))
    turns = parsed.select("conv_id", "seq", F.try_variant_get("v", "$.type", "string").alias("role"), content_text(F.try_variant_get("v", "$.message.content", "variant")).alias("content"))
    return turns.where(F.col("role").isin("user", "assistant") & F.col("content").rlike(r"\S"))


def distinct_turns(turns: DataFrame, time_col: str, delay: str) -> DataFrame:
    """First turn of each content within the watermark; the state is bounded by ``delay``."""
    return turns.withColumn("hash", T.content_hash(F.col("content"))).withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["conv_id", "hash"])


FOUND = "conv_id {0}, rule_pos long, pos long, rule string, rule_key string, recent_from long"


class RulesOfConversation(StatefulProcessor):
    """Numbers a conversation's turns and passes on the rules that are new to it, up to ``most``; then where its last ``verbatim`` turns begin."""

    def __init__(self, most: int, verbatim: int, forget_after_s: int):
        self.most, self.verbatim, self.forget_after_s = most, verbatim, forget_after_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getValueState("turns", "n long")
        self.known = handle.getMapState("known", "rule_key string", "rule_pos long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        n = self.turns.get()[0] if self.turns.exists() else 0
        known = sum(1 for _ in self.known.keys()) if self.known.exists() else 0
        batch = [(*seq, found) for frame in rows for seq, found in zip(frame["seq"], frame["found"], strict=True)]
        batch.sort(key=lambda x: x[0])
        out = []
        for _, found in batch:
            for f in sorted((f for f in found if known < self.most), key=lambda f: (f["kind"], f["unit_no"])):
                if known < self.most and not self.known.containsKey((f["rule_key"],)):
                    known += 1
                    self.known.updateValue((f["rule_key"],), (known,))
                    out.append((key[0], known, n, f["rule"], f["rule_key"], None))
            n += 1
        self.turns.update((n,))
        out.append((key[0], None, None, None, None, max(0, n - self.verbatim) if self.verbatim > 0 else n))
        if self.forget_after_s:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + 1000 * self.forget_after_s)
        frame = pd.DataFrame(out, columns=["conv_id", "rule_pos", "pos", "rule", "rule_key", "recent_from"])
        yield frame.astype({c: "Int64" for c in ("rule_pos", "pos", "recent_from")})

    def handleExpiredTimer(self, key, timer_values, expired_timer) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.turns.clear()
        self.known.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def found_rules(turns: DataFrame, most: int = P.MAX_RULES, verbatim: int = P.VERBATIM_TURNS, forget_after_s: int = 0, terms: tuple[str, ...] = P.SAFETY_TERMS) -> DataFrame:
    """New rules of a stream of turns (conv_id, seq, role, content), as ``extract_rules`` numbers them: conv_id, rule_pos, pos, rule and rule_key.

    Each batch also gives a row with ``recent_from`` for each conversation that it has turns of: the place from which on turns are recent. Within a batch turns are in the order of ``seq``, and batches come in
    order. Texts stay where they are read; sentences with triggers travel. A conversation without turns for ``forget_after_s`` seconds (0: for ever) begins anew. The session
    needs the setting ``STATE_STORE``.
    """
    sentences = F.filter(R.sentences(F.col("content"), terms), lambda f: R.is_rule(f["rule"], terms))
    keyed = F.transform(sentences, lambda f: F.struct(f["kind"].alias("kind"), f["unit_no"].alias("unit_no"), f["rule"].alias("rule"), R.rule_key(f["rule"]).alias("rule_key")))
    triggered = (F.col("role") == "user") & (F.col("content").rlike(P.CORRECTION) | F.col("content").rlike(P.IMPLICIT_CORRECTION))
    found = F.coalesce(F.when(triggered, keyed), F.array().cast("array<struct<kind:int,unit_no:int,rule:string,rule_key:string>>"))
    rows = turns.select("conv_id", F.struct("seq").alias("seq"), found.alias("found"))
    kind = dict(turns.dtypes)["conv_id"]
    processor = RulesOfConversation(most, verbatim, forget_after_s)
    return rows.groupBy("conv_id").transformWithStateInPandas(processor, FOUND.format(kind), "Append", "ProcessingTime" if forget_after_s else "None")


def merge_rules_from(turns: DataFrame, store: RuleStore, checkpoint: str) -> StreamingQuery:
    """Start a query that merges the rules of each batch into the store: those new to their conversation if turns have a ``seq``, else those of the batch."""
    stateful = "seq" in turns.columns
    rows = found_rules(turns) if stateful else turns

    def merge(batch: DataFrame, batch_id: int) -> None:
        rules = batch.where("rule IS NOT NULL") if stateful else R.extract_rules(batch.withColumn("pos", F.lit(0).cast("long")))
        store.merge(rules.select("rule", (F.lit(batch_id) * (P.MAX_RULES + 1) + F.col("rule_pos")).cast("long").alias("seq")))

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

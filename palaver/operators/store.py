"""The rule store: versions of a small table, each with a manifest that is written last, and an audit log.

A version counts once its manifest is there and its checksum holds; otherwise the version before it does. So a save that is cut off changes nothing, and earlier versions are the
backups. A manifest is created once (``sinks.once``): of savers who merge into the same version one gets the next number, and the others load what it saved and merge again,
so no rule is lost. A store holds ``STORE_HARD_MAX`` rules at most, so its checks run on the driver.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.utils import AnalysisException

from palaver.functions import patterns as P
from palaver.functions import text as T
from palaver.operators.rules import merge_rules
from palaver.settings import settings
from palaver.sinks.once import Folder, name_of, number_of

RULES = S.StructType([S.StructField("rule", S.StringType()), S.StructField("first_seen_seq", S.LongType())])


def checksum(rules: list[str]) -> str:
    return hashlib.sha256(json.dumps(rules, ensure_ascii=False).encode("utf-8")).hexdigest()


class RuleStore:
    def __init__(self, spark: SparkSession, path: str | None = None, most: int | None = None):
        """The store at ``path``, of ``most`` rules; by default as the settings say."""
        own = settings(spark)
        self.spark, self.path = spark, (path or own.rules_store).rstrip("/")
        self.most = min(own.max_store_rules if most is None else most, P.STORE_HARD_MAX)

    def _manifests(self) -> Folder:
        return Folder(self.spark, f"{self.path}/manifest")

    def _rows(self, folder: str) -> list[tuple[str, int]]:
        rows = self.spark.read.schema(RULES).parquet(f"{self.path}/rules/{folder}").orderBy("first_seen_seq").collect()
        return [(r[0], r[1]) for r in rows]

    def load(self) -> DataFrame:
        """rule and first_seen_seq of the latest version that is whole; empty if there is none."""
        return self.spark.createDataFrame(self._load()[1], RULES)

    def _load(self) -> tuple[int, list[tuple[str, int]]]:
        """The latest version's number, whole or not, and the rules of the latest that is whole."""
        manifests = self._manifests()
        names = sorted(((number_of(n), n) for n in manifests.names()), reverse=True)
        latest = max([0, *(number for number, _ in names)])
        for _, name in names:
            try:
                told = json.loads(manifests.text(name))
                rows = self._rows(told["folder"])
            except (AnalysisException, ValueError, KeyError, TypeError):
                continue
            if len(rows) == told["n"] and checksum([r[0] for r in rows]) == told["checksum"]:
                longest = max((len(r[0]) for r in rows if r[0] is not None), default=0)
                if longest > P.STORE_WARN_LENGTH:
                    warnings.warn(f"the rule store holds a rule of {longest} characters", stacklevel=3)
                return latest, [r for r in rows if r[0] is not None][: self.most]
        return latest, []

    @staticmethod
    def refusal(old: list[str], new: list[str]) -> str | None:
        """Why ``new`` isn't saved over ``old``, or None."""
        if not new:
            return "empty"
        if any(r is None for r in new):
            return "not a string"
        if len(set(new)) != len(new):
            return "duplicates"
        if any(len(r) > P.STORE_SAVE_LENGTH for r in new):
            return "too long"
        if new == old:
            return "unchanged"
        if len(new) - len(old) > P.STORE_MAX_JUMP and old:
            return "sudden increase"
        if len(new) > P.STORE_HARD_MAX:
            return "over the hard maximum"
        return None

    def merge(self, rules: DataFrame) -> str | None:
        """Merge rules (columns rule, seq) into the store; the reason if nothing was saved."""
        rules = self.spark.createDataFrame(self._wanted(rules), "rule string, seq long")
        while True:
            version, old = self._load()
            merged = merge_rules(rules, self.spark.createDataFrame(old, RULES), self.most).orderBy("first_seen_seq").collect()
            reason = self.refusal([r[0] for r in old], [r[0] for r in merged])
            if reason or self._save(version + 1, [(r[0], r[1]) for r in merged]):
                break
        self._audit("refused: " + reason if reason else "saved", len(merged))
        return reason

    def _wanted(self, rules: DataFrame) -> list[tuple[str, int]]:
        """Those of the rules that can find a place, the first of them: no more than a full store and as many others."""
        own = rules.select(T.strip(F.col("rule")).alias("rule"), F.col("seq").cast("long").alias("seq")).where("rule != ''")
        first = own.groupBy("rule").agg(F.min("seq").alias("seq")).orderBy("seq", "rule").limit(2 * P.STORE_HARD_MAX)
        return [(r["rule"], r["seq"]) for r in first.collect()]

    def _save(self, version: int, rows: list[tuple[str, int]]) -> bool:
        """Write the rows, read them again, and make them the version of this number; false if another saver has."""
        digest, folder = checksum([r[0] for r in rows]), f"v{version:09d}-{uuid.uuid4().hex}"
        self.spark.createDataFrame(rows, RULES).coalesce(1).write.parquet(f"{self.path}/rules/{folder}")
        if checksum([r[0] for r in self._rows(folder)]) != digest:
            raise RuntimeError("the rule store differs from what was written")
        saved_at = datetime.datetime.now(datetime.timezone.utc).isoformat()
        if self._manifests().create(name_of(version), json.dumps({"version": version, "n": len(rows), "checksum": digest, "folder": folder, "saved_at": saved_at})):
            return True
        Folder(self.spark, f"{self.path}/rules").delete(folder)
        return False

    def _audit(self, action: str, n: int) -> None:
        row = self.spark.range(1).select(F.current_timestamp().alias("at"), F.lit(action).alias("action"), F.lit(n).cast("long").alias("n"), F.lit(self.most).cast("long").alias("most"))
        row.write.mode("append").parquet(f"{self.path}/audit")

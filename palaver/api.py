"""What a user calls: transcripts in, DataFrames out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from palaver.functions import patterns as P
from palaver.operators import rules as R
from palaver.operators.store import RuleStore
from palaver.plans import prune as plans
from palaver.settings import settings
from palaver.sources import transcripts


def load(spark: SparkSession, paths: str | list[str], most: int | None = P.MAX_INPUT_CHARS) -> DataFrame:
    """Turns of files; inputs of over ``most`` characters are refused, with None none is."""
    return transcripts.load(spark, paths, most)[0]


def load_with_rejects(spark: SparkSession, paths: str | list[str], most: int | None = P.MAX_INPUT_CHARS, observation: Observation | None = None, warn: int = P.WARN_INPUT_CHARS) -> tuple[DataFrame, DataFrame]:
    """Turns of files, and whatever is no turn with the reason; an action over the turns tells ``observation`` the sizes of the inputs, and how many have over ``warn`` characters."""
    return transcripts.load(spark, paths, most, observation=observation, warn=warn)


def diagnose_conversation(turns: DataFrame, verbatim: int = P.VERBATIM_TURNS) -> DataFrame:
    return plans.diagnose(turns, verbatim)


def prune_conversation(turns: DataFrame, verbatim: int = P.VERBATIM_TURNS, prescription: str = "standard") -> tuple[DataFrame, DataFrame]:
    """The kept turns, and their statistics."""
    return plans.prune(turns, verbatim, prescription), plans.prune_stats(turns, verbatim, prescription)


def create_briefing(turns: DataFrame, verbatim: int = P.VERBATIM_TURNS, prescription: str = "aggressive", stamp: str | None = None) -> DataFrame:
    return plans.briefing(turns, verbatim, prescription, stamp)


def write_briefings(turns: DataFrame, path: str, verbatim: int = P.VERBATIM_TURNS, prescription: str = "aggressive", stamp: str | None = None) -> None:
    """Briefings of conversations of any length, in parts (conv_id, part, text), as the current result at ``path``."""
    plans.write_briefings(turns, path, verbatim, prescription, stamp)


def extract_rules(turns: DataFrame, store: RuleStore | None = None, review: bool | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rules with the forced ones, merged into ``store`` if given, and flags of near duplicates if asked for (by default, if the settings say so)."""
    review = settings(turns.sparkSession).review if review is None else review
    rules = R.extract_rules(turns)
    forced = R.forced_rules(turns, rules).select("conv_id", F.lit(P.MAX_RULES + 1).alias("rule_pos"), "rule", F.lower("rule").alias("rule_key"))
    rules = rules.unionByName(forced)
    flags = None
    if store is not None:
        if review:
            flags = R.review_flags(R.near_duplicates(R.new_rules(rules, store.load()), store.load().unionByName(rules.select("rule", F.lit(0).cast("long").alias("first_seen_seq")))))
        store.merge(rules.select("rule", F.col("rule_pos").cast("long").alias("seq")))
    return rules, flags


def rules_status(store: RuleStore) -> DataFrame:
    return R.rules_status(store.load(), store.most)

"""Behavioural rules: sentences of users that correct the assistant, and their merge into a store.

Defined results: a null content has no rules; a null conversation is one of its own; rules of turns without a place come last; of equal rules the first counts; null
rules are left out of merges; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions import patterns as P
from palaver.functions import text as T
from palaver.operators.turns import beside


def sentences(c: Column, terms: tuple[str, ...] = P.SAFETY_TERMS) -> Column:
    """kind (0 correction, 1 implicit), unit_no and rule of every sentence of a text with a trigger.

    A trigger counts within the unit (up to a full stop or line end) that holds it, or across full stops of a line; that sentence goes from the unit in which the
    trigger begins to the one in which it ends. A unit with both kinds is a correction.
    """
    kind = lambda u: F.when(u.rlike(P.CORRECTION), 0).when(u.rlike(P.IMPLICIT_CORRECTION), 1)
    found = lambda kind, unit_no, sentence: F.struct(kind.alias("kind"), unit_no.cast("int").alias("unit_no"), sentence.alias("sentence"))
    paired = F.arrays_zip(T.sentence_units(c).alias("unit"), T.unit_sentences(c).alias("sentence"))
    units = F.filter(F.transform(paired, lambda u, i: found(kind(u["unit"]), i, u["sentence"])), lambda x: x["kind"].isNotNull())
    before = lambda x: F.size(T.sentence_units(F.substring(c, F.lit(1), F.instr(c, x) - 1))) - 1
    across = F.transform(F.regexp_extract_all(c, F.lit(P.ACROSS), F.lit(0)), lambda x: found(F.lit(0), before(x), T.strip(x)))
    return F.transform(F.concat(units, across), lambda u: F.struct(u["kind"].alias("kind"), u["unit_no"].alias("unit_no"), T.trim_rule(u["sentence"], terms).alias("rule")))


def correcting(turns: DataFrame) -> DataFrame:
    """Turns of users with a trigger."""
    return turns.where(F.col("role") == "user").where(F.col("content").rlike(P.CORRECTION) | F.col("content").rlike(P.IMPLICIT_CORRECTION))


def is_rule(rule: Column, terms: tuple[str, ...] = P.SAFETY_TERMS) -> Column:
    return (F.length(rule) >= P.MIN_RULE_LENGTH) & ((F.length(rule) <= P.MAX_RULE_LENGTH) | T.protected(rule, terms))


def rule_key(rule: Column) -> Column:
    return T.space_key(F.lower(rule))


def rule_sentences(turns: DataFrame, terms: tuple[str, ...] = P.SAFETY_TERMS) -> DataFrame:
    """conv_id, pos, kind, unit_no, rule: every sentence with a trigger. Narrow."""
    return correcting(turns).select("conv_id", "pos", F.explode(sentences(F.col("content"), terms)).alias("u")).select("conv_id", "pos", "u.kind", "u.unit_no", "u.rule")


def extract_rules(turns: DataFrame, most: int = P.MAX_RULES, terms: tuple[str, ...] = P.SAFETY_TERMS) -> DataFrame:
    """conv_id, rule_pos, rule, rule_key: distinct rules of each conversation in order, the first ``most``."""
    keyed = rule_sentences(turns, terms).where(is_rule(F.col("rule"), terms)).withColumn("rule_key", rule_key(F.col("rule")))
    first = keyed.groupBy("conv_id", "rule_key").agg(F.min(F.struct("pos", "kind", "unit_no", "rule")).alias("first"))
    order = Window.partitionBy("conv_id").orderBy(F.col("first.pos").asc_nulls_last(), "first.kind", "first.unit_no")
    ranked = first.withColumn("rule_pos", F.row_number().over(order)).where(F.col("rule_pos") <= most)
    return ranked.select("conv_id", "rule_pos", F.col("first.rule").alias("rule"), "rule_key")


def forced_rules(turns: DataFrame, rules: DataFrame, terms: tuple[str, ...] = P.PROTECTED_TERMS) -> DataFrame:
    """conv_id, rule: pieces with a protected term that no rule of the conversation has; a turn answers for the first term it holds."""
    if not terms:
        return turns.select("conv_id", F.col("content").alias("rule")).limit(0)
    lower = F.lower("content")
    term = F.coalesce(*[F.when(F.contains(lower, F.lit(t.lower())), F.lit(t.lower())) for t in terms])
    users = turns.where((F.col("role") == "user") & T.protected(F.col("content"), terms)).withColumn("term", term)
    piece = F.try_element_at(F.filter(F.split("content", r"\."), lambda s: F.contains(F.lower(s), F.col("term")) & (F.length(s) > 30)), F.lit(1))
    wanted = users.select("conv_id", "pos", "term", F.concat(T.strip(piece), F.lit(".")).alias("rule")).where("rule IS NOT NULL")
    first = wanted.groupBy("conv_id", "term").agg(F.min(F.struct("pos", "rule")).alias("first")).select("conv_id", "term", "first.rule")
    have = rules.where(T.protected(F.col("rule"), terms)).select("conv_id", F.explode(F.filter(F.array(*[F.when(F.contains(F.lower("rule"), F.lit(t.lower())), F.lit(t.lower())) for t in terms]), lambda t: t.isNotNull())).alias("term"))
    return beside(first, have, "conv_id", "term", how="left_anti").select("conv_id", "rule")


def new_rules(rules: DataFrame, store: DataFrame) -> DataFrame:
    """Distinct stripped rules that the store (column rule) has not."""
    own = rules.select(T.strip(F.col("rule")).alias("rule")).where("rule != ''").distinct()
    return own.join(store.select("rule"), "rule", "left_anti")


def merge_rules(rules: DataFrame, store: DataFrame, most: int = P.STORE_RULES) -> DataFrame:
    """rule, first_seen_seq: the store's rules and then new ones (columns rule, seq), by first appearance, the first ``most``."""
    own = rules.select(T.strip(F.col("rule")).alias("rule"), (F.col("seq") + (1 << 40)).alias("seq")).where("rule != ''")
    every = store.select("rule", F.col("first_seen_seq").cast("long").alias("seq")).unionByName(own.select("rule", F.col("seq").cast("long").alias("seq")))
    first = every.groupBy("rule").agg(F.min("seq").alias("seq"))
    ranked = first.withColumn("first_seen_seq", F.row_number().over(Window.orderBy("seq", "rule")))
    return ranked.where(F.col("first_seen_seq") <= most).select("rule", F.col("first_seen_seq").cast("long").alias("first_seen_seq"))


def near_duplicates(new: DataFrame, known: DataFrame, least: float = P.NEAR_DUPLICATE) -> DataFrame:
    """new_rule, rule, overlap: pairs whose shared word bigrams are ``least`` of the larger set. Report only.

    Rules meet only through their rarest bigrams: those that are left when ``least`` of them, less one, are put aside. Similar rules share one of these,
    and a bigram that most rules have is hardly ever among them.
    """
    a = new.select(F.col("rule").alias("new_rule")).distinct().withColumn("b", T.bigrams(F.col("new_rule")))
    b = known.select("rule").distinct().withColumn("b", T.bigrams(F.col("rule")))
    every = a.select(F.col("new_rule").alias("rule"), "b").union(b).distinct().select("rule", F.size("b").alias("n"), F.explode("b").alias("bigram"))
    often = every.groupBy("bigram").agg(F.count(F.lit(1)).alias("often"))
    listed = every.join(often, "bigram").groupBy("rule", "n").agg(F.sort_array(F.collect_list(F.struct("often", "bigram"))).alias("own"))
    kept = F.slice("own", F.lit(1), F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1)
    rare = listed.select("rule", F.explode(F.transform(kept, lambda x: x["bigram"])).alias("bigram"))
    left, right = (df.join(rare.withColumnRenamed("rule", name), name) for df, name in ((a, "new_rule"), (b.withColumnRenamed("b", "c"), "rule")))
    pairs = left.join(right, "bigram").where("new_rule != rule").select("new_rule", "rule", "b", "c").distinct()
    overlap = F.size(F.array_intersect("b", "c")) / F.greatest(F.size("b"), F.size("c"))
    return pairs.where(overlap >= least).select("new_rule", "rule", F.round(overlap, 2).alias("overlap"))


def review_flags(pairs: DataFrame, most: int = 3) -> DataFrame:
    """One row per new rule: its ``most`` nearest rules, both cut to 80 characters."""
    order = Window.partitionBy("new_rule").orderBy(F.col("overlap").desc(), "rule")
    top = pairs.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    near = F.transform(F.array_sort(F.collect_list(F.struct("n", "rule", "overlap"))), lambda x: F.struct(F.substring(x["rule"], 1, 80).alias("rule"), x["overlap"].alias("overlap")))
    return top.groupBy("new_rule").agg(near.alias("near_duplicates")).select(F.substring("new_rule", 1, 80).alias("new_rule"), "near_duplicates")


def rules_status(rules: DataFrame, most: int = P.STORE_RULES) -> DataFrame:
    n = F.count(F.lit(1))
    status = F.when(n >= most, "FULL").when(n >= int(most * 0.8), "APPROACHING").otherwise("OK")
    return rules.agg(n.alias("n_rules"), F.round(n / F.lit(most) * 100, 1).alias("capacity_pct"), status.alias("status"))

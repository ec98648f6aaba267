"""Frequency baselines, surprisal, stage rebuild and attacker profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.columns import col, filled

# Order of the tactics in an attack chain.
TACTIC_ORDER = [
    "Reconnaissance", "Resource Development", "Initial Access", "Execution", "Persistence", "Privilege Escalation",
    "Defense Evasion", "Credential Access", "Discovery", "Lateral Movement", "Collection",
    "Command and Control", "Exfiltration", "Impact",
]
TACTIC_IDS = {
    "initial-access": ("TA0001", "Initial Access"),
    "execution": ("TA0002", "Execution"),
    "persistence": ("TA0003", "Persistence"),
    "privilege-escalation": ("TA0004", "Privilege Escalation"),
    "defense-evasion": ("TA0005", "Defense Evasion"),
    "credential-access": ("TA0006", "Credential Access"),
    "discovery": ("TA0007", "Discovery"),
    "lateral-movement": ("TA0008", "Lateral Movement"),
    "collection": ("TA0009", "Collection"),
    "exfiltration": ("TA0010", "Exfiltration"),
    "command-and-control": ("TA0011", "Command and Control"),
    "impact": ("TA0040", "Impact"),
    "reconnaissance": ("TA0043", "Reconnaissance"),
    "resource-development": ("TA0042", "Resource Development"),
}


def signature_baseline(df: DataFrame) -> DataFrame:
    return df.groupBy("signature").agg(F.count(F.lit(1)).alias("seen"))


def surprisal(df: DataFrame, baseline: DataFrame) -> DataFrame:
    """-log2 of the share of the signature in the baseline; a new signature counts once."""
    total = baseline.agg(F.sum("seen").alias("t")).scalar()
    joined = df.join(baseline, "signature", "left")
    return joined.withColumn("surprisal", -F.log2(F.coalesce("seen", F.lit(1)) / total)).drop("seen")


def triple_baseline(triples: DataFrame) -> DataFrame:
    return triples.groupBy("subject", "operation", "object").agg(F.count(F.lit(1)).alias("seen"))


def path_scores(triples: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of the edge surprisals of each path.

    Equal edges of a path are counted before the join, so a hot edge crosses
    the shuffle once per path instead of once per event.
    """
    total = baseline.agg(F.sum("seen").alias("t")).scalar()
    per_path = triples.groupBy(*keys, "subject", "operation", "object").agg(F.count(F.lit(1)).alias("n"))
    joined = per_path.join(baseline, ["subject", "operation", "object"], "left")
    edge = -F.log2(F.coalesce("seen", F.lit(1)) / total)
    return joined.groupBy(*keys).agg(F.sum("n").alias("edges"), F.sum(edge * F.col("n")).alias("path_score"))


def attack_stages(df: DataFrame, keys: list[str]) -> DataFrame:
    """Stages of each attack in tactic order; events without a tactic are skipped."""
    order = F.create_map(*[x for i, t in enumerate(TACTIC_ORDER) for x in (F.lit(t), F.lit(i))])
    tactic = filled(col("threat.tactic.name"))
    staged = df.where(tactic.isNotNull()).groupBy(*keys, tactic.alias("tactic")).agg(
        F.count(F.lit(1)).alias("events"), F.min("ts").alias("started"), F.max("ts").alias("ended"))
    return staged.withColumn("stage", F.coalesce(F.try_element_at(order, F.col("tactic")), F.lit(len(TACTIC_ORDER)))).withColumn(
        "description", F.concat(F.col("tactic"), F.lit(": "), F.col("events").cast("string"), F.lit(" events")))


def attacker_profile(df: DataFrame) -> DataFrame:
    """What each source address touched."""
    return df.where(filled(col("source.ip")).isNotNull()).groupBy(col("source.ip").alias("attacker")).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_distinct(col("host.name")).alias("hosts"),
        F.count_distinct(col("threat.technique.id")).alias("techniques"),
        F.count_distinct(col("process.name")).alias("tools"),
        F.count_distinct(col("threat.tactic.name")).alias("chain_depth"),
        F.max(col("event.severity")).alias("max_severity"),
    )

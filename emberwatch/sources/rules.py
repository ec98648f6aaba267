"""Rule files to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULE_DDL = """
id string, title string, status string, level string, product string, category string, service string,
detection_json string, tags array<string>, file_path string
"""


def _parser():
    """YAML files to rule rows, one Arrow batch at a time."""
    def parse(batches):
        import json

        import pandas as pd
        import yaml

        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    doc = yaml.safe_load(bytes(content).decode("utf-8"))
                    if not doc or "detection" not in doc or "logsource" not in doc:
                        continue
                    source = doc["logsource"] or {}
                    out.append({
                        "id": str(doc.get("id", "")), "title": str(doc.get("title", "")), "status": str(doc.get("status", "unknown")),
                        "level": str(doc.get("level", "medium")), "product": source.get("product"), "category": source.get("category"),
                        "service": source.get("service"), "detection_json": json.dumps(doc["detection"], default=str),
                        "tags": [str(t) for t in doc.get("tags") or []], "file_path": path,
                    })
                except Exception:  # noqa: BLE001  a file that does not parse is skipped
                    continue
            yield pd.DataFrame(out, columns=["id", "title", "status", "level", "product", "category", "service",
                                             "detection_json", "tags", "file_path"])

    return parse


def attack_tags(tags: Column, kind: str) -> Column:
    """Technique ids or tactic names among ``attack.*`` tags; whatever does not start with t is a tactic."""
    values = F.transform(F.filter(tags, lambda t: t.startswith("attack.")), lambda t: F.replace(t, F.lit("attack."), F.lit("")))
    if kind == "tactics":
        return F.filter(values, lambda v: ~F.lower(v).startswith("t"))
    return F.transform(F.filter(values, lambda v: F.lower(v).startswith("t") & v.rlike("[0-9]")), lambda v: F.upper(v))


def with_attack_tags(rules: DataFrame) -> DataFrame:
    return rules.withColumns({"tactics": attack_tags(F.col("tags"), "tactics"), "techniques": attack_tags(F.col("tags"), "techniques")})


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """All ``*.yml`` below ``path``; files without detection or logsource are left out."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.yml").option("recursiveFileLookup", "true")
             .load(path).select("path", "content"))
    return with_attack_tags(files.mapInPandas(_parser(), RULE_DDL))


def select_rules(rules: DataFrame, product: str | None = None, category: str | None = None, service: str | None = None) -> DataFrame:
    """Rules that do not conflict with the asked log source: a key counts only if both sides state it."""
    for name, want in (("product", product), ("category", category), ("service", service)):
        if want:
            rules = rules.where(F.col(name).isNull() | (F.col(name) == "") | (F.col(name) == want))
    return rules


def linux_rules(rules: DataFrame) -> DataFrame:
    return select_rules(rules, product="linux")


def zeek_rules(rules: DataFrame) -> DataFrame:
    return select_rules(rules, product="zeek")


def process_creation_rules(rules: DataFrame, product: str = "linux") -> DataFrame:
    return select_rules(rules, product=product, category="process_creation")


def auditd_rules(rules: DataFrame) -> DataFrame:
    return select_rules(rules, product="linux", service="auditd")


def rule_stats(rules: DataFrame) -> DataFrame:
    """Rule counts by product, category, level and tactic in long form."""
    named = rules.select(
        F.coalesce("product", F.lit("unknown")).alias("product"), F.coalesce("category", F.lit("unknown")).alias("category"),
        "level", "tactics")
    long = named.select(F.explode(F.concat(
        F.array(F.struct(F.lit("product").alias("kind"), F.col("product").alias("value")),
                F.struct(F.lit("category").alias("kind"), F.col("category").alias("value")),
                F.struct(F.lit("level").alias("kind"), F.col("level").alias("value"))),
        F.transform("tactics", lambda t: F.struct(F.lit("tactic").alias("kind"), t.alias("value"))))).alias("s"))
    return long.groupBy("s.kind", "s.value").agg(F.count(F.lit(1)).alias("rules"))

"""Honeypot records (one JSON object per line) to events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.columns import contains_any, filled, is_json_object, iso
from emberwatch.schema import build_events

RECORD_DDL = """
eventid string, timestamp string, src_ip string, src_port int, dst_ip string, dst_port int, session string, username string,
password string, input string, message string, sensor string
"""
# Records kept, and the command audit (words, technique, rule, confidence, severity).
KEPT = ["cowrie.session.connect", "cowrie.login.success", "cowrie.login.failed", "cowrie.command.input", "cowrie.session.file_download"]
COMMAND_AUDIT = [
    (["curl", "wget"], "T1105", "Ingress Tool Transfer", "Suspicious Downloader (curl/wget)", 1.0, "high", 8),
    (["/etc/passwd", "/etc/shadow", "whoami"], "T1087", "Account Discovery", "Sensitive File Access", 0.9, "medium", 7),
    (["rm ", "mv ", "chmod"], "T1070", "Indicator Removal", "File Manipulation", 0.7, "medium", 6),
]
DEFAULT_PORT = 2222


def parse_lines(lines: DataFrame, all_events: bool = False) -> DataFrame:
    """Complete JSON lines of the kept record kinds."""
    df = lines.where(is_json_object(F.col("value"))).withColumn("r", F.from_json("value", RECORD_DDL)).where(F.col("r.eventid").isNotNull())
    return df if all_events else df.where(F.col("r.eventid").isin(KEPT))


def audit_command(cmd: Column) -> Column:
    """Finding of the first audit row whose words occur; null without one."""
    out = None
    for words, technique, name, rule, confidence, level, severity in COMMAND_AUDIT:
        value = F.struct(F.lit(technique).alias("technique"), F.lit(name).alias("name"), F.lit(rule).alias("rule"),
                         F.lit(confidence).alias("confidence"), F.lit(level).alias("level"), F.lit(severity).alias("severity"))
        hit = contains_any(cmd, words)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def honeypot_events(parsed: DataFrame, sensor: str | Column, keep: dict[str, Column] | None = None) -> DataFrame:
    sensor = F.lit(sensor) if isinstance(sensor, str) else sensor
    r = lambda f: F.col(f"r.{f}")
    kind = r("eventid")
    login, command, proxy = kind.contains("login"), kind.contains("command.input"), kind.contains("direct-tcpip")
    command, proxy = ~login & command, ~login & ~command & proxy
    failed = login & kind.contains("failed")
    cmd = F.when(command, filled(r("input")))
    df = parsed.withColumn("__f", F.when(command, audit_command(cmd)))
    severity = (
        F.when(failed, F.lit(5)).when(login, F.lit(1)).when(command & cmd.isNull(), F.lit(3))
        .when(command, F.coalesce(F.col("__f.severity"), F.lit(5))).when(proxy, F.lit(5)).otherwise(F.lit(3)))
    stamp = F.when(r("timestamp").contains("T"), r("timestamp")).otherwise(iso(F.current_timestamp()))
    return build_events(df, {
        "@timestamp": stamp, "event.dataset": F.lit("cowrie"), "event.type": F.lit("info"),
        "event.category": F.when(login, "authentication").when(command, "process").when(proxy, "network").otherwise("host"),
        "event.action": F.when(proxy, "proxy_attempt").otherwise(F.substring_index(kind, ".", -1)),
        "event.outcome": F.when(failed, "failure").otherwise("success"), "event.severity": severity,
        "source.ip": filled(r("src_ip")), "source.port": F.coalesce(r("src_port"), F.lit(0)),
        "destination.ip": filled(r("dst_ip")), "destination.port": F.coalesce(r("dst_port"), F.lit(DEFAULT_PORT)),
        "host.name": sensor, "host.ip": F.array(F.coalesce(r("dst_ip"), F.lit(""))),
        "user.name": F.coalesce(r("username"), F.lit("unknown")), "user.session_id": filled(r("session")),
        "process.command_line": cmd, "process.name": F.get(F.split(F.trim(cmd), r"\s+"), F.lit(0)),
        "threat.technique.id": F.col("__f.technique"), "threat.technique.name": F.col("__f.name"),
        "detection.rules": F.when(failed, F.array(F.lit("Brute Force Attempt"))).when(F.col("__f").isNotNull(), F.array(F.col("__f.rule"))),
        "detection.confidence": F.when(failed, F.lit(0.6)).otherwise(F.col("__f.confidence")),
        "detection.severity": F.when(failed, "low").otherwise(F.col("__f.level")),
        "message": F.coalesce(r("message"), F.concat(F.lit("Cowrie Event: "), kind)), "raw": F.col("value"),
    }, keep)

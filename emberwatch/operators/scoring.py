"""Threat score of an event and the selection of seed events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.columns import col, contains_any, fence, filled, text, truth

# ---------------------------------------------------------------------------
# Fixed values of the score.
# ---------------------------------------------------------------------------
RULE_SCORES = {"critical": 100, "high": 80, "medium": 50, "low": 20}
LOCAL_SOURCES = ["127.0.0.1", "::1", "localhost"]
DANGEROUS_TOOLS = ["ncat", "nc", "socket"]
DOWNLOADERS = ["wget", "curl"]
WEB_USER_TOOLS = ["curl", "wget", "python", "perl", "php"]
WEB_SCRIPT_EXTENSIONS = [".php", ".jsp", ".asp", ".aspx"]
SENSITIVE_FILES = ["/etc/shadow", "/etc/passwd", "/etc/sudoers"]
PERSISTENCE_PATHS = ["/etc/cron.d/", "/etc/rc.local", "systemd/system"]
FINAL_LEVELS = [(90, "critical"), (70, "high"), (50, "medium")]
THREAT_SCORE = 50
TACTIC_KEYWORDS = [
    (["authentication", "login", "bruteforce"], "Credential Access"),
    (["webshell", "persistence"], "Persistence"),
    (["shell", "execution", "powershell", "process"], "Execution"),
    (["honeypot"], "Collection"),
    (["download", "curl", "wget"], "Command and Control"),
    (["scan", "recon"], "Reconnaissance"),
]
DEFAULT_TACTIC = "Initial Access"
# ---------------------------------------------------------------------------


def _reasons(*entries: Column) -> Column:
    return F.array_compact(F.array(*entries))


def heuristics() -> Column:
    """Struct(score, reasons) of the content heuristics."""
    proc, cmd = text(col("process.name")), text(col("process.command_line"))
    path, user, dataset = text(col("file.path")), text(col("user.name")), text(col("event.dataset"))

    shell = cmd.contains("bash -i") | cmd.contains("/dev/tcp/")
    tool = contains_any(proc, DANGEROUS_TOOLS)
    downloader = contains_any(proc, DOWNLOADERS)
    low_priv = (user == "www-data") & contains_any(proc, WEB_USER_TOOLS)
    in_web = path.contains("/var/www/html") | cmd.contains("/var/www/html")
    web = in_web & (contains_any(path, WEB_SCRIPT_EXTENSIONS) | contains_any(cmd, WEB_SCRIPT_EXTENSIONS))
    sensitive = contains_any(path, SENSITIVE_FILES) | contains_any(cmd, SENSITIVE_FILES)
    persist = contains_any(path, PERSISTENCE_PATHS)
    windows = dataset == "windows"
    encoded = windows & proc.contains("powershell") & (cmd.contains("-enc") | cmd.contains("-encodedcommand"))
    certutil = windows & proc.contains("certutil") & cmd.contains("-urlcache")

    rows = [
        (shell, 85, F.lit("Heuristic: Reverse Shell Pattern")),
        (tool, 70, F.concat(F.lit("Heuristic: Dangerous Tool ("), proc, F.lit(")"))),
        (downloader, 60, F.concat(F.lit("Heuristic: Suspicious Tool ("), proc, F.lit(")"))),
        (low_priv, 75, F.lit("Heuristic: Low-Priv User Web Request")),
        (web, 90, F.when(cmd.contains("/var/www/html"), F.lit("Heuristic: WebShell Pattern"))
            .otherwise(F.lit("Heuristic: WebShell Write"))),
        (sensitive, 70, F.lit("Heuristic: Sensitive/Persistence File Access")),
        (persist, 70, F.lit("Heuristic: Persistence Mechanism Modification")),
        (encoded, 70, F.lit("Heuristic: PowerShell Encoded Command")),
        (certutil, 65, F.lit("Heuristic: Certutil Download (LotL)")),
    ]
    score = F.greatest(*[F.when(p, F.lit(s)).otherwise(F.lit(0)) for p, s, _ in rows])
    return F.struct(score.alias("score"), _reasons(*[F.when(p, r) for p, _, r in rows]).alias("reasons"))


def with_threat(df: DataFrame) -> DataFrame:
    """Adds ``score``, ``is_threat``, ``severity`` and sorted ``reasons``."""
    category, outcome = col("event.category"), col("event.outcome")
    rule_level = text(col("detection.severity"))
    reported = F.coalesce(col("event.severity"), F.lit(0))
    anomalies = F.when(category == "memory", col("memory.anomalies"))

    def risk_reason(level: str, title: str) -> Column:
        hits = F.filter(anomalies, lambda a: F.upper(a["risk_level"]) == level)
        named = F.transform(hits, lambda a: F.concat(
            F.lit(f"MemDefense: {title} Anomaly ("), F.coalesce(a["type"], F.lit("Unknown")), F.lit(")")))
        return F.coalesce(named, F.array().cast("array<string>"))

    critical, high = risk_reason("CRITICAL", "Critical"), risk_reason("HIGH", "High Risk")
    memory_score = F.when(F.size(critical) > 0, F.lit(100)).when(F.size(high) > 0, F.lit(90)).otherwise(F.lit(0))

    rule_score = F.coalesce(*[F.when(rule_level == k, F.lit(v)) for k, v in RULE_SCORES.items()])
    rule_reason = F.when(rule_score.isNotNull(), F.concat(F.lit("Sigma Rule: "), F.upper(rule_level)))
    base = F.greatest(memory_score, F.coalesce(rule_score, F.lit(0)))

    agent_wins = (reported > 0) & (reported * 10 > base)
    agent_reason = F.when(agent_wins, F.concat(F.lit("Agent Reported Severity: "), reported.cast("string")))
    agent_score = F.when(agent_wins, reported * 10).otherwise(F.lit(0))

    is_auth = category == "authentication"
    failure = truth(is_auth & (outcome == "failure"))
    source = F.coalesce(filled(col("source.ip")), F.lit("None"))
    root_remote = truth(is_auth & (col("user.name") == "root") & (outcome == "success") & ~source.isin(LOCAL_SOURCES))

    honeypot = text(col("event.dataset")).contains("cowrie")
    action = F.coalesce(col("event.action"), F.lit(""))
    pot = (
        F.when(action == "input", F.struct(F.lit(75).alias("s"), F.lit("HIGH: Honeypot Command Execution").alias("r")))
        .when((action == "login") & truth(outcome == "success"), F.struct(F.lit(60).alias("s"), F.lit("MEDIUM: Honeypot Login Success").alias("r")))
        .when(action == "login", F.struct(F.lit(40).alias("s"), F.lit("LOW: Honeypot Login Attempt").alias("r")))
        .otherwise(F.struct(F.lit(25).alias("s"), F.lit("LOW: Honeypot Interaction").alias("r")))
    )
    plain = F.greatest(
        base, agent_score,
        F.when(failure, F.lit(40)).otherwise(F.lit(0)),
        F.when(root_remote, F.lit(60)).otherwise(F.lit(0)),
        F.when(honeypot, pot["s"]).otherwise(F.lit(0)),
    )
    plain_reasons = F.concat(critical, high, _reasons(
        rule_reason, agent_reason,
        F.when(failure, F.lit("Authentication: Login Failure")),
        F.when(root_remote, F.concat(F.lit("Authentication: Root Remote Login from "), source)),
        F.when(honeypot, pot["r"]),
    ))
    out = df.withColumns({"__plain": plain, "__why": plain_reasons, "__h": heuristics()})
    wins = F.col("__h.score") > F.col("__plain")
    out = out.withColumn("score", F.greatest(F.col("__plain"), F.col("__h.score")))
    level = F.lit("low")
    for bound, name in reversed(FINAL_LEVELS):
        level = F.when(F.col("score") >= bound, F.lit(name)).otherwise(level)
    why = F.when(wins, F.concat(F.col("__why"), F.col("__h.reasons"))).otherwise(F.col("__why"))
    return out.withColumns({
        "is_threat": F.col("score") >= THREAT_SCORE,
        "severity": level,
        "reasons": F.array_sort(F.array_distinct(why)),
    }).drop("__plain", "__why", "__h")


def tactic_from_reasons(reasons: Column) -> Column:
    words = F.lower(F.array_join(reasons, " "))
    out = F.lit(DEFAULT_TACTIC)
    for keys, tactic in reversed(TACTIC_KEYWORDS):
        out = F.when(contains_any(words, keys), F.lit(tactic)).otherwise(out)
    return out


def backfill(scored: DataFrame) -> DataFrame:
    """Write severity, confidence and a missing tactic of scored events into the event."""
    tactic = F.coalesce(filled(col("threat.tactic.name")), tactic_from_reasons(F.col("reasons")))
    confidence = F.greatest(F.col("score"), F.lit(10)) / 100.0
    return scored.withColumns({
        "detection": F.col("detection").withField("severity", F.col("severity")),
        "threat": F.col("threat").withField("confidence", confidence).withField("tactic.name", tactic),
    })


def seeds(df: DataFrame, start=None, end=None, min_score: int = THREAT_SCORE, newest: int | None = None) -> DataFrame:
    """Events of a time range whose score reaches ``min_score`` or that come from a honeypot.

    The whole range is scored. ``newest`` asks for a report on that many newest
    events only.
    """
    if start is not None:
        df = df.where(F.col("ts") >= F.to_timestamp(F.lit(start)))
    if end is not None:
        df = df.where(F.col("ts") <= F.to_timestamp(F.lit(end)))
    if newest is not None:
        df = df.orderBy(F.col("ts").desc(), F.col("seq").desc()).limit(newest)
    scored = fence(with_threat(df), ["score", "is_threat", "severity", "reasons"])
    keep = (F.col("score") >= min_score) | truth(col("event.dataset").contains("cowrie"))
    return backfill(scored.where(keep))


def critical_alert(df: DataFrame) -> DataFrame:
    """Newest event reported as critical."""
    hit = truth(col("detection.severity") == "critical") | truth(col("event.severity").isin(8, 10))
    return df.where(hit).orderBy(F.col("ts").desc(), F.col("seq").desc()).limit(1)


def best_seed(seed_events: DataFrame) -> DataFrame:
    """Seed with the highest confidence; the newest wins a tie."""
    return seed_events.orderBy(col("threat.confidence").desc(), F.col("ts").desc(), F.col("seq").desc()).limit(1)

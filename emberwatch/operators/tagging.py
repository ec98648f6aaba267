"""Technique nodes, attack summaries and per-event results from rule hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.functions.columns import col, fence, filled
from emberwatch.operators.detect import Rule, annotate
from emberwatch.operators.rarity import TACTIC_IDS

# ---------------------------------------------------------------------------
# Technique names, levels and confidences.
# ---------------------------------------------------------------------------
TECHNIQUE_NAMES = {
    "T1059": "Command and Scripting Interpreter",
    "T1059.001": "PowerShell",
    "T1059.004": "Unix Shell",
    "T1027": "Obfuscated Files or Information",
    "T1036": "Masquerading",
    "T1021": "Remote Services",
    "T1021.002": "SMB/Windows Admin Shares",
    "T1021.004": "SSH",
    "T1071": "Application Layer Protocol",
    "T1071.001": "Web Protocols",
    "T1071.004": "DNS",
    "T1095": "Non-Application Layer Protocol",
    "T1132": "Data Encoding",
    "T1496": "Resource Hijacking",
    "T1082": "System Information Discovery",
    "T1087": "Account Discovery",
    "T1083": "File and Directory Discovery",
    "T1018": "Remote System Discovery",
    "T1049": "System Network Connections Discovery",
    "T1016": "System Network Configuration Discovery",
    "T1053": "Scheduled Task/Job",
    "T1053.003": "Cron",
    "T1110": "Brute Force",
    "T1110.001": "Password Guessing",
    "T1110.003": "Password Spraying",
    "T1078": "Valid Accounts",
    "T1098": "Account Manipulation",
    "T1222": "File and Directory Permissions Modification",
    "T1070": "Indicator Removal",
    "T1070.004": "File Deletion",
    "T1562": "Impair Defenses",
    "T1562.001": "Disable or Modify Tools",
    "T1140": "Deobfuscate/Decode Files or Information",
    "T1190": "Exploit Public-Facing Application",
    "T1203": "Exploitation for Client Execution",
    "T1105": "Ingress Tool Transfer",
    "T1046": "Network Service Discovery",
    "T1572": "Protocol Tunneling",
}
LEVEL_SEVERITY = {"low": "low", "medium": "medium", "high": "high", "critical": "critical", "informational": "low"}
LEVEL_CONFIDENCE = {"low": 0.3, "medium": 0.6, "high": 0.85, "critical": 0.95}
DEFAULT_CONFIDENCE = 0.5
CONFIDENCE_STEP = 0.05
CONFIDENCE_CAP = 0.99
SEVERITY_WEIGHT = {"low": 1, "medium": 2, "high": 3, "critical": 4}
RISK_LEVELS = [(3.5, "critical"), (2.5, "high"), (1.5, "medium")]
UPSTREAM_CONFIDENCE = 0.8
UPSTREAM_SEVERITY = "high"
CHAIN_ORDER = ["TA0043", "TA0042", "TA0001", "TA0002", "TA0003", "TA0004", "TA0005", "TA0006", "TA0007", "TA0008", "TA0009",
               "TA0011", "TA0010", "TA0040"]
# ---------------------------------------------------------------------------
# With the smallest base confidence the cap is reached once this many distinct
# events contributed, so later events cannot change a node's confidence.
DECISIVE_EVENTS = 6

NODE = ["technique_id", "tactic_id"]


def _map(pairs: dict, value=F.lit) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), value(v))])


def context() -> Column:
    """Long form of what an event involves: struct(kind, value) entries."""
    def entry(kind: str, c: Column) -> Column:
        return F.when(filled(c).isNotNull(), F.struct(F.lit(kind).alias("kind"), c.alias("value")))

    strip = lambda c: F.regexp_replace(c, r'^"+|"+$', "")
    other = lambda a, b: F.when(~a.eqNullSafe(b), a)
    proc, exe = col("process.name"), col("process.executable")
    user, proc_user = col("user.name"), col("process.user.name")
    host, hostname = col("host.name"), col("host.hostname")
    return F.array_compact(F.array(
        entry("source_ip", col("source.ip")), entry("dest_ip", col("destination.ip")),
        entry("process", strip(proc)), entry("process", strip(other(exe, proc))),
        entry("user", user), entry("user", other(proc_user, user)),
        entry("host", host), entry("host", other(hostname, host)),
    ))


def tag_hits(hits: DataFrame) -> DataFrame:
    """Rule hits to technique × tactic rows; a rule without either gives no row."""
    known = _map(TACTIC_IDS, lambda v: F.struct(F.lit(v[0]).alias("id"), F.lit(v[1]).alias("name")))
    names = _map(TECHNIQUE_NAMES)
    out = hits.withColumn("technique_id", F.explode("techniques")).withColumn("__t", F.explode("tactics"))
    found = F.try_element_at(known, F.col("__t"))
    return out.withColumns({
        "technique_name": F.coalesce(F.try_element_at(names, F.col("technique_id")),
                                     F.concat(F.lit("Unknown Technique ("), F.col("technique_id"), F.lit(")"))),
        "tactic_id": F.coalesce(found["id"], F.lit("")),
        "tactic_name": F.coalesce(found["name"], F.col("__t")),
    }).drop("__t")


def technique_nodes(tagged: DataFrame) -> DataFrame:
    """One row per technique and tactic: counts, time range, rules, severity and confidence.

    Expects ``seq, pos, level, title, ts`` and the event id. Name, severity and
    base confidence are those of the node's first hit. Every hit then adds
    0.05 per distinct event seen before; as the cap is reached after six
    distinct events at the latest, only a node's first six events are ranked,
    which Spark limits before the shuffle.
    """
    level_sev, level_conf = _map(LEVEL_SEVERITY), _map(LEVEL_CONFIDENCE)
    tagged = tagged.withColumn("__e", F.coalesce(filled(col("event.id")), F.concat(F.lit("#"), F.col("seq").cast("string"))))
    order = F.struct("seq", "pos")
    base = tagged.groupBy(*NODE).agg(
        F.min_by(F.struct("technique_name", "tactic_name", "level"), order).alias("__first"),
        F.count_distinct("__e").alias("event_count"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.array_sort(F.collect_set("title")).alias("matched_rules"),
    )
    per_event = tagged.groupBy(*NODE, "__e").agg(F.min("seq").alias("__seq"), F.count(F.lit(1)).alias("__hits"))
    rank = F.row_number().over(Window.partitionBy(*NODE).orderBy("__seq", "__e"))
    early = per_event.withColumn("__rank", rank).where(F.col("__rank") <= DECISIVE_EVENTS)
    gain = early.groupBy(*NODE).agg(F.sum(F.col("__hits") * (F.col("__rank") - 1)).alias("__steps"))
    out = base.join(gain, NODE)
    start = F.coalesce(F.try_element_at(level_conf, F.col("__first.level")), F.lit(DEFAULT_CONFIDENCE))
    return out.select(
        "technique_id", F.col("__first.technique_name").alias("technique_name"), "tactic_id",
        F.col("__first.tactic_name").alias("tactic_name"),
        F.when(F.col("__steps") > 0, F.least(F.lit(CONFIDENCE_CAP), start + F.lit(CONFIDENCE_STEP) * F.col("__steps")))
        .otherwise(start).alias("confidence"),
        F.coalesce(F.try_element_at(level_sev, F.col("__first.level")), F.lit("medium")).alias("severity"),
        "event_count", "first_seen", "last_seen", "matched_rules",
    )


def technique_context(tagged: DataFrame) -> DataFrame:
    """Distinct addresses, processes, users and hosts of each node, one row per value.

    ``tagged`` carries the ``context()`` entries of its event in a column ``context``.
    """
    long = tagged.select(*NODE, "seq", F.explode("context").alias("c"))
    return long.groupBy(*NODE, F.col("c.kind").alias("kind"), F.col("c.value").alias("value")).agg(
        F.count_distinct("seq").alias("events"))


def nodes_of_tactic(nodes: DataFrame, tactic_id: str) -> DataFrame:
    return nodes.where(F.col("tactic_id") == tactic_id)


def attack_summary(nodes: DataFrame) -> DataFrame:
    """Overall risk of all nodes. The top severity is the greatest word, as established reports have it."""
    weight = F.coalesce(F.try_element_at(_map(SEVERITY_WEIGHT), F.max("severity")), F.lit(2))
    risk = weight * F.max("confidence")
    level = F.lit("low")
    for bound, name in reversed(RISK_LEVELS):
        level = F.when(F.col("__risk") >= bound, F.lit(name)).otherwise(level)
    out = nodes.agg(
        F.count(F.lit(1)).alias("total_techniques"), F.sum("event_count").alias("total_events"), risk.alias("__risk"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    return out.select("total_techniques", "total_events", level.alias("risk_level"), F.bround("__risk", 2).alias("risk_score"),
                      "first_seen", "last_seen")


def tactic_summary(nodes: DataFrame) -> DataFrame:
    """Techniques per tactic; the list is bounded by the technique catalogue."""
    entry = F.struct("technique_id", "technique_name", "event_count", "confidence", "severity")
    return nodes.groupBy("tactic_id").agg(F.min("tactic_name").alias("tactic_name"), F.array_sort(F.collect_list(entry)).alias("techniques"))


def attack_chain(nodes: DataFrame) -> DataFrame:
    """Tactics in chain order with their techniques."""
    place = _map({t: i for i, t in enumerate(CHAIN_ORDER)})
    out = tactic_summary(nodes).withColumn("stage", F.try_element_at(place, F.col("tactic_id")))
    return out.where(F.col("stage").isNotNull()).orderBy("stage")


# --------------------------------------------------------------------------- per event

def _rule_facts(rules: list[Rule]) -> tuple[Column, Column]:
    """Literal maps rule position → title and rule position → first technique/tactic (null without both)."""
    titles = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(i), F.lit(r.title))])

    def first(r: Rule) -> Column:
        ok = bool(r.techniques and r.tactics)
        tech = r.techniques[0] if ok else None
        tid, tname = TACTIC_IDS.get(r.tactics[0], ("", r.tactics[0])) if ok else (None, None)
        return F.struct(
            F.lit(tech).cast("string").alias("technique_id"),
            F.lit(TECHNIQUE_NAMES.get(tech, f"Unknown Technique ({tech})") if ok else None).cast("string").alias("technique_name"),
            F.lit(tid).cast("string").alias("tactic_id"), F.lit(tname).cast("string").alias("tactic_name"),
            F.lit(LEVEL_CONFIDENCE.get(r.level, DEFAULT_CONFIDENCE)).alias("confidence"),
            F.lit(LEVEL_SEVERITY.get(r.level, "medium")).alias("severity"),
        )

    return titles, F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(i), first(r))])


def analyze(df: DataFrame, rules: list[Rule], semantics: str = "strict") -> DataFrame:
    """Adds ``detected``, ``matched_rules`` and ``primary`` (first technique) to every event.

    Works row by row from the hit array: no shuffle. Events without a local hit
    pass on the technique an upstream sensor reported.
    """
    titles, firsts = _rule_facts(rules)
    out = fence(annotate(df, rules, semantics), ["hits"])
    up = filled(col("threat.technique.id"))
    up_name = filled(col("threat.technique.name"))
    local = F.size("hits") > 0
    named = F.array_sort(F.array_distinct(F.transform("hits", lambda h: titles[h["pos"]])))
    tagged = F.filter(F.transform("hits", lambda h: firsts[h["pos"]]), lambda s: s["technique_id"].isNotNull())
    passed = F.struct(
        up.alias("technique_id"), F.coalesce(up_name, F.lit("Unknown")).alias("technique_name"), F.lit("").alias("tactic_id"),
        F.lit("").alias("tactic_name"), F.lit(UPSTREAM_CONFIDENCE).alias("confidence"), F.lit(UPSTREAM_SEVERITY).alias("severity"))
    return out.withColumns({
        "matched_rules": F.when(local, named).when(up.isNotNull(), F.array(F.concat(F.lit("Upstream Detection: "), F.coalesce(up_name, up))))
        .otherwise(F.array().cast("array<string>")),
        "primary": F.when(local, F.get(tagged, F.lit(0))).when(up.isNotNull(), passed),
    }).withColumn("detected", F.col("primary").isNotNull())


def upstream_only(analyzed: DataFrame) -> DataFrame:
    """Events that no rule hit but an upstream sensor named."""
    return analyzed.where((F.size("hits") == 0) & F.col("primary").isNotNull())


def batch_report(analyzed: DataFrame) -> DataFrame:
    n, hit = F.count(F.lit(1)), F.count_if("detected")
    return analyzed.agg(n.alias("analyzed_events"), hit.alias("detected_events"),
                        F.when(n > 0, F.bround(hit / n * 100, 2)).otherwise(F.lit(0.0)).alias("detection_rate"))


def export_events(analyzed: DataFrame, event_columns: list[str]) -> DataFrame:
    """Detected events with the first technique written into ``threat`` and ``detection``; others unchanged."""
    p = F.col("primary")
    threat = F.col("threat")
    for path, c in {"framework": F.lit("MITRE ATT&CK"), "tactic.id": p["tactic_id"], "tactic.name": p["tactic_name"],
                    "technique.id": p["technique_id"], "technique.name": p["technique_name"]}.items():
        threat = threat.withField(path, c)
    detection = (F.col("detection").withField("rules", F.col("matched_rules")).withField("confidence", p["confidence"])
                 .withField("severity", p["severity"]))
    out = analyzed.withColumns({
        "threat": F.when(F.col("detected"), threat).otherwise(F.col("threat")),
        "detection": F.when(F.col("detected"), detection).otherwise(F.col("detection")),
    })
    return out.select(*[F.col(f"`{c}`") for c in event_columns])

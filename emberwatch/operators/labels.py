"""Semantic labels of events and path signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.columns import col, contains_any, filled, literal

# ---------------------------------------------------------------------------
# Fixed values. (pattern, label, severity, technique); earlier rows win.
# ---------------------------------------------------------------------------
EXECUTABLE_LABELS = [
    (r".*/?(id|whoami|uname|hostname|ifconfig|ip|netstat)$", "RECON_COMMAND", 3, "T1082"),
    (r".*/?(cat|head|tail|less|more|grep|find|locate)$", "FILE_READER", 3, "T1005"),
    (r".*/?(nmap|masscan|zmap)$", "NETWORK_SCANNER", 5, "T1595"),
    (r".*/?(curl|wget|fetch)$", "SUSPICIOUS_DOWNLOADER", 4, "T1105"),
    (r".*/?(scp|rsync|ftp|sftp|nc|ncat|netcat)$", "DATA_TRANSFER_TOOL", 5, "T1567"),
    (r".*/?(bash|sh|zsh|dash|csh|tcsh|ksh)$", "SHELL_EXECUTION", 2, "T1059"),
    (r".*/?(python[23]?|perl|ruby|php|node)$", "SCRIPT_INTERPRETER", 2, "T1059"),
    (r".*/?(sudo|su|doas|pkexec)$", "PRIVILEGE_ESCALATION", 4, "T1548.001"),
    (r".*/?(chmod|chown|setfacl)$", "PERMISSION_CHANGE", 3, "T1222.002"),
    (r".*/?(crontab|systemctl|service)$", "PERSISTENCE_MECHANISM", 5, "T1543"),
    (r".*/?(gcc|g\+\+|make|ld)$", "COMPILATION_TOOL", 4, "T1027.004"),
    (r".*/?(tar|gzip|zip|unzip|7z)$", "ARCHIVE_TOOL", 3, "T1560"),
]
FILE_LABELS = [
    (r"^/dev/shm/.*", "IN_MEMORY_STAGING", 7, "T1027.004"),
    (r"^/tmp/.*", "TEMP_FILE_ACCESS", 4, "T1564"),
    (r"^/var/tmp/.*", "TEMP_FILE_ACCESS", 4, "T1564"),
    (r".*/var/www/html/.*", "WEB_ROOT_ACCESS", 6, "T1505.003"),
    (r".*/htdocs/.*", "WEB_ROOT_ACCESS", 6, "T1505.003"),
    (r".*/wwwroot/.*", "WEB_ROOT_ACCESS", 6, "T1505.003"),
    (r".*/public_html/.*", "WEB_ROOT_ACCESS", 6, "T1505.003"),
    (r".*\.php$", "PHP_SCRIPT", 5, "T1505.003"),
    (r".*\.jsp$", "JSP_SCRIPT", 5, "T1505.003"),
    (r".*\.asp$", "ASP_SCRIPT", 5, "T1505.003"),
    (r".*\.aspx$", "ASPX_SCRIPT", 5, "T1505.003"),
    (r"^/etc/passwd$", "SENSITIVE_FILE", 8, "T1003.008"),
    (r"^/etc/shadow$", "SENSITIVE_FILE", 8, "T1003.008"),
    (r"^/etc/sudoers$", "SENSITIVE_FILE", 8, "T1003.008"),
    (r".*/.ssh/.*", "SSH_RELATED", 7, "T1552.004"),
    (r".*/.bash_history$", "HISTORY_FILE", 4, "T1552.003"),
    (r"^/var/log/.*", "LOG_FILE_ACCESS", 2, "T1562.006"),
    (r".*/cowrie/downloads/.*", "COWRIE_DOWNLOAD", 8, "T1105"),
]
COMMAND_LABELS = [
    (r"bash\s+-i", "REVERSE_SHELL", 10, "T1059.004"),
    (r"/dev/tcp/", "REVERSE_SHELL", 10, "T1059.004"),
    (r"nc\s+-e", "REVERSE_SHELL", 10, "T1059.004"),
    (r"ncat\s+-e", "REVERSE_SHELL", 10, "T1059.004"),
    (r"curl.*\|\s*bash", "DOWNLOAD_AND_EXECUTE", 9, "T1105"),
    (r"wget.*\|\s*bash", "DOWNLOAD_AND_EXECUTE", 9, "T1105"),
    (r"curl.*-o\s+/tmp/", "DOWNLOAD_TO_TEMP", 8, "T1105"),
    (r"wget.*-O\s+/tmp/", "DOWNLOAD_TO_TEMP", 8, "T1105"),
    (r"base64\s+-d", "ENCODED_EXECUTION", 7, "T1027"),
    (r"\|\s*bash", "PIPE_TO_SHELL", 6, "T1059.004"),
    (r"\|\s*sh", "PIPE_TO_SHELL", 6, "T1059.004"),
    (r"rm\s+-rf\s+/", "DESTRUCTIVE_ACTION", 10, "T1485"),
    (r"cat\s+/etc/passwd|cat\s+/etc/shadow", "SENSITIVE_FILE_READ", 8, "T1003.008"),
]
PROTOCOL_LABELS = [
    (r"^dns$", "DNS_QUERY", 0, ""),
    (r"^http$", "HTTP_REQUEST", 0, ""),
    (r"^https$", "HTTPS_REQUEST", 0, ""),
    (r"^ssh$", "SSH_CONNECTION", 0, ""),
    (r"^icmp$", "ICMP_TRAFFIC", 0, ""),
]
MEMORY_LABELS = {
    "MEMFD_EXEC": ("FILELESS_ATTACK", 9, "T1620"),
    "ANON_ELF": ("FILELESS_ATTACK", 9, "T1620"),
    "RWX_REGION": ("CODE_INJECTION", 8, "T1055"),
    "STACK_EXEC": ("CODE_INJECTION", 8, "T1055"),
    "HEAP_EXEC": ("CODE_INJECTION", 8, "T1055"),
    "PROCESS_HOLLOWING": ("PROCESS_HOLLOWING", 9, "T1055.012"),
    "REFLECTIVE_LOAD": ("REFLECTIVE_LOADING", 9, "T1620"),
    "SUSPICIOUS_MEMORY": ("MEMORY_ANOMALY", 5, "T1055"),
}
MEMORY_LABELS_SHORT = {
    "MEMFD_EXEC": "FILELESS_ATTACK",
    "ANON_ELF": "FILELESS_ATTACK",
    "RWX_REGION": "CODE_INJECTION",
    "STACK_EXEC": "CODE_INJECTION",
    "PROCESS_HOLLOWING": "PROCESS_HOLLOWING",
}
SENSITIVE_FILES = ["/etc/passwd", "/etc/shadow", "/etc/sudoers"]
WEB_DIRECTORIES = ["/var/www", "htdocs", "wwwroot", "public_html"]
WEB_EXTENSIONS = ["php", "jsp", "asp", "aspx"]
WEB_WRITES = ["create", "write", "moved-to", "rename"]
TEMP_DIRECTORIES = ["/tmp/", "/var/tmp/", "/dev/shm/"]
CLIENT_TOOLS = ["curl", "wget", "fetch"]
SERVER_DAEMONS = ["nginx", "apache", "httpd"]
# ---------------------------------------------------------------------------


def _detail(label: str, severity: int = 0, technique: str = "") -> Column:
    return F.expr(_detail_sql(label, severity, technique))


def _detail_sql(label: str, severity: int, technique: str) -> str:
    return f"named_struct('label', {literal(label)}, 'severity', {severity}, 'technique', {literal(technique)})"


def _search_form(pattern: str) -> str:
    """Same pattern for a search: a leading or trailing run of anything only costs backtracking."""
    pattern = pattern.removeprefix(".*").removeprefix("/?")
    return pattern.removesuffix(".*")


def match_table(target: Column, table) -> Column:
    """Detail struct of the first pattern found in ``target``, else null."""
    out = None
    for pattern, label, severity, technique in table:
        hit = target.rlike("(?i)" + _search_form(pattern))
        value = _detail(label, severity, technique)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def _direction(direction: Column) -> Column:
    d = F.lower(direction)
    return F.when(d.isin("inbound", "ingress"), _detail("NETWORK_Inbound")).when(
        d.isin("outbound", "egress"), _detail("NETWORK_Outbound"))


def _implied_direction(proc: Column) -> Column:
    return F.when(proc.isin(CLIENT_TOOLS), _detail("NETWORK_Outbound")).when(
        proc.isin(SERVER_DAEMONS), _detail("NETWORK_Inbound"))


def memory_label(anomalies: Column) -> Column:
    """Label of the riskiest anomaly that has one; equal risks keep their order."""
    table = F.create_map(*[x for k, (label, sev, ttp) in MEMORY_LABELS.items() for x in (F.lit(k), _detail(label, sev, ttp))])

    def rated(a: Column, i: Column) -> Column:
        risk = F.upper(a["risk_level"])
        rank = F.coalesce(*[F.when(risk == r, F.lit(n)) for n, r in enumerate(["CRITICAL", "HIGH", "MEDIUM", "LOW"])], F.lit(4))
        label = F.coalesce(
            F.try_element_at(table, F.coalesce(a["type"], F.lit(""))),
            F.when(risk == "CRITICAL", _detail("CRITICAL_MEMORY_ANOMALY")),
            F.when(risk == "HIGH", _detail("HIGH_RISK_MEMORY_ANOMALY")),
        )
        return F.struct(rank.alias("rank"), i.alias("i"), label.alias("label"))

    best = F.array_min(F.filter(F.transform(anomalies, rated), lambda s: s["label"].isNotNull()))
    return F.coalesce(best["label"], _detail("MEMORY_ANOMALY"))


def label_detail() -> Column:
    """Primary label with the severity and technique of the table row it came from."""
    category, action = filled(col("event.category")), filled(col("event.action"))
    path, cmd = filled(col("file.path")), filled(col("process.command_line"))
    exe, proc = filled(col("process.executable")), filled(col("process.name"))
    proto, direction = filled(col("network.protocol")), filled(col("network.direction"))
    ext = F.lower(F.coalesce(col("file.extension"), F.lit("")))

    in_web = contains_any(path, WEB_DIRECTORIES) & (ext.isin(WEB_EXTENSIONS) | path.contains(".php"))
    generic = F.coalesce(
        F.when(category == "network", match_table(proto, PROTOCOL_LABELS)),
        F.when(category == "file", match_table(path, FILE_LABELS)),
        match_table(cmd, COMMAND_LABELS),
        match_table(exe, EXECUTABLE_LABELS),
        match_table(F.concat(F.lit("/"), proc), EXECUTABLE_LABELS),
        match_table(path, FILE_LABELS),
        match_table(proto, PROTOCOL_LABELS),
        _direction(direction),
        F.when(direction.isNull() & (proto.isNotNull() | (category == "network")), _implied_direction(proc)),
    )
    name = F.concat_ws("_", F.upper(category), F.upper(action))
    fallback = F.when(category.isNull(), _detail("UNKNOWN")).otherwise(
        F.struct(name.alias("label"), F.lit(0).alias("severity"), F.lit("").alias("technique")))
    return (
        F.when(category == "memory", memory_label(col("memory.anomalies")))
        .when(contains_any(F.coalesce(path, F.lit("")), SENSITIVE_FILES) | contains_any(F.coalesce(cmd, F.lit("")), SENSITIVE_FILES),
              _detail("SENSITIVE_FILE"))
        .when(in_web & action.isin(WEB_WRITES), _detail("PHP_SCRIPT"))
        .when(in_web, _detail("WEB_ROOT_ACCESS"))
        .when(contains_any(path, TEMP_DIRECTORIES), _detail("TEMP_FILE_ACCESS"))
        .when((category == "network") & _direction(direction).isNotNull(), _direction(direction))
        .otherwise(F.coalesce(generic, fallback))
    )


def primary_label() -> Column:
    return label_detail()["label"]


def all_labels() -> Column:
    """Every table match in a fixed order without repeats; [UNKNOWN] when there is none."""
    direction, proc = filled(col("network.direction")), filled(col("process.name"))
    found = F.array(
        match_table(filled(col("process.executable")), EXECUTABLE_LABELS)["label"],
        match_table(filled(col("file.path")), FILE_LABELS)["label"],
        match_table(filled(col("process.command_line")), COMMAND_LABELS)["label"],
        match_table(filled(col("network.protocol")), PROTOCOL_LABELS)["label"],
        F.when(direction.isNotNull(), _direction(direction)["label"]).otherwise(_implied_direction(proc)["label"]),
    )
    labels = F.array_distinct(F.array_compact(found))
    return F.when(F.size(labels) > 0, labels).otherwise(F.array(F.lit("UNKNOWN")))


def short_label() -> Column:
    """Reduced label set: memory type, download-and-run, else the category."""
    category, cmd = filled(col("event.category")), col("process.command_line")
    table = F.create_map(*[x for k, v in MEMORY_LABELS_SHORT.items() for x in (F.lit(k), F.lit(v))])
    typed = F.array_compact(F.transform(
        col("memory.anomalies"),
        lambda a: F.try_element_at(table, F.coalesce(a["type"], F.lit("")))))
    return F.coalesce(
        F.when(category == "memory", F.get(typed, F.lit(0))),
        F.when(cmd.contains("curl") & cmd.contains("|") & cmd.contains("bash"), F.lit("DOWNLOAD_AND_EXECUTE")),
        F.upper(category),
        F.lit("UNKNOWN"),
    )


def with_labels(df: DataFrame) -> DataFrame:
    """Adds ``label`` to events."""
    return df.withColumn("label", primary_label())


def path_signature(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted distinct labels of each case joined with an arrow.

    Labels are reduced to one row per case and label first, so the list that is
    finally collected is bounded by the label vocabulary.
    """
    known = F.when(F.col("label") != "UNKNOWN", F.col("label"))
    return labelled.select(*keys, known.alias("label")).distinct().groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_list("label")), " -> ").alias("signature"))


def label_sequence(labelled: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Distinct labels of each case in order of first appearance."""
    first = labelled.groupBy(*keys, "label").agg(F.min(order).alias("__o"))
    return first.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__o", "label"))), lambda s: s["label"]).alias("sequence"))


def fingerprint(sequence: Column) -> Column:
    """SHA-256 of the steps joined in order."""
    return F.sha2(F.array_join(sequence, "->"), 256)

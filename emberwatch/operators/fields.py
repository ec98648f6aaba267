"""Log source of an event and the rule field names it answers to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberwatch.functions.columns import col, filled
from emberwatch.schema import event_schema

# ---------------------------------------------------------------------------
# Rule field → event paths, first filled path wins. ``raw.x`` is a key of the raw record.
# ---------------------------------------------------------------------------
PROCESS_FIELDS = {
    "Image": ["process.executable", "process.name"],
    "CommandLine": ["process.command_line", "raw.input", "raw.data"],
    "User": ["process.user.name", "user.name"],
    "ParentImage": ["process.parent.executable", "process.parent.name"],
    "ParentCommandLine": ["process.parent.command_line"],
    "CurrentDirectory": ["process.working_directory"],
}
AUDIT_FIELDS = {
    "key": ["event.action", "raw.key"],
    "type": ["raw.type"],
    "syscall": ["raw.syscall"],
    "exe": ["process.executable"],
    "comm": ["process.name"],
    "uid": ["process.user.id", "user.id"],
    "auid": ["user.audit_id"],
}
ZEEK_FIELDS = {
    "id.orig_h": ["source.ip"],
    "id.orig_p": ["source.port"],
    "id.resp_h": ["destination.ip"],
    "id.resp_p": ["destination.port"],
    "proto": ["network.transport", "raw.proto"],
    "service": ["network.protocol", "raw.service"],
    "conn_state": ["zeek.conn_state", "raw.conn_state"],
    "orig_bytes": ["source.bytes", "raw.orig_bytes"],
    "resp_bytes": ["destination.bytes", "raw.resp_bytes"],
    "query": ["dns.question.name", "raw.query"],
    "method": ["http.request.method", "raw.method"],
    "uri": ["url.original", "raw.uri"],
    "FileName": ["file.name", "raw.filename"],
}
HONEYPOT_FIELDS = {
    "src_ip": ["source.ip", "raw.src_ip"],
    "src_port": ["source.port", "raw.src_port"],
    "dst_ip": ["destination.ip", "raw.dst_ip"],
    "dst_port": ["destination.port", "raw.dst_port"],
    "username": ["user.name", "raw.username"],
    "password": ["user.password", "raw.password"],
    "input": ["process.command_line", "raw.input"],
    "eventid": ["raw.eventid", "event.action"],
    "session": ["raw.session", "event.id"],
    "Image": ["process.name"],
    "TargetFileName": ["file.path", "raw.outfile", "raw.destfile"],
    "CommandLine": ["process.command_line", "raw.input"],
}
SYSCALL_TYPES = ["SYSCALL", "EXECVE"]
AUDIT_TYPES = ["SYSCALL", "EXECVE", "CWD", "PATH"]
# ---------------------------------------------------------------------------
# Extension used in strict mode only: names of Windows records other than process creation.
WINDOWS_FIELDS = {
    **PROCESS_FIELDS,
    "TargetFilename": ["file.path"],
    "SourceIp": ["source.ip"],
    "SourcePort": ["source.port"],
    "DestinationIp": ["destination.ip"],
    "DestinationPort": ["destination.port"],
    "QueryName": ["dns.question.name"],
    "TargetUserName": ["user.name"],
    "IpAddress": ["source.ip"],
    "Protocol": ["network.protocol"],
    "OriginalFileName": ["raw.OriginalFileName"],
}


def path_column(path: str) -> Column | None:
    """Text of an event path, of a key of the raw record, or None when the schema has no such leaf."""
    if path.startswith("raw."):
        return filled(F.get_json_object(col("raw"), "$." + path[4:]))
    dtype: T.DataType = event_schema()
    for part in path.split("."):
        if not isinstance(dtype, T.StructType) or part not in dtype.names:
            return None
        dtype = dtype[part].dataType
    if isinstance(dtype, (T.StructType, T.ArrayType)):
        return None
    return filled(F.col(f"`{path}`") if path == "@timestamp" else F.col(path))


def odd_key(name: str) -> Column | None:
    """Text of a key of the raw record that is no plain word, as it is or, with dots, as a path; None for names a path cannot hold."""
    if any(c in name for c in "'[]*\\") or not name.strip():
        return None
    found = [f"$['{name}']"]
    if "." in name and all(name.split(".")):
        found.append("$" + "".join(f"['{part}']" for part in name.split(".")))
    return F.coalesce(*[filled(F.get_json_object(col("raw"), p)) for p in found])


def mapped(paths: list[str]) -> Column:
    cols = [c for c in (path_column(p) for p in paths) if c is not None]
    return F.coalesce(*cols) if cols else F.lit(None).cast("string")


def _unquote(c: Column) -> Column:
    return filled(F.regexp_replace(c, r"""^["']+|["']+$""", ""))


def audit_process_fields() -> dict[str, Column]:
    """Process fields of audit events; the general table fills in when the command line is blank."""
    exe, name = _unquote(col("process.executable")), _unquote(col("process.name"))
    cmd = filled(col("process.command_line"))
    fallback = {k: mapped(v) for k, v in PROCESS_FIELDS.items()}
    no_cmd = cmd.isNull()
    own = {"Image": F.coalesce(exe, name), "CommandLine": cmd, "User": filled(col("process.user.name"))}
    out = {k: F.coalesce(own.get(k), F.when(no_cmd, v)) if k in own else F.when(no_cmd, v) for k, v in fallback.items()}
    out["ProcessName"] = name
    out["ProcessId"] = col("process.pid").cast("string")
    out["EventTime"] = filled(F.col("`@timestamp`"))
    return out


def with_logsource(df: DataFrame) -> DataFrame:
    """Adds ``ls_product``, ``ls_category`` and ``ls_service``."""
    dataset, category = F.coalesce(col("event.dataset"), F.lit("")), col("event.category")
    raw_type = F.coalesce(F.get_json_object(col("raw"), "$.type"), F.lit(""))
    windows = F.lower(dataset).contains("windows")
    honeypot = dataset == "cowrie"
    zeek = dataset.contains("zeek")
    audit = (dataset == "auditd") | raw_type.isin(AUDIT_TYPES)
    service = F.when(zeek & ~windows & ~honeypot, F.get(F.split(dataset, r"\."), F.lit(1)))
    product = F.when(windows, "windows").when(honeypot, "cowrie").when(zeek, "zeek").otherwise("linux")
    by_windows = F.when(category == "process", "process_creation").when(category == "file", "file_event").when(
        category == "network", "network_connection").when(category == "authentication", "authentication")
    by_honeypot = F.when(category == "process", "process_creation").when(category == "authentication", "authentication")
    by_zeek = F.when(service == "conn", "network_connection").when(service == "dns", "dns")
    by_audit = F.when(raw_type.isin(SYSCALL_TYPES) | (category == "process"), "process_creation").when(
        raw_type == "SOCKADDR", "network_connection")
    kind = F.when(windows, by_windows).when(honeypot, by_honeypot).when(zeek, by_zeek).when(audit, by_audit)
    return df.withColumns({
        "ls_product": product, "ls_category": kind, "ls_service": filled(service),
        "ls_audit": (dataset == "auditd") | raw_type.isin(SYSCALL_TYPES), "ls_honeypot": honeypot,
    })

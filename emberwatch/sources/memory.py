"""Memory regions to anomalies and scanner results to events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.schema import build_events

# Risks that raise an alert, and Windows page and region constants.
ALERT_RISKS = ["HIGH", "CRITICAL"]
MEM_COMMIT, MEM_PRIVATE = 0x1000, 0x20000
PAGE_EXECUTE_READ, PAGE_EXECUTE_READWRITE = 0x20, 0x40


def _anomaly(kind: str, risk: str, confidence: float, details) -> Column:
    details = F.lit(details) if isinstance(details, str) else details
    return F.struct(F.lit(kind).alias("type"), F.lit(risk).alias("risk_level"), F.lit(confidence).alias("confidence"), details.alias("details"))


def not_listed(regions: DataFrame, allowed: DataFrame) -> DataFrame:
    """Leave out processes whose pid or name is on the allow list (one column ``entry``)."""
    entry = allowed.select("entry").distinct()
    out = regions.join(entry, F.col("pid").cast("string") == F.col("entry"), "left_anti")
    return out.join(entry, F.col("comm") == F.col("entry"), "left_anti")


def linux_anomalies(regions: DataFrame) -> DataFrame:
    """Suspicious regions among process map lines (``pid, comm, maps_line, is_elf``).

    Order: executable memfd, writable and executable, anonymous with an ELF header.
    """
    head = F.regexp_extract("maps_line", r"^(\S+)\s+(\S+)\s+\S+\s+\S+\s+\S+ *(.*)$", 1)
    df = regions.withColumns({
        "address": head, "perms": F.regexp_extract("maps_line", r"^(\S+)\s+(\S+)\s+\S+\s+\S+\s+\S+ *(.*)$", 2),
        "path": F.regexp_extract("maps_line", r"^(\S+)\s+(\S+)\s+\S+\s+\S+\s+\S+ *(.*)$", 3)})
    edge = lambda i: F.conv(F.element_at(F.split("address", "-"), i), 16, 10).cast("decimal(20,0)")
    p, path = F.col("perms"), F.col("path")
    runs, wx, rwx = p.contains("x"), p.contains("wx"), p.contains("rwx")
    memfd, anon = path.contains("/memfd:"), (path == "") | (path == "[anon]")
    elf = F.col("is_elf") & (memfd | anon | rwx)
    stack = path.contains("[stack]") | path.contains("[heap]")
    found = (
        F.when(memfd & elf, _anomaly("MEMFD_EXEC", "CRITICAL", 1.0, "Executable memfd with valid ELF header (Reflective Loading)"))
        .when(memfd, _anomaly("MEMFD_EXEC", "HIGH", 0.8, "Executable memfd region"))
        .when(wx & elf, _anomaly("RWX_REGION", "CRITICAL", 1.0, "RWX region containing ELF header"))
        .when(wx & anon, _anomaly("RWX_REGION", "HIGH", 0.85, "Anonymous RWX region (Potential Shellcode)"))
        .when(wx & stack, _anomaly("RWX_REGION", "CRITICAL", 0.95, "Executable Stack/Heap (Buffer Overflow Exploit)"))
        .when(wx, _anomaly("RWX_REGION", "MEDIUM", 0.5, "File-backed RWX region (Possible JIT/Packer)"))
        .when(anon & elf, _anomaly("ANON_ELF", "HIGH", 0.9, "Anonymous region with ELF header (Process Hollowing/Reflective)"))
    )
    df = df.where(runs).withColumns({"a": found, "__elf": elf, "size": (edge(2) - edge(1)).cast("bigint")}).where(F.col("a").isNotNull())
    keep = [c for c in regions.columns if c not in ("maps_line", "is_elf")]
    return df.select(*keep, "address", "size", "perms", "path", F.col("__elf").alias("is_elf"), "a.type", "a.risk_level", "a.confidence", "a.details")


def windows_anomalies(regions: DataFrame) -> DataFrame:
    """Suspicious regions among Windows region rows (``pid, base, size, state, protect, type, header``)."""
    committed, private = F.col("state") == MEM_COMMIT, F.col("type") == MEM_PRIVATE
    rwx = committed & (F.col("protect") == PAGE_EXECUTE_READWRITE)
    rx = committed & (F.col("protect") == PAGE_EXECUTE_READ) & private
    pe = F.concat(F.lit("Detected RWX memory region. PE Header: "), F.when(F.col("header") == "MZ", F.lit("True")).otherwise(F.lit("False")))
    found = (
        F.when(rwx & private, _anomaly("RWX_REGION", "CRITICAL", 0.9, pe)).when(rwx, _anomaly("RWX_REGION", "HIGH", 0.9, pe))
        .when(rx, _anomaly("PRIVATE_EXEC", "MEDIUM", 0.7, "Detected Private Executable memory (Potential Shellcode/JIT)")))
    df = regions.withColumn("a", found).where(F.col("a").isNotNull())
    keep = [c for c in regions.columns if c not in ("base", "state", "protect", "type", "header", "size")]
    return df.select(
        *keep, F.concat(F.lit("0x"), F.lower(F.hex("base"))).alias("address"), "size", F.when(rwx, "RWX").otherwise("RX").alias("perms"),
        F.when(private, "[Private]").otherwise("[Mapped]").alias("path"), F.lit(False).alias("is_elf"), "a.type", "a.risk_level", "a.confidence", "a.details")


ANOMALY = ["type", "address", "size", "perms", "path", "is_elf", "risk_level", "confidence", "details"]


def scan_results(anomalies: DataFrame, keys: list[str]) -> DataFrame:
    """Anomalies of one process scan as one row; a scan is bounded by the process's memory map."""
    return anomalies.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*ANOMALY))).alias("anomalies"))


def linux_scan_events(scans: DataFrame, filtered: bool = True, keep: dict[str, Column] | None = None) -> DataFrame:
    """Scan rows (``ts_iso, host, pid, exe, reason, anomalies``) to memory events.

    Only HIGH and CRITICAL anomalies raise one. ``filtered=False`` also reports
    quiet scans, at severity 1 with full confidence.
    """
    hot = F.filter("anomalies", lambda a: a["risk_level"].isin(ALERT_RISKS))
    df = scans.withColumn("__hot", hot if filtered else F.col("anomalies")).withColumn("__n", F.size(hot))
    if filtered:
        df = df.where(F.col("__n") > 0)
    quiet = F.lit(False) if filtered else F.size("__hot") == 0
    return build_events(df, {
        "@timestamp": F.col("ts_iso"), "host.name": F.col("host"), "event.category": F.lit("memory"),
        "event.action": F.lit("anomaly_detected") if filtered else F.when(quiet, "memory_scan").otherwise("anomaly_detected"),
        "event.type": F.when(quiet, "info"), "event.severity": F.when(quiet, F.lit(1)).otherwise(F.lit(10)), "event.reason": F.col("reason"),
        "detection.confidence": F.when(quiet, F.lit(1.0)), "process.pid": F.col("pid"), "process.executable": F.col("exe"),
        "memory.anomalies": F.col("__hot"),
    }, keep)


def windows_scan_events(scans: DataFrame, keep: dict[str, Column] | None = None) -> DataFrame:
    """Windows scan rows to host events of severity 8."""
    n = F.size("anomalies").cast("string")
    return build_events(scans.where(F.size("anomalies") > 0), {
        "@timestamp": F.col("ts_iso"), "host.name": F.col("host"), "event.category": F.lit("host"), "event.type": F.lit("info"),
        "event.action": F.lit("memory_scan"), "event.severity": F.lit(8), "event.dataset": F.lit("win_memory_scanner"), "process.pid": F.col("pid"),
        "process.name": F.lit("<unknown>"), "process.start_time": F.col("ts_iso"), "memory.anomalies": F.col("anomalies"),
        "detection.rules": F.array(F.lit("WinMemoryScanner")), "detection.severity": F.lit("high"), "detection.confidence": F.lit(0.9),
        "message": F.concat(F.lit("Detected "), n, F.lit(" memory anomalies in PID "), F.col("pid").cast("string")),
    }, keep)

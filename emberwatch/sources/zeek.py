"""Network sensor records (one JSON object per line) to events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.columns import entropy, filled, is_json_object, iso
from emberwatch.schema import build_events

RECORD_DDL = """
ts double, `id.orig_h` string, `id.orig_p` int, `id.resp_h` string, `id.resp_p` int, query string, proto string, orig_bytes bigint,
orig_pkts bigint, version string, method string, uri string, host string, filename string, md5 string, sha256 string
"""
# Logs read, detector bounds, deprecated protocol versions.
LOGS = ["conn", "dns", "http", "ssl", "files"]
MAX_QUERY, MAX_LABELS, MAX_ENTROPY = 70, 7, 5.0
MAX_ICMP_BYTES = 800
WEAK_TLS = ["SSLv2", "SSLv3", "TLSv10"]


def parse_lines(lines: DataFrame) -> DataFrame:
    """Lines (``value``, ``log``) that hold a complete JSON object, parsed; other lines and logs are skipped (``rejected`` returns broken ones)."""
    df = lines.where(is_json_object(F.col("value")) & F.col("log").isin(LOGS))
    return df.withColumn("r", F.from_json("value", RECORD_DDL))


def dns_reasons(query: Column) -> Column:
    """Why a name looks like a tunnel: length, number of labels, entropy."""
    labels = F.size(F.split(query, r"\."))
    bits = entropy(query)
    return F.array_compact(F.array(
        F.when(F.length(query) > MAX_QUERY, F.concat(F.lit("Length("), F.length(query).cast("string"), F.lit(")"))),
        F.when(labels > MAX_LABELS, F.concat(F.lit("Depth("), labels.cast("string"), F.lit(")"))),
        F.when(bits > MAX_ENTROPY, F.concat(F.lit("Entropy("), bits.cast("string"), F.lit(")")))))


def zeek_events(parsed: DataFrame, sensor: str | Column, keep: dict[str, Column] | None = None) -> DataFrame:
    """Parsed records to network and file events with the detectors applied."""
    sensor = F.lit(sensor) if isinstance(sensor, str) else sensor
    r = lambda f: F.col(f"r.`{f}`")
    is_ = {k: F.col("log") == k for k in LOGS}
    query = F.coalesce(r("query"), F.lit(""))
    proto = F.coalesce(r("proto"), F.lit("unknown"))
    version = F.coalesce(r("version"), F.lit("unknown"))
    df = parsed.withColumn("__why", F.when(is_["dns"], dns_reasons(query)))
    tunnel = is_["dns"] & (F.size("__why") > 0)
    icmp = is_["conn"] & (proto == "icmp") & (F.coalesce(r("orig_bytes"), F.lit(0)) > MAX_ICMP_BYTES)
    weak = is_["ssl"] & version.isin(WEAK_TLS)
    name = F.coalesce(r("filename"), F.lit("unknown"))
    return build_events(df, {
        "@timestamp": iso(F.coalesce(F.timestamp_micros(F.round(r("ts") * 1_000_000).cast("bigint")), F.current_timestamp())),
        "event.category": F.when(is_["files"], "file").otherwise("network"), "event.dataset": F.concat(F.lit("zeek."), F.col("log")),
        "event.action": F.lit("network_flow"), "event.severity": F.when(tunnel | icmp | weak, F.lit(7)).otherwise(F.lit(3)),
        "source.ip": filled(r("id.orig_h")), "source.port": F.coalesce(r("id.orig_p"), F.lit(0)),
        "destination.ip": filled(r("id.resp_h")), "destination.port": F.coalesce(r("id.resp_p"), F.lit(0)),
        "host.name": sensor, "host.ip": F.array(F.coalesce(r("id.orig_h"), F.lit(""))),
        "network.protocol": F.when(is_["dns"], "dns").when(is_["conn"], proto).when(is_["ssl"], "ssl").when(is_["http"], "http"),
        "network.transport": F.when(is_["dns"], "udp"),
        "network.application": F.when(is_["ssl"], version).when(is_["http"], "http"),
        "network.direction": F.when(is_["http"], "outbound"),
        "network.bytes": F.when(is_["conn"], F.coalesce(r("orig_bytes"), F.lit(0))),
        "network.packets": F.when(is_["conn"], F.coalesce(r("orig_pkts"), F.lit(0))),
        "dns.question.name": F.when(is_["dns"], filled(query)),
        "file.name": F.when(is_["files"], name), "file.hash.md5": F.when(is_["files"], filled(r("md5"))),
        "file.hash.sha256": F.when(is_["files"], filled(r("sha256"))),
        "threat.technique.id": F.when(tunnel | icmp, "T1071.004").when(weak, "T1573"),
        "threat.technique.name": F.when(tunnel, "DNS Tunneling").when(icmp, "ICMP Tunneling").when(weak, "Insecure TLS Version"),
        "detection.rules": F.when(tunnel, F.transform("__why", lambda w: F.concat(F.lit("DNS Anomaly: "), w)))
        .when(icmp, F.array(F.lit("Large ICMP Payload"))).when(weak, F.array(F.concat(F.lit("Deprecated Protocol: "), version))),
        "detection.confidence": F.when(tunnel, F.lit(0.9)).when(icmp, F.lit(0.8)).when(weak, F.lit(1.0)),
        "detection.severity": F.when(tunnel | icmp, "high").when(weak, "medium"),
        "message": F.when(tunnel, F.concat(F.lit("DNS tunnel ["), F.array_join("__why", ", "), F.lit("]: "), query))
        .when(is_["dns"], F.concat(F.lit("DNS Query: "), query)).when(icmp, F.lit("Suspected ICMP tunnel"))
        .when(is_["conn"], F.concat(F.lit("Conn: "), proto, F.lit(" flow"))).when(weak, F.concat(F.lit("Weak encryption: "), version))
        .when(is_["ssl"], F.concat(F.lit("SSL/TLS Handshake: "), version))
        .when(is_["http"], F.concat(F.lit("HTTP "), F.coalesce(r("method"), F.lit("UNKNOWN")), F.lit(" "), F.coalesce(r("host"), F.lit("")), F.coalesce(r("uri"), F.lit(""))))
        .otherwise(F.concat(F.lit("File in transit: "), name)),
        "raw": F.col("value"),
    }, keep)

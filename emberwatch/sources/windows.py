"""Windows security records and memory regions to events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.functions.columns import basename, filled
from emberwatch.schema import build_events

RECORD_DDL = """
EventID int, TimeCreated string, EventData map<string,string>, Message string, System struct<EventID:int>
"""
# Addresses that name no remote machine.
LOCAL_ADDRESSES = ["-", "::1", "127.0.0.1"]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD_DDL).json(path)


def _number(c: Column) -> Column:
    """Process id in decimal or 0x form."""
    return F.when(c.startswith("0x"), F.conv(F.substring(c, 3, 16), 16, 10).try_cast("int")).otherwise(c.try_cast("int"))


def normalise_records(records: DataFrame, keep: dict[str, Column] | None = None) -> DataFrame:
    """Logon, ticket, process and file records to events; other ids keep only type and time."""
    d = lambda k: F.try_element_at("EventData", F.lit(k))
    eid = F.coalesce("EventID", F.col("System.EventID"), F.lit(0))
    logon, ticket, ntlm, process, access = (eid == n for n in (4624, 4768, 4776, 4688, 4663))
    addr = d("IpAddress")
    exe, obj = filled(d("NewProcessName")), filled(d("ObjectName"))
    pid = F.when(process, F.coalesce(_number(F.coalesce(d("ProcessId"), F.lit("0"))), F.lit(0)))
    return build_events(records, {
        "@timestamp": F.col("TimeCreated"), "event.dataset": F.lit("windows"), "host.os.family": F.lit("windows"),
        "event.category": F.when(logon | ticket | ntlm, "iam").when(process, "process").when(access, "file"),
        "event.action": F.when(logon, "login-success").when(ticket, "login-attempt-domain").when(ntlm, "login-attempt-ntlm")
        .when(process, "process_created").when(access, "access"),
        "event.outcome": F.when(logon | ticket | ntlm, "success"),
        "event.severity": F.when(logon | ticket, F.lit(1)).otherwise(F.lit(5)),
        "user.name": F.when(logon | ticket | ntlm, filled(d("TargetUserName"))),
        "source.ip": F.when(logon & ~addr.isin(LOCAL_ADDRESSES), filled(addr)).when(ticket, filled(F.replace(addr, F.lit("::ffff:"), F.lit(""))))
        .when(ntlm, filled(d("Workstation"))),
        "process.executable": F.when(process, exe), "process.name": F.when(process, basename(exe, "\\")),
        "process.command_line": F.when(process, filled(d("CommandLine"))),
        "process.pid": pid,
        "process.parent.pid": F.when(process, F.coalesce(_number(F.coalesce(d("ParentProcessId"), F.lit("0"))), F.lit(0))),
        "file.path": F.when(access, obj), "file.name": F.when(access, basename(obj, "\\")),
        "message": F.col("Message"),
    }, keep)


def attribute_remote(events: DataFrame, controller: str) -> DataFrame:
    """Domain-controller records with a remote address belong to that machine, others to the controller."""
    ip = filled(F.col("source.ip"))
    remote = ip.isNotNull() & ~ip.isin(LOCAL_ADDRESSES)
    host = F.col("host")
    there = (host.withField("name", F.concat(F.lit("Remote-Host-"), ip)).withField("hostname", ip).withField("ip", F.array(ip))
             .withField("os.family", F.lit("unknown")).withField("os.name", F.lit("unknown")).withField("os.version", F.lit(None).cast("string")))
    here = host.withField("name", F.lit(controller)).withField("hostname", F.lit(controller))
    return events.withColumn("host", F.when(remote, there).otherwise(here))


def blank_addresses(events: DataFrame) -> DataFrame:
    """Blank source and destination addresses become null."""
    return events.withColumns({
        "source": F.col("source").withField("ip", filled(F.col("source.ip"))),
        "destination": F.col("destination").withField("ip", filled(F.col("destination.ip"))),
    })

"""Raw log lines derived row by row from the activity table, to run the parsers on tables of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.functions.columns import literal, pick
from emberwatch.operators.detect import Rule
from emberwatch.sources import tables as A

COMMS = A.PROCESSES + ["sleep", "date"]
ZEEK_LOGS = ["conn", "dns", "http", "ssl", "files"]
TLS = ["TLSv12", "SSLv3", "TLSv10", "TLSv13"]
LONG_NAME = "abcdefghij" * 8 + ".example.com"
DEEP_NAME = "a.b.c.d.e.f.g.h.example.com"
MIXED_NAME = "abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOP.com"
POT_EVENTS = ["cowrie.login.success", "cowrie.login.failed", "cowrie.command.input", "cowrie.direct-tcpip.request",
              "cowrie.session.connect", "cowrie.session.closed"]
WINDOWS_IDS = [4624, 4768, 4776, 4688, 4663, 4625]
PERMS = ["rwxp", "r-xp", "rw-p", "-wxp"]
MAPPED = ["", " /memfd:x (deleted)", " [stack]", " /usr/lib/a.so", " [heap]"]


def _choose(values: list, index: Column) -> Column:
    return F.element_at(F.expr("array(" + ", ".join(literal(v) for v in values) + ")"), (index + 1).cast("int"))


def _stamp() -> Column:
    ms = F.floor(F.unix_micros("ts") / 1000).cast("bigint")
    return F.concat(F.floor(ms / 1000).cast("string"), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))


def audit_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``file, line_no, value``: a login line per signup, a record group per other row."""
    k, uid = F.col("k"), F.col("user_id")
    a = A.activity(spark, folder)
    head = lambda t: F.concat(F.lit(f"type={t} msg=audit("), _stamp(), F.lit(":"), (F.col("event_id") + 1000).cast("string"), F.lit("): "))
    s = lambda c: c.cast("string")
    res = F.when(k % 9 == 0, F.lit(" res=failed")).otherwise(F.lit(" res=success"))
    ses = F.concat(F.lit(" ses="), F.when(k % 17 == 0, F.lit("4294967295")).otherwise(s(uid % 40)))
    addr = F.when(k % 10 == 0, F.lit("?")).otherwise(F.concat(F.lit("10.1."), s(uid % 4), F.lit("."), s(k)))
    words = F.split(_choose(A.COMMANDS, k % 12), " ")
    args = F.array_join(F.transform(words, lambda w, i: F.concat(F.lit("a"), s(i), F.lit('="'), w, F.lit('"'))), " ")
    auid = F.when(k % 11 == 1, F.lit("www-data")).otherwise(s(uid))
    account = F.when(k % 4 == 0, F.lit("0")).otherwise(s(1000 + uid))
    path = _choose(A.FILES, k % 10)
    login = F.array(F.concat(head("USER_LOGIN"), F.lit("pid="), s(1000 + uid), F.lit(" uid=0 addr="), addr, ses, res))
    group = F.array(
        F.concat(head("SYSCALL"), F.lit("arch=c000003e syscall=59 ppid="), s(1000 + uid % 20), F.lit(" pid="), s(1000 + uid), F.lit(" auid="), auid,
                 F.lit(" uid="), account, ses, F.lit(' comm="'), _choose(COMMS, k % 14), F.lit('" exe="'), _choose(A.EXECUTABLES, k % 12), F.lit('"'), res),
        F.concat(head("EXECVE"), F.lit("argc="), s(F.size(words)), F.lit(" "), args),
        F.concat(head("CWD"), F.lit('cwd="/home/u"')),
        F.concat(head("PATH"), F.lit('item=0 name="/bin" nametype=PARENT')),
        F.concat(head("PATH"), F.lit('item=1 name="'), path, F.lit('" nametype=NORMAL')),
        F.concat(head("EOE")),
    )
    lines = F.when(F.col("event_type") == "signup", login).when(k % 3 == 0, F.slice(group, 1, 5)).otherwise(group)
    return a.select(F.concat(F.lit("audit-"), s(uid % 3)).alias("file"), "event_id", F.posexplode_outer(lines).alias("i", "value")).select(
        "file", (F.col("event_id") * 8 + F.col("i")).alias("line_no"), "value")


def zeek_lines(spark: SparkSession, folder: str) -> DataFrame:
    k, uid = F.col("k"), F.col("user_id")
    log = _choose(ZEEK_LOGS, k % 5)
    query = (F.when(k % 7 == 0, F.lit(LONG_NAME)).when(k % 11 == 0, F.lit(DEEP_NAME)).when(k % 13 == 0, F.lit(MIXED_NAME))
             .otherwise(F.concat(F.lit("h"), k.cast("string"), F.lit(".example.com"))))
    on = lambda name, c: F.when(F.col("log") == name, c)
    record = F.struct(
        (F.unix_micros("ts") / 1_000_000).alias("ts"),
        F.concat_ws(".", F.lit("10.0"), (uid % 8).cast("string"), k.cast("string")).alias("id.orig_h"), (40000 + k).alias("id.orig_p"),
        F.concat_ws(".", F.lit("172.16"), (uid % 4).cast("string"), k.cast("string")).alias("id.resp_h"), _choose(A.PORTS, k % 4).alias("id.resp_p"),
        on("dns", query).alias("query"), on("conn", _choose(["icmp", "tcp", "udp"], k % 3)).alias("proto"), on("conn", k * 20).alias("orig_bytes"),
        on("conn", k).alias("orig_pkts"), on("ssl", _choose(TLS, k % 4)).alias("version"), on("http", F.lit("GET")).alias("method"),
        on("http", F.concat(F.lit("/p/"), k.cast("string"))).alias("uri"), on("http", F.lit("site.example")).alias("host"),
        on("files", F.concat(F.lit("f"), k.cast("string"))).alias("filename"), on("files", F.md5(k.cast("string"))).alias("md5"))
    a = A.activity(spark, folder).withColumn("log", log)
    # one line in 50 is a comment the reader must skip
    return a.select(F.col("event_id").alias("seq"), "log", F.when(k % 50 == 49, F.lit("#fields ts uid")).otherwise(F.to_json(record)).alias("value"))


def honeypot_lines(spark: SparkSession, folder: str) -> DataFrame:
    k, uid = F.col("k"), F.col("user_id")
    record = F.struct(
        _choose(POT_EVENTS, k % 6).alias("eventid"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.concat_ws(".", F.lit("59.64"), (uid % 8).cast("string"), k.cast("string")).alias("src_ip"), (50000 + k).alias("src_port"),
        F.lit("192.168.1.5").alias("dst_ip"), F.concat(F.lit("s"), uid.cast("string")).alias("session"),
        F.when(k % 4 == 0, F.lit("root")).alias("username"), F.when(k % 12 == 8, F.lit("")).otherwise(_choose(A.COMMANDS, F.floor(k / 2) % 12)).alias("input"))
    return A.activity(spark, folder).select(F.col("event_id").alias("seq"), F.to_json(record).alias("value"))


def with_broken(lines: DataFrame, every: int = 7) -> DataFrame:
    """The lines with the last character of every so manieth cut off, as a crash of the writer leaves them."""
    cut = F.substring("value", F.lit(1), F.length("value") - 1)
    return lines.withColumn("value", F.when(F.col("seq") % every == 0, cut).otherwise(F.col("value")))


def windows_records(spark: SparkSession, folder: str) -> DataFrame:
    from emberwatch.sources.windows import RECORD_DDL
    k, uid = F.col("k"), F.col("user_id")
    ip = F.when(k % 5 == 0, F.lit("-")).otherwise(F.concat(F.when(k % 2 == 0, F.lit("::ffff:")).otherwise(F.lit("")), F.lit("192.168.7."), k.cast("string")))
    data = F.struct(
        F.concat(F.lit("u"), uid.cast("string")).alias("TargetUserName"), ip.alias("IpAddress"), F.concat(F.lit("WS"), (uid % 9).cast("string")).alias("Workstation"),
        pick(A.EXECUTABLES, k % 12).alias("NewProcessName"), pick(A.COMMANDS, k % 12).alias("CommandLine"),
        F.concat(F.lit("0x"), F.lower(F.hex(1000 + uid))).alias("ProcessId"), (uid % 20 + 4).cast("string").alias("ParentProcessId"),
        pick(A.FILES, k % 10).alias("ObjectName"))
    record = F.struct(_choose(WINDOWS_IDS, k % 6).alias("EventID"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("TimeCreated"), data.alias("EventData"))
    return A.activity(spark, folder).select("event_id", F.from_json(F.to_json(record), RECORD_DDL).alias("r")).select("event_id", "r.*")


def map_lines(spark: SparkSession, folder: str) -> DataFrame:
    k, uid = F.col("k"), F.col("user_id")
    low = lambda c: F.lower(F.lpad(F.hex(c), 8, "0"))
    line = F.concat(low(k * 4096), F.lit("-"), low(k * 4096 + 8192), F.lit(" "), _choose(PERMS, k % 4), F.lit(" 00000000 08:02 173521"), _choose(MAPPED, k % 5))
    return A.activity(spark, folder).select(
        "event_id", (1000 + uid).alias("pid"), pick(A.PROCESSES, k % 12).alias("comm"), line.alias("maps_line"), (k % 2 == 0).alias("is_elf"))


def region_rows(spark: SparkSession, folder: str) -> DataFrame:
    k, uid = F.col("k"), F.col("user_id")
    return A.activity(spark, folder).select(
        "event_id", (1000 + uid).alias("pid"), (k.cast("bigint") * 65536).alias("base"), F.lit(4096).cast("bigint").alias("size"),
        _choose([0x1000, 0x1000, 0x2000], k % 3).alias("state"), _choose([0x40, 0x20, 0x04, 0x40, 0x20], k % 5).alias("protect"),
        _choose([0x20000, 0x1000000], k % 2).alias("type"), F.when(k % 4 == 0, F.lit("MZ")).otherwise(F.lit("")).alias("header"))


def syscalls(spark: SparkSession, folder: str) -> DataFrame:
    """System call per row with host and pid."""
    k, uid = F.col("k"), F.col("user_id")
    return A.activity(spark, folder).select(
        F.col("event_id").alias("seq"), "ts", F.concat(F.lit("host-"), (uid % 20).cast("string")).alias("host"), (1000 + uid).alias("pid"),
        _choose(A.SYSCALLS, k % 6).alias("syscall"), F.md5((F.floor(k / 34)).cast("string")).alias("signature"))


# Parts of command lines that the rules of ``rule_grid`` ask for, and names of programs beside those of the activity table.
COMMAND_PARTS = [["-enc"], ["/dev/tcp", ">&"], ["http://", ".sh"], ["/etc/"], ["-la"], ["evil.example", "/tmp/"], ["/var/www/"], ["-e ", "/bin/sh"],
                 ["-urlcache"], ["/all"], ["base64", "-d"], ["-rf"]]
OWN_PROGRAMS = 288


def rule_grid() -> list[tuple[str, str, str, list[str], str]]:
    """A large rule set of our own making: (id, product, end of the image, parts of the command line, start that is left alone)."""
    images = [e[max(e.rfind("/"), e.rfind("\\")):].lower() for e in A.EXECUTABLES]
    images += [f"\\agent{n:03}.exe" if n % 2 else f"/agent{n:03}" for n in range(OWN_PROGRAMS)]
    out = []
    for i, image in enumerate(images):
        product = "windows" if image.startswith("\\") else "linux"
        out += [(f"grid-{i:03}-{k:02}", product, image, parts, f"quiet{k} ") for k, parts in enumerate(COMMAND_PARTS)]
    return out


def grid_rules() -> list[Rule]:
    """The rules of ``rule_grid`` in the rule language."""
    return [Rule(i, i, "low", product, "process_creation", None, {
        "selection_image": {"Image|endswith": image}, "selection_line": {"CommandLine|contains|all": parts}, "filter_quiet": {"CommandLine|startswith": start},
        "condition": "all of selection_* and not filter_quiet"}, [], []) for i, product, image, parts, start in rule_grid()]

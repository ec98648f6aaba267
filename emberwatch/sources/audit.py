"""Audit log lines to events.

Lines carry ``value`` (text), ``file`` and ``line_no``. Order-dependent steps
work on blocks of line numbers and carry the block ends over, so a file that
holds most of the lines is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.columns import basename, contains_any, fence, filled, iso
from emberwatch.functions.ordered import line_chunk, with_last_known, with_runs_between
from emberwatch.schema import build_events
from emberwatch.session import apply_runtime_conf

# ---------------------------------------------------------------------------
# Fixed values of the audit format and of its filters.
# ---------------------------------------------------------------------------
HEADER = r"msg=audit\((\d+\.\d+):(\d+)\):"
PROCESS_TYPES = ["SYSCALL", "EXECVE", "PROCTITLE"]
LOGIN_TYPES = ["USER_LOGIN", "USER_AUTH"]
NO_SESSION = "4294967295"
NOT_AN_ADDRESS = ["?", "localhost", "127.0.0.1"]
SENSITIVE = ["/etc/passwd", "/etc/shadow", ".ssh", "/etc/sudoers"]
SENSITIVE_COMMANDS = ["/etc/passwd", "/etc/shadow", ".ssh", "authorized_keys"]
NOISE = ["sleep", "date", "uptime", "awk", "sed", "head", "tail", "cut", "tr"]
WEB_USERS = ["www-data", "apache"]
LONG_SLEEP = 60
MAIN_KEYS = ["type", "ses", "addr", "res", "uid", "pid", "ppid", "comm", "exe", "auid"]
# ---------------------------------------------------------------------------


def _kv(line: Column) -> Column:
    """key=value tokens of a line; quotes at the ends go. Needs the last value of a repeated key to win."""
    tokens = F.filter(F.split(F.trim(line), r"\s+"), lambda t: t.contains("="))
    return F.map_from_entries(F.transform(tokens, lambda t: F.struct(
        F.substring_index(t, "=", 1).alias("key"),
        F.btrim(F.substring(t, F.locate("=", t) + 1, F.length(t)), F.lit("\"'")).alias("value"))))


def is_audit_line(line: Column) -> Column:
    return line.contains("type=") | line.contains("msg=audit")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Adds ``ts_epoch``, ``audit_id`` and ``kv``; lines without an audit header are left out.

    Sets the session so that the last value of a repeated key wins.
    """
    apply_runtime_conf(lines.sparkSession)
    return lines.where(F.col("value").rlike(HEADER)).withColumns({
        "ts_epoch": F.regexp_extract("value", HEADER, 1).cast("double"),
        "audit_id": F.regexp_extract("value", HEADER, 2),
        "kv": _kv(F.col("value")),
    })


def raw_events(lines: DataFrame, keep: dict[str, Column] | None = None) -> DataFrame:
    """Lines that are no audit records become raw log events."""
    rest = lines.where(~is_audit_line(F.col("value")) & (F.trim("value") != ""))
    return build_events(rest, {
        "@timestamp": iso(F.current_timestamp()), "message": F.trim("value"), "event.category": F.lit("raw_log"), "event.dataset": F.lit("unknown"),
    }, {"log_file": F.col("file"), "line_no": F.col("line_no"), **(keep or {})})


def group_records(parsed: DataFrame, mode: str = "by_id", block: int | None = None) -> DataFrame:
    """Records of one audit event: ``file, audit_id, ts_epoch, first_line, records``.

    ``by_id`` collects by audit id and time, as ids start again at every boot. ``contiguous`` reproduces the line-by-line
    collector: a run ends when the id changes or at an EOE record, the run still
    open at the end of a file is not emitted, and the run that ends right
    before an EOE line of another id is lost. An audit event is a handful of
    records, so a group is bounded by the log format.
    """
    record = F.struct("line_no", F.col("kv"))
    agg = [F.min("line_no").alias("first_line"), F.collect_list(record).alias("__r")]
    if mode == "by_id":
        out = parsed.groupBy("file", "audit_id", "ts_epoch").agg(*agg)
    else:
        chunk = line_chunk(F.col("line_no"), block) if block else line_chunk(F.col("line_no"))
        run = parsed.withColumns({"__chunk": chunk, "__eoe": F.coalesce(F.try_element_at("kv", F.lit("type")) == "EOE", F.lit(False))})
        value = F.struct(F.col("audit_id").alias("id"), F.col("__eoe").alias("eoe"))
        run = with_runs_between(run, ["file"], "__chunk", ["line_no"], value, lambda last, this: (last["id"] != this["id"]) | last["eoe"], "__run", "__next")
        # what starts right behind the end of a run decides whether the run was handed over; lines of no known file hand nothing over
        handed = F.coalesce(F.col("file").isNotNull() & (F.col("__next.id") != F.col("audit_id")) & ~F.col("__next.eoe"), F.lit(False))
        groups = run.groupBy("file", "__run").agg(
            *agg, F.min_by("ts_epoch", "line_no").alias("ts_epoch"), F.first("audit_id").alias("audit_id"), F.max("__eoe").alias("__closed"), F.max(handed).alias("__handed"))
        out = groups.where(F.col("__closed") | F.col("__handed"))
    ordered = F.array_sort("__r", lambda a, b: (a["line_no"] - b["line_no"]).cast("int"))
    return out.select("file", "audit_id", "ts_epoch", "first_line", F.transform(ordered, lambda r: r["kv"]).alias("records"))


def _get(m: Column, key: str) -> Column:
    return F.try_element_at(m, F.lit(key))


def _pick(records: Column, predicate) -> Column:
    return F.get(F.filter(records, predicate), F.lit(0))


def group_events(groups: DataFrame, host: str | Column, block: int | None = None) -> DataFrame:
    """Audit groups to unified events, with the source address of the session's login."""
    of = lambda kind: (lambda r: _get(r, "type") == kind)
    rec = F.col("records")
    host = F.lit(host) if isinstance(host, str) else host
    g = groups.withColumns({
        "sys": _pick(rec, of("SYSCALL")), "exec": _pick(rec, of("EXECVE")), "cwd": _pick(rec, of("CWD")),
        "pth": F.coalesce(_pick(rec, lambda r: (_get(r, "type") == "PATH") & (_get(r, "nametype") == "NORMAL")), _pick(rec, of("PATH"))),
        "__host": host,
    })
    g = g.withColumn("main", F.coalesce("sys", F.get(rec, F.lit(0))))
    main = F.col("main")
    # arguments a0, a1, ... up to the first gap
    ex = F.col("exec")
    count = F.coalesce(F.size(F.map_keys(ex)), F.lit(0))
    args = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(0))), lambda i: F.try_element_at(ex, F.concat(F.lit("a"), i.cast("string"))))
    g = g.withColumn("__args", args)
    args = F.col("__args")
    upto = F.array_position(F.transform(args, lambda a: a.isNull()), True) - 1
    joined = F.when(ex.isNotNull() & (upto > 0), F.array_join(F.slice(args, F.lit(1), upto.cast("int")), " "))
    # the records are searched once; filters and columns behind the fence read the texts found
    texts = {"__has_sys": F.col("sys").isNotNull(), "__command": F.coalesce(filled(joined), _get(main, "proctitle"), _get(main, "cmdline")),
             "__name": filled(_get(F.col("pth"), "name")), "__cwd": _get(F.col("cwd"), "cwd"), **{f"__m_{k}": _get(main, k) for k in MAIN_KEYS}}
    g = fence(g.withColumns(texts).drop("sys", "exec", "cwd", "pth", "main", "__args"), list(texts))
    of_main = lambda k: F.col(f"__m_{k}")
    kind = F.coalesce(of_main("type"), F.lit("UNKNOWN"))
    proc = kind.isin(PROCESS_TYPES) | F.col("__has_sys")
    login = ~proc & kind.isin(LOGIN_TYPES)
    ses = of_main("ses")
    ses = F.when((proc | login) & (F.coalesce(ses, F.lit("")) != "") & (ses != NO_SESSION), ses)
    addr = F.when(login, F.coalesce(of_main("addr"), F.lit("localhost")))
    g = g.withColumns({"__proc": proc, "__login": login, "__ses": ses, "__addr": addr})
    chunk = line_chunk(F.col("first_line"), block) if block else line_chunk(F.col("first_line"))
    g = with_last_known(g.withColumn("__chunk", chunk), ["file", "__ses"], "__chunk", ["first_line"],
                        F.when(F.col("__ses").isNotNull() & ~F.col("__addr").isin(NOT_AN_ADDRESS), F.col("__addr")), "__known")
    proc, login = F.col("__proc"), F.col("__login")

    g = g.withColumns({"__cmd": F.when(proc, F.col("__command")), "__path": F.when(proc, F.col("__name")), "__uid": F.when(proc, of_main("uid"))})
    failed = F.coalesce(of_main("res") == "failed", F.lit(False))
    severity = F.when(failed, F.lit(4)).otherwise(F.lit(1))
    severity = F.when(F.col("__uid") == "0", F.greatest(severity, F.lit(8))).otherwise(severity)
    hot = contains_any(F.coalesce(filled(F.col("__path")), filled(F.col("__cmd")), F.lit("")), SENSITIVE)
    stamp = iso(F.timestamp_micros((F.col("ts_epoch") * 1_000_000).cast("bigint")))
    return build_events(g, {
        "@timestamp": stamp, "event.dataset": F.lit("auditd"),
        "event.category": F.when(proc, "process").when(login, "authentication"),
        "event.action": F.when(proc, "process_started").when(login, "login"),
        "event.outcome": F.when(failed, "failure").otherwise("success"),
        "event.severity": F.when(hot, F.lit(10)).otherwise(severity),
        "detection.severity": F.when(hot, "critical"),
        "process.pid": F.when(proc, F.coalesce(of_main("pid").try_cast("int"), F.lit(0))),
        "process.parent.pid": F.when(proc, of_main("ppid").try_cast("int")),
        "process.name": F.when(proc, F.coalesce(of_main("comm"), F.lit("unknown"))),
        "process.executable": F.when(proc, filled(of_main("exe"))),
        "process.command_line": filled(F.col("__cmd")),
        "process.cwd": F.when(proc, F.col("__cwd")),
        "process.start_time": F.when(proc, stamp),
        "user.id": F.col("__uid"), "user.name": F.when(proc, of_main("auid")), "user.session_id": F.col("__ses"),
        "source.ip": F.when(login, F.col("__addr")).when(proc, F.col("__known")),
        "file.path": F.col("__path"), "file.name": basename(F.col("__path")),
        "metadata.atlas_label": F.when(F.col("__path").contains("/tmp"), "TEMP_FILE"),
        "host.name": F.col("__host"), "host.hostname": F.col("__host"),
        "raw": F.to_json(F.struct("audit_id", F.col("ts_epoch").alias("timestamp"), "records")),
    }, {"log_file": F.col("file"), "first_line": F.col("first_line"), "seq": F.col("first_line"), "audit_id": F.col("audit_id")})


def ingest_filter(events: DataFrame, filtered: bool = True) -> DataFrame:
    """Drop started processes without a command and quiet tools; ``filtered=False`` keeps everything."""
    if not filtered:
        return events
    cmd, action = filled(F.col("process.command_line")), F.coalesce("event.action", F.lit(""))
    long_sleep = F.exists(F.split(F.coalesce(cmd, F.lit("")), r"\s+"), lambda t: F.coalesce(t.try_cast("bigint") > LONG_SLEEP, F.lit(False)))
    name = F.coalesce(F.col("process.name"), F.lit(""))
    noisy = name.isin(NOISE) & ~((name == "sleep") & long_sleep) & ~F.coalesce(F.col("user.name").isin(WEB_USERS), F.lit(False))
    return events.where(~((action == "process_started") & cmd.isNull()) & ~noisy)


def align_severity(events: DataFrame) -> DataFrame:
    """Sensitive commands report 10, root activity other than a start reports 8."""
    cmd = F.coalesce(F.col("process.command_line"), F.lit(""))
    root = F.coalesce((F.col("user.id") == "0") & (F.coalesce("event.action", F.lit("")) != "process_started"), F.lit(False))
    level = F.when(contains_any(cmd, SENSITIVE_COMMANDS), F.lit(10)).when(root, F.lit(8)).otherwise(F.coalesce("event.severity", F.lit(1)))
    return events.withColumn("event", F.col("event").withField("severity", level))


def audit_events(lines: DataFrame, host: str | Column, mode: str = "by_id", filtered: bool = True) -> DataFrame:
    """Lines to filtered and aligned events."""
    return align_severity(ingest_filter(group_events(group_records(parse_lines(lines), mode), host), filtered))

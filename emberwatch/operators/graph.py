"""Provenance graph of events: typed nodes, edges, parents and chains."""

from __future__ import annotations

from functools import reduce



from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.columns import basename, col, contains_any, filled, spread, text
from emberwatch.operators.labels import label_detail
from emberwatch.session import apply_runtime_conf

# Action groups of file edges, directions of network edges, login words.
READ_ACTIONS = ["read", "open", "access"]
WRITE_ACTIONS = ["write", "create", "modify", "rename", "moved-to", "truncate"]
DELETE_ACTIONS = ["delete", "remove", "unlink"]
OUTBOUND = ["outbound", "egress"]
INBOUND = ["inbound", "ingress"]
LOGIN_WORDS = ["login", "logon", "logout", "logoff", "auth"]
MEMORY_SEVERITY, MEMORY_TECHNIQUE = 9, "T1055"


def node_key(*parts: Column) -> Column:
    """md5 of the parts joined with '|'; a missing part counts as ''."""
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def pid_table(df: DataFrame) -> DataFrame:
    """Start time per host and pid: the latest written entry wins."""
    return df.groupBy("host", "pid").agg(F.max_by("start_time", "seq").alias("start_time"))


def with_start_times(df: DataFrame, pids: DataFrame | None) -> DataFrame:
    """Adds ``start_own`` and ``start_parent`` from the pid table; both null without one."""
    if pids is None:
        return df.withColumns({"start_own": F.lit(None).cast("string"), "start_parent": F.lit(None).cast("string")})
    own = pids.select(F.col("host").alias("__h"), F.col("pid").alias("__p"), F.col("start_time").alias("start_own"))
    par = pids.select(F.col("host").alias("__h2"), F.col("pid").alias("__p2"), F.col("start_time").alias("start_parent"))
    out = df.join(own, (col("host.name") == F.col("__h")) & (col("process.pid") == F.col("__p")), "left")
    out = out.join(par, (col("host.name") == F.col("__h2")) & (col("process.parent.pid") == F.col("__p2")), "left")
    return out.drop("__h", "__p", "__h2", "__p2")


def event_node_id() -> Column:
    """Identity of an event by category; expects ``start_own``."""
    host = F.coalesce(col("host.name"), F.lit("unknown"))
    stamp = F.coalesce(F.col("`@timestamp`"), F.lit(""))
    category = col("event.category")
    start = F.coalesce(F.col("start_own"), filled(col("process.start_time")), stamp)
    return (
        F.when(category == "process", node_key(host, F.coalesce(col("process.pid"), F.lit(0)), col("process.executable"), start))
        .when(category == "file", node_key(host, F.coalesce(col("file.path"), F.lit("unknown")), stamp))
        .when(category == "network", node_key(host, col("source.ip"), col("source.port"), col("destination.ip"),
                                              col("destination.port"), col("network.protocol"), stamp))
        .when(category == "authentication", node_key(host, col("user.name"), col("source.ip"), col("event.outcome"), stamp))
        .otherwise(F.md5(F.coalesce(col("event.id"), F.lit("unknown"))))
    )


def file_relation(action: Column) -> Column:
    a = text(action)
    return F.when(a.isin(READ_ACTIONS), "read").when(a.isin(WRITE_ACTIONS), "write").when(a.isin(DELETE_ACTIONS), "delete").otherwise("file_op")


def network_relation(direction: Column) -> Column:
    d = text(direction)
    return F.when(d.isin(OUTBOUND), "connect_outbound").when(d.isin(INBOUND), "connect_inbound").otherwise("connect")


def _network_label() -> Column:
    ip, port, proto = filled(col("destination.ip")), col("destination.port"), filled(col("network.protocol"))
    port = F.when(port != 0, port.cast("string"))
    return F.when(ip.isNull(), F.coalesce(proto, F.lit("network"))).otherwise(F.concat_ws(":", proto, ip, port))


def _props(**entries: Column) -> Column:
    pairs = [x for k, v in entries.items() for x in (F.lit(k), v.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def event_parts(df: DataFrame, pids: DataFrame | None = None) -> DataFrame:
    """Node ids and flags of every event in flat columns; the base of nodes and edges."""
    apply_runtime_conf(df.sparkSession)
    df = with_start_times(df, pids).withColumn("__d", label_detail())
    category = F.coalesce(col("event.category"), F.lit(""))
    host = F.coalesce(filled(col("host.name")), F.lit("unknown"))
    stamp = F.coalesce(F.col("`@timestamp`"), F.lit(""))
    pid, exe = F.coalesce(col("process.pid"), F.lit(0)), F.coalesce(col("process.executable"), F.lit(""))
    ppid = F.coalesce(col("process.parent.pid"), F.lit(0))
    start = F.coalesce(F.col("start_own"), filled(col("process.start_time")), stamp)
    path = filled(col("file.path"))
    src, dst, proto = filled(col("source.ip")), filled(col("destination.ip")), filled(col("network.protocol"))
    user, outcome = filled(col("user.name")), filled(col("event.outcome"))
    has_file = path.isNotNull() | filled(col("file.name")).isNotNull()
    has_net = F.coalesce(proto, src, dst).isNotNull()
    has_auth = contains_any(text(col("event.action")), LOGIN_WORDS) | text(outcome).isin("success", "failure") | F.coalesce(user, src).isNotNull()
    wants_file = (category == "file") | (~category.isin("authentication", "network") & has_file)
    wants_net = (category == "network") | (~category.isin("authentication", "file") & has_net)
    wants_auth = (category == "authentication") | (~category.isin("network", "file") & has_auth)
    own = event_node_id()
    return df.select(
        "seq", *([c for c in ("case_id",) if c in df.columns]), stamp.alias("stamp"), category.alias("category"), host.alias("host"),
        F.when(host != "unknown", node_key(F.lit("host"), host)).alias("host_id"),
        own.alias("event_node"),
        F.when((pid != 0) | (exe != ""), node_key(host, pid, exe, start)).alias("process_id"),
        pid.alias("pid"), exe.alias("exe"), ppid.alias("ppid"),
        F.coalesce(filled(col("process.parent.executable")), filled(col("process.parent.path")), F.lit("")).alias("parent_exe"),
        F.coalesce(F.col("start_parent"), filled(col("process.parent.start_time")), F.lit("unknown")).alias("parent_start"),
        F.when(wants_file & path.isNotNull(), node_key(F.lit("file"), host, path)).alias("file_id"),
        F.when(wants_net & has_net, node_key(F.lit("network"), host, dst, col("destination.port"), proto)).alias("network_id"),
        F.when(wants_auth & F.coalesce(user, src).isNotNull(), node_key(F.lit("auth"), host, user, src, outcome)).alias("auth_id"),
        F.when(category == "memory", node_key(F.lit("anomaly"), stamp, own)).alias("anomaly_id"),
        F.col("__d.label").alias("label"), col("process.command_line").alias("command_line"),
        col("host.hostname").alias("hostname"), F.array_join(col("host.ip"), ",").alias("host_ips"), col("host.os.name").alias("os"),
        path.alias("path"), col("file.name").alias("file_name"), col("file.extension").alias("extension"), col("file.size").alias("size"),
        src.alias("source_ip"), col("source.port").alias("source_port"), dst.alias("destination_ip"),
        col("destination.port").alias("destination_port"), proto.alias("protocol"), col("network.direction").alias("direction"),
        user.alias("user"), outcome.alias("outcome"), col("event.action").alias("action"), _network_label().alias("network_label"),
        F.to_json(col("memory.anomalies")).alias("anomalies"),
    )


def _node(id_: str, kind: str, label: Column, props: Column, semantic: bool = True, severity: int = 0, technique: str = "") -> Column:
    body = F.struct(
        F.col(id_).alias("id"), F.lit(kind).alias("type"), label.alias("label"),
        (F.col("label") if semantic is True else F.lit("") if semantic is False else semantic).alias("semantic"),
        F.lit(severity).alias("severity"), F.lit(technique).alias("technique"), props.alias("properties"),
    )
    return F.when(F.col(id_).isNotNull(), body)


def event_nodes(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Every node mention, one pass over the events."""
    c = F.col
    pid_text = F.when(c("pid") != 0, F.concat(F.lit(" (PID:"), c("pid").cast("string"), F.lit(")"))).otherwise(F.lit(""))
    name = F.when(c("exe") != "", basename(c("exe"))).otherwise(F.lit("process"))
    who = F.when(c("user").isNotNull() & c("source_ip").isNotNull(), F.concat_ws("@", "user", "source_ip")).otherwise(F.coalesce("user", "source_ip"))
    mentions = F.array_compact(F.array(
        _node("host_id", "host", c("host"), _props(host=c("host"), hostname=c("hostname"), ip=c("host_ips"), os=c("os")), False),
        _node("anomaly_id", "memory_anomaly", F.lit("Memory Anomaly"), _props(details=c("anomalies")), False, MEMORY_SEVERITY, MEMORY_TECHNIQUE),
        _node("process_id", "process", F.concat(name, pid_text), _props(pid=c("pid"), command_line=c("command_line"), host=c("host")),
              F.when(c("category") == "process", c("label")).otherwise(F.lit(""))),
        _node("file_id", "file", basename(c("path")), _props(path=c("path"), name=c("file_name"), extension=c("extension"), size=c("size"), host=c("host"))),
        _node("network_id", "network", c("network_label"),
              _props(source_ip=c("source_ip"), source_port=c("source_port"), destination_ip=c("destination_ip"),
                     destination_port=c("destination_port"), protocol=c("protocol"), direction=c("direction"), host=c("host"))),
        _node("auth_id", "authentication", who, _props(user=c("user"), source_ip=c("source_ip"), outcome=c("outcome"), host=c("host"))),
    ))
    rows = parts.select(*keys, "seq", F.posexplode_outer(mentions).alias("slot", "n")).where(F.col("n").isNotNull())
    return rows.select(*keys, F.col("n.id").alias("id"), (F.col("seq") * 10 + F.col("slot")).alias("ord"), "n")


def _first_nodes(mentions: DataFrame, keys: list[str]) -> DataFrame:
    """The first mention of a node defines it; combines before the shuffle."""
    # properties is a map and cannot sit in a comparison, so only the order column is compared
    first = mentions.groupBy(*keys, "id").agg(F.min_by("n", "ord").alias("n"), F.min("ord").alias("ord"))
    return first.select(*keys, "id", "ord", *[F.col(f"n.{f}").alias(f) for f in ("type", "label", "semantic", "severity", "technique", "properties")])


def event_edges(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Edges an event states directly: process to object, else host to object."""
    c = F.col

    def edge(target: str, relation: Column, host_relation: str, slot: int) -> Column:
        source = F.coalesce("process_id", "host_id")
        rel = F.when(c("process_id").isNotNull(), relation).otherwise(F.lit(host_relation))
        return F.when(c(target).isNotNull() & source.isNotNull(), F.struct(
            source.alias("source"), c(target).alias("target"), rel.alias("relation"), (c("seq") * 10 + slot).alias("ord")))

    found = F.array_compact(F.array(
        F.when(c("anomaly_id").isNotNull(), F.struct(c("event_node").alias("source"), c("anomaly_id").alias("target"),
                                                     F.lit("triggered_anomaly").alias("relation"), (c("seq") * 10).alias("ord"))),
        edge("file_id", file_relation(c("action")), "host_file", 1),
        edge("network_id", network_relation(c("direction")), "host_network", 2),
        edge("auth_id", F.lit("auth"), "host_auth", 3),
    ))
    return spread(parts, [*keys, "stamp"], found, "e").select(*keys, "e.source", "e.target", "e.relation", "stamp", "e.ord")


def build_graph(df: DataFrame, pids: DataFrame | None = None, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the events, per case when ``keys`` are given.

    All de-duplication is a hash aggregate with map-side combine, so a host or
    process that holds a large share of the events is reduced before it moves.
    Parent links are reduced to distinct (child, parent pid) pairs before they
    are joined to the process nodes. A parent that was never seen gets one
    placeholder per host and pid, named by the first event that mentions it.
    """
    keys = keys or []
    parts = event_parts(df, pids)
    nodes = _first_nodes(event_nodes(parts, keys), keys)
    direct = event_edges(parts, keys)

    links = parts.where((F.col("ppid") > 0) & F.col("process_id").isNotNull()).groupBy(
        *keys, "host", "ppid", "parent_exe", "parent_start", "process_id").agg(
        F.min_by("stamp", "seq").alias("stamp"), F.min("seq").alias("seq"))
    process = parts.where(F.col("process_id").isNotNull()).groupBy(*keys, "host", F.col("pid").alias("ppid")).agg(
        F.min_by("process_id", "seq").alias("known_parent"))
    parents = links.groupBy(*keys, "host", "ppid").agg(F.min_by(F.struct("parent_exe", "parent_start"), "seq").alias("p"))
    parents = parents.join(process, [*keys, "host", "ppid"], "left").select(
        *keys, "host", "ppid", "known_parent",
        F.coalesce("known_parent", node_key(F.col("host"), F.col("ppid"), F.col("p.parent_exe"), F.col("p.parent_start"))).alias("parent_id"))
    on = [*keys, "host", "ppid"]
    parents = parents.select(*[F.col(k).alias(f"__{k}") for k in on], "known_parent", "parent_id")
    linked = links.join(parents, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in on]))
    spawned = linked.select(*keys, F.col("parent_id").alias("source"), F.col("process_id").alias("target"),
                            F.lit("spawned").alias("relation"), "stamp", (F.col("seq") * 10 + 9).alias("ord"))
    edges = direct.unionByName(spawned).groupBy(*keys, "source", "target", "relation").agg(
        F.min_by("stamp", "ord").alias("timestamp"), F.min("ord").alias("ord"))

    missing = linked.where(F.col("known_parent").isNull()).groupBy(*keys, F.col("parent_id").alias("id")).agg(
        F.min(F.struct("seq", "ppid", "host")).alias("p"))
    # no process of that host and pid exists, so no node can have the id
    placeholders = missing.select(
        *keys, "id", (F.col("p.seq") * 10 + 9).alias("ord"), F.lit("process").alias("type"),
        F.concat(F.lit("parent (PID:"), F.col("p.ppid").cast("string"), F.lit(")")).alias("label"), F.lit("").alias("semantic"),
        F.lit(0).alias("severity"), F.lit("").alias("technique"), _props(pid=F.col("p.ppid"), host=F.col("p.host")).alias("properties"))
    return nodes.unionByName(placeholders), edges


def chain(nodes: DataFrame, edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Edges with the type and label of both ends, to be read in time order."""
    keys = keys or []
    ends = nodes.select(*keys, "id", "type", "label")
    src = ends.select(*keys, F.col("id").alias("source"), F.col("type").alias("source_type"), F.col("label").alias("source_label"))
    dst = ends.select(*keys, F.col("id").alias("target"), F.col("type").alias("target_type"), F.col("label").alias("target_label"))
    out = edges.join(src, [*keys, "source"], "left").join(dst, [*keys, "target"], "left")
    return out.fillna("unknown", ["source_type", "source_label", "target_type", "target_label"])


def entities(df: DataFrame) -> DataFrame:
    """Typed entities of each event with their role; id is ``type:value``."""
    def entry(kind: str, role: str, c: Column) -> Column:
        v = filled(c.cast("string"))
        return F.when(v.isNotNull(), F.struct(F.lit(kind).alias("type"), F.lit(role).alias("role"), v.alias("value")))

    found = F.array_compact(F.array(
        entry("host", "target", col("host.name")), entry("ip", "source", col("source.ip")), entry("ip", "destination", col("destination.ip")),
        entry("user", "subject", col("user.name")), entry("process", "subject", col("process.name")),
        entry("process", "parent", col("process.parent.name")), entry("file", "object", col("file.path")),
    ))
    return spread(df, ["seq"], found, "e").select(
        "seq", "e.type", "e.role", "e.value", F.concat_ws(":", F.col("e.type"), F.col("e.value")).alias("entity_id"))



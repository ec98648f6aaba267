"""The unified event: one nested record per log event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberwatch.functions.columns import filled, is_json_object, parse_iso

EVENT_DDL = """
`@timestamp` string,
event struct<id:string,category:string,type:string,action:string,outcome:string,severity:int,dataset:string,reason:string>,
source struct<ip:string,port:int,mac:string,bytes:bigint,
              geo:struct<country_name:string,city_name:string,location:struct<lat:double,lon:double>>>,
destination struct<ip:string,port:int,mac:string,bytes:bigint>,
host struct<name:string,hostname:string,ip:array<string>,os:struct<family:string,name:string,version:string>>,
process struct<pid:int,name:string,executable:string,command_line:string,cwd:string,working_directory:string,
               parent:struct<pid:int,name:string,executable:string,command_line:string,path:string,start_time:string>,
               user:struct<name:string,id:string>,start_time:string>,
file struct<path:string,name:string,extension:string,size:bigint,hash:struct<md5:string,sha256:string>>,
network struct<protocol:string,transport:string,application:string,bytes:bigint,packets:bigint,direction:string>,
user struct<name:string,id:string,domain:string,session_id:string,audit_id:string,password:string>,
threat struct<framework:string,tactic:struct<id:string,name:string>,technique:struct<id:string,name:string>,confidence:double>,
dns struct<question:struct<name:string>>,
url struct<original:string>,
http struct<request:struct<method:string>>,
zeek struct<conn_state:string>,
message string,
raw string,
metadata struct<atlas_label:string,path_signature:string>,
detection struct<rules:array<string>,confidence:double,severity:string>,
memory struct<anomalies:array<struct<type:string,address:string,size:bigint,perms:string,path:string,is_elf:boolean,
              risk_level:string,confidence:double,details:string>>>,
tags array<string>
"""

# The reporting default of an event that states no severity, and the threat framework name.
DEFAULT_SEVERITY = 5
FRAMEWORK = "MITRE ATT&CK"


def _nested(dtype: T.DataType, path: str, given: dict[str, str]) -> str:
    """SQL text of one event column whose leaves are the flat columns in ``given``, other leaves null."""
    if path in given:
        return f"CAST(`{given[path]}` AS {dtype.simpleString()})"
    if isinstance(dtype, T.StructType):
        parts = ", ".join(f"'{f.name}', {_nested(f.dataType, f'{path}.{f.name}', given)}" for f in dtype.fields)
        return f"named_struct({parts})"
    return f"CAST(NULL AS {dtype.simpleString()})"


def build_events(df: DataFrame, values: dict[str, Column], keep: dict[str, Column] | None = None) -> DataFrame:
    """Events from expressions by dotted path, plus the columns in ``keep``.

    The leaves are computed in a flat projection first. Later operators then
    read plain columns instead of repeating the expressions behind them.
    """
    keep = keep or {}
    names = {path: f"__v{i}" for i, path in enumerate(values)}
    flat = df.select(*[c.alias(n) for n, c in keep.items()], *[c.alias(names[p]) for p, c in values.items()])
    return flat.select(*keep, *[
        F.expr(_nested(f.dataType, f.name, names)).alias(f.name) for f in event_schema().fields])


def event_schema() -> T.StructType:
    return T.StructType.fromDDL(EVENT_DDL)


def leaves(dtype: T.DataType, path: str) -> dict[str, T.DataType]:
    """Leaf paths below a column with their types."""
    if isinstance(dtype, T.StructType):
        return {p: t for f in dtype.fields for p, t in leaves(f.dataType, f"{path}.{f.name}").items()}
    return {path: dtype}


def prune(dtype: T.DataType, c: Column) -> Column:
    """Null for everything empty: blank text, empty arrays, structs without any filled leaf."""
    if isinstance(dtype, T.StringType):
        return filled(c)
    if isinstance(dtype, T.ArrayType):
        return F.when(F.size(c) > 0, c)
    if isinstance(dtype, T.StructType):
        inner = [prune(f.dataType, c[f.name]) for f in dtype.fields]
        return F.when(F.coalesce(*[F.when(i.isNotNull(), F.lit(True)) for i in inner]),
                      F.struct(*[i.alias(f.name) for i, f in zip(inner, dtype.fields)]))
    return c


def conform(df: DataFrame, json_col: str = "value") -> DataFrame:
    """JSON text to the event schema.

    Text that is no complete JSON object is left out (``rejected`` returns it).
    Unknown keys are dropped, a sub-object of the wrong shape becomes null, a
    missing severity takes the default, and ``timestamp`` is accepted for
    ``@timestamp``. All other input columns are kept.
    """
    schema = T.StructType(event_schema().fields + [T.StructField("timestamp", T.StringType())])
    keep = [c for c in df.columns if c != json_col]
    parsed = df.where(is_json_object(F.col(json_col))).select(*keep, F.from_json(F.col(json_col), schema).alias("e"))
    return normalise(parsed.select(*keep, "e.*"))


def normalise(df: DataFrame) -> DataFrame:
    """Fill what events may leave out and add the parsed ``ts``.

    Blank text becomes null, and a missing object becomes one with null leaves.
    """
    present = [f for f in event_schema().fields if f.name in df.columns]
    values = {}
    for f in present:
        for path, t in leaves(f.dataType, f.name).items():
            c = F.col(f"`{path}`") if path == f.name else F.col(path)
            values[path] = filled(c) if isinstance(t, T.StringType) else c
    if "timestamp" in df.columns:
        values["@timestamp"] = F.coalesce(values["@timestamp"], filled(F.col("timestamp")))
    severity = values.get("event.severity", F.lit(None).cast("int"))
    values["event.severity"] = F.coalesce(severity, F.lit(DEFAULT_SEVERITY))
    names = {f.name for f in event_schema().fields}
    keep = {c: F.col(f"`{c}`") for c in df.columns if c not in names and c not in ("timestamp", "ts")}
    return build_events(df, values, {**keep, "ts": parse_iso(values["@timestamp"])})


def to_documents(df: DataFrame) -> DataFrame:
    """Events to JSON text, one document per row; empty fields and objects are left out."""
    cols = [prune(f.dataType, F.col(f"`{f.name}`")).alias(f.name) for f in event_schema().fields if f.name in df.columns]
    return df.select(F.to_json(F.struct(*cols)).alias("value"))

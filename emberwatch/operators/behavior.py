"""System call sequences, debounced triggers and de-duplicated alerts on tables."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberwatch.functions.ordered import time_chunk, with_runs

# ---------------------------------------------------------------------------
# Ordered pairs, single calls worth a scan, horizons in seconds.
# ---------------------------------------------------------------------------
SEQUENCES = [
    ("ptrace", "write", "Ptrace Injection"),
    ("memfd_create", "execve", "Fileless Execution"),
    ("write", "mprotect", "Memory Tampering"),
]
SINGLE_CALLS = [("ptrace", "Suspicious Ptrace"), ("memfd_create", "Memfd Creation")]
HORIZON_SECONDS = 10
TRIGGER_SECONDS = 5
ALERT_SECONDS = 300
CALL_WORDS = ["ptrace", "memfd_create", "mprotect"]
# ---------------------------------------------------------------------------


def tag_syscall(text: Column) -> Column:
    """First known call named in a text."""
    return F.coalesce(*[F.when(text.contains(w), F.lit(w)) for w in CALL_WORDS])


def call_patterns(calls: DataFrame, horizon: int = HORIZON_SECONDS, chunk: int | None = None) -> DataFrame:
    """Adds ``reason``: the first sequence seen within the horizon that ends at each call, else a single risky call.

    Input: ``seq, ts, host, pid, syscall``. Time is cut into chunks; the calls
    of the last horizon before a chunk are replicated into it, so the windows
    run per (host, pid, chunk) and a busy process is spread over tasks.
    """
    chunk = chunk or max(3600, horizon)
    size, back = chunk * 1_000_000, horizon * 1_000_000
    us = F.unix_micros("ts")
    own = F.floor(us / F.lit(size)).cast("bigint")
    late = F.floor((us + F.lit(back)) / F.lit(size)).cast("bigint")
    df = calls.withColumns({"__us": us, "__own": own}).withColumn("__chunk", F.explode(F.sequence("__own", late)))
    w = Window.partitionBy("host", "pid", "__chunk").orderBy("__us", "seq")
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    call, since = F.col("syscall"), F.col("__us") - F.lit(back)
    prior = {f"__p{i}": F.max(F.when(call == a, F.col("__us"))).over(before) for i, (a, _, _) in enumerate(SEQUENCES)}
    df = df.withColumns(prior)
    pairs = {f"__q{i}": F.max(F.when(call == b, F.col(f"__p{i}"))).over(upto) for i, (_, b, _) in enumerate(SEQUENCES)}
    single = {f"__s{i}": F.max(F.when(call == a, F.col("__us"))).over(upto) for i, (a, _) in enumerate(SINGLE_CALLS)}
    df = df.withColumns({**pairs, **single}).where(F.col("__chunk") == F.col("__own"))
    reason = F.coalesce(
        *[F.when(F.col(f"__q{i}") > since, F.lit(n)) for i, (_, _, n) in enumerate(SEQUENCES)],
        *[F.when(F.col(f"__s{i}") > since, F.lit(n)) for i, (_, n) in enumerate(SINGLE_CALLS)])
    return df.withColumn("reason", reason).select(*calls.columns, "reason")


def _whole_slices(batches):
    """Batches cut anew so that every slice is complete; rows arrive in slice and time order, ``__first`` marks where a slice begins."""
    import pandas as pd

    held = []
    for pdf in batches:
        starts = np.flatnonzero(pdf["__first"].to_numpy(bool))
        if not len(starts):
            held.append(pdf)
            continue
        block = pd.concat([*held, pdf.iloc[:starts[-1]]], ignore_index=True)
        held = [pdf.iloc[starts[-1]:]]
        if len(block):
            yield block
    if held:
        yield pd.concat(held, ignore_index=True)


class _Jumps:
    """The fold's moves in a block of slices: from an accepted row to the first row at least ``gap`` later."""

    def __init__(self, block, gap: int):
        first = block["__first"].to_numpy(bool)
        self.t = block["__us"].to_numpy(np.int64)
        self.begin = np.flatnonzero(first)
        self.slice = np.cumsum(first) - 1
        self.since = self.t - self.t[self.begin][self.slice]
        # slices laid end to end, further apart than a jump reaches
        self.span = int(self.since.max()) + gap + 1
        self.place = self.since + self.slice * self.span
        self.next = np.searchsorted(self.place, self.place + gap)
        self.end = np.append(self.begin[1:], len(self.t))


def _summarise(gap: int, heads: list[str]):
    """Slice → how it leaves the fold, as a step function of the first time it may accept."""

    def summarise(batches):
        for block in _whole_slices(batches):
            j = _Jumps(block, gap)
            here = np.arange(len(j.t))
            last = np.where(j.next < j.end[j.slice], j.next, here)
            while True:
                further = last[last]
                if np.array_equal(further, last):
                    break
                last = further
            leave = j.t[last]
            # what was accepted earlier lies before the slice and hides less than one gap of it
            may_start = np.append(True, j.since[:-1] < gap) | (j.since == 0)
            at = np.flatnonzero(may_start)
            of, x = j.slice[at], leave[at]
            at = at[np.append((of[1:] != of[:-1]) | (x[1:] != x[:-1]), True)]
            cuts = np.cumsum(np.bincount(j.slice[at], minlength=len(j.begin)))[:-1]
            yield block.loc[j.begin, heads].assign(__upto=np.split(j.t[at], cuts), __exit=np.split(leave[at], cuts))

    return summarise


def _chain(gap: int, heads: list[str], never: int):
    """Slices of each key in order → the last accepted time every slice starts from."""

    def chain(batches):
        entry = never
        for pdf in batches:
            out = []
            for first, upto, leave in zip(pdf["__first"], pdf["__upto"], pdf["__exit"]):
                entry = never if first else entry
                out.append(entry)
                i = int(np.searchsorted(upto, entry + gap))
                if i < len(upto):
                    entry = int(leave[i])
            yield pdf[heads].assign(__entry=out)

    return chain


def _walk(gap: int):
    """Accepted rows of each slice."""

    def walk(batches):
        for block in _whole_slices(batches):
            j = _Jumps(block, gap)
            wait = np.maximum(block["__entry"].to_numpy(np.int64)[j.begin] + gap - j.t[j.begin], 0)
            at, end = np.searchsorted(j.place, wait + np.arange(len(j.begin)) * j.span), j.end
            keep = np.zeros(len(j.t), bool)
            while len(at):
                inside = at < end
                at, end = at[inside], end[inside]
                keep[at] = True
                at = j.next[at]
            yield block.loc[keep, ["__seq"]]

    return walk


NEVER = -(2 ** 61)


def debounce(df: DataFrame, keys: list[str], seconds: int, chunk: int = 3600) -> DataFrame:
    """Rows accepted when at most one per ``seconds`` may pass, counted from the last accepted one.

    Input: keys, ``ts`` and a unique ``seq``. The rule is a sequential fold. Each
    key's time is cut into slices of ``chunk`` seconds; a slice is reduced to a
    small step function (where the fold leaves it, by where it may start), only
    these summaries are chained per key, and then every slice is walked on its
    own. A key that holds most of the rows is thus handled by many tasks, and
    equal times collapse before anything is shuffled. Within a slice the fold is
    a jump table over sorted times: the work is n log n, whatever the gap hides.
    Rows without a time are never accepted.
    """
    chunk = max(chunk, seconds)
    gap = seconds * 1_000_000
    names = [f"__k{i}" for i in range(len(keys))]
    heads = [*names, "__chunk"]
    times = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], time_chunk(F.col("ts"), chunk).alias("__chunk"),
                      F.unix_micros("ts").alias("__us"), "seq").where("__us is not null").groupBy(*heads, "__us").agg(F.min("seq").alias("__seq"))
    slices = Window.partitionBy(*heads).orderBy("__us")
    times = times.withColumn("__first", F.row_number().over(slices) == 1)
    head = [times.schema[n] for n in heads]
    longs = T.ArrayType(T.LongType())
    # the window leaves every slice complete and sorted inside one partition
    summaries = times.select(*heads, "__us", "__first").mapInPandas(
        _summarise(gap, heads), T.StructType([*head, T.StructField("__upto", longs), T.StructField("__exit", longs)]))
    order = Window.partitionBy(*names).orderBy("__chunk")
    entries = summaries.withColumn("__first", F.row_number().over(order) == 1).mapInPandas(
        _chain(gap, heads, NEVER), T.StructType([*head, T.StructField("__entry", T.LongType())]))
    entries = entries.select(*[F.col(n).alias(n + "e") for n in heads], "__entry")
    on = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(n + "e")) for n in heads])
    started = times.drop("__first").join(entries, on).select(*heads, "__us", "__seq", "__entry").withColumn(
        "__first", F.row_number().over(slices) == 1)
    accepted = started.select("__us", "__seq", "__entry", "__first").mapInPandas(
        _walk(gap), T.StructType([T.StructField("__seq", times.schema["__seq"].dataType)]))
    return df.join(accepted, df["seq"] == accepted["__seq"], "left_semi")


def distinct_alerts(alerts: DataFrame, keys: list[str], seconds: int = ALERT_SECONDS, chunk: int = 3600) -> DataFrame:
    """Alerts that are not a repetition of the key's last alert within ``seconds``.

    Input: keys, ``ts``, ``seq``, ``signature``. A changed signature is always
    reported, so the last reported signature is that of the row before; runs of
    one signature are debounced on their own.
    """
    df = alerts.withColumn("__c", time_chunk(F.col("ts"), max(chunk, seconds)))
    df = with_runs(df, keys, "__c", ["ts", "seq"], F.col("signature"), "__run").drop("__c")
    return debounce(df, [*keys, "__run"], seconds, chunk).drop("__run")


def alert_signature(anomalies: Column) -> Column:
    return F.md5(F.to_json(anomalies))


def scan_triggers(calls: DataFrame, horizon: int = HORIZON_SECONDS, gap: int = TRIGGER_SECONDS) -> DataFrame:
    """Calls that start a memory scan: a pattern matched and the process was not scanned just before.

    Calls that are part of no pattern are left out first, so they never start a scan.
    """
    wanted = sorted({c for a, b, _ in SEQUENCES for c in (a, b)} | {c for c, _ in SINGLE_CALLS})
    hits = call_patterns(calls.where(F.col("syscall").isin(wanted)), horizon).where(F.col("reason").isNotNull())
    return debounce(hits, ["host", "pid"], gap, max(3600, gap))

"""Related events around anchors and the expansion of a seed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.functions.columns import basename, col, contains_any, filled, spread
from emberwatch.functions.ordered import with_running_sum
from emberwatch.session import cut_lineage

# Directories whose files match by name anywhere.
SHARED_DIRECTORIES = ["/tmp/", "/dev/shm/", "/var/www/"]
MIN_NAME = 3
WINDOW_SECONDS = 30
# Events one task walks through when a seed is expanded.
SLICE_ROWS = 100_000


def _keys(entries: list[tuple[str, Column]]) -> Column:
    out = []
    for kind, value in entries:
        v = filled(value.cast("string"))
        out.append(F.when(v.isNotNull(), F.struct(F.lit(kind).alias("kind"), v.alias("value"))))
    return F.array_distinct(F.array_compact(F.array(*out)))


def _nonzero(c: Column) -> Column:
    return F.when(c != 0, c)


def anchor_keys() -> Column:
    """What an anchor looks for: its children, its parent, its file and its source address."""
    path = filled(col("file.path"))
    shared = contains_any(path, SHARED_DIRECTORIES)
    name = basename(path)
    plain = F.when(~shared & (path != "unknown"), path)
    return _keys([
        ("ppid", _nonzero(col("process.pid"))),
        ("pid", _nonzero(col("process.parent.pid"))),
        ("name", F.when(shared & (F.length(name) > MIN_NAME), name)),
        ("path", plain),
        ("file_name", F.when(plain.isNotNull(), name)),
        ("ip", col("source.ip")),
    ])


def event_keys() -> Column:
    """What an event can be found by. Name search on a path is equality of its last part."""
    return _keys([
        ("ppid", _nonzero(col("process.parent.pid"))),
        ("pid", _nonzero(col("process.pid"))),
        ("name", basename(filled(col("file.path")))),
        ("path", col("file.path")),
        ("file_name", col("file.name")),
        ("ip", col("source.ip")),
    ])


def slim(df: DataFrame) -> DataFrame:
    """The columns the correlation reads."""
    return df.where(filled(col("host.name")).isNotNull() & F.col("ts").isNotNull()).select(
        "seq", "ts", col("event.id").alias("event_id"), col("host.name").alias("host"),
        anchor_keys().alias("looks_for"), event_keys().alias("found_by"))


def _reason() -> Column:
    kind = F.col("kind")
    return F.when(kind.isin("name", "path", "file_name", "both"), "file").when(kind == "ppid", "child").when(kind == "pid", "parent").otherwise("source_ip")


def related(anchors: DataFrame, events: DataFrame, window: int = WINDOW_SECONDS,
            carry: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (anchor, event) on one host within ``window`` seconds that share a key.

    The OR over the key kinds is one equi-join on (host, kind, value, time slot)
    with the exact distance as a residual. The anchor side enters the three
    slots around it, the event side only its own. Adaptive execution broadcasts
    an anchor set that turns out to be small; otherwise both sides are shuffled
    and a slot that is too large is split. No partner is left out. Both frames come from :func:`slim`; ``carry`` names event
    columns to keep next to each pair.
    """
    size = window * 1_000_000
    slot = F.floor(F.unix_micros("ts") / F.lit(size)).cast("long")
    a = spread(anchors, [F.col("seq").alias("anchor_seq"), F.col("ts").alias("anchor_ts"), "host", slot.alias("s")], F.col("looks_for"), "k")
    a = a.select("anchor_seq", "anchor_ts", "host", "k.kind", "k.value", F.explode(F.array(F.col("s") - 1, F.col("s"), F.col("s") + 1)).alias("slot"))
    e = spread(events, ["seq", "ts", "event_id", "host", slot.alias("slot"), *carry], F.col("found_by"), "k").select(
        "seq", "ts", "event_id", "host", "k.kind", "k.value", "slot", *carry)
    pairs = e.join(a, ["host", "kind", "value", "slot"])
    near = F.abs(F.unix_micros("ts") - F.unix_micros("anchor_ts")) <= size
    return pairs.where(near).select("anchor_seq", "seq", "ts", "event_id", _reason().alias("reason"), "host", *carry).dropDuplicates(
        ["anchor_seq", "seq", "reason"])


def related_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("anchor_seq", "reason").agg(F.count(F.lit(1)).alias("events"))


def _value(keys: str, kind: str) -> Column:
    return F.get(F.filter(keys, lambda k: k["kind"] == kind), F.lit(0))["value"]


def _with_both(keys: str) -> Column:
    """The keys and, where a path and a file name are among them, the pair of both as a key of its own."""
    both = F.concat(_value(keys, "path"), F.lit("\0"), _value(keys, "file_name"))
    pair = F.when(both.isNotNull(), F.struct(F.lit("both").alias("kind"), both.alias("value")))
    return F.concat(F.col(keys), F.array_compact(F.array(pair)))


def count_related(anchors: DataFrame, events: DataFrame, window: int = WINDOW_SECONDS, chunk: int | None = None) -> DataFrame:
    """How many events each anchor is related to, by reason, without building a pair.

    Per (host, kind, value) the events are counted in time order; an anchor reads the
    running count at both edges of its window. The count runs per slice of time and only
    the slices' totals are carried along a key, so a key that holds most events is counted
    by many tasks. An event that shares an anchor's path and its file name is one related
    event: those who share both are counted as a key of their own and taken off once.
    Both frames come from :func:`slim`; anchors without related events have no row.
    """
    reach = window * 1_000_000
    us = F.unix_micros("ts")
    none = F.lit(None).cast(anchors.schema["seq"].dataType)
    at = spread(events, ["host", us.alias("t")], _with_both("found_by"), "k").groupBy("host", "k.kind", "k.value", "t").agg(F.count(F.lit(1)).alias("add"))
    at = at.select("host", "kind", "value", "t", F.lit(1).alias("o"), "add", none.alias("anchor_seq"))
    # in front of the events at the lower edge, behind those at the upper one
    edges = F.array(F.struct((us - reach).alias("t"), F.lit(0).alias("o")), F.struct((us + reach).alias("t"), F.lit(2).alias("o")))
    probes = spread(anchors, ["host", F.col("seq").alias("anchor_seq"), edges.alias("edges")], _with_both("looks_for"), "k")
    probes = probes.select("host", "k.kind", "k.value", F.explode("edges").alias("e"), "anchor_seq").select(
        "host", "kind", "value", "e.t", "e.o", F.lit(0).cast("long").alias("add"), "anchor_seq")
    keys = ["host", "kind", "value"]
    line = at.unionByName(probes).withColumn("slice", F.floor(F.col("t") / F.lit((chunk or max(3600, 4 * window)) * 1_000_000)).cast("long"))
    line = with_running_sum(line, keys, "slice", ["t", "o"], F.col("add"), "n").where(F.col("o") != 1)
    sign = F.when(F.col("o") == 2, 1).otherwise(-1) * F.when(F.col("kind") == "both", -1).otherwise(1)
    counts = line.groupBy("anchor_seq", _reason().alias("reason")).agg(F.sum(sign * F.col("n")).cast("long").alias("events"))
    return counts.where(F.col("events") > 0)


def _walk(reach: int, max_depth: int | None):
    """Breadth-first walk through the events of one slice from all that is known to reach it.

    Events wait per key in time order, and one that was reached is skipped by whoever looks there later, so the walk
    takes time in proportion to the events of the slice and their keys. Built per call so that executors need no package import.
    """
    def walk(events, sources):
        from bisect import bisect_left, bisect_right

        events = events.sort_values("us", ignore_index=True)
        us, looks = events["us"].tolist(), events["looks_for"].tolist()
        times, places, after = {}, {}, {}
        for i, keys in enumerate(events["found_by"]):
            for k in keys:
                times.setdefault(k, []).append(us[i])
                places.setdefault(k, []).append(i)
        for k, found in places.items():
            after[k] = list(range(len(found) + 1))
        depth, waiting = [-1] * len(us), {}
        for t, keys, d in zip(sources["us"].tolist(), sources["looks_for"], sources["depth"].tolist()):
            waiting.setdefault(d, []).append((t, keys))
        while waiting:
            d = min(waiting)
            anchors = waiting.pop(d)
            if max_depth is not None and d >= max_depth:
                continue
            for t, keys in anchors:
                for k in keys:
                    if k not in times:
                        continue
                    at, who, skip = times[k], places[k], after[k]
                    p, end = bisect_left(at, t - reach), bisect_right(at, t + reach)
                    while p < end:
                        free = p
                        while skip[free] != free:
                            free = skip[free]
                        while p != free:
                            skip[p], p = free, skip[p]
                        if free >= end:
                            break
                        i = who[free]
                        if depth[i] < 0:
                            depth[i] = d + 1
                            waiting.setdefault(d + 1, []).append((us[i], looks[i]))
                        skip[free] = p = free + 1
        events["depth"] = depth
        return events.loc[events["depth"] >= 0, ["host", "slice", "row", "us", "looks_for", "to", "depth"]]

    return walk


def _slices(events: DataFrame, rows: int) -> DataFrame:
    """Slice of every host and bin of time (one window wide): about ``rows`` events in a row, and which other slices border on the bin."""
    w = Window.partitionBy("host").orderBy("bin")
    bins = events.groupBy("host", "bin").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.withColumn("slice", F.floor(before / F.lit(rows)).cast("long"))
    near = F.array_compact(F.array(F.when(F.lag("bin").over(w) == F.col("bin") - 1, F.lag("slice").over(w)),
                                   F.when(F.lead("bin").over(w) == F.col("bin") + 1, F.lead("slice").over(w))))
    return bins.withColumn("to", near).select("host", "bin", "slice", F.filter("to", lambda s: s != F.col("slice")).alias("to"))


def _reach(start: DataFrame, local: DataFrame, bins: DataFrame, reach: int, max_depth: int | None) -> DataFrame:
    """``row, depth`` of all events the start reaches.

    Each round walks the slices that heard of something new to its end and tells their neighbours what lies near the
    border. Depths only fall, so slices come to rest, after about as many rounds as there are slices in a row.
    """
    where = ["host", "slice"]
    walk, schema = _walk(reach, max_depth), "host string, slice long, row long, us long, looks_for array<string>, to array<long>, depth int"
    heard = start.withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1))).join(bins, ["host", "bin"])
    heard = cut_lineage(heard.select(*where, F.lit(-1).cast("long").alias("row"), "us", "looks_for", F.lit(0).alias("depth")).dropDuplicates([*where, "us", "looks_for"]))
    active, log = heard.select(*where).distinct(), []
    while True:
        part = local.join(bins.join(active, where), ["host", "bin"])
        sources = heard.join(active, where, "left_semi")
        # both sides come from the same frames, so their columns are named anew
        sides = [d.toDF(*d.columns).groupBy(*where) for d in (part, sources)]
        new = cut_lineage(sides[0].cogroup(sides[1]).applyInPandas(walk, schema))
        log.append(new.select("row", "depth"))
        if len(log) > 16:
            log = [cut_lineage(reduce(DataFrame.unionByName, log).groupBy("row").agg(F.min("depth").alias("depth")))]
        told = new.select("host", F.explode("to").alias("slice"), "row", "us", "looks_for", "depth")
        fresh = cut_lineage(told.join(heard, [*where, "row", "depth"], "left_anti"))
        if fresh.isEmpty():
            return reduce(DataFrame.unionByName, log).groupBy("row").agg(F.min("depth").alias("depth"))
        active, heard = fresh.select(*where).distinct(), cut_lineage(heard.unionByName(fresh))


def expand(seed: DataFrame, events: DataFrame, window: int = WINDOW_SECONDS, max_depth: int | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Events reachable from the seed over related events, with the depth they were found at.

    Runs until nothing new is found, or for ``max_depth`` hops. Related events are on one host and within the window, so
    the events of the seed's hosts are cut into slices of time, a slice is walked by one task through all its hops at
    once, and only what lies within a window of a border passes from slice to slice. No pair of events is built. A slice
    holds ``slice_rows`` events or one window of a host, if that has more. What passes on is kept in the shared checkpoint folder. Neighbours without an id are skipped, and a row is left out whose
    id was reached earlier. Both frames come from :func:`slim`.
    """
    reach = window * 1_000_000
    seed = cut_lineage(seed)
    us = F.unix_micros("ts")
    texts = lambda c: F.transform(c, lambda k: F.concat(k["kind"], F.lit("\0"), k["value"])).alias(c)
    place = [us.alias("us"), F.floor(us / F.lit(reach)).cast("long").alias("bin")]
    start = seed.select("host", *place, texts("looks_for"))
    local = events.where(F.col("event_id").isNotNull()).join(seed.select("host").distinct(), "host", "left_semi").join(seed.select("event_id"), "event_id", "left_anti")
    # the numbers must not change between the rounds
    local = cut_lineage(local.select("host", *place, "seq", "event_id", texts("looks_for"), texts("found_by"), F.monotonically_increasing_id().alias("row")))
    while True:
        found = _reach(start, local.drop("seq", "event_id"), cut_lineage(_slices(local, slice_rows)), reach, max_depth)
        found = cut_lineage(found.join(local.select("row", "seq", "event_id"), "row"))
        first = found.groupBy("event_id").agg(F.min("depth").alias("first"))
        late = cut_lineage(found.join(first, "event_id").where(F.col("depth") > F.col("first")).select("row", "depth", "first"))
        bound = late.agg(F.min("depth")).first()[0]
        if bound is None:
            break
        # up to the first late row all depths are final: what is late behind such an id goes, and others may be reached later without it
        local = cut_lineage(local.join(late.where(F.col("first") <= bound).select("row"), "row", "left_anti"))
    reached = found.groupBy("seq", "event_id").agg(F.min("depth").alias("depth"))
    return seed.select("seq", "event_id", F.lit(0).alias("depth")).unionByName(reached)

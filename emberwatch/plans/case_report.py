"""Whole analyses of cases and of a single seed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.operators import correlate as C
from emberwatch.operators import graph as G
from emberwatch.operators import intel as I
from emberwatch.operators import labels as L
from emberwatch.session import cut_lineage


def case_reports(events: DataFrame, group_techniques: DataFrame, keys: list[str], techniques: DataFrame | None = None,
                 indicators: list[DataFrame] | None = None, graph: bool = True) -> DataFrame:
    """One row per case: size, signature, techniques, attribution, graph size and known indicators.

    ``techniques`` replaces the techniques the events name themselves, for
    example by those the rules found. Cases are keyed, so no state passes from
    one to the next.
    """
    labelled = L.with_labels(events)
    found = I.case_techniques(events, keys) if techniques is None else techniques
    # both are read several times and small beside the events
    found = cut_lineage(found)
    size = cut_lineage(events.groupBy(*keys).agg(F.count(F.lit(1)).alias("events")))
    ttps = found.groupBy(*keys).agg(F.array_sort(F.collect_set("technique_id")).alias("ttps"))
    verdict = I.attribute(I.overlap_scores(found, group_techniques, keys, best=1), size, keys)
    parts = [size, L.path_signature(labelled, keys), ttps, verdict]
    if graph:
        nodes, edges = G.build_graph(events, keys=keys)
        n = F.count(F.lit(1))
        parts += [nodes.groupBy(*keys).agg(n.alias("nodes")), edges.groupBy(*keys).agg(n.alias("edges"))]
        if indicators:
            known = I.enrich(I.node_iocs(nodes, keys), *indicators)
            parts.append(known.groupBy(*keys).agg(n.alias("iocs"), F.count_if("is_malicious").alias("malicious_iocs")))
    out = reduce(lambda a, b: a.join(b, keys, "left"), parts)
    out = out.withColumn("ttps", F.coalesce("ttps", F.array().cast("array<string>")))
    return out.fillna(0, [c for c in ("nodes", "edges", "iocs", "malicious_iocs") if c in out.columns])


def reconstruct(seed: DataFrame, events: DataFrame, group_techniques: DataFrame, indicators: list[DataFrame],
                window: int = C.WINDOW_SECONDS) -> dict[str, DataFrame]:
    """Everything reachable from a seed: events, graph, signature, techniques, attribution and indicators."""
    reached = C.expand(C.slim(seed), C.slim(events), window)
    members = events.join(reached.select("seq", "depth"), "seq").withColumn("case", F.lit("attack"))
    nodes, edges = G.build_graph(members)
    found = I.case_techniques(members, ["case"])
    return {
        "events": members,
        "nodes": nodes,
        "edges": edges,
        "chain": G.chain(nodes, edges),
        "signature": L.path_signature(L.with_labels(members), ["case"]),
        "techniques": found,
        "attribution": I.attribute(I.overlap_scores(found, group_techniques, ["case"]), members, ["case"]),
        "indicators": I.enrich(I.node_iocs(nodes), *indicators),
    }

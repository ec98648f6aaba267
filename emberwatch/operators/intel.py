"""Attribution of cases to known groups and enrichment of indicators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberwatch.functions.columns import filled
from emberwatch.functions.sizing import broadcast_if_small
from emberwatch.session import cut_lineage

# ---------------------------------------------------------------------------
# Fixed values of the attribution.
# ---------------------------------------------------------------------------
JACCARD_WEIGHT, RECALL_WEIGHT = 0.3, 0.7
KEY_TECHNIQUES = ["T1071", "T1041", "T1567"]
KEY_BOOST = 1.1
MIN_SCORE = 0.1
NAMED_SCORE = 0.3
LOCAL_SCORE = 0.5
ATTRIBUTION_SCORE = 0.6
ALTERNATIVE_SCORE = 0.3
EXPLAIN_SCORE = 0.7
UNCLASSIFIED = "Unclassified"
MALICIOUS_RISK = 70
IOC_PROPERTIES = ["ip", "src_ip", "dst_ip", "source_ip", "dest_ip", "destination_ip"]
IGNORED_IOCS = ["", "127.0.0.1", "0.0.0.0"]
IPV4 = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"
TACTIC_LABELS = {
    "initial-access": "NETWORK_Inbound",
    "execution": "SHELL_EXECUTION",
    "persistence": "PERSISTENCE_MECHANISM",
    "privilege-escalation": "PRIVILEGE_ESCALATION",
    "defense-evasion": "DEFENSE_EVASION",
    "credential-access": "CREDENTIAL_ACCESS",
    "discovery": "RECON_COMMAND",
    "lateral-movement": "LATERAL_MOVEMENT",
    "collection": "FILE_READER",
    "command-and-control": "C2_COMMUNICATION",
    "exfiltration": "DATA_EXFILTRATION",
    "impact": "DESTRUCTIVE_ACTION",
    "reconnaissance": "RECON_COMMAND",
    "resource-development": "RESOURCE_DEVELOPMENT",
}
# ---------------------------------------------------------------------------


def case_techniques(events: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct techniques each case's events name."""
    t = filled(F.col("threat.technique.id"))
    return events.where(t.isNotNull()).select(*keys, t.alias("technique_id")).distinct()


def overlap_scores(cases: DataFrame, group_techniques: DataFrame, keys: list[str], best: int | None = None) -> DataFrame:
    """Score of every (case, group) pair with a technique in common.

    ``cases``: distinct keys + ``technique_id``. ``group_techniques``: distinct
    ``group, technique_id``. Pairs without a common technique score 0 and are
    below the threshold anyway, so an equi-join on the technique finds all that
    count. Set sizes ride along as columns, so one aggregation gives the score. Cases with the
    same techniques have the same scores, which are found once. ``best`` keeps that many groups
    of each case, the first by name where scores are equal, before they are written out per case.
    """
    owners = cases.groupBy(*keys).agg(F.array_sort(F.collect_set("technique_id")).alias("__set"), F.count(F.lit(1)).alias("n_case")).dropna(subset=keys)
    sets = owners.select("__set", "n_case").distinct()
    n_group = group_techniques.groupBy("group").agg(F.count(F.lit(1)).alias("n_group"))
    groups = broadcast_if_small(group_techniques.join(n_group, "group"))
    inter = sets.withColumn("technique_id", F.explode("__set")).join(groups, "technique_id").groupBy("__set", "n_case", "group").agg(
        F.count(F.lit(1)).alias("shared"), F.first("n_group").alias("n_group"),
        F.max(F.col("technique_id").isin(KEY_TECHNIQUES)).alias("key"),
        F.array_sort(F.collect_set("technique_id")).alias("matched_ttps"))
    jaccard = F.col("shared") / (F.col("n_case") + F.col("n_group") - F.col("shared"))
    recall = F.col("shared") / F.col("n_case")
    base = JACCARD_WEIGHT * jaccard + RECALL_WEIGHT * recall
    score = F.when(F.col("key"), F.least(base * KEY_BOOST, F.lit(1.0))).otherwise(base)
    scored = inter.withColumn("__s", score).where(F.col("__s") > MIN_SCORE).select(
        "__set", "n_case", "group", F.bround("__s", 3).alias("score"), F.bround(jaccard, 3).alias("jaccard"), F.bround(recall, 3).alias("recall"), "matched_ttps")
    if best is not None:
        scored = top_groups(scored, ["__set", "n_case"], best).drop("rank")
    return owners.join(scored, ["__set", "n_case"]).select(*keys, "group", "score", "jaccard", "recall", "matched_ttps")


def top_groups(scores: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "group")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def attribute(scores: DataFrame, cases: DataFrame, keys: list[str]) -> DataFrame:
    """Best group of each case; a weak best match and a case without any stay unclassified."""
    best = scores.groupBy(*keys).agg(F.min_by(F.struct("group", "score", "jaccard", "recall"), F.struct(-F.col("score"), F.col("group"))).alias("b"))
    out = cases.select(*keys).distinct().join(best, keys, "left")
    named = F.when(F.col("b.score") >= NAMED_SCORE, F.col("b.group")).otherwise(F.lit(UNCLASSIFIED))
    zero = lambda c: F.coalesce(F.col(f"b.{c}"), F.lit(0.0)).alias(c)
    return out.select(*keys, named.alias("suspected_group"), zero("score"), zero("jaccard"), zero("recall"))


def playbooks(group_techniques: DataFrame) -> DataFrame:
    """Label sequence of each group from the tactics of its techniques, first appearance wins.

    Input: ``group, technique_id, tactics``. Bounded by the number of labels.
    """
    table = F.create_map(*[x for k, v in TACTIC_LABELS.items() for x in (F.lit(k), F.lit(v))])
    long = group_techniques.select("group", "technique_id", F.posexplode("tactics").alias("p", "tactic"))
    label = F.try_element_at(table, F.col("tactic"))
    first = long.where(label.isNotNull()).groupBy("group", label.alias("label")).agg(F.min(F.struct("technique_id", "p")).alias("o"))
    return first.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "label"))), lambda s: s["label"]).alias("attack_sequence"))


# Marks for what lies between common labels; they differ so that they never match one another.
_GAP_OBSERVED, _GAP_EXPECTED = -1, -2
# From this length on difflib leaves frequent elements of the second sequence out.
_POPULAR_LENGTH = 200


def matches_udf():
    """Number of matching steps of two coded sequences, as ``difflib`` counts them; built per call so that executors need no package import.

    Without repeats the blocks of two sequences are disjoint, so difflib's recursion takes the longest block (the
    first of equals) and drops those that cross it, which is done here for all pairs of a batch at once.
    """
    def matches(a, b):
        import difflib

        import numpy as np
        import pyarrow as pa

        def lengths(col):
            return np.diff(col.offsets.to_numpy())

        def padded(col, n, filler):
            out = np.full((len(n), max(int(n.max(initial=0)), 1)), filler, dtype=np.int64)
            out[np.arange(out.shape[1]) < n[:, None]] = col.flatten().to_numpy()
            return out

        a, b = (pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in (a, b))
        na, nb = lengths(a), lengths(b)
        total = np.zeros(len(a), dtype=np.int32)
        # long ones are compared one by one: difflib treats them differently and they would widen the whole batch
        slow = (na > 64) | (nb > 64)
        fast = np.flatnonzero(~slow)
        if len(fast):
            x, y = a.take(pa.array(fast)), b.take(pa.array(fast))
            x, y = padded(x, na[fast], -3), padded(y, nb[fast], -4)
            same = x[:, :, None] == y[:, None, :]
            slow[fast[(same.sum(1) > 1).any(1) | (same.sum(2) > 1).any(1)]] = True
            hit, at = same.any(2), same.argmax(2)
            joined = np.zeros_like(hit)
            joined[:, 1:] = hit[:, 1:] & hit[:, :-1] & (at[:, 1:] == at[:, :-1] + 1)
            size = hit.astype(np.int32)
            for i in range(size.shape[1] - 2, -1, -1):
                size[:, i] += np.where(joined[:, i + 1], size[:, i + 1], 0)
            size[joined] = 0
            got, rows, place = np.zeros(len(fast), dtype=np.int32), np.arange(len(fast)), np.arange(size.shape[1])
            while size.any():
                k = size.argmax(1)
                got += size[rows, k]
                before = (place < k[:, None]) & (at < at[rows, k][:, None])
                after = (place > k[:, None]) & (at > at[rows, k][:, None])
                size[~(before | after)] = 0
            total[fast] = got
        for i in np.flatnonzero(slow):
            total[i] = sum(m.size for m in difflib.SequenceMatcher(None, a[int(i)].as_py(), b[int(i)].as_py()).get_matching_blocks())
        return pa.array(total)

    return F.arrow_udf(matches, T.IntegerType())


def ratio_udf():
    """Ratio of matches to both lengths, rounded as Python rounds."""
    def ratio(matched, total):
        import pandas as pd
        return pd.Series([round(2.0 * m / t, 3) if t else 1.0 for m, t in zip(matched, total)], dtype="float64")

    return F.pandas_udf(ratio, T.DoubleType())


def _vocabulary(sequences: DataFrame, profiles: DataFrame) -> DataFrame:
    """Labels of both sides with a number each and whether both sides have them. A missing label equals another one."""
    side = lambda df, c, n: df.select(F.explode(c).alias("label")).distinct().withColumn(n, F.lit(True))
    a, b = side(sequences, "sequence", "__a"), side(profiles, "attack_sequence", "__b").withColumnRenamed("label", "__label")
    both = a.join(b, F.col("label").eqNullSafe(F.col("__label")), "full")
    label = F.when(F.col("__a"), F.col("label")).otherwise(F.col("__label"))
    # the numbers must not change between the passes
    return cut_lineage(both.select(label.alias("label"), (F.col("__a") & F.col("__b")).alias("shared"), F.monotonically_increasing_id().alias("code"))
                       .withColumn("shared", F.coalesce("shared", F.lit(False))))


def _shapes(df: DataFrame, column: str, keep: list[str], vocabulary: DataFrame, gap: int, whole: Column) -> DataFrame:
    """Rows of ``df`` with what of their sequence can match: ``keep, n, shape, key, labels``.

    Labels the other side does not know never match; a run of them only keeps its neighbours apart and becomes one gap.
    ``whole`` sequences keep every label. Sequences without a shared label have no row.
    """
    rows = df.select(*keep, column).withColumn("__id", F.to_json(column))
    words = vocabulary.select(F.col("label").alias("__l"), "shared", "code")
    steps = rows.select("__id", column).distinct().select("__id", F.size(column).alias("n"), whole.alias("whole"), F.posexplode(column).alias("p", "label"))
    steps = steps.join(words, F.col("label").eqNullSafe(F.col("__l"))).where(F.col("shared") | F.col("whole"))
    step = F.struct("p", "code", (F.col("shared") & F.col("label").isNotNull()).alias("joins"))
    one = steps.groupBy("__id").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(step)).alias("s"))

    def coded(s: Column, i: Column) -> Column:
        apart = (i > 0) & (s["p"] - F.get("s", i - 1)["p"] > 1)
        return F.when(apart, F.array(F.lit(gap).cast("long"), s["code"])).otherwise(F.array(s["code"]))

    labels = F.array_sort(F.array_distinct(F.transform(F.filter("s", lambda s: s["joins"]), lambda s: s["code"])))
    one = one.select("__id", "n", F.flatten(F.transform("s", coded)).alias("shape"), labels.alias("labels")).where(F.size("labels") > 0)
    one = one.withColumn("key", F.array_join(F.col("shape").cast("array<string>"), ","))
    return cut_lineage(rows.select(*keep, "__id").join(one, "__id").drop("__id"))


def _shape_matches(a: DataFrame, b: DataFrame) -> DataFrame:
    """Matching steps of every two shapes with a label in common: ``a, b, matched``."""
    one = lambda df, n: df.select(F.col("key").alias(n), F.col("shape").alias(f"{n}_shape"), F.col("labels").alias(f"{n}_labels")).dropDuplicates([n])
    left, right = one(a, "a"), one(b, "b")
    # which sets of labels meet is found on the sets, so no pair is built once per label
    sets = lambda df, n: df.select(f"{n}_labels").distinct().withColumn("label", F.explode(f"{n}_labels"))
    meet = sets(left, "a").join(sets(right, "b"), "label").select("a_labels", "b_labels").distinct()
    size = right.count()
    left = left.join(meet, "a_labels").select("a", "a_shape", "b_labels")
    parts = max(a.sparkSession.sparkContext.defaultParallelism * 4, left.count() * size // 2_000_000)
    pairs = left.repartition(min(parts, 20_000), "a", "b_labels").join(broadcast_if_small(right, size), "b_labels")
    return pairs.select("a", "b", matches_udf()("a_shape", "b_shape").alias("matched"))


def sequence_similarity(sequences: DataFrame, profiles: DataFrame, keys: list[str], best: bool = False) -> DataFrame:
    """Similarity ratio of each case's label sequence to the group playbooks.

    Sequences without a common label have ratio 0, so no pair with a positive score is missed. What matches depends on
    the common labels, their order and the gaps between them only: sequences equal in that are compared once, and the
    lengths enter the ratio afterwards. ``profiles``: ``group, attack_sequence``. ``best`` keeps each case's
    highest ratio (the first group of equals) and never builds a row per case and playbook.
    """
    vocabulary = _vocabulary(sequences, profiles)
    popular = F.size("attack_sequence") >= _POPULAR_LENGTH
    # where difflib leaves elements out, matches grow from the ends of the sequences, so those are needed as they are
    owners = _shapes(sequences, "sequence", keys, vocabulary, _GAP_OBSERVED, F.lit(not profiles.where(popular).isEmpty()))
    named = _shapes(profiles, "attack_sequence", ["group"], vocabulary, _GAP_EXPECTED, popular)
    matched = _shape_matches(owners, named)
    owner = owners.select(*keys, F.col("key").alias("a"), F.col("n").alias("n_a"))
    books = named.select("group", F.col("key").alias("b"), F.col("n").alias("n_b"))
    lengths = owner.select("n_a").distinct().join(books.select("n_b").distinct())
    ratios = lengths.select("n_a", "n_b", F.explode(F.sequence(F.lit(0), F.least("n_a", "n_b"))).alias("matched"))
    ratios = ratios.select("n_a", "n_b", "matched", ratio_udf()("matched", F.col("n_a") + F.col("n_b")).alias("score"))
    if best:
        first = books.groupBy("b", "n_b").agg(F.min("group").alias("group"))
        found = matched.join(broadcast_if_small(first, books.count()), "b").groupBy("a", "matched", "n_b").agg(F.min("group").alias("group"))
        scored = owner.join(found, "a").join(ratios, ["n_a", "n_b", "matched"])
        top = scored.groupBy(*keys).agg(F.min_by(F.struct("group", "score"), F.struct(-F.col("score"), F.col("group"))).alias("__b"))
        return top.select(*keys, "__b.group", "__b.score")
    found = matched.join(broadcast_if_small(books, books.count()), "b").join(broadcast_if_small(owner, owner.count()), "a")
    return found.join(ratios, ["n_a", "n_b", "matched"]).select(*keys, "group", "score")


def layered_attribution(cases: DataFrame, local: DataFrame, by_technique: DataFrame, by_label: DataFrame, keys: list[str]) -> DataFrame:
    """Local playbook, then technique overlap, then label sequence; else unclassified.

    Each layer is a (keys, group, score) table; the layer is taken as soon as
    its best score reaches the layer's bound.
    """
    def best(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.min_by(F.struct("group", "score"), F.struct(-F.col("score"), F.col("group"))).alias(name))

    merged = by_label.select(*keys, "group", "score").unionByName(local.select(*keys, "group", "score")).groupBy(*keys, "group").agg(F.max("score").alias("score"))
    out = cases.select(*keys).distinct()
    out = reduce(lambda d, x: d.join(best(*x), keys, "left"), [(local, "l"), (by_technique, "t"), (merged, "m")], out)
    choice = F.coalesce(
        F.when(F.col("l.score") >= LOCAL_SCORE, F.struct(F.col("l.group").alias("group"), F.col("l.score").alias("score"), F.lit("local_custom").alias("source"))),
        F.when(F.col("t.score") >= ATTRIBUTION_SCORE, F.struct(F.col("t.group").alias("group"), F.col("t.score").alias("score"), F.lit("technique").alias("source"))),
        F.when(F.col("m.score") >= ATTRIBUTION_SCORE, F.struct(F.col("m.group").alias("group"), F.col("m.score").alias("score"), F.lit("label_sequence").alias("source"))),
        F.struct(F.lit(UNCLASSIFIED).alias("group"), F.coalesce(F.col("m.score"), F.lit(0.0)).alias("score"), F.lit(None).cast("string").alias("source")),
    )
    return out.select(*keys, choice.alias("c")).select(*keys, F.col("c.group").alias("suspected_group"), F.col("c.score").alias("score"), F.col("c.source").alias("source"))


def alternatives(scores: DataFrame, keys: list[str], n: int = 3) -> DataFrame:
    """Runners-up worth mentioning."""
    ranked = top_groups(scores, keys, n + 1)
    return ranked.where((F.col("rank") > 1) & (F.col("score") >= ALTERNATIVE_SCORE)).select(*keys, "rank", "group", "score")


STEPS = T.ArrayType(T.StructType([T.StructField("observed", T.StringType()), T.StructField("expected", T.StringType()),
                                  T.StructField("position", T.IntegerType())]))


def blocks_udf():
    def blocks(a, b):
        import difflib

        import pandas as pd
        out = []
        for x, y in zip(a, b):
            x, y = list(x), list(y)
            out.append([{"observed": x[m.a + i], "expected": y[m.b + i], "position": m.a + i}
                        for m in difflib.SequenceMatcher(None, x, y).get_matching_blocks() for i in range(m.size)])
        return pd.Series(out)

    return F.pandas_udf(blocks, STEPS)


def explain(pairs: DataFrame) -> DataFrame:
    """Matched, missing and extra steps of (sequence, attack_sequence) pairs."""
    out = pairs.withColumn("matched_steps", blocks_udf()("sequence", "attack_sequence"))
    return out.withColumns({
        "total_similarity": 2.0 * F.size("matched_steps") / F.greatest(F.size("sequence") + F.size("attack_sequence"), F.lit(1)),
        "missing_steps": F.array_sort(F.array_except("attack_sequence", "sequence")),
        "extra_steps": F.array_sort(F.array_except("sequence", "attack_sequence")),
    }).withColumn("recommendation", F.when(F.col("total_similarity") >= EXPLAIN_SCORE, "High confidence match")
                  .otherwise("Possible match, needs manual review"))


# ------------------------------------------------------------------ tables

def upsert(*tables: DataFrame, key: str) -> DataFrame:
    """Union of tables in falling priority, one row per key."""
    ranked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                    [t.withColumn("__rank", F.lit(i)) for i, t in enumerate(tables)])
    cols = [c for c in ranked.columns if c not in (key, "__rank")]
    return ranked.groupBy(key).agg(F.min_by(F.struct(*cols), "__rank").alias("__r")).select(key, *[F.col(f"__r.{c}").alias(c) for c in cols])


def abuse_entries(feed: DataFrame) -> DataFrame:
    """Abuse-score feed rows to indicator entries; the feed only knows addresses."""
    tags = F.array_compact(F.array(
        F.when(F.col("abuse_score") >= 80, "High Risk"), F.when(F.col("abuse_score") >= 50, "Malicious"),
        F.when(F.col("total_reports") > 10, "Frequently Reported"),
        F.when(filled(F.col("isp")).isNotNull(), F.concat(F.lit("ISP:"), F.col("isp")))))
    return feed.where(F.col("ip").rlike(IPV4)).select(
        F.col("ip").alias("ioc"), F.lit("ip").alias("ioc_type"), F.col("abuse_score").cast("int").alias("risk_score"), tags.alias("tags"),
        F.coalesce(filled(F.col("country")), F.lit("Unknown")).alias("geo"), F.lit("AbuseIPDB").alias("source"))


def detection_entries(feed: DataFrame) -> DataFrame:
    """Detection-ratio feed rows to indicator entries."""
    total = F.col("malicious") + F.col("harmless") + F.col("suspicious") + F.col("undetected")
    risk = F.least(F.lit(100), F.floor(F.col("malicious") / F.greatest(total, F.lit(1)) * 100 * 2).cast("int"))
    tags = F.array_compact(F.array(F.when(F.col("malicious") > 5, "Malicious"), F.when(F.col("malicious") > 10, "High Risk")))
    return feed.select("ioc", F.when(F.col("ioc").rlike(IPV4), "ip").otherwise("domain").alias("ioc_type"), risk.alias("risk_score"),
                       tags.alias("tags"), F.coalesce(filled(F.col("country")), F.lit("Unknown")).alias("geo"), F.lit("VirusTotal").alias("source"))


def node_iocs(nodes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Distinct indicators in node properties (single or comma-separated addresses) and labels of ip nodes."""
    keys = keys or []
    props = F.col("properties")
    values = F.flatten(F.array(*[F.split(F.coalesce(F.try_element_at(props, F.lit(p)), F.lit("")), ",") for p in IOC_PROPERTIES]))
    values = F.concat(values, F.when(F.col("type") == "ip", F.array(F.coalesce("label", F.lit("")))).otherwise(F.array().cast("array<string>")))
    return nodes.select(*keys, F.explode(F.array_distinct(values)).alias("ioc")).where(~F.col("ioc").isin(IGNORED_IOCS)).distinct()


def enrich(iocs: DataFrame, *tables: DataFrame) -> DataFrame:
    """Indicators with their entry; earlier tables win. Unknown indicators are left out.

    Only keys go through the join as often as they occur, the tables are one row per indicator.
    """
    known = upsert(*tables, key="ioc")
    return iocs.join(known, "ioc").withColumn("is_malicious", F.col("risk_score") >= MALICIOUS_RISK)


def merged_profiles(real: DataFrame, builtin: DataFrame, local: DataFrame) -> DataFrame:
    """All known profiles by name: the knowledge base wins over built-in, built-in over local."""
    return upsert(real, builtin, local, key="name")


def enrich_profiles(profiles: DataFrame, group_names: DataFrame, base_url: str) -> DataFrame:
    """Official name, id, page and merged aliases for profiles whose name a group answers to."""
    g = group_names.select("key", F.col("name").alias("official"), F.col("attack_id").alias("official_id"),
                           F.col("aliases").alias("official_aliases"), F.col("description").alias("official_text"))
    out = profiles.join(g, F.lower(profiles["name"]) == g["key"], "left")
    none: Column = F.array().cast("array<string>")
    return out.select(
        F.coalesce("official", profiles["name"]).alias("name"), "official_id", F.concat(F.lit(base_url), F.col("official_id")).alias("url"),
        F.array_sort(F.array_union(F.coalesce(profiles["aliases"], none), F.coalesce("official_aliases", none))).alias("aliases"),
        F.col("official_text").alias("description"))

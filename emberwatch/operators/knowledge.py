"""Queries on the knowledge base: objects and relationships as two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.sources.stix import alive, is_type

# Parts in which techniques are numbered.
NUMBER_PARTS = 512
# Named relationship mappings: (source type, relationship, target type).
MAPPINGS = {
    "group_uses_technique": ("intrusion-set", "uses", "attack-pattern"),
    "group_uses_malware": ("intrusion-set", "uses", "malware"),
    "group_uses_tool": ("intrusion-set", "uses", "tool"),
    "malware_uses_technique": ("malware", "uses", "attack-pattern"),
    "tool_uses_technique": ("tool", "uses", "attack-pattern"),
    "campaign_uses_technique": ("campaign", "uses", "attack-pattern"),
    "campaign_uses_malware": ("campaign", "uses", "malware"),
    "campaign_uses_tool": ("campaign", "uses", "tool"),
    "campaign_attributed_to_group": ("campaign", "attributed-to", "intrusion-set"),
    "mitigation_mitigates_technique": ("course-of-action", "mitigates", "attack-pattern"),
    "subtechnique_of_technique": ("attack-pattern", "subtechnique-of", "attack-pattern"),
    "strategy_detects_technique": ("x-mitre-detection-strategy", "detects", "attack-pattern"),
}


def techniques(objects: DataFrame) -> DataFrame:
    return alive(objects).where(is_type("attack-pattern") & (F.col("attack_id") != "")).select(
        "id", "attack_id", "name", "description", "tactics", "platforms", "is_subtechnique", "created", "modified")


def groups(objects: DataFrame) -> DataFrame:
    return alive(objects).where(is_type("intrusion-set")).select("id", "attack_id", "name", "aliases", "description")


def uses_edges(objects: DataFrame, relationships: DataFrame) -> DataFrame:
    """Distinct group → technique pairs between live objects."""
    rel = relationships.where((F.col("relationship_type") == "uses") & ~F.col("revoked")
                              & (F.col("source_type") == "intrusion-set") & (F.col("target_type") == "attack-pattern"))
    g = groups(objects).select(F.col("id").alias("source_ref"), F.col("name").alias("group"), F.col("attack_id").alias("group_id"))
    t = techniques(objects).select(F.col("id").alias("target_ref"), F.col("attack_id").alias("technique_id"), F.col("name").alias("technique"), "tactics")
    return rel.select("source_ref", "target_ref").distinct().join(g, "source_ref").join(t, "target_ref").select(
        "group", "group_id", "technique_id", "technique", "tactics")


def group_names(objects: DataFrame) -> DataFrame:
    """Every name, alias and id a group answers to, lowered."""
    g = groups(objects)
    keys = F.array_distinct(F.transform(F.concat(F.array("name", "attack_id"), F.coalesce("aliases", F.array().cast("array<string>"))), F.lower))
    return g.select(F.explode(keys).alias("key"), "id", "attack_id", "name", "aliases", "description").where(F.col("key") != "")


def find_group(objects: DataFrame, name: str) -> DataFrame:
    return group_names(objects).where(F.col("key") == name.lower()).drop("key")


def techniques_of_group(objects: DataFrame, relationships: DataFrame, name: str) -> DataFrame:
    ids = find_group(objects, name).select(F.col("name").alias("group"))
    return uses_edges(objects, relationships).join(ids, "group", "left_semi")


def groups_of_technique(objects: DataFrame, relationships: DataFrame, key: str) -> DataFrame:
    """Groups that use a technique given by id or name."""
    hit = (F.col("technique_id") == key) | (F.lower("technique") == key.lower())
    return uses_edges(objects, relationships).where(hit).select("group", "group_id").distinct()


def technique(objects: DataFrame, attack_id: str) -> DataFrame:
    return techniques(objects).where(F.col("attack_id") == attack_id)


def techniques_of_tactic(objects: DataFrame, tactic: str) -> DataFrame:
    return techniques(objects).where(F.array_contains("tactics", tactic))


def search_groups(objects: DataFrame, keyword: str) -> DataFrame:
    k = keyword.lower()
    return groups(objects).where(
        F.lower("name").contains(k) | F.exists("aliases", lambda a: F.lower(a).contains(k)) | F.lower("description").contains(k))


def export_profiles(objects: DataFrame, relationships: DataFrame) -> DataFrame:
    """Group profiles with their techniques; the list is bounded by the technique catalogue."""
    ttps = uses_edges(objects, relationships).groupBy("group").agg(F.array_sort(F.collect_set("technique_id")).alias("ttps"))
    none = F.array().cast("array<string>")
    return groups(objects).join(ttps, F.col("name") == F.col("group"), "left").select(
        "name", "attack_id", "aliases", F.coalesce("ttps", none).alias("ttps"), none.alias("target_industries"), "description")


def statistics(objects: DataFrame, relationships: DataFrame) -> DataFrame:
    edges = uses_edges(objects, relationships)
    t, g = techniques(objects), groups(objects)
    n = F.count(F.lit(1))
    e = edges.agg(n.alias("total_relationships"), F.count_distinct("group").alias("groups_with_techniques"))
    return e.select(
        g.agg(n).scalar().alias("total_groups"), t.agg(n).scalar().alias("total_techniques"), "total_relationships",
        "groups_with_techniques", t.agg(F.count_if("is_subtechnique")).scalar().alias("subtechniques"))


def related_objects(objects: DataFrame, relationships: DataFrame, src_type: str, rel_type: str, target_type: str,
                    reverse: bool = False) -> DataFrame:
    """Object → related object rows of one relationship kind; ``reverse`` maps targets to sources.

    Revoked relationships and revoked related objects are left out.
    """
    rel = relationships.where((F.col("relationship_type") == rel_type) & ~F.col("revoked")
                              & (F.col("source_type") == src_type) & (F.col("target_type") == target_type))
    a, b = ("target_ref", "source_ref") if reverse else ("source_ref", "target_ref")
    kind = src_type if reverse else target_type
    other = objects.where(is_type(kind) & ~F.col("revoked")).select(
        F.col("id").alias("related_id"), F.col("name").alias("related_name"), F.col("attack_id").alias("related_attack_id"))
    return rel.select(F.col(a).alias("object_id"), F.col(b).alias("related_id")).join(other, "related_id")


def mapping(objects: DataFrame, relationships: DataFrame, name: str, reverse: bool = False) -> DataFrame:
    return related_objects(objects, relationships, *MAPPINGS[name], reverse=reverse)


def software_of_groups(objects: DataFrame, relationships: DataFrame) -> DataFrame:
    """Software a group uses itself or through campaigns attributed to it."""
    soft = objects.where(is_type("malware", "tool") & ~F.col("revoked")).select(F.col("id").alias("software"))
    rel = relationships.where(~F.col("revoked"))
    uses = rel.where((F.col("relationship_type") == "uses") & F.col("target_type").isin("malware", "tool")).select(
        "source_type", "source_ref", F.col("target_ref").alias("software")).join(soft, "software", "left_semi")
    direct = uses.where(F.col("source_type") == "intrusion-set").select(F.col("source_ref").alias("group_ref"), "software")
    attributed = rel.where(F.col("relationship_type") == "attributed-to").select("source_ref", F.col("target_ref").alias("group_ref"))
    via = uses.where(F.col("source_type") == "campaign").join(attributed, "source_ref").select("group_ref", "software")
    return direct.union(via).distinct()


def techniques_by_software(objects: DataFrame, relationships: DataFrame) -> DataFrame:
    """Group → software → technique in two hops, distinct.

    Both hops are reduced to distinct pairs first, and the result combines map-side.
    """
    rel = relationships.where((F.col("relationship_type") == "uses") & ~F.col("revoked"))
    is_soft = lambda c: F.col(c).isin("malware", "tool")
    first = rel.where((F.col("source_type") == "intrusion-set") & is_soft("target_type")).select(
        F.col("source_ref").alias("group_ref"), F.col("target_ref").alias("software")).distinct()
    second = rel.where(is_soft("source_type") & (F.col("target_type") == "attack-pattern")).select(
        F.col("source_ref").alias("software"), F.col("target_ref").alias("technique_ref")).distinct()
    live = objects.where(is_type("attack-pattern")).select(F.col("id").alias("technique_ref"), "attack_id")
    return first.join(second, "software").select("group_ref", "technique_ref").distinct().join(live, "technique_ref")


def technique_counts_by_software(objects: DataFrame, relationships: DataFrame) -> DataFrame:
    """Group → number of techniques it reaches through software: ``group_ref, techniques``.

    Techniques are numbers, and a software's are one array: what moves is an array per group
    and software. Pairs of group and technique are built behind that shuffle only, and made distinct where they are.
    """
    rel = relationships.where((F.col("relationship_type") == "uses") & ~F.col("revoked"))
    is_soft = lambda c: F.col(c).isin("malware", "tool")
    number = Window.partitionBy("part").orderBy("technique_ref")
    # small numbers within a part of the techniques; parts are told apart by a hash, so equal rows get equal numbers in every pass
    numbered = objects.where(is_type("attack-pattern")).select(F.col("id").alias("technique_ref")).distinct().withColumn(
        "part", F.pmod(F.xxhash64("technique_ref"), F.lit(NUMBER_PARTS)))
    numbered = numbered.select("technique_ref", ((F.row_number().over(number) - 1) * NUMBER_PARTS + F.col("part")).cast("int").alias("n"))
    second = rel.where(is_soft("source_type") & (F.col("target_type") == "attack-pattern")).select(
        F.col("source_ref").alias("software"), F.col("target_ref").alias("technique_ref"))
    sets = second.join(numbered, "technique_ref").groupBy("software").agg(F.array_sort(F.collect_set("n")).alias("numbers"))
    first = rel.where((F.col("source_type") == "intrusion-set") & is_soft("target_type")).select(
        F.col("source_ref").alias("group_ref"), F.col("target_ref").alias("software")).distinct()
    moved = first.join(sets, "software").select("group_ref", "numbers").repartition("group_ref")
    pairs = moved.select("group_ref", F.explode("numbers").alias("n")).distinct()
    return pairs.groupBy("group_ref").agg(F.count(F.lit(1)).alias("techniques"))


def replaced_by(objects: DataFrame, relationships: DataFrame) -> DataFrame:
    """Revoked objects with the live object that replaces them."""
    rel = relationships.where(F.col("relationship_type") == "revoked-by").select(F.col("source_ref").alias("old_id"), F.col("target_ref").alias("id"))
    return rel.join(objects.where(~F.col("revoked")), "id").select("old_id", F.col("id").alias("new_id"), F.col("name").alias("new_name"))


def select_objects(objects: DataFrame, kind: str | None = None, id: str | None = None, attack_id: str | None = None, name: str | None = None,
                   alias: str | None = None, platform: str | None = None, content: str | None = None, created_after: str | None = None,
                   modified_after: str | None = None, subtechniques: bool | None = None) -> DataFrame:
    """Objects by any combination of the listed properties."""
    out = objects
    if kind:
        out = out.where(is_type(*kind.split("|")))
    for column, value in (("id", id), ("attack_id", attack_id), ("name", name)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if alias is not None:
        out = out.where(F.array_contains("aliases", alias))
    if platform is not None:
        out = out.where(F.array_contains("platforms", platform))
    if content is not None:
        out = out.where(F.lower("description").contains(content.lower()))
    if created_after is not None:
        out = out.where(F.col("created") > F.to_timestamp(F.lit(created_after)))
    if modified_after is not None:
        out = out.where(F.col("modified") > F.to_timestamp(F.lit(modified_after)))
    if subtechniques is not None:
        out = out.where(F.col("is_subtechnique") == subtechniques)
    return out


def matrix_tactics(objects: DataFrame) -> DataFrame:
    """Tactics of every matrix in matrix order."""
    m = objects.where(is_type("x-mitre-matrix")).select(F.col("name").alias("matrix"), F.posexplode("tactic_refs").alias("position", "id"))
    t = objects.where(is_type("x-mitre-tactic")).select("id", F.col("name").alias("tactic"))
    return m.join(t, "id").select("matrix", "position", "tactic")

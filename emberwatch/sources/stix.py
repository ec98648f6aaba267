"""Threat knowledge bundles and release indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Reference source and kill chain names of the knowledge base.
REFERENCE_SOURCE = "mitre-attack"
KILL_CHAINS = ["mitre-attack", "mitre-mobile-attack", "mitre-ics-attack"]

OBJECT_DDL = """
type string, id string, name string, description string, created string, modified string, revoked boolean,
x_mitre_deprecated boolean, x_mitre_is_subtechnique boolean, x_mitre_platforms array<string>, aliases array<string>,
x_mitre_aliases array<string>, tactic_refs array<string>, x_mitre_shortname string, x_mitre_version string,
kill_chain_phases array<struct<kill_chain_name:string,phase_name:string>>,
external_references array<struct<source_name:string,external_id:string,url:string>>,
relationship_type string, source_ref string, target_ref string
"""


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """All objects of one or more bundle files."""
    raw = spark.read.schema(f"type string, objects array<struct<{_struct(OBJECT_DDL)}>>").json(path, multiLine=True)
    return raw.select(F.explode("objects").alias("o")).select("o.*")


def _struct(ddl: str) -> str:
    from pyspark.sql.types import StructType
    return StructType.fromDDL(ddl).simpleString()[len("struct<"):-1]


def objects(bundle: DataFrame) -> DataFrame:
    """Knowledge objects in the flat form the knowledge queries use."""
    refs = F.filter("external_references", lambda r: r["source_name"] == REFERENCE_SOURCE)
    phases = F.filter("kill_chain_phases", lambda p: p["kill_chain_name"].isin(KILL_CHAINS))
    none = F.array().cast("array<string>")
    return bundle.where(F.col("type") != "relationship").select(
        "id", "type", "name", F.coalesce("description", F.lit("")).alias("description"),
        F.to_timestamp("created").alias("created"), F.to_timestamp("modified").alias("modified"),
        F.coalesce("revoked", F.lit(False)).alias("revoked"), F.coalesce("x_mitre_deprecated", F.lit(False)).alias("deprecated"),
        F.coalesce(F.get(refs, F.lit(0))["external_id"], F.lit("")).alias("attack_id"), F.get(refs, F.lit(0))["url"].alias("url"),
        F.coalesce("aliases", "x_mitre_aliases", none).alias("aliases"),
        F.coalesce(F.transform(phases, lambda p: p["phase_name"]), none).alias("tactics"),
        F.coalesce("x_mitre_platforms", none).alias("platforms"),
        F.coalesce("x_mitre_is_subtechnique", F.lit(False)).alias("is_subtechnique"),
        F.coalesce("tactic_refs", none).alias("tactic_refs"))


def relationships(bundle: DataFrame) -> DataFrame:
    """Relationships with the object types of both ends, taken from the id prefixes."""
    return bundle.where(F.col("type") == "relationship").select(
        F.substring_index("source_ref", "--", 1).alias("source_type"), F.substring_index("target_ref", "--", 1).alias("target_type"),
        "source_ref", "relationship_type", "target_ref",
        (F.coalesce("revoked", F.lit(False)) | F.coalesce("x_mitre_deprecated", F.lit(False))).alias("revoked"))


# ------------------------------------------------------------------ release index

def release_index(versions: DataFrame) -> DataFrame:
    """One row per collection: versions, first creation, last modification; named by its oldest version.

    Input: ``collection, version, modified, created, name, description``.
    """
    return versions.groupBy("collection").agg(
        F.count(F.lit(1)).alias("versions"), F.min("created").alias("created"), F.max("modified").alias("modified"),
        F.min_by(F.struct("name", "description"), F.struct("modified", "version")).alias("__n"),
    ).select("collection", "versions", "created", "modified", F.col("__n.name").alias("name"), F.col("__n.description").alias("description"))


def release_listing(versions: DataFrame) -> DataFrame:
    """Flat listing of all versions, newest first within a collection, with a printable date."""
    return versions.orderBy("collection", F.col("modified").desc(), F.col("version").desc()).select(
        "collection", "version", F.date_format("modified", "dd MMMM yyyy").alias("released"))


def alive(df: DataFrame) -> DataFrame:
    """Objects that are neither revoked nor deprecated."""
    return df.where(~F.col("revoked") & ~F.col("deprecated"))


def is_type(*types: str) -> Column:
    return F.col("type").isin(*types)

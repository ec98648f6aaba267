"""Corpus pipeline: five stages from raw documents to token ids.

A stage takes the documents its predecessor kept and returns documents with the
same columns; the last one returns token ids. ``run`` keeps every stage's rows in
the shared checkpoint folder, so that a lost executor costs a stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.llm import decontaminate, line_dedup, pieces, simhash
from emberwatch.llm import toxicity as toxic
from emberwatch.llm.columns import digest, remainder
from emberwatch.llm.queries import load, model_file
from emberwatch.session import cut_lineage


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the toxicity threshold; the fit leaves the held-out labels alone."""
    labels = load(spark, sf_dir, "labels").where(remainder("doc_id", 3) != 1)
    model = toxic.fit(docs, labels)
    return toxic.score(docs, model).where(F.col("score") < toxic.THRESHOLD).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id, of equal ids the one of the smallest row hash.

    Documents that share an id but no group are all kept, as are all without an id, which
    can't be told apart.
    """
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    key = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", *[h.alias(n) for h, n in zip(digest(row), ("h1", "h2"))]))
    keyed = docs.withColumn("__key", key)
    found = simhash.near_duplicates(keyed.select("__key", "text"), doc_id="__key")
    first = found.where(F.col("__key") == F.col("component_id")).select("__key").distinct()
    kept = keyed.join(first, "__key", "left_semi").dropDuplicates(["__key"])
    return kept.unionByName(keyed.where(F.col("__key").isNull())).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return decontaminate.decontaminate(docs, load(spark, sf_dir, "benchmark")).where(F.col("n_hit") == 0).select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether decoding gives the text back."""
    out = pieces.encode(docs.select("doc_id", "text"), model_file(), decoded="decoded")
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", same.alias("round_trip"))


STAGES = [("toxicity", toxicity), ("line_dedup", lines), ("simhash", near_duplicates), ("decontamination", decontamination), ("sentencepiece", token_ids)]

#: No stage before the ids can be told in SQL without its trained model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs)
    return docs

"""One registered query per operator of this subpackage, over whole tables."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.llm import (ball_tree, byte_pairs, decontaminate, embedding_dedup, line_dedup, passages, periods, pieces, quality, sharding, simhash,
                            suffix_dedup, toxicity)
from emberwatch.llm.columns import UPPER, remainder
from emberwatch.session import cut_lineage

LOWER = UPPER.lower()


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def model_file() -> str:
    """The SentencePiece vocabulary: EMBERWATCH_PIECES, or the installed public one."""
    own = os.environ.get("EMBERWATCH_PIECES")
    if own:
        return own
    found = importlib.util.find_spec("public_tokenizers")
    return os.path.join(os.path.dirname(found.origin) if found else "/opt/tokenizers", "piece_bpe_32k.model")


def byte_pair_file() -> str:
    """The byte-level BPE vocabulary: EMBERWATCH_BYTE_PAIRS, or the installed public one."""
    return os.environ.get("EMBERWATCH_BYTE_PAIRS") or os.path.join(os.path.dirname(model_file()), "byte_bpe_50k.json")


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = line_dedup.dedup_lines(load(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = suffix_dedup.dedup_substrings(load(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_compact_windows(spark: SparkSession, folder: str) -> DataFrame:
    return passages.near_passages(load(spark, folder, "documents").select("doc_id", "text"))


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, folder, "documents").select("doc_id", "text"))


def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every text, and whether decoding them gives the text back."""
    out = pieces.encode(load(spark, folder, "documents").select("doc_id", "text"), model_file(), decoded="decoded")
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", same.alias("round_trip"))


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    out = sharding.shard_rows(load(spark, folder, "documents").select("doc_id", "text"))
    return out.withColumn("grown_shard", F.lit(None).cast("int"))


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    out = decontaminate.decontaminate(load(spark, folder, "documents").select("doc_id", "text"), load(spark, folder, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_vectors(load(spark, folder, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = load(spark, folder, "documents").select("doc_id", "text"), load(spark, folder, "labels")
    model = toxicity.fit(docs, labels.where(remainder("doc_id", 3) != 1))
    out = toxicity.score(docs, model)
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "offending")


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = load(spark, folder, "documents"), load(spark, folder, "labels")
    # the statistics are small beside the texts and are needed twice
    measured = cut_lineage(docs.select("doc_id", quality.statistics(F.col("text")).alias("x")))
    train = labels.where(remainder("doc_id", 5) != 0).select("doc_id", F.col("quality").alias("y"))
    model = quality.fit(measured.join(train, "doc_id").select("y", "x"))
    out = quality.scored(measured, model)
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with a repeated part in every tenth document by hash; rows without an id or words stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def repeat(words: Column) -> Column:
        n, g = F.size(words), F.floor(h / 10)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        at = F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
        return F.array_join(F.transform(at, lambda i: F.get(words, i)), " ")

    # one round over an array of the word list, so that the list is made once a row
    words = F.array(F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    made = F.get(F.transform(words, lambda w: F.when(F.size(w) > 0, repeat(w))), 0)
    return docs.select("doc_id", F.coalesce(F.when(h % 10 == 0, made), F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    out = periods.periodic_runs(planted(load(spark, folder, "documents")))
    # by start and period already, so the first of equal exponents is kept
    best = F.aggregate("runs", F.get("runs", 0), lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    out = out.select("doc_id", "runs", "collapsed", best.alias("b"))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("b.start").alias("start"), F.col("b.length").alias("length"), F.col("b.period").alias("period"),
        F.expr("1000 * b.length div b.period").alias("exponent_milli"), F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ball_tree.search(load(spark, folder, "documents").select("doc_id", "text"), load(spark, folder, "benchmark"))


def op13_byte_pairs(spark: SparkSession, folder: str) -> DataFrame:
    out = byte_pairs.encode(load(spark, folder, "documents").select("doc_id", "text"), byte_pair_file(), decoded="decoded")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_suffix_dedup, op3_compact_windows, op4_simhash, op5_sentencepiece, op6_sharding, op7_decontamination,
                                   op8_embedding_dedup, op9_toxicity, op10_quality, op11_periodic_runs, op12_ranked_search, op13_byte_pairs)}

_LINES = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, trim(translate(line, '{UPPER}', '{LOWER}'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM lines),
frequent AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
flagged AS (SELECT k.*, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key)"""

_DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z[:^ascii:]]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z[:^ascii:]]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS s
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
spot AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT spot.doc_id, spot.k, spot.n, win.item_id FROM spot JOIN win ON spot.s = win.s AND spot.n = win.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id"""

# crc32 of a decimal id bit by bit: a byte is mixed in, -1 is one step of the register
_CRC = """xor(4294967295, list_reduce(
  list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT)] || list_transform(range(8), lambda k: CAST(-1 AS BIGINT))))),
  lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END))"""

_PERIODS = f"""
WITH hashed AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {_CRC} AS h FROM documents),
part AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS hit, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS k FROM hashed),
doc AS (
  SELECT doc_id, CASE WHEN hit THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // k) END]) ELSE w END AS w FROM part),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM doc),
same AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM word a JOIN word b ON a.doc_id = b.doc_id AND a.x = b.x AND a.i < b.i),
stretch AS (
  SELECT doc_id, q, min(i) AS s, count(*) + q AS n
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same) GROUP BY doc_id, q, island),
long AS (SELECT * FROM stretch WHERE n >= 2 * q),
run AS (
  SELECT * FROM long l WHERE n >= greatest(6, 4 * q)
    AND NOT EXISTS (SELECT 1 FROM long o WHERE o.doc_id = l.doc_id AND o.q < l.q AND o.s <= l.s AND o.s + o.n >= l.s + l.n)),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS runs FROM run GROUP BY doc_id),
best AS (
  SELECT * FROM run r WHERE NOT EXISTS (
    SELECT 1 FROM run o WHERE o.doc_id = r.doc_id AND (o.n * r.q > r.n * o.q OR (o.n * r.q = r.n * o.q AND (o.s < r.s OR (o.s = r.s AND o.q < r.q)))))),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + n)) AS i FROM run),
kept AS (
  SELECT w.doc_id, string_agg(w.x, ' ' ORDER BY w.i) AS t FROM word w ANTI JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(l.n_runs, 0) AS n_runs, CAST(b.s AS BIGINT) AS start, CAST(b.n AS BIGINT) AS length, CAST(b.q AS BIGINT) AS period,
       CAST(1000 * b.n // b.q AS BIGINT) AS exponent_milli, sha256(coalesce(l.runs, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM doc d LEFT JOIN listed l ON l.doc_id = d.doc_id LEFT JOIN best b ON b.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id"""

_SEARCH = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z[:^ascii:]]+') AS w FROM documents),
size AS (SELECT count(*) AS nn, CAST(sum(len(w)) AS BIGINT) AS ll FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY doc_id, n, t),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
item AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z[:^ascii:]]+')) AS t FROM benchmark),
term AS (SELECT item_id, t, CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) AS weight FROM item JOIN df USING (t), size),
found AS (
  SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * nn) // ll))))) AS BIGINT) AS score
  FROM term JOIN tf USING (t), size GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM found WHERE score > 0) WHERE rank <= 50"""

SQL = {
    "op11_periodic_runs": _PERIODS,
    "op12_ranked_search": _SEARCH,
    "op1_line_dedup": _LINES + """
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id""",
    "op7_decontamination": _DECONTAMINATION,
    "op8_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
         label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
         AND list_count(embedding) = len(embedding) AND isfinite(list_sum(CAST(embedding AS DOUBLE[])))
         AND (list_max(embedding) <> 0 OR list_min(embedding) <> 0) AS ok
  FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND a.ok AND b.ok AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
root AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(d.n, 0) AS n_links, r.component_id, v.vec_id = r.component_id AS kept
FROM v JOIN root r ON r.a = v.vec_id LEFT JOIN degree d ON d.a = v.vec_id""",
}

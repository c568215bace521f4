"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups, name the row that stays.

Only DataFrame functions. Two passes over the texts:
1. rows are grouped by (hash, text). Hash grouping compares the whole text, so a collision of the hash cannot merge
   two texts; copies meet in the map-side combine, so thousands of copies ship as one row a task. What is left is thin:
   hash, id that stays, size, text digest;
2. every row learns its group's facts by its hash. Hashes that hold 1/1000 of all rows are at most 1000 and are broadcast, the
   others are joined by shuffling, thin on both sides.
A hash that two texts share (never seen for a good hash; tests force it) is resolved by the text itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, skew_join


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", normalise: Callable[[Column], Column] = ascii_lower, content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    keep: "min" (smallest id stays) or "max". Null texts count as empty. Null ids never stay if the group has another id;
    in a group of null ids all rows stay. Rows that agree in id and text are one document: they share every column here, so all
    or none of them are kept. Other columns of docs, whatever their names, are not read. An empty table gives no rows.
    """
    best = F.max if keep == "max" else F.min
    base = docs.select(F.col(id_col).alias("_id"), normalise(F.coalesce(F.col(text_col), F.lit(""))).alias("_text")).withColumn("_hash", content_hash(F.col("_text")))
    texts = cut(base.groupBy("_hash", "_text").agg(best("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).select("_hash", "keep_id", "group_size", F.sha2("_text", 256).alias("text_sha256")))
    by_hash = texts.groupBy("_hash").agg(F.count(F.lit(1)).alias("_texts"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.max("text_sha256").alias("text_sha256"))
    seen = by_hash.agg(F.sum("group_size"), F.count(F.when(F.col("_texts") > 1, 1))).first()
    out = skew_join(base.select("_id", "_hash"), by_hash, ["_hash"], "group_size", F.col("_id"), seen[0] or 0)
    if seen[1]:
        shared = by_hash.where("_texts > 1").select("_hash")
        again = base.join(shared, "_hash").withColumn("text_sha256", F.sha2("_text", 256)).select("_id", "_hash", "text_sha256").join(texts, ["_hash", "text_sha256"])
        out = out.where("_texts = 1").select("_id", "keep_id", "group_size", "text_sha256").unionByName(again.select("_id", "keep_id", "group_size", "text_sha256"))
    return out.select(F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """docs without the rows whose text another row already has; columns as they were. Nulls, repeated rows and ids: as in exact_groups; an empty table stays empty."""
    gone = exact_groups(docs, id_col, text_col, keep).where(~F.col("kept")).select(F.col(id_col).alias("_gone"), "text_sha256")
    key = F.sha2(ascii_lower(F.coalesce(docs[text_col], F.lit(""))), 256)
    return docs.join(gone.distinct(), docs[id_col].eqNullSafe(gone["_gone"]) & (key == gone["text_sha256"]), "left_anti")

"""Quality rules: lines that many documents of a host share are removed, and documents they leave depleted are rejected.

Only DataFrame functions. Per document, words, symbols, repeated lines and repeated 3-word windows are counted inside the row,
with arrays; nothing is exploded for that. For the line rule, each document's distinct normalised lines are hashed, the distinct
documents of each (host, line) counted with map-side combine, and only lines above the limit travel back. A document is an id with
its text: copies under ids of their own count each, repeated rows once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, skew_join

SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def line_key(line: Column) -> Column:
    """A line's normal form: lower case, digits as 0, one space between words."""
    return F.xxhash64(F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[0-9]+", "0"), SPACE, " ")))


def text_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with _t (text, null as empty), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, _lines."""
    d = docs.withColumn("_t", F.coalesce(F.col(text_col), F.lit("")))
    d = d.withColumn("_w", words_of(F.col("_t"))).withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: x.rlike(NOT_SPACE)))
    d = d.withColumn("n_words", F.size("_w").cast("long"))
    w = F.col("_w")
    d = d.withColumn("_win", F.when(F.col("n_words") >= 3, F.transform(F.slice(w, F.lit(1), F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>")))
    # Equal windows meet by sorting (hash, place); the places found are sorted again and the union of [place, place + 3) is measured.
    d = d.withColumn("_sorted", F.when(F.size(F.array_distinct("_win")) < F.size("_win"), F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = F.col("_sorted")
    d = d.withColumn("_places", F.sort_array(F.filter(F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"])), lambda p: p.isNotNull())))
    p = F.col("_places")
    reach = F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return (
        d.withColumn("n_repeat_words", F.coalesce(reach, F.lit(0)).cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count("_t", F.lit(SYMBOLS)).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    )


def line_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = 20, min_share: float = 0.2) -> DataFrame:
    """One row per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words, kept.

    A line is removed where more than max_docs different documents of its host hold it; a document is depleted when less than min_share
    of its words is left. Nulls: a null text has no words (and fails the base rule), a null host is a host of its own, null ids are kept
    apart by their content. Repeated rows get equal answers and are one document in the counts. Other columns are not read; an empty table gives no rows.
    """
    base = text_counts(docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("\0")).alias("_host"), F.col(text_col).alias("_text")), "_text")
    base = base.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).withColumn("_doc", F.xxhash64("_id", "_t"))
    counts = cut(base.select("_id", "_doc", "_host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), scan=True)
    lines = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("\0")).alias("_host"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    lines = lines.select("_host", F.xxhash64("_id", "_t").alias("_doc"), F.explode(F.filter(F.split("_t", "\n"), lambda x: x.rlike(NOT_SPACE))).alias("_l"))
    lines = lines.groupBy("_host", "_doc", line_key(F.col("_l")).alias("_line")).agg(F.sum(F.size(words_of(F.col("_l")))).alias("_n"), F.count(F.lit(1)).alias("_rows"))
    lines = cut(lines)
    often = cut(lines.groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_docs")).where(F.col("_docs") > max_docs))
    total = lines.count()
    hit = skew_join(lines.select("_host", "_line", "_doc", "_n", "_rows"), often, ["_host", "_line"], "_docs", F.col("_doc"), total).where(F.col("_docs").isNotNull())
    # repeated rows were summed together; their number divides out again
    lost = hit.groupBy("_host", "_doc").agg(F.sum("_n").alias("_gone"))
    copies = counts.groupBy("_host", "_doc").agg(F.count(F.lit(1)).alias("_copies"))
    lost = cut(copies.join(lost, ["_host", "_doc"]).select("_host", "_doc", "_copies", (F.col("_gone") / F.col("_copies")).cast("long").alias("removed_words")))
    out = skew_join(counts, lost, ["_host", "_doc"], "_copies", F.col("_id"), counts.count())
    left = F.col("n_words") - F.coalesce(F.col("removed_words"), F.lit(0))
    return out.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.coalesce(F.col("removed_words"), F.lit(0)).alias("removed_words"),
        (~F.col("base_failed") & (left >= F.lit(min_share) * F.col("n_words"))).alias("kept"),
    )

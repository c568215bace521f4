"""Benchmark decontamination by winnowing: which words of a document stand in a passage that a benchmark item holds too.

Only DataFrame functions. Every window of `window` words has as its fingerprint the least of the hashes of its `gram`-word grams, on both
sides alike, so that a document window that equals an item's has the same fingerprint: no shared span of `window` words is missed.
1. the items' windows, each once, with the set of items that hold it (sets are told apart by count, xor and sum of 64-bit hashes of the ids);
2. one pass over the documents: each window's fingerprint is looked up among the items'. While those are at most `small`, they are
   broadcast (their number is counted first) and no text is shuffled; beyond that, the documents' distinct fingerprints are joined by
   shuffling, and only documents that share one go on;
3. fingerprints only nominate. A nominated window's words are compared with the items' as a whole, and windows that hold extend to spans.
An item of fewer words than a window is one window of its own length; documents' windows of those lengths are looked up as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: So many windows of the items are broadcast at most: about 30 MB.
SMALL = 1 << 18


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _grams(w: Column, n: int) -> Column:
    """The hash of the n words from each place on."""
    return F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(0))), lambda x, i: F.xxhash64(F.lit(n), x, *[F.get(w, i + k) for k in range(1, n)]))


def _winnowed(w: Column, g: Column, window: int, gram: int) -> Column:
    """Each window's fingerprint: the least hash of the grams in it."""
    if window == gram:
        return g
    return F.transform(F.slice(g, F.lit(1), F.greatest(F.size(w) - (window - 1), F.lit(0))), lambda x, i: F.least(x, *[F.get(g, i + k) for k in range(1, window - gram + 1)]))


def _phrase(w: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(w, start + 1, length), " ")


def _windows(df: DataFrame, lengths: list[int], gram: int) -> DataFrame:
    """df with a row for each window of its words _w (column _n: their number): _start, _length, _f, and one more with _start -1 for the row itself."""
    window = lengths[0]
    df = df.withColumn("_g", _grams(F.col("_w"), min(gram, window)))
    df = df.withColumn("_m", F.concat(F.array(F.lit(None).cast("long")), _winnowed(F.col("_w"), F.col("_g"), window, min(gram, window)), *[_grams(F.col("_w"), n) for n in lengths[1:]]))
    df = df.select(*[c for c in df.columns if c not in ("_g", "_m")], F.posexplode_outer("_m").alias("_p", "_f"))  # outer: the filter that Spark infers for the other would compute all this anew for each element
    start, length, base = F.when(F.col("_p") == 0, -1), F.when(F.col("_p") == 0, 0), F.lit(1)
    for n in lengths:
        after = base + F.greatest(F.col("_n") - (n - 1), F.lit(0))
        start, length, base = start.when(F.col("_p") < after, F.col("_p") - base), length.when(F.col("_p") < after, F.lit(n)), after
    return df.withColumn("_start", start).withColumn("_length", length).drop("_p")


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = 10, gram: int = 5) -> tuple[DataFrame, DataFrame, list[int]]:
    """(windows, sets, lengths): _f, _win and _set of each distinct window of the items, the items of each set, and the windows' lengths (the longest first)."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("_item"), words_of(F.col(text_col)).alias("_w")).withColumn("_n", F.size("_w")).where("_n > 0")
    short = items.where(F.col("_n") < window).select("_n").distinct().collect()  # at most window - 1
    lengths = [window, *sorted((r["_n"] for r in short), reverse=True)]
    own = _windows(items, lengths, gram).where((F.col("_start") >= 0) & (F.col("_length") == F.least(F.col("_n"), F.lit(window))))
    pairs = cut(own.select("_f", _phrase(F.col("_w"), F.col("_start"), F.col("_length")).alias("_win"), "_item").distinct())
    h = F.xxhash64("_item")
    sets = F.concat_ws(":", F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(38,0)")))
    windows = cut(pairs.groupBy("_f", "_win").agg(sets.alias("_set")))
    first = windows.groupBy("_set").agg(F.min("_win").alias("_win"))
    return windows, cut(pairs.join(first, "_win").select("_set", "_item")), lengths


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, gram: int = 5, small: int = SMALL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, hits, sets): _row, id as _id, _hash of the text and _n (words) of each document; _row, _start, _length and _set of each of
    its windows that an item holds; the items (_item, as text) of each set.

    A null text has no words; a null item_id counts as an id of no characters. Repeated rows and ids are documents of their own, repeated
    items of one id are one. Other columns, whatever their names, are not read; empty tables, on either side, give no hits.
    """
    windows, sets, lengths = benchmark_windows(benchmark, item_col, item_text_col, window, gram)
    d = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_hash"), F.col(text_col).alias("_t"))
    prints, phrase = windows.select(F.col("_f").alias("_known")).distinct(), _phrase(F.col("_w"), F.col("_start"), F.col("_length"))
    spread = lambda df: _windows(df.withColumn("_w", words_of(F.col("_t"))).drop("_t").withColumn("_n", F.size("_w")), lengths, gram)
    if windows.count() <= small:
        met = spread(d).join(F.broadcast(prints), F.col("_f") == F.col("_known"), "left").where("_start < 0 or _known is not null")
        met = cut(met.select("_row", "_id", "_hash", "_n", "_start", "_length", "_f", F.when(F.col("_start") >= 0, phrase).alias("_win")), scan=True)
        base, met, windows, sets = met.where("_start < 0").select("_row", "_id", "_hash", "_n"), met.where("_start >= 0"), F.broadcast(windows), F.broadcast(sets) if sets.count() <= small else sets
    else:
        d = cut(d, scan=True)
        w = d.withColumn("_w", words_of(F.col("_t"))).withColumn("_n", F.size("_w"))
        base = cut(w.select("_row", "_id", "_hash", "_n"), scan=True)
        some = w.select("_row", "_w", "_n").withColumn("_g", _grams(F.col("_w"), min(gram, window)))
        some = some.withColumn("_m", F.array_distinct(F.concat(_winnowed(F.col("_w"), F.col("_g"), window, min(gram, window)), *[_grams(F.col("_w"), n) for n in lengths[1:]])))
        rows = cut(some.select("_row", F.explode_outer("_m").alias("_known")).join(prints, "_known", "left_semi").select("_row").distinct())
        met = spread(d.join(rows, "_row", "left_semi")).where("_start >= 0").withColumn("_win", phrase)
    return base, cut(met.join(windows, ["_f", "_win"]).select("_row", "_start", "_length", "_set")), sets


def _reach() -> Column:
    """Where the windows that begin before (or with) this one end."""
    return F.max(F.col("_start") + F.col("_length")).over(Window.partitionBy("_row").orderBy("_start", "_length").rowsBetween(Window.unboundedPreceding, -1))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: id, n_words, n_hit (words inside a window that an item holds), n_items, items_sha256 (of the items' ids, sorted as
    text, with commas between), contaminated (n_hit > 0). options and edge cases: see matches."""
    base, hits, sets = matches(docs, benchmark, id_col, **options)
    end = F.col("_start") + F.col("_length")
    fresh = hits.withColumn("_reach", F.coalesce(_reach(), F.lit(0))).withColumn("_new", F.greatest(F.lit(0), end - F.greatest("_start", "_reach")))
    words = fresh.groupBy("_row").agg(F.sum("_new").alias("n_hit"))
    items = hits.select("_row", "_set").distinct().join(sets, "_set").groupBy("_row").agg(F.collect_set("_item").alias("_items"))
    out = base.join(words.join(items, "_row"), "_row", "left")
    found = F.coalesce(F.col("_items"), F.array().cast("array<string>"))
    return out.select(
        F.col("_id").alias(id_col), F.col("_n").cast("long").alias("n_words"), F.coalesce(F.col("n_hit"), F.lit(0)).cast("long").alias("n_hit"), F.size(found).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(found), ","), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """id, start and length (in words) of each maximal run of words that the items' windows cover; windows that only touch are one run. Edge cases: see matches."""
    base, hits, _ = matches(docs, benchmark, id_col, **options)
    hits = hits.withColumn("_opens", F.when(F.col("_start") > F.coalesce(_reach(), F.lit(-1)), 1).otherwise(0))
    hits = hits.withColumn("_span", F.sum("_opens").over(Window.partitionBy("_row").orderBy("_start", "_length").rowsBetween(Window.unboundedPreceding, 0)))
    runs = hits.groupBy("_row", "_span").agg(F.min("_start").alias("start"), F.max(F.col("_start") + F.col("_length")).alias("_end"))
    return base.join(runs, "_row").select(F.col("_id").alias(id_col), F.col("start").cast("long").alias("start"), (F.col("_end") - F.col("start")).cast("long").alias("length"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows in which a benchmark window stands; columns as they were. Edge cases: see matches."""
    base, hits, _ = matches(docs, benchmark, id_col, text_col, **options)
    gone = base.join(hits.select("_row").distinct(), "_row", "left_semi").select(F.col("_id").alias("_gone"), "_hash").distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_gone"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == gone["_hash"]), "left_anti")

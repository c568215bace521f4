"""MinHash near-dedup: bottom-k sketches from one hash function, overlaps by inverted lists, union-sketch estimates, exact Jaccard.

1. Every text becomes a set of word shingles (64-bit hashes); its sketch is the k smallest. Documents of equal sets form a class with one representative.
2. Inverted lists of retained values: a list of at most SHORT members gives its pairs. A pair of similarity 0.8 shares about 0.8 k values, so it meets in
   some short list unless nearly all of what the two share is frequent. A class with at least HOT of its values in long lists is therefore also joined
   another way, without sketches: by its rarest shingles (of n, the n - ceil(0.8 n) + 1 rarest: two sets that are similar enough must share one of these).
3. A pair stays a candidate while its sizes allow the similarity and the estimate from the bottom k of the union is not far below it; then the full sets decide.
   Each class is first tried with its most similar candidate; pairs inside one component need no more work.
4. In long lists of step 2 no pairs are listed: pivots (one at first, then eight times as many in each round) are tried against the members outside their component, then leave the list. A
   group of near copies falls into one component in the first rounds. Rounds go on until every list is inside one component or used up.

   A list has each value's place in its set's order by rarity: pairs whose first common value comes too late, or whose signatures are too far apart, are left out.

Chance enters in the estimates and signatures only: for k = 64 a link at exactly 0.8 is missed with a probability of about 1e-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, lean, mix64, release, skew_join, text_runs, word_hashes

SKETCH, SHORT, HOT, ESTIMATE = 64, 16, 0.45, 0.45
#: Members of a long list that are dealt to one task.
SPREAD = 1024
#: A signature has a bit of the smallest hash in each of 256 ranges. At a similarity of 0.8 a bit differs with a probability of 0.1 at most, so over APART of
#: them with one of 1e-8.
_SIGNS, APART = ["s0", "s1", "s2", "s3"], 59
_STEP = np.array([pow(0xC2B2AE3D27D4EB4F, i + 1, 1 << 64) | 1 for i in range(64)], np.uint64)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; fewer words than a shingle: the whole sequence as one."""
    words, at = word_hashes(texts)
    n = words.size
    h = np.zeros(max(0, n - size + 1), np.uint64)
    for i in range(size):
        h += mix64(words[i : i + h.size] * _STEP[i])
    h = mix64(h)
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if hi - lo >= size:
            out.append(np.unique(h[lo : hi - size + 1]))
        elif hi > lo:
            out.append(mix64(np.array([mix64(words[lo:hi] * _STEP[: hi - lo]).sum() + np.uint64(hi - lo)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signature(values: np.ndarray) -> list[int]:
    """256 bits of a sorted set of 64-bit hashes, as four signed words."""
    bins, at = np.unique(values >> np.uint64(56), return_index=True)
    bits = np.zeros(256, np.uint8)
    bits[bins.astype(np.int64)] = (values[at] & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits).view(np.int64).tolist()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def sketch_table(docs: DataFrame, id_col: str, text_col: str, size: int, k: int) -> DataFrame:
    """id, th (hash of the text), n, hi, lo (128-bit hash of the set), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in text_runs(b, text_col):
                sets = shingle_sets(texts, size)
                hi = np.array([mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum() for s in sets], np.uint64)
                lo = np.array([mix64(s + np.uint64(0x14057B7EF767814F)).sum() for s in sets], np.uint64)
                low = [s[:k] for s in sets]
                values = pa.ListArray.from_arrays(np.cumsum([0, *map(len, low)]).astype(np.int32), _signed(np.concatenate(low)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(sets)), b.column(1).slice(at, len(sets)), pa.array([s.size for s in sets], pa.int64()), _signed(hi), _signed(lo), values], names=["id", "th", "n", "hi", "lo", "sketch"])

    return docs.select(F.col(id_col).cast("long"), F.xxhash64(text_col).alias("_th"), F.col(text_col)).mapInArrow(lean(run), "id long, th long, n long, hi long, lo long, sketch array<long>")


def full_sets(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """id, shingles (sorted 64-bit hashes as bytes) of the classes (id, rep, th), from the text that each one's representative has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in text_runs(b, text_col):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.array([s.tobytes() for s in shingle_sets(texts, size)], pa.binary())], names=["id", "shingles"])

    found = docs.select(F.col(id_col).cast("long").alias("rep"), F.xxhash64(text_col).alias("th"), F.col(text_col)).join(classes, ["rep", "th"])
    # repeated rows count once, by the join's own partitions
    return found.groupBy("rep", "th", "id").agg(F.max(text_col).alias(text_col)).select("id", text_col).mapInArrow(lean(run), "id long, shingles binary")


def _size_ok(a: str, b: str, level: Fraction):
    lo, hi = F.least(a, b), F.greatest(a, b)
    return lo * level.denominator >= hi * level.numerator


def estimated(pairs: DataFrame, reps: DataFrame, k: int, level: Fraction) -> DataFrame:
    """pairs (a, b) whose union sketch doesn't rule the similarity out, with est."""
    one = pairs.join(reps.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
    two = one.join(reps.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b").where(_size_ok("na", "nb", level))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sa, sb = (c.flatten().to_numpy().view(np.uint64) for c in b.columns[2:4])
            oa, ob = (np.concatenate([[0], np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False))]).astype(int) for c in b.columns[2:4])
            est = np.zeros(b.num_rows)
            for i in range(b.num_rows):
                x, y = sa[oa[i] : oa[i + 1]], sb[ob[i] : ob[i + 1]]
                union = np.union1d(x, y)[:k]
                est[i] = np.isin(union, np.intersect1d(x, y, True), True).mean()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(est)], names=["a", "b", "est"])

    return two.select("a", "b", "sa", "sb").mapInArrow(lean(run), "a long, b long, est double").where(F.col("est") >= ESTIMATE)


def verified(pairs: DataFrame, sets: DataFrame, level: Fraction) -> DataFrame:
    """pairs (a, b) whose full sets are similar enough."""
    both = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.intersect1d(p, q, True).size
                keep.append(both * level.denominator >= (p.size + q.size - both) * level.numerator)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(lean(run), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id, comp (smallest id reachable) of every id in links but the smallest themselves: large-star and small-star by turns until nothing moves."""
    edges, before = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), None
    last = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = cut(small, "edges")
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if last is not None:
            discard(last)
        last = edges
        if mark == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("comp"))
        before = mark


def _with_comp(df: DataFrame, comps: DataFrame | None, key: str, name: str) -> DataFrame:
    if comps is None:
        return df.withColumn(name, F.col(key))
    return df.join(comps.select(F.col("id").alias(key), F.col("comp").alias("_comp")), key, "left").withColumn(name, F.coalesce("_comp", key)).drop("_comp")


def _merged(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after more links, which are given between components (a, b)."""
    step = components(links)
    if comps is None:
        return step
    moved = _with_comp(comps.select("id", F.col("comp").alias("c")), step, "c", "comp").select("id", "comp")
    return cut(moved.union(step.join(comps.select("id"), "id", "left_anti")), "comps")


def _pivot_rounds(lists: DataFrame, sets: DataFrame, comps: DataFrame | None, level: Fraction) -> DataFrame | None:
    """Resolve long lists (v, id, n, at, w, size and signature): see step 4 above. A list's members are dealt over tasks in parts of about SPREAD of them."""
    tried, pivots = None, 1
    parts = F.ceil(F.col("size") / SPREAD)
    lists = lists.withColumn("part", F.pmod(F.xxhash64("id"), parts))
    every_part = F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part")
    # what two sets share from their first common value on has to be enough, and their signatures near enough
    fits = F.least(F.col("n") - F.col("at"), F.col("na") - F.col("ata")) * (level.numerator + level.denominator) >= (F.col("n") + F.col("na")) * level.numerator
    alike = reduce(add, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}a"))) for c in _SIGNS]) <= APART
    while True:
        now = _with_comp(lists, comps, "id", "comp")
        alive = now.groupBy("v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m"), F.max(F.struct("w", (-F.col("id")).alias("i"))).alias("top"), F.max("size").alias("size")).where("lo <> hi")
        alive = alive.select("v", "m", (-F.col("top.i")).alias("top"), every_part)
        before, now = lists, cut(now.join(alive, ["v", "part"]), "lists")
        if now.isEmpty():
            return comps
        # the member with most values in lists leads first; after that about `pivots` members by hash, and all of a list that is no longer than that
        chosen = F.col("id") == F.col("top") if pivots == 1 else F.pmod(F.xxhash64("id", F.lit(pivots)), F.ceil(F.col("m") / pivots)) == 0
        lead = now.where(chosen | (F.col("id") == F.col("top"))).select("v", F.col("id").alias("a"), F.col("n").alias("na"), F.col("at").alias("ata"), F.col("comp").alias("ca"), *[F.col(c).alias(f"{c}a") for c in _SIGNS], "size")
        pairs = now.drop("size").join(lead.select("*", every_part).drop("size"), ["v", "part"]).where((F.col("comp") != F.col("ca")) & (F.col("id") != F.col("a")) & _size_ok("n", "na", level) & fits & alike).select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = cut(pairs, "tried")
        tried = pairs if tried is None else tried.union(pairs)
        found = _with_comp(_with_comp(cut(verified(pairs, sets, level), "links"), comps, "a", "ca"), comps, "b", "cb").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        if not found.isEmpty():
            comps = _merged(comps, found)
        lists = now.join(lead.select("v", F.col("a").alias("id")), ["v", "id"], "left_anti").select(*before.columns)
        pivots *= 8


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: str = "0.8", k: int = SKETCH, short: int = SHORT) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable over links), kept (the id is the component's).

    Words are runs of anything but ASCII blanks, A-Z lower-cased. A text without words, or null, has an empty set and is linked with nothing. Rows with
    a null id are linked with nothing and have a null component. Rows that repeat an id are one document in the links: they share a component, and what any
    of their texts is linked with belongs to it. Ids must be integers. Other columns, whatever their names, are not read; an empty table gives no rows.
    """
    spark, level = docs.sparkSession, Fraction(similarity)
    rows = cut(sketch_table(docs, id_col, text_col, size, k), "sketches", scan=True)
    # a class: the rows of one set; its number is what links and components are about, since an id may stand in several classes
    sets_of = rows.where("id is not null and n > 0").groupBy("hi", "lo").agg(F.min(F.struct("id", "th")).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    reps = cut(sets_of.select(F.monotonically_increasing_id().alias("id"), "hi", "lo", F.col("rep.id").alias("rep"), F.col("rep.th").alias("th"), "copies", "n", "sketch"), "reps")
    classes = cut(reps.drop("sketch", "n"), "classes")
    slim = cut(skew_join(rows.select(F.col("id").alias("doc"), "n", "hi", "lo"), classes.select("hi", "lo", "id", "copies"), ["hi", "lo"], "copies", F.col("doc")).select("doc", "n", "id"), "sizes")
    discard(rows)
    inverted = reps.select("id", "n", F.explode("sketch").alias("v"))
    sizes = cut(inverted.groupBy("v").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "sizes")
    member = cut(skew_join(inverted, sizes, ["v"], "m", F.concat_ws(".", "id", "v"), reps.agg(F.sum(F.size("sketch"))).first()[0] or 0).where("m > 1"), "member")
    release(spark)
    near = member.where(F.col("m") <= short).select("v", "id", "n")
    pairs = near.alias("p").join(near.alias("q"), "v").where("p.id < q.id").where(_size_ok("p.n", "q.n", level)).select(F.col("p.id").alias("a"), F.col("q.id").alias("b")).distinct()
    cand = cut(estimated(pairs, reps, k, level), "candidates")
    hot = cut(member.where(F.col("m") > short).groupBy("id", "n").agg(F.count(F.lit(1)).alias("w")).where(F.col("w") >= HOT * F.least("n", F.lit(k))).select("id", "n"), "hot")
    discard(reps, sizes, member)
    release(spark)
    need = cand.select(F.col("a").alias("id")).union(cand.select(F.col("b").alias("id"))).union(hot.select("id")).distinct()
    sets = cut(full_sets(docs, classes.select("id", "rep", "th").join(need, "id"), id_col, text_col, size), "sets")
    release(spark)
    first = cand.groupBy("b").agg(F.max(F.struct("est", (-F.col("a")).alias("m"))).alias("x")).select((-F.col("x.m")).alias("a"), "b")
    comps = components(cut(verified(first, sets, level).union(_same_document(slim)), "links"))
    rest = _with_comp(_with_comp(cand.select("a", "b"), comps, "a", "ca"), comps, "b", "cb").where("ca <> cb").join(first, ["a", "b"], "left_anti")
    found = cut(verified(rest, sets, level), "links")
    if not found.isEmpty():
        comps = _merged(comps, _with_comp(_with_comp(found, comps, "a", "ca"), comps, "b", "cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    if not hot.isEmpty():
        comps = _pivot_rounds(_rare_lists(hot, sets, level), sets, comps, level)
    # a component's name is the smallest document id of its classes
    linked = comps.union(comps.select(F.col("comp").alias("id"), "comp").distinct()).join(classes.select("id", "rep"), "id")
    names = cut(linked.groupBy("comp").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("m")), "names")
    of_class = skew_join(linked.select("id", "comp"), names, ["comp"], "m", F.col("id")).select("id", "component_id")
    named = cut(classes.join(of_class, "id", "left").select("id", F.coalesce("component_id", "rep").alias("component_id"), "copies"), "named")
    out = skew_join(slim.where("doc is not null and id is not null"), named, ["id"], "copies", F.col("doc")).select("doc", "n", "component_id")
    out = out.union(slim.where("doc is null or id is null").select("doc", "n", F.col("doc").alias("component_id")))
    return out.select(F.col("doc").cast(docs.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"), F.col("component_id").cast(docs.schema[id_col].dataType).alias("component_id"), F.col("doc").eqNullSafe(F.col("component_id")).alias("kept"))


def _same_document(slim: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of one document id: each one's first class with every other."""
    known = slim.where("doc is not null and id is not null").select("doc", "id")
    first = cut(known.groupBy("doc").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.count(F.lit(1)).alias("m")).where("a < z").select("doc", "a", "m"), "twice")
    return skew_join(known, first, ["doc"], "m", F.col("id")).where("a < id").select("a", F.col("id").alias("b")).distinct()


def _rare_lists(hot: DataFrame, sets: DataFrame, level: Fraction) -> DataFrame:
    """Lists (v, id, n, at, w, size, signature) by each hot class's rarest shingles; w: how many of its values stand in lists of two or more; size: sets with the value."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, n, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                v = np.frombuffer(s.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(v.size, d)), pa.array(np.full(v.size, n)), pa.array(v)], names=["id", "n", "v"])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = np.array([signature(np.frombuffer(s.as_buffer(), np.uint64)) for s in b.column(1)], np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(words[:, i])) for i in range(4))], names=["id", *_SIGNS])

    values = cut(hot.join(sets, "id").select("id", "n", "shingles").mapInArrow(lean(explode), "id long, n long, v long"), "values")
    often = cut(values.groupBy("v").agg(F.count(F.lit(1)).alias("m")), "often")
    with_m = skew_join(values, often, ["v"], "m", F.concat_ws(".", "id", "v"))
    ranked = with_m.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("m", "v"))).alias("s"))  # one set a row
    prefix = F.col("n") - F.ceil(F.col("n") * level.numerator / level.denominator) + 1
    numbered = F.transform(F.slice("s", F.lit(1), prefix.cast("int")), lambda x, i: F.struct(x["m"].alias("m"), x["v"].alias("v"), i.cast("long").alias("at")))
    lists = ranked.select("id", "n", F.filter(numbered, lambda x: x["m"] > 1).alias("s")).select("id", "n", F.size("s").alias("w"), F.explode("s").alias("e")).select("e.v", "id", "n", "e.at", "w", F.col("e.m").alias("size"))
    signs = hot.join(sets, "id").select("id", "shingles").mapInArrow(sign, "id long, " + ", ".join(f"{c} long" for c in _SIGNS))
    out = cut(lists.join(signs, "id").select("v", "id", "n", "at", "w", "size", *_SIGNS), "rare")
    discard(values, often)
    release(hot.sparkSession)
    return out


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: str = "0.8") -> DataFrame:
    """docs without all but one document (the one of smallest id) of each group of near copies. Columns as they were."""
    gone = near_groups(docs, id_col, text_col, size, similarity).where(~F.col("kept")).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti")
